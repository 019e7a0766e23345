"""Document fingerprints by SpotSigs, in DataFrame functions only.

A run of common words is an anchor; the next ``CHAIN`` content words after it, passing over later common words, are a chain, and the
hash of a chain is a signature.  The start of a text is an anchor as well, whose chain is its first ``HEAD`` words one by one, so that
texts without common words have a likeness too.  The common words are a fixed list, so a text's fingerprint depends on the text alone
and stays the same as a corpus grows.  The likeness of two fingerprints is the Jaccard share of their signatures.

A fingerprint is printed as the number of signatures, a hash of all of them and the ``SKETCH`` least ones: ``sketch_likeness``
estimates from two of them what ``likeness`` gives for the whole sets.

Defined cases: null texts count as empty; texts without a letter or digit have the fingerprint of the empty set, and two of those have
likeness 1; texts of any length are taken whole; equal texts have equal fingerprints; rows of one key are in the order of a hash of
their text; repeated rows stay rows, each but one of them being followed by its like; null keys come first; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

CHAIN, HEAD, SKETCH, THRESHOLD = 3, 8, 8, 0.8
#: Rows of a block, and ranges of keys at two levels: at most OUTER * INNER of them, whatever the table.
BLOCK, OUTER, INNER = 512, 1024, 256
#: Common words of English, French, German and Spanish.
COMMON = (
    "the of and to in a is that it for was on as with be by this are at an from or "
    "de la le les des et un une que en du est pour qui dans au par sur pas avec "
    "der die und den von zu das mit sich auf ist im nicht ein eine dem als "
    "el los las se del por con no su al lo es y"
).split()


def one_of(words: list[str]) -> str:
    """A regular expression for any of the words, with shared beginnings written once: a matcher then tries few ways."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        ways = [c + written(node[c]) for c in sorted(node) if c]
        out = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})" if ways else ""
        return out + "?" if "" in node and ways else out

    return written(tree)


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sorted array of the text's signatures."""
    line = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    # cut at each common word by itself: a pattern for runs of them would nest as deep as the longest run
    df = df.withColumn("_line", line).withColumn("_parts", F.split("_line", f" {one_of(COMMON)}(?= )"))
    df = df.withColumn("_parts", F.array_remove(F.transform(F.slice("_parts", F.lit(2), F.size("_parts")), lambda s: F.trim(s)), ""))
    at = lambda i: F.coalesce(F.get(F.col("_parts"), i), F.lit(""))
    chains = F.transform("_parts", lambda s, i: F.trim(F.substring_index(F.concat_ws(" ", s, at(i + 1), at(i + 2)), " ", CHAIN)))
    df = df.withColumn("_chains", chains)
    words = F.split(F.substring_index(F.trim("_line"), " ", HEAD), " ")
    own = F.concat("_chains", F.transform(F.array_remove(words, ""), lambda w: F.concat(F.lit("="), w)))
    return df.withColumn(out, F.array_sort(F.array_distinct(F.transform(own, lambda s: F.xxhash64(s))))).drop("_line", "_parts", "_chains")


def digest(signatures: str) -> Column:
    """A fingerprint as text: how many signatures, a hash of all of them, and the least ones."""
    joined = lambda x: F.array_join(x.cast("array<string>"), ",")
    every = F.col(signatures)
    return F.concat_ws(":", F.size(every).cast("string"), F.substring(F.sha2(joined(every), 256), 1, 16), joined(F.slice(every, 1, SKETCH)))


def sketch_likeness(a: str, b: str) -> Column:
    """The estimated likeness of two printed fingerprints: of the least signatures of both, the share that both have."""
    least = lambda c: F.array_remove(F.split(F.split(F.col(c), ":")[2], ","), "").cast("array<bigint>")
    union = F.slice(F.array_sort(F.array_union(least(a), least(b))), 1, SKETCH)
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(F.coalesce(F.try_divide(F.size(F.array_intersect(F.array_intersect(union, least(a)), least(b))), F.size(union)), F.lit(0.0)))


def likeness(a: str, b: str) -> Column:
    both = F.size(F.array_intersect(F.col(a), F.col(b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both).cast("double"))


def _place(bounds: Column, x: Column, most: int) -> Column:
    """How many of at most ``most`` sorted bounds are at or below x, by halving."""
    steps = [1 << j for j in range(most.bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*[F.lit(n) for n in steps]), F.lit(0), lambda at, step: F.when(F.coalesce(F.get(bounds, at + step - 1) <= x, F.lit(False)), at + step).otherwise(at))


def with_block(df: DataFrame, key: str, tie: str) -> DataFrame:
    """``df`` with (_block, _sub): ranges of (key, tie) in ascending order, of about BLOCK rows each, whatever the keys are like.

    Bounds are quantiles of the keys: up to OUTER ranges, and for larger tables INNER ones within each.  A key that has as many rows
    as four ranges is a range of its own, cut by the tie, which is a hash."""
    x = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    n = df.count()
    outer = max(1, min(OUTER, -(-n // BLOCK)))
    inner = max(1, min(INNER, -(-n // (BLOCK * outer))))
    cuts = lambda k: [i / k for i in range(1, k)]
    out = df.withColumn("_x", x)
    if outer == 1:
        return out.withColumns({"_block": F.lit(0), "_sub": F.lit(0)})
    bounds = df.agg(F.percentile_approx(x, cuts(outer), 100 * outer)).first()[0]
    first = F.array(*[F.lit(b) for b in bounds])
    if inner > 1:
        at = _place(first, x, outer)
        finer = F.broadcast(df.select(at.alias("_o"), x.alias("_x")).groupBy("_o").agg(F.percentile_approx("_x", cuts(inner), 100 * inner).alias("_b")))  # at most OUTER rows of INNER bounds
        out = out.withColumn("_o", at).join(finer, "_o").withColumn("_block", F.col("_o") * inner + _place(F.col("_b"), F.col("_x"), inner)).drop("_o", "_b")
    else:
        out = out.withColumn("_block", _place(first, F.col("_x"), outer))
    many = df.groupBy(x.alias("_hot")).agg(F.count("*").alias("_n")).where(F.col("_n") > 4 * n / outer)  # fewer than OUTER / 4 rows
    hot = F.broadcast(many.select("_hot", F.ceil(F.col("_n") / max(BLOCK, n / (OUTER * INNER))).alias("_parts")))
    # such a key is the least of its block, so the block's other keys come behind it
    share = F.floor((F.col(tie) / float(1 << 64) + 0.5) * F.col("_parts")).cast("int")
    return out.join(hot, F.col("_x") == F.col("_hot"), "left").withColumn("_sub", F.coalesce(share, F.lit((1 << 31) - 1))).drop("_hot", "_parts")


def with_next(df: DataFrame, key: str, text: str, prepared: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """``prepared(df)`` with ``next_<column>`` of the row with the next key (after the last: the first), null keys first.

    Rows are dealt by ranges of keys, and each range also gets the first row of the next: no global sort.  Rows move once, and are
    prepared where they arrive."""
    raw = with_block(df.withColumn("_tie", F.xxhash64(text)), key, "_tie")
    edges = durable(raw.groupBy("_block", "_sub").agg(F.min(F.struct("_x", "_tie")).alias("_first")))
    # the one window without a partition sees a row for each range: at most OUTER * INNER, and as many for keys of many rows
    order = Window.orderBy("_block", "_sub")
    span = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct("_block", "_sub")
    ends = edges.select(F.col("_block"), F.col("_sub"), "_first", F.coalesce(F.lag(own).over(order), F.last(own).over(span)).alias("_target"))
    heads = raw.join(F.broadcast(ends), ["_block", "_sub"]).where((F.col("_x") == F.col("_first._x")) & (F.col("_tie") == F.col("_first._tie")))
    heads = heads.dropDuplicates(["_block", "_sub"]).withColumn("_block", F.col("_target._block")).withColumn("_sub", F.col("_target._sub")).drop("_first", "_target")
    both = prepared(raw.withColumn("_head", F.lit(0)).unionByName(heads.withColumn("_head", F.lit(1))).repartition("_block", "_sub"))
    after = Window.partitionBy("_block", "_sub").orderBy("_head", "_x", "_tie")
    return both.withColumns({f"next_{c}": F.lead(c).over(after) for c in columns}).where("_head = 0").drop("_block", "_sub", "_head", "_x", "_tie")


def near_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's fingerprint, that of its edited text (its last quarter replaced by the start of the next row's), and likenesses."""
    slim = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    slim = with_next(slim, key, "text", lambda d: with_signatures(d, "text", "sigs"), ["text", "sigs"])
    quarter = F.floor(F.length("text") / 4).cast("int")
    slim = slim.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.substring(F.col("next_text"), F.lit(1), quarter)))
    slim = with_signatures(slim.select(key, F.length("text").cast("long").alias("n_chars"), "edited", "sigs", "next_sigs"), "edited", "edited_sigs")
    return slim.select(
        key, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digest("sigs").alias("fingerprint"), digest("edited_sigs").alias("edited_fingerprint"),
        likeness("sigs", "edited_sigs").alias("near_edited"), likeness("sigs", "next_sigs").alias("near_next"),
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(membership: key, class_id; pairs: class_a, class_b, likeness of at least ``threshold``).

    Rows of equal fingerprints are one class.  Classes are partitioned by set length so that those within the threshold are in the
    same or the next partition; there they meet on the rarest signatures of each (a prefix long enough that two sets within the
    threshold share one), are pruned by length, and compared whole."""
    own = durable(with_signatures(docs.select(key, text), text, "sigs").select(key, "sigs", digest("sigs").alias("print")))
    members = own.select(key, F.col("print").alias("class_id"))
    sets = durable(own.groupBy("print").agg(F.any_value("sigs").alias("sigs")))
    tokens = sets.select("print", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    rare = tokens.groupBy("sig").agg(F.count("*").alias("df"))
    placed = tokens.join(rare, "sig").where("df > 1")  # a signature of one class links nothing
    # the prefix counts all signatures, so those of df 1 are its first
    singles = placed.groupBy("print").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("shared"))
    prefix = F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1 - (F.col("n") - F.size("shared"))
    part = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold)))
    heads = singles.where(prefix > 0).select("print", "n", part.alias("part"), F.explode(F.slice("shared", 1, prefix.cast("int"))).alias("x")).select("print", "n", "part", F.col("x.sig").alias("sig"))
    a, b = heads.alias("a"), heads.select("print", "n", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), "sig").alias("b")
    met = a.join(b, ["part", "sig"]).where("b.n < a.n or (b.n = a.n and b.print < a.print)").where(F.col("b.n") >= F.lit(threshold) * F.col("a.n"))
    met = met.select(F.col("a.print").alias("class_a"), F.col("b.print").alias("class_b")).distinct()
    s, t = sets.select(F.col("print").alias("class_a"), F.col("sigs").alias("sa")), sets.select(F.col("print").alias("class_b"), F.col("sigs").alias("sb"))
    pairs = met.join(s, "class_a").join(t, "class_b").withColumn("likeness", likeness("sa", "sb")).where(F.col("likeness") >= threshold)
    return members, pairs.select("class_a", "class_b", "likeness")
