"""SimHash near-duplicates by meet in the middle.

Two fingerprints that differ in at most 2r bits have a common neighbour within r bits of both.  Every distinct fingerprint emits all
its variants within r = radius / 2 bits; those that meet in a variant are linked.  All that meet in one variant are within the radius
of each other, so each is linked to the least of them (no pairs within the group), and a variant has at most 65 different fingerprints
(r = 1).  Links are deduplicated, verified by their bit distance, and joined up to components.

``representatives`` looks for a similarity of five-word shingles, at which some ten of 64 bits differ: too many for a ball of variants.
So a text gets several fingerprints, each by a hash function of its own, and each is cut in halves of 32 bits.  Texts meet if any half
is within the radius, and are linked if all their bits together show that similarity, or, where bits leave it open, their shingles do.  A
large group of near copies would make many links within itself, so it is brought down first: each text is compared with the one text that
it shares most halves with, and goes where the two are linked.  What is left meets in the halves of the first quarter of its fingerprints,
one text of each group that this links goes on, and those meet in the halves of the others.

Defined cases: null and empty texts, and texts of white space, have fingerprint zero, which is linked like any other; texts of fewer
words than a shingle hash their whole word sequence; equal fingerprints are always linked; repeated rows stay rows; documents of null
id get a fingerprint but never give a component its name unless all ids in it are null; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, durable, row_hashes, settled, small_batches, spread_join, unused
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: For ``representatives``: words of a shingle, fingerprints of a text, the similarity (Jaccard share of shingles) and the bits of a half.
NEAR_SHINGLE, TABLES, SIMILARITY, HALF = 5, 8, 0.8, 32
#: Odd multipliers that mix 64 bits well.
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def prints(text: str | None, k: int = SHINGLE, seed: int = SEED, tables: int = 1) -> list[int]:
    """Fingerprints, unsigned, by as many hash functions: a bit is set if it is set in over half of the shingles' hashes.  The first
    function is XXH64, the others mix its values anew."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return [0] * tables
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(k, len(words))
    starts = np.concatenate(([0], ends[:-k])).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], seed) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)], dtype="<u8")
    set_in = np.zeros(64 * tables, dtype=np.int64)
    for at in range(0, len(h), 255):  # as many as a byte can count
        part = np.stack([_mixed(h[at : at + 255], table) for table in range(tables)], axis=1)
        set_in += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return [int(_BITS[most].sum(dtype=np.uint64)) for most in (set_in * 2 > len(h)).reshape(tables, 64)]


def _mixed(h: np.ndarray, table: int) -> np.ndarray:
    """The hash function of this number: each bit of its values depends on all bits of ``h`` (multiply and shift, twice)."""
    if not table:
        return h
    x = h + np.uint64(table * int(_ODD[0]) % (1 << 64))
    for odd, shift in zip(_ODD[1:], (np.uint64(30), np.uint64(27)), strict=True):
        x = (x ^ (x >> shift)) * odd
    return x ^ (x >> np.uint64(31))


def simhash(text: str | None, k: int = SHINGLE, seed: int = SEED) -> int:
    """The first of ``prints``."""
    return prints(text, k, seed)[0]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, carried: tuple[str, ...] = (), tables: int = 1) -> DataFrame:
    """(key, carried columns, fps): an array of ``tables`` fingerprints as signed longs."""
    small_batches(docs.sparkSession)
    kept = [key, *carried]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("fps", T.ArrayType(T.LongType()))])

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf[kept].assign(fps=[np.array(prints(t, k, SEED, tables), dtype=np.uint64).view(np.int64) for t in pdf[text]])

    return docs.select(*kept, text).mapInPandas(batches, schema)


def masks(half: int, bits: int = 64) -> list[int]:
    """All patterns of at most ``half`` of ``bits`` bits, signed."""
    out = [sum(1 << b for b in places) for n in range(half + 1) for places in combinations(range(bits), n)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def links(fps: DataFrame, radius: int = RADIUS, bits: int = 64) -> DataFrame:
    """Distinct ``fp`` values to verified links (a, b), a < b, that connect all fingerprints within the radius.  Only the low ``bits`` of
    them vary: fingerprints that differ in others never meet."""
    if radius % 2 or not 0 < radius <= 4:
        raise ValueError("radius must be 2 or 4: an even number of bits has a middle")
    flips = F.array(*[F.lit(m).cast("long") for m in masks(radius // 2, bits)])
    variants = fps.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    met = variants.groupBy("variant").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    pairs = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a != b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def most_bits(bits: int, similarity: float = SIMILARITY, errors: int = 2) -> int:
    """How many of ``bits`` may differ between texts of that Jaccard share: what is expected and so many standard errors.  Each bit of sets
    of one size differs with the probability angle / pi, the cosine of the angle being 2s / (1 + s)."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + errors * math.sqrt(bits * p * (1 - p)))


def _halves(every: DataFrame, tables: range) -> tuple[DataFrame, DataFrame]:
    """Distinct (node, fps) to (node, fp) of the halves of these of their fingerprints, each with its place above its 32 bits, and to (fp, least, n): of the
    nodes of a half the least in an order of that half's own, so that no node stands for the same texts everywhere."""
    low = F.lit((1 << HALF) - 1).cast("long")
    halves = [F.lit((2 * t + i) << HALF).cast("long").bitwiseOR(half) for t in tables for i, half in enumerate((F.col("fps")[t].bitwiseAND(low), F.shiftrightunsigned(F.col("fps")[t], HALF)))]
    placed = durable(every.select("node", F.explode(F.array(*halves)).alias("fp")))
    order = F.struct(F.xxhash64("fp", "node"), F.col("node").alias("node"))
    return placed, durable(placed.groupBy("fp").agg(F.min(order)["node"].alias("least"), F.count("*").alias("n")))


def shingle_sets(texts: DataFrame, k: int = NEAR_SHINGLE) -> DataFrame:
    """(node, text) to (node, shingles): the distinct hashes of its shingles, as ``prints`` cuts them."""
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = settled(texts, "w", F.regexp_extract_all(lower, F.lit(f"({WORD})")))
    n = F.least(F.size("w"), F.lit(k))
    each = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, n), " ")))
    return cut.select("node", F.when(F.size("w") > 0, F.array_distinct(each)).otherwise(F.array().cast("array<bigint>")).alias("shingles"))


def _verified(pairs: DataFrame, every: DataFrame, sets: Callable[[DataFrame], DataFrame], tables: int, similarity: float) -> DataFrame:
    """Of a written table of pairs (a, b) of nodes, those of that similarity: where bits leave it open, by the shingles themselves, which
    ``sets`` gives for nodes."""
    of_a = durable(pairs.groupBy("a").agg(F.count("*").alias("n")).join(every.select(F.col("node").alias("a"), F.col("fps").alias("fps_a")), "a"))
    both = spread_join(pairs, of_a, "a", "n").join(every.select(F.col("node").alias("b"), F.col("fps").alias("fps_b")), "b")
    differ = sum((F.bit_count(F.col("fps_a")[t].bitwiseXOR(F.col("fps_b")[t])) for t in range(tables)), F.lit(0))
    near = durable(both.select("a", "b", differ.alias("differ")).where(F.col("differ") <= most_bits(64 * tables, similarity)))
    sure = F.col("differ") <= most_bits(64 * tables, similarity, -2)
    open_ = near.where(~sure).select("a", "b")
    found = durable(sets(open_.select(F.col("a").alias("node")).union(open_.select(F.col("b").alias("node"))).distinct()))
    of = lambda side: found.select(F.col("node").alias(side), F.col("shingles").alias(f"set_{side}"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    exact = open_.join(of("a"), "a").join(of("b"), "b").where(shared >= similarity * (F.size("set_a") + F.size("set_b") - shared))
    return near.where(sure).select("a", "b").unionByName(exact.select("a", "b"))


def first_links(every: DataFrame, sets: Callable[[DataFrame], DataFrame], tables: int = TABLES, similarity: float = SIMILARITY) -> DataFrame:
    """Distinct (node, fps) to links (a, b): each node with the one that stands for most of its halves, if they are alike."""
    placed, groups = _halves(every, range(tables))
    alike = spread_join(placed, groups, "fp", "n").where("least != node").groupBy("node", "least").agg(F.count("*").alias("halves"))
    best = alike.groupBy("node").agg(F.max(F.struct("halves", "least")).alias("x")).select(F.col("x.least").alias("a"), F.col("node").alias("b"))
    return _verified(durable(best), every, sets, tables, similarity)


def _roots(linked: DataFrame, doublings: int = 2) -> DataFrame:
    """Links (a, b), one at most for each b, to (node, above): four steps from each b to its a, so that all whom one node stands for come
    together, whatever the order of their ids.  Nodes that come to the same one are linked with each other; that these steps may end
    in a circle, or below the top, only leaves some of a group apart, which are linked in all halves afterwards."""
    up = durable(linked.select(F.col("b").alias("node"), F.col("a").alias("above")))
    for _ in range(doublings):
        further = up.select(F.col("node").alias("above"), F.col("above").alias("further"))
        up = durable(up.join(further, "above", "left").select("node", F.coalesce("further", "above").alias("above")))
    return up


def links_of_similar(every: DataFrame, sets: Callable[[DataFrame], DataFrame], tables: int = TABLES, radius: int = RADIUS, similarity: float = SIMILARITY, by: range | None = None) -> DataFrame:
    """Distinct (node, fps), an array of ``tables`` fingerprints each, to links (a, b) of nodes.  The nodes of one half meet its least;
    halves within the radius meet by those.  ``by`` are the fingerprints whose halves count, all by default."""
    placed, groups = _halves(every, range(tables) if by is None else by)
    alike = spread_join(placed, groups, "fp", "n").select(F.col("least").alias("a"), F.col("node").alias("b"))
    near = durable(links(_spread(groups.select("fp"), "fp"), radius, HALF))
    name = lambda side: groups.select(F.col("fp").alias(side), F.col("least").alias(f"least_{side}"))
    met = near.join(name("a"), "a").join(name("b"), "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))
    return _verified(durable(alike.unionByName(met).where("a != b").distinct()), every, sets, tables, similarity)


def _spread(written: DataFrame, *on: str) -> DataFrame:
    # a set number of partitions of a written table, as each row becomes 65 and few won't do
    return written.repartition(int(written.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on)


def clusters(per_fp: DataFrame, linked: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp, least, n) and links (a, b) of them to (fp, n, name): the smallest ``least`` of each component."""
    groups = components(linked)
    rooted = durable(per_fp.join(groups, per_fp["fp"] == groups["node"], "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("root")))
    names = durable(rooted.groupBy("root").agg(F.min("least").alias("name"), F.count("*").alias("fps")))
    return spread_join(rooted, names, "root", "fps").select("fp", "n", "name")


def _brought_down(per_fp: DataFrame, up: DataFrame) -> DataFrame:
    """Of the texts (fp, least, fps) that have the same ``above`` in (node, above) the one of the least ``least`` goes on."""
    rooted = per_fp.join(up, per_fp["fp"] == up["node"], "left").withColumn("root", F.coalesce("above", "fp"))
    return durable(rooted.groupBy("root").agg(F.min(F.struct("least", "fp", "fps")).alias("x")).select("x.fp", "x.least", "x.fps"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row for each row of ``docs``: key, fingerprint (16 hex digits), component_id (the least key in its component)."""
    of_doc = durable(fingerprints(docs, key, text, k).select(key, F.col("fps")[0].alias("fp")))
    per_fp = durable(of_doc.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")))  # copies end here
    named = durable(clusters(per_fp, links(_spread(per_fp.select("fp"), "fp"), radius)))
    return spread_join(of_doc, named, "fp", "n").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("name").alias("component_id"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = NEAR_SHINGLE, radius: int = RADIUS, tables: int = TABLES, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component: that of the least key, null keys last, then by a hash of the whole row.  Rows are told
    apart by that hash, not by the key, so rows of null or repeated keys are groups' members like any other; of rows that are equal
    in all columns one stays.  Rows are linked as ``links_of_similar`` says; more ``tables`` catch more of the near copies, and tell the
    similarity better.  Texts are told apart by a hash of 64 bits of all their fingerprints."""
    a, b = unused(docs, "row_a"), unused(docs, "row_b")
    one, two = row_hashes(docs)
    rows = docs.withColumns({a: one, b: two})
    of_row = durable(fingerprints(rows, key, text, k, (a, b), tables))
    per_row = durable(of_row.groupBy(a, b).agg(F.min(key).alias("key"), F.min("fps").alias("fps"), F.count("*").alias("copies")))
    first = F.struct(F.col("key").isNull().alias("none"), "key", a, b)
    per_fp = durable(per_row.groupBy(F.xxhash64("fps").alias("fp")).agg(F.min(first).alias("least"), F.min("fps").alias("fps")))
    node = F.col("fp").alias("node")
    of_node = durable(per_fp.select(node, f"least.{a}", f"least.{b}"))

    def sets(nodes: DataFrame) -> DataFrame:
        ids = of_node.join(nodes, "node").dropDuplicates([a, b])
        return shingle_sets(ids.join(rows.select(a, b, F.col(text).alias("text")), [a, b]).dropDuplicates(["node"]).select("node", "text"), k)

    per_fp = _brought_down(per_fp, _roots(first_links(per_fp.select(node, "fps"), sets, tables, similarity)))
    few = max(1, tables // 4)  # by these most of what a large group has left is linked, and doesn't meet once more for each of the others
    for by in filter(None, (range(few), range(few, tables))):
        linked = links_of_similar(per_fp.select(node, "fps"), sets, tables, radius, similarity, by)
        per_fp = _brought_down(per_fp, components(linked).withColumnRenamed("component", "above"))
    chosen = per_fp.select(f"least.{a}", f"least.{b}").distinct()
    # rows that repeat over 1/1000 of the table, fewer than 1000 of them, go round the shuffle
    hot = F.broadcast(per_row.where(F.col("copies") > (per_row.agg(F.sum("copies")).first()[0] or 0) / 1000).select(a, b))
    chosen = durable(chosen)
    rest = rows.join(hot, [a, b], "left_anti").join(chosen, [a, b], "left_semi")
    repeated = rows.join(F.broadcast(chosen.join(hot, [a, b], "left_semi")), [a, b], "left_semi")
    return rest.dropDuplicates([a, b]).unionByName(repeated.dropDuplicates([a, b])).select(*docs.columns)
