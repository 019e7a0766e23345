"""Mixing sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources that a document counts for).  A flow routes token capacity from
patterns to source quotas: an arc from a pattern carries its tokens once at cost 0, a second time at cost 1, a third at 3, and so on
(convex, so repetition is spread), up to ``repeats`` times.  The tokens a pattern then gives are taken in whole passes over its
documents, and the rest from its documents in the order of a seeded hash.

What reaches the driver are the sums by pattern and by source; more than MAX_PATTERNS of either are refused, none is cut.  The cut within a pattern is found from sums by hash bin,
then from sums of equal rows (key and text) within the one bin that it falls in.  Of the equal rows that it falls among as many are taken as the rest
needs, numbered within the parts that they are read in: neither a pattern nor a row that is repeated for a third of the table meets in one task.

Defined cases: null texts have size 0 and take 0; a null source is a source of its own, last in order; repeated rows count each time;
ties of the hash are split by id and text hash; a text of any length counts whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, fraction, unused

REPEATS, BINS, MAX_PATTERNS, SEED = 3, 4096, 100_000, 7
PLACES = ("pattern", "size", "tie", "h", "bin", "cut", "taken", "part")


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], total: float, repeats: int = REPEATS) -> dict[str | None, float]:
    """Shares of ``total`` by weight, none over ``repeats`` times its size; the excess is reshared by weight until none is above."""
    out, left, free = {}, float(total), set(sizes)
    while free:
        unit = left / sum(weights[s] for s in free)
        if not (over := {s for s in free if weights[s] * unit > repeats * sizes[s]}):
            return out | {s: weights[s] * unit for s in free}
        out |= {s: float(repeats * sizes[s]) for s in over}
        left -= sum(out[s] for s in over)
        free -= over
    return out


def flow(patterns: dict[tuple, int], quotas: dict, repeats: int = REPEATS) -> dict[tuple, int]:
    """Tokens that each pattern gives; quotas that can't be met are met as far as possible.

    The one costs are those of the arcs into patterns, and a path never leads back into the start, so the cheapest paths are those of
    the lowest repetition that still has room: primal-dual steps by repetition, each a maximum flow by layers."""
    names, sources = list(patterns), list(quotas)
    end = 1 + len(names) + len(sources)
    node = {s: 1 + len(names) + i for i, s in enumerate(sources)}
    heads, room, arcs = [], [], [[] for _ in range(end + 1)]  # an arc's way back is arc ^ 1

    def arc(a: int, b: int, capacity: int) -> None:
        for x, y, c in ((a, b, capacity), (b, a, 0)):
            arcs[x].append(len(heads))
            heads.append(y)
            room.append(c)

    for i in range(len(names)):
        arc(0, 1 + i, 0)  # arc 2 * i
    for i, p in enumerate(names):
        for s in p:
            if s in node:
                arc(1 + i, node[s], patterns[p] * repeats)
    for s in sources:
        arc(node[s], end, int(quotas[s]))

    def layers() -> list[int]:
        depth, queue = [-1] * (end + 1), deque([0])
        depth[0] = 0
        while queue:
            a = queue.popleft()
            for e in arcs[a]:
                if room[e] > 0 and depth[heads[e]] < 0:
                    depth[heads[e]] = depth[a] + 1
                    queue.append(heads[e])
        return depth

    def fill(depth: list[int]) -> None:
        """All that still goes through these layers."""
        at, path, a = [0] * (end + 1), [], 0
        while True:
            if a == end:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                full = next(i for i, e in enumerate(path) if room[e] == 0)
                a = heads[path[full] ^ 1]
                del path[full:]
            while at[a] < len(arcs[a]) and not (room[arcs[a][at[a]]] > 0 and depth[heads[arcs[a][at[a]]]] == depth[a] + 1):
                at[a] += 1
            if at[a] < len(arcs[a]):
                path.append(arcs[a][at[a]])
                a = heads[path[-1]]
            elif path:
                a = heads[path.pop() ^ 1]
                at[a] += 1
            else:
                return

    for _ in range(repeats):
        for i, p in enumerate(names):
            room[2 * i] += patterns[p]
        while (depth := layers())[end] > 0:
            fill(depth)
    return {p: room[2 * i + 1] for i, p in enumerate(names)}


def route(patterns: dict[tuple, int], quotas: dict, repeats: int = REPEATS) -> dict[tuple, int]:
    """``flow`` for each set of patterns and sources that hang together."""
    root = {s: s for s in quotas}

    def find(s):
        while root[s] != s:
            root[s] = s = root[root[s]]
        return s

    for p in patterns:
        for s in p[1:]:
            root[find(s)] = find(p[0])
    groups: dict = {}
    for p in patterns:
        groups.setdefault(find(p[0]) if p else None, []).append(p)
    out: dict[tuple, int] = {}
    for group in groups.values():
        out.update(flow({p: patterns[p] for p in group}, {s: quotas[s] for p in group for s in p}, repeats))
    return out


def few(df: DataFrame, what: str) -> list:
    """All rows of ``df``, of which there must be at most MAX_PATTERNS: none is left out."""
    got = df.limit(MAX_PATTERNS + 1).collect()
    if len(got) > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} {what}: group sources first")
    return got


def measured(docs: DataFrame, key: str, text: str, source: str, member: str | None, seed: int, names: dict[str, str]) -> DataFrame:
    """``docs`` with pattern, size, and place in the seeded order (h, its bin, and a tie-break), under the given names."""
    lists = F.col(member) if member else F.array(F.col(source))
    out = docs.withColumns({names["pattern"]: F.array_sort(F.array_distinct(F.coalesce(lists, F.array().cast("array<string>")))), names["size"]: words(text), names["tie"]: F.xxhash64(key, text)})
    out = out.withColumn(names["h"], fraction(seed, names["tie"]))
    return out.withColumn(names["bin"], F.floor(F.col(names["h"]) * BINS).cast("int"))


def taken(rows: DataFrame, slim: DataFrame, key: str, names: dict[str, str], weights: dict | None, repeats: int) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with the words that the mix takes of each, under ``names``; a row of source, source_size and target for each source).
    ``slim`` is a written table of all rows as ``measured``; ``rows`` are the same ones, with any columns."""
    spark = slim.sparkSession
    patterns = {tuple(r["pattern"] or ()): int(r["size"]) for r in few(slim.groupBy("pattern").agg(F.sum("size").alias("size")), "membership patterns")}
    own = {r["source"]: int(r["size"]) for r in few(slim.groupBy("source").agg(F.sum("size").alias("size")), "sources")}
    named = {s for p in patterns for s in p} | set(own)
    order = sorted((s for s in named if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in named)
    weights = weights or {s: 1 + i % 3 for i, s in enumerate(order)}
    reach = dict.fromkeys(order, 0)
    for p, n in patterns.items():
        for s in p:
            reach[s] += n
    want = targets(reach, weights, sum(patterns.values()), repeats)
    given = route(patterns, {s: int(round(want[s])) for s in order}, repeats)
    plan = [(list(p), given[p] // n if n else 0, given[p] % n if n else 0) for p, n in patterns.items()]
    plan = F.broadcast(spark.createDataFrame(plan, "mixed array<string>, passes long, rest long"))  # at most MAX_PATTERNS rows, as the next
    info = F.broadcast(spark.createDataFrame([(s, own.get(s, 0), float(want[s])) for s in order], "named string, source_size long, target double"))
    # of each pattern: the last bin that gives anything, and what the bins before it give
    before = F.coalesce(F.sum("n").over(Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = slim.groupBy("pattern", "bin").agg(F.sum("size").alias("n")).withColumn("before", before)
    cuts = bins.join(plan, F.col("pattern").eqNullSafe(F.col("mixed"))).where("before < rest").groupBy("mixed", "passes", "rest").agg(F.max(F.struct("bin", "before")).alias("cut"))
    # within that bin: the last of the sums of equal rows that gives anything
    cuts = F.broadcast(cuts.select("mixed", "rest", F.col("cut.bin").alias("at_bin"), F.col("cut.before").alias("bin_before")))
    same = slim.join(cuts, F.col("pattern").eqNullSafe(F.col("mixed")) & (F.col("bin") == F.col("at_bin"))).groupBy("mixed", "rest", "bin_before", "h", "tie").agg(F.sum("size").alias("n"))
    before = F.col("bin_before") + F.coalesce(F.sum("n").over(Window.partitionBy("mixed").orderBy("h", "tie").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = same.withColumn("before", before).where("before < rest").groupBy("mixed").agg(F.max(F.struct("h", "tie", "before")).alias("cut"))
    none = F.struct(F.lit(-1.0).alias("h"), F.lit(0).cast("long").alias("tie"), F.lit(0).cast("long").alias("before"))
    all_cuts = plan.select(F.col("mixed").alias("_m"), "passes", "rest").join(cuts, F.col("_m").eqNullSafe(F.col("mixed")), "left").withColumn("cut", F.coalesce("cut", none))
    cuts = F.broadcast(all_cuts.select(F.struct(F.col("_m").alias("pattern"), "passes", "rest", "cut.h", "cut.tie", "cut.before").alias(names["cut"])))
    at, size, part = F.col(names["cut"]), F.col(names["size"]), names["part"]
    joined = rows.join(cuts, F.col(names["pattern"]).eqNullSafe(at["pattern"]))
    place, last = F.struct(F.col(names["h"]).alias("h"), F.col(names["tie"]).alias("tie")), F.struct(at["h"].alias("h"), at["tie"].alias("tie"))
    whole = joined.where(place != last).withColumn(names["taken"], F.when(place < last, size).otherwise(F.lit(0)))
    # equal rows among which the cut falls: numbered by the part they were read in (written with them), then within it
    equal = durable(joined.where(place == last).withColumn(part, F.spark_partition_id()))
    of, nth, n, first = (unused(rows, c) for c in ("_of", "_place", "_n", "_first"))
    before_part = Window.partitionBy(of).orderBy(nth).rowsBetween(Window.unboundedPreceding, -1)
    ahead = equal.groupBy(at["pattern"].alias(of), F.col(part).alias(nth)).agg(F.count("*").alias(n)).withColumn(first, F.coalesce(F.sum(n).over(before_part), F.lit(0)))
    numbered = equal.join(ahead, at["pattern"].eqNullSafe(F.col(of)) & (F.col(part) == F.col(nth)))
    number = F.col(first) + F.row_number().over(Window.partitionBy(of, nth).orderBy(key)) - 1
    numbered = numbered.withColumn(names["taken"], F.least(size, F.greatest(at["rest"] - at["before"] - number * size, F.lit(0)))).select(*whole.columns)
    return whole.unionByName(numbered).withColumn(names["taken"], size * at["passes"] + F.col(names["taken"])), info


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", member: str | None = None, weights: dict | None = None, seed: int = SEED, repeats: int = REPEATS) -> DataFrame:
    """key, source, size, source_size, target, taken of each row.  ``member`` names a column of source lists; without it a row
    counts for its source.  Weights default to 1, 2, 3, repeating, by source in code-point order."""
    names = {c: c for c in PLACES}
    slim = durable(measured(docs.select(F.col(key), F.col(text).alias("text"), F.col(source).alias("source"), *([F.col(member).alias("member")] if member else [])), key, "text", "source", member and "member", seed, names).select(key, "source", *PLACES[:5]))
    out, info = taken(slim, slim, key, names, weights, repeats)
    return out.join(info, F.col("source").eqNullSafe(F.col("named")), "left").select(key, "source", "size", "source_size", "target", "taken")


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """``docs`` as mixed: each row as often as the mix takes it, to the nearest whole number; rows that it doesn't take go.  What is
    taken is found for each row where it stands: rows are never joined by key, so null and repeated keys do no harm."""
    names = {c: unused(docs, f"mix_{c}") for c in PLACES}
    plain = {c: c for c in PLACES}
    slim = durable(measured(docs.select(F.col(key), F.col(text).alias("text"), F.col(source).alias("source")), key, "text", "source", None, seed, plain).select(key, "source", *PLACES[:5]))
    out, _ = taken(measured(docs, key, text, source, None, seed, names), slim, key, names, None, REPEATS)
    times = F.round(F.try_divide(F.col(names["taken"]), F.col(names["size"]))).cast("int")
    return out.withColumn(names["taken"], times).where(F.col(names["taken"]) > 0).withColumn(names["cut"], F.explode(F.sequence(F.lit(1), F.col(names["taken"])))).select(*docs.columns)
