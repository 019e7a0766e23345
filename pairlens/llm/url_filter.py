"""URL filters: host and path rules, and for the rest a path-template tree that learns from the pages that rules decide.

Per host, the tree's branches are path segments.  A segment of digits, hex or a date is a wildcard by its form; a branch point at
which nearly each distinct path has a segment of its own becomes a wildcard by count.  Sibling branches at any level whose labelled pages are
alike (two proportions closer than chance explains, both with labels) merge.  A template is rejected if the smoothed share of blocked
pages among its labelled ones is over one half: (blocked + strength * prior) / (labelled + strength).  A template without labelled
pages takes the share of its nearest ancestor that has some, up to the host.

All of it is joins and aggregates on (host, template): a hot host is summed before it is shuffled, and no host meets in one task.

Defined cases: null urls and urls without ``://`` have an empty host and path; templates of hosts without labelled pages are
allowed; urls repeat freely, and may be of any length and depth; of equally long rules the last listed wins; an empty table gives no rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, spread_join, unused

#: The rules of the contract, as (host suffix, path prefix, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Labelled pages that the prior counts for, when a branch point is a wildcard, and how far alike siblings may differ.
STRENGTH, MANY, SPREAD, ALIKE_Z = 4.0, 20, 0.5, 2.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str) -> tuple[Column, Column]:
    has = F.coalesce(F.col(url), F.lit("")).contains("://")
    rest = F.regexp_replace(F.col(url), r"(?s)^.*?://", "")
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct<rule, verdict>, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for suffix, prefix, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):  # the last that fits wins
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(suffix + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """Path segments, wildcards by form."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.when(s.rlike(r"^[0-9._-]+(\.[A-Za-z]+)?$|^[0-9a-fA-F-]{16,}$"), "*").otherwise(s))


def templates(pages: DataFrame) -> DataFrame:
    """(host, path) to (host, raw, template): ``raw`` are the segments by form, ``template`` those after wildcards by count.

    Level by level from the root: a branch point is a host and a prefix that is generalised already, and counts distinct paths.  One
    with under MANY paths has no wildcards below, so its paths are done; rounds end when all are."""
    raw = pages.distinct().select("host", F.array_join(segments(F.col("path")), "/").alias("raw")).groupBy("host", "raw").agg(F.count("*").alias("n"))
    left = durable(raw.select("host", "raw", "n", F.split("raw", "/").alias("segs"), F.array().cast("array<string>").alias("done"), F.concat("host", F.lit("/")).alias("at")))
    out, level = [], 0
    while True:
        seg = F.get("segs", F.lit(level))
        points = left.groupBy("at", seg.alias("seg")).agg(F.sum("n").alias("n")).groupBy("at").agg(F.count("*").alias("kinds"), F.sum("n").alias("paths"), F.sum("n").alias("count"))
        named = spread_join(left, durable(points), "at", "count")
        wild = (F.col("kinds") >= MANY) & (F.col("kinds") > SPREAD * F.col("paths"))
        named = named.withColumn("done", F.concat("done", F.array(F.when(wild, "*").otherwise(seg)))).withColumn("open", (F.col("paths") >= MANY) & (F.size("segs") > level + 1))
        named, level = durable(named), level + 1
        rest = F.slice("segs", F.lit(level + 1), F.greatest(F.size("segs") - level, F.lit(0)))
        out.append(named.where("not open").select("host", "raw", F.array_join(F.concat("done", rest), "/").alias("template")))
        left = named.where("open").select("host", "raw", "n", "segs", "done", F.concat("host", F.lit("/"), F.array_join("done", "/")).alias("at"))
        if left.isEmpty():
            return functools.reduce(DataFrame.unionByName, out)


def nodes(leaves: DataFrame, template: str) -> DataFrame:
    """A row for each node above a template and itself, from the host (level 0) down: level, node, its parent and its last segment."""
    rows = leaves.withColumn("_s", F.split(template, "/")).withColumn("level", F.explode(F.sequence(F.lit(0), F.size("_s"))))
    prefix = lambda n: F.array_join(F.slice("_s", F.lit(1), n), "/")
    rows = rows.withColumn("node", prefix(F.col("level"))).withColumn("parent", prefix(F.greatest(F.col("level") - 1, F.lit(0))))
    return rows.withColumn("seg", F.coalesce(F.get("_s", F.col("level") - 1), F.lit(""))).drop("_s")


def judge(df: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] = RULES, strength: float = STRENGTH) -> DataFrame:
    """``df`` with host, path, rule, verdict, template and purity.  Columns of ``df`` with those names are replaced."""
    host, path = split_url(url)
    df = df.drop(*({"host", "path", "rule", "verdict", "template", "purity"} - {url}))
    own, raw, times = (unused(df, c) for c in ("rule_of", "raw", "times"))
    pages = df.withColumn("host", host).withColumn("path", path)
    pages = pages.withColumn(own, rule_of(F.col("host"), F.col("path"), rules)).withColumn(raw, F.array_join(segments(F.col("path")), "/"))
    judged = F.col(own).isNotNull()
    blocked = F.coalesce((F.col(own)["verdict"] == "block"), F.lit(False))
    tree = durable(templates(pages.select("host", "path")))
    counted = durable(pages.groupBy("host", F.col(raw).alias("raw")).agg(F.sum(judged.cast("long")).alias("labelled"), F.sum(blocked.cast("long")).alias("bad"), F.count("*").alias("n")))
    leaves = durable(counted.join(tree, ["host", "raw"]).groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")))
    # siblings: named children of one node; alike ones share a branch, at each level of the tree
    counts = nodes(leaves, "template").groupBy("host", "level", "node").agg(F.max("seg").alias("seg"), F.max("parent").alias("parent"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    counts = durable(counts.where((F.col("level") > 0) & ~F.col("seg").isin("", "*")))
    families = counts.groupBy("host", "level", "parent").agg(F.sum("labelled").alias("fl"), F.sum("bad").alias("fb"))
    others, other_bad = F.col("fl") - F.col("labelled"), F.col("fb") - F.col("bad")
    pooled = F.try_divide(F.col("fb"), F.col("fl"))
    error = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-6)) * (F.try_divide(F.lit(1.0), F.col("labelled")) + F.try_divide(F.lit(1.0), others)))
    alike = (F.col("labelled") > 0) & (others > 0) & (F.abs(F.try_divide(F.col("bad"), F.col("labelled")) - F.try_divide(other_bad, others)) <= ALIKE_Z * error)
    merging = counts.join(families, ["host", "level", "parent"]).where(alike).select("host", "level", "node", F.lit(True).alias("alike"))
    steps = nodes(leaves, "template").where("level > 0").join(merging, ["host", "level", "node"], "left").withColumn("seg", F.when(F.col("alike"), "?").otherwise(F.col("seg")))
    ordered = F.array_sort(F.collect_list(F.struct("level", "seg")))  # the segments of one template
    merged = durable(steps.groupBy("host", "template").agg(F.array_join(F.transform(ordered, lambda x: x["seg"]), "/").alias("merged"), F.first("labelled").alias("labelled"), F.first("bad").alias("bad")))
    # a template has the share of its deepest node with labels, the host being the last resort
    known = nodes(merged, "merged").groupBy("host", "level", "node").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).where("labelled > 0")
    nearest = nodes(merged.drop("labelled", "bad"), "merged").join(known, ["host", "level", "node"]).groupBy("host", "template").agg(F.max(F.struct("level", "labelled", "bad")).alias("near"))
    prior = counted.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("labelled")), F.lit(0.0)).alias("prior"))  # one row
    near = lambda c: F.coalesce(F.col(f"near.{c}"), F.lit(0))
    share = (near("bad") + F.lit(strength) * F.least(F.col("prior"), F.lit(0.5))) / (near("labelled") + F.lit(strength))
    leaves = merged.join(nearest, ["host", "template"], "left").crossJoin(F.broadcast(prior)).select("host", "template", share.alias("purity"), "merged")
    known = tree.join(leaves, ["host", "template"]).join(counted, ["host", "raw"])
    known = durable(known.select("host", F.col("raw").alias(raw), F.col("merged").alias("template"), "purity", F.col("n").alias(times)))
    out = spread_join(pages, known, ["host", raw], times)  # every page has its row; the root page of a hot host meets no single task
    verdict = F.coalesce(F.col(own)["verdict"], F.when(F.col("purity") > 0.5, "block").otherwise("allow"))
    return out.withColumn("rule", F.col(own)["rule"]).withColumn("verdict", verdict).drop(own, raw)
