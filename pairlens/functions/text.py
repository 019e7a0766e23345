"""Text and set similarity as column expressions; what they take must be columns or cheap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters and digits of any script, and the underscore: what a word character is in Python.
WORDS = r"[\p{L}\p{N}_]+"


def tokens(*values: Column) -> Column:
    """Distinct lower-cased tokens of values, cut at single spaces."""
    return F.array_distinct(F.split(F.lower(F.concat_ws(" ", *values)), " "))


def words(text: Column, lower: bool = True) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(WORDS), F.lit(0))


def _same(a: Column, b: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda n, x: n + F.size(F.filter(b, lambda y: y == x)))


def count_cosine(a: Column, b: Column) -> Column:
    """Cosine of the counts of two short word arrays (quadratic in their length); 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(_same(a, b) / F.sqrt((_same(a, a) * _same(b, b)).cast("double")))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def tokenised(value: Column) -> Column:
    """A value's tokens at white space; an empty value has none."""
    return F.array_remove(F.split(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " ")), " "), "")


def detokenised(tokens_: Column) -> Column:
    return F.array_join(tokens_, " ")


def diff_label(before: Column, after: Column) -> Column:
    """``-`` and the words that a change takes away, or else ``+`` and those that it adds."""
    gone, new = F.array_except(tokenised(before), tokenised(after)), F.array_except(tokenised(after), tokenised(before))
    return F.when(F.size(gone) > 0, F.concat(F.lit("-"), F.array_join(gone, " "))).otherwise(F.concat(F.lit("+"), F.array_join(new, " ")))


def anchor_distance(x: Column, a: Column, b: Column) -> Column:
    """The mean Jaccard distance of a token set to two others."""
    return ((1 - jaccard(x, a)) + (1 - jaccard(x, b))) / 2


def change_cosine(original: Column, one: Column, two: Column) -> Column:
    """Cosine of the smooth tf-idf of what two texts change in a third: the characters that only one of text and original has, in lower
    case.  One half if neither changes any."""
    letters = lambda t: F.array_distinct(F.split(t, ""))
    changed = lambda t: F.filter(F.transform(symmetric_difference(letters(original), letters(t)), F.lower), lambda x: x.rlike(WORDS))
    a, b = changed(one), changed(two)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(0.5)).otherwise(tfidf_cosine(a, b))


def long_text_cosine(pairs: DataFrame, key: str, a: str, b: str, lower: bool = False) -> DataFrame:
    """key, cosine for texts of any length: words are counted, joined and summed."""

    def counts(c: str, name: str) -> DataFrame:
        return pairs.select(key, F.explode(words(F.col(c), lower)).alias("w")).groupBy(key, "w").agg(F.count("*").alias(name))

    both = counts(a, "x").join(counts(b, "y"), [key, "w"], "full").groupBy(key)
    sums = both.agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    return pairs.select(key).join(sums, key, "left").select(key, F.coalesce(F.col("xy") / F.sqrt((F.col("xx") * F.col("yy")).cast("double")), F.lit(0.0)).alias("cosine"))


def vector_cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(eps))


def tfidf_cosine(a: Column, b: Column) -> Column:
    """Cosine of the smooth tf-idf of two token arrays, each the other's only other document: ln(3 / (1 + df)) + 1."""
    once, twice = F.lit(1.4054651081081644), F.lit(1.0)  # ln(3 / 2) + 1 and ln(3 / 3) + 1
    weight = lambda x, other: F.when(F.array_contains(other, x), twice).otherwise(once)
    dot = F.aggregate(F.array_distinct(F.array_intersect(a, b)), F.lit(0.0), lambda n, x: n + F.size(F.filter(a, lambda y: y == x)) * F.size(F.filter(b, lambda y: y == x)))
    norm = lambda s, o: F.sqrt(F.aggregate(F.array_distinct(s), F.lit(0.0), lambda n, x: n + F.pow(F.size(F.filter(s, lambda y: y == x)) * weight(x, o), F.lit(2))))
    return F.coalesce(F.try_divide(dot, norm(a, b) * norm(b, a)), F.lit(0.0))
