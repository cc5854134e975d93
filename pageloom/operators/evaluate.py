"""Scores of extracted text against gold text, and reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: letters, marks, decimal digits, connectors - the same in Java and RE2.
WORD = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def word_bags(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, word, n``."""
    return df.select(key, F.explode(words(F.col(text))).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))


def word_f1(pairs: DataFrame, key: str, predicted: str, gold: str) -> DataFrame:
    """``key, precision, recall, f1`` by word multisets; a side without words scores 0, both sides without 1.

    Overlap is an equi-join on (key, word), so long texts only meet in their common words.
    """
    p, g = word_bags(pairs, key, predicted), word_bags(pairs, key, gold)
    both = p.join(g.withColumnRenamed("n", "m"), [key, "word"]).groupBy(key).agg(F.sum(F.least("n", "m")).alias("overlap"))
    size = lambda c: F.size(words(F.col(c)))
    rows = pairs.select(key, size(predicted).alias("np"), size(gold).alias("ng")).distinct().join(both, key, "left").fillna(0, ["overlap"])
    precision = F.when(F.col("np") > 0, F.col("overlap") / F.col("np")).otherwise(F.when(F.col("ng") == 0, 1.0).otherwise(0.0))
    recall = F.when(F.col("ng") > 0, F.col("overlap") / F.col("ng")).otherwise(F.when(F.col("np") == 0, 1.0).otherwise(0.0))
    scored = rows.select(key, precision.cast("double").alias("precision"), recall.cast("double").alias("recall"))
    return scored.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def excess_words(pairs: DataFrame, key: str, predicted: str, gold: str, top: int = 30) -> DataFrame:
    """``word, side, excess``: the words most over- and under-represented, a top-k report by design."""
    p, g = word_bags(pairs, key, predicted), word_bags(pairs, key, gold).withColumnRenamed("n", "m")
    both = p.join(g, [key, "word"], "full_outer").fillna(0, ["n", "m"]).groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    extra = both.select("word", F.lit("extra").alias("side"), (F.col("n") - F.col("m")).alias("excess")).where("excess > 0").orderBy(F.desc("excess"), "word").limit(top)
    missing = both.select("word", F.lit("missing").alias("side"), (F.col("m") - F.col("n")).alias("excess")).where("excess > 0").orderBy(F.desc("excess"), "word").limit(top)
    return extra.unionByName(missing)


def with_without(pages: DataFrame, key: str, text: str, wanted: str, unwanted: str) -> DataFrame:
    """``key, with_recall, without_reject``: the share of wanted snippets in the text and of unwanted ones not in it."""
    has = lambda c: F.when(F.size(c) > 0, F.aggregate(F.col(c), F.lit(0), lambda s, x: s + F.contains(F.coalesce(F.col(text), F.lit("")), x).cast("int")) / F.size(c))
    return pages.select(key, has(wanted).alias("with_recall"), (1 - has(unwanted)).alias("without_reject"))


def nearest_rank(df: DataFrame, group: list[str], value: str, ranks: tuple[float, ...] = (0.5, 0.9, 0.99, 1.0)) -> DataFrame:
    """Percentiles by nearest rank, per group; ``p50, p90, p99, p100`` of the default ranks.

    ``percentile_disc`` is the same order statistic; it aggregates value counts, not rows.
    """
    aggs = [F.expr(f"percentile_disc({r}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(r * 100)}") for r in ranks]
    return df.groupBy(*group).agg(*aggs) if group else df.agg(*aggs)


def f1_report(scores: DataFrame, page_type: str) -> DataFrame:
    """``page_type, pages, precision, recall, f1``, with a total row whose page_type is null."""
    return scores.rollup(page_type).agg(F.count("*").alias("pages"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


def confusion(rows: DataFrame, wanted: str, got: str) -> DataFrame:
    """``wanted, got, n``: how often each pair of labels occurs; a null label is the label ''."""
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.groupBy(label(wanted).alias("wanted"), label(got).alias("got")).agg(F.count("*").alias("n"))


def classification_report(rows: DataFrame, wanted: str, got: str) -> DataFrame:
    """``label, support, precision, recall, f1`` of every label that is wanted or given; without rows to divide by they are 0."""
    c = confusion(rows, wanted, got)
    sides = c.select(F.col("wanted").alias("label"), F.col("n").alias("w"), F.lit(0).alias("g"), F.when(F.col("wanted") == F.col("got"), F.col("n")).otherwise(0).alias("hit"))
    sides = sides.unionByName(c.select(F.col("got").alias("label"), F.lit(0).alias("w"), F.col("n").alias("g"), F.lit(0).alias("hit")))
    t = sides.groupBy("label").agg(F.sum("w").alias("support"), F.sum("g").alias("given"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("hit"), F.col("given")), ratio(F.col("hit"), F.col("support"))
    return t.select("label", "support", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))
