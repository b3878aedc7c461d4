"""Counts and summaries of batches, funnels and states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def counts_by(df: DataFrame, columns: list[str]) -> DataFrame:
    """(what, value, n) for each of the columns, in one pass."""
    entries = F.explode(F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(entries.alias("e")).groupBy("e.what", "e.value").agg(F.count("*").alias("n"))


def batch_stats(results: DataFrame) -> DataFrame:
    """One row: number, unreadable and poor results, and the least, mean and largest quality in thousandths."""
    q = F.floor(F.col("quality_score") * 1000 + 0.5).cast("long")
    return results.agg(F.count("*").alias("total"), F.count_if(F.col("text").isNull()).alias("unreadable"), F.count_if(F.col("quality_score") < 0.3).alias("poor"), F.min(q).alias("min_quality"), F.max(q).alias("max_quality"), F.floor(F.avg(q)).cast("long").alias("avg_quality"))


def next_sequence(existing: DataFrame, new: DataFrame) -> DataFrame:
    """`new` (date, ...) with ids `KB-date-NN` that go on from the largest number of the date among `existing` (id)."""
    top = existing.select(F.regexp_extract("id", r"^KB-(\d{4}-\d{2}-\d{2})-\d+$", 1).alias("date"), F.regexp_extract("id", r"-(\d+)$", 1).cast("int").alias("n")).where("date <> ''").groupBy("date").agg(F.max("n").alias("top"))
    w = W.Window.partitionBy("date").orderBy("ord")
    out = new.join(top, "date", "left").withColumn("n", F.coalesce("top", F.lit(0)) + F.row_number().over(w))
    return out.withColumn("new_id", F.format_string("KB-%s-%02d", F.col("date"), F.col("n"))).drop("top", "n")


def forward_filled(rows: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """`value` carried down over the nulls after it, within `key`, by `pos`."""
    w = W.Window.partitionBy(key).orderBy(pos).rowsBetween(W.Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


def selection_funnel(rows: DataFrame) -> DataFrame:
    """(stage, n) of candidates (score, reading_level, full_text_read)."""
    one = rows.agg(F.count("*").alias("found"), F.count_if(F.col("score") > 0).alias("relevant"), F.count_if((F.col("score") > 0) & F.col("reading_level").isin("PDF_TEXT_FULL", "HUMAN_CONFIRMED")).alias("full_text"), F.count_if(F.coalesce(F.col("full_text_read"), F.lit(False))).alias("read"))
    return one.unpivot([], ["found", "relevant", "full_text", "read"], "stage", "n")


def backfill_dates(first: str, last: str, done: DataFrame, most: int = 30) -> DataFrame:
    """Dates from `first` to `last`, at most `most`, that `done` (date) lacks."""
    spark = done.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("d")).orderBy("d").limit(most)
    return days.select(F.date_format("d", "yyyy-MM-dd").alias("date")).join(done.select("date").distinct(), "date", "left_anti")


def manifest_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two manifests (path, hash): added, removed, changed."""
    j = old.select("path", F.col("hash").alias("a")).join(new.select("path", F.col("hash").alias("b")), "path", "full")
    return j.withColumn("change", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")).where("change is not null").select("path", "change")
