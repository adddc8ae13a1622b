"""Roll-ups of verdicts in windows, and what the dashboard derives from findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.canon import escaped

SAMPLES = 5
RECENT = 100


def summaries(verdicts: DataFrame) -> DataFrame:
    """What a roll-up needs of a verdict; a missing signature is empty."""
    return verdicts.select("topic", "status", "severity", F.coalesce("signature_id", F.lit("")).alias("signature_id"), F.coalesce("signature", F.array().cast("array<string>")).alias("signature"), "guid", "decided_at_millis")


KEY = ("window_start_millis", "topic", "status", "signature_id")


def partial_rollups(verdicts: DataFrame, window_millis: int = 60_000) -> DataFrame:
    """Counts of verdicts by topic, status and signature in epoch-aligned windows of their decision time; the severity
    and signature of the first of them, and the first SAMPLES distinct guids with their times, by decision time and guid;
    until: the last decision time. Parts of one roll-up can be merged. Partial aggregates stay small: per guid first, of
    guids only the earliest."""
    start = F.col("decided_at_millis") - F.pmod(F.col("decided_at_millis"), F.lit(window_millis))
    rows = summaries(verdicts).withColumn("window_start_millis", start)
    each = rows.groupBy(*KEY, "guid").agg(F.count("*").alias("n"), F.min("decided_at_millis").alias("at"), F.max("decided_at_millis").alias("until"), F.min_by("severity", "decided_at_millis").alias("severity"), F.min_by("signature", "decided_at_millis").alias("signature"))
    order = Window.partitionBy(*KEY).orderBy("at", "guid")
    # ranks up to SAMPLES are limited before the exchange by Spark's window group limit
    first = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= SAMPLES).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("at", "guid"))).alias("samples"))
    head = F.min(F.struct("at", "guid", "severity", "signature"))
    total = each.groupBy(*KEY).agg(F.sum("n").alias("count"), head.alias("head"), F.max("until").alias("until"))
    return total.join(first, list(KEY)).select(*KEY, "count", "head", "samples", "until")


def merged_samples(samples: Column) -> Column:
    """The first SAMPLES distinct guids of several parts' samples."""
    return F.slice(F.array_distinct(F.transform(F.array_sort(F.flatten(samples)), lambda x: x["guid"])), 1, SAMPLES)


def finished(rolled: DataFrame, window_millis: int) -> DataFrame:
    """Roll-ups of head and sample_guids, as they are reported."""
    end = F.col("window_start_millis") + window_millis
    return rolled.select("window_start_millis", end.alias("window_end_millis"), "topic", "status", "head.severity", "signature_id", "head.signature", "count", "sample_guids")


def rollups(verdicts: DataFrame, window_millis: int = 60_000) -> DataFrame:
    """All verdicts' roll-ups: window_start_millis, window_end_millis, topic, status, severity, signature_id, signature,
    count, sample_guids."""
    parts = partial_rollups(verdicts, window_millis)
    return finished(parts.withColumn("sample_guids", F.transform("samples", lambda x: x["guid"])), window_millis)


def latest_verdicts(verdicts: DataFrame) -> DataFrame:
    """The last revision of each document and topic."""
    order = Window.partitionBy("guid", "topic").orderBy(F.desc("revision"), F.desc("decided_at_millis"))
    return verdicts.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")


def recent(findings: DataFrame, at: str, topic: str | None = None, limit: int = RECENT, tie: tuple[str, ...] = ()) -> DataFrame:
    """The newest findings first."""
    found = findings.filter(F.col("topic") == topic) if topic else findings
    return found.orderBy(F.desc(at), *tie).limit(limit)


def summary(verdicts: DataFrame, topic: str | None = None, limit: int | None = RECENT, tie: tuple[str, ...] = ("guid", "topic")) -> DataFrame:
    """Counts by status of the newest verdicts; limit None counts all."""
    found = recent(verdicts, "decided_at_millis", topic, limit, tie) if limit is not None else (verdicts.filter(F.col("topic") == topic) if topic else verdicts)
    return found.groupBy("status").agg(F.count("*").alias("count"))


def volume_series(rolled: DataFrame) -> DataFrame:
    """For each window how many verdicts are DIFF and how many are not."""
    is_diff = F.col("status") == "DIFF"
    return rolled.groupBy("window_start_millis").agg(F.sum(F.when(is_diff, F.col("count")).otherwise(0)).alias("diff"), F.sum(F.when(~is_diff, F.col("count")).otherwise(0)).alias("other")).orderBy("window_start_millis")


def diff_rates(rolled: DataFrame) -> DataFrame:
    """Per topic the share of DIFF in whole percent, with its colour."""
    out = rolled.groupBy("topic").agg(F.sum("count").alias("total"), F.sum(F.when(F.col("status") == "DIFF", F.col("count")).otherwise(0)).alias("diff"))
    out = out.withColumn("pct", F.floor(F.col("diff") * 100 / F.col("total") + 0.5).cast("long"))
    return out.withColumn("level", F.when(F.col("pct") >= 25, "red").when(F.col("pct") >= 5, "yellow").otherwise("green")).orderBy(F.desc("pct"), F.desc("total"), "topic")


def status_counts(rolled: DataFrame, topic: str | None = None) -> DataFrame:
    found = rolled.filter(F.col("topic") == topic) if topic else rolled
    return found.groupBy("status").agg(F.sum("count").alias("count"))


def suggested_rules(rolled: DataFrame) -> DataFrame:
    """Ignore rules for what signatures name: the text before an entry's last colon, each path once."""
    entry = rolled.select(F.explode("signature").alias("entry"), "count")
    return entry.withColumn("path", F.trim(F.regexp_replace("entry", ":[^:]*$", ""))).groupBy("path").agg(F.sum("count").alias("count")).select(F.lit("ignore").alias("type"), "path", "count")


def ignore_rule(fields: list[str]) -> dict:
    """An ignore rule for a place given by its field names, whatever characters these have."""
    return {"type": "ignore", "path": ".".join(map(escaped, fields))}
