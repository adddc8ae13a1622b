"""Findings as JSON, and the keys under which they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.statemachine import STATS

VALUE_CHARS, PREVIEW_CHARS, DIFFS = 2000, 1000, 100
CUT = "…(truncated)"


def cut(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(CUT))).otherwise(text)


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.title() for x in rest)


def verdict_json() -> Column:
    """Without signature, diffs and diffsTruncated where there are none."""
    some = F.size("diffs") > 0
    diff = lambda d: F.struct(d["path"].alias("path"), d["kind"].alias("kind"), cut(d["main"], VALUE_CHARS).alias("main"), cut(d["load"], VALUE_CHARS).alias("load"))
    return F.to_json(F.struct(
        F.lit("verdict").alias("type"), "guid", "topic", "status", "severity", "revision", F.col("decided_at_millis").alias("decidedAtMillis"), F.col("signature_id").alias("signatureId"), "signature",
        F.when(some, F.transform(F.slice("diffs", 1, DIFFS), diff)).alias("diffs"), F.when(F.size("diffs") > DIFFS, F.lit(True)).alias("diffsTruncated"),
        F.struct(*(F.col(f"stats.{c}").alias(camel(c)) for c in STATS)).alias("stats"),
    ))


def dead_letter_json() -> Column:
    return F.to_json(F.struct(
        F.lit("dead-letter").alias("type"), "env", "topic", F.col("ts_millis").alias("timestampMillis"), F.coalesce(cut(F.col("error"), VALUE_CHARS), F.lit("")).alias("error"),
        F.coalesce(cut(F.make_valid_utf8(F.col("payload")), PREVIEW_CHARS), F.lit("")).alias("payloadPreview"),
    ))


def rollup_json() -> Column:
    named = F.col("signature_id") != ""
    return F.to_json(F.struct(
        F.lit("rollup").alias("type"), F.col("window_start_millis").alias("windowStartMillis"), F.col("window_end_millis").alias("windowEndMillis"), "topic", "status", "severity",
        F.when(named, F.col("signature_id")).alias("signatureId"), F.when(named, F.col("signature")).alias("signature"), "count", F.col("sample_guids").alias("sampleGuids"),
    ))


def keyed_verdicts(verdicts: DataFrame, emit_equal: bool = True) -> DataFrame:
    found = verdicts if emit_equal else verdicts.filter("status <> 'EQUAL'")
    return found.select(F.concat_ws("|", "guid", "topic").alias("key"), verdict_json().alias("value"))


def keyed_dead_letters(letters: DataFrame) -> DataFrame:
    return letters.select(F.concat_ws("|", "env", "topic").alias("key"), dead_letter_json().alias("value"))


def keyed_rollups(rolled: DataFrame) -> DataFrame:
    return rolled.select(F.concat_ws("|", "topic", "status", "signature_id").alias("key"), rollup_json().alias("value"))


class Codec:
    """How findings are written. A job takes another one that has these three methods."""

    def verdicts(self, found: DataFrame, emit_equal: bool = True) -> DataFrame:
        return keyed_verdicts(found, emit_equal)

    def dead_letters(self, letters: DataFrame) -> DataFrame:
        return keyed_dead_letters(letters)

    def rollups(self, rolled: DataFrame) -> DataFrame:
        return keyed_rollups(rolled)
