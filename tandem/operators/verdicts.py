"""Observations to verdicts, in batch: every document has gone quiet and is decided once.

All groupings contain the document's guid, so one exchange by guid serves them all: timelines with and without sequences,
entries and decision times are read from the same dealt records, and records are decoded once.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tandem.functions.canon import read
from tandem.functions.rules import Differ, diff
from tandem.functions.statemachine import COHORT, STATS, Version, final_version, sequence_pairs as pairs_in_order
from tandem.plans.config import CompareConfig, MatchPolicy

DIFF = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "general", "kind", "main", "load")])
DIFFS = T.ArrayType(DIFF)
#: A number, and one spelled as its value: no exponent, plus or needless zeros. Such numbers are equal only if their
#: texts are.
ANY_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
PLAIN_NUMBER = r"^(0|-?[1-9][0-9]*(\.[0-9]*[1-9])?|-?0\.[0-9]*[1-9])$"
SIDES = ("main", "load")
PAIRS = T.ArrayType(T.StructType([T.StructField(s, T.StringType()) for s in SIDES]))


def dealt(observed: DataFrame) -> DataFrame:
    """The observations of a document in one place. Everything reads the same columns of it, so that there is one
    exchange and one decode."""
    columns = ("guid", "topic", "env", "kind", "sequence", "state_hash", "state_json", "ts_millis", "arrival")
    return observed.filter("error is null").select(*columns).repartition("guid")


def _of(side: str) -> Column:
    return F.col("env") == side.upper()


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0).cast("long"))


def states(rows: DataFrame) -> DataFrame:
    """A row for each distinct state without sequence of a document and topic: state (its hash), json, and of each side n
    messages and the first arrival; also rows with a null state, which stand for entries and for messages with a
    sequence. All with the times of their messages."""
    rows = rows.withColumn("state", F.when((F.col("kind") == "OUTPUT") & F.col("sequence").isNull(), F.col("state_hash")))
    sides = [x for s in SIDES for x in (F.count(F.when(_of(s), 1)).alias(f"{s}_n"), F.min(F.when(_of(s), F.col("arrival"))).alias(f"{s}_first"))]
    # one hash has one JSON, so any of them will do
    json = F.any_value(F.when(F.col("state").isNotNull(), F.col("state_json")))
    return rows.groupBy("guid", "topic", "kind", "state").agg(*sides, json.alias("json"), F.min("ts_millis").alias("since"), F.max("ts_millis").alias("until"))


def timeline(side: str) -> dict[str, Column]:
    """Aggregates over one side's states: the final state is the last that was new when it arrived."""
    has = F.col("state").isNotNull() & (F.col(f"{side}_n") > 0)
    pick = lambda c: F.max_by(c, F.when(has, F.col(f"{side}_first")))
    messages, kinds = _zero(F.sum(F.when(has, F.col(f"{side}_n")))), F.count(F.when(has, 1))
    return {"messages": messages, "distinct_states": kinds, "duplicates": messages - kinds, "hash": pick("state"), "json": pick("json")}


def paired_unsequenced(rows: DataFrame) -> DataFrame:
    """A row for each document and topic that has entries or messages without sequence, with both sides' timelines;
    entered_main, entered_load, since and until of all its messages. No list of states is held: two sides have the same
    states if each state has both."""
    sides = {f"{s}_{n}": x for s in SIDES for n, x in timeline(s).items()}
    entered = {f"entered_{s}": F.max((F.col("kind") == "ENTRY") & (F.col(f"{s}_n") > 0)) for s in SIDES}
    same = F.coalesce(F.min(F.when(F.col("state").isNotNull(), (F.col("main_n") > 0) == (F.col("load_n") > 0))), F.lit(True))
    both = states(rows).groupBy("guid", "topic").agg(*(x.alias(n) for n, x in (sides | entered).items()), same.alias("same_states"), F.min("since").alias("since"), F.max("until").alias("until"))
    zero = F.lit(0).cast("long")
    return both.withColumns({"sequenced": F.lit(False), "missing": zero, "extra": zero, "pairs": F.array().cast(PAIRS)})


def unsequenced_timelines(observed: DataFrame) -> DataFrame:
    """(guid, topic, env, messages, distinct_states, duplicates, hash, json) of lines without sequences."""
    columns = ("messages", "distinct_states", "duplicates", "hash", "json")
    sides = F.array(*(F.struct(F.lit(s.upper()).alias("env"), *(F.col(f"{s}_{c}").alias(c) for c in columns)) for s in SIDES))
    each = paired_unsequenced(dealt(observed)).select("guid", "topic", F.explode(F.filter(sides, lambda x: x["messages"] > 0)).alias("side"))
    return each.select("guid", "topic", "side.*")


def folded(messages: Column, states: Column) -> Column:
    """One sequence's messages (arrival, ts, hash) in order: a repeated state counts as a duplicate, another state
    replaces it unless its time is earlier. states: JSON by hash, each state once however often it came."""
    first = messages[0]
    state = lambda h, t, d: F.struct(h.alias("hash"), t.alias("ts_millis"), d.alias("duplicates"))
    fold = lambda a, x: (
        F.when(a["hash"] == x["hash"], state(a["hash"], a["ts_millis"], a["duplicates"] + 1))
        .when(x["ts_millis"] >= a["ts_millis"], state(x["hash"], x["ts_millis"], a["duplicates"])).otherwise(a)
    )
    rest = F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))
    last = F.aggregate(rest, state(first["hash"], first["ts_millis"], F.lit(0).cast("long")), fold)
    version = F.transform(F.array(last), lambda v: F.struct(v["hash"].alias("hash"), F.get(F.filter(states, lambda s: s["hash"] == v["hash"]), 0)["json"].alias("json"), v["ts_millis"].alias("ts_millis"), F.size(messages).cast("long").alias("messages"), v["duplicates"].alias("duplicates"), first["arrival"].alias("first")))
    return F.when(F.size(messages) > 0, version[0])


def sequence_pairs(rows: DataFrame) -> DataFrame:
    """MAIN and LOAD of each exact sequence: (guid, topic, sequence, main, load), either null if it lacks."""
    has = F.col("sequence").isNotNull()
    message = F.struct("arrival", "ts_millis", F.col("state_hash").alias("hash"))
    grouped = rows.groupBy("guid", "topic", "sequence").agg(
        *(F.array_sort(F.collect_list(F.when(has & _of(s), message))).alias(f"{s}_messages") for s in SIDES),
        F.collect_set(F.when(has, F.struct(F.col("state_hash").alias("hash"), F.col("state_json").alias("json")))).alias("states"),
    )
    # not a filter by sequence, which would be pushed below the exchange that other groupings share
    some = grouped.filter("size(main_messages) + size(load_messages) > 0")
    return some.select("guid", "topic", "sequence", *(folded(F.col(f"{s}_messages"), F.col("states")).alias(s) for s in SIDES))


def sequenced_versions(observed: DataFrame) -> DataFrame:
    """(guid, topic, env, sequence, hash, json, ts_millis, messages, duplicates) of each line's sequences."""
    pairs = sequence_pairs(dealt(observed))
    sides = F.array(*(F.struct(F.lit(s.upper()).alias("env"), F.col(s).alias("v")) for s in SIDES))
    each = pairs.withColumn("side", F.explode(F.filter(sides, lambda x: x["v"].isNotNull())))
    return each.select("guid", "topic", "side.env", "sequence", *(F.col(f"side.v.{c}") for c in ("hash", "json", "ts_millis", "messages", "duplicates")))


def sequence_order() -> Column:
    """Orders plain numbers by value, of any length, and texts by UTF-16 units; used where a group has only one kind."""
    text = F.col("sequence")
    number, below = text.rlike(PLAIN_NUMBER), text.startswith("-")
    digits = F.regexp_replace(text, "^-", "")
    whole = F.substring_index(digits, ".", 1)
    part = F.when(F.contains(digits, F.lit(".")), F.substring_index(digits, ".", -1)).otherwise("")
    turned = lambda x: F.translate(x, "0123456789", "9876543210")
    sign = F.when(text == "0", 0).when(below, -1).otherwise(1)
    return F.struct(
        F.when(number, sign).alias("sign"), F.when(number, F.when(below, -F.length(whole)).otherwise(F.length(whole))).alias("size"), F.when(number, F.when(below, turned(whole)).otherwise(whole)).alias("whole"),
        F.when(number, F.when(below, F.concat(turned(part), F.lit("~"))).otherwise(part)).alias("part"), F.when(~number, F.encode(text, "UTF-16BE")).alias("text"),
    )


ODD = T.StructType([
    *(T.StructField(f"{s}_{c}", T.StringType()) for s in SIDES for c in ("hash", "json")), T.StructField("missing", T.LongType()), T.StructField("extra", T.LongType()), T.StructField("pairs", PAIRS),
])


@F.arrow_udf(ODD)
def decided_by_arrival(groups: pa.Array) -> pa.Array:
    """Final states and pairs of documents whose sequences have no order that doesn't depend on arrival."""

    def one(rows: list[dict] | None) -> dict | None:
        if not rows:
            return None
        versions = [{r["sequence"]: Version(r[f"{s}_place"], r[s]["hash"], r[s]["json"], r[s]["ts_millis"]) for r in rows if r[s] is not None} for s in SIDES]
        finals = [final_version(v) if v else None for v in versions]
        missing, extra, pairs = pairs_in_order(*versions)
        found = {f"{s}_{c}": f and getattr(f, c) for s, f in zip(SIDES, finals, strict=True) for c in ("hash", "json")}
        return found | {"missing": missing, "extra": extra, "pairs": [{"main": a, "load": b} for a, b in pairs]}

    return pa.array([one(g) for g in groups.to_pylist()], to_arrow_type(ODD))


def paired_sequenced(rows: DataFrame) -> DataFrame:
    """A row for each document and topic that has sequences. Groups of plain numbers, and of texts without any number,
    have an order of their own; those that mix numbers with texts, or spell numbers otherwise, are ordered as they
    arrived, in Python, which gets null for all others."""
    document = Window.partitionBy("guid", "topic")
    number, plain = F.col("sequence").rlike(ANY_NUMBER), F.col("sequence").rlike(PLAIN_NUMBER)
    pairs = sequence_pairs(rows).withColumns({"order": sequence_order(), "odd": F.max(number).over(document) & ~F.min(plain).over(document)})
    differ = F.col("main.hash") != F.col("load.hash")
    aggs = []
    for s in SIDES:
        last = F.max_by(F.col(s), F.when(F.col(s).isNotNull(), F.col("order")))
        aggs += [_zero(F.sum(f"{s}.messages")).alias(f"{s}_messages"), F.count(s).alias(f"{s}_distinct_states"), _zero(F.sum(f"{s}.duplicates")).alias(f"{s}_duplicates"), last.alias(f"{s}_final")]
    version = lambda s: F.when(F.col(s).isNotNull(), F.struct(*(F.col(f"{s}.{c}") for c in ("hash", "json", "ts_millis")))).alias(s)
    odd = F.struct("sequence", *(version(s) for s in SIDES), *(F.col(f"{s}.first").alias(f"{s}_first") for s in SIDES))
    out = pairs.groupBy("guid", "topic").agg(
        *aggs, F.count(F.when(F.col("load").isNull(), 1)).alias("missing"), F.count(F.when(F.col("main").isNull(), 1)).alias("extra"),
        F.array_sort(F.collect_list(F.when(~F.col("odd") & differ, F.struct("order", F.col("main.json").alias("main"), F.col("load.json").alias("load"))))).alias("differing"),
        F.collect_list(F.when(F.col("odd"), odd)).alias("odd"),
    )
    placed = F.col("odd")
    for s in SIDES:  # places instead of arrivals, which may be of any type
        firsts = F.array_sort(F.filter(F.transform("odd", lambda x: x[f"{s}_first"]), lambda a: a.isNotNull()))
        placed = F.transform(placed, lambda x: x.withField(f"{s}_place", F.array_position(firsts, x[f"{s}_first"])))
    placed = F.transform(placed, lambda x: x.dropFields(*(f"{s}_first" for s in SIDES)))
    out = out.withColumn("found", decided_by_arrival(F.when(F.size("odd") > 0, placed)))
    by_arrival = F.col("found").isNotNull()
    either = lambda name, own: F.when(by_arrival, F.col(f"found.{name}")).otherwise(own).alias(name)
    counts = [f"{s}_{c}" for s in SIDES for c in ("messages", "distinct_states", "duplicates")]
    return out.select(
        "guid", "topic", *counts, *(either(f"{s}_{c}", F.col(f"{s}_final.{c}")) for s in SIDES for c in ("hash", "json")), F.lit(True).alias("sequenced"), F.lit(True).alias("same_states"),
        either("missing", F.col("missing")), either("extra", F.col("extra")), either("pairs", F.transform("differing", lambda p: F.struct(p["main"].alias("main"), p["load"].alias("load")))),
    )


def diff_udf(config: CompareConfig, differ: Differ = diff):
    """Diffs of pairs of states in JSON, all of a row together; none where the pairs are null or empty, which is how
    equal states are passed."""
    @F.arrow_udf(DIFFS)
    def diffs(topic: pa.Array, pairs: pa.Array) -> pa.Array:
        rows = zip(topic.to_pylist(), pairs.to_pylist(), strict=True)
        return pa.array([[vars(d) for p in ps or () for d in differ(read(p["main"]), read(p["load"]), config.rules_of(t))] for t, ps in rows], to_arrow_type(DIFFS))

    return diffs


def with_signature(df: DataFrame, diffs: str = "diffs") -> DataFrame:
    """signature (sorted distinct 'general path: kind') and signature_id; null without diffs."""
    entries = F.array_sort(F.array_distinct(F.transform(diffs, lambda d: F.concat(d["general"], F.lit(": "), d["kind"]))))
    some = F.size(diffs) > 0
    return df.withColumn("signature", F.when(some, entries)).withColumn("signature_id", F.when(some, F.substring(F.sha2(F.array_join(entries, "\n"), 256), 1, 12)))


def decision_times(observed: DataFrame, policy: MatchPolicy) -> DataFrame:
    """When each document has gone quiet: (guid, decide_at_millis)."""
    seen = observed.filter("error is null").groupBy("guid").agg(F.min("ts_millis").alias("since"), F.max("ts_millis").alias("until"))
    return seen.select("guid", _decision_time(policy).alias("decide_at_millis"))


def _decision_time(policy: MatchPolicy) -> Column:
    return F.least(F.col("until") + policy.quiet_millis, F.col("since") + policy.max_wait_millis)


def paired(rows: DataFrame, config: CompareConfig, documents: bool) -> DataFrame:
    """One row for each document and topic, with both sides' counts and final states. Only what the config's topics can
    hold is planned; documents: also plan what is needed of a document as a whole, its entries and times."""
    sequenced = any(t.role != "ENTRY" and t.sequence_paths for t in config.topics.values())
    plain = any(t.role != "ENTRY" and not t.sequence_paths for t in config.topics.values())
    parts = [paired_unsequenced(rows)] if plain or documents or not sequenced else []
    parts += [paired_sequenced(rows)] if sequenced else []
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def in_cohort(pairs: DataFrame, config: CompareConfig) -> DataFrame:
    """What entries make of documents: those that entered both sides keep a row for each topic; those that entered one
    side get one row with the sums of their topics' counters; those that entered neither are unanchored, topic by topic.
    Adds standing: inside, one side (NOT_MIRRORED or TEST_TRAFFIC) or UNANCHORED."""
    counters = STATS[:6]
    document = Window.partitionBy("guid")
    flags = {f"entered_{s}": F.coalesce(F.max(f"entered_{s}").over(document), F.lit(False)) for s in SIDES}
    rows = pairs.withColumns(flags | {f"sum_{c}": _zero(F.sum(c).over(document)) for c in counters} | {"place": F.row_number().over(document.orderBy("topic"))})
    standing = F.when(F.col("entered_main") & F.col("entered_load"), "inside").when(F.col("entered_main"), "NOT_MIRRORED").when(F.col("entered_load"), "TEST_TRAFFIC").otherwise("UNANCHORED")
    rows = rows.withColumn("standing", standing)
    one_side = F.col("standing").isin("NOT_MIRRORED", "TEST_TRAFFIC")
    rows = rows.filter(F.when(one_side, F.col("place") == 1).otherwise(F.col("main_messages") + F.col("load_messages") > 0))
    return rows.withColumns({c: F.when(one_side, F.col(f"sum_{c}")).otherwise(F.col(c)) for c in counters} | {"topic": F.when(one_side, COHORT).otherwise(F.col("topic"))})


def judged(pairs: DataFrame, config: CompareConfig, differ: Differ) -> DataFrame:
    """status, severity, diffs of each row of documents and topics."""
    inside = F.col("standing") == "inside"
    differ_at_end = inside & (F.col("main_messages") > 0) & (F.col("load_messages") > 0) & (F.col("main_hash") != F.col("load_hash"))
    diffs = diff_udf(config, differ)
    finals = F.array(F.struct(F.col("main_json").alias("main"), F.col("load_json").alias("load")))
    out = pairs.withColumn("final_diffs", diffs("topic", F.when(differ_at_end, finals)))
    out = out.withColumn("pair_diffs", diffs("topic", F.when(inside & (F.size("final_diffs") == 0), F.col("pairs"))))
    equal = F.when(F.col("sequenced"), (F.size("pair_diffs") == 0) & (F.col("missing") == 0) & (F.col("extra") == 0)).otherwise(F.col("same_states"))
    status = F.when(~inside, F.col("standing")).when(F.col("load_messages") == 0, "MISSING_IN_LOAD").when(F.col("main_messages") == 0, "EXTRA_IN_LOAD").when(F.size("final_diffs") > 0, "DIFF").when(equal, "EQUAL").otherwise("EQUAL_DIVERGED")
    out = out.withColumn("status", status)
    fixed = {"EQUAL": "OK", "DIFF": "ERROR", "MISSING_IN_LOAD": "ERROR", "EXTRA_IN_LOAD": "WARN", "UNANCHORED": "WARN", "NOT_MIRRORED": "INFO", "TEST_TRAFFIC": "INFO", "EQUAL_DIVERGED": "WARN" if config.policy.strict_intermediates else "INFO"}
    severity = reduce(lambda when, s: when.when(F.col("status") == s, fixed[s]), list(fixed)[1:], F.when(F.col("status") == "EQUAL", fixed["EQUAL"]))
    counted = F.col("status").isin("EQUAL", "EQUAL_DIVERGED") & F.col("sequenced")
    chosen = F.when(F.col("status") == "DIFF", F.col("final_diffs")).when(F.col("status") == "EQUAL_DIVERGED", F.col("pair_diffs")).otherwise(F.array().cast(DIFFS))
    zero = F.lit(0).cast("long")
    return out.withColumns({"severity": severity, "diffs": chosen, "missing": F.when(counted, F.col("missing")).otherwise(zero), "extra": F.when(counted, F.col("extra")).otherwise(zero)})


def verdicts(observed: DataFrame, config: CompareConfig, decided_at: int | None = 0, differ: Differ = diff) -> DataFrame:
    """A verdict for each document and topic: guid, topic, status, severity, signature_id, signature, diffs, stats,
    revision, decided_at_millis. decided_at: the time of all verdicts; None: each document's own, when it has gone quiet.
    """
    by_entry, own_time = config.policy.cohort_mode == "ENTRY_TOPICS", decided_at is None
    found = paired(dealt(observed), config, documents=by_entry or own_time)
    if own_time:
        document = Window.partitionBy("guid")
        found = found.withColumns({"since": F.min("since").over(document), "until": F.max("until").over(document)})
    found = in_cohort(found, config) if by_entry else found.filter("main_messages + load_messages > 0").withColumn("standing", F.lit("inside"))
    found = judged(found, config, differ)
    long = STATS[:2] + STATS[4:6]
    stats = F.struct(*(F.col({STATS[6]: "missing", STATS[7]: "extra"}.get(c, c)).cast("long" if c in long else "int").alias(c) for c in STATS))
    at = _decision_time(config.policy) if own_time else F.lit(decided_at).cast("long")
    return with_signature(found).select("guid", "topic", "status", "severity", "signature_id", "signature", "diffs", stats.alias("stats"), F.lit(1).alias("revision"), at.alias("decided_at_millis"))
