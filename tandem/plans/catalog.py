"""The engine's queries over the derived environments, and the same in DuckDB SQL.

The SQL is written from the definition of each result, not from the engine's plan: states are spelled out as canonical
text and hashed, sides are joined, statuses follow from comparisons.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions import codec
from tandem.functions.rules import RuleTypes
from tandem.operators import observe as ob
from tandem.operators import rollups as ru
from tandem.operators import verdicts as ve
from tandem.plans import fixtures as fx
from tandem.plans.config import CompareConfig
from tandem.session import table

DECIDED_AT = 1_700_000_000_000
DAY = 86_400_000


def observed(raw: DataFrame, config: CompareConfig | None = None) -> DataFrame:
    return ob.observe(raw, config or fx.config())


def order_verdicts(spark: SparkSession, d: str, config: CompareConfig | None = None) -> DataFrame:
    config = config or fx.config(topics=("orders",))
    return ve.verdicts(observed(fx.orders(spark, d), config), config, DECIDED_AT)


def timed_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Order verdicts that were each decided when their document had gone quiet."""
    config = fx.config(topics=("orders",))
    return ve.verdicts(observed(fx.orders(spark, d), config), config, None)


def verdict_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return order_verdicts(spark, d).groupBy("status").agg(F.count("*").alias("count"))


def verdicts_by_guid(spark: SparkSession, d: str) -> DataFrame:
    return order_verdicts(spark, d).select("guid", "status", "severity", "signature_id", F.col("stats.main_messages").alias("main_messages"), F.col("stats.load_messages").alias("load_messages"), "revision", "decided_at_millis")


def cohort_verdicts(spark: SparkSession, d: str) -> DataFrame:
    config = fx.config("ENTRY_TOPICS", topics=("orders", "pipeline.in"))
    seen = observed(fx.orders(spark, d).unionByName(fx.entries(spark, d)), config)
    return ve.verdicts(seen, config).select("guid", "topic", "status", "severity", F.col("stats.main_messages").alias("main_messages"), F.col("stats.load_messages").alias("load_messages"))


def unsequenced_timeline(spark: SparkSession, d: str) -> DataFrame:
    return ve.unsequenced_timelines(observed(fx.events(spark, d))).select("guid", "env", "messages", "distinct_states", "duplicates", "hash")


def sequenced_timeline(spark: SparkSession, d: str) -> DataFrame:
    return ve.sequenced_versions(observed(fx.lines(spark, d))).select("guid", "env", "sequence", "hash", "ts_millis", "messages", "duplicates")


def sequence_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = ve.paired_sequenced(ve.dealt(observed(fx.lines(spark, d))))
    return pairs.select("guid", "missing", "extra", "main_messages", "load_messages", "main_duplicates", "load_duplicates")


def numeric_sequence_final(spark: SparkSession, d: str) -> DataFrame:
    pairs = ve.paired_sequenced(ve.dealt(observed(fx.lines(spark, d))))
    return pairs.select("guid", "main_hash", "load_hash")


def line_verdicts(spark: SparkSession, d: str) -> DataFrame:
    config = fx.config(topics=("lineitem",))
    return ve.verdicts(observed(fx.lines(spark, d), config), config).select("guid", "status", "severity", F.size("diffs").cast("long").alias("n_diffs"), F.col("stats.missing_sequences_in_load").cast("long").alias("missing"), F.col("stats.extra_sequences_in_load").cast("long").alias("extra"))


def event_verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    config = fx.config(topics=("events",))
    return ve.verdicts(observed(fx.events(spark, d), config), config).groupBy("status").agg(F.count("*").alias("count"))


def field_diffs(spark: SparkSession, d: str) -> DataFrame:
    return order_verdicts(spark, d).select("guid", F.explode("diffs").alias("d")).select("guid", "d.path", "d.kind", "d.main", "d.load")


def diff_signatures(spark: SparkSession, d: str) -> DataFrame:
    found = order_verdicts(spark, d).filter("signature_id is not null")
    return found.groupBy("signature_id", F.array_join("signature", "\n").alias("signature")).agg(F.count("*").alias("count"))


def number_tolerance(spark: SparkSession, d: str) -> DataFrame:
    strict, lax = (order_verdicts(spark, d, fx.config(epsilon=e, topics=("orders",))).groupBy("status").agg(F.count("*").alias("count")).select(F.lit(e or 0).alias("epsilon"), "status", "count") for e in (None, 1))
    return strict.unionByName(lax)


def time_tolerance(spark: SparkSession, d: str) -> DataFrame:
    config = fx.config(topics=("times",))
    return ve.verdicts(observed(fx.times(spark, d), config), config).select("guid", "status")


def _states(spark: SparkSession, d: str, payload, rules: dict) -> DataFrame:
    """States of one payload for each part, under one rule set."""
    df = table(spark, d, "part").withColumn("k", F.col("p_partkey"))
    raw = df.select(F.lit("MAIN").alias("env"), F.lit("orders").alias("topic"), F.lit(None).cast("binary").alias("key"), payload.cast("binary").alias("value"), F.col("k").alias("ts_millis"), F.col("k").alias("arrival"))
    return observed(raw, fx.config(orders=rules)).select("guid", "state_json", "state_hash")


def _payload(text: str):
    """A JSON text in which {k}, {name}, {brand} and {size} stand for a part's values."""
    out = F.lit(text)
    for name, value in {"{k}": F.col("k").cast("string"), "{name}": F.col("p_name"), "{brand}": F.col("p_brand"), "{size}": F.col("p_size").cast("string")}.items():
        out = F.replace(out, F.lit(name), value)
    return out


def _sql_text(text: str, states: str = "part") -> str:
    return f"select cast(k as varchar) as guid, s as state_json, sha256(s) as state_hash from (select p_partkey as k, replace(replace(replace(replace('{text}', '{{k}}', cast(p_partkey as varchar)), '{{name}}', p_name), '{{brand}}', p_brand), '{{size}}', cast(p_size as varchar)) as s from {states})"


#: name: (payload, rule set, canonical state)
STATE_CASES = {
    "canonical_hash": ('{"z":[1.50,1e2,-0.0,true,null],"guid":"{k}","a":{"y":"{name}","x":{size}.10}}', {"rules": []}, '{"a":{"x":{size}.1,"y":"{name}"},"guid":"{k}","z":[1.5,100,0,true,null]}'),
    "ignore_mask_hash": ('{"guid":"{k}","meta":{"traceId":"t{k}","by":"{brand}"},"ssn":"{size}","items":[{"id":1,"ts":9},{"id":{size},"ts":8}]}', {"rules": [{"type": "ignore", "path": "**.traceId"}, {"type": "mask", "path": "ssn"}, {"type": "ignore", "path": "items[].ts"}]}, '{"guid":"{k}","items":[{"id":1},{"id":{size}}],"meta":{"by":"{brand}"},"ssn":"***"}'),
    "cast_rule": ('{"guid":"{k}","size":" {size}.00 ","flag":"TRUE","name":"{name}"}', {"rules": [{"type": "cast", "path": "size", "to": "NUMBER"}, {"type": "cast", "path": "flag", "to": "BOOLEAN"}, {"type": "cast", "path": "name", "to": "NUMBER"}]}, '{"flag":true,"guid":"{k}","name":"{name}","size":{size}}'),
    "null_absent": ('{"guid":"{k}","a":null,"b":[null,{size}],"c":{"d":null}}', {"rules": []}, '{"b":[null,{size}],"c":{},"guid":"{k}"}'),
    "empty_absent": ('{"guid":"{k}","a":{"b":{"c":null}},"d":[],"e":[{}],"f":{size}}', {"emptyEqualsAbsent": True, "rules": []}, '{"e":[{}],"f":{size},"guid":"{k}"}'),
    "unordered_arrays": ('{"guid":"{k}","tags":["z","{brand}","a"],"kept":["z","a"]}', {"rules": [{"type": "unordered", "path": "tags"}]}, '{"guid":"{k}","kept":["z","a"],"tags":["{brand}","a","z"]}'),
}


def _state_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    payload, rules, _ = STATE_CASES[name]
    return lambda spark, d: _states(spark, d, _payload(payload), rules)


def observations_roles(spark: SparkSession, d: str) -> DataFrame:
    seen = observed(fx.orders(spark, d).unionByName(fx.entries(spark, d)))
    return seen.groupBy("env", "topic", "kind").agg(F.count("*").alias("count"), F.countDistinct("guid").alias("guids"))


def guid_extract(spark: SparkSession, d: str) -> DataFrame:
    return observed(fx.parts(spark, d)).select("env", "guid")


def composite_sequence(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events")
    payload = F.concat(F.lit('{"guid":"'), F.col("user_id").cast("string"), F.lit('","seq":['), F.lit('"'), F.col("event_type"), F.lit('",'), F.col("event_id").cast("string"), F.lit("]}"))
    raw = df.select(F.lit("MAIN").alias("env"), F.lit("s").alias("topic"), F.lit(None).cast("binary").alias("key"), payload.cast("binary").alias("value"), F.col("event_id").alias("ts_millis"), F.col("event_id").alias("arrival"))
    config = {"topics": [{"name": "s", "format": "json", "guidPath": "guid", "sequencePath": ["seq[0]", "seq[1]"]}]}
    return ob.observe(raw, json.dumps(config)).select("guid", "sequence")


def dead_letters(spark: SparkSession, d: str) -> DataFrame:
    found = ob.dead_letters(observed(fx.broken(spark, d)))
    return found.select("env", "topic", "ts_millis", "error", F.col("payload").cast("string").alias("payload"))


def dead_letter_counts(spark: SparkSession, d: str) -> DataFrame:
    return dead_letters(spark, d).groupBy("env", "topic").agg(F.count("*").alias("count"))


def dead_letter_json(spark: SparkSession, d: str) -> DataFrame:
    return codec.keyed_dead_letters(ob.dead_letters(observed(fx.broken(spark, d))))


def xml_decode(spark: SparkSession, d: str) -> DataFrame:
    return observed(fx.parts(spark, d)).select("env", "guid", "state_json")


def xml_verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    config = fx.config(topics=("parts",))
    return ve.verdicts(observed(fx.parts(spark, d), config), config).groupBy("status").agg(F.count("*").alias("count"))


def decision_times(spark: SparkSession, d: str) -> DataFrame:
    config = fx.config()
    return ve.decision_times(observed(fx.events(spark, d), config), config.policy)


def rollups(spark: SparkSession, d: str) -> DataFrame:
    return ru.rollups(timed_verdicts(spark, d), DAY).select("window_start_millis", "window_end_millis", "topic", "status", "severity", "signature_id", F.array_join("signature", "\n").alias("signature"), "count")


def rollup_samples(spark: SparkSession, d: str) -> DataFrame:
    return ru.rollups(timed_verdicts(spark, d), 30 * DAY).select("window_start_millis", "status", "signature_id", F.array_join("sample_guids", ",").alias("sample_guids"))


def rollup_json(spark: SparkSession, d: str) -> DataFrame:
    return codec.keyed_rollups(ru.rollups(timed_verdicts(spark, d), 30 * DAY))


def summary_recent(spark: SparkSession, d: str) -> DataFrame:
    return ru.summary(timed_verdicts(spark, d))


def summary_all(spark: SparkSession, d: str) -> DataFrame:
    return ru.summary(timed_verdicts(spark, d), limit=None)


def latest_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """A second revision of every third document says EQUAL; the latest one counts."""
    first = order_verdicts(spark, d).select("guid", "topic", "status", "revision", "decided_at_millis")
    again = first.filter(F.col("guid").cast("long") % 3 == 0).withColumn("revision", F.lit(2)).withColumn("status", F.lit("EQUAL"))
    return ru.latest_verdicts(first.unionByName(again)).groupBy("status", "revision").agg(F.count("*").alias("count"))


def diff_volume_series(spark: SparkSession, d: str) -> DataFrame:
    return ru.volume_series(ru.rollups(timed_verdicts(spark, d), 30 * DAY))


def topic_diff_rates(spark: SparkSession, d: str) -> DataFrame:
    config = fx.config(topics=("orders", "times"))
    seen = observed(fx.orders(spark, d).unionByName(fx.times(spark, d)), config)
    return ru.diff_rates(ru.rollups(ve.verdicts(seen, config, DECIDED_AT), DAY))


def topic_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return ru.status_counts(ru.rollups(timed_verdicts(spark, d), DAY), "orders")


def suggested_ignore_rules(spark: SparkSession, d: str) -> DataFrame:
    return ru.suggested_rules(ru.rollups(timed_verdicts(spark, d), DAY))


def rule_catalog(spark: SparkSession, d: str) -> DataFrame:
    rows = [(t["type"], ",".join(f"{p['name']}:{p['kind']}:{'required' if p['required'] else 'optional'}" for p in t["params"])) for t in RuleTypes.standard().catalogue()]
    return spark.createDataFrame(rows, "type string, params string")


def verdict_json(spark: SparkSession, d: str) -> DataFrame:
    return codec.keyed_verdicts(order_verdicts(spark, d), emit_equal=False)


def strict_severities(spark: SparkSession, d: str) -> DataFrame:
    """With strict intermediates, documents that diverged on the way are warnings."""
    return order_verdicts(spark, d, fx.config(strict=True, topics=("orders",))).groupBy("status", "severity").agg(F.count("*").alias("count"))


def array_field_diffs(spark: SparkSession, d: str) -> DataFrame:
    config = fx.config(topics=("baskets",))
    return ve.verdicts(observed(fx.baskets(spark, d), config), config).select("guid", F.explode("diffs").alias("d")).select("guid", "d.path", "d.general", "d.kind", "d.main", "d.load")


def sequence_orders(spark: SparkSession, d: str) -> DataFrame:
    """Final states by decimal sequences, by long ones, and by some that only their arrival orders."""
    config = fx.config(topics=("steps",))
    return ve.verdicts(observed(fx.steps(spark, d), config), config).select("guid", "status", "severity", F.size("diffs").cast("long").alias("n_diffs"))


_PLAIN = [
    verdict_status_counts, verdicts_by_guid, cohort_verdicts, unsequenced_timeline, sequenced_timeline, sequence_pairs, numeric_sequence_final, line_verdicts, event_verdict_counts, field_diffs,
    diff_signatures, number_tolerance, time_tolerance, observations_roles, guid_extract, composite_sequence, dead_letters, dead_letter_counts, dead_letter_json, xml_decode, xml_verdict_counts,
    decision_times, rollups, rollup_samples, rollup_json, summary_recent, summary_all, latest_verdicts, diff_volume_series, topic_diff_rates, topic_status_counts, suggested_ignore_rules, rule_catalog, verdict_json,
    strict_severities, array_field_diffs, sequence_orders,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _PLAIN} | {name: _state_query(name) for name in STATE_CASES}


# ---- the same in SQL ------------------------------------------------------------------------------------------------

_ORDERS = """
o as (select o_orderkey as k, o_orderstatus as st, o_orderpriority as pr, cast(round(o_totalprice * 100) as bigint) as c, (epoch_us(o_orderdate) // 1000) as ts from orders),
m as (select k, ts, st, pr, c, '{"guid":"' || k || '","priority":"' || pr || '","status":"' || st || '","total":' || c || '}' as s from o where k % 50 <> 7),
l0 as (select k, ts, case when k % 17 <> 0 then st end as st, case when k % 13 = 0 then 'X-' || pr else pr end as pr, c + (case when k % 11 = 0 then 1 else 0 end) as c from o where k % 40 <> 3),
l as (select *, '{"guid":"' || k || '","priority":"' || pr || '"' || coalesce(',"status":"' || st || '"', '') || ',"total":' || c || '}' as s from l0),
j as (select coalesce(m.k, l.k) as k, coalesce(m.ts, l.ts) as ts, m.k is not null as im, l.k is not null as il, m.s as ms, l.s as ls, m.pr as mp, l.pr as lp, m.st as mst, l.st as lst, abs(m.c - l.c) as dc, m.c as mc, l.c as lc from m full join l using (k)),
v0 as (select *, mp is distinct from lp as dp, mst is distinct from lst as dst from j),
v as (select k, cast(k as varchar) as guid, 'orders' as topic, ts, im, il, mp, lp, mst, dp, dst, ms, ls,
  case when not il then 'MISSING_IN_LOAD' when not im then 'EXTRA_IN_LOAD' when dp or dst or dc > {epsilon} then 'DIFF' when ms = ls then 'EQUAL' else 'EQUAL_DIVERGED' end as status,
  case when im and il and (dp or dst) then concat_ws(chr(10), case when dp then 'priority: value-changed' end, case when dst then 'status: removed' end) end as sig from v0),
w as (select *, case status when 'EQUAL' then 'OK' when 'EQUAL_DIVERGED' then 'INFO' when 'EXTRA_IN_LOAD' then 'WARN' else 'ERROR' end as severity, substr(sha256(sig), 1, 12) as signature_id, ts + 300000 as decided from v)
"""
_W = "with " + _ORDERS.replace("{epsilon}", "1")
_EVENTS = """
e as (select cast(user_id as varchar) as guid, (epoch_us(ts) // 1000) as t, event_id, '{"guid":"' || user_id || '","k":' || json_extract_string(props, '$.k') || ',"type":"' || event_type || '"}' as s from events),
x as (select 'MAIN' as env, * from e union all select 'LOAD', * from e where event_id % 41 <> 0),
f as (select env, guid, s, count(*) as n, min({'t': t, 'i': event_id}) as first from x group by all),
tl as (select guid, env, cast(sum(n) as bigint) as messages, count(*) as distinct_states, cast(sum(n) - count(*) as bigint) as duplicates, sha256(arg_max(s, first)) as hash, list_sort(list(s)) as states from f group by guid, env)
"""
_LINES = """
c as (select *, unnest(case when l_suppkey % 7 = 0 then [0, 1] else [0] end) as cp from lineitem),
x as (select 'MAIN' as env, *, 0 as more from c where l_suppkey % 29 <> 0 union all select 'LOAD', *, case when l_suppkey % 23 = 0 then 1 else 0 end from c where l_partkey % 37 <> 0),
y as (select env, cast(l_orderkey as varchar) as guid, cast(l_linenumber as varchar) as sequence, (epoch_us(l_shipdate) // 1000) as ts,
  '{"guid":"' || l_orderkey || '","price":' || (cast(round(l_extendedprice * 100) as bigint) + more) || ',"qty":' || cast(round(l_quantity * 100) as bigint) || ',"seq":' || l_linenumber || '}' as s,
  row_number() over (partition by env, l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, cp) as a from x),
z as (select guid, env, sequence, count(*) as messages, list_reduce(list({'s': s, 't': ts, 'd': 0::bigint} order by a), lambda p, q: case when p.s = q.s then {'s': p.s, 't': p.t, 'd': p.d + 1} when q.t >= p.t then {'s': q.s, 't': q.t, 'd': p.d} else p end) as v from y group by all),
sv as (select guid, env, sequence, v.s as s, sha256(v.s) as hash, v.t as ts_millis, messages, v.d as duplicates from z),
pr as (select guid, sequence, max(case when env = 'MAIN' then s end) as ms, max(case when env = 'LOAD' then s end) as ls, max(case when env = 'MAIN' then messages end) as mn, max(case when env = 'LOAD' then messages end) as ln_, max(case when env = 'MAIN' then duplicates end) as md, max(case when env = 'LOAD' then duplicates end) as ld from sv group by all),
pg as (select guid, count(*) filter (where ls is null) as missing, count(*) filter (where ms is null) as extra, cast(coalesce(sum(mn), 0) as bigint) as main_messages, cast(coalesce(sum(ln_), 0) as bigint) as load_messages,
  cast(coalesce(sum(md), 0) as bigint) as main_duplicates, cast(coalesce(sum(ld), 0) as bigint) as load_duplicates,
  arg_max(ms, cast(sequence as bigint)) filter (where ms is not null) as mf, arg_max(ls, cast(sequence as bigint)) filter (where ls is not null) as lf from pr group by guid)
"""
_ROLL = _W + ", r as (select decided - decided % {window} as window_start_millis, topic, status, severity, coalesce(signature_id, '') as signature_id, coalesce(sig, '') as signature, guid, decided from w)"


def _rolled(window: int) -> str:
    return _ROLL.replace("{window}", str(window))


def _line_diffs(side: str) -> str:
    """How many of price, qty and seq differ; the streams only change the price, but a line's pair may be two lines."""
    return f"(select count(*) from unnest(['price', 'qty', 'seq']) t(f) where json_extract_string({side.split(',')[0]}, '$.' || f) <> json_extract_string({side.split(',')[1]}, '$.' || f))"


def oracle_sql() -> dict[str, str]:
    status = "select status, count(*) as count from w group by status"
    letters = """select env, 'broken' as topic, (epoch_us(ts) // 1000) as ts_millis, 'invalid JSON on topic broken' as error, substr(props, 1, length(props) - 1) as payload from events, (values ('MAIN'), ('LOAD')) t(env) where event_id % 43 = 0"""
    found = {
        "verdict_status_counts": f"{_W} {status}",
        "verdicts_by_guid": f"{_W} select guid, status, severity, signature_id, cast(im as bigint) as main_messages, cast(il as bigint) as load_messages, 1 as revision, {DECIDED_AT} as decided_at_millis from w",
        "cohort_verdicts": f"""{_W}, f as (select o_orderkey as k, o_orderkey % 29 <> 0 as em, o_orderkey % 31 <> 0 as el from orders), a as (select f.k, em, el, w.guid, w.status, w.severity, coalesce(im, false) as im, coalesce(il, false) as il from f left join w using (k))
select cast(k as varchar) as guid, case when em and el or not em and not el then 'orders' else '(cohort)' end as topic,
  case when em and el then status when em then 'NOT_MIRRORED' when el then 'TEST_TRAFFIC' else 'UNANCHORED' end as status,
  case when em and el then severity when em or el then 'INFO' else 'WARN' end as severity, cast(im as bigint) as main_messages, cast(il as bigint) as load_messages
from a where (em <> el) or guid is not null""",
        "unsequenced_timeline": f"with {_EVENTS} select guid, env, messages, distinct_states, duplicates, hash from tl",
        "event_verdict_counts": f"""with {_EVENTS}, p as (select m.guid, m.hash as mh, l.hash as lh, m.states as ms, l.states as ls from (select * from tl where env = 'MAIN') m full join (select * from tl where env = 'LOAD') l using (guid))
select case when mh is null then 'EXTRA_IN_LOAD' when lh is null then 'MISSING_IN_LOAD' when mh <> lh then 'DIFF' when ms = ls then 'EQUAL' else 'EQUAL_DIVERGED' end as status, count(*) as count from p group by all""",
        "sequenced_timeline": f"with {_LINES} select guid, env, sequence, hash, ts_millis, messages, duplicates from sv",
        "sequence_pairs": f"with {_LINES} select guid, missing, extra, main_messages, load_messages, main_duplicates, load_duplicates from pg",
        "numeric_sequence_final": f"with {_LINES} select guid, sha256(mf) as main_hash, sha256(lf) as load_hash from pg",
        "line_verdicts": f"""with {_LINES}, pd as (select guid, cast(sum({_line_diffs("ms,ls")}) as bigint) as n from pr where ms <> ls group by guid),
q as (select pg.*, coalesce(n, 0) as n, {_line_diffs("mf,lf")} as fd from pg left join pd using (guid)),
s as (select *, case when load_messages = 0 then 'MISSING_IN_LOAD' when main_messages = 0 then 'EXTRA_IN_LOAD' when mf <> lf then 'DIFF' when n = 0 and missing = 0 and extra = 0 then 'EQUAL' else 'EQUAL_DIVERGED' end as status from q)
select guid, status, case status when 'EQUAL' then 'OK' when 'EQUAL_DIVERGED' then 'INFO' when 'EXTRA_IN_LOAD' then 'WARN' else 'ERROR' end as severity,
  case status when 'DIFF' then fd when 'EQUAL_DIVERGED' then n else 0 end as n_diffs, case when status like 'EQUAL%' then missing else 0 end as missing, case when status like 'EQUAL%' then extra else 0 end as extra from s""",
        "field_diffs": f"""{_W} select guid, 'priority' as path, 'value-changed' as kind, '"' || mp || '"' as main, '"' || lp || '"' as load from w where status = 'DIFF' and dp
union all select guid, 'status', 'removed', '"' || mst || '"', null from w where status = 'DIFF' and dst
union all select guid, 'total', 'value-changed', cast(mc as varchar), cast(lc as varchar) from w join (select cast(k as varchar) as guid, mc, lc, dc from j) using (guid) where status = 'DIFF' and dc > 1""",
        "diff_signatures": f"{_W} select signature_id, sig as signature, count(*) as count from w where sig is not null group by all",
        "number_tolerance": f"with {_ORDERS.replace('{epsilon}', '0')} select 0 as epsilon, status, count(*) as count from w group by status union all select * from ({_W} select 1 as epsilon, status, count(*) as count from w group by status)",
        "time_tolerance": "select cast(o_orderkey as varchar) as guid, case when o_orderkey % 5 > 2 then 'DIFF' when o_orderkey % 5 = 0 and o_orderkey % 2 = 1 then 'EQUAL' else 'EQUAL_DIVERGED' end as status from orders",
        "observations_roles": """select env, topic, kind, count(*) as count, count(distinct k) as guids from (
select 'MAIN' as env, 'orders' as topic, 'OUTPUT' as kind, o_orderkey as k from orders where o_orderkey % 50 <> 7 union all select 'LOAD', 'orders', 'OUTPUT', o_orderkey from orders where o_orderkey % 40 <> 3
union all select 'MAIN', 'pipeline.in', 'ENTRY', o_orderkey from orders where o_orderkey % 29 <> 0 union all select 'LOAD', 'pipeline.in', 'ENTRY', o_orderkey from orders where o_orderkey % 31 <> 0) group by all""",
        "guid_extract": "select env, cast(p_partkey as varchar) as guid from part, (values ('MAIN'), ('LOAD')) t(env)",
        "composite_sequence": "select cast(user_id as varchar) as guid, event_type || '|' || event_id as sequence from events",
        "dead_letters": letters,
        "dead_letter_counts": f"select env, topic, count(*) as count from ({letters}) group by all",
        "dead_letter_json": f"""select env || '|' || topic as key, '{{"type":"dead-letter","env":"' || env || '","topic":"broken","timestampMillis":' || ts_millis || ',"error":"' || error || '","payloadPreview":"' || replace(payload, '"', '\\"') || '"}}' as value from ({letters})""",
        "xml_decode": """select env, cast(p_partkey as varchar) as guid, '{"part":{"@id":"' || p_partkey || '","brand":"' || p_brand || '","size":' || p_size || '}}' as state_json from part, (values ('MAIN'), ('LOAD')) t(env)""",
        "xml_verdict_counts": "select 'EQUAL' as status, count(*) as count from part",
        "decision_times": "select cast(user_id as varchar) as guid, least(max((epoch_us(ts) // 1000)) + 300000, min((epoch_us(ts) // 1000)) + 3600000) as decide_at_millis from events group by user_id",
        "rollups": f"{_rolled(DAY)} select window_start_millis, window_start_millis + {DAY} as window_end_millis, topic, status, severity, signature_id, signature, count(*) as count from r group by all",
        "rollup_samples": f"{_rolled(30 * DAY)} select window_start_millis, status, signature_id, array_to_string(list_slice(list(guid order by decided, guid), 1, 5), ',') as sample_guids from r group by all",
        "rollup_json": f"""{_rolled(30 * DAY)} select topic || '|' || status || '|' || signature_id as key, '{{"type":"rollup","windowStartMillis":' || window_start_millis || ',"windowEndMillis":' || (window_start_millis + {30 * DAY}) || ',"topic":"' || topic || '","status":"' || status || '","severity":"' || severity || '"'
|| case when signature_id <> '' then ',"signatureId":"' || signature_id || '","signature":["' || replace(signature, chr(10), '","') || '"]' else '' end || ',"count":' || count(*) || ',"sampleGuids":["' || array_to_string(list_slice(list(guid order by decided, guid), 1, 5), '","') || '"]}}' as value
from r group by window_start_millis, topic, status, severity, signature_id, signature""",
        "summary_recent": f"{_W} select status, count(*) as count from (select * from w order by decided desc, guid, topic limit 100) group by status",
        "summary_all": f"{_W} {status}",
        "latest_verdicts": f"{_W} select case when k % 3 = 0 then 'EQUAL' else status end as status, case when k % 3 = 0 then 2 else 1 end as revision, count(*) as count from w group by all",
        "diff_volume_series": f"{_rolled(30 * DAY)} select window_start_millis, count(*) filter (where status = 'DIFF') as diff, count(*) filter (where status <> 'DIFF') as other from r group by all",
        "topic_diff_rates": f"""{_W}, t as (select topic, status from w union all select 'times', case when o_orderkey % 5 > 2 then 'DIFF' else 'EQUAL' end from orders), g as (select topic, count(*) as total, count(*) filter (where status = 'DIFF') as diff from t group by topic),
h as (select *, cast(floor(diff * 100 / total + 0.5) as bigint) as pct from g) select topic, total, diff, pct, case when pct >= 25 then 'red' when pct >= 5 then 'yellow' else 'green' end as level from h""",
        "topic_status_counts": f"{_W} {status}",
        "suggested_ignore_rules": f"{_W} select 'ignore' as type, trim(regexp_replace(e, ':[^:]*$', '')) as path, count(*) as count from (select unnest(string_split(sig, chr(10))) as e from w where sig is not null) group by all",
        "verdict_json": f"""{_W}, d as (select *, concat_ws(',', case when dp then '{{"path":"priority","kind":"value-changed","main":"\\"' || mp || '\\"","load":"\\"' || lp || '\\""}}' end, case when dst then '{{"path":"status","kind":"removed","main":"\\"' || mst || '\\""}}' end) as ds from w where status <> 'EQUAL')
select guid || '|' || topic as key, '{{"type":"verdict","guid":"' || guid || '","topic":"orders","status":"' || status || '","severity":"' || severity || '","revision":1,"decidedAtMillis":{DECIDED_AT}'
|| case when status = 'DIFF' then ',"signatureId":"' || signature_id || '","signature":["' || replace(sig, chr(10), '","') || '"],"diffs":[' || ds || ']' else '' end
|| ',"stats":{{"mainMessages":' || cast(im as int) || ',"loadMessages":' || cast(il as int) || ',"mainDistinctStates":' || cast(im as int) || ',"loadDistinctStates":' || cast(il as int) || ',"mainDuplicates":0,"loadDuplicates":0,"missingSequencesInLoad":0,"extraSequencesInLoad":0}}}}' as value from d""",
        "strict_severities": f"{_W} select status, case when status = 'EQUAL_DIVERGED' then 'WARN' else severity end as severity, count(*) as count from w group by all",
        "array_field_diffs": """with p as (select p_partkey as k, p_size as z from part)
select cast(k as varchar) as guid, 'items[0].p' as path, 'items[].p' as general, 'value-changed' as kind, cast(z as varchar) as main, cast(z + 1 as varchar) as load from p where k % 3 = 0
union all select cast(k as varchar), 'items[2]', 'items[]', 'added', null, '{"p":9}' from p where k % 4 = 0
union all select cast(k as varchar), 'more', 'more', 'added', null, 'true' from p where k % 7 = 0
union all select cast(k as varchar), 'note', 'note', 'removed', '"n"', null from p where k % 11 = 0
union all select cast(k as varchar), 'note', 'note', 'type-changed', '"n"', '5' from p where k % 5 = 0 and k % 11 <> 0""",
        "sequence_orders": """with s as (select o_orderkey as k, case when k % 3 = 2 then 3 else 2 end as n, case when k % 3 < 2 then 1 when k % 2 = 0 then 2 else 0 end as last from orders)
select cast(k as varchar) as guid, case when k % n = last then 'DIFF' else 'EQUAL_DIVERGED' end as status, case when k % n = last then 'ERROR' else 'INFO' end as severity, 1 as n_diffs from s""",
        "rule_catalog": "select * from (values ('cast', 'to:enum:NUMBER,BOOLEAN:required'), ('ignore', ''), ('mask', ''), ('numberTolerance', 'epsilon:number:required'), ('timeTolerance', 'toleranceMillis:number:required,epochUnit:enum:MILLIS,SECONDS:optional'), ('unordered', '')) t(type, params)",
    }
    return found | {name: _sql_text(state) for name, (_, _, state) in STATE_CASES.items()}
