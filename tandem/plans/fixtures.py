"""Two environments derived from the supplied tables by plain arithmetic, so that every verdict is known beforehand.

Each stream has the envelope of raw records and an arrival of its own; LOAD differs from MAIN where a key says so.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.plans.config import CompareConfig, load_compare
from tandem.session import spread, table


def millis(df: DataFrame, name: str) -> Column:
    """Epoch milliseconds; a timestamp without a zone counts as UTC, whatever the session's zone."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {name})")
    return F.unix_millis(name)


def cents(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("long")


def _json(**fields: Column | None) -> Column:
    """An object of fields that are JSON already; a null one is left out."""
    parts = [F.concat(F.lit(f'"{k}":'), v.cast("string")) for k, v in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _text(x: Column) -> Column:
    return F.concat(F.lit('"'), x.cast("string"), F.lit('"'))


def _sides(df: DataFrame, topic: str, payloads: dict[str, Column], keep: dict[str, Column], ts: Column, arrival: Column, key: Column) -> DataFrame:
    sides = [
        df.filter(keep.get(env, F.lit(True))).select(F.lit(env).alias("env"), F.lit(topic).alias("topic"), key.cast("string").cast("binary").alias("key"), payload.cast("binary").alias("value"), ts.alias("ts_millis"), arrival.alias("arrival"))
        for env, payload in payloads.items()
    ]
    return spread(reduce(DataFrame.unionByName, sides))


def orders(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders")
    k = F.col("o_orderkey")
    total = cents("o_totalprice")
    load_total = total + F.when(k % 11 == 0, 1).otherwise(0)
    both = lambda env, status, priority, total: _json(guid=_text(k), status=status, priority=priority, total=total, traceId=_text(F.concat(F.lit(env + "-"), k.cast("string"))))
    main = both("MAIN", _text(F.col("o_orderstatus")), _text(F.col("o_orderpriority")), total)
    load = both(
        "LOAD", F.when(k % 17 != 0, _text(F.col("o_orderstatus"))), _text(F.when(k % 13 == 0, F.concat(F.lit("X-"), "o_orderpriority")).otherwise(F.col("o_orderpriority"))),
        F.when(k % 19 == 0, _text(load_total)).otherwise(load_total.cast("string")),
    )
    return _sides(df, "orders", {"MAIN": main, "LOAD": load}, {"MAIN": k % 50 != 7, "LOAD": k % 40 != 3}, millis(df, "o_orderdate"), k, k)


def entries(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders")
    k = F.col("o_orderkey")
    payload = _json(guid=_text(k))
    return _sides(df, "pipeline.in", {"MAIN": payload, "LOAD": payload}, {"MAIN": k % 29 != 0, "LOAD": k % 31 != 0}, millis(df, "o_orderdate"), k, k)


LINE_ORDER = ("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "cp")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Arrival follows other columns than time, so that late and repeated messages occur."""
    df = table(spark, d, "lineitem")
    df = df.withColumn("cp", F.explode(F.when(F.col("l_suppkey") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    price = cents("l_extendedprice")
    payload = lambda price: _json(guid=_text(F.col("l_orderkey")), seq=F.col("l_linenumber"), qty=cents("l_quantity"), price=price)
    load = payload(price + F.when(F.col("l_suppkey") % 23 == 0, 1).otherwise(0))
    return _sides(df, "lineitem", {"MAIN": payload(price), "LOAD": load}, {"MAIN": F.col("l_suppkey") % 29 != 0, "LOAD": F.col("l_partkey") % 37 != 0}, millis(df, "l_shipdate"), F.struct(*LINE_ORDER), F.col("l_orderkey"))


def events(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events")
    payload = _json(guid=_text(F.col("user_id")), type=_text(F.col("event_type")), k=F.get_json_object("props", "$.k"))
    return _sides(df, "events", {"MAIN": payload, "LOAD": payload}, {"LOAD": F.col("event_id") % 41 != 0}, millis(df, "ts"), F.struct(millis(df, "ts").alias("t"), "event_id"), F.col("event_id"))


def broken(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events")
    payload = F.when(F.col("event_id") % 43 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    return _sides(df, "broken", {"MAIN": payload, "LOAD": payload}, {}, millis(df, "ts"), F.col("event_id"), F.col("event_id"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part")
    k = F.col("p_partkey")
    xml = lambda size: F.concat(F.lit('<part id="'), k.cast("string"), F.lit('"><brand>'), F.col("p_brand"), F.lit("</brand> <size>"), size, F.lit("</size></part>"))
    size = F.col("p_size").cast("string")
    return _sides(df, "parts", {"MAIN": xml(size), "LOAD": xml(F.when(k % 7 == 0, F.concat(size, F.lit(".0"))).otherwise(size))}, {}, k, k, k)


def times(spark: SparkSession, d: str) -> DataFrame:
    """A time that LOAD writes key % 5 seconds later, and for even keys in another zone's form."""
    df = table(spark, d, "orders")
    k = F.col("o_orderkey")
    second = F.pmod(k, F.lit(50))
    at = lambda s: F.concat(F.lit("2024-01-02T03:04:"), F.lpad(s.cast("string"), 2, "0"))
    late = at(second + k % 5)
    load = F.when(k % 2 == 0, F.concat(F.regexp_replace(late, "T03", "T06"), F.lit("+03:00"))).otherwise(F.concat(late, F.lit("Z")))
    return _sides(df, "times", {"MAIN": _json(guid=_text(k), at=_text(F.concat(at(second), F.lit("Z")))), "LOAD": _json(guid=_text(k), at=_text(load))}, {}, k, k, k)


def baskets(spark: SparkSession, d: str) -> DataFrame:
    """Objects with arrays: LOAD changes an element, adds one, adds a field, drops a field or changes its type."""
    df = table(spark, d, "part")
    k = F.col("p_partkey")
    items = lambda first, *more: F.concat(F.lit('[{"p":'), first.cast("string"), F.lit('},{"p":1}'), *more, F.lit("]"))
    size = F.col("p_size")
    main = _json(guid=_text(k), items=items(size), note=F.lit('"n"'))
    note = F.when(k % 11 == 0, F.lit(None)).when(k % 5 == 0, "5").otherwise('"n"')
    load = _json(guid=_text(k), items=items(size + F.when(k % 3 == 0, 1).otherwise(0), F.when(k % 4 == 0, ',{"p":9}').otherwise("")), more=F.when(k % 7 == 0, "true"), note=note)
    return _sides(df, "baskets", {"MAIN": main, "LOAD": load}, {}, k, k, k)


#: Sequences as a document's key modulo 3 says: decimals, numbers of more than 18 digits, numbers among texts.
STEPS = (("9.5", "10.5"), ("99999999999999999999", "100000000000000000000"), ("2", "10", "1a"))


def steps(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose sequences are spelled in several ways. They arrive as listed for even keys, the other way round
    for odd ones; LOAD has another state at the place that is the key modulo their number."""
    df = table(spark, d, "orders")
    k = F.col("o_orderkey")
    lists = F.array(*(F.array(*map(F.lit, x)) for x in STEPS))
    df = df.withColumn("all", F.get(lists, (k % 3).cast("int"))).select("o_orderkey", F.size("all").alias("n"), F.posexplode("all").alias("at", "s"))
    arrival = F.when(k % 2 == 0, F.col("at")).otherwise(-F.col("at"))
    payload = lambda v: _json(guid=_text(k), s=_text(F.col("s")), v=v)
    load = F.when(F.col("at") == k % F.col("n"), 2).otherwise(1)
    return _sides(df, "steps", {"MAIN": payload(F.lit(1)), "LOAD": payload(load)}, {}, k, F.struct(k.alias("k"), arrival.alias("at")), k)


def config(mode: str = "ASSUME_ALL", epsilon: int | None = 1, tolerance: int = 2000, strict: bool = False, topics: tuple[str, ...] = (), **changes: dict) -> CompareConfig:
    """The compare config of all streams, or of those named; changes replace rule sets by name."""
    rules = [{"type": "ignore", "path": "**.traceId"}, {"type": "cast", "path": "total", "to": "NUMBER"}]
    if epsilon is not None:
        rules.append({"type": "numberTolerance", "path": "total", "epsilon": epsilon})
    topic = lambda name, role="OUTPUT", kind="json", guid="guid", **more: {"name": name, "role": role, "format": kind, "guidPath": guid} | more
    return load_compare(json.dumps({
        "policy": {"cohortMode": mode, "strictIntermediates": strict},
        "ruleSets": {
            "default": {"rules": []}, "orders": {"rules": rules}, "parts": {"rules": [{"type": "cast", "path": "part.size", "to": "NUMBER"}]},
            "times": {"rules": [{"type": "timeTolerance", "path": "at", "toleranceMillis": tolerance}]},
        } | changes,
        "topics": [t for t in (
            topic("orders", ruleSet="orders"), topic("pipeline.in", "ENTRY"), topic("lineitem", sequencePath="seq"), topic("events"),
            topic("broken", guid="k"), topic("parts", kind="xml", guid="part.@id", ruleSet="parts"), topic("times", ruleSet="times"), topic("baskets"),
            topic("steps", sequencePath="s"),
        ) if not topics or t["name"] in topics],
    }))
