"""The job on a stream: roll-ups, repeated batches, state that ends, control messages, plug-ins; the API's contract."""

import json
import threading
import time
import urllib.request

import pytest
from pyspark.sql import functions as F

from tandem.functions import codec
from tandem.functions.decoders import DecoderRegistry
from tandem.functions.rules import FieldDiff, RuleTypes, Rule, normalise
from tandem.operators import rollups as ru
from tandem.operators import verdicts as ve
from tandem.operators.observe import dead_letters, observe
from tandem.plans.config import load_compare, load_job
from tandem.plans.plugins import Plugins
from tandem.sources import readers
from tandem.sources.findings import TableStore
from tandem.streaming import api as http_api
from tandem.streaming import engine, openapi
from tandem.streaming.control import FolderControl, KafkaControl, Resolver, publish, relay
from tests.test_engine import compare, rows_of

BASE = {"policy": {"cohortMode": "ASSUME_ALL", "quietMillis": 800, "maxWaitMillis": 600000}, "topics": [{"name": "t", "format": "json", "guidPath": "guid"}, {"name": "q", "format": "json", "guidPath": "guid", "sequencePath": "s"}]}


def job(tmp_path, base=BASE, **more):
    servers = {"bootstrapServers": "h"}
    table = lambda name: {"type": "table", "options": {"path": f"{tmp_path}/{name}"}}
    return load_job({"compare": base, "main": servers, "load": servers, "control": servers | {"topic": "c"}, "results": table("results"), "deadLetters": table("dead"), "rollups": {"windowMillis": 1000, "sink": table("rollups")}} | more)


class Feed:
    """A folder of Parquet files as the stream, and what the job has written so far."""

    def __init__(self, spark, tmp_path):
        self.spark, self.tmp_path, self.sent = spark, tmp_path, 0
        (tmp_path / "in").mkdir()
        self.raw = readers.files(spark, str(tmp_path / "in"), streaming=True)

    def send(self, records):
        self.sent += 1
        rows_of(self.spark, records).coalesce(1).write.parquet(f"{self.tmp_path}/sent-{self.sent}")
        next((self.tmp_path / f"sent-{self.sent}").glob("*.parquet")).rename(self.tmp_path / "in" / f"{self.sent}.parquet")

    def read(self, name):
        try:
            return [json.loads(r.value) for r in self.spark.read.parquet(f"{self.tmp_path}/{name}").collect()]
        except Exception:  # noqa: BLE001 - nothing written yet
            return []

    def until(self, name, test, most=90):
        end = time.time() + most
        while time.time() < end:
            if test(found := self.read(name)):
                return found
            time.sleep(0.5)
        raise AssertionError(f"{name}: {self.read(name)}")


def test_job_with_rollups_from_a_fresh_folder(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    queries = engine.run_job(feed.raw, job(tmp_path), str(tmp_path / "job"), rollup_delay_millis=0)
    try:
        feed.send([(e, "t", {"guid": str(g), "v": 1}, 1) for g in range(8) for e in ("MAIN", "LOAD")] + [("MAIN", "t", {"guid": "x", "v": 1}, 1), ("LOAD", "t", b"{", 1)])
        feed.until("results", lambda f: len(f) == 9)
        time.sleep(1.5)
        feed.send([("MAIN", "t", {"guid": "later", "v": 1}, 1)])  # moves the watermark on
        found = feed.until("rollups", lambda f: sum(r["count"] for r in f) >= 9)
        assert sum(r["count"] for r in found if r["status"] == "EQUAL") == 8 and {r["windowEndMillis"] - r["windowStartMillis"] for r in found} == {1000}
        samples = [g for r in found if r["status"] == "EQUAL" for g in r["sampleGuids"]]
        assert len(samples) == len(set(samples)) >= 5 and all(len(r["sampleGuids"]) <= 5 for r in found)
        assert all(openapi.faults(r, openapi.ref("Rollup")) == [] for r in found)
        assert [(r["env"], r["topic"]) for r in feed.read("dead")] == [("LOAD", "t")]
        assert len(queries) == 2  # verdicts, dead letters and partial roll-ups come from one
    finally:
        for q in queries:
            q.stop()


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    rows = [(f"g{i}", "t", "DIFF", "ERROR", "s1", ["v: value-changed"], i) for i in range(20)]
    df = spark.createDataFrame(rows, "guid string, topic string, status string, severity string, signature_id string, signature array<string>, decided_at_millis long")
    folder = f"{tmp_path}/parts"
    source = engine.rollup_parts(spark, folder)  # made if it lacks
    assert engine.write_once(ru.partial_rollups(df, 1000), folder, 3)
    files = sorted(p.name for p in (tmp_path / "parts").rglob("*.parquet"))
    assert not engine.write_once(ru.partial_rollups(df, 1000), folder, 3)
    assert files == sorted(p.name for p in (tmp_path / "parts").rglob("*.parquet"))
    engine.write_once(ru.partial_rollups(df.withColumn("guid", F.concat(F.lit("a"), "guid")).withColumn("decided_at_millis", F.col("decided_at_millis") + 990), 1000), folder, 4)
    query = engine.merged_rollups(source, 1000, 0).writeStream.outputMode("complete").format("memory").queryName("merged").trigger(availableNow=True).start()
    query.awaitTermination(90)
    got = {r.window_start_millis: (r["count"], r.sample_guids, r.severity) for r in spark.table("merged").collect()}
    assert got == {0: (30, ["g0", "g1", "g2", "g3", "g4"], "ERROR"), 1000: (10, ["ag10", "ag11", "ag12", "ag13", "ag14"], "ERROR")}
    assert spark.read.schema(engine.PARTS).option("recursiveFileLookup", "true").parquet(folder).schema == engine.PARTS


def test_state_ends_after_its_time_to_live(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    queries = engine.run_job(feed.raw, job(tmp_path, stateTtlMillis=15000, rollups=None), str(tmp_path / "job"))
    try:
        feed.send([("MAIN", "q", {"guid": "1", "s": 1, "v": 1}, 1), ("LOAD", "q", {"guid": "1", "s": 1, "v": 1}, 1)])
        feed.until("results", lambda f: len(f) == 1)
        feed.send([("MAIN", "q", {"guid": "1", "s": 10, "v": 2}, 5), ("MAIN", "q", {"guid": "1", "s": 9, "v": 3}, 5)])
        second = feed.until("results", lambda f: len(f) == 2)
        assert sorted((v["status"], v["revision"], v["stats"]["mainMessages"]) for v in second) == [("DIFF", 2, 3), ("EQUAL", 1, 1)]
        time.sleep(19)
        feed.send([("LOAD", "q", {"guid": "1", "s": 1, "v": 1}, 1)])
        third = feed.until("results", lambda f: len(f) == 3)
        assert [(v["status"], v["revision"], v["stats"]["mainMessages"]) for v in third if v not in second] == [("EXTRA_IN_LOAD", 1, 0)]
    finally:
        for q in queries:
            q.stop()


def test_arrivals_of_any_type_are_ordered():
    order = engine.arrival_order
    assert order({"a": 1, "b": {"c": 2}}) < order({"a": 1, "b": {"c": 3}}) and order((1, None)) < order((1, 0)) and order(3) < order(4)


# ---- control ----------------------------------------------------------------------------------------------------


def topic(name):
    return {"topics": [{"name": name, "format": "json", "guidPath": "g"}]}


def names(resolver):
    return set(resolver().topics)


def test_control_messages_need_no_clock(tmp_path, monkeypatch):
    folder = str(tmp_path / "control")
    resolvers = [Resolver(json.dumps(topic(b)), folder, 0.0) for b in ("one", "other")]
    assert [names(r) for r in resolvers] == [{"one"}, {"other"}]  # two jobs on one folder keep their own bootstrap
    publish(folder, topic("two"))
    monkeypatch.setattr(time, "time_ns", lambda: 0)  # a publisher whose clock is behind
    publish(folder, topic("three"))
    assert [names(r) for r in resolvers] == [{"three"}] * 2
    (tmp_path / "control" / "00000000000000000000-late.json").write_text(json.dumps({"type": "compare-config", "compare": topic("four")}))
    (tmp_path / "control" / "00000000000000000009-bad.json").write_text('{"type":"compare-config","compare":{"topics":[]}}')
    assert [names(r) for r in resolvers] == [{"three"}] * 2  # older versions and invalid ones change nothing


def test_relayed_messages(spark, tmp_path):
    folder = str(tmp_path / "control")
    message = lambda c: json.dumps({"type": "compare-config", "compare": c})
    rows = spark.createDataFrame([(message(topic("a")).encode(), 0, 7), (message(topic("b")).encode(), 0, 8), (b"{", 0, 9), (None, 0, 10)], "value binary, partition int, offset long")
    assert relay(rows, folder) == 4 and relay(rows, folder) == 4
    assert len(list((tmp_path / "control").glob("*.json"))) == 4
    control = FolderControl(folder, json.dumps(topic("b")))
    assert control.active() == (json.dumps(topic("b")), "control")  # though it equals the bootstrap config
    control.apply(topic("c"))
    assert json.loads(control.active()[0]) == topic("c")
    with pytest.raises(ValueError):
        control.apply({"topics": []})
    if not readers.has_kafka(spark):
        for call in (lambda c: KafkaControl(spark, c), lambda c: readers.control_stream(spark, c), lambda c: engine.run_config(spark, json.loads(job_text(tmp_path)), str(tmp_path))):
            with pytest.raises(RuntimeError, match="spark-sql-kafka"):
                call(job(tmp_path).control)
    assert readers.control_options(job(tmp_path).control) == {"kafka.bootstrap.servers": "h", "subscribe": "c", "startingOffsets": "earliest"}


def job_text(tmp_path):
    servers = {"bootstrapServers": "h"}
    return json.dumps({"compare": BASE, "main": servers, "load": servers, "control": servers | {"topic": "c"}, "results": {"type": "logging"}})


def test_all_clusters_are_one_source(spark, monkeypatch):
    """Both environments' clusters, each with its own topics, and logical names for physical ones."""
    servers = lambda *names: {"clusters": [{"bootstrapServers": n, "topics": [t], "topicPrefix": f"{n}."} for n, t in names]}
    config = load_job({"compare": BASE, "main": servers(("m1", "t"), ("m2", "q")), "load": {"bootstrapServers": "l", "topicOverrides": {"t": "other"}}, "control": {"bootstrapServers": "h", "topic": "c"}, "results": {"type": "logging"}})

    def fake(session, cluster, env, streaming=True):
        rows = [(p, b"k", b"v", 1, 0, 7) for p in sorted(cluster.logical())]
        return readers.tagged(session.createDataFrame(rows, "topic string, key binary, value binary, ts_millis long, partition int, offset long"), env, cluster.logical())

    monkeypatch.setattr(readers, "kafka", fake)
    found = readers.job_source(spark, config, streaming=False)
    assert sorted((r.env, r.topic) for r in found.collect()) == [("LOAD", "q"), ("LOAD", "t"), ("MAIN", "q"), ("MAIN", "t")]
    assert found.columns == ["env", "topic", "key", "value", "ts_millis", "partition", "offset"]


# ---- plug-ins ---------------------------------------------------------------------------------------------------


def lines_decoder(payload, _topic):
    return dict(x.split("=", 1) for x in bytes(payload).decode().split(";"))


def first_only(main, load, rules):
    return [FieldDiff("whole", "whole", "value-changed", "m", "l")]


def upper(tree, rules):
    return {k: v.upper() if isinstance(v, str) else v for k, v in normalise(tree, rules).items()}


class ShortCodec(codec.Codec):
    def verdicts(self, found, emit_equal=True):
        return found.select(F.col("guid").alias("key"), F.to_json(F.struct("status", F.size("diffs").alias("n"))).alias("value"))


def plugins():
    types = RuleTypes.standard().register("double", lambda m, _: Rule(m, lambda n: n + n if isinstance(n, str) else n))
    return Plugins(DecoderRegistry.standard().register("lines", lines_decoder), types, codec=ShortCodec(), differ=first_only, normaliser=upper)


def test_plugins_in_batch(spark):
    own = plugins()
    config = own.load_compare({"policy": {"cohortMode": "ASSUME_ALL"}, "ruleSets": {"default": {"rules": [{"type": "double", "path": "v"}]}}, "topics": [{"name": "t", "format": "lines", "guidPath": "guid"}]})
    raw = rows_of(spark, [("MAIN", "t", b"guid=1;v=a", 1), ("LOAD", "t", b"guid=1;v=b", 1), ("MAIN", "t", b"guid=2;v=a", 1), ("LOAD", "t", b"guid=2;v=A", 1)])
    seen = observe(raw, config, own.decoders, own.normaliser)
    assert {r.state_json for r in seen.collect()} == {'{"guid":"1","v":"AA"}', '{"guid":"1","v":"BB"}', '{"guid":"2","v":"AA"}'}
    found = {v.guid: (v.status, [d.path for d in v.diffs]) for v in ve.verdicts(seen, config, differ=own.differ).collect()}
    assert found == {"1": ("DIFF", ["whole"]), "2": ("EQUAL", [])}


def test_plugins_in_a_stream(spark, tmp_path):
    own, feed = plugins(), Feed(spark, tmp_path)
    base = {"policy": BASE["policy"], "ruleSets": {"default": {"rules": [{"type": "double", "path": "v"}]}}, "topics": [{"name": "t", "format": "lines", "guidPath": "guid"}]}
    servers = {"bootstrapServers": "h"}
    config = own.load_job({"compare": base, "main": servers, "load": servers, "control": servers | {"topic": "c"}, "results": {"type": "table", "options": {"path": f"{tmp_path}/results"}}})
    queries = engine.run_job(feed.raw, config, str(tmp_path / "job"), plugins=own)
    try:
        feed.send([("MAIN", "t", b"guid=1;v=a", 1), ("LOAD", "t", b"guid=1;v=b", 1)])
        assert feed.until("results", lambda f: len(f) == 1) == [{"status": "DIFF", "n": 1}]
    finally:
        for q in queries:
            q.stop()


# ---- the contract -----------------------------------------------------------------------------------------------


def test_findings_keep_the_contract(spark):
    config = compare("ENTRY_TOPICS")
    values = {f"k{i:03d}": "a" * 3000 for i in range(120)}
    raw = rows_of(spark, [("MAIN", "in", {"guid": "g"}, 1), ("LOAD", "in", {"guid": "g"}, 1), ("MAIN", "t", {"guid": "g"} | values, 1), ("LOAD", "t", {"guid": "g", "n": [1]}, 1), ("MAIN", "t", {"guid": "u"}, 1), ("MAIN", "in", {"guid": "m"}, 1), ("MAIN", "t", b"\xff", 1)])
    seen = observe(raw, config)
    verdicts = ve.verdicts(seen, config, 5)
    found = {v["guid"]: v for v in (json.loads(r.value) for r in codec.keyed_verdicts(verdicts).collect())}
    assert {g: v["status"] for g, v in found.items()} == {"g": "DIFF", "u": "UNANCHORED", "m": "NOT_MIRRORED"} and found["g"]["diffsTruncated"]
    (letter,) = [json.loads(r.value) for r in codec.keyed_dead_letters(dead_letters(seen)).collect()]
    rolled = [json.loads(r.value) for r in codec.keyed_rollups(ru.rollups(verdicts)).collect()]
    values = [(v, "Verdict") for v in found.values()] + [(letter, "DeadLetter")] + [(r, "Rollup") for r in rolled]
    assert [openapi.faults(v, openapi.ref(name)) for v, name in values] == [[]] * len(values)
    assert openapi.faults({"type": "verdict", "odd": 1}, openapi.ref("Verdict"))[-1] == "$: odd is unknown"
    assert openapi.faults([True], {"type": "array", "items": openapi.WHOLE}) == ["$[0]: no integer"]


def test_routes_keep_the_contract(spark, tmp_path):
    values = [("g|t", json.dumps({"type": "verdict", "guid": "g", "topic": "t", "status": "EQUAL", "severity": "OK", "revision": 1, "decidedAtMillis": 1, "stats": {k: 0 for k in openapi.SCHEMAS["Verdict"]["properties"]["stats"]["properties"]}}))]
    for kind in ("verdict", "rollup", "dead-letter"):
        spark.createDataFrame(values if kind == "verdict" else [], "key string, value string").write.parquet(f"{tmp_path}/{kind}")
    store = TableStore(spark, {k: f"{tmp_path}/{k}" for k in ("verdict", "rollup", "dead-letter")})
    api = http_api.Api(store, FolderControl(f"{tmp_path}/control"))
    document = openapi.document()
    assert set(document["components"]["schemas"]) >= {"Verdict", "Rollup", "DeadLetter"} and {f"{m.upper()} {p}" for p, ms in document["paths"].items() for m in ms} == set(openapi.OPERATIONS)
    assert set(api.routes) == set(openapi.OPERATIONS) | {"GET /openapi.yaml", "GET /docs"}
    for route, (_, schema, takes_config, _) in openapi.OPERATIONS.items():
        method, path = route.split()
        status, value = api.answer(method, path, json.dumps(topic("x")).encode() if takes_config else b"")
        assert status == 200 and openapi.faults(value, schema) == [], route
    status, value = api.answer("POST", "/api/config/apply", b"[]")
    assert status == 400 and openapi.faults(value, openapi.ref("Error")) == []
    server = http_api.serve(api, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        get = lambda path: urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}", timeout=30)
        with get("/openapi.yaml") as answer:
            assert answer.headers["Content-Type"] == "application/yaml" and json.load(answer) == document
        with get("/docs") as answer:
            assert answer.headers["Content-Type"].startswith("text/html") and b"/api/verdicts" in answer.read()
    finally:
        server.shutdown()


def test_findings_stores(spark):
    """The search that the Elasticsearch store asks for, and the tail of a topic, without either system."""
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from tandem.plans.config import ApiConfig, Endpoint
    from tandem.sources.findings import ElasticsearchStore, KafkaStore, StoreRegistry

    asked = []

    class Stub(BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((self.path, self.headers["Authorization"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            body = json.dumps({"hits": {"total": {"value": 3}, "hits": [{"_source": {"guid": "g"}}]}, "aggregations": {"status": {"buckets": [{"key": "DIFF", "doc_count": 3}]}}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    end = Endpoint("c", "h", {})
    config = lambda kind, **options: ApiConfig(0, end, end, end, None, None, 3, "latest", kind, options)
    registry = StoreRegistry.standard()
    store = registry.create(spark, config("Elasticsearch", url=f"http://127.0.0.1:{server.server_port}/", index="i", username="u", password="p"))
    assert store.values("rollup", "t", 7) == [{"guid": "g"}] and store.counts() == (3, {"DIFF": 3})
    server.shutdown()
    assert [a[:2] for a in asked] == [("/i/_search", "Basic dTpw")] * 2
    assert asked[0][2] == {"size": 7, "sort": [{"windowStartMillis": {"order": "desc"}}], "query": {"bool": {"filter": [{"term": {"type.keyword": "rollup"}}, {"term": {"topic.keyword": "t"}}]}}}
    assert asked[1][2]["size"] == 0 and asked[1][2]["query"] == {"bool": {"filter": [{"term": {"type.keyword": "verdict"}}]}}
    with pytest.raises(ValueError, match="url"):
        ElasticsearchStore({})
    if not readers.has_kafka(spark):
        with pytest.raises(RuntimeError, match="spark-sql-kafka"):
            registry.create(spark, config("kafka-tail"))

    class Tail(KafkaStore):
        def __init__(self):
            self.spark, self.tail, self.endpoints = spark, 3, {"verdict": end}

        def records(self, kind):
            if not self.endpoints.get(kind):
                return super().records(kind)
            rows = [("k", json.dumps({"type": "verdict", "topic": "t", "status": s, "decidedAtMillis": i}), i // 2, 0, i) for i, s in enumerate(["EQUAL", "DIFF", "DIFF", "EQUAL"])] + [("k", "no json", 9, 0, 9)]
            return spark.createDataFrame(rows, "key string, value string, timestamp long, partition int, offset long")

    assert [v["decidedAtMillis"] for v in Tail().values("verdict")] == [3, 2, 1] and Tail().counts("t") == (3, {"DIFF": 2, "EQUAL": 1}) and Tail().values("rollup") == []


def test_flat_records_equal_the_decoder_in_python(spark):
    """Column expressions against the decoder, on texts that are flat, nearly flat and broken."""
    import random

    r = random.Random(4)
    rules = {"a": {"rules": [{"type": "ignore", "path": "**.drop"}, {"type": "mask", "path": "m"}, {"type": "cast", "path": "c", "to": "NUMBER"}, {"type": "cast", "path": "**.d", "to": "BOOLEAN"}, {"type": "unordered", "path": "*"}]}, "b": {"nullsEqualAbsent": False, "rules": [{"type": "mask", "path": "*"}]}}
    each = {"format": "json", "guidPath": "g"}
    config = load_compare({"ruleSets": rules, "topics": [each | {"name": "t", "sequencePath": ["s"], "ruleSet": "a"}, each | {"name": "b", "role": "BOTH", "ruleSet": "b"}, each | {"name": "e", "role": "ENTRY"}, each | {"name": "n", "guidPath": "g.x"}]})
    values = ["1", "-0", "0.00", "-0.50", "12.340", "1e3", '"a"', '" 12.50 "', '"-007.10"', '".5"', '"5."', '"1e3"', '"TRUE"', '"fAlse "', "null", "true", '"é漢"', '"😀"', '"\\u0041"', '"\\ud800"', '"x\\n"', '{"z":1}', "[1,null]", "1" * 40 + ".10", '"+.0"', '"."', '""', "01", "NaN", '"a,b}:{"', '"-"']
    space = lambda: r.choice(["", "", " ", "\n\t"])
    rows = []
    for i in range(3000):
        keys = r.sample(["g", "s", "drop", "m", "c", "d", "z", "ä", "a b", "x"], r.randint(1, 9)) + ["g"] * (r.random() < 0.05)
        pairs = [f'{space()}"{k}"{space()}:{space()}{r.choice(values) if k not in "gs" or r.random() < 0.2 else r.choice(["1", "2.50", chr(34) + "q" + chr(34)])}{space()}' for k in keys]
        payload = (space() + "{" + ",".join(pairs) + "}" + r.choice(["", "", "", " x", '{"g":1}'])).encode()
        payload = payload.replace(b"a", b"\xff") if r.random() < 0.03 else b"\xef\xbb\xbf" + payload if r.random() < 0.02 else payload
        rows.append(("MAIN", r.choice("tben"), payload, i))
    raw = rows_of(spark, rows)
    fast, plain = (sorted(map(repr, observe(raw, config, native=n).collect())) for n in (True, False))
    assert fast == plain and len(fast) > 3000
