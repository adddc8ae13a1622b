"""State machine scenarios, the batch engine against it, queries against SQL, the stream, sinks and the API."""

import json
import random
import threading
import time
import urllib.request
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tandem.functions import codec
from tandem.functions import statemachine as sm
from tandem.operators import rollups as ru
from tandem.operators import verdicts as ve
from tandem.operators.observe import RAW, dead_letters, observe
from tandem.plans import catalog
from tandem.plans.config import ApiConfig, ClusterConfig, Endpoint, SinkConfig, load_compare, load_job
from tandem.sources import readers
from tandem.sources.findings import StoreRegistry, TableStore
from tandem.sources.sinks import SinkRegistry
from tandem.streaming import api as http_api
from tandem.streaming.control import FolderControl, Resolver, publish
from tandem.streaming.engine import run_job
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"


def compare(mode="ASSUME_ALL", **topic):
    rules = {"default": {"rules": [{"type": "numberTolerance", "path": "v", "epsilon": 1}]}}
    topics = [{"name": "t", "format": "json", "guidPath": "guid"} | topic, {"name": "in", "format": "json", "guidPath": "guid", "role": "ENTRY"}]
    return load_compare({"policy": {"cohortMode": mode, "quietMillis": 1000, "maxWaitMillis": 10000}, "ruleSets": rules, "topics": topics})


def fold(messages, config, guid="g"):
    state = sm.Document()
    for env, kind, sequence, value, ts in messages:
        text = None if value is None else json.dumps({"v": value})
        sm.observe(state, env, "t" if kind == "OUTPUT" else "in", kind, sequence, text and str(hash(text)), text, ts)
    return state, sm.decide(guid, state, config, 99)


def out(env, value, sequence=None, ts=1):
    return env, "OUTPUT", sequence, value, ts


@pytest.mark.parametrize("messages, status, severity", [
    ([out("MAIN", 1), out("LOAD", 1)], "EQUAL", "OK"), ([out("MAIN", 1)], "MISSING_IN_LOAD", "ERROR"), ([out("LOAD", 1)], "EXTRA_IN_LOAD", "WARN"), ([out("MAIN", 1), out("LOAD", 5)], "DIFF", "ERROR"),
    ([out("MAIN", 1), out("LOAD", 2)], "EQUAL_DIVERGED", "INFO"), ([out("MAIN", 1), out("MAIN", 9), out("LOAD", 9)], "EQUAL_DIVERGED", "INFO"), ([out("MAIN", 1), out("MAIN", 9), out("LOAD", 1), out("LOAD", 9), out("LOAD", 9)], "EQUAL", "OK"),
    ([out("MAIN", 1, "1"), out("LOAD", 2, "1")], "EQUAL", "OK"), ([out("MAIN", 1, "1"), out("MAIN", 5, "2"), out("LOAD", 5, "2")], "EQUAL_DIVERGED", "INFO"),
    ([out("MAIN", 1, "2"), out("MAIN", 5, "10"), out("LOAD", 5, "10"), out("LOAD", 9, "2")], "EQUAL_DIVERGED", "INFO"),
])
def test_statuses(messages, status, severity):
    _, (v,) = fold(messages, compare())
    assert (v["status"], v["severity"]) == (status, severity)


def test_first_final_state_is_the_last_that_was_new():
    state, _ = fold([out("MAIN", 1), out("MAIN", 2), out("MAIN", 1)], compare())
    line = state.lines["t", "MAIN"]
    assert json.loads(sm.final(line)[1]) == {"v": 2} and line.duplicates == 1 and len(line.states) == 2


def test_late_states_of_a_sequence_are_dropped():
    state, _ = fold([out("MAIN", 1, "1", 1), out("MAIN", 1, "1", 5), out("MAIN", 2, "1", 3), out("MAIN", 7, "1", 2)], compare())
    line = state.lines["t", "MAIN"]
    assert json.loads(line.versions["1"].json) == {"v": 2} and line.duplicates == 1 and line.messages == 4


@pytest.mark.parametrize("order", [["9.5", "10.5"], ["10.5", "9.5"], ["99999999999999999999", "100000000000000000000"], ["-2", "-1.5", "0", "0.25", "0.3"], ["2", "10", "1a"], ["a", "b"], ["1", "1.0"], ["1e3", "999"]])
def test_final_sequence_by_default(spark, order):
    """Whatever the spelling of sequences, batch verdicts are those of the state machine, without a switch."""
    config = compare(sequencePath="s")
    for last in (order[-1], order[0]):
        messages = [(env, "t", {"guid": "g", "s": s, "v": 9 if s == last and env == "LOAD" else 1}, 1) for s in order for env in ("MAIN", "LOAD")]
        raw = rows_of(spark, messages).withColumn("arrival", F.col("offset"))
        seen = observe(raw, config)
        doc = sm.Document()
        for o in sorted(seen.collect(), key=lambda o: o.arrival):
            sm.observe(doc, o.env, o.topic, o.kind, o.sequence, o.state_hash, o.state_json, o.ts_millis)
        (want,) = sm.decide("g", doc, config, 0)
        (got,) = ve.verdicts(seen, config).collect()
        assert (got.status, got.severity, got.stats.asDict()) == (want["status"], want["severity"], want["stats"])
        assert [d.path for d in got.diffs] == [d.path for d in want["diffs"]]


def test_cohort():
    entry = lambda env: (env, "ENTRY", None, None, 1)
    config = compare("ENTRY_TOPICS")
    both = [out("MAIN", 1), out("LOAD", 1)]
    names = lambda messages: [v["status"] for v in fold(messages, config)[1]]
    assert names([entry("MAIN"), entry("LOAD"), *both]) == ["EQUAL"] and names([entry("MAIN"), *both]) == ["NOT_MIRRORED"] and names([entry("LOAD"), *both]) == ["TEST_TRAFFIC"]
    assert names(both) == ["UNANCHORED"] and names([entry("MAIN"), entry("LOAD")]) == []


def test_revisions_and_decision_time():
    state, _ = fold([out("MAIN", 1), out("LOAD", 1, ts=500)], compare())
    assert sm.decide("g", state, compare(), 1)[0]["revision"] == 2
    assert sm.decision_time(state, compare().policy) == 1500 and sm.decision_time(sm.Document(), compare().policy) == -1


def rows_of(spark, records):
    return spark.createDataFrame([(e, t, None, json.dumps(p).encode() if not isinstance(p, bytes) else p, ts, 0, i) for i, (e, t, p, ts) in enumerate(records)], RAW)


@pytest.mark.parametrize("mode", ["ASSUME_ALL", "ENTRY_TOPICS"])
@pytest.mark.parametrize("sequenced", [False, True])
def test_batch_equals_state_machine(spark, mode, sequenced):
    r = random.Random(5)
    config = compare(mode, **({"sequencePath": "s"} if sequenced else {}))
    records = []
    for i in range(600):
        guid, env = f"g{r.randrange(40)}", r.choice(["MAIN", "LOAD"])
        odd = sequenced and guid in ("g1", "g2")
        p = {"guid": guid, "v": r.choice([1, 2, 5, "x"]), "s": r.choice(["2", "10", "1a", "2.0"]) if odd else r.randrange(4)}
        if sequenced:
            p["w"] = r.randrange(2)
        records.append((env, "t", p, r.randrange(20)))
        if r.random() < 0.05:
            records.append((env, "in", {"guid": f"g{r.randrange(44)}"}, 3))
    raw = rows_of(spark, records).withColumn("arrival", F.col("offset"))
    seen = observe(raw, config)
    got = {(v.guid, v.topic): v for v in ve.verdicts(seen, config, 99).collect()}
    states = {}
    for o in sorted(seen.collect(), key=lambda o: o.arrival):
        sm.observe(states.setdefault(o.guid, sm.Document()), o.env, o.topic, o.kind, o.sequence, o.state_hash, o.state_json, o.ts_millis)
    want = {(v["guid"], v["topic"]): v for g, s in states.items() for v in sm.decide(g, s, config, 99)}
    assert set(got) == set(want)
    for k, w in want.items():
        g = got[k]
        assert (g.status, g.severity, g.signature_id, g.signature, g.revision) == (w["status"], w["severity"], w["signature_id"], w["signature"], 1), k
        assert g.stats.asDict() == w["stats"], k
        assert [tuple(d) for d in g.diffs] == [tuple(vars(d).values()) for d in w["diffs"]], k


def test_observe_roles_and_dead_letters(spark):
    config = load_compare({"topics": [{"name": "b", "format": "json", "guidPath": "g", "role": "BOTH", "sequencePath": "s"}, {"name": "x", "format": "nope", "guidPath": "g"}]})
    raw = rows_of(spark, [("MAIN", "b", {"g": 1.50, "s": True}, 1), ("MAIN", "b", {"g": 1}, 2), ("LOAD", "x", {"g": 1}, 3), ("LOAD", "unknown", {"g": 1}, 4), ("MAIN", "b", {"g": {}}, 5), ("MAIN", "b", b"", 6)])
    seen = observe(raw, config)
    assert sorted((r.kind, r.guid, r.sequence) for r in seen.filter("error is null").collect()) == [("ENTRY", "1.5", None), ("OUTPUT", "1.5", "true")]
    letters = {r.ts_millis: r.error for r in dead_letters(seen).collect()}
    assert sorted(letters) == [2, 3, 5, 6] and letters[2] == "no sequence at 's' in message on topic b" and "no decoder" in letters[3]
    keyed = codec.keyed_dead_letters(dead_letters(seen)).filter("key = 'LOAD|x'").first()
    assert json.loads(keyed.value)["payloadPreview"] == '{"g": 1}'
    assert observe(raw.limit(0), config).collect() == []


def test_codec_limits(spark):
    config = compare()
    values = {f"k{i:03d}": "a" * 3000 for i in range(120)}
    raw = rows_of(spark, [("MAIN", "t", {"guid": "g"} | values, 1), ("LOAD", "t", {"guid": "g"}, 1)])
    found = json.loads(codec.keyed_verdicts(ve.verdicts(observe(raw, config), config)).first().value)
    assert len(found["diffs"]) == 100 and found["diffsTruncated"] is True and found["diffs"][0]["main"].endswith("…(truncated)") and len(found["diffs"][0]["main"]) == 2000 + 12 and "load" not in found["diffs"][0]
    same = codec.keyed_verdicts(ve.verdicts(observe(rows_of(spark, [("MAIN", "t", {"guid": "g"}, 1), ("LOAD", "t", {"guid": "g"}, 1)]), config), config))
    assert set(json.loads(same.first().value)) == {"type", "guid", "topic", "status", "severity", "revision", "decidedAtMillis", "stats"} and same.first().key == "g|t"


def test_rollup_samples_are_distinct_and_first(spark):
    rows = [(f"g{i % 7}", "t", "DIFF", "ERROR", "s1", ["v: value-changed"], i) for i in range(20)]
    df = spark.createDataFrame(rows, "guid string, topic string, status string, severity string, signature_id string, signature array<string>, decided_at_millis long")
    (r,) = ru.rollups(df, 1000).collect()
    assert (r["count"], r.sample_guids, r.window_end_millis) == (20, ["g0", "g1", "g2", "g3", "g4"], 1000)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_match_sql(spark, name):
    assert differences(catalog.queries()[name](spark, SF), connect(SF), catalog.oracle_sql()[name]) == []


def test_topic_mapping_and_kafka_gate(spark):
    df = spark.createDataFrame([("load.orders", 42, b"{}"), ("other", 1, b"")], "topic string, ts_millis long, value binary").withColumns({"key": F.lit(None).cast("binary"), "partition": F.lit(0), "offset": F.lit(1)})
    assert [r.topic for r in readers.tagged(df, "LOAD", {"load.orders": "orders"}).collect()] == ["orders", "other"]
    cluster = ClusterConfig("c", "h:1", "g", ("a",), "p.", properties={"x": "y"})
    assert readers.kafka_options(cluster, True)["kafka.x"] == "y" and readers.kafka_options(cluster, True)["subscribe"] == "p.a"
    if not readers.has_kafka(spark):
        with pytest.raises(RuntimeError, match="spark-sql-kafka"):
            readers.kafka(spark, cluster, "MAIN")


def test_active_control(spark):
    messages = spark.createDataFrame([('{"type":"compare-config","compare":{"a":1}}', 0, 1), ('{"type":"x","compare":{"a":2}}', 0, 2), ("bad", 0, 3)], "value string, partition int, offset long")
    assert readers.active_control(messages) == ('{"a":1}', "control") and readers.active_control(messages.limit(0), "b") == ("b", "bootstrap") and readers.active_control(messages.limit(0)) == (None, "none")


def test_sinks(spark, tmp_path):
    seen = []

    class Stub(BaseHTTPRequestHandler):
        def do_PUT(self):
            seen.append((self.path, self.headers["Authorization"], self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(201)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rows = spark.createDataFrame([("g|t", "{}")], "key string, value string")
    registry = SinkRegistry.standard()
    registry.create(SinkConfig("ElasticSearch", {"url": f"http://127.0.0.1:{server.server_port}", "index": "i", "apiKey": "k"}))(rows)
    server.shutdown()
    assert seen == [("/i/_doc/g%7Ct", "ApiKey k", b"{}")]
    registry.create(SinkConfig("logging"))(rows)
    registry.create(SinkConfig("table", {"path": f"{tmp_path}/t"}))(rows)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1
    for bad in (SinkConfig("nope"), SinkConfig("kafka", {})):
        with pytest.raises(ValueError):
            registry.create(bad)


def test_store_and_api(spark, tmp_path):
    def finding(i, status):
        return (f"g{i}|t", json.dumps({"type": "verdict", "guid": f"g{i}", "topic": "t", "status": status, "decidedAtMillis": i}))

    rows = [finding(i, "EQUAL") for i in range(6)] + [("g5|t", json.dumps({"type": "verdict", "topic": "t", "status": "DIFF", "decidedAtMillis": 50})), ("x", "no json")]
    spark.createDataFrame(rows, "key string, value string").write.parquet(f"{tmp_path}/verdict")
    end = Endpoint("c", "h", {})
    config = ApiConfig(0, end, end, end, None, None, 3, "latest", "kafka-tail", {"path": str(tmp_path)})
    tail = StoreRegistry.standard().create(spark, config)
    assert {r["status"]: r["count"] for r in tail.summary().collect()} == {"DIFF": 1, "EQUAL": 2}
    latest = TableStore(spark, {"verdict": f"{tmp_path}/verdict"}, None, latest=True)
    assert {r["status"]: r["count"] for r in latest.summary(limit=None).collect()} == {"DIFF": 1, "EQUAL": 5}
    server = http_api.serve(http_api.Api(tail, FolderControl(f"{tmp_path}/control")), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(path, body=None):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", None if body is None else json.dumps(body).encode())
        try:
            with urllib.request.urlopen(request, timeout=60) as answer:
                return answer.status, json.load(answer)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert call("/api/health") == (200, {"ok": True}) and call("/nope")[0] == 404
    assert [v["decidedAtMillis"] for v in call("/api/verdicts?topic=t&limit=2")[1]] == [50, 5]
    assert call("/api/summary")[1] == {"total": 3, "counts": {"DIFF": 1, "EQUAL": 2}}
    assert call("/api/config/active")[1]["source"] == "none" and call("/api/config/validate", {"topics": []})[1]["valid"] is False
    good = {"topics": [{"name": "t", "format": "json", "guidPath": "guid"}]}
    assert call("/api/config/apply", good) == (200, {"applied": True}) and call("/api/config/apply", {"topics": []})[0] == 400
    assert call("/api/config/active")[1] == {"active": good, "source": "control"} and len(call("/api/rule-types")[1]) == 6
    server.shutdown()


def test_invalid_control_messages_are_ignored(tmp_path):
    one = {"topics": [{"name": "one", "format": "json", "guidPath": "g"}]}
    two = {"topics": [{"name": "two", "format": "json", "guidPath": "g"}]}
    resolver = Resolver(json.dumps(one), str(tmp_path), 0.0)
    assert set(resolver().topics) == {"one"}
    publish(str(tmp_path), two)
    (tmp_path / "99999999999999999999-x.json").write_text('{"type":"compare-config","compare":{"topics":[]}}')
    assert set(resolver().topics) == {"two"}
    with pytest.raises(ValueError):
        publish(str(tmp_path), {"topics": []})


def test_stream(spark, tmp_path):
    """Documents are decided once quiet, late messages decide anew, rules change while the stream runs."""
    base = {"policy": {"cohortMode": "ASSUME_ALL", "quietMillis": 1500, "maxWaitMillis": 600000}, "topics": [{"name": "t", "format": "json", "guidPath": "guid"}]}
    servers = {"bootstrapServers": "h"}
    job = load_job({"compare": base, "main": servers, "load": servers, "control": servers | {"topic": "c"}, "results": {"type": "table", "options": {"path": f"{tmp_path}/results"}}, "deadLetters": {"type": "table", "options": {"path": f"{tmp_path}/dead"}}})
    incoming, control = tmp_path / "in", f"{tmp_path}/control"
    incoming.mkdir()

    def send(name, records):
        rows_of(spark, records).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        next((tmp_path / name).glob("*.parquet")).rename(incoming / f"{name}.parquet")

    def results(until, most=60):
        end = time.time() + most
        while time.time() < end:
            try:
                found = sorted(((v := json.loads(r.value))["guid"], v["status"], v["revision"]) for r in spark.read.parquet(f"{tmp_path}/results").collect())
                if until(found):
                    return found
            except Exception:  # noqa: BLE001 - nothing written yet
                pass
            time.sleep(0.5)
        raise AssertionError("no such results in time")

    raw = readers.files(spark, str(incoming), streaming=True)
    queries = run_job(raw, job, str(tmp_path / "job"), control)
    try:
        send("a", [("MAIN", "t", {"guid": "1", "v": 1}, 1), ("LOAD", "t", {"guid": "1", "v": 1}, 2), ("MAIN", "t", {"guid": "2", "v": 1}, 1), ("LOAD", "t", b"{", 1)])
        assert results(lambda f: len(f) == 2) == [("1", "EQUAL", 1), ("2", "MISSING_IN_LOAD", 1)]
        publish(control, base | {"ruleSets": {"default": {"rules": [{"type": "ignore", "path": "v"}]}}})
        time.sleep(1.5)
        send("b", [("LOAD", "t", {"guid": "2", "v": 1}, 2), ("MAIN", "t", {"guid": "3", "v": 1}, 1), ("LOAD", "t", {"guid": "3", "v": 2}, 2)])
        found = results(lambda f: len(f) == 4)
        assert ("3", "EQUAL", 1) in found and ("2", "DIFF", 2) in found
        assert spark.read.parquet(f"{tmp_path}/dead").count() == 1
    finally:
        for q in queries:
            q.stop()
