"""Canonical trees, paths, decoders, rules, differ and configs."""

from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tandem.functions import canon, decoders, rules
from tandem.plans import config as cf

RULES = rules.RuleTypes.standard()


def rule_set(*specs, **flags):
    return RULES.rule_set({"rules": list(specs)} | flags)


def normalised(text, *specs, **flags):
    return canon.write(rules.normalise(canon.read(text), rule_set(*specs, **flags)))


def diffs(a, b, *specs):
    return [(d.path, d.kind, d.main, d.load) for d in rules.diff(canon.read(a), canon.read(b), rule_set(*specs))]


@pytest.mark.parametrize("text, want", [("1.000", "1"), ("1e2", "100"), ("-0.0", "0"), ("0.50", "0.5"), ("12345678901234567890123456789012345678901", "12345678901234567890123456789012345678901"), ('"\\b\\u001f\\n\\"é"', '"\\u0008\\u001f\\n\\"é"'), ('{"b":1,"a":[true,null]}', '{"a":[true,null],"b":1}'), ('{"a":1,"a":2} x', '{"a":2}')])
def test_canonical_text(text, want):
    assert canon.write(canon.read(text)) == want


def test_keys_are_sorted_by_utf16_units():
    assert canon.write({"ﬁ": None, "\U0001f600": None}) == '{"\U0001f600":null,"ﬁ":null}'


trees = st.recursive(st.none() | st.booleans() | st.text(max_size=5) | st.decimals(allow_nan=False, allow_infinity=False, places=3, min_value=-10**6, max_value=10**6), lambda t: st.lists(t, max_size=3) | st.dictionaries(st.text(max_size=3), t, max_size=3), max_leaves=8)


@given(trees)
def test_canonical_text_reads_back(tree):
    text = canon.write(tree)
    assert canon.write(canon.read(text)) == text
    assert rules.diff(tree, canon.read(text), rules.EMPTY) == []


def test_hash_is_sha256_of_utf8():
    assert canon.state_hash('{"a":1}') == "015abd7f5cc57a2dd94b7590f04ad8084273905ee33ec5cebeae62276a97f862"


@pytest.mark.parametrize("pattern, path, yes", [
    ("meta.ts", ("meta", "ts"), True), ("items[].id", ("items", 3, "id"), True), ("items[2]", ("items", 2), True), ("items[2]", ("items", 1), False), ("*.id", ("a", "id"), True), ("*.id", (0, "id"), False),
    ("**.t", ("t",), True), ("**.t", ("a", 0, "t"), True), ("a.**.z", ("a", "z"), True), ("a.**.z", ("a", "b", 1, "z"), True), ("a.**", ("a",), True), ("$", (), True), ("$.a", ("a",), True), ("$[0]", (0,), True), (r"a\.b", ("a.b",), True), ("[*]", (7,), True), ("a", ("a", "b"), False),
])
def test_patterns(pattern, path, yes):
    assert canon.Matcher(pattern).matches(path) is yes


@pytest.mark.parametrize("bad", ["a..b", "a.", "a[1", "", "a[x]", "a\\", ".a"])
def test_bad_patterns(bad):
    with pytest.raises(ValueError):
        canon.parse_pattern(bad)


def test_concrete_paths_and_rendering():
    assert canon.parse_path("a.b[2].c") == ("a", "b", 2, "c")
    with pytest.raises(ValueError):
        canon.parse_path("a.*")
    assert canon.render(("a", 2, "b")) == "a[2].b" and canon.render(("a", 2, "b"), True) == "a[].b" and canon.render(()) == "$"
    assert canon.parse_pattern(canon.escaped("a.b[c")) == (("field", "a.b[c"),)


@pytest.mark.parametrize("xml, want", [
    (b'<order id="42">total</order>', '{"order":{"#text":"total","@id":"42"}}'), (b"<o><i>1</i><i>2</i><x> a </x></o>", '{"o":{"i":["1","2"],"x":"a"}}'), (b"<o/>", '{"o":""}'),
    (b"<o>a<!--c--> b</o>", '{"o":"ab"}'), (b"<o><![CDATA[ <x> ]]></o>", '{"o":"<x>"}'), (b"<p:o xmlns:p='u'/>", '{"p:o":{"@xmlns:p":"u"}}'),
])
def test_xml(xml, want):
    assert canon.write(decoders.decode_xml(xml, "t")) == want


@pytest.mark.parametrize("payload", [b"<a>", b"", None, b"<!DOCTYPE a><a/>", b"<!DOCTYPE a [<!ENTITY x 'y'>]><a>&x;</a>"])
def test_bad_xml(payload):
    with pytest.raises(canon.DecodeError):
        decoders.decode_xml(payload, "t")


@pytest.mark.parametrize("payload", [b"", None, b"{", b"NaN", b"\xff"])
def test_bad_json(payload):
    with pytest.raises(canon.DecodeError):
        decoders.decode_json(payload, "t")


def test_registry_ignores_case_and_names_what_it_has():
    assert decoders.DecoderRegistry.standard().get("JSON") is decoders.decode_json
    with pytest.raises(ValueError, match="json"):
        decoders.DecoderRegistry.standard().get("avro")


def test_normaliser():
    ignore = {"type": "ignore", "path": "**.traceId"}
    assert normalised('{"traceId":1,"a":{"traceId":2,"keep":3}}', ignore) == '{"a":{"keep":3}}'
    assert normalised('{"customer":{"ssn":null,"name":"x"}}', {"type": "mask", "path": "customer.ssn"}) == '{"customer":{"name":"x","ssn":"***"}}'
    assert normalised('{"a":null,"b":[null,1]}') == '{"b":[null,1]}'
    assert normalised('{"a":null}', nullsEqualAbsent=False) == '{"a":null}'
    assert normalised('{"a":{"b":{}}}', emptyEqualsAbsent=True) == "{}"
    assert normalised('{"i":[{"id":2,"ts":1},{"id":1,"ts":2}]}', {"type": "ignore", "path": "i[].ts"}, {"type": "unordered", "path": "i"}) == '{"i":[{"id":1},{"id":2}]}'
    assert normalised('["a","b","c"]', {"type": "ignore", "path": "[0]"}, {"type": "mask", "path": "[2]"}) == '["b","***"]'
    assert normalised("1", {"type": "ignore", "path": "$"}) == "null"
    cast = {"type": "cast", "path": "a", "to": "number"}
    assert normalised('{"a":" 1.50 "}', cast) == '{"a":1.5}' and normalised('{"a":"1_0"}', cast) == '{"a":"1_0"}'
    assert normalised('{"a":"TRUE"}', {"type": "cast", "path": "a", "to": "BOOLEAN"}) == '{"a":true}'


def test_differ():
    assert diffs('{"a":1,"b":2}', '{"b":"2","c":3}') == [("a", "removed", "1", None), ("b", "type-changed", "2", '"2"'), ("c", "added", None, "3")]
    assert diffs("[1,2]", "[1,5,3]") == [("[1]", "value-changed", "2", "5"), ("[2]", "added", None, "3")]
    assert diffs("true", "1") == [("$", "type-changed", "true", "1")]
    near = {"type": "numberTolerance", "path": "t", "epsilon": "0.01"}
    assert diffs('{"t":1.00}', '{"t":1.01}', near) == [] and len(diffs('{"t":1.00}', '{"t":1.0101}', near)) == 1
    time = {"type": "timeTolerance", "path": "t", "toleranceMillis": 5000}
    assert diffs('{"t":"2024-01-01T00:00:00Z"}', '{"t":"2024-01-01T03:00:05+03:00"}', time) == []
    assert diffs('{"t":"2024-01-01T00:00:00Z"}', '{"t":1704067205000}', time) == []
    assert len(diffs('{"t":"2024-01-01T00:00:00"}', '{"t":"2024-01-01T00:00:01"}', time)) == 1
    assert len(diffs('{"t":1}', "{}", near)) == 1


@given(st.decimals(allow_nan=False, allow_infinity=False), st.decimals(allow_nan=False, allow_infinity=False, min_value=-10, max_value=10))
def test_near_is_exact(a, step):
    from fractions import Fraction

    if abs(a.adjusted()) < 200:
        b = Decimal(str(a)) if not step else a + step
        assert rules.near(a, b, Decimal("0.5")) == (abs(Fraction(a) - Fraction(b)) <= Fraction(1, 2))


def test_signature():
    found = rules.diff(canon.read('{"i":[{"p":1},{"p":2}]}'), canon.read('{"i":[{"p":3},{"p":4}]}'), rules.EMPTY)
    entries, id_ = rules.signature(found)
    assert entries == ["i[].p: value-changed"] and len(id_) == 12
    with pytest.raises(ValueError):
        rules.signature([])


def test_rule_loader():
    for bad in ({"path": "a"}, {"type": "ignore"}, {"type": "nope", "path": "a"}, {"type": "cast", "path": "a", "to": "x"}, {"type": "numberTolerance", "path": "a"}):
        with pytest.raises(ValueError):
            RULES.rule(bad)
    own = rules.RuleTypes.standard().register("upper", lambda m, _: rules.Rule(m, lambda n: n.upper() if isinstance(n, str) else n))
    assert rules.normalise("a", own.rule_set({"rules": [{"type": "upper", "path": "$"}]})) == "A"
    assert [t["type"] for t in own.catalogue()] == sorted(own.factories)


TOPIC = {"name": "orders", "format": "json", "guidPath": "guid"}


@pytest.mark.parametrize("bad, said", [("{", "invalid config JSON"), ({"topics": []}, "no topics"), ({"topics": [TOPIC, TOPIC]}, "duplicate topic"), ({"topics": [TOPIC | {"ruleSet": "x"}]}, "unknown rule set"), ({"topics": [TOPIC | {"sequencePath": []}]}, "sequencePath"), ({"topics": [{"name": "a"}]}, "format"), ({"topics": [TOPIC | {"guidPath": "a.*"}]}, "wildcards")])
def test_bad_compare_configs(bad, said):
    with pytest.raises(ValueError, match=said):
        cf.load_compare(bad)


def test_rule_set_choice():
    c = cf.load_compare({"ruleSets": {"default": {"rules": [{"type": "ignore", "path": "a"}]}, "own": {"nullsEqualAbsent": False}}, "topics": [TOPIC, TOPIC | {"name": "b", "ruleSet": "own"}]})
    assert len(c.rules_of("orders").rules) == 1 and not c.rules_of("b").nulls_equal_absent and len(c.rules_of("other").rules) == 1


def job(**changes):
    servers = {"bootstrapServers": "h:1"}
    return {"compare": {"topics": [TOPIC]}, "main": servers, "load": servers | {"topicPrefix": "load."}, "control": servers | {"topic": "c"}, "results": {"type": "logging"}} | changes


def test_job_config():
    j = cf.load_job(job())
    assert j.load[0].logical() == {"load.orders": "orders"} and j.emit_equal_verdicts and j.state_ttl_millis == 7_200_000 and j.dead_letters.type == "logging" and j.rollups is None
    cluster = {"bootstrapServers": "h:1", "topics": ["orders"]}
    for bad, said in [
        ({"main": {"clusters": [cluster, cluster]}}, "is assigned to clusters"), ({"main": {"clusters": [cluster | {"topics": ["x"]}]}}, "unknown topic"), ({"main": {"clusters": []}}, "assigns no cluster"),
        ({"main": {"clusters": [{"bootstrapServers": "h"}]}}, "must list the topics"), ({"main": {"bootstrapServers": "h", "startingOffsets": "x"}}, "startingOffsets"), ({"results": None}, "results"),
        ({"compare": {"topics": [TOPIC, TOPIC | {"name": "b"}]}, "main": {"bootstrapServers": "h", "topicOverrides": {"b": "orders"}}}, "same physical topic"),
    ]:
        with pytest.raises(ValueError, match=said):
            cf.load_job(job(**bad))


def test_api_config():
    a = cf.load_api({"bootstrapServers": "h", "controlTopic": "c", "resultsTopic": {"topic": "r", "bootstrapServers": "g", "properties": {"a": 1}}})
    assert a.port == 8080 and a.results.bootstrap_servers == "g" and a.results.properties == {"a": "1"} and a.tail_size == 500 and a.dead_letters is None
    for bad in ({"bootstrapServers": "h"}, {"controlTopic": "c"}):
        with pytest.raises(ValueError):
            cf.load_api(bad)


def test_type_names():
    from decimal import Decimal

    from tandem.functions.canon import type_name

    assert [type_name(x) for x in (None, True, "a", Decimal(1), [], {})] == ["null", "boolean", "string", "number", "array", "object"]
