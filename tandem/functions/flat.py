"""JSON objects of scalars as column expressions: the common payload needs no Python worker.

A record is flat if its text is one object of strings, plain numbers, booleans and nulls without escapes, exponents and
characters from U+D800 on, with each key once. Its canonical text then follows from its tokens: numbers lose trailing
zeros, pairs are sorted (below U+D800 by UTF-8 and by UTF-16 units alike), rules change, cast or drop single values. All
else, and whatever is not valid, is left to the decoder in Python, which is also what these expressions are tested against.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tandem.functions.decoders import DecoderRegistry, decode_json
from tandem.functions.rules import MASK, RuleSet
from tandem.plans.config import CompareConfig, TopicConfig

_WS = r"[ \t\r\n]*+"
_TEXT = r'"[^"\\\x00-\x1f\uD800-\uFFFF\x{10000}-\x{10FFFF}]*+"'
_PAIR = rf"{_TEXT}{_WS}:{_WS}(?:{_TEXT}|-?+(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+|true|false|null)"
#: Possessive throughout: it is matched in one go, however many pairs there are.
FLAT = rf"^{_WS}\{{{_WS}(?:{_PAIR}(?:{_WS},{_WS}{_PAIR})*+)?+{_WS}\}}{_WS}\z"
_FIELD = rf'"([^"]*+)"{_WS}:{_WS}("[^"]*+"|[^ \t\r\n,}}]++)'
_NUMERIC = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)"
_FRACTION_ZEROS = r"\.0*$|(\.[0-9]*?[1-9])0+$"


def is_flat(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.is_valid_utf8(text) & text.rlike(FLAT), F.lit(False))


def fields(value: Column) -> Column:
    """Key and canonical token of each pair of a flat text."""
    found = [F.regexp_extract_all(value.cast("string"), F.lit(_FIELD), F.lit(i)) for i in (1, 2)]
    return F.zip_with(*found, lambda k, v: F.struct(k.alias("k"), _canonical(v).alias("v")))


def once(fields: Column) -> Column:
    """Whether each key stands there once."""
    keys = F.transform(fields, lambda x: x["k"])
    return F.size(F.array_distinct(keys)) == F.size(fields)


def _is_text(v: Column) -> Column:
    return v.startswith('"')


def _inner(v: Column) -> Column:
    return F.substring(v, F.lit(2), F.length(v) - 2)


def _plain_number(v: Column) -> Column:
    """A number without exponent and leading zeros; no trailing zeros, no negative zero."""
    out = F.when(F.contains(v, F.lit(".")), F.regexp_replace(v, _FRACTION_ZEROS, "$1")).otherwise(v)
    return F.when(out == "-0", "0").otherwise(out)


def _canonical(v: Column) -> Column:
    # a token begins with a quote, a minus, a digit or a letter, in this order
    return F.when((v >= "-") & (v < ":"), _plain_number(v)).otherwise(v)


def _to_number(v: Column) -> Column:
    text = F.trim(_inner(v))
    digits = F.regexp_replace(text, "^[+-]?0*", "")
    whole = F.when(digits.startswith(".") | (digits == ""), F.concat(F.lit("0"), digits)).otherwise(digits)
    signed = F.concat(F.when(text.startswith("-"), "-").otherwise(""), F.regexp_replace(whole, _FRACTION_ZEROS, "$1"))
    return F.when(_is_text(v) & text.rlike(f"^{_NUMERIC}$"), F.when(signed == "-0", "0").otherwise(signed)).otherwise(v)


def _to_boolean(v: Column) -> Column:
    text = F.lower(F.trim(_inner(v)))
    return F.when(_is_text(v) & text.isin("true", "false"), text).otherwise(v)


#: What a rule does to a scalar, by the name that the rule gives; null drops it.
EFFECTS: dict[str, Callable[[Column], Column]] = {
    "drop": lambda v: F.lit(None).cast("string"), "mask": lambda v: F.lit(f'"{MASK}"'), "number": _to_number, "boolean": _to_boolean, "keep": lambda v: v,
}


def named(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: test(x["k"])


@dataclass(frozen=True)
class TopicPlan:
    """How one topic's flat records are read. rules: (test of a key, effect) in order."""

    topic: TopicConfig
    rules: tuple[tuple[Callable[[Column], Column], str], ...]
    drop_nulls: bool

    def text_at(self, fields: Column, path: tuple) -> Column:
        """The scalar of a field as text; null if it lacks or is null."""
        text = lambda x: F.when(x["v"] != "null", F.when(_is_text(x["v"]), _inner(x["v"])).otherwise(x["v"]))
        return F.get(F.transform(F.filter(fields, lambda x: x["k"] == path[0]), text), 0)

    def guid(self, fields: Column) -> Column:
        return self.text_at(fields, self.topic.guid_path)

    def sequence(self, fields: Column) -> Column:
        """Null if a part of it lacks; empty if it has none."""
        parts = [self.text_at(fields, p) for p in self.topic.sequence_paths] if self.topic.role != "ENTRY" else []
        return F.concat(*[x for p in parts for x in (F.lit("|"), p)][1:]) if parts else F.lit("")

    def has_sequence(self) -> bool:
        return self.topic.role != "ENTRY" and bool(self.topic.sequence_paths)

    def readable(self, fields: Column) -> Column:
        """Whether no rule would have to read an exponent."""
        out = F.lit(True)
        for test, effect in self.rules:
            if effect == "number":
                out &= ~F.exists(F.filter(fields, named(test)), lambda x: x["v"].rlike(rf'^" *{_NUMERIC}[eE][+-]?[0-9]+ *"$'))
        return out

    def state(self, fields: Column) -> Column:
        def value(x: Column) -> Column:
            v = x["v"]
            for test, effect in self.rules:
                v = F.when(test(x["k"]) & v.isNotNull(), EFFECTS[effect](v)).otherwise(v)
            return F.when(v != "null", v) if self.drop_nulls else v

        kept = F.transform(fields, lambda x: F.struct(x["k"].alias("k"), value(x).alias("v"))) if self.rules or self.drop_nulls else fields
        pairs = F.transform(F.array_sort(F.filter(kept, lambda x: x["v"].isNotNull())), lambda x: F.concat(F.lit('"'), x["k"], F.lit('":'), x["v"]))
        return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def rule_plans(rules: RuleSet) -> tuple | None:
    """The rules that reach fields of a flat object; None if one of them can't be told by its name, or rewrites the whole
    object."""
    found = []
    for rule in rules.rewrites:
        where = rule.matcher.top_level()
        if rule.flat not in EFFECTS or where == "root":
            return None
        if where == "any":
            found.append((lambda k: F.lit(True), rule.flat))
        elif where:
            found.append((lambda k, name=where[1]: k == name, rule.flat))
    return tuple(found)


def topic_plans(config: CompareConfig, decoders: DecoderRegistry) -> dict[str, TopicPlan]:
    """The topics whose flat records can be read by expressions."""
    found = {}
    for t in config.topics.values():
        rules = config.rules_of(t.name)
        paths = (t.guid_path, *t.sequence_paths)
        plans = rule_plans(rules)
        if decoders.by_format.get(t.format.lower()) is decode_json and plans is not None and all(len(p) == 1 and isinstance(p[0], str) for p in paths):
            found[t.name] = TopicPlan(t, plans, rules.nulls_equal_absent)
    return found
