"""Normalisation rules, equivalence rules, the structural differ and diff signatures."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from decimal import Decimal
from typing import Any

from tandem.functions.canon import JAVA_BLANK, NUMBER, Matcher, Tree, render, utf8, utf16, write


class GONE:
    """Stands for a node that is not there. A class, so that it stays itself when rules travel to executors."""


MASK = "***"


@dataclass(frozen=True)
class Rule:
    """rewrite: changes a node (GONE removes it), before its children or, with after, behind them; equivalent: says
    that two nodes do not differ. A rule has one of the two. flat: what a rewrite does to a scalar, by a name that
    `tandem.functions.flat` knows; without one, records under the rule are decoded in Python."""

    matcher: Matcher
    rewrite: Callable[[Tree], Tree] | None = None
    after: bool = False
    equivalent: Callable[[Tree, Tree], bool] | None = None
    flat: str | None = None


@dataclass(frozen=True)
class RuleSet:
    nulls_equal_absent: bool = True
    empty_equals_absent: bool = False
    rules: tuple[Rule, ...] = ()
    rewrites: tuple[Rule, ...] = field(init=False)
    equivalences: tuple[Rule, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "rewrites", tuple(r for r in self.rules if r.rewrite))
        object.__setattr__(self, "equivalences", tuple(r for r in self.rules if r.equivalent))


EMPTY = RuleSet()


def required(spec: dict, name: str, what: str = "rule field") -> Any:
    value = spec.get(name) if isinstance(spec, dict) else None
    if value is None:
        raise ValueError(f"missing required {what} '{name}' in {json.dumps(spec, default=str)}")
    return value


def to_number(node: Tree) -> Tree:
    text = node.strip(JAVA_BLANK) if isinstance(node, str) else ""
    return Decimal(text) if NUMBER.fullmatch(text) else node


def to_boolean(node: Tree) -> Tree:
    return {"true": True, "false": False}.get(node.strip(JAVA_BLANK).lower(), node) if isinstance(node, str) else node


_INSTANT = re.compile(r"([+-]?\d{4,10})-(\d\d)-(\d\d)T(\d\d):(\d\d)(?::(\d\d)(?:\.(\d{0,9}))?)?(Z|[+-]\d\d(?::?\d\d(?::?\d\d)?)?)", re.I)
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def instant_millis(node: Tree, unit: str) -> int | None:
    """Epoch milliseconds of an ISO text with a zone, or of an epoch number; None for anything else."""
    if isinstance(node, Decimal):
        return int(node) * (1000 if unit == "SECONDS" else 1)
    m = _INSTANT.fullmatch(node) if isinstance(node, str) else None
    if not m:
        return None
    zone = m[8].upper().replace(":", "")
    shift = timedelta() if zone == "Z" else timedelta(hours=int(zone[1:3]), minutes=int(zone[3:5] or 0), seconds=int(zone[5:7] or 0)) * (-1 if zone[0] == "-" else 1)
    try:
        at = datetime(int(m[1]), int(m[2]), int(m[3]), int(m[4]), int(m[5]), int(m[6] or 0), tzinfo=timezone.utc) - shift
    except (ValueError, OverflowError):
        return None
    return (at - _EPOCH) // timedelta(milliseconds=1) + int(((m[7] or "") + "000")[:3])


def _cast(matcher: Matcher, spec: dict) -> Rule:
    to = str(required(spec, "to")).upper()
    if to not in ("NUMBER", "BOOLEAN"):
        raise ValueError(f"unknown cast target '{to}'")
    return Rule(matcher, to_number if to == "NUMBER" else to_boolean, flat=to.lower())


def _number_tolerance(matcher: Matcher, spec: dict) -> Rule:
    raw = required(spec, "epsilon")
    text = raw if isinstance(raw, str) else str(raw)
    if not NUMBER.fullmatch(text):
        raise ValueError(f"invalid epsilon '{raw}'")
    epsilon = Decimal(text)
    return Rule(matcher, equivalent=lambda a, b: isinstance(a, Decimal) and isinstance(b, Decimal) and near(a, b, epsilon))


def near(a: Decimal, b: Decimal, epsilon: Decimal) -> bool:
    """|a - b| <= epsilon without rounding."""
    low, high = min(a, b), max(a, b)
    unit = min(0, *(x.as_tuple().exponent for x in (low, high, epsilon)))
    whole = lambda x: int(x.scaleb(-unit)) if len(x.as_tuple().digits) + x.as_tuple().exponent - unit <= 28 else int(format(x, "f").replace(".", "") + "0" * (-unit - max(0, -x.as_tuple().exponent)))
    return whole(high) - whole(low) <= whole(epsilon)


def _time_tolerance(matcher: Matcher, spec: dict) -> Rule:
    tolerance, unit = int(required(spec, "toleranceMillis")), str(spec.get("epochUnit") or "MILLIS").upper()
    if unit not in ("MILLIS", "SECONDS"):
        raise ValueError(f"unknown epoch unit '{unit}'")

    def equivalent(a: Tree, b: Tree) -> bool:
        x, y = instant_millis(a, unit), instant_millis(b, unit)
        return x is not None and y is not None and abs(x - y) <= tolerance

    return Rule(matcher, equivalent=equivalent)


RuleFactory = Callable[[Matcher, dict], Rule]


class RuleTypes:
    """Rule factories by type, and what the catalogue says of their parameters: (name, kind, required)."""

    def __init__(self) -> None:
        self.factories: dict[str, RuleFactory] = {}
        self.params: dict[str, list[tuple[str, str, bool]]] = {}

    @staticmethod
    def standard() -> RuleTypes:
        return (
            RuleTypes()
            .register("ignore", lambda m, _: Rule(m, lambda _n: GONE, flat="drop"))
            .register("mask", lambda m, _: Rule(m, lambda _n: MASK, flat="mask"))
            .register("unordered", lambda m, _: Rule(m, lambda n: sorted(n, key=lambda x: utf16(write(x))) if isinstance(n, list) else n, after=True, flat="keep"))
            .register("cast", _cast, [("to", "enum:NUMBER,BOOLEAN", True)])
            .register("numberTolerance", _number_tolerance, [("epsilon", "number", True)])
            .register("timeTolerance", _time_tolerance, [("toleranceMillis", "number", True), ("epochUnit", "enum:MILLIS,SECONDS", False)])
        )

    def register(self, name: str, factory: RuleFactory, params: list[tuple[str, str, bool]] | None = None) -> RuleTypes:
        self.factories[name] = factory
        self.params[name] = params or []
        return self

    def rule(self, spec: dict) -> Rule:
        kind = required(spec, "type")
        if kind not in self.factories:
            raise ValueError(f"unknown rule type '{kind}', registered: {sorted(self.factories)}")
        return self.factories[kind](Matcher(str(required(spec, "path"))), spec)

    def rule_set(self, spec: dict) -> RuleSet:
        flag = lambda name, default: spec[name] if isinstance(spec.get(name), bool) else default
        return RuleSet(flag("nullsEqualAbsent", True), flag("emptyEqualsAbsent", False), tuple(self.rule(r) for r in spec.get("rules") or []))

    def catalogue(self) -> list[dict]:
        return [{"type": t, "params": [{"name": n, "kind": k, "required": r} for n, k, r in self.params[t]]} for t in sorted(self.factories)]


def _without_absent(node: Tree, rules: RuleSet) -> Tree:
    """What is left of a tree that no rule rewrites."""
    if isinstance(node, dict):
        kept = {name: _without_absent(child, rules) for name, child in node.items() if child is not None or not rules.nulls_equal_absent}
        return {name: child for name, child in kept.items() if child or not isinstance(child, (dict, list))} if rules.empty_equals_absent else kept
    return [_without_absent(child, rules) for child in node] if isinstance(node, list) else node


def normalise(tree: Tree, rules: RuleSet) -> Tree:
    """Rewrite a tree by its rules: each node by the rules that match its place, in their order; then its children, whose
    places keep their first indices; then by the rules that work behind the children. A removed root is null."""
    rewrites = rules.rewrites
    if not rewrites:
        return _without_absent(tree, rules)

    def visit(node: Tree, places: tuple[frozenset[int], ...]) -> Tree:
        mine = [r for r, p in zip(rewrites, places, strict=True) if r.matcher.accepts(p)]
        for rule in mine:
            if not rule.after and (node := rule.rewrite(node)) is GONE:
                return GONE
        below = lambda to: tuple(r.matcher.step(p, to) for r, p in zip(rewrites, places, strict=True))
        if isinstance(node, dict):
            kept = {}
            for name, child in node.items():
                child = visit(child, below(name))
                absent = child is GONE or (child is None and rules.nulls_equal_absent) or (rules.empty_equals_absent and isinstance(child, (dict, list)) and not child)
                if not absent:
                    kept[name] = child
            node = kept
        elif isinstance(node, list):
            node = [c for i, child in enumerate(node) if (c := visit(child, below(i))) is not GONE]
        for rule in mine:
            if rule.after and (node := rule.rewrite(node)) is GONE:
                return GONE
        return node

    out = visit(tree, tuple(r.matcher.start for r in rewrites))
    return None if out is GONE else out


#: A tree and its rules to the tree that is compared.
Normaliser = Callable[[Tree, RuleSet], Tree]


@dataclass(frozen=True)
class FieldDiff:
    path: str
    general: str
    kind: str  # added, removed, value-changed, type-changed
    main: str | None
    load: str | None


def diff(main: Tree, load: Tree, rules: RuleSet) -> list[FieldDiff]:
    """Where two trees differ: at the top-most missing node, else at leaves. Objects are walked by sorted keys, arrays by
    position; nodes that a rule calls equivalent are left alone."""
    out: list[FieldDiff] = []
    checks = rules.equivalences

    def add(path: tuple, kind: str, a: Tree, b: Tree) -> None:
        out.append(FieldDiff(render(path), render(path, True), kind, None if a is GONE else write(a), None if b is GONE else write(b)))

    def visit(path: tuple, a: Tree, b: Tree, places: tuple[frozenset[int], ...]) -> None:
        if a is GONE or b is GONE:
            add(path, "added" if a is GONE else "removed", a, b)
            return
        if any(r.matcher.accepts(p) and r.equivalent(a, b) for r, p in zip(checks, places, strict=True)):
            return
        below = lambda to: tuple(r.matcher.step(p, to) for r, p in zip(checks, places, strict=True))
        if isinstance(a, dict) and isinstance(b, dict):
            for name in sorted({*a, *b}, key=utf16):
                visit((*path, name), a.get(name, GONE), b.get(name, GONE), below(name))
        elif isinstance(a, list) and isinstance(b, list):
            for i in [*range(min(len(a), len(b))), *range(len(b), len(a)), *range(len(a), len(b))]:
                visit((*path, i), a[i] if i < len(a) else GONE, b[i] if i < len(b) else GONE, below(i))
        elif type(a) is not type(b):
            add(path, "type-changed", a, b)
        elif a != b:
            add(path, "value-changed", a, b)

    visit((), main, load, tuple(r.matcher.start for r in checks))
    return out


#: Two trees, MAIN and LOAD, and their rules to where they differ.
Differ = Callable[[Tree, Tree, RuleSet], list[FieldDiff]]


def signature(diffs: list[FieldDiff]) -> tuple[list[str], str]:
    """Distinct sorted entries 'general path: kind', and the first 12 hex digits of their hash."""
    if not diffs:
        raise ValueError("a signature needs at least one diff")
    entries = sorted({f"{d.general}: {d.kind}" for d in diffs}, key=utf16)
    return entries, hashlib.sha256(utf8("\n".join(entries))).hexdigest()[:12]
