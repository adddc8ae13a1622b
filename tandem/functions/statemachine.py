"""One document's state, message by message: the streaming engine's fold and decision, and the batch engine's yardstick.

A document has a line for each topic and environment. A line knows its states by what tells them apart: by their hash
where messages have no sequence, by their sequence otherwise. So a message costs one look-up, however long its line. A
line is anything with the members of `Line`, which keeps its states in memory; the streaming engine has one that keeps
them in the state store.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from tandem.functions.canon import NUMBER, read, utf16
from tandem.functions.rules import Differ, FieldDiff, diff, signature
from tandem.plans.config import CompareConfig, MatchPolicy

COHORT = "(cohort)"
SIDES = ("MAIN", "LOAD")
STATS = ("main_messages", "load_messages", "main_distinct_states", "load_distinct_states", "main_duplicates", "load_duplicates", "missing_sequences_in_load", "extra_sequences_in_load")


@dataclass
class Version:
    """The state of one sequence: when its sequence was first seen (a place in the line), hash, JSON, time."""

    place: int
    hash: str
    json: str
    ts: int


@dataclass
class Line:
    """States of one topic and environment. tail: hash and JSON of the state without a sequence that was new last."""

    messages: int = 0
    duplicates: int = 0
    tail: tuple[str, str] | None = None
    states: set[str] = field(default_factory=set)
    versions: dict[str, Version] = field(default_factory=dict)

    def knows(self, hash_: str) -> bool:
        return hash_ in self.states

    def append(self, hash_: str, json_: str) -> None:
        self.states.add(hash_)
        self.tail = hash_, json_

    def version(self, sequence: str) -> Version | None:
        return self.versions.get(sequence)

    def put(self, sequence: str, version: Version) -> None:
        self.versions[sequence] = version

    def places(self) -> int:
        """How many sequences there are."""
        return len(self.versions)


@dataclass
class Document:
    entered: set[str] = field(default_factory=set)
    first: int | None = None
    last: int | None = None
    cohort: int = 0  # verdicts on the document as a whole so far
    revisions: dict[str, int] = field(default_factory=dict)  # verdicts on each topic so far
    lines: dict[tuple[str, str], Line] = field(default_factory=dict)

    def touch(self, ts: int) -> None:
        self.first = ts if self.first is None else min(self.first, ts)
        self.last = ts if self.last is None else max(self.last, ts)

    def topics(self) -> list[str]:
        return list(dict.fromkeys(topic for topic, _ in self.lines))


def compare_sequences(a: str | None, b: str | None) -> int:
    """Numbers by value, anything else by text; none comes first."""
    if a is None or b is None:
        return (a is not None) - (b is not None)
    x, y = (Decimal(a), Decimal(b)) if NUMBER.fullmatch(a) and NUMBER.fullmatch(b) else (utf16(a), utf16(b))
    return (x > y) - (x < y)


def fold(line: Line, sequence: str | None, hash_: str, json_: str, ts: int) -> None:
    """A message enters its line. A state that is there already is a duplicate; another state of a known sequence
    replaces it unless its time is earlier."""
    line.messages += 1
    if sequence is None:
        if line.knows(hash_):
            line.duplicates += 1
        else:
            line.append(hash_, json_)
        return
    known = line.version(sequence)
    if known is None:
        line.put(sequence, Version(line.places(), hash_, json_, ts))
    elif known.hash == hash_:
        line.duplicates += 1
    elif ts >= known.ts:
        line.put(sequence, Version(known.place, hash_, json_, ts))


def observe(doc: Document, env: str, topic: str, kind: str, sequence: str | None, hash_: str | None, json_: str | None, ts: int) -> None:
    doc.touch(ts)
    if kind == "ENTRY":
        doc.entered.add(env)
    else:
        fold(doc.lines.setdefault((topic, env), Line()), sequence, hash_, json_, ts)


def in_order(versions: dict[str, Version]) -> list[tuple[str, Version]]:
    """Sequences as they were first seen."""
    return sorted(versions.items(), key=lambda x: x[1].place)


def final_version(versions: dict[str, Version]) -> Version:
    """Of the highest sequence, as the comparison of each with the best before it says; among equals of the latest time,
    then of the first seen."""
    best = None
    for s, v in in_order(versions):
        order = 1 if best is None else compare_sequences(s, best[0])
        if order > 0 or (order == 0 and v.ts > best[1].ts):
            best = s, v
    return best[1]


def final(line: Line) -> tuple[str, str]:
    """Hash and JSON of a line's final state. Any sequence is above none."""
    if not line.versions:
        return line.tail
    v = final_version(line.versions)
    return v.hash, v.json


def all_sequences(main: dict[str, Version], load: dict[str, Version]) -> list[str]:
    """All sequences in order; of those that compare equal, the first one, MAIN's before LOAD's."""
    out: list[str] = []
    for s, _ in (*in_order(main), *in_order(load)):
        lo, hi, known = 0, len(out), False
        while lo < hi and not known:
            mid = (lo + hi) // 2
            order = compare_sequences(s, out[mid])
            known = order == 0
            lo, hi = (mid + 1, hi) if order > 0 else (lo, mid)
        if not known:
            out.insert(lo, s)
    return out


def sequence_pairs(main: dict[str, Version], load: dict[str, Version]) -> tuple[int, int, list[tuple[str, str]]]:
    """Sequences that LOAD lacks, that MAIN lacks, and both states of those that differ, in order."""
    missing = extra = 0
    differing = []
    for s in all_sequences(main, load):
        x, y = main.get(s), load.get(s)
        missing += y is None
        extra += x is None
        if x and y and x.hash != y.hash:
            differing.append((x.json, y.json))
    return missing, extra, differing


def decision_time(doc: Document, policy: MatchPolicy) -> int:
    return -1 if doc.last is None else min(doc.last + policy.quiet_millis, doc.first + policy.max_wait_millis)


def _stats(doc: Document, topics: list[str], missing: int = 0, extra: int = 0) -> dict[str, int]:
    def total(env: str, of) -> int:
        return sum(of(doc.lines[t, env]) for t in topics if (t, env) in doc.lines)

    counters = (lambda x: x.messages, lambda x: len(x.states) + len(x.versions), lambda x: x.duplicates)
    return dict(zip(STATS, (*(total(env, of) for of in counters for env in SIDES), missing, extra), strict=True))


def _verdict(doc: Document, guid: str, topic: str, topics: list[str], status: str, severity: str, revision: int, now: int, diffs: list[FieldDiff] | None = None, missing: int = 0, extra: int = 0) -> dict:
    entries, id_ = signature(diffs) if diffs else (None, None)
    return {"guid": guid, "topic": topic, "status": status, "severity": severity, "signature_id": id_, "signature": entries, "diffs": diffs or [], "stats": _stats(doc, topics, missing, extra), "revision": revision, "decided_at_millis": now}


def judge(doc: Document, guid: str, topic: str, config: CompareConfig, now: int, differ: Differ = diff) -> dict:
    main, load = (doc.lines.get((topic, env)) for env in SIDES)
    doc.revisions[topic] = doc.revisions.get(topic, 0) + 1
    verdict = lambda status, severity, *found: _verdict(doc, guid, topic, [topic], status, severity, doc.revisions[topic], now, *found)
    if load is None:
        return verdict("MISSING_IN_LOAD", "ERROR")
    if main is None:
        return verdict("EXTRA_IN_LOAD", "WARN")
    rules = config.rules_of(topic)
    compared = lambda a, b: differ(read(a), read(b), rules)
    (a, x), (b, y) = final(main), final(load)
    if a != b and (diffs := compared(x, y)):
        return verdict("DIFF", "ERROR", diffs)
    diverged = ("EQUAL_DIVERGED", "WARN" if config.policy.strict_intermediates else "INFO")
    if not main.versions and not load.versions:
        return verdict("EQUAL", "OK") if main.states == load.states else verdict(*diverged)
    missing, extra, differing = sequence_pairs(main.versions, load.versions)
    diffs = [d for x, y in differing for d in compared(x, y)]
    return verdict(*(diverged if diffs or missing or extra else ("EQUAL", "OK")), diffs, missing, extra)


def decide(guid: str, doc: Document, config: CompareConfig, now: int, differ: Differ = diff) -> list[dict]:
    """The verdicts on a document that has gone quiet; their revisions are counted in it."""
    topics = doc.topics()
    if config.policy.cohort_mode == "ASSUME_ALL" or doc.entered.issuperset(SIDES):
        return [judge(doc, guid, t, config, now, differ) for t in topics]
    if doc.entered:
        doc.cohort += 1
        return [_verdict(doc, guid, COHORT, topics, "NOT_MIRRORED" if "MAIN" in doc.entered else "TEST_TRAFFIC", "INFO", doc.cohort, now)]
    out = []
    for t in topics:
        doc.revisions[t] = doc.revisions.get(t, 0) + 1
        out.append(_verdict(doc, guid, t, [t], "UNANCHORED", "WARN", doc.revisions[t], now))
    return out
