"""Loaders of compare, job and API configs; what is wrong with one is said in a ValueError."""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass, field
from typing import Any

from tandem.functions.canon import parse_path
from tandem.functions.rules import EMPTY, RuleSet, RuleTypes

ROLES = ("ENTRY", "OUTPUT", "BOTH")
COHORT_MODES = ("ENTRY_TOPICS", "ASSUME_ALL")
OFFSET_MODES = ("earliest", "latest")


@dataclass(frozen=True)
class MatchPolicy:
    quiet_millis: int = 300_000
    max_wait_millis: int = 3_600_000
    strict_intermediates: bool = False
    cohort_mode: str = "ENTRY_TOPICS"


@dataclass(frozen=True)
class TopicConfig:
    name: str
    role: str
    format: str
    guid_path: tuple[str | int, ...]
    guid_text: str
    sequence_paths: tuple[tuple[str | int, ...], ...] = ()
    sequence_texts: tuple[str, ...] = ()
    rule_set: str | None = None


@dataclass(frozen=True)
class CompareConfig:
    policy: MatchPolicy
    rule_sets: dict[str, RuleSet]
    topics: dict[str, TopicConfig]
    text: str = ""

    def rules_of(self, topic: str) -> RuleSet:
        """The set that the topic names, which replaces the default one; the default one; no rules."""
        config = self.topics.get(topic)
        return self.rule_sets.get(config.rule_set if config and config.rule_set is not None else "default", EMPTY)


def _parsed(text: str | dict, what: str) -> dict:
    if isinstance(text, dict):
        return text
    try:
        found = json.loads(text)
    except ValueError as e:
        raise ValueError(f"invalid {what} JSON") from e
    return found if isinstance(found, dict) else {}


def _need(node: dict, name: str, what: str) -> Any:
    value = node.get(name) if isinstance(node, dict) else None
    if value is None:
        raise ValueError(f"missing required {what} field '{name}'")
    return value


def _one_of(value: Any, allowed: tuple[str, ...], what: str) -> str:
    if (name := str(value).upper()) not in allowed:
        raise ValueError(f"{what} must be one of {list(allowed)}, got '{value}'")
    return name


def _topic(node: dict, rule_sets: dict[str, RuleSet]) -> TopicConfig:
    name, rules = str(_need(node, "name", "config")), node.get("ruleSet")
    if rules is not None and rules not in rule_sets:
        raise ValueError(f"topic '{name}' references unknown rule set '{rules}'")
    sequence = node.get("sequencePath")
    sequence = [] if sequence is None else [sequence] if isinstance(sequence, str) else sequence
    if node.get("sequencePath") is not None and not (isinstance(sequence, list) and sequence):
        raise ValueError("sequencePath must be a path or a non-empty array of paths")
    role, kind, guid = _one_of(node.get("role") or "OUTPUT", ROLES, "role"), str(_need(node, "format", "config")), str(_need(node, "guidPath", "config"))
    return TopicConfig(name, role, kind, parse_path(guid), guid, tuple(parse_path(str(p)) for p in sequence), tuple(map(str, sequence)), rules)


def load_compare(config: str | dict, types: RuleTypes | None = None) -> CompareConfig:
    root, types = _parsed(config, "config"), types or RuleTypes.standard()
    policy = root.get("policy") or {}
    rule_sets = {name: types.rule_set(spec) for name, spec in (root.get("ruleSets") or {}).items()}
    topics = [_topic(t, rule_sets) for t in root.get("topics") or []]
    if twice := [t for t, n in Counter(t.name for t in topics).items() if n > 1]:
        raise ValueError(f"duplicate topic in config: {twice[0]}")
    if not topics:
        raise ValueError("config defines no topics")
    return CompareConfig(
        MatchPolicy(int(policy.get("quietMillis", 300_000)), int(policy.get("maxWaitMillis", 3_600_000)), bool(policy.get("strictIntermediates", False)), _one_of(policy.get("cohortMode") or "ENTRY_TOPICS", COHORT_MODES, "cohortMode")),
        rule_sets, {t.name: t for t in topics}, config if isinstance(config, str) else json.dumps(config),
    )


@dataclass(frozen=True)
class ClusterConfig:
    name: str
    bootstrap_servers: str
    group_id: str
    topics: tuple[str, ...]
    topic_prefix: str = ""
    topic_overrides: dict[str, str] = field(default_factory=dict)
    starting_offsets: str = "latest"
    properties: dict[str, str] = field(default_factory=dict)

    def physical(self, topic: str) -> str:
        return self.topic_overrides.get(topic, self.topic_prefix + topic)

    def logical(self) -> dict[str, str]:
        """Physical to logical topics; two of one physical name are an error."""
        found: dict[str, str] = {}
        for topic in self.topics:
            if (other := found.setdefault(self.physical(topic), topic)) != topic:
                raise ValueError(f"topics '{other}' and '{topic}' map to the same physical topic '{self.physical(topic)}' on cluster '{self.name}'")
        return found


@dataclass(frozen=True)
class SinkConfig:
    type: str
    options: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class ControlConfig:
    bootstrap_servers: str
    topic: str
    properties: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class RollupConfig:
    window_millis: int
    sink: SinkConfig


@dataclass(frozen=True)
class JobConfig:
    main: tuple[ClusterConfig, ...]
    load: tuple[ClusterConfig, ...]
    control: ControlConfig
    results: SinkConfig
    dead_letters: SinkConfig
    rollups: RollupConfig | None
    state_ttl_millis: int
    checkpoint_interval_millis: int | None
    parallelism: int | None
    emit_equal_verdicts: bool
    is_local: bool
    compare: CompareConfig


def _texts(node: Any) -> dict[str, str]:
    return {k: v if isinstance(v, str) else json.dumps(v) for k, v in (node or {}).items()}


def _cluster(node: dict, group: str, name: str, topics: tuple[str, ...]) -> ClusterConfig:
    offsets = node.get("startingOffsets", "latest")
    if offsets not in OFFSET_MODES:
        raise ValueError(f"startingOffsets must be one of {list(OFFSET_MODES)}, got '{offsets}'")
    return ClusterConfig(node.get("name", name), str(_need(node, "bootstrapServers", "job config")), node.get("groupId", group), topics, node.get("topicPrefix", ""), _texts(node.get("topicOverrides")), offsets, _texts(node.get("properties")))


def _env(env: str, node: dict, topics: set[str]) -> tuple[ClusterConfig, ...]:
    group = f"tandem-{env}"
    if node.get("clusters") is None:
        return (_cluster(node, group, env, tuple(sorted(topics))),)
    clusters = []
    for i, c in enumerate(node["clusters"]):
        listed = c.get("topics")
        if not isinstance(listed, list) or not listed:
            raise ValueError(f"cluster '{env}-{i}' must list the topics it carries")
        clusters.append(_cluster(c, group, f"{env}-{i}", tuple(dict.fromkeys(map(str, listed)))))
    owner: dict[str, str] = {}
    for c in clusters:
        for t in c.topics:
            if t not in topics:
                raise ValueError(f"cluster '{c.name}' of environment '{env}' lists unknown topic '{t}'")
            if t in owner:
                raise ValueError(f"topic '{t}' is assigned to clusters '{owner[t]}' and '{c.name}' in environment '{env}'")
            owner[t] = c.name
    if missing := topics - set(owner):
        raise ValueError(f"environment '{env}' assigns no cluster for topics {sorted(missing)}")
    return tuple(clusters)


def _sink(node: dict) -> SinkConfig:
    return SinkConfig(str(_need(node, "type", "job config")), _texts(node.get("options")))


def load_job(config: str | dict, types: RuleTypes | None = None) -> JobConfig:
    root = _parsed(config, "job config")
    compare = load_compare(_need(root, "compare", "job config"), types)
    envs = [_env(env, _need(root, env, "job config"), set(compare.topics)) for env in ("main", "load")]
    control, rollups = _need(root, "control", "job config"), root.get("rollups")
    job = JobConfig(
        *envs,
        ControlConfig(str(_need(control, "bootstrapServers", "job config")), str(_need(control, "topic", "job config")), _texts(control.get("properties"))),
        _sink(_need(root, "results", "job config")),
        _sink(root["deadLetters"]) if root.get("deadLetters") else SinkConfig("logging"),
        RollupConfig(int(rollups.get("windowMillis", 60_000)), _sink(_need(rollups, "sink", "job config"))) if rollups else None,
        int(root.get("stateTtlMillis", 7_200_000)), root.get("checkpointIntervalMillis"), root.get("parallelism"),
        bool(root.get("emitEqualVerdicts", True)), bool(root.get("isLocal", False)), compare,
    )
    for cluster in (*job.main, *job.load):
        cluster.logical()
    return job


@dataclass(frozen=True)
class Endpoint:
    topic: str
    bootstrap_servers: str
    properties: dict[str, str]


@dataclass(frozen=True)
class ApiConfig:
    port: int
    control: Endpoint
    results: Endpoint
    rollups: Endpoint
    dead_letters: Endpoint | None
    bootstrap_compare_path: str | None
    tail_size: int
    offset_reset: str
    store_type: str
    store_options: dict[str, str]


def load_api(config: str | dict) -> ApiConfig:
    root = _parsed(config, "api config")
    servers, shared = root.get("bootstrapServers"), _texts(root.get("kafkaProperties"))

    def endpoint(name: str, default: str | None) -> Endpoint:
        node = root.get(name)
        if node is None and default is None:
            raise ValueError(f"missing required api config field '{name}'")
        node = default if node is None else node
        own = {"topic": node} if isinstance(node, str) else node
        where = own.get("bootstrapServers") or servers
        if where is None:
            raise ValueError(f"api config topic '{name}' has no bootstrapServers and no top-level default")
        return Endpoint(str(_need(own, "topic", "api config")), where, _texts(own["properties"]) if "properties" in own else shared)

    store = root.get("findingsStore") or {}
    return ApiConfig(
        int(root.get("port", 8080)), endpoint("controlTopic", None), endpoint("resultsTopic", "tandem.verdicts"), endpoint("rollupsTopic", "tandem.rollups"),
        endpoint("deadLetterTopic", None) if root.get("deadLetterTopic") else None, root.get("bootstrapComparePath"), int(root.get("tailSize", 500)),
        root.get("findingsOffsetReset", "latest"), store.get("type", "kafka-tail"), _texts(store.get("options")),
    )
