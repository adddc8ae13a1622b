"""What a job can be given instead of its own: decoders, rule types, normaliser, differ, codec and sinks."""

from __future__ import annotations

from dataclasses import dataclass, field

from tandem.functions.codec import Codec
from tandem.functions.decoders import DecoderRegistry
from tandem.functions.rules import Differ, Normaliser, RuleTypes, diff, normalise
from tandem.plans.config import CompareConfig, JobConfig, load_compare, load_job
from tandem.sources.sinks import SinkRegistry


@dataclass
class Plugins:
    """Plain values, which travel to the executors; any of them can be replaced or, the registries, added to."""

    decoders: DecoderRegistry = field(default_factory=DecoderRegistry.standard)
    rule_types: RuleTypes = field(default_factory=RuleTypes.standard)
    sinks: SinkRegistry = field(default_factory=SinkRegistry.standard)
    codec: Codec = field(default_factory=Codec)
    differ: Differ = diff
    normaliser: Normaliser = normalise

    def load_compare(self, config: str | dict) -> CompareConfig:
        return load_compare(config, self.rule_types)

    def load_job(self, config: str | dict) -> JobConfig:
        return load_job(config, self.rule_types)
