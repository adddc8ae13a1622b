"""Sinks of findings: frames of (key, value) strings go to the sink that a config names."""

from __future__ import annotations

import base64
import json
import logging
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tandem.plans.config import SinkConfig
from tandem.sources.readers import NO_KAFKA, has_kafka

LOG = logging.getLogger("tandem.findings")
Sink = Callable[[DataFrame], None]


def _need(options: dict[str, str], name: str, sink: str) -> str:
    if not options.get(name):
        raise ValueError(f"sink '{sink}' needs option '{name}'")
    return options[name]


def logging_sink(options: dict[str, str]) -> Sink:
    """Each finding as a line of the executors' logs."""

    def write(batch: DataFrame) -> None:
        def log(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for key, value in zip(b.column("key").to_pylist(), b.column("value").to_pylist(), strict=True):
                    LOG.info("%s %s", key, value)
                yield b.slice(0, 0)

        batch.mapInArrow(log, "key string, value string").write.format("noop").mode("overwrite").save()

    return write


def kafka_sink(options: dict[str, str]) -> Sink:
    """At least once; options beside bootstrapServers and topic become producer properties."""
    servers, topic = _need(options, "bootstrapServers", "kafka"), _need(options, "topic", "kafka")
    own = {f"kafka.{k}": v for k, v in options.items() if k not in ("bootstrapServers", "topic")}

    def write(batch: DataFrame) -> None:
        if not has_kafka(batch.sparkSession):
            raise RuntimeError(NO_KAFKA)
        batch.select("key", "value").write.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic} | own).save()

    return write


def authorization(options: dict[str, str]) -> dict[str, str]:
    """The header that the options apiKey, or username and password, ask for."""
    if options.get("apiKey"):
        return {"Authorization": "ApiKey " + options["apiKey"]}
    if options.get("username"):
        return {"Authorization": "Basic " + base64.b64encode(f"{options['username']}:{options.get('password', '')}".encode()).decode()}
    return {}


def elasticsearch_sink(options: dict[str, str]) -> Sink:
    """PUT each finding under its key, so that a later one of a key replaces it; an error of the server fails the task."""
    url, index = _need(options, "url", "elasticsearch").rstrip("/"), _need(options, "index", "elasticsearch")
    headers = {"Content-Type": "application/json"} | authorization(options)

    def write(batch: DataFrame) -> None:
        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for key, value in zip(b.column("key").to_pylist(), b.column("value").to_pylist(), strict=True):
                    request = urllib.request.Request(f"{url}/{index}/_doc/{urllib.parse.quote_plus(key)}", value.encode(), headers, method="PUT")
                    with urllib.request.urlopen(request, timeout=30) as answer:
                        if answer.status // 100 != 2:
                            raise RuntimeError(f"{url}: status {answer.status}")
                yield b.slice(0, 0)

        batch.select("key", "value").mapInArrow(put, "key string, value string").write.format("noop").mode("overwrite").save()

    return write


def table_sink(options: dict[str, str]) -> Sink:
    """Append to a folder of Parquet files (option path)."""
    path = _need(options, "path", "table")
    return lambda batch: batch.write.mode("append").parquet(path)


class SinkRegistry:
    """Sink factories by type, whatever its case."""

    def __init__(self) -> None:
        self.by_type: dict[str, Callable[[dict[str, str]], Sink]] = {}

    @staticmethod
    def standard() -> SinkRegistry:
        found = SinkRegistry()
        for name, factory in (("logging", logging_sink), ("kafka", kafka_sink), ("elasticsearch", elasticsearch_sink), ("table", table_sink)):
            found.register(name, factory)
        return found

    def register(self, name: str, factory: Callable[[dict[str, str]], Sink]) -> SinkRegistry:
        self.by_type[name.lower()] = factory
        return self

    def create(self, config: SinkConfig) -> Sink:
        if config.type.lower() not in self.by_type:
            raise ValueError(f"unknown sink type '{config.type}', registered: {sorted(self.by_type)}")
        return self.by_type[config.type.lower()](config.options)


def control_message(compare: dict) -> tuple[str, str]:
    """Key and value of the message that activates a compare config."""
    return "compare-config", json.dumps({"type": "compare-config", "compare": compare})
