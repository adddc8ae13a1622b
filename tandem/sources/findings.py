"""Findings that were written as JSON under keys: the store behind the API and the dashboard."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.plans.config import ApiConfig, Endpoint
from tandem.sources.readers import NO_KAFKA, has_kafka
from tandem.sources.sinks import authorization

#: Newest first by these.
TIMES = {"verdict": "decidedAtMillis", "rollup": "windowStartMillis", "dead-letter": "timestampMillis"}


def parsed(findings: DataFrame, kind: str) -> DataFrame:
    """Findings of one kind: topic, at, key, value; values that are no JSON of this kind are left out."""
    get = lambda path: F.get_json_object("value", path)
    return findings.filter(get("$.type") == kind).select(get("$.topic").alias("topic"), get(f"$.{TIMES[kind]}").cast("long").alias("at"), get("$.status").alias("status"), "key", "value")


class TableStore:
    """Folders of (key, value) rows for each kind. tail: only so many of the newest findings are seen; latest: of each
    key only the newest one."""

    def __init__(self, spark: SparkSession, folders: dict[str, str], tail: int | None = 500, latest: bool = False):
        self.spark, self.folders, self.tail, self.latest = spark, folders, tail, latest

    def _all(self, kind: str) -> DataFrame:
        found = parsed(self.spark.read.schema("key string, value string").parquet(self.folders[kind]), kind)
        if self.latest:
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("at"), F.desc("value")))).filter("rank = 1").drop("rank")
        return found.orderBy(F.desc("at"), "key").limit(self.tail) if self.tail else found

    def find(self, kind: str, topic: str | None = None, limit: int = 100) -> DataFrame:
        found = self._all(kind)
        return (found.filter(F.col("topic") == topic) if topic else found).orderBy(F.desc("at"), "key").limit(limit)

    def summary(self, topic: str | None = None, limit: int | None = 100) -> DataFrame:
        """Counts by status over the recent window; limit None: over everything."""
        found = self._all("verdict") if limit is None else self.find("verdict", topic, limit)
        return (found.filter(F.col("topic") == topic) if topic else found).groupBy("status").agg(F.count("*").alias("count"))

    def values(self, kind: str, topic: str | None = None, limit: int = 100) -> list[dict]:
        """The newest findings as the API gives them."""
        return [json.loads(r["value"]) for r in self.find(kind, topic, limit).collect()]

    def counts(self, topic: str | None = None, limit: int = 100) -> tuple[int, dict[str, int]]:
        """How many verdicts there are, and how many of each status."""
        found = {r["status"] or "UNKNOWN": r["count"] for r in self.summary(topic, limit).collect()}
        return sum(found.values()), found


class KafkaStore(TableStore):
    """The newest records of the topics that a job writes to, newest by their place in them. A kind without a topic has
    no findings."""

    def __init__(self, spark: SparkSession, endpoints: dict[str, Endpoint | None], tail: int):
        if not has_kafka(spark):
            raise RuntimeError(NO_KAFKA)
        super().__init__(spark, {}, tail)
        self.endpoints = endpoints

    def records(self, kind: str) -> DataFrame:
        """(key, value, timestamp, partition, offset) of a kind's topic."""
        endpoint = self.endpoints.get(kind)
        if endpoint is None:
            return self.spark.createDataFrame([], "key string, value string, timestamp timestamp, partition int, offset long")
        own = {f"kafka.{k}": v for k, v in endpoint.properties.items()}
        found = self.spark.read.format("kafka").options(**{"kafka.bootstrap.servers": endpoint.bootstrap_servers, "subscribe": endpoint.topic} | own).load()
        return found.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "timestamp", "partition", "offset")

    def _all(self, kind: str) -> DataFrame:
        newest = self.records(kind).filter(F.get_json_object("value", "$.type").isNotNull()).orderBy(F.desc("timestamp"), F.desc("offset"), "partition").limit(self.tail)
        return parsed(newest, kind)


class ElasticsearchStore:
    """Findings of an index that the Elasticsearch sink writes, found by its search."""

    def __init__(self, options: dict[str, str]):
        if not options.get("url"):
            raise ValueError("findings store 'elasticsearch' needs option 'url'")
        self.search = f"{options['url'].rstrip('/')}/{options.get('index', 'tandem-findings')}/_search"
        self.headers = {"Content-Type": "application/json"} | authorization(options)

    def _ask(self, kind: str, topic: str | None, **body) -> dict:
        terms = {"type.keyword": kind} | ({"topic.keyword": topic} if topic else {})
        body["query"] = {"bool": {"filter": [{"term": {name: value}} for name, value in terms.items()]}}
        request = urllib.request.Request(self.search, json.dumps(body).encode(), self.headers, method="POST")
        with urllib.request.urlopen(request, timeout=30) as answer:
            return json.load(answer)

    def values(self, kind: str, topic: str | None = None, limit: int = 100) -> list[dict]:
        found = self._ask(kind, topic, size=max(limit, 0), sort=[{TIMES[kind]: {"order": "desc"}}])
        return [hit["_source"] for hit in found["hits"]["hits"]]

    def counts(self, topic: str | None = None, limit: int = 100) -> tuple[int, dict[str, int]]:
        """Over all verdicts, whatever the limit."""
        found = self._ask("verdict", topic, size=0, aggs={"status": {"terms": {"field": "status.keyword", "size": 50}}})
        return found["hits"]["total"]["value"], {b["key"]: b["doc_count"] for b in found["aggregations"]["status"]["buckets"]}


StoreFactory = Callable[[SparkSession, ApiConfig], "TableStore | ElasticsearchStore"]


class StoreRegistry:
    """Stores by type, whatever its case. kafka-tail: the newest findings, each revision; elasticsearch: all, the newest of
    each key. With the option path both read the tables there, which the table sink writes, instead of their own system;
    table: the same, by that name."""

    def __init__(self) -> None:
        self.by_type: dict[str, StoreFactory] = {}

    @staticmethod
    def standard() -> StoreRegistry:
        folders = lambda c: {k: f"{c.store_options['path']}/{k}" for k in TIMES}
        tables = lambda spark, c: TableStore(spark, folders(c), c.tail_size)
        endpoints = lambda c: {"verdict": c.results, "rollup": c.rollups, "dead-letter": c.dead_letters}
        found = StoreRegistry()
        found.register("table", tables)
        found.register("kafka-tail", lambda spark, c: tables(spark, c) if "path" in c.store_options else KafkaStore(spark, endpoints(c), c.tail_size))
        found.register("elasticsearch", lambda spark, c: TableStore(spark, folders(c), None, latest=True) if "path" in c.store_options else ElasticsearchStore(c.store_options))
        return found

    def register(self, name: str, factory: StoreFactory) -> StoreRegistry:
        self.by_type[name.lower()] = factory
        return self

    def create(self, spark: SparkSession, config: ApiConfig) -> TableStore | ElasticsearchStore:
        if config.store_type.lower() not in self.by_type:
            raise ValueError(f"unknown findings store type '{config.store_type}', registered: {sorted(self.by_type)}")
        return self.by_type[config.store_type.lower()](spark, config)
