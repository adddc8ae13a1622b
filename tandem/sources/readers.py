"""Sources of raw records: (env, topic, key, value, ts_millis, partition, offset)."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.operators.observe import RAW
from tandem.plans.config import ClusterConfig, ControlConfig, JobConfig

KAFKA_CLASS = "org.apache.spark.sql.kafka010.KafkaSourceProvider"
NO_KAFKA = "reading or writing Kafka needs the package org.apache.spark:spark-sql-kafka-0-10 of this Spark version on the class path (spark.jars.packages)"


def has_kafka(spark: SparkSession) -> bool:
    try:
        spark._jvm.java.lang.Class.forName(KAFKA_CLASS, False, spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
    except Exception:  # noqa: BLE001 - py4j wraps ClassNotFoundException
        return False
    return True


def logical_topic(topic: Column, mapping: dict[str, str]) -> Column:
    """A physical topic's logical name; topics that the mapping lacks keep theirs."""
    if not mapping:
        return topic
    return F.coalesce(F.create_map(*(F.lit(x) for x in chain(*mapping.items())))[topic], topic)


def tagged(records: DataFrame, env: str, mapping: dict[str, str]) -> DataFrame:
    """Kafka's columns as raw records of one environment."""
    ts = F.unix_millis("timestamp") if "timestamp" in records.columns else F.col("ts_millis")
    return records.select(F.lit(env).alias("env"), logical_topic(F.col("topic"), mapping).alias("topic"), F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), ts.cast("long").alias("ts_millis"), F.col("partition").cast("int").alias("partition"), F.col("offset").cast("long").alias("offset"))


def kafka_options(cluster: ClusterConfig, streaming: bool) -> dict[str, str]:
    own = {f"kafka.{k}": v for k, v in cluster.properties.items()}
    start = cluster.starting_offsets if streaming else "earliest"  # a batch read can't begin at the latest offsets
    return {"kafka.bootstrap.servers": cluster.bootstrap_servers, "subscribe": ",".join(sorted(cluster.logical())), "kafka.group.id": cluster.group_id, "startingOffsets": start} | own


def kafka(spark: SparkSession, cluster: ClusterConfig, env: str, streaming: bool = True) -> DataFrame:
    if not has_kafka(spark):
        raise RuntimeError(NO_KAFKA)
    reader = (spark.readStream if streaming else spark.read).format("kafka").options(**kafka_options(cluster, streaming))
    return tagged(reader.load(), env, cluster.logical())


def job_source(spark: SparkSession, job: JobConfig, streaming: bool = True) -> DataFrame:
    """All clusters of both environments as one stream."""
    parts = [kafka(spark, c, env, streaming) for env, clusters in (("MAIN", job.main), ("LOAD", job.load)) for c in clusters]
    return reduce(DataFrame.unionByName, parts)


def control_options(control: ControlConfig) -> dict[str, str]:
    own = {f"kafka.{k}": v for k, v in control.properties.items()}
    return {"kafka.bootstrap.servers": control.bootstrap_servers, "subscribe": control.topic, "startingOffsets": "earliest"} | own


def control_source(spark: SparkSession, control: ControlConfig) -> DataFrame:
    """All control messages so far: value, partition, offset."""
    if not has_kafka(spark):
        raise RuntimeError(NO_KAFKA)
    found = spark.read.format("kafka").options(**control_options(control)).load()
    return found.select(F.col("value").cast("string").alias("value"), "partition", "offset")


def control_stream(spark: SparkSession, control: ControlConfig) -> DataFrame:
    """Control messages as they come, from the first on."""
    if not has_kafka(spark):
        raise RuntimeError(NO_KAFKA)
    return spark.readStream.format("kafka").options(**control_options(control)).load()


def files(spark: SparkSession, path: str, streaming: bool = False, format: str = "parquet", **options: str) -> DataFrame:
    """Raw records from files of any format that Spark reads; with streaming, new files as they come."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(RAW).format(format).options(**options).load(path)


def active_control(messages: DataFrame, bootstrap: str | None = None) -> tuple[str | None, str]:
    """The last message with a compare config, or the bootstrap config, or none; and which of these it is."""
    envelope = messages.select(F.get_json_object("value", "$.type").alias("type"), F.get_json_object("value", "$.compare").alias("compare"), F.struct(*(c for c in ("offset", "partition") if c in messages.columns)).alias("at"))
    last = envelope.filter("type = 'compare-config' and compare is not null").agg(F.max_by("compare", "at").alias("compare")).first()["compare"]
    return (last, "control") if last is not None else (bootstrap, "bootstrap" if bootstrap is not None else "none")
