"""The engine on a stream: documents are folded as messages come and decided when they have gone quiet.

One query decodes each record once, folds and decides, and gives verdicts and dead letters; it also writes the roll-ups
of each micro-batch, a few rows however many documents it has, which a second query merges by windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tandem.functions.statemachine import STATS, Document, Line, Version, decide, fold
from tandem.operators import rollups as ru
from tandem.operators.observe import observe as observed_rows
from tandem.operators.verdicts import DIFF
from tandem.plans.config import JobConfig
from tandem.plans.plugins import Plugins
from tandem.sources.readers import has_kafka, job_source
from tandem.streaming.control import Resolver, start_control


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()
STATS_TYPE = _struct(**{n: _L if n in STATS[:2] + STATS[4:6] else _I for n in STATS})
VERDICT = _struct(guid=_S, topic=_S, status=_S, severity=_S, signature_id=_S, signature=T.ArrayType(_S), diffs=T.ArrayType(DIFF), stats=STATS_TYPE, revision=_I, decided_at_millis=_L)
LETTER = _struct(env=_S, topic=_S, ts_millis=_L, error=_S, payload=T.BinaryType())
FOUND = _struct(verdict=VERDICT, letter=LETTER)
PARTS = _struct(window_start_millis=_L, topic=_S, status=_S, signature_id=_S, count=_L, head=_struct(at=_L, guid=_S, severity=_S, signature=T.ArrayType(_S)), samples=T.ArrayType(_struct(at=_L, guid=_S)), until=_L)


def arrival_order(arrival) -> tuple:
    """A sort key from an arrival column's value, which may be a struct (a dict or tuple here) or a plain value."""
    if isinstance(arrival, dict):
        arrival = tuple(arrival.values())
    return tuple(map(arrival_order, arrival)) if isinstance(arrival, tuple) else (arrival is not None, arrival)


class StoredLine:
    """A line whose states lie in the state store, one entry each; its counters are written back once a batch."""

    def __init__(self, processor: Decider, topic: str, env: str):
        self.processor, self.key = processor, (topic, env)
        row = processor.lines.getValue(self.key) if processor.lines.containsKey(self.key) else (0, 0, 0, None, None)
        self.messages, self.duplicates, self.sequences, *tail = row
        self.tail = tuple(tail) if tail[0] is not None else None

    def save(self) -> None:
        self.processor.lines.updateValue(self.key, (self.messages, self.duplicates, self.sequences, *(self.tail or (None, None))))

    def knows(self, hash_: str) -> bool:
        return self.processor.states.containsKey((*self.key, hash_))

    def append(self, hash_: str, json_: str) -> None:
        self.processor.states.updateValue((*self.key, hash_), (True,))
        self.tail = hash_, json_

    def version(self, sequence: str) -> Version | None:
        key = (*self.key, sequence)
        return Version(*self.processor.versions.getValue(key)) if self.processor.versions.containsKey(key) else None

    def put(self, sequence: str, version: Version) -> None:
        self.sequences = max(self.sequences, version.place + 1)
        self.processor.versions.updateValue((*self.key, sequence), (version.place, version.hash, version.json, version.ts))

    def places(self) -> int:
        return self.sequences


class Decider(StatefulProcessor):
    """Keeps a document's state; a timer fires when it has been quiet, or has waited long enough. State stays after a
    decision until nothing has touched it for its time to live, so that a late message decides anew, with the next
    revision. A message reads and writes its own state's entry and its line's counters, whatever else there is.

    Records that can't be read come under keys of their own and leave as dead letters at once; they keep no state."""

    def __init__(self, config: Callable, ttl_millis: int, plugins: Plugins):
        self.config, self.ttl_millis, self.differ = config, ttl_millis, plugins.differ

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        line = _struct(topic=_S, env=_S)
        self.clock = handle.getValueState("clock", _struct(first=_L, fire=_L, touched=_L, expire=_L))
        self.document = handle.getValueState("document", _struct(main=T.BooleanType(), load=T.BooleanType(), first=_L, last=_L, cohort=_I))
        self.lines = handle.getMapState("lines", line, _struct(messages=_L, duplicates=_L, sequences=_L, hash=_S, json=_S))
        self.states = handle.getMapState("states", _struct(topic=_S, env=_S, hash=_S), _struct(known=T.BooleanType()))
        self.versions = handle.getMapState("versions", _struct(topic=_S, env=_S, sequence=_S), _struct(place=_L, hash=_S, json=_S, ts=_L))
        self.revisions = handle.getMapState("revisions", _struct(topic=_S), _struct(revision=_I))

    def forget(self) -> None:
        for state in (self.clock, self.document, self.lines, self.states, self.versions, self.revisions):
            state.clear()

    def loaded(self) -> Document:
        main, load, first, last, cohort = self.document.get() or (False, False, None, None, 0)
        return Document({e for e, has in (("MAIN", main), ("LOAD", load)) if has}, first, last, cohort)

    def saved(self, doc: Document) -> None:
        self.document.update(("MAIN" in doc.entered, "LOAD" in doc.entered, doc.first, doc.last, doc.cohort))

    def whole(self) -> Document:
        """The document with all its lines, for a decision."""
        doc = self.loaded()
        doc.revisions = {k[0]: v[0] for k, v in self.revisions.iterator()}
        for k, (messages, duplicates, _, hash_, json_) in self.lines.iterator():
            doc.lines[tuple(k)] = Line(messages, duplicates, (hash_, json_) if hash_ is not None else None)
        for (topic, env, hash_), _ in self.states.iterator():
            doc.lines[topic, env].states.add(hash_)
        for (topic, env, sequence), v in self.versions.iterator():
            doc.lines[topic, env].versions[sequence] = Version(*v)
        return doc

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[1] is not None:
            for r in rows:
                yield Row(verdict=None, letter=Row(env=r["env"], topic=r["topic"], ts_millis=r["ts_millis"], error=r["error"], payload=r["value"]))
            return
        now, policy = timerValues.getCurrentProcessingTimeInMs(), self.config().policy
        first, fire, touched, expire = self.clock.get() or (None, None, None, None)
        if touched is not None and touched + self.ttl_millis <= now:  # its time has come, if its timer has not
            for timer in {fire, expire} - {None}:
                self.handle.deleteTimer(timer)
            self.forget()
            first = fire = expire = None
        doc, lines = self.loaded(), {}
        for r in sorted(rows, key=lambda r: arrival_order(r["arrival"])):
            doc.touch(r["ts_millis"])
            if r["kind"] == "ENTRY":
                doc.entered.add(r["env"])
                continue
            line = lines.get((r["topic"], r["env"])) or lines.setdefault((r["topic"], r["env"]), StoredLine(self, r["topic"], r["env"]))
            fold(line, r["sequence"], r["state_hash"], r["state_json"], r["ts_millis"])
        for line in lines.values():
            line.save()
        self.saved(doc)
        first = now if first is None else first
        soon = max(min(now + policy.quiet_millis, first + policy.max_wait_millis), now + 1)
        if fire is not None and fire not in (soon, expire):
            self.handle.deleteTimer(fire)
        self.handle.registerTimer(soon)
        if expire is None:
            expire = now + self.ttl_millis
            self.handle.registerTimer(expire)
        self.clock.update((first, soon, now, expire))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        clock, at, now = self.clock.get(), expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentProcessingTimeInMs()
        if not clock:
            return
        first, fire, touched, expire = clock
        if at == fire:
            doc = self.whole()
            found = decide(key[0], doc, self.config(), now, self.differ)
            self.saved(doc)
            for topic, revision in doc.revisions.items():
                self.revisions.updateValue((topic,), (revision,))
            fire, touched = None, now
            for v in found:
                verdict = v | {"diffs": [Row(**vars(d)) for d in v["diffs"]], "stats": Row(**v["stats"])}
                yield Row(verdict=Row(**verdict), letter=None)
        if at >= expire and touched + self.ttl_millis <= now:
            if fire is not None:
                self.handle.deleteTimer(fire)
            self.forget()
            return
        if at >= expire:
            expire = touched + self.ttl_millis
            self.handle.registerTimer(expire)
        self.clock.update((first, fire, touched, expire))

    def close(self) -> None:
        pass


def found_stream(raw: DataFrame, config: Callable, ttl_millis: int = 7_200_000, plugins: Plugins | None = None) -> DataFrame:
    """A stream of raw records to a stream of findings, each a verdict or a dead letter. Needs the RocksDB state store
    provider. Records of one batch and document are folded by time, partition and offset."""
    plugins = plugins or Plugins()
    seen = observed_rows(raw, config, plugins.decoders, plugins.normaliser)
    place = F.when(F.col("error").isNotNull(), F.xxhash64("env", "topic", "ts_millis", "value"))
    return seen.withColumn("place", place).groupBy("guid", "place").transformWithState(Decider(config, ttl_millis, plugins), FOUND, "append", "processingTime")


def verdict_stream(raw: DataFrame, config: Callable, ttl_millis: int = 7_200_000, plugins: Plugins | None = None) -> DataFrame:
    """The verdicts of a stream of raw records."""
    return found_stream(raw, config, ttl_millis, plugins).filter("verdict is not null").select("verdict.*")


def make_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)


def write_once(batch: DataFrame, folder: str, batch_id: int) -> bool:
    """Write a micro-batch's rows as a folder that appears whole, by a rename; a batch that is repeated after a failure
    finds it there and adds nothing, so readers see its files once. Returns whether it wrote."""
    spark = batch.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    draft, final = hadoop.Path(f"{folder}/_draft-{batch_id}"), hadoop.Path(f"{folder}/batch_id={batch_id}")
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(final):
        return False
    batch.write.mode("overwrite").parquet(draft.toString())
    if not fs.rename(draft, final):
        raise RuntimeError(f"can't rename {draft.toString()} to {final.toString()}")
    return True


def start_findings(raw: DataFrame, config: Callable, results: Callable[[DataFrame], None], letters: Callable[[DataFrame], None], checkpoint: str, parts: str | None = None, window_millis: int = 60_000, emit_equal: bool = True, ttl_millis: int = 7_200_000, plugins: Plugins | None = None, **trigger: str) -> StreamingQuery:
    """Run the stream: verdicts and dead letters to their sinks (at least once), and each micro-batch's roll-ups (of EQUAL
    verdicts too) to the folder parts (once)."""
    plugins = plugins or Plugins()

    def split(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            verdicts = batch.filter("verdict is not null").select("verdict.*")
            if parts:
                write_once(ru.partial_rollups(verdicts, window_millis), parts, batch_id)
            results(plugins.codec.verdicts(verdicts, emit_equal))
            letters(plugins.codec.dead_letters(batch.filter("letter is not null").select("letter.*")))
        finally:
            batch.unpersist()

    writer = found_stream(raw, config, ttl_millis, plugins).writeStream.outputMode("append").foreachBatch(split).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def merged_rollups(parts: DataFrame, window_millis: int, delay_millis: int = 60_000) -> DataFrame:
    """Merge a stream of micro-batches' roll-ups by their windows. State is one row for each roll-up of an open window,
    with a few samples for each micro-batch."""
    at = F.timestamp_millis("until")
    rows = parts.withColumn("at", at).withWatermark("at", f"{delay_millis} milliseconds")
    grouped = rows.groupBy(F.window("at", f"{window_millis} milliseconds"), *ru.KEY).agg(F.sum("count").alias("count"), F.min("head").alias("head"), ru.merged_samples(F.collect_list("samples")).alias("sample_guids"))
    return ru.finished(grouped, window_millis)


def start_rollups(parts: DataFrame, window_millis: int, sink: Callable[[DataFrame], None], checkpoint: str, delay_millis: int = 60_000, plugins: Plugins | None = None, **trigger: str) -> StreamingQuery:
    """Write the roll-ups of a window when it has passed."""
    codec = (plugins or Plugins()).codec
    writer = merged_rollups(parts, window_millis, delay_millis).writeStream.outputMode("append").foreachBatch(lambda batch, _: sink(codec.rollups(batch))).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def rollup_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of roll-ups that micro-batches write to a folder, which is made if it is not there."""
    make_folder(spark, folder)
    return spark.readStream.schema(PARTS).option("recursiveFileLookup", "true").parquet(folder)


def run_job(raw: DataFrame, job: JobConfig, folder: str, control_folder: str | None = None, plugins: Plugins | None = None, rollup_delay_millis: int = 60_000) -> list[StreamingQuery]:
    """Start all queries of a job config on a stream of raw records; folder holds checkpoints, roll-ups of micro-batches
    and, unless control_folder is another, control messages. Where Kafka is there, the job's control topic is relayed."""
    spark, plugins = raw.sparkSession, plugins or Plugins()
    control_folder = control_folder or f"{folder}/control"
    if job.parallelism:
        spark.conf.set("spark.sql.shuffle.partitions", str(job.parallelism))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    config = Resolver(job.compare.text, control_folder, load=plugins.load_compare)
    trigger = {"processingTime": f"{job.checkpoint_interval_millis} milliseconds"} if job.checkpoint_interval_millis else {}
    parts = f"{folder}/rollup-parts" if job.rollups else None
    window = job.rollups.window_millis if job.rollups else 60_000
    results, letters = plugins.sinks.create(job.results), plugins.sinks.create(job.dead_letters)
    queries = [start_findings(raw, config, results, letters, f"{folder}/checkpoints/findings", parts, window, job.emit_equal_verdicts, job.state_ttl_millis, plugins, **trigger)]
    if job.rollups:
        queries.append(start_rollups(rollup_parts(spark, parts), window, plugins.sinks.create(job.rollups.sink), f"{folder}/checkpoints/rollups", rollup_delay_millis, plugins, **trigger))
    if has_kafka(spark):
        queries.append(start_control(spark, job.control, control_folder, f"{folder}/checkpoints/control", **trigger))
    return queries


def run_config(spark: SparkSession, config: str | dict, folder: str, plugins: Plugins | None = None) -> list[StreamingQuery]:
    """Start a job config with its own Kafka sources."""
    plugins = plugins or Plugins()
    job = plugins.load_job(config)
    return run_job(job_source(spark, job), job, folder, plugins=plugins)
