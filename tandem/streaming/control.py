"""Compare configs that can be swapped while a stream runs.

Control messages are files of a folder that driver and executors reach; the valid one of the greatest name is active.
Names begin with a version, one more than the greatest of the folder, and end with a random part, so messages don't
depend on anyone's clock, and all readers agree on the active one however late they see a file. Executors look for new
files now and then and recompile only when the text has changed. Timers have no input row, so the config can't come with
the rows. Where the job's control messages come by Kafka, a query writes them to the folder by their offsets.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import lru_cache

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tandem.plans.config import CompareConfig, ControlConfig, load_compare
from tandem.sources.readers import NO_KAFKA, active_control, control_source, control_stream, has_kafka
from tandem.sources.sinks import control_message, kafka_sink

Loader = Callable[[str], CompareConfig]


@lru_cache(16)
def compiled(text: str, load: Loader = load_compare) -> CompareConfig:
    return load(text)


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def compare_of(message: str | None, load: Loader = load_compare) -> str | None:
    """The compare config in a control message if it is valid, else None: then the active one stays."""
    try:
        envelope = json.loads(message or "")
        if envelope.get("type") != "compare-config" or envelope.get("compare") is None:
            return None
        text = json.dumps(envelope["compare"])
        compiled(text, load)
    except (ValueError, AttributeError, TypeError):
        return None
    return text


_looked: dict[tuple[str, Loader], tuple[float, str | None]] = {}  # a folder: when looked at, the active text


@lru_cache(256)
def _message(name: str, folder: str, load: Loader) -> str | None:
    """The config of one file; files don't change."""
    fs, _ = _opened(folder)
    with fs.open_input_stream(name) as f:
        return compare_of(f.read().decode("utf-8", "replace"), load)


def _names(folder: str) -> list[str]:
    fs, path = _opened(folder)
    return sorted(f.path for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if f.is_file and f.base_name.endswith(".json"))


class Resolver:
    """The active config: the last valid message of the folder, else the bootstrap config."""

    def __init__(self, bootstrap: str, folder: str | None = None, refresh_seconds: float = 1.0, load: Loader = load_compare):
        self.bootstrap, self.folder, self.refresh_seconds, self.load = bootstrap, folder, refresh_seconds, load

    def __call__(self) -> CompareConfig:
        return compiled(self.text(), self.load)

    def found(self) -> str | None:
        """The folder's active config, None without one."""
        if not self.folder:
            return None
        key = self.folder, self.load
        looked, active = _looked.get(key, (None, None))
        if looked is None or time.monotonic() - looked >= self.refresh_seconds:
            active = next((text for name in reversed(_names(self.folder)) if (text := _message(name, self.folder, self.load))), None)
            _looked[key] = time.monotonic(), active
        return active

    def text(self) -> str:
        return self.found() or self.bootstrap


def _write(folder: str, name: str, value: str) -> str:
    fs, path = _opened(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{name}.part") as out:
        out.write(value.encode())
    fs.move(f"{path}/{name}.part", f"{path}/{name}.json")
    return f"{path}/{name}.json"


def publish(folder: str, compare: str | dict, load: Loader = load_compare) -> str:
    """Validate a compare config and add it to the folder; ValueError if it is not valid."""
    text = compare if isinstance(compare, str) else json.dumps(compare)
    load(text)
    _, value = control_message(json.loads(text))
    last = max((int(n.rpartition("/")[2].split("-")[0]) for n in _names(folder)), default=-1)
    return _write(folder, f"{last + 1:020d}-{uuid.uuid4().hex[:12]}", value)


def relay(messages: DataFrame, folder: str) -> int:
    """Write control messages (value, partition, offset) to the folder under their offsets; messages that are there
    already stay the same files. They are few, so the driver takes them one by one. Returns how many there were."""
    n = 0
    for r in messages.select(F.col("value").cast("string").alias("value"), "partition", "offset").toLocalIterator():
        _write(folder, f"{r['offset']:020d}-{r['partition']:06d}", r["value"] or "")
        n += 1
    return n


def start_control(spark: SparkSession, control: ControlConfig, folder: str, checkpoint: str, **trigger: str) -> StreamingQuery:
    """Relay the control topic, from its beginning, to the folder."""
    writer = control_stream(spark, control).writeStream.foreachBatch(lambda batch, _: relay(batch, folder)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


class FolderControl:
    """The API's side of a control folder."""

    def __init__(self, folder: str, bootstrap: str | None = None, load: Loader = load_compare):
        self.folder, self.bootstrap, self.load = folder, bootstrap, load

    def active(self) -> tuple[str | None, str]:
        """The active config and where it comes from: control, bootstrap or none."""
        found = Resolver("", self.folder, 0.0, self.load).found()
        return (found, "control") if found else (self.bootstrap, "bootstrap" if self.bootstrap else "none")

    def apply(self, compare: dict) -> None:
        publish(self.folder, compare, self.load)


class KafkaControl:
    """The API's side of a control topic."""

    def __init__(self, spark: SparkSession, control: ControlConfig, bootstrap: str | None = None, load: Loader = load_compare):
        if not has_kafka(spark):
            raise RuntimeError(NO_KAFKA)
        self.spark, self.control, self.bootstrap, self.load = spark, control, bootstrap, load

    def active(self) -> tuple[str | None, str]:
        return active_control(control_source(self.spark, self.control), self.bootstrap)

    def apply(self, compare: dict) -> None:
        text = json.dumps(compare)
        self.load(text)
        options = {"bootstrapServers": self.control.bootstrap_servers, "topic": self.control.topic, "acks": "all"} | self.control.properties
        kafka_sink(options)(self.spark.createDataFrame([control_message(compare)], "key string, value string"))
