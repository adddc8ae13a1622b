"""Raw records to observations: decode, extract, normalise, hash; what can't be read becomes a dead letter."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions import flat
from tandem.functions.canon import DecodeError, extract, utf8, write
from tandem.functions.decoders import DecoderRegistry
from tandem.functions.rules import Normaliser, normalise
from tandem.plans.config import CompareConfig, TopicConfig, load_compare

RAW = "env string, topic string, key binary, value binary, ts_millis long, partition int, offset long"
DECODED = "role string, guid string, sequence string, state_json string, error string"
_NAMES = [x.split()[0] for x in DECODED.split(", ")]


def _needed(tree, path: tuple, text: str, what: str, topic: str) -> str:
    found = extract(tree, path)
    if found is None:
        raise DecodeError(f"no {what} at '{text}' in message on topic {topic}")
    return found


def decode_one(config: CompareConfig, topic: TopicConfig, decoders: DecoderRegistry, normaliser: Normaliser, payload: bytes | None) -> tuple:
    """(role, guid, sequence, state, error) of one record; DecodeError or ValueError if it can't be read."""
    tree = decoders.get(topic.format)(payload, topic.name)
    guid = _needed(tree, topic.guid_path, topic.guid_text, "GUID", topic.name)
    if topic.role == "ENTRY":
        return topic.role, guid, None, None, None
    parts = [_needed(tree, p, t, "sequence", topic.name) for p, t in zip(topic.sequence_paths, topic.sequence_texts, strict=True)]
    return topic.role, guid, "|".join(parts) if parts else None, write(normaliser(tree, config.rules_of(topic.name))), None


def _valid(text: str | None) -> str | None:
    """Text that UTF-8 can hold."""
    return text if text is None or text.isascii() else utf8(text).decode()


def decoder(active: Callable[[], CompareConfig], decoders: DecoderRegistry, normaliser: Normaliser):
    """(topic, value) to a struct of DECODED; all null for a null topic, or one that the active config lacks."""

    def decode(topic: pa.Array, value: pa.Array) -> pa.Array:
        if topic.null_count == len(topic):
            return pa.nulls(len(topic), pa.struct([(n, pa.string()) for n in _NAMES]))
        now, none, rows = active(), (None,) * len(_NAMES), []
        for name, payload in zip(topic.to_pylist(), value.to_pylist(), strict=True):
            try:
                rows.append(decode_one(now, now.topics[name], decoders, normaliser, payload) if name in now.topics else none)
            except ValueError as e:
                rows.append((None, None, None, None, str(e)))
        columns = zip(*rows, strict=True) if rows else [()] * len(_NAMES)
        return pa.StructArray.from_arrays([pa.array([_valid(x) for x in c], pa.string()) for c in columns], _NAMES)

    # not deterministic, so that filters above don't repeat it
    return F.arrow_udf(decode, DECODED).asNondeterministic()


def default_arrival(raw: DataFrame) -> Column:
    """Without an arrival column of their own, records arrive by timestamp, partition and offset."""
    if "arrival" in raw.columns:
        return F.col("arrival")
    return F.struct("ts_millis", *(c for c in ("partition", "offset") if c in raw.columns))


def by_topic(of: dict[str, Column], kind: str) -> Column:
    """The expression of the row's topic; null for others."""
    out = F.lit(None).cast(kind)
    for name, x in of.items():
        out = F.when(F.col("topic") == name, x).otherwise(out)
    return out


def observe(raw: DataFrame, config: CompareConfig | str | Callable[[], CompareConfig], decoders: DecoderRegistry | None = None, normaliser: Normaliser = normalise, native: bool = True) -> DataFrame:
    """raw with guid, sequence, kind, state_hash, state_json and error in place of key and value; value stays where an
    error is. A record of an unknown topic gives no row, one of a topic with role BOTH gives two. Flat JSON is read by
    column expressions (native), all else in Python, which gets nulls for the records that are read already. Filters on
    envelope columns belong before this, Spark doesn't push them through. config may be a function that executors ask
    for the active one; the topics that are read stay those of the start, and all records are read in Python."""
    config = load_compare(config) if isinstance(config, str) else config
    active = config if callable(config) else lambda: config
    decoders = decoders or DecoderRegistry.standard()
    start = active()
    native = native and not callable(config) and normaliser is normalise
    plans = flat.topic_plans(start, decoders) if native else {}
    keep = ["env", "topic", "ts_millis", "arrival"]
    rows = raw.filter(F.col("topic").isin(list(start.topics))).withColumn("arrival", default_arrival(raw)).select(*keep, "value")
    decode = decoder(active, decoders, normaliser)
    if plans:
        some = lambda of, kind: by_topic({t: of(p) for t, p in plans.items()}, kind)
        fields = F.col("fields")
        rows = rows.withColumn("fields", F.when(F.col("topic").isin(list(plans)) & flat.is_flat(F.col("value")), flat.fields(F.col("value"))))
        rows = rows.withColumns({"own_guid": some(lambda p: p.guid(fields), "string"), "own_sequence": some(lambda p: p.sequence(fields), "string")})
        readable = F.coalesce(flat.once(fields) & some(lambda p: p.readable(fields), "boolean"), F.lit(False))
        rows = rows.withColumn("flat", fields.isNotNull() & F.col("own_guid").isNotNull() & F.col("own_sequence").isNotNull() & readable)
        rows = rows.withColumn("slow", decode(F.when(~F.col("flat"), F.col("topic")), F.when(~F.col("flat"), F.col("value"))))
        rows = rows.filter("flat or slow.guid is not null or slow.error is not null")
        sequenced = [t for t, p in plans.items() if p.has_sequence()]
        fast = {
            "role": some(lambda p: F.lit(p.topic.role), "string"), "guid": F.col("own_guid"), "sequence": F.when(F.col("topic").isin(sequenced), F.col("own_sequence")),
            "state_json": by_topic({t: p.state(fields) for t, p in plans.items() if p.topic.role != "ENTRY"}, "string"), "error": F.lit(None).cast("string"),
        }
        rows = rows.select(*keep, *(F.when(F.col("flat"), x).otherwise(F.col(f"slow.{n}")).alias(n) for n, x in fast.items()), "value")
    else:
        rows = rows.withColumn("found", decode(F.col("topic"), F.col("value"))).filter("found.guid is not null or found.error is not null").select(*keep, "found.*", "value")
    kind = F.when(F.col("role") == "ENTRY", "ENTRY").when(F.col("role") == "OUTPUT", "OUTPUT")
    if callable(config) or any(t.role == "BOTH" for t in start.topics.values()):
        kind = F.explode(F.when(F.col("role") == "BOTH", F.array(F.lit("ENTRY"), F.lit("OUTPUT"))).otherwise(F.array(kind)))
    rows = rows.withColumn("kind", kind)
    output = lambda c: F.when(F.col("kind") == "OUTPUT", F.col(c)).alias(c)
    return rows.select(*keep, "guid", output("sequence"), "kind", output("state_json"), "error", F.when(F.col("error").isNotNull(), F.col("value")).alias("value")).select(
        *keep, "guid", "sequence", "kind", F.sha2("state_json", 256).alias("state_hash"), "state_json", "error", "value"
    )


def dead_letters(observed: DataFrame) -> DataFrame:
    return observed.filter("error is not null").select("env", "topic", "ts_millis", "error", F.col("value").alias("payload"))
