"""Messages: records as key and JSON value, and back. The transport is any source or sink with these columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def encode(df: DataFrame, key: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """``key, value``: the value is the record as JSON with ISO times, null fields included."""
    key_column = F.col(f"`{key}`").cast("string") if key else F.lit(None).cast("string")
    value = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns or df.columns]), {**JSON_OPTIONS, "ignoreNullFields": "false"})
    return df.select(key_column.alias("key"), value.alias("value"))


def parse(messages: DataFrame, schema: str | T.StructType) -> DataFrame:
    """The message columns plus ``record``; null where the value is not a JSON object."""
    value = F.col("value").cast("string")
    parsed = F.from_json(value, schema, {**JSON_OPTIONS, "mode": "PERMISSIVE"})
    sound = F.coalesce(F.is_valid_utf8(value) & F.json_object_keys(value).isNotNull(), F.lit(False))
    return messages.withColumn("record", F.when(sound, parsed))


def decode(messages: DataFrame, schema: str | T.StructType) -> DataFrame:
    """Records of the readable messages."""
    return parse(messages, schema).filter(F.col("record").isNotNull()).select("record.*")


def dead_letters(messages: DataFrame, schema: str | T.StructType) -> DataFrame:
    """The messages ``decode`` skips."""
    return parse(messages, schema).filter(F.col("record").isNull()).drop("record")


def send_stats(messages: DataFrame) -> tuple[DataFrame, Observation]:
    """The messages with an observation: the counts are taken while a sink writes them."""
    seen = Observation("send_stats")
    sent = F.col("value").isNotNull()
    return messages.observe(seen, F.count(F.lit(1)).alias("total_records"), F.count_if(sent).alias("sent_records"),
                            F.count_if(~sent).alias("error_records")), seen


def write_topic(messages: DataFrame, servers: str, topic: str) -> None:
    """Send to Kafka; needs the connector package on the cluster."""
    (messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
     .option("kafka.acks", "all").option("kafka.compression.type", "snappy").save())


def read_topic(spark, servers: str, topic: str, starting: str = "earliest", per_trigger: int | None = None) -> DataFrame:
    """Stream of a topic; offsets live in the checkpoint of the query."""
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
              .option("startingOffsets", starting))
    return (reader.option("maxOffsetsPerTrigger", per_trigger) if per_trigger else reader).load()
