"""The raw flow stream and its typed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.scalar import guess_flag, parse_time, with_defaults
from flowlens.schemas import FLOWS, FLOWS_RAW

MALFORMED = "_corrupt_record"
RAW = T.StructType(FLOWS_RAW.fields + [T.StructField(MALFORMED, T.StringType())])


def flow_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """JSON-lines flow files as a stream, with the declared schema.

    A record that does not fit it, such as a counter beyond 63 bits, is kept as text in ``MALFORMED``.
    ``files_per_trigger`` bounds a batch.
    """
    reader = spark.readStream.schema(RAW).option("columnNameOfCorruptRecord", MALFORMED)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def from_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """S1 for a message-bus frame: decode the JSON payload column."""
    options = {"columnNameOfCorruptRecord": MALFORMED}
    return messages.select(F.from_json(F.col(value).cast("string"), RAW, options).alias("f")).select("f.*")


def typed(raw: DataFrame) -> DataFrame:
    """The 37 typed columns; time parsed, flag as a number, optional columns defaulted."""
    parsed = raw.withColumns({
        "collected_at": parse_time("collected_at"),
        "application_is_guessed": guess_flag("application_is_guessed"),
    })
    return with_defaults(parsed).select(*[F.col(f.name).cast(f.dataType) for f in FLOWS.fields])
