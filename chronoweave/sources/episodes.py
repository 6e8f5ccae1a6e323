"""A1: scans of raw episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.schema import RAW_EPISODES

FORMATS = ["parquet", "json", "text"]
_BROKEN = "_broken_line"


def _raw(df: DataFrame) -> DataFrame:
    """The raw episode columns in order; absent ones are null."""
    columns = [
        (F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in RAW_EPISODES.fields
    ]
    return df.select(*columns)


def _options(reader, fmt: str):
    """Schema and options of a reader; of a JSON line that cannot be read the text is kept."""
    if fmt != "json":
        return reader.schema(RAW_EPISODES).format(fmt)
    schema = T.StructType([*RAW_EPISODES.fields, T.StructField(_BROKEN, T.StringType())])
    return reader.schema(schema).format(fmt).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BROKEN)


def _rescued(df: DataFrame) -> DataFrame:
    """A broken line is a JSON episode with the line as its content: the quarantine names its error."""
    if _BROKEN not in df.columns:
        return df
    lost = F.col("content").isNull() & F.col(_BROKEN).isNotNull()
    rescued = {"source": F.when(lost, F.lit("json")).otherwise(F.col("source")), "content": F.coalesce("content", _BROKEN)}
    return df.withColumns(rescued).drop(_BROKEN)


def read_episodes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A1: raw episodes from Parquet, JSON lines, or text files (one episode each).

    A JSON line that cannot be read becomes an episode with its text, so no text is lost.
    """
    if fmt == "text":
        files = spark.read.text(path, wholetext=True)
        return _raw(files.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("content")))
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    return _rescued(_options(spark.read, fmt).load(path))


def stream_episodes(
    spark: SparkSession, path: str, fmt: str = "json", max_files: int | None = None
) -> DataFrame:
    """A1 as a stream: files are picked up as they arrive."""
    reader = _options(spark.readStream, fmt)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _rescued(reader.load(path))
