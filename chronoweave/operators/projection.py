"""B: projections of stored rows and cleaning jobs over raw columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.time import iso_utc

# The texts that mean true, and the suffix of compatible endpoints.
TRUE_TEXTS = ["true", "1", "yes", "on"]
URL_SUFFIX = "/v1"
URL_SCHEMES = ["http://", "https://"]


def project_node_result(entities: DataFrame) -> DataFrame:
    """B1: entity rows as search results show them."""
    no_labels = F.array().cast("array<string>")
    no_attributes = F.create_map().cast("map<string,string>")
    return entities.select(
        "uuid",
        "name",
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("labels", no_labels).alias("labels"),
        "group_id",
        iso_utc(F.col("created_at")).alias("created_at"),
        F.coalesce("attributes", no_attributes).alias("attributes"),
    )


def _with_iso_times(df: DataFrame) -> DataFrame:
    times = {
        f.name: iso_utc(F.col(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))
    }
    return df.withColumns(times) if times else df


def format_fact(facts: DataFrame) -> DataFrame:
    """B2: fact rows without their embedding, in the column or in the attributes."""
    df = facts.drop("fact_embedding")
    if "attributes" in df.columns:
        df = df.withColumn("attributes", F.map_filter("attributes", lambda k, _: k != "fact_embedding"))
    return _with_iso_times(df)


def episodes_to_json(episodes: DataFrame) -> DataFrame:
    """One JSON object per episode, nulls kept, times as ISO text."""
    df = _with_iso_times(episodes)
    whole = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.select("uuid", whole.alias("json"))


def normalized_url(url: Column, suffix: str = URL_SUFFIX, default: str | None = None) -> Column:
    """The URL without any occurrence of the suffix and without trailing slashes."""
    given = F.when((url.isNull()) | (url == ""), F.lit(default)).otherwise(url)
    return F.regexp_replace(F.replace(given, F.lit(suffix), F.lit("")), "/+$", "")


def normalize_urls(
    df: DataFrame, url: str, id: str, suffix: str = URL_SUFFIX, default: str | None = None
) -> DataFrame:
    """One row per normalised URL: first id, number of rows, scheme check."""
    native = normalized_url(F.col(url), suffix, default)
    has_scheme = F.lit(False)
    for scheme in URL_SCHEMES:
        has_scheme = has_scheme | F.col("native_url").startswith(scheme)
    return (
        df.select(native.alias("native_url"), F.col(id).alias("_id"))
        .groupBy("native_url")
        .agg(F.min("_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .withColumn("has_http_scheme", has_scheme)
    )


def _cleaned(raw: Column, kind: str, default: object, blank_is_null: bool) -> tuple[Column, Column]:
    """The typed value, and whether it fell back to the default."""
    given = F.when(F.trim(raw) != "", raw) if blank_is_null else raw
    if kind == "bool":
        value = F.lower(given).isin(TRUE_TEXTS)
        fallback = given.isNull()
        sql_type = "boolean"
    elif kind in ("int", "float"):
        sql_type = {"int": "bigint", "float": "double"}[kind]
        # '3.0' is a number but not an integer text
        text = F.when(given.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(given)) if kind == "int" else F.trim(given)
        value = text.try_cast(sql_type)
        fallback = value.isNull()
    elif kind == "str":
        value, fallback, sql_type = given, given.isNull(), "string"
    else:
        raise ValueError(f"unknown column type: {kind}")
    return F.coalesce(value, F.lit(default).cast(sql_type)), fallback


def clean_columns(
    df: DataFrame, spec: dict[str, tuple[str, object, bool]]
) -> tuple[DataFrame, DataFrame]:
    """Casts raw text columns by `column -> (type, default, blank_is_null)`.

    Returns the typed table and, per column, how many values fell back.
    """
    cleaned = {c: _cleaned(F.col(c), *rule) for c, rule in spec.items()}
    typed = df.withColumns({c: value for c, (value, _) in cleaned.items()})
    counted = df.agg(*[F.count_if(fallback).alias(c) for c, (_, fallback) in cleaned.items()])
    counts = counted.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("fallbacks")) for c in spec])
        ).alias("r")
    ).select("r.*")
    return typed, counts
