"""A2, A4, H: episodes and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.text import stable_id
from chronoweave.operators.ordered import HOT_ROWS, joined_in_order, with_position
from chronoweave.schema import DEFAULT_GROUP, QUEUED, SOURCES

# How a role opens a line of a rendered prompt.
PROMPT_ROLES = {"system": "System: ", "user": "User: ", "assistant": "Assistant: "}


def normalize_episodes(
    raw: DataFrame, default_group: str | None = DEFAULT_GROUP, now: Column | None = None
) -> DataFrame:
    """A2: known source types, resolved group, filled times, stable ids."""
    now = F.current_timestamp() if now is None else now
    source = F.lower("source")
    df = raw.select(
        "uuid",
        "name",
        "content",
        F.when(source.isin(SOURCES), source).otherwise(F.lit("text")).alias("source"),
        F.coalesce("source_description", F.lit("")).alias("source_description"),
        # an empty group is a group of its own; only null takes the default
        F.coalesce("group_id", F.lit("" if default_group is None else default_group)).alias("group_id"),
        F.coalesce(F.col("reference_time").cast("timestamp"), now).alias("reference_time"),
        now.alias("created_at"),
    )
    made = stable_id(F.col("group_id"), F.col("name"), F.unix_micros("reference_time"), F.col("content"))
    return df.withColumn("uuid", F.coalesce("uuid", made))


def queue_position(
    episodes: DataFrame, arrival: str = "reference_time", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """A4: 1-based place of each accepted episode in its group's queue."""
    placed = with_position(episodes, ["group_id"], [arrival, "uuid"], "position", hot_rows)
    message = F.format_string(QUEUED, "name", "position")
    return placed.withColumn("message", message)


def messages_to_prompt(
    messages: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    content: str = "text",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """H1: each conversation as one prompt; rows of other roles are left out."""
    who = F.coalesce(F.col(role), F.lit("user"))
    prefix = F.create_map(*[F.lit(x) for pair in PROMPT_ROLES.items() for x in pair])[who]
    line = F.concat(prefix, F.coalesce(F.col(content), F.lit("")))
    rows = messages.select(conv, turn, line.alias("_line"))
    return joined_in_order(rows, [conv], turn, F.col("_line"), "\n", "prompt", hot_rows=hot_rows)


def conversations_to_episodes(
    messages: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    content: str = "text",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """H2: each conversation as the content of one message episode."""
    line = F.concat(F.coalesce(F.col(role), F.lit("user")), F.lit(": "), F.coalesce(F.col(content), F.lit("")))
    rows = messages.select(conv, turn, line.alias("_line"), F.lit(1).cast("long").alias("n_turns"))
    joined = joined_in_order(
        rows,
        [conv],
        turn,
        F.col("_line"),
        "\n",
        "content",
        extra=[F.sum("n_turns").alias("n_turns")],
        hot_rows=hot_rows,
    )
    return joined.withColumn("source", F.lit("message"))
