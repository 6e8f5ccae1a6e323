"""Table schemas and the registry of typed entities."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _TS = T.StringType(), T.TimestampType()
_VEC = T.ArrayType(T.FloatType())
_ATTRS = T.MapType(T.StringType(), T.StringType())


def _table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


# What a caller hands in: every optional argument may be null.
RAW_EPISODES = _table(
    uuid=_S, name=_S, content=_S, source=_S, source_description=_S, group_id=_S, reference_time=_TS
)
EPISODES = _table(
    uuid=_S,
    name=_S,
    content=_S,
    source=_S,
    source_description=_S,
    group_id=_S,
    reference_time=_TS,
    created_at=_TS,
)
ENTITIES = _table(
    uuid=_S,
    name=_S,
    summary=_S,
    labels=T.ArrayType(_S),
    group_id=_S,
    created_at=_TS,
    attributes=_ATTRS,
    name_embedding=_VEC,
)
FACTS = _table(
    uuid=_S,
    group_id=_S,
    source_node_uuid=_S,
    target_node_uuid=_S,
    name=_S,
    fact=_S,
    fact_embedding=_VEC,
    episodes=T.ArrayType(_S),
    created_at=_TS,
    expired_at=_TS,
    valid_at=_TS,
    invalid_at=_TS,
    attributes=_ATTRS,
)
MENTIONS = _table(episode_uuid=_S, entity_uuid=_S, group_id=_S)
POSTINGS = _table(
    kind=_S, group_id=_S, doc_uuid=_S, term=_S, tf=T.LongType(), dl=T.LongType()
)

GRAPH_TABLES: dict[str, T.StructType] = {
    "episodes": EPISODES,
    "entities": ENTITIES,
    "facts": FACTS,
    "mentions": MENTIONS,
    "postings": POSTINGS,
}

# The typed entities, their required fields, the accepted
# sources, the default group and the default result sizes.
ENTITY_TYPES: dict[str, list[str]] = {
    "Requirement": ["project_name", "description"],
    "Preference": ["category", "description"],
    "Procedure": ["description"],
}
SOURCES = ["text", "message", "json"]
DEFAULT_GROUP = "default"
DEFAULT_LIMIT = 10
CACHE_TTL_SECONDS = 300
RERANK_TOP_SCORE = 1.0
RERANK_STEP = 0.01

# The texts of messages.
QUEUED = "Episode '%s' queued for processing (position: %d)"
FACT_ERROR = "Error getting entity edge: "
AVAILABLE = "%s available"
NOT_FOUND = "%s '%s' not found. Available models: %s"
NO_MODELS = "(none)"
CHECK_SKIPPED = "%s validation skipped due to error: Missing 'models' field in response"
SHOWN_MODELS = 5
BAD_GROUP = "Group ID must be a string"
BAD_LIMIT = "%s must be a positive integer"
