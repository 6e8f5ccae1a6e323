"""Turns, entities and relations out of episode contents.

Everything here works on one episode at a time: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions import variant as V
from chronoweave.functions.text import sentences
from chronoweave.schema import ENTITY_TYPES

# The chat roles and the statement forms that mark each type.
ROLES = ["system", "user", "assistant"]
NEED = r"(?i)^we need (.+)$"
REQUIRED = r"(?i)^(.+?) (?:is|are) required$"
MUST_HAVE = r"(?i)^(.+? must have .+)$"
LIKES = r"(?i)^i (?:like|love|enjoy|prefer) (.+)$"
DISLIKES = r"(?i)^i (?:don'?t like|do not like|hate|dislike) (.+)$"
PREFERS_OVER = r"(?i)^i prefer (.+?) over (.+)$"
STEPS = r"(?i)^first,? (.+, then .+)$"
ALWAYS = r"(?i)^always (.+?) when (.+?)(?: happens)?$"
CONDITION = r"(?i)^if (.+?) occurs,? then (.+)$"
PRIORITIES = {"critical": r"(?i)\bcritical\b", "high": r"(?i)\bhigh priority\b"}
CATEGORIES = {
    "Food": r"(?i)\b(food|tea|coffee|meal|dish|restaurant|spicy)\b",
    "Music": r"(?i)\b(music|song|album|band|concert)\b",
    "Brands": r"(?i)\b(brand|label|maker)\b",
}
OTHER_CATEGORY = "other"
ROOT = "$"
PROJECT = "Project"
NAME_KEYS = ["name", "title", "id"]


def _turns(content: Column) -> Column:
    """Turns of a chat as array<struct<role, text>>.

    A line starting with a role opens a turn, other lines continue it; text
    before the first role belongs to the user.
    """
    role = "|".join(ROLES)
    opened = F.filter(F.split(content, rf"(?i)(?:^|\n)(?=(?:{role}):)"), lambda t: t != "")

    def turn(t: Column) -> Column:
        who = F.lower(F.regexp_extract(t, rf"(?i)^({role}):", 1))
        return F.struct(
            F.when(who == "", "user").otherwise(who).alias("role"),
            F.regexp_replace(t, rf"(?i)^(?:{role}):[^\S\n]*", "").alias("text"),
        )

    return F.transform(opened, turn)


def split_turns(episodes: DataFrame) -> DataFrame:
    """turns of message episodes as (uuid, turn, role, text)."""
    chats = episodes.filter((F.col("source") == "message") & (F.col("content") != ""))
    turns = chats.select("uuid", F.posexplode(_turns(F.col("content"))).alias("turn", "_t"))
    return turns.select("uuid", F.col("turn").cast("long").alias("turn"), "_t.role", "_t.text")


_PARENT_SQL = "struct<path:string,label:string,name:string>"
_ENTRY_SQL = f"struct<value:variant,label:string,path:string,parent:{_PARENT_SQL}>"
_OBJECT_SQL = f"struct<label:string,name:string,path:string,parent:{_PARENT_SQL},attributes:map<string,string>>"
MISSING, NOT_JSON, UNREADABLE = "missing content", "content is not valid JSON", "content cannot be read: lone surrogate"
# half of a surrogate pair in an escape that is not itself escaped
_LONE = (
    r"(?<!\\)(?:\\\\)*+\\u(?:[dD][89aAbB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F])|"
    r"(?<!\\u[dD][89aAbB][0-9a-fA-F]{2}\\u)[dD][c-fC-F][0-9a-fA-F]{2})"
)
_STRINGS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


# The expressions below are SQL text: as one text they are analysed far faster than as columns built one by one.
def _let(value: str, name: str, body: str) -> str:
    """`body` with `name` standing for `value`, computed once per row."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _fields(entry: str) -> str:
    """Members of an object as (key, value, json, inner); null for anything else.

    `inner`: an object, or an array with an object somewhere inside.
    """
    is_object = "try_variant_get(m.value, '$', 'struct<>') IS NOT NULL"
    any_object = "exists(try_variant_get(m.value, '$', 'array<struct<>>'), x -> x IS NOT NULL)"
    deeper = f"startswith(j, '[') AND contains(j, '{{') AND contains(regexp_replace(j, r'{_STRINGS}', ''), '{{')"
    plain = _let("to_json(m.value)", "j", f"struct(m.key AS key, m.value AS value, j AS json, {deeper} AS inner)")
    # what will be walked is not written out as text: that would repeat a deep text once per level
    walked = "struct(m.key AS key, m.value AS value, CAST(NULL AS string) AS json, true AS inner)"
    field = f"CASE WHEN {is_object} OR coalesce({any_object}, false) THEN {walked} ELSE {plain} END"
    return f"transform(map_entries(try_variant_get({entry}.value, '$', 'map<string,variant>')), m -> {field})"


def _object_of(entry: str) -> str:
    """(found, next) of an object with members `fields`: itself, and the entries one level down."""
    named = [
        _let(
            f"get(filter(fields, f -> f.key = '{key}'), 0)", "f",
            r"""CASE WHEN NOT startswith(f.json, '"') THEN CASE WHEN f.json RLIKE '^[-0-9tf]' THEN f.json END"""
            r""" WHEN contains(f.json, '\\') THEN try_variant_get(f.value, '$', 'string') ELSE substring(f.json, 2, length(f.json) - 2) END""",
        )
        for key in NAME_KEYS
    ]
    name = f"coalesce({', '.join(named)}, CASE WHEN {entry}.path = '{ROOT}' THEN {entry}.label ELSE {entry}.path END)"
    plain = "map_from_entries(transform(filter(fields, f -> NOT f.inner), f -> struct(f.key, f.json)))"
    below = f"struct(f.value AS value, f.key AS label, concat({entry}.path, '.', f.key) AS path, struct({entry}.path AS path, {entry}.label AS label, n AS name) AS parent)"
    itself = f"struct({entry}.label AS label, n AS name, {entry}.path AS path, {entry}.parent AS parent, {plain} AS attributes)"
    return _let(name, "n", f"struct(array({itself}) AS found, transform(filter(fields, f -> f.inner), f -> {below}) AS next)")


def _elements_of(entry: str) -> str:
    """The same for an array: its elements take its key and belong to the object around it."""
    element = f"struct(v AS value, {entry}.label AS label, concat({entry}.path, '[', i, ']') AS path, {entry}.parent AS parent)"
    inner = f"transform(try_variant_get({entry}.value, '$', 'array<variant>'), (v, i) -> {element})"
    return f"struct(CAST(array() AS array<{_OBJECT_SQL}>) AS found, coalesce({inner}, CAST(array() AS array<{_ENTRY_SQL}>)) AS next)"


def _objects(parsed: str, label: str, content: str) -> Column:
    """All objects of a parsed text, level by level until no level is left.

    A text has no more levels than opening brackets; once the frontier is empty
    the remaining steps do nothing.
    """
    first = f"struct({parsed} AS value, {label} AS label, '{ROOT}' AS path, CAST(NULL AS {_PARENT_SQL}) AS parent)"
    none = f"CAST(array() AS array<{_OBJECT_SQL}>)"
    start = f"struct({none} AS found, array(struct({none} AS found, CAST(array({first}) AS array<{_ENTRY_SQL}>) AS next)) AS parts)"
    level = _let(_fields("e"), "fields", f"CASE WHEN fields IS NOT NULL THEN {_object_of('e')} ELSE {_elements_of('e')} END")
    # a transform copies what it returns, so the objects found so far must not pass through one at every level
    both = "concat(s.found, flatten(transform(s.parts, p -> p.found)))"
    step = f"CASE WHEN size(s.parts) = 0 THEN s ELSE struct({both} AS found, transform(flatten(transform(s.parts, p -> p.next)), e -> {level}) AS parts) END"
    brackets = f"length({content}) - length(translate({content}, '[{{', ''))"
    steps = f"CASE WHEN {brackets} > 0 THEN sequence(1, {brackets}) ELSE CAST(array() AS array<int>) END"
    return F.expr(f"aggregate({steps}, {start}, (s, x) -> {step}, s -> {both})")


def with_objects(episodes: DataFrame) -> DataFrame:
    """`episodes` plus `objects` (of JSON episodes) and `error` (null when the episode can be processed).

    The one place that parses contents, once each and without Python: the parsed
    text is a frontier that steps one level down at a time, as deep as the text
    goes.  A text the parser cannot read (broken, thousands of levels, lone
    surrogates) becomes an error of its row.  Narrow: no shuffle.
    """
    is_json = F.coalesce(F.lower("source") == "json", F.lit(False))
    # kept as a column of its own, so that the text is parsed once
    parsed = F.when(is_json, F.try_parse_json("content"))
    lone = is_json & F.col("content").contains("\\u") & F.col("content").rlike(_LONE)
    error = F.when(F.col("content").isNull(), MISSING).when(is_json & F.col("_parsed").isNull(), NOT_JSON).when(lone, UNREADABLE)
    judged = episodes.drop("objects", "error").withColumn("_parsed", parsed).withColumn("error", error)
    objects = F.when(is_json & F.col("error").isNull(), _objects("_parsed", "name", "content"))
    return judged.withColumn("objects", objects).drop("_parsed")


def json_objects(episodes: DataFrame) -> DataFrame:
    """Every JSON object of JSON episodes, at any depth; texts that cannot be read have none."""
    parsed = episodes if "objects" in episodes.columns else with_objects(episodes)
    # an outer inline: for the plain one the optimizer repeats the whole expression in filters
    found = parsed.select(F.col("uuid").alias("episode_uuid"), "group_id", "reference_time", F.inline_outer("objects"))
    return found.filter(F.col("path").isNotNull())


def json_entities(episodes: DataFrame) -> DataFrame:
    """each JSON object as an entity, its scalar members as attributes."""
    return json_objects(episodes).drop("parent")


def json_relations(episodes: DataFrame) -> DataFrame:
    """containment of objects as facts named after the containing key."""
    inner = json_objects(episodes).filter(F.col("parent").isNotNull())
    return inner.select(
        "episode_uuid",
        "group_id",
        "reference_time",
        F.col("parent.path").alias("source_path"),
        F.col("parent.label").alias("source_label"),
        F.col("parent.name").alias("source_name"),
        F.col("path").alias("target_path"),
        F.col("label").alias("target_label"),
        F.col("name").alias("target_name"),
        F.col("label").alias("name"),
        F.concat_ws(" ", "parent.name", "label", "name").alias("fact"),
    )


def _sentences(episodes: DataFrame) -> DataFrame:
    """Sentences of texts, and of the turns of chats with their turn and role."""
    whole = F.array(F.struct(F.lit(None).cast("string").alias("role"), F.col("content").alias("text")))
    spoken = F.when(F.col("source") == "message", _turns(F.col("content"))).otherwise(whole)
    parts = episodes.select("uuid", "group_id", "reference_time", "name", "source", "source_description", F.posexplode(spoken).alias("_at", "_part"))
    return parts.select(
        F.col("uuid").alias("episode_uuid"),
        "group_id",
        "reference_time",
        "name",
        "source_description",
        F.when(F.col("source") == "message", F.col("_at").cast("long")).alias("turn"),
        F.col("_part.role").alias("role"),
        F.posexplode(sentences(F.col("_part.text"))).alias("sentence_no", "sentence"),
    )


_FOUND = ["episode_uuid", "group_id", "reference_time", "turn", "sentence_no"]


def _match(pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract("sentence", pattern, group)
    return F.when(found != "", found)


def _requirement() -> Column:
    """What a sentence states as needed, or null."""
    return F.coalesce(_match(NEED), _match(REQUIRED), _match(MUST_HAVE))


def _project() -> Column:
    return F.when(F.trim("source_description") != "", F.col("source_description")).otherwise(F.col("name"))


def _priority() -> Column:
    return F.coalesce(*[F.when(F.col("sentence").rlike(p), F.lit(name)) for name, p in PRIORITIES.items()])


def _preferences() -> Column:
    """(description, polarity, category) of a sentence; over something is two.

    In a chat only the user's own words state a preference.
    """

    def one(what: Column, polarity: int) -> Column:
        category = [F.when(what.rlike(p), F.lit(name)) for name, p in CATEGORIES.items()]
        return F.struct(
            what.alias("description"),
            F.lit(polarity).cast("long").alias("polarity"),
            F.coalesce(*category, F.lit(OTHER_CATEGORY)).alias("category"),
        )

    own = F.coalesce(F.col("role"), F.lit("user")) == "user"
    return (
        F.when(
            own & _match(PREFERS_OVER).isNotNull(),
            F.array(one(_match(PREFERS_OVER), 1), one(_match(PREFERS_OVER, 2), -1)),
        )
        .when(own & _match(DISLIKES).isNotNull(), F.array(one(_match(DISLIKES), -1)))
        .when(own & _match(LIKES).isNotNull(), F.array(one(_match(LIKES), 1)))
    )


def _steps() -> Column:
    """The actions of a sentence in order, or null."""
    then = r"(?i),? then "
    return F.coalesce(
        F.when(_match(STEPS).isNotNull(), F.split(_match(STEPS), then)),
        F.when(_match(ALWAYS).isNotNull(), F.array(_match(ALWAYS))),
        F.when(_match(CONDITION).isNotNull(), F.split(_match(CONDITION, 2), then)),
    )


def _trigger() -> Column:
    return F.coalesce(_match(ALWAYS, 2), _match(CONDITION))


def extract_requirements(episodes: DataFrame) -> DataFrame:
    """stated needs, with their project and priority."""
    return (
        _sentences(episodes)
        .select(*_FOUND, _project().alias("project_name"), _requirement().alias("description"), _priority().alias("priority"))
        .filter(F.col("description").isNotNull())
    )


def requirement_facts(requirements: DataFrame) -> DataFrame:
    """The mandatory edge from each requirement to its project."""
    return requirements.select(
        "episode_uuid",
        "group_id",
        "reference_time",
        F.lit("Requirement").alias("source_label"),
        F.col("description").alias("source_name"),
        F.lit(PROJECT).alias("target_label"),
        F.col("project_name").alias("target_name"),
        F.lit("requirement_of").alias("name"),
        F.concat(F.col("description"), F.lit(" is a requirement of "), F.col("project_name")).alias("fact"),
    )


def extract_preferences(episodes: DataFrame) -> DataFrame:
    """likes (+1) and dislikes (-1); a preference over something is both."""
    return _sentences(episodes).select(*_FOUND, F.inline(_preferences()))


def extract_procedures(episodes: DataFrame) -> DataFrame:
    """ordered steps, one row each, with the trigger that starts them."""
    return (
        _sentences(episodes)
        .select(*_FOUND, F.col("sentence").alias("description"), _trigger().alias("trigger"),
                F.posexplode(_steps()).alias("step", "action"))
        .withColumns(
            {
                "step": (F.col("step") + 1).cast("long"),
                "action": F.regexp_replace(F.trim("action"), r"(?i)^do ", ""),
            }
        )
    )


def typed_extract(episodes: DataFrame, use_custom_entities: bool = True) -> DataFrame:
    """entities of the typed schemas as (label, name, attributes); none when off.

    All rules look at each sentence in one pass over the texts.  A procedure's
    sentence is one entity, whatever its number of steps.
    """

    def entity(label: str, name: Column, **attributes: Column) -> Column:
        pairs = [x for k, v in attributes.items() for x in (F.lit(k), v.cast("string"))]
        known = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
        return F.struct(F.lit(label).alias("label"), name.alias("name"), known.alias("attributes"))

    need, sentence = F.col("_need"), F.col("sentence")
    requirement = entity("Requirement", need, project_name=_project(), description=need, priority=_priority())
    preference = lambda p: entity(
        "Preference", p["description"], category=p["category"], description=p["description"], polarity=p["polarity"]
    )
    procedure = entity("Procedure", sentence, description=sentence, trigger=_trigger())
    none = F.array().cast("array<struct<label:string,name:string,attributes:map<string,string>>>")
    found = F.concat(
        F.when(need.isNotNull(), F.array(requirement)).otherwise(none),
        F.coalesce(F.transform("_liked", preference), none),
        F.when(_steps().isNotNull(), F.array(procedure)).otherwise(none),
    )
    whole = (
        _sentences(episodes)
        .withColumns({"_need": _requirement(), "_liked": _preferences()})
        .select("episode_uuid", "group_id", "reference_time", "turn", F.inline(found))
    )
    return whole if use_custom_entities else whole.filter(F.lit(False))


def validate_entities(
    df: DataFrame, registry: dict[str, list[str]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """F8: splits into rows with all required fields, and rejected ones with the reason.

    `df` has (label, attributes).  The registry is a literal map: no join.
    """
    registry = ENTITY_TYPES if registry is None else registry
    required = F.create_map(
        *[x for label, fields in registry.items() for x in (F.lit(label), F.array(*[F.lit(f) for f in fields]))]
    )
    missing = F.filter(
        F.coalesce(required[F.col("label")], F.array().cast("array<string>")),
        lambda f: F.col("attributes").isNull() | F.col("attributes")[f].isNull(),
    )
    reason = F.concat(F.lit("missing required fields: "), F.array_join("_missing", ", "))
    judged = df.withColumn("_missing", missing)
    valid = judged.filter(F.size("_missing") == 0).drop("_missing")
    rejected = judged.filter(F.size("_missing") > 0).withColumn("reason", reason).drop("_missing")
    return valid, rejected


def _field(members: Column, field: T.StructField) -> Column:
    """The member as the field's type, or null when it has no accepted form."""
    v = members[field.name]
    k, text = V.kind(v), V.as_text(v)
    number = k.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    if isinstance(field.dataType, T.StringType):
        return F.when(k == "STRING", text)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return F.when(number | (k == "STRING"), F.trim(text).try_cast("double"))
    if isinstance(field.dataType, (T.IntegerType, T.LongType)):
        whole = F.when(number, text.try_cast("double"))
        integral = F.when(whole == F.floor(whole), text.try_cast("decimal(38,0)").try_cast("bigint"))
        digits = F.when((k == "STRING") & F.trim(text).rlike(r"^[+-]?\d+$"), F.trim(text).try_cast("bigint"))
        return F.coalesce(F.when(number, integral), digits)
    if isinstance(field.dataType, T.BooleanType):
        return F.when(k == "BOOLEAN", text.try_cast("boolean"))
    raise ValueError(f"unsupported field type: {field.dataType.simpleString()}")


def parse_structured(df: DataFrame, content: str, schema: T.StructType) -> DataFrame:
    """adds `status` and `parsed`; rows are never dropped, contents never changed.

    status: unstructured, json_error, validation_error or ok.  Every field of
    the schema is required; other members are ignored.
    """
    # the same blanks on both ends as a text strip removes
    trimmed = F.regexp_replace(F.col(content), r"^\s+|\s+$", "")
    members = V.members(F.col("_v"))
    fields = [_field(members, f).cast(f.dataType).alias(f.name) for f in schema.fields]
    complete = F.lit(True)
    for f in schema.fields:
        complete = complete & F.col(f"_parsed.`{f.name}`").isNotNull()
    status = (
        F.when(~F.coalesce(trimmed.startswith("{"), F.lit(False)), "unstructured")
        .when(F.col("_v").isNull(), "json_error")
        .when(complete, "ok")
        .otherwise("validation_error")
    )
    return (
        df.withColumn("_v", F.try_parse_json(trimmed))
        .withColumn("_parsed", F.struct(*fields))
        .withColumn("status", status)
        .withColumn("parsed", F.when(F.col("status") == "ok", F.col("_parsed")))
        .drop("_v", "_parsed")
    )


def normalize_extracted(df: DataFrame, content: str, keep: list[str]) -> DataFrame:
    """entity lists, bare or wrapped, as rows (entity_type_id, name)."""
    v = F.col("_v")
    listed = F.when(V.kind(v) == "ARRAY", V.elements(v)).otherwise(V.elements(V.members(v)["extracted_entities"]))
    m = F.col("_m")
    return (
        df.withColumn("_v", F.try_parse_json(content))
        .select(*keep, F.posexplode(listed).alias("position", "_e"))
        .withColumn("_m", V.members(F.col("_e")))
        .filter(m.isNotNull())
        .select(
            *keep,
            F.col("position").cast("long").alias("position"),
            V.as_text(m["entity_type_id"]).try_cast("bigint").alias("entity_type_id"),
            F.coalesce(V.as_text(m["name"]), V.as_text(m["entity"])).alias("name"),
        )
    )
