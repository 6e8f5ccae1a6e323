import json

import pandas as pd
import pytest
from pyspark.sql import types as T

from chronoweave.operators import episodes as E
from chronoweave.operators import extraction as X
from chronoweave.operators.plugins import with_extractor
from tests.conftest import same

EP = "uuid string, name string, content string, source string, source_description string, group_id string, reference_time timestamp"


def ep(table, *contents, source="text", name="n", described=""):
    return table([(str(i), name, c, source, described, "g", None) for i, c in enumerate(contents)], EP)


def test_turns(table):
    df = ep(table, "user: hi\nassistant: hello\nthere\nUSER: ok", "intro\nsystem:   s", "", "user:\n\nx", source="message")
    got = [(r.uuid, r.turn, r.role, r.text) for r in X.split_turns(df).orderBy("uuid", "turn").collect()]
    assert got == [
        ("0", 0, "user", "hi"), ("0", 1, "assistant", "hello\nthere"), ("0", 2, "user", "ok"),
        ("1", 0, "user", "intro"), ("1", 1, "system", "s"),
        ("3", 0, "user", "\n\nx"),
    ]


@pytest.mark.parametrize("hot", [1_000_000, 3])
def test_turns_invert_conversations(table, hot):
    rows = [(c, t, ["user", "assistant"][t % 2], f"text {c}\nline {t}") for c in range(4) for t in range(c * 3 + 1)]
    messages = table(rows, "conv_id long, turn long, role string, text string")
    episodes = E.conversations_to_episodes(messages, hot_rows=hot).withColumnRenamed("conv_id", "uuid")
    same(X.split_turns(episodes).withColumnRenamed("uuid", "conv_id"), messages)


def test_json_objects(table):
    body = {"company": {"name": "Acme"}, "items": [{"id": "P1", "name": "Sync"}, {"id": "P2"}], "n": 1.5, "t": ["é", 2], "z": None}
    df = ep(table, json.dumps(body), "5", "not json{", '[{"title": "T"}, [{"id": 7}]]', source="JSON", name="Profile")
    got = {(r.episode_uuid, r.label, r.name, r.path): r.attributes for r in X.json_entities(df).collect()}
    assert got == {
        ("0", "Profile", "Profile", "$"): {"n": "1.5", "t": '["é",2]', "z": "null"},
        ("0", "company", "Acme", "$.company"): {"name": '"Acme"'},
        ("0", "items", "Sync", "$.items[0]"): {"id": '"P1"', "name": '"Sync"'},
        ("0", "items", "P2", "$.items[1]"): {"id": '"P2"'},
        ("3", "Profile", "T", "$[0]"): {"title": '"T"'},
        ("3", "Profile", "7", "$[1][0]"): {"id": "7"},
    }
    facts = {(r.source_name, r.name, r.target_name, r.fact) for r in X.json_relations(df).collect()}
    assert facts == {
        ("Profile", "company", "Acme", "Profile company Acme"),
        ("Profile", "items", "Sync", "Profile items Sync"),
        ("Profile", "items", "P2", "Profile items P2"),
    }


def test_json_of_any_depth(table):
    df = ep(table, '{"a": {"b": {"c": {"d": {"e": {"f": {}}}}}}}', source="json")
    assert X.json_entities(df).count() == 7
    deep = "{" + '"a": {' * 300 + '"name": "deepest"' + "}" * 301
    assert X.json_entities(ep(table, deep, source="json")).filter("name = 'deepest'").count() == 1


def test_texts_that_cannot_be_read_become_errors(table):
    from chronoweave.plans.ingest import quarantine

    bodies = ['{"x":' + "[" * 3000 + "]" * 3000 + "}", '{"name":"x\\ud800"}', '{"a": {"b": 1}}', "{", None, "[]"]
    rows = [ep(table, b, source="json").withColumn("uuid", X.F.lit(str(i))) for i, b in enumerate(bodies)]
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.unionByName(r)
    good, failed = quarantine(whole)
    assert {r["uuid"] for r in good.collect()} == {"2", "5"}
    bad = {r["uuid"]: r for r in failed.collect()}
    assert set(bad) == {"0", "1", "3", "4"} and all(r["error"] for r in bad.values())
    assert bad["1"]["content"] == bodies[1]
    assert X.json_entities(good).count() == 2


def test_chat_turns_and_lines_are_read(table):
    chat = ep(table, "user: I like tea.\nassistant: We need milk\nassistant: I like rain\nuser: - I hate mud", source="message")
    found = {(r["turn"], r["label"], r["name"]) for r in X.typed_extract(chat).collect()}
    assert found == {(0, "Preference", "tea"), (1, "Requirement", "milk"), (3, "Preference", "mud")}
    lines = ep(table, "We need milk\n\n* I like tea\r\n2) Audit is required", source="text")
    assert sorted(r["name"] for r in X.typed_extract(lines).collect()) == ["Audit", "milk", "tea"]


TEXT = (
    "We need fast search. Audit is required. Login must have 2FA. This has high priority: nothing. "
    "I prefer tea over coffee. I don't like rain! I love spicy food. "
    "First do A, then do B. Always do X when Y. If P occurs, then do Q. First mix, then bake, then eat. Always ping when it fails happens."
)


def test_typed_rules(table):
    df = ep(table, TEXT)
    needs = [(r.project_name, r.description, r.priority) for r in X.extract_requirements(df).collect()]
    assert needs == [("n", "fast search", None), ("n", "Audit", None), ("n", "Login must have 2FA", None)]
    likes = [(r.description, r.polarity, r.category) for r in X.extract_preferences(df).collect()]
    assert likes == [("tea", 1, "Food"), ("coffee", -1, "Food"), ("rain", -1, "other"), ("spicy food", 1, "Food")]
    steps = [(r.trigger, r.step, r.action) for r in X.extract_procedures(df).collect()]
    assert steps == [
        (None, 1, "A"), (None, 2, "B"), ("Y", 1, "X"), ("P", 1, "Q"),
        (None, 1, "mix"), (None, 2, "bake"), (None, 3, "eat"), ("it fails", 1, "ping"),
    ]


def test_priority_and_project(table):
    df = ep(table, "We need a critical fix.", described="Apollo")
    r = X.extract_requirements(df).first()
    assert (r.project_name, r.priority) == ("Apollo", "critical")
    f = X.requirement_facts(X.extract_requirements(df)).first()
    assert (f.source_name, f.name, f.target_name) == ("a critical fix", "requirement_of", "Apollo")


def test_typed_switch(table):
    df = ep(table, TEXT)
    on, off = X.typed_extract(df, True), X.typed_extract(df, False)
    assert on.groupBy("label").count().count() == 3 and off.count() == 0 and off.schema == on.schema
    valid, rejected = X.validate_entities(on)
    assert valid.count() == on.count() and rejected.count() == 0


def test_validation(table):
    df = table(
        [("Preference", {"description": "d"}), ("Preference", {"description": "d", "category": "c"}), ("Requirement", None), ("Any", {})],
        "label string, attributes map<string,string>",
    )
    valid, rejected = X.validate_entities(df)
    assert sorted(r.label for r in valid.collect()) == ["Any", "Preference"]
    assert {r.reason for r in rejected.collect()} == {
        "missing required fields: category",
        "missing required fields: project_name, description",
    }


GOOD = '{"name":"Ann","type":"person","confidence":0.95}'
CASES = [
    (GOOD, "ok"), (f"  \n{GOOD} ", "ok"), (GOOD[:-1] + ',"x":[1]}', "ok"), (GOOD.replace("0.95", '"0.95"'), "ok"),
    ('{"name":1,"type":"t","confidence":0.5}', "validation_error"), ('{"wrong":"x"}', "validation_error"),
    ('{"name":null,"type":"t","confidence":1}', "validation_error"), ('{"name":"a","type":"t","confidence":"x"}', "validation_error"),
    ('{"invalid": json', "json_error"), ("plain text", "unstructured"), ("", "unstructured"), (None, "unstructured"),
    ('[{"entity":"X"}]', "unstructured"), ('see: {"name":"x', "unstructured"),
]


def test_parse_structured(table):
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType()), T.StructField("confidence", T.DoubleType())])
    df = table([(i, c) for i, (c, _) in enumerate(CASES)], "i int, c string")
    rows = X.parse_structured(df, "c", schema).orderBy("i").collect()
    assert [(r.c, r.status) for r in rows] == CASES
    assert all((r.parsed is not None) == (r.status == "ok") for r in rows)
    assert {tuple(r.parsed) for r in rows if r.parsed} == {("Ann", "person", 0.95)}


def test_parse_whole_numbers(table):
    schema = T.StructType([T.StructField("n", T.LongType())])
    texts = ['{"n":3}', '{"n":3.0}', '{"n":"3"}', '{"n":3.5}', '{"n":"x"}', '{"n":9007199254740993}']
    rows = X.parse_structured(table([(i, t) for i, t in enumerate(texts)], "i int, c string"), "c", schema).orderBy("i").collect()
    assert [r.parsed and r.parsed.n for r in rows] == [3, 3, 3, None, None, 9007199254740993]


def test_extracted_lists(table):
    texts = ['[{"entity_type_id":0,"entity":"A"}]', '{"extracted_entities":[{"entity_type_id":1,"name":"B"}]}', "[]", '[{"entity_type_id":2}, 5]', "x"]
    got = X.normalize_extracted(table([(t,) for t in texts], "c string"), "c", [])
    assert sorted((r.entity_type_id, r.name) for r in got.collect() if r.name) == [(0, "A"), (1, "B")]
    assert got.filter("name is null").first().entity_type_id == 2


def test_extractor_plug(table):
    def fn(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"label": "Procedure", "attributes": [{"description": c} if c else {} for c in batch["content"]]})

    valid, rejected = with_extractor(ep(table, "x", ""), fn, "label string, attributes map<string,string>")
    assert valid.count() == 1 and rejected.first().reason == "missing required fields: description"
