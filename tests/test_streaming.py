import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronoweave.operators.episodes import normalize_episodes
from chronoweave.operators.folds import lifecycle, ttl_cache
from chronoweave.plans.ingest import build_graph, quarantine
from chronoweave.schema import GRAPH_TABLES, RAW_EPISODES
from chronoweave.sources.episodes import read_episodes, stream_episodes
from chronoweave.sources.graph import read_graph, read_table, write_graph, write_table
from chronoweave.streaming.ingest import dedup_episodes, ingest_batch, materialize, quarantine_stream, stream_ingest
from chronoweave.streaming.keyed import lifecycle_stream, sequence_by_group, ttl_cache_stream
from tests.conftest import same

T0 = datetime(2024, 1, 1)


def now():
    return F.lit("2025-01-01").cast("timestamp")


RAW = RAW_EPISODES.simpleString()[7:-1].replace(":", " ")


def episode(i, group, body, source="text", uuid=None):
    return (uuid or f"e{i:03d}", f"n{i}", body, source, "", group, T0 + timedelta(minutes=i))


def put(df, path, fmt="json"):
    df.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").format(fmt).save(path)


BODIES = [
    ('{"company": {"name": "Acme"}}', "json"), ("We need speed. I prefer tea over rum.", "text"), ("{bad", "json"),
    (None, "text"), ("user: hi\nassistant: yo", "message"), ("First a, then b.", "text"),
]


def test_stream_gives_the_batch_graph(table, spark, tmp_path):
    rows = [episode(i, f"g{i % 3}", *BODIES[i % len(BODIES)]) for i in range(24)]
    inbox, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    for part in (rows[:9], rows[9:], rows[5:12]):  # the last ones are repetitions
        put(table(part, RAW), inbox)
        stream_ingest(spark, inbox, out, ckpt, now=now()).awaitTermination()
    got = materialize(spark, out)
    want = build_graph(normalize_episodes(table(rows, RAW), now=now()))
    assert want["failed"].count() == 8 and want["facts"].count() > 0
    for name in ("episodes", "entities", "facts", "mentions"):
        if name == "entities":
            flat = lambda d: d.withColumn("attributes", F.to_json("attributes"))
            same(flat(want[name]), flat(got[name]))
        else:
            same(want[name], got[name])
    assert {(r.uuid, r.error) for r in got["failed"].collect()} == {(r.uuid, r.error) for r in want["failed"].collect()}


def test_folding_news_into_a_stored_graph(table, spark, tmp_path):
    rows = [episode(i, f"g{i % 3}", *BODIES[i % len(BODIES)]) for i in range(24)]
    out, kept = str(tmp_path / "out"), str(tmp_path / "kept")
    flat = lambda d: d.withColumn("attributes", F.to_json("attributes")) if "attributes" in d.columns else d
    ingest_batch(table(rows[:12], RAW), 0, out, now=now())
    for name, df in materialize(spark, out).items():
        df.write.parquet(f"{kept}/{name}")
    ingest_batch(table(rows[12:], RAW), 1, out, now=now())
    base = {n: spark.read.parquet(f"{kept}/{n}") for n in ("episodes", "entities", "facts", "mentions")}
    news = materialize(spark, out, base=base, after=0)
    whole = materialize(spark, out)
    for name in base:
        same(flat(whole[name]), flat(news[name]))


def test_replayed_batch_changes_nothing(table, spark, tmp_path):
    raw = table([episode(i, "g", *BODIES[i % 2]) for i in range(4)], RAW)
    out = str(tmp_path)
    counts = []
    for _ in range(2):
        ingest_batch(raw, 0, out, now=now())
        counts.append({n: d.count() for n, d in materialize(spark, out).items()})
    assert counts[0] == counts[1]


def test_bad_episode_holds_up_nobody(table, spark, tmp_path):
    inbox, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    put(table([episode(0, "g", "{bad", "json"), episode(1, "g", "{}", "json"), episode(2, "g", None)], RAW), inbox)
    quarantine_stream(stream_episodes(spark, inbox), out, ckpt).awaitTermination()
    assert [r.uuid for r in spark.read.parquet(f"{out}/ok").collect()] == ["e001"]
    assert {r.uuid: r.error for r in spark.read.parquet(f"{out}/failed").collect()} == {
        "e000": "content is not valid JSON", "e002": "missing content",
    }


def test_edge_contents_survive(table):
    bodies = ["", "A" * 10_000, "🎉 é 漢字 العربية"]
    good, failed = quarantine(normalize_episodes(table([episode(i, "g", b) for i, b in enumerate(bodies)], RAW)))
    assert sorted(r.content for r in good.collect()) == sorted(bodies) and failed.count() == 0


@pytest.mark.parametrize("hot", [10**6, 8])
def test_sequence_has_no_gaps(table, spark, tmp_path, hot):
    rnd = random.Random(1)
    rows = [episode(i, rnd.choice(["hot", "hot", "b"]), "x") for i in range(90)]
    inbox, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    for part in (rows[:20], rows[20:70], rows[70:]):
        put(table(part, RAW), inbox)
        sequence_by_group(stream_episodes(spark, inbox), out, ckpt, hot_rows=hot).awaitTermination()
    got = {r.uuid: r.sequence for r in spark.read.parquet(f"{out}/rows").collect()}
    seen = {}
    for r in rows:
        seen[r[5]] = seen.get(r[5], 0) + 1
        assert got[r[0]] == seen[r[5]]


def test_dedup(table, spark, tmp_path):
    rows = [episode(0, "g", "first", uuid="u"), episode(9, "g", "second", uuid="u"), episode(1, "g", "x", uuid="v")]
    df = table(rows, RAW)
    assert {r.uuid: r.content for r in dedup_episodes(df).collect()} == {"u": "first", "v": "x"}
    inbox, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    for part in (rows, rows):
        put(table(part, RAW), inbox)
        stream = dedup_episodes(stream_episodes(spark, inbox), "1 day")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.uuid for r in spark.read.parquet(out).collect()) == ["u", "v"]


def run_parts(spark, df, tmp_path, start):
    """Feeds a table in three parts, in time order, and reads what comes out."""
    inbox, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    cuts = [T0 + timedelta(minutes=m) for m in (15, 30)]
    for part in (df.filter(F.col("ts") <= cuts[0]), df.filter((F.col("ts") > cuts[0]) & (F.col("ts") <= cuts[1])), df.filter(F.col("ts") > cuts[1])):
        put(part, inbox, "parquet")
        start(spark.readStream.schema(df.schema).parquet(inbox), out, ckpt).awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@pytest.mark.parametrize("hot", [10**6, 20])
def test_cache_stream_is_the_batch(table, spark, tmp_path, hot):
    rnd = random.Random(2)
    big = 2**60  # ids that a double cannot hold
    rows = [(rnd.choice("aaab"), T0 + timedelta(seconds=rnd.randrange(3000)), big + i) for i in range(150)]
    df = table(rows, "k string, ts timestamp, id long").unionByName(table([(None, T0, 5), ("a", T0, None), (None, T0, 6)], "k string, ts timestamp, id long"))
    got = run_parts(spark, df, tmp_path, lambda s, out, ckpt: ttl_cache_stream(s, out, ckpt, "k", "ts", "id", 300, hot))
    same(ttl_cache(df, "k", "ts", "id", 300), got.drop("batch_id"))


def test_cache_stream_keeps_rows_without_a_time(table, spark, tmp_path):
    df = table([("a", None, 1), ("b", None, 2)], "k string, ts timestamp, id long")
    inbox, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    put(df, inbox, "parquet")
    ttl_cache_stream(spark.readStream.schema(df.schema).parquet(inbox), out, ckpt, "k", "ts", "id", 300).awaitTermination()
    assert sorted((r.id, r.hit, r.served_from) for r in spark.read.parquet(f"{out}/rows").collect()) == [(1, False, None), (2, False, None)]


def test_state_is_sparks_and_expires(table, spark, tmp_path):
    rows = [(k, T0 + timedelta(minutes=m), m) for m in (0, 1, 200, 400) for k in ("ab" if m < 2 else "b")]
    df = table(rows, "k string, ts timestamp, id long")
    inbox, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    for m in (0, 1, 200, 400):
        put(df.filter(F.col("id") == m), inbox, "parquet")
        ttl_cache_stream(spark.readStream.schema(df.schema).parquet(inbox), out, ckpt, "k", "ts", "id", 300).awaitTermination()
    state = spark.read.format("statestore").option("stateVarName", "entry").load(f"{ckpt}/state")
    # the entry of a, which nothing has used since, is gone
    assert {r["key"]["k"] for r in state.collect()} == {"b"}


def test_lifecycle_stream_is_the_batch(table, spark, tmp_path):
    rnd = random.Random(3)
    rows = [(f"k{rnd.randrange(60)}", T0 + timedelta(minutes=rnd.randrange(50)), i, rnd.choice(["start", "complete", "start", "complete", "fail"]), f"m{i}") for i in range(200)]
    df = table(rows, "key string, ts timestamp, id long, event string, message string")
    got = run_parts(spark, df, tmp_path, lambda s, out, ckpt: lifecycle_stream(s, out, ckpt, "key"))
    columns = ["state", "start_time", "completion_time", "error"]
    last = got.groupBy("key").agg(F.max_by(F.struct(*columns), "batch_id").alias("r")).select("key", "r.*")
    same(lifecycle(df, ["key"]).select("key", *columns), last)


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_read_episodes(table, spark, tmp_path, fmt):
    df = table([episode(1, "", "a\nb 漢"), episode(2, None, None)], RAW)
    put(df, str(tmp_path / "e"), fmt)
    same(df, read_episodes(spark, str(tmp_path / "e"), fmt))


def test_read_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    r = read_episodes(spark, str(tmp_path), "text").first()
    assert (r.name, r.content, r.uuid) == ("a.txt", "one\ntwo", None)
    with pytest.raises(ValueError):
        read_episodes(spark, str(tmp_path), "avro")


def test_graph_round_trip(table, spark, tmp_path):
    path = str(tmp_path / "g")
    tables = {n: spark.createDataFrame([], s) for n, s in GRAPH_TABLES.items()}
    episodes = table([("1", "a", "x", "text", "", "g1", T0, T0), ("2", "b", "y", "text", "", "", T0, T0), ("3", "c", "z", "text", "", "g2", T0, T0)], GRAPH_TABLES["episodes"])
    write_graph({**tables, "episodes": episodes}, path, buckets=16)
    back = read_graph(spark, path, buckets=16)
    same(episodes, back["episodes"])
    assert back["facts"].schema == GRAPH_TABLES["facts"] and back["facts"].count() == 0
    one = read_table(spark, f"{path}/episodes", GRAPH_TABLES["episodes"], ["g1"], 16)
    assert [r.uuid for r in one.collect()] == ["1"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(group_bucket" in plan or "PartitionFilters: [(group_bucket" in plan


def test_rewriting_a_group_keeps_the_others(table, spark, tmp_path):
    path, schema = str(tmp_path / "t"), GRAPH_TABLES["mentions"]
    write_table(table([("e1", "n", "a"), ("e2", "n", "b")], schema), path, 64)
    write_table(table([("e9", "n", "a")], schema), path, 64)
    assert sorted(r.episode_uuid for r in read_table(spark, path, schema, buckets=64).collect()) == ["e2", "e9"]
    write_table(table([], schema), path, 64, whole=True)
    assert read_table(spark, path, schema, buckets=64).count() == 0
