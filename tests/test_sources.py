"""Episodes from files: broken lines keep their text up to the failed table."""

from chronoweave.operators.episodes import normalize_episodes
from chronoweave.plans.ingest import build_graph
from chronoweave.sources.episodes import read_episodes, stream_episodes

LINES = [
    '{"uuid": "a", "name": "n", "content": "{\\"name\\": \\"x\\"}", "source": "json", "group_id": "g"}',
    '{"uuid": "b", "content": "cut off in the mid',
    "not JSON at all",
    '{"uuid": "c", "content": "kept", "source": "text", "reference_time": "no time"}',
]


def test_broken_lines_keep_their_text(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text("\n".join(LINES) + "\n")
    raw = read_episodes(spark, str(tmp_path / "in"), "json")
    got = {(r["source"], r["content"]) for r in raw.collect()}
    assert got == {("json", '{"name": "x"}'), ("json", LINES[1]), ("json", LINES[2]), ("text", "kept")}
    assert raw.count() == 4 and len(raw.select("content").collect()) == 4
    failed = build_graph(normalize_episodes(raw))["failed"].collect()
    assert {r["content"] for r in failed} == {LINES[1], LINES[2]} and all(r["error"] for r in failed)


def test_broken_lines_on_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text("\n".join(LINES) + "\n")
    rows = stream_episodes(spark, str(tmp_path / "in"))
    run = rows.writeStream.format("memory").queryName("rescued").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert LINES[2] in {r["content"] for r in spark.table("rescued").collect()}
