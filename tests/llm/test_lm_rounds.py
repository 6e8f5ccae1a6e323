import pyarrow as pa

from chronoweave.llm import lm


def test_rounds_share_out_what_is_asked(spark, monkeypatch):
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([False, True]), pa.array(["a b c d e " * 3, "b c f g"], pa.large_string())], ["doc_id", "held_out", "text"])
    held = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([lm._pack([rows])], pa.large_binary())], ["batch", "blob"])
    whole = {r["part"]: r for b in lm._asked([held], 7) for r in b.to_pylist()}
    turns = [[r for b in lm._asked([held], 7, t, 2) for r in b.to_pylist()] for t in range(2)]
    assert all(r["part"] % 2 == t for t in range(2) for r in turns[t])
    assert {r["part"]: r for turn in turns for r in turn} == whole

    docs = spark.createDataFrame([(i, f"some words {i % 9} of text {i % 5}\n" * 40) for i in range(300)], "doc_id long, text string")
    monkeypatch.setattr(lm, "PART_BYTES", 20_000)
    monkeypatch.setattr(lm, "BATCH_BYTES", 30_000)
    got = sorted(lm.score_documents(docs).collect())
    monkeypatch.setattr(lm, "ROUNDS", 1)
    assert len(got) == 300 and got == sorted(lm.score_documents(docs).collect())
