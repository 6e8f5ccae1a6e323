import re

from chronoweave.llm import quality


def plain(text):
    """The base measures, word by word."""
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed,
    )


PROSE = "The quick brown fox jumps over the lazy dog while seven grey herons watch from the far bank of the river."
OTHER = "Nobody in the village could say how long the old mill had been standing empty beside that narrow road."
TEXTS = [
    None, "", " \n\t\n", PROSE, PROSE + "\n" + PROSE, "a b c d e f g h " * 10 + ".",
    "\n".join([PROSE, "Home | News | Sport | About | Contact", "All rights reserved.", "a line without an end"]),
    "x " * 7 + "y z w " + "x " * 9, "é𐍈 " * 25 + "end.", "word " * 30000 + "stop.", PROSE.replace(" ", " ### ") + " $$$",
]


def test_measures_match_a_plain_count(spark):
    rows = [(i, t, "extra", 7) for i, t in enumerate(TEXTS)] + [(1, "", "extra", 8), (None, PROSE, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    got = quality.judge_documents(docs)
    assert got.columns.count("kept") == 1 and got.columns.count("n_words") == 1
    found = got.select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert len(found) == len(rows)
    for r in found:
        assert tuple(r)[1:] == plain(r["text"])


def test_lines_fail_and_documents_lose_too_much(spark):
    page = "\n".join([PROSE, OTHER, "Home | News | Sport | About | Contact", "Privacy policy applies here.", "no end"])
    menu = "\n".join([PROSE] + ["Home | News | Sport | About | Contact | Help | More | Even more | Last"] * 6)
    docs = spark.createDataFrame([(1, page), (2, menu), (3, PROSE)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.judge_documents(docs).collect()}
    assert got[1]["n_failed_lines"] == 3 and got[1]["kept"]
    assert got[1]["clean_text"] == "\n".join([PROSE, OTHER])
    assert not got[2]["base_failed"] or got[2]["n_repeat_words"] > 0
    assert not got[2]["kept"] and got[3]["kept"] and got[3]["clean_text"] == PROSE


def test_cleaning_keeps_the_columns(spark):
    docs = spark.createDataFrame([(1, PROSE + "\nmenu", "en", "s", 9), (2, None, "en", None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = quality.clean_documents(docs)
    assert got.columns == docs.columns
    assert [(r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()] == [(1, PROSE, len(PROSE))]
    assert quality.clean_documents(docs.limit(0)).count() == 0


def test_lines_are_judged_once(spark, monkeypatch):
    calls, rule = [], quality.line_fails
    monkeypatch.setattr(quality, "line_fails", lambda x: calls.append(1) or rule(x))
    quality.judge_documents(spark.createDataFrame([(1, PROSE)], "doc_id long, text string"))
    assert len(calls) == 1


def test_line_ends_as_by_pattern(spark):
    ends = ["", ".", "!", "。", "…", '."', ".”)", ".\r", ". \t", ". ", '.") \u0085', ".  ", ".  ", " ", '"', "a)", ". a"]
    rows = [(i, "some words" + e) for i, e in enumerate(ends)]
    pattern = "[.!?:;…。！？][\"'”’»)\\]]*[\\x20\\x09-\\x0D]*$"
    got = spark.createDataFrame(rows, "i long, line string").selectExpr("*", "line").toDF("i", "line", "again")
    for r in got.select("line", quality._closed(got["line"]).alias("closed"), got["line"].rlike(pattern).alias("by_pattern")).collect():
        assert r["closed"] == r["by_pattern"], repr(r["line"])
