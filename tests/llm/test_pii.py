import hashlib
import re
import time
from collections import defaultdict

from pyspark.sql import functions as F

from chronoweave.llm import pii

REGEX = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 8 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, rx in REGEX.items() for m in re.finditer(rx, text or "") if valid(k, m[0])]


RUN = r"(?<![^ \t-\r])[^ \t-\r0-9@]*[0-9@][^ \t-\r]*(?: [^ \t-\r0-9@]*[0-9@][^ \t-\r]*)*"


def discovered(texts, rounds=pii.ROUNDS):
    """The bootstrapping, document by document and edge by edge."""
    found, edges = [], defaultdict(lambda: [0, False])
    for row, text in enumerate(texts):
        spans = base(text)
        for m in re.finditer(RUN, text or ""):
            last = max([e for e in (x.end() for x in re.finditer(RUN, text[: m.start()].rstrip(" ")))], default=0)
            near = text[last : m.start()][-64:].lower()
            hit = re.search(r"([^ \t-\r]+[ \t-\r]+)?[^ \t-\r]+[ \t-\r]*$", near)
            pattern = re.sub(r"[ \t-\r0-9]+", " ", hit[0]) if hit else ""
            bare = re.sub(r"^[!\"#$%&'()*,\-./:;<=>?@\[\\\]^_`{|}~]+|[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]+$", "", m[0])
            if not pattern.strip(" ") or not re.search("[0-9@]", bare):
                continue
            start = m.start() + m[0].index(bare)
            seed = any(s < m.end() and e > m.start() for _, s, e in spans)
            found.append((row, start, start + len(bare), pattern, seed))
            edges[pattern, bare][0] += 1
            edges[pattern, bare][1] |= seed
    score = {k: float(s) for k, (_, s) in edges.items()}
    worth = {}
    for left in range(rounds, 0, -1):
        sums = defaultdict(lambda: [0.0, 0, 0])
        for (p, i), (n, s) in edges.items():
            sums[p][0] += n * score[p, i]
            sums[p][1] += n
            sums[p][2] += s
        worth = {p: (round(a / b, 9), c) for p, (a, b, c) in sums.items()}
        if left > 1:
            doubt = defaultdict(lambda: 1.0)
            for (p, i), (_, s) in edges.items():
                if not s:
                    doubt[i] *= 1 - pii.DAMPING * worth[p][0]
            score = {(p, i): 1.0 if s else round(1 - doubt[i], 9) for (p, i), (_, s) in edges.items()}
    good = {p for p, (w, s) in worth.items() if w >= pii.MIN_WORTH and s >= pii.MIN_SEEDS}
    return {row: sorted(("context", a, b) for r, a, b, p, seed in found if r == row and p in good and not seed) for row in range(len(texts))}


TEXTS = [
    None, "", "nothing here", "mail a@b.c_d@e.f or x@y and z.w+q@mail.example.com. ip 1.2.3.4.5.6.7.8 and 256.1.1.1 007.1.1.255",
    "+1 (523) 555-3824, card 4111 1111 1111 1111 and 4111-1111-1111-1112 or 4111111111111111", "é𐍈 +49 30 1234567 ü 10.0.0.1",
    "a" * 60000 + "@" + "b." * 3 + " end", "1" * 50000, "1.1." * 20000, "+" * 500 + "1", "@ @. a@ @b.c 1.2.3 12 345-6",
    *[f"please write to me at user{i}@example.com today" for i in range(6)], "please write to me at agent-7781-x. thanks", "you may call me at 555-1234 now",
]


def test_spans_match_a_plain_search(spark):
    docs = spark.createDataFrame([(i, t, "old", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string, other int")
    got = pii.find_personal_data(docs).withColumn("base", pii.spans_text(pii.base_only(F.col("spans")))).collect()
    more = discovered(TEXTS)
    assert len(got) == len(TEXTS)
    for r in got:
        want = base(r["text"])
        assert [tuple(s) for s in r["spans"]] == want + more[r["doc_id"]]
        assert r["base"] == ",".join(f"{k}:{a}:{b}" for k, a, b in want)
    assert more[17] == [("context", 22, 34)]


def test_same_results_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id")
    texts = [r["text"] for r in docs.collect()]
    ids = [r["doc_id"] for r in docs.collect()]
    more = discovered(texts)
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.find_personal_data(docs).collect()}
    assert all(got[i] == base(t) + more[k] for k, (i, t) in enumerate(zip(ids, texts, strict=True)))


def test_digest_is_over_the_joined_spans(spark):
    docs = spark.createDataFrame([(1, TEXTS[5])], "doc_id long, text string")
    row = pii.find_personal_data(docs).select(F.sha2(pii.spans_text(F.col("spans")), 256).alias("h")).first()
    assert row["h"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base(TEXTS[5])).encode()).hexdigest()


def test_redaction_replaces_every_span(spark):
    docs = spark.createDataFrame([(1, "to a@b.c, card 4111 1111 1111 1111.", "en", "s", 1), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in pii.redact_documents(docs).collect()}
    assert got[1]["text"] == "to [EMAIL], card [CARD]." and got[1]["n_chars"] == 24
    assert got[2]["text"] is None
    assert pii.redact_documents(docs.limit(0)).count() == 0


def test_identifiers_in_several_parts_are_found_whole(spark):
    texts = [*[f"please write to me at user{i}@example.com today" for i in range(6)], "please write to me at 555 123 4567 or so"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in pii.redact_documents(docs).collect()}
    assert got[6] == "please write to me at [CONTEXT] or so" and got[0] == "please write to me at [EMAIL] today"


def test_long_texts_full_of_matches(spark):
    texts = ["no. 12345, " * 90_000, "a@b.c, " * 60_000, "\U0001f600 10.0.0.1 " * 3_000 + "tail"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    start = time.monotonic()
    spans = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs).select("doc_id", "spans").collect()}
    assert [tuple(s) for s in spans[1]] == base(texts[1]) and [tuple(s) for s in spans[2]] == base(texts[2])
    got = {r["doc_id"]: r["text"] for r in pii.redact_documents(docs).collect()}
    assert got == {0: texts[0], 1: "[EMAIL], " * 60_000, 2: "\U0001f600 [IP] " * 3_000 + "tail"}
    assert time.monotonic() - start < 90
