"""Personal data in texts, with patterns learnt from the corpus itself.

Base finders give the seeds: e-mail addresses, IP numbers, card numbers and
telephone numbers.  Every other word with a digit or an @ is a candidate, together
with such words that follow it directly.  The words left of a seed or candidate are its lexical pattern.  Patterns and
instances form a graph; in each round a pattern is worth the mean score of
what it extracts, and an instance is worth 1 - prod(1 - worth of its patterns).
Patterns of high worth, backed by several different seeds, then discover the
candidates they extract.  Base spans always stay.

Column expressions and joins only.  The graph holds one row per (pattern,
instance) after map-side combining, so a phrase in a third of the documents
is a count, not a group of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import let
from chronoweave.session import scratch_path

# The four base patterns.  The look-behinds and possessive signs
# do not change what they match; they keep long runs of one character linear.
_BLANK = r"\x20\x09-\x0D"
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without this cannot hold the kind.
_HINT = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}
# A candidate: a word with a digit or @, and those that follow it after one blank each.
_WORD = rf"[^{_BLANK}0-9@]*+[0-9@][^{_BLANK}]*+"
CANDIDATE = rf"(?<![^{_BLANK}]){_WORD}(?:\x20{_WORD})*+"
CONTEXT = "context"

# The words of a pattern are looked for in so many characters left of a candidate.
PATTERN_CHARS = 64
# Code points per piece of a text that is cut at many places.
PIECE = 1024
ROUNDS = 3
MIN_SEEDS = 3
MIN_WORTH = 0.8
DAMPING = 0.9

_SPAN = "struct<start:int,end:int,value:string,before:string>"


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running sums or maxima of an array in a logarithmic number of passes."""

    def step(acc: Column, k: Column) -> Column:
        return F.transform(acc, lambda x, i: F.coalesce(join(x, F.get(acc, i - F.call_function("shiftleft", F.lit(1), k))), x))

    steps = F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int")
    return F.aggregate(F.sequence(F.lit(0), steps - 1), values, step)


def occurrences(text: Column, regex: str) -> Column:
    """Leftmost non-overlapping matches with code point positions and the text before each."""

    def spans(parts: Column) -> Column:
        def span(m: Column, i: Column) -> Column:
            end = F.get(parts["ends"], i)
            return F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("value"), F.get(parts["between"], i).alias("before"))

        return F.transform(parts["found"], span)

    def placed(parts: Column) -> Column:
        steps = F.transform(parts["found"], lambda m, i: F.length(m) + F.length(F.get(parts["between"], i)))
        ends = let(steps, lambda x: _running(x, lambda a, b: a + b))
        return let(F.struct(parts["found"].alias("found"), parts["between"].alias("between"), ends.alias("ends")), spans)

    none = F.array().cast(f"array<{_SPAN}>")

    def with_pieces(found: Column) -> Column:
        between = F.when(F.size(found) > 0, F.split(text, regex, -1))
        parts = F.struct(found.alias("found"), between.alias("between"))
        return F.when(F.size(found) > 0, let(parts, placed)).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), with_pieces)


def _overlapped(found: Column, base: Column) -> Column:
    """For each of the ordered spans `found`, whether one of `base` overlaps it.

    That is so if the greatest end of the base spans which start before its end
    lies behind its start.
    """

    def event(at: Column, kind: int, start: Column, reach: Column) -> Column:
        return F.struct(at.alias("at"), F.lit(kind).alias("kind"), start.alias("start"), reach.alias("reach"))

    ends = F.transform(found, lambda s: event(s["end"], 0, s["start"], F.lit(-1)))
    starts = F.transform(base, lambda b: event(b["start"], 1, F.lit(-1), b["end"]))

    def flags(events: Column) -> Column:
        reach = let(F.transform(events, lambda e: e["reach"]), lambda x: _running(x, lambda a, b: F.greatest(a, b)))
        judged = let(
            reach,
            lambda r: F.transform(events, lambda e, i: F.struct(e["kind"].alias("kind"), (F.get(r, i) > e["start"]).alias("hit"))),
        )
        return F.transform(F.filter(judged, lambda j: j["kind"] == 0), lambda j: j["hit"])

    return F.when((F.size(found) > 0) & (F.size(base) > 0), let(F.array_sort(F.concat(ends, starts)), flags))


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _base(text: Column) -> Column:
    """array<struct<kind, start, end>>, by kind, then start."""
    kinds = []
    none = F.array().cast(f"array<{_SPAN}>")
    for kind, regex in KINDS.items():
        found = F.when(text.rlike(_HINT[kind]), occurrences(text, regex)).otherwise(none)
        kinds.append(_labelled(found, kind))
    return F.concat(*kinds)


def _labelled(found: Column, kind: str) -> Column:
    return F.transform(
        F.filter(found, lambda s: _valid(kind, s["value"])),
        lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )


def _context(before: Column) -> Column:
    """Up to two last words before a position, lower case, without digits."""
    near = F.lower(F.when(F.length(before) > PATTERN_CHARS, F.substring(before, -PATTERN_CHARS, PATTERN_CHARS)).otherwise(before))
    return F.regexp_replace(F.regexp_extract(near, rf"([^{_BLANK}]+[{_BLANK}]+)?[^{_BLANK}]+[{_BLANK}]*$", 0), rf"[{_BLANK}0-9]+", " ")


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` plus `_base` and `_candidates` (start, end, pattern, instance, seed)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_base", _base(whole))

    def candidate(s: Column, seed: Column) -> Column:
        bare = F.regexp_replace(s["value"], r"^[\p{Punct}&&[^+]]+|\p{Punct}+$", "")
        lead = F.length(F.regexp_extract(s["value"], r"^[\p{Punct}&&[^+]]+", 0))
        start = s["start"] + lead
        return F.struct(
            start.alias("start"), (start + F.length(bare)).alias("end"), _context(s["before"]).alias("pattern"),
            bare.alias("instance"), seed.alias("seed"),
        )

    def candidates(found: Column) -> Column:
        return let(
            F.struct(found.alias("found"), _overlapped(found, F.col("_base")).alias("seeds")),
            lambda x: F.transform(x["found"], lambda s, i: candidate(s, F.coalesce(F.get(x["seeds"], i), F.lit(False)))),
        )

    found = F.when(whole.rlike("[0-9@]"), occurrences(whole, CANDIDATE)).otherwise(F.array().cast(f"array<{_SPAN}>"))
    shaped = F.filter(let(found, candidates), lambda c: c["instance"].rlike("[0-9@]") & (F.length(F.trim(c["pattern"])) > 0))
    return out.withColumn("_candidates", shaped)


def score_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Worth of each pattern: (pattern, worth, seeds).

    `edges` has one row per (pattern, instance) with n and seed.  Scores are
    rounded to nine digits, so the order of additions decides nothing.
    """
    scored = edges.withColumn("score", F.when(F.col("seed"), 1.0).otherwise(0.0))
    worth = None
    for left in range(rounds, 0, -1):
        worth = scored.groupBy("pattern").agg(
            F.round(F.sum(F.col("n") * F.col("score")) / F.sum("n"), 9).alias("worth"),
            F.sum(F.col("seed").cast("long")).alias("seeds"),
        )
        if left > 1:
            doubt = F.sum(F.log(1 - DAMPING * F.col("worth")))
            better = (
                edges.filter(~F.col("seed"))
                .join(worth.filter(F.col("worth") > 0), "pattern")
                .groupBy("instance")
                .agg(F.round(1 - F.exp(doubt), 9).alias("_score"))
            )
            scored = edges.join(better, "instance", "left").withColumn(
                "score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("_score", F.lit(0.0)))
            )
    return worth


def find_personal_data(
    docs: DataFrame, text: str = "text", rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_worth: float = MIN_WORTH
) -> DataFrame:
    """`docs` plus `spans`: array<struct<kind, start, end>> of code points, end exclusive.

    Base spans by kind and start, then those the learnt patterns discovered
    (kind "context").  Null and empty texts hold none, an empty table gives no
    rows.  Whole texts are searched, in time near their length; of the text before
    a candidate the last PATTERN_CHARS characters are its context.  Equal rows are
    treated alike and all stay.  Columns of `docs` named like the added or the internal
    ones (with a leading underscore) are replaced.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "pii")
    # written once: three readers follow, and the row id must not change between them
    with_candidates(docs.drop("spans"), text).withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    single = rows.filter(F.size("_candidates") > 0).select("_row", F.explode("_candidates").alias("c")).select("_row", "c.*")
    graph = scratch_path(spark, "pii-graph")
    single.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")).write.parquet(graph)
    edges = spark.read.parquet(graph)
    good = score_patterns(edges, rounds).filter((F.col("worth") >= min_worth) & (F.col("seeds") >= min_seeds)).select("pattern")
    span = F.struct(F.lit(CONTEXT).alias("kind"), "start", "end")
    found = single.filter(~F.col("seed")).join(good, "pattern").groupBy("_row").agg(F.array_sort(F.collect_list(span)).alias("_more"))
    more = F.coalesce("_more", F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    return rows.join(found, "_row", "left").withColumn("spans", F.concat("_base", more)).drop("_row", "_base", "_candidates", "_more")


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] != CONTEXT)


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column) -> Column:
    """`text` with every span replaced by its kind in brackets; overlapping spans become one."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def merged(all_: Column) -> Column:
        """Overlapping spans as one, of the first one's kind."""

        def cut(x: Column) -> Column:
            firsts = F.filter(
                F.sequence(F.lit(0), F.size(all_) - 1), lambda i: (i == 0) | (F.get(all_, i)["start"] >= F.get(x["reach"], i - 1))
            )
            return let(
                firsts,
                lambda f: F.transform(
                    f,
                    lambda i, j: F.struct(
                        F.get(all_, i)["start"].alias("start"),
                        F.get(x["reach"], F.coalesce(F.get(f, j + 1), F.size(all_)) - 1).alias("end"),
                        F.get(all_, i)["kind"].alias("kind"),
                    ),
                ),
            )

        reach = let(F.transform(all_, lambda s: s["end"]), lambda e: _running(e, lambda a, b: F.greatest(a, b)))
        return let(F.struct(reach.alias("reach")), cut)

    def between(pieces: Column, start: Column, end: Column) -> Column:
        """The text from `start` to `end`, without walking over what comes before."""
        of = F.transform(
            F.sequence(F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")),
            lambda p: F.substring(
                F.get(pieces, p), F.greatest(start - p * PIECE, F.lit(0)) + 1, F.least(end - p * PIECE, F.lit(PIECE)) - F.greatest(start - p * PIECE, F.lit(0))
            ),
        )
        return F.when(end > start, F.array_join(of, "")).otherwise("")

    def rebuilt(x: Column) -> Column:
        spans_ = x["spans"]
        kept = F.transform(
            spans_,
            lambda s, i: F.concat(
                between(x["pieces"], F.coalesce(F.get(spans_, i - 1)["end"], F.lit(0)), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")
            ),
        )
        return F.concat(F.array_join(kept, ""), between(x["pieces"], F.element_at(spans_, -1)["end"], F.length(text)))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    parts = F.struct(let(ordered, merged).alias("spans"), pieces.alias("pieces"))
    return F.when(F.size(spans) > 0, let(parts, rebuilt)).otherwise(text)


def redact_documents(docs: DataFrame) -> DataFrame:
    """`docs` with personal data replaced in text and n_chars counted anew."""
    found = find_personal_data(docs)
    return found.withColumn("text", redacted(F.col("text"), F.col("spans"))).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)
