"""Conversation structure repair by Knuth's lightest derivation.

What a conversation may be is the language `(s?(ua)+)?` over the initials of its
roles.  Repairing is deduction: the item (rows read, state) follows from another
by keeping, relabelling or deleting the next row or by inserting a turn, and the
item of a longer stretch follows from those of two adjacent shorter ones.  Every
deduction carries a function of (cost, audit) that is monotone and never less
than its arguments, the audit being the edits' initials, so an agenda that pops
the least item first finalises each item at its lightest derivation, and stops
when the goal is popped.

Ordinary conversations are read one at a time from partitions sorted by
(conv_id, turn).  A conversation with more than HOT_TURNS rows is cut into blocks
of BLOCK rows: Spark numbers the rows, finds the repetitions, solves the blocks
and combines them FAN at a time, level by level; no task holds all of its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.ordered import broadcast_if_small, hot_keys, with_next, with_position
from chronoweave.session import cut_lineage, scratch_path

# Costs of the edits, states and legal turns.
RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
AFTER = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ENDS = (START, ASSISTANT)
LEGAL_PAIRS = ("su", "ua", "au")
ROLES = {USER: "user", ASSISTANT: "assistant"}
BLANKS = " \t\n\x0b\x0c\r"

BLOCK = 256
FAN = 32
HOT_TURNS = 20_000

Value = tuple[int, str]


def lightest(axioms: Iterable[tuple[Value, tuple]], consequents: Callable, goals: Iterable[tuple]) -> dict[tuple, Value]:
    """Finalised items: pops the least (cost, audit) until all goals are final or nothing is left.

    `consequents(item, value, final)` yields what follows from a newly final item
    and the items that are final already.
    """
    agenda, final, open_ = [], {}, set(goals)
    for entry in axioms:
        heappush(agenda, entry)
    while agenda and open_:
        value, item = heappop(agenda)
        if item in final:
            continue
        final[item] = value
        open_.discard(item)
        for entry in consequents(item, value, final):
            if entry[1] not in final:
                heappush(agenda, entry)
    return final


def _row_deductions(codes: str) -> list[list[list[tuple[int, str, int]]]]:
    """Per row and state the deductions (cost, initial, next state) that read the row.

    A code is the initial of the row's role (x for another one), upper case if the
    row is truncated, or d if it must be deleted.
    """
    made, rows = {}, []
    for code in codes:
        if code not in made:
            extra, kind = (TRUNCATED, code.lower()) if code.isupper() else (0, code)
            by_state = []
            for state in STATES:
                moves = [(DELETE, "D", state)]
                if kind != "d":
                    for turn, to in AFTER[state].items():
                        if turn == kind:
                            moves.append((extra, "K", to))
                        elif turn != "s":
                            moves.append((extra + RELABEL, "R", to))
                by_state.append(moves)
            made[code] = by_state
        rows.append(made[code])
    return rows


def segment(codes: str, source: int, goals: Iterable[int] = STATES) -> dict[int, Value]:
    """Lightest derivations that read all rows of a stretch from state `source`, by the state they end in."""
    rows, n = _row_deductions(codes), len(codes)

    def follow(item: tuple, value: Value, final: dict) -> Iterator[tuple[Value, tuple]]:
        at, state = item
        cost, audit = value
        if at < n:
            for more, initial, to in rows[at][state]:
                yield (cost + more, audit + initial), (at + 1, to)
        for turn, to in AFTER[state].items():
            if turn != "s":
                yield (cost + INSERT, audit + "I"), (at, to)

    final = lightest([((0, ""), (0, source))], follow, [(n, q) for q in goals])
    return {q: final[n, q] for q in STATES if (n, q) in final}


Table = dict[tuple[int, int], Value]


def table(codes: str) -> Table:
    """Lightest derivations of a stretch between every two states."""
    return {(p, q): v for p in STATES for q, v in segment(codes, p).items()}


def chained(tables: list[Table], source: int) -> dict[int, tuple[Value, list[int]]]:
    """Lightest derivations over adjacent stretches from `source`, with the states between the stretches.

    A deduction has two antecedents: the stretches so far up to a state, and the next one from it.
    """
    back = {}

    def follow(item: tuple, value: Value, final: dict) -> Iterator[tuple[Value, tuple]]:
        at, state = item
        if at < len(tables):
            for q in STATES:
                if (state, q) in tables[at]:
                    more, audit = tables[at][state, q]
                    new = (value[0] + more, value[1] + audit)
                    if (at + 1, q) not in back or new < back[at + 1, q][0]:
                        back[at + 1, q] = (new, state)
                    yield new, (at + 1, q)

    final = lightest([((0, ""), (0, source))], follow, [(len(tables), q) for q in STATES])
    found = {}
    for q in STATES:
        if (len(tables), q) in final:
            via = [q]
            for at in range(len(tables), 0, -1):
                via.append(back[at, via[-1]][1])
            found[q] = (final[len(tables), q], via[::-1])
    return found


def repair(codes: str) -> Value:
    """(cost, audit) of a whole conversation; the codes are those of `_row_deductions`."""
    if len(codes) <= BLOCK:
        # the goal follows from either legal end
        rows_read = segment(codes, START, ENDS)
        return min(rows_read[q] for q in ENDS if q in rows_read)
    pieces = [table(codes[at : at + BLOCK]) for at in range(0, len(codes), BLOCK)]
    ends = chained(pieces, START)
    return min(ends[q][0] for q in ENDS if q in ends)


def _code(role: str, text: str, again: bool) -> str:
    bare = text.strip(BLANKS)
    if not bare or again:
        return "d"
    kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return kind if bare[-1] in ".!?" else kind.upper()


def _repaired(audit: str, turns: list[tuple], state: int = START) -> Iterator[tuple]:
    """(turn, role, text, edit) of the turns an audit leaves; inserted turns have no number."""
    rows = iter(turns)
    for edit in audit:
        turn, role, text = (None, "", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        to = AFTER[state][role[0]] if edit == "K" else next(q for t, q in AFTER[state].items() if t != "s")
        yield turn, role if edit == "K" else ROLES[to], text, edit
        state = to


def _sha(lines: Iterable[tuple]) -> str:
    digest = hashlib.sha256()
    for k, (_, role, text, _) in enumerate(lines):
        digest.update(f"{chr(10) if k else ''}{role}:{text}".encode())
    return digest.hexdigest()


_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURN = "place long, turn long, role string, text string, edit string"
NOTHING = hashlib.sha256(b"").hexdigest()


def _solve(turns: list[tuple]) -> tuple[tuple, list[tuple]]:
    """Summary and repaired turns of one conversation, whose (turn, role, text) are in order."""
    seen, codes, faults = set(), [], [0, 0, 0]
    for _, role, text in turns:
        code = _code(role, text, (role, text) in seen)
        seen.add((role, text))
        codes.append(code)
        if not text.strip(BLANKS):
            faults[0] += 1
        elif code == "d":
            faults[1] += 1
        elif code.isupper():
            faults[2] += 1
    initials = [role[:1] for _, role, _ in turns]
    illegal = sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:]))
    numbers = {t for t, _, _ in turns if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    cost, audit = repair("".join(codes))
    lines = list(_repaired(audit, turns))
    return (gaps, *faults, illegal, cost, audit, _sha(lines)), lines


def _walk(batches: Iterator[pa.RecordBatch], rows_out: bool) -> Iterator[pa.RecordBatch]:
    """Reads sorted rows conversation by conversation; one is held at a time."""
    names = ["conv_id", *[c.split()[0] for c in (_TURN if rows_out else _SUMMARY).split(", ")]]
    types = [pa.int64(), *[pa.string() if c.endswith("string") else pa.int64() for c in (_TURN if rows_out else _SUMMARY).split(", ")]]
    found: list[tuple] = []

    def finish(name: int | None, turns: list[tuple]) -> None:
        summary, lines = _solve(turns)
        if rows_out:
            found.extend((name, k, *line) for k, line in enumerate(lines))
        else:
            found.append((name, *summary))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*found)) or [()] * len(names)
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
        found.clear()
        return batch

    name, turns = None, []
    for batch in batches:
        for conv, turn, role, text in zip(*[c.to_pylist() for c in batch.columns]):
            if turns and conv != name:
                finish(name, turns)
                turns = []
            name = conv
            turns.append((turn, role, text))
        yield flush()
    if turns:
        finish(name, turns)
    yield flush()


def _prepared(turns: DataFrame) -> DataFrame:
    blank = F.lit(" ")
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text")
    )


def _ordinary(rows: DataFrame, rows_out: bool) -> DataFrame:
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(partial(_walk, rows_out=rows_out), f"conv_id long, {_TURN if rows_out else _SUMMARY}")


def _solve_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        entries = [
            [{"p": p, "q": q, "cost": c, "audit": a, "via": []} for (p, q), (c, a) in table(codes).items()]
            for codes in batch.column(2).to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(entries, _ENTRIES)], ["conv_id", "block", "entries"])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        entries = []
        for stretch in batch.column(2).to_pylist():
            tables = [{(e["p"], e["q"]): (e["cost"], e["audit"]) for e in part["entries"]} for part in stretch]
            entries.append([
                {"p": p, "q": q, "cost": c, "audit": a, "via": via} for p in STATES for q, ((c, a), via) in chained(tables, p).items()
            ])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(entries, _ENTRIES)], ["conv_id", "block", "entries"])


_ENTRIES = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("via", pa.list_(pa.int32()))]))
_BLOCKS = "conv_id long, block long, entries array<struct<p:int,q:int,cost:long,audit:string,via:array<int>>>"


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns of every block from its state, audit and rows."""
    for batch in batches:
        out = []
        for conv, block, state, audit, turns in zip(*[c.to_pylist() for c in batch.columns]):
            kept = _repaired(audit, [(t["turn"], t["role"], t["text"]) for t in turns], state)
            out.extend((conv, block, k, *line) for k, line in enumerate(kept))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        columns = list(zip(*out)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", "block", "k", "turn", "role", "text", "edit"])


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, repaired_sha256) from sorted rows; holds one digest, not the rows."""
    name, digest, found = None, None, []
    for batch in batches:
        for conv, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")]):
            if digest is None or conv != name:
                if digest is not None:
                    found.append((name, digest.hexdigest()))
                name, digest = conv, hashlib.sha256(f"{role}:{text}".encode())
            else:
                digest.update(f"\n{role}:{text}".encode())
    if digest is not None:
        found.append((name, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], ["conv_id", "repaired_sha256"])


def _by_conversation(left: DataFrame, right: DataFrame, how: str, *more: str) -> DataFrame:
    """Joins on conv_id, null with null, and on the columns `more`."""
    named = right.withColumnsRenamed({c: f"_r_{c}" for c in ("conv_id", *more)})
    on = F.col("conv_id").eqNullSafe(F.col("_r_conv_id"))
    for c in more:
        on = on & (F.col(c) == F.col(f"_r_{c}"))
    return left.join(named, on, how).drop(*[f"_r_{c}" for c in ("conv_id", *more)])


def _long(rows: DataFrame, hot_turns: int) -> tuple[DataFrame, DataFrame]:
    """(summary, repaired turns) of conversations too long for one task."""
    spark = rows.sparkSession
    path = scratch_path(spark, "turns")
    with_position(rows, ["conv_id"], ["turn", "role", "text"], "pos", hot_turns).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("pos", F.col("pos") - 1)
    said = F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)
    bare = F.regexp_replace("text", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    slim = placed.select(
        "conv_id", "pos", "turn", F.substring("role", 1, 1).alias("initial"), said.alias("said"), (bare == "").alias("is_blank"),
        F.substring(bare, -1, 1).isin(".", "!", "?").alias("ended"),
    )
    firsts = slim.groupBy("conv_id", "said").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    coded = _by_conversation(slim, firsts, "left", "said").withColumn("again", F.coalesce(F.col("pos") > F.col("first"), F.lit(False)))
    kind = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    code = F.when(F.col("is_blank") | F.col("again"), "d").when(F.col("ended"), kind).otherwise(F.upper(kind))
    coded = with_next(coded.withColumn("code", code), ["conv_id"], ["pos"], ["initial"], "next", hot_turns).withColumn("block", F.floor(F.col("pos") / BLOCK))
    coded = cut_lineage(coded)

    count = lambda when: F.count(F.when(when, 1))
    pair = F.concat("initial", F.col("next.initial"))
    faults = coded.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1).alias("span"),
        count(F.col("is_blank")).alias("blank"), count(~F.col("is_blank") & F.col("again")).alias("duplicate"),
        count(F.col("code").isin("S", "U", "A", "X")).alias("truncated"), count(F.col("next").isNotNull() & ~pair.isin(*LEGAL_PAIRS)).alias("illegal"),
    )
    distinct = coded.filter("turn IS NOT NULL").select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))

    codes = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]), "")
    level = coded.groupBy("conv_id", "block").agg(codes.alias("codes")).mapInArrow(_solve_blocks, _BLOCKS)
    levels = [cut_lineage(level)]
    while levels[-1].agg(F.max("block")).first()[0]:
        parts = F.sort_array(F.collect_list(F.struct("block", "entries")))
        above = levels[-1].groupBy("conv_id", F.floor(F.col("block") / FAN).alias("over")).agg(parts.alias("parts"))
        levels.append(cut_lineage(above.select("conv_id", F.col("over").alias("block"), "parts").mapInArrow(_combine, _BLOCKS)))

    # the goal, then downwards which states each stretch lies between
    entry = F.explode("entries").alias("e")
    ends = levels[-1].select("conv_id", "block", entry).filter((F.col("e.p") == START) & F.col("e.q").isin(*ENDS))
    chosen = ends.groupBy("conv_id", "block").agg(F.min(F.struct("e.cost", "e.audit", "e.p", "e.q", "e.via")).alias("e"))
    total = chosen.select("conv_id", F.col("e.cost").alias("cost"), F.col("e.audit").alias("audit"))
    chosen = cut_lineage(chosen.select("conv_id", "block", "e"))
    for below in reversed(levels[:-1]):
        wanted = chosen.select("conv_id", F.col("block").alias("over"), F.posexplode(F.slice("e.via", 1, F.size("e.via") - 1)).alias("k", "p"), F.col("e.via").alias("via"))
        wanted = wanted.select("conv_id", (F.col("over") * FAN + F.col("k")).alias("block"), "p", F.get("via", F.col("k") + 1).alias("q"))
        options = below.select("conv_id", "block", entry).select("conv_id", "block", F.col("e.p").alias("p"), F.col("e.q").alias("q"), "e")
        chosen = cut_lineage(_by_conversation(options, wanted, "inner", "block", "p", "q").select("conv_id", "block", "e"))

    line = F.sort_array(F.collect_list(F.struct("pos", "turn", "role", "text")))
    blocks = placed.groupBy("conv_id", F.floor(F.col("pos") / BLOCK).alias("block")).agg(line.alias("turns"))
    solved = _by_conversation(blocks, chosen, "inner", "block").select("conv_id", "block", F.col("e.p").alias("state"), F.col("e.audit").alias("audit"), "turns")
    out = scratch_path(spark, "repaired")
    solved.mapInArrow(_apply, "conv_id long, block long, k long, turn long, role string, text string, edit string").write.parquet(out)
    repaired = spark.read.parquet(out)
    # a digest of one text is sequential by nature; it streams through one task
    digests = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "block", "k").select("conv_id", "role", "text").mapInArrow(
        _hash_rows, "conv_id long, repaired_sha256 string"
    )
    joined = faults
    for other in (distinct, total, digests):
        joined = _by_conversation(joined, other, "left")
    summary = joined.select(
        "conv_id", F.coalesce(F.col("span") - F.col("turns"), F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256"),
    )
    numbered = with_position(repaired, ["conv_id"], ["block", "k"], "place", hot_turns).withColumn("place", F.col("place") - 1)
    return summary, numbered.select("conv_id", "place", "turn", "role", "text", "edit")


def _both(turns: DataFrame, hot_turns: int, rows_out: bool) -> DataFrame:
    rows = _prepared(turns)
    hot = hot_keys(rows, ["conv_id"], hot_turns)
    if hot is None:
        return _ordinary(rows, rows_out)
    names = broadcast_if_small(hot.select(F.col("conv_id").alias("_h")))
    is_hot = F.col("conv_id").eqNullSafe(F.col("_h"))
    return _ordinary(rows.join(names, is_hot, "left_anti"), rows_out).unionByName(_long(rows.join(names, is_hot, "left_semi"), hot_turns)[rows_out])


def repair_conversations(turns: DataFrame, hot_turns: int = HOT_TURNS) -> DataFrame:
    """One row per conversation: faults found, cost and audit of the cheapest repair, digest of its result.

    `turns` has (conv_id, turn, role, text).  Rows are taken by turn, nulls first,
    and rows of one turn by role and text, so ties and repeated rows have one order.
    A null role or text is one blank; a null conv_id is a conversation like any
    other.  Blank rows and repetitions must go; a blank row, then a repetition, then
    a truncated row is what a row counts as.  Texts of any length are kept whole.
    The digest is that of the lines `role:text`; a conversation that loses every row
    has that of the empty text.  An empty table gives no rows.  Other columns,
    whatever their names, are ignored.
    """
    return _both(turns, hot_turns, False)


def repaired_turns(turns: DataFrame, hot_turns: int = HOT_TURNS) -> DataFrame:
    """(conv_id, place, turn, role, text, edit) of the repaired conversations; inserted turns have no number.

    Nulls, ties and empty tables as in `repair_conversations`; a conversation that
    loses every row has no rows here.
    """
    return _both(turns, hot_turns, True)
