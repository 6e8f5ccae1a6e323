import hashlib
import itertools
import random
import re
from zlib import crc32

import pytest

from chronoweave.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, cost string, gaps int"


def plain_cheapest(rows):
    """Least (cost, audit) and its lines over all edit scripts with at most three insertions."""
    best = None
    seen, must = set(), []
    for role, text in rows:
        must.append(not re.search(r"[^\x20\x09-\x0D]", text) or (role, text) in seen)
        seen.add((role, text))
    gaps = [g for k in range(4) for g in itertools.product((("user", ""), ("assistant", "")), repeat=k)]
    choices = [(("D", None), ("K", None), ("R", "user"), ("R", "assistant")) for _ in rows]
    for edits in itertools.product(*choices):
        if any(m and e[0] != "D" for m, e in zip(must, edits)):
            continue
        for places in itertools.product(*[gaps if len(rows) < 2 else gaps[:7]] * (len(rows) + 1)):
            if sum(map(len, places)) > 3:
                continue
            cost, audit, lines = 0, "", []
            for k in range(len(rows) + 1):
                for role, text in places[k]:
                    cost, audit = cost + 5, audit + "I"
                    lines.append(f"{role}:{text}")
                if k < len(rows):
                    (e, to), (role, text) = edits[k], rows[k]
                    audit += e
                    cost += {"K": 0, "R": 1, "D": 2}[e]
                    if e != "D":
                        bare = text.strip(" \t\n\v\f\r")
                        cost += 5 * (bare[-1] not in ".!?")
                        lines.append(f"{to or role}:{text}")
            if re.fullmatch("(s?(ua)+)?", "".join(x[0] if x[0] != ":" else "?" for x in lines)):
                best = min(best or (10**9,), (cost, audit, lines))
    return best


TEXTS = ["Yes.", "No", " ", "Yes.", "Well! ", "é?\n"]
ROLES = ["user", "assistant", "system", "tool", " "]


def summary(rows):
    found = repair._solve([(k, r, t) for k, (r, t) in enumerate(rows)])[0]
    return found[5], found[6], found[7]


def test_cheapest_edits_match_all_scripts():
    rnd = random.Random(4)
    for n in (0, 1, 1, 2, 2, 2, 2, 2, 3, 3):
        rows = [(rnd.choice(ROLES), rnd.choice(TEXTS)) for _ in range(n)]
        cost, audit, lines = plain_cheapest(rows)
        assert summary(rows) == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), rows


def test_agenda_equals_a_table_of_all_items():
    """Long stretches in blocks and as a whole give what relaxing all items until nothing changes gives."""
    rnd = random.Random(8)
    for n in (1, 7, 40, 300, 700):
        codes = "".join(rnd.choice("suaxSUAXd") for _ in range(n))
        rows, best = repair._row_deductions(codes), {0: (0, "")}
        for at in range(n + 1):
            for _ in range(4):
                for q, (c, a) in list(best.items()):
                    for turn, to in repair.AFTER[q].items():
                        if turn != "s":
                            best[to] = min(best.get(to, (10**9, "")), (c + 5, a + "I"))
            if at < n:
                after = {}
                for q, (c, a) in best.items():
                    for more, edit, to in rows[at][q]:
                        after[to] = min(after.get(to, (10**9, "")), (c + more, a + edit))
                best = after
        assert repair.repair(codes) == min(best[q] for q in repair.ENDS if q in best)


def conversations():
    rnd = random.Random(2)
    rows = []
    for conv in [None, *range(12)]:
        for turn in range(rnd.randint(1, 9)):
            rows.append((conv, rnd.choice([turn, turn, None]), rnd.choice([*ROLES, None]), rnd.choice([*TEXTS, None, "", "word " * 20000]), "x", 1))
    rows += rows[:4]
    for turn in range(90):  # one conversation far longer than the others
        rows.append((77, turn, ROLES[turn % 3 % 2], f"{turn % 31} says." if turn % 5 else "cut", "x", 1))
    return rows


def expected(rows):
    groups = {}
    for conv, turn, role, text, *_ in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        out[conv] = repair._solve(turns)
    return out


@pytest.mark.parametrize("hot", [10**6, 20])
def test_conversations_of_any_length(spark, monkeypatch, hot):
    monkeypatch.setattr(repair, "BLOCK", 4)
    monkeypatch.setattr(repair, "FAN", 3)
    rows = conversations()
    turns = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = expected(rows)
    got = {r[0]: tuple(r)[1:] for r in repair.repair_conversations(turns, hot).collect()}
    assert got == {c: s for c, (s, _) in want.items()}
    lines = {}
    for r in repair.repaired_turns(turns, hot).orderBy("conv_id", "place").collect():
        lines.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"], r["edit"]))
    assert lines == {c: x for c, (_, x) in want.items() if x}


def test_nothing_to_repair(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair_conversations(none).count() == 0 and repair.repaired_turns(none).count() == 0
    bare = spark.createDataFrame([(None, None, None, None, None, None)], SCHEMA)
    assert tuple(repair.repair_conversations(bare).first()) == (None, 0, 1, 0, 0, 0, 2, "D", repair.NOTHING)


def test_damage_and_lost_conversations(spark, tmp_path):
    rows = [(c, t, "user", "Hi. You!", "x", 1) for c in range(60) for t in range(2)] + [(None, None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    want = {}
    for conv, turn, role, text, *_ in rows:
        d = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept = want.setdefault(conv, [])
        role, text = role or " ", text or " "
        if d:
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            kept += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    got = {r["conv_id"]: (r["blank"], r["duplicate"], r["truncated"], r["cost"], r["audit"]) for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()}
    whole = {c: repair._solve(t)[0] if t else (0, 0, 0, 0, 0, 0, "", "") for c, t in want.items()}
    assert got == {c: (*s[1:4], s[5], s[6]) for c, s in whole.items()}
    assert any(not t for t in want.values()) or len(want) == 61
