"""Conversation repair: held against a plain search over all edits, short and long path alike."""

import hashlib
import re
import zlib
from functools import cache

import pytest

from maskframe.llm import conversations as C
from maskframe.llm import queries

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
STEPS = {"": "su", "s": "u", "u": "a", "a": "u"}


def damaged(conv, rows):
    out = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def brute(rows):
    """Counts and the least of all cheapest edits, by search over (row, initial before)."""
    seen, faults = set(), []
    for _, role, text in rows:
        end = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))

    @cache
    def best(i, last, put):
        """(cost, audit, lines) from row i on; ``put``: rows put in since the last one read."""
        options = []
        if i == len(rows) and last in ("", "a"):
            options.append((0, "", ()))
        if put < 3:
            options += [(c + 2, "I" + a, (f"{r}:", *x)) for r in ("user", "assistant") if r[0] in STEPS[last] for c, a, x in [best(i, r[0], put + 1)]]
        if i < len(rows):
            _, role, text = rows[i]
            c, a, x = best(i + 1, last, 0)
            options.append((c + 3, "D" + a, x))
            if faults[i] in ("", "truncated"):
                more = faults[i] == "truncated"
                for letter, cost, r in (("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")):
                    if r[:1] and r[:1] in STEPS[last]:
                        c, a, x = best(i + 1, r[:1], 0)
                        options.append((c + cost + more, letter + a, (f"{r}:{text}", *x)))
        return min(options, key=lambda o: o[:2]) if options else (10**9, "~", ())

    cost, audit, lines = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(rows):
    groups = {}
    for conv, *row in rows:
        groups.setdefault(conv, []).append(row)
    return {conv: brute(damaged(conv, r)) for conv, r in groups.items()}


def collected(df):
    assert df.columns == COLUMNS
    rows = [tuple(r) for r in df.collect()]
    out = {r[0]: r[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def made_rows():
    import random

    draw = random.Random(7)
    rows = []
    for conv in range(60):
        for turn in range(draw.randint(1, 14)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            text = draw.choice([f"Line {turn}.", "Same thing.", "no end", "end?  \n", " \t\x0b", "", None, "é!", "x" * 3000 + "."])
            rows.append((conv, draw.choice([turn, turn, turn + 3, None]), role, text))
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Yes."), (900, 3, "user", "Same."), (900, 3, "user", "Same."), (900, 3, "user", "Same.")]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("limit", [C.LIMIT, 4, 1])
def test_against_search(spark, limit):
    rows = made_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    assert collected(C.repair(C.damage(df), limit)) == expected(rows)


def test_long_conversation(spark):
    """A conversation of a third of all rows goes by chunks; so do copies of one row."""
    roles = ["user", "assistant"]
    rows = [(1, t, roles[t % 2] if t % 7 else "system", f"Say {t % 300}.") for t in range(1500)] + [(2, 5, "user", "Again.")] * 700 + [(3 + i // 4, i % 4, roles[i % 2], f"Well {i}!") for i in range(2000)]
    whole = collected(C.repair(C.damage(spark.createDataFrame(rows, SCHEMA))))
    parts = collected(C.repair(C.damage(spark.createDataFrame(rows, SCHEMA).repartition(3)), 100))
    assert whole == parts
    assert len(whole[2][6]) >= 700 or whole[2][6] == ""
    assert {k: v for k, v in whole.items() if k > 2} == {k: v for k, v in expected(rows[2200:]).items()}


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.repair(C.damage(empty)).collect() == []
    nothing = hashlib.sha256(b"").hexdigest()
    dropped = next((c, t) for c in range(100) for t in range(50) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    rows = [(dropped[0], dropped[1], "user", "Gone.")]
    extra = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", n long, audit string")
    assert collected(C.repair(C.damage(extra))) == {dropped[0]: (0, 0, 0, 0, 0, 0, "", nothing)}
    long = [(7, 0, "user", "a b " * 400_000 + "?"), (7, 1, "assistant", " " * 300_000)]
    assert collected(C.repair(C.damage(spark.createDataFrame(long, SCHEMA)))) == expected(long)


def test_states_are_few():
    machine = C.Repairs()
    assert machine.all_states() < 200


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(queries.QUERIES["op13_conversation_repair"](spark, sf)) == expected(rows)
