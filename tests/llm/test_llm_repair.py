"""Conversation repair against all edit sequences of small conversations."""
import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

SHAPE = re.compile(r"(s?(ua)+)?\Z")


def brute(rows):
    """Cheapest, ASCII-least audit by trying every one of up to two inserts per gap; rows are (initial, fault)."""
    best = None
    for letters in itertools.product("DKR", repeat=len(rows)):
        if any(f in ("blank", "duplicate") and x != "D" for x, (_, f) in zip(letters, rows)):
            continue
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            audit, options, cost = "", [""], 0
            for g, x, (i, f) in zip(gaps, list(letters) + [""], rows + [("", None)]):
                for _ in range(g):
                    audit, cost, options = audit + "I", cost + 5, [o + c for o in options for c in "ua"]
                if x:
                    audit += x
                    cost += {"D": 2, "K": 0, "R": 1}[x] + (5 if f == "truncated" and x != "D" else 0)
                    options = [o + c for o in options for c in ("" if x == "D" else i if x == "K" else "ua") or [""]]
            if any(SHAPE.match(o) for o in options) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def solve(rows):
    from seqspark.llm.op12_repair import Repair
    r = Repair()
    for i, f in rows:
        r.row(i, f)
    return r.result()


def test_repair_equals_brute_force():
    rng = random.Random(3)
    for n in range(5):
        for _ in range(12 if n == 4 else 25):
            rows = [(rng.choice("suua ax"), rng.choice([None, None, "truncated", "blank", "duplicate"])) for _ in range(n)]
            assert solve(rows) == brute(rows), rows


@pytest.mark.parametrize("chunk", [1, 2, 3, 7])
def test_chunks_do_not_change_the_answer(monkeypatch, chunk):
    """Folding the letters into ranks gives the audit that one wide integer gives."""
    from seqspark.llm import op12_repair as M
    rng = random.Random(chunk)
    cases = [[(rng.choice("suuuaa "), rng.choice([None, None, None, "truncated", "blank"])) for _ in range(rng.randint(1, 90))]
             for _ in range(60)] + [[("u", None)] * 80, [("a", None)] * 81]

    def under(c):
        monkeypatch.setattr(M, "CHUNK", c)
        monkeypatch.setattr(M, "DIGITS", 3 * c + 2)
        monkeypatch.setattr(M, "TOP", M.BITS * (3 * c + 2))
        return [solve(x) for x in cases]

    assert under(chunk) == under(200)


def test_report_and_rows(spark):
    from seqspark.llm.op12_repair import repair, repair_report, repaired_rows
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Hello!"), (1, 1, "assistant", "Hello!"), (1, 3, "user", "cut"),
            (2, None, "system", "Be."), (2, 5, "assistant", " \t"), (2, 9, "user", "Q?"), (2, 9, "user", "Q?"),
            (None, 1, None, "x."), (None, 2, "assistant", None), (4, 1, "user", "long " * 5000 + "."), (4, 2, "tool", "ok. \n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(3)).repartition(4)
    ids = df.select("conv_id").unionByName(spark.createDataFrame([(9,)], "conv_id long"))
    got = {r["conv_id"]: r for r in repair_report(ids, df).collect()}
    pick = lambda k: tuple(got[k][c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"))
    assert pick(1) == (1, 0, 1, 1, 1, 4, "KKDD")
    assert pick(2) == (3, 1, 1, 0, 2, 6, "RDRD")
    assert pick(None) == (0, 1, 0, 0, 1, 4, "DD")
    assert pick(4) == (0, 0, 0, 0, 1, 1, "KR") and pick(9) == (0, 0, 0, 0, 0, 0, "")
    sha = lambda *lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert got[1]["repaired_sha256"] == sha("user:Hi.", "assistant:Hello!")
    assert got[2]["repaired_sha256"] == sha("user:Be.", "assistant:Q?")
    assert got[9]["repaired_sha256"] == got[None]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[4]["repaired_sha256"] == sha("user:" + "long " * 5000 + ".", "assistant:ok. \n")
    out = sorted(tuple(r) for r in repaired_rows(*repair(df)).where("conv_id = 4").collect())
    assert [(r[1], r[2], r[3]) for r in out] == [(0, "K", "user"), (1, "R", "assistant")]
    empty = df.limit(0)
    assert repair_report(empty, empty).count() == 0


def test_damage(spark):
    from seqspark.llm.op12_repair import damage
    import zlib
    rows = [(c, t, "assistant", "One. Two?") for c in (*range(12), None) for t in (*range(9), None)]
    want = []
    for c, t, role, text in rows:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if d:
            row = (c, t, "user" if d == 4 else role, "" if d == 1 else "One Two" if d == 2 else text)
            want += [row] * (2 if d == 3 else 1)
    got = damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
