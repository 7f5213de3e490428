"""Repair of conversations against an exhaustive search: single ones, cut ones, and the registered query."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from wavemill.llm import dialogue, queries
from wavemill.llm.dialogue import FINAL, INF

DATA = "/root/testdata/sf0.001"
STEP = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
WANTED = ["user", "user", "assistant", "user"]


def plain_best(rows):
    """Least (cost, audit, repaired) by states from the end; rows are (role, text, fault)."""
    best = [(0, "", []), None, None, (0, "", [])]
    less = lambda x, y: y if x is None or y is not None and y[:2] < x[:2] else x

    def inserted(best):
        out = list(best)
        for _ in range(3):
            for q in range(4):
                to = out[STEP[q].get("a") or 2]
                if to is not None:
                    out[q] = less(out[q], (to[0] + 2, "I" + to[1], [(WANTED[q], ""), *to[2]]))
        return out

    best = inserted(best)
    for role, text, fault in reversed(rows):
        here = []
        for q in range(4):
            b = best[q] and (best[q][0] + 3, "D" + best[q][1], best[q][2])
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                to = STEP[q].get(role[:1])
                if to is not None and best[to] is not None:
                    b = less(b, (best[to][0] + more, "K" + best[to][1], [(role, text), *best[to][2]]))
                to = best[STEP[q].get("a") or 2]
                if to is not None:
                    b = less(b, (to[0] + 2 + more, "R" + to[1], [(WANTED[q], text), *to[2]]))
            here.append(b)
        best = inserted(here)
    return best[0]


def expected(conv, rows, tied=False):
    out = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        n = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if n == 1 else text.translate({ord(c): None for c in ".!?"}) if n == 2 else text
        out += [(turn, "user" if n == 4 else role, text)] * (0 if n == 0 else 2 if n == 3 else 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}\n{r[2]}".encode()).hexdigest()))
    seen, marked = set(), []
    for _, role, text in out:
        body = text.strip(dialogue.BLANKS)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role, text, fault))
    turns = {t for t, *_ in out if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
    cost, audit, fixed = plain_best(marked)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
    return (conv, gaps, *(sum(f == k for *_, f in marked) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest), fixed


def check(spark, df, folder):
    df.write.parquet(f"{folder}/conversations.parquet")
    by = {}
    for r in df.collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    got = {tuple(r) for r in queries.op11_dialogue(spark, str(folder)).collect()}
    assert got == {expected(c, rows)[0] for c, rows in by.items()}
    return by


def random_rows(seed, sizes):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "unicorn"]
    for c, n in enumerate(sizes):
        for t in range(n):
            text = r.choice([f"line {r.random()}.", f"line {r.random()}", "ok.", "same!", " \n", None, "end? \t"])
            yield None if c == 0 else c, None if r.random() < 0.1 else t + r.choice([0, 0, 0, 1, 5]), r.choice(roles[: r.choice([2, 3, 9])]), text


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", range(3))
def test_search_is_exhaustive(seed):
    r = random.Random(seed)
    for _ in range(150):
        codes = bytes(r.randrange(12) for _ in range(r.randint(0, 12 if seed < 2 else 70)))
        rows = [("suax"[c // 3], "", ("", "truncated", "blank")[c % 3]) for c in codes]
        cost, audit, fixed = plain_best(rows)
        if len(codes) <= dialogue.CHUNK:
            assert dialogue.search(codes, 0, FINAL, True) == (cost, audit)
        assert dialogue.edits_of(codes, 0, FINAL, True) == audit and dialogue.cost_of(codes, audit) == cost
        kept = [x for x in rows if x[2] != "blank"]
        assert [y[0][:1] for y in fixed] == [y[0][:1] for y in dialogue.apply(codes, [x[0] for x in kept], [""] * len(kept), 0, audit)]


def test_matrix_composes():
    r = random.Random(5)
    for _ in range(40):
        codes = bytes(r.randrange(12) for _ in range(r.randint(2, 60)))
        k = r.randrange(len(codes) + 1)
        a, b, whole = (dialogue.matrix(x) for x in (codes[:k], codes[k:], codes))
        assert whole == [min(INF, min(a[4 * p + m] + b[4 * m + q] for m in range(4))) for p in range(4) for q in range(4)]


def test_query_on_the_driver_table(spark, tmp_path):
    df = spark.read.parquet(f"{DATA}/conversations.parquet")
    check(spark, df.withColumns({c: F.lit(f"own {c}") for c in ("e", "part", "seq", "code", "blank", "copies", "a.b")}), tmp_path)


def test_query_on_odd_rows(spark, tmp_path):
    check(spark, spark.createDataFrame(list(random_rows(1, [6, 1, 3, 40, 8, 90, 2] * 3)), SCHEMA), tmp_path)
    assert queries.op11_dialogue(spark, str(tmp_path)).where("cost is null").count() == 0


def test_long_conversations_are_cut(spark, tmp_path, monkeypatch):
    """A conversation with most rows spans tasks and pieces; one of equal rows is a count."""
    monkeypatch.setattr(dialogue, "PIECE_ROWS", 16)
    rows = list(random_rows(2, [5, 400, 3, 130])) + [(9, 1, "user", "again.")] * 100 + [(10, None, "user", "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    by = check(spark, df, tmp_path)
    turns = {}
    for r in dialogue.repaired_turns(dialogue.damaged(df), copies_col="copies").collect():
        turns.setdefault(r.conv_id, []).append((r.position, r.role, r.text))
    for c, rows in by.items():
        assert [x[1:] for x in sorted(turns.get(c, []))] == expected(c, rows)[1]


def test_empty_table_and_conversations_without_rows(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    none.write.parquet(str(tmp_path / "conversations.parquet"))
    assert queries.op11_dialogue(spark, str(tmp_path)).collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    check(spark, spark.createDataFrame([(5, gone, "user", "x."), (6, 1, "user", "x" * 3_000_000)], SCHEMA), tmp_path / "gone")
