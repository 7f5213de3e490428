"""Repair of conversation structure by iterative-deepening A*.

A conversation must read ``(s?(ua)+)?`` in the initials of its roles.  Each row is kept, given another role or deleted,
and empty rows may be inserted; the cheapest list of edits is looked for, the first in ASCII order among equals.

The search is depth first in ASCII order of the edits (D, I, K, R) under a cost bound that grows until a path is
accepted.  A path is cut where its cost and the least that the rows ahead must cost exceed the bound, or where the same
place was left without success with as much still to spend; such failures hold for every bound, so the table of
them is kept while the bound grows.

Conversations have any length.  Rows are sorted in ranges of (conversation, turn), so that a long one is spread
over tasks.  What a task holds whole it repairs at once.  A conversation that meets a border of a task, or is
large, is cut in pieces: each gives the costs between its four states at both ends, found by the same
search; these compose backwards to the cost of what follows each piece; and with that as its ending each piece is
searched once more, in order, while its text goes into the digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from wavemill.llm.columns import column
from wavemill.llm.store import Store

BLANKS = " \t\n\x0b\x0c\r"
#: Classes of initials; a row's code is three times its class plus 1 if truncated, 2 if it must go.
S, U, A, X = range(4)
#: States: nothing yet, after s, after u, after a.  What keeping a class leads to, and what an inserted or reroled row does.
KEEP = [{S: 1, U: 2}, {U: 2}, {A: 3}, {U: 2}]
NEXT = [2, 2, 3, 2]
ROLE = ["user", "user", "assistant", "user"]
INF = 1 << 30
#: Costs of ending in each state: a conversation ends before its first row or after an a.
FINAL = (0, INF, INF, 0)
#: Rows searched at once; rows and bytes of text of a piece.
CHUNK, PIECE_ROWS, PIECE_BYTES = 32, 4096, 4 << 20
LEGAL = np.zeros((4, 4), bool)
LEGAL[[S, U, A], [U, A, U]] = True


def _least(code: int) -> int:
    """What a row costs at least, whatever becomes of it."""
    kind, fault = divmod(code, 3)
    return 3 if fault == 2 else min(3, 2 + fault) if kind == X else fault


LEAST = [_least(c) for c in range(12)]


@lru_cache(maxsize=1 << 15)
def search(codes: bytes, entry: int, ending: tuple[int, ...], closing: bool) -> tuple[int, str]:
    """Cost and edits of the cheapest way through ``codes`` from a state, the ASCII-least of such.

    ``ending`` is what follows each state at the end.  Rows may be inserted after the last row only if ``closing``; so of
    two ways through a chunk neither begins with the other, and chunks joined keep the order.  INF: there is none.
    """
    n = len(codes)
    if not closing:  # nothing leads back to the first two states but an s
        some = n > 0
        first = entry == 1 or (entry == 0 and any(c // 3 == S and c % 3 < 2 for c in codes))
        reached = (entry == 0, first, some or entry == 2, some or entry == 3)
        ending = tuple(e if r else INF for e, r in zip(ending, reached, strict=True))
        if min(ending) == INF:
            return INF, ""
    ahead = [min(ending)] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + LEAST[codes[i]]
    failed: dict[int, int] = {}

    def walk(i: int, q: int, left: int) -> str | None:
        if ahead[i] > left or failed.get(4 * i + q, -1) >= left:
            return None
        if i == n:
            if ending[q] <= left:
                return ""
            if closing and (rest := walk(i, NEXT[q], left - 2)) is not None:
                return "I" + rest
        else:
            kind, fault = divmod(codes[i], 3)
            if (rest := walk(i + 1, q, left - 3)) is not None:
                return "D" + rest
            if (rest := walk(i, NEXT[q], left - 2)) is not None:
                return "I" + rest
            if fault < 2:
                to = KEEP[q].get(kind)
                if to is not None and (rest := walk(i + 1, to, left - fault)) is not None:
                    return "K" + rest
                if (rest := walk(i + 1, NEXT[q], left - 2 - fault)) is not None:
                    return "R" + rest
        failed[4 * i + q] = left
        return None

    # Deleting all rows and inserting two reaches whatever can be reached.
    most = 3 * n + 4 + max((e for e in ending if e < INF), default=0)
    for bound in range(ahead[0], most + 1):
        if (found := walk(0, entry, bound)) is not None:
            return bound, found
    return INF, ""


def final_state(codes: bytes, entry: int, edits: str) -> int:
    q, i = entry, 0
    for e in edits:
        if e == "K":
            q = KEEP[q][codes[i] // 3]
        elif e != "D":
            q = NEXT[q]
        i += e != "I"
    return q


def _chunks(codes: bytes) -> list[bytes]:
    return [codes[i : i + CHUNK] for i in range(0, len(codes), CHUNK)]


def _before(chunk: bytes, ending: tuple[int, ...]) -> tuple[int, ...]:
    """Cost of a chunk and what follows it, from each state."""
    base = min(ending)
    shifted = tuple(min(e - base, INF) for e in ending)
    return tuple(min(INF, c + base) for c in (search(chunk, q, shifted, False)[0] for q in range(4)))


def matrix(codes: bytes) -> list[int]:
    """Costs of a piece from each state to each, row by row."""
    columns = []
    for q in range(4):
        ending = tuple(0 if k == q else INF for k in range(4))
        for chunk in reversed(_chunks(codes)):
            ending = _before(chunk, ending) if min(ending) < INF else ending
        columns.append(ending)
    return [columns[q][p] for p in range(4) for q in range(4)]


def edits_of(codes: bytes, entry: int, ending: tuple[int, ...], closing: bool) -> str:
    """The edits of a piece, chunk by chunk."""
    chunks = _chunks(codes) or [b""]
    after = [ending]
    for k in range(len(chunks) - 1, 0, -1):
        last = closing and k == len(chunks) - 1
        after.append(tuple(search(chunks[k], q, ending, True)[0] for q in range(4)) if last else _before(chunks[k], after[-1]))
    out = []
    for chunk, end in zip(chunks, reversed(after), strict=True):
        last = closing and len(out) == len(chunks) - 1
        base = min(end)
        found = search(chunk, entry, tuple(min(e - base, INF) for e in end), last)[1]
        out.append(found)
        entry = final_state(chunk, entry, found)
    return "".join(out)


def cost_of(codes: bytes, edits: str) -> int:
    i, total = 0, 0
    for e in edits:
        total += 2 if e == "I" else 3 if e == "D" else codes[i] % 3 + 2 * (e == "R")
        i += e != "I"
    return total


def apply(codes: bytes, roles: list[str], texts: list[str], entry: int, edits: str) -> Iterator[tuple[str, str]]:
    """The repaired rows; ``roles`` and ``texts`` are of the rows that need not go."""
    q, i, at = entry, 0, 0
    for e in edits:
        stays = e != "I" and codes[i] % 3 < 2
        if e == "K":
            yield roles[at], texts[at]
            q = KEEP[q][codes[i] // 3]
        elif e != "D":
            yield ROLE[q], "" if e == "I" else texts[at]
            q = NEXT[q]
        i += e != "I"
        at += stays


class _Rows:
    """Rows of a conversation gathered so far, and what is counted of them."""

    def __init__(self):
        self.codes, self.roles, self.texts, self.bytes = bytearray(), [], [], 0
        self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = 0

    def add(self, turn: int | None, role: str, text: str, code: int, copies: int, blank: bool) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        fault = code % 3
        self.codes += bytes([code]) + bytes([code - fault + 2]) * (copies - 1)
        self.blank += copies * blank
        self.duplicate += 0 if blank else copies - 1 + (fault == 2)
        self.truncated += fault == 1
        if fault < 2:
            self.roles.append(role)
            self.texts.append(text)
            self.bytes += len(role) + len(text)

    def illegal(self) -> int:
        kinds = np.frombuffer(bytes(self.codes), np.uint8) // 3
        return int((~LEGAL[kinds[:-1], kinds[1:]]).sum())

    def counts(self) -> dict:
        return {"blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal()}


def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)`` after damage by the checksum of conversation and turn; a dropped row has no copies.

    Nulls are one blank each, in the checksum too.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    role = F.when(fate == 4, "user").otherwise(blank("role"))
    copies = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("long")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
PIECES = """part long, seq long, codes binary, roles array<string>, texts array<string>, costs array<long>, first long, last long, turns long"""


def _piece_stage(conv_type: pa.DataType, piece_rows: int):
    """From sorted rows: a finished row for each conversation a task holds whole, pieces of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, size = TaskContext.get().partitionId(), 0, 0
        out: list[dict] = []
        names = ["conv_id", *COUNTS, "audit", "repaired", "part", "seq", "codes", "roles", "texts", "costs", "first", "last", "turns"]
        pair = pa.struct([("role", pa.string()), ("text", pa.string())])
        many = pa.list_(pa.string())
        types = [conv_type, *[pa.int64()] * 6, pa.string(), pa.list_(pair), pa.int64(), pa.int64(), pa.binary(), many, many, pa.list_(pa.int64()), *[pa.int64()] * 3]
        schema = pa.schema(list(zip(names, types, strict=True)))

        def cut(conv, rows: _Rows) -> None:
            nonlocal seq, size
            codes = bytes(rows.codes)
            more = {"costs": matrix(codes), "first": rows.first, "last": rows.last, "turns": rows.turns}
            out.append({"conv_id": conv, **rows.counts(), "part": part, "seq": seq, "codes": codes, "roles": rows.roles, "texts": rows.texts, **more})
            seq += 1
            size += rows.bytes + len(codes)

        def close(conv, rows: _Rows) -> None:
            nonlocal size
            codes = bytes(rows.codes)
            edits = edits_of(codes, 0, FINAL, True)
            gaps = 0 if rows.first is None else rows.last - rows.first + 1 - rows.turns
            fixed = [{"role": r, "text": t} for r, t in apply(codes, rows.roles, rows.texts, 0, edits)]
            out.append({"conv_id": conv, "gaps": gaps, **rows.counts(), "cost": cost_of(codes, edits), "audit": edits, "repaired": fixed})
            size += rows.bytes

        conv, rows, open_ = None, None, True
        for b in batches:
            for c, turn, role, text, code, copies, blank in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if rows is None or c != conv:
                    if rows is not None:
                        cut(conv, rows) if open_ else close(conv, rows)
                        open_ = False
                    conv, rows = c, _Rows()
                while copies:
                    n = min(copies, piece_rows)
                    rows.add(turn, role, text, code, n, blank)
                    copies -= n
                    code = code - code % 3 + 2  # copies after the first go
                    if len(rows.codes) >= piece_rows or rows.bytes >= PIECE_BYTES:
                        cut(conv, rows)
                        rows, open_ = _Rows(), True
                if len(out) >= 512 or size >= PIECE_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
        if rows is not None:
            cut(conv, rows)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _compose(pieces: pd.DataFrame) -> pd.DataFrame:
    """What follows each piece, from each state, and the counts of the conversation at its first piece."""
    p = pieces.sort_values(["part", "seq"]).reset_index(drop=True)
    after, ending = [], FINAL
    for k in range(len(p) - 1, -1, -1):
        after.append(list(ending))
        m = [int(x) for x in p["costs"][k]]
        if k == len(p) - 1:  # rows may be inserted at the end
            ending = (0, 4, 2, 0)
        ending = tuple(min(INF, min(m[4 * a + b] + ending[b] for b in range(4))) for a in range(4))
    first = p["first"].dropna()
    gaps = 0
    if len(first):
        turns, last = 0, None
        for f, e, n in zip(p["first"], p["last"], p["turns"], strict=True):
            if not pd.isna(f):
                turns += int(n) - (last is not None and int(f) == last)
                last = int(e)
        gaps = last - int(first.iloc[0]) + 1 - turns
    kinds = [np.frombuffer(c, np.uint8) // 3 for c in p["ends"] if len(c)]
    borders = sum(not LEGAL[a[-1], b[0]] for a, b in zip(kinds, kinds[1:], strict=False))
    totals = {"gaps": gaps, **{c: int(p[c].sum()) for c in ("blank", "duplicate", "truncated", "illegal")}}
    totals["illegal"] += borders
    out = pd.DataFrame({"part": p["part"], "seq": p["seq"], "ending": after[::-1], "closing": [False] * (len(p) - 1) + [True]})
    return out.assign(**totals)


def _finish(conv_type: pa.DataType, turns: bool):
    """Pieces of a conversation in order, each searched from the state the last one left; one piece is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, conv, entry, cost, audit, digest, count = False, None, 0, 0, [], None, 0
        for big in batches:
            for b in (big.slice(i, 1) for i in range(big.num_rows)):
                r = b.to_pylist()[0]
                if not started or r["conv_id"] != conv:
                    started, conv, entry, cost, audit, digest, count = True, r["conv_id"], 0, 0, [], hashlib.sha256(), 0
                edits = edits_of(r["codes"], entry, tuple(r["ending"]), r["closing"])
                fixed = []
                for role, text in apply(r["codes"], r["roles"], r["texts"], entry, edits):
                    digest.update(f"{chr(10) if count else ''}{role}:{text}".encode())
                    if turns:
                        fixed.append((count, role, text))
                    count += 1
                cost += cost_of(r["codes"], edits)
                audit.append(edits)
                entry = final_state(r["codes"], entry, edits)
                if turns and fixed:
                    cols = [pa.array([conv] * len(fixed), conv_type), *(pa.array(list(c), t) for c, t in zip(zip(*fixed, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True))]
                    yield pa.record_batch(cols, names=["conv_id", "position", "role", "text"])
                elif not turns and r["closing"]:
                    cols = [pa.array([conv], conv_type), *(pa.array([r[c]], pa.int64()) for c in COUNTS[:-1]), pa.array([cost], pa.int64()), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])]
                    yield pa.record_batch(cols, names=["conv_id", *COUNTS, "audit", "repaired_sha256"])

    return run


#: A table of later copies of a row is broadcast up to this many rows.
FEW = 100_000


def _pieces(rows: DataFrame, store: Store) -> DataFrame:
    """``(conv_id, ...)``: conversations that are done, and pieces of the others, as one table."""
    data = F.col("text")
    e = F.md5(F.concat(F.col("role"), F.lit("\n"), data).cast("binary"))
    last = F.substring(F.rtrim(data, F.lit(BLANKS)), -1, 1)
    initial = F.substring("role", 1, 1)
    live = F.col("copies") > 0
    when: Column = F.when(initial == "s", S).when(initial == "u", U).when(initial == "a", A).otherwise(X)
    at = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    # A dropped row stands for its conversation alone; copies of a row become a count before anything is sorted.
    seen = rows.select("conv_id", F.when(live, F.col("turn")).alias("turn"), F.when(live, F.col("role")).alias("role"), F.when(live, data).alias("text"), F.when(live, e).alias("e"), "copies")
    once = seen.groupBy("conv_id", "turn", "e").agg(F.first("role").alias("role"), F.first("text").alias("text"), F.sum("copies").alias("copies"))
    repeats = seen.where(F.col("e").isNotNull() & (last != "")).groupBy("conv_id", "e").agg(F.min(at).alias("earliest"), F.max(at).alias("latest"))
    repeats = store.keep(repeats.where("earliest < latest").select(F.col("conv_id").alias("conv"), F.col("e").alias("d"), "earliest"), "repeats")
    same = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("e") == F.col("d"))
    judged = once.join(F.broadcast(repeats) if repeats.count() <= FEW else repeats, same, "left")
    blank = last == ""
    later = F.coalesce(at > F.col("earliest"), F.lit(False))
    fault = F.when(blank | later, 2).when(~last.isin(".", "!", "?"), 1).otherwise(0)
    judged = judged.select("conv_id", "turn", "role", "text", (3 * when + fault).cast("long").alias("code"), "copies", blank.alias("blank"), "e")
    # Ranges of (conversation, turn, digest): a conversation of any length is spread, and no text is a bound.
    dealt = judged.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "e").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "e").drop("e")
    kind = rows.schema["conv_id"]
    pairs = "array<struct<role:string,text:string>>"
    schema = StructType([StructField("conv_id", kind.dataType), *_fields(", ".join(f"{c} long" for c in COUNTS) + f", audit string, repaired {pairs}, " + PIECES)])
    return store.keep(dealt.mapInArrow(_piece_stage(_arrow(kind.dataType), PIECE_ROWS), schema), "pieces")


def _fields(ddl: str) -> list[StructField]:
    return StructType.fromDDL(ddl).fields


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _solve(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, copies_col: str | None, turns: bool) -> tuple[DataFrame, DataFrame]:
    """The table of conversations that are done and what comes of the pieces of the others."""
    store = Store(rows.sparkSession, "dialogue")
    text = [F.coalesce(column(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))]
    copies = F.lit(1).cast("long") if copies_col is None else column(copies_col).cast("long")
    rows = rows.select(column(conv_col).alias("conv_id"), column(turn_col).cast("long").alias("turn"), *text, copies.alias("copies"))
    table = _pieces(rows, store)
    kind = rows.schema["conv_id"]
    # Of each piece a few numbers: the 16 costs, the turns and the codes at its ends.
    ends = F.concat(F.substring("codes", 1, 1), F.substring("codes", -1, 1)).alias("ends")
    brief = table.where("part is not null").select("conv_id", "part", "seq", "costs", F.col("first").cast("string"), F.col("last").cast("string"), "turns", *COUNTS[1:-1], ends)
    after = brief.groupBy("conv_id").applyInPandas(_compose, "part long, seq long, ending array<long>, closing boolean, " + ", ".join(f"{c} long" for c in COUNTS[:-1]))
    pieces = table.where("part is not null").select("conv_id", "part", "seq", "codes", "roles", "texts").join(after, ["part", "seq"])
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    ddl = "position long, role string, text string" if turns else ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
    return table.where("part is null"), ordered.mapInArrow(_finish(_arrow(kind.dataType), turns), StructType([StructField("conv_id", kind.dataType), *_fields(ddl)]))


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """One row a conversation: ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``.

    Rows are taken by turn, nulls first; rows of one turn by a digest of role and text, so that equal ones adjoin.
    ``copies_col`` counts how often a row is there; zero only names its conversation, which then may have no rows: zeros,
    an empty audit, the digest of nothing.  A null role or text is one blank.  Null is a conversation like any other.
    Other columns are not read.  An empty table gives no rows.
    """
    done, cut = _solve(rows, conv_col, turn_col, role_col, text_col, copies_col, False)
    text = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    return done.select("conv_id", *COUNTS, "audit", F.sha2(text, 256).alias("repaired_sha256")).unionByName(cut)


def repaired_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """The repaired rows: ``conv_id``, ``position`` from 0, ``role``, ``text``; the same rules as for ``repair``."""
    done, cut = _solve(rows, conv_col, turn_col, role_col, text_col, copies_col, True)
    return done.select("conv_id", F.posexplode("repaired").alias("position", "r")).select("conv_id", F.col("position").cast("long"), "r.role", "r.text").unionByName(cut)
