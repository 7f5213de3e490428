"""Periodic runs of words: suffix trees of a stretch and of its reversal, Lyndon roots, extension both ways.

Every run holds a Lyndon word as its root, the longest that starts at its place in the order of symbols or in the
inverse one.  So the longest Lyndon words at all places, in both orders, are the candidates; each is extended to the
right by the tree of the stretch and to the left by the tree of its reversal.

Trees are built only where a run can be.  A run of ``min_length`` words and ``min_exponent`` periods is covered
without gaps by ``gram``-word strings that occur again in it, no further than a third of its length away; stretches
that are not covered so, which is most text, hold no run and need no tree.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from wavemill.llm.columns import boxed, column, unboxed
from wavemill.llm.suffix_tree import SuffixTree

#: A run: start, length and smallest period, in words.
Run = tuple[int, int, int]
RUNS = ArrayType(StructType([StructField(c, LongType()) for c in ("start", "length", "period")]))


def lyndon_ends(ranks: np.ndarray) -> np.ndarray:
    """Where the longest Lyndon word at each place ends: at the next smaller suffix."""
    r = ranks.tolist()
    n = len(r) - 1
    ends = [n] * n
    for i in range(n - 2, -1, -1):
        j, own = i + 1, r[i]
        while j < n and r[j] > own:
            j = ends[j]
        ends[i] = j
    return np.asarray(ends, np.int64)


def runs_of(symbols: np.ndarray, min_length: int = 24, min_exponent: int = 3) -> list[Run]:
    """All runs of a string with at least that length and so many smallest periods (two or more)."""
    n = len(symbols)
    if n < max(min_length, min_exponent):
        return []
    dense = np.unique(symbols, return_inverse=True)[1] + 1
    tree = SuffixTree(dense)
    i = np.concatenate([np.arange(n), np.arange(n)])
    j = np.concatenate([lyndon_ends(tree.ranks()), lyndon_ends(tree.ranks(reverse=True))])
    low = np.unique(np.stack([i, j], axis=1), axis=0)
    i, j = low[:, 0], low[:, 1]
    right = tree.extension(i, j)
    del tree
    left = SuffixTree(dense[::-1]).extension(n - i, n - j)
    start, period = i - left, j - i
    length = j + right - start
    ok = length >= np.maximum(min_length, min_exponent * period)
    return [tuple(r) for r in np.unique(np.stack([start, length, period], axis=1)[ok], axis=0).tolist()]


def _hashes(ids: np.ndarray, gram: int) -> np.ndarray:
    total = np.zeros(len(ids) - gram + 1, np.uint64)
    for k in range(gram):
        total = (total ^ ids[k : k + len(total)]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total


def stretches(ids: np.ndarray, min_length: int, min_exponent: int) -> list[tuple[int, int]]:
    """The stretches (start, end) outside which there is no run.

    With a third (1 / ``min_exponent``, if that is three or more, else one word) of ``min_length`` words as gram, every word
    of a run lies in a gram that occurs again at a distance of its period, so of at most that share of the stretch.  Distances to the neighbouring
    occurrences are no longer, and shorter stretches allow shorter distances, until nothing changes.
    """
    gram = max(1, min_length // min_exponent) if min_exponent > 2 else 1
    if len(ids) < min_length:
        return []
    h = _hashes(ids, gram)
    order = np.argsort(h, kind="stable")
    gap = np.diff(order)
    same = h[order[1:]] == h[order[:-1]]
    near = np.full(len(h), np.iinfo(np.int64).max)
    np.minimum.at(near, order[1:][same], gap[same])
    np.minimum.at(near, order[:-1][same], gap[same])
    limit = np.full(len(h), len(ids) // min_exponent)
    before = -1
    while True:
        marks = np.zeros(len(ids) + 1, np.int64)
        starts = np.flatnonzero(near <= limit)
        if not len(starts):
            return []
        marks[starts] += 1
        marks[starts + gram] -= 1
        flags = np.concatenate([[False], np.cumsum(marks)[:-1] > 0, [False]])
        edges = np.flatnonzero(flags[1:] != flags[:-1]).reshape(-1, 2)
        edges = edges[edges[:, 1] - edges[:, 0] >= min_length]
        covered = int((edges[:, 1] - edges[:, 0]).sum())
        if covered == before or not len(edges):
            return [tuple(e) for e in edges.tolist()]
        before = covered
        limit = np.full(len(h), -1)
        for s, e in edges.tolist():
            limit[s : max(s, e - gram + 1)] = (e - s) // min_exponent


def word_runs(words: list, min_length: int = 24, min_exponent: int = 3) -> list[Run]:
    """All runs of a list of words by start, then period."""
    if len(words) < min_length:
        return []
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, len(words))
    found = [(s + a, n, p) for a, b in stretches(ids, min_length, min_exponent) for s, n, p in runs_of(ids[a:b], min_length, min_exponent)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[Run]) -> list:
    """The words without those that a run holds after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        gone[s + p] += 1
        gone[s + n] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()] if runs else words


def planted(doc_id: int | None, words: list) -> list:
    """Every tenth document, by the checksum of its id, repeats a stretch of its words to its end; null ids are left."""
    n = len(words)
    if doc_id is None or n == 0:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 24, min_exponent: int = 3, edit: Callable[[int | None, list], list] | None = None
) -> DataFrame:
    """``docs`` with three columns more: ``n_words``, ``runs`` (by start, then period) and ``collapsed``, the words left, joined by blanks.

    Words are what ASCII white space separates.  ``edit`` may change the words of a document, as bytes, before the search.
    Null, empty and blank texts have no words and no runs.  Each row is judged for itself, so null ids, ties and
    repeated rows need no rule.  A text is held whole by one task.  Columns of ``docs`` named like the new ones
    are replaced; others may have any name.  An empty table gives no rows.
    """
    new = ["n_words", "runs", "collapsed"]
    old = [c for c in docs.columns if c not in new]
    rows = docs.select(boxed(docs, old), column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"))
    names = ("start", "length", "period")
    struct = pa.struct([(c, pa.int64()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(i, 256) for i in range(0, big.num_rows, 256)):
                counts, found, left = [], [], []
                for doc, text in zip(b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    words = (text or b"").split()  # of bytes: at ASCII white space
                    if edit is not None:
                        words = edit(doc, words)
                    runs = word_runs(words, min_length, min_exponent)
                    counts.append(len(words))
                    found.append([dict(zip(names, r, strict=True)) for r in runs])
                    left.append(b" ".join(collapsed(words, runs)).decode())
                cols = [b.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(struct)), pa.array(left, pa.string())]
                yield pa.record_batch(cols, names=["row", *new])

    schema = StructType([rows.schema["row"], StructField("n_words", LongType()), StructField("runs", RUNS), StructField("collapsed", StringType())])
    return rows.mapInArrow(run, schema).select(*unboxed(old), *new)
