"""Language identification by prediction by partial matching.

Each language has a context tree of bytes up to ``order`` long with counts from labelled texts.  A
byte is coded in the longest known context in which it was seen; each longer known context
costs its escape.  With escape method C a context seen n times before d different bytes gives a
byte that came c times c / (n + d), and the escape d / (n + d); below all contexts a byte
costs 8 bits.  The statistics are frozen, so the code length of a text is a sum over its bytes,
and the language with the shortest code is predicted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from wavemill.llm.columns import boxed, column, texts, unboxed

#: Bytes scored at a time.
SPAN = 1 << 19
ASCII_LETTER = re.compile("[A-Za-z]")
EMPTY = np.uint64((1 << 64) - 1)


def has_letter(text: str | None) -> bool:
    return bool(text) and (ASCII_LETTER.search(text) is not None or any(c.isalpha() for c in text))


class _Table:
    """Rows of numbers by integer key, in an open-addressed array of keys."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys, self.at, self.rows = np.full(1 << bits, EMPTY), np.zeros(1 << bits, np.int32), rows
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == EMPTY
            here = left[free]
            _, first = np.unique(slot[here], return_index=True)
            here = here[first]
            self.keys[slot[here]], self.at[slot[here]] = keys[here], here
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + np.uint64(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key, -1 where there is none."""
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.at[slot], -1)
        left = np.flatnonzero((seen != keys) & (seen != EMPTY))
        while len(left):
            slot[left] = (slot[left] + np.uint64(1)) & self.mask
            seen = self.keys[slot[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.at[slot[left[hit]]]
            left = left[~hit & (seen != EMPTY)]
        return out


class Model:
    """Code lengths in bits for all languages at once, from counts (lang, k, gram, n)."""

    def __init__(self, langs: np.ndarray, ks: np.ndarray, grams: np.ndarray, counts: np.ndarray):
        self.langs = sorted(set(langs.tolist()))
        self.order = int(ks.max()) if len(ks) else 0
        which = np.searchsorted(np.array(self.langs), langs) if self.langs else langs
        self.codes: list[_Table] = []
        self.escapes: list[_Table] = []
        wide = len(self.langs)
        if not wide:
            return
        for k in range(self.order + 1):
            mine = ks == k
            gram, n, lang = grams[mine].astype(np.uint64), counts[mine], which[mine]
            if k == 0:  # every byte has a row
                gram, n, lang = np.r_[gram, np.arange(256, dtype=np.uint64)], np.r_[n, np.zeros(256, n.dtype)], np.r_[lang, np.zeros(256, lang.dtype)]
            keys, row = np.unique(gram, return_inverse=True)
            c = np.zeros((len(keys), wide))
            np.add.at(c, (row, lang), n)
            contexts, ctx = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), wide)), np.zeros((len(contexts), wide))
            np.add.at(total, ctx, c)
            np.add.at(kinds, ctx, c > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2(total + kinds) - np.log2(kinds), 0.0)
                direct = np.log2(total + kinds)[ctx] - np.log2(c)
            lower = np.full((len(keys), wide), 8.0) if k == 0 else self._bits(k - 1, keys & np.uint64((1 << 8 * k) - 1))
            self.codes.append(_Table(keys, np.where(c > 0, direct, escape[ctx] + lower).astype(np.float32)))
            self.escapes.append(_Table(contexts, escape.astype(np.float32)))

    def _bits(self, k: int, grams: np.ndarray) -> np.ndarray:
        at = self.codes[k].find(grams)
        out = self.codes[k].rows[at]
        new = np.flatnonzero(at < 0)
        if len(new) and k:
            ctx = self.escapes[k].find(grams[new] >> np.uint64(8))
            escape = np.where(ctx[:, None] >= 0, self.escapes[k].rows[ctx], 0)
            out[new] = escape + self._bits(k - 1, grams[new] & np.uint64((1 << 8 * k) - 1))
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits for each text and language; the bytes before a text count as zeros."""
        out = np.zeros((len(texts), len(self.langs)))
        waiting: list[tuple[int, np.ndarray]] = []
        size, span = 0, max(1 << 14, SPAN * 4 // max(4, len(self.langs)))

        def flush():
            bits = self._bits(self.order, np.concatenate([g for _, g in waiting]))
            starts = np.cumsum([0] + [len(g) for _, g in waiting[:-1]])
            np.add.at(out, [i for i, _ in waiting], np.add.reduceat(bits, starts, axis=0, dtype=np.float64))
            waiting.clear()

        for i, text in enumerate(texts):
            padded = np.frombuffer(bytes(self.order) + text, np.uint8)
            for low in range(0, len(text), span):
                waiting.append((i, grams_of(padded[low : low + span + self.order], self.order)))
                size += len(waiting[-1][1])
                if size >= span:
                    flush()
                    size = 0
        if waiting:
            flush()
        return out


def grams_of(padded: np.ndarray, k: int) -> np.ndarray:
    """The k + 1 bytes that end at each byte after the first k, as integers."""
    n = len(padded) - k
    out = np.zeros(n, np.uint64)
    for i in range(k + 1):
        out = (out << np.uint64(8)) | padded[i : i + n].astype(np.uint64)
    return out


def labelled(rows: DataFrame, per_lang: int) -> DataFrame:
    """Of ``(id, lang, text)`` the rows to learn from: those whose id hash lies in the share that gives ``per_lang`` rows of a language on average."""
    part = F.shiftrightunsigned(F.xxhash64("id"), 11) / float(1 << 53)
    limits = rows.groupBy("lang").agg((F.lit(float(per_lang)) / F.count(F.lit(1))).alias("limit"))
    # One row for each language.
    return rows.withColumn("part", part).join(F.broadcast(limits), "lang").where("part < limit").select("lang", "text")


def train(docs: DataFrame, learn: Column, order: int = 3, per_lang: int = 600, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from a bounded sample: whole texts of about ``per_lang`` labelled documents of each language, all if there are fewer.

    Counting runs on the executors; the driver gets the counts of the sample, no texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            texts = b.column(1).cast(pa.binary()).to_pylist()
            for lang in sorted(set(names)):
                own = [np.frombuffer(bytes(order) + t, np.uint8) for t, n in zip(texts, names, strict=True) if n == lang and t]
                for k in range(order + 1) if own else ():
                    grams, n = np.unique(np.concatenate([grams_of(x[order - k :], k) for x in own]), return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(n)), pa.array(np.full(len(n), k, np.int32)), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "k", "gram", "n"])

    known = docs.where(learn & column(lang_col).isNotNull() & column(text_col).isNotNull())
    rows = labelled(known.select(column(id_col).cast("string").alias("id"), column(lang_col).cast("string").alias("lang"), column(text_col).cast("string").alias("text")), per_lang)
    counts = rows.mapInArrow(count, "lang string, k int, gram long, n long")
    found = counts.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).toArrow()
    return Model(*(found.column(c).to_numpy() for c in ("lang", "k", "gram", "n")))


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether a document is in the held-out fold, by the crc32 of its id as text; a null id is."""
    return F.coalesce(F.crc32(column(id_col).cast("string")) % folds == fold, F.lit(True))


def identify(
    docs: DataFrame, order: int = 3, per_lang: int = 600, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None
) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred``, ``score`` and ``bits``, predicted from the text alone.

    ``lang_pred`` is ``und`` with score 0 for null texts and texts without a letter, and where
    nothing could be learned.  ``score`` is the share of the prediction when languages are as
    likely as their codes are short; ``bits`` is the code's length for each byte (null for ``und``).
    Ties go to the language that sorts first.  Columns of ``docs`` with these names are replaced, others may
    have any name.  Repeated rows give repeated results; rows with a null id are held out; an empty table
    gives no rows.
    """
    new = ["held_out", "lang_pred", "score", "bits"]
    own = [c for c in docs.columns if c not in new]
    model = model or train(docs, ~held_out(id_col), order, per_lang, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for big in batches:
            for b in (big.slice(i, 1024) for i in range(0, big.num_rows, 1024)):
                given = texts(b.column(0), text_col).to_pylist()
                ok = np.array([has_letter(t) and bool(m.langs) for t in given], bool)
                raw = [t.encode() for t, good in zip(given, ok, strict=True) if good]
                names, scores, bits = np.full(len(given), "und", object), np.zeros(len(given)), np.full(len(given), np.nan)
                if raw:
                    length = m.code_lengths(raw)
                    best = length.argmin(axis=1)
                    least = length[np.arange(len(raw)), best]
                    names[ok] = np.array(m.langs, object)[best]
                    scores[ok] = 1 / np.exp2(least[:, None] - length).sum(axis=1)
                    bits[ok] = least / np.array([len(t) for t in raw])
                yield pa.record_batch([*b.columns, pa.array(names.tolist(), pa.string()), pa.array(scores), pa.array(bits, from_pandas=True)], names=["row", *new])

    given = docs.select(boxed(docs, own), held_out(id_col).alias("held_out"))
    schema = StructType([given.schema["row"], given.schema["held_out"], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("bits", DoubleType())])
    return given.mapInArrow(predict, schema).select(*unboxed(own), *new)
