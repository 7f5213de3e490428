"""Every registered query that SQL does not express against a brute-force version, and all of them over odd rows."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from test_scans import plain_pii, plain_secrets
from tokenizers import Tokenizer

import corpus_pipeline
from wavemill.llm import langid, pii, queries, secrets

DATA = "/root/testdata/sf0.001"
CLASHING = ["row", "id", "total", "quota", "source_f", "__text", "score", "bits", "held_out", "lang_pred", "kept", "drop", "n_lines", "epoch", "position", "tokens", "weight", "exponent", "block", "tag", "fp", "component_id", "a.b", "n"]


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def run(spark, name, folder=DATA):
    return {r.doc_id: r for r in queries.queries()[name](spark, str(folder)).collect()}


def plain_classes(fps, linked):
    of = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if linked(fps[i], fps[j]) and of[i] != of[j]:
                    of[i] = of[j] = min(of[i], of[j])
                    changed = True
    return of


def test_op1(spark, docs):
    fps = {}
    for i, r in docs.items():
        w = words_of(lowered(r.text))
        hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    want = plain_classes(fps, lambda x, y: (x ^ y).bit_count() <= 4)
    got = run(spark, "op1_simhash")
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fps[i]:016x}", want[i]) for i in docs}


def test_op2_and_op6(spark, docs):
    t, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    two, six = run(spark, "op2_token_files"), run(spark, "op6_bpe")
    assert two.keys() == six.keys() == docs.keys()
    for i in sorted(docs):
        ids = t.encode(docs[i].text or "", add_special_tokens=False).ids
        r, whole = two[i], np.array([*ids, 2], "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) + 1, zlib.crc32(whole))
        start += len(ids) + 1
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), t.decode(ids, skip_special_tokens=False))]
        assert (six[i].n_tokens, six[i].ids_sha256, six[i].decoded_sha256) == (len(ids), *digests)


@pytest.mark.parametrize(("name", "plain", "kinds"), [("op3_secrets", plain_secrets, ("assign", "access", "hex", "random")), ("op4_pii", plain_pii, pii.KINDS)])
def test_op3_and_op4(spark, docs, name, plain, kinds):
    got = run(spark, name)
    assert got.keys() == docs.keys()
    own = len(kinds) if name == "op4_pii" else 3
    for i, r in got.items():
        base = sorted(plain(docs[i].text or ""), key=lambda x: (x[1], x[0]))
        text = ",".join(f"{kinds[k]}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in kinds[:own]] == [sum(x[0] == n for x in base) for n in range(own)]
        every = [(kinds.index(k), int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert set(base) <= set(every) and every == sorted(every, key=lambda x: (x[1], x[0]))


def test_op5(spark):
    got = {}
    for r in queries.op5_nearest(spark, DATA).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    assert got.keys() == {i for i in ids.tolist() if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        score = (x[ids == q][0] * x).sum(axis=1)
        best = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        hits += len({f[1] for f in found} & set(ids[best].tolist()))
        assert [f[0] for f in sorted(found)] == list(range(1, 21)) and q not in {f[1] for f in found}
        assert all(abs(s - score[ids == i][0]) < 1e-12 for _, i, s in found)
        assert sorted(found) == [(n + 1, *y) for n, y in enumerate((i, s) for s, i in sorted(((s, i) for _, i, s in found), key=lambda y: (-y[0], y[1])))]
    assert hits >= 0.9 * 20 * len(got)


def test_op9(spark, docs):
    got = run(spark, "op9_language")
    assert {i: r.held_out for i, r in got.items()} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in docs}
    assert all(0 <= r.score <= 1 for r in got.values())
    learned = {r.lang for i, r in docs.items() if not got[i].held_out and r.lang is not None}
    for i, r in got.items():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in docs[i].text or "")) and r.lang_pred in learned | {"und"}
    judged = [docs[i].lang == r.lang_pred for i, r in got.items() if r.held_out and r.lang_pred != "und"]
    assert np.mean(judged) > 0.95


def odd_documents(spark):
    long = "lorem ipsum dolor sit amet " * 40_000
    rows = [(None, "an english sentence without an id and more", "en", "a"), (1, None, "en", "a"), (2, "", "de", None), (3, "an english sentence for two rows and more", None, "b"), (3, "an english sentence for two rows and more", None, "b"), (4, long, "en", "tiny"), (5, " \n\n\t", "de", "a"), (6, "9" * 5000 + ".1.1.1 ́ \U0001f600", "de", "b")]
    rows += [(i, f"ein deutscher satz mit der nummer {i} und noch mehr" if i % 2 else f"an english sentence with the number {i} and more", "de" if i % 2 else "en", "a") for i in range(10, 40)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


OVER_DOCUMENTS = [n for n in queries.queries() if n not in ("op5_nearest", "op11_dialogue", "pipeline")]


@pytest.mark.parametrize("name", OVER_DOCUMENTS)
def test_queries_of_odd_and_empty_tables(spark, name, tmp_path):
    df = odd_documents(spark)
    df.write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    df.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.queries()[name](spark, str(tmp_path / "none")).collect() == []
    got = queries.queries()[name](spark, str(tmp_path / "odd")).collect()
    ids = sorted(r.doc_id or 0 for r in got)
    if name == "op7_mixing":
        assert set(ids) <= {0, *range(1, 7), *range(10, 40)} and max(r.epoch for r in got) < queries.MIXTURE["max_repeats"]
    else:
        assert ids == [0, 1, 2, 3, 3, 4, 5, 6, *range(10, 40)]


def test_pipeline_of_odd_rows(spark, tmp_path):
    docs = odd_documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        assert docs.columns == columns and rows and all(r[c] == f"own {c}" for r in rows for c in CLASHING)
        if n == 0:
            assert {r.doc_id for r in rows} >= {None, 3, *range(10, 40)} and not {1, 2, 5} & {r.doc_id for r in rows}
        if n == 2:
            assert sum(r.doc_id == 3 for r in rows) == 1 and sum(r.doc_id is None for r in rows) == 1
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(last) == docs.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_secrets_that_the_patterns_miss(spark):
    """Planted tokens are in the texts that the model is trained on, unlabelled, and are found none the less."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    planted = secrets.generated(40, seed=5)[40:]  # all but the plain hex ones, which the patterns find
    rows = [(r.doc_id, f"{r.text}\nuse {planted[i % len(planted)]} here") for i, r in enumerate(docs.collect())]
    found = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    hit = sum(any(texts[r.doc_id][s.start : s.end] in planted for s in r.spans) for r in found)
    wrong = sum(texts[r.doc_id][s.start : s.end] not in planted for r in found for s in r.spans if not s.base)
    assert hit > 0.9 * len(rows) and wrong < 0.02 * len(rows)


def test_labels_of_the_language_stage_are_not_read(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    one = {r.doc_id: r.lang_pred for r in langid.identify(df).collect()}
    two = {r.doc_id: r.lang_pred for r in langid.identify(df.withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang")))).collect()}
    assert one == two
