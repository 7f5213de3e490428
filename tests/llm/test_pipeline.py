import hashlib
import re

import duckdb
import numpy as np
import public_tokenizers
from test_jaccard import plain, similarity
from tokenizers import Tokenizer

import corpus_pipeline
from wavemill.llm import langid, oracles, queries

DATA = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_the_last_encodes(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "mixing", "bpe"]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        if n < 3:
            assert 0.5 * before < docs.count() <= before
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((i, len(t.encode(x, add_special_tokens=False).ids)) for i, x in texts)
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()) == want


def test_registered(spark):
    got = queries.queries()["pipeline"](spark, DATA).toPandas()
    assert len(got) and got.ids_sha256.str.len().eq(64).all() and np.issubdtype(got.n_tokens.dtype, np.integer)


def lines_kept(docs):
    """Texts by id after the removal of shared lines, without documents that have no words left."""
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in docs.items():
        for k in {key(x) for x in t.split("\n")}:
            if len(k) >= 20:
                holders.setdefault(k, set()).add(i)
    shared = {k: max(h) for k, h in holders.items() if len(h) >= 3}
    left = {i: "\n".join(x for x in t.split("\n") if shared.get(key(x), i) == i) for i, t in docs.items()}
    return {i: t for i, t in left.items() if re.search("[^\x20\x09-\x0d]", t)}


def first_of_each_class(docs):
    ids, sets = sorted(docs), {i: plain(t) for i, t in docs.items()}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if similarity(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in ids if find(i) == i}


def test_whole_run_against_brute_force(spark, tmp_path):
    """Every stage on what its predecessor kept: predictions by the operator, lines and sets by loops, the mixture by SQL, ids by the library."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    first = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out[name] = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    told = {r.doc_id: r.lang_pred for r in langid.identify(spark.read.parquet(f"{DATA}/documents.parquet")).collect() if r.lang_pred != "und" and r.bits < 8}
    assert sorted(out["language_id"]) == sorted((i, first[i].text, told[i]) for i in told)
    lines = lines_kept({i: t for i, t, _ in out["language_id"]})
    assert {i: t for i, t, _ in out["line_dedup"]} == lines and len(out["line_dedup"]) == len(lines)
    assert sorted(i for i, _, _ in out["near_dedup"]) == sorted(first_of_each_class(lines))
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from read_parquet('{tmp_path}/near_dedup/*.parquet')")
    mixed = sorted(r[0] for r in duck.sql(f"select doc_id from ({oracles.oracle_sql()['op7_mixing']})").fetchall())
    assert sorted(i for i, _, _ in out["mixing"]) == mixed
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t, _ in out["mixing"]:
        ids = tokens.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), digest(",".join(map(str, ids))), digest(tokens.decode(ids, skip_special_tokens=False))))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()) == sorted(want)
