import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wavemill.llm import bpe, token_files
from wavemill.llm.store import Store

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABETS = ["ab", "abcdefghij klmnop", "the on and ing ", "  \n\t.,'s", "éàü漢字   ", "0123456789 a", "aaaaaa", "日本語한국어😀 ", "'ll 've's ", "=-_*#/\\ ", "x y  ", "a.b, c!\n d"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def samples(n=1500, seed=1):
    r = random.Random(seed)
    out = ["", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", " ", "\n", "a  b", " lead", "trail ", "x" * 3000, "ab" * 2000, "\r\n\r\n x"]
    for _ in range(n):
        a = r.choice(ALPHABETS)
        out.append("".join(r.choices(a, k=r.choice([1, 3, 8, 20, 60, 300]))))
    return out


def test_both_encoders_match_the_library(library):
    texts = samples()
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    own = bpe.transducer(PATH)
    assert [np.frombuffer(own.encode(t), "<u4").tolist() for t in texts] == want
    assert [np.frombuffer(b, "<u4").tolist() for b in token_files.library(PATH).encode(texts)] == want
    assert own.encode(None) == b"" and token_files.library(PATH).encode([None]) == [b""]
    merges = bpe.load(PATH)
    assert [bpe.decode(np.array(ids, "<i4"), merges, run=3) for ids in want] == [library.decode(ids, skip_special_tokens=False) for ids in want]


def test_transducer_emits_long_words_with_bounded_lookahead(library):
    merges, r = bpe.load(PATH), random.Random(2)
    assert 0 < merges.lookahead < 5000
    for alphabet in ("a", "ab", "the", "-", "thingonre", "é漢"):
        word = "".join(r.choices(alphabet, k=9000))
        raw = word.encode()
        got = list(merges.transduce(raw[i : i + 100] for i in range(0, len(raw), 100)))
        assert got == library.encode(word, add_special_tokens=False).ids


def test_decoder_holds_back_unfinished_characters(library):
    merges = bpe.load(PATH)
    ids = library.encode("漢字😀", add_special_tokens=False).ids
    d = bpe.Decoder(merges)
    assert "".join([d.feed([i]) for i in ids] + [d.finish()]) == "漢字😀"
    broken = [ids[0], 64]
    assert bpe.decode(np.array(broken), merges) == library.decode(broken, skip_special_tokens=False)


def test_documents(spark, library):
    rows = [(5, "a b", "x"), (1, None, "x"), (3, "", "x"), (5, "a b", "x"), (None, "q", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode_and_decode(df, PATH).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in got) == [(0, "q"), (1, ""), (3, ""), (5, "a b"), (5, "a b")]
    assert all(r.ids == library.encode(r.decoded, add_special_tokens=False).ids for r in got)
    assert bpe.encode_and_decode(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("length", [4, 2048])
def test_files_round_trip(spark, library, length):
    r = random.Random(7)
    texts = [t for t in samples(80, 3)] + [None]
    ids = r.sample(range(10_000), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts, [1] * len(ids), strict=True)), "doc_id long, text string, start int").repartition(3)
    got = {x.doc_id: x for x in token_files.round_trip(df, PATH, length=length).collect()}
    start = 0
    for doc, text in sorted(zip(ids, texts, strict=True)):
        want = (library.encode(text, add_special_tokens=False).ids if text else []) + [2]
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    assert token_files.round_trip(df.limit(0), PATH).count() == 0


def test_sequences_are_views_of_equal_length(spark):
    df = spark.createDataFrame([(i, "word " * i) for i in range(30)], "doc_id long, text string").coalesce(1)
    folder = Store(spark, "t").path("shards")
    row = token_files.write_tokens(df, PATH, folder, length=16).first()
    shard = token_files.Shard(row.ids_path, row.docs_path, 16)
    n = -(-row.n_tokens // 16)
    parts = [shard.sequence(i) for i in range(n)]
    mask = np.concatenate([m.to_numpy(zero_copy_only=False) for _, m, _ in parts])
    last = np.concatenate([x.to_numpy(zero_copy_only=False) for _, _, x in parts])
    flat = np.concatenate([x.to_numpy() for x, _, _ in parts])
    assert mask.sum() == row.n_tokens and last.sum() == 30 and (flat[np.flatnonzero(last)] == 2).all()
    assert parts[0][0].type == "uint16" and all(len(x) == 16 for x, _, _ in parts)
