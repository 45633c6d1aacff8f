import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import Row

from veilframe.llm import bpe, lengths

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    odd = ["a", " ", "  ", "\n", "'", "'ll", "ß", "漢", "1", "\x1c", " ", "!", "é", "\t", "<|endoftext|>", "😀"]
    made = ["".join(rng.choice(odd) for _ in range(rng.randrange(0, 300))) for _ in range(150)]
    return [None, "", "word", *made, "x" * 20000, " " * 9000, "漢" * 9000, ("ab 'll  " * 3000), "12345 " * 4000]


def test_tree_equals_plain_encoding(spark, plain, monkeypatch):
    for leaf in (1, 7, 64, bpe.LEAF):
        monkeypatch.setattr(bpe, "LEAF", leaf)
        monkeypatch.setattr(bpe, "WINDOW", 2)
        for text in texts():
            if text and (leaf > 7 or len(text) < 400):
                assert bpe.encode_text(plain, text).tolist() == plain.encode_ordinary(text)


def test_round_trip_and_digests(spark, plain):
    rows = [Row(doc_id=i, text=t, token_count=1, lang=None) for i, t in enumerate(texts())] + [Row(doc_id=None, text="word", token_count=None, lang="x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_count int, lang string")
    got = bpe.digests(df, PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for row in rows:
        ids = plain.encode_ordinary(row.text or "")
        r = by_id[row.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
    assert bpe.digests(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(df, PATH, public_tokenizers.PATTERN, into="lang")
    with pytest.raises(ValueError, match="pattern"):
        bpe.encode(df, PATH, r"[^\s]+[\r\n]*|\s+")


def test_histogram_against_brute_force(spark, plain):
    rng = random.Random(5)
    sizes = [0, 0, 1, 4095, 4096, 4097, 9000] + [rng.randrange(0, 12000) for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in sizes] + [(None,)], "n_tokens int")
    sizes.append(0)
    sums = lengths.suffix_sums(lengths.histogram(df)).cache()
    rows = {r.length: r for r in sums.collect()}
    assert set(rows) == set(sizes)
    for length, r in rows.items():
        assert r.docs == sizes.count(length) and r.tokens == length * r.docs
        assert r.docs_from == sum(x >= length for x in sizes) and r.tokens_from == sum(x for x in sizes if x >= length)
        assert r.truncated_tokens == sum(min(x, length) for x in sizes)
        assert r.all_tokens == sum(sizes) and r.all_docs == len(sizes)
    limits = spark.createDataFrame([(x,) for x in (0, 5, 4096, 10**7, 5, None)], "limit int")
    for r in lengths.at_limits(sums, limits).collect():
        if r.limit is None:
            assert r.docs_over is None
        else:
            assert r.docs_over == sum(x > r.limit for x in sizes) and r.truncated_tokens == sum(min(x, r.limit) for x in sizes)
    ordered = sorted(sizes)
    for q in (0.01, 0.5, 0.99, 1.0):
        assert lengths.quantile(sums, q).first().length == ordered[-(-int(q * 1e6) * len(sizes) // 10**6) - 1]
    assert lengths.suffix_sums(lengths.histogram(df.limit(0))).count() == 0


def test_count_matches_encode(spark, plain):
    df = spark.createDataFrame([(t,) for t in texts()], "text string")
    got = bpe.count(df, PATH, public_tokenizers.PATTERN).collect()
    assert all(r.n_tokens == len(plain.encode_ordinary(r.text or "")) for r in got)
