import os
import random

import pytest

from bitsieve.llm import tokens

tiktoken = pytest.importorskip("tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARIES), reason="no vocabulary files")


@pytest.fixture(scope="module")
def plain():
    v = tokens.Vocabulary(tokens.VOCABULARIES, "byte_bpe_50k", shortcut=False)
    return v, tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=v.rank, special_tokens={})


def test_every_token_is_its_own_fixpoint(plain):
    v, _ = plain
    text = {}
    for data, i in v.rank.items():
        try:
            text[data.decode()] = i
        except UnicodeDecodeError:
            pass
    v.learn(list(text))
    assert all(v.known[t] == [i] for t, i in text.items())


def test_words_against_library(plain):
    v, e = plain
    rng = random.Random(1)
    words = ["aaaa" * 50, "ab" * 500, "-" * 3001, "é" * 77, "the" * 400, "中" * 100, "\x00​", "x" * 200_000]
    words += ["".join(rng.choice("aethorn") for _ in range(rng.randrange(1, 60))) for _ in range(500)]
    v.learn(words)
    assert [w[:20] for w in words if v.known[w] != e._encode_single_piece(w)] == []


def test_operator(spark, plain):
    texts = [None, "", " ", "\r\n\t", "<|endoftext|> it's", "Thursd- \nay", "é é ­​", "word " * 30_000, "naïve 東京 😀", " trailing  "]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(1, "again", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in tokens.encoded(df, "doc_id", "text").collect())
    want = sorted((i, plain[1].encode_ordinary(t or "")) for i, t in [*enumerate(texts), (1, "again")])
    assert got == want
    sizes = sorted((r.doc_id, r.n_tokens) for r in tokens.encoded(df, "doc_id", "text", only_sizes=True).collect())
    assert sizes == sorted((i, len(x)) for i, x in want)
    assert tokens.encoded(df.where("false"), "doc_id", "text").count() == 0


def test_given_documents(spark, plain, small_dir):
    df = spark.read.parquet(f"{small_dir}/documents.parquet")
    got = {r.doc_id: list(r.ids) for r in tokens.encoded(df, "doc_id", "text").collect()}
    assert got == {r.doc_id: plain[1].encode_ordinary(r.text or "") for r in df.select("doc_id", "text").collect()}


def test_forgetting(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 100)
    v = tokens.Vocabulary(tokens.VOCABULARIES, "byte_bpe_50k")
    one = [list(v.encode([f"Qzx{i} wug{i}-{i}", "plain words"])) for i in range(30)]
    assert one[3] == list(v.encode(["Qzx3 wug3-3", "plain words"]))
