import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bitsieve.llm.term_counts import ngram_counts, record_terms, term_marks

ROWS = [(1, [5, 5, 6]), (1, [5, 5, 6]), (2, None), (3, []), (4, [6, None, 5, 6, 5]), (None, [9]), (5, [7] * 40), (6, [-1, 70000])]


def brute(rows, n):
    cf, df = Counter(), Counter()
    for terms in rows:
        grams = [tuple(terms[i : i + k]) for k in range(1, n + 1) for i in range(len(terms) - k + 1)]
        cf.update(grams)
        df.update(set(grams))
    return {g: (cf[g], df[g]) for g in cf}


@pytest.mark.parametrize("n", [1, 2, 3])
def test_small_table(spark, n):
    df = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "id long, fingerprint array<int>, records int")
    got = {tuple(r.gram): (r.occurrences, r.records) for r in ngram_counts(record_terms(df, "id", "fingerprint"), n).collect()}
    assert got == brute([[t for t in x if t is not None] for i, x in {(i, tuple(t)) for i, t in ROWS if i is not None and t}], n)


@pytest.mark.parametrize("n", [1, 3, 4])
def test_random_words(spark, n):
    rng = random.Random(n)
    rows = [[rng.choice("abcde") * rng.randrange(1, 3) for _ in range(rng.randrange(30))] for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, t array<string>")
    out = ngram_counts(record_terms(df, "id", "t"), n).collect()
    assert len(out) == len({tuple(r.gram) for r in out})
    assert {tuple(r.gram): (r.occurrences, r.records) for r in out} == brute(rows, n)


def test_marks(spark):
    df = spark.createDataFrame([(i, [1, 2] if i < 7 else [3] if i == 7 else None) for i in range(10)], "id long, t array<int>")
    total = df.agg(F.count_distinct("id").alias("n"))
    out = term_marks(ngram_counts(record_terms(df, "id", "t")), total, rare_below=3, common_above=0.69)
    assert {(r.term, r.records, r.mark) for r in out.collect()} == {(1, 7, "common"), (2, 7, "common"), (3, 1, "rare")}


def test_empty(spark):
    df = spark.createDataFrame([], "id long, t array<int>")
    assert ngram_counts(record_terms(df, "id", "t"), 2).count() == 0
