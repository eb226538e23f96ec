import random

from bitsieve.llm import subjects
from bitsieve.llm.subjects import page_subjects

WORDS = {"law": "court judge verdict trial oath clause writ statute".split(), "sport": "match goal referee racket pitch sprint wicket oarsmen".split(), "arts": "canvas sonnet ballet mural overture etching violin stage".split()}
FILLER = "the mayor spoke for an hour near and told paper letters reach daily port wine served".split()
DOCS = "doc_id long, text string, lang string, lines array<struct<line_no int, col_no int>>, subject string"


def corpus(rng, n):
    """Pages of one or two articles; page, its subjects."""
    for i in range(n):
        own = rng.sample(sorted(WORDS), rng.choice([1, 1, 2]))
        passages = [" ".join(rng.sample(WORDS[s], 3) + rng.sample(FILLER, 4)) + "." for s in own for _ in range(5)]
        passages += [" ".join(rng.sample(FILLER, 6)) + "." for _ in range(3)]
        yield 1000 + i, "\n".join(passages), set(own)


def test_held_out_pages_and_edge_cases(spark):
    rng = random.Random(1)
    pages = list(corpus(rng, 300))
    labels = [(i, s) for i, _, own in pages[:100] for s in own if rng.random() < 0.9] + [(1001, "unknown"), (None, "law"), (1002, None), (99, "law")] + [(1000, "law")] * 2
    odd = [(1, None, "en", None, "x"), (2, "", "en", [], "x"), (3, " \r\n ", None, None, "x"), (4, "court", "nl", [(0, 0), (1, None)], "x"), (5, "court verdict " * 50_000, "en", None, "x")]
    docs = spark.createDataFrame([(i, t, "en", None, "x") for i, t, _ in pages] + odd, DOCS)
    out = page_subjects(docs, spark.createDataFrame(labels, "doc_id long, subject string"), sorted(WORDS)).collect()
    got = {(r.doc_id, r.subject) for r in out}
    assert len(got) == len(out)
    want = {(i, s) for i, _, own in pages[100:] for s in own}
    held = {x for x in got if x[0] >= 1100}
    assert len(held & want) > 0.9 * len(want) and len(held & want) > 0.9 * len(held)
    assert not {i for i, _ in got} & {1, 2, 3} and (5, "law") in got


def test_columns_and_broken_words():
    read = subjects._reader()
    text = "The judg-\nballet be-\ne wrote.\ngan again."
    assert read(text, [0, 1, 0, 1]) == [["the", "judge", "wrote"], ["ballet", "began", "again"]]
    assert read("It is.\r\nNot so", None) == [["it", "is"], ["not", "so"]]
    assert read(None, None) == read("", []) == read(" \n ", [0, 0]) == []


def test_empty_tables_and_no_labels(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, subject string")
    assert page_subjects(docs, labels, sorted(WORDS)).count() == 0
    assert page_subjects(spark.createDataFrame([(1, "court judge", "en", None, "x")] * 20, DOCS), labels, sorted(WORDS)).count() == 0


def test_given_pages_against_noisy_labels(spark):
    """Labels of the other half of the labelled pages; about one in ten labels is wrong or missing."""
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
    names = [r.subject for r in read("subject_area").collect()]
    labels = read("doc_label")
    got = {tuple(r) for r in page_subjects(read("documents"), labels.where("doc_id % 2 = 0"), names).collect()}
    held = {(r.doc_id, r.subject) for r in labels.where("doc_id % 2 = 1").collect()}
    ids = {i for i, _ in held}
    found = {x for x in got if x[0] in ids}
    assert len(found & held) > 0.8 * len(found) and len(found & held) > 0.8 * len(held)
