"""Subjects of the articles on each page, several or none.

Pages are put in reading order (by printed column), mended at line ends and cut into passages. Pages are
embedded by term weighting and truncated singular value decomposition; seed centroids, one per subject and
language, come from labelled pages and are refined by the passages of the whole corpus that lie clearly nearest to
them; a passage goes to the subject of its most similar centroid, by cosine similarity, if it is similar
enough and clearly more so than to any other subject. A page has the subjects that enough of its passages go to.

What is fitted on labelled rows: the centroids' seeds and the terms' discrimination, on at most ``LABELLED`` labelled
pages (the first by hash of their id). Everything else covers all pages and all words: document frequencies, the decomposition
(a randomised range finder whose products with the page-by-term matrix are sums over partitions), the refinement
and the assignment. A word in at least the share ``SHARE`` of all pages is a term of its own; as a page has a bounded number of words, there are at
most words per page / ``SHARE`` of these, however large the corpus. All rarer words count as well: they are hashed into ``BUCKETS`` terms, each with the
document frequency of its bucket.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitsieve.sources.tables import stored

LABELLED = 50_000
SHARE = 5e-4
BUCKETS = 2048
DIMENSIONS = 32
POWER_STEPS = 2
REFINEMENTS = 2
#: A passage's least cosine similarity, its least lead over the next subject, and its least length
#: as a part of a median term's weight. A page has a subject that two of its clear passages have, or a third of them.
SIMILAR, LEAD, LENGTH = 0.3, 0.1, 0.15
ENOUGH, PART = 2, 1 / 3
#: Cosine similarity from which a seed joins a larger one of its subject: pages of one language under several marks.
SAME = 0.5
#: Partitions that the sums over all pages are made in, for each core.
SUMS_PER_CORE = 2


def _reader():
    import regex

    joined = regex.compile(r"[-‐‑=¬~⸗\xad](?<=\p{L}.)[^\S\n]*+\n\s*+(?=\p{Ll})")
    # Words, and what ends a passage: a mark before white space, a dash within it, or much of it.
    pieces = regex.compile(r"\p{L}{2,}+|[.!?;:—»”\"]\s|\s[—–]\s|\s\s").findall

    def passages(text: str | None, columns: list[int | None] | None) -> list[list[str]]:
        """The distinct words of each passage of a page."""
        if not text:
            return []
        lines = text.replace("\r\n", "\n").split("\n")
        if columns and len(columns) == len(lines):
            columns = [c or 0 for c in columns]
            lines = [lines[i] for i in sorted(range(len(lines)), key=columns.__getitem__)]
        whole = "\n".join([x.rstrip() for x in lines])
        if not whole.isascii():
            whole = unicodedata.normalize("NFC", whole).replace("ſ", "s").replace("​", "")
        whole = joined.sub("", whole).replace("\n", " ").lower()
        found: list[list[str]] = []
        now: dict[str, None] = {}
        for piece in pieces(whole):
            if piece[-1].isspace():
                if now:
                    found.append(list(now))
                    now = {}
            else:
                now[piece] = None
        if now:
            found.append(list(now))
        return found

    return passages


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages of each page: their words one after another, and how many each has."""
    passages = _reader()
    for batch in batches:
        for s in range(0, batch.num_rows, 500):
            part = batch.slice(s, 500)
            pages = [passages(t, c) for t, c in zip(part.column("text").to_pylist(), part.column("columns").to_pylist(), strict=True)]
            words = [[w for p in page for w in p] for page in pages]
            sizes = [[len(p) for p in page] for page in pages]
            cols = {c: part.column(c) for c in part.schema.names if c not in ("text", "columns")}
            yield pa.RecordBatch.from_pydict(cols | {"words": pa.array(words, pa.list_(pa.string())), "sizes": pa.array(sizes, pa.list_(pa.int32()))})


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few pages at a time: their vectors then stay in the processor's cache."""
    for batch in batches:
        for s in range(0, batch.num_rows, 250):
            yield batch.slice(s, 250)


def _coded(sent):
    """Words as term numbers, rare ones as those of their buckets. Later passes then move numbers only."""
    from zlib import crc32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        own = len(number)
        for batch in batches:
            words, sizes = batch.column("words"), batch.column("sizes")
            coded = words.flatten().dictionary_encode()
            known = np.array([number[w] if w in number else own + crc32(w.encode()) % BUCKETS for w in coded.dictionary.to_pylist()], np.int32)
            term = known[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int32)
            counts = sizes.flatten().to_numpy()
            ends = np.r_[0, np.cumsum(counts)]
            bounds = sizes.offsets.to_numpy() - sizes.offsets[0].as_py()
            cols = {c: batch.column(c) for c in ("doc_id", "lang")}
            yield pa.RecordBatch.from_pydict(cols | {
                "terms": pa.ListArray.from_arrays(pa.array(ends[bounds], pa.int32()), pa.array(term)),
                "sizes": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(counts)),
            })

    return run


class _Batch:
    """Passages of a batch of pages as term numbers of the vocabulary."""

    def __init__(self, batch: pa.RecordBatch):
        terms, sizes = batch.column("terms"), batch.column("sizes")
        counts = sizes.flatten().to_numpy()
        self.pages, self.passages = batch.num_rows, len(counts)
        self.owner = np.repeat(np.arange(self.pages), np.diff(sizes.offsets.to_numpy()))
        self.term = terms.flatten().to_numpy().astype(np.int64)
        self.at = np.repeat(np.arange(self.passages), counts)

    def page_terms(self, v: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(page, term, value): rows of unit length, log(1 + passages) times the term's weight."""
        key, n = np.unique(self.owner[self.at] * len(v["weight"]) + self.term, return_counts=True)
        page, term = key // len(v["weight"]), key % len(v["weight"])
        value = np.log1p(n) * v["weight"][term]
        length = np.sqrt(np.bincount(page, value**2, self.pages))
        return page, term, (value / np.maximum(length, 1e-9)[page]).astype(np.float32)

    def embedded(self, v: dict) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors of the passages, and their lengths before."""
        out = _sum_rows(v["axes"][self.term] * v["weight"][self.term, None].astype(np.float32), self.at, self.passages)
        length = np.linalg.norm(out, axis=1)
        return out / np.maximum(length, 1e-9)[:, None], length


def _sum_rows(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows with equal ``at`` (ascending)."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(at):
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        out[at[first]] = np.add.reduceat(values, first)
    return out


def _numbered(rows: np.ndarray) -> pa.RecordBatch:
    use = np.flatnonzero(np.abs(rows).sum(axis=1))
    flat = rows[use].astype(np.float32)
    offsets = np.arange(len(use) + 1, dtype=np.int32) * rows.shape[1]
    return pa.RecordBatch.from_arrays([pa.array(use, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))], ["row", "v"])


def _summed(pages: DataFrame, each, shape: tuple[int, int]) -> np.ndarray:
    """Sum over all partitions of the matrix that ``each`` adds up for one; only the sum reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in _parts(batches):
            each(batch, total)
        yield _numbered(total)

    # Each partition sends one matrix: fewer, larger ones move less, however many files the corpus has.
    cores = pages.sparkSession.sparkContext.defaultParallelism
    parts = pages.coalesce(SUMS_PER_CORE * cores).mapInArrow(run, "row int, v array<float>")
    sums = parts.groupBy("row").agg(*(F.sum(F.get("v", F.lit(k))).alias(f"v{k}") for k in range(shape[1])))
    out = np.zeros(shape)
    for r in sums.toArrow().to_batches():
        out[r.column("row").to_numpy()] = np.stack([r.column(f"v{k}").to_numpy() for k in range(shape[1])], axis=1)
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def _chosen(z: np.ndarray, length: np.ndarray, v: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(clear, subject, centroid) of each passage."""
    near = z @ v["centroids"].T.astype(np.float32)
    rows = np.arange(len(near))
    centroid = near.argmax(axis=1)
    best = near[rows, centroid]
    other = np.where(v["of"][None, :] == v["of"][centroid][:, None], np.float32(-1), near).max(axis=1)
    clear = (best > SIMILAR) & (best - other > LEAD) & (length > LENGTH * v["typical"])
    return clear, v["of"][centroid], centroid


def page_subjects(documents: DataFrame, labels: DataFrame, subjects: list[str]) -> DataFrame:
    """``doc_id, subject`` of every page and subject of its articles.

    ``documents``: ``doc_id, text, lang`` and ``lines`` (structs with ``col_no``); ``labels``: ``doc_id, subject``, noisy;
    ``subjects``: the closed list. Defined results: null, empty and blank pages have no subject; a page whose number of lines
    differs from ``lines`` is read as it stands; labels of other subjects or with nulls are left out; without
    any label there are no seeds and no rows; other columns aren't read.
    """
    spark = documents.sparkSession
    names = sorted(subjects)
    rows = documents.select("doc_id", "text", F.lower("lang").alias("lang"), F.col("lines.col_no").alias("columns"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    pages = stored(rows.mapInArrow(_words, f"doc_id {kind}, lang string, words array<string>, sizes array<int>"), "pages")

    known = labels.where(F.col("subject").isin(names)).select("doc_id", "subject").distinct()
    known = known.groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("labels"))  # at most the closed list
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)

    n_pages = pages.count()
    # Terms by document frequency, all pages; and by label on the labelled ones.
    terms = pages.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = terms.where(F.col("df") >= max(2, SHARE * n_pages)).orderBy(F.desc("df"), "term").select("term").toArrow().column("term").to_pylist()
    number = spark.sparkContext.broadcast({t: i for i, t in enumerate(terms)})
    pages = stored(pages.mapInArrow(_coded(number), f"doc_id {kind}, lang string, terms array<int>, sizes array<int>"), "coded")
    seen = stored(pages.join(known, "doc_id"), "labelled")
    if seen.isEmpty():
        return spark.createDataFrame([], f"doc_id {kind}, subject string")
    n_terms = len(terms) + BUCKETS
    v: dict = {}
    df = _summed(pages, _page_counts(n_terms), (n_terms, 1))[:, 0]
    labelled = _summed(seen, _label_counts(names), (n_terms, len(names)))
    shares = seen.select(F.explode("labels").alias("s"), (1 / F.size("labels")).alias("w")).groupBy("s").agg(F.sum("w").alias("w")).collect()
    prior = np.maximum([sum(r.w for r in shares if r.s == s) for s in names], 1e-9)
    prior /= prior.sum()
    lift = (labelled + 2 * prior) / (labelled.sum(axis=1, keepdims=True) + 2) / prior
    lift /= lift.sum(axis=1, keepdims=True)
    decided = 1 + (lift * np.log(np.maximum(lift, 1e-12))).sum(axis=1) / np.log(max(2, len(names)))
    v["weight"] = np.log(max(n_pages, 2) / np.maximum(df, 1)) * np.sqrt(np.maximum(decided, 0))
    v["typical"] = float(np.median(v["weight"][v["weight"] > 0])) if (v["weight"] > 0).any() else 1.0

    # Truncated decomposition of the page-by-term matrix by a randomised range finder.
    k = min(DIMENSIONS, n_terms)
    v["axes"] = np.linalg.qr(np.random.default_rng(7).standard_normal((n_terms, k)))[0].astype(np.float32)
    for _ in range(POWER_STEPS + 1):
        v["axes"] = np.linalg.qr(_summed(pages, _product(spark.sparkContext.broadcast(v)), (n_terms, k)))[0].astype(np.float32)

    # Seeds: mean vectors of the pages with one label, by subject and language.
    # Every language that labelled pages name, and none (""), has its seeds; those that lie close to a larger seed of their subject join it.
    languages = sorted({r.lang or "" for r in seen.select("lang").distinct().collect()})
    groups = [(s, g) for g in languages for s in names]
    seeds = _summed(seen.where("size(labels) = 1"), _seed_sums(spark.sparkContext.broadcast(v), groups), (len(groups), k))
    v["centroids"], v["of"] = _joined(seeds, np.array([names.index(s) for s, _ in groups]))
    for missing in set(range(len(names))) - set(v["of"].tolist()):
        v["centroids"], v["of"] = np.r_[v["centroids"], np.zeros((1, k))], np.r_[v["of"], missing]
    for _ in range(REFINEMENTS):
        sums = _summed(pages, _refined(spark.sparkContext.broadcast(v)), v["centroids"].shape)
        moved = np.abs(sums).sum(axis=1, keepdims=True) > 0
        v["centroids"] = np.where(moved, _unit(sums), v["centroids"])
    out = pages.mapInArrow(_assigned(spark.sparkContext.broadcast(v), names), f"doc_id {kind}, subject string")
    return out


def _joined(seeds: np.ndarray, subject: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit centroids, their subjects) of summed page vectors, the longest sums first."""
    sums: list[np.ndarray] = []
    of: list[int] = []
    for i in np.argsort(-np.linalg.norm(seeds, axis=1), kind="stable"):
        if not np.abs(seeds[i]).sum():
            continue
        own = [j for j, s in enumerate(of) if s == subject[i]]
        near = _unit(np.array([sums[j] for j in own])) @ _unit(seeds[i : i + 1])[0] if own else np.zeros(0)
        if len(near) and near.max() >= SAME:
            sums[own[int(near.argmax())]] += seeds[i]
        else:
            sums.append(seeds[i].copy())
            of.append(int(subject[i]))
    return _unit(np.array(sums).reshape(-1, seeds.shape[1])), np.array(of, np.int64)


def _page_counts(n_terms: int):
    def each(batch: pa.RecordBatch, total: np.ndarray) -> None:
        b = _Batch(batch)
        key = np.unique(b.owner[b.at] * n_terms + b.term)
        total[:, 0] += np.bincount(key % n_terms, minlength=n_terms)

    return each


def _label_counts(names: list[str]):
    def each(batch: pa.RecordBatch, total: np.ndarray) -> None:
        b = _Batch(batch)
        share = np.zeros((b.pages, len(names)))
        for i, x in enumerate(batch.column("labels").to_pylist()):
            share[i, [names.index(s) for s in x]] = 1 / len(x)
        key = np.unique(b.owner[b.at] * len(total) + b.term)
        np.add.at(total, key % len(total), share[key // len(total)])

    return each


def _product(sent):
    """Adds A'(A axes) for the batch's rows of the page-by-term matrix A."""

    def each(batch: pa.RecordBatch, total: np.ndarray) -> None:
        v = sent.value
        b = _Batch(batch)
        page, term, value = b.page_terms(v)
        y = _sum_rows(v["axes"][term] * value[:, None], page, b.pages)
        order = np.argsort(term.astype(np.uint16 if len(v["weight"]) <= 1 << 16 else np.uint32), kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(term[order]) > 0]) if len(order) else order
        if len(order):
            total[term[order[first]]] += np.add.reduceat(y[page[order]] * value[order, None], first)

    return each


def _seed_sums(sent, groups: list[tuple[str, str]]):
    def each(batch: pa.RecordBatch, total: np.ndarray) -> None:
        v = sent.value
        b = _Batch(batch)
        page, term, value = b.page_terms(v)
        y = _unit(_sum_rows(v["axes"][term] * value[:, None], page, b.pages))
        for i, (labels, lang) in enumerate(zip(batch.column("labels").to_pylist(), batch.column("lang").to_pylist(), strict=True)):
            group = labels[0], lang or ""
            if group in groups:
                total[groups.index(group)] += y[i]

    return each


def _refined(sent):
    def each(batch: pa.RecordBatch, total: np.ndarray) -> None:
        v = sent.value
        z, length = _Batch(batch).embedded(v)
        clear, _, centroid = _chosen(z, length, v)
        total += (centroid[clear] == np.arange(len(total))[:, None]).astype(np.float32) @ z[clear]

    return each


def _assigned(sent, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for batch in _parts(batches):
            b = _Batch(batch)
            z, length = b.embedded(v)
            clear, subject, _ = _chosen(z, length, v)
            votes = np.zeros((b.pages, len(names)), np.int64)
            np.add.at(votes, (b.owner[clear], subject[clear]), 1)
            page, k = np.nonzero((votes >= ENOUGH) | ((votes > 0) & (votes >= PART * votes.sum(axis=1, keepdims=True))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(page)), pa.array([names[i] for i in k], pa.string())], ["doc_id", "subject"])

    return run
