"""Occurrences and record counts of every term and n-gram of a collection.

Suffix-sorted n-gram counting: every position of a record's term sequence gives
one suffix, cut to ``max_n`` terms; suffixes are routed by their first term, sorted in
reverse lexicographic order, and a stack of at most ``max_n`` open prefixes adds up the
counts of all prefixes in one pass over the sorted run. The same for single terms (``max_n`` of 1) as for longer ones.

Two counts have to come out for each prefix: occurrences, and distinct records. For
the second, each suffix carries the shortest of its prefixes that its record hasn't shown
at an earlier position (``new_from``; all longer prefixes are new as well). Both counts then
just add up, so equal suffixes of an Arrow batch are folded before the shuffle: a term that
every record holds sends one row per batch and ``new_from``. A frequent
first term with very many continuations is routed by its first two terms; its own
row is summed over the routes at the end.

Within a batch all of this is array work: the stack closes a prefix where the next suffix differs within its length, so
the boundaries of each length are found at once, and only the prefixes open at the end of a batch are carried over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def record_terms(df: DataFrame, record: str, terms: str) -> DataFrame:
    """``__record, __terms``: one row per record; identical rows count once.

    Rows of one record that differ are one record with the sequences joined;
    null records are no records; null terms are left out.
    """
    rows = df.where(F.col(record).isNotNull()).select(F.col(record).alias("__record"), F.col(terms).alias("__terms"))
    return rows.groupBy("__record").agg(F.flatten(F.array_sort(F.collect_set("__terms"))).alias("__terms")).withColumn(
        "__terms", F.filter("__terms", lambda t: t.isNotNull())
    )


#: Positions of a batch that are cut at a time, or one record's.
POSITIONS = 1 << 20


def _lists(values: pa.Array, codes: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Lists of terms from rows of codes of which the first ``lengths`` count."""
    use = np.arange(codes.shape[1])[None, :] < lengths[:, None]
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), values.take(pa.array(codes[use])))


def _cut(max_n: int):
    """Cuts records into suffixes; equal ones are folded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column("__terms").offsets.to_numpy()
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + POSITIONS, side="right")) - 1)
                part = batch.column("__terms").slice(at, to - at)
                at = to
                if len(part.flatten()):
                    yield cut(part)

    def cut(lists: pa.ListArray) -> pa.RecordBatch:
        terms = lists.flatten().dictionary_encode()
        code = terms.indices.to_numpy().astype(np.int64)
        ends = lists.offsets.to_numpy().astype(np.int64)
        record = np.repeat(np.arange(len(lists)), np.diff(ends))
        left = (ends - ends[0])[record + 1] - np.arange(len(code))  # terms from here to the record's end
        rows = np.full((len(code), max_n), -1, np.int64)
        new_from = np.full(len(code), max_n + 1)
        name = np.zeros(len(code), np.int64)  # of the prefix
        for n in range(1, max_n + 1):
            here = left >= n
            rows[here, n - 1] = code[np.flatnonzero(here) + n - 1]
            name = np.unique(name * (len(terms.dictionary) + 1) + rows[:, n - 1] + 1, return_inverse=True)[1]
            first = np.unique(record * (name.max() + 1) + name, return_index=True)[1]
            fresh = np.zeros(len(code), bool)
            fresh[first] = True
            new_from[fresh & here & (new_from > n)] = n
        length = np.minimum(left, max_n)
        new_from = np.minimum(new_from, length + 1)
        _, first, count = np.unique(name * (max_n + 2) + new_from, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays(
            [_lists(terms.dictionary, rows[first], length[first]), pa.array(new_from[first], pa.int32()), pa.array(count, pa.int64())], ["suffix", "new_from", "occurrences"]
        )

    return run


def _stack(max_n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list] = {}  # by length: the prefix, its occurrences and records so far
        kind = None
        for batch in batches:
            lists = batch.column("suffix")
            kind = lists.type
            if not batch.num_rows:
                continue
            terms = lists.flatten().dictionary_encode()
            lengths = np.diff(lists.offsets.to_numpy())
            rows = np.full((len(lengths), max_n), -1, np.int64)
            rows[np.arange(max_n)[None, :] < lengths[:, None]] = terms.indices.to_numpy()
            new_from, count = batch.column("new_from").to_numpy(), batch.column("occurrences").to_numpy()
            for n in range(1, max_n + 1):
                use = np.flatnonzero(lengths >= n)
                if not len(use):
                    continue
                prefix = rows[use, :n]
                starts = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]).any(axis=1)])
                n_all = np.add.reduceat(count[use], starts)
                n_new = np.add.reduceat(np.where(new_from[use] <= n, count[use], 0), starts)
                grams = _lists(terms.dictionary, prefix[starts], np.full(len(starts), n))
                if n in open_:
                    gram, c, r = open_.pop(n)
                    if grams[0].as_py() == gram:
                        n_all[0] += c
                        n_new[0] += r
                    else:
                        yield closed([gram], [c], [r], kind)
                open_[n] = [grams[-1].as_py(), int(n_all[-1]), int(n_new[-1])]
                yield closed(grams[:-1], n_all[:-1], n_new[:-1], kind)
        for gram, c, r in open_.values():
            yield closed([gram], [c], [r], kind)

    def closed(grams, n_all, n_new, kind: pa.DataType) -> pa.RecordBatch:
        grams = grams if isinstance(grams, pa.Array) else pa.array(grams, kind)
        return pa.RecordBatch.from_arrays([grams.cast(kind), pa.array(n_all, pa.int64()), pa.array(n_new, pa.int64())], ["gram", "occurrences", "records"])

    return run


def ngram_counts(records: DataFrame, max_n: int = 1, *, routes: int | None = None) -> DataFrame:
    """``gram, occurrences, records`` of every n-gram of 1..``max_n`` terms.

    ``records`` comes from :func:`record_terms`. Defined results: records with null or
    empty sequences hold nothing; an empty table gives no rows; a record however long is
    cut into suffixes of ``max_n`` terms at most, none is dropped.
    """
    term = records.schema["__terms"].dataType.elementType.simpleString()
    suffixes = records.select("__terms").mapInArrow(_cut(max_n), f"suffix array<{term}>, new_from int, occurrences long")
    route = [F.get("suffix", F.lit(0))] + ([F.xxhash64(F.get("suffix", F.lit(1))) % 16] if max_n > 1 else [])
    keyed = suffixes.repartition(*([routes] if routes else []), *route).sortWithinPartitions(F.desc("suffix"))
    counted = keyed.mapInArrow(_stack(max_n), f"gram array<{term}>, occurrences long, records long")
    if max_n == 1:
        return counted  # a term has one route
    return counted.groupBy("gram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def term_marks(counts: DataFrame, total_records: DataFrame, *, rare_below: int, common_above: float) -> DataFrame:
    """Single terms with a mark: ``rare`` under so many records, ``common`` over such a share.

    ``total_records`` is one row with the column ``n``. A term that is both (a tiny
    table) is ``rare``. Terms in no record don't occur.
    """
    one = counts.where(F.size("gram") == 1).crossJoin(F.broadcast(total_records))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * F.col("n"), "common")
    return one.select(F.get("gram", F.lit(0)).alias("term"), "occurrences", "records", mark.alias("mark"))
