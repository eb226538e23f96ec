"""Similarity and containment search of many query records at once against a store of bit sets.

Everywhere ``queries`` has ``query, fp`` (sorted distinct bits) and the store has a key column and ``fp``. Searches
are joins on bits, band keys or lengths, or of blocks of sets, where pairs are cut by lengths, bits and sketches before they become rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitsieve.config import LshConfig, score_limit
from bitsieve.functions.sets import band_keys, minhash, tanimoto

#: Sets and queries that meet at a time in ``top_each``.
STORE_BLOCK, QUERY_BLOCK = 8192, 1024
#: Sets of a block, and queries that meet it, in ``similar_exact`` and ``containing``; 64-bit words of a bit matrix there, and of what is compared at a time.
SETS, ASKED, MATRIX, PIECE = 32768, 1 << 17, 1 << 22, 1 << 18


def lsh_index(records: DataFrame, key: str, config: LshConfig) -> DataFrame:
    """``band, key, structure_id``: the band keys of every non-empty set, one row each."""
    b, r = config.bands()
    keyed = records.where("size(fp) > 0").select(F.col(key).alias("structure_id"), band_keys(minhash("fp", config.permutations, config.seed), b, r).alias("keys"))
    return keyed.select(F.posexplode("keys").alias("band", "key"), "structure_id")


def lsh_candidates(queries: DataFrame, index: DataFrame, *, sizes: tuple[DataFrame, DataFrame] | None = None, limit: float = 0.0) -> DataFrame:
    """``query, structure_id`` of every two records that share a band key, once.

    ``queries`` has ``query, band, key``. Hot keys are joined in parts by the planner's skew handling. With ``sizes`` (``query, n`` and ``structure_id, m``) and a
    ``limit``, pairs whose lengths can't pass it are left out before they are made distinct.
    """
    if sizes is None:
        return queries.join(index, ["band", "key"]).select("query", "structure_id").distinct()
    fits = (F.col("m") > F.col("n") * limit - 1e-9) & (F.col("n") > F.col("m") * limit - 1e-9)
    return queries.join(sizes[0], "query").join(index.join(sizes[1], "structure_id"), ["band", "key"]).where(fits).select("query", "structure_id").distinct()


def sharing(pairs: DataFrame, queries: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """``pairs`` (``query``, ``key`` and other columns) of which both records share a band key, each once. Rows are met by record, so hot band keys don't matter."""
    met = pairs.join(index.withColumnRenamed("structure_id", key), key).join(queries, ["query", "band", "key"], "left_semi")
    return met.drop("band", "key").dropDuplicates(["query", key])


def scored(pairs: DataFrame, queries: DataFrame, store: DataFrame, key: str, limit: float | None) -> DataFrame:
    """``query, <store columns but fp>, t`` of candidate pairs; only t > limit where one is given."""
    limit = None if limit is None else score_limit(limit, 0.0)
    both = pairs.join(queries.select("query", F.col("fp").alias("__q")), "query").join(store.withColumnRenamed("fp", "__fp"), pairs["structure_id"] == store[key])
    out = both.withColumn("t", F.round(tanimoto("__q", "__fp"), 9)).drop("__q", "__fp", "structure_id")
    return out if limit is None else out.where(F.col("t") > limit)


def similar_exact(queries: DataFrame, store: DataFrame, key: str, limit: float) -> DataFrame:
    """All pairs with Tanimoto similarity above ``limit`` (>= 0).

    Blocks of queries meet blocks of stored sets of fitting lengths. Two sets above the limit differ in at most
    ``(n + m) (1 - limit) / (1 + limit)`` bits, so their 64-bit parity sketches differ in no more; pairs that pass this lossless test
    are counted exactly. No pair leaves its block before that.
    """
    limit = score_limit(limit, 0.0)
    low = max(0.0, limit - 1e-8)  # scores are rounded before they are compared
    most = (1 - low) / (1 + low)

    def pairs(q: _Sets, s: _Sets):
        for i, n in enumerate(q.sizes):
            first, last = np.searchsorted(s.n, np.ceil(n * low - 1e-6)), len(s.n) if low == 0 else np.searchsorted(s.n, n / low + 1e-6, "right")
            bound = np.minimum((n + s.n[first:last]) * most + 1e-6, 64).astype(np.uint8)
            own, step = q.of_size(i), max(1, PIECE // max(1, last - first))
            for at in range(own.start, own.stop if last > first else own.start, step):
                to = min(at + step, own.stop)
                near = np.nonzero(np.bitwise_count(q.parity[at:to, None] ^ s.parity[first:last]) <= bound)
                for x, y in _few(near[0] + at, near[1] + first, q.words):
                    i_ = np.bitwise_count(q.packed[x] & s.packed[y]).sum(axis=1, dtype=np.int64)
                    keep = i_ > np.maximum(0, low * (n + s.n[y] - i_) - 1e-6)
                    yield x[keep], y[keep], i_[keep]

    met = _in_blocks(queries, store, key, pairs).withColumn("t", F.round(F.col("__i") / (F.col("__n") + F.col("__m") - F.col("__i")), 9))
    return met.where(F.col("t") > limit).drop("__i", "__n", "__m")


def containing(queries: DataFrame, store: DataFrame, key: str, *, prefilter: bool = True) -> DataFrame:
    """Pairs whose stored set has every bit of the query's; ``t`` is the query's length over the stored one.

    An inverted index on bits within blocks: pairs are met through the query's rarest bit of the block only, then tested for the rest, by a 64-bit sketch first.
    ``prefilter`` keeps stored lengths from L to 10 L + 4, as ordered searches do.
    """

    def pairs(q: _Sets, s: _Sets):
        rows, codes = s.row[s.known], s.codes[s.known]
        df = np.bincount(codes, minlength=s.words * 64)
        posting, start = rows[np.argsort(codes, kind="stable")], np.r_[0, np.cumsum(df)]
        whole = np.flatnonzero(np.logical_and.reduceat(q.known, q.start)) if len(q.n) else np.zeros(0, int)
        rarest = np.minimum.reduceat(df[q.codes] * (1 << 32) + q.codes, q.start) & ((1 << 32) - 1) if len(q.n) else whole
        whole = whole[np.argsort(rarest[whole], kind="stable")]
        for own in np.split(whole, np.flatnonzero(np.diff(rarest[whole])) + 1):
            met = posting[start[rarest[own[0]]] : start[rarest[own[0]] + 1]] if len(own) else own
            step = max(1, PIECE // max(1, len(met)))
            for at in range(0, len(own) if len(met) else 0, step):
                part = own[at : at + step]
                near = np.nonzero((q.any[part, None] & ~s.any[met]) == 0)
                for x, y in _few(part[near[0]], met[near[1]], q.words):
                    keep = ~(q.packed[x] & ~s.packed[y]).any(axis=1)
                    yield x[keep], y[keep], q.n[x[keep]]

    met = _in_blocks(queries, store, key, pairs)
    if prefilter:
        met = met.where("__m <= 10 * __n + 4")
    return met.withColumn("t", F.round(F.col("__n") / F.col("__m"), 9)).drop("__i", "__n", "__m")


class _Sets:
    """Sets of a block, shortest first: 64-bit sketches (parity, any), and bit matrices over ``names``, the bits that either side may share."""

    def __init__(self, at: np.ndarray, n: np.ndarray, bits: np.ndarray, names: np.ndarray):
        self.at, self.n, self.words = at, n, len(names) // 64 + 1
        self.start = np.r_[0, np.cumsum(n)[:-1]].astype(np.int64) if len(n) else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(n)), n)
        self.sizes, self.first = np.unique(n, return_index=True)
        with np.errstate(over="ignore"):
            one = np.uint64(1) << ((bits.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58))
        self.parity, self.any = (f.reduceat(one, self.start) if len(n) else one for f in (np.bitwise_xor, np.bitwise_or))
        self.codes = np.minimum(np.searchsorted(names, bits), max(0, len(names) - 1))
        self.known = names[self.codes] == bits if len(names) else np.zeros(len(bits), bool)
        flat = np.zeros(len(n) * self.words, np.uint64)
        code = self.codes[self.known]
        np.add.at(flat, self.row[self.known] * self.words + (code >> 6), np.uint64(1) << (code & 63).astype(np.uint64))
        self.packed = flat.reshape(len(n), self.words)

    def of_size(self, i: int) -> slice:
        return slice(self.first[i], self.first[i + 1] if i + 1 < len(self.first) else len(self.n))


def _few(x: np.ndarray, y: np.ndarray, words: int):
    """Pairs, at most so many at a time that their words fit a piece."""
    step = max(1, PIECE // words)
    for at in range(0, len(x), step):
        yield x[at : at + step], y[at : at + step]


def _in_blocks(queries: DataFrame, store: DataFrame, key: str, pairs) -> DataFrame:
    """``query, <store columns but fp>, __n, __m, __i`` of the pairs (query row, stored row, shared bits) that ``pairs`` finds in every block of queries and of stored sets; empty sets are in none. Rows of the store that are repeated by ``key`` lie in one block, which takes the first."""
    queries, store = queries.where("size(fp) > 0"), store.where("size(fp) > 0")
    blocks = lambda df, name, n: df.agg(F.greatest(F.ceil(F.count(F.lit(1)) / n), F.lit(1)).cast("int").alias(name))
    parts = F.broadcast(blocks(store, "__s", SETS).crossJoin(F.broadcast(blocks(queries, "__q", ASKED))))
    own = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = [c for c in store.columns if c != "fp"]
    left = queries.crossJoin(parts).select("query", F.col("fp").alias("__fp"), own("query", "__q").alias("__qb"), every("__s").alias("__sb"))
    right = store.crossJoin(parts).select(*rest, F.col("fp").alias("__fp"), own(key, "__s").alias("__sb"), every("__q").alias("__qb"))

    def sets(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        column = block["__fp"].combine_chunks()
        n = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.argsort(n, kind="stable")
        return at, n[at], pc.list_flatten(column.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(np.int64)

    def cut(block: tuple, names: np.ndarray):
        at, n, bits = block
        ends, step = np.r_[0, np.cumsum(n)], max(1, MATRIX // (len(names) // 64 + 1))
        for i in range(0, len(n), step):
            to = min(i + step, len(n))
            yield _Sets(at[i:to], n[i:to], bits[ends[i] : ends[to]], names)

    def find(q: pa.Table, s: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 5]
        if q.num_rows and s.num_rows:
            once = np.unique(s[key].to_numpy(), return_index=True)[1]
            s = s if len(once) == s.num_rows else s.take(pa.array(once))
            one, two = sets(q), sets(s)
            names = np.intersect1d(one[2], two[2])
            for b in cut(two, names):
                for a in cut(one, names):
                    found += [(a.at[x], b.at[y], a.n[x], b.n[y], i) for x, y, i in pairs(a, b) if len(x)]
        x, y, n, m, i = (np.concatenate(c) for c in zip(*found, strict=True))
        out = {"query": q["query"].take(pa.array(x))} | {c: s[c].take(pa.array(y)) for c in rest}
        return pa.table(out | {"__n": pa.array(n, pa.int64()), "__m": pa.array(m, pa.int64()), "__i": pa.array(i, pa.int64())})

    kind = T.StructType([queries.schema["query"], *(store.schema[c] for c in rest), *(T.StructField(c, T.LongType()) for c in ("__n", "__m", "__i"))])
    return left.groupBy("__sb", "__qb").cogroup(right.groupBy("__sb", "__qb")).applyInArrow(find, kind)


def inverted(store: DataFrame, key: str) -> DataFrame:
    """``bit, key, n``: the postings of a store, with the length of each set."""
    return store.select(key, F.size("fp").alias("n"), F.explode("fp").alias("bit"))


def contained_counts(queries: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    """``query, key, hits``: bits of the query found in each stored set that has all of them, from the postings only.

    A query's bits are taken rarest first. Sets are met in the posting of its rarest bit; these are counted against the postings
    of the others, so no common bit's posting is joined with every query that has it.
    """
    df = postings.groupBy("bit").agg(F.count(F.lit(1)).alias("df"))
    bits = queries.select("query", F.size("fp").alias("need"), F.explode("fp").alias("bit")).join(df, "bit", "left")
    first = Window.partitionBy("query").orderBy(F.coalesce("df", F.lit(0)), "bit")
    bits = bits.withColumn("at", F.row_number().over(first))
    met = bits.where("at = 1").select("query", "need", "bit").join(postings, "bit").where("n >= need").select("query", "need", key)
    found = met.join(bits.select("query", "bit"), "query").join(postings.select("bit", key), ["bit", key])
    return found.groupBy("query", "need", key).agg(F.count(F.lit(1)).alias("hits")).where("hits = need").select("query", key, "hits")


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``."""
    return first_of(df, keys, order, 1)


def first_of(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows per key in ``order``."""
    return df.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__at") <= k).drop("__at")


def top(df: DataFrame, k: int, *tie: str) -> DataFrame:
    """The k best rows by t, ties by the given columns."""
    return df.orderBy(F.desc("t"), *tie).limit(k)


def top_each(queries: DataFrame, store: DataFrame, key: str, k: int) -> DataFrame:
    """``query, key, molecule, t``: the k best of all stored sets for every query, also those that share no bit with it.

    Blocks of at most some thousand sets meet blocks of queries as products of bit matrices; each block keeps its k
    best, and the best of all blocks are taken by rank. Scores are compared in billionths, ties go to the least molecule and key.
    """
    none = F.lit(-(1 << 63))
    blocks = lambda df, n: F.broadcast(df.agg(F.ceil(F.count(F.lit(1)) / n).cast("int").alias("n")))
    parts = blocks(store, STORE_BLOCK).withColumnRenamed("n", "__s").crossJoin(blocks(queries, QUERY_BLOCK).withColumnRenamed("n", "__q"))
    own = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.crossJoin(F.broadcast(parts)).select("query", F.col("fp").alias("__fp"), own("query", "__q").alias("__qb"), every("__s").alias("__sb"))
    right = store.crossJoin(F.broadcast(parts)).select(F.col(key).alias("__key"), F.coalesce("molecule", none).alias("__m"), F.col("fp").alias("__fp"), own(key, "__s").alias("__sb"), every("__q").alias("__qb"))

    def best(q, s):
        import numpy as np
        import pandas as pd

        s = s.sort_values(["__m", "__key"], ignore_index=True)
        m = s["__fp"].map(len).to_numpy(np.int64)
        bits, row = np.concatenate([np.asarray(x) for x in s["__fp"]] or [np.zeros(0, int)]), np.repeat(np.arange(len(s)), m)
        out = [pd.DataFrame({"query": np.zeros(0, np.int64), "__key": np.zeros(0, np.int64), "__m": np.zeros(0, np.int64), "__b": np.zeros(0, np.int64)})]
        for at in range(0, len(q) if len(s) else 0, 256):
            part = q.iloc[at : at + 256]
            n = part["__fp"].map(len).to_numpy(np.int64)
            asked = np.concatenate([np.asarray(x) for x in part["__fp"]])
            names = np.unique(asked)
            one = np.zeros((len(part), len(names)), np.float32)
            one[np.repeat(np.arange(len(part)), n), np.searchsorted(names, asked)] = 1
            place = np.minimum(np.searchsorted(names, bits), len(names) - 1)
            met = names[place] == bits
            two = np.zeros((len(s), len(names)), np.float32)
            two[row[met], place[met]] = 1
            i = (one @ two.T).astype(np.int64)
            u = n[:, None] + m[None, :] - i
            b = (i * 2_000_000_000 + u) // (2 * u)
            rank = b * len(s) + (len(s) - 1 - np.arange(len(s)))
            first = np.argpartition(-rank, k - 1, axis=1)[:, :k] if k < len(s) else np.tile(np.arange(len(s)), (len(part), 1))
            each, flat = first.shape[1], first.ravel()
            out.append(pd.DataFrame({"query": np.repeat(part["query"].to_numpy(), each), "__key": s["__key"].to_numpy()[flat], "__m": s["__m"].to_numpy()[flat], "__b": np.take_along_axis(b, first, 1).ravel()}))
        return pd.concat(out, ignore_index=True)

    met = left.groupBy("__sb", "__qb").cogroup(right.groupBy("__sb", "__qb")).applyInPandas(best, "query long, __key long, __m long, __b long")
    met = first_of(met, ["query"], [F.desc("__b"), F.col("__m"), F.col("__key")], k)
    return met.select("query", F.col("__key").alias(key), F.nullif("__m", none).alias("molecule"), (F.col("__b") / F.lit(1e9)).alias("t"))
