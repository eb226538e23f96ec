"""Token ids of whole texts by a public byte-level BPE tokenizer.

Per input partition: texts are split into words by the tokenizer's pattern; the words
not yet seen by the worker are encoded together by a recursive query in an embedded DuckDB; texts are then put
together from their words' ids. The recursive query holds one row per token of a word, with its
position. Each turn joins neighbouring tokens with the merge table, takes each word's pair of
least rank and contracts it, from the left, until no word has a pair left; an ordered
aggregation gives the ids.

All occurrences of the least pair are contracted in one turn. That is the same as one at a time: a
pair that a contraction brings about holds a token made later than the pair, so its rank is higher.
A word that is a token as a whole is its own fixpoint (tests encode the whole vocabulary without
this shortcut).

Words are kept per Python worker up to a number of bytes, then forgotten. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bitsieve.llm.pivots import kept

#: Where the vocabulary files lie, and the pattern that splits text into words.
VOCABULARIES = "/opt/tokenizers"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of distinct words that a worker remembers; turns of one recursive query.
REMEMBERED = 32 << 20
TURNS = 24

CONTRACT = """
WITH RECURSIVE step(turn, w, pos, tok, done) AS (
    SELECT 0, w, pos, tok, false FROM open
  UNION ALL (
    WITH pairs AS (
        SELECT turn, w, pos, tok, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS following FROM step WHERE NOT done AND turn < {turns}
    ), ranked AS (
        SELECT p.*, m.rank, m.id, min(m.rank) OVER (PARTITION BY w) AS least FROM pairs p LEFT JOIN merges m ON m.a = p.tok AND m.b = p.following
    ), runs AS (
        SELECT *, rank = least AS hit, count(*) FILTER (rank IS DISTINCT FROM least) OVER (PARTITION BY w ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM ranked
    ), marked AS (
        SELECT *, coalesce(hit, false) AND count(*) FILTER (hit) OVER (PARTITION BY w, run ORDER BY pos ROWS UNBOUNDED PRECEDING) % 2 = 1 AS starts FROM runs
    ), taken AS (
        SELECT *, lag(starts, 1, false) OVER (PARTITION BY w ORDER BY pos) AS ends FROM marked
    )
    SELECT turn + 1, w, pos, CASE WHEN starts THEN id ELSE tok END, least IS NULL FROM taken WHERE NOT ends
  )
)
SELECT w, list(tok ORDER BY pos) AS ids, bool_and(done) AS done FROM step WHERE done OR turn = {turns} GROUP BY w
"""


class Vocabulary:
    """Ranks and merges of one tokenizer, in an embedded database of its own."""

    def __init__(self, folder: str, name: str, *, shortcut: bool = True):
        import duckdb
        import regex

        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = pa.table({"a": [ids[a] for a, _ in pairs], "b": [ids[b] for _, b in pairs], "rank": range(len(pairs)), "id": [ids[a + b] for a, b in pairs]})
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.words = regex.compile(PATTERN)
        self.shortcut = shortcut
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        self.db.execute("CREATE TABLE merges AS SELECT a::INTEGER AS a, b::INTEGER AS b, rank::INTEGER AS rank, id::INTEGER AS id FROM merges")
        self.known: dict[str, list[int]] = {}
        self.held = 0

    def learn(self, words: list[str]) -> None:
        """Encodes words that aren't known, all in one recursive query per ``TURNS`` turns."""
        data = [w.encode() for w in words]
        if self.shortcut:
            whole = [self.rank.get(d) for d in data]
            self.known.update((w, [r]) for w, r in zip(words, whole, strict=True) if r is not None)
            rest = [i for i, r in enumerate(whole) if r is None]
            words, data = [words[i] for i in rest], [data[i] for i in rest]
        self.held += sum(map(len, data)) + 64 * len(data)
        # Words of more than about a million bytes in all go through the query in parts.
        start, size = 0, 0
        for i, d in enumerate(data):
            size += len(d)
            if size > 1 << 20 or i == len(data) - 1:
                self._contract(words[start : i + 1], data[start : i + 1])
                start, size = i + 1, 0

    def _contract(self, words: list[str], data: list[bytes]) -> None:
        lengths = np.array([len(d) for d in data], np.int64)
        tok = self.of_byte[np.frombuffer(b"".join(data), np.uint8)]
        w = np.repeat(np.arange(len(data)), lengths)
        pos = np.arange(len(tok)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        while len(w):
            open = pa.table({"w": pa.array(w, pa.int32()), "pos": pa.array(pos, pa.int32()), "tok": pa.array(tok, pa.int32())})  # noqa: A001
            self.db.register("open", open)
            # Fewer turns at once for very long words: the query keeps the rows of all its turns.
            out = self.db.sql(CONTRACT.format(turns=max(2, min(TURNS, TURNS * (1 << 18) // len(w))))).to_arrow_table()
            self.db.unregister("open")
            left = []
            for i, ids, done in zip(*(out.column(c).to_pylist() for c in ("w", "ids", "done")), strict=True):
                if done:
                    self.known[words[i]] = ids
                else:
                    left.append((i, ids))
            w = np.repeat(np.array([i for i, _ in left], np.int64), [len(x) for _, x in left])
            pos = np.concatenate([np.arange(len(x)) for _, x in left]) if left else w
            tok = np.concatenate([np.array(x, np.int32) for _, x in left]) if left else w

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        split = [self.words.findall(t) if t else [] for t in texts]
        known = self.known
        new = {x for words in split for x in words if x not in known}
        if self.held > REMEMBERED:
            known.clear()
            self.held = 0
            new = {x for words in split for x in words}
        if new:
            self.learn(list(new))
        for words in split:
            ids: list[int] = []
            for x in words:
                ids += known[x]
            yield ids


def _encoder(folder: str, name: str, only_sizes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = kept(f"vocabulary {folder} {name}", lambda: Vocabulary(folder, name))
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                encoded = list(v.encode(part.column("__text").to_pylist()))
                sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
                if only_sizes:
                    ids = pa.array(sizes)
                else:
                    flat = np.fromiter((i for x in encoded for i in x), np.int32, int(sizes.sum()))
                    ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat))
                cols = {c: part.column(c) for c in part.schema.names if c != "__text"}
                yield pa.RecordBatch.from_pydict(cols | {"__out": ids})

    return run


def encoded(df: DataFrame, key: str, text: str, *, name: str = "byte_bpe_50k", folder: str = VOCABULARIES, only_sizes: bool = False) -> DataFrame:
    """``key, ids`` (or ``key, n_tokens``) of every row.

    Defined results: null and empty texts have no ids; no special tokens are added, and text that looks like
    one is ordinary text; a text of any length is encoded whole; every row of ``df`` gives one row, repeated
    keys included; other columns aren't read.
    """
    rows = df.select(key, df[text].alias("__text"))
    kind = df.schema[key].dataType.simpleString()
    out = rows.mapInArrow(_encoder(folder, name, only_sizes), f"{key} {kind}, __out {'long' if only_sizes else 'array<int>'}")
    return out.withColumnRenamed("__out", "n_tokens" if only_sizes else "ids")
