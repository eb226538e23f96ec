"""Batches of arrivals checked against everything accepted before, without reprocessing it.

Accepted records lie in a persisted inverted file: cells with the full vectors, in files by a hash of the cell (a bucketed table, so
a join with probes never shuffles the history, and only files that hold a probed cell are read). A batch is
assigned to cells, probes exactly the cells that a distance bound can't rule out, reranks what it
meets there exactly, settles the order within the batch, and appends what is accepted to the cells. What a later
run needs (settings, pivots, ranges of the cells) is kept beside them: ``open`` takes up an index from its folder. Two
kinds of vectors are held:

* :class:`SetIndex`: sets of items under Jaccard similarity. Cells belong to pivots, a bounded sample of the
  stored sets, and are divided by the size of sets; the bound is the triangle inequality on the overlap with the cell's pivot.
* :class:`MixtureIndex`: fractions of named components. Cells are grid cells of the first fractions
  among mixtures of the same components; only neighbouring cells can hold a match.

Within a batch, arrival i is turned down if an earlier *accepted* arrival matches it, which
in turn may depend on still earlier ones. This is settled in rounds over keys, never over pairs
of equal arrivals: half as many rounds as the longest chain of dependent arrivals.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitsieve.llm.pivots import SLOTS, Bounds, Overlaps, Threshold, kept, nearest, size_bucket
from bitsieve.llm.set_pairs import _sketch
from bitsieve.sources.tables import discard, stored, work_folder

#: Pivots of a :class:`SetIndex`: the most sets that are sent to the driver and the workers to fit it.
PIVOTS = 2048


def _step(state: DataFrame) -> DataFrame:
    """One round of :func:`settle`: arrivals without an earlier open one are accepted, those with an earlier accepted one refused."""
    alive = state.where("state >= 0").select("seq", "state", F.explode("own").alias("key"))
    first = alive.groupBy("key").agg(F.min("seq").alias("any"), F.min(F.when(F.col("state") == 1, F.col("seq"))).alias("sure"))
    looks = state.where("state = 0").select("seq", F.explode("looks").alias("key"))
    met = looks.join(first, "key").groupBy("seq").agg(F.min("any").alias("any"), F.min("sure").alias("sure"))
    new = F.when(F.col("state") != 0, F.col("state")).when(F.col("sure") < F.col("seq"), -1).when(F.col("any").isNull() | (F.col("any") >= F.col("seq")), 1).otherwise(0)
    return state.join(met, "seq", "left").withColumn("state", new).drop("any", "sure")


def settle(batch: DataFrame) -> tuple[DataFrame, str]:
    """The rows of a batch with ``accepted``, and where they are written.

    ``batch``: ``seq`` (its order), ``refused`` (by what is known already), ``own``, the array of keys under
    which others find it, and ``looks``, the keys under which it looks for earlier ones.
    """
    state = batch.withColumn("state", F.when(F.col("refused"), -1).otherwise(0))
    while True:
        left, path = Observation(), work_folder(batch.sparkSession, "state")
        state = _step(_step(state)).withColumn("accepted", F.col("state") == 1)
        state.observe(left, F.count(F.when(F.col("state") == 0, 1)).alias("n")).write.parquet(path)
        state = batch.sparkSession.read.schema(state.schema).parquet(path)
        if not left.get["n"]:
            return state, path


def verdicts(settled: DataFrame) -> DataFrame:
    """``seq, verdict`` of the arrivals of any number of batches that aren't accepted.

    ``settled`` has ``batch, seq, exact_key, known_exact, accepted``: ``exact`` if the key was known before the batch or an
    earlier accepted arrival of the batch has it; else ``near``.
    """
    first = settled.where("accepted and exact_key is not null").groupBy("batch", "exact_key").agg(F.min("seq").alias("first"))
    out = settled.where("not accepted").join(first, ["batch", "exact_key"], "left")
    exact = F.col("known_exact") | F.coalesce(F.col("first") < F.col("seq"), F.lit(False))
    return out.select("seq", F.when(exact, "exact").otherwise("near").alias("verdict"))


class _Cells:
    """An inverted file: rows with a ``slot``, in one file per append and hash of the slot.

    A catalog entry without data of its own makes the files a bucketed table; it is made anew for each process.
    """

    def __init__(self, spark: SparkSession, folder: str, columns: str, buckets: int):
        self.spark, self.buckets, self.name = spark, buckets, f"bitsieve_{uuid.uuid4().hex}"
        self.columns = [c.split()[0] for c in columns.split(", ")]
        spark.sql(f"CREATE TABLE {self.name} (slot BIGINT, {columns}, zone INT) USING parquet PARTITIONED BY (zone) CLUSTERED BY (slot) INTO {buckets} BUCKETS LOCATION '{folder}/cells'")
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/cells")
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def zone(self, slot: str | Column) -> Column:
        """The file of a slot: what the planner's bucketing gives as well."""
        return F.pmod(F.hash(slot), F.lit(self.buckets))

    def append(self, rows: DataFrame) -> None:
        rows = rows.repartition(self.buckets, "slot").select("slot", *self.columns, self.zone("slot").alias("zone"))
        rows.write.insertInto(self.name)

    def rows(self, zones: list[int] | None = None) -> DataFrame:
        """All rows, or those of some files; the others aren't opened."""
        rows = self.spark.table(self.name)
        return (rows if zones is None else rows.where(F.col("zone").isin(zones))).drop("zone")

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


class _Index:
    """What both kinds share: a folder with settings and cells."""

    COLUMNS = ""

    def __init__(self, spark: SparkSession, folder: str, settings: dict):
        self.spark, self.folder, self.settings = spark, folder, settings
        self.cells = _Cells(spark, folder, self.COLUMNS, settings["buckets"])

    @staticmethod
    def _new(spark: SparkSession, folder: str | None, name: str, settings: dict, buckets: int | None = None) -> tuple[str, dict]:
        folder = folder or work_folder(spark, name)
        settings = settings | {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))}
        spark.createDataFrame([(json.dumps(settings),)], "settings string").coalesce(1).write.parquet(f"{folder}/settings")
        return folder, settings

    @classmethod
    def open(cls, spark: SparkSession, folder: str):
        """The index that an earlier run has left in ``folder``."""
        return cls(spark, folder, json.loads(spark.read.parquet(f"{folder}/settings").first()[0]))

    def close(self, *, delete: bool = False) -> None:
        self.cells.close()
        if delete:
            discard(self.spark, self.folder)


class SetIndex(_Index):
    """Sets with an exact key (null: none), held for matches at or above a threshold.

    A cell's rows are sets (``items``) or exact keys, which have slots of their own.
    """

    COLUMNS = "h BIGINT, n INT, sketch BIGINT, level INT, items ARRAY<BIGINT>, exact_key BINARY"
    ASSIGNED = "items array<bigint>, h long, n int, sketch long, slot long, level int"

    def __init__(self, spark: SparkSession, folder: str, settings: dict):
        super().__init__(spark, folder, settings)
        self.t = Threshold(settings["p"], settings["q"], settings["strict"])
        rows = spark.read.parquet(f"{folder}/pivots").orderBy("number").collect()  # at most as many as build was told
        pivots = [np.array(r["items"], np.int64) for r in rows] or [np.zeros(0, np.int64)]
        self.tag = hashlib.md5(repr([p.tolist() for p in pivots]).encode()).hexdigest()
        self.sent = spark.sparkContext.broadcast(pivots)
        self.ranges = np.zeros((0, 4), np.int64)
        self._learn(spark.read.parquet(f"{folder}/ranges"))

    @classmethod
    def build(cls, spark: SparkSession, stored_rows: DataFrame, threshold: Threshold, *, folder: str | None = None, pivots: int = PIVOTS, buckets: int | None = None) -> SetIndex:
        """``stored_rows``: ``exact_key`` and ``items`` (sorted, distinct longs; null or empty: no set). ``buckets``: files of one append, the
        session's shuffle partitions by default."""
        folder, settings = cls._new(spark, folder, "set-index", {"p": threshold.p, "q": threshold.q, "strict": threshold.strict}, buckets)
        sets = stored_rows.where("size(items) > 0").select("items").distinct()
        sample = sets.orderBy(F.md5(F.concat_ws(",", F.col("items").cast("array<string>")))).limit(pivots).collect()
        spark.createDataFrame([(i, r["items"]) for i, r in enumerate(sample)], "number int, items array<bigint>").coalesce(1).write.parquet(f"{folder}/pivots")
        spark.createDataFrame([], "cell long, b long, low long, high long").write.parquet(f"{folder}/ranges")
        self = cls(spark, folder, settings)
        self.cells.append(self._rows(self._assigned(sets, "home"), stored_rows.select("exact_key")))
        self._learn(self._ranges(self.cells.rows().where("items is not null")), keep=True)
        return self

    def _assigned(self, sets: DataFrame, how: str) -> DataFrame:
        """Distinct sets with their slot and level; to ``probe``, with the slots that can hold a match as well."""
        rows = sets.select("items", F.xxhash64("items").alias("h"), F.size("items").alias("n"), _sketch("items").alias("sketch"))
        if how == "home":
            return rows.mapInArrow(_homes(self.sent, self.tag), self.ASSIGNED)
        return rows.mapInArrow(_homes(self.sent, self.tag, self.ranges, self.t), f"{self.ASSIGNED}, probes array<long>, met array<int>")

    @staticmethod
    def _key_slot(key: str) -> Column:
        return F.xxhash64(key)

    def _rows(self, assigned: DataFrame, keys: DataFrame) -> DataFrame:
        keys = keys.where("exact_key is not null").distinct().select("exact_key", self._key_slot("exact_key").alias("slot"))
        return assigned.drop("probes", "met").unionByName(keys, allowMissingColumns=True)

    @staticmethod
    def _ranges(rows: DataFrame) -> DataFrame:
        """Range of levels by cell and size bucket."""
        size = rows.groupBy("slot").agg(F.min("level").alias("low"), F.max("level").alias("high"))
        return size.select(F.expr(f"slot div {SLOTS}").alias("cell"), F.expr(f"slot % {SLOTS}").alias("b"), F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))

    def _learn(self, ranges: DataFrame, *, keep: bool = False) -> None:
        """At most pivots x size buckets rows, whatever the table holds."""
        self._merge(np.stack([c.to_numpy() for c in ranges.toArrow().columns], axis=1).astype(np.int64).reshape(-1, 4), keep=keep)

    def _merge(self, new: np.ndarray, *, keep: bool) -> None:
        if keep and len(new):
            self.spark.createDataFrame(pa.table(dict(zip(("cell", "b", "low", "high"), map(pa.array, new.T), strict=True)))).coalesce(1).write.mode("append").parquet(f"{self.folder}/ranges")
        self.ranges = _merged(self.ranges, new)

    def check(self, batch: DataFrame) -> str:
        """Where the settled rows of a batch are written, see :func:`verdicts`; those accepted are appended.

        ``batch``: ``seq`` (unique, the order), ``exact_key`` and ``items``. An arrival without key and set is accepted.
        """
        batch = batch.select("seq", "exact_key", "items", F.when(F.size("items") > 0, F.xxhash64("items")).alias("h"))
        sets = stored(self._assigned(batch.where("h is not null").select("items").distinct(), "probe"), "assigned")
        keys = batch.where("exact_key is not null").select("exact_key").distinct().withColumn("slot", self._key_slot("exact_key"))
        # One small look at the batch: the ranges of its own slots, and which files its probes are in.
        own = sets.groupBy("slot").agg(F.min("level").alias("low"), F.max("level").alias("high"))
        zones = sets.select(F.explode("probes").alias("slot")).unionAll(keys.select("slot")).select(self.cells.zone("slot").alias("zone")).distinct()
        look = own.unionAll(zones.select((-1 - F.col("zone")).cast("long"), F.lit(None).cast("int"), F.lit(None).cast("int"))).collect()
        found = np.array([(r.slot // SLOTS, r.slot % SLOTS, r.low, r.high) for r in look if r.slot >= 0], np.int64).reshape(-1, 4)
        zone_list = [-1 - r.slot for r in look if r.slot < 0]

        within = sets.drop("probes", "met").mapInArrow(_homes(self.sent, self.tag, found, self.t), f"{self.ASSIGNED}, probes array<long>, met array<int>")
        asked = lambda s: s.select(F.col("h").alias("hy"), F.col("n").alias("ny"), F.col("sketch").alias("sy"), F.explode(F.arrays_zip("probes", "met")).alias("p")).select(
            "hy", "ny", "sy", F.col("p.probes").alias("slot"), F.col("p.met").alias("met")
        )
        side = lambda s, *more: s.select("slot", F.col("h").alias("hx"), F.col("n").alias("nx"), F.col("sketch").alias("sx"), "level", F.col("items").alias("x"), *more)
        total = "cast(nx + ny as bigint)"
        p, q = self.t.p, self.t.p + self.t.q
        least = f"({p} * ({total}) div {q} + 1)" if self.t.strict else f"(({p} * ({total}) + {q - 1}) div {q})"
        bound = f"{least} <= least(nx, ny) and met >= level - (nx - {least}) and met <= level + (ny - {least}) and bit_count(sx ^ sy) <= {total} - 2 * {least}"
        full = sets.select(F.col("h").alias("hy"), F.col("items").alias("y"))
        # Exact rerank on the full vectors.
        near = lambda met: met.join(full, "hy").where(F.size(F.array_intersect("x", "y")) >= F.expr(least))
        # Keys have slots of their own: one join with the history serves both.
        probes = asked(sets).unionByName(keys.select("slot", F.col("exact_key").alias("ky")), allowMissingColumns=True)
        met = side(self.cells.rows(zone_list), F.col("exact_key").alias("kx")).join(probes, "slot").where(F.expr(f"case when ky is null then coalesce({bound}, false) else coalesce(kx = ky, false) end"))
        by_key = met.where("ky is not null").select(F.col("ky").alias("exact_key"), F.lit(True).alias("known_exact")).distinct()
        by_set = near(met.where("ky is null")).select(F.col("hy").alias("h"), F.lit(True).alias("known_near")).distinct()
        between = near(side(sets).join(asked(within), "slot").where(F.expr(f"hx <> hy and {bound}")))
        between = between.groupBy(F.col("hy").alias("h")).agg(F.collect_set("hx").alias("near"))
        of_set = lambda c: F.concat(F.lit("s"), c.cast("string"))
        own = F.filter(F.array(F.concat(F.lit("k"), F.hex("exact_key")), of_set(F.col("h"))), lambda k: k.isNotNull())
        seen = batch.drop("items").join(by_key, "exact_key", "left").join(by_set, "h", "left").join(between, "h", "left").fillna(False, ["known_exact", "known_near"])
        seen = stored(
            seen.select("seq", "exact_key", "h", "known_exact", (F.col("known_exact") | F.col("known_near")).alias("refused"), own.alias("own"),
                        F.concat(own, F.coalesce(F.transform("near", of_set), F.array().cast("array<string>"))).alias("looks")), "seen",
        )
        settled, path = settle(seen)
        accepted = settled.where("accepted")
        self.cells.append(self._rows(sets.join(accepted.select("h").distinct(), "h", "left_semi"), accepted.select("exact_key")))
        self._merge(found, keep=True)
        return path


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    rows = np.concatenate([a, b])
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    first = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
    return np.c_[rows[first, :2], np.minimum.reduceat(rows[:, 2], first), np.maximum.reduceat(rows[:, 3], first)]


def _homes(sent, tag: str, ranges: np.ndarray | None = None, threshold: Threshold | None = None):
    """Slot and level of each set; with ``ranges``, the slots whose ranges admit a match, and the set's overlap with their pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = kept(tag, lambda: Overlaps(sent.value))
        bounds = None if ranges is None else Bounds(o.k, ranges, threshold, smaller_only=False)
        for batch in batches:
            sets = _sets(batch)
            slot, level, found = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int32), []
            for i, s in enumerate(sets):
                v = o.of(s)
                cell = nearest(v, len(s), o.sizes)
                slot[i], level[i] = cell * SLOTS + int(size_bucket(len(s))), v[cell]
                if bounds is not None:
                    rows = bounds.rows_for(v, len(s))
                    found.append((bounds.slot[rows], v[bounds.rows[rows, 0]].astype(np.int32)))
            cols = {c: batch.column(c) for c in ("items", "h", "n", "sketch")} | {"slot": pa.array(slot), "level": pa.array(level)}
            if bounds is not None:
                ends = pa.array(np.r_[0, np.cumsum([len(a) for a, _ in found])].astype(np.int32))
                empty = [(np.zeros(0, np.int64), np.zeros(0, np.int32))]
                cols |= {c: pa.ListArray.from_arrays(ends, pa.array(np.concatenate([f[k] for f in empty + found]))) for k, c in enumerate(("probes", "met"))}
            yield pa.RecordBatch.from_pydict(cols)

    return run


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    lists = batch.column("items")
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


class MixtureIndex(_Index):
    """Mixtures: named components with a fraction or null. Matches have the same components, nulls
    at the same ones, and fractions that each differ by less than ``within``."""

    COLUMNS = "cell STRING, fractions ARRAY<DOUBLE>, exact_key STRING"

    def __init__(self, spark: SparkSession, folder: str, settings: dict):
        super().__init__(spark, folder, settings)
        self.within = settings["within"]

    @classmethod
    def build(cls, spark: SparkSession, stored_rows: DataFrame, within: float, *, folder: str | None = None) -> MixtureIndex:
        """``stored_rows``: ``mixture`` (its components in order, as text) and ``fractions`` (aligned)."""
        self = cls(spark, *cls._new(spark, folder, "mixture-index", {"within": within}))
        self.cells.append(self._assigned(stored_rows.select("mixture", "fractions").distinct()))
        return self

    def _grid(self) -> Column:
        return F.transform(F.slice(F.filter("fractions", lambda f: f.isNotNull()), 1, 2), lambda f: F.floor(f / self.within).cast("long"))

    def _name(self, grid: Column) -> Column:
        nulls = F.array_join(F.transform("fractions", lambda f: F.when(f.isNull(), "0").otherwise("1")), "")
        return F.concat_ws("|", F.col("mixture"), nulls, F.array_join(grid, ","))

    def _assigned(self, rows: DataFrame) -> DataFrame:
        exact = F.concat_ws("|", F.col("mixture"), F.array_join(F.transform("fractions", lambda f: f.cast("string")), ",", "null"))
        return rows.withColumn("cell", self._name(self._grid())).withColumn("exact_key", exact).withColumn("slot", F.xxhash64("cell"))

    def check(self, batch: DataFrame) -> str:
        """As :meth:`SetIndex.check`, for ``seq, mixture, fractions``. An arrival without components
        (null or empty mixture) is accepted and matches nothing."""
        rows = self._assigned(batch.where("mixture <> ''").select("seq", "mixture", "fractions"))
        vectors = rows.drop("seq").dropDuplicates(["exact_key"])
        grid = self._grid()
        steps = F.array(*(F.array(F.lit(a), F.lit(b)) for a in (-1, 0, 1) for b in (-1, 0, 1)))
        around = F.array_distinct(F.transform(steps, lambda s: F.zip_with(grid, F.slice(s, 1, F.size(grid)), lambda g, d: g + d.cast("long"))))
        probes = vectors.select(F.col("exact_key").alias("key_y"), F.col("fractions").alias("y"), F.explode(F.transform(around, lambda g: self._name(g))).alias("cell"))
        probes = probes.withColumn("slot", F.xxhash64("cell"))
        zones = [r[0] for r in probes.select(self.cells.zone("slot")).distinct().collect()]
        side = lambda df: df.select("slot", "cell", F.col("exact_key").alias("key_x"), F.col("fractions").alias("x"))
        close = F.forall(F.zip_with("x", "y", lambda a, b: (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) < self.within, F.lit(False))), lambda ok: ok)
        known = side(self.cells.rows(zones)).join(probes, ["slot", "cell"]).where(close)
        known = known.groupBy(F.col("key_y").alias("exact_key")).agg(F.max(F.col("key_x") == F.col("key_y")).alias("known_exact"), F.lit(True).alias("refused"))
        between = side(vectors).join(probes, ["slot", "cell"]).where("key_x <> key_y").where(close)
        between = between.groupBy(F.col("key_y").alias("exact_key")).agg(F.collect_set("key_x").alias("near"))
        own = F.array("exact_key")
        seen = rows.join(known, "exact_key", "left").join(between, "exact_key", "left").fillna(False, ["known_exact", "refused"])
        seen = stored(seen.withColumn("own", own).withColumn("looks", F.concat(own, F.coalesce("near", F.array().cast("array<string>")))).drop("near"), "seen")
        settled, path = settle(seen)
        self.cells.append(settled.where("accepted").dropDuplicates(["exact_key"]))
        return path


def _read(index: SetIndex | MixtureIndex, arrivals: DataFrame, written: list[str]) -> DataFrame:
    if not written:
        return index.spark.createDataFrame([], T.StructType([arrivals.schema["seq"], T.StructField("verdict", T.StringType())]))
    parts = index.spark.read.parquet(*written).withColumn("batch", F.regexp_extract(F.input_file_name(), "([^/]*)/[^/]*$", 1))
    return verdicts(parts)


def in_batches(arrivals: DataFrame, batch: str, index: SetIndex | MixtureIndex) -> DataFrame:
    """The verdicts of batches that are checked one after another in the order of ``batch`` (null last), as each comes in."""
    arrivals = stored(arrivals, "arrivals")
    numbers = sorted((r[0] for r in arrivals.select(batch).distinct().collect()), key=lambda b: (b is None, b))
    return _read(index, arrivals, [index.check(arrivals.where(F.col(batch).eqNullSafe(number))) for number in numbers])


def in_order(arrivals: DataFrame, batch: str, index: SetIndex | MixtureIndex) -> DataFrame:
    """The same verdicts for batches that are all there: they are one batch, in the order of ``batch`` (null last) and ``seq``.

    What is accepted depends on that order only, so the history is probed once for all of them.
    """
    place = F.struct(F.col(batch).isNull().alias("last"), F.col(batch).alias("batch"), F.col("seq").alias("seq"))
    out = _read(index, arrivals, [index.check(stored(arrivals.withColumn("seq", place), "arrivals"))])
    return out.select("seq.seq", "verdict")
