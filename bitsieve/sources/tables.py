"""Stored tables and the shared work folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that every executor can reach")
    import tempfile

    return f"file://{tempfile.gettempdir()}"


_opened: dict[str, SparkSession] = {}


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for intermediate tables that every executor can reach.

    It lies in the folder named by ``spark.checkpoint.dir``. Where that is unset it is an error, but for a session
    with a local master (tests, one machine). All folders of an application have one parent, which is
    deleted when the driver's Python ends, or by :func:`discard`.
    """
    own = f"{_base(spark)}/bitsieve-{spark.sparkContext.applicationId}"
    if own not in _opened:
        _opened[own] = spark
        atexit.register(_discard_quietly, own)
    return f"{own}/{purpose}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _discard_quietly(path: str) -> None:
    try:
        discard(_opened.pop(path), path)
    except Exception:  # noqa: BLE001 - the session may be gone
        if path.startswith("file://"):
            import shutil

            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def stored(df: DataFrame, purpose: str, *, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the work folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = work_folder(spark, purpose)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    schema = df.schema
    writer.parquet(path)
    return spark.read.schema(schema).parquet(path)
