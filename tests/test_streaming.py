from pyspark.sql import functions as F

from bitsieve.config import LshConfig
from bitsieve.operators import search
from bitsieve.sources.store import Store
from bitsieve.streaming.lsh_append import append_to_index, index_rows


def test_streamed_index_equals_batch_index(spark, small_dir, tmp_path):
    rows = spark.read.parquet(f"{small_dir}/molecule_structure.parquet").select("id", "fingerprint")
    source, config = str(tmp_path / "in"), LshConfig(permutations=16, threshold=0.5)
    for part in (0, 1):
        rows.where(F.col("id") % 2 == part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
        append_to_index(stream, str(tmp_path / "index"), str(tmp_path / "checkpoint"), config).awaitTermination()
    got = {tuple(r) for r in index_rows(spark, str(tmp_path / "index")).collect()}
    want = {tuple(r) for r in search.lsh_index(Store(spark, small_dir).structures(), "structure", config).select("band", "key", "structure_id").collect()}
    assert got == want and got
