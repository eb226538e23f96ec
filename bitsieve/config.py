"""Settings of a store, kept beside its tables."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from bitsieve.functions.sets import optimal_bands


@dataclass(frozen=True)
class FingerprintConfig:
    min_radius: int = 1
    max_radius: int = 6
    length: int = 2048
    number_active_bits: int = 2
    number_bit_pairs: int = 4


@dataclass(frozen=True)
class LshConfig:
    """MinHash settings of one index; the bands follow from them."""

    permutations: int = 64
    threshold: float = 0.7
    seed: int = 42

    def bands(self) -> tuple[int, int]:
        return optimal_bands(self.threshold, self.permutations)


@dataclass(frozen=True)
class EngineConfig:
    fingerprint: FingerprintConfig = FingerprintConfig()
    molecules: LshConfig = LshConfig()
    cgrs: LshConfig = LshConfig()

    def to_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, json.dumps(v)) for k, v in asdict(self).items()], "key string, value string")

    @staticmethod
    def from_table(rows: DataFrame) -> EngineConfig:
        """Missing keys keep their defaults."""
        v = {r.key: json.loads(r.value) for r in rows.collect()}
        kinds = {"fingerprint": FingerprintConfig, "molecules": LshConfig, "cgrs": LshConfig}
        return EngineConfig(**{k: kinds[k](**v[k]) for k in kinds if k in v})


def score_limit(value: float | None, default: float) -> float:
    """A limit in [0, 1]; anything else is an error."""
    if value is None:
        return default
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value <= 1:
        raise ValueError("a score limit lies between 0 and 1")
    return float(value)
