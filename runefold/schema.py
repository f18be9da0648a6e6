"""Record model, configuration and errors of the key-value engine."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import types as T

#: One operation of the log: ``ts`` in microseconds; (ts, seq) is the order of records.
LOG = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("tombstone", T.BooleanType(), False),
        T.StructField("ts", T.LongType(), False),
        T.StructField("seq", T.LongType(), False),
    ]
)
RUN = T.StructType([*LOG.fields, T.StructField("level", T.IntegerType()), T.StructField("run_id", T.StringType())])
STATE = T.StructType([LOG["key"], LOG["value"], LOG["ts"]])

# Key prefixes that hold the engine's own objects.
BLOOM, COUNT_MIN, HYPERLOGLOG, SIMHASH, BUCKET = b"bl00m_f1lt3r/", b"c0unt_m1n_$k3tch/", b"hyp3r_l0g_l0g/", b"$1m_ha$h/", b"t0k3n_buck3t/state"
RESERVED = (BLOOM, COUNT_MIN, HYPERLOGLOG, SIMHASH, BUCKET)


class ReservedKeyError(ValueError):
    """A user operation names a key under a reserved prefix."""


class ProbabilisticTypeError(KeyError):
    """No sketch of that kind and name exists."""


class TokenBucketError(RuntimeError):
    """The rate limiter refused the operation."""


@dataclass
class DBConfig:
    """Settings with their defaults; unknown fields of a file are ignored, missing and null ones take the default."""

    # Names and defaults of the configuration file.

    bloom_filter_probability: float = 0.1
    bloom_filter_cap: int = 1_000_000
    skip_list_max_level: int = 10
    hyperloglog_precision: int = 10
    write_ahead_log_dir: str = "./wal/"
    write_ahead_log_num_of_logs: int = 1000
    write_ahead_log_size: int = 1_048_576
    b_tree_order: int = 10
    count_min_sketch_probability: float = 0.001
    count_min_sketch_tolerance: float = 0.99999
    memory_table_capacity: int = 1000
    memory_table_type: str = "BTree"
    memory_table_pool_num: int = 10
    summary_density: int = 3
    index_density: int = 2
    sstable_single_file: bool = False
    sstable_dir: str = "./sstables/"
    lsm_max_level: int = 5
    lsm_max_per_level: int = 5
    lsm_leveled_amplification: int = 10
    cache_max_size: int = 5000
    token_bucket_capacity: int = 1000
    token_bucket_refill_rate: int = 100
    compaction_enabled: bool = True
    compaction_algorithm_type: str = "SizeTiered"
    use_compression: bool = True
    use_variable_encoding: bool = True
    compression_dictionary_path: str = "./dictionary.bin"

    def __post_init__(self):
        if self.lsm_max_level < 2:
            raise ValueError("lsm_max_level must be at least 2")
        if self.compaction_algorithm_type not in ("SizeTiered", "Leveled"):
            raise ValueError(f"unknown compaction algorithm {self.compaction_algorithm_type}")

    @classmethod
    def load(cls, path: str) -> DBConfig:
        with open(path) as f:
            given = json.load(f)
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in given.items() if k in known and v is not None})

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(asdict(self), f, indent=2)
