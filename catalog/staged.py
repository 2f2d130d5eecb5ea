"""Tables that several queries share are written once per session and read back.

These are the hand-over points between the steps of the work: visit counts,
profiles, the place-to-category map. They live in the shared folder, so neither
recomputation nor a lost executor touches what follows.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from placewise.session import scratch_path

_PATHS: dict[tuple[str, str, str], tuple[str, object]] = {}

#: Seconds spent on writing each table, without the tables that it needed itself.
SECONDS: dict[str, float] = {}
_INNER = [0.0]


def staged(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Write the table on first use in a session and data folder; read it after that."""

    @wraps(build)
    def read(spark: SparkSession, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf, f"{build.__module__}.{build.__name__}")
        if key not in _PATHS:
            start = time.time()
            _INNER.append(0.0)
            df = build(spark, sf)
            path = scratch_path(spark, build.__name__)
            df.write.parquet(path)
            _PATHS[key] = (path, df.schema)
            whole = time.time() - start
            SECONDS[key[2]] = SECONDS.get(key[2], 0.0) + whole - _INNER.pop()
            _INNER[-1] += whole
        path, schema = _PATHS[key]
        return spark.read.schema(schema).parquet(path)

    return read
