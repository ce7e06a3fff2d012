"""Every query of the library with its SQL, from the modules beside this one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loglake.plans import admin, coordination, functions, logs, metrics, relational, streams

QUERIES: dict = {}
ORACLES: dict = {}
for module in (logs, coordination, metrics, functions, relational, streams, admin):
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compacted topic, each partition's offsets beside its records."""
    from loglake.model import PLACE, event_log
    from loglake.operators.compact import compact
    from loglake.operators.read import watermarks

    log = event_log(spark, sf_dir)
    return compact(log).join(watermarks(log), PLACE).select(*PLACE, "offset", "key", "value", "log_start", "log_end", "high_watermark")
