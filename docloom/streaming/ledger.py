"""The step log as a stream: the latest state of each step, late entries included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_status(stream: DataFrame) -> DataFrame:
    """(job_id, step_name, status, updated_at) for update or complete mode.

    The state holds one row a step of a job; an entry that arrives days late wins
    only if it is the newer one by its own time.
    """
    at = F.coalesce("completed_at", "started_at", F.lit("1970-01-01").cast("timestamp_ntz"))
    return stream.groupBy("job_id", "step_name").agg(F.max_by("status", F.struct(at, "id", "status")).alias("status"), F.max(at).alias("updated_at"))


def sessions(stream: DataFrame, at: str, key: str, gap: str, late: str) -> DataFrame:
    """Activity of a key in sessions that end after a gap."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
