"""The ledger of jobs and steps: latest states, what to run, resets, transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The steps of a job in their order, and the retrieval steps of each kind of task with what they need.
STEPS = ["convert", "parse", "outline", "structure", "integrate"]
TEMPLATES = {
    "document": [("s1", "domain_search", []), ("s2", "document_search", ["s1"]), ("s3", "node_search", ["s2"])],
    "web": [("s1", "web_search", [])],
    "quantitative": [("s1", "domain_search", []), ("s2", "quantitative_search", ["s1"])],
    "mixed": [("s1", "domain_search", []), ("s2", "document_search", ["s1"]), ("s3", "node_search", ["s2"]), ("s4", "web_search", [])],
}
NEVER = "1970-01-01"


def latest_steps(log: DataFrame) -> DataFrame:
    """(job_id, step_name, status, updated_at): the last entry of each step; finished entries come after running ones."""
    at = F.coalesce("completed_at", "started_at", F.lit(NEVER).cast("timestamp_ntz"))
    return log.groupBy("job_id", "step_name").agg(F.max_by("status", F.struct(at, "id", "status")).alias("status"), F.max(at).alias("updated_at"))


def to_run(latest: DataFrame) -> DataFrame:
    """(job_id, step_name, step_no): the first step that is not completed and all behind it; jobs that are done give none."""
    jobs = latest.select("job_id").distinct()
    wanted = jobs.select("job_id", F.posexplode(F.array(*[F.lit(s) for s in STEPS])).alias("step_no", "step_name"))
    state = wanted.join(latest.select("job_id", "step_name", "status"), ["job_id", "step_name"], "left")
    first = F.min(F.when(F.coalesce("status", F.lit("")) != "completed", F.col("step_no"))).over(Window.partitionBy("job_id"))
    return state.withColumn("first", first).filter("step_no >= first").select("job_id", "step_name", "step_no")


def reset(latest: DataFrame, step: str) -> DataFrame:
    """The ledger after a reset: the named step and all behind it are gone, so that a cancelled job can run again."""
    order = F.array_position(F.array(*[F.lit(s) for s in STEPS]), F.col("step_name"))
    return latest.filter(order < STEPS.index(step) + 1)


def transitions(log: DataFrame) -> DataFrame:
    """(job_id, from_step, to_step): consecutive steps of a job by their start."""
    w = Window.partitionBy("job_id").orderBy("started_at", "id")
    return log.filter("started_at is not null").withColumn("from_step", F.lag("step_name").over(w)).filter("from_step is not null").select("job_id", "from_step", F.col("step_name").alias("to_step"))
