"""A question's plan: steps with dependencies, run as lazy DataFrames, with bounded retries."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.ledger import TEMPLATES
from docloom.operators.rules import INTERNAL, TASK_TYPES
from docloom.providers import Provider
from docloom.sources import paths

MAX_SEARCHES, MAX_WRITES = 3, 2


@dataclass
class Step:
    step_id: str
    kind: str
    needs: list[str]
    status: str = "pending"
    error: str = ""


@dataclass
class Plan:
    query: str
    task_type: str
    steps: list[Step]
    events: list[dict] = field(default_factory=list)

    def tell(self, kind: str, message: str) -> None:
        self.events.append({"type": kind, "message": message})


def planned(query: str, provider: Provider | None = None) -> Plan:
    """The provider's plan with its type repaired: unknown types and questions about internal documents become document searches."""
    raw = (provider or Provider()).plan(query)
    kind = raw.get("task_type") if raw.get("task_type") in TASK_TYPES else "document"
    if kind == "web" and re.search(INTERNAL, query):
        kind = "document"
    return Plan(raw.get("embedding_query") or query, kind, [Step(i, k, list(n)) for i, k, n in TEMPLATES[kind]])


def execute(plan: Plan, handlers: dict[str, Callable[[Plan, dict[str, DataFrame]], DataFrame]]) -> dict[str, DataFrame]:
    """Results by step. A step runs when all it needs is done; after a failure its dependents stay pending.

    Handlers return lazy DataFrames, so independent steps end up in one Spark plan.
    """
    done: dict[str, DataFrame] = {}
    for step in plan.steps:
        if any(n not in done for n in step.needs):
            continue
        step.status = "in_progress"
        plan.tell("progress", step.kind)
        try:
            done[step.step_id] = handlers[step.kind](plan, {n: done[n] for n in step.needs})
            step.status = "done"
        except Exception as e:  # a failed step is data, as an empty result is
            step.status, step.error = "failed", str(e)
            plan.tell("error", f"{step.kind}: {e}")
    return done


def rewritten(plan: Plan, query: str) -> Plan:
    """The plan for another wording: all its steps pending again, its type and events kept."""
    return Plan(query, plan.task_type, [Step(s.step_id, s.kind, list(s.needs)) for s in plan.steps], plan.events)


class JobCancelled(Exception):
    pass


def run_job(spark: SparkSession, folder: str, job_id: str, steps: list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]], cancelled: Callable[[str], bool] = lambda job: False) -> dict[str, DataFrame]:
    """Results by step name. Steps run in order, each on the results before it, and their results are stored.

    A step that was completed is read, not run; one that was not, or failed, runs. The
    ledger below ``folder`` gets a row for every start and end; a failure is recorded
    and raised, a cancellation is looked for before each step.
    """
    ledger = f"{folder}/ledger"
    kind = "job_id string, step_name string, status string, error string, result string, at timestamp"

    def tell(step: str, status: str, error: str = "", result: str = "") -> None:
        row = spark.createDataFrame([(job_id, step, status, error, result)], "job_id string, step_name string, status string, error string, result string")
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(ledger)

    done: dict[str, DataFrame] = {}
    log = spark.read.schema(kind).parquet(ledger).filter(F.col("job_id") == job_id) if paths.exists(spark, ledger) else spark.createDataFrame([], kind)
    stored = {r.step_name: r for r in log.groupBy("step_name").agg(F.max_by("status", "at").alias("status"), F.max_by("result", "at").alias("result")).collect()}  # a row a step
    for name, run in steps:
        if cancelled(job_id):
            raise JobCancelled(job_id)
        if name in stored and stored[name].status == "completed":
            done[name] = spark.read.parquet(stored[name].result)
            continue
        tell(name, "running")
        path = f"{folder}/{job_id}/{name}-{uuid.uuid4().hex}"
        try:
            run(done).write.parquet(path)
        except Exception as e:
            tell(name, "failed", f"{name}: {str(e).splitlines()[0] if str(e) else type(e).__name__}")
            raise
        tell(name, "completed", "", path)
        done[name] = spark.read.parquet(path)
    return done


def answered(query: str, search: Callable[[str], list[str]], provider: Provider | None = None, rewrite: Callable[[str, int], str] | None = None) -> dict:
    """Search until the judge finds something to use, write until the verifier passes; both bounded, a partial answer is kept."""
    p = provider or Provider()
    plan = planned(query, p)
    asked, texts, used = plan.query, [], []
    for attempt in range(MAX_SEARCHES + 1):
        plan.tell("progress", f"search {attempt + 1}")
        texts = search(asked)
        used = p.judge(query, texts)
        if used or attempt == MAX_SEARCHES:
            break
        asked = rewrite(asked, attempt) if rewrite else asked
    chosen = [texts[i - 1] for i in used] or texts
    text, signal = "", "RETRY_WRITER"
    for attempt in range(MAX_WRITES + 1):
        plan.tell("progress", f"write {attempt + 1}")
        text = p.write(query, chosen)
        signal = p.verify(text, "\n".join(chosen))
        if signal == "PASS":
            break
    plan.tell("done" if signal == "PASS" and used else "error", signal)
    return {"answer": text, "signal": signal, "used": used, "events": plan.events, "complete": bool(used) and signal == "PASS"}
