"""Job ledger and event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import ledger
from docloom.registry import Registry
from docloom.streaming import ingest

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
query = R.query

_AT = "coalesce(completed_at, started_at, timestamp '1970-01-01')"
_LS = f"ls as (select job_id, step_name, arg_max(status, ({_AT}, id, status)) as status, max({_AT}) as updated_at from parser_job_steps group by 1, 2)"
_STEPS = "('convert', 0), ('parse', 1), ('outline', 2), ('structure', 3), ('integrate', 4)"


@query(f"with {_LS} select job_id, step_name, status, updated_at from ls")
def job_latest_state(x):
    return ledger.latest_steps(x.parser_job_steps)


@query(
    f"""with {_LS}, st(step_name, step_no) as (values {_STEPS}), w as (select j.job_id, st.step_name, st.step_no, ls.status from (select distinct job_id from ls) j cross join st left join ls on ls.job_id = j.job_id and ls.step_name = st.step_name),
    f as (select *, min(case when coalesce(status, '') <> 'completed' then step_no end) over (partition by job_id) as first from w) select job_id, step_name, cast(step_no as integer) as step_no from f where step_no >= first"""
)
def steps_to_run(x):
    return ledger.to_run(ledger.latest_steps(x.parser_job_steps))


@query(f"with {_LS}, st(step_name, step_no) as (values {_STEPS}) select job_id, step_name, status from ls join st using (step_name) where step_no < 2")
def steps_after_reset(x):
    return ledger.reset(ledger.latest_steps(x.parser_job_steps), "outline").select("job_id", "step_name", "status")


@query(
    """with l as (select *, lag(step_name) over (partition by job_id order by started_at, id) as from_step from (select distinct id, job_id, step_name, started_at from parser_job_steps where started_at is not null))
    select from_step, step_name as to_step, count(*) as n from l where from_step is not null group by 1, 2"""
)
def step_transitions(x):
    log = x.parser_job_steps.select("id", "job_id", "step_name", "started_at").distinct()
    return ledger.transitions(log).groupBy("from_step", "to_step").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_LS} select step_name, count(*) as total, count(*) filter (status = 'completed') as completed, count(*) filter (status = 'running') as running, count(*) filter (status = 'failed') as failed from ls group by 1")
def job_status_counts(x):
    s = F.col("status")
    return ledger.latest_steps(x.parser_job_steps).groupBy("step_name").agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "completed").alias("completed"), F.count_if(s == "running").alias("running"), F.count_if(s == "failed").alias("failed"))


_TPL = """('document', 's1', 'domain_search', ''), ('document', 's2', 'document_search', 's1'), ('document', 's3', 'node_search', 's2'), ('web', 's1', 'web_search', ''), ('quantitative', 's1', 'domain_search', ''), ('quantitative', 's2', 'quantitative_search', 's1'),
    ('mixed', 's1', 'domain_search', ''), ('mixed', 's2', 'document_search', 's1'), ('mixed', 's3', 'node_search', 's2'), ('mixed', 's4', 'web_search', '')"""


@query(
    f"""with tp(task_type, step_id, step_type, needs) as (values {_TPL}), d as (select doc_id, case doc_id % 4 when 0 then 'document' when 1 then 'web' when 2 then 'quantitative' else 'mixed' end as task_type from documents)
    select d.doc_id, tp.step_id, tp.step_type, tp.needs from d join tp using (task_type)"""
)
def task_template_steps(x):
    """The steps of each task; the template is a few rows."""
    rows = [(k, i, t, ",".join(d)) for k, steps in ledger.TEMPLATES.items() for i, t, d in steps]
    tp = x.spark.createDataFrame(rows, "task_type string, step_id string, step_type string, needs string")
    m = F.col("doc_id") % 4
    kind = F.when(m == 0, "document").when(m == 1, "web").when(m == 2, "quantitative").otherwise("mixed")
    return x.documents.select("doc_id", kind.alias("task_type")).join(F.broadcast(tp), "task_type").select("doc_id", "step_id", "step_type", "needs")


@query(
    """select distinct job_id, id, case when status = 'failed' then 'error' when status = 'completed' and step_name = 'integrate' then 'done' else 'progress' end as type,
    concat_ws(' ', step_name, status) as message, started_at from parser_job_steps where started_at is not null"""
)
def progress_events(x):
    """The step log as progress, done and error messages, in order."""
    s = F.col("status")
    kind = F.when(s == "failed", "error").when((s == "completed") & (F.col("step_name") == ledger.STEPS[-1]), "done").otherwise("progress")
    e = x.parser_job_steps.filter("started_at is not null")
    return e.select("job_id", "id", kind.alias("type"), F.concat_ws(" ", "step_name", "status").alias("message"), "started_at").distinct()


@query("with e as (select event_id, any_value(date_trunc('hour', ts)) as hour, any_value(event_type) as event_type, any_value(value) as value from events group by 1) select hour, event_type, count(*) as n, round(sum(value), 6) as value from e group by 1, 2")
def stream_ingest_dedupe(x):
    """The event log read as a stream, repeated events dropped within a watermark, counted per hour and type."""
    return ingest.hourly_events(x.spark, f"{x.folder}/events.parquet")
