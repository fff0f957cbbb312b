"""The library's front: ingest files, search, inspect, run guarded SQL, run jobs.

Tables are append-only. Every write belongs to a run, a sub-folder of the table; a run
counts once its name is published, which is one write at its end, so that a failure
leaves nothing behind that a reader sees and a repeat adds nothing. A deletion is a
published list of documents that hides what earlier runs wrote of them.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import schemas
from docloom.functions.text import analyze
from docloom.operators import flow, ledger, retrieval, rules, sections
from docloom.providers import Provider, embedded, proposed
from docloom.sources import files as sources
from docloom.sources import paths


class Engine:
    """Catalogue tables below one folder. Every method returns a lazy DataFrame, ``ingest`` and ``delete`` write."""

    def __init__(self, spark: SparkSession, folder: str, provider: Provider | None = None) -> None:
        self.spark, self.folder, self.provider = spark, folder.rstrip("/"), provider or Provider()

    def _runs(self) -> list[str]:
        return [r.run for r in self._read("_runs", "run string").select("run").collect()]  # one row an ingest

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(path) if paths.exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def table(self, name: str) -> DataFrame:
        """The published rows of a table, without deleted documents; an empty table before the first ingest."""
        rows = self._read(f"{name}.parquet", f"{schemas.ENGINE[name]}, run string").filter(F.col("run").isin(self._runs()))
        gone = self._read("_deleted", "document_id string, at string").groupBy("document_id").agg(F.max("at").alias("at"))
        return rows.join(gone, "document_id", "left").filter("at is null or run > at").drop("run", "at")

    @staticmethod
    def _stamp() -> str:
        return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def ingest(self, files: str, convert: Callable[[str, bytes], tuple[str, bytes]] | None = None) -> None:
        """Files to documents, sections, propositions and vectors; contents at hand are left alone, so a repeat adds nothing.

        Of equal files one path is chosen by their digests; no file's bytes are shuffled.
        ``convert`` turns formats that need it into ones that are read.
        """
        run = self._stamp()
        write = lambda df, name: df.write.parquet(f"{self.folder}/{name}.parquet/run={run}")
        staged = lambda name: self.spark.read.parquet(f"{self.folder}/{name}.parquet/run={run}")
        every = sources.files(self.spark, files)
        digests = every.select("document_id", "path", "extension").groupBy("document_id").agg(F.min_by("extension", "path").alias("extension"), F.min("path").alias("source_path"))
        write(digests.join(self.table("documents").select("document_id"), "document_id", "left_anti"), "documents")
        ids = staged("documents")
        new = every.join(ids.select(F.col("source_path").alias("path")), "path", "left_semi")
        write(sources.blocks(sources.prepared(new, convert=convert)), "blocks")
        s = sections.heading_sections(staged("blocks").filter("block_type = 'text'").withColumnRenamed("content", "text"), "document_id")
        write(s.withColumn("section_id", F.xxhash64("document_id", "section_no")), "sections")
        p = staged("sections").withColumn("p", proposed(F.col("title"), F.col("content"), self.provider))
        p = p.select("document_id", "section_id", "title", F.col("p.keywords").alias("keywords"), F.posexplode("p.propositions").alias("seq", "proposition"))
        write(embedded(p, "proposition", "v", self.provider).withColumn("id", F.xxhash64("section_id", "seq")), "propositions")
        self.spark.createDataFrame([(run,)], "run string").coalesce(1).write.mode("append").parquet(f"{self.folder}/_runs")

    def delete(self, document_ids: list[str]) -> None:
        """Hide documents with all their children; one write, so that readers see all of it or nothing. A later ingest may bring them back."""
        at = self._stamp()
        self.spark.createDataFrame([(d, at) for d in document_ids], "document_id string, at string").coalesce(1).write.mode("append").parquet(f"{self.folder}/_deleted")

    def _nodes(self) -> DataFrame:
        return self.table("propositions").select("id", "document_id", "section_id", F.col("proposition").alias("text"), "v")

    def _asked(self, query: str) -> tuple[list[float], list[str]]:
        terms = self.spark.range(1).select(analyze(F.lit(query)).alias("t")).first().t
        return self.provider.embed([query])[0], sorted(set(terms))

    def search(self, query: str, k: int = 10, document_ids: list[str] | None = None) -> DataFrame:
        """Hybrid search of the propositions, expanded to their sections; where the vector search fails, the first chunks that match."""
        n = self._nodes()
        where = F.col("document_id").isin(document_ids) if document_ids else None
        ranked = retrieval.with_fallback(lambda: retrieval.hybrid(n, *self._asked(query), k, where=where), n, k, where)
        few = ranked.select("id", "score", "rank")
        hits = n.drop("v").join(F.broadcast(few), "id")  # k rows
        texts = self.table("sections").select("section_id", F.col("content").alias("text"))
        none = F.lit(None).cast("int")
        return retrieval.small_to_big(hits, texts, texts.select("section_id", none.alias("first_page"), none.alias("last_page")))

    def handlers(self, sql: Callable[[str], DataFrame] | None = None, pages: DataFrame | None = None) -> dict[str, Callable]:
        """What each kind of step runs: a function (plan, results of the steps it needs) -> DataFrame."""
        n = self._nodes()

        def ranked_documents(plan: flow.Plan, k: int) -> DataFrame:
            best = retrieval.hybrid(n, *self._asked(plan.query), 4 * k).join(n.select("id", "document_id"), "id")
            return best.groupBy("document_id").agg(F.max("score").alias("score"))

        def domain(plan: flow.Plan, needs: dict) -> DataFrame:
            return ranked_documents(plan, 10)

        def document(plan: flow.Plan, needs: dict) -> DataFrame:
            allowed = next(iter(needs.values())).select("document_id")
            return ranked_documents(plan, 10).join(allowed, "document_id", "left_semi").orderBy(F.desc("score"), "document_id").limit(3)

        def node(plan: flow.Plan, needs: dict) -> DataFrame:
            inside = n.join(F.broadcast(next(iter(needs.values())).select("document_id")), "document_id", "left_semi")
            return retrieval.hybrid(inside, *self._asked(plan.query), 15)

        def image(plan: flow.Plan, needs: dict) -> DataFrame:
            b = self.table("blocks").filter("block_type = 'image'").select(F.xxhash64("document_id", "seq").alias("id"), F.col("content").alias("text"))
            return retrieval.ranked(retrieval.bm25(b, self._asked(plan.query)[1]), 5)

        def web(plan: flow.Plan, needs: dict) -> DataFrame:
            found = pages if pages is not None else self.spark.createDataFrame([], "id bigint, text string")
            return retrieval.ranked(retrieval.bm25(found, self._asked(plan.query)[1]), 5).withColumn("score", 1.0 / F.col("rank"))

        def quantitative(plan: flow.Plan, needs: dict) -> DataFrame:
            if sql is None:
                raise ValueError("no translation of questions into SQL")
            return sql(plan.query)

        return {"domain_search": domain, "document_search": document, "node_search": node, "image_search": image, "web_search": web, "quantitative_search": quantitative}

    def answer(self, query: str, k: int = 10) -> dict:
        """Search, judge, write, verify; a handful of rows reaches the driver. An answer that fails the check is written again from twice as many sections."""
        rows = self.search(query, k).orderBy("position").limit(k).collect()
        texts = [r.content for r in rows]
        used = self.provider.judge(query, texts)
        chosen = [texts[i - 1] for i in used] or texts
        text = self.provider.write(query, chosen)
        signal = self.provider.verify(text, "\n".join(chosen))
        if signal != "PASS" and len(rows) < 2 * k:
            rows = self.search(query, 2 * k).orderBy("position").limit(2 * k).collect()
            chosen = [r.content for r in rows]
            used, text = list(range(1, len(rows) + 1)), self.provider.write(query, chosen)
            signal = self.provider.verify(text, "\n".join(chosen))
        return {"answer": text, "signal": signal, "sections": [rows[i - 1].section_id for i in used]}

    def inspect(self, title: str | None = None) -> DataFrame:
        s = self.table("sections")
        return s if title is None else s.filter(F.col("title").ilike(f"%{title}%"))

    def sql(self, text: str, **tables: DataFrame) -> DataFrame | dict:
        """A guarded query over views; what the guard or Spark rejects comes back as data."""
        if not rules.is_select(self.spark, text):
            return {"status": "rejected", "message": "only queries are run"}
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        try:
            return self.spark.sql(text)
        except Exception as e:
            return {"status": "error", "message": str(e).split("\n")[0]}

    def run_job(self, job_id: str, steps: list[tuple[str, Callable]], cancelled: Callable[[str], bool] = lambda job: False) -> dict[str, DataFrame]:
        """Run a job's steps in order, each result stored; a repeat goes on behind the last completed one."""
        return flow.run_job(self.spark, f"{self.folder}/_jobs", job_id, steps, cancelled)

    @staticmethod
    def status(log: DataFrame) -> DataFrame:
        return ledger.latest_steps(log)
