"""Small literal cases that pin behaviour, and all queries over empty tables."""

import glob
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docloom.functions import text as t
from docloom.operators import catalog, ledger, retrieval, rules, sections, sheets, stats
from docloom.providers import Provider, json_part


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


def test_token_estimate(spark):
    assert one(spark, t.token_estimate(F.lit("가나다라abcd"))) == 3
    assert one(spark, t.token_estimate(F.lit(""))) == 0
    assert one(spark, t.token_estimate(F.lit(None).cast("string"))) is None


def test_rrf(spark):
    ranks = [("a", 1, 3), ("b", 3, 1), ("c", 2, 2), ("d", 1, 10)]
    v = spark.createDataFrame([(i, a) for i, a, _ in ranks], "id string, rank bigint")
    w = spark.createDataFrame([(i, b) for i, _, b in ranks], "id string, rank bigint")
    got = {r.id: round(r.score, 4) for r in retrieval.rrf(v, w).collect()}
    assert got == {"a": 0.0323, "b": 0.0323, "c": 0.0323, "d": 0.0307}


def test_pre_and_post_filter(spark):
    rows = [(i, "y" if i == 3 else "n", [1.0, float(i)]) for i in range(5)]
    n = spark.createDataFrame(rows, "id int, kind string, v array<float>")
    keep = F.col("kind") == "y"
    assert retrieval.knn(n, [1.0, 0.0], 3, keep).count() == 1
    assert retrieval.knn_then_filter(n, [1.0, 0.0], 3, keep).count() == 0


def test_zero_and_null_vectors_are_no_hits(spark):
    n = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [2.0, 0.0])], "id int, v array<float>")
    assert [r.id for r in retrieval.knn(n, [1.0, 0.0], 3).collect()] == [3]


def test_islands(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 0.6), (1, 2, 0.4), (1, 3, 0.5)], "d int, p int, sim double")
    got = sections.islands(df, ["d"], ["p"], F.col("sim").isNull() | (F.col("sim") < 0.5)).orderBy("p").collect()
    assert [r.island for r in got] == [1, 1, 2, 2]


def test_heading_sections(spark):
    df = spark.createDataFrame([(1, "before\n# A\n\n## B\nbody"), (2, None), (3, "")], "d int, text string")
    got = {(r.d, r.title, r.content) for r in sections.heading_sections(df, "d").collect()}
    assert got == {(1, sections.PREAMBLE, "before"), (1, "B", "body")}


@pytest.mark.parametrize("sizes,packs", [([1500, 600, 2500, 100], [0, 1, 2, 3]), ([5000], [0]), ([1000, 1000, 48, 1], [0, 0, 0, 1]), ([], [])])
def test_packs(spark, sizes, packs):
    c = F.array(*[F.lit(s).cast("bigint") for s in sizes]) if sizes else F.array().cast("array<bigint>")
    assert one(spark, sections.greedy_packs(2048, c)) == packs


def test_bibliography(spark):
    lines = ["1. Intro", "5. References", "2405.21060. URL x", "9. Adams", "Appendix", "2. More"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "d int, pos int, line string")
    got = [r.demoted for r in sections.bibliography_mode(df, "d").orderBy("pos").collect()]
    assert got == [False, False, True, True, False, False]


def test_tree_parents(spark):
    df = spark.createDataFrame([("d", i, lv) for i, lv in enumerate([1, 2, 3, 2, 1, 3])], "d string, ord int, level int")
    assert [r.parent_pos for r in sections.tree_parents(df, "d").orderBy("ord").collect()] == [None, 0, 1, 0, None, 4]


def test_tables(spark):
    df = spark.createDataFrame([(1, "d", 1, 0, "table", '[{"a": "1", "b": "", "c": "x"}]'), (2, "d", 1, 1, "table", "[]"), (3, "d", 1, 2, "table", None)], "id bigint, document_id string, section_id bigint, seq int, block_type string, table_json string")
    tb = sheets.parsed_tables(df)
    assert [r.block_id for r in tb.collect()] == [1]
    assert sheets.table_rows(tb).select(sheets.row_text(F.lit("S"), F.col("row")).alias("t")).first().t == "S: a=1, c=x"
    grid = spark.createDataFrame([(1, r, c, v) for r, row in enumerate([["Q1", "Q1", ""], ["a", "a", ""]]) for c, v in enumerate(row)], "block_id int, row int, col int, value string")
    assert [r.header for r in sheets.flat_headers(grid).orderBy("col").collect()] == ["Q1.a", "Q1.a_1", "col2"]
    runs = spark.createDataFrame([(1, r, 0, "" if r == 3 else "x") for r in range(1, 7)], "block_id int, row int, col int, value string")
    assert sorted((r.first_row, r.last_row) for r in sheets.regions(runs).collect()) == [(1, 2), (4, 6)]


def test_auto_merge(spark):
    n = spark.createDataFrame([("A1", "A"), ("A2", "A"), ("A3", "A"), ("B1", "B")], "id string, section_id string")
    hits = spark.createDataFrame([("A1", "A", 1), ("B1", "B", 2), ("A2", "A", 3)], "id string, section_id string, rank bigint")
    got = retrieval.auto_merge(hits, n).orderBy("position", "id").collect()
    assert [r.id for r in got] == ["A1", "A2", "A3", "B1"]


def test_small_to_big(spark):
    hits = spark.createDataFrame([("s1", 0.5, 1, "x"), ("s2", 0.9, 2, "y"), ("s1", 0.7, 3, "z"), (None, 0.9, 4, "n")], "section_id string, score double, rank bigint, text string")
    texts = spark.createDataFrame([("s1", "full")], "section_id string, text string")
    pages = spark.createDataFrame([("s1", 2, 3)], "section_id string, first_page int, last_page int")
    got = [(r.section_id, r.score, r.content) for r in retrieval.small_to_big(hits, texts, pages).orderBy("position").collect()]
    assert got == [("s1", 0.7, "full"), ("s2", 0.9, "y")]


@pytest.mark.parametrize("a,z,want", [(5, 5, "f, p.5"), (5, 14, "f, pp.5-14"), (None, None, "f")])
def test_citation(spark, a, z, want):
    assert one(spark, t.citation(F.lit("f"), F.lit(a).cast("int"), F.lit(z).cast("int"))) == want


def test_rules(spark):
    assert one(spark, rules.unsafe(F.lit("select replace(a,'x','y') from t")))
    assert not one(spark, rules.unsafe(F.lit("select inserted from t")))
    assert one(spark, rules.overridden_type(F.lit("web"), F.lit("the Annual Report"))) == "document"
    assert rules.is_select(spark, "select 1") and not rules.is_select(spark, "drop table x") and not rules.is_select(spark, "selec 1")


def test_script_filter(spark):
    assert one(spark, t.has_ideograph(F.lit("가 漢 나"))) and not one(spark, t.has_ideograph(F.lit("가나다")))


def test_resume_and_reset(spark):
    rows = [("j", s, st) for s, st in zip(ledger.STEPS, ["completed", "completed", "failed"])] + [("k", s, "completed") for s in ledger.STEPS]
    latest = spark.createDataFrame(rows, "job_id string, step_name string, status string")
    assert sorted((r.job_id, r.step_no) for r in ledger.to_run(latest).collect()) == [("j", 2), ("j", 3), ("j", 4)]
    assert ledger.reset(latest, "parse").count() == 2


def test_merged_documents(spark):
    rows = [("d", "a.pdf", ".pdf", None, "x", None, None, "2024-01-02"), ("d", "b.pdf", ".PDF", "m", "y", None, None, "2024-03-02"), ("d", "c.pdf", ".p", "q", "z", None, None, None)]
    df = spark.createDataFrame(rows, "document_id string, source_path string, original_ext string, doc_type string, domain_category string, minio_bucket string, minio_key string, created_at string")
    df = df.withColumn("created_at", F.to_timestamp_ntz("created_at"))
    r = catalog.merged_documents(df).first()
    assert (r.source_path, r.doc_type, r.domain_category) == ("c.pdf", "m", "y")


def test_p_value():
    assert abs(stats.p_value(2.0, 10) - 0.07338803) < 1e-6
    assert abs(stats.p_value(0.5, 30) - 0.6207) < 1e-3


def test_provider():
    p = Provider()
    assert p.embed([]) == [] and p.embed([""])[0] == [0.0] * 64
    assert abs(sum(v * v for v in p.embed(["a b c"])[0]) - 1) < 1e-9
    assert json_part('x {"a": 1} y', {}) == {"a": 1} and json_part("none", {"d": 0}) == {"d": 0}
    assert p.verify("", "x") == "PASS" and p.judge("alpha beta", ["alpha", "gamma"]) == [1]


def test_engine(spark, tmp_path):
    from docloom.engine import Engine

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_text("# Grid\nThe battery plant stores power. It feeds the northern grid at night.\n\n# Law\nThe court heard the appeal of the tenant.")
    (src / "b.csv").write_text("k,v\n1,x\n")
    e = Engine(spark, str(tmp_path / "out"))
    e.ingest(str(src))
    e.ingest(str(src))
    assert e.table("documents").count() == 2 and e.table("sections").count() == 2
    top = e.search("battery grid", 2).orderBy("position").first()
    assert "battery" in top.content
    assert e.answer("battery grid power")["signal"] == "PASS"
    assert e.sql("drop table x")["status"] == "rejected"
    assert e.sql("select count(*) as n from d", d=e.table("documents")).first().n == 2
    e.delete([e.table("documents").filter("extension = '.md'").first().document_id])
    assert e.table("documents").count() == 1 and e.table("sections").count() == 0


def test_stream_upsert(spark, tmp_path):
    from docloom.streaming import ingest

    src = tmp_path / "in"
    src.mkdir()
    for n, body in (("a.txt", "x"), ("b.txt", "x"), ("c.txt", "y")):
        (src / n).write_text(body)
    for _ in range(2):
        ingest.ingest_folder(spark, str(src), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_hourly_events_equal_batch(spark, folder, tmp_path):
    from docloom.streaming import ingest

    events = spark.read.parquet(f"{folder}/events.parquet")
    path = str(tmp_path / "events.parquet")
    events.unionByName(events.filter("event_id % 3 = 0")).coalesce(1).write.parquet(path)
    (part,) = tmp_path.glob("events.parquet/*.parquet")
    got = {(str(r.hour), r.event_type): (r.n, round(r.value, 4)) for r in ingest.hourly_events(spark, str(part)).collect()}
    want = {}
    for e in {e.event_id: e for e in events.collect()}.values():
        key = (str(e.ts.replace(minute=0, second=0, microsecond=0)), e.event_type)
        n, value = want.get(key, (0, 0.0))
        want[key] = (n + 1, value + e.value)
    assert got == {k: (n, round(v, 4)) for k, (n, v) in want.items()}


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for p in glob.glob(f"{folder}/*.parquet"):
        spark.read.parquet(p).limit(0).write.parquet(f"{d}/{os.path.basename(p)}")
    return d


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not (n[0] == "p" and n[1].isdigit())))
def test_empty_tables(spark, empty, name):
    assert entry.queries()[name](spark, empty).count() <= 4  # aggregates give a row


def test_flow(spark):
    from docloom.operators import flow

    assert flow.planned("how many orders").task_type == "quantitative"

    class Web(Provider):
        def plan(self, query):
            return {"task_type": "web"}

    assert flow.planned("the annual report", Web()).task_type == "document"
    plan = flow.planned("a question")
    one_row = spark.range(1)

    def broken(p, needs):
        raise ValueError("down")

    done = flow.execute(plan, {"domain_search": lambda p, n: one_row, "document_search": broken, "node_search": lambda p, n: one_row})
    assert list(done) == ["s1"] and [s.status for s in plan.steps] == ["done", "failed", "pending"]
    calls = []
    got = flow.answered("alpha beta", lambda q: calls.append(q) or ["nothing"], rewrite=lambda q, i: q + "!")
    assert len(calls) == flow.MAX_SEARCHES + 1 and not got["complete"] and got["events"][-1]["type"] == "error"
    assert flow.answered("alpha beta", lambda q: ["alpha beta gamma"])["complete"]


def test_ledger_stream(spark, folder, tmp_path):
    from docloom.streaming import ledger as stream_ledger

    log = spark.read.parquet(f"{folder}/parser_job_steps.parquet")
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    s = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    q = stream_ledger.latest_status(s).writeStream.format("memory").queryName("ledger_now").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((r.job_id, r.step_name, r.status) for r in df.collect())
    assert key(spark.table("ledger_now")) == key(ledger.latest_steps(log))


def test_files(spark, tmp_path):
    import zipfile

    from docloom.sources import files

    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>v</t></is></c></row><row r="2"><c r="A2"><v>7</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>k</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    (tmp_path / "n.txt").write_bytes(b"\xff\xfe plain")
    (tmp_path / "e.md").write_text("")
    (tmp_path / "z.exe").write_text("no")
    got = {r.source_path.rsplit("/", 1)[-1]: r for r in files.blocks(files.files(spark, str(tmp_path))).collect()}
    assert set(got) == {"x.xlsx", "n.txt"}  # Spark reads no file without bytes
    assert got["x.xlsx"].content == "| k | v |\n| --- | --- |\n| 7 |  |" and got["x.xlsx"].sheet_name == "sheet1"
