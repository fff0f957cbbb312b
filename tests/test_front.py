"""The front, its guard and runner, hot documents, spreadsheets and searches, by literal cases."""

import math
import zipfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from docloom import schemas
from docloom.engine import Engine
from docloom.operators import catalog, flow, retrieval, rules, sections, sheets
from docloom.providers import Provider
from docloom.sources import files, paths

QUERIES = [
    "select 1", "select a, count(*) from t where b > 3 group by a having count(*) > 1 order by a limit 3", "with x as (select * from t) select * from x", "select * from t where a in (select b from u) union all select * from v",
    "select * from (values (1, 2)) as t(a, b)", "select explode(x) from t", "select *, row_number() over (partition by a order by b) from t", "select * from t left join u using (k), lateral (select t.a + 1)", "from t select a", "values (1)", "table t",
]
COMMANDS = [
    "execute immediate 'drop table t'", "begin drop table t; end", "begin select 1; end", "alter table t add columns (a int)", "alter table t rename to u", "load data inpath '/x' into table t", "call p()", "cache table t", "uncache table t",
    "analyze table t compute statistics", "msck repair table t", "drop table t", "insert into t select 1", "create table t as select 1", "create or replace temp view v as select 1", "set a=b", "set var x = 1", "declare variable x int", "reset", "use d",
    "show tables", "describe t", "explain select 1", "truncate table t", "merge into t using u on t.a = u.a when matched then delete", "delete from t", "update t set a = 1", "refresh table t", "add jar 'x'", "insert overwrite directory '/x' select 1",
    "from t insert into u select *", "select transform(a) using 'cat' as (b) from t", "select reflect('java.lang.System', 'exit', 0)", "select java_method('java.util.UUID', 'randomUUID')", "nonsense", "",
]


@pytest.mark.parametrize("sql", QUERIES)
def test_guard_lets_queries_through(spark, sql):
    assert rules.is_select(spark, sql)


@pytest.mark.parametrize("sql", COMMANDS)
def test_guard_refuses_commands(spark, sql):
    assert not rules.is_select(spark, sql)


@pytest.fixture
def engine(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_text("# Grid\nThe battery plant stores power. It feeds the northern grid at night.\n\n# Law\nThe court heard the appeal of the tenant.")
    (src / "b.csv").write_text("k,v\n1,x\n")
    (src / "copy.md").write_bytes((src / "a.md").read_bytes())
    e = Engine(spark, str(tmp_path / "out"))
    e.src = src
    return e


def test_ingest_repeats_add_nothing(engine):
    for _ in range(2):
        engine.ingest(str(engine.src))
        assert [engine.table(n).count() for n in ("documents", "sections", "blocks")] == [2, 2, 2]


def test_a_failed_ingest_leaves_nothing(engine, monkeypatch):
    assert engine.table("documents").count() == 0
    real = engine.provider
    engine.provider = None  # fails behind the first tables
    with pytest.raises(Exception):
        monkeypatch.setattr("docloom.engine.embedded", lambda *a: 1 / 0)
        engine.ingest(str(engine.src))
    assert engine.table("documents").count() == 0 and engine.table("blocks").count() == 0
    monkeypatch.undo()
    engine.provider = real
    engine.ingest(str(engine.src))
    assert [engine.table(n).count() for n in ("documents", "sections", "blocks")] == [2, 2, 2]


def test_deleted_documents_may_come_back(engine):
    engine.ingest(str(engine.src))
    engine.delete([engine.table("documents").filter("extension = '.md'").first().document_id])
    assert engine.table("documents").count() == 1 and engine.table("sections").count() == 0
    engine.ingest(str(engine.src))
    assert engine.table("documents").count() == 2 and engine.table("sections").count() == 2


def test_steps_of_a_plan(engine):
    engine.ingest(str(engine.src))
    plan = flow.planned("battery grid power")
    done = flow.execute(plan, engine.handlers())
    assert [s.status for s in plan.steps] == ["done"] * 3 and done["s3"].count() >= 1
    counted = flow.execute(flow.planned("how many tenants"), engine.handlers(sql=lambda q: engine.sql("select 1 as n")))
    assert counted["s2"].first().n == 1
    again = flow.rewritten(plan, "tenant appeal")
    assert again.query == "tenant appeal" and {s.status for s in again.steps} == {"pending"}


def test_search_reads_texts_of_hits_only(engine):
    engine.ingest(str(engine.src))
    found = engine.search("battery grid", 2)
    assert "battery" in found.orderBy("position").first().content
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_run_job(spark, tmp_path):
    ran = []

    def step(name, fails=False):
        def run(done):
            ran.append((name, sorted(done)))
            if fails:
                raise ValueError("down")
            return spark.range(len(done) + 1)

        return name, run

    folder = str(tmp_path / "jobs")
    with pytest.raises(ValueError):
        flow.run_job(spark, folder, "j", [step("a"), step("b", True), step("c")])
    with pytest.raises(flow.JobCancelled):
        flow.run_job(spark, folder, "j", [step("a"), step("b")], lambda job: True)
    done = flow.run_job(spark, folder, "j", [step("a"), step("b"), step("c")])
    assert ran == [("a", []), ("b", ["a"]), ("b", ["a"]), ("c", ["a", "b"])] and [done[n].count() for n in "abc"] == [1, 2, 3]
    log = [(r.step_name, r.status, r.error) for r in spark.read.parquet(f"{folder}/ledger").orderBy("at").collect()]
    assert log[:4] == [("a", "running", ""), ("a", "completed", ""), ("b", "running", ""), ("b", "failed", "b: down")]


def test_schemas(spark, tmp_path):
    assert "toc_nodes" in schemas.prepare(spark, str(tmp_path)) and schemas.prepare(spark, str(tmp_path)) == []
    old = spark.createDataFrame([(1, "x", "y")], "id int, title string, more string")
    assert schemas.conformed(old, "id bigint, title string, level int").collect() == [Row(id=1, title="x", level=None)]


@pytest.mark.parametrize("rows", [3, 7, 1000])
def test_running_sums_over_ranges(spark, monkeypatch, rows):
    monkeypatch.setattr(sections, "HOT_ROWS", rows)
    data = [("hot", i * i if i % 5 else None, i) for i in range(60)] + [("cold", 1, 100), (None, 1, 200), (None, 2, 201)]
    df = spark.createDataFrame(data, "doc string, a bigint, id bigint")
    got = {r.id: r.n for r in sections.running_sum(df, "doc", ["a", "id"], F.lit(1), "n").collect()}
    order = sorted(range(60), key=lambda i: (i % 5 != 0, i * i if i % 5 else 0, i))
    assert got == {**{i: n + 1 for n, i in enumerate(order)}, 100: 1, 200: 1, 201: 2}


def test_contents_table(spark):
    text = "# Report\n\n## 목 차\n| □ | Overview ···· |\n| --- | --- |\n| 1. | Scope ···· 3 |\n| 2 | Risks… 4 |\n| x | skipped |\n| □ | ab |\n# Body\n| □ | not an entry |"
    df = spark.createDataFrame([(1, text), (2, "no contents"), (3, None), (4, "# 목차\n| 1. | no major |")], "id int, text string")
    got = [(r.id, r.depth, r.major, r.title) for r in sections.contents_entries(df, "id").orderBy("pos").collect()]
    assert got == [(1, 1, "Overview", "Overview"), (1, 2, "Overview", "1. Scope"), (1, 2, "Overview", "2. Risks")]


def test_packs_close_behind_paragraphs(spark):
    sizes, ok = F.array(*[F.lit(n).cast("bigint") for n in (5, 8, 4, 20, 1)]), F.array(*[F.lit(x) for x in (False, True, True, True, True)])
    assert spark.range(1).select(sections.greedy_packs(10, sizes, ok).alias("p")).first().p == [0, 0, 1, 2, 3]


def test_searches_count_repeated_rows_once(spark):
    rows = [(f"n{i:02d}", [1.0, i / 10], f"word{i} common") for i in range(20)]
    df = spark.createDataFrame(rows * 3 + [rows[0]] * 50 + [("zero", [0.0, 0.0], ""), ("null", None, None)], "id string, v array<double>, text string")
    top = retrieval.knn(df, [1.0, 0.0], 3).orderBy("rank").collect()
    assert [(r.id, r["rank"]) for r in top] == [("n00", 1), ("n01", 2), ("n02", 3)]
    asked = spark.createDataFrame([(7, [2.0, 0.0]), (8, [0.0, 0.0])], "qid bigint, v array<double>")
    batch = retrieval.knn_batch(df, asked, 3).orderBy("rank").collect()
    assert [(r.qid, r.id, r.score) for r in batch] == [(7, r.id, r.score) for r in top]
    index = retrieval.postings(df.select("id", "text"))
    assert {(r.term, r.id, r.dl, r.tf) for r in index.filter("id = 'n00'").collect()} == {("word0", "n00", 2, 1), ("common", "n00", 2, 1)}
    single = {r.id: r.score for r in retrieval.bm25(df.select("id", "text"), ["common", "word3"]).collect()}
    sizes = spark.createDataFrame([(21, 40 / 21)], "total bigint, mean double")
    many = retrieval.bm25_batch(index, sizes, spark.createDataFrame([(1, "common"), (1, "word3")], "qid bigint, term string"), 50)
    assert {r.id: r.score for r in many.collect()} == single and len(single) == 20


def shuffled(spark, run) -> int:
    """Rows that the stages of ``run`` write to shuffles."""
    store, before = spark.sparkContext._jsc.sc().statusStore(), 0
    for sign in (-1, 1):
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        before += sign * sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))
        if sign < 0:
            run()
    return before


@pytest.mark.parametrize("rows", [3, 16384])
def test_many_questions_shuffle_no_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(retrieval, "ROWS", rows, raising=False)
    monkeypatch.setattr(retrieval, "QUESTIONS", 250)  # two blocks
    texts = spark.range(400).select(F.concat(F.lit("n"), "id").alias("id"), F.concat(F.lit("common words and "), "id").alias("text"))
    asked = spark.range(400).select(F.col("id").alias("qid"), F.explode(F.array(F.lit("common"), F.lit("words"), F.col("id").cast("string"))).alias("term"))
    sizes = spark.createDataFrame([(400, 4.0)], "total bigint, mean double")
    for search in (lambda: retrieval.bm25_batch(retrieval.postings(texts), sizes, asked, 2), lambda: retrieval.bm25_batch_texts(texts, asked, 2)):
        got = []
        # 400 x 400 pairs have a word in common
        assert shuffled(spark, lambda: got.extend(search().collect())) < 40_000
        assert {(r.qid, r["rank"]): r.id for r in got} == {(q, k): f"n{q}" if k == 1 else "n0" if q else "n1" for q in range(400) for k in (1, 2)}


def test_many_vectors_send_only_the_best(spark):
    # two tasks a core at most, of 40 parts; repeated rows, an id with two vectors, ties
    v = lambda a: F.array(F.cos(a), F.sin(a))
    df = spark.range(0, 400, 1, 40).select(F.format_string("n%03d", "id").alias("id"), v(F.col("id") % 200 / 200.0).alias("v"))
    df = df.unionByName(df.filter("id = 'n007'")).unionByName(spark.createDataFrame([("n005", [1.0, 0.0])] * 30, "id string, v array<double>"))
    asked = spark.range(200).select(F.col("id").alias("qid"), v(F.col("id") / 200.0).alias("v"))
    got = []
    sent = shuffled(spark, lambda: got.extend(retrieval.knn_batch(df, asked, 3).collect()))
    # a row a question, task and rank, once
    assert sent <= 2 * spark.sparkContext.defaultParallelism * 200 * 3 + 1000
    rows = {(r.qid, r["rank"]): r.id for r in got}
    assert len(rows) == 600 and all(rows[(q, 1)] == f"n{q:03d}" and rows[(q, 2)] == f"n{q + 200:03d}" for q in range(6, 200))
    assert [rows[(0, k)] for k in (1, 2, 3)] == ["n000", "n005", "n200"]


def test_batches_count_all_texts_of_an_id(spark):
    rows = [("a", "red blue"), ("a", "red green"), ("a", "red"), ("a", "red blue"), ("b", "blue Blue"), ("c", ""), (None, "red"), ("d", None)]
    df = spark.createDataFrame(rows, "id string, text string")
    got = retrieval.bm25_batch_texts(df, spark.createDataFrame([(1, "red"), (1, "blue"), (1, "blue"), (2, "none")], "qid bigint, term string"), 5).collect()
    # five texts of seven words; (id, length, term, times): a 2 red 2, a 1 red 1, a 2 blue 1, b 2 blue 2
    part = lambda dl, tf, n: math.log(1 + (5 - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 1.4))
    assert [(r.qid, r.id, r.score, r["rank"]) for r in got] == [(1, "a", round(part(2, 2, 2) + part(1, 1, 2) + part(2, 1, 2), 6), 1), (1, "b", round(part(2, 2, 2), 6), 2)]


def test_fallbacks(spark):
    df = spark.createDataFrame([(i, [1.0], "x") for i in range(5)], "id bigint, v array<double>, text string")
    assert [r.id for r in retrieval.with_fallback(lambda: 1 / 0, df, 2, F.col("id") > 1).orderBy("rank").collect()] == [2, 3]
    asked = []
    retrieval.widened(lambda k: asked.append(k) or df.limit(k), 2, lambda hits: False)
    assert asked == [2, 4]


def test_spreadsheet_regions(spark, tmp_path):
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    cell = lambda r, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>' if not v.isdigit() else f'<c r="{r}"><v>{v}</v></c>'
    rows = [["A1:Year", "B1:Power", "D1:Note"], ["B2:low", "C2:high", "D2:text"], ["A3:2020", "B3:5", "C3:7"], ["A6:k", "B6:k"], ["A7:1", "B7:2"]]
    body = "".join(f'<row>{"".join(cell(*x.split(":")) for x in r)}</row>' for r in rows)
    sheet = f'<worksheet xmlns="{ns}"><sheetData>{body}</sheetData><mergeCells><mergeCell ref="A1:A2"/><mergeCell ref="B1:C1"/></mergeCells></worksheet>'
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    got = [(r.first_row, r.row_index, r.row) for r in files.sheet_rows(files.files(spark, str(tmp_path))).orderBy("first_row").collect()]
    assert got == [(0, 0, {"Year.Year": "2020", "Power.low": "5", "Power.high": "7", "Note.text": ""}), (5, 0, {"k": "1", "k_1": "2"})]
    assert files.decoded("가나".encode("cp949")) == "가나" and files.decoded(b"\xef\xbb\xbfx") == "x"


def test_cells_by_sheet_and_header(spark):
    rows = [(1, "North", [{"Ratio": "5", "x": "1"}, {"Ratio": "6"}]), (2, "South", [{"ratio": "7"}]), (3, "North", [{"y": "8"}])]
    df = spark.createDataFrame(rows, "block_id bigint, sheet_name string, rows array<map<string,string>>")
    assert {(r.block_id, r.row_index, r.header, r.value) for r in sheets.cell_search(df, F.col("sheet_name") == "North", "rat").collect()} == {(1, 0, "Ratio", "5"), (1, 1, "Ratio", "6")}


def test_scratch_needs_a_shared_folder(spark):
    assert paths.scratch(spark, "x").startswith("file:") or spark.conf.get("spark.checkpoint.dir", None)


def test_files_that_need_conversion(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(b"PK...")
    (tmp_path / "b.md").write_text("plain")
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.prepared(files.files(spark, str(tmp_path)), convert=lambda p, c: (".md", b"turned")).collect()}
    assert bytes(got["a.docx"].content) == b"turned" and got["a.docx"].converted and got["a.docx"].extension == ".md" and not got["b.md"].converted
    assert got["b.md"].object_key.startswith("raw/") and got["b.md"].object_key.endswith(".md")
    assert [r.path.rsplit("/", 1)[-1] for r in files.prepared(files.files(spark, str(tmp_path))).collect()] == ["b.md"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a.md", "# one\ntwo"), ("b.md", "three")], "file_name string, body string")
    catalog.exported(df, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"), wholetext=True)
    assert {(r.file_name, r.value.strip()) for r in back.collect()} == {("a.md", "# one\ntwo"), ("b.md", "three")}
    old = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id int, v string")
    new = spark.createDataFrame([(2, "x", 0), (3, "y", 0), (None, "z", 0)], "id int, v string, more int")
    assert {(r.id, r.v) for r in catalog.upserted(old, new, "id").collect()} == {(1, "a"), (2, "x"), (3, "y"), (None, "z")}


def test_providers_try_again():
    class Wrong(Provider):
        def propose(self, title, text, most=10, hint=""):
            return (["This one is fine."], ["w"]) if hint else (["中文句子在这里。"], ["中"])

    p = Provider()
    assert Wrong().propose_valid("t", "x") == (["This one is fine."], ["w"]) and p.propose_valid("t", "") == ([], [])
    assert p.rewrite("where is the northern turbine") == "where the northern turbine" and p.rewrite("x") == "x"
    assert [q["domain"] for q in p.split_query("court appeal and grid power", {"law": "court appeal", "energy": "grid power"})] == ["law", "energy"]
