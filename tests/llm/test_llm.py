"""The numbered problems: against brute force, round trips and held-out data; nulls, empties, repeats, ties, clashing columns."""

import glob
import itertools
import os
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("docloom.llm")
from docloom.llm import mixing, neardup, packing, queries, scanrepair, sentences, subjects, unify, vectors  # noqa: E402
from docloom.llm.tokens import encoding  # noqa: E402

WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for p in glob.glob(f"{folder}/*.parquet"):
        spark.read.parquet(p).limit(0).write.parquet(f"{d}/{os.path.basename(p)}")
    return d


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() <= 22


# --- p1


def mutate(rng, words):
    w = list(words)
    for _ in range(rng.randint(1, 3)):
        i = rng.randrange(len(w))
        rng.choice([lambda: w.pop(i), lambda: w.insert(i, rng.choice(WORDS)), lambda: w.__setitem__(i, rng.choice(WORDS))])()
    if rng.random() < 0.3:
        k = rng.randrange(len(w))
        w = w[k:] + w[:k]
    return w


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    rows, n = [], 0
    for _ in range(60):
        base = [rng.choice(WORDS) for _ in range(rng.randint(25, 60))]
        rows.append(("a", n, " ".join(base)))
        n += 1
        for _ in range(rng.randint(0, 3)):
            rows.append(("a", n, " ".join(mutate(rng, base)).upper() if rng.random() < 0.2 else ", ".join(mutate(rng, base))))
            n += 1
    rows += [("a", n, None), ("a", n + 1, ""), ("a", n + 2, "... !"), ("a", None, "w1 w2"), ("b", 0, rows[0][2]), ("b", 1, rows[0][2]), ("b", 1, rows[0][2]), ("a", n + 3, "x " * 20000), ("a", n + 4, "x " * 20000)]
    df = spark.createDataFrame(rows, "tbl string, id bigint, text string").withColumn("chk1", F.lit(1)).withColumn("rep", F.lit(2))
    got = {(r.tbl, r.id_a, r.id_b) for r in neardup.near_pairs(df).collect()}
    want = set()
    for (ta, ia, xa), (tb, ib, xb) in itertools.combinations(sorted({r for r in rows if r[1] is not None and r[2]}), 2):
        if ta == tb and ia != ib:
            a, b = Counter(re.findall(r"[^\W_]+", xa.lower())), Counter(re.findall(r"[^\W_]+", xb.lower()))
            if a and b and (a & b).total() >= 0.7 * (a | b).total():
                want.add((ta, min(ia, ib), max(ia, ib)))
    assert ("b", 0, 1) in got and ("a", n + 3, n + 4) in got
    assert got <= want and len(got) >= 0.98 * len(want)


def test_near_pairs_at_the_threshold(spark):
    rows, n = [], 400
    for i in range(n):
        both, own = ((28, 6), (24, 5), (35, 7), (29, 5))[i % 4]  # similarities 0.700, 0.706, 0.714, 0.744
        word = lambda k: f"t{i}x{k}"  # noqa: B023, E731
        common = [word(k) for k in range(both)]
        rows.append((2 * i, " ".join(common + [word(f"a{k}") for k in range(own)])))
        rows.append((2 * i + 1, " ".join(common + [word(f"b{k}") for k in range(own)])))
    df = spark.createDataFrame(rows, "id bigint, text string").withColumn("tbl", F.lit("a"))
    got = {(r.id_a, r.id_b) for r in neardup.near_pairs(df).collect()}
    assert got <= {(2 * i, 2 * i + 1) for i in range(n)} and len(got) >= 0.97 * n


def test_an_id_with_several_texts(spark):
    base = [f"v{i}" for i in range(40)]
    one, other = " ".join(base), " ".join(f"u{i}" for i in range(30))
    rows = [(1, one), (1, other), (2, one + " x"), (3, other), (4, other + " y")]
    df = spark.createDataFrame(rows, "id bigint, text string").withColumn("tbl", F.lit("t"))
    assert {(r.id_a, r.id_b) for r in neardup.near_pairs(df).collect()} == {(1, 2), (1, 3), (1, 4), (3, 4)}


def test_groups(spark):
    base = " ".join(WORDS[:40])
    rows = [(1, base), (2, base + " x"), (3, base + " x y"), (4, base), (9, "lonely words here")]
    got = {(r.id, r.class_id, r.group_id, r.links) for r in neardup.near_groups(spark.createDataFrame(rows, "id bigint, text string").withColumn("tbl", F.lit("t"))).collect()}
    assert got == {(1, 1, 1, 2), (4, 1, 1, 2), (2, 2, 1, 2), (3, 3, 1, 2)}


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([("t", i, i + 1) for i in range(30)] + [("t", 100, 101)], "tbl string, id_a bigint, id_b bigint")
    got = {r.id: r.group_id for r in neardup.components(e).collect()}
    assert set(got.values()) == {0, 100} and all(got[i] == 0 for i in range(31))


def test_sketch_estimates_similarity():
    words = [f"u{i}" for i in range(1000)]
    e, o = neardup.elements([" ".join(words[:800]), " ".join(words[200:])])
    s = neardup.sketches(e, o, 2, 512)
    assert (s != np.iinfo(np.uint64).max).all() and abs((s[0] == s[1]).mean() - 0.6) < 0.08


# --- p2


def test_edges_and_numbers():
    assert scanrepair.read_edge("- 7 -") == ("", 7) and scanrepair.read_edge("5 / 10") == ("", 5) and scanrepair.read_edge("[12]") == ("", 12)
    assert scanrepair.read_edge("11 / 17 | Bond outlook") == ("Bond outlook", 11) and scanrepair.read_edge("Bond outlook    12쪽") == ("Bond outlook", 12)
    assert scanrepair.read_edge("Page 8 | 1. Squad results")[1] == 8 and scanrepair.read_edge("2. Bond outlook") == ("2. Bond outlook", None) and scanrepair.read_edge("xiv")[1] == 14
    assert scanrepair.fix_number("97S3") == "9753" and scanrepair.fix_number("20o3") == "2003" and scanrepair.fix_number("files") is None and scanrepair.fix_number("2003") is None


def test_broken_words(spark):
    known = spark.createDataFrame([("low-cost", 9), ("vaccine", 9), ("예산", 50), ("예", 1)], "word string, clean bigint")
    cases = [("vac-", "cine"), ("low-", "cost."), ("예", "산"), ("-", "a"), ("word.", "next"), ("unk-", "nown")]
    ends = [(i, 0, None, "hyphen" if e[0] else "bare", e[1], e[2]) for i, (a, b) in enumerate(cases) if (e := scanrepair.line_end(a, b))]
    df = spark.createDataFrame(ends, "block_id bigint, line_no int, next_block bigint, kind string, head string, tail string")
    got = {(r.block_id, r.kind, r.word) for r in scanrepair.broken_words(df, known).collect()}
    assert got == {(0, "broken_word", "vaccine"), (1, "broken_word", "low-cost"), (2, "broken_word", "예산"), (5, "lookup", "unknown")}


def test_two_confusions_and_learnt_ones(spark):
    known = spark.createDataFrame([("ausführlich", 500), ("transportation", 400), ("documentation", 300), ("presentations", 300), ("containerized", 300), ("international", 300), ("configuration", 300)], "word string, clean bigint")
    # x for t is no confusion that the table starts with; seven long words tell it
    wrong = ["xransportation", "documenxation", "presenxations", "conxainerized", "inxernational", "configuraxion", "transporxation", "presentaxions"]
    rare = spark.createDataFrame([(w,) for w in [*wrong, "ausfiihrlich", "documcntaxion", "y" * 70_000]], "word string")
    counts = rare.select("word", F.lit(0).cast("bigint").alias("clean"), F.lit(1).cast("bigint").alias("noisy"))
    got = {r.word: r.right for r in scanrepair.corrections(rare, counts, known).collect()}
    assert got == {**{w: w.replace("x", "t") for w in wrong}, "ausfiihrlich": "ausführlich", "documcntaxion": "documentation"}


def test_any_two_confusions_come_together(spark):
    right = [f"{a * 3}z{b * 3}{c * 3}q{d * 3}" for a, b, c, d in ("abcd", "efgh", "hgba", "jkah", "mpda", "tdke")]
    letters = [chr(i) for i in (*range(0x10D0, 0x10F0), *range(0x0561, 0x0587))]
    # seventy confusions of six words each, and one of five
    wrong = {w.replace("z", x): w for w in right for x in letters} | {w.replace("q", "ж"): w for w in right[:5]}
    twice = {w.replace("z", letters[0]).replace("q", "ж"): w for w in right}
    known = spark.createDataFrame([(w, 500) for w in right], "word string, clean bigint")
    rare = spark.createDataFrame([(w,) for w in [*wrong, *twice]], "word string")
    counts = rare.select("word", F.lit(0).cast("bigint").alias("clean"), F.lit(1).cast("bigint").alias("noisy"))
    assert len(letters) == 70 and {r.word: r.right for r in scanrepair.corrections(rare, counts, known).collect()} == wrong | twice


def test_common_misreadings_are_not_known(spark):
    rows = [("report", 9000, 1000), ("rep0rt", 6, 300), ("grid", 40, 4), ("rare", 3, 0), ("other", 90000, 9000)]
    known, common = scanrepair.known_words(spark.createDataFrame(rows, "word string, clean bigint, noisy bigint"))
    assert {r.word for r in known.collect()} == {"report", "grid", "other"} and common == {"report", "grid", "other"}


def test_corrections(spark):
    known = spark.createDataFrame([("under", 500), ("기준으로", 400), ("records", 300)], "word string, clean bigint")
    rare = spark.createDataFrame([("iinder",), ("urider",), ("가준으로",), ("rec0rds",), ("Qirx",), (None,)], "word string").filter("word is not null")
    counts = rare.select("word", F.lit(0).cast("bigint").alias("clean"), F.lit(1).cast("bigint").alias("noisy"))
    got = {r.word: r.right for r in scanrepair.corrections(rare, counts, known).collect()}
    assert got == {"iinder": "under", "urider": "under", "가준으로": "기준으로", "rec0rds": "records"}


def test_scanned_pages_ignore_others(spark):
    body = "\n".join(["a line of text"] * 12)
    rows = [("s", i, i, 1, "text", body) for i in range(4)] + [("s", 3, 3, 1, "text", body), ("p", 9, 0, 1, "text", "one line"), ("n", 10, 0, 1, "text", None), ("i", 11, 0, 1, "image", body)]
    df = spark.createDataFrame(rows, "document_id string, id bigint, page int, section_id bigint, block_type string, content string")
    assert sorted(r.id for r in scanrepair.scanned_pages(df).collect()) == [0, 1, 2, 3]


def test_scanned_pages_with_null_pages(spark):
    body = "\n".join(["a line of text"] * 12)
    rows = [("s", i, i if i > 1 else None, 1, "text", body) for i in range(6)] + [("p", 10 + i, 1, 1, "text", body) for i in range(4)]
    df = spark.createDataFrame(rows, "document_id string, id bigint, page int, section_id bigint, block_type string, content string")
    assert sorted(r.id for r in scanrepair.scanned_pages(df).collect()) == list(range(6))


def test_returning_header_between_other_lines(spark):
    header = "Ministry of Public Health"
    tops = ["Ministry aaaaaaaaaaaaaaaaaaaaaaa of lic Health", "Ministry zzzzzzzzzzzzzzzzzzzzzzz of lic Health", header, header, header]
    rows = [("d", i, i + 1, 1, "\n".join([top, *(f"body {chr(97 + i) * 9} {chr(97 + k) * 9} text" for k in range(8))])) for i, top in enumerate(tops)]
    pages = spark.createDataFrame(rows, "document_id string, id bigint, page int, section_id bigint, content string")
    none = spark.createDataFrame([], "document_id string, title string")
    got = {(r.id, r.line_no) for r in scanrepair.furniture(pages, none, none).filter("header").collect()}
    assert {(2, 0), (3, 0), (4, 0)} <= got and not {(0, 0), (1, 0)} & got


# --- p3


def test_subjects_on_held_out(spark):
    rng = random.Random(1)
    areas = {"law": ["court", "appeal", "tenant", "clause"], "sport": ["league", "goal", "coach", "medal"], "energy": ["grid", "turbine", "boiler", "meter"]}
    docs, blocks, labels, truth = [], [], [], {}
    for d in range(150):
        mine = rng.sample(sorted(areas), rng.choice([1, 1, 2]))
        truth[f"d{d}"] = set(mine)
        docs.append((f"d{d}", rng.choice(mine) if rng.random() < 0.7 else rng.choice(sorted(areas)), None))
        text = " ".join(f"The {rng.choice(areas[mine[i % len(mine)]])} and the {rng.choice(areas[mine[i % len(mine)]])} were noted." for i in range(20))
        blocks.append((d, f"d{d}", "text", text))
        if d < 40:
            labels += [(f"d{d}", m, "r") for m in mine]
    docs += [("none", None, None), ("hint", " LAW ", None), docs[0]]
    df = spark.createDataFrame(docs, "document_id string, domain_category string, created_at timestamp")
    b = spark.createDataFrame(blocks + [(999, "d1", "text", None), (998, "d1", "image", "court")] + blocks[:3], "id bigint, document_id string, block_type string, content string")
    lab = spark.createDataFrame(labels + [("d1", "unknown", "r")], "document_id string, area_code string, labelled_by string")
    ar = spark.createDataFrame([(a, a.title(), None, None) for a in areas], "area_code string, name_en string, name_ko string, scope_note string")
    got: dict = {}
    for r in subjects.subject_areas(df, b, lab, ar).collect():
        got.setdefault(r.document_id, set()).add(r.area_code)
    assert set(got) == set(truth) | {"none", "hint"} and got["hint"] == {"law"} and len(got["none"]) == 1
    assert sum(got[d] == truth[d] for d in truth if int(d[1:]) >= 40) >= 100


def test_long_sentences_and_other_scripts(spark):
    long = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(70_000))
    docs = spark.createDataFrame([("a", None, None), ("b", None, None), ("c", "law", None)], "document_id string, domain_category string, created_at timestamp")
    blocks = spark.createDataFrame([(1, "a", "text", long), (2, "b", "text", "ศาลตัดสินคดี न्यायालय суд " * 30), (3, "c", "text", "ศาลตัดสินคดี न्यायालय суд " * 30)], "id bigint, document_id string, block_type string, content string")
    labels = spark.createDataFrame([("c", "law", "r")], "document_id string, area_code string, labelled_by string")
    areas = spark.createDataFrame([("law", "Law", None, None), ("sport", "Sport", None, None)], "area_code string, name_en string, name_ko string, scope_note string")
    got = {(r.document_id, r.area_code) for r in subjects.subject_areas(docs, blocks, labels, areas).collect()}
    assert {d for d, _ in got} == {"a", "b", "c"} and ("b", "law") in got
    assert "न्यायालय" in subjects.words_of("न्यायालय।") and "ศา" in subjects.words_of("ศาล")
    with pytest.raises(ValueError):
        many = spark.createDataFrame([(f"x{i}", None, None, None) for i in range(70)], "area_code string, name_en string, name_ko string, scope_note string")
        subjects.subject_areas(docs, blocks, labels, many)


# --- p4


def test_similar_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 64)).astype(np.float32)
    rows = [("f", f"k{i:03d}", v.tolist()) for i, v in enumerate(m)] + [("f", "zero", [0.0] * 64), ("f", "null", None), ("f", "short", [1.0]), ("f", None, m[0].tolist()), ("f", "k001", m[1].tolist()), ("g", "only", m[0].tolist())]
    got = {(r.field_name, r.key_a, r.key_b) for r in vectors.similar_pairs(spark.createDataFrame(rows, "field string, key string, v array<float>")).collect()}
    u = m / np.linalg.norm(m, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {("f", *sorted((f"k{i:03d}", f"k{j:03d}"))) for i in range(300) for j in np.argsort(-s[i])[:5]}
    assert got == want


def test_copies_of_vectors(spark):
    a, b, c = [1.0] + [0.0] * 63, [0.9, 0.1] + [0.0] * 62, [0.0, 1.0] + [0.0] * 62
    rows = [("f", f"a{i}", a) for i in range(9)] + [("f", "b0", b), ("f", "b1", b), ("f", "c", c)]
    got = {(r.key_a, r.key_b) for r in vectors.similar_pairs(spark.createDataFrame(rows, "field string, key string, v array<double>")).collect()}
    assert ("a0", "a8") in got and ("a5", "a8") not in got  # a8's five are the first copies
    assert ("b0", "b1") in got and {("a0", "b0"), ("a3", "b0")} <= got and ("a4", "b0") not in got
    assert {k for p in got for k in p if "c" in p} == {"c", "b0", "b1", "a0", "a1", "a2"}


def test_forest_recall(spark):
    rng = np.random.default_rng(5)
    m = (rng.normal(size=(40, 64))[rng.integers(0, 40, 6000)] + 0.6 * rng.normal(size=(6000, 64))).astype(np.float32)
    u = (m / np.linalg.norm(m, axis=1)[:, None]).astype(np.float32)
    df = spark.createDataFrame([("f", i, bytearray(v.tobytes())) for i, v in enumerate(u)], "field string, id bigint, vec binary")
    got: dict = {}
    for r in vectors.nearest(df, leaf_rows=512, block_rows=300).collect():
        got.setdefault(r.id, set()).add(r.nb)
    s = u[:500] @ u.T
    s[np.arange(500), np.arange(500)] = -9
    want = np.argpartition(-s, 5, axis=1)[:, :5]
    assert np.mean([len(got[i] & set(w.tolist())) / 5 for i, w in enumerate(want)]) >= 0.9


# --- p5


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("plain Text 40 m²", []), ("Ｆｕｌｌ １", ["form"]), ("ﬁle", ["form"]), ("ｱｲ", ["form"]), ("éa", ["composed"]), ("가", ["composed"]), ("a​b", ["invisible"]), ("sche­dule", ["invisible"]),
        ("می‌شود", []), ("a b", ["space"]), ("　", ["space"]), ("bаck", ["lookalike"]), ("договор", []), ("Σ β Ω", []), ("kΩ", []), ("（全角）：", []), ("", []), ("क्‍ष", []),
    ],
)
def test_kinds(text, kinds):
    assert unify.kinds_of(text) == kinds


@pytest.mark.parametrize("c", ["\ufff0", "\U0001d173", "\U0001bca0", "\u00ad", "\u200b"])
def test_ignorable_characters_are_invisible(c):
    assert unify.kinds_of(f"a{c}b") == ["invisible"] and unify.canonical(f"a{c}b") == "ab"


def test_one_form(spark):
    assert unify.canonical("Ｔｒіο​ｆａｅ ẞ") == "triofae ss" and unify.canonical("е́") == unify.canonical("é")
    rows = [("t", 1, "A B"), ("t", 1, "A B"), ("t", 2, None), ("t", None, "Ａ"), ("t", 3, "Straße"), ("t", 4, "")]
    df = spark.createDataFrame(rows, "tbl string, id bigint, text string").withColumn("form", F.lit(0)).withColumn("kind", F.lit(0))
    assert {(r.record_id, r.kind) for r in unify.found_kinds(df).collect()} == {(1, "space")}
    assert {(r.record_id, r.form) for r in unify.one_form(df).collect()} == {(1, "a b"), (3, "strasse"), (4, ""), (None, "a")}


def test_plain_form_of_every_character(spark):
    texts = [t for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 for t in (f"A{chr(c)}가", f"{chr(c)}が" if c % 2 else f"é{chr(c)}")]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    easy = df.filter(~unify.changeable(F.col("text"))).select("text", unify.plain_form(F.col("text")).alias("form")).collect()
    assert len(easy) > 60000
    assert [(r.text, r.form) for r in easy if r.form != unify.canonical(r.text)] == []


def test_forms_of_clean_copies(spark):
    rows = [(i, t) for i, t in enumerate(["方法：30", "方\u200b法：30", "40 m²", "40\u200b m²", "（全…角）", "（全\u200b…角）"])]
    df = spark.createDataFrame(rows, "id bigint, text string").withColumn("tbl", F.lit("a"))
    forms = {r.record_id: r.form for r in unify.one_form(df).collect()}
    assert forms[0] == forms[1] == "方法:30" and forms[2] == forms[3] == "40 m2" and forms[4] == forms[5] == "(全...角)"


# --- p6, p7


def test_containers(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 120)))) for i in range(300)] + [(900, "long text " * 2000), (901, ""), (902, None), (None, "x")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("shard", F.lit(1))
    plans = spark.createDataFrame([("s", 128), ("l", 1024), ("bad", 0), (None, 5)], "plan_name string, capacity_tokens int")
    got = packing.containers(df, plans, shard_texts=100).toPandas()
    enc = encoding()
    for plan, cap in (("s", 128), ("l", 1024)):
        g = got[got.plan_name == plan]
        assert (g.groupby("container_id").n_tokens.sum() <= cap).all()
        for i, text in texts:
            if i is None or not text:
                assert i is None or not (g.doc_id == i).any()
                continue
            size, mine = len(enc.encode_ordinary(text)), g[g.doc_id == i].sort_values("part_no")
            assert mine.n_tokens.sum() == size and len(mine) == max(1, -(-size // cap)) and mine.start_token.tolist() == [k * cap for k in range(len(mine))]
        assert g.n_tokens.sum() / (g.container_id.nunique() * cap) > 0.9


def test_shards_hold_close_texts(spark):
    rng = random.Random(3)
    topics = [[f"{chr(97 + k)}{rng.randrange(10**6)}" for _ in range(60)] for k in range(8)]
    rows = [(i, " ".join(rng.choice(topics[i % 8]) for _ in range(40))) for i in range(1600)]
    plans = spark.createDataFrame([("l", 4096)], "plan_name string, capacity_tokens int")
    got = packing.containers(spark.createDataFrame(rows, "doc_id bigint, text string"), plans, shard_texts=200).toPandas()
    assert sorted(got.doc_id) == list(range(1600))
    same = got.assign(topic=got.doc_id % 8).groupby("container_id").topic.agg(lambda t: t.value_counts().iloc[0] / len(t))
    assert same.mean() > 0.8


def test_most_are_retrieved(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(WORDS[(i % 5) * 60 : (i % 5) * 60 + 60]) for _ in range(rng.randint(5, 90)))) for i in range(500)]
    plans = spark.createDataFrame([("s", 256), ("m", 1024), ("l", 4096)], "plan_name string, capacity_tokens int")
    got = packing.containers(spark.createDataFrame(rows, "doc_id bigint, text string"), plans, shard_texts=200).toPandas()
    placed = got[got.position > 0]
    assert ((placed.placed_as == "neighbour").groupby(placed.plan_name).mean() >= 0.8).all() and (placed[placed.placed_as == "neighbour"].score > 0).all()


def test_bm25_scores_match_formula():
    docs = [np.array([1, 1, 2]), np.array([2, 3]), np.array([4])]
    for dense in (1, 99):
        s = packing.bm25_scores(docs, dense)
        idf = np.log(1 + (3 - 2 + 0.5) / 2.5)
        want = idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / 2))
        assert abs(s[0, 1] - want) < 1e-5 and s[0, 2] == 0 and s[0, 0] == -1


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["big"] * 6 + ["mid"] * 3 + ["rare"]), " ".join(rng.choice(WORDS) for _ in range(20))) for i in range(600)]
    rows += [(700, "big", None), (701, None, "x"), (702, "other", "not listed"), (703, "rare", rows[0][2])]
    targets = spark.createDataFrame([("big", 50.0, 1), ("mid", 30.0, 2), ("rare", 15.0, 3), ("gone", 5.0, 4), (None, 1.0, 1)], "source string, target_pct double, max_repeats int")
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("tokens", F.lit(1))
    chosen, plan = mixing.mixed(df, targets)
    c = chosen.toPandas()
    caps = {"big": 1, "mid": 2, "rare": 3}
    assert set(c.source) == set(caps) and all(c[c.source == s].repeat_no.max() <= n for s, n in caps.items())
    share = c.groupby("source").n_tokens.sum() / c.n_tokens.sum()
    assert all(abs(share[s] - t / 95) < 0.01 for s, t in (("big", 50), ("mid", 30), ("rare", 15)))
    assert c.position.between(0, 1).all() and not c.duplicated(["doc_id", "repeat_no"]).any()
    tilt = {r.source: r.tilt for r in plan.collect()}
    late = c[c.position > 0.5].groupby("source").n_tokens.sum() / c.groupby("source").n_tokens.sum()
    assert tilt["rare"] > tilt["big"] and late["rare"] > late["big"]


def test_mix_keeps_shared_texts(spark):
    rows = [(1, "unlisted", "shared one"), (2, "a", "shared one"), (3, "b", "shared two"), (4, "a", "shared two"), (5, "off", "shared three"), (6, "a", "shared three")]
    rows += [(10 + i, "b", f"text number {i} of the larger source") for i in range(50)]
    texts = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 50.0, 2), ("b", 50.0, 2), ("off", 0.0, 2)], "source string, target_pct double, max_repeats int")
    got = {(r.doc_id, r.source) for r in mixing.sized(texts, targets).collect()}
    assert got == {(2, "a"), (4, "a"), (6, "a")} | {(10 + i, "b") for i in range(50)}


def test_reports_equal_their_rows(spark, folder):
    """Sums of the report queries against the rows of the queries that they report on."""
    boxes = packing.p6_containers(spark, folder).toPandas()
    for r in packing.p6_fill(spark, folder).collect():
        mine = boxes[boxes.plan_name == r.plan_name]
        assert (r.pieces, r.tokens, r.containers) == (len(mine), mine.n_tokens.sum(), mine.container_id.nunique()) and r.filled > 0.8 and r.retrieved > 0.8
    mix = mixing.p7_mix(spark, folder).toPandas()
    for r in mixing.p7_shares(spark, folder).collect():
        mine = mix[mix.source == r.source]
        assert (r.used_tokens, r.texts_used, r.most_repeats) == (mine.n_tokens.sum(), mine.doc_id.nunique(), mine.repeat_no.max() if len(mine) else 0)
        assert abs(r.reached_pct - 100 * mine.n_tokens.sum() / mix.n_tokens.sum()) < 1e-3
    report = mixing.p7_shares_of_all(spark, folder).collect()
    assert all(r.used_tokens <= r.source_tokens * r.max_repeats + 5000 for r in report) and sum(r.used_tokens for r in report) > mix.n_tokens.sum()
    found = Counter(r.area_code for r in subjects.p3_found(spark, folder).collect())
    assert {r.area_code: r.documents for r in subjects.p3_shares(spark, folder).collect() if r.documents} == dict(found)


# --- p8


@pytest.fixture(scope="module")
def classifier(spark, folder):
    return sentences.Classifier(sentences.learn(spark.read.parquet(f"{folder}/documents.parquet")))


@pytest.mark.parametrize(
    "text,units",
    [
        ("The grid was tested. It failed again!", ["The grid was tested.", "It failed again!"]),
        ("# Title\n- one item. two\n- next", ["# Title", "- one item. two", "- next"]),
        ("They met “It is ready. We start,” said Bo. The end.", ["They met “It is ready. We start,” said Bo.", "The end."]),
        ("配置已更新。下一步开始了！", ["配置已更新。", "下一步开始了！"]),
        ("Value 3.5 rose (cf. p. 4). The next", ["Value 3.5 rose (cf. p. 4).", "The next"]),
        (" \n \n", []),
        ("", []),
    ],
)
def test_units(classifier, text, units):
    assert [text[a:b] for a, b in classifier.units(text)] == units


def test_thai_is_linear(classifier):
    import time

    text = "ผลการทดสอบระบบส่งกำลังไฟฟ้า เสร็จสิ้นแล้ว เจ้าหน้าที่รายงานว่า " * 16_000
    start = time.time()
    assert classifier.units(text[:1_000_000]) and time.time() - start < 20


def test_long_tokens_and_many_headings(classifier):
    text = "x" * 300_000 + ". " + "a.b" * 50_000 + "\n\n" + "\n\n".join(f"Section {i}" for i in range(5000))
    units = classifier.units(text)
    assert len(units) >= 5000 and units[-1][1] == len(text)


def test_languages_of_labels(spark):
    rows = [("nl", "de het een van en wordt niet met op voor zijn " * 40), ("NL-x", "het een van wordt niet " * 40), ("en", "the of and was with for this that were not by " * 60), ("xxxx", "the of"), (None, "the of"), ("ko", "사업 the 회의 자료를 검토했다 " * 50)]
    languages = sentences.learn_languages(spark.createDataFrame(rows, "lang string, text string"))
    assert set(languages.names) == {"en", "nl"} and languages.of("wordt het niet") == "nl" and languages.of("was this not that") == "en" and languages.of("회의 자료를") == "ko"


def test_words_signs_and_quotations_are_found_quickly_and_rightly(classifier):
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        assert sentences.latin_words(f"Ab{c}d") == sentences.LATIN_WORD.findall(f"Ab{c}d".lower())
    rng = random.Random(8)
    for _ in range(500):
        text = "".join(rng.choice(["a", "B", "ß", "Ÿ", "Ő", "\xd7", " ", "\u3000", "\n", ".", "!", "?", "…", "。", "।", "“", "”", '"', "(", "（", "）", ")", "[", "]", "‘", "’", "「", "」"]) for _ in range(40))
        assert sentences.latin_words(text) == sentences.LATIN_WORD.findall(text.lower())
        assert classifier._spans(text, "en") == [m.span() for m in sentences.SPAN.finditer(text)]
        assert [m.span() for x in sentences.SIGNS.finditer(text) for m in sentences.SIGN.finditer(text, *x.span())] == [m.span() for m in sentences.SIGN.finditer(text)]
    long = "The grid’s figures were reported again, and so was the “new” line for the city of Ärvik. " * 5000

    def best(f):
        took = []
        for _ in range(5):
            at = time.process_time()
            f()
            took.append(time.process_time() - at)
        return min(took)

    assert best(lambda: sentences.latin_words(long)) < 0.9 * best(lambda: sentences.LATIN_WORD.findall(long.lower()))
    assert best(lambda: [*sentences.SIGNS.finditer(long)]) < best(lambda: [*sentences.SIGN.finditer(long)]) / 1.5


def test_long_numbers_are_linear():
    start = time.process_time()
    assert sentences.core("1" * 60_000 + "x") == "1" * 60_000 + "x" and sentences.core("(1/2-3.5)") == "##" and sentences.core("-/-") == "-/-"
    assert time.process_time() - start < 1


def test_units_hold_all_characters(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = spark.createDataFrame([(10**9, "a. " * 30000), (10**9 + 1, None), (10**9 + 2, "  ")], "doc_id bigint, text string")
    rows = docs.select("doc_id", "text").unionByName(more)
    text = {r.doc_id: r.text for r in rows.collect()}
    seen: dict = {}
    for r in sentences.sentence_units(rows.withColumn("start_pos", F.lit(1))).collect():
        seen.setdefault(r.doc_id, []).append((r.start_pos, r.end_pos))
    for i, t in text.items():
        spans, at, rest = sorted(seen.get(i, [])), 0, ""
        for a, b in spans:
            assert a >= at and t[a:b] == t[a:b].strip()
            rest += t[at:a]
            at = b
        assert not (rest + (t or "")[at:]).strip()


def test_paragraphs_over_ranges(spark, monkeypatch):
    from docloom.operators import sections as ops

    monkeypatch.setattr(ops, "HOT_ROWS", 5)
    texts = ["The records were kept.", "the figures of the year", "were reported. All was well.", "And again"]
    rows = [("s", i, i if i < 22 else None, 1, "text", "\n".join([texts[i % 4], *(f"line {k} of the page {i} goes" for k in range(8)), "on." if i % 3 else "and"])) for i in range(24)]
    b = spark.createDataFrame(rows, "document_id string, id bigint, page int, section_id bigint, block_type string, content string")
    none = spark.createDataFrame([], "document_id string, title string")
    split = scanrepair.paragraphs(b, none, none).orderBy("para_no").collect()
    monkeypatch.setattr(ops, "HOT_ROWS", 1000)
    assert split == scanrepair.paragraphs(b, none, none).orderBy("para_no").collect() and len(split) > 5


def test_paragraphs(spark):
    clean = [("c", 100 + i, i % 3, 9, "text", "The vaccine figures were reported again. The records of the vaccine were kept under review.") for i in range(30)]
    top = "Vaccine scope for Zed"
    one = f"{top}\n  The vaccine figures were re-\nported again. The rec0rds of the vac-\ncine were kept iinder\nreview. The records of the\nvaccine were kept under review.\nThe figures were reported\nagain. The vaccine\n- 4 -"
    two = f"{top}\nfigures were kept.\n\n  The records were kept.\nThe vaccine figures were\nreported again.\nThe records of\nthe vaccine\nwere kept.\n- 5 -"
    rows = clean + [("s", 1, 0, 1, "text", one), ("s", 2, 1, 1, "text", two), ("s", 2, 1, 1, "text", two)]
    b = spark.createDataFrame(rows, "document_id string, id bigint, page int, section_id bigint, block_type string, content string")
    sections_ = spark.createDataFrame([("s", "Other title"), ("s", None)], "document_id string, title string")
    titles = spark.createDataFrame([("s", top), ("c", "x")], "document_id string, title string")
    found = {(r.block_id, r.line_no, r.kind, r.word) for r in scanrepair.damaged_lines(b, sections_, titles).collect()}
    assert {(1, 0, "running_header", ""), (2, 0, "running_header", ""), (1, 8, "page_number", ""), (2, 9, "page_number", ""), (1, 1, "broken_word", "reported"), (1, 2, "broken_word", "vaccine"), (1, 2, "misread", "records"), (1, 3, "misread", "under")} == found
    got = [r.text for r in scanrepair.paragraphs(b, sections_, titles).orderBy("para_no").collect()]
    assert got[0].startswith("The vaccine figures were reported again. The records of the vaccine were kept under review.") and got[0].endswith("again. The vaccine figures were kept.") and len(got) == 2


def test_subject_sentences_are_found_quickly_and_rightly():
    slow = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n\s*\n")
    texts = ["", "a b. c", "x!? yy\nzz", "Aa.\n\nBb", "一二。三四！五六？ 七八。\n\n九十", "ll mm. nn\n \nqq rr\n.\nss", "...   \n\n\n  kk", "a.b c.\x85dd"]
    for text in texts:
        assert [subjects.words_of(x) for x in subjects.SENTENCE.split(text) if subjects.words_of(x)] == [subjects.words_of(x) for x in slow.split(text) if subjects.words_of(x)]
    long = "some words of a text without many signs " * 5000

    def best(pattern):
        took = []
        for _ in range(5):
            at = time.process_time()
            pattern.split(long)
            took.append(time.process_time() - at)
        return min(took)

    assert best(subjects.SENTENCE) < best(slow) / 2
