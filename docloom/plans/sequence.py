"""Order-dependent operators: adjacent rows, runs, headings, trees, packs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import text as t
from docloom.functions import vector
from docloom.operators import catalog
from docloom.operators import sections as s
from docloom.registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
query = R.query

# Fixed values of the SQL side, written out so that a slip on either side shows.
_HEADING = r"(?i)^(\d+\.(?:\d+\.)*\s+\S|\d+\)\s+\S|[IVXLC]+\.\s+\S|제\s*\d+\s*[장절항편]|Chapter\s+\d|(?:Abstract|초록|요약|서론|결론|서문|부록|Appendix)$|(?:Acknowledgments?|감사의\s*글?)$|(?:References?|참고\s*문헌|Bibliography)$|(?:Introduction|Conclusions?|Methods?|Results?|Discussion|Background)$|(?:Related\s+Work|Experiments?|Evaluation|Future\s+Work)$)"
_BIBLIOGRAPHY = r"(?i)(?:References?|참고\s*문헌|Bibliography)"
_RESET = r"(?i)^(?:Abstract|초록|요약|서론|결론|서문|부록|Appendix|Acknowledgments?|감사의\s*글?|Introduction|Conclusions?|Methods?|Results?|Discussion|Background|Related\s+Work|Experiments?|Evaluation|Future\s+Work|제\s*\d+\s*[장절항편]|Chapter\s+\d)$"

_C = "c as (select distinct chunk_id, document_id, parent_section_id, content, proposition_embedding::double[] as v from chunk_index where proposition_embedding is not null and list_sum(list_transform(proposition_embedding, lambda x: abs(x))) > 0)"


def chunks(x):
    c = x.chunk_index.select("chunk_id", "document_id", "parent_section_id", "content", F.col("proposition_embedding").alias("v")).distinct()
    return c.filter(F.col("v").isNotNull() & F.exists("v", lambda a: a != 0))


_ADJ = f"{_C}, a as (select *, round(list_cosine_similarity(lag(v) over (partition by document_id order by chunk_id), v), 4) as sim from c)"


def adjacent(x):
    w = Window.partitionBy("document_id").orderBy("chunk_id")
    return chunks(x).withColumn("sim", F.round(vector.cosine(F.lag("v").over(w), F.col("v")), 4))


@query(f"with {_ADJ} select chunk_id, sim from a where sim is not null")
def adjacent_similarity(x):
    return adjacent(x).filter("sim is not null").select("chunk_id", "sim")


@query(
    f"""with {_ADJ}, g as (select *, sum(case when sim is null or sim < 0.5 then 1 else 0 end) over (partition by document_id order by chunk_id) as island from a)
    select document_id, cast(island as bigint) as island, count(*) as chunks, md5(string_agg(coalesce(content, ''), chr(10) order by chunk_id)) as digest from g group by 1, 2"""
)
def merge_islands(x):
    """Neighbours of at least 0.5 join one group."""
    a = s.islands(adjacent(x), ["document_id"], ["chunk_id"], F.col("sim").isNull() | (F.col("sim") < 0.5)).withColumn("content", F.coalesce("content", F.lit("")))
    n = a.groupBy("document_id", "island").agg(F.count(F.lit(1)).alias("chunks"))
    return s.by_group(a, ["document_id", "island"], ["chunk_id"], "content").join(n, ["document_id", "island"]).select("document_id", "island", "chunks", F.md5("content").alias("digest"))


_TITLE = "regexp_extract(line, '^#{1,6}\\s+(.+)', 1)"
_L = "l as (select doc_id, i - 1 as pos, ls[i] as line from (select doc_id, string_split(text, chr(10)) as ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents where text is not null))"


@query(f"with {_L} select doc_id, pos, last_value(nullif({_TITLE}, '') ignore nulls) over (partition by doc_id order by pos) as heading from l where trim(line) <> '' and doc_id in (select doc_id from l where {_TITLE} <> '')")
def heading_ffill(x):
    l = s.lines(x.documents, "doc_id")
    title = F.nullif(F.regexp_extract("line", r"^#{1,6}\s+(.+)", 1), F.lit(""))
    with_heads = l.filter(title.isNotNull()).select("doc_id").distinct()
    filled = F.last(title, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos"))
    return l.filter(F.trim("line") != "").join(with_heads, "doc_id", "left_semi").select("doc_id", F.col("pos").cast("bigint").alias("pos"), filled.alias("heading"))


@query(
    f"""with {_L}, n as (select *, {_TITLE} as title, sum(case when {_TITLE} <> '' then 1 else 0 end) over (partition by doc_id order by pos) as section_no from l),
    b as (select doc_id, section_no, regexp_replace(string_agg(line, chr(10) order by pos), '^\\s+|\\s+$', '', 'g') as content from n where title = '' group by 1, 2),
    h as (select doc_id, section_no, trim(title) as title from n where title <> '')
    select b.doc_id, cast(b.section_no as bigint) as section_no, coalesce(h.title, '서두') as title, md5(b.content) as digest from b left join h using (doc_id, section_no) where b.content <> ''"""
)
def heading_split(x):
    return s.heading_sections(x.documents, "doc_id").select("doc_id", F.col("section_no").cast("bigint").alias("section_no"), "title", F.md5("content").alias("digest"))


_TOC = "n as (select distinct node_id, document_id, parent_id, ord, level, title, page from toc_nodes)"


def toc(x):
    return x.toc_nodes.distinct()


@query(
    f"""with {_TOC}, m as (select *, last_value(case when level = 1 then title end ignore nulls) over (partition by document_id order by ord, node_id) as major from n)
    select node_id, case when level = 1 then 1 else 2 end as depth, major, regexp_replace(title, '[·…\\s]+$', '') as title from m where title is not null and length(title) > 2 and major is not null"""
)
def toc_parse(x):
    """Two depths of toc entries, each with the major entry above it; leader dots fall away."""
    major = F.last(F.when(F.col("level") == 1, F.col("title")), ignorenulls=True).over(Window.partitionBy("document_id").orderBy("ord", "node_id"))
    m = toc(x).withColumn("major", major).filter("title is not null and length(title) > 2 and major is not null")
    return m.select("node_id", F.when(F.col("level") == 1, 1).otherwise(2).alias("depth"), "major", F.regexp_replace("title", r"[·…\s]+$", "").alias("title"))


_KEY = "lower(translate(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}_]', '', 'g'), 'Σ', 'σ'))"


@query(
    f"""with b as (select distinct b.id, b.document_id, s.seq as s_seq, b.seq, b.content from parser_blocks b join parser_sections s on s.id = b.section_id where b.block_type = 'text' and b.content is not null),
    k as (select distinct document_id, {_KEY.format('title')} as k from toc_nodes where title is not null),
    m as (select b.*, case when k.k is not null then 1 else 0 end as hit from b left join k on k.document_id = b.document_id and k.k = {_KEY.format("substr(split_part(b.content, chr(10), 1), 1, 100)")} and k.k <> ''),
    g as (select *, sum(hit) over (partition by document_id order by s_seq, seq, id) as part from m)
    select document_id, cast(part as bigint) as part, count(*) as blocks, sum(hit)::bigint as titled from g group by 1, 2"""
)
def toc_match_split(x):
    """Blocks whose first line is a toc title start parts; what comes before is the document's head, part 0."""
    b = x.parser_blocks.filter("block_type = 'text' and content is not null").select("id", "document_id", "section_id", "seq", "content").distinct()
    sec = x.parser_sections.select(F.col("id").alias("section_id"), F.col("seq").alias("s_seq"))
    k = x.toc_nodes.filter("title is not null").select("document_id", t.normalize_title(F.col("title")).alias("k"), F.lit(1).alias("hit")).filter("k <> ''").distinct()
    first = t.normalize_title(F.substring(F.split_part("content", F.lit("\n"), F.lit(1)), 1, 100))
    m = b.join(sec, "section_id").withColumn("k", first).join(k, ["document_id", "k"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    g = s.islands(m, ["document_id"], ["s_seq", "seq", "id"], F.col("hit") == 1, split=True).withColumnRenamed("island", "part")
    return g.groupBy("document_id", "part").agg(F.count(F.lit(1)).alias("blocks"), F.sum("hit").cast("bigint").alias("titled"))


@query(
    f"""with {_L}, h as (select doc_id, pos, line, case when regexp_matches(trim(line), '{_HEADING}') then 1 else 0 end as h from l), ok as (select doc_id from h group by 1 having sum(h) >= 2),
    g as (select *, sum(h) over (partition by doc_id order by pos) as part from h where doc_id in (select doc_id from ok))
    select doc_id, cast(part as bigint) as part, coalesce(max(case when h = 1 then trim(line) end), '서두') as title, count(*) as lines from g group by 1, 2"""
)
def heading_detect_split(x):
    """Parts of texts with two heading lines or more; texts with fewer give none."""
    l = s.lines(x.documents, "doc_id").withColumn("h", F.trim("line").rlike(s.HEADING).cast("int"))
    ok = l.groupBy("doc_id").agg(F.sum("h").alias("n")).filter("n >= 2").select("doc_id")
    g = s.islands(l.join(ok, "doc_id", "left_semi"), ["doc_id"], ["pos"], F.col("h") == 1).withColumnRenamed("island", "part")
    return g.groupBy("doc_id", "part").agg(F.coalesce(F.max(F.when(F.col("h") == 1, F.trim("line"))), F.lit(s.PREAMBLE)).alias("title"), F.count(F.lit(1)).alias("lines"))


@query(
    f"""with {_L}, k as (select *, regexp_matches(trim(line), '{_HEADING}') as heading, case when regexp_matches(trim(line), '{_HEADING}') and regexp_matches(trim(line), '{_RESET}') and not regexp_matches(trim(line), '{_BIBLIOGRAPHY}') then 'reset'
      when regexp_matches(trim(line), '{_HEADING}') and regexp_matches(trim(line), '{_BIBLIOGRAPHY}') then 'biblio' end as kind from l),
    st as (select *, last_value(kind ignore nulls) over (partition by doc_id order by pos) as state from k)
    select doc_id, count(*) filter (heading) as headings, count(*) filter (heading and coalesce(state, '') = 'biblio' and coalesce(kind <> 'biblio', true)) as demoted from st group by 1"""
)
def biblio_demote(x):
    m = s.bibliography_mode(s.lines(x.documents, "doc_id"), "doc_id")
    return m.groupBy("doc_id").agg(F.count_if("heading").alias("headings"), F.count_if("demoted").alias("demoted"))


_DB = "db as (select document_id, id, row_number() over (partition by document_id order by id) - 1 as pos, count(*) over (partition by document_id) as m from (select distinct document_id, id from parser_blocks)), ns as (select document_id, count(*) as n from parser_sections group by 1)"


@query(f"with {_DB} select db.id, least(db.pos // greatest(1, db.m // ns.n), ns.n - 1) as section_no from db join ns using (document_id)")
def proportional_split(x):
    """Blocks dealt to the sections in equal runs; the last takes the rest."""
    b = s.running_sum(x.parser_blocks.select("document_id", "id").distinct(), "document_id", ["id"], F.lit(1), "at")
    n = x.parser_sections.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    m = x.parser_blocks.groupBy("document_id").agg(F.count_distinct("id").alias("m")).join(n, "document_id")
    size = F.greatest(F.lit(1), F.floor(F.col("m") / F.col("n")))
    return b.join(m, "document_id").select("id", F.least(F.floor((F.col("at") - 1) / size), F.col("n") - 1).cast("bigint").alias("section_no"))


@query(
    """with b as (select distinct id, document_id, page, block_type from parser_blocks where page is not null), m as (select document_id, max(page) + 1 as pages from b group by 1), ns as (select document_id, count(*) as n from parser_sections group by 1)
    select b.id, cast(least(floor(b.page / m.pages * ns.n), ns.n - 1) as bigint) as section_no from b join m using (document_id) join ns using (document_id) where b.block_type <> 'text'"""
)
def proportional_place(x):
    b = x.parser_blocks.filter("page is not null").select("id", "document_id", "page", "block_type").distinct()
    m = b.groupBy("document_id").agg((F.max("page") + 1).alias("pages"))
    n = x.parser_sections.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    at = F.floor(F.col("page") / F.col("pages") * F.col("n"))
    return b.filter("block_type <> 'text'").join(m, "document_id").join(n, "document_id").select("id", F.least(at, F.col("n") - 1).cast("bigint").alias("section_no"))


@query(
    f"""with {_TOC}, tn as (select document_id, title, row_number() over (partition by document_id order by ord, node_id) as i from n where title is not null),
    tb as (select document_id, id, row_number() over (partition by document_id order by id) as i from (select distinct document_id, id from parser_blocks where block_type = 'table'))
    select tb.id, coalesce(tn.title, 'Table ' || tb.i) as title from tb left join tn using (document_id, i)"""
)
def tabular_split(x):
    """The i-th table of a document takes the i-th toc title."""
    order = lambda *o: F.row_number().over(Window.partitionBy("document_id").orderBy(*o)).alias("i")
    titles = toc(x).filter("title is not null").select("document_id", "title", order("ord", "node_id"))
    tables = s.running_sum(x.parser_blocks.filter("block_type = 'table'").select("document_id", "id").distinct(), "document_id", ["id"], F.lit(1), "i")
    return tables.join(titles, ["document_id", "i"], "left").select("id", F.coalesce("title", F.concat(F.lit("Table "), F.col("i").cast("string"))).alias("title"))


@query(f"with {_TOC}, m as (select n.*, (select max(p.ord) from n p where p.document_id = n.document_id and p.ord < n.ord and p.level <= least(n.level, 3) - 1) as parent_pos from n) select node_id, cast(parent_pos as integer) as parent_pos from m")
def toc_tree_parent(x):
    return s.tree_parents(toc(x), "document_id").select("node_id", "parent_pos")


@query(
    f"""with {_TOC} select a.node_id, coalesce(c.title || ' > ', '') || coalesce(b.title || ' > ', '') || a.title as path from n a left join n b on a.parent_id = b.node_id left join n c on b.parent_id = c.node_id where a.title is not null"""
)
def toc_flatten_path(x):
    """Titles from the top; levels are three at most."""
    n = toc(x).select("node_id", "parent_id", "title")
    up = lambda p: n.select(F.col("node_id").alias(f"{p}_id"), F.col("parent_id").alias(f"{p}_parent"), F.col("title").alias(f"{p}_title"))
    j = n.join(up("b"), F.col("parent_id") == F.col("b_id"), "left").join(up("c"), F.col("b_parent") == F.col("c_id"), "left")
    part = lambda c: F.coalesce(F.concat(F.col(c), F.lit(" > ")), F.lit(""))
    return j.filter("title is not null").select("node_id", F.concat(part("c_title"), part("b_title"), "title").alias("path"))


@query(
    """with b as (select distinct document_id, id, content from parser_blocks where block_type = 'text' and content is not null), f as (select *, lower(trim(split_part(content, chr(10), 1))) as line from b),
    r as (select document_id, line from f where line <> '' group by 1, 2 having count(*) >= 5), k as (select f.*, case when r.line is null then 1 else 0 end as kept from f left join r using (document_id, line)),
    g as (select *, sum(kept) over (partition by document_id order by id) as part from k) select document_id, cast(part as bigint) as part, count(*) as blocks, min(id) as first_id from g where part > 0 group by 1, 2"""
)
def drop_repeated_headers(x):
    """Blocks under a repeated first line go to the kept block before them; those before any kept one are lost."""
    b = x.parser_blocks.filter("block_type = 'text' and content is not null").select("document_id", "id", "content").distinct()
    f = b.withColumn("line", F.lower(F.trim(F.split_part("content", F.lit("\n"), F.lit(1))))).drop("content")
    r = f.filter("line <> ''").groupBy("document_id", "line").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5").withColumn("again", F.lit(True)).drop("n")
    k = f.join(r, ["document_id", "line"], "left")
    g = s.islands(k, ["document_id"], ["id"], F.col("again").isNull(), split=True).withColumnRenamed("island", "part")
    return g.filter("part > 0").groupBy("document_id", "part").agg(F.count(F.lit(1)).alias("blocks"), F.min("id").alias("first_id"))


_DEPTH = "case when regexp_matches(trim(title), '^[□■◆]') then 1 when regexp_matches(trim(title), '^\\d+\\.\\s') then 2 else 3 end"


@query(
    f"""with d as (select document_id, id, seq, title, {_DEPTH} as depth from parser_sections where title is not null), g as (select *, sum(case when depth <= 2 then 1 else 0 end) over (partition by document_id order by seq, id) as chunk from d)
    select document_id, cast(chunk as bigint) as chunk, count(*) as sections, string_agg(title, ' | ' order by seq, id) as titles from g group by 1, 2"""
)
def chunk_by_depth(x):
    """Entries of depth 1 and 2 start chunks, deeper ones are appended."""
    d = x.parser_sections.filter("title is not null").select("document_id", "id", "seq", "title", t.classify_depth(F.col("title")).alias("depth"))
    g = s.islands(d, ["document_id"], ["seq", "id"], F.col("depth") <= 2).withColumnRenamed("island", "chunk")
    n = g.groupBy("document_id", "chunk").agg(F.count(F.lit(1)).alias("sections"))
    return s.by_group(g, ["document_id", "chunk"], ["seq", "id"], "title", " | ").withColumnRenamed("title", "titles").join(n, ["document_id", "chunk"])


@query(
    """with b as (select distinct id, document_id, page from parser_blocks), o as (select *, sum(case when page >= 5 then 1 else 0 end) over (partition by document_id order by id) as late from b) select document_id, count(*) as blocks from o where late = 0 group by 1"""
)
def preview_pages(x):
    """Blocks before the first one of page 5 or later."""
    b = x.parser_blocks.select("id", "document_id", "page")
    late = b.filter("page >= 5").groupBy("document_id").agg(F.min("id").alias("first"))
    kept = b.join(late, "document_id", "left").filter("first is null or id < first").select("document_id", "id").distinct()
    return kept.groupBy("document_id").agg(F.count(F.lit(1)).alias("blocks"))


@query(
    f"""with {_C}, w as (select chunk_id, v, lag(v) over o as a, lead(v) over o as b from c window o as (partition by document_id order by chunk_id)) select chunk_id, round(greatest(list_cosine_similarity(v, a), list_cosine_similarity(v, b)), 4) as best from w where a is not null and b is not null"""
)
def max_of_two_sims(x):
    w = Window.partitionBy("document_id").orderBy("chunk_id")
    c = chunks(x).withColumn("a", F.lag("v").over(w)).withColumn("b", F.lead("v").over(w)).filter("a is not null and b is not null")
    return c.select("chunk_id", F.round(F.greatest(vector.cosine(F.col("v"), F.col("a")), vector.cosine(F.col("v"), F.col("b"))), 4).alias("best"))


_SECS = f"""{_L}, hn as (select *, {_TITLE} as title, sum(case when {_TITLE} <> '' then 1 else 0 end) over (partition by doc_id order by pos) as section_no from l),
    hb as (select doc_id, section_no, regexp_replace(string_agg(line, chr(10) order by pos), '^\\s+|\\s+$', '', 'g') as content from hn where title = '' group by 1, 2),
    hh as (select doc_id, section_no, trim(title) as title from hn where title <> ''),
    se as (select hb.doc_id, hb.section_no, coalesce(hh.title, '서두') as title, hb.content from hb left join hh using (doc_id, section_no) where hb.content <> '')"""
_HG = "length(regexp_replace(content, '[^가-힣]', '', 'g'))"
_EST = f"cast(floor({_HG} / 2 + (length(content) - {_HG}) / 4) as bigint)"
_PARAS = "len(list_filter(list_transform(string_split_regex(content, '\\n\\s*\\n'), lambda s: trim(s)), lambda s: length(s) >= 10 and not starts_with(s, '|') and not starts_with(s, '<!--')))"
_PACK = """it as (select *, row_number() over (partition by doc_id order by section_no) as k from sn),
    st as (select doc_id, k, n as used, ok, 0 as pack from it where k = 1 union all
      select it.doc_id, it.k, case when st.ok and st.used + it.n > {limit} then it.n else st.used + it.n end, case when st.ok and st.used + it.n > {limit} then it.ok else st.ok or it.ok end,
        case when st.ok and st.used + it.n > {limit} then st.pack + 1 else st.pack end from st join it on it.doc_id = st.doc_id and it.k = st.k + 1),
    pk as (select it.*, cast(st.pack as bigint) as pack from it join st using (doc_id, k))"""


def _packs(sec, limit: int):
    """(doc_id, pack, section_no, title, n) of sections (doc_id, section_no, title, n, ok); a text's sections are one array of numbers and titles."""
    g = sec.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section_no", "n", "ok", "title"))).alias("i"))
    g = g.withColumn("p", s.greedy_packs(limit, F.transform("i", lambda e: e["n"]), F.transform("i", lambda e: e["ok"])))
    return g.select("doc_id", F.explode(F.arrays_zip("i", "p")).alias("z")).select("doc_id", F.col("z.p").alias("pack"), "z.i.section_no", "z.i.title", "z.i.n")


@query(
    f"""with recursive {_SECS}, sn as (select doc_id, section_no, title, {_EST} as n, {_PARAS} > 0 as ok from se), {_PACK.format(limit=2048)}
    select doc_id, pack, cast(sum(n) as bigint) as tokens, count(*) as sections, arg_min(title, section_no) as first_title, 'D' || doc_id || case when pack > 0 then ' > ' || substr(arg_min(title, section_no), 1, 25) else '' end as title from pk group by 1, 2"""
)
def pack_tokens(x):
    """Sections of a text in order, packed to 2048 estimated tokens; a larger one stays whole. Packs after the first name the text, their parent, and their first section."""
    sec = s.heading_sections(x.documents, "doc_id").withColumn("n", t.token_estimate(F.col("content"))).withColumn("ok", F.size(s.paragraphs(F.col("content"))) > 0)
    g = _packs(sec, 2048).groupBy("doc_id", "pack").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("sections"), F.min_by("title", "section_no").alias("first_title"))
    name = F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.when(F.col("pack") > 0, F.concat(F.lit(" > "), F.substring("first_title", 1, 25))).otherwise(""))
    return g.withColumn("title", name)


@query(f"with recursive {_SECS}, sn as (select doc_id, section_no, title, cast(length(content) as bigint) as n, true as ok from se), {_PACK.format(limit=2000)} select doc_id, pack, cast(sum(n) as bigint) as chars, count(*) as parts from pk group by 1, 2")
def pack_by_chars(x):
    """Parts between headings, packed to 2000 characters."""
    sec = s.heading_sections(x.documents, "doc_id").withColumn("n", F.char_length("content").cast("bigint")).withColumn("ok", F.lit(True))
    return _packs(sec, 2000).groupBy("doc_id", "pack").agg(F.sum("n").alias("chars"), F.count(F.lit(1)).alias("parts"))


_CORE = "substr(trim(regexp_replace(title, '^\\d+\\.\\s*', '')), 1, 15)"
_MATCH = f"""{_TOC}, dp as (select document_id, max(case when level > 1 then 2 else 1 end) as depth from n where title is not null and ord is not null group by 1),
    en as (select n.document_id, ord, {_CORE} as core, row_number() over (partition by n.document_id order by ord, {_CORE}) as i from n join dp on dp.document_id = n.document_id and (case when n.level > 1 then 2 else 1 end) = dp.depth where title is not null and ord is not null),
    hd as (select document_id, seq as pos, title, row_number() over (partition by document_id order by seq, title) as h from parser_sections where title is not null and not regexp_matches(title, '^목\\s*차$')),
    st as (select distinct document_id, cast(0 as bigint) as h, cast(1 as bigint) as i, cast(null as integer) as ord, cast(null as integer) as pos from hd union all
      select hd.document_id, hd.h, case when length(en.core) >= 3 and contains(hd.title, en.core) then st.i + 1 else st.i end, case when length(en.core) >= 3 and contains(hd.title, en.core) then en.ord end, case when length(en.core) >= 3 and contains(hd.title, en.core) then hd.pos end
      from st join hd on hd.document_id = st.document_id and hd.h = st.h + 1 left join en on en.document_id = st.document_id and en.i = st.i),
    mt as (select document_id, ord, pos from st where ord is not null)"""


def _matched(x):
    """Entries of depth 2, where a document has them, else of depth 1, found in its section titles in order; the contents heading is no section."""
    core = F.substring(F.trim(F.regexp_replace("title", r"^\d+\.\s*", "")), 1, 15)
    depth = F.when(F.col("level") > 1, 2).otherwise(1)
    e = toc(x).filter("title is not null and ord is not null").select("document_id", "ord", depth.alias("depth"), core.alias("core"))
    deepest = e.groupBy("document_id").agg(F.max("depth").alias("depth"))
    heads = x.parser_sections.filter("title is not null").filter(~F.col("title").rlike(r"^목\s*차$")).select("document_id", F.col("seq").alias("pos"), "title")
    return s.monotone_match(e.join(deepest, ["document_id", "depth"], "left_semi").select("document_id", "ord", "core"), heads)


@query(f"with recursive {_MATCH} select document_id, ord, pos from mt")
def toc_monotone_match(x):
    return _matched(x)


_STEXT = "sx as (select section_id, string_agg(trim(content), chr(10) || chr(10) order by seq, id) as content from (select distinct id, section_id, content, seq, block_type from parser_blocks) where block_type = 'text' and trim(content) <> '' and section_id is not null group by 1)"


@query(
    f"""with recursive {_MATCH}, {_STEXT}, sc as (select s.document_id, s.id, s.seq as pos, s.title, coalesce(sx.content, '') as content, m.pos is not null as hit from parser_sections s left join sx on sx.section_id = s.id left join mt m on m.document_id = s.document_id and m.pos = s.seq where s.title is null or not regexp_matches(s.title, '^목\\s*차$')),
    gr as (select *, sum(case when hit then 1 else 0 end) over (partition by document_id order by pos, id) as part from sc),
    tx as (select document_id, part, count(*) as sections, string_agg(content, chr(10) || chr(10) order by pos, id) as content, arg_min(coalesce(title, ''), (pos, id)) as first_title, cast(sum({_PARAS}) as bigint) as paragraphs from gr group by 1, 2)
    select document_id, cast(part as bigint) as part, sections, case when part = 0 then '서두' else first_title end as title, {_EST} as tokens, paragraphs, md5(content) as digest from tx"""
)
def toc_split(x):
    """Sections grouped under the toc entry matched last: their texts joined, paragraphs and estimated tokens; what comes before the first match is the preamble."""
    texts = catalog.section_texts(x.parser_blocks.select("id", "section_id", "block_type", "content", "seq").distinct()).select(F.col("section_id").alias("id"), F.col("text").alias("content"))
    sec = x.parser_sections.filter(F.col("title").isNull() | ~F.col("title").rlike(r"^목\s*차$")).select("document_id", "id", F.col("seq").alias("pos"), F.coalesce("title", F.lit("")).alias("title"))
    m = sec.join(_matched(x).select("document_id", "pos").withColumn("hit", F.lit(True)), ["document_id", "pos"], "left")
    g = s.islands(m, ["document_id"], ["pos", "id"], F.col("hit").isNotNull(), split=True).withColumnRenamed("island", "part")
    g = g.join(texts, "id", "left").withColumn("content", F.coalesce("content", F.lit("")))
    n = g.groupBy("document_id", "part").agg(F.count(F.lit(1)).alias("sections"), F.min_by("title", F.struct("pos", "id")).alias("first"), F.sum(F.size(s.paragraphs(F.col("content")))).alias("paragraphs"))
    joined = s.by_group(g, ["document_id", "part"], ["pos", "id"], "content", "\n\n").join(n, ["document_id", "part"])
    return joined.select("document_id", "part", "sections", F.when(F.col("part") == 0, s.PREAMBLE).otherwise(F.col("first")).alias("title"), t.token_estimate(F.col("content")).alias("tokens"), "paragraphs", F.md5("content").alias("digest"))


@query(
    f"""with {_TOC}, o as (select document_id, title, level, row_number() over (partition by document_id order by ord, node_id) as i from n where title is not null), w as (select *, i - 1 as pos, trim(case when level = 1 then '| □ | ' else '| ' || i || '. | ' end || title || ' ····· ' || i || ' |') as line from o where i <= 120),
    r as (select document_id, pos, level, trim(regexp_extract(line, '^\\|\\s*(.+?)\\s*\\|\\s*(.+?)\\s*\\|', 1)) as a, trim(regexp_extract(line, '^\\|\\s*(.+?)\\s*\\|\\s*(.+?)\\s*\\|', 2)) as b from w),
    p as (select *, case when level = 1 then trim(regexp_replace(b, '[·…\\s]+$', '')) end as top from r), q as (select *, last_value(top ignore nulls) over (partition by document_id order by pos) as major from p)
    select document_id, cast(pos as integer) as pos, case when level = 1 then 1 else 2 end as depth, major, coalesce(top, replace(a, '.', '') || '. ' || trim(regexp_replace(b, '[·…]+.*$', ''))) as title from q where major is not null"""
)
def toc_table_parse(x):
    """Contents tables written as Markdown, one a document, read back as entries of two depths."""
    w = Window.partitionBy("document_id").orderBy("ord", "node_id")
    o = toc(x).filter("title is not null").withColumn("i", F.row_number().over(w))
    mark = F.when(F.col("level") == 1, F.lit("| □ | ")).otherwise(F.concat(F.lit("| "), F.col("i").cast("string"), F.lit(". | ")))
    o = o.withColumn("line", F.concat(mark, "title", F.lit(" ····· "), F.col("i").cast("string"), F.lit(" |")))
    text = s.by_group(o, ["document_id"], ["i"], "line").withColumn("text", F.concat(F.lit("# Title\n\n## 목차\n"), "line", F.lit("\n# Next\n| □ | no entry |")))
    return s.contents_entries(text, "document_id")


@query(
    """with p as (select distinct document_id, replace(section_path, ' > ', ' → ') as structure from parser_sections where section_path is not null), w as (select document_id, string_split_regex(structure, '\\s*→\\s*') as parts from p)
    select distinct document_id, cast(i - 1 as integer) as ord, 1 as level, parts[i] as title from (select *, unnest(range(1, len(parts) + 1)) as i from w)"""
)
def toc_from_type(x):
    """Level-1 entries from a structure text that joins its parts by arrows; here section paths."""
    p = x.parser_sections.filter("section_path is not null").select("document_id", F.regexp_replace("section_path", " > ", " → ").alias("structure")).distinct()
    return p.select("document_id", F.posexplode(F.split("structure", r"\s*→\s*")).alias("ord", "title")).select("document_id", "ord", F.lit(1).alias("level"), "title").distinct()
