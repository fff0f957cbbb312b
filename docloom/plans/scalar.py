"""Scalar functions and rules over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as t
from docloom.functions import vector
from docloom.operators import rules
from docloom.registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
query = R.query

_HANGUL = "length(regexp_replace({0}, '[^가-힣]', '', 'g'))"
_ESTIMATE = "cast(floor({h} / 2 + (length({0}) - {h}) / 4) as bigint)"


def _estimate(col: str) -> str:
    return _ESTIMATE.format(col, h=_HANGUL.format(col))


@query(f"select doc_id, {_estimate('text')} as tokens from documents")
def token_estimate(x):
    return x.documents.select("doc_id", t.token_estimate(F.col("text")).alias("tokens"))


@query(
    f"""select doc_id, case when {_HANGUL.format('text')} > 0.1 * greatest(length(text), 1) then {_estimate('text')}
    else cast(floor(len(regexp_extract_all(text, '\\S+')) * 1.3 + 1e-9) as bigint) end as tokens from documents"""
)
def token_estimate_lang(x):
    return x.documents.select("doc_id", t.token_estimate_lang(F.col("text")).alias("tokens"))


@query("select id, lower(translate(regexp_replace(title, '[^\\p{L}\\p{N}_]', '', 'g'), 'Σ', 'σ')) as key from parser_sections")
def normalize_title(x):
    return x.parser_sections.select("id", t.normalize_title(F.col("title")).alias("key"))


_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) >= 10)"


@query(f"with s as (select doc_id, {_SENTENCES} as s from documents) select doc_id, len(s) as sentences, md5(array_to_string(s, '|')) as digest from s")
def sentence_split(x):
    s = x.documents.select("doc_id", t.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("bigint").alias("sentences"), F.md5(F.array_join("s", "|")).alias("digest"))


@query("select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 4) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def cosine_pairs(x):
    a = x.embeddings.select("vec_id", F.col("embedding").alias("a"))
    b = x.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.round(vector.cosine(F.col("a"), F.col("b")), 4).alias("cosine"))


@query(
    """with c as (select distinct chunk_id, document_id, section_depth, section_path, section_name, proposition from chunk_index), d as (select distinct document_id, title, domain_category from doc_index)
    select c.chunk_id, '[' || coalesce(d.domain_category, '') || ']\n[' || coalesce(d.title, '') || ']\n[section: ' || coalesce(case when c.section_depth > 1 then trim(split_part(c.section_path, '>', 1)) || ' > ' || c.section_name else c.section_name end, '') || ']\n' || c.proposition as passage
    from c left join d using (document_id)"""
)
def contextual_prefix(x):
    c = x.chunk_index.select("chunk_id", "document_id", "section_depth", "section_path", "section_name", "proposition").distinct()
    d = x.doc_index.select("document_id", "title", "domain_category").distinct()
    major = F.when(F.col("section_depth") > 1, F.trim(F.split_part("section_path", F.lit(">"), F.lit(1))))
    return c.join(d, "document_id", "left").select("chunk_id", t.contextual_prefix(F.col("domain_category"), F.col("title"), major, F.col("section_name"), F.col("proposition")).alias("passage"))


_GENERIC = "'문서 헤더', '헤더', '개요', '서론', '목차', '서문', '소개', '본문', 'introduction', 'header', 'overview', 'preface', 'contents', 'table of contents'"


@query(
    f"""with s as (select document_id, list_transform(list(section_path order by seq, id), lambda p: trim(split_part(p, '>', 1))) as tops from parser_sections group by 1),
    d as (select document_id, min(source_path) as source_path from parser_documents group by 1)
    select d.document_id, coalesce(list_filter(coalesce(s.tops, []), lambda p: p <> '' and lower(p) not in ({_GENERIC}))[1], regexp_replace(regexp_extract(d.source_path, '([^/]+)$', 1), '\\.[^./]+$', '')) as name from d left join s using (document_id)"""
)
def doc_name(x):
    paths = F.transform(F.array_sort(F.collect_list(F.struct("seq", "id", "section_path"))), lambda p: p["section_path"])
    s = x.parser_sections.groupBy("document_id").agg(paths.alias("paths"))
    d = x.parser_documents.groupBy("document_id").agg(F.min("source_path").alias("source_path"))
    return d.join(s, "document_id", "left").select("document_id", t.document_name(F.col("paths"), F.col("source_path")).alias("name"))


@query(
    """with c as (select distinct lower(trim(domain_category)) as given from parser_documents where domain_category is not null),
    a as (select area_code, lower(name_en) as name, row_number() over (order by area_code) as pos from subject_areas),
    m as (select given, area_code, pos, (contains(name, given) or contains(given, name)) as inside,
      len(list_intersect(regexp_extract_all(given, '[\\p{L}\\p{N}]+'), regexp_extract_all(name, '[\\p{L}\\p{N}]+'))) as shared from c cross join a)
    select given, arg_min(area_code, case when inside then pos else 1000 - shared * 100 + pos end) as area_code from m group by given"""
)
def closest_type(x):
    """The area that a category names, by containment either way in list order, else by shared words."""
    areas = x.subject_areas.select("area_code", F.lower("name_en").alias("name")).orderBy("area_code").limit(1001).collect()  # a fixed dimension
    if len(areas) > 1000:
        raise ValueError("more than 1000 areas")
    given = x.parser_documents.filter("domain_category is not null").select(F.lower(F.trim("domain_category")).alias("given")).distinct()
    if not areas:
        return given.select("given", F.lit(None).cast("string").alias("area_code"))
    words = t.analyze(F.col("given"))
    score = lambda i, a: F.when(F.lit(a.name).contains(F.col("given")) | F.col("given").contains(a.name), F.lit(i)).otherwise(1000 - 100 * F.size(F.array_intersect(words, t.analyze(F.lit(a.name)))) + i)
    best = F.array_min(F.array(*[F.struct(score(i + 1, a).alias("s"), F.lit(a.area_code).alias("area_code")) for i, a in enumerate(areas)]))
    return given.select("given", best["area_code"].alias("area_code"))


@query("select event_id, regexp_extract('answer: ' || props || ' end', '(?s)(\\{.*\\})', 1) as json from events")
def json_slice(x):
    return x.events.select("event_id", t.json_slice(F.concat(F.lit("answer: "), "props", F.lit(" end"))).alias("json"))


@query("select event_type, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as k, count(*) as n from events group by 1")
def json_extract(x):
    return x.events.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"), F.count(F.lit(1)).alias("n"))


@query(
    """select distinct id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(content, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'),
    '(<!-- image -->\\n*){2,}', '<!-- image -->' || chr(10) || chr(10), 'g'), '\\s+\\.(\\s)', '.\\1', 'g'), '\\s+,(\\s)', ',\\1', 'g'), '\\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '[\\x{f000}-\\x{f0ff}]', '', 'g')) as digest
    from parser_blocks where content is not null"""
)
def text_clean(x):
    return x.parser_blocks.filter("content is not null").select("id", F.md5(t.clean(F.col("content"))).alias("digest")).distinct()


@query("select doc_id, md5(text) as content_id, substr(md5(text), 1, 8) as short_id from documents where text is not null")
def content_id(x):
    return x.documents.filter("text is not null").select("doc_id", F.md5("text").alias("content_id"), F.substring(F.md5("text"), 1, 8).alias("short_id"))


@query("select id, cast(least(level, 3) as integer) as level from parser_sections where level is not null")
def heading_level(x):
    style = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Heading "), F.col("level").cast("string"))).otherwise(F.concat(F.lit("제목 "), F.col("level").cast("string")))
    return x.parser_sections.filter("level is not null").select("id", t.heading_level(style).alias("level"))


@query(
    """with l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: regexp_replace(trim(s), '^\\d+[.)]\\s*', '')), lambda s: length(s) >= 10) as l from documents where text is not null)
    select doc_id, coalesce(l[1], '') as first, coalesce(l[2], '') as second from l"""
)
def parse_numbered(x):
    lines = F.filter(F.transform(F.split("text", "\n"), lambda s: F.regexp_replace(F.trim(s), r"^\d+[.)]\s*", "")), lambda s: F.char_length(s) >= 10)
    d = x.documents.filter("text is not null").select("doc_id", lines.alias("l"))
    return d.select("doc_id", F.coalesce(F.get("l", F.lit(0)), F.lit("")).alias("first"), F.coalesce(F.get("l", F.lit(1)), F.lit("")).alias("second"))


_TOKENS = "unnest(regexp_extract_all(lower(translate(text, 'Σ', 'σ')), '[\\p{L}\\p{N}]+'))"


@query(f"with t as (select doc_id, {_TOKENS} as token from documents) select token, count(*) as n, count(distinct doc_id) as docs from t group by 1")
def analyze_tokens(x):
    # counts per document first, so that a frequent token is summed on the map side
    tokens = x.documents.select("doc_id", F.explode(t.analyze(F.col("text"))).alias("token"))
    per = tokens.groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


_ENDING = "^([a-z]{3,}?)(?:ingly|edly|ings|ing|ed|ies|es|s)$"
_PARTICLE = "^([가-힣]{2,}?)(?:으로|에서|에게|까지|부터|은|는|이|가|을|를|의|에|로|와|과|도)$"


@query(
    f"""with t as (select doc_id, {_TOKENS} as token from documents), e as (select doc_id, coalesce(nullif(regexp_extract(token, '{_ENDING}', 1), ''), token) as token from t),
    s as (select doc_id, coalesce(nullif(regexp_extract(token, '{_PARTICLE}', 1), ''), token) as stem from e) select stem, count(*) as n, count(distinct doc_id) as docs from s group by 1"""
)
def analyze_stemmed(x):
    """Counts of stems: the analysis for searches that are to find other forms of a word."""
    stems = x.documents.select("doc_id", F.explode(t.stemmed(t.analyze(F.col("text")))).alias("stem"))
    per = stems.groupBy("stem", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("stem").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


@query("select doc_id, trim(regexp_replace(regexp_replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[\\x{f000}-\\x{f0ff}]', '', 'g'), '[\\s\\x{A0}\\x{3000}]+', ' ', 'g')) as line from documents where text is not null and not regexp_matches(text, '\\s+[.,]\\s') and not regexp_matches(text, '(<!-- image -->\\n*){2,}')")
def normalize_space(x):
    """Texts as one line; those whose spaces before punctuation fall away too are left to text_clean."""
    d = x.documents.filter("text is not null").filter(~F.col("text").rlike(r"\s+[.,]\s") & ~F.col("text").rlike(r"(<!-- image -->\n*){2,}"))
    return d.select("doc_id", t.normalize_space(F.col("text")).alias("line"))


@query(
    """select distinct id, len(list_filter(coalesce(keywords, []), lambda k: not regexp_matches(k, '[\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}]'))) as keywords_kept from parser_propositions
    where not regexp_matches(proposition, '[\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}]') and length(trim(proposition)) > 5"""
)
def filter_script(x):
    p = x.parser_propositions.filter(~t.has_ideograph(F.col("proposition")) & (F.char_length(F.trim("proposition")) > 5))
    kept = F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: ~t.has_ideograph(k))
    return p.select("id", F.size(kept).cast("bigint").alias("keywords_kept")).distinct()


_UNSAFE = "INSERT|UPDATE|DELETE|DROP|TRUNCATE|ALTER|CREATE|REPLACE|MERGE"


@query(f"select doc_id, not regexp_matches('select * from notes where note = ''' || text || '''', '(?i)\\b({_UNSAFE})\\b') as accepted from documents where text is not null")
def sql_guard(x):
    statement = F.concat(F.lit("select * from notes where note = '"), "text", F.lit("'"))
    return x.documents.filter("text is not null").select("doc_id", (~rules.unsafe(statement)).alias("accepted"))


@query("select doc_id, regexp_extract(text, '(?i)\\bFROM\\s+([a-zA-Z_][a-zA-Z0-9_]*)', 1) as first_table from documents where text is not null")
def sql_first_table(x):
    return x.documents.filter("text is not null").select("doc_id", rules.first_table(F.col("text")).alias("first_table"))


_INTERNAL = r"(?i)보고서|연례 보고서|연간 보고서|요약|문서|내부 문서|제\d+회|제\d+차|백서|지침|가이드라인|매뉴얼|정책서|규정집|내규|기술 문서|설명서|공문|annual report|report|document|summary|white paper|guideline|manual|policy|regulation|bulletin"


@query(
    f"""with q as (select doc_id, text, case doc_id % 3 when 0 then 'web' when 1 then 'document' else 'mixed' end as kind from documents where text is not null)
    select doc_id, case when kind = 'web' and regexp_matches(text, '{_INTERNAL}') then 'document' else kind end as task_type from q"""
)
def plan_override(x):
    kind = F.when(F.col("doc_id") % 3 == 0, "web").when(F.col("doc_id") % 3 == 1, "document").otherwise("mixed")
    return x.documents.filter("text is not null").select("doc_id", rules.overridden_type(kind, F.col("text")).alias("task_type"))


@query(
    """with f as (select min(area_code) as first from subject_areas), d as (select distinct document_id, doc_type, lower(trim(domain_category)) as c from parser_documents)
    select document_id, case when doc_type in ('document', 'web', 'quantitative', 'mixed') then doc_type else 'document' end as task_type, coalesce(a.area_code, f.first) as domain
    from d cross join f left join subject_areas a on lower(a.name_en) = d.c"""
)
def plan_validate(x):
    areas = x.subject_areas.select("area_code", F.lower("name_en").alias("c"))
    first = areas.agg(F.min("area_code")).first()[0]
    d = x.parser_documents.select("document_id", "doc_type", F.lower(F.trim("domain_category")).alias("c")).distinct()
    return d.join(areas, "c", "left").select("document_id", rules.valid_type(F.col("doc_type")).alias("task_type"), F.coalesce("area_code", F.lit(first)).alias("domain"))


@query("select distinct node_id, title from toc_nodes where title is not null and not regexp_matches(title, '(?i)arXiv:|doi\\.org|https?://|^\\[\\d+\\]\\s')")
def toc_filter_biblio(x):
    return x.toc_nodes.filter("title is not null").filter(~F.col("title").rlike(r"(?i)arXiv:|doi\.org|https?://|^\[\d+\]\s")).select("node_id", "title").distinct()


@query(
    """with p as (select doc_id, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda s: trim(s)), lambda s: length(s) >= 10 and not starts_with(s, '|') and not starts_with(s, '<!--')) as p from documents where text is not null)
    select doc_id, len(p) as paragraphs, md5(array_to_string(p, '|')) as digest from p"""
)
def paragraph_split(x):
    p = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda s: F.trim(s)), lambda s: (F.char_length(s) >= 10) & ~s.startswith("|") & ~s.startswith("<!--"))
    d = x.documents.filter("text is not null").select("doc_id", p.alias("p"))
    return d.select("doc_id", F.size("p").cast("bigint").alias("paragraphs"), F.md5(F.array_join("p", "|")).alias("digest"))


@query("select doc_id, substr(text, 1, 200) as preview, substr(text, 1, 500) as context from documents")
def preview_truncate(x):
    return x.documents.select("doc_id", F.substring("text", 1, 200).alias("preview"), F.substring("text", 1, 500).alias("context"))


@query("select id, case when regexp_matches(trim(title), '^[□■◆]') then 1 when regexp_matches(trim(title), '^\\d+\\.\\s') then 2 else 3 end as depth from parser_sections where title is not null")
def classify_depth(x):
    return x.parser_sections.filter("title is not null").select("id", t.classify_depth(F.col("title")).alias("depth"))
