"""Sources, sinks, filters, listings and joins over the document catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import text as t
from docloom.functions import vector
from docloom.operators import catalog, retrieval, sections, sheets
from docloom.registry import Registry
from docloom.sources import files, paths

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
query = R.query

_B = "b as (select distinct id, document_id, section_id, block_type, content, page, minio_key, table_json, seq from parser_blocks)"
_EXT = "lower(regexp_extract(source_path, '(\\.[^./]+)$', 1))"


def _in(xs) -> str:
    return "(" + ", ".join(f"'{v}'" for v in xs) + ")"


_MEDIA = """('.pdf', 'application/pdf'), ('.hwp', 'application/x-hwp'), ('.hwpx', 'application/hwp+zip'), ('.docx', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'), ('.pptx', 'application/vnd.openxmlformats-officedocument.presentationml.presentation'), ('.md', 'text/markdown'), ('.csv', 'text/csv'), ('.xlsx', 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet'), ('.jpg', 'image/jpeg'), ('.jpeg', 'image/jpeg'), ('.png', 'image/png'), ('.bmp', 'image/bmp'), ('.tiff', 'image/tiff'), ('.tif', 'image/tiff'), ('.webp', 'image/webp')"""


@query(
    f"""with m(ext, mime) as (values {_MEDIA}), e as (select distinct document_id, {_EXT} as extension from parser_documents where source_path is not null)
    select document_id, extension, mime is not null as supported, extension in ('.hwp', '.hwpx', '.docx') as needs_conversion, extension in ('.jpg', '.jpeg', '.png', '.bmp', '.tiff', '.tif', '.webp') as is_image, coalesce(mime, 'application/octet-stream') as mime_type from e left join m on extension = ext"""
)
def scan_format_detect(x):
    e = t.extension(F.col("source_path"))
    kinds = F.create_map(*[F.lit(v) for k, row in t.EXTENSIONS.items() for v in (k, row[2])])
    return x.parser_documents.filter("source_path is not null").select(
        "document_id", e.alias("extension"), e.isin(list(t.EXTENSIONS)).alias("supported"), e.isin([k for k, v in t.EXTENSIONS.items() if v[0]]).alias("needs_conversion"),
        e.isin([k for k, v in t.EXTENSIONS.items() if v[1]]).alias("is_image"), F.coalesce(kinds[e], F.lit("application/octet-stream")).alias("mime_type"),
    ).distinct()


@query(f"with {_B} select document_id, case when avg(length(trim(content))) >= 20 then 'text' else 'image' end as pdf_type from b where block_type = 'text' and content is not null and page < 5 group by 1")
def scan_pdf_classify(x):
    b = x.parser_blocks.filter("block_type = 'text' and content is not null and page < 5").select("id", "document_id", "content", "page").distinct()
    return b.groupBy("document_id").agg(F.when(F.avg(F.char_length(F.trim("content"))) >= 20, "text").otherwise("image").alias("pdf_type"))


@query("select o_orderkey, to_json({'o_orderkey': cast(o_orderkey as varchar), 'o_orderstatus': o_orderstatus, 'o_orderpriority': o_orderpriority}) as row_data from orders")
def scan_rows_as_maps(x):
    row = F.struct(F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_orderstatus", "o_orderpriority")
    return x.orders.select("o_orderkey", F.to_json(row).alias("row_data"))


@query(
    """with l as (select doc_id, i - 1 as pos, ls[i] as line from (select doc_id, string_split(text, chr(10)) as ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents where text is not null)),
    h as (select doc_id, pos, nullif(regexp_extract(trim(line), '^##\\s+(.+)', 1), '') as head, nullif(regexp_extract(trim(line), '^###\\s+(.+)', 1), '') as entry from l),
    f as (select *, last_value(head ignore nulls) over (partition by doc_id order by pos) as category from h) select doc_id, cast(pos as integer) as pos, category, coalesce(entry, head) as entry, entry is not null as below from f where coalesce(entry, head) is not null"""
)
def taxonomy_scan(x):
    """(doc_id, pos, category, entry, below): second-level headings are categories, third-level ones entries below the category above them."""
    lines = x.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(F.trim("line").rlike(r"^#{2,3}\s"))
    title = lambda mark: F.nullif(F.regexp_extract(F.trim("line"), rf"^{mark}\s+(.+)", 1), F.lit(""))
    w = Window.partitionBy("doc_id").orderBy("pos")
    filled = lines.withColumn("entry", title("###")).withColumn("head", title("##")).withColumn("category", F.last("head", ignorenulls=True).over(w))
    return filled.select("doc_id", "pos", "category", F.coalesce("entry", "head").alias("entry"), F.col("entry").isNotNull().alias("below")).filter("entry is not null")


_ASK = "qt as (select distinct unnest(regexp_extract_all(lower(translate(proposition, 'Σ', 'σ')), '[\\p{L}\\p{N}]+')) as term from (select proposition from chunk_index where proposition is not null order by chunk_id, proposition limit 1))"


@query(
    f"""with {_ASK}, b_t as (select doc_id as id, regexp_extract_all(lower(translate(text, 'Σ', 'σ')), '[\\p{{L}}\\p{{N}}]+') as t from documents where text is not null), b_s as (select count(*) as total, avg(len(t)) as mean from b_t),
    b_f as (select id, dl, term, count(*) as tf from (select id, len(t) as dl, unnest(t) as term from b_t) where term in (select term from qt) group by 1, 2, 3), b_d as (select term, count(*) as df from b_f group by 1),
    b as (select id, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) as score from b_f join b_d using (term), b_s group by 1),
    r as (select id, row_number() over (order by score desc, id) as rank from b) select id as doc_id, rank, round(1.0 / rank, 6) as score from r where rank <= 5"""
)
def web_search_rank_score(x):
    """The first five pages for a question (the first chunk's words), ranked by BM25, scored by one over their rank."""
    first = x.chunk_index.filter("proposition is not null").select("chunk_id", "proposition", t.analyze(F.col("proposition")).alias("t")).orderBy("chunk_id", "proposition").first()
    pages = x.documents.select(F.col("doc_id").alias("id"), "text")
    top = retrieval.ranked(retrieval.bm25(pages, sorted(set(first.t)) if first else []), 5)
    return top.select(F.col("id").alias("doc_id"), "rank", F.round(1.0 / F.col("rank"), 6).alias("score"))


_MIME = "case lower(regexp_extract(minio_key, '\\.([^.]+)$', 1)) when 'jpg' then 'image/jpeg' when 'jpeg' then 'image/jpeg' when 'webp' then 'image/webp' else 'image/png' end"


@query(
    f"""with {_B}, r as (select section_id, id, minio_key, row_number() over (partition by section_id order by seq, id) as rank from b where block_type = 'image' and minio_key is not null and section_id is not null)
    select section_id, id, rank, {_MIME} as mime_type from r where rank <= 3"""
)
def section_images_topn(x):
    b = x.parser_blocks.filter("block_type = 'image' and minio_key is not null and section_id is not null").select("section_id", "id", "seq", "minio_key").distinct()
    kind = F.lower(F.regexp_extract("minio_key", r"\.([^.]+)$", 1))
    mime = F.when(kind.isin("jpg", "jpeg"), "image/jpeg").when(kind == "webp", "image/webp").otherwise("image/png")
    return catalog.top_by(b, ["section_id"], 3, "seq", "id").select("section_id", "id", F.col("rank").cast("bigint").alias("rank"), mime.alias("mime_type"))


@query(
    f"""select distinct document_id, 'raw/' || strftime(created_at, '%Y%m%d') || '/' || regexp_replace(regexp_extract(source_path, '([^/]+)$', 1), '\\.[^./]+$', '') || '_' || substr(md5(regexp_extract(source_path, '([^/]+)$', 1)), 1, 8) || {_EXT} as object_key
    from parser_documents where created_at is not null and source_path is not null"""
)
def object_key(x):
    return x.parser_documents.filter("created_at is not null and source_path is not null").select("document_id", t.object_key("raw", F.col("created_at"), F.col("source_path")).alias("object_key")).distinct()


_ORDER = "coalesce(created_at, timestamp '1970-01-01') {0}, source_path {0}, doc_type {0} nulls {1}, domain_category {0} nulls {1}"


@query(
    f"""with f as (select *, row_number() over (partition by document_id order by {_ORDER.format('asc', 'first')}) as n from parser_documents), l as (select *, row_number() over (partition by document_id order by {_ORDER.format('desc', 'last')}) as n from parser_documents)
    select f.document_id, f.source_path, f.original_ext, l.doc_type, l.domain_category, l.minio_bucket, l.minio_key, l.created_at from f join l on f.document_id = l.document_id and f.n = 1 and l.n = 1"""
)
def upsert_documents(x):
    return catalog.merged_documents(x.parser_documents)


@query(
    f"""with {_B} select b.id, b.document_id, row_number() over (partition by b.document_id order by s.seq nulls first, b.seq nulls first, b.id) - 1 as table_index from b left join parser_sections s on s.id = b.section_id where b.block_type = 'table' and b.table_json is not null"""
)
def table_index_assign(x):
    b = x.parser_blocks.filter("block_type = 'table' and table_json is not null").select("id", "document_id", "section_id", "seq").distinct()
    s = x.parser_sections.select(F.col("id").alias("section_id"), F.col("seq").alias("s_seq"))
    # sections order the tables; those of a document with very many go over ranges
    at = sections.running_sum(b.join(s, "section_id", "left").select("id", "document_id", "s_seq", "seq"), "document_id", ["s_seq", "seq", "id"], F.lit(1), "n")
    return at.select("id", "document_id", (F.col("n") - 1).alias("table_index"))


@query(
    """with latest as (select job_id, arg_max(status, (coalesce(completed_at, started_at, timestamp '1970-01-01'), id, status)) as status from parser_job_steps group by 1),
    gone as (select job_id as document_id from latest where status in ('failed', 'cancelled', 'pending'))
    select 'parser_documents' as table_name, count(*) as rows_before, count(*) filter (document_id not in (select document_id from gone)) as rows_after from parser_documents
    union all select 'parser_sections', count(*), count(*) filter (document_id not in (select document_id from gone)) from parser_sections
    union all select 'parser_propositions', count(*), count(*) filter (document_id not in (select document_id from gone)) from parser_propositions
    union all select 'parser_blocks', count(*), count(*) filter (document_id not in (select document_id from gone)) from parser_blocks"""
)
def delete_cascade(x):
    """Rows left when documents whose last step did not complete go, with all their children."""
    none = F.lit(catalog.EPOCH).cast("timestamp_ntz")
    latest = x.parser_job_steps.groupBy("job_id").agg(F.max_by("status", F.struct(F.coalesce("completed_at", "started_at", none), "id", "status")).alias("status"))
    gone = latest.filter(F.col("status").isin("failed", "cancelled", "pending")).select(F.col("job_id").alias("document_id"))
    out = None
    for name in ("parser_documents", "parser_sections", "parser_propositions", "parser_blocks"):
        df = getattr(x, name).select("document_id").join(gone.withColumn("gone", F.lit(1)), "document_id", "left")
        n = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows_before"), F.count(F.when(F.col("gone").isNull(), 1)).alias("rows_after"))
        out = n if out is None else out.unionByName(n)
    return out


@query(
    """with c as (select distinct chunk_id, parent_section_id, section_name, proposition, content from chunk_index), r as (select *, row_number() over (partition by parent_section_id order by chunk_id) - 1 as sub from c where parent_section_id is not null)
    select printf('sec%03d_sub%03d.md', cast(parent_section_id as integer), sub) as file_name, md5('# ' || coalesce(section_name, '') || ' > ' || sub || chr(10) || '- ' || coalesce(proposition, '') || chr(10) || '---' || chr(10) || coalesce(content, '')) as digest from r"""
)
def chunk_export_text(x):
    c = x.chunk_index.filter("parent_section_id is not null").select("chunk_id", "parent_section_id", "section_name", "proposition", "content").distinct()
    c = c.withColumn("sub", F.row_number().over(Window.partitionBy("parent_section_id").orderBy("chunk_id")) - 1)
    e = lambda n: F.coalesce(n, F.lit(""))
    body = F.concat(F.lit("# "), e("section_name"), F.lit(" > "), F.col("sub").cast("string"), F.lit("\n- "), e("proposition"), F.lit("\n---\n"), e("content"))
    return c.select(F.format_string("sec%03d_sub%03d.md", F.col("parent_section_id").cast("int"), "sub").alias("file_name"), F.md5(body).alias("digest"))


@query("select distinct document_id, title from doc_index where doc_type in ('manual', 'minutes', 'tender') and domain_category is not null")
def filter_terms(x):
    return x.doc_index.filter(F.col("doc_type").isin("manual", "minutes", "tender") & F.col("domain_category").isNotNull()).select("document_id", "title").distinct()


@query("with r as (select document_id, id, title, row_number() over (partition by document_id order by seq, id) as n from parser_sections where title ilike '%schedule%') select document_id, id, title from r where n = 1")
def inspect_title_ilike(x):
    s = x.parser_sections.filter(F.col("title").ilike("%schedule%")).select("document_id", "id", "title", "seq")
    return catalog.first_by(s, ["document_id"], "seq", "id").select("document_id", "id", "title")


_LATEST = "latest as (select job_id, arg_max(status, (coalesce(completed_at, started_at, timestamp '1970-01-01'), id, status)) as status, max(coalesce(completed_at, started_at)) as updated_at from parser_job_steps group by 1)"


def latest_jobs(x):
    none = F.lit(catalog.EPOCH).cast("timestamp_ntz")
    at = F.struct(F.coalesce("completed_at", "started_at", none), "id", "status")
    return x.parser_job_steps.groupBy("job_id").agg(F.max_by("status", at).alias("status"), F.max(F.coalesce("completed_at", "started_at")).alias("updated_at"))


@query(f"with {_LATEST} select distinct d.document_id, l.status from parser_documents d join latest l on l.job_id = d.document_id where contains(lower(d.source_path), 're') and l.status = 'completed'")
def jobs_filter(x):
    d = x.parser_documents.filter(F.lower("source_path").contains("re")).select("document_id").distinct()
    return d.join(latest_jobs(x).filter("status = 'completed'"), F.col("job_id") == F.col("document_id")).select("document_id", "status")


@query(f"with {_LATEST} select job_id, status, updated_at from latest order by updated_at desc nulls last, job_id limit 20 offset 20")
def jobs_page(x):
    return latest_jobs(x).orderBy(F.desc_nulls_last("updated_at"), "job_id").offset(20).limit(20)


@query(
    f"""with p as (select document_id, arg_max(source_path, coalesce(created_at, timestamp '1970-01-01')) as source_path from parser_documents group by 1), i as (select distinct document_id, title, file_name from doc_index)
    select coalesce(p.document_id, i.document_id) as document_id, coalesce(p.source_path, i.file_name) as name, i.title from p full join i on p.document_id = i.document_id"""
)
def merge_by_key(x):
    """Two lists of documents merged by key: the catalogue wins, rows of either list stay."""
    p = x.parser_documents.groupBy("document_id").agg(F.max_by("source_path", F.coalesce("created_at", F.lit(catalog.EPOCH).cast("timestamp_ntz"))).alias("source_path"))
    i = x.doc_index.select("document_id", "title", "file_name").distinct()
    return p.join(i, "document_id", "full").select("document_id", F.coalesce("source_path", "file_name").alias("name"), "title")


@query(
    """with d as (select distinct document_id from doc_index), c as (select document_id, count(distinct chunk_id) as n from chunk_index group by 1)
    select d.document_id, coalesce(c.n, 0) as chunks from d left join c using (document_id)"""
)
def doc_chunk_counts(x):
    c = x.chunk_index.select("document_id", "chunk_id").distinct().groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    return x.doc_index.select("document_id").distinct().join(c, "document_id", "left").select("document_id", F.coalesce("n", F.lit(0)).alias("chunks"))


@query("select distinct s.id, s.title, d.source_path from parser_sections s join (select document_id, min(source_path) as source_path from parser_documents group by 1) d using (document_id)")
def join_section_meta(x):
    d = x.parser_documents.groupBy("document_id").agg(F.min("source_path").alias("source_path"))
    return x.parser_sections.join(d, "document_id").select("id", "title", "source_path").distinct()


@query("select distinct p.section_id, regexp_extract(d.source_path, '([^/]+)$', 1) as file_name from (select distinct section_id, document_id from parser_propositions where section_id is not null) p join (select document_id, min(source_path) as source_path from parser_documents group by 1) d using (document_id)")
def resolve_sources(x):
    hits = x.parser_propositions.filter("section_id is not null").select("section_id", "document_id").distinct()
    d = x.parser_documents.groupBy("document_id").agg(F.min("source_path").alias("source_path"))
    return hits.join(d, "document_id").select("section_id", t.file_name(F.col("source_path")).alias("file_name")).distinct()


@query(
    """with p as (select distinct id, section_id, keywords from parser_propositions), u as (select id, section_id, unnest(case when keywords is null or len(keywords) = 0 then [null] else keywords end) as keyword from p)
    select s.document_id, u.id, u.keyword from u join parser_sections s on s.id = u.section_id"""
)
def lateral_unnest_outer(x):
    p = x.parser_propositions.select("id", "section_id", "keywords").distinct().select("id", "section_id", F.explode_outer("keywords").alias("keyword"))
    s = x.parser_sections.select(F.col("id").alias("section_id"), "document_id")
    return p.join(s, "section_id").select("document_id", "id", "keyword")


@query(
    f"""with {_B} select s.id as section_id, count(b.id) as blocks, count(b.id) filter (b.block_type = 'text') as texts, coalesce(cast(sum(length(b.content)) as bigint), 0) as chars from parser_sections s left join b on b.section_id = s.id group by 1"""
)
def sections_with_blocks(x):
    b = x.parser_blocks.select("id", "section_id", "block_type", "content").distinct()
    g = b.groupBy("section_id").agg(F.count("id").alias("blocks"), F.count_if(F.col("block_type") == "text").alias("texts"), F.sum(F.char_length("content")).alias("chars"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return x.parser_sections.select(F.col("id").alias("section_id")).join(g, "section_id", "left").select("section_id", zero("blocks"), zero("texts"), zero("chars"))


@query(
    """with n as (select node_id, document_id, lower(translate(regexp_replace(title, '[^\\p{L}\\p{N}_]', '', 'g'), 'Σ', 'σ')) as k, ord from (select distinct node_id, document_id, title, ord from toc_nodes)),
    t as (select document_id, k, arg_max(node_id, (ord, node_id)) as node_id from n where k <> '' group by 1, 2)
    select s.id as section_id, t.node_id from (select id, document_id, lower(translate(regexp_replace(title, '[^\\p{L}\\p{N}_]', '', 'g'), 'Σ', 'σ')) as k from parser_sections) s join t on t.document_id = s.document_id and t.k = s.k"""
)
def toc_match_join(x):
    """Sections and toc entries of one normalised title; of repeated entries the last counts."""
    n = x.toc_nodes.select("node_id", "document_id", t.normalize_title(F.col("title")).alias("k"), "ord").filter("k <> ''")
    n = n.groupBy("document_id", "k").agg(F.max_by("node_id", F.struct("ord", "node_id")).alias("node_id"))
    s = x.parser_sections.select(F.col("id").alias("section_id"), "document_id", t.normalize_title(F.col("title")).alias("k"))
    return s.join(n, ["document_id", "k"]).select("section_id", "node_id")


@query("select distinct p.id from parser_propositions p where p.document_id in (select document_id from doc_index where doc_type = 'manual')")
def hier_semi_filter(x):
    d = x.doc_index.filter("doc_type = 'manual'").select("document_id")
    return x.parser_propositions.join(d, "document_id", "left_semi").select("id").distinct()


@query("with r as (select section_id, id, row_number() over (partition by section_id order by seq, id) as n from (select distinct section_id, id, seq from parser_propositions where section_id is not null)) select section_id, id from r where n = 1")
def dedupe_first(x):
    p = x.parser_propositions.filter("section_id is not null")
    return p.groupBy("section_id").agg(F.min(F.struct("seq", "id"))["id"].alias("id"))


@query(
    """with e as (select vec_id, label, embedding::double[] as v from embeddings where list_sum(list_transform(embedding, lambda x: abs(x))) > 0), p as (select a.label = b.label as same, list_cosine_similarity(a.v, b.v) as c from e a join e b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id)
    select same, count(*) as pairs, round(avg(c), 4) as mean from p group by 1"""
)
def pairwise_intra_inter(x):
    """Mean cosine of pairs with equal and with different labels: every vector whose id is divisible by 20 against all others.

    The mean over all pairs of two sets is a product of sums of unit vectors, so that no pair is formed.
    """
    e = x.embeddings.filter("embedding is not null and exists(embedding, v -> v <> 0)").select("vec_id", "label", F.col("embedding").alias("v"))
    unit = e.select("vec_id", "label", F.transform("v", lambda a: a.cast("double") / F.sqrt(vector.dot(F.col("v"), F.col("v")))).alias("u"))
    asked = F.col("vec_id") % 20 == 0
    flat = unit.select("label", asked.alias("asked"), F.posexplode("u").alias("i", "x"))
    sums = flat.groupBy("label", "i").agg(F.sum("x").alias("every"), F.coalesce(F.sum(F.when(F.col("asked"), F.col("x"))), F.lit(0.0)).alias("some"))
    n = unit.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(asked).alias("m"))
    inside = sums.groupBy("label").agg(F.sum(F.col("every") * F.col("some")).alias("dot")).join(n, "label")
    # a vector with itself is no pair
    own = inside.agg(F.sum(F.col("dot") - F.col("m")).alias("s"), F.sum(F.col("m") * (F.col("n") - 1)).cast("bigint").alias("c"))
    allsum = sums.groupBy("i").agg((F.sum("every") * F.sum("some")).alias("d")).agg(F.sum("d").alias("d"))
    total = allsum.crossJoin(n.agg(F.sum("m").alias("m"), F.sum("n").alias("n"))).crossJoin(own)  # one row each
    mean = lambda s, c: F.round(s / c, 4).alias("mean")
    same = total.select(F.lit(True).alias("same"), F.col("c").alias("pairs"), mean(F.col("s"), F.col("c")))
    others = F.col("m") * (F.col("n") - 1) - F.col("c")
    different = total.select(F.lit(False).alias("same"), others.cast("bigint").alias("pairs"), mean(F.col("d") - F.col("m") - F.col("s"), others))
    return same.unionByName(different).filter("pairs > 0")


@query(f"with {_B} select section_id, cast(min(page) as integer) as first_page, cast(max(page) as integer) as last_page from b where section_id is not null group by 1")
def page_range(x):
    return catalog.page_ranges(x.parser_blocks)


@query(
    f"""with {_B}, r as (select section_id, min(page) as a, max(page) as z from b where section_id is not null group by 1), d as (select document_id, regexp_extract(min(source_path), '([^/]+)$', 1) as name from parser_documents group by 1)
    select s.id as section_id, case when r.a is null then d.name when r.a = r.z then d.name || ', p.' || r.a else d.name || ', pp.' || r.a || '-' || r.z end as citation from parser_sections s join d using (document_id) left join r on r.section_id = s.id"""
)
def citation_format(x):
    d = x.parser_documents.groupBy("document_id").agg(t.file_name(F.min("source_path")).alias("name"))
    s = x.parser_sections.select(F.col("id").alias("section_id"), "document_id")
    j = s.join(d, "document_id").join(catalog.page_ranges(x.parser_blocks), "section_id", "left")
    return j.select("section_id", t.citation(F.col("name"), F.col("first_page"), F.col("last_page")).alias("citation"))


@query(
    """with p as (select s.document_id, p.id, p.seq, s.seq as s_seq, p.proposition, unnest(case when p.keywords is null or len(p.keywords) = 0 then [null] else p.keywords end) as k from (select distinct id, section_id, seq, proposition, keywords from parser_propositions) p join parser_sections s on s.id = p.section_id)
    select document_id, md5(array_to_string(list(proposition order by s_seq, seq, id), '|')) as digest, count(*) as items from p where proposition is not null group by 1"""
)
def agg_ordered_array(x):
    """Propositions of a document in order, repeated once a keyword, as the lateral join leaves them."""
    p = x.parser_propositions.filter("proposition is not null").select("id", "section_id", "seq", "proposition", "keywords").distinct()
    p = p.select("id", "section_id", "seq", "proposition", F.explode_outer("keywords").alias("k"))
    s = x.parser_sections.select(F.col("id").alias("section_id"), "document_id", F.col("seq").alias("s_seq"))
    a = F.array_sort(F.collect_list(F.struct("s_seq", "seq", "id", "proposition")))
    g = p.join(s, "section_id").groupBy("document_id").agg(a.alias("a"))
    return g.select("document_id", F.md5(F.array_join(F.transform("a", lambda v: v["proposition"]), "|")).alias("digest"), F.size("a").cast("bigint").alias("items"))


@query("select document_id, list_sort(list(distinct k)) as keywords from (select document_id, unnest(keywords) as k from parser_propositions) where k is not null group by 1")
def agg_distinct_filter(x):
    k = x.parser_propositions.select("document_id", F.explode("keywords").alias("k")).filter("k is not null").distinct()
    return k.groupBy("document_id").agg(F.array_sort(F.collect_list("k")).alias("keywords"))


@query(f"with {_B} select section_id, md5(string_agg(trim(content), chr(10) || chr(10) order by seq, id)) as digest from b where block_type = 'text' and trim(content) <> '' and section_id is not null group by 1")
def section_text(x):
    b = x.parser_blocks.select("id", "section_id", "block_type", "content", "seq").distinct()
    return catalog.section_texts(b).select("section_id", F.md5("text").alias("digest"))


@query(f"with {_B} select s.id, (select count(*) from b where b.section_id = s.id) as blocks from parser_sections s")
def section_block_counts(x):
    n = x.parser_blocks.select("id", "section_id").distinct().groupBy("section_id").agg(F.count(F.lit(1)).alias("n"))
    return x.parser_sections.select("id").join(n, F.col("id") == F.col("section_id"), "left").select("id", F.coalesce("n", F.lit(0)).alias("blocks"))


@query(
    """with k as (select p.id, u.k, u.pos from (select distinct id, keywords from parser_propositions) p, lateral (select unnest(p.keywords) as k, generate_subscripts(p.keywords, 1) as pos) u where u.k is not null)
    select k as keyword, count(*) as n from k group by 1 order by n desc, min((id, pos)) limit 30"""
)
def keyword_topn(x):
    k = x.parser_propositions.select("id", "keywords").distinct().select("id", F.posexplode("keywords").alias("pos", "keyword")).filter("keyword is not null")
    g = k.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "pos")).alias("first"))
    return g.orderBy(F.desc("n"), "first").limit(30).select("keyword", "n")


@query(
    f"""with {_B} select document_id, page, coalesce(arg_min(substr(split_part(trim(content), chr(10), 1), 1, 60), (seq, id)) filter (block_type = 'text' and trim(content) <> ''), 'Page ' || (page + 1)) as title, count(*) as blocks from b where page is not null group by 1, 2"""
)
def group_by_page(x):
    b = x.parser_blocks.filter("page is not null").select("id", "document_id", "page", "block_type", "content", "seq").distinct()
    first = F.min(F.when((F.col("block_type") == "text") & (F.trim("content") != ""), F.struct("seq", "id", F.substring(F.split_part(F.trim("content"), F.lit("\n"), F.lit(1)), 1, 60).alias("c"))))
    g = b.groupBy("document_id", "page").agg(first.alias("f"), F.count(F.lit(1)).alias("blocks"))
    return g.select("document_id", "page", F.coalesce("f.c", F.concat(F.lit("Page "), (F.col("page") + 1).cast("string"))).alias("title"), "blocks")


@query(f"with {_B}, l as (select document_id, lower(trim(split_part(content, chr(10), 1))) as line from b where block_type = 'text' and content is not null) select document_id, line, count(*) as n from l where line <> '' group by 1, 2 having count(*) >= 5")
def repeated_titles(x):
    """First lines that stand on five blocks of a document or more: headers and footers."""
    b = x.parser_blocks.filter("block_type = 'text' and content is not null").select("id", "document_id", "content").distinct()
    l = b.select("document_id", F.lower(F.trim(F.split_part("content", F.lit("\n"), F.lit(1)))).alias("line")).filter("line <> ''")
    return l.groupBy("document_id", "line").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")


@query(
    """select 'document' as step, document_id as key from (select distinct document_id from doc_index where doc_type = 'manual') union all
    select 'domain', document_id from (select distinct document_id from doc_index where doc_type in ('manual', 'minutes')) union all
    select 'node', chunk_id from (select distinct chunk_id from chunk_index where section_depth = 2)"""
)
def step_union_all(x):
    d = x.doc_index.select("document_id", "doc_type").distinct()
    pick = lambda df, step, col: df.select(F.lit(step).alias("step"), F.col(col).alias("key")).distinct()
    a = pick(d.filter("doc_type = 'manual'"), "document", "document_id")
    b = pick(d.filter("doc_type in ('manual', 'minutes')"), "domain", "document_id")
    return a.unionByName(b).unionByName(pick(x.chunk_index.filter("section_depth = 2"), "node", "chunk_id"))


@query("select document_id from doc_index union select document_id from chunk_index union select document_id from parser_documents")
def union_distinct_ids(x):
    ids = lambda df: df.select("document_id")
    return ids(x.doc_index).union(ids(x.chunk_index)).union(ids(x.parser_documents)).distinct()


@query(
    """with a as (select row_number() over (order by area_code) as pos, area_code from subject_areas), d as (select document_id, arg_max(lower(trim(domain_category)), coalesce(created_at, timestamp '1970-01-01')) as c from parser_documents group by 1),
    f as (select document_id, a.area_code as hit from d left join a on a.area_code = d.c),
    c as (select document_id, hit as area_code, 0 as pos from f where hit is not null union all select document_id, a.area_code, a.pos from f cross join a where hit is null or a.area_code <> hit),
    r as (select document_id, area_code, row_number() over (partition by document_id order by pos) as rank from c) select document_id, area_code, rank from r where rank <= 3"""
)
def domain_padding(x):
    """Three candidate areas a document: the one its category names, then others in list order."""
    codes = [r.area_code for r in x.subject_areas.select("area_code").orderBy("area_code").limit(1001).collect()]  # a fixed dimension
    if len(codes) > 1000:
        raise ValueError("more than 1000 areas")
    d = x.parser_documents.groupBy("document_id").agg(F.max_by(F.lower(F.trim("domain_category")), F.coalesce("created_at", F.lit(catalog.EPOCH).cast("timestamp_ntz"))).alias("c"))
    every = F.array(*[F.lit(c) for c in codes])
    hit = F.when(F.col("c").isin(codes), F.array("c")).otherwise(F.array().cast("array<string>"))
    three = F.slice(F.array_distinct(F.concat(hit, every)), 1, 3)
    return d.select("document_id", F.posexplode(three).alias("p", "area_code")).select("document_id", "area_code", (F.col("p") + 1).cast("bigint").alias("rank"))


_DIG = """pr as (select distinct document_id, id, seq, proposition, keywords from parser_propositions), ld as (select document_id, proposition, row_number() over (partition by document_id order by seq nulls first, id) as r from pr where proposition is not null),
    sm as (select document_id, string_agg(proposition, ' ' order by r) as summary from ld where r <= 3 group by 1),
    kw as (select document_id, id, seq, unnest(keywords) as k, generate_subscripts(keywords, 1) as pos from pr), kn as (select document_id, k, count(*) as n, min((seq, id, pos)) as f from kw where k is not null group by 1, 2),
    kr as (select document_id, k, row_number() over (partition by document_id order by n desc, f, k) as r from kn), ks as (select document_id, list(k order by r) as keywords from kr where r <= 30 group by 1),
    dg as (select coalesce(sm.document_id, ks.document_id) as document_id, summary, keywords from sm full join ks on sm.document_id = ks.document_id)"""


@query(f"with {_DIG} select * from dg")
def doc_summary_keywords(x):
    """A document's first propositions and most frequent keywords, what a summary is made of."""
    return catalog.digests(x.parser_propositions.select("document_id", "id", "seq", "proposition", "keywords").distinct())


@query(f"with {_DIG}, d as (select distinct document_id from parser_documents) select d.document_id, dg.summary, dg.keywords from d left join dg on dg.document_id = d.document_id")
def late_summary_update(x):
    """The catalogue's documents with the summaries and keywords that come after them."""
    late = catalog.digests(x.parser_propositions.select("document_id", "id", "seq", "proposition", "keywords").distinct()).withColumn("at", F.lit(1))
    return catalog.with_summaries(x.parser_documents.select("document_id").distinct(), late)


@query(
    f"""with {_B}, t as (select b.id, b.document_id, b.table_json from b where block_type = 'table' and table_json is not null and json_array_length(table_json) > 0), q as (select distinct section_id from parser_propositions where proposition is not null and section_id is not null),
    f as (select distinct b.id, b.section_id from b where block_type = 'table') select t.id as block_id, cast(json_array_length(t.table_json) as integer) as n_rows, array_to_string(list_sort(json_keys(json_extract(t.table_json, '$[0]'))), ', ') as columns from t join f using (id) where f.section_id is null or f.section_id not in (select section_id from q)"""
)
def table_fallback(x):
    """Tables of sections without a proposition, by their columns and number of rows."""
    tables = sheets.parsed_tables(x.parser_blocks.select("id", "document_id", "section_id", "seq", "block_type", "table_json").distinct())
    told = x.parser_propositions.filter("proposition is not null and section_id is not null").select("section_id").distinct()
    left = tables.join(told, "section_id", "left_anti")
    return left.select("block_id", F.size("rows").alias("n_rows"), F.array_join(F.array_sort(sheets.headers(F.col("rows"))), ", ").alias("columns"))


@query(
    """with o as (select distinct chunk_id, parent_section_id, token_count from chunk_index), n as (select chunk_id, parent_section_id, coalesce(token_count, 0) + 1 as token_count from o where cast(parent_section_id as bigint) % 2 = 0)
    select chunk_id, parent_section_id, token_count from o where chunk_id not in (select chunk_id from n) union all select * from n"""
)
def index_upsert(x):
    """The index after the chunks of every other section were indexed again."""
    old = x.chunk_index.select("chunk_id", "parent_section_id", "token_count").distinct()
    new = old.filter(F.col("parent_section_id").cast("bigint") % 2 == 0).withColumn("token_count", F.coalesce("token_count", F.lit(0)) + 1)
    return catalog.upserted(old, new, "chunk_id")


@query("select s_suppkey, to_json({'s_suppkey': cast(s_suppkey as varchar), 's_name': s_name}) as row_data from supplier")
def scan_csv_rows(x):
    """A table written as CSV files and read back as rows of text by header."""
    folder = paths.scratch(x.spark, "csv")
    x.supplier.select("s_suppkey", "s_name").write.option("header", True).csv(folder)
    rows = files.csv_rows(x.spark, folder)
    return rows.select(F.col("row")["s_suppkey"].cast("bigint").alias("s_suppkey"), F.to_json("row").alias("row_data"))
