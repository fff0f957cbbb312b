"""Tables inside documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.operators import catalog, sheets
from docloom.registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
query = R.query

_T = "t as (select distinct id as block_id, document_id, section_id, seq, table_json from parser_blocks where block_type = 'table' and table_json is not null and json_array_length(table_json) > 0)"
_RW = "rw as (select block_id, document_id, section_id, i - 1 as row_index, json_extract(table_json, '$[' || (i - 1) || ']') as r from (select *, unnest(range(1, cast(json_array_length(table_json) as bigint) + 1)) as i from t))"
_KV = "kv as (select block_id, row_index, i - 1 as col, ks[i] as k, coalesce(json_extract_string(r, '$.\"' || ks[i] || '\"'), '') as v from (select *, json_keys(r) as ks, unnest(range(1, len(json_keys(r)) + 1)) as i from rw))"
_GRID = f"with {_T}, {_RW}, {_KV}, g as (select block_id, 0 as row, col, k as value from kv where row_index = 0 union all select block_id, row_index + 1, col, v from kv)"


def tables(x):
    return sheets.parsed_tables(x.parser_blocks.select("id", "document_id", "section_id", "seq", "block_type", "table_json").distinct())


def grid(x):
    return sheets.cells(tables(x))


@query(
    f"""{_GRID}, m as (select block_id, 0 as row_from, 1 as row_to, 0 as col_from, 1 as col_to from t where block_id % 2 = 0)
    select g.block_id, cast(g.row as integer) as row, cast(g.col as integer) as col, coalesce((select c.value from g c join m on c.block_id = m.block_id and c.row = m.row_from and c.col = m.col_from where m.block_id = g.block_id and g.row between m.row_from and m.row_to and g.col between m.col_from and m.col_to limit 1), g.value) as value from g"""
)
def xlsx_expand_merged(x):
    """Grids in which every other table's upper left four cells are one range."""
    merges = tables(x).filter("block_id % 2 = 0").select("block_id", F.lit(0).alias("row_from"), F.lit(1).alias("row_to"), F.lit(0).alias("col_from"), F.lit(1).alias("col_to"))
    return sheets.expand_merged(grid(x), merges)


@query(f"{_GRID}, f as (select distinct block_id, row from g where trim(value) <> ''), i as (select *, row - row_number() over (partition by block_id order by row) as island from f) select block_id, cast(min(row) as integer) as first_row, cast(max(row) as integer) as last_row from i group by block_id, island")
def xlsx_detect_regions(x):
    return sheets.regions(grid(x))


@query(
    f"""{_GRID}, r as (select block_id, row, max(case when regexp_matches(value, '^-?\\d+(\\.\\d+)?$') then 1 else 0 end) as num from g group by 1, 2), b as (select *, sum(num) over (partition by block_id order by row) as before from r)
    select block_id, greatest(count(*) filter (before = 0), 1) as depth from b group by 1"""
)
def xlsx_header_depth(x):
    return sheets.header_depth(grid(x))


@query(
    f"""{_GRID}, h as (select block_id, col, coalesce(string_agg(trim(value), '.' order by row) filter (trim(value) <> ''), '') as h from g where row < 2 group by 1, 2), n as (select block_id, col, case when h = '' then 'col' || col else h end as h from h),
    k as (select *, row_number() over (partition by block_id, h order by col) - 1 as i from n) select block_id, cast(col as integer) as col, case when i > 0 then h || '_' || i else h end as header from k"""
)
def xlsx_flat_headers(x):
    return sheets.flat_headers(grid(x))


@query(f"with {_T}, {_RW}, {_KV} select block_id, cast(row_index as integer) as row_index, string_agg(k, '|' order by col) as header, string_agg(v, '|' order by col) as row_values from kv group by 1, 2")
def table_rows_normalize(x):
    rows = sheets.table_rows(tables(x))
    return rows.select("block_id", "row_index", F.array_join(F.map_keys("row"), "|").alias("header"), F.array_join(F.map_values("row"), "|").alias("row_values"))


@query(f"with {_T}, {_RW}, {_KV} select block_id, cast(row_index as integer) as row_index, 'T' || block_id || ': ' || coalesce(string_agg(k || '=' || v, ', ' order by col) filter (trim(v) <> ''), '') as text from kv group by 1, 2")
def row_to_text(x):
    label = F.concat(F.lit("T"), F.col("block_id").cast("string"))
    return sheets.table_rows(tables(x)).select("block_id", "row_index", sheets.row_text(label, F.col("row")).alias("text"))


@query(
    f"""with {_T}, {_RW}, {_KV}, h as (select block_id, string_agg(k, ', ' order by col) as c, count(*) as w from kv where row_index = 0 group by 1), n as (select block_id, count(*) as n from rw group by 1),
    s as (select block_id, row_index, string_agg(v, ', ' order by col) as line from kv where row_index < 5 and col < 5 group by 1, 2), ss as (select block_id, string_agg(line, chr(10) order by row_index) as body from s group by 1)
    select block_id, 'columns: ' || c || chr(10) || 'rows: ' || n || chr(10) || body as text from h join n using (block_id) join ss using (block_id)"""
)
def table_meta_text(x):
    """Columns, number of rows, and up to five rows of five columns."""
    few = F.transform(F.slice("rows", 1, 5), lambda r: F.array_join(F.slice(F.map_values(r), 1, 5), ", "))
    text = F.concat(F.lit("columns: "), F.array_join(sheets.headers(F.col("rows")), ", "), F.lit("\nrows: "), F.size("rows").cast("string"), F.lit("\n"), F.array_join(few, "\n"))
    return tables(x).select("block_id", text.alias("text"))


@query(
    f"""with {_T}, {_RW}, {_KV}, h as (select block_id, '| ' || string_agg(k, ' | ' order by col) || ' |' || chr(10) || '| ' || string_agg('---', ' | ' order by col) || ' |' as head from kv where row_index = 0 group by 1),
    l as (select block_id, row_index, '| ' || string_agg(v, ' | ' order by col) || ' |' as line from kv group by 1, 2) select block_id, any_value(head) || chr(10) || string_agg(line, chr(10) order by row_index) as markdown from l join h using (block_id) group by 1"""
)
def markdown_table(x):
    return tables(x).select("block_id", sheets.markdown(F.col("rows")).alias("markdown"))


@query(f"with {_T}, {_RW}, {_KV}, l as (select block_id, row_index, string_agg(v, '|' order by col) as row_values from kv group by 1, 2) select block_id, cast(row_index as integer) as row_index, row_values from l where row_index < 5")
def table_sample_rows(x):
    rows = sheets.table_rows(tables(x)).filter("row_index < 5")
    return rows.select("block_id", "row_index", F.array_join(F.map_values("row"), "|").alias("row_values"))


@query(
    f"""with {_T}, {_RW}, {_KV}, x as (select block_id, row_index, 'T' || block_id || ': ' || string_agg(k || '=' || v, ', ' order by col) as text, string_agg(k, '|' order by col) as keywords from kv where trim(v) <> '' group by 1, 2)
    select x.block_id, cast(x.row_index as integer) as row_index, x.text, coalesce(s.section_path, 'T' || x.block_id) as section_path from x join t using (block_id) left join parser_sections s on s.id = t.section_id"""
)
def table_index(x):
    """Every table row as a proposition, with its section's path or the table's label."""
    label = F.concat(F.lit("T"), F.col("block_id").cast("string"))
    t = tables(x)
    filled = F.exists(F.map_values("row"), lambda v: F.trim(v) != "")
    rows = t.select("block_id", "section_id", F.posexplode("rows").alias("row_index", "row")).filter(filled)
    s = x.parser_sections.select(F.col("id").alias("section_id"), "section_path")
    return rows.join(s, "section_id", "left").select("block_id", "row_index", sheets.row_text(label, F.col("row")).alias("text"), F.coalesce("section_path", label).alias("section_path"))
