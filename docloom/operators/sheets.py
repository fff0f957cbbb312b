"""Tables inside documents: rows, cells, regions, headers and their renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS = "array<map<string,string>>"


def parsed_tables(blocks: DataFrame) -> DataFrame:
    """(block_id, document_id, section_id, seq, rows) of the table blocks that hold rows."""
    rows = F.from_json("table_json", ROWS)
    t = blocks.filter("block_type = 'table' and table_json is not null").select(F.col("id").alias("block_id"), "document_id", "section_id", "seq", rows.alias("rows"))
    return t.filter(F.size("rows") > 0)


def headers(rows: Column) -> Column:
    return F.map_keys(rows[0])


def table_rows(tables: DataFrame) -> DataFrame:
    """(block_id, row_index, row): one row a table row, from 0."""
    return tables.select("block_id", F.posexplode("rows").alias("row_index", "row"))


def row_text(label: Column, row: Column) -> Column:
    """``label: k=v, ...`` of the cells that are not blank."""
    cells = F.filter(F.map_entries(row), lambda e: F.trim(F.coalesce(e["value"], F.lit(""))) != "")
    return F.concat(label, F.lit(": "), F.array_join(F.transform(cells, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", "))


def markdown(rows: Column) -> Column:
    line = lambda xs: F.concat(F.lit("| "), F.array_join(xs, " | "), F.lit(" |"))
    head = headers(rows)
    return F.concat_ws("\n", line(head), line(F.transform(head, lambda _: F.lit("---"))), F.array_join(F.transform(rows, lambda r: line(F.map_values(r))), "\n"))


def cells(tables: DataFrame) -> DataFrame:
    """(block_id, row, col, value): the grid, header in row 0, from the rows of each table."""
    head = tables.select("block_id", F.lit(0).alias("row"), F.posexplode(headers(F.col("rows"))).alias("col", "value"))
    body = tables.select("block_id", F.posexplode("rows").alias("i", "r")).select("block_id", (F.col("i") + 1).alias("row"), F.posexplode(F.map_values("r")).alias("col", "value"))
    return head.unionByName(body)


def regions(grid: DataFrame) -> DataFrame:
    """(block_id, first_row, last_row): maximal runs of rows with a filled cell."""
    full = grid.filter(F.trim("value") != "").select("block_id", "row").distinct()
    island = F.col("row") - F.row_number().over(Window.partitionBy("block_id").orderBy("row"))
    return full.withColumn("island", island).groupBy("block_id", "island").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row")).drop("island")


def header_depth(grid: DataFrame) -> DataFrame:
    """(block_id, depth): leading rows whose filled cells are all words; at least 1."""
    number = F.col("value").rlike(r"^-?\d+(\.\d+)?$")
    by_row = grid.groupBy("block_id", "row").agg(F.max(F.when(number & (F.trim("value") != ""), 1).otherwise(0)).alias("has_number"))
    before = F.sum("has_number").over(Window.partitionBy("block_id").orderBy("row"))
    return by_row.withColumn("before", before).groupBy("block_id").agg(F.greatest(F.count_if(F.col("before") == 0), F.lit(1)).cast("bigint").alias("depth"))


def flat_headers(grid: DataFrame, depth: int = 2, depths: DataFrame | None = None) -> DataFrame:
    """(block_id, col, header): the first ``depth`` rows, or those that ``depths`` (block_id, depth) gives each table, joined by points, blank ones named, repeated ones numbered."""
    head = grid.filter(F.col("row") < depth) if depths is None else grid.join(depths, "block_id").filter("row < depth")
    parts = F.array_sort(F.collect_list(F.when(F.trim("value") != "", F.struct("row", F.trim("value").alias("v")))))
    joined = head.groupBy("block_id", "col").agg(F.array_join(F.transform(parts, lambda x: x["v"]), ".").alias("h"))
    named = joined.withColumn("h", F.when(F.col("h") == "", F.concat(F.lit("col"), F.col("col").cast("string"))).otherwise(F.col("h")))
    again = F.row_number().over(Window.partitionBy("block_id", "h").orderBy("col")) - 1
    return named.withColumn("n", again).select("block_id", "col", F.when(F.col("n") > 0, F.concat("h", F.lit("_"), F.col("n").cast("string"))).otherwise(F.col("h")).alias("header"))


def region_rows(grid: DataFrame, merges: DataFrame) -> DataFrame:
    """(block_id, first_row, row_index, row): the rows of every table region of sheets as maps, header to text.

    Merged cells are filled, blank rows part regions, each region's leading rows of
    words are its header; cells that a sheet leaves out are blank. A region of header
    rows alone gives no row. ``grid`` has (block_id, row, col, value), one block a sheet.
    """
    full = expand_merged(grid, merges)
    span = regions(full)
    # regions of a sheet part its rows, so each cell meets one
    cell = full.join(span, "block_id").filter(F.col("row").between(F.col("first_row"), F.col("last_row")))
    cell = cell.select(F.struct("block_id", "first_row").alias("block_id"), (F.col("row") - F.col("first_row")).alias("row"), "col", "value")
    depths = header_depth(cell)
    names = flat_headers(cell, depths=depths)
    head = names.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("col", "header"))).alias("head"))
    body = cell.join(depths, "block_id").filter("row >= depth").withColumn("i", F.col("row") - F.col("depth"))
    values = body.groupBy("block_id", "i").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("v"))
    entries = F.transform("head", lambda h: F.struct(h["header"].alias("key"), F.coalesce(F.col("v")[h["col"]], F.lit("")).alias("value")))
    return values.join(head, "block_id").select("block_id.block_id", "block_id.first_row", F.col("i").cast("int").alias("row_index"), F.map_from_entries(entries).alias("row"))


def expand_merged(grid: DataFrame, merges: DataFrame) -> DataFrame:
    """(block_id, row, col, value): cells of a merged range take its top left value.

    ``merges`` has (block_id, row_from, row_to, col_from, col_to); ranges meet
    cells by table first, so the range condition is tested inside a table only.
    """
    inside = F.col("row").between(F.col("row_from"), F.col("row_to")) & F.col("col").between(F.col("col_from"), F.col("col_to"))
    hit = grid.join(merges, "block_id", "left").withColumn("inside", F.coalesce(inside, F.lit(False)))
    cell = hit.groupBy("block_id", "row", "col", "value").agg(F.min(F.when(F.col("inside"), F.struct("row_from", "col_from"))).alias("m"))
    corner = grid.select("block_id", F.col("row").alias("row_from"), F.col("col").alias("col_from"), F.col("value").alias("corner"))
    cell = cell.withColumn("row_from", F.col("m.row_from")).withColumn("col_from", F.col("m.col_from"))
    return cell.join(corner, ["block_id", "row_from", "col_from"], "left").select("block_id", "row", "col", F.coalesce("corner", "value").alias("value"))


def cell_search(tables: DataFrame, sheet: Column, header: str) -> DataFrame:
    """(block_id, sheet_name, row_index, header, value) of the columns whose header contains ``header`` in any case.

    ``tables`` has (block_id, sheet_name, rows); the headers are those of the first
    row. Tables are told by sheet and headers before their rows are opened.
    """
    wanted = F.filter(headers(F.col("rows")), lambda h: h.ilike(f"%{header}%"))
    kept = tables.filter(sheet).withColumn("wanted", wanted).filter(F.size("wanted") > 0)
    rows = kept.select("block_id", "sheet_name", "wanted", F.posexplode("rows").alias("row_index", "row"))
    cells = rows.select("block_id", "sheet_name", "row_index", "row", F.explode("wanted").alias("header"))
    return cells.filter(F.map_contains_key("row", F.col("header"))).select("block_id", "sheet_name", "row_index", "header", F.col("row")[F.col("header")].alias("value"))
