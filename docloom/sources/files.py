"""Files as typed blocks: Markdown, text, CSV, spreadsheets; other formats go through a parser function."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.text import EXTENSIONS, extension, object_key
from docloom.operators import sheets

BLOCKS = "document_id string, source_path string, block_type string, content string, page int, sheet_name string, seq int"


def files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, content, document_id, extension, supported): the id is the content's digest. Files without bytes give no row."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    ext = extension(F.col("path"))
    return raw.select("path", "content", F.md5("content").alias("document_id"), ext.alias("extension"), ext.isin(list(EXTENSIONS) + [".txt"]).alias("supported"))


def prepared(df: DataFrame, prefix: str = "raw", convert: Callable[[str, bytes], tuple[str, bytes]] | None = None) -> DataFrame:
    """(document_id, path, content, extension, supported, converted, object_key) of the supported files, ready to be stored and parsed.

    ``convert(path, content)`` turns a format that needs conversion into (extension,
    content); without it such files are left out. The key is that of the object store, by
    the day of this run, the file's name and the digest of the name.
    """
    needing = [k for k, v in EXTENSIONS.items() if v[0]]
    key = object_key(prefix, F.current_timestamp(), F.col("path")).alias("object_key")
    plain = df.filter("supported").filter(~F.col("extension").isin(needing)).withColumn("converted", F.lit(False))
    if convert is not None:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                got = [convert(p, c) for p, c in zip(pdf.path, pdf.content)]
                yield pdf.assign(extension=[e for e, _ in got], content=[c for _, c in got])

        done = df.filter(F.col("extension").isin(needing)).select("path", "content", "document_id", "extension", "supported").mapInPandas(run, "path string, content binary, document_id string, extension string, supported boolean")
        plain = plain.unionByName(done.withColumn("converted", F.lit(True)))
    return plain.select("document_id", "path", "content", "extension", "supported", "converted", key)


def csv_rows(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(row): every row of CSV files as a map from header to text; blank cells are empty strings."""
    raw = spark.read.option("header", True).option("encoding", encoding).option("nullValue", None).option("emptyValue", "").csv(path)
    return raw.select(F.map_from_arrays(F.array(*[F.lit(c) for c in raw.columns]), F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in raw.columns])).alias("row"))


def _at(ref: str) -> tuple[int, int] | None:
    m = re.match(r"([A-Z]+)(\d+)$", ref)
    if not m:
        return None
    col = 0
    for ch in m.group(1):
        col = col * 26 + ord(ch) - 64
    return int(m.group(2)) - 1, col - 1


def sheet_cells(content: bytes) -> Iterator[tuple[str, int, int, str | None, int | None, int | None]]:
    """(sheet, row, column, value, None, None) of an XLSX file's cells, from its own XML, and (sheet, row, column, None, last row, last column) of its merged ranges."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        for name in sorted(n for n in names if re.match(r"xl/worksheets/sheet\d+\.xml$", n)):
            root, sheet = ElementTree.fromstring(z.read(name)), name.rsplit("/", 1)[-1][:-4]
            for m in root.iter(f"{{{ns['m']}}}mergeCell"):
                a, b = (_at(x) for x in (m.get("ref", "") + ":").split(":")[:2])
                if a and b:
                    yield sheet, *a, None, *b
            for c in root.iter(f"{{{ns['m']}}}c"):
                at = _at(c.get("r", ""))
                v, inline = c.find("m:v", ns), c.find("m:is", ns)
                value = "".join(t.text or "" for t in inline.iter(f"{{{ns['m']}}}t")) if inline is not None else (v.text or "") if v is not None else ""
                if at and value:
                    yield sheet, *at, shared[int(value)] if c.get("t") == "s" else value, None, None


def decoded(content: bytes) -> str:
    """UTF-8 with or without a mark, else the usual Korean code page, else with replaced bytes."""
    for code in ("utf-8-sig", "cp949"):
        try:
            return content.decode(code)
        except UnicodeDecodeError:
            pass
    return content.decode("utf-8", "replace")


def sheet_rows(df: DataFrame) -> DataFrame:
    """(document_id, source_path, sheet_name, first_row, row_index, row): the rows of every table region of spreadsheet files as maps, header to text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(d, p, *c) for d, p, content in zip(pdf.document_id, pdf.path, pdf.content) for c in sheet_cells(content)]
            yield pd.DataFrame(out, columns=["document_id", "source_path", "sheet_name", "row", "col", "value", "row_to", "col_to"]).astype({"row_to": "Int64", "col_to": "Int64"})

    schema = "document_id string, source_path string, sheet_name string, row int, col int, value string, row_to int, col_to int"
    cells = df.filter("extension = '.xlsx'").select("document_id", "path", "content").mapInPandas(run, schema)
    block = F.struct("document_id", "source_path", "sheet_name").alias("block_id")
    grid = cells.filter("value is not null").select(block, "row", "col", "value")
    merges = cells.filter("row_to is not null").select(block, F.col("row").alias("row_from"), F.col("row_to"), F.col("col").alias("col_from"), F.col("col_to"))
    # a merged cell stands for all cells of its range
    spread = merges.select("block_id", F.explode(F.sequence("row_from", "row_to")).alias("row"), "col_from", "col_to").select("block_id", "row", F.explode(F.sequence("col_from", "col_to")).alias("col"))
    blank = spread.join(grid.select("block_id", "row", "col"), ["block_id", "row", "col"], "left_anti").withColumn("value", F.lit(""))
    return sheets.region_rows(grid.unionByName(blank), merges).select("block_id.document_id", "block_id.source_path", "block_id.sheet_name", "first_row", "row_index", "row")


def blocks(df: DataFrame, others: Callable[[str, bytes], list[tuple[str, str, int]]] | None = None) -> DataFrame:
    """One row a block of every supported file.

    Text files give one block; CSV files give a Markdown table, spreadsheets one for
    every region of a sheet, with merged cells filled and header rows joined. ``others(path, content)`` parses any other format into (type, content,
    page); without it such files give no block. Undecodable bytes are replaced.
    """

    def rows(path: str, content: bytes) -> list[tuple]:
        ext = "." + path.rsplit(".", 1)[-1].lower()
        if ext in (".md", ".txt"):
            return [("text", decoded(content), 0, None)]
        if ext == ".csv":
            t = pd.read_csv(io.StringIO(decoded(content)), dtype=str, keep_default_na=False)
            return [("table", _markdown(list(t.columns), t.values.tolist()), 0, None)]
        return [(k, c, p, None) for k, c, p in others(path, content)] if others else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(d, p, k, c, page, s, i) for d, p, content in zip(pdf.document_id, pdf.path, pdf.content) for i, (k, c, page, s) in enumerate(rows(p, content))]
            yield pd.DataFrame(out, columns=["document_id", "source_path", "block_type", "content", "page", "sheet_name", "seq"])

    plain = df.filter("supported and extension <> '.xlsx'").select("document_id", "path", "content").mapInPandas(run, BLOCKS)
    by = sheet_rows(df).groupBy("document_id", "source_path", "sheet_name", "first_row").agg(F.array_sort(F.collect_list(F.struct("row_index", F.map_entries("row").alias("e")))).alias("r"))
    text = sheets.markdown(F.transform("r", lambda x: F.map_from_entries(x["e"])))  # one region of one sheet
    number = F.row_number().over(Window.partitionBy("document_id", "source_path").orderBy("sheet_name", "first_row")) - 1
    tables = by.select("document_id", "source_path", F.lit("table").alias("block_type"), text.alias("content"), F.lit(0).alias("page"), "sheet_name", number.alias("seq"))
    return plain.unionByName(tables)


def _markdown(head: list[str], rows: list[list[str]]) -> str:
    line = lambda xs: "| " + " | ".join(str(x) for x in xs) + " |"
    return "\n".join([line(head), line(["---"] * len(head)), *[line(r) for r in rows]])
