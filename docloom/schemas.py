"""Schemas of the catalogue's tables, and the way from an older table to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.sources import paths

# The tables that ``Engine`` writes.
ENGINE = {
    "documents": "document_id string, extension string, source_path string",
    "blocks": "document_id string, source_path string, block_type string, content string, page int, sheet_name string, seq int",
    "sections": "document_id string, section_no bigint, title string, content string, section_id bigint",
    "propositions": "document_id string, section_id bigint, title string, keywords array<string>, seq int, proposition string, v array<double>, id bigint",
}
# The catalogue tables that the queries read.
CATALOGUE = {
    "parser_documents": "document_id string, source_path string, original_ext string, doc_type string, domain_category string, minio_bucket string, minio_key string, created_at timestamp_ntz",
    "parser_sections": "id bigint, document_id string, title string, level int, section_path string, domain_category string, seq int",
    "parser_propositions": "id bigint, document_id string, section_id bigint, proposition string, keywords array<string>, seq int",
    "parser_blocks": "id bigint, document_id string, section_id bigint, block_type string, content string, page int, bbox array<double>, minio_key string, table_json string, seq int",
    "toc_nodes": "node_id bigint, document_id string, parent_id bigint, ord int, level int, title string, page int",
    "parser_job_steps": "id bigint, job_id string, step_name string, status string, result string, error string, started_at timestamp_ntz, completed_at timestamp_ntz",
}


def conformed(df: DataFrame, schema: str) -> DataFrame:
    """The columns of the schema in its types; missing ones are null, extra ones fall away."""
    have = {f.name for f in df.schema}
    kinds = StructType.fromDDL(schema)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])


def prepare(spark: SparkSession, folder: str, tables: dict[str, str] | None = None) -> list[str]:
    """Create the tables that are missing below a folder, empty; gives their names. Tables at hand stay as they are, so it may run again."""
    made = []
    for name, schema in (tables or CATALOGUE).items():
        path = f"{folder.rstrip('/')}/{name}.parquet"
        if not paths.exists(spark, path):
            spark.createDataFrame([], schema).write.parquet(path)
            made.append(name)
    return made
