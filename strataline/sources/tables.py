"""Schemas of the index tables and readers that prune to the columns asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "files": "id long, path string, hash string, mtime double, ext string, is_test boolean, repo_id string",
    "symbols": "id long, file_id long, name string, kind string, start_line int, end_line int, start_byte int, end_byte int, signature string",
    "edges": "id long, src_symbol_id long, dst_symbol_id long, dst_name string, kind string, resolution string",
    "chunks": "symbol_id long, code string, summary string, parts string",
    "string_literals": "id long, symbol_id long, file_id long, key string, store string, action string, line int",
    "manifest": "repo_id string, version_id string, path string, hash string, mtime double, built_at timestamp, content_version int, ingested_at timestamp",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, repo_id string, created_at timestamp",
    "mix_targets": "source string, target_share double, max_repeats int",
    "common_words": "lang string, word string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One stored table as delivered, repeats included."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unique(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The chosen columns of a table with repeated deliveries removed by its id (ids are unique apart from those).

    Only for narrow columns: the rows are shuffled once on the id.
    """
    df = table(spark, sf_dir, name)
    key = {"chunks": "symbol_id", "documents": "doc_id"}.get(name, "id")
    cols = [key, *[c for c in columns if c != key]] if columns else df.columns
    return df.select(*cols).dropDuplicates([key])


#: The shape of what a build stores; a store of another number is rebuilt once.
CONTENT_VERSION = 3


def conform(df: DataFrame, name: str) -> DataFrame:
    """df in the current schema of a table: columns it lacks are added as null, is_test and parts worked out where they are missing or null, types cast, others dropped."""
    from strataline.functions.text import indexed_parts, is_test_file

    fields = [f.strip().split(" ") for f in SCHEMAS[name].split(",")]
    have = set(df.columns)
    out = []
    for column, kind in fields:
        c = F.col(column).cast(kind) if column in have else F.lit(None).cast(kind)
        if name == "files" and column == "is_test" and "path" in have:
            c = F.coalesce(c, is_test_file(F.col("path")))
        if name == "chunks" and column == "parts" and "code" in have:
            c = F.coalesce(c, indexed_parts(F.col("code"), F.col("summary") if "summary" in have else F.lit(None).cast("string")))
        out.append(c.alias(column))
    return df.select(*out)


def exists(df: DataFrame) -> bool:
    """Whether there is any row; reads no more than it takes to find one."""
    return not df.isEmpty()


def newest(candidates: DataFrame, key: str, value: str, built_at: str) -> DataFrame:
    """(key, value): of several candidates of a key the one built last, ties to the greatest value; unknown times lose."""
    return candidates.groupBy(key).agg(F.max_by(value, F.struct(F.coalesce(F.col(built_at), F.lit("1970-01-01").cast("timestamp")), value)).alias(value))
