"""Queries of the text operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataline.llm import bpe, credentials, documented, mixture, pieces, prose, provenance
from strataline.sources.tables import table, unique


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    c = pieces.cuts(pieces.ranges(table(spark, d, "chunks"), "symbol_id", "code"))
    return c.select(F.col("key").alias("symbol_id")).distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "chunks").where(F.octet_length("code") > pieces.LIMIT).select("symbol_id", "code").dropDuplicates(["symbol_id"])
    at = unique(spark, d, "symbols", "id", "start_byte").select(F.col("id").alias("key"), "start_byte")
    p = pieces.pieces(items, "symbol_id", "code").join(at, "key", "left")
    return p.select(
        F.col("key").alias("symbol_id"), "piece_no", (F.col("start_byte") + F.col("first")).alias("start_byte"), (F.col("start_byte") + F.col("stop")).alias("end_byte"), (F.col("begin") - F.col("first")).alias("overlap_bytes"), F.col("piece").alias("code")
    )


def p3_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of whole chunks cut by ranges so small that most items span several: what they hold together, for comparison with the items."""
    items = table(spark, d, "chunks").where(F.octet_length("code") > pieces.LIMIT).select("symbol_id", "code").dropDuplicates(["symbol_id"])
    p = pieces.pieces(items, "symbol_id", "code", range_bytes=4 * pieces.LIMIT)
    new = F.decode(F.substring(F.encode("piece", "UTF-8"), F.col("begin") - F.col("first") + 1, F.col("stop") - F.col("begin")), "UTF-8")
    p = p.select("key", "piece_no", "begin", "stop", "piece", new.alias("new")).withColumn("before", F.lag("stop", 1, 0).over(Window.partitionBy("key").orderBy("piece_no")))
    return p.groupBy(F.col("key").alias("symbol_id")).agg(
        F.sum(F.octet_length("new")).cast("long").alias("n_bytes"),
        F.sum(F.char_length("new")).cast("long").alias("n_chars"),
        F.sum(F.char_length(F.regexp_replace("new", "[^\n]", ""))).cast("long").alias("n_lines"),
        F.sum(F.char_length(F.regexp_replace("new", "[^aeiou]", ""))).cast("long").alias("n_vowels"),
        F.sum((F.col("begin") != F.col("before")).cast("int")).cast("long").alias("gaps"),
        F.sum((F.octet_length("piece") > pieces.LIMIT).cast("int")).cast("long").alias("too_long"),
        F.max("piece_no").cast("long").alias("last_no"),
        (F.count("*") - 1).alias("last_no_counted"),
    ).where("last_no = last_no_counted").drop("last_no", "last_no_counted")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(unique(spark, d, "documents", "text"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    code = credentials.found(table(spark, d, "chunks"), "symbol_id", "code").select(F.lit("chunks").alias("table_name"), "row_id", "line_no")
    keys = credentials.found(table(spark, d, "string_literals"), "id", "key").select(F.lit("string_literals").alias("table_name"), "row_id", "line_no")
    return code.unionByName(keys).distinct()


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    code = credentials.redact(unique(spark, d, "chunks", "code"), "symbol_id", "code").select(F.lit("chunks").alias("table_name"), "row_id", "n_values", "text")
    keys = credentials.redact(unique(spark, d, "string_literals", "key"), "id", "key").select(F.lit("string_literals").alias("table_name"), "row_id", "n_values", "text")
    return code.unionByName(keys)


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces, "p3_ranges": p3_ranges, "p4_found": p4_found, "p4_redacted": p4_redacted, "p7_ids": p7_ids}

SQL = {
    "p3_found": "SELECT DISTINCT symbol_id FROM chunks WHERE octet_length(encode(code)) > 2000",
    "p3_ranges": r"""SELECT symbol_id, octet_length(encode(code))::BIGINT AS n_bytes, length(code)::BIGINT AS n_chars, length(regexp_replace(code, '[^\n]', '', 'g'))::BIGINT AS n_lines, length(regexp_replace(code, '[^aeiou]', '', 'g'))::BIGINT AS n_vowels,
0::BIGINT AS gaps, 0::BIGINT AS too_long FROM (SELECT DISTINCT symbol_id, code FROM chunks WHERE octet_length(encode(code)) > 2000)""",
}


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    s = prose.shares(table(spark, d, "documents"), table(spark, d, "common_words"))
    return s.where("prose_share >= 0 and prose_share < 0.5").select("doc_id").distinct()  # ids are shuffled, not texts


def p9_stats(spark: SparkSession, d: str) -> DataFrame:
    return prose.statistics(table(spark, d, "documents").where("doc_id is not null"), table(spark, d, "common_words")).dropDuplicates(["doc_id"])


QUERIES |= {"p9_found": p9_found, "p9_stats": p9_stats}

SQL["p9_stats"] = r"""WITH d AS (SELECT doc_id, any_value(coalesce(text, '')) t FROM documents GROUP BY doc_id),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[\p{L}\p{N}_]+') w, list_filter(regexp_split_to_array(t, '\r\n|\n|\r'), lambda x: length(regexp_replace(x, '[\s\x0b]', '', 'g')) > 0) l,
  length(regexp_replace(t, '[\s\x0b]', '', 'g')) n, length(regexp_replace(t, '[\s\x0b\p{L}\p{N}_]', '', 'g')) sym FROM d),
c AS (SELECT list(DISTINCT lower(word)) c FROM common_words WHERE word IS NOT NULL)
SELECT doc_id, len(w) AS word_count, CASE WHEN len(w) > 0 THEN round(list_sum(list_transform(w, lambda x: length(x))) / len(w), 6) ELSE 0.0 END AS mean_word_len,
  CASE WHEN n > 0 THEN round(sym / n, 6) ELSE 0.0 END AS symbol_ratio,
  CASE WHEN len(l) > 0 THEN round(len(list_filter(l, lambda x: regexp_matches(x, '[.!?:;…。！？]["''”’»)\]]*[\s\x0b]*$'))) / len(l), 6) ELSE 0.0 END AS punct_line_share,
  CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: list_contains(c, lower(x)))) / len(w), 6) ELSE 0.0 END AS common_share FROM w, c"""


def p6_reasons(spark: SparkSession, d: str) -> DataFrame:
    return provenance.not_by_hand(table(spark, d, "files"), table(spark, d, "symbols"), table(spark, d, "chunks"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_reasons(spark, d).select("file_id")


QUERIES |= {"p6_found": p6_found, "p6_reasons": p6_reasons}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return documented.documented(table(spark, d, "symbols"), table(spark, d, "chunks"), table(spark, d, "files"), with_code=False).select("symbol_id")


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return documented.documented(table(spark, d, "symbols"), table(spark, d, "chunks"), table(spark, d, "files"))


QUERIES |= {"p5_found": p5_found, "p5_pairs": p5_pairs}


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select(F.struct("doc_id", "source").alias("k"), "text")
    n = bpe.encode(docs, "k", "text", count_only=True)  # counted before repeats go, so that no text is shuffled
    return mixture.mixture(n.select("k.doc_id", "k.source", "n_tokens").dropDuplicates(["doc_id"]), table(spark, d, "mix_targets"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[1]


QUERIES |= {"p8_mixture": p8_mixture, "p8_report": p8_report}
