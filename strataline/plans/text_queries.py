"""Queries of the text functions, whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions import text as T
from strataline.sources.tables import table, unique

STOP = "[" + ",".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def in_list(words: list[str]) -> str:
    return "(" + ",".join(f"'{w}'" for w in words) + ")"


def sql_split(x: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda z: z <> '')"


def sql_stem(x: str) -> str:
    return f"CASE WHEN length({x}) > 3 AND {x} LIKE '%s' AND {x} NOT LIKE '%ss' THEN left({x}, length({x}) - 1) ELSE {x} END"


def sql_distinct(x: str) -> str:
    """First occurrences in order."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def sql_base(x: str) -> str:
    return f"regexp_replace(replace(coalesce({x}, ''), '\\', '/'), '\\.[A-Za-z0-9]+$', '')"


def sql_path_tokens(x: str) -> str:
    words = f"list_transform(list_filter(list_transform(flatten(list_transform(string_split({sql_base(x)}, '/'), lambda s: {sql_split('s')})), lambda w: lower(w)), lambda w: length(w) >= 3), lambda w: {sql_stem('w')})"
    return f"list_distinct({words})"


def sql_terms(x: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains({STOP}, w)), lambda w: {sql_stem('w')})"


U_SYM = "(SELECT DISTINCT * FROM symbols)"
U_FILES = "(SELECT DISTINCT * FROM files)"
U_CHUNKS = "(SELECT DISTINCT * FROM chunks)"
U_EDGES = "(SELECT DISTINCT * FROM edges)"
U_LIT = "(SELECT DISTINCT * FROM string_literals)"
U_DOCS = "(SELECT DISTINCT * FROM documents)"


def split_identifiers(spark: SparkSession, d: str) -> DataFrame:
    s = unique(spark, d, "symbols", "name")
    return s.select("id", F.array_join(T.split_identifier(F.col("name")), " ").alias("pieces"), F.array_join(T.indexable_parts(F.col("name")), " ").alias("parts"), T.is_compound(F.col("name")).alias("compound"))


def chunk_parts(spark: SparkSession, d: str) -> DataFrame:
    c = unique(spark, d, "chunks", "code", "summary")
    return c.select("symbol_id", F.trim(F.concat_ws(" ", T.identifier_parts(F.col("code")), T.comment_words(F.col("summary")))).alias("parts"))


def terms_of_documents(spark: SparkSession, d: str) -> DataFrame:
    return unique(spark, d, "documents", "text").select("doc_id", F.array_join(F.array_sort(T.query_terms(F.col("text"))), " ").alias("terms"), F.size(T.query_terms(F.col("text"))).cast("long").alias("n_terms"))


def path_facts(spark: SparkSession, d: str) -> DataFrame:
    f = unique(spark, d, "files", "path", "ext", "repo_id")
    p = F.col("path")
    return f.select("id", F.array_join(F.array_sort(T.path_tokens(p)), " ").alias("tokens"), T.is_test_file(p).alias("is_test"), T.is_generic(T.extension(p)).alias("generic"), T.extension(p).alias("ext"), T.repo_id(F.col("repo_id")).alias("derived_repo"), T.repo_name(F.col("path"), F.col("repo_id")).alias("base_name"))


def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    s = unique(spark, d, "symbols", "file_id", "name", "kind", "signature")
    f = unique(spark, d, "files", "path").withColumnRenamed("id", "fid")
    c = unique(spark, d, "chunks", "summary")
    j = s.join(f, s["file_id"] == f["fid"]).join(c, s["id"] == c["symbol_id"], "left")
    return j.select("id", T.embedding_text(F.col("kind"), F.col("name"), F.col("path"), F.col("signature"), F.trim(F.col("summary"))).alias("text"))


def version_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "manifest").where("built_at is not null").select("repo_id", T.version_id(F.col("built_at")).alias("version_id")).distinct()


def query_shapes(spark: SparkSession, d: str) -> DataFrame:
    s = unique(spark, d, "symbols", "name").select("id", T.query_shape(F.col("name")).alias("q"), T.cache_key(F.col("name")).alias("cache_key"))
    return s.select("id", "q.lexical_first", "q.reason", "q.name_search", "q.inner", F.size("q.tokens").cast("long").alias("n_tokens"), "cache_key")


def weights(spark: SparkSession, d: str) -> DataFrame:
    s = unique(spark, d, "symbols", "file_id", "kind")
    f = unique(spark, d, "files", "path").withColumnRenamed("id", "fid")
    j = s.join(f, s["file_id"] == f["fid"], "left")
    k, p = F.col("kind"), F.col("path")
    return j.select("id", F.round(T.rank_weight(k, p, F.lit(False)), 6).alias("weight"), F.round(T.rank_weight(k, p, F.lit(True)), 6).alias("weight_tests"), F.round(T.context_weight(k, p), 6).alias("context_weight"))


def doc_test_intent(spark: SparkSession, d: str) -> DataFrame:
    return unique(spark, d, "documents", "text").select("doc_id", F.coalesce(F.col("text").rlike(T.TEST_INTENT), F.lit(False)).alias("test_intent"))


def signatures(spark: SparkSession, d: str) -> DataFrame:
    """Signature, capped body and first line that says something of each chunk."""
    c = F.coalesce("code", F.lit(""))
    lines = F.split(c, "\n")
    some = F.filter(lines, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")
    return unique(spark, d, "chunks", "code").select("symbol_id", F.trim(F.element_at(F.split(F.left(c, F.lit(160)), "\n"), 1)).alias("signature"), F.length(F.left(c, F.lit(20000))).cast("long").alias("n_body"), F.left(F.trim(F.coalesce(F.get(some, F.lit(0)), F.lit(""))), F.lit(160)).alias("first_line"), F.size(lines).cast("long").alias("n_lines"))


def storage_calls(spark: SparkSession, d: str) -> DataFrame:
    """Browser-storage keys in code with their store, action and line."""
    s = unique(spark, d, "symbols", "kind").where("kind = 'file'").select(F.col("id").alias("sid"))
    c = unique(spark, d, "chunks", "code").join(s, F.col("symbol_id") == F.col("sid"), "left_semi").select("symbol_id", F.posexplode(F.split("code", "\n")).alias("n", "text"))
    rx = r"\b(localStorage|sessionStorage)\.(getItem|setItem|removeItem)\(\s*['\"]([^'\"]*)['\"]"
    c = c.where(F.col("text").rlike(rx)).select("symbol_id", (F.col("n") + 1).cast("long").alias("line"), F.regexp_extract("text", rx, 1).alias("store"), F.regexp_extract("text", rx, 2).alias("call"), F.regexp_extract("text", rx, 3).alias("key"))
    return c.select("symbol_id", "line", "store", F.when(F.col("call") == "getItem", "read").when(F.col("call") == "setItem", "write").otherwise("remove").alias("action"), "key")


QUERIES = {f.__name__: f for f in (split_identifiers, chunk_parts, terms_of_documents, path_facts, embedding_texts, version_ids, query_shapes, weights, doc_test_intent, signatures, storage_calls)}

_EXT = "lower(regexp_extract({p}, '[^/.](\\.[^/.]*)$', 1))"
_RX_STORE = "\\b(localStorage|sessionStorage)\\.(getItem|setItem|removeItem)\\(\\s*[''\"]([^''\"]*)[''\"]"
_TESTRX = T.TEST_FILE


def sql_weight(kind: str, path: str, intent: bool) -> str:
    k = f"CASE WHEN {kind} IN ('test','suite') THEN 0.35 WHEN {kind} = 'hook' THEN 0.5 WHEN {kind} = 'file' THEN 0.7 ELSE 1.0 END"
    w = "1.0" if intent else f"CASE WHEN coalesce(regexp_matches({path}, '{_TESTRX}'), false) THEN least({k}, 0.35) ELSE {k} END"
    return f"({w}) * CASE WHEN {_EXT.format(p=path)} IN {in_list(T.PRESENTATION)} THEN 0.6 ELSE 1.0 END"


_RUNS = f"list_filter(list_transform(list_filter(ids, lambda w: len({sql_split('w')}) > 1), lambda w: list_transform(list_filter({sql_split('w')}, lambda p: length(p) >= 2), lambda p: lower(p))), lambda p: len(p) > 0)"
SQL = {
    "split_identifiers": f"SELECT id, array_to_string({sql_split('name')}, ' ') AS pieces, array_to_string(list_transform(list_filter({sql_split('name')}, lambda p: length(p) >= 2), lambda p: lower(p)), ' ') AS parts, len({sql_split('name')}) > 1 AS compound FROM {U_SYM}",
    "terms_of_documents": f"WITH t AS (SELECT doc_id, list_sort(list_distinct({sql_terms('text')})) w FROM {U_DOCS}) SELECT doc_id, array_to_string(w, ' ') AS terms, len(w) AS n_terms FROM t",
    "path_facts": f"SELECT id, array_to_string(list_sort({sql_path_tokens('path')}), ' ') AS tokens, regexp_matches(path, '{_TESTRX}') AS is_test, {_EXT.format(p='path')} NOT IN {in_list(T.FULL)} AS generic, {_EXT.format(p='path')} AS ext, coalesce(nullif(trim(regexp_replace(lower(repo_id), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'repo') || '-' || left(sha1(repo_id), 8) AS derived_repo, regexp_extract(path, '([^/\\\\]*)$', 1) AS base_name FROM {U_FILES}",
    "embedding_texts": f"""WITH j AS (SELECT s.id, s.kind, s.name, s.signature, trim(c.summary, ' ') doc, lower(array_to_string({sql_split('s.name')}, ' ')) w, list_filter(string_split({sql_base('f.path')}, '/'), lambda z: z <> '' AND lower(z) NOT IN {in_list(T.BORING)}) segs
  FROM {U_SYM} s JOIN {U_FILES} f ON f.id = s.file_id LEFT JOIN {U_CHUNKS} c ON c.symbol_id = s.id),
k AS (SELECT *, array_to_string(list_transform(segs[greatest(1, len(segs) - 2):len(segs)], lambda z: lower(array_to_string({sql_split('z')}, ' '))), ' / ') wh FROM j)
SELECT id, left(kind || ' ' || name || CASE WHEN w <> '' AND w <> lower(name) THEN ' (' || w || ')' ELSE '' END || CASE WHEN wh <> '' THEN ' in ' || wh ELSE '' END || ': ' || coalesce(signature, '') || CASE WHEN coalesce(doc, '') <> '' THEN ' - ' || doc ELSE '' END, 700) AS text FROM k""",
    "version_ids": "SELECT DISTINCT repo_id, strftime(built_at AT TIME ZONE 'UTC', '%Y%m%dT%H%M%SZ') AS version_id FROM manifest WHERE built_at IS NOT NULL",
    "query_shapes": """WITH a AS (SELECT id, name, trim(coalesce(name, ''), ' ') t FROM (SELECT DISTINCT * FROM symbols)),
b AS (SELECT *, length(t) > 2 AND left(t, 1) = right(t, 1) AND left(t, 1) IN ('''', '"', '`') AS q FROM a),
c AS (SELECT *, CASE WHEN q THEN trim(substr(t, 2, length(t) - 2), ' ') ELSE t END AS inner_ FROM b),
d AS (SELECT *, regexp_extract_all(inner_, '[A-Za-z0-9_$.]+') w FROM c),
e AS (SELECT *, len(w) > 0 AND len(w) <= 3 AND array_to_string(w, ' ') = regexp_replace(inner_, '\\s+', ' ', 'g') AND len(list_filter(w, lambda z: NOT regexp_matches(z, '[a-z][A-Z]|[_$.]|^[A-Z][a-z]+[A-Z]'))) = 0 AS ident FROM d)
SELECT id, len(w) > 0 AND (q OR ident) AS lexical_first, CASE WHEN len(w) > 0 AND q THEN 'quoted-literal' WHEN ident THEN 'identifier' END AS reason, CASE WHEN len(w) > 0 AND (q OR ident) THEN NOT q OR len(w) = 1 ELSE false END AS name_search, inner_ AS inner, len(w) AS n_tokens, trim(regexp_replace(name, '\\s+', ' ', 'g'), ' ') AS cache_key FROM e""",
    "weights": f"SELECT s.id, round({sql_weight('s.kind', 'f.path', False)}, 6)::DOUBLE AS weight, round({sql_weight('s.kind', 'f.path', True)}, 6)::DOUBLE AS weight_tests, round((CASE WHEN s.kind IN ('method','function') THEN 1.0 WHEN s.kind = 'class' THEN 0.95 WHEN s.kind = 'test' THEN 0.6 WHEN s.kind = 'suite' THEN 0.55 WHEN s.kind = 'hook' THEN 0.5 WHEN s.kind = 'file' THEN 0.2 ELSE 0.8 END) * (CASE WHEN {_EXT.format(p='f.path')} IN {in_list(T.PRESENTATION)} THEN 0.25 WHEN {_EXT.format(p='f.path')} <> '' AND {_EXT.format(p='f.path')} NOT IN {in_list(T.FULL)} THEN 0.6 ELSE 1.0 END), 6)::DOUBLE AS context_weight FROM {U_SYM} s LEFT JOIN {U_FILES} f ON f.id = s.file_id",
    "doc_test_intent": f"SELECT doc_id, coalesce(regexp_matches(text, '{T.TEST_INTENT}'), false) AS test_intent FROM {U_DOCS}",
    "signatures": f"WITH c AS (SELECT symbol_id, coalesce(code, '') c FROM {U_CHUNKS}) SELECT symbol_id, trim(string_split(left(c, 160), chr(10))[1], ' ') AS signature, least(length(c), 20000) AS n_body, left(trim(coalesce(list_filter(string_split(c, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'), ' ') <> '')[1], ''), ' '), 160) AS first_line, len(string_split(c, chr(10))) AS n_lines FROM c",
    "storage_calls": f"WITH l AS (SELECT c.symbol_id, unnest(range(1, len(string_split(c.code, chr(10))) + 1)) line, string_split(c.code, chr(10)) a FROM {U_CHUNKS} c JOIN (SELECT DISTINCT id FROM symbols WHERE kind = 'file') s ON s.id = c.symbol_id WHERE c.code IS NOT NULL), m AS (SELECT symbol_id, line, a[line] t FROM l) SELECT symbol_id, line, regexp_extract(t, '{_RX_STORE}', 1) AS store, CASE regexp_extract(t, '{_RX_STORE}', 2) WHEN 'getItem' THEN 'read' WHEN 'setItem' THEN 'write' ELSE 'remove' END AS action, regexp_extract(t, '{_RX_STORE}', 3) AS key FROM m WHERE regexp_matches(t, '{_RX_STORE}')",
}
