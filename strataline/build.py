"""Building and refreshing an index of repositories: walk, hashes, difference, extraction of what changed, edges, vectors, snapshot.

A store is a folder of Parquet tables, each partitioned by repo_id; a build rewrites the partitions of the repositories it was given and leaves the rest alone. Ids are
63-bit hashes of what identifies a row, so that a task run twice, or a full rebuild, gives the same ids as an incremental one; a collision is
looked for and raises.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataline.functions.text import embedding_text, indexed_parts, is_test_file, version_id
from strataline.operators.incremental import diff_manifest
from strataline.operators.relations import bind_literals, precise_edges, resolve_calls
from strataline.operators.vector import hashed as hashed_vectors
from strataline.operators.vector import size_warning
from strataline.session import _file_system, materialize
from strataline.sources.files import extract, hashed, walk_all, with_content
from strataline.sources.store import drop_old, write_snapshot
from strataline.sources.tables import CONTENT_VERSION, SCHEMAS, conform

#: Tables of a store beside SCHEMAS of the same names: what calls were found, so that edges can be resolved anew, and the vectors.
OWN = {
    "calls": "file_id long, caller_name string, callee_name string, line int",
    "vectors": "vec_id long, embedding array<double>",
    "state": "path string, hash string, mtime double, content_version int, built_at timestamp",
}
TABLES = ["files", "symbols", "chunks", "edges", "string_literals", "calls", "vectors", "state"]


def _id(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 63) - 1))


def _schema(name: str) -> str:
    own = OWN.get(name) or ", ".join(f for f in SCHEMAS[name].split(", ") if not f.startswith("repo_id "))
    return own + ", repo_id string"


def read(spark: SparkSession, store: str, name: str, repo_id: str | None = None) -> DataFrame:
    """One table of a store, of one repository if it is named (other partitions aren't read). A table that was never written is empty."""
    hp, fs = _file_system(spark, f"{store}/{name}")
    if not fs.exists(hp):
        return spark.createDataFrame([], _schema(name))
    df = spark.read.schema(_schema(name)).parquet(f"{store}/{name}")
    return df if repo_id is None else df.where(F.col("repo_id") == repo_id)


def clear(spark: SparkSession, store: str, repo_id: str) -> None:
    """Forget one repository: its partitions of every table."""
    for t in TABLES:
        hp, fs = _file_system(spark, f"{store}/{t}/repo_id={repo_id}")
        fs.delete(hp, True)


def repositories(spark: SparkSession, store: str) -> DataFrame:
    """(repo_id, n_files, built_at) of what a store holds."""
    return read(spark, store, "state").groupBy("repo_id").agg(F.count("*").alias("n_files"), F.max("built_at").alias("built_at")).orderBy("repo_id")


def _edges(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Call edges within each repository: names are taken apart by repository, so that a name means its own repository's symbols."""

    def scoped(c: str) -> Column:
        return F.concat("repo_id", F.lit("\n"), F.col(c))

    s = symbols.select("id", "file_id", scoped("name").alias("name"))
    c = calls.select("file_id", scoped("caller_name").alias("caller_name"), scoped("callee_name").alias("callee_name")).distinct()
    e = resolve_calls(c, s)
    repo, name = F.substring_index("dst_name", "\n", 1), F.expr("substring(dst_name, instr(dst_name, '\n') + 1)")
    return e.select("src_symbol_id", "dst_symbol_id", name.alias("dst_name"), F.lit("calls").alias("kind"), F.lit("heuristic").alias("resolution"), repo.alias("repo_id"))


def _unique(df: DataFrame, what: str) -> None:
    twice = df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise RuntimeError(f"two {what} have one id")


def build(spark: SparkSession, roots: list[tuple[str, str]], store: str, force: bool = False, built_at: datetime | None = None, resolved: DataFrame | None = None, ignore_dirs: tuple[str, ...] = (), extensions: tuple[str, ...] = (), snapshots: str | None = None) -> DataFrame:
    """(repo_id, n_total, n_changed, n_added, n_unchanged, n_deleted, n_symbols, n_vectors, warning): brings a store in step with repositories on disk.

    roots: (repo_id, folder on a file system all workers reach). Only files whose hash is new are parsed; a repository stored in another CONTENT_VERSION, or with force, is
    built from nothing. Edges are resolved anew from all stored calls, as a new symbol may answer an old call. resolved: precise calls (repo_id, path, caller_name, callee_name,
    target_path, target_line), added beside the others. snapshots: where to keep each build's graph, the last two of a repository; none for an empty graph, nor
    again for the same built_at. Folders without files give counts of 0.
    """
    now = built_at or datetime.now(timezone.utc).replace(microsecond=0)
    repos = spark.createDataFrame(roots, "repo_id string, root string")
    content = with_content(walk_all(repos, ignore_dirs, extensions))
    listed, _ = materialize(hashed(content).drop("content"), "listed")  # narrow; the texts of changed files are read again
    prior = read(spark, store, "state").join(repos.select("repo_id"), "repo_id", "left_semi")
    known = prior.where(F.col("content_version") == CONTENT_VERSION) if not force else prior.limit(0)
    diff, _ = materialize(diff_manifest(listed, known), "diff")
    todo = listed.join(diff.where("status in ('changed', 'added')").select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    keep = diff.where("status = 'unchanged'").select(_id(F.col("repo_id"), F.col("path")).alias("file_id"))

    text = with_content(todo.join(repos, "repo_id").select("repo_id", "root", "path", "ext", "n_bytes", "mtime"))
    parsed = extract(text).withColumn("file_id", _id(F.col("repo_id"), F.col("path")))
    nth = F.row_number().over(Window.partitionBy("file_id", "kind", "name", "start_byte", "end_byte").orderBy("signature"))
    parsed, _ = materialize(parsed.withColumn("id", _id(F.col("file_id"), F.col("kind"), F.col("name"), F.col("start_byte"), F.col("end_byte"), nth)), "parsed")

    def stays(name: str, by: str) -> DataFrame:
        """The stored rows of files that didn't change."""
        t = read(spark, store, name).join(repos.select("repo_id"), "repo_id", "left_semi")
        if by == "file":
            return t.join(keep, "file_id", "left_semi") if "file_id" in t.columns else t.join(keep.withColumnRenamed("file_id", "id"), "id", "left_semi")
        own = read(spark, store, "symbols").join(keep, "file_id", "left_semi").select(F.col("id").alias(by))
        return t.join(own, by, "left_semi")

    def shaped(df: DataFrame, name: str) -> DataFrame:
        return conform(df, name).withColumn("repo_id", df["repo_id"]) if name in SCHEMAS and "repo_id" not in SCHEMAS[name] else conform(df, name)

    new = {}
    files = todo.select(_id(F.col("repo_id"), F.col("path")).alias("id"), "path", "hash", "mtime", "ext", is_test_file(F.col("path")).alias("is_test"), "repo_id")
    new["files"] = stays("files", "file").unionByName(files.select(*read(spark, store, "files").columns))
    symbols = parsed.select("id", "file_id", "name", "kind", "start_line", "end_line", "start_byte", "end_byte", "signature", "repo_id")
    new["symbols"], _ = materialize(stays("symbols", "file").unionByName(symbols), "symbols")
    chunks = parsed.select(F.col("id").alias("symbol_id"), "code", "summary", indexed_parts(F.col("code"), F.col("summary")).alias("parts"), "repo_id")
    new["chunks"] = stays("chunks", "symbol_id").unionByName(chunks)
    calls = parsed.where("name is not null").select("file_id", F.col("name").alias("caller_name"), F.explode(F.arrays_zip("calls", "call_lines")).alias("c"), "repo_id").select("file_id", "caller_name", F.col("c.calls").alias("callee_name"), F.col("c.call_lines").alias("line"), "repo_id")
    new["calls"], _ = materialize(stays("calls", "file").unionByName(calls), "calls")
    lits = parsed.select("file_id", "repo_id", F.explode("literals").alias("l")).select("file_id", "repo_id", "l.*")
    bound = bind_literals(lits.drop("repo_id"), symbols).join(todo.select(_id(F.col("repo_id"), F.col("path")).alias("file_id"), "repo_id"), "file_id")
    bound = bound.withColumn("id", _id(F.col("symbol_id"), F.col("key"), F.col("store"), F.col("action"), F.col("line"), F.row_number().over(Window.partitionBy("symbol_id", "key", "store", "action", "line").orderBy("file_id"))))
    new["string_literals"] = stays("string_literals", "file").unionByName(bound.select(*read(spark, store, "string_literals").columns))
    edges = _edges(new["calls"], new["symbols"])
    if resolved is not None:
        r = resolved.select(_id(F.col("repo_id"), F.col("path")).alias("file_id"), "caller_name", "callee_name", F.concat("repo_id", F.lit("\n"), F.col("target_path")).alias("target_path"), "target_line")
        p = precise_edges(r, new["symbols"], new["files"].select("id", F.concat("repo_id", F.lit("\n"), F.col("path")).alias("path")))
        edges = edges.unionByName(p.join(new["symbols"].select(F.col("id").alias("src_symbol_id"), "repo_id"), "src_symbol_id").select(*edges.columns))
    again = F.row_number().over(Window.partitionBy("src_symbol_id", "dst_symbol_id", "dst_name", "resolution").orderBy("kind"))
    new["edges"] = edges.withColumn("id", _id(F.col("src_symbol_id"), F.coalesce("dst_symbol_id", F.lit(-1)), F.col("dst_name"), F.col("resolution"), again)).select("id", "src_symbol_id", "dst_symbol_id", "dst_name", "kind", "resolution", "repo_id")
    about = parsed.select("id", embedding_text(F.col("kind"), F.col("name"), F.col("path"), F.col("signature"), F.col("summary")).alias("t"), "repo_id")
    vec = hashed_vectors(about, "id", "t").join(about.select("id", "repo_id"), "id").select(F.col("id").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "repo_id")
    new["vectors"] = stays("vectors", "vec_id").unionByName(vec)
    new["state"] = listed.select("path", "hash", "mtime", F.lit(CONTENT_VERSION).alias("content_version"), F.lit(now).cast("timestamp").alias("built_at"), "repo_id")

    # everything is worked out and written aside before a partition is touched
    ready = {t: materialize(new[t].select(*read(spark, store, t).columns), t)[0] for t in TABLES}
    _unique(ready["files"], "files")
    _unique(ready["symbols"], "symbols")
    for r, _ in roots:
        clear(spark, store, r)
    for t in TABLES:
        ready[t].repartition("repo_id", _id(*[F.col(c) for c in ready[t].columns if c in ("path", "id", "symbol_id", "vec_id", "line")]) % 8).write.mode("append").partitionBy("repo_id").parquet(f"{store}/{t}")

    if snapshots:
        _snapshot(spark, ready, snapshots, now)
    counts = diff.groupBy("repo_id").pivot("status", ["changed", "added", "unchanged", "deleted"]).count()
    n_s = ready["symbols"].groupBy("repo_id").agg(F.count("*").alias("n_symbols"))
    n_v = ready["vectors"].groupBy("repo_id").agg(F.count("*").alias("n_vectors"))
    warn = size_warning(ready["vectors"].count())
    j = repos.select("repo_id").join(counts, "repo_id", "left").join(n_s, "repo_id", "left").join(n_v, "repo_id", "left").na.fill(0)
    return j.select("repo_id", (F.col("changed") + F.col("added") + F.col("unchanged")).alias("n_total"), *[F.col(c).alias(f"n_{c}") for c in ("changed", "added", "unchanged", "deleted")], "n_symbols", "n_vectors", F.lit(warn).cast("string").alias("warning"))


def _snapshot(spark: SparkSession, ready: dict[str, DataFrame], path: str, now: datetime) -> None:
    """Each repository's graph as a version of its build time: nothing for empty graphs, the last two stay. The same time writes the same version again, which changes nothing."""
    v = version_id(F.lit(now).cast("timestamp"))
    some = ready["symbols"].select("repo_id").distinct()
    for t, columns in (("files", ["path", "ext", "is_test"]), ("symbols", ["id", "file_id", "name", "kind", "start_line", "end_line", "signature"]), ("edges", ["src_symbol_id", "dst_symbol_id", "resolution"])):
        df = ready[t].join(some, "repo_id", "left_semi")
        df = df.where("dst_symbol_id is not null") if t == "edges" else df
        write_snapshot(df.select(*columns, "repo_id", v.alias("version_id")), f"{path}/{t}")
        if not df.isEmpty():
            drop_old(spark, f"{path}/{t}")


def refresh(spark: SparkSession, store: str, snapshots: str, live: list[str] | None = None) -> DataFrame:
    """(repo_id, created): snapshots of the stored builds that aren't recorded yet; repositories that are gone (not in live, where it is given) lose theirs."""
    state = read(spark, store, "state").groupBy("repo_id").agg(F.max("built_at").alias("built_at"))
    state = state.withColumn("version_id", version_id(F.col("built_at")))
    hp, fs = _file_system(spark, f"{snapshots}/symbols")
    from strataline.sources.store import catalog

    have = catalog(spark, f"{snapshots}/symbols") if fs.exists(hp) else spark.createDataFrame([], "repo_id string, version_id string")
    due = state.join(have, ["repo_id", "version_id"], "left_anti").select("repo_id", "built_at").collect()  # one row a repository
    for r in due:
        _snapshot(spark, {t: read(spark, store, t, r.repo_id) for t in ("files", "symbols", "edges")}, snapshots, r.built_at.replace(tzinfo=timezone.utc) if r.built_at.tzinfo is None else r.built_at)
    for r in have.select("repo_id").distinct().collect() if live is not None else []:
        if r.repo_id not in live:
            for t in ("files", "symbols", "edges"):
                hp, fs = _file_system(spark, f"{snapshots}/{t}/repo_id={r.repo_id}")
                fs.delete(hp, True)
    made = {r.repo_id for r in due}
    return state.select("repo_id", F.col("repo_id").isin(sorted(made)).alias("created")) if made else state.select("repo_id", F.lit(False).alias("created"))
