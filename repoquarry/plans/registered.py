"""Queries over the driver's tables, each with the SQL it should agree with.

`documents` stand for files: a source is a repository, a text is a file's content,
and the path comes from the language and id. Every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoquarry.functions import paths, text, tokens, vector
from repoquarry.operators import approx, chunk, dedup, embed, group, render, search, select
from repoquarry.params import SOURCE_STAMP, IndexParams
from repoquarry.plans import derived, jobs, oracle
from repoquarry.plans.derived import commit_of, file_rows, repo_texts, table
from repoquarry.schemas import META_SCHEMA
from repoquarry.session import explode_all, materialise, scratch_path
from repoquarry.sources import repo_files
from repoquarry.sources.documents import as_documents
from repoquarry.sources.index_table import IndexTable
from repoquarry.sources.storage import path_exists

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_MAX_BYTES = 4000  # of the test texts, so that some files are too large
_DIM = 64  # of the indexes built here


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def big(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


# --- paths and decisions -----------------------------------------------------


@query(oracle.path_suffix_language)
def path_suffix_language(spark: SparkSession, sf: str) -> DataFrame:
    files = file_rows(spark, sf)
    return files.select(
        "repo_url",
        "rel",
        paths.suffix(F.col("rel")).alias("suffix"),
        paths.language(F.col("rel")).alias("language"),
        paths.is_notebook(F.col("rel")).alias("notebook"),
    )


@query(oracle.page_suffixes)
def page_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    path = F.regexp_replace(F.col("url"), r"[?#].*$|^[a-z]+://[^/?#]*/?", "")
    return table(spark, sf, "pages").select(
        "page_id", path.alias("path"), paths.suffix(path).alias("suffix")
    )


@query(oracle.relative_paths)
def relative_paths(spark: SparkSession, sf: str) -> DataFrame:
    full, root = F.concat(F.lit("/data/"), "repo_url", F.lit("/"), "rel"), F.lit("/data/src1/")
    return file_rows(spark, sf).select(
        full.alias("path"), paths.relative_to(full, root).alias("below_root")
    )


@query(oracle.path_ignore)
def path_ignore(spark: SparkSession, sf: str) -> DataFrame:
    rel = derived.nested_path(F.col("doc_id"), F.col("rel"))
    return file_rows(spark, sf).select(
        "doc_id", rel.alias("rel"), paths.is_ignored(rel).alias("ignored")
    )


@query(oracle.file_decisions)
def file_decisions(spark: SparkSession, sf: str) -> DataFrame:
    size = F.when(F.col("doc_id") % 97 != 0, F.col("size"))
    decided = select.decide(file_rows(spark, sf).withColumn("size", size), _MAX_BYTES)
    return decided.select("repo_url", "rel", "decision.include", "decision.reason")


@query(oracle.decision_counts)
def decision_counts(spark: SparkSession, sf: str) -> DataFrame:
    blank = F.when(F.col("lang") == "es", F.lit("  \n")).otherwise(F.col("text"))
    files = select.decide(file_rows(spark, sf), _MAX_BYTES).withColumn("text", blank)
    states = files.select(
        "repo_url",
        "commit",
        "decision.reason",
        select.file_state(F.col("decision.reason"), F.lit(None), F.col("text")).alias("state"),
    )
    return select.file_counts(states)


@query(oracle.repo_urls)
def repo_urls(spark: SparkSession, sf: str) -> DataFrame:
    urls = file_rows(spark, sf).select("doc_id", derived.url_of(F.col("doc_id")).alias("repo_url"))
    good, bad = select.split_repo_urls(urls)
    return good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))


# --- scalar functions --------------------------------------------------------


@query(oracle.human_bytes)
def human_bytes(spark: SparkSession, sf: str) -> DataFrame:
    # A double throughout: the product of large keys is beyond 64 bits.
    size = F.col("l_orderkey").cast("double") * F.col("l_partkey") * F.pow(F.lit(64), F.col("l_linenumber") - 1)
    shown = table(spark, sf, "lineitem").select(
        text.human_bytes(F.col("l_orderkey")).alias("orderkey"),
        text.human_bytes(size).alias("product"),
    )
    return shown.groupBy("orderkey", "product").agg(F.count("*").alias("n"))


@query(oracle.sanitize_strip)
def sanitize_strip(spark: SparkSession, sf: str) -> DataFrame:
    padded = F.concat(F.lit("\u00a0\t\x1c"), "text", F.lit("\x00\u2003 \x00\n\u3000"))
    return table(spark, sf, "documents").select(
        "doc_id",
        text.remove_nul(padded).alias("clean"),
        text.strip(padded).alias("stripped"),
        text.is_blank(F.lit(" \x1f ")).alias("blank"),
    )


@query(oracle.decode_text)
def decode_text(spark: SparkSession, sf: str) -> DataFrame:
    crlf = F.encode(F.replace("text", F.lit("\n"), F.lit("\r\n")), "utf-8")
    bad = F.concat(crlf, F.unhex(F.lit("0D61FF62E28263F09F98")))
    return table(spark, sf, "documents").select("doc_id", text.decode_text(bad).alias("text"))


@query(oracle.notebook_extract)
def notebook_extract(spark: SparkSession, sf: str) -> DataFrame:
    books = derived.notebooks(table(spark, sf, "documents"))
    read = text.notebook_text(F.encode("json", "utf-8"))
    return books.select("doc_id", read.alias("content"))


@query(oracle.unreadable_files)
def unreadable_files(spark: SparkSession, sf: str) -> DataFrame:
    books = derived.notebooks(table(spark, sf, "documents"))
    broken = F.when(F.col("lang") == "fr", F.concat("json", F.lit("}"))).otherwise(F.col("json"))
    files = books.select(
        "doc_id",
        F.concat(F.lit("n"), "doc_id", F.lit(".ipynb")).alias("rel"),
        F.when(F.col("lang") != "de", F.encode(broken, "utf-8")).alias("content"),
        F.when(F.col("lang") == "de", "OSError: gone").alias("error"),
    )
    return select.with_texts(files).where(F.col("error").isNotNull()).select("doc_id", "error")


@query(oracle.short_labels)
def short_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id",
        text.short_commit(commit_of(F.col("source"))).alias("commit"),
        text.or_default(F.when(F.col("lang") != "fr", ""), "Unknown").alias("unknown"),
        text.or_default(F.col("source"), "Unknown").alias("known"),
        F.initcap("lang").alias("titled"),
    )


@query(oracle.meta_json)
def meta_json(spark: SparkSession, sf: str) -> DataFrame:
    meta = F.struct(
        F.lit(SOURCE_STAMP).alias("source"),
        "repo_url",
        F.array("rel").alias("file_paths"),
        "commit",
        big("doc_id").alias("chunk_index"),
        big("size").alias("total_chunks"),
    )
    written = file_rows(spark, sf).select("doc_id", F.to_json(meta).alias("json"))
    back = F.from_json("json", META_SCHEMA)
    return written.select(
        "doc_id",
        "json",
        back["repo_url"].alias("repo_url"),
        F.element_at(back["file_paths"], 1).alias("path"),
        back["chunk_index"].alias("chunk_index"),
        back["language"].isNull().alias("no_language"),
    )


@query(oracle.local_times)
def local_times(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        F.date_format(text.local_time(F.col("ts")), "yyyy-MM-dd HH:mm:ss").alias("local_ts"),
    )


@query(oracle.token_counts)
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", big(tokens.token_count(F.col("text"))).alias("n")
    )


# --- chunkers ----------------------------------------------------------------


def _exploded(docs: DataFrame, chunks: Column, *keys: str) -> DataFrame:
    return docs.select(*keys, explode_all(chunks).alias("pos", "chunk")).withColumn(
        "pos", big("pos")
    )


@query(oracle.line_chunks)
def line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = chunk.line_windows(F.col("text"), 40, 15, 1024)
    return _exploded(table(spark, sf, "documents"), chunks, "doc_id")


@query(oracle.line_windows)
def line_windows(spark: SparkSession, sf: str) -> DataFrame:
    chunks = chunk.line_windows(F.col("text"), 7, 3, None)
    return _exploded(table(spark, sf, "documents"), chunks, "doc_id")


@query(oracle.char_pieces)
def char_pieces(spark: SparkSession, sf: str) -> DataFrame:
    pieces = chunk.split_by_chars(F.col("html"), 500)
    return _exploded(table(spark, sf, "pages"), pieces, "page_id")


@query(oracle.token_chunks)
def token_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = chunk.token_windows(F.col("text"), 1024, 64)
    return _exploded(table(spark, sf, "documents"), chunks, "doc_id")


@query(oracle.notebook_chunks)
def notebook_chunks(spark: SparkSession, sf: str) -> DataFrame:
    books = derived.notebooks(table(spark, sf, "documents"))
    read = books.select("doc_id", text.notebook_text(F.encode("json", "utf-8")).alias("text"))
    return _exploded(read, chunk.cell_chunks(F.col("text"), 1024), "doc_id")


@query(oracle.struct_chunks)
def struct_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = chunk.declaration_chunks(F.col("text"), "python", 1024, 3)
    return _exploded(derived.code_like(table(spark, sf, "documents")), chunks, "doc_id")


@query(oracle.expanded_chunks)
def expanded_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = chunk.declaration_chunks(F.col("text"), "python", 1024, 0, expand=True)
    headed = F.transform(chunks, lambda c: chunk.with_path_header(F.col("source"), c))
    return _exploded(derived.code_like(table(spark, sf, "documents")), headed, "doc_id")


@query(oracle.routed_chunks)
def routed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    files = file_rows(spark, sf).withColumn("language", paths.language(F.col("rel")))
    chunks = chunk.route(F.col("text"), F.col("language"), IndexParams())
    return _exploded(files, chunks, "doc_id", "language")


# --- groups ------------------------------------------------------------------


@query(oracle.language_groups)
def language_groups(spark: SparkSession, sf: str) -> DataFrame:
    return group.language_groups(repo_texts(spark, sf))


@query(oracle.group_lines)
def group_lines(spark: SparkSession, sf: str) -> DataFrame:
    return group.group_lines(repo_texts(spark, sf)).withColumn("line_no", big("line_no"))


@query(oracle.group_line_chunks)
def group_line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    windows = group.group_line_windows(repo_texts(spark, sf), 40, 15)
    return windows.withColumn("file_paths", F.array_join("file_paths", "|"))


@query(oracle.group_file_paths)
def group_file_paths(spark: SparkSession, sf: str) -> DataFrame:
    return group.group_files(repo_texts(spark, sf))


@query(oracle.group_path_lists)
def group_path_lists(spark: SparkSession, sf: str) -> DataFrame:
    lists = group.path_pages(group.group_files(repo_texts(spark, sf)), 100)
    return lists.withColumn("file_paths", F.array_join("file_paths", "|"))


@query(oracle.chunk_counts_by_group)
def chunk_counts_by_group(spark: SparkSession, sf: str) -> DataFrame:
    n = F.size(chunk.line_windows(F.col("text"), 40, 15, 1024))
    counted = repo_texts(spark, sf).select(
        "repo_url", group.group_label(F.col("language")).alias("label"), n.alias("n")
    )
    return counted.groupBy("repo_url", "label").agg(F.sum("n").alias("chunks"))


# --- duplicates and numbers --------------------------------------------------


def _line_units(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    texts = repo_texts(spark, sf)
    chunks = chunk.line_windows(F.col("text"), 7, 0, 200)
    units = texts.select(
        "repo_url",
        group.group_label(F.col("language")).alias("label"),
        F.col("rel").alias("unit"),
        chunks.alias("chunks"),
    ).withColumn("digests", dedup.digests(F.col("chunks")))
    return units, group.language_groups(texts)


@query(oracle.dedup_first_wins)
def dedup_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    kept = dedup.first_of_equals(*_line_units(spark, sf))
    return kept.select(
        "repo_url", "first_rel", "unit", F.explode(F.col("keep").cast("array<bigint>")).alias("pos")
    )


@query(oracle.chunk_numbering)
def chunk_numbering(spark: SparkSession, sf: str) -> DataFrame:
    units, groups = _line_units(spark, sf)
    numbered = dedup.number_kept(dedup.first_of_equals(units, groups))
    return dedup.kept_chunks(units, numbered).select(
        "repo_url", "unit", big("pos").alias("pos"), "chunk", "chunk_index", "total_chunks", "ordinal"
    )


@query(oracle.duplicates_removed)
def duplicates_removed(spark: SparkSession, sf: str) -> DataFrame:
    units, _ = _line_units(spark, sf)
    return dedup.duplicate_counts(units)


@query(oracle.duplicate_documents)
def duplicate_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The same over whole texts, all sources taken as one repository."""
    texts = file_rows(spark, sf).select(
        F.lit("all").alias("repo_url"),
        F.lit("text").alias("label"),
        F.format_string("%012d", "doc_id").alias("unit"),
        dedup.digests(F.array("text")).alias("digests"),
    )
    groups = texts.groupBy("repo_url", "label").agg(F.min("unit").alias("first_rel"))
    return dedup.first_of_equals(texts, groups).select(F.col("unit").cast("bigint").alias("doc_id"))


# --- whole repositories ------------------------------------------------------


@query(oracle.indexed_chunks)
def indexed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = jobs.build_chunks(derived.files_in_table(spark, sf), IndexParams()).chunks
    return chunks.select(
        "repo_url",
        "content",
        F.col("meta.file_path").alias("file_path"),
        F.col("meta.chunk_index").alias("chunk_index"),
        F.col("meta.total_chunks").alias("total_chunks"),
        "ordinal",
    )


@query(oracle.run_summary)
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.build_chunks(derived.files_in_table(spark, sf), IndexParams()).summary


@query(oracle.group_scope_chunks)
def group_scope_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Group scope over files of line languages: a chunk names the files in its window."""
    files = derived.files_in_table(spark, sf, suffix=".js")
    chunks = jobs.build_chunks(files, IndexParams(scope="group")).chunks
    return chunks.select(
        "repo_url",
        "content",
        F.array_join("meta.file_paths", "|").alias("file_paths"),
        F.col("meta.chunk_index").alias("chunk_index"),
        F.col("meta.total_chunks").alias("total_chunks"),
    )


# --- embedding ---------------------------------------------------------------


@query(oracle.hash_embed_buckets)
def hash_embed_buckets(spark: SparkSession, sf: str) -> DataFrame:
    counts = embed.token_counts(table(spark, sf, "documents"), "doc_id", "text", 1536)
    return counts.withColumn("bucket", big("bucket"))


@query(oracle.embed_documents)
def embed_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    done = embed.embed_column(docs, "text", embed.HashEmbedder(_DIM))
    return done.select(
        "doc_id",
        F.posexplode("embedding").alias("place", "x"),
    ).select("doc_id", big("place").alias("place"), F.round(F.col("x").cast("double"), 5).alias("x"))


@query(oracle.check_documents)
def check_documents(spark: SparkSession, sf: str) -> DataFrame:
    content = (
        F.when(F.col("lang") == "fr", "  \n")
        .when(F.col("lang") == "de", "")
        .when(F.col("lang") == "en", F.col("text"))
    )
    docs = table(spark, sf, "documents").select("doc_id", content.alias("content"))
    return embed.check_content(docs, "content", "quarantine").select("doc_id", "error")


@query(oracle.embed_knn)
def embed_knn(spark: SparkSession, sf: str) -> DataFrame:
    embedder = embed.HashEmbedder(1536)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    corpus = embed.embed_column(docs, "text", embedder)
    asked = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )
    found = search.nearest(corpus, jobs.embed_queries(asked, embedder), k=2)
    return _shown(found)


# --- search ------------------------------------------------------------------


def _shown(found: DataFrame) -> DataFrame:
    return found.select(
        "query_id", "id", big("rank").alias("rank"), _rounded(F.col("distance")).alias("distance")
    )


def _rounded(x: Column) -> Column:
    """To six digits, without a negative zero."""
    return F.when(F.abs(x) < 5e-7, 0.0).otherwise(F.round(x, 6))


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return rows, rows.select(F.col("id").alias("query_id"), "embedding")


@query(oracle.cosine_distances)
def cosine_distances(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = _vectors(spark, sf)
    first = rows.where("id = 0").first().embedding
    q = F.lit(first).cast("array<float>")
    unit = vector.l2_normalise(F.col("embedding"))
    return rows.select(
        "id",
        _rounded(vector.cosine_distance(F.col("embedding"), q)).alias("distance"),
        F.round(1 + vector.cosine_distance(unit, q), 5).alias("one_more_by_unit"),
    )


@query(oracle.knn_top2)
def knn_top2(spark: SparkSession, sf: str) -> DataFrame:
    rows, queries = _vectors(spark, sf)
    return _shown(search.nearest(rows, queries.where("query_id = 0")))


@query(oracle.knn_batch)
def knn_batch(spark: SparkSession, sf: str) -> DataFrame:
    rows, queries = _vectors(spark, sf)
    return _shown(search.nearest(rows, queries, k=5))


@query(oracle.knn_threshold)
def knn_threshold(spark: SparkSession, sf: str) -> DataFrame:
    rows, queries = _vectors(spark, sf)
    return _shown(search.nearest(rows, queries, k=10, max_distance=0.6))


@query(oracle.knn_unembedded)
def knn_unembedded(spark: SparkSession, sf: str) -> DataFrame:
    rows, queries = _vectors(spark, sf)
    outlier = F.get("embedding", F.lit(0)) > 0.33
    some = rows.withColumn("embedding", F.when(outlier, F.col("embedding")))
    return _shown(search.nearest(some, queries, k=10, keep_unembedded=True))


@query(oracle.knn_lsh)
def knn_lsh(spark: SparkSession, sf: str) -> DataFrame:
    rows, queries = _vectors(spark, sf)
    path = scratch_path(spark, "lsh")
    approx.build_lsh(rows, path)
    return _shown(approx.search_lsh(spark, path, queries, k=5))


@query()
def knn_multiprobe(spark: SparkSession, sf: str) -> DataFrame:
    """Hashed postings without vectors; 8 cells a table read, nearest first."""
    rows, queries = _vectors(spark, sf)
    path = scratch_path(spark, "multiprobe")
    approx.build_multiprobe(rows, path)
    return approx.search_multiprobe(spark, path, rows, queries, k=5, probes=8)


@query()
def knn_multiprobe_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of the multi-probe search against the exact one, and the share of rows each
    query compares, for 2 to 32 cells a table."""
    rows, queries = _vectors(spark, sf)
    exact = materialise(search.nearest(rows, queries, k=5).select("query_id", "id"), "exact")
    path = scratch_path(spark, "multiprobe")
    approx.build_multiprobe(rows, path)
    total = rows.where(F.col("embedding").isNotNull()).count()
    wanted = exact.count()
    measured = []
    for probes in (2, 8, 32):
        found = approx.search_multiprobe(spark, path, rows, queries, k=5, probes=probes)
        found = materialise(found.select("query_id", "id", "compared"), "found")
        hits = exact.join(found.select("query_id", "id"), ["query_id", "id"], "left_semi").count()
        share = found.select("query_id", "compared").distinct().agg(F.avg("compared")).first()[0] or 0.0
        measured.append((probes, hits / max(1, wanted), share / max(1, total)))
    return spark.createDataFrame(measured, "probes int, recall double, share double")


@query(oracle.knn_self)
def knn_lsh_self(spark: SparkSession, sf: str) -> DataFrame:
    """Equal vectors share all their cells, so each vector finds itself."""
    rows, queries = _vectors(spark, sf)
    path = scratch_path(spark, "lsh")
    approx.build_lsh(rows, path, tables=3)
    return _shown(approx.search_lsh(spark, path, queries, k=1))


@query(oracle.knn_self)
def knn_cluster_self(spark: SparkSession, sf: str) -> DataFrame:
    rows, queries = _vectors(spark, sf)
    path = scratch_path(spark, "clusters")
    approx.build_clusters(rows, path, cells=16)
    return _shown(approx.search_clusters(spark, path, queries, k=1, probes=1))


@query(oracle.knn_clusters)
def knn_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Around given centres, so that SQL can repeat the choice of cells."""
    rows, queries = _vectors(spark, sf)
    path = scratch_path(spark, "clusters")
    centres = rows.where("id < 16").select(F.col("id").alias("cell"), F.col("embedding").alias("centre"))
    approx.build_clusters(rows, path, centres=centres)
    return _shown(approx.search_clusters(spark, path, queries, k=5, probes=4))


@query(oracle.knn_batch)
def knn_all_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """With every cell probed the clustered search is exact."""
    rows, queries = _vectors(spark, sf)
    path = scratch_path(spark, "clusters")
    approx.build_clusters(rows, path, cells=8)
    return _shown(approx.search_clusters(spark, path, queries, k=5, probes=8))


@query(oracle.knn_batch)
def knn_clusters_proven(spark: SparkSession, sf: str) -> DataFrame:
    """Two cells probed, then only the cells whose radius may hold a nearer row: exact."""
    rows, queries = _vectors(spark, sf)
    path = scratch_path(spark, "clusters")
    approx.build_clusters(rows, path, cells=16)
    found = approx.search_clusters_exact(spark, path, queries, k=5, probes=2)
    return _shown(found.drop("cells_read"))


@query(oracle.knn_self)
def dropped_derived(spark: SparkSession, sf: str) -> DataFrame:
    """A derived table goes; the rows it came from still answer."""
    rows, queries = _vectors(spark, sf)
    path = scratch_path(spark, "lsh")
    approx.build_lsh(rows, path, tables=1)
    approx.drop_derived(spark, path)
    gone = not path_exists(spark, path)
    return _shown(search.nearest(rows.where(F.lit(gone)), queries, k=1))


@query(oracle.render_results)
def render_results(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of every vector among the labelled ones, the rest having none."""
    rows, queries = _vectors(spark, sf)
    some = queries.join(rows.where("label <> 2").select(F.col("id").alias("query_id")), "query_id")
    found = search.nearest(rows, some, k=2)
    meta = F.struct(
        F.when(F.col("label") == 1, F.concat(F.lit("f"), "id")).alias("file_path"),
        F.when(F.col("label") == 4, "python").alias("language"),
        "label",
        big("label").alias("chunk_index"),
    )
    stored = rows.select(
        "id",
        F.when(F.col("label") == 0, "").otherwise(F.concat(F.lit("r"), "label")).alias("repo_url"),
        meta.alias("meta"),
        F.when(F.col("label") != 1, F.concat(F.lit("c"), "id")).alias("content"),
    )
    return render.render_results(queries, found.join(stored, "id"))


# --- the file source ---------------------------------------------------------


@query(oracle.scan_files)
def scan_files(spark: SparkSession, sf: str) -> DataFrame:
    snapshots = derived.write_snapshots(spark, sf)
    files = repo_files.read_files(repo_files.list_files(snapshots))
    return files.select(
        "repo_url", "commit", "rel", "size", F.sha2("content", 256).alias("digest"), "error"
    )


@query(oracle.scan_summary)
def scan_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The whole job from a manifest of snapshots to an index, as its summary."""
    snapshots = derived.write_snapshots(spark, sf)
    index = IndexTable.create(spark, scratch_path(spark, "index"), _DIM, 8)
    params = IndexParams(dim=_DIM)
    summary = jobs.index_repositories(index, snapshots, params).summary
    stored = index.read().groupBy("repo_url").agg(F.count("*").alias("stored"))
    return summary.join(stored, "repo_url")


# --- the index ---------------------------------------------------------------


def _index(spark: SparkSession, sf: str) -> tuple[IndexTable, DataFrame]:
    """An index of all documents; those of one source belong to no repository."""
    index = IndexTable.create(spark, scratch_path(spark, "index"), _DIM, 8)
    docs = table(spark, sf, "documents").select(
        F.nullif("source", F.lit("src3")).alias("repo_url"),
        F.col("text").alias("content"),
        F.col("doc_id").alias("seq"),
    )
    jobs.ingest(index, docs)
    return index, docs


def _rows(index: IndexTable) -> DataFrame:
    return index.read().select("id", "repo_url", F.sha2("content", 256).alias("digest"))


@query(oracle.index_rows)
def index_rows(spark: SparkSession, sf: str) -> DataFrame:
    index, _ = _index(spark, sf)
    return _rows(index)


@query(oracle.assigned_ids)
def assigned_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of documents of which some bring their own."""
    index = IndexTable.create(spark, scratch_path(spark, "index"), _DIM, 8)
    own = F.when(F.col("lang") == "fr", F.col("doc_id") + 1_000_000)
    docs = table(spark, sf, "documents").select(
        own.alias("id"), F.col("text").alias("content"), F.col("doc_id").alias("seq")
    )
    return jobs.ingest(index, docs).ids.select(F.col("seq").alias("doc_id"), "id")


@query(oracle.foreign_meta)
def foreign_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Events as documents whose metadata is a JSON object of the caller's."""
    docs = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("content"), F.col("props").alias("meta")
    )
    return as_documents(docs, "https://github.com/a/b").select(
        "id", "repo_url", "content", "meta_json", F.col("meta.language").isNull().alias("no_language")
    )


@query(oracle.repo_exists)
def repo_exists(spark: SparkSession, sf: str) -> DataFrame:
    index, _ = _index(spark, sf)
    docs = table(spark, sf, "documents")
    asked = docs.select(F.col("source").alias("repo_url")).union(docs.select("lang")).distinct()
    known = index.existing(asked).withColumn("known", F.lit(True))
    return asked.join(known, "repo_url", "left").select(
        "repo_url", F.coalesce("known", F.lit(False)).alias("present")
    )


@query(oracle.delete_repo)
def delete_repo(spark: SparkSession, sf: str) -> DataFrame:
    index, _ = _index(spark, sf)
    deleted = index.delete_repo("src0")
    return _rows(index).withColumn("deleted", F.lit(deleted).cast("bigint"))


@query(oracle.search_self)
def search_approximate(spark: SparkSession, sf: str) -> DataFrame:
    """Every text as a query: equal texts share all cells, so each finds the first of its copies."""
    index, docs = _index(spark, sf)
    asked = docs.select(F.col("seq").alias("query_id"), F.col("content").alias("query"))
    found = jobs.search(index, asked, k=1, approximate=True)
    return found.select("query_id", (F.abs("distance") < 1e-6).alias("found"))


@query(oracle.of_repo)
def of_repo(spark: SparkSession, sf: str) -> DataFrame:
    index, _ = _index(spark, sf)
    rows = index.of_repo("src0")
    return rows.select("id", "repo_url", F.sha2("content", 256).alias("digest"))


@query(oracle.index_rows)
def compacted_index(spark: SparkSession, sf: str) -> DataFrame:
    """Two jobs of half the documents each, then one run, and nothing else kept."""
    index = IndexTable.create(spark, scratch_path(spark, "index"), _DIM, 8)
    docs = table(spark, sf, "documents").select(
        F.nullif("source", F.lit("src3")).alias("repo_url"),
        F.col("text").alias("content"),
        (F.col("doc_id") + 1).alias("id"),
    )
    jobs.ingest(index, docs.where("id % 2 = 0"))
    jobs.ingest(index, docs.where("id % 2 = 1"))
    index.compact()
    index.vacuum(0)
    assert len(index.manifest().runs) == 1
    return _rows(index)


@query(oracle.drop_table)
def drop_table(spark: SparkSession, sf: str) -> DataFrame:
    """Of two indexes one is dropped."""
    index, _ = _index(spark, sf)
    other = IndexTable.create(spark, scratch_path(spark, "index"), _DIM, 8)
    rows = _rows(index).agg(F.count("*").alias("n_rows")).withColumn("there", F.lit(index.exists()))
    other.drop()
    return rows.withColumn("other_there", F.lit(other.exists()))


@query(oracle.ingest_one)
def ingest_one(spark: SparkSession, sf: str) -> DataFrame:
    """The longest text joins all others as a document of its own."""
    index, docs = _index(spark, sf)
    longest = docs.orderBy(F.length("content").desc(), "seq").first()
    number = jobs.ingest_one(index, longest.content)
    return _rows(index).withColumn("added", F.col("id") == number)


@query(oracle.audit_stamps)
def audit_stamps(spark: SparkSession, sf: str) -> DataFrame:
    """Replaced rows keep their repository's first stamp and get a new second one."""
    index, docs = _index(spark, sf)
    jobs.ingest(index, docs.where(F.col("repo_url").isin("src1", "src2")), clear_existing=True)
    rows = index.read()
    first = rows.agg(F.min("created_at").alias("first"))
    return rows.join(F.broadcast(first)).select(
        "repo_url",
        (F.col("created_at") == F.col("first")).alias("old"),
        (F.col("updated_at") > F.col("created_at")).alias("renewed"),
    ).groupBy("repo_url", "old", "renewed").agg(F.count("*").alias("n"))


@query(oracle.empty_input)
def empty_input(spark: SparkSession, sf: str) -> DataFrame:
    """A job without documents is refused, one over empty repositories is not."""
    index = IndexTable.create(spark, scratch_path(spark, "index"), _DIM, 8)
    docs = table(spark, sf, "documents").select(F.col("text").alias("content"))
    try:
        jobs.ingest(index, docs.where("content IS NULL"))
        refused = False
    except jobs.NoDocuments:
        refused = True
    files = derived.files_in_table(spark, sf).withColumn("size", F.lit(1 << 40))
    chunked, done = jobs.index_files(index, files, IndexParams(dim=_DIM))
    return chunked.summary.select(
        "repo_url", "total_files", "skipped_large", "total_chunks",
        F.lit(refused).alias("refused"), F.lit(done is None).alias("nothing_stored"),
    )


class _Picky(embed.HashEmbedder):
    """Refuses texts that start with a T, and so every request that has one."""

    def embed(self, texts: list[str]):
        if any(t.startswith("T") for t in texts):
            raise ValueError("no T")
        return super().embed(texts)


@query(oracle.embed_fallback)
def embed_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """A request that fails is repeated text by text; only texts that fail alone are refused."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    done = embed.embed_column(docs, "text", _Picky(_DIM), 5, "quarantine")
    return done.select(
        "doc_id", F.col("embedding").isNotNull().alias("embedded"), F.col("embed_error").alias("error")
    )


@query(oracle.stored_group_files)
def stored_group_files(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of every group, as the index publishes them."""
    index = IndexTable.create(spark, scratch_path(spark, "index"), _DIM, 8)
    jobs.index_files(index, derived.files_in_table(spark, sf), IndexParams(dim=_DIM, scope="group"))
    return index.group_files()


@query(oracle.scan_failures)
def scan_failures(spark: SparkSession, sf: str) -> DataFrame:
    """One of the snapshots has no folder: it is named, and the others are indexed."""
    snapshots = derived.write_snapshots(spark, sf)
    broken = F.col("repo_url") == "https://github.com/o/src1"
    snapshots = snapshots.withColumn("root", F.when(broken, F.concat("root", F.lit("-gone"))).otherwise(F.col("root")))
    index = IndexTable.create(spark, scratch_path(spark, "index"), _DIM, 8)
    done = jobs.index_repositories(index, snapshots, IndexParams(dim=_DIM))
    stored = index.read().select("repo_url").distinct().withColumn("stored", F.lit(True))
    failed = done.failures.select(F.col("repo_url").alias("r"), F.col("rel").alias("path"), "error")
    return (
        done.summary.select("repo_url", "total_files", "failed_files")
        .join(stored, "repo_url", "left")
        .join(failed, F.col("repo_url") == F.col("r"), "left")
        .select("repo_url", "total_files", "failed_files", F.coalesce("stored", F.lit(False)).alias("stored"), "path", "error")
    )


@query(oracle.replace_repo)
def replace_repo(spark: SparkSession, sf: str) -> DataFrame:
    index, docs = _index(spark, sf)
    again = docs.where(F.col("repo_url").isin("src1", "src2")).withColumn(
        "content", F.concat(F.lit("v2 "), "content")
    )
    jobs.ingest(index, again, clear_existing=True)
    return _rows(index)


@query(oracle.append_repo)
def append_repo(spark: SparkSession, sf: str) -> DataFrame:
    index, docs = _index(spark, sf)
    jobs.ingest(index, docs.where(F.col("repo_url").isin("src1", "src2")))
    return _rows(index)


@query(oracle.search_index)
def search_index(spark: SparkSession, sf: str) -> DataFrame:
    index, _ = _index(spark, sf)
    asked = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )
    found = jobs.search(index, asked, k=2)
    return _shown(found).join(
        found.select("query_id", "id", "repo_url", F.sha2("content", 256).alias("digest")),
        ["query_id", "id"],
    )
