"""The whole jobs: chunking repositories, ingesting documents, indexing, searching."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.functions.paths import is_notebook
from repoquarry.functions.text import is_blank, remove_nul
from repoquarry.operators.approx import Planes, search_hashed, write_hashed
from repoquarry.operators.chunk import route, split_by_chars, with_path_header
from repoquarry.operators.dedup import digests, first_of_equals, kept_chunks, number_kept
from repoquarry.operators.embed import Embedder, HashEmbedder, check_content, embed_column
from repoquarry.operators.group import (
    group_files,
    group_label,
    group_line_windows,
    language_groups,
)
from repoquarry.operators.numbering import dense_numbers, running_totals
from repoquarry.operators.render import render_results
from repoquarry.operators.search import nearest
from repoquarry.operators.select import (
    decide,
    file_counts,
    file_state,
    listed,
    split_repo_urls,
    with_texts,
)
from repoquarry.params import (
    LOCAL_ZONE,
    NO_LANGUAGE,
    SOURCE_STAMP,
    STRUCTURED_LANGUAGES,
    IndexParams,
)
from repoquarry.schemas import FILE_SCHEMA, MANIFEST_SCHEMA, require
from repoquarry.sources.documents import as_documents, one_document
from repoquarry.sources.index_table import REFUSED, IndexTable, Manifest
from repoquarry.sources.repo_files import list_files, read_files
from repoquarry.session import materialise, tasks_for

# --- chunking ----------------------------------------------------------------


@dataclass
class Chunked:
    """What chunking repositories yields; all tables are lazy over written ones."""

    chunks: DataFrame  # documents: content, meta and `ordinal`, the overall order
    summary: DataFrame  # a row of counts per repository
    failures: DataFrame  # files that could not be read, with the error
    group_files: DataFrame | None  # in group scope, every path of every group


def _line_language(label: Column) -> Column:
    return ~label.isin(NO_LANGUAGE, *STRUCTURED_LANGUAGES)


def _file_units(files: DataFrame, params: IndexParams) -> DataFrame:
    """A row per listed file with its state and, for a kept one, chunks and digests. Chunks
    of white space only, which cannot be embedded, are left out before anything counts them.

    In group scope the files of line languages keep their text instead; they are
    cut as groups in a second step.
    """
    by_group = params.scope == "group"
    text, language = F.col("text"), F.col("language")
    chunks = route(text, language, params, is_notebook(F.col("rel")))
    if params.expand_chunks:
        chunks = F.transform(chunks, lambda c: with_path_header(F.col("rel"), c))
    chunks = F.filter(chunks, lambda c: ~is_blank(c))
    in_group = _line_language(F.col("label")) if by_group else F.lit(False)
    kept = F.col("state") == "kept"
    return (
        files.withColumn("state", file_state(F.col("reason"), F.col("error"), text))
        .withColumn("label", group_label(language))
        .withColumn("chunks", F.when(kept & ~in_group, chunks))
        .select(
            F.coalesce("repo_url", F.raise_error(F.lit("a file has no repo_url"))).alias("repo_url"),
            "commit",
            "rel",
            "reason",
            "state",
            "error",
            "language",
            "label",
            F.when(kept & in_group, text).alias("text"),
            "chunks",
            digests(F.col("chunks")).alias("digests"),
        )
    )


def _group_units(files: DataFrame, params: IndexParams) -> DataFrame:
    """Units of the line languages in group scope: a row per window of a group."""
    windows = group_line_windows(files, params.chunk_lines, params.chunk_lines_overlap)
    commits = files.groupBy("repo_url").agg(F.first("commit", ignorenulls=True).alias("commit"))
    chunks = F.filter(split_by_chars(F.col("chunk"), params.max_chars), lambda c: ~is_blank(c))
    return windows.join(commits, "repo_url").select(
        "repo_url",
        "commit",
        "label",
        F.lpad(F.col("window").cast("string"), 19, "0").alias("unit"),
        F.lit(None).cast("string").alias("rel"),
        "file_paths",
        F.col("label").alias("language"),
        chunks.alias("chunks"),
        digests(chunks).alias("digests"),
    )


def _check_paths(states: DataFrame) -> None:
    """Chunks are numbered by their place in a repository's files, so a path may be there
    once only. Two snapshots of one repository are two jobs."""
    twice = states.groupBy("repo_url", "rel").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0].rel} is there more than once in {twice[0].repo_url}")


def build_chunks(files: DataFrame, params: IndexParams = IndexParams()) -> Chunked:
    """Chunk, deduplicate and number the files of any number of repositories.

    `files(repo_url, commit, rel, size, content, error)` holds the listed files, the
    content only of those to include. Chunks are made once and written with their
    digests; what follows works on digests and counts until the kept texts are read
    back.
    """
    require(files, FILE_SCHEMA, "files")
    decided = decide(listed(files), params.max_bytes).withColumn(
        "reason", F.col("decision.reason")
    )
    states = materialise(_file_units(with_texts(decided), params), "files")
    _check_paths(states)
    kept = states.where(F.col("state") == "kept")
    units = kept.where(F.col("chunks").isNotNull()).select(
        "repo_url",
        "commit",
        "label",
        F.col("rel").alias("unit"),
        "rel",
        F.array("rel").alias("file_paths"),
        "language",
        "chunks",
        "digests",
    )
    members = None
    if params.scope == "group":
        members = group_files(kept)
        lines = _group_units(kept.where(_line_language(F.col("label"))), params)
        units = units.unionByName(materialise(lines, "windows"))
    numbered = number_kept(first_of_equals(units, language_groups(kept)))
    chunks = kept_chunks(units, numbered)
    meta = F.struct(
        F.lit(SOURCE_STAMP).alias("source"),
        "repo_url",
        "file_paths",
        "commit",
        "chunk_index",
        "total_chunks",
        "language",
        (F.col("rel") if params.scope == "file" else F.lit(None).cast("string")).alias("file_path"),
    )
    totals = numbered.groupBy("repo_url").agg(F.max("total_chunks").alias("total_chunks"))
    summary = (
        file_counts(states)
        .join(totals, "repo_url", "left")
        .withColumn("total_chunks", F.coalesce("total_chunks", F.lit(0)))
    )
    return Chunked(
        chunks=chunks.select(
            "repo_url", F.col("chunk").alias("content"), meta.alias("meta"), "ordinal"
        ),
        summary=summary,
        failures=states.where(F.col("state") == "failed").select("repo_url", "rel", "error"),
        group_files=members,
    )


# --- ingesting ---------------------------------------------------------------


@dataclass
class Ingested:
    ids: DataFrame  # (seq, id) of the stored rows, `seq` giving the input order
    stored: int
    deleted: int
    quarantine: DataFrame  # documents that were not stored, with the error


class NoDocuments(ValueError):
    """Nothing to ingest: an error for a caller with documents, not for a job over
    repositories."""


def local_now() -> Column:
    """One stamp for a whole job: the wall clock of the fixed zone."""
    now = datetime.now(ZoneInfo(LOCAL_ZONE)).replace(tzinfo=None)
    return F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")


def assign_ids(docs: DataFrame, base: int, order: list[str]) -> DataFrame:
    """Keep the ids documents bring, and number the others above `base` in the given
    order; `base` has to be at least every id brought."""
    new = F.col("id").isNull()
    numbered = running_totals(docs, [], order, F.when(new, 1).otherwise(0), before="_n", total="_t")
    return numbered.withColumn("id", F.coalesce("id", F.col("_n") + base + 1)).drop("_n", "_t")


def _check_replaced(refused: DataFrame, replaced: DataFrame) -> None:
    """Old rows are only given up for a whole set of new ones."""
    lost = refused.distinct().join(replaced, "repo_url", "left_semi").take(1)
    if lost:
        raise NotReplaced(f"{lost[0].repo_url} has documents that got no embedding")


def _check_ids(table: IndexTable, docs: DataFrame, surviving: DataFrame | None) -> None:
    taken = docs.groupBy("id").count().where("count > 1").select("id").limit(1).collect()
    if not taken and surviving is not None:
        taken = docs.select("id").join(surviving.select("id"), "id", "left_semi").take(1)
    if taken:
        raise ValueError(f"id {taken[0].id} is used more than once")


class NotReplaced(RuntimeError):
    """New rows of a repository got no embedding; the index keeps its old ones."""


def ingest(
    table: IndexTable,
    docs: DataFrame,
    embedder: Embedder | None = None,
    params: IndexParams = IndexParams(),
    repo_url: str | None = None,
    clear_existing: bool = False,
    dense_seq: bool = False,
    batch: tuple[str, int] | None = None,
    members: DataFrame | None = None,
) -> Ingested:
    """Embed and store documents: `content`, and optionally `meta`, `id`, `repo_url`
    and `seq`, a column that tells their order; documents that share a `seq` or have none
    are documents of their own. With `dense_seq` it counts from 0 without gaps or repeats,
    and new ids simply add to it. `batch` names a stream and its
    batch, recorded together with the rows. `members` are the files of the groups that
    chunks name, stored and published with them.

    With `clear_existing` the repositories among the documents lose their old rows.
    Old and new state change over in one step, after the new rows were checked. If a
    document of such a repository is refused, nothing changes and the job fails.
    """
    spark = table.spark
    manifest = table.manifest()
    embedder = embedder or HashEmbedder(manifest.dim)
    if embedder.dim != manifest.dim:
        raise ValueError(f"the index holds {manifest.dim} dimensions, not {embedder.dim}")
    checked = check_content(as_documents(docs, repo_url), "content", params.on_error)
    in_scan_order = "seq" not in checked.columns
    if in_scan_order:
        checked = checked.withColumn("seq", F.monotonically_increasing_id())
    # What tells one staged document from another: `seq` is the caller's and may repeat.
    key = "seq" if in_scan_order or dense_seq else "_at"
    if key == "_at":
        checked = checked.withColumn(key, F.monotonically_increasing_id())
    staged = materialise(checked, "documents")
    usable = F.col("error").isNull()
    seen = staged.agg(
        F.count("*").alias("all"),
        F.count_if(usable).alias("usable"),
        F.coalesce(F.max(F.when(usable, F.col("id"))), F.lit(0)).alias("max_id"),
        F.count_if(usable & F.col("id").isNotNull()).alias("with_id"),
        F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"),
    ).first()
    if not seen["all"]:
        raise NoDocuments("there are no documents to ingest")
    good = staged.where(usable)
    base, brings_ids = max(manifest.max_id, seen.max_id), seen.with_id > 0
    if in_scan_order and not brings_ids:
        numbered = dense_numbers(staged, "seq", "_n")
        rows = numbered.where(usable).withColumn("id", F.col("_n") + base + 1).drop("_n")
        ids = rows.select("seq", "id")
    elif dense_seq and not brings_ids:
        rows = good.withColumn("id", F.col("seq") + base + 1)
        ids = rows.select("seq", "id")
    else:
        order = list(dict.fromkeys(["seq", key]))
        ids = assign_ids(good.select(*order, "id"), base, order)
        rows = good.drop("id").join(ids.select(key, "id"), key)

    touched: list[int] = []
    replaced = None
    if clear_existing:
        incoming = good.where(F.col("repo_url").isNotNull()).select("repo_url").distinct()
        replaced = table.existing(incoming)
        touched = table.buckets_of(replaced, manifest.buckets)
    if brings_ids:
        survivors = table.read(manifest)
        if touched:
            survivors = survivors.join(replaced, "repo_url", "left_anti")
        _check_ids(table, ids, survivors)
    elif dense_seq:
        _check_ids(table, ids, None)
    if clear_existing:
        bad = staged.where(~usable & F.col("repo_url").isNotNull()).select("repo_url")
        _check_replaced(bad, replaced)

    now = local_now()
    rows = rows.withColumn("created_at", now).withColumn("updated_at", now)
    if touched:
        old = table.read(manifest).where(F.col("repo_bucket").isin(touched))
        since = old.groupBy("repo_url").agg(F.min("created_at").alias("since"))
        rows = (
            rows.join(since, "repo_url", "left")
            .withColumn("created_at", F.coalesce("since", "created_at"))
            .drop("since")
        )
    # Texts are laid out before they are embedded, so that vectors, which are larger,
    # are written where they were made and never shuffled. Embedding is costly for
    # the size of a text: tasks fill all slots as long as there are requests to make, and
    # grow in number with the texts, so that none has more than `TASK_BYTES`.
    requests = -(-seen.usable // params.batch_size)
    tasks = params.embed_partitions or tasks_for(spark, requests, seen["bytes"])
    rows = table.laid_out(rows, manifest.buckets, tasks)
    rows = embed_column(rows, "content", embedder, params.batch_size, params.on_error)
    run = table.write_run(rows.withColumn("content", remove_nul(F.col("content"))))

    refused = F.col("repo_bucket") == REFUSED
    wrong = F.col("embedding").isNull() | (F.size("embedding") != manifest.dim)
    written = table.read_run(run)
    counts = written.agg(
        F.count("*").alias("all"),
        F.count_if(~refused).alias("stored"),
        F.count_if(~refused & wrong).alias("wrong"),
        F.coalesce(F.max("id"), F.lit(0)).alias("max_id"),
    ).first()
    if counts["all"] != seen.usable or counts.wrong:
        table.discard_run(run)
        raise RuntimeError(
            f"{counts['all']} of {seen.usable} rows written, {counts.wrong} without a vector"
        )
    if clear_existing and counts.stored < counts["all"]:
        try:
            _check_replaced(written.where(refused).select("repo_url"), replaced)
        except NotReplaced:
            table.discard_run(run)
            raise
    deleted, runs = 0, [run]
    if touched:
        runs.append(table.write_survivors(replaced, manifest, touched))
        deleted = table.rows_in(touched, manifest) - table.read_run(runs[1]).count()
    files_run = table.write_members(members) if members is not None else None
    table.publish_runs(runs, manifest, counts.max_id, touched, batch, files_run)

    failed = written.where(refused).select("id", "embed_error").join(ids, "id")
    quarantine = staged.where(F.col("error").isNotNull()).unionByName(
        staged.drop("error").join(failed.select(key, F.col("embed_error").alias("error")), key)
    )
    kept = ids.join(failed.select(key), key, "left_anti")
    return Ingested(
        ids=kept.select("seq", "id").orderBy("seq", "id"),
        stored=counts.stored,
        deleted=deleted,
        quarantine=quarantine.drop("_at"),
    )


def ingest_one(
    table: IndexTable, content: str, meta: str | None = None, doc_id: int | None = None, **options
) -> int:
    """Store a single document and return its id."""
    params = options.pop("params", IndexParams(on_error="fail"))
    done = ingest(table, one_document(table.spark, content, meta, doc_id), params=params, **options)
    return done.ids.first().id


# --- indexing ----------------------------------------------------------------


@dataclass
class Indexed:
    summary: DataFrame
    ingested: Ingested | None
    failures: DataFrame
    bad_urls: DataFrame


def index_files(
    table: IndexTable,
    files: DataFrame,
    params: IndexParams = IndexParams(),
    embedder: Embedder | None = None,
    clear_existing: bool = True,
) -> tuple[Chunked, Ingested | None]:
    """Chunk and ingest files that are already in a table."""
    chunked = build_chunks(files, params)
    docs = chunked.chunks.withColumnRenamed("ordinal", "seq")
    try:
        return chunked, ingest(
            table,
            docs,
            embedder,
            params,
            clear_existing=clear_existing,
            dense_seq=True,
            members=chunked.group_files,
        )
    except NoDocuments:
        return chunked, None


def index_repositories(
    table: IndexTable,
    manifest: DataFrame,
    params: IndexParams = IndexParams(),
    embedder: Embedder | None = None,
    clear_existing: bool = True,
) -> Indexed:
    """Index snapshots `manifest(repo_url, commit, root)` of repositories.

    Files are listed and chosen by name and size; only chosen ones are read. A repository
    of which a folder or file cannot be listed is not indexed: it keeps the rows it has, and
    the summary and the failures name it. A repository that is there twice is a bad URL.
    """
    require(manifest, MANIFEST_SCHEMA, "snapshots")
    good, bad = split_repo_urls(manifest)
    found = decide(listed(list_files(good)), params.max_bytes)
    partial = found.where(F.col("error").isNotNull()).select("repo_url").distinct()
    whole = found.join(partial, "repo_url", "left_anti")
    included = whole.where("decision.include").drop("decision", "error")
    others = whole.where("NOT decision.include").unionByName(
        found.where(F.col("error").isNotNull())
    )
    files = read_files(included).unionByName(
        others.drop("decision", "root"), allowMissingColumns=True
    )
    chunked, done = index_files(table, files, params, embedder, clear_existing)
    return Indexed(chunked.summary, done, chunked.failures, bad)


# --- searching ---------------------------------------------------------------

def embed_queries(queries: DataFrame, embedder: Embedder, batch_size: int = 32) -> DataFrame:
    """(query_id, query, embedding); a blank query stops the job."""
    checked = check_content(queries, "query", "fail").where(F.col("error").isNull())
    return embed_column(checked.drop("error"), "query", embedder, batch_size).drop("embed_error")


def search(
    table: IndexTable,
    queries: DataFrame,
    embedder: Embedder | None = None,
    k: int = 2,
    max_distance: float | None = None,
    with_embedding: bool = False,
    approximate: bool = False,
) -> DataFrame:
    """The k stored rows nearest to each of `queries(query_id, query)`:
    (query_id, rank, distance) and the columns of the index. With `approximate` only rows
    in the hashed cells of a query are compared with it.

    The search reads ids and vectors only. The rows found are then fetched by their
    bucket and id, without the vectors unless `with_embedding`.
    """
    manifest = table.manifest()
    embedder = embedder or HashEmbedder(manifest.dim)
    rows = table.read(manifest)
    vectors = materialise(embed_queries(queries, embedder), "queries")
    if approximate and manifest.runs:
        cells = hashed_rows(table, manifest)
        hits = search_hashed(cells, vectors, Planes(manifest.dim), k, max_distance)
    else:
        hits = nearest(rows.select("id", "embedding"), vectors, k, max_distance)
    return fetch(rows if with_embedding else rows.drop("embedding"), hits)


def hashed_rows(table: IndexTable, manifest: Manifest) -> DataFrame:
    """The hashed cells of all live rows. Cells are written run by run, once, as a run never
    changes; what replaced or deleted rows is seen through the manifest."""
    new = [run for run in manifest.runs if not table.has_derived("hashed", run)]
    for run in new:
        rows = table.read(Manifest(0, manifest.buckets, manifest.dim, runs={run: []}))
        write_hashed(rows, table.derived_path("hashed", run), Planes(manifest.dim))
    return table.read_derived("hashed", manifest)


def fetch(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Stored rows of search results.

    The ids alone tell the buckets, of which a table has a set number; only their folders
    are read, and within them the join is on bucket and id.
    """
    found = materialise(hits.join(rows.select("id", "repo_bucket"), "id"), "hits")
    buckets = [row.repo_bucket for row in found.select("repo_bucket").distinct().collect()]
    near = rows.where(F.col("repo_bucket").isin(buckets))
    return found.join(near, ["repo_bucket", "id"]).select(
        "query_id", "rank", "distance", *[c for c in rows.columns if c != "repo_bucket"]
    )


def search_rendered(table: IndexTable, queries: DataFrame, **options) -> DataFrame:
    """(query_id, rendered): the results of each query as Markdown."""
    return render_results(queries, search(table, queries, **options))
