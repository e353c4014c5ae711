"""Ingesting documents as they arrive, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from repoquarry.operators.embed import Embedder
from repoquarry.params import IndexParams
from repoquarry.plans.jobs import ingest
from repoquarry.sources.index_table import IndexTable


MAX_RUNS = 32  # a batch is a run; more than these are joined in one


def ingest_stream(
    table: IndexTable,
    docs: DataFrame,
    name: str,
    checkpoint: str,
    embedder: Embedder | None = None,
    params: IndexParams = IndexParams(),
    clear_existing: bool = False,
    **trigger,
) -> StreamingQuery:
    """Start a query that ingests a stream of documents into the index.

    The index records the last batch of each stream together with its rows, so a
    batch that is delivered again after a failure is stored once. With
    `clear_existing` the repositories of a batch replace what the index had of them,
    so a snapshot of a repository has to arrive within one batch. Many small batches are
    compacted now and then, so that reading the index does not slow down.
    """

    def store(batch: DataFrame, number: int) -> None:
        if number <= table.manifest().streams.get(name, -1) or batch.isEmpty():
            return
        ingest(
            table,
            batch,
            embedder,
            params,
            clear_existing=clear_existing,
            batch=(name, number),
        )
        if len(table.manifest().runs) > MAX_RUNS:
            table.compact()

    return (
        docs.writeStream.queryName(name)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(store)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
