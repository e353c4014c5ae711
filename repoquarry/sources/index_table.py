"""The index: a Parquet table with a small list of what is live in it.

    <path>/data/run=<run>/repo_bucket=<b>/*.parquet    written once, never changed
    <path>/group_files/run=<run>/*.parquet             files of the groups chunks name
    <path>/manifest/v=<n>                              the runs that count, one file a version

A job writes a run, checks it, and then publishes the next manifest: readers see all
of a job or nothing of it, and a failed job leaves the index as it was. Replacing or
deleting a repository rewrites only the buckets it is in; the manifest then names
those buckets as dead in the older runs. `compact` joins the live rows of all runs in
one; `vacuum` deletes what no longer counts.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoquarry.functions.paths import repo_bucket
from repoquarry.schemas import INDEX_SCHEMA
from repoquarry.session import tasks_for
from repoquarry.sources.storage import create_file, delete_path, entries, path_exists, read_file

_STORED = T.StructType(
    [
        *INDEX_SCHEMA.fields,
        T.StructField("run", T.StringType()),
        T.StructField("repo_bucket", T.IntegerType()),
    ]
)
_WRITTEN = T.StructType([*_STORED.fields, T.StructField("embed_error", T.StringType())])
COLUMNS = INDEX_SCHEMA.fieldNames()
REFUSED = -1  # bucket of rows that got no embedding


@dataclass
class Manifest:
    version: int
    buckets: int
    dim: int
    max_id: int = 0
    runs: dict[str, list[int]] = field(default_factory=dict)  # run -> its dead buckets
    streams: dict[str, int] = field(default_factory=dict)  # stream -> last batch stored
    group_runs: list[str] = field(default_factory=list)  # runs of group files, oldest first

    def next(self, **changes) -> Manifest:
        return Manifest(**{**self.__dict__, **changes, "version": self.version + 1})


class IndexTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # --- the manifest ---

    @classmethod
    def create(cls, spark: SparkSession, path: str, dim: int, buckets: int) -> IndexTable:
        """A new, empty table; it is an error if there is one."""
        table = cls(spark, path)
        table._publish(Manifest(0, buckets, dim))
        return table

    @classmethod
    def open(cls, spark: SparkSession, path: str, dim: int, buckets: int) -> IndexTable:
        """The table at `path`, created when there is none."""
        table = cls(spark, path)
        return table if table.exists() else cls.create(spark, path, dim, buckets)

    def exists(self) -> bool:
        return path_exists(self.spark, f"{self.path}/manifest")

    def manifest(self) -> Manifest:
        """The newest version that is whole; one being written does not count yet."""
        for version in self._versions()[-1:-3:-1]:
            try:
                return Manifest(**json.loads(read_file(self.spark, self._version_path(version))))
            except json.JSONDecodeError:
                continue
        raise ValueError(f"there is no index at {self.path}")

    def _version_path(self, version: int) -> str:
        return f"{self.path}/manifest/v={version}"

    def _versions(self) -> list[int]:
        names = [name for name, _ in entries(self.spark, f"{self.path}/manifest")]
        return sorted(int(name[2:]) for name in names if name.startswith("v="))

    def _publish(self, manifest: Manifest) -> None:
        """Creating a version that is there already fails, so of two jobs that
        started from the same state the second does not undo the first."""
        create_file(
            self.spark, self._version_path(manifest.version), json.dumps(manifest.__dict__)
        )

    # --- reading ---

    def read(self, manifest: Manifest | None = None) -> DataFrame:
        """All live rows, with their bucket. Filters on `repo_bucket` prune folders."""
        manifest = manifest or self.manifest()
        if not manifest.runs:
            return self.spark.createDataFrame([], _STORED).drop("run")
        data = f"{self.path}/data"
        paths = [f"{data}/run={run}" for run in manifest.runs]
        return (
            self.spark.read.schema(_STORED)
            .option("basePath", data)
            .parquet(*paths)
            .where(self._live(manifest))
            .drop("run")
        )

    def _live(self, manifest: Manifest) -> Column:
        """Rows of (run, repo_bucket) that count: one condition for all runs that lost the
        same buckets."""
        same: dict[tuple[int, ...], list[str]] = {}
        for run, dead in manifest.runs.items():
            same.setdefault(tuple(dead), []).append(run)
        parts = [
            F.col("run").isin(runs) & ~F.col("repo_bucket").isin([REFUSED, *dead])
            for dead, runs in same.items()
        ]
        return reduce(or_, parts)

    # --- tables derived from runs ---

    def derived_path(self, name: str, run: str) -> str:
        return f"{self.path}/{name}/run={run}"

    def has_derived(self, name: str, run: str) -> bool:
        return path_exists(self.spark, f"{self.derived_path(name, run)}/_SUCCESS")

    def read_derived(self, name: str, manifest: Manifest) -> DataFrame:
        """Live rows of a derived table, which has to keep `repo_bucket`."""
        paths = [self.derived_path(name, run) for run in manifest.runs]
        rows = self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*paths)
        return rows.where(self._live(manifest)).drop("run", "repo_bucket")

    def of_repo(self, repo_url: str) -> DataFrame:
        """Rows of one repository; reads one bucket."""
        manifest = self.manifest()
        return self.read(manifest).where(self._is_repo(repo_url, manifest.buckets))

    def _is_repo(self, repo_url: str, buckets: int) -> Column:
        # The bucket of a literal is folded to a constant, which prunes folders.
        own = F.col("repo_bucket") == repo_bucket(F.lit(repo_url), buckets)
        return own & (F.col("repo_url") == repo_url)

    def repo_exists(self, repo_url: str) -> bool:
        return not self.of_repo(repo_url).select("id").limit(1).isEmpty()

    def existing(self, repos: DataFrame) -> DataFrame:
        """Those of `repos(repo_url)` that have rows in the index."""
        manifest = self.manifest()
        touched = self.buckets_of(repos, manifest.buckets)
        # Distinct before the join: one large repository is then one row.
        known = self.read(manifest).where(F.col("repo_bucket").isin(touched))
        return (
            repos.select("repo_url")
            .distinct()
            .join(known.select("repo_url").distinct(), "repo_url", "left_semi")
        )

    # --- writing ---

    def laid_out(self, rows: DataFrame, buckets: int, tasks: int | None = None) -> DataFrame:
        """Rows spread as the table stores them, with `repo_bucket`.

        The rebalance hint lets Spark split a bucket that one large repository fills
        and merge small ones. With `tasks`, ranges of bucket and id make that many
        even parts instead.
        """
        rows = rows.withColumn("repo_bucket", repo_bucket(F.col("repo_url"), buckets))
        if tasks:
            return rows.repartitionByRange(tasks, "repo_bucket", "id")
        return rows.hint("rebalance", "repo_bucket")

    def write_run(self, laid_out: DataFrame) -> str:
        """Write laid-out rows as a run that does not count yet. Rows with an
        `embed_error` go to a folder of their own, which readers leave out."""
        run = uuid.uuid4().hex
        if "embed_error" not in laid_out.columns:
            laid_out = laid_out.withColumn("embed_error", F.lit(None).cast("string"))
        refused = F.col("embed_error").isNotNull()
        (
            laid_out.withColumn(
                "repo_bucket", F.when(refused, REFUSED).otherwise(F.col("repo_bucket"))
            )
            .select(*COLUMNS, "embed_error", "repo_bucket")
            .sortWithinPartitions("repo_bucket", "id")
            .write.partitionBy("repo_bucket")
            .parquet(f"{self.path}/data/run={run}")
        )
        return run

    def read_run(self, run: str) -> DataFrame:
        """All rows of a run with their `embed_error` and bucket."""
        return (
            self.spark.read.schema(_WRITTEN)
            .option("basePath", f"{self.path}/data")
            .parquet(f"{self.path}/data/run={run}")
            .drop("run")
        )

    def discard_run(self, run: str) -> None:
        delete_path(self.spark, f"{self.path}/data/run={run}")

    def publish_runs(
        self,
        new: list[str],
        manifest: Manifest,
        max_id: int,
        dead: list[int] = (),
        batch: tuple[str, int] | None = None,
        group_run: str | None = None,
    ) -> None:
        """Make runs count, and the buckets they rewrote dead in the older ones."""
        runs = {
            old: sorted({*buckets, *dead})
            for old, buckets in manifest.runs.items()
            if len({*buckets, *dead}) < manifest.buckets
        }
        self._publish(
            manifest.next(
                runs={**runs, **{run: [] for run in new}},
                max_id=max(max_id, manifest.max_id),
                streams={**manifest.streams, **dict([batch] if batch else [])},
                group_runs=[*manifest.group_runs, *([group_run] if group_run else [])],
            )
        )

    def write_members(self, members: DataFrame) -> str:
        """Write (repo_url, label, rel, position, files) as a run that does not count yet."""
        run = uuid.uuid4().hex
        members.write.parquet(f"{self.path}/group_files/run={run}")
        return run

    def group_files(self) -> DataFrame:
        """Every path of the groups that chunks in group scope name, for the repositories
        in the index: those of the last job that brought a repository."""
        manifest = self.manifest()
        schema = "repo_url string, label string, rel string, position bigint, files bigint"
        if not manifest.group_runs:
            return self.spark.createDataFrame([], schema)
        base = f"{self.path}/group_files"
        paths = [f"{base}/run={run}" for run in manifest.group_runs]
        order = F.array_position(F.array(*[F.lit(r) for r in manifest.group_runs]), F.col("run"))
        rows = self.spark.read.schema(f"{schema}, run string").option("basePath", base)
        rows = rows.parquet(*paths).withColumn("_job", order)
        last = rows.groupBy("repo_url").agg(F.max("_job").alias("_job"))
        present = self.read(manifest).select("repo_url").distinct()
        last = last.join(present, "repo_url", "left_semi")
        return rows.join(last, ["repo_url", "_job"]).drop("_job", "run")

    def compact(self) -> None:
        """Join the live rows of all runs in one run."""
        manifest = self.manifest()
        rows = self.read(manifest)
        count, size = rows.agg(
            F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("content") + 4 * manifest.dim), F.lit(0))
        ).first()
        tasks = tasks_for(self.spark, -(-count // 1000), size)
        run = self.write_run(self.laid_out(rows.drop("repo_bucket"), manifest.buckets, tasks))
        if self.read_run(run).count() != count:
            self.discard_run(run)
            raise RuntimeError("a compacted run lost rows")
        self._publish(manifest.next(runs={run: []}))

    def vacuum(self, older_than_hours: float = 24) -> int:
        """Delete runs and versions that do not count and are older than that, which is to
        be longer than any job or read takes; returns how many."""
        manifest = self.manifest()
        limit = (time.time() - 3600 * older_than_hours) * 1000
        kept = {f"run={run}" for run in (*manifest.runs, *manifest.group_runs)}
        kept |= {f"v={manifest.version}"}
        gone = 0
        for folder in ("data", "group_files", "hashed", "manifest"):
            for name, changed in entries(self.spark, f"{self.path}/{folder}"):
                if name not in kept and changed <= limit:
                    gone += delete_path(self.spark, f"{self.path}/{folder}/{name}")
        return gone

    def buckets_of(self, repos: DataFrame, buckets: int) -> list[int]:
        """Buckets of some repositories: at most as many as the table has."""
        found = repos.select(repo_bucket(F.col("repo_url"), buckets).alias("b")).distinct()
        return sorted(row.b for row in found.collect())

    def without(self, repos: DataFrame, manifest: Manifest, touched: list[int]) -> DataFrame:
        """Rows of the touched buckets that belong to none of `repos`. Rows without
        a repository match nothing and stay."""
        rows = self.read(manifest).where(F.col("repo_bucket").isin(touched))
        return rows.join(repos.select("repo_url").distinct(), "repo_url", "left_anti")

    def rows_in(self, buckets: list[int], manifest: Manifest) -> int:
        return self.read(manifest).where(F.col("repo_bucket").isin(buckets)).count()

    def write_survivors(self, repos: DataFrame, manifest: Manifest, touched: list[int]) -> str:
        """Write what remains in the touched buckets without `repos` as a run."""
        return self.write_run(
            self.laid_out(self.without(repos, manifest, touched), manifest.buckets)
        )

    def delete(self, repos: DataFrame) -> int:
        """Delete the rows of `repos(repo_url)`; returns how many there were."""
        manifest = self.manifest()
        present = self.existing(repos.where(F.col("repo_url").isNotNull()))
        touched = self.buckets_of(present, manifest.buckets)
        if not touched:
            return 0
        run = self.write_survivors(present, manifest, touched)
        deleted = self.rows_in(touched, manifest) - self.read_run(run).count()
        self.publish_runs([run], manifest, 0, touched)
        return deleted

    def delete_repo(self, repo_url: str) -> int:
        return self.delete(self.spark.createDataFrame([(repo_url,)], "repo_url string"))

    def drop(self) -> None:
        """Remove the table and its data; does nothing where there is no table."""
        if self.exists():
            delete_path(self.spark, self.path)
