"""Keyed tables without row updates: versioned snapshots and idempotent appends (K1-K5 sinks).

A new snapshot is computed lazily (``upsert_*``), written to a new ``version=N`` folder and
committed by Spark's ``_SUCCESS`` marker; readers take the highest committed version. A path
that is being read is never overwritten. Appends carry a content key so a replayed batch is a no-op.
All paths live under the shared folder named by ``spark.checkpoint.dir`` (or a table root given by the job).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def committed_versions(spark: SparkSession, root: str, prefix: str = "version=") -> list[int]:
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith(prefix) and fs.exists(st.getPath().suffix("/_SUCCESS")):
            out.append(int(name.split("=", 1)[1]))
    return sorted(out)


def read_latest(spark: SparkSession, root: str, schema=None) -> DataFrame | None:
    versions = committed_versions(spark, root)
    if not versions:
        return None
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(f"{root.rstrip('/')}/version={versions[-1]:09d}")


def write_snapshot(df: DataFrame, root: str, version: int | None = None) -> int:
    """Write ``df`` as the next version (or the given one). Returns the version.

    A version that is already committed raises: nothing is dropped or overwritten without notice."""
    spark = df.sparkSession
    versions = committed_versions(spark, root)
    v = (versions[-1] + 1 if versions else 0) if version is None else version
    if v in versions:
        raise ValueError(f"version {v} of {root} is already committed")
    df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/version={v:09d}")
    return v


def append_new(existing: DataFrame | None, incoming: DataFrame, key: str) -> DataFrame:
    """K4 / K5: rows of ``incoming`` whose key is new. Of different rows with one key in the batch the one with the smallest
    hash stays, so a retry keeps the same row; a row without a key is compared with none.

    The choice is made on (key, hash), so no text goes through a sorted aggregate; of the table only the keys that the batch
    names are kept (a semi-join, which a small batch makes a map-side one), before the anti-join."""
    cols = incoming.columns
    once = incoming.distinct().withColumn("_h", F.xxhash64(*cols))
    best = once.groupBy(F.col(key).alias("_k")).agg(F.min("_h").alias("_best"))
    new = once.join(best, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_h") == F.col("_best"))).select(*cols)
    if existing is None:
        return new
    named = existing.select(key).join(incoming.select(key), key, "left_semi")
    return new.join(named, key, "left_anti")


def append_rows(df: DataFrame, root: str, key: str, every: int = 64) -> DataFrame:
    """Append the rows whose ``key`` is not yet in the table at ``root``; returns the appended rows, read back from what was
    written.

    Every append is one committed folder ``rows/batch=N``, written once (one writer at a time; a folder without ``_SUCCESS``
    is nobody's and is written over). After ``every`` appends the folders are folded into one, sorted by key range.
    """
    spark = df.sparkSession
    done = committed_versions(spark, f"{root}/rows", "batch=")
    path = f"{root.rstrip('/')}/rows/batch={max(done, default=-1) + 1}"
    append_new(read_rows(spark, root) if done else None, df, key).write.mode("overwrite").parquet(path)
    new = spark.read.schema(df.schema).parquet(path)
    if len(done) >= every:
        return _fold_rows(spark, root, key, new)
    return new


def _fold_rows(spark: SparkSession, root: str, key: str, new: DataFrame) -> DataFrame:
    """All batches as one folder under the next number; the folders it holds are listed in ``folded`` before they go, so a
    reader never sees a row twice. The newest batch stays for who asked for it."""
    done = committed_versions(spark, f"{root}/rows", "batch=")
    old, last = done[:-1], done[-1]
    path = f"{root.rstrip('/')}/rows/batch={last + 1}"
    rows = spark.read.parquet(*[f"{root}/rows/batch={b}" for b in old if b not in _folded(spark, root)])
    spark.createDataFrame([(b, last + 1) for b in old], "batch bigint, into bigint").coalesce(1).write.mode("append").parquet(f"{root}/folded")
    rows.repartitionByRange(key).write.mode("overwrite").parquet(path)
    for b in old:
        fs, p = _fs(spark, f"{root}/rows/batch={b}")
        fs.delete(p, True)
    return new


def _folded(spark: SparkSession, root: str) -> set[int]:
    """Batches whose rows another committed batch holds."""
    fs, p = _fs(spark, f"{root}/folded")
    if not fs.exists(p):
        return set()
    done = set(committed_versions(spark, f"{root}/rows", "batch="))
    return {r.batch for r in spark.read.parquet(f"{root}/folded").collect() if r.into in done}  # one row per folded append


def read_rows(spark: SparkSession, root: str) -> DataFrame:
    """The table that ``append_rows`` keeps."""
    gone = _folded(spark, root)
    return spark.read.parquet(*[f"{root.rstrip('/')}/rows/batch={b}" for b in committed_versions(spark, f"{root}/rows", "batch=") if b not in gone])


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


class ChangedKeys:
    """The readable side of a stream's keyed state: the values live in Spark's state store, and every micro-batch adds the keys
    that it changed, with their new values, as rows under ``delta/batch=N``. The newest row of a key is its state.

    A batch that is committed is a replay and left alone. Deltas belong to the checkpoint whose id stands in ``owner``: a new
    checkpoint starts at batch 0 with an empty store, so it is refused instead of mixed in. After ``every`` deltas they are folded
    into ``base/version=N``, range-partitioned by key; the two newest bases and the deltas that they need are kept for readers.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], every: int = 50) -> None:
        self.spark, self.root, self.keys, self.every = spark, root.rstrip("/"), keys, every

    def owner(self) -> str | None:
        fs, p = _fs(self.spark, f"{self.root}/owner")
        return self.spark.read.text(f"{self.root}/owner").first().value if fs.exists(p) else None

    def check_owner(self, checkpoint: str) -> None:
        """Refuse a checkpoint that did not make this table."""
        fs, p = _fs(self.spark, f"{checkpoint.rstrip('/')}/metadata")
        mine = self.spark.read.schema("id string").json(str(p)).first().id if fs.exists(p) else None
        if self.owner() not in (None, mine):
            raise ValueError(f"{self.root} belongs to another stream checkpoint; migrate it or use a new folder")

    def put(self, changed: DataFrame, batch: int, owner: str) -> bool:
        """Add the changed rows of one batch. False when it was added before."""
        if self.owner() is None:
            self.spark.createDataFrame([(owner,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/owner")
        elif self.owner() != owner:
            raise ValueError(f"{self.root} belongs to another stream checkpoint; migrate it or use a new folder")
        deltas = committed_versions(self.spark, f"{self.root}/delta", "batch=")
        base = max(committed_versions(self.spark, f"{self.root}/base"), default=-1)
        if batch in deltas or batch <= base:
            return False
        changed.write.mode("overwrite").parquet(f"{self.root}/delta/batch={batch}")
        if len([d for d in deltas if d > base]) + 1 >= self.every:
            self.fold(batch)
        return True

    def _rows(self) -> tuple[DataFrame | None, int]:
        base = max(committed_versions(self.spark, f"{self.root}/base"), default=-1)
        paths = [f"{self.root}/delta/batch={d}" for d in committed_versions(self.spark, f"{self.root}/delta", "batch=") if d > base]
        rows = None
        if paths:
            rows = self.spark.read.option("basePath", f"{self.root}/delta").parquet(*paths).withColumnRenamed("batch", "_batch")
        if base >= 0:
            folded = self.spark.read.parquet(f"{self.root}/base/version={base:09d}").withColumn("_batch", F.lit(-1))
            rows = folded if rows is None else rows.unionByName(folded)
        return rows, base

    def read(self) -> DataFrame | None:
        """One row per key, or None before the first batch. The newest batch number is found on (key, number) alone."""
        rows, _ = self._rows()
        if rows is None:
            return None
        newest = rows.groupBy(*self.keys).agg(F.max("_batch").alias("_batch"))
        return rows.join(newest, [*self.keys, "_batch"]).drop("_batch")

    def fold(self, upto: int) -> None:
        """Write the state as a base that holds all batches up to ``upto`` and drop what no reader needs any more."""
        self.read().repartitionByRange(*self.keys).write.mode("overwrite").parquet(f"{self.root}/base/version={upto:09d}")
        bases = committed_versions(self.spark, f"{self.root}/base")
        keep_from = bases[-2] if len(bases) > 1 else -1
        gone = [f"base/version={b:09d}" for b in bases[:-2]]
        gone += [f"delta/batch={d}" for d in committed_versions(self.spark, f"{self.root}/delta", "batch=") if d <= keep_from]
        for name in gone:
            fs, p = _fs(self.spark, f"{self.root}/{name}")
            fs.delete(p, True)


def write_clustered(df: DataFrame, table: str, path: str, keys: list[str], buckets: int) -> None:
    """Write a history table bucketed and sorted by its join keys (at ``path``, a new folder per version), so that the daily joins
    on them shuffle the day's rows only. Buckets hold some hundred MB each; both sides of a join must agree on them."""
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).mode("errorifexists").saveAsTable(table)


def read_clustered(spark: SparkSession, table: str, path: str, schema, keys: list[str], buckets: int) -> DataFrame:
    """The table that ``write_clustered`` wrote, in this session or another: where the session's catalog does not know it, it is
    declared over its folder."""
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        by = ", ".join(f"`{k}`" for k in keys)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)
