"""The model seam (section 2.11): a caller's function over batches of rows, and a table of its results.

The library ships no model and calls none; the function is the job's.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .state import committed_versions


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType) -> DataFrame:
    """Apply ``fn`` to Arrow batches of ``df`` (mapInPandas): one call per batch, never per row."""

    def run(batches):
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(run, schema)


def call_once(df: DataFrame, inputs: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], outputs: str, version: str, root: str,
              portions: int = 16) -> DataFrame:
    """``df`` with the ``outputs`` that ``fn`` gives for the columns ``inputs``, each distinct input being asked once, ever.

    Results are a table keyed by the sha-256 of the input (null and empty differ) under ``root/<version>``; a new version of the
    function is a new table. The inputs that the table lacks are asked in ``portions`` of their hashes, each committed when it
    is done, so a run that fails, or is repeated, asks again only for the portion that was under way. ``fn`` gets the inputs
    and returns one row per input in the same order.
    """
    spark, path = df.sparkSession, f"{root.rstrip('/')}/{version}"
    text = F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in inputs])
    keyed = df.withColumn("_key", F.sha2(text, 256))
    schema = StructType.fromDDL(f"_key string, {outputs}")
    names = [f.name for f in schema.fields[1:]]

    def known() -> DataFrame:
        done = [f"{path}/batch={b}" for b in committed_versions(spark, path, "batch=")]
        return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)

    def ask(batches):
        for pdf in batches:
            made = fn(pdf[inputs])
            out = made[names].reset_index(drop=True)
            out.insert(0, "_key", pdf["_key"].to_numpy())
            yield out

    todo = keyed.select("_key", *inputs).dropDuplicates(["_key"]).join(known().select("_key"), "_key", "left_anti")
    portion = F.conv(F.substring("_key", 1, 4), 16, 10).cast("int") % portions
    first = max(committed_versions(spark, path, "batch="), default=-1) + 1
    for p in range(portions):  # portions hold different keys, so none needs to look at another's results
        todo.filter(portion == p).mapInPandas(ask, schema).write.mode("overwrite").parquet(f"{path}/batch={first + p}")
    return keyed.join(known(), "_key", "left").select(*df.columns, *names)
