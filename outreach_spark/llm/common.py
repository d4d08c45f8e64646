"""Helpers shared by the operators: table reads, shared scratch tables, per-text Arrow maps, fold arithmetic."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A word of the contracts: a run of characters other than space and \t \n \v \f \r.
WORD_CLASS = r"[^\x20\x09-\x0D]+"
#: The same class as bytes, for bytes.translate.
WORD_BREAKS = b" \t\n\x0b\x0c\r"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, so that tasks can import it wherever the driver was started from.

    Called before a function is handed to Spark; once per application.
    """
    sc = spark.sparkContext
    package = Path(__file__).resolve().parents[1]
    if sc.applicationId in _SHIPPED or not package.is_dir():
        return
    path = os.path.join(tempfile.mkdtemp(prefix="llm-package-"), f"{package.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a scratch folder only where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="llm-work-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{work_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and the table
    outlives any executor."""
    ship_package(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % F.lit(modulus), F.lit(-1))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has (names compare without case in Spark)."""
    taken = {c.lower() for c in df.columns}
    name, n = f"__{stem}", 0
    while name.lower() in taken:
        n += 1
        name = f"__{stem}{n}"
    return name


def map_texts(
    docs: DataFrame,
    text_col: str,
    out_col: str,
    fields: T.StructType,
    make: Callable[[], Callable[[list[bytes]], list]],
) -> DataFrame:
    """``docs`` plus one struct column computed from the UTF-8 bytes of ``text_col`` (null text: empty bytes).

    ``make()`` runs once per task and returns a function from a list of texts to one list or Arrow array
    per field. The other columns pass through untouched, so clashing names need no care.
    """
    ship_package(docs.sparkSession)
    names = [*docs.columns, out_col]
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, fields, True)])
    kinds = [to_arrow_type(f.dataType) for f in fields.fields]
    arrow_fields = [pa.field(f.name, k, True) for f, k in zip(fields.fields, kinds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
            made = [x if isinstance(x, pa.Array) else pa.array(x, type=k) for x, k in zip(work(texts), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(made, fields=arrow_fields)], names=names)

    return docs.mapInArrow(run, schema)


def slices(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` characters or bytes in all, so that what a step holds per
    slice is bounded by the limit or by one text."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def local_file(spark: SparkSession, name: str, write: Callable[[str], None]) -> str:
    """Write a size-bounded file on the driver, hand it to every executor with ``addFile`` and return the
    name under which tasks find it (``SparkFiles.get``). Executors that join later fetch it too."""
    folder = tempfile.mkdtemp(prefix="llm-file-")
    unique = f"{name}-{uuid.uuid4().hex[:12]}"
    path = os.path.join(folder, unique)
    write(path)
    spark.sparkContext.addFile(path)
    return unique
