"""What the operators of this package share: shared storage, code shipping, text batches."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Collection, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "[^\\x20\\x09-\\x0D]+"

#: Bytes of text that one numpy pass works on; it bounds a worker's memory whatever Arrow's batch size.
SLICE_BYTES = 1 << 20

_shipped: set[str] = set()
_staged: list[tuple[str, str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and all runs on one machine, as in tests, an own temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: later steps start from files that no executor owns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append((spark.sparkContext.applicationId, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession, after: int = 0, keep: Collection[str] = ()) -> int:
    """Delete the tables that ``stage`` wrote in this application, when no result that reads them is needed any more.

    With ``after`` the first tables stay, and those in ``keep`` too.
    """
    own = [path for app, path in _staged if app == spark.sparkContext.applicationId][after:]
    own = [path for path in own if path not in keep]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in own:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    _staged[:] = [x for x in _staged if x[1] not in own]
    return len(own)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is staged inside is deleted at the end, but for what the yielded function stages."""
    before = sum(app == spark.sparkContext.applicationId for app, _ in _staged)
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        out = stage(df)
        kept.append(_staged[-1][1])
        return out

    yield keep
    drop_staged(spark, before, kept)


def key_of(df: DataFrame, columns: list[str], *salt: int) -> Column:
    """A hash of a row over the named columns; maps, which have no order, are left out."""
    return F.xxhash64(*map(F.lit, salt), *[F.col(f"`{c}`") for c in columns if df.schema[c].dataType.typeName() != "map"])


def whole(df: DataFrame, columns: list[str]) -> Column:
    """The named columns as one struct called doc: beside it an operator's own columns clash with none."""
    return (F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.struct(F.lit(1))).alias("doc")


def parts(columns: list[str]) -> list[Column]:
    """The columns of the struct that ``whole`` made."""
    return [F.col("doc").getField(c).alias(c) for c in columns]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets, without a copy of the bytes; nulls are empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, n + 1, column.offset * 4).astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``most`` bytes of ``text``; a longer text is a slice of its own."""
    k = batch.schema.get_field_index(text)
    _, at = utf8(batch.column(k))
    begin, n = 0, batch.num_rows
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start[i] to start[i] + n[i] - 1, for all i end to end."""
    return np.repeat(start + n - np.cumsum(n), n) + np.arange(n.sum())


def single_threaded() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
