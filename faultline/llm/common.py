"""What the operators of this subpackage share: staged tables, size-checked joins, batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the separators of words in every operator here.
BLANKS = " \t\n\x0b\f\r"
#: A join side is broadcast only if it has at most so many rows, and so many bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 16 << 20
#: Text bytes that one step of a Python task works on at a time.
STEP_BYTES = 4 << 20


_staged: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local one if all run on this machine; else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and return the written table.

    Later steps read files instead of recomputing, so a lost executor costs no
    more than the tasks that it ran.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def staged_so_far() -> int:
    """A mark for discard."""
    return len(_staged)


def discard(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete the tables staged since a mark but those of keep, which are staged themselves; frames that read the others end with them."""
    kept = {getattr(df, "_staged_at", None) for df in keep}
    for path in _staged[since:]:
        if path not in kept:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _staged[since:] = [x for x in _staged[since:] if x in kept]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind value to a lambda variable, so that it is computed once per row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def fresh_name(name: str, df: DataFrame) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    return next(x for x in (f"{name}{'_' * k}" for k in range(1, len(taken) + 2)) if x not in taken)


def join_checked(big: DataFrame, small: DataFrame, on, how: str, row_bytes: int) -> DataFrame:
    """Join with small broadcast if its counted rows fit the bound, else by a shuffle that splits skewed keys.

    small is a staged table: counting it reads file footers only.
    """
    rows = small.count()
    if rows <= BROADCAST_ROWS and rows * row_bytes <= BROADCAST_BYTES:
        small = F.broadcast(small)
    return big.join(small, on, how)


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about limit bytes of the column each; a longer single row is a slice of its own."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def in_steps(column: str, work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch], limit: int = STEP_BYTES):
    """A mapInArrow function that applies work to each slice of each batch."""

    def run(batches):
        for batch in batches:
            for part in steps(batch, column, limit):
                out = work(part)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return run


def prefix_sums(counts: DataFrame, order: list[str], value: str, out: str, groups: list[str] | None = None) -> DataFrame:
    """Exclusive running sums of value in the given order; counts has one row per partition or bucket, never per record."""
    from pyspark.sql import Window

    w = Window.partitionBy(*(groups or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
