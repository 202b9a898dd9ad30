"""What the operators of this subpackage share: tables, shared storage, sorted group streams."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows in an Arrow batch: some very long texts in one batch must fit a Python worker.
BATCH_ROWS = 1000
#: For a shuffled join of whole tables with a few keys: a Bloom filter of these (8 MB at most) keeps most other rows from it.
BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "10g",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keeps Arrow batches of whole texts small; a setting already below ``rows`` stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings of the session while jobs run inside, and as they were afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; where that is unset, one set here, in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            import tempfile

            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")

            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="chronoweave-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get()
    return at.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cw-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cw_path = path  # type: ignore[attr-defined]
    return out


def discard(*frames: DataFrame) -> None:
    """Removes what :func:`materialize` wrote, when no lazy plan reads it any more."""
    for df in frames:
        path = getattr(df, "_cw_path", None)
        if path:
            spark = df.sparkSession
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once for a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_state: dict = {}


def worker_state(key, make: Callable):
    """What a Python worker keeps from one task to the next: the state of one use only. Workers outlive a stage, and the caches of an earlier one would stay beside those of the next."""
    if _state.get("key") != key:
        forget()
        _state["value"], _state["key"] = make(), key
    return _state["value"]


def forget() -> None:
    """Drops what a Python worker keeps."""
    if _state:
        _state.clear()
        gc.collect()


def give_back() -> None:
    """Gives freed memory of a Python worker back to the machine; Arrow and the C library would keep it for later."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable, keeps: bool) -> Callable:
    """``run`` over Arrow batches in a worker that others used before and will use afterwards."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def map_arrow(df: DataFrame, run: Callable, schema: str, keeps: bool = False) -> DataFrame:
    """df.mapInArrow. A worker holds no memory that the pass doesn't need: caches of an earlier use go (``keeps``: the pass has a :func:`worker_state`), and freed memory is given back after each task."""
    return df.mapInArrow(tidy(run, keeps), schema)


def crc_of_id(col: str = "doc_id") -> Column:
    return F.crc32(F.col(col).cast("string").cast("binary"))


def raw_texts(col: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each text, without decoding them."""
    return iter(col.cast(pa.large_binary()).to_pylist())


def grouped_stream(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of equal keys in a stream sorted by ``keys``; each with the slices that hold its rows."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    key: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), n]
        for a, b in zip(edges, edges[1:], strict=False):
            k = tuple(c[a].item() if hasattr(c[a], "item") else c[a] for c in cols)
            if k != key:
                if held:
                    yield key, held
                key, held = k, []
            held.append(batch.slice(a, b - a))
    if held:
        yield key, held
