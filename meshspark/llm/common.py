"""What the operators share: work tables in the shared folder, and text as flat numpy arrays."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GOLD = np.uint64(0x9E3779B97F4A7C15)


def lean(spark: SparkSession) -> None:
    """Texts go to Python in batches of 1,000 rows and 16 MB, where the session has Spark's own 10,000 rows:
    two workers share an executor's memory, and texts can be long."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A folder of this machine is
    taken only where the setting is absent and Spark runs in this one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.gettempdir() + "/meshspark-work"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


class Work:
    """Parquet tables in the shared folder. They cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/work-{uuid.uuid4().hex}", 0
        lean(spark)
        atexit.register(self._leave)

    def _leave(self) -> None:
        """What a lazy result still reads stays until the program ends."""
        with contextlib.suppress(Exception):
            self.drop()

    def path(self, name: str = "t") -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str = "t", **options: str) -> DataFrame:
        at = self.path(name)
        df.write.options(**({"compression": "zstd"} | options)).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def size(self, df: DataFrame) -> int:
        """Bytes of a saved table's files."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        names = sorted({f.rpartition("/")[0] for f in df.inputFiles()})
        return sum(jvm.org.apache.hadoop.fs.Path(x).getFileSystem(conf).getContentSummary(jvm.org.apache.hadoop.fs.Path(x)).getLength() for x in names)

    def drop(self, df: DataFrame | None = None) -> None:
        """Remove the files of a saved table that nothing reads any more; without one, everything."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        names = [self.root] if df is None else sorted({f.rpartition("/")[0] for f in df.inputFiles()})
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(name)
            at.getFileSystem(conf).delete(at, True)

    def release(self) -> None:
        """Let Spark remove the shuffle files of plans that nothing refers to any more; it does so when
        the driver collects its garbage, which may otherwise be long after."""
        gc.collect()
        self.spark._jvm.System.gc()

    def result(self, df: DataFrame) -> DataFrame:
        """A small result, checkpointed, so that the work tables can go. Spark removes the checkpoint
        once nothing refers to it, where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
        if not self.spark.sparkContext.getCheckpointDir():
            self.spark.sparkContext.setCheckpointDir(shared_dir(self.spark))
        out = df.checkpoint()
        self.drop()
        return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, in whatever case."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def row_key() -> Column:
    """A row by its doc_id and text, in 64 bits; rows that agree in both share it."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs but for the rows of these keys (one column, distinct)."""
    (name,) = fresh(docs, "dropped_row")
    return docs.join(keys.toDF(name), row_key() == F.col(name), "left_anti")


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.large_binary(), pa.large_string()):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"" if column.type == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, most: int = 1 << 19):
    """(first, end) runs of texts of about `most` bytes together; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE, _POWERS, _INVERSES = 0xD1342543DE82EF95, [np.ones(1, np.uint64)], [np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and their inverses."""
    if len(_POWERS[0]) < n:
        n = max(n, 2 * len(_POWERS[0]))
        for kept, base in ((_POWERS, _BASE), (_INVERSES, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            kept[0] = np.multiply.accumulate(steps)
    return _POWERS[0], _INVERSES[0]


class Spans:
    """64-bit hashes of byte spans of a text: polynomial prefix sums, then mixed with the length."""

    def __init__(self, body: np.ndarray):
        up, self.down = _powers(len(body) + 1)
        self.sums = np.zeros(len(body) + 1, np.uint64)
        np.cumsum((mix(np.arange(1, 257, dtype=np.uint64) * GOLD))[body] * up[: len(body)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * GOLD)
