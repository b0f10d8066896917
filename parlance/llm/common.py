"""What the operators share: words, written intermediates, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.session import work_dir

#: White space of the contracts: blank and U+0009 to U+000D.
BLANKS = "[\\x20\\x09-\\x0D]+"
#: Text that one step of a Python task holds at once.
STEP_BYTES = 4 << 20


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{BLANKS}|{BLANKS}$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, BLANKS)
    )


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def stored(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """Written once into the shared folder and read back, so that lost executors cost no rerun
    of what led to it and several readers share it. A ``large`` table is compressed harder, and the
    shuffles that led to it are deleted with its last row, not when the driver collects garbage."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_deleted(spark) if large else contextlib.nullcontext():
        df.write.parquet(path, compression="zstd" if large else None)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that nothing reads any more."""
    for table in tables:
        files = table.inputFiles()
        if files:
            jvm = table.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What runs inside deletes its shuffle files as it ends; nothing else may read them later."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def small_batches(spark: SparkSession) -> None:
    """Limits the bytes of an Arrow batch for the session: texts are long, and a batch is held by
    the JVM and by the Python worker, once as input and once as output."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(name)).rstrip("b")) > STEP_BYTES:
        spark.conf.set(name, str(STEP_BYTES))


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def steps(
    batches: Iterator[pa.RecordBatch], text: str = "text", most: int = STEP_BYTES
) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of one hold about ``most`` bytes; one longer text is one batch.
    ``text`` may also be a column with the texts' sizes."""
    for batch in batches:
        sizes = batch.column(text)
        if not pa.types.is_integer(sizes.type):
            sizes = pc.binary_length(sizes)
        sizes = pc.fill_null(sizes, 0).to_numpy(False)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(batch):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()


def release() -> None:
    """Gives free memory of this worker process back; workers stay for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


class Tokens:
    """Words of a batch of texts (``flat``): ``codes`` into ``vocabulary``, text ``i`` at
    ``codes[offsets[i]:offsets[i + 1]]``. Null texts have no words."""

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if lower:
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten()
        lengths = np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
        full = pc.not_equal(flat, "")  # blanks at either end leave empty strings
        if not pc.all(full).as_py():
            keep = full.to_numpy(zero_copy_only=False)
            flat, owner = flat.filter(full), owner[keep]
        coded = flat.dictionary_encode()
        self.flat = flat
        self.vocabulary = coded.dictionary
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.owner = owner
        self.counts = np.bincount(owner, minlength=len(texts)).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.counts)])

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word of the vocabulary."""
        digest = xxhash.xxh3_64_intdigest
        found = (digest(word) for word in self.vocabulary.cast(pa.large_binary()).to_pylist())
        return np.fromiter(found, np.uint64, len(self.vocabulary))


def joined(flat: pa.Array, offsets: np.ndarray) -> pa.Array:
    """Words of each run ``flat[offsets[i]:offsets[i + 1]]``, with one blank between them."""
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat.cast(pa.large_string()))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def mixed(values: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (finaliser of a public hash function)."""
    values = values.astype(np.uint64, copy=True)
    values ^= values >> np.uint64(33)
    values *= np.uint64(0xFF51AFD7ED558CCD)
    values ^= values >> np.uint64(33)
    values *= np.uint64(0xC4CEB9FE1A85EC53)
    values ^= values >> np.uint64(33)
    return values


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every run of ``size`` entries, by position of its first entry."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += hashes[k : k + n]
        total ^= total >> np.uint64(29)
    return mixed(total)


def components(links: DataFrame) -> DataFrame:
    """Rows (a, b) of longs -> (node, root): smallest node each node is connected to.

    Alternates large-star and small-star steps, each a grouping by node with partial
    aggregation, until no link changes; every step is cut with a written table. The number of
    steps grows with the logarithm of the longest chain. Null ends and self links are ignored.
    """
    spark = links.sparkSession
    pairs = links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    pairs = pairs.where("a is not null and b is not null and a <> b").distinct()
    now, seen = stored(pairs, "links"), None
    while True:
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(
            now.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        )
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("m").alias("lo"), F.col("v").alias("hi")).union(
            least.select(F.col("m").alias("lo"), F.col("u").alias("hi"))
        )
        now = stored(small.where("lo <> hi").distinct(), "links")
        state = now.agg(
            F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))
        ).collect()[0]
        if state == seen:
            break
        seen = state
    roots = now.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root"))
    return roots.union(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    ).groupBy("node").agg(F.min("root").alias("root"))
