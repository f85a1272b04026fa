"""What the operators of this subpackage share."""

import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.sources.storage import scratch_path

#: ASCII white space, as a character class for Java and Python patterns; bytes.split() splits on the same set.
SPACE = r"\x20\x09-\x0D"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
NULL_ID = -2 ** 63


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """The UTF-8 words of a text, split on ASCII white space; a null text has none."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.translate(LOWER) if lower else data).split()


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written to a new folder in the shared scratch space and read back, and that folder: later plans start from its files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialised(df: DataFrame, name: str) -> DataFrame:
    """df by way of a folder that stays until its scratch scope or the cluster ends."""
    return stored(df, name)[0]


#: Bytes of an Arrow batch between the JVM and a Python worker; both sides hold one, the JVM beside its heap.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the bytes of Arrow batches, if it is higher: texts of 10 KB make 64 MB of a default batch."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).lower()
    if not now.removesuffix("b").isdigit() or int(now.removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def settle(spark: SparkSession) -> None:
    """Between the stages of a long session: small Arrow batches, and the driver gives back what finished queries left.

    Plans, broadcasts and results of earlier stages are garbage by now; the driver's heap shrinks only when it is collected.
    """
    small_batches(spark)
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``size`` bytes of text, one row at least."""
    weight = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            weight += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = held = 0
    for at, n in enumerate(weight.tolist()):
        if at > start and (held + n > size or at - start >= rows):
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


def by_batch(make: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch], schema: pa.Schema, rows: int = 2048, size: int = 4 << 20):
    """A mapInArrow function that calls make on slices bounded in rows and bytes, whatever the session's batch size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows, size):
                found = make(part)
                for out in found.to_batches() if isinstance(found, pa.Table) else [found]:
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out.columns, schema)], schema=schema)
    return run


class WordHashes(dict):
    """64-bit hashes of words, remembered for as many words as fit a bound."""

    LIMIT = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def word_hashes(texts: Sequence[str | None], known: WordHashes, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts, where each text begins in them and the end)."""
    parts, edges = [], [0]
    for text in texts:
        words = words_of(text, lower)
        parts.append(np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words)))
        edges.append(edges[-1] + len(words))
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64), np.array(edges)


def mixed(values: np.ndarray, salt: int) -> np.ndarray:
    """A bijective 64-bit mix of the values."""
    with np.errstate(over="ignore"):
        x = values ^ np.uint64(salt * 0x9E3779B97F4A7C15 % 2 ** 64)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def set_aside(docs: DataFrame, core: Sequence[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but the core ones under names that no operator uses, and what gives them back their own."""
    others = {c: f"other_{i}" for i, c in enumerate(docs.columns) if c not in core}

    def restore(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(others.get(c, f"`{c}`")).alias(c) for c in docs.columns])
    return docs.withColumnsRenamed(others), restore
