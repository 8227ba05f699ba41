"""What the operators share: the document view, batch slicing, partition counts and saved tables."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import inspect
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.sources.io import work_folder

#: How the names of folders with saved tables begin.
OWN_PREFIX = "codesieve-saved-"
#: Bytes of text that an operator holds in its working arrays at a time.
SLICE_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a data folder; Spark's own reader opens the path."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def view(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that other columns can't clash; a null text is the empty text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def spare(columns: list[str], *names: str) -> list[str]:
    """Column names that none of `columns` has, one for each of `names`."""
    prefix = "cs"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = f"x{prefix}"
    return [f"{prefix}_{name}" for name in names]


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session sets."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_size(docs: DataFrame) -> int:
    """Bytes of all texts of a view, by one pass."""
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def dealt(target: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each number that stands in an array, in order, and its places."""
    order = np.argsort(target, kind="stable")
    cuts = np.flatnonzero(np.append(True, target[order][1:] != target[order][:-1])[: len(target)])
    return [(int(target[x[0]]), x) for x in np.split(order, cuts[1:])] if len(target) else []


def fold(modulus: int, remainder: int) -> F.Column:
    """Whether crc32(doc_id as text) leaves the remainder; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def sliced(batch: pa.RecordBatch | pa.Table, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch | pa.Table]:
    """The batch in runs of rows with about `most` bytes of text each, a longer text alone."""
    sizes = np.cumsum(byte_lengths(batch.column(column)))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def byte_lengths(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array with no offset and 64-bit offsets."""
    column = pa.chunked_array([column]) if isinstance(column, pa.Array) else column
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary())
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a column one after the other, and where each row starts and the last ends."""
    array = flat(column)
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8) if len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8) if len(array) and array.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array | pa.ChunkedArray, lower: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words [^\\x20\\x09-\\x0D]+ in order of first use, the word number of each token, and where each row's tokens start."""
    import pyarrow.compute as pc

    array = flat(column)
    if lower:
        array = pc.ascii_lower(array)
    lists = pc.ascii_split_whitespace(array)
    starts = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.slice(int(starts[0]), int(starts[-1] - starts[0]))
    starts = starts - starts[0]
    full = pc.binary_length(values).to_numpy(zero_copy_only=False) > 0
    if not full.all():  # an empty piece stands before leading and after trailing white space
        kept = np.concatenate([[0], np.cumsum(full)])
        values, starts = values.filter(pa.array(full)), kept[starts]
    coded = values.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), starts


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each row's values; 0 for an empty row. starts has one entry more than there are rows."""
    out = np.zeros(len(starts) - 1, values.dtype)
    some = np.flatnonzero(np.diff(starts))
    if len(some):
        out[some] = np.add.reduceat(values, starts[some])
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i] + 1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on unsigned 64-bit values that spreads them evenly."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


#: What operators keep in a Python worker from one task to the next, by operator.
KEPT: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """A dictionary that lasts in a worker until a task of another operator begins there (see `lean`)."""
    return KEPT.setdefault(operator, {})


def forget(own: str = "") -> None:
    """Empty what operators but one keep."""
    for operator, things in KEPT.items():
        if operator != own:
            things.clear()


def give_back() -> None:
    """Return to the system what Python, NumPy and Arrow have freed and would hold for the process's next use; of the first two only where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(f: Callable, own: str = "") -> Callable:
    """A function for mapInArrow or applyInArrow that leaves its worker small: workers live on with all that they have, and an executor has several.

    Before it runs, what operators other than `own` keep goes; after a task's batches, or a group, freed memory is given back.
    """
    if inspect.isgeneratorfunction(f):

        def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget(own)
            try:
                yield from f(rows)
            finally:
                give_back()

        return functools.wraps(f)(batches)

    def group(table: pa.Table) -> pa.Table:
        forget(own)
        try:
            return f(table)
        finally:
            give_back()

    def groups(left: pa.Table, right: pa.Table) -> pa.Table:
        forget(own)
        try:
            return f(left, right)
        finally:
            give_back()

    return functools.wraps(f)(groups if len(inspect.signature(f).parameters) == 2 else group)


def hash_words(dictionary: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same on every machine."""
    import pandas as pd

    return pd.util.hash_array(np.asarray(dictionary.to_pylist(), dtype=object), categorize=False) if len(dictionary) else np.zeros(0, np.uint64)


class Saved:
    """Tables written to the shared folder: they cut lineage, so a lost executor repeats one step and not all."""

    def __init__(self, spark: SparkSession):
        self.spark, self.home, self.paths = spark, f"{work_folder(spark)}/{OWN_PREFIX}{uuid.uuid4().hex}", []

    def save(self, table: DataFrame, name: str = "t") -> DataFrame:
        path = f"{self.home}/{name}-{len(self.paths)}"
        table.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(table.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        release(*tables)

    def last(self, table: DataFrame, name: str = "t") -> DataFrame:
        """Save a result and delete every other table that was saved here."""
        others, out = list(self.paths), self.save(table, name)
        delete(self.spark, others)
        self.paths = self.paths[-1:]
        return out


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(*tables: DataFrame) -> None:
    """Delete the saved tables that these read, once their own rows are saved or not needed; other files stay."""
    for table in tables:
        paths = {file.rpartition("/")[0] for file in table.inputFiles()}
        delete(table.sparkSession, [x for x in paths if x.rpartition("/")[0].rpartition("/")[2].startswith(OWN_PREFIX)])
