"""Shared pieces of the corpus operators: word hashing and written tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Words of a shingle and the similarity from which two texts are near-duplicates.
SHINGLE_WORDS = 5
SIMILARITY = 0.8

#: Bytes of text that are hashed at once.
BLOCK_BYTES = 1 << 18

_SPACES = b" \t\n\x0b\x0c\r"
_BASE = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHasher:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of an Arrow string column.

    A word's hash is a polynomial over random values of its bytes, taken from
    prefix sums, so that no Python object is made for a word. With ``lower``
    the letters A-Z count as a-z.
    """

    def __init__(self, lower: bool = True):
        values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if lower:
            values[65:91] = values[97:123]
        self.values = values
        self.space = np.zeros(256, bool)
        self.space[list(_SPACES)] = True
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            size = max(n, BLOCK_BYTES + 1)
            for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                setattr(self, name, np.cumprod(table, dtype=np.uint64))

    def _block(self, data: np.ndarray, edges: np.ndarray):
        """Word hashes, starts and ends in ``data``; texts begin at ``edges``."""
        n = len(data)
        if not n:
            z = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), z, z
        self._powers(n)
        space = self.space[data]
        begins = np.empty(n, bool)
        begins[0] = True
        begins[1:] = space[:-1]
        begins[edges[edges < n]] = True
        ends = np.empty(n, bool)
        ends[-1] = True
        ends[:-1] = space[1:]
        inner = edges[(edges > 0) & (edges < n)]
        ends[inner - 1] = True
        first, last = np.flatnonzero(begins & ~space), np.flatnonzero(ends & ~space)
        total = np.cumsum(self.values[data] * self.power[:n], dtype=np.uint64)
        before = np.where(first > 0, total[first - 1], np.uint64(0))
        return mix((total[last] - before) * self.inverse[first]), first, last + 1

    def words(self, column):
        """(hashes, offsets, starts, ends): text i has the hashes offsets[i]:offsets[i + 1].

        Starts and ends are byte positions in the text. A null text has no words.
        """
        data, at = string_buffers(column)
        n, hashes, starts, ends = len(at) - 1, [], [], []
        counts = np.zeros(n, np.int64)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK_BYTES, "right")) - 1)
            lo, hi = at[i], at[j]
            h, s, e = self._block(data[lo:hi], at[i:j] - lo)
            owner = np.searchsorted(at[i:j] - lo, s, "right") - 1
            counts[i:j] += np.bincount(owner, minlength=j - i)
            base = (at[i:j] - lo)[owner] if len(owner) else np.zeros(0, np.int64)
            hashes.append(h)
            starts.append(s - base)
            ends.append(e - base)
            i = j
        offsets = np.concatenate(([0], np.cumsum(counts)))
        cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        return cat(hashes, np.uint64), offsets, cat(starts, np.int64), cat(ends, np.int64)


def string_buffers(column):
    """The bytes and offsets of an Arrow string array; nulls are empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def shingles(hashes: np.ndarray, offsets: np.ndarray, words: int = SHINGLE_WORDS, whole: bool = True):
    """Hashes of all runs of ``words`` words, in order, with offsets by text.

    A text with fewer words, but at least one, has its whole sequence as one
    shingle if ``whole``, else none.
    """
    counts = np.diff(offsets)
    n = np.maximum(counts - words + 1, 0)
    if whole:
        n = np.where((counts > 0) & (counts < words), 1, n)
    out_at = np.concatenate(([0], np.cumsum(n)))
    if not out_at[-1]:
        return np.zeros(0, np.uint64), out_at
    total = len(hashes) - words + 1
    rolled = np.zeros(max(total, 0), np.uint64)
    for k in range(words):
        if total > 0:
            rolled *= np.uint64(_BASE)
            rolled += hashes[k : k + total]
    owner = np.repeat(np.arange(len(counts)), n)
    place = np.arange(out_at[-1]) - out_at[owner] + offsets[owner]
    long = counts[owner] >= words
    out = np.zeros(len(owner), np.uint64)
    out[long] = mix(rolled[place[long]])
    for i in np.flatnonzero((counts > 0) & (counts < words)) if whole else ():
        value = int(counts[i])
        for h in hashes[offsets[i] : offsets[i + 1]].tolist():
            value = (value * _BASE + h + 1) % (1 << 64)
        out[out_at[i]] = mix(np.array([value], np.uint64))[0]
    return out, out_at


# -- tables that all executors can read


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path below ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is taken, but only if driver and
    executors are one process.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="marketlab-")
        context.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/marketlab-{uuid.uuid4().hex}"
    _Made.paths.append(path)
    if not _Made.hooked:
        _Made.hooked = True
        atexit.register(_Made.drop, spark)
    return path


class _Made:
    paths: list[str] = []
    hooked = False

    @classmethod
    def drop(cls, spark: SparkSession) -> None:
        try:
            for p in cls.paths:
                remove(spark, p)
        except Exception:  # the session has ended: its folder goes with the cluster's
            pass


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark can write."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, which cuts its lineage."""
    return _table(df, shared_dir(df.sparkSession))


def _table(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one computation in the shared folder, which go when it ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, shared_dir(spark), 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        remove(self.spark, self.folder)
        _Made.paths.remove(self.folder)

    def written(self, df: DataFrame) -> DataFrame:
        self.n += 1
        return _table(df, f"{self.folder}/table-{self.n}")


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting of the session for the time of some jobs."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


# -- files of arrays in the shared folder


def filesystem(path: str):
    """(file system, path in it) of a path as Spark has it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = path[5:] if not path.startswith("file://") else path[7:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def put(folder: str, name: str, array: np.ndarray) -> None:
    """Writes an array; a retried task replaces the whole file."""
    files, base = filesystem(folder)
    files.create_dir(base, recursive=True)
    temp = f"{base}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(temp) as out:
        out.write(memoryview(np.ascontiguousarray(array)).cast("B") if array.size else b"")
    files.move(temp, f"{base}/{name}")


class Arrays:
    """Reads parts of files of 64-bit integers: mapped into memory where the folder is mounted, else by position."""

    def __init__(self, folder: str, most: int = 256):
        self.files, self.base = filesystem(folder)
        self.open, self.most = {}, most

    def __call__(self, name: str, at: int, n: int) -> np.ndarray:
        if name not in self.open:
            if len(self.open) >= self.most:
                self.open.pop(next(iter(self.open)))
            path = f"{self.base}/{name}"
            self.open[name] = np.memmap(path, "<u8", "r") if self.files.type_name == "local" else self.files.open_input_file(path)
        file = self.open[name]
        return np.asarray(file[at : at + n]) if isinstance(file, np.memmap) else np.frombuffer(file.read_at(8 * n, 8 * at), "<u8")


def buckets(spark: SparkSession) -> int:
    """How many parts keyed data is dealt to: it follows the session's shuffle partitions."""
    return max(48, int(spark.conf.get("spark.sql.shuffle.partitions")))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes of text that a worker holds arrays of at once.
SLICE_BYTES = 4 << 20


def slices(batches, column: str, most: int = SLICE_BYTES):
    """Parts of Arrow batches, in order, that hold about ``most`` bytes of a string column, and one text at least."""
    for batch in batches:
        _, at = string_buffers(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, len(at) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def column(batch, name: str):
    return batch.column(batch.schema.get_field_index(name))
