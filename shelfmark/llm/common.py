"""What the operators share: words, byte buffers, hashes, chunks and buckets.

Most exact operators here work in two meetings.  Documents are dealt into
*chunks* (some megabytes of text each); a chunk sends every key it holds
once to the key's *bucket*; a bucket sees all chunks that hold a key and sends
back one answer for each key it was sent.  A key that a third of all documents
hold therefore costs one record per chunk, not one per document, and no pairs.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What separates words; the rest of the text is words.
BLANKS = " \t\n\x0b\f\r"
BLANK_CLASS = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"

#: Megabytes of text in one chunk.
CHUNK_MB = 4
#: Keys in one bucket.
BUCKET_KEYS = 1 << 20
#: Bytes of text that are looked at together inside a task.
BLOCK = 1 << 20

_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[[ord(c) for c in BLANKS]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_fallback: dict[str, str] = {}


def work_path(spark: SparkSession, label: str) -> str:
    """A new folder name in the folder that driver and executors share."""
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        root = _fallback.setdefault(app, "") or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        _fallback[app] = root
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Runtime setting: the shuffle files of a query go when it ends, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of the working tables written so far in each open scope.
_scopes: list[list[str]] = []


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends here, and so do the shuffle files behind it."""
    spark = df.sparkSession
    path = work_path(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(build: Callable[[], DataFrame], label: str) -> DataFrame:
    """The result of ``build()`` as a table; the working tables that it took are removed."""
    _scopes.append([])
    try:
        rows = build()
        mine = _scopes.pop()
    except BaseException:
        _scopes.pop()
        raise
    out = stored(rows, label)
    files = out.sparkSession._jvm.org.apache.hadoop.fs
    conf = out.sparkSession._jsc.hadoopConfiguration()
    for path in mine:
        place = files.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """All words of a text, in order."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{BLANK_CLASS}+", -1))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- chunks ---------------------------------------------------------------

def text_bytes(docs: DataFrame, name: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(name)).alias("n")).first()["n"] or 0


def chunk_count(total: int) -> int:
    """Chunks for this many bytes of text: grows in proportion to the input."""
    return max(1, -(-int(total) // int(CHUNK_MB * 1e6)))


def dealt(docs: DataFrame, n: int, name: str = "text") -> DataFrame:
    """``docs`` with a ``chunk`` out of ``n``, by identity and text: hot ids and hot texts alone decide nothing."""
    return docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", name), F.lit(n)).cast("long"))


def quoted(name: str) -> str:
    """A column name as SQL takes it, whatever letters are in it."""
    return "`" + name.replace("`", "``") + "`"


def folded(docs: DataFrame, own: tuple[str, ...] = ("doc_id", "text", "source")) -> DataFrame:
    """``docs`` with all columns but ``own`` set aside in one, so that no name clashes with an operator's."""
    rest = [F.col(quoted(c)).alias(c) for c in docs.columns if c not in own]
    return docs.select(*[c for c in docs.columns if c in own], *([F.struct(*rest).alias("_rest")] if rest else []))


def unfolded(rows: DataFrame, columns: list[str], own: tuple[str, ...] = ("doc_id", "text", "source")) -> DataFrame:
    """The columns of documents again, in their order."""
    return rows.select(*[F.col(c) if c in own else F.col("_rest")[c].alias(c) for c in columns])


# --- buffers --------------------------------------------------------------

def buffers(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and where each row starts (one more at the end); null is empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = pc.fill_null(array.cast(pa.large_string()), "")
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = array.buffers()
    at = np.frombuffer(at, np.int64)[array.offset:array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def blocks(at: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a longer row stands alone."""
    first, n = 0, len(at) - 1
    while first < n:
        last = int(np.searchsorted(at, at[first] + most, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def lower_bytes(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each row (one more at the end)."""
    inside = ~_IS_BLANK[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, at)


# --- hashes ---------------------------------------------------------------

_random = np.random.default_rng(20240607)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers of the hash base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 2 * len(_powers), 4096), _BASE, dtype=np.uint64)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a one-to-one map)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    index = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    values = _BYTE[data[index + np.repeat(starts, sizes)]] * powers(int(sizes.max()))[index]
    return mixed(np.add.reduceat(values, first) + sizes.astype(np.uint64) * _BASE)


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of every ``size`` consecutive values (fewer values: none)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for k in range(1, size):
        out *= _BASE
        out += h[k:k + n]
    return mixed(out)


def row_windows(per_row: np.ndarray, size: int) -> np.ndarray:
    """Which of the windows over all words in a line stay inside one row; ``per_row``: words before each row."""
    n = int(per_row[-1]) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    ok = np.ones(n, dtype=bool)
    for edge in per_row[1:-1]:
        ok[max(0, edge - size + 1):min(n, edge)] = False
    return np.flatnonzero(ok)


# --- buckets --------------------------------------------------------------

ASKED = T.StructType([
    T.StructField("bucket", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("keys", T.BinaryType())])
ANSWERED = T.StructType([
    T.StructField("chunk", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("marks", T.BinaryType())])


def packed(keys: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of sorted 64-bit keys, byte planes one after another."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(blob: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def bucket_bounds(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where each bucket's keys start among sorted 64-bit keys; buckets split the key space evenly."""
    edges = np.array([(i << 64) // n_buckets for i in range(1, n_buckets)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)])).astype(np.int64)


def bucket_count(keys: float) -> int:
    """Buckets for about this many keys."""
    return max(1, -(-int(keys) // BUCKET_KEYS))


def asked(chunk: int, keys: np.ndarray, n_buckets: int, width: int) -> dict[str, list]:
    """Requests of a chunk: its distinct keys (sorted), each bucket's in one row.

    A bucket's keys lie in one range of the key space; what they share at the
    top is left out, and so many of the next bits are kept as fit ``width`` bytes.
    """
    at = bucket_bounds(keys, n_buckets)
    drop = np.uint64(max(0, 64 - (n_buckets.bit_length() - 1) - 8 * width))
    out: dict[str, list] = {"bucket": [], "chunk": [], "keys": []}
    for b in np.flatnonzero(np.diff(at)):
        low = np.uint64((int(b) << 64) // n_buckets)
        out["bucket"].append(int(b))
        out["chunk"].append(chunk)
        out["keys"].append(packed((keys[at[b]:at[b + 1]] - low) >> drop, width))
    return out


def asked_table(rows: dict[str, list]) -> pa.Table:
    return pa.table({"bucket": pa.array(rows["bucket"], pa.int32()), "chunk": pa.array(rows["chunk"], pa.int64()),
                     "keys": pa.array(rows["keys"], pa.binary())})


def answered(chunks: list[int], buckets: list[int], marks: list[bytes]) -> pa.Table:
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "bucket": pa.array(buckets, pa.int32()),
                     "marks": pa.array(marks, pa.binary())})


def held_elsewhere(width: int):
    """Bucket side, two marks for each key of each chunk: another chunk holds it as well; this chunk is the first to hold it."""

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        chunks, blobs = table.column("chunk").to_pylist(), table.column("keys").to_pylist()
        keys = [unpacked(b, width) for b in blobs]
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = every[order][1:] != every[order][:-1]
        group = np.cumsum(new) - 1
        often, first = np.zeros(len(order), bool), np.zeros(len(order), bool)
        often[order] = (np.bincount(group) > 1)[group]
        first[order] = new
        at = np.cumsum([len(k) for k in keys])[:-1]
        marks = [np.packbits(x).tobytes() + np.packbits(y).tobytes() for x, y in zip(np.split(often, at), np.split(first, at), strict=True)]
        return answered(chunks, table.column("bucket").to_pylist(), marks)

    return answer


def held_before(width: int, last: int):
    """Bucket side: for each key of each chunk, whether a chunk of a smaller number (capped at ``last``) holds it."""

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        chunks, blobs = table.column("chunk").to_pylist(), table.column("keys").to_pylist()
        keys = [unpacked(b, width) for b in blobs]
        every = np.concatenate(keys)
        sizes = np.array([len(k) for k in keys])
        place = np.repeat(np.minimum(chunks, last), sizes)
        order = np.argsort(every, kind="stable")
        first = np.ones(len(order), bool)
        first[1:] = every[order][1:] != every[order][:-1]
        least = place[order][np.flatnonzero(first)][np.cumsum(first) - 1]
        later = np.zeros(len(order), bool)
        later[order] = place[order] > least
        at = np.cumsum(sizes)[:-1]
        marks = [np.packbits(x).tobytes() for x in np.split(later, at)]
        return answered(chunks, table.column("bucket").to_pylist(), marks)

    return answer


def marked(keys: np.ndarray, n_buckets: int, answers: pa.Table, which: int = 0) -> np.ndarray:
    """The marks (number ``which``) that came back for a chunk's distinct keys, in their order."""
    at, out = bucket_bounds(keys, n_buckets), np.zeros(len(keys), bool)
    for b, blob in zip(answers.column("bucket").to_pylist(), answers.column("marks").to_pylist(), strict=True):
        n = int(at[b + 1] - at[b])
        bits = np.frombuffer(blob, np.uint8, -(-n // 8), which * -(-n // 8))
        out[at[b]:at[b + 1]] = np.unpackbits(bits, count=n).astype(bool)
    return out


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys."""
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def recurring(keys: np.ndarray, n_buckets: int, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which of a chunk's keys occur again, in the chunk or elsewhere, and which of them an earlier chunk holds."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    group = np.cumsum(new) - 1
    often = np.bincount(group) > 1 if len(keys) else np.zeros(0, bool)
    again, earlier = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order] = (often | marked(keys[order][new], n_buckets, answers))[group]
    earlier[order] = ~marked(keys[order][new], n_buckets, answers, 1)[group]
    return again, earlier
