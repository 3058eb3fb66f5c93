"""Shared plumbing of the training-data operators: shared scratch tables, Arrow text access, labelled samples."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir`` where the cluster sets it, else one in the warehouse."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return root.rstrip("/")


_FOLDERS: set[str] = set()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's scratch folder, which goes when the driver's JVM ends."""
    folder = f"{scratch_root(spark)}/tidewrack/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _FOLDERS.add(folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` once as a table in the shared folder and return the scan of it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, wherever they run."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        home = Path(__file__).resolve().parents[1]
        name = Path(tempfile.mkdtemp(prefix="tidewrack-")) / "tidewrack.zip"
        with zipfile.ZipFile(name, "w") as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, f"{home.name}/{f.relative_to(home)}")
        context.addPyFile(str(name))
        _SHIPPED.add(context.applicationId)


#: Bytes of rows that are sent to a Python worker at a time.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Send at most about BATCH_BYTES at a time to Python workers, unless the session asks for less.

    This lowers a setting of the session for good: Spark reads it when a lazy result is run at last. It changes no result.
    """
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps: they go once the driver has collected what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: The C library's way to return free memory, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Give what a Python worker has freed back to the system, as idle workers stay beside those of later steps."""
    gc.collect(0)
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def forget(df: DataFrame) -> None:
    """Delete a table written by ``materialize`` that nothing reads any more."""
    jvm, spark = df.sparkSession.sparkContext._jvm, df.sparkSession
    for folder in _folders(df):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _folders(df: DataFrame) -> set[str]:
    return {folder for f in df.inputFiles() if "/tidewrack/" in (folder := f.rsplit("/", 1)[0])}


#: Bytes that a task may hold in a hash table, and how much larger rows are there than in a written table.
HASH_BYTES, SWELL = 64 << 20, 8


def hashed(side: DataFrame, *written: DataFrame) -> DataFrame:
    """``side`` of a join with a hint to hash it, if the written tables that it is made of (itself, if none are given) are
    small enough for that in every partition. A hash table can't spill; beyond this size joins sort."""
    spark = side.sparkSession
    size = 0
    for folder in set().union(*(_folders(w) for w in written or (side,))):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        size += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    fits = SWELL * size <= HASH_BYTES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return side.hint("shuffle_hash") if fits else side


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(column, modulus: int):
    """crc32(id as text) mod ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of an Arrow string array, without copying; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1] or b"\0" * 8, np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data, offsets


def blocks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``most`` bytes; a longer text is a range of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


def list_array(values: np.ndarray, lengths, kind: pa.DataType) -> pa.Array:
    """A list array of the given row lengths over flat values."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _share(rows: DataFrame, spot: Column, n: int, most: int) -> DataFrame:
    """Of about ``n`` different rows, a share by their hash ``spot`` that holds ``most`` of them and some more."""
    share = (1.2 * most + 1000) / max(n, 1)
    return rows if share >= 1 else rows.filter(spot < int(share * 2**64 - 2**63))


def bounded_keys(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows of unique keys, those of the least hashes: all rows where there are no more."""
    spot = F.xxhash64(F.lit("sample"), key)
    return _share(rows, spot, rows.count(), most).orderBy(spot, key).limit(most)


def training_texts(rows: DataFrame, most: int, most_chars: int) -> pa.Table:
    """At most ``most`` rows (k, text, more columns) on the driver, with at most ``most_chars`` characters of text.

    Rows of equal k and text count once. Where there are more, rows are taken in the order of a hash of k and text, and a
    text that doesn't fit into what is left of the characters is passed over. The driver sees the keys and lengths of
    ``most`` rows before it fetches texts.
    """
    rows = rows.withColumn("th", F.xxhash64("text"))
    spot = F.xxhash64(F.lit("row"), "k", "th")
    n = rows.agg(F.approx_count_distinct(spot)).first()[0]
    others = [c for c in rows.columns if c not in ("k", "th", "text")]
    once = _share(rows, spot, n, most).groupBy("k", "th").agg(F.min("text").alias("text"), *[F.max(c).alias(c) for c in others])
    held = materialize(once, "sample")
    chosen, left = [], most_chars
    for r in held.select("k", "th", F.length("text").alias("n")).orderBy(spot, "k", "th").limit(most).collect():
        if r.n <= left:
            chosen.append((r.k, r.th))
            left -= r.n
    wanted = held.sparkSession.createDataFrame(chosen, held.select("k", "th").schema)
    match = held["k"].eqNullSafe(wanted["k"]) & (held["th"] == wanted["th"])
    got = held.join(F.broadcast(wanted), match, "left_semi").select("k", "text", *others).toArrow()
    forget(held)
    return got


_BUILT: dict[str, object] = {}
#: Models that a Python worker keeps; the oldest goes first.
KEPT = 2


def per_worker(key: str, build):
    """What ``build`` makes, once for each key in a Python worker, which remembers the last few keys only."""
    if key not in _BUILT:
        while len(_BUILT) >= KEPT:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[key] = build()
    return _BUILT[key]


_TABLES: dict[str, np.ndarray] = {}


def code_table(kind: str) -> np.ndarray:
    """Code of every code point: itself if ``kind`` (a str method) holds for it, else a space."""
    if kind not in _TABLES:
        test = getattr(str, kind)
        _TABLES[kind] = np.fromiter((i if test(chr(i)) else 32 for i in range(0x110000)), np.uint32, 0x110000)
    return _TABLES[kind]


def codes(texts: list[str], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased characters of all texts in one array, each text between two spaces, runs of spaces as one; n + 1 starts."""
    raw = np.frombuffer("\x00".join([f" {t.lower()} " for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    mapped = code_table(kind)[raw]
    ends = np.flatnonzero(raw == 0)
    if len(ends) != len(texts) - 1:  # texts with such a character of their own
        sizes = [len(t.lower()) + 2 for t in texts]
        ends = np.cumsum(sizes)[:-1] + np.arange(len(texts) - 1)
    keep = np.ones(len(mapped), bool)
    keep[1:] = (mapped[1:] != 32) | (mapped[:-1] != 32)
    keep[ends] = True
    if len(ends):
        keep[ends + 1] = True
        keep[np.maximum(ends - 1, 0)] |= mapped[np.maximum(ends - 1, 0)] != 32
    keep[ends] = False
    at = np.concatenate([[0], np.cumsum(keep)])
    starts = np.concatenate([[0], at[ends + 1], [at[-1]]]) if len(texts) else np.zeros(1, np.int64)
    return mapped[keep], starts.astype(np.int64)


def ngram_hashes(chars: np.ndarray, starts: np.ndarray, sizes: tuple[int, ...], bits: int) -> list[np.ndarray]:
    """Hash of the n-gram at every character for each size; 0 where it would reach beyond its text."""
    out, h = [], chars * np.uint32(0x9E3779B1)
    ends = starts[1:]
    for n in range(2, max(sizes) + 1):
        h = h[:-1] * np.uint32(0x01000193) + (chars[n - 1 :] ^ (chars[n - 1 :] << np.uint32(15))) if len(h) > 1 else h[:0]
        if n in sizes:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            x = np.maximum(mixed >> np.uint32(32 - bits), np.uint32(1))
            over = (ends[:, None] - np.arange(1, n)).ravel()
            x[over[(over >= 0) & (over < len(x))]] = 0
            out.append(x)
    return out


#: Bits of a membership filter at most (8 MB): beyond it the filter only lets more rows pass that a join then drops.
FILTER_BITS = 1 << 26


def bit_table(hashes: DataFrame, name: str) -> np.ndarray:
    """A bit filter of a bigint column of hashes: bit ``hash mod bits`` of 64-bit words, 16 bits a row up to FILTER_BITS."""
    bits = 1 << min((16 * hashes.count() + 1024).bit_length(), FILTER_BITS.bit_length() - 1)
    spot = F.col(name).bitwiseAND(F.lit(bits - 1).cast("bigint"))
    words = hashes.select(spot.alias("h")).groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(h & 63))")).alias("b")).toArrow()
    table_ = np.zeros(bits // 64, np.int64)
    table_[words["w"].to_numpy()] = words["b"].to_numpy()
    return table_


def may_hold(keys: DataFrame, *names: str):
    """A test of bigint columns that is true for all rows of ``keys`` and false for most other rows.

    Rows that fail it need not be shuffled for a join with ``keys``. The filter is bounded, whatever the number of keys,
    so that it can be broadcast.
    """
    spark = keys.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(bit_table(keys.select(F.xxhash64(*names).alias("h")), "h"))

    def test(h):
        at = h.to_numpy(zero_copy_only=False) & (64 * len(shared.value) - 1)
        return pa.array((shared.value[at >> 6] >> (at & 63)) & 1 > 0)

    test.__annotations__ = {"h": pa.Array, "return": pa.Array}
    run = F.arrow_udf(test, "boolean")
    return lambda *columns: run(F.xxhash64(*columns))


#: Bits of ``narrowed``'s filter at most: a quarter of a million rows to broadcast.
NATIVE_BITS = 1 << 24


def narrowed(rows: DataFrame, keys: DataFrame, *names: str) -> DataFrame:
    """The rows whose columns ``names`` may be among those of ``keys``, by a bounded bit filter like that of ``may_hold``, but
    in Spark's own functions: words of it are broadcast and joined."""
    bits = 1 << min((16 * keys.count() + 1024).bit_length(), NATIVE_BITS.bit_length() - 1)
    spot = F.xxhash64(*names).bitwiseAND(F.lit(bits - 1).cast("bigint"))
    words = keys.select(spot.alias("h")).groupBy(F.shiftright("h", 6).alias("__word")).agg(F.expr("bit_or(shiftleft(1L, int(h & 63)))").alias("__bits"))
    marked = rows.withColumn("__spot", spot)
    near = marked.join(F.broadcast(words), F.shiftright(marked["__spot"], 6) == words["__word"])
    return near.filter("shiftright(__bits, int(__spot & 63)) & 1 = 1").select(*rows.columns)
