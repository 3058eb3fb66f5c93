"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over all training windows.

A window is ``WINDOW`` consecutive words of an item; an item of fewer words, but not none, is one window. Hash hits are
verified word by word.

The set is broadcast while the items hold at most ``BROADCAST_BYTES``. Beyond that nothing that grows with the benchmark
is broadcast: windows of texts that pass a bit filter of bounded size are joined with the windows of the items, on all
their words, and what is found comes back to the texts. Both ways give the same results.
"""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import bit_table, blocks, list_array, materialize, may_hold, per_worker, small_batches, string_buffers
from tidewrack.llm.words import Words

WINDOW = 13
#: Bytes of item texts and ids that are broadcast at most.
BROADCAST_BYTES = 4 << 20
#: Bytes of document text hashed at a time, and verified windows that a worker remembers.
CHUNK, REMEMBERED = 1 << 18, 20_000


def _window_sizes(words: Words, n: int, window: int) -> np.ndarray:
    """Length of the windows of each of n items."""
    return np.minimum(np.bincount(words.text, minlength=n), window)


def _item_windows(words: Words, sizes: np.ndarray, size: int) -> np.ndarray:
    """First words of the windows of that length, in the items that have such windows."""
    at = np.arange(max(len(words.hash) - size + 1, 0))
    return at[(words.text[at] == words.text[at + size - 1]) & (sizes[words.text[at]] == size)]


class WindowSet:
    """Windows of the items by length: a bit filter of eight slots a window, sorted hashes, and places of the words."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        self.ids = [i for i, _ in items]
        data, offsets = string_buffers(pa.array([t for _, t in items], pa.string()))
        self.words = Words(data, offsets)
        sizes = _window_sizes(self.words, len(items), window)
        self.tables = {}
        for size in np.unique(sizes[sizes > 0]).tolist():
            at = _item_windows(self.words, sizes, size)
            h = self.words.windows(size)[at]
            order = np.argsort(h, kind="stable")
            mask = np.uint64((1 << (8 * len(at)).bit_length()) - 1)
            bits = np.zeros(int(mask) + 1, bool)
            bits[h & mask] = True
            self.tables[size] = bits, mask, h[order], at[order]
        self.known: dict[tuple[int, int], dict[bytes, tuple[int, ...]]] = {}

    def items_of(self, size: int, low: int, high: int) -> dict[bytes, tuple[int, ...]]:
        """Items of each window among the sorted places from low to high, which share a hash."""
        if (size, low) not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found: dict[bytes, set[int]] = {}
            for k in self.tables[size][3][low:high].tolist():
                found.setdefault(self.words.key(k, size), set()).add(int(self.words.text[k]))
            self.known[size, low] = {k: tuple(v) for k, v in found.items()}
        return self.known[size, low]

    def scan(self, texts: pa.Array) -> pa.Array:
        data, offsets = string_buffers(texts)
        n = len(offsets) - 1
        n_words, n_hit = np.zeros(n, np.int64), np.zeros(n, np.int64)
        items: list[set] = [set() for _ in range(n)]
        spans: list[np.ndarray] = []
        for a, b in blocks(offsets, CHUNK):
            words = Words(data, offsets[a : b + 1])
            n_words[a:b] = np.bincount(words.text, minlength=b - a)
            edge = np.zeros(len(words.hash) + 1, np.int64)
            for size, (bits, mask, hashes, _) in self.tables.items():
                h = words.windows(size)
                maybe = np.flatnonzero(bits[h & mask])
                maybe = maybe[words.text[maybe] == words.text[maybe + size - 1]]
                low, high = np.searchsorted(hashes, h[maybe], "left"), np.searchsorted(hashes, h[maybe], "right")
                for i, p, q in zip(maybe.tolist(), low.tolist(), high.tolist(), strict=True):
                    if p < q and (found := self.items_of(size, p, q).get(words.key(i, size))):
                        edge[i] += 1
                        edge[i + size] -= 1
                        items[a + words.text[i]].update(found)
            hit = np.cumsum(edge[:-1]) > 0
            n_hit[a:b] = np.bincount(words.text[hit], minlength=b - a)
            where = offsets[a] - offsets[a + words.text[hit]]
            spans.append(np.stack([words.start[hit] + where, words.end[hit] + where], 1).ravel())
        found = [sorted({self.ids[i] for i in x}) for x in items]
        return _hits(n_words, n_hit, found, np.concatenate(spans) if spans else np.zeros(0, np.int64))


def _hits(n_words: np.ndarray, n_hit: np.ndarray, ids: list, flat: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays(
        [pa.array(n_words), pa.array(n_hit), pa.array(ids, pa.list_(pa.string())), list_array(flat, 2 * n_hit, pa.int64())],
        ["n_words", "n_hit", "item_ids", "hit_bytes"],
    )


HITS = "struct<n_words: bigint, n_hit: bigint, item_ids: array<string>, hit_bytes: array<bigint>>"


def with_hits(rows: DataFrame, text: str, mark: str, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows with a struct column ``mark`` of hits (see ``HITS``; hit_bytes: start and end byte of every hit word).

    Null and word-less texts have no words and no hits; null items have no windows; a null item id is named "null", and
    items that repeat an id count once by it.
    """
    spark = rows.sparkSession
    small_batches(spark)
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.col(item_text).alias("t"))
    held = items.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + F.octet_length("i"))).first()[0] or 0
    if held > most_bytes:
        return _joined(rows, text, mark, items, window)
    shared, key = spark.sparkContext.broadcast([tuple(r) for r in items.collect()]), f"windows-{uuid.uuid4().hex}"

    def scan(texts: pa.Array) -> pa.Array:
        return per_worker(key, lambda: WindowSet(shared.value, window)).scan(texts)

    return rows.withColumn(mark, F.arrow_udf(scan, HITS)(F.col(text)))


_WINDOWS = pa.schema([("i", pa.string()), ("size", pa.int32()), ("h", pa.int64()), ("key", pa.binary())])
_CANDIDATES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("at", pa.int32()), ("size", pa.int32()), ("h", pa.int64()), ("key", pa.binary())])


def _windows_of(window: int):
    def run(batches):
        for batch in batches:
            data, offsets = string_buffers(batch.column(1))
            for a, b in blocks(offsets, CHUNK):
                words = Words(data, offsets[a : b + 1])
                sizes = _window_sizes(words, b - a, window)
                for size in np.unique(sizes[sizes > 0]).tolist():
                    at, h = _item_windows(words, sizes, size), words.windows(size).view(np.int64)
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(a + words.text[at])), pa.array(np.full(len(at), size, np.int32)),
                        pa.array(h[at]), pa.array([words.key(k, size) for k in at.tolist()], pa.binary()),
                    ], schema=_WINDOWS)

    return run


def _candidates(shared, sizes: list[int]):
    def run(batches):
        bits = shared.value
        mask = np.uint64(64 * len(bits) - 1)
        for batch in batches:
            data, offsets = string_buffers(batch.column(2))
            for a, b in blocks(offsets, CHUNK):
                words = Words(data, offsets[a : b + 1])
                first = np.searchsorted(words.text, np.arange(b - a))
                for size in sizes:
                    h = words.windows(size)
                    spot = (h & mask).astype(np.int64)
                    at = np.flatnonzero((bits[spot >> 6] >> (spot & 63)) & 1)
                    at = at[words.text[at] == words.text[at + size - 1]]
                    text = pa.array(a + words.text[at])
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(text), batch.column(1).take(text), pa.array((at - first[words.text[at]]).astype(np.int32)),
                        pa.array(np.full(len(at), size, np.int32)), pa.array(h[at].view(np.int64)), pa.array([words.key(k, size) for k in at.tolist()], pa.binary()),
                    ], schema=_CANDIDATES)

    return run


def _placed(texts: pa.Array, places: pa.Array, ids: pa.Array) -> pa.Array:
    """Hits of texts from the places (first word, length) and the items of their windows."""
    data, offsets = string_buffers(texts)
    n = len(offsets) - 1
    n_words, n_hit, spans = np.zeros(n, np.int64), np.zeros(n, np.int64), []
    for k in range(n):
        words = Words(data, offsets[k : k + 2])
        edge = np.zeros(len(words.hash) + 1, np.int64)
        for p in places[k].as_py() or ():
            edge[p["at"]] += 1
            edge[p["at"] + p["size"]] -= 1
        hit = np.cumsum(edge[:-1]) > 0
        n_words[k], n_hit[k] = len(words.hash), hit.sum()
        spans.append(np.stack([words.start[hit], words.end[hit]], 1).ravel())
    return _hits(n_words, n_hit, [x or [] for x in ids.to_pylist()], np.concatenate(spans) if spans else np.zeros(0, np.int64))


def _joined(rows: DataFrame, text: str, mark: str, items: DataFrame, window: int) -> DataFrame:
    """``with_hits`` by a join. Texts are known by two hashes; only those that may have hits are joined with them."""
    spark = rows.sparkSession
    windows = materialize(items.mapInArrow(_windows_of(window), "i string, size int, h bigint, key binary").distinct(), "windows")
    sizes = [r.size for r in windows.select("size").distinct().collect()]  # at most ``window`` of them
    shared = spark.sparkContext.broadcast(bit_table(windows.select("h"), "h"))
    names = [f"{mark}_{x}" for x in ("h1", "h2")]
    own = [F.xxhash64(F.lit(salt), F.coalesce(F.col(text), F.lit(""))) for salt in names]
    asked = rows.select(own[0].alias("h1"), own[1].alias("h2"), F.col(text).alias("t"))
    made = asked.mapInArrow(_candidates(shared, sizes), "h1 bigint, h2 bigint, at int, size int, h bigint, key binary").distinct()
    found = materialize(materialize(made, "candidates").join(windows, ["size", "h", "key"]).select("h1", "h2", "at", "size", "i"), "found")
    places = found.groupBy("h1", "h2").agg(F.collect_set(F.struct("at", "size")).alias("places"))
    ids = found.groupBy("h1", "h2").agg(F.array_sort(F.collect_set("i")).alias("ids"))
    hits = materialize(places.join(ids, ["h1", "h2"]), "hits")
    marked = rows.withColumns(dict(zip(names, own, strict=True)))
    maybe = may_hold(hits, "h1", "h2")(*[F.col(x) for x in names])
    near = marked.withColumn(f"{mark}_near", maybe)
    joined = near.filter(f"{mark}_near").join(hits.toDF(*names, f"{mark}_places", f"{mark}_ids"), names, "left")
    none = {f"{mark}_{x}": F.lit(None).cast(hits.schema[x].dataType) for x in ("places", "ids")}
    everything = joined.unionByName(near.filter(f"NOT {mark}_near").withColumns(none))
    done = everything.withColumn(mark, F.arrow_udf(_placed, HITS)(F.col(text), F.col(f"{mark}_places"), F.col(f"{mark}_ids")))
    return done.drop(*names, *none, f"{mark}_near")


def _contaminated(hits: str):
    return (F.col(f"{hits}.n_hit") > 0) & (20 * F.col(f"{hits}.n_hit") >= F.col(f"{hits}.n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_hit, item_ids (sorted), contaminated, hit_bytes.

    contaminated: n_hit > 0 and 20 * n_hit >= n_words. Repeated rows give repeated results; an empty table gives none;
    other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("t"))
    found = with_hits(rows, "t", "hits", benchmark, window=window, most_bytes=most_bytes)
    return found.select(F.col("k").alias(doc_id), "hits.n_words", "hits.n_hit", F.array_sort("hits.item_ids").alias("item_ids"), "hits.hit_bytes", _contaminated("hits").alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns; null texts stay."""
    mark = "__contamination"
    return with_hits(docs, text, mark, benchmark, most_bytes=most_bytes).filter(~_contaminated(mark)).select(*[F.col(f"`{c}`") for c in docs.columns])
