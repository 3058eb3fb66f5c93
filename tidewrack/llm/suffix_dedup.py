"""Removal of repeated byte strings by distributed prefix doubling, as for suffix arrays.

Positions that may start a repeated string of ``LENGTH`` bytes are ranked by growing prefixes. Spark sorts the pairs
(rank of the first k bytes, rank of the k bytes at offset k) of all of them, equal pairs get one dense rank of 2k bytes,
positions whose rank is unique are dropped, and so on until LENGTH is passed. All but the first position of each rank of
LENGTH bytes are repeats.

Ranking every byte of a corpus would shuffle some 16 bytes for each, so positions are sifted before. A window of LENGTH
bytes is represented by its anchor, the position in it whose hash of ``GRAM`` bytes is smallest (leftmost of equal ones):
equal windows have equal anchors at equal offsets. Neighbouring windows with one anchor form a segment.

1. Grams of all anchors are counted; unique ones are dropped, with all windows of their segments.
2. Segments that are equal as a whole are repeats of the first one, which goes on only if its gram has another segment.
3. The segments that go on are cut into blocks of BLOCK windows, aligned to the anchor. Blocks that are equal as a whole are
   repeats of the first; it goes on if another block shares the CORE bytes that the windows of a block have in common.
4. The windows of the blocks that go on are the positions that prefix doubling ranks: at 32 bytes by their grams, then at
   64, then, with an offset of 36, at 100.

Segments and blocks are equal where two 64-bit hashes are, of different parts; ranks of 100 bytes are equal where the
hashes of four overlapping grams are. Every round writes its small result to the shared folder and lets go of its
shuffles, so that an executor's loss costs one round and the disk holds one round at a time. Joins are between written
tables, so that skewed ranks can be split.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import blocks, forget, hashed, materialize, release, small_batches, string_buffers

LENGTH, GRAM, BLOCK = 100, 32, 8
#: Rows of one range when ranks are sorted.
RANGE_ROWS = 1 << 20
CORE = LENGTH - BLOCK + 1
SPAN = LENGTH - GRAM + 1
CHUNK = 1 << 16
#: Odd multipliers of the rounds of doubling, by the length that is doubled; of overlapping pairs (0), and of mixing.
_ROUND = {k: np.uint64(m) for k, m in zip((0, 1, 2, 4, 8, 16, 32), (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x87C37B91114253D5), strict=True)}
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, np.uint64) | np.uint64(1)


def pair(left: np.ndarray, right: np.ndarray, round_: int = 0) -> np.ndarray:
    """Rank of a string from the ranks of two strings that make it up (they may overlap)."""
    h = left * _ROUND[round_]
    h += right
    return h


def mixed(h: np.ndarray) -> np.ndarray:
    """Ranks whose order and low bits are as good as random."""
    h = h ^ (h >> np.uint64(32))
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def ranks(data: np.ndarray, longest: int = 64) -> dict[int, np.ndarray]:
    """Ranks of 32 (mixed) and 64 bytes at every position where so many follow: every round doubles the length."""
    rank, out = _BYTE[data], {}
    for k in (1, 2, 4, 8, 16, 32):
        if 2 * k <= longest:
            rank = pair(rank[:-k], rank[k:], k)
            if k >= 16:
                out[2 * k] = rank
    out[GRAM] = mixed(out[GRAM])
    return out


def anchors(grams: np.ndarray) -> np.ndarray:
    """Position of the smallest rank in each range of SPAN positions, the leftmost of equal ones."""
    least, at, width = grams, np.arange(len(grams), dtype=np.int32), 1
    while width < SPAN:
        step = min(width, SPAN - width)
        right = least[step:] < least[:-step]
        least = np.minimum(least[step:], least[:-step])
        at = np.where(right, at[step:], at[:-step])
        width += step
    return at


class Segments:
    """Segments of neighbouring texts: text number, first window, number of windows, place of the anchor in the first
    window, rank of the anchor and of the whole."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, anchors_only: bool = False) -> None:
        first, n = int(offsets[0]), int(offsets[-1] - offsets[0])
        if n < LENGTH:
            self.text = self.start = self.count = self.inside = np.zeros(0, np.int64)
            self.anchor = self.whole = np.zeros(0, np.uint64)
            return
        rank = ranks(data[first : first + n], GRAM if anchors_only else 64)
        at = anchors(rank[GRAM])
        starts, ends = offsets[:-1] - first, offsets[1:] - first
        ok = np.ones(len(at), bool)
        for e in np.unique(ends[:-1]).tolist():
            ok[max(0, e - LENGTH + 1) : e] = False
        begin, stop, moved = ok.copy(), ok.copy(), at[1:] != at[:-1]
        begin[1:] &= ~ok[:-1] | moved
        s = np.flatnonzero(begin)
        self.anchor = rank[GRAM][at[s]]
        if anchors_only:
            return
        stop[:-1] &= ~ok[1:] | moved
        e = np.flatnonzero(stop)
        self.text = np.searchsorted(starts, s, "right") - 1
        self.start, self.count, self.inside = s - starts[self.text], e - s + 1, at[s] - s
        self.whole = mixed(pair(windows(rank, s), windows(rank, e)) + self.count.astype(np.uint64) * _MIX)

    def packed(self) -> np.ndarray:
        return self.start << 14 | self.count << 7 | self.inside


def windows(rank: dict[int, np.ndarray], at: np.ndarray) -> np.ndarray:
    """Ranks of LENGTH bytes at positions."""
    return mixed(pair(rank[64][at], rank[64][at + LENGTH - 64]))


def block_rows(text: bytes, packed: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks of the given segments of one text: group (anchor's rank and place of the block), rank of the core, rank of
    the whole, first window and number of windows (packed)."""
    rank = ranks(np.frombuffer(text, np.uint8))
    start, count, inside = packed >> 14, packed >> 7 & 127, packed & 127
    anchor = start + inside
    low, high = (anchor - (start + count - 1)) // BLOCK, inside // BLOCK
    n = high - low + 1
    seg = np.repeat(np.arange(len(start)), n)
    j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[seg]
    a = anchor[seg]
    near, far = np.maximum(j * BLOCK, a - (start + count - 1)[seg]), np.minimum(j * BLOCK + BLOCK - 1, inside[seg])
    core = mixed(pair(rank[64][a - j * BLOCK], rank[64][a - j * BLOCK + CORE - 64]))
    whole = mixed(pair(windows(rank, a - far), windows(rank, a - near)) + (near << 8 | far).astype(np.uint64) * _MIX)
    group = mixed(pair(rank[GRAM][a], j.astype(np.uint64)))
    return group, core, whole, (a - far) << 7 | (far - near + 1)


def pair_rows(text: bytes, packed: np.ndarray) -> tuple[np.ndarray, ...]:
    """First pairs of one text, at the start of each window of the given blocks and where later rounds ask for ranks: rank
    of the gram there, rank of the next gram, whether a window starts there, and the place."""
    grams = ranks(np.frombuffer(text, np.uint8), GRAM)[GRAM]
    start, count = packed >> 7, packed & 127
    at = np.unique(np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    asked = np.unique(np.concatenate([at + x for x in asked_offsets()]))
    return grams[asked], grams[asked + GRAM], np.isin(asked, at).astype(np.int64), asked


def rounds() -> list[int]:
    """Offset of each round: ranks of k bytes at it make ranks of k + offset bytes, from GRAM up to LENGTH."""
    out, k = [], GRAM
    while k < LENGTH:
        out.append(min(k, LENGTH - k))
        k += out[-1]
    return out


def asked_offsets() -> list[int]:
    """Distances from the start of a window at which rounds after the first need ranks."""
    found = {0}
    for offset in rounds()[1:]:
        found |= {x + offset for x in found}
    return sorted(found)


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [pa.array(c.view(np.int64) if isinstance(c, np.ndarray) and c.dtype == np.uint64 else c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _longs(*names: str) -> pa.Schema:
    return pa.schema([(n, pa.int64()) for n in names])


_SEGMENT = _longs("h", "s", "k", "th", "p")
_BLOCK = _longs("g", "c", "b", "k", "th", "p")
_PAIR = _longs("r", "next", "own", "k", "th", "p")


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{n} bigint" for n in schema.names)


def _anchors_of(batches):
    for batch in batches:
        data, offsets = string_buffers(batch.column(0))
        for a, b in blocks(offsets, CHUNK):
            yield _batch(_longs("h"), Segments(data, offsets[a : b + 1], True).anchor)


def _segments_of(batches):
    for batch in batches:
        k, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        data, offsets = string_buffers(batch.column(2))
        for a, b in blocks(offsets, CHUNK):
            x = Segments(data, offsets[a : b + 1])
            yield _batch(_SEGMENT, x.anchor, x.whole, k[a + x.text], th[a + x.text], x.packed())


def _within(schema: pa.Schema, rows):
    """Rows of texts (k, th, t) for the packed places listed with each (x)."""

    def run(batches):
        for batch in batches:
            for k, th, t, x in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                made = rows(t.encode("utf-8", "surrogatepass"), np.unique(np.array(x, np.int64)))
                n = len(made[0])
                yield _batch(schema, *made[:-1], np.full(n, k), np.full(n, th), made[-1])

    return run


def _first(rows: DataFrame, *by: str) -> DataFrame:
    """First occurrence (f) and number (n) of each rank."""
    return rows.groupBy(*by).agg(F.min(F.struct("k", "th", "p")).alias("f"), F.count("*").alias("n"))


def _later(rows: DataFrame, firsts: DataFrame, *by: str) -> DataFrame:
    """Rows that are not the first occurrence of their rank."""
    return rows.join(firsts.filter("n > 1").select(*by, "f"), list(by)).filter(F.struct("k", "th", "p") > F.col("f"))


def _open(firsts: DataFrame, by: list[str]) -> DataFrame:
    """First occurrences of the ranks that share the shorter rank ``by`` with another, by text."""
    shared = materialize(firsts.groupBy(*by).agg(F.count("*").alias("m")).filter("m > 1").drop("m"), "shared")
    return firsts.join(shared, by, "left_semi").select("f.k", "f.th", "f.p")


def _numbered(batches):
    """Rows of a sorted range with the number of the range and their own number in it."""
    place, done = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        numbers = [pa.array(np.full(n, place, np.int64)), pa.array(np.arange(done, done + n, dtype=np.int64))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *numbers], schema=_longs(*batch.schema.names, "range", "at"))
        done += n


def dense_ranks(keys: DataFrame, *names: str) -> DataFrame:
    """Different keys (bigint columns) with their rank in sorted order: Spark sorts them in ranges, whose sizes are summed."""
    spark = keys.sparkSession
    n = max(-(-keys.count() // RANGE_ROWS), min(32, spark.sparkContext.defaultParallelism), 1)
    sorted_ = keys.repartitionByRange(n, *names).sortWithinPartitions(*names)
    placed = materialize(sorted_.mapInArrow(_numbered, _ddl(_longs(*names, "range", "at"))), "order")
    sizes = sorted(tuple(r) for r in placed.groupBy("range").agg(F.count("*")).collect())  # one for each range
    starts = np.cumsum([0] + [m for _, m in sizes]).tolist()
    before = spark.createDataFrame([(k, a) for (k, _), a in zip(sizes, starts, strict=False)], "range bigint, before bigint")
    return placed.join(F.broadcast(before), "range").select(*names, (F.col("before") + F.col("at")).alias("rank"))


def ranked(pairs: DataFrame) -> DataFrame:
    """Positions (r, own, k, th, p) of pairs (r, next, own, k, th, p): equal pairs get one dense rank in sorted order, those
    whose pair is unique are dropped."""
    shared = materialize(pairs.groupBy("r", "next").agg(F.count("*").alias("n")).filter("n > 1").select("r", "next"), "shared")
    order = materialize(dense_ranks(shared, "r", "next"), "order")
    found = materialize(pairs.join(hashed(order), ["r", "next"]).select(F.col("rank").alias("r"), "own", "k", "th", "p"), "positions")
    forget(shared)
    forget(order)
    release(pairs.sparkSession)
    return found


def doubled(positions: DataFrame, offset: int) -> DataFrame:
    """Pairs of the rank of each position and the rank at ``offset`` from it; positions without one there are dropped."""
    after = positions.select(F.col("r").alias("next"), "k", "th", (F.col("p") - offset).alias("p"))
    pairs = materialize(positions.join(after, ["k", "th", "p"]).select("r", "next", "own", "k", "th", "p"), "pairs")
    release(positions.sparkSession)
    return pairs


def _spans(rows: DataFrame, start, count) -> DataFrame:
    return rows.select("k", "th", start.cast("int").alias("s"), (start + count + (LENGTH - 1)).cast("int").alias("e"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """k, th, s, e: byte spans of the texts (k, th, t) that repeats cover."""
    spark = docs.sparkSession
    step = lambda df, label: (materialize(df, label), release(spark))[0]

    grams = docs.select("t").mapInArrow(_anchors_of, _ddl(_longs("h")))
    shared = step(grams.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "ranks")
    segments = step(docs.select("k", "th", "t").mapInArrow(_segments_of, _ddl(_SEGMENT)).join(hashed(shared), "h"), "segments")
    forget(shared)
    whole = step(_first(segments, "h", "s"), "wholes")
    start, count = F.shiftright("p", 14), F.shiftright("p", 7).bitwiseAND(127)
    spans = [step(_spans(_later(segments, whole, "h", "s"), start, count), "spans")]
    forget(segments)

    listed = lambda places: places.groupBy("k", "th").agg(F.collect_list("p").alias("x"))
    within = lambda places: docs.join(hashed(listed(places), places), ["k", "th"]).select("k", "th", "t", "x")
    todo = step(_open(whole, ["h"]), "open")
    forget(whole)
    cut = step(within(todo).mapInArrow(_within(_BLOCK, block_rows), _ddl(_BLOCK)), "blocks")
    forget(todo)
    parts = step(_first(cut, "g", "c", "b"), "parts")
    start, count = F.shiftright("p", 7), F.col("p").bitwiseAND(127)
    spans.append(step(_spans(_later(cut, parts, "g", "c", "b"), start, count), "spans"))
    forget(cut)

    todo = step(_open(parts, ["g", "c"]), "open")
    forget(parts)
    pairs = step(within(todo).mapInArrow(_within(_PAIR, pair_rows), _ddl(_PAIR)), "pairs")
    forget(todo)
    at = ranked(pairs)
    forget(pairs)
    for offset in rounds()[1:]:
        pairs = doubled(at, offset)
        forget(at)
        at = ranked(pairs)
        forget(pairs)
    starts = at.filter("own = 1")
    firsts = step(_first(starts, "r"), "firsts")
    spans.append(step(_spans(_later(starts, firsts, "r"), F.col("p"), F.lit(1)), "spans"))
    for x in (at, firsts):
        forget(x)
    return spans[0].union(spans[1]).union(spans[2])


RESULT = "struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept: binary>"


def _kept(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Removed bytes, maximal runs of them, and what is left of each text; spans may overlap."""
    data, offsets = string_buffers(texts)
    counts = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    pair_ = spans.flatten()
    s, e = (pair_.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    first = offsets[0]
    base = np.repeat(offsets[:-1] - first, counts)
    total = int(offsets[-1] - first)
    gone = np.cumsum(np.bincount(base + s, minlength=total + 1) - np.bincount(base + e, minlength=total + 1))[:total] > 0
    begin = gone.copy()
    begin[1:] &= ~gone[:-1]
    starts = (offsets[:-1] - first)[offsets[1:] > offsets[:-1]]
    begin[starts] = gone[starts]
    upto = lambda x: np.concatenate([[0], np.cumsum(x)])[offsets - first]
    left = upto(~gone)
    kept = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(left.astype(np.int32).tobytes()), pa.py_buffer(data[first : first + total][~gone].tobytes())])
    return pa.StructArray.from_arrays([pa.array(np.diff(offsets)), pa.array(np.diff(upto(gone))), pa.array(np.diff(upto(begin))), kept], ["n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept (bytes left) of every row.

    Removed is every byte under a string of LENGTH bytes that also starts earlier: in a smaller id, or earlier in the same
    text. Null texts are empty; a null id is the smallest; rows that share an id but not the text are ordered by a hash of
    the text; identical rows (id and text) count once and give equal results; an empty table gives no rows; other columns
    are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = base.select("id", F.coalesce(F.col("id").cast("bigint"), F.lit(-(2**63)).cast("bigint")).alias("k"), F.xxhash64("t").alias("th"), "t")
    spans = repeated_spans(rows.select("k", "th", "t"))
    found = spans.groupBy("k", "th").agg(F.collect_list(F.struct("s", "e")).alias("x"))
    done = rows.join(hashed(found, spans), ["k", "th"], "left").select("id", F.arrow_udf(_kept, RESULT)("t", "x").alias("r"))
    return done.select(F.col("id").alias(doc_id), "r.n_bytes", "r.n_removed", "r.n_spans", "r.kept")
