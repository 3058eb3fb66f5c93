"""N-gram Jaccard self-join by chosen paths (Christiani and Pagh), on sets of word shingles.

Every set is embedded as ``SIZE`` minhashes. In each run, a bucket of sets chooses coordinates at random, 1 / SIMILARITY
of them on average, and splits into the buckets of equal values there. Buckets of up to ``SMALL`` sets are compared by
brute force; larger ones are split again, up to ``DEPTH`` times. Runs are repeated until a pair at the threshold is met
with probability ``RECALL``. As all runs are independent, they are carried out together.

Groups of near copies stay together however often they are split, so a first pass links them: ``LINKS`` runs of one split,
whose large buckets are compared in blocks that share some of their sets. Sets that it connects have one label. In the
runs, a bucket of one label has nothing left to find and goes. A large bucket is split by its largest label and the rest:
where the rest is at most ``WIDE`` sets, they are compared with the whole bucket, block by block; else the bucket is split
again. What is still large after the last split is compared that way whatever the rest. No pair of a bucket is dropped.

What meets is kept as a spanning forest, never as all pairs, of the pairs whose sketches may reach the threshold. Inside
each component of it the exact similarities count, also of pairs that no run met. Components of one block are compared
whole. In larger ones, Jaccard distance being a metric, exact distances to a central set decide most pairs: those close
to it are surely linked and only counted, those at very different distances surely aren't; only the others are compared.

Equal sets are one node, named by 128 bits of a cryptographic digest.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.llm.common import blocks, forget, materialize, may_hold, release, small_batches, string_buffers
from tidewrack.llm.components import components
from tidewrack.llm.words import Words

SHINGLE, SIMILARITY = 5, (4, 5)
SIZE, DEPTH, RECALL = 128, 3, 0.999
#: Runs of the linking pass; sets compared by brute force in one bucket; sets in a block of a large bucket; sets that all
#: its blocks share in the linking pass; sets outside a bucket's largest label that are compared with the whole bucket.
LINKS, SMALL, BLOCK, SHARED, WIDE = 2, 128, 256, 32, 512
#: Sets and bytes in a block of a component whose pairs are computed exactly.
MEMBERS, MEMBER_BYTES = 128, 8 << 20
#: Members of a large component from which its centre is estimated. Any centre gives the same result at another cost.
SAMPLE = 512
#: Agreement of sketches from which a pair is looked at exactly: four standard deviations below the threshold.
THRESHOLD = SIMILARITY[0] / SIMILARITY[1]
MAYBE = math.floor(SIZE * (THRESHOLD - 4 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / SIZE)))
#: Distances to the centre are kept in bins of 1 / BINS. Two sets in bins that sum to at most SURE are linked, by the
#: triangle inequality; two in bins that differ by FAR or more aren't. NO_BIN: of a component that has no centre.
BINS = 128
SURE, FAR, NO_BIN = math.floor(BINS * (1 - THRESHOLD)) - 2, math.floor(BINS * (1 - THRESHOLD)) + 2, 4 * BINS
CHUNK = 1 << 16

_RANDOM = np.random.Generator(np.random.PCG64(11))
_FLIP = _RANDOM.integers(0, 2**32, SIZE, np.uint64).astype(np.uint32)
_FACTOR = _RANDOM.integers(0, 2**32, SIZE, np.uint64).astype(np.uint32) | np.uint32(1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def runs_needed() -> int:
    """Runs until a pair at the threshold is met with probability RECALL: each meets it if the branching process of their
    common choices, of mean one, lives through DEPTH levels."""
    dies = 0.0
    for _ in range(DEPTH):
        dies = math.exp(dies - 1)
    return math.ceil(math.log(1 - RECALL) / math.log(dies))


def _mix(a, b):
    h = (a ^ (b * _A)) * _B
    h ^= h >> np.uint64(29)
    h *= _A
    return h ^ (h >> np.uint64(32))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of neighbouring texts; fewer words than a shingle, but not none, are one shingle."""
    words = Words(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(words.text, minlength=n)
    first = np.cumsum(count) - count
    hashed = words.windows(SHINGLE)
    by_size = {m: words.windows(m) for m in set(count[(count > 0) & (count < SHINGLE)].tolist())}
    out = []
    for i, m in zip(first.tolist(), count.tolist(), strict=True):
        out.append(np.unique(hashed[i : i + m - SHINGLE + 1]) if m >= SHINGLE else by_size[m][i : i + 1] if m else hashed[:0])
    return out


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Minhashes of sets that are not empty."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), SIZE), np.uint32)
    for i in range(SIZE):
        out[:, i] = np.minimum.reduceat((flat ^ _FLIP[i]) * _FACTOR[i], at)
    return out


def names_of(s: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


SKETCHES = "k bigint, th bigint, v bigint, w bigint, n int, mh binary, sk binary"


def _schema(**kinds: pa.DataType) -> pa.Schema:
    return pa.schema(list(kinds.items()))


def _sketches(batches):
    schema = _schema(k=pa.int64(), th=pa.int64(), v=pa.int64(), w=pa.int64(), n=pa.int32(), mh=pa.binary(), sk=pa.binary())
    for batch in batches:
        data, offsets = string_buffers(batch.column(2))
        for a, b in blocks(offsets, CHUNK):
            sets = shingle_sets(data, offsets[a : b + 1])
            full = [s for s in sets if len(s)]
            made = sketch(full) if full else np.zeros((0, SIZE), np.uint32)
            at = np.cumsum([len(s) > 0 for s in sets]) - 1
            small = (made & np.uint32(255)).astype(np.uint8)
            names = [names_of(s) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([x for x, _ in names], pa.int64()), pa.array([x for _, x in names], pa.int64()),
                pa.array([len(s) for s in sets], pa.int32()), *(pa.array([m[i].tobytes() if len(s) else None for s, i in zip(sets, at, strict=True)], pa.binary()) for m in (made, small)),
            ], schema=schema)


def _matrix(column, kind=np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, SIZE)


def chosen(paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of the choices that each path makes."""
    draw = _mix(paths[:, None], np.arange(1, SIZE + 1, dtype=np.uint64)[None, :])
    return np.nonzero(draw < np.uint64(2**64 / (THRESHOLD * SIZE)))


PATHS = "path bigint, v bigint, l bigint"
_PATH = _schema(path=pa.int64(), v=pa.int64(), l=pa.int64())


def _children(paths: np.ndarray, v: np.ndarray, label: np.ndarray, mh: np.ndarray) -> pa.RecordBatch:
    row, i = chosen(paths)
    child = _mix(_mix(paths[row], i.astype(np.uint64) + np.uint64(1)), mh[row, i].astype(np.uint64))
    return pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(v[row]), pa.array(label[row])], schema=_PATH)


def _longs(batch: pa.RecordBatch, *columns: int) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False) for i in columns]


def _roots(first: int, runs: int):
    """First splits of so many runs, from (v, l, mh)."""

    def run(batches):
        start = _mix(np.arange(first, first + runs, dtype=np.uint64), np.uint64(1))
        for batch in batches:
            v, label = _longs(batch, 0, 1)
            mh = _matrix(batch.column(2))
            for path in start:
                yield _children(np.full(len(v), path), v, label, mh)

    return run


def _deeper(batches):
    for batch in batches:
        path, v, label = _longs(batch, 0, 1, 2)
        yield _children(path.view(np.uint64), v, label, _matrix(batch.column(3)))


def _groups(batches, keys: int):
    """Tables of rows that agree in the first ``keys`` columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([c.astype(np.int64) for c in _longs(batch, *range(keys))], 1)
        cut = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            here = tuple(key[a].tolist())
            if held and here != last:
                yield pa.Table.from_batches(held)
                held = []
            last = here
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges (member, root) that connect what a symmetric boolean matrix connects."""
    n = len(near)
    left = np.ones(n, bool)
    out = []
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        edge = near[root] & left
        while edge.any():
            left &= ~edge
            members = np.flatnonzero(edge)
            out += [(m, root) for m in members.tolist()]
            edge = near[members].any(0) & left
    return out


EDGES = "a bigint, b bigint"
_EDGE = _schema(a=pa.int64(), b=pa.int64())


def _agree(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pairs of sketches that may reach the threshold."""
    near = np.empty((len(left), len(right)), bool)
    for k in range(0, len(left), 16):
        near[k : k + 16] = (left[k : k + 16, None, :] == right[None, :, :]).sum(2) >= MAYBE
    return near


def _met(keys: int):
    """Spanning forest of the pairs of a group (``keys`` columns, then v, l, sk) that may reach the threshold and have
    different labels."""

    def run(batches):
        a: list[int] = []
        b: list[int] = []
        for group in _groups(batches, keys):
            v, at = np.unique(group.column("v").to_numpy(), return_index=True)
            if len(v) > 1:
                label, sk = group.column("l").to_numpy()[at], _matrix(group.column("sk"), np.uint8)[at]
                for m, r in _forest(_agree(sk, sk) & (label[:, None] != label[None, :])):
                    a.append(int(v[m]))
                    b.append(int(v[r]))
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=_EDGE)
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGE)

    return run


def _met_across(batches):
    """The same across a pair of blocks (inside the block if i = j)."""
    for group in _groups(batches, 3):
        v, at = np.unique(group.column("v").to_numpy(), return_index=True)
        side, label = group.column("block").to_numpy()[at], group.column("l").to_numpy()[at]
        sk = _matrix(group.column("sk"), np.uint8)[at]
        p, q = (np.flatnonzero(side == group.column(c)[0].as_py()) for c in ("i", "j"))
        near = np.zeros((len(v), len(v)), bool)
        near[np.ix_(p, q)] = _agree(sk[p], sk[q]) & (label[p][:, None] != label[q][None, :])
        edges = _forest(near | near.T)
        yield pa.RecordBatch.from_arrays([pa.array([int(v[m]) for m, _ in edges], pa.int64()), pa.array([int(v[r]) for _, r in edges], pa.int64())], schema=_EDGE)


def _sorted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def _step(df: DataFrame, label: str) -> DataFrame:
    """Write a step and let go of its shuffles."""
    done = materialize(df, label)
    release(df.sparkSession)
    return done


def _live(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rows of the buckets in ``sizes``, with the size. Most rows are in none, so a filter goes before the shuffle."""
    live = _step(rows.filter(may_hold(sizes, "path")(F.col("path"))).join(sizes, "path"), "live")
    forget(sizes)
    return live


def _linked(nodes: DataFrame) -> DataFrame:
    """v, l: label of the nodes that the linking pass connects with others."""
    rows = nodes.select("v", F.col("v").alias("l"), "mh").mapInArrow(_roots(runs_needed() + 1, LINKS), PATHS)
    sizes = materialize(rows.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    live = _live(rows, sizes)
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    deal = F.pmod(F.xxhash64("path", "v"), n.cast("bigint")).cast("int")
    everywhere = F.pmod(F.xxhash64("v", "path", F.lit(1)), F.col("size").cast("bigint")) < SHARED
    where = F.when(n <= 1, F.array(F.lit(0))).when(everywhere, F.sequence(F.lit(0), n - 1)).otherwise(F.array(deal))
    dealt = live.withColumn("block", F.explode(where)).join(nodes.select("v", "sk"), "v").select("path", "block", "v", "l", "sk")
    edges = _step(_sorted(dealt, "path", "block").mapInArrow(_met(2), EDGES).distinct(), "links")
    forget(live)
    labels = materialize(components(edges).select(F.col("node").alias("v"), F.col("label").alias("l")), "labels")
    forget(edges)
    return labels


def _with_main(large: DataFrame) -> DataFrame:
    """Adds main (the most frequent label of the bucket) and rest (members of other labels)."""
    counts = large.groupBy("path", "l").agg(F.count("*").alias("c"))
    tops = materialize(counts.groupBy("path").agg(F.max(F.struct("c", "l")).alias("top"), F.sum("c").alias("m")), "tops")
    return materialize(large.join(tops, "path").select("path", "v", "l", F.col("top.l").alias("main"), (F.col("m") - F.col("top.c")).alias("rest"), F.col("top.c").alias("most")), "main")


def _across(large: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between the sets of the buckets (path, v, l, main, rest, most) that don't have the main label and all others.

    Those of the main label and the rest are dealt over blocks of BLOCK sets each; the rest's blocks meet all blocks.
    """
    a, b = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("most", "rest"))
    deal = lambda n: F.pmod(F.xxhash64("path", "v"), n.cast("bigint")).cast("int")
    main = F.col("l") == F.col("main")
    firsts, others = F.sequence(F.lit(0), a - 1), F.sequence(a, a + b - 1)
    dealt = large.filter("rest > 0").withColumn("block", F.when(main, deal(a)).otherwise(a + deal(b))).withColumn("partners", F.when(main, others).otherwise(F.concat(firsts, others)))
    known = materialize(dealt.select("path", "v", "l", "block", "partners"), "dealt").join(nodes.select("v", "sk"), "v").withColumn("other", F.explode("partners"))
    cells = known.select("path", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "v", "l", "block", "sk")
    return _step(_sorted(cells, "path", "i", "j").mapInArrow(_met_across, EDGES).distinct(), "met")


def meetings(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) of nodes (v, mh, sk) that connect all that met in a bucket and may reach the threshold. Buckets compare
    the last bytes of the minhashes (sk), a quarter of their size; different values agree in them once in 256."""
    labels = _linked(nodes)
    marked = nodes.select("v", "mh", may_hold(labels, "v")(F.col("v")).alias("near"))  # only what may have a label is shuffled
    labelled = marked.filter("near").join(labels, "v", "left").select("v", F.coalesce("l", "v").alias("l"), "mh")
    rows = labelled.union(marked.filter("NOT near").select("v", "v", "mh")).mapInArrow(_roots(1, runs_needed()), PATHS)
    edges = labels.select(F.col("v").alias("a"), F.col("l").alias("b"))
    for depth in range(DEPTH):
        sizes = rows.groupBy("path").agg(F.count("*").alias("size"), F.min("l").alias("low"), F.max("l").alias("high"))
        sizes = materialize(sizes.filter("size > 1 AND low <> high").select("path", "size"), "sizes")
        live = _live(rows, sizes)
        small = live.filter(F.col("size") <= SMALL).join(nodes.select("v", "sk"), "v").select("path", "v", "l", "sk")
        edges = edges.union(_step(_sorted(small, "path").mapInArrow(_met(1), EDGES).distinct(), "met"))
        large = live.filter(F.col("size") > SMALL).select("path", "v", "l")
        if large.isEmpty():
            break
        large = _with_main(large)
        forget(live)
        split = F.col("rest") > WIDE
        if depth == DEPTH - 1:
            if not large.filter(split).isEmpty():
                found = _step(components(edges), "labels")
                large = _with_main(large.select("path", "v").join(found.select(F.col("node").alias("v"), F.col("label").alias("l")), "v", "left").select("path", "v", F.coalesce("l", "v").alias("l")))
            return edges.union(_across(large, nodes))
        edges = edges.union(_across(large.filter(~split), nodes))
        parents = large.filter(split).select("path", "v", "l")
        wanted = nodes.filter(may_hold(parents, "v")(F.col("v"))).select("v", "mh")
        rows = parents.join(wanted, "v").select("path", "v", "l", "mh").mapInArrow(_deeper, PATHS)
    return edges


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from the shingles that at least two of the sets hold, some columns at a time."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[column] > 1
    number = np.cumsum(count > 1) - 1
    column, owner = number[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    wide = max(256, (16 << 20) // (4 * len(sets)))
    total = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, total, wide):
        p, q = np.searchsorted(column, [a, a + wide])
        x = np.zeros((len(sets), min(wide, total - a)), np.float32)
        x[owner[p:q], column[p:q] - a] = 1
        out += x @ x.T
    common = np.rint(out).astype(np.int64)
    np.fill_diagonal(common, [len(s) for s in sets])
    return common


def linked(common, n, m):
    """Whether sets of n and m shingles with so many in common reach the threshold."""
    top, low = SIMILARITY
    return (top + low) * common >= top * (n + m)


LINKED = "v bigint, links bigint, root bigint"


def _exact(batches):
    """Weighted links of every set of a block pair that their bins don't decide, and the least member that it connects to,
    over the whole sets."""
    schema = _schema(v=pa.int64(), links=pa.int64(), root=pa.int64())
    for group in _groups(batches, 3):
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        v, at = np.unique(group.column("v").to_numpy(), return_index=True)
        side, weight, bins = (group.column(c).to_numpy()[at] for c in ("block", "m", "bin"))
        sets = [np.frombuffer(x, np.uint64) for x in group.column("s").take(pa.array(at)).to_pylist()]
        n = np.array([len(s) for s in sets])
        near = linked(intersections(sets), n[:, None], n[None, :]) & (bins[:, None] + bins[None, :] > SURE)
        np.fill_diagonal(near, False)
        if i != j:
            near &= side[:, None] != side[None, :]
        links = near @ weight
        root = v.copy()
        for m, r in _forest(near):
            root[m] = v[r]
        keep = links > 0
        yield pa.RecordBatch.from_arrays([pa.array(v[keep]), pa.array(links[keep].astype(np.int64)), pa.array(root[keep])], schema=schema)


def _whole_sets(batches):
    schema = _schema(comp=pa.int64(), v=pa.int64(), m=pa.int64(), size=pa.int64(), per=pa.int64(), s=pa.binary())
    for batch in batches:
        data, offsets = string_buffers(batch.column(5))
        for a, b in blocks(offsets, CHUNK):
            sets = shingle_sets(data, offsets[a : b + 1])
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(5)), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)


def _modes(batches):
    """Most frequent value of every coordinate among the sketches of a component's sample."""
    for group in _groups(batches, 1):
        sk = _matrix(group.column("sk"), np.uint8)
        mode = np.array([np.bincount(sk[:, i], minlength=256).argmax() for i in range(SIZE)], np.uint8)
        yield pa.RecordBatch.from_arrays([group.column("comp").slice(0, 1).combine_chunks(), pa.array([mode.tobytes()], pa.binary())], schema=_schema(comp=pa.int64(), mode=pa.binary()))


def _from_mode(batches):
    """Coordinates in which each member (comp, v, sk, mode) differs from the mode."""
    for batch in batches:
        away = (_matrix(batch.column(2), np.uint8) != _matrix(batch.column(3), np.uint8)).sum(1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(away.astype(np.int64))], schema=_schema(comp=pa.int64(), v=pa.int64(), away=pa.int64()))


CENTRED = "comp bigint, v bigint, m bigint, bin int, root bigint"


def _centred(batches):
    """Bin of the distance to the centre, and the centre where it is linked, of every member of a block."""
    schema = _schema(comp=pa.int64(), v=pa.int64(), m=pa.int64(), bin=pa.int32(), root=pa.int64())
    for group in _groups(batches, 2):
        is_centre = group.column("centre").to_numpy(zero_copy_only=False)
        middle = int(np.flatnonzero(is_centre)[0])
        centre, name = np.frombuffer(group.column("s")[middle].as_py(), np.uint64), group.column("v")[middle].as_py()
        own = group.filter(pa.array(~is_centre))
        sets = [np.frombuffer(x, np.uint64) for x in own.column("s").to_pylist()]
        n = np.array([len(s) for s in sets], np.int64)
        common = np.array([np.isin(s, centre, assume_unique=True).sum() for s in sets], np.int64)
        apart = (n + len(centre) - 2 * common) / (n + len(centre) - common)
        v = own.column("v").to_numpy()
        root = np.where(linked(common, n, len(centre)), name, v)
        yield pa.RecordBatch.from_arrays([own.column("comp").combine_chunks(), pa.array(v), own.column("m").combine_chunks(), pa.array(np.floor(apart * BINS).astype(np.int32)), pa.array(root)], schema=schema)


def _central(whole: DataFrame, nodes: DataFrame) -> DataFrame:
    """comp, v, m, bin, root of the members of large components (see ``CENTRED``)."""
    members = whole.select("comp", "v", "size").join(nodes.select("v", "sk"), "v").select("comp", "v", "size", "sk")
    sample = members.filter(F.pmod(F.xxhash64("v"), F.col("size")) < SAMPLE).select("comp", "sk")
    modes = materialize(_sorted(sample, "comp").mapInArrow(_modes, "comp bigint, mode binary"), "modes")
    away = members.join(modes, "comp").select("comp", "v", "sk", "mode").mapInArrow(_from_mode, "comp bigint, v bigint, away bigint")
    centres = materialize(away.groupBy("comp").agg(F.min(F.struct("away", "v")).alias("c")).select("comp", F.col("c.v").alias("v")), "centres")
    parts = F.ceil(F.col("size") / F.col("per")).cast("int")
    dealt = whole.withColumn("block", F.pmod(F.xxhash64("v"), parts.cast("bigint")).cast("int")).select("comp", "block", "v", "m", "s", F.lit(False).alias("centre"))
    copies = whole.join(centres, ["comp", "v"]).withColumn("block", F.explode(F.sequence(F.lit(0), parts - 1))).select("comp", "block", "v", "m", "s", F.lit(True).alias("centre"))
    return _step(_sorted(dealt.union(copies), "comp", "block").mapInArrow(_centred, CENTRED), "centred")


def _placed(centred: DataFrame, sizes: DataFrame) -> DataFrame:
    """comp, v, m, bin, root, links (those that are sure by bins), block, low and high (blocks to be compared with; null:
    none). Blocks follow the bins, so that what needs comparing is a range of them."""
    counts = centred.groupBy("comp", "bin").agg(F.count("*").alias("c"), F.sum("m").alias("w"))
    listed = counts.groupBy("comp").agg(F.array_sort(F.collect_list(F.struct("bin", "c", "w"))).alias("bins")).join(sizes, "comp")  # BINS + 1 at most
    total = lambda xs, of: F.aggregate(xs, F.lit(0).cast("bigint"), lambda s, x: s + of(x))
    before = lambda x: F.floor(total(F.filter("bins", lambda y: y["bin"] < x["bin"]), lambda y: y["c"]) / F.col("per"))
    parts = lambda x: F.greatest(F.lit(1).cast("bigint"), F.ceil(x["c"] / F.col("per")))
    made = listed.withColumn("at", F.transform("bins", lambda x: F.struct(x["bin"].alias("bin"), before(x).alias("first"), parts(x).alias("parts"))))
    sure = lambda x: total(F.filter("bins", lambda y: y["bin"] + x["bin"] <= SURE), lambda y: y["w"])
    asked = lambda x: F.filter("at", lambda y: (y["bin"] + x["bin"] > SURE) & (F.abs(y["bin"] - x["bin"]) < FAR))
    plan = made.select("comp", F.explode(F.transform("at", lambda x: F.struct(
        x["bin"].alias("bin"), x["first"].alias("first"), x["parts"].alias("parts"), sure(x).alias("sure"),
        F.array_min(F.transform(asked(x), lambda y: y["first"])).alias("low"), F.array_max(F.transform(asked(x), lambda y: y["first"] + y["parts"] - 1)).alias("high"),
    ))).alias("x")).select("comp", "x.*")
    own = F.when(2 * F.col("bin") <= SURE, F.col("m")).otherwise(F.lit(0))
    joined = centred.join(materialize(plan, "plan"), ["comp", "bin"])
    return _step(joined.select("comp", "v", "m", "bin", "root", (F.col("sure") - own).alias("links"), (F.col("first") + F.pmod(F.xxhash64("v"), F.col("parts"))).alias("block"), "low", "high"), "placed")


def exact_links(wanted: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """v, links, root: exact links inside components, in one or more rows for each v that has any.

    ``wanted``: comp, v, k, th, n (size of the set), m (rows that have it); ``texts``: k, th, t. The cost of a component
    of several blocks is its members, and the pairs of blocks that distances to its centre leave open.
    """
    spark = texts.sparkSession
    per = F.greatest(F.lit(2).cast("bigint"), F.least(F.lit(MEMBERS).cast("bigint"), F.floor(MEMBER_BYTES * F.col("size") / (8 * F.col("held")))))
    sizes = materialize(wanted.groupBy("comp").agg(F.count("*").alias("size"), F.sum("n").alias("held")).select("comp", "size", per.alias("per")), "sizes")
    asked = materialize(wanted.join(sizes, "comp").select("comp", "v", "m", "size", "per", "k", "th"), "asked")
    least = F.lit(-(2**63)).cast("bigint")
    near = texts.filter(may_hold(asked, "k", "th")(F.col("k"), F.col("th"))).withColumn("k", F.coalesce("k", least))
    with_text = near.join(asked.withColumn("k", F.coalesce("k", least)), ["k", "th"]).select("comp", "v", "m", "size", "per", "t")
    whole = _step(with_text.mapInArrow(_whole_sets, "comp bigint, v bigint, m bigint, size bigint, per bigint, s binary").dropDuplicates(["v"]), "whole")
    zero = F.lit(0).cast("bigint")
    cells = [whole.filter("size <= per").select("comp", zero.alias("i"), zero.alias("j"), "v", zero.alias("block"), "m", F.lit(NO_BIN).alias("bin"), "s")]
    counted = []
    large = whole.filter("size > per")
    if not large.isEmpty():
        placed = _placed(_central(large, nodes), sizes.select("comp", "per"))
        counted.append(placed.select("v", "links", "root"))
        keyed = placed.filter("low IS NOT NULL").select("comp", "v", "m", "bin", "block", F.explode(F.sequence("low", "high")).alias("other"))
        cells.append(keyed.join(large.select("v", "s"), "v").select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "v", "block", "m", "bin", "s"))
    for x in cells:
        counted.append(_step(_sorted(x, "comp", "i", "j").mapInArrow(_exact, LINKED), "exact"))
    forget(whole)
    out = counted[0]
    for x in counted[1:]:
        out = out.union(x)
    return out


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, th (hash of the text), class_id, class_node and n_links of every row.

    A link joins two rows whose shingle sets have a Jaccard similarity of at least 4/5; n_links counts the row's links,
    copies included; class_id is the least id of the rows that links connect, class_node names them uniquely. Texts
    without words (null ones too) have no links and are classes of their own, of their own id. Repeated rows are copies
    of each other; a null id never is a class id unless all of the class are null; an empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("bigint").alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = materialize(texts.select("k", "th", "t").mapInArrow(_sketches, SKETCHES), "sketches")
    known = rows.filter("n > 0")
    sets = known.groupBy("v", "w").agg(F.min(F.struct("k", "th")).alias("f"), F.min("k").alias("least"), F.count("*").alias("m"), F.min("n").alias("n"))
    again = F.row_number().over(Window.partitionBy("v").orderBy("w"))  # more than 1 only where two sets share half of their names
    named = sets.withColumn("r", again).withColumn("u", F.when(F.col("r") == 1, F.col("v")).otherwise(F.xxhash64("v", "w", "r"))).drop("r")
    classes = _step(named, "sets")
    own = known.select("k", "th", "v", "w", "mh", "sk").join(classes.select("v", "w", "u", "f"), ["v", "w"]).filter(F.col("f.k").eqNullSafe(F.col("k")) & (F.col("f.th") == F.col("th")))
    nodes = _step(own.select(F.col("u").alias("v"), "mh", "sk").dropDuplicates(["v"]), "nodes")

    comp = components(meetings(nodes)).select(F.col("node").alias("u"), F.col("label").alias("comp"))
    wanted = materialize(comp.join(classes, "u").select("comp", F.col("u").alias("v"), "f.k", "f.th", "n", "m"), "candidates")
    exact = exact_links(wanted, texts, nodes)
    label = components(exact.select(F.col("v").alias("a"), F.col("root").alias("b")).filter("a <> b")).select(F.col("node").alias("u"), "label")
    links = exact.groupBy(F.col("v").alias("u")).agg(F.sum("links").alias("links"))
    joined = classes.select("u", "v", "w", "least", "m").join(label, "u", "left").join(links, "u", "left")
    joined = materialize(joined.select("v", "w", "least", F.coalesce("label", "u").alias("node"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "named")
    ids = materialize(joined.groupBy("node").agg(F.min("least").alias("class_id")), "ids")
    final = materialize(joined.join(ids, "node").select("v", "w", "node", "class_id", "n_links"), "classes")
    for x in (nodes, classes, wanted, joined, ids):
        forget(x)
    with_class = known.select("k", "th", "v", "w").join(final, ["v", "w"]).select("k", "th", "class_id", "node", "n_links")
    alone = rows.filter("n = 0").select("k", "th", F.col("k").alias("class_id"), F.lit(None).cast("bigint").alias("node"), F.lit(0).cast("bigint").alias("n_links"))
    return with_class.union(alone).select(F.col("k").alias(doc_id), "th", "class_id", F.col("node").alias("class_node"), "n_links")


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, the one of the least id (then of the least hash of the text), with all its columns.

    Of rows that agree in id and text one stays. Rows of a null id in a class of their own stay. Only rows that a bounded
    filter takes for possible losers are shuffled.
    """
    spark = docs.sparkSession
    found = similar_documents(docs.select(F.col(doc_id), F.col(text)), doc_id, text)
    null = F.lit(-(2**63)).cast("bigint")
    members = _step(found.select(F.coalesce(F.col(doc_id).cast("bigint"), null).alias("k"), F.col(doc_id).isNull().alias("z"), "th", "class_node"), "members")
    best = materialize(members.filter("class_node IS NOT NULL").groupBy("class_node").agg(F.min(F.struct("z", "k", "th")).alias("f")), "best")
    same = (F.col("k") == F.col("f.k")) & (F.col("th") == F.col("f.th"))
    losers = members.join(best, "class_node").filter(~same).select("k", "th").distinct()
    repeated = members.groupBy("k", "th").count().filter("count > 1").select("k", "th")
    unsure = _step(losers.withColumn("lost", F.lit(1)).unionByName(repeated.withColumn("lost", F.lit(0))).groupBy("k", "th").agg(F.max("lost").alias("lost")), "unsure")
    forget(members)
    names = ["__similar_k", "__similar_th"]
    marked = docs.withColumns(dict(zip(names, [F.coalesce(F.col(doc_id).cast("bigint"), null), F.xxhash64(F.coalesce(F.col(text), F.lit("")))], strict=True)))
    marked = marked.withColumn("__similar_near", may_hold(unsure, "k", "th")(*[F.col(x) for x in names]))
    near = marked.filter("__similar_near").join(unsure.toDF(*names, "__similar_lost"), names, "left")
    out = [F.col(f"`{c}`") for c in docs.columns]
    once = near.filter("__similar_lost = 0").dropDuplicates(names).select(*out)
    return marked.filter("NOT __similar_near").select(*out).union(near.filter("__similar_lost IS NULL").select(*out)).union(once)
