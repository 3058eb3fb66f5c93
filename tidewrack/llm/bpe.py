"""Byte-level BPE encoding and decoding over a public vocabulary file.

Pieces come from the vocabulary's split pattern. The pieces that are new to a worker are merged together, in a
contiguous array of adjacent ranks with a row for each short piece: the minimum of each row is found by a scan, its
boundary is deleted, and the ranks beside it are refreshed, until no row has a rank left. A long piece, for which
scanning would be quadratic, takes the same merges from a heap over linked boundaries, a very long one rank by rank from
arrays of places, which take some 40 bytes a byte. Vocabularies are parsed on the driver and broadcast as arrays, whose
size the vocabulary file bounds.
"""

import heapq
import json
import re
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm.common import list_array, per_worker, small_batches, trim

#: Pieces of more bytes are merged with a heap, and of more than LONG rank by rank.
SHORT, LONG = 64, 1 << 14
#: Bytes of pieces and units that a worker remembers, with their ids; beyond it the memory starts anew. Longer units than
#: LONGEST characters are forgotten at once. An entry costs ENTRY bytes beside its own.
CACHE_BYTES, LONGEST, ENTRY = 48 << 20, 256, 200
#: The split pattern of the vocabulary, and Unicode's White_Space characters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

NONE = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """Printable stand-in for each byte: itself where printable in Latin-1, else the next free code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(free))
        free += b not in plain
    return out


class Vocabulary:
    """Arrays of a byte-level BPE: sorted pair keys with rank and merged id, ids of bytes, bytes of ids, special strings."""

    def __init__(self, pairs, ranks, merged, byte_ids, token_bytes, token_at, special) -> None:
        self.pairs, self.ranks, self.merged = pairs, ranks, merged
        self.byte_ids, self.token_bytes, self.token_at, self.special = byte_ids, token_bytes, token_at, special
        self._byte_ranks = None

    def rising(self) -> bool:
        """Whether all merges that take a token have a higher rank than those that make it."""
        n = int(max(self.merged.max(initial=0), (self.pairs & 0xFFFFFFFF).max(initial=0), (self.pairs >> 32).max(initial=0))) + 1
        made, used = np.full(n, -1, np.int64), np.full(n, len(self.ranks), np.int64)
        np.maximum.at(made, self.merged, self.ranks)
        for part in (self.pairs >> 32, self.pairs & 0xFFFFFFFF):
            np.minimum.at(used, part, self.ranks)
        return bool((made < used).all())

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab, added = model["model"]["vocab"], {t["content"]: t["id"] for t in model["added_tokens"]}
        if len(vocab) + len(added) > 1 << 22:
            raise ValueError("vocabulary too large to broadcast")
        symbols = byte_symbols()
        back = {s: b for b, s in enumerate(symbols)}
        pairs, merged = [], []
        for m in model["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            pairs.append(vocab[a] << 32 | vocab[b])
            merged.append(vocab[a + b])
        order = np.argsort(np.array(pairs, np.int64), kind="stable")
        raw = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in vocab.items():
            raw[i] = bytes(back[c] for c in token)
        for token, i in added.items():
            raw[i] = token.encode()
        at = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(x) for x in raw], out=at[1:])
        return cls(
            np.array(pairs, np.int64)[order], np.arange(len(pairs), dtype=np.int32)[order], np.array(merged, np.int32)[order],
            np.array([vocab.get(s, -1) for s in symbols], np.int32), np.frombuffer(b"".join(raw), np.uint8), at, added,
        )

    def byte_ranks(self) -> np.ndarray:
        """Rank of each pair of bytes."""
        if self._byte_ranks is None:
            self._byte_ranks = self.rank(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))[0].reshape(256, 256)
        return self._byte_ranks

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE: no merge) and its place."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE), at


def merge_short(vocab: Vocabulary, pieces: list[bytes]) -> list[bytes]:
    """Ids (int32 bytes) of short pieces, all merged at once in one contiguous array of parts and ranks."""
    n, width = len(pieces), max(map(len, pieces))
    size = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    parts = np.where(np.arange(width) < size[:, None], vocab.byte_ids[raw], np.int32(-1)).astype(np.int32)
    parts = np.concatenate([parts, np.full((n, 1), -1, np.int32)], 1)
    ranks = np.full((n, width), NONE, np.int32)
    if width > 1:
        ranks[:, :-1] = np.where(parts[:, 1:width] >= 0, vocab.byte_ranks()[raw[:, :-1], raw[:, 1:]], NONE)
    out: list[bytes] = [b""] * n
    row, column = np.arange(n), np.arange(width)
    while len(row):
        least = ranks.argmin(1)
        here = np.arange(len(row))
        going = ranks[here, least] != NONE
        if not going.all():
            for k in np.flatnonzero(~going).tolist():
                out[row[k]] = parts[k, : size[k]].tobytes()
            parts, ranks, row, size, least = parts[going], ranks[going], row[going], size[going], least[going]
            here = np.arange(len(row))
        if not len(row):
            break
        _, at = vocab.rank(parts[here, least], parts[here, least + 1])
        parts[here, least] = vocab.merged[at]
        after = column > least[:, None]  # delete the boundary: what follows moves up
        parts[:, :-1] = np.where(after, parts[:, 1:], parts[:, :-1])
        ranks[:, :-1] = np.where(column[:-1] >= least[:, None], ranks[:, 1:], ranks[:, :-1])
        ranks[:, -1] = NONE
        size -= 1
        ranks[here, least] = vocab.rank(parts[here, least], parts[here, least + 1])[0]
        before = np.maximum(least - 1, 0)
        fresh = vocab.rank(parts[here, before], parts[here, before + 1])[0]
        ranks[here, before] = np.where(least > 0, fresh, ranks[here, before])
    return out


def merge_long(vocab: Vocabulary, piece: bytes) -> bytes:
    """Ids of one long piece: the lowest rank, leftmost first, from a heap over linked boundaries."""
    parts = vocab.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    first, at = vocab.rank(np.array(parts[:-1], np.int32), np.array(parts[1:], np.int32))
    heap = [(r, i, parts[i], parts[i + 1], m) for i, (r, m) in enumerate(zip(first.tolist(), vocab.merged[at].tolist(), strict=True)) if r != NONE]
    heapq.heapify(heap)
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def push(i: int) -> None:
        j = after[i]
        if j < n:
            pair = parts[i], parts[j]
            if pair not in known:
                r, k = vocab.rank(np.array(pair[:1], np.int32), np.array(pair[1:], np.int32))
                known[pair] = int(r[0]), int(vocab.merged[k[0]])
            if known[pair][0] != NONE:
                heapq.heappush(heap, (known[pair][0], i, *pair, known[pair][1]))

    while heap:
        _, i, a, b, m = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= n or parts[j] != b:
            continue
        parts[i], parts[j] = m, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return np.array([p for p in parts if p >= 0], np.int32).tobytes()


def merge_by_rank(vocab: Vocabulary, piece: bytes) -> bytes:
    """Ids of one very long piece: ranks in rising order, all places of one at once, leftmost first where they overlap. This
    is the order of single merges if ranks rise from a token's merge to those that take it (``Vocabulary.rising``)."""
    parts = vocab.byte_ids[np.frombuffer(piece, np.uint8)].astype(np.int32)
    n = len(parts)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    places: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(at: np.ndarray) -> None:
        at = at[after[at] < n]
        ranks, _ = vocab.rank(parts[at], parts[after[at]])
        at, ranks = at[ranks != NONE], ranks[ranks != NONE]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cut = np.flatnonzero(np.diff(ranks, prepend=-1))
        for r, group in zip(ranks[cut].tolist(), np.split(at, cut[1:]), strict=False):
            if r not in places:
                heapq.heappush(heap, r)
            places.setdefault(r, []).append(group)

    add(np.arange(n - 1, dtype=np.int32))
    by_rank = np.argsort(vocab.ranks)
    while heap:
        r = heapq.heappop(heap)
        key, m = int(vocab.pairs[by_rank[r]]), vocab.merged[by_rank[r]]
        at = np.unique(np.concatenate(places.pop(r)))
        at = at[(parts[at] == key >> 32) & (after[at] < n)]
        at = at[parts[after[at]] == key & 0xFFFFFFFF]
        if key >> 32 == key & 0xFFFFFFFF and len(at):  # every other one of a run
            first = np.concatenate([[True], after[at[:-1]] != at[1:]])
            start = np.flatnonzero(first)[np.cumsum(first) - 1]
            at = at[(np.arange(len(at)) - start) % 2 == 0]
        gone = after[at]
        parts[at], parts[gone] = m, -1
        after[at] = after[gone]
        inside = after[at] < n
        before[after[at][inside]] = at[inside]
        add(np.unique(np.concatenate([at, before[at][before[at] >= 0]])))
    return parts[parts >= 0].tobytes()


class Encoder:
    """Encodes texts with a bounded memory of units: pieces where a plain pattern can tell them, else runs to be split.

    A unit starts where a piece starts. Runs of Latin letters before an ASCII character that is no letter, and runs of
    ASCII punctuation other than apostrophes before a letter, digit or white space, are pieces whatever comes before;
    any other unit runs up to the next white space and is split by the vocabulary's pattern.
    """

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.units: dict[str, bytes] = {}
        self.held, self.rising = 0, vocab.rising()
        self.split = regex.compile(PATTERN.replace(r"\s\p", f"{SPACE}\\p").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")).findall
        letters, marks = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u01ba", "!-&(-/:-@\\[-`{-~"
        self.unit = re.compile(f" ?[{letters}]+(?=[\0-@\\[-`{{-\x7f]|\\Z)| ?[{marks}]+(?=[A-Za-z0-9 \n]|\\Z)|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(vocab.special, key=len, reverse=True))) + ")") if vocab.special else None

    def learn(self, units: set[str]) -> list[str]:
        """Merge the pieces of units that are not known yet; all that is new."""
        have = self.units
        cut = {u: p for u in units if not (u.isalpha() or u[1:].isalpha() and u[0] == " ") and len(p := self.split(u)) > 1}
        groups: dict[int, list[tuple[str, bytes]]] = {}
        new = {p for x in cut.values() for p in x if p not in have}.union(units.difference(cut))
        for p in new:
            raw = p.encode("utf-8", "surrogatepass")
            if len(raw) > SHORT:
                have[p] = (merge_by_rank if len(raw) > LONG and self.rising else merge_long)(self.vocab, raw)
            else:
                groups.setdefault(-(-len(raw) // 4), []).append((p, raw))
        for group in groups.values():
            for k in range(0, len(group), 8192):
                part = group[k : k + 8192]
                have.update(zip([p for p, _ in part], merge_short(self.vocab, [r for _, r in part]), strict=True))
        for u, x in cut.items():
            have[u] = b"".join([have[p] for p in x])
        return [*new, *cut]

    def trim(self, new: list[str]) -> None:
        """Keep the memory in its bounds."""
        for u in new:
            ids = self.units[u]
            if len(u) > LONGEST:
                del self.units[u]
            else:
                self.held += ENTRY + 2 * len(u) + len(ids)
        if self.held > CACHE_BYTES:
            self.units.clear()
            self.held = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as int32 bytes; special strings take their own ids."""
        parts = [self.special.split(t) if self.special and t else [t] for t in texts]
        cut = [[self.unit(x) if k % 2 == 0 else x for k, x in enumerate(p)] for p in parts]
        new = set().union(*(x for p in cut for x in p[::2])).difference(self.units)
        learned = self.learn(new) if new else []
        get = self.units.__getitem__
        out = []
        for p in cut:
            ids = b"".join(map(get, p[0]))
            for k in range(1, len(p), 2):
                ids += np.int32(self.vocab.special[p[k]]).tobytes() + b"".join(map(get, p[k + 1]))
            out.append(ids)
        self.trim(list(dict.fromkeys(learned)))
        return out


#: Characters of text taken at a time.
CHUNK = 500_000


def encode_array(encoder: Encoder, texts: pa.Array) -> pa.Array:
    """list<int32> of ids for a string array; null counts as empty."""
    found: list[bytes] = []
    batch: list[str] = []
    held = 0
    for t in texts.to_pylist():
        batch.append(t or "")
        held += len(batch[-1])
        if held > CHUNK:
            found += encoder.encode(batch)
            batch, held = [], 0
    found += encoder.encode(batch)
    return list_array(np.frombuffer(b"".join(found), np.int32), [len(x) // 4 for x in found], pa.int32())


def decode_array(vocab: Vocabulary, ids: pa.Array) -> pa.Array:
    """Text of each id list: the bytes of its tokens; bytes that are no UTF-8 become replacement characters."""
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), out=rows[1:])
    out: list[str] = []
    for a in range(0, len(ids), 256):
        b = min(a + 256, len(ids))
        part = flat[rows[a] : rows[b]]
        size = vocab.token_at[part + 1] - vocab.token_at[part]
        end = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(end[-1]) + np.repeat(vocab.token_at[part] - end[:-1], size)
        raw = vocab.token_bytes[take].tobytes()
        edge = end[rows[a : b + 1] - rows[a]]
        out += [raw[edge[k] : edge[k + 1]].decode("utf-8", "replace") for k in range(b - a)]
    return pa.array(out, pa.string())


class Tokenizer:
    """Encoding and decoding columns for one vocabulary file."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.shared = spark.sparkContext.broadcast(Vocabulary.load(path))
        trim()  # what parsing has freed on the driver
        self.key = f"bpe-{uuid.uuid4().hex}"

    def encode(self, text: Column) -> Column:
        """array<int>: ids of a text; null: no ids."""
        shared, key = self.shared, self.key

        def run(texts: pa.Array) -> pa.Array:
            try:
                return encode_array(per_worker(key, lambda: Encoder(shared.value)), texts)
            finally:
                trim()

        return F.arrow_udf(run, "array<int>")(text)

    def decode(self, ids: Column) -> Column:
        shared = self.shared

        def run(x: pa.Array) -> pa.Array:
            return decode_array(shared.value, x)

        return F.arrow_udf(run, "string")(ids)


def tokenize(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, ids and decoded text of every row. Repeated rows give repeated results; an empty table gives none; other
    columns are ignored, whatever their names; null and empty texts have no ids and decode to the empty text."""
    small_batches(docs.sparkSession)
    tokens = Tokenizer(docs.sparkSession, path)
    encoded = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("t")).select("k", tokens.encode(F.col("t")).alias("ids"))
    return encoded.select(F.col("k").alias(doc_id), "ids", tokens.decode(F.col("ids")).alias("decoded"))
