"""Near duplicates, repeated strings, components."""

import collections
import hashlib
import random

import pytest

from tests.llm import cases
from tidewrack.llm import components, jaccard_join, suffix_dedup


def classes(rows):
    """(class id, links) of each row, by comparing all pairs."""
    sets = [cases.shingles(t) for _, t in rows]
    n = len(rows)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 9 * common >= 4 * (len(sets[i]) + len(sets[j])):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [(k, least.get(find(i)) if sets[i] else k, links[i]) for i, (k, _) in enumerate(rows)]


def near_copies(seed, copies=60, size=90, groups=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for c in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 9])):
                text[rng.randrange(size)] = rng.choice(vocabulary)
            rows.append((1000 * g + c, " ".join(text)))
    rows += [(9000 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60)))) for i in range(80)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_join_equals_brute_force(spark, monkeypatch, small):
    """With tiny limits every bucket is split, dealt over blocks, and every component takes several blocks."""
    rows = near_copies(3)
    if small:
        for name, value in (("SMALL", 4), ("BLOCK", 8), ("SHARED", 4), ("WIDE", 6), ("MEMBERS", 16), ("SAMPLE", 8)):
            monkeypatch.setattr(jaccard_join, name, value)
    got = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert collections.Counter((r.doc_id, r.class_id, r.n_links) for r in got) == collections.Counter(classes(rows))


def test_join_of_dissimilar_sets_in_large_buckets(spark, monkeypatch):
    """Rows of 8 out of 24 common passages and some text of their own: large buckets of dissimilar sets, links between few of them."""
    for name, value in (("SMALL", 4), ("BLOCK", 2), ("SHARED", 1), ("WIDE", 3), ("MEMBERS", 16)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    passages = [[word() for _ in range(60)] for _ in range(24)]
    rows = []
    for i in range(900):
        shared = [w for p in sorted(rng.sample(range(24), 8)) for w in passages[p]]
        for copy in range(2 if i % 10 == 0 else 1):
            rows.append((10 * i + copy, " ".join(shared + [word() for _ in range(48)])))
    got = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert collections.Counter((r.doc_id, r.class_id, r.n_links) for r in got) == collections.Counter(classes(rows))


def test_join_of_odd_rows(spark):
    rows = [(k, t) for k, t, *_ in cases.odd_rows()]
    got = jaccard_join.similar_documents(cases.odd(spark)).collect()
    assert collections.Counter((r.doc_id, r.class_id, r.n_links) for r in got) == collections.Counter(classes(rows))
    assert jaccard_join.similar_documents(cases.empty(spark)).count() == 0


def test_one_of_each_class_stays(spark):
    rows = near_copies(4, copies=12)
    docs = spark.createDataFrame([(k, t, "en") for k, t in rows + rows[:5]], "doc_id bigint, text string, lang string")
    kept = jaccard_join.drop_similar(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in classes(rows)})
    left = jaccard_join.drop_similar(cases.odd(spark))
    assert left.columns == cases.odd(spark).columns
    wordless = {k for k, t, *_ in cases.odd_rows() if not cases.words(t)}
    assert wordless <= {r.doc_id for r in left.collect()}
    assert jaccard_join.drop_similar(cases.empty(spark)).count() == 0


def test_runs_reach_the_recall(spark, capsys):
    """Planted pairs of known similarity among rows of common passages: nearly all at 0.8 and above are found."""
    assert jaccard_join.runs_needed() >= 10
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(40_000)}"
    passages = [[word() for _ in range(60)] for _ in range(12)]
    rows, pairs = [], []
    for changed in (10, 7, 5):  # of 90 shingles: similarities of 80/100, 83/97, 85/95
        for _ in range(150):
            base = [word() for _ in range(94)]
            pairs.append(((90 - changed) / (90 + changed), len(rows)))
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[: 94 - changed] + [word() for _ in range(changed)]))]
    rows += [(10_000 + i, " ".join([w for p in rng.sample(passages, 3) for w in p] + [word() for _ in range(80)])) for i in range(300)]
    got = {r.doc_id: r.class_id for r in jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    found = collections.defaultdict(list)
    for similarity, k in pairs:
        found[round(similarity, 2)].append(got[k] == got[k + 1])
    with capsys.disabled():
        print({s: sum(x) / len(x) for s, x in found.items()})
    assert all(sum(x) >= 0.99 * len(x) for x in found.values())


def removed(rows):
    """n_bytes, n_removed, n_spans and digest of each text, from the set of all strings seen so far."""
    seen, out = set(), {}
    for k, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - suffix_dedup.LENGTH + 1):
            s = raw[i : i + suffix_dedup.LENGTH]
            if s in seen:
                gone[i : i + len(s)] = b"\1" * len(s)
            seen.add(s)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[k] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out


def repeated_rows():
    rng = random.Random(9)
    base = "".join(rng.choice("abcdef \n") for _ in range(1500))
    rows = [(i, x) for i, x in enumerate(["a" * 500, "ab" * 200, "a" * 99, "a" * 100, "", None, "x" + "abc" * 100, "é" * 120, "日本" * 60, base, base, base[:700], "q" + base[650:], base[:99], base[1:101]])]
    for i in range(25):
        text = list(base)
        for _ in range(rng.randrange(0, 25)):
            text[rng.randrange(len(text))] = "Z"
        rows.append((100 + i, "".join(text)))
    return rows


def test_repeats_equal_brute_force(spark):
    rows = repeated_rows()
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got} == removed(rows)


def test_repeats_of_odd_rows(spark):
    got = suffix_dedup.remove_repeats(cases.odd(spark)).collect()
    assert collections.Counter((r.doc_id, r.n_bytes) for r in got) == collections.Counter((k, len((t or "").encode())) for k, t, *_ in cases.odd_rows())
    assert all(r.n_bytes == r.n_removed + len(r.kept) for r in got)
    assert suffix_dedup.remove_repeats(cases.empty(spark)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 150: 100, 200: 100}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("bits", [None, 64])
def test_filter_passes_all_keys(spark, monkeypatch, bits):
    from pyspark.sql import functions as F

    from tidewrack.llm import common

    if bits:
        monkeypatch.setattr(common, "FILTER_BITS", bits)
    keys = spark.createDataFrame([(i * 7, -i) for i in range(300)] + [(None, 3)], "a bigint, b bigint")
    rows = keys.union(spark.range(1000, 3000).select(F.col("id"), F.lit(1).cast("bigint")))
    passed = rows.filter(common.may_hold(keys, "a", "b")(F.col("a"), F.col("b")))
    assert keys.exceptAll(passed).count() == 0
    if not bits:
        assert passed.count() < 600
    assert rows.filter(common.may_hold(keys.limit(0), "a", "b")(F.col("a"), F.col("b"))).count() == 0
