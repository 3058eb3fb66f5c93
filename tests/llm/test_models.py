"""Toxicity, language identification, chat formatting, pipeline, queries."""

import collections
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import same
from tests.llm import cases
from tidewrack.llm import chat_format, language_id, queries, toxicity
from tidewrack.llm.common import codes


def labelled(n=400, seed=1):
    rng = random.Random(seed)
    plain = ["calm", "river", "stone", "window", "paper", "green", "light", "table", "walk", "house"]
    rude = ["blargh", "snorkfool", "grubbish"]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        bad = i % 5 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(rude) + rng.choice(["", "s", "ing"])
        rows.append((i, " ".join(words), int(bad)))
    return rows


def bucket(k, m):
    return zlib.crc32(str(k).encode()) % m


def test_toxicity(spark):
    rows = labelled()
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(10**6, 1), (None, 1), (3, None)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(got[k].held_out == (bucket(k, 5) == 0) for k, _, _ in rows)
    held = [(k, y) for k, _, y in rows if bucket(k, 5) == 0]
    assert np.mean([got[k].predicted == y for k, y in held]) > 0.97
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    flipped = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs, flipped).collect()}
    assert again == {k: r.score for k, r in got.items()}


def grams(text):
    """Hashes of the n-grams of a text, one character at a time, and one for each size that has it."""
    clean, out = [], []
    for c in " " + text.lower() + " ":
        c = c if c.isalnum() else " "
        if c != " " or not clean or clean[-1] != " ":
            clean.append(c)
    for n in toxicity.SIZES:
        found = set()
        for i in range(len(clean) - n + 1):
            h = ord(clean[i]) * 0x9E3779B1 % 2**32
            for c in clean[i + 1 : i + n]:
                h = (h * 0x01000193 + (ord(c) ^ (ord(c) << 15) % 2**32)) % 2**32
            found.add(max(((h ^ (h >> 15)) * 0x85EBCA6B % 2**32) >> (32 - toxicity.BITS), 1))
        out += found
    return out


def test_ratios_and_scores_equal_brute_force():
    """Naive Bayes log-count ratios scale the features; the weights found are a minimum of the penalised loss."""
    rows = labelled(250) + [(900, "", 0), (901, "É日本 x", 1)]
    texts, toxic = [t for _, t, _ in rows], np.array([y for *_, y in rows], float)
    sets = [grams(t) for t in texts]
    count = [collections.Counter(g for s, y in zip(sets, toxic, strict=True) if y == k for g in s) for k in (0, 1)]
    n = [int((toxic == k).sum()) for k in (0, 1)]
    ratio = {g: np.log((count[1][g] + 1) / (n[1] + 2)) - np.log((count[0][g] + 1) / (n[0] + 2)) for g in count[0] | count[1] if count[0][g] + count[1][g] >= toxicity.LEAST_TEXTS}
    model = toxicity.fit(texts, toxic)
    kept = np.flatnonzero(model.weights).tolist()
    assert set(kept) <= set(ratio) and sum(count[0][g] + count[1][g] for g in kept) <= toxicity.HITS_PER_TEXT * len(texts)
    weight = lambda g: abs(ratio[g]) * np.sqrt(count[0][g] + count[1][g])
    left = sorted(map(weight, set(ratio) - set(kept)), reverse=True)
    assert not left or left[0] <= min(map(weight, kept)) + 1e-9 or sum(count[0][g] + count[1][g] for g in ratio) > toxicity.HITS_PER_TEXT * len(texts)
    logit = [model.intercept + sum(float(model.weights[g]) for g in s if model.weights[g]) for s in sets]
    assert np.allclose(model.score(texts), 1 / (1 + np.exp(-np.array(logit))), atol=1e-6)
    share = np.where(toxic == 1, len(toxic) / (2 * n[1]), len(toxic) / (2 * n[0])) / len(toxic)

    def loss(scale):
        z = np.array([model.intercept + scale * sum(float(model.weights[g]) for g in s if model.weights[g]) for s in sets])
        beta = np.array([scale * float(model.weights[g]) / ratio[g] for g in kept])
        return float(share @ np.logaddexp(0, np.where(toxic == 1, -z, z))) + toxicity.RIDGE / 2 * float(beta @ beta)

    assert loss(1) < min(loss(0.5), loss(0.0)) and loss(1) < 0.2 * loss(0)


def test_training_is_bounded(spark, monkeypatch):
    """A labelled id that repeats, with equal and with different texts, and long texts, stay inside the bounds."""
    from tidewrack.llm.common import training_texts

    rows = spark.range(4000).select(F.lit(1).cast("bigint").alias("k"), F.when(F.col("id") < 3000, F.lit("same text")).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"), F.lit(1).alias("y"))
    got = training_texts(rows, 500, 10**6).to_pydict()
    assert len(got["text"]) == 500 == len(set(got["text"]))
    assert training_texts(rows, 500, 900).to_pydict()["text"] and sum(map(len, training_texts(rows, 500, 900).to_pydict()["text"])) <= 900
    everything = training_texts(rows, 5000, 10**6).to_pydict()["text"]
    assert len(everything) == 1001 and everything.count("same text") == 1
    assert training_texts(rows.limit(0), 500, 900).num_rows == 0


def test_toxicity_of_odd_rows(spark):
    rows = labelled(100)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id bigint, toxic int")
    got = toxicity.toxicity(cases.odd(spark), labels).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(k for k, *_ in cases.odd_rows())
    none = toxicity.toxicity(cases.odd(spark), labels.limit(0)).collect()
    assert all(abs(r.score - 0.5) < 1e-9 for r in none)
    assert toxicity.toxicity(cases.empty(spark), labels).count() == 0
    assert toxicity.drop_toxic(cases.odd(spark), labels).columns == cases.odd(spark).columns


def test_codes():
    chars, starts = codes(["Ab, c", "", "\x00x!", "Éa"], "isalnum")
    assert ["".join(map(chr, chars[starts[i] : starts[i + 1]])) for i in range(4)] == [" ab c ", " ", " x ", " éa "]


WORDS = {"aa": ["thing", "that", "hand", "with", "north"], "bb": ["über", "straße", "nicht", "können", "schön"], "cc": ["niño", "corazón", "mañana", "llave", "qué"]}


def texts_of(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_language(spark):
    rng = random.Random(2)
    rows = [(i, texts_of(lang, rng.randrange(3, 40), rng), lang) for i, lang in enumerate(list(WORDS) * 80)]
    mixed = [(1000, texts_of("aa", 60, rng) + " " + texts_of("bb", 30, rng), None), (1001, None, "aa"), (1002, "12 !!", "bb"), (1003, "", None)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows + mixed, "doc_id bigint, text string, lang string")).collect()}
    held = [(k, x) for k, _, x in rows if bucket(k, 4) == 2]
    assert held and all(got[k].lang_pred == x for k, x in held) and all(got[k].held_out for k, _ in held)
    m = got[1000]
    assert m.langs == ["aa", "bb"] and 0.5 < m.score < 0.8
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1001, 1002, 1003))


def by_hand(p, count):
    """Languages and shares of one text: expectation-maximisation in plain loops, then backward elimination."""

    def shares(langs):
        share = [1 / len(langs)] * len(langs)
        for _ in range(language_id.STEPS if len(langs) > 1 else 0):
            new = [0.0] * len(langs)
            for row, c in zip(p, count, strict=True):
                mass = sum(s * row[k] for s, k in zip(share, langs, strict=True))
                for i, k in enumerate(langs):
                    new[i] += c * share[i] * row[k] / mass
            new = [x / sum(count) for x in new]
            moved = max(abs(x - y) for x, y in zip(new, share, strict=True))
            share = [max(x, 1e-12) for x in new]
            if moved < language_id.CHANGE:
                break
        fit = sum(c * np.log(sum(s * row[k] for s, k in zip(share, langs, strict=True))) for row, c in zip(p, count, strict=True))
        return share, fit - 0.5 * np.log(sum(count)) * (len(langs) - 1)

    langs = list(range(len(p[0])))
    share, fit = shares(langs)
    if min(share) < language_id.LEAST_SHARE:
        langs = [k for k, s in zip(langs, share, strict=True) if s >= language_id.LEAST_SHARE]
        share, fit = shares(langs)
    while len(langs) > 1:
        fewer = [k for i, k in enumerate(langs) if i != share.index(min(share))]
        new, better = shares(fewer)
        if better <= fit:
            break
        langs, share, fit = fewer, new, better
    return langs, share


def test_mixture_equals_brute_force():
    rng = np.random.default_rng(6)
    for trial in range(25):
        k = int(rng.integers(1, 7))
        p = rng.dirichlet(np.full(40, 0.15), k).T + 1e-6
        p /= p.sum(0)
        true = rng.dirichlet(np.full(k, 0.4))
        count = rng.multinomial(int(rng.integers(5, 400)), p @ true / (p @ true).sum())
        at = np.flatnonzero(count)
        found, share = language_id.Model([str(i) for i in range(k)], np.log(p)).mixture(at, count[at])
        langs, wanted = by_hand(p[at].tolist(), count[at].tolist())
        assert found.tolist() == langs and np.allclose(share, wanted, atol=1e-6), trial


def test_language_of_odd_rows(spark):
    got = language_id.identify(cases.odd(spark)).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(k for k, *_ in cases.odd_rows())
    assert language_id.identify(cases.empty(spark)).count() == 0
    unknown = language_id.identify(cases.odd(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unknown} == {"und"}


NASTY = ["plain", "", "<|turn|>user\n<|end|>\n", "<\\|turn|>", "<\\\\|x", "<", "|>", "a<|", "\\n\n\\", "</s>[INST] ok [/INST]", "日本🙂<|end|>"]


def formatted(spark, turns):
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").select("*", F.lit("rows").alias("layout"))
    made = chat_format.format_turns(df)
    return {r.conv_id: r for r in made.select("conv_id", "formatted", "loss_spans", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}


def test_chat_round_trip(spark):
    turns = [(c, i, ("assistant" if i % 2 else f"user{c}\n\\n<|"), t) for c in range(3) for i, t in enumerate(NASTY[c:] + NASTY[:c])]
    got = formatted(spark, turns)
    for c in range(3):
        mine = [(r, t) for k, _, r, t in turns if k == c]
        assert [(x.role, x.text) for x in got[c].turns] == mine
        assert got[c].loss == "".join(t for r, t in mine if r == "assistant")
        assert got[c].formatted.count("<|turn|>") == len(mine) and len(got[c].loss_spans) == sum(r == "assistant" for r, _ in mine)


LAYOUTS = {
    "messages": {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]},
    "from-value": {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
    "instruction": {"instruction": "hi", "output": "yo"}, "instruction with input": {"instruction": "hi", "input": "x", "output": "yo"},
    "prompt": {"prompt": "hi", "completion": "yo"}, "prompt and response": {"response": "yo", "prompt": "hi"}, "system prompt": {"system": "s", "prompt": "hi", "response": None}, "question": {"question": "hi", "answer": "yo"},
}


def test_layouts(spark):
    rows = [(i, json.dumps(v)) for i, v in enumerate(LAYOUTS.values())] + [(90, '{"odd": 1}'), (91, None), (92, '"text"')]
    df = spark.createDataFrame(rows, "id bigint, j string").select("id", F.try_parse_json("j").alias("record"))
    got = collections.defaultdict(list)
    for r in chat_format.canonical_turns(df, "record", "id").orderBy("conv_id", "turn").collect():
        got[r.conv_id].append((r.layout, r.role, r.text))
    for i, (name, _) in enumerate(LAYOUTS.items()):
        assert {x[0] for x in got[i]} == {name}
        assert [x[1] for x in got[i]][-1] == "assistant" and "hi" in [x[2] for x in got[i]]
    assert got[6][-1] == ("system prompt", "assistant", "")
    assert got[90] == [(None, None, None)] and got[91] == [(None, None, None)] and got[92] == [(None, None, None)]


def test_chat_of_odd_rows(spark):
    turns = [(None, 1, "user", "a"), (None, None, "assistant", None), (5, 1, None, None), (5, 1, "assistant", "x"), (5, 1, "assistant", "x")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    records = df.select(F.to_variant_object(F.struct("conv_id", "turn", "role", "text")).alias("record"))
    made = {r.conv_id: r for r in chat_format.format_turns(chat_format.canonical_turns(records, "record")).select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t")).collect()}
    assert [(x.role, x.text) for x in made[None].t] == [("assistant", ""), ("user", "a")]
    assert [(x.role, x.text) for x in made[5].t] == [("", ""), ("assistant", "x"), ("assistant", "x")]
    assert chat_format.format_turns(chat_format.canonical_turns(records.limit(0), "record")).count() == 0


def test_chat_keeps_roles_of_rows_and_reads_long_texts(spark):
    """Roles of rows stay as they are, whatever they are; long texts and clashing columns do no harm."""
    long = "<|end|> é\n" * 60_000
    turns = [(1, 0, "human", "hi"), (1, 1, "gpt", "no assistant"), (1, 2, "assistant", long), (2, 0, "assistant", long), (2, 1, "model", "")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    records = df.select(F.to_variant_object(F.struct("conv_id", "turn", "role", "text")).alias("record"), F.lit(3).alias("layout"), F.lit("x").alias("head"), F.lit("y").alias("turns"))
    made = chat_format.format_turns(chat_format.canonical_turns(records, "record"))
    got = {r.conv_id: r for r in made.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for c in (1, 2):
        assert [(x.role, x.text) for x in got[c].turns] == [(r, t) for k, _, r, t in turns if k == c]
        assert got[c].loss == long


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, duck, name):
    same(queries.queries()[name](spark, sf_dir), duck, queries.oracle_sql()[name])


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "tokens":
            assert out.columns == docs.columns, name
            docs = spark.createDataFrame(out.collect(), out.schema)
    rows = out.collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    assert 0.6 * before < len(rows) < before
    assert collections.Counter(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()) == collections.Counter(r.doc_id for r in rows)


def test_pipeline_stages_of_odd_rows(spark, sf_dir):
    """Nulls, empty and repeated rows, clashing columns, and tables without rows or without columns that no stage needs."""
    import corpus_pipeline

    full, bare = cases.odd(spark), cases.odd(spark).select("text", "doc_id")
    for docs in (full, full.limit(0), bare):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if name == "tokens":
                got = out.collect()
                assert all(r.round_trip for r in got) and len(got) == docs.count()
            else:
                assert out.columns == docs.columns, name
                docs = spark.createDataFrame(out.collect(), out.schema)
    clean = {k for k, t, *_ in cases.odd_rows() if not cases.words(t)}
    assert clean <= {r.doc_id for r in got}
