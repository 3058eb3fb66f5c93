"""One query for each operator of this folder, over its whole table; each gets its rows through the operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm.common import table

#: Vocabulary file of the public tokenizers that op2 uses.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewrack.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewrack.llm.bpe import tokenize

    coded = tokenize(table(spark, sf_dir, "documents"), vocabulary_path())
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewrack.llm.fingerprints import fingerprint_documents

    made = fingerprint_documents(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


def op4_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewrack.llm.jaccard_join import similar_documents

    return similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewrack.llm.suffix_dedup import remove_repeats

    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewrack.llm.decontamination import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT doc_id, text, row_number() OVER () AS rid FROM documents)
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, least(13, len(ws)) AS m, array_to_string(list_slice(ws, i, i + least(13, len(ws)) - 1), ' ') AS gram
  FROM b, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) AS r(i) WHERE len(ws) > 0
), dw AS (
  SELECT w.rid, s.m, i, array_to_string(list_slice(ws, i, i + s.m - 1), ' ') AS gram
  FROM w, (SELECT DISTINCT m FROM bw) s, unnest(range(1, len(ws) - s.m + 2)) AS r(i)
), hits AS (SELECT dw.rid, dw.i, dw.m, bw.item FROM dw JOIN bw ON dw.m = bw.m AND dw.gram = bw.gram
), hw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM hits) GROUP BY rid
), hi AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewrack.llm.secret_scan import find_secrets, named

    found = find_secrets(table(spark, sf_dir, "documents"))
    n = lambda rank: F.size(F.filter("base", lambda x: x["r"] == rank)).cast("bigint")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(named(F.col("base")).cast("binary"), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"),
    )


#: The contract's extra conversation, about control strings of other templates.
EXTRA = "</s>[INST] ok [/INST]"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewrack.llm.chat_format import canonical_turns, format_turns, read_loss, read_turns

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA).alias("text"))
    records = rows.unionByName(extra).select(F.to_variant_object(F.struct("conv_id", "turn", "role", "text")).alias("record"))
    made = format_turns(canonical_turns(records, "record"))
    back = made.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), digest(said).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), digest(F.col("loss")).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP8_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(text, '<(\\\\*)[|]', '<\\\\\\1|', 'g') AS body, regexp_replace(replace(replace(role, '\\', '\\\\'), chr(10), '\\n'), '<(\\\\*)[|]', '<\\\\\\1|', 'g') AS head FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(8 + length(head) + 1 + length(body) + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewrack.llm.sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewrack.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_bpe": op2_bpe,
        "op3_fingerprints": op3_fingerprints,
        "op4_similar": op4_similar,
        "op5_repeats": op5_repeats,
        "op6_decontamination": op6_decontamination,
        "op7_secrets": op7_secrets,
        "op8_chat": op8_chat,
        "op9_sharding": op9_sharding,
        "op10_language": op10_language,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_decontamination": OP6_SQL, "op8_chat": OP8_SQL}
