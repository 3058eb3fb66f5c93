"""Document fingerprints: a canonical exact digest, with DataFrame and SQL functions only.

Texts are normalised (NFKC) and case-folded twice over, which is Unicode's caseless form, runs of white space fold to one
space, and the ends are trimmed. The digest is two differently salted 64-bit xxhashes of that. Documents with equal
digests are grouped and compared byte by byte; where a group holds different canonical texts, their digests are extended
by a cryptographic one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.llm.common import forget, materialize, narrowed, release

#: Ids in one range of the ordering, and ranges at most (this bounds what is broadcast).
RANGE_ROWS, MOST_RANGES = 50_000, 20_000


def canonical(text: Column) -> Column:
    """Case-folded NFKC, folded and trimmed white space; null counts as empty. ASCII texts need lower case only."""
    t = F.coalesce(text, F.lit(""))
    nfkc = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    folded = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(nfkc(fold(nfkc(fold(nfkc(t))))))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}\x85]+", " "))


def digest(canon: Column) -> Column:
    """128 bits as hex, from two xxhashes with different salts before the text."""
    half = lambda salt: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(salt), canon))), 16, "0")
    return F.concat(half("left"), half("right"))


def colliding(texts: DataFrame) -> DataFrame:
    """Digests (fp) that several different canonical texts (c) share: compared as bytes, partially aggregated first.

    There are none unless someone makes xxhash collide on purpose, under both salts.
    """
    return texts.groupBy("fp").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a <> b").select("fp")


def next_ids(ids: DataFrame) -> DataFrame:
    """id (k), its ``need``, and the next id (nxt) in descending order, the first one after the last.

    Ids are dealt over ranges; only the first id of each range, of which there are at most ``MOST_RANGES``, is looked at
    as a whole.
    """
    n = ids.count()
    ranges = min(max(1, -(-n // RANGE_ROWS), min(32, n)), MOST_RANGES)
    placed = materialize(ids.repartitionByRange(ranges, F.col("k").desc()).withColumn("pid", F.spark_partition_id()), "order")
    firsts = placed.groupBy("pid").agg(F.max("k").alias("first"))
    everything = Window.orderBy("pid")
    after = firsts.select("pid", F.coalesce(F.lead("first").over(everything), F.max("first").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    inside = F.lead("k").over(Window.partitionBy("pid").orderBy(F.col("k").desc()))
    return placed.withColumn("inside", inside).join(F.broadcast(after), "pid").select("k", "need", F.coalesce("inside", "after").alias("nxt"))


def _extended(rows: DataFrame, fp: str, text: str, clashes: DataFrame) -> DataFrame:
    """The rows with the digests in ``clashes`` extended by a cryptographic digest of the canonical text."""
    marked = rows.join(clashes.select(F.col("fp").alias(fp), F.lit(True).alias("clash")), fp, "left")
    longer = F.concat(fp, F.lit("-"), F.sha2(canonical(F.col(text)).cast("binary"), 256))
    return marked.withColumn(fp, F.when(F.col("clash"), longer).otherwise(F.col(fp))).drop("clash")


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, as the contract of op3 words it.

    Returns id, n_chars, edited (the edited text), fingerprint, edited_fingerprint, near_edited, near_next. Null texts
    count as empty; repeated ids share their next document, and where the next id repeats, its row with the smallest
    (needed prefix, fingerprint) is taken; rows with a null id have themselves as the next document; other columns are
    ignored; an empty table gives no rows.

    Canonical forms of all texts are made twice, for a narrow table of digests and on the way to the shuffle of the rows, and
    once more of edited texts and of texts that share a digest. Texts that may share a digest are shuffled to be compared;
    when that shuffle has gone, all are shuffled once by id, beside the prefixes that the rows before them ask for. Digests
    travel with that shuffle, as a join that brings them would shuffle the texts once more.
    """
    base = docs.select(F.col(doc_id).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("th", F.xxhash64("t"))
    fresh = digest(canonical(F.col("t")))
    prints = materialize(base.select("k", "th", fresh.alias("fp"), F.length("t").alias("n")), "prints")
    known = prints.filter("k IS NOT NULL")
    links = materialize(next_ids(known.groupBy("k").agg(F.max(F.floor(F.col("n") / 3)).cast("int").alias("need"))), "next")

    with_id = base.filter("k IS NOT NULL")
    shared = materialize(prints.groupBy("fp").count().filter("count > 1").select("fp"), "shared")
    repeated = materialize(known.join(shared, "fp", "left_semi").select("k", "th", "fp").distinct(), "repeated")
    texts = narrowed(with_id, repeated, "k", "th").join(repeated, ["k", "th"]).select("fp", canonical(F.col("t")).alias("c"))
    clashes = materialize(colliding(texts), "colliding")
    clashing = not clashes.isEmpty()
    forget(shared)
    forget(repeated)
    release(docs.sparkSession)  # the texts shuffled for this, before the rows' own shuffle
    extended = lambda rows, fp, of: _extended(rows, fp, of, clashes) if clashing else rows

    own = extended(with_id.select("k", "t", fresh.alias("fp")), "fp", "t")
    asked = links.select(F.col("nxt").alias("k"), F.col("k").alias("asker"), "need")
    nexts = own.join(asked, "k").select("asker", F.struct(F.expr("substring(t, 1, need)").alias("p"), F.col("fp").alias("fp")).alias("n")).groupBy("asker").agg(F.min("n").alias("n"))
    joined = own.join(nexts.select(F.col("asker").alias("k"), F.col("n.p").alias("p"), F.col("n.fp").alias("next_fp")), "k", "left")
    alone = extended(base.filter("k IS NULL").withColumn("fp", fresh), "fp", "t")
    alone = alone.select("k", "t", "fp", F.expr("substring(t, 1, int(floor(length(t) / 3)))").alias("p"), F.col("fp").alias("next_fp"))
    rows = joined.select("k", "t", "fp", "p", "next_fp").unionByName(alone).withColumn("n", F.length("t"))
    edited = rows.select("k", "t", "n", "fp", "next_fp", F.expr("concat(substring(t, 1, n - int(floor(n / 3))), substring(p, 1, int(floor(n / 3))))").alias("e"))
    out = extended(edited.withColumn("efp", digest(canonical(F.col("e")))), "efp", "e")
    same = F.col("fp") == F.col("efp")
    equal = F.when(same, canonical(F.col("t")) == canonical(F.col("e"))).otherwise(F.lit(False))
    return out.select(
        F.col("k").alias(doc_id), F.col("n").cast("bigint").alias("n_chars"), F.col("e").alias("edited"), F.col("fp").alias("fingerprint"), F.col("efp").alias("edited_fingerprint"),
        equal.cast("double").alias("near_edited"), (F.col("fp") == F.col("next_fp")).cast("double").alias("near_next"),
    )
