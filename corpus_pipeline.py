"""The corpus pipeline: stages over ``documents``, each written and read again.

Every stage takes all rows that the one before kept and returns the columns of
``documents``; the last returns token ids.  Null and empty texts have no language and go
with the first stage.  Further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopeforge.llm import crf_langid, mixture, sentencepiece_codec, signature_tree, substring_fm
from scopeforge.session import materialize

#: Near duplicates: words of a shingle and similarity.
SHINGLE, SIMILARITY = 5, 0.8
#: Mean of the words' highest posteriors below which a document counts as in no known language.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words are in languages that the labelled ones teach, in one or mixed;
    without letters, or with words that no language claims, they go."""
    chain = crf_langid.fit(crf_langid.training_rows(docs))
    lang, score, sure = unused(docs, "lang_pred", "score", "sure")
    found = crf_langid.predict(docs, chain, docs.columns, names=(lang, score, sure))
    return found.filter((F.col(lang) != "und") & (F.col(sure) >= LEAST_SCORE)).select(*docs.columns)


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    return [next(n for n in (f"_{name}{'_' * i}" for i in range(len(taken) + 1)) if n.lower() not in taken) for name in names]


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id (of
    several texts of that id, one); rows that repeat an id and text are one document."""
    th, = unused(docs, "th")
    found = signature_tree.near_duplicates(docs.select("doc_id", "text"), SHINGLE, SIMILARITY).filter("doc_id IS NOT NULL")
    found = materialize(found.groupBy("component", "doc_id", F.col("th").alias(th)).agg(F.count("*").alias("rows")), "near-duplicates")
    best = found.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", th, "rows")).alias("d")).select("d.*")
    first = materialize(best.union(found.filter("component IS NULL").select("doc_id", th, "rows")), "first-of-duplicates")
    kept = docs.withColumn(th, F.xxhash64("text")).join(first.select("doc_id", th), ["doc_id", th], "left_semi").select(*docs.columns)
    if not first.filter("rows > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.union(docs.filter("doc_id IS NULL"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the word windows that an earlier document holds; documents of which
    nothing is left go."""
    th, kept = unused(docs, "th", "kept")
    cut = substring_fm.deduplicate(docs.select("doc_id", "text")).filter("kept IS NOT NULL").select(
        "doc_id", F.col("th").alias(th), F.col("kept").alias(kept)).dropDuplicates(["doc_id", th])
    joined = docs.withColumn(th, F.xxhash64("text")).join(cut, ["doc_id", th], "left").filter(
        F.col(kept).isNull() | (F.col(kept) != ""))
    text = F.coalesce(kept, "text")
    return joined.withColumn("n_chars", F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(
        F.length(kept)).cast(docs.schema["n_chars"].dataType)).withColumn("text", text).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each reading of their source; of a
    document at the end of its source's share only the words that are taken."""
    rid, start, words, size = unused(docs, "rid", "from", "words", "size")
    columns = docs.columns
    docs = materialize(docs.withColumn(rid, F.monotonically_increasing_id()), "mix-documents")
    sizes, _, mixed = mixture.mix(docs, rid=rid)
    taken = (mixed.groupBy("rid", "epoch").agg(F.min("from_word").alias(start), F.sum("words").alias(words))
             .join(sizes.select("rid", F.col("size").alias(size)), "rid").drop("epoch").withColumnRenamed("rid", rid))
    part = F.array_join(F.slice(F.split(F.btrim("text", F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+"),
                                (F.col(start) + 1).cast("int"), F.col(words).cast("int")), " ")
    whole = F.col(words) == F.col(size)
    joined = docs.join(taken, rid).withColumn("text", F.when(whole, F.col("text")).otherwise(part))
    return joined.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text")).cast(
        docs.schema["n_chars"].dataType)).select(*columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, bytes_covered, decoded_sha256) of every document."""
    import public_tokenizers
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_codec.encode(docs, model, decoded=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.element_at("ends", -1).cast("long").alias("bytes_covered"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("mix", mix), ("encode", encode)]

#: A learned language model and a tokenizer cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
