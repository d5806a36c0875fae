"""A training corpus from raw documents: quality, toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows its predecessor kept. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.llm import packing, passages, quality, simhash, toxicity
from rillmark.llm.common import free_name, id_filter, materialize, table, with_bit


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows whose text the quality model scores THRESHOLD or more.

    Null and empty texts have a score as any other; null and repeated ids are rows each (ids do not matter); texts are
    read whole, however long; an empty table gives an empty one; further columns, whatever their names, stay."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    name = free_name(docs.columns, "quality_score")
    return quality.score(docs, model, score_col=name).where(F.col(name) >= quality.THRESHOLD).select(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows whose text the toxicity model scores below THRESHOLD.

    Null and empty texts have a score as any other; null and repeated ids are rows each (ids do not matter); texts are
    read whole, however long; an empty table gives an empty one; further columns, whatever their names, stay."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    name = free_name(docs.columns, "toxicity_score")
    return toxicity.score(docs, model, score_col=name).where(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates (shingles of five words, similarity of 0.8): that of smallest id.

    Texts meet by linked SimHash fingerprints (2 bits, as in op8) and by minima of their shingles; those that meet are
    compared whole.
    Null, empty and blank texts are one group. Groups hold rows, not ids: of several texts under one id those that are
    copies go, and of rows equal in id and text one stays (any, should further columns differ). Rows without an id stay.
    An empty table gives an empty one. Only rows that may go are moved to meet the list of those that do."""
    groups = materialize(simhash.similar_documents(docs), "groups")
    key, digest = free_name(docs.columns, "key"), free_name(docs.columns, "digest")
    named = F.col("id").alias(key), F.col("text_hash").alias(digest)
    copies = materialize(groups.where("not first").select(*named).distinct(), "copies")
    again = materialize(groups.where("first").groupBy(*named).count().where("count > 1").select(key, digest), "again")

    def met(rows: DataFrame, listed: DataFrame, how: str) -> DataFrame:
        text_hash = F.xxhash64(rows["text"].cast("string"))
        return rows.join(listed, (rows["doc_id"].cast("long") == listed[key]) & (text_hash == listed[digest]), how)

    bits = id_filter(copies, key)
    out = with_bit(docs, bits, "doc_id", keep=False).union(met(with_bit(docs, bits, "doc_id", keep=True), copies, "left_anti"))
    if again.isEmpty():
        return out
    bits = id_filter(again, key)
    moved = with_bit(out, bits, "doc_id", keep=True)
    once = met(moved, again, "inner").dropDuplicates([key, digest]).select(*[moved[c] for c in docs.columns])
    return with_bit(out, bits, "doc_id", keep=False).union(met(moved, again, "left_anti")).union(once)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that stand in an earlier document out of the later ones; other texts stay to the byte.

    All rows stay. Null, empty and short texts and rows without an id stay as they are; texts of one id are documents
    each (see ``repeated_passages``); n_chars follows the text; an empty table gives an empty one."""
    spans = materialize(passages.repeated_passages(docs), "spans")
    out = passages.without_repeats(docs, spans)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of all documents into sequences: a row per piece, with its ids and its place.

    Null and empty texts are the end id alone; null and repeated ids are documents each; longer texts than a sequence
    are cut into pieces; an empty table gives an empty one."""
    import public_tokenizers

    out = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)
    return out.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("simhash", one_of_each_group),
    ("passages", without_repeated_passages),
    ("packing", packed),
]

#: Models, 64-bit hashes of shingles and token ids are not for SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
