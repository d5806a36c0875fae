"""Toxicity of texts: non-negative positive-unlabelled learning.

Confirmed toxic texts (P) and a sample of texts of unknown kind (U) train a logistic model over the presence of
words. With the class prior pi, the risk is pi * loss(P as toxic) + max(0, loss(U as clean) - pi * loss(P as clean)):
the unlabelled texts stand for clean ones once the share of toxic ones among them is taken off, and where that
difference turns negative (the model has begun to learn U by heart) the step goes back up.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.common import MARKS, Words, materialize, table, text_slices, tidy
from rillmark.llm.labelled import fold, training_rows

POSITIVE_ROWS, UNLABELLED_ROWS, VOCABULARY, MIN_Z, FOLDS, HELD_OUT, THRESHOLD = 4_000, 16_000, 512, 6.0, 5, 0, 0.5


def word_presence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words (runs of letters, digits and bytes beyond ASCII) of each text: text number and word hash."""
    words = Words(texts, between=MARKS)
    key, text = words.hashes(), words.text
    order = np.lexsort((key, text))
    key, text = key[order], text[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    return text[fresh], key[fresh].view(np.int64)


@dataclass
class WordModel:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        logit = np.full(len(texts), self.bias)
        if len(self.words):
            key = Words(texts, between=MARKS)
            hashes = key.hashes().view(np.int64)
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            hit = np.flatnonzero(self.words[at] == hashes)
            pair = np.unique(key.text[hit] * len(self.words) + at[hit])
            logit += np.bincount(pair // len(self.words), self.weights[pair % len(self.words)], len(texts))
        return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(row: np.ndarray, column: np.ndarray, positive: np.ndarray, n_columns: int, prior: float, steps: int = 600, rate: float = 0.1, ridge: float = 1e-4, back: float = 0.5) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk with the logistic loss. row, column: where a feature is present; positive: per row."""
    n_p, n_u = max(int(positive.sum()), 1), max(int((~positive).sum()), 1)
    w, m, v = np.zeros(n_columns + 1), np.zeros(n_columns + 1), np.zeros(n_columns + 1)
    w[-1] = np.log(prior / (1 - prior))
    share = np.where(positive, 1 / n_p, 1 / n_u)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[column], len(positive)) + w[-1]
        loss = np.logaddexp(0, z)  # of calling a row clean
        clean = loss[~positive].sum() / n_u - prior * loss[positive].sum() / n_p
        if clean >= 0:
            slope = np.where(positive, prior * (_sigmoid(z) - 1) - prior * _sigmoid(z), _sigmoid(z)) * share
        else:
            slope = -back * np.where(positive, -prior * _sigmoid(z), _sigmoid(z)) * share
        grad = np.concatenate([np.bincount(column, slope[row], n_columns), [slope.sum()]]) + ridge * np.concatenate([w[:-1], [0]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS, vocabulary: int = VOCABULARY) -> WordModel:
    """Fits on at most ``positive_rows`` confirmed toxic and ``unlabelled_rows`` other documents of the training folds.

    Equal texts of the sample count once, of several texts of one id that of least hash; null and empty texts have no words. The vocabulary is the ``vocabulary`` words whose share of documents differs
    most (by MIN_Z standard errors at least) between the two samples; the class prior is the share of toxic rows among the labelled.
    Without toxic rows every score is the prior's.
    """
    known = training_rows(labels, label_col, id_col, FOLDS, HELD_OUT, unlabelled_rows)
    stats = known.agg(F.count("*").alias("n"), F.sum("y").alias("k")).first()
    prior = float(np.clip(((stats["k"] or 0) + 0.5) / (stats["n"] + 1), 0.001, 0.5))
    toxic = training_rows(labels.where(F.col(label_col) == 1), label_col, id_col, FOLDS, HELD_OUT, positive_rows).select("id", F.lit(True).alias("p"))
    ids = docs.select(F.col(id_col).alias("id"))
    some = ids.where(F.col("id").isNotNull() & (fold("id", FOLDS) != HELD_OUT)).orderBy(F.xxhash64("id"), "id").limit(unlabelled_rows).select("id", F.lit(False).alias("p"))
    chosen = toxic.union(some).groupBy("id").agg(F.max("p").alias("p"))  # at most positive_rows + unlabelled_rows rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, part in text_slices(batches):
            text, key = word_presence(part)
            keep = pa.array(text)
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("same")).take(keep), rows.column(rows.schema.get_field_index("p")).take(keep), pa.array(key)], ["d", "p", "w"])

    sample = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("p").alias("p"))
    sample = sample.select("text", "p", F.xxhash64("text").alias("same"))
    seen = sample.mapInArrow(tidy(run), "d long, p boolean, w long").groupBy("d", "w").agg(F.max("p").alias("p"))
    seen = materialize(seen, "toxicity-words")
    size = {r["p"]: r["n"] for r in seen.groupBy("d").agg(F.max("p").alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = size.get(True, 0), size.get(False, 0)
    bias = float(np.log(prior / (1 - prior)))
    if not n_p or not n_u:
        return WordModel(np.zeros(0, np.int64), np.zeros(0), bias)
    a, b = F.col("a") / F.lit(float(n_p)), F.col("b") / F.lit(float(n_u))
    all_ = (F.col("a") + F.col("b") + 1) / F.lit(float(n_p + n_u + 2))
    differ = seen.groupBy("w").agg(F.sum(F.col("p").cast("int")).alias("a"), F.sum((~F.col("p")).cast("int")).alias("b")).where(F.col("a") + F.col("b") >= 5)
    best = differ.withColumn("z", F.abs(a - b) / F.sqrt(all_ * (1 - all_) * F.lit(1 / n_p + 1 / n_u))).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "w").limit(vocabulary).select("w")
    got = seen.join(F.broadcast(best), "w").toArrow()  # at most vocabulary words of each sampled text
    words = np.unique(best.toArrow()["w"].to_numpy())
    docs_, row = np.unique(got["d"].to_numpy(), return_inverse=True)
    positive = np.zeros(n_p + n_u, bool)  # rows without a word of the vocabulary come last
    flags = got["p"].to_numpy().astype(bool)
    positive[row[flags]] = True
    missing = n_p - int(positive[: len(docs_)].sum())
    positive[len(docs_) : len(docs_) + missing] = True
    weights, bias = fit(row, np.searchsorted(words, got["w"].to_numpy()), positive, len(words), prior)
    return WordModel(words, weights, bias)


def score(docs: DataFrame, model: WordModel, text_col: str = "text", score_col: str = "toxicity_score") -> DataFrame:
    """``docs`` with ``score_col`` (0 to 1), from each row's whole text alone, however long. Null and empty texts have no
    words and a score; ids do not matter; an empty table gives an empty one."""
    names = [*docs.columns, score_col]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches, text_col):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(model.score(texts))], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{score_col}` double"
    return docs.mapInArrow(tidy(run), schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds: int) -> DataFrame:
    """(id, held_out, score, predicted) for every row. Null and empty texts have no words and get the bias alone;
    repeated rows are scored each; an empty table gives an empty one."""
    model = train(docs, labels, id_col, text_col, **bounds)
    scored = score(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), model)
    return scored.select("id", F.coalesce(fold("id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= THRESHOLD).cast("int").alias("predicted"))


def op10(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
