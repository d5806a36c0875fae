"""Quality of texts: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins; cyclic boosting fits a shallow tree to the residuals of one feature after
the other and adds it to that feature's lookup table, then does the same for the pairs of features whose joint
bins explain most of what is left. A score is the sum of one table entry per feature and pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.common import Words, bytes_of, table, text_slices, tidy
from rillmark.llm.labelled import fold, training_rows

FIT_ROWS, FOLDS, HELD_OUT, THRESHOLD = 20_000, 4, 2, 0.7
FEATURES = ["log_bytes", "log_words", "word_length", "letters", "capitals", "digits", "bars", "symbols", "stops", "lines", "distinct", "repeats", "titled", "wide", "longest", "exclaims"]


def _is(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


CAPITALS, DIGITS = _is("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _is("0123456789")
LETTERS = CAPITALS | _is("abcdefghijklmnopqrstuvwxyz")
LETTERS[128:] = True
WIDE = np.arange(256) >= 0xC0  # first bytes of characters beyond ASCII
STARTS = (np.arange(256) & 0xC0) != 0x80


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each whole text of a slice; texts without words have zeros."""
    raw, at = bytes_of(texts)

    def count(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask[raw], dtype=np.int64)])[at])

    words = Words(texts, lower=False)
    n = np.diff(words.first)
    key = words.hashes()
    same = np.zeros(len(words), bool)
    same[1:] = (key[1:] == key[:-1]) & (words.text[1:] == words.text[:-1])
    order = np.lexsort((key, words.text))
    fresh = np.ones(len(words), bool)
    fresh[1:] = (key[order][1:] != key[order][:-1]) | (words.text[order][1:] != words.text[order][:-1])
    longest = np.zeros(len(n))
    full = np.flatnonzero(n)
    if len(full):
        longest[full] = np.maximum.reduceat(words.length, words.first[:-1][full])
    chars, letters, capitals = (np.maximum(count(m), 1) for m in (STARTS, LETTERS & STARTS, CAPITALS))
    per = np.maximum(n, 1)
    by_text = lambda x: np.bincount(words.text, x, len(n))
    return np.column_stack([
        np.log1p(np.diff(at)), np.log1p(n), by_text(words.length) / per, letters / chars, (capitals - (count(CAPITALS) == 0)) / letters,
        count(DIGITS) / chars, count(_is("|")) / per, count(_is("#$%&*@^~<>{}[]\\=+_")) / per, count(_is(".,;:?")) / per, count(_is("\n")) / per,
        by_text(fresh.astype(float)[np.argsort(order)]) / per, by_text(same) / per, by_text(CAPITALS[words.data[words.start]]) / per, count(WIDE) / chars, np.log1p(longest), count(_is("!")) / per,
    ])


def _tree(grad: np.ndarray, hess: np.ndarray, depth: int, ridge: float = 1.0) -> np.ndarray:
    """A shallow regression tree over ordered bins: the value of the leaf each bin falls into."""
    value = np.full(len(grad), grad.sum() / (hess.sum() + ridge))
    if depth and len(grad) > 1:
        g, h = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
        gain = g**2 / (h + ridge) + (grad.sum() - g) ** 2 / (hess.sum() - h + ridge)
        cut = int(gain.argmax()) + 1
        if gain[cut - 1] > grad.sum() ** 2 / (hess.sum() + ridge) + 1e-9:
            value[:cut], value[cut:] = _tree(grad[:cut], hess[:cut], depth - 1, ridge), _tree(grad[cut:], hess[cut:], depth - 1, ridge)
    return value


def _tree2(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """A tree over a grid: one cut across the first feature, then one across the second on each side."""
    value, best = np.zeros(grad.shape), -1.0
    for g, h, flip in ((grad, hess, False), (grad.T, hess.T, True)):
        for cut in range(1, g.shape[0]):
            sides = [(g[:cut].sum(0), h[:cut].sum(0)), (g[cut:].sum(0), h[cut:].sum(0))]
            leaves = [_tree(a, b, 1) for a, b in sides]
            gain = sum((2 * v * a - v * v * (b + 1.0 / len(b))).sum() for (a, b), v in zip(sides, leaves, strict=True))
            if gain > best:
                best, grid = gain, np.vstack([np.tile(leaves[0], (cut, 1)), np.tile(leaves[1], (g.shape[0] - cut, 1))])
                value = grid.T if flip else grid
    return value


@dataclass
class AdditiveModel:
    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]
    grids: list[np.ndarray]

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, table_ in enumerate(self.tables):
            out += table_[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for (a, b), grid in zip(self.pairs, self.grids, strict=True):
            out += grid[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 30, n_pairs: int = 6, rate: float = 0.15, bins: int = 48, coarse_bins: int = 8) -> AdditiveModel:
    """Fits the model; without rows, or with one class alone, the score is the (smoothed) share of label 1."""
    cuts = lambda n: [np.unique(np.quantile(x[:, j], np.arange(1, n) / n)) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    edges, coarse = cuts(bins), cuts(coarse_bins)
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(edges, float(np.log(share / (1 - share))), [np.zeros(len(e) + 1) for e in edges], [], coarse, [])
    if len(np.unique(y)) < 2:
        return model
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    logit = np.full(len(x), model.base)
    for _ in range(rounds):
        for j, bin_ in enumerate(at):
            p = 1 / (1 + np.exp(-logit))
            size = len(edges[j]) + 1
            step = rate * _tree(np.bincount(bin_, y - p, size), np.bincount(bin_, p * (1 - p), size), 2)
            model.tables[j] += step
            logit += step[bin_]
    low = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]

    def grids(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        cell = low[a] * shape[1] + low[b]
        return cell, *(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p)))

    def gain(a: int, b: int) -> float:
        _, g, h = grids(a, b)
        return float((g**2 / (h + 1)).sum() - (g.sum(0) ** 2 / (h.sum(0) + 1)).sum() - (g.sum(1) ** 2 / (h.sum(1) + 1)).sum())

    all_pairs = [(a, b) for a in range(x.shape[1]) for b in range(a + 1, x.shape[1]) if len(coarse[a]) and len(coarse[b])]
    model.pairs = sorted(all_pairs, key=lambda p: -gain(*p))[:n_pairs]
    model.grids = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(model.pairs):
            cell, g, h = grids(a, b)
            step = rate * _tree2(g, h)
            model.grids[k] += step
            logit += step.ravel()[cell]
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> AdditiveModel:
    """Fits on at most ``fit_rows`` labelled documents outside the held-out fold; only their features reach the driver.

    Of several texts of one id that of least hash counts; null and empty texts count as any other; labels without a
    document and documents without a label or an id do not; without usable rows every score is 0.5."""
    chosen = training_rows(labels, label_col, id_col, FOLDS, HELD_OUT, fit_rows)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")  # at most fit_rows ids
    sample = sample.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            x = features(texts)
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("id")).cast("string"), rows.column(rows.schema.get_field_index("y")), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())], ["id", "y", "x"])

    got = sample.select("id", "text", "y").mapInArrow(tidy(run), "id string, y int, x array<double>").toArrow().sort_by([("id", "ascending")])
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, got["y"].to_numpy().astype(float))


def score(docs: DataFrame, model: AdditiveModel, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """``docs`` with ``score_col`` (0 to 1, higher for label 1), from each row's whole text alone, however long. Null and
    empty texts have all features zero and a score; ids do not matter; an empty table gives an empty one."""
    names = [*docs.columns, score_col]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches, text_col):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(model.score(features(texts)))], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{score_col}` double"
    return docs.mapInArrow(tidy(run), schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id, held_out, score, predicted) for every row. Null and empty texts are scored like others (all features zero);
    repeated rows are scored each; without usable labels every score is 0.5; an empty table gives an empty one."""
    model = train(docs, labels, id_col, text_col, fit_rows=fit_rows)
    scored = score(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), model)
    return scored.select("id", F.coalesce(fold("id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))


def op7(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
