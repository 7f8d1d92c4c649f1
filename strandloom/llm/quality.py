"""Quality classifier: regularised quadratic discriminant (operator 8).

Document statistics are transformed so that both classes are near normal; each class has a
mean and a covariance shrunk towards the pooled diagonal; the score is the sigmoid of the
difference of the log densities (Mahalanobis distances through cached Cholesky factors) plus
the log prior odds. The moments are summed over all learned rows, so nothing is sampled.

Defined results. A null text counts as empty and is scored; a text of any length is scored whole; a null doc_id is held out; labels
other than 0 and 1 are not learned; with fewer than two rows of a class every score is the
share of class 1 (0.5 without labels); repeated rows are scored alike; an empty table gives
no row; other columns are left out, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import store

STATISTICS = ("words", "word_length", "word_length_spread", "distinct_words", "top_word", "symbol_chars", "symbol_words", "digit_chars", "upper_chars", "stops_per_word", "commas_per_word", "lines_per_word", "repeated_lines", "line_length", "entropy", "non_ascii")
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()-]")


def statistics(text: str) -> list[float]:
    """The transformed statistics, in the order of STATISTICS."""
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    k = len(words)
    sizes = np.fromiter(map(len, words), dtype=float, count=k)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    symbols = _SYMBOL.findall(text)
    symbol_words = sum(1 for w, c in counts.items() if symbols and _SYMBOL.search(w) for _ in range(c)) if symbols else 0
    chars = np.array([*Counter(text).values()], dtype=float) / n
    ratio = lambda a, b: math.sqrt(a / b)
    return [
        math.log1p(k),
        float(sizes.mean()),
        math.log1p(float(sizes.std())),
        math.log((len(counts) + 1) / (k + 2 - len(counts))),
        ratio(max(counts.values()), k),
        ratio(len(symbols), n),
        ratio(symbol_words, k),
        ratio(len(re.findall(r"\d", text)), n),
        ratio(len(re.findall(r"[A-Z]", text)), n),
        ratio(text.count(".") + text.count("!") + text.count("?"), k),
        ratio(text.count(","), k),
        ratio(len(lines), k),
        ratio(len(lines) - len(set(lines)), len(lines)),
        math.log1p(n / len(lines)),
        float(-(chars * np.log(chars)).sum()),
        ratio(n - len(text.encode("ascii", "ignore")), n),
    ]


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and stats (array of doubles), one row per row of docs."""
    store.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) if t else [0.0] * len(STATISTICS) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "stats"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, stats array<double>")


@dataclass(frozen=True)
class QuadraticDiscriminant:
    """Means, Cholesky factors of the shrunk covariances, their log determinants and the prior."""

    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    log_dets: tuple[float, float]
    log_odds: float

    @staticmethod
    def fit(n: np.ndarray, sums: np.ndarray, products: np.ndarray, shrinkage: float = 0.1) -> QuadraticDiscriminant | None:
        """From each class's count, sum and sum of outer products."""
        if min(n) < 2:
            return None
        d = sums.shape[1]
        means = sums / n[:, None]
        scatter = [products[c] - n[c] * np.outer(means[c], means[c]) for c in (0, 1)]
        pooled = np.diag(scatter[0] + scatter[1]) / n.sum()
        scale = 1 / np.sqrt(np.maximum(pooled, 1e-9))
        factors, dets = [], []
        for c in (0, 1):
            cov = scatter[c] / n[c] * np.outer(scale, scale)
            weight = max(shrinkage, min(1.0, d / n[c]))
            low = np.linalg.cholesky((1 - weight) * cov + weight * np.eye(d) + 1e-6 * np.eye(d))
            factors.append(np.linalg.inv(low))
            dets.append(2 * float(np.log(np.diag(low)).sum()))
        return QuadraticDiscriminant(scale, (means[0], means[1]), (factors[0], factors[1]), (dets[0], dets[1]), float(np.log(n[1] / n[0])))

    def score(self, x: np.ndarray) -> np.ndarray:
        density = [-0.5 * ((((x - self.means[c]) * self.scale) @ self.factors[c].T) ** 2).sum(axis=1) - 0.5 * self.log_dets[c] for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.log_odds, -500, 500)))


def moments(labelled: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and sums of outer products by class of (stats, label), summed in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            if batch.num_rows:
                x, y = np.array(batch.column("stats").to_pylist(), dtype=float), np.array(batch.column("label").to_pylist())
                for c in (0, 1):
                    own = x[y == c]
                    total[c] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        at = np.arange(2 * (1 + d + d * d))
        yield pa.RecordBatch.from_pydict({"at": at, "value": total.ravel()})

    out = np.zeros(2 * (1 + d + d * d))
    for r in labelled.select("stats", "label").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    out = out.reshape(2, -1)
    return out[:, 0], out[:, 1 : d + 1], out[:, d + 1 :].reshape(2, d, d)


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def clean_labels(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """One 0/1 label per id: the largest where an id has several."""
    return labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held_fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    d = len(STATISTICS)
    rows = store.stored(with_statistics(docs, id_col, text_col), "quality")
    learned = rows.where(bucket(F.col("doc_id"), folds) != held_fold).join(clean_labels(labels, label, id_col), "doc_id")
    n, sums, products = moments(learned, d)
    model = QuadraticDiscriminant.fit(n, sums, products)
    share = float(n[1] / n.sum()) if n.sum() else 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("stats").to_pylist(), dtype=float)
                s = model.score(x) if model else np.full(len(x), share)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype("i4"))], names=["doc_id", "score", "predicted"])

    scored = rows.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(bucket(F.col("doc_id"), folds) == held_fold, F.lit(True)).alias("held_out"), "score", "predicted")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
