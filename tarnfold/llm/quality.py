"""Quality classifier: hashed word n-gram logistic regression trained with FTRL-proximal updates.

Words are runs of letters, digits and bytes beyond ASCII, and runs of other signs, case kept. A text's features are its distinct hashed
word unigrams and bigrams, weighted by ``1 + ln(count)`` and scaled to unit length, beside a bias. Training folds the
labelled rows through follow-the-regularised-leader (per-coordinate rates, L1 and L2 terms); scoring is one sparse dot
product a text, in Arrow batches.

Bound: at most ``max_train`` labelled rows are learned from, those with the smallest hash of their id. Their features go
through one task in order, once an epoch, in pieces of ``PIECE``; it holds the ``2**bits`` coordinates and one batch, and
only the weights reach the driver. Everything else, scoring above all, covers every row and every whole text.

Defined results: a null or empty text scores as the bias alone; rows of ``labels`` with a null id or a null label teach
nothing; repeated label rows of one id count once, with the smallest label; of the texts of a repeated labelled id the
smallest teaches; with no label rows at all the score is 0.5; repeated documents are scored each; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.llm.words import runs

BITS = 18
MAX_TRAIN = 8192
EPOCHS = 3
THRESHOLD = 0.3
#: Features of a row that travels to the training task.
PIECE = 4096


_STEP = np.uint64(0x9E3779B97F4A7C15)


def features(text: bytes | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The hashed features of a whole text (UTF-8): sorted distinct indices and their weights (unit length)."""
    one = runs(text or b"")
    if not len(one):
        return np.empty(0, np.int64), np.empty(0)
    two = (one[:-1] * _STEP) ^ (one[1:] + (one[:-1] >> np.uint64(29)))
    grams = np.sort((np.concatenate([one, two * _STEP]) >> np.uint64(64 - bits)).astype(np.int32))
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    weight = 1.0 + np.log(np.diff(np.append(first, len(grams))))
    return grams[first].astype(np.int64), weight / np.sqrt((weight * weight).sum())


class Ftrl:
    """FTRL-proximal state of a logistic regression; the last coordinate is the bias."""

    def __init__(self, bits: int = BITS, alpha: float = 4.0, beta: float = 1.0, l1: float = 0.0, l2: float = 0.001):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, i: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[i]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2))

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        i, x = np.append(index, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(i)
        g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        root = np.sqrt(self.n[i] + g * g)
        self.z[i] += g - (root - np.sqrt(self.n[i])) / self.alpha * w
        self.n[i] += g * g


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: CRC-32 of the id as text leaves remainder 0 by 5 (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(spark: SparkSession, documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Learns from at most ``max_train`` labelled rows outside the held-out fold."""
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_train)
    )
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    sample = documents.select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(chosen), "id")  # at most max_train pairs of numbers
    sample = sample.groupBy("id", "label").agg(F.min("text").alias("text"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for order, label, text in zip(pdf["order"], pdf["label"], pdf["text"], strict=True):
                i, x = features(text, bits)
                for k in range(0, max(len(i), 1), PIECE):
                    out.append((order, k, len(i), label, i[k : k + PIECE].astype("<i4").tobytes(), x[k : k + PIECE].astype("<f4").tobytes()))
            yield pd.DataFrame(out, columns=["order", "piece", "length", "label", "i", "x"])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, indices, values, held = Ftrl(bits), [], [], 0
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                indices.append(np.frombuffer(r.i, "<i4").astype(np.int64))
                values.append(np.frombuffer(r.x, "<f4").astype(float))
                held += len(indices[-1])
                if held == r.length:
                    model.learn(np.concatenate(indices), np.concatenate(values), r.label)
                    indices, values, held = [], [], 0
        yield pd.DataFrame({"weights": [model.weights().astype("<f4").tobytes()]})

    numbered = sample.select("label", "text", F.xxhash64("id").alias("order"))
    pieces = numbered.mapInPandas(hashed, "order bigint, piece int, length int, label int, i binary, x binary")
    turns = pieces.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    # One task, as the updates depend on each other: at most max_train rows an epoch, sorted outside memory.
    made = turns.repartition(1).sortWithinPartitions("epoch", "order", "label", "length", "piece").mapInPandas(fit, "weights binary").first()
    return np.frombuffer(made["weights"], "<f4") if made else np.zeros((1 << bits) + 1, np.float32)


def score(documents: DataFrame, weights: np.ndarray, text_col: str = "text", out: str = "score", bits: int = BITS) -> DataFrame:
    """All rows and columns of ``documents`` with the probability of label 1 in ``out``."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))  # 2**bits + 1 numbers, whatever the input

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value.astype(float)
        for batch in texts:
            dots = []
            for text in batch:
                i, x = features(text, bits)
                dots.append(w[i] @ x + w[-1])
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(np.array(dots, dtype=float), -500, 500))))

    return documents.withColumn(out, scored(F.col(text_col).cast("binary")))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **kw) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``documents``."""
    spark = documents.sparkSession
    weights = train(spark, documents, labels, **kw)
    return score(documents.select("doc_id", "text"), weights).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    )


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
