"""Language identification: sparse multinomial logistic regression on TF-IDF weights of character n-grams.

* *Features.* All 1- to 3-grams of the lower-cased code points of a whole text, hashed to ``FEATURES`` numbers. A
  text's vector is (1 + ln count) * idf, scaled to length 1.
* *Document frequencies* come from all learning texts; tasks send one sparse count table each.
* *Training.* Follow-the-regularised-leader (FTRL-proximal) with an elastic net, one text at a time, over a sample
  of about ``per_class`` texts per language, chosen by a hash of the id. The sample is bounded by that parameter
  and trained on in one task; the L1 part keeps the weights sparse.
* *Calibration.* A fifth of the sample is held back; the temperature that gives its least log loss divides the scores.

Defined cases: null texts and texts without a letter are ``und`` with score 0; rows with a null language are
predicted but not learnt from; with no learning rows all is ``und``; ties go to the first language in code point
order; repeated rows count each time; other columns pass by unread.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

FEATURES = 1 << 15
PER_CLASS, EPOCHS = 400, 3
UNKNOWN = "und"


def held_out(doc_id: str = "doc_id", remainder: int = 0, of: int = 5) -> Column:
    """Whether crc32 of the id as text leaves this remainder."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % of == remainder, F.lit(False))


def grams(text: str) -> np.ndarray:
    """Feature numbers of all 1- to 3-grams, with repeats."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    one = points * np.uint32(2654435761)
    two = (one[:-1] ^ (points[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
    three = (two[:-1] ^ (points[2:] * np.uint32(668265263))) * np.uint32(374761393)
    return np.concatenate([one, two, three]) >> np.uint32(17)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(grams(text), minlength=FEATURES)
    where = np.flatnonzero(counts)
    return where, counts[where]


def vector(where: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[where]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def document_frequencies(texts: DataFrame) -> DataFrame:
    """One text column -> (feature, df); feature -1 counts the texts."""
    def run(batches):
        df, n = np.zeros(FEATURES, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                df[np.unique(grams(text))] += 1
                n += 1
        where = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(where, -1)), pa.array(np.append(df[where], n))], ["feature", "df"])

    return texts.mapInArrow(run, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df"))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    temperature: float

    def probabilities(self, text: str) -> np.ndarray:
        where, counts = counted(text)
        z = (vector(where, counts, self.idf) @ self.weights[where] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int, alpha: float = 2.0, beta: float = 1.0,
         l1: float = 0.02, l2: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal for softmax regression; feature FEATURES is the bias and is not penalised."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))
    penalty = np.full((FEATURES + 1, 1), l1)
    penalty[-1] = 0

    def solved(rows):
        zr, root = z[rows], np.sqrt(n[rows])
        shrunk = np.sign(zr) * np.maximum(np.abs(zr) - penalty[rows], 0)
        return -shrunk / ((beta + root) / alpha + l2)

    for _ in range(epochs):
        for where, x, label in examples:
            rows, values = np.append(where, FEATURES), np.append(x, 1.0)
            w = solved(rows)
            score = values @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[label] -= 1
            g = values[:, None] * p[None, :]
            g2 = g * g
            z[rows] += g - (np.sqrt(n[rows] + g2) - np.sqrt(n[rows])) / alpha * w
            n[rows] += g2
    w = solved(np.arange(FEATURES + 1))
    return w[:-1], w[-1]


def best_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """Least log loss over a fine grid of temperatures."""
    def loss(t):
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]))

    return min(np.geomspace(0.02, 20, 120), key=loss)


def train(learning: DataFrame, per_class: int = PER_CLASS, epochs: int = EPOCHS) -> Model | None:
    """(doc_id, text, lang) without nulls -> the model; None without rows."""
    counts = {r["lang"]: r["n"] for r in learning.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    if not counts:
        return None
    languages = sorted(counts)
    found = document_frequencies(learning.select("text")).toArrow()  # at most FEATURES + 1 rows
    feature, df = (found.column(c).to_numpy() for c in ("feature", "df"))
    texts, idf = int(df[feature == -1].sum()), np.zeros(FEATURES)
    idf[feature[feature >= 0]] = np.log((1 + texts) / (1 + df[feature >= 0])) + 1
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, per_class / n))) for x, n in counts.items()])
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 20)) / float(1 << 20)
    sample = learning.withColumn("draw", draw).filter(F.col("draw") < share).select("doc_id", "text", "lang", "draw")
    number = {x: i for i, x in enumerate(languages)}

    def run(batches):
        rows = sorted((d, str(i), t, number[g]) for b in batches for i, t, g, d in zip(*[c.to_pylist() for c in b.columns]))
        examples = []
        for _, i, text, label in rows:
            where, found = counted(text)
            examples.append((where, vector(where, found, idf), label, zlib.crc32(b"calibrate" + i.encode()) % 5 == 0))
        order = np.random.default_rng(7).permutation(len(examples))
        fitted = [examples[j][:3] for j in order if not examples[j][3]] or [e[:3] for e in examples]
        w, bias = ftrl(fitted, len(languages), epochs)
        kept = [e for e in examples if e[3]] or examples
        t = best_temperature(np.array([e[1] @ w[e[0]] + bias for e in kept]), np.array([e[2] for e in kept])) if kept else 1.0
        where = np.flatnonzero(np.abs(w).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(where, [-1, -2])), pa.array([*w[where].tolist(), bias.tolist(), [float(t)] * len(languages)], pa.list_(pa.float64()))], ["feature", "weights"])

    fitted = materialise(sample.repartition(1).mapInArrow(run, "feature long, weights array<double>"), "langid").toArrow()
    weights, bias, temperature = np.zeros((FEATURES, len(languages))), np.zeros(len(languages)), 1.0
    for feature, w in zip(*(c.to_pylist() for c in fitted.columns)):
        if feature >= 0:
            weights[feature] = w
        elif feature == -1:
            bias = np.array(w)
        else:
            temperature = float(w[0])
    return Model(languages, idf.astype(np.float32), weights.astype(np.float32), bias, temperature)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, text, held_out) -> doc_id, held_out, lang_pred, score. The model goes to tasks as it is: FEATURES numbers a language."""
    def run(batches):
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(1).to_pylist():
                if model is None or text is None or not any(map(str.isalpha, text)):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    p = model.probabilities(text)
                    best = int(p.argmax())
                    langs.append(model.languages[best])
                    scores.append(float(min(1.0, p[best])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, remainder: int = 0) -> DataFrame:
    """(doc_id, text, lang) -> a prediction per row, learnt from the rows that are not held out."""
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", held_out(remainder=remainder))
    learning = marked.filter(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    return predict(marked, train(learning))
