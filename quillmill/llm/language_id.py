"""Language identification.

Sparse multinomial logistic regression on TF-IDF character n-grams, trained
with follow-the-regularised-leader (FTRL-Proximal) under an elastic-net penalty
(L1 keeps weights at zero, L2 keeps the rest small), then calibrated with one
temperature.

An n-gram is hashed to one of ``BUCKETS`` features; TF is its share of the
text's n-grams and IDF comes from document frequencies over all training texts
(one pass, a dense vector per partition). The weights are fitted on a bounded
sample: up to ``PER_CLASS`` training documents of each language and ``SAMPLE`` in
all, those with the smallest hash of id and text, of which a fifth serves the
calibration only.

Defined results: a text that is null or has no letter is ``und`` with score 0;
bytes that aren't UTF-8 are read as replacement characters; without any
training row every text is ``und``; rows with a null lang are predicted but not
learned from; more than ``MOST_LABELS`` languages are an error; repeated rows are predicted one by one; an
empty table gives an empty result; columns that clash with an output are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import carried, fraction_hash, small_batches

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Bounds on the labelled documents that the weights are fitted on: of one language, and of all.
PER_CLASS = 1000
SAMPLE = 100_000
#: Languages that one model can tell apart; its weights are features x languages in memory.
MOST_LABELS = 400
UND = "und"
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
#: Characters hashed at once; bounds the memory of a very long text.
CHUNK = 1 << 20


def read(text: bytes | None) -> str:
    return (text or b"").decode("utf-8", "replace")


def grams(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of a text's character n-grams, in chunks of whole n-grams."""
    width = max(ORDERS)
    for at in range(0, max(1, len(text)), CHUNK):
        part = text[at : at + CHUNK + width - 1]
        c = np.frombuffer(part.lower().encode("utf-32-le", "replace"), np.uint32)
        mixed = [c * m for m in _MIX]
        own = CHUNK  # n-grams that begin in this chunk
        for k in ORDERS:
            n = min(own, len(c) - k + 1)
            if n <= 0:
                continue
            h = mixed[0][:n].copy()
            for j in range(1, k):
                h ^= np.left_shift(mixed[j][j : j + n], np.uint32(j)) + np.uint32(k)
            h *= np.uint32(0x2545F491)
            yield (h >> np.uint32(16)).astype(np.int32)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers in order, and how often each occurs."""
    total = np.zeros(BUCKETS, np.int64)
    for g in grams(text):
        total += np.bincount(g, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def document_frequency(texts: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """How many of the texts hold each feature, and how many texts there are."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                n += 1
                seen = np.zeros(BUCKETS, bool)
                for g in grams(read(t)):
                    seen[g] = True
                df += seen
        slot = [*range(0, BUCKETS, 4096), -1]
        part = [df[s : s + 4096].tolist() if s >= 0 else [n] for s in slot]
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(part, pa.list_(pa.int64()))], names=["slot", "part"])

    parts = texts.select(F.col(text).cast("binary")).mapInArrow(run, "slot int, part array<long>")
    summed = (
        parts.select("slot", F.posexplode("part").alias("i", "n")).groupBy("slot", "i").agg(F.sum("n").alias("n")).where("n > 0")
    )
    got = summed.toPandas()  # at most BUCKETS + 1 rows
    df = np.zeros(BUCKETS, np.int64)
    feats = got[got["slot"] >= 0]
    df[feats["slot"].to_numpy() + feats["i"].to_numpy()] = feats["n"].to_numpy()
    return df, int(got.loc[got["slot"] < 0, "n"].sum())


def sample(train: DataFrame, label: str, key: Column, per_class: int, most: int = SAMPLE) -> DataFrame:
    """At most about ``per_class`` rows of each label and ``most`` of all, by a threshold on their hash."""
    sizes = train.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    k = sizes.count()
    per = max(1, min(per_class, most // max(1, k)))
    if k > MOST_LABELS:
        raise ValueError(f"{k} languages; a model tells at most {MOST_LABELS} apart")
    few = train.join(F.broadcast(sizes), F.col(label) == F.col("_l"))
    return few.where(key < per / F.greatest(F.lit(per), F.col("_n"))).drop("_l", "_n")


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-4, epochs: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x classes) and biases by per-coordinate FTRL-Proximal."""
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
    rng = np.random.default_rng(3)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            at, x, y = rows[r]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weights(z[at], n[at])
            p = softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(z, n)
    return w[:-1], w[-1]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden section on its log."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))[np.arange(len(y)), y]
        return -np.log(np.maximum(p, 1e-12)).mean()

    lo, hi, r = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # idf times weight, features x classes
    bias: np.ndarray
    temperature: float
    norm: float

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for g in grams(text):
            total += self.table[g].sum(axis=0, dtype=np.float64)
            n += len(g)
        return total / max(n, 1) * self.norm + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UND, 0.0
        p = softmax(self.logits(text) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(min(1.0, p[k]))


#: Scales mean TF-IDF, a number around 1, so that one step size suits any text.
NORM = 4.0


def fit(train: DataFrame, label: str = "lang", text: str = "text", doc_id: str = "doc_id", per_class: int = PER_CLASS) -> Model:
    """A model of the training rows; ``train`` holds no held-out row."""
    train = train.where(F.col(label).isNotNull()).select(doc_id, label, text)
    df, n = document_frequency(train, text)
    idf = np.log((1 + n) / (1 + df)) + 1
    small_batches(train.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            feats = [counts(read(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), *[pa.array([f[k].astype(np.int32).tobytes() for f in feats], pa.binary()) for k in (0, 1)]],
                names=["lang", "key", "at", "n"],
            )

    key = fraction_hash(F.lit("lang"), F.col(doc_id), F.col(text))
    chosen = sample(train, label, key, per_class).select(F.col(label).alias("lang"), F.col(text).cast("binary"), key.alias("key"))
    got = chosen.mapInArrow(run, "lang string, key double, at binary, n binary").toPandas()
    got = got.sort_values(["lang", "key"], kind="stable")
    langs = sorted(got["lang"].unique())
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, NORM)
    rows, held = [], []
    for i, (lang, at, c) in enumerate(zip(got["lang"], got["at"], got["n"], strict=True)):
        at, c = np.frombuffer(at, np.int32), np.frombuffer(c, np.int32)
        x = c / max(1, c.sum()) * idf[at] * NORM
        (held if i % 5 == 4 else rows).append((at, x, langs.index(lang)))
    w, bias = ftrl(rows, len(langs))
    logits = np.array([x @ w[at] + bias for at, x, _ in held]).reshape(-1, len(langs))
    t = temperature(logits, np.array([y for *_, y in held], int))
    return Model(langs, (idf[:, None] * w).astype(np.float32), bias, t, NORM)


def predict(docs: DataFrame, model: Model, text: str = "text", carry_text: bool = False) -> DataFrame:
    """The documents, with their text only if asked for, with ``lang_pred`` and ``score``.

    What is broadcast has a fixed number of features for each language.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = [c for c in docs.columns if c.lower() not in ("lang_pred", "score") and (carry_text or c != text)]
    src = carried(docs, keep, text)
    schema = docs.select(*keep).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.predict(read(t)) for t in b.column(0).to_pylist()]
            cols = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *cols], names=[*keep, "lang_pred", "score"])

    return src.mapInArrow(run, schema)
