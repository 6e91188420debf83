"""Quality classifier by positive-unlabelled learning.

An additive model of text statistics minimises the non-negative unbiased PU
risk: trusted positives carry the positive part, unlabelled web text minus the
positives' share the negative part, and the negative part may not fall below
zero (a step that would push it there is taken back instead). The class prior
is estimated from positives and unlabelled texts: a first model orders both, and
the prior is the least ratio, less what chance allows, of the unlabelled to the
held-back positives above a score. A two-parameter calibration on labelled rows
that were not fitted on then makes the score a probability.

Each statistic is cut into quantile bins of the unlabelled sample, so its
effect may bend. The model is fitted on bounded samples: up to ``PER_SET``
trusted positives, as many unlabelled texts and as many labelled rows for the
calibration, those with the smallest hash of id and text. A fifth of the
positives is held back for the prior and the calibration; with fewer than
``FEW`` of those the prior is the labelled share of positives. The model itself
is then fitted on all of them.

Defined results: a null or empty text is scored as the empty text; documents
without a label are unlabelled; of several labels of one id each counts; with
no trusted positive every score is the prior; repeated rows are scored one by
one; an empty table gives an empty result; columns that clash with an output
are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import LOWER, carried, fraction_hash, small_batches

#: Bound on each sample that the model is fitted on.
PER_SET = 6000
#: Held-back positives that can tell the class prior.
FEW = 100
BINS = 24
THRESHOLD = 0.7
FEATURES = (
    "log_words", "log_bytes", "word_length", "distinct_words", "repeat_next", "longest_run", "dup_windows",
    "top_word", "dup_lines", "log_lines", "symbols", "punctuation", "marked_words", "digits", "capitals", "capital_words",
    "high_bytes", "entropy", "pipes", "exclaim", "url_mail", "short_words", "long_words", "stop_gain",
)
_MARKS = re.compile(rb"[#*$%&|<>{}\[\]\\^~=_+@]+")
_NET = re.compile(rb"https?://|www\.|\S@\S")


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _PUNCT, _DIGIT, _UPPER, _LETTER = (
    _table(c)
    for c in (b"#*$%&|<>{}[]\\^~=_+@", b".,;:!?'\"()-", b"0123456789", bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
)


def statistics(text: bytes) -> np.ndarray:
    """The features of one whole text."""
    b = np.frombuffer(text, np.uint8)
    n = max(1, len(b))
    hist = np.bincount(b, minlength=256)
    ws = text.split()
    low = text.translate(LOWER).split()
    k = len(ws)
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = max(1, int(hist[_LETTER].sum()))
    out = dict.fromkeys(FEATURES, 0.0)
    p = hist[hist > 0] / n
    out |= {
        "log_words": np.log1p(k),
        "log_bytes": np.log1p(len(b)),
        "symbols": hist[_SYMBOL].sum() / n,
        "punctuation": hist[_PUNCT].sum() / n,
        "digits": hist[_DIGIT].sum() / n,
        "capitals": hist[_UPPER].sum() / letters,
        "high_bytes": hist[128:].sum() / n,
        "entropy": float(-(p * np.log(p)).sum()),
        "pipes": hist[124] / n,
        "exclaim": hist[33] / n,
        "log_lines": np.log1p(len(lines)),
        "dup_lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "url_mail": min(1.0, len(_NET.findall(text)) / max(1, k)),
    }
    if k:
        ids: dict[bytes, int] = {}
        seq = np.fromiter((ids.setdefault(w, len(ids)) for w in low), np.int64, k)
        same = seq[1:] == seq[:-1]
        edge = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
        freq = np.bincount(seq)
        size = np.fromiter(map(len, ws), np.int64, k)
        win = seq[:-2] + len(ids) * (seq[1:-1] + len(ids) * seq[2:]) if k > 2 else seq[:0]
        out |= {
            "word_length": size.mean(),
            "distinct_words": len(ids) / k,
            "repeat_next": same.mean() if k > 1 else 0.0,
            "longest_run": np.log(np.diff(edge).max()),
            "dup_windows": 1 - len(np.unique(win)) / len(win) if len(win) else 0.0,
            "top_word": freq.max() / k,
            "marked_words": len(_MARKS.findall(text)) / k,
            "capital_words": sum(map(bytes.isupper, ws)) / k,
            "short_words": (size <= 2).mean(),
            "long_words": (size >= 14).mean(),
            "stop_gain": float(np.sort(freq)[-5:].sum() / k),
        }
    return np.array([out[f] for f in FEATURES], np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Model:
    cuts: list[np.ndarray] = field(default_factory=list)
    w: np.ndarray | None = None
    bias: float = 0.0
    prior: float = 0.5
    slope: float = 1.0
    shift: float = 0.0

    def design(self, x: np.ndarray) -> np.ndarray:
        """Places of each row's bins in the weights; one per feature."""
        at, cols = 0, []
        for f, c in enumerate(self.cuts):
            cols.append(np.searchsorted(c, x[:, f], "right") + at)
            at += len(c) + 1
        return np.stack(cols, axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.w[self.design(x)].sum(axis=1) + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), self.prior)
        return sigmoid(self.slope * self.raw(x) + self.shift)


def nnpu(model: Model, pos: np.ndarray, unl: np.ndarray, epochs: int = 60, batch: int = 1024, lr: float = 0.02, l2: float = 1e-4, gamma: float = 1.0) -> None:
    """Fits the weights by Adam on the non-negative PU risk with logistic loss."""
    dp, du = model.design(pos), model.design(unl)
    size = sum(len(c) + 1 for c in model.cuts)
    w, prior, rng = np.zeros(size + 1), model.prior, np.random.default_rng(5)
    m, v, t = np.zeros(size + 1), np.zeros(size + 1), 0
    steps = max(1, len(du) // batch)
    for _ in range(epochs):
        op, ou = rng.permutation(len(dp)), rng.permutation(len(du))
        for s in range(steps):
            p = dp[op[s * len(dp) // steps : (s + 1) * len(dp) // steps]]
            u = du[ou[s * len(du) // steps : (s + 1) * len(du) // steps]]
            if not len(p) or not len(u):
                continue
            fp, fu = w[p].sum(axis=1) + w[-1], w[u].sum(axis=1) + w[-1]
            neg = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            # d/df of log(1+e^f) is sigmoid(f), of log(1+e^-f) is sigmoid(f) - 1
            gn_u, gn_p = sigmoid(fu) / len(fu), -prior * sigmoid(fp) / len(fp)
            gp = prior * (sigmoid(fp) - 1) / len(fp)
            g_p, g_u = (gp + gn_p, gn_u) if neg >= 0 else (-gamma * gn_p, -gamma * gn_u)
            grad = l2 * w
            np.add.at(grad, p.ravel(), np.repeat(g_p, p.shape[1]))
            np.add.at(grad, u.ravel(), np.repeat(g_u, u.shape[1]))
            grad[-1] += g_p.sum() + g_u.sum()
            t += 1
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            w = w - lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.w, model.bias = w[:-1], float(w[-1])


def class_prior(pos: np.ndarray, unl: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The share of positives among the unlabelled, by the best top bin of their scores.

    Above any score the unlabelled hold at least the positives' share of
    positives; the bin with the least bound on the ratio holds little else.
    """
    cuts = np.unique(pos)
    in_pos = 1 - np.searchsorted(np.sort(pos), cuts, "left") / len(pos)
    in_unl = 1 - np.searchsorted(np.sort(unl), cuts, "left") / len(unl)
    chance = sum(np.sqrt(np.log(4 / delta) / (2 * len(x))) for x in (pos, unl))
    best = np.argmin((in_unl + (1 + gamma) * chance) / in_pos)
    return float(np.clip(in_unl[best] / in_pos[best], 0.01, 0.99))


def calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> None:
    """Slope and shift of the log-odds by Newton steps, with a weak prior on both."""
    f = model.raw(x)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * f + b)
        r, s = p - y, np.maximum(p * (1 - p), 1e-6)
        g = np.array([(r * f).sum() + 0.01 * (a - 1), r.sum() + 0.01 * b])
        h = np.array([[(s * f * f).sum() + 0.01, (s * f).sum()], [(s * f).sum(), s.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    if a > 0:
        model.slope, model.shift = float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_set: int = PER_SET) -> Model:
    """A model from the texts and labels of training rows.

    ``labels`` (doc_id, quality) holds no held-out row. Texts of any document
    may serve as unlabelled.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(doc_id, F.col(label).cast("int").alias("_y"))
    n_docs = docs.count()
    by = {r[0]: r[1] for r in marks.groupBy("_y").count().collect()}
    n_pos, n_marks = by.get(1, 0), sum(by.values())
    prior = (n_pos + 1) / (n_marks + 2)
    key = fraction_hash(F.lit("quality"), F.col(doc_id), F.col(text))
    unl = docs.where(key < F.lit(per_set / max(per_set, n_docs))).select(text, F.lit(-1).alias("_y"), key.alias("_k"))
    # the labels chosen are a bounded set of ids, so they are broadcast; over ids, so they don't depend on texts
    pick = fraction_hash(F.lit("label"), F.col(doc_id))
    keep = F.lit(False)
    for y in (0, 1):
        keep = keep | ((F.col("_y") == y) & (pick < F.lit(per_set / max(per_set, by.get(y, 0)))))
    chosen = marks.where(keep)
    lab = docs.join(F.broadcast(chosen), doc_id).select(text, "_y", key.alias("_k"))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t or b"").tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(x, pa.binary())], names=["y", "k", "x"])

    both = unl.unionByName(lab).select(F.col(text).cast("binary"), "_y", "_k")
    got = both.mapInArrow(run, "y int, k double, x binary").toPandas().sort_values(["y", "k", "x"], kind="stable")
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, len(FEATURES)).astype(np.float64)
    y = got["y"].to_numpy()
    model = Model(prior=prior)
    pos, web = x[y == 1], x[y == -1]
    if not len(pos) or not len(web):
        return model
    grid = np.linspace(0, 1, BINS + 1)[1:-1]
    model.cuts = [np.unique(np.concatenate([np.quantile(web[:, f], grid), np.quantile(web[:, f], [0.005, 0.01, 0.02, 0.98, 0.99, 0.995])])) for f in range(len(FEATURES))]
    # rows are in the order of their hash, so the part that is held back is random and repeatable
    back = np.arange(len(pos)) % 5 == 4
    if back.sum() >= FEW:
        first = replace(model, prior=0.5)
        nnpu(first, pos[~back], web)
        model.prior = class_prior(first.raw(pos[back]), first.raw(web))
    nnpu(model, pos, web)
    bad = x[y == 0]
    if len(bad) and back.any():
        # the curve comes from a model that hasn't seen its rows; both classes are weighed as the labels are
        part = replace(model)
        nnpu(part, pos[~back], web)
        both, marks = np.concatenate([pos[back], bad]), np.repeat([1, 0], [back.sum(), len(bad)])
        weight = np.where(marks == 1, by.get(1, 0) / back.sum(), by.get(0, 0) / len(bad))
        _weighted(part, both, marks, weight)
        model.slope, model.shift = part.slope, part.shift
    return model


def _weighted(model: Model, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
    """Calibrates with weights, by repeating rows in proportion."""
    times = np.maximum(1, np.round(4 * w / w.min())).astype(int)
    calibrate(model, np.repeat(x, times, axis=0), np.repeat(y, times))


def predict(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD, carry_text: bool = False) -> DataFrame:
    """The documents, with their text only if asked for, with ``score`` and ``predicted``."""
    spark = docs.sparkSession
    small_batches(spark)
    keep = [c for c in docs.columns if c.lower() not in ("score", "predicted") and (carry_text or c != text)]
    src = carried(docs, keep, text)
    schema = docs.select(*keep).withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            x = np.stack([statistics(t or b"") for t in b.column(0).to_pylist()]) if b.num_rows else np.zeros((0, len(FEATURES)))
            s = m.score(x.astype(np.float64))
            cols = [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *cols], names=[*keep, "score", "predicted"])

    return src.mapInArrow(run, schema)
