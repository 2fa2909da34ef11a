"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives (rows labelled 1) and unlabelled web text train a small network on measures of a text's
characters, words and lines, and a linear part on its hashed words. The risk is ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``
with the logistic loss, minimised by Adam in numpy; where the bracket falls below zero, the step goes against it, as the
non-negative estimator prescribes. Labelled negatives take no part.

The class prior is estimated from positives and unlabelled rows alone: a first model tells the two samples apart, and
among the highest scores of rows it has not seen, where hardly any negatives are, the unlabelled rows' share over
the positives' is the prior; the smallest upper bound of that ratio over all cuts is taken (best bin estimation). Scores
are shifted so that the unlabelled rows' mean is the prior.

Both samples are bounded (``POSITIVES``, ``UNLABELLED``) and drawn by a hash of the ids among the documents
outside the held-out fold; only their measures go to the driver. Every whole text is measured and scored.

Defined results: null texts count as empty and are scored; with no trusted positive every score is a half.
Repeated rows and ids give a row each; null ids stay and are not learned from; rows of labels without a document, and null
labels, are ignored, and a document with several labels is a positive if any is 1; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows of the two samples that the model is fitted on, at most (about).
POSITIVES = 4000
UNLABELLED = 16_000
HIDDEN = 12
EPOCHS = 800
RATE = 0.03
THRESHOLD = 0.3
MOD = 5
#: Weight decay of the measures' weights, and of the words'.
WEIGHTS, DECAY = 1e-4, 1e-4

_CLASSES = np.zeros((256, 12))
for _c in range(256):
    _k = chr(_c)
    _CLASSES[_c, 0 if _c >= 128 else 1 if "a" <= _k <= "z" else 2 if "A" <= _k <= "Z" else 3 if _k.isdigit() else 4 if _k == "\n" else 5 if _k.isspace() else 6 if _k in ".,;:" else 7 if _k in "!?" else 8 if _k in "#*$%&" else 9 if _k in "|<>" else 10 if _k in "'\"()-" else 11] = 1
N = 24
#: Buckets of the hashed words.
WORDS = 1024


def lexical(words: Counter) -> np.ndarray:
    """The words' buckets by the root of their counts, of length 255 in all."""
    at = np.fromiter((zlib.crc32(w) & (WORDS - 1) for w in words), np.int64, len(words))
    times = np.sqrt(np.bincount(at, np.fromiter(words.values(), np.float64, len(words)), WORDS))
    return np.round(255 * times / max(np.sqrt((times * times).sum()), 1)).astype(np.uint8)


def measures(text) -> tuple[np.ndarray, np.ndarray]:
    """A text's N measures, all from 0 to about 1, and its words' buckets."""
    data = (text or "").encode("utf-8", "replace")
    f = np.zeros(N, np.float32)
    words = data.split()
    n = len(words)
    if not n:
        f[23] = 1
        return f, np.zeros(WORDS, np.uint8)
    counted = Counter(words)
    size = len(data)
    f[:12] = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASSES / size
    distinct = len(counted)
    f[12] = distinct / n
    f[13] = (1 - distinct / n) * min(1.0, np.log1p(n) / 5)
    f[14] = sum(a == b for a, b in zip(words, words[1:])) / n
    f[15] = sum(1 for w in words if w[-1:] in b"#*$%&|<>~^_=+" or w[-2:] in (b"!!", b"??")) / n
    upper = data.count(b"!!") + data.count(b"??")
    f[16] = min(1.0, upper / n)
    f[17] = min(2.0, size / n / 10)
    lines = [x for x in data.split(b"\n") if x.strip()]
    f[18] = 1 - len(set(lines)) / len(lines)
    f[19] = sum(1 for x in lines if x.rstrip()[-1:] in (b".", b"!", b"?")) / len(lines)
    f[20] = min(1.0, np.log1p(n) / 12)
    f[21] = min(1.0, n / len(lines) / 200)
    ends = data.count(b". ") + data.count(b".\n") + data.endswith(b".")
    f[22] = min(1.0, 5 * ends / n)
    f[23] = n < 10
    return f, lexical(counted)


@dataclass
class Rows:
    """Measures (float) and words' buckets (uint8) of texts."""

    x: np.ndarray
    words: np.ndarray

    def __len__(self):
        return len(self.x)

    def take(self, at) -> Rows:
        return Rows(self.x[at], self.words[at])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: list = field(default_factory=list)  # hidden weights and biases, output weights, bias, direct weights, words' weights
    shift: float = 0.0

    def forward(self, rows: Rows) -> np.ndarray:
        return _forward(self.weights, (rows.x - self.mean) / self.scale, rows.words)[1] + self.shift


def _forward(w, x, words):
    h = np.tanh(x @ w[0] + w[1])
    return h, h @ w[2] + x @ w[4] + w[3][0] + words.astype(np.float32) @ (w[5] / 255).astype(np.float32)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(model: Model, rows: Rows) -> np.ndarray:
    return _sigmoid(model.forward(rows)) if model.weights else np.full(len(rows), 0.5)


def nn_risk(z: np.ndarray, k: int, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of outputs z, of k positives and then unlabelled rows, and the slope that a step follows."""
    s, n = _sigmoid(z), len(z) - k
    plus, minus = np.logaddexp(0, -z), np.logaddexp(0, z)  # the loss of calling a row positive and negative
    bracket = minus[k:].mean() - prior * minus[:k].mean()
    d = np.empty(len(z))
    if bracket >= 0:
        d[:k] = prior * ((s[:k] - 1) - s[:k]) / k
        d[k:] = s[k:] / n
    else:  # the estimate of the negatives' risk has gone below what is possible
        d[:k] = prior * s[:k] / k
        d[k:] = -s[k:] / n
    return float(prior * plus[:k].mean() + max(0.0, bracket)), d


def train(positive: Rows, unlabelled: Rows, prior: float | None = None, seed: int = 11, epochs: int = EPOCHS) -> Model:
    """Minimises the non-negative unbiased risk over the two samples; without a prior, the risk of telling them apart."""
    model = Model(np.zeros(N), np.ones(N))
    if not len(positive) or not len(unlabelled):
        return model
    rng = np.random.default_rng(seed)
    both = np.concatenate((positive.x, unlabelled.x))
    model.mean, model.scale = both.mean(0), np.maximum(both.std(0), 0.02)
    p, u = (Rows((r.x - model.mean) / model.scale, r.words) for r in (positive, unlabelled))
    w = [rng.normal(0, 0.3, (N, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1), np.zeros(N), np.zeros(WORDS)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for step in range(1, epochs + 1):
        a, b = (r.take(rng.integers(0, len(r), min(len(r), most))) for r, most in ((p, 1000), (u, 2000)))
        x, words, k = np.concatenate((a.x, b.x)), np.concatenate((a.words, b.words)), len(a)
        h, z = _forward(w, x, words)
        if prior is None:
            s = _sigmoid(z)
            d = np.concatenate(((s[:k] - 1) / (2 * k), s[k:] / (2 * (len(x) - k))))
        else:
            d = nn_risk(z, k, prior)[1]
        dh = np.outer(d, w[2]) * (1 - h * h)
        own = (d.astype(np.float32) @ words.astype(np.float32)) / 255
        grads = [x.T @ dh + WEIGHTS * w[0], dh.sum(0), h.T @ d + WEIGHTS * w[2], np.array([d.sum()]), x.T @ d + WEIGHTS * w[4], own + DECAY * w[5]]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            w[i] = w[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    model.weights = w
    return model


def estimate_prior(positive: Rows, unlabelled: Rows) -> float:
    """The share of positives among the unlabelled rows, by best bin estimation."""
    half = lambda r, k: r.take(np.arange(len(r)) % 2 == k)
    if len(positive) < 2 or len(unlabelled) < 2:
        return 0.5
    bounds = []
    for k in (0, 1):
        model = train(half(positive, k), half(unlabelled, k), None, 5 + k, EPOCHS // 2)
        p, u = np.sort(model.forward(half(positive, 1 - k))), np.sort(model.forward(half(unlabelled, 1 - k)))
        cuts = np.quantile(p, np.linspace(0, 0.9, 91))
        over = lambda r: 1 - np.searchsorted(r, cuts) / len(r)
        slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
        share_p, share_u = over(p), over(u)
        best = np.argmin((share_u + slack) / np.maximum(share_p, 1e-9))
        bounds.append(share_u[best] / max(share_p[best], 1e-9))
    return float(np.clip(np.mean(bounds), 0.01, 0.99))


def calibrated(model: Model, unlabelled: Rows, prior: float) -> Model:
    """The model with the shift at which the unlabelled rows' mean score is the prior."""
    if model.weights:
        z, low, high = model.forward(unlabelled), -40.0, 40.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if _sigmoid(z + middle).mean() < prior else (low, middle)
        model.shift = (low + high) / 2
    return model


def _measured(texts: pa.Array) -> Rows:
    both = [measures(t.as_py()) for t in texts]
    x = np.stack([a for a, _ in both]).astype(np.float64) if both else np.zeros((0, N))
    return Rows(x, np.stack([b for _, b in both]) if both else np.zeros((0, WORDS), np.uint8))


def _measures():
    @F.arrow_udf("struct<x:binary,words:binary>")
    def measured(texts: pa.Array) -> pa.Array:
        rows = _measured(texts)
        cells = [pa.array([r.tobytes() for r in part], pa.binary()) for part in (rows.x, rows.words)]
        return pa.StructArray.from_arrays(cells, ["x", "words"])

    return measured


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    own = F.col("doc_id").isNotNull() & ~common.in_fold("doc_id", MOD, 0)
    marked = labels.where(own & (F.col("quality") == 1)).select("doc_id").distinct()
    trusted = common.by_hash(marked, "doc_id", 1.1 * positives / max(marked.count(), 1), "positive").limit(2 * positives)
    texts = docs.where(own).select("doc_id", F.col("text").cast("string").alias("text"))
    web = common.by_hash(texts, "doc_id", 1.1 * unlabelled / max(texts.count(), 1), "unlabelled").limit(2 * unlabelled)
    # the trusted ids number 2 * positives at most; an id may have any number of rows
    good = texts.join(F.broadcast(trusted), "doc_id").limit(2 * positives)

    def get(df):
        rows = sorted(df.select("doc_id", _measures()("text").alias("f")).select("doc_id", "f.*").collect(), key=lambda r: (r["doc_id"], r["x"], r["words"]))
        return Rows(np.frombuffer(b"".join(r["x"] for r in rows), np.float64).reshape(-1, N), np.frombuffer(b"".join(r["words"] for r in rows), np.uint8).reshape(-1, WORDS))

    p, u = get(good), get(web)
    prior = estimate_prior(p, u)
    return calibrated(train(p, u, prior), u, prior)


def classify(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    common.tune(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels))  # of fixed size

    @F.arrow_udf("double")
    def quality(texts: pa.Array) -> pa.Array:
        return pa.array(score(held.value, _measured(texts)))

    found = docs.select("doc_id", quality(F.col("text").cast("string")).alias("score"))
    return found.select("doc_id", common.in_fold("doc_id", MOD, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1_quality_classifier(spark, sf_dir):
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
