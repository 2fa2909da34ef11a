"""Language ID: averaged embeddings of hashed subwords under a linear softmax, with calibrated rejection.

Subwords are the 2-, 3- and 4-grams of the UTF-8 bytes of the lower-cased text, in which ASCII characters that
are no letters count as spaces; each is hashed to a bucket with an embedding. A text's vector is the mean of
its subwords' embeddings; a linear softmax over it gives the language. Both are trained together by stochastic
gradient descent in numpy, on a bounded sample of labelled documents: at most ``SAMPLE`` a language and ``TOTAL`` in all,
of any length, drawn by a hash of the ids. Executors turn them into features, the ``MOST`` most frequent buckets of a document, so
what goes to the driver is bounded, however long the texts and however many the languages.

A fifth of the sample calibrates. Its documents, and a short snippet of each, set the softmax's temperature. A text is rejected if
its score, or its likeness to its language, is well under what all but ``REJECTED`` of them reach. The likeness
is the mean log probability of its buckets in the language, as a number of standard deviations from the language's mean; it is what
tells texts of languages never learned, and noise, which a softmax has to give to some language.

As the model is linear after the mean, scoring sums the buckets' logits, vectorised over a batch's bytes.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is every text when there
is no labelled row. Repeated rows and ids give a row each; null ids stay (and are not learned from); an empty
table gives no rows; extra columns are ignored; ties go to the language that sorts first. Of more than ``LANGUAGES`` languages,
the most frequent are learned.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled documents that are learned from, at most (about): of a language, and in all.
SAMPLE, TOTAL = 600, 40_000
LANGUAGES = 1000
#: Buckets of a learned document, at most.
MOST = 4096
BUCKETS = 1 << 15
GRAMS = (2, 3, 4)
DIM = 12
EPOCHS = 12
RATE = 2.0
#: Share of the calibration texts that lie beyond the usual; texts are rejected at twice the unlikeness of these, or at odds
#: lower than theirs by a factor of e.
REJECTED = 0.001
#: Bytes of the snippets that calibrate short texts.
SNIPPETS = (40, 400)
#: Grams by which a text's likeness varies no less, however long it is: texts differ by more than their grams' chance.
LIKE_GRAMS = 400
UNKNOWN = "und"
MOD, REST = 4, 2

_LETTER = re.compile(r"[^\W\d_]")
_PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # a row for each bucket: its embedding times the softmax's weights, then its log probabilities
    bias: np.ndarray
    temperature: float
    reject_under: float
    usual: np.ndarray  # the mean log probability of each language's texts
    spread: np.ndarray  # and its standard deviation at LIKE_GRAMS grams or more
    unlike_under: float

    def judge(self, z: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, rejected) of texts with the mean rows z and so many grams."""
        k = len(self.languages)
        x = (z[:, :k] + self.bias) / self.temperature
        best = x.argmax(1)
        p = np.exp(x - x.max(1, keepdims=True))
        score = p[np.arange(len(x)), best] / p.sum(1)
        return best, score, (score < self.reject_under) | (self.likeness(z, best, grams) < self.unlike_under)

    def likeness(self, z: np.ndarray, language: np.ndarray, grams: np.ndarray) -> np.ndarray:
        away = z[np.arange(len(z)), len(self.languages) + language] - self.usual[language]
        return away / self.spread[language] * np.sqrt(np.minimum(grams, LIKE_GRAMS) / LIKE_GRAMS)


def _normal(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace").translate(_PLAIN) + b" "


def buckets(data: np.ndarray, buckets_: int = BUCKETS) -> list[np.ndarray]:
    """For each gram size, the bucket of the gram that begins at each byte."""
    value = data.astype(np.uint32)
    out, rolled = [], value
    shift = 32 - int(buckets_).bit_length() + 1
    for n in range(2, max(GRAMS) + 1):
        rolled = rolled[:-1] * np.uint32(257) + value[n - 1 :]
        if n in GRAMS:
            out.append(((rolled * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(shift)).astype(np.int32))
    return out


def _features(data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """The most frequent buckets of a normal text, their shares, and the number of its grams."""
    found = np.concatenate(buckets(np.frombuffer(data, np.uint8)))
    times = np.bincount(found, minlength=BUCKETS)
    at = np.flatnonzero(times)
    if len(at) > MOST:
        at = np.sort(at[np.argsort(-times[at], kind="stable")[:MOST]])
    return at.astype(np.int32), (times[at] / max(len(found), 1)).astype(np.float32), len(found)


def _snippet(data: bytes, seed: int) -> bytes:
    """A stretch of a normal text, by its seed."""
    rng = np.random.default_rng(seed & 0x7FFFFFFF)
    size = int(rng.integers(*SNIPPETS))
    at = int(rng.integers(0, max(1, len(data) - size + 1)))
    return b" " + data[at : at + size].strip() + b" "


def train(rows: list[tuple], labels: list[str], snippets: list[tuple], seed: int = 7) -> Model:
    """Stochastic gradient descent over documents' features; every fifth is kept for calibration, with its snippet."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    k = len(languages)
    place = {x: i for i, x in enumerate(languages)}
    y = np.array([place[x] for x in labels], np.int64)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (DIM, k)).astype(np.float32), np.zeros(k, np.float32)
    held = np.arange(len(rows)) % 5 == 4
    own = np.flatnonzero(~held) if len(rows) >= 50 else np.arange(len(rows))
    steps, step = EPOCHS * len(own), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(own):
            rate = RATE * (1 - step / steps)
            step += 1
            at, share, _ = rows[i]
            mean = share @ emb[at]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            # the gradient of a mean is spread thinly over its grams; a row's own step makes up for that
            emb[at] -= (rate * 10 * share)[:, None] * back
    times = np.zeros((BUCKETS, k))
    for i in own:
        at, share, n = rows[i]
        times[at, y[i]] += share * min(n, 20_000)
    likely = np.log((times + 0.1) / (times.sum(0) + 0.1 * BUCKETS))
    model = Model(languages, np.concatenate((emb @ out, likely), axis=1).astype(np.float32), bias, 1.0, 0.0, np.zeros(k), np.ones(k), -np.inf)
    check = np.flatnonzero(held) if len(rows) >= 50 else own
    texts = [(rows[i], y[i]) for i in check] + [(snippets[i], y[i]) for i in check if snippets[i][2] >= SNIPPETS[0]]
    mean = lambda own: np.array([r[1] @ model.logits[r[0]] / max(r[1].sum(), 1e-9) for r in own], np.float64).reshape(-1, 2 * k)
    z, grams, label = mean([r for r, _ in texts]), np.array([r[2] for r, _ in texts]), np.array([c for _, c in texts], np.int64)
    if k > 1:
        def loss(t):
            x = (z[:, :k] + bias) / t
            x -= x.max(1, keepdims=True)
            return (np.log(np.exp(x).sum(1)) - x[np.arange(len(x)), label]).mean()

        grid = np.geomspace(0.01, 10, 80)
        model.temperature = float(grid[int(np.argmin([loss(t) for t in grid]))])
    for c in range(k):
        every = z[label == c, k + c] if (label == c).any() else mean([rows[i] for i in own if y[i] == c])[:, k + c]
        # a language of few documents has at least the spread of half a nat
        model.usual[c], model.spread[c] = np.median(every), max(1.4826 * np.median(np.abs(every - np.median(every))), 0.05)
    best, score, _ = model.judge(z, grams)
    right = best == label
    if right.any():
        least = float(np.quantile(score[right], REJECTED))
        model.reject_under = least / (least + (1 - least) * np.e)
        like = model.likeness(z, label, grams)[right]
        model.unlike_under = 2 * float(min(np.quantile(like, REJECTED), -4.0))
    return model


def predict(model: Model | None, texts) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, scores and rejections of an Arrow array of texts."""
    names, scores, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    for i in range(len(texts)):
        text = texts[i].as_py()
        if model is None or not text or not _LETTER.search(text):
            continue
        data = np.frombuffer(_normal(text), np.uint8)
        z, n = np.zeros(model.logits.shape[1]), 0
        for at in range(0, len(data), 1 << 16):  # a long text's grams, part by part
            for grams in buckets(data[at : at + (1 << 16) + max(GRAMS) - 1] if len(data) > (1 << 16) else data):
                own = grams[: 1 << 16]
                z += np.bincount(own, minlength=BUCKETS) @ model.logits if len(own) > BUCKETS else model.logits[own].sum(0, dtype=np.float64)
                n += len(own)
        best, score, out = model.judge(z[None] / max(n, 1), np.array([n]))
        names[i], scores[i], rejected[i] = model.languages[best[0]], score[0], out[0]
    return names, scores, rejected


FEATURES = "at binary, share binary, grams long, snippet_at binary, snippet_share binary, snippet_grams long"


def _sampled():
    @F.arrow_udf(f"struct<{FEATURES.replace(' ', ':').replace(',:', ',')}>")
    def features(texts: pa.Array, seeds: pa.Array) -> pa.Array:
        cells = []
        for text, seed in zip(texts, seeds):
            data = _normal(text.as_py())
            for own in (data, _snippet(data, seed.as_py())):
                at, share, n = _features(own)
                cells += [at.tobytes(), share.tobytes(), n]
        names = [f.split()[0] for f in FEATURES.split(", ")]
        return pa.StructArray.from_arrays([pa.array(cells[k::6], pa.int64() if k % 3 == 2 else pa.binary()) for k in range(6)], names)

    return features


def fit(docs: DataFrame, sample: int = SAMPLE, total: int = TOTAL) -> Model | None:
    """Learns from text and lang of the documents outside the held-out fold, a bounded sample of them."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~common.in_fold("doc_id", MOD, REST))
    text = F.col("text").cast("string")
    known = known.where(F.regexp_like(text, F.lit(r"\p{L}"))).select("doc_id", "lang", text.alias("text"))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return None
    sample = max(1, min(sample, total // len(counts)))
    # a margin of a tenth, as the hash draws about so many
    shares = {r["lang"]: min(1.0, 1.1 * sample / r["n"]) for r in counts}
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id")), F.lit(1_000_000))
    limits = F.create_map(*[x for lang, share in shares.items() for x in (F.lit(lang), F.lit(int(share * 1_000_000) + (share >= 1)))])
    drawn = known.where(draw < F.try_element_at(limits, F.col("lang"))).limit(2 * sample * len(shares))
    rows = drawn.select("doc_id", "lang", _sampled()("text", F.xxhash64("doc_id")).alias("f")).select("doc_id", "lang", "f.*").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["at"], r["lang"]))
    if not rows:
        return None
    read = lambda r, own: (np.frombuffer(r[own + "at"], np.int32), np.frombuffer(r[own + "share"], np.float32), r[own + "grams"])
    return train([read(r, "") for r in rows], [r["lang"] for r in rows], [read(r, "snippet_") for r in rows])


def predictor(docs: DataFrame, model: Model | None):
    """A column function of a text: struct<lang_pred, score, rejected>."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows, whatever the input's size

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def language(texts: pa.Array) -> pa.Array:
        names, scores, rejected = predict(held.value, texts)
        common.give_back()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores), pa.array(rejected, pa.bool_())], ["lang_pred", "score", "rejected"])

    return language


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every document."""
    common.tune(docs.sparkSession)
    language = predictor(docs, model or fit(docs))
    found = docs.select("doc_id", language(F.col("text").cast("string")).alias("p"))
    return found.select("doc_id", common.in_fold("doc_id", MOD, REST).alias("held_out"), "p.*")


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents whose language isn't rejected, unchanged."""
    common.tune(docs.sparkSession)
    language = predictor(docs, fit(docs))
    name = "_language_" + "_".join(sorted(docs.columns))[:64]
    return docs.withColumn(name, language(F.col("text").cast("string"))).where(~F.col(f"{name}.rejected")).select(*docs.columns)


def op7_language_id(spark, sf_dir):
    return identify(common.table(spark, sf_dir, "documents"))
