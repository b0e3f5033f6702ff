"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are all it is trained on: the risk of negatives
is the unlabelled risk less the positives' part of it, kept from falling below zero, as a
model that pushes it there is fitting noise. The class prior, the share of positives in
the unlabelled text, is estimated from scores: above any cut, unlabelled over positive
rates are at least the prior, and come down to it where no negatives are left.

One scan turns whole texts into a few dozen numbers, which are kept; the model is fitted
on a bounded sample of those on the driver and scores all of them as one expression.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leafmill.llm.html_extract import STOP_WORDS
from leafmill.llm.shared import hash_sample, materialize
from leafmill.llm.quality_rules import repeated_window_words
from leafmill.llm.words import PLAIN, text_chunks, thrifty, word_hashes

RATES = ["upper", "digits", "symbols", "bars", "shouts", "stops_marks", "other", "accents", "lines", "repeats", "again", "windows", "functional", "short_words", "long_words"]
SHAPE = ["size", "variety", "word_length", "no_words"]
FEATURES = [f"{r}_{k}" for r in RATES for k in ("rate", "root", "any")] + SHAPE
_STOPS = np.sort(word_hashes(sorted(STOP_WORDS), PLAIN)[0])
_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&<>@^~=+_{}[]\\/", "|", "!?", ".,;:'\"()-"), 1):
    _CLASS[[ord(c) for c in _chars]] = _i
_CLASS[128:] = 7
_CLASS[10] = 8
_CLASS[[c for c in range(128) if _CLASS[c] == 0 and not chr(c).isalnum() and chr(c) not in " \t\r\v\f"]] = 9


def features(texts: list[str | None]) -> np.ndarray:
    """FEATURES of each text, whole."""
    n = len(texts)
    words, at = word_hashes(texts, PLAIN)
    count = np.diff(at)
    per_word = np.maximum(count, 1)
    owner = np.repeat(np.arange(n), count)
    classes = np.zeros((n, 10))
    chars = np.zeros(n)
    for i, t in enumerate(texts):
        raw = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8)
        chars[i] = len(raw)
        classes[i] = np.bincount(_CLASS[raw], minlength=10)
    share = lambda x: x / np.maximum(chars, 1)
    same, again = np.zeros(len(words), bool), np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    for back in (2, 3, 4):
        again[back:] |= (words[back:] == words[:-back]) & (owner[back:] == owner[:-back])
    order = np.lexsort((words, owner))
    new = np.ones(len(words), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=n)
    stop = _STOPS[np.minimum(np.searchsorted(_STOPS, words), len(_STOPS) - 1)] == words if len(words) else np.zeros(0, bool)
    by = lambda flag: np.bincount(owner[flag], minlength=n) / per_word
    letters = share(chars - classes[:, 1:10].sum(axis=1) + classes[:, 1] + classes[:, 7])
    rates = np.stack(
        [
            share(classes[:, 1]) / np.maximum(letters, 1e-9), share(classes[:, 2]), share(classes[:, 3]), classes[:, 4] / per_word, classes[:, 5] / per_word, classes[:, 6] / per_word,
            share(classes[:, 9]), share(classes[:, 7]), classes[:, 8] / per_word, by(same), by(again), repeated_window_words(words, at) / per_word, by(stop), (count < 12) * 1.0, chars / per_word / 40,
        ],
        axis=1,
    ).clip(0, 1)
    bent = np.stack((rates, np.sqrt(rates), np.minimum(1, 20 * rates)), axis=2).reshape(n, -1)
    variety = np.log1p(distinct) / np.maximum(np.log1p(count), 1e-9)
    shape = np.stack((np.log1p(count) / 10, np.where(count > 0, variety, 0), np.minimum(chars / per_word, 30) / 10, count == 0), axis=1)
    return np.concatenate((bent, shape), axis=1)


@thrifty
def _featured(batches):
    for batch in batches:
        for lo, hi, texts in text_chunks(batch.column(1)):
            x = features(texts).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(x[:, j]) for j in range(x.shape[1]))], ["doc", *FEATURES])


@dataclass
class Model:
    """A logistic model on standardised features, and the class prior it was fitted with."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights + self.bias


def fit_with_prior(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-3) -> Model:
    """Minimise prior * R+(pos) + max(0, R-(unl) - prior * R-(pos)) for the logistic loss."""
    both = np.concatenate((pos, unl))
    mean, scale = both.mean(axis=0), np.maximum(both.std(axis=0), 1e-3)
    p, u = ((x - mean) / scale for x in (pos, unl))
    p, u = p.clip(-8, 8), u.clip(-8, 8)
    w, b = np.zeros(p.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        zp, zu = p @ w + b, u @ w + b
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp, gu, gn = (sigmoid(zp) - 1) / len(p), sigmoid(zu) / len(u), sigmoid(zp) / len(p)
        of_neg = np.append(u.T @ gu - prior * (p.T @ gn), gu.sum() - prior * gn.sum())
        of_pos = prior * np.append(p.T @ gp, gp.sum())
        grad = of_pos + of_neg if negative >= 0 else -of_neg
        grad[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(mean, scale, w, b, prior)


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Smallest ratio of unlabelled to positive shares above a cut, over cuts that a fifth of the positives pass."""
    cuts = np.quantile(pos, np.linspace(0.0, 0.8, 81))
    share_p = np.array([(pos >= c).mean() for c in cuts])
    share_u = np.array([(unl >= c).mean() for c in cuts])
    slack = 1 / np.sqrt(max(1, min(len(pos), len(unl))))
    return float(np.clip(((share_u + 0.5 * slack) / share_p).min(), 0.05, 0.98))


def fit(pos: np.ndarray, unl: np.ndarray) -> Model | None:
    """Two rounds: a prior guessed at one half, then the one its scores show. None without positives or unlabelled rows."""
    if not len(pos) or not len(unl):
        return None
    first = fit_with_prior(pos, unl, 0.5)
    return fit_with_prior(pos, unl, estimate_prior(first.logit(pos), first.logit(unl)))


def _sample(rows: DataFrame, most: int) -> np.ndarray:
    """FEATURES of about `most` rows, in an order of their own: sums over them don't depend on tasks."""
    x = hash_sample(rows, ["doc"], most).select(*FEATURES).toPandas().to_numpy(float)
    return x[np.lexsort(x.T)]


def held_out(doc):
    """crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(doc.cast("string").cast("binary")) % 5 == 0


def fold_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", cut: float = 0.3, most_positives: int = 8_000, most_unlabelled: int = 12_000) -> DataFrame:
    """(id, held_out, score, predicted, prior) of every row.

    Positives are rows labelled 1; unlabelled text is any row, whatever its label. Both
    come from rows that are not held out, and the sample of each is taken by a hash of the
    id, of about most_positives and most_unlabelled rows. Labels, source and language
    are never features. Null and empty texts are scored as texts without words. A null id
    is held out from learning. Where there are no positives every score is one half.
    Repeated rows give repeated rows; columns not named are not read.
    """
    read = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    table = materialize(read.mapInArrow(_featured, "doc long, " + ", ".join(f"{f} float" for f in FEATURES)), "features")
    usable = table.where(~held_out(F.col("doc")))
    positive = labels.where(F.col(label_col) == 1).select(F.col(label_id_col).cast("long").alias("doc")).distinct()
    trusted = materialize(usable.join(positive, "doc", "left_semi"), "trusted")
    model = fit(_sample(trusted, most_positives), _sample(usable, most_unlabelled))
    if model is None:
        score, prior = F.lit(0.5), F.lit(None).cast("double")
    else:
        terms = [(F.least(F.greatest((F.col(f) - float(m)) / float(s), F.lit(-8.0)), F.lit(8.0)) * float(w)) for f, m, s, w in zip(FEATURES, model.mean, model.scale, model.weights, strict=True)]
        logit = F.lit(float(model.bias))
        for t in terms:
            logit = logit + t
        score, prior = 1 / (1 + F.exp(-F.least(F.greatest(logit, F.lit(-30.0)), F.lit(30.0)))), F.lit(model.prior)
    out = table.select(F.col("doc").alias(id_col), F.coalesce(held_out(F.col("doc")), F.lit(True)).alias("held_out"), score.alias("score"), prior.alias("prior"))
    return out.select(id_col, "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"), "prior")
