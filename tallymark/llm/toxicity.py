"""Toxicity scores: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams and of the word itself, all kept in
one hashed table; a text's vector is the average of its words' vectors (see POWER); a softmax over two classes reads it.
Table, softmax and bias are trained together, so an unseen misspelling gets the vector that its n-grams
share with the words seen. For scoring, table and softmax are multiplied out to one number for each slot.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of the hashed table and length of its vectors.
SLOTS, DIM = 1 << 20, 4
#: Lengths of the character n-grams.
NGRAMS = (3, 4, 5)
#: Labelled rows of each class that training takes at most, and characters of the longest text it takes.
PER_CLASS, TRAIN_CHARS = 1500, 20_000
#: Training texts that a slot has to occur in, and standard errors by which its shares of the two labels' texts have to differ;
#: other slots keep a zero vector, so that single labelled texts are not learnt by heart. Chosen by three-fold cross-validation.
LEAST_TEXTS, CONTRAST = 4, 4.0
#: Passes over the sample, rate of training, pull of the table to zero, and factor of the short averaged vectors.
EPOCHS, RATE, PULL, SCALE = 8, 0.2, 1e-3, 2.0
#: The sum of the vectors of a text's distinct words is divided by their count to this power: averaged, the few telling words of
#: a long text would drown; at the square root, what the many others add keeps the same spread at every length.
POWER = 0.5
#: How far an uneven sample is undone: at 0 both kinds of error count alike, at 1 each text does.
PRIOR = 0.5
#: Words longer than this are cut into pieces of this length.
WORD = 64
#: Words whose scores a process keeps.
CACHE = 300_000
#: The softmax's bias where there are not labels of both kinds.
UNTAUGHT = np.array([4.0, -4.0])
#: A text is rejected from this score on.
THRESHOLD = 0.5
_WORDS = re.compile(rf"\w{{1,{WORD}}}")


def words_of(text: str | None) -> list[str]:
    """The distinct words of a text, in order: lines that repeat within a text add nothing."""
    return list(dict.fromkeys(_WORDS.findall((text or "").lower())))


def slots_of(word: str, slots: int = SLOTS) -> list[int]:
    """The slots of a word and of its n-grams."""
    w = f"<{word}>"
    grams = [w, *(w[i : i + n] for n in NGRAMS if n < len(w) for i in range(len(w) - n + 1))]
    return [zlib.crc32(g.encode()) % slots for g in grams]


class Model:
    """The trained table, softmax and bias."""

    def __init__(self, table: np.ndarray, softmax: np.ndarray, bias: np.ndarray):
        self.table, self.softmax, self.bias = table, softmax, bias

    def collapsed(self) -> Scorer:
        return Scorer((self.table @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0]))


class Scorer:
    """Log-odds of a text: the mean over its words of the mean over their slots, and the bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias, "known": {}}

    def word(self, word: str) -> float:
        return float(self.weights[slots_of(word, len(self.weights))].mean())

    def score(self, text: str | None) -> float:
        words = words_of(text)
        known = self.known
        if new := [w for w in words if w not in known]:
            if len(known) > CACHE:
                known.clear()
                new = words
            for w in new:
                known[w] = self.word(w)
        x = self.bias + (sum(map(known.__getitem__, words)) / len(words) ** POWER if words else 0.0)
        return float(1 / (1 + np.exp(-x)))


def telling(texts_of: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Which slots are frequent and differ between the labels, from texts of each label with the slot, and all of each label."""
    n = texts_of.sum(0)
    if not texts.all():
        return np.zeros(len(n), bool)
    gap = np.abs(texts_of[0] / texts[0] - texts_of[1] / texts[1])
    share = n / texts.sum()
    return (n >= LEAST_TEXTS) & (gap >= CONTRAST * np.sqrt(share * (1 - share) * (1 / texts).sum())) & (gap > 0)


def train(texts: list[str], labels: list[int], class_weights: tuple[float, float] = (1.0, 1.0), slots: int = SLOTS, dim: int = DIM, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fits table, softmax and bias jointly, text by text, with per-slot rates. Deterministic.

    Only slots that tell the labels apart (see CONTRAST) get vectors; where none does, as with fewer than about
    eight texts of each label, every text gets the score of UNTAUGHT. ``class_weights`` shift the bias at the end
    by PRIOR of what they say, so that classes may be sampled unevenly.
    """
    rng = np.random.default_rng(seed)
    known: dict[str, np.ndarray] = {}
    texts_of = np.zeros((2, slots), np.int32)
    inputs = []
    for text, label in zip(texts, labels, strict=True):
        words = words_of(text)
        ids, shares = [], []
        for w in words:
            s = known.get(w)
            if s is None:
                s = known[w] = np.array(slots_of(w, slots), np.int32)
            ids.append(s)
            shares.append(np.full(len(s), 1 / len(words) ** POWER / len(s), np.float32))
        at, where = np.unique(np.concatenate(ids), return_inverse=True) if ids else (np.zeros(0, np.int32), np.zeros(0, int))
        texts_of[label, at] += 1
        inputs.append((at, np.bincount(where, np.concatenate(shares), len(at)).astype(np.float32) if ids else np.zeros(0, np.float32)))
    known.clear()
    used = telling(texts_of, np.bincount(np.array(labels, int), minlength=2))
    inputs = [(at[keep], SCALE * x[keep]) for at, x in inputs for keep in [used[at]]]
    table = np.zeros((slots, dim), np.float32)
    table[used] = rng.uniform(-0.1, 0.1, (int(used.sum()), dim))
    softmax, bias = rng.normal(0, 1, (dim, 2)).astype(np.float32), np.zeros(2)
    if used.any():
        seen, seen_softmax, seen_bias = np.full(slots, 1e-6, np.float32), np.full((dim, 2), 1e-2, np.float32), np.full(2, 1e-2)
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs)
            for d in rng.permutation(len(inputs)):
                at, x = inputs[d]
                vectors = table[at]
                hidden = x @ vectors
                z = hidden @ softmax + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[d]] -= 1
                back, outer = (softmax @ p).astype(np.float32), np.outer(hidden, p)
                seen[at] += x * x * float(back @ back)
                table[at] = vectors * (1 - rate * PULL) - (rate * x / np.sqrt(seen[at]))[:, None] * back
                seen_softmax += outer * outer
                softmax -= (rate * outer / np.sqrt(seen_softmax)).astype(np.float32)
                seen_bias += p * p
                bias -= rate * p / np.sqrt(seen_bias)
        bias = bias + PRIOR * np.log(np.maximum(class_weights, 1e-6))
    else:
        table, bias = np.zeros_like(table), UNTAUGHT
    return Model(table, softmax * SCALE, bias)


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is kept from training: crc32 of the id as text, modulo 5, is 0. A null id has no label: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, train_chars: int = TRAIN_CHARS) -> Model:
    """Trains on a bounded sample of the labelled rows that are not held out.

    The sample has at most about ``per_class`` rows of each label, those whose ids hash lowest, and leaves
    out texts of more than ``train_chars`` characters; rows weigh so that the classes keep the shares they
    have among all labelled rows. A null label or id takes no part; an id with several labels counts as 1
    if any is 1, one with several texts gives the first in order. Without labels of both kinds nothing can be
    learnt: every text scores the same, far under the threshold, and none is rejected.
    """
    label = F.col(label_col).cast("int")
    known = (
        labels.select(F.col(id_col).alias("i"), label.alias("y")).filter("i is not null and y in (0, 1)").groupBy("i").agg(F.max("y").alias("y"))
        .filter(~held_out(F.col("i"))).withColumn("h", F.pmod(F.xxhash64("i"), F.lit(1 << 30)))
    )
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    cut = {y: min(1 << 30, (per_class << 30) // max(1, n)) for y, n in counts.items()}
    chosen = known.filter(F.expr(" or ".join([f"(y = {y} and h < {c})" for y, c in cut.items()] or ["false"])))
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter(F.length("t") <= train_chars)
    # one text for each of about 2 * per_class ids
    rows = texts.join(F.broadcast(chosen.select("i", "y")), "i").groupBy("i").agg(F.min("t").alias("t"), F.max("y").alias("y")).select("t", "y").collect()
    rows.sort(key=lambda r: (r["y"], zlib.crc32(r["t"].encode()), r["t"]))
    got = Counter(r["y"] for r in rows)
    weights = tuple(counts.get(c, 0) / max(1, got[c]) for c in (0, 1))
    return train([r["t"] for r in rows], [r["y"] for r in rows], weights)


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The score of a text column by ``model``: 0 to 1, from whole texts; null and empty texts get that of no words."""
    shared = docs.sparkSession.sparkContext.broadcast(model.collapsed())

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        one = shared.value.score
        return pd.Series([one(t) for t in texts], dtype="float64")

    return score(F.col(text_col))
