"""Language of texts by averaged hashed subword embeddings and a linear softmax.

A word's subwords are its letter sequences of two to four (with marks for its ends) and the word's
first five letters; each is hashed to a row of an embedding table. A text is the mean of its rows, and a linear
layer over it gives a language by softmax. Both are trained in numpy by stochastic gradient descent
on a bounded sample. Held-back rows of the sample set the temperature of the softmax and the score
below which a prediction is rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelflot.llm.chars import Words
from shelflot.llm.common import extend, fold, least_hashes, ship, slices, table

BUCKET_BITS = 17
WIDTH = 16
#: Distinct texts that train, in the order of a hash: for each language (two at least), and in all.
ROWS_PER_LANGUAGE, ROWS = 500, 4_000
EPOCHS, RATE = 8, 0.4
#: Share of right held-back predictions that the rejection may cost.
REJECTED_SHARE = 0.005
UNKNOWN = "und"
#: Words whose scores a worker remembers; it forgets all of them beyond, which changes no result.
REMEMBERED = 150_000


@dataclass
class Model:
    languages: list[str]
    #: For each bucket the product of its embedding and the linear layer, or the embedding where that is narrower.
    scores: np.ndarray
    #: What turns a mean of these into languages.
    layer: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    held_back: dict = field(default_factory=dict)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of the words, and the word that each comes from."""
    parts = Words(words)
    owner, buckets, owners = parts.word_text[parts.word], [], []
    for last in (1, 2, 3, 4):
        keep = parts.place >= last - 1 if last < 4 else parts.place == last
        key = parts.keys(0, last)[keep]
        buckets.append((key >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
        owners.append(owner[keep])
    return np.concatenate(buckets), np.concatenate(owners)


def bags(rows: DataFrame) -> DataFrame:
    """``lang, hash, buckets, counts`` of each text: how often each bucket occurs in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own, counts = [], []
            for text in batch.column(0).to_pylist():
                words, times = np.unique(np.array((text or "").lower().split() or [""]), return_counts=True)
                found, owner = subwords(words.tolist())
                kinds, inverse = np.unique(found, return_inverse=True)
                own.append(kinds.tolist())
                counts.append(np.bincount(inverse, weights=times[owner], minlength=len(kinds)).astype(np.float32).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(own, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))],
                names=["lang", "hash", "buckets", "counts"],
            )

    ship(rows.sparkSession)
    return rows.select("text", "lang", "hash").mapInArrow(run, "lang string, hash bigint, buckets array<int>, counts array<float>")


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def descend(samples: list[tuple[np.ndarray, np.ndarray, int]], k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, linear layer and bias after stochastic gradient descent over (buckets, shares, class)."""
    random = np.random.default_rng(seed)
    rows = random.normal(0, 1 / WIDTH, (1 << BUCKET_BITS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((k, WIDTH), np.float32), np.zeros(k, np.float32)
    steps, done = EPOCHS * len(samples), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(samples)):
            buckets, shares, label = samples[i]
            mean = shares @ rows[buckets]
            wrong = _softmax(layer @ mean + bias)
            wrong[label] -= 1
            rate = RATE * (1 - done / steps)
            back = wrong @ layer
            layer -= rate * np.outer(wrong, mean)
            bias -= rate * 0.1 * wrong
            rows[buckets] -= rate * back
            done += 1
    return rows, layer, bias


def fit(labelled: DataFrame) -> Model:
    """The model from ``text, lang`` rows; rows with a NULL or empty text or a NULL language are left out.

    It learns from a bounded sample (ROWS_PER_LANGUAGE, ROWS) chosen by a hash of the text, copies of a
    text in a language counting once; the sample alone goes to the driver. With many languages each gets
    fewer texts, two at least, but none is left out. Without any such row there is no language to predict.
    """
    known = labelled.where("lang is not null and trim(text) <> ''").select(
        "text", F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("hash")
    )
    counts = known.groupBy("lang").agg(F.approx_count_distinct("hash", 0.02).alias("texts")).toArrow()
    sizes = dict(sorted(zip(counts["lang"].to_pylist(), counts["texts"].to_pylist(), strict=True)))
    if not sizes:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    languages = list(sizes)
    each = max(2, min(ROWS_PER_LANGUAGE, ROWS // len(languages)))
    found = bags(candidates(known, sizes, each)).toArrow()
    place = {name: i for i, name in enumerate(languages)}
    samples, taken = [], Counter()
    rows = zip(found["hash"].to_pylist(), found["lang"].to_pylist(), found["buckets"], found["counts"], strict=True)
    for _, lang, buckets, counts in sorted(rows, key=lambda r: r[:2]):
        own, share = buckets.values.to_numpy(), counts.values.to_numpy()
        if len(own) and taken[lang] < each:
            taken[lang] += 1
            samples.append((own, share / share.sum(), place[lang]))
    samples.sort(key=lambda s: (s[2], len(s[0]), s[0].tobytes(), s[1].tobytes()))  # however the rows came
    back, train = samples[::5], [s for i, s in enumerate(samples) if i % 5]
    rows, layer, bias = descend(train or samples, len(languages))
    if len(languages) <= WIDTH:
        rows, layer = rows @ layer.T, np.eye(len(languages))
    model = Model(languages, rows.astype(np.float32), layer.astype(float), bias)
    calibrate(model, back)
    return model


def candidates(known: DataFrame, sizes: dict[str, int], each: int) -> DataFrame:
    """``text, lang, hash`` of the texts with the least hashes, ``each`` of a language and some more, once each.

    The threshold of a language follows from its estimated number of texts, so rows are chosen where
    they lie; the margin makes fewer than ``each`` of more unlikely.
    """
    margin = each + 6 * each**0.5 + 12
    bounds = known.sparkSession.createDataFrame([(s, least_hashes(margin, n)) for s, n in sizes.items()], "lang string, most long")
    near = known.join(bounds, "lang").where("hash <= most")
    return near.groupBy("lang", "hash").agg(F.min("text").alias("text"))


def calibrate(model: Model, back: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """Set the temperature that makes held-back rows likeliest, and the rejection threshold."""
    if not back or len(model.languages) < 2:
        return
    logits = np.array([model.layer @ (shares @ model.scores[buckets]) + model.bias for buckets, shares, _ in back])
    labels = np.array([label for *_, label in back])
    choices = np.exp(np.linspace(0, np.log(30), 60))  # never sharper than trained
    losses = [-np.log(_softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in choices]
    model.temperature = float(choices[int(np.argmin(losses))])
    chances = _softmax(logits / model.temperature)
    right = chances.argmax(1) == labels
    if right.any():
        model.threshold = float(np.quantile(chances.max(1)[right], REJECTED_SHARE))
    model.held_back = {"rows": len(labels), "accuracy": float(right.mean())}


class Predictor:
    """Predicts languages of texts, remembering the words it has seen."""

    def __init__(self, model: Model):
        self.model, self.places = model, {}
        self.sums = np.zeros((0, model.scores.shape[1] + 1), np.float32)

    def _learn(self, new: list[str]) -> None:
        found, owner = subwords(new)
        columns = [np.bincount(owner, weights=self.model.scores[found, k], minlength=len(new)) for k in range(self.model.scores.shape[1])]
        columns.append(np.bincount(owner, minlength=len(new)))
        self.places.update(zip(new, range(len(self.sums), len(self.sums) + len(new)), strict=True))
        self.sums = np.concatenate([self.sums, np.column_stack(columns).astype(np.float32)])

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        if len(self.places) > REMEMBERED:
            self.places, self.sums = {}, self.sums[:0]
        split = [(t or "").lower().split() for t in texts]
        wanted = set()
        for words in split:
            wanted.update(words)
        new = [w for w in wanted if w not in self.places]
        for k in range(0, len(new), 50_000):
            self._learn(new[k : k + 50_000])
        names, scores, accepted = [], [], []
        for text, words in zip(texts, split, strict=True):
            if not text or not self.model.languages or not any(c.isalpha() for c in text):
                names.append(UNKNOWN), scores.append(0.0), accepted.append(False)
                continue
            total = self.sums[[self.places[w] for w in words]].astype(float).sum(0)
            logits = self.model.layer @ (total[:-1] / max(total[-1], 1.0)) + self.model.bias
            chances = _softmax(logits / self.model.temperature)
            best = int(chances.argmax())
            names.append(self.model.languages[best]), scores.append(float(chances[best]))
            accepted.append(scores[-1] >= self.model.threshold)
        return names, scores, accepted


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, its ``score`` (0 to 1) and ``accepted``, false where the score is below the threshold.

    A text that is NULL or has no letter gets ``und``, 0 and false. Ties go to the first language by
    name. All columns are kept; columns of these names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        predictor = Predictor(shared.value)
        for batch in batches:
            names, scores, accepted = predictor(batch.column(0).to_pylist())
            yield [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())]

    fields = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("accepted", T.BooleanType()),
    ]
    return extend(df, [text], fields, run)


def op10_language(spark: SparkSession, directory: str) -> DataFrame:
    """Every document's language, learned from the folds that are not held out."""
    held_out = fold("doc_id", 4) == 2
    model = fit(table(spark, directory, "documents", "doc_id", "text", "lang").where(~held_out))
    found = predict(table(spark, directory, "documents", "doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")
