"""Toxicity by class-conditional Kneser-Ney models of the letters of words.

One model for toxic and one for ordinary words gives the chance of each letter after the five
before it, inside its word. Both back off to the same shared counts: the pooled model of that
order, which backs off to continuation counts of pairs and of single letters. Where neither class has
seen a letter after its context the shared part cancels and it is no evidence, so rare expressions
compare as equal, however much less is known of one class.

Training counts cover every labelled row that is not held out; they are combined in each task
before the shuffle. The whole comparison is kept as a table by the full 64-bit key of a letter after
its context, which grows with the data; a key that is not in it is no evidence. Up to a bound it is sent to
the workers; a larger one is joined with the letters of the texts' distinct words, with the same results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelflot.llm.chars import Words, per_text
from shelflot.llm.common import extend, fold, least_hashes, ship, slices, table
from shelflot.session import pinned, run_dir

CONTEXT = 5
DISCOUNT = 0.75
#: Letters after a context that are sent to every worker at most (12 bytes each); more are joined by a shuffle.
BROADCAST_LETTERS = 8_000_000
#: Log-ratios are kept in whole units of one over this, so that their sums do not depend on any order.
UNITS = 1 << 20
#: Words of more than one part in so many of all (text, word) pairs are joined by a broadcast; as many at most.
HOT_WORDS = 10_000
#: Words in a window whose mean comparison is a feature beside the text's.
WINDOW = 8
#: Distinct labelled texts, those of the least hashes, that calibrate the score (about as many, however many rows).
CALIBRATION_TEXTS = 50_000
#: Words whose comparison a worker remembers; it forgets all of them beyond, which changes no result.
REMEMBERED = 200_000
#: Labels that are sent to every worker at most; more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
#: Distinct words after which a task passes on what it has counted.
COUNTED = 300_000

_COUNTS = "letter bigint, context bigint, triple bigint, pair bigint, code bigint, toxic bigint, ordinary bigint"


@dataclass
class Model:
    """``letters`` holds ``letter, ratio`` (in units) of every key: sorted arrays, or a table beyond the bound."""

    letters: tuple[np.ndarray, np.ndarray] | DataFrame
    weights: np.ndarray
    center: np.ndarray
    scale: np.ndarray


def _counted(counts: Counter) -> pa.RecordBatch:
    """The letters of counted words ((word, class) -> times), summed by their contexts."""
    words = list(dict.fromkeys(w for w, _ in counts))
    parts = Words(words)
    owner = parts.word_text[parts.word]
    keys = [parts.keys(0, CONTEXT), parts.keys(1, CONTEXT), parts.keys(0, 2), parts.keys(1, 2)]
    own, first, inverse = np.unique(keys[0], return_index=True, return_inverse=True)
    sums = []
    for label in (1, 0):
        times = np.array([counts.get((w, label), 0) for w in words], float)
        sums.append(np.bincount(inverse, weights=times[owner] if len(owner) else None, minlength=len(own)).astype(np.int64))
    columns = [own.view(np.int64), *(k[first].view(np.int64) for k in keys[1:]), parts.codes[parts.at][first].astype(np.int64), *sums]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in _COUNTS.split(", ")])


def letter_counts(labelled: DataFrame) -> DataFrame:
    """Counts of letters after their contexts, by class, over all rows of ``text, toxic``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in Counter((text or "").lower().split()).items():
                    counts[word, toxic] += n
            if len(counts) > COUNTED:
                yield _counted(counts)
                counts.clear()
        if counts:
            yield _counted(counts)

    ship(labelled.sparkSession)
    rows = labelled.select("text", F.col("toxic").cast("int")).mapInArrow(run, _COUNTS)
    return rows.groupBy("letter", "context", "triple", "pair", "code").agg(*[F.sum(c).alias(c) for c in ("toxic", "ordinary")])


def comparison(counts: DataFrame) -> DataFrame:
    """``letter, weight, ratio``: the log-ratio of the two models for each letter after its context.

    Windows are over one context and hold at most the letters of the alphabets.
    """
    d, seen = DISCOUNT, lambda c: F.when(F.col(c) > 0, 1).otherwise(0)
    triples = counts.groupBy("triple", "pair", "code").agg(F.count("*").alias("n3"))
    singles = triples.groupBy("code").agg(F.count("*").alias("n1"))
    total = singles.agg(F.sum("n1").alias("total"), F.count("*").alias("kinds"))
    by_pair = Window.partitionBy("pair")
    p1 = (F.greatest(F.col("n1") - d, F.lit(0.0)) + d) / F.col("total")
    lower = (
        triples.join(singles, "code").crossJoin(F.broadcast(total))  # one row
        .withColumns({"t3": F.sum("n3").over(by_pair), "k3": F.count("*").over(by_pair), "p1": p1})
        .select("triple", "pair", "code", ((F.greatest(F.col("n3") - d, F.lit(0.0)) + d * F.col("k3") * F.col("p1")) / F.col("t3")).alias("p3"))
    )
    by = Window.partitionBy("context")
    known = (
        counts.join(lower, ["triple", "pair", "code"])
        .withColumn("n", F.col("toxic") + F.col("ordinary"))
        .withColumns(
            {
                "nt": F.sum("toxic").over(by), "kt": F.sum(seen("toxic")).over(by),
                "no": F.sum("ordinary").over(by), "ko": F.sum(seen("ordinary")).over(by),
                "na": F.sum("n").over(by), "ka": F.count("*").over(by),
            }
        )
        .withColumn("shared", (F.greatest(F.col("n") - d, F.lit(0.0)) + d * F.col("ka") * F.col("p3")) / F.col("na"))
    )

    def chance(count: str, total: str, kinds: str):
        own = (F.greatest(F.col(count) - d, F.lit(0.0)) + d * F.col(kinds) * F.col("shared")) / F.col(total)
        return F.when(F.col(total) > 0, own).otherwise(F.col("shared"))

    ratio = F.log(chance("toxic", "nt", "kt") / chance("ordinary", "no", "ko"))
    return known.select("letter", F.col("n").alias("weight"), ratio.alias("ratio"))


def _letters(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray] | DataFrame:
    """All keys with their ratios, as sorted arrays if there are ``most`` at most, else as a table."""
    path = run_dir(rows.sparkSession, "letters")
    rows.select("letter", F.round(F.col("ratio") * UNITS).cast("int").alias("ratio")).write.parquet(path)
    kept = rows.sparkSession.read.schema("letter bigint, ratio int").parquet(path)
    if kept.count() > most:
        return kept
    found = kept.toArrow()
    keys = found["letter"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found["ratio"].to_numpy()[order]


def _summary(ratios: np.ndarray) -> tuple[float, float, float]:
    """The features of a text from the ratios of its words in order."""
    if not len(ratios):
        return 0.0, 0.0, 0.0
    sums = np.cumsum(np.concatenate([[0.0], ratios]))
    size = min(WINDOW, len(ratios))
    second = np.partition(ratios, -2)[-2] if len(ratios) > 1 else 0.0
    return sums[-1] / len(ratios), (sums[size:] - sums[:-size]).max() / size, second


class Comparer:
    """Compares words by the model, remembering those it has seen."""

    def __init__(self, letters: tuple[np.ndarray, np.ndarray]):
        (self.letters, self.ratios), self.known = letters, {}

    def learn(self, new: list[str]) -> None:
        parts = Words(new)
        keys = parts.keys(0, CONTEXT)
        ratios = np.zeros(len(keys))
        if len(self.letters):
            own, inverse = np.unique(keys, return_inverse=True)
            places = np.minimum(np.searchsorted(self.letters, own), len(self.letters) - 1)
            ratios = np.where(self.letters[places] == own, self.ratios[places], 0).astype(float)[inverse]
        sums = per_text(ratios, parts.word_text[parts.word], len(new)) / UNITS
        self.known.update(zip(new, sums.tolist(), strict=True))

    def features(self, texts: list[str | None]) -> np.ndarray:
        """For each text: the mean log-ratio of its words, the highest mean of a window of words,
        and the second highest of a word; zeros without words."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        split = [(t or "").lower().split() for t in texts]
        wanted = set()
        for words in split:
            wanted.update(words)
        new = [w for w in wanted if w not in self.known]
        for k in range(0, len(new), 50_000):
            self.learn(new[k : k + 50_000])
        out = np.zeros((len(texts), 3))
        for i, words in enumerate(split):
            out[i] = _summary(np.array([self.known[w] for w in words]))
        return out


def _joined_features(df: DataFrame, letters: DataFrame, text: str) -> DataFrame:
    """The features by joins: letters of distinct words with the table, and words with the texts they are in.

    No word that is joined by a shuffle is in more than one of ``HOT_WORDS`` parts of the pairs.
    """
    ship(df.sparkSession)
    rows = pinned(df.withColumn("__row", F.monotonically_increasing_id()))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for value, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                places: dict[str, list[int]] = {}
                for i, word in enumerate((value or "").lower().split()):
                    places.setdefault(word, []).append(i)
                columns = [pa.array([row] * len(places), pa.int64()), pa.array(list(places), pa.string()), pa.array(list(places.values()), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["__row", "word", "places"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = batch.column(0).to_pylist()
            parts = Words(words)
            owner = parts.word_text[parts.word]
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(parts.keys(0, CONTEXT).view(np.int64), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "letter"])

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((batch.num_rows, 3))
            for i, words in enumerate(batch.column(1)):
                places, units = words.values.field("places"), words.values.field("units").to_numpy()
                at, sizes = places.flatten().to_numpy(), places.value_lengths().to_numpy()
                ratios = np.zeros(len(at))
                ratios[at] = np.repeat(units / UNITS, sizes)
                found[i] = _summary(ratios)
            columns = [batch.column(0), *(pa.array(found[:, k], pa.float64()) for k in range(3))]
            yield pa.RecordBatch.from_arrays(columns, names=["__row", "__f0", "__f1", "__f2"])

    pairs = rows.select(F.col(f"`{text}`"), "__row").mapInArrow(split, "__row bigint, word string, places array<int>")
    words = pinned(pairs.groupBy("word").agg(F.count("*").alias("n")))
    total = words.agg(F.sum("n")).first()[0] or 0
    spelled = words.select("word").mapInArrow(spell, "word string, letter bigint")
    sums = spelled.join(letters, "letter").groupBy("word").agg(F.sum("ratio").alias("units"))
    known = pinned(words.join(sums, "word", "left").select("word", (F.col("n") * HOT_WORDS > total).alias("hot"), F.coalesce("units", F.lit(0)).alias("units")))
    hot = F.broadcast(known.where("hot").select("word", "units"))  # HOT_WORDS at most
    rare = pairs.join(hot, "word", "left_anti").join(known.where("not hot"), "word")
    both = pairs.join(hot, "word").select("__row", "places", "units").union(rare.select("__row", "places", "units"))
    lists = both.groupBy("__row").agg(F.collect_list(F.struct("places", "units")).alias("words"))
    found = lists.mapInArrow(summarize, "__row bigint, __f0 double, __f1 double, __f2 double")
    none = {f"__f{k}": F.coalesce(f"__f{k}", F.lit(0.0)) for k in range(3)}
    return rows.join(found, "__row", "left").withColumns(none).drop("__row")


def _features(df: DataFrame, letters: tuple[np.ndarray, np.ndarray] | DataFrame, text: str = "text") -> DataFrame:
    if isinstance(letters, DataFrame):
        return _joined_features(df, letters, text)
    letters = df.sparkSession.sparkContext.broadcast(letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        comparer = Comparer(letters.value)
        for batch in batches:
            found = comparer.features(batch.column(0).to_pylist())
            yield [pa.array(found[:, k], pa.float64()) for k in range(3)]

    return extend(df, [text], [T.StructField(f"__f{k}", T.DoubleType()) for k in range(3)], run)


def logistic(features: np.ndarray, labels: np.ndarray, times: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (constant first), centre and scale of a logistic regression by Newton steps.

    A row counts as often as ``times`` says. With labels of one class only, a constant near its share.
    """
    n, positive = float(times.sum()), float(labels @ times)
    k = features.shape[1]
    if positive in (0.0, n):
        share = (positive + 1e-3) / (n + 1.0)
        return np.array([np.log(share / (1 - share))] + [0.0] * k), np.zeros(k), np.ones(k)
    center = times @ features / n
    scale = np.sqrt(times @ (features - center) ** 2 / n) + 1e-9
    x = np.column_stack([np.ones(len(labels)), (features - center) / scale])
    w, penalty = np.zeros(k + 1), np.diag([1e-6] + [ridge] * k)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (times * (labels - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w, center, scale


def fit(labelled: DataFrame, calibration: DataFrame, broadcast_letters: int = BROADCAST_LETTERS) -> Model:
    """The model from ``text, toxic`` rows, its score calibrated on other such rows.

    Rows with a NULL label are left out. Without rows of a class the score is a constant.
    """
    spark = labelled.sparkSession
    path = run_dir(spark, "letter-counts")
    letter_counts(labelled.where("toxic is not null")).write.parquet(path)  # read several times below
    letters = _letters(comparison(spark.read.schema(_COUNTS).parquet(path)), broadcast_letters)
    found = _features(calibration_sample(calibration), letters)
    found = found.groupBy("__text", "toxic", "__f0", "__f1", "__f2").agg(F.count("*").alias("times")).drop("__text").toArrow()
    found = found.sort_by([(c, "ascending") for c in found.column_names])  # sums do not depend on the order of rows
    features = np.column_stack([found[f"__f{k}"].to_numpy() for k in range(3)])
    toxic, times = (found[c].to_numpy().astype(float) for c in ("toxic", "times"))
    return Model(letters, *logistic(features, toxic, times))


def calibration_sample(rows: DataFrame, texts: int = CALIBRATION_TEXTS) -> DataFrame:
    """``text, toxic, __text`` (its hash) of the rows with a label whose text is among about ``texts`` by least hash.

    The threshold follows from the estimated number of distinct texts, so rows stay in their tasks.
    All copies of a text are in or out, and share its hash.
    """
    known = rows.where("toxic is not null").select("text", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("text").alias("__text"))
    distinct = known.agg(F.approx_count_distinct("__text", 0.02)).first()[0]
    return known.where(F.col("__text") <= least_hashes(texts, distinct))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``: how likely a text is toxic, 0 to 1. NULL and empty texts score as no evidence.

    Repeated rows score alike; all columns are kept and one named as ``out`` is replaced.
    """
    with_features = _features(df, model.letters, text)
    logit = F.lit(float(model.weights[0]))
    for k in range(3):
        logit = logit + F.lit(float(model.weights[k + 1])) * (F.col(f"__f{k}") - float(model.center[k])) / float(model.scale[k])
    return with_features.withColumn(out, 1 / (1 + F.exp(-logit))).drop("__f0", "__f1", "__f2")


def train(documents: DataFrame, labels: DataFrame, broadcast_letters: int = BROADCAST_LETTERS) -> Model:
    """Fit on the labelled documents: folds 2 to 4 of five count, fold 1 calibrates, fold 0 is held out."""
    known = labels.where("toxic is not null and doc_id is not null").select("doc_id", "toxic").distinct()
    if known.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    rows = documents.select("doc_id", "text").join(known, "doc_id")
    part = fold("doc_id", 5)
    return fit(rows.where(part >= 2).select("text", "toxic"), rows.where(part == 1).select("text", "toxic"), broadcast_letters)


def op5_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    """Every document's score and prediction."""
    documents = table(spark, directory, "documents", "doc_id", "text")
    scored = score(documents, train(documents, table(spark, directory, "labels", "doc_id", "toxic")))
    return scored.select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
