"""Recommending a medicine from a description: TF-IDF terms and multinomial naive Bayes.

Fitting and scoring are joins and aggregates over (document, term) rows. The vocabulary has at
most ``max_features`` rows, and only terms in it are shuffled per document.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelflot.functions.containment import first_containing
from shelflot.functions.ranks import row_numbers, running_total
from shelflot.functions.text import ascii_lower
from shelflot.operators.joins import lookup_join
from shelflot.session import pinned

# The words that carry no meaning of their own, and the model's parameters.
STOP_WORDS = tuple(
    """a about above after again all also am an and any are as at be because been before being
    below between both but by can could did do does doing down during each few for from further
    had has have having he her here hers him his how i if in into is it its itself just me more
    most my no nor not now of off on once only or other our ours out over own same she should so
    some such than that the their theirs them then there these they this those through to too
    under until up very was we were what when where which while who whom why will with would you
    your yours""".split()
)
WORD = r"[\p{L}\p{N}_]{2,}"
MAX_FEATURES = 100
ALPHA = 0.1
TOP = 3


class Tfidf(NamedTuple):
    """Vocabulary (term, df, idf) and document weights (id, term, weight)."""

    vocabulary: DataFrame
    weights: DataFrame


class Model(NamedTuple):
    """Vocabulary (term, idf), class priors (label, log_prior), and (label, term, log_prob)."""

    vocabulary: DataFrame
    priors: DataFrame
    log_probs: DataFrame


def class_distribution(labelled: DataFrame, label: str = "medicine") -> DataFrame:
    """Rows per label, most frequent first."""
    return (
        labelled.groupBy(label)
        .agg(F.count(F.lit(1)).alias("samples"))
        .orderBy(F.desc("samples"), label)
    )


def class_totals(labelled: DataFrame, label: str = "medicine") -> DataFrame:
    """Number of rows and of distinct labels, in one row."""
    per_label = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return per_label.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("samples"),
        F.count(label).alias("labels"),
    )


def _words(text: str) -> Column:
    return F.filter(
        F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0)),
        lambda w: ~w.isin(*STOP_WORDS),
    )


def _following(words: str) -> Column:
    """The words from the second on; empty for fewer than two."""
    return F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(1)))


def tokenise(df: DataFrame, text: str = "symptoms", id: str = "id") -> DataFrame:
    """(id, terms): the words of each text and the pairs of neighbours, stop words left out first."""
    pairs = F.zip_with(
        F.slice("words", F.lit(1), F.greatest(F.size("words") - 1, F.lit(0))),
        _following("words"),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return df.select(F.col(id).alias("id"), _words(text).alias("words")).select(
        "id", F.concat("words", pairs).alias("terms")
    )


def _pair_rows(df: DataFrame, text: str, id: str) -> DataFrame:
    """(id, word, next): every word with its follower, NULL after the last.

    The outer form of explode keeps Spark from testing the list beforehand, which would
    tokenise twice; a text without words gives one row of NULLs.
    """
    beside = F.arrays_zip(F.col("words").alias("word"), _following("words").alias("next"))
    return (
        df.select(F.col(id).alias("id"), _words(text).alias("words"))
        .select("id", F.explode_outer(beside).alias("z"))
        .select("id", "z.word", "z.next")
    )


def _joined() -> Column:
    return F.concat("word", F.lit(" "), "next")


def term_rows(df: DataFrame, text: str = "symptoms", id: str = "id") -> DataFrame:
    """(id, term): the terms of ``tokenise``, a row each, in no order."""
    both = F.explode_outer(F.array("word", _joined()))
    return _pair_rows(df, text, id).select("id", both.alias("term")).filter(F.col("term").isNotNull())


def frequent_terms(texts: DataFrame, n: int, text: str = "text", id: str = "id") -> DataFrame:
    """(term, n): the ``n`` most frequent terms; ties go to the earlier term.

    Words are counted first. A pair is never more frequent than either of its words, so once
    there are ``n`` words, pairs of words rarer than the last of them cannot be among the
    ``n``: only the pairs of frequent words are counted, of which there are few, instead of
    shuffling every pair that occurs.
    """
    pairs = _pair_rows(texts, text, id)
    counted = F.count(F.lit(1)).alias("n")
    words = pinned(pairs.filter(F.col("word").isNotNull()).groupBy(F.col("word").alias("term")).agg(counted))
    best = words.orderBy(F.desc("n"), "term").limit(n).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).first()
    least = best["least"] if best["k"] == n else 0
    frequent = words.filter(F.col("n") >= least)
    followed = pairs.filter(F.col("word").isNotNull() & F.col("next").isNotNull())
    if least > 1:
        for column in ("word", "next"):
            followed = lookup_join(followed, frequent.select(F.col("term").alias(column)), column, "id")
    both = frequent.unionByName(followed.groupBy(_joined().alias("term")).agg(counted))
    return both.orderBy(F.desc("n"), "term").limit(n)


def _frequencies(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, term, tf) for the terms in the vocabulary.

    Terms outside it are filtered before anything is shuffled; a document's rows are made in
    one task, so the count per document and term is complete before the shuffle.
    """
    known = lookup_join(terms, vocabulary.select("term"), "term", "id")
    return known.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def _weights(frequencies: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Unit-length TF-IDF weights; a document has at most a vocabulary of rows in its window."""
    raw = lookup_join(frequencies, vocabulary.select("term", "idf"), "term", "id")
    raw = raw.withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.select("id", "term", (F.col("w") / norm).alias("weight"))


def fit_tfidf(
    texts: DataFrame, max_features: int = MAX_FEATURES, text: str = "text", id: str = "id"
) -> Tfidf:
    """Vocabulary of the most frequent terms with smoothed idf, and the documents' weights.

    The texts are read three times: to count words, to count pairs of frequent words, and to
    keep the terms in the vocabulary. The results are stored, so nothing later reads the texts
    again.
    """
    chosen = pinned(frequent_terms(texts, max_features, text, id).select("term"))
    frequencies = pinned(_frequencies(term_rows(texts, text, id), chosen))
    documents = texts.agg(F.count(F.lit(1)).alias("n")).scalar()
    idf = F.log((documents + 1) / (F.col("df") + 1)) + 1
    vocabulary = pinned(
        frequencies.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", "df", idf.alias("idf"))
    )
    return Tfidf(vocabulary, _weights(frequencies, vocabulary))


def fit_nb(tfidf: Tfidf, labels: DataFrame, alpha: float = ALPHA) -> Model:
    """Naive Bayes over weighted terms; ``labels`` holds (id, label), one row per document.

    Class priors are plain shares. Every label gets a row for every term of the vocabulary.
    """
    labels = labels.filter(F.col("label").isNotNull())
    per_label = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    documents = per_label.agg(F.sum("n").alias("n")).scalar()
    priors = per_label.select("label", F.log(F.col("n") / documents).alias("log_prior"))
    sums = (
        tfidf.weights.join(labels.select("id", "label"), "id")
        .groupBy("label", "term")
        .agg(F.sum("weight").alias("w"))
    )
    # At most max_features terms, so the list fits in a row.
    terms = tfidf.vocabulary.agg(F.collect_list("term").alias("terms")).scalar()
    filled = (
        per_label.select("label", F.explode(terms).alias("term"))
        .join(sums, ["label", "term"], "left")
        .withColumn("w", F.coalesce("w", F.lit(0.0)) + F.lit(float(alpha)))
    )
    log_prob = F.log("w") - F.log(F.sum("w").over(Window.partitionBy("label")))
    return Model(
        tfidf.vocabulary.select("term", "idf"),
        pinned(priors),
        pinned(filled.select("label", "term", log_prob.alias("log_prob"))),
    )


def train(labelled: DataFrame, max_features: int = MAX_FEATURES, alpha: float = ALPHA) -> Model:
    """Fit on (id, text, label) rows."""
    return fit_nb(fit_tfidf(labelled, max_features), labelled.select("id", "label"), alpha)


def class_scores(model: Model, terms: DataFrame) -> DataFrame:
    """(id, label, score) for documents with at least one known term: joint log probability."""
    weights = _weights(_frequencies(terms, model.vocabulary), model.vocabulary)
    sums = (
        lookup_join(weights, model.log_probs, "term", "id")
        .groupBy("id", "label")
        .agg(F.sum(F.col("weight") * F.col("log_prob")).alias("s"))
    )
    scored = lookup_join(sums, model.priors, "label", "id")
    return scored.select("id", "label", (F.col("s") + F.col("log_prior")).alias("score"))


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` likeliest labels per id with their probability; ties go to the later name.

    A window holds one row per class.
    """
    best = Window.partitionBy("id").orderBy(F.desc("score"), F.desc("label"))
    everyone = Window.partitionBy("id")
    top = F.max("score").over(everyone)
    return (
        scores.withColumn("e", F.exp(F.col("score") - top))
        .withColumn("probability", F.col("e") / F.sum("e").over(everyone))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("id", "rank", "label", "probability")
    )


def predict(model: Model, queries: DataFrame, k: int = TOP, text: str = "symptoms", id: str = "id") -> DataFrame:
    """(id, rank, label, probability): the ``k`` likeliest labels of every query.

    A query without any known term gets the class priors.
    """
    known = pinned(_ranked(class_scores(model, term_rows(queries, text, id)), k))
    usual = (
        model.priors.orderBy(F.desc("log_prior"), F.desc("label"))
        .limit(k)
        .withColumn("probability", F.exp("log_prior"))
        .agg(F.collect_list(F.struct("log_prior", "label", "probability")).alias("top"))
        .select(F.sort_array("top", asc=False).alias("top"))
        .scalar()
    )
    blind = (
        queries.select(F.col(id).alias("id"))
        .join(known.select("id").distinct(), "id", "left_anti")
        .select("id", F.posexplode(usual).alias("pos", "t"))
        .select("id", (F.col("pos") + 1).alias("rank"), "t.label", "t.probability")
    )
    return known.unionByName(blind)


def resolve_medicine(names: DataFrame, medicines: DataFrame, name: str = "label") -> DataFrame:
    """Each row with the first medicine (by id) whose name contains ``name``, or with NULLs.

    The name is a LIKE pattern without case.
    """
    record = F.struct("id", F.col("name"), "category", "composition", "uses", "dosage", "side_effects")
    texts = medicines.select(F.col("name").alias("__name"), record.alias("__record"))
    matches = first_containing(names.select(name), texts, name, "__name", "__record")
    return (
        names.withColumn("pattern", ascii_lower(name))
        .join(matches, "pattern", "left")
        .withColumn("medicine", F.col("first"))
        .drop("pattern", "first")
    )


def recommend(
    model: Model, queries: DataFrame, medicines: DataFrame, k: int = TOP, text: str = "symptoms", id: str = "id"
) -> DataFrame:
    """The ``k`` likeliest medicines per query, with their details where the shelf list has them."""
    asked = queries.filter(F.trim(text) != "")
    found = resolve_medicine(predict(model, asked, k, text, id), medicines)
    details = F.struct(*[f"medicine.{c}" for c in ("category", "composition", "uses", "dosage", "side_effects")])
    return found.select(
        "id",
        "rank",
        F.coalesce("medicine.name", "label").alias("name"),
        F.round(F.col("probability") * 100, 2).alias("confidence"),
        F.col("medicine.id").alias("medicine_id"),
        F.when(F.col("medicine.id").isNotNull(), details).alias("details"),
    )


def _draw(id: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id).cast("string"), F.lit(f":{seed}")))


def holdout(
    labelled: DataFrame, fraction: float = 0.2, seed: int = 42, label: str = "label", id: str = "id"
) -> DataFrame:
    """Add ``is_test``: about ``fraction`` of every label, by a hash of the id; a lone row trains.

    A label with n > 1 rows gives round(n * fraction) of them to the test set.
    """
    named = labelled.filter(F.col(label).isNotNull())
    keyed = named.withColumn("__draw", F.coalesce(_draw(id, seed), F.lit("")))
    # Only ids are put in order: what comes back is the last one tested of every label, by which
    # the rows are judged where they lie.
    ids = pinned(keyed.groupBy(label, "__draw", F.col(id).alias("__id")).agg(F.count(F.lit(1)).alias("__c")))
    share = F.floor(F.col("__n") * F.lit(float(fraction)) + 0.5)
    shares = ids.groupBy(label).agg(F.sum("__c").alias("__n")).select(
        label, F.when(F.col("__n") > 1, share).otherwise(F.lit(0)).alias("__share")
    )
    placed = running_total(ids, [label], ["__draw", "__id"], "__c", "__upto")
    last = placed.join(shares, label).filter(
        (F.col("__upto") >= F.col("__share")) & (F.col("__upto") - F.col("__c") < F.col("__share"))
    )
    cuts = pinned(
        shares.join(last.drop("__share"), label, "left").select(
            label,
            F.coalesce(F.col("__draw"), F.lit("")).alias("__last"),
            F.coalesce(F.col("__share") - F.col("__upto") + F.col("__c"), F.lit(0)).alias("__rest"),
            F.coalesce("__c", F.lit(0)).alias("__of"),
        )
    )
    judged = lookup_join(keyed, cuts, label, id)
    before, at = F.col("__draw") < F.col("__last"), F.col("__draw") == F.col("__last")
    split = at & (F.col("__rest") > 0) & (F.col("__rest") < F.col("__of"))
    columns = [*labelled.columns, "is_test"]
    whole = judged.withColumn("is_test", before | (at & (F.col("__rest") > 0)))
    if cuts.filter((F.col("__rest") > 0) & (F.col("__rest") < F.col("__of"))).isEmpty():
        return whole.select(*columns)
    # Rows of one id on both sides of the cut: so many of them as are still wanted.
    tied = row_numbers(judged.filter(split), [label], [F.xxhash64(*labelled.columns)], "__rank")
    return whole.filter(~split).select(*columns).unionByName(
        tied.withColumn("is_test", F.col("__rank") <= F.col("__rest")).select(*columns)
    )


def accuracy(model: Model, labelled: DataFrame, text: str = "text", id: str = "id") -> DataFrame:
    """Rows, hits and share of (id, text, label) rows whose likeliest label is right, in one row."""
    guessed = predict(model, labelled, 1, text, id).select("id", F.col("label").alias("guess"))
    judged = labelled.select(F.col(id).alias("id"), "label").join(guessed, "id")
    return judged.agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(F.col("label") == F.col("guess")).alias("hits"),
    ).withColumn("accuracy", F.col("hits") / F.when(F.col("samples") > 0, F.col("samples")))


def top_terms(model: Model, n: int = 5) -> DataFrame:
    """The ``n`` likeliest terms of every label; ties go to the later term."""
    best = Window.partitionBy("label").orderBy(F.desc("log_prob"), F.desc("term"))
    return (
        model.log_probs.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= n)
        .select("label", "rank", "term", "log_prob")
    )


def save_model(model: Model, path: str) -> None:
    """Write the model's three tables as Parquet below ``path``."""
    for name, df in model._asdict().items():
        df.write.parquet(f"{path.rstrip('/')}/{name}")


def load_model(spark: SparkSession, path: str) -> Model:
    """Read a saved model."""
    return Model(*[spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in Model._fields])
