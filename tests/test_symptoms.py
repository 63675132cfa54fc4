"""The classifier against a plain Python rendering of its formulas."""

import math
import re
from collections import Counter, defaultdict

import pytest

from shelflot.operators import symptoms as M

TEXTS = [
    (1, "headache and fever", "A"),
    (2, "fever with chills, high fever", "A"),
    (3, "cough; sore throat", "B"),
    (4, "dry cough at night", "B"),
    (5, "itching rash", "C"),
    (6, "", "C"),
    (7, "rash on skin_fold Été", "C"),
]


def terms_of(text):
    words = [w for w in re.findall(r"\w{2,}", text.lower()) if w not in M.STOP_WORDS]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain_model(rows, limit):
    tokens = {i: terms_of(t) for i, t, _ in rows}
    counts = Counter(t for ts in tokens.values() for t in ts)
    vocabulary = sorted(sorted(counts), key=lambda t: (-counts[t], t))[:limit]
    df = {t: sum(t in ts for ts in tokens.values()) for t in vocabulary}
    idf = {t: math.log((1 + len(rows)) / (1 + df[t])) + 1 for t in vocabulary}
    labels = sorted({l for _, _, l in rows})
    sums = defaultdict(float)
    for i, _, label in rows:
        for t, w in weigh(tokens[i], idf).items():
            sums[label, t] += w
    log_prob = {}
    for l in labels:
        whole = sum(sums[l, t] + 0.1 for t in vocabulary)
        for t in vocabulary:
            log_prob[l, t] = math.log((sums[l, t] + 0.1) / whole)
    prior = {l: math.log(sum(x == l for _, _, x in rows) / len(rows)) for l in labels}
    return idf, prior, log_prob


def weigh(tokens, idf):
    raw = {t: n * idf[t] for t, n in Counter(tokens).items() if t in idf}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    return {t: v / norm for t, v in raw.items()}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "id bigint, text string, label string").cache()


@pytest.fixture(scope="module")
def model(texts):
    return M.train(texts, max_features=12)


def test_tokens(spark, texts):
    got = {r.id: r.terms for r in M.tokenise(texts, "text").collect()}
    assert got == {i: terms_of(t) for i, t, _ in TEXTS}
    rows = sorted((r.id, r.term) for r in M.term_rows(texts, "text").collect())
    assert rows == sorted((i, t) for i, text, _ in TEXTS for t in terms_of(text))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 100])
def test_frequent_terms(spark, n):
    words = ["aa", "bb", "cc", "dd"]
    rows = [(i, " ".join(words[(i * j) % 4 if j % 3 else 0] for j in range(i % 9))) for i in range(60)]
    counts = Counter(t for _, text in rows for t in terms_of(text))
    wanted = sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:n]
    got = M.frequent_terms(spark.createDataFrame(rows, "id bigint, text string"), n)
    assert sorted((r.term, r.n) for r in got.collect()) == sorted(wanted)


def test_model(model):
    idf, prior, log_prob = plain_model(TEXTS, 12)
    assert {r.term: r.idf for r in model.vocabulary.collect()} == pytest.approx(idf)
    assert {r.label: r.log_prior for r in model.priors.collect()} == pytest.approx(prior)
    assert {(r.label, r.term): r.log_prob for r in model.log_probs.collect()} == pytest.approx(log_prob)


def test_predictions(spark, model):
    idf, prior, log_prob = plain_model(TEXTS, 12)
    asked = [(1, "fever and cough"), (2, "unheard of"), (3, "RASH")]
    got = defaultdict(dict)
    order = defaultdict(list)
    for r in sorted(M.predict(model, spark.createDataFrame(asked, "id bigint, symptoms string")).collect(), key=lambda r: r.rank):
        got[r.id][r.label] = r.probability
        order[r.id].append(r.label)
    for id, text in asked:
        score = {l: prior[l] + sum(w * log_prob[l, t] for t, w in weigh(terms_of(text), idf).items()) for l in prior}
        whole = sum(math.exp(s) for s in score.values())
        assert got[id] == pytest.approx({l: math.exp(s) / whole for l, s in score.items()})
    assert order[2] == ["C", "B", "A"]  # the priors; ties go to the later name
    assert order[3][0] == "C"


def test_recommend(spark, model, medicines):
    named = medicines.selectExpr("id", "case id when 2 then 'xAx' else name end as name", "category", "composition", "uses", "dosage", "side_effects")
    asked = spark.createDataFrame([(1, "fever"), (2, "  ")], "id bigint, symptoms string")
    got = {r.rank: r for r in M.recommend(model, asked, named).collect()}
    assert set(got) == {1, 2, 3} and got[1].name == "Paracetamol" and got[1].details.category == "Analgesic"
    assert abs(sum(r.confidence for r in got.values()) - 100) < 0.03


def test_holdout(spark):
    rows = [(i, "t", "big") for i in range(50)] + [(100, "t", "lone")] + [(200 + i, "t", "pair") for i in range(2)]
    df = M.holdout(spark.createDataFrame(rows, "id bigint, text string, label string"))
    tested = Counter(r.label for r in df.collect() if r.is_test)
    assert df.count() == 53 and tested == {"big": 10}


def test_holdout_orders_ids_alone(spark):
    """The rows, with their texts, are judged where they lie; a label's rows don't meet in one task."""
    rows = [(i, f"text {i} " * 50, "big") for i in range(400)] + [(500 + i, "t", "small") for i in range(20)]
    df = M.holdout(spark.createDataFrame(rows, "id bigint, text string, label string").repartition(8))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    assert Counter(r.label for r in df.collect() if r.is_test) == {"big": 80, "small": 4}


def test_holdout_of_repeated_ids(spark):
    """An id's rows may lie on both sides of the cut; rows without an id come first."""
    rows = [(i % 3, f"t{i}", "a") for i in range(30)] + [(None, "x", "b"), (1, "y", "b"), (2, "z", "b"), (3, "w", None)]
    got = M.holdout(spark.createDataFrame(rows, "id bigint, text string, label string"), fraction=0.5).collect()
    assert Counter(r.label for r in got) == {"a": 30, "b": 3}
    assert Counter(r.label for r in got if r.is_test) == {"a": 15, "b": 2}
    tested = Counter(r.id for r in got if r.is_test and r.label == "a")
    assert sorted(tested.values()) == [5, 10] and any(r.is_test and r.id is None for r in got)


def test_accuracy_and_top_terms(texts, model):
    got = M.accuracy(model, texts).first()
    assert got.samples == 7 and got.hits == 7
    top = [r.term for r in sorted(M.top_terms(model, 2).filter("label = 'A'").collect(), key=lambda r: r.rank)]
    assert top[0] == "fever"


def test_save_and_load(spark, model, tmp_path):
    M.save_model(model, str(tmp_path / "m"))
    back = M.load_model(spark, str(tmp_path / "m"))
    assert sorted(back.log_probs.collect()) == sorted(model.log_probs.collect())


def test_class_counts(texts):
    assert [(r.label, r.samples) for r in M.class_distribution(texts, "label").collect()] == [("C", 3), ("A", 2), ("B", 2)]
    assert M.class_totals(texts, "label").first() == (7, 3)
