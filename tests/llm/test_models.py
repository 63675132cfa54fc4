import zlib

import numpy as np
import pytest

from shelflot.llm import language, toxicity
from shelflot.llm.chars import Words
from shelflot.llm.common import table

DIRECTORY = "/root/testdata/sf0.01"
VERY_LONG = "plain words, " * 20_000


def test_toxicity_finds_planted_words(spark, documents):
    clean = [(i, f"the cat number{i % 7} sat on mat{i % 11} and slept well today") for i in range(400)]
    toxic = [(1000 + i, f"the cat number{i % 7} you {('moron', 'idiot', 'moronic')[i % 3]} sat on mat{i % 11} scum") for i in range(120)]
    labels = spark.createDataFrame([(i, 0) for i, _ in clean] + [(i, 1) for i, _ in toxic] + [(None, 1), (5, None)], "doc_id long, toxic int")
    extra = [(5000, None), (5001, ""), (5002, VERY_LONG), (None, "null id"), (5002, VERY_LONG)]
    docs = documents(clean + toxic + extra)
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).select("doc_id", "text", "score", "source").collect()
    assert len(got) == len(clean) + len(toxic) + len(extra)
    assert all(0 <= r.score <= 1 for r in got)
    out = {r.doc_id: r.score >= 0.5 for r in got}
    held = lambda rows: [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i] for i in held(toxic)) and not any(out[i] for i in held(clean))
    assert not out[5000] and not out[5001]
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_without_labels(spark, documents):
    docs, labels = documents([(1, "a b"), (2, None)]), spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert [r.score < 0.5 for r in got] == [True, True]


def test_counts_and_ratios(spark):
    rows = spark.createDataFrame([("abc abd xyz", 1), ("abc abe abe q", 0), ("xyw", 0)], "text string, toxic int")
    counts = toxicity.letter_counts(rows)
    assert counts.agg({"toxic": "sum", "ordinary": "sum"}).first().asDict() == {"sum(toxic)": 4 * 3, "sum(ordinary)": 4 * 4 + 2}
    by_letter = {r.letter: r for r in counts.collect()}
    for r in toxicity.comparison(counts).collect():
        if not by_letter[r.letter].ordinary:
            assert r.ratio > 0  # seen in toxic words alone
    swapped = rows.selectExpr("text", "1 - toxic as toxic")
    ratios = {r.letter: r.ratio for r in toxicity.comparison(counts).collect()}
    for r in toxicity.comparison(toxicity.letter_counts(swapped)).collect():
        assert abs(r.ratio + ratios[r.letter]) < 1e-12


def test_every_key_counts_and_strangers_are_no_evidence(spark):
    letters = (1 << 44) + np.arange(20, dtype=np.uint64)  # one place of the first 24 bits
    rows = spark.createDataFrame([(int(k), 1, float(i - 9)) for i, k in enumerate(letters)], "letter long, weight long, ratio double")
    keys, ratios = toxicity._letters(rows, 20)
    assert keys.tolist() == letters.tolist() and (ratios / toxicity.UNITS).tolist() == [i - 9.0 for i in range(20)]
    assert toxicity._letters(rows, 19).count() == 20
    own = Words(["scum"]).keys(0, toxicity.CONTEXT)
    near = np.sort(own ^ np.uint64(1))  # the same places, other keys
    assert toxicity.Comparer((near, np.full(len(near), 9 * toxicity.UNITS))).features(["scum"]).tolist() == [[0, 0, 0]]
    assert toxicity.Comparer((np.sort(own), np.full(len(own), toxicity.UNITS))).features(["scum"])[0, 0] == len(own)


def test_joined_letters_score_as_those_sent(spark, documents, monkeypatch):
    monkeypatch.setattr(toxicity, "HOT_WORDS", 8)
    rows = [(i, f"the cat number{i % 7} sat on mat{i % 11} and slept") for i in range(60)]
    rows += [(100 + i, f"the cat you moron{i % 3} sat scum") for i in range(60)]
    docs = documents(rows + [(500, None), (501, ""), (502, "a-b c.c, the the"), (None, "null id"), (502, "a-b c.c, the the")])
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows], "doc_id long, toxic int")
    got = []
    for bound in (1_000_000, 0):
        model = toxicity.train(docs, labels, bound)
        got.append(sorted(toxicity.score(docs, model).select("doc_id", "text", "score", "source").collect(), key=str))
    assert len(got[0]) == 125 and got[0] == got[1]


def test_calibration_sample_keeps_whole_groups_of_copies(spark):
    rows = spark.createDataFrame([(f"text {i}", i % 2) for i in range(4_000)] + [("copy", 0)] * 2_000 + [(None, 1), ("unlabelled", None)], "text string, toxic int")
    assert toxicity.calibration_sample(rows, 5_000).count() == 6_001
    some = toxicity.calibration_sample(rows, 400).collect()
    assert 300 <= len({r.text for r in some}) <= 500
    assert sum(r.text == "copy" for r in some) in (0, 2_000)


def test_rows_weigh_as_often_as_they_occur():
    random = np.random.default_rng(3)
    features, times = random.normal(size=(60, 3)), random.integers(1, 5, 60)
    labels = (features[:, 0] + random.normal(size=60) > 0).astype(float)
    spread = toxicity.logistic(np.repeat(features, times, axis=0), np.repeat(labels, times), np.ones(times.sum()))
    for a, b in zip(toxicity.logistic(features, labels, times.astype(float)), spread, strict=True):
        assert np.allclose(a, b)


def test_no_language_is_left_out(spark, documents, monkeypatch):
    monkeypatch.setattr(language, "ROWS", 30)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(100 * k + i, f"{letters[k] * 3} {letters[k] * 2}{letters[(k + 1) % 26]} {letters[k] * 4} {i}", f"l{k:02}") for k in range(26) for i in range(20)]
    rows += [(9_000 + i, "aaa aab aaaa", "l00") for i in range(300)]
    model = language.fit(documents(rows))
    assert len(model.languages) == 26 and model.scores.shape[1] == language.WIDTH
    known = documents(rows).selectExpr("text", "lang", "xxhash64(text) hash")
    chosen = language.candidates(known, dict.fromkeys(model.languages, 20), 2)
    assert chosen.groupBy("lang", "hash").count().where("count > 1").count() == 0
    assert chosen.select("lang").distinct().count() == 26
    got = language.predict(documents(rows), model).collect()
    assert {r.lang_pred for r in got} <= set(model.languages) and all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("folds", [True, False])
def test_language_accuracy_on_held_out(spark, folds):
    docs = table(spark, DIRECTORY, "documents", "doc_id", "text", "lang")
    got = language.op10_language(spark, DIRECTORY).join(docs.select("doc_id", "lang"), "doc_id").where("held_out" if folds else "not held_out")
    rows = got.collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert sum(r.accepted for r in rows) >= 0.9 * len(rows)


def test_language_edges(spark, documents):
    rows = [(i, "der die und das ist nicht " + "x" * (i % 3), "de") for i in range(30)]
    rows += [(100 + i, "the and of is not with " + "x" * (i % 3), "en") for i in range(30)] + [(200, "unlabelled", None), (201, None, "fr"), (202, "", "fr")]
    model = language.fit(documents(rows))
    assert model.languages == ["de", "en"]
    asked = documents([(1, None), (2, ""), (3, "123 !"), (4, "und das ist nicht"), (5, "the and of is"), (5, "the and of is"), (6, VERY_LONG)])
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.predict(asked, model).collect()]
    assert [g[1] for g in got[:3]] == ["und"] * 3 and [g[2] for g in got[:3]] == [0.0] * 3
    assert [g[1] for g in got[3:6]] == ["de", "en", "en"] and all(0 <= g[2] <= 1 for g in got)
    none = language.fit(documents([]))
    assert [r.lang_pred for r in language.predict(asked, none).collect()] == ["und"] * 7
    assert language.predict(documents([]), model).count() == 0
