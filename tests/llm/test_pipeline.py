import random

import pytest

import corpus_pipeline
from shelflot.llm import mixing
from tests.llm.test_near import brute_sets, closed


@pytest.mark.parametrize("weights", [{"a": 0.5, **{f"s{i}": 0.05 for i in range(10)}}, {"a": 1.0}, {"a": 0.31, "b": 0.29, "c": 0.4}])
def test_deviation_is_below_one_block(weights):
    slots, period = mixing.shares(weights)
    assert sum(slots.values()) == period
    total = sum(weights.values())
    assert all(abs(slots[s] / period - w / total) <= len(weights) / period for s, w in weights.items())
    served = dict.fromkeys(slots, 0)
    for s, i, slot in mixing.schedule(slots, period):
        assert i == served[s] and i * period // slots[s] <= slot < -(-(i + 1) * period // slots[s])
        served[s] += 1
        assert all(abs(served[k] - slots[k] * (slot + 1) / period) < 1 for k in slots)


def test_mix(spark, documents):
    rows = [(i, "x" * (50 + i % 90), None, "big") for i in range(300)] + [(1000 + i, "y" * 80, None, "small") for i in range(20)]
    rows += [(5000, None, None, None), (5000, None, None, None), (None, "", None, ""), (6000, "z" * 2_000, None, "small")]
    docs = documents(rows)
    got = mixing.mix(docs, {"big": 2, "small": 1, mixing.NO_SOURCE: 1, "": 1}, block_chars=500).collect()
    assert len({(r.doc_id, r.text_hash, r.copy) for r in got}) == len(rows)  # none is lost
    assert all(r.release <= r.slot < r.deadline for r in got)
    blocks = {}
    for r in got:
        assert blocks.setdefault(r.slot, (r.source, r.epoch, r.block)) == (r.source, r.epoch, r.block)
    assert len({(r.doc_id, r.text_hash, r.copy, r.epoch) for r in got}) == len(got)
    out = mixing.mixed_rows(docs, {"big": 2, "small": 1, mixing.NO_SOURCE: 1, "": 1}, block_chars=500)
    assert out.columns == docs.columns and out.count() == len(got)
    assert mixing.mix(documents([])).count() == 0 and mixing.mixed_rows(documents([])).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"big": 1.0})


def test_characters_follow_the_weights_past_long_last_documents(spark, documents):
    rows = [(1, "x" * 5_000, None, "long")] + [(100 + i, "y" * 100, None, "short") for i in range(400)] + [(9, "z" * 3_000, None, "other")]
    weights = {"long": 2, "short": 5, "other": 1}
    slots, period = mixing.shares(weights)
    got = mixing.mix(documents(rows), weights, block_chars=500).collect()
    length = {i: len(text) for i, text, _, _ in rows}
    longest = {"long": 5_000, "short": 100, "other": 3_000}
    for end in range(20, max(r.slot for r in got) + 2):
        for s in weights:
            served = sum(length[r.doc_id] for r in got if r.source == s and r.slot < end)
            assert abs(served - end * 500 * slots[s] / period) <= longest[s] + 500


def test_pipeline_against_brute_force(spark, tmp_path):
    random.seed(9)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(260):
        text = random.choices(words, k=random.randrange(12, 40))
        if i >= 130 and i % 13 == 0:
            text = rows[i - 130][1].split(" ")
        if i % 4 == 0:
            for _ in range(4):
                text.insert(random.randrange(len(text)), random.choice(["moron", "idiot", "scum"]))
        elif i % 9 == 0:
            text += ["token=abcdef99"]
        rows.append((i, " ".join(text), "en", f"s{i % 5 if i % 3 else 0}", 0, "kept"))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(900, None, None, None, None, "kept"), (901, "", "en", "s1", 0, None), (None, "no number " * 8, "en", "s2", 0, "kept")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), [(r[0], r[1]) for r in rows]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/out/{name}")
        if name != "byte_bpe":
            assert docs.columns == before.columns
        got = [(r.doc_id, r.text) for r in docs.collect()] if name != "byte_bpe" else None
        if name == "toxicity":
            expected = [(i, t) for i, t in kept if not (t and {"moron", "idiot", "scum"} & set(t.split()))]
            assert sorted(got, key=str) == sorted(expected, key=str)
        elif name == "ngram_jaccard_join":
            sets = {i: brute_sets(t, 5) for i, t in kept if i is not None}
            least = closed(sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
            assert sorted(got, key=str) == sorted([(i, t) for i, t in kept if i is None or least[i] == i], key=str)
        elif name == "secret_scan":
            assert sorted(got, key=str) == sorted([(i, t and t.replace("token=abcdef99", "[secret]")) for i, t in kept], key=str)
            assert all(r.n_chars == len(r.text) for r in docs.where("text like '%[secret]%'").collect())
        elif name == "source_mix":
            assert set(got) == set(kept)
        kept = got
    assert docs.where("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
