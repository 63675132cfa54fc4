import hashlib
import random
import re
import zlib

import numpy as np

from shelflot.llm import periodic_runs as pr

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - p:
            j = i
            while j < len(words) - p and words[j] == words[j + p]:
                j += 1
            if j - i >= p and j - i + p >= 12:
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_against_brute_force():
    pick = random.Random(3)
    for _ in range(400):
        texts = []
        for _ in range(pick.randint(1, 4)):
            n, v = pick.randint(0, 120), pick.choice([1, 2, 3, 5, 40])
            x = [pick.randrange(v) for _ in range(n)]
            if n and pick.random() < 0.6:
                a = pick.randrange(n)
                p = pick.randint(1, max(1, (n - a) // 2))
                x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
            texts.append(x)
        got = pr.find_runs(np.array(sum(texts, []), np.int64), np.array([len(x) for x in texts], np.int64))
        assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, x in enumerate(texts) for r in brute(x)]


def test_transforms_multiply_polynomials():
    x = np.random.default_rng(0).integers(0, pr.PRIME, (3, 16), dtype=np.uint64)
    assert (pr.inverse(pr.transform(x)) == x).all()
    codes = np.array([5, 7, 9, 5, 7, 9, 5, 7, 9, 5, 7, 9] + [0] * 30, np.uint64)
    starts, distances = pr.zero_mismatches(codes, np.array([0, 2]), 2)
    assert sorted(zip(starts.tolist(), distances.tolist())) == [(0, 3), (0, 6), (2, 3), (2, 6)]


def test_long_texts_cost_little():
    one, pair = np.zeros(200_000, np.int64), np.tile(np.arange(60_001), 4)
    assert pr.find_runs(one, np.array([len(one)])).tolist() == [[0, 0, 200_000, 1]]
    assert pr.find_runs(pair, np.array([len(pair)])).tolist() == [[0, 0, 240_004, 60_001]]


def test_column_values(spark, documents):
    texts = [None, "", " \t\n", "a\x0bb " * 8, "x  é y z " * 5 + "end", "a " * 30 + "b c " * 9, "no run here at all", "w " * 11, "w " * 12]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    df = documents(rows).withColumnRenamed("score", "runs")
    got = pr.with_runs(df)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "runs", "collapsed"]
    assert got.count() == len(rows)
    for r in got.collect():
        words = BLANK.findall(r.text or "")
        runs = brute(words)
        assert [tuple(x) for x in r.runs] == runs and r.collapsed == collapsed(words, runs)
    assert pr.with_runs(documents([])).count() == 0


def test_query(spark, tmp_path):
    pick = random.Random(2)
    rows = [(i, " ".join(pick.choices("abcdefgh", k=pick.randrange(300)))) for i in range(120)]
    rows += [(500, None), (None, "q " * 20), (7, rows[7][1]), (501, "one two three " * 2_000), (502, "")]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for doc, text in rows:
        h, words = zlib.crc32(str("" if doc is None else doc).encode()), BLANK.findall(text or "")
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words)
        s, length, p = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        want.append((
            doc, len(runs), s, length, p, None if p is None else 1000 * length // p,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest(),
        ))
    got = [tuple(r) for r in pr.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(r[1] and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in got)
