import math
import random

import numpy as np
import pytest

from shelflot.llm import jaccard_join as J
from shelflot.llm import near_vectors as N
from shelflot.llm.common import components


def closed(nodes, links):
    """The least node that each reaches, by following links."""
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(110)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7), (999, 999)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == closed({x for e in edges for x in e}, edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_sets(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words)} if 0 < len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


@pytest.mark.parametrize("k, num, den", [(3, 90, 100), (5, 80, 100), (2, 50, 100), (3, 100, 100)])
def test_jaccard_against_brute_force(spark, documents, k, num, den):
    random.seed(k)
    words = [f"w{i}" for i in range(400)]
    passage = random.choices(words, k=60)
    rows, base = [], [random.choices(words, k=random.randrange(5, 120)) for _ in range(25)]
    for i in range(220):
        text = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 2, 5])):
            text[random.randrange(len(text))] = random.choice(words)
        if i % 6 == 0:
            text += passage
        rows.append((i, " ".join(text) if i % 5 else "\n".join(text).upper()))
    rows += [(300, None), (301, ""), (302, " \n"), (303, "one"), (304, "ONE"), (305, "one two"), (306, " ".join(words * 20)), (306, " ".join(words * 20))]
    sets = {i: brute_sets(t, k) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    expected = closed(sets, links)
    got = J.classes(documents(rows), k, num, den).collect()
    assert len(got) == len([1 for i, t in rows if sets[i]])
    for r in got:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), expected[r.doc_id])


def test_jaccard_of_groups_and_of_texts_about_the_threshold(spark, documents):
    random.seed(11)
    words = [f"w{i}" for i in range(3000)]
    heads = [random.choices(words, k=60) for _ in range(3)]
    passages = [random.choices(words, k=20) for _ in range(12)]
    rows = []
    for i in range(150):  # one prefix and size, but different sets: the common passages are in no prefix
        rows.append((i, " ".join(heads[i % 3] + passages[random.randrange(12)] + passages[random.randrange(12)])))
    base = random.choices(words, k=200)
    for i in range(150, 300):
        text = list(base)
        for _ in range(random.randrange(2, 12)):
            text[random.randrange(200)] = random.choice(words)
        rows.append((i, " ".join(text)))
    rows += [(400 + i, "x" * 1_000_000 + f" b c {i // 2}") for i in range(4)]
    for num, den in ((80, 100), (90, 100)):
        sets = {i: brute_sets(t, 3) for i, t in rows}
        links = [(a, b) for a in sets for b in sets if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
        expected = closed(sets, links)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.classes(documents(rows), 3, num, den).collect()}
        assert got == {i: (len(sets[i]), expected[i]) for i in sets}


def test_one_of_each(spark, documents):
    same = "a b c d e f g h i j"
    rows = [(4, same), (2, same.upper()), (2, same.upper()), (None, same), (9, "x y z"), (5, None), (5, None), (6, " ")]
    got = J.one_of_each(documents(rows)).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == [(2, same.upper()), (5, ""), (5, ""), (6, " "), (9, "x y z")]
    assert J.one_of_each(documents([])).count() == 0


def test_packed_numbers():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 1000, dtype=np.uint64))
    assert (J.unpack(J.pack(values)) == values).all()
    assert len(J.unpack(J.pack(values[:0]))) == 0


def test_vectors_against_brute_force(spark):
    random.seed(5)
    rows, base = [], [[random.gauss(0, 1) for _ in range(8)] for _ in range(30)]
    for i in range(400):
        b = base[i % 30]
        rows.append((i, [float(np.float32(x + random.gauss(0, 0.04))) for x in b], i % 3 if i % 50 else None))
    rows += [(1000, rows[1][1], 1), (1001, [2 * x for x in rows[1][1]], 1), (1001, [2 * x for x in rows[1][1]], 1), (None, rows[4][1], 1)]
    odd = [(2000, None, 1), (2001, [0.0] * 8, 1), (2002, [float("nan")] + [1.0] * 7, 1), (2003, [None] + [1.0] * 7, 1), (2004, [1.0] * 5, 1), (2005, [math.inf] * 8, 1), (2006, [], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    good = [(k, r) for k, r in enumerate(rows) if r[2] is not None]
    unit = {k: np.array(r[1], float) / np.linalg.norm(r[1]) for k, r in good}
    links = [(a, b) for a, x in good for b, y in good if a < b and x[2] == y[2] and unit[a] @ unit[b] >= 0.98]
    degree = {k: 0 for k in range(len(rows))}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    place, members = closed(range(len(rows)), links), {}
    for k, r in enumerate(rows):
        members.setdefault(place[k], []).append(r[0])
    least = {p: min((i for i in ids if i is not None), default=None) for p, ids in members.items()}
    expected = sorted(((r[0], degree[k], least[place[k]]) for k, r in enumerate(rows)), key=str) + [(o[0], 0, o[0]) for o in odd]
    got = [(r.vec_id, r.n_links, r.component_id) for r in N.near_duplicates(df).collect()]
    found, all_links = sum(g[1] for g in got), 2 * len(links)
    assert 0.9 * all_links <= found <= all_links
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert N.near_duplicates(df.limit(0)).count() == 0
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in N.near_duplicates(df.where("vec_id > 1900 or vec_id is null")).collect())


def test_vectors_of_all_lengths_and_doubles(spark):
    random.seed(6)
    rows, base = [], {d: [[random.gauss(0, 1) for _ in range(d)] for _ in range(40)] for d in (8, 5, 2)}
    for i in range(900):
        d = (8, 8, 5, 2)[i % 4]
        rows.append((i, [x + random.gauss(0, 0.02) for x in base[d][i % 40]], str(i % 2)))
    rows += [(2000 + i, [x], "0") for i, x in enumerate((3.0, 0.5, -1.0, -7.0, 1e-9))]
    edge = math.sqrt(1 / 0.98**2 - 1)
    rows += [(3000, [1.0, 0.0, 0.0], "e"), (3001, [1.0, edge * (1 - 1e-10), 0.0], "e"), (3002, [1.0, 0.0, edge * (1 + 1e-10)], "e")]
    rows += [(3100, [1e300, 1e299, 0.0], "far"), (3101, [1e-200, 1e-201, 0.0], "far"), (3200, [2.0, 3.0], "1"), (3201, [3.0], "1,2")]
    unit = [np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) for _, v, _ in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    degree = np.bincount(np.array(links).ravel(), minlength=len(rows))
    place = closed([r[0] for r in rows], [(rows[a][0], rows[b][0]) for a, b in links])
    got = N.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(r[0], n, place[r[0]]) for r, n in sorted(zip(rows, degree.tolist()))]
    assert {r.vec_id: r.n_links for r in got if 2000 <= r.vec_id < 3200} == {2000: 2, 2001: 2, 2002: 1, 2003: 1, 2004: 2, 3000: 1, 3001: 1, 3002: 0, 3100: 1, 3101: 1}
