import hashlib
import random

import duckdb
import pytest

from shelflot.llm import winnowing
from tests.parity import compare

LONG = "The Ñandú river runs 12 miles past seven quiet farms, and then turns back to sea again slowly"
ITEMS = [
    (1, LONG), (2, "alpha beta"), (3, None), (4, "..."), (5, "one two three four five six seven"), (6, LONG.upper() + " éÉ extra"),
    (10, " ".join(f"w{i}" for i in range(25))), (10, "again under one id, with ten words in it or so"), (None, "zeta"),
]
DOCS = [
    (1, "x y " + LONG.lower() + " z"), (2, None), (3, ""), (4, "it is ALPHA-BETA, alpha beta"), (5, "!!"), (1, "x y " + LONG.lower() + " z"),
    (6, " ".join(f"w{i}" for i in range(3, 13)) + " break " + " ".join(f"w{i}" for i in range(9))), (None, "eta zeta"),
    (7, " ".join(LONG.split()[:9])), (8, "one two three four five six seven " * 300), (9, " ".join(["w1"] * 5_000)),
]
RESULTS = "doc_id long, text string, n_hit string, items int"


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isalnum() and c < "\x7f" or c > "\x7f" else " " for c in text).split(" ")


def brute(docs, items):
    clean = lambda t: [w for w in words(t) if w]
    out = []
    for _, text in docs:
        w, hit, names = clean(text), set(), set()
        for item, item_text in items:
            x = clean(item_text)
            n = min(10, len(x))
            windows = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    names.add("" if item is None else str(item))
        out.append((len(w), len(hit), len(names), sorted(names), bool(hit)))
    return out


def run(spark, docs, items):
    left = spark.createDataFrame([(i, t, "old", k) for k, (i, t) in enumerate(docs)], "doc_id long, text string, n_hit string, place int")
    right = spark.createDataFrame(items, "item_id long, text string")
    rows = winnowing.contaminated(left, right).orderBy("place").collect()
    return [(r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) for r in rows]


def test_edges_against_brute_force(spark):
    assert run(spark, DOCS, ITEMS) == brute(DOCS, ITEMS)


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_random_texts_against_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(winnowing, "BROADCAST_ROWS", bound)
    pick, text = random.Random(5), lambda n, v: " ".join(str(pick.randrange(v)) for _ in range(n))
    items = [(i, text(pick.randrange(5, 40), 3)) for i in range(12)]
    docs = [(i, text(pick.randrange(60), 3)) for i in range(40)] + [(99, items[0][1] + " 7 " + items[3][1])]
    assert run(spark, docs, items) == brute(docs, items)


def test_a_passage_of_many_documents_and_items(spark):
    items = [(i, f"{i} " + LONG) for i in range(60)]
    docs = [(i, (f"doc {i} " if i % 3 else "") + LONG) for i in range(300)]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], ITEMS) == []
    assert run(spark, DOCS[:3], []) == brute(DOCS[:3], [])


def test_every_window_of_ten_words_has_a_fingerprint(spark):
    text = " ".join(random.Random(1).choices("abcd", k=400))
    hashed = winnowing._hashed(spark.createDataFrame([(text,)], "text string"), "text")
    rows = winnowing.fingerprints(hashed, []).select("fp.*").orderBy("first").collect()
    assert [i for r in rows for i in range(r.first, r.upto + 1)] == list(range(391))


def test_query_and_sql_on_edges(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = winnowing.op13_decontaminate(spark, str(tmp_path))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    result = con.execute(winnowing.OP13_SQL)
    assert compare(df.columns, df.collect(), [d[0] for d in result.description], result.fetchall()) is None
    digest = hashlib.sha256(b"1,6").hexdigest()
    assert [r.items_sha256 for r in df.collect() if r.doc_id == 1] == [digest, digest]


def test_no_python_workers(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    plan = winnowing.op13_decontaminate(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Cartesian" not in plan
