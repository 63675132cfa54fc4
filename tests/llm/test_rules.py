import hashlib
import re

import duckdb
import pytest

from shelflot.llm import host_rules, secret_scan
from tests.parity import compare

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
TEXTS = [
    None, "", "no secret here", 'Token = "abcdef12" é\U0001f600 secret: short', "token:token:abcdefgh", "AKIA" + "A" * 16 + " AKIAshort AKIA" + "B" * 15,
    "f" * 24 + "g" + "0" * 23 + "\U0001f600" + "deadbeef" * 8, "api_key=== AKIA" + "9" * 20, "x\npassword: " + "a" * 50 + " tail", "-----BEGIN RSA PRIVATE KEY----- ghp_" + "Z" * 36,
    "token=abcdef " * 4_000,
]


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def test_secrets(spark, documents):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, TEXTS[8])]
    df = secret_scan.find_secrets(documents(rows).withColumnRenamed("score", "blob"))
    assert "blob" in df.columns
    got = secret_scan.digests(df).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = brute(TEXTS[8] if r.doc_id is None else TEXTS[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{s[2]}:{s[0]}:{s[3]}" for s in spans).encode()).hexdigest()
    assert [s.split(":")[0] for r in got if r.doc_id == 9 for s in r.spans.split(",")] == ["pem", "github"]
    assert secret_scan.find_secrets(documents([])).count() == 0


def test_ledger_scans_only_what_it_has_not_seen(spark, documents, tmp_path):
    ledger, rules = str(tmp_path / "ledger"), secret_scan.BASE
    first = documents([(1, TEXTS[3]), (2, TEXTS[3]), (3, "clean")])
    assert secret_scan.find_secrets(first, ledger, rules).where("size(spans) > 0").count() == 2
    pairs = lambda: spark.read.parquet(f"{ledger}/scanned").count()
    assert pairs() == 2 * len(rules)
    more = first.union(documents([(4, TEXTS[8]), (5, "clean")]))
    assert secret_scan.find_secrets(more, ledger, rules).where("size(spans) > 0").count() == 3
    assert pairs() == 3 * len(rules)
    newer = (*rules[:2], secret_scan.Rule("hex", "[0-9a-f]{40,}", 40, 0, 2))
    secret_scan.find_secrets(more, ledger, newer)
    assert pairs() == 3 * len(rules) + 3  # the new version alone
    assert secret_scan.find_secrets(more, ledger, rules).where("size(spans) > 0").count() == 3


def test_redacted(spark, documents):
    rows = [(1, "a token=abcdef12 b " + "f" * 30 + " c"), (2, "secret = " + "a" * 30), (3, None), (4, "clean"), (5, "token: abcdef")]
    found = secret_scan.find_secrets(documents(rows))
    got = {r.doc_id: r.t for r in found.select("doc_id", secret_scan.redacted().alias("t")).collect()}
    assert got == {1: "a [secret] b [secret] c", 2: "[secret]", 3: None, 4: "clean", 5: "[secret]"}


def host_rows():
    good = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(i, good + f" {i}", None, "good.example") for i in range(40)]
    rows += [(100 + i, "$$$ ### " * 12 + good, None, "bad.example") for i in range(60)]
    rows += [(200, "short", None, "good.example"), (201, good * 1 + "\n" + good, None, None), (202, None, None, "good.example"), (203, "", None, ""), (203, "", None, "")]
    rows += [(300, ("a b c d e f " * 3_000), None, "few.example"), (301, "x\n" * 50 + good, None, "few.example"), (302, "a b c d e a b c d e q r", None, "few.example")]
    return rows


def test_one_host(spark, documents):
    rows = [(1, "a b c", None, "h"), (2, None, None, "h"), (3, "one two three four five six seven eight nine ten", None, "h"), (4, "x", None, None)]
    assert {r.doc_id: r.kept for r in host_rules.judge(documents(rows)).collect()} == dict.fromkeys([1, 2, 3, 4], False)
    assert {r.doc_id: r.kept for r in host_rules.judge(documents(rows[2:])).collect()} == {3: True, 4: False}


def test_host_rules(spark, documents):
    docs = documents(host_rows())
    con = duckdb.connect()
    con.register("documents", docs.drop("score").toPandas())
    got = host_rules.judge(docs)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    result = con.execute(host_rules.OP8_SQL)
    assert compare(columns, got.select(columns).collect(), [d[0] for d in result.description], result.fetchall()) is None
    kept = {r.doc_id: r.kept for r in got.collect()}
    assert kept[0] and not kept[100] and not kept[200] and not kept[202]
    assert {r.doc_id: r.n_repeat_words for r in got.collect()}[302] == 10
    salted = host_rules.judge(docs, small_bytes=0)
    assert sorted(map(str, salted.collect())) == sorted(map(str, got.collect()))
    clashing = docs.selectExpr("*", "5 as host_ok")
    assert {r.host_ok for r in host_rules.judge(clashing).collect()} == {5}
    assert host_rules.judge(documents([])).count() == 0


@pytest.mark.parametrize("query, sql", [(host_rules.op8_host_rules, host_rules.OP8_SQL), (secret_scan.op4_secret_scan, secret_scan.OP4_SQL)])
def test_native(spark, query, sql):
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
