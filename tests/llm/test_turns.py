import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from shelflot.llm import turn_repair as tr

BLANK = " \t\n\x0b\x0c\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def planted(rows):
    out = []
    for conv, turn, role, text in rows:
        plain = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{plain(conv)}:{plain(turn)}".encode()) % 20
        role, text = plain(role), plain(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(rows, faults):
    """Dijkstra without a heap: costs are small, so all (cost, audit) pairs are relaxed in order of rows."""
    layer = {"": (0, "", ())}
    for i in range(len(rows) + 1):
        for _ in range(2):  # inserts before row i
            for state, (cost, audit, out) in list(layer.items()):
                to = NEXT[state]
                new = (cost + 3, audit + "I", (*out, ("user" if to == "u" else "assistant", "")))
                layer[to] = min(layer.get(to, (10**9,)), new)
        if i == len(rows):
            break
        (_, _, role, text), fault, after = rows[i], faults[i], defaultdict(lambda: (10**9,))
        for state, (cost, audit, out) in layer.items():
            after[state] = min(after[state], (cost + 4, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more, first = 3 * (fault == "truncated"), role[:1]
            if first == NEXT[state] or (first == "s" and state == ""):
                after[first] = min(after[first], (cost + more, audit + "K", (*out, (role, text))))
            to = NEXT[state]
            after[to] = min(after[to], (cost + 3 + more, audit + "R", (*out, ("user" if to == "u" else "assistant", text))))
        layer = dict(after)
    return min(layer[s] for s in ("", "a") if s in layer)


def brute(rows):
    by = defaultdict(list)
    for r in planted(rows):
        by[r[0]].append(r)
    out = []
    for conv in dict.fromkeys(r[0] for r in rows):
        mine = sorted(by[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults = set(), []
        for _, _, role, text in mine:
            bare = text.strip(BLANK)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in mine if r[1] is not None]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, kept = cheapest(mine, faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest))
    return out


def made(seed, convs=60, longest=14):
    pick, rows = random.Random(seed), []
    for conv in [*range(convs), None]:
        for _ in range(pick.randrange(longest)):
            role = pick.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = pick.choice(["Yes.", "no", " ", None, "a. b!", "Why? \n", "Done.", f"Text {pick.random()}.", "é "])
            rows.append((conv, pick.choice([None, *range(20)]), role, text))
    return rows


def results(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, pos string")
    summary, repaired = tr.repair(tr.damaged(df), **options)
    found = summary.join(tr.digests(repaired), "__c", "left").collect()
    empty = hashlib.sha256().hexdigest()
    got = {r["__c"]: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256 or empty) for r in found}
    want = {"" if w[0] is None else f"={w[0]}": w[1:] for w in brute(rows)}
    return got, {c: w for c, w in want.items() if c in got}


def test_query_against_brute_force(spark, tmp_path):
    rows = made(1) + [(500, t, "user", "same.") for t in range(30)] + [(501, t, "assistant" if t % 2 else "user", f"T{t}. " * 500) for t in range(40)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = [tuple(r) for r in tr.op12_turn_repair(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("passes", [6, 0])
def test_chunks_and_matrices_give_the_same(spark, passes):
    rows = made(2, 12, 60) + [(900, t, "user", f"u{t}.") for t in range(50)]
    got, want = results(spark, rows, chunk=5, passes=passes)
    assert got == want and len(got) > 10


def test_fix_up_stops_where_costs_differ_by_a_constant():
    pick = random.Random(4)
    for _ in range(300):
        letters = "".join(pick.choices("suaoSUAO0123", k=pick.randrange(1, 40)))
        old, new = [0, 0, 0, 0], [pick.randrange(7) for _ in range(4)]
        assert tr.fix_up(letters, old, new, tr.backward(letters, old)) == tr.backward(letters, new)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    summary, repaired = tr.repair(tr.damaged(df))
    assert summary.count() == repaired.count() == tr.digests(repaired).count() == 0
