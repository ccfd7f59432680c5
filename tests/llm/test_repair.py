"""Conversation repair against a forward search over whole audits."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from courierlake.llm import conversation_repair as cr

FOLLOWS, ROLES = {0: 2, 1: 2, 2: 3, 3: 2}, {2: "user", 3: "assistant"}


def harmed(rows):
    by = {r[0]: [] for r in rows}
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(k, text)
        by[c] += [(t, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
    return {c: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, v in by.items()}


def with_inserts(states):
    for _ in range(3):
        for q, (cost, audit, rows) in list(states.items()):
            to = FOLLOWS[q]
            new = (cost + 5, audit + "I", (*rows, f"{ROLES[to]}:"))
            if to not in states or new[:2] < states[to][:2]:
                states[to] = new
    return states


def brute(rows):
    out = {}
    for c, own in harmed(rows).items():
        turns = [t for t, _, _ in own if t is not None]
        faults, seen = [], set()
        for _, role, text in own:
            signs = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not signs else "duplicate" if (role, text) in seen else "" if signs[-1] in ".!?" else "truncated")
            seen.add((role, text))
        states = with_inserts({0: (0, "", ())})
        for (_, role, text), fault in zip(own, faults):
            new = {}

            def put(q, x):
                if q not in new or x[:2] < new[q][:2]:
                    new[q] = x

            for q, (cost, audit, done) in states.items():
                put(q, (cost + 2, audit + "D", done))
                if fault not in ("blank", "duplicate"):
                    more = 5 * (fault == "truncated")
                    put(FOLLOWS[q], (cost + 1 + more, audit + "R", (*done, f"{ROLES[FOLLOWS[q]]}:{text}")))
                    to = 1 if role[:1] == "s" and q == 0 else FOLLOWS[q] if role[:1] == ROLES[FOLLOWS[q]][0] else None
                    if to:
                        put(to, (cost + more, audit + "K", (*done, f"{role}:{text}")))
            states = with_inserts(new)
        cost, audit, done = min((states[q] for q in (0, 3) if q in states), key=lambda x: x[:2])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest())
    return out


def got(df, **more):
    rows = df.collect() if not more else cr.repair(df, **more).collect()
    out = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    texts = ["a.", "b", "", " ", "c!", "d?", "long text", None, "e", "f.\n", "g.", "é.", "x" * 3000 + "."]
    roles = ["user", "assistant"] * 4 + ["user", "assistant", "system", None, "tool", "", "u2", "s"]
    out = []
    for _ in range(3000):
        text = rng.choice(texts)
        text = text + str(rng.randrange(400)) + rng.choice([".", ""]) if text is not None and rng.random() < 0.6 else text
        out.append((99 if rng.random() < 0.4 else rng.choice([None, *range(60)]), rng.choice([None, *range(300)]), rng.choice(roles), text))
    return out + [(98, 5, "user", "same.")] * 300 + [(97, 5, None, None)] + [(96, t, "user", "x.") for t in range(4) if zlib.crc32(f"96:{t}".encode()) % 20 == 0]


@pytest.mark.parametrize("fragment", [cr.FRAGMENT, 41])
def test_made_conversations(spark, rows, fragment):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, c string, at int").repartition(5)
    assert got(df, fragment=fragment) == brute(rows)


def test_table(spark):
    path = "/root/testdata/sf0.001/conversations.parquet"
    assert got(cr.repair(spark.read.parquet(path))) == brute(duckdb.sql(f"select conv_id, turn, role, text from '{path}'").fetchall())


def test_empty(spark):
    assert cr.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    gone = next(t for t in range(100) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    one = cr.repair(spark.createDataFrame([(5, gone, "user", "x.")], "conv_id long, turn long, role string, text string"))
    assert got(one) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_distances_are_shortest():
    rng = random.Random(7)
    for _ in range(40):
        codes = bytes(rng.choice([0, 1, 2, 3, 1, 2, 4, 8 + 1, 8 + 2, 8]) for _ in range(rng.randrange(12)))
        dist = cr.distances(codes, cr.ENDS)
        n, want = len(codes), {}
        for q in range(4):  # relaxed until nothing changes
            want[n, q] = cr.ENDS[q]
        for i in range(n, -1, -1):
            for q in range(4):
                if i < n:
                    c = codes[i]
                    more = 5 if c & cr.TRUNCATED else 0
                    options = [2 + want[i + 1, q]]
                    if not c & cr.GONE:
                        options.append(1 + more + want[i + 1, cr.NEXT[q]])
                        kept = cr.kept_state(c, q)
                        options += [more + want[i + 1, kept]] if kept >= 0 else []
                    want[i, q] = min(options)
            for _ in range(4):
                for q in range(4):
                    want[i, q] = min(want[i, q], 5 + want[i, cr.NEXT[q]])
        assert dist == [want[i, q] for i in range(n + 1) for q in range(4)]
