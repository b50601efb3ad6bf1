"""Conversation repair against its SQL, a brute-force search and conversations longer than a block."""

import hashlib
import heapq
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.llm import conversation_repair as cr

TYPE = "conv_id long, turn long, role string, text string"
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damage(rows, key):
    out = []
    for turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if key is None else key}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def expected(key, rows):
    """Dijkstra over (turns done, grammar state), the queue ordered by cost, then audit."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    queue, done = [(0, "", 0, 0, ())], set()
    while queue:
        cost, audit, i, state, out = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            return (key, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
        for role in ("user", "assistant"):
            if (state, role[0]) in STEP:
                heapq.heappush(queue, (cost + 3, audit + "I", i, STEP[state, role[0]], (*out, role + ":")))
        if i < len(rows):
            _, own, text = rows[i]
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, state, out))
            if faults[i] in (0, 3):
                for role, letter in ((own, "K"), ("user", "R"), ("assistant", "R")):
                    if (state, role[:1]) in STEP:
                        heapq.heappush(queue, (cost + faults[i] + 3 * (letter == "R"), audit + letter, i + 1, STEP[state, role[:1]], (*out, f"{role}:{text}")))


def result(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def plain(spark, rows):
    """The operator on rows as they are."""
    return cr.repair_conversations(spark.createDataFrame(rows, TYPE).withColumn("gone", F.lit(False)))


def by_key(rows):
    out = {}
    for key, *rest in rows:
        out.setdefault(key, []).append(tuple(rest))
    return out


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_sql_and_brute_force(spark, size):
    folder = f"/root/testdata/{size}"
    got = result(cr.op11_conversation_repair(spark, folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    assert got == sorted(con.execute(cr.OP11_SQL).fetchall())
    source = by_key(con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall())
    assert got == [expected(k, damage(rows, k)) for k, rows in sorted(source.items())]


def test_random_conversations(spark):
    rng = random.Random(3)
    rows = []
    for key in range(300):
        for _ in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "system", "tool", "", "umpire"])
            rows.append((key, rng.choice([None, *range(6)]), role, rng.choice(["Yes.", "No", " \t", "Why?  ", "é.", "a.\nb", ""])))
    assert result(plain(spark, rows)) == [expected(k, v) for k, v in sorted(by_key(rows).items())]


def test_long_conversation_is_walked_block_by_block(spark):
    rng = random.Random(4)
    n = 5 * cr.BLOCK_TURNS + 17
    rows = [(1, i, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"{i}.", f"{i}", "same.", ""])) for i in range(n)]
    rows += [(2, i, "user" if i % 2 == 0 else "assistant", f"{i}.") for i in range(2 * cr.BLOCK_TURNS)]
    got = result(plain(spark, rows))
    assert got == [expected(k, v) for k, v in sorted(by_key(rows).items())]
    assert got[1][6:8] == (0, "K" * 2 * cr.BLOCK_TURNS)


def test_one_row_for_every_conversation(spark):
    """Conversations that lose all rows, null ids, null turns, clashing columns and repeated rows."""
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hm."), (None, None, None, None), (None, 3, "user", "Yes."), (None, 3, "user", "Yes."), (None, 4, "assistant", "x" * 200_000 + "."), (-5, None, "user", "No.")]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], TYPE + ", gone string, fault int")
    got = result(cr.repair_conversations(cr.damaged(table)))
    assert got == sorted((expected(k, damage(v, k)) for k, v in by_key(rows).items()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got


def test_empty_table(spark):
    assert plain(spark, []).count() == 0


def test_one_shuffle(spark, sf):
    plan = cr.op11_conversation_repair(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
