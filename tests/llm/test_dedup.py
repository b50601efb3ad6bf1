"""Line, passage and near-duplicate removal against brute force."""

import random
import re

import duckdb
import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import line_dedup, simhash, substring_dedup
from quire.llm.components import connected_components
from quire.llm.perfect_hash import PerfectHash

SCHEMA = "doc_id long, text string, shard int, hi string, carry int, drops string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, "y") for i, t in rows], SCHEMA).repartition(3)


def test_op10_is_the_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(line_dedup.OP10_SQL).fetchall()
    assert sorted(map(tuple, line_dedup.op10_line_dedup(spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())) == sorted(want)


def kept_lines(rows):
    """By brute force; rows of one id are one document."""
    keys = lambda t: [line.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)}) for line in (t or "").split("\n")]
    holders = {}
    for i, t in rows:
        for k in keys(t):
            holders.setdefault(k, set()).add(-(1 << 63) if i is None else i)
    out = []
    for i, t in rows:
        own = -(1 << 63) if i is None else i
        kept = [line for line, k in zip((t or "").split("\n"), keys(t), strict=True) if len(k) < 20 or len(holders[k]) < 3 or max(holders[k]) == own]
        out.append((i, "\n".join(kept)))
    return out


L = "This line has more than twenty letters"
ROWS = [
    (1, f"{L}\nother text\n{L}"), (2, f"  {L.upper()}\t\nown line of document two, long"), (3, f"{L}\n{L} \n"), (4, None), (5, ""), (6, "\n\n"), (7, "x" * 50_000 + "\n" + L),
    (8, "née École été à la plage"), (9, "née École été à la plage"), (10, "née École été à la plage"), (11, "short"), (12, "short"), (13, "short"), (None, f"{L}\nnull id"), (3, "a second row of id three\n" + L), (1, f"{L}\nother text\n{L}"),
    (14, "nineteen letters ab"), (15, "nineteen letters ab"), (16, "nineteen letters ab"), (17, "exactly twenty chars"), (18, "exactly twenty chars"), (19, "exactly twenty chars"),
]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_lines_against_brute_force(spark):
    got = [(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(frame(spark, ROWS), carry=["shard", "hi"]).collect()]
    assert order(got) == order(kept_lines(ROWS))
    assert line_dedup.dedup_lines(frame(spark, []).limit(0)).count() == 0


def test_repeated_ids_are_one_document_as_in_the_sql(spark):
    rows = [(i, t) for i, t in ROWS if i is not None] + [(50, f"{L} x"), (50, f"{L} x\n{L} x"), (51, f"{L} x"), (50, f"{L} x"), (60, f"{L} y"), (60, f"{L} y"), (61, f"{L} y"), (62, f"{L} y\n")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted(con.execute(f"SELECT doc_id, n_lines, n_dropped FROM ({line_dedup.OP10_SQL})").fetchall())
    got = {}
    for r in line_dedup.dedup_lines(frame(spark, rows)).collect():
        lines, dropped = got.get(r["doc_id"], (0, 0))
        got[r["doc_id"]] = lines + r["n_lines"], dropped + r["n_dropped"]
    assert sorted((i, *x) for i, x in got.items()) == want


def test_joined_frame_and_many_shards(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_BYTES", 2_000)
    rng = random.Random(4)
    rows = [(i, "\n".join(f"a line of the pool with number {rng.randrange(300)}" for _ in range(5))) for i in range(300)]
    keys = spark.createDataFrame([(i,) for i, _ in rows], "doc_id long")
    joined = frame(spark, rows).join(keys, "doc_id").join(keys, "doc_id")
    assert order([(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(joined).collect()]) == order(kept_lines(rows))


def test_hot_lines(spark, monkeypatch):
    rng = random.Random(1)
    pool = [f"a common line of the pool number {k}" for k in range(6)]
    rows = [(i, "\n".join([*rng.sample(pool, 3), f"its own line {i} is long enough"])) for i in range(900)]
    monkeypatch.setattr(line_dedup, "SHARD_BYTES", 1_000_000_000)
    got = [(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()]
    assert order(got) == order(kept_lines(rows))


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 5000), st.integers(0, 1 << 30))
def test_perfect_hash(n, seed):
    rng = np.random.default_rng(seed)
    hi, lo = rng.integers(0, 1 << 63, n, dtype=np.uint64) % np.uint64(7), np.arange(n, dtype=np.uint64)
    h = PerfectHash.build(hi, lo)
    assert sorted(PerfectHash.from_bytes(h.to_bytes()).find(hi, lo).tolist()) == list(range(n))


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[j : j + 4]) for j in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, prints):
    v, parent = np.array(prints, np.uint64), list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in np.flatnonzero(np.bitwise_count(v[a] ^ v[a + 1 :]) <= 4):
            x, y = root(a), root(a + 1 + int(b))
            parent[max(x, y)] = min(x, y)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [least.get(root(k)) for k in range(len(ids))]


def test_op9(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().sort_values("doc_id")
    prints = list(map(fingerprint, docs.text))
    want = list(zip(docs.doc_id, (f"{p:016x}" for p in prints), components(list(docs.doc_id), prints), strict=True))
    assert sorted(map(tuple, simhash.op9_simhash(spark, sf).select("doc_id", "fingerprint", "component_id").collect())) == want


def test_simhash_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "a b c d e"), (7, "a  b\tc d E"), (7, "another row of seven"), (None, "one"), (9, "é É x y z"), (10, "word " * 30_000)]
    got = sorted(((r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(frame(spark, rows)).collect()), key=repr)
    prints = [fingerprint(t) for _, t in rows]
    assert got == sorted(zip((i for i, _ in rows), prints, components([i for i, _ in rows], prints), strict=True), key=repr)
    assert simhash.near_duplicates(frame(spark, []).limit(0)).count() == 0


def test_links_of_dense_groups(spark):
    """Random fingerprints, a chain, and a cloud around one centre, with buckets small enough to be dealt out."""
    rng = np.random.default_rng(3)
    values = set(rng.integers(0, 1 << 63, 300, dtype=np.uint64).tolist())
    x = 0x0123456789ABCDEF
    for k in range(40):
        x ^= sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        values.add(x)
    for _ in range(400):
        values.add(0xF0F0F0F0F0F0F0F0 ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False)))
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    classes = spark.createDataFrame([(s, s, 0, 0) for s in signed], "node long, fingerprint long, second long, size int").repartition(3)
    links = simhash.link_fingerprints(classes, bucket=64)
    found = {r["node"]: r["component"] for r in connected_components(links).collect()}
    want = components(signed, values)
    assert len({found.get(s, s) for s in signed}) == len(set(want))
    assert {(found.get(a, a) == found.get(b, b)) == (x == y) for a, x in zip(signed, want, strict=True) for b, y in zip(signed, want, strict=True)} == {True}


def test_plan_is_complete():
    rng = np.random.default_rng(4)
    sample = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    for total in (10, 10**4, 10**9):
        plan = simhash.plan_partitions(sample, 4, total)
        assert sum(t + 1 for _, t in plan) == 5
        a = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        b = a ^ np.array([sum(1 << int(k) for k in rng.choice(64, 4, replace=False)) for _ in a], np.uint64)
        met = np.zeros(len(a), bool)
        for bits, t in plan:
            (i, s), (j, r) = simhash.signatures(a, bits, t), simhash.signatures(b, bits, t)
            own = [set(s[i == k].tolist()) & set(r[j == k].tolist()) for k in range(len(a))]
            met |= np.array([bool(o) for o in own])
        assert met.all()


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(64)] + [(2000, 2001 + i) for i in range(50)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert got == {n: root(n) for a, b in links if a != b for n in (a, b)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


SENTENCES = [f"{w} goes over the hill with its {w} and never comes back to {w}." for w in ("ant", "bee", "cow", "dog", "elk", "fox", "gnu", "hen")]
OTHERS = [f"{w} sits by the road with one {w} and waits for a {w}." for w in ("owl", "pig", "rat", "yak")]
PASSAGE = " ".join(SENTENCES[:6])


def plain_clauses(text):
    """Up to a stop, comma or colon before a blank, with the blanks; up to the end of a line, with the empty lines after it."""
    out, start, i = [], 0, 0
    while i < len(text):
        j = i + 1
        if text[i] == "\n":
            while j < len(text) and text[j] == "\n":
                j += 1
        elif text[i] in ".!?,;:" and text[j : j + 1] in (" ", "\t"):
            while text[j : j + 1] in (" ", "\t"):
                j += 1
        else:
            i = j
            continue
        out.append(text[start:j])
        start = i = j
    return out + [text[start:]] * (start < len(text))


def plain_units(text):
    """(start, end, words, normal form) of units that aren't blank: a clause of six words ends one, as does a line; of two shorter ones in a row the second may."""
    out, start, at, before = [], 0, 0, None
    for c in plain_clauses(text):
        words = c.split()
        at += len(c)
        whole = len(words) >= 6 or c.endswith("\n")
        poor = bool(before) and not whole and xxhash.xxh3_64_intdigest(" ".join(before + words).lower().encode()) % 3 == 0
        before = None if whole else words
        if whole or poor or at == len(text):
            unit = text[start:at]
            if unit.split():
                out.append((start, at, len(unit.split()), " ".join(unit.lower().split())))
            start = at
    return out


def passages_left(rows, min_words=25):
    """The operator's rule by brute force: later units go where they stand together, all of them or those of six words or more, with min_words words."""
    name = lambda i: -(1 << 63) if i is None else i
    units = [plain_units(t or "") for _, t in rows]
    first = {}
    for (i, _), own in zip(rows, units, strict=True):
        for k, u in enumerate(own):
            first[u[3]] = min(first.get(u[3], (name(i), k)), (name(i), k))
    out = []
    for (i, t), own in zip(rows, units, strict=True):
        later = [first[u[3]] != (name(i), k) for k, u in enumerate(own)]
        gone = set()
        for among in (list(range(len(own))), [k for k, u in enumerate(own) if u[2] >= 6]):
            runs = [[]]
            for k in among:
                runs[-1].append(k) if later[k] else runs.append([])
            for run in runs:
                if sum(own[k][2] for k in run) >= min_words:
                    gone.update(run)
        kept = list(t or "")
        for k in gone:
            kept[own[k][0] : own[k][1]] = [""] * (own[k][1] - own[k][0])
        out.append((i, "".join(kept)))
    return out


def test_passages_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, "\n".join(" ".join(rng.choice(OTHERS) if rng.random() < 0.2 else f"{rng.random()} is a number that stands alone here {rng.random()}." for _ in range(rng.randint(1, 6))) for _ in range(3))) for i in range(60)]
    rows += [(100, f"An opening of its own. {PASSAGE} And an end."), (101, f"other words before it {PASSAGE}"), (102, PASSAGE.upper()), (103, ""), (104, "clean text that nobody else has written down here. " * 3), (105, "w " * 20_000 + PASSAGE)]
    got = {r["doc_id"]: r for r in substring_dedup.dedup_passages(frame(spark, rows), carry=["hi"]).collect()}
    assert {i: r["text"] for i, r in got.items()} == dict(passages_left(rows))
    assert got[100]["n_removed"] == 0 and got[104]["text"] != ""
    assert "fox goes" in got[100]["text"] and "fox goes" not in got[101]["text"] and "FOX" not in got[102]["text"]
    spans = [(s["start"], s["end"]) for s in got[101]["removed"]]
    assert "".join(dict(rows)[101][a:b] for a, b in spans) in PASSAGE and got[101]["removed"][0]["kept_doc_id"] == 100


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .,!\n\té", max_size=90))
def test_units_by_definition(text):
    assert [(a, b, n) for a, b, n, _ in plain_units(text)] == [(a, b, n) for a, b, n, _ in substring_dedup.hashed_units(text)]


def test_verse_and_short_clauses(spark):
    rng = random.Random(12)
    verse = "\n".join(f"{rng.choice('abcdef')}{rng.randrange(99)} goes to {rng.randrange(99)}" for _ in range(14)) + "\n"
    commas = " ".join(f"one {rng.randrange(999)}, two {rng.randrange(999)}; three," for _ in range(14))
    rows = [(1, f"Its own start of the text.\n{verse}"), (2, f"{verse}And another end of it all."), (3, f"A line that begins with it, {commas} and more."), (4, f"Something else here; {commas} and less."), (None, f"{verse}")]
    got = sorted(((r["doc_id"], r["text"]) for r in substring_dedup.dedup_passages(frame(spark, rows)).collect()), key=repr)
    assert got == sorted(passages_left(rows), key=repr) and got != sorted(rows, key=repr)


def test_passages_odd_rows(spark):
    rows = [(None, PASSAGE), (1, PASSAGE), (1, PASSAGE), (2, None), (3, "")]
    got = sorted((repr(r["doc_id"]), r["text"]) for r in substring_dedup.dedup_passages(frame(spark, rows)).collect())
    assert got == [("1", ""), ("1", ""), ("2", ""), ("3", ""), ("None", PASSAGE)]
    assert substring_dedup.dedup_passages(frame(spark, []).limit(0)).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab .!?\n\t", max_size=80))
def test_units_cover_the_text(text):
    at = 0
    for a, b, n in substring_dedup.split_units(text):
        assert a == at and b > a and n == len(text[a:b].split())
        at = b
    assert at == len(text)
