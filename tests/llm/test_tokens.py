"""Ids against the tokenizer libraries; packing and tables against brute force."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import byte_bpe, packing, sstable
from quire.llm.byte_bpe import TokenBytes
from quire.llm.library_tokens import library_encoder, rank_encoder, vocabulary

ALPHABET = "ab'stlrevmdLL  \n\t\r.!éÉ12½_İ’漢 ß\x85\x1c<|>"
ODD = [None, "", " ", "\n\n  x", "'s's 'll", "it's we'RE", "<|endoftext|> a", "a" * 3000, "ab" * 2000, "漢字" * 300, "éab" * 200, "x  y   z ", "日本 語's", "İstanbul", "́e", "0123456789 12,345", "𝒳 emoji 🎉🎉"]


def same(encoder, expected, texts):
    return [list(map(int, x)) for x in encoder.encode(texts)] == [expected(t or "") for t in texts]


@pytest.mark.parametrize(("name", "mode"), [("byte_bpe_50k.json", "gpt"), ("word_bpe_49k.json", "clip")])
def test_library_ids(name, mode):
    tokenizer = Tokenizer.from_file(vocabulary(name))
    tokenizer.encode_special_tokens = True
    rng = random.Random(5)
    texts = [*ODD, *("".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(3000))]
    assert same(library_encoder(vocabulary(name), mode), lambda t: tokenizer.encode(t, add_special_tokens=False).ids, texts)


def tiktoken_of(name):
    with open(P.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_rank_ids_and_decoding():
    own, (encoder, tokens) = tiktoken_of("byte_bpe_multi_50k.tiktoken"), rank_encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    rng = random.Random(6)
    texts = [*ODD, *("".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(3000))]
    assert same(encoder, own.encode_ordinary, texts)
    table = TokenBytes(tokens)
    assert [table.decode(ids) for ids in encoder.encode(texts)] == [(t or "").encode() for t in texts]


def twins(n):
    """Two words of n letters that any polynomial hash modulo 2^64 confuses from n = 1024 on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096, 8192])
def test_words_of_one_hash(n):
    one, two = twins(n)
    for texts in ([one, two, one], [f"{two} {one} {two}"]):
        for name, mode in (("byte_bpe_50k.json", "gpt"), ("word_bpe_49k.json", "clip")):
            tokenizer = Tokenizer.from_file(vocabulary(name))
            encoder = library_encoder(vocabulary(name), mode)
            for block in (texts, *([t] for t in texts)):  # in one block, then one after another
                assert same(encoder, lambda t, k=tokenizer: k.encode(t, add_special_tokens=False).ids, block)
        own, (encoder, _) = tiktoken_of("byte_bpe_multi_50k.tiktoken"), rank_encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
        for block in (texts, *([t] for t in texts)):
            assert same(encoder, own.encode_ordinary, block)


def test_cache_that_starts_again(monkeypatch):
    from quire.llm import segment

    monkeypatch.setattr(segment, "CACHE_PIECES", 5)
    monkeypatch.setattr(segment, "BLOCK_CHARS", 40)
    encoder, _ = rank_encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    encoder.cache.clear()
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(12)) for _ in range(60)]
    assert same(encoder, tiktoken_of("byte_bpe_multi_50k.tiktoken").encode_ordinary, texts)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(max_size=50), max_size=10))
def test_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    encoder, tokens = rank_encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    table = TokenBytes(tokens)
    assert [table.decode(ids).decode() for ids in encoder.encode(texts)] == texts


SCHEMA = "doc_id long, text string, ids string, task int, carry int"


def odd_documents(spark):
    rows = [(i, t, "clash", 1, 2) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[3], (None, "no id", None, None, None), (5, "same id", "x", 1, 2)], SCHEMA).repartition(3)


def test_op7(spark, sf):
    own = tiktoken_of("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    got = byte_bpe.op7_byte_bpe(spark, sf).toPandas().set_index("doc_id")
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        ids = own.encode_ordinary(text)
        assert tuple(got.loc[i]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    odd = byte_bpe.encode_documents(odd_documents(spark), vocabulary("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert byte_bpe.encode_documents(odd_documents(spark).limit(0), vocabulary("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0
    assert len(odd) == len(ODD) + 3 and {bytes(r["decoded"]).decode() for r in odd} == {*((t or "") for t in ODD), "no id", "same id"}


def packed(rows, capacity=1024):
    """Checks a packing; returns its sequences."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in by_sequence.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return by_doc, len(by_sequence)


def test_op2(spark, sf):
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    by_doc, sequences = packed(packing.op2_best_fit_packing(spark, sf).collect())
    total = 0
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and sum(r["length"] for r in pieces) == len(ids)
        assert all(r["length"] == 1024 for r in pieces[1:]) and pieces[0]["start"] == 0
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in pieces)
        total += len(ids)
    assert sequences <= 1.02 * -(-total // 1024) + 1
    odd = odd_documents(spark)
    assert len(packing.pack_documents(odd, vocabulary("byte_bpe_50k.json")).filter("piece = 0").collect()) == odd.count()
    assert packing.pack_documents(odd.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=120))
def test_plan_is_best_fit(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.plan_best_fit(counts, 32)
    assert plan.sequences == best_fit(lengths, 32)
    used = {}
    for n, c in counts.items():
        for s, o in zip(*plan.place(n, np.arange(c)), strict=True):
            used.setdefault(int(s), []).append((int(o), n))
    for slots in used.values():
        at = 0
        for offset, n in sorted(slots):
            assert offset == at
            at += n
        assert at <= 32
    assert len(used) == plan.sequences


def test_op8(spark, sf):
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().sort_values("doc_id")
    got = {r["doc_id"]: r for r in sstable.op8_sorted_tables(spark, sf).collect()}
    at = 0
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_tables(spark, tmp_path):
    odd = odd_documents(spark)
    manifest = sstable.write_tables(odd, vocabulary("word_bpe_49k.json"), f"file://{tmp_path}/t", docs_per_shard=4)
    assert manifest.count() > 2
    rows = sstable.read_tables(manifest).orderBy("start").collect()
    keys = [-(1 << 63) if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert keys == sorted(keys) and len(rows) == odd.count()
    tables = [sstable.Table(r["path"]) for r in sorted(manifest.collect(), key=lambda r: r["shard"])]
    for r in rows:
        hit = next(x for t in tables if (x := t.get(r["doc_id"])) is not None)
        assert r["doc_id"] in (3, 5) or hit.tobytes() == bytes(r["ids"])
    assert all(t.get(10**9) is None for t in tables)
    empty = sstable.write_tables(odd.limit(0), vocabulary("word_bpe_49k.json"), f"file://{tmp_path}/e")
    assert sstable.read_tables(empty).count() == 0


def test_rows_of_one_id_are_many_shards(spark, tmp_path):
    rows = [(7, f"text number {i} of one id") for i in range(200)] + [(1, "first"), (9, "last")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    manifest = sstable.write_tables(docs, vocabulary("word_bpe_49k.json"), f"file://{tmp_path}/t", docs_per_shard=20)
    assert max(r["docs"] for r in manifest.collect()) < 100
    back = sstable.read_tables(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in back] == [1, *[7] * 200, 9]
    at = 0
    for r in back:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    assert sorted(bytes(r["ids"]) for r in back) == sorted(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for _, t in rows)


@settings(max_examples=20, deadline=None)
@given(st.dictionaries(st.integers(-(1 << 63), (1 << 63) - 1), st.lists(st.integers(0, 1 << 31), max_size=5), max_size=60))
def test_table_round_trip(entries):
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        w = sstable.Writer(f"{d}/x.sst")
        for k in sorted(entries):
            w.add(sstable.key_of(k), sstable.pack_ids(np.array(entries[k], np.uint32)))
        w.close()
        t = sstable.Table(f"{d}/x.sst")
        assert [(k, v.tolist()) for k, v in t] == [(k, entries[k]) for k in sorted(entries)]
        assert all(t.get(k).tolist() == v for k, v in entries.items())
        assert t.get(12345) is None or 12345 in entries
