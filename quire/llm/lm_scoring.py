"""Log probabilities of texts under a trigram model that is learnt from the corpus itself, held as sharded Elias-Fano tries.

Words are the stretches between white space, A-Z lower-cased, and an end token; a word is known by its 64-bit hash.  With
c(.) counts over the training documents, N all their tokens and V their distinct ones:

    p1(w)     = (c(w) + FLOOR) / (N + FLOOR (V + 1))                         V + 1: all words not learnt are one
    p2(w|v)   = c(vw)  / (c(v) + PAIR)    + PAIR   / (c(v) + PAIR) p1(w)     the first word of a text has p1,
    p3(w|uv)  = c(uvw) / (c(uv) + TRIPLE) + TRIPLE / (c(uv) + TRIPLE) p2(w)  the second p2

where what stands before each plus sign, and the weight after it, is read quantised from a trie (``ngram_trie``); codes round
down, so the probabilities of a context add up to 1 at most.

1. Texts are packed into blocks of about BLOCK_TOKENS tokens, as files of word numbers in the shared folder (named by
   the task attempt; a row names the attempt that counts) with one row of hashes and training counts for each block.
2. Hashes go to ranges; a range adds the counts up and gives each word an id, small for frequent words.  Counts and
   ids return to the blocks.
3. Each block asks once for each of its distinct trigrams, with its training count, at the shard of the first word.  Words
   that hold a HOT-th of all tokens are spread over shards by pair, pairs that hold a HOT-th by trigram; such pairs are
   found among those frequent in some block and then counted exactly, at most 4/3 HOT of them.
4. A shard adds up the counts, builds its trie, writes it, maps it, and answers every trigram asked for by searching
   successors relative to their context.  Blocks put the answers together and give each of their texts its sum.

Nothing of the model is broadcast but the hot pairs; no count is cut off, and tries grow with the corpus.  Rows of step 3
number at most the distinct trigrams of the blocks.  Distinct words must number below 2^32.

Null and empty texts are the end token alone.  Repeated rows and ids count and are scored each for itself; a null id belongs to the
training documents.  Without training documents every text has probability 1.  Extra columns are left alone.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count, groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Rows, deleted, id_and_text, written
from quire.llm.ngram_trie import ABSENT, NGramTrie, Quantiser
from quire.llm.sstable import filesystem
from quire.storage import shared_folder

BLOCK_TOKENS, SHARD_TOKENS, RANGE_WORDS = 1_000_000, 1_500_000, 1_500_000
HOT = 1024
FLOOR, PAIR, TRIPLE = 0.6, 400.0, 2.0
END = b""
LOW = np.uint64(0xFFFFFFFF)
HIGH = np.uint64(32)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, byte plane by byte plane, compressed."""
    import zstandard

    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.str[1]), a.itemsize, len(a)))], np.int64)
    return zstandard.compress(head.tobytes() + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays), 3)


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.decompress(data)
    (n,) = np.frombuffer(raw, np.int64, 1)
    head, at, out = np.frombuffer(raw, np.int64, 3 * n, 8).tolist(), 8 + 24 * int(n), []
    for kind, width, size in zip(head[::3], head[1::3], head[2::3], strict=True):
        planes = np.frombuffer(raw, np.uint8, width * size, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(f"<{chr(kind)}{width}").reshape(size))
        at += width * size
    return out


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that agree in their first columns."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, own in groupby(rows, lambda row: row[:keys]):
        yield key, [row[keys:] for row in own]


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only


class Block:
    """Documents as numbers of words, in the order of their hashes."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, held: np.ndarray, size: np.ndarray, words: np.ndarray):
        self.ids, self.known, self.held, self.size, self.words = ids, known, held.astype(bool), size, words
        self.end = np.cumsum(size)

    def write(self, path: str) -> None:
        fs, path = filesystem(path)
        with fs.open_output_stream(path) as out:
            out.write(pack(self.ids, self.known, self.held.astype(np.uint8), self.size, self.words))

    @classmethod
    def read(cls, path: str) -> Block:
        fs, path = filesystem(path)
        with fs.open_input_file(path) as f:
            return cls(*unpack(f.read()))

    def pairs(self) -> np.ndarray:
        """The places of words that have a word before them in their document."""
        inside = np.ones(len(self.words), bool)
        inside[self.end - self.size] = False
        return np.flatnonzero(inside)

    def training(self) -> np.ndarray:
        return np.repeat(~self.held, self.size)


def pack_documents(docs: DataFrame, folder: str, block_tokens: int) -> DataFrame:
    """A row for each block of (doc_id, text, held): its file's name, its tokens and those to learn from, its words' hashes and counts, its most frequent pairs."""
    schema = pa.schema([("block", pa.string()), ("tokens", pa.int64()), ("learnt", pa.int64()), ("words", pa.int64()), ("payload", pa.binary()), *((c, pa.list_(pa.int64())) for c in ("first", "second", "times"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        task, made = TaskContext.get(), count()
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        number: dict[bytes, int] = defaultdict(count().__next__)
        end, lists, keys, held, n = number[END], [], [], [], 0

        def flush():
            hashes = np.fromiter(map(xxh3_64_intdigest, number), np.uint64, len(number))
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            block = Block(np.array([k or 0 for k in keys], np.int64), np.array([k is not None for k in keys], np.uint8), np.array(held, np.uint8), np.array([len(x) for x in lists], np.uint32), place[np.concatenate(lists)])
            name = f"{task.partitionId()}-{task.taskAttemptId()}-{next(made)}"
            block.write(f"{folder}/{name}")
            learnt = block.training()
            times = np.bincount(block.words[learnt], minlength=len(order)).astype(np.uint32)
            at = block.pairs()
            at = at[learnt[at]]
            pair, many = np.unique(block.words[at - 1].astype(np.uint64) << HIGH | block.words[at], return_counts=True)
            often = many > n / (4 * HOT)
            pair, many, signed = pair[often], many[often], hashes[order].view(np.int64)
            return pa.record_batch([[name], [n], [int(learnt.sum())], [len(order)], [pack(hashes[order], times)], [signed[(pair >> HIGH).astype(np.int64)]], [signed[(pair & LOW).astype(np.int64)]], [many]], schema=schema)

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for key, text, out in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True):
                    found = tokens(text)
                    lists.append(np.append(np.fromiter(map(number.__getitem__, found), np.uint32, len(found)), np.uint32(end)))
                    keys.append(key)
                    held.append(out)
                    n += len(found) + 1
                    if n >= block_tokens:
                        yield flush()
                        number = defaultdict(count().__next__)
                        end, lists, keys, held, n = number[END], [], [], [], 0
        if keys:
            yield flush()

    return docs.mapInArrow(run, "block string, tokens long, learnt long, words long, payload binary, first array<long>, second array<long>, times array<long>")


def count_words(packed: DataFrame, ranges: int) -> DataFrame:
    """For each block and range of hashes the words' ids and training counts (part 0 on, in order of hash); with block null a range's number of words learnt."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes, times = unpack(payload)
                edge = np.searchsorted(hashes, np.array([-(-(k << 64) // ranges) for k in range(ranges)], np.uint64)).tolist() + [len(hashes)]
                rows = [(k, name, pack(hashes[a:b], times[a:b])) for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if a < b]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.binary()), strict=True)], ["part", "block", "payload"])

    schema = pa.schema([("part", pa.int32()), ("block", pa.string()), ("payload", pa.binary()), ("learnt", pa.int64())])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for (part,), rows in grouped(batches, 1):
            hashes, times = (np.concatenate(x) for x in zip(*(unpack(data) for _, data in rows), strict=True))
            size = [len(unpack(data)[0]) for _, data in rows]
            words, inverse = np.unique(hashes, return_inverse=True)
            total = np.zeros(len(words), np.int64)
            np.add.at(total, inverse, times)
            ids = np.empty(len(words), np.int64)
            ids[np.argsort(-total, kind="stable")] = np.arange(len(words)) * ranges + part + 1
            ids[total == 0] = 0
            if ids.max(initial=0) >> 32:
                raise ValueError("more distinct words than ids")
            at = 0
            for (name, _), n in zip(rows, size, strict=True):
                own = inverse[at : at + n]
                data = pack(ids[own].astype(np.uint32), total[own])
                yield from out.add((part, name, data, 0), len(data) + 64)
                at += n
            yield from out.add((part, None, None, int((total > 0).sum())))
        yield out.flush()

    asked = packed.select("block", "payload").mapInArrow(ask, "part int, block string, payload binary")
    return asked.repartition(ranges, "part").sortWithinPartitions("part", "block").mapInArrow(answer, "part int, block string, payload binary, learnt long")


def hot_pairs(packed: DataFrame, folder: str, learnt: int) -> list[tuple[int, int, int]]:
    """(hash, hash, training count) of the pairs that hold a HOT-th of all tokens, and of some others; at most 4/3 HOT.

    A block names its pairs above a quarter of that share, so a hot pair lacks at most a quarter of its count in the sums of what is named."""
    pair = F.explode(F.arrays_zip("first", "second", "times")).alias("p")
    sums = packed.select(pair).groupBy("p.first", "p.second").agg(F.sum("p.times").alias("n")).filter(F.col("n") >= 0.75 * learnt / HOT)
    chosen = [(r["first"], r["second"]) for r in sums.collect()]
    if not chosen:
        return []

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block, hashes = Block.read(f"{folder}/{name}"), unpack(payload)[0]
                at = block.pairs()
                at = at[block.training()[at]]
                key = np.sort(block.words[at - 1].astype(np.uint64) << HIGH | block.words[at])
                both = np.array(chosen, np.int64).view(np.uint64).reshape(-1, 2)
                place = np.minimum(np.searchsorted(hashes, both), len(hashes) - 1)
                here = (hashes[place] == both).all(axis=1)
                sought = place[:, 0].astype(np.uint64) << HIGH | place[:, 1].astype(np.uint64)
                n = np.where(here, np.searchsorted(key, sought, "right") - np.searchsorted(key, sought), 0)
                yield pa.record_batch([pa.array(range(len(chosen)), pa.int32()), pa.array(n, pa.int64())], ["pair", "n"])

    found = packed.select("block", "payload").mapInArrow(times, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return [(*chosen[r["pair"]], r["n"]) for r in found]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(31))


class Asked:
    """The distinct trigrams of a block in the order in which it asks for them, and where they stand."""

    def __init__(self, block: Block, ids: np.ndarray, counts: np.ndarray, learnt: int, shards: int, hot: dict[int, int]):
        words = ids[block.words]
        at = block.pairs()
        at = at[(words[at - 1] > 0) & (words[at] > 0)]
        self.at = at  # the second words of the pairs asked for
        last = np.zeros(len(words), bool)
        last[block.end - 1] = True
        following = np.where(last[at], 0, words[np.minimum(at + 1, len(words) - 1)])
        pair = words[at - 1].astype(np.uint64) << HIGH | words[at]
        pairs, which = np.unique(pair, return_inverse=True)
        triple, self.which = np.unique(which.astype(np.uint64) << HIGH | following, return_inverse=True)
        self.pair, self.third = (triple >> HIGH).astype(np.int64), (triple & LOW).astype(np.uint32)
        self.pair_of, self.pairs = which, pairs
        self.times = np.zeros(len(triple), np.uint32)
        np.add.at(self.times, self.which, block.training()[at].astype(np.uint32))
        first = (pairs >> HIGH).astype(np.uint32)
        total = np.zeros(len(pairs), np.int64)  # of the first word of each pair
        total[which] = counts[block.words[at - 1]]
        self.first_total = total
        by = first.astype(np.uint64)
        by = np.where(total * HOT >= learnt, mixed(pairs), by)
        by = mixed(by)[self.pair]
        if hot:
            often = np.isin(pairs, np.fromiter(hot, np.uint64, len(hot)))[self.pair]
            by[often] = mixed(by[often] ^ mixed(self.third[often]))
        shard = (by >> np.uint64(8)) % np.uint64(shards)
        self.order = np.argsort(shard, kind="stable")
        self.edge = np.searchsorted(shard[self.order], np.arange(shards + 1, dtype=np.uint64))

    def messages(self) -> Iterator[tuple[int, bytes]]:
        for shard, (a, b) in enumerate(zip(self.edge[:-1], self.edge[1:], strict=True)):
            if a < b:
                own = self.order[a:b]
                begin = np.flatnonzero(np.append(True, np.diff(self.pair[own]) != 0))
                pairs = self.pair[own[begin]]
                first = (self.pairs[pairs] >> HIGH).astype(np.uint32)
                heads = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
                sizes = [np.diff(np.append(x, n)).astype(np.uint32) for x, n in ((heads, len(pairs)), (begin, b - a))]
                yield shard, pack(first[heads], self.first_total[pairs[heads]], sizes[0], (self.pairs[pairs] & LOW).astype(np.uint32), sizes[1], self.third[own], self.times[own])

    def answers(self, replies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chance of the second word of each pair, what the pair leaves to shorter contexts, chance of each trigram) from the shards' replies in order."""
        chance2, left, chance3 = np.zeros(len(self.pairs)), np.ones(len(self.pairs)), np.zeros(len(self.pair))
        used = [(a, b) for a, b in zip(self.edge[:-1], self.edge[1:], strict=True) if a < b]
        for (a, b), reply in zip(used, replies, strict=True):
            own = self.order[a:b]
            begin = np.flatnonzero(np.append(True, np.diff(self.pair[own]) != 0))
            steps, two, rest, three = unpack(reply)
            values = [Quantiser(x).values for x in steps.tolist()]
            pairs = self.pair[own[begin]]
            chance2[pairs], chance3[own] = values[0][two], values[2][three]
            left[pairs] = np.where(rest == ABSENT, 1.0, values[1][rest])
        return chance2, left, chance3


def ask_trigrams(known: DataFrame, folder: str, learnt: int, shards: int, hot: list[tuple[int, int, int]]) -> DataFrame:
    """(shard, block, payload): each block's distinct trigrams with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(pa.schema([("shard", pa.int32()), ("block", pa.string()), ("payload", pa.binary())]))
        for (name,), rows in grouped(batches, 1):
            asked, _, _ = _asked(folder, name, [data for _, data in rows], learnt, shards, hot)
            for shard, data in asked.messages():
                yield from out.add((shard, name, data), len(data) + 64)
        yield out.flush()

    own = known.filter("block is not null").select("block", "part", "payload")
    return own.repartition("block").sortWithinPartitions("block", "part").mapInArrow(run, "shard int, block string, payload binary")


def _asked(folder: str, name: str, payloads: list[bytes], learnt: int, shards: int, hot: list) -> tuple[Asked, Block, tuple]:
    block = Block.read(f"{folder}/{name}")
    ids, counts = (np.concatenate(x) for x in zip(*map(unpack, payloads), strict=True))
    return Asked(block, ids, counts, learnt, shards, _hot_ids(hot)), block, (ids, counts)


def _hot_ids(hot: list[tuple[int, int, int]]) -> dict[int, int]:
    return {a << 32 | b: n for a, b, n in hot}


def answer_trigrams(asked: DataFrame, folder: str, shards: int, hot: list[tuple[int, int, int]], keep: bool) -> DataFrame:
    """(block, part, payload): each shard's trie answers what blocks asked it, and is deleted then unless it is to be kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        attempt, out, fixed = TaskContext.get().taskAttemptId(), Rows(pa.schema([("block", pa.string()), ("part", pa.int32()), ("payload", pa.binary())])), _hot_ids(hot)
        for (shard,), rows in grouped(batches, 1):
            file = f"{path}/shard-{shard}-{attempt}"
            for name, data in answers([(name, unpack(data)) for name, data in rows], fixed, fs, file):
                yield from out.add((name, shard, data), len(data) + 64)
            if not keep:
                fs.delete_file(file)
        yield out.flush()

    return asked.repartition(shards, "shard").sortWithinPartitions("shard", "block").mapInArrow(run, "block string, part int, payload binary")


def answers(messages: list[tuple[str, list[np.ndarray]]], fixed: dict[int, int], fs, path: str) -> Iterator[tuple[str, bytes]]:
    """Builds, writes and maps the trie of one shard, and answers its messages."""
    size2, size3 = [len(m[3]) for _, m in messages], [len(m[5]) for _, m in messages]
    first, total, heads, second, repeats, third, times = (np.concatenate(x) for x in zip(*(m for _, m in messages), strict=True))
    first, total = np.repeat(first, heads), np.repeat(total, heads)
    pairs, pair_at, pair_of = np.unique(first.astype(np.uint64) << HIGH | second, return_index=True, return_inverse=True)
    total = total[pair_at].astype(np.float64)
    triple, triple_of = np.unique(np.repeat(pair_of.astype(np.uint64), repeats) << HIGH | third, return_inverse=True)
    seen = np.zeros(len(triple), np.int64)
    np.add.at(seen, triple_of, times)
    pair, third = (triple >> HIGH).astype(np.int64), (triple & LOW).astype(np.uint32)
    held = np.zeros(len(pairs), np.int64)  # of a pair
    np.add.at(held, pair, seen)
    if fixed:
        place = np.minimum(np.searchsorted(pairs, np.fromiter(fixed, np.uint64, len(fixed))), len(pairs) - 1)
        for at, (key, n) in zip(place.tolist(), fixed.items(), strict=True):
            if int(pairs[at]) == key:
                held[at] = n
    learnt = held > 0
    real = (seen > 0) & (third > 0)
    rank = np.cumsum(learnt) - 1
    firsts, seconds = (pairs >> HIGH).astype(np.uint32), (pairs & LOW).astype(np.uint32)
    NGramTrie.build(
        firsts[learnt],
        seconds[learnt],
        held[learnt] / (total[learnt] + PAIR),
        TRIPLE / (held[learnt] + TRIPLE),
        rank[pair[real]],
        third[real],
        seen[real] / (held[pair[real]] + TRIPLE),
    ).write(fs, path)
    trie = NGramTrie.open(fs, path)
    at2 = trie.pairs(firsts, seconds)
    at3 = np.where(third > 0, trie.thirds(at2[pair], third), -1)

    def codes(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.append(values, np.uint8(ABSENT))[at]  # place -1 is the last

    chance2, left, chance3 = codes(trie.chance2, at2), codes(trie.left, at2), codes(trie.chance3, at3)
    a2 = a3 = 0
    for (name, _), n2, n3 in zip(messages, size2, size3, strict=True):
        own2, own3 = pair_of[a2 : a2 + n2], triple_of[a3 : a3 + n3]
        yield name, pack(trie.steps, chance2[own2], left[own2], chance3[own3])
        a2, a3 = a2 + n2, a3 + n3


def sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.cumsum(size) - size) if len(size) else np.zeros(0)


def score_blocks(known: DataFrame, replies: DataFrame, folder: str, learnt: int, distinct: int, shards: int, hot: list[tuple[int, int, int]]) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name,), rows in grouped(batches, 1):
            asked, block, (_, counts) = _asked(folder, name, [data for kind, _, data in rows if kind == 0], learnt, shards, hot)
            chance2, left, chance3 = asked.answers([data for kind, _, data in rows if kind == 1])
            times = counts[block.words].astype(np.float64)
            base = np.log10((times + 1) / (learnt + distinct + 1))
            p = (times + FLOOR) / (learnt + FLOOR * (distinct + 1))
            at = block.pairs()
            two = np.zeros(len(p))
            two[asked.at] = chance2[asked.pair_of]
            p[at] = two[at] + PAIR / (times[at - 1] + PAIR) * p[at]
            last = np.zeros(len(p), bool)
            last[block.end - 1] = True
            on = ~last[asked.at]  # pairs that another word follows
            after = asked.at[on] + 1
            p[after] = chance3[asked.which[on]] + left[asked.pair_of[on]] * p[after]
            n = block.size.astype(np.int64)
            known_ids = pa.array(block.ids, pa.int64(), mask=block.known == 0)
            out = [known_ids, block.held, n, sums((times > 0).astype(np.int64), n), np.full(len(n), learnt), sums(base, n), sums(np.log10(p), n)]
            yield pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    both = known.filter("block is not null").select("block", F.lit(0).alias("kind"), "part", "payload").unionByName(replies.select("block", F.lit(1).alias("kind"), "part", "payload"))
    columns = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return both.repartition("block").sortWithinPartitions("block", "kind", "part").mapInArrow(run, columns)


def score_documents(docs: DataFrame, held: str, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, tries: str | None = None) -> DataFrame:
    """Per row: doc_id long, held_out boolean (``held``, an SQL condition on doc_id), n_tokens, n_known, train_tokens long, base_score, score double.

    ``tries``: a folder in which the shards' files stay; a file of a lost task's attempt may stay beside them."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "lm-blocks")
    own = id_and_text(docs, id_col, text_col).withColumn("held", F.coalesce(F.expr(held), F.lit(False)))
    packed = written(pack_documents(own, folder, block_tokens), "lm-words")
    all_tokens, learnt, words = (x or 0 for x in packed.agg(F.sum("tokens"), F.sum("learnt"), F.sum("words")).first())
    known = written(count_words(packed, max(1, -(-words // RANGE_WORDS))), "lm-counts")
    distinct = known.agg(F.sum("learnt")).first()[0] or 0
    shards = max(1, -(-all_tokens // shard_tokens))
    hot = hot_ids(packed, known, hot_pairs(packed, folder, learnt))
    deleted(packed)  # what follows reads the blocks and the counts
    asked = ask_trigrams(known, folder, learnt, shards, hot)
    return score_blocks(known, answer_trigrams(asked, tries or shared_folder(spark, "lm-tries"), shards, hot, tries is not None), folder, learnt, distinct, shards, hot)


def hot_ids(packed: DataFrame, known: DataFrame, hot: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The hot pairs by their words' ids."""
    if not hot:
        return []
    sought = sorted({h for a, b, _ in hot for h in (a, b)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_,), rows in grouped(batches, 1):
            hashes = np.concatenate([unpack(data)[0] for kind, _, data in rows if kind == 0]).view(np.int64)
            ids = np.concatenate([unpack(data)[0] for kind, _, data in rows if kind == 1])
            here = np.isin(hashes, sought)
            yield pa.record_batch([pa.array(hashes[here], pa.int64()), pa.array(ids[here], pa.int64())], ["hash", "id"])

    both = packed.select("block", F.lit(0).alias("kind"), F.lit(0).alias("part"), "payload").unionByName(known.filter("block is not null").select("block", F.lit(1).alias("kind"), "part", "payload"))
    found = both.repartition("block").sortWithinPartitions("block", "kind", "part").mapInArrow(run, "hash long, id long").distinct().collect()  # two for each hot pair at most
    number = {r["hash"]: r["id"] for r in found}
    return [(number[a], number[b], n) for a, b, n in hot]


def op12_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Every document's log probability, learnt from six sevenths of them, beside that of smoothed word counts."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), "pmod(crc32(cast(cast(doc_id as string) as binary)), 7) = 2")
