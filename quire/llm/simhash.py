"""Near-duplicates by SimHash, found with the generalised pigeonhole principle.

1. A text's fingerprint: words split at ASCII white space, A-Z lower-cased; XXH64 (seed 42) of every
   shingle, repeats included; a bit is 1 if over half of the hashes have it.
2. Distinct fingerprints are the classes.  On a bounded sample of them the 64 bits are grouped into
   partitions of correlated bits, and dynamic programming shares the distance out to the partitions in
   unequal thresholds, at the least estimated cost of candidates and signatures.  If the thresholds t
   of all partitions have sum(t + 1) = distance + 1, two fingerprints within the distance are within t
   in at least one partition.  The sample decides the cost only, never what is found.
3. A fingerprint's signatures in a partition are its bits there, with any up to t set bits cleared: two
   values within t meet where both have lost the bits in which they differ.  Signatures travel packed,
   by the task that the sample's counts deal them to.  Rows with one signature, a bucket, are verified in whole
   arrays; each task gives a spanning forest of its links, not its pairs.  Buckets of more than BUCKET
   fingerprints are dealt out as pairs of blocks, so none lands whole in a task.
4. Components of the links, then each document gets its class's; hot classes, a bounded number, are joined by
   broadcast, the others by a shuffle.

With ``least`` a link needs a similarity of the shingle sets (shared / all), and classes are distinct sets.  They
have a second fingerprint, of mixed hashes.  Candidates are the pairs within the distance by either fingerprint and
within SECOND bits by the other; ``exact`` verifies them on whole sets.  Similar texts that are further apart by
both are missed.

Null and empty texts have fingerprint zero, linked like any other.  Repeated rows share a class.  A null
id takes part; a class with null ids only has a null component.  An empty table gives no rows.  Extra
columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import id_and_text, written
from quire.llm.components import connected_components
from quire.llm.exact import exact_links
from quire.llm.segment import spread

SAMPLE, PLAN_SAMPLE = 16_000, 2_000
BUCKET = 32_768
#: A class is hot with over a HOT-th of all rows or over HOT_ROWS; so the hot ones are under HOT, or one for HOT_ROWS rows.
HOT, HOT_ROWS = 1_000, 2_000_000
#: Signatures that a task verifies at most (fewer, where there are many comparisons), and that a task holds before it sends them.
TASK_ROWS, SEND_ROWS = 1_000_000, 1_000_000
#: Values compared at once, about.
COMPARE = 1 << 16
#: Most bits in which second fingerprints of similar texts differ: at a similarity of 0.8 one pair in 5,000 has more.
SECOND = 20
#: Shingles whose bits are counted at once.
COUNT_SHINGLES = 40_000


def shingle_hashes(text: str | None, size: int, seed: int) -> list[bytes]:
    """XXH64 of every shingle, as eight big-endian bytes."""
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined, n = b" ".join(words), max(1, len(words) - size + 1) if words else 0
    if n <= 1:
        return [xxh64_digest(joined, seed)] * n
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.append(0, ends[:-1] + 1)
    cuts = map(slice, begins[:n].tolist(), ends[size - 1 :].tolist())
    return list(map(xxh64_digest, map(joined.__getitem__, cuts), repeat(seed, n)))


#: For each byte its eight bits, highest first, as eight bytes of one number.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view("<u8").ravel()
#: Hashes whose bits are added up in such bytes.
_LANE_ROWS = 255


def majorities(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each run of hashes the bits that over half of them have."""
    out = np.zeros(len(lengths), np.uint64)
    if len(hashes):
        has = np.flatnonzero(lengths)
        n = lengths[has]
        parts = -(-n // _LANE_ROWS)
        cuts = np.repeat(np.cumsum(n) - n, parts) + spread(np.zeros(len(n), np.int64), parts) * _LANE_ROWS
        lanes = _LANES[hashes.astype(">u8").view(np.uint8).reshape(-1, 8)]
        some = np.add.reduceat(lanes, cuts, axis=0).astype("<u8").view(np.uint8).reshape(-1, 64)
        ones = np.add.reduceat(some, np.cumsum(parts) - parts, axis=0, dtype=np.int64)
        out[has] = np.packbits(2 * ones > n[:, None], axis=1).view(">u8").ravel()
    return out


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles."""
    with np.errstate(over="ignore"):
        x = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _runs(texts: Iterator[str | None], size: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of some texts one after another, hashes per text)."""
    digests: list[bytes] = []
    lengths: list[int] = []
    for text in texts:
        own = shingle_hashes(text, size, seed)
        digests += own
        lengths.append(len(own))
        if len(digests) >= COUNT_SHINGLES:
            yield np.frombuffer(b"".join(digests), ">u8").astype(np.uint64), np.array(lengths, np.int64)
            digests, lengths = [], []
    yield np.frombuffer(b"".join(digests), ">u8").astype(np.uint64), np.array(lengths, np.int64)


def fingerprints(texts: Iterator[str | None], size: int = 4, seed: int = 42) -> Iterator[int]:
    """The fingerprint of each text, as an unsigned 64-bit number."""
    for hashes, lengths in _runs(texts, size, seed):
        yield from majorities(hashes, lengths).tolist()


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, seed: int = 42) -> DataFrame:
    """Per row: doc_id long, fingerprint long (the 64 bits, as a signed number)."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t for i in range(0, batch.num_rows, 512) for t in batch.column(1).slice(i, 512).to_pylist())
            values = np.fromiter(fingerprints(texts, size, seed), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], schema=schema)

    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, fingerprint long")


def shingle_prints(docs: DataFrame, id_col: str, text_col: str, size: int, seed: int) -> DataFrame:
    """Per row: doc_id, node (a hash of its set of shingles), fingerprint, second, size (of the set)."""
    from xxhash import xxh3_64_intdigest

    names = ["doc_id", "node", "fingerprint", "second", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t for i in range(0, batch.num_rows, 512) for t in batch.column(1).slice(i, 512).to_pylist())
            node, sizes, first, second = [], [], [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for hashes, lengths in _runs(texts, size, seed):
                first.append(majorities(hashes, lengths))
                second.append(majorities(mixed(hashes), lengths))
                for own in np.split(hashes, np.cumsum(lengths)[:-1]) if len(lengths) else ():
                    own = np.unique(own)
                    node.append(xxh3_64_intdigest(own.tobytes()))
                    sizes.append(len(own))
            prints = (np.concatenate(x).view(np.int64) for x in (first, second))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(node, np.uint64).view(np.int64)), *map(pa.array, prints), pa.array(sizes, pa.int32())], names=names)

    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, node long, fingerprint long, second long, size int")


def _bits(values: np.ndarray) -> np.ndarray:
    """One row of 64 bits, lowest first, for each value."""
    return (values[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of about equal width: each starts at a bit left over and takes the bits most correlated with those it has."""
    x = _bits(sample).astype(np.float64)
    x -= x.mean(axis=0)
    scale = np.sqrt((x * x).sum(axis=0))
    near = np.abs(x.T @ x) / np.maximum(np.outer(scale, scale), 1e-9)
    left, groups = list(range(64)), []
    for p in range(parts):
        width = len(left) // (parts - p)
        group = [left.pop(0)]
        while len(group) < width:
            best = max(left, key=lambda b: (near[b, group].mean(), -b))
            left.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def plan_partitions(sample: np.ndarray, distance: int, total: int, choices: tuple[int, ...] = (4, 5, 6)) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of the least estimated cost; a threshold of -1 leaves its partition out.  A partition has 16 bits at most, so its buckets can be numbered."""
    signature_cost, best = 100.0, None  # in comparisons of two fingerprints
    bits = _bits(sample)
    half = len(bits) // 2
    for parts in choices:
        groups = group_bits(sample, parts) if len(sample) else [list(range(p * 64 // parts, (p + 1) * 64 // parts)) for p in range(parts)]
        cost = []
        for group in groups:
            apart = (bits[:half, None, group] != bits[None, half : 2 * half, group]).sum(axis=2) if half else np.zeros((1, 1))
            row = [0.0]
            for t in range(distance + 1):
                # pairs that meet may be t apart on either side
                share = max((apart <= 2 * t).mean() / (1 if t == 0 else 2), 1 / 2.0 ** len(group))
                signatures = sum(comb(len(group) // 2, k) for k in range(t + 1))
                row.append(total * signatures * signature_cost + total * float(total) * share / 2)
            cost.append(row)
        # cheapest[s]: slots s = sum(t + 1) used so far
        cheapest: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in cost:
            step: dict[int, tuple[float, list[int]]] = {}
            for s, (c, chosen) in cheapest.items():
                for k in range(min(distance + 1 - s, distance + 1) + 1):
                    if s + k not in step or c + row[k] < step[s + k][0]:
                        step[s + k] = (c + row[k], [*chosen, k - 1])
            cheapest = step
        c, chosen = cheapest[distance + 1]
        if best is None or c < best[0]:
            best = (c, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0])
    return best[1]


def signatures(values: np.ndarray, bits: list[int], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into values, signature): the bits of a partition, with up to ``threshold`` of the set ones cleared."""
    mask = np.uint64(sum(1 << b for b in bits))
    own = values & mask
    index, out = [np.arange(len(values))], [own]
    for k in range(1, threshold + 1):
        for some in combinations(bits, k):
            clear = np.uint64(sum(1 << b for b in some))
            has = np.flatnonzero((own & clear) == clear)
            index.append(has)
            out.append(own[has] & ~clear)
    return np.concatenate(index), np.concatenate(out)


class Dealing:
    """Numbers for the buckets of a plan, cells (buckets, or pairs of blocks of a large one), and the task of each cell."""

    def __init__(self, plan: list[tuple[list[int], int]], sample: np.ndarray, total: int, bucket: int):
        self.plan = plan
        self.base = np.cumsum([0, *(1 << len(bits) for bits, _ in plan)])
        held = np.zeros(self.base[-1])
        for part in range(len(plan)):
            _, number = self.signed(part, sample)
            held += np.bincount(number, minlength=len(held))
            # what the sample hasn't seen counts as a share of the partition's mean
            own = slice(self.base[part], self.base[part + 1])
            held[own] = np.maximum(held[own], 0.25 * len(number) / max(1, len(held[own])))
        held *= total / max(1, len(sample))
        self.blocks = np.maximum(1, np.where(held > bucket, np.ceil(held / (bucket // 2)), 1)).astype(np.int64)
        cells = self.blocks * (self.blocks + 1) // 2
        self.first = np.cumsum(cells) - cells
        rows = held * self.blocks / cells  # of a cell; a comparison counts for a hundredth of a row
        weight = np.cumsum(np.repeat(rows + rows * rows / 200, cells))
        self.tasks = int(max(1, np.ceil(weight[-1] / TASK_ROWS)))
        self.task = np.minimum((weight - weight[0]) * self.tasks / max(weight[-1], 1), self.tasks - 1).astype(np.int32)

    def signed(self, part: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into values, number of a bucket) for all signatures of a partition."""
        bits, threshold = self.plan[part]
        index, signature = signatures(values, bits, threshold)
        number = np.zeros(len(signature), np.int64)
        for k, b in enumerate(bits):
            number |= ((signature >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
        return index, number + self.base[part]

    def cells(self, index: np.ndarray, number: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, cell): one for a small bucket, for a large one all pairs of blocks with the node's own."""
        blocks = self.blocks[number]
        if (blocks == 1).all():
            return index, self.first[number]
        row = np.repeat(np.arange(len(index)), blocks)
        other = spread(np.zeros(len(blocks), np.int64), blocks)
        with np.errstate(over="ignore"):
            mine = ((node[index].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % blocks.astype(np.uint64)).astype(np.int64)[row]
        high, low = np.maximum(mine, other), np.minimum(mine, other)
        return index[row], self.first[number[row]] + high * (high + 1) // 2 + low


_ROW = np.dtype([("cell", "<u4"), ("size", "<u4"), ("value", "<u8"), ("second", "<u8"), ("node", "<i8")])


def _send(dealing: Dealing):
    """(node, fingerprint, second, size) to packed signatures of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(held) if held else np.empty(0, _ROW)
            task = dealing.task[rows["cell"]]
            order = np.argsort(task, kind="stable")
            rows, task = rows[order], task[order]
            names, first = np.unique(task, return_index=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([r.tobytes() for r in np.split(rows, first[1:])][: len(names)], pa.binary())], names=["task", "rows"])

        for batch in batches:
            for i in range(0, batch.num_rows, 4_096):
                node, value, second, size = (c.to_numpy(zero_copy_only=False) for c in batch.slice(i, 4_096).columns)
                for part in range(len(dealing.plan)):
                    index, cell = dealing.cells(*dealing.signed(part, value.view(np.uint64)), node)
                    rows = np.empty(len(index), _ROW)
                    rows["cell"], rows["size"], rows["value"], rows["second"], rows["node"] = cell, size[index], value.view(np.uint64)[index], second.view(np.uint64)[index], node[index]
                    held.append(rows)
                    count += len(rows)
                    if count >= SEND_ROWS:
                        yield flush()
                        count = 0
        yield flush()

    return run


def link_bucket(value: np.ndarray, second: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one bucket of many: each value met is compared once with those not reached yet."""
    left, links = np.arange(len(value)), []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            i = front.pop()
            near = (_apart(value[i], value[left]) <= distance) & (_apart(second[i], second[left]) <= SECOND)
            if near.any():
                found = left[near]
                links.append((np.full(len(found), i), found))
                front += found.tolist()
                left = left[~near]
    return tuple(np.concatenate(x) for x in zip(*links, strict=True)) if links else (np.empty(0, np.int64),) * 2


def bucket_links(value: np.ndarray, second: np.ndarray, size: np.ndarray, distance: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that have the components of all links within one bucket, which is sorted by size; sets whose sizes are further apart than ``least`` can't be similar."""
    n, found = len(value), []
    step = max(16, COMPARE // n)
    reach = np.searchsorted(size, size / least, side="right") if least else np.full(n, n)
    room = min(step, n) * n
    differ, apart, near = np.empty(room, np.uint64), np.empty(room, np.uint8), np.empty(room, bool)
    for i in range(0, n, step):
        rows, end = min(step, n - i), int(reach[min(i + step, n) - 1])
        wide = end - i
        k = rows * wide
        np.bitwise_xor(value[i : i + rows, None], value[None, i:end], out=differ[:k].reshape(rows, wide))
        np.bitwise_count(differ[:k], out=apart[:k])
        np.less_equal(apart[:k], distance, out=near[:k])
        a, b = np.divmod(np.flatnonzero(near[:k]), wide)
        a, b = a[a < b] + i, b[a < b] + i
        alike = _apart(second[a], second[b]) <= SECOND
        found.append((a[alike], b[alike]))
        if len(found[-1][0]) > 32 * step:  # crowded: no more pairs than values
            return link_bucket(value, second, distance)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links that join what earlier ones have not joined."""
    names, both = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(names)))
    keep = []
    n = len(u)
    for k, (a, b) in enumerate(zip(both[:n].tolist(), both[n:].tolist(), strict=True)):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b:
            parent[max(a, b)] = min(a, b)
            keep.append(k)
    return u[keep], v[keep]


def _verify(distance: int, least: float):
    """A task's packed signatures to links (u, v) of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = [x for batch in batches for x in batch.column(1).to_pylist()]
        rows = np.frombuffer(b"".join(packed), _ROW)
        packed.clear()
        rows = rows[np.lexsort((rows["size"], rows["cell"]))]
        value, second, node, weight = (np.ascontiguousarray(rows[c]) for c in ("value", "second", "node", "size"))
        first = np.flatnonzero(np.append(True, rows["cell"][1:] != rows["cell"][:-1])) if len(rows) else np.empty(0, np.int64)
        size = np.diff(np.append(first, len(rows)))
        u, v, found, held = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def near(a: np.ndarray, b: np.ndarray) -> None:
            nonlocal u, v, held
            other = node[a] != node[b]  # a task may have both rows of one node in a pair of blocks
            found.append((node[a[other]], node[b[other]]))
            held += len(found[-1][0])
            if held > 200_000:
                u, v = forest(*(np.concatenate([x, *y]) for x, y in zip((u, v), zip(*found, strict=True), strict=True)))
                found.clear()
                held = 0

        for a, n in zip(first[size > 32].tolist(), size[size > 32].tolist(), strict=True):
            i, j = bucket_links(value[a : a + n], second[a : a + n], weight[a : a + n], distance, least)
            near(i + a, j + a)
        end = np.repeat(first + size, size)
        at = np.flatnonzero(np.repeat(size <= 32, size))
        for step in range(1, 32):
            at = at[at + step < end[at]]
            if not len(at):
                break
            hit = at[(_apart(value[at], value[at + step]) <= distance) & (_apart(second[at], second[at + step]) <= SECOND)]
            near(hit, hit + step)
        if found:
            u, v = forest(*(np.concatenate([x, *y]) for x, y in zip((u, v), zip(*found, strict=True), strict=True)))
        for i in range(0, len(u), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(u[i : i + 100_000]), pa.array(v[i : i + 100_000])], names=["u", "v"])

    return run


def link_fingerprints(classes: DataFrame, distance: int = 4, least: float = 0.0, sample_rows: int = SAMPLE, bucket: int = BUCKET) -> DataFrame:
    """classes (node long, fingerprint long, second long, size int; distinct nodes) to links (u, v) that have the components of all links within ``distance``, and with sizes at least ``least`` alike."""
    total = classes.count()
    fraction = min(1.0, 2.0 * sample_rows / max(1, total))
    sample = np.array([r[0] for r in classes.sample(fraction, 7).select("fingerprint").limit(sample_rows).collect()], np.int64).view(np.uint64)
    dealing = Dealing(plan_partitions(sample[:PLAN_SAMPLE], distance, total), sample, total, bucket)
    sent = classes.select("node", "fingerprint", "second", "size").mapInArrow(_send(dealing), "task int, rows binary")
    return sent.repartitionById(dealing.tasks, "task").mapInArrow(_verify(distance, least), "u long, v long")


def near_duplicates(docs: DataFrame, distance: int = 4, size: int = 4, seed: int = 42, least: tuple[int, int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (long), component_id (the smallest doc_id reachable over links).  least: the least similarity of a link, as a fraction of whole numbers."""
    if least:
        prints = written(shingle_prints(docs, id_col, text_col, size, seed), "fingerprints")
    else:  # a class is named by its fingerprint: it is unique even where ids are null or repeated
        prints = written(fingerprint_documents(docs, id_col, text_col, size, seed).withColumns({"node": F.col("fingerprint"), "second": F.lit(0).cast("long"), "size": F.lit(0)}), "fingerprints")
    classes = written(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.min(F.struct("fingerprint", "second", "size")).alias("print")).select("node", "least", "n", "print.*"), "classes")
    links = link_fingerprints(classes, distance, least[0] / least[1] if least else 0.0)
    if least:
        other = classes.withColumns({"fingerprint": F.col("second"), "second": F.col("fingerprint")})
        links = links.unionByName(link_fingerprints(other, distance, least[0] / least[1]))
        links = exact_links(connected_components(links), classes, id_and_text(docs, id_col, text_col), lambda t: np.frombuffer(b"".join(shingle_hashes(t, size, seed)), ">u8").astype(np.uint64), least)
    member = connected_components(links).withColumnRenamed("component", "reached")
    named = written(classes.join(member, "node", "left").select("node", "least", "n", F.coalesce("reached", "node").alias("component")), "members")
    answer = written(named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "n", "component_id"), "components")
    rows = max(1, prints.count())
    hot = answer.filter(F.col("n") > min(rows / HOT, HOT_ROWS)).select("node", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot"))
    marked = prints.select("doc_id", "fingerprint", "node").join(F.broadcast(hot), "node", "left")
    cold = marked.filter(F.col("hot").isNull()).select("doc_id", "fingerprint", "node").join(answer.select("node", "component_id"), "node")
    return marked.filter("hot").select("doc_id", "fingerprint", F.col("hot_id").alias("component_id")).unionByName(cold.select("doc_id", "fingerprint", "component_id"))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
