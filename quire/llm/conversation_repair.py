"""Conversations made well-formed at least cost, by a recursive DuckDB query over blocks of turns in every task.

Rows of a conversation, by turn (nulls first; ties by role, then text), are checked for one fault each: blank (no
character but white space), duplicate (role and text seen earlier), truncated (doesn't end with a stop).  Edits then make the
role initials (s?(ua)+)?: Keep, Rerole to user or assistant, Delete, Insert an empty user or assistant turn (COST).
Blank and duplicate rows must be deleted; a truncated row that stays costs extra.  Of the cheapest edits those with
the ASCII-least audit (their initials in order) are taken.

1. Rows are hashed to partitions by conversation, once.  Two windows over that partitioning mark the repeats of
   (role, text) and carry the neighbour's initial and turn; rows then stream to the task in order.
2. A task cuts the stream into blocks of at most BLOCK_TURNS turns of one conversation and gathers blocks of about
   BATCH_TURNS turns.  One recursive query serves a batch: each recursion advances one turn in all its blocks, and keeps the
   minimum (cost, audit) for each grammar state that a block may be entered in and the state it has reached.
   Equal costs after equal turns have audits of which none begins another, so the least audit of a
   state stays the least, and blocks can be joined by their entry and exit states.
3. Blocks of one conversation follow one another in the stream, so a conversation of any length is a walk over four states,
   each with its cost, the pieces of its audit and a running SHA-256; its texts are never held together.  That digest is one
   chain by definition, so a conversation is one task's work, in bounded memory but for its audit, which is a result.

Two inserts in a row are never cheapest: they lead from s, a or the empty start only to the state after a, and after s
deleting s costs less.  Null conv_ids are one conversation; other nulls count as one space.  Conversations without rows give zeros,
an empty audit and the digest of nothing.  Repeated rows are duplicates.  Extra columns are left alone.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import Rows

BLOCK_TURNS, BATCH_TURNS, BATCH_BYTES = 256, 16_384, 16_000_000
COST = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
#: Grammar states: nothing yet, after s, after u, after a; the state that an initial leads to from each.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NAME = {USER: "user", ASSISTANT: "assistant"}
#: What completes a conversation that ends in a state.
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
#: Faults, as codes.
GOOD, BLANK, DUPLICATE, CUT = range(4)
SPACES = " \t\n\x0b\x0c\r"


def rerole(state: int) -> int:
    """The state after the user or assistant turn that may follow a state."""
    return ASSISTANT if state == USER else USER


def edits() -> list[tuple[int, str, str, int, int, bool]]:
    """(state, initial or * for any, audit letters, cost, next state, whether the row stays): what may be done about one row, with or without an insert before it."""
    out = []
    for state in range(4):
        for before, s, price in (("", state, 0), ("I", rerole(state), COST["I"])):
            out.append((state, "*", before + "D", price + COST["D"], s, False))
            out.append((state, "*", before + "R", price + COST["R"], rerole(s), True))
            out += [(state, initial, before + "K", price + COST["K"], to, True) for (at, initial), to in NEXT.items() if at == s]
    return out


WALK = f"""
WITH RECURSIVE walk AS (
    SELECT block, 0 AS place, entry, entry AS state, 0::BIGINT AS cost, '' AS audit FROM entries
    UNION ALL
    SELECT block, place + 1, entry, state, (least_one).cost, (least_one).audit
    FROM (
        SELECT w.block, w.place, w.entry, e.next AS state,
               min({{'cost': w.cost + e.cost + CASE WHEN e.stays AND t.fault = {CUT} THEN {TRUNCATED} ELSE 0 END, 'audit': w.audit || e.letters}}) AS least_one
        FROM walk w
        JOIN turns t ON t.block = w.block AND t.place = w.place
        JOIN edits e ON e.state = w.state AND e.initial IN ('*', t.initial) AND NOT (e.stays AND t.fault IN ({BLANK}, {DUPLICATE}))
        GROUP BY ALL
    )
)
SELECT block, entry, state, cost, audit FROM walk JOIN sizes USING (block) WHERE place = size ORDER BY block
"""


def repaired_turns(audit: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """What an audit makes of turns from a grammar state on, as role:text."""
    out, at = [], 0
    for letter in audit:
        if letter == "I":
            state = rerole(state)
            out.append(f"{NAME[state]}:")
            continue
        role, text, at = roles[at], texts[at], at + 1
        if letter == "R":
            state = rerole(state)
            out.append(f"{NAME[state]}:{text}")
        elif letter == "K":
            state = NEXT[state, role[:1]]
            out.append(f"{role}:{text}")
    return out


class Conversation:
    """The sums of a conversation so far, and for each grammar state it may be in the least cost, the end of its audit and the digest of its turns.

    ``agreed`` holds the pieces of the audit that all states share, so a long audit isn't copied for every block."""

    def __init__(self, key: int | None):
        self.key, self.sums, self.agreed, self.blocks = key, [0] * 5, [], 0
        self.low = self.high = None
        self.ways = {START: (0, "", hashlib.sha256(), False)}

    def count(self, turns: list, news: list, faults: list, breaks: list) -> None:
        known = [t for t in turns if t is not None]
        if known:
            self.low, self.high = known[0] if self.low is None else self.low, known[-1]
        for k, n in enumerate((sum(news), faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), sum(breaks))):
            self.sums[k] += n

    def follow(self, moves: list[tuple[int, int, int, str]], roles: list[str], texts: list[str]) -> None:
        """Goes through one block, given (entry, exit, cost, audit) of its cheapest ways."""
        best: dict[int, tuple] = {}
        for entry, leave, cost, audit in moves:
            if entry in self.ways:
                way = (self.ways[entry][0] + cost, self.ways[entry][1] + audit, entry, audit)
                best[leave] = min(way, best.get(leave, way))
        ways = {leave: (cost, whole, *self._told(entry, audit, roles, texts)) for leave, (cost, whole, entry, audit) in best.items()}
        shared = commonprefix([w[1] for w in ways.values()])
        self.agreed.append(shared)
        self.ways = {s: (cost, whole[len(shared) :], *rest) for s, (cost, whole, *rest) in ways.items()}

    def _told(self, state: int, audit: str, roles: list[str], texts: list[str]) -> tuple:
        """The digest of a state after an audit's turns, and whether there was any turn."""
        _, _, digest, begun = self.ways[state]
        lines = repaired_turns(audit, state, roles, texts)
        if lines:
            digest = digest.copy()
            digest.update(("\n" * begun + "\n".join(lines)).encode("utf-8", "surrogatepass"))
        return digest, begun or bool(lines)

    def row(self) -> tuple:
        cost, audit, state = min((cost + sum(COST[x] for x in CLOSING[s]), audit + CLOSING[s], s) for s, (cost, audit, _, _) in self.ways.items())
        digest, _ = self._told(state, CLOSING[state], [], [])
        distinct, *faults = self.sums
        gaps = 0 if self.low is None else self.high - self.low + 1 - distinct
        return self.key, gaps, *faults, cost, "".join(self.agreed) + audit, digest.hexdigest()


class Batch:
    """Blocks of turns, and the recursive query over them."""

    def __init__(self):
        import duckdb

        self.con = duckdb.connect(config={"threads": 1})
        self.con.register("edits", pa.table(dict(zip(("state", "initial", "letters", "cost", "next", "stays"), map(list, zip(*edits(), strict=True)), strict=True))))
        self.blocks: list[tuple[Conversation, bool, list]] = []
        self.turns = self.size = 0

    def add(self, conversation: Conversation, rows: list) -> None:
        """One more block; the first of a conversation is only entered at the start of the grammar."""
        self.blocks.append((conversation, conversation.blocks == 0, rows))
        conversation.blocks += 1
        self.turns += len(rows)
        self.size += sum(len(r[2]) for r in rows)

    def full(self) -> bool:
        return self.turns >= BATCH_TURNS or self.size >= BATCH_BYTES

    def walk(self) -> None:
        """Takes all conversations through their blocks."""
        block = [b for b, (_, _, rows) in enumerate(self.blocks) for _ in rows]
        tables = {
            "turns": pa.table({"block": pa.array(block, pa.int64()), "place": pa.array([i for _, _, rows in self.blocks for i in range(len(rows))], pa.int64()), "initial": pa.array([r[1][:1] for _, _, rows in self.blocks for r in rows], pa.string()), "fault": pa.array([r[3] for _, _, rows in self.blocks for r in rows], pa.int64())}),
            "sizes": pa.table({"block": pa.array(range(len(self.blocks)), pa.int64()), "size": pa.array([len(rows) for _, _, rows in self.blocks], pa.int64())}),
            "entries": pa.table({"block": pa.array([b for b, (_, first, _) in enumerate(self.blocks) for _ in range(1 if first else 4)], pa.int64()), "entry": pa.array([s for _, first, _ in self.blocks for s in range(1 if first else 4)], pa.int64())}),
        }
        for name, table in tables.items():
            self.con.register(name, table)
        moves: list[list] = [[] for _ in self.blocks]
        for b, *move in self.con.execute(WALK).fetchall():
            moves[b].append(tuple(move))
        for (conversation, _, rows), own in zip(self.blocks, moves, strict=True):
            turns, roles, texts, faults, breaks, news = map(list, zip(*rows, strict=True))
            conversation.count(turns, news, faults, breaks)
            conversation.follow(own, roles, texts)
        self.blocks, self.turns, self.size = [], 0, 0


SCHEMA = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
INPUT = ("conv_id", "turn", "role", "text", "fault", "illegal", "new_turn", "gone")


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole conversations, one after another, to a row for each."""
    out, batch, now, rows, done = Rows(SCHEMA), Batch(), None, [], []

    def finish():
        """Runs the query; conversations that ended are handed out."""
        if batch.blocks:
            batch.walk()
        for c in done:
            row = c.row()
            yield from out.add(row, len(row[7]) + 200)
        done.clear()

    for data in batches:
        for i in range(0, data.num_rows, 1024):
            part = data.slice(i, 1024)
            for conv, *turn, gone in zip(*(part.column(c).to_pylist() for c in INPUT), strict=True):
                if now is None or conv != now.key:
                    if now is not None:
                        if rows:
                            batch.add(now, rows)
                        done.append(now)
                        rows = []
                        if batch.full() or len(done) >= BATCH_TURNS:
                            yield from finish()
                    now = Conversation(conv)
                if gone:
                    continue
                rows.append(tuple(turn))
                if len(rows) == BLOCK_TURNS:
                    batch.add(now, rows)
                    rows = []
                    if batch.full():
                        yield from finish()
    if now is not None:
        if rows:
            batch.add(now, rows)
        done.append(now)
    yield from finish()
    yield out.flush()


def checked_turns(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) with their faults, in order and partitioned by conversation.  Rows that are ``gone`` only keep their conversation known."""
    bare = F.btrim("text", F.lit(SPACES))
    own = turns.withColumn("digest", F.when(~F.col("gone"), F.unhex(F.md5(F.concat(F.char_length("role"), F.lit(":"), "role", "text"))))).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "digest").orderBy("turn")) > 1
    in_order = Window.partitionBy("conv_id", "gone").orderBy("turn", "role", "text")
    pair = F.concat(F.lag(F.left("role", F.lit(1))).over(in_order), F.left("role", F.lit(1)))
    first = F.row_number().over(in_order) == 1
    return (
        own.withColumn("again", again)
        .withColumn("fault", F.when(bare == "", BLANK).when(F.col("again"), DUPLICATE).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(GOOD))
        .withColumn("illegal", (~first & ~pair.isin("su", "ua", "au")).cast("int"))
        .withColumn("new_turn", (F.col("turn").isNotNull() & (first | ~F.lag("turn").over(in_order).eqNullSafe(F.col("turn")))).cast("int"))
        .select(*INPUT)
        .sortWithinPartitions("conv_id", "gone", "turn", "role", "text")
    )


def repair_conversations(turns: DataFrame) -> DataFrame:
    """One row for each conv_id of rows (conv_id long, turn long, role string, text string, gone boolean)."""
    columns = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return checked_turns(turns).mapInArrow(_repair, columns)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the faults that the query plants, by crc32 of conversation and turn; a dropped row stays as ``gone``, without its text."""
    space = F.lit(" ")
    own = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")))
    kind = F.pmod(F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))).cast("binary")), F.lit(20))
    own = own.withColumn("kind", kind)
    text = F.when(F.col("kind").isin(0, 1), F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0))))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Every conversation of the damaged table: its faults, the cost and audit of its repair, and the digest of the result."""
    return repair_conversations(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP11_SQL = """
WITH RECURSIVE source AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
    FROM conversations
), kinds AS (
    SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(name, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) ELSE xor(r >> 1, 3988292384 * (r & 1)) END), 4294967295::BIGINT) % 20 AS kind
    FROM source
), damaged AS (
    SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM kinds WHERE kind <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS place, left(role, 1) AS initial,
           trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
    FROM damaged
), turns AS (
    SELECT *, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY place) > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
           lag(initial) OVER (PARTITION BY c ORDER BY place) || initial AS pair
    FROM placed
), sums AS (
    SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
           count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
    FROM turns GROUP BY c
), follows(state, initial, after) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), inserts AS (
    SELECT state, state AS after, '' AS letter, []::VARCHAR[] AS line, 0 AS price FROM (VALUES (0), (1), (2), (3)) AS s(state)
    UNION ALL SELECT state, after, 'I', [CASE after WHEN 2 THEN 'user:' ELSE 'assistant:' END], 3 FROM follows WHERE initial <> 's'
), walk AS (
    SELECT DISTINCT c, 1::BIGINT AS place, 0 AS state, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS way FROM source
    UNION ALL
    SELECT c, place + 1, state, min(way) FROM (
        SELECT w.c, w.place, i.after AS state, {'cost': w.way.cost + i.price + 4, 'audit': w.way.audit || i.letter || 'D', 'lines': list_concat(w.way.lines, i.line)} AS way
        FROM walk w JOIN turns t ON t.c = w.c AND t.place = w.place JOIN inserts i ON i.state = w.state
        UNION ALL
        SELECT w.c, w.place, f.after,
               {'cost': w.way.cost + i.price + CASE WHEN keep THEN 0 ELSE 3 END + CASE t.fault WHEN 3 THEN 3 ELSE 0 END, 'audit': w.way.audit || i.letter || CASE WHEN keep THEN 'K' ELSE 'R' END,
                'lines': list_concat(w.way.lines, list_append(i.line, CASE WHEN keep THEN t.role WHEN f.initial = 'u' THEN 'user' ELSE 'assistant' END || ':' || t.text))}
        FROM walk w JOIN turns t ON t.c = w.c AND t.place = w.place JOIN inserts i ON i.state = w.state JOIN follows f ON f.state = i.after, (VALUES (true), (false)) AS k(keep)
        WHERE t.fault IN (0, 3) AND (CASE WHEN keep THEN f.initial = t.initial ELSE f.initial <> 's' END)
    ) GROUP BY c, place, state
), ended AS (
    SELECT w.c, min({'cost': w.way.cost + i.price, 'audit': w.way.audit || i.letter, 'lines': list_concat(w.way.lines, i.line)}) AS way
    FROM walk w LEFT JOIN sums USING (c) JOIN inserts i ON i.state = w.state
    WHERE w.place = coalesce(n, 0) + 1 AND i.after IN (0, 3) GROUP BY w.c
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       way.cost AS cost, way.audit AS audit, sha256(coalesce(array_to_string(way.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, c FROM source) JOIN ended USING (c) LEFT JOIN sums USING (c)
"""
