"""Structure repair of conversations at the least cost.

Roles have to read s?(ua)+ or nothing, a grammar of four states. Edits of a row cost 0 to 7, an inserted row costs 5. The
cheapest edits are found as approximate matching with cost layers: for each place between two rows a bitset of the grammar
states from which the end can be reached at a cost of c at most, for c = 0, 1, 2, ...; a layer follows from the ones that
are cheaper by an edit's cost, for all states at once. The first layer with the start's bit gives the cost, and a walk
along the bits, each time by the first letter that stays on a cheapest way, the least audit.

At scale: rows are sorted by ranges of (conversation, turn), so a conversation of any length is spread over as many tasks as
its rows fill. One that lies within a task is repaired there, in one pass. Another one is cut into blocks of bounded size. A
block by itself gives its costs from each state to each state; those of a conversation, sixteen numbers a block, are
composed from the end to give each block the costs behind it; then each block is walked from each of its states, and the
ways are put together from the start. Rows do not wait in memory: texts go by once, and a conversation's hash is fed in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import joinable, settled, with_row_id, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
OUTSIDE = 1 << 20
#: Rows, and characters of roles and texts, that a block has at most; a longer single row is one of its own.
BLOCK_ROWS, BLOCK_CHARS = 256, 2_000_000
#: Conversations of at most so many blocks are repaired at once if they lie within one task.
WHOLE_BLOCKS = 4

# states: nothing yet, after s, after u, after a; the roles read well in the first and the last
STATES = range(4)
ACCEPTS = {0: 0, 3: 0}
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The one role that a new or renamed row can have in each state, and the state after it.
NEXT = (("u", 2), ("u", 2), ("a", 3), ("u", 2))
WORD = {"u": "user", "a": "assistant"}
NONE, BLANK, DUPLICATE, TRUNCATED_FAULT = range(4)


def _sources(to: dict[int, int]) -> list[int]:
    """For each bitset of states: those with a step into it."""
    return [sum(1 << q for q, r in to.items() if bits >> r & 1) for bits in range(16)]


_BY_NEXT = _sources({q: r for q, (_, r) in enumerate(NEXT)})
_BY_KEEP = {c: _sources({q: AFTER[q][c] for q in STATES if c in AFTER[q]}) for c in "sua"}
_NO_KEEP = [0] * 16


def layers(rows: list[tuple[str, int]], end: dict[int, int], wanted: int) -> list[bytearray]:
    """For cost c = 0, 1, ...: a bitset for each place, the states from which the end can be reached at cost c at most. Until
    all wanted states have their bit in the first place, or can't get it. rows: initial and fault. end: costs behind the rows."""
    n, found = len(rows), []
    # the most that any state can cost: all rows deleted, and what is behind the rows; further layers bring nothing
    most = DELETE * n + 2 * INSERT + max(end.values(), default=0)
    blank = bytearray(n + 1)
    edits = [(_BY_KEEP.get(role, _NO_KEEP) if fault in (NONE, TRUNCATED_FAULT) else None, TRUNCATED * (fault == TRUNCATED_FAULT)) for role, fault in rows]
    for c in range(most + 1):
        now = bytearray(n + 1)
        at = [now, *(found[c - k] if c >= k else blank for k in range(1, TRUNCATED + REROLE + 1))]
        now[n] = sum(1 << q for q, k in end.items() if k <= c)
        deleted, inserted = at[DELETE], at[INSERT]
        for i in range(n - 1, -1, -1):
            keep, extra = edits[i]
            reached = deleted[i + 1] | _BY_NEXT[inserted[i]]
            if keep is not None:
                reached |= keep[at[extra][i + 1]] | _BY_NEXT[at[extra + REROLE][i + 1]]
            now[i] = reached
        found.append(now)
        if now[0] & wanted == wanted:
            break
    return found


def first_layer(found: list[bytearray], state: int) -> int:
    """The cost of a state in the first place."""
    return next((c for c, now in enumerate(found) if now[0] >> state & 1), OUTSIDE)


def walk(rows: list[tuple[str, int]], found: list[bytearray], state: int) -> tuple[str, int]:
    """The least audit from a state in the first place along the bits, and the state behind the rows."""
    audit, i, n, left = [], 0, len(rows), first_layer(found, state)
    if left == OUTSIDE:
        return "", state

    def reaches(place: int, at: int, cost: int) -> bool:
        return cost >= 0 and bool(found[cost][place] >> at & 1)

    while i < n:
        role, fault = rows[i]
        extra, follows = TRUNCATED * (fault == TRUNCATED_FAULT), NEXT[state][1]
        if reaches(i + 1, state, left - DELETE):
            letter, left, i = "D", left - DELETE, i + 1
        elif reaches(i, follows, left - INSERT):
            letter, left, state = "I", left - INSERT, follows
        elif fault in (NONE, TRUNCATED_FAULT) and role in AFTER[state] and reaches(i + 1, AFTER[state][role], left - KEEP - extra):
            letter, left, i, state = "K", left - KEEP - extra, i + 1, AFTER[state][role]
        else:
            letter, left, i, state = "R", left - REROLE - extra, i + 1, follows
        audit.append(letter)
    return "".join(audit), state


def closing(state: int) -> int:
    """How many rows have to be inserted behind the last one."""
    return (0, 2, 1, 0)[state]


#: Costs behind the last row.
END = {q: INSERT * closing(q) for q in STATES}


def applied(audit: str, rows: Iterator[tuple[str, str]], state: int) -> Iterator[str]:
    """``role:text`` of each repaired row; rows: role and text."""
    for letter in audit:
        if letter == "I":
            role, state = NEXT[state]
            yield f"{WORD[role]}:"
            continue
        role, text = next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = AFTER[state][role[:1]]
        else:
            new, state = NEXT[state]
            role = WORD[new]
        yield f"{role}:{text}"


class _Stretch:
    """Consecutive rows of one conversation."""

    def __init__(self, most: int = BLOCK_ROWS):
        self.most = most
        self.codes, self.roles, self.texts, self.chars = [], [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == TRUNCATED_FAULT
        if self.codes:
            self.illegal += self.last + initial not in LEGAL
        else:
            self.first = initial
        self.last = initial
        if turn is not None:
            self.turns += turn != self.high  # rows come by turn
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.codes.append((initial, fault))
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(role) + len(text)

    @property
    def full(self) -> bool:
        return len(self.codes) >= self.most or self.chars >= BLOCK_CHARS


LEGAL = ("su", "ua", "au")
SUMS = ("blank", "duplicate", "truncated", "illegal", "turns")
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
RESULT = (*COUNTS, "cost", "audit", "repaired_sha256")
MARKS = (*SUMS, "first", "last", "low", "high")


class _Total:
    """Counts of a conversation from those of its stretches, in order."""

    def __init__(self):
        self.sums = dict.fromkeys(SUMS, 0)
        self.last = self.low = self.high = None

    def add(self, x: dict) -> None:
        if x["first"] is None:
            return  # no rows
        for k in SUMS:
            self.sums[k] += x[k]
        self.sums["illegal"] += self.last is not None and self.last + x["first"] not in LEGAL
        self.last = x["last"]
        if x["low"] is not None:
            self.sums["turns"] -= x["low"] == self.high
            self.low, self.high = x["low"] if self.low is None else self.low, x["high"]

    def row(self) -> tuple[int, ...]:
        """gaps, blank, duplicate, truncated, illegal."""
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.sums["turns"]
        return (gaps, *(self.sums[k] for k in SUMS[:4]))


def repaired(blocks: list[_Stretch]) -> tuple:
    """The whole result of a conversation that is at hand."""
    codes = [c for b in blocks for c in b.codes]
    found = layers(codes, END, 1)
    audit, state = walk(codes, found, 0)
    audit += "I" * closing(state)
    rows = ((r, t) for b in blocks for r, t in zip(b.roles, b.texts, strict=True))
    text = "\n".join(applied(audit, rows, 0))
    total = _Total()
    for b in blocks:
        total.add(vars(b))
    return (*total.row(), first_layer(found, 0), audit, hashlib.sha256(text.encode("utf-8", "replace")).hexdigest())


def crossings(codes: list[tuple[str, int]]) -> list[int]:
    """Costs of a block from each state to each state: four times four."""
    out = [OUTSIDE] * 16
    for to in STATES:
        # only those who delete everything stay in the first state, and none comes into the second but from it
        from_ = [q for q in STATES if (to == 0) <= (q == 0) and not (to == 1 and q > 1)]
        found = layers(codes, {to: 0}, sum(1 << q for q in from_))
        for q in from_:
            out[4 * q + to] = first_layer(found, q)
    return out


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """rid, conv_id, turn, role, text, copies of each row: a stated damage by the checksum of conversation and turn. Rows that
    are dropped have no copies, repeated ones two. Nulls of role and text are one space."""
    rows = with_row_id(conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(to) for c, to in ((role_col, "role"), (text_col, "text")))))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("rid", "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def faults(rows: DataFrame) -> DataFrame:
    """Adds fault (BLANK, DUPLICATE, TRUNCATED_FAULT or NONE), of rows as ``damaged`` has them.

    A row is a duplicate if one before it has its role and text. Groups of equal rows are reduced to their first one before
    they meet again, so a hot row is no hot key."""
    bare = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    word = F.concat_ws(":", F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n")), F.length("role").cast("string"), "role", "text")
    keyed = rows.filter((F.col("copies") > 0) & (bare != "")).select("rid", "turn", F.sha2(word.cast("binary"), 256).alias("same"))
    firsts = written(keyed.groupBy("same").agg(F.min(F.struct("turn", "rid")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("same", F.col("first.rid").alias("first")))
    later = written(keyed.join(joinable(firsts), "same").filter("rid <> first").select("rid", F.lit(True).alias("later")))
    fault = F.when(bare == "", BLANK).when(F.coalesce("later", F.lit(False)), DUPLICATE).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED_FAULT).otherwise(NONE)
    return rows.join(joinable(later), "rid", "left").withColumn("fault", fault).drop("later")


def _stretches(kind: pa.DataType, block_rows: int):
    """Over rows sorted by conversation and turn: whole results of conversations that surely lie in this task, blocks of others."""
    fields = [("conv_id", kind), ("part", pa.int32()), ("seq", pa.int32()), *((c, pa.int64()) for c in (*COUNTS, "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]
    fields += [("turns", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("crossings", pa.list_(pa.int32())), ("faults", pa.list_(pa.int32())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
    schema = pa.schema(fields)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                yield from zip(*(c.to_pylist() for c in b.slice(i, 1000).columns), strict=True)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        seq, part = 0, None
        chars = 0

        def block(conv, b: _Stretch) -> None:
            nonlocal seq, chars
            chars += b.chars
            held.append({"conv_id": conv, "part": part, "seq": seq, "crossings": crossings(b.codes), "faults": [f for _, f in b.codes], "roles": b.roles, "texts": b.texts} | {k: getattr(b, k) for k in MARKS})
            seq += 1

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal held, chars
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, chars = [], 0

        before: tuple | None = None  # the conversation that has ended last, in case it is the last one of the task
        at_start = True
        for conv, rows in groupby(rows_of(batches), key=itemgetter(0)):
            if before is not None:
                held.append(dict(zip(("conv_id", *RESULT), (before[0], *repaired(before[1])), strict=True)))
            blocks, early = [_Stretch(block_rows)], at_start  # of the first conversation rows may be in the task before
            for _, turn, role, text, copies, fault, part in rows:
                for copy in range(copies):
                    if blocks[-1].full:
                        blocks.append(_Stretch(block_rows))
                        early |= len(blocks) > WHOLE_BLOCKS
                    blocks[-1].add(turn, role, text, fault if fault == BLANK or not copy else DUPLICATE)
                if early:
                    for b in blocks[:-1]:
                        block(conv, b)
                    del blocks[:-1]
                if len(held) >= 1000 or chars >= BLOCK_CHARS:
                    yield from flushed()
            if early:
                block(conv, blocks[0])
                before = None
            else:
                before = conv, blocks
            at_start = False
        if before is not None:  # rows may follow in the next task
            for b in before[1]:
                block(before[0], b)
        yield from flushed()

    return out


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterable[tuple]:
    """Rows as dicts by conversation, for tables that are sorted by it."""
    return groupby((r for b in batches for i in range(0, b.num_rows, 8) for r in b.slice(i, 8).to_pylist()), key=itemgetter("conv_id"))


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 200) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema=schema)


def _spread(blocks: DataFrame, kind: str, arrow: pa.DataType) -> DataFrame:
    """Results of conversations that are cut into blocks."""
    at = [("part", pa.int32()), ("seq", pa.int32())]

    def by_conversation(df: DataFrame, forward: bool) -> DataFrame:
        order = [F.col(c).asc() if forward else F.col(c).desc() for c in ("part", "seq")]
        return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)

    def costs_behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for _, each in _in_order(batches):
                behind = [END[q] for q in STATES]
                for r in each:
                    yield {"part": r["part"], "seq": r["seq"], "behind": behind}
                    behind = [min(r["crossings"][4 * q + to] + behind[to] for to in STATES) for q in STATES]

        return _batches(rows(), pa.schema([*at, ("behind", pa.list_(pa.int64()))]))

    behind = written(by_conversation(blocks.select("conv_id", "part", "seq", "crossings"), False).mapInArrow(costs_behind, "part int, seq int, behind array<long>"))

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Audit, cost and last state of a block from each state."""

        def rows():
            for b in batches:
                for r in b.to_pylist():
                    codes = list(zip(r["initials"], r["faults"], strict=True))
                    low = min(r["behind"])
                    end = {q: k - low for q, k in enumerate(r["behind"])}
                    found = layers(codes, end, 15)
                    each = [walk(codes, found, q) for q in STATES]
                    yield {"part": r["part"], "seq": r["seq"], "conv_id": r["conv_id"], "audits": [a for a, _ in each], "exits": [q for _, q in each], "costs": [first_layer(found, q) - end[x] for q, (_, x) in enumerate(each)]}

        schema = pa.schema([*at, ("conv_id", arrow), ("audits", pa.list_(pa.string())), ("exits", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64()))])
        return _batches(rows(), schema)

    initials = F.transform("roles", lambda r: F.substring(r, 1, 1)).alias("initials")
    walked = blocks.select("conv_id", "part", "seq", "faults", initials).join(behind, ["part", "seq"])
    walked = written(walked.mapInArrow(ways, f"part int, seq int, conv_id {kind}, audits array<string>, exits array<int>, costs array<long>"))

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for _, each in _in_order(batches):
                state = 0
                for r in each:
                    yield {"part": r["part"], "seq": r["seq"], "state": state}
                    state = r["exits"][state]

        return _batches(rows(), pa.schema([*at, ("state", pa.int32())]), 5000)

    entry = written(by_conversation(walked.select("conv_id", "part", "seq", "exits"), True).mapInArrow(entered, "part int, seq int, state int"))
    chosen = walked.join(entry, ["part", "seq"]).select("part", "seq", "state", *(F.get(c, F.col("state")).alias(to) for c, to in (("audits", "audit"), ("exits", "exit"), ("costs", "cost"))))

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                lines = [line + "\n" for line in applied(r["audit"], zip(r["roles"], r["texts"], strict=True), r["state"])]
                columns = {f.name: b.column(f.name).slice(i, 1) for f in b.schema if f.name not in ("roles", "texts", "state")}
                yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(["".join(lines)])], names=[*columns, "lines"])

    types = f"conv_id {kind}, part int, seq int, blank long, duplicate long, truncated long, illegal long, turns long, first string, last string, low long, high long, audit string, exit int, cost long"
    parts = blocks.select("conv_id", "part", "seq", *MARKS, "roles", "texts").join(chosen, ["part", "seq"]).select("conv_id", "part", "seq", *MARKS, "audit", "exit", "cost", "roles", "texts", "state")
    parts = parts.mapInArrow(edited, types + ", lines string")

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for conv, each in _in_order(batches):
                total, audit, cost, digest, state, waiting = _Total(), [], 0, hashlib.sha256(), 0, b""
                for r in each:
                    total.add(r)
                    audit.append(r["audit"])
                    cost += r["cost"]
                    state = r["exit"]
                    if r["lines"]:  # the last line break of all is not part of the text
                        raw = r["lines"].encode("utf-8", "replace")
                        digest.update(waiting + raw[:-1])
                        waiting = raw[-1:]
                added = closing(state)
                for line in applied("I" * added, iter(()), state):
                    digest.update(waiting + line.encode())
                    waiting = b"\n"
                result = (*total.row(), cost + INSERT * added, "".join(audit) + "I" * added, digest.hexdigest())
                yield {"conv_id": conv} | dict(zip(RESULT, result, strict=True))

        schema = pa.schema([("conv_id", arrow), *((c, pa.int64()) for c in (*COUNTS, "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        return _batches(rows(), schema)

    return by_conversation(parts, True).mapInArrow(ended, _result(kind))


def _result(kind: str) -> str:
    return f"conv_id {kind}, " + ", ".join(f"{c} long" for c in (*COUNTS, "cost")) + ", audit string, repaired_sha256 string"


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    rows: rid (distinct, decides among equal turns), conv_id, turn, role, text, copies (0 to drop a row), fault. Conversations
    of null ids are one. One without rows left has zeros, an empty audit and the hash of the empty text; an empty table gives
    no rows. Roles that begin with none of s, u, a can't be kept."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind, arrow = rows.schema["conv_id"].dataType.simpleString(), to_arrow_type(rows.schema["conv_id"].dataType)
    order = ("conv_id", "turn", "rid")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select("conv_id", "turn", F.when(F.col("copies") > 0, F.col("role")).alias("role"), F.when(F.col("copies") > 0, F.col("text")).alias("text"), "copies", "fault", F.spark_partition_id().alias("part"))
    fields = f"conv_id {kind}, part int, seq int, " + ", ".join(f"{c} long" for c in (*COUNTS, "cost")) + ", audit string, repaired_sha256 string, turns long, first string, last string, low long, high long, crossings array<int>, faults array<int>, roles array<string>, texts array<string>"
    found = written(dealt.mapInArrow(_stretches(arrow, block_rows), fields))
    whole = found.filter("seq IS NULL").select("conv_id", *RESULT)
    return whole.unionByName(_spread(found.filter("seq IS NOT NULL"), kind, arrow).select("conv_id", *RESULT))


def repair_damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``repair`` of the conversations as ``damaged`` leaves them. Rows of equal turns keep the table's order."""
    return repair(faults(damaged(settled(conversations), conv_col, turn_col, role_col, text_col)), block_rows)
