"""Repairs against a plain shortest-way search, and the query against its SQL twin."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import catalog, repair

SF = "/root/testdata/sf0.001"
GOOD = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NAMES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit, repaired lines), forward over all states. rows: role, text, fault."""
    best = {0: (0, "", ())}

    def inserted(best):
        for _ in range(2):
            for q, (cost, audit, lines) in list(best.items()):
                for r in "ua":
                    if (q, r) in GOOD:
                        new = (cost + 5, audit + "I", (*lines, f"{NAMES[r]}:"))
                        to = GOOD[q, r]
                        best[to] = min(best.get(to, new), new, key=lambda x: x[:2])
        return best

    for role, text, fault in rows:
        now = {}
        for q, (cost, audit, lines) in inserted(best).items():
            ways = [(q, (cost + 2, audit + "D", lines))]
            if fault in (repair.NONE, repair.TRUNCATED_FAULT):
                late = 5 * (fault == repair.TRUNCATED_FAULT)
                ways += [(GOOD[q, role[:1]], (cost + late, audit + "K", (*lines, f"{role}:{text}")))] if (q, role[:1]) in GOOD else []
                ways += [(GOOD[q, r], (cost + late + 1, audit + "R", (*lines, f"{NAMES[r]}:{text}"))) for r in "ua" if (q, r) in GOOD]
            for to, new in ways:
                now[to] = min(now.get(to, new), new, key=lambda x: x[:2])
        best = now
    best = inserted(best)
    return min((best[q] for q in (0, 3) if q in best), key=lambda x: x[:2])


def plain(rows):
    """rows: conv_id, turn, role, text in order of the table."""
    conversations = defaultdict(list)
    for at, (conv, turn, role, text) in enumerate(rows):
        kept = conversations[conv]
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn is not None, turn or 0, at, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    out = []
    for conv, kept in conversations.items():
        kept.sort(key=lambda r: r[:3])
        seen, coded = set(), []
        for _, _, _, role, text in kept:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = repair.BLANK if not body else repair.DUPLICATE if (role, text) in seen else repair.NONE if body[-1] in ".!?" else repair.TRUNCATED_FAULT
            seen.add((role, text))
            coded.append((role, text, fault))
        turns = {t for there, t, *_ in kept if there}
        cost, audit, lines = cheapest(coded)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:], strict=False))
        counts = (sum(f == k for _, _, f in coded) for k in (repair.BLANK, repair.DUPLICATE, repair.TRUNCATED_FAULT))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(map(str, out))


CODES = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from(range(4))), max_size=14)


@settings(max_examples=600, deadline=None)
@given(CODES)
def test_whole(codes):
    b = repair._Stretch()
    for i, (role, fault) in enumerate(codes):
        b.add(i, role, f"t{i}", fault)
    cost, audit, lines = cheapest([(r, f"t{i}", f) for i, (r, f) in enumerate(codes)])
    assert repair.repaired([b])[5:] == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(CODES, st.integers(1, 5))
def test_blocks(codes, size):
    """Blocks composed from the end, then walked from the start."""
    rows = [(r[:1], f) for r, f in codes]
    blocks = [rows[i : i + size] for i in range(0, len(rows), size)]
    behind = [[repair.END[q] for q in repair.STATES]]
    for b in reversed(blocks):
        x = repair.crossings(b)
        behind.append([min(x[4 * q + to] + behind[-1][to] for to in repair.STATES) for q in repair.STATES])
    state, audit, first = 0, "", behind[-1][0]
    for b, end in zip(blocks, behind[-2::-1], strict=True):
        low = min(end)
        found = repair.layers(b, {q: k - low for q, k in enumerate(end)}, 15)
        letters, state = repair.walk(b, found, state)
        audit += letters
    audit += "I" * repair.closing(state)
    assert (first, audit) == cheapest([(r, "", f) for r, f in codes])[:2]


def table():
    rows = [(1, t, ("system", "user", "assistant")[min(t, 1) + (t > 1 and t % 2 == 0)], f"Turn {t}.") for t in range(9)]
    rows += [(2, None, None, None), (2, None, "user", "Null turn."), (2, 5, "user", None), (None, 1, "user", "No id."), (None, None, "assistant", "None."), (3, 1, "tool", "x"), (4, 1, "", "Empty role.")]
    rows += [(5, t, ("user", "assistant")[t % 2], ("Same words.", f"Long {'x' * 3000} {t}", "no stop", "\x0b\n ", "Yes! ")[t * 7 % 5]) for t in range(700)]
    rows += [(6, 1, "user", "A."), (6, 1, "user", "A."), (6, 1, "user", "A."), (7, 3, "user", "Z" * 400_000)]
    rows += [(10 + i, t, ("user", "assistant", "system")[(t * t + i) % 3], f"Words {t * i}{'.?! '[t % 4]}") for i in range(120) for t in range(i % 9)]
    return rows


@pytest.mark.parametrize("rows_in_block", [7, 256])
def test_rows(spark, rows_in_block):
    rows = table()
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string, rid int")
    assert sorted(str(tuple(r)) for r in repair.repair_damaged(df, block_rows=rows_in_block).collect()) == plain(rows)
    assert repair.repair_damaged(df.limit(0)).count() == 0


def test_half_of_all_rows_in_one(spark):
    """The rows of one conversation are in many tasks until its text is hashed."""
    rows = [(9, t, ("user", "assistant")[t % 2], f"Turn {t}{'.' * (t % 5 > 0)}") for t in range(6000)] + [(t, 0, "user", "Alone.") for t in range(10, 3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(str(tuple(r)) for r in repair.repair_damaged(df).collect()) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_query(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    twin = c.sql(catalog.ORACLES["op13_repair"])
    got = catalog.QUERIES["op13_repair"](spark, SF).select(*twin.columns).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, twin.fetchall())) == plain(c.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall())
