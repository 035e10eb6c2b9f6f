"""Greedy batches over one running sequence of any length.

Where a batch begins depends on all rows before it. But a batch that begins at a row ends at a place that follows from the rows
behind it alone, and it has a bounded number of rows. So a block of consecutive rows is reduced to a function: for each of
the first rows at which a batch may begin, how many batches begin in the block and what the last of them has so far. The
functions, a few hundred numbers for some thousand rows, are composed in order; then all blocks are numbered at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import values as V
from tessera.session import scratch

BLOCK_ROWS = 4096


def next_starts(tokens: np.ndarray, most_tokens: int, most_items: int) -> np.ndarray:
    """For each row where the batch after one that begins there would begin; the number of rows or more if not in the block."""
    sums, rows = np.r_[0, np.cumsum(tokens)], np.arange(len(tokens))
    fits = np.searchsorted(sums, sums[:-1] + most_tokens, side="right") - 1
    end = np.minimum(np.maximum(fits, rows + 1), rows + most_items)
    return np.where((end == len(tokens)) & (rows + most_items > len(tokens)), len(tokens), end)


def reduced(tokens: np.ndarray, most_tokens: int, most_items: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the first rows: the batches that begin in the block if one begins there, and where the last of them does."""
    after, n = next_starts(tokens, most_tokens, most_items).tolist(), len(tokens)
    begun, last = [1] * n, list(range(n))
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            begun[i], last[i] = begun[after[i]] + 1, last[after[i]]
    return np.array(begun[:most_items], np.int64), np.array(last[:most_items], np.int64)


def first_start(head: np.ndarray, n: int, total: int, most_tokens: int, most_items: int) -> int:
    """The first row of a block at which a batch begins, if the open batch has n rows and so many tokens. head: tokens of the
    first rows. The number of rows or more: at none of them."""
    if not n:
        return 0
    return int(min(max(most_items - n, 0), np.searchsorted(np.cumsum(head), most_tokens - total, side="right")))


def batch_pack(rows: DataFrame, group: list[str], order: str, tokens: str, most_tokens: int = V.TOKENS_PER_BATCH, most_items: int = V.ITEMS_PER_BATCH, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(group, order, batch): greedy batches in order, from 0 in each group; without group columns all rows are one sequence. A
    batch closes before the row that would exceed its tokens or its items; a row of more tokens is a batch of its own. Null
    tokens are none. Equal rows in the order come in any order. An empty table gives no rows."""
    named = [f"__g{i}" for i in range(len(group))]
    narrow = rows.select(*(F.col(c).alias(a) for c, a in zip(group, named, strict=True)), F.col(order).alias("at"), F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0)).alias("t"))
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema.fields}
    keys = "".join(f"{a} {kinds[a]}, " for a in named)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks: rows of one group in one task."""
        held, seq, part = None, 0, 0  # of the rows that wait: key, tables

        def block(table: pa.Table) -> pa.RecordBatch:
            nonlocal seq
            t = table.column("t").to_numpy()
            begun, last = reduced(t, most_tokens, most_items)
            open_tokens = t.sum() - np.r_[0, np.cumsum(t)][last]
            one = {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32())} | {a: table.column(a).combine_chunks().slice(0, 1) for a in named}
            lists = {"begun": begun, "open_rows": len(t) - last, "open_tokens": open_tokens, "head": t[:most_items], "t": t}
            one |= {c: pa.array([v.astype(np.int64)], pa.list_(pa.int64())) for c, v in lists.items()}
            one |= {"n": pa.array([len(t)], pa.int64()), "total": pa.array([int(t.sum())], pa.int64())}
            at = table.column("at").combine_chunks()
            one["at"] = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), at)
            seq += 1
            return pa.RecordBatch.from_arrays([one[c] for c in columns], names=columns)

        for b in batches:
            if not b.num_rows:
                continue
            part = b.column("part")[0].as_py()
            change = np.zeros(b.num_rows, bool)
            for a in named:
                x = b.column(a).to_pylist()
                change[1:] |= np.fromiter((p != q for p, q in zip(x, x[1:], strict=False)), bool, b.num_rows - 1)
            edges = [0, *np.flatnonzero(change).tolist(), b.num_rows]
            for i, j in zip(edges, edges[1:], strict=False):
                key, piece = [b.column(a)[i].as_py() for a in named], pa.Table.from_batches([b.slice(i, j - i)])
                if held and held[0] != key:
                    yield block(held[1])
                    held = None
                held = key, piece if held is None else pa.concat_tables([held[1], piece])
                while held[1].num_rows > block_rows:
                    yield block(held[1].slice(0, block_rows))
                    held = key, held[1].slice(block_rows)
        if held:
            yield block(held[1])

    columns = ["part", "seq", *named, "begun", "open_rows", "open_tokens", "head", "n", "total", "at", "t"]
    dealt = narrow.repartitionByRange(*named, "at").sortWithinPartitions(*named, "at").withColumn("part", F.spark_partition_id())
    lists = "".join(f"{c} array<long>, " for c in ("begun", "open_rows", "open_tokens", "head"))
    blocks = dealt.mapInArrow(cut, f"part int, seq int, {keys}{lists}n long, total long, at array<{kinds['at']}>, t array<long>")
    path = scratch(rows.sparkSession, "blocks")
    blocks.write.parquet(path)
    blocks = rows.sparkSession.read.schema(blocks.schema).parquet(path)

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the open batch has when each block begins, and the number of the first batch that begins in it."""
        every = (r for b in batches for i in range(0, b.num_rows, 200) for r in b.slice(i, 200).to_pylist())
        for _, each in groupby(every, key=lambda r: [r[a] for a in named]):
            n = total = number = 0
            out = []
            for r in each:
                out.append((r["part"], r["seq"], n, total, number))
                s = first_start(np.array(r["head"], np.int64), n, total, most_tokens, most_items)
                if s >= r["n"]:
                    n, total = n + r["n"], total + r["total"]
                else:
                    n, total, number = r["open_rows"][s], r["open_tokens"][s], number + r["begun"][s]
                if len(out) >= 5000:
                    yield states(out)
                    out = []
            yield states(out)

    def states(rows: list[tuple]) -> pa.RecordBatch:
        names = ["part", "seq", "n0", "total0", "number"]
        kind = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kind)], names=names)

    functions = blocks.drop("at", "t")
    functions = functions.repartition(*named) if named else functions.repartition(1)  # a row for some thousand, as a stream
    entry = functions.sortWithinPartitions(*named, "part", "seq").mapInArrow(entered, "part int, seq int, n0 long, total0 long, number long")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                t = np.array(one.column("t")[0].as_py(), np.int64)
                n0, total0, number = (one.column(c)[0].as_py() for c in ("n0", "total0", "number"))
                s, after = first_start(t[:most_items], n0, total0, most_tokens, most_items), next_starts(t, most_tokens, most_items)
                begins = np.zeros(len(t), np.int64)
                while s < len(t):
                    begins[s] = 1
                    s = int(after[s])
                own = pa.array(np.zeros(len(t), np.int64))
                yield pa.RecordBatch.from_arrays([*(one.column(a).take(own) for a in named), one.column("at").flatten(), pa.array(number - 1 + np.cumsum(begins))], names=[*named, "at", "batch"])

    joined = blocks.select("part", "seq", *named, "at", "t").join(entry, ["part", "seq"])
    out = joined.mapInArrow(numbered, f"{keys}at {kinds['at']}, batch long")
    return out.select(*(F.col(a).alias(c) for c, a in zip(group, named, strict=True)), F.col("at").alias(order), "batch")
