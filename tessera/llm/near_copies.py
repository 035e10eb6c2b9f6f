"""Near copies: rows whose sets of word shingles have at least a given Jaccard similarity, grouped by links.

SimHash alone does not reach texts of similarity 0.8: their fingerprints differ in some ten bits, and a covering ball of that
reach would hold a good part of all anchors. So the anchors of ``simhash`` make the first candidates, those within its
threshold, and the smallest hashes of the sets make the others: BANDS keys of BAND_HASHES minima each, of which two sets of
similarity s share one with probability 1 - (1 - s**BAND_HASHES)**BANDS, 0.998 for 0.8. All candidates are verified on
whole sets (of 32-bit hashes), so no pair below the similarity is linked.

Neither fingerprints nor keys give all pairs of a group. First each node is compared with the smallest one of the keys that
it shares most of. Then rounds compare every member of a key with the first one of its key and with the one before it, in
orders of their own for each key and round; only members that are not in one group yet, and pairs that were not compared
before, count. So candidates of a round grow with the rows of a group, not with their square. Keys with more than HOT
members are cut into parts, other ones in each round and for each key. From the second round on only keys whose members
are in different groups are left; in each part all pairs of different groups are looked at by sizes and parities, and
PARTNERS of those that may be similar are taken for each member, others in each round. A passage that many texts share
crowds keys with members that are not similar: these give no candidates. When a round finds no link, all that no round has
drawn is compared: every pair of members of a key that are in different groups still and may be similar, each part of the key
with itself and with each other part. So no pair that shares a key is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import checkpoint, joinable, released, settled, small, texts, trimmed, with_row_id
from tessera.llm.components import connected_components
from tessera.llm.tokens import mix

SEED = 42
SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_HASHES = 16, 5
#: Possible partners of a member of a key that a later round takes at most; the others are compared after the rounds.
PARTNERS = 16
#: Members of a part whose parities are compared with all others at once.
MEMBERS_AT_ONCE = 128
#: Members of a key that one task gets at most, about.
HOT = 1000
#: Texts whose sets are made in one step.
SETS_AT_ONCE = 500
#: Classes of shingles by hash whose parities are compared.
PARITIES = 512
#: Links of a round that one task joins; more are joined by rounds of their own.
LINKS_AT_ONCE = 100_000
#: Rounding room for products with the similarity.
EPS = 1e-9

_rng = np.random.default_rng(20240317)
_FACTOR = _rng.integers(1, 1 << 63, BANDS * BAND_HASHES, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_SHIFT = _rng.integers(1, 1 << 63, BANDS * BAND_HASHES, dtype=np.uint64)


def shingles(text: bytes, words_in_shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted hashes of the different shingles; a shorter text is one shingle, and so is a text without words."""
    words = text.lower().split()  # of bytes: A-Z, and the six ASCII white-space characters
    k = min(words_in_shingle, len(words))
    joined = b" ".join(words)
    if not k:
        return np.array([xxhash.xxh64_intdigest(b"", SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(first, last, strict=True)), np.uint64, len(first)))


def keys_of(found: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set of hashes."""
    low = np.full(len(_FACTOR), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 4096):
        low = np.minimum(low, mix((found[i : i + 4096] ^ _SHIFT[:, None]) * _FACTOR[:, None]).min(axis=1))
    rows = low.reshape(BANDS, BAND_HASHES)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(BAND_HASHES):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return key


def simhash_of(found: np.ndarray) -> int:
    """A bit is 1 if over half of the hashes have it."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(found), simhash.SHINGLES_AT_ONCE):
        ones += np.unpackbits(found[i : i + simhash.SHINGLES_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<u8")[0])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (key, part, node, root) sorted by key and part: pairs (a, b) of each row with the first one of its key and
    part and with the one before it, where their roots differ."""
    last = None  # key, part, node and root of the last row, node and root of the first one of its part
    for b in batches:
        if not b.num_rows:
            continue
        key, part, node, root = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "part", "node", "root"))
        same = np.r_[last is not None and (key[0], part[0]) == last[:2], (key[1:] == key[:-1]) & (part[1:] == part[:-1])]
        group = np.cumsum(~same) - 1  # -1: goes on from the batch before
        heads = np.flatnonzero(~same)
        at = heads[np.maximum(group, 0)] if len(heads) else np.zeros(len(key), np.int64)
        first, first_root = (np.where(group < 0, last[i] if last else 0, x[at]) for i, x in ((4, node), (5, root)))
        before, before_root = (np.r_[last[i] if last else 0, x[:-1]] for i, x in ((2, node), (3, root)))
        left, right = [], []
        for other, its_root in ((first, first_root), (before, before_root)):
            pair = same & (its_root != root)
            left.append(np.minimum(other, node)[pair])
            right.append(np.maximum(other, node)[pair])
        last = (key[-1], part[-1], node[-1], root[-1], first[-1], first_root[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (left, right)], names=["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Table]]:
    """Rows of each key and part, which are sorted by them and held one group at a time."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        key, part = (b.column(c).to_numpy() for c in ("key", "part"))
        heads = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        for i, j in zip(heads, np.r_[heads[1:], b.num_rows], strict=True):
            if held and (key[i], part[i]) != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = (key[i], part[i])
            held.append(b.slice(i, j - i))
    if held:
        yield last, pa.Table.from_batches(held)


def _possible(size_a, size_b, differ, similarity: float):
    """Whether sets may have this similarity, by their sizes and by how many of their parities differ, as columns or arrays: two
    sets differ in one element at least for each parity that differs."""
    both = size_a + size_b
    least, most = (F.least(size_a, size_b), F.greatest(size_a, size_b)) if isinstance(differ, Column) else (np.minimum(size_a, size_b), np.maximum(size_a, size_b))
    return (least >= similarity * most - EPS) & (differ <= (1 - similarity) / (1 + similarity) * both + EPS)


def _mates(own: np.ndarray, other: np.ndarray, root: np.ndarray, size: np.ndarray, parity: np.ndarray, similarity: float) -> np.ndarray:
    """Which members of two lists have different roots and may be similar."""
    differ = np.zeros((len(own), len(other)), np.int64)
    for word in range(parity.shape[1]):
        differ += np.bitwise_count(parity[own, word][:, None] ^ parity[other, word])
    return (root[own][:, None] != root[other]) & _possible(size[own][:, None], size[other], differ, similarity)


def _partners(node: np.ndarray, root: np.ndarray, size: np.ndarray, parity: np.ndarray, seed: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of members of one part that have different roots and may be similar: all of them where a member has PARTNERS at
    most, else the next ones behind it in a circle whose order the seed decides."""
    order = np.argsort(mix(node.view(np.uint64) ^ np.uint64(seed)))
    node, root, size, parity = node[order], root[order], size[order], parity[order].view(np.uint64)
    n, left, right = len(node), [], []
    for i in range(0, n, MEMBERS_AT_ONCE):
        own = np.arange(i, min(i + MEMBERS_AT_ONCE, n))
        row, at = np.nonzero(_mates(own, np.arange(n), root, size, parity, similarity))
        behind = np.lexsort(((at - own[row]) % n, row))
        row, at = row[behind], at[behind]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        left.append(node[own[row[rank < PARTNERS]]])
        right.append(node[at[rank < PARTNERS]])
    left, right = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (left, right))
    return np.minimum(left, right), np.maximum(left, right)


def _all_partners(side: np.ndarray, node: np.ndarray, root: np.ndarray, size: np.ndarray, parity: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (a, b) of members that have different roots and may be similar: of one part (side 0), or of the members of one part
    (side 1) with those of another (side 2). MEMBERS_AT_ONCE of the first ones at a time."""
    parity, first, second = parity.view(np.uint64), np.flatnonzero(side != 2), np.flatnonzero(side != 1)
    for i in range(0, len(first), MEMBERS_AT_ONCE):
        own = first[i : i + MEMBERS_AT_ONCE]
        some = _mates(own, second, root, size, parity, similarity)
        row, at = np.nonzero(some if side.any() else some & (own[:, None] < second))
        left, right = node[own[row]], node[second[at]]
        yield np.minimum(left, right), np.maximum(left, right)


def links(docs: DataFrame, words_in_shingle: int = SHINGLE_WORDS, similarity: float = SIMILARITY, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (rid, doc_id, node of each row; a node is a set of shingles) and groups (node, root of each node with a link).

    docs: rid, doc_id, text. Rows with equal sets are one node, so a hot text costs one row. rounds: at most so many, and nothing
    after them; by default until one finds no link, and then all pairs of different groups that share a key."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be over 0 and at most 1")
    kind = docs.schema["doc_id"].dataType.simpleString()

    @trimmed
    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, size, fp, keys, parity = [], [], [], [], []
            for t in texts(b.column(2)):
                found = shingles(t, words_in_shingle)
                node.append(xxhash.xxh3_64_intdigest(found.tobytes()))
                size.append(len(found))
                fp.append(simhash_of(found))
                keys.append(keys_of(found).view(np.int64))
                odd = np.bincount((found % PARITIES).astype(np.int64), minlength=PARITIES) & 1
                parity.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            node, fp = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, fp))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), node, pa.array(size, pa.int64()), fp, *(pa.array(x, pa.list_(pa.int64())) for x in (keys, parity))], names=["rid", "doc_id", "node", "size", "fp", "keys", "parity"])

    rows = checkpoint(docs.select("rid", "doc_id", "text").mapInArrow(sketches, f"rid long, doc_id {kind}, node long, size long, fp long, keys array<long>, parity array<long>"))
    # one row of each node stands for it: the others have the same set
    heads = checkpoint(rows.groupBy("node").agg(F.min("rid").alias("rid")))
    alone = checkpoint(rows.join(heads, ["node", "rid"], "left_semi").select("node", "rid", "size", "fp", "keys", "parity"))
    members = alone.select("node", F.explode("keys").alias("key"))
    crowds = checkpoint(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = checkpoint(members.join(crowds, "key").select("key", "node", F.ceil(F.col("n") / HOT).alias("parts")))

    def rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
        return members.withColumn("root", F.col("node")) if roots is None else members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def part_of(number: int) -> Column:
        return F.pmod(F.xxhash64("node", "key", F.lit(-number)), F.col("parts")).alias("part")

    def round_of(number: int, rooted: DataFrame) -> DataFrame:
        """Pairs (a, b) of members of a key with different roots."""
        order = F.xxhash64("node", "key", F.lit(number)) if number else F.col("node")
        dealt = rooted.select("key", part_of(number), "node", "root", order.alias("order")).repartition("key", "part").sortWithinPartitions("key", "part", "order", "node")
        return dealt.mapInArrow(_neighbours, "a long, b long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))

    def later_round(number: int, rooted: DataFrame) -> DataFrame:
        """Pairs (a, b) of members of a key with different roots that may be similar."""

        @trimmed
        def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, members in _groups(batches):
                seed = int(key[0]) + 0x9E3779B97F4A7C15 * number & (1 << 64) - 1
                node, root, size = (members.column(c).to_numpy() for c in ("node", "root", "size"))
                parity = members.column("parity").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _partners(node, root, size, parity, seed, similarity)], names=["a", "b"])

        dealt = rooted.select("key", part_of(number), "node", "root", "size", "parity").repartition("key", "part").sortWithinPartitions("key", "part", "node")
        return dealt.mapInArrow(partners, "a long, b long").distinct()

    def all_rounds(rooted: DataFrame) -> DataFrame:
        """All pairs (a, b) of members of a key with different roots that may be similar."""

        @trimmed
        def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, members in _groups(batches):
                side, node, root, size = (members.column(c).to_numpy() for c in ("side", "node", "root", "size"))
                parity = members.column("parity").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
                for pairs in _all_partners(side, node, root, size, parity, similarity):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], names=["a", "b"])

        own, other = F.col("own"), F.col("other")
        met = rooted.withColumn("own", part_of(0)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        side = F.when(own == other, 0).when(own < other, 1).otherwise(2)
        dealt = met.select("key", (F.least(own, other) * F.col("parts") + F.greatest(own, other)).alias("part"), side.alias("side"), "node", "root", "size", "parity")
        return dealt.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(partners, "a long, b long").distinct()

    def mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
        """Members of keys that have members with different roots, with their sizes and parities."""
        open_keys = rooted(members, roots).groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
        left = members.join(open_keys, "key", "left_semi")
        return checkpoint(left if "parity" in left.columns else left.join(alone.select("node", "size", "parity"), "node"))

    def joined(roots: DataFrame, new: DataFrame) -> DataFrame:
        """Roots after further links: only the groups that these touch are worked on."""
        edges = new
        for c in ("a", "b"):
            edges = edges.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
        merged = checkpoint(connected_components(edges.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")), "a", "b", LINKS_AT_ONCE))
        moved = roots.join(joinable(merged.select(F.col("node").alias("root"), F.col("root").alias("to"))), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        return checkpoint(moved.unionByName(merged.join(roots, "node", "left_anti")))

    # candidates of the anchors: fingerprints within the threshold, and nodes of one fingerprint
    prints = checkpoint(alone.groupBy("fp").agg(F.min("node").alias("low")))
    of_print = simhash.links(prints.select("fp"))
    for c in ("a", "b"):
        of_print = of_print.join(prints.select(F.col("fp").alias(c), F.col("low").alias(f"node_{c}")), c)
    of_print = of_print.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    of_print = of_print.unionByName(alone.join(prints, "fp").filter("node > low").select(F.col("low").alias("a"), F.col("node").alias("b"))).distinct()
    first = checkpoint(round_of(0, rooted(members, None)))
    near = checkpoint(of_print.withColumn("n", F.lit(BANDS).cast("long")))
    marks = alone.select("node", "rid", "size", "parity")

    @trimmed
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, SETS_AT_ONCE):
                part = b.slice(i, SETS_AT_ONCE)
                found = [np.unique(shingles(t, words_in_shingle).astype(np.uint32)).tobytes() for t in texts(part.column(1))]
                number = pc.list_value_length(part.column(2)).to_numpy()
                row, target = pa.array(np.repeat(np.arange(part.num_rows), number)), part.column(2).flatten()
                yield pa.RecordBatch.from_arrays([*(target.field(c) for c in ("leader", "part", "role")), part.column(0).take(row), pa.array(found, pa.binary()).take(row)], names=["leader", "part", "role", "node", "hashes"])

    @trimmed
    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by leader, part and role: the set of a leader, then those that are compared with it."""
        own = np.zeros(0, np.uint32)
        for b in batches:
            left, right = [], []
            for leader, role, node, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), strict=True):
                found = np.frombuffer(raw.as_buffer(), np.uint32)
                if not role:
                    own = found
                    continue
                both = len(np.intersect1d(own, found, assume_unique=True))
                if both >= similarity * (len(own) + len(found) - both) - EPS:
                    left.append(leader)
                    right.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (left, right)], names=["a", "b"])

    def verified(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links, and all pairs that were compared. Sizes and parities rule out most of what is not similar. A set then goes to the leaders that it is compared with; a leader's set, to the parts of its members."""
        for c in ("a", "b"):
            pairs = pairs.join(marks.select(F.col("node").alias(c), F.col("rid").alias(f"rid_{c}"), F.col("size").alias(f"size_{c}"), F.col("parity").alias(f"parity_{c}")), c)
        differ = sum((F.bit_count(F.col("parity_a")[i].bitwiseXOR(F.col("parity_b")[i])) for i in range(PARITIES // 64)), F.lit(0))
        possible = checkpoint(pairs.filter(_possible(F.col("size_a"), F.col("size_b"), differ, similarity)).select("a", "b", "rid_a", "rid_b"))
        parts = possible.groupBy("a", "rid_a").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("a", "b"), F.coalesce("parts", F.lit(1))).cast("int")
        if small(possible, HOT):  # so no leader has more than one part
            dealt = possible.withColumn("parts", F.lit(1))
        else:
            dealt = possible.join(joinable(checkpoint(parts.filter("parts > 1").select("a", "parts"))), "a", "left")
        members = dealt.select(F.col("rid_b").alias("rid"), F.col("b").alias("node"), F.struct(F.col("a").alias("leader"), part.alias("part"), F.lit(1).alias("role")).alias("target"))
        leaders = parts.select(F.col("rid_a").alias("rid"), F.col("a").alias("node"), F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.col("a").alias("leader"), i.alias("part"), F.lit(0).alias("role")))).alias("target"))
        targets = checkpoint(members.unionByName(leaders).groupBy("rid", "node").agg(F.collect_list("target").alias("targets")))
        dealt = docs.select("rid", "text").join(joinable(targets, lists="targets"), "rid").select("node", "text", "targets").mapInArrow(sets, "leader long, part int, role int, node long, hashes binary")
        return checkpoint(dealt.repartition("leader", "part").sortWithinPartitions("leader", "part", "role").mapInArrow(similar, "a long, b long")), possible.select("a", "b")

    meant = first.unionByName(near)
    # one candidate of each node first: in a group of copies the other ones then need no comparison
    best = meant.groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("a"))).alias("x")).select((-F.col("x.a")).alias("a"), "b")
    new, compared = verified(best)
    roots = checkpoint(connected_components(new, "a", "b", LINKS_AT_ONCE))
    number = 0
    while rounds is None or number < rounds:
        released(docs.sparkSession)
        number += 1
        if number > 1:
            members = mixed(members, roots)
            pairs = later_round(number, rooted(members, roots))
        else:
            pairs = round_of(number, rooted(members, roots)).select("a", "b")
            for c in ("a", "b"):
                near = near.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
            pairs = pairs.union(near.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")).distinct()
        new, tried = verified(pairs.join(compared, ["a", "b"], "left_anti"))
        compared = compared.unionByName(tried)
        if new.isEmpty():
            break
        roots = joined(roots, new)
    if rounds is None:
        released(docs.sparkSession)
        new, _ = verified(all_rounds(rooted(mixed(members, roots), roots)).join(compared, ["a", "b"], "left_anti"))
        if not new.isEmpty():
            roots = joined(roots, new)
    return rows.select("node", "rid", "doc_id"), roots


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The input with one row of each group of linked rows: the one with the smallest id. All columns stay.

    Two rows are linked if the sets of their shingles have at least this similarity. Null texts are empty; texts without
    words are equal. A null id is larger than any other; of rows with equal ids the first one stays. An empty table stays
    empty."""
    docs = settled(docs)
    plain = with_row_id(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))).select("rid", "doc_id", "text")
    rows, roots = links(plain, words_in_shingle, similarity)
    grouped = checkpoint(rows.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "rid", "doc_id"))
    low = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    dropped = checkpoint(grouped.join(low, "root").filter("rid <> low.rid").select(F.col("rid").alias("__rid")))
    return with_row_id(docs, "__rid").join(joinable(dropped), "__rid", "left_anti").drop("__rid")
