"""Near-duplicates by the exact Jaccard similarity of word shingles, found with SimHash.

At a similarity of 0.8 two texts differ in about 15 of 100 SimHash bits, far beyond the budget of one 64-bit
fingerprint. So a text has a wide fingerprint of 32 prints of 40 bits, each a SimHash of its own: at 0.8 a pair is within
three bits in at least one of them with probability 0.986, at 0.85 with 0.9998. Each print has a trie
self-join: of two prints within three bits at least one of four blocks is equal, so each print stands in four tries, one
for each block at the top, and meets its partners below one top node (a unit). Units are walked
inside tasks, node pair by node pair, adding up differing bits and dropping pairs over the budget. What
is linked in a unit is a set; in each set all pairs whose wide fingerprints are near enough for the threshold are
compared by their shingles, nearest first, unless earlier links connect them already. So a large
group of copies takes about one comparison for each, and only true links, a forest of each set, leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import UPPER, bitmap, free_name, release_memory, small_side, text_tie
from tidewatch.llm.components import components
from tidewatch.llm.simhash import SEED, _star_labels, shingle_hashes
from tidewatch.session import cut_lineage

WIDTH = 5
SIMILARITY = 0.8
PRINTS, BITS, BUDGET = 32, 40, 3
WORDS = PRINTS * BITS // 64
# Texts up to which prints are cut into four blocks (heads of one block); beyond into five (heads of two).
FOUR_BLOCKS = 1 << 20
# Prints of a unit that one task walks; larger units are split by further blocks. Values compared without splitting a node pair.
UNIT = 2048
LEAF = 1024
PAIRS = 1 << 19
# Wide fingerprints further apart than this many standard deviations beyond the mean of the threshold are not compared.
SIGMAS = 3.5

_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_ODD = np.random.default_rng(SEED).integers(0, 2**63, (2, WORDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> set[bytes]:
    """The distinct runs of ``width`` words; of shorter texts the whole, of texts without words nothing."""
    words = (text or "").encode().translate(_LOWER).split()
    if len(words) <= width:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def similarity(a: set, b: set) -> float:
    """Jaccard similarity; one if both are empty."""
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def most_bits(least: float = SIMILARITY) -> int:
    """Differing bits of wide fingerprints up to which a pair may be as similar as ``least``."""
    share = math.acos(2 * least / (1 + least)) / math.pi
    n = PRINTS * BITS
    return math.ceil(n * share + SIGMAS * math.sqrt(n * share * (1 - share)))


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """For each of PRINTS * BITS hash functions, whether more than half of the distinct shingle hashes have the bit."""
    x = hashes[:, None] * _ODD[0]
    x ^= x >> np.uint64(29)
    x *= _ODD[1]
    x ^= x >> np.uint64(32)
    # Counts of all bits at once, as sums in binary: three rows of one weight make one of it and one of the next.
    now, weight, weights, planes = x, 0, [], []
    while len(now):
        carries = []
        while len(now) > 2:
            k = len(now) // 3
            a, b, c = now[:k], now[k : 2 * k], now[2 * k : 3 * k]
            odd = a ^ b
            carries.append((a & b) | (odd & c))
            now = np.concatenate((odd ^ c, now[3 * k :]))
        planes.append(now)
        weights += [1 << weight] * len(now)
        now, weight = np.concatenate(carries) if carries else now[:0], weight + 1
    bits = np.unpackbits(np.concatenate(planes).view(np.uint8), axis=1, bitorder="little") if planes else np.zeros((0, PRINTS * BITS), np.uint8)
    return np.packbits(2 * (np.array(weights, dtype=np.float64) @ bits) > len(hashes), bitorder="little").tobytes()


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wide, same = [], []
        for text in batch.column("_text").to_pylist():
            hashes = np.unique(shingle_hashes(text, WIDTH))
            wide.append(wide_fingerprint(hashes) if len(hashes) else None)
            same.append(xxhash.xxh64_intdigest(b" ".join((text or "").encode().translate(_LOWER).split()), SEED))
        same = pa.array(np.array(same, dtype=np.uint64).view(np.int64))
        yield pa.record_batch({"_id": batch.column("_id"), "_tie": batch.column("_tie"), "same": same, "wide": pa.array(wide, pa.binary())})
        release_memory()


def _prints(batches: Iterator[pa.RecordBatch], n_blocks: int) -> Iterator[pa.RecordBatch]:
    """(key, value, same): for each print and choice of top blocks its unit and the rest of its bits."""
    size = BITS // n_blocks
    heads = list(combinations(range(n_blocks), n_blocks - BUDGET))
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            raw = np.frombuffer(b"".join(batch.column("wide").to_pylist()), np.uint8).reshape(-1, PRINTS, BITS // 8).astype(np.int64)
            value = (raw << (8 * np.arange(BITS // 8))).sum(axis=2)
            blocks = [(value >> (size * i)) & ((1 << size) - 1) for i in range(n_blocks)]
            keys, rests = [], []
            for t, head in enumerate(heads):
                key, rest = np.arange(PRINTS) * len(heads) + t, np.zeros_like(value)
                for i in range(n_blocks):
                    if i in head:
                        key = (key << size) | blocks[i]
                    else:
                        rest = (rest << size) | blocks[i]
                keys.append(key)
                rests.append(rest)
            same = np.repeat(batch.column("same").to_numpy(), PRINTS * len(heads))
            yield pa.record_batch({"key": pa.array(np.stack(keys, axis=2).reshape(-1)), "value": pa.array(np.stack(rests, axis=2).reshape(-1)), "same": pa.array(same)})


def _split(rows: DataFrame, bits: int) -> DataFrame:
    """The prints of large units by one further block each: two within the budget share at least one of four."""
    edges = [bits * i // (BUDGET + 1) for i in range(BUDGET + 2)]
    parts = []
    for lo, hi in zip(edges[:-1], edges[1:]):
        block = F.shiftright("value", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
        rest = F.shiftleft(F.shiftright("value", hi), lo).bitwiseOR(F.col("value").bitwiseAND(F.lit((1 << lo) - 1)))
        parts.append(F.struct(F.xxhash64("key", F.lit(lo), block).alias("key"), rest.alias("value"), "same"))
    return rows.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def trie_pairs(starts: np.ndarray, ends: np.ndarray, value: np.ndarray, bits: int, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j within the budget, of each stretch of sorted values that ``starts`` and ``ends`` give.

    All stretches walk down together, a bit at a time. A pair of nodes with at most LEAF pairs of values is compared value by value.
    """
    a0, a1, b0, b1, diff = starts, ends, starts, ends, np.zeros(len(starts), np.int8)
    for bit in range(bits - 1, -2, -1):
        leaf = ((a1 - a0) * (b1 - b0) <= LEAF) if bit >= 0 else np.ones(len(a0), bool)
        la, lb, na, nb = a0[leaf], b0[leaf], (a1 - a0)[leaf], (b1 - b0)[leaf]
        # Some leaves at a time, and one at least.
        cuts = np.searchsorted(total := np.cumsum(na * nb), np.arange(PAIRS, int(total[-1]) if len(total) else 0, PAIRS))
        for part in np.split(np.arange(len(la)), np.unique(cuts)):
            n = na[part] * nb[part]
            own = np.repeat(part, n)
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            i, j = la[own] + k // nb[own], lb[own] + k % nb[own]
            near = (i < j) & (np.bitwise_count(value[i] ^ value[j]) <= budget)
            yield i[near], j[near]
        a0, a1, b0, b1, diff = (x[~leaf] for x in (a0, a1, b0, b1, diff))
        if not len(a0):
            return
        ones = np.concatenate(([0], np.cumsum((value >> bit) & 1)))
        am, bm, crossed = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0]), a0 != b0
        a0, a1, b0, b1, diff = (
            np.concatenate(x)
            for x in (
                (a0, am, a0, am[crossed]), (am, a1, am, a1[crossed]), (b0, bm, bm, b0[crossed]), (bm, b1, b1, bm[crossed]), (diff, diff, diff + 1, diff[crossed] + 1),
            )
        )
        live = (a1 > a0) & (b1 > b0) & (diff <= budget)
        a0, a1, b0, b1, diff = (x[live] for x in (a0, a1, b0, b1, diff))


def _linked_sets(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(set, first, same) of the linked sets of each unit; rows come sorted by unit. A set is named by its members."""
    held: list[pa.RecordBatch] = []

    def sets(rows: pa.Table) -> pa.RecordBatch:
        key, value, same = (rows.column(c).to_numpy() for c in ("key", "value", "same"))
        order = np.lexsort((value, key))
        key, value, same = key[order], value[order], same[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        pairs = list(trie_pairs(starts, np.concatenate((starts[1:], [len(key)])), value, bits))
        i, j = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*pairs))
        own, place = np.unique(np.concatenate((i, j)), return_inverse=True)
        label = _star_labels(len(own), place[: len(i)], place[len(i) :])
        order = np.lexsort((same[own], label))
        label, members = label[order], same[own][order]
        edges = np.flatnonzero(np.diff(label, prepend=-1, append=-1))
        names = [xxhash.xxh64_intdigest(members[lo:hi].tobytes(), SEED) for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist())]
        sizes = np.diff(edges)
        named = np.repeat(np.array(names, dtype=np.uint64).view(np.int64), sizes)
        return pa.record_batch({"set": pa.array(named), "first": pa.array(np.repeat(members[edges[:-1]], sizes)), "same": pa.array(members)})

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < 20 * UNIT:
            continue
        rows = pa.Table.from_batches(held)
        key = rows.column("key").to_numpy()
        # The last unit may go on in the next batch.
        if cut := int(np.searchsorted(key, key[-1])):
            yield sets(rows.slice(0, cut))
            held = rows.slice(cut).combine_chunks().to_batches()
            release_memory()
    if held and sum(b.num_rows for b in held):
        yield sets(pa.Table.from_batches(held))


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = pa.array([np.unique(shingle_hashes(t, WIDTH)).view(np.int64) for t in batch.column("_text").to_pylist()], pa.list_(pa.int64()))
        yield pa.record_batch({"same": batch.column("same"), "wide": batch.column("wide"), "shingles": rows})
        release_memory()


def similar_links(wide: np.ndarray, shingle_sets: list[np.ndarray], least: float = SIMILARITY) -> list[tuple[int, int]]:
    """A forest of similar pairs that connects all texts which similar pairs connect.

    Pairs are compared by their shingles, those with the nearest wide fingerprints first, unless they are connected.
    """
    n, most = len(wide), most_bits(least)
    first, second, bits = [], [], []
    step = max(1, PAIRS // (8 * n))
    for lo in range(0, n, step):
        far = np.bitwise_count(wide[lo : lo + step, None, :] ^ wide[None, :, :]).sum(axis=2, dtype=np.int32)
        i, j = np.nonzero(far <= most)
        keep = i + lo < j
        first.append(i[keep] + lo)
        second.append(j[keep])
        bits.append(far[i[keep], j[keep]])
    order = np.argsort(np.concatenate(bits), kind="stable")
    i, j = np.concatenate(first)[order], np.concatenate(second)[order]
    root, own, links = np.arange(n), {}, []

    def shingles_of(k: int) -> set[int]:
        if k not in own:
            own[k] = set(shingle_sets[k].tolist())
        return own[k]

    for at in range(0, len(i), 4096):
        # Of pairs that are connected by now nothing is to be learnt.
        a, b = i[at : at + 4096], j[at : at + 4096]
        open_ = root[a] != root[b]
        for x, y in zip(a[open_].tolist(), b[open_].tolist()):
            if root[x] != root[y] and similarity(shingles_of(x), shingles_of(y)) >= least:
                links.append((x, y))
                root[root == root[x]] = root[y]
    return links


def _similar_in_set(rows: pa.Table) -> pa.Table:
    wide = np.frombuffer(b"".join(rows.column("wide").to_pylist()), np.uint64).reshape(-1, WORDS)
    column = rows.column("shingles").combine_chunks()
    flat, edges = column.values.to_numpy(), column.offsets.to_numpy()
    links = similar_links(wide, [flat[a:b] for a, b in zip(edges[:-1], edges[1:])])
    same = rows.column("same").to_numpy()
    return pa.table({"a": pa.array(same[[x for x, _ in links]], pa.int64()), "b": pa.array(same[[y for _, y in links]], pa.int64())})


def candidate_sets(nodes: DataFrame) -> DataFrame:
    """(set, same): sets of some UNIT texts at most, which hold all pairs of texts that links within the budget of any print connect.

    Texts that sets connect, directly or by a chain, are one set if they are no more than UNIT: each of them stands in it once, and
    not once in each of its units. Beyond that the sets stay as they are.
    """
    sets = cut_lineage(_unit_sets(nodes))
    found = cut_lineage(components(sets.where("first <> same").select("first", "same").distinct(), "first", "same"))
    whole = found.select(F.col("root").alias("set"), F.col("node").alias("same")).union(found.select("root", "root").distinct())
    large = cut_lineage(found.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= UNIT).select(F.col("root").alias("set")))
    if large.isEmpty():
        return whole
    tied = whole.join(small_side(large), "set", "left_semi").select(F.col("same").alias("first"))
    return whole.join(small_side(large), "set", "left_anti").union(sets.join(tied, "first", "left_semi").select("set", "same"))


def _unit_sets(nodes: DataFrame) -> DataFrame:
    """(set, first, same): the linked sets of all units, ``first`` being one of the set."""
    n_blocks = 4 if nodes.count() <= FOUR_BLOCKS else 5
    bits = BITS * BUDGET // n_blocks
    rows = nodes.where("wide IS NOT NULL").select("same", "wide").mapInArrow(lambda b: _prints(b, n_blocks), "key long, value long, same long")
    sets = None
    while True:
        large = cut_lineage(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > UNIT))
        more = not large.isEmpty()
        small = rows.join(small_side(large), "key", "left_anti") if more else rows
        walked = small.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b, bits=bits: _linked_sets(b, bits), "set long, first long, same long")
        sets = walked if sets is None else sets.union(walked)
        if not more:
            return sets.distinct()
        rows = rows.join(small_side(large.select("key")), "key", "left_semi")
        if bits < 2 * (BUDGET + 1):
            break
        rows, bits = _split(rows, bits), bits - bits // (BUDGET + 1)
    # Texts that differ in next to no bit of a print: parts of half a unit, and a set of each two of them, so that every pair meets.
    firsts = rows.groupBy("key").agg(F.min("same").alias("first"), F.ceil(2 * F.count("*") / UNIT).alias("parts"))
    dealt = rows.join(firsts, "key").withColumn("part", F.pmod(F.xxhash64("same"), F.col("parts")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("other <> part")
    return sets.union(met.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("set"), "first", "same")).distinct()


def _keys(id_col: str, tie: str):
    """What names a document (rows that repeat id and text are one): a 64-bit hash."""
    return F.xxhash64(F.col(id_col).isNull(), id_col, tie)


def similar_roots(marks: DataFrame, docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(same, root) of all nodes that similar pairs link to a smaller one, from the marks of all rows."""
    # A null id orders last: min() over the pair would put it first.
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_tie")).alias("first")
    nodes = cut_lineage(marks.groupBy("same").agg(first, F.min("wide").alias("wide")))
    sets = cut_lineage(candidate_sets(nodes))
    # Only the texts of candidates are read again, and only those that a bitmap does not rule out are shuffled.
    needed = sets.select("same").distinct().join(nodes, "same")
    wanted = cut_lineage(needed.select("same", "wide", _keys("first._id", "first._tie").alias("key")))
    marked = bitmap(wanted, "key")

    @F.pandas_udf("boolean")
    def asked(keys: pd.Series) -> pd.Series:
        return pd.Series(marked.value.holds(keys.to_numpy()))

    tied = docs.select(F.col(text).alias("_text"), F.col(id_col).alias("_id"), text_tie(F.col(text)).alias("_tie"))
    found = tied.select("_text", _keys("_id", "_tie").alias("key")).where(asked("key"))
    contents = found.join(wanted, "key").dropDuplicates(["same"]).select("same", "wide", "_text").mapInArrow(_contents, "same long, wide binary, shingles array<long>")
    links = sets.join(contents, "same").groupBy("set").applyInArrow(_similar_in_set, "a long, b long")
    return components(links, "a", "b").withColumnRenamed("node", "same")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when of each component of similar texts the one with the smallest id is kept.

    Texts of equal words are one node. All columns stay, whatever their names. Null ids come last, then the smallest text
    hash decides; of rows that repeat id and text any one stays. Null and empty texts and those without words are one
    component. Very long texts count whole. An empty table gives an empty one.

    Rows that are alone in their component, which is most, stay where they are: only the others are shuffled.
    """
    source = docs.select(F.col(id_col).alias("_id"), text_tie(F.col(text)).alias("_tie"), F.col(text).alias("_text"))
    marks = cut_lineage(source.mapInArrow(_marks, f"_id {dict(docs.dtypes)[id_col]}, _tie long, same long, wide binary"))
    roots = similar_roots(marks, docs, id_col, text)
    rows = marks.select("same", "_id", "_tie").join(roots, "same", "left").withColumn("root", F.coalesce("root", "same"))
    order = F.struct(F.col("_id").isNull().alias("none"), "_id", "_tie")
    groups = rows.groupBy("root").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1")
    # The complement gives the join an exchange of its own, so that a component with very many copies can be split.
    at = F.bitwise_not("root").alias("at")
    shared = rows.select(at, _keys("_id", "_tie").alias("key")).join(groups.select(at, _keys("first._id", "first._tie").alias("first")), "at")
    verdicts = cut_lineage(shared.groupBy("key").agg(F.max((F.col("key") == F.col("first")).cast("int")).alias("stays")))
    marked = bitmap(verdicts, "key")

    @F.pandas_udf("boolean")
    def in_group(keys: pd.Series) -> pd.Series:
        return pd.Series(marked.value.holds(keys.to_numpy()))

    tie, key, flag, stays = (free_name(docs, n) for n in ("_tie", "_key", "_flag", "_stays"))
    keyed = docs.withColumn(tie, text_tie(F.col(text))).withColumn(key, _keys(id_col, tie)).withColumn(flag, in_group(key))
    alone = keyed.where(~F.col(flag)).select(*docs.columns)
    known = verdicts.select(F.col("key").alias(key), F.col("stays").alias(stays))
    judged = keyed.where(flag).join(known, key, "left").where(F.coalesce(F.col(stays), F.lit(1)) == 1)
    # What the bitmap took for shared and is not is one row a document; of the others one row of the first stays.
    return alone.union(judged.dropDuplicates([key]).select(*docs.columns))
