"""SimHash near-duplicates: fingerprints, and a binary trie self-join within a Hamming budget.

The join walks pairs of trie nodes. Its top is spread over tables: the 64 bits are cut into six
blocks, and of any two fingerprints within three bits at least three blocks are equal, so in one of
the 20 tables that put three blocks first the walk enters both through the same node. Below that
node pairs are split level by level, differing bits add up, and a pair over the budget is dropped.
Node pairs with many fingerprints are split as Spark rows; small ones are walked to the end inside a
task, many at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.common import UPPER, free_name, text_tie
from tidewatch.llm.components import components
from tidewatch.session import cut_lineage

SEED = 42
BUDGET = 3
BLOCKS = (11, 11, 11, 11, 10, 10)
# Bits by which large nodes are split, and fingerprints up to which a node pair is walked in one task.
STEP = 8
UNIT = 2048
VOTE_ROWS = 1 << 15

_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes of the ``width``-word shingles, repeats and all; of shorter texts one of the whole; none without words."""
    # A to Z and the six separators are single bytes in UTF-8 and part of no other character.
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    cuts = map(line.__getitem__, map(slice, starts[:n].tolist(), ends[width - 1 :].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, cuts, repeat(SEED)), np.uint64, n)


def voted(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), VOTE_ROWS):
        part = np.ascontiguousarray(hashes[i : i + VOTE_ROWS], dtype="<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the ``width``-word shingles (repeats count); zero without words."""
    return voted(shingle_hashes(text, width))


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint", width: int = 3) -> DataFrame:
    """``docs`` with the fingerprint as a (signed) long. Null and empty texts have fingerprint zero."""

    @F.pandas_udf("long")
    def marks(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn(name, marks(F.col(text)))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _tables() -> list[tuple[list[tuple[int, int]], int]]:
    """For each table its blocks as (low bit, width), those of the head first, and the head's width."""
    spans, low = [], 64
    for w in BLOCKS:
        low -= w
        spans.append((low, w))
    out = []
    for head in combinations(range(len(spans)), len(spans) - BUDGET):
        order = [*head, *(i for i in range(len(spans)) if i not in head)]
        out.append(([spans[i] for i in order], sum(spans[i][1] for i in head)))
    return out


TABLES = _tables()


def _permuted(fp: Column, order: list[tuple[int, int]]) -> Column:
    """The blocks of ``fp`` in another order, from the highest bit down."""
    out, left = F.lit(0).cast("long"), 64
    for low, width in order:
        left -= width
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1)), left))
    return out


def _prefix(p: Column, table: Column, level: int) -> Column:
    """The trie node of ``p`` on a level: level 0 is the head, each further one adds STEP bits."""
    depths = [min(64, head + STEP * level) for _, head in TABLES]
    shift = F.element_at(F.array(*[F.lit(64 - d) for d in depths]), table + 1)
    return F.call_function("shiftrightunsigned", p, shift)


def walk_pairs(unit: np.ndarray, side: np.ndarray, value: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (i, j) of all linked values of each unit; rows must be sorted by unit, side, value.

    A unit with one side joins it with itself, one with two sides joins side 0 with side 1. All
    units walk down together, one bit at a time. Values are distinct within a side.
    """
    value = value.astype(np.uint64)
    starts = np.flatnonzero(np.concatenate(([True], (unit[1:] != unit[:-1]) | (side[1:] != side[:-1]))))
    ends = np.concatenate((starts[1:], [len(unit)]))
    first = np.concatenate(([True], unit[starts[1:]] != unit[starts[:-1]]))
    paired = np.concatenate((~first[1:], [False])) & first
    alone = first & ~paired & (side[starts] == 0)
    a0, a1 = np.concatenate((starts[alone], starts[paired])), np.concatenate((ends[alone], ends[paired]))
    b0, b1 = np.concatenate((starts[alone], starts[1:][paired[:-1]])), np.concatenate((ends[alone], ends[1:][paired[:-1]]))
    diff = np.zeros(len(a0), np.int8)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for bit in range(63, -1, -1):
        if not len(a0):
            break
        ones = np.concatenate(([0], np.cumsum((value >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)))
        am, bm, own = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0]), a0 == b0
        crossed = ~own
        a0, a1, b0, b1, diff = (
            np.concatenate(parts)
            for parts in (
                (a0, am, a0, am[crossed]),
                (am, a1, am, a1[crossed]),
                (b0, bm, bm, b0[crossed]),
                (bm, b1, b1, bm[crossed]),
                (diff, diff, diff + 1, diff[crossed] + 1),
            )
        )
        live = (a1 > a0) & (b1 > b0) & (diff <= budget) & ((a0 != b0) | (a1 - a0 > 1))
        a0, a1, b0, b1, diff = a0[live], a1[live], b0[live], b1[live], diff[live]
        # Two single values need no further levels.
        done = (a1 - a0 == 1) & (b1 - b0 == 1)
        i, j = a0[done], b0[done]
        near = np.bitwise_count(value[i] ^ value[j]) <= budget
        found.append((i[near], j[near]))
        a0, a1, b0, b1, diff = a0[~done], a1[~done], b0[~done], b1[~done], diff[~done]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _star_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n values the smallest index linked with it."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def _walk_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of whole units from rows that are sorted by unit; one star per linked set."""
    held: list[pa.RecordBatch] = []

    def links(rows: pa.Table) -> pa.RecordBatch:
        key = np.stack([rows.column(c).to_numpy() for c in ("table", "level", "a", "b")])
        unit = np.concatenate(([0], np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0))))
        value = rows.column("p").to_numpy().view(np.uint64)
        fp, side = rows.column("fp").to_numpy(), rows.column("side").to_numpy()
        order = np.lexsort((value, side, unit))
        i, j = walk_pairs(unit[order], side[order], value[order])
        label, fp = _star_labels(len(order), i, j), fp[order]
        far = np.flatnonzero(label != np.arange(len(label)))
        return pa.record_batch({"x": fp[far], "y": fp[label[far]]})

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held)
        if rows.num_rows < 4 * UNIT:
            continue
        # The last unit may go on in the next batch; a unit has few rows, so what is held stays small.
        key = np.stack([rows.column(c).to_numpy() for c in ("table", "level", "a", "b")])
        same = (key == key[:, -1:]).all(axis=0)
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield links(rows.slice(0, cut))
            held = rows.slice(cut).combine_chunks().to_batches()
    if held:
        yield links(pa.Table.from_batches(held))


def trie_links(fingerprints: DataFrame, column: str = "fingerprint") -> DataFrame:
    """(x, y) links that connect all distinct fingerprints within the budget, as stars of each node pair.

    Not every pair is listed: within a node pair each linked set is a star, which keeps components
    and is linear in the fingerprints.
    """
    fp = F.col(column)
    rows = F.array(*[F.struct(F.lit(t).alias("table"), _permuted(fp, order).alias("p")) for t, (order, _) in enumerate(TABLES)])
    dealt = fingerprints.where(fp.isNotNull()).select(fp.alias("fp"), F.explode(rows).alias("_r")).select("fp", "_r.table", "_r.p")
    dealt = dealt.withColumn("head", _prefix(F.col("p"), F.col("table"), 0))
    shared = dealt.groupBy("table", "head").agg(F.count("*").alias("n")).where("n > 1")
    members = cut_lineage(dealt.join(shared.select("table", "head"), ["table", "head"], "left_semi").select("table", "p", "fp"))

    def nodes(level: int) -> DataFrame:
        return members.groupBy("table", _prefix(F.col("p"), F.col("table"), level).alias("node")).agg(F.count("*").alias("n"))

    top = nodes(0)
    pairs = top.select("table", F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).alias("diff"), F.col("n").alias("na"), F.col("n").alias("nb"))
    size = F.when(F.col("a") == F.col("b"), F.col("na")).otherwise(F.col("na") + F.col("nb"))
    units, level = [], 0
    while True:
        held = cut_lineage(pairs)
        small = held.where((size <= UNIT) & ((F.col("a") != F.col("b")) | (F.col("na") > 1)))
        units.append((level, small))
        large = held.where(size > UNIT)
        if large.isEmpty():
            break
        # Children of both nodes meet; each pair of nodes has at most 2^STEP children on a side.
        level += 1
        grown = [min(64, head + STEP * level) - min(64, head + STEP * (level - 1)) for _, head in TABLES]
        step = F.element_at(F.array(*[F.lit(g) for g in grown]), F.col("table") + 1)
        kids = nodes(level).withColumn("parent", F.call_function("shiftrightunsigned", F.col("node"), step))
        ka = kids.select("table", F.col("parent").alias("a"), F.col("node").alias("ca"), F.col("n").alias("ca_n"))
        kb = kids.select("table", F.col("parent").alias("b"), F.col("node").alias("cb"), F.col("n").alias("cb_n"))
        met = large.join(ka, ["table", "a"]).join(kb, ["table", "b"]).where((F.col("a") != F.col("b")) | (F.col("ca") <= F.col("cb")))
        # The xor of two nodes has the bits of all levels so far; heads are equal.
        met = met.withColumn("diff", F.bit_count(F.col("ca").bitwiseXOR(F.col("cb")))).where(F.col("diff") <= BUDGET)
        pairs = met.select("table", F.col("ca").alias("a"), F.col("cb").alias("b"), "diff", F.col("ca_n").alias("na"), F.col("cb_n").alias("nb"))

    work = None
    for lv, small in units:
        node = _prefix(F.col("p"), F.col("table"), lv)
        at = members.withColumn("node", node)
        ends = small.select("table", "a", "b", F.col("a").alias("node"), F.lit(0).alias("side")).union(
            small.where("a <> b").select("table", "a", "b", F.col("b").alias("node"), F.lit(1).alias("side"))
        )
        rows = ends.join(at, ["table", "node"]).select("table", F.lit(lv).alias("level"), "a", "b", "side", "p", "fp")
        work = rows if work is None else work.union(rows)
    keys = ["table", "level", "a", "b"]
    dealt_work = work.repartition(*keys).sortWithinPartitions(*keys)
    return cut_lineage(dealt_work.mapInArrow(_walk_task, "x long, y long").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (long) and component_id.

    ``component_id`` is the smallest id among the documents that links of at most three differing
    bits reach, itself included (null only where all those ids are null). Copies share a
    fingerprint and meet as one node. Texts without words have fingerprint zero and link like others.
    Repeated ids are rows of their own. Other columns are not carried.
    """
    marks = _marked(docs, id_col, text, width)
    rooted, classes = _classes(marks)
    named = rooted.join(classes, "root").select("fp", F.col("first._id").alias("component_id"))
    return marks.join(named, "fp").select(F.col("_id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay when of each component one row is kept, with all their columns.

    The row with the smallest id stays (ids that are null come last; ties: the smallest text hash; of
    rows that repeat id and text any one).
    """
    _, classes = _classes(_marked(docs, id_col, text, width))
    return keep_firsts(docs, classes, id_col, text)


def keep_firsts(docs: DataFrame, classes: DataFrame, id_col: str, text: str) -> DataFrame:
    """The rows of ``docs`` that are the ``first`` of a class, one for each."""
    kept = classes.select(F.col("first._id").alias("_id"), F.col("first._tie").alias("_tie"))
    a, b, c = (free_name(docs, n) for n in ("_key", "_no_key", "_tie"))
    left = docs.withColumn(c, text_tie(F.col(text))).withColumns({a: F.xxhash64(id_col), b: F.col(id_col).isNull()})
    right = kept.select(F.xxhash64("_id").alias(a), F.col("_id").isNull().alias(b), F.col("_tie").alias(c))
    return left.join(right, [a, b, c], "left_semi").dropDuplicates([a, b, c]).select(*docs.columns)


def _marked(docs: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    source = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    return cut_lineage(with_fingerprint(source, "_text", "fp", width).select("_id", "fp", text_tie(F.col("_text")).alias("_tie")))


def _classes(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fp, root) of all fingerprints, and (root, first) of all components."""
    # A null id orders last: min() over the pair would put it first.
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_tie")).alias("first")
    nodes = cut_lineage(marks.groupBy("fp").agg(first))
    roots = components(trie_links(nodes, "fp"), "x", "y").withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return rooted.select("fp", "root"), rooted.groupBy("root").agg(F.min("first").alias("first"))
