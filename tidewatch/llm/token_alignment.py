"""Alignment of two tokenizers over a corpus, each distinct text once.

Rows are shuffled by their full text, so that a text is tokenised and aligned once however many rows hold it.
Inside a block of texts the work goes by stretches between spaces (``units``): neither tokenizer has a token across
the space that begins one, so both have a token end there, and a stretch is tokenised and aligned once for all texts
of the block that hold it. Where ends of both tokenizers meet, a group closes; between two neighbouring ends of
either, one token of each overlaps: that is a link.

Corpus-wide counts of linked id pairs go through aggregates and joins on the pair: a block sends each of its
pairs once, with the number of its documents (weighted by their copies), and gets the total back.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import free_name
from tidewatch.llm.word_blocks import pack, pack_each, unpack, unpack_each
from tidewatch.session import scratch_path

# Characters after which a block of texts is closed.
BLOCK_CHARS = 6_000_000
# Stretches that are tokenised together, and bytes of packed sequences that are summed together.
UNITS = 50_000
CHUNK = 400_000
# Fixed value: the character that stands for a space in pieces.
PIECE_SPACE = "▁"

MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
# A space inside or behind other white space is no border.
_INNER_SPACE = re.compile(r"\s ")
_BORDER = re.compile(r"(?<=\S)(?= )")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Pair:
    """A byte-level BPE (the text of its JSON file) and a piece BPE with byte fallback (the bytes of its model file).

    The first must cut texts by the usual byte-level pattern and the second must leave characters as they are and have
    no piece with a space behind another character: then no token crosses a space that follows a
    non-space. ``load_pair`` checks the pieces.
    """

    byte_level: str
    pieces: bytes

    @cached_property
    def first(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(self.byte_level)
        tokenizer.encode_special_tokens = True
        return tokenizer

    @cached_property
    def second(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.pieces)

    @cached_property
    def first_bytes(self) -> list[bytes]:
        letters, vocabulary = byte_letters(), self.first.get_vocab(with_added_tokens=True)
        table = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            table[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        return table

    @cached_property
    def second_bytes(self) -> list[bytes]:
        p = self.second
        return [bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace(PIECE_SPACE, " ").encode() for i in range(p.get_piece_size())]

    @cached_property
    def labels(self) -> list[str]:
        """Decimal ids of both with what may stand behind them in a list of groups: first with , and |, second with , and ;"""
        return [f"{i}{mark}" for size, marks in ((len(self.first_bytes), ",|"), (len(self.second_bytes), ",;")) for mark in marks for i in range(size)]


def load_pair(byte_level_path: str, piece_path: str) -> Pair:
    """Reads both files on the driver; tasks get them by broadcast, whose size the vocabularies fix."""
    with open(byte_level_path, encoding="utf-8") as a, open(piece_path, "rb") as b:
        pair = Pair(a.read(), b.read())
    if json.loads(pair.byte_level)["pre_tokenizer"]["type"] != "ByteLevel":
        raise ValueError("the first tokenizer is not byte-level")
    fresh = Pair(pair.byte_level, pair.pieces)
    pieces = map(fresh.second.id_to_piece, range(fresh.second.get_piece_size()))
    if any(PIECE_SPACE in p.lstrip(PIECE_SPACE) for p in pieces):
        raise ValueError("the second tokenizer has pieces that hold a space behind another character")
    return pair


@dataclass
class Aligned:
    """Measures of each stretch, the ids of its groups as text, and its links as id pairs (first << 32 | second)."""

    whole: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[str]
    n_links: np.ndarray
    links: np.ndarray

    @classmethod
    def joined(cls, parts: list[Aligned]) -> Aligned:
        arrays = lambda name: np.concatenate([np.empty(0, np.int64), *(getattr(p, name) for p in parts)])
        whole = np.concatenate([np.empty(0, bool), *(p.whole for p in parts)])
        return cls(whole, arrays("n_a"), arrays("n_b"), arrays("n_groups"), [g for p in parts for g in p.groups], arrays("n_links"), arrays("links"))


def align(units: list[str], pair: Pair) -> Aligned:
    """Aligns stretches that begin with a space. One whose joined tokens differ from it is not ``whole`` and has none."""
    first = [e.ids for e in pair.first.encode_batch_fast(units, add_special_tokens=False)]
    second = pair.second.encode([u[1:] for u in units], num_threads=1)
    of_a, of_b = pair.first_bytes.__getitem__, pair.second_bytes.__getitem__
    # Without the rest of its text an empty stretch behind the space has no piece for it.
    second = [s or [pair.second.piece_to_id(PIECE_SPACE)] for s in second]
    whole = np.fromiter((b"".join(map(of_a, a)) == b"".join(map(of_b, b)) == u.encode() for a, b, u in zip(first, second, units)), bool, len(units))
    first = [a if w else [] for a, w in zip(first, whole)]
    second = [b if w else [] for b, w in zip(second, whole)]
    n_a, n_b = (np.fromiter(map(len, x), np.int64, len(units)) for x in (first, second))
    ids_a, ids_b = (np.fromiter((i for x in side for i in x), np.int64, int(n.sum())) for side, n in ((first, n_a), (second, n_b)))
    size_a, size_b = (np.fromiter(map(len, t), np.int64, len(t)) for t in (pair.first_bytes, pair.second_bytes))
    ends_a, ends_b = np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b])
    ends = np.union1d(ends_a, ends_b)
    at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    links = ids_a[at_a] << 32 | ids_b[at_b] if len(ends) else ends
    unit_a, unit_b = np.repeat(np.arange(len(units)), n_a), np.repeat(np.arange(len(units)), n_b)
    n_links = np.bincount(unit_a[at_a], minlength=len(units))
    closed = np.intersect1d(ends_a, ends_b, assume_unique=True)
    n_groups = np.bincount(unit_a[np.searchsorted(ends_a, closed)], minlength=len(units))
    # Ids in the order of the groups, each with the mark behind it.
    group_a, group_b = np.searchsorted(closed, ends_a), np.searchsorted(closed, ends_b)
    n, m = len(size_a), len(size_b)
    label_a = ids_a + n * (np.diff(group_a, append=-1) != 0)
    label_b = ids_b + 2 * n + m * (np.diff(group_b, append=-1) != 0)
    order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
    label, unit = np.concatenate((label_a, label_b))[order], np.concatenate((unit_a, unit_b))[order]
    texts, edges = list(map(pair.labels.__getitem__, label.tolist())), np.searchsorted(unit, np.arange(len(units) + 1)).tolist()
    groups = ["".join(texts[lo:hi])[:-1] for lo, hi in zip(edges[:-1], edges[1:])]
    return Aligned(whole, n_a, n_b, n_groups, groups, n_links, links)


def units_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts (with a space put before each) as numbers of stretches: all in a row, how many a text has, and the stretches."""
    parts = pc.split_pattern(texts, " ")
    coded = parts.values.dictionary_encode()
    codes, lengths = coded.indices.to_numpy().astype(np.int64), np.diff(parts.offsets.to_numpy()).astype(np.int64)
    units = [" " + u for u in coded.dictionary.to_pylist()]
    odd = [i for i, t in enumerate(texts.to_pylist()) if _INNER_SPACE.search(" " + t)]
    if not odd:
        return codes, lengths, units
    # Other white space around a space: such texts are cut by the pattern.
    number = {u: i for i, u in enumerate(units)}
    edges = np.concatenate(([0], np.cumsum(lengths)))
    rows = np.split(codes, edges[1:-1]) if len(lengths) else []
    for i in odd:
        rows[i] = np.array([number.setdefault(u, len(number)) for u in _BORDER.split(" " + texts[i].as_py())], dtype=np.int64)
    # Only stretches that are still used are worked on.
    codes, lengths, units = np.concatenate(rows), np.fromiter(map(len, rows), np.int64, len(rows)), list(number)
    used, codes = np.unique(codes, return_inverse=True)
    return codes, lengths, [units[i] for i in used.tolist()]


def _sums(values: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The sum of the values of each text's stretches; no text is without one."""
    return np.add.reduceat(values[codes], np.cumsum(lengths) - lengths) if len(lengths) else np.empty(0, np.int64)


def _expanded(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, in a row."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _align_block(number: int, rows: pa.Table, pair: Pair) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """Rows of the texts, and the row of the block with its pairs and their documents."""
    codes, lengths, units = units_of(rows.column("_body").combine_chunks())
    found = Aligned.joined([align(units[i : i + UNITS], pair) for i in range(0, len(units), UNITS)])
    good = _sums((~found.whole).astype(np.int64), codes, lengths) == 0
    measures = [np.where(good, _sums(x, codes, lengths), 0) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
    edges, digests = np.cumsum(lengths), []
    for hi, n, fine in zip(edges.tolist(), lengths.tolist(), good.tolist()):
        digests.append(sha256(";".join(map(found.groups.__getitem__, codes[hi - n : hi].tolist())).encode()).hexdigest() if fine else "")
    pairs, link = np.unique(found.links, return_inverse=True)
    # The documents of a pair: texts in which any stretch holds it, times their copies.
    copies = rows.column("_copies").to_numpy()
    starts = np.cumsum(found.n_links) - found.n_links
    documents = np.zeros(len(pairs), np.int64)
    at = np.flatnonzero(good)
    for part in np.split(at, np.searchsorted(np.cumsum(lengths[at]), np.arange(UNITS, int(lengths[at].sum()) + 1, UNITS))):
        own = codes[_expanded(edges[part] - lengths[part], lengths[part])]
        text = np.repeat(part, lengths[part])
        own, text = np.divmod(np.unique(own * len(good) + text), len(good))
        ranks = link[_expanded(starts[own], found.n_links[own])]
        ranks, text = np.divmod(np.unique(ranks * len(good) + np.repeat(text, found.n_links[own])), len(good))
        np.add.at(documents, ranks, copies[text])
    numbers = [pa.array(m) for m in measures]
    # Sequences name stretches by falling frequency, so that frequent ones take one byte.
    order = np.argsort(-np.bincount(codes, minlength=len(units)), kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    each = pack_each(rank[codes], lengths)
    used, size = documents > 0, found.n_links[order]
    lists = pack(link[_expanded(starts[order], size)])
    none = lambda kind: pa.nulls(len(good), kind)
    of_texts = [rows.column("_key").combine_chunks(), *numbers, pa.array(digests), pa.array(each, pa.binary()), none(pa.binary()), none(pa.list_(pa.int64())), none(pa.list_(pa.int32())), none(pa.list_(pa.int64()))]
    texts = pa.record_batch([pa.array(np.full(len(good), number)), *of_texts], STORED)
    ranks = np.flatnonzero(used).astype(np.int32)
    whole = [pa.nulls(1, k) for k in (pa.binary(), *[pa.int64()] * 4, pa.string())]
    block = pa.record_batch([pa.array([number]), *whole, pa.array([pack(size)], pa.binary()), pa.array([lists], pa.binary()), pa.array([pairs[used]]), pa.array([ranks]), pa.array([documents[used]])], STORED)
    return texts, block


STORED = ["_block", "_key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "_sequence", "_lists", "_pairs", "_ranks", "_documents"]
_STORED_TYPE = "_block long, _key binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, _sequence binary, _lists binary, _pairs array<long>, _ranks array<int>, _documents array<long>"


def _sum_up(rows: pa.Table, totals: pa.Table) -> pa.Table:
    """n_best and count_sum of the texts of one block from the totals of its pairs."""
    is_block = rows.column("_key").is_null()
    block, texts = rows.filter(is_block), rows.filter(pc.invert(is_block))
    size, link = unpack(block.column("_sequence")[0].as_py()), unpack(block.column("_lists")[0].as_py())
    rank = totals.column("_rank").to_numpy()
    count, best = (np.zeros(int(max(link.max(initial=-1), rank.max(initial=-1))) + 1, np.int64) for _ in range(2))
    count[rank], best[rank] = totals.column("_count").to_numpy(), totals.column("_best").to_numpy()
    ends = np.cumsum(size)
    per_unit = [np.diff(np.concatenate(([0], np.cumsum(x[link])))[np.concatenate(([0], ends))]) for x in (best, count)]
    sums: list[list[np.ndarray]] = [[], []]
    held, room = [], 0
    sequences = texts.column("_sequence").to_pylist()
    for i, s in enumerate(sequences):
        held.append(s)
        room += len(s)
        if room >= CHUNK or i == len(sequences) - 1:
            codes, lengths = unpack_each(held)
            for out, x in zip(sums, per_unit):
                out.append(_sums(x, codes, lengths))
            held, room = [], 0
    good = texts.column("groups_sha256").to_numpy(zero_copy_only=False) != ""
    sums = [np.where(good, np.concatenate([np.empty(0, np.int64), *x]), 0) for x in sums]
    kept = texts.select(["_key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    return kept.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))


def aligned_texts(docs: DataFrame, pair: Pair, text: str = "text") -> DataFrame:
    """(_key, measures, groups_sha256) of each distinct text that is not null or empty; _key is its SHA-256.

    The alignments are written once to the shared folder, so the shuffles that follow read them from there.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pair)
    body = F.col(text)
    # Copies are counted before the shuffle by the whole text.
    distinct = docs.where(body.isNotNull() & (body != "")).groupBy(body.alias("_body")).agg(F.count("*").alias("_copies"))
    keyed = distinct.select("_body", "_copies", F.unhex(F.sha2("_body", 256)).alias("_key"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n_blocks, rows, held = TaskContext.get().partitionId(), 0, [], 0

        def close() -> Iterator[pa.RecordBatch]:
            texts, block = _align_block((part << 32) | n_blocks, pa.Table.from_batches(rows), shared.value)
            yield from (texts.slice(i, 2000) for i in range(0, texts.num_rows, 2000))
            yield block

        for batch in batches:
            sizes, at = pc.utf8_length(batch.column("_body")).to_numpy(), 0
            while at < batch.num_rows:
                ends = np.cumsum(sizes[at:])
                take = min(int(np.searchsorted(ends, BLOCK_CHARS - held)) + 1, len(ends))
                rows.append(batch.slice(at, take))
                at, held = at + take, held + int(ends[take - 1])
                if held >= BLOCK_CHARS:
                    yield from close()
                    rows, held, n_blocks = [], 0, n_blocks + 1
        if rows:
            yield from close()

    path = scratch_path(spark, "alignments")
    keyed.mapInArrow(task, _STORED_TYPE).write.parquet(path)
    blocks = spark.read.parquet(path).where("_key IS NULL")
    entries = blocks.select("_block", F.explode(F.arrays_zip("_pairs", "_ranks", "_documents")).alias("e")).select(
        F.col("e._pairs").alias("_pair"), "_block", F.col("e._ranks").alias("_rank"), F.col("e._documents").alias("_n")
    )
    totals = entries.groupBy("_pair").agg(F.sum("_n").alias("_count")).withColumn("_a", F.shiftright("_pair", 32).cast("int"))
    highest = totals.groupBy("_a").agg(F.max("_count").alias("_highest"))
    totals = totals.join(highest, "_a").select("_pair", "_count", (F.col("_count") == F.col("_highest")).cast("int").alias("_best"))
    answers = entries.select("_pair", "_block", "_rank").join(totals, "_pair").select("_block", "_rank", "_count", "_best")
    rows = spark.read.parquet(path).select("_block", "_key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "_sequence", "_lists")
    kinds = "_key binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return rows.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(_sum_up, kinds)


def align_documents(docs: DataFrame, pair: Pair, text: str = "text") -> DataFrame:
    """``docs`` with the measures of the alignment of each text (columns of these names are replaced).

    n_a and n_b tokens, n_groups (a group ends where tokens of both end), n_links (pairs of tokens whose bytes overlap),
    n_best (links whose id pair stands in the most documents among the pairs of its first id, ties included), count_sum
    (over links, the number of documents that hold the id pair linked) and groups_sha256 of the ids of the groups.

    A space is put before each text. Null and empty texts, and those whose joined tokens are not the text, have
    zeros and an empty ``groups_sha256``, and add nothing to the counts. Rows stay rows: equal texts are worked on once, get equal
    answers and count as many documents as there are rows. An empty table gives an empty one; a very long text is a block of its own.
    """
    key = free_name(docs, "_text_key")
    made = [*MEASURES, "groups_sha256"]
    found = aligned_texts(docs, pair, text).withColumnRenamed("_key", key)
    others = [c for c in docs.columns if c not in made]
    held = docs.select(*others, F.unhex(F.sha2(F.col(text), 256)).alias(key))
    joined = held.join(found, key, "left")
    return joined.select(*others, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in MEASURES), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
