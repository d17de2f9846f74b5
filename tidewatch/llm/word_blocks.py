"""The global distinct-word shuffle that tokenisation and language-model scoring share.

Texts are cut into blocks of some megabytes. A block keeps, per text, the sequence of its words as
numbers into the block's own word list, and deals the list out by word in pages. A page gathers all
entries of its words over all blocks, so each distinct word of the corpus is worked on once; the
results travel back to the blocks, where the sequences put them in place. A word is one entry per
block however often its texts hold it, so no word is hot.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidewatch.llm.common import release_memory

# Characters of text after which a block is closed. A block's word list and sequences are held by one task.
BLOCK_CHARS = 8_000_000
# Word pages per shuffle partition: more pages mean smaller groups.
PAGES = 8
# Numbers of a block that are worked on together: what is made of them on the way is many times the numbers.
AT_ONCE = 100_000


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as groups of seven bits, low groups first."""
    v = values.astype(np.uint64)
    size = 1 + sum((v >= np.uint64(1 << 7 * i)).astype(np.int64) for i in range(1, 6))
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for i in range(int(size.max(initial=0))):
        has = size > i
        more = (size[has] > i + 1).astype(np.uint8) << 7
        out[at[has] + i] = ((v[has] >> np.uint64(7 * i)) & np.uint64(127)).astype(np.uint8) | more
    return out.tobytes()


def pack_each(values: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """``pack`` of each stretch of ``values``, done AT_ONCE numbers at a time."""
    edges, parts, done = np.concatenate(([0], np.cumsum(lengths))), [], 0
    ends = np.zeros(len(edges), np.int64)
    for lo in range(0, len(values), AT_ONCE):
        part = values[lo : lo + AT_ONCE]
        parts.append(pack(part))
        # A number ends with the byte whose high bit is not set.
        stops = np.flatnonzero(np.frombuffer(parts[-1], np.uint8) < 128)
        here = slice(np.searchsorted(edges, lo, "right"), np.searchsorted(edges, lo + len(part), "right"))
        ends[here] = done + 1 + stops[edges[here] - lo - 1]
        done += len(parts[-1])
    data = b"".join(parts)
    return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def lists_of(codes: np.ndarray, start: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that ``codes`` stand for, one after another, made for AT_ONCE codes at a time."""
    out, done = np.empty(int(size.sum()), flat.dtype), 0
    for lo in range(0, len(codes), AT_ONCE):
        n = size[lo : lo + AT_ONCE]
        stop = done + int(n.sum())
        out[done:stop] = flat[np.repeat(start[codes[lo : lo + AT_ONCE]] - (np.cumsum(n) - n), n) + np.arange(stop - done)]
        done = stop
    return out


def unpack_each(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all parts, one part after another, and how many each part has."""
    data = b"".join(parts)
    ends = np.concatenate(([0], np.cumsum(np.frombuffer(data, np.uint8) < 128)))[np.cumsum([0, *map(len, parts)])]
    return unpack(data), np.diff(ends)


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    out = np.zeros(len(last), np.int64)
    for i in range(int((last - first).max(initial=-1)) + 1):
        has = first + i <= last
        out[has] |= (raw[first[has] + i].astype(np.int64) & 127) << (7 * i)
    return out


# A cutter turns texts into numbers of words: those of all texts in a row, how many each text has, and the words.
Cutter = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, list[str]]]


@dataclass
class Block:
    number: int
    rows: pa.Table
    sequences: list[bytes]
    words: list[str]
    counts: np.ndarray


def blocks(batches: Iterator[pa.RecordBatch], text: str, cut: Cutter, counted: str | None = None) -> Iterator[Block]:
    """One partition's blocks. ``counts`` are those in rows whose column ``counted`` is true (all without it).

    Words are numbered by falling frequency, so that frequent ones take one byte. The block's number holds a
    checksum of all of this: were a lost task to see other rows when it runs again, its parts would
    not match those made before, and the job would stop instead of mixing them.
    """
    part, n_blocks = TaskContext.get().partitionId(), 0
    rows, held = [], 0

    def close() -> Block:
        table = pa.Table.from_batches(rows)
        numbers, lengths, words = cut(table.column(text).fill_null("").combine_chunks())
        order = np.argsort(-np.bincount(numbers, minlength=len(words)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        own = np.repeat(table.column(counted).to_numpy(zero_copy_only=False), lengths) if counted else slice(None)
        counts = np.bincount(numbers[own], minlength=len(words))
        words, packed = [words[i] for i in order.tolist()], pack_each(rank[numbers], lengths)
        del numbers
        mark = zlib.crc32(b"".join(packed), zlib.crc32("\0".join(words).encode()))
        return Block((part << 44) | (n_blocks << 32) | mark, table, packed, words, counts[order])

    for batch in batches:
        sizes, at = pc.utf8_length(batch.column(text).fill_null("")).to_numpy(zero_copy_only=False), 0
        while at < batch.num_rows:
            ends = np.cumsum(sizes[at:])
            take = min(int(np.searchsorted(ends, BLOCK_CHARS - held)) + 1, len(ends))
            rows.append(batch.slice(at, take))
            at, held = at + take, held + int(ends[take - 1])
            if held >= BLOCK_CHARS:
                yield close()
                rows, held, n_blocks = [], 0, n_blocks + 1
                release_memory()
    if rows:
        yield close()
    release_memory()


def schema_of(df: DataFrame, columns: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return "".join(f"`{c}` {kinds[c]}, " for c in columns)


def text_sequences(source: DataFrame, text: str, keep: list[str], cut: Cutter) -> DataFrame:
    """``keep``, _block, _sequence: a row per text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text, cut):
            kept = b.rows.select(keep).combine_chunks()
            out = kept.append_column("_block", pa.array([b.number] * len(b.sequences), pa.int64())).append_column("_sequence", pa.array(b.sequences, pa.binary()))
            yield from out.to_batches(max_chunksize=2000)

    return source.mapInArrow(task, f"{schema_of(source, keep)}_block long, _sequence binary")


def word_pages(source: DataFrame, text: str, cut: Cutter, counted: str | None = None) -> DataFrame:
    """_page, _block, _ranks (differences), _sizes, _words (bytes, compressed), _counts: a row per page and block."""
    n_pages = PAGES * int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ("_page", "_block", "_ranks", "_sizes", "_words", "_counts")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text, cut, counted):
            raw = [w.encode() for w in b.words]
            page = np.fromiter((zlib.crc32(w) % n_pages for w in raw), np.int64, len(raw))
            order = np.argsort(page, kind="stable")
            edges = np.flatnonzero(np.diff(page[order], prepend=-1))
            rows = []
            for lo, hi in zip(edges, [*edges[1:], len(order)]):
                ranks = order[lo:hi]
                own = [raw[i] for i in ranks]
                sizes = np.fromiter(map(len, own), np.int64, len(own))
                counts = pack(b.counts[ranks]) if counted else b""
                rows.append((int(page[ranks[0]]), b.number, pack(np.diff(ranks, prepend=0)), pack(sizes), zlib.compress(b"".join(own), 1), counts))
            kinds = [pa.int64()] * 2 + [pa.binary()] * 4
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(names))

    return source.mapInArrow(task, "_page long, _block long, _ranks binary, _sizes binary, _words binary, _counts binary")


def words_in(sizes: bytes, data: bytes) -> list[bytes]:
    """The words of a page's row."""
    raw, at, out = zlib.decompress(data), 0, []
    for n in unpack(sizes).tolist():
        out.append(raw[at : at + n])
        at += n
    return out


@dataclass
class Lists:
    """Per word of a block a list of numbers, and further numbers per word."""

    start: np.ndarray
    size: np.ndarray
    flat: np.ndarray
    also: np.ndarray | None

    @classmethod
    def of(cls, pages: pa.Table, sizes: str, flat: str, also: str | None = None) -> Lists:
        none = np.empty(0, np.int64)
        column = lambda c, f=unpack: np.concatenate([none, *map(f, pages.column(c).to_pylist())])
        rank = column("_ranks", lambda b: np.cumsum(unpack(b)))
        n = column(sizes)
        start, size, more = np.zeros(len(rank), np.int64), np.full(len(rank), -1, np.int64), None
        start[rank], size[rank] = np.cumsum(n) - n, n
        if also:
            more = np.zeros(len(rank), np.int64)
            more[rank] = column(also)
        return cls(start, size, column(flat), more)

    def chunks(self, sequences: list[bytes], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ranks and lengths of the sequences, some at a time: of about ``most`` bytes, and one at least."""
        held, size = [], 0
        for s in sequences:
            held.append(s)
            size += len(s)
            if size >= most:
                yield self._checked(held)
                held, size = [], 0
        if held:
            yield self._checked(held)

    def _checked(self, sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        r, n = unpack_each(sequences)
        if len(r) and (r.max() >= len(self.size) or (self.size[r] < 0).any()):
            raise RuntimeError("a block was read with other rows the second time; store the documents first")
        return r, n

    def joined(self, ranks: np.ndarray) -> np.ndarray:
        """The lists of these words, one after another."""
        n = self.size[ranks]
        return self.flat[np.repeat(self.start[ranks] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
