"""Byte-level BPE through the global shuffle of distinct pre-tokens of ``word_blocks``.

Every distinct pre-token of the corpus is encoded once, whatever the number of texts that hold it;
its ids are joined back and put in place by position. Decoding joins the token-byte table.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm.common import free_name, release_memory
from tidewatch.llm.word_blocks import Lists, lists_of, pack, schema_of, text_sequences, word_pages, words_in

# Fixed value: the characters that \s stands for in the encoder's own pattern language.
WHITE_SPACE = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@dataclass(frozen=True)
class Vocabulary:
    """Token bytes with their ranks (which are the ids), and the pattern that cuts texts."""

    ranks: dict[bytes, int]
    pattern: str

    @cached_property
    def encoding(self) -> tiktoken.Encoding:
        """Built once per Python worker, which holds the broadcast table."""
        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})

    @cached_property
    def cutter(self) -> regex.Pattern:
        """The pattern for Python, with white space spelled out since the two languages differ on it."""
        inside = self.pattern.replace(r"[^\s", f"[^{WHITE_SPACE}")
        return regex.compile(inside.replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]"))


def load_vocabulary(path: str, pattern: str) -> Vocabulary:
    """Reads a rank file on the driver; tasks get the table by broadcast, whose size the vocabulary fixes."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


_MARKS = pa.array(list(".,;:!?"))
# Bytes of packed sequences that are put together at once.
CHUNK = 400_000


class PreTokens:
    """Cuts texts into pre-tokens. What stands between two spaces is cut once for all texts that have it."""

    # A space inside or at the end of a longer run of white space is no boundary of its own.
    _inner_space = re.compile(r"\s (?:\s|\Z)")

    def __init__(self, pattern: regex.Pattern):
        self.pattern = pattern

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        parts = pc.split_pattern(texts, " ")
        offsets = np.asarray(parts.offsets, dtype=np.int64)
        coded = parts.values.dictionary_encode()
        pieces = coded.dictionary
        # Letters alone, or with one mark behind, need no pattern.
        marked = pc.is_in(pc.utf8_slice_codeunits(pieces, -1), value_set=_MARKS)
        letters = pc.if_else(marked, pc.utf8_slice_codeunits(pieces, 0, -1), pieces)
        plain = pc.utf8_is_alpha(letters)
        bases = pc.filter(letters, plain).dictionary_encode()
        words = pc.binary_join_element_wise(" ", bases.dictionary, "").to_pylist()
        number = dict(zip(words, range(len(words))))
        known = lambda found: [number.setdefault(w, len(number)) for w in found]
        plain, marked = plain.to_numpy(zero_copy_only=False), marked.to_numpy(zero_copy_only=False)
        mark_of = np.full(len(pieces), -1)
        ends = pc.filter(pc.utf8_slice_codeunits(pieces, -1), pa.array(plain & marked)).to_pylist()
        mark_of[plain & marked] = known(ends)
        others, other_sizes = array("i"), array("i")
        for p in pc.filter(pieces, pa.array(~plain)):
            others.extend(found := known(self.pattern.findall(" " + p.as_py())))
            other_sizes.append(len(found))
        size = np.where(plain, 1 + marked, 0)
        size[~plain] = np.frombuffer(other_sizes, np.int32)
        start = np.cumsum(size) - size
        flat = np.zeros(int(size.sum()), np.int32)
        flat[start[plain]] = np.asarray(bases.indices)
        flat[start[plain & marked] + 1] = mark_of[plain & marked]
        rest_of = np.ones(len(flat), bool)
        rest_of[start[plain]] = False
        rest_of[start[plain & marked] + 1] = False
        flat[rest_of] = np.frombuffer(others, np.int32)
        # The first piece of a text has no space before it, and a text with other white space around spaces is cut
        # whole: each text has a piece of its own that stands for the first or for all.
        firsts, first_sizes, whole = array("i"), array("i"), np.zeros(len(texts), bool)
        for i in range(len(texts)):
            text = texts[i].as_py()
            whole[i] = self._inner_space.search(text) is not None
            firsts.extend(found := known(self.pattern.findall(text if whole[i] else text.split(" ", 1)[0])))
            first_sizes.append(len(found))
        flat = np.concatenate((flat, np.frombuffer(firsts, np.int32)))
        size = np.concatenate((size, np.frombuffer(first_sizes, np.int32)))
        start = np.cumsum(size) - size
        codes = np.array(coded.indices, dtype=np.int32)
        # The texts in pieces are not needed from here on.
        n_pieces = len(pieces)
        del parts, coded, pieces, letters, bases, words, others, firsts
        codes[offsets[:-1]] = n_pieces + np.arange(len(texts))
        n = size.astype(np.int32)[codes]
        n[np.repeat(whole, np.diff(offsets)) & (codes < n_pieces)] = 0
        lengths = np.add.reduceat(n, offsets[:-1], dtype=np.int64) if len(texts) else n
        return lists_of(codes, start, n, flat), lengths, list(number)


def encode(docs: DataFrame, vocabulary: Vocabulary, keep: list[str], text: str = "text", name: str = "token_ids", binary: bool = False) -> DataFrame:
    """The columns ``keep`` of each row of ``docs`` with its token ids as array<int> in ``name``.

    With ``binary`` the ids are little-endian unsigned 32-bit integers in one binary instead.

    Equals encoding each match of the pattern by itself, without special tokens. Null and empty texts
    have no ids. Rows stay rows, whatever repeats. ``docs`` is read twice and should come from
    stored files; a difference between the two readings fails the job.
    """
    if name in keep:
        raise ValueError(f"column {name} is kept and made")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    source = docs.select(*[F.col(c) for c in keep], F.col(text).alias(body := free_name(docs, "_body")))
    cut = lambda texts: PreTokens(shared.value.cutter)(texts)

    kind = pa.binary() if binary else pa.list_(pa.int32())

    def encode_page(pages: pa.Table) -> pa.Table:
        """All entries of the words that fall on one page: each distinct word is encoded once."""
        encoder = shared.value.encoding
        known: dict[bytes, list[int]] = {}
        sizes_out, ids_out = [], []
        for sizes, data in zip(pages.column("_sizes").to_pylist(), pages.column("_words").to_pylist()):
            per_word, ids = [], []
            for word in words_in(sizes, data):
                found = known.get(word)
                if found is None:
                    found = known[word] = encoder.encode_ordinary(word.decode())
                per_word.append(len(found))
                ids += found
            sizes_out.append(pack(np.array(per_word, dtype=np.int64)))
            ids_out.append(pack(np.array(ids, dtype=np.int64)))
        return pa.table({"_block": pages.column("_block"), "_ranks": pages.column("_ranks"), "_sizes": pa.array(sizes_out, pa.binary()), "_ids": pa.array(ids_out, pa.binary())})

    def put_together(texts: pa.Table, pages: pa.Table) -> pa.Table:
        """The ids of one block's texts."""
        release_memory()
        lists, columns = Lists.of(pages, "_sizes", "_ids"), []
        for ranks, n in lists.chunks(texts.column("_sequence").to_pylist(), CHUNK):
            words = np.concatenate(([0], np.cumsum(lists.size[ranks])))
            ends = words[np.concatenate(([0], np.cumsum(n)))]
            ids = lists.joined(ranks).astype("<i4")
            if binary:
                columns.append(pa.array([ids[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary()))
            else:
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)))
        return texts.select(keep).append_column(name, pa.chunked_array(columns, kind))

    coded = word_pages(source.select(body), body, cut).groupBy("_page").applyInArrow(encode_page, "_block long, _ranks binary, _sizes binary, _ids binary")
    placed = text_sequences(source, body, keep, cut)
    return placed.groupBy("_block").cogroup(coded.groupBy("_block")).applyInArrow(put_together, f"{schema_of(source, keep)}`{name}` {'binary' if binary else 'array<int>'}")


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "token_ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for, in ``name`` (replaced if present).

    A broadcast join with the token-byte table, whose size the vocabulary fixes, done on the ids of a
    row where they lie. Ids are an array or a binary as ``encode`` makes them. Null ids stay null; an id beyond the table raises.
    """
    spark: SparkSession = encoded.sparkSession
    table = [b""] * (max(vocabulary.ranks.values(), default=-1) + 1)
    for b, i in vocabulary.ranks.items():
        table[i] = b
    shared = spark.sparkContext.broadcast(table)

    others = [c for c in encoded.columns if c != name]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*others).schema.fields] + [f"`{name}` binary"])

    def listed(row: pa.Scalar) -> list[int]:
        return np.frombuffer(row.as_buffer(), "<u4").tolist() if pa.types.is_binary(row.type) else row.values.to_pylist()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            rows = [None if not x.is_valid else b"".join(map(table.__getitem__, listed(x))) for x in batch.column(ids)]
            yield pa.record_batch([*batch.columns, pa.array(rows, pa.binary())], [*batch.schema.names, name])
            release_memory()

    return encoded.select(*others).mapInArrow(task, schema)
