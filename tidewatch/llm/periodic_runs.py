"""Periodic runs of words, found with a dictionary of basic factors.

For each power of two L every stretch of L words gets a name, made from the names of its two halves; equal
stretches have equal names. The occurrences of a name that lie at most L/2 apart overlap so far that they form an
arithmetic progression. A run of period q (L <= q < 2L) repeats the stretch at its start q words later, and one
of the two occurrences opens its progression (otherwise the run would go on to the left). So each occurrence
is paired with the first members of the next and of the previous progressions less than 2L away: at most six
proposals a place, however periodic the text. Each proposal is extended both ways by descending through the
names, and equal runs are kept once, with their least period.

Documents are dealt with inside the task that reads them, many at a time; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import free_name
from tidewatch.llm.word_blocks import schema_of

# Runs shorter than this, or than two periods, do not count.
LEAST_WORDS = 12
# Words named at once; a document is never split, so a longer one is taken alone.
CHUNK_WORDS = 250_000
# Progressions within two lengths of a place: they begin more than half a length apart.
NEIGHBOURS = 3

RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


@dataclass
class Runs:
    """Maximal runs by document, start and period: places count words of all documents of the chunk in a row."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _proposals(names: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) pairs that occurrences propose; ``names`` and their places ``at`` are sorted."""
    breaks = np.concatenate(([True], (names[1:] != names[:-1]) | (2 * (at[1:] - at[:-1]) > width)))
    heads = np.flatnonzero(breaks)
    own, head_at, head_name = np.cumsum(breaks) - 1, at[heads], names[heads]
    places, periods = [], []
    for t in range(1, NEIGHBOURS + 1):
        ahead = np.flatnonzero(own + t < len(heads))
        ahead = ahead[head_name[own[ahead] + t] == names[ahead]]
        q = head_at[own[ahead] + t] - at[ahead]
        fit = (q >= width) & (q < 2 * width)
        places.append(at[ahead][fit])
        periods.append(q[fit])
        behind = np.flatnonzero(own >= t)
        behind = behind[head_name[own[behind] - t] == names[behind]]
        q = at[behind] - head_at[own[behind] - t]
        fit = (q >= width) & (q < 2 * width)
        places.append(head_at[own[behind] - t][fit])
        periods.append(q[fit])
    return np.concatenate(places), np.concatenate(periods)


def runs_of(words: np.ndarray, document: np.ndarray, least: int = LEAST_WORDS) -> Runs:
    """All runs of at least ``least`` words and two periods, from the words (as numbers) of documents in a row."""
    n, none = len(words), np.empty(0, np.int64)
    # Words of unlike documents never match, so no stretch repeats across a border.
    _, name = np.unique(document.astype(np.int64) * (int(words.max(initial=0)) + 1) + words, return_inverse=True)
    at, levels, found = np.arange(n), [], []
    width = 1
    while len(at):
        order = np.argsort(name, kind="stable")
        names, places = name[order], at[order]
        alike = names[1:] == names[:-1]
        again = np.concatenate((alike, [False])) | np.concatenate(([False], alike))
        names, places = names[again], places[again]
        if not len(names):
            break
        found.append(_proposals(names, places, width))
        dense = np.full(n, -1, np.int32)
        dense[places] = np.cumsum(np.concatenate(([0], names[1:] != names[:-1])))
        levels.append(dense)
        at = np.flatnonzero(dense[: max(0, n - width)] >= 0)
        at = at[dense[at + width] >= 0]
        name = dense[at].astype(np.int64) * (len(names) + 1) + dense[at + width]
        width *= 2
    place = np.concatenate([none, *(p for p, _ in found)])
    period = np.concatenate([none, *(q for _, q in found)])
    # Proposals of one period that lie closer than the stretches they matched belong to one run.
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    stretch = np.left_shift(1, np.frexp(period.astype(np.float64))[1].astype(np.int64) - 1)
    new = np.ones(len(place), bool)
    new[1:] = (period[1:] != period[:-1]) | (place[1:] - place[:-1] > stretch[1:])
    place, period = place[new], period[new]
    left, right = place.copy(), place.copy()
    for k in range(len(levels) - 1, -1, -1):
        size, dense = 1 << k, levels[k]
        live = np.flatnonzero(right + period + size <= n)
        a = dense[right[live]]
        right[live[(a >= 0) & (a == dense[right[live] + period[live]])]] += size
        live = np.flatnonzero(left >= size)
        a = dense[left[live] - size]
        left[live[(a >= 0) & (a == dense[left[live] - size + period[live]])]] -= size
    length = right - left + period
    long = length >= np.maximum(least, 2 * period)
    start, length, period = left[long], length[long], period[long]
    # A run found under a multiple of its period has the same borders.
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return Runs(start[order], length[order], period[order])


def _words(texts: pa.Array) -> pa.ListArray:
    """The words between white space of ASCII; null has none."""
    parts = pc.ascii_split_whitespace(texts.fill_null(""))
    full = pc.not_equal(pc.binary_length(parts.values), 0)
    ends = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))[parts.offsets.to_numpy()]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), parts.values.filter(full))


def _answer(words: pa.ListArray, least: int) -> tuple[pa.Array, pa.Array]:
    """The runs and the collapsed text of each document."""
    ends = words.offsets.to_numpy().astype(np.int64)
    coded = words.values.dictionary_encode()
    document = np.repeat(np.arange(len(words)), np.diff(ends))
    runs = runs_of(coded.indices.to_numpy().astype(np.int64), document, least)
    of = document[runs.start] if len(runs.start) else runs.start
    edges = np.searchsorted(of, np.arange(len(words) + 1)).astype(np.int32)
    rows = pa.StructArray.from_arrays([pa.array(runs.start - ends[of]), pa.array(runs.length), pa.array(runs.period)], list(RUN_TYPE.value_type.names))
    drop = np.zeros(len(document) + 1, np.int64)
    np.add.at(drop, runs.start + runs.period, 1)
    np.add.at(drop, runs.start + runs.length, -1)
    stays = np.cumsum(drop)[:-1] == 0
    kept = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(stays)))[ends].astype(np.int32)), words.values.filter(pa.array(stays)))
    return pa.ListArray.from_arrays(pa.array(edges), rows), pc.binary_join(kept, " ")


def find_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with every run of its words and the text without their repetitions (columns replaced if present).

    ``runs`` is an array of (start, length, period), by start, then period, in words from 0: the maximal stretches
    of at least ``least`` words and two periods, each with its smallest period. ``collapsed`` holds the words that
    no run contains after its first period, joined by one space.

    Null and empty texts have no runs and an empty ``collapsed``, never null. Rows stay rows, whatever their ids
    repeat; equal texts get equal answers; an empty table gives an empty one. Texts of any length are taken whole,
    by one task each, with memory linear in their words times the logarithm of the longest repeated stretch.
    """
    body = free_name(docs, "_body")
    keep = [c for c in docs.columns if c not in (runs, collapsed)]
    source = docs.select(*keep, F.col(text).alias(body))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # About one word in five bytes: chunks are closed by bytes before they are cut into words.
            size = pc.binary_length(batch.column(body).fill_null("")).to_numpy(zero_copy_only=False)
            chunk = (np.cumsum(size) - 1) // (5 * CHUNK_WORDS)
            for lo, hi in zip(edges := np.flatnonzero(np.diff(chunk, prepend=-2)), [*edges[1:], batch.num_rows]):
                part = batch.slice(lo, hi - lo)
                found, rest = _answer(_words(part.column(body)), least)
                yield pa.record_batch([*(part.column(c) for c in keep), found, rest], [*keep, runs, collapsed])

    kinds = f"`{runs}` array<struct<start:bigint,length:bigint,period:bigint>>, `{collapsed}` string"
    return source.mapInArrow(task, f"{schema_of(source, keep)}{kinds}")
