import tracemalloc

import numpy as np
import pytest

from tidewatch.llm import word_blocks


def test_packing_a_block_takes_no_multiple_of_its_numbers():
    values = np.random.default_rng(1).integers(0, 30_000, 2_000_000).astype(np.int32)
    lengths = np.full(100, 20_000)
    tracemalloc.start()
    packed = word_blocks.pack_each(values, lengths)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * values.nbytes
    assert np.array_equal(word_blocks.unpack_each(packed)[0], values)


@pytest.mark.parametrize("at_once", [1, 3, 100_000])
def test_work_in_pieces_gives_the_same(monkeypatch, at_once):
    monkeypatch.setattr(word_blocks, "AT_ONCE", at_once)
    rng = np.random.default_rng(2)
    lengths = np.array([0, 0, 5, 0, 7, 1, 0])
    values = rng.integers(0, 40_000, 13)
    assert word_blocks.pack_each(values, lengths) == [word_blocks.pack(v) for v in np.split(values, np.cumsum(lengths)[:-1])]
    assert word_blocks.pack_each(values[:0], lengths[:2]) == [b"", b""] and word_blocks.pack_each(values[:0], lengths[:0]) == []
    size, codes = np.array([2, 0, 3]), rng.integers(0, 3, 20)
    start, flat = np.cumsum(size) - size, rng.integers(0, 99, 5)
    want = [x for c in codes for x in flat[start[c] : start[c] + size[c]]]
    assert word_blocks.lists_of(codes, start, size[codes], flat).tolist() == want
