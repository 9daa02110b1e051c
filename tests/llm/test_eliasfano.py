"""Elias-Fano sequences against numpy."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cutline.llm.eliasfano import EliasFano, load, prefixed, save, sequence


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=60), st.integers(0, 63))
def test_small_sequences(values, shift):
    values = np.sort(np.array([v >> shift for v in values], np.uint64))
    ef = EliasFano(EliasFano.encode(values))
    assert (ef[np.arange(len(values))] == values).all()
    probe = np.array([*values.tolist(), *[max(int(v) - 1, 0) for v in values], *[min(int(v) + 1, 2**64 - 1) for v in values], 0, 2**64 - 1], np.uint64)
    assert (ef.successor(probe) == np.searchsorted(values, probe)).all()
    assert ((ef.find(probe) >= 0) == np.isin(probe, values)).all()


@pytest.mark.parametrize("top", [300_000, 2**40, 2**64 - 1])
def test_large_sequences_in_a_file(tmp_path, top):
    rng = np.random.default_rng(1)
    values = np.unique(np.concatenate([rng.integers(0, top, 200_000, dtype=np.uint64), np.arange(5000, dtype=np.uint64)]))
    save(str(tmp_path / "x"), {**prefixed("v", EliasFano.encode(values)), "more": np.arange(3)})
    held = load(str(tmp_path / "x"))
    ef = sequence(held, "v")
    assert held["more"].tolist() == [0, 1, 2]
    probe = rng.integers(0, top, 50_000, dtype=np.uint64)
    assert (ef.successor(probe) == np.searchsorted(values, probe)).all()
    assert (ef.find(values[::7]) == np.arange(0, len(values), 7)).all()
    bits = 8 * sum(v.nbytes for v in EliasFano.encode(values).values()) / len(values)
    assert bits < max(1, np.log2(top / len(values))) + 12
