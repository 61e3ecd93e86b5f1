"""Word hashes, planes, connected components against plain Python."""

import os
from pathlib import Path

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from baleprice.llm import words as W
from baleprice.llm.common import components, planes, released, unplanes

_TEXT = st.text(st.sampled_from("ab Aé\t\n\v \x00."), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(_TEXT, max_size=6))
def test_hashes_tell_words_apart(texts):
    h, bounds = W.word_hashes(*W.buffers(pa.array(texts, pa.string())))
    plain = [t.encode().split() for t in texts]
    assert np.diff(bounds).tolist() == [len(p) for p in plain]
    seen = {}
    for word, value in zip([w for p in plain for w in p], h.tolist()):
        assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_long_text_in_pieces_equals_whole(monkeypatch):
    text = ("alpha beta  gamma\n" * 500) + "x" * 3000 + " end"
    texts = pa.array(["", text, "tail words", None], pa.string()).fill_null("")
    whole = W.word_hashes(*W.buffers(texts))
    monkeypatch.setattr(W, "_PIECE", 1000)
    cut = W.word_hashes(*W.buffers(texts))
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_lower_case_and_slices():
    a = W.word_hashes(*W.buffers(pa.array(["x", "Ab cD", "É"]).slice(1, 2)), lower=True)[0]
    b = W.word_hashes(*W.buffers(pa.array(["aB Cd", "É"])), lower=True)[0]
    assert (a == b).all()


def test_rolling_depends_on_order_and_seed():
    h = np.arange(1, 9, dtype=np.uint64)
    assert len(W.rolling(h, 3, 5)) == 6 and len(W.rolling(h[:2], 3, 5)) == 0
    assert W.rolling(h[:3], 3, 5)[0] != W.rolling(h[:3][::-1].copy(), 3, 5)[0]
    assert W.rolling(h[:3], 3, 5)[0] != W.rolling(h[:3], 3, 7)[0]


def test_planes_round_trip():
    a = np.array([0, 1, -5, 2**62], np.int64)
    assert (unplanes(planes(a), np.int64) == a).all()
    b = np.array([1, 2**56 - 1], np.uint64)
    assert (unplanes(planes(b, 7), np.uint64, 7) == b).all()
    assert len(unplanes(b"", np.int64)) == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (100, 100), (7, 300), (-3, 101)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 1 for i in [*range(1, 41), 300]}, 100: -3, 101: -3, -3: -3}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_workers_hand_freed_memory_back():
    def held():
        return int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    pins = []

    def run(batches):
        for batch in batches:
            pieces = [np.ones(1 << 12) for _ in range(4000)]  # 32 KB each, of the heap
            pins.append(np.ones(1 << 12))  # lies above them, so that the heap can't shrink from its end
            yield batch + len(pieces)

    before = held()
    assert list(released(run)([1, 2])) == [4001, 4002]
    assert held() - before < 40 << 20
