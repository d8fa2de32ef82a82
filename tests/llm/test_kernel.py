import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm.kernel import row_slices, shingle_sets, span_hashes, string_bytes, word_hashes, word_spans

TEXT = st.text(st.sampled_from("aB c\t\n\x0b\x0c\ré漢\x1c\u00a0"), max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    data, offsets = string_bytes(pa.array(texts, pa.string()))
    starts, ends, first = word_spans(data, offsets)
    got = [[data[a:b].tobytes().decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=5), st.integers(1, 4))
def test_shingle_sets_match_tuples(texts, width):
    data, offsets = string_bytes(pa.array(texts, pa.string()))
    sets = shingle_sets(data, offsets, width)
    plain = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        plain.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    assert [len(s) for s in sets] == [len(p) for p in plain]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(sets[i], sets[j])) == len(plain[i] & plain[j])


def test_slices_keep_rows_whole():
    offsets = np.cumsum([0, 5, 0, 100, 3, 3, 0])
    runs = list(row_slices(offsets, 6))
    assert [i for i, _ in runs][0] == 0 and runs[-1][1] == 6 and all(a[1] == b[0] for a, b in zip(runs, runs[1:], strict=False))


def test_hashes_do_not_depend_on_place():
    rng = random.Random(1)
    w = ["".join(rng.choices("abc", k=rng.randint(1, 40))) for _ in range(300)]
    data, offsets = string_bytes(pa.array([" ".join(w), " ".join(w[::-1])]))
    h, first = word_hashes(data, offsets)
    assert (h[: first[1]] == h[first[1] :][::-1]).all() and len(set(h.tolist())) == len(set(w))
    assert len(span_hashes(data, np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0
