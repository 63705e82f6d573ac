"""Measures of the quality labellers against plain Python, and how often a pass goes over the words."""

import numpy as np
import pyarrow as pa

from voxloom.llm import quality
from voxloom.llm.toxicity import batches_of

TEXTS = ["", "a A b", "One two, two. Three | four!", "  \n", "ÀB 12 __ {x} é é", "x x", "x", "A?" * 9, None, "b\tb\fb B c"]


def plain(text: str) -> list[float]:
    data = (text or "").encode()
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in data).split()
    letters = sum(chr(c).isalpha() if c < 128 else True for c in data)
    n, size = max(1, len(words)), max(1, len(data))
    count = lambda marks: sum(c in marks for c in data)
    return [count(b"#$%&*@^~<>=_+{}[]\\") / size, sum(65 <= c <= 90 for c in data) / max(1, letters), count(b"|") / n, len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n, count(b".!?") / n, len(words)]


def test_measures_are_those_of_each_text():
    for data, bounds in batches_of(pa.array(TEXTS)):
        assert np.array_equal(quality.measures(data, bounds), np.array([plain(t) for t in TEXTS], float).T)


def test_a_pass_goes_over_the_words_once(monkeypatch):
    calls = []
    hashes = quality.word_hashes
    monkeypatch.setattr(quality, "word_hashes", lambda *a: calls.append(1) or hashes(*a))
    list(quality._count([pa.record_batch({"text": TEXTS})]))
    assert len(calls) == 1  # the count of votes needs no shapes
    data, bounds = next(batches_of(pa.array(TEXTS)))
    scores = quality.score(data, bounds, np.ones(quality.WIDTH + 1))
    assert len(calls) == 3 and [s > 0 for s in scores] == [bool((t or "").split()) for t in TEXTS]
