"""What the n-gram join keeps on the driver, and the rounds that its classes take."""

import tracemalloc

import numpy as np
import pytest

from tidewater.llm import components as stars
from tidewater.llm import ngram_join


@pytest.fixture
def rounds(monkeypatch):
    """Rounds of contraction so far."""
    seen = []
    step = stars._large_star
    monkeypatch.setattr(stars, "_large_star", lambda edges: seen.append(1) or step(edges))
    return seen


def classes(df):
    return {(r["node"], r["component"]) for r in df.collect()}


def test_stars_take_no_round(spark, rounds):
    star = spark.createDataFrame([(1, 5), (9, 1), (1, 7), (2, 3), (4, 4), (5, 1)], "a long, b long")
    known = stars.components(star)
    assert classes(known) == {(5, 1), (9, 1), (7, 1), (3, 2)} and not rounds
    none = spark.createDataFrame([], "a long, b long")
    assert classes(ngram_join._joined(known, none)) == classes(known) and not rounds


def test_classes_go_on_from_known_ones(spark, rounds):
    rng = np.random.default_rng(0)
    label, known = np.arange(300), None
    for _ in range(3):
        links = rng.integers(0, 300, (60, 2))
        known = ngram_join._joined(known, spark.createDataFrame(links.tolist(), "a long, b long"))
        for a, b in links.tolist():
            label[label == max(label[a], label[b])] = min(label[a], label[b])
        assert classes(known) == {(k, int(x)) for k, x in enumerate(label) if k != x}
    assert rounds


def test_driver_passes_bits_on_as_they_come(spark):
    docs = spark.createDataFrame([(k, k, 3) for k in range(1000)] + [(-1, 7, 3)], "doc long, token long, n int")
    spark.sparkContext.broadcast(0)
    tracemalloc.start()
    twice, chosen = ngram_join._met_twice(docs), ngram_join._bits(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20  # the bits themselves are 16 and 2 MB
    twice, chosen = map(ngram_join._whole, (twice, chosen))
    assert twice.size == 1 << (ngram_join.TOKEN_BITS - 5) and np.flatnonzero(twice).tolist() == [0] and twice[0] == 1 << 7
    assert chosen.size == 1 << (ngram_join.FILTER_BITS - 5) and 990 <= np.bitwise_count(chosen).sum() <= 1001


def test_levels_by_parts():
    counts = np.random.default_rng(1).poisson(0.3, 1 << ngram_join.COUNTER_BITS).astype(np.uint32)
    counts[::5000] += np.arange(counts[::5000].size, dtype=np.uint32)
    parts = ngram_join._levels(ngram_join._chunks(counts))
    whole = b"".join(map(ngram_join.zlib.decompress, parts))
    assert (np.frombuffer(whole, np.uint8) == ngram_join.frequency_levels(counts)).all()
    assert ngram_join._levels([]) == []
