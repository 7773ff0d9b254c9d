"""Cost-based allocation of the n-gram Jaccard join: whatever is rare, no link is lost."""

import numpy as np
import pytest

from trendspark.llm import jaccard_join


def linked_pairs(percent, number, largest, rng):
    """Pairs of sets that just link, of sizes up to ``largest``."""
    for _ in range(number):
        n = int(rng.integers(1, largest))
        whole = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        lost = int(rng.integers(0, n * (100 - percent) // 100 + 1))
        kept = len(whole) - lost
        fresh = max(0, kept * 100 // percent - len(whole))
        other = np.unique(np.concatenate([whole[lost:], rng.integers(0, 1 << 63, fresh).astype(np.uint64)]))
        common = len(np.intersect1d(whole, other))
        if len(other) and 100 * common >= percent * (len(whole) + len(other) - common):
            yield whole, other


@pytest.mark.parametrize("percent", [80, 85, 95])
@pytest.mark.parametrize("hot", [0.0, 0.5, 0.75, 0.95, 1.0])
def test_no_link_lost_whatever_is_hot(percent, hot):
    schemes, rng = jaccard_join.Schemes(percent), np.random.default_rng(int(percent + 100 * hot))
    steps = len(jaccard_join.STEPS)
    for whole, other in linked_pairs(percent, 400, 260, rng):
        # The step depends on the shingle alone, as in the join.
        kinds = rng.integers(1, steps + 1)

        def warm(s, kinds=kinds):
            mixed = jaccard_join.mix(s)
            low = (mixed >> np.uint64(40)).astype(np.int64) % 1000 < 1000 * hot
            return np.where(low, 1 + (mixed >> np.uint64(20)).astype(np.int64) % kinds, 0).astype(np.uint8)

        a = jaccard_join.entries(whole, schemes, warm(whole))
        b = jaccard_join.entries(other, schemes, warm(other))
        assert len(np.intersect1d(a, b)), (len(whole), len(other))


def test_sets_without_enough_segments_meet_under_their_band(monkeypatch):
    """All shingles in one segment of three, two of them different there: no subset or neighbour is shared."""
    monkeypatch.setattr(jaccard_join, "SMALL_SEEDS", 1)
    schemes, rng = jaccard_join.Schemes(80), np.random.default_rng(5)
    band = int(np.searchsorted(schemes.high, 9))
    m = int(schemes.segments[band])
    salt = jaccard_join.mix(np.array([band * 8 + 1], np.uint64))
    pool = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    segment = (jaccard_join.mix(pool ^ salt) >> np.uint64(33)).astype(np.int64) % m
    pool = pool[segment == 0]
    one, other = np.sort(pool[:10]), np.sort(np.concatenate([pool[:9], pool[10:11]]))
    a, b = (jaccard_join.entries(s, schemes) for s in (one, other))
    assert m == 3 and len(np.intersect1d(a, b))


def test_a_hot_shingle_alone_is_not_listed():
    """Unlike sets that share a passage of hot shingles share no entry."""
    schemes, rng = jaccard_join.Schemes(80), np.random.default_rng(7)
    passage = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    met = {True: 0, False: 0}
    for _ in range(100):
        sets = [np.unique(np.append(passage, rng.integers(0, 1 << 63, 200).astype(np.uint64))) for _ in range(2)]
        for steps in met:
            listed = [
                jaccard_join.entries(s, schemes, np.isin(s, passage).astype(np.uint8) * 4 if steps else None)
                for s in sets
            ]
            met[steps] += len(np.intersect1d(*listed)) > 0
    assert met[True] == 0 and met[False] > 0


def test_counts_cover_all_texts(spark):
    rows = [(i, f"a common line of six words and then {i} comes {i * 7} own {i * 13} text") for i in range(300)]
    found = jaccard_join.warmth(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "text", 4)
    hashes = jaccard_join.Hashes()
    line = jaccard_join.shingle_set(b"a common line of six words", hashes, 4)
    own = jaccard_join.shingle_set(b"comes 49 own 91 text", hashes, 4)
    assert found.shape == (jaccard_join.PLACES,)
    assert (found[jaccard_join.place_of(line)] == 4).all() and (found[jaccard_join.place_of(own)] == 0).all()
    empty = jaccard_join.warmth(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), "text", 4)
    assert not empty.any()
