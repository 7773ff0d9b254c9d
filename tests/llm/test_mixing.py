"""Mixes: targets, exact quotas, disjoint draws, and the splitting tree's distribution."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from trendspark.llm import mixing, queries
from trendspark.llm.mixing import Mix

SCHEMA = "doc_id bigint, source string, text string, size string, row int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Share by weight, cut at the limit, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, found = share * sum(sizes.values()), dict.fromkeys(names, 0.0)
    active = set(names) if total else set()
    while total > 1e-9 and active:
        unit = total / sum(weight[s] for s in active)
        total = 0
        for s in sorted(active, key=repr):
            found[s] += unit * weight[s]
            if found[s] >= most * sizes[s]:
                total += found[s] - most * sizes[s]
                found[s] = most * sizes[s]
                active.discard(s)
    return found


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    names = ["a", "b", None, "\U0001F600", "\uFF5A", "Z", "tiny"]
    many = [300, 40, 30, 60, 50, 20, 1]
    found, i = [], 0
    for name, n in zip(names, many, strict=True):
        for _ in range(n):
            i += 1
            found.append((i, name, " ".join(f"{i}.{k}" for k in range(rng.choice([0, 3, 40, 700])))))
    return found + [(5, "a", found[4][2]), (None, "a", "x y"), (990, "b", None), (991, "empty", " \n "), (992, "a", "w " * 9_000)]


def test_targets(spark, rows):
    got = {r["source"]: r for r in Mix(frame(spark, rows)).sources.collect()}
    sizes = Counter()
    for _, name, text in rows:
        sizes[name] += len((text or "").split())
    want = plain_targets(sizes)
    assert set(got) == set(want)
    for name, value in want.items():
        assert got[name]["source_size"] == sizes[name] and got[name]["target"] == pytest.approx(value, abs=1e-6)


@pytest.mark.parametrize("block,shards", [(16, 13), (1024, 1), (7, 200)])
def test_draws(spark, rows, monkeypatch, block, shards):
    """Every source to the word, no word twice in a pass, quotas of shards even, texts as cut."""
    monkeypatch.setattr(mixing, "BLOCK_WORDS", block)
    mix = Mix(frame(spark, rows), shards=shards, with_text=True)
    text_of = {r["row"]: r["text"] for r in mix.rows.collect()}
    pieces = mix.pieces.collect()
    taken, drawn, places = Counter(), defaultdict(set), defaultdict(list)
    for p in pieces:
        words = set(range(p["first_word"], p["first_word"] + p["words"]))
        assert not words & drawn[p["row"], p["pass"]]
        drawn[p["row"], p["pass"]] |= words
        taken[p["source_id"]] += p["words"]
        places[p["shard"]].append((p["place"], p["source_id"], p["draw"]))
        assert p["piece"].split() == text_of[p["row"]].split()[p["first_word"]:p["first_word"] + p["words"]]
    for s in mix.sources.collect():
        assert taken[s["source_id"]] == int(s["target"] + 0.5)
    assert set(places) <= set(range(shards))
    for own in places.values():
        assert sorted(p for p, _, _ in own) == list(range(1, len(own) + 1))
    every = mix.sources.agg({"quota": "sum"}).first()[0]
    sizes = Counter()
    for r in mix.dealt.collect():
        sizes[r["shard"]] += r["quota"]
    assert sum(sizes.values()) == every
    assert all(abs(sizes[s] - every / shards) < 2 for s in range(shards))


def test_query(spark, rows, tmp_path):
    """Sizes, targets and bounds; the same result whatever the files; an empty table."""
    found = []
    for parts in (1, 5):
        path = tmp_path / str(parts)
        frame(spark, rows).repartition(parts, "size" if parts == 1 else "doc_id").write.parquet(str(path / "documents.parquet"))
        got = queries.QUERIES["op12_mixing"](spark, str(path))
        assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
        found.append(sorted(map(tuple, got.collect()), key=repr))
    assert found[0] == found[1] and len(found[0]) == len(rows)
    assert all(0 <= r[4] <= 2 * r[1] for r in found[0])
    assert sorted(map(repr, ((r[0], r[1]) for r in found[0]))) == sorted(map(repr, ((i, len((t or "").split())) for i, _, t in rows)))
    frame(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.QUERIES["op12_mixing"](spark, str(tmp_path / "none")).collect() == []


def test_write_shards(spark, rows, tmp_path):
    mix = Mix(frame(spark, rows), shards=5, with_text=True)
    mix.write_shards(str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == mix.pieces.count() and back.filter("size(split(piece, ' ')) != words").isEmpty()


def test_permutation():
    for full in (1, 2, 3, 100, 1025):
        blocks = np.arange(full)
        ways = [mixing.slot_of(blocks, np.full(full, full), np.full(full, key)) for key in range(20)]
        assert all(sorted(w.tolist()) == blocks.tolist() for w in ways)
        assert full < 100 or len({tuple(w.tolist()) for w in ways}) == 20


def test_split_is_hypergeometric():
    """Means and variances of a node's draws over many seeds."""
    quota = np.array([500, 300, 200])
    left = np.array([mixing.split(0, 4, quota, seed) for seed in range(4_000)])
    assert (left.sum(axis=1) == 500).all()
    share = quota / 1000
    assert np.allclose(left.mean(axis=0), 500 * share, atol=1)
    assert np.allclose(left.var(axis=0), 500 * share * (1 - share) * 500 / 999, rtol=0.1)
