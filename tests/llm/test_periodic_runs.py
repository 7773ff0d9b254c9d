"""Runs of words against a comparison of all places and periods."""

import hashlib
import random
import zlib

import pytest

from trendspark.llm import periodic_runs, queries


def plain_runs(words, least, times):
    n, found = len(words), set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size, part = j - i + q, words[i:j + q]
            if size >= max(least, times * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                found.add((i, size, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least,times", [(6, 4), (1, 2), (3, 3)])
def test_runs_of_random_words(least, times):
    rng = random.Random(least)
    for _ in range(700):
        most, n = rng.randint(0, 3), rng.randint(0, 70)
        words = [str(rng.randint(0, most)).encode() for _ in range(n)]
        if rng.random() < 0.6 and n:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(3, 10)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = periodic_runs.find_word_runs(words, least, times)
        assert [tuple(r) for r in found.tolist()] == plain_runs(words, least, times)


def test_long_texts():
    rng = random.Random(5)
    words = [b"w%d" % rng.randint(0, 300) for _ in range(30_000)]
    words[2_000:30_000] = [words[2_000 + i % 6_001] for i in range(28_000)]
    words[100:900] = [b"same"] * 800
    found = [tuple(r) for r in periodic_runs.find_word_runs(words).tolist()]
    assert found == [(100, 800, 1), (2_000, 28_000, 6_001)]
    kept = periodic_runs.collapse(words, periodic_runs.find_word_runs(words)).split()
    assert kept == words[:101] + words[900:8_001]


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, 6, 4)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        doc_id, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None,
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


COLUMNS = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()


def test_query_on_a_fixture(spark, tmp_path):
    """Every document of a small table, with odd rows and columns of clashing names."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("ab \u3000ü") for _ in range(rng.randint(0, 90)))) for i in range(150)]
    rows += [(3, rows[3][1]), (None, "x " * 30), (None, None), (200, ""), (201, " \n\t"), (202, "ab " * 9_000)]
    frame = spark.createDataFrame([(*r, "r", 1) for r in rows], "doc_id bigint, text string, runs string, start int")
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((plain_row(*r) for r in rows), key=repr)
    frame.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect() == []
