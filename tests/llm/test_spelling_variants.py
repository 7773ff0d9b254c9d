"""Spelling variants against a comparison of all words, and the query against the words of whole texts."""

import random
import re
import zlib
from collections import Counter

import pytest

from trendspark.llm import queries, spelling_variants
from trendspark.llm.spelling_variants import group_variants

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(counts, least=2, ratio=10):
    words = {w: n for w, n in counts.items() if n >= least}
    form, near = {}, {}
    for w, n in words.items():
        own = [v for v in words if v != w and one_edit(v, w)]
        near[w] = len(own)
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), n, near[w], words.get(form[w])) for w, n in words.items()), key=repr)


def some_words(seed, many, letters="abcé"):
    """Words, their edits and anagrams, with counts that make forms of forms."""
    rng = random.Random(seed)
    counts = Counter()
    for _ in range(many):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(7, 10)))
        n = rng.choice([1, 2, 3, 30, 300, 4000])
        for _ in range(rng.randint(1, 5)):
            counts[word] += n
            at, kind = rng.randrange(len(word)), rng.randrange(4)
            shuffled = "".join(rng.sample(word, len(word)))
            word = [word[:at] + word[at + 1:], word[:at] + "z" + word[at:], word[:at] + "y" + word[at + 1:], shuffled][kind]
            n = max(1, n // rng.choice([1, 10, 12]))
    return counts


@pytest.mark.parametrize("cell", [spelling_variants.CELL, 16])
def test_groups(spark, monkeypatch, cell):
    """In one block per length, and with trees over cells, blocks and parts."""
    monkeypatch.setattr(spelling_variants, "CELL", cell)
    monkeypatch.setattr(spelling_variants, "ASKING", cell * 3)
    monkeypatch.setattr(spelling_variants, "SAMPLE", 200)
    monkeypatch.setattr(spelling_variants, "LEAF", 4)
    counts = some_words(1, 150)
    counts |= {"".join(w): 5 for w in {tuple(random.Random(i).sample("aaaabbbb", 8)) for i in range(300)}}
    counts |= {"x" * 40_000: 2, "x" * 40_001: 20, "x" * 39_999 + "y": 300}
    found = group_variants(spark.createDataFrame(list(counts.items()), "word string, n bigint"))
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect()), key=repr) == plain(counts)


def test_no_words(spark):
    assert group_variants(spark.createDataFrame([], "word string, n bigint")).collect() == []
    assert group_variants(spark.createDataFrame([("lonelyword", 9)], "word string, n bigint")).collect() == [
        ("lonelyword", None, "lonelyword", 9, 0, None)
    ]


def plain_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 7:
                counts[run] += 1
    return counts


def test_query_on_a_fixture(spark, tmp_path):
    rng = random.Random(2)
    words = list(some_words(3, 40, "abcdeÉé×")) + ["short", "UPPERCASE", "uppercasE", "ÀÉÎÕÜ\u00ff\u00fe"]
    often = [rng.choice([1, 1, 30]) for _ in words]
    rows = [(i, " ".join(rng.choices(words, often, k=60)) + ",_9 ") for i in range(120)]
    rows += [(3, rows[3][1]), (None, "Nullkeys nullkeys"), (None, None), (300, ""), (301, "日本語の言葉 repeated1repeated" * 9)]
    frame = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id bigint, text string, word string, n int")
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["op13_spelling_variants"](spark, str(tmp_path))
    assert found.columns == COLUMNS
    want = plain(plain_words(rows))
    assert sorted(map(tuple, found.collect()), key=repr) == want and any(r[1] for r in want)


def test_handed_on_in_parts(spark, monkeypatch):
    rows = [(i, f"alpha{'abcdefgh'[i % 8]}beta common word commonly") for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = sorted(map(tuple, spelling_variants.word_counts(frame).collect()))
    monkeypatch.setattr(spelling_variants, "WAITING", 2)
    assert sorted(map(tuple, spelling_variants.word_counts(frame).collect())) == whole
    assert ("commonly", 50) in whole
