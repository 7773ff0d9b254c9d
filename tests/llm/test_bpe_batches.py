"""Many pre-tokens in one rank queue against one at a time and against the library."""

import random

import public_tokenizers
import pyarrow as pa
import tiktoken

from trendspark.llm import bpe
from trendspark.llm.common import batches_by_length

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_batch_equals_one_by_one():
    rng, ranks = random.Random(6), bpe.load_ranks(PATH)
    one = bpe.Encoder(ranks, PATTERN)
    pieces = {bytes(rng.choices(b"abcdehiou aaa", k=rng.randint(1, 40))) for _ in range(4_000)}
    pieces |= {"".join(rng.choices("äöß中😀étion", k=rng.randint(1, 20))).encode() for _ in range(1_000)}
    pieces |= {b"a" * n for n in range(1, 64)} | {b"abab" * n for n in range(1, 16)} | {bytes([b]) for b in range(256)}
    pieces = [p for p in pieces if p not in ranks]
    assert one.merge_many(pieces) == [one.merge(p) for p in pieces]
    assert not any(one.low)


def test_texts_equal_the_library():
    rng, ranks = random.Random(7), bpe.load_ranks(PATH)
    library = tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [" ".join("".join(rng.choices("abcdeéß'1,.", k=rng.randint(0, 12))) for _ in range(300)) for _ in range(40)]
    texts += ["", " ", "  a", "x" * 500 + " y", "don't  stop\n now 12345 " * 50]
    own = bpe.Encoder(ranks, PATTERN)
    own.learn_texts(texts)
    assert len(own.known) > bpe.FEW
    for text in texts:
        ids = library.encode_ordinary(text)
        assert [i for part in own.encode(text) for i in part] == ids
        parts = list(own.spelled(text))
        assert "".join(p[0] for p in parts) == "".join(f" {i}" for i in ids)
        assert b"".join(p[1] for p in parts) == text.encode() and sum(p[2] for p in parts) == len(ids)


def test_ids_alone_keep_no_spelling():
    rng, ranks = random.Random(8), bpe.load_ranks(PATH)
    library = tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [" ".join("".join(rng.choices("abcdeß'1,.", k=rng.randint(0, 12))) for _ in range(300)) for _ in range(40)]
    own = bpe.Encoder(ranks, PATTERN)
    own.learn_texts(texts, spelled=False)
    assert not own.known and len(own.cache) > bpe.FEW
    for text in texts:
        assert [i for part in own.encode(text) for i in part] == library.encode_ordinary(text)


def test_cached_ids_are_one_object_each():
    rng, ranks = random.Random(9), bpe.load_ranks(PATH)
    own = bpe.Encoder(ranks, PATTERN)
    own.learn_texts([" ".join("".join(rng.choices("abcdehiou", k=9)) for _ in range(3_000))], spelled=False)
    ids = [i for cached in own.cache.values() for i in cached]
    assert len(ids) > 3 * bpe.FEW and len({id(i) for i in ids}) <= 2 * len(set(ids))


def test_ids_are_decoded_in_slices(spark, monkeypatch):
    """Null, empty and long arrays, cut into slices of few ids at once."""
    texts = ["one two three", None, "", "word " * 300, "äöß 中 😀", "end"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    encoded = bpe.encode(docs, PATH, PATTERN).collect()
    rows = [(r["id"], None if r["id"] == 2 else list(r["ids"])) for r in encoded]
    arrays = spark.createDataFrame(rows, "id int, ids array<int>").coalesce(1)
    monkeypatch.setattr(bpe, "IDS_BYTES", 64)
    monkeypatch.setattr(bpe, "_shipped", lambda *_: lambda: bpe.Encoder(bpe.load_ranks(PATH), PATTERN))
    for r in bpe.decode(arrays, PATH, PATTERN).collect():
        assert bytes(r["decoded"]) == (b"" if r["id"] == 2 else (texts[r["id"]] or "").encode())
    batch = pa.RecordBatch.from_pydict({"ids": pa.array([i for _, i in rows], pa.list_(pa.int32()))})
    sizes = [sum(map(len, filter(None, part.column(0).to_pylist()))) for part in batches_by_length(iter([batch]), "ids", 16)]
    assert len(sizes) > 6 and all(n <= 16 for n in sizes if n < 300) and sum(sizes) == sum(len(i or ()) for _, i in rows)
