"""What one bucket of the n-gram join takes, and that it finds the same."""

import tracemalloc

import numpy as np
import pyarrow as pa

from trendspark.llm import jaccard_join
from trendspark.llm.lm_score import pack, unpack


def bucket(rng, slices, sets, entries, values):
    blobs = []
    for _ in range(slices):
        names = np.sort(rng.choice(4 * sets, sets, replace=False)).astype(np.int64)
        ref = np.repeat(np.arange(sets, dtype=np.int32), entries)
        blobs.append(pack(names, names % 97 + 1, ref, rng.choice(values, len(ref)).astype(np.uint32)))
    return pa.table({"bucket": pa.array([0] * slices, pa.int64()), "blob": pa.array(blobs, pa.binary())})


def met(table):
    found = zip(table.column("range").to_pylist(), table.column("blob").to_pylist(), strict=True)
    return {r: [c.tolist() for c in unpack(b, *[np.int64] * 4)[:4]] for r, b in found}


def test_entries_of_a_bucket_meet_the_same_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    values = np.append(rng.integers(0, 1 << 32, 3000), [0, (1 << 32) - 1])
    table = bucket(rng, 5, 200, 3, values)
    whole = met(jaccard_join.meet(table, 4))
    monkeypatch.setattr(jaccard_join, "MEET", 100)
    assert met(jaccard_join.meet(table, 4)) == whole and sum(len(c[0]) for c in whole.values()) > 100


def test_memory_of_a_bucket_follows_its_packed_entries():
    rng = np.random.default_rng(4)
    table = bucket(rng, 16, 1000, 100, rng.integers(0, 1 << 32, 1 << 20))
    tracemalloc.start()
    jaccard_join.meet(table, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * 1_600_000
