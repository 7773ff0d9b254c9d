import tracemalloc

import zstandard

from trendspark.llm.substring_dedup import Package, unpack


def test_an_occurrence_takes_the_memory_of_its_five_numbers():
    package, n = Package(), 20_000
    tracemalloc.start()
    for i in range(n):
        package.add(b"one string", (i << 40) - 1, 1000 + i, 2000 + i, 1)
    taken = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert taken < 64 * n
    table, strings = unpack(package.blob(zstandard.ZstdCompressor()))
    assert strings == [b"one string"]
    assert table.T.tolist() == [[0, (i << 40) - 1, 1000 + i, 2000 + i, 1] for i in range(n)]
