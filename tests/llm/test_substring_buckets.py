"""Which strings of a bucket are looked into."""

import numpy as np
import zstandard

from trendspark.llm import substring_dedup


def test_strings_with_a_minimiser_of_their_own_are_not_looked_into(monkeypatch):
    packer, package, other = zstandard.ZstdCompressor(), substring_dedup.Package(), substring_dedup.Package()
    package.add(b"a b c d", 1, 4, 0, 1, 2)      # alone
    package.add(b"a b c a b c", 2, 6, 0, 1, 5)  # its run comes twice in the text
    package.add(b"x y z u", 3, 9, 5, 1, 6)
    other.add(b"x y z v", 4, 4, 0, 1, 6)        # shares a run with the one before
    other.add(b"p q r", 5, 3, 0, 2, 8)          # in two rows
    looked, found = [], substring_dedup.repeated_windows
    monkeypatch.setattr(substring_dedup, "repeated_windows", lambda s, *rest: looked.extend(s) or found(s, *rest))
    packages = (package, other)
    ranges = substring_dedup.ranges_of_bucket([p.blob(packer) for p in packages], 3, [p.marks.tobytes() for p in packages])
    assert sorted(looked) == [b"a b c a b c", b"p q r", b"x y z u", b"x y z v"]
    # Two ranges of a string that touch are one only if their windows follow each other.
    assert sorted(map(tuple, ranges.to_numpy().tolist())) == [(2, 6, 0, 3), (2, 6, 3, 6), (3, 9, 5, 8), (4, 4, 0, 3), (5, 3, 0, 3)]


def test_runs_that_occur_twice():
    runs = np.array([5, 9, 5, 7, 1, 9], np.uint64)
    assert substring_dedup.occur_twice(np.array([1, 5, 9, 20], np.uint64), runs).tolist() == [False, True, True, False]
    assert not substring_dedup.occur_twice(runs[:2], runs[:2]).any()
