"""Exact Jaccard join of word n-gram sets, by pigeonhole over a partition of the universe.

Sizes fall into bands. For a band, two sets that link differ in H shingles at most; hashing cuts the
universe into H + 1 segments, so one segment at least is the same in both. A set is listed under the
hash of its subset in each segment that holds a rare shingle. The other segments, empty ones and those
whose list would be long, cost nothing that way and are paid for where it is cheap: a set with e of them
also lists the one-deletion neighbourhoods of its first segments with two rare shingles or more, e of
them. If all segments without a difference are bare of rare shingles, then one of these has exactly one
difference, and the neighbourhoods meet. Rare is what passes no step of frequency, counted over all
texts. A set that has too few segments with two rare shingles goes on to the next step, up to the one at which all
shingles are rare, and for the sake of sets that stayed below lists all neighbours with a shingle that
is rare there. A set that fails at the last step too lists all its neighbours and an entry of its band
that all such sets share; those of few shingles are listed under several hashes first, so that hardly one does.
So the cost follows the lengths of lists, and no link is lost.

Sets that share a list entry form candidate clusters. A cluster's centre, the set with most company,
is compared with all others; only sets that it does not reach are compared with the rest, block by
block. All comparisons count the exact intersection. Links are kept as forests, never as all pairs.

Defined results: null, empty and blank texts have no shingles, link with nothing and are their own
component; a text of fewer words than a shingle is one shingle; repeated rows and copies fall together
before anything is compared; a null id counts in its component but never names it.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.llm.common import as_bytes, batches_by_size, free, give_back, parts_for, total_bytes
from trendspark.llm.hashing import Hashes, mix, run_hashes, text_hash, word_codes
from trendspark.llm.lm_score import pack, unpack
from trendspark.operators.components import connected_components
from trendspark.session import materialize, scratch

WORDS, PERCENT = 4, 85
SLICE_BYTES = 1 << 22
#: Bytes of text whose list entries share a bucket.
BUCKET_BYTES = 1 << 24
#: Shingles of the sets that are compared in one block.
BLOCK_SHINGLES = 1 << 18
#: List entries of a bucket that are sorted at once.
MEET = 1 << 18
#: Bits of a set's place in its slice, and of a slice's number in its task.
PLACE_BITS, SLICE_BITS = 24, 19
#: Cells of the counts that bound differences; cells are named by eight bits.
CELLS = 256
#: Sets up to this size are listed under several hashes.
SMALL, SMALL_SEEDS = 64, 3
#: Places into which the counts of all shingles fall, and strips that they travel in.
PLACES, STRIPS = 1 << 20, 64
#: Steps of frequency, as multiples of the mean count of a place.
STEPS = (4, 16, 64, 256)
LISTED = "kind int, `{key}` {type}, set bigint, n bigint, bucket bigint, blob binary"


def bands(percent: int) -> list[tuple[int, int]]:
    """Smallest and largest size of each band; sizes that can link are in one band or in neighbours."""
    found, low = [], 1
    while low < 1 << 31:
        high = low * 100 // percent
        found.append((low, high))
        low = high + 1
    return found


class Schemes:
    """For each band the number of segments."""

    def __init__(self, percent: int) -> None:
        self.percent, self.bands = percent, bands(percent)
        self.high = np.array([high for _, high in self.bands])
        most = (self.high + self.high * 100 // percent) * (100 - percent) // (100 + percent)
        self.segments = most + 1

    def of(self, n: int) -> list[int]:
        """Bands whose scheme a set of ``n`` shingles is listed in: its own, and that below in reach."""
        own = int(np.searchsorted(self.high, n))
        below = own > 0 and n * self.percent <= 100 * self.high[own - 1]
        return [own, own - 1] if below else [own]


def shingle_set(data: bytes, hashes: Hashes, size: int = WORDS) -> np.ndarray:
    """Distinct shingles of a text as sorted hashes."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = word_codes(words, hashes)
    if len(words) < size:
        return mix(run_hashes(codes, len(words)) + np.uint64(len(words)))
    return np.unique(run_hashes(codes, size))


def warmth(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """Of each of ``PLACES`` places of shingle hashes, how many of ``STEPS`` its share of all shingles passes.

    Every task adds up its own counts and sends them in strips; the driver gets one number per place.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, found = Hashes(), np.zeros(PLACES, np.int64)
        for batch in batches_by_size(batches, text, SLICE_BYTES):
            for data in set(as_bytes(batch.column(text))):
                np.add.at(found, place_of(shingle_set(data, hashes, size)), 1)
        if found.any():
            strips = found.reshape(STRIPS, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(STRIPS), pa.int64()), pa.array([pack(s) for s in strips], pa.binary())],
                names=["strip", "blob"],
            )

    def add(table: pa.Table) -> pa.Table:
        total = sum(unpack(blob, np.int64)[0] for blob in table.column("blob").to_pylist())
        return pa.table({"strip": table.column("strip")[:1], "blob": pa.array([pack(total)], pa.binary())})

    schema = "strip bigint, blob binary"
    rows = docs.select(text).mapInArrow(count, schema).groupBy("strip").applyInArrow(add, schema).collect()
    found = np.zeros((STRIPS, PLACES // STRIPS), np.int64)
    for row in rows:
        found[row["strip"]] = unpack(row["blob"], np.int64)[0]
    mean = max(1, found.sum() / PLACES)
    return np.searchsorted(np.array(STEPS) * mean, found.ravel()).astype(np.uint8)


def place_of(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - PLACES.bit_length() + 1)).astype(np.int64)


def entries(shingles: np.ndarray, schemes: Schemes, warm: np.ndarray | None = None) -> np.ndarray:
    """Hashes under which a set is listed; ``warm`` holds the steps of its shingles, none if not given."""
    found, last = [], len(STEPS)
    warm = np.zeros(len(shingles), np.uint8) if warm is None else warm
    for band in schemes.of(len(shingles)):
        m, stuck = int(schemes.segments[band]), True
        for seed in range(SMALL_SEEDS if len(shingles) <= SMALL else 1):
            salt = np.array([band * 8 + seed + 1], np.uint64)
            mixed = mix(shingles ^ mix(salt))
            segment = (mixed >> np.uint64(33)).astype(np.int64) % m
            value = mix(mixed ^ np.uint64(0xD6E8FEB86659FD93))
            # Sums of halves stay exact in doubles.
            total = [
                np.bincount(segment, (value >> np.uint64(shift) & np.uint64(0xFFFFFFFF)).astype(np.float64), m)
                .astype(np.uint64)
                for shift in (0, 32)
            ]
            name = mix(np.arange(m, dtype=np.uint64) * np.uint64(4096) + salt)

            def listed(low, high, at, name=name):
                return mix(mix(low + name[at]) ^ high)

            # The first step at which enough segments hold two shingles of it or below.
            below = np.zeros(m, np.int64)
            for step in range(last + 1):
                rare = np.bincount(segment[warm <= step], minlength=m)
                wide = np.flatnonzero(rare >= 2)
                bare = m - np.count_nonzero(rare)
                if len(wide) >= bare:
                    stuck = False
                    break
                below = rare
            full = np.flatnonzero(rare)
            found.append(listed(total[0][full], total[1][full], full))
            picked = np.zeros(m, bool)
            picked[wide[:bare]] = True
            # Sets that came to terms with fewer steps look for these neighbours.
            limit = step if len(wide) >= bare else step + 1
            part = picked[segment] | (below[segment] > (warm < limit))
            if part.any():
                at, own = segment[part], value[part]
                found.append(
                    listed(total[0][at] - (own & np.uint64(0xFFFFFFFF)), total[1][at] - (own >> np.uint64(32)), at)
                )
        if stuck:
            found.append(mix(mix(np.array([band * 8], np.uint64)) ^ np.uint64(0xE7037ED1A0B428DB)))
    return np.unique(np.concatenate(found))


def list_entries(
    docs: DataFrame, buckets: int, key: str, text: str, size: int = WORDS, percent: int = PERCENT,
    warm: np.ndarray | None = None,
) -> DataFrame:
    """Rows of kind 0, one per document with its text's hash and number of shingles, and of kind 1,
    blobs of list entries for a bucket.

    In blobs a set goes by a number of its own, told as ``bucket`` of the first document in its slice: with more
    buckets a set has its entries in more of them, and its hash would be most of what travels.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = LISTED.format(key=key, type=kind)
    packed = pack(np.zeros(PLACES, np.uint8) if warm is None else warm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, schemes, steps = Hashes(), Schemes(percent), unpack(packed, np.uint8)[0]
        numbers = count(TaskContext.get().partitionId() << SLICE_BITS)
        for batch in batches_by_size(batches, text, SLICE_BYTES):
            texts, slice_ = as_bytes(batch.column(text)), next(numbers)
            sizes: dict[bytes, tuple[int, int]] = {}
            lengths, listed, nodes = [], [], [None] * len(texts)
            for row, data in enumerate(texts):
                if data not in sizes:
                    shingles = shingle_set(data, hashes, size)
                    sizes[data] = text_hash(data), len(shingles)
                    if len(shingles):
                        own = entries(shingles, schemes, steps[place_of(shingles)])
                        nodes[row] = slice_ << PLACE_BITS | len(lengths)
                        lengths.append(len(own))
                        listed.append(own)
            rows, column = len(texts), batch.column(key)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([0] * rows, pa.int32()), column, pa.array([sizes[t][0] for t in texts], pa.int64()),
                    pa.array([sizes[t][1] for t in texts], pa.int64()), pa.array(nodes, pa.int64()),
                    pa.nulls(rows, pa.binary()),
                ],
                names=["kind", key, "set", "n", "bucket", "blob"],
            )
            if not lengths:
                continue
            every = np.concatenate(listed)
            ref = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
            bucket = (every >> np.uint64(32)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            blobs, names = [], []
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                blobs.append(shrink(slice_, ref[part], (every[part] & np.uint64(0xFFFFFFFF)).astype(np.uint32)))
                names.append(int(bucket[part[0]]))
            rows = len(names)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([1] * rows, pa.int32()), pa.nulls(rows, column.type), pa.nulls(rows, pa.int64()),
                    pa.nulls(rows, pa.int64()), pa.array(names, pa.int64()), pa.array(blobs, pa.binary()),
                ],
                names=["kind", key, "set", "n", "bucket", "blob"],
            )

    return docs.select(key, text).mapInArrow(run, schema)


def shrink(slice_: int, ref: np.ndarray, entry: np.ndarray) -> bytes:
    """List entries of a slice for one bucket; ``ref``, the places of their sets in the slice, do not fall.

    Steps between places are small: their bytes of equal weight lie together, and the upper ones pack to nothing.
    """
    steps = np.diff(ref, prepend=ref.dtype.type(0))
    return pack(np.array([slice_], np.int64), steps.view(np.uint8).reshape(len(ref), -1).T, entry)


def expand(blob: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the sets, no sizes, and for each entry the index of its set and the entry."""
    slice_, steps, entry, _ = unpack(blob, np.int64, np.uint8, np.uint32)
    ref = np.ascontiguousarray(steps.reshape(4, -1).T).view(np.int32).ravel().cumsum(dtype=np.int32)
    place, own = np.unique(ref, return_inverse=True)
    return slice_ << PLACE_BITS | place, np.zeros(len(place), np.int64), own.astype(np.int32), entry.copy()


def sized(blob: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same of a blob that holds sets and their sizes itself."""
    return unpack(blob, np.int64, np.int64, np.int32, np.uint32)[:4]


def local_roots(one: np.ndarray, other: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of each node's component, for edges among ``n`` nodes."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, one, root[other])
        np.minimum.at(least, other, root[one])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def meet(table: pa.Table, ranges: int, read: Callable[[pa.Buffer], tuple] = sized) -> pa.Table:
    """Sets of one bucket that share an entry: blobs of (set, n, root, company) by range of the set.

    Entries are gone through ``MEET`` at a time, those of one hash together, so that memory follows
    the packed entries and not the arrays made of them.
    """
    sets, sizes, refs, listed, base = [], [], [], [], 0
    for blob in table.column("blob"):
        own, n, ref, entry = read(blob.as_buffer())
        sets.append(own)
        sizes.append(n)
        refs.append((ref, base))
        listed.append(entry)
        base += len(own)
    node, first, number = np.unique(np.concatenate(sets), return_index=True, return_inverse=True)
    size, number = np.concatenate(sizes)[first], number.astype(np.int32)
    parts = max(1, -(-sum(map(len, listed)) // MEET))
    company, trees = np.zeros(len(node), np.int64), [np.zeros((2, 0), np.int64)]
    for part in range(parts):
        low, high = (-(-(k << 32) // parts) for k in (part, part + 1))
        pairs = []
        for entry, (ref, of) in zip(listed, refs, strict=True):
            at = np.flatnonzero((entry >= low) & (entry <= high - 1))
            pairs.append(entry[at].astype(np.uint64) << np.uint64(32) | number[ref[at] + of].astype(np.uint64))
        pairs = np.unique(np.concatenate(pairs))
        if not len(pairs):
            continue
        entry, member = (pairs >> np.uint64(32)).astype(np.uint32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
        many = np.diff(np.append(begin, len(entry)))
        group = np.repeat(np.arange(len(begin)), many)
        company += np.bincount(member, many[group] - 1, len(node)).astype(np.int64)
        root = local_roots(member[begin[group]], member, len(node))
        grown = np.flatnonzero(root != np.arange(len(node)))
        trees.append(np.stack([grown, root[grown]]))
    root = local_roots(*np.concatenate(trees, axis=1), len(node))
    met = np.flatnonzero(company)
    part = (mix(node[met].astype(np.uint64)) >> np.uint64(33)).astype(np.int64) % ranges
    order = np.argsort(part, kind="stable")
    names, blobs = [], []
    for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []:
        at = met[rows]
        blobs.append(pack(node[at], size[at], node[root[at]], company[at]))
        names.append(int(part[rows[0]]))
    del sets, sizes, refs, listed, trees
    give_back()
    return pa.table({"range": pa.array(names, pa.int64()), "blob": pa.array(blobs, pa.binary())})


def gather(table: pa.Table) -> pa.Table:
    """Rows (node, company, root) of a range: one per set, with a null root, and one per distinct edge."""
    columns = [np.concatenate(c) for c in zip(
        *(unpack(b, np.int64, np.int64, np.int64, np.int64)[:4] for b in table.column("blob").to_pylist()), strict=True
    )]
    node, number = np.unique(columns[0], return_inverse=True)
    company = np.bincount(number, columns[3], len(node)).astype(np.int64)
    edges = np.unique(np.stack([columns[0], columns[2]])[:, columns[0] != columns[2]], axis=1)
    nothing = pa.nulls(edges.shape[1], pa.int64())
    return pa.concat_tables(
        [
            pa.table({"node": node, "company": company, "root": pa.nulls(len(node), pa.int64())}),
            pa.table({"node": edges[0], "company": nothing, "root": edges[1]}),
        ]
    )


def candidates(listed: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Sets that share a list entry with another, ``set, n, company``, and a forest ``a, b`` that connects them."""
    met = listed.filter("kind = 1").select("bucket", "blob").groupBy("bucket")
    met = met.applyInArrow(lambda t: meet(t, buckets, expand), "range bigint, blob binary")
    found = materialize(met.groupBy("range").applyInArrow(gather, "node bigint, company bigint, root bigint"))
    names = listed.filter("kind = 0 and bucket is not null").select(F.col("bucket").alias("node"), "set", "n")
    # Copies of a text in several slices have a number each, and the same company.
    sets = found.filter("root is null").join(names, "node").groupBy("set").agg(
        F.max("n").alias("n"), F.max("company").alias("company")
    )
    roots = names.select(F.col("node").alias("root"), F.col("set").alias("b"))
    edges = found.filter("root is not null").join(names, "node").join(roots, "root")
    return sets, edges.select(F.col("set").alias("a"), "b").filter("a != b").distinct()


class Sets:
    """Shingle sets of one block, for finding all that link with one of them.

    Sets lie in order of size, so that those of fitting size are one stretch. Counts of shingles by
    cell bound the differences of two sets from below; what the bound leaves is counted exactly.
    """

    def __init__(self, texts: list[bytes], size: int, percent: int) -> None:
        hashes, self.percent = Hashes(), percent
        found = [shingle_set(t, hashes, size) for t in texts]
        self.at = sorted(range(len(found)), key=lambda i: len(found[i]))
        self.place = np.argsort(self.at)
        found = [found[i] for i in self.at]
        self.sizes = np.array([len(f) for f in found], np.int64)
        self.names, ids = np.unique(np.concatenate(found), return_inverse=True)
        self.ids = np.split(ids, np.cumsum(self.sizes)[:-1])
        self.mark = np.zeros(len(self.names), np.int64)
        cell = (mix(self.names) >> np.uint64(56)).astype(np.int64)
        self.cells = np.stack([np.bincount(cell[own], minlength=CELLS) for own in self.ids]).astype(np.int32)
        self.coarse = self.cells.reshape(len(found), CELLS // 8, 8).sum(axis=2, dtype=np.int32)

    def linked(self, one: int) -> list[int]:
        """The sets that link with set ``one``, itself included."""
        own = int(self.place[one])
        n, p = int(self.sizes[own]), self.percent
        low = int(np.searchsorted(self.sizes, -(-n * p // 100)))
        high = int(np.searchsorted(self.sizes, n * 100 // p, side="right"))
        near = np.arange(low, high)
        # Few coarse cells part most unlike sets, fine ones the rest.
        for cells in (self.coarse, self.cells):
            least = np.abs(cells[near] - cells[own]).sum(axis=1)
            near = near[(100 + p) * least <= (100 - p) * (self.sizes[near] + n)]
        self.mark[self.ids[own]] = 1
        common = np.array([self.mark[self.ids[j]].sum() for j in near.tolist()])
        self.mark[self.ids[own]] = 0
        good = near[100 * common >= p * (self.sizes[near] + n - common)]
        return [self.at[j] for j in good.tolist()]


class Forest:
    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.parent[max(a, b)] = min(a, b)


def compare_block(table: pa.Table, size: int, percent: int) -> pa.Table:
    """Forests of links within a block: (set, root, reached), reached from the cluster's centre."""
    clusters: dict[int, dict[int, bytes]] = defaultdict(dict)
    centre_of: dict[int, int] = {}
    columns = (table.column(c).to_pylist() for c in ("cluster", "centre", "set"))
    for cluster, centre, name, data in zip(*columns, as_bytes(table.column("text").combine_chunks()), strict=True):
        clusters[cluster][name] = data
        centre_of[cluster] = centre
    out: tuple[list, list, list] = ([], [], [])
    for cluster, members in clusters.items():
        # The centre comes first, so that its tree has it as root.
        names = sorted(members, key=lambda s: (s != centre_of[cluster], s))
        sets, trees = Sets([members[s] for s in names], size, percent), Forest(len(names))
        reached = set(sets.linked(0))
        for i in reached:
            trees.join(0, i)
        for i in range(len(names)):
            if i not in reached:
                for j in sets.linked(i):
                    trees.join(i, j)
        for i, name in enumerate(names):
            root = trees.root(i)
            out[0].append(name)
            out[1].append(names[root])
            out[2].append(root == 0)
    return pa.table({"set": pa.array(out[0], pa.int64()), "root": pa.array(out[1], pa.int64()), "reached": out[2]})


def compare_across(table: pa.Table, size: int, percent: int) -> pa.Table:
    """Links (set, root) of the left-over sets of a block pair with the sets of the block."""
    names = table.column("set").to_pylist()
    left = table.column("left_over").to_pylist()
    if not any(left):
        return pa.table({"set": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    sets = Sets(as_bytes(table.column("text").combine_chunks()), size, percent)
    edges, done = set(), Forest(len(names))
    for i, is_left in enumerate(left):
        if is_left:
            for j in sets.linked(i):
                if done.root(i) != done.root(j):
                    done.join(i, j)
                    edges.add((names[i], names[j]))
    one, other = zip(*edges, strict=True) if edges else ((), ())
    return pa.table({"set": pa.array(one, pa.int64()), "root": pa.array(other, pa.int64())})


def _blocks(nodes: DataFrame, packs: int) -> DataFrame:
    """Adds ``cuts``, ``pack``, ``band`` and ``salt``: small clusters are packed together, large ones
    are cut by band of sizes, and a band by hash."""
    cut = F.expr(f"CAST(ceil(band_weight / {BLOCK_SHINGLES}) AS bigint)")
    whole = F.col("weight") <= BLOCK_SHINGLES
    return nodes.withColumns(
        {
            "cuts": F.when(whole, F.lit(0)).otherwise(cut),
            "pack": F.when(whole, F.pmod(F.xxhash64("cluster"), F.lit(packs))).otherwise(F.col("cluster")),
            "band": F.when(whole, F.lit(-1)).otherwise(F.col("band")),
            "salt": F.when(whole, F.lit(-1)).otherwise(F.pmod(F.xxhash64("set"), cut)),
        }
    )


def link_edges(docs: DataFrame, sets: DataFrame, edges: DataFrame, text: str, size: int, percent: int) -> DataFrame:
    """Forest (a, b) over text hashes that connects exactly what links connect; ``sets, edges`` are the candidates."""
    edges = edges.withColumn("category", F.lit(0))
    cluster = connected_components(edges).select(F.col("node").alias("set"), F.col("component").alias("cluster"))
    nodes = sets.join(cluster, "set")
    summary = nodes.groupBy("cluster").agg(
        F.sum("n").alias("weight"), F.max_by("set", F.struct("company", "set")).alias("centre")
    )
    # Sets that link are in one band of sizes or in neighbouring ones.
    width = -math.log(percent / 100) * (1 + 1e-9)
    nodes = nodes.join(summary, "cluster").withColumn("band", F.floor(F.log("n") / width))
    banded = nodes.groupBy("cluster", "band").agg(F.sum("n").alias("band_weight"))
    nodes = materialize(nodes.join(banded, ["cluster", "band"]))
    weight = nodes.agg(F.sum("n").alias("n")).first()["n"] or 0
    nodes = _blocks(nodes, parts_for(docs.sparkSession, weight, BLOCK_SHINGLES))
    texts = docs.select(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("set"), F.col(text).alias("text"))
    # One text per hash before the join, first within each task.
    members = materialize(
        texts.groupBy("set").agg(F.first("text").alias("text")).join(
            nodes.select("set", "cluster", "centre", "cuts", "pack", "band", "salt"), "set"
        )
    )
    cut = members.filter("cuts > 0")
    every = cut.select("cluster", "band", "salt").distinct()
    guests = (
        cut.filter("set = centre").drop("band", "salt")
        .join(every, "cluster").select(*members.columns)
    )
    inside = materialize(
        members.unionByName(guests)
        .select("pack", "band", "salt", "cluster", "centre", "set", "text")
        .groupBy("pack", "band", "salt")
        .applyInArrow(lambda t: compare_block(t, size, percent), "set bigint, root bigint, reached boolean")
    )
    left = materialize(cut.join(inside.filter("not reached").select("set").distinct(), "set", "left_semi"))
    turns = left.groupBy("cluster", "band").agg(
        F.expr(f"CAST(ceil(sum(length(text)) / {8 * BLOCK_SHINGLES}) AS bigint)").alias("turns")
    )
    # A block meets the left-over sets of its band and of the neighbours, a turn of them at a time.
    visits = turns.withColumnRenamed("band", "from_band").withColumn("band", F.explode(
        F.sequence(F.col("from_band") - 1, F.col("from_band") + 1)
    )).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("turns") - 1)))
    blocks = cut.join(visits.drop("turns"), ["cluster", "band"])
    asking = (
        left.drop("salt").join(turns, ["cluster", "band"])
        .withColumn("turn", F.pmod(F.xxhash64("set"), F.col("turns")))
        .withColumnRenamed("band", "from_band").withColumn("band", F.explode(
            F.sequence(F.col("from_band") - 1, F.col("from_band") + 1)
        ))
        .join(every, ["cluster", "band"])
    )
    columns = ["cluster", "band", "salt", "from_band", "turn", "set", "text"]
    across = (
        blocks.select(*columns, F.lit(False).alias("left_over"))
        .unionByName(asking.select(*columns, F.lit(True).alias("left_over")))
        .groupBy(*columns[:5])
        .applyInArrow(lambda t: compare_across(t, size, percent), "set bigint, root bigint")
    )
    forest = inside.select("set", "root").unionByName(across).filter("set != root")
    return forest.select(F.lit(0).alias("category"), F.col("set").alias("a"), F.col("root").alias("b")).distinct()


def _with_component(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """``key, set, n, component`` of every document; no component without shingles. Stored."""
    spark = docs.sparkSession
    with scratch(spark) as keep:
        buckets = parts_for(spark, total_bytes(docs, text), BUCKET_BYTES)
        warm = warmth(docs, text, size)
        # List entries are not needed beyond the candidates.
        with scratch(spark) as keep_on:
            listed = materialize(list_entries(docs, buckets, key, text, size, percent, warm))
            sets, edges = (keep_on(part) for part in candidates(listed, buckets))
            rows = keep_on(listed.filter("kind = 0").select(key, "set", "n"))
        forest = link_edges(docs, sets, edges, text, size, percent)
        component = connected_components(materialize(forest)).select(F.col("node").alias("set"), "component")
        return keep(
            rows.join(component, "set", "left").withColumn(
                "component", F.when(F.col("n") > 0, F.coalesce("component", "set"))
            )
        )


def components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """``key, n_shingles, component_id`` of every document; two link from ``percent`` of their union on."""
    rows = _with_component(docs, key, text, size, percent).drop("set")
    least = rows.filter("component is not null").groupBy("component").agg(F.min(key).alias("least"))
    return rows.join(least, "component", "left").select(
        key, F.col("n").alias("n_shingles"), F.coalesce("least", key).alias("component_id")
    )


def keep_one(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row of each component, that with the smallest key; rows without shingles all stay."""
    rows = _with_component(docs, key, text, size, percent)
    order = F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("key"), "set")
    own, mark, first_key, first_set, first_mark = free(docs, "_set", "_mark", "_first_key", "_first_set", "_first_mark")
    first = rows.filter("n > 0").groupBy("component").agg(F.min(order).alias("first"))
    first = first.select(
        F.col("first.key").alias(first_key), F.col("first.set").alias(first_set), F.xxhash64("first.key").alias(first_mark)
    )
    hashed = docs.withColumns({own: F.xxhash64(F.coalesce(F.col(text), F.lit(""))), mark: F.xxhash64(key)})
    has_words = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    # Texts are dealt once, by the hashes, which serves repeated rows too; a null-safe key would have them dealt again.
    same = F.coalesce(F.col(key) == F.col(first_key), F.lit(False)) | (F.col(key).isNull() & F.col(first_key).isNull())
    chosen = hashed.filter(has_words).join(
        first, (F.col(own) == F.col(first_set)) & (F.col(mark) == F.col(first_mark)) & same
    )
    single = chosen.dropDuplicates([own, mark, key]).select(*docs.columns)
    return single.unionByName(docs.filter(~has_words))
