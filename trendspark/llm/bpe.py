"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token is a linked list of byte spans. A bucket per merge rank holds the positions whose
pair has that rank; a two-level bitmap over the ranks gives the next rank by find-first-set.
Entries whose pair has changed meanwhile are stale and skipped. A pre-token of n bytes takes
O(n log n) steps, so very long ones do no harm. A batch's new pre-tokens that are not long share one
queue: a bucket then holds positions of many of them, and of each the first is merged at once.

Defined results: a null text is the empty text, with no tokens; repeated rows are encoded alike;
texts of any length are split in bounded slices; other columns stay as they are.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import cached_property
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trendspark.llm.common import as_bytes, batches_by_length, batches_by_size

#: Characters of a text encoded at once, and pre-tokens at once in a stretch without a space.
SLICE, RUN = 1 << 20, 1 << 17
#: Words and pre-tokens kept per Python worker; the caches start anew when full.
CACHE = 1 << 20
#: Fewer new words than this are encoded one by one.
FEW = 500
BATCH_BYTES = 1 << 24
#: Bytes of text whose ids are held at once.
IDS_BYTES = 1 << 22


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Encoder:
    """Encoder and decoder of one vocabulary.

    The rank queue has one bit per rank in 256-bit words (``low``) and one bit per word above them
    (``top``). It is empty between calls, so its words serve every pre-token.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern)
        size = max(ranks.values()) + 1
        self.vocabulary = [b""] * size
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        self.low = [0] * ((size >> 8) + 1)
        self.bit = [1 << i for i in range(max(256, len(self.low)))]
        self.words: dict[str, tuple[int, ...]] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.known = Known(self)
        # One object an id: the caches hold each id many times, and a number of its own takes 28 bytes.
        self.numbers = list(range(size))
        self.byte_ids = np.array([ranks.get(bytes([b]), 0) for b in range(256)], np.int64)

    @cached_property
    def digits(self) -> list[str]:
        return [str(i) for i in range(len(self.vocabulary))]

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of tokens that make a token, sorted, and its rank."""
        rank_of, found = self.ranks.get, []
        for whole, rank in self.ranks.items():
            for cut in range(1, len(whole)):
                left, right = rank_of(whole[:cut]), rank_of(whole[cut:])
                if left is not None and right is not None:
                    found.append((left * (len(self.vocabulary) + 1) + right, rank))
        table = np.array(sorted(found) or [(-1, -1)], np.int64)
        return table[:, 0].copy(), table[:, 1].copy()

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Token ids of one pre-token."""
        rank_of = self.ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return (whole,)
        low, bit, top, n = self.low, self.bit, 0, len(piece)
        buckets: dict[int, list[int]] = {}
        after, before = list(range(1, n + 1)), list(range(-1, n))
        pair = [rank_of(piece[i:i + 2], -1) for i in range(n - 1)]
        pair.append(-1)
        for i, rank in enumerate(pair):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    word = rank >> 8
                    low[word] |= bit[rank & 255]
                    top |= bit[word]
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            first = bits & -bits
            rank = word << 8 | first.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heapq.heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                low[word] = bits = bits ^ first
                if not bits:
                    top ^= bit[word]
            if pair[i] != rank:
                continue  # stale
            j = after[i]
            pair[j] = -1
            end = after[i] = after[j]
            before[end] = i
            left = before[i]
            right = rank_of(piece[i:after[end]], -1) if end < n else -1
            pair[i] = right
            if left >= 0:
                found = pair[left] = rank_of(piece[left:end], -1)
                changed = ((found, left), (right, i))
            else:
                changed = ((right, i),)
            for found, at in changed:
                if found >= 0:
                    if found in buckets:
                        heapq.heappush(buckets[found], at)
                    else:
                        buckets[found] = [at]
                        word = found >> 8
                        low[word] |= bit[found & 255]
                        top |= bit[word]
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i:after[i]]])
            i = after[i]
        return tuple(ids)

    def merge_many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of different pre-tokens, by one queue over all of them."""
        sizes = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n, low, bit, top = len(data), self.low, self.bit, 0
        owner = np.repeat(np.arange(len(pieces)), sizes)
        end, begin = np.cumsum(sizes) - 1, np.cumsum(sizes) - sizes
        # The place after the last one stands for the end of every piece; no pair goes there.
        token = np.append(self.byte_ids[data], len(self.vocabulary))
        after, before = np.arange(1, n + 1), np.arange(-1, n)
        after[end], before[begin] = n, -1
        pair = self.pair_ranks(token[:-1], token[after])
        buckets: dict[int, list[np.ndarray]] = {}
        alive = np.ones(n, bool)
        fresh = np.flatnonzero(pair >= 0)
        while True:
            if len(fresh):
                order = np.argsort(pair[fresh], kind="stable")
                fresh = fresh[order]
                cuts = np.flatnonzero(np.diff(pair[fresh])) + 1
                for part in np.split(fresh, cuts) if len(cuts) else (fresh,):
                    rank = int(pair[part[0]])
                    if rank in buckets:
                        buckets[rank].append(part)
                    else:
                        buckets[rank] = [part]
                        word = rank >> 8
                        low[word] |= bit[rank & 255]
                        top |= bit[word]
            if not top:
                break
            word = (top & -top).bit_length() - 1
            first = low[word] & -low[word]
            rank = word << 8 | first.bit_length() - 1
            found = buckets.pop(rank)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            at = at[pair[at] == rank]  # without stale ones
            at.sort()
            leading = np.ones(len(at), bool)
            leading[1:] = owner[at[1:]] != owner[at[:-1]]
            rest = at[~leading]
            if len(rest):
                buckets[rank] = [rest]
                at = at[leading]
            else:
                low[word] ^= first
                if not low[word]:
                    top ^= bit[word]
            gone = after[at]
            right = after[gone]
            token[at], after[at], before[right] = rank, right, at
            alive[gone], pair[gone] = False, -1
            left = before[at]
            left = left[left >= 0]
            touched = np.concatenate([left, at])
            pair[touched] = self.pair_ranks(token[touched], token[after[touched]])
            fresh = touched[pair[touched] >= 0]
        kept = np.flatnonzero(alive)
        ids, many = [*map(self.numbers.__getitem__, token[kept].tolist())], np.bincount(owner[kept], minlength=len(pieces))
        ends = np.cumsum(many).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two tokens make together, else -1."""
        key = left * (len(self.vocabulary) + 1) + right
        keys, values = self.pairs
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, values[at], -1)

    def learn(self, words: Iterable[str], spelled: bool) -> None:
        """Encode what is new of the distinct words that follow a space, all at once."""
        new = [w for w in words if len(w) <= 64]
        if spelled:
            new = [w for w in new if w not in self.known]
        else:
            new = [w for w in new if " " + w not in self.cache and " " + w not in self.words]
        if len(new) < FEW:
            return
        tokens = [self.split.findall(" " + w) for w in new]
        unseen = list({t for own in tokens for t in own if t not in self.cache and len(t) <= 64})
        pieces = [t.encode() for t in unseen]
        whole = [self.ranks.get(p) for p in pieces]
        todo = [i for i, rank in enumerate(whole) if rank is None]
        self.cache.update((t, (rank,)) for t, rank in zip(unseen, whole, strict=True) if rank is not None)
        if todo:
            self.cache.update(zip([unseen[i] for i in todo], self.merge_many([pieces[i] for i in todo]), strict=True))
        for word, own in zip(new, tokens, strict=True) if spelled else ():
            self.known[word] = self.spell([*chain.from_iterable(map(self.pre_token, own))])

    def learn_texts(self, texts: Iterable[str], spelled: bool = True) -> None:
        """Get to know the words of texts, also as they are written if they are to be ``spelled``."""
        self.make_room()
        if len(self.known) > CACHE // 2:
            self.known.clear()
        words: set[str] = set()
        for text in texts:
            words.update(text.split(" "))
        # Nothing made here is part of a cycle.
        gc.disable()
        try:
            self.learn(words, spelled)
        finally:
            gc.enable()

    def pre_token(self, token: str) -> tuple[int, ...]:
        ids = self.cache.get(token)
        if ids is None:
            ids = self.merge(token.encode())
            if len(token) <= 64:
                self.cache[token] = ids
        return ids

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of a stretch that starts and ends where a match does."""
        tokens = self.split.findall(word)
        if len(tokens) == 1:
            return self.pre_token(tokens[0])
        ids = tuple(chain.from_iterable(map(self.pre_token, tokens)))
        if len(word) <= 64:
            self.words[word] = ids
        return ids

    def slices(self, text: str) -> Iterator[str]:
        """Parts of a text that end before a space where a match ends as well."""
        start = 0
        while len(text) - start > SLICE and (cut := CUT.search(text, start + SLICE)):
            yield text[start:cut.start()]
            start = cut.start()
        yield text[start:]

    def make_room(self) -> None:
        if len(self.words) + len(self.cache) > CACHE:
            self.words.clear()
            self.cache.clear()

    def encode_part(self, part: str) -> Iterator[list[int]]:
        """Ids of a part match by match, in bounded lists."""
        self.make_room()
        matches = self.split.finditer(part)
        while run := [m.group() for m in islice(matches, RUN)]:
            yield list(chain.from_iterable(map(self.pre_token, run)))

    def encode(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, in bounded lists."""
        for part in self.slices(text):
            if len(part) > 2 * SLICE or WHITE_BOTH_SIDES.search(part):
                yield from self.encode_part(part)
            else:
                self.make_room()
                # A match ends before a space that has no white space on one of its sides.
                first, *rest = part.split(" ")
                words, tokens, slow = self.words, self.cache, self.word
                yield [*self.word(first), *chain.from_iterable(
                    [tokens.get(w) or words.get(w) or slow(w) for w in map(" ".__add__, rest)]
                )]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))

    def spelled(self, text: str) -> Iterator[tuple[str, bytes, int]]:
        """A text's ids in decimals, each after a space, the bytes they decode to, and their number, in
        bounded parts. A word is encoded, written and decoded once and then looked up as a whole."""
        for part in self.slices(text):
            if len(self.known) > CACHE // 2:
                self.known.clear()
            if len(part) > 2 * SLICE or WHITE_BOTH_SIDES.search(part):
                yield from map(self.spell, self.encode_part(part))
                continue
            first, *rest = part.split(" ")
            found = [self.spell(self.word(first)), *map(self.known.__getitem__, rest)]
            yield "".join([f[0] for f in found]), b"".join([f[1] for f in found]), sum([f[2] for f in found])

    def spell(self, ids: Sequence[int]) -> tuple[str, bytes, int]:
        return "".join([" " + self.digits[i] for i in ids]), self.decode(ids), len(ids)


class Known(dict):
    """What a word after a space is spelled as."""

    def __init__(self, bpe: Encoder) -> None:
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> tuple[str, bytes, int]:
        bpe = self.bpe
        found = bpe.spell([*chain.from_iterable(map(bpe.pre_token, bpe.split.findall(" " + word)))])
        if len(word) <= 64:
            self[word] = found
        return found


#: A space after something else than white space: no match goes across its left side.
CUT = re.compile(r"(?<=\S) ")
WHITE_BOTH_SIDES = re.compile(r"\s \s")
_KEPT: dict[tuple[str, str], Encoder] = {}


def encoder(key: str, ranks: dict[bytes, int], pattern: str) -> Encoder:
    """The worker's encoder of a vocabulary; its cache serves later tasks as well."""
    if (key, pattern) not in _KEPT:
        _KEPT.clear()
        _KEPT[key, pattern] = Encoder(ranks, pattern)
    return _KEPT[key, pattern]


def _shipped(df: DataFrame, path: str, pattern: str):
    """A function that gives the encoder inside a task. The ranks, a few MB at most, are broadcast."""
    ranks = load_ranks(path)
    key = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    sent = df.sparkSession.sparkContext.broadcast(ranks)
    return lambda: encoder(key, sent.value, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the token ids of ``text`` as an array; a column of that name is replaced."""
    df = df.drop(ids)
    get = _shipped(df, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = get()
        for batch in batches_by_size(batches, text, IDS_BYTES):
            flat, ends = array("i"), [0]
            texts = [value.decode() for value in as_bytes(batch.column(text))]
            bpe.learn_texts(texts, spelled=False)
            for value in texts:
                for part in bpe.encode(value):
                    flat.extend(part)
                ends.append(len(flat))
            values = pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32))
            yield batch.append_column(ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values))

    schema = T.StructType(df.schema.fields + [T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(run, schema)


def decode(
    df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """Adds the bytes of an array of ids; a null array has no bytes. A column of that name is replaced."""
    df = df.drop(decoded)
    get = _shipped(df, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = get()
        for batch in batches_by_length(batches, ids, IDS_BYTES // 4):
            column = batch.column(ids)
            sizes = column.value_lengths().fill_null(0).to_pylist()
            flat, found, at = column.flatten().to_numpy(), [], 0
            for size in sizes:
                found.append(bpe.decode(flat[at:at + size].tolist()))
                at += size
            yield batch.append_column(decoded, pa.array(found, pa.binary()))

    return df.mapInArrow(run, T.StructType(df.schema.fields + [T.StructField(decoded, T.BinaryType())]))


def round_trip(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes every text; returns key, count and digests without building the arrays."""
    get = _shipped(df, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = get()
        for batch in batches_by_size(batches, text, BATCH_BYTES):
            counts, ids_hash, text_hash = [], [], []
            texts = [value.decode() for value in as_bytes(batch.column(text))]
            bpe.learn_texts(texts, spelled=True)
            for value in texts:
                count, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
                for written, data, many in bpe.spelled(value):
                    of_ids.update((written if count else written[1:]).encode())
                    of_bytes.update(data)
                    count += many
                counts.append(count)
                ids_hash.append(of_ids.hexdigest())
                text_hash.append(of_bytes.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(counts, pa.int64()), pa.array(ids_hash), pa.array(text_hash)],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
