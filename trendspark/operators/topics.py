"""Topic membership, numbering, enrichment and keywords."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from trendspark.functions.text import blank, bound, word_text_ascii, words
from trendspark.functions.wordlists import stopwords
from trendspark.operators.dedup import last_by_id
from trendspark.session import materialize, spread, top_per_group, with_position

TOPIC = ["category", "topic"]
NOISE = -1
#: Counts a task holds before it hands them on, and terms that are sent to every task at most.
COUNTED = 1 << 19
ASKED = 1 << 18
#: Bytes of text coded at once.
SLICE = 1 << 23
#: Blanks in place of ASCII characters that are of no word.
_SPACED = np.array([i if i > 127 or chr(i).isalnum() or chr(i) == "_" else 32 for i in range(256)], np.uint8)


def attach_topics(posts: DataFrame, labels: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Topic of each post, by id instead of by row position."""
    return posts.join(labels.select(*keys, "topic"), list(keys))


def check_alignment(posts: DataFrame, labels: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Posts without label and labels without post; both counts are 0 when aligned."""
    sides = {"unlabelled_posts": (posts, labels), "labels_without_post": (labels, posts)}
    counts = [
        left.join(right.select(*keys), list(keys), "left_anti")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(name).alias("side"), "n")
        for name, (left, right) in sides.items()
    ]
    return counts[0].unionByName(counts[1])


def topic_members(posts: DataFrame, id: str = "id", seq: str = "ingest_seq") -> DataFrame:
    """Post ids per topic in row order: one row ``(category, topic, position, post_id)`` a post.

    ``seq`` is unique within a topic. A topic that holds a third of all posts is many rows, not an array.
    """
    rows = posts.select(*TOPIC, F.col(seq).alias("_seq"), F.trim(F.col(id).cast("string")).alias("post_id"))
    return with_position(rows, ["_seq"], TOPIC, "position").select(*TOPIC, "position", "post_id")


def fold_members(listed: DataFrame) -> DataFrame:
    """One array of ids per topic, for callers whose topics are small enough for one value."""
    member = F.struct("position", "post_id")
    folded = listed.groupBy(*TOPIC).agg(F.array_sort(F.collect_list(member)).alias("members"))
    return folded.select(*TOPIC, F.transform("members", lambda m: m["post_id"]).alias("post_ids"))


def members(posts: DataFrame, topic: int) -> DataFrame:
    return posts.filter(F.col("topic") == topic)


def posts_of_topics(
    listed: DataFrame, metadata: DataFrame, id: str = "id", seq: str = "ingest_seq"
) -> DataFrame:
    """Members joined to their post; unknown ids drop out, the last row of an id wins.

    A listed id counts as often as it is listed. Ids are trimmed on both sides.
    """
    listed = listed.select(*TOPIC, F.col("post_id").alias("_id"))
    posts = last_by_id(
        metadata.withColumn("_id", F.trim(F.col(id).cast("string"))), ["category", "_id"], seq
    )
    return listed.join(posts, ["category", "_id"]).drop("_id")


def enrich_topics(topics: DataFrame, keywords: DataFrame, titles: DataFrame) -> DataFrame:
    """Keywords and title of each topic; ``[]`` and ``""`` where there are none."""
    empty = F.array().cast("array<string>")
    return (
        topics.join(keywords.select(*TOPIC, "keywords"), TOPIC, "left")
        .join(titles.select(*TOPIC, "title"), TOPIC, "left")
        .withColumns(
            {"keywords": F.coalesce("keywords", empty), "title": F.coalesce("title", F.lit(""))}
        )
    )


def topic_sizes(posts: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    return posts.groupBy(*TOPIC).agg(
        F.count(F.lit(1)).alias("size"), F.min(seq).alias("first_seq")
    )


def number_topics(posts: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """Number per topic: 0 is the largest, ties by first row; noise stays -1."""
    sizes = topic_sizes(posts, seq)
    real = sizes.filter(F.col("topic") != NOISE).withColumn("_smaller", -F.col("size"))
    numbered = with_position(real, ["_smaller", "first_seq"], ["category"], "number")
    noise = sizes.filter(F.col("topic") == NOISE).withColumn("number", F.lit(NOISE).cast("bigint"))
    return numbered.select(*TOPIC, "size", F.col("number").cast("int")).unionByName(
        noise.select(*TOPIC, "size", F.col("number").cast("int"))
    )


def renumber(posts: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """Posts with their topic replaced by its number."""
    numbers = number_topics(posts, seq).select(*TOPIC, "number")
    return posts.join(numbers, TOPIC).drop("topic").withColumnRenamed("number", "topic")


def terms(text: Column, ngrams: tuple[int, int], stop: Sequence[str]) -> Column:
    """N-grams of the tokens of at least two characters left after stop words go."""
    kept = F.filter(words(text), lambda w: (F.length(w) >= 2) & ~w.isin(list(stop)))

    def grams(tokens: Column, n: int) -> Column:
        count = F.greatest(F.size(tokens) - F.lit(n - 1), F.lit(0))
        shifted = [F.slice(tokens, F.lit(first + 1), count) for first in range(n)]
        return reduce(
            lambda left, right: F.zip_with(left, right, lambda a, b: F.concat(a, F.lit(" "), b)),
            shifted,
        )

    sizes = range(ngrams[0], ngrams[1] + 1)
    return bound(kept, lambda tokens: F.concat(*(grams(tokens, n) for n in sizes)))


def term_counts(
    posts: DataFrame,
    text: str = "text_for_embedding",
    ngrams: tuple[int, int] = (1, 2),
    stop: Sequence[str] | None = None,
) -> DataFrame:
    stop = stopwords() if stop is None else stop
    listed = spread(posts).select(
        *TOPIC, F.explode(terms(blank(F.col(text)), ngrams, stop)).alias("term")
    )
    return listed.groupBy(*TOPIC, "term").agg(F.count(F.lit(1)).alias("n"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Rows of one category, of texts of about ``SLICE`` bytes at most together."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("words")).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + SLICE, "right")))
            part = batch.slice(start, stop - start)
            for category in part.column("category").unique().to_pylist():
                yield category, part.filter(pc.equal(part.column("category"), category))
            start = stop


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All tokens, empty ones among them, and the number of the text that each is of."""
    valid, offsets, data = texts.buffers()
    # Bytes beyond ASCII are parts of word characters, see ``word_text_ascii``.
    spaced = pa.py_buffer(_SPACED[np.frombuffer(data, np.uint8)]) if data else data
    lists = pc.split_pattern(pa.Array.from_buffers(texts.type, len(texts), [valid, offsets, spaced], offset=texts.offset), " ")
    return lists.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))


def _coded(texts: DataFrame, stop: Sequence[str]) -> DataFrame:
    """``(category, topic, words)`` as slices of one category, each word looked up once.

    A slice has the topics of its texts, how many tokens each has, its distinct words joined by blanks,
    and the tokens as places among these. Stop words and single characters are left out.
    """
    left_out, topic = pa.array(sorted(stop), pa.string()), texts.schema["topic"].dataType
    fields = StructType(
        [
            StructField("category", StringType()), StructField("topics", ArrayType(topic)),
            StructField("sizes", BinaryType()), StructField("terms", StringType()), StructField("codes", BinaryType()),
        ]
    )
    schema = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for category, rows in _slices(batches):
            tokens, of = _tokens(rows.column("words"))
            found = tokens.dictionary_encode()
            term = found.dictionary
            kept = pc.and_(pc.greater_equal(pc.utf8_length(term), 2), pc.invert(pc.is_in(term, value_set=left_out)))
            term, kept = term.filter(kept), kept.to_numpy(zero_copy_only=False)
            if not len(term):
                continue
            codes = np.where(kept, np.cumsum(kept) - 1, -1).astype(np.int32)[found.indices.to_numpy()]
            at = np.flatnonzero(codes >= 0)
            sizes = np.bincount(of[at], minlength=rows.num_rows).astype(np.int32)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(term)], pa.int32()), term.cast(pa.string())), " ")
            columns = [[category], [rows.column("topic").to_pylist()], [sizes.tobytes()], joined, [codes[at].tobytes()]]
            columns = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return texts.select("category", "topic", "words").mapInArrow(run, fields)


def _coded_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray, pa.Array]]:
    """Category, words, places of the tokens among them, and the text that each is of, with the texts' topics."""
    for batch in batches:
        for i in range(batch.num_rows):
            sizes, codes = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int32) for c in ("sizes", "codes"))
            terms = pc.split_pattern(batch.column("terms").slice(i, 1), " ").flatten()
            yield batch.column("category")[i].as_py(), terms, codes, np.repeat(np.arange(len(sizes)), sizes), batch.column("topics")[i].values


def _word_counts(coded: DataFrame) -> DataFrame:
    """Counts per category of the words of coded slices, summed up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, found = ["category", "term", "n"], []

        def merged() -> pa.Table:
            counts = pa.concat_tables(found).group_by(names[:2]).aggregate([("n", "sum")])
            return counts.select([*names[:2], "n_sum"]).rename_columns(names)

        for category, terms, codes, *_ in _coded_slices(batches):
            n = pa.array(np.bincount(codes, minlength=len(terms)), pa.int64())
            found.append(pa.table([pa.array([category] * len(terms), pa.string()), terms.cast(pa.string()), n], names=names))
            if sum(t.num_rows for t in found) > 4 * COUNTED:
                found = [merged()]
                if found[0].num_rows > 2 * COUNTED:
                    yield from found[0].to_batches()
                    found = []
        if found:
            yield from merged().to_batches()

    listed = coded.mapInArrow(run, "category string, term string, n bigint")
    return listed.groupBy("category", "term").agg(F.sum("n").alias("n"))


def _numbers(terms: pa.Array, codes: np.ndarray, words: pa.Array) -> np.ndarray:
    """Places of the tokens among ``words``, or -1 for words that are not."""
    place = pc.fill_null(pc.index_in(terms.cast(pa.string()), value_set=words), -1)
    return place.to_numpy(zero_copy_only=False).astype(np.int64)[codes]


def _grams(codes: np.ndarray, of: np.ndarray, size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all n-grams of ``size`` known words within a text, and the text each is of."""
    n = max(len(codes) - size + 1, 0)
    whole, number = of[:n] == of[len(of) - n:], np.zeros(n, np.int64)
    for i in range(size):
        part = codes[i:i + n]
        whole &= part >= 0
        number = number * base + part
    at = np.flatnonzero(whole)
    return number[at], of[at]


class _Tally:
    """Sums of counts by number, kept as sorted arrays."""

    def __init__(self) -> None:
        self.numbers, self.counts, self.fresh = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def add(self, numbers: np.ndarray, below: int) -> None:
        """Numbers, all less than ``below``."""
        if below <= 4 * len(numbers):
            counts = np.bincount(numbers, minlength=below)
            met = np.flatnonzero(counts)
            self.fresh.append((met, counts[met]))
        else:
            self.fresh.append(np.unique(numbers, return_counts=True))
        if sum(len(n) for n, _ in self.fresh) > max(COUNTED, len(self.numbers)):
            self.merge()

    def merge(self) -> None:
        """All in one pair of arrays."""
        numbers, counts = (np.concatenate([own, *parts]) for own, parts in zip((self.numbers, self.counts), zip(*self.fresh) if self.fresh else ((), ())))
        self.numbers, at = np.unique(numbers, return_inverse=True)
        self.counts, self.fresh = np.bincount(at, counts, len(self.numbers)).astype(np.int64), []


def _longer(
    texts: DataFrame, ngrams: tuple[int, int], stop: Sequence[str], words: dict[str, list[str]], least: dict[str, tuple[int, int]] | None
) -> DataFrame:
    """N-grams of frequent words ``(category, term, n)`` that are worth a count, from each task.

    ``least`` has per category the count that the vocabulary asks and that of all frequent words. An n-gram
    that reaches it has in some task at least the task's share of it, by frequent words. Without ``least``
    all n-grams are given out, so that ``n`` adds up to their counts. ``texts`` may be coded already.
    """
    coded = texts if "codes" in texts.columns else _coded(texts, stop)
    sent = texts.sparkSession.sparkContext.broadcast((words, least))
    sizes = range(2, ngrams[1] + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, least = sent.value
        known: dict[str, pa.Array] = {}
        tallies: dict[tuple[str, int], _Tally] = defaultdict(_Tally)
        seen: Counter = Counter()

        def handed_on(category: str) -> Iterator[pa.RecordBatch]:
            own = words[category]
            share = 0 if least is None else least[category][0] * seen.pop(category, 0) // least[category][1]
            for size in sizes:
                tally = tallies.pop((category, size), None)
                if tally is None:
                    continue
                tally.merge()
                many = tally.counts >= share
                number, parts = tally.numbers[many], []
                for _ in range(size):
                    number, part = np.divmod(number, len(own))
                    parts.append(part.tolist())
                terms = [" ".join(own[p] for p in reversed(gram)) for gram in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([category] * len(terms), pa.string()), pa.array(terms, pa.string()), pa.array(tally.counts[many])],
                    names=["category", "term", "n"],
                )

        for category, terms, codes, of, _ in _coded_slices(batches):
            own = words.get(category)
            if not own:
                continue
            if category not in known:
                known[category] = pa.array(own, pa.string())
            found = _numbers(terms, codes, known[category])
            seen[category] += int((found >= 0).sum())
            for size in sizes:
                tallies[category, size].add(_grams(found, of, size, len(own))[0], len(own) ** size)
            if sum(len(tallies[category, size].numbers) for size in sizes) > 8 * COUNTED:
                yield from handed_on(category)
        for category in list(dict.fromkeys(c for c, _ in tallies)):
            yield from handed_on(category)

    return coded.mapInArrow(run, "category string, term string, n bigint")


def _chosen_counts(
    coded: DataFrame, words: dict[str, list[str]], longer: dict[str, list[str]]
) -> DataFrame:
    """Counts per topic of the given words and n-grams of them, summed up in each task first."""
    sent = coded.sparkSession.sparkContext.broadcast((words, longer))
    topic = StructField("topic", coded.schema["topics"].dataType.elementType)
    fields = StructType([StructField("category", StringType()), topic, StructField("term", StringType()), StructField("n", LongType())])
    schema = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, longer = sent.value
        known: dict[str, pa.Array] = {}
        # Per category and size: the numbers of the chosen n-grams, sorted, and their terms.
        chosen: dict[str, list[tuple[int, np.ndarray, list[str]]]] = {}
        tallies: dict[tuple[str, int], _Tally] = defaultdict(_Tally)
        topics: dict = {}

        def prepared(category: str) -> None:
            own = words[category]
            known[category] = pa.array(own, pa.string())
            index = {w: i for i, w in enumerate(own)}
            asked = defaultdict(list)
            for term in (*own, *longer.get(category, ())):
                parts = term.split(" ")
                asked[len(parts)].append((reduce(lambda number, w: number * len(own) + index[w], parts, 0), term))
            chosen[category] = []
            for size, pairs in sorted(asked.items()):
                pairs.sort()
                chosen[category].append((size, np.array([n for n, _ in pairs], np.int64), [t for _, t in pairs]))

        def handed_on() -> Iterator[pa.RecordBatch]:
            names = list(topics)
            for (category, size), tally in tallies.items():
                tally.merge()
                terms = next(t for s, _, t in chosen[category] if s == size)
                topic, term = np.divmod(tally.numbers, len(terms))
                columns = [[category] * len(term), [names[t] for t in topic.tolist()], [terms[t] for t in term.tolist()], tally.counts]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            tallies.clear()
            topics.clear()

        for category, terms, codes, of, topics_of in _coded_slices(batches):
            if not words.get(category):
                continue
            if category not in known:
                prepared(category)
            found = _numbers(terms, codes, known[category])
            own = np.array([topics.setdefault(t, len(topics)) for t in topics_of.to_pylist()], np.int64)
            for size, numbers, _ in chosen[category]:
                grams, of_gram = _grams(found, of, size, len(words[category]))
                place = np.minimum(np.searchsorted(numbers, grams), len(numbers) - 1)
                met = np.flatnonzero(numbers[place] == grams)
                tallies[category, size].add(own[of_gram[met]] * len(numbers) + place[met], len(topics) * len(numbers))
            if sum(len(t.numbers) for t in tallies.values()) > 2 * COUNTED:
                yield from handed_on()
        yield from handed_on()

    counted = coded.mapInArrow(run, fields)
    return counted.groupBy(*TOPIC, "term").agg(F.sum("n").alias("n"))


def _lists(terms: DataFrame) -> dict[str, list[str]]:
    return {c: sorted(g["term"]) for c, g in terms.toPandas().groupby("category")}


def vocabulary_counts(
    posts: DataFrame, text: str, ngrams: tuple[int, int], stop: Sequence[str], size: int
) -> DataFrame:
    """``term_counts`` of the terms that the vocabulary holds, without counting all others by topic.

    No n-gram occurs more often than one of its words. So beside the words only the n-grams of
    words that are as frequent as the last of the ``size`` most frequent words can be of the
    vocabulary, and only those that have their share of that count in some task. These are counted
    by topic. What reaches the driver are such words and n-grams; if ties make too many of them,
    they are counted per category first, or all terms are counted.
    """
    # The plan of posts is not asked for its partitions: if it holds a join, that would run it.
    texts = posts.select(*TOPIC, word_text_ascii(blank(F.col(text))).alias("words"))
    coded = _coded(texts.filter(F.col("category").isNotNull()), stop)
    # A row is a slice, so that a row group has to be small to be read a few slices at a time.
    coded = spread(materialize(coded, **{"parquet.block.size": 2 * SLICE}))
    totals = materialize(_word_counts(coded))
    # The count of the last of the most frequent words, without putting all words in order.
    met = Window.partitionBy("category").orderBy(F.col("n").desc())
    alike = totals.groupBy("category", "n").agg(F.count(F.lit(1)).alias("words")).withColumn("rank", F.sum("words").over(met))
    # With fewer words than the vocabulary holds, every n-gram has its chance.
    least = alike.groupBy("category").agg(F.coalesce(F.max(F.when(F.col("rank") >= size, F.col("n"))), F.lit(1)).alias("least"))
    frequent = materialize(totals.join(least, "category").filter(F.col("n") >= F.col("least")).select("category", "term", "n"))
    if frequent.count() > ASKED or frequent.select("category").distinct().count() * size > ASKED:
        return term_counts(posts, text, ngrams, stop)
    words, longer = _lists(frequent), {}
    if max(map(len, words.values()), default=0) ** ngrams[1] >= 1 << 62:  # numbers of n-grams have no room
        return term_counts(posts, text, ngrams, stop)
    if ngrams[1] > 1:
        # No more categories than frequent words.
        shares = {c: (low, whole) for c, low, whole in frequent.groupBy("category").agg(F.min("n"), F.sum("n")).collect()}
        likely = materialize(_longer(coded, ngrams, stop, words, shares).groupBy("category", "term").agg(F.sum("n").alias("n")))
        if likely.count() > ASKED:
            every = _longer(coded, ngrams, stop, words, None).groupBy("category", "term").agg(F.sum("n").alias("n"))
            best = vocabulary(frequent.unionByName(every), size)
            likely = best.filter(F.contains("term", F.lit(" ")))
        longer = _lists(likely)
    counts = materialize(_chosen_counts(coded, words, longer))
    return counts.join(vocabulary(counts, size).select("category", "term"), ["category", "term"], "left_semi").select(*TOPIC, "term", "n")


def vocabulary(counts: DataFrame, size: int) -> DataFrame:
    """Most frequent terms per category, ties by term."""
    totals = counts.groupBy("category", "term").agg(F.sum("n").alias("total"))
    return top_per_group(totals, ["category"], [F.col("total").desc(), F.col("term")], size).drop("rank")


def ctfidf(
    posts: DataFrame,
    text: str = "text_for_embedding",
    ngrams: tuple[int, int] = (1, 2),
    vocabulary_size: int = 1000,
    stop: Sequence[str] | None = None,
    weighting: str = "counts",
) -> DataFrame:
    """Class-based TF-IDF ``(category, topic, term, n, weight)``.

    Weight is the term's share of its topic times ``log(1 + A / f)``: ``f`` is the
    term's total and ``A`` the whole part of the mean topic total. ``weighting="tfidf"``
    feeds smoothed, L2-normed TF-IDF values in place of the counts.
    """
    if weighting not in ("counts", "tfidf"):
        raise ValueError(f"unknown weighting: {weighting}")
    stop = stopwords() if stop is None else stop
    # Without single words there is no bound for the others.
    counted = vocabulary_counts(posts, text, ngrams, stop, vocabulary_size) if ngrams[0] == 1 else term_counts(posts, text, ngrams, stop)
    # Written once: the vocabulary and the weights both read it.
    counts = materialize(counted)
    n_topics = posts.groupBy("category").agg(F.count_distinct("topic").alias("topics"))
    vocab = vocabulary(counts, vocabulary_size).join(n_topics, "category")
    # A topic has at most one row per vocabulary term, which bounds these windows.
    own_topic = Window.partitionBy(*TOPIC)
    if weighting == "tfidf":
        known = counts.join(vocab, ["category", "term"])
        spread = known.groupBy("category", "term").agg(F.count(F.lit(1)).alias("df"))
        idf = F.log((1 + F.col("topics")) / (1 + F.col("df"))) + 1
        valued = (
            known.join(spread, ["category", "term"])
            .withColumn("x", F.col("n") * idf)
            .withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(own_topic)))
        )
        totals = valued.groupBy("category", "term").agg(F.sum("x").alias("f"))
        terms_of = vocab.select("category", "term", "topics").join(totals, ["category", "term"])
    else:
        valued = counts.withColumn("x", F.col("n").cast("double"))
        terms_of = vocab.withColumn("f", F.col("total").cast("double"))
    per_category = Window.partitionBy("category")
    mean = F.floor(F.sum("f").over(per_category) / F.col("topics"))
    terms_of = terms_of.select("category", "term", "f", mean.alias("mean_total"))
    share = F.col("x") / F.sum("x").over(own_topic)
    weight = share * F.log(1 + F.col("mean_total") / F.col("f"))
    weighted = valued.select(*TOPIC, "term", "n", "x").join(terms_of, ["category", "term"])
    return weighted.select(*TOPIC, "term", "n", weight.alias("weight"))


def topic_words(weights: DataFrame, n: int = 10) -> DataFrame:
    """Top terms per topic with their rank; weights equal to 9 decimals tie by term."""
    order = [F.round("weight", 9).desc(), F.col("term")]
    return top_per_group(weights, TOPIC, order, n)


def topic_keywords(weights: DataFrame, n: int = 10) -> DataFrame:
    ranked = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return (
        topic_words(weights, n)
        .groupBy(*TOPIC)
        .agg(ranked.alias("ranked"))
        .select(*TOPIC, F.transform("ranked", lambda r: r["term"]).alias("keywords"))
    )


def topic_names(keywords: DataFrame) -> DataFrame:
    """``number_word_word_word_word``, noise included."""
    parts = F.concat(F.array(F.col("topic").cast("string")), F.slice("keywords", 1, 4))
    return keywords.select(*TOPIC, F.array_join(parts, "_").alias("name"))


def topic_titles(keywords: DataFrame) -> DataFrame:
    """Names of the real topics; the noise topic has no title."""
    return topic_names(keywords).filter(F.col("topic") != NOISE).withColumnRenamed("name", "title")


def topic_info(posts: DataFrame, keywords: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    return topic_sizes(posts, seq).join(topic_names(keywords), TOPIC, "left").select(
        *TOPIC, "size", F.coalesce("name", F.col("topic").cast("string")).alias("name")
    )


def majority_label(
    rows: DataFrame, keys: Sequence[str], label: str, labels: Sequence[str]
) -> DataFrame:
    """Most frequent of the given labels per key; ties and absence go to the earlier one."""
    seen = F.lower(blank(F.col(label)))
    counts = rows.groupBy(*keys).agg(
        *(F.count_if(seen == name).alias(f"_n{i}") for i, name in enumerate(labels))
    )
    ranked = F.array(
        *(
            F.struct(F.col(f"_n{i}").alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("label"))
            for i, name in enumerate(labels)
        )
    )
    return counts.select(*keys, F.array_max(ranked)["label"].alias("majority"))
