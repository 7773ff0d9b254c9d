"""Operators for training data against brute force, and their defined results in odd cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from trendspark.llm import (
    bpe, decontaminate, html_text, jaccard_join, lm_score, quality_classifier, quality_rules, substring_dedup,
    url_filter, warc,
)
from trendspark.llm.hashing import text_hash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _key string, _set int, ids string"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 1, "x") for i, t in rows], DOCS)


def some_texts(seed, n, words=40, vocabulary=30):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(vocabulary)]
    return [" ".join(rng.choice(names) for _ in range(rng.randint(0, words))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, blanks, repeated rows, ties, a long text."""
    base = some_texts(3, 12)
    rows = list(enumerate(base)) + [(0, base[0]), (3, base[4]), (50, base[4]), (None, base[5]), (60, None), (61, "")]
    return rows + [(62, " \n\t "), (None, None), (70, "long " * 40_000), (71, "Ünïcode “quotes” 中文 😀 " * 9)]


# --- 1: decontamination


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(text, items, size):
    words, hit, found = plain_words(text), set(), set()
    for item, data in items:
        own = plain_words(data)
        if not own:
            continue
        wide = min(size, len(own))
        windows = {tuple(own[i:i + wide]) for i in range(len(own) - wide + 1)}
        for i in range(len(words) - wide + 1):
            if tuple(words[i:i + wide]) in windows:
                hit.update(range(i, i + wide))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 200])
def test_decontamination(spark, odd, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    texts = [t for _, t in odd if t and len(t) < 1000]
    items = [(1, texts[1]), (2, " ".join(texts[2].split()[3:20])), (3, "w1 W2"), (4, None), (5, ""), (6, texts[1])]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.with_digest(decontaminate.decontaminate(frame(spark, odd), benchmark, size=6)).collect()
    got = sorted((repr(r["doc_id"]), r["n_words"], r["n_hit"], list(r["items"])) for r in found)
    assert got == sorted((repr(i), *plain_hits(t, items, 6)) for i, t in odd)
    for r in found:
        assert r["items_sha256"] == hashlib.sha256(",".join(r["items"]).encode()).hexdigest()
        assert r["n_items"] == len(r["items"]) and r["contaminated"] == (r["n_hit"] > 0)


def test_decontamination_segments_and_filter(spark, odd, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT_WORDS", 1)
    items = [(1, odd[1][1])]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    kept = decontaminate.drop_contaminated(frame(spark, odd), benchmark)
    assert kept.columns == frame(spark, odd).columns
    want = [repr(i) for i, t in odd if not plain_hits(t, items, 10)[1]]
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(want)
    nothing = benchmark.limit(0)
    assert decontaminate.decontaminate(frame(spark, odd), nothing).filter("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(frame(spark, []), benchmark).count() == 0


def test_proximity(spark):
    docs = frame(spark, [(1, "a x b y c"), (2, "a b"), (3, "c z z z z z b a"), (4, "c b a"), (5, "b a"), (6, "c")])
    documents, postings = decontaminate.build_index(docs)
    near = decontaminate.search(documents, postings, [("q", b"a b c")], slop=2)
    near = near.join(documents, ["segment", "ordinal"])
    assert sorted({(r["doc_id"], r["start"]) for r in near.collect()}) == [(1, 0), (4, 0)]
    exact = decontaminate.search(documents, postings, [("q", b"c b a")])
    assert [(r["start"], r["words"]) for r in exact.collect()] == [(0, 3)]


# --- 2: WARC


def test_warc_round_trip(spark):
    long = "é" * 700
    rows = [(1, "http://a/\r\nx", long), (2, None, long), (2, None, long), (3, "u", ""), (4, "u", None), (None, "u", "x")]
    pages = spark.createDataFrame([(*r, "f", 9) for r in rows], "page_id bigint, url string, html string, _first string, payload int")
    manifest = warc.write_archives(warc.page_records(pages), warc.new_folder(spark), archive_bytes=300)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    found = warc.read_archives(manifest).collect()
    got = sorted((r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload"]) for r in found)
    full = long.encode()
    assert got == sorted(
        [
            ("urn:page:1", "revisit", "urn:page:2", 1400, None), ("urn:page:2", "response", None, 1400, full),
            ("urn:page:2", "response", None, 1400, full), ("urn:page:3", "response", None, 0, b""),
            ("urn:page:4", "response", None, 0, b""), ("urn:page:null", "response", None, 1, b"x"),
        ]
    )
    assert {r["payload_digest"] for r in found if r["payload_bytes"] == 1400} == {hashlib.sha1(full).hexdigest()}
    empty = warc.write_archives(warc.page_records(pages.limit(0)), warc.new_folder(spark))
    assert warc.read_archives(empty).count() == 0


class Slow:
    """A stream that gives few bytes at once."""

    def __init__(self, data, step):
        self.data, self.step = data, step

    def read(self, _):
        piece, self.data = self.data[: self.step], self.data[self.step:]
        return piece


def archive(*records):
    return b"".join(zlib.compress(r, wbits=31) for r in records)


def test_warc_framing(monkeypatch):
    one = warc.record_bytes("urn:page:1", "http://a", "response", None, b"\r\n\r\n<p>" * 500)
    two = warc.record_bytes("urn:page:2", None, "revisit", "urn:page:1", b"abc")
    for step in (1, 7, 1 << 20):
        monkeypatch.setattr(warc, "STEP", 11)
        found = list(warc.read_records(Slow(archive(one, two), step)))
        assert [(r["record_id"], r["payload_bytes"]) for r in found] == [("urn:page:1", 3500), ("urn:page:2", 3)]
        assert found[0]["payload"] == b"\r\n\r\n<p>" * 500 and found[1]["payload"] is None
    for broken in (one[:-8], one.replace(b"<p>", b"<q>", 1), one + b"x"):
        with pytest.raises(ValueError):
            list(warc.read_records(Slow(archive(broken), 99)))
    with pytest.raises(ValueError):
        list(warc.read_records(Slow(archive(one)[:-12], 99)))


def test_warc_long_url(spark):
    url = "http://a/" + "é/" * (1 << 20)
    plain = [warc.record_bytes(f"urn:page:{i}", u, "response", None, b"abc") for i, u in ((1, url), (2, "u"))]
    for step in (1000, 1 << 20):
        found = list(warc.read_records(Slow(archive(*plain), step)))
        assert [(r["target_uri"], r["payload"]) for r in found] == [(url, b"abc"), ("u", b"abc")]
    with pytest.raises(ValueError, match="no end of headers"):
        list(warc.read_records(Slow(archive(plain[0][: 1 << 21]), 1 << 20)))
    pages = spark.createDataFrame([(1, url, "x"), (2, "u", "y")], "page_id bigint, url string, html string")
    manifest = warc.write_archives(warc.page_records(pages), warc.new_folder(spark))
    assert {r["target_uri"] for r in warc.read_archives(manifest, with_payload=False).collect()} == {url, "u"}


# --- 3: quality classifier


def test_classifier(spark, odd):
    good, bad = some_texts(5, 150), ["### ".join(t.split()) + "###" for t in some_texts(6, 150, 30)]
    rows = list(enumerate(t + " ok" for t in good)) + [(1000 + i, t) for i, t in enumerate(bad)]
    docs = frame(spark, rows + [(5000, None), (5001, ""), (5000, None)])
    labels = spark.createDataFrame(
        [(i, int(i < 1000), 0) for i, _ in rows] + [(5000, None, 0), (9999, 1, 0)], "doc_id bigint, quality int, toxic int"
    )
    learn = F.col("doc_id") % 3 != 1
    found = {r["doc_id"]: r for r in quality_classifier.classify(docs, labels, learn).collect()}
    held = [i for i, _ in rows if i % 3 == 1]
    assert np.mean([found[i]["predicted"] == int(i < 1000) for i in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found.values())
    assert found[5000]["score"] == found[5001]["score"]
    kept = quality_classifier.keep_good(docs, labels, learn)
    assert kept.columns == docs.columns
    want = sorted(r for r in [*found, 5000] if found[r]["predicted"])
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    none = quality_classifier.classify(frame(spark, odd), labels.limit(0), learn).collect()
    assert len(none) == len(odd) and {r["score"] for r in none} == {0.5}
    assert quality_classifier.classify(frame(spark, []), labels, learn).count() == 0


def test_temperature_is_fitted():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 65))
    y = (x[:, 0] + rng.normal(size=2000) > 0).astype(float)
    model = quality_classifier.Network(x, y)
    p = model.probability(x)
    assert abs(p.mean() - y.mean()) < 0.05 and 0.25 <= model.temperature <= 8


# --- 4: HTML extraction

PAGE = """<!doctype html><html><head><title>No</title><style>p{}</style></head><body class="menu">
<header><a href=/>Site</a></header><nav><ul><li>One<li>Two</ul></nav><div class="cookie-notice">We use cookies, always.</div>
<article><h1>A  title</h1><p>First &amp; <b>bold</b>\n text, long enough to count as content.<p>Second one; it is here too.<br>Line.
<script>var a = "</p>";</script><div class="ad">Buy now, or never.</div><ul><li>item</li></ul></article>
<aside>Side, bar.</aside><div id="comments"><p>I disagree, strongly, with every word.</p></div>
<form><p>Name, please.</p></form><footer>&copy; 2020, us.</footer></body></html>"""


def test_html():
    assert html_text.main_text(PAGE) == (
        "A title First & bold text, long enough to count as content. Second one; it is here too. Line. item"
    )
    assert html_text.main_text("") == html_text.main_text("<nav>x</nav>") == html_text.main_text("<!-- <p>a") == ""
    assert html_text.main_text("<div><p>Text, as it is.</p><p>More of it.") == "Text, as it is. More of it."
    assert html_text.main_text("<p>a < b, &am") == "a < b, &am"


BODY = "<p>The first sentence of the body, long enough.</p><p>The second one; it is here, too.</p>"
BODY_TEXT = "The first sentence of the body, long enough. The second one; it is here, too."


@pytest.mark.parametrize("mark", [
    'div class="layout has-sidebar"', 'div class="no-banner"', 'div id="related-work"', 'form id="aspnetForm" action="/"',
    'div role="form"', 'section class=widget',
])
def test_html_hints_keep_articles(mark):
    end = f"</{mark.split()[0]}>"
    menu = '<div class="menu"><a href="/">Home</a></div>'
    for body in (BODY, f"<article>{BODY}</article>", f"<main>{BODY}</main>"):
        assert html_text.main_text(f"<body><{mark}>{body}{end}</body>") == BODY_TEXT
        assert html_text.main_text(f"<body><nav>One</nav><{mark}>{menu}{body}{end}<footer>Us.</footer></body>") == BODY_TEXT
    # A short article stays as it is one.
    assert html_text.main_text(f"<{mark}><article><p>Short</p></article>{end}") == "Short"
    # Equal tags and classes with other ids are other paths.
    assert html_text.main_text(f'<div id="menu"><p>Go</p></div><div id="text">{BODY}</div>') == BODY_TEXT


def test_html_attributes():
    for mark in ('href="/x?id=share"', 'data-id="ad-12"', 'title="The hidden cost"', "data-x='a class=ad' href=/y",
                 'title="display:none"', 'data-role="menu"', 'aria-hidden="false"', "href=/a?class=menu"):
        assert html_text.main_text(f"<article><p>Some text, <a {mark}>a link</a>ed word.</p></article>") == "Some text, a linked word."
    for mark in ('CLASS = "ad"', "data-y='class' id=share", "hidden", "hidden=''", 'style="color:red; display : none"', "role=menu"):
        page = f"<article>{BODY * 3}<div {mark}>Go, on.</div></article>"
        assert html_text.main_text(page) == " ".join([BODY_TEXT] * 3)
    # A hinted inline element that stays doesn't part words.
    assert html_text.main_text('<p>un<b class="no-banner">brok</b>en <i class="ad">word</i></p>'.replace("<p>", "<form>")) == "unbroken word"


def test_html_frame(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "u", ""), (3, "u", "<p>" + "word, " * 100_000)]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id bigint, url string, html string, text string")
    found = html_text.extract(pages).collect()
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    assert max(r["n_chars"] for r in found) == 6 * 100_000 - 1
    assert html_text.extract(pages.limit(0)).count() == 0


# --- 5: byte-level BPE


def test_bpe_equals_the_library():
    ranks = bpe.load_ranks(PATH)
    own = bpe.Encoder(ranks, PATTERN)
    known = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    letters = "ab c\n\t\x1c\x85\xa0\u2003\u3000'sTtéß中😀12#$  \r\u200b"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += ["a" * 3000, "ab" * 2000, " " * 999 + "x", "é" * 900, "<|endoftext|>"]
    for text in texts:
        ids = [i for part in own.encode(text) for i in part]
        assert ids == known.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_bpe_slices(monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 50)
    monkeypatch.setattr(bpe, "RUN", 3)
    ranks = bpe.load_ranks(PATH)
    known = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    own, rng = bpe.Encoder(ranks, PATTERN), random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("abc  \n\t'1#é") for _ in range(400))
        assert [i for part in own.encode(text) for i in part] == known.encode_ordinary(text)


def test_bpe_frames(spark, odd):
    docs = frame(spark, odd)
    both = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in both) and len(both) == len(odd)
    digests = {(r["doc_id"], r["n_tokens"]): r for r in bpe.round_trip(docs, PATH, PATTERN).collect()}
    for r in both:
        own = digests[r["doc_id"], len(r["ids"])]
        assert own["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
        assert own["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.round_trip(frame(spark, []), PATH, PATTERN).count() == 0


# --- 6: substring dedup


def plain_kept(rows, size):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = {}
    for words in split:
        for i in range(len(words) - size + 1):
            key = tuple(words[i:i + size])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for words in split:
        gone = {
            p for i in range(len(words) - size + 1) if seen[tuple(words[i:i + size])] > 1 for p in range(i, i + size)
        }
        out.append([w for p, w in enumerate(words) if p not in gone])
    return split, out


@pytest.mark.parametrize("slice_bytes", [1 << 24, 64])
def test_substring_dedup(spark, odd, monkeypatch, slice_bytes):
    monkeypatch.setattr(substring_dedup, "SLICE_BYTES", slice_bytes)
    shared = some_texts(9, 1, 60)[0]
    rows = odd + [(80, "a b " + shared + " c"), (81, shared + " d e f g"), (82, "x " + shared)]
    split, kept = plain_kept(rows, 10)
    found = substring_dedup.removal_digest(frame(spark, rows), size=10, mer=3).collect()
    want = sorted(
        (repr(i), len(s), len(s) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest())
        for (i, _), s, k in zip(rows, split, kept, strict=True)
    )
    assert sorted((repr(r[0]), *r[1:]) for r in found) == want
    left = substring_dedup.remove_repeats(frame(spark, rows), size=10, mer=3)
    assert left.columns == frame(spark, rows).columns
    texts = sorted(repr(r["text"]) for r in left.collect())
    assert texts == sorted(
        repr(t if len(k) == len(s) else " ".join(k)) for (_, t), s, k in zip(rows, split, kept, strict=True)
    )
    assert substring_dedup.removal_digest(frame(spark, []), size=10, mer=3).count() == 0


def test_frequent_runs_and_colliding_hashes(monkeypatch):
    strings = [b"a b c d", b"x b c d", b"a b c e"]
    times = np.array([1, 1, 1])
    expect = {(0, 1), (1, 1), (0, 0), (2, 0)}
    of, offset = substring_dedup.repeated_windows(strings, times, 3)
    assert set(zip(of.tolist(), offset.tolist(), strict=True)) == expect
    monkeypatch.setattr(substring_dedup, "run_hashes", lambda codes, n: np.zeros(len(codes) - n + 1, np.uint64))
    of, offset = substring_dedup.repeated_windows(strings, times, 3)
    assert set(zip(of.tolist(), offset.tolist(), strict=True)) == expect
    codes = np.arange(40, dtype=np.uint64)
    assert substring_dedup.sliding_least(codes, 7).tolist() == list(range(34))


def test_text_hash_is_sparks(spark):
    for text in ("", "abc", "é中" * 50):
        assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] == text_hash(text.encode())


# --- 7: quality rules


def plain_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    many = {w for w in windows if windows.count(w) > 1}
    cover = {p for i, w in enumerate(windows) if w in many for p in range(i, i + 8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(cover)


def test_rule_counts():
    rng = random.Random(4)
    for k in range(300):
        parts = [rng.choice(["a", "b", "c#", "é|", "\n", "\x1c", "\xa0", " \r"]) for _ in range(rng.randint(0, 60))]
        text = rng.choice([" ", "\n", "\t"]).join(parts) + (" z q r s t u v w" * (k % 3))
        assert quality_rules.count(text.encode())[:5] == plain_rules(text)
    assert quality_rules.repeated([b"a"] * 9) == 9 and quality_rules.repeated([b"a"] * 8) == 0


def test_judge(spark, odd):
    rng = random.Random(8)
    good = [(i, " ".join(f"word{rng.randint(0, 900)}" for _ in range(rng.randint(25, 60))) + ".") for i in range(300)]
    bad = [(1000 + i, " ".join(f"$$##{rng.randint(0, 900)}||" for _ in range(40))) for i in range(20)]
    docs = frame(spark, good + bad + odd)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad], "doc_id bigint, quality int, toxic int")
    found = quality_rules.judge(docs, labels, most=0.05).collect()
    assert len(found) == len(good + bad + odd)
    kept = {r["doc_id"]: r["kept"] for r in found if r["n_words"] >= 25}
    assert sum(kept[i] for i, _ in good[12:]) >= 285 and not any(kept[i] for i, _ in bad)
    assert all(not r["kept"] for r in found if r["base_failed"])
    assert all(r["base_failed"] for r in found if r["n_words"] < 20)
    free = quality_rules.judge(docs, labels.limit(0)).filter("not kept and not base_failed")
    assert free.count() == 0
    assert quality_rules.judge(frame(spark, []), labels).count() == 0


# --- 8: Jaccard join


def plain_sets(texts, size):
    out = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    return out


def plain_components(rows, size, percent):
    sets = plain_sets([t for _, t in rows], size)
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return sets, root


def near_copies(seed, groups=8, copies=12):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}w{rng.randint(0, 10_000)}" for _ in range(rng.choice([1, 3, 5, 8, 14, 20, 40, 90, 200]))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 99)}"
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("block, percent", [(jaccard_join.BLOCK_SHINGLES, 85), (60, 80)])
def test_jaccard(spark, odd, monkeypatch, block, percent):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    rows = near_copies(block) + [((i or 0) + 1000 if i is not None else None, t) for i, t in odd]
    sets, root = plain_components(rows, 4, percent)
    found = jaccard_join.components(frame(spark, rows), percent=percent).collect()
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted(
        (repr(i), len(s), repr(least.get(r, i) if s else i)) for (i, _), s, r in zip(rows, sets, root, strict=True)
    )
    assert sorted((repr(r[0]), r[1], repr(r[2])) for r in found) == want
    kept = jaccard_join.keep_one(frame(spark, rows), percent=percent)
    assert kept.columns == frame(spark, rows).columns
    blank = [repr(i) for (i, _), s in zip(rows, sets, strict=True) if not s]
    first = [repr(least.get(r)) for r in {r for r, s in zip(root, sets, strict=True) if s}]
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(blank + first)


def test_jaccard_empty(spark):
    assert jaccard_join.components(frame(spark, [])).count() == 0
    assert jaccard_join.components(frame(spark, [(1, None), (2, "")])).filter("component_id != doc_id").count() == 0


def test_pigeonhole_loses_no_link():
    """Pairs at the very threshold share an entry, whatever their sizes and empty segments."""
    schemes, rng = jaccard_join.Schemes(85), np.random.default_rng(3)
    for _ in range(1500):
        n = int(rng.integers(1, 130))
        whole = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        lost = int(rng.integers(0, len(whole) * 15 // 100 + 1))
        fresh = int(rng.integers(0, 12))
        other = np.unique(np.concatenate([whole[lost:], rng.integers(0, 1 << 63, fresh).astype(np.uint64)]))
        common = len(np.intersect1d(whole, other))
        if len(other) and 100 * common >= 85 * (len(whole) + len(other) - common):
            a, b = jaccard_join.entries(whole, schemes), jaccard_join.entries(other, schemes)
            assert len(np.intersect1d(a, b)), (len(whole), len(other), common)


# --- 9: URL filters


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    fit = [
        (len(h + p), h + p, a) for a, h, p in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fit, default=None)
    return host, path, best[1] if best else None, best[2] if best else "allow"


@pytest.mark.parametrize("rows_in_block", [1024, 3])
def test_url_filter(spark, monkeypatch, rows_in_block):
    monkeypatch.setattr(url_filter, "BLOCK_ROWS", rows_in_block)
    rng = random.Random(6)
    hosts = [".".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(40)]
    paths = ["", "/"] + ["/" + "".join(rng.choice("xy/") for _ in range(rng.randint(1, 5))) for _ in range(40)]
    rules = sorted({(rng.choice(hosts), rng.choice(paths)) for _ in range(60)})
    rules = [(rng.choice(["allow", "block"]), h, p) for h, p in rules]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/', '#f'])}" for _ in range(300)]
    urls += [None, "", "a.b/x", "://", "http://", "HTTP://A.B/X", "x://é.b/中?", urls[0], urls[0], "http://a" + "/x" * 300]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id bigint, url string, host string, _best int")
    table = spark.createDataFrame(rules + [rules[0]], "action string, host string, path string")
    found = url_filter.filter_urls(pages, table).collect()
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in found)
    assert got == [(i, *plain_verdict(u, rules)) for i, u in enumerate(urls)]
    assert url_filter.filter_urls(pages.limit(0), table).count() == 0
    assert url_filter.filter_urls(pages, table.limit(0)).filter("verdict = 'allow' and rule is null").count() == len(urls)


def test_url_filter_long_path(spark, monkeypatch):
    """A long url at the start of a block is not cut at each of its characters."""
    monkeypatch.setattr(url_filter, "BLOCK_ROWS", 1)
    long = "/x" * 100_000
    pages = spark.createDataFrame([(1, f"http://a.b{long}"), (2, "http://a.b/y")], "page_id bigint, url string")
    rules = [("block", "a.b", "/x/x"), ("allow", "b", ""), ("block", "a.b", "/x/y")]
    found = url_filter.filter_urls(pages, spark.createDataFrame(rules, "action string, host string, path string")).collect()
    got = sorted((r["page_id"], r["path"], r["rule"], r["verdict"]) for r in found)
    assert got == [(1, long, "a.b/x/x", "block"), (2, "/y", "b", "allow")]


# --- 10: language model


def plain_ctw(train, text):
    """Context-tree weighting by its recursive definition, after training."""
    depth = lm_score.DEPTH

    def steps(data):
        padded = b"\n" * depth + data
        for at in range(depth, len(padded)):
            byte = padded[at]
            for k in range(8):
                yield padded[at - depth:at], (1 << k) | (byte >> (8 - k)), byte >> (7 - k) & 1

    counts = {}
    for data in train:
        for context, node, bit in steps(data):
            for d in range(depth + 1):
                counts.setdefault((context[depth - d:], node), [0, 0])[bit] += 1
    children = {}
    for context, node in counts:
        if context:
            children.setdefault((context[1:], node), []).append((context, node))
    log = {}

    def estimate(pair):
        a, b = pair
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    for name in sorted(counts, key=lambda n: -len(n[0])):
        own = estimate(counts[name])
        if len(name[0]) == depth:
            log[name] = own, 0.0, own
        else:
            below = sum(log[c][2] for c in children[name])
            log[name] = own, below, np.logaddexp(own, below) - math.log(2)
    total = 0.0
    for context, node, bit in steps(text):
        p = None
        for d in range(depth, -1, -1):
            name = (context[depth - d:], node)
            a, b = counts.get(name, (0, 0))
            one = (b + 0.5) / (a + b + 1)
            if p is None:
                p = one
            else:
                own, below, _ = log.get(name, (0.0, 0.0, 0.0))
                weight = 1 / (1 + math.exp(below - own))
                p = weight * one + (1 - weight) * p
        total += math.log10(p if bit else 1 - p)
    return total


@pytest.mark.parametrize("chunk", [lm_score.CHUNK_BYTES, 500])
def test_lm_scores(spark, odd, monkeypatch, chunk):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(lm_score, "STRIDE", 300)
    rows = [(i, t) for i, t in odd if not t or len(t) < 1000] + [(90, "NEW zz W1"), (90, "NEW zz W1")]
    held = F.col("doc_id") % 3 == 0
    split = [(i is not None and i % 3 == 0, (t or "").encode().lower().split()) for i, t in rows]
    train = [words for out, words in split if not out]
    counts = {}
    for words in train:
        for w in [*words, None]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    streams = [b" ".join(w) + b"\n" for w in train]
    want = []
    for (i, _), (out, words) in zip(rows, split, strict=True):
        base = sum(math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in [*words, None])
        known = sum(w in counts for w in [*words, None])
        want.append((repr(i), out, len(words) + 1, known, n, base, plain_ctw(streams, b" ".join(words) + b"\n")))
    found = lm_score.score(frame(spark, rows), held).collect()
    got = sorted((repr(r[0]), *r[1:]) for r in found)
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-5)


def test_lm_without_training(spark, odd):
    found = lm_score.score(frame(spark, odd[:3]), F.lit(True)).collect()
    for r in found:
        assert r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] < 0
    assert lm_score.score(frame(spark, []), F.lit(False)).count() == 0


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7, 1e3, 1e7])
    assert np.allclose(lm_score.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)
