"""The same results in SQL over the same tables, one statement per checkable query."""

from __future__ import annotations

from trendspark.functions.wordlists import SUPPORTED_LANGUAGES, stopwords


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


POSTS = """posts AS (
  SELECT d.doc_id AS ingest_seq, CAST(d.doc_id AS VARCHAR) AS id, d.lang AS category,
    CASE WHEN d.source = 'src19' THEN -1 ELSE CAST(substr(d.source, 4) AS INTEGER) END AS topic,
    CASE WHEN l.doc_id IS NULL THEN 'espn' WHEN d.lang = 'es' THEN 'other' ELSE 'reddit' END AS source,
    regexp_extract(d.text, '^[^.\\n]*', 0) AS title, d.text AS text,
    COALESCE(NULLIF(l.quality, 0), NULLIF(d.n_chars, 0), 0) AS popularity,
    1704067200 + d.doc_id * 3600 AS secs
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

COMPOSED = """composed AS (
  SELECT *, CASE
    WHEN source = 'reddit' THEN regexp_replace(title || E'\\n\\n' || text, '^\\s+|\\s+$', '', 'g')
    WHEN source = 'espn' THEN regexp_replace(E'\\n\\n' || title || E'\\n\\n' || text, '^\\s+|\\s+$', '', 'g')
    ELSE text END AS composed
  FROM posts)"""


def term_counts(stop=None, base: str = "posts") -> str:
    stop = quoted(stopwords() if stop is None else stop)
    return f"""toks AS (
  SELECT category, topic, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'),
    lambda w: length(w) >= 2 AND w NOT IN ({stop})) AS t FROM {base}),
grams AS (
  SELECT category, topic, unnest(t) AS term FROM toks
  UNION ALL
  SELECT category, topic, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM toks),
counts AS (SELECT category, topic, term, count(*) AS n FROM grams GROUP BY ALL),
vocab AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY total DESC, term) AS r
    FROM (SELECT category, term, sum(n) AS total FROM counts GROUP BY ALL)) WHERE r <= 1000),
n_topics AS (SELECT category, count(DISTINCT topic) AS topics FROM {base} GROUP BY ALL)"""


WEIGHTS = """mass AS (SELECT category, floor(sum(total) / max(topics)) AS a
  FROM vocab JOIN n_topics USING (category) GROUP BY category),
weights AS (
  SELECT category, topic, term, n,
    n / sum(n) OVER (PARTITION BY category, topic) * ln(1 + a / total) AS weight
  FROM counts JOIN vocab USING (category, term) JOIN mass USING (category))"""

KEYWORDS = """kw AS (
  SELECT category, topic, list(term ORDER BY r) AS keywords FROM (
    SELECT *, row_number() OVER (PARTITION BY category, topic ORDER BY round(weight, 9) DESC, term) AS r
    FROM weights) WHERE r <= 10 GROUP BY category, topic)"""

TOP = """top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category, topic
    ORDER BY popularity DESC, ingest_seq) AS rank FROM composed) WHERE rank <= 5)"""

TITLES = """titles AS (
  SELECT category, topic, list(title ORDER BY rank) AS top_titles FROM top WHERE title <> '' GROUP BY ALL)"""

INPUTS = """inputs AS (
  SELECT category, topic, array_to_string(list_filter(regexp_split_to_array(
      string_agg(composed, E'\\n\\n' ORDER BY rank), '\\s+'), lambda w: w <> '')[1:1024], ' ') AS summary_input
  FROM top WHERE composed <> '' GROUP BY ALL)"""

DATES = """dates AS (
  SELECT category, topic, count(*) AS total_posts,
    strftime(make_timestamp(min(secs) * 1000000), '%Y-%m-%d') AS start_date,
    strftime(make_timestamp(max(secs) * 1000000), '%Y-%m-%d') AS end_date
  FROM posts GROUP BY ALL)"""


def summaries() -> str:
    stop = quoted(stopwords())
    return f"""sent AS (
  SELECT category, topic, unnest(range(0, len(s))) AS pos, trim(unnest(s)) AS sentence
  FROM (SELECT category, topic, regexp_extract_all(summary_input, '[^.!?]+[.!?]*') AS s FROM inputs)),
sent_toks AS (
  SELECT category, topic, pos, sentence,
    list_filter(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}_]+'),
      lambda w: length(w) >= 2 AND w NOT IN ({stop})) AS t,
    len(list_filter(regexp_split_to_array(sentence, '\\s+'), lambda w: w <> '')) AS tokens
  FROM sent WHERE sentence <> ''),
sent_terms AS (
  SELECT category, topic, pos, unnest(t) AS term FROM sent_toks
  UNION ALL
  SELECT category, topic, pos, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))
  FROM sent_toks),
sent_scores AS (
  SELECT category, topic, pos, avg(COALESCE(weight, 0)) AS score
  FROM sent_terms LEFT JOIN weights USING (category, topic, term) GROUP BY ALL),
scored AS (
  SELECT category, topic, pos, sentence, tokens, sum(tokens) OVER (PARTITION BY category, topic
    ORDER BY round(COALESCE(score, 0), 9) DESC, pos ROWS UNBOUNDED PRECEDING) AS used
  FROM sent_toks LEFT JOIN sent_scores USING (category, topic, pos)),
chosen AS (
  SELECT category, topic, string_agg(sentence, ' ' ORDER BY pos) AS text
  FROM scored WHERE used <= 80 OR used - tokens < 10 GROUP BY ALL),
sums AS (
  SELECT category, topic, COALESCE(array_to_string(regexp_split_to_array(text, '\\s+')[1:80], ' '),
    '[No summary: not enough content]') AS summary
  FROM inputs LEFT JOIN chosen USING (category, topic))"""


TRENDS = """trends AS (
  SELECT topic AS cluster_id, total_posts, category, keywords,
    COALESCE(summary, '[No summary: not enough content]') AS summary,
    COALESCE(top_titles, []) AS top_titles, start_date, end_date
  FROM kw LEFT JOIN dates USING (category, topic) LEFT JOIN titles USING (category, topic)
    LEFT JOIN sums USING (category, topic))"""

KNOWN = "cluster_id <> -1 AND category IN ('en', 'fr', 'de', 'es')"

CARDS = f"""hot AS (
  SELECT *, row_number() OVER (ORDER BY total_posts DESC, category, cluster_id)
    <= greatest(3, (SELECT count(*) // 10 FROM trends WHERE {KNOWN})) AS is_hot
  FROM trends WHERE {KNOWN}),
overlap AS (
  SELECT category, cluster_id, i, t, len(list_intersect(
      list_distinct(regexp_extract_all(lower(summary), '[\\p{{L}}\\p{{N}}_]+')),
      list_distinct(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+')))) AS shared
  FROM (SELECT category, cluster_id, summary, unnest(top_titles) AS t,
    unnest(range(0, len(top_titles))) AS i FROM trends)),
best AS (
  SELECT category, cluster_id, first(t ORDER BY shared DESC, i) AS display_title FROM overlap GROUP BY ALL),
cards AS (
  SELECT category, cluster_id, is_hot, COALESCE(display_title, '(No title)') AS display_title,
    (CASE WHEN is_hot THEN '🔥 ' ELSE '' END) || COALESCE(display_title, '(No title)') || ' (' || total_posts
      || ' posts) [' || start_date || ' – ' || end_date || ']' AS header,
    upper(category[1]) || lower(category[2:]) AS category_label,
    array_to_string(keywords, ' | ') AS keyword_line, summary,
    array_to_string(list_filter(top_titles, lambda t: t <> COALESCE(display_title, '(No title)')), '|') AS other_titles
  FROM hot LEFT JOIN best USING (category, cluster_id))"""


def with_(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def trend_query(select: str, base: str = POSTS, *more: str) -> str:
    return with_(
        base, COMPOSED, term_counts(), WEIGHTS, KEYWORDS, TOP, TITLES, INPUTS, DATES, summaries(), TRENDS,
        *more, select=select,
    )


def keyword_query(select: str) -> str:
    return with_(POSTS, term_counts(), WEIGHTS, KEYWORDS, select=select)


READABLE = """SELECT cluster_id, total_posts, category, array_to_string(keywords, '|') AS keywords, summary,
  array_to_string(top_titles, '|') AS top_titles, start_date, end_date FROM trends"""

CLEAN = "trim(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f\\p{Cf}\\p{Co}]', '', 'g'), '\\s+', ' ', 'g'))"

LINES = """lines AS (
  SELECT doc_id AS line, md5(text) AS id, source, lang = 'de' AS broken,
    CASE WHEN n_chars < 500 THEN ['id', 'source'] ELSE ['id', 'source', 'lang', 'n_chars'] END AS fields
  FROM documents)"""
KNOWN_SOURCES = quoted(f"src{i}" for i in range(12))
MISSING = """SELECT line, 'missing' AS rule, unnest(list_filter({wanted}, lambda f: NOT list_contains(fields, f))) AS detail
  FROM lines WHERE NOT broken"""
DUPLICATES = """SELECT line, 'duplicate' AS rule FROM (
    SELECT line, row_number() OVER (PARTITION BY id ORDER BY line) AS r FROM lines WHERE NOT broken) WHERE r > 1"""

BUCKET = "CAST('0x' || substr(md5({gram}), 1, 4) AS INTEGER)"
TRIGRAMS = """SELECT {keys}, unnest(list_transform(range(1, greatest(length(h) - 2, 1) + 1), lambda i: substr(h, i, 3))) AS gram
  FROM (SELECT {keys}, lower(substr({clean}, 1, 200)) AS h FROM {table})"""
WHOLE = TRIGRAMS.replace("lower(substr({clean}, 1, 200))", "lower({clean})")
PROFILE = f"""raw AS ({WHOLE.format(keys='lang', clean=CLEAN, table='documents')}),
seen AS (SELECT lang, {BUCKET.format(gram='gram')} AS bucket, count(*) AS n FROM raw GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS total FROM seen GROUP BY lang),
profile AS (SELECT lang, bucket, n, ln((n + 1) / (total + 65536)) AS logp FROM seen JOIN totals USING (lang))"""

TRANSLATED = """SELECT doc_id, CASE WHEN lang = 'en' THEN {clean} ELSE array_to_string(list_transform(
  {tokens}, lambda w: CASE WHEN regexp_full_match(w, '[\\p{{L}}\\p{{N}}_]+') THEN reverse(lower(w)) ELSE w END), ' ') END AS text_en
  FROM (SELECT *, regexp_split_to_array({clean}, ' ') AS toks FROM documents)"""
CHUNKED = "flatten(list_transform(range(0, greatest(0, len(toks) - 51) + 1, 410), lambda s: toks[s + 1:s + 460]))"

PAIRS = """pairs AS (
  SELECT q.vec_id AS src, b.vec_id AS dst, b.label AS topic, list_sum(list_transform(
    list_zip(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2
  FROM embeddings q, embeddings b {where})"""
RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(d2, 9), dst) AS rank FROM pairs)"""
GRAPH = with_(PAIRS.format(where="WHERE q.vec_id <> b.vec_id"), RANKED,
    select="SELECT src, dst, rank, round(d2, 6) AS d2 FROM ranked WHERE rank <= 5")
SEARCH = with_(PAIRS.format(where=""), RANKED, select="""SELECT src AS query_id, dst AS id, rank,{topic}
    round(d2, 6) AS distance FROM ranked WHERE rank <= 5""")

REGIONS = """parts AS (
  SELECT label, vec_id, unnest(range(1, 65)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
means AS (SELECT label, i, avg(x) AS m, count(*) AS size FROM parts GROUP BY ALL),
radii AS (SELECT label, max(d2) AS radius2 FROM (
  SELECT label, vec_id, sum((x - m) * (x - m)) AS d2 FROM parts JOIN means USING (label, i) GROUP BY ALL) GROUP BY label)"""
PLACED = """placed AS (
  SELECT id, CASE WHEN round(d2, 9) <= round(radius2, 9) THEN label ELSE -1 END AS topic, d2 FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d2, 9), label) AS r FROM (
      SELECT p.vec_id AS id, m.label, sum((x - m) * (x - m)) AS d2
      FROM parts p JOIN means m ON p.i = m.i GROUP BY ALL)) JOIN radii USING (label) WHERE r = 1)"""
REACH = f"""WITH RECURSIVE {PAIRS.format(where="WHERE q.vec_id <> b.vec_id")},
  cores AS (SELECT src, max(d2) AS core FROM (SELECT src, d2, row_number() OVER (PARTITION BY src ORDER BY d2) AS r
    FROM pairs) WHERE r <= 5 GROUP BY src),
  edges AS (SELECT p.src, p.dst, round(greatest(sqrt(p.d2), sqrt(a.core), sqrt(b.core)), 9) AS w
    FROM pairs p JOIN cores a ON a.src = p.src JOIN cores b ON b.src = p.dst)"""

ORACLE: dict[str, str] = {
    "density_components": f"""{REACH},
      near AS (SELECT src, dst FROM edges WHERE w <= sqrt(1.35)),
      walk AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings
        UNION SELECT node, dst FROM walk JOIN near ON near.src = walk.seen)
      SELECT node, min(seen) AS component FROM walk GROUP BY node""",
    "topic_regions": with_(REGIONS, select="""SELECT label AS topic, size, round(m, 6) + 0.0::DOUBLE AS first,
      round(radius2, 6) AS radius2 FROM means JOIN radii USING (label) WHERE i = 1"""),
    "assign_topics": with_(REGIONS, PLACED, select="SELECT id, topic, round(d2, 6) AS d2 FROM placed"),
    "members": with_(REGIONS, PLACED, select="SELECT id FROM placed WHERE topic = 3"),
    "topic_bars": with_(POSTS, term_counts(), WEIGHTS, select="""SELECT category, topic, rank, term, round(weight, 9) AS weight
      FROM (SELECT *, row_number() OVER (PARTITION BY category, topic ORDER BY round(weight, 9) DESC, term) AS rank
        FROM weights) WHERE rank <= 5 AND topic <> -1"""),
    "vector_search": SEARCH.format(topic=" topic,"),
    "search_vector_table": SEARCH.format(topic=""),
    "search_code_table": """SELECT 'all' AS category, count(*) * least(5, count(*)) AS n_hits, true AS recalled FROM embeddings""",
    "knn_graph": GRAPH,
    "knn_graph_cells": GRAPH,
    "clean_text": f"""SELECT 'document' AS kind, doc_id AS row_id, 0 AS turn, {CLEAN} AS cleaned FROM documents
      UNION ALL SELECT 'turn', conv_id, turn, {CLEAN} FROM conversations""",
    "unified_text": """SELECT a.conv_id, a.turn, a.text || E'\\n\\n' || COALESCE(b.text, '') AS text
      FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""",
    "compose_text": with_(POSTS, COMPOSED, select="SELECT id, composed FROM composed"),
    "infer_category": """SELECT page_id, CASE
        WHEN g = 'en' THEN 'english' WHEN g = 'fr' THEN 'french'
        WHEN contains(lower(url), 'blog') OR contains(lower(url), 'thth') OR contains(lower(html), 'blog') OR contains(lower(html), 'thth') THEN 'english'
        WHEN contains(lower(url), 'nicht') OR contains(lower(url), 'für') OR contains(lower(html), 'nicht') OR contains(lower(html), 'für') THEN 'german'
        WHEN contains(lower(url), 'utm_') OR contains(lower(url), 'page=') OR contains(lower(html), 'utm_') OR contains(lower(html), 'page=') THEN 'query'
        ELSE 'other' END AS category
      FROM (SELECT *, lower(regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1)) AS g FROM pages)""",
    "valid_ids": """SELECT doc_id, id FROM (SELECT doc_id, text AS id FROM documents)
      WHERE id <> '' AND lower(trim(id)) <> 'none'""",
    "supported_language": f"""SELECT doc_id, CASE WHEN lang IN ('en', {quoted(SUPPORTED_LANGUAGES)}) THEN lang
      ELSE 'unsupported' END AS detected_language FROM documents""",
    "word_set": """SELECT doc_id, array_to_string(list_sort(list_distinct(
      regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))), '|') AS words FROM documents""",
    "popularity": with_(POSTS, select="SELECT id, popularity FROM posts"),
    "event_time_of_posts": with_(POSTS, select="SELECT id, CAST(secs AS DOUBLE) AS seconds FROM posts"),
    "published_dates": "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) - 7200 AS seconds FROM events",
    "truncate_tokens": """SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'),
      lambda w: w <> '')[1:100], ' ') AS head FROM documents""",
    "chunk_tokens": f"""SELECT doc_id, (s // 410) AS chunk_no, array_to_string(toks[s + 1:s + 460], ' ') AS chunk FROM (
      SELECT doc_id, toks, unnest(range(0, greatest(0, len(toks) - 51) + 1, 410)) AS s
      FROM (SELECT doc_id, regexp_split_to_array({CLEAN}, ' ') AS toks FROM documents))""",
    "latest_per_group": """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (
      PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 50""",
    "drop_pinned": "SELECT event_id, event_type FROM events WHERE event_type <> 'error'",
    "combine_sources": """SELECT key, part, lang, n_chars, role,
      row_number() OVER (ORDER BY rank, key, part) - 1 AS ingest_seq FROM (
        SELECT 0 AS rank, doc_id AS key, 0 AS part, lang, n_chars, NULL AS role FROM documents
        UNION ALL SELECT 1, conv_id, turn, NULL, NULL, role FROM conversations)""",
    "dedup_first": "SELECT md5(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY md5(text)",
    "json_errors": "SELECT doc_id AS line, 'json' AS rule FROM documents WHERE lang = 'de'",
    "missing_fields": with_(LINES, select=MISSING.format(wanted="['id', 'lang', 'n_chars', 'url']")),
    "duplicate_ids": with_(LINES, select=DUPLICATES),
    "validate_mixed": with_(LINES, select=MISSING.format(
        wanted=f"CASE WHEN source IN ({KNOWN_SOURCES}) THEN ['id', 'url', 'source', 'lang', 'n_chars'] ELSE ['id', 'url'] END")
        + f"""\nUNION ALL SELECT line, 'unknown_source', source FROM lines
          WHERE NOT broken AND source NOT IN ({KNOWN_SOURCES})"""),
    "validation_report": with_(LINES, select=f"""SELECT rule, count(*) AS n FROM (
        SELECT 'lines' AS rule FROM lines
        UNION ALL SELECT 'json' FROM lines WHERE broken
        UNION ALL SELECT rule FROM ({MISSING.format(wanted=f"CASE WHEN source IN ({KNOWN_SOURCES}) THEN ['id', 'source', 'lang', 'n_chars'] ELSE CAST([] AS VARCHAR[]) END")})
        UNION ALL SELECT 'unknown_source' FROM lines WHERE NOT broken AND source NOT IN ({KNOWN_SOURCES})
        UNION ALL SELECT rule FROM ({DUPLICATES})) GROUP BY rule"""),
    "collect_members": """SELECT label AS topic,
      row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS position, 'v' || vec_id AS post_id FROM embeddings""",
    "posts_of_topics": """WITH rows AS (SELECT lang AS category, source AS topic, md5(text) AS id, doc_id FROM documents),
      last AS (SELECT category, id, max(doc_id) AS ingest_seq FROM rows GROUP BY ALL)
      SELECT category, topic, id, last.ingest_seq FROM rows JOIN last USING (category, id)""",
    "attach_topics": "SELECT doc_id AS id, lang, quality AS topic FROM documents JOIN labels USING (doc_id)",
    "check_alignment": """SELECT 'unlabelled_posts' AS side, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
      UNION ALL SELECT 'labels_without_post', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
    "number_topics": with_(POSTS, select="""SELECT category, topic, size, CASE WHEN topic = -1 THEN -1 ELSE
        row_number() OVER (PARTITION BY category, topic = -1 ORDER BY size DESC, first_seq) - 1 END AS number
      FROM (SELECT category, topic, count(*) AS size, min(ingest_seq) AS first_seq FROM posts GROUP BY ALL)"""),
    "majority_label": """SELECT source, first(lang ORDER BY n DESC, o) AS majority FROM (
        SELECT source, lang, count(*) AS n, list_position(['fr', 'de', 'es', 'en'], lang) AS o
        FROM documents GROUP BY ALL) GROUP BY source""",
    "ctfidf": with_(POSTS, term_counts(), WEIGHTS,
        select="SELECT category, topic, term, n, round(weight, 9) AS weight FROM weights"),
    "ctfidf_parity": with_(POSTS, term_counts(stopwords(parity=True)), select="""SELECT category, topic, term, n,
        round(x / sum(x) OVER (PARTITION BY category, topic) * ln(1 + a / f), 9) AS weight FROM (
          SELECT *, floor(sum(x) OVER (PARTITION BY category) / topics) AS a FROM (
            SELECT *, sum(x) OVER (PARTITION BY category, term) AS f FROM (
              SELECT *, y / sqrt(sum(y * y) OVER (PARTITION BY category, topic)) AS x FROM (
                SELECT *, n * (ln((1 + topics) / (1 + count(*) OVER (PARTITION BY category, term))) + 1) AS y
                FROM counts JOIN vocab USING (category, term) JOIN n_topics USING (category)))))"""),
    "topic_keywords": keyword_query("SELECT category, topic, array_to_string(keywords, '|') AS keywords FROM kw"),
    "topic_titles": keyword_query("""SELECT category, topic, topic || '_' || array_to_string(keywords[1:4], '_') AS title
      FROM kw WHERE topic <> -1"""),
    "topic_info": keyword_query("""SELECT category, topic, size,
        COALESCE(topic || '_' || array_to_string(keywords[1:4], '_'), CAST(topic AS VARCHAR)) AS name
      FROM (SELECT category, topic, count(*) AS size FROM posts GROUP BY ALL) LEFT JOIN kw USING (category, topic)"""),
    "enrich_topics": keyword_query("""SELECT category, topic,
        CASE WHEN topic = -1 OR keywords IS NULL THEN '' ELSE topic || '_' || array_to_string(keywords[1:4], '_') END AS title,
        COALESCE(array_to_string(keywords, '|'), '') AS keywords
      FROM (SELECT DISTINCT category, topic FROM posts UNION ALL SELECT DISTINCT role, 0 FROM conversations)
        LEFT JOIN kw USING (category, topic)"""),
    "top_posts": with_(POSTS, COMPOSED, TOP, select="SELECT category, topic, rank, id, popularity FROM top"),
    "top_titles": with_(POSTS, COMPOSED, TOP, TITLES,
        select="SELECT category, topic, array_to_string(top_titles, '|') AS top_titles FROM titles"),
    "trend_dates": with_(POSTS, DATES, select="SELECT * FROM dates"),
    "event_dates": """SELECT user_id, strftime(min(ts), '%Y-%m-%d') AS start_date,
      strftime(max(ts), '%Y-%m-%d') AS end_date FROM events GROUP BY user_id""",
    "summary_input": with_(POSTS, COMPOSED, TOP, INPUTS, select="SELECT * FROM inputs"),
    "summarize": trend_query("SELECT category, topic, summary FROM sums"),
    "trend_rows": trend_query(READABLE),
    "filter_trends": trend_query(f"{READABLE} WHERE {KNOWN} AND category <> 'es'"),
    "search_trends": trend_query(f"""{READABLE} WHERE contains(lower(summary), 'the en')
      OR len(list_filter(top_titles, lambda t: contains(lower(t), 'the en'))) > 0"""),
    "keyword_facet": keyword_query("SELECT DISTINCT unnest(keywords) AS keyword FROM kw"),
    "filter_by_keyword": keyword_query("""SELECT category, topic, array_to_string(keywords, '|') AS keywords
      FROM kw WHERE list_contains(keywords, 'th')"""),
    "best_title": trend_query("""SELECT category, cluster_id, COALESCE(display_title, '(No title)') AS title
      FROM trends LEFT JOIN best USING (category, cluster_id)""", POSTS, CARDS),
    "hot_trends": trend_query("SELECT category, cluster_id, total_posts, is_hot FROM hot", POSTS, CARDS),
    "hot_trends_parity": trend_query("""SELECT category, cluster_id, total_posts,
      cluster_id IN (SELECT cluster_id FROM hot WHERE is_hot) AS is_hot FROM hot""", POSTS, CARDS),
    "recent_trends": trend_query(
        "SELECT category, cluster_id, end_date, false AS is_hot FROM trends WHERE cluster_id <> -1 AND category = 'en'"),
    "trend_cards": trend_query("SELECT * FROM cards", POSTS, CARDS),
    "top_trends": trend_query("SELECT * FROM cards", f"""{POSTS.replace('posts AS', 'all_posts AS')},
cleaned AS (SELECT * REPLACE ({CLEAN} AS text), text AS raw FROM all_posts),
posts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY ingest_seq) AS r FROM cleaned) WHERE r = 1)""", CARDS),
    "language_profile": with_(PROFILE, select="SELECT lang, bucket, n, round(logp, 9) AS logp FROM profile"),
    "detect_language": with_(PROFILE, f"""grams AS (
        SELECT conv_id, turn, {BUCKET.format(gram='gram')} AS bucket FROM (
          {TRIGRAMS.format(keys='conv_id, turn', clean=CLEAN, table='conversations')}))""",
        select=f"""SELECT c.conv_id, c.turn, COALESCE(language, 'en') AS language FROM conversations c LEFT JOIN (
          SELECT conv_id, turn, first(lang ORDER BY score DESC, lang) AS language FROM (
            SELECT g.conv_id, g.turn, t.lang, round(sum(COALESCE(p.logp, ln(1 / (t.total + 65536)))), 9) AS score
            FROM grams g CROSS JOIN totals t LEFT JOIN profile p ON p.lang = t.lang AND p.bucket = g.bucket
            GROUP BY ALL) GROUP BY ALL) USING (conv_id, turn)"""),
    "language_report": f"""SELECT language, count(*) AS n
      FROM (SELECT lang AS language FROM documents UNION ALL SELECT event_type FROM events)
      WHERE language NOT IN ('en', {quoted(SUPPORTED_LANGUAGES)}) GROUP BY language""",
    "translate_lexicon": TRANSLATED.format(clean=CLEAN, tokens="toks"),
    # Accepted are every other start in a run of neighbouring starts.
    "translate_phrases": """WITH d AS (SELECT doc_id, lang, regexp_split_to_array({clean}, ' ') AS toks, {clean} AS c FROM documents),
      t AS (SELECT doc_id, unnest(toks) AS w, unnest(range(1, len(toks) + 1)) AS p FROM d WHERE lang <> 'en' AND c <> ''),
      n AS (SELECT *, lead(w) OVER (PARTITION BY doc_id ORDER BY p) AS after FROM t),
      m AS (SELECT *, after IS NOT NULL AND md5(lower(w || ' ' || after)) LIKE '%0' AS hit FROM n),
      g AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, hit ORDER BY p) AS island FROM m),
      a AS (SELECT *, hit AND (row_number() OVER (PARTITION BY doc_id, hit, island ORDER BY p)) % 2 = 1 AS taken FROM g),
      k AS (SELECT *, coalesce(lag(taken) OVER (PARTITION BY doc_id ORDER BY p), false) AS covered FROM a),
      o AS (SELECT doc_id, string_agg(CASE WHEN taken THEN lower(w) || '_' || lower(after) ELSE w END, ' ' ORDER BY p) AS text_en
        FROM k WHERE NOT covered GROUP BY doc_id)
      SELECT doc_id, coalesce(o.text_en, c) AS text_en FROM d LEFT JOIN o USING (doc_id)""".format(clean=CLEAN),
    "translate_lexicon_parity": TRANSLATED.format(clean=CLEAN, tokens=CHUNKED),
    "embed_text": """WITH words AS (
        SELECT doc_id, CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) AS bucket,
          CAST('0x' || substr(md5(w), 5, 4) AS INTEGER) % 64 AS dim,
          CASE WHEN substr(md5(w), 9, 1) >= '8' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sign
        FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents)),
      idf AS (SELECT bucket, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(DISTINCT doc_id))) + 1 AS idf
        FROM words GROUP BY bucket),
      cells AS (SELECT doc_id, dim, sum(sign * idf) AS v FROM words JOIN idf USING (bucket) GROUP BY ALL),
      normed AS (SELECT doc_id, dim, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS v FROM cells)
      SELECT doc_id, dim, round(v, 6) + 0.0::DOUBLE AS value FROM normed WHERE abs(v) > 1e-12""",
    "search_text": """WITH w AS (
        SELECT 'd' AS side, doc_id AS k, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents
        UNION ALL SELECT 'q', item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) FROM benchmark),
      coded AS (
        SELECT side, k, CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) AS bucket,
          CAST('0x' || substr(md5(w), 5, 4) AS INTEGER) % 64 AS dim,
          CASE WHEN substr(md5(w), 9, 1) >= '8' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sign FROM w),
      idf AS (SELECT bucket, count(DISTINCT k) AS df FROM coded WHERE side = 'd' GROUP BY bucket),
      cells AS (
        SELECT side, k, dim, sum(sign * (ln((1 + (SELECT count(*) FROM documents)) / (1 + COALESCE(df, 0))) + 1)) AS v
        FROM coded LEFT JOIN idf USING (bucket) GROUP BY ALL),
      normed AS (SELECT side, k, dim, v / sqrt(sum(v * v) OVER (PARTITION BY side, k)) AS v FROM cells),
      near AS (
        SELECT q.k AS query_id, d.k AS id, 2 - 2 * sum(q.v * d.v) AS d2
        FROM normed q JOIN normed d USING (dim) WHERE q.side = 'q' AND d.side = 'd' GROUP BY ALL),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d2, 9), id) AS rank FROM near)
      SELECT query_id, id, rank, abs(round(d2, 6)) AS distance FROM ranked WHERE rank <= 5""",
}
