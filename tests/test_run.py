import json
import random

from trendspark import config
from trendspark.config import Settings
from trendspark.operators import language, search
from trendspark.plans import trend_run
from trendspark.sources import landing

WORDS = {
    "nba": ["guard dunk rim".split(), "trade draft pick".split()],
    "soccer": ["goal keeper penalty".split(), "transfer fee club".split()],
}


def landed_posts():
    rng = random.Random(5)
    for category, themes in WORDS.items():
        for t, theme in enumerate(themes):
            for i in range(12):
                words = rng.choices(theme, k=9) + [f"w{rng.randrange(40)}"]
                yield dict(
                    id=f"{category}{t}-{i}", subreddit=category, author=None, title=" ".join(words[:4]),
                    selftext=" ".join(words[4:]) + ".", score=i, num_comments=1, url="u",
                    created_utc=1.7e9 + 86400 * i, stickied=False,
                )


def test_files_to_trends(spark, tmp_path):
    posts = list(landed_posts())
    copy = dict(posts[0], title="copy")
    # The first row of this id is of no listed category, so the id drops out.
    hidden = [dict(posts[1], id="late", subreddit="chess", title="x", selftext="x"), dict(posts[1], id="late")]
    (tmp_path / "posts.json").write_text("\n".join(json.dumps(p) for p in [*posts, copy, *hidden]))
    combined = landing.combine_sources(landing.read_posts(spark, str(tmp_path / "posts.json")))
    samples = [("the guard of the team", "en"), ("le but de la main", "fr")]
    profile = language.train_language_profile(spark.createDataFrame(samples, "text string, lang string"))
    out = str(tmp_path / "out")
    found = trend_run.run(combined, profile, out)
    rows = found.trends.collect()
    assert sum(r.total_posts for r in rows) == 48
    assert {r.category for r in rows} == {"nba", "soccer"}
    assert all(r.keywords and r.summary and r.start_date for r in rows)
    assert landing.read_trends(spark, f"{out}/trends").count() == len(rows)
    assert spark.read.parquet(f"{out}/vectors/vectors").count() == 48
    asked = spark.createDataFrame([(1, "guard dunk rim"), (2, "club fee")], "query_id bigint, text string")
    hits = search.search_text(spark, f"{out}/vectors", asked, 1, metadata=["title_en"], dim=Settings().embedding_dim)
    assert {(h.query_id, h.category) for h in hits.collect()} == {(q, c) for q in (1, 2) for c in WORDS}


def test_chunk_settings_and_summary_limit_reach_the_run(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(config.SUMMARY_INPUT_LIMITS, "pegasus", 7)
    posts = [dict(p, title="le but de la main", selftext="a b c d e f g h") for p in landed_posts()][:1] + list(landed_posts())[1:]
    (tmp_path / "posts.json").write_text("\n".join(json.dumps(p) for p in posts))
    combined = landing.combine_sources(landing.read_posts(spark, str(tmp_path / "posts.json")))
    samples = [(" ".join(w for c in WORDS.values() for t in c for w in t), "en"), ("le but de la main a b c d e f g h", "fr")]
    profile = language.train_language_profile(spark.createDataFrame(samples, "text string, lang string"))
    models = trend_run.Models(
        translate=lambda lang: lambda texts: [f"[{t}]" for t in texts], summarize=lambda: lambda text: str(len(text.split()))
    )
    for parity, want in ((False, "[a b c] [d e f] [g h]"), (True, "[a b c] [c d e] [e f g] [g h]")):
        settings = Settings(chunk_tokens=3, chunk_overlap=1, parity=parity)
        prepared = trend_run.prepare_posts(combined, profile, models=models, settings=settings)
        assert [r.selftext_en for r in prepared.filter("selftext = 'a b c d e f g h'").collect()] == [want]
    found = trend_run.run(
        combined, profile, str(tmp_path / "out"), models=trend_run.Models(summarize=models.summarize),
        settings=Settings(summary_model="google/pegasus-xsum"),
    )
    assert {r.summary for r in found.trends.collect()} == {"7"}
    assert trend_run.summary_limit(models) == 1024
    assert trend_run.summary_limit(models, Settings(summary_model="x", summary_input_tokens=9000)) == 4096
    assert trend_run.summary_limit(settings=Settings(summary_model="pegasus", summary_input_tokens=90)) == 90
