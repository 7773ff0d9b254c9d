"""Explicit schemas of every table; JSON and XML are never inferred."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

TEXT, COUNT, REAL, FLAG = StringType(), LongType(), DoubleType(), BooleanType()


def schema(**fields: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


RAW_POST = schema(
    id=TEXT, subreddit=TEXT, author=schema(name=TEXT), title=TEXT, selftext=TEXT, score=COUNT,
    num_comments=COUNT, url=TEXT, created_utc=REAL, stickied=FLAG,
)
RAW_ITEM = schema(guid=TEXT, title=TEXT, description=TEXT, link=TEXT, pubDate=TEXT)
POST = schema(
    id=TEXT, source=TEXT, subreddit=TEXT, author=TEXT, title=TEXT, selftext=TEXT, text=TEXT,
    score=COUNT, num_comments=COUNT, url=TEXT, created_utc=REAL, category=TEXT,
)
ARTICLE = schema(
    id=TEXT, source=TEXT, category=TEXT, title=TEXT, summary=TEXT, text=TEXT, link=TEXT, published=TEXT
)
COMBINED = StructType([*POST.fields, *(f for f in ARTICLE.fields if f.name not in POST.names)])
NORMALIZED = StructType(
    [
        *COMBINED.fields,
        *schema(detected_language=TEXT, title_en=TEXT, selftext_en=TEXT, summary_en=TEXT, text_en=TEXT).fields,
    ]
)
TREND = schema(
    cluster_id=IntegerType(), total_posts=COUNT, category=TEXT, keywords=ArrayType(TEXT), summary=TEXT,
    top_titles=ArrayType(TEXT), start_date=TEXT, end_date=TEXT,
)
