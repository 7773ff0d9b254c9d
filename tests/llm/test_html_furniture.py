"""Pages composed of an article and of furniture that is longer than it: the exact text has to come back."""

import random

import pytest

from trendspark.llm.html_text import main_text

LONG = [
    "ad", "ad-unit", "ad-slot", "promo-box", "sponsored-content", "comments", "comment-thread", "comment-list",
    "replies", "responses", "discussion", "newsletter signup", "related", "widget",
]


def prose(rng, n_words):
    words = ["".join(rng.choices("abcdefghiou", k=rng.randint(2, 9))) for _ in range(n_words)]
    return " ".join(w + (rng.choice([",", "."]) if i % 9 == 8 else "") for i, w in enumerate(words)) + "."


def paragraphs(rng, many, n_words):
    texts = [prose(rng, n_words) for _ in range(many)]
    return "".join(f"<p>{t}</p>" for t in texts), " ".join(texts)


@pytest.mark.parametrize("holder", ["article", "main", 'div class="post"', "div id=text"])
@pytest.mark.parametrize("mark", LONG)
def test_long_furniture(holder, mark):
    rng = random.Random(mark)
    close = holder.split()[0]
    for name in ("class", "id"):
        body, text = paragraphs(rng, 3, 55)
        more, _ = paragraphs(rng, rng.randint(2, 6), 110)
        for tag in ("div", "section"):
            junk = f'<{tag} {name}="{mark}">{more}</{tag}>'
            page = "<body><nav><a>Home</a></nav><{h}><h1>A title</h1>{a}</{c}>{b}<footer>Us.</footer></body>"
            assert main_text(page.format(h=holder, c=close, a=body, b=junk)) == f"A title {text}"
            first, rest = body.split("</p>", 1)
            assert main_text(page.format(h=holder, c=close, a=f"{first}</p>{junk}{rest}", b="")) == f"A title {text}"


@pytest.mark.parametrize("reply", ['article class="reply"', 'article class="comment"', 'article id="comment-7"'])
def test_comment_articles(reply):
    rng = random.Random(reply)
    body, text = paragraphs(rng, 3, 55)
    replies = "".join(f"<{reply}>{paragraphs(rng, 2, 100)[0]}</article>" for _ in range(4))
    plain = replies.replace(f"<{reply}>", "<article>")
    assert main_text(f"<article>{body}</article>{replies}") == text
    assert main_text(f"<article>{body}{plain}</article>") == text
    assert main_text(f'<article>{body}</article><section id="comments">{plain}</section>') == text


def test_plain_articles_stay():
    """Several articles, short ones, and articles in hinted wrappers."""
    rng = random.Random(1)
    parts = [paragraphs(rng, 2, 30) for _ in range(3)]
    page = "".join(f"<article>{body}</article>" for body, _ in parts)
    assert main_text(page) == " ".join(text for _, text in parts)
    body, text = parts[0]
    for mark in ("div class=widget", "form action=/", 'div class="has-sidebar"', "section class=promo-box"):
        assert main_text(f"<body><{mark}><article>{body}</article></{mark.split()[0]}></body>") == text
        assert main_text(f"<body><{mark}>{body}</{mark.split()[0]}><nav>x</nav></body>") == text
