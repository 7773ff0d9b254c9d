"""Word lists, group names and language codes."""

from __future__ import annotations

# Base stop words.
BASE_STOPWORDS = tuple(
    """
    the and to of in a is for on with at by an be as from that
    it are was this will has have but not or its after his he she they
    their you we who all about more up out new one over into than just
    so can if no how what when which do did been also had would could
    should our your them get got like now see us off only back time make
    made still very much where why go going may want needs need even most
    first last said says year years day days game games season team teams
    player players coach coaches match matches win won loss losses play playing
    score scored scoring points point home away vs vs. espn reddit category him some
    """.split()
)

# Stop words of the domain; entries with a blank are kept as written.
DOMAIN_STOPWORDS = tuple(
    """
    fan fans ranked rank
    division conference record standings stats stat report rumor
    healthy practice lineup pts reb ast discussion
    thread post title comment op link source
    via tweet video article photo highlight clip
    r u subreddit mod nsfw flair
    watch watching talk talking looks looking feel feeling
    start starting started bench
    better worse good bad crazy insane wild amazing great terrible
    etc lol yeah thing stuff weekly footballrelated happened
    """.split()
) + ("discussion thread", "weekly discussion", "chat latest", "bit ")

# Fixed values by rule: small numbers and recent years.
NUMBER_STOPWORDS = tuple(str(n) for n in [*range(41), 50, 2023, 2024, 2025])

STOPWORDS = tuple(dict.fromkeys(BASE_STOPWORDS + DOMAIN_STOPWORDS + NUMBER_STOPWORDS))

# Under parity three words are absent and two fused words stand in the list.
_ABSENT_UNDER_PARITY = {"thread", "watch", "r"}
_FUSED_UNDER_PARITY = ("discussionthread", "0r", "threadwatch")


def stopwords(parity: bool = False) -> tuple[str, ...]:
    if not parity:
        return STOPWORDS
    return tuple(w for w in STOPWORDS if w not in _ABSENT_UNDER_PARITY) + _FUSED_UNDER_PARITY


# Group name -> category.
GROUP_CATEGORY = {
    "soccer": "soccer",
    "football": "soccer",
    "premierleague": "soccer",
    "championsleague": "soccer",
    "laliga": "soccer",
    "seriea": "soccer",
    "bundesliga": "soccer",
    "ligue1": "soccer",
    "nba": "nba",
    "nbatalk": "nba",
    "nba_draft": "nba",
    "nbacirclejerk": "nba",
    "nbadiscussion": "nba",
}

# Category -> keywords, in order of precedence.
CATEGORY_KEYWORDS = {
    "nba": ("nba", "basketball"),
    "soccer": (
        "soccer", "football", "premier league", "champions league", "laliga",
        "serie a", "bundesliga", "ligue 1", "futbol",
    ),
}

# Languages that can be translated to English.
SUPPORTED_LANGUAGES = tuple("es it de fr af ca da id et sv fi tl pl pt no ja ru zh".split())
