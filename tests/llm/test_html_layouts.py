"""Pages whose markup leaves end tags out: the article must come out whole."""

import pytest

from pagesift.llm.html_text import main_text

LONG = ["The old ferry crossed the bay twice a day, and on most mornings the captain knew every passenger by name, by trade and by temper.",
        "In winter the crossing took longer, because the ice had to be broken first, and people stood at the rail to watch the pieces turn."]
BODY = "".join(f"<p>{x}</p>" for x in LONG)
ARTICLE = f"<article>{BODY}</article>"
SIDE = "<footer><p>All rights reserved by the owners.</p></footer>"
WANT = "\n".join(LONG)

PAGES = {
    "head left open": f"<html><head><title>T</title><meta charset=x><link rel=y><body>{ARTICLE}{SIDE}",
    "head left open, no body tag": f"<html><head><title>T</title><style>p {{}}</style>{ARTICLE}{SIDE}",
    "head left open, text first": f"<head><script>x</script>{ARTICLE}",
    "anchor without an end": f"<body><a name=top>{ARTICLE}{SIDE}",
    "anchor without an end inside": f"<body><article><a name='x'>{BODY}</article>{SIDE}",
    "link left open in a list": f"<body><ul><li><a href=/>Home</ul>{ARTICLE}{SIDE}",
    "link left open in a heading": f"<body><div><h2><a href=/>Home</h2></div><article>{BODY.replace('p>', 'div>')}</article>{SIDE}",
    "two anchors": f"<body><a href=/><a id=y>{ARTICLE}",
    "button left open": f"<body><button>Go{ARTICLE}{SIDE}",
    "button with boxes left open": f"<body><button><div>Go</div><div>{ARTICLE}</div>{SIDE}",
    "select left open": f"<body><form><select><option>a<option>b</form><div>{ARTICLE}</div>",
    "select left open before a box": f"<body><select><option>a<div>{ARTICLE}</div>",
    "drawing left open": f"<body><svg><path d=x>{ARTICLE}{SIDE}",
    "paragraphs left open": "<body><article>" + "".join(f"<p>{x}" for x in LONG) + f"</article>{SIDE}",
    "items left open": f"<body><nav><ul><li>Home<li>News</ul></nav>{ARTICLE}{SIDE}",
    "all closed": f"<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav>{ARTICLE}{SIDE}</body></html>",
}


@pytest.mark.parametrize("name", PAGES)
def test_article_is_whole(name):
    got = main_text(PAGES[name])
    assert [x for x in got.split("\n") if x in LONG] == LONG, got
    assert len(got) <= len(WANT) + 20 and "rights" not in got


def test_a_closed_button_stays_out():
    got = main_text(f"<body><article><button><div>Subscribe now</div></button>{BODY}<button>Send<b>it</b></button></article>{SIDE}")
    assert got == WANT


def test_card_links_are_still_links():
    cards = "".join(f"<a href='/{i}'><h3>Read another story of ours, number {i}, today</h3></a>" for i in range(6))
    assert main_text(f"<body>{ARTICLE}<div>{cards}</div>{SIDE}") == WANT
