"""Articles in odd surroundings keep their whole text."""

import pytest

from oncolattice.llm import html

LONG = "This is a long paragraph of the article, with several clauses; it goes on and on, and it ends here. " * 4
WHOLE = f"Title of it\n{LONG.strip()}"
ARTICLE = f"<h1>Title of it</h1><p>{LONG}</p>"
PAGES = {
    "form around all": (f"<body><form id=aspnetForm>{ARTICLE}</form></body>", WHOLE),
    "sign of a neighbour": (f'<body><div class="content has-sidebar">{ARTICLE}</div></body>', WHOLE),
    "other attribute": (f'<body><div data-id="search-results">{ARTICLE}</div></body>', WHOLE),
    "own header": (f'<body><article><header class="entry-header"><h1>Title of it</h1></header><p>{LONG}</p></article></body>', WHOLE),
    "site header": (f'<body><header class="site-header"><p>Welcome, dear readers, to this place.</p></header><article>{ARTICLE}</article></body>', WHOLE),
    "labelled ancestor": (f'<body><div class="widget"><main>{ARTICLE}</main></div></body>', WHOLE),
    "lists and cells": (f"<body><article>{ARTICLE}<ul><li>one</li><li>two</li></ul><table><tr><td>x</td><td>y</td></tr></table><blockquote><p>said</p></blockquote></article></body>",
                        WHOLE + "\none\ntwo\nx\ny\nsaid"),
    "lists without article": (f"<body><div>{ARTICLE}<ul><li>one</li><li>two</li></ul><blockquote><p>said</p></blockquote></div></body>", WHOLE + "\none\ntwo\nsaid"),
    "formula": (f"<body><article><p>{LONG}so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p></article></body>", f"{LONG}so x=1 holds."),
    "short section": (f"<body><main><section>{ARTICLE}</section><section><h2>More</h2><p>Short note</p></section></main></body>", WHOLE + "\nMore\nShort note"),
    "loose menu": (f"<body><div>Menu Home About</div><div>{ARTICLE}</div></body>", WHOLE),
    "unclosed style": (f"<html><style>p{{margin:0}}<body><article>{ARTICLE}</article></body>", WHOLE),
    "long comments": (f'<body><article>{ARTICLE}</article><div class="comments"><p>{LONG * 3}</p></div></body>', WHOLE),
    "long comments, no article": (f'<body><div>{ARTICLE}</div><div class="comments"><p>{LONG * 3}</p></div></body>', WHOLE),
    "list of links": (f"<body><article>{ARTICLE}<ul><li><a href=x>see this one</a></li><li><a href=y>and that</a></li></ul></article></body>", WHOLE),
    "advert with sentences": (f'<body><div class="ad"><p>{LONG}</p></div><article>{ARTICLE}</article></body>', WHOLE),
    "no punctuation": ('<body><div class="ad">Buy this now, it is good.</div><article><h1>word word</h1><p>word word word</p></article></body>', "word word\nword word word"),
    "nothing": ("<body><nav>Home</nav></body>", ""),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_article(name):
    page, want = PAGES[name]
    assert html.main_text(page) == want
