"""Pages of many makes: the story and only it."""

import pytest

from assaykit.llm.html_text import main_text

STORY = ["A long first paragraph about the river, its banks and the people who live there.", "A second one, as long as the first, tells of the bridge that they built.", "Short end."]
PARAGRAPHS = "".join(f"<p>{p}</p>" for p in STORY)
TEXT = " ".join(STORY)
MENU = '<div><a href="/">Home</a> | <a href="/n">News</a></div><ul><li><a href="/a">About us and all of our many pages</a></li><li><a href="/b">Shop for everything you need today</a></li></ul>'
COMMENTS = '<div class="comment-list"><div class="comment">I have read this long story with great joy and would like to say so here.</div></div>'


@pytest.mark.parametrize("page", [
    f'<div class="wrapper has-sidebar"><article>{PARAGRAPHS}</article><div class="sidebar">Tags and other things</div></div>',
    f'<div class="post no-comments">{PARAGRAPHS}</div>',
    f'<div id="page" class="ad-free">{PARAGRAPHS}</div>',
    f'<form id="aspnet"><div>{PARAGRAPHS}</div><footer>Imprint</footer></form>',
    f'<form><input name="q"><h1>{STORY[0]}</h1><p>{STORY[1]}</p><p>{STORY[2]}</p></form>',
    f'<div class="sidebar-layout"><div class="inner">{PARAGRAPHS}</div></div>',
    f"<title>Not the story</title><body>{PARAGRAPHS}</body>",
    f"<body>{MENU}{PARAGRAPHS}<div>© 2020 all rights</div></body>",
    f"<body>{MENU}<div>{PARAGRAPHS}</div>{COMMENTS}<div>Copyright 2021 by us</div></body>",
    f"<body><article>{PARAGRAPHS}{COMMENTS}</article></body>",
    f'<body><main><h1>{STORY[0]}</h1><div class="text"><p>{STORY[1]}</p><p>{STORY[2]}</p></div><div class="related-posts"><p>Other posts</p></div></main></body>',
    f'<article><section class="related-work"><p>{STORY[0]}</p></section><div class="widget-text"><p>{STORY[1]}</p></div><p>{STORY[2]}</p></article>',
    f'<body><div class="cookie-notice">We use cookies, as everybody does, and ask you to accept them all.</div>{PARAGRAPHS}</body>',
])
def test_story(page):
    assert main_text(page) == TEXT


def test_links_within_the_text_stay():
    page = f'<body>{MENU}<div><p>{STORY[0]}</p><p><a href="/x">A line that is a link</a></p><p>{STORY[1]}</p></div></body>'
    assert main_text(page) == f"{STORY[0]} A line that is a link {STORY[1]}"


def test_no_text_no_story():
    assert [main_text(p) for p in (None, "", "<p></p>", "<script>var a = 1</script>", "<nav>Home</nav>")] == [""] * 5


def test_long_page_is_linear():
    page = "<div class='sidebar'>" * 2000 + PARAGRAPHS * 300 + "</div>" * 2000
    assert main_text(page) == " ".join([TEXT] * 300)
