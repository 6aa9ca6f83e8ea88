"""Pages whose parts are marked by names, and pages that nest deep."""

import time

import pytest

from tallow.llm import extraction

TEXT = "Long main text of the article goes on here for a while. " * 5
P = f"<p>{TEXT}</p>"
WANT = " ".join(TEXT.split())


@pytest.mark.parametrize(
    "page,text",
    [
        (f'<div class="content has-sidebar">{P}<div class="sidebar"><p>side</p></div></div>', WANT),
        (f'<div class="main sidebar-left">{P}<div class="sidebar-left"><p>side</p></div></div>', WANT),
        (f'<div class="content">{P}<div class="content sidebar"><p>side</p></div></div>', WANT),
        (f'<article>{P}<ol class="commentlist"><li>first!</li></ol></article>', WANT),
        (f'<article>{P}<div class="comments-area"><p>first!</p></div><div id="commentform">say</div></article>', WANT),
        (f'<article><div class="post-header"><h1>Title</h1></div>{P}<div class="post-footer">tags</div></article>', f"Title {WANT}"),
        (f'<div class="sidebar"><p>one two</p></div><div class="banner">{P}<div class="ad">buy</div></div><nav>menu</nav>', WANT),
        ('<div class="sidebar"><script>x</script></div>', ""),
        (f"<div><ul><li>one<li>two</ul>{P}</div>", f"one two {WANT}"),
        (f"<div><p>one<div>two</div></b></span></div>{P}", f"one two {WANT}"),
    ],
)
def test_names(page, text):
    assert extraction.extract(f"<body>{page}</body>", []) == text


def test_paths_are_spelt_out_on_demand():
    root = extraction.parse('<body><div class="a b2"><span><p>x</p></span></div><div class="a b3"><p>y</p></div></body>')
    found = [x for x in extraction.containers(root) if x.tag == "div"]
    assert {x.path for x in found} == {">body>div.a.b#"} and {x.key for x in found} == {extraction.key_of(">body>div.a.b#")}
    assert found[0].length == len(found[0].path)
    assert extraction.extract("<body><div class='x'>one two</div><div class='y'>a b c</div></body>", [">body>div.x"]) == "one two"


@pytest.mark.parametrize("page", ["<div>" * 40_000 + "x", '<div class="a">' * 20_000 + "</b>" * 20_000 + "x", "<noscript>" * 30_000 + "x", "<span>" * 20_000 + "<p>x" * 20_000, "<div>" * 3000 + "<li>x" * 20_000])
def test_deep_and_unclosed_pages_take_time_in_proportion(page):
    began = time.process_time()
    assert "x" in extraction.extract(page, [])
    assert time.process_time() - began < 10
