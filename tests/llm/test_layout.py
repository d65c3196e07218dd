"""Pages whose article lies in a form or in a block that is named like what is dropped."""

import random

import pytest

from tabguard.llm import pages
from tabguard.llm.htmltree import Page

WRAPPERS = ["div class='content-sidebar-wrap'", "div class='row sidebar-right'", "div class='post comment'", "form", "form id=aspnetForm action='/x'", "section id=social", "div class='widget'"]
NOISE = ["<nav><ul><li><a href=/x>Home</a></li></ul></nav>", "<div class='ad-box'>Buy now</div>", "<aside>aside words</aside>", "<div id='cookie-notice'>We use cookies</div>", "<div class=comments><p>First! I disagree with all of it, at length.</p></div>", "<footer><p>(c) me</p></footer>", "<form><p>mail</p><input></form>"]


def words(r, n):
    return " ".join(r.choice("alpha beta gamma delta zeta eta theta jota kappa".split()) for _ in range(n))


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("depth", [1, 2])
def test_wrapped_pages_keep_their_text(wrapper, depth):
    r = random.Random(len(wrapper) + depth)
    for _ in range(30):
        blocks = [words(r, r.randrange(15, 40)) for _ in range(r.randrange(3, 7))]
        article = "".join(f"<p>{b}</p>" for b in blocks)
        inside = article if r.random() < 0.5 else f"<article class=post>{article}</article>"
        a, b, c = (r.choice(NOISE) for _ in range(3))
        tag = wrapper.split()[0]
        body = f"{a}<div class=page>{inside}</div>{b}"
        for _ in range(depth):
            body = f"<{wrapper}>{body}</{tag}>"
        source = f"<html><head><title>t</title></head><body><header>Site</header>{body}{c}</body></html>"
        assert pages.main_text(source, None)[0] == "\n".join(blocks)


def test_long_comments_stay_out():
    r = random.Random(5)
    article, reader = words(r, 60), [words(r, 80) for _ in range(5)]
    for box in ("<section class=comments>{}</section>", "<div id='comment-list'>{}</div>", "<form class=replies>{}</form>"):
        source = f"<body><div class=post><p>{article}</p></div>{box.format(''.join(f'<p>{x}</p>' for x in reader))}</body>"
        assert pages.main_text(source, None)[0] == article
    assert pages.main_text("<body><form><label>User name</label><input><label>Password</label></form></body>", None)[0] == ""
    assert pages.main_text(f"<body><nav><p>{article}</p></nav></body>", None)[0] == ""
    assert pages.main_text(f"<body><form style='display: none'><p>{article}</p></form></body>", None)[0] == ""


def test_many_named_blocks_take_linear_time():
    import time

    def took(n):
        began = time.process_time()
        Page("<div class=sidebar><form><p>some text of some length here</p></form>" * n)
        return time.process_time() - began

    small = took(3_000)
    assert took(12_000) < 12 * small + 0.5
