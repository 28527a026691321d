"""Main text of pages that are deep, broken, or named against the grain; votes against a plain count."""

import random
import time
from collections import Counter

import pytest

from axonwave.llm import op01_consensus_extraction as op1

LONG = "The article goes on for a good many words, so that it is longer than whatever else is on its page. " * 6


@pytest.mark.parametrize("depth", [1, 14, 15, 16, 17, 40, 2000])
def test_nested_containers(depth):
    page = "<html><body>" + "<div>" * depth + f"<p>{LONG}</p><p>end</p>" + "</div>" * depth + "<div class=footer>foot</div></body></html>"
    want = LONG.strip() + " end"
    assert op1.main_text(page, None) == want
    path, _ = op1.best_container(op1.parse(page))
    assert op1.main_text(page, path) == want == op1.main_text(page, "html>body>nowhere")


def test_deep_pages_of_a_host(spark):
    page = lambda k: f"<body><div class=x>{'<div>' * 30}<p>{LONG}{k}</p>{'</div>' * 30}</div><div class=nav>{'<a>link</a>' * 9}</div></body>"
    pages = spark.createDataFrame([(k, f"http://h{k % 2}.org/{k}", page(k)) for k in range(8)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in op1.extract(pages).collect()} == {k: LONG + str(k) for k in range(8)}


@pytest.mark.parametrize(
    "page, text",
    [
        ("<div class=news-alert><h1>x</h1>article</div><p>tail</p>", "x article tail"),
        ("<div class=alert-news><h1>x</h1>article</div><p>tail</p>", "x article tail"),
        ("<div class=promo-story><h1>x</h1>article</div><p>tail</p>", "x article"),
        ("<h1>Title</h1><form><div>article</div></form>", "Title article"),
        (f"<div class=content><p>{LONG}</p></div><div class=promo>buy now</div>", LONG.strip()),
        (f"<div class=content><p>{LONG}</p></div><form><p>search here</p></form>", LONG.strip()),
        (f"<article><p>short one</p></article><section class=user-reviews><p>{LONG}</p></section>", "short one"),
        (f"<article><p>short one</p></article><div class=feedback-list><p>{LONG}</p></div>", "short one"),
        (f"<div><p>short one</p></div><div id=discussion><p>{LONG}</p></div>", "short one"),
        (f"<div id=comments><p>{LONG}</p></div>", ""),
        (f"<div class=promo-story><p>{LONG}</p></div>", LONG.strip()),
        ("<div class=promo-story><p>buy now</p></div>", ""),
        (f"<div class=sidebar><p>aside</p></div><div><p>{LONG}</p></div>", LONG.strip()),
    ],
)
def test_names(page, text):
    assert op1.main_text(f"<html><body>{page}</body></html>", None) == text


@pytest.mark.parametrize("page", ["<b>" * 50_000 + "x", "<p><b>" * 30_000 + "x" + "</i>" * 30_000, "<div>" * 20_000 + "x", "<ul>" + "<li><b>x" * 20_000, "<a>" * 30_000 + "<p>" + LONG, "<td>" * 20_000 + "x</table>"])
def test_time_is_linear(page):
    begun = time.process_time()
    op1.main_text(page, "html>body>div")
    assert time.process_time() - begun < 4


def test_votes_against_a_plain_count(spark):
    r = random.Random(6)
    pages = []
    for k in range(60):
        host, kind = f"h{r.randrange(4)}", r.choice(["a", "a", "b7", "b9", "c"])
        pages.append((k, [f"http://{host}.org/{k}", None][k % 17 == 0], f"<body><div class='{kind}'><p>{LONG}</p></div><p>x</p></body>"))
    votes = {}
    for _, url, html in pages:
        host = url.split("/")[2] if url else ""
        votes.setdefault(host, Counter())[op1.best_container(op1.parse(html))[0]] += 1
    want = {h: min((-n, p) for p, n in c.items()) for h, c in votes.items()}
    got = op1.winning_paths(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.host: (-r.votes, r.path) for r in got} == want and {r.host: r.of for r in got} == {h: c.total() for h, c in votes.items()}
