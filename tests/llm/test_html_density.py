"""The content region against a plain computation, its parameters, and class names that hit the word lists by chance."""

import math
import random
import re

import pytest

from bizfit.llm import html_text as H

PROSE = "A sentence of the article that goes on for quite a while, with many words and no tags in it. "


def plain_region(lines, parts):
    """The same selection by loops over lines and ancestors."""
    n, reach = len(lines), int(3 * H.SIGMA)
    raw = [math.log1p(len(x.text) / max(1, x.tags)) for x in lines]
    score = []
    for k in range(n):
        near = [(math.exp(-0.5 * ((j - k) / H.SIGMA) ** 2), raw[j]) for j in range(max(0, k - reach), min(n, k + reach + 1))]
        score.append(sum(a * b for a, b in near) / sum(a for a, _ in near))
    order, best, bound = sorted(score), -1.0, -math.inf
    for k in range(1, n):
        low, high = sum(order[:k]) / k, sum(order[k:]) / (n - k)
        if k * (n - k) * (high - low) ** 2 > best + 1e-9:
            best, bound = k * (n - k) * (high - low) ** 2, order[k] if high - low >= H.APART else -math.inf

    def chain(k):
        return [k, *(chain(parts[k].parent) if k else [])]

    def weight(k):
        w = weight(parts[k].parent) * H.SAY[parts[k].mark] if k else 1.0
        return max(w, H.ARTICLE_SAY) if k and parts[k].tag in ("article", "main") and not parts[k].mark else w

    say = [sum(weight(x.part) * len(x.text) for x, s in zip(lines, score, strict=True) if s >= bound - 1e-9 and k in chain(x.part)) for k in range(len(parts))]
    if not say[0]:
        return [False] * n
    articles = [k for k, p in enumerate(parts) if p.tag in ("article", "main") and say[k] >= H.ARTICLE_SHARE * say[0]]
    sections = [k for k, p in enumerate(parts) if say[k] >= H.SHARE * say[0] and (k == 0 or p.tag in H.SECTIONS)]
    chosen = max(articles or sections, key=lambda k: len([j for j in chain(k)]) * 1000 + k)
    whole = parts[chosen].tag in ("", "html", "body")
    keep, solid, links = [], [], []
    for x, r, s in zip(lines, raw, score, strict=True):
        up = chain(x.part)
        inside = chosen in up
        marks = [parts[k].mark for k in up if k not in chain(chosen)]
        links.append(x.links >= H.LINKS * len(x.text))
        solid.append(min(r, s) >= bound - 1e-9 and not links[-1])
        gone = any(m in ("hard", "strong", "hidden") or m == "header" and (not inside or whole) for m in marks)
        keep.append(not gone and (solid[-1] or inside and "weak" not in marks) and (inside or not articles))
    firm = [k for k in range(n) if keep[k] and solid[k]]
    if not articles and bound > -math.inf:
        keep = [c and not (links[k] and (not firm or k < firm[0] or whole and k > firm[-1])) for k, c in enumerate(keep)]
    return keep


def test_region_matches_a_plain_computation():
    rng = random.Random(8)
    for _ in range(400):
        parts = [H.Part(0, "", "")]
        for k in range(1, rng.randrange(1, 9)):
            parts.append(H.Part(rng.randrange(k), rng.choice(["div", "body", "article", "nav", "section", "span"]), rng.choice(["", "", "", "", "weak", "strong", "header", "hidden", "hard"])))
        parts = [p._replace(mark=p.mark or "weak") if p.tag == "span" else p for p in parts]
        lines = []
        for _ in range(rng.randrange(1, 40)):
            text = "x" * rng.choice([1, 3, 12, 81, 403])
            lines.append(H.Line(text, rng.randrange(0, 6), rng.choice([0, 0, len(text)]), rng.randrange(len(parts))))
        assert H.region(lines, parts) == plain_region(lines, parts)


def page(article, before="", after=""):
    return f"<html><head><title>t</title></head><body><nav><ul><li><a href=x>one</a><li><a href=y>two</a></ul></nav>{before}{article}{after}<footer>Foot words of some length here</footer></body></html>"


ARTICLE = "<article><h1>Head line</h1>" + "".join(f"<p>{PROSE * 2}{k}</p>" for k in range(6)) + "<p>x</p></article>"
WANT = "Head line " + " ".join(f"{PROSE * 2}{k}" for k in range(6)) + " x"


MENU = "<ul>" + "".join(f"<li><a href=/{k}>Topic {k}</a></li>" for k in range(20)) + "</ul>"
BODY = ARTICLE.replace("article>", "div>")
NOISE = [MENU, "<div>Buy this thing now, it is cheap</div>", f"<div>{MENU}</div>"]


@pytest.mark.parametrize("noise", NOISE)
@pytest.mark.parametrize("body", [ARTICLE, BODY])
def test_density_drops_what_no_mark_names(noise, body, monkeypatch):
    for html in (page(body, before=noise), page(body, after=noise), page(body, before=noise, after=noise)):
        assert H.extract(html) == WANT
    monkeypatch.setattr(H, "threshold", lambda scores: float("-inf"))  # everything is dense: marks alone don't find it
    assert body is ARTICLE or H.extract(page(body, before=noise)) != WANT


def test_a_menu_in_the_body_itself():
    inner = BODY[5:-6]
    assert H.extract(f"<html><body>{MENU}{inner}{MENU}</body></html>") == WANT


def test_smoothing_decides():
    lines = [H.Line("x" * 400, 2, 0, 0)] * 8 + [H.Line("x", 2, 0, 1)] * 8
    lines.insert(4, H.Line("x", 2, 0, 0))
    parts = [H.Part(0, "", ""), H.Part(0, "div", "weak")]
    assert H.region(lines, parts) == [True] * 9 + [False] * 8
    lines = [x._replace(part=1) for x in lines]
    assert H.region(lines, [parts[0], H.Part(0, "div", "")], sigma=0) == [True] * 17  # the only section is elected whole


@pytest.mark.parametrize("names", ["right-sidebar", "sidebar", "banner", "modal", "page-header", "subscribe", "promo", "content-sidebar", "cookie-notice", "comments"])
@pytest.mark.parametrize("extra", ["", "<p>One short paragraph beside it.</p>"])
def test_an_article_in_a_marked_wrapper_stays(names, extra):
    assert H.extract(page(f"<div class='{names}'>{ARTICLE}</div>", before=extra)) == WANT
    assert H.extract(f"<body><div class='{names}'>{BODY}</div></body>") == WANT


@pytest.mark.parametrize("part", ["<table>" + "".join(f"<tr><td>k{k}</td><td>{k}</td></tr>" for k in range(30)) + "</table>", MENU, "<ol><li>a</li><li>b</li></ol>"])
@pytest.mark.parametrize("body", [ARTICLE, BODY])
def test_tables_and_lists_of_an_article_stay(part, body):
    words = " ".join(x for x in re.sub("<[^>]*>", "|", part).split("|") if x)
    for at in ("<p>x</p>", f"<p>{PROSE * 2}4</p>"):
        html = page(body.replace(at, at + part))
        assert H.extract(html) == WANT.replace(at[3:-4], f"{at[3:-4].strip()} {words}", 1) if at != "<p>x</p>" else H.extract(html) == f"{WANT} {words}"


@pytest.mark.parametrize("names", ["class='social-study'", "id='search-history'", "class='has-sidebar'", "class='advertising-ethics'", "class='header-files'", "class='discussion'", "id='comment-on-kant'"])
def test_names_that_hit_by_chance(names):
    inside = ARTICLE.replace("<p>x</p>", f"<div {names}><p>{PROSE}in a part</p></div><p>x</p>")
    assert H.extract(page(inside)) == WANT.replace(" x", f" {PROSE}in a part x")
    assert H.extract(page(f"<div {names}>{ARTICLE}</div>")) == WANT


@pytest.mark.parametrize("names", ["class=sidebar", "id=comments", "class='cookie-notice'", "class='ad-slot'", "role=navigation", "class='user-comments'", "class='newsletter-signup'"])
@pytest.mark.parametrize("place", ["in", "out"])
def test_parts_that_are_not_the_article(names, place):
    part = f"<div {names}><p>{PROSE}</p><p>Me too</p></div>"
    html = page(ARTICLE.replace("<p>x</p>", f"<p>x</p>{part}")) if place == "in" else page(ARTICLE, after=part)
    assert H.extract(html) == WANT


def test_an_article_in_a_marked_element_is_still_the_densest():
    body = "".join(f"<p>{PROSE * 3}{k}</p>" for k in range(9))
    text = H.extract(page(f"<div id='main-content' class='post'>{body}</div>"))
    assert text.count(PROSE) == 27 and "Foot" not in text and "one" not in text.split()


def test_awkward_pages(spark):
    long = page("<article>" + f"<p>{PROSE}</p>" * 20_000 + "</article>")
    rows = [(1, "u", page(ARTICLE)), (1, "u", page(ARTICLE)), (2, None, None), (None, "v", ""), (3, "w", "<p>only this"), (4, "w", "<nav>only a menu</nav>"), (5, "w", long), (6, "w", "plain text, no tags"), (7, "w", "<<<>>&amp;&#x41;<b")]
    pages = spark.createDataFrame([(*r, "t", 9) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in H.extract_pages(pages).collect()]
    assert len(out) == len(rows) and all(n == len(t) for *_, t, n in out)
    by = {i: t for i, _, t, _ in out}
    assert by[1] == WANT and by[2] == by[None] == by[4] == "" and by[3] == "only this" and by[6] == "plain text, no tags" and by[5].count(PROSE.strip()) == 20_000
    assert H.extract_pages(pages.limit(0)).count() == 0
