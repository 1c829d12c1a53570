"""Pages without an article tag, and with many open elements."""

from bizfit.llm.html_text import extract

LONG = "A sentence of the article that goes on for quite a while, with many words and no tags in it. " * 3


def test_containers_within_the_elected_one_are_kept():
    parts = "".join(f"<p>{LONG} {k}</p>" for k in range(8))
    page = f"<html><body><div>{parts}<div>Quoted words {LONG}</div><table><tr><td>A cell of the article</td></tr></table><p>Last {LONG}</p></div></body></html>"
    text = extract(page)
    assert "Quoted words" in text and "A cell of the article" in text and "Last A sentence" in text


def test_dense_text_beside_the_elected_container_is_kept():
    parts = "".join(f"<p>{LONG} {k}</p>" for k in range(8))
    page = f"<html><body><nav><a>menu</a></nav><div>{parts}</div><div><p>Trailing part {LONG}</p></div><footer>foot words</footer></body></html>"
    text = extract(page)
    assert "Trailing part" in text and "menu" not in text and "foot words" not in text


def test_a_part_with_many_unclosed_elements_ends():
    page = "<html><body><nav>" + "<span>x" * 1000 + f"</nav><p>{LONG}</p></body></html>"
    assert extract(page) == LONG.strip()


def test_many_useless_end_tags_take_linear_time():
    assert extract("<b>" + "<div>" * 20_000 + "</b>" * 20_000 + LONG) == LONG.strip()
