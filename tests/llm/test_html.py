import math
import time

import pytest

from rillflow.llm.html import extract_text, main_text, noisy_name, parse, path_ratios, solid

LONG = "This is a paragraph of some length, with commas, and it ends. "


def page(body, head=""):
    return f'<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{{margin:0}}</style><script>var t="</p>";</script>{head}</head><body>{body}</body></html>'


def test_article_of_a_page():
    html = page(
        "<nav><ul><li><a href=/a>Home</a><li><a>News</a></ul></nav><!-- x --><div class='ad'>Buy this now, it is cheap.</div>"
        "<article><h1>A &amp; B</h1><p><b>First<br><p>Second&nbsp;  line\n of &lt;text&gt;.</p><ul><li>one<li>two</ul><aside>no</aside><p>Th<i>i</i>rd.</p><form>no<input></form>"
        "<div class=comments><p>" + LONG * 9 + "</p></div></article><footer>&copy; x</footer>"
    )
    assert main_text(html) == "A & B\nFirst\nSecond line of <text>.\none\ntwo\nThird."


def test_page_without_an_article():
    html = page(f"<div id=menu><a>a</a> <a>b</a></div><div class=content><h2>Title</h2><p>{LONG}</p><p>{LONG * 2}</p><p>Short.</p></div><div class='sidebar'><p>{LONG}</p></div><div class=footer>c</div>")
    assert main_text(html) == "\n".join(["Title", LONG.strip(), (LONG * 2).strip(), "Short."])


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p", "<html><body></body></html>", "<script>x</script>", "<!-- open", "</p></div>"])
def test_no_text(html):
    assert main_text(html) in ("", "<", "<p")


def test_deep_and_long_pages():
    assert main_text("<div>" * 3000 + "deep." + "</div>" * 3000) == "deep."
    assert len(main_text(page("<article><p>" + "word, " * 200_000 + "</p></article>"))) == 1_199_999


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", page("<article><p>x.</p></article>"), "mine"), (None, None, None, None), (1, "u", "", "mine")], "page_id long, url string, html string, text string")
    out = extract_text(df)
    assert out.columns == ["page_id", "url", "text"] and sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, [(1, "u", "x."), (None, None, ""), (1, "u", "")]))
    assert extract_text(df.limit(0)).count() == 0


BODY = f"<h1>Head</h1><p>{LONG}</p><p>{LONG * 2}</p><p>Short.</p>"
WHOLE = "\n".join(["Head", LONG.strip(), (LONG * 2).strip(), "Short."])


@pytest.mark.parametrize("name", ["site-content no-sidebar", "with-sidebar content", "social-sciences", "search-results", "post-header-content", "sidebar", "comment"])
def test_classes_of_the_article_itself(name):
    assert main_text(page(f"<div class='{name}'>{BODY}</div><div class=footer>c</div>")) == WHOLE


def test_noisy_names():
    assert all(map(noisy_name, ["ad", "site-footer", "cookie-banner", "comment-list", "nav_menu", "skip-link", "related-posts"]))
    assert not any(map(noisy_name, ["content", "no-sidebar", "with-sidebar", "social-sciences", "search-results", "post-header-content", "adult", "headers", "content-with-ads", "no-comments", "comment-on-article", "load-more"]))


def test_header_of_an_article():
    assert main_text(page(f"<header>Site</header><article><header><h1>Head</h1></header><p>{LONG}</p><footer>by</footer></article>")) == "Head\n" + LONG.strip()


def test_teaser_in_an_article():
    assert main_text(page(f"<article><p>Teaser.</p></article><div class=content>{BODY}</div>")).endswith(WHOLE)


@pytest.mark.parametrize("inner", ["div", "blockquote", "ul", "table"])
def test_part_of_the_content_in_one_element(inner):
    cell = {"ul": "li", "table": "td"}.get(inner, "p")
    got = main_text(page(f"<div id=x><h1>Head</h1><p>{LONG}</p><{inner}><{cell}>{LONG * 3}</{cell}></{inner}><p>{LONG}</p></div>"))
    assert got == "\n".join(["Head", LONG.strip(), (LONG * 3).strip(), LONG.strip()])


def test_lists_of_links_go():
    links = "".join(f"<li><a href=/{i}>Go to {i}</a></li>" for i in range(9))
    assert main_text(page(f"<div class=page><ul>{links}</ul>{BODY}<p>See <a href=/x>this</a>.</p></div>")) == WHOLE + "\nSee this."


def test_links_in_a_sentence_stay():
    rare = "<p>See also <b><a>the report</a></b> and <em><a>the answer</a></em>.</p><p><i>By <a>Jane Roe</a></i></p><p><a>One</a> | <a>two</a></p>"
    assert main_text(page(f"<article>{BODY}{rare}</article>")) == WHOLE + "\nSee also the report and the answer.\nBy Jane Roe"


@pytest.mark.parametrize("name", ["user-comments", "reader-comments", "comment-body", "comment_text", "advert-text", "ad-unit", "related-articles", "newsletter-text", "promo-text", "login-prompt"])
def test_comments_and_adverts_in_an_article_go(name):
    assert main_text(page(f"<article>{BODY}<div class='{name}'><p>{LONG * 3}</p></div></article>")) == WHOLE


def test_nested_noise_stays_out_of_a_lifted_class():
    assert main_text(page(f"<div class=sidebar><div class=ad>Buy, now.</div>{BODY}<nav>n</nav></div>")) == WHOLE


def test_ratios_equal_brute_force():
    html = page(f"<nav><p>x.</p></nav><div><h1>Head</h1><p>{LONG}</p><p>One, <a>link</a> two.</p><ul><li>a<li>b, c</ul></div><p>End.</p>")
    texts = [x for x in parse(html)[1] if not x[0].noise and x[2].strip()]

    def path(n):
        return (path(n.parent) if n.parent else "") + "/" + n.tag

    order = list(dict.fromkeys(path(n) for n, _, _ in texts))
    mean = lambda p, f: sum(f(n, t) for n, _, t in texts if path(n) == p) / sum(path(n) == p for n, _, _ in texts)
    size = {p: mean(p, lambda n, t: 0 if "/a" in path(n) + "/" and path(n).split("/").count("a") else sum(not c.isspace() for c in t)) for p in order}
    marks = {p: mean(p, lambda n, t: sum(c in ".,;:!?" for c in t)) for p in order}
    got = path_ratios(texts)
    for i, p in enumerate(order):
        w = {q: math.exp(-((i - j) ** 2) / 2) for j, q in enumerate(order) if abs(i - j) <= 2}
        want = sum(w[q] * size[q] for q in w) / sum(w.values()) * (1 + sum(w[q] * marks[q] for q in w) / sum(w.values()))
        assert abs(got[next(n.path for n, _, _ in texts if path(n) == p)] - want) < 1e-9
    assert solid(" a\nb ") == 2


@pytest.mark.parametrize("piece", ["<font>x", "<a ", "<p><td>x", "</b>", "<div>", "<li>x", "<ul><li>x", "<!-- x", "<a '", '<a "', "<font></i>", "<table><tr><td>x", "<title>", "&", "<", "<p><font>x</div>"])
def test_hostile_pages_are_linear(piece):
    start = time.perf_counter()
    main_text(piece * 100_000)
    assert time.perf_counter() - start < 8
