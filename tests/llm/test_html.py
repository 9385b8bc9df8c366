"""Main text of pages with known articles."""

import html
import random

from shellfield.llm.html_template import Page, equivalence_classes, extract_block, extract_main_text, token_classes
from tests.llm.corpus import text_of

SCHEMA = "page_id long, url string, html string, text string, n int, host string, block int, `a.b` int"


def page(rng, i, skin):
    blocks = [" ".join(text_of(rng, rng.randrange(3, 30)).split()) for _ in range(rng.randrange(1, 6))]
    title = " ".join(text_of(rng, 5).split())
    body = f"<h1>{html.escape(title)}</h1>" + "".join(f"<p>{html.escape(b)}</p>" for b in blocks)
    other = lambda: " ".join(text_of(rng, 8).split())
    if skin == 0:
        source = (
            f"<!DOCTYPE html><html><head><title>{title}</title><script>var t='</p>';</script></head><body><nav><ul><li><a "
            f"href='/x'>{other()}</a></li></ul></nav><!-- ad --><div class=\"ad\">{other()}</div><article>{body}</article>"
            f"<footer>&copy; {other()}</footer></body></html>"
        )
    elif skin == 1:
        source = (
            f"<html><body class='has-sidebar'><header><h1>{other()}</h1></header><div id=menu>{other()}</div><main>"
            f"<article class='post post-{i}'>{body}<form><input><p>{other()}</p></form><div class='share-bar'>{other()}</div>"
            f"</article><section id='comments'><article class='comment'><p>{other()}</p></article></section></main>"
            f"<aside><article><p>{other()}</p></article></aside><div class='cookie-notice'>{other()}</div></body></html>"
        )
    else:
        source = (
            f"<body><div class=navbar>{other()}</div><div class='content main-{i}'>{body}</div><div class='sidebar'>"
            f"{other()} {other()}</div><style>p{{}}</style><div class='footer'>{other()}"  # cut off
        )
    return source, "\n".join([title, *blocks])


def test_pages(spark):
    rng = random.Random(2)
    rows, expected = [], {}
    for i in range(230):
        skin = i % 3
        source, expected[i] = page(rng, i, skin)
        host = f"h{skin}.example.org" if i < 200 else f"single{i}.example.org"
        rows.append((i, f"https://user@{host}:80/p?{i}", source, "x", 1, "h", 2, 3))
    odd = [(1000, None, None), (1001, "http://e.org/", ""), (1002, "nothing", "a &amp; b&nbsp;&nbsp;c\n d"), (1003, "x", "<<<>>> <p"),
           (1004, "http://e.org/2", "<article>" + "<p>word &#x41;</p>" * 5000)]
    rows += [(*r, "x", 1, "h", 2, 3) for r in odd] + [rows[0]]
    got = extract_main_text(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_chars == len(r.text)
        if r.page_id < 1000:
            assert r.text == expected[r.page_id], r.page_id
    texts = {r.page_id: r.text for r in got}
    assert texts[1000] == texts[1001] == ""
    assert texts[1002] == "a & b c d"
    assert texts[1004] == "\n".join(["word A"] * 5000)
    assert extract_main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_classes_have_equal_vectors_and_one_order():
    sources = ["<body><nav><ul>" + "<li>x" * n + "</ul></nav><article>" + "<p>y</p>" * (n + 1) + "</article></body>" for n in (1, 2, 4)]
    classes = equivalence_classes([Page(s) for s in sources])
    assert classes[0] == ["/body", "/body/nav", "/body/nav/ul", "/body/article"]
    assert ["/body/nav/ul/li"] in classes and ["/body/article/p"] in classes


def test_inline_and_unclosed():
    source = "<article><p><b>One<i>two</i> three<br>four<p>five <span class='ad'>no</span>six<ul><li>a<li>b</ul>tail</article>"
    assert extract_block([source]) == ["Onetwo three four\nfive six\na\nb\ntail"]


def test_lines_of_the_template_go_whatever_their_names():
    rng = random.Random(5)
    line = lambda n: " ".join(text_of(rng, n).split())
    bodies = [[line(6), *[line(30) for _ in range(1 + i % 3)]] for i in range(9)]
    sources = [
        "<body><article><h1>" + b[0] + "</h1><div class='xq7'>Read our magazine</div><p>" + "<p>".join(b[1:])
        + "<div>Seen by <b>many</b></div></article></body>"
        for b in bodies
    ]
    assert extract_block(sources) == ["\n".join(b) for b in bodies]
    # One page, and copies of one article, have no template: nothing of the article goes.
    whole = "\n".join([bodies[0][0], "Read our magazine", *bodies[0][1:], "Seen by many"])
    assert extract_block(sources[:1]) == [whole]
    assert extract_block(sources[:1] * 8) == [whole] * 8


def test_classes_out_of_order_or_crossing_are_dropped():
    assert token_classes([list("abcd"), list("abdc"), list("abcd")])[0] in (list("abc"), list("abd"))
    assert token_classes([list("xyxy"), list("xyyx"), list("xy")]) == []
    # k and l come on two pages of three, around c of the wider class.
    assert token_classes([list("abkcld"), list("abcd"), list("abkcld")]) == [list("abcd")]
    assert ["k", "l"] in token_classes([list("abklcd"), list("abcd"), list("abklcd")])


def test_names_inside_an_article_drop_nothing_of_it():
    rng = random.Random(6)
    line = lambda n: " ".join(text_of(rng, n).split())
    sources, expected = [], []
    for i in range(8):
        a = [line(9) for _ in range(6)]
        more = [line(9)] if i == 3 else []
        sources.append(
            f"<body><div id='search-box'>{line(4)}</div><article><h1>{a[0]}</h1><h2 id='related-work'>{a[1]}</h2>"
            f"<section id='search-algorithms'><p>{a[2]}</p><p class='notice'>{a[3]}</p></section><h2 id='menu'>{a[4]}</h2>"
            f"<div class='share-bar'>{line(5)}</div><div id='reply-{i}'>{line(5)}</div><p>{a[5]}</p>"
            + "".join(f"<section id='search'><p>{m}</p></section>" for m in more) + "</article></body>"
        )
        expected.append("\n".join(a + more))
    assert extract_block(sources) == expected
