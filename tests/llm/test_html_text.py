"""Template removal: counts against brute force, texts against another parser, and pages whose tags say nothing."""

from __future__ import annotations

import collections
import random
from html.parser import HTMLParser

import pytest

from quire.llm import html_text
from quire.llm.html_text import main_text

random.seed(4)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n: int) -> str:
    return " ".join(random.choice(WORDS) + str(random.randrange(99)) for _ in range(n))


class Article(HTMLParser):
    """The blocks of the article by the standard library's parser."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks, self.now = 0, [], ""
        self.feed(html)
        self.close()

    def cut(self) -> None:
        if self.now.split():
            self.blocks.append(" ".join(self.now.split()))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.depth += 1
        if tag in ("p", "h1", "article"):
            self.cut()
        if tag == "br":
            self.now += " "

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.cut()
        if tag == "article":
            self.depth -= 1

    def handle_data(self, data):
        if self.depth:
            self.now += data


def page(i: int, links: int, body: str) -> str:
    menu = "".join(f'<li><a href="/{prose(1)}">{prose(1)}</a></li>' for _ in range(links))
    return f"<html><head><title>x</title><script>var t = '</p>';</script></head><body><nav><ul>{menu}</ul></nav><div class='ad'>{prose(5)}</div>{body}<footer>&copy; {prose(3)}</footer></body></html>"


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts(df, **options):
    return {r["page_id"]: r["text"] for r in html_text.extract_text(df, **options).collect()}


@pytest.fixture(scope="module")
def site(spark):
    rows = []
    for i in range(60):
        parts = "".join(f"<p>{prose(12)} &amp; <b>{prose(2)}<br></b></p>" for _ in range(1 + i % 4))
        rows.append((i, f"http://{('big.org', 'b.org', 'c.org', f'one{i}.org')[i % 4]}/{i}", page(i, 2 + i % 5, f"<article><h1>{prose(4)}</h1>{parts}</article>")))
    return rows


def test_texts_equal_those_of_another_parser_and_templates_decide(spark, site):
    df = frame(spark, site)
    want = {i: "\n\n".join(Article(h).blocks) for i, _, h in site}
    assert texts(df) == want
    templates = html_text.site_templates(df)
    none = templates.selectExpr("host", "counted", "cast(array() as array<bigint>) as hashes", "groups")
    without = texts(df, templates=none)
    # Without the counted subtrees the pages of hosts with several keep their menu, advert and footer.
    several = [i for i in want if i % 4 < 3]
    assert several and all(without[i] != want[i] and want[i] in without[i] for i in several)


def test_templates_before_their_pages_give_the_same(spark, site, monkeypatch):
    df = frame(spark, [*site, (None, None, "<p>lone</p>"), site[0]])
    want = sorted(map(tuple, html_text.extract_text(df).collect()), key=repr)
    monkeypatch.setattr(html_text, "SMALL_HASHES", 0)
    monkeypatch.setattr(html_text, "PAGES_A_GROUP", 4)
    assert sorted(map(tuple, html_text.extract_text(df).collect()), key=repr) == want


def test_an_unrelated_host_changes_no_text(spark):
    def bare(i, body):
        return f"<body><nav><a href='/'>Home {i}</a></nav><div class='text'><h1>Title {i}</h1><p>{body}</p></div><div class='cookies'>We use cookies</div><footer>Contact us {i}</footer></body>"

    rows = [(1, "http://a.org/1", bare(0, prose(30))), (2, "http://b.org/2", bare(1, prose(30)))]
    other = [(9, "http://z.org/", "<body><main><p>Quite another page.</p></main></body>"), (10, "http://y.org/", "<body><table><tr><td>And another.</td></tr></table></body>")]
    want = {i: f"Title {i - 1}\n\n" + h.split("<p>")[1].split("</p>")[0] for i, _, h in rows}
    assert texts(frame(spark, rows)) == want
    got = texts(frame(spark, rows + other))
    assert {i: got[i] for i in want} == want and got[9] == "Quite another page."
    # A host of a single page loses its navigation and footer whatever else there is.
    assert texts(frame(spark, rows[:1])) == {1: want[1]}


def test_counts_against_brute_force(spark, site):
    df = frame(spark, site + [(100 + i, "http://big.org/copy", site[0][2]) for i in range(5)])
    host = lambda u: u.split("/")[2]
    distinct = {(host(u), h) for _, u, h in site}
    pages, seen, inside = collections.Counter(), collections.defaultdict(set), collections.Counter()
    for name, h in distinct:
        shapes, digests = html_text.countable(h)
        inside.update((name, d) for d in digests)
        pages.update((name, d) for d in shapes)
        for d in shapes:
            seen[d].add(name)
    sizes = collections.Counter(name for name, _ in distinct)
    want = collections.defaultdict(set)
    for (name, d), n in pages.items():
        if n >= 3 or len(seen[d]) >= 3:
            want[name].add(d)
    for (name, d), n in inside.items():
        if n >= 3:
            want[name].add(d)
    got = {r["host"]: set(r["hashes"] or ()) for r in html_text.site_templates(df).collect()}
    assert got == {name: want[name] for name in sizes}


def test_pages_without_article(spark):
    def plain(i):
        return f"<body><div class='top'><a href='/a'>{prose(1)}</a> <a href='/b'>{prose(1)}</a></div><div class='layout with-sidebar'><h1>T{i}</h1><p>{prose(30)}</p><div class='box'>Sign up now</div></div><div class='low'>{prose(3)}</div></body>"

    def flat(i):
        return f"<body><ul><li><a href='/{i}'>{prose(1)}</a><li><a href='/x'>{prose(1)}</a></ul><h2>F{i}</h2><p>{prose(9)}</p><p>{prose(9)}</p><footer>{prose(4)}</footer></body>"

    rows = [(i, f"http://h.org/{i}", plain(i)) for i in range(6)] + [(10 + i, f"http://g.org/{i}", flat(i)) for i in range(6)]
    got = texts(frame(spark, rows))
    for i in range(6):
        p = rows[i][2]
        assert got[i] == f"T{i}\n\n" + p.split("<p>")[1].split("</p>")[0]
        assert got[10 + i].split("\n\n") == [f"F{i}"] + [x.split("</p>")[0] for x in rows[6 + i][2].split("<p>")[1:]]


def test_furniture_words_inside_class_names_do_not_empty_a_page():
    text = prose(20)
    assert main_text(f"<body><div class='layout with-sidebar'><p>{text}</p></div></body>") == text
    assert main_text(f"<body><article><div class='post social'><p>{text}</p></div><div class='share'>Share</div></article></body>") == text
    assert main_text(f"<body><article class='post social'><p>{text}</p></article><article class='comment'><p>no</p></article></body>") == text
    assert main_text(f"<article><p>{text}</p><section class='comments'><p>nice</p></section><aside>x</aside></article>") == text


def test_small_tables_and_odd_rows(spark):
    one = frame(spark, [(1, "http://a.org/", page(1, 3, "<article><p>body text</p></article>"))])
    assert texts(one) == {1: "body text"}
    odd = frame(spark, [(None, None, None), (2, None, ""), (2, "x", "<p>t</p>"), (2, "x", "<p>t</p>"), (3, "http://b.org", "<nav>only</nav>")])
    rows = html_text.extract_text(odd.withColumnsRenamed({}).selectExpr("*", "'c' as text", "1 as n_chars", "'d' as host", "'e' as digest")).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in rows) == [(0, ""), (2, ""), (2, "t"), (2, "t"), (3, "")]
    assert html_text.extract_text(odd.limit(0)).count() == 0


def test_a_very_long_page_is_kept_whole(spark):
    paragraphs = [prose(50) for _ in range(4000)]
    long = "<article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article>"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    got = texts(frame(spark, [(1, "http://a.org/", page(1, 3, long)), (2, "http://a.org/d", deep)]))
    assert got[1] == "\n\n".join(paragraphs) and got[2] == "deep"
