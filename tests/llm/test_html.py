import html
import re

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from raggedly.llm import html as operator
from raggedly.llm.html import Template, extract_main_text, main_text, templates, tokens_of
from raggedly.llm.queries import op13_html


@pytest.fixture
def pages(spark):
    """Pages with columns whose names the operator uses itself."""

    def build(rows):
        names = ["page_id", "url", "html", "_html", "_host", "text", "classes"]
        schema = StructType(
            [StructField(n, LongType() if n == "page_id" else StringType()) for n in names]
        )
        return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], schema)

    return build


def result(df):
    assert df.columns == ["page_id", "url", "text", "n_chars"]
    rows = df.collect()
    assert all(r.n_chars == len(r.text) for r in rows)
    return {r.page_id: r.text for r in rows}


def text_of(page):
    return main_text(Template(None), page)


def shell(i, body, more=""):
    """A site without any telling name: only its pages together say what its template is."""
    return (
        f"<html><head><title>t{i}</title></head><body><div class=x1><b>Site Name</b><ul>"
        f"<li><a href=/{i}>part {i * 7}</a><li><a href=/z>about {i * 3}</a></ul></div>"
        f"<div class=x2>{body}</div>{more}<div class=x3>All rights kept</div></body></html>"
    )


def test_every_article_of_the_tables(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = result(op13_html(spark, sf_dir))
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        plain = re.sub("<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inside)
        assert got[r.page_id] == " ".join(html.unescape(plain).split())


def test_template_of_a_site_without_names(pages):
    bodies = [f"<h2>Head {i}</h2><p>Text number {i} goes on{' and on' * i}." for i in range(9)]
    rows = [(i, "http://plain.example/p", shell(i, b)) for i, b in enumerate(bodies)]
    rows.append((90, "http://Plain.example:80/odd", "<p>No page of that kind"))
    got = result(extract_main_text(pages(rows)))
    for i in range(9):
        assert got[i] == f"Head {i} Text number {i} goes on{' and on' * i}."
    assert got[90] == "No page of that kind"


def test_copies_of_an_article_are_no_template(pages):
    copy = "<h2>Same head</h2><p>The same long text on many pages of a host, word for word.</p>"
    rows = [(i, "http://copies.example/", shell(i, copy)) for i in range(40)]
    rows += [(100 + i, "http://copies.example/", shell(i, f"<h2>H{i}</h2><p>Own text of this page {i * i}, longer than a menu.</p>"))
             for i in range(4)]
    got = result(extract_main_text(pages(rows)))
    assert {got[i] for i in range(40)} == {
        "Same head The same long text on many pages of a host, word for word."
    }
    assert got[103] == "H3 Own text of this page 9, longer than a menu."


def test_repeated_slots_and_rare_parts(pages):
    """Lists of other lengths, a part that some pages have, and one that is out of order."""
    rows = []
    for i in range(12):
        body = "".join(f"<p>Line {i} {j} of this text</p>" for j in range(1 + i % 4))
        more = "<div class=x4>Seen only now and then</div>" if i % 2 else ""
        rows.append((i, "https://h/", shell(i, body, more if i % 3 else more * 2)))
    got = result(extract_main_text(pages(rows)))
    for i in range(12):
        assert got[i].startswith(" ".join(f"Line {i} {j} of this text" for j in range(1 + i % 4)))
        assert "Site Name" not in got[i] and "rights" not in got[i] and "about" not in got[i]


def test_constant_text_of_an_article(pages):
    def page(i, end):
        return f"<body><nav>menu</nav><article><p>Some words {i * 11} here{'!' * i}</p>{end}</article></body>"

    share = "<div><i>Read more of this</i></div>"
    rows = [(i, "http://all.example/", page(i, share)) for i in range(8)]
    rows += [(20 + i, "http://most.example/", page(i, "<p>A shared line</p>" if i % 4 else "")) for i in range(8)]
    got = result(extract_main_text(pages(rows)))
    assert [got[i] for i in range(8)] == [f"Some words {i * 11} here{'!' * i}" for i in range(8)]
    assert got[21] == "Some words 11 here! A shared line"
    assert got[20] == "Some words 0 here"


def test_same_result_by_joined_templates(pages, monkeypatch):
    rows = [(i, f"http://h{i % 2}/", shell(i, f"<p>Some text {i * i}, of a page")) for i in range(14)]
    want = result(extract_main_text(pages(rows)))
    monkeypatch.setattr(operator, "MAX_BROADCAST_TOKENS", 0)
    assert result(extract_main_text(pages(rows))) == want
    assert want[3] == "Some text 9, of a page"


def test_templates_are_ordered_classes(spark, pages):
    from pyspark.sql import functions as F

    rows = pages([(i, "u", shell(i, f"<p>Words {i * i}")) for i in range(6)])
    found = templates(rows.select(F.lit(1).cast("long").alias("_host"), F.col("html").alias("_html"))).collect()
    assert len(found) == 1
    tokens = [t for t, *_ in tokens_of(shell(0, "<p>Words 0")) if t]
    for c in found[0].classes:
        at = [tokens.index(t) for t in c.tokens]
        assert at == sorted(at) and c.share == 1.0


def test_nulls_empty_and_repeated_rows(pages):
    rows = [(1, None, None), (1, None, None), (None, "", ""), (2, "no host", "<p>a"), (2, "no host", "<p>a"),
            (3, "http://x/", "   "), (4, None, "<nav>only menu</nav>"), (5, "//rel.example/x", "word " * 50_000)]
    df = extract_main_text(pages(rows))
    got = sorted(((r.page_id or 0, r.url, r.text) for r in df.collect()), key=repr)
    assert got == sorted(
        [(1, None, ""), (1, None, ""), (0, "", ""), (2, "no host", "a"), (2, "no host", "a"),
         (3, "http://x/", ""), (4, None, ""), (5, "//rel.example/x", ("word " * 50_000).strip())], key=repr)
    assert extract_main_text(pages([])).collect() == []


@pytest.mark.parametrize("page, text", [
    ("a<b>b</b>c <i>d</i>\n\t e<br>f<div>g</div>h", "abc d e f g h"),
    ("x &amp; y &lt;z&gt; &copy; &eacute;&#233;&#xe9; &nbsp;&am &amp", "x & y <z> © ééé &am &"),
    ("<script>var t=\"</p>\";if(a<b)</script>a<style>p{}</style>b<!-- c --> d <!-->e<!-- open", "ab d e"),
    ("<p>a<p>b<ul><li>c<li>d</ul><table><tr><td>e<td>f</table>", "a b c d e f"),
    ("<header>h</header><article><header><h1>T</h1></header>a<footer>f</footer></article>", "T a"),
    ("<main>m<article>a<aside>s</aside></article></main>", "a"),
    ("<main>m<p>n</main>after", "m n"),
    ("<div role=navigation>n</div><div class='post-body'>a<div class=\"ad-slot\">x</div>b</div>", "a b"),
    ("<body class='has-sidebar no-ads'><article><p>a</article><section class=userComments>c", "a"),
    ("<article>a<div class=comments><p>c</div></article><article class=comment>d</article>", "a"),
    ("<article>a</article><article>b</article>", "a b"),
    ("<p>cut off in a <a href=\"x", "cut off in a"),
    ("<p title='a > b' data-x=\"<p>\">q</p><form>f<p>g</form>2 < 3 <3", "q 2 < 3 <3"),
    ("<article>a <form>f</form><button>b</button><a href=x>link</a></article>", "a link"),
    ("<DIV CLASS=Cookie-Notice>n</DIV><P HIDDEN>h</P><P>T</P>", "T"),
    ("<p title='hidden'>a</p><p data-x=hidden aria-hidden=false>b</p><p class=is-hidden>c", "a b c"),
    ("<div hidden><p>a</p></div><div><p>b</p></div><div hidden><p>c", "b"),
    ("</p></div>a</b>", "a"),
    ("<title>t<p>u", ""),
    ("<article></article>outside", "outside"),
])
def test_rules_of_a_page(page, text):
    assert text_of(page) == text


def test_hostile_markup_takes_linear_time():
    import time

    start = time.time()
    for page in ("<a " * 100_000, "<a href=\"" * 50_000, "<b>" * 60_000 + "<p>x" * 60_000,
                 "<div>" * 100_000 + "</p>" * 100_000, "<!-- " * 100_000, "<" * 300_000, "<script>" * 50_000,
                 "</div>" * 100_000, "<li>" * 100_000):
        text_of(page)
    assert time.time() - start < 30
