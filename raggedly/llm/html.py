"""Main text of web pages: templates are deduced from the pages of a host, what is left is text."""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from heapq import nlargest

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import spread_join, stored

#: A host's template needs so many pages that differ, and a token so large a share of them.
LEAST_PAGES, SUPPORT = 5, 0.5
#: Pages of a host differ when so many of their longest runs of text do.
LONGEST = 3
#: Tokens of a class; the share of its pages in which they stand in one order at one place.
LEAST_TOKENS, ORDERED = 2, 0.9
#: Constant text inside an article goes when it is on so large a share of a host's pages.
ARTICLE_SUPPORT = 0.95
#: A slot of a template whose text is linked to this share is a menu.
LINKED = 0.5
#: Tokens of all templates that are broadcast; with more of them pages are joined by host.
MAX_BROADCAST_TOKENS = 2_000_000

# Fixed values of HTML: elements without content, with raw content, that make blocks, and
# those that another start tag closes (up to the ones that hold them).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav noscript ol optgroup option p pre search section select summary table tbody td "
    "template tfoot th thead title tr ul".split()
)
HOLDERS = BLOCKS - frozenset("p br hr h1 h2 h3 h4 h5 h6 address".split())
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}

#: Elements, roles and words of class or id whose content is no main text.
OUTSIDE = frozenset(
    "head nav footer aside form script style noscript template iframe object svg canvas audio "
    "video button select textarea dialog menu search title".split()
)
OUTSIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog form menu "
    "menubar toolbar".split()
)
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices popup modal overlay sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead comment comments respond disqus share "
    "sharing social related recommended newsletter subscribe subscription login signup "
    "pagination pager toolbar".split()
)
#: After these words a class says what a page has, not what an element is.
NOT_ITSELF = frozenset("has with no without is".split())
REGIONS = {"main": 1, "article": 2}

MARK = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>"
    r"|<[/!?][^>]*+(?:>|\Z)|<[A-Za-z][^>]*+\Z",
    re.S,
)
TELLING = re.compile(r"class|id|role|hidden", re.I)
ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s\"'>]++))?")


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars`` (code points).

    The tokens of a page are its tags, each with the path and classes of its elements, and the
    runs of text between them. On the pages of a host, tokens that occur equally often on each
    page are equivalent. Pages with the same ``LONGEST`` longest runs of text count once, so that
    copies of one article do not make it a template. A class of tokens on half of the pages is
    valid when its tokens stand in the same order, at the same place of another class, on nearly
    all pages that have them; valid classes nested into each other are the template. Its constant
    text goes; the rest of a page is in slots between its tokens. Slots that are mostly links go, and so
    does what stands in elements that are no article by their name, role or class (menus,
    headers, footers, sidebars, notices, adverts, forms, scripts, comments). Where a page has an
    article (or else a main element) its slots are the result; links and, unless nearly all
    pages have it, constant text stay there.

    Occurrence vectors are added up as hashes, so no page is gathered, and a template is no
    longer than two mean pages. Character references are decoded, white space becomes one
    space, and blocks are joined by one space.

    A host with fewer than ``LEAST_PAGES`` different pages has no template; the other rules
    hold. Null html counts as empty and gives an empty text. Null urls are one host. Rows that
    repeat an id are rows of their own, with equal text if they are equal. No rows give none.
    """
    host = F.lower(F.regexp_extract(F.coalesce(pages[url_col].cast("string"), F.lit("")),
                                    r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    rows = pages.select(
        pages[id_col].alias("page_id"),
        pages[url_col].alias("url"),
        F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("_html"),
        F.xxhash64(host).alias("_host"),
    )
    template = templates(rows)
    schema = rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return _with_template(rows, template, "left").mapInArrow(_extract, schema)


def templates(rows: DataFrame) -> DataFrame:
    """``_host, classes``: array of (tokens in their order, share of pages), and ``linked``:
    array of (first token of a class, place after that many of its tokens)."""
    classes = stored(_classes(rows), "page-classes")
    seen = stored(
        _with_template(rows.select("_host", "_html"), classes, "inner").mapInArrow(
            _learn,
            "_host long, tokens array<long>, parent long, place int, n_pages long, chars long, "
            "linked long",
        ),
        "page-orders",
    )
    # By the smallest token of a class: the pages with one order and place, and with any.
    orders = (
        seen.where("chars is null")
        .groupBy("_host", F.array_min("tokens").alias("_class"), "tokens", "parent", "place")
        .agg(F.sum("n_pages").alias("_n"))
        .groupBy("_host", "_class")
        .agg(
            F.sum("_n").alias("_all"),
            F.max(F.struct("_n", "tokens", "parent", "place")).alias("_top"),
        )
        .where((F.col("_top._n") >= ORDERED * F.col("_all")) & (F.size("_top.tokens") >= LEAST_TOKENS))
    )
    shares = classes.select("_host", F.explode("classes").alias("c")).select(
        F.col("_host").alias("_h"), F.array_min("c.tokens").alias("_c"), "c.share"
    )
    valid = (
        orders.join(shares, (F.col("_host") == F.col("_h")) & (F.col("_class") == F.col("_c")))
        .groupBy("_host")
        .agg(F.collect_list(F.struct(F.col("_top.tokens").alias("tokens"), "share")).alias("classes"))
    )
    menus = (
        seen.where("chars is not null")
        .groupBy("_host", "parent", "place")
        .agg(F.sum("chars").alias("_chars"), F.sum("linked").alias("_linked"))
        .where(F.col("_linked") >= LINKED * F.col("_chars"))
        .groupBy(F.col("_host").alias("_h"))
        .agg(F.collect_list(F.struct("parent", "place")).alias("linked"))
    )
    return stored(
        valid.join(menus, F.col("_host") == F.col("_h"), "left").select("_host", "classes", "linked"),
        "page-templates",
    )


def _classes(rows: DataFrame) -> DataFrame:
    """``_host, classes``: array of (tokens, share) with equal occurrence vectors."""
    vector = F.xxhash64("variant", "n")
    tokens = (
        rows.select("_host", "_html")
        .mapInArrow(_occurrences, "_host long, token long, variant long, n int")
        .groupBy("_host", "token", "variant")
        .agg(F.max("n").alias("n"))
        .groupBy("_host", "token")
        .agg(F.bit_xor(vector).alias("_vector"), F.count("*").alias("_support"))
    )
    tokens = stored(tokens.where(F.col("_support") >= LEAST_PAGES * SUPPORT), "page-tokens")
    hosts = tokens.where("token = 0").select("_host", F.col("_support").alias("_pages"))
    return (
        spread_join(tokens.where("token <> 0"), hosts, ["_host"], F.col("token"))
        .where((F.col("_pages") >= LEAST_PAGES) & (F.col("_support") >= SUPPORT * F.col("_pages")))
        .groupBy("_host", "_vector", "_support")
        .agg(
            F.collect_list("token").alias("tokens"),
            F.max(F.col("_support") / F.col("_pages")).alias("share"),
        )
        .where(F.size("tokens") >= LEAST_TOKENS)
        .groupBy("_host")
        .agg(F.collect_list(F.struct("tokens", "share")).alias("classes"))
    )


def _with_template(rows: DataFrame, template: DataFrame, how: str) -> DataFrame:
    """Pages with what is known of their host; no page is shuffled unless templates are many."""
    size = template.agg(F.sum(F.aggregate("classes", F.lit(0), lambda n, c: n + F.size(c["tokens"])))).first()[0]
    if (size or 0) > MAX_BROADCAST_TOKENS:
        return spread_join(rows, template, ["_host"], F.xxhash64("_html"), how)
    known = template.withColumnRenamed("_host", "_of_host")
    joined = rows.join(F.broadcast(known), F.col("_host") == F.col("_of_host"), how)
    return joined.drop("_of_host")


class Element:
    """An open element: its hash of names from the top on, and what holds for its content."""

    __slots__ = ("name", "path", "outside", "region", "link")

    def __init__(self, name: str, path: int, outside: bool, region: int, link: bool):
        self.name, self.path, self.outside, self.region, self.link = name, path, outside, region, link


def tokens_of(page: str) -> Iterator[tuple[int, str | None, Element | None, bool]]:
    """``token, text, element, block``: tags have no text; ``block`` is whether a block ends or
    starts there. White space alone is no token (and text None), but may stand between words."""
    stack: list[Element] = [Element("", 0, False, 0, False)]
    open_names: Counter[str] = Counter()
    at, end = 0, len(page)

    def closed(n: int):
        while len(stack) > n:
            e = stack.pop()
            open_names[e.name] -= 1
            yield ~e.path, None, None, e.name in BLOCKS

    while at < end:
        found = MARK.search(page, at)
        start = found.start() if found else end
        if start > at:
            text = page[at:start]
            words = " ".join(text.split())
            token = _hash(f"{stack[-1].path} {words}") if words else 0
            yield token, text, stack[-1], False
        if not found:
            break
        at, name = found.end(), (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            if open_names[name]:
                n = len(stack) - 1
                while stack[n].name != name:
                    n -= 1
                yield from closed(n)
            elif name in BLOCKS:
                yield 0, None, None, True
            continue
        targets, holders = IMPLIED.get(name, (("p",), HOLDERS))
        if name in IMPLIED or name in BLOCKS and name != "br":
            if any(open_names[t] for t in targets):
                n = len(stack) - 1
                while n and stack[n].name not in targets and stack[n].name not in holders:
                    n -= 1
                if n and stack[n].name in targets:
                    yield from closed(n)
        up = stack[-1]
        attributes = found[3] if TELLING.search(found[3]) else ""
        element = _known.get((up.path, name, attributes))
        if element is None:
            words, outside = _described(name, attributes, up)
            element = Element(
                name,
                _hash(f"{up.path} <{name} {words}"),
                outside,
                max(up.region, _region(name, words)),
                up.link or name == "a",
            )
            if len(_known) < REMEMBERED:
                _known[up.path, name, attributes] = element
        yield element.path, None, None, name in BLOCKS
        if name in VOID:
            continue
        open_names[name] += 1
        stack.append(element)
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = stop.start() if stop else end
    yield from closed(1)


#: Elements by the path above, name and telling attributes; a bound of memory.
REMEMBERED = 50_000
_known: dict[tuple[int, str, str], Element] = {}


def _hash(key: str) -> int:
    return xxhash.xxh3_64_intdigest(key.encode("utf-8", "replace")) >> 1 | 1  # no sign, never 0


def _described(name: str, attributes: str, up: Element) -> tuple[str, bool]:
    """Classes, id and role without digits, and whether the content is no main text."""
    words, outside = [], up.outside or name in OUTSIDE or name == "header" and not up.region
    for key, value in ATTRIBUTE.findall(attributes) if attributes else ():
        key = key.lower()
        if key == "hidden":
            words.append(key)
            outside = True
        if key not in ("class", "id", "role"):
            continue
        parts = re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", value).lower())
        words.append(f"{key}={' '.join(parts)}")
        if key == "role":
            outside |= not OUTSIDE_ROLES.isdisjoint(parts)
        elif name not in ("html", "body", "main", "article") or "comment" in parts:
            outside |= any(
                p in OUTSIDE_WORDS and (i == 0 or parts[i - 1] not in NOT_ITSELF)
                for i, p in enumerate(parts)
            )
    return " ".join(words), outside


def _region(name: str, words: str) -> int:
    return REGIONS.get(name, 0) or ("role=main" in words) or 2 * ("role=article" in words)


def _occurrences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each token is on each page; token 0 once for the page itself."""
    for batch in batches:
        columns = ([], [], [], [])
        for host, page in zip(batch["_host"].to_pylist(), batch["_html"].to_pylist()):
            counts, runs = Counter(), set()
            for token, text, element, _ in tokens_of(page):
                if token:
                    counts[token] += 1
                if text and not element.outside:
                    runs.add(text)
            counts[0] = 1
            longest = nlargest(LONGEST, runs, key=lambda text: (len(text), text))
            variant = _hash("\0".join(longest))
            for token, n in counts.items():
                for column, value in zip(columns, (host, token, variant, n)):
                    column.append(value)
        yield _batch(("_host", "token", "variant", "n"), columns, (pa.int64(),) * 3 + (pa.int32(),))


def _batch(names, columns, types) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types)], names=list(names)
    )


class Template:
    """Which class each token of a host is in, by number."""

    def __init__(self, classes: list[dict] | None, linked: list[dict] | None = None):
        self.tokens = [c["tokens"] for c in classes or ()]
        self.share = [c["share"] for c in classes or ()]
        self.of = {t: k for k, tokens in enumerate(self.tokens) for t in tokens}
        self.linked = {(m["parent"], m["place"]) for m in linked or ()}

    def walk(self, page: str):
        """``token, text, element, block, class, slots`` along the page, and what it says of the
        classes: the order of their tokens and the slot they start in (None: no one order)."""
        open_: list[tuple[int, list[int]]] = []  # classes whose tokens are not complete
        inside: set[int] = set()
        said: dict[int, tuple | None] = {}
        for token, text, element, block in tokens_of(page):
            k = self.of.get(token)
            if k is not None:
                if k in inside and open_[-1][0] != k:  # it goes on across a class in its slot
                    while open_[-1][0] != k:
                        other = open_.pop()[0]
                        inside.discard(other)
                        said[other] = None
                if k not in inside:
                    parent = self._slot(open_[-1]) if open_ else (0, 0)
                    open_.append((k, []))
                    inside.add(k)
                    if said.setdefault(k, ((), parent)) and said[k][1] != parent:
                        said[k] = None
                order = open_[-1][1]
                if token in order:
                    said[k] = None
                    open_.pop()
                    inside.discard(k)
                else:
                    order.append(token)
                    if len(order) == len(self.tokens[k]):
                        open_.pop()
                        inside.discard(k)
                        before = said[k]
                        if before:
                            same = not before[0] or before[0] == tuple(order)
                            said[k] = (tuple(order), before[1]) if same else None
            yield token, text, element, block, k, open_
        for k, _ in open_:
            said[k] = None
        self.said = said

    def _slot(self, entry: tuple[int, list[int]]) -> tuple[int, int]:
        return min(self.tokens[entry[0]]), len(entry[1])

    def is_linked(self, open_: list[tuple[int, list[int]]]) -> bool:
        return bool(self.linked) and any(self._slot(e) in self.linked for e in open_)


def _hosts(batch: pa.RecordBatch) -> Iterator[tuple[int, Template, str]]:
    """Pages with the template of their host, made once for each host of a batch."""
    known: dict[int, Template] = {}
    linked = batch["linked"] if "linked" in batch.schema.names else None
    for i, (host, page) in enumerate(zip(batch["_host"].to_pylist(), batch["_html"].to_pylist())):
        if host not in known:
            known[host] = Template(batch["classes"][i].as_py(), linked and linked[i].as_py())
        yield host, known[host], page


def _learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Orders of classes by the number of pages, and text and linked text of their slots."""
    for batch in batches:
        orders: Counter[tuple] = Counter()
        chars: Counter[tuple] = Counter()
        links: Counter[tuple] = Counter()
        for host, template, page in _hosts(batch):
            for token, text, element, _, _, open_ in template.walk(page):
                if text and token:
                    for entry in open_:
                        slot = (host, *template._slot(entry))
                        chars[slot] += len(text)
                        links[slot] += len(text) * element.link
            for k, what in template.said.items():
                if what:
                    orders[host, what[0], *what[1]] += 1
                else:  # the smallest token alone: less than any class has
                    orders[host, (min(template.tokens[k]),), 0, 0] += 1
        rows = [(h, list(t), p, at, n, None, None) for (h, t, p, at), n in orders.items()]
        rows += [(h, None, p, at, None, n, links[h, p, at]) for (h, p, at), n in chars.items()]
        yield _batch(
            ("_host", "tokens", "parent", "place", "n_pages", "chars", "linked"),
            list(zip(*rows)) or [[]] * 7,
            (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32()) + (pa.int64(),) * 3,
        )


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(template, page) for _, template, page in _hosts(batch)]
        yield pa.RecordBatch.from_arrays(
            [
                batch["page_id"],
                batch["url"],
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ],
            names=["page_id", "url", "text", "n_chars"],
        )


def main_text(template: Template, page: str) -> str:
    """The text in the slots of the highest region that has any."""
    found: list[list[str]] = [[], [], []]
    for _, text, element, block, k, open_ in template.walk(page):
        if block:
            for parts in found:
                parts.append(" ")
        if not text or element.outside:
            continue
        if k is not None and (not element.region or template.share[k] >= ARTICLE_SUPPORT):
            continue
        if not element.region and template.is_linked(open_):
            continue
        found[element.region].append(references.unescape(text))
    for parts in reversed(found):
        text = " ".join("".join(parts).split())
        if text:
            return text
    return ""
