"""Main text of web pages by site template removal.

Every element's subtree is hashed over its tag, attributes, text and children.
Spark counts per host with how many different contents each hash occurs; the
subtrees that recur across many are the host's template and are deleted from
every page, inside its article as well (there only containers are asked, never
an article's own paragraphs). A page's content is known by its longest
paragraph, so copies of one article count once and are not taken for a template.

What is left of the article or main element, or of the body where there is
neither, is the text, without what pages mark as furniture themselves: elements
for it (nav, footer, form), hidden ones, and those whose class, id or role says
nothing else (an advert or a reader's comment differs from page to page, so it
never recurs).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import table, written
from loomgraph.llm.urls import host_of

#: Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)
FURNITURE = frozenset("head nav header footer aside form button select option dialog menu object svg canvas audio video input label fieldset".split()) | RAW
ROOTS = ("article", "main")
#: Words of a class, id or role that mark furniture.
MARKED = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion cookie cookies consent gdpr
    notice notices popup modal overlay newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header
    masthead comment comments disqus respond share sharing toolbar pagination pager login signup contentinfo complementary""".split()
)
#: Words that may stand beside a marking one without another meaning ("ad-slot" is an advert, "ad-hoc" is not).
BESIDE = frozenset(
    """area bar banner block body bottom box button buttons class container content div el element footer form global group header holder id inner
    item items js left link links list main outer page panel primary right row secondary section site slot small social text the top unit widget
    wrap wrapper zone""".split()
)
#: Elements that may be template inside an article: containers, not the paragraphs of the text.
CONTAINERS = frozenset("div section ul ol dl aside nav form figure table details address".split())
#: Elements whose start ends an open one of the given names.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "body": ("head",),
}
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SCOPE = frozenset("table td th body html article section div aside form".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))|[^>])*+)(>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.S)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Element:
    name: str
    attrs: str = ""
    children: list = field(default_factory=list)  # of elements and strings
    digest: int | None = None


class _Open:
    """The open elements, with the places of each name among them, so that ends and implied ends cost the same at any depth."""

    def __init__(self, root: Element):
        self.stack, self.at = [root], {}

    def push(self, e: Element) -> None:
        self.at.setdefault(e.name, []).append(len(self.stack))
        self.stack.append(e)

    def last(self, names) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def close(self, k: int) -> None:
        while len(self.stack) > k:
            self.at[self.stack.pop().name].pop()

    def start(self, name: str) -> None:
        """Ends what the start of an element of that name ends."""
        for names, until in ((CLOSES.get(name, ()), SCOPE - {name}), (("p",) if name in ENDS_P else (), SCOPE)):
            k = self.last(names) if names else 0
            if k and k >= self.last(until):
                self.close(k)


def parse(html: str) -> Element:
    """The tree of a page, in time linear in its length. Never fails: stray ends are passed over, what is open at the end of the page is closed there."""
    root = Element("#page")
    open_ = _Open(root)
    stack, at, n = open_.stack, 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if not m:
            stack[-1].children.append(html[at:])
            break
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if not m[4]:  # the page ends inside a tag
            break
        if m[1]:
            k = open_.last((name,))
            if k:
                open_.close(k)
            continue
        open_.start(name)
        element = Element(name, m[3])
        stack[-1].children.append(element)
        if name in VOID or m[3].endswith("/"):
            continue
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>?", re.I).search(html, at)
            element.children.append(html[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        open_.push(element)
    return root


def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): unescape(v.strip("\"'")) if v else "" for k, v in _ATTR.findall(raw)}


def furniture(e: Element, in_root: bool) -> bool:
    """Whether the site marks e as no part of the article; an article's own header holds its title and stays."""
    if e.name in ROOTS or e.name in ("body", "html"):
        return False
    if e.name in FURNITURE:
        return not (e.name == "header" and in_root)
    if not e.attrs or "=" not in e.attrs and "hidden" not in e.attrs:
        return False
    a = attributes(e.attrs)
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    for token in f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}".split():
        words = {w.lower() for w in _WORD.findall(token)}
        marks = words & MARKED
        if marks and words <= MARKED | BESIDE and not (in_root and marks == {"header"}):
            return True
    return False


def hash_subtrees(root: Element) -> None:
    """Fills digest of every element, children first."""
    order, todo = [], [root]
    while todo:
        e = todo.pop()
        order.append(e)
        todo += [c for c in e.children if isinstance(c, Element)]
    for e in reversed(order):
        h = xxhash.xxh3_64(f"<{e.name} {' '.join(e.attrs.split())}>")
        for c in e.children:
            h.update(c.digest.to_bytes(8, "little", signed=True) if isinstance(c, Element) else " ".join(c.split()))
        e.digest = h.intdigest() - (1 << 63)


def candidates(root: Element) -> Iterator[Element]:
    """Elements that may be template: outside article and main all but the page's own frame, inside them containers."""
    todo = [(root, False)]
    while todo:
        e, in_root = todo.pop()
        for c in e.children:
            if isinstance(c, Element):
                if c.children and (c.name in CONTAINERS if in_root else c.name not in ("html", "body", "head", *ROOTS)):
                    yield c
                todo.append((c, in_root or c.name in ROOTS))


def content_key(root: Element) -> int:
    """A hash of the page's longest run of text, in its article or main element and in a paragraph where there are such: copies of an article share it."""
    best: tuple = (False, False, 0, "")
    todo: list[tuple[Element, bool, bool]] = [(root, False, False)]
    while todo:
        e, in_root, in_p = todo.pop()
        if e.name in RAW:
            continue
        for c in e.children:
            if isinstance(c, Element):
                todo.append((c, in_root or c.name in ROOTS, c.name == "p" or in_p and c.name in INLINE))
            elif (in_root, in_p, len(c)) >= best[:3]:
                run = " ".join(c.split())
                best = max(best, (in_root, in_p and bool(run), len(run), run))
    return xxhash.xxh3_64_intdigest(best[3]) - (1 << 63)


def article_text(root: Element, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The text of the page's roots, or of all of it where it has none, in page order."""
    roots: list[Element] = []
    todo = [root]
    while todo:  # outermost article elements, else main elements
        e = todo.pop()
        if e.name in ROOTS:
            roots.append(e)
        elif not furniture(e, False) and e.digest not in template:
            todo += [c for c in reversed(e.children) if isinstance(c, Element)]
    in_root = bool(roots)
    out: list[str] = []
    walk: list = [*reversed(roots)] if in_root else [root]
    while walk:
        x = walk.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if furniture(x, in_root) or x.digest in template and x.name not in ROOTS and (not in_root or x.name in CONTAINERS):
            out.append(" ")
            continue
        if x.name not in INLINE:
            out.append(" ")
            walk.append(" ")
        walk += reversed([unescape(c) if isinstance(c, str) and "&" in c else c for c in x.children])
    return " ".join("".join(out).split())


@dataclass(frozen=True)
class Params:
    """A subtree is template on a host if it is there with min_pages different contents at least and with this share of them.

    most bounds the template hashes that are broadcast; beyond it the pages are joined with their host's by a merge join.
    """

    min_pages: int = 8
    share: float = 0.05
    most: int = 500_000


def _subtrees():
    schema = pa.schema([("host", pa.string()), ("digest", pa.int64()), ("content", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: set[tuple] = set()
            for host, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                root = parse(x.as_py() or "")
                hash_subtrees(root)
                content = content_key(root)
                rows.add((host, None, content))
                rows.update((host, e.digest, content) for e in candidates(root))
            cols = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    return run


def templates(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """(host, digests) of the subtrees that recur; pages: host, html. A host has 1 / share times as many as a page has subtrees at most."""
    seen = pages.select("host", "html").mapInArrow(_subtrees(), "host string, digest long, content long").distinct()
    counted = written(seen.groupBy("host", "digest").agg(F.count("*").alias("n")).where((F.col("n") >= p.min_pages) | F.col("digest").isNull()))
    total = counted.where("digest is null").select("host", F.col("n").alias("contents"))
    often = counted.where("digest is not null").join(total, "host").where(F.col("n") >= p.share * F.col("contents"))
    return often.groupBy("host").agg(F.collect_list("digest").alias("digests"))


def extract(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """pages (all its columns) with h_host and h_text.

    A null or empty html has an empty text; a null url has the empty host;
    repeated rows are taken row by row (and count once for templates); an empty
    table gives no rows; columns of pages named h_host and h_text are replaced,
    any other name is free.
    """
    names = [c for c in pages.columns if c.lower() not in ("h_host", "h_text")]
    rows = pages.select(F.struct(*names).alias("row"), host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))
    known = written(templates(rows, p))
    size = known.agg(F.sum(F.size("digests")), F.count("*")).first()
    few = (size[0] or 0) + size[1] <= p.most

    @F.pandas_udf("string")
    def text_of(htmls, digests):
        import pandas as pd

        out = []
        for html, template in zip(htmls, digests):
            root = parse(html or "")
            found = frozenset(template) if template is not None else frozenset()
            if found:
                hash_subtrees(root)
            out.append(article_text(root, found))
        return pd.Series(out, dtype=object)

    joined = rows.join(F.broadcast(known) if few else known.hint("merge"), "host", "left")
    return joined.select("row.*", F.col("host").alias("h_host"), text_of("html", "digests").alias("h_text"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; edge rows as in extract()."""
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("h_text").alias("text"), F.length("h_text").cast("long").alias("n_chars"))
