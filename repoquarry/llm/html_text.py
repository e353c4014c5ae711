"""Main text of web pages, by the style trees of their sites.

The pages of a host are merged into one tree of styles: an element is known by its path of
tags and classes. For each path two entropies are taken over the host's different pages:
of presentation (which children the element has) and of content (its text). A branch that
looks and reads alike on most pages carries no information about any of them: its
importance, the weighted sum of both, is low, and it is removed from every page. Elements
whose tag, role, class or id names their purpose (menus, adverts, forms ...) have importance
zero from the start; a class or id does so as a whole, not by a piece of it. No name, and no
number of copies of a page, removes what holds the article; equal articles count once.

The text is that of the article elements; without any, of the main element; without it, of
the body. Character references are decoded, white space becomes one space, and blocks are
joined by one line feed.

Defined cases: null and empty pages give an empty text; text without markup is returned as
one block. Null URLs, and those without a host, are one site. Pages that break off end all
open elements. Repeated rows get equal answers, an empty table an empty result; other
columns are not read.

A page is only text and hashes of its branches until the entropies are known; the branches
that go are joined to their host's pages. A path counts only if a tenth of the host's pages
have it, so their number is bounded by a page's size, not by the host's.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.llm.common import slices

from repoquarry.llm.url_filter import host_of
from repoquarry.session import materialise

MIN_PAGES = 8  # of one host, before its tree says anything
MIN_SHARE = 0.1  # of the host's pages
PRESENTATION = 0.25  # weight of presentation in the importance
LEAST = 0.3  # importance below which a branch goes

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(
    r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I
)
_RAW = {t: re.compile(rf"</{t}[\s/>]|\Z", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")}

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt"
    " fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend"
    " li main menu nav ol option p pre section summary table tbody tfoot thead title tr ul".split()
)
_SPACED = frozenset("br td th".split())
_ENDS_P = _BLOCKS - frozenset("caption dd dt head html body legend li option tbody tfoot thead title tr".split())
# An opening tag ends an open element of its kind, up to the container named.
_SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_GONE_TAGS = frozenset(
    "nav footer aside form script style noscript template iframe svg button select textarea"
    " dialog head title menu object canvas audio video map datalist".split()
)
_GONE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert form menu"
    " menubar toolbar".split()
)
_GONE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion"
    " nav navbar navigation menu menus breadcrumb breadcrumbs sidebar footer cookie cookies"
    " consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup"
    " share sharing social related recommended comment comments commentlist disqus respond"
    " reply replies widget widgets toolbar login search pagination pager copyright legal"
    " disclaimer skip".split()
)
# What a class attribute of an article has to be for it not to be the article.
_NOT_ARTICLES = frozenset(
    "comment comments reply replies related recommended sponsored promo advert ad ads card teaser".split()
)
_OUTSIDE_NAMES = frozenset("header masthead banner topbar".split())  # not inside an article
# Words that do not change what a name says: "nav-bar" is a menu, "has-sidebar" is no sidebar.
_NEUTRAL = frozenset(
    "area bar block bottom box button buttons container form global icon icons inner item items"
    " left link links list main outer panel primary right secondary section site top unit"
    " wrap wrapper".split()
)
_TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
_TREE_TAGS = frozenset("div section ul ol dl table figure header main details center fieldset".split())


@dataclass
class Element:
    tag: str
    label: str
    path: int
    parent: int
    ends: bool  # goes with all below it, by its tag or role
    named: bool  # goes by its name, if it does not hold the article
    first: int  # the first text run inside
    last: int = -1
    gone: bool = False
    holds: bool = False  # is an article, or the main element
    rooted: bool = False  # an article is inside
    in_article: bool = False
    children: list[str] = field(default_factory=list)


def _names(rest: str) -> tuple[list[str], str]:
    words: list[str] = []
    role = ""
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        value = (a or b or c).lower()
        if name.lower() == "role":
            role = value.strip()
        else:
            words += re.split(r"[^a-z]+", value)
    return [w for w in words if w], role


def _values(rest: str, wanted: str) -> list[str]:
    return [w for name, a, b, c in _ATTRIBUTE.findall(rest) if name.lower() == wanted
            for w in (a or b or c).lower().split()]


def _classes(rest: str) -> list[str]:
    return _values(rest, "class")


def _ids(rest: str) -> list[str]:
    return _values(rest, "id")


def _says(name: str, words: frozenset[str], neutral: frozenset[str] = _NEUTRAL) -> bool:
    """Whether a whole class or id is made of these words and neutral ones."""
    parts = [p for p in re.split(r"[^a-z]+", name) if p]
    return any(p in words for p in parts) and all(p in words or p in neutral for p in parts)


def _named(tag: str, rest: str, inside: bool) -> bool:
    """Whether class or id name a purpose. Headings and paragraphs are not named by an id, nor
    by a class inside an article."""
    names = _classes(rest)
    if tag in ("article", "main"):
        return any(w in _NOT_ARTICLES for w in names)
    if tag in _TEXT_TAGS:
        names = [] if inside else names
    else:
        names = names + _ids(rest)
    return any(
        _says(w, _GONE_NAMES) or (not inside and _says(w, _OUTSIDE_NAMES, _NEUTRAL | {"page"}))
        for w in names
    )


class Page:
    """The elements and text runs of a page. A run is (element, text); text None is the
    border of a block."""

    def __init__(self, source: str):
        self.elements = [Element("", "", 0, -1, False, False, 0)]
        self.runs: list[tuple[int, str | None]] = []
        self.stack = [0]
        at, size = 0, len(source)
        while at < size:
            found = _TOKEN.search(source, at)
            stop = found.start() if found else size
            if stop > at:
                self.runs.append((self.stack[-1], source[at:stop]))
            if not found:
                break
            at = found.end()
            tag = found.group(2)
            if tag is None:
                continue
            tag = tag.lower()
            if found.group(1):
                self._close(tag)
                continue
            self._open(tag, found.group(3) or "")
            if tag in _RAW:
                end = _RAW[tag].search(source, at)
                at = end.start() if end else size
                self._close(tag)
        while len(self.stack) > 1:
            self._pop()
        self.elements[0].last = len(self.runs)
        self._settle()

    def _settle(self) -> None:
        """What goes, now that it is known what holds an article. Inside an article, names
        decide whatever the element holds."""
        shut = [False]
        for e in self.elements[1:]:
            above = self.elements[e.parent]
            final = e.named and (above.in_article or e.tag in ("article", "main"))
            shut.append(shut[e.parent] or e.ends or final)
        for number, e in enumerate(self.elements):
            while e.holds and not shut[number] and not self.elements[number].rooted:
                self.elements[number].rooted = True
                number = max(0, self.elements[number].parent)
        for e in self.elements[1:]:
            e.gone = self.elements[e.parent].gone or e.ends or (e.named and not e.rooted)

    def _pop(self) -> None:
        number = self.stack.pop()
        element = self.elements[number]
        element.last = len(self.runs)
        if element.tag in _BLOCKS:
            self.runs.append((self.stack[-1], None))

    def _pop_to(self, tags, walls) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.elements[self.stack[depth]].tag
            if tag in tags:
                while len(self.stack) > depth:
                    self._pop()
                return
            if tag in walls:
                return

    def _close(self, tag: str) -> None:
        if tag == "p":
            self.runs.append((self.stack[-1], None))  # also without an open paragraph
        self._pop_to((tag,), () if tag in ("article", "body", "html", "main") else ("article",))

    def _open(self, tag: str, rest: str) -> None:
        if tag in _ENDS_P:
            self._pop_to(("p",), ("article", "div", "td", "li", "section", "table", "button"))
        if tag in _SIBLINGS:
            self._pop_to(*_SIBLINGS[tag])
        parent = self.stack[-1]
        above = self.elements[parent]
        if tag in _BLOCKS:
            self.runs.append((parent, None))
        elif tag in _SPACED:
            self.runs.append((parent, " "))
        if tag in _VOID:
            return
        words, role = _names(rest) if "=" in rest else ([], "")
        inside = above.in_article or tag == "article"
        ends = tag in _GONE_TAGS or role in _GONE_ROLES or (not inside and tag == "header")
        named = "=" in rest and _named(tag, rest, inside)
        if tag in ("html", "body"):
            ends = named = False
        label = f"{tag}.{'.'.join(words)}" if words else tag
        path = xxhash.xxh64_intdigest(label, above.path)
        above.children.append(label)
        self.elements.append(Element(tag, label, path, parent, ends, named, len(self.runs)))
        number = len(self.elements) - 1
        self.elements[number].in_article = inside
        self.stack.append(number)
        self.elements[number].holds = tag in ("article", "main") or role == "main"

    def _roots(self) -> list[Element]:
        stays = [e for e in self.elements[1:] if not e.gone]
        articles = [e for e in stays if e.tag == "article"]
        if articles:
            return articles
        main = [e for e in stays if e.rooted and e.tag not in ("html", "body")]
        body = [e for e in stays if e.tag == "body"]
        return main or body or self.elements[:1]

    def text(self, noise=frozenset()) -> str:
        """The text of the content without branches that go."""
        gone = []
        for e in self.elements:
            low = e.path in noise and _may_go(e)
            gone.append(e.gone or low or (e.parent >= 0 and gone[e.parent]))
        blocks: list[str] = []
        done = 0
        for root in self._roots():
            parts: list[str] = []
            for owner, run in self.runs[max(root.first, done) : root.last]:
                if run is None:
                    blocks.append("".join(parts))
                    parts = []
                elif not gone[owner]:
                    parts.append(html.unescape(run) if "&" in run else run)
            blocks.append("".join(parts))
            done = max(done, root.last)
        return "\n".join(b for b in (" ".join(block.split()) for block in blocks) if b)

    def branches(self) -> Iterator[tuple[int, int, int]]:
        """(path, presentation, content) of the elements that may turn out to be noise."""
        for e in self.elements[1:]:
            if _may_go(e) and not e.gone:
                words = " ".join(
                    run for owner, run in self.runs[e.first : e.last]
                    if run is not None and not self.elements[owner].gone
                ).split()
                if words:
                    look = dict.fromkeys(e.children)
                    yield e.path, xxhash.xxh64_intdigest("|".join(look)), xxhash.xxh64_intdigest(" ".join(words))


def _may_go(e: Element) -> bool:
    """Whether the site's tree may remove an element. Lists and tables of an article that
    carry no name are its text, however often they repeat."""
    return e.tag in _TREE_TAGS and not e.rooted and (not e.in_article or "." in e.label)


def _signed(values: list[int]) -> pa.Array:
    return pa.array([v - (1 << 64) if v >> 63 else v for v in values], pa.int64())


def _branch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        hosts, pages, rows = [], [], []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1)):
            page = Page(source.as_py() or "")
            digest = xxhash.xxh64_intdigest(page.text())
            found = list(page.branches()) or [(0, 0, 0)]  # the page itself counts
            hosts += [host] * len(found)
            pages += [digest] * len(found)
            rows += found
        columns = zip(*rows) if rows else ([], [], [])
        arrays = [pa.array(hosts, pa.string()), _signed(pages), *map(_signed, map(list, columns))]
        yield pa.RecordBatch.from_arrays(arrays, ["_host", "_page", "_path", "_look", "_content"])


def _entropy(seen: DataFrame, what: str, name: str) -> DataFrame:
    """Entropy of a column over the pages of each host and path, from 0 to 1."""
    counts = seen.groupBy("_host", "_path", what).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    m = F.sum("_n")
    bits = F.log2(m) - F.sum(F.col("_n") * F.log2("_n")) / m
    return counts.groupBy("_host", "_path").agg(
        m.alias("_m"), F.when(m > 1, bits / F.log2(m)).otherwise(1.0).alias(name)
    )


def branch_importance(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(_host, _path, _m, importance) of the branches of every site; `_m` counts pages with
    different texts."""
    seen = (
        pages.select(host_of(F.col(url)).alias("_host"), F.col(source).cast("string").alias("_html"))
        .mapInArrow(_branch_rows, "_host string, _page long, _path long, _look long, _content long")
        .distinct()
    )
    seen = materialise(seen, "branches")
    look = _entropy(seen, "_look", "_by_look").drop("_m")
    whole = _entropy(seen, "_content", "_by_content").join(look, ["_host", "_path"])
    importance = F.lit(PRESENTATION) * F.col("_by_look") + F.lit(1 - PRESENTATION) * F.col("_by_content")
    sizes = seen.select("_host", "_page").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    return whole.join(sizes, "_host").select("_host", "_path", "_m", "_pages", importance.alias("importance"))


def _noise(importance: DataFrame) -> DataFrame:
    low = (
        (F.col("importance") < LEAST)
        & (F.col("_m") >= MIN_PAGES)
        & (F.col("_m") >= MIN_SHARE * F.col("_pages"))
        & (F.col("_path") != 0)
    )
    return importance.where(low).groupBy("_host").agg(F.collect_set("_path").alias("_gone"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = []
        for source, gone in zip(batch.column(1), batch.column(2)):
            noise = {p % (1 << 64) for p in gone.as_py()} if gone.is_valid else frozenset()
            texts.append(Page(source.as_py() or "").text(noise))
        arrays = [batch.column(0), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["_row", "text"])


def extract_text(pages: DataFrame, id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row."""
    noise = materialise(_noise(branch_importance(pages, url, source)), "noise")
    noise = noise.withColumnRenamed("_host", "_site")
    keyed = pages.select(
        F.struct(F.col(id).alias("id"), F.col(url).alias("url")).alias("_row"),
        F.col(source).cast("string").alias("_html"),
        host_of(F.col(url)).alias("_host"),
    )
    joined = keyed.join(noise, F.col("_host") == F.col("_site"), "left").select("_row", "_html", "_gone")
    row = joined.schema["_row"].dataType.simpleString()
    found = joined.mapInArrow(_texts, f"_row {row}, text string")
    return found.select(
        F.col("_row.id").alias(id), F.col("_row.url").alias(url), "text",
        F.char_length("text").cast("bigint").alias("n_chars"),
    )
