"""Main text of web pages, with site templates removed.

1. Every page is parsed into elements. Subtrees are hashed, and counted for each host and each section of a host (first
   folder of the path): those outside the page's article over pages of different content, containers inside it over
   articles of different content.
2. Subtrees that recur on many pages of a host or section are its template. Prose that sites repeat is no template:
   paragraphs, headings and list items must be on a large share of the pages, and inside the article they never are, nor
   is anything that a quotation holds.
3. The article of each page is read without template subtrees and without elements that are no article text by name,
   role or class (what differs from page to page, such as readers' comments, no count can find).
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, stash

#: A subtree is a template if at least so many different pages of the host, and this share of them, have it.
LEAST_PAGES, LEAST_SHARE = 8, 0.2
#: The same for containers outside the article, which hold menus, notices and the like.
OUTSIDE_PAGES, OUTSIDE_SHARE = 5, 0.01
#: Bytes of template lists that may be broadcast; more are joined.
BROADCAST_BYTES = 16 << 20

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript noembed noframes iframe xmp template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split())
NOT_TEXT = frozenset("head nav footer aside form button select dialog menu svg canvas audio video object math search script style title textarea noscript noembed noframes iframe xmp template".split())
CLOSES_P = BLOCK - {"body", "html", "option", "optgroup", "legend", "tbody", "tfoot", "thead", "tr"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table div section article main body html td th blockquote aside nav form".split())
WHOLE = frozenset("html body main".split())  # their classes tell what the page has, such as has-sidebar
CONTAINERS = frozenset("address center details dir div dl fieldset figure header hgroup ol section table ul".split())  # may be templates inside an article
QUOTES = frozenset("blockquote pre".split())
PROSE = BLOCK - CONTAINERS - frozenset("article aside body footer form html main menu nav search tbody tfoot thead tr".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
_WORD = (
    r"(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|banner|cookie|cookies|consent|gdpr|notice|notices|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|"
    r"sidebar|footer|masthead|comment|comments|respond|disqus|share|sharing|social|related|newsletter|subscribe|popup|modal|login|signup|widget|pagination)")
#: A whole class or id: a word, or words joined with each other or with a word for the kind of box.
AWAY = re.compile(rf"(?:^|\s){_WORD}(?:[_-](?:{_WORD}|area|bar|box|buttons|form|icons|links|list|posts))*(?=$|\s)")
READERS = re.compile(r"(?:^|\s)(?:comment|comments|disqus|respond)(?=$|[\s_-])")

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
PLAIN = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
FOLDER = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)/"


class Element:
    __slots__ = ("tag", "away", "by_class", "readers", "main", "holds", "parts")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.parts = tag, []
        self.main, self.holds = tag in ("article", "main"), False  # holds: is or contains one that is not away
        self.away = tag in NOT_TEXT
        self.by_class = self.readers = False  # whether it is no article text by class, and that as readers' comments
        if attributes:
            a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
            role = a.get("role", "").lower()
            self.main = self.main or role == "main"
            self.away = self.away or role in ROLES or "hidden" in a
            if tag not in WHOLE and role != "main":
                names = f"{a.get('class', '')} {a.get('id', '')}".lower()
                self.by_class = bool(AWAY.search(names))
                self.readers = self.by_class and bool(READERS.search(names))


def tree(page: str) -> Element:
    """The elements of a page, each with its text and elements in order; missing end tags are put where HTML puts them."""
    root = _elements(page)
    _decide(root)
    return root


class Scanner:
    """Splits a page into text and tags, each character looked at once."""

    def __init__(self, page: str):
        self.page, self.last_end = page, page.rfind(">")
        self.quoted = {q: page.rfind(q) for q in "\"'"}

    def _end(self, at: int) -> int:
        """Where the tag with attributes from `at` on ends, -1 if it doesn't; a quote that is never closed is an ordinary character."""
        while True:
            at = PLAIN.match(self.page, at).end()
            if at >= len(self.page):
                return -1
            if self.page[at] == ">":
                return at
            quote = self.page[at]
            at = self.page.index(quote, at + 1) + 1 if self.quoted[quote] > at else at + 1

    def next(self, at: int) -> tuple[int, int, str, str, str]:
        """(end of the text before, where to go on, slash, name, attributes) of the next tag or comment; a comment has no name.

        At the end of the page, or where no tag ends any more, the text goes to the end.
        """
        page, size = self.page, len(self.page)
        look = at
        while True:
            start = page.find("<", look)
            if start < 0:
                return size, size, "", "", ""
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, size if end < 0 else end + 3, "", "", ""
            slash = page.startswith("/", start + 1)
            name = NAME.match(page, start + 1 + slash)
            if name is None:
                if slash or page[start + 1:start + 2] in ("!", "?"):
                    end = page.find(">", start)
                    return start, size if end < 0 else end + 1, "", "", ""
                look = start + 1
                continue
            if name.end() > self.last_end:  # nothing ends here any more, but a comment may begin
                end = page.find("<!--", start)
                return (size if end < 0 else end), size, "", "", ""
            end = self._end(name.end())
            if end < 0:
                return size, size, "", "", ""
            return start, end + 1, "/" if slash else "", name[0], page[name.end():end]


def _elements(page: str) -> Element:
    root = Element("#root")
    scanner = Scanner(page)
    stack, at = [root], 0
    places: dict[str, list[int]] = {}  # of each open tag in the stack
    scopes = [0]

    def cut(i: int) -> None:
        for e in stack[:i - 1:-1]:
            places[e.tag].pop()
            if e.tag in SCOPE:
                scopes.pop()
        del stack[i:]

    while at < len(page):
        upto, after, slash, name, attributes = scanner.next(at)
        text = page[at:upto]
        if text:
            stack[-1].parts.append(html.unescape(text) if "&" in text else text)
        at = after
        if not name:
            continue
        tag = name.lower()
        if slash:
            if places.get(tag):
                cut(places[tag][-1])
            continue
        if tag in CLOSES_P or tag in SIBLINGS:
            ends = SIBLINGS.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            if tag[0] == "h" and tag[1:].isdigit():
                ends = ends | {"h1", "h2", "h3", "h4", "h5", "h6"}
            last = max((places[t][-1] for t in ends if places.get(t)), default=0)
            if last and last >= scopes[-1]:
                cut(last)
        element = Element(tag, attributes)
        stack[-1].parts.append(element)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            close = page.find(">", end.end() - 1) if end else -1
            at = close + 1 if close >= 0 else len(page)
        elif tag not in VOID and not attributes.endswith("/"):
            places.setdefault(tag, []).append(len(stack))
            if tag in SCOPE:
                scopes.append(len(stack))
            stack.append(element)
    return root


def _decide(root: Element) -> None:
    """Sets away where the class says so. A class never discards an element that is or contains an article or main.

    Only readers' comments go with the articles they are put in, if the page has an article besides them.
    """
    order: list[tuple[Element, Element | None, bool]] = []
    stack: list[tuple[Element, Element | None, bool]] = [(root, None, False)]
    while stack:
        e, above, readers = stack.pop()
        if e.away:
            continue
        readers = readers or e.readers
        order.append((e, above, readers))
        stack += [(x, e, readers) for x in e.parts if isinstance(x, Element)]
    for e, above, _ in reversed(order):
        e.holds = e.holds or e.main
        if e.holds and above is not None:
            above.holds = True
    besides = any(e.tag == "article" and not readers for e, _, readers in order)
    for e, _, _ in order:
        e.away = e.by_class and (not e.holds or (e.readers and besides))


def _main_parts(root: Element) -> list[Element]:
    """The outermost articles and main elements that are not away, in page order; the whole page if there are none."""
    found: list[Element] = []
    stack = [root]
    while stack:
        e = stack.pop()
        if e.away:
            continue
        if e.main:
            found.append(e)
            continue
        stack += [x for x in reversed(e.parts) if isinstance(x, Element)]
    return found or [root]


def _hash(top: Element, main: set[int], into: dict[int, bytes], kinds: frozenset[str] = BLOCK, person: bytes = b"") -> bytes:
    """A hash of the subtree: names, and text with white space as one space. into: gets those of kinds outside main (ids) and quotations by id."""
    start = lambda e: (e, iter(e.parts), hashlib.blake2b(e.tag.encode("utf-8", "replace"), digest_size=8, person=person))
    stack = [start(top)]
    quotes = int(bool(person) and top.tag in QUOTES)
    while True:
        e, parts, h = stack[-1]
        for x in parts:
            if not isinstance(x, Element):
                h.update(b"\0" + " ".join(x.split()).encode("utf-8", "replace"))
            elif id(x) not in main:
                quotes += bool(person) and x.tag in QUOTES
                stack.append(start(x))
                break
        else:
            stack.pop()
            if not quotes and e.tag in kinds and not (person and e.holds):
                into[id(e)] = h.digest()
            quotes -= bool(person) and e.tag in QUOTES
            if not stack:
                return h.digest()
            stack[-1][2].update(b"\1" + h.digest())


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "little", signed=True)


def _all(root: Element) -> Iterator[Element]:
    stack = [root]
    while stack:
        e = stack.pop()
        yield e
        stack += [x for x in e.parts if isinstance(x, Element)]


def subtrees(root: Element) -> tuple[dict[int, int], dict[int, int], int]:
    """Hashes by id of the element, and a hash of the article.

    First those of the block elements outside the page's article, or without one of all blocks; then those of the
    containers inside the article, which differ from the hashes of the same elements outside.
    """
    main = _main_parts(root)
    outside: dict[int, bytes] = {}
    inside: dict[int, bytes] = {}
    whole = hashlib.blake2b(digest_size=8)
    if main[0] is root:
        main = []
    _hash(root, {id(e) for e in main}, outside)
    for e in main:
        whole.update(_hash(e, set(), inside, CONTAINERS, b"inside"))
        inside.pop(id(e), None)
    return {k: _number(v) for k, v in outside.items()}, {k: _number(v) for k, v in inside.items()}, _number(whole.digest())


def main_text(root: Element, template: frozenset[int] = frozenset()) -> str:
    """The blocks of the page's article, one a line."""
    main = _main_parts(root)
    hashes: dict[int, int] = {}
    if template:
        outside, inside, _ = subtrees(root)
        hashes = outside | inside
    blocks: list[str] = []
    line: list[str] = []

    def flush():
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    for top in main:
        inside, stack = top is not root, [(top, iter(top.parts))]
        while stack:
            e, parts = stack[-1]
            for x in parts:
                if not isinstance(x, Element):
                    line.append(x)
                    continue
                if x.tag in BLOCK:
                    flush()
                if x.away or (not inside and x.tag == "header") or (template and hashes.get(id(x)) in template):
                    continue
                if x.tag in ("br", "td", "th"):
                    line.append(" ")
                stack.append((x, iter(x.parts)))
                break
            else:
                stack.pop()
                if stack and e.tag in BLOCK:
                    flush()
        flush()
    return "\n".join(blocks)


def subtree_pages(pages: DataFrame) -> DataFrame:
    """(site, inside, subtree, prose, pages): on how many different pages or articles of a site a subtree is, from rows (host, section, html).

    Subtree 0 stands for the page or article itself. prose tells whether the element is one of PROSE.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for host, section, page in zip(b.column("host").to_pylist(), b.column("section").to_pylist(), b.column("html").to_pylist(), strict=True):
                digest = _number(hashlib.blake2b(page.encode("utf-8", "replace"), digest_size=8).digest())
                root = tree(page)
                outside, inside, article = subtrees(root)
                prose = {id(e) for e in _all(root) if e.tag in PROSE}
                for kind, found, content in ((False, outside, digest), (True, inside, article)):
                    own = {(0, False)} | {(h, k in prose) for k, h in found.items()}
                    rows += [(host, section, kind, h, p, content) for h, p in own]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["host", "section", "inside", "subtree", "prose", "page"])

    kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
    seen = pages.mapInArrow(run, "host string, section string, inside boolean, subtree long, prose boolean, page long")
    seen = seen.select(F.explode(F.array("host", "section")).alias("site"), "inside", "subtree", "prose", "page").distinct()
    return seen.groupBy("site", "inside", "subtree", "prose").agg(F.count("*").alias("pages"))


def templates(pages: DataFrame, least_pages: int, least_share: float) -> DataFrame:
    """(site, template): the subtrees that recur on a host or section, from rows (host, section, html).

    Prose and all inside articles must be on least_pages pages and least_share of them, containers outside on OUTSIDE_PAGES
    and OUTSIDE_SHARE, if these are less. A site's list is short whatever its size: a page has few subtrees, and each
    listed one is on a share of its pages.
    """
    loose = ~F.col("inside") & ~F.col("prose")
    few, some = (F.when(loose, min(x, y)).otherwise(y) for x, y in ((OUTSIDE_PAGES, least_pages), (OUTSIDE_SHARE, least_share)))
    counts = stash(subtree_pages(pages).where((F.col("pages") >= few) | (F.col("subtree") == 0)), "subtrees")
    whole = counts.where("subtree = 0").select("site", "inside", F.col("pages").alias("all"))
    often = counts.where("subtree <> 0").join(whole, ["site", "inside"]).where(F.col("pages") >= some * F.col("all"))
    return stash(often.groupBy("site").agg(F.collect_set("subtree").alias("template")), "templates")


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    text has the blocks of all outermost main and article elements in page order, one a line, with white space inside a
    block as one space; it is empty where nothing is left or html is null. A page without article or main element is read as a whole. Pages
    with null or odd urls share one host. Copies of a page, and inside it of an article, count once when subtrees are
    counted. Repeated rows each give theirs; empty input gives an empty result; other columns are not read.
    """
    bound_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), HOST, 1))
    section = F.concat(host, F.lit("/"), F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), FOLDER, 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), host.alias("host"), section.alias("section"))
    found = templates(rows.select("host", "section", "html"), least_pages, least_share)
    for key, is_section in (("host", False), ("section", True)):
        of = found.where(F.col("site").contains("/") == is_section).select(F.col("site").alias(key), F.col("template").alias(f"{key}_template"))
        size = of.agg(F.sum(F.size(f"{key}_template") * 8 + F.octet_length(key) + 32)).first()[0] or 0
        rows = rows.join(F.broadcast(of) if size <= BROADCAST_BYTES else of, key, "left")
    none = F.array().cast("array<bigint>")
    joined = rows.select("page_id", "url", "html", F.array_union(F.coalesce("host_template", none), F.coalesce("section_template", none)).alias("template"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(tree(page), frozenset(t.as_py() or ())) for page, t in zip(b.column("html").to_pylist(), b.column("template"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
