"""Main text of web pages by site template removal."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusreview.llm import common

#: A subtree belongs to the site's template if it stands on this many pages of a host and on this share of them.
MIN_PAGES = 4
SHARE = 0.1
#: The share for text blocks, and for anything inside the page's own article.
TEXT_SHARE = 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|noscript|iframe|noembed|noframes|xmp|template"
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
TEXT_BLOCKS = frozenset("blockquote dd dt h1 h2 h3 h4 h5 h6 li p pre td th figcaption".split())
#: An opening tag closes an open element of the second group, up to the nearest element of the third.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
MAIN = frozenset(["article", "main"])
#: Elements, words of class and id, and roles that are not part of an article.
ASIDE_TAGS = frozenset(
    "head nav footer aside form script style noscript template iframe svg canvas button select input textarea dialog menu "
    "noembed noframes xmp title object audio video map datalist".split()
)
ASIDE_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted "
    "banner masthead nav navbar navigation menu menubar topbar breadcrumb breadcrumbs pagination pager sidebar sidenav rail "
    "footer colophon copyright cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations teaser "
    "teasers widget widgets toolbar search comment comments commentlist respond reply replies discussion disqus responses".split()
)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar status".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)|<[!?][^>]*+>|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*+)",
    re.I | re.S,
)
#: What may end a tag, or open a value in which it does not end.
_STOP = re.compile(r">|=\s*+([\"'])")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
_CUT_OFF = re.compile(r"<[a-z/!?]", re.I)
_WORDS = re.compile(r"[a-z]+")


class Node:
    """An element: its children (elements and decoded texts), whether it is left out, and a digest once it is closed."""

    __slots__ = ("tag", "kids", "aside", "named", "digest", "size")

    def __init__(self, tag: str, rest: str, inside: bool):
        self.tag, self.kids, self.digest, self.size = tag, [], 0, 0
        names: list[str] = []
        roles: set[str] = set()
        if "=" in rest:
            for name, *values in _ATTRIBUTE.findall(rest):
                value = next((v for v in values if v), "").lower()
                if name.lower() == "role":
                    roles.update(value.split())
                else:
                    names.append(value)
        self.named = " ".join(names)
        words = set(_WORDS.findall(self.named)) if names else set()
        # an article's own header holds its headline
        headed = not inside and (tag == "header" or "header" in words)
        self.aside = tag in ASIDE_TAGS or headed or (tag not in ("html", "body") and bool(words & ASIDE_WORDS or roles & ASIDE_ROLES))

    def close(self) -> None:
        """Digest of the subtree: tag, class and id, texts and the digests of the children."""
        parts = [self.tag, self.named]
        for kid in self.kids:
            if isinstance(kid, Node):
                parts.append(f"<{kid.digest}>")
                self.size += kid.size
            else:
                text = " ".join(kid.split())
                parts.append(text)
                self.size += len(text)
        self.digest = xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) >> 1


def _tag_end(page: str, start: int, unclosed: dict[str, int]) -> int:
    """Place of the ">" that ends the tag whose name ends at ``start``, after all quoted values, however long they are.

    If a value is never closed, the first ">" ends the tag; -1 if there is none.  ``unclosed`` remembers from where on a kind of
    quote does not occur, so that the page is not searched again for it.
    """
    at = start
    while True:
        stop = _STOP.search(page, at)
        if stop is None:
            break
        quote = stop[1]
        if quote is None:
            return stop.start()
        close = -1 if stop.end() >= unclosed.get(quote, len(page)) else page.find(quote, stop.end())
        if close < 0:
            unclosed[quote] = min(unclosed.get(quote, len(page)), stop.end())
            break
        at = close + 1
    return page.find(">", start)


def _tokens(page: str, last: int) -> Iterator[tuple[re.Match, str, int]]:
    """Comments, raw elements and tags before ``last``, each with the attributes of a tag and its end."""
    at = 0
    unclosed: dict[str, int] = {}
    while True:
        token = _TOKEN.search(page, at, last)
        if token is None:
            return
        at = token.end()
        rest = ""
        if token["tag"]:
            stop = _tag_end(page, at, unclosed)
            if stop < 0:
                return
            rest, at = page[at:stop], stop + 1
        yield token, rest, at


def parse(page: str) -> Node:
    """The element tree of a page, lenient as browsers are: open elements end where their parents end."""
    root = Node("html", "", False)
    stack = [root]
    opened: Counter[str] = Counter()
    mains = 0
    at = 0

    def end(depth: int) -> None:
        nonlocal mains
        while len(stack) > depth:
            node = stack.pop()
            mains -= node.tag in MAIN
            opened[node.tag] -= 1
            node.close()

    def text(upto: int) -> None:
        if upto > at:
            stack[-1].kids.append(html.unescape(page[at:upto]))

    # behind the last ">" there is text only, up to a tag that the page's end cuts off
    last = page.rfind(">") + 1
    cut = _CUT_OFF.search(page, last)
    page = page[: cut.start()] if cut else page
    for token, rest, stop in _tokens(page, last):
        text(token.start())
        at = stop
        name = token["tag"]
        if name is None:
            raw = token["raw"]
            if raw and not re.search(rf"</{raw}\s*+>\Z", token[0], re.I) or token[0].startswith("<!--") and not token[0].endswith("-->"):
                at = len(page)  # never closed
            continue
        tag = name.lower()
        if token["close"]:
            for depth in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[depth].tag == tag:
                    end(depth)
                    break
                if tag not in BLOCKS and stack[depth].tag in BLOCKS:
                    break  # an inline end tag does not end a block
            continue
        if tag in ("html", "body"):
            continue
        if tag in BLOCKS:
            closes, within = IMPLIED.get(tag, ((), MAIN))
            for depth in range(len(stack) - 1, 0, -1):
                other = stack[depth].tag
                if other == "p" or other in closes:
                    end(depth)
                    if other != "p":
                        break
                elif other in within or (other in BLOCKS and not closes):
                    break
        node = Node(tag, rest, mains > 0)
        stack[-1].kids.append(node)
        if tag not in VOID and not rest.rstrip().endswith("/"):
            stack.append(node)
            opened[tag] += 1
            mains += tag in MAIN
        else:
            node.close()
    text(len(page))
    end(0)
    return root


def _walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """All elements that are not inside one that is left out, with whether they are inside an article, in page order."""
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        yield node, inside
        if not node.aside:
            inside = inside or node.tag in MAIN
            todo.extend((kid, inside) for kid in reversed(node.kids) if isinstance(kid, Node))


def has_article(root: Node) -> bool:
    return any(node.tag in MAIN and not node.aside for node, _ in _walk(root))


def _code(node: Node, inside: bool) -> tuple[int, bool] | None:
    """The digest of a block subtree with a bit that says whether it is strict, and that bit; None if it is never template."""
    if node.tag not in BLOCKS or node.tag in MAIN or (inside and (not node.named or node.tag in TEXT_BLOCKS)):
        return None
    strict = inside or node.tag in TEXT_BLOCKS
    return node.digest & ~1 | strict, strict


def subtrees(root: Node) -> set[tuple[int, bool, bool]]:
    """``code, strict, matters`` of the block subtrees with text.

    ``strict`` ones need the higher share; inside an article only named containers are taken, so its paragraphs are never
    counted.  Only those that matter can change the page's text.
    """
    article = has_article(root)
    found = set()
    for node, inside in _walk(root):
        code = _code(node, inside) if node.size and node is not root else None
        if code:
            found.add((*code, not node.aside and (inside or not article)))
    return found


def main_text(root: Node, template: frozenset[int] = frozenset()) -> str:
    """The texts of the article, or of the page if it has none, without what is left out and without the codes of the template."""
    article = has_article(root)
    parts: list[str] = []
    todo: list[tuple[object, bool]] = [(root, not article)]
    while todo:
        item, taken = todo.pop()
        if isinstance(item, Node):
            code = _code(item, article and taken) if template and item is not root else None
            if item.aside or (code and code[0] in template):
                parts.append(" ")
                continue
            taken = taken or item.tag in MAIN
            breaks = item.tag in BLOCKS or item.tag == "br"
            if breaks:
                todo.append((" ", True))
            todo.extend((kid, taken) for kid in reversed(item.kids))
            if breaks:
                parts.append(" ")
        elif taken:
            parts.append(item)
    return " ".join("".join(parts).split())


def _subtree_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in common.text_chunks(batches, "html"):
        hosts, digests, strict, matters = [], [], [], []
        for host, page in zip(*(piece.column(c).to_pylist() for c in ("host", "html"))):
            found = sorted(subtrees(parse(page or "")))
            hosts += [host] * len(found)
            digests += [f[0] for f in found]
            strict += [f[1] for f in found]
            matters += [f[2] for f in found]
        yield pa.record_batch(
            {
                "host": pa.array(hosts, pa.string()),
                "digest": pa.array(digests, pa.int64()),
                "strict": pa.array(strict, pa.bool_()),
                "matters": pa.array(matters, pa.bool_()),
            }
        )


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in common.text_chunks(batches, "html"):
        texts = [
            main_text(parse(page or ""), frozenset(template or ()))
            for page, template in zip(piece.column("html").to_pylist(), piece.column("template").to_pylist())
        ]
        yield pa.record_batch(
            {
                "page_id": piece.column("page_id"),
                "url": piece.column("url"),
                "text": pa.array(texts, pa.string()),
                "n_chars": pa.array(np.fromiter(map(len, texts), np.int64, len(texts))),
            }
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of every page.

    Pages become element trees.  The digest of every block subtree is counted per host over all pages, and subtrees that
    recur on many pages of their host are deleted; an article's own paragraphs are never counted.  Elements that say by tag,
    class, id or role that they are menus, headers, footers, sidebars, notices, adverts, forms or reader comments go on any
    host, however few pages it has.  If a page has articles, only their text is taken.

    A null or empty page has the empty text.  Pages without a host (null or odd urls) count as one host.  Repeated rows give
    repeated results; they count as pages of their own.  Other columns are ignored.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    hosted = pages.select("page_id", "url", "html", host.alias("host"))
    marks = hosted.select("host", "html").mapInArrow(_subtree_rows, "host string, digest bigint, strict boolean, matters boolean")
    counted = marks.groupBy("host", "digest", "strict").agg(F.count(F.lit(1)).alias("times"), F.max("matters").alias("matters"))
    frequent = common.write_stage(counted.filter(F.col("matters") & (F.col("times") >= MIN_PAGES)), "frequent-subtrees")
    sizes = hosted.select(F.col("host").alias("of_host")).groupBy("of_host").agg(F.count(F.lit(1)).alias("pages"))
    share = F.when(F.col("strict"), TEXT_SHARE).otherwise(SHARE)
    template = frequent.join(sizes, F.col("host") == F.col("of_host")).filter(F.col("times") >= share * F.col("pages"))
    # a row per host: a page holds few subtrees, so few can be on a tenth of a host's pages, however many these are
    template = common.write_stage(template.groupBy(F.col("host").alias("of_host")).agg(F.collect_set("digest").alias("template")), "templates")
    found = hosted.join(template, F.col("host") == F.col("of_host"), "left").select("page_id", "url", "html", "template")
    return found.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(common.table(spark, sf_dir, "pages"))
