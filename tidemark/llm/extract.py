"""Main text of web pages: templates deduced from token classes, and the slots they leave."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import free_name, stored
from tidemark.llm.urllists import host

# Tokens form a template class if they share their occurrence vector with another and occur on so many pages, and that share, of a host.
MIN_PAGES = 8
MIN_SHARE = 0.25
# An element whose texts vary is a slot. A text that repeats inside one joins the template only from this share of a host's contents.
SLOT_SHARE = 0.75

# HTML elements by how they are read.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
_ENDS_P = _BLOCK - frozenset("option select head html body title".split())
# An element of the key ends an open one of the values, up to the nearest of the scopes.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol menu dl table select html body div article section main".split())
_P_SCOPE = _SCOPE | {"li", "td", "th", "dd", "blockquote"}
_LI_SCOPE = _SCOPE - {"div"}
_INLINE = frozenset("b i u em strong a span font small big code tt s sub sup".split())
# Never text of a page: what they hold is no markup or not shown.
_RAW = r"script|style|noscript|template|textarea|iframe|svg|math|object|canvas|audio|video"
# Elements, roles and class or id words of what is no article.
_DROPPED = frozenset("nav header footer aside form button select dialog menu head title noscript template label input".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_DROPPED_WORDS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs topbar masthead header footer foot sidebar sidebars aside rail ad ads adv advert adverts "
    "advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login social share sharing related recommended recommendations comment comments commentlist disqus reply replies "
    "respond widget pagination pager toolbar skip".split()
)
_COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
_MAIN_WORDS = frozenset("article content post entry story main maincontent articlebody".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element:
    """An open element: its name, a hash of the path down to it, and whether it is dropped or main text."""

    __slots__ = ("above", "dropped", "main", "name", "path")

    def __init__(self, name: str, above: Element | None, rest: str):
        attributes = {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)} if rest else {}
        marks = f"{attributes.get('class', '')} {attributes.get('id', '')}"
        words = {w.lower() for w in _WORDS.findall(marks)} if marks != " " else set()
        role = attributes.get("role", "").lower()
        self.name = name
        self.above = above.path if above else 0
        self.path = _hash(str(self.above), name, marks if words else "")
        unwanted = _COMMENT_WORDS if name in ("article", "main", "body", "html") else _DROPPED_WORDS
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        self.dropped = bool(above and above.dropped) or name in _DROPPED or role in _DROPPED_ROLES or bool(words & unwanted) or hidden
        # 2: by element, 1: by class; a part of main text is main text.
        own = 2 if name in ("article", "main") or role in ("main", "article") else 1 if words & _MAIN_WORDS and name in _BLOCK else 0
        self.main = max(above.main if above else 0, 0 if name in ("html", "body") else own)


def blocks(page: str | None) -> Iterator[tuple[str, Element]]:
    """The text blocks of a page in order, references decoded and white space made single, with the element they stand in.

    Tags that should end an element do, if they are missing; end tags of what is not open are ignored; text of
    what is cut off counts.
    """
    page = page or ""
    stack = _Stack([Element("", None, "")])
    parts: list[str] = []
    owner = stack[0]
    begun = False

    def flush() -> Iterator[tuple[str, Element]]:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            yield text, owner

    def add(text: str) -> None:
        """More text of the block; the element of its first text owns it."""
        nonlocal owner, begun
        if not parts:
            begun = False
        if not begun:
            owner = stack[-1]
            begun = bool(text) and not text.isspace()
        if text and stack[-1].dropped == owner.dropped:
            parts.append(text)

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        if name == "br":
            add(" ")
            continue
        if name in _BLOCK or (name in _DROPPED and name not in _INLINE):
            yield from flush()
        if m["end"]:
            stack.close({name}, frozenset())
            continue
        if name in _ENDS_P:
            stack.close({"p"}, _P_SCOPE)
        if name in _ENDS:
            stack.close(_ENDS[name], _LI_SCOPE if name == "li" else _SCOPE)
        element = Element(name, stack[-1], m["rest"])
        if name not in _VOID and not m["rest"].endswith("/"):
            if element.dropped != stack[-1].dropped and name not in _BLOCK:
                yield from flush()
            stack.open(element)
    add(page[at:])
    yield from flush()


class _Stack(list):
    """Open elements, and how many of each name, so that tags of what is not open cost nothing."""

    def __init__(self, elements: list[Element]):
        super().__init__(elements)
        self.names: Counter[str] = Counter()

    def open(self, element: Element) -> None:
        self.append(element)
        self.names[element.name] += 1

    def close(self, names: set[str], scopes: frozenset[str]) -> None:
        """End the innermost element of these names, unless one of the scopes is in between."""
        if not any(self.names[n] for n in names):
            return
        for i in range(len(self) - 1, 0, -1):
            if self[i].name in names:
                for element in self[i:]:
                    self.names[element.name] -= 1
                del self[i:]
                return
            if self[i].name in scopes:
                return


def _hash(*parts: str) -> int:
    return int.from_bytes(xxhash.xxh64_digest("\x00".join(parts).encode("utf-8", "surrogatepass")), "big", signed=True)


def page_tokens(page: str | None) -> list[dict]:
    """Different tokens of a page with their counts: each text block in its place, and each element, by path, that holds a block."""
    return _content_and_tokens(page)[1]


def _content_and_tokens(page: str | None) -> tuple[int, list[dict]]:
    """A hash of the texts that may be main text, which copies of a page share, and the page's tokens."""
    found: Counter[tuple[int, int, bool]] = Counter()
    content = set()
    for text, element in blocks(page):
        token = _hash(str(element.path), text)
        found[token, element.path, True] += 1
        found[element.path, element.above, False] += 1
        if not element.dropped:
            content.add(token)
    return _hash(*map(str, sorted(content))), [{"token": t, "parent": p, "is_text": k, "n": n} for (t, p, k), n in found.items()]


def templates(pages: DataFrame, url: str = "url", html_column: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, tokens): the text tokens of each host's template.

    A token's occurrence vector says how often it occurs on each page of the host; the sums of a hash of page and count stand
    for it, so that equal vectors have equal sums and no page list is ever gathered. Pages of equal content are one page here, so that
    an article is not taken for a template because it is copied. Tokens with equal vectors are a class. A class is
    valid if it has two tokens or more and occurs on ``min_pages`` pages and ``min_share`` of the host's (an element is two
    tokens, its tags); its texts join the template if the element they are nested in belongs to a valid class too. Where an element
    holds texts that vary (on ``min_pages`` pages or more) it is a slot, and what repeats in it is most likely a passage that articles share:
    it joins only if it is on ``SLOT_SHARE`` of the host's contents. All pages count; a task
    sums up before anything is shuffled, so a host with a third of all pages is summed by all tasks.
    """

    @F.pandas_udf("struct<content: bigint, tokens: array<struct<token: bigint, parent: bigint, is_text: boolean, n: int>>>")
    def parsed(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_content_and_tokens(t) for t in texts], columns=["content", "tokens"])

    named = pages.select(host(F.col(url)).alias("host"), F.col(html_column).alias("html")).where("host <> ''")
    read = named.select("host", parsed(F.col("html")).alias("read")).select("host", "read.content", "read.tokens")
    read = stored(read.withColumn("at", F.monotonically_increasing_id()), "read")
    firsts = stored(read.groupBy("host", "content").agg(F.min("at").alias("at")), "contents")
    rows = read.join(firsts.select("at"), "at", "left_semi").select("host", "content", F.inline("tokens"))
    vector = F.xxhash64("content", "n")
    low, high = vector.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(vector, 32)
    sums = rows.groupBy("host", "token", "parent", "is_text").agg(F.count(F.lit(1)).alias("pages"), F.sum(low).alias("low"), F.sum(high).alias("high"))
    on_hosts = firsts.groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    enough = (F.col("pages") >= min_pages) & (F.col("pages") >= F.col("of") * min_share)
    counted = stored(sums.join(on_hosts, "host").withColumn("often", enough), "tokens")
    often = counted.where("often")
    tags = F.when(F.col("is_text"), 1).otherwise(2)
    classes = often.groupBy("host", "low", "high").agg(F.sum(tags).alias("tokens")).where("tokens >= 2")
    valid = often.join(classes, ["host", "low", "high"]).select("host", "token", "parent", "is_text", "pages", "of")
    elements = valid.where("not is_text").select("host", F.col("token").alias("parent")).distinct()
    slots = counted.where("is_text and not often").groupBy("host", "parent").agg(F.sum("pages").alias("vary")).where(F.col("vary") >= min_pages)
    nested = valid.where("is_text").join(elements, ["host", "parent"], "left_semi").join(slots, ["host", "parent"], "left")
    nested = nested.where(F.col("vary").isNull() | (F.col("pages") >= F.col("of") * SLOT_SHARE))
    return nested.groupBy("host").agg(F.sort_array(F.collect_set("token")).alias("tokens"))


def main_text(page: str | None, template: frozenset[int] = frozenset()) -> str:
    """The blocks that are left: no dropped element and no block of the host's template; of these slots those in article or main if

    there is text in one, else in an element named as content, else all.
    """
    kept = [(text, e) for text, e in blocks(page) if not e.dropped and not (template and _hash(str(e.path), text) in template)]
    level = max((e.main for _, e in kept), default=0)
    return "\n".join(text for text, e in kept if e.main == level)


def extracted(pages: DataFrame, url: str = "url", html_column: str = "html", out: str = "text", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """The pages with their main text: empty if there is none, and for NULL or empty html.

    Pages without a host have no template, nor have hosts with fewer than ``min_pages`` pages: there the elements alone decide. Repeated pages
    count once. Templates hold one row per host; Spark broadcasts them only if
    their stored size allows, else joins by host and splits hot ones. ``out`` replaces a column of that name; other columns are carried along.
    """
    name, known, of = free_name(pages, "page_host"), free_name(pages, "page_template"), free_name(pages, "template_host")
    template = stored(templates(pages, url, html_column, min_pages, min_share), "templates").select(F.col("host").alias(of), F.col("tokens").alias(known))

    @F.pandas_udf("string")
    def text(htmls: pd.Series, tokens: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, frozenset() if t is None else frozenset(t)) for h, t in zip(htmls, tokens, strict=True)], dtype=object)

    joined = pages.withColumn(name, host(F.col(url))).join(template, F.col(name) == F.col(of), "left")
    return joined.withColumn(out, text(F.col(html_column), F.col(known))).drop(name, known, of)
