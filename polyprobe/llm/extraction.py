"""Main text of web pages by template deduction over the pages of a host.

Tokens are tags in their place (the path of enclosing elements) and whole text
nodes in their place.  Tokens that occur equally often on every page of a host
have the same occurrence vector and form an equivalence class.  A vector is
never built: each page adds a hash of (page, count) to the token's sum, and
equal sums mean equal vectors, so classes of a host with any number of pages
come from one small aggregation and no host is gathered anywhere.  Classes with
enough tokens and support, whose places nest, make the template: one class spans
most of the host, others are layouts of their own and hold tags that only their
pages have.  Tags that occur once on each page of a class are its frame, text
nodes in a class are its fixed text, and what is left are slots.  The main text
is what fills the slots of the content region: the innermost frame element that
holds most of the text, where an article or main element goes before what it
encloses.  Pages without a template go by such elements alone.  Menus, headers,
footers, sidebars, notices, adverts, forms, comments and markup are never part
of it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from html import unescape
from typing import NamedTuple
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from polyprobe.llm.common import batch_of, stored

#: A class is valid with this many tokens on this many pages; one on less than this share of the host's pages is a
#: layout and needs a tag that its pages have once and no others have (copies of one page share only texts).
MIN_TOKENS = 3
MIN_SHARE = 0.9
MIN_PAGES = 8
#: Share of the text of its pages that a content region must hold.
REGION_SHARE = 0.6

# Elements and attribute words by their role on a page.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark q s samp small span "
                    "strike strong sub sup time tt u var wbr img".split())
_HIDDEN = frozenset("head nav footer aside form button select textarea option script style noscript template iframe "
                    "object svg canvas audio video dialog menu".split())
_SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
                 "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                    "header hr main nav ol p pre section table ul".split())
_SCOPES = frozenset("article aside body div footer form header html main nav section table td th ul ol".split())
_ROLE_WORDS = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed|s)?|promo(?:tion)?s?|banners?|cookies?|"
    r"consent|gdpr|notices?|alerts?|newsletter|subscribe|popup|modal|overlay|sidebars?|side-?bar|menus?|navs?|navbar|"
    r"navigation|breadcrumbs?|pagination|pager|toc|footers?|headers?|masthead|topbar|toolbar|comments?|commentlist|"
    r"disqus|replies|respond|responses|share|sharing|social|related|recommend(?:ed|ations)?|widgets?|login|signup|"
    r"search|skip|copyright|legal)(?:$|[\s_-])")
#: An article by one of these names is not the page's own.
_OTHER_ARTICLE = re.compile(
    r"(?i)(?:^|[\s_-])(?:comments?|commentlist|repl(?:y|ies)|responses?|related|recommend(?:ed|ations)?|teasers?|promos?|"
    r"sponsor(?:ed|s)?|ads?|adverts?|advertisement)(?:$|[\s_-])")
_ROLES = re.compile(r"(?i)^(?:navigation|banner|contentinfo|complementary|search|form|dialog|alert|menu|menubar)$")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|textarea|svg|title)\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|</?(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"<]*\"|'[^'<]*'|[^>\"'])*+)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I)
_ATTRIBUTE = re.compile(r"(?i)(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


class Node(NamedTuple):
    """A piece of text: its block number, place, region numbers of article-like elements, and hidden or not."""

    text: str
    block: int
    place: int
    article: bool
    hidden: bool
    frames: tuple[int, ...]


class Page(NamedTuple):
    """Text nodes, the places of all structural tags in order, the place that encloses each, and those of articles."""

    nodes: list[Node]
    tags: list[int]
    parents: dict[int, int]
    articles: set[int]


def _hidden_by_attributes(attrs: str) -> tuple[bool, str]:
    names, hidden = [], False
    for m in _ATTRIBUTE.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            hidden |= bool(_ROLES.match(value))
        else:
            hidden |= bool(_ROLE_WORDS.search(value))
            names.append(value)
    return hidden, " ".join(names)


def parse(html: str) -> Page:
    """Text nodes with their places, and the places of all structural tags."""
    nodes: list[Node] = []
    tags: list[int] = []
    parents: dict[int, int] = {}
    articles: set[int] = set()
    # Open elements: name, hidden, article, place, frames up to here.
    stack: list[tuple[str, bool, bool, int, tuple[int, ...]]] = [("", False, False, 0, ())]
    block = at = 0

    def text(piece: str) -> None:
        if piece:
            _, hidden, article, place, frames = stack[-1]
            nodes.append(Node(piece, block, place, article, hidden, frames))

    for m in _TOKEN.finditer(html):
        text(html[at: m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag, closing = tag.lower(), html[m.start() + 1] == "/"
        if tag not in _INLINE:
            block += 1
        elif tag in ("br", "img", "wbr"):
            if tag == "br":
                text(" ")
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] in _SCOPES and tag not in _SCOPES:
                    break
            continue
        ends = _SELF_CLOSING.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    del stack[k:]
                    break
                if stack[k][0] in _SCOPES:
                    break
        _, hidden, article, place, frames = stack[-1]
        attrs = m["attrs"]
        by_name, names = _hidden_by_attributes(attrs) if "=" in attrs and tag not in ("html", "body") else (False, "")
        if tag not in _INLINE and tag != "p":
            parent, place = place, crc32(f"{place}/{tag}.{names}".encode())
            tags.append(place)
            parents[place] = parent
            if tag in ("article", "main"):
                articles.add(place)
            if tag not in _VOID:
                frames = (*frames, place)
        if tag in _VOID or attrs.endswith("/"):
            continue
        inside = article or tag in ("article", "main")
        # A header inside an article carries its title.
        own = tag in _HIDDEN or (tag == "header" and not article) or by_name and (
            tag not in ("article", "main") or tag == "article" and bool(_OTHER_ARTICLE.search(names)))
        stack.append((tag, hidden or own, inside, place, frames))
    text(html[at:])
    return Page(nodes, tags, parents, articles)


def _blocks(nodes: list[Node]) -> str:
    parts: dict[int, list[str]] = {}
    for node in nodes:
        parts.setdefault(node.block, []).append(node.text)
    lines = (" ".join(unescape("".join(p)).split()) for p in parts.values())
    return "\n".join(line for line in lines if line)


def _text_token(node: Node) -> int:
    return crc32(" ".join(node.text.split()).encode(), node.place) | 1 << 32


def tokens(pages: DataFrame) -> DataFrame:
    """Occurrence sums of each host's tokens.

    ``vector`` identifies the occurrence vector, ``once`` counts the pages with
    exactly one occurrence, ``chars`` is the visible text below a tag and
    ``total`` that of all pages with the token, ``parent`` is the enclosing
    place, and ``article`` says that the tag is an article or main element.
    """
    kinds = "host string, token bigint, pages bigint, once bigint, vector bigint, chars bigint, total bigint, " \
        "depth bigint, parent bigint, article boolean"
    schema = pa.schema([(name, {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[kind])
                        for name, kind in (field.split() for field in kinds.split(", "))])

    def run(batches):
        for batch in batches:
            sums: dict[tuple[str, int], list] = {}
            for host, row, html in zip(*(c.to_pylist() for c in batch.columns)):
                page = parse(html or "")
                seen: dict[int, int] = {}
                for place in page.tags:
                    seen[place] = seen.get(place, 0) + 1
                parents = dict(page.parents)
                chars: dict[int, tuple[int, int]] = {}
                total = 0
                for node in page.nodes:
                    blank = not node.text.strip()
                    if blank or node.hidden:
                        continue
                    total += len(node.text)
                    t = _text_token(node)
                    seen[t] = seen.get(t, 0) + 1
                    parents[t] = node.place
                    for depth, place in enumerate(node.frames):
                        chars[place] = (chars.get(place, (0, 0))[0] + len(node.text), depth)
                for t, n in seen.items():
                    s = sums.setdefault((host, t), [0, 0, 0, 0, 0, 0, parents[t], t in page.articles])
                    s[0] += 1
                    s[1] += n == 1
                    # Python hashes of integer tuples are the same in every process.
                    s[2] = (s[2] + hash((row, n))) % (1 << 40)
                    got = chars.get(t, (0, 0))
                    s[3] += got[0]
                    s[4] += total
                    s[5] = max(s[5], got[1])
            cols = list(zip(*((h, t, *s) for (h, t), s in sums.items()))) or [[]] * len(schema.names)
            yield batch_of(schema, **dict(zip(schema.names, map(list, cols))))

    return pages.select("host", "row", "html").mapInArrow(run, kinds).groupBy("host", "token").agg(
        F.sum("pages").alias("pages"), F.sum("once").alias("once"), (F.sum("vector") % (1 << 40)).alias("vector"),
        F.sum("chars").alias("chars"), F.sum("total").alias("total"), F.max("depth").alias("depth"),
        F.max("parent").alias("parent"), F.max("article").alias("article"))


def templates(pages: DataFrame) -> DataFrame:
    """Per host: tokens of fixed text, and the content regions of its layouts in order of preference."""
    counted = stored(tokens(pages), "tokens")
    sizes = pages.groupBy("host").agg(F.count("*").alias("of"))
    key = ["host", "vector", "pages"]
    is_text = F.col("token") >= (1 << 32)
    classes = counted.groupBy(key).agg(
        F.count("*").alias("n"), F.sum((~is_text & (F.col("once") == F.col("pages"))).cast("int")).alias("frames"),
        F.max(F.col("once") == F.col("pages")).alias("single")) \
        .where((F.col("n") >= MIN_TOKENS) & (F.col("pages") >= MIN_PAGES)).join(sizes, "host") \
        .where((F.col("pages") >= MIN_SHARE * F.col("of")) | (F.col("frames") > 0))
    members = counted.join(classes.select(*key, "single"), key)
    # What repeats on a page nests only if all of it lies in one enclosing place outside the class.
    own = members.where(~is_text).select(*key, F.col("token").alias("parent"), F.lit(True).alias("inner"))
    nested = members.join(own, [*key, "parent"], "left").groupBy(key).agg(
        F.countDistinct(F.when(F.col("inner").isNull(), F.col("parent"))).alias("outer")) \
        .where(F.col("outer") == 1)
    valid = members.where("single").unionByName(members.where(~F.col("single")).join(nested.select(key), key, "left_semi"))
    fixed = valid.where(is_text).groupBy("host").agg(F.collect_set("token").alias("fixed"))
    # Frame tags occur once on each page of their class.
    frame = valid.where(~is_text & (F.col("once") == F.col("pages")) & (F.col("chars") > 0)
                        & (F.col("chars") >= REGION_SHARE * F.col("total")))
    regions = frame.groupBy("host").agg(F.expr(
        "transform(sort_array(collect_list(struct(article, depth, chars, token)), false), r -> r.token)").alias("regions"))
    return fixed.join(regions, "host", "full")


def _length(nodes: list[Node]) -> int:
    return sum(len(n.text.strip()) for n in nodes)


def main_text(html: str | None, fixed: frozenset[int] = frozenset(), regions: Sequence[int] = ()) -> str:
    """Main text of one page given its host's template; a page without any slot is all its own."""
    page = parse(html or "")
    open_nodes = [n for n in page.nodes if not n.hidden]
    slots = [n for n in open_nodes if _text_token(n) not in fixed]
    for region in regions:
        held = [n for n in slots if region in n.frames]
        if _length(held):
            inside = [n for n in held if n.article]
            return _blocks(inside if _length(inside) >= REGION_SHARE * _length(held) else held)
    if not _length(slots):
        slots = open_nodes
    inside = [n for n in slots if n.article]
    return _blocks(inside if _length(inside) else slots)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars.

    A null or empty html has empty text; pages with a null url share one
    template; small hosts have none and go by the elements alone; fixed text goes even inside an article; rows that
    repeat are pages like any other; text without any markup is its own main
    text; other columns are ignored; an empty table gives an empty result.
    """
    named = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                         F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")) \
        .withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]+)", 1)), F.lit(""))) \
        .withColumn("row", F.xxhash64("page_id", "url"))
    known = stored(templates(named), "templates")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            memo: dict[str, frozenset[int]] = {}
            texts = []
            hosts, htmls, fixed, regions = (batch.column(i).to_pylist() for i in range(2, 6))
            for host, html, own, region in zip(hosts, htmls, fixed, regions):
                if host not in memo:
                    memo[host] = frozenset(own or ())
                texts.append(main_text(html, memo[host], region or ()))
            yield batch_of(schema, page_id=batch.column(0), url=batch.column(1), text=texts)

    return named.join(known, "host", "left").select("page_id", "url", "host", "html", "fixed", "regions") \
        .mapInArrow(run, "page_id bigint, url string, text string") \
        .withColumn("n_chars", F.length("text").cast("bigint"))
