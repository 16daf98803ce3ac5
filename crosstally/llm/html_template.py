"""Main text of web pages by template deduction.

Pages of one host share a template. Its tokens are elements in their place (a chain of tags with their classes and ids)
and strings of text in their place. Each token has an occurrence vector, its count on every page of the host;
tokens with equal vectors form an equivalence class. A vector is kept as the number of pages, the sum and an XOR of
hashes of (page, count), so classes come from aggregation and no host is gathered. Frequent classes that nest inside
one another make the template; what lies between its tokens are slots. The main slot is the deepest template
container that holds most of the text outside menus, notices and the like; its text, without template strings, is
the page's main text (pages say themselves what an article holds: inside one no string is dropped). A page without its host's main slot falls back on its own deepest container of template elements.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches

# Element names of HTML by their role.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = ("script", "style")
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
             "small span strike strong sub sup time tt u var wbr".split())
CONTAINER = set("article main section div td body".split())
DROPPED = set("head title nav footer aside form script style noscript iframe svg button select option textarea template "
              "object audio video canvas dialog menu".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Words in classes and ids of parts that are not main text.
ASIDE = set("ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies "
            "complementary contentinfo disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices notification "
            "popup popular promo promoted promotion recommended related replies reply search share sharing sidebar signup "
            "skip social sponsor sponsored subscribe subscription toc toolbar widget widgets".split())

#: Words that say nothing about a part's role when they stand beside one of the above.
NEUTRAL = set("area bar block body bottom box button buttons container content group holder inner item items left link links list "
              "outer panel post posts right row section site text title top wrap wrapper".split())
# Elements that hold a paragraph, heading, entry or cell.
PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 li blockquote pre figcaption dt dd td th tr tbody table caption address".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[^<]++|<", re.S)
# Where quotes are left open, a tag ends at the next bracket.
_LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[^<]++|<", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS, _NUMBER = re.compile(r"\d+"), re.compile(r"\d{3,}")
FREQUENT, MOST = 0.2, 0.7


def _names_aside(named: list[tuple[str, str]], in_article: bool, tag: str) -> bool:
    """Whether classes, ids or roles name a part that isn't main text.

    Around the article any listed word does. Inside it only a name all of whose words are listed or neutral does, such as
    ``share-buttons`` but not ``share-price``, and never that of a paragraph.
    """
    if tag in ("body", "html", "main", "article"):
        return False
    if not in_article:
        return any(p.lower() in ASIDE for _, v in named for p in _PART.findall(v))
    if tag in PARAGRAPHS or tag in INLINE:
        return False
    listed, known = ASIDE - {"header"}, ASIDE | NEUTRAL
    for _, value in named:
        for name in value.split():
            parts = {p.lower() for p in _PART.findall(name)}
            if parts & listed and parts <= known:
                return True
    return False


class Element:
    __slots__ = ("aside", "article", "chars", "container", "depth", "direct", "link", "node", "parent", "root", "seen", "tag", "within")

    def __init__(self, tag: str, attributes: str, parent: "Element | None"):
        named = sorted((k.lower(), a or b or c) for k, a, b, c in _NAMED.findall(attributes)) if attributes else []
        # Ids belong to a page, and so do long numbers; a class such as col-8 belongs to the template.
        sign = tag + "".join(f" {k}={(_DIGITS if k == 'id' else _NUMBER).sub('0', v)}" for k, v in named)
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        self.chars = self.direct = 0
        self.seen, self.within = False, None
        self.article = tag in ("article", "main") or bool(parent and parent.article)
        self.aside = bool(parent and parent.aside) or tag in DROPPED or (tag == "header" and not self.article) or _names_aside(
            named, self.article, tag)
        self.link = tag == "a" or bool(parent and parent.link)
        self.container = tag in CONTAINER
        # Marks of text, such as bold, don't make a place of their own.
        above = parent.node if parent else 0
        self.node = above if tag in INLINE and not self.aside else xxhash.xxh64_intdigest(f"{above} {sign}") >> 1
        #: Place of the outermost article or main element around, itself included; 0: none.
        self.root = parent.root if parent and parent.root else self.node if tag in ("article", "main") else 0


def blocks(source: str | None, elements: list[Element] | None = None) -> Iterator[tuple[Element | None, str, int]]:
    """(innermost open element, text, characters in links) of every block of text, in page order; elements end implicitly
    where HTML lets them, unknown ends are skipped. References are decoded and white space is one blank. ``elements`` gets
    all elements that were opened, outer ones first."""
    source = source or ""
    stack: list[Element] = []
    open_tags: Counter[str] = Counter()
    held: list[str] = []
    links, at, end, last, token = 0, 0, len(source), source.rfind(">"), _TOKEN

    def flush():
        nonlocal held, links
        text = " ".join("".join(held).split()) if held else ""
        out = (stack[-1] if stack else None, text, links)
        held, links = [], 0
        return out

    while at < end:
        if at > last:  # no tag ends behind the last bracket, but a comment may run to the end
            comment = source.find("<!--", at)
            piece = html.unescape(source[at : comment if comment >= 0 else end])
            held.append(piece)
            links += len(piece) if stack and stack[-1].link else 0
            break
        m = token.match(source, at)
        if m[0] == "<" and token is _TOKEN and at + 1 < end and (source[at + 1].isalpha() or source[at + 1] == "/"):
            token = _LOOSE  # some quote is never closed
            continue
        at, tag = m.end(), m[2]
        if tag is None:
            if not m[0].startswith(("<!", "<?")):
                piece = html.unescape(m[0])
                held.append(piece)
                if stack and stack[-1].link:
                    links += len(piece)
            continue
        tag = tag.lower()
        breaks = tag not in INLINE or tag in DROPPED
        if breaks and held:
            yield flush()
        if m[1]:
            if open_tags[tag]:
                while True:
                    closed = stack.pop()
                    open_tags[closed.tag] -= 1
                    if closed.tag == tag:
                        break
            continue
        if any(open_tags[c] for c in CLOSES.get(tag, ())):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in CLOSES[tag]:
                    open_tags.subtract(e.tag for e in stack[i:])
                    del stack[i:]
                    break
                if stack[i].tag in CONTAINER or stack[i].tag in ("ul", "ol", "dl", "table"):
                    break
        element = Element(tag, m[3], stack[-1] if stack else None)
        if elements is not None:
            elements.append(element)
        if tag in RAW:
            close = re.compile(f"</{tag}", re.I).search(source, at)
            at = close.start() if close else end
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(element)
            open_tags[tag] += 1
    if held:
        yield flush()


class Place:
    """What a page holds at one place: elements, text of its own and below, in characters outside links and asides."""

    __slots__ = ("chars", "container", "count", "depth", "direct", "parent", "root")

    def __init__(self, e: Element):
        self.parent, self.container, self.depth, self.root = e.parent.node if e.parent else 0, e.container, e.depth, e.root
        self.count = self.chars = self.direct = 0


def _measured(source: str | None):
    """The places of a page that blocks of text lie in, the strings in their places, and the blocks that aren't aside:
    (innermost element, text, string)."""
    elements: list[Element] = []
    strings: dict[int, int] = defaultdict(int)
    kept = []
    for top, text, links in blocks(source, elements):
        if top is not None:
            top.seen = True
        if top is not None and top.aside or not text:
            continue
        if top is not None:
            own = len(text) - min(links, len(text))
            top.chars += own
            holder = top
            while holder.parent is not None and not holder.container and holder.tag in INLINE | PARAGRAPHS:
                holder = holder.parent
            holder.direct += own if holder.tag not in ("body", "html") else 0
        label = 0
        if not (top and top.article):
            label = xxhash.xxh64_intdigest(f"{top.node if top else 0}|{text}") >> 1
            strings[label] += 1
        kept.append((top, text, label))
    places: dict[int, Place] = {}
    for e in elements:  # outer ones first: a place is described by the first element there
        if e.node not in places:
            places[e.node] = Place(e)
    for e in reversed(elements):  # inner ones first: sums go up once
        place, parent = places[e.node], e.parent
        place.direct += e.direct
        if parent is not None:
            parent.seen = parent.seen or e.seen
            parent.chars += e.chars
        place.count += e.seen
        if parent is None or parent.node != e.node:
            place.chars += e.chars
    return {n: p for n, p in places.items() if p.count}, strings, kept


def _widened(main: int, places: dict[int, Place]) -> int:
    """The article around a place, or the highest container above it up to which each has text of its own."""
    root = places[main].root
    if root:
        return root if root in places else main
    above = places[main].parent
    while above in places:
        if places[above].container:
            if not places[above].direct:
                break
            main = above
        above = places[above].parent
    return main


def _host(url):
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return F.when(host == "", F.lit("-")).otherwise(host)


_VECTORS = ("host string, node long, parent long, root long, container boolean, string boolean, n long, chars long, direct long, "
            "depth int, vector long")


def templates(pages: DataFrame) -> DataFrame:
    """host, main (place of the main slot; 0: none), places (containers of the template), labels (template strings)."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, page, source in zip(*(batch.column(i).to_pylist() for i in range(3))):
                places, strings, _ = _measured(source)
                for node, p in places.items():
                    rows.append((host, node, p.parent, p.root, p.container, False, p.count, p.chars, p.direct, p.depth,
                                 xxhash.xxh64_intdigest(f"{page} {p.count}") >> 1))
                for node, n in strings.items():
                    rows.append((host, node, 0, 0, False, True, n, 0, 0, 0, xxhash.xxh64_intdigest(f"{page} {n}") >> 1))
            frame = pd.DataFrame(rows, columns=[x.split()[0] for x in _VECTORS.split(", ")])
            yield pa.RecordBatch.from_pandas(frame, schema=_arrow, preserve_index=False)

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32()}
    _arrow = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in _VECTORS.split(", "))])
    tokens = saved(
        pages.mapInArrow(run, _VECTORS).groupBy("host", "node", "parent", "root", "container", "string").agg(
            F.count("*").alias("pages"), F.sum("n").alias("total"), F.sum("chars").alias("chars"), F.sum("direct").alias("direct"),
            F.min("depth").alias("depth"), F.bit_xor("vector").alias("vector")),
        "tokens",
    )
    # Every page with any token has an outermost element; those of depth 0 tell the number of pages well enough.
    sizes = tokens.groupBy("host").agg(F.max("pages").alias("of"), F.max("chars").alias("text"))
    frequent = tokens.join(sizes, "host").where(F.col("pages") >= FREQUENT * F.col("of")).where(
        ~F.col("string") | ((F.col("pages") >= 0.8 * F.col("of")) & (F.col("of") >= 5) & (F.col("total") == F.col("pages"))))
    return frequent.groupBy("host").applyInPandas(_deduced, "host string, main long, places array<long>, labels array<long>")


def _deduced(tokens: pd.DataFrame) -> pd.DataFrame:
    """The template of one host from its frequent tokens (at most 1 / FREQUENT times what a page has)."""
    elements = tokens[~tokens["string"]].drop_duplicates("node").set_index("node")
    elements["direct"] //= elements["pages"]  # at least a character on every page, or none
    classes = {node: (r.pages, r.total, r.vector) for node, r in elements.iterrows()}
    # A class nests if the places that hold its tokens belong to itself or to one other class.
    outer = defaultdict(set)
    for node, r in elements.iterrows():
        above = classes.get(r.parent)
        if above is not None and above != classes[node]:
            outer[classes[node]].add(above)
    nested = {c for c in set(classes.values()) if len(outer[c]) <= 1}
    places = [n for n, r in elements.iterrows() if r.container and classes[n] in nested]
    text = max([int(tokens["text"].max()), 1])
    main = max((n for n in places if elements.loc[n].chars >= MOST * text),
               key=lambda n: (elements.loc[n].depth, elements.loc[n].chars, n), default=0)
    main = _widened(main, {n: r for n, r in elements.iterrows()}) if main else 0
    labels = sorted(tokens[tokens["string"]]["node"].tolist())
    return pd.DataFrame({"host": [tokens["host"].iloc[0]], "main": [main], "places": [places], "labels": [labels]})


def _inside(top: Element | None, main: int) -> bool:
    """Whether an element lies at the place or below it; what is found out is noted on the way."""
    way = []
    while top is not None and top.within is None and top.node != main:
        way.append(top)
        top = top.parent
    found = top is not None and (top.node == main or bool(top.within))
    for e in way:
        e.within = found
    return found


def _text(source: str | None, main: int, places: set[int], labels: set[int]) -> str:
    found, _, kept = _measured(source)
    if main not in found or not found[main].chars:
        most = MOST * max([p.chars for p in found.values()], default=0)
        open_to = [n for n, p in found.items() if p.container and p.chars >= most and (n in places or not places)]
        main = max(open_to, key=lambda n: (found[n].depth, found[n].chars, n), default=0)
        main = _widened(main, found) if main else 0
    inside = [(text, label) for top, text, label in kept if not main or _inside(top, main)]
    # Where all strings are the template's, as on hosts whose pages are copies of one, they are the page's text.
    own = [text for text, label in inside if label not in labels]
    return "\n".join(own or [text for text, _ in inside])


#: Rows of one host are dealt over so many tasks when pages meet their templates; AQE splits further.
SPREAD = 16


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row, from its whole html.

    Null, empty and text-free html give an empty text; html without elements gives its text; a null or odd url is a host
    of its own; repeated rows give a row each; extra columns are ignored; an empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), _host(F.col("url")).alias("host"))
    found = saved(templates(rows.select("host", F.xxhash64("page_id", "url").alias("page"), "html")), "templates")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SPREAD)))
    many = found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    joined = salted.join(many, ["host", "salt"], "left").select("page_id", "url", "html", "main", "places", "labels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(2, 6)]
            texts = [_text(h, m or 0, set(p or ()), set(l or ())) for h, m, p, l in zip(*columns)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
