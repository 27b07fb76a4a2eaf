"""Main text of web pages, with the templates of each site removed.

Pages become blocks of text by one pass over their tags. Subtrees are hashed
bottom-up, over tag, class, text and the hashes of what they hold. Spark counts
for each host where a subtree recurs; its template is deleted, beside what says
itself that it is no content: menus, headers and footers, sidebars, notices,
adverts, forms, scripts, styles and comments of readers.

Copies of an article are still articles, so what counts is how much the rest
of the main element, or of the page, differs: each occurrence draws one block
of that rest, by its hash and in proportion to its length, and distinct draws
are counted. Copies draw the same block, versions of an article mostly do, and
what is most of the text draws none; beside a share box each article draws
another one. So many draws make a template on a host of any size. Outside the
main element so many distinct pages do, too, if they are a share of the host's
pages. A main element as a whole is never deleted, and of the plain paragraphs
inside, whose sentences may be said again, only those on most pages of the
host.

Counts are combined before the shuffle. Templates meet the subtrees of pages
by host and subtree, N:1 and left to skew splitting, and each page is given
those that it holds, so no list grows with its host. Hosts of fewer distinct
pages than a template needs have none.

Null and empty pages have an empty text. A page without a host shares its
templates with others of no host. Repeated rows give repeated results, and
count as one page.
"""

import html as entities
import itertools
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mealgrid.llm.common import text_of
from mealgrid.session import stage

# A subtree is a template on a host from so many distinct draws on, or so many distinct pages and so large a share.
PAGES = 8
SHARE = 0.05
# A plain paragraph inside a main element may be said again: it also needs so large a share.
MOST = 0.5

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>"""
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'=/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']+))?""")
UNSHOWN = re.compile(r"display\s*:\s*none", re.I)
SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em embed font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose "
    "msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd semantics annotation annotation-xml".split()
)
# Dropped from their start to their end, if they have one; else the tag alone.
EMBEDDED = frozenset("noscript template textarea iframe svg title select object".split())
DROPPED = frozenset("nav footer aside form head button dialog menu input".split())
MAIN = frozenset(["article", "main"])
# A name that ends so tells what an article allows, not what it is.
STATES = frozenset("open opened closed enabled disabled allowed on off".split())
# Parts of class, id and role names that mark what is not the article: anywhere in a name,
STRONG = frozenset(
    "advert adverts advertisement advertising sponsored cookie cookies consent gdpr newsletter popup modal navbar navigation breadcrumb "
    "breadcrumbs sidebar comment comments disqus related recommended".split()
)
# and first or last in a name.
WEAK = frozenset(
    "ad ads promo sponsor banner notice subscribe overlay nav menu aside widget share sharing social footer masthead topbar replies login "
    "signup search toolbar pagination pager skip".split()
)
# A name that starts so tells about something else.
OTHERS = frozenset("has with without no is".split())
PARTS = re.compile(r"[^a-z0-9]+")
# An open tag of the first closes elements of the second, up to one of the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
TOP = frozenset("html body head".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre".split())


def _names(attrs: str) -> Iterator[list[str]]:
    """Parts of the names that tell about the element itself."""
    for m in CLASS.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = [p for p in PARTS.split(name) if p]
            if parts and parts[0] not in OTHERS:
                yield parts


def _named(attrs: str) -> bool:
    """Whether names mark an element as no part of the article. ``header`` counts apart."""
    return any(not STRONG.isdisjoint(p) or p[0] in WEAK or p[-1] in WEAK for p in _names(attrs))


def _remark(attrs: str) -> bool:
    """Whether names mark an article as no article, such as a reader's comment."""
    return any(not STRONG.isdisjoint(p) and p[-1] not in STATES for p in _names(attrs))


def _heads(attrs: str) -> bool:
    return any("header" in p for p in _names(attrs))


def _hidden(attrs: str) -> bool:
    lower = attrs.lower()
    if "hidden" not in lower and "display" not in lower:
        return False
    for m in ATTRIBUTE.finditer(attrs):
        name = m[1].lower()
        value = (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and UNSHOWN.search(value):
            return True
    return False


class _Element:
    """An open element; ``held`` is the text before it if it is dropped from within a block."""

    __slots__ = ("tag", "away", "main", "sign", "blocks", "head", "held", "first", "off", "inside", "saved", "firm", "outs")

    def __init__(self, tag, away, main, head, held=None, up=None, first=0, firm=False):
        self.tag, self.away, self.main, self.head, self.held, self.first = tag, away, main, head, held, first
        self.sign, self.blocks = [], None
        # Main elements within it stay if it is dropped, unless that is firm.
        self.saved, self.firm = None, firm
        # Elements to be dropped from here upwards.
        self.outs = away + (up.outs if up is not None else 0)
        self.inside = main or up is not None and up.inside
        # Within the innermost main element, or the page, to be dropped.
        self.off = away or not main and up is not None and up.off


def _both(a: tuple | None, b: tuple | None) -> tuple | None:
    """Blocks of ``a``, then those of ``b``, as a tree (number, left, right), so that no depth copies them."""
    if a is None or b is None:
        return b if a is None else a
    return (a[0] + b[0], a, b)


def _listed(blocks: tuple | None) -> list[str]:
    out, left = [], [blocks] if blocks else []
    while left:
        node = left.pop()
        if len(node) == 2:
            out.append(node[1])
        else:
            left += (node[2], node[1])
    return out


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - ((h >> 63) << 64)


class _Region:
    """Blocks of a main element with their draw keys, and places of its subtrees."""

    def __init__(self):
        self.keys: list[tuple[float, int, int]] = []
        self.subtrees: list[tuple[int, int, int, int]] = []

    def add(self, text: str) -> None:
        h = _hash(text)
        self.keys.append((-math.log(((h & (1 << 64) - 1) + 1) / 2.0**64) / len(text), h, len(text)))

    def drawn(self) -> Iterator[tuple[int, int | None, int]]:
        """Each subtree with the block drawn of those outside it, if it is no more than half of the text."""
        none = (math.inf, 0, 0)
        before = list(itertools.accumulate(self.keys, min, initial=none))
        after = list(itertools.accumulate(reversed(self.keys), min, initial=none))[::-1]
        sizes = list(itertools.accumulate((k[2] for k in self.keys), initial=0))
        for h, first, end, kind in self.subtrees:
            least = min(before[first], after[end])
            yield h, None if least is none or 2 * (sizes[end] - sizes[first]) > sizes[-1] else least[1], kind


def _embedded(tags: list[re.Match]) -> dict[int, int]:
    """Where embedded elements start and end, without those that never end."""
    opened, found = {tag: [] for tag in EMBEDDED}, {}
    for m in tags:
        tag = (m[3] or m[6] or "").lower()
        if tag not in EMBEDDED:
            continue
        if not (m[2] or m[5]):
            if tag != "svg" or not (m[4] or m[7] or "").endswith("/"):
                opened[tag].append(m.start())
        elif opened[tag]:
            found[opened[tag].pop()] = m.end()
    return found


def parsed(
    page: str, templates: frozenset[int] = frozenset(), draws: bool = False
) -> tuple[list[str], list[tuple[int, int | None, int, bool]]]:
    """Blocks of the main text and, with ``draws``, hashes of the subtrees.

    With each hash come the block drawn of the rest of its main element or page,
    what the subtree is (0 outside a main element, 1 inside one, 2 a plain
    paragraph inside one), and whether it can be part of the text.

    A block's text goes to its element; when the element closes, its blocks go
    to its parent, unless it is to be dropped. If the page has main elements,
    only theirs are kept. Those in an element to be dropped count if there are
    no others: of these the least deep in such elements, if they hold as much
    text as the rest. Otherwise they stand in the rest, but for those in menus
    and the like.
    """
    root = _Element("", False, False, "")
    stack, buffer, hashes, mains, regions = [root], [], [], {}, [_Region()]
    # Where the open elements of each tag, the main ones, and those that are no inline ones stand in the stack.
    places, main_at, standing = defaultdict(list), [], [0]
    hashed = draws or bool(templates)

    def flush() -> None:
        if buffer:
            text = SPACE.sub(" ", entities.unescape("".join(buffer))).strip()
            buffer.clear()
            if text:
                stack[-1].blocks = _both(stack[-1].blocks, (1, text))
                stack[-1].sign.append(text)
                if draws and not stack[-1].off:
                    regions[-1].add(text)

    def push(element: _Element) -> None:
        places[element.tag].append(len(stack))
        if element.main:
            main_at.append(len(stack))
        if element.held is None:
            standing.append(len(stack))
        stack.append(element)

    def pop() -> _Element:
        done = stack.pop()
        places[done.tag].pop()
        if done.main:
            main_at.pop()
        if done.held is None:
            standing.pop()
        return done

    def close() -> None:
        nonlocal buffer
        if stack[-1].held is not None:
            done = pop()
            buffer = done.held
            if done.saved and not done.firm:
                flush()
                stack[-1].blocks = _both(stack[-1].blocks, done.saved)
                stack[-1].saved = _both(stack[-1].saved, done.saved)
            return
        flush()
        done = pop()
        up = stack[-1]
        if done.main:
            region = regions.pop()
            if draws:
                hashes.extend(region.drawn())
                if not (done.off or up.off):
                    regions[-1].keys += region.keys
            if not done.away:
                if not up.inside and done.blocks:
                    mains[up.outs] = _both(mains.get(up.outs), done.blocks)
                    up.saved = _both(up.saved, done.blocks)
                up.blocks = _both(up.blocks, done.blocks)
            return
        gone = done.away
        if hashed and not (done.off and done.inside) and done.tag not in TOP and done.sign:
            # Inside and outside of the main element a subtree is not the same.
            h = _hash("\x1f".join([*(["main"] if done.inside else []), done.tag, done.head, *done.sign]))
            kind = 0 if not done.inside else 2 if done.tag in PROSE and not done.head.strip() and (not done.blocks or done.blocks[0] < 2) else 1
            regions[-1].subtrees.append((h, done.first, len(regions[-1].keys), kind))
            up.sign.append(str(h))
            gone = gone or h in templates
        if not (done.away and done.firm):
            up.saved = _both(up.saved, done.saved)
            up.blocks = _both(up.blocks, done.saved if gone else done.blocks)

    at = 0
    tags = list(TAG.finditer(page))
    embedded = _embedded(tags)
    for m in tags:
        if m.start() < at:
            continue
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = embedded.get(m.start(), m.end())
        tag = m[3] or m[6]
        if not tag or tag.lower() in EMBEDDED:
            continue
        tag, ends, attrs = tag.lower(), bool(m[2] or m[5]), (m[4] or m[7] or "")
        if tag in INLINE and not (attrs and (_named(attrs) or _hidden(attrs))):
            if tag == "br":
                buffer.append(" ")
            if not ends or not places[tag]:
                continue
        if ends:
            if places[tag]:
                # Within the innermost main element, the end of an element around it is a stray.
                if main_at and tag not in TOP and tag not in MAIN and places[tag][-1] < main_at[-1]:
                    continue
                while stack[-1].tag != tag:
                    close()
                close()
            else:
                flush()
            continue
        if tag in VOID:
            flush()
            continue
        if tag in INLINE:
            push(_Element(tag, True, False, "", buffer, up=stack[-1], firm=_hidden(attrs)))
            buffer = []
            continue
        flush()
        if tag in CLOSES:
            closed, stops = CLOSES[tag]
            k = max(places[t][-1] if places[t] else 0 for t in closed)
            if k and k > max(places[t][-1] if places[t] else 0 for t in stops):
                while len(stack) > k:
                    close()
        last = standing[-1]
        if stack[last].tag == "p":
            while len(stack) > last:
                close()
        in_main = bool(main_at)
        head = (tag == "header" or bool(attrs) and _heads(attrs)) and not in_main
        firm = tag in DROPPED and tag != "form" or bool(attrs) and _hidden(attrs)
        away = firm or tag == "form" or head or bool(attrs) and _named(attrs)
        main = tag in MAIN or bool(attrs) and 'role="main"' in attrs.lower()
        if tag == "article":
            # A reader's comment may be an article of its own.
            away = bool(attrs) and _remark(attrs)
        elif main or tag in TOP:
            away = tag == "head"
        if tag in MAIN and in_main and places[tag]:
            main = False
        if main:
            regions.append(_Region())
        push(_Element(tag, away, main, attrs[:200], up=stack[-1], first=len(regions[-1].keys), firm=firm))
    if at < len(page):
        rest = page[at:]
        buffer.append(rest)
    while len(stack) > 1:
        close()
    flush()
    if draws:
        hashes.extend(regions[0].drawn())
        hashes = [(*found, found[2] > 0 or 0 not in mains) for found in hashes]
    whole, kept = _listed(root.blocks), _listed(root.saved)
    if not mains:
        return whole, hashes
    least = min(mains)
    chosen = _listed(mains[least])
    size = lambda blocks: sum(map(len, blocks))
    if least and size(chosen) < size(whole) - size(kept):
        return whole, hashes
    return chosen, hashes


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def keyed(pages: DataFrame) -> DataFrame:
    """``host``, ``page`` (by content) and ``html``."""
    html = text_of(F.col("html"))
    return pages.select(host_of(F.col("url")).alias("host"), F.xxhash64(html).alias("page"), html.alias("html"))


def subtrees(pages: DataFrame) -> DataFrame:
    """``host``, ``page``, ``subtree``, the ``block`` drawn outside of it, its ``kind``, and whether it can be ``used``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for host, page, html in zip(pdf["host"], pdf["page"], pdf["html"]):
                rows += [(host, page, *found) for found in set(parsed(html, draws=True)[1])]
            frame = pd.DataFrame(rows, columns=["host", "page", "subtree", "block", "kind", "used"])
            yield frame.assign(block=pd.array([r[3] for r in rows], "Int64"))

    return keyed(pages).mapInPandas(run, "host string, page bigint, subtree bigint, block bigint, kind int, used boolean")


def templates(held: DataFrame, pages: DataFrame, least: int = PAGES, share: float = SHARE) -> DataFrame:
    """``host`` and ``subtree`` of the templates; ``held`` are the subtrees of ``pages``."""
    marks = F.array_compact(F.array(
        F.when(F.col("block").isNotNull(), F.struct(F.lit(True).alias("drawn"), F.col("block").alias("of"))),
        F.when(F.col("kind") != 1, F.struct(F.lit(False).alias("drawn"), F.col("page").alias("of"))),
    ))
    key = ["host", "subtree", "kind"]
    # Most subtrees are rare; only the others go on to be counted by distinct marks.
    often = stage(held.groupBy(*key).agg(F.count("*").alias("rows")).where(F.col("rows") >= least).select(*key), "often")
    marked = held.join(often, key, "left_semi").select(*key, F.explode(marks).alias("mark")).distinct()
    counts = marked.groupBy(*key).agg(F.count_if("mark.drawn").alias("draws"), F.count_if(~F.col("mark.drawn")).alias("n"))
    counts = counts.where((F.col("draws") >= least) | (F.col("kind") == 0) & (F.col("n") >= least))
    size = keyed(pages).select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    enough = F.when(F.col("kind") == 2, F.col("n") >= MOST * F.col("pages")).otherwise(
        (F.col("draws") >= least) | (F.col("n") >= share * F.col("pages"))
    )
    return counts.join(size, "host").where(enough).select("host", "subtree").distinct()


def found(pages: DataFrame, least: int = PAGES, share: float = SHARE) -> DataFrame:
    """``host``, ``page`` and the template ``subtrees`` it holds, for pages that hold any."""
    held = stage(subtrees(pages), "subtrees")
    known = stage(templates(held, pages, least, share), "templates")
    rows = held.where("used").select("host", "page", "subtree").join(known, ["host", "subtree"], "left_semi")
    return rows.groupBy("host", "page").agg(F.collect_set("subtree").alias("subtrees"))


def extract(pages: DataFrame, least: int = PAGES, share: float = SHARE) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for held, page in zip(pdf["subtrees"], pdf["html"]):
                known = frozenset() if held is None else frozenset(int(h) for h in held)
                texts.append("\n".join(parsed(page, known)[0]))
            out = pdf[["page_id", "url"]].assign(text=texts)
            yield out.assign(n_chars=out["text"].map(len).astype("int64"), page_id=out["page_id"].astype("Int64"))

    slim = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        text_of(F.col("html")).alias("html"),
        host_of(F.col("url")).alias("host"),
    ).withColumn("page", F.xxhash64("html"))
    # Written first: its size decides the join, so pages are not shuffled while the table is small.
    rows = slim.join(stage(found(pages, least, share), "found"), ["host", "page"], "left")
    return rows.mapInPandas(run, "page_id bigint, url string, text string, n_chars bigint")
