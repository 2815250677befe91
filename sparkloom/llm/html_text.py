"""Main text of web pages by tag-path ratios (operator 11).

A page is read into blocks: text between block tags, each with its path of block
elements from root to leaf.  Per path the characters, the punctuation and the
characters inside links are added up; a path's ratios are its text and its
punctuation for every block on it.  Both are fused, with the share of text outside
links and with what elements say of themselves: menus, page headers, footers, sidebars,
notices, adverts, forms and readers' comments weigh nothing, nor does what lies outside
the article of a page that names one (``article``, else ``main``).  The fused ratios, in
page order, are smoothed by a Gaussian; paths whose mean reaches ``LAMBDA`` standard
deviations are content.

Content nodes are then told apart by place.  The region is the article that holds most
text of content paths, or, on pages that name none, the deepest element that holds
nearly all of it.  In an article every weighing block stays but those on paths of links
(menus without a name); elsewhere those on content paths and headings stay.

Pages are independent: each task parses its own batches, and ratios of all pages of
a batch are computed at once in arrays.  Nothing is shuffled; memory is that of
``SLICE_CHARS`` of pages, or of one longer page.

Edge cases: null and empty pages, and pages without content, give an empty text;
unclosed elements end where their parents end, unclosed scripts and comments at the
end; a ``<`` that begins no tag is text; repeated rows and null ids are kept, each row
by itself; extra columns are left out; no rows give no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.shared import unused

#: Paths below this many standard deviations of the smoothed ratios are no content.
LAMBDA = 0.8
#: Half width and spread of the smoothing, in blocks.
RADIUS = 1
#: The region holds this part of the text on content paths.
SHARE = 0.9
#: Articles with less than this part of the largest one's text are beside it.
BESIDE = 0.5
#: A path of so many blocks, with this part of its text in links, is a menu.
MENU = (3, 0.9)
SLICE_CHARS = 4 << 20

# element names of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes plaintext".split())
PHRASE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt rtc s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
EXCLUDED = frozenset("head nav header footer aside menu button select datalist fieldset noscript template svg canvas object audio video applet map dialog frameset".split())
#: Elements whose classes often say ``header`` or ``footer`` of their place in a text.
TEXTUAL = HEADINGS | frozenset("table caption thead tbody tfoot tr th td".split())
#: An opening tag ends these open elements (up to the nearest of the second list).
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "body": ({"head"}, set()),
}
#: Words of class and id that name what is no part of an article.
SAYS_OTHER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners promo promotion promotions sponsor sponsored sponsors teaser teasers widget widgets "
    "nav navbar navigation sidenav menu menus breadcrumb breadcrumbs crumbs pager pagination toc sitemap toolbar skip "
    "header masthead topbar logo footer foot colophon copyright imprint sidebar sidebars aside rail related recommended recommendations trending popular tags tagcloud "
    "notice notices cookie cookies consent gdpr privacy disclaimer alert popup modal overlay newsletter subscribe subscription signup login paywall "
    "comment comments commentlist disqus respond reply replies discussion share sharing social follow form search searchbox".split()
)
#: Of these, the ones that hold also for an article, and for what stands around one.
SAYS_BESIDE = frozenset("comment comments commentlist disqus respond reply replies related recommended teaser teasers sidebar sponsored".split())
#: After these a word names something absent or beside: ``with-sidebar``, ``no-comments``.
_BESIDE = frozenset("with has no without".split())
ROLES_OTHER = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+))""")
_ARTICLE = re.compile(r"""(?i)\b(?:role\s*=\s*["']?(?:main|article)\b|itemprop\s*=\s*["']?articlebody\b)""")
_CLASS = re.compile(r"""(?i)\bclass\s*=\s*["']?\s*([^\s"'>]+)""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_PUNCTUATION = re.compile(r"[.,;:!?…،。、，！？；：¿¡]")


@dataclass
class Element:
    """A block element: its parent's place, name, path, and what it says of itself."""

    parent: int
    name: str
    path: str
    article: bool
    #: 0: nothing; 1: that it is no content, unless an article stands in it; 2: that it is no content.
    other: int
    excluded: bool = False


@dataclass
class Block:
    element: int
    text: str
    linked: int


def says_other(name: str, attributes: str) -> int:
    """Whether name, class, id or role tell a part beside the article: 2 surely, 1 unless an article stands in it."""
    if name in EXCLUDED:
        return 2
    said = 1 if name == "form" else 0
    if "=" not in attributes or name in ("html", "body"):
        return said
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), html.unescape("".join(values))
        if key == "role" and value.lower() in ROLES_OTHER:
            said = max(said, 1)
        if key in ("class", "id"):
            for token in value.split():
                words = [w.lower() for w in _WORD.findall(token)]
                for k, w in enumerate([*words, "".join(words)]):  # side-bar is a sidebar
                    if w in SAYS_OTHER and not _BESIDE & set(words[:k]) and (w in SAYS_BESIDE or name not in TEXTUAL):
                        said = max(said, 2 if w in SAYS_BESIDE else 1)
    return said


def is_article(name: str, attributes: str) -> bool:
    return name in ("article", "main") or bool("=" in attributes and _ARTICLE.search(attributes))


def path_word(name: str, attributes: str) -> str:
    """An element's part of a path: its name and first class."""
    found = _CLASS.search(attributes) if "=" in attributes else None
    return f"{name}.{found[1]}" if found else name


def parse(page: str) -> tuple[list[Element], list[Block]]:
    """Block elements in opening order (the first is the root) and blocks of text in page order."""
    elements, blocks = [Element(-1, "", "", False, 0)], []
    stack: list[tuple[str, int]] = [("", 0)]  # name and, of block elements, place
    pieces: list[str] = []
    linked = links = at = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append(Block(owner(), text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def owner() -> int:
        return next(k for _, k in reversed(stack) if k >= 0)

    def say(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text)
            pieces.append(text)
            if links > 0:
                linked += len(text.strip())

    def close(names: set[str], until: set[str]) -> None:
        """Ends the nearest open element of these names, and all inside it, unless one of ``until`` is nearer."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                if any(place >= 0 for _, place in stack[k:]):
                    flush()
                del stack[k:]
                return
            if stack[k][0] in until:
                return

    end = len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        if not found:
            say(page[at:])
            break
        say(page[at : found.start()])
        at = found.end()
        name = found[2] or found[5]
        if not name:
            continue
        name, closing, attributes = name.lower(), bool(found[1] or found[4]), found[3] or found[6] or ""
        if closing:
            if name == "a":
                links = max(links - 1, 0)
            if name == "br":
                flush()
            elif name == "p" and all(n != "p" for n, _ in stack):
                flush()
            elif name in PHRASE:
                close({name}, {n for n, k in stack if k >= 0})
            else:
                close({name}, {"table"} if name in ("p", "div", "li") else set())
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at) if name != "plaintext" else None
            at = stop.end() if stop else end
            continue
        if name in VOID:
            if name in ("br", "hr"):
                flush()
            continue
        if name in PHRASE:
            if name == "a":
                links = 1
            if not attributes.rstrip().endswith("/"):
                stack.append((name, -1))
            continue
        flush()
        links = 0
        if name in CLOSES:
            inside, until = CLOSES[name]
            while any(n in inside for n, _ in stack) and _nearest(stack, inside, until):
                close(inside, until)
        if any(n == "p" for n, _ in stack) and _nearest(stack, {"p"}, {"table", "button", "object"}):
            close({"p"}, set())
        while stack[-1][1] < 0:  # phrases left open end with their block
            stack.pop()
        if attributes.rstrip().endswith("/") and name in ("svg", "canvas", "template"):
            continue
        up = stack[-1][1]
        article, said = is_article(name, attributes), says_other(name, attributes)
        elements.append(Element(up, name, f"{elements[up].path}/{path_word(name, attributes)}", article, said if said == 2 or not article else 0))
        stack.append((name, len(elements) - 1))
    flush()
    return elements, blocks


def _nearest(stack: list[tuple[str, int]], names: set[str], until: set[str]) -> bool:
    return next((n in names for n, _ in reversed(stack) if n in names or n in until), False)


def exclude(elements: list[Element]) -> None:
    """Decides which elements are no content: what they say holds for all inside them."""
    for e in elements[:0:-1]:
        if e.article and e.other < 2:  # what stands around an article is no menu, whatever it is called
            k = e.parent
            while k > 0 and elements[k].other < 2:
                elements[k].other = 0
                k = elements[k].parent
    inside = [False] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        up = elements[e.parent]
        inside[i] = inside[e.parent] or e.article
        e.excluded = up.excluded or e.other > 0
        if e.name in HEADINGS and "header" in up.path.rsplit("/", 1)[-1] and inside[i] and not elements[up.parent].excluded:
            e.excluded = False  # the article's own title


def articles(elements: list[Element], blocks: list[Block]) -> list[int]:
    """Outermost articles with text, or else main parts."""
    full = set()
    for b in blocks:
        k = b.element
        while k > 0 and not elements[b.element].excluded:
            full.add(k)
            k = elements[k].parent
    for kind in (lambda e: e.article and e.name != "main", lambda e: e.article):
        found: list[int] = []
        within = [False] * len(elements)
        for i, e in enumerate(elements[1:], 1):
            mine = kind(e) and i in full
            if mine and not within[e.parent]:
                found.append(i)
            within[i] = within[e.parent] or mine
        if found:
            return found
    return []


def inside(elements: list[Element], tops: list[int]) -> set[int]:
    found = set(tops)
    for i, e in enumerate(elements):
        if e.parent in found:
            found.add(i)
    return found


def ratios(pages: list[tuple[list[Element], list[Block], set[int]]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Which blocks of each page lie on content paths, and which on paths of links; pages: with the elements that may be content."""
    paths: dict[tuple[int, str], int] = {}
    path, page, chars, marks, linked, weight = [], [], [], [], [], []
    for k, (elements, blocks, may) in enumerate(pages):
        for b in blocks:
            path.append(paths.setdefault((k, elements[b.element].path), len(paths)))
            page.append(k)
            chars.append(len(b.text))
            marks.append(len(_PUNCTUATION.findall(b.text)))
            linked.append(b.linked)
            weight.append(float(b.element in may))
    if not path:
        return [(np.zeros(0, bool), np.zeros(0, bool)) for _ in pages]
    path, page, weight = np.array(path), np.array(page), np.array(weight)
    total = lambda x: np.bincount(path, np.array(x, float), len(paths))
    count, text = total(np.ones(len(path))), total(chars)
    links = total(linked) / text
    fused = (text / count) * (1 + total(marks) / count) * (1 - links)
    series = fused[path] * weight
    kernel = np.exp(-(np.arange(-RADIUS, RADIUS + 1) ** 2) / (2 * max(RADIUS, 1) ** 2))
    smooth, norm = np.zeros(len(series)), np.zeros(len(series))
    for shift, k in zip(range(-RADIUS, RADIUS + 1), kernel):  # neighbours of the same page
        i = np.arange(max(0, -shift), len(series) - max(0, shift))
        i = i[page[i] == page[i + shift]]
        smooth[i] += k * series[i + shift]
        norm[i] += k
    smooth /= norm
    smooth[weight == 0] = 0
    # threshold by page, over blocks that may be content
    may = weight > 0
    n = np.maximum(np.bincount(page[may], minlength=len(pages)), 1)
    mean = np.bincount(page[may], smooth[may], len(pages)) / n
    spread = np.sqrt(np.bincount(page[may], (smooth[may] - mean[page[may]]) ** 2, len(pages)) / n)
    level = np.bincount(path, smooth, len(paths)) / count
    chosen = may & (level[path] >= LAMBDA * spread[page]) & (level[path] > 0)
    menu = ((count >= MENU[0]) & (links >= MENU[1]))[path]
    cuts = np.cumsum(np.bincount(page, minlength=len(pages)))[:-1]
    return list(zip(np.split(chosen, cuts), np.split(menu, cuts)))


def region(elements: list[Element], blocks: list[Block], named: list[int], chosen: np.ndarray) -> set[int]:
    """Elements of the content region; named: the page's articles."""
    mass, own = [0] * len(elements), [0] * len(elements)
    for b, c in zip(blocks, chosen):
        if c:
            own[b.element] += len(b.text)
    for i in range(len(elements) - 1, -1, -1):
        mass[i] += own[i]
        if i:
            mass[elements[i].parent] += mass[i]
    if named:
        most = max(mass[i] for i in named)
        return inside(elements, [i for i in named if mass[i] >= BESIDE * most])
    best = 0
    for i, e in enumerate(elements[1:], 1):  # parents come before their children
        if e.parent == best and mass[i] >= SHARE * mass[0]:
            best = i
    up = elements[best].parent
    if up > 0 and elements[best].name != "body" and any(e.parent == up and e.name in HEADINGS for e in elements):
        best = up  # a title beside the text belongs to it
    return inside(elements, [best])


def extract(pages: list[str]) -> list[str]:
    """Main text of every page."""
    parsed, named = [], []
    for page in pages:
        elements, blocks = parse(page)
        exclude(elements)
        named.append(articles(elements, blocks))
        scope = inside(elements, named[-1]) if named[-1] else range(len(elements))
        parsed.append((elements, blocks, {i for i in scope if not elements[i].excluded}))
    out = []
    for (elements, blocks, may), tops, (chosen, menu) in zip(parsed, named, ratios(parsed)):
        near = region(elements, blocks, tops, chosen) & may
        stays = lambda b, c, link: not link if tops else c or elements[b.element].name in HEADINGS
        out.append(" ".join(b.text for b, c, link in zip(blocks, chosen, menu) if b.element in near and stays(b, c, link)))
    return out


def main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The rows without ``html_col`` but with ``text``, the main text (a column of that name is replaced)."""
    keep = [c for c in pages.columns if c.lower() not in (html_col.lower(), "text")]
    names, raw = [*keep, "text"], unused(pages, "__html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, size, held = 0, 0, []
            for k, page in enumerate(batch.column(0)):
                held.append(page.as_py())
                size += len(held[-1])
                if size >= SLICE_CHARS or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*(c.slice(begin, len(held)) for c in batch.columns[1:]), pa.array(extract(held), pa.string())], names)
                    begin, size, held = k + 1, 0, []

    kinds = dict(pages.dtypes)
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keep) + "text string"
    return pages.select(F.coalesce(F.col(html_col), F.lit("")).alias(raw), *keep).mapInArrow(run, schema)


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
