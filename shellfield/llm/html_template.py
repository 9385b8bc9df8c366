"""HTML main text by equivalence-class template deduction.

Pages of one host come from one template. The tokens of a block of pages are its elements, named by
their path, and its lines of text with their path; those with the same vector of occurrences over the
pages form a class. A class is valid if its tokens stand in one order on every page and do not cross
those of wider classes; valid classes nest into the template of the block. What is left between
its tokens are slots: lines that vary over the pages. Those inside the main container are the text of the article.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellfield.llm.common import stage

BLOCK_PAGES = 64
BLOCK_BYTES = 16 << 20
LEAST_PAGES = 8  # different pages that tell a template's lines from an article's

# Elements of HTML by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
CELLS = {"td", "th"}
NOT_TEXT = set(
    "head script style noscript template iframe svg math canvas audio video object nav footer aside form button select "
    "option input textarea menu dialog title xmp noembed noframes".split()
)
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup sidebar "
    "sidebars aside widget widgets related recommended share sharing social breadcrumb breadcrumbs pagination pager nav "
    "navbar navigation menu menus topbar footer foot masthead comment comments commentlist disqus reply replies respond "
    "skip login search".split()
)
# What a name says of the form of an element, not of its contents.
FORMS = set(
    "area bar block box button buttons container icons inner item items link links list panel section slot unit wrap wrapper "
    "articles posts stories content".split()
)
# Elements of running text: inside an article their names say nothing.
PROSE = set(
    "h1 h2 h3 h4 h5 h6 p pre blockquote table thead tbody tfoot tr td th caption figure figcaption dl dt dd li img hr br".split()
)
MAIN_NAMES = set("article content post entry story main".split())
# An element in the list is closed by the start of one in its set.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
             "th": {"td", "th", "tr"}, "option": {"option"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?[a-zA-Z][^\s>/]*(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>?", re.S
)
_NAME = re.compile(r"</?([a-zA-Z][^\s>/]*)")
_ATTRIBUTE = re.compile(r"([a-zA-Z][-\w:]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_MARKED = re.compile(r"\s(?:class|id|role|style|hidden|aria-hidden)\b", re.I)
_PART = re.compile(r"[a-z0-9]+")


class Element:
    """An element of a page: its name, path, attributes, parent and place."""

    __slots__ = ("name", "path", "parent", "attributes", "at", "holds_main")

    def __init__(self, name, path, parent, attributes, at):
        self.name, self.path, self.parent, self.attributes, self.at = name, path, parent, attributes, at
        self.holds_main = False


class Page:
    """Elements and texts of a page in order; unclosed elements end with the one around them."""

    def __init__(self, source: str):
        self.elements: list[Element] = []
        self.texts: list[tuple[Element | None, str, int]] = []  # element around, text, place
        self.breaks: list[int] = []  # places where a block starts or ends
        self.cells: list[int] = []
        self.has_main = False
        self.settle(None, None)
        stack: list[Element] = []
        at, place = 0, 0
        raw = None
        while at < len(source):
            if raw:  # up to its own end tag nothing else counts
                stop = re.compile(rf"</{raw}[\s/>]", re.I).search(source, at)
                at, raw = (stop.start() if stop else len(source)), None
                continue
            found = _TOKEN.search(source, at)
            text = source[at : found.start() if found else len(source)]
            place += 1
            if text:
                self.texts.append((stack[-1] if stack else None, text, place))
            if not found:
                break
            at = found.end()
            tag = found.group()
            name = _NAME.match(tag)
            if not name:
                continue
            name = name.group(1).lower()
            place += 1
            if name in CELLS:
                self.cells.append(place)
            elif name == "br" or name not in INLINE:
                (self.cells if name == "br" else self.breaks).append(place)
            if tag[1] == "/":
                if any(e.name == name for e in stack):
                    while stack.pop().name != name:
                        pass
                continue
            if name in INLINE and not _MARKED.search(tag):
                continue
            while stack and (name in CLOSED_BY.get(stack[-1].name, ()) or stack[-1].name == "p" and name not in INLINE):
                stack.pop()
            attributes = self._attributes(tag)
            names = sorted(c for c in _PART.findall(attributes.get("class", "").lower()) if not c.isdigit())
            parent = stack[-1] if stack else None
            path = (parent.path if parent else "") + "/" + ".".join([name, *names])
            element = Element(name, path, parent, attributes, place)
            if name in INLINE and not boilerplate(element):
                continue
            self.elements.append(element)
            if name in VOID or tag.endswith("/>"):
                continue
            stack.append(element)
            if name in ("article", "main") and not self.has_main and not boilerplate(element) and not any(
                e.name in NOT_TEXT for e in stack
            ):
                self.has_main = True
                for e in stack:
                    e.holds_main = True
            if name in RAW:
                raw = name

    @staticmethod
    def _attributes(tag: str) -> dict[str, str]:
        body = tag[1:].split(None, 1)
        if len(body) < 2:
            return {}
        return {m[0].lower(): entities.unescape(m[1] or m[2] or m[3]) for m in _ATTRIBUTE.findall(body[1])}

    def settle(self, container: str | None, repeated: set | None) -> None:
        """From now on the article is in ``container``; ``repeated`` are the kinds that the template repeats, if it is known."""
        self._container = container if container and container.rpartition("/")[2].split(".")[0] not in ("html", "body") else None
        self._repeated = repeated
        self._dropped: dict[Element, bool] = {}
        self._inside: dict[Element, bool] = {}

    def _in_article(self, element: Element | None) -> bool:
        if element is None or self._container is None:
            return False
        known = self._inside.get(element)
        if known is None:
            known = self._inside[element] = element.path == self._container or self._in_article(element.parent)
        return known

    def dropped(self, element: Element | None) -> bool:
        """Whether an element or one around it holds no article text."""
        if element is None:
            return False
        known = self._dropped.get(element)
        if known is None:
            inside = self._in_article(element.parent)
            own = foreign(element, self._repeated) if inside else boilerplate(element)
            known = self._dropped[element] = own or self.dropped(element.parent)
        return known


def kind_of(element: Element) -> tuple[str, str]:
    """What tells elements of one kind over the pages of a host: the path, and the id without numbers."""
    return element.path, re.sub(r"\d+", "", element.attributes.get("id", "")).lower()


def repeated_kinds(pages: list[Page]) -> set[tuple[str, str]]:
    """The kinds of elements that at least half of the pages have, and two at least."""
    support = Counter(kind for page in pages for kind in {kind_of(e) for e in page.elements})
    return {kind for kind, n in support.items() if 2 * n >= len(pages) and n > 1}


def _whole_name(token: str) -> bool:
    parts = set(re.findall(r"[a-z]+", token))
    return bool(parts & NAMES) and parts <= NAMES | FORMS


def foreign(element: Element, repeated: set | None) -> bool:
    """Whether an element inside the article's container is none of its text.

    By name it is if a whole class or id says so and the template repeats the element; a page
    without others to hold it against goes by its classes alone. Names of headings, paragraphs and the like do not count.
    """
    if _boilerplate_by_role(element):
        return True
    if element.name in PROSE or element.holds_main or element.name in ("html", "body", "main", "header"):
        return False
    a = element.attributes
    if repeated is None:
        return any(map(_whole_name, a.get("class", "").lower().split()))
    return kind_of(element) in repeated and any(map(_whole_name, f"{a.get('class', '')} {a.get('id', '')}".lower().split()))


def _names(element: Element) -> set[str]:
    return set(_PART.findall((element.attributes.get("class", "") + " " + element.attributes.get("id", "")).lower()))


def _boilerplate_by_role(element: Element) -> bool:
    a = element.attributes
    if element.name in NOT_TEXT or a.get("role", "").lower() in ROLES:
        return True
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return True
    return bool(re.search(r"display\s*:\s*none", a.get("style", ""), re.I))


def boilerplate(element: Element) -> bool:
    """Whether an element outside of an article holds none of its text, by its role and parts of its names."""
    if _boilerplate_by_role(element):
        return True
    if element.name in ("html", "body", "article", "main") and not _names(element) & {"comment", "comments"}:
        return False
    if element.name == "header":
        return not any(e in element.path.split("/") for e in ("article", "main"))
    return not element.holds_main and bool(_names(element) & NAMES)


def _ordered(members: list, pages: list[dict]) -> list:
    """The most tokens that follow each other in one order on all pages, each there once; ``pages`` give their places."""
    at = np.array([[page[m] for m in members] for page in pages])
    members, at = [members[i] for i in np.argsort(at[0])], at[:, np.argsort(at[0])]
    length, before = np.ones(len(members), np.int64), np.full(len(members), -1)
    for j in range(1, len(members)):
        fits = np.flatnonzero((at[:, :j] < at[:, j : j + 1]).all(axis=0))
        if len(fits):
            before[j] = fits[np.argmax(length[fits])]
            length[j] = length[before[j]] + 1
    j, chain = int(np.argmax(length)), []
    while j >= 0:
        chain.append(members[j])
        j = before[j]
    return chain[::-1]


def _nests(inner: list[np.ndarray], outer: list[np.ndarray]) -> bool:
    """Whether all rounds of ``inner`` (rounds x members, for each page) lie in one slot of ``outer``."""
    slots = set()
    for rounds, around in zip(inner, outer):
        if not len(rounds) or not len(around):
            continue
        gap = np.searchsorted(around.ravel(), rounds)
        if (gap != gap[:, :1]).any():
            return False
        # In front of the first, between two rounds and behind the last is outside.
        slots.update((gap[:, 0] % around.shape[1]).tolist())
    return len(slots) <= 1


def token_classes(sequences: list[list]) -> list[list]:
    """The template of pages given as token sequences: valid nested classes of equal occurrence vectors, the widest first.

    A class is kept if at least half of the pages have it, its tokens follow each other in one order
    wherever they occur, and it does not cross a wider class. Of tokens that pages have once, those out of order go.
    """
    counts = [Counter(tokens) for tokens in sequences]
    support = Counter(t for counter in counts for t in counter)
    common = {t for t, n in support.items() if 2 * n >= len(sequences)}
    vectors = {t: np.zeros(len(sequences), np.int32) for t in common}
    for i, counter in enumerate(counts):
        for t, n in counter.items():
            if t in common:
                vectors[t][i] = n
    classes: dict[bytes, list] = defaultdict(list)
    for t, vector in vectors.items():
        classes[vector.tobytes()].append(t)
    group = {t: key for key, members in classes.items() if len(members) > 1 for t in members}
    places: dict[bytes, list[list]] = {key: [[] for _ in sequences] for key in set(group.values())}
    for i, tokens in enumerate(sequences):
        for at, t in enumerate(tokens):
            if t in group:
                places[group[t]][i].append((at, t))
    valid: list[tuple[list, list[np.ndarray]]] = []
    single = []
    for key, members in classes.items():
        if len(members) == 1:
            single.append(members)  # a point crosses nothing
            continue
        n = len(members)
        vector = np.frombuffer(key, np.int32)
        rows = places[key]
        orders = {tuple(t for _, t in row[i : i + n]) for row in rows for i in range(0, len(row), n)}
        if len(orders) == 1:
            chain = list(orders.pop())
        elif vector.max() == 1:
            chain = _ordered(members, [{t: at for at, t in row} for row in rows if row])
        else:
            continue
        inside = set(chain)
        valid.append((chain, [np.array([at for at, t in row if t in inside], np.int64).reshape(-1, len(chain)) for row in rows]))
    nested: list[tuple[list, list[np.ndarray]]] = []
    for chain, at in sorted(valid, key=lambda v: -len(v[0])):
        if all(_nests(at, other) or _nests(other, at) for _, other in nested):
            nested.append((chain, at))
    return sorted([chain for chain, _ in nested] + single, key=len, reverse=True)


def equivalence_classes(pages: list[Page]) -> list[list[str]]:
    """Paths of the elements of the pages' template, by class; the widest class comes first."""
    return token_classes([[e.path for e in page.elements] for page in pages])


def _different(pages: list[list[tuple[str, str]]]) -> list[int]:
    """Pages of which no two share more than half of the shorter one's text: copies do not make an article a template."""
    kept: list[tuple[int, dict, int]] = []
    for i, lines in enumerate(pages):
        own = {t: len(t[1]) for t in lines}
        total = sum(own.values())
        if total and all(2 * sum(own[t] for t in own.keys() & o.keys()) <= min(total, n) for _, o, n in kept):
            kept.append((i, own, total))
    return [i for i, _, _ in kept]


def template_lines(pages: list[Page], container: str | None) -> set[tuple[str, str]]:
    """(path, text) of the lines inside the container that belong to the template; all others are slots."""
    lines = [page_lines(page, container) for page in pages]
    chosen = _different([[(path, text) for _, path, text in rows] for rows in lines])
    if len(chosen) < LEAST_PAGES:
        return set()
    sequences = []
    for i in chosen:
        tokens = [(e.at, e.path) for e in pages[i].elements] + [(at, (path, text)) for at, path, text in lines[i]]
        sequences.append([t for _, t in sorted(tokens, key=lambda x: x[0])])
    return {t for members in token_classes(sequences) for t in members if isinstance(t, tuple)}


def main_path(pages: list[Page]) -> str | None:
    """The path of the template's main container: the slot that holds the article.

    Of the template's containers outside of menus and the like, an article or main element, else one that is named
    like content, else the one with the most words in it that no other has; the outermost of its kind.
    """
    if len(pages) > 1:
        template = [path for group in equivalence_classes(pages) for path in group]
    else:  # one page has no template
        template = list({e.path: None for e in pages[0].elements})
    first: dict[str, Element] = {}
    words: Counter = Counter()
    for page in pages:
        for e in page.elements:
            if not page.dropped(e):
                first.setdefault(e.path, e)
        for element, text, _ in page.texts:
            if element is not None and not page.dropped(element):
                n = len(text.split())
                e = element
                while e is not None:
                    words[e.path] += n
                    e = e.parent
    open_paths = [p for p in template if p in first]

    def best(paths):
        return min(paths, key=lambda p: (p.count("/"), -words[p], p), default=None)

    for kind in ({"article"}, {"main"}):
        found = best([p for p in open_paths if first[p].name in kind and words[p]])
        if found:
            return found
    named = [p for p in open_paths if _names(first[p]) & MAIN_NAMES and first[p].name in ("div", "section", "td")]
    total = max((words[p] for p in open_paths), default=0)
    named = [p for p in named if 2 * words[p] >= total]
    return best(named) or best([p for p in open_paths if first[p].name == "body"])


def page_lines(page: Page, container: str | None) -> list[tuple[int, str, str]]:
    """(place, path, text) of the lines inside the container, one for each block."""
    inside: dict[Element, bool] = {}

    def within(e):
        if e is None:
            return container is None
        if e not in inside:
            inside[e] = container is None or e.path == container or within(e.parent)
        return inside[e]

    marks = [(at, None, "\n") for at in page.breaks] + [(at, None, " ") for at in page.cells]
    chosen = [
        (at, e.path if e else "", "\0" + entities.unescape(text))
        for e, text, at in page.texts
        if within(e) and not page.dropped(e)
    ]
    if not chosen:
        return []
    lines, words, first = [], [], None
    for at, path, text in [*sorted(marks + chosen, key=lambda x: x[0]), (0, None, "\n")]:
        if text == "\n":
            line = " ".join("".join(words).split())
            if line:
                lines.append((*first, line))
            words, first = [], None
        else:
            words.append(text[1:] if text != " " else " ")
            if first is None and text[1:].strip():
                first = (at, path)
    return lines


def main_text(page: Page, container: str | None, template: set[tuple[str, str]] = frozenset()) -> str:
    """Text of the slots inside the container, one line for each block."""
    return "\n".join(text for _, path, text in page_lines(page, container) if (path, text) not in template)


def has(page: Page, container: str | None) -> bool:
    return container is not None and any(e.path == container for e in page.elements)


def extract_block(sources: list[str | None]) -> list[str]:
    """Main texts of pages of one host, by the template they share."""
    pages = [Page(s or "") for s in sources]
    container = main_path([p for p in pages if p.elements]) if any(p.elements for p in pages) else None
    # A page without the container of its template, or with an article where that has none, has one of its own.
    fits = [
        has(page, container) and (not page.has_main or container.rpartition("/")[2].startswith(("article", "main")))
        for page in pages
    ]
    fitting = [page for page, fit in zip(pages, fits) if fit]
    repeated = repeated_kinds(fitting) if len(fitting) > 1 else None
    own = {}
    for i, page in enumerate(pages):
        own[i] = container if fits[i] else main_path([page])
        page.settle(own[i], repeated if fits[i] else None)
    template = template_lines(fitting, container)
    return [main_text(page, own[i], template if fits[i] else frozenset()) for i, page in enumerate(pages)]


def _extract(table: pa.Table) -> pa.Table:
    texts = extract_block(table.column("html").to_pylist())
    return pa.table(
        {
            "page_id": table.column("page_id"),
            "url": table.column("url"),
            "text": pa.array(texts, pa.string()),
            "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        }
    )


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][-+.A-Za-z0-9]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract_main_text(pages: DataFrame, block_pages: int = BLOCK_PAGES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages(page_id, url, html)``.

    text is the article: character references are decoded, blanks inside a block become one, blocks
    are joined by a line break in page order. Menus, headers and footers of the page, sidebars,
    notices, adverts, forms, scripts, styles and comments of readers are left out, and so are whole lines
    of the template: those that at least half of a block's different pages have (eight pages at least).

    Defined cases: null and empty pages, and pages without an article's text, give an empty text.
    A null url, or one without a host, belongs to the host with the empty name. Repeated rows are extracted each. Cut pages
    end where they end. Other columns are ignored.

    Scale: a host's pages are dealt into blocks of about ``block_pages`` by hash, each with a template of
    its own, so one host may have all pages. Pages are moved once; page counts of hosts are
    summed before the shuffle and joined by size.
    """
    named = pages.select(
        F.col("`page_id`").cast("long").alias("page_id"), F.col("`url`").alias("url"), F.col("`html`").alias("html")
    ).withColumn("host", host_of(F.col("url")))
    sizes = named.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("b"))
    blocks = F.greatest(
        F.ceil(F.col("n") / block_pages), F.ceil(F.coalesce("b", F.lit(0)) / block_bytes), F.lit(1)
    ).cast("long")
    sizes = stage(sizes.select("host", blocks.alias("blocks")), "hosts")
    dealt = named.join(sizes, "host").withColumn("block", F.pmod(F.xxhash64("page_id", "url"), F.col("blocks")))
    return dealt.groupBy("host", "block").applyInArrow(_extract, "page_id long, url string, text string, n_chars long")
