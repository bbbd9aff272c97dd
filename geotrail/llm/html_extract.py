"""Main text of HTML pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. A word scores by where it stands: from
a logistic model on the kinds of elements around it, 2p - 1 if it is rather
content (p > 1/2), else zero. A tag scores below zero, the more so the
less often it occurs inside content; a tag inside the main element of a page,
inside surroundings or inside a data table scores zero, so nothing of an article
is lost to its pictures, rules and links. Both weights are fitted on labelled pages. One linear scan finds the contiguous stretch with the highest sum.
Within it, words that score zero (an advert or a form in the middle of an
article) are left out.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geotrail.llm.labelled_pages import PAGES

# --- fixed values: kinds of elements ---------------------------------------

BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt
fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav
ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template textarea iframe svg math object title head select".split())
TO_THE_END = frozenset("script style textarea".split())     # without an end tag they hold the rest of the page
FLAT = frozenset("title head".split())                      # end at the first end tag; the others may be nested
SHOWN = frozenset("noscript svg math object iframe".split())    # skipped outside the article only
MAY_BE_EMPTY = frozenset("svg math iframe object".split())  # with a slash at the end
# an open element that ends when one of these starts
ENDED_BY = {"p": BLOCKS - {"body", "html", "head", "option", "legend", "caption", "summary"},
            "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
            "td": frozenset({"td", "th", "tr", "tbody"}), "th": frozenset({"td", "th", "tr", "tbody"}),
            "tr": frozenset({"tr", "tbody", "tfoot"}), "option": BLOCKS}
SCOPES = frozenset("""article aside body div footer form header html main nav section table td th ul ol
noscript svg math object""".split())

# kinds of surroundings: by tag name, and by words in class, id or role
BY_TAG = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "form": "form",
          "button": "form", "label": "form", "fieldset": "form", "option": "form", "dialog": "notice", "address": "footer",
          "article": "main", "main": "main", "a": "link", "li": "item", "dd": "item", "dt": "item", "td": "cell",
          "th": "cell", "p": "para", "blockquote": "para", "pre": "para", "figcaption": "para",
          **{f"h{i}": "heading" for i in range(1, 7)}}
BY_WORD = {
    "menu": "menu navbar navigation nav breadcrumb breadcrumbs topbar pagination pager toc tabs skip",
    "header": "header masthead",
    "footer": "footer copyright colophon contentinfo",
    "sidebar": "sidebar widget related recommended recommendations popular trending rail more-stories complementary",
    "notice": "notice cookie cookies consent gdpr alert banner popup modal overlay paywall warning disclaimer",
    "ad": "ad ads adsbygoogle adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion commercial",
    "form": "form newsletter subscribe subscription signup login search feedback",
    "comment": "comment comments commentlist respond response responses disqus reply replies discussion reviews",
    "share": "share sharing social follow tags byline meta",
    "main": "article main content post entry story maincontent",
}
HINTS = {w: kind for kind, words in BY_WORD.items() for w in words.split()}
# words that also name parts of an article: inside one they need a second sign
AMBIGUOUS = frozenset("""skip tabs toc menu header footer popular trending notice alert banner warning disclaimer
promotion commercial search feedback subscription response discussion reviews reply replies respond social follow
response responses tags byline meta""".split())
# words that say nothing against a hint beside them: "related-posts", but not "related-work"
NEUTRAL = frozenset("""site page pages main post posts entry entries article articles content story stories area section
inner outer wrap wrapper container box block bar list item items group left right top bottom upper lower primary
secondary global local sub col column row panel pane region holder module unit slot link links btn button buttons icon
icons thread body head""".split())
KINDS = ("main", "para", "heading", "item", "cell", "link", "hint", "menu", "header", "footer", "sidebar", "notice", "ad",
         "form", "comment", "share")
BIT = {k: 1 << i for i, k in enumerate(KINDS)}
AROUND = sum(BIT[k] for k in KINDS[7:])     # surroundings, not content

TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
                   r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden|data-main)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""",
                       re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
ABOUT_LAYOUT = frozenset("has no not with without is".split())      # "no-sidebar" is not a sidebar
WHOLE_PAGE = frozenset("html body main".split())                    # never surroundings themselves
CLOSED = frozenset("nav aside footer dialog menu button label address".split())     # never wrappers of a page
TABLE = frozenset("table caption colgroup col thead tbody tfoot tr td th".split())
LANDMARKS = frozenset("h1 header nav footer".split())
SIDES, COLUMNS = frozenset("left right".split()), frozenset("col column columns pane panel rail side".split())
# a heading over reader comments, without its marks and numbers
COMMENT_HEADING = re.compile(r"(?:reader |user |all )?comments?|(?:leave|post|add|write) a (?:comment|reply)")
COUNTED_HEADING = re.compile(r"(?:\d+|no|one) (?:comments?|responses?|replies|reply)\b.*|(?:comments?|responses|replies) \(?\d+\)?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


# --- page -> sequence ------------------------------------------------------

class Node:
    """An element: its kinds by tag, and what class, id and role hint at."""

    __slots__ = ("parent", "name", "tag", "main", "sure", "whole", "weak", "named", "named_weak", "part", "hidden", "marked",
                 "words", "links", "holds", "section", "landmark", "wraps", "layout", "extra", "article")

    def __init__(self, parent: int, name: str, attributes: str, hidden: bool, marked: bool):
        self.parent, self.name, self.hidden, self.marked = parent, name, hidden, marked
        kind = BY_TAG.get(name)
        self.tag = BIT[kind] if kind else 0
        # hints of a role; of a whole class, clear or ambiguous; of a whole id; of one part among other words
        self.main = self.sure = self.whole = self.weak = self.named = self.named_weak = self.part = 0
        self.words = self.links = self.article = 0      # article: words of the longest article among its children
        self.section = name == "section"
        self.landmark, self.wraps = name in LANDMARKS, False
        self.extra = False      # left out, except in an article
        self.layout = False     # holds blocks other than the parts of a table
        for m in ATTRIBUTE.finditer(attributes or ""):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key in ("class", "id", "role"):
                for token in value.split():
                    self.section |= token == "section"
                    self._hint(key, token)
            elif key == "data-main":
                self.marked = True
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (
                    key == "style" and HIDDEN.search(value)):
                self.hidden = True
        if name in WHOLE_PAGE:
            self.sure = self.whole = self.weak = self.named = self.named_weak = self.part = 0
        if name in ("html", "body"):
            self.main = 0
        self.holds = bool((self.tag | self.main) & BIT["main"])

    def _hint(self, key: str, token: str) -> None:
        words = [w.lower() for w in WORDS.findall(token)]
        if not words or words[0] in ABOUT_LAYOUT:
            return
        found = [w for w in words if w in HINTS]
        self.main |= BIT["main"] if any(HINTS[w] == "main" for w in found) else 0
        found = [w for w in found if HINTS[w] != "main"]
        if not found and SIDES & set(words) and COLUMNS & set(words):
            self.part |= BIT["sidebar"]
        kinds = sum(BIT[k] for k in {HINTS[w] for w in found})
        if not all(w in HINTS or w in NEUTRAL for w in words):
            self.part |= kinds
        elif key == "role":
            self.sure |= kinds
        elif len(words) == 1 and words[0] in AMBIGUOUS:
            if key == "id":
                self.named_weak |= kinds
            else:
                self.weak |= kinds
        elif key == "id":
            self.named |= kinds
        else:
            self.whole |= kinds


def _own(v: Node, up: Node, inside: int, page_has_main: bool) -> int:
    """Kinds of an element whose surroundings have the kinds ``inside``.

    A hint makes an element surroundings if it is a role or a whole class or
    id; an id of a section, an ambiguous word inside an article, a part of a
    name, and any hint on a heading or on inline elements of a paragraph
    do so only with a second sign: mostly links, beside an article of some length, or outside
    the article of a page that has one. Without it, it is the kind "hint"."""
    in_main = inside & BIT["main"]
    beside = up.article * 4 > v.words and not v.holds
    firm, loose = v.sure | v.whole, v.weak | v.named | v.named_weak | v.part
    if not in_main:
        firm |= v.weak
    if not v.section:       # generators name sections by their headings
        firm |= v.named if in_main else v.named | v.named_weak
    if v.tag & BIT["heading"] or (v.name not in BLOCKS and inside & BIT["para"]):
        firm, loose = v.sure, loose | firm
    loose &= ~firm
    if loose and not v.tag & BIT["heading"]:
        if v.links * 2 >= v.words > 0 or beside or (page_has_main and not in_main and not v.holds):
            firm, loose = firm | loose, 0
    own = v.tag | v.main | firm | (BIT["hint"] if loose else 0)
    if in_main:
        own &= ~(BIT["header"] | BIT["share"])      # the heading of an article; its byline, tags and share links
    if v.wraps:
        own &= ~AROUND
    if own & AROUND:
        own &= ~BIT["main"]
    return own


def _mark_wrappers(nodes: list[Node]) -> None:
    """Find the elements that are wrapped around the main text.

    These are never surroundings, whatever their tag or name (a form around
    the page, "content-sidebar-wrap"); what lies in them is judged by its own
    marks. They are what is around a main element, around the article with the most
    words (not one in a box, if more words stand outside all boxes), and, without
    any, an element with a heading or menu that has half of the page's words."""
    comment = BIT["comment"]
    best, shut, inner, boxed = 0, [False], [False], [False]
    plain = nodes[0].words          # words outside everything that has a mark
    for i, v in enumerate(nodes[1:], 1):
        hints = v.sure | v.whole | v.weak | v.named | v.named_weak
        boxed.append(boxed[v.parent] or bool((v.tag | hints) & AROUND))
        if boxed[i] and not boxed[v.parent]:
            plain -= v.words
        # not a candidate: what is in a box that cannot be a wrapper, or in a list of comments
        shut.append(shut[v.parent] or v.name in CLOSED or bool(hints & comment))
        main = (v.tag | v.main) & BIT["main"] and not hints & AROUND and not shut[i]
        if v.name == "main":
            _wrap(nodes, v.parent)
        elif main and not inner[v.parent] and v.words > (nodes[best].words if best else 0):
            best = i
        inner.append(inner[v.parent] or bool(main))
    if best and not (boxed[best] and nodes[best].words < plain):
        _wrap(nodes, nodes[best].parent)
    else:
        for i, v in enumerate(nodes[1:], 1):
            v.wraps |= (v.landmark and v.name not in LANDMARKS and not shut[i]
                        and v.words * 2 >= nodes[0].words > 0)


def _wrap(nodes: list[Node], i: int) -> None:
    while i and not nodes[i].wraps:
        nodes[i].wraps = True
        i = nodes[i].parent


def _mark_comment_lists(nodes: list[Node], events: list[tuple]) -> None:
    """What follows a heading such as "12 Comments", up to the next heading of its
    parent, holds reader comments (unless it is the main element)."""
    said: dict[int, list[str]] = {}
    for kind, value, v, _ in events:
        while kind == "text" and v:
            if nodes[v].tag & BIT["heading"]:
                said.setdefault(v, []).append(value)
                break
            v = nodes[v].parent if nodes[v].name not in BLOCKS else 0
    over = {}       # parent -> the comments' heading that its next children stand under
    for i, v in enumerate(nodes[1:], 1):
        if v.tag & BIT["heading"]:
            text = " ".join(html.unescape("".join(said.get(i, ()))).lower().split()).strip(" .:;!?-")
            over[v.parent] = bool(COMMENT_HEADING.fullmatch(text) or COUNTED_HEADING.fullmatch(text))
            if over[v.parent]:
                v.sure |= BIT["comment"]
        elif over.get(v.parent) and v.name in BLOCKS and not (v.tag | v.main) & BIT["main"]:
            v.sure |= BIT["comment"]


def _mark_titles(nodes: list[Node], kinds: list[int]) -> None:
    """An h1 right before the main element is the title of its text."""
    last: dict[int, int] = {}       # parent -> its latest child
    for i, v in enumerate(nodes[1:], 1):
        j = last.get(v.parent, 0)
        if (v.tag | v.main) & kinds[i] & BIT["main"] and j and nodes[j].name == "h1" and not kinds[j] & AROUND:
            kinds[j] |= BIT["main"]
        last[v.parent] = i
    for i, v in enumerate(nodes[1:], 1):       # what is in the title
        if nodes[v.parent].name == "h1":
            kinds[i] |= kinds[v.parent] & BIT["main"]


def _resolve(nodes: list[Node]) -> list[int]:
    """Kinds of every node, its own and those of the elements around it."""
    for v in reversed(nodes[1:]):
        up = nodes[v.parent]
        up.words += v.words
        if v.name == "article":
            up.article = max(up.article, v.words)
        up.links += v.words if v.name == "a" else v.links
        up.holds |= v.holds
        up.landmark |= v.landmark
        up.layout |= v.layout or v.name == "table" or (v.name in BLOCKS and v.name not in TABLE)
    _mark_wrappers(nodes)
    kinds = [0]
    for v in nodes[1:]:
        kinds.append(kinds[v.parent] | _own(v, nodes[v.parent], kinds[v.parent], nodes[0].holds))
    _mark_titles(nodes, kinds)
    return kinds


def _free(nodes: list[Node], kinds: list[int]) -> list[bool]:
    """Nodes whose tags cost nothing: inside the main element or a data table.
    The element's own end tag stands for all of them."""
    free = [False]
    for i, v in enumerate(nodes[1:], 1):
        data = v.name == "table" and not v.layout and v.links * 2 < max(1, v.words)
        free.append(free[v.parent] or data or bool(kinds[i] & BIT["main"]))
    return free


def tokens(page: str) -> Iterator[tuple]:
    """('tag', '+name' or '-name', kinds, block number, costs nothing) and
    ('text', raw text, kinds, block number, marked)."""
    nodes, events = _parse(page)
    _mark_comment_lists(nodes, events)
    kinds = _resolve(nodes)
    free = _free(nodes, kinds)
    extra = [False]
    for i, v in enumerate(nodes[1:], 1):
        extra.append(extra[v.parent] or (v.extra and not kinds[i] & BIT["main"]))
    for kind, value, v, block in events:
        if kind == "tag":
            yield kind, value, kinds[v], block, free[v] or extra[v]
        elif not extra[v]:
            yield kind, value, kinds[v], block, nodes[v].marked


def _ends(page: str, name: str) -> dict[int, int]:
    """Start of each element ``name`` that has an end tag -> where that ends."""
    tag = re.compile(rf"""<!--(?:.*?-->|.*)|<(?P<raw>script|style|textarea)\b[^>]*>(?:.*?</(?P=raw)\b|.*)"""
                     rf"""|<(?P<close>/?){re.escape(name)}(?=[\s/>])(?:(?P<a>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(?P<b>[^>]*)>?)""",
                     re.S | re.I)
    ends, pending = {}, []
    for m in tag.finditer(page):
        if m["close"] is None:
            continue
        if not m["close"]:
            if not (name in MAY_BE_EMPTY and (m["a"] or m["b"] or "").endswith("/")):
                pending.append(m.start())
        elif pending:
            for start in pending if name in FLAT else pending[-1:]:
                ends[start] = m.end()
            del pending[0 if name in FLAT else -1:]
    return ends


class OpenElements:
    """The stack of open elements, with the places of each name, of blocks and of scopes,
    so that a stray end tag or a new block need not search through it."""

    def __init__(self) -> None:
        self.names: list[str] = [""]
        self.nodes: list[int] = [0]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.scopes: list[int] = []

    @property
    def top(self) -> int:
        return self.nodes[-1]

    def push(self, name: str, node: int) -> None:
        at = len(self.names)
        self.names.append(name)
        self.nodes.append(node)
        self.places.setdefault(name, []).append(at)
        if name in BLOCKS:
            self.blocks.append(at)
        if name in SCOPES:
            self.scopes.append(at)

    def _pop_to(self, at: int) -> None:
        while len(self.names) > at:
            self.nodes.pop()
            self.places[self.names.pop()].pop()
        for places in (self.blocks, self.scopes):
            while places and places[-1] >= at:
                places.pop()

    def close(self, name: str) -> None:
        """The innermost ``name`` ends, and with it all that is open in it; an element
        that is no scope is not sought outside the innermost scope."""
        at = (self.places.get(name) or [0])[-1]
        if at and (name in SCOPES or not self.scopes or at > self.scopes[-1]):
            self._pop_to(at)

    def make_room(self, name: str) -> None:
        """Elements that the start of ``name`` ends."""
        while len(self.names) > 1 and name in ENDED_BY.get(self.names[-1], ()):
            self._pop_to(len(self.names) - 1)
        if name in BLOCKS and self.blocks:      # an open paragraph ends, whatever inline elements it left open
            if name in ENDED_BY.get(self.names[self.blocks[-1]], ()):
                self._pop_to(self.blocks[-1])


def _parse(page: str) -> tuple[list[Node], list[tuple]]:
    """Elements in page order (the first stands for the page), and ('tag' or
    'text', value, number of the element, block number)."""
    nodes, events = [Node(0, "", "", False, False)], []
    open_ = OpenElements()
    known_ends: dict[str, dict[int, int]] = {}
    at, block, n = 0, 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at:
            events.append(("text", page[at:end], open_.top, block))
            if not nodes[open_.top].hidden:
                nodes[open_.top].words += len(page[at:end].split())
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attributes = name.lower(), bool(m[1] or m[4]), (m[3] if m[2] else m[6])
        shown = False
        if name in SKIPPED and not closing:
            if name in MAY_BE_EMPTY and attributes.endswith("/"):
                continue
            if name in TO_THE_END:
                stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                stop = stop.end() if stop else n
            else:
                if name not in known_ends:
                    known_ends[name] = _ends(page, name)
                stop = known_ends[name].get(m.start())
            if stop and name in SHOWN:
                shown = True
            elif stop:      # without an end tag its words are words of the page
                at = stop
                block += 1
                continue
        if name in BLOCKS:
            block += 1
        if closing:
            open_.close(name)
        else:
            open_.make_room(name)
            if name not in VOID and not attributes.endswith("/"):
                up = nodes[open_.top]
                nodes.append(Node(open_.top, name, attributes, up.hidden, up.marked))
                nodes[-1].extra = shown or nodes[-1].hidden
                open_.push(name, len(nodes) - 1)
        events.append(("tag", ("-" if closing else "+") + name, open_.top, block))
        if name in ("br", "text"):      # a line; a label in an svg
            events.append(("text", " ", open_.top, block))
    return nodes, events


# --- weights ---------------------------------------------------------------

class Weights:
    """word: kinds of surroundings -> score; tag: '+name' -> score (< 0)."""

    def __init__(self, bias: float, kinds: np.ndarray, tags: dict[str, float], other_tag: float):
        self.bias, self.kinds, self.tags, self.other_tag = bias, kinds, tags, other_tag
        self.seen: dict[int, float] = {}

    def word(self, mask: int) -> float:
        if mask not in self.seen:
            p = 1 / (1 + np.exp(-(self.bias + _features(mask) @ self.kinds)))
            self.seen[mask] = max(0.0, float(2 * p - 1))
        return self.seen[mask]

    def tag(self, name: str, mask: int = 0, free: bool = False) -> float:
        if free or (mask & AROUND and self.word(mask) == 0):
            return 0.0
        return self.tags.get(name, self.other_tag)


def _features(mask: int) -> np.ndarray:
    return np.array([float(bool(mask & BIT[k])) for k in KINDS] + [float(bool(mask & AROUND))])


def fit_weights(pages=PAGES, steps: int = 400, rate: float = 0.5, ridge: float = 0.002) -> Weights:
    """Logistic regression of content words, and log ratios of tags.

    pages: HTML whose content elements carry the attribute data-main. Words
    are counted by their surroundings, so the size of the fit does not depend
    on the length of the pages."""
    words: Counter = Counter()
    inside, outside = Counter(), Counter()
    for page in pages:
        within = False
        for token in tokens(page):
            if token[0] == "text":
                words[token[2], token[4]] += len(token[1].split())
                if token[1].strip():
                    within = token[4]
            else:
                (inside if within else outside)[token[1]] += 1
    x = np.array([_features(mask) for mask, _ in words])
    y = np.array([float(marked) for _, marked in words])
    n = np.array([float(c) for c in words.values()])
    n /= n.sum()
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        error = n * (1 / (1 + np.exp(-(x @ w + b))) - y)
        w -= rate * 10 * (x.T @ error + ridge * w)
        b -= rate * 10 * error.sum()
    names = set(inside) | set(outside)
    tags = {t: -float(np.log(1 + (outside[t] + 1) / (inside[t] + 1))) / 2 for t in names}
    return Weights(b, w, tags, -float(np.log(2)) / 2)


# --- extraction ------------------------------------------------------------

def best_stretch(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous stretch with the highest sum (the first
    and shortest of equals; empty if no score is positive)."""
    best, start, end = 0.0, 0, 0
    total, begin = 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, start, end = total, begin, i + 1
    return start, end


def main_text(page: str | None, weights: Weights) -> str:
    """Blocks of the best stretch, white space collapsed, joined by \\n\\n."""
    sequence = list(tokens(page or ""))
    scores = [weights.word(t[2]) * len(t[1].split()) if t[0] == "text"
              else weights.tag(t[1], t[2], t[4]) for t in sequence]
    start, end = best_stretch(scores)
    blocks: dict[int, list[str]] = {}
    for t in sequence[start:end]:
        if t[0] == "text" and weights.word(t[2]) > 0:
            blocks.setdefault(t[3], []).append(html.unescape(t[1]))
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(x for x in lines if x)


def _extract(weights, html_col: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                text = [main_text(x, weights) for x in part.column(html_col).to_pylist()]
                yield (part.select(columns).append_column("text", pa.array(text, pa.string()))
                       .append_column("n_chars", pa.array([len(x) for x in text], pa.int64())))
    return run


def extract_text(pages: DataFrame, html_col: str = "html", labelled=PAGES,
                 columns: list[str] | None = None) -> DataFrame:
    """Main text of every page.

    labelled: pages whose content elements carry data-main; the weights are
    fitted on them when the query is built. Character references are decoded,
    white space inside a block becomes one space, blocks are joined by two \\n.
    Returns ``columns`` of ``pages`` (all, by default; columns named text or
    n_chars are replaced) plus text and n_chars (code points, long). A null or
    empty page, and one without content words, gives '' and 0. Rows are
    handled one by one: repeated rows give equal texts, an empty table an
    empty one; a page is held in memory as a whole.
    """
    weights = fit_weights(labelled)
    keep = [c for c in (columns or pages.columns) if c not in ("text", "n_chars")]
    src = pages.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, html_col])])
    fields = list(src.select(*[F.col(f"`{c}`") for c in keep]).schema.fields)
    schema = T.StructType(fields).add("text", "string").add("n_chars", "long")
    return src.mapInArrow(_extract(weights, html_col, keep), schema)
