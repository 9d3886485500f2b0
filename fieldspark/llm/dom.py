"""A page as a flat list of elements and text blocks, and their features."""

from __future__ import annotations

import html
import math
import re

import numpy as np

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*>",
    re.S,
)
ATTRIBUTE = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME = re.compile(r"[a-z]+")

# Fixed values of the HTML standard: elements by how they nest and what they hold.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea select title".split())
# These end with the page if nothing ends them before; of the others an unclosed one costs its tag alone.
TO_THE_END = {"script", "style"}
BLOCK = set(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol "
    "option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSED_BY = {
    "p": BLOCK - {"br", "button", "option"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option"},
    "head": {"body"},
}
SCOPE = set("table ul ol dl div section article aside nav main header footer form blockquote td th".split())

# Element kinds the trees can tell apart; everything else is one kind.
KINDS = (
    "#text article main section div p h1 h2 h3 h4 ul ol li a nav header footer aside form button "
    "table tr td blockquote pre figure figcaption span b dl address details body html head title "
    "script style noscript iframe select textarea dialog menu"
).split()
KIND = {name: i for i, name in enumerate(KINDS)}


class Page:
    """Parallel lists over nodes in page order; a parent always comes before its children."""

    def __init__(self) -> None:
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.names: list[str] = []
        self.text: list[str] = []

    def add(self, tag: str, parent: int, names: str = "", text: str = "") -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.names.append(names)
        self.text.append(text)
        return len(self.tag) - 1


def parse(source: str) -> Page:
    """Elements and text blocks of any input, well formed or not.

    A text block is the text between two block boundaries, with references decoded and white space
    made single; it hangs below the element in which it begins.
    """
    page = Page()
    stack = [page.add("#root", -1)]
    pieces: list[str] = []
    holder = 0

    def flush() -> None:
        nonlocal pieces
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                page.add("#text", holder, "", text)
            pieces = []

    def say(text: str) -> None:
        nonlocal holder
        if text:
            if not pieces:
                if not text.strip():
                    return
                # inline elements do not hold a block
                k = len(stack) - 1
                while k and page.tag[stack[k]] not in BLOCK:
                    k -= 1
                holder = stack[k]
            pieces.append(text)

    at, raw, unclosed = 0, "", set()
    for m in TOKEN.finditer(source):
        if m.start() < at:
            continue
        if not raw:
            say(source[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if not raw and source.startswith("<![CDATA[", m.start()):
                say(html.escape(m[0][9:-3]))
            continue
        tag = tag.lower()
        if raw:
            if m[1] and tag == raw:
                raw = ""
            continue
        if m[1]:
            if tag in BLOCK:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if page.tag[stack[k]] == tag:
                    del stack[k:]
                    break
                if page.tag[stack[k]] in SCOPE and tag not in BLOCK:
                    break
            continue
        if tag in BLOCK:
            flush()
        for k in range(len(stack) - 1, 0, -1):
            open_tag = page.tag[stack[k]]
            if tag in CLOSED_BY.get(open_tag, ()):
                del stack[k:]
                break
            if open_tag in SCOPE:
                break
        names = " ".join(next(filter(None, a), "") for a in ATTRIBUTE.findall(m[3])).lower() if m[3] else ""
        if tag in RAW and not m[3].endswith("/"):
            page.add(tag, stack[-1], names)
            raw = tag
            # raw text ends at its own closing tag, whatever it holds
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at) if tag not in unclosed else None
            if end:
                at = end.end()
            elif tag in TO_THE_END:
                at = len(source)
            else:
                unclosed.add(tag)
            raw = ""
        elif tag in BLOCK and tag not in VOID:
            stack.append(page.add(tag, stack[-1], names))
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(page.add(tag, stack[-1], names))
    say(source[at:])
    flush()
    return page


# Stems (anywhere in a name) and whole words of class, id and role names that tell
# the surroundings of a text from the text. They are features only; the trees decide.
AROUND_STEMS = (
    "advert sponsor promo banner cookie consent notice popup modal gdpr newsletter subscri signup "
    "login search sidebar widget related recommend popular trending footer header masthead topbar "
    "copyright legal colophon breadcrumb navi menu toolbar comment discuss respon repl share social "
    "paginat disclaimer contact"
).split()
AROUND_WORDS = set("ad ads nav toc side rail more form tags alert brand bottom links pager aside".split())
MAIN_STEMS = "article content story entry markdown prose".split()
MAIN_WORDS = set("main post body text page news".split())
AROUND_TAGS = set("nav header footer aside form button select dialog menu label".split())

FEATURES = (
    "kind parent_kind depth children siblings place text_share parent_share text_log texts_log "
    "mean_text links list_items density sentences page_place digits around around_above main "
    "main_above inner_main around_tag"
).split()

_name_counts: dict[str, tuple[int, int]] = {}


def name_counts(names: str) -> tuple[int, int]:
    """How many names speak for the surroundings and how many for main text."""
    if names not in _name_counts:
        if len(_name_counts) > 50_000:
            _name_counts.clear()
        words = NAME.findall(names)
        around = sum(w in AROUND_WORDS or any(t in w for t in AROUND_STEMS) for w in words)
        main = sum(w in MAIN_WORDS or any(t in w for t in MAIN_STEMS) for w in words)
        _name_counts[names] = (around, main)
    return _name_counts[names]


def features(page: Page, vocabulary: dict[str, int]) -> np.ndarray:
    """One row per node: FEATURES, then a flag per attribute token of the node."""
    tag, parent, names = page.tag, page.parent, page.names
    n = len(tag)
    size, texts, elements = [0] * n, [0] * n, [0] * n
    links, items, sentences, digits = [0] * n, [0] * n, [0] * n, [0] * n
    children, place = [0] * n, [0] * n
    around, main, around_up, main_up, inner_main = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    around_tag = [0] * n
    flags = []
    for i in range(1, n):
        p = parent[i]
        place[i] = children[p]
        children[p] += 1
        around_up[i] = around_up[p] + around[p]
        main_up[i] = main_up[p] + main[p]
        around_tag[i] = around_tag[p] + (tag[i] in AROUND_TAGS)
        if names[i]:
            around[i], main[i] = name_counts(names[i])
            flags += [(i, vocabulary[w]) for w in NAME.findall(names[i]) if w in vocabulary]
        main[i] += tag[i] in ("article", "main")
        text = page.text[i]
        if text:
            size[i], texts[i] = len(text), 1
            sentences[i] = text.count(". ") + text.count("! ") + text.count("? ") + (text[-1] in ".!?")
            digits[i] = sum(map(text.count, "0123456789"))
        else:
            elements[i] = 1
            if tag[i] == "a":
                links[i] = 1
            elif tag[i] in ("li", "input", "option", "button"):
                items[i] = 1
    for i in range(n - 1, 0, -1):
        p = parent[i]
        size[p] += size[i]
        texts[p] += texts[i]
        elements[p] += elements[i]
        links[p] += links[i]
        items[p] += items[i]
        sentences[p] += sentences[i]
        digits[p] += digits[i]
        inner_main[p] += inner_main[i] + main[i]
    total = max(1, size[0])
    other = len(KINDS)
    log1p = math.log1p
    rows = [(0.0,) * len(FEATURES)]
    for i in range(1, n):
        p, s, t = parent[i], size[i], max(1, texts[i])
        rows.append(
            (
                KIND.get(tag[i], other), KIND.get(tag[p], other), page.depth[i], children[i],
                children[p], place[i] / children[p], s / total, s / max(1, size[p]), log1p(s),
                log1p(texts[i]), s / t, links[i] / t, items[i] / t, s / (elements[i] + 1),
                100 * sentences[i] / max(1, s), i / n, digits[i] / max(1, s),
                around[i], around_up[i], main[i], main_up[i], inner_main[i], around_tag[i],
            )
        )
    out = np.zeros((n, len(FEATURES) + len(vocabulary)), dtype=np.float32)
    out[:, : len(FEATURES)] = rows
    for i, j in flags:
        out[i, len(FEATURES) + j] = 1
    return out


def decode(page: Page, probability: np.ndarray) -> list[int]:
    """The text nodes of the likeliest consistent labelling, in page order.

    A node that is open holds main text, one that is closed holds none: below a closed node nothing
    is open, and an open element has an open child. Text nodes are open if they are main text.
    """
    p = np.clip(probability, 1e-4, 1 - 1e-4)
    opened, shut = np.log(p), np.log1p(-p)
    n = len(page.tag)
    closed_sum, open_sum = shut.tolist(), opened.tolist()
    gain = [-math.inf] * n
    for i in range(n - 1, 0, -1):
        if page.tag[i] != "#text" and gain[i] < 0:
            # no child wants to be open: opening means forcing the cheapest one, if there is any
            open_sum[i] = open_sum[i] + gain[i]
        q = page.parent[i]
        closed_sum[q] += closed_sum[i]
        open_sum[q] += max(open_sum[i], closed_sum[i])
        gain[q] = max(gain[q], open_sum[i] - closed_sum[i])
    is_open = [False] * n
    is_open[0] = True
    forced = {}
    for i in range(1, n):
        q = page.parent[i]
        if is_open[q]:
            is_open[i] = open_sum[i] > closed_sum[i]
            if not is_open[i] and q and gain[q] < 0 and open_sum[i] - closed_sum[i] == gain[q]:
                if q not in forced:
                    forced[q] = i
                    is_open[i] = True
    return [i for i in range(n) if is_open[i] and page.tag[i] == "#text"]
