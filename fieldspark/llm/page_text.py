"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

The trees are trained on pages made from a bounded sample of the given ones: the blocks of text
inside a page's article are set into layouts drawn at random, among menus, headers, footers,
sidebars, notices, adverts, forms and comments whose texts come from the sample as well. Each
node's label says whether it holds main text.
"""

from __future__ import annotations

import html
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted
from .dom import NAME, Page, decode, features, parse

# Pages read for training (the first by a hash of page_id and html), and layouts made of each.
TRAIN_PAGES = 200
LAYOUTS = 3
VOCABULARY = 24
BATCH_NODES = 60_000

# Names that layouts give to the parts of a page, main text first.
MAIN = (
    "article content main-content post-content entry-content story body-text article-body text post "
    "entry page-content prose markdown news-body mw-parser-output"
).split()
ASIDE = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav main-menu links toc".split(),
    "header": "header masthead site-header topbar banner branding page-header".split(),
    "footer": "footer site-footer copyright legal colophon bottom".split(),
    "aside": "sidebar side aside related widget widgets recommended popular trending more rail".split(),
    "advert": "ad ads advert advertisement sponsored promo promotion sponsor adsbox banner-ad".split(),
    "notice": "cookie cookie-notice consent notice alert gdpr popup modal privacy cookie-banner".split(),
    "form": "form newsletter subscribe signup search login contact-form search-form".split(),
    "comments": "comments comment-list comment reader-comments discussion responses replies".split(),
    "share": "share social sharing tags byline-links pagination pager author-links".split(),
}
ADDRESS = "(c) all rights reserved privacy terms contact"


def rule_label(page: Page) -> np.ndarray:
    """Where the sample's text comes from: text in an article or main element, outside its noise."""
    noise = {name for names in ASIDE.values() for name in names}
    noise |= {"nav", "aside", "footer", "form", "header", "script", "style", "button"}
    state = [0] * len(page.tag)
    for i in range(1, len(page.tag)):
        p = state[page.parent[i]]
        words = {page.tag[i], *page.names[i].split()}
        if p < 0 or (words & noise and not (page.tag[i] == "header" and p > 0)):
            state[i] = -1
        else:
            state[i] = 1 if p > 0 or words & {"article", "main"} else 0
    return np.array([s > 0 for s in state])


def article_blocks(source: str) -> tuple[list[str], list[str]]:
    """Main text blocks of a page by plain rules, and its other texts."""
    page = parse(source or "")
    main = rule_label(page)
    blocks = [(page.text[i], main[i]) for i in range(len(page.tag)) if page.tag[i] == "#text"]
    return [t for t, m in blocks if m], [t for t, m in blocks if not m]


MARK = "\u2063"  # an invisible character put before main text in made pages


def make_page(blocks: list[str], others: list[str], rng: random.Random) -> str:
    """A page with the blocks as main text, marked, in a layout drawn at random."""
    pick = rng.choice

    def words(low: int, high: int) -> str:
        text = pick(others).split() or ["x"]
        begin = rng.randrange(len(text))
        return html.escape(" ".join(text[begin : begin + rng.randint(low, high)]) or "x")

    def attributes(names: list[str]) -> str:
        if rng.random() < 0.25:
            return ""
        name = pick(names)
        if rng.random() < 0.3:
            name += " " + pick(["wide", "col-8", "box", "clearfix", "left", "dark"])
        return f' {pick(["class", "class", "id"])}="{name}"'

    def part(kind: str) -> str:
        named = attributes(ASIDE[kind])
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        if kind == "comments":
            tag = pick(["div", "section"])
        if tag != "div" and rng.random() < 0.4 and named:
            tag = pick(["div", "section"])
        if tag in ("div", "section") and not named:
            named = f' class="{pick(ASIDE[kind])}"'
        if kind in ("nav", "share") or kind == "aside" and rng.random() < 0.5:
            links = "".join(f'<li><a href="/{k}">{words(1, 4)}</a></li>' for k in range(rng.randint(3, 8)))
            title = f"<h3>{words(1, 3)}</h3>" if rng.random() < 0.4 else ""
            inner = f"{title}<ul>{links}</ul>"
        elif kind == "footer":
            inner = f"&copy; {words(1, 8)} {pick(['', '<p>' + words(3, 20) + '</p>', '<a href=/>' + words(1, 2) + '</a>'])}"
        elif kind == "header":
            inner = f"{pick(['', '<h1>' + words(1, 3) + '</h1>'])}<a href=/>{words(1, 3)}</a><p>{words(2, 8)}</p>"
        elif kind == "form":
            inner = f"<label>{words(1, 5)}</label><input name=q><p>{words(3, 15)}</p><button>{words(1, 2)}</button>"
        elif kind == "comments":
            item = pick(["div", "li", "article"])
            inner = f"<h3>{words(1, 3)}</h3>" + "".join(
                f'<{item} class="comment">{pick(["", "<b>" + words(1, 2) + "</b>"])}<p>{words(5, 60)}</p></{item}>'
                for _ in range(rng.randint(1, 6))
            )
        else:
            inner = pick(["{}", "<p>{}</p>", "<p>{}</p><a href=/x>more</a>", "<span>{}</span>"]).format(words(3, 30))
        return f"<{tag}{named}>{inner}</{tag}>"

    def body_block(text: str, first: bool) -> str:
        safe = MARK + html.escape(text, quote=False)
        if first and rng.random() < 0.7:
            return f"<h1>{safe}</h1>"
        form = pick(["<p>{}</p>"] * 6 + ["<p><b>{}<br>", "<p>{}", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<div>{}</div>", "<p><i>{}</i></p>", "<table><tr><td>{}</td></tr></table>", "<pre>{}</pre>"])
        return form.format(safe)

    inside = []
    for i, text in enumerate(blocks):
        inside.append(body_block(text, i == 0))
        if rng.random() < 0.06:
            inside.append(part(pick(["advert", "share", "aside", "notice", "form"])))
    if rng.random() < 0.2:
        inside.append(part("share"))
    if rng.random() < 0.15:
        inside.append(part("comments"))
    tag = pick(["article", "article", "main", "div", "section"])
    named = attributes(MAIN) or ("" if tag in ("article", "main") else f' class="{pick(MAIN)}"')
    middle = f"<{tag}{named}>{''.join(inside)}</{tag}>"
    if rng.random() < 0.4:
        side = part("aside")
        middle = middle + side if rng.random() < 0.6 else side + middle
    if rng.random() < 0.4:
        wrap = pick(["main", "div", "section"])
        middle = f'<{wrap} {pick(["class", "id"])}="{pick(["container", "wrapper", "page", "layout", "row"])}">{middle}</{wrap}>'
    before = [part(k) for k in ("header", "nav", "notice", "advert") if rng.random() < 0.55]
    after = [part(k) for k in ("comments", "share", "aside", "form", "advert", "notice", "footer") if rng.random() < 0.4]
    rng.shuffle(before)
    head = f"<head><title>{words(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
    return f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{middle}{''.join(after)}</body></html>"


def _node_labels(page: Page, main: np.ndarray) -> np.ndarray:
    held = main.astype(bool)
    for i in range(len(held) - 1, 0, -1):
        if held[i]:
            held[page.parent[i]] = True
    return held


class Extractor:
    """A trained model: the tree ensemble and the attribute tokens it looks at."""

    def __init__(self, trees: Boosted, vocabulary: dict[str, int]) -> None:
        self.trees, self.vocabulary = trees, vocabulary

    def texts(self, sources: list[str | None]) -> list[str]:
        out, pages, size = [], [], 0
        for k, source in enumerate(sources):
            pages.append(parse(source or ""))
            size += len(pages[-1].tag)
            if size >= BATCH_NODES or k + 1 == len(sources):
                table = np.concatenate([features(p, self.vocabulary) for p in pages])
                probability = self.trees.probability(table)
                at = 0
                for p in pages:
                    chosen = decode(p, probability[at : at + len(p.tag)])
                    out.append("\n".join(p.text[i] for i in chosen))
                    at += len(p.tag)
                pages, size = [], 0
        return out


def train(sources: list[str], layouts: int = LAYOUTS, seed: int = 11) -> Extractor:
    """An extractor from sample pages; without usable pages, from fixed filler text."""
    rng = random.Random(seed)
    samples = [article_blocks(s) for s in sources]
    samples = [(b, o) for b, o in samples if b]
    if not samples:
        filler = [" ".join(f"word{i % 37} and" for i in range(k, k + 30)) + "." for k in range(12)]
        samples = [(filler, [ADDRESS])]
    everything = [t for b, o in samples for t in [*b[:2], *o]] + [ADDRESS]
    pages, labels = [], []
    for blocks, _ in samples:
        for _ in range(layouts):
            few = blocks if rng.random() < 0.6 else blocks[: rng.randint(1, 3)]
            # articles also hold very short blocks
            few = [" ".join(t.split()[: rng.randint(1, 4)]) if rng.random() < 0.1 else t for t in few]
            page = parse(make_page(few, everything, rng))
            main = np.array([t.startswith(MARK) for t in page.text])
            page.text = [t.replace(MARK, "") for t in page.text]
            pages.append(page)
            labels.append(_node_labels(page, main))
    # the sample itself, where plain rules find an article
    for source in sources:
        page = parse(source)
        main = rule_label(page) & np.array([t == "#text" for t in page.tag])
        if main.any():
            pages.append(page)
            labels.append(_node_labels(page, main))
    counts: dict[str, int] = {}
    for page in pages:
        for i in range(1, len(page.tag)):
            for name in NAME.findall(page.names[i]):
                counts[name] = counts.get(name, 0) + 1
    common = sorted(counts, key=lambda w: (-counts[w], w))[:VOCABULARY]
    vocabulary = {w: i for i, w in enumerate(common)}
    table = np.concatenate([features(p, vocabulary) for p in pages])
    y = np.concatenate(labels).astype(float)
    real = np.concatenate([np.arange(len(p.tag)) > 0 for p in pages])
    # pages weigh alike, however many nodes they have
    weight = np.concatenate([np.full(len(p.tag), 100 / len(p.tag)) for p in pages])
    return Extractor(Boosted().fit(table[real], y[real], weight[real]), vocabulary)


def extract_main_text(pages: DataFrame, keep: list[str], train_pages: int = TRAIN_PAGES) -> DataFrame:
    """The columns ``keep`` of every row of ``pages(page_id, html)`` with ``text`` and ``n_chars``.

    The trees are fitted on a bounded sample of ``train_pages`` pages. A null or empty html, or a
    page without main text, has empty text. Repeated rows give equal texts; null ids are kept; broken
    markup is read as far as it goes. An empty table gives an empty result. Other columns are not
    looked at.
    """
    spark = pages.sparkSession
    # choose ids first, so that only the chosen pages travel
    ids = pages.where(F.col("html").isNotNull() & F.col("page_id").isNotNull()).select("page_id")
    ids = ids.orderBy(F.xxhash64("page_id"), "page_id").limit(train_pages).distinct()
    sample = pages.select("page_id", "html").join(F.broadcast(ids), "page_id", "left_semi")
    sample = sample.orderBy(F.xxhash64("page_id"), "page_id", "html").limit(train_pages)
    model = spark.sparkContext.broadcast(train([r["html"] for r in sample.collect() if r["html"]]))
    rows = pages.select(*keep, F.col("html").cast("string").alias("_html"))
    names = {c: f"_k{i}" for i, c in enumerate(keep)}
    rows = rows.select(*[F.col(c).alias(n) for c, n in names.items()], "_html")
    kinds = ", ".join(f"{n} {pages.schema[c].dataType.simpleString()}" for c, n in names.items())

    def run(batches):
        extractor = model.value
        for batch in batches:
            texts = extractor.texts(batch["_html"].tolist())
            out = batch.drop(columns="_html")
            for name in out.columns:
                if out[name].dtype == "float64":
                    out[name] = out[name].astype("Int64")
            yield out.assign(text=texts, n_chars=[len(t) for t in texts])

    done = rows.mapInPandas(run, f"{kinds}, text string, n_chars bigint")
    return done.select(*[F.col(n).alias(c) for c, n in names.items()], "text", "n_chars")
