"""Main text of HTML pages by a linear-chain conditional random field over the DOM's leaf blocks.

A page is read into blocks: runs of text between the tags of block elements. A block's
features are the tags and the kinds of class, id and role of all its ancestors, and
measures of its text. The field has two labels, main text or not, and is trained on
labelled pages: `labelled_pages` lays pages out at random from usual parts whose labels
are known. Viterbi decoding picks the likeliest labelling of a page, whose main blocks are
joined by a blank line.

Null and empty pages, and pages without main text, give an empty text. Pages that are cut
off, have stray or missing end tags or wrong quotes are read as far as they go; nothing
is capped. What stands in script, style, head, title, template, textarea and iframe is no text of the
page; one of these that is never closed is passed over, but for script and style, which reach to
the end of the page, as in browsers. Tags inside a block leave no space, but for br. Repeated
rows and ids all stay.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm._spark import map_texts, unused

# Elements of HTML.
BLOCK_TAGS = (
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "label", "legend", "li", "main", "menu", "nav",
    "noscript", "object", "ol", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
RAW_TAGS = ("script", "style", "textarea", "title", "iframe", "template", "head")
#: Of these, those that reach to the end of a page which does not close them; others without an end are passed over.
ENDLESS_TAGS = ("script", "style")
#: A start tag ends an open element of these, unless one of the limits lies between.
CLOSES = {
    **{t: (("p",), ("article", "aside", "blockquote", "div", "section", "td", "li", "button")) for t in BLOCK_TAGS},
    "li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)),
    "noscript": ((), ()), "object": ((), ()), "select": ((), ()), "option": (("option",), ("select",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "body": (("head",), ()),
}
# Kinds of class, id and role, by the words in them.
KINDS = {
    "content": "article content entry story main post text prose body markdown",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip",
    "header": "header masthead topbar brand logo banner hero site-title",
    "footer": "footer foot colophon legal copyright contentinfo imprint",
    "side": "sidebar side aside related recommended recommendations widget rail popular trending complementary teaser more",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall warning banner-notice disclaimer",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion promoted dfp outbrain taboola",
    "comment": "comment comments reply replies disqus discussion respond thread reactions feedback",
    "share": "share sharing social follow like tweet",
    "form": "form search login signin register contact poll survey",
    "meta": "meta byline author date tags tag timestamp published caption",
}
KIND_OF = {word: kind for kind, words in KINDS.items() for word in words.split()}
PHRASES = {
    "notice": ("cookie", "consent", "javascript", "browser", "privacy"),
    "footer": ("©", "copyright", "all rights reserved", "terms of"),
    "form": ("subscribe", "sign up", "log in", "password", "e-mail", "your name"),
    "comment": ("reply", "comment", "says:", "wrote:"),
    "ad": ("advertisement", "sponsored", "buy now", "sale", "click here"),
    "menu": ("read more", "next", "previous", "home", "share"),
}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*\Z""", re.S)
NAMED = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD_BREAK = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
SENTENCE_END = (".", "!", "?", "…", "。", '."', ".”", ".»", ":")


class Block(NamedTuple):
    text: str
    features: tuple[int, ...]


_names: dict[str, int] = {}
FEATURES = [
    "bias",
    *(f"in {t}" for t in BLOCK_TAGS),
    *(f"own {t}" for t in BLOCK_TAGS),
    *(f"kind {k}" for k in KINDS),
    *(f"says {k}" for k in PHRASES),
    "words 1-2", "words 3-5", "words 6-12", "words 13-30", "words 31-", "links none", "links some", "links most", "links all",
    "sentence end", "comma", "bars", "digits", "no letter", "title seen", "first", "inside content", "outside content",
]
_names.update({name: i for i, name in enumerate(FEATURES)})
IN = {t: _names[f"in {t}"] for t in BLOCK_TAGS}
OWN = {t: _names[f"own {t}"] for t in BLOCK_TAGS}
BLOCKS, VOIDS, RAWS = frozenset(BLOCK_TAGS), frozenset(VOID_TAGS), frozenset(RAW_TAGS)


@functools.lru_cache(4096)
def kinds_of(attributes: str) -> tuple[int, ...]:
    """Features for the kinds of class, id and role among a tag's attributes."""
    words: set[str] = set()
    for m in NAMED.finditer(attributes):
        value = m[1] or m[2] or m[3] or ""
        words.update(WORD_BREAK.split(value.lower()), WORD_BREAK.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()), value.lower().split())
    return tuple(sorted({_names[f"kind {KIND_OF[w]}"] for w in words if w in KIND_OF}))


def text_features(text: str, linked: int) -> list[int]:
    words, low = text.count(" ") + 1, text.lower()
    found = ["words 1-2" if words < 3 else "words 3-5" if words < 6 else "words 6-12" if words < 13 else "words 13-30" if words < 31 else "words 31-"]
    share = linked / len(text)
    found.append("links none" if not linked else "links some" if share < 0.4 else "links most" if share < 0.9 else "links all")
    if text.endswith(SENTENCE_END):
        found.append("sentence end")
    if "," in text:
        found.append("comma")
    if words < 40:
        found += [f"says {k}" for k, phrases in PHRASES.items() if any(p in low for p in phrases)]
        if text.count("|") + text.count("·") + text.count("»") > 1:
            found.append("bars")
    digits = sum(map(text.count, "0123456789"))
    if digits > 0.3 * len(text):
        found.append("digits")
    if not any(c.isalpha() for c in text[:200]) and not any(c.isalpha() for c in text):
        found.append("no letter")
    return [_names[f] for f in found]


@functools.lru_cache(16)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*(?:>|\Z)" + (r"|(?=<body\b)" if tag == "head" else ""), re.I)


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in page order, each with a word or mark."""
    out: list[Block] = []
    #: (tag, features of it and all above it)
    stack: list[tuple[str, frozenset[int]]] = [("", frozenset())]
    parts: list[str] = []
    linked, in_link, title, at = 0, 0, False, 0
    content = (IN["article"], IN["main"], _names["kind content"])

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            above = stack[-1][1]
            own = next((t for t, _ in reversed(stack) if t in BLOCKS), "body")
            more = [_names["bias"], OWN[own], _names["inside content" if any(c in above for c in content) else "outside content"]]
            if title:
                more.append(_names["title seen"])
            if not out:
                more.append(_names["first"])
            out.append(Block(text, (*above, *more, *text_features(text, min(linked, len(text))))))
        linked = 0

    while m := TOKEN.search(page, at):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            linked += len(piece) if in_link else 0
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = (m[1], m[3]) if m[2] else (m[4], m[6])
        if closing:
            if tag == "p" and not any(t == "p" for t, _ in stack):
                flush()
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if tag in BLOCKS:
                flush()
            if tag == "a":
                in_link = 0
            if k:
                if any(t in BLOCKS for t, _ in stack[k:]):
                    if tag not in BLOCKS:
                        continue  # a stray end of an inline element doesn't close blocks
                    flush()
                del stack[k:]
            continue
        if tag in RAWS:
            if not attributes.endswith("/"):
                end = _raw_end(tag).search(page, at)
                at = end.end() if end else len(page) if tag in ENDLESS_TAGS else at
            continue
        if tag in VOIDS:
            if tag == "hr":
                flush()
            if tag == "br":
                parts.append(" ")
            continue
        if tag == "a":
            in_link = 1
        if tag in BLOCKS:
            flush()
            closes, limits = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in closes:
                    del stack[i:]
                    break
                if stack[i][0] in limits:
                    break
            title = title or tag == "h1"
        above = stack[-1][1]
        own = kinds_of(attributes) if attributes else ()
        if tag in BLOCKS:
            stack.append((tag, above.union(own, (IN[tag],))))
        else:
            stack.append((tag, above.union(own) if own else above))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


class Field(NamedTuple):
    """Scores of label 1 over label 0 for each feature, and of each pair of neighbouring labels."""

    weight: np.ndarray
    pair: np.ndarray

    def decode(self, blocks: Sequence[Block]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        if not blocks:
            return []
        w = self.weight
        (p00, p01), (p10, p11) = self.pair.tolist()
        score = [float(w[list(b.features)].sum()) for b in blocks]
        a, b, back = 0.0, score[0], []
        for s in score[1:]:
            to0, to1 = (0, a + p00) if a + p00 >= b + p10 else (1, b + p10), (0, a + p01) if a + p01 > b + p11 else (1, b + p11)
            back.append((to0[0], to1[0]))
            a, b = to0[1], to1[1] + s
        label = int(b > a)
        out = [label]
        for choice in reversed(back):
            label = choice[label]
            out.append(label)
        return out[::-1]


def train(pages: Sequence[tuple[Sequence[Block], Sequence[int]]], steps: int = 250, rate: float = 0.05, l2: float = 0.5) -> Field:
    """Maximum likelihood with an L2 penalty, by forward and backward sums over all pages at once."""
    pages = [p for p in pages if p[0]]
    n, most = len(pages), max(len(p[0]) for p in pages)
    size = np.array([len(p[0]) for p in pages])
    gold = np.zeros((n, most), int)
    for i, (_, labels) in enumerate(pages):
        gold[i, : len(labels)] = labels
    there = np.arange(most) < size[:, None]
    page, spot, feature = np.array([(i, t, f) for i, (blocks, _) in enumerate(pages) for t, b in enumerate(blocks) for f in set(b.features)]).T
    cell = page * most + spot
    w, pair = np.zeros(len(FEATURES)), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(pair), np.zeros_like(pair)]
    both = there[:, 1:] & there[:, :-1]
    seen = np.array([[(both & (gold[:, :-1] == a) & (gold[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    for step in range(1, steps + 1):
        score = np.zeros((n, most, 2))
        score[:, :, 1] = np.bincount(cell, w[feature], n * most).reshape(n, most)
        forward, backward = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        forward[:, 0] = score[:, 0]
        for t in range(1, most):
            new = np.logaddexp.reduce(forward[:, t - 1, :, None] + pair, 1) + score[:, t]
            forward[:, t] = np.where(there[:, t, None], new, forward[:, t - 1])
        for t in range(most - 2, -1, -1):
            new = np.logaddexp.reduce(pair + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(there[:, t + 1, None], new, 0)
        total = np.logaddexp.reduce(forward[:, -1], 1)[:, None]
        marginal = np.where(there, np.exp(forward[:, :, 1] + backward[:, :, 1] - total), 0)
        joint = np.exp(forward[:, :-1, :, None] + pair + (score + backward)[:, 1:, None, :] - total[:, :, None, None]) * both[:, :, None, None]
        gw = np.bincount(feature, (marginal - gold * there).ravel()[cell], len(w)) + l2 * w
        gp = joint.sum((0, 1)) - seen + l2 * pair
        for x, g, m, v in ((w, gw / n, *moments[:2]), (pair, gp / n, *moments[2:])):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Field(w, pair)


PAGES, SEED = 500, 11


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[str, list[str]]]:
    """Pages laid out at random from usual parts, each with the texts of its main blocks."""
    rng = random.Random(seed)
    syllables = [a + b for a in "b d f g k l m n p r s t v".split() for b in "a e i o u an en or".split()]
    lexicon = ["".join(rng.choices(syllables, k=rng.choice((1, 1, 2, 2, 3)))) for _ in range(800)]
    pick, chance = rng.choice, lambda p: rng.random() < p

    def words(a: int, b: int) -> str:
        return " ".join(rng.choices(lexicon, k=rng.randint(a, b)))

    def sentence(a: int = 3, b: int = 16) -> str:
        return (words(a, b) + pick((", ", " ")) + words(1, 6)).capitalize() + pick("....?!")

    def prose(a: int = 1, b: int = 6) -> str:
        return " ".join(sentence() for _ in range(rng.randint(a, b)))

    def links(tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{words(1, 1)}">{words(1, 3)}</a></{tag}>' for _ in range(rng.randint(2, 7)))

    def wrap(tags: str, names: str, inner: str, bare: float = 0.0) -> str:
        tag, name = pick(tags.split()), pick(names.split())
        attribute = "" if chance(bare) else pick((f' class="{name}"', f' id="{name}"', f' class="{words(1, 1)} {name}"'))
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def menu() -> str:
        return pick((f"<nav><ul>{links()}</ul></nav>", wrap("div ul nav", "menu nav main-nav breadcrumb navbar", links(pick(("li", "span")))), f'<div role="navigation">{links("p")}</div>'))

    def header() -> str:
        return wrap("header div", "header site-header masthead topbar", f"<{pick(('p', 'div', 'span'))}>{words(1, 4)}</p><p>{pick((sentence(), prose(1, 2), words(2, 5)))}</p>" + (menu() if chance(0.5) else ""), 0.3) if chance(0.5) else f"<header>{prose(1, 2)}</header>"

    def footer() -> str:
        inner = pick((f"&copy; {words(1, 2)} &middot; {prose(1, 3)}", f"<p>{words(2, 5)}. All rights reserved.</p>{links('span')}", f"<ul>{links()}</ul><p>{prose(1, 2)}</p>"))
        return f"<footer>{inner}</footer>" if chance(0.6) else wrap("div section", "footer site-footer colophon legal", inner)

    def side() -> str:
        inner = f"<{pick(('h2', 'h3', 'h4'))}>{words(1, 4)}</h3>" * chance(0.6) + pick((f"<ul>{links()}</ul>", f"<p>{prose(1, 4)}</p>", f"<p>{sentence()}</p><p>{prose(1, 3)}</p>"))
        return f"<aside>{inner}</aside>" if chance(0.5) else wrap("aside div section", "sidebar related widget side-bar recommended popular", inner)

    def notice() -> str:
        inner = pick((f"We use cookies. {prose(1, 2)}", prose(1, 3), f"<p>{prose(1, 3)}</p><button>{words(1, 2)}</button>"))
        if chance(0.15):
            return pick((f"<noscript>{inner}</noscript>", f"<object data='x'>{pick((prose(1, 1), words(2, 6)))}</object>"))
        return wrap("div section dialog aside p", "cookie-notice cookie consent notice alert gdpr newsletter popup banner-notice disclaimer", inner)

    def advert() -> str:
        return wrap("div section p aside", "ad ads advert advertisement sponsored promo ad-slot", pick((prose(1, 3), f"<p>{prose(1, 2)}</p>", f"<a href='#'>{words(2, 6)}</a>")))

    def form() -> str:
        inner = f"<label>{words(1, 3)}</label><input type='text'><button>{words(1, 2)}</button>" + f"<p>{prose(1, 2)}</p>" * chance(0.6)
        if chance(0.2):
            inner += "<select>" + "".join(f"<option>{words(1, 3)}</option>" for _ in range(rng.randint(2, 5))) + "</select>"
        return f"<form action='/'>{inner}</form>" if chance(0.7) else wrap("div form", "search-form login contact-form signup", inner)

    def comments() -> str:
        one = lambda: pick((f"<p>{prose(1, 4)}</p>", f"<b>{words(1, 2)}</b><p>{prose(1, 3)}</p>", f"<li><p>{prose(1, 5)}</p></li>", wrap("article div li", "comment reply", f"<p>{prose(1, 4)}</p>")))
        inner = f"<h3>{words(1, 3)}</h3>" * chance(0.6) + "".join(one() for _ in range(rng.randint(1, 5)))
        return wrap("div section ol ul aside", "comments comment-list reader-comments discussion disqus respond", inner)

    def share() -> str:
        return wrap("div ul p", "share social share-buttons follow", links("span"))

    found = []
    for _ in range(n):
        main: list[str] = []

        def keep(text: str, main: list[str] = main) -> str:
            main.append(text)
            return text

        loose = chance(0.3)
        end = lambda tag, loose=loose: "" if loose and chance(0.5) else f"</{tag}>"
        inner = f"<h1>{keep(words(2, 9) + pick(('', '.')))}</h1>" if chance(0.9) else ""
        if chance(0.15):
            inner = wrap("div p span", "byline meta date", f"{words(2, 4)} 2021-03-04") + inner
        for _ in range(rng.choice((0, 1, 2, 3, 4, 6, 9))):
            kind = rng.random()
            if kind < 0.72:
                text = keep(pick((prose(1, 1), prose(1, 6), prose(2, 9), words(1, 4) + ".", words(2, 12))))
                inner += f"<p>{'<b>' * chance(0.1)}{text}{'<br>' * chance(0.1)}{end('p')}"
            elif kind < 0.78:
                inner += f"<{(t := pick(('h2', 'h3')))}>{keep(words(1, 7))}</{t}>"
            elif kind < 0.84:
                items = "".join(f"<li>{keep(pick((sentence(), words(2, 6))))}{end('li')}" for _ in range(rng.randint(2, 5)))
                inner += f"<ul>{items}</ul>"
            elif kind < 0.88:
                inner += f"<blockquote>{keep(prose(1, 3))}</blockquote>"
            elif kind < 0.91:
                inner += f"<table><tr><td>{keep(words(1, 3))}</td><td>{keep(words(1, 3))}</td></tr></table>"
            else:
                inner += pick((advert, side, share, form, notice))()
        if chance(0.15):
            inner += comments()
        body = pick(
            (
                f"<article>{inner}{end('article')}",
                f"<main>{inner}</main>",
                f"<main><article>{inner}</article></main>",
                wrap("div section", "content post entry-content article-body story main-content", inner),
                f"<div>{inner}</div>",
            )
        )
        before = [pick((menu, menu, header, notice, advert, side, form))() for _ in range(rng.randint(0, 4))]
        after = [pick((comments, side, advert, share, notice, menu, form))() for _ in range(rng.randint(0, 3))] + [footer()] * chance(0.85)
        title = f"<title>{words(2, 6)}</title>"
        found.append((f"<!DOCTYPE html><html><head>{title}</head><body>{''.join(before)}{body}{''.join(after)}" + "</body></html>" * (not loose), main))
    return found


@functools.lru_cache(2)
def model(pages: int = PAGES, seed: int = SEED) -> Field:
    """The field trained on `pages` labelled pages: a bounded set."""
    rows = []
    for page, main in labelled_pages(pages, seed):
        blocks, left, labels = blocks_of(page), list(main), []
        for b in blocks:
            own = bool(left) and b.text == " ".join(left[0].split())
            labels.append(int(own))
            if own:
                left.pop(0)
        if not left:
            rows.append((blocks, labels))
    return train(rows)


def main_text(page: str | None, field: Field) -> str:
    blocks = blocks_of(page or "")
    return "\n\n".join(b.text for b, label in zip(blocks, field.decode(blocks)) if label)


def extract_text(pages: DataFrame, html_column: str = "html", pages_learned: int = PAGES) -> DataFrame:
    """`pages` without the markup and with `text` and `n_chars`; columns of these names are replaced."""
    carried = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]
    (raw,) = unused(pages, "raw")
    source = pages.select(*[F.col(f"`{c}`") for c in carried], F.col(html_column).alias(raw))
    types = dict(source.dtypes)
    held = pages.sparkSession.sparkContext.broadcast(model(pages_learned))

    def run(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        texts = [main_text(x, held.value) for x in batch.column(raw).to_pylist()]
        columns = [*(batch.column(c) for c in carried), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        return [pa.RecordBatch.from_arrays(columns, names=[*carried, "text", "n_chars"])]

    return map_texts(source, raw, run, ", ".join([*(f"`{c}` {types[c]}" for c in carried), "text string", "n_chars long"]))
