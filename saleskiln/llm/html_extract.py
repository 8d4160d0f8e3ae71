"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Every block element of a page is described by its subtree (text, links, elements, density), its attributes, its place
(depth, order) and its siblings. Boosted trees give the chance that it holds main text. A dynamic program over the tree
then picks the likeliest set of choices in which nothing below a dropped element is kept.

Pages carry no labels. The trees are fitted to a bounded sample labelled by what its markup says outright (semantic
elements and plain attribute tokens); copies of the sampled pages, in which these signs are renamed or gone and further
menus, notices, adverts, forms and reader comments are put in, teach them to go by structure as well.
"""

from __future__ import annotations

import html as references
import random
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from saleskiln.llm.common import batch_udf, hash_sample

#: Pages to learn from (smallest hashes of their ids), and the longest of them in characters.
TRAIN_PAGES, TRAIN_CHARS = 300, 200_000
TREES, DEPTH, RATE, BINS, LEAF = 40, 4, 0.2, 32, 8
TOKEN_BUCKETS = 12

# Elements of HTML by their role.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br tspan".split())
MATH = set("math mi mn mo ms mtext mspace mrow mfrac msup msub msubsup msqrt mroot munder mover munderover mtable mtr mlabeledtr mtd mstyle mpadded mphantom menclose mfenced merror maction mmultiscripts mprescripts semantics annotation annotation-xml".split())
INLINE |= MATH
SPACED = set("br mtr mtd annotation annotation-xml".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title".split())
#: Embedded parts, fallbacks and controls: elements as any other where they have text and an end.
PARTS = set("noscript template iframe select button svg object canvas audio video".split())
ENDS_PARAGRAPH = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
FENCES = set("ul ol dl table body article section div main aside nav header footer form blockquote".split()) | PARTS
DROP_TAGS = set("nav footer aside form menu dialog head button select".split())
KEEP_TAGS = set("article main".split())
# Tokens of class, id and role that say what an element is.
DROP_TOKENS = set(
    "ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar side aside footer foot header masthead topbar"
    " cookie cookies consent notice gdpr popup modal overlay newsletter subscribe signup login comment comments respond discussion reply replies share sharing social related recommended widget toolbar search form".split()
)
KEEP_TOKENS = set("article content post entry story main body text page single prose".split())

NAME = re.compile(r"[a-zA-Z][^\s>/]*")
QUOTE_OR_END = re.compile(r"[\"'>]")
SAME = {tag: re.compile(rf"<(/?){tag}\b(?:[^>]*>|\Z)", re.I) for tag in RAW | PARTS}
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
SIGNS = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
PART = re.compile(r"[a-z]+")
SENTENCE = re.compile(r"[.!?…。](?=\s|$)")


@dataclass
class Page:
    """Block elements in page order (0 is the root) and the text blocks: (element, text)."""

    tags: list[str] = field(default_factory=lambda: ["#root"])
    parents: list[int] = field(default_factory=lambda: [-1])
    tokens: list[list[str]] = field(default_factory=lambda: [[]])
    links: list[int] = field(default_factory=lambda: [0])
    blocks: list[tuple[int, str]] = field(default_factory=list)


class Markup:
    """Tags, comments and declarations of a page, found from left to right in linear time, however broken they are."""

    def __init__(self, html: str) -> None:
        self.html, self.size = html, len(html)
        #: quotes and tag ends, outside quotes, from which no end of a tag can be reached outside quotes
        self.stuck: set[int] = set()
        self.last_end = html.rfind(">")

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, stop, closing name, opening name, attributes) of what comes first from ``at`` on."""
        html = self.html
        while (start := html.find("<", at)) >= 0:
            if html.startswith("<!--", start):
                stop = html.find("-->", start + 4)
                return start, stop + 3 if stop >= 0 else self.size, "", "", ""
            at = start + 1
            if start > self.last_end:
                # only comments need no end
                start = html.find("<!--", at)
                if start < 0:
                    return None
                at = start
                continue
            mark = html[at : at + 1]
            if mark in ("!", "?"):
                return start, html.find(">", at) + 1, "", "", ""
            end = html.find(">", at) if mark == "/" or mark.isalpha() else -1
            name = NAME.match(html, at + (mark == "/"), end) if end >= 0 else None
            if not name:
                continue
            if mark == "/":
                return start, end + 1, name.group(), "", ""
            stop = self.tag_end(name.end(), end)
            return start, stop + 1, "", name.group(), html[name.end() : stop]
        return None

    def tag_end(self, at: int, first: int) -> int:
        """The first tag end outside quotes, or ``first``, that at all, where quotes don't close in front of one."""
        html, seen = self.html, []
        while m := QUOTE_OR_END.search(html, at):
            place = m.start()
            if html[place] == ">":
                return place
            if place in self.stuck:
                break
            seen.append(place)
            close = html.find(html[place], place + 1)
            if close < 0:
                break
            at = close + 1
        self.stuck.update(seen)
        return first

    def raw_end(self, tag: str, at: int) -> int:
        """Behind the end tag of an element whose content is no markup, or the end of the page."""
        end = RAW_END[tag].search(self.html, at) if at <= self.last_end else None
        return end.end() if end else self.size


def has_text(inner: str) -> bool:
    """Whether anything but markup, the content of raw elements and white space is there."""
    markup, at = Markup(inner), 0
    while found := markup.next(at):
        if references.unescape(inner[at : found[0]]).strip():
            return True
        tag = found[3].lower()
        at = markup.raw_end(tag, found[1]) if tag in RAW else found[1]
    return bool(references.unescape(inner[at:]).strip())


def parse(html: str) -> Page:
    """Lenient: unclosed and stray tags are mended as browsers do for paragraphs, lists and tables.

    Only an unclosed script, style, textarea or title takes the rest of the page with it, as in browsers. Formulas are
    text of their paragraph; an embedded part, fallback or control without text is passed over, and one without an end
    leaves its content to its parent."""
    page, stack, parts, anchors, at, size = Page(), [0], [], 0, 0, len(html)
    markup = Markup(html)
    # places in the stack of the open elements of each name
    names: dict[str, list[int]] = {}

    def close_block() -> None:
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            if text:
                page.blocks.append((stack[-1], text))
            parts.clear()

    def pop_to(wanted: set[str], fences: set[str]) -> None:
        """Close the innermost open element of ``wanted``, unless a fence is in between."""
        place = max((names[t][-1] for t in wanted if names.get(t)), default=0)
        if place and all(names[f][-1] < place for f in fences - wanted if names.get(f)):
            for gone in reversed(stack[place:]):
                names[page.tags[gone]].pop()
            del stack[place:]

    while at < size:
        found = markup.next(at)
        text = html[at : found[0] if found else size]
        if text:
            parts.append(text)
            if anchors > 0:
                page.links[stack[-1]] += len(text.strip())
        if not found:
            break
        _, at, closing, opening, attributes = found
        if opening:
            tag = opening.lower()
            empty = (tag in ("svg", "math") or bool(names.get("svg"))) and attributes.rstrip().endswith("/")
            if tag in RAW:
                at = at if empty else markup.raw_end(tag, at)
            elif tag in INLINE:
                anchors += tag == "a" and not empty
                if tag in SPACED:
                    parts.append(" ")
            elif tag in PARTS and (empty or not (end := SAME[tag].search(html, at)) or not end.group(1)):
                parts.append(" ")
            elif tag in PARTS and (tag == "iframe" or not has_text(html[at : end.start()])):
                at = end.end()
            else:
                close_block()
                if tag in ENDS_PARAGRAPH and names.get("p"):
                    pop_to({"p"}, FENCES)
                if tag in CLOSES and any(names.get(t) for t in CLOSES[tag]):
                    pop_to(CLOSES[tag], FENCES - {tag})
                if tag not in VOID and not empty:
                    signs = " ".join(m.group(1) for m in SIGNS.finditer(attributes))
                    page.tags.append(tag)
                    page.parents.append(stack[-1])
                    page.tokens.append(PART.findall(signs.lower()))
                    page.links.append(0)
                    names.setdefault(tag, []).append(len(stack))
                    stack.append(len(page.tags) - 1)
                    anchors = 0
        elif closing:
            tag = closing.lower()
            if tag in INLINE:
                anchors = max(0, anchors - (tag == "a"))
            elif names.get(tag):
                close_block()
                pop_to({tag}, set())
                anchors = 0
    close_block()
    return page


def features(page: Page) -> np.ndarray:
    """One row per element."""
    n = len(page.tags)
    parent = page.parents
    own, marks, words = np.zeros(n), np.zeros(n), np.zeros(n)
    for node, text in page.blocks:
        own[node] += len(text)
        marks[node] += len(SENTENCE.findall(text))
        words[node] += text.count(" ") + 1
    chars, links, elements, sentences, many = own.copy(), np.array(page.links, float), np.ones(n), marks, words
    depth, children, order = np.zeros(n), np.zeros(n), np.zeros(n)
    drop, keep = np.zeros(n), np.zeros(n)
    for k in range(n):
        p = parent[k]
        tokens, tag = page.tokens[k], page.tags[k]
        drop[k] = sum(t in DROP_TOKENS for t in tokens) + (tag in DROP_TAGS) + (tag == "header")
        keep[k] = sum(t in KEEP_TOKENS for t in tokens) + (tag in KEEP_TAGS)
        if p >= 0:
            depth[k] = depth[p] + 1
            order[k] = children[p]
            children[p] += 1
    for k in range(n - 1, 0, -1):
        p = parent[k]
        for sums in (chars, links, elements, sentences, many):
            sums[p] += sums[k]
    above_drop, above_keep = np.zeros(n), np.zeros(n)
    for k in range(1, n):
        p = parent[k]
        above_drop[k] = max(above_drop[p], float(drop[p] > 0))
        above_keep[k] = max(above_keep[p], float(keep[p] > 0))
    up = np.maximum(np.array(parent), 0)
    beside = np.maximum(children[up] - 1, 1)
    density = links / np.maximum(chars, 1)
    total = max(chars[0], 1)
    tags = page.tags
    one = lambda names: np.array([t in names for t in tags], float)
    buckets = np.zeros((n, TOKEN_BUCKETS))
    for k, tokens in enumerate(page.tokens):
        for t in tokens:
            if t not in DROP_TOKENS and t not in KEEP_TOKENS:
                buckets[k, zlib.crc32(t.encode()) % TOKEN_BUCKETS] += 1
    rows = [
        np.log1p(chars), np.log1p(elements), chars / elements, density, depth, np.arange(n) / n, children[up], order / np.maximum(children[up], 1),
        np.log1p((chars[up] - chars) / beside), density[up], sentences / np.maximum(many, 1), np.log1p(many), chars / total, np.log1p(own), sentences,
        one({"h1", "h2", "h3", "h4", "h5", "h6"}), one({"p", "blockquote", "pre"}), one({"ul", "ol", "li", "dl"}), one({"table", "tr", "td", "th"}),
        drop, keep, above_drop, above_keep, drop[up], chars / np.maximum(chars[up], 1),
    ]
    return np.column_stack([*rows, buckets])


def said(page: Page) -> np.ndarray:
    """Labels by what the markup says outright: elements that hold main text."""
    n = len(page.tags)
    plain = any(t in KEEP_TAGS for t in page.tags)
    gone, inside, label = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n)
    for k in range(n):
        p = page.parents[k]
        tag, tokens = page.tags[k], page.tokens[k]
        told = any(t in DROP_TOKENS for t in tokens) and not any(t in KEEP_TOKENS for t in tokens)
        gone[k] = (p >= 0 and gone[p]) or tag in DROP_TAGS or told or (tag == "header" and not (p >= 0 and inside[p]))
        inside[k] = (p >= 0 and inside[p]) or tag in KEEP_TAGS or not plain
    for node, _ in page.blocks:
        if inside[node] and not gone[node]:
            label[node] = 1
    for k in range(n - 1, 0, -1):
        label[page.parents[k]] = max(label[page.parents[k]], label[k])
    return label


class Trees:
    """Boosted trees for a yes or no, on binned features. A tree is three arrays over its nodes in heap order."""

    def __init__(self) -> None:
        self.edges: np.ndarray | None = None
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)]).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        self.edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
        binned = self.bins(x)
        self.base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        score = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self.grow(binned, p - y, p * (1 - p) + 1e-6)
            self.trees.append(tree)
            score += self.apply(tree, binned)
        return self

    def grow(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = 2 ** (DEPTH + 1) - 1
        column, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        members = {0: np.arange(len(grad))}
        for node in range(size):
            rows = members.pop(node, None)
            if rows is None:
                continue
            g, h = grad[rows].sum(), hess[rows].sum()
            value[node] = -RATE * g / (h + 1.0)
            if node >= size // 2 or len(rows) < 2 * LEAF:
                continue
            best = (1e-3, -1, 0)
            for c in range(binned.shape[1]):
                at = binned[rows, c]
                gs, hs, ns = (np.cumsum(np.bincount(at, weights=w, minlength=BINS))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < LEAF) | (len(rows) - ns < LEAF)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], c, k)
            if best[1] >= 0:
                column[node], cut[node] = best[1], best[2]
                left = binned[rows, best[1]] <= best[2]
                members[2 * node + 1], members[2 * node + 2] = rows[left], rows[~left]
        return column, cut, value

    def apply(self, tree: tuple, binned: np.ndarray) -> np.ndarray:
        column, cut, value = tree
        at = np.zeros(len(binned), np.int64)
        rows = np.arange(len(binned))
        for _ in range(DEPTH):
            c = column[at]
            at = np.where(c < 0, at, 2 * at + 1 + (binned[rows, np.maximum(c, 0)] > cut[at]))
        return value[at]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        binned = self.bins(x)
        return self.base + sum(self.apply(tree, binned) for tree in self.trees)


def decode(parents: list[int], odds: np.ndarray) -> np.ndarray:
    """The likeliest choices under which all below a dropped element is dropped: an element is worth its log-odds plus
    what its children are worth if it is kept, and nothing if it is dropped."""
    worth = odds.copy()
    for k in range(len(parents) - 1, 0, -1):
        worth[parents[k]] += max(worth[k], 0.0)
    kept = worth > 0
    for k in range(1, len(parents)):
        kept[k] &= kept[parents[k]]
    return kept


def variants(html: str, rng: random.Random) -> list[str]:
    """The page itself, and one with its signs renamed and further parts from its own text."""
    texts = [t for _, t in parse(html).blocks if len(t) > 20] or ["Lorem."]
    pick = lambda: references.escape(rng.choice(texts)[: rng.randint(20, 240)])
    names = {
        "article": rng.choice(["div class=content", "div id=main", "section class=post", "div class=entry-content", "div class=story", "div class=x1", "article"]),
        "nav": rng.choice(["div class=menu", "div id=navbar", "ul class=navigation", "div class=x2", "nav"]),
        "footer": rng.choice(["div class=footer", "div id=foot", "div class=x3", "footer"]),
    }
    other = html
    for tag, new in names.items():
        other = re.sub(rf"<{tag}\b[^>]*>", f"<{new} data-role={tag}>", other, flags=re.I)
        other = re.sub(rf"</{tag}>", f"</{new.split()[0]}>", other, flags=re.I)
    extra = [
        f'<aside class="sidebar"><h3>{pick()}</h3><p>{pick()}</p></aside>', f'<div class="cookie-notice"><p>{pick()}</p><button>OK</button></div>',
        f'<div class="{rng.choice(["ads", "sponsored", "banner", "promo"])}"><p>{pick()}</p></div>', f'<form action="/s"><label>{pick()}</label><input name=q></form>',
        f'<section class="comments"><h2>Comments</h2>{"".join(f"<div class=comment><p>{pick()}</p></div>" for _ in range(rng.randint(1, 6)))}</section>',
        f'<header class="site-header"><p>{pick()}</p></header>', f'<div id="related"><ul>{"".join(f"<li><a href=/x>{pick()[:60]}</a></li>" for _ in range(5))}</ul></div>',
    ]
    body = re.search(r"<body\b[^>]*>", other, re.I)
    for part in rng.sample(extra, 4):
        at = body.end() if body and rng.random() < 0.5 else max(other.lower().rfind("</body"), 0) or len(other)
        other = other[:at] + part + other[at:]
    return [html, other]


def train_extractor(pages: DataFrame, html_column: str = "html", id_column: str = "page_id", rows: int = TRAIN_PAGES, seed: int = 11) -> Trees | None:
    """Trees from at most ``rows`` pages of at most TRAIN_CHARS characters, or None without any. In the changed copies
    the labels are those of the roles the elements had."""
    some = pages.select(F.col(id_column).alias("id"), F.col(html_column).alias("html")).where(F.length("html").between(1, TRAIN_CHARS))
    chosen = hash_sample(some.where("id is not null").select("id").distinct(), "id", rows)
    found = some.join(F.broadcast(chosen), "id").limit(2 * rows).collect()
    found.sort(key=lambda r: (str(r.id), r.html))
    rng, x, y = random.Random(seed), [], []
    for row in found:
        for html in variants(row.html, rng):
            page = parse(html)
            x.append(features(page))
            y.append(said(parse(restored(html))))
    x, y = [a for a, b in zip(x, y) if len(a) == len(b)], [b for a, b in zip(x, y) if len(a) == len(b)]
    return Trees().fit(np.concatenate(x), np.concatenate(y)) if x else None


def restored(html: str) -> str:
    """A changed copy with the signs of its roles put back as attributes, element by element."""
    words = {"article": "article", "nav": "navigation", "footer": "footer"}
    return re.sub(r"<(\w+)[^<>]*? data-role=(\w+)>", lambda m: f"<{m[1]} class={words.get(m[2], 'x')}>", html)


def main_text(page: Page, trees: Trees | None) -> str:
    kept = decode(page.parents, trees.log_odds(features(page))) if trees else said(page) > 0
    return "\n\n".join(text for node, text in page.blocks if kept[node])


def extract_main_text(pages: DataFrame, trees: Trees | None, html_column: str = "html") -> DataFrame:
    """``pages`` with text (blocks of main text joined by an empty line; empty if there is none) and n_chars (its code
    points). A null or empty page gives an empty text; broken markup is mended; without trees the markup's own signs
    decide. Repeated rows give equal texts, columns of these names are replaced."""
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def start():
        trees = shared.value

        def work(rows: list) -> pa.Array:
            found = [parse(html or "") for html in rows]
            if trees is None or not found:
                return pa.array([main_text(page, None) for page in found], pa.string())
            odds = trees.log_odds(np.concatenate([features(page) for page in found]))
            out, at = [], 0
            for page in found:
                kept = decode(page.parents, odds[at : at + len(page.tags)])
                at += len(page.tags)
                out.append("\n\n".join(text for node, text in page.blocks if kept[node]))
            return pa.array(out, pa.string())

        return work

    return pages.withColumn("text", batch_udf("string", start)(F.col(html_column))).withColumn("n_chars", F.length("text").cast("bigint"))
