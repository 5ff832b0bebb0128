"""Main text of web pages: gradient-boosted trees over the block nodes of the DOM, decoded from the root down.

A node counts as content if any article text is below it. The trees give each block node its log
odds from its own and its subtree's statistics; decoding then finds the best consistent choice, in
which a dropped node has only dropped nodes below it and a kept one without text of its own keeps a
child. Trees are grown here from pages made by rule (make_page), whose article parts are known.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from sparktrace.llm.common import named, numbered

TAG = re.compile(r"<(?:!--(.*?)(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[!?/][^>]*>)", re.S)
ATTR = re.compile(r"""\b(?:class|id|role|itemprop|aria-label|data-[a-z]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "select", "xmp", "noembed", "noframes"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Start tags that end an open element of the same kind first, and what the search for it doesn't cross.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"})}
NO_P = BLOCK - {"html", "body", "button", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "summary", "legend", "figcaption"}
TAGS = ["nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "ul", "ol", "li", "table", "tr", "td", "blockquote", "pre", "figure", "figcaption", "button", "body", "h1", "h2", "h3", "#text", "dl", "address", "dialog", "details"]
#: Elements whose presence above a node is a feature of it; the attribute tokens above it are too.
ABOVE = ["article", "main", "nav", "header", "footer", "aside", "form", "ul", "section"]
N_STATS = 16


class Node:
    __slots__ = ("tag", "tokens", "parent", "kids", "text", "linked", "depth", "order")

    def __init__(self, tag: str, tokens: tuple[str, ...], parent: Node | None):
        self.tag, self.tokens, self.parent = tag, tokens, parent
        self.kids: list[Node] = []
        self.text: list[str] = []
        self.linked = 0
        self.depth = parent.depth + 1 if parent else 0


def parse(page: str) -> Node:
    """Tree of block elements with their text; inline markup only adds to the block it is in."""
    root = Node("body", (), None)
    at, links, end = root, 0, len(page)
    stack = [root]
    position = 0

    def add(data: str) -> None:
        nonlocal at
        if not data:
            return
        if at.kids and at.kids[-1].tag != "#text" or at.kids:
            if not data.strip():
                if at.kids[-1].tag == "#text":
                    at.kids[-1].text.append(" ")
                return
            if at.kids[-1].tag != "#text":
                at.kids.append(Node("#text", (), at))
            leaf = at.kids[-1]
        else:
            leaf = at
        leaf.text.append(data)
        if links:
            leaf.linked += len(data)

    def close(to: Node) -> None:
        nonlocal at
        while stack[-1] is not to:
            stack.pop()
        stack.pop()
        at = stack[-1]

    while position < end:
        m = TAG.search(page, position)
        if not m:
            add(page[position:])
            break
        add(page[position : m.start()])
        position = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if m[2]:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCK and name not in ("html", "body"):
                found = next((n for n in reversed(stack[1:]) if n.tag == name), None)
                if found:
                    close(found)
                    links = 0
            continue
        if name in RAW:
            stop = re.compile(f"</{name}\\s*>", re.I).search(page, position)
            position = stop.end() if stop else end
            continue
        if name == "a":
            links += 1
        elif name in ("br", "hr", "img"):
            add(" ")
        elif name in BLOCK and name not in ("html", "body"):
            links = 0
            if name in NO_P and (found := next((n for n in reversed(stack[1:]) if n.tag == "p"), None)):
                close(found)
            if name in ENDS:
                same, fence = ENDS[name]
                for n in reversed(stack[1:]):
                    if n.tag in fence:
                        break
                    if n.tag in same:
                        close(n)
                        if name != "tr":
                            break
            tokens = tuple(WORD.findall(" ".join(x for found in ATTR.findall(m[4]) for x in found).lower())) if m[4].strip() else ()
            if at.text and not at.kids and "".join(at.text).strip():
                loose = Node("#text", (), at)
                loose.text, loose.linked, at.text, at.linked = at.text, at.linked, [], 0
                at.kids.append(loose)
            elif not at.kids:
                at.text = []
            node = Node(name, tokens, at)
            at.kids.append(node)
            stack.append(node)
            at = node
    return root


def clean(parts: list[str]) -> str:
    """Text of one block: character references decoded, white space runs made one space, ends trimmed."""
    return " ".join(html.unescape("".join(parts)).split())


def flat(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        node.order = len(out)
        out.append(node)
        todo += reversed(node.kids)
    return out


def features(nodes: list[Node], texts: list[str], vocabulary: dict[str, int]) -> np.ndarray:
    """Rows of statistics, tag flags and attribute-token flags, one per node in document order."""
    n = len(nodes)
    own = np.array([[len(t), t.count(" ") + 1 if t else 0, min(node.linked, len(t)), t.count(",") + t.count(".") + t.count(";"), node.tag == "p", 1] for node, t in zip(nodes, texts, strict=True)], float)
    total = own.copy()
    for i in range(n - 1, 0, -1):
        total[nodes[i].parent.order] += total[i]
    whole = max(total[0, 0], 1)
    before = np.cumsum(own[:, 0]) - own[:, 0]
    width = N_STATS + len(TAGS) + len(vocabulary)
    out = np.zeros((n, width + len(ABOVE) + len(vocabulary)))
    chars = total[:, 0]
    siblings = np.array([len(node.parent.kids) if node.parent else 1 for node in nodes], float)
    place = np.zeros(n)
    alike = np.zeros(n)
    for node in nodes:
        kinds: dict[str, int] = {}
        for i, kid in enumerate(node.kids):
            place[kid.order] = i
            kinds[kid.tag] = kinds.get(kid.tag, 0) + 1
        for kid in node.kids:
            alike[kid.order] = kinds[kid.tag]
    kin = np.array([chars[node.parent.order] if node.parent else chars[0] for node in nodes])
    out[:, :N_STATS] = np.stack([
        np.log1p(chars), total[:, 1], total[:, 2] / np.maximum(chars, 1), total[:, 3] > 0, total[:, 4], total[:, 5], chars / total[:, 5],
        [node.depth for node in nodes], siblings, place, alike, before / whole, chars / whole, chars / np.maximum(kin, 1), own[:, 0] / np.maximum(chars, 1), total[:, 1] / np.maximum(total[:, 5], 1),
    ], 1)
    for i, node in enumerate(nodes):
        if node.tag in _TAG_AT:
            out[i, _TAG_AT[node.tag]] = 1
        for token in node.tokens:
            if (at := vocabulary.get(token)) is not None:
                out[i, N_STATS + len(TAGS) + at] = 1
        if i:
            up = node.parent.order
            out[i, width:] = out[up, width:]
            out[i, width + len(ABOVE) :] += out[up, N_STATS + len(TAGS) : width]
            if node.parent.tag in ABOVE:
                out[i, width + ABOVE.index(node.parent.tag)] = 1
    return out


_TAG_AT = {tag: N_STATS + i for i, tag in enumerate(TAGS)}


class Trees:
    """Boosted regression trees for log odds, grown on quantile bins."""

    def __init__(self, rounds: int = 120, depth: int = 5, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, wide = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(wide)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score, self.trees = np.full(n, self.start), []
        everything, rng = binned, np.random.default_rng(0)
        for _ in range(self.rounds):
            some = np.unique(np.concatenate([np.arange(min(N_STATS, x.shape[1])), rng.permutation(x.shape[1])[: max(1, x.shape[1] // 3)]]))
            binned, wide = everything[:, some], len(some)
            offset = np.arange(wide) * self.bins
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            at, feature, cut, value = np.zeros(n, int), [], [], []
            for level in range(self.depth):
                leaves = 1 << level
                cell = (at[:, None] * wide * self.bins + offset + binned).ravel()
                g = np.bincount(cell, np.repeat(grad, wide), leaves * wide * self.bins).reshape(leaves, wide, self.bins).cumsum(2)
                h = np.bincount(cell, np.repeat(hess, wide), leaves * wide * self.bins).reshape(leaves, wide, self.bins).cumsum(2)
                left = g**2 / (h + self.ridge)
                right = (g[:, :, -1:] - g) ** 2 / (h[:, :, -1:] - h + self.ridge)
                best = (left + right).reshape(leaves, -1).argmax(1)
                f, b = best // self.bins, best % self.bins
                feature.append(some[f])
                cut.append(np.array([self.edges[j][k] if k < len(self.edges[j]) else np.inf for j, k in zip(some[f], b, strict=True)]))
                at = at * 2 + (binned[np.arange(n), f[at]] > b[at])
            leaf = np.bincount(at, grad, 1 << self.depth) / (np.bincount(at, hess, 1 << self.depth) + self.ridge) * self.rate
            value = leaf
            score = score + leaf[at]
            self.trees.append((feature, cut, value))
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), int)
            for f, c in zip(feature, cut, strict=True):
                at = at * 2 + (x[rows, f[at]] > c[at])
            out += value[at]
        return out


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Best consistent choice: per node, kept or not, given each node's log odds of being content."""
    n = len(nodes)
    keep = np.minimum(odds, 0) - np.log1p(np.exp(-np.abs(odds)))
    drop = np.minimum(-odds, 0) - np.log1p(np.exp(-np.abs(odds)))
    below_drop, below_keep = drop.copy(), keep.copy()
    for i in range(n - 1, -1, -1):
        kids = [k.order for k in nodes[i].kids]
        if kids:
            below_drop[i] += sum(below_drop[k] for k in kids)
            gain = [below_keep[k] - below_drop[k] for k in kids]
            below_keep[i] += sum(max(below_keep[k], below_drop[k]) for k in kids) + min(0.0, max(gain))
    kept = np.zeros(n, bool)
    kept[0] = below_keep[0] > below_drop[0]
    for i, node in enumerate(nodes):
        if kept[i] and node.kids:
            gain = [below_keep[k.order] - below_drop[k.order] for k in node.kids]
            most = max(gain)
            for kid, g in zip(node.kids, gain, strict=True):
                kept[kid.order] = g > 0 or (most <= 0 and g == most)
    return kept


#: Names that pages commonly give to parts of each kind.
NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav toc pagination pager tabs", "header": "header masthead banner topbar logo branding site", "footer": "footer copyright colophon bottom legal",
    "aside": "sidebar aside related recommended widget rail side more popular trending", "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner adsbygoogle commercial",
    "notice": "notice cookie consent gdpr alert message popup modal overlay banner warning", "form": "form search newsletter subscribe signup login contact", "comments": "comments comment reply replies discussion respond thread disqus reader",
    "share": "share social sharing follow buttons", "article": "article content main post entry story body text",
}


def make_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page made by rule and its article blocks, in order."""
    letters = "aeiourstnlmdchpbgvfkw"
    noise, loud = rng.choice(["", "", "", "!!", "###", "***", " | ", "%%%"]), rng.random() < 0.1

    def sentence(least: int = 1, most: int = 18) -> str:
        found = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(least, most))]
        for i in range(len(found)):
            if rng.random() < 0.08:
                found[i] += ","
        whole = " ".join(found).capitalize() + rng.choice([".", ".", ".", "?", "!", ""])
        whole = whole.replace(" ", noise + " ") + noise if noise else whole
        return whole.upper() if loud else whole

    def prose(most: int = 7) -> str:
        if rng.random() < 0.05:
            return " ".join([sentence()] * rng.randint(2, 6))
        return " ".join(sentence() for _ in range(rng.randint(1, most)))

    def named(kind: str, tag: str, inside: str) -> str:
        attrs = ""
        if tag not in ("nav", "header", "footer", "aside", "form", "article", "main") or rng.random() < 0.4:
            found = rng.sample(NAMES[kind].split(), rng.randint(1, 2))
            if rng.random() < 0.9:
                attrs = f' {rng.choice(["class", "class", "id"])}="{rng.choice("- _").join(found)}"'
        return f"<{tag}{attrs}>{inside}</{tag}>"

    def link_list() -> str:
        inside = "".join(f'<li><a href="/{i}">{sentence(1, 3).rstrip(".")}</a></li>' for i in range(rng.randint(1, 9)))
        return f"<ul>{inside}</ul>"

    def aside_part(kind: str) -> str:
        if kind == "nav":
            return named(kind, rng.choice(["nav", "nav", "div", "ul"]), link_list())
        if kind == "header":
            return named(kind, rng.choice(["header", "div"]), rng.choice([f"<a href='/'>{sentence(1, 3)}</a>", f"<h1>{sentence(1, 4)}</h1>", sentence(1, 6)]) + rng.choice(["", link_list()]))
        if kind == "footer":
            return named(kind, rng.choice(["footer", "footer", "div"]), rng.choice([f"&copy; {sentence(1, 8)}", f"<p>{sentence(2, 12)}</p>", link_list() + f"<p>&copy; {sentence(1, 5)}</p>"]))
        if kind == "aside":
            return named(kind, rng.choice(["aside", "aside", "div", "section"]), f"<h3>{sentence(1, 4)}</h3>" * rng.randint(0, 1) + rng.choice([link_list(), f"<p>{prose(3)}</p>", f"<div>{sentence()}</div>"]))
        if kind == "form":
            return named(kind, rng.choice(["form", "form", "div"]), f"<p>{sentence(1, 10)}</p><label>{sentence(1, 3)}</label><input name=q><button>{sentence(1, 2)}</button>")
        if kind == "comments":
            each = "".join(f'<{t} class="comment"><b>{sentence(1, 2)}</b><p>{prose(4)}</p></{t}>' for t in rng.choices(["div", "li", "article"], k=rng.randint(1, 6)))
            return named(kind, rng.choice(["section", "div", "ol"]), f"<h2>{sentence(1, 3)}</h2>" * rng.randint(0, 1) + each)
        return named(kind, rng.choice(["div", "div", "section", "aside", "p"] if kind in ("ad", "notice") else ["div", "ul"]), rng.choice([sentence(1, 14), f"<p>{prose(2)}</p>", f"<a href=x>{sentence(1, 8)}</a>"]) if rng.random() < 0.9 else prose(3))

    blocks, body = [], []

    def block(tag: str, data: str) -> str:
        blocks.append(clean([data]))
        return f"<{tag}>{data}</{tag}>" if rng.random() < 0.9 or tag != "p" else f"<p><b>{data}<br>"

    for _ in range(rng.choice([1, 1, 1, 1, 2, 2, 3, 5, 8, 12, 20])):
        kind = rng.random()
        if kind < 0.75:
            body.append(block("p", prose(rng.choice([1, 3, 9]))))
        elif kind < 0.83:
            body.append(block(rng.choice(["h2", "h3"]), sentence(1, 8)))
        elif kind < 0.9:
            body.append("<ul>" + "".join(block("li", sentence(1, 14)) for _ in range(rng.randint(1, 5))) + "</ul>")
        elif kind < 0.94:
            body.append("<blockquote>" + block("p", prose(3)) + "</blockquote>")
        elif kind < 0.97:
            body.append("<table>" + "".join("<tr>" + block("td", sentence(1, 5)) + block("td", sentence(1, 5)) + "</tr>" for _ in range(2)) + "</table>")
        else:
            body.append(block("pre", sentence(3, 20)))
        if rng.random() < 0.07:
            body.append(aside_part(rng.choice(["ad", "aside", "share", "form", "notice"])))
    if rng.random() < 0.8:
        rest, blocks[:] = list(blocks), []
        body.insert(0, block("h1", sentence(1, 12)))
        blocks += rest
    inner = "".join(body)
    if rng.random() < 0.25:
        inner += aside_part(rng.choice(["share", "comments", "footer"]))
    article = rng.choice(["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", named("article", "div", "{}"), named("article", "div", "<div>{}</div>"), named("article", "section", "{}")]).format(inner)
    first = [aside_part(k) for k in ("header", "nav", "notice", "ad", "form", "aside") if rng.random() < 0.45]
    last = [aside_part(k) for k in ("comments", "aside", "ad", "form", "share", "nav") if rng.random() < 0.35] + [aside_part("footer")] * (rng.random() < 0.8)
    rng.shuffle(first)
    whole = "".join(first) + article + "".join(last)
    if rng.random() < 0.2:
        whole = f'<div id="{rng.choice(["wrapper", "page", "root"])}">{whole}</div>'
    return f"<html><head><title>x</title></head><body>{whole}</body></html>", blocks


def labelled(page: str, blocks: list[str]) -> tuple[list[Node], list[str], np.ndarray]:
    """Nodes of a made page, their texts and whether each is content (its blocks follow in order)."""
    nodes = flat(parse(page))
    texts = [clean(n.text) for n in nodes]
    y, nth = np.zeros(len(nodes)), 0
    for i, text in enumerate(texts):
        if text and nth < len(blocks) and text == blocks[nth]:
            y[i], nth = 1, nth + 1
    for i in range(len(nodes) - 1, 0, -1):
        if y[i]:
            y[nodes[i].parent.order] = 1
    return nodes, texts, y


@lru_cache(1)
def model(pages: int = 800, seed: int = 5) -> tuple[Trees, dict[str, int]]:
    rng = random.Random(seed)
    found = [labelled(*make_page(rng)) for _ in range(pages)]
    counts: dict[str, int] = {}
    for nodes, _, _ in found:
        for token in {t for n in nodes for t in n.tokens}:
            counts[token] = counts.get(token, 0) + 1
    vocabulary = {t: i for i, t in enumerate(sorted(t for t, c in counts.items() if c >= 3))}
    x = np.concatenate([features(nodes, texts, vocabulary) for nodes, texts, _ in found])
    return Trees().fit(x, np.concatenate([y for _, _, y in found])), vocabulary


def main_text(pages: list[str | None], trees: Trees, vocabulary: dict[str, int]) -> list[str]:
    """Main text of each page, blocks in page order joined by newlines."""
    trees_of = [flat(parse(p or "")) for p in pages]
    texts_of = [[clean(n.text) for n in nodes] for nodes in trees_of]
    odds = trees.log_odds(np.concatenate([features(n, t, vocabulary) for n, t in zip(trees_of, texts_of, strict=True)])) if pages else []
    out, at = [], 0
    for nodes, texts in zip(trees_of, texts_of, strict=True):
        kept = decode(nodes, odds[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n".join(t for t, k in zip(texts, kept, strict=True) if k and t))
    return out


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    A null, empty or text-free page has an empty text; null ids and urls stay null; repeated rows
    give repeated results; further columns are ignored; an empty table gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t for i in range(0, len(batch), 64) for t in main_text(batch["html"].iloc[i : i + 64].tolist(), *shared.value)]
            yield pd.DataFrame({"page_id": batch["page_id"].array, "url": batch["url"].array, "text": texts, "n_chars": [len(t) for t in texts]})

    return numbered(named(pages, "url", "html", name="page_id").mapInPandas(run, "page_id string, url string, text string, n_chars long"), "page_id")
