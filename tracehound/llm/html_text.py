"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a node with a label: content or not. Node potentials weigh what the
tag, class, id and role say and how the node's own text looks (length, share inside links,
sentence ends); parent-child potentials tie a node to the one it stands in. Messages go from
the leaves to the root and back (sum-product), which is exact on a tree and gives every node
its marginal. A block's text belongs to the main text if content is the likelier label.

Weights are fitted by maximum likelihood on labelled pages: the gradient is the difference of
observed and expected features, expectations coming from the same messages. The labelled
pages are built from a grammar of page layouts (``labelled_pages``), as no table has labels;
other labelled pages can be given. Pages of a batch go through the messages together, level
by level.

Scripts, styles, comments, form controls and the head never give text. Character references
are decoded, white space inside a block becomes one blank, blocks are joined by a line end.
Null html is empty and gives the empty text; broken markup is read as far as it goes; repeated
rows keep their own result rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tracehound.llm.common import query, table

# a quote opens a value only right behind the equals sign
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+"[^"]*(?:"|\Z)|=\s*+'[^']*(?:'|\Z)|[^>])*+)(?:>|\Z)""", re.S)
_MARK = re.compile(r"""\b(class|id|role|data-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)

# Elements by what a parser has to do with them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript iframe template xmp noembed noframes".split())
SILENT = set("head button select option optgroup datalist svg math object canvas audio video map".split())
BLOCKS = set(
    "html body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr "
    "td th caption blockquote pre figure figcaption form fieldset address details summary dialog hgroup center".split()
)
CLOSES_P = BLOCKS - set("html body td th caption".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
SCOPE |= {"option": BLOCKS | {"select", "datalist", "optgroup"}, "optgroup": BLOCKS | {"select", "datalist"}}
FOREIGN = ("svg", "math")  # a slash at a tag's end closes the element in there only

SPEAKING = set("main article section nav aside header footer form dialog address".split())

# What names of classes, ids and roles tell.
NAMES = {
    "content": r"content|article|post|entry|main|story|body|text",
    "menu": r"nav|menu|breadcrumb|toc|pager|pagination|tabs",
    "head": r"header|masthead|banner|topbar|logo|brand",
    "foot": r"footer|bottom|copyright|legal|contentinfo|colophon",
    "side": r"side|aside|widget|related|recommend|complementary|rail|popular|more",
    "advert": r"\bad\b|\bads\b|advert|sponsor|promo|adsense|banner-ad|adsbygoogle",
    "notice": r"cookie|notice|consent|alert|gdpr|popup|modal|warning|message",
    "comment": r"comment|reply|replies|discuss|disqus|respond",
    "form": r"form|login|subscribe|newsletter|search|signup",
    "share": r"share|social|follow|tags?\b|meta|byline",
}
_NAMES = {k: re.compile(v, re.I) for k, v in NAMES.items()}
TAGS = "html body main article section nav aside header footer div p h1 h2 h3 h4 ul ol li table tr td dl dd blockquote pre figure form fieldset address details".split()
LOOKS = ["bias", "named", "empty", "short", "middle", "long", "linked", "some_links", "sentence", "many_parts", "bare page"]
PLAIN = ("article", "main", "section", "div", "ul", "ol", "body")  # elements that mean another thing without a name
FEATURES = {name: k for k, name in enumerate([*LOOKS, *("tag " + t for t in [*TAGS, "other"]), *("plain " + t for t in PLAIN), *("name " + n for n in NAMES)])}


@dataclass
class Page:
    """Nodes in page order: parent, tag, names, own text runs; runs: (node, text)."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)


def parse(source: str, labelled: bool = False) -> Page:
    """Block elements of a page and the text runs between their edges.

    Labels are read from training pages only; on others the attribute means something else.
    """
    page, held, letters = Page(), [], 0
    stack: list[tuple[str, int]] = []  # open elements; block elements with their node, others with the node they are in
    opened: dict[str, list[int]] = defaultdict(list)  # by tag: places on the stack

    def add(tag: str, names: str, label: int) -> int:
        page.parent.append(stack[-1][1] if stack else -1)
        page.tag.append(tag)
        page.names.append(names)
        page.label.append(label)
        page.linked.append(0)
        return len(page.parent) - 1

    stack.append(("html", add("html", "", 0)))
    links = silent = 0

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            page.runs.append((stack[-1][1], text))

    def pop_to(k: int) -> None:
        nonlocal links, silent
        if any(t in BLOCKS for t, _ in stack[k:]):
            flush()
        for tag, _ in stack[k:]:
            opened[tag].pop()
            links -= tag == "a"
            silent -= tag in SILENT
        del stack[k:]

    def push(tag: str, node: int) -> None:
        opened[tag].append(len(stack))
        stack.append((tag, node))

    def close(tag: str, scope: set[str]) -> None:
        """Close the innermost element of that tag, unless one of ``scope`` is open in it."""
        if opened.get(tag) and not any(opened[t][-1] > opened[tag][-1] for t in scope if opened.get(t)):
            pop_to(opened[tag][-1])

    def self_closed(tag: str, marks: str) -> bool:
        if not marks.endswith("/") or not (tag in FOREIGN or any(opened.get(t) for t in FOREIGN)):
            return False
        last = marks.split()[-1]  # a bare value takes the slash
        return "=" not in last or last[-2] in "\"'="

    def say(raw: str) -> None:
        nonlocal letters
        if raw and not silent:
            text = html.unescape(raw)
            held.append(text)
            if links:
                page.linked[stack[-1][1]] += len(text.strip())

    at = 0
    while True:
        m = _TOKEN.search(source, at)
        if m is None:
            say(source[at:])
            break
        say(source[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            close(tag, set() if tag in BLOCKS else {"td", "th", "body"})
            continue
        if self_closed(tag, m[3]):
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag == "br":
            held.append(" ")
        if tag == "hr":
            close("p", BLOCKS - {"p"})
            flush()
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            close("p", BLOCKS - {"p"})
        for other in SAME.get(tag, ()):
            close(other, SCOPE[tag])
        if tag in BLOCKS:
            flush()
            marks = {k.lower(): v.strip("\"'") for k, v in _MARK.findall(m[3] or "")}
            own = marks.get("data-label") if labelled else None
            label = int(own) if own else page.label[stack[-1][1]]
            if tag == "html":
                page.label[0] = label
                continue
            node = add(tag, " ".join(marks.get(k, "") for k in ("class", "id", "role")), label)
            push(tag, node)
        else:
            links += tag == "a"
            silent += tag in SILENT
            push(tag, stack[-1][1])
    flush()
    return page


def features(page: Page) -> list[list[int]]:
    """Features that hold for each node."""
    size, last, parts = [0] * len(page.parent), [""] * len(page.parent), [0] * len(page.parent)
    for node, text in page.runs:
        size[node] += len(text)
        last[node] = text
        parts[node] += 1
    # a page without any element that speaks for itself is likely nothing but text
    bare = not any(t in SPEAKING or n.strip() for t, n in zip(page.tag, page.names, strict=True))
    out = []
    for k, tag in enumerate(page.tag):
        on = ["bias", *(["bare page"] if bare and k == 0 else []), "tag " + tag if "tag " + tag in FEATURES else "tag other"]
        on.append("empty" if not size[k] else "short" if size[k] < 40 else "middle" if size[k] < 200 else "long")
        if size[k]:
            share = page.linked[k] / size[k]
            on += ["linked"] if share > 0.6 else ["some_links"] if share > 0.2 else []
            on += ["sentence"] if last[k][-1:] in ".!?\"”»…" else []
        on += ["many_parts"] if parts[k] > 3 else []
        if page.names[k].strip():
            on += ["named", *("name " + n for n, pattern in _NAMES.items() if pattern.search(page.names[k]))]
        elif tag in PLAIN:
            on.append("plain " + tag)
        out.append([FEATURES[f] for f in on])
    return out


@dataclass
class Model:
    """unary: features x 2; pair: kind of edge x parent label x own label.

    Edges to elements that speak for themselves, by tag or name, are of another kind than those to plain ones.
    """

    unary: np.ndarray
    pair: np.ndarray


class Forest:
    """Pages of a batch as one forest, with the sum-product messages over it."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.parent) for p in pages]
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + s) for p, s in zip(pages, self.start, strict=False)])
        held = [f for p in pages for f in features(p)]
        self.rows = np.repeat(np.arange(len(held)), [len(h) for h in held])
        self.cols = np.fromiter((c for h in held for c in h), np.int64, len(self.rows))
        self.kind = np.array([int(t in SPEAKING or bool(n.strip())) for p in pages for t, n in zip(p.tag, p.names, strict=True)])
        depth = np.zeros(len(self.parent), np.int64)
        for k, p in enumerate(self.parent.tolist()):  # parents come before their children
            if p >= 0:
                depth[k] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)

    def marginals(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """Of each node's label, and of each (parent label, own label)."""
        n = len(self.parent)
        own = np.zeros((n, 2))
        np.add.at(own, self.rows, model.unary[self.cols])
        up, message = own.copy(), np.zeros((n, 2))
        for level in reversed(self.levels[1:]):
            pair = model.pair[self.kind[level]]
            message[level] = np.logaddexp(pair[:, :, 0] + up[level][:, :1], pair[:, :, 1] + up[level][:, 1:])
            np.add.at(up, self.parent[level], message[level])
        belief, pairs = up.copy(), np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            outer = belief[self.parent[level]] - message[level]  # what the parent knows without this child
            joint = outer[:, :, None] + model.pair[self.kind[level]] + up[level][:, None, :]
            belief[level] = np.logaddexp(joint[:, 0], joint[:, 1])
            joint -= joint.max((1, 2), keepdims=True)
            joint = np.exp(joint)
            pairs[level] = joint / joint.sum((1, 2), keepdims=True)
        belief -= belief.max(1, keepdims=True)
        belief = np.exp(belief)
        return belief / belief.sum(1, keepdims=True), pairs


def train(pages: list[Page], steps: int = 300, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """Maximum likelihood on pages whose nodes are labelled."""
    forest = Forest(pages)
    label = np.concatenate([p.label for p in pages])
    truth = np.eye(2)[label]
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (forest.kind[child], label[forest.parent[child]], label[child]), 1)
    model = Model(np.zeros((len(FEATURES), 2)), np.zeros((2, 2, 2)))
    past = [np.full_like(model.unary, 1e-6), np.full_like(model.pair, 1e-6)]
    for _ in range(steps):
        nodes, pairs = forest.marginals(model)
        grad = np.zeros_like(model.unary)
        np.add.at(grad, forest.cols, (truth - nodes)[forest.rows])
        expected = np.zeros_like(seen)
        np.add.at(expected, forest.kind[child], pairs[child])
        for value, g, p in ((model.unary, grad, past[0]), (model.pair, seen - expected, past[1])):
            g = g / len(label) - decay * value
            p += g * g
            value += rate * g / np.sqrt(p)
    return model


def labelled_pages(n: int = 400, seed: int = 3) -> list[Page]:
    """Pages of a grammar of layouts; what is content is known for every node."""
    rng = np.random.default_rng(seed)
    pick = lambda *options: options[rng.integers(len(options))]
    syllables = "ta re mi no ka su li don ver ing est ou al per sha en".split()
    word = lambda: "".join(pick(*syllables) for _ in range(rng.integers(1, 4)))
    say = lambda low, high, end=".": " ".join(word() for _ in range(rng.integers(low, high))).capitalize() + end

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(k)) + "</ul>"

    def off(options: tuple[str, ...], inner: str) -> str:
        opening = pick(*options)
        tag = re.match(r"\w+", opening)[0]
        return f'<{opening} data-label="0">{inner}</{tag}>'

    def menu() -> str:
        return off(("nav", "div class='menu'", "div id='navbar'", "ul class='breadcrumb'", "div role='navigation'"), links(rng.integers(2, 9)))

    def top() -> str:
        return off(("header", "div class='header'", "div id='masthead'"), pick(f"<h1>{say(1, 4, '')}</h1>", f"<p>{say(2, 9)}</p>", say(1, 5, "")) + pick("", menu()))

    def foot() -> str:
        return off(("footer", "div class='footer'", "div id='page-footer'"), pick(f"&copy; {say(1, 20)}", f"<p>{say(3, 25)}</p>", links(4)))

    def side() -> str:
        return off(("aside", "div class='sidebar'", "div id='sidebar'", "div class='related-posts'", "section class='widget'"), f"<h3>{say(1, 4, '')}</h3>" + pick(links(5), f"<p>{say(5, 40)}</p>"))

    def advert() -> str:
        return off(("div class='ad'", "div class='advert'", "div id='ads-top'", "section class='sponsored'", "aside class='promo'"), pick(say(3, 20), f"<p>{say(3, 30)}</p>"))

    def notice() -> str:
        return off(("div class='cookie-notice'", "div id='consent'", "div class='alert'", "div class='notice'", "dialog class='popup'"), pick(say(4, 25), f"<p>{say(4, 25)}</p>"))

    def remarks() -> str:
        each = "".join(f"<{t}><p>{say(3, 60)}</p></{t}>" for t in [pick("div class='comment'", "li", "article class='comment'")] * rng.integers(1, 4))
        each = re.sub(r"</(\w+) [^>]*>", r"</\1>", each)
        return off(("section class='comments'", "div id='comments'", "div class='replies'", "ol class='commentlist'"), pick("", "<h3>Comments</h3>") + each)

    def ask() -> str:
        return off(("form", "form class='search'", "div class='newsletter'", "form id='login'"), f"<p>{say(2, 12)}</p><input><button>{word()}</button>")

    def share() -> str:
        return off(("div class='share'", "ul class='social'"), links(3))

    def block() -> str:
        kind = rng.integers(12)
        if kind < 7:
            return f"<p>{say(1, pick(6, 30, 90), pick('.', '.', ''))}" + pick("</p>", "</p>", "")
        if kind == 7:
            return f"<h2>{say(1, 8, '')}</h2>"
        if kind == 8:
            return "<ul>" + "".join(f"<li>{say(2, 15)}</li>" for _ in range(3)) + "</ul>"
        if kind == 9:
            return pick(f"<blockquote>{say(5, 40)}</blockquote>", f"<blockquote><p>{say(5, 40)}</p></blockquote>", f"<pre>{say(4, 20)}</pre>")
        if kind == 10:
            return f"<p><b>{say(3, 12)}<br>" + pick("", "</b></p>")
        return "<table><tr>" + "".join(f"<td>{say(1, 5, '')}</td>" for _ in range(3)) + "</tr></table>"

    def article() -> str:
        inner = pick(f"<h1>{say(2, 10, '')}</h1>", f"<h1>{say(2, 10)}</h1>", "") + "".join(block() for _ in range(rng.integers(1, 9)))
        for extra in (advert, share, remarks, side):
            if rng.random() < 0.2:
                inner += extra() + pick("", block())
        opening = pick("article", "article", "main", "div class='content'", "div class='post'", "div class='entry-content'", "div id='article-body'", "section class='story'", "div class='main-text'", "main id='main'")
        return f'<{opening} data-label="1">{inner}</{re.match(r"[a-z]+", opening)[0]}>'

    out = []
    for _ in range(n):
        before = [f() for f in (top, menu, notice, advert, ask, side) if rng.random() < 0.35]
        after = [f() for f in (side, remarks, advert, ask, share, foot, foot, notice) if rng.random() < 0.35]
        body = "".join([*before, article(), *after])
        if rng.random() < 0.3:
            body = f"<div class='{pick('page', 'wrapper', 'container')}'>{body}</div>"
        if rng.random() < 0.2:  # a page that is nothing but text, with or without a body element
            lines = [f"<p>{say(4, pick(20, 60))}</p>" for _ in range(rng.integers(1, 7))]
            lines[:0] = pick([], [], [f"<h1>{say(2, 10, '')}</h1>"])
            out.append(parse(f'<html data-label="1">{pick("", "<body>")}{"".join(lines)}', labelled=True))
            continue
        out.append(parse(f"<html><body>{body}</body></html>", labelled=True))
    return out


def main_text(pages: list[Page], model: Model) -> list[str]:
    if not pages:
        return []
    forest = Forest(pages)
    content = forest.marginals(model)[0][:, 1] >= 0.5
    return ["\n".join(text for node, text in p.runs if content[s + node]) for p, s in zip(pages, forest.start.tolist(), strict=False)]


def extract(pages: DataFrame, model: Model | None = None, together: int = 200) -> DataFrame:
    """page_id, url, text and n_chars of every row; trained on the labelled pages unless a model is given."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train(labelled_pages()))
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), together):
                part = batch.iloc[at : at + together]
                texts = main_text([parse(h or "") for h in part["html"]], shared.value)
                yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


@query("op6_html_text")
def op6_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
