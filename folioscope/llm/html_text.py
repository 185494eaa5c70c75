"""Main text of web pages by a graphical model over the document tree.

Every block element is a variable: does it hold main text? Its own potential
comes from its tag, its class and id words, its text and its links; potentials
between parent and child tie neighbours together. Messages pass from the leaves
up and from the root down (sum-product), which gives the exact marginal of each
node. Text of nodes with a marginal of one half or more is kept.

All potentials are fitted to labelled pages: outlines that are labelled here,
in ``LABELLED``, and a bounded sample of the table's own pages whose mark-up
names an article, labelled by it. Without such pages the outlines alone do.

A NULL or empty page has an empty text. Broken mark-up is read tolerantly: what
isn't closed ends with its parent, and an unclosed script or comment runs to the
end. Repeated pages are read each; other columns are not looked at.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, map_slices

#: Most pages of the table that are used to fit, taken by a hash of their id.
FIT_PAGES = 2_000
RIDGE, FIT_STEPS = 1e-5, 1_000
#: Neighbours alike may not outweigh what a node itself shows.
AGREE_MOST = 1.0
KINDS = ("page", "part", "inner")

# Fixed names of the mark-up language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object select option datalist textarea".split())
BLOCKS = frozenset(
    "html body head title main article section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd "
    "table caption thead tbody tfoot tr td th form fieldset legend figure figcaption blockquote pre address hr "
    "details summary dialog menu center button label".split()
)
CLOSED_BY_ITSELF = {
    "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option",
}
CLOSES_P = BLOCKS - frozenset("html body head title button label caption thead tbody tfoot tr td th legend summary".split())
SCOPES = frozenset("table ul ol dl html body article section div main aside nav header footer form".split())
TOKENS = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role|data-main|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "names", "main", "own", "linked", "total", "total_linked", "places")

    def __init__(self, tag: str, parent: int, names: list[str], main: str | None):
        self.tag, self.parent, self.names, self.main = tag, parent, names, main
        self.own = self.linked = self.total = self.total_linked = 0
        self.places: list[int] = []


def parse(page: str) -> tuple[list[Node], list[tuple[int, list[str]]]]:
    """Block elements, parents before children, and runs of text with their block in page order."""
    nodes, runs = [Node("#root", -1, [], None)], [(0, [])]
    stack: list[tuple[str, int]] = [("#root", 0)]
    links = 0
    at, size = 0, len(page)

    def say(text: str) -> None:
        block = stack[-1][1]
        if runs[-1][0] != block:
            runs.append((block, []))
        runs[-1][1].append(text)
        length = len(text.strip())
        nodes[block].own += length
        nodes[block].linked += length if links else 0

    def leave(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            tag, block = stack.pop()
            links -= tag == "a"
            if block != stack[-1][1]:
                runs.append((stack[-1][1], []))

    while at < size:
        found = TOKENS.search(page, at)
        if not found:
            say(html.unescape(page[at:]))
            break
        if found.start() > at:
            say(html.unescape(page[at : found.start()]))
        at = found.end()
        closing, tag = found[1] or found[4], (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if depth:
                leave(depth)
            continue
        if tag in RAW or tag == "title":
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag == "br" or tag in VOID:
            say(" ")
            continue
        if tag in CLOSES_P or tag in CLOSED_BY_ITSELF:
            shut = {*CLOSED_BY_ITSELF.get(tag, "").split(), *(["p"] if tag in CLOSES_P else [])}
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in shut:
                    leave(i)
                    break
                if stack[i][0] in SCOPES:
                    break
        if tag in BLOCKS:
            names, main = [], None
            attributes = found[3] or found[6] or ""
            for name, *values in ATTRIBUTE.findall(attributes) if "=" in attributes or "hidden" in attributes else ():
                value = next(filter(None, values), "")
                if name.lower() == "data-main":
                    main = value
                else:
                    names += [w.lower() for w in WORDS.findall(value)] if value else [name.lower()]
            nodes.append(Node(tag, stack[-1][1], names, main))
            runs.append((len(nodes) - 1, []))
            if not found[0].endswith("/>"):
                stack.append((tag, len(nodes) - 1))
        else:
            links += tag == "a"
            stack.append((tag, stack[-1][1]))
    for node in reversed(nodes):
        node.total += node.own
        node.total_linked += node.linked
        if node.parent >= 0:
            nodes[node.parent].total += node.total
            nodes[node.parent].total_linked += node.total_linked
    return nodes, runs


def kind_of_tag(tag: str) -> str:
    """Which potentials hold between an element and its children."""
    return "page" if tag in ("#root", "html", "body") else "part" if tag in ("div", "section", "main") else "inner"


def features(node: Node, parent: Node | None) -> list[str]:
    share = node.total_linked / node.total if node.total else 0
    found = [f"tag {node.tag}", f"linked {0 if share == 0 else 1 if share < 0.4 else 2}"]
    found.append(f"length {min(5, int(math.log(node.own + 1, 4)))}")
    found += [f"name {n}" for n in dict.fromkeys(node.names)]
    if parent is not None:
        found += [f"inside {parent.tag}"]
    return found


class Potentials:
    """Logarithms of the node potentials by feature, and of the reward for equal neighbours by kind of parent."""

    def __init__(self, weight: dict[str, float], agree: dict[str, float]):
        self.weight, self.agree = weight, agree

    @classmethod
    def counted(cls, seen: Counter) -> Potentials:
        """Both together by pseudo-likelihood: each label given the node's features and its neighbours' labels."""
        names = sorted({f for key, *_ in seen for f in key.split("\n")})
        index = {f: i for i, f in enumerate([*(f"agree {k}" for k in KINDS), *names])}
        rows, columns, values, labels = [], [], [], []
        for i, (key, above, below, label) in enumerate(seen):
            kind, *own = key.split("\n")
            parts = [(f, 1.0) for f in own]
            parts += [(f"agree {kind}", float(above)), (f"agree {kind_of_tag(own[0][4:])}", float(below))]
            for f, v in parts:
                rows.append(i)
                columns.append(index[f])
                values.append(v)
            labels.append(label)
        rows, columns, values = np.array(rows), np.array(columns), np.array(values)
        labels = np.array(labels, float)
        # Frequent shapes count more, but not in proportion: a page full of one shape is one author's habit.
        weights = np.sqrt(np.array(list(seen.values()), float))
        weights /= weights.sum()
        found = np.zeros(len(index))
        first, second = np.zeros(len(index)), np.zeros(len(index))
        for turn in range(1, FIT_STEPS + 1):
            z = np.bincount(rows, values * found[columns], len(labels))
            error = weights * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels)
            slope = np.bincount(columns, values * error[rows], len(index)) + RIDGE * found
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
            found -= 0.1 * first / (1 - 0.9**turn) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-9) / (1 + turn / 200)
            found[: len(KINDS)] = np.clip(found[: len(KINDS)], 0, AGREE_MOST)
        made = dict(zip(index, found.tolist()))
        return cls({f: made[f] for f in names}, {k: made[f"agree {k}"] for k in KINDS})

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Chance of each node to hold main text, by messages up and down the tree."""
        kinds = [kind_of_tag(node.tag) for node in nodes]
        # For a parent without and with main text, and a child without and with it.
        pair = {(k, p, c): math.exp(a if p == c else -a) for k, a in self.agree.items() for p in (0, 1) for c in (0, 1)}
        own = []
        for node in nodes:
            parent = nodes[node.parent] if node.parent >= 0 else None
            # Text outside of all elements is the page itself.
            z = sum(self.weight.get(f, 0.0) for f in features(node, parent)) if parent else 1.0
            z = max(-30.0, min(30.0, z))
            own.append((1 / (1 + math.exp(z)), 1 / (1 + math.exp(-z))))
        up, to_parent = [list(o) for o in own], [(1.0, 1.0)] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            no, yes = up[i]
            kind = kinds[nodes[i].parent]
            m0 = pair[kind, 0, 0] * no + pair[kind, 0, 1] * yes
            m1 = pair[kind, 1, 0] * no + pair[kind, 1, 1] * yes
            to_parent[i] = (m0 / (m0 + m1), m1 / (m0 + m1))
            above = up[nodes[i].parent]
            a, b = above[0] * to_parent[i][0], above[1] * to_parent[i][1]
            above[0], above[1] = a / (a + b), b / (a + b)
        found = [0.0] * len(nodes)
        belief = [(0.5, 0.5)] * len(nodes)
        for i, node in enumerate(nodes):
            no, yes = up[i]
            if i:
                # The parent's belief without what this node told it.
                p0 = belief[node.parent][0] / max(to_parent[i][0], 1e-12)
                p1 = belief[node.parent][1] / max(to_parent[i][1], 1e-12)
                kind = kinds[node.parent]
                no *= p0 * pair[kind, 0, 0] + p1 * pair[kind, 1, 0]
                yes *= p0 * pair[kind, 0, 1] + p1 * pair[kind, 1, 1]
            belief[i] = (no / (no + yes), yes / (no + yes))
            found[i] = belief[i][1]
        return found


# Words by which authors name what is no main text, and what is; fixed values for the labelled outlines.
ASIDE_NAMES = (
    "nav navbar navigation menu topbar breadcrumb breadcrumbs header masthead banner footer bottom copyright sidebar "
    "side rail widget related recommended popular trending ad ads adsense advert advertisement sponsor sponsored promo "
    "cookie cookies consent notice alert gdpr popup modal overlay newsletter subscribe signup login search form share "
    "social follow tags pagination pager comment comments disqus replies reply respond discussion reader skip hidden"
).split()
MAIN_NAMES = "article content main post entry story body text page prose markdown".split()
LONG = "Some words of a longer sentence that tells what happened, and to whom, and why it did. " * 3
SHORT = "A few words here"


def labelled_outlines() -> Iterable[str]:
    """Pages with the label of each part in ``data-main``; what it doesn't name has its parent's."""
    link = '<a href="/x">Some link</a>'
    menu = f"<ul><li>{link}</li><li>{link}</li><li>{link}</li></ul>"
    text = (f"<h1>{SHORT}</h1><p>{LONG}</p><ul><li>{SHORT}</li></ul><div><ol><li>{SHORT}</li><li>{SHORT}</li></ol></div><p>{LONG}</p><p>{LONG} {link} {SHORT}</p><h2>{SHORT}</h2><ul><li>{SHORT}</li><li>{LONG}</li></ul>"
            f"<blockquote><p>{LONG}</p></blockquote><pre>{SHORT}</pre><p>{SHORT}</p><table><tr><td>{SHORT}</td></tr></table>")
    mains = ["<article data-main=1>{}</article>", "<main data-main=1>{}</main>", "<main data-main=1><article>{}</article></main>"]
    mains += [f'<div data-main=1 class="{n}">{{}}</div>' for n in MAIN_NAMES]
    mains += [f'<section data-main=1 id="{n}">{{}}</section>' for n in MAIN_NAMES]
    mains += ["<article data-main=1><header>{}</header></article>", "<div data-main=1><div>{}</div></div>"]
    plain = ['<section data-main=0 class="comments"><article class="comment">{}</article></section>',
             '<div data-main=0 id="comments"><article>{}</article><article>{}</article></div>'.replace("{}</article><", "</article><", 1),
             "<nav data-main=0>{}</nav>", "<aside data-main=0>{}</aside>", "<footer data-main=0>{}</footer>",
             "<header data-main=0>{}</header>", "<form data-main=0>{}<label>Some field</label><button>Send</button></form>"]
    plain += [f'<div data-main=0 class="{n}">{{}}</div>' for n in ASIDE_NAMES]
    plain += [f'<section data-main=0 id="{n}">{{}}</section>' for n in ASIDE_NAMES]
    inner = [menu, f"<h1>{SHORT}</h1>", f"<h2>{SHORT}</h2><p>{SHORT}</p>", f"<p>{SHORT}</p>", f"<p>{LONG}</p>", SHORT, LONG, f"<h3>{SHORT}</h3><div><p>{LONG}</p></div>"]
    head = f"<header data-main=0><h1>{SHORT}</h1><p>{SHORT}</p></header>"
    for i, main in enumerate(mains * 10):
        around = [plain[(7 * i + 5 * k) % len(plain)].format(inner[(i + i // 7 + k) % len(inner)]) for k in range(8)]
        inside = plain[(5 * i + 1) % len(plain)].format(inner[i % len(inner)])
        yield (f"<html data-main=0><body>{head if i % 3 else ''}<nav data-main=0>{menu}</nav>{''.join(around[:4])}"
               f"{main.format(text + inside)}{''.join(around[4:])}<footer data-main=0>{SHORT} {LONG}</footer></body></html>")


def labels_of(nodes: list[Node], own_markup: bool) -> list[int]:
    """Labels by ``data-main``, or by what the mark-up itself names; containers have what they hold."""
    labels = [0] * len(nodes)
    for i, node in enumerate(nodes):
        above = labels[node.parent] if i else 0
        if own_markup:
            named = 1 if node.tag in ("article", "main") else None
            if node.tag in ("nav", "aside", "footer", "form") or node.tag == "header" and not above or set(node.names) & set(ASIDE_NAMES):
                named = 0
        else:
            named = None if node.main is None else int(node.main)
        labels[i] = above if named is None else named
    for i in range(len(nodes) - 1, 0, -1):
        if labels[i] and not labels[nodes[i].parent]:
            labels[nodes[i].parent] = 1
    return labels


def observed(page: str, own_markup: bool) -> list[tuple[str, int, int, int]]:
    """For each labelled node: its parent's kind and its features, how neighbours' labels add up, its label."""
    nodes, _ = parse(page)
    labels = labels_of(nodes, own_markup)
    if own_markup and not any(n.tag in ("article", "main") for n in nodes):
        return []
    below = [0] * len(nodes)
    for node, label in zip(nodes[1:], labels[1:]):
        below[node.parent] += 2 * label - 1
    out = []
    for i, node in enumerate(nodes[1:], 1):
        parent = nodes[node.parent]
        key = "\n".join([kind_of_tag(parent.tag), *features(node, parent)])
        out.append((key, 2 * labels[node.parent] - 1, max(-3, min(3, below[i])), labels[i]))
    return out


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES) -> Potentials:
    """Potentials from the labelled outlines and from pages whose mark-up names the article."""
    known = pages.select("page_id", F.col("html").cast("string").alias("html")).dropna()
    sample = known.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(fit_pages).distinct()
    chosen = known.join(F.broadcast(sample), "page_id", "left_semi")

    def work(columns: list[list]) -> list[list]:
        seen: Counter = Counter()
        for page in columns[0]:
            seen.update(observed(page, own_markup=True))
        return [list(c) for c in zip(*((*k, n) for k, n in seen.items()))] if seen else [[] for _ in range(5)]

    keys = ["features", "above", "below", "label"]
    counted = map_slices(chosen.select("html"), work, "features string, above int, below int, label int, n bigint")
    counts: Counter = Counter()
    for r in counted.groupBy(*keys).agg(F.sum("n").alias("n")).collect():
        counts[tuple(r[k] for k in keys)] += r["n"]
    seen: Counter = Counter()
    for page in labelled_outlines():
        seen.update(observed(page, own_markup=False))
    # Both kinds of labelled pages weigh the same.
    share = sum(seen.values()) / max(1, sum(counts.values()))
    for key, n in counts.items():
        seen[key] += n * share
    return Potentials.counted(seen)


def main_text(page: str | None, potentials: Potentials) -> str:
    """Main text of a page, a line for each block."""
    if not page:
        return ""
    nodes, runs = parse(page)
    chances = potentials.marginals(nodes)
    lines = (SPACE.sub(" ", "".join(parts)).strip() for block, parts in runs if parts and chances[block] >= 0.5)
    return "\n".join(line for line in lines if line)


def with_main_text(pages: DataFrame, potentials: Potentials, html_column: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of each page."""
    shared = pages.sparkSession.sparkContext.broadcast((potentials.weight, potentials.agree))

    def work(columns: list[list]) -> list[list]:
        known = Potentials(*shared.value)
        return [[main_text(p, known) for p in columns[0]]]

    return append_columns(pages, [html_column], work, f"{out} string")
