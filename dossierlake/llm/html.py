"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

A page is parsed into block nodes; each text run belongs to its innermost block. Every node gets features:
tag kind, tokens of class, id and role (its own and its ancestors'), depth, text and link density of the
subtree, and its place and share among its siblings. Gradient-boosted trees give each node the log odds of
being main text. A bottom-up pass over the tree then picks the labels of largest total: a node may be kept
only if its parent is, so no choice contradicts that of an ancestor, and a dropped subtree is dropped whole.

The trees are fitted with Spark ML on `SAMPLE_PAGES` pages of smallest hash of page_id that have an article
element; each is also rebuilt in `VARIANTS` other layouts (other containers, sidebars, notices, forms,
comments) from its own texts, where the label of every node is known.

Defined cases: a null or blank page has the empty text and 0 characters; unclosed and stray tags are
repaired as browsers do; a page is parsed alone, so its size bounds the memory; with no page to learn
from, every page's text is that of its article or main element, or of its body.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
import html as entities
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from dossierlake.llm.common import checkpoint

SAMPLE_PAGES, VARIANTS = 150, 6
TREES, DEPTH = 16, 5
PAGES_AT_ONCE = 100
CUT = 2.0

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*>|[^<]+|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTES = re.compile(r"""(class|id|role|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")

# The element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object textarea title head xmp".split())
BLOCKS = frozenset("""
html body address article aside blockquote button canvas caption center dd details dialog div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul
""".split())
CLOSES_P = BLOCKS - {"button", "caption", "option", "legend", "html", "body", "tbody", "td", "tfoot", "th", "thead", "tr"}
CLOSES_ITSELF = {"li": "li", "dd": "dt dd", "dt": "dt dd", "option": "option", "tr": "tr td th", "td": "td th", "th": "td th",
                 "tbody": "tbody thead tr td th", "thead": "tbody thead tr td th", "tfoot": "tbody thead tr td th"}
SCOPE = frozenset("table td th ul ol dl div article section main aside form html body select".split())

TAG_KINDS = {tag: i for i, tags in enumerate((
    "article main", "section div center", "p pre blockquote", "h1 h2 h3 h4 h5 h6 hgroup", "ul ol dl menu", "li dd dt", "nav", "header",
    "footer address", "aside", "form fieldset button select option legend", "table tbody thead tfoot tr td th caption",
    "figure figcaption details summary", "body html dialog canvas")) for tag in tags.split()}
TOKEN_KINDS = {token: i for i, tokens in enumerate((
    "article content main post entry story body text page hentry blog",
    "nav navigation menu navbar breadcrumb breadcrumbs pagination pager toc skip links topbar tabs",
    "ad ads advert adverts advertisement banner promo promotion sponsor sponsored sponsors teaser outbrain taboola",
    "comment comments disqus reply replies respond discussion feedback reviews",
    "sidebar side aside widget rail related recommended popular trending more",
    "footer foot copyright legal colophon header head masthead top logo branding bottom",
    "cookie cookies consent gdpr notice alert popup modal overlay warning message banner-notice announcement dialog",
    "form search login signup subscribe newsletter subscription register contact share social follow buttons toolbar",
)) for token in tokens.split()}
N_TAGS, N_TOKENS = max(TAG_KINDS.values()) + 1, max(TOKEN_KINDS.values()) + 1
FEATURES = 2 * N_TAGS + 2 * N_TOKENS + 14


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    kinds: tuple[int, ...] = ()
    label: str = ""
    children: list[int] = field(default_factory=list)
    runs: list[int] = field(default_factory=list)
    tags: int = 1


@dataclass
class Page:
    nodes: list[Node]
    runs: list[tuple[int, str, int]]  # node, text, characters in links


def kinds_of(attributes: str) -> tuple[tuple[int, ...], str]:
    kinds, label = set(), ""
    for match in ATTRIBUTES.finditer(attributes):
        value = match[2] or match[3] or match[4] or ""
        if match[1].lower() == "data-main":
            label = value
        else:
            kinds.update(TOKEN_KINDS[p.lower()] for p in PARTS.findall(value) if p.lower() in TOKEN_KINDS)
    return tuple(kinds), label


def parsed(source: str) -> Page:
    """Block nodes in document order and the text runs between their tags."""
    nodes = [Node("html", -1, 0)]
    stack: list[tuple[str, int]] = [("html", 0)]  # every open element and the block it lies in
    runs: list[tuple[int, str, int]] = []
    text: list[str] = []
    links, linked = 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                nodes[stack[-1][1]].runs.append(len(runs))
                runs.append((stack[-1][1], joined, min(linked, len(joined))))
            text.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal links
        if any(tag in BLOCKS for tag, _ in stack[upto:]):
            flush()
        links -= sum(tag == "a" for tag, _ in stack[upto:])
        del stack[upto:]

    def close_open(tags: str, scope: frozenset[str] = SCOPE) -> None:
        wanted = tags.split()
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in wanted:
                close(i)
                return
            if stack[i][0] in scope:
                return

    at, size = 0, len(source)
    while at < size:
        match = TOKEN.match(source, at)
        piece, at = match.group(), match.end()
        if piece[0] != "<" or len(piece) == 1:
            text.append(piece)
            if links:
                linked += len(piece)
            continue
        if piece[1] in "!?":
            continue
        tag = NAME.match(piece)[1].lower()
        if piece[1] == "/":
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag not in BLOCKS and stack[i][0] in BLOCKS:
                    break
            continue
        if tag in RAW:
            if not piece.endswith("/>"):
                end = re.compile(rf"</{re.escape(tag)}\s*>|<body\b" if tag == "head" else rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                at = size if end is None else end.start() if end.group()[1] != "/" else end.end()
            continue
        if tag in VOID:
            text.append(" ")
            continue
        if tag in ("html", "body") and len(nodes) > 1 and (tag == "html" or any(t == "body" for t, _ in stack)):
            continue
        if tag in BLOCKS:
            if tag in CLOSES_P:
                close_open("p", SCOPE | {"li"})
            if tag in CLOSES_ITSELF:
                close_open(CLOSES_ITSELF[tag], frozenset(("table", "ul", "ol", "dl", "select")))
            flush()
            parent = stack[-1][1]
            kinds, label = kinds_of(piece)
            nodes[parent].children.append(len(nodes))
            nodes.append(Node(tag, parent, nodes[parent].depth + 1, kinds, label))
            stack.append((tag, len(nodes) - 1))
        else:
            nodes[stack[-1][1]].tags += 1
            links += tag == "a"
            stack.append((tag, stack[-1][1]))
    flush()
    return Page(nodes, runs)


def features(page: Page) -> np.ndarray:
    """One row of FEATURES numbers for each node; subtree sums come bottom-up, ancestors' kinds top-down."""
    nodes, n = page.nodes, len(page.nodes)
    own, links, stops = [0] * n, [0] * n, [0] * n
    for node, text, linked in page.runs:
        own[node] += len(text)
        links[node] += linked
        stops[node] += text.count(".") + text.count(",")
    chars, tags, leaves = own[:], [x.tags for x in nodes], [len(x.runs) for x in nodes]
    for i in range(n - 1, 0, -1):
        up = nodes[i].parent
        chars[up] += chars[i]
        tags[up] += tags[i]
        links[up] += links[i]
        stops[up] += stops[i]
        leaves[up] += leaves[i]
    out = np.zeros((n, FEATURES))
    above = 2 * N_TAGS + N_TOKENS
    total = max(1, chars[0])
    for i, node in enumerate(nodes):
        row = out[i]
        tag = TAG_KINDS[node.tag]
        row[tag] = 1
        for kind in node.kinds:
            row[2 * N_TAGS + kind] = 1
        if i:
            up = node.parent
            parent = out[up]
            row[N_TAGS : 2 * N_TAGS] = np.maximum(parent[N_TAGS : 2 * N_TAGS], parent[:N_TAGS])
            row[above : above + N_TOKENS] = np.maximum(parent[above : above + N_TOKENS], parent[2 * N_TAGS : above])
            siblings = nodes[up].children
            rest = max(1, len(siblings) - 1)
            place = parent[-1]
            parent[-1] += 1
            among = chars[i] / max(1, chars[up])
        else:
            siblings, rest, place, among = [0], 1, 0, 1
        c = chars[i]
        row[-14:-1] = (
            node.depth, math.log1p(c), math.log1p(own[i]), links[i] / max(1, c), c / tags[i], math.log1p(len(node.children)),
            place / rest, math.log1p(len(siblings)), among, c / total, stops[i] / max(1, c), c / max(1, leaves[i]), leaves[i])
    out[:, -1] = [len(x.children) for x in nodes]
    return out


@dataclass
class Forest:
    """Boosted regression trees as arrays; the log odds are twice the weighted sum."""

    weights: list[float]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        index = np.arange(len(rows))
        for weight, (feature, limit, left, right, value) in zip(self.weights, self.trees, strict=True):
            at = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                at = np.where(rows[index, feature[at]] <= limit[at], left[at], right[at])
            total += weight * value[at]
        return 2 * total


def flattened(tree) -> tuple[np.ndarray, ...]:
    """A fitted Spark ML tree as arrays; a leaf leads to itself."""
    feature, limit, left, right, value = [], [], [], [], []

    def add(node) -> int:
        at = len(feature)
        for column in (feature, limit, left, right, value):
            column.append(0)
        value[at], left[at], right[at] = node.prediction(), at, at
        if node.subtreeDepth() > 0:
            feature[at], limit[at] = node.split().featureIndex(), node.split().threshold()
            left[at], right[at] = add(node.leftChild()), add(node.rightChild())
        return at

    add(tree._call_java("rootNode"))
    return np.array(feature), np.array(limit, float), np.array(left), np.array(right), np.array(value, float)


def kept(page: Page, odds: np.ndarray) -> list[bool]:
    """The labels of largest total in which only children of kept nodes are kept.

    A node weighs by its own text; containers without text weigh little. To cut a subtree off a kept parent
    costs `CUT`, so weak evidence against a short block does not take it out of its section.
    """
    n = len(page.nodes)
    own = np.zeros(n)
    for node, text, _ in page.runs:
        own[node] += len(text)
    gain = (np.clip(odds, -4, 4) * (0.2 + np.log1p(own))).tolist()
    best = gain[:]
    for i in range(n - 1, 0, -1):
        best[page.nodes[i].parent] += max(best[i], -CUT)
    keep = [False] * n
    keep[0] = best[0] > -CUT
    for i in range(1, n):
        keep[i] = keep[page.nodes[i].parent] and best[i] > -CUT
    return keep


def text_of(page: Page, keep: list[bool]) -> str:
    return "\n".join(text for node, text, _ in page.runs if keep[node])


def plain_choice(page: Page) -> list[bool]:
    """Without a model: the article or main elements, or the whole page."""
    found = any(x.tag in ("article", "main") for x in page.nodes)
    keep = [not found] * len(page.nodes)
    for i, node in enumerate(page.nodes[1:], 1):
        keep[i] = keep[node.parent] or node.tag in ("article", "main")
    return keep


def weak_labels(page: Page) -> list[int]:
    """Labels of a page that marks its article: inside it 1, inside other sections 0, containers above it 1."""
    labels = [-1] * len(page.nodes)
    for i, node in enumerate(page.nodes):
        up = labels[node.parent] if i else -1
        bad = node.tag in ("nav", "footer", "aside", "form", "header") or any(0 < k for k in node.kinds)
        labels[i] = 0 if up == 0 or bad else 1 if up == 1 or node.tag in ("article", "main") else -1
    for i in range(len(page.nodes) - 1, 0, -1):
        up = page.nodes[i].parent
        if labels[i] == 1 and labels[up] == -1:
            labels[up] = 1
    return [max(x, 0) for x in labels]


def marked_labels(page: Page) -> list[int]:
    """Labels of a rebuilt page, from the nearest marked ancestor."""
    labels = []
    for i, node in enumerate(page.nodes):
        labels.append(int(node.label) if node.label else labels[node.parent] if i else 1)
    return labels


def rebuilt(page: Page, labels: list[int], seed: int) -> str:
    """The page's texts in another layout, every section marked with its label."""
    rng = random.Random(seed)
    pick, esc = rng.choice, entities.escape
    main = [t for n, t, _ in page.runs if labels[n]] or ["Text."]
    rest = [t for n, t, _ in page.runs if not labels[n]] or ["Text"]
    if rng.random() < 0.3:
        main = main[: rng.randint(1, 3)]
    short = lambda: esc(" ".join(pick(rest).split()[: rng.randint(1, 4)]))
    long = lambda: esc(pick(main))
    menu = lambda: "<ul>" + "".join(f'<li><a href="#">{short()}</a></li>' for _ in range(rng.randint(2, 9))) + "</ul>"

    def off(choices: str, inner: str) -> str:
        tag, _, names = pick(choices.split("|")).partition(".")
        attribute = f' {pick(("class", "class", "id"))}="{names}"' if names else ""
        return f'<{tag}{attribute} data-main="0">{inner}</{tag}>'

    def brief(text: str, share: float) -> str:
        return " ".join(text.split()[: rng.randint(1, 4)]) if rng.random() < share else text

    def paragraphs(texts: list[str]) -> str:
        out = []
        for t in (brief(t, 0.15) for t in texts):
            tag = pick(("p", "p", "p", "p", "p", "blockquote", "h2", "li", "div", "pre", "td"))
            body = f"<p>{esc(t)}</p>" if tag == "blockquote" else esc(t)
            cells = "".join(f"<td>{esc(brief(t, 0.8))}</td>" for _ in range(rng.randint(1, 4)))
            out.append({"li": f"<ul><li>{body}</li></ul>", "td": f"<table><tr>{cells}</tr></table>"}.get(tag, f"<{tag}>{body}</{tag}>"))
        return "".join(out)

    extras = [
        lambda: off("div.ad|div.advert|aside.ads|div.banner|div.promo|div.sponsored|section.advertisement", pick((short, long))()),
        lambda: off("aside|aside|aside.note|div.sidebar", f"<p>{pick((short, long))()}</p>"),
        lambda: off("aside|aside.sidebar|div.sidebar|div.widget|section.related|div.side-rail", f"<h3>{short()}</h3>{menu()}<p>{long()}</p>"),
        lambda: off("div.cookie-notice|div.notice|div.consent|section.alert|div.popup|div.cookie-banner", f"<p>{pick((short, long))()}</p><button>{short()}</button>"),
        lambda: off("form|form.search|div.newsletter|form.subscribe|div.login|div.share|div.social", f"<label>{short()}</label><input><p>{short()}</p><button>{short()}</button>"),
    ]
    comments = off("section.comments|div.comments|div#comments|ol.comment-list|div.disqus|div.discussion".replace("#", "."),
                   "".join(f'<div class="{pick(("comment", "reply", "comment-body"))}"><p>{short()}</p><p>{long()}</p></div>' for _ in range(rng.randint(1, 5))))
    tag, _, names = pick(("article", "article", "main", "div.content", "div.post", "div.entry-content", "section.article-body",
                          "div.story", "div.main-content", "article.post", "div", "")).partition(".")
    inside = [paragraphs(main)] + [f() for f in rng.sample(extras, rng.choice((0, 0, 0, 1)))]
    if rng.random() < 0.2:
        inside.append(off("footer|div.tags|div.share|ul.links", short()))
    title = f"<h1>{esc(brief(main[0], 0.5))}</h1>" if tag or rng.random() < 0.5 else ""
    article = f'<{tag}{f" class={chr(34)}{names}{chr(34)}" if names else ""} data-main="1">{title}{"".join(inside)}{comments if rng.random() < 0.2 else ""}</{tag}>'
    if not tag:
        article = title + "".join(inside)
    head = [off("header|div.header|div.masthead|header.top", f"<p>{short()}</p>{menu() if rng.random() < 0.5 else ''}"), off("nav|div.menu|div.navbar|div.breadcrumbs|ul.nav", menu())]
    after = [f() for f in rng.sample(extras, rng.randint(1, 3))] + ([comments] if rng.random() < 0.6 else [])
    before = [f() for f in rng.sample(extras, rng.choice((0, 1)))]
    foot = off("footer|div.footer|footer.site-footer|div.copyright", f"<p>{pick((short, long))()}</p>{menu() if rng.random() < 0.4 else ''}")
    body = "".join([*head, *before, article, *after, foot]) if tag or rng.random() < 0.5 else article
    if rng.random() < 0.5:
        body = f'<div class="{pick(("wrapper", "container", "page", "site", "layout"))}" data-main="1">{body}</div>'
    return f"<html><body>{body}</body></html>"


def fit(pages: DataFrame) -> Forest | None:
    """Boosted trees from the sampled pages and their rebuilt layouts; None if no page has an article."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    marked = pages.where(F.lower("html").contains("<article"))
    chosen = marked.select("page_id", F.xxhash64("page_id").alias("h")).orderBy("h", "page_id").limit(SAMPLE_PAGES).select("page_id")
    # bounded: SAMPLE_PAGES ids
    sample = marked.join(F.broadcast(chosen), "page_id", "left_semi").select("page_id", "html")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, labels = [], []
            for page_id, source in zip(batch["page_id"], batch["html"], strict=True):
                page = parsed(source)
                known = weak_labels(page)
                seed = zlib.crc32(f"{page_id}|{source}".encode("utf-8", "surrogatepass"))
                for part, own in [(page, known)] + [(p, marked_labels(p)) for p in (
                        parsed(rebuilt(page, known, seed + v)) for v in range(VARIANTS))]:
                    found.append(features(part))
                    labels += own
            if found:
                yield pd.DataFrame({"row": list(np.concatenate(found)), "label": np.array(labels, float)})

    training = checkpoint(sample.mapInPandas(rows, "row array<double>, label double").select(array_to_vector("row").alias("features"), "label"))
    if training.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=5).fit(training)
    return Forest(list(model.treeWeights), [flattened(t) for t in model.trees])


def main_text(sources: list[str | None], forest: Forest | None) -> list[str]:
    pages = [parsed(s or "") for s in sources]
    if forest is None:
        return [text_of(p, plain_choice(p)) for p in pages]
    rows = [features(p) for p in pages]
    odds = np.split(forest.log_odds(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
    return [text_of(p, kept(p, o)) for p, o in zip(pages, odds, strict=True)]


def extracted(pages: DataFrame, forest: Forest | None) -> DataFrame:
    """`pages` with text and n_chars; one pass, no shuffle. The model's size is fixed by TREES and DEPTH."""
    shared = pages.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("string")
    def main(sources: pd.Series) -> pd.Series:
        values = sources.tolist()
        out = []
        for i in range(0, len(values), PAGES_AT_ONCE):
            out += main_text(values[i : i + PAGES_AT_ONCE], shared.value)
        return pd.Series(out, dtype=object)

    return pages.withColumn("text", main("html")).withColumn("n_chars", F.length("text").cast("bigint"))
