"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded over the tree.

Every block-level node gets features of its own (tag, attribute tokens, text), of its subtree (text, link and punctuation
density), of its place (depth, siblings) and of its path. Tags and attribute tokens count by how they speak for main text: a log-odds each, learned
from one half of generated pages whose nodes are labelled (a bounded sample, ``train_pages``); unknown ones count nothing. Boosted trees, fitted by Spark ML on
the other half, give each node a log-odds of being main text. Decoding then picks the best labels for
all nodes at once under the rule that along any path from the root come containers, then main text, then what is left
out; so nothing inside a dropped node is kept, and main text has no container inside.

Defined cases: null and empty pages, and pages without main text, give an empty text. Unclosed and crossing tags are
repaired as browsers do for paragraphs, list items and table cells; a stray end tag is ignored. Text in elements of HIDDEN (buttons, drawings, ``noscript`` and ``textarea`` too),
however deep, goes whatever the trees say. Very long pages are read whole. Null ids and URLs are kept, and
repeated rows are treated alike. An empty table gives an empty result. Other columns are kept, but html is not; clashing result columns are replaced.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of HTML: elements that make a block, that never have content, whose content is not markup, and that are never shown.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td template tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
HIDDEN = frozenset("head script style title template noscript iframe svg math object select textarea button dialog".split())
#: What an open element is closed by, and what keeps it from being looked for further up.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
KEEPS_P = frozenset("td th table caption button html body article".split())

#: Features by token: of a node's tag and of its attributes' words, the least and the greatest weight at the node and on its path.
TOKEN_FEATURES = [f"{where}{what}_{end}" for where in ("", "path_") for what in ("tag", "word") for end in ("least", "most")]
FEATURES = [*TOKEN_FEATURES, "log_chars", "link_density", "chars_per_tag", "punctuation", "depth", "place", "siblings", "share_of_parent", "share_of_page", "paragraphs", "chars_per_block", "is_p", "is_heading", "is_list", "is_box", "controls", "sibling_links"]

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+>", re.S)
_VALUE = r"\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)"
#: One attribute at a time, so that a name is never found inside another name or a quoted value.
_ATTRIBUTE = re.compile(rf"(?:(class|id|role|style|aria-hidden)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))|(hidden)(?![^\s=/>])(?:{_VALUE})?|[^\s\"'=/>]+(?:{_VALUE})?", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_MARKS = re.compile(r"[.,;:!?]")


class Page:
    """Block nodes in page order, and the text blocks with the node each belongs to."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.words = ["#root"], [-1], [frozenset()]
        self.hidden, self.tags, self.controls, self.links = [False], [0], [0], [0]
        self.texts: list[tuple[int, str]] = []
        self._run: list[str] = []
        self._stack: list[tuple[str, int]] = [("#root", 0)]  # open elements with their nearest block node
        self._link = self._hide = 0  # open links, and open elements whose text is never shown
        at, end = 0, len(html)
        while at < end:
            found = _TAG.search(html, at)
            if found is None:
                self._text(html[at:])
                break
            if found.start() > at:
                self._text(html[at : found.start()])
            at = found.end()
            name = found[2] or found[5]
            if name is None:
                continue
            name = name.lower()
            if found[1] or found[4]:
                self._close(name)
                continue
            self._open(name, found[3] or found[6] or "")
            if name in RAW:
                stop = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
                at = stop.start() if stop else end
                if name not in HIDDEN and stop:
                    self._text(html[found.end() : at])
        self._flush()

    def _flush(self) -> None:
        if self._run:
            text = _SPACE.sub(" ", "".join(self._run)).strip()
            self._run = []
            if text:
                node = self._stack[-1][1]
                if node == 0:  # loose text belongs to an implied body, as the root is never main text
                    for held, value in ((self.tag, "body"), (self.parent, 0), (self.words, frozenset()), (self.hidden, False), (self.tags, 1), (self.controls, 0), (self.links, self.links[0])):
                        held.append(value)
                    node, self.links[0] = len(self.tag) - 1, 0
                self.texts.append((node, text))

    def _text(self, raw: str) -> None:
        node = self._stack[-1][1]
        if not self.hidden[node] and not self._hide:
            text = entities.unescape(raw) if "&" in raw else raw
            self._run.append(text)
            if self._link:
                self.links[node] += len(text)

    def _open(self, name: str, attributes: str) -> None:
        if name == "br":
            self._run.append(" ")
        if name in CLOSED_BY:
            self._close_one_of(CLOSED_BY[name], SCOPE[name])
        if name in BLOCK:
            self._flush()
            self._close_one_of({"p"}, KEEPS_P)
        node = self._stack[-1][1]
        self.tags[node] += 1
        if name in ("input", "button", "select", "textarea"):
            self.controls[node] += 1
        if name in VOID:
            return
        if name in BLOCK:
            words: set[str] = set()
            hidden = self.hidden[node] or name in HIDDEN
            for key, value, flag in _ATTRIBUTE.findall(attributes) if attributes else ():
                if flag:
                    hidden = True
                elif not key:
                    continue
                elif key.lower() == "style":
                    hidden = hidden or re.search(r"display\s*:\s*none", value, re.I) is not None
                elif key.lower() == "aria-hidden":
                    hidden = hidden or "true" in value.lower()
                else:
                    words.update(t.lower() for t in _TOKEN.findall(value))
            for held, value in ((self.tag, name), (self.parent, node), (self.words, words), (self.hidden, hidden), (self.tags, 1), (self.controls, 0), (self.links, 0)):
                held.append(value)
            node = len(self.tag) - 1
        elif name == "a":
            self._link += 1
        self._hide += name in HIDDEN
        self._stack.append((name, node))

    def _pop_to(self, k: int) -> None:
        """Closes open elements from place k up."""
        if any(x in BLOCK for x, _ in self._stack[k:]):
            self._flush()
        self._link -= sum(x == "a" for x, _ in self._stack[k:])
        self._hide -= sum(x in HIDDEN for x, _ in self._stack[k:])
        del self._stack[k:]

    def _close_one_of(self, names: set[str], scope: frozenset | set) -> None:
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] in names:
                self._pop_to(k)
                return
            if self._stack[k][0] in scope:
                return

    def _close(self, name: str) -> None:
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] == name:
                self._pop_to(k)
                return
            if name not in BLOCK and self._stack[k][0] in BLOCK:
                return  # an inline end tag does not reach past its block

    def features(self, weights: dict[str, float]) -> np.ndarray:
        """A row of FEATURES a node. weights: those of tokens_of()."""
        n = len(self.tag)
        parent = np.array(self.parent)
        chars, marks, blocks = np.zeros(n), np.zeros(n), np.zeros(n)
        for node, text in self.texts:
            chars[node] += len(text)
            marks[node] += len(_MARKS.findall(text))
            blocks[node] += 1
        tag = np.array(self.tag)
        own = {"tag": [[weights.get("<" + t, 0.0)] for t in self.tag], "word": [[weights.get(w, 0.0) for w in sorted(ws)] or [0.0] for ws in self.words]}
        tokens = {f"{what}_{end}": np.array([pick(v) for v in values]) for what, values in own.items() for end, pick in (("least", min), ("most", max))}
        paths = {f"path_{k}": v.copy() for k, v in tokens.items()}
        links, tags, controls = np.array(self.links, float), np.array(self.tags, float), np.array(self.controls, float)
        paragraphs, depth, order, siblings = (tag == "p").astype(float), np.zeros(n), np.zeros(n), np.zeros(n)
        for i in range(1, n):
            p = parent[i]
            depth[i] = depth[p] + 1
            order[i] = siblings[p]
            siblings[p] += 1
            for k, v in paths.items():
                v[i] = min(v[i], v[p]) if k.endswith("least") else max(v[i], v[p])
        for i in range(n - 1, 0, -1):
            p = parent[i]
            for v in (chars, marks, blocks, links, tags, controls, paragraphs):
                v[p] += v[i]
        around = siblings[parent]
        density = np.minimum(links, chars) / np.maximum(chars, 1)
        columns = tokens | paths | {
            "log_chars": np.log1p(chars),
            "link_density": density,
            "chars_per_tag": chars / np.maximum(tags, 1),
            "punctuation": marks / np.maximum(chars, 1),
            "depth": depth,
            "place": order / np.maximum(around, 1),
            "siblings": around,
            "share_of_parent": chars / np.maximum(chars[parent], 1),
            "share_of_page": chars / max(chars[0], 1),
            "paragraphs": paragraphs,
            "chars_per_block": chars / np.maximum(blocks, 1),
            "is_p": tag == "p",
            "is_heading": np.isin(tag, ["h1", "h2", "h3", "h4", "h5", "h6"]),
            "is_list": np.isin(tag, ["ul", "ol", "li", "dl", "dt", "dd"]),
            "is_box": np.isin(tag, ["div", "section", "table", "td", "tr"]),
            "controls": controls,
            "sibling_links": np.minimum(links[parent], chars[parent]) / np.maximum(chars[parent], 1),
        }
        return np.column_stack([columns[k].astype(float) for k in FEATURES])

    def tokens_of(self, node: int) -> set[str]:
        return {"<" + self.tag[node], *self.words[node]}

    def decode(self, odds: np.ndarray) -> str:
        """Text of the nodes labelled as main text by the best labels for the whole tree.

        States: 0 container, 1 main text, 2 left out; a child's state is its parent's or a later one. A node counts by how far its odds speak for
        its state, and only if it has text of its own below it.
        """
        n = len(self.tag)
        weighs = np.zeros(n, bool)
        for node, _ in self.texts:
            weighs[node] = True
        best = np.zeros((n, 3))
        best[:, 1] = np.where(weighs, odds, 0.25 * odds)
        best[np.array(self.hidden), 1] = -math.inf
        pick = np.zeros((n, 3), int)
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            for state in (0, 1, 2):
                k = max(range(state, 3), key=lambda s: best[i, s])
                pick[i, state] = k
                best[p, state] += best[i, k]
        label = [0] * n
        for i in range(1, n):
            label[i] = pick[i, label[self.parent[i]]]
        return "\n\n".join(text for node, text in self.texts if label[node] == 1)


def training_page(rng: random.Random) -> str:
    """A generated page with labelled nodes (y="1" main text, y="0" not).

    Layouts, tags and attribute names vary, and any node may bear names that say nothing; texts are of any quality, so that a node's place
    tells more than its words.
    """
    def words(n: int) -> str:
        out = []
        for _ in range(n):
            w = "".join(rng.choices("abcdefghijklmnoprstuvz", k=rng.randint(1, 9)))
            out.append(w + rng.choice(["", "", "", "", ",", ".", "!!", "***"]))
        text = " ".join(out)
        return rng.choice([text, text, text.upper(), text.capitalize() + "."])

    def links(n: int) -> str:
        return "".join(f'<li y="0"><a href="/{k}">{words(rng.randint(1, 3))}</a></li>' for k in range(n))

    def named(*options: str) -> str:
        neutral = rng.choice(["", "", "", " row", " col left", " box", " wide", " " + "".join(rng.choices("bcdfgkmptx", k=3))])
        return rng.choice(["class", "class", "id", "role"]) + f'="{rng.choice(options)}{neutral}"'

    def plain() -> str:
        return rng.choice(["", "", "", ' class="row"', ' class="col left"', ' id="box"', ' data-hidden="false"', ' title="hidden places"', f' class="{"".join(rng.choices("bcdfgkmptx", k=4))}"'])

    junk = [
        lambda: f'<nav y="0"{plain()}><ul y="0">{links(rng.randint(2, 9))}</ul></nav>',
        lambda: f'<div y="0" {named("menu", "nav-bar", "breadcrumbs", "topMenu", "navigation", "pager", "pagination", "toolbar", "skip")}><ul y="0">{links(rng.randint(2, 6))}</ul></div>',
        lambda: f'<ul y="0"{plain()}>{links(rng.randint(3, 9))}</ul>',
        lambda: f'<header y="0"><h1 y="0">{words(3)}</h1><p y="0">{words(6)}</p></header>',
        lambda: f'<div y="0" {named("site-header", "masthead", "banner", "logo")}><p y="0">{words(5)}</p></div>',
        lambda: f'<footer y="0"><p y="0">{words(rng.randint(2, 30))}</p></footer>',
        lambda: f'<footer y="0"{plain()}>{words(rng.randint(2, 30))}</footer>',
        lambda: f'<div y="0" {named("footer", "copyright legal", "imprint", "disclaimer")}>{words(rng.randint(3, 30))}</div>',
        lambda: f'<aside y="0"{plain()}><h3 y="0">{words(2)}</h3><p y="0">{words(rng.randint(4, 60))}</p></aside>',
        lambda: f'<div y="0" {named("sidebar", "widget", "related-posts", "recommended", "trending")}><ul y="0">{links(4)}</ul><p y="0">{words(20)}</p></div>',
        lambda: f'<div y="0" {named("ad", "ads", "advert", "sponsored", "promo banner", "advertisement", "ad-box")}>{words(rng.randint(2, 25))}</div>',
        lambda: f'<div y="0" {named("cookie-notice", "notice", "gdpr consent", "popup", "newsletter-signup", "modal", "subscribe", "paywall", "alert")}><p y="0">{words(rng.randint(5, 40))}</p></div>',
        lambda: f'<form y="0"{plain()}><p y="0">{words(4)}</p><input name="q"><button>{words(1)}</button></form>',
        lambda: f'<div y="0" {named("search", "login", "share", "social-links", "tags")}>{words(4)}</div>',
    ]

    def comments() -> str:
        outer, inner = rng.choice([("div", "div"), ("section", "div"), ("section", "article"), ("ol", "li"), ("ul", "li")])
        said = "".join(f'<{inner} y="0" class="{rng.choice(["comment", "reply", "comment reply"])}"><p y="0">{words(rng.randint(3, 60))}</p></{inner}>' for _ in range(rng.randint(1, 5)))
        return f'<{outer} y="0" {named("comments", "comment-list", "disqus_thread", "reader-comments", "responses", "discussion")}>{said}</{outer}>'

    def body_block() -> str:
        k = rng.random()
        if k < 0.7:
            return f'<p y="1"{plain()}>{words(rng.randint(1, 90))}</p>'
        if k < 0.78:
            return f'<h{(d := rng.randint(2, 4))} y="1">{words(rng.randint(1, 6))}</h{d}>'
        if k < 0.85:
            return '<ul y="1">' + "".join(f'<li y="1">{words(rng.randint(1, 12))}</li>' for _ in range(rng.randint(2, 5))) + "</ul>"
        if k < 0.89:
            return f'<blockquote y="1"><p y="1">{words(rng.randint(5, 40))}</p></blockquote>'
        if k < 0.93:
            return f'<div y="1"{plain()}>{words(rng.randint(3, 60))}</div>'
        if k < 0.96:
            return '<table y="1">' + "".join(f'<tr y="1"><td y="1">{words(2)}</td><td y="1">{words(3)}</td></tr>' for _ in range(rng.randint(2, 4))) + "</table>"
        return f'<p y="1"><a href="/x">{words(3)}</a> {words(rng.randint(5, 40))}</p>'

    blocks = [f'<h1 y="1">{words(rng.randint(2, 9))}</h1>'] * (rng.random() < 0.85) + [body_block() for _ in range(rng.randint(1, 14))]
    for _ in range(rng.choice([0, 0, 1, 2])):
        blocks.insert(rng.randint(1, len(blocks)), rng.choice(junk[9:])())
    if rng.random() < 0.2:
        blocks.append(comments())
    inner = "".join(blocks)
    article = rng.choice([
        lambda: f'<article y="1"{plain()}>{inner}</article>',
        lambda: f'<article y="1" {named("post", "entry", "story")}>{inner}</article>',
        lambda: f'<main y="1"{plain()}>{inner}</main>',
        lambda: f'<main><article y="1">{inner}</article></main>',
        lambda: f'<div y="1" {named("content", "article-body", "post entry", "main-text", "storyBody", "page-content", "prose", "text", "main")}>{inner}</div>',
        lambda: f'<div{plain()}><div y="1"{plain()}>{inner}</div></div>',
        lambda: f'<section y="1"{plain()}>{inner}</section>',
        lambda: f'<div y="1">{inner}</div>',
    ])()
    around = [rng.choice(junk)() for _ in range(rng.randint(1, 6))]
    if rng.random() < 0.3:
        around.append(comments())
    rng.shuffle(around)
    cut = rng.randint(0, len(around))
    if rng.random() < 0.12:  # laid out by a table
        page = f'<table{plain()}><tr><td>{"".join(around[:cut])}</td><td>{article}</td></tr></table>{"".join(around[cut:])}'
    else:
        page = "".join([*around[:cut], article, *around[cut:]])
    if rng.random() < 0.4:
        page = f'<div {named("wrapper", "page", "container")}>{page}</div>'
    return f"<html><head><title>{words(3)}</title></head><body>{page}</body></html>"


class _Labelled(Page):
    """A generated page whose nodes keep their labels."""

    def __init__(self, html: str) -> None:
        self.label = [None]
        super().__init__(html)

    def _open(self, name: str, attributes: str) -> None:
        n = len(self.tag)
        super()._open(name, attributes)
        if len(self.tag) > n:
            found = re.search(r'\by="([01])"', attributes)
            self.label.append(int(found[1]) if found else None)


def token_weights(pages: list[_Labelled]) -> dict[str, float]:
    """The smoothed log-odds that a labelled node with the token is main text, against all labelled nodes."""
    counts: dict[str, list[int]] = {}
    total = [1, 1]
    for page in pages:
        for node, y in enumerate(page.label):
            if y is not None:
                total[y] += 1
                for t in page.tokens_of(node):
                    counts.setdefault(t, [1, 1])[y] += 1
    base = math.log(total[1] / total[0])
    return {t: round(math.log(k[1] / k[0]) - base, 6) for t, k in counts.items()}


class Trees:
    """Boosted trees as arrays: the split feature (-1 at a leaf), threshold, children and value of each node; and the tokens' weights."""

    def __init__(self, model, weights: dict[str, float]) -> None:
        self.trees, self.weights = [], weights
        for weight, tree in zip(model.treeWeights, model.trees, strict=True):
            rows: list[list[float]] = []

            def walk(node) -> int:
                at = len(rows)
                rows.append([-1, 0.0, 0, 0, 0.0])
                if node.subtreeDepth() == 0:
                    rows[at][4] = weight * node.prediction()  # noqa: B023
                else:
                    split = node.split()
                    rows[at] = [split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild()), 0.0]
                return at

            walk(tree._java_obj.rootNode())
            self.trees.append(tuple(np.array(c, dtype) for c, dtype in zip(zip(*rows, strict=True), (int, float, int, int, float), strict=True)))

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the positive class for each row."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), int)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                low = x[rows, np.maximum(f, 0)] <= threshold[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            total += value[at]
        return 2 * total


_fitted: dict[tuple, Trees] = {}


def fit_trees(spark: SparkSession, train_pages: int = 800, trees: int = 16, depth: int = 5, seed: int = 7) -> Trees:
    """Fits on ``train_pages`` generated pages, once an application: tokens' weights on one half, trees on the other."""
    key = (spark.sparkContext.applicationId, train_pages, trees, depth, seed)
    if key not in _fitted:
        rng = random.Random(seed)
        pages = [_Labelled(training_page(rng)) for _ in range(train_pages)]
        weights = token_weights(pages[::2])
        rows = []
        for page in pages[1::2]:
            rows += [(float(y), *map(float, x)) for y, x in zip(page.label, page.features(weights), strict=True) if y is not None]
        table = spark.createDataFrame(pd.DataFrame(rows, columns=["label", *FEATURES])).coalesce(2)
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(table).select("label", "features").persist()
        model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed).fit(vectors)
        vectors.unpersist()
        _fitted[key] = Trees(model, weights)
    return _fitted[key]


def extract_text(pages: DataFrame, html_col: str = "html", trees: Trees | None = None) -> DataFrame:
    """Adds text and n_chars to the pages (html is not carried)."""
    trees = fit_trees(pages.sparkSession) if trees is None else trees
    keep = [c for c in pages.columns if c not in {html_col, "text", "n_chars"}]
    schema = T.StructType([*[pages.schema[c] for c in keep], T.StructField("text", T.StringType())])

    def extract(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            htmls, out = batch["__html"].to_pylist(), []
            for at in range(0, len(htmls), 256):
                some = [Page(h or "") for h in htmls[at : at + 256]]
                odds = trees.odds(np.concatenate([p.features(trees.weights) for p in some]))
                edges = np.cumsum([0, *[len(p.tag) for p in some]])
                out += [p.decode(odds[a:b]) for p, a, b in zip(some, edges[:-1], edges[1:], strict=True)]
            columns = [batch[c] for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.string())], names=[*keep, "text"])

    found = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(html_col).cast("string").alias("__html")).mapInArrow(extract, schema)
    return found.withColumn("n_chars", F.length("text").cast("long"))
