"""HTML extraction: the main text of web pages from flat text blocks, classified by a decision tree.

A page becomes a list of text blocks. Each is described by its words and link density, by those of the block before and after it, and by
where it stands (``FEATURES``). A decision tree, grown by Gini impurity from a small labelled table, keeps the blocks of the
article; they are joined in page order by an empty line. Everything that a kept block says stays.

The labelled table is made by a rule (``labelled_pages``): layouts with and without helpful elements and names, in which each block is marked as part of
the article or not, with blocks of several lengths. ``fit`` takes any such pages; they are small and held by the driver (``most`` blocks at most, beyond it raises).

Each page is a row of its own and is never shuffled. Cases: null html is empty; a page without blocks, or without a kept one, has an empty text of 0 characters; long pages are
read whole in time linear in their length; ties in growing go to the earlier feature and the lower cut, in a leaf to keeping; repeated rows give
repeated rows; empty tables give none; of other columns only those named are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaprism.llm.html_blocks import Block, blocks

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "aside", "outside", "inside", "named", "heading", "item", "stops", "rights")


def features(page: list[Block]) -> np.ndarray:
    own = np.array([(b.words, b.linked / b.words, b.aside, b.outside, b.inside, b.named, b.heading, b.item, b.text[-1] in ".!?…:;\"”»。！？", b.text[0] == "©") for b in page], np.float64).reshape(-1, 10)
    edge = np.zeros((1, 2))
    before, after = np.concatenate([edge, own[:-1, :2]]), np.concatenate([own[1:, :2], edge])
    return np.concatenate([own[:, :2], before[: len(own)], after[-len(own) :] if len(own) else after[:0], own[:, 2:]], axis=1)


@dataclass
class Node:
    """A cut (rows at or below ``cut`` go to ``low``), or a leaf that keeps or drops."""

    keep: bool
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int, least: int) -> Node:
    node = Node(bool(2 * y.sum() >= len(y)))
    if depth == 0 or len(y) < 2 * least or y.all() or not y.any():
        return node
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, kept = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        ok = (v[1:] > v[:-1]) & (n >= least) & (len(y) - n >= least)
        if not ok.any():
            continue
        a, b = kept[:-1], kept[-1] - kept[:-1]
        impurity = a * (n - a) / n + b * (len(y) - n - b) / (len(y) - n)
        i = int(np.argmin(np.where(ok, impurity, np.inf)))
        if best is None or impurity[i] < best[0] - 1e-9:
            best = impurity[i], f, (v[i] + v[i + 1]) / 2
    if best is None:
        return node
    _, node.feature, node.cut = best
    below = x[:, node.feature] <= node.cut
    node.low, node.high = grow(x[below], y[below], depth - 1, least), grow(x[~below], y[~below], depth - 1, least)
    return node


def kept(tree: Node, x: np.ndarray) -> np.ndarray:
    if tree.low is None:
        return np.full(len(x), tree.keep)
    below = x[:, tree.feature] <= tree.cut
    found = np.empty(len(x), bool)
    found[below], found[~below] = kept(tree.low, x[below]), kept(tree.high, x[~below])
    return found


def fit(pages: list[tuple[str, set[str]]], *, depth: int = 10, least: int = 3, most: int = 100_000) -> Node:
    """A tree from pages and the texts of their article's blocks."""
    rows, labels, n = [], [], 0
    for page, article in pages:
        found = blocks(page)
        n += len(found)
        if n > most:
            raise ValueError(f"the labelled table has more than {most} blocks; give a smaller one")
        rows.append(features(found))
        labels += [b.text in article for b in found]
    return grow(np.concatenate(rows) if rows else np.zeros((0, len(FEATURES))), np.array(labels, bool), depth, least)


#: Layouts of the labelled table: before the article, around it, after it. ``*n`` stands for a block of n words of the article, ``-n`` for one of something else, ``=n`` for n linked words of something else.
_BEFORE = (
    "<header><div>-2</div><nav><ul><li><a>=1</a></li><li><a>=2</a></li><li><a>=1</a></li></ul></nav></header>",
    "<nav><ul><li><a>=1</a></li><li><a>=1</a></li></ul></nav><div class='ad'>-9</div>",
    "<div id='header'><h1>-3</h1><p>-8</p></div><div class='menu'><a>=1</a> <a>=1</a> <a>=2</a></div><div class='breadcrumbs'><a>=1</a> &gt; <a>=2</a></div>",
    "<div class='cookie-notice'><p>-25</p><button>-1</button></div><div class='top-nav'><a>=1</a><a>=1</a></div>",
    "<div><a>=1</a> | <a>=1</a> | <a>=2</a> | <a>=1</a></div>",
    "<table><tr><td><a>=1</a></td><td><a>=1</a></td><td><a>=2</a></td></tr></table>",
    "<div role='banner'>-4</div><form><label>-1</label><input></form><div class='alert'>-14</div>",
    "<p><a>=1</a> <a>=1</a></p><p>-2</p>",
    "<nav><a>=2</a><ul><li><a>=2</a></li><li><a>=3</a></li></ul></nav>",
    "<ul><li><a>=1</a></li><li><a>=3</a></li></ul>",
    "",
)
_AROUND = (
    ("<article>", "</article>"),
    ("<main>", "</main>"),
    ("<main><article>", "</article></main>"),
    ("<div class='layout with-sidebar'><article class='post'>", "</article></div>"),
    ("<div class='content'>", "</div>"),
    ("<div id='main'><div class='post-body'>", "</div></div>"),
    ("<div role='main'>", "</div>"),
    ("<div>", "</div>"),
    ("<table><tr><td>", "</td></tr></table>"),
)
_ARTICLE = (
    "<h1>*6</h1><p>*40</p><p>*3</p><p>*60</p><p>*1</p><p>*25</p>",
    "<header><h1>*9</h1></header><p>*1</p><p>*30</p><h2>*3</h2><p>*45</p><ul><li>*4</li><li>*12</li><li>*2</li></ul><p>*80</p><p>*2</p>",
    "<h1>*4</h1><p>*90<p>*5<p>*33<blockquote>*20</blockquote><p>*7",
    "<h2>*5</h2><p>*50</p><table><tr><td>*1</td><td>*2</td></tr><tr><td>*3</td><td>*1</td></tr></table><p>*35</p>",
    "<h1>*8</h1><p>*12</p><p>*15</p><p>*70</p>",
    "<h1>*7</h1><p>*22</p><aside>-15</aside><p>*55</p><div class='ad'>-8</div><p>*18</p><div class='share'><a>=1</a><a>=1</a></div>",
    "<h1>*6</h1><p>*20 <a>*6</a> *9</p><p>*4 <a>*3</a></p><p>*2 <a>*2</a> *1</p><p>*31</p>",
    "<p>*1</p><h3>*2</h3><p>*48</p><p>*5 <a>*4</a></p><p>*3 <a>*1</a></p><p>*16 <a>*14</a></p><p>*11</p>",
    "<p>*65<br>*10</p><p>*2</p><p>*1</p><p>*4</p><div class='notice'>-12</div><p>*9</p>",
    "<p>*42</p><p>*30</p><p>*2</p><p>*57</p>",
    "<p>*12</p><p>*24</p><p>*19</p>",
    "<p>*3</p><p>*36</p><p>*1</p><p>*28</p>",
    "<p>*2</p><p>*33</p><p>*2 <a>*1</a></p>",
    "<h1>*2</h1><p>*38</p><h2>*1</h2><p>*26</p><p>*3</p>",
    "<h1>*1</h1><p>*2</p><p>*52</p><h2>*3</h2><p>*17</p>",
    "<h1>*3</h1><p>*14</p><p>*29</p><p>*1</p><p>*2</p><p>*3</p><p>*21</p>",
    "<h1>*5</h1><p>*44</p><figure><figcaption>*8</figcaption></figure><p>*28</p><ul><li><a>=4</a></li><li><a>=5</a></li><li><a>=3</a></li></ul>",
)
_AFTER = (
    "<footer>-12</footer>",
    "<div class='comments'><h3>-2</h3><div class='comment'><p>-30</p></div><div class='comment'><p>-6</p></div></div><footer><p>-9</p><a>=2</a></footer>",
    "<aside><h3>-2</h3><p>-40</p><ul><li><a>=5</a></li><li><a>=6</a></li></ul></aside><div id='footer'>-10</div>",
    "<div class='related'><h3>-2</h3><a>=6</a><a>=7</a></div><div class='newsletter'><form><p>-14</p></form></div><div class='footer'>-7 <a>=1</a></div>",
    "<div>&copy; -4</div>",
    "<div><a>=1</a> | <a>=1</a> | <a>=1</a></div><p>&copy; -6</p>",
    "<section id='comments'><p>-35</p><p>-8</p></section><div class='sidebar'><p>-50</p></div>",
    "<ul><li><a>=3</a></li><li><a>=4</a></li><li><a>=4</a></li></ul><p>-5 <a>=2</a></p>",
    "",
    "<div class='cookie-banner'>-20</div>",
    "<p>&copy; -3</p>",
    "<div>&copy; -8</div>",
)


def labelled_pages() -> list[tuple[str, set[str]]]:
    """The pages of the labelled table with the texts of their articles' blocks; each layout meets every other kind."""
    pages = []
    for i in range(3 * len(_BEFORE) * len(_AROUND)):
        opening, closing = _AROUND[i % len(_AROUND)]
        page, article = "", set()
        for piece in re.split(r"([*=-]\d+)", _BEFORE[i // len(_AROUND) % len(_BEFORE)] + opening + _ARTICLE[i % len(_ARTICLE)] + closing + _AFTER[(i + i // len(_AFTER)) % len(_AFTER)]):
            if re.fullmatch(r"[*=-]\d+", piece):
                # Of the words only their number, and whether the last one ends in a stop, is ever looked at.
                words = [f"w{i}x{len(page)}x{k}" for k in range(int(piece[1:]))]
                article.update(words if piece[0] == "*" else ())
                piece = " ".join(words) + "." * (len(words) > 5)
            page += piece
        page = "<html><head><title>t</title></head><body>" + page + "</body></html>"
        pages.append((page, {b.text for b in blocks(page) if b.text.split()[0].rstrip(".") in article}))
    return pages


def extract(pages: DataFrame, tree: Node | None = None, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of ``keep``, text and n_chars (code points) of each page."""
    tree = tree or fit(labelled_pages())
    rows = pages.select(*keep, F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("_html"))
    names = [f.name for f in rows.schema[:-1]] + ["text", "n_chars"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]), "text string, n_chars long"])

    def run(batches):
        for b in batches:
            texts = []
            for page in b.column(b.num_columns - 1):
                found = blocks(page.as_py())
                texts.append("\n\n".join(x.text for x, keep in zip(found, kept(tree, features(found)), strict=True) if keep))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names)

    return rows.mapInArrow(run, schema)
