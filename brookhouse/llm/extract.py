"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks (llm.blocks). Every block becomes a vector of its tag path, of its hashed
words and of a few plain measures, and a bidirectional LSTM (llm.labeller) that has read all blocks of the page
before and after it says whether the block belongs to the article.

The labeller learns from pages of the corpus that mark their article themselves (an `article` or
`main` element): blocks in it are text, except those in elements named below; all others are not. Such pages
are also learned in disguise: elements are renamed and given the class names of common templates, and blocks
of sidebars, notices, forms and comments are put in, so that the network does not hang on one tag name.
Training takes `sample` pages in the order of a hash of their content (a documented bound).

Defined results: null and empty pages give an empty text; a page without an article gives an empty text or
what the network takes for one; references are decoded, unfinished ones stay as they are; white space within a
block becomes one space; unclosed elements end with the page; equal pages give equal texts; other columns come
back untouched, one named `main_text` is replaced; with no page to learn from, all blocks outside the
elements of ASIDE are text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import Block, blocks
from .labeller import Labeller, features

# Fixed names: elements and class words that hold the article, and those that never do.
ARTICLE = frozenset("article main".split())
ASIDE = frozenset(
    "head title nav footer aside header form button select dialog menu ad ads advert advertisement banner sponsored promo sidebar "
    "navbar navigation breadcrumb breadcrumbs cookie consent notice alert popup modal newsletter subscribe comment comments "
    "respond replies disqus related recommended share social footnav copyright login search widget toolbar pagination".split())
# Fixed disguises of the elements of a page.
DISGUISE = {
    "article": ("article", "main", "article", "div content", "div post", "div entry content", "div article body", "section story", "div main content", "div"),
    "nav": ("nav", "nav", "div menu", "div nav", "header nav", "div navbar", "div navigation", "ul menu"),
    "footer": ("footer", "footer", "div footer", "div bottom", "div copyright", "div site footer"),
    "ad": ("div ad", "div ad", "div ads", "div advert", "aside sponsored", "div banner", "div promo", "section advertisement"),
}
INSERTS = (
    "aside", "div sidebar", "aside widget", "div notice", "div cookie consent", "section comments", "div comment", "div comments list",
    "form", "form search", "div newsletter subscribe", "div related", "div share social", "header", "div header", "div popup modal", "div alert",
    "ul breadcrumb", "div login",
)


def weak_labels(page: list[Block]) -> np.ndarray | None:
    """1 for blocks of the marked article, or None if nothing is marked."""
    out = np.zeros(len(page), np.float32)
    for i, block in enumerate(page):
        steps = [set(step.split()) for step in block.path]
        inside = any(step & ARTICLE for step in steps)
        out[i] = inside and not any(step & ASIDE for step in steps)
    return out if out.any() else None


def disguised(page: list[Block], labels: np.ndarray, extra: list[str], rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    names = {k: v[rng.integers(len(v))] for k, v in DISGUISE.items()}

    def renamed(step: str) -> str:
        if "ad" in step.split():
            return names["ad"]
        return names.get(step, step)

    out, marks = [], []
    n_insert = rng.integers(0, 5)
    spots = sorted(rng.integers(0, len(page) + 1, n_insert))
    outer = next((tuple(b.path[:2]) for b in page if b.path), ("html", "body"))
    for i in range(len(page) + 1):
        while spots and spots[0] == i:
            spots.pop(0)
            kind = INSERTS[rng.integers(len(INSERTS))]
            # A comment or notice may stand within the article as well.
            within = i and rng.random() < 0.4
            base = tuple(map(renamed, page[i - 1].path[:3])) if within else ("html", "body") if outer[:1] == ("html",) else outer
            for _ in range(rng.integers(1, 4)):
                text = extra[rng.integers(len(extra))]
                text = text if rng.random() < 0.6 else " ".join(text.split()[:rng.integers(1, 6)])
                leaf = (("p",), ("li",), ("div",), ())[rng.integers(4)]
                out.append(Block((*base, kind, *leaf), text, len(text) if rng.random() < 0.3 else 0))
                marks.append(0.0)
        if i < len(page):
            out.append(Block(tuple(map(renamed, page[i].path)), page[i].text, page[i].linked))
            marks.append(labels[i])
    return out, np.array(marks, np.float32)


def train(pages: DataFrame, html: str = "html", sample: int = 400, copies: int = 3, seed: int = 1) -> Labeller | None:
    """A labeller from up to `sample` pages; None if none of them marks its article."""
    hashed = pages.filter(F.length(html) > 0).select(F.xxhash64(html).alias("h"), F.col(html).alias("html"))
    # Only hashes are ordered; a scan then finds the pages, equal ones once.
    first = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(sample).collect()]
    if not first:
        return None
    picked = hashed.filter(F.col("h") <= first[-1]).groupBy("h").agg(F.min("html").alias("html"))
    rows = sorted(picked.collect(), key=lambda r: r["h"])
    known = [(p, w) for row in rows if (p := blocks(row["html"])) and (w := weak_labels(p)) is not None]
    if not known:
        return None
    rng = np.random.default_rng(seed)
    extra = [b.text for p, _ in known for b in p]
    shown = list(known)
    for _ in range(copies):
        shown += [disguised(p, w, extra, rng) for p, w in known]
    network = Labeller()
    network.fit([features(p) for p, _ in shown], [w for _, w in shown])
    return network


def extract(pages: DataFrame, network: Labeller | None, html: str = "html") -> DataFrame:
    """The rows of `pages` with a column `main_text` added."""
    kept = [f for f in pages.schema.fields if f.name != "main_text"]
    shared = pages.sparkSession.sparkContext.broadcast(network)
    own = pages.select(F.struct(*[F.col(f"`{f.name}`") for f in kept]).alias("row"), F.col(html).cast("string").alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in batches:
            cut = [blocks(page) if page else [] for page in batch.column("html").to_pylist()]
            if network is None:
                marks = [np.array([not any(set(s.split()) & ASIDE for s in b.path) for b in p], float) for p in cut]
            else:
                marks = network.label([features(p) for p in cut])
            texts = [" ".join(b.text for b, m in zip(p, mark, strict=True) if m >= 0.5) for p, mark in zip(cut, marks, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "main_text"])

    done = own.mapInArrow(read, f"row {own.schema['row'].dataType.simpleString()}, main_text string")
    return done.select(*[F.col("row")[f.name].alias(f.name) for f in kept], "main_text")
