"""Operator 7: main text of pages by a linear-chain conditional random field over leaf blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.llm.common import map_texts, table
from driftspark.llm.html_blocks import Block, blocks
from driftspark.llm.html_labels import PAGES

# Pages of the table that join the labelled ones; their labels are their own semantic tags.
SAMPLE = 200
# Pages of the table with more blocks are not trained on: all are filled up to the longest in the driver's memory.
LONGEST = 400
ANCESTORS = ("nav", "header", "footer", "aside", "form", "button", "article", "main", "section", "table", "figure", "ul", "ol", "dl", "dialog", "menu", "address")
HINTS = ("nav", "ad", "notice", "comment", "side", "foot", "head", "main", "hidden")
NOT_MAIN = frozenset(("nav", "header", "footer", "aside", "form", "button", "dialog", "menu"))
NAMES = (
    "bias", *(f"in {t}" for t in ANCESTORS), *(f"like {h}" for h in HINTS), "heading", "paragraph", "item", "inside main and hinted away",
    "under 4 words", "under 12 words", "under 40 words", "40 words or more", "mostly links", "some links", "ends a sentence",
    "copyright", "first", "last", "no main element above",
)
INDEX = {name: i for i, name in enumerate(NAMES)}
AWAY = frozenset(HINTS) - {"main"}


def above(tags: tuple[str, ...], hints: frozenset[str]) -> list[int]:
    """Indices of the features of what a block stands in; the same for most blocks of a page."""
    found = set(tags)
    names = ["bias", *(f"in {t}" for t in ANCESTORS if t in found), *(f"like {h}" for h in HINTS if h in hints)]
    own = tags[-1] if tags else ""
    if own in ("h1", "h2", "h3", "h4", "h5", "h6"):
        names.append("heading")
    elif "p" in found:
        names.append("paragraph")
    elif "li" in found:
        names.append("item")
    inside = "article" in found or "main" in found or "main" in hints
    if inside and (found & NOT_MAIN or hints & AWAY):
        names.append("inside main and hinted away")
    if not inside:
        names.append("no main element above")
    return [INDEX[n] for n in names]


def rows_of(page: list[Block]) -> list[list[int]]:
    """For each block the indices of the features that hold: what stands above it, its text, its place."""
    known: dict[tuple, list[int]] = {}
    rows, last = [], len(page) - 1
    for place, block in enumerate(page):
        context = (block.tags, block.hints)
        row = known.get(context)
        if row is None:
            row = known[context] = above(*context)
        text = block.text
        words = text.count(" ") + 1
        row = [*row, INDEX["under 4 words" if words < 4 else "under 12 words" if words < 12 else "under 40 words" if words < 40 else "40 words or more"]]
        if block.linked:
            row.append(INDEX["mostly links" if block.linked * 2 > len(text) else "some links"])
        if text[-1] in ".!?:;\"'»”":
            row.append(INDEX["ends a sentence"])
        if "©" in text:
            row.append(INDEX["copyright"])
        if place == 0:
            row.append(INDEX["first"])
        if place == last:
            row.append(INDEX["last"])
        rows.append(row)
    return rows


class Model:
    """Weights of a two-state chain: features by state, transitions, start."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray, start: np.ndarray):
        self.emission, self.transition, self.start = emission, transition, start

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        (t00, t01), (t10, t11) = self.transition.tolist()
        zero, one = self.emission.T.tolist()
        a, b = self.start.tolist()
        back = []
        for i, row in enumerate(rows):
            e0 = sum([zero[f] for f in row])
            e1 = sum([one[f] for f in row])
            if i:
                to0, to1 = b + t10 > a + t00, b + t11 > a + t01
                back.append((to0, to1))
                a, b = (b + t10 if to0 else a + t00), (b + t11 if to1 else a + t01)
            a, b = a + e0, b + e1
        label = int(b > a)
        labels = [label]
        for step in reversed(back):
            label = int(step[label])
            labels.append(label)
        return labels[::-1]


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit(pages: list[tuple[list[list[int]], list[int]]], rounds: int = 150, rate: float = 0.3, ridge: float = 0.02) -> Model:
    """Maximum likelihood of the labels given the blocks, with a ridge penalty, by gradient ascent (AdaGrad).

    Gradients are observed minus expected counts; expectations come from the forward-backward recursion over
    all pages at once, padded to the longest."""
    pages = [p for p in pages if p[0]]
    count, longest, size = len(pages), max(len(p[0]) for p in pages), len(NAMES)
    x = np.zeros((count, longest, size))
    y = np.zeros((count, longest), np.int64)
    mask = np.zeros((count, longest), bool)
    for i, (rows, labels) in enumerate(pages):
        for j, row in enumerate(rows):
            x[i, j, row] = 1.0
        y[i, : len(labels)] = labels
        mask[i, : len(rows)] = True
    hot = np.eye(2)[y] * mask[:, :, None]
    both = mask[:, 1:] & mask[:, :-1]
    seen = (np.einsum("plf,pls->fs", x, hot), np.einsum("pla,plb->ab", hot[:, :-1] * both[:, :, None], hot[:, 1:]), hot[:, 0].sum(axis=0))
    weights = [np.zeros((size, 2)), np.zeros((2, 2)), np.zeros(2)]
    squares = [np.full(w.shape, 1e-8) for w in weights]
    for _ in range(rounds):
        emission, transition, start = weights
        score = x @ emission
        forward = np.zeros((count, longest, 2))
        backward = np.zeros((count, longest, 2))
        forward[:, 0] = start + score[:, 0]
        for j in range(1, longest):
            step = _logsumexp(forward[:, j - 1, :, None] + transition[None], 1) + score[:, j]
            forward[:, j] = np.where(mask[:, j, None], step, forward[:, j - 1])
        for j in range(longest - 2, -1, -1):
            step = _logsumexp(transition[None] + (score[:, j + 1] + backward[:, j + 1])[:, None, :], 2)
            backward[:, j] = np.where(mask[:, j + 1, None], step, 0.0)
        total = _logsumexp(forward[:, -1], 1)
        single = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
        pair = np.exp(
            forward[:, :-1, :, None] + transition[None, None] + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        ) * both[:, :, None, None]
        expected = (np.einsum("plf,pls->fs", x, single), pair.sum(axis=(0, 1)), single[:, 0].sum(axis=0))
        for w, s, observed, guess in zip(weights, squares, seen, expected):
            gradient = observed - guess - ridge * w
            s += gradient**2
            w += rate * gradient / np.sqrt(s)
    return Model(*weights)


def by_tags(page: list[Block]) -> list[int]:
    """Labels that a page gives itself: inside ``article`` or ``main`` and in nothing that is set apart."""
    return [int(bool({"article", "main"} & set(b.tags)) and not (NOT_MAIN & set(b.tags)) and not (b.hints & AWAY)) for b in page]


def train(pages: DataFrame | None = None, key: str = "page_id", html: str = "html", sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """A model of the labelled pages and of at most ``sample`` rows of ``pages`` that have a main element.

    The rows are those of the smallest keys, so the same table gives the same model. A page of more than ``longest``
    blocks does not join, so every page that does is learned from as a whole. Both bound the training only:
    every page is extracted, whole."""
    labelled = [blocks(p) for p in PAGES]
    data = [(rows_of(p), [b.label for b in p]) for p in labelled] * 4
    if pages is not None and sample:
        known = pages.filter(F.col(key).isNotNull() & F.col(html).isNotNull()).select(key, F.col(html).alias("html"))
        # Keys first: tasks send ``sample`` keys each, and only the pages of the smallest ones come to the driver.
        smallest = [r[0] for r in known.select(key).orderBy(key).limit(sample).collect()]
        rows = known.filter(F.col(key).isin(smallest)).limit(sample).collect() if smallest else []
        for row in sorted(rows, key=lambda r: (r[key], r["html"])):
            page = blocks(row["html"])
            labels = by_tags(page)
            if any(labels) and len(page) <= longest:
                data.append((rows_of(page), labels))
    return fit(data)


def main_text(page: str | None, model: Model) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b.text for b, label in zip(found, model.decode(rows_of(found))) if label)


def extract(pages: DataFrame, key: list[str], html: str = "html", model: Model | None = None) -> DataFrame:
    """``key`` columns and ``text``, the main text of each whole page: its main blocks in page order, one a line.

    Null and empty pages, and pages without main text, give an empty text; repeated rows give repeated rows.
    """
    model = model or train()
    return map_texts(pages, key, html, lambda: lambda page: (main_text(page, model),), "text string")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    text = extract(pages, ["page_id", "url"], model=train(pages))
    return text.withColumn("n_chars", F.length("text").cast("long"))
