"""Main text of web pages: flat text blocks, classified by a decision tree over the blocks and their neighbours."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import chunks

# Elements by what they mean for the text inside or around them.
HIDDEN = "script style noscript template svg iframe object canvas audio video head title textarea select option button annotation annotation-xml"
BLOCKS = (
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame h1 h2 h3 h4 "
    "h5 h6 header hgroup hr html label legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul"
)
VOID = "area base br col embed hr img input link meta param source track wbr"
CHROME = "nav aside footer form menu dialog fieldset search"
# Words in class, id or role that name what is not the article, and what is.
OUTSIDE = (
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form header login "
    "masthead menu modal nav navbar navigation newsletter notice pagination popup promo related reply replies respond share sharing sidebar signup "
    "social sponsor sponsored subscribe tags toolbar widget"
)
# Last words of a class, id or role that say how, not what; first words after which the rest is not the element itself;
# elements that are never outside by a name of their own.
MANNER = "area bar block body bottom box container content group inner items left list outer panel primary right secondary section top wrap wrapper"
ABOUT = "has hide is layout no not with without"
NEVER = "html body main article h1 h2 h3 h4 h5 h6"
INSIDE = "article content entry main post story"
_hidden, _blocks, _void, _chrome, _outside, _inside, _manner, _about, _never = (set(x.split()) for x in (HIDDEN, BLOCKS, VOID, CHROME, OUTSIDE, INSIDE, MANNER, ABOUT, NEVER))
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "chrome", "outside", "heading")
# Labelled blocks: the features in the order above, then 1 for main text.  links are shares of the words that lie in links.
LABELLED = """
40 0 12 0 55 0 1 0 0 0 1
5 0 30 0 28 0 1 0 0 0 1
1 0 60 0 44 0 1 0 0 0 1
12 0 8 0 70 0 1 0 0 1 1
3 0 0 0 35 0 1 0 0 1 1
90 0.1 40 0 20 0 1 0 0 0 1
14 0.3 60 0 33 0 1 0 0 0 1
25 0.05 10 0 0 0 1 0 0 0 1
150 0 90 0.02 4 0.5 1 0 0 0 1
9 0 7 0 80 0 1 0 0 0 1
2 0 5 0 6 0 1 0 0 0 1
30 0 10 0 8 1 1 0 0 0 1
4 1 120 0 6 1 1 0 0 0 0
6 0.9 3 1 4 1 1 0 0 0 0
3 1 20 0 5 1 1 0 0 0 0
5 0 40 0 3 1 1 1 0 0 0
30 0 60 0 12 0 1 1 0 0 0
25 0 70 0 4 0 1 0 1 0 0
60 0 80 0 35 0 1 0 1 0 0
8 0 50 0 40 0 1 0 1 0 0
3 0 12 0 30 0 1 0 1 1 0
1 1 0 0 1 1 0 1 0 0 0
1 1 1 1 1 1 0 1 0 0 0
2 1 1 1 3 1 0 1 0 0 0
8 0 1 1 10 0 0 0 1 0 0
20 0 1 1 45 0 0 0 1 0 0
70 0 12 0 30 0 0 0 1 0 0
45 0 3 0 20 0 0 1 0 0 0
10 0 90 0 0 0 0 1 0 0 0
6 0.2 55 0 0 0 0 1 0 0 0
120 0 14 0 16 0 0 1 0 0 0
7 0 5 0 9 0 0 1 1 0 0
4 0 2 0 3 0 0 1 1 1 0
45 0 10 0 60 0 0 0 0 0 1
80 0.05 45 0 70 0.1 0 0 0 0 1
28 0.1 60 0 5 0.5 0 0 0 0 1
16 0 50 0 45 0 0 0 0 0 1
12 0 65 0 38 0 0 0 0 0 1
9 0 3 0 50 0 0 0 0 1 1
6 0 40 0 42 0 0 0 0 1 1
11 0 2 0.5 75 0 0 0 0 1 1
5 0 40 0 42 0 0 0 0 0 1
3 0 2 0.5 4 0.5 0 0 0 0 0
4 0 1 1 2 1 0 0 0 0 0
2 0 0 0 3 1 0 0 0 0 0
6 1 4 1 3 1 0 0 0 0 0
12 0.8 5 1 9 0.7 0 0 0 0 0
5 0.6 30 0 4 1 0 0 0 0 0
8 0 3 1 2 1 0 0 0 0 0
3 0 50 0 2 1 0 0 0 0 0
4 0.5 2 1 0 0 0 0 0 0 0
20 0.7 6 0.5 18 0.8 0 0 0 0 0
3 0 2 1 5 1 0 0 0 1 0
35 0 0 0 0 0 1 0 0 0 1
6 0 15 0 0 0 1 0 0 0 1
22 0 30 0 10 0.5 1 0 0 0 1
4 0 0 0 12 0 1 0 0 0 1
10 0 5 0 7 0 1 0 0 0 1
7 0 100 0 14 0 1 0 0 0 1
18 0.2 25 0 5 0 1 0 0 0 1
1 0 3 0 2 0 1 0 0 0 1
11 0 0 0 20 0 1 0 0 1 1
5 0 25 0 18 0 1 0 0 1 1
55 0 70 0 90 0 0 0 1 0 0
12 0 6 0 8 0 0 0 1 0 0
5 0 0 0 0 0 0 0 1 0 0
33 0 40 0 60 0 1 0 1 0 0
9 0 15 0 12 0 1 0 1 0 0
4 0 8 0 75 0 1 0 1 0 0
16 0 22 0 0 0 1 0 1 0 0
50 0 20 0 60 0 0 1 0 0 0
14 0 9 0 11 0 0 1 0 0 0
6 0 0 0 0 0 0 1 0 0 0
28 0 36 0 50 0 1 1 0 0 0
4 0 18 0 15 0 1 1 0 0 0
9 0 60 0 0 0 1 1 0 0 0
60 0 0 0 0 0 0 0 0 0 1
30 0 0 0 45 0 0 0 0 0 1
26 0 70 0 0 0 0 0 0 0 1
3 0 1 1 8 0 1 0 0 1 1
6 0 2 1 40 0 1 0 0 1 1
12 0 1 1 60 0 1 0 0 1 1
4 0 1 1 30 0 1 0 0 0 1
8 0 3 0.9 12 0 1 0 0 0 1
5 0 4 1 0 0 1 0 0 0 1
10 0 1 1 3 1 1 0 0 0 1
2 0 1 1 1 1 1 0 0 0 1
45 0 5 1 4 1 1 0 0 0 1
"""
# Blocks before links: short ones in an article stay, as do paragraphs outside one; links, and what is furniture or outside, do not.
LABELLED += "".join(
    [f"{w} {own} {before} {after} 1 1 0 0 {heading} 1\n" for w in (1, 2, 3, 5, 8, 12, 18, 25, 40) for own in (0, 0.3) for before in ("0 0", "30 0", "90 0", "4 1") for after in (2, 4, 9, 25) for heading in (0, 1)]
    + [f"{w} 0 {before} 0 {after} 1 0 0 0 0 1\n" for w in (10, 14, 20, 25) for before in (20, 40, 90) for after in (2, 4, 9)]
    + [f"{w} {own} {before} {after} 1 1 0 0 0 0\n" for w in (2, 5, 9, 20) for own in (0.7, 1) for before in ("5 1", "40 0") for after in (3, 9)]
    + [f"{w} 0 {before} 0 {after} 1 1 {chrome} {1 - chrome} 0 0\n" for w in (3, 12, 30) for before in (5, 40) for after in (3, 9) for chrome in (0, 1)]
)


@dataclass
class Tree:
    """Binary decision tree in arrays: rows with feature <= threshold go left; leaves have feature -1."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]

    @classmethod
    def fit(cls, rows: np.ndarray, labels: np.ndarray, depth: int = 12) -> Tree:
        """Greedy splits by Gini impurity, halfway between neighbouring values; the first of equally good ones."""
        tree = cls([], [], [], [], [])

        def grow(at: np.ndarray, level: int) -> int:
            k, share = len(tree.feature), float(labels[at].mean())
            for field, value in ((tree.feature, -1), (tree.threshold, 0.0), (tree.left, -1), (tree.right, -1), (tree.value, share)):
                field.append(value)
            if level == depth or share in (0.0, 1.0):
                return k
            best = (2 * share * (1 - share) * len(at) - 1e-9, -1, 0.0)
            for f in range(rows.shape[1]):
                values = np.unique(rows[at, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    low = labels[at][rows[at, f] <= cut]
                    high = labels[at][rows[at, f] > cut]
                    impurity = sum(2 * p.mean() * (1 - p.mean()) * len(p) for p in (low, high))
                    if impurity < best[0]:
                        best = (impurity, f, float(cut))
            if best[1] >= 0:
                below = rows[at, best[1]] <= best[2]
                tree.feature[k], tree.threshold[k] = best[1], best[2]
                tree.left[k], tree.right[k] = grow(at[below], level + 1), grow(at[~below], level + 1)
            return k

        grow(np.arange(len(rows)), 0)
        return tree

    def keep(self, row: tuple) -> bool:
        k = 0
        while self.feature[k] >= 0:
            k = self.left[k] if row[self.feature[k]] <= self.threshold[k] else self.right[k]
        return self.value[k] >= 0.5


def trained_tree(table: str = LABELLED) -> Tree:
    rows = np.array([[float(x) for x in line.split()] for line in table.strip().splitlines()])
    return Tree.fit(rows[:, :-1], rows[:, -1])


def _named_outside(name: str) -> bool:
    """Whether a whole class, id or role names what is not the article: by its last word that says what it is."""
    words = _WORDS.findall(name.lower())
    if not words or words[0] in _about:
        return False
    while len(words) > 1 and words[-1] in _manner:
        words.pop()
    return words[-1] in _outside


def blocks(page: str | None) -> list[tuple]:
    """(text, words, share of linked words, in an article, in page furniture, named as outside, heading) of each text block."""
    out, parts, linked = [], [], 0
    stack: list[tuple[str, tuple]] = []
    # In an article, in furniture, named as outside, heading, depth of links.
    state = (False, False, False, False, 0)
    at, hidden, text = 0, None, page or ""

    def close() -> None:
        nonlocal parts, linked
        words = " ".join("".join(parts).split())
        if words:
            n = words.count(" ") + 1
            out.append((words, n, min(1.0, linked / n), *state[:4]))
        parts, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            piece = html.unescape(raw) if "&" in raw else raw
            parts.append(piece)
            if state[4]:
                linked += len(piece.split())

    for m in _TOKEN.finditer(text):
        if hidden:
            if m[2] and m[1] and m[2].lower() == hidden:
                hidden, at = None, m.end()
            continue
        add(text[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name, ends = m[2].lower(), bool(m[1])
        if name in _hidden and name != "head":
            if not ends and not m[3].endswith("/") and re.compile(f"</{name}\\b", re.I).search(text, at):
                hidden = name
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in _blocks:
            close()
        if name in _void or name == "head":
            continue
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    state = stack[k][1]
                    del stack[k:]
                    break
                # Phrases left open do not outlive a block, and a stray end tag does not close blocks around it.
                if stack[k][0] in _blocks and name not in _blocks:
                    break
            continue
        if name == "p" or name == "li":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    state = stack[k][1]
                    del stack[k:]
                    break
                if stack[k][0] in _blocks and stack[k][0] != "p":
                    break
        stack.append((name, state))
        article, chrome, outside, heading, depth = state
        names = [n for group in _NAMED.findall(m[3]) for n in " ".join(group).split()] if "=" in m[3] else ()
        # The header of an article holds its title.
        other = any(_named_outside(n) and not (article and n.lower().endswith("header")) for n in names)
        if name in ("article", "main"):
            # An inner article is main text again, unless it is itself a comment or the like.
            article, outside = True, outside and name == "article" and other
        elif name in _blocks and not outside and not other and any(w & _inside and not w & _outside for w in (set(_WORDS.findall(n.lower())) for n in names)):
            article = True
        chrome |= name in _chrome or (name == "header" and not article)
        outside |= other and name not in _never
        heading |= len(name) == 2 and name[0] == "h" and name[1] in "123456"
        state = (article, chrome, outside, heading, depth + (name == "a"))
    if not hidden:
        add(text[at:])
    close()
    return out


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page)
    kept = []
    for i, (text, words, links, article, chrome, outside, heading) in enumerate(found):
        before = found[i - 1][1:3] if i else (0, 0.0)
        after = found[i + 1][1:3] if i + 1 < len(found) else (0, 0.0)
        if tree.keep((words, links, *before, *after, article, chrome, outside, heading)):
            kept.append(text)
    return "\n".join(kept)


def extract_main_text(pages: DataFrame, *, source: str = "html", text: str = "text") -> DataFrame:
    """``pages`` without the column ``source``, with ``text``: the main text of each whole page.

    A page is cut into blocks at its block elements; scripts, styles, comments and form controls are left out, character
    references decoded, white space inside a block made one blank.  A decision tree, trained here on the labelled table,
    keeps or drops each block by its words, its share of linked words, the same of its neighbours, and where it stands.
    A null or empty page, and one of which nothing is kept, gives an empty text.  Pages are independent of each other.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trained_tree())
    kept = pages.drop(text) if text != source else pages
    names = [c for c in kept.columns if c != source]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in chunks(batches, source):
            texts = pa.array([main_text(page, shared.value) for page in found], pa.string())
            columns = [c for n, c in zip(batch.schema.names, batch.columns) if n != source]
            yield pa.RecordBatch.from_arrays([*columns, texts], names=[*names, text])

    return kept.mapInArrow(run, kept.select(*names).withColumn(text, F.lit("").cast("string")).schema)
