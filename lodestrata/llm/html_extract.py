"""Main text of HTML pages by the maximum-scoring subsequence of their tokens.

A page is a sequence of words and tags. Words score positive where labelled pages have
such words in their content, tags negative by how much rarer they are inside content
than outside. One linear scan finds the contiguous run of tokens with the largest sum;
its words, block by block, are the text.

Weights come from labelled pages: those that mark their content with one <article> or
<main>. At extraction that mark decides nothing. Counted are
* for words, their surroundings: the kind of block they stand in (all containers count
  as one kind but for the labels, so that renamed ones are the same), whether in a link,
  and whether the block is short; a word scores the log odds of content there, at most 1,
  and 1 where nothing is known. On a page without any word that scores, all score 1;
* for containers' tags, the same odds, negative; each is counted by its name and as a
  container of any name, and the milder of both holds. Other tags take next to nothing;
* for containers whose name or class says what they hold, the share of content among
  their words, with a prior for names that the HTML standard or common usage gives to
  boilerplate. Those below one half are cut out before the scan: a menu, a notice or a
  reader comment in the middle of the content is not contiguous with it.
Weights are fitted on the labelled ones among about `sample_pages` pages (chosen by a
hash of their html); their counts are summed where the pages are, so that no pages move.

Table rows are blocks and their cells are parts of them (as in a browser's plain text,
where a tab, so white space, stands between cells). Formulas and drawings keep their text.

Defined results: null, empty and wordless pages give an empty text; a page cut off
in the middle gives what it has up to there; very long pages are read whole, one at a
time; of equal sums the first, then the shortest run wins; repeated rows are each
returned; an empty table gives an empty table; other columns are ignored or passed through.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..partitions import spread

SAMPLE_PAGES = 2000
#: HTML element kinds.
RAW = frozenset("script style noscript template textarea title iframe".split())
MENUS = frozenset("nav header footer aside form button select dialog menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul".split()
)
LABELS = ("article", "main")
CONTAINERS = MENUS | frozenset("article main section div ul ol table fieldset details".split())
#: Containers that say nothing of what they hold, and that another of these could stand for.
PLAIN = frozenset("article main section div nav header footer aside menu details dialog body center address dir hgroup search".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Words in class, id or role that give boilerplate away.
NOISE = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header legal login "
    "menu modal nav navbar navigation newsletter notice pagination popup promo promoted related replies respond search share sharing sidebar "
    "signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z)|<[!?/](?:[^>]*)(?:>|\Z)|<(?P<bad>/?[A-Za-z][^\s/>]*)[^>]*(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"(?P<a>[^\"]*)\"|'(?P<b>[^']*)'|(?P<c>[^\s>]+))", re.I)
#: Scores: of a word of which nothing is known; the least of a word; the least and the most that a tag takes away (so many
#: words, so that a wrapper that no labelled page has does not tear a text apart). Words below which a block is short.
WORD_SCORE, LEAST, NEUTRAL, MOST, SHORT, ANY = 1.0, -4.0, 0.001, 2.0, 4, "any"


@dataclass
class Node:
    """Something in page order: text, or a tag with its signature and (for a start tag) where its element ends."""

    kind: str  # text, start, end
    name: str = ""
    text: str = ""
    words: int = 0
    sign: str = ""
    end: int = -1


@dataclass
class Weights:
    """content: signature -> share of content among its words. words: surroundings -> score. tags: name -> penalty."""

    content: dict[str, float] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def tag(self, name: str) -> float:
        own = self.tags.get(name)
        if name in PLAIN:
            return min((w for w in (own, self.tags.get(ANY)) if w is not None), default=NEUTRAL)
        return NEUTRAL if own is None else own

    def boilerplate(self, sign: str) -> bool:
        """Whether a container is cut out for its name."""
        return bool(sign) and self.content.get(sign, 0.0 if sign.startswith("!") else 1.0) < 0.5 and sign not in PLAIN


def _signature(name: str, attrs: str) -> str:
    """The container's kind: its name and first noise word, or its first class; with a "!" if names alone mark it as boilerplate."""
    first = ""
    for m in ATTR.finditer(attrs):
        words = (m["a"] or m["b"] or m["c"] or "").lower().split()
        first = first or (words[0] if words else "")
        for w in words:
            if not NOISE.isdisjoint(re.split(r"[^a-z]+", w)):
                return f"!{name}.{w}"
    return ("!" if name in MENUS else "") + (f"{name}.{first}" if first else name)


def parse(page: str) -> list[Node]:
    """The page's nodes; comments, doctypes and raw elements (scripts, styles, ...) leave none."""
    nodes: list[Node] = []
    open_: list[int] = []
    at, n = 0, len(page)

    def text(a: int, b: int) -> None:
        if b > a:
            t = html_lib.unescape(page[a:b])
            nodes.append(Node("text", text=t, words=len(t.split())))

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            text(at, n)
            break
        text(at, m.start())
        at = m.end()
        name = (m["name"] or (m["bad"] or "").lstrip("/")).lower()
        if not name:
            continue
        closing = bool(m["close"]) or (m["bad"] or "").startswith("/")
        if closing:
            nodes.append(Node("end", name))
            if name in CONTAINERS:
                for i in range(len(open_) - 1, -1, -1):
                    if nodes[open_[i]].name == name:
                        nodes[open_[i]].end = len(nodes) - 1
                        del open_[i:]
                        break
            continue
        attrs = m["attrs"] or ""
        if name in RAW:
            if not attrs.rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else n
            continue
        node = Node("start", name)
        if name in CONTAINERS:
            node.sign = _signature(name, attrs)
        nodes.append(node)
        if name in CONTAINERS:
            open_.append(len(nodes) - 1)
    return nodes


def _region(nodes: list[Node]) -> tuple[int, int] | None:
    """The element that labels a page's content: its only <article>, or else its only <main> (a comment's <article> does not count)."""
    for name in LABELS:
        found = [i for i, x in enumerate(nodes) if x.kind == "start" and x.name == name and not x.sign.startswith("!")]
        if len(found) == 1:
            i = found[0]
            return i, nodes[i].end if nodes[i].end >= 0 else len(nodes)
    return None


def surroundings(nodes: list[Node]) -> list[str]:
    """Of each text node: the kind of its block, whether it is linked, and whether its block has few words."""
    out = [""] * len(nodes)
    block, linked, members, words = "page", False, [], 0
    open_: list[str] = []

    def close() -> None:
        for i in members:
            out[i] += " short" if words < SHORT else ""

    for i, x in enumerate(nodes):
        if x.kind == "text":
            if x.words:
                out[i] = block + (" link" if linked else "")
                members.append(i)
                words += x.words
        elif x.name == "a":
            linked = x.kind == "start"
        elif x.name in BLOCKS:
            close()
            members, words = [], 0
            kind = ANY if x.name in PLAIN and x.name not in LABELS else x.name
            if x.kind == "start":
                if x.name != "hr":
                    open_.append(kind)
            elif kind in open_:
                del open_[len(open_) - 1 - open_[::-1].index(kind) :]
            linked = linked and kind != ANY
            block = open_[-1] if open_ else "page"
    close()
    return out


def tally(page: str) -> Counter | None:
    """Counts of a labelled page, by ("in"/"out", container), ("word in"/"word out", surroundings) and ("tag in"/"tag out", name); None if it has no label."""
    nodes = parse(page)
    region = _region(nodes)
    if region is None:
        return None
    counts: Counter = Counter()
    around = surroundings(nodes)
    stack: list[tuple[int, str]] = []
    for i, x in enumerate(nodes):
        while stack and i > stack[-1][0]:
            stack.pop()
        side = "in" if region[0] < i < region[1] else "out"
        signs = [s for _, s in stack]
        noisy = next((k for k, s in enumerate(signs) if s.startswith("!")), None)
        if x.kind == "text" and x.words:
            if noisy is None or side == "out":  # a notice amid the content says nothing of the words and tags around it
                counts[f"word {side}", around[i]] += x.words
            for sign in set(signs if noisy is None else signs[: noisy + 1]):
                counts[side, sign] += x.words
        elif x.kind != "text" and i not in region:
            if noisy is None or side == "out":
                counts[f"tag {side}", x.name] += 1
                if x.name in PLAIN:
                    counts[f"tag {side}", ANY] += 1
            if noisy is None and x.kind == "start" and x.sign and x.end >= 0:
                stack.append((x.end, x.sign))
    return counts


def fit(counts: dict[tuple[str, str], int], prior: float = 5.0) -> Weights:
    """Weights from summed tallies. `prior` words speak for what a container's name says, and for words that score WORD_SCORE."""
    w = Weights()

    def sides(kind: str) -> Iterator[tuple[str, int, int]]:
        for name in {n for k, n in counts if k in (f"{kind}in", f"{kind}out")}:
            yield name, counts.get((f"{kind}in", name), 0), counts.get((f"{kind}out", name), 0)

    for sign, a, b in sides(""):
        given = 0.0 if sign.startswith("!") else 1.0
        w.content[sign] = (a + prior * given) / (a + b + prior)
    for name, a, b in sides("word "):
        w.words[name] = max(LEAST, min(WORD_SCORE, math.log((a + prior * math.e) / (b + prior))))
    for name, a, b in sides("tag "):
        w.tags[name] = min(MOST, max(NEUTRAL, math.log((b + 0.5) / (a + 0.5)))) if name in PLAIN or name == ANY else NEUTRAL
    return w


def scored(page: str, weights: Weights) -> list[tuple[float, str | None]]:
    """(score, text) of each token: a text, None for a block's edge, a space for a cell's or a line's end, "" for other tags."""
    nodes = parse(page)
    around = surroundings(nodes)
    tokens: list[tuple[float, str | None]] = []
    i = 0
    while i < len(nodes):
        x = nodes[i]
        if x.kind == "text":
            tokens.append((x.words * weights.words.get(around[i], WORD_SCORE) if x.words else 0.0, x.text))
        elif x.kind == "start" and weights.boilerplate(x.sign) and x.end >= 0:
            tokens.append((-NEUTRAL, None))
            i = x.end
        else:
            tokens.append((-weights.tag(x.name), None if x.name in BLOCKS else (" " if x.name in ("br", "td", "th") else "")))
        i += 1
    return tokens


def best_run(scores: Iterable[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the largest sum: of equal ones the first, then the shortest."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for j, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, j
        total += score
        if total > best + 1e-9:
            best, span = total, (start, j + 1)
    return span


def extract(page: str | None, weights: Weights) -> str:
    """The text of the best run of tokens, blocks joined by newlines."""
    if not page:
        return ""
    tokens = scored(page, weights)
    start, end = best_run(score for score, _ in tokens)
    if start == end:  # nothing looks like content: then all words do
        start, end = best_run(float(len(t.split())) if t else -NEUTRAL for _, t in tokens)
    blocks, now = [], []
    for _, t in tokens[start:end]:
        if t is None:
            blocks.append("".join(now))
            now = []
        else:
            now.append(t)
    blocks.append("".join(now))
    return "\n".join(t for b in blocks if (t := " ".join(b.split())))


def train(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> Weights:
    """Weights from about `sample_pages` pages. Runs two jobs: a count, and the tallies, summed before they come to the driver (a few kinds for each container of the sample)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter = Counter()
            for page in b.column(0):
                counts += tally(page.as_py()) or Counter()
            rows = [(k[0], k[1], v) for k, v in counts.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(("kind", "sign", "n"), r)) for r in rows], schema=pa.schema([("kind", pa.string()), ("sign", pa.string()), ("n", pa.int64())]))

    share = sample_pages / max(1, pages.count())
    sample = pages.select(html_col).filter(F.col(html_col).isNotNull() & (F.pmod(F.xxhash64(html_col), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))))
    rows = sample.mapInArrow(run, "kind string, sign string, n long").groupBy("kind", "sign").agg(F.sum("n").alias("n")).collect()
    return fit({(r["kind"], r["sign"]): r["n"] for r in rows})


def extract_text(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES, weights: Weights | None = None) -> DataFrame:
    """`pages` with `text` in place of a column of that name. Fits the weights first unless they are given."""
    weights = weights or train(pages, html_col, sample_pages)

    @F.udf("string", useArrow=True)
    def text(page: str | None) -> str:
        return extract(page, weights)

    return pages.withColumn("text", text(F.col(html_col)))


def op10_html_extract(spark, sf_dir: str) -> DataFrame:
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return extract_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
