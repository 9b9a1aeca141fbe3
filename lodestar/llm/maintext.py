"""Main text of web pages: the contiguous region of the highest score, words counting for it and tags against.

A page is a row of tags and texts. A word scores by the elements that it is in, a tag by how often it stands outside of
main text; both weights are fitted to labelled pages. One linear scan gives the stretches of the greatest sums: the best is
the main text, together with those that come near it. The same scan over the negated scores of such a stretch finds what
speaks against it, an advert between two paragraphs, say, and its words go. Nothing else leaves a text out.
"""

from __future__ import annotations

import functools
import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.columns import map_column, quoted

#: Labelled pages that weights are fitted on, and kinds of places in them (the bounds of the sample).
TRAIN_PAGES, PLACES = 400, 5000
#: Class and id names that get a weight of their own, the most frequent first.
OWN_NAMES = 400
#: Stretches of at least this share of the best one's score count as main text too.
SHARE = 0.2
#: A stretch that speaks against main text within it goes when its words score -CUT or less.
CUT = 0.45
#: Least and greatest score of a word. A few words that speak against a stretch must not part what surrounds them.
WORST, BEST = -0.5, 1.5
#: What a tag costs that always stands outside of main text; spread of a fitted weight around its prior.
TAG_COST, SPREAD = 0.5, 1.0

# Elements whose content isn't markup, elements whose text isn't shown, and the kinds of elements.
RAW = "script style textarea title iframe xmp noembed noframes"
SILENT = frozenset("head template svg math object canvas audio video select option datalist noscript".split())
BLOCK = frozenset(
    "p div section article main body html h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr pre blockquote figure figcaption hr address details summary "
    "fieldset nav header footer aside form button dialog menu".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
INLINE = frozenset("b i em strong span u s small big font tt code kbd samp var sub sup abbr cite mark q label time a ins del bdi bdo dfn strike".split())
GAP = frozenset("br td th img".split())
#: An opening tag ends an open element of these kinds, up to the nearest of the others.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
ENDS = {tag: (frozenset(ended.split()), frozenset(up_to.split())) for tag, (ended, up_to) in ENDS.items()}
# Words for what stands around a main text, and words that say nothing about it, in class and id names.
AROUND = frozenset(
    "ad advert advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb sidebar aside footer header masthead cookie consent gdpr "
    "notice popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment respond response reply replies discussion discuss thread "
    "feedback reader disqus pagination pager widget toolbar search skip hidden".split()
)
NEUTRAL = frozenset("box block section wrapper wrap container area list item bar main site page top bottom left right inner outer global unit slot zone group button link post content form".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Prior weights of the places that a word can be in. "word" holds everywhere.
PRIOR = {
    "word": 1.0, "p": 0.5, "main": 0.5, "link": -0.4, "heading": 0.3, "nav": -3.0, "footer": -3.0, "aside": -3.0, "menu": -3.0, "dialog": -3.0, "button": -3.0, "form": -2.5,
    "header": -3.0, "named": -3.0, "role": -3.0, "hidden": -5.0, "silent": -6.0,
}
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))

_QUOTED = r"""(?:[^>"']|"[^"]{0,65536}"|'[^']{0,65536}')*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW.replace(' ', '|')})\b(?:{_QUOTED}|[^>]*)>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:({_QUOTED})|([^>]*))>|<[!?/][^>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
_PARTS = re.compile(r"[_\-]+|(?<=[a-z])(?=[A-Z])")


def _around(name: str) -> bool:
    """Whether a class or id name as a whole is one of something around the main text: "site-header", but not "with-header"."""
    parts = [p.lower() for p in _PARTS.split(name) if p]
    known = [any(x in AROUND for x in (p, p.removesuffix("s"))) for p in parts]
    return any(known) and all(k or p in NEUTRAL or p.removesuffix("s") in NEUTRAL for k, p in zip(known, parts, strict=True))


def _places(tag: str, attributes: str, above: frozenset[str]) -> set[str]:
    """What an element adds to the places of the words in it."""
    found = {tag} if tag not in INLINE and tag not in ("html", "body", "article", "div", "section", *HEADINGS) else set()
    if tag in SILENT:
        found = {"silent"}
    elif tag == "a":
        found.add("link")
    elif tag in HEADINGS:
        found.add("heading")
    elif tag == "header" and "in-article" in above:
        found = set()  # the article's own
    elif tag == "article":
        found.add("in-article")
    elif tag == "main":
        found.add("in-article")
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                for v in value.split():
                    found.add(f".{v}")
                    if _around(v) and tag not in ("html", "body", "main", "article"):
                        found.add("named")
            elif name == "role" and value.lower() in ROLES:
                found.add("role")
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                found.add("hidden")
    return found


@dataclass(slots=True)
class Run:
    """A piece of a page in order: a text, or a tag (text is None) that may end a block, with the places that it is in."""

    tag: str
    text: str | None = None
    places: frozenset[str] = frozenset()
    inside: bool = False
    owner: Owner | None = None


@dataclass(slots=True, eq=False)
class Owner:
    """An open element: its tag, how deep it is, and the element that it is in."""

    tag: str
    depth: int = 0
    above: Owner | None = None


def shared(a: Owner, b: Owner) -> Owner:
    """The innermost element that holds both."""
    while a is not b:
        if a.depth >= b.depth:
            a = a.above
        else:
            b = b.above
    return a


def runs(page: str) -> Iterator[Run]:
    """Tags and texts of a page. inside: whether it is in an article element, which labels a page; no place tells it."""
    root = Owner("")
    stack: list[tuple[str, frozenset[str], bool, Owner]] = [("", frozenset(), False, root)]
    known: dict[tuple, frozenset[str]] = {}
    at, stop = 0, page.rfind(">") + 1
    for m in _TOKEN.finditer(page, 0, stop):
        if m.start() > at:
            yield Run("", page[at : m.start()], *stack[-1][1:])
        at = m.end()
        if m[3] is None:  # a comment, a declaration, or an element whose content isn't text
            if m[1]:
                yield Run(m[1].lower(), None, *stack[-1][1:])
            continue
        tag, attributes = m[3].lower(), m[4] if m[4] is not None else m[5]
        if m[2]:
            _, places, inside, owner = stack[-1]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    break
                if tag in INLINE and stack[depth][0] in BLOCK:
                    break  # an inline element's end ends no block
            yield Run(tag, None, places, inside, owner)
            continue
        if tag in ENDS:
            ended, up_to = ENDS[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in ended:
                    del stack[depth:]
                    break
                if stack[depth][0] in up_to:
                    break
        elif tag in BLOCK:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in ("p", "head"):
                    del stack[depth:]
                    break
                if stack[depth][0] not in INLINE:
                    break
        _, places, inside, owner = stack[-1]
        if tag == "a":  # no link within a link: the open one ends
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "a":
                    del stack[depth:]
                    _, places, inside, owner = stack[-1]
                    break
                if stack[depth][0] in BLOCK:
                    break
        inside = inside or tag == "article"
        yield Run(tag, None, places, inside, owner)
        if tag not in VOID and not (attributes.endswith("/") and tag in SILENT):
            key = (places, tag, attributes)
            if key not in known:
                known[key] = places | _places(tag, attributes, places)
            stack.append((tag, known[key], inside, Owner(tag, owner.depth + 1, owner)))
    if at < len(page):
        yield Run("", page[at:], *stack[-1][1:])


def size_of(text: str) -> int:
    """Words of a text; one without spaces counts by its length."""
    words = len(text.split())
    return max(words, len(text) // 20) if words else 0


@dataclass
class Weights:
    """Scores of a word by the places that it is in (the sum of theirs), and of tags; other tags score `other`."""

    places: dict[str, float] = field(default_factory=lambda: dict(PRIOR))
    tags: dict[str, float] = field(default_factory=dict)
    other: float = -TAG_COST / 4
    known: dict[frozenset, float] = field(default_factory=dict, repr=False, compare=False)

    def word(self, places: frozenset[str]) -> float:
        if places not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            found = [self.places["word"], *(self.places.get(p, 0.0) for p in places)]
            self.known[places] = max(WORST, min(BEST, sum(v for v in found if v > 0)) + sum(v for v in found if v < 0))
        return self.known[places]

    def score(self, run: Run) -> float:
        if run.text is None:
            return self.tags.get(run.tag, self.other)
        return size_of(run.text) * self.word(run.places)


def observe(page: str) -> tuple[dict[str, list[int]], dict[str, list[int]]] | None:
    """({places: [words outside, inside]}, {tag: [outside, inside]}) of a page that one article element labels, else None.

    Tags in a place that speaks against main text by itself, such as the list of links in a menu, aren't counted.
    """
    words: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    tags: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    prior, articles = Weights(), 0
    for r in runs(page):
        articles += r.text is None and r.tag == "article"
        if r.text is None:
            if prior.word(r.places) > 0:
                tags[r.tag][r.inside] += 1
        elif n := size_of(r.text):
            words[" ".join(sorted(r.places - {"in-article"}))][r.inside] += n
    return (dict(words), dict(tags)) if articles == 2 and any(w[1] for w in words.values()) else None


def fit(words: dict[str, list[int]], tags: dict[str, list[int]]) -> Weights:
    """Weights from counts of labelled words and tags, outside and inside of main text. Without any, the prior ones.

    Places: a logistic regression of whether a word is inside, with a normal prior around PRIOR (0 for a class or id name
    and for other elements); inside and outside weigh the same. Tags: the share that stands outside, times -TAG_COST.
    """
    shares = {t: -TAG_COST * (out + 1) / (out + within + 4) for t, (out, within) in tags.items()}
    total = [max(1, sum(w[k] for w in words.values())) for k in (0, 1)]
    if not words:
        return Weights(tags=shares)
    often: dict[str, int] = defaultdict(int)
    for place, (out, within) in words.items():
        for p in place.split():
            if p not in PRIOR:
                often[p] += out + within
    names = [*PRIOR, *sorted(often, key=lambda p: (-often[p], p))[:OWN_NAMES]]
    column = {p: i for i, p in enumerate(names)}
    x = np.zeros((len(words), len(names)))
    x[:, 0] = 1.0
    for row, place in enumerate(words):
        for p in place.split():
            if p in column:
                x[row, column[p]] = 1.0
    # As many observations as there are rows of either label at most, shared out by words.
    seen = np.array([[out / total[0], within / total[1]] for out, within in words.values()]) * 40.0
    prior = np.array([PRIOR.get(p, 0.0) for p in names])
    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (seen[:, 1] - seen.sum(1) * p) - (w - prior) / SPREAD**2
        curve = (x * (seen.sum(1) * p * (1 - p))[:, None]).T @ x + np.eye(len(names)) / SPREAD**2
        step = np.linalg.solve(curve, gradient)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return Weights({p: float(round(v, 6)) for p, v in zip(names, w, strict=True)}, shares)


def stretches(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal stretches (begin, end, sum) of a row of scores, in order, by one scan.

    A stretch is maximal when no part of it, and no larger one that holds it without falling below zero at an end, sums
    to more. The scan keeps candidates with the sums before and after them, each with the nearest one to its left that
    begins lower; a candidate that a new stretch outdoes is merged into it.
    """
    begins: list[int] = []
    ends: list[int] = []
    befores: list[float] = []
    afters: list[float] = []
    lower: list[int] = []  # place of the nearest candidate to the left with a smaller sum before it, else -1
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        begin, left, j = i, before, len(begins) - 1
        while True:
            while j >= 0 and befores[j] >= left:
                j = lower[j]
            if j < 0 or afters[j] >= total:
                break
            begin, left, outer = begins[j], befores[j], lower[j]
            for kept in (begins, ends, befores, afters, lower):
                del kept[j:]
            j = outer
        for kept, value in zip((begins, ends, befores, afters, lower), (begin, i + 1, left, total, j), strict=True):
            kept.append(value)
    return [(a, b, y - x) for a, b, x, y in zip(begins, ends, befores, afters, strict=True)]


def main_text(page: str, weights: Weights) -> str:
    """The blocks of the best stretch of the page, of those that come near it, and of those that share its innermost element,
    joined by empty lines; "" without any. The body and the page as a whole are no such element: too much else is in them."""
    found = list(runs(page))
    scores = [weights.score(r) for r in found]
    regions = stretches(scores)
    if not regions:
        return ""
    begin, end, best = max(regions, key=lambda r: r[2])
    held = functools.reduce(shared, (r.owner for r in found[begin:end] if r.text is not None and r.text.strip()))
    while held.tag in INLINE or held.tag in ("p", *HEADINGS):
        held = held.above
    whole = held.tag in ("", "html", "body")
    chosen = np.zeros(len(found), bool)
    for a, b, s in regions:
        if s >= SHARE * best or (not whole and all(shared(held, r.owner) is held for r in found[a:b] if r.text is not None)):
            chosen[a:b] = True
            for x, y, _ in stretches([-v for v in scores[a:b]]):
                if sum(scores[i] for i in range(a + x, a + y) if found[i].text is not None) <= -CUT:
                    chosen[a + x : a + y] = False
    blocks, pieces = [], []
    for r, kept in zip([*found, Run("html")], [*chosen.tolist(), False], strict=True):
        if r.text is not None:
            if kept:
                pieces.append(r.text)
        elif r.tag in BLOCK:
            block = " ".join(html.unescape("".join(pieces)).split())
            if block:
                blocks.append(block)
            pieces = []
        elif r.tag in GAP:
            pieces.append(" ")
    return "\n\n".join(blocks)


_SEEN = "page long, tag boolean, place string, out long, within long"


def fit_pages(pages: DataFrame, key: str = "page_id", source: str = "html", most: int = TRAIN_PAGES) -> Weights:
    """Weights from at most `most` keys' pages, chosen by a hash of the key; pages that no article element labels don't count.

    Tasks count words and tags by place, Spark adds them up, and at most PLACES sums come to the driver. Rows of one key
    count once.
    """
    hashed = F.xxhash64(quoted(key))
    last = pages.select(hashed.alias("h")).distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if last is None:
        return Weights()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = observe(page)
                if seen:
                    rows = [{"page": h, "tag": tag, "place": place, "out": n[0], "within": n[1]} for tag, part in zip((False, True), seen, strict=True) for place, n in part.items()]
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("page", pa.int64()), ("tag", pa.bool_()), ("place", pa.string()), ("out", pa.int64()), ("within", pa.int64())]))

    sample = pages.select(hashed.alias("h"), quoted(source).alias("html")).where((F.col("h") <= last) & F.col("html").contains("<article"))
    once = sample.mapInArrow(count, _SEEN).groupBy("page", "tag", "place").agg(F.min("out").alias("out"), F.min("within").alias("within"))
    sums = once.groupBy("tag", "place").agg(F.sum("out").alias("out"), F.sum("within").alias("within"))
    told = sums.orderBy(F.desc(F.col("out") + F.col("within")), "tag", "place").limit(PLACES).collect()
    return fit(*[{r["place"]: [r["out"], r["within"]] for r in told if r["tag"] == tag} for tag in (False, True)])


def extract(pages: DataFrame, weights: Weights, source: str = "html", text: str = "text") -> DataFrame:
    """pages with the main text of every whole page. All other columns stay; one named as the output is replaced.

    Null and empty html give an empty text, as does a page without a word that speaks for any stretch; rows that repeat
    give equal texts; of stretches with equal sums all count; a table without rows gives none.
    """

    def run(part: pa.Array) -> list[pa.Array]:
        return [pa.array([main_text(p, weights) for p in part.to_pylist()], pa.string())]

    return map_column(pages, F.coalesce(quoted(source), F.lit("")), [T.StructField(text, T.StringType())], run)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages: their main text."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    done = extract(pages, fit_pages(pages)).select("page_id", "url", "text")
    return done.withColumn("n_chars", F.length("text").cast("long"))
