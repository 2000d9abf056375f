"""Main text of web pages: the maximum-scoring run of words and tags, with weights from labelled pages.

A page is a line of words and tags. A word scores by what it stands in (its block's tag, a link outside paragraphs,
beside the page's marked article), a tag costs, and one linear scan finds the contiguous region with the largest sum.
Labelled pages are those that mark one ``article`` or ``main`` element: what stands within and beyond it gives the
weights, also of the words in class, id and role names, by which parts inside the region are left out. A compound name
with a word of no known weight, as in comment-thread-analysis, says too little for that.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.arrow import prepare, texts
from quillon.llm.sample import smallest_hashes

#: Weights are learned from so many pages at most, and so many features of theirs, the commonest, are kept.
FIT_PAGES, FEATURES = 4000, 20_000
#: Score of a word; bound of a learned weight; cost of a block tag and of a part that is left out.
WORD, BOUND, TAG, LEFT_OUT = 1.0, 3.0, -0.1, -0.5
#: Names whose weights add up to this or less name a part that is left out; words that the prior of a name stands for.
OUT_AT, PRIOR = -1.5, 20
#: Tags with quotes that never close, after which quotes are no longer heeded in a page.
PATIENCE = 16

_TAG = re.compile(r"""<(?:!--|!\[CDATA\[|[!?]|(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>)""")
_PLAIN = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_NAMED = re.compile(r"""(?:^|[\s/"'])(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", re.I)
# Kinds of elements as the HTML standard has them.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
_OUT = frozenset("head nav aside footer form script style noscript template iframe button select textarea title dialog menu svg canvas object fieldset label input option noframes xmp".split())
_MAIN = frozenset(("article", "main"))
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Prior of name words, which labelled pages can overrule: what is mostly beyond the article (as are links outside
#: paragraphs), and what mostly holds it.
BEYOND = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle alert banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies dialog discussion disqus "
    "footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup popover promo promotion related recommended recommendations replies "
    "reply respond responses search share sharing sidebar signup skip skiplink social sponsor sponsored subscribe subscription teaser toc toolbar topbar tracking widget".split()
)
WITHIN = frozenset("article post entry story prose body content main text".split())
#: Names beyond the article whatever stands beside them; and words that say nothing of what an element holds, which leave
#: the rest of a compound name its meaning. Any other word, as in search-guide, makes the name one of its own.
SURE = frozenset("ad ads adv advert adverts advertisement advertising adsbygoogle banner cookie cookies footer gdpr navbar navigation newsletter popover popup promo promotion sidebar sponsor sponsored".split())
NEUTRAL = frozenset(
    "area bar body bottom box bubble button buttons card cards center col column container content count counter desktop div feed field fixed float form group header heading holder icon icons id inner input item items js label "
    "large layer left level line link links list lists main message messages mobile module new outer page panel panels post posts primary reader readers region results right row secondary section sections site slot small sticky "
    "strip text thread threads title top ui unit user users view wrap wrapper zone".split()
)
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_TEXT, _OPEN, _CLOSE, _EMPTY = range(4)


def names(attributes: str) -> tuple[list[list[str]], bool]:
    """The words of each class, id and role name, and whether the element is hidden."""
    found = []
    for m in _NAMED.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", value, re.I):
            return [], True
        if name in ("class", "id", "role"):
            found += [w for w in ([x.lower() for x in _SPLIT.findall(token)] for token in value.split()) if w]
    return found, False


def scan(source: str) -> list[list]:
    """Events of a page in one pass: [kind, text or tag, attributes, index of the closing event, closed by its own end tag].

    Elements that stay open are closed where an outer one is, or at the end. Every step moves on in the page and looks
    back at nothing, so malformed pages cost no more than others.
    """
    events: list[list] = []
    stack: list[int] = []  # open events
    open_now: Counter = Counter()
    n, last, at, failed = len(source), source.rfind(">"), 0, 0

    def pop(own: bool) -> str:
        i = stack.pop()
        event = events[i]
        open_now[event[1]] -= 1
        event[3], event[4] = len(events), own
        events.append([_CLOSE, event[1], "", i, own])
        return event[1]

    def text(raw: str) -> None:
        if raw:
            events.append([_TEXT, raw, "", 0, False])

    while at < n:
        lt = source.find("<", at)
        if lt < 0 or lt > last:  # no tag can end any more
            text(source[at:])
            break
        m = (_TAG if failed < PATIENCE else _PLAIN).match(source, lt)
        if m is None and failed < PATIENCE and lt + 1 < n and (source[lt + 1].isalpha() or source[lt + 1] == "/"):
            m = _PLAIN.match(source, lt)
            failed += m is not None
        if m is None:
            mark = source[lt : lt + 2]
            if mark in ("<!", "<?"):
                end = source.find("-->", lt) if source.startswith("<!--", lt) else source.find(">", lt)
                text(source[at:lt])
                at = n if end < 0 else end + (3 if source.startswith("<!--", lt) else 1)
                continue
            text(source[at : lt + 1])
            at = lt + 1
            continue
        text(source[at:lt])
        if not m[2]:
            end, width = (source.find("-->", lt), 3) if m[0] == "<!--" else (source.find("]]>", lt), 3) if m[0] == "<![CDATA[" else (source.find(">", lt), 1)
            at = n if end < 0 else end + width
            continue
        at = m.end()
        name, attributes = m[2].lower(), m[3]
        if m[1]:
            if open_now[name]:
                while pop(events[stack[-1]][1] == name) != name:
                    pass
            elif name == "p" or name not in _INLINE:
                events.append([_EMPTY, name, "", 0, False])
            continue
        if name == "body":
            while stack and events[stack[-1]][1] == "head":
                pop(True)
        if name in _VOID or attributes.endswith("/") and name not in _MAIN:
            events.append([_EMPTY, name, attributes, 0, False])
            continue
        stack.append(len(events))
        open_now[name] += 1
        events.append([_OPEN, name, attributes, 0, False])
        if name in _RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*+>", re.I).search(source, at)
            text(source[at : close.start() if close else n])
            at = close.end() if close else n
            pop(close is not None)
    while stack:
        pop(False)
    return events


def region(scores: list[float]) -> tuple[int, int]:
    """First and last (exclusive) place of the contiguous run with the largest sum, the first of equal ones: one linear scan."""
    top = total = 0.0
    best, start = (0, 0), 0
    for i, score in enumerate(scores):
        total += score
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > top:
            top, best = total, (start, i + 1)
    return best


def name_weight(words: list[str], weights: dict[str, float]) -> float:
    """What a name says: its least word, or the mean where that word isn't SURE and another one is foreign (not known to be beyond, not NEUTRAL or WITHIN, three letters or more); such a name alone leaves nothing out."""
    each = [weights.get(f".{w}", 0.0) for w in words]
    least = min(each, default=0.0)
    foreign = any(x >= 0 and w not in NEUTRAL | WITHIN and len(w) > 2 for w, x in zip(words, each))
    if least < 0 and foreign and not any(w in SURE and weights.get(f".{w}", 0.0) < 0 for w in words):
        return max(sum(each) / len(each), OUT_AT / 2)
    return least


class Page:
    """A scanned page with what each run of words stands in."""

    def __init__(self, source: str) -> None:
        self.events = scan(source)
        self.names = {i: names(e[2]) for i, e in enumerate(self.events) if e[0] == _OPEN and e[2]}
        self.marked = [i for i, e in enumerate(self.events) if e[0] == _OPEN and e[1] in _MAIN]

    def runs(self) -> Iterator[tuple[int, str, int, bool]]:
        """(event, context, words, named) of every run of words: its block's tag, ``>a`` in a link outside paragraphs; whether the block has names."""
        blocks, links = [("body", False)], 0
        for i, e in enumerate(self.events):
            kind, name = e[0], e[1]
            if kind == _TEXT:
                block, named = blocks[-1]
                yield i, ">a" if links and block != "p" else block, len(name.split()), named
            elif kind in (_OPEN, _CLOSE):
                step = 1 if kind == _OPEN else -1
                if name == "a":
                    links += step
                elif name not in _INLINE:
                    blocks.append((name, bool(self.names.get(i, ([], False))[0]))) if step > 0 else blocks.pop()

    def weight(self, i: int, weights: dict[str, float]) -> float:
        """Sum over the names of an element (:func:`name_weight`)."""
        return sum(name_weight(words, weights) for words in self.names.get(i, ([], False))[0])

    def best(self, weights: dict[str, float]) -> str:
        """The text of the contiguous region with the largest sum of scores, without the parts that are left out."""
        events = self.events
        total_p = [0]  # words of paragraphs, and headings and marked elements, before each text or opening event
        at_p, at_top = [], []
        runs = {i: (c, n) for i, c, n, _ in self.runs()}
        for i, (c, n) in runs.items():
            if c == "p":
                at_p.append(i)
                total_p.append(total_p[-1] + n)
        usual = [i for i in self.marked if self.weight(i, weights) > OUT_AT]
        at_top = sorted([*usual, *(i for i, e in enumerate(events) if e[0] == _OPEN and e[1] == "h1")])

        def holds(i: int) -> bool:
            """Whether an element has a heading of the page or a marked element, and half of the words in paragraphs."""
            end = events[i][3]
            if bisect_left(at_top, i) == bisect_left(at_top, end):
                return False
            return 2 * (total_p[bisect_left(at_p, end)] - total_p[bisect_left(at_p, i)]) >= total_p[-1] > 0

        inside = 0
        stack: list[tuple[int, int, bool]] = []  # left out before, marked before, whether all that is left out stays unclosed
        out, unclosed = 0, True
        scores: list[float] = []
        items: list[tuple[str, bool]] = []  # words, or a block's edge

        def add(score: float, words: str, edge: bool) -> None:
            scores.append(score)
            items.append((words, edge))

        single = len(usual) == 1
        beside = weights.get("beside", 0.0)
        for i, e in enumerate(events):
            kind, name = e[0], e[1]
            if kind == _TEXT:
                if not out:
                    context, n = runs[i]
                    score = WORD + weights.get(context, 0.0) + (beside if single and not inside else 0.0)
                    add(n * max(-2.0, min(WORD, score)), entities.unescape(name), False)
                continue
            if kind == _CLOSE:
                out, inside, unclosed = stack.pop()
            if kind in (_CLOSE, _EMPTY):
                if not out and name not in _INLINE:
                    add(min(TAG, weights.get(name, 0.0)) if kind == _CLOSE else TAG, "", True)
                continue
            stack.append((out, inside, unclosed))
            _, hidden = self.names.get(i, ([], False))
            weight = self.weight(i, weights)
            own = hidden or name in _OUT or name == "header" and not inside or name not in ("html", "body") and weight <= OUT_AT and not holds(i)
            if name in _MAIN and weight > OUT_AT and not hidden:
                if out and unclosed:  # a menu or advert that is never closed doesn't hold the article
                    out = 0
                inside, own = inside + 1, False
            if own:
                if not out:
                    add(LEFT_OUT, "", True)
                unclosed = (unclosed if out else True) and not e[4]
                out += 1
            elif not out and name not in _INLINE:
                add(min(TAG, weights.get(name, 0.0)), "", True)
        blocks, run = [], []
        first, last = region(scores)
        for words, edge in items[first:last]:
            if edge:
                blocks.append("".join(run))
                run = []
            else:
                run.append(words)
        blocks.append("".join(run))
        return " ".join(w for b in blocks for w in b.split())


def tally(page: Page) -> Iterator[tuple[str, int, int]]:
    """(feature, words within, words beyond) of a labelled page: contexts of words, and words of names over all that they hold.

    Not a labelled page, no rows. A word counts for its own context only, and not for a tag that has names to blame.
    Names that the prior has beyond the article are judged by what they hold, not by where in an article they stand.
    """
    if len(page.marked) != 1:
        return
    first, last = page.marked[0], page.events[page.marked[0]][3]
    at, within, beyond = [], [0], [0]
    for i, context, n, named in page.runs():
        inner = first < i < last
        at.append(i)
        within.append(within[-1] + n * inner)
        beyond.append(beyond[-1] + n * (not inner))
        if not named:
            yield context, n * inner, n * (not inner)
    yield "beside", 0, beyond[-1]
    yield "", within[-1], beyond[-1]
    for i, (found, _) in page.names.items():
        if not page.events[i][4]:
            continue
        a, b = bisect_left(at, i), bisect_left(at, page.events[i][3])
        for word in {w for words in found for w in words}:
            if i <= first or word not in BEYOND:  # adverts and comments inside an article don't belong to it
                yield f".{word}", within[b] - within[a], beyond[b] - beyond[a]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    within, beyond = Counter(), Counter()
    for batch in batches:
        for source in texts(batch, "html"):
            for feature, a, b in tally(Page(source)):
                within[feature] += a
                beyond[feature] += b
    found = sorted({*within, *beyond})
    yield pa.RecordBatch.from_pydict({"feature": pa.array(found, pa.string()), "within": pa.array([within[x] for x in found], pa.int64()), "beyond": pa.array([beyond[x] for x in found], pa.int64())})


def learn(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Weights from words within and beyond: log-odds against the pages' own, bounded; name words start from their prior."""
    a, b = counts.get("", (0, 0))
    share = (a + 0.5) / (a + b + 1)
    out = {}
    for feature in {*counts, *(f".{w}" for w in BEYOND | WITHIN), ">a"} - {""}:
        x, y = counts.get(feature, (0, 0))
        if feature == ">a" or feature.startswith("."):
            x, y = x + PRIOR * (feature[1:] in WITHIN) + 1, y + PRIOR * (feature == ">a" or feature[1:] in BEYOND) + 1
            odds = math.log(x / y)
        else:
            odds = math.log((x + share) / share) - math.log((y + 1 - share) / (1 - share))
        out[feature] = max(-BOUND, min(BOUND, odds))
    return out


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", limit: int = FIT_PAGES) -> dict[str, float]:
    """Weights from labelled pages, those with exactly one article or main element.

    Of all pages the ``limit`` with the smallest hash of their id are looked at (repeated ids: all their rows); null ids
    are not. The driver receives FEATURES rows at most, one per tag or name word of those pages. No labelled page, an
    empty table: the prior alone.
    """
    prepare(pages.sparkSession)
    chosen = smallest_hashes(pages.select(F.col(id_col).alias("k")).where("k IS NOT NULL").distinct(), limit)
    sample = pages.select(F.col(id_col).alias("k"), F.col(html_col).cast("string").alias("html")).join(F.broadcast(chosen), "k").select("html")
    rows = sample.mapInArrow(_tally, "feature string, within long, beyond long").groupBy("feature").agg(F.sum("within").alias("within"), F.sum("beyond").alias("beyond"))
    return learn({r.feature: (r.within, r.beyond) for r in rows.orderBy(F.desc(F.col("within") + F.col("beyond")), "feature").limit(FEATURES).collect()})


def extract(pages: DataFrame, weights: dict[str, float], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page's main text.

    The best contiguous region wins, the first of equal ones; what is hidden, what HTML has for menus, footers, asides,
    forms, scripts and the like, and what is named by words that labelled pages have beyond their article is left out of
    it. Null html and pages without words give the empty text; the whole html is read; repeated rows give equal texts;
    an empty table gives no rows; other columns are ignored.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Page(source).best(weights) for source in texts(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    return own.mapInArrow(run, own.drop("html").schema.add("text", "string").add("n_chars", "long"))
