"""HTML main-text extraction by a maximum-scoring subsequence.

A page is a sequence of words and tags. A word scores one. A tag scores below nothing:
by how often elements with its name, class, id or role stand outside the article of
labelled pages, and by whether it opens or closes the article itself. Words in an
element that labelled pages have outside their article score nothing, and those outside
an element that is the article nearly nothing; before and after what holds most of the page
they count against the run. One linear scan then finds the contiguous run of the highest
sum; that run, less the elements outside that stand within it, is the main text.

Pages label themselves: the text of the one article element a page has (else of its main
element) is content; what stands outside it, or inside it in an element that its markup
names as no content (nav, aside, class="ad", ...), is not. A bounded sample of such pages
is enough. Names that the sample lacks have the weight of PRIOR pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages whose markup is counted, about: those whose hash falls in the share that makes up so many.
TRAIN_PAGES = 1000
#: Score taken by a tag of an element that always stands outside the article, and by any tag at all.
PENALTY, LEAST = 12.0, 1e-4
#: Pages that the fixed lists below count as; share of elements outside for names that neither lists nor pages have.
PRIOR, UNKNOWN = 4.0, 0.15
#: What stands between the blocks of the smallest element that holds more than this share of the words left does not part them.
MOST = 0.5

# Element names by their role.
_RAW = frozenset("script style template noscript iframe svg math object canvas select textarea title".split())
_OUTER = frozenset("nav header footer aside form button dialog menu label fieldset head".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ROLE = re.compile(r"ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|gdpr|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pagination|popup|promo\w*|related|replies|respond|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget", re.I)
#: Words that leave a role what it is; with any other word (post-header, no-sidebar) a name is no role.
_BESIDE = frozenset("area bar block bottom box button buttons center container content feed form global inner item items left links list main mobile outer panel primary right row secondary section site slot sticky thread top unit wrap wrapper".split())
_DISCUSSION = re.compile(r"comments?|disqus|replies|respond", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
_UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)

#: (share outside the article, share that is the article) by feature: a name, .token, @role.
Scores = dict[str, tuple[float, float]]


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """('text', '', decoded text), ('open', name, attributes) and ('close', name, '') in page order; raw-text elements give no text.

    Linear in the page: quoted attributes are looked through at most a few times the
    page's length in vain, then a tag ends at the next >.
    """
    decoded = html.unescape if "&" in page else str
    at = begin = 0
    last, wasted, unclosed = page.rfind(">"), 0, set()
    while 0 <= (at := page.find("<", at)):
        m, name, following = None, "", page[at + 1 : at + 2]
        if following in ("!", "?"):
            start, stop = ("<!--", "-->") if page.startswith("<!--", at) else ("<![CDATA[", "]]>") if page.startswith("<![CDATA[", at) else ("<", ">")
            end = page.find(stop, at + len(start))
            end = len(page) if end < 0 else end + len(stop)
        elif at < last and (following.isalpha() or following == "/"):
            if wasted <= 4 * len(page):
                m = _TAG.match(page, at)
                wasted += 0 if m else len(page) - at
            m = m or _PLAIN_TAG.match(page, at)
            end = m.end() if m else 0
        if not m and following not in ("!", "?"):
            at += 1
            continue
        if at > begin:
            yield "text", "", decoded(page[begin:at])
        at = begin = end
        if not m:
            continue
        name, attributes = m[2].lower(), m[3]
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, attributes
        if name in _RAW and not attributes.endswith("/"):
            close = None if name in unclosed else _END[name].search(page, at)
            if close:
                yield "close", name, ""
                at = begin = close.end()
            else:
                unclosed.add(name)
                if name in ("script", "style"):
                    begin = len(page)
                    break
        elif name in _VOID or attributes.endswith("/"):
            yield "close", name, ""
    if begin < len(page):
        yield "text", "", decoded(page[begin:])


def _roles(name: str) -> list[str]:
    """The roles that a class token, id or role names; post-header or no-sidebar name none."""
    parts = [x for x in re.split(r"[-_]+", name.lower()) if x]
    roles = [x for x in parts if _ROLE.fullmatch(x)]
    return roles if roles and all(x in _BESIDE or x.isdigit() or _ROLE.fullmatch(x) for x in parts) else []


def features(name: str, attributes: str) -> list[str]:
    """An element's features: its name; .x of each class token, id and role; @x of each role those name; @hidden."""
    found = [name]
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and _UNSEEN.search(value):
            found.append("@hidden")
        elif key in ("class", "id", "role"):
            for token in value.split():
                found.append("." + token.lower())
                found += ["@discussion" if _DISCUSSION.fullmatch(x) else f"@{x}" for x in _roles(token)]
    return found


def _sure(feature: str) -> bool:
    """Whether a feature says what an element is however much of the page it holds."""
    return feature in ("@hidden", "@discussion") or feature in _OUTER and feature != "form"


class Page:
    """A page's tokens, where each element ends, the words before each token, and the element that the markup calls the content."""

    def __init__(self, page: str):
        self.found = list(tokens(page))
        self.before, self.end, self.closed = [0], [len(self.found)] * len(self.found), [False] * len(self.found)
        opened: dict[str, list[int]] = {}
        outermost = Counter()
        for i, (kind, name, value) in enumerate(self.found):
            self.before.append(self.before[-1] + (len(value.split()) if kind == "text" else 0))
            if kind == "open":
                outermost[name] += not opened.get(name)
                opened.setdefault(name, []).append(i)
            elif kind == "close" and opened.get(name):
                start = opened[name].pop()
                self.end[start], self.closed[start] = i, True
        self.words = self.before[-1]
        self.region = next((x for x in ("article", "main") if outermost[x] == 1), "article" if outermost["article"] else "main" if outermost["main"] else "")
        self.labelled = outermost[self.region] == 1

        self.content = next((i for i, (kind, name, _) in enumerate(self.found) if kind == "open" and name == self.region), None)

    def around(self, i: int) -> bool:
        """Whether the element that token i opens holds the content's element or, on a page without one, all words there are: then it is no menu, advert or form, whatever its class says."""
        if self.content is not None:
            return i < self.content < self.end[i]
        return self.before[self.end[i]] - self.before[i] == self.words


def element_counts(page: Page, *, lists: bool = True) -> Iterator[tuple[str, str]]:
    """(feature, where) of the elements of a page that labels itself, where being inside, outside, region or around.

    Of elements outside within each other only the outermost counts, so a paragraph of a
    footer says nothing against paragraphs. A name counts where the element has no
    class, id or role. Without lists everything in the article is inside.
    """
    begin = page.content
    if begin is None or not page.labelled:
        return
    end, until = page.end[begin], 0
    for i, (kind, name, value) in enumerate(page.found):
        if kind != "open" or i < until or name in _RAW or name in _VOID or page.before[page.end[i]] == page.before[i]:
            continue
        of = [f for f in features(name, value) if lists or f[0] != "@"]
        where = "region" if i == begin else "around" if i < begin and page.end[i] >= end else "outside"
        if begin < i < end:
            named = [f for f in of if (f[0] == "@" or f in _OUTER and f != "header") and (_sure(f) or not page.around(i))]
            where = "outside" if lists and named and page.closed[i] else "inside"
        if where == "outside" and page.closed[i]:
            until = page.end[i]
        yield from ((f, where) for f in of if f != name or len(of) == 1)


def scores_of(counts: dict[str, Counter], *, lists: bool = True) -> Scores:
    """The shares of every counted feature, and of those that the lists name."""
    outer = {f: (PRIOR, 0.0, PRIOR) for f in (*_OUTER, "@hidden", "@discussion", *(f for f in counts if f[0] == "@"))}
    listed = outer | {f: (0.0, PRIOR, PRIOR) for f in ("article", "main")} if lists else {}
    scores = {"@": (1.0, 0.0)} if lists else {}
    for f in {*counts, *listed}:
        n, (out, region, weight) = counts.get(f, Counter()), listed.get(f, (UNKNOWN, 0.0, 1.0))
        scores[f] = (n["outside"] + out) / (n.total() + weight), (n["region"] + region) / (n.total() + weight)
    return scores


def best_run(words: list[float], penalties: list[float]) -> tuple[int, int]:
    """[first, last] block of the highest sum of what words score less the penalties of the tags between; (0, -1) if none scores."""
    best, here, start, span = 0.0, 0.0, 0, (0, -1)
    for i, (n, cost) in enumerate(zip(words, penalties, strict=True)):
        here -= cost
        if here <= 0:
            here, start = 0.0, i
        here += n
        if here > best:
            best, span = here, (start, i)
    return span


def _shares_of(of: list[str], scores: Scores, in_content: bool, small: bool) -> tuple[float, float]:
    """(share outside, share that is the content) of elements with these features, the largest of each.

    small: the element is not around() the content. In the content a name
    decides only if it is one of the outer ones, and names that nobody knows say nothing.
    """
    name, marked = of[0], any(f[0] == "." for f in of)
    unknown = (0.0, 0.0) if in_content else (UNKNOWN, 0.0)
    found = [(0.0, 0.0)]
    for f in of:
        if f == name and (name not in _OUTER and (in_content or marked) or name == "header" and in_content):
            continue
        outside, region = scores.get(f, scores.get("@", unknown) if f[0] == "@" else unknown)
        found.append((outside if small or _sure(f) else 0.0, region))
    return max(x for x, _ in found), max(x for _, x in found)


def scored_blocks(page: Page, scores: Scores, *, drop: bool = True) -> tuple[list[str], list[float], list[float]]:
    """The texts of a page's blocks, less the words of elements outside the content; what their words score, and what the tags before or in each take.

    A word scores one. Where a page has an element that is the content by its name or
    class, other words score as much less as labelled pages are sure of that. Words of
    elements outside score nothing within the content and minus one elsewhere. Without
    drop those words stay in the texts, so that the run alone decides.
    """
    texts: list[list[str]] = [[]]
    costs, within = [0.0], [False]
    certain = 0.0  # how sure labelled pages are of the content's element
    stack: list[tuple[str, bool, bool, bool]] = []  # name; outside the content; so for good; the content itself
    standing: Counter = Counter()
    regions = 0
    known: dict[tuple[str, str, bool, bool], tuple[float, float, bool]] = {}
    parting: list[tuple[int, int, float]] = []  # token, block, what an element outside the content takes
    against: list[tuple[int, int, int]] = []  # token, block, words of elements outside
    kept = [0] * (len(page.found) + 1)
    for at, (kind, name, value) in enumerate(page.found):
        if kind == "text":
            outside = bool(stack and stack[-1][1])
            if outside and not regions:
                against.append((at, len(costs) - 1, len(value.split())))
            if not outside:
                kept[at + 1] = len(value.split())
            if not outside or not drop:
                texts[-1].append(value)
            continue
        cost, keep = LEAST, len(stack)
        if kind == "close":
            if standing[name]:
                while stack[keep - 1][0] != name:
                    keep -= 1
                keep -= 1
        elif name == "p" and stack and stack[-1][0] == "p":
            keep -= 1
        elif name == page.region and stack and stack[-1][1] and not stack[-1][2]:
            # menus that are not closed in time end where the content begins
            keep = next(i for i, s in enumerate(stack) if s[1])
        for gone, _, _, own in stack[keep:]:
            standing[gone] -= 1
            if own:
                regions -= 1
                cost += PENALTY + page.words - page.before[at]
        del stack[keep:]
        own = False
        if kind == "open":
            outside, deep = stack[-1][1:3] if stack else (False, False)
            if not outside and name not in _VOID:
                element = name, value, regions > 0, not page.around(at)
                if element not in known:
                    of = features(name, value)
                    known[element] = *_shares_of(of, scores, *element[2:]), name in ("aside", "footer") or "@discussion" in of
                out, region, final = known[element]
                if page.region == name and not regions:
                    out, region = 0.0, scores.get(name, (0.0, 0.0))[1]
                own = region > 0.5 and not regions and page.region in ("", name)
                outside = out > 0.5 and (page.closed[at] or name in _RAW)
                deep = outside and final
                if not regions:
                    parting.append((at, len(costs) - (name not in _BLOCK and not own), PENALTY * out))
                if own:
                    cost += PENALTY + page.before[at]
                    regions += 1
                    certain = max(certain, region)
            standing[name] += 1
            stack.append((name, outside, deep, own))
        if name in _BLOCK or own:
            texts.append([])
            costs.append(0.0)
            within.append(regions > 0)
        elif name == "br":
            texts[-1].append(" ")
        costs[-1] += cost
    # within the smallest element that holds most of what is left, what stands between its blocks parts nothing, nor do the elements around it
    left = list(accumulate(kept))
    most = [i for i, (kind, name, _) in enumerate(page.found) if kind == "open" and name not in ("html", "body") and left[page.end[i]] - left[i] > MOST * left[-1]]
    begin, end = (most[-1], page.end[most[-1]]) if most else (0, 0)
    for at, block, cost in parting:
        costs[block] += 0.0 if begin < at < end or at <= begin and page.end[at] >= end else cost
    blocks = [" ".join("".join(t).split()) for t in texts]
    elsewhere = 1 - certain if any(t and w for t, w in zip(blocks, within, strict=True)) else 1.0
    words = [len(t.split()) * (1.0 if w else elsewhere) for t, w in zip(blocks, within, strict=True)]
    for at, block, n in against:
        words[block] -= (0 if begin < at < end else n) + (0 if drop else n * (1.0 if within[block] else elsewhere))
    return blocks, words, costs


def extract(page: str, scores: Scores, *, drop: bool = True, run: bool = True) -> str:
    """The main text: the blocks of the best run that have words, joined by an empty line. drop: see scored_blocks(); without run all blocks count."""
    texts, words, costs = scored_blocks(Page(page), scores, drop=drop)
    first, last = best_run(words, costs) if run else (0, len(texts))
    return "\n\n".join(t for t in texts[first : last + 1] if t)


def tag_scores(pages: DataFrame, *, train_pages: int = TRAIN_PAGES, lists: bool = True) -> Scores:
    """The shares of features, from those pages that label themselves among about train_pages chosen by their hash.

    The choice follows from page_id and html alone, so it is the same in every run.
    Features met fewer than three times are not learned.
    """
    share = min(1.0, train_pages / max(pages.count(), 1))
    key = F.pmod(F.xxhash64("page_id", "html"), F.lit(1 << 40))
    sample = pages.where(F.col("html").isNotNull() & (key < int(share * (1 << 40)))).select("html")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = Counter(x for batch in batches for page in batch.column(0).to_pylist() for x in element_counts(Page(page), lists=lists))
        yield pa.record_batch([pa.array([f for f, _ in n], pa.string()), pa.array([w for _, w in n], pa.string()), pa.array(n.values(), pa.int64())], names=["feature", "where", "n"])

    rows = sample.mapInArrow(count, "feature string, where string, n long").groupBy("feature").pivot("where", ["inside", "outside", "region", "around"]).agg(F.sum("n"))
    rows = rows.na.fill(0).where("inside + outside + region + around >= 3").collect()
    return scores_of({r["feature"]: Counter({w: r[w] for w in ("inside", "outside", "region", "around")}) for r in rows}, lists=lists)


def extract_main_text(pages: DataFrame, *, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """pages (page_id, url, html) -> (page_id, url, text, n_chars), a row a page.

    Character references are decoded, white space inside a block becomes one space,
    blocks are joined by an empty line in page order. Null and empty pages, and pages
    without words, give an empty text. Very long pages, and tags, quotes and comments
    that are never closed, take time in proportion to their length. Repeated rows are
    each extracted; other columns are ignored; an empty table gives none.
    """
    pages = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    scores = tag_scores(pages, train_pages=train_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page or "", scores) for page in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
