"""HTML extraction by the maximum-scoring subsequences of a page.

A page is read as a row of tokens: words, tags, and whole boilerplate elements
such as menus. Words score positive, tags and boilerplate negative, and one
linear scan finds all maximal runs of tokens, those that no longer and no
shorter run beats. The best of them is the content region. Where it lies in
``<article>`` or ``<main>``, the page says itself what its article is, and all
such elements are kept whole; elsewhere the runs that come near the best are.

A second pass leaves out blocks of the region that are adverts, reader
comments, notices and the like by a whole name of class, role or id, unless
nothing else is left. An article in a list of comments is a comment.

Weights come from labelled pages, those with exactly one ``<article>`` or
``<main>``: the weight of a token is how much likelier it is inside than
outside, as a logarithm, with its sign and size kept in bounds. A tag that no
labelled article holds weighs as its class, block or inline, does.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 2_000  # labelled pages the weights are taken from, at most
NEAR = 0.5  # of the best run's sum that another run of a page without article has at least
WORD, HINTED, OTHER = "word", "word:hint", "tag:other"
DROPPED = "word:dropped"  # of a block that is left out of an article
UNSEEN = {True: "tag:block", False: "tag:inline"}  # classes of tags
UNSEEN_LEAST = -2.0
WORD_BOUNDS = (0.05, 1.0)
TAG_BOUNDS = (-10.0, -0.02)
#: weights without labelled pages
PLAIN = {WORD: 1.0}
PLAIN_TAG = -1.0

# Names of HTML elements
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "title", "head"}
#: of these, text is code; of the others it is read as text where the end tag is missing
CODE = {"script", "style"}
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog"}
#: inside an article or main element these head or end a part of it
PARTS = {"header", "footer"}
CONTENT = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html",
    "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot",
    "th", "thead", "tr", "ul",
}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u",
    "var", "wbr",
}
KNOWN = BLOCK | INLINE | VOID | BOILERPLATE | RAW | CONTENT
#: roles that say what ``nav`` and ``form`` do
ROLES = {"menu", "navigation", "search", "toolbar"}
#: names of class, id or role that speak for boilerplate
HINTS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "contentinfo", "consent", "cookie", "cookies", "disqus", "footer", "menu", "nav", "navbar", "navigation",
    "newsletter", "notice", "popup", "promo", "related", "search", "share", "sharing", "sidebar", "social", "sponsor",
    "sponsored", "subscribe", "toolbar", "widget",
}
#: of these, names that are not enough to leave a block out
WEAK = {"banner", "widget"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
EDGES = {f"tag:{end}{name}" for name in CONTENT for end in ("", "/")}
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ENDS = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: a slash at the end that is not of a value without quotes
_CLOSED = re.compile(r"""(?:=\s*[^\s"'>]*)?/$""")
_PART = re.compile(r"[^A-Za-z0-9]+")


def attributes_of(given: str) -> dict[str, str]:
    """Names, in lower case, and values; the first of equal names counts."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(given):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def self_closed(attributes: str) -> bool:
    end = _CLOSED.search(attributes[-200:])
    return end is not None and not end.group().startswith("=")


def is_boilerplate(name: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element is boilerplate by its name or role."""
    if name in BOILERPLATE:
        return not (inside and name in PARTS)
    if name in CONTENT or name in ("body", "html") or not attributes:
        return False
    return not ROLES.isdisjoint(attributes.get("role", "").lower().split())


def hints(name: str, attributes: dict[str, str]) -> set[str]:
    """Words of a whole id, or of whole names of class or role, that say boilerplate: all words of such a name are hints."""
    if name in CONTENT or name in HEADINGS or name in ("body", "html"):
        return set()
    names = [*attributes.get("class", "").lower().split(), *attributes.get("role", "").lower().split()]
    names.append(attributes.get("id", "").strip().lower())
    parts = [{p for p in _PART.split(n) if p} for n in names]
    return set().union(*(p for p in parts if p and HINTS.issuperset(p)))


def maximal_runs(scores: list[float]) -> list[tuple[float, int, int]]:
    """(sum, start, end) of all maximal scoring runs, in order, in time linear in their number.

    A run from the stack absorbs a later one, and all between, if it begins
    lower (by the sum of all before) and the later one ends higher. Each run
    knows the last one that begins lower, so none is looked at twice.
    """
    runs: list[tuple[float, float, int, int, int]] = []  # sums before and after, start, end, the last that begins lower
    total = 0.0
    for i, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        low, start = before, i
        j = len(runs) - 1
        while True:
            while j >= 0 and runs[j][0] >= low:
                j = runs[j][4]
            if j < 0 or runs[j][1] >= total:
                break
            low, start, below = runs[j][0], runs[j][2], runs[j][4]
            del runs[j:]
            j = below
        if j >= len(runs):
            j = len(runs) - 1
        runs.append((low, total, start, i + 1, j))
    return [(high - low, start, end) for low, high, start, end, _ in runs]


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of tags; comments and declarations have no name.

    Linear: a ``<`` that begins nothing is text, an open comment or tag lasts
    to the end of the page, and quotes hold a ``>`` only where they are closed.
    """
    at, n = 0, len(page)
    quotes = {'"': True, "'": True}  # whether more of them are ahead
    while True:
        at = page.find("<", at)
        if at < 0:
            return
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = n if end < 0 else end + 3
            yield at, end, "", False, ""
            at = end
            continue
        closing = page.startswith("/", at + 1)
        name = _NAME.match(page, at + 1 + closing)
        if name is None:
            if page[at + 1 : at + 2] in ("!", "?", "/"):
                end = page.find(">", at)
                end = n if end < 0 else end + 1
                yield at, end, "", False, ""
                at = end
            else:
                at += 1
            continue
        end = name.end()
        while True:
            mark = _ENDS.search(page, end)
            if mark is None:
                end = n
                break
            end = mark.end()
            if mark.group() == ">":
                break
            if quotes[mark.group()] and page[: mark.start()][-1:] == "=":
                close = page.find(mark.group(), end)
                if close < 0:
                    quotes[mark.group()] = False
                else:
                    end = close + 1
        yield at, end, name.group().lower(), closing, page[name.end() : end - 1]
        at = end


class Page:
    """Tokens of a page: kind, words (0 but for text), text or None, whether it ends a block."""

    def __init__(self, page: str | None):
        self.tokens: list[tuple[str, int, str | None, bool]] = []
        self.inside: list[bool] = []  # in an article or main element
        self.left_out: list[bool] = []  # in a block that the second pass leaves out
        self.nested: list[bool] = []  # in an article that is in such a block
        page = page or ""
        # open elements, and depth of boilerplate, hints and blocks to leave out before each
        stack: list[tuple[str, int, int, int, bool]] = []
        opened: Counter[str] = Counter()
        open_ended: set[str] = set()  # raw elements without an end tag ahead
        depth = hinted = content = dropped = 0
        nested = False
        last = skip = 0
        for start, end, name, closing, attributes in tags(page):
            if start < skip:
                continue
            if start > last and not depth:
                self._text(page[last:start], content, hinted, dropped, nested)
            last = end
            if not name:
                continue
            if name in RAW and not closing:
                # to its end tag; without one, to the end of the page if the text is code
                if name in open_ended or name == "svg" and self_closed(attributes):
                    continue
                close = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, end)
                if close is None and name not in CODE:
                    open_ended.add(name)
                    continue
                stop = len(page) if close is None else page.find(">", close.start()) + 1
                skip = last = stop or len(page)
                continue
            if closing:
                if name not in VOID and opened[name]:
                    was_in_boilerplate = depth > 0
                    while True:
                        top, depth, hinted, dropped, nested = stack.pop()
                        opened[top] -= 1
                        content -= top in CONTENT
                        if top == name:
                            break
                    if was_in_boilerplate:
                        continue
                if not depth:
                    self._tag("/" + name, name, content)
                continue
            hint = False
            if name not in VOID:
                stack.append((name, depth, hinted, dropped, nested))
                opened[name] += 1
                read = attributes_of(attributes) if attributes else {}
                found = hints(name, read) if read and not depth else set()
                if name in CONTENT:
                    nested = nested or dropped > 0
                    depth = hinted = dropped = 0
                elif is_boilerplate(name, read, content > 0):
                    if not depth:
                        kind = "boilerplate:" + (name if name in BOILERPLATE else "hint")
                        self._add(kind, 0, None, name in BLOCK, content)
                    depth += 1
                elif found:
                    hint = not content
                    hinted += hint
                    dropped += not found <= WEAK
            if not depth:
                if hint:
                    self._add("boilerplate:hint", 0, None, name in BLOCK, content)
                else:
                    self._tag(name, name, content)
                content += name in CONTENT
        if len(page) > last and not depth:
            self._text(page[last:], content, hinted, dropped, nested)

    def _add(
        self, kind: str, words: int, text: str | None, ends: bool, content: int, left_out: bool = False, nested: bool = False
    ) -> None:
        self.tokens.append((kind, words, text, ends))
        self.inside.append(content > 0)
        self.left_out.append(left_out)
        self.nested.append(nested)

    def _text(self, raw: str, content: int, hinted: int, dropped: int, nested: bool) -> None:
        text = html.unescape(raw)
        kind = DROPPED if content and dropped else HINTED if hinted else WORD
        self._add(kind, len(text.split()), text, False, content, dropped > 0, nested)

    def _tag(self, shown: str, name: str, content: int) -> None:
        kind = f"tag:{shown}" if name in KNOWN else OTHER
        self._add(kind, 0, " " if name == "br" else None, name in BLOCK, content)

    def labelled(self) -> bool:
        return sum(kind in ("tag:article", "tag:main") for kind, *_ in self.tokens) == 1

    def counts(self) -> dict[str, list[int]]:
        found: dict[str, list[int]] = {}
        for (kind, words, _, _), inside in zip(self.tokens, self.inside):
            found.setdefault(kind, [0, 0])[0 if inside and kind not in EDGES else 1] += words if kind in (WORD, HINTED) else 1
        found.pop(DROPPED, None)
        return found

    def runs(self, weights: dict[str, float]) -> list[tuple[float, int, int]]:
        word, other = weights.get(WORD, 1.0), weights.get(OTHER, PLAIN_TAG)
        scores = []
        for kind, words, _, _ in self.tokens:
            if kind in weights:
                score = weights[kind]
            elif kind.startswith("tag:") and UNSEEN[True] in weights:
                score = weights[UNSEEN[kind[4:].lstrip("/") in BLOCK]]
            else:
                score = 0.0 if kind == DROPPED else word if kind == WORD else other
            scores.append(score * words if kind in (WORD, HINTED, DROPPED) else score)
        return maximal_runs(scores)

    def region(self, weights: dict[str, float]) -> tuple[int, int]:
        """Tokens of the largest sum, the end exclusive; the first of equals, and none without words."""
        runs = self.runs(weights)
        return max(runs, key=lambda r: r[0])[1:] if runs else (0, 0)

    def _chosen(self, weights: dict[str, float], all_words: bool) -> list[bool]:
        """Tokens whose text is kept."""
        runs = self.runs(weights)
        chosen = [False] * len(self.tokens)
        if not runs:
            return chosen
        best, first, past = max(runs, key=lambda r: r[0])
        drop = [False] * len(chosen) if all_words else self.left_out
        if any(self.inside[first:past]):
            own = any(
                inside and not out and not nested and words
                for inside, out, nested, (_, words, _, _) in zip(self.inside, drop, self.nested, self.tokens)
            )
            return [inside and not out and not (own and nested) for inside, out, nested in zip(self.inside, drop, self.nested)]
        for score, start, end in runs:
            if score >= NEAR * best:
                chosen[start:end] = [not out for out in drop[start:end]]
        return chosen

    def text(self, weights: dict[str, float]) -> str:
        blocks = self._blocks(self._chosen(weights, False))
        if not blocks:  # all words are hinted at: they are the page
            word = weights.get(WORD, 1.0)
            blocks = self._blocks(self._chosen({**weights, HINTED: word, DROPPED: word}, True))
        return "\n\n".join(blocks)

    def _blocks(self, chosen: list[bool]) -> list[str]:
        blocks, block = [], []
        for (_, _, text, ends), kept in zip(self.tokens, chosen):
            if ends:
                blocks.append("".join(block))
                block = []
            elif kept and text is not None:
                block.append(text)
        blocks.append("".join(block))
        return [b for b in (" ".join(b.split()) for b in blocks) if b]


def weights_of(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log of how much likelier a token is inside than outside, within bounds."""
    kinds = len(counts) + 1
    inside = sum(a for a, _ in counts.values()) + kinds
    outside = sum(b for _, b in counts.values()) + kinds
    if inside == kinds or outside == kinds:
        return dict(PLAIN)
    found = {OTHER: TAG_BOUNDS[0] / 10}
    classes = {name: [0, 0] for name in UNSEEN.values()}
    for kind, (a, b) in counts.items():
        if kind.startswith("tag:"):
            held = classes[UNSEEN[kind[4:].lstrip("/") in BLOCK]]
            held[0], held[1] = held[0] + a, held[1] + b
    for kind, (a, b) in [*classes.items(), *counts.items()]:
        low, high = WORD_BOUNDS if kind == WORD else (UNSEEN_LEAST, TAG_BOUNDS[1]) if kind in classes else TAG_BOUNDS
        found[kind] = min(high, max(low, math.log((a + 1) / inside) - math.log((b + 1) / outside)))
    for kind, (a, _) in counts.items():
        if kind.startswith("tag:") and not a and kind not in EDGES:
            found[kind] = found[UNSEEN[kind[4:].lstrip("/") in BLOCK]]
    return found


def fit(pages: DataFrame, key: str = "page_id", page: str = "html", sample: int = SAMPLE) -> dict[str, float]:
    """Weights from at most ``sample`` labelled pages, those of the smallest hashes of key and page.

    What is collected is a row for each kind of token, and these are names of
    HTML elements. Without labelled pages words count 1 and tags -1.
    """

    @F.arrow_udf("array<struct<kind: string, a: bigint, b: bigint>>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64())]))
        for given in batches:
            out = []
            for value in given:
                read = Page(value.as_py())
                found = read.counts() if read.labelled() else {}
                out.append([{"kind": k, "a": a, "b": b} for k, (a, b) in found.items()])
            yield pa.array(out, kind)

    given = pages.filter(F.col(page).rlike("(?i)<(article|main)[\\s>]"))
    order = F.xxhash64(F.col(key), F.col(page))
    # the hash of the last page taken; hashes that are equal are taken together
    last = given.select(order.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return dict(PLAIN)
    rows = given.filter(order <= last).select(F.explode(count(F.col(page))).alias("c"))
    rows = rows.groupBy("c.kind").agg(F.sum("c.a"), F.sum("c.b")).collect()
    return weights_of({k: (a, b) for k, a, b in rows})


def extract(pages: DataFrame, weights: dict[str, float], key: str = "page_id", page: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(key, *keep, text), one row for each page, repeated ones too.

    Character references are decoded, white space inside a block becomes one
    blank, and blocks are joined by two line breaks. A null, empty or wordless
    page has an empty text; the first of equally good regions decides. The
    whole page is read, in its task, in time linear in its length.
    """
    sent = pages.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for given in batches:
            yield pa.array([Page(v.as_py()).text(sent.value) for v in given], pa.string())

    return pages.select(F.col(key), *keep, texts(F.col(page)).alias("text"))
