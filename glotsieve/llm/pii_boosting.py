"""Personal data by boosted trees over candidate spans, in column expressions only.

Patterns with a check (Luhn, range of parts, number of digits) give the base
spans, and these always stay. Generators of high recall propose more spans,
which may overlap: numbers of any shape as card, phone or address, and
anything like an address around an at sign. Each candidate is described by
its format and its context in a few small classes. What makes a span one of the
base is hidden from the description: a leading plus, and whether an address is
written with an at sign or with ``(at)`` and ``(dot)``. So base spans stand for
what they are without these marks, and words that announce a number or an
address speak for it as well, see ``targets``. Boosted trees learn from all
candidates of the table which descriptions go with personal data, and a
threshold for each kind, calibrated on the other half of the texts, selects
further spans that the checks miss: national numbers, spelled-out addresses,
mistyped cards.

What training gathers is one row for each description met, whose number is
bounded by the product of the classes, whatever the size of the table.
Finding and scoring never leave the row of a text: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotsieve.llm.common import kept

KINDS = ("email", "ip", "card", "phone")
ROUNDS, DEPTH, RATE = 30, 3, 0.3
PRECISION = 0.98  # of the spans a threshold selects, on the calibration half

#: marks around matches; a text's own are exchanged for a character no pattern knows
MARK, SPARE = "\ue000", "\ue001"
GROUP = 128  # values summed together, an even number
_SPAN = "array<struct<start: bigint, end: bigint, span: string, before: string, after: string>>"

_LOCAL = "[A-Za-z0-9._%+-]"
#: A match begins where a run begins, or where the last match ended, and runs are never given
#: back: the same matches as the plain patterns have, in time linear in the text.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
IP_CHECK = rf"^{_PART}(?:\.{_PART}){{3}}$"
#: what the generators propose: numbers, and words around an at sign
NUMBER = r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])++"
AT = r"(?:\G|(?<![\w.%+-]))[\w.%+-]++\s?(?:@|\(at\)|\[at\])\s?[\w-]++(?:(?:\s?(?:\(dot\)|\[dot\])\s?|\s\.\s|\.)[\w-]++)*+"

#: (name, number of classes) of a description
CLASSES = (
    ("kind", 4), ("size", 8), ("groups", 4), ("marks", 4), ("gaps", 4), ("left", 4), ("right", 3), ("context", 5),
)
CONTEXTS = (
    r"(?i)(?<!\p{L})(?:tel|phone|call|fax|mobile|cell|whatsapp)[^0-9]{0,12}$",
    r"(?i)(?<!\p{L})(?:e?mail|contact|write|reach)[^0-9]{0,12}$",
    r"(?i)(?<!\p{L})(?:card|visa|credit|payment|account|iban)[^0-9]{0,12}$",
    r"(?i)(?:token|version|id|no|nr|key|order|invoice|date|=|#|\")[^0-9]{0,4}$",
)
#: the last context, where nothing but such a word stands between a number and the words before
NAMED = r"(?i)(?<!\p{L})(?:token|version|id|key|order|invoice|date)(?:\s(?:no|nr|number|id))?[^0-9\p{L}]{0,4}$"
#: days and ranges of years
_YEAR, _MONTH, _DAY = "(?:19|20)[0-9]{2}", "(?:0?[1-9]|1[0-2])", "(?:0?[1-9]|[12][0-9]|3[01])"
DATE = (
    rf"^(?:{_YEAR}[ .-]{{1,2}}{_MONTH}[ .-]{{1,2}}{_DAY}|(?:{_DAY}[ .-]{{1,2}}{_MONTH}|{_MONTH}[ .-]{{1,2}}{_DAY})[ .-]{{1,2}}{_YEAR})(?:[ .-]{{1,2}}[0-9]{{1,2}})?$"
    rf"|^{_YEAR}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])$|^{_YEAR} ?- ?{_YEAR}$"
)
FULL = rf"^{_LOCAL}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}}$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.transform(F.array(value), use)[0]


def running_sums(values: Column) -> Column:
    """Sum of all values before each one. Values are taken in groups, so the cost stays near linear."""
    none = F.array().cast("array<bigint>")

    def sums(of: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))
        step = lambda s, v: F.struct((s["at"] + v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(of, start, step, lambda s: s["out"])

    starts = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(GROUP))
    groups = F.transform(starts, lambda i: F.slice(values, i + 1, F.lit(GROUP)))

    def add(group: Column) -> Column:
        return F.aggregate(group, F.lit(0).cast("bigint"), lambda total, v: total + v)

    def joined(groups: Column) -> Column:
        return let(
            sums(F.transform(groups, add)),
            lambda before: F.flatten(
                F.transform(groups, lambda g, i: F.transform(sums(g), lambda s: s + F.get(before, i)))
            ),
        )

    return let(groups, joined)


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern, with their place in code points and what stands around them.

    Marks are put around the matches and the text is cut at the marks, so every
    second part is a match and lengths add up to places.
    """
    marked = F.regexp_replace(F.translate(text, MARK, SPARE), pattern, f"{MARK}$0{MARK}")

    def gather(parts: Column) -> Column:
        numbers = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i % 2 == 1)

        def found(starts: Column) -> Column:
            return F.transform(
                numbers,
                lambda i: F.struct(
                    F.get(starts, i).alias("start"),
                    (F.get(starts, i) + F.length(F.get(parts, i))).alias("end"),
                    F.get(parts, i).alias("span"),
                    F.right(F.get(parts, i - 1), F.lit(24)).alias("before"),
                    F.left(F.get(parts, i + 1), F.lit(2)).alias("after"),
                ),
            )

        lengths = F.transform(parts, lambda p: F.length(p).cast("bigint"))
        return let(let(lengths, running_sums), found)

    return let(F.split(marked, MARK), gather)


def digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(number, F.length(number) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, span: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return span.rlike(IP_CHECK)
    if kind == "card":
        return let(digits(span), lambda d: F.length(d).between(13, 19) & F.when(F.length(d) <= 19, luhn(d)))
    return F.length(digits(span)).between(9, 15)


def base_spans(text: Column, kind: str) -> Column:
    """Spans of one kind that match its pattern and pass its check."""
    sign = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))
    found = F.filter(matches(text, PATTERNS[kind]), lambda s: F.coalesce(_valid(kind, s["span"]), F.lit(False)))
    return F.when(sign, found).otherwise(F.array().cast(_SPAN))


def _cut(value: Column, borders: tuple[int, ...]) -> Column:
    """Number of borders at or below a value."""
    out = F.lit(0)
    for i, border in enumerate(borders):
        out = F.when(value >= border, i + 1).otherwise(out)
    return out


def describe(kind: Column, s: Column) -> Column:
    """Classes of a candidate: format of the span, character on each side, words before.

    Addresses are described as if written with an at sign and dots, numbers as
    if without a plus. ``marks`` tell addresses in full, and dates (1) and
    numbers with a bracket (2).
    """
    before, after = s["before"], s["after"]
    is_email = kind == 0
    signs = F.regexp_replace(s["span"], r"\s?[(\[]at[)\]]\s?", "@")
    span = F.when(is_email, F.regexp_replace(signs, r"\s?[(\[]dot[)\]]\s?", ".")).otherwise(s["span"])
    n = F.length(digits(span))
    size = F.when(is_email, _cut(F.length(span), (6, 9, 12, 16, 24, 40, 64))).otherwise(
        _cut(n, (7, 9, 12, 13, 16, 17, 20))
    )
    parts = F.length(F.regexp_replace(span, "[^ ().-]", ""))
    marks = F.when(is_email, F.when(span.rlike(FULL), 1).otherwise(0)).otherwise(
        F.when(span.rlike(DATE), 1).otherwise(0) + F.when(span.contains("("), 2).otherwise(0)
    )
    gaps = (
        F.when(span.contains(" ") & ~span.contains("."), 1)
        .when(span.contains("-") & ~span.contains("."), 2)
        .when(span.contains("."), 3)
        .otherwise(0)
    )
    left = (
        F.when(before == "", 0).when(before.rlike(r"\s$"), 1).when(before.rlike(r"[\p{L}\p{N}]$"), 2).otherwise(3)
    )
    right = F.when((after == "") | after.rlike(r"^(?:\s|[.,;:!?](?:\s|$))"), 0).when(after.rlike(r"^[\p{L}\p{N}]"), 1).otherwise(2)
    context = F.lit(0)
    for i, words in reversed(list(enumerate(CONTEXTS))):
        context = F.when(before.rlike(words), i + 1).otherwise(context)
    context = F.when(~is_email & before.rlike(NAMED), len(CONTEXTS)).otherwise(context)
    values = (kind, size, _cut(parts, (1, 3, 6)), marks, gaps, left, right, context)
    return F.struct(*[v.cast("int").alias(name) for v, (name, _) in zip(values, CLASSES)])


def _described(kind: int) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"], s["end"], describe(F.lit(kind), s).alias("d"))


def _of_kind(kind: int) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"], s["end"])


def candidates(text: Column) -> Column:
    """Candidates of all generators, described; a number may stand as several kinds."""

    def numbers(found: Column) -> Column:
        n = lambda s: F.length(digits(s["span"]))
        quad = F.filter(found, lambda s: s["span"].rlike(r"^[0-9]+(?:\.[0-9]+){3}$"))
        card = F.filter(found, lambda s: n(s).between(12, 19))
        phone = F.filter(found, lambda s: n(s).between(7, 15))
        return F.concat(*[F.transform(part, _described(k)) for k, part in ((1, quad), (2, card), (3, phone))])

    some = F.array().cast("array<struct<start: bigint, end: bigint, d: struct<%s>>>" % ", ".join(f"{n}: int" for n, _ in CLASSES))
    ats = F.transform(matches(text, AT), _described(0))
    return F.concat(
        F.when(text.rlike("@|[(\\[]at[)\\]]"), ats).otherwise(some),
        F.when(text.rlike("[0-9]"), let(matches(text, NUMBER), numbers)).otherwise(some),
    )


@dataclass
class Boosted:
    """Trees over descriptions, and the least score of each kind that is selected."""

    bias: float = 0.0
    trees: list = field(default_factory=list)  # (class, border, below, from the border on) or a number
    least: dict[int, float] = field(default_factory=dict)

    def values(self, x: np.ndarray) -> np.ndarray:
        def of(tree, rows):
            if not isinstance(tree, tuple):
                return np.full(len(rows), tree)
            j, border, low, high = tree
            return np.where(rows[:, j] < border, of(low, rows), of(high, rows))

        return self.bias + sum((of(t, x) for t in self.trees), np.zeros(len(x)))

    def column(self, d: Column) -> Column:
        def of(tree):
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            j, border, low, high = tree
            return F.when(d[CLASSES[j][0]] < border, of(low)).otherwise(of(high))

        out = F.lit(float(self.bias))
        for tree in self.trees:
            out = out + of(tree)
        return out

    def selected(self, d: Column) -> Column:
        """Whether the score of a description reaches the threshold of its kind."""
        if not self.least:
            return F.lit(False)
        least = F.lit(float("inf"))
        for kind, score in self.least.items():
            least = F.when(d["kind"] == kind, F.lit(float(score))).otherwise(least)
        return self.column(d) >= least


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree on gradients and curvatures, by the best gain at each node."""
    leaf = float(-RATE * g.sum() / (h.sum() + 1.0))
    if not depth or len(x) < 2:
        return leaf
    score = lambda a, b: a * a / (b + 1.0)
    best, cut = 1e-6, None
    for j, (_, n) in enumerate(CLASSES):
        gs, hs = np.bincount(x[:, j], g, n).cumsum(), np.bincount(x[:, j], h, n).cumsum()
        gain = score(gs[:-1], hs[:-1]) + score(gs[-1] - gs[:-1], hs[-1] - hs[:-1]) - score(gs[-1], hs[-1])
        k = int(gain.argmax())
        if gain[k] > best:
            best, cut = gain[k], (j, k + 1)
    if cut is None:
        return leaf
    low = x[:, cut[0]] < cut[1]
    if low.all() or not low.any():
        return leaf
    return (*cut, _tree(x[low], g[low], h[low], depth - 1), _tree(x[~low], g[~low], h[~low], depth - 1))


def boost(x: np.ndarray, good: np.ndarray, bad: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH) -> Boosted:
    """Trees for the log odds of ``good`` against ``bad`` counts of each description."""
    total = good + bad
    model = Boosted(bias=float(np.log((good.sum() + 1) / (bad.sum() + 1))))
    value = np.full(len(x), model.bias)
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-value))
        tree = _tree(x, total * p - good, total * p * (1 - p), depth)
        model.trees.append(tree)
        value = value + Boosted(trees=[tree]).values(x)
    return model


def calibrate(model: Boosted, x: np.ndarray, good: np.ndarray, bad: np.ndarray, precision: float = PRECISION) -> None:
    """The lowest threshold of each kind above which counts keep the precision, however few they are.

    A kind without such a threshold, or without candidates, has none.
    """
    value = model.values(x)
    for kind in range(len(KINDS)):
        of = np.flatnonzero(x[:, 0] == kind)
        of = of[np.argsort(-value[of], kind="stable")]
        a, n = good[of].cumsum(), (good[of] + bad[of]).cumsum()
        # descriptions of one score are selected together
        last = np.append(value[of][1:] < value[of][:-1] - 1e-9, True)[: len(of)]
        fits = np.flatnonzero(last & (n > 0) & (a >= precision * n))
        if len(fits):
            model.least[kind] = float(value[of][fits[-1]]) - 1e-9  # sums in another order may differ by less


def targets(x: np.ndarray, base: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Good and bad counts of each description, from those of base spans and of other candidates.

    Base spans are good. So are other candidates that words announce as what
    they are: phones that are no dates, cards of 13 to 19 digits, addresses in
    full. Addresses in full and phones with a bracket that nothing announces
    may be either and do not count; all else is bad.
    """
    of = {name: x[:, i] for i, (name, _) in enumerate(CLASSES)}
    kind, marks, context = of["kind"], of["marks"], of["context"]
    full = (kind == 0) & (marks == 1)
    card = (kind == 2) & (of["size"] >= 3) & (of["size"] <= 6) & (marks % 2 == 0)
    phone = (kind == 3) & (marks % 2 == 0)
    good = full & (context == 2) | card & (context == 3) | phone & (context == 1)
    open_ = ~good & (full | phone & (marks == 2) & (context < 3))
    return base + np.where(good, other, 0), np.where(good | open_, 0, other)


def fit(docs: DataFrame, text: str = "text", precision: float = PRECISION) -> Boosted:
    """Trees and thresholds from all candidates of a table.

    Candidates are counted by description, apart if they are base spans of
    their kind; ``targets`` says which are good. Trees come from the texts of
    one half of the hash range, thresholds from the other.
    The grouped counts are collected: 122,880 descriptions at most by half.
    """
    given = F.coalesce(F.col(text), F.lit(""))
    base = F.array(*[F.transform(base_spans(given, k), lambda s: F.struct(s["start"], s["end"])) for k in KINDS])
    rows = docs.filter(F.col(text).rlike("[0-9@]|[(\\[]at[)\\]]")).select(
        (F.pmod(F.xxhash64(given), F.lit(2)) == 0).alias("half"), base.alias("base"), candidates(given).alias("c")
    )
    marked = F.transform(
        "c",
        lambda c: F.struct(
            c["d"].alias("d"),
            F.exists(F.get(F.col("base"), c["d"]["kind"]), lambda b: (b["start"] == c["start"]) & (b["end"] == c["end"])).alias("base"),
        ),
    )
    rows = rows.select("half", F.inline(marked))
    counts = rows.groupBy("half", *[f"d.{n}" for n, _ in CLASSES]).agg(
        F.count_if("base").alias("n_base"), F.count_if(~F.col("base")).alias("n_other")
    )
    found = np.array([tuple(int(v) for v in r) for r in counts.collect()], np.int64).reshape(-1, len(CLASSES) + 3)
    found = found[np.lexsort(found.T[::-1])]
    x = found[:, 1:-2]
    good, bad = targets(x, found[:, -2].astype(float), found[:, -1].astype(float))
    learn = found[:, 0] == 1
    model = boost(x[learn], good[learn], bad[learn])
    calibrate(model, x[~learn], good[~learn], bad[~learn], precision)
    return model


_OUT = "array<struct<kind: int, start: bigint, end: bigint>>"


def personal_data(docs: DataFrame, model: Boosted, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, base, spans), one row for each row of ``docs``.

    ``base`` and ``spans`` are arrays of (kind, start, end) in the order of
    kind and start; kinds count from 0 as in ``KINDS``, places are in code
    points and the end is exclusive. ``spans`` holds the base spans and the
    candidates selected that overlap none of them, the longest first of those
    that begin together and the first of those that overlap. A null text is an
    empty one and has no spans. Repeated rows have equal spans. A ``keep``
    column named ``base`` or ``spans`` comes back with ``kept_`` before it.
    """
    given = F.coalesce(F.col(text), F.lit(""))
    base = F.flatten(F.array(*[F.transform(base_spans(given, k), _of_kind(i)) for i, k in enumerate(KINDS)])).cast(_OUT)
    chosen = F.filter(candidates(given), lambda c: model.selected(c["d"]))
    more = F.transform(chosen, lambda c: F.struct(c["start"], (-c["end"]).alias("less"), c["d"]["kind"].alias("kind")))
    carried = F.struct(F.col(key), *kept(keep, ("base", "spans")))
    rows = docs.select(carried.alias("_row"), base.alias("_base"), F.array_sort(more).alias("_more"))

    def add(out: Column, c: Column) -> Column:
        span = F.struct(c["kind"], c["start"], (-c["less"]).alias("end"))
        free = ~F.exists(out, lambda s: (s["start"] < -c["less"]) & (c["start"] < s["end"]))
        return F.when(free, F.concat(out, F.array(span))).otherwise(out)

    spans = F.when(F.size("_more") == 0, F.col("_base")).otherwise(F.aggregate("_more", F.col("_base"), add))
    return rows.select("_row.*", F.col("_base").alias("base"), F.array_sort(spans).alias("spans"))


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count_of(spans: Column, kind: str) -> Column:
    """Number of spans of one kind."""
    number = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("bigint")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of spans that overlap, the whole range."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))

    def step(state: Column, s: Column) -> Column:
        apart = s["start"] >= state["at"]
        gap = F.substr(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(apart, F.concat(state["out"], gap, F.get(names, s["kind"]))).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    rest = lambda state: F.concat(state["out"], F.substr(text, (state["at"] + 1).cast("int")))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(ordered, start, step, rest))
