"""Personal data: candidates from loose generators, chosen by boosted trees on format and context.

Base spans are those of four fixed patterns.  Loose generators propose further, overlapping spans of
the same kinds: addresses with spelled-out signs, dotted numbers in brackets, card-like and
phone-like digit groups.  Boosted regression trees (logistic loss) tell loose personal data from
other numbers and words.  Nobody labels them, so the texts' own base spans do: each is rewritten in
its place into a loose form that no base rule finds (a positive), and a number that is none of that
kind (order number, version, date, price) is put elsewhere in the same text (a negative).  Candidates
whose value cannot be of their kind are negatives too, at their own frequency; the other candidates
are not labelled and teach nothing, as do those that a base rule confirms.

All examples of all texts teach: the trees grow on the binned table of ``operators.boosting``, bins are cut at exact quantiles,
and the threshold comes from the running totals of every held-out score.

Scores are calibrated on held-out examples, none of them a base span; per kind the lowest threshold
whose precision reaches PRECISION selects, counting as many loose forms as base spans against all
negatives.  A kind without base spans to learn from, or whose held-out scores never reach it, adds
nothing.  Chosen spans that overlap a base span, or a better chosen one, are dropped; base spans
always stay.

Offsets count code points; ends are exclusive.  Null text reads as empty: no spans.  A text of any
length is read whole, and each pattern in time linear in it.  Without any candidate to learn from,
only base spans are found.  The result is a column: repeated rows, ties and other columns do not matter.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.llm.common import by_slices, row_slices, utf8
from screenloom.operators.boosting import Binned, BoostedModel, Setting, fit_all
from screenloom.operators.running import running_totals
from screenloom.session import stored

KINDS = ("email", "ip", "card", "phone")
TREES = 30
DEPTH = 3
BINS = 16
RATE = 0.3
MIN_LEAF = 20
#: Least hessian of a leaf of the trees that learn from all examples.
LEAST_HESSIAN = 1.0
PRECISION = 0.98
#: Held-out examples a threshold must rest on.
MIN_SUPPORT = 50
#: Characters before and after a candidate that its features see.
AROUND = 24
#: Characters around a rewritten span that are read again.
WINDOW = 96

# The patterns of the base spans.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Loose generators: the sign of an address with what follows it, and digit groups by kind.
_SIGN = re.compile(
    r"(?: ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?)[A-Za-z0-9-]{1,63}){1,4}"
    r"| at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{1,63}){1,4})"
)
_LOOSE = {
    "ip": re.compile(r"[0-9]{1,4}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,4}){3}"),
    "card": re.compile(r"[0-9]{3,6}(?:[\x20.-]?[0-9]{2,6}){2,5}"),
    "phone": re.compile(r"(?:\+|00|\()?[0-9]{1,4}\)?(?:[\x20./-]{0,2}\(?[0-9]{2,5}\)?){2,5}"),
}
#: Longest local part that a loose address takes.
_LONGEST_LOCAL = 64
_DIGIT = re.compile("[0-9]")
_CUES = {
    "email": ("mail", "contact", "write", "reply"),
    "ip": ("ip", "host", "server", "addr", "login"),
    "card": ("card", "visa", "pay", "credit", "account"),
    "phone": ("phone", "tel", "call", "fax", "mobile"),
}
#: Words beside numbers that are no personal data.
_OTHER_CUES = ("order", "invoice", "version", "release", "isbn", "serial", "part no", "ref", "dated", "ticket", "units")
_AT = re.compile(r" ?(?:@|\(at\)|\[at\]) ?| at ")
_DOT = re.compile(r" ?(?:\(dot\)|\[dot\]) ?| dot ")
_DATE = re.compile(r"(?:19|20)[0-9]{2}([-./\x20]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])(?![0-9])")
#: Spelled-out signs of addresses.
_SPELLED = ((" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" at ", " dot "), (" (at) ", "."), (" @ ", "."))
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ backwards over the local part: linear, and the same as matching from the left."""
    done = 0
    at = text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _LOCAL:
            first -= 1
        if first < at and (m := _DOMAIN.match(text, at)):
            yield first, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Base spans, by start and then kind."""
    found: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = re.sub("[ -]", "", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[Span]:
    """Overlapping spans of the loose generators."""
    found: list[Span] = []
    if "@" in text or "at)" in text or "at]" in text or " dot " in text:
        for m in _SIGN.finditer(text):
            first = m.start()
            while first > 0 and m.start() - first < _LONGEST_LOCAL and text[first - 1] in _LOCAL:
                first -= 1
            if first < m.start():
                found.append(("email", first, m.end()))
    if _DIGIT.search(text):
        for kind, pattern in _LOOSE.items():
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
    return found


class Cover:
    """Disjoint ranges of a text, kept in order."""

    def __init__(self, ranges: Iterable[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(ranges):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k > 0 and self.ends[k - 1] > a

    def add(self, a: int, b: int) -> None:
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def restored(kind: str, body: str) -> str:
    """A candidate in the form that the base rule of its kind reads."""
    if kind == "email":
        return _DOT.sub(".", _AT.sub("@", body, count=1))
    if kind == "ip":
        return re.sub(r"[\[\]()]", "", body)
    digits = "".join(re.findall("[0-9]+", body))
    return digits if kind == "card" else "+" + digits.removeprefix("00")


def plausible(kind: str, body: str) -> bool:
    """Whether the value, in whatever form, can be of its kind."""
    plain = restored(kind, body)
    if kind == "email":
        return plain.rsplit(".", 1)[-1].isalpha() and len(plain.rsplit(".", 1)[-1]) > 1 and plain.count("@") == 1
    if kind == "ip":
        return all(int(p) <= 255 for p in plain.split("."))
    if kind == "card":
        return 14 <= len(plain) <= 19 and luhn(plain)
    return 10 <= len(plain) - 1 <= 15


def foreign(text: str, span: Span) -> bool:
    """Whether a candidate is surely none of its kind: by its value, or a date, or a named or bare number."""
    kind, a, b = span
    body = text[a:b]
    if not plausible(kind, body):
        return True
    if kind != "phone":
        return False
    before = text[max(0, a - AROUND) : a].lower()
    called = any(x in before for x in _CUES[kind])
    return bool(_DATE.match(body)) or not called and (body.isdigit() or any(x in before for x in _OTHER_CUES))


def loosened(kind: str, body: str, h: int) -> str:
    """A base span in a form that the base rules do not find; ``h`` chooses among them."""
    if kind == "email":
        local, domain = body.split("@")
        at, dot = _SPELLED[h % len(_SPELLED)]
        return local + at + domain.replace(".", dot)
    if kind == "ip":
        return body.replace(".", ("[.]", "(.)")[h % 2])
    if kind == "card":
        digits = restored(kind, body)
        return ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return ("", "00")[h % 2] + body[1:]


def other(kind: str, h: int) -> str:
    """Words and numbers that look like the kind and are not."""
    n = [h >> k & 0xFFF for k in range(0, 60, 6)]
    long = f"{h % 10**12:012d}"
    if kind == "email":
        return (f"boxes @ {n[0] % 90 + 1}.{n[1] % 90 + 10} each", f"look at the dot {('product', 'matrix', 'above')[n[2] % 3]}", f"sold (at) {n[0] % 90}.{n[1] % 90 + 10} net", f"step at {n[0] % 9} dot {n[1] % 9}")[n[3] % 4]
    if kind == "ip":
        return f"{('version', 'release', 'v')[n[3] % 3]} {n[0] % 12 + 2015}{('.', '[.]')[n[4] % 2]}{n[1] % 30}.{n[2] % 300}.{n[5] % 20}"
    if kind == "card":
        digits = f"{h % 10**16:016d}"
        digits = digits[:-1] + str((int(digits[-1]) + luhn(digits)) % 10)
        return f"{('order', 'serial', 'ticket')[n[0] % 3]} {('', '.', '-', ' ')[n[1] % 4].join(digits[i : i + 4] for i in range(0, 16, 4))}"
    return (
        f"order {long[: n[1] % 3 + 10]}", f"invoice {long[:4]}-{long[4:8]}-{long[8:]}", f"isbn 978-{long[0]}-{long[1:3]}-{long[3:9]}-{long[9]}",
        f"dated {n[1] % 40 + 1990}-{n[2] % 12 + 1:02d}-{n[3] % 28 + 1:02d} {n[4] % 24:02d} {n[5] % 60:02d}", f"{long[:11]} units", f"part no {long[:3]} {long[3:6]} {long[6:10]}",
    )[n[0] % 6]


def examples(text: str, h: int) -> Iterator[tuple[str, bool, int, list[float]]]:
    """(kind, label, hash, features): foreign candidates as they stand, base spans rewritten, and other numbers put in."""
    base = base_spans(text)
    cover = Cover(s[1:] for s in base)
    for s in candidates(text):
        if not cover.meets(*s[1:]) and foreign(text, s):
            yield s[0], False, _mixed(h, s[1]), features(text, s)
    for kind, a, b in base:
        draw = _mixed(h, a)
        before, body = text[max(0, a - WINDOW) : a], loosened(kind, text[a:b], draw >> 8)
        seen = before + body + text[b : b + WINDOW]
        first, last = len(before), len(before) + len(body)
        known = Cover(s[1:] for s in base_spans(seen))
        for s in candidates(seen):
            if s[0] == kind and s[1] <= first and last <= s[2] <= last + 4 and first - s[1] <= 4 and not known.meets(*s[1:]):
                yield kind, True, draw, features(seen, s)
        gap = text.find(" ", draw % len(text))
        gap = len(text) if gap < 0 else gap
        before, body = text[max(0, gap - WINDOW) : gap] + " ", other(kind, draw)
        seen = before + body + text[gap : gap + WINDOW]
        first, last = len(before), len(before) + len(body)
        known = Cover(s[1:] for s in base_spans(seen))
        for s in candidates(seen):
            if s[0] == kind and s[1] < last and s[2] > first and not known.meets(*s[1:]):
                yield kind, False, _mixed(h, -a - 2), features(seen, s)


def _mixed(h: int, at: int) -> int:
    x = (h ^ (at + 1) * 0x9E3779B97F4A7C15) % (1 << 64)
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
    x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
    return (x ^ x >> 31) % (1 << 62)


def features(text: str, span: Span) -> list[float]:
    """Format, value and neighbourhood of a candidate."""
    kind, a, b = span
    body, before, after = text[a:b], text[max(0, a - AROUND) : a].lower(), text[b : b + AROUND].lower()
    digits = [c.isdigit() for c in body]
    n = sum(digits)
    runs = [len(x) for x in re.findall("[0-9]+", body)] or [0]
    plain = restored(kind, body)
    return [
        len(body),
        n,
        n / len(body),
        len(runs),
        max(runs),
        min(runs),
        sum(c.isalpha() for c in body),
        sum(c in " -" for c in body),
        sum(c in "()[]" for c in body),
        body.count("."),
        len(plain.rsplit(".", 1)[-1]),
        len(plain.split("@")[0]),
        plausible(kind, body),
        bool(_DATE.match(body)),
        _class(before[-1:]),
        _class(after[:1]),
        _class(before[-2:-1]),
        _class(after[1:2]),
        sum(before.count(x) for x in _CUES[kind]),
        sum(before.count(x) for x in _OTHER_CUES),
        sum(c.isdigit() for c in before),
        sum(c.isdigit() for c in after),
        sum(c.isalpha() for c in before),
        sum(c.isalpha() for c in after),
    ]


def _class(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in ".,;:!?" else 5


@dataclass
class Trees:
    """Boosted trees of one kind, complete to DEPTH: node k has the children 2k+1 and 2k+2."""

    start: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)
    threshold: float = np.inf

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        row = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        return total


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting on quantile bins."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    out = Trees(float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    total = np.full(len(y), out.start)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for k in range(2**DEPTH - 1):
            own = node == k
            best = 1e-6
            for f, e in enumerate(edges):
                if own.sum() < 2 * MIN_LEAF or not len(e):
                    continue
                gs = np.bincount(binned[own, f], g[own], len(e) + 1).cumsum()
                hs = np.bincount(binned[own, f], h[own], len(e) + 1).cumsum()
                ns = np.bincount(binned[own, f], minlength=len(e) + 1).cumsum()
                gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                gain[(ns[:-1] < MIN_LEAF) | (ns[-1] - ns[:-1] < MIN_LEAF)] = 0
                if gain.max() > best:
                    best, feature[k], cut[k] = gain.max(), f, e[gain.argmax()]
            node[own] = 2 * k + 1 + (x[own, feature[k]] > cut[k])
        at = node - len(feature)
        leaf = RATE * np.bincount(at, g, 2**DEPTH) / (np.bincount(at, h, 2**DEPTH) + 1)
        out.feature.append(feature)
        out.cut.append(cut)
        out.leaf.append(leaf)
        total += leaf[at]
    return out


def calibrated_threshold(margin: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    """Lowest margin above which the held-out precision, made monotone, reaches PRECISION."""
    order = np.argsort(-margin, kind="stable")
    weight = np.ones(len(y)) if weight is None else weight[order]
    precision = np.cumsum(y[order] * weight) / np.cumsum(weight)
    last = np.append(margin[order][1:] != margin[order][:-1], True)  # ties are taken together
    good = np.flatnonzero(last & (precision >= PRECISION) & (np.arange(1, len(y) + 1) >= MIN_SUPPORT))
    return float(margin[order][good[-1]]) if len(good) else np.inf


def completed(model: BoostedModel) -> Trees:
    """The same trees in complete form: a leaf above the last level goes left, down to its value."""
    out = Trees()
    for feature, threshold, value in zip(model.feature, model.threshold, model.value, strict=True):
        kind, cut, value = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf), value.copy()
        split = np.zeros(2 << DEPTH, bool)
        split[1] = True
        for node in range(1, 2**DEPTH):
            if split[node] and feature[node] >= 0:
                kind[node - 1], cut[node - 1] = feature[node], threshold[node]
                split[[2 * node, 2 * node + 1]] = True
            else:
                value[2 * node] = value[node]
        out.feature.append(kind)
        out.cut.append(cut)
        out.leaf.append(value[2**DEPTH :])
    return out


def _edges(examples: DataFrame) -> dict[int, list[np.ndarray]]:
    """Upper edges of the bins by kind and feature, at exact quantiles.  A feature has few values, as candidates are short."""
    each = examples.select("kind", F.posexplode("x").alias("f", "v")).groupBy("kind", "f", "v").agg(F.count("*").alias("n")).toPandas()
    out: dict[int, list[np.ndarray]] = {}
    for (kind, _), own in each.sort_values(["kind", "f", "v"]).groupby(["kind", "f"]):
        values, share = own["v"].to_numpy(), own["n"].cumsum().to_numpy() / own["n"].sum()
        at = np.searchsorted(share, np.linspace(0, 1, BINS + 1)[1:-1])
        edges = np.unique(values[np.minimum(at, len(values) - 1)])
        out.setdefault(int(kind), []).append(edges[edges < values[-1]])
    return out


def _margins(examples: DataFrame, model: dict[str, Trees]) -> DataFrame:
    """(kind, y, margin) of all examples of the kinds in the model."""
    held = examples.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("kind").to_numpy()
            for kind, trees in held.value.items():
                own = batch.filter(pa.array(number == KINDS.index(kind)))
                if len(own):
                    x = own.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                    yield pa.RecordBatch.from_arrays([own.column("kind"), own.column("y"), pa.array(trees.margin(x))], ["kind", "y", "margin"])

    return examples.select("kind", "y", "x").mapInArrow(score, "kind int, y boolean, margin double")


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> dict[str, Trees]:
    """Trees per kind, learned from every example of every text; both labels of a kind weigh the same.

    A hash of the row's key, text size and offset holds a third of the examples out for the threshold.
    """

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, j - i) for b in batches for i, j in row_slices(np.diff(utf8(b.column("text"))[1]))):
            rows = [
                (KINDS.index(kind), y, at, x)
                for t, h in zip(batch.column("text").to_pylist(), batch.column("h").to_pylist(), strict=True)
                for kind, y, at, x in examples(t or "", h)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.float64())))],
                ["kind", "y", "h", "x"],
            )

    noted = docs.select(F.col(text).alias("text"), F.xxhash64(F.col(key), F.length(text)).alias("h"))
    mined = stored(noted.mapInArrow(mine, "kind int, y boolean, h long, x array<double>"), "candidates")
    held = F.col("h") % 3 == 0
    total = {(r["kind"], r["y"], r["held"]): r["count"] for r in mined.groupBy("kind", "y", held.alias("held")).count().collect()}
    learning = mined.filter(~held)
    edges = _edges(learning)
    setting = Setting(TREES, DEPTH, RATE, 1.0, 1.0, LEAST_HESSIAN, 0.0)
    out = {}
    for k, kind in enumerate(KINDS):
        count = {y: total.get((k, y, False), 0) for y in (False, True)}
        tested = sum(total.get((k, y, True), 0) for y in (False, True))
        if not all(count.values()) or not tested or tested + sum(count.values()) < 4 * MIN_LEAF:
            continue
        weight = F.when(F.col("y"), sum(count.values()) / 2 / count[True]).otherwise(sum(count.values()) / 2 / count[False])
        rows = learning.filter(F.col("kind") == k)
        rows = rows.select("h", F.col("y").cast("int").alias("label"), weight.alias("weight"), array_to_vector("x").alias("features"))
        binned = Binned.of(rows, "h", weight="weight", edges=edges[k])
        out[kind] = completed(BoostedModel.of(fit_all(binned, [setting])[0], binned.edges, DEPTH))
    if out:
        found = _margins(mined.filter(held), out).groupBy("kind", "margin")
        found = found.agg(F.count_if("y").alias("good"), F.count("*").alias("n"))
        cut = running_totals(found, "margin", ["good", "n"], by=["kind"], descending=True)
        enough = (F.col("cum_good") >= PRECISION * F.col("cum_n")) & (F.col("cum_n") >= MIN_SUPPORT)
        for r in cut.filter(enough).groupBy("kind").agg(F.min("margin").alias("least")).collect():
            out[KINDS[r["kind"]]].threshold = r["least"]
    return out


def all_spans(text: str, model: dict[str, Trees]) -> list[tuple[str, int, int, bool]]:
    """Base spans and those that the trees add, by start and then kind."""
    base = base_spans(text)
    found = [(*s, True) for s in base]
    rest = []
    taken = Cover(s[1:] for s in base)
    usable = [s for s in candidates(text) if s[0] in model and np.isfinite(model[s[0]].threshold) and not taken.meets(*s[1:])]
    for kind in {s[0] for s in usable}:
        own = [s for s in usable if s[0] == kind]
        margin = model[kind].margin(np.array([features(text, s) for s in own]))
        rest += [(m - model[kind].threshold, s) for m, s in zip(margin, own, strict=True) if m >= model[kind].threshold]
    for _, s in sorted(rest, key=lambda r: (-r[0], r[1][1], KINDS.index(r[1][0]))):
        if not taken.meets(*s[1:]):
            taken.add(*s[1:])
            found.append((*s, False))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _column(docs: DataFrame, model: dict[str, Trees], text: str, result: str, make: Callable) -> Column:
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(result)
    def over(column: pa.Array) -> pa.Array:
        return make(column, held.value)

    return over(F.col(text))


def spans(docs: DataFrame, model: dict[str, Trees], text: str = "text") -> Column:
    """All spans of a text column: kind, start, end, and whether a base rule found it."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def make(column: pa.Array, model: dict[str, Trees]) -> pa.Array:
        names = ("kind", "start", "end", "base")
        told = lambda texts: pa.array([[dict(zip(names, s, strict=True)) for s in all_spans(t or "", model)] for t in texts.to_pylist()], kind)
        return by_slices(column, told, kind)

    return _column(docs, model, text, SPANS, make)


def redact(text: str, found: list[tuple[str, int, int, bool]]) -> str:
    """Spans replaced by their kind; overlapping ones are one gap named after the first."""
    parts, done = [], 0
    for kind, a, b, _ in found:
        if a >= done:
            parts += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*parts, text[done:]])


def redacted(docs: DataFrame, model: dict[str, Trees], text: str = "text") -> Column:
    """The text without its personal data; null stays null."""

    def make(column: pa.Array, model: dict[str, Trees]) -> pa.Array:
        clean = lambda texts: pa.array([t and redact(t, all_spans(t, model)) for t in texts.to_pylist()], pa.string())
        return by_slices(column, clean, pa.string())

    return _column(docs, model, text, "string", make)
