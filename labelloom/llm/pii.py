"""Personal data by candidates and gradient-boosted trees.

Base patterns with checks (dots and ranges, Luhn, digit counts) are always redacted. Wide
generators propose further spans, which may overlap: spelled-out addresses, numbers with
other separators, card-like numbers. A span that fails the checks of its kind, or is a date or
a book number, is never added. Boosted trees score the others by their format and the words
around them. They learn from base spans against spans that fail the checks and spans that
pass them where no word of their kind stands before; all of these as they stand and rewritten
into the wide notations alike, so that the notation itself tells nothing. Wide spans that pass
near such a word have no label. Per-kind thresholds are calibrated on whole documents kept aside.

Trees and thresholds come from all candidates. Numbers become places among 31 quantiles, equal
rows are counted once, and every level of a tree is one pass that adds up histograms of a fixed
size, in whole numbers, so that sums don't depend on the order of rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import id_and_text, slices, stored
from labelloom.operators.numbering import in_written_order, numbered, with_starts

KINDS = ("email", "ip", "card", "phone")
LEAST_CANDIDATES = 50
CUTS = 31
# Slopes and bends are added up in this unit, weights in decimals.
UNIT = 2**26
WEIGHT = "decimal(12,6)"
PRECISION = 0.9
DEFAULT_THRESHOLD = 0.9
LEAST_HELD = 20

# The base patterns. Starts inside a run of digits cannot match where the run's start doesn't.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Generators of further candidates.
_WIDE = {
    "email": re.compile(
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\s?(?:\(at\)|\[at\]|\{at\}| at )\s?"
        r"[A-Za-z0-9-]{1,63}(?:\s?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.)\s?[A-Za-z0-9-]{2,63}){1,4}", re.I),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?[.:]\s?[0-9]{1,3}){3}(?![0-9.])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[\x20./_-]?[0-9]){12,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:\(?[0-9]{2,4}\)?[\x20./-]){1,3}[0-9]{3,4}[\x20.-]?[0-9]{2,4}(?![0-9])"),
}
_HINTS = {
    "email": ("mail", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "pay", "credit"),
    "phone": ("phone", "tel", "call", "fax", "mobile"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c)
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their at signs in linear time."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, in order."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_at_most_255(p) for p in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(map(m.group().count, "0123456789")) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and int(part) <= 255)


def wide_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the generators; spans of different kinds may overlap."""
    found = []
    if " at " in text or "at)" in text or "at]" in text or "at}" in text:
        found += [(m.start(), 0, m.end()) for m in _WIDE["email"].finditer(text)]
    if _DIGIT.search(text):
        for k in (1, 2, 3):
            found += [(m.start(), k, m.end()) for m in _WIDE[KINDS[k]].finditer(text)]
    return sorted(found)


def refused(span: str, kind: int) -> bool:
    """Whether a span in any notation fails the checks of its kind."""
    digits = "".join(c for c in span if "0" <= c <= "9")
    if kind == 0:  # a full stop and the next sentence
        return re.search(r"\.\s", span) is not None
    if kind == 1:
        return not all(map(_at_most_255, re.findall("[0-9]+", span)))
    if kind == 2:
        return not (14 <= len(digits) <= 19 and luhn(digits))
    return not 10 <= len(digits) <= 15 or _dated(span) or _book_number(digits)


def _dated(span: str) -> bool:
    """Whether the first three groups of digits are a day, in any order and with a year of four digits."""
    groups = [int(g) for g in re.findall("[0-9]+", span)[:3]]
    years = [g for g in groups if 1000 <= g <= 2999]
    rest = sorted(g for g in groups if not 1000 <= g <= 2999)
    return len(groups) == 3 and len(years) == 1 and 1 <= rest[0] <= 12 and rest[1] <= 31


def _book_number(digits: str) -> bool:
    return len(digits) == 13 and digits[:3] in ("978", "979") and sum(int(c) * (1 + 2 * (i % 2)) for i, c in enumerate(digits)) % 10 == 0


NEAR = 40
# How many spans pass the checks of a kind by chance for each that fails them, roughly; a span
# that fails is no candidate itself, but so much does it say against its format and place.
CHANCE = (1.0, 0.05, 0.11, 0.1)


def hint_distance(text: str, start: int, kind: int) -> int:
    """Characters back to the last word of the kind, ``NEAR`` + 1 if there is none that near."""
    around = text[max(0, start - NEAR) : start].lower()
    return min((len(around) - at for h in _HINTS[KINDS[kind]] if (at := around.rfind(h)) >= 0), default=NEAR + 1)


_AT_DOT = ((" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "."), ("{at}", "{dot}"))


def rewritten(span: str, kind: int) -> str | None:
    """A base span in one of the wide notations, chosen by its bytes; None if it has none there."""
    draw = zlib.crc32(span.encode("utf-8", "surrogatepass"))
    if kind == 0:
        at, dot = _AT_DOT[draw % len(_AT_DOT)]
        if "@" not in span:
            return None
        local, domain = span.split("@", 1)
        new = local + at + domain.replace(".", dot)
    elif kind == 1:
        new = (":", " . ", ". ")[draw % 3].join(re.findall("[0-9]+", span))
    elif kind == 2:
        digits, sep = re.sub("[^0-9]", "", span), "./_"[draw % 3]
        new = sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    else:
        groups, sep = re.findall("[0-9]+", span), " ./-"[draw % 4]
        if len(groups) < 3:
            digits = "".join(groups)
            groups = [digits[:-10], digits[-10:-7], digits[-7:-4], digits[-4:]] if draw % 2 else [digits[-10:-7], digits[-7:-4], digits[-4:]]
        new = sep.join(g for g in groups if g)
    return new if _WIDE[KINDS[kind]].fullmatch(new) else None


def describe(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format and context of a candidate as numbers."""
    span = text[start:end]
    digits = [c for c in span if "0" <= c <= "9"]
    around = text[max(0, start - NEAR) : start].lower()
    after = text[end : end + 1]
    groups = re.findall("[0-9]+", span)
    seps = [c for c in span if not c.isalnum()]
    return [
        float(kind), float(len(span)), float(len(digits)), float(len(groups)),
        float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(len(seps)), float(len(set(seps))), float(span.count(".")), float(span.count(" ")), float(span.count("-")),
        float(sum(c.isalpha() for c in span)), float(sum(h in around for h in _HINTS[KINDS[kind]])),
        float(bool(after) and not after.isspace() and after not in ".,;:)"),
        float(start > 0 and not text[start - 1].isspace()), float(len(set(digits))),
        float(hint_distance(text, start, kind) // 8), float(digits[0]) if digits else -1.0,
    ]


@dataclass
class Boosted:
    """Gradient-boosted trees of depth two on numbers, for the logistic loss."""

    trees: list[list[tuple]] = field(default_factory=list)
    start: float = 0.0
    thresholds: dict[int, float] = field(default_factory=dict)

    def fit(self, rows: DataFrame, share: float, edges: list[np.ndarray], rounds: int = 40, rate: float = 0.3, leaf: float = 2.0) -> Boosted:
        """Trees from all ``binned`` rows, two passes each; ``share`` of them, by weight, is confirmed."""
        share = min(max(share, 1e-3), 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        places = Boosted(start=self.start)  # the same trees on the places of the numbers
        for _ in range(rounds):
            tree, whole = (0.0,), _histograms(rows, places, None, len(edges))
            split = _split(whole[0], edges, leaf)
            if split is None:
                tree = _leaf(whole[0], rate, leaf)
            else:
                sides = _histograms(rows, places, split, len(edges))
                tree = (*split, *[self._grow(side, edges, rate, leaf) for side in sides])
            places.trees.append(tree)
        self.trees = [_with_cuts(tree, edges) for tree in places.trees]
        return places

    def _grow(self, sums: np.ndarray, edges: list[np.ndarray], rate: float, leaf: float) -> tuple:
        split = _split(sums, edges, leaf)
        if split is None:
            return _leaf(sums, rate, leaf)
        left = sums[:, split[0]].copy()
        left[:, split[1] + 1 :] = 0
        return (*split, _leaf(left[:, None], rate, leaf), _leaf((sums[:, split[0]] - left)[:, None], rate, leaf))

    def _walk(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        if len(tree) == 1:
            return np.full(len(x), tree[0])
        return np.where(x[:, tree[0]] <= tree[1], self._walk(tree[2], x), self._walk(tree[3], x))

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        for tree in self.trees:
            score = score + self._walk(tree, x)
        return 1 / (1 + np.exp(-score))

    def selects(self, text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        if not spans or not self.trees:
            return []
        x = np.array([describe(text, *s) for s in spans])
        p = self.probability(x)
        return [s for s, v in zip(spans, p, strict=True) if v >= self.thresholds.get(s[1], DEFAULT_THRESHOLD)]


def _leaf(sums: np.ndarray, rate: float, leaf: float) -> tuple:
    _, slope, bend = (int(v) / UNIT for v in sums[:, 0].sum(axis=1))
    return (rate * slope / (bend + leaf),)


def _split(sums: np.ndarray, edges: list[np.ndarray], leaf: float) -> tuple[int, int] | None:
    """The number and the place of the cut that gain most; None without any gain."""
    left = np.cumsum(sums, axis=2)
    right = left[:, :, -1:] - left
    gain = 0.0
    for n, slope, bend in (left, right):
        gain = gain + np.where(n > 0, (slope / UNIT) ** 2 / (bend / UNIT + leaf), -np.inf)
    slope, bend = left[1:, 0, -1] / UNIT
    gain -= slope**2 / (bend + leaf)
    gain[np.arange(CUTS + 1) >= np.array([len(cuts) for cuts in edges])[:, None]] = -np.inf
    at = int(gain.argmax())
    return divmod(at, CUTS + 1) if gain.flat[at] > 1e-6 else None


def _with_cuts(tree: tuple, edges: list[np.ndarray]) -> tuple:
    if len(tree) == 1:
        return tree
    return (tree[0], float(edges[tree[0]][tree[1]]), *[_with_cuts(t, edges) for t in tree[2:]])


def _places(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("places").to_pylist()), np.uint8).reshape(b.num_rows, -1)


def _histograms(rows: DataFrame, model: Boosted, split: tuple[int, int] | None, width: int) -> np.ndarray:
    """Candidates, slopes and bends by number and place: of all rows, or of both sides of a split.

    Every task sends one row of a fixed size.
    """
    nodes, cells = 1 if split is None else 2, width * (CUTS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((nodes, 3, cells), np.int64)
        for b in batches:
            x = _places(b)
            n, y = b.column("n").to_numpy(), b.column("confirmed").to_numpy(zero_copy_only=False).astype(float)
            w = np.array([float(v) for v in b.column("weight").to_pylist()])
            p = model.probability(x)
            cell = x + np.arange(width) * (CUTS + 1)
            side = np.zeros(len(n), int) if split is None else (x[:, split[0]] > split[1]).astype(int)
            for i, values in enumerate((n, np.rint(w * (y - p) * UNIT) * n, np.rint(w * p * (1 - p) * UNIT) * n)):
                at = (cell + side[:, None] * cells).ravel()
                found = np.bincount(at, np.repeat(values.astype(float), width), nodes * cells)
                total[:, i] += found.astype(np.int64).reshape(nodes, cells)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    shape = (nodes, 3, width, CUTS + 1)
    found = rows.select("places", "confirmed", "weight", "n").mapInArrow(run, "sums binary").collect()
    return sum((np.frombuffer(r["sums"], np.int64).reshape(shape) for r in found), np.zeros(shape, np.int64))


class Cover:
    """Answers whether a span overlaps one of the given spans, which are in order of their starts."""

    def __init__(self, spans: list[tuple[int, int, int]]) -> None:
        self.starts = [s[0] for s in spans]
        self.ends = list(accumulate((s[2] for s in spans), max))

    def meets(self, span: tuple[int, int, int]) -> bool:
        before = bisect_left(self.starts, span[2])
        return before > 0 and self.ends[before - 1] > span[0]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, numbers, confirmed and weight of every candidate that has a label.

    Confirmed are base spans; not confirmed are wide spans beside them that fail the checks,
    or that no word of their kind stands before. Each is described as it stands and rewritten.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                base = base_spans(text)
                taken = Cover(base)
                labelled = [(s, True, 1.0) for s in base]
                for s in wide_spans(text):
                    if not taken.meets(s):
                        if refused(text[s[0] : s[2]], s[1]):
                            labelled.append((s, False, CHANCE[s[1]]))
                        elif hint_distance(text, s[0], s[1]) > NEAR:
                            labelled.append((s, False, 1.0))
                for (a, k, e), good, weight in labelled:
                    row = {"doc_id": doc, "start": a, "confirmed": good, "weight": weight}
                    rows.append(row | {"x": describe(text, a, k, e)})
                    new = rewritten(text[a:e], k)
                    if new is not None:
                        around = text[max(0, a - NEAR) : a]
                        x = describe(around + new + text[e : e + 1], len(around), k, len(around) + len(new))
                        rows.append(row | {"x": x})
            schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("x", pa.list_(pa.float64())), ("confirmed", pa.bool_()), ("weight", pa.float64())])
            yield pa.RecordBatch.from_pylist(rows, schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, start long, x array<double>, confirmed boolean, weight double")


def cut_points(found: DataFrame, width: int) -> list[np.ndarray]:
    """Up to ``CUTS`` distinct quantiles of each number; exact, from counts of its distinct values."""
    shares = F.array(*[F.lit((i + 1) / (CUTS + 1)) for i in range(CUTS)])
    row = found.agg(*[F.percentile(F.col("x")[i], shares).alias(f"x{i}") for i in range(width)]).first()
    return [np.unique(np.array(c)) for c in row]


def binned(found: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """Candidates with the places of their numbers among the cuts; equal ones are one row with their count ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, len(edges))
            at = np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(edges)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.tobytes() for r in at], pa.binary()), pa.array(x[:, 0].astype(np.int32)),
                 *[b.column(c) for c in ("confirmed", "weight", "aside")]], ["places", "kind", "confirmed", "weight", "aside"],
            )

    rows = found.mapInArrow(run, "places binary, kind int, confirmed boolean, weight double, aside boolean")
    keys = ["places", "kind", "confirmed", F.col("weight").cast(WEIGHT).alias("weight"), "aside"]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Boosted:
    """Trees and thresholds from all candidates.

    Documents whose id hashes to a fourth of all values are kept aside for the thresholds.
    """
    found = stored(candidates(docs, id_col, text_col), "candidates")
    mine = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("None")).cast("binary")) % 4 == 0
    kinds = found.groupBy("confirmed", F.col("weight").cast(WEIGHT).alias("weight"), mine.alias("aside"))
    kinds = kinds.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width")).collect()
    if sum(r["n"] for r in kinds) < LEAST_CANDIDATES or len({r["confirmed"] for r in kinds}) < 2:
        return Boosted()
    if len({r["aside"] for r in kinds}) == 1:
        found = numbered(found, F.xxhash64("doc_id", "start", "x"), many_ties=True)
        mine = F.col("place") % 4 == 0
    found = found.select("x", "confirmed", "weight", mine.alias("aside"))
    edges = cut_points(found.filter(~F.col("aside")), kinds[0]["width"])
    rows = stored(binned(found, edges), "places", "aside")
    learn = rows.filter(~F.col("aside"))
    weights = learn.groupBy("confirmed").agg(F.sum(F.col("weight") * F.col("n")).alias("w")).collect()
    share = sum(r["w"] for r in weights if r["confirmed"]) / sum(r["w"] for r in weights)
    model = Boosted()
    places = model.fit(learn, float(share), edges)
    model.thresholds = thresholds(rows.filter("aside"), places)
    return model


def thresholds(aside: DataFrame, places: Boosted) -> dict[int, float]:
    """Per kind, the lowest score down to which the wanted share of all candidates, by weight, was confirmed.

    The share holds where the running total of confirmed weight less the wanted part of all weight is not below zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = pa.array(places.probability(_places(b)), pa.float64())
            yield pa.RecordBatch.from_arrays([p, *[b.column(c) for c in ("kind", "confirmed", "weight", "n")]], ["p", "kind", "confirmed", "weight", "n"])

    over = F.col("confirmed").cast("int") - F.lit(PRECISION).cast("decimal(4,3)")
    scored = aside.select("places", "kind", "confirmed", "weight", "n").mapInArrow(run, f"p double, kind int, confirmed boolean, weight {WEIGHT}, n long")
    scored = scored.groupBy("kind", "p").agg(F.sum("n").alias("n"), F.sum(over * F.col("weight") * F.col("n")).cast("decimal(38,9)").alias("over"))
    ordered = in_written_order(scored, "kind", F.desc("p"))
    totals = dict(sorted((r["kind"], r["over"]) for r in ordered.groupBy("kind").agg(F.sum("over").alias("over")).collect()))
    before = F.lit(0)
    for kind in totals:
        before = F.when(F.col("kind") == kind, F.lit(sum((v for k, v in totals.items() if k < kind), Decimal(0)))).otherwise(before)
    good = with_starts(ordered, "over", "before").filter(F.col("before") + F.col("over") - before >= 0)
    least = {r["kind"]: r["p"] for r in good.groupBy("kind").agg(F.min("p").alias("p")).collect()}
    enough = F.lit(False)
    for kind, p in least.items():
        enough = enough | ((F.col("kind") == kind) & (F.col("p") >= p))
    held = {r["kind"]: r["n"] for r in ordered.filter(enough).groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    return {k: max(least[k] if held.get(k, 0) > LEAST_HELD else DEFAULT_THRESHOLD, 0.5) for k in range(len(KINDS))}


def find(text: str, model: Boosted) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: the base ones and selected candidates that pass the checks and overlap none of them."""
    base = base_spans(text)
    taken = Cover(base)
    more: list[tuple[int, int, int]] = []
    open_ones = [s for s in wide_spans(text) if not taken.meets(s) and not refused(text[s[0] : s[2]], s[1])]
    for s in model.selects(text, open_ones):
        if not more or more[-1][2] <= s[0]:
            more.append(s)
    return base, sorted([*base, *more])


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_all(docs: DataFrame, model: Boosted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base counts per kind, base_sha256 and all spans, for every row; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [find(text, model) for text in b.column("text").to_pylist()]
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
            digest = [hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *counts, pa.array(digest, pa.string()),
                 pa.array([listed(every) for _, every in found], pa.string())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Spans replaced by their kinds in angle brackets; overlapping spans become one, of the first kind."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows with personal data replaced, columns of the input; null texts stay null."""
    model, schema = fit(docs, id_col, text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            texts = [t if t is None else redact_text(t, find(t, model)[1]) for t in b.column(text_col).to_pylist()]
            at = b.schema.get_field_index(text_col)
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(run, schema)
