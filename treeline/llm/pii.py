"""Personal data: exact base patterns, high-recall candidates, boosted trees over format and context, redaction."""

from __future__ import annotations

import bisect
import hashlib
import pickle
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm._common import bounded_batches, materialize

KINDS = ("email", "ip", "card", "phone")
# The leading look-behinds only spare starts that cannot be a leftmost match: inside a run the same continuation fails too.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    """The card numbers' check sum."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(t: str) -> str:
    return "".join(_DIGIT.findall(t))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain.part, found from each @: linear in the text."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans that pass their checks, by start, then kind."""
    found: list[Span] = [(a, 0, b) for a, b in emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found)


# Candidates: looser forms. Each may overlap others and the base spans.
_LOOSE = (
    (0, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,63}){1,4}")),
    (1, re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?[.,:] ?[0-9]{1,3}){3}(?![0-9])")),
    (2, re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./_-]{1,2}[0-9]{4}){2,3}(?:[ ./_-]{1,2}[0-9]{1,3})?(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])")),
    (3, re.compile(r"(?<![0-9A-Za-z])\(?(?:\+|00)?[0-9]{1,4}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){2,5}(?![0-9])")),
)
_HINT = (
    re.compile(r"e-?mail|mail|write|contact|correo|courriel", re.I),
    re.compile(r"\bip\b|addr|host|server|from", re.I),
    re.compile(r"card|visa|master|credit|karte|carte|tarjeta|pay", re.I),
    re.compile(r"tel|phone|call|mobile|fax|fon|handy|móvil", re.I),
)
#: Code points of context on each side that the features see.
CONTEXT = 24
N_FEATURES = 31
_AT = re.compile(r"\(at\)|\[at\]")
_DOT = re.compile(r"\(dot\)|\[dot\]| dot ")


def candidates(text: str) -> list[Span]:
    """High-recall spans, overlapping where they like: the loose forms and the base patterns' own matches.

    The loose forms repeat within fixed bounds only, so the time is linear in the text.
    """
    found = set(base_spans(text))
    if "@" in text or "at" in text:
        near = [m.start() for m in re.finditer(r"@|\(at\)|\[at\]| at ", text)]
        done = 0
        for at in near:
            m = _LOOSE[0][1].search(text, max(done, at - 66), min(len(text), at + 340))
            if m:
                found.add((m.start(), 0, m.end()))
                done = m.end()
    if _DIGIT.search(text):
        for kind, pattern in _LOOSE[1:]:
            found.update((m.start(), kind, m.end()) for m in pattern.finditer(text))
    return sorted(found)


def span_features(text: str, span: Span) -> list[float]:
    """Format and context of one candidate."""
    a, kind, b = span
    t, left, right = text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    d = _digits(t)
    parts = re.split(r"[^0-9]+", t.strip("+() "))
    numbers = [int(p) for p in parts if p and len(p) < 19]
    last = re.split(r"[.@ ]", t)[-1]
    return [
        *(float(kind == k) for k in range(4)),
        float(len(t)),
        float(len(d)),
        len(d) / len(t),
        float(len(parts)),
        float(max(numbers, default=0) <= 255),
        float(luhn(d)) if d else 0.0,
        float(t.count("@")),
        float(t.count(".")),
        float(t.count(" ")),
        float(t.count("-")),
        float(t[0] == "+"),
        float(len(last)) if last.isalpha() else 0.0,
        float(left[-1:].isalnum()),
        float(right[:1].isalnum()),
        float(left[-1:] in ".@-+/="),
        float(right[:1] in "@-+/="),
        float(bool(_HINT[kind].search(left))),
        float(sum(c.isdigit() for c in left + right)),
        float(bool(_AT.search(t))),
        float(" at " in t),
        float(bool(_DOT.search(t))),
        float(len(re.findall(r"\.\s", t))),
        float(t.lstrip("(")[:1] == "0"),
        float("(" in t),
        float(max(map(len, parts))),
        float(min(map(len, parts))),
        float(t.count(",") + t.count(":")),
    ]


def rewritten(t: str, kind: int, variant: int) -> str:
    """A base span in one of the loose forms that the base patterns do not match."""
    v = variant
    if kind == 0:
        local, domain = t.split("@", 1)
        at, dot = (("(at)", "."), (" (at) ", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" at ", " dot "), (" @ ", "."), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" [at] ", "."), (" at ", "."))[v % 10]
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return (" . ", ". ", " .")[v % 3].join(t.split("."))
    d = _digits(t)
    if kind == 2:
        return (". "[: 1 + v % 2], "/", "_", "  ")[v // 2 % 4].join(d[k : k + 4] for k in range(0, len(d), 4))
    if v % 3 == 0:
        return t[1:]
    if v % 3 == 1:
        return "00" + t[1:]
    cut = 1 + v // 3 % 3  # national: a trunk zero in place of the country's digits
    rest, size, sep = d[cut:], 3 + v // 9 % 2, " -./"[v // 18 % 4]
    groups = ["0" + rest[:size], *(rest[k : k + 4] for k in range(size, len(rest), 4))]
    return sep.join(groups[:-2] + [groups[-2] + groups[-1]] if len(groups[-1]) < 2 else groups)


def _rewrite_example(left: str, t: str, kind: int, right: str, variant: int) -> list[float] | None:
    """Features of a base span's rewritten form between its neighbours, if a loose pattern finds it clear of base spans."""
    new = rewritten(t, kind, variant)
    whole, a, b = left + new + right, len(left), len(left) + len(new)
    for s in _clear(candidates(whole), base_spans(whole)):
        if s[1] == kind and s[0] <= a and s[2] >= b:
            return span_features(whole, s)
    return None


def _context_negative(text: str, s: Span) -> bool:
    """Whether a candidate can be taken for wrong: no word before it hints at its kind, and it is not spelled to hide an address."""
    t, left = text[s[0] : s[2]], text[max(0, s[0] - CONTEXT) : s[0]]
    return not (_HINT[s[1]].search(left) or s[1] == 0 and (_AT.search(t) or _DOT.search(t)))


@dataclass(frozen=True)
class Settings:
    """precision: least share of right ones among those that a kind's threshold lets through on the held-out third;
    local: distinct examples that the driver takes at most; more are summed by tasks, with the same result."""

    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    precision: float = 0.99
    local: int = 200_000


# Bins are fixed, so that nothing need be known of the examples to sort them in: shares by 1/31, all else by size.
_RATIO = 6
_EDGES = np.array([*range(17), 18, 20, 22, 24, 28, 32, 40, 48, 64, 96, 128, 192, 255, 256], float)
BINS = len(_EDGES) + 1
#: Gradients are multiples of 1/GRAIN and probabilities are told apart by 1/GRID, so that sums are exact in any order.
GRAIN, GRID = float(1 << 20), 10_000


def binned(x: np.ndarray) -> np.ndarray:
    """The bin of each feature of each row."""
    x = np.atleast_2d(np.asarray(x, float))
    out = np.searchsorted(_EDGES, x, side="left")
    if x.shape[1] == N_FEATURES:
        out[:, _RATIO] = np.ceil(np.clip(x[:, _RATIO], 0, 1) * (BINS - 1))
    return out.astype(np.uint8)


class Boosted:
    """Gradient boosting for the logistic loss: trees of fixed depth over binned features, as arrays."""

    def __init__(self, s: Settings):
        self.s, self.base, self.edges, self.trees = s, 0.0, None, []

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return binned(x) if self.edges is None else np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1)

    def margin(self, b: np.ndarray) -> np.ndarray:
        """Sum of the trees for rows of bins."""
        z = np.full(len(b), self.base)
        for tree, leaf in self.trees:
            z += leaf[_node(b, tree)]
        return z

    def sums(self, b: np.ndarray, y: np.ndarray, w: np.ndarray, tree: list[np.ndarray], z: np.ndarray | None = None) -> np.ndarray:
        """Gradients and curvatures of rows with weights w, by node of the tree that is being grown, feature and bin."""
        p = 1 / (1 + np.exp(-(self.margin(b) if z is None else z)))
        g, h = (np.rint(v * GRAIN) / GRAIN * w for v in (y - p, np.maximum(p * (1 - p), 1e-6)))
        node, n, f = _node(b, tree), 1 << len(tree), b.shape[1]
        at = (node[:, None] * f + np.arange(f)) * BINS + b
        return np.stack([np.bincount(at.ravel(), np.repeat(v, f), n * f * BINS).reshape(n, f, BINS) for v in (g, h)])

    def grow(self, mean: float, sums: Callable[[list[np.ndarray]], np.ndarray]) -> Boosted:
        """Fit all trees. mean: share of label 1; sums: what sums() gives for all examples and a tree that is being grown."""
        p0 = min(max(mean, 1e-3), 1 - 1e-3)
        self.base = float(np.log(p0 / (1 - p0)))
        for _ in range(self.s.trees):
            tree: list[np.ndarray] = []
            for level in range(self.s.depth):
                gs, hs = sums(tree).cumsum(axis=3)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = (gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)).reshape(1 << level, -1)
                j, k = gain.argmax(axis=1), np.arange(1 << level)
                none = gain[k, j] <= 1e-9
                at, cut = np.where(none, 0, j // BINS), np.where(none, BINS, j % BINS)
                tree.append(np.stack([at, cut], axis=1))
                low = np.minimum(cut, BINS - 1)
                left = np.stack([gs[k, at, low], hs[k, at, low]], axis=1)
            whole = np.stack([gs[k, at, -1], hs[k, at, -1]], axis=1)
            both = np.stack([left, whole - left], axis=1).reshape(-1, 2)  # leaves: each node's lower bins, then the others
            self.trees.append((tree, both[:, 0] / (both[:, 1] + 1) * self.s.rate))
        return self

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Fit on rows of features, which are few: bins are cut at their own quantiles."""
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS - 1))) for k in range(x.shape[1])]
        return self.fit_binned(self._bin(x), y, np.ones(len(y)))

    def fit_binned(self, b: np.ndarray, y: np.ndarray, w: np.ndarray) -> Boosted:
        """Fit on rows of bins with weights, all in memory."""
        z = [0, np.zeros(0)]

        def sums(tree: list[np.ndarray]) -> np.ndarray:
            if not len(z[1]) and len(b):
                z[1] = np.full(len(b), self.base)
            for t, leaf in self.trees[z[0] :]:
                z[1] += leaf[_node(b, t)]
            z[0] = len(self.trees)
            return self.sums(b, y, w, tree, z[1])

        return self.grow(float(np.average(y, weights=w)) if len(y) else 0.5, sums)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities."""
        return 1 / (1 + np.exp(-self.margin(self._bin(x))))


def _node(b: np.ndarray, tree: list[np.ndarray]) -> np.ndarray:
    node, row = np.zeros(len(b), np.int64), np.arange(len(b))
    for cut in tree:
        node = 2 * node + (b[row, cut[node, 0]] > cut[node, 1])
    return node


@dataclass
class Model:
    """A boosted model and the threshold of each kind (over 1: the kind adds nothing)."""

    boosted: Boosted | None
    thresholds: tuple[float, float, float, float] = (2.0, 2.0, 2.0, 2.0)


_EXAMPLE = "kind int, label int, h long, x binary"
_CELL = pa.schema([("kind", pa.int32()), ("label", pa.int32()), ("h", pa.int64()), ("x", pa.binary())])


def _hash(t: str) -> int:
    return int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little", signed=True)


def _examples(text: str) -> Iterator[tuple[int, int, int, list[float]]]:
    """kind, label, hash, features of the examples of a text, none of which the base patterns decide.

    Right are its base spans, each rewritten into a loose form where it stands; wrong are candidates clear of all base
    spans whose context says nothing for them. Other candidates are left out: nothing tells what they are.
    """
    base = base_spans(text)
    for a, kind, b in base:
        h = _hash(text[max(0, a - 9) : b + 9])
        x = _rewrite_example(text[max(0, a - 3 * CONTEXT) : a], text[a:b], kind, text[b : b + 3 * CONTEXT], h & 0xFFFF)
        if x:
            yield kind, 1, h, x
    for s in _clear(candidates(text), base):
        if _context_negative(text, s):
            yield s[1], 0, _hash(text[max(0, s[0] - 9) : s[2] + 9]), span_features(text, s)


def _built_in(n: int = 200) -> list[tuple[int, int, int, list[float]]]:
    """The same kinds of examples from made-up texts, n a kind and class, so that a kind rare in the corpus is learned too."""
    rng = np.random.default_rng(42)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    num = lambda lo, hi: int(rng.integers(lo, hi))
    dig = lambda k: "".join(str(num(0, 10)) for _ in range(k))
    word = lambda: "".join(chr(97 + num(0, 26)) for _ in range(num(2, 9)))
    hints = (("mail ", "write to ", "contact: "), ("server ", "from ", "IP: "), ("card ", "pay with ", "Visa: "), ("call ", "tel. ", "phone: "))

    def base(kind: int) -> str:
        if kind == 0:
            return f"{word()}{pick('', '.' + word(), dig(2))}@{word()}{pick('', '.' + word())}.{pick('org', 'com', 'net', 'de', 'example', 'fr')}"
        if kind == 1:
            return ".".join(str(num(0, 256)) for _ in range(4))
        if kind == 2:
            d = pick("4", "5", "37")
            d += dig(15 - len(d))
            return next(d + str(c) for c in range(10) if luhn(d + str(c)))
        return f"+{num(1, 100)} {pick('%s', '(%s)') % dig(num(2, 4))} {dig(num(3, 5))}{pick(' ', '-')}{dig(num(2, 5))}"

    def wrong(kind: int) -> str:
        if kind == 0:
            return f"{word()} at {word()}. {word().title()}"
        if kind == 1:
            return pick(", ".join(str(num(0, 99)) for _ in range(4)), ":".join(f"{num(0, 60):02}" for _ in range(4)), ".".join(str(num(256, 999)) for _ in range(4)))
        if kind == 2:
            return pick(dig(num(13, 20)), pick(" ", ".", "/", "-", "_").join(dig(4) for _ in range(4)))
        return pick(f"{num(1900, 2030)}-{num(1, 13):02}-{num(1, 29):02}", f"{num(1, 29):02}.{num(1, 13):02}.{num(1900, 2030)}", " ".join([str(num(1, 999)), *(dig(3) for _ in range(num(2, 4)))]), "-".join(dig(2) for _ in range(num(3, 6))), " ".join(dig(num(2, 4)) for _ in range(num(3, 6))))

    found: dict[tuple[int, int, int], list[float]] = {}
    for kind in range(4):
        for k in range(n):
            left, right = f"{word()} {word()} " + (pick(*hints[kind]) if k % 2 else ""), pick(".", " ", ", ") + f" {word()}"
            if x := _rewrite_example(left, base(kind), kind, right, k):
                found[kind, 1, k] = x
            text = f"{word()} {word()} " + wrong(kind) + right
            for s in _clear(candidates(text), base_spans(text)):
                if s[1] == kind and _context_negative(text, s):
                    found[kind, 0, k] = span_features(text, s)
    return [(*k, x) for k, x in found.items()]


def _cells(rows: list[tuple[int, int, int, list[float]]]) -> pa.RecordBatch:
    """Examples with their features' bins as bytes."""
    if not rows:
        return pa.RecordBatch.from_pylist([], schema=_CELL)
    kinds, labels, hashes, xs = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip((kinds, labels, hashes, [b.tobytes() for b in binned(np.array(xs))]), _CELL, strict=True)], schema=_CELL)


def _collect(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in bounded_batches(it):
        yield _cells([e for text in b.column("text").to_pylist() if text for e in _examples(text)])


def _arrays(b: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """kind, label, weight and bins of rows of kind, label, x, n."""
    x = np.frombuffer(b"".join(b["x"].to_pylist()), np.uint8).reshape(-1, N_FEATURES)
    return b["kind"].to_numpy(), b["label"].to_numpy().astype(float), b["n"].to_numpy().astype(float), x


def _tail(boosted: Boosted, kind: np.ndarray, y: np.ndarray, w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Weights by kind, label and step of the probability."""
    step = np.floor(GRID / (1 + np.exp(-boosted.margin(x)))).astype(np.int64)
    return np.bincount((kind * 2 + y.astype(np.int64)) * (GRID + 1) + step, w, 8 * (GRID + 1)).reshape(4, 2, GRID + 1)


def _summed(cells: DataFrame, of: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum of of(kind, label, weight, bins) over pieces of all rows; a task sends one array."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in it:
            if b.num_rows:
                part = of(*_arrays(b))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["v"])

    return sum(pickle.loads(r[0]) for r in cells.mapInArrow(run, "v binary").toLocalIterator())


def fit(docs: DataFrame, s: Settings = Settings()) -> Model:
    """Fit on every distinct example of docs (column text) and the built-in ones; thresholds from all of a held-out third.

    Examples with equal bins are one row with a weight. Up to s.local such rows are summed on the driver, more by tasks,
    in a pass for each level of each tree; the sums are exact, so the model is the same.
    """
    spark = docs.sparkSession
    spans = docs.select("text").where(F.col("text").rlike("[0-9@]| at |\\(at\\)|\\[at\\]")).mapInArrow(_collect, _EXAMPLE)
    every = spans.union(spark.createDataFrame(pa.Table.from_batches([_cells(_built_in())])).select("kind", "label", "h", "x"))
    distinct = every.distinct().withColumn("held", F.pmod(F.xxhash64("h"), F.lit(3)) == 0)
    cells, _ = materialize(distinct.groupBy("held", "kind", "label", "x").agg(F.count("*").alias("n")), "examples")
    boosted = Boosted(s)
    learn, held = cells.where("NOT held").select("kind", "label", "x", "n"), cells.where("held").select("kind", "label", "x", "n")
    if cells.limit(s.local + 1).count() <= s.local:
        _, y, w, x = _arrays(learn.toArrow())
        boosted.fit_binned(x, y, w)
        tail = _tail(boosted, *_arrays(held.toArrow()))
    else:
        ones, total = learn.agg(F.sum(F.col("label") * F.col("n")), F.sum("n")).first()
        boosted.grow(ones / total, lambda tree: _summed(learn, lambda _, y, w, x: boosted.sums(x, y, w, tree)))
        tail = _summed(held, lambda *a: _tail(boosted, *a))
    up = tail[:, :, ::-1].cumsum(axis=2)[:, :, ::-1]  # those of at least each step
    thresholds = []
    for wrong, right in up:
        good = np.flatnonzero((right >= s.precision * (right + wrong)) & (right > 0))
        thresholds.append(float(max(0.9, good[0] / GRID)) if len(good) else 2.0)
    return Model(boosted, tuple(thresholds))


def all_spans(text: str, model: Model, base: list[Span] | None = None) -> list[Span]:
    """The base spans, and those candidates clear of them that the model's thresholds let through, likeliest first."""
    base = base_spans(text) if base is None else base
    if model.boosted is None:
        return base
    extra = _clear(candidates(text), base)
    if not extra:
        return base
    p = model.boosted.predict(np.array([span_features(text, s) for s in extra], float))
    taken: list[Span] = []
    for k in np.argsort(-p, kind="stable"):
        s = extra[k]
        if p[k] < model.thresholds[s[1]]:
            continue
        at = bisect.bisect_left(taken, s)  # those taken are disjoint, so only the neighbours can overlap
        if (at == 0 or taken[at - 1][2] <= s[0]) and (at == len(taken) or taken[at][0] >= s[2]):
            taken.insert(at, s)
    return sorted(base + taken)


def _clear(found: list[Span], base: list[Span]) -> list[Span]:
    """Candidates that overlap no base span, in one pass over both by start."""
    if not base:
        return found
    merged: list[list[int]] = []
    for a, _, e in base:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([a, e])
    starts, ends = np.array([m[0] for m in merged]), np.array([m[1] for m in merged])
    out = []
    for s in found:
        k = int(np.searchsorted(ends, s[0], side="right"))
        if k == len(ends) or starts[k] >= s[2]:
            out.append(s)
    return out


def spell(spans: list[Span]) -> str:
    """kind:start:end by start, then kind, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in spans)


def redact(text: str, spans: list[Span]) -> str:
    """text with each span, or run of overlapping ones, replaced by the first one's kind in angle brackets."""
    out, at = [], 0
    for a, k, e in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and all spans of each row of docs (doc_id, text).

    Offsets count code points. NULL and empty texts have none: zeros, the hash of the empty string, an empty string.
    Equal rows get equal results.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(sent.value)
        for b in bounded_batches(it):
            counts, shas, spans = [], [], []
            for text in b.column("text").to_pylist():
                base = base_spans(text or "")
                counts.append([sum(k == kind for _, k, _ in base) for kind in range(4)])
                shas.append(hashlib.sha256(spell(base).encode()).hexdigest())
                spans.append(spell(all_spans(text or "", own, base)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), pa.array(shas, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame, model: Model) -> DataFrame:
    """docs with all spans of column text redacted; NULL stays NULL, other columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    cols = docs.columns

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(sent.value)
        for b in bounded_batches(it):
            texts = [t if not t else redact(t, all_spans(t, own)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in cols], names=cols)

    return docs.mapInArrow(run, docs.schema)
