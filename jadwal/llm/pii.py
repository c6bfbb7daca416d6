"""Personal data: generators propose overlapping spans, boosted trees score them, thresholds select.

The base kinds (email, ip, card, phone) follow fixed rules and always stay. Wider generators propose
further spans: tolerant forms of the base kinds and long key-like runs. Gradient-boosted trees score those by
format and context; a span is added when it passes its kind's threshold and does not overlap a chosen span.

The trees are fitted on a bounded number of candidates of each kind and label. The thresholds are set for
precision from a histogram of the scores of all other candidates of all documents that could be added.

The trees learn from weak labels. A candidate is positive when a base rule accepts its span. Tolerant forms, which
no base rule accepts as they stand, are positive by other evidence: emails and ips when the base rule accepts them
with plain signs in place of (at) and (dot), cards by the Luhn sum and groups of three digits or more (by a cue word too
below 14 digits), phones by an international prefix or a cue word, emails with spaces round a plain at-sign by a cue word,
and key-like runs by a word such as ``token`` just before. Cue words are hidden from the features of the kinds that they label.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jadwal.llm.common import table, text_slices, written
from jadwal.shipping import ship

KINDS = ("email", "ip", "card", "phone", "secret")
TRAIN_SPANS = 2000  # the bound on the distinct candidates of one kind and label that the trees see
BIN, FAR = 16, 12  # bins for each unit of log-odds, and the log-odds of the last bin
PRECISION = 0.95
CONTEXT = 24
DOCS_AT_ONCE = 512

# The contract's kinds of characters and patterns, in forms that never read a run of characters twice. An email is
# found from its sign and widened to both sides, an ip starts where a run of digits starts; both give the leftmost matches.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# What the generators propose besides; no candidate of digits is a part of a longer run of digits.
WIDE_SIGN = re.compile(r" ?(?:@|\(at\)|\[at\]) ?")
WIDE_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?)[A-Za-z0-9-]++)++")
WIDE = {
    "ip": re.compile(r"[0-9]{1,4}(?:(?:\.|[(\[]\.[)\]]| ?(?:\(dot\)|\[dot\]) ?)[0-9]{1,4}){3}"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){11,20}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[\x20.-]?\(?[0-9]{2,4}\)?){2,5}(?![0-9])"),
    "secret": re.compile(r"[A-Za-z0-9_-]{16,}"),
}
KEY_WORDS = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|key|bearer)\W{0,4}$")
TALK_WORDS = re.compile(r"(?i)(?:phone|tel|call|mobile|fax|card|visa|mail|contact|addr|host|server|ip)\W{0,4}$")
CUES = {
    "email": re.compile(r"(?i)(?:mail|contact|write to|reach|addr(?:ess)?)\W{0,4}$"),
    "card": re.compile(r"(?i)(?:card|visa|mastercard|amex|maestro|credit)(?: no| number)?\W{0,4}$"),
    "phone": re.compile(r"(?i)(?:phone|tel|telephone|call|mobile|cell|fax)(?: no| number)?\W{0,4}$"),
}
AT, DOT = re.compile(r" ?(?:@|[(\[]at[)\]]) ?"), re.compile(r" ?[(\[](?:dot|\.)[)\]] ?")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def emails(text: str, sign: re.Pattern[str] | str = "@", domain: re.Pattern[str] = DOMAIN) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping (start, end): characters of LOCAL, the sign, a domain."""
    found = re.finditer(sign, text)
    least = 0  # where the local part may start: after the last match and the last sign
    for m in found:
        start = least + len(text[least : m.start()].rstrip(LOCAL))
        end = domain.match(text, m.end()) if least <= m.start() else None
        if end and start < m.start():
            yield start, end.end()
            least = end.end()
        else:
            least = max(least, m.end())


def _ip_fits(s: str) -> bool:
    parts = [p.lstrip("0") or "0" for p in s.split(".")]
    return all(len(p) <= 3 and int(p) <= 255 for p in parts)


def _card_fits(s: str) -> bool:
    d = _digits(s)
    return 14 <= len(d) <= 19 and luhn(d)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start, then kind as listed."""
    out: list[tuple[int, int, str]] = []
    if "@" in text:
        out += [(s, e, "email") for s, e in emails(text)]
    if DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if _ip_fits(m[0])]
        out += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if _card_fits(m[0])]
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Spans that the wide generators propose; they may overlap."""
    if not (DIGIT.search(text) or "@" in text or "at)" in text or "at]" in text):
        return []
    out = [(s, e, "email") for s, e in emails(text, WIDE_SIGN, WIDE_DOMAIN)]
    return out + [(m.start(), m.end(), kind) for kind, pattern in WIDE.items() for m in pattern.finditer(text) if kind != "secret" or DIGIT.search(m[0])]


class Taken:
    """Disjoint intervals of one text in order."""

    def __init__(self, spans: Iterable[tuple[int, int, str]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end, _ in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def free(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i == 0 or self.ends[i - 1] <= start

    def take(self, start: int, end: int) -> None:
        i = bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format and context of a span."""
    s, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + 4]
    d = _digits(s)
    counts = Counter(s)
    entropy = -sum(n / len(s) * math.log2(n / len(s)) for n in counts.values())
    groups = [len(g) for g in re.findall(r"[0-9]+", s)] or [0]
    return [
        KINDS.index(kind), len(s), len(d), sum(c.isalpha() for c in s), len(s) - len(d) - sum(c.isalpha() for c in s), float(luhn(d)) if d else 0.0, s.count("."), s.count("-") + s.count(" "),
        float(s.startswith("+")), float("(" in s), entropy, len(groups), max(groups), min(groups), float(max((int(g[:6]) for g in re.findall(r"[0-9]+", s)), default=0) <= 255), s.rpartition(".")[2].isalpha() * len(s.rpartition(".")[2]),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(all(c in "0123456789abcdef" for c in s)), 0.0 if kind in CUES else float(bool(TALK_WORDS.search(before))), 0.0 if kind == "secret" else float(bool(KEY_WORDS.search(before))), float(before[-1:] in "\"'"), float("=" in before[-4:]),
    ]


def weak_label(text: str, start: int, end: int, kind: str, accepted: set[tuple[int, int, str]]) -> int:
    before, s = text[max(0, start - CONTEXT) : start], text[start:end]
    if kind == "secret":
        return int(bool(KEY_WORDS.search(before)))
    return int((start, end, kind) in accepted or _tolerant_fits(s, kind, kind in CUES and bool(CUES[kind].search(before)), before[-1:] + " " + text[end : end + 1]))


def _tolerant_fits(s: str, kind: str, cued: bool, around: str) -> bool:
    """Whether evidence other than the base rule as it stands speaks for a span; ``around`` has the signs next to it."""
    if kind == "email":
        plain = DOT.sub(".", AT.sub("@", s))
        return next(emails(plain), None) == (0, len(plain)) and len(end := plain.rpartition(".")[2]) >= 2 and end.isalpha() and ("at)" in s or "at]" in s or "dot" in s or cued)
    if kind == "ip":
        plain = DOT.sub(".", s)
        return plain != s and bool(IP.fullmatch(plain)) and _ip_fits(plain)
    d = _digits(s)
    if any(c.isalnum() for c in around):  # a part of a longer run
        return False
    if kind == "card":
        grouped = min(len(g) for g in re.findall(r"[0-9]+", s)) >= 3
        return grouped and luhn(d) and (14 <= len(d) <= 19 or (12 <= len(d) <= 13 and cued))
    if s.startswith("00") and 12 <= len(d) <= 17 and len(d) < len(s):
        return bool(PHONE.fullmatch("+" + s[2:].lstrip()))
    return cued and 7 <= len(d) <= 15


@dataclass
class BoostedTrees:
    """Depth-limited regression trees on logistic loss over binned features."""

    trees: list[list[tuple[int, float, int, int, float]]]
    base: float
    rate: float

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, least: int = 5, bins: int = 32) -> BoostedTrees:
        p0 = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
        model = BoostedTrees([], math.log(p0 / (1 - p0)), rate)
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1) if len(x) else x.astype(int)
        raw = np.full(len(y), model.base)
        for _ in range(rounds if 0 < y.sum() < len(y) else 0):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            nodes: list[tuple[int, float, int, int, float]] = []

            def grow(rows: np.ndarray, level: int) -> int:
                at = len(nodes)
                gs, hs = g[rows].sum(), h[rows].sum()  # noqa: B023
                nodes.append((-1, 0.0, -1, -1, gs / (hs + 1)))  # noqa: B023
                best = (1e-6, -1, -1)
                if level < depth and len(rows) >= 2 * least:
                    for j, e in enumerate(edges):
                        if not len(e):
                            continue
                        gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(e) + 1))[:-1]  # noqa: B023
                        hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(e) + 1))[:-1]  # noqa: B023
                        nl = np.cumsum(np.bincount(binned[rows, j], minlength=len(e) + 1))[:-1]
                        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                        gain[(nl < least) | (len(rows) - nl < least)] = 0
                        if gain.max() > best[0]:
                            best = (float(gain.max()), j, int(gain.argmax()))
                if best[1] >= 0:
                    left = binned[rows, best[1]] <= best[2]
                    a = grow(rows[left], level + 1)
                    b = grow(rows[~left], level + 1)
                    nodes[at] = (best[1], float(edges[best[1]][best[2]]), a, b, 0.0)  # noqa: B023
                return at

            grow(np.arange(len(y)), 0)
            model.trees.append(nodes)
            raw += rate * model._one(nodes, x)
        return model

    @staticmethod
    def _one(nodes: list[tuple[int, float, int, int, float]], x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x)), [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            j, cut, a, b, value = nodes[at]
            if j < 0:
                out[rows] = value
            elif len(rows):
                left = x[rows, j] <= cut
                todo += [(a, rows[left]), (b, rows[~left])]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        for nodes in self.trees:
            raw += self.rate * self._one(nodes, x)
        return 1 / (1 + np.exp(-raw))


@dataclass
class SpanModel:
    trees: BoostedTrees
    thresholds: dict[str, float]

    @staticmethod
    def fit(texts: list[str], precision: float = PRECISION) -> SpanModel:
        """Trees from even texts, thresholds from odd ones."""
        even, odd = (rows_of(texts[i::2]) for i in (0, 1))
        model = SpanModel(fit_trees([r.features for r in even], [r.label for r in even]), {})
        free = [r for r in odd if r.free]
        bins = model.bins([r.features for r in free])
        model.calibrate([(r.kind, b, r.label, 1 - r.label) for r, b in zip(free, bins, strict=True)], precision)
        return model

    def bins(self, x: list) -> list[int]:
        """Each candidate's bin of log-odds."""
        p = np.clip(self.trees.predict(as_matrix(x)), 1e-9, 1 - 1e-9)
        return np.clip(np.floor(np.log(p / (1 - p)) * BIN + 1e-6), -FAR * BIN, FAR * BIN).astype(int).tolist()

    def calibrate(self, histogram: list[tuple[str, int, float, float]], precision: float = PRECISION) -> None:
        """For each kind the lowest threshold that keeps ``precision``, from (kind, bin, positives, negatives)."""
        at = lambda edge: float(1 / (1 + np.exp(-edge / BIN)))
        for kind in KINDS:
            sums: dict[int, list[float]] = {}
            for k, b, pos, neg in histogram:
                if k == kind:
                    own = sums.setdefault(b, [0.0, 0.0])
                    own[0], own[1] = own[0] + pos, own[1] + pos + neg
            cut, positives, total = 1.1, 0.0, 0.0
            order = sorted(sums, reverse=True)
            for b, below in zip(order, [*order[1:], None], strict=False):
                positives, total = positives + sums[b][0], total + sums[b][1]
                if total and positives >= precision * total:  # midway to the next score below
                    cut = max(0.5, (at(b) + (0.0 if below is None else at(below + 1))) / 2 - 1e-6)
            self.thresholds[kind] = cut


@dataclass
class Candidate:
    kind: str
    label: int
    free: bool  # overlaps no base span, so it can be added
    h: int
    features: list[float]


def rows_of(texts: list[str]) -> list[Candidate]:
    """The candidates of these texts; equal ones with equal context have equal hashes."""
    out = []
    for text in texts:
        found = candidates(text)
        base = base_spans(text) if found else []
        accepted, taken = set(base), Taken(base)
        for start, end, kind in found:
            key = f"{kind} {start - max(0, start - CONTEXT)} {text[max(0, start - CONTEXT) : end + 4]}".encode("utf-8", "surrogatepass")
            h = int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "big") >> 1
            out.append(Candidate(kind, weak_label(text, start, end, kind, accepted), taken.free(start, end), h, features(text, start, end, kind)))
    return out


def as_matrix(x: list) -> np.ndarray:
    return np.array(x, "f8").reshape(-1, len(features("0", 0, 1, "card")))


def fit_trees(x: list, y: list[int]) -> BoostedTrees:
    return BoostedTrees.fit(as_matrix(x), np.array(y, "f8"))


def all_spans(texts: list[str], model: SpanModel) -> list[tuple[list, list]]:
    """For each text its base spans and all chosen spans, both in order."""
    bases = [base_spans(t) for t in texts]
    found = [(i, c) for i, t in enumerate(texts) for c in candidates(t)]
    p = model.trees.predict(np.array([features(texts[i], *c) for i, c in found], "f8")) if found else []
    chosen, taken = [list(b) for b in bases], [Taken(b) for b in bases]
    for q, i, (start, end, kind) in sorted(((float(q), i, c) for q, (i, c) in zip(p, found, strict=True)), key=lambda r: (-r[0], r[1], r[2])):
        if q >= model.thresholds[kind] and taken[i].free(start, end):
            taken[i].take(start, end)
            chosen[i].append((start, end, kind))
    return [(b, sorted(c, key=lambda s: (s[0], KINDS.index(s[2])))) for b, c in zip(bases, chosen, strict=True)]


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each run of overlapping spans becomes its first kind in brackets."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][1])
        out += [text[at:start], f"[{kind.upper()}]"]
        at, i = end, i + 1
    return "".join(out) + text[at:]


def candidate_rows(docs: DataFrame) -> DataFrame:
    """kind, label, free, h and features of every candidate in the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 0, DOCS_AT_ONCE):
                rows = rows_of([t or "" for t in part.column(0).to_pylist()])
                columns = [pa.array([getattr(r, name) for r in rows], kind) for name, kind in fields]
                yield pa.RecordBatch.from_arrays(columns, [name for name, _ in fields])

    fields = [("kind", pa.string()), ("label", pa.int32()), ("free", pa.bool_()), ("h", pa.int64()), ("features", pa.list_(pa.float64()))]
    ship(docs.sparkSession)
    return docs.select("text").mapInArrow(work, "kind string, label int, free boolean, h long, features array<double>")


def _histogram(rows: DataFrame, model: SpanModel) -> DataFrame:
    """kind, bin, label and how many candidates: few rows for each batch, then added up."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            counts = Counter(zip(kinds, shared.value.bins(batch.column(2).to_pylist()), labels, strict=True))
            columns = [pa.array([key[i] for key in counts], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts.values(), pa.int64())], ["kind", "bin", "label", "n"])

    out = rows.select("kind", "label", "features").mapInArrow(work, "kind string, bin int, label int, n long")
    return out.groupBy("kind", "bin", "label").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, n: int = TRAIN_SPANS) -> SpanModel:
    """Trees from about ``n`` distinct candidates of each kind, label and freedom; thresholds from all documents.

    The sample has the smallest hashes among the even ones, so that rare kinds and labels are in it whatever else the
    corpus holds. Every other candidate that could be added is scored and counted. The counts of a kind and label are
    raised by the share that the trees have seen, so that precision is that of all documents.
    """
    rows = written(candidate_rows(docs), "pii-candidates")
    group = ["kind", "label", "free"]
    even = F.col("h") % 2 == 0
    sizes = rows.groupBy(*group).agg(F.approx_count_distinct(F.when(even, F.col("h"))).alias("d"), F.count("*").alias("total")).collect()
    drawn = F.lit(False)
    for r in sizes:
        cut = min(2**63 - 1, 2**63 * n // max(1, r["d"]))
        drawn = drawn | ((F.col("kind") == r["kind"]) & (F.col("label") == r["label"]) & (F.col("free") == r["free"]) & (F.col("h") <= F.lit(cut).cast("long")))
    drawn = even & drawn
    sample = rows.where(drawn).groupBy(*group, "h").agg(F.first("features").alias("features")).orderBy(*group, "h").collect()
    model = SpanModel(fit_trees([r["features"] for r in sample], [r["label"] for r in sample]), {})
    counted = [tuple(r) for r in _histogram(rows.where(F.col("free") & ~drawn), model).collect()]
    unseen = Counter()
    for kind, _, label, m in counted:
        unseen[kind, label] += m
    raised = {(r["kind"], r["label"]): r["total"] / max(1, unseen[r["kind"], r["label"]]) for r in sizes if r["free"]}
    model.calibrate([(k, b, m * raised[k, y] * y, m * raised[k, y] * (1 - y)) for k, b, y, m in counted])
    return model


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, model: SpanModel) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans as text, and the redacted text.

    Null texts count as empty; every row gives one row, repeated rows too. Other columns are ignored. Texts of any length
    are read whole, in time in proportion to their length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1, DOCS_AT_ONCE):
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = all_spans(texts, shared.value)
                counts = [Counter(k for _, _, k in base) for base, _ in found]
                columns = [part.column(0), *[pa.array([c[k] for c in counts], pa.int64()) for k in KINDS[:4]]]
                columns.append(pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string()))
                columns.append(pa.array([_joined(spans) for _, spans in found], pa.string()))
                columns.append(pa.array([redact(t, spans) if spans else None for t, (_, spans) in zip(texts, found, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(work, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string")


def redact_documents(docs: DataFrame, model: SpanModel) -> DataFrame:
    """``docs`` with the spans in ``text`` replaced; ``n_chars`` follows where there is one. Null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, at, DOCS_AT_ONCE):
                texts = part.column(at).to_pylist()
                found = all_spans([t or "" for t in texts], shared.value)
                clean = [t if not spans else redact(t, spans) for t, (_, spans) in zip(texts, found, strict=True)]
                yield part.set_column(at, part.schema.field(at), pa.array(clean, part.schema.field(at).type))

    ship(docs.sparkSession)
    out = docs.mapInArrow(work, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs)).drop("redacted")
