"""Personal data by fixed patterns and by weak supervision.

E-mail addresses, IPv4 addresses, card and phone numbers are found by fixed patterns. Further spans (credentials and
identifiers) come from weak supervision: every token with a digit, of `MIN_TOKEN` characters or more, and every token of
any length that a gazetteer word with a colon or an equals sign announces, is a candidate where it overlaps no fixed
span; regex, gazetteer and context labelers vote on it; expectation maximisation over the counts of all vote patterns in
the corpus estimates how reliable each labeler is; the resulting probabilities train a logistic classifier on the shape
and the surroundings of the candidates, and that classifier decides.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewatch.llm.batches import by_value, slices

by_value(__name__)

Span = tuple[int, int]

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
MIN_TOKEN = 8

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/-")
_RIGHT = re.compile(r"[A-Za-z0-9_+/-]*")

# Words that announce a credential or a personal number.
GAZETTEER = frozenset(
    "account apikey auth bearer credential iban key login pass passport passwd password pin pwd secret ssn tax token user".split()
)
_FORMATS = re.compile(
    r"[A-Z]{4}[0-9A-Z]{16}|(?:[0-9a-f]{2}){8,}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}|(?:sk|pk|gh[a-z]|xox[a-z])[_-][0-9A-Za-z_-]{16,}"
)
_LAST_WORD = re.compile(r"([A-Za-z]+)[^A-Za-z0-9]{0,4}$")
_SIGN = re.compile(r"[:=]")
_GAP = re.compile(r"[ \"']{0,3}")


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping matches: each domain takes the name before it, back to the last match."""
    found, done = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
            done = m.end()
    return found


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of the fixed kinds, in code points. Matches that fail their check are dropped and not tried again."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if _DIGIT.search(text):
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
                found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def _with_digits(text: str) -> Iterator[Span]:
    """Tokens of ASCII letters, digits and _+/- with a digit, of `MIN_TOKEN` characters or more."""
    done = 0
    for m in _DIGIT.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and text[start - 1] in _TOKEN:
            start -= 1
        done = end = _RIGHT.match(text, m.start()).end()
        if end - start >= MIN_TOKEN:
            yield start, end


def _announced(text: str) -> Iterator[Span]:
    """Tokens of any length and kind after a gazetteer word and a colon or an equals sign."""
    for m in _SIGN.finditer(text):
        word = _LAST_WORD.search(text, max(0, m.start() - 24), m.start())
        if word and word[1].lower() in GAZETTEER:
            start = _GAP.match(text, m.end()).end()
            end = _RIGHT.match(text, start).end()
            if end > start:
                yield start, end


def candidates(text: str, taken: list[Span]) -> Iterator[Span]:
    """Tokens to be voted on, outside the spans already taken."""
    taken, t = sorted(taken), 0
    for start, end in sorted({*_with_digits(text), *_announced(text)}):
        while t < len(taken) and taken[t][1] <= start:
            t += 1
        if not (t < len(taken) and taken[t][0] < end):
            yield start, end


def votes(text: str, span: Span) -> tuple[int, ...]:
    """1 (personal), 0 (not) or -1 (no opinion) of each labeler: formats, gazetteer, context, shape (of longer tokens)."""
    token, before, after = text[span[0] : span[1]], text[max(0, span[0] - 24) : span[0]], text[span[1] : span[1] + 1]
    word = _LAST_WORD.search(before)
    named = bool(word) and word[1].lower() in GAZETTEER
    assigned = before.rstrip(" \"'")[-1:] in ("=", ":") and before[-1:] != ""
    digits = sum(c.isdigit() for c in token)
    mixed = 0 < digits < len(token)
    return (
        1 if _FORMATS.fullmatch(token) else 0,
        1 if named else -1,
        1 if assigned else (0 if after in (".", ",", "") and not mixed else -1),
        1 if mixed and len(token) >= 16 and digits >= len(token) // 8 else (0 if len(token) >= MIN_TOKEN and not mixed or "/" in token else -1),
    )


LABELERS = 4


def features(text: str, span: Span) -> tuple[int, ...]:
    """Small numbers that describe a candidate; few values each, so that all combinations can be counted."""
    token, before = text[span[0] : span[1]], text[max(0, span[0] - 24) : span[0]]
    digits = sum(c.isdigit() for c in token)
    upper = sum("A" <= c <= "Z" for c in token)
    lower = sum("a" <= c <= "z" for c in token)
    word = _LAST_WORD.search(before)
    return (
        min(len(token) // 8, 4),
        4 * digits // len(token),
        2 * (upper > 0) + (lower > 0),
        int(digits + upper + lower == len(token)),
        int(bool(word) and word[1].lower() in GAZETTEER),
        int(before.rstrip(" \"'")[-1:] in ("=", ":")),
        int(all(c in "0123456789abcdef" for c in token)),
    )


FEATURES = (5, 5, 4, 2, 2, 2, 2)


# Every labeler is taken to have been right in eight of ten votes of either kind before any is seen.
PRIOR = np.array([[8.0, 2.0], [2.0, 8.0]])


def reliabilities(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[float, np.ndarray]:
    """Expectation maximisation: the share of personal spans, and for each labeler how often, when it votes at all,
    it says 0 or 1 (last axis) about a span that is not (row 0) or is (row 1) personal. It starts from the majority;
    a labeler without an opinion says nothing about the span."""
    rows = np.array(sorted(patterns), np.int64).reshape(-1, LABELERS)
    count = np.array([patterns[tuple(r)] for r in rows.tolist()], np.float64)
    said = _said(rows)
    score = (rows == 1).sum(axis=1) - (rows == 0).sum(axis=1)
    belief = np.where(score > 0, 0.9, np.where(score < 0, 0.1, 0.5))
    for _ in range(rounds):
        share = (count @ belief + count.sum()) / (3 * count.sum())  # kept from the ends, where few are of one class
        told = np.stack([np.einsum("n,nlv->lv", count * b, said) for b in (1 - belief, belief)], axis=1) + PRIOR
        told /= told.sum(axis=2, keepdims=True)
        belief = _belief(said, share, told)
    return float(share), told


def _said(rows: np.ndarray) -> np.ndarray:
    return np.stack([rows == 0, rows == 1], axis=-1).astype(np.float64)


def _belief(said: np.ndarray, share: float, told: np.ndarray) -> np.ndarray:
    logs = np.einsum("nlv,lcv->nc", said, np.log(told)) + np.log([1 - share, share])
    return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))


def _design(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(rows), 1)), *[np.eye(n)[rows[:, i]] for i, n in enumerate(FEATURES)]], axis=1)


@dataclass
class SpanModel:
    """The classifier's weights; None where the corpus has no candidate."""

    weights: np.ndarray | None
    share: float = 0.0
    told: np.ndarray | None = None

    def wanted(self, keys: list[tuple[int, ...]]) -> list[bool]:
        if self.weights is None or not keys:
            return [False] * len(keys)
        return (_design(np.array(keys, np.int64)) @ self.weights > 0).tolist()


def train(counts: dict[tuple[tuple[int, ...], tuple[int, ...]], int], rounds: int = 25) -> SpanModel:
    """The span model of (votes, features) counts: EM over the votes, then a logistic fit by Newton's method."""
    if not counts:
        return SpanModel(None)
    patterns: Counter = Counter()
    for (vote, _), n in counts.items():
        patterns[vote] += n
    share, told = reliabilities(patterns)
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], np.float64)
    belief = _belief(_said(np.array([v for v, _ in keys], np.int64)), share, told)
    x = _design(np.array([f for _, f in keys], np.int64))
    n /= n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (belief - p)) - 1e-4 * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
    return SpanModel(np.round(w, 9), share, told)


_COUNTS = T.StructType([T.StructField("code", T.StringType()), T.StructField("n", T.LongType())])


def fit(docs: DataFrame, text: str = "text") -> SpanModel:
    """Count all candidates of all documents by votes and features, and train. What reaches the driver is bounded by
    the number of combinations (81 vote patterns by 1,600 feature values), not by the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part in slices(batches):
            for t in part.column(text).to_pylist():
                if t:
                    base = base_spans(t)
                    for span in candidates(t, [s for x in base.values() for s in x]):
                        counts[votes(t, span), features(t, span)] += 1
        codes = [",".join(map(str, (*v, *f))) for v, f in counts]
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.string()), pa.array(counts.values(), pa.int64())], names=["code", "n"])

    counted = docs.select(text).mapInArrow(run, _COUNTS).groupBy("code").agg(F.sum("n").alias("n")).collect()
    rows = [(tuple(map(int, r["code"].split(","))), r["n"]) for r in counted]
    return train({(r[:LABELERS], r[LABELERS:]): n for r, n in rows})


def all_spans(text: str | None, model: SpanModel) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by kind as listed, the model's last, then by start."""
    if not text:
        return []
    base = base_spans(text)
    taken = [s for x in base.values() for s in x]
    more = list(candidates(text, taken))
    wanted = model.wanted([features(text, s) for s in more])
    found = [(k, a, b) for k in KINDS for a, b in base[k]]
    return found + [(SECRET, a, b) for (a, b), w in zip(more, wanted) if w]


SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)


def find_personal_data(docs: DataFrame, text: str = "text", name: str = "pii_spans", model: SpanModel | None = None) -> DataFrame:
    """`docs` with the spans found in each text in column `name` (which replaces a column of that name).

    Null and empty texts have none. Without a `model` one is fitted on all of `docs`.
    """
    model = fit(docs, text) if model is None else model
    docs = docs.drop(name) if name in docs.columns else docs
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in all_spans(t, model)] for t in part.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, kind)], names=[*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, SPANS)]))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets; spans that overlap become one."""
    kept, done = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= done:
            kept += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*kept, text[done:]])


def redact_personal_data(docs: DataFrame, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """`docs` with all personal data replaced; every document stays, `chars` (if there) follows the text."""
    model = fit(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            old = part.column(text).to_pylist()
            spans = [all_spans(t, model) for t in old]
            columns = dict(zip(part.schema.names, part.columns))
            if any(spans):
                new = [redacted(t, s) if s else t for t, s in zip(old, spans)]
                columns[text] = pa.array(new, columns[text].type)
                if chars in columns:
                    counts = [len(t) if s else n for t, s, n in zip(new, spans, columns[chars].to_pylist())]
                    columns[chars] = pa.array(counts, columns[chars].type)
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, docs.schema)
