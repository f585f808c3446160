"""Personal data by weak supervision.

Candidate spans come from the base patterns and from wider ones (spelled-out
addresses, numbers that fail a check, local phone numbers, credentials). Six
labelers vote on each candidate: yes, no or nothing. Expectation-maximisation over
the counts of vote patterns of *all* candidates estimates, for each labeler, how
it votes on personal data and on other text; the posteriors then train a logistic
span classifier on features that no labeler returns. Base spans always stay; a
wider candidate is added when the classifier says yes and no base span overlaps.

Vote patterns and features are small fixed domains, so what the driver fits on is
bounded by their product, not by the corpus.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huescope.llm.common import arrow_map, pick, stored, text_or_empty

BASE = ("email", "ip", "card", "phone")
#: Kinds in the order of the result; the last four are found by the method only.
KINDS = (*BASE, "spelled_email", "local_phone", "id_number", "credential")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match that can't start inside a run of digits starts at its beginning: same matches, linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELLED = re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?:(?: ?[\[(] ?dot ?[\])] ?|\.)[A-Za-z0-9-]{1,63})+")
_LOCAL_PHONE = re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])")
_ID_NUMBER = re.compile(r"(?<![\w.-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7})(?![\w-])")
_CREDENTIAL = re.compile(
    r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}"
    r"|(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b ?[:=] ?)[\"']?[^\s,;\"']{6,}"
)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each ``@`` outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _ip_fits(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def base_and_failed(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans in order of kind and start; and the matches that failed their check."""
    good = [("email", a, b) for a, b in _emails(text)]
    failed: list[tuple[str, int, int]] = []
    if _has_digit(text):
        for kind, pattern, fits in (
            ("ip", _IP, _ip_fits),
            ("card", _CARD, lambda t: 16 <= len(_digits(t)) <= 19 and _luhn(_digits(t))),
            ("phone", _PHONE, lambda t: 8 <= len(_digits(t)) <= 15),
        ):
            for m in pattern.finditer(text):
                if fits(m[0]):
                    good.append((kind, *m.span()))
                elif kind != "card" or 13 <= len(_digits(m[0])) <= 19:
                    failed.append((kind, *m.span()))
    return good, failed


_has_digit = re.compile("[0-9]").search

#: Country calling codes, card issuer prefixes, top-level domains and key names: the gazetteer.
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "358", "380", "420")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "62")
ENDINGS = frozenset("com org net edu gov io co de fr es it nl uk us ca au info biz eu ch at be se no".split())
CUES = re.compile(
    r"(?i)\b(?:e-?mail|mail|contact|call|phone|tel|fax|mobile|ip|host|server|address|card|visa|pay|account|ssn|iban|login|user|password|passwd|pwd|secret|token|key|write to)\b"
)
AGAINST = re.compile(r"(?i)\b(?:version|licen[cs]e|v|cc|section|chapter|page|figure|table|isbn|issn|doi|rfc|item|no)\b[\s.:#-]*$")
#: Votes (-1, 0, 1) of each labeler taken as seen on other text and on personal data.
BELIEF = np.array([[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]])
LABELERS = ("format", "gazetteer", "cue", "against", "bounds", "variety")


@dataclass
class Candidate:
    kind: str
    start: int
    end: int
    base: bool
    votes: tuple[int, ...]
    features: tuple[int, ...]


def candidates(text: str) -> list[Candidate]:
    """All candidate spans of a whole text, base ones first, each kind by start."""
    good, failed = base_and_failed(text)
    wider = list(failed)
    if "@" not in text and not _has_digit(text) and "=" not in text and ":" not in text and "at" not in text:
        return []
    if "(" in text or "[" in text:
        wider += [("spelled_email", *m.span()) for m in _SPELLED.finditer(text)]
    if _has_digit(text):
        wider += [("local_phone", *m.span()) for m in _LOCAL_PHONE.finditer(text)]
        wider += [("id_number", *m.span()) for m in _ID_NUMBER.finditer(text)]
        wider += [("credential", *m.span()) for m in _CREDENTIAL.finditer(text)]
    elif "=" in text or ":" in text:
        wider += [("credential", *m.span()) for m in _CREDENTIAL.finditer(text)]
    found = [Candidate(k, a, b, True, vote(text, k, a, b, True), describe(text, k, a, b)) for k, a, b in good]
    return found + [Candidate(k, a, b, False, vote(text, k, a, b, False), describe(text, k, a, b)) for k, a, b in wider]


def vote(text: str, kind: str, start: int, end: int, fits: bool) -> tuple[int, ...]:
    """What each labeler says of a span: 1 personal, -1 not, 0 nothing."""
    span, digits = text[start:end], _digits(text[start:end])
    before = text[max(0, start - 40) : start]
    left, right = text[start - 1 : start], text[end : end + 1]
    if kind == "id_number":
        fits = span[0].isdigit() and not span.startswith(("000", "666", "9")) or _iban_fits(span)
    elif kind in ("spelled_email", "local_phone", "credential"):
        fits = True
    if kind in ("email", "spelled_email"):
        known = re.split(r"[\s.\])]+", span.rstrip("])").lower())[-1] in ENDINGS
    elif kind == "phone":
        known = digits.startswith(CALLING)
    elif kind == "card":
        known = digits.startswith(ISSUERS)
    elif kind == "ip":
        known = digits[0] not in "0" and not span.startswith(("0.", "1.0.", "2.0."))
    else:
        known = kind == "credential"
    tight = bool(left) and (left.isalnum() or left in "._-") or bool(right) and (right.isalnum() or right in "_-")
    different = len(set(digits or span))
    return (
        1 if fits else -1,
        1 if known else -1,
        1 if CUES.search(before) or (kind == "credential" and CUES.search(span)) else 0,
        -1 if AGAINST.search(before) else 0,
        -1 if tight else 1,
        1 if different >= 4 else -1 if different <= 2 else 0,
    )


def _iban_fits(span: str) -> bool:
    compact = span.replace(" ", "")
    if not compact[:2].isalpha():
        return False
    moved = "".join(str(int(c, 36)) for c in compact[4:] + compact[:4])
    return int(moved) % 97 == 1


def describe(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """Small categories of a span: kind, length, share of digits, neighbours."""
    span = text[start:end]
    share = len(_digits(span)) / len(span)

    def side(c: str) -> int:
        return 0 if not c or c.isspace() else 1 if c in ".,;:!?)(\"'" else 2

    return (
        KINDS.index(kind),
        min(5, len(span).bit_length()),
        int(share * 3.999),
        side(text[start - 1 : start]),
        side(text[end : end + 1]),
    )


#: Number of categories of each feature in ``describe``.
WIDTHS = (len(KINDS), 6, 4, 3, 3)


@dataclass
class SpanModel:
    """Labelers' estimated votes and the classifier's weights."""

    prior: float
    votes: np.ndarray  # [class, labeler, vote + 1]
    weights: np.ndarray

    def probability(self, features: tuple[int, ...]) -> float:
        total = self.weights[-1] + sum(self.weights[i] for i in _places(features))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, total))))


def _places(features: tuple[int, ...]) -> list[int]:
    offsets = np.concatenate([[0], np.cumsum(WIDTHS)[:-1]])
    return [int(o) + f for o, f in zip(offsets, features)]


def estimate_reliabilities(patterns: dict[tuple[int, ...], int], rounds: int = 100) -> tuple[float, np.ndarray]:
    """EM over vote patterns: the share of personal data and P(vote | class) of each labeler.

    Starts from the majority of the votes. ``BELIEF`` counts as votes seen before:
    labelers are right more often than not, so the classes keep their meaning when
    one of them is rare.
    """
    votes = np.array(list(patterns), dtype=int).reshape(-1, len(LABELERS))
    counts = np.array(list(patterns.values()), dtype=float)
    yes = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1)))
    table = np.zeros((2, len(LABELERS), 3))
    prior = 0.5
    for _ in range(rounds):
        for c, weight in ((1, yes * counts), (0, (1 - yes) * counts)):
            for j in range(len(LABELERS)):
                table[c, j] = np.bincount(votes[:, j] + 1, weight, minlength=3) + BELIEF[c]
        table /= table.sum(axis=2, keepdims=True)
        prior = float((yes @ counts + 1) / (counts.sum() + 2))
        new = posterior(votes, prior, table)
        if np.abs(new - yes).max(initial=0) < 1e-9:
            break
        yes = new
    return prior, table


def posterior(votes: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    """P(personal | votes) for rows of votes."""
    odds = np.full(len(votes), math.log(prior / (1 - prior)))
    for j in range(len(LABELERS)):
        odds += np.log(table[1, j, votes[:, j] + 1] / table[0, j, votes[:, j] + 1])
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def train_classifier(features: np.ndarray, target: np.ndarray, counts: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on weighted soft targets by Newton's method; the last weight is the bias."""
    x = np.zeros((len(features), sum(WIDTHS) + 1))
    x[:, -1] = 1
    for i, row in enumerate(features):
        x[i, _places(tuple(row))] = 1
    weights = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (counts * (p - target)) + ridge * weights
        curve = (x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


SPANS = "array<struct<kind:string,first:int,last:int,base:boolean,votes:array<int>,features:array<int>>>"


def candidate_rows(docs: DataFrame) -> DataFrame:
    """doc_id and the candidate spans of every document's whole text."""
    texts = pick(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in incoming:
            yield doc_id, [
                {"kind": c.kind, "first": c.start, "last": c.end, "base": c.base, "votes": c.votes, "features": c.features}
                for c in candidates(text)
            ]

    return arrow_map(texts, rows, f"doc_id {kind}, spans {SPANS}", 5000)


def fit_spans(found: DataFrame) -> SpanModel:
    """Fit on all rows of ``candidate_rows``; without candidates nothing is added."""
    span = found.select(F.explode("spans").alias("s"))
    groups = span.groupBy(F.col("s.votes").alias("votes"), F.col("s.features").alias("features")).count().collect()
    if not groups:
        return SpanModel(0.5, np.full((2, len(LABELERS), 3), 1 / 3), np.zeros(sum(WIDTHS) + 1) - 1)
    groups = sorted((tuple(r["votes"]), tuple(r["features"]), r["count"]) for r in groups)
    patterns: dict[tuple[int, ...], int] = {}
    for votes, _, count in groups:
        patterns[votes] = patterns.get(votes, 0) + count
    prior, table = estimate_reliabilities(patterns)
    target = posterior(np.array([v for v, _, _ in groups]), prior, table)
    counts = np.array([c for _, _, c in groups], dtype=float)
    return SpanModel(prior, table, train_classifier(np.array([f for _, f, _ in groups]), target, counts))


def chosen_spans(spans: list[dict], model: SpanModel) -> tuple[list[tuple], list[tuple]]:
    """Base spans; and all spans: base ones and added ones that overlap no other, by kind and start."""
    base = [(s["kind"], s["first"], s["last"]) for s in spans if s["base"]]
    taken = sorted((a, b) for _, a, b in base)
    added = []
    for s in sorted((s for s in spans if not s["base"]), key=lambda s: (s["first"], -s["last"], KINDS.index(s["kind"]))):
        a, b = s["first"], s["last"]
        free = all(b <= x or a >= y for x, y in taken) if len(taken) < 50 else _free(taken, a, b)
        if free and model.probability(tuple(s["features"])) >= 0.5:
            added.append((s["kind"], a, b))
            taken = sorted([*taken, (a, b)]) if len(taken) < 50 else _insert(taken, a, b)
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + added, key=lambda s: (order[s[0]], s[1]))


def _free(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Base spans of different kinds may overlap, so all that start before the end count."""
    return not any(x < b and a < y for x, y in taken)


def _insert(taken: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
    taken.append((a, b))
    return taken


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document.

    Null text counts as empty. Repeated rows count each; empty input gives no rows;
    further columns are ignored. Offsets are code points, ends exclusive.
    """
    found = stored(candidate_rows(docs), "span-candidates")
    model = fit_spans(found)
    kind = found.schema["doc_id"].dataType.simpleString()

    def rows(incoming: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, spans in incoming:
            base, every = chosen_spans(spans, model)
            counts = [sum(1 for s in base if s[0] == k) for k in BASE]
            yield doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)

    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return arrow_map(found, rows, schema, 5000)


def redact_text(text: str, model: SpanModel) -> str:
    """The text with every chosen span replaced by its kind in angle brackets; overlaps as one."""
    spans = [
        {"kind": c.kind, "first": c.start, "last": c.end, "base": c.base, "features": c.features} for c in candidates(text)
    ]
    if not spans:
        return text
    parts, done = [], 0
    for kind, a, b in sorted(chosen_spans(spans, model)[1], key=lambda s: (s[1], -s[2])):
        if a >= done:
            parts += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join([*parts, text[done:]])


def redact(docs: DataFrame) -> DataFrame:
    """All documents with their columns; personal data in ``text`` replaced, ``n_chars`` (if any) recounted.

    A null text stays null.
    """
    import pyarrow as pa

    model = fit_spans(stored(candidate_rows(docs), "span-candidates"))
    places = [f"_c{i}" for i in range(len(docs.columns))]
    numbered = docs.toDF(*places)
    text_at = docs.columns.index("text")
    size_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                texts = [None if t is None else redact_text(t, model) for t in part.column(text_at).to_pylist()]
                columns = list(part.columns)
                columns[text_at] = pa.array(texts, part.schema.field(text_at).type)
                if size_at is not None:
                    sizes = [None if t is None else len(t) for t in texts]
                    columns[size_at] = pa.array(sizes, pa.int64()).cast(part.schema.field(size_at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)
