"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a classifier decides.

Candidates are wide: everything of the shape of an e-mail address, IP address,
payment card, phone number or secret key, also where strict rules fail.
Each candidate gets five votes (for, against, none): strict pattern,
checksum or range, gazetteer, words before it, and its borders. The counts of
each kind's vote patterns (at most kinds x 3^5 of them) cover all rows and are
all that expectation-maximisation needs: it estimates how reliable each
labeler is on each class, and so the probability of every pattern. With those
as soft labels a logistic span classifier is fitted on all candidates, those of
equal features and votes as one weighted group: each Newton step adds up the
groups where they lie and brings only sums to the driver. It then decides on
every candidate of every text.

Strict matches (base spans) always stay; the classifier adds spans where it
sees no base span. Positions are code points, ends exclusive. Nulls count as
empty texts. Each row gives one row, repeated rows and null ids too. With no
candidate at all nothing is added. Only doc_id and text are read, and masking
keeps all other columns.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, staged

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
LABELERS = ("pattern", "checksum", "gazetteer", "context", "border")
EM_ROUNDS = 60
THRESHOLD = 0.5

#: The strict patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Wider candidates.
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63})+")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])")
_KEY = re.compile(r"[A-Za-z0-9_-]{20,}")  # whole runs; those without a digit are left out afterwards
_DIGIT = re.compile(r"[0-9]")
#: Gazetteers.
_TOP_LEVEL = frozenset("com org net edu gov mil int info biz io ai co uk de fr es it nl eu us ca au ch at be se no dk fi pl pt ru jp cn in br mx example test".split())
_CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "358", "380", "420", "971", "972")
_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|3[068]|62")
_KEY_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "pk_", "sk_", "xox", "AIza", "glpat-")
_BEFORE = {
    "email": re.compile(r"mail|contact|write|address|from|to:|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|host|server|addr|from|client|login|ping", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|debit|pay|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"tel|phone|call|fax|mobile|cell|telefon|whatsapp|sms", re.I),
    "secret": re.compile(r"key|token|secret|passw|api|auth|bearer|=\s*[\"']?$", re.I),
}
_AGAINST = re.compile(r"version|section|release|isbn|issn|order|invoice|chapter|figure|build|commit|page", re.I)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        value = ord(c) - 48
        if k % 2:
            value = value * 2 - 9 if value > 4 else value * 2
        total += value
    return total % 10 == 0


def shapes(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, strict) of all strict-pattern matches; strict tells whether the further rules hold too."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((0, start, m.end(), True))
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    for m in _DOTTED.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups, start = m[0].split("."), m.start()
        for k in range(0, len(groups) - 3, 4):
            four = groups[k : k + 4]
            end = start + sum(map(len, four)) + 3
            found.append((1, start, end, all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in four)))
            start = end + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            found.append((2, *m.span(), 16 <= len(digits) <= 19 and _luhn(digits)))
    if "+" in text:
        for m in _PHONE.finditer(text):
            found.append((3, *m.span(), 8 <= sum(c.isdigit() for c in m[0]) <= 15))
    return found


_WORTH = re.compile(r"[0-9@+]|[\[(]at[\])]")


def candidates(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, bool]]]:
    """Base spans (kind, start, end), and all candidates (kind, start, end, base)."""
    if not text or not _WORTH.search(text):
        return [], []
    found = shapes(text)
    base = [(k, s, e) for k, s, e, strict in found if strict]
    wide = [(k, s, e, strict) for k, s, e, strict in found if strict or k != 2 or e - s <= 30]
    wide += [(0, *m.span(), False) for m in _SPELLED.finditer(text)] if "at" in text else []
    wide += [(3, *m.span(), False) for m in _LOCAL_PHONE.finditer(text)]
    wide += [(4, *m.span(), False) for m in _KEY.finditer(text) if _DIGIT.search(m[0]) and not m[0].isdigit()]
    return sorted(base), wide


def votes(text: str, kind: int, start: int, end: int, base: bool) -> list[int]:
    """1 for, -1 against, 0 none, by LABELERS."""
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    before, after = text[max(0, start - 1) : start], text[end : end + 1]
    clear = not (before.isalnum() or before in ("_", ".", "-", "/") and before) and not (after.isalnum() or after == "_")
    left = text[max(0, start - 32) : start]
    context = 1 if _BEFORE[KINDS[kind]].search(left) else -1 if _AGAINST.search(left) else 0
    if kind == 0:
        pattern, top = 1 if base else 0, re.split(r"[.\s\])]+", span)[-1].lower()
        check, known = (1 if 2 <= len(top) <= 24 and top.isalpha() else -1), (1 if top in _TOP_LEVEL else 0)
    elif kind == 1:
        parts = span.split(".")
        pattern = 1 if base else -1
        check = 1 if base and all(p == "0" or p[0] != "0" for p in parts) else -1
        known = -1 if parts[0] in ("0", "127", "255") or all(len(p) == 1 for p in parts) else 0
    elif kind == 2:
        pattern = 1 if 13 <= len(digits) <= 19 else -1
        check = 1 if _luhn(digits) else -1
        known = 1 if _ISSUERS.match(digits) else -1
    elif kind == 3:
        pattern = 1 if base else 0
        check = 1 if 8 <= len(digits) <= 15 else -1
        known = (1 if digits.startswith(_CALLING) else -1) if span[0] == "+" else 0
    else:
        variety = len(set(span))
        pattern = 1 if re.fullmatch(r"[0-9a-f]{32,128}|[0-9A-F]{32,128}", span) or (any(c.isupper() for c in span) and any(c.islower() for c in span)) else 0
        check = 1 if variety >= 10 and len(digits) >= 3 else -1
        known = 1 if span.startswith(_KEY_STARTS) else 0
    return [pattern, check, known, context, 1 if clear else -1]


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """What the span classifier sees: the span and its surroundings, not the votes themselves."""
    span = text[start:end]
    n = max(1, len(span))
    digits = sum("0" <= c <= "9" for c in span)
    left, right = text[max(0, start - 32) : start], text[end : end + 1]
    number = "".join(c for c in span if "0" <= c <= "9")
    one = [0.0] * len(KINDS)
    one[kind] = 1.0
    checked = float(kind == 2 and _luhn(number))
    return [
        *one,
        *(x * (min(n, 64) / 32) for x in one),
        *(x * (digits / n) for x in one),
        checked,
        float(kind == 2 and bool(_ISSUERS.match(number))),
        float(kind == 2 and 16 <= len(number) <= 19),
        float(kind == 1 and all(len(p) <= 3 and int(p or 0) <= 255 for p in span.split("."))),
        float(kind == 1 and all(len(p) == 1 for p in span.split("."))),
        float(kind == 0 and "@" in span),
        float(kind == 3 and span[0] == "+"),
        len(set(span)) / n,
        float(bool(_BEFORE[KINDS[kind]].search(left))),
        float(bool(_AGAINST.search(left))),
        float(left[-1:].isalnum() or left[-1:] in ("_", ".", "/") and bool(left)),
        float(right.isalnum() or right == "_"),
        1.0,
    ]


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Two-class expectation-maximisation of one kind: patterns (p x labelers of -1, 0, 1) and how often each occurs.

    Returns the probability of personal data for each pattern, and the
    labelers' reliabilities as P(vote | class), labeler x class x vote.
    """
    belief = np.clip(0.5 + patterns.sum(axis=1) / (2 * patterns.shape[1]), 0.05, 0.95)
    tables = np.zeros((patterns.shape[1], 2, 3))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - belief), counts * belief])
        prior = (weight.sum(axis=1) + 1) / (weight.sum() + 2)
        score = np.log(prior)[:, None] + np.zeros((2, len(patterns)))
        for j in range(patterns.shape[1]):
            for c in range(2):
                for v in range(3):
                    # a labeler is taken to be better than chance: its prior counts agree with its votes
                    agrees = 2.0 if v - 1 == (1, -1)[c == 0] else 1.0 if v == 1 else 0.5
                    tables[j, c, v] = weight[c][patterns[:, j] == v - 1].sum() + agrees
                tables[j, c] /= tables[j, c].sum()
                score[c] += np.log(tables[j, c, patterns[:, j] + 1])
        belief = 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))
    return belief, tables


def _sums(groups: DataFrame, belief: dict[tuple, float], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curvature of the log likelihood at w over all candidates, without the ridge."""
    width = len(w)

    def run(batches):
        slope, curve = np.zeros(width), np.zeros((width, width))
        for batch in batches:
            x = np.asarray(batch.column("features").flatten(), dtype=np.float64).reshape(-1, width)
            n = batch.column("n").to_numpy().astype(np.float64)
            y = np.array([belief[k, tuple(v)] for k, v in zip(batch.column("kind").to_pylist(), batch.column("votes").to_pylist(), strict=True)])
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope += x.T @ (n * (y - p))
            curve += (x * (n * p * (1 - p))[:, None]).T @ x
        yield pa.RecordBatch.from_arrays([pa.array([slope.tolist()]), pa.array([curve.ravel().tolist()])], ["slope", "curve"])

    parts = groups.mapInArrow(run, "slope array<double>, curve array<double>").collect()
    return sum(np.array(r["slope"]) for r in parts), sum(np.array(r["curve"]) for r in parts).reshape(width, width)


def _logistic(groups: DataFrame, belief: dict[tuple, float], width: int, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression on soft labels by Newton's method over weighted groups."""
    w = np.zeros(width)
    for _ in range(rounds):
        slope, curve = _sums(groups, belief, w)
        step = np.linalg.solve(curve + ridge * np.eye(width), slope - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class SpanModel:
    weights: list[float]
    reliabilities: dict[str, list]

    def accepts(self, text: str, kind: int, start: int, end: int) -> bool:
        return bool(self.weights) and float(np.dot(self.weights, features(text, kind, start, end))) > np.log(THRESHOLD / (1 - THRESHOLD))

    def spans(self, text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans, and all spans: the base ones and what is added, by kind, then start."""
        base, wide = candidates(text)
        if not wide:
            return base, base
        taken = _joined([(s, e) for _, s, e in base])
        more = []
        for kind, start, end, strict in sorted(wide, key=lambda c: (c[1], -c[2], c[0])):
            if strict or more and start < more[-1][2]:
                continue
            if not _touches(taken, start, end) and self.accepts(text, kind, start, end):
                more.append((kind, start, end))
        return base, sorted([*base, *more])


def _joined(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover, in order; none overlap."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _touches(taken: tuple[list[int], list[int]], start: int, end: int) -> bool:
    """Whether a span shares a place with any stretch."""
    starts, ends = taken
    k = bisect_right(ends, start)  # the first that ends after the span's start
    return k < len(starts) and starts[k] < end


def fit(docs: DataFrame) -> SpanModel:
    """Votes over all texts, reliabilities from all vote patterns, the classifier from all candidates."""

    def work():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            kinds, ballots, seen = [], [], []
            for text in part.column("text").to_pylist():
                for kind, start, end, base in candidates(text)[1]:
                    kinds.append(kind)
                    ballots.append(votes(text, kind, start, end, base))
                    seen.append(features(text, kind, start, end))
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(ballots, pa.list_(pa.int32())), pa.array(seen, pa.list_(pa.float64()))], ["kind", "votes", "features"])

        return step

    found = map_slices(docs.select("text"), "text", work, "kind int, votes array<int>, features array<double>")
    groups = staged(found.groupBy("kind", "votes", "features").agg(F.count("*").alias("n")), "groups")
    counted = groups.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()
    belief: dict[tuple, float] = {}
    reliabilities = {}
    for kind in sorted({r["kind"] for r in counted}):
        own = sorted((tuple(r["votes"]), r["n"]) for r in counted if r["kind"] == kind)
        p, tables = estimate(np.array([v for v, _ in own]), np.array([n for _, n in own], dtype=float))
        belief |= {(kind, v): float(b) for (v, _), b in zip(own, p, strict=True)}
        reliabilities[KINDS[kind]] = np.round(tables, 4).tolist()
    if not counted:
        return SpanModel([], reliabilities)
    return SpanModel(_logistic(groups, belief, len(features("1", 0, 0, 1))).tolist(), reliabilities)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_personal_data(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """doc_id, the base spans' counts by kind and digest, and all spans, for each row of docs."""
    model = model or fit(docs)

    def work():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            counts, digests, spans = [], [], []
            for text in part.column("text").to_pylist():
                base, every = model.spans(text)
                counts.append([sum(k == kind for k, _, _ in base) for kind in range(len(BASE_KINDS))])
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(every))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(BASE_KINDS))]
            return pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

        return step

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return map_slices(docs.select("doc_id", "text"), "text", work, schema)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_personal_data(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """docs with the spans of `text` masked and `n_chars`, where there is such a column, recounted for changed texts."""
    model = model or fit(docs)
    has_length = "n_chars" in docs.columns

    def work():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            texts, lengths = part.column("text").to_pylist(), part.column("n_chars").to_pylist() if has_length else []
            for k, text in enumerate(texts):
                spans = model.spans(text)[1]
                if spans:
                    texts[k] = masked(text, spans)
                    if has_length:
                        lengths[k] = len(texts[k])
            new = {"text": texts, "n_chars": lengths}
            return pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name == "text" or f.name == "n_chars" else part.column(f.name) for f in part.schema], part.schema.names)

        return step

    return map_slices(docs, "text", work, docs.schema)
