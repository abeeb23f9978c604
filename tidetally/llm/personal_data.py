"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a classifier decides.

Base spans are found by patterns and simple checks (``base_spans``). Candidates
are wider: other spellings, and what a base match that failed has swallowed, such
as a phone number that a card number follows. Six labelers vote for or against a
candidate or abstain: the base pattern, its form, its numbers (checksum, ranges),
a gazetteer (domains, issuers, calling codes, networks), the words around it, and
what touches it. Nothing is labelled by hand: expectation-maximisation takes the
true answer as unseen and estimates for each kind how often it is yes and how each
labeler votes given either answer. The answers so expected train a logistic
classifier on a candidate's evidence and shape, without the base pattern's vote,
so that it can find what the patterns miss. Candidates that it accepts and that
touch no base span are added; of two that overlap the likelier stays.

All texts take part in the estimates, whole. What they gather is a count for each
combination of votes and shape: at most ``4 * 3**6 * 24`` rows, whatever the
input, which is what the driver sees. Texts are read twice and never shuffled.

Rows: a null text is empty; a row without spans has zero counts and an empty list;
repeated rows and ids keep their rows, and each counts in the estimates; an empty
table gives no rows; further columns are ignored. Work is linear in a text's
length, also for very long runs of digits or letters.
"""

import hashlib
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidetally.llm.batches import column, record

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "form", "numbers", "gazetteer", "context", "touching")

#: A candidate is added if the classifier gives it at least this.
ACCEPT = 0.8
#: Characters read on either side of a candidate for its context.
AROUND = 40
ROUNDS = 200

#: Made-up votes (no, none, yes) that the estimates begin with, given the answer no and yes.
#: Labelers are rather right than wrong; numbers that can't be right almost rule a span out.
USUAL = ((4.0, 3.0, 1.0), (1.0, 3.0, 4.0))
BELIEFS = {"numbers": ((5.0, 2.0, 3.0), (0.05, 0.5, 9.45))}

# The base patterns' parts.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Gazetteers and context words.
TOP_DOMAINS = frozenset(
    "com org net edu gov mil int info biz io co us uk de fr es it nl be ch at se no dk fi pl pt ru ua "
    "cn jp kr in br mx ar ca au nz za eu".split()
)
CALLING_CODES = tuple(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 "
    "65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 234 254 351 352 353 354 355 356 357 358 "
    "359 370 371 372 373 374 375 380 381 385 386 420 421 852 886 961 962 963 964 965 966 971 972".split()
)
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|64[4-9]|65|35|30[0-5]|36|3[89]|50|5[6-9]|6[0-9]")
WORDS = {
    "email": frozenset("mail email e-mail contact address write correo courriel adresse kontakt from to".split()),
    "ip": frozenset("ip host server address node gateway proxy client adresse servidor serveur".split()),
    "card": frozenset("card visa mastercard amex credit debit payment karte carte tarjeta pay".split()),
    "phone": frozenset("phone call tel telephone mobile cell fax telefon téléphone teléfono contact".split()),
}
AGAINST = frozenset(
    "version v isbn issn token key hash sha md5 id password section license licence chapter commit build".split()
)

# Candidates that the base patterns do not give.
WIDE = {
    "email": (
        re.compile(
            r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}[\x20]?[\[(][\x20]?at[\x20]?[\])][\x20]?"
            r"[A-Za-z0-9-]{1,63}(?:(?:\.|[\x20]?[\[(][\x20]?dot[\x20]?[\])][\x20]?)[A-Za-z0-9-]{1,63}){1,4}"
        ),
    ),
    "ip": (
        re.compile(r"(?<![0-9])[0-9]{1,6}(?:\.[0-9]{1,6}){3}(?![0-9])"),
        re.compile(r"(?<![0-9])[0-9]{1,3}(?:[\[(]\.[\])][0-9]{1,3}){3}(?![0-9])"),
    ),
    "card": (
        re.compile(r"(?<![0-9])[0-9]{12,19}(?![0-9])"),
        re.compile(r"(?<![0-9])[0-9]{4}([\x20.-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?![0-9])"),
        re.compile(r"(?<![0-9])[0-9]{4}([\x20.-])[0-9]{6}\1[0-9]{4,5}(?![0-9])"),
    ),
    "phone": (
        re.compile(
            r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{3,4}(?![0-9])"
        ),
        re.compile(r"(?<![0-9+])\([0-9]{3}\)[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
        re.compile(r"(?<![0-9+])[0-9]{3}([\x20.-])[0-9]{3}\1[0-9]{4}(?![0-9])"),
    ),
}
_HIDDEN_AT = re.compile(r"[\[(]\x20?at\x20?[\])]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_][\w-]*")
_FORM = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,62}@([A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,}"),
    "ip": re.compile(r"(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}"),
    "card": re.compile(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}"),
    "phone": re.compile(
        r"\+[0-9]{1,3}[ .-]?(\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3}[ .-]?[0-9]{3,4}"
        r"|\([0-9]{3}\) ?[0-9]{3}[.-][0-9]{4}"
    ),
}

_PATTERNS = {"ip": IP, "card": CARD, "phone": PHONE}

Span = tuple[int, int, int]  # start, kind, end: sorts as spans are listed


def luhn(digits: str) -> bool:
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + at % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _parts_fit(text: str) -> bool:
    """Whether the parts are at most 255; they may have any number of zeros before."""
    parts = [p.lstrip("0") for p in text.split(".")]
    return all(len(p) < 4 and int(p or "0") <= 255 for p in parts)


def _card_fits(text: str) -> bool:
    digits = _digits(text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the base pattern, found from each @ so that no run is read twice."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        else:
            free = at + 1  # what lies before belongs to no later match
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """The base patterns' matches that pass their checks, in listed order."""
    spans = [(start, 0, end) for start, end in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        spans += [(m.start(), 1, m.end()) for m in IP.finditer(text) if _parts_fit(m.group())]
        spans += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if _card_fits(m.group())]
        spans += [
            (m.start(), 3, m.end())
            for m in PHONE.finditer(text)
            if 9 <= len(_digits(m.group())) <= 15
        ]
    return sorted(spans)


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Base spans and those of the wider patterns."""
    found = set(base)
    if "@" in text:
        # Addresses on a host without a dot: seldom personal, and so what speaks against.
        for m in re.finditer(r"@[A-Za-z0-9-]++(?![.@])", text):
            start = m.start()
            while start > 0 and m.start() - start < 64 and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                found.add((start, 0, m.end()))
    if _HIDDEN_AT.search(text):
        found.update((m.start(), 0, m.end()) for p in WIDE["email"] for m in p.finditer(text))
    if _DIGIT.search(text):
        for kind in (1, 2, 3):
            for pattern in WIDE[KINDS[kind]]:
                found.update((m.start(), kind, m.end()) for m in pattern.finditer(text))
    return sorted(found)


def _numbers(kind: str, span: str) -> int:
    if kind == "email":
        local, _, domain = span.partition("@")
        if not domain:
            return 0
        good = len(local) <= 64 and local[0] != "." != local[-1] and ".." not in span
        return 1 if good and all(0 < len(p) < 64 and "-" not in (p[0], p[-1]) for p in domain.split(".")) else -1
    if kind == "ip":
        return 1 if _parts_fit(re.sub(r"[\[\]()]", "", span)) else -1
    if kind == "card":
        return 1 if _card_fits(span) else -1
    return 1 if 10 <= len(_digits(span)) <= 15 else -1


def _gazetteer(kind: str, span: str) -> int:
    if kind == "email":
        return 1 if re.split(r"[^A-Za-z0-9-]+", span.rstrip(")]"))[-1].lower() in TOP_DOMAINS else -1
    digits = _digits(span)
    if kind == "ip":
        first = span.split(".")[0].strip("[(")
        if len(first) > 3:
            return -1
        return -1 if int(first) in (0, 127) or int(first) >= 224 else 1
    if kind == "card":
        return 1 if ISSUERS.match(digits) else -1
    if span[0] == "+":
        return 1 if digits.startswith(CALLING_CODES) else -1
    return 0


def _context(kind: str, text: str, start: int, end: int) -> int:
    near = text[max(0, start - AROUND) : start] + " " + text[end : end + AROUND]
    words = {w.lower() for w in _WORD.findall(near)}
    return bool(words & WORDS[kind]) - bool(words & AGAINST)


def _touching(text: str, start: int, end: int) -> int:
    before, after = text[start - 1 : start], text[end : end + 1]
    if any(c.isalnum() or c in "_=/#" for c in before + after):
        return -1
    ends = all(not c or c.isspace() or c in "()[]<>,;:.!?|\"'" for c in (before, after))
    return 1 if ends else 0


def votes(text: str, span: Span, base: bool) -> tuple[int, ...]:
    """The labelers' votes: 1, -1, or 0 for none.

    The base pattern votes against what it matches as a whole and its check refuses.
    """
    start, number, end = span
    kind, own = KINDS[number], text[start:end]
    refused = not base and kind in _PATTERNS and bool(_PATTERNS[kind].fullmatch(own))
    return (
        base - refused,
        1 if _FORM[kind].fullmatch(own) else -1,
        _numbers(kind, own),
        _gazetteer(kind, own),
        _context(kind, text, start, end),
        _touching(text, start, end),
    )


def shape(own: str) -> int:
    """One of 24: length, separators, variety."""
    length = sum(len(own) >= n for n in (13, 17, 30))
    separators = sum(not c.isalnum() for c in own)
    return length * 6 + (separators > 0) * 2 + (separators > 3) * 2 + (len(set(own)) > 5)


def _coded(kind: int, own: tuple[int, ...], form: int) -> int:
    code = kind
    for vote in own:
        code = code * 3 + vote + 1
    return code * 24 + form


def _decoded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, votes (0 to 2) and shapes."""
    forms, rest = codes % 24, codes // 24
    columns = []
    for _ in LABELERS:
        columns.append(rest % 3)
        rest = rest // 3
    return rest, np.column_stack(columns[::-1]), forms


def expectation(
    own: np.ndarray, counts: np.ndarray, labelers: tuple[str, ...] = LABELERS, rounds: int = ROUNDS
) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of yes, reliabilities, answer expected for each row) by expectation-maximisation.

    ``own`` holds votes from 0 (no) to 2 (yes) by row and labeler, ``counts`` how
    often each row occurs. Reliabilities are the chances of each vote given no and
    yes, by labeler. The first answers are those of ``BELIEFS`` alone.
    """
    one_hot = np.eye(3)[own]  # row, labeler, vote
    believed = np.array([BELIEFS.get(name, USUAL) for name in labelers]).transpose(1, 0, 2)
    share, seen, yes = 0.5, believed, np.full(len(own), 0.5)
    for _ in range(rounds):
        chances = seen / seen.sum(axis=2, keepdims=True)
        logs = np.einsum("rlv,clv->cr", one_hot, np.log(chances))
        odds = logs[1] - logs[0] + np.log(share) - np.log1p(-share)
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        moved, yes = np.abs(new - yes).max(initial=0), new
        weights = np.stack([counts * (1 - yes), counts * yes])
        seen = np.einsum("cr,rlv->clv", weights, one_hot) + believed
        share = (weights[1].sum() + 1) / (counts.sum() + 2)
        if moved < 1e-10:
            break
    return float(share), chances, yes


def evidence(own: np.ndarray, forms: np.ndarray) -> np.ndarray:
    """The classifier's inputs: all votes but the pattern's, and the shape, as ones and zeros."""
    parts = [np.eye(3)[own[:, k]] for k in range(1, own.shape[1])]
    parts += [np.eye(4)[forms // 6], np.eye(3)[forms % 6 // 2], np.eye(2)[forms % 2]]
    return np.column_stack([*parts, np.ones(len(own))])


def fit(
    x: np.ndarray, yes: np.ndarray, counts: np.ndarray, begin: np.ndarray, steps: int = 50
) -> np.ndarray:
    """Weights of a logistic classifier for expected answers, by Newton's method.

    They are lightly held to ``begin``, so that evidence no candidate shows keeps its say.
    """
    w, held = begin.copy(), np.full(len(begin), 0.1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts * (p - yes)) + held * (w - begin)
        bend = (x * (counts * p * (1 - p))[:, None]).T @ x + np.diag(held)
        move = np.linalg.solve(bend, slope)
        w -= np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    """By kind: share of yes, chances of each labeler's votes given no and yes, weights."""

    shares: dict[int, float]
    reliabilities: dict[int, np.ndarray]
    weights: dict[int, np.ndarray]

    def chance(self, kind: int, own: tuple[int, ...], form: int) -> float:
        """How likely the classifier holds a candidate for personal data."""
        if kind not in self.weights:
            return 0.0
        x = evidence(np.array([own]) + 1, np.array([form]))
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights[kind], -30, 30)))[0])


def learn(docs: DataFrame) -> Model:
    """Estimates and classifier from the candidates of all texts."""
    schema = pa.schema([("code", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()  # no more keys than there are combinations
        for batch in batches:
            for text in _texts(batch):
                base = base_spans(text)
                known = set(base)
                for span in candidates(text, base):
                    own = votes(text, span, span in known)
                    seen[_coded(span[1], own, shape(text[span[0] : span[2]]))] += 1
        yield record(schema, list(seen), list(seen.values()))

    counted = docs.select("text").mapInArrow(count, "code long, n long")
    rows = counted.groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    codes, counts = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
    kinds, own, forms = _decoded(codes)
    shares, reliabilities, weights = {}, {}, {}
    for kind in sorted(set(kinds.tolist())):
        mine = kinds == kind
        share, chances, yes = expectation(own[mine], counts[mine])
        shares[kind], reliabilities[kind] = share, chances
        ratios = np.log(chances[1] / chances[0])[1:].ravel()
        begin = np.concatenate([ratios, np.zeros(9), [np.log(share / (1 - share))]])
        weights[kind] = fit(evidence(own[mine], forms[mine]), yes, counts[mine], begin)
    return Model(shares, reliabilities, weights)


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    """One text at a time; null is empty."""
    own = batch.column(batch.schema.get_field_index("text"))
    for at in range(batch.num_rows):
        yield own[at].as_py() or ""


def added_spans(text: str, base: list[Span], model: Model, known: dict | None = None) -> list[Span]:
    """Candidates that the classifier accepts, apart from base spans and from each other."""
    known = {} if known is None else known
    taken = [(s[0], s[2]) for s in base]
    ranked = []
    have = set(base)
    for span in candidates(text, base):
        if span in have:
            continue
        key = (span[1], votes(text, span, False), shape(text[span[0] : span[2]]))
        chance = known.get(key)
        if chance is None:
            chance = known[key] = model.chance(*key)
        if chance >= ACCEPT:
            ranked.append((-chance, span[0] - span[2], span))
    added = []
    if ranked:
        # Taken places, in order; a candidate is checked against its neighbours only.
        taken.sort()
        merged: list[tuple[int, int]] = []
        for start, end in taken:
            if merged and start < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
            else:
                merged.append((start, end))
        for _, _, span in sorted(ranked):
            at = bisect_left(merged, (span[2], 0))
            if at and merged[at - 1][1] > span[0]:
                continue
            insort(merged, (span[0], span[2]))
            added.append(span)
    return added


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


FOUND = pa.schema(
    [
        ("doc_id", pa.int64()),
        *((f"n_{kind}", pa.int64()) for kind in KINDS),
        ("base_sha256", pa.string()),
        ("spans", pa.string()),
        ("n_added", pa.int64()),
    ]
)


def find(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: base spans counted by kind and digested, all spans listed, and how many were added."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}  # no more keys than there are combinations
        for batch in batches:
            out = []
            for text in _texts(batch):
                base = base_spans(text)
                added = added_spans(text, base, model, known)
                counts = Counter(kind for _, kind, _ in base)
                digest = hashlib.sha256(shown(base).encode()).hexdigest()
                out.append((*(counts[k] for k in range(4)), digest, shown(base + added), len(added)))
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield record(FOUND, column(batch, "doc_id"), *map(list, columns))

    schema = (
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
        "base_sha256 string, spans string, n_added long"
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(mark, schema)


def personal_data(docs: DataFrame) -> DataFrame:
    """Learns from all rows and finds the spans of all rows."""
    return find(docs, learn(docs))
