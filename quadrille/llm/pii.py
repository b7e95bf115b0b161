"""Operator 6: personal data by rules and a linear-chain conditional random field.

Emails, IP addresses, card and phone numbers are found by rules over the whole text.  A conditional
random field over word-shape features adds spans of national phone numbers, social security numbers,
account numbers and secrets; it is trained from the small labelled table below and decoded by Viterbi
in numpy batches.  Its sequences are whole texts: a word's scores are sums over its own features and its
neighbours', taken once for each distinct word and gathered.  Where no other label can beat "outside"
in any run of words, the best path is outside (see ``open_words``); Viterbi decodes the
stretches between such words, which gives the path that it would give over the whole text.  Added spans
that meet one found by rule are dropped.

Defined results: a null text is the empty one and has no spans; very long texts are read whole; offsets
count code points; of labels that score alike the first listed wins; repeated rows repeat; an empty table
gives no rows; other columns are ignored by ``report`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quadrille.llm.common import map_rows, table
from quadrille.llm.crf import Crf, train, viterbi
from quadrille.llm.textops import distinct, word_array

KINDS = ("email", "ip", "card", "phone")
ADDED = ("national", "ssn", "account", "secret")
#: Distinct words whose scores a worker remembers.
KNOWN_WORDS = 200_000

REPORT = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: White space as str.isspace has it.
_SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()])

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = (ord(d) - 48) << (k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """What the rules find, by kind as listed and then by start."""
    out: list[Span] = []
    if "@" in text:
        end = 0
        for m in _AT.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL_SIGNS:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                end = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def _own(word: str) -> tuple[str, ...]:
    """Shape features of one word without the marks around it."""
    core = word.strip("\"'.,;:!?*#$%&<>[]{}|")
    if not core:
        return ("mark",)
    digits = sum("0" <= c <= "9" for c in core)
    if not digits:
        low = core.lower()
        inner = core[1:] != low[1:] and not core.isupper()
        return ("plain", "w=" + low) if len(low) <= 12 else ("plain", "long", f"mixed={inner}", f"joined={not core.isalpha()}")
    alpha = sum(c.isalpha() for c in core)
    shape = re.sub(r"[0-9]+", lambda m: "0" * min(len(m[0]), 6), re.sub(r"[^\W\d_]+", "a", core))
    kind = "hex" if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", core) else "alnum" if re.fullmatch(r"[0-9A-Za-z_+/=-]+", core) else "other"
    size = len(core)
    bucket = next(b for b in (4, 8, 12, 19, 1 << 60) if size <= b)
    return (
        "digits", f"shape={shape if len(shape) <= 16 else 'long'}", f"kind={kind}", f"size={bucket}", f"kind={kind},size={bucket},letters={bool(alpha)}",
        f"count={min(digits, 12)}", f"iban={bool(re.fullmatch(r'[A-Z]{2}[0-9]{2}[0-9A-Z]*', core))}", f"upper={core.isupper()}",
    )


def _features(words: list[str]) -> list[list[str]]:
    own = [_own(w) for w in words]
    edge = ("edge",)
    out = []
    for k in range(len(words)):
        names = list(own[k])
        names += ["-1:" + f for f in (own[k - 1] if k else edge)]
        names += ["+1:" + f for f in (own[k + 1] if k + 1 < len(words) else edge)]
        out.append(names)
    return out


def labelled(seed: int = 7, rows: int = 260) -> list[tuple[list[str], list[str]]]:
    """The labelled table: short sentences with numbers that are personal and numbers that aren't."""
    r = random.Random(seed)

    def d(n: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(n))

    def plain() -> str:
        word = "".join(r.choice("aeioulnrstdmh") for _ in range(r.randint(2, 9) if r.random() < 0.9 else r.randint(10, 28)))
        if r.random() < 0.04:
            word += r.choice(["-", "/", "_", "McA", "://www."]) + word
        return (word.capitalize() if r.random() < 0.1 else word) + r.choice(["", "", "", "", ",", "."])

    def close(word: str) -> str:
        return word + r.choice(["", "", ",", ".", ";"])

    def national() -> list[tuple[str, str]]:
        form = r.choice(["({a}) {b}-{c}", "{a}-{b}-{c}", "{a}.{b}.{c}", "({a}) {b} {c}"]).format(a=d(3), b=d(3), c=d(4))
        words = form.split()
        return [(w, "B-national" if k == 0 else "I-national") for k, w in enumerate([*words[:-1], close(words[-1])])]

    def ssn() -> list[tuple[str, str]]:
        return [(close(f"{d(3)}-{d(2)}-{d(4)}"), "B-ssn")]

    def account() -> list[tuple[str, str]]:
        country = r.choice(["DE", "FR", "ES", "GB", "NL", "IT"])
        if r.random() < 0.5:
            return [(close(country + d(18)), "B-account")]
        return [(country + d(2), "B-account"), *((d(4), "I-account") for _ in range(r.randint(3, 4))), (close(d(4)), "I-account")]

    def secret() -> list[tuple[str, str]]:
        n, kind = r.choice([20, 24, 32, 40, 64]), r.random()
        signs = "0123456789abcdef" if kind < 0.5 else "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" if kind < 0.8 else "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        if r.random() < 0.15:  # letters alone, behind a word that says so
            value = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
            return [*((w, "O") for w in r.choice([["token", "="], ["key:"], ["password", "="], ["secret:"], ["api_key", "="]])), (close(value), "B-secret")]
        value = "a1" + "".join(r.choice(signs) for _ in range(n - 2))
        value = r.choice(["", "", "AKIA", "sk-", "ghp_"]) + value if kind >= 0.5 else value
        lead = r.choice([[], ["token", "="], ["key:"], ["password", "="], ["secret:"], ["api_key", "="]])
        quote = r.choice(['"', "'", ""])
        return [*((w, "O") for w in lead), (close(quote + value + quote), "B-secret")]

    def other() -> list[tuple[str, str]]:
        form = r.choice([d(1), d(2), d(3), d(4), d(5), d(6), d(8), d(10), d(16), "19" + d(2), f"{d(1)}.{d(1)}", f"{d(1)}.{d(2)}.{d(1)}", f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}", f"${d(3)}.{d(2)}", f"{d(2)}%", f"{d(1)},{d(3)}", f"x{d(2)}", f"{d(3)}-{d(3)}", f"v{d(1)}.{d(1)}", f"{d(4)}-{d(4)}", f"a{d(3)}b", f"({d(2)})", f"[{d(1)}]", f"{d(3)}.{d(2)}.{d(3)}.{d(2)}", f"user{d(2)}@mail{d(1)}.example.com", f"({d(4)})"])
        return [(close(form), "O")]

    def listed() -> list[tuple[str, str]]:
        return [(d(r.randint(1, 4)), "O") for _ in range(r.randint(2, 6))]

    def foreign() -> list[tuple[str, str]]:
        return [(w, "O") for w in (f"+{d(r.randint(1, 2))}", f"({d(3)})", close(f"{d(3)}-{d(4)}"))]

    out = []
    for _ in range(rows):
        row: list[tuple[str, str]] = []
        for _ in range(r.randint(1, 3)):
            row += [(plain(), "O") for _ in range(r.randint(0, 4))]
            row += r.choice([national, ssn, account, secret, other, other, other, listed, foreign])()
        row += [(plain(), "O") for _ in range(r.randint(0, 3))]
        out.append(([w for w, _ in row], [t for _, t in row]))
    return out


@lru_cache(maxsize=1)
def model() -> Crf:
    rows = labelled()
    tags = ["O", *(f"{p}-{k}" for k in ADDED for p in "BI")]
    return train([_features(w) for w, _ in rows], [t for _, t in rows], tags)


class Scores:
    """The field's scores of words by themselves and as neighbours: a row for each set of features, remembered by word."""

    def __init__(self, crf: Crf) -> None:
        self.crf = crf
        #: features that any of the three sums knows
        self.names = {f.removeprefix("-1:").removeprefix("+1:") for f in crf.index}
        self.known: dict[bytes, int] = {}
        n = len(crf.labels)
        edge = crf.emissions([["-1:edge"], ["+1:edge"]])
        #: own scores, those given to the next word, and those given to the one before; row 0 is the edge
        self.rows = np.stack([np.zeros((1, n)), edge[:1], edge[1:]], axis=1)
        self.row_of: dict[tuple[str, ...], int] = {}
        row = self._row(b"word")
        plain = self.rows[row].sum(axis=0)  # as most words are, among their like
        self.potential = potentials(crf, plain[0] - plain)

    def _row(self, word: bytes) -> int:
        names = tuple(f for f in _own(word.decode()) if f in self.names)
        row = self.row_of.get(names)
        if row is None:
            row = self.row_of[names] = len(self.rows)
            sums = [self.crf.emissions([[lead + f for f in names]]) for lead in ("", "-1:", "+1:")]
            self.rows = np.concatenate([self.rows, np.stack(sums, axis=1)])
        return row

    def places(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known = self.known
        for word in words:
            if word not in known:
                known[word] = self._row(word)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def of(self, words: pa.BinaryArray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Words x labels; first and last mark the words at the ends of texts."""
        every, which = distinct(words)
        at = self.places(every)[which]
        before, after = np.concatenate([[0], at[:-1]]), np.concatenate([at[1:], [0]])
        before[first], after[last] = 0, 0
        return self.rows[at, 0] + self.rows[before, 1] + self.rows[after, 2]


def potentials(crf: Crf, gap: np.ndarray) -> np.ndarray:
    """Of each label, the best that a run of words with scores ``gap`` below label 0 can gain up to it; zeros if runs can gain without end."""
    n = len(crf.labels)
    for slack in (0.5, 0.25, 0.1, 0.05, 0.0):
        gain = crf.moves - crf.moves[0, 0] - gap + slack * gap.clip(0)
        best = np.append(0.0, gain[0, 1:])
        for _ in range(n + 1):
            now = np.append(0.0, np.maximum(best[1:], (best[1:, None] + gain[1:, 1:]).max(axis=0)))
            if np.allclose(now, best):
                return now
            best = now
    return np.zeros(n)


def open_words(score: np.ndarray, first: np.ndarray, last: np.ndarray, crf: Crf, potential: np.ndarray) -> np.ndarray:
    """Which words may have another label than 0 on the best path; first and last mark the ends of texts.

    A run of other labels gains, over labels 0 throughout, at most the sum over its words of the best score and
    move into any label, and the best move out.  Potentials shift parts of moves from a label's way in to its way
    out, which changes no run's sum.  A word is settled if no run that it is part of gains by this bound.
    """
    shift = crf.moves - crf.moves[0, 0] + potential[:, None] - potential
    lead = score[:, 1:] - score[:, :1]
    most = (lead + shift[:, 1:].max(axis=0)).max(axis=1)
    most[first] = (lead[first] + (crf.first - crf.first[0] - potential)[1:]).max(axis=1)
    out = shift[1:, 0].max()
    most[last] += max(0.0, potential[1:].max() - out)  # no move leads out of a text's last word
    total = np.concatenate([[0.0], np.cumsum(most)])
    apart = (1.0 + np.abs(most).sum()) * np.cumsum(first)
    low = np.minimum.accumulate(total[:-1] - apart) + apart
    high = np.maximum.accumulate((total[1:] - apart)[::-1])[::-1] + apart
    return high - low + out >= -1e-3


def paths(score: np.ndarray, first: np.ndarray, last: np.ndarray, crf: Crf, potential: np.ndarray) -> np.ndarray:
    """Best label of each word of all texts."""
    path = np.zeros(len(score), np.int64)
    at = np.flatnonzero(open_words(score, first, last, crf, potential)) if len(score) else path
    if not len(at):
        return path
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | first[at[1:]]]))
    parts = []
    for a, b in zip(at[new].tolist(), (at[np.append(new[1:], len(at)) - 1] + 1).tolist(), strict=True):
        part = score[a:b].copy()
        part[0] += crf.first if first[a] else crf.moves[0]
        if not last[b - 1]:
            part[-1] += crf.moves[:, 0]
        parts.append((a, b, part))
    for (a, b, _), best in zip(parts, viterbi([p for _, _, p in parts], crf.moves, np.zeros(len(crf.labels))), strict=True):
        path[a:b] = best
    return path


@lru_cache(maxsize=2)
def _scores(crf: Crf) -> Scores:
    return Scores(crf)


def added_spans(texts: list[str], crf: Crf) -> list[list[Span]]:
    """What the field finds in each text."""
    out: list[list[Span]] = [[] for _ in texts]
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    inside = ~np.isin(points, _SPACES)
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    if not len(begin):
        return out
    text_offs = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    number = np.searchsorted(text_offs, begin, side="right") - 1
    first, last = np.ones(len(begin), bool), np.ones(len(begin), bool)
    first[1:] = last[:-1] = number[1:] != number[:-1]
    scores = _scores(crf)
    path = paths(scores.of(word_array(points, inside, starts), first, last), first, last, crf, scores.potential)
    i, found = 0, np.flatnonzero(path)
    while i < len(found):
        w, kind = found[i], crf.labels[path[found[i]]][2:]
        i += 1
        v = w + 1
        while i < len(found) and found[i] == v and not first[v] and crf.labels[path[v]] == "I-" + kind:
            i, v = i + 1, v + 1
        k = int(number[w])
        text, a, b = texts[k], int(begin[w] - text_offs[k]), int(end[v - 1] - text_offs[k])
        while a < b and text[a] in "\"'[{<*#$%&|":
            a += 1
        while b > a and text[b - 1] in "\"'.,;:!?]}>*#$%&|":
            b -= 1
        if a < b:
            out[k].append((kind, a, b))
    return out


def all_spans(texts: list[str], crf: Crf) -> list[tuple[list[Span], list[Span]]]:
    """(by rule, added) of each text; added spans don't meet one by rule."""
    out = []
    for text, more in zip(texts, added_spans(texts, crf), strict=True):
        base = base_spans(text)
        out.append((base, sorted((s for s in more if all(s[2] <= a or b <= s[1] for _, a, b in base)), key=lambda s: (ADDED.index(s[0]), s[1]))))
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def report(docs: DataFrame) -> DataFrame:
    """Per document: counts by rule, the digest of those spans, and all spans."""
    held = docs.sparkSession.sparkContext.broadcast(model())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = all_spans([t or "" for t in batch.column("text").to_pylist()], held.value)
        counts = [pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS]
        return pa.record_batch([batch.column("doc_id"), *counts, pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in found]), pa.array([_joined(b + m) for b, m in found])], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return map_rows(docs.select("doc_id", "text"), "text", run, REPORT)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones together, as the upper-case kind in brackets."""
    parts, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced; null texts stay null, and n_chars, where it is, follows the text."""
    held = docs.sparkSession.sparkContext.broadcast(model())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        found = all_spans([t or "" for t in texts], held.value)
        new = [None if t is None else redacted(t, [*b, *m]) if b or m else t for t, (b, m) in zip(texts, found, strict=True)]
        return batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(new, batch.schema.field("text").type))

    return map_rows(docs, "text", run, docs.schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
