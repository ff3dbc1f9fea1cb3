"""Secret scans: fixed formats first, then automata inferred from the credentials these find.

The base patterns mark assignments, access keys and hexadecimal strings. Their values, grouped by kind, are
the labelled credentials: a bounded sample of them builds a prefix tree over character classes, and states
whose continuations are statistically compatible (Hoeffding bounds on every symbol, recursively) are merged
into one probabilistic automaton a kind. Every other candidate string of a text is then scored by its
log-likelihood under each automaton; one that beats the background by `min_gain` in total becomes a span of kind
"like_<kind>". The background is a Markov chain over the character classes, counted over the runs of all texts that are
too short for candidates or plain (a word, capitals, a number, a rule of signs), so that unknown credentials don't enter
it; a run that hardly changes its class is ordinary as well, whatever was counted. A format is judged by this ratio alone: a rich alphabet makes every single character
unlikely, under any model.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import whole

SAMPLE = 2_000  # labelled credentials of a kind that the inference reads at most
ALPHA = 0.05
MIN_GAIN = 8.0
MIN_CANDIDATE = 12  # the least of the labelled values' lengths
KINDS = ("assign", "access", "hex")
PREPEND = {"assign": 12, "access": 18, "hex": 16}  # least lengths

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of hexadecimal digits is matched whole, so short runs never hide one
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % MIN_CANDIDATE)  # maximal runs of what a labelled value may hold
PLAIN = re.compile(r"[A-Z]?[a-z]+[.=-]*|[A-Z]+[.=-]*|[0-9]+[.=-]*|[+/_.=-]+")

END = "$"
PAIRS = "pairs"
#: Share of each class among the characters of ordinary words; half of it, and half of staying in the class, are what
#: PRIOR characters after each class say, beside those of the texts.
SHARES = {"v": 0.17, "l": 0.50, "h": 0.28, "U": 0.03, "d": 0.01, "s": 0.01}
PRIOR = 20.0
STAY = 0.9  # how likely a class is followed by itself in an ordinary run of capitals, digits or signs
ORDER = "vlhUds"


def classes(value: str) -> str:
    """Digits d, letters a-f h, other vowels v, other small letters l, capitals U, signs s."""
    return "".join("d" if c.isdigit() else "h" if c in "abcdef" else "v" if c in "iou" else "l" if c.islower() else "U" if c.isupper() else "s" for c in value)


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the base patterns, leftmost and non-overlapping a kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= PREPEND["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= PREPEND["access"]]
    found += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


class Automaton:
    """A deterministic probabilistic automaton: counts of symbols and ends by state, and transitions."""

    def __init__(self, values: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        for value in sorted(values):
            state = 0
            for symbol in classes(value):
                self.count[state][symbol] += 1
                if symbol not in self.next[state]:
                    self.next[state][symbol] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                state = self.next[state][symbol]
            self.count[state][END] += 1

    def _compatible(self, a: int, b: int, alpha: float) -> bool:
        """Whether two states' continuations could come from one distribution, all the way down."""
        open_pairs = [(a, b)]
        while open_pairs:
            a, b = open_pairs.pop()
            n, m = sum(self.count[a].values()), sum(self.count[b].values())
            if not n or not m:
                continue
            bound = (1 / math.sqrt(n) + 1 / math.sqrt(m)) * math.sqrt(0.5 * math.log(2 / alpha))
            for symbol in self.count[a].keys() | self.count[b].keys():
                if abs(self.count[a][symbol] / n - self.count[b][symbol] / m) > bound:
                    return False
                if symbol in self.next[a] and symbol in self.next[b]:
                    open_pairs.append((self.next[a][symbol], self.next[b][symbol]))
        return True

    def _fold(self, into: int, state: int) -> None:
        """Add the counts of a subtree to the states it is merged with."""
        pending = [(into, state)]
        while pending:
            into, state = pending.pop()
            self.count[into].update(self.count[state])
            for symbol, target in self.next[state].items():
                if symbol in self.next[into]:
                    pending.append((self.next[into][symbol], target))
                else:
                    self.next[into][symbol] = target

    def merged(self, alpha: float = ALPHA) -> Automaton:
        """Red states are settled; a blue child is merged with the first compatible red state or turns red."""
        red, blue = [0], sorted((s, 0, c) for c, s in self.next[0].items())
        while blue:
            state, parent, symbol = blue.pop(0)
            match = next((r for r in red if self._compatible(r, state, alpha)), None)
            if match is None:
                red.append(state)
            else:
                self.next[parent][symbol] = match
                self._fold(match, state)
            settled = set(red)
            blue = sorted({(s, r, c) for r in red for c, s in self.next[r].items() if s not in settled})
        return self

    def log_likelihood(self, value: str) -> float:
        """With a little mass for unseen symbols, so that every string has a likelihood."""
        state, total = 0, 0.0
        for symbol in classes(value):
            counts = self.count[state]
            total += math.log((counts[symbol] + 0.01) / (sum(counts.values()) + 0.07))
            if symbol not in self.next[state]:
                return total - 5.0 * len(value)
            state = self.next[state][symbol]
        return total


#: The place in ORDER of every Latin-1 character, len(ORDER) for those outside of candidates.
CODES = np.array([ORDER.index(classes(c)) if re.fullmatch("[A-Za-z0-9+/_.=-]", c) else len(ORDER) for c in map(chr, range(256))], np.int64)


def class_pairs(text: str, base: list[tuple[int, int, str, str]]) -> np.ndarray:
    """How often each class follows each one (the last stands for all that no candidate has), outside base spans and candidates that are not plain."""
    codes = CODES[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
    for start, end in [s[:2] for s in base] + [m.span() for m in CANDIDATE.finditer(text) if not PLAIN.fullmatch(m[0])]:
        codes[start:end] = len(ORDER)
    size = len(ORDER) + 1
    return np.bincount(codes[:-1] * size + codes[1:], minlength=size * size)


class Background:
    """Ordinary text: the likelihood of a string of a given length, class by class."""

    def __init__(self, pairs: dict[int, int]):
        size = len(ORDER) + 1
        self.log: dict[str, float] = {}
        for i, before in enumerate((*ORDER, "")):  # "" begins a string
            prior = {c: 0.5 * SHARES[c] + 0.5 * (SHARES[c] if not before else c == before) for c in ORDER}
            seen = {c: pairs.get(i * size + k, 0) + PRIOR * prior[c] for k, c in enumerate(ORDER)}
            total = sum(seen.values())
            self.log |= {before + c: math.log(n / total) for c, n in seen.items()}

    def log_likelihood(self, value: str) -> float:
        found = classes(value)
        pairs = [*zip(found, found[1:])]
        steady = sum(math.log(STAY if a == b else (1 - STAY) * SHARES[b]) for a, b in pairs)
        return self.log[found[0]] + max(sum(self.log[a + b] for a, b in pairs), steady)


def learned(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> tuple[dict[str, list[str]], Background]:
    """At most `sample` labelled credentials a kind: those of the smallest hash, the same on every run; the background."""

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, set] = defaultdict(set)
        pairs = np.zeros((len(ORDER) + 1) ** 2, np.int64)
        for batch in batches:
            for body in batch["text"]:
                base = base_spans(body)
                pairs += class_pairs(body, base)
                for _, _, kind, value in base:
                    kept[kind].add((hashlib.md5(value.encode()).hexdigest(), value))
            for kind in kept:  # what no task can need is dropped at once
                kept[kind] = set(sorted(kept[kind])[:sample])
        rows = [(k, h, v, 0) for k in sorted(kept) for h, v in sorted(kept[k])]
        rows += [(PAIRS, "", str(k), int(n)) for k, n in enumerate(pairs) if n]
        yield pd.DataFrame(rows, columns=["kind", "h", "value", "n"])

    found = docs.select(whole(text).alias("text")).mapInPandas(values, "kind string, h string, value string, n long")
    found = found.groupBy("kind", "h", "value").agg(F.sum("n").alias("found"))
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("h", "value"))).where((F.col("n") <= sample) | (F.col("kind") == PAIRS))
    out: dict[str, list[str]] = {}
    counts: dict[int, int] = {}
    for row in first.select("kind", "value", "found").collect():  # at most `sample` short strings a kind, and the class pairs
        if row["kind"] == PAIRS:
            counts[int(row["value"])] = row["found"]
        else:
            out.setdefault(row["kind"], []).append(row["value"])
    return out, Background(counts)


def infer(values: dict[str, list[str]], alpha: float = ALPHA) -> dict[str, Automaton]:
    return {kind: Automaton(values[kind]).merged(alpha) for kind in KINDS if values.get(kind)}


def candidates(text: str, base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """The runs that are not within a base span. An assignment is no part of a token: its name and value split the run."""
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        near = [b for b in base if b[0] < end and start < b[1]]
        for s, e, kind in [*near, (end, end, "assign")]:
            if kind == "assign":
                if min(s, end) - start >= MIN_CANDIDATE and not any(b[0] <= start and min(s, end) <= b[1] for b in near):
                    yield start, min(s, end)
                start = max(start, e)


def all_spans(text: str, automata: dict[str, Automaton], background: Background, min_gain=MIN_GAIN) -> list[tuple[int, int, str]]:
    """Base spans, and candidates not within one of them that an automaton finds likelier than the background does."""
    base = [(s, e, kind) for s, e, kind, _ in base_spans(text)]
    added = []
    for start, end in candidates(text, base):
        value = text[start:end]
        scores = [(a.log_likelihood(value), kind) for kind, a in automata.items()]
        if scores:
            best, kind = max(scores)
            if best - background.log_likelihood(value) >= min_gain:
                added.append((start, end, f"like_{kind}"))
    order = {k: i for i, k in enumerate((*KINDS, *(f"like_{k}" for k in KINDS)))}
    return sorted(base + added, key=lambda s: (s[0], order[s[2]]))


SPANS = "array<struct<start: long, end: long, kind: string>>"


def secret_scan(docs: DataFrame, doc_id="doc_id", text="text", sample: int = SAMPLE, alpha=ALPHA, min_gain=MIN_GAIN) -> DataFrame:
    """(doc_id, spans) for every row; spans are (start, end, kind) in code points, end exclusive.

    Every run of a labelled value's characters of `MIN_CANDIDATE` or more is scored, whatever its characters; one that
    reaches beyond a base span is added beside it. A null or empty text has no spans; repeated rows are scanned each; an empty table, or one without any
    labelled credential, infers no automaton and only base spans are found. Other columns are ignored.
    """
    values, background = learned(docs, text, sample)
    automata = infer(values, alpha)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = [[{"start": s, "end": e, "kind": k} for s, e, k in all_spans(t, automata, background, min_gain)] for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": spans})

    kind = docs.schema[doc_id].dataType
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    return rows.mapInPandas(scan, f"doc_id {kind.simpleString()}, spans {SPANS}")


def digest(found: DataFrame) -> DataFrame:
    """Counts a base kind, the digest of the base spans, and all spans as text."""
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    base = f"filter(spans, s -> s.kind in {KINDS})"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.expr(joined.format(base)), 256).alias("base_sha256"), F.expr(joined.format("spans")).alias("spans"))
