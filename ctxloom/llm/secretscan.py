"""Secret scans: fixed forms, and Markov models of random and ordinary strings.

Base spans come from three patterns of fixed form. The method adds spans: a run is
made of the characters that keys and passwords are made of; an order-2 Markov model of
random strings and one of ordinary identifiers give each character a log-likelihood
ratio (each context counts once in a run, so that repeats prove nothing), and the
stretch of a run of ``RUN`` or more whose ratios sum to the most is a span of kind ``markov`` if it has ``LEAST`` characters, ``threshold`` nats and ``per_character`` nats a
character, and overlaps no base span; what lies before and after it is searched alike.
So a key at the end of a path or behind a name is found, and the name is left out.
Spans are in code points, the end exclusive.

The models are trained from labelled samples. Labelled in real text are, in a bounded
sample of the documents (``rows`` in the mean, by the hashes of their ids, of whose runs
each is counted): random, what the fixed forms find (the value of an assignment);
ordinary, every other run. As these are few, and no text shows all spellings, seeded
generators add ``samples`` of each: strings over the usual key alphabets, and words joined
in the usual spellings, numbers, syllables, alphabets, keyboard rows and repeats.

Scale: one narrow pass over the sample, whose counts by context are aggregated, and one
over the texts; the models are one array of ratios, 1 MB.

Defined cases: null text is empty and has no spans; repeated rows are scanned one
by one; spans of equal start are listed in the order assign, access, hex, markov;
without documents the generators train alone; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bound_batches, strings, values

KINDS = ("assign", "access", "hex", "markov")
#: The forms of the base spans.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_KEYWORD = re.compile(r"pass(?:word|wd)|secret|token|api_?key", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24

#: Characters of a run that is searched, and of a span in it.
RUN, LEAST = 16, 12
_RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{RUN},}}")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.full(128, -1, np.int64)
for _i, _c in enumerate(_ALPHABET):
    _CODE[ord(_c)] = _i
_EDGE, _SIZE = len(_ALPHABET), len(_ALPHABET) + 1

#: Ordinary words of code and prose.
WORDS = (
    "account active agent amount application argument author balance before branch build cache category "
    "character class cluster collection column comment company config console content control cookie "
    "count create customer date default delta description dialog display domain driver editor email "
    "enable endpoint entity event exception export extension failure field filter first format frame "
    "gateway generate graph handler height history house import info insert integer internal item journal "
    "keyword language layer length library limit link listener local log loop main mapping master matrix "
    "member menu message method minimum model monitor name node notification object operation order "
    "output page parameter parser password pattern people period phone pipeline player point position "
    "price private product program property provider query random reader reference register remote render "
    "request resource result review root rule sample schema score script second segment sequence service "
    "setting share simple socket space stage start static storage string style summary switch system "
    "target template test thread time token total traffic transfer trigger unique unknown upload utility "
    "value vector version view bonjour maison toujours quelque pendant lorsque entre aucun travail monde "
    "nicht werden zwischen schule arbeit zeit heute morgen richtig wieder gegen einheit trabajo siempre "
    "cuando tiempo donde entonces mundo ciudad nunca porque"
).split()

#: Parts of syllables, and rows of keyboards.
_ONSETS = ["", *"bcdfghjklmnpqrstvwxyz", *"ch sh th st tr pr gr br cl pl qu sch tz pf nt nd gn".split()]
_RHYMES = "a e i o u y ai au ea ei eu ie io oi ou ue eau an en in on un er ar or es is os ed ing ly el et it us".split()

_KEYBOARD = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "yxcvbnm", "azertyuiop", "qsdfghjklm", "1234567890")


def random_string(rng: random.Random) -> str:
    """Labelled positive: what generators of keys and passwords print."""
    size = rng.randint(16, 64)
    hexes, base = "0123456789abcdef", _ALPHABET[:62]
    kind = rng.randrange(5)
    if kind == 0:
        return "".join(rng.choices(hexes, k=size))
    if kind == 1:
        return "".join(rng.choices(hexes.upper(), k=size))
    if kind == 2:
        return "".join(rng.choices(base[:26] + "0123456789", k=size))
    return "".join(rng.choices(base + ("+/" if kind == 3 else "-_"), k=size))


def identifier(rng: random.Random) -> str:
    """Labelled negative: words joined as in code, paths and addresses."""
    words = rng.choices(WORDS, k=rng.randint(2, 6))
    kind = rng.randrange(12)
    if kind == 9:  # a stretch of an alphabet
        row, at = rng.choice((_ALPHABET[:26], _ALPHABET[26:52], _ALPHABET[52:62] * 3, _ALPHABET[:62])), rng.randrange(8)
        return row[at:] + rng.choice(("", row))
    if kind == 10:  # rows of a keyboard
        rows = "".join(rng.choices(_KEYBOARD, k=rng.randint(2, 4)))
        return rows.upper() if rng.random() < 0.2 else rows
    if kind == 11:  # one to three characters, again and again
        return "".join(rng.choices(_ALPHABET, k=rng.randint(1, 3))) * rng.randint(8, 20)
    if kind == 7:  # card, phone and order numbers
        return "".join(rng.choices("0123456789", k=rng.randint(16, 24)))
    if kind == 8:  # a long word of some other language
        out = "".join(rng.choice(_ONSETS) + rng.choice(_RHYMES) for _ in range(rng.randint(4, 12)))
        return out.capitalize() if rng.random() < 0.3 else out
    if kind == 0:
        out = "_".join(words)
    elif kind == 1:
        out = words[0] + "".join(w.capitalize() for w in words[1:])
    elif kind == 2:
        out = "-".join(words)
    elif kind == 3:
        out = "_".join(words).upper()
    elif kind == 4:
        out = "/".join(words)
    elif kind == 5:
        out = "".join(words)
    else:
        out = rng.choice("-_=") * rng.randint(16, 40)
    if rng.random() < 0.25:
        out += rng.choice(("", "_", "-")) + str(rng.randrange(10 ** rng.randint(1, 4)))
    if rng.random() < 0.1:  # dates and counters are ordinary too
        out = f"{out}-{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
    return out


def _codes(text: str) -> np.ndarray:
    body = _CODE[np.frombuffer(text.encode("ascii"), np.uint8)]
    return np.concatenate([[_EDGE, _EDGE], body])


def _cells(codes: np.ndarray) -> np.ndarray:
    return (codes[:-2] * _SIZE + codes[1:-1]) * _SIZE + codes[2:]


def _count(runs: Iterable[str]) -> np.ndarray:
    """How often each character follows each two before it, in runs of characters of the alphabet."""
    total = np.zeros(_SIZE**3)
    for many in itertools.batched(runs, 1 << 16):
        raw = np.frombuffer("\n\n".join(["", *many]).encode("ascii"), np.uint8)
        codes = np.where(raw == 10, _EDGE, _CODE[raw])
        total += np.bincount(_cells(codes)[codes[2:] != _EDGE], minlength=_SIZE**3)
    return total


@functools.lru_cache(maxsize=2)
def _generated(samples: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = random.Random(seed)
    return tuple(_count(make(rng) for _ in range(samples)) for make in (random_string, identifier))


class MarkovPair:
    """log P(c | two before, random) - log P(c | two before, ordinary), by contexts.

    ``labelled`` holds counts of contexts in labelled strings, random ones first.
    """

    def __init__(self, samples: int = 40_000, labelled: tuple[np.ndarray, np.ndarray] | None = None, smoothing: float = 0.3):
        counts = _generated(samples)
        if labelled is not None:
            counts = [a + b for a, b in zip(counts, labelled, strict=True)]
        self.ratio = (self._log(counts[0], smoothing) - self._log(counts[1], smoothing)).astype(np.float32)

    @staticmethod
    def _log(counts: np.ndarray, smoothing: float) -> np.ndarray:
        three = counts.reshape(_SIZE, _SIZE, _SIZE)
        two = three.sum(axis=0)  # backing off to one character before
        one = two.sum(axis=0)
        p1 = (one + smoothing) / (one + smoothing).sum()
        p2 = (two + 20 * smoothing * p1) / (two.sum(axis=1, keepdims=True) + 20 * smoothing)
        p3 = (three + 20 * smoothing * p2[None]) / (three.sum(axis=2, keepdims=True) + 20 * smoothing)
        return np.log(p3).ravel()

    def ratios(self, text: str) -> np.ndarray:
        """The log-likelihood ratio of each character; one that follows two as it did before adds nothing."""
        cells, out = _cells(_codes(text)), np.zeros(len(text))
        _, first = np.unique(cells, return_index=True)
        out[first] = self.ratio[cells[first]]
        return out

    def score(self, text: str) -> float:
        return float(self.ratios(text).sum())


def labelled_runs(text: str) -> tuple[list[str], list[str]]:
    """What the fixed forms find in a text, the value of an assignment; and its other runs."""
    base = base_spans(text)
    secret = [_ASSIGN.fullmatch(text, s, e)[2] if kind == "assign" else text[s:e] for s, e, kind in base]
    secret = [m[0] for x in secret for m in _RUN.finditer(x)]
    free, at = [], 0
    for s, e, _ in base:
        free.append(text[at:s])
        at = max(at, e)
    return secret, [m[0] for part in [*free, text[at:]] for m in _RUN.finditer(part)]


def train(docs: DataFrame, rows: int = 2000, samples: int = 40_000) -> MarkovPair:
    """Models of the labelled runs of about ``rows`` documents, and of generated strings."""
    share = rows / max(1, docs.count())
    below = -(1 << 63) + int(min(1.0, share) * (1 << 64)) - 1
    sample = docs.select("doc_id", "text").filter(F.xxhash64("doc_id") <= F.lit(below)).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, _SIZE**3))
        for batch in batches:
            labelled = [labelled_runs(text) for text in strings(batch, "text")]
            for label in (0, 1):
                total[label] += _count(run for runs in labelled for run in runs[label])
        for label in (0, 1):
            cell = np.flatnonzero(total[label])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), label)), pa.array(cell), pa.array(total[label][cell])], names=["label", "cell", "n"])

    bound_batches(docs.sparkSession)
    found = sample.mapInArrow(count, "label long, cell long, n double").groupBy("label", "cell").agg(F.sum("n").alias("n"))
    labelled = np.zeros((2, _SIZE**3))
    for label, cell, n in found.collect():  # at most 600,000 cells, whatever the corpus
        labelled[label, cell] = n
    return MarkovPair(samples, (labelled[0], labelled[1]))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then by kind."""
    found = []
    if _KEYWORD.search(text):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _stretches(ratios: np.ndarray, threshold: float, per_character: float) -> Iterator[tuple[int, int]]:
    """The stretches of a run with the greatest sums, one after another, that are long and random enough."""
    waiting = [(0, len(ratios))]
    while waiting:
        a, b = waiting.pop()
        if b - a < LEAST:
            continue
        sums = np.concatenate([[0.0], np.cumsum(ratios[a:b])])
        least = np.minimum.accumulate(sums)
        end = int((sums - least).argmax())
        score = float(sums[end] - least[end])
        start = int((sums[: end + 1] == least[end]).nonzero()[0][-1]) if end else 0
        if score < threshold:
            continue
        if end - start >= LEAST and score >= per_character * (end - start):
            yield a + start, a + end
        waiting += [(a, a + start), (a + end, b)]


def markov_spans(
    text: str, base: list[tuple[int, int, str]], models: MarkovPair, threshold: float, per_character: float
) -> list[tuple[int, int, str]]:
    found = []
    for m in _CANDIDATE.finditer(text):
        for s, e in _stretches(models.ratios(m[0]), threshold, per_character):
            s, e = s + m.start(), e + m.start()
            if not any(x < e and s < y for x, y, _ in base):
                found.append((s, e, "markov"))
    return found


def scan_secrets(
    docs: DataFrame, threshold: float = 20.0, per_character: float = 0.8, models: MarkovPair | None = None, rows: int = 2000, samples: int = 40_000
) -> DataFrame:
    """doc_id and ``found``: kind, start and end of all spans, in order; the models are trained on ``docs`` unless given."""
    models = train(docs, rows, samples) if models is None else models
    shared = docs.sparkSession.sparkContext.broadcast(models.ratio)

    def make():
        own = MarkovPair.__new__(MarkovPair)
        own.ratio = shared.value

        def each(batch):
            out = []
            for text in strings(batch, "text"):
                base = base_spans(text)
                spans = base + markov_spans(text, base, own, threshold, per_character)
                spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
                out.append([{"kind": k, "start": s, "end": e} for s, e, k in spans])
            return {"doc_id": values(batch, "doc_id"), "found": out}

        return each

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, found array<struct<kind:string,start:long,end:long>>")
