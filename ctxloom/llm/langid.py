"""Language ID by Bayesian evidence fusion.

log P(lang | all) = text likelihood + declared language + address suffix + host prior + const

* Text: naive Bayes over hashed byte trigrams of the whole text, trained on a
  bounded sample of labelled rows (``per_language`` rows of each language, taken
  by the hashes of their ids). Neighbouring trigrams overlap, so the
  likelihood counts a third.
* Declared markup language: right with probability ``declared_trust``.
* Address suffix: country-code suffixes name a language with probability
  ``suffix_trust``; others say nothing.
* Host prior: the text posteriors of the other rows, summed by grouped aggregation,
  smoothed from all rows to suffix to host with ``prior_rows`` pseudo-rows. A row's own
  posterior is taken out of every level, so that it does not count twice.

One more class stands for texts of no trained language: its likelihood is the mean of
that of single bytes in any order, and of all trigrams alike. Text that the trigrams
of every language explain worse belongs to it.

A row is rejected if under ``min_letters`` of its visible bytes are letters, if under
``min_plain`` are letters or digits (with ``PLAIN_BYTES`` more that are, so that a lone
word may end in a point), if its best language has a posterior under ``min_posterior``, or
if that language is not accepted.

Scale: one narrow pass over the texts, whose scores are written with the columns that
are asked for; only sums by host are shuffled, after partial aggregation. The host
table meets the rows by broadcast up to a measured size, otherwise by a join on host,
which Spark splits where a host is hot.

Defined cases: null or empty text has no likelihood and is rejected; null or
unknown declared languages and suffixes say nothing; a null host is the host '';
without labelled rows every row gets a null language and is rejected; repeated
rows each count; other columns pass through, whatever their names. The names of the
columns that are added begin with ``__langid_``, or with more underscores where one
of the table's own does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, own_prefix, release_memory

BUCKETS = 1 << 16
BROADCAST_BYTES = 32 << 20
_CHUNK = 1 << 18
OWN = "__langid_"
_LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
_PLAIN = _LETTER | np.array([0x30 <= b <= 0x39 for b in range(256)])
_SPACE = np.array([b <= 0x20 for b in range(256)])
PLAIN_BYTES = 8

#: The main language of country-code suffixes.
SUFFIX_LANGUAGE = {
    "fr": "fr", "de": "de", "at": "de", "es": "es", "mx": "es", "ar": "es", "cl": "es",
    "co": "es", "pe": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en",
    "it": "it", "nl": "nl", "pt": "pt", "br": "pt", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh",
}


def _pieces(text: bytes) -> Iterator[np.ndarray]:
    """Hashed trigrams of the whole text, in pieces of bounded size."""
    raw = np.frombuffer(text.lower(), np.uint8)
    for at in range(0, len(raw) - 2, _CHUNK):
        x = raw[at : at + _CHUNK + 2].astype(np.uint32)
        yield (x[:-2] * np.uint32(40503) + x[1:-1] * np.uint32(8209) + x[2:] * np.uint32(257)) & np.uint32(BUCKETS - 1)


class Model:
    """Languages, log P(trigram | language) as an array of languages x buckets, and log P(byte) of no language.

    ``limits`` has the largest hash of an id that was sampled, by language.
    """

    def __init__(self, languages: list[str], counts: np.ndarray, singles: np.ndarray | None = None, limits: dict[str, int] | None = None, smoothing: float = 0.5):
        self.languages, self.limits = languages, limits or {}
        total = counts.sum(axis=1, keepdims=True)
        self.weights = np.log((counts + smoothing) / (total + smoothing * BUCKETS)).astype(np.float32)
        singles = np.zeros((len(languages), 256)) if singles is None else singles
        rates = (singles + smoothing) / (singles.sum(axis=1, keepdims=True) + 256 * smoothing)
        self.single = np.log(rates.mean(axis=0)) if languages else np.zeros(256)

    def score(self, text: bytes) -> np.ndarray:
        """Log-likelihoods of no language and of each language."""
        out = np.zeros(len(self.languages) + 1)
        for grams in _pieces(text):
            out[1:] += self.weights[:, grams].sum(axis=1, dtype=np.float64)
        if len(text) > 2:  # the bytes of the trigrams: three each, less at the ends
            raw = np.frombuffer(text.lower(), np.uint8)
            at = self.single[raw]
            single = 3 * at.sum() - 2 * (at[0] + at[-1]) - at[1] - at[-2] if len(raw) > 3 else at.sum()
            out[0] = np.logaddexp(single / 3, -math.log(BUCKETS) * (len(raw) - 2) / 3) * 3
        return out / 3

    def trained_on(self, doc_id: Column, label: Column) -> Column:
        """Whether a row belongs to the sample that the model was trained on."""
        chosen = F.lit(False)
        for lang, below in self.limits.items():
            chosen = chosen | ((label == lang) & (F.xxhash64(doc_id) <= F.lit(below)))
        return F.coalesce(chosen, F.lit(False))


def train(docs: DataFrame, per_language: int = 500, label: str = "lang") -> Model:
    """A model of a sample of the labelled rows, taken by the hashes of their ids.

    Bound: ``per_language`` rows in the mean, and twice as many at most, of each language;
    texts are read one at a time and only counts are kept, 2 MB a language.
    """
    labelled = docs.filter(F.col(label).isNotNull() & F.col("text").isNotNull()).select(F.col(label).alias("label"), "doc_id", "text")
    found = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()
    languages = sorted(r.label for r in found)
    if not languages:
        return Model([], np.zeros((0, BUCKETS)))
    limits = {r.label: -(1 << 63) + int(min(1.0, per_language / r.n) * (1 << 64)) - 1 for r in found}
    below = docs.sparkSession.createDataFrame(list(limits.items()), "label string, below long")
    chosen = labelled.join(F.broadcast(below), "label").filter(F.xxhash64("doc_id") <= F.col("below"))
    counts, singles = np.zeros((len(languages), BUCKETS)), np.zeros((len(languages), 256))
    place, seen = {lang: i for i, lang in enumerate(languages)}, dict.fromkeys(languages, 0)
    for lang, text in chosen.select("label", "text").toLocalIterator():
        seen[lang] += 1
        if seen[lang] > 2 * per_language:  # ids that repeat can share a hash
            continue
        raw = text.encode()
        for grams in _pieces(raw):
            counts[place[lang]] += np.bincount(grams, minlength=BUCKETS)
        singles[place[lang]] += np.bincount(np.frombuffer(raw.lower(), np.uint8), minlength=256)
    return Model(languages, counts, singles, limits)


def text_evidence(model: Model, text: str | Column = "text") -> Column:
    """Array of the shares of letters and of plain bytes among the visible ones, the log-likelihoods of no language
    and of each language, and the posteriors of the languages by text alone."""
    shared = model.weights, model.languages, model.single

    @F.arrow_udf("array<double>")
    def evidence(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model.__new__(Model)
        own.weights, own.languages, own.single = shared
        for texts in batches:
            out = []
            for raw in texts.cast(pa.binary()).to_pylist():
                raw = raw or b""
                x = np.frombuffer(raw, np.uint8)
                visible = len(x) - int(_SPACE[x].sum())
                share = int(_LETTER[x].sum()) / visible if visible else 0.0
                plain = (int(_PLAIN[x].sum()) + PLAIN_BYTES) / (visible + PLAIN_BYTES)
                scores = own.score(raw)
                out.append([share, plain, *scores, *(_softmax(scores[1:]) if len(scores) > 1 else ())])
            yield pa.array(out, pa.list_(pa.float64()))
        release_memory()

    return evidence(text)


def _softmax(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return raised / raised.sum(axis=-1, keepdims=True)


def _likelihood(languages: list[str], values: list[str], trust: float) -> np.ndarray:
    """log P(value | language) where a value names one of the languages, otherwise 0."""
    out = np.zeros((len(values), len(languages)))
    place = {lang: i for i, lang in enumerate(languages)}
    for row, value in enumerate(values):
        if value in place:
            out[row] = math.log((1 - trust) / max(1, len(languages) - 1))
            out[row, place[value]] = math.log(trust)
    return out


def host_sums(scored: DataFrame, languages: int) -> tuple[DataFrame, list[float]]:
    """(host, suffix, n, m, sn, sm): rows and posteriors by language of each host and suffix; then those of all rows."""
    names = [f"m{i}" for i in range(languages)]
    seen = scored.filter(F.element_at("evidence", 1) > 0)
    hosts = seen.groupBy("host", "suffix").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("mass")[i]).alias(m) for i, m in enumerate(names)))
    hosts = materialize(hosts)
    every = hosts.agg(F.sum("n"), *map(F.sum, names)).first()
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("sn"), F.array(*(F.sum(m) for m in names)).alias("sm"))
    out = hosts.join(suffixes, "suffix").select("host", "suffix", "n", F.array(*names).alias("m"), "sn", "sm")
    return materialize(out), [float(x or 0) for x in every]


def identify(
    docs: DataFrame,
    model: Model,
    text: str = "text",
    declared: Column | None = None,
    host: Column | None = None,
    suffix: Column | None = None,
    declared_trust: float = 0.9,
    suffix_trust: float = 0.7,
    prior_rows: float = 20.0,
    other: float = 0.01,
    min_letters: float = 0.2,
    min_plain: float = 0.8,
    min_posterior: float = 0.5,
    accepted: list[str] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default), then __langid_lang, _posterior, _accepted and _letters."""
    bound_batches(docs.sparkSession)
    languages, own = model.languages, own_prefix(docs.columns, OWN)
    width, blank = len(languages), F.lit("")
    of = lambda name: F.col(own + name)
    cleaned = lambda c: F.lower(F.coalesce(c.cast("string"), blank)) if c is not None else blank
    given = {
        "declared": F.regexp_extract(cleaned(declared), r"^\s*([a-z]+)", 1) if declared is not None else blank,
        "host": cleaned(host),
        "suffix": cleaned(suffix),
        "evidence": text_evidence(model, F.col(f"`{text}`")),
    }
    kept = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    scored = docs.select(*kept, *(c.alias(own + n) for n, c in given.items()))
    if not languages:
        none = [F.lit(None).cast(t).alias(own + n) for n, t in (("lang", "string"), ("posterior", "double"))]
        return scored.select(*kept, *none, F.lit(False).alias(f"{own}accepted"), of("evidence")[0].alias(f"{own}letters"))
    scored = materialize(scored)
    mass = F.slice(of("evidence"), 4 + width, width)
    sums, (rows, *totals) = host_sums(scored.select(*(of(n).alias(n) for n in ("host", "suffix", "evidence")), mass.alias("mass")), width)
    size = sums.agg(F.sum(F.octet_length("host") + F.octet_length("suffix") + 16 * width + 64)).first()[0] or 0
    sums = sums.select(*(F.col(c).alias(f"{own}sum_{c}") for c in sums.columns))
    if size <= BROADCAST_BYTES:
        sums = F.broadcast(sums)
    joined = scored.join(sums, (of("host") == of("sum_host")) & (of("suffix") == of("sum_suffix")), "left")

    @F.arrow_udf("struct<lang:string,posterior:double>")
    def fuse(evidence: pa.Array, declared: pa.Array, suffix: pa.Array, n: pa.Array, m: pa.Array, sn: pa.Array, sm: pa.Array) -> pa.Array:
        """The likeliest language of each row, and its posterior beside those of the others and of no language."""
        table = lambda a: a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)
        found = table(evidence)
        counted = (found[:, :1] > 0).astype(float)
        mine = found[:, 3 + width :] * counted  # the row's own part of every sum
        less = lambda total: np.maximum(total - mine, 0.0)
        count = lambda total: np.maximum(total - counted, 0.0)
        column = lambda a: a.to_numpy(zero_copy_only=False).astype(float)[:, None]
        everywhere = (less(np.array(totals)) + 1) / (count(rows) + width)
        by_suffix = (less(table(sm)) + prior_rows * everywhere) / (count(column(sn)) + prior_rows)
        prior = np.log((less(table(m)) + prior_rows * by_suffix) / (count(column(n)) + prior_rows))
        fused = found[:, 3 : 3 + width] + prior + math.log(1 - other)
        fused += _likelihood(languages, declared.to_pylist(), declared_trust)
        fused += _likelihood(languages, [SUFFIX_LANGUAGE.get(x) for x in suffix.to_pylist()], suffix_trust)
        posterior = _softmax(np.concatenate([found[:, 2:3] + math.log(other), fused], axis=1))[:, 1:]
        best = posterior.argmax(axis=1)
        names = pa.array(languages).take(pa.array(best))
        return pa.StructArray.from_arrays([names, pa.array(posterior[np.arange(len(best)), best])], names=["lang", "posterior"])

    nothing = F.array_repeat(F.lit(0.0), width)
    zero = lambda name: F.coalesce(of(name).cast("double"), F.lit(0.0))
    many = lambda name: F.coalesce(of(name), nothing)
    best = fuse(of("evidence"), of("declared"), of("suffix"), zero("sum_n"), many("sum_m"), zero("sum_sn"), many("sum_sm"))
    joined = joined.withColumn(f"{own}best", best)
    share, lang, posterior = of("evidence")[0], of("best")["lang"], of("best")["posterior"]
    fine = (share >= min_letters) & (share > 0) & (of("evidence")[1] >= min_plain) & (posterior >= min_posterior)
    if accepted is not None:
        fine = fine & lang.isin(accepted)
    return joined.select(
        *kept,
        lang.alias(f"{own}lang"),
        posterior.alias(f"{own}posterior"),
        F.coalesce(fine, F.lit(False)).alias(f"{own}accepted"),
        share.alias(f"{own}letters"),
    )


def accept(docs: DataFrame, model: Model, **options) -> DataFrame:
    """The documents that language ID accepts, with all their columns."""
    flag = own_prefix(docs.columns, OWN) + "accepted"
    return identify(docs, model, **options).filter(F.col(flag)).select(*(F.col(f"`{c}`") for c in docs.columns))


def address_suffix(host: Column) -> Column:
    """What stands behind the last dot of a host's name; '' where there is none."""
    return F.regexp_extract(F.coalesce(host.cast("string"), F.lit("")), r"\.([A-Za-z]{2,})$", 1)


def page_columns(pages: DataFrame) -> DataFrame:
    """Pages with their visible ``text`` and the evidence declared, host and suffix."""
    html = F.coalesce(F.col("html"), F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"&#?\w+;", " ")
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return pages.select(
        "page_id",
        F.trim(bare).alias("text"),
        F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1).alias("declared"),
        host.alias("host"),
        address_suffix(host).alias("suffix"),
    )
