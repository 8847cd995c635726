"""The near-copy stage against all pairs of shingle sets."""

import os
import random

import pytest

from ctxloom.llm import overlap, pipeline

DATA = "/root/testdata/sf0.001"


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_keep(texts):
    """Of {id: text}, the smallest id of each component at an overlap of 4/5, by all pairs."""
    sets = {i: plain_shingles(x) for i, x in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for i in ids:
        for j in ids:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted(i for i in ids if find(i) == i)


def made(rng):
    """Copies with up to a fifth of the words changed, around the bound and on either side of it."""
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    common, texts = " ".join(word() for _ in range(30)), []
    for _ in range(12):
        base = [word() for _ in range(120)]
        for changes in (0, 0, 1, 2, 3, 4, 5, 6, 8):
            copy = list(base)
            for at in rng.sample(range(len(copy)), changes):
                copy[at] = word()
            texts.append(" ".join(copy))
        texts.append(f"{' '.join(base[:100])} {common}")
    group = [word() for _ in range(150)]
    for _ in range(60):
        copy = list(group)
        copy[rng.randrange(150)] = word()
        texts.append(" ".join(copy))
    return dict(enumerate([*texts, "", None, " ", "one two", "One TWO"]))


@pytest.mark.parametrize("pairs_a_row", [0, 4, 10**9])
def test_keeps_what_all_pairs_keep(spark, monkeypatch, pairs_a_row):
    monkeypatch.setattr(overlap, "PAIRS_A_ROW", pairs_a_row)
    texts = made(random.Random(7))
    docs = spark.createDataFrame([(i, x, "en", "a", 1) for i, x in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in pipeline.near_copies(spark, docs, "").collect()) == plain_keep(texts)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_tables_keep_what_all_pairs_keep(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = plain_keep({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    assert sorted(r.doc_id for r in pipeline.near_copies(spark, docs, "").collect()) == want


def test_prefixes_decide():
    """Any two sets that overlap by 4/5 share one of the needed first members."""
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(1, 40)
        a = set(rng.sample(range(60), n))
        b = (a - set(rng.sample(sorted(a), rng.randrange(0, max(1, n // 5) + 1)))) | set(rng.sample(range(60, 90), rng.randrange(0, max(1, n // 5) + 1)))
        if b and 5 * len(a & b) >= 4 * len(a | b):
            assert set(sorted(a)[: overlap.needed(len(a))]) & set(sorted(b)[: overlap.needed(len(b))])


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    rows = overlap.keep_one(odd_docs).collect()
    ids = [r.doc_id for r in rows]
    assert ids.count(1) == 1 and 8 not in ids and len(ids) == len(set(ids)) and set(rows[0].asDict()) == set(odd_docs.columns)
    assert overlap.keep_one(no_docs).collect() == []


def crowd(rng, members):
    """Texts of which any two have much in common, and some four fifths of it: each has a word or two of a common text changed."""
    base = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(160)]
    out = []
    for _ in range(members):
        copy = list(base)
        for at in rng.sample(range(160), rng.choice((1, 2))):
            copy[at] = "".join(rng.choices("klmnop", k=6))
        out.append(" ".join(copy))
    return dict(enumerate(out))


def test_pairs_are_made_about_once(spark):
    """A pair meets in most of the shingles that it shares; what is made of it there doesn't grow with them."""
    texts = crowd(random.Random(11), 40)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    marked = overlap.marks(docs, overlap.frequencies(docs)).cache()
    rows = overlap.bucket_rows(marked).join(marked.select("fp", "bits"), "fp").selectExpr("h", "fp", "n", "at", "before", "fp root", "bits")
    made = [(r.a, r.b) for p in [overlap._by_bucket(rows, ["root"], overlap._crossing, "b long, a long")] for r in p.collect()]
    sets, fps = {i: plain_shingles(x) for i, x in texts.items()}, {r.doc_id: r.fp for r in marked.collect()}
    links = {tuple(sorted((fps[i], fps[j]))) for i in texts for j in texts if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert len(links) > 300 and links <= set(made)
    meet = sum(r["count"] * (r["count"] - 1) // 2 for r in rows.groupBy("h").count().collect())
    assert meet > 10 * len(links) and len(made) < 3 * len(links)
