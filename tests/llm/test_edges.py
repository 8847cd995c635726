"""Odd rows and empty tables through every operator, query and stage."""

import os

import pytest

import corpus_pipeline
from ctxloom.llm import chatformat, decontaminate, fingerprint, langid, linededup, packing, queries, secretscan, simhash, substrings, tokencount

DATA = "/root/testdata/sf0.001"


def benchmark(spark):
    return spark.createDataFrame([(1, "words of an ordinary text"), (None, None), (2, "")], "item_id long, text string")


OPERATORS = {
    "pack": lambda s, d, v: packing.pack(d, v),
    "secrets": lambda s, d, v: secretscan.scan_secrets(d),
    "tokens": lambda s, d, v: tokencount.count_tokens(d, v),
    "contamination": lambda s, d, v: decontaminate.find_contamination(d, benchmark(s)),
    "clean": lambda s, d, v: decontaminate.drop_contaminated(d, benchmark(s)),
    "repeats": lambda s, d, v: substrings.remove_repeats(d, part_bytes=10_000),
    "language": lambda s, d, v: langid.identify(d, langid.train(d), declared=d["lang"], host=d["source"]),
    "near": lambda s, d, v: simhash.near_duplicates(d),
    "keep_one": lambda s, d, v: simhash.keep_one(d),
    "lines": lambda s, d, v: linededup.drop_boilerplate(d),
    "fingerprints": lambda s, d, v: fingerprint.neighbour_report(d),
}
#: Rows of the odd table that come out, where it is not all 11.
ROWS = {"clean": 8, "keep_one": None, "pack": None}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, odd_docs, vocabulary, name):
    rows = OPERATORS[name](spark, odd_docs, vocabulary).collect()
    if (want := ROWS.get(name, 11)) is not None:
        assert len(rows) == want
    if name == "keep_one":
        ids = [r.doc_id for r in rows]
        assert ids.count(1) == 1 and 8 not in ids and len(ids) == len(set(ids))
    if name == "pack":
        assert sum(r.length for r in rows if r.doc_id == 3) == 1 and len([r for r in rows if r.doc_id == 1]) == 2
    if name in ("clean", "keep_one", "lines"):
        assert set(rows[0].asDict()) == set(odd_docs.columns)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, no_docs, vocabulary, name):
    assert OPERATORS[name](spark, no_docs, vocabulary).collect() == []


def test_empty_benchmark_and_conversations(spark, odd_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_contaminated(odd_docs, none).count() == 11
    assert chatformat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_repeated_ids_and_nulls_in_repeats(spark, odd_docs):
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in substrings.remove_repeats(odd_docs).collect()}
    assert got[1, 45] == 0 and got[8, 45] == 0 and got[2, 0] == 0 and got[6, 60_000] == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", queries.QUERIES)
def test_queries_run(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {table} as select * from read_parquet('{DATA}/{table}.parquet')")
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall(), key=str)
    assert sorted((tuple(r[n] for n in names) for r in queries.QUERIES[name](spark, DATA).collect()), key=str) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline_stages(spark):
    """Each stage against what a plain reading of it keeps."""
    from .test_overlap import plain_keep

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    junk = [(10_000, "%%% $$$ ### " * 40), (10_001, None), (10_002, ""), (10_003, "\u0432\u0441\u0435 \u043b\u044e\u0434\u0438 " * 30), (10_004, "zxq wvk jjq xzv " * 30)]
    docs = docs.unionByName(spark.createDataFrame([(i, t, None, "src0", 0) for i, t in junk], docs.schema))
    columns, before = docs.columns, docs.collect()
    plain = lambda t: sum(c.isalnum() for c in t) / max(1, sum(not c.isspace() for c in t))
    passages = {" ".join(w[i : i + 10]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() for w in [item_words(r.text)] for i in range(max(1, len(w) - 9))}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns
        after = docs.collect()
        if name == "language_id":
            gone = {r.doc_id for r in before} - {r.doc_id for r in after}
            assert {i for i, _ in junk} <= gone
            texts = {r.doc_id: r.text or "" for r in before}
            assert all(plain(texts[i]) < 0.85 or i >= 10_000 or len(texts[i]) < 20 for i in gone)  # what has few signs stays
            assert all(plain(r.text) > 0.6 for r in after)
        if name == "line_dedup":
            pages = {}
            for r in before:
                pages.setdefault(r.source, []).append(set(r.text.split("\n")))
            often = lambda line, source: line.strip() and sum(line in p for p in pages[source]) / len(pages[source]) > 0.1  # noqa: E731, B023
            want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if not often(x, r.source)) for r in before}
            assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)
        if name == "near_dedup":
            assert sorted(r.doc_id for r in after) == plain_keep({r.doc_id: r.text for r in before})
        if name == "decontamination":
            words = {r.doc_id: item_words(r.text) for r in before}
            hit = {i for i, w in words.items() if any(" ".join(w[k : k + 10]) in passages for k in range(max(1, len(w) - 9)))}
            assert {r.doc_id for r in after} == set(words) - hit and 0 < len(hit)
        docs, before = spark.createDataFrame(after, docs.schema), after
    lengths = {r.doc_id: r.n_tokens + 1 for r in tokencount.count_tokens(docs, queries.VOCABULARY).collect()}
    placed, sums = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect(), {}
    for r in placed:
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.length
    assert sums == lengths


def item_words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline_run_removes_its_tables(spark):
    from ctxloom.llm.common import shared_folder

    def written():
        return sum(len(folders) for at, folders, _ in os.walk(shared_folder(spark)) if os.path.basename(at) == spark.sparkContext.applicationId)

    before = written()
    assert corpus_pipeline.run(spark, DATA).count() > 0
    assert written() - before <= 3  # the last stage's and the rows that it read


def test_pipeline_stages_on_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, DATA)
            assert docs.columns == columns
        docs.collect()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert {r.doc_id for r in stage(spark, odd_docs, DATA).collect()} <= {1, 2, 3, 4, 5, 6, 7, 8, None}
    assert len(corpus_pipeline.STAGES[-1][1](spark, odd_docs, DATA).collect()) >= 11


def test_the_rest_stands_alone():
    """Nothing outside the subpackage imports it, but for the entry module's guard."""
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(top, "ctxloom")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert "llm" not in f.read(), name


def test_passes_of_repeats_leave_no_shuffle_files(spark, odd_docs):
    """Only the last pass's shuffle is left to the reader of the result; what the passes before wrote is gone."""

    def files():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {blocks.apply(i).getName() for i in range(blocks.size()) if blocks.apply(i).length() > 1000}

    before, key = {x for x in files() if x.startswith("shuffle_")}, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(key, None)
    rows = substrings.remove_repeats(odd_docs)
    assert {x for x in files() if x.startswith("shuffle_")} <= before and spark.conf.get(key, None) == kept
    assert rows.count() == 11
