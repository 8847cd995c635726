"""Golden cases, randomised models and end-to-end runs of the engine."""

import json
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from ctxloom import cli, schemas
from ctxloom.functions import paths as P
from ctxloom.functions import text as X
from ctxloom.operators import audit as A
from ctxloom.operators import buckets as B
from ctxloom.operators import extract, graph, lanes, resolve, similarity
from ctxloom.operators.scanner import analyze, strip_strings_and_comments
from ctxloom.plans import bundle as plan
from ctxloom.plans import render
from ctxloom.sources import bundles, config, diff, embeddings, memory, tree


def arcs_frame(spark, arcs):
    rows = [(a, i, b, [], "static") for i, (a, b) in enumerate(arcs)]
    return spark.createDataFrame(rows, "node string, arc_ord long, next string, symbols array<string>, type string")


def tiers(spark, starts, arcs, **caps):
    frame = spark.createDataFrame([(s,) for s in starts], "start string")
    hops = graph.traverse(frame, arcs_frame(spark, arcs), "forward", **caps).collect()
    return sorted((h.start, h.hop, h.pos, h.path, h.via) for h in hops)


def model(starts, arcs, max_hops, per_parent, per_tier):
    after = {}
    for a, b in arcs:
        after.setdefault(a, []).append(b)
    out = []
    for s in starts:
        seen, frontier = {s}, [s]
        for hop in range(1, max_hops + 1):
            tier = []
            for node in frontier:
                taken = 0
                for b in after.get(node, []):
                    if b in seen or taken >= per_parent:
                        continue
                    seen.add(b)
                    taken += 1
                    tier.append((b, node))
            tier = tier[:per_tier]
            out += [(s, hop, i, b, via) for i, (b, via) in enumerate(tier)]
            frontier = [b for b, _ in tier]
    return sorted(out)


def test_bfs_caps_and_shared_children(spark):
    arcs = [("S", "A"), ("S", "B"), ("A", "x"), ("A", "y"), ("A", "z"), ("B", "x"), ("B", "z"), ("B", "w"), ("B", "v")]
    got = [(p, v) for _, hop, _, p, v in tiers(spark, ["S"], arcs, per_parent=2) if hop == 2]
    assert got == [("x", "A"), ("y", "A"), ("z", "B"), ("w", "B")]


def test_bfs_dropped_nodes_stay_visited(spark):
    arcs = [("S", "a"), ("S", "b"), ("S", "c"), ("a", "c"), ("a", "d")]
    assert [(h, p) for _, h, _, p, _ in tiers(spark, ["S"], arcs, per_tier=2)] == [(1, "a"), (1, "b"), (2, "d")]


def test_bfs_cycle(spark):
    assert [(h, p) for _, h, _, p, _ in tiers(spark, ["S"], [("S", "a"), ("a", "S")])] == [(1, "a")]


def test_bfs_random_model(spark):
    rng = random.Random(4)
    nodes = [f"n{i}" for i in range(40)]
    arcs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(220)]
    assert tiers(spark, nodes, arcs, max_hops=3, per_parent=2, per_tier=5) == model(nodes, arcs, 3, 2, 5)


LADDER = {
    "src/a.ts": "", "src/foo.ts": "", "src/foo.js": "", "src/dir/index.ts": "", "src/data.json": "{}", "src/empty/.keep": "",
    "packages/p/package.json": '{"name": "@o/p"}', "packages/p/src/x.ts": "", "pnpm-workspace.yaml": "packages:\n  - 'packages/*'  # all\n",
    "tsconfig.json": '{ /* c */ "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["./src/*"],}}}',
}
CASES = [
    ("./foo.js", "src/foo.ts"), ("./foo", "src/foo.ts"), ("./dir", "src/dir/index.ts"), ("./data", "src/data.json"), ("./data.json", "src/data.json"),
    ("./empty", "src/empty"), ("..", None), ("@/foo", "src/foo.ts"), ("@o/p/dist/x", "packages/p/src/x.ts"), ("@o/p", "packages/p/src"), ("react", None),
]


def test_resolver_ladder(spark):
    files = spark.createDataFrame(list(LADDER.items()), "path string, content string")
    index = files.filter(P.is_source(F.col("path")))
    rows = [("src/a.ts", i, s, "static", []) for i, (s, _) in enumerate(CASES)]
    imports = spark.createDataFrame(rows, schemas.RAW_IMPORTS)
    edges = resolve.resolve_imports(imports, tree.entries_of(files, index), config.configs(files), config.workspaces(spark, files)).collect()
    assert {(e.specifier, e.resolved_path) for e in edges} == set(CASES)
    assert all((e.kind == "internal") == (e.resolved_path is not None) for e in edges)


def test_line_numbers(spark):
    rows = [("a\nb\n", 100), ("\n" * 9, 100), ("abcdé", 3), ("éé", 3)]
    out = []
    for text, cap in rows:
        d = spark.createDataFrame([(text,)], "t string")
        out.append(tuple(d.select(X.with_line_numbers(F.col("t"), cap), X.over_limit(F.col("t"), cap)).first()))
    assert out[0] == ("1: a\n2: b\n3: ", False)
    assert out[1][0].startswith(" 1: \n") and out[1][0].endswith("\n10: ")
    assert out[2] == ("1: abc", True) and out[3] == ("1: éé", True)


BUCKETS = {
    "apps/backend/prisma/migrations/1/m.sql": "01", "apps/backend/src/app/api/x.ts": "02", "apps/backend/prisma/seed.ts": "03", "apps/dashboard/src/app/p.tsx": "04",
    "apps/dashboard/src/lib/a.ts": "05", "apps/e2e/t.ts": "06", "packages/react/x.ts": "07", "apps/mobile/readme.md": "08", "apps/dashboard/x.css": "09", "README.md": "09",
    "packages/other/x.ts": "99", "prisma/migrations/x.ts": "99",
}


def test_buckets(spark):
    d = spark.createDataFrame([(p,) for p in BUCKETS], "path string")
    assert {r.path: r.b.id for r in d.select("path", B.bucket_of(F.col("path")).alias("b")).collect()} == BUCKETS


def test_diff_texts(spark):
    lines = ["A\tn", "R087\told\tnew", "T\tx", "U\tx", "C100\ta\tb", ""]
    d = spark.createDataFrame(list(enumerate(lines)), "ord int, value string")
    got = [(r.status, r.path, r.prev_path) for r in diff.parse_name_status(d).orderBy("ord").collect()]
    assert got == [("added", "n", None), ("renamed", "new", "old"), ("modified", "x", None), ("modified", "x", None), ("copied", "a", None)]
    stats = spark.createDataFrame([("12\t3\tf",), ("-\t-\tf",), ("",)], "value string")
    assert sorted((r.additions, r.deletions) for r in diff.parse_numstat(stats).collect()) == [(0, 0), (0, 0), (12, 3)]


def test_cosine_and_ranks(spark):
    pairs = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0], [0.0]), ([1.0], [1.0, 2.0])]
    d = spark.createDataFrame(pairs, "a array<double>, b array<double>")
    assert [r[0] for r in d.select(similarity.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, -1.0, 0.0, 0.0]
    rng = random.Random(2)
    vectors = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(6)] if i % 9 else None) for i in range(120)] + [(500, [1.0] * 6), (501, [1.0] * 6), (502, [1.0] * 5)], "id long, vec array<double>")
    targets = vectors.filter("id % 10 = 0 and vec is not null").select(F.col("id").alias("target"), "vec")
    pairs = vectors.filter("vec is not null").join(F.broadcast(targets.withColumnRenamed("vec", "t")), F.col("target") != F.col("id"))
    scored = pairs.select("target", "id", similarity.cosine(F.col("t"), F.col("vec")).alias("score")).filter("score > 0")
    want = similarity.ranked(scored, 5).collect()
    for block in (1 << 25, 200):
        assert sorted(similarity.top_k(targets, vectors, 5, block).collect()) == sorted(want)


def test_memory_texts(tmp_path):
    text = memory.with_item("# M\n\n## Rules\n\n- a\n\n\n## Notes\n", "Rules", "b")
    assert text == "# M\n\n## Rules\n\n- a\n- b\n\n## Notes\n"
    assert memory.with_item("# M\n", "Notes", "n").endswith("## Notes\n\n- n\n")
    path = str(tmp_path / "deep" / "m.md")
    memory.append(path, "Rules", "one")
    assert memory.items(memory.ensure(path)) == [("Rules", 0, "one")]
    assert cli.main(["memory", "--memory-path", path, "rule"]) == 2
    assert cli.main(["memory", "--memory-path", path, "note", "two", "words"]) == 0
    assert ("Notes", 0, "two words") in memory.items(memory.ensure(path))


SAMPLE = """import d, { a as b } from './x';
import * as ns from './y';
import './side';
export { p as q } from './z';
export * from './w';
const r = require('cjs');
export const f = () => 1, k = 2;
export default class K {}
function local() {}
"""


def test_scanner_golden():
    found = analyze(SAMPLE)
    assert found.imports == [
        ("./x", "static", ["d", "a"]), ("./y", "static", ["* as ns"]), ("./side", "static", []), ("./z", "reexport", ["q"]), ("./w", "reexport-all", []), ("cjs", "cjs", []),
    ]
    assert (list(found.exports), list(found.functions), list(found.classes)) == (["q", "f", "k", "default"], ["f", "local"], ["K"])


def test_scanner_typescript():
    found = analyze(
        """import type { T, type U as V } from "./t"; // import x from 'no'
/* export const no = 1 */
const s = `a ${require('inner')} import z from 'w'`
export async function* gen<T>(x: T = {a: 1}): AsyncGenerator<T> { const inner = () => 1; await import("./dyn") }
export interface I { a: string }
export const enum E { A }
export abstract class Abs extends Base implements I {}
const arrow = async (a: number): Promise<Map<string, number>> => { return new Map() }
const fn = function () {}, other = /re'gex/.test("x")
let { de, str } = obj
export { arrow as default }
foo.require('nope'); import.meta.url
"""
    )
    assert [i[:2] for i in found.imports] == [("./t", "static"), ("inner", "cjs"), ("./dyn", "dynamic")]
    assert list(found.exports) == ["gen", "I", "E", "Abs", "default"]
    assert list(found.functions) == ["gen", "arrow", "fn"] and list(found.classes) == ["Abs"]


@pytest.mark.parametrize("source", ["", "}{", "import", "export {", "`${", "import {a from", "/", "'", "export default", "a" * 50_000])
def test_scanner_never_fails(source):
    analyze(source)
    strip_strings_and_comments(source)


def test_config_inheritance():
    texts = {
        "a/tsconfig.json": '{"extends": ["./none", "../base.json", "../other.json"], "compilerOptions": {"baseUrl": "x"}}',
        "base.json": '{"compilerOptions": {"paths": {"p/*": ["q/*"]}}, "extends": "./a/tsconfig.json"}',
        "other.json": '{"compilerOptions": {"paths": {"no": ["no"]}}}',
    }
    got = config.load_config("a/tsconfig.json", texts)
    assert got["base_url"] == "x" and got["paths"] == {"p/*": ["q/*"]} and got["base_dir"] == ""
    assert config.load_config("a/tsconfig.json", texts, False)["base_dir"] == "a"
    assert config.relaxed_json('{"a": "//no", /* c */ "b": [1, ], }') == {"a": "//no", "b": [1]}
    assert config.yaml_packages("packages: [a, 'b/*' , \"c\"] # d\nother: [no]\n") == ["a", "b/*", "c"]
    assert config.yaml_packages("x:\n  packages:\n    - no\n") == [] and config.yaml_packages("packages:\n# c\n- a\n\n- 'it''s'\nb: 1\n- no\n") == ["a", "it's"]
    assert config.yaml_packages("x: 1\npackages:\n  - 'a/*'\n  - b # c\nother:\n  - no\n") == ["a/*", "b"]


def test_embedding_cache(spark, tmp_path):
    files = spark.createDataFrame([("a", "same"), ("b", "same"), ("c", ""), ("d", "x" * 3000)], "path string, content string")
    path = str(tmp_path / "cache")

    def embed(texts):
        if any(len(x) > 1000 for x in texts):
            raise embeddings.ContextLengthError("context length")
        return [[float(len(x)), 1.0] for x in texts]

    first = embeddings.probe(files, embeddings.read_cache(spark, path, "m"), "m")
    assert embeddings.counters(first).first().asDict() == {"hits": 0, "misses": 3}
    found = embeddings.embed_missing(first, embed, "m")
    embeddings.append_cache(found, path)
    again = embeddings.probe(files, embeddings.read_cache(spark, path, "m"), "m").collect()
    assert {r.path: r.vec for r in again} == {"a": [4.0, 1.0], "b": [4.0, 1.0], "d": [750.0, 1.0]}
    assert embeddings.counters(embeddings.probe(files, embeddings.read_cache(spark, path, "other"), "other")).first().hits == 0


def test_hop_audit(spark):
    rows = [("S", "forward", 1, "a", "?"), ("S", "forward", 2, "b", "a"), ("S", "forward", 2, "c", "nowhere"), ("S", "reverse", 1, "S", "S")]
    issues, counters = A.hop_integrity(spark.createDataFrame(rows, "start string, direction string, hop int, path string, via string"))
    assert counters.first().asDict() == {"valid": 1, "invalid": 2} and issues.count() == 2


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    files = {
        "src/a.ts": "import { b } from './b';\nimport x from 'react';\nexport const a = () => b;\n",
        "src/b.ts": "import { c } from '@/c';\nexport function b() { return c; }\n",
        "src/c.ts": "export class C {}\nexport const c = 1;\n",
        "src/gone.ts": "export const gone = 1;\n",
        "src/old.ts": "export const moved = 1;\nexport const two = 2;\n",
        "src/naïve name.ts": "export const q = 1;\n",
        "node_modules/x/index.js": "export const no = 1;\n",
        "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"]}}}',
        "AGENTS.md": "Be kind.\n",
        ".cursorrules": "Be brief.\n",
        "src/_app.tsx": "import { c } from './c';\nexport const app = c;\n",
        "src/__tests__/t.ts": "import { app } from '../_app';\n",
        "src/a+b%20c.ts": "export const odd = 1;\n",
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "logo.png").write_bytes(b"\x89PNG\xff\xfe\x00")
    (root / "font.woff").write_bytes(bytes(range(256)))
    (root / "src/latin.ts").write_bytes(b"export const caf\xe9 = 1;\n")
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-f", ".")
    git("commit", "-qm", "base")
    git("branch", "dev")
    (root / "src/b.ts").write_text("import { c } from '@/c';\nexport function b() { return c + 1; }\n")
    (root / "src/gone.ts").unlink()
    (root / "src/old.ts").rename(root / "src/new.ts")
    (root / "src/extra.ts").write_text("import './a';\n")
    git("add", "-A")
    return root


def test_bundle_end_to_end(spark, repo, tmp_path):
    options = plan.Options(root=str(repo), base="dev", memory_path=str(tmp_path / "m.md"), cache_path=str(tmp_path / "cache"), include_content_for_deps=True)
    inputs = plan.gather(spark, options, lambda texts: [[float(len(t)), 1.0, float(t.count("export"))] for t in texts])
    built = plan.assemble(inputs, options, "now")
    document = json.loads(bundles.bundle_json(built).first().value)
    by = {f["path"]: f for f in document["files"]}
    assert document["changedFiles"] == ["src/b.ts", "src/extra.ts", "src/gone.ts", "src/new.ts"]
    assert by["src/new.ts"]["status"] == "renamed" and by["src/new.ts"]["prevPath"] == "src/old.ts"
    assert [i["resolvedPath"] for i in by["src/b.ts"]["directImports"]] == ["src/c.ts"]
    assert [c["path"] for c in by["src/b.ts"]["directCallers"]] == ["src/a.ts"]
    assert [[n["path"] for n in tier] for tier in by["src/b.ts"]["multiHop"]["reverseTiers"]] == [["src/a.ts"], ["src/extra.ts"]]
    assert by["src/gone.ts"]["fullContent"] == "" and by["src/gone.ts"]["semanticNeighbors"] == []
    assert by["src/b.ts"]["dependencyContents"]["src/c.ts"]["content"].startswith("1: export class C")
    assert "node_modules/x/index.js" not in json.dumps(document) and "src/naïve name.ts" in by["src/b.ts"]["siblings"]
    assert document["rules"] == {"AGENTS.md": "Be kind.\n", ".cursorrules": "Be brief.\n"} and document["meta"]["graphEdgeCount"] == 5
    assert by["src/new.ts"]["patch"].startswith("diff --git ") and by["src/new.ts"]["additions"] == 2 and by["src/gone.ts"]["deletions"] == 1
    assert document["meta"]["embeddings"]["cacheMisses"] == document["meta"]["indexedFileCount"]

    path = tmp_path / "bundle.json"
    path.write_text(json.dumps(document))
    read = bundles.read_bundle(spark, str(path))
    assert json.loads(bundles.bundle_json(read).first().value) == document
    files = tree.read_tree(spark, str(repo))
    note = spark.createDataFrame([(options.memory_path, memory.ensure(options.memory_path))], "name string, content string")
    report = A.audit(read, tree.entries_of(files, files).select("path"), extract.stripped_sources(files), tree.rules(files), note)
    assert not report.failed and report.issues.filter("severity = 'error'").count() == 0, report.text()
    assert report.counters["existence"]["checked"] > 5

    docs = {r.name: r.content for r in render.documents(read).collect()}
    assert {"00-overview.md", "rules-and-memory.md", "prelude-context.md", "buckets/99-misc/pass2.md"} <= set(docs)
    assert "`src/b.ts`" in docs["buckets/99-misc/pass2.md"] and "`src/old.ts` to `src/new.ts`" in docs["prelude-context.md"]
    assert "Be kind." in docs["rules-and-memory.md"] and "return c + 1" in docs["buckets/99-misc/pass1+3.md"]
    prompt = render.file_prompt(read, "b.ts").first()
    assert prompt.name == "src/b.ts" and "  src/a.ts uses { b }" in prompt.content
    assert render.with_preamble(render.file_prompt(read), "/w").first().content.startswith("Work in `/w`")

    assert cli.main(["split", str(path), str(tmp_path / "out"), "/w"]) == 0
    assert (tmp_path / "out/buckets/99-misc/pass4.md").exists()
    assert cli.main(["split", str(path), str(tmp_path / "out")]) == 1
    assert cli.main(["review", str(path), "b.ts"]) == 0
    assert cli.main(["audit", str(path), str(repo)]) == 0


def test_trees_are_read_whole(spark, repo):
    held = {r.path: r.content for r in tree.read_tree(spark, str(repo), also=["font.woff"]).collect()}
    assert {"src/_app.tsx", "src/__tests__/t.ts", ".cursorrules", "logo.png", "src/a+b%20c.ts", "src/naïve name.ts"} <= set(held)
    assert not any("node_modules" in p or ".git/" in p for p in held)
    assert held["logo.png"] is None and held["font.woff"] is not None and held["src/latin.ts"] == "export const caf\ufffd = 1;\n"
    assert set(r.path for r in tree.read_tree(spark, str(repo), "src").collect()) == {p for p in held if p.startswith("src/")}
    assert tree.read_tree(spark, str(repo / "no such")).collect() == []
    far = {r.path: r.content for r in tree.read_tree(spark, f"file://{repo}").collect()}
    assert far == {**held, "font.woff": None}


def test_options():
    o = cli.parse_options(["--max-hops", "3", "--no-embeddings", "stray", "--base", "main"])
    assert (o.max_hops, o.embeddings, o.base, o.max_callers) == (3, False, "main", 15)
    with pytest.raises(SystemExit) as e:
        cli.parse_options(["--unknown", "1"])
    assert e.value.code == 2


def test_first_seen_and_external_merge(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert sorted(tuple(r) for r in lanes.first_seen(a, b, key="k").collect()) == [(1, "x", 0), (2, "y", 0), (3, "w", 1)]
    rows = [("f", 0, "lib", "external", "static", None, ["b", "a"]), ("f", 1, "lib", "external", "static", None, ["a", "c"])]
    merged = B.merge_external(spark.createDataFrame(rows, schemas.EDGES.__class__([schemas.EDGES[n] for n in ("src", "ord", "specifier", "kind", "type", "resolved_path", "named_symbols")])))
    assert merged.first().named_symbols == ["b", "a", "c"]
