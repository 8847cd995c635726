"""Command line: build a bundle, audit it, split it, pick a file, or edit the memory.

    python -m ctxloom.cli [options]                 the bundle, to --out or standard output
    python -m ctxloom.cli audit BUNDLE ROOT         exit status 1 if a category fails
    python -m ctxloom.cli split BUNDLE OUT [TREE]   documents, one file each; OUT must be empty
    python -m ctxloom.cli review BUNDLE [FILE] [--worktree TREE]
    python -m ctxloom.cli memory show|rule|suppress|note|clear-cache [TEXT]
"""

from __future__ import annotations

import argparse
import logging
import os
import shutil
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import attach
from .operators import audit as A
from .operators import extract
from .plans import bundle as plan
from .plans import render
from .sources import bundles, embeddings, memory, tree

log = logging.getLogger("ctxloom")


def session() -> SparkSession:
    spark = SparkSession.builder.appName("ctxloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    attach(spark)
    return spark


def options_parser() -> argparse.ArgumentParser:
    d = plan.Options()
    p = argparse.ArgumentParser(prog="ctxloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("base", "root", "scope", "out", "memory_path", "cache_path", "embedding_model"):
        p.add_argument(f"--{name.replace('_', '-')}", default=getattr(d, name))
    p.add_argument("--ollama-url", dest="embedding_url", default=d.embedding_url)
    for name in ("max_file_bytes", "max_callers", "max_siblings", "max_hops", "max_per_parent", "max_neighbors", "embed_max_chars", "embed_batch_size"):
        p.add_argument(f"--{name.replace('_', '-')}", type=int, default=getattr(d, name))
    p.add_argument("--include-content-for-deps", action="store_true")
    p.add_argument("--no-workspaces", dest="include_workspaces", action="store_false")
    p.add_argument("--no-embeddings", dest="embeddings", action="store_false")
    p.add_argument("--no-memory", dest="use_memory", action="store_false")
    p.add_argument("rest", nargs="*", help=argparse.SUPPRESS)
    return p


def parse_options(args: list[str]) -> plan.Options:
    """Options of a run; unknown ones end with status 2, stray words are passed over."""
    found = vars(options_parser().parse_args(args))
    found.pop("rest")
    return plan.Options(**found)


def build(args: list[str]) -> int:
    options = parse_options(args)
    spark = session()
    embed = embeddings.http_embedder(options.embedding_model, options.embedding_url) if options.embeddings else None
    if embed is not None:
        try:
            embed(["probe"])
        except Exception as e:  # noqa: BLE001  without a model there are no neighbours
            log.warning("embeddings are off: %s", e)
            embed = None
    try:
        inputs = plan.gather(spark, options, embed)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    document = bundles.bundle_json(plan.assemble(inputs, options)).first().value
    if options.out:
        with open(options.out, "w", encoding="utf-8") as f:
            f.write(document + "\n")
    else:
        print(document)
    return 0


def run_audit(args: list[str]) -> int:
    path, root = args
    spark = session()
    bundle = bundles.read_bundle(spark, path)
    files = tree.read_tree(spark, root)
    held = bundle.select("memory.path").first()
    rows = []
    if held.path and os.path.exists(held.path):
        with open(held.path, encoding="utf-8") as f:
            rows.append((held.path, f.read()))
    existing = tree.entries_of(files, files).select("path")
    note = spark.createDataFrame(rows, "name string, content string")
    report = A.audit(bundle, existing, extract.stripped_sources(files.filter(F.col("path").isNotNull())), tree.rules(files), note)
    print(report.text())
    return int(report.failed)


def split(args: list[str]) -> int:
    path, out, *worktree = args
    if os.path.exists(out) and os.listdir(out):
        print(f"{out} is not empty", file=sys.stderr)
        return 1
    spark = session()
    docs = render.documents(bundles.read_bundle(spark, path))
    for sub in ("buckets", "outputs"):
        os.makedirs(os.path.join(out, sub), exist_ok=True)
    for row in render.with_preamble(docs, worktree[0] if worktree else None).toLocalIterator():
        target = os.path.join(out, row.name)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "w", encoding="utf-8") as f:
            f.write(row.content)
    return 0


def review(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="ctxloom review")
    p.add_argument("bundle")
    p.add_argument("file", nargs="?")
    p.add_argument("--worktree")
    a = p.parse_args(args)
    prompt = render.with_preamble(render.file_prompt(bundles.read_bundle(session(), a.bundle), a.file), a.worktree).first()
    target = f"{a.bundle}.review.prompt.md"
    with open(target, "w", encoding="utf-8") as f:
        f.write(prompt.content)
    print(target)
    return 0


def edit_memory(args: list[str]) -> int:
    options = argparse.ArgumentParser(prog="ctxloom memory")
    d = plan.Options()
    options.add_argument("--memory-path", default=d.memory_path)
    options.add_argument("--cache-path", default=d.cache_path)
    options.add_argument("command", choices=["show", *memory.SECTIONS, "clear-cache"])
    options.add_argument("text", nargs="*")
    a = options.parse_args(args)
    if a.command == "show":
        print(memory.ensure(a.memory_path))
    elif a.command == "clear-cache":
        shutil.rmtree(a.cache_path, ignore_errors=True)
    else:
        text = " ".join(a.text).strip()
        if not text:
            print("nothing to add", file=sys.stderr)
            return 2
        memory.append(a.memory_path, memory.SECTIONS[a.command], text)
    return 0


def main(args: list[str]) -> int:
    commands = {"audit": run_audit, "split": split, "review": review, "memory": edit_memory}
    if args and args[0] in commands:
        return commands[args[0]](args[1:])
    return build(args)


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO)
    sys.exit(main(sys.argv[1:]))
