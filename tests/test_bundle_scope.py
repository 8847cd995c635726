"""A bundle with a scope and a workspace package outside it."""

import json
import subprocess

from ctxloom.plans import bundle as plan
from ctxloom.sources import bundles


def test_package_outside_the_scope_is_embedded(spark, tmp_path):
    root = tmp_path / "tree"
    files = {
        "package.json": '{"workspaces": ["packages/*"]}',
        "packages/ui/package.json": '{"name": "@x/ui"}',
        "packages/ui/button.ts": "export const button = 1;\n",
        "app/main.ts": "export const main = 1;\n",
        "other/far.ts": "export const far = 1;\n",
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "base")
    git("branch", "dev")
    (root / "app/main.ts").write_text("export const main = 2;\n")
    options = plan.Options(root=str(root), scope="app", memory_path=str(tmp_path / "m.md"), cache_path=str(tmp_path / "cache"))
    inputs = plan.gather(spark, options, lambda texts: [[float(len(t)), 1.0] for t in texts])
    document = json.loads(bundles.bundle_json(plan.assemble(inputs, options, "now")).first().value)
    (changed,) = document["files"]
    assert [n["path"] for n in changed["semanticNeighbors"]] == ["packages/ui/button.ts"]
    assert document["meta"]["indexedFileCount"] == document["meta"]["embeddings"]["cacheMisses"] == 2
