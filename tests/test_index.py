"""The index over a small project: build, rebuild, search, context, diff, reports, store."""

import os

import pytest
from pyspark.sql import functions as F

from ctxspark.plans.index import EmptyIndex, Index
from ctxspark.sources import files as scanning
from ctxspark.sources import project, sinks
from ctxspark.sources.store import Store

SOURCES = {
    "src/login.ts": "import { db } from './db';\n/** Logs a user in. */\nexport function loginUser(name: string) { return db(name); }\n",
    "src/db.ts": "export const db = (x) => x;\nexport interface Row { id: number }\n",
    "src/logout.js": "const { db } = require('./db');\nfunction logoutUser() { return db(); }\n",
}


@pytest.fixture()
def root(tmp_path):
    for path, code in SOURCES.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(code)
    return tmp_path


def status(found):
    return {os.path.basename(r["path"]): r["status"] for r in found.collect()}


def test_index_life(spark, root):
    index = Index(spark, str(root))
    with pytest.raises(EmptyIndex):
        index.search("login")
    assert status(index.build()) == dict.fromkeys(("login.ts", "db.ts", "logout.js"), "added")
    row = index.stats().first()
    assert (row["chunks"], row["files"], row["embeddings"], row["edges"]) == (4, 3, 4, 2)
    top = index.search("login user", use_git=False).first()
    assert top["name"] == "loginUser"
    login = next(r["file"] for r in index.store.table("chunks").collect() if r["name"] == "loginUser")
    assert {r["section"] for r in index.context("login user", login).collect()} <= {"graph", "search"}
    assert index.packed_context("login", login).count() >= 1 and index.auto("login", login).count() >= 1
    assert index.packed_search("login").count() >= 1
    changed = spark.createDataFrame([("src/db.ts",)], "path string")
    diff = index.diff("login", changed=changed)
    assert {r["name"] for r in diff["changed"].collect()} == {"db", "Row"}
    assert {r["name"] for r in diff["dependencies"].collect()} == {"loginUser", "logoutUser"}
    assert index.explain()["important"].first()["file"].endswith("db.ts")
    assert set(status(index.build()).values()) == {"unchanged"}
    (root / "src/logout.js").unlink()
    (root / "src/db.ts").write_text("export const db = (x) => [x];\n")
    os.utime(root / "src/db.ts", (2_000_000_000, 2_000_000_000))
    assert status(index.build()) == {"login.ts": "unchanged", "db.ts": "changed", "logout.js": "deleted"}
    assert {r["name"] for r in index.store.table("chunks").collect()} == {"loginUser", "db"}
    assert index.store.table("embeddings").count() == 2
    # the same as a fresh build
    again = Index(spark, str(root), store=str(root / "other"))
    again.build()
    own, fresh = ({r["id"]: r["hash"] for r in i.store.table("chunks").collect()} for i in (index, again))
    assert own == fresh


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.get_meta("a") is None
    store.set_meta("a", "1")
    store.set_meta("b", "2")
    store.set_meta("a", "3")
    assert store.get_meta("a") == "3" and store.table("meta").count() == 2
    store.delete("meta", spark.createDataFrame([("a",), ("none",)], "key string"))
    assert [r["key"] for r in store.table("meta").collect()] == ["b"]
    store.clear()
    assert store.table("meta").count() == 0


def test_scan_honours_gitignore(spark, root):
    (root / ".gitignore").write_text("logout.js\n")
    found = {os.path.basename(r["path"]) for r in scanning.scan(spark, str(root)).collect()}
    assert found == {"login.ts", "db.ts"}


def test_project_detection(spark, tmp_path):
    (tmp_path / "package.json").write_text('{"dependencies": {"express": "1"}, "main": "app.js", "bin": {"x": "cli.js"}}')
    (tmp_path / "src").mkdir()
    (tmp_path / "src/index.ts").write_text("")
    config = project.init(str(tmp_path))
    assert config["language"] == ["javascript"] and config["framework"] == ["express"] and config["structure"] == "src-based"
    assert config["entryPoints"] == ["app.js", "cli.js", "src/index.ts"] and config["include"] == ["**/*.js", "**/*.jsx"]
    assert project.load(spark, str(tmp_path)).first()["version"] == project.VERSION
    assert project.load(spark, str(tmp_path / "src")) is None


def test_sinks(spark):
    rows = spark.createDataFrame([("a#f", "/x/y/a.ts", "f", "function f()", 0.5, "graph", 1)], "id string, file string, name string, signature string, score double, section string, position int")
    assert sinks.lines(rows).first()["line"] == "[0.5000] f  y/a.ts  function f()"
    assert '"name"' in sinks.as_json(rows).first()["json"]
    assert sinks.as_markdown(rows, "Task").first()["markdown"] == "# Task\n\n## graph\n- **y/a.ts**: `function f()`"


def test_empty_sources_index_nothing(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("// nothing declared\n")
    index = Index(spark, str(tmp_path))
    assert status(index.build()) == {"a.ts": "added"}
    assert index.stats().select(F.col("chunks")).first()[0] == 0


def test_git_sources(spark, root):
    """Commits newest first, and sources that differ from a branch."""
    import subprocess

    from ctxspark.sources import git


    def run(*args):
        subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", *args], cwd=root, check=True, capture_output=True)

    run("init", "-q", "-b", "main")
    run("add", "src/db.ts")
    run("commit", "-q", "-m", "one")
    run("checkout", "-q", "-b", "side")
    run("add", ".")
    run("commit", "-q", "-m", "two")
    rows = [(r["commit_ord"], r["path"]) for r in git.log(spark, str(root)).orderBy("commit_ord", "path").collect()]
    assert rows == [(1, "src/login.ts"), (1, "src/logout.js"), (2, "src/db.ts")]
    assert {r["path"] for r in git.changed(spark, str(root)).collect()} == {"src/login.ts", "src/logout.js"}
    (root / "src/db.ts").write_text("changed")
    assert [r["path"] for r in git.changed(spark, str(root), "no-such-branch").collect()] == ["src/db.ts"]
    index = Index(spark, str(root))
    index.build()
    assert index.search("login user").first()["name"] == "loginUser"


def test_names_and_cases(spark):
    from ctxspark.functions import paths
    from ctxspark.functions import text as tx

    row = spark.range(1).select(
        tx.capitalised(F.lit("data access")).alias("c"), tx.first_filled(F.lit(""), F.lit("b")).alias("f"), tx.short_path(F.lit("a\\b\\c.ts")).alias("s"),
        paths.resolved(F.lit("/a/b"), F.lit("../c/./d.ts")).alias("r"), tx.quarter_tokens(F.lit("abcde")).alias("q"),
    ).first()
    assert tuple(row) == ("Data access", "b", "b/c.ts", "/a/c/d.ts", 12)


def test_rendered_context(spark):
    rows = [("graph", 2, "/x/y/b.ts", "g", "", None), ("graph", 1, "/x/y/a.ts", "f", "function f()", None), ("search", 1, "z.ts", "h", "h(x)", 0.25)]
    listed = spark.createDataFrame(rows, "section string, position int, file string, name string, signature string, score double")
    text = lambda style: sinks.render(listed, sinks.CONTEXT[style], task="fix it", target="y/a.ts").first()["text"]
    assert text("text") == "ARCH:\n  y/a.ts: function f()\n  y/b.ts: g\n\nCONTEXT:\n  z.ts: h(x)\n\nTASK:\n  fix it\n"
    assert text("markdown") == (
        "# Context for: fix it\n\n**Target file:** `y/a.ts`\n\n## Architecture (dependencies)\n\n- `y/a.ts`: `function f()`\n- `y/b.ts`: `g`\n"
        "\n## Relevant code\n\n- **h** (`z.ts`): `h(x)`\n\n## Task\n\nfix it\n"
    )
    assert text("prompt").startswith("I'm working on the file `y/a.ts`") and text("prompt").endswith("z.ts: h(x)\n\n## Task\n\nfix it")
    import json

    found = json.loads(sinks.context_json(listed, "fix it", None).first()["json"])
    assert found["file"] is None and found["totalEntries"] == 3 and found["entries"][2] == {"file": "z.ts", "name": "h", "signature": "h(x)", "score": 0.25, "source": "search"}
    assert sinks.render(listed.limit(0), sinks.DIFF["markdown"], task="t").first()["text"] == "\n# PR Context: t\n\n## Changed files (0 chunks)\n\n\n## Dependencies (0 chunks)\n\n\n## Related code\n\n"


def test_texts_of_an_index(spark, root):
    index = Index(spark, str(root))
    index.build()
    login = next(r["file"] for r in index.store.table("chunks").collect() if r["name"] == "loginUser")
    text = index.context_text("login user", login, tokens=500).first()["text"]
    assert text.startswith("ARCH:\n") and "src/login.ts: export function loginUser(name: string)" in text and text.endswith("TASK:\n  login user\n")
    changed = spark.createDataFrame([("src/db.ts",)], "path string")
    text = index.diff_text("login", style="markdown", changed=changed).first()["text"]
    assert "## Changed files (2 chunks)\n\n- `src/db.ts`: `export const db = (x) =>`\n" in text and "## Dependencies (2 chunks)" in text
