"""Ignore rules against git itself, and scans of a project with nested ignore files."""

import subprocess

import pytest

from ctxspark.sources import files as scanning
from ctxspark.sources import ignore

IGNORES = {
    "": "# comment\n\n*.log\n!keep.log\n/build\nout/\n\\#odd\n\\!bang\ntmp*/\ndoc/**/draft\n**/cache\na/**/z\nfoo/**\n[ab]x.ts\n[!q]y.ts\nq?.js\nspace \\ \ntrail  \n*.gen.ts\n!src/special.gen.ts\n/vendor/*\n!/vendor/kept\n",
    "src": "!*.log\n/local.ts\nsub/skip.ts\n*.js\n!q1.js\n",
    "src/sub": "deep/\n!deep/\n*.ts\n!ok.ts\n",
}
PATHS = """a.log keep.log build/x.ts src/build/x.ts out out2 dir/out/x.ts dir/out #odd !bang tmp/x tmpfile/y src/tmp1/z doc/draft doc/a/draft doc/a/b/draft/x.ts
cache/x x/cache/y a/z a/b/z a/b/c/z/k foo/x foo/y/z ax.ts bx.ts cx.ts qy.ts ay.ts q1.js qq.js src/q1.js src/q12.js src/m.js src/a.log src/keep.log src/local.ts
src/x/local.ts src/sub/skip.ts src/sub/ok.ts src/sub/other.ts src/sub/deep/ok.ts src/sub/deep/no.ts x.gen.ts src/special.gen.ts src/other.gen.ts
vendor/a/x vendor/kept/y trail src/sub/a.log lib/é.ts deep/er/still/a.log""".split() + ["space  ", "trail  "]


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("ignore")
    files = [p for p in PATHS if p not in ("out", "dir/out", "trail  ", "space  ")]
    for path in files:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text("x")
    for folder, text in IGNORES.items():
        (root / folder / ".gitignore").write_text(text)
    subprocess.run(["git", "init", "-q"], cwd=root, check=True)
    asked = subprocess.run(["git", "check-ignore", "--stdin", "-z", "--no-index"], cwd=root, input="\0".join(files), capture_output=True, text=True)
    return root, files, set(filter(None, asked.stdout.split("\0")))


def test_rules_are_those_of_git(spark, project):
    root, files, expected = project
    assert 10 < len(expected) < len(files) - 10
    rules = spark.createDataFrame(ignore.read_rules(spark, str(root), files), ignore.RULES)
    texts = spark.createDataFrame(list(IGNORES.items()), "dir string, text string")
    assert sorted(map(tuple, ignore.rules(texts).collect())) == sorted(map(tuple, rules.collect()))
    found = ignore.ignored(spark.createDataFrame([(p,) for p in files * 2], "relative string"), rules)
    assert sorted(r["relative"] for r in found.collect()) == sorted(expected)


def test_scan_takes_nested_rules(spark, project):
    root, files, expected = project
    found = {r["path"].removeprefix(f"{root}/") for r in scanning.listing(spark, str(root), include=["**/*.ts", "**/*.js"], ignore=[]).collect()}
    assert found == {p for p in files if p.endswith((".ts", ".js"))} - expected


def test_no_rules_and_no_paths(spark):
    none = spark.createDataFrame([], ignore.RULES)
    paths = spark.createDataFrame([("a/b.ts",)], "relative string")
    assert ignore.ignored(paths, none).collect() == []
    some = ignore.rules(spark.createDataFrame([("", "*.ts\n\n# c\n/\n!"), ("x", None)], "dir string, text string"))
    assert some.count() == 1 and ignore.ignored(paths.limit(0), some).collect() == []
