"""Project detection: languages, frameworks, structure, patterns, entry points. Inputs are a few names; this is driver work."""

from __future__ import annotations

import json
import os


from pyspark.sql import DataFrame, SparkSession

# Fixed value: the configuration's version.
VERSION = "1.0.0"
CONFIG = os.path.join(".ctxspark", "config.json")
# Marker files and suffixes of languages.
MARKERS = {
    "javascript": (["package.json", "tsconfig.json"], []),
    "typescript": (["tsconfig.json"], [".ts"]),
    "python": (["requirements.txt", "pyproject.toml", "setup.py", "Pipfile"], []),
    "go": (["go.mod", "go.sum"], []),
    "rust": (["Cargo.toml"], []),
    "java": (["pom.xml", "build.gradle", "build.gradle.kts"], []),
    "ruby": (["Gemfile"], []),
    "php": (["composer.json"], []),
    "swift": (["Package.swift"], []),
    "dart": (["pubspec.yaml"], []),
    "csharp": ([".csproj"], [".sln"]),
}
# Languages by the extension of sources.
EXTENSIONS = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python",
    ".go": "go", ".rs": "rust", ".java": "java", ".rb": "ruby", ".php": "php",
}
# Frameworks by npm dependency.
FRAMEWORKS = {
    "express": "express", "fastify": "fastify", "koa": "koa", "next": "nextjs", "nuxt": "nuxt", "react": "react", "vue": "vue",
    "angular": "angular", "svelte": "svelte", "nestjs": "nestjs", "@nestjs/core": "nestjs", "prisma": "prisma",
    "@prisma/client": "prisma", "mongoose": "mongoose", "sequelize": "sequelize", "typeorm": "typeorm",
}
# Frameworks that requirements name.
PYTHON_FRAMEWORKS = ["django", "flask", "fastapi"]
# Globs by language, and what is never indexed.
GLOBS = {
    "typescript": ["**/*.ts", "**/*.tsx"], "javascript": ["**/*.js", "**/*.jsx"], "python": ["**/*.py"], "go": ["**/*.go"],
    "rust": ["**/*.rs"], "java": ["**/*.java"], "ruby": ["**/*.rb"], "php": ["**/*.php"],
}
IGNORED = [
    "node_modules/**", "dist/**", "build/**", ".git/**", "coverage/**", ".next/**", ".nuxt/**", "__pycache__/**",
    "*.min.js", "*.bundle.js", "*.map",
]
# Test globs by configuration file.
TESTS = [
    (["jest.config.js", "jest.config.ts"], ["**/*.test.ts", "**/*.test.js", "**/*.spec.ts", "**/*.spec.js"]),
    ([".mocharc.yml", ".mocharc.json"], ["test/**/*.js", "test/**/*.ts"]),
    (["pytest.ini", "pyproject.toml"], ["tests/**/*.py", "test_*.py"]),
]
# Test globs of any other project, usual entry points, files of a workspace.
OTHER_TESTS = ["test/**", "tests/**", "**/*.test.*", "**/*.spec.*"]
ENTRY_POINTS = [
    "src/index.ts", "src/index.js", "src/main.ts", "src/main.js", "app.js", "app.ts", "server.js", "server.ts", "index.js", "index.ts",
]
WORKSPACES = ["lerna.json", "pnpm-workspace.yaml", "turbo.json"]
# A project's structure by its folders, in this order: some of the first are there, and some of the second or, without these, a workspace file.
STRUCTURES = [
    ({"packages", "apps", "services"}, WORKSPACES, "monorepo", "multi-package"),
    ({"controllers", "components"}, {"services", "models", "dal"}, "mvc-layered", "component-based"),
    ({"features", "modules"}, {"features", "modules"}, "feature-based", "feature-based"),
    ({"src"}, {"src"}, "src-based", "src-based"),
]
SCHEMA = (
    "version string, language array<string>, framework array<string>, structure string, include array<string>, "
    "ignore array<string>, testPatterns array<string>, entryPoints array<string>"
)


def _text(*path: str) -> str:
    try:
        with open(os.path.join(*path), encoding="utf-8") as lines:
            return lines.read()
    except OSError:
        return ""


def _package(root: str) -> dict:
    try:
        found = json.loads(_text(root, "package.json") or "{}")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def languages(root: str) -> list[str]:
    names = sorted(os.listdir(root))
    found = [
        language for language, (files, suffixes) in MARKERS.items()
        if any(n in files or any(n.endswith(s) for s in suffixes) for n in names)
    ]
    if found:
        return found
    deep = (os.path.splitext(f)[1] for _, _, files in os.walk(os.path.join(root, "src")) for f in sorted(files))
    return list(dict.fromkeys(EXTENSIONS[e] for e in deep if e in EXTENSIONS))


def frameworks(root: str) -> list[str]:
    package = _package(root)
    have = {**(package.get("dependencies") or {}), **(package.get("devDependencies") or {})}
    found = [name for dependency, name in FRAMEWORKS.items() if have.get(dependency)]
    required = _text(root, "requirements.txt").lower()
    return list(dict.fromkeys(found + [name for name in PYTHON_FRAMEWORKS if name in required]))


def structure(root: str) -> str:
    try:
        dirs = {f.name.lower() for f in os.scandir(root) if f.is_dir()}
    except OSError:
        return "unknown"
    for some, more, both, else_ in STRUCTURES:
        if dirs & some:
            fits = any(os.path.exists(os.path.join(root, w)) for w in more) if more is WORKSPACES else bool(dirs & more)
            return both if fits else else_
    return "flat"


def detect(root: str = ".") -> dict:
    there = lambda f: os.path.exists(os.path.join(root, f))
    known = languages(root)
    include = list(dict.fromkeys(g for x in known for g in GLOBS.get(x, []))) or ["**/*.ts", "**/*.js"]
    tests = [g for files, globs in TESTS if any(map(there, files)) for g in globs] or OTHER_TESTS
    package = _package(root)
    entries = [package["main"]] if package.get("main") else []
    programs = package.get("bin") or []
    entries += [programs] if isinstance(programs, str) else list(programs.values()) if isinstance(programs, dict) else []
    return {
        "version": VERSION, "language": known, "framework": frameworks(root), "structure": structure(root), "include": include,
        "ignore": list(IGNORED), "testPatterns": list(tests), "entryPoints": list(dict.fromkeys(entries + [f for f in ENTRY_POINTS if there(f)])),
    }


def init(root: str = ".") -> dict:
    """Detect, and write the configuration below root."""
    config = detect(root)
    path = os.path.join(root, CONFIG)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        json.dump(config, out, indent=2)
    return config


def load(spark: SparkSession, root: str = ".") -> DataFrame | None:
    """The written configuration as one row, or None."""
    path = os.path.join(root, CONFIG)
    return spark.read.schema(SCHEMA).json(path, multiLine=True) if os.path.exists(path) else None
