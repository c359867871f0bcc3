"""What a tree says about itself: README, manifests, module comments, build commands, maintained areas.

All work on texts; ``Folder`` reads the few small files they need through the
file system that Spark knows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import SparkSession

# Names of files that describe a tree.
READMES = ("README.md", "README", "readme.md", "Readme.md", "README.rst", "README.txt")
MANIFESTS = ("Cargo.toml", "package.json", "go.mod", "pyproject.toml", "setup.py", "Package.swift", "build.gradle.kts", "build.gradle")
MODULE_ROOTS = ("lib.rs", "main.rs", "mod.rs", "index.ts", "index.tsx", "index.js", "__init__.py", "main.go", "main.py", "app.py", "main.ts", "main.swift", "Main.kt")
SCRIPTS = ("dev", "start", "build", "test", "check", "typecheck", "lint")
LOCK_FILES = {"pnpm-lock.yaml": "pnpm", "yarn.lock": "yarn", "bun.lockb": "bun", "bun.lock": "bun"}
TARGETS = ("help", "all", "build", "test", "check", "lint", "install", "clean")
NOISE = ("copyright", "spdx", "eslint", "@ts-", "prettier")

Text = Callable[[str], str | None]


class Folder:
    """Small files below a root, by their path; None for those that aren't there or aren't UTF-8."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.known = spark, root.rstrip("/"), {}

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}" if path else self.root)

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def has(self, path: str) -> bool:
        return self._fs().exists(self._path(path))

    def __call__(self, path: str) -> str | None:
        if path not in self.known:
            self.known[path] = None
            if self.has(path) and not self._fs().getFileStatus(self._path(path)).isDirectory():
                stream = self._fs().open(self._path(path))
                try:
                    self.known[path] = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
                except UnicodeDecodeError:
                    pass
                finally:
                    stream.close()
        return self.known[path]


def below(directory: str, name: str) -> str:
    return f"{directory}/{name}" if directory else name


def plain(text: str) -> str:
    """Inline marks removed; links keep their text. A link's target ends at the first bracket after its opening."""
    out, rest = "", text
    while (at := rest.find("[")) >= 0:
        inner = rest[at + 1 :]
        mid, end = inner.find("]("), inner.find(")")
        if 0 <= mid < end:
            out, rest = out + rest[:at] + inner[:mid], inner[end + 1 :]
        else:
            out, rest = out + rest[: at + 1], inner
    return re.sub(r"\*\*|`|__", "", out + rest)


def sentence(text: str, limit: int) -> str:
    """The first sentence of more than twelve bytes, white space collapsed, at most so many characters."""
    flat = " ".join(text.split())
    cut = next((flat[: m.end()] for m in re.finditer(r"\.(?= )", flat) if len(flat[: m.start()].encode()) > 12), flat)
    return cut if len(cut) <= limit else cut[: max(0, limit - 3)] + "..."


def readme(text: str) -> tuple[str | None, str] | None:
    """Title and first paragraph of prose; None without either."""
    title, found, fenced = None, [], False
    for line in map(str.strip, text.splitlines()):
        if line.startswith("```"):
            fenced = not fenced
        elif fenced:
            continue
        elif line.startswith("# "):
            if found:
                break
            title = title or plain(line[2:]).strip()
        elif not line or line.startswith(("#", "[![", "![", "<", "|", "---", "===")):
            if found:
                break
        else:
            found.append(plain(line))
    return (title, sentence(" ".join(found), 360)) if found or title is not None else None


def purpose_of_tree(text: Text) -> tuple[str | None, str] | None:
    first = next((t for n in READMES if (t := text(n)) is not None), None)
    return None if first is None else readme(first)


def description(text: Text, directory: str) -> str | None:
    """The one line in which a manifest says what it is."""
    try:
        value = json.loads(text(below(directory, "package.json")) or "{}")
    except ValueError:
        value = {}
    said = value.get("description") if isinstance(value, dict) else None
    if isinstance(said, str) and said.strip():
        return sentence(said, 110)
    for name in ("Cargo.toml", "pyproject.toml"):
        for line in (text(below(directory, name)) or "").splitlines():
            if (m := re.match(r"\s*description\s*=*\s*\"*(.*?)\"*\s*$", line)) and m[1]:
                return sentence(m[1], 110)
    return None


def module_doc(source: str, extension: str) -> str | None:
    """The comment or docstring that a source file begins with, without licence and linter lines."""
    lines = [x for x in map(str.strip, source.splitlines()) if not x.startswith("#!")]
    found: list[str] = []
    if extension == "py":
        while lines and (not lines[0] or lines[0].startswith("#")):
            lines.pop(0)
        mark = lines[0][:3] if lines else ""
        if mark not in ('"""', "'''"):
            return None
        body = "\n".join([lines[0][3:], *lines[1:]])
        body = body.split(mark)[0].strip("\n")
        found = body.split("\n\n")[0].split("\n")
    else:
        for line in lines:
            m = re.match(r"(//!|///|//|/\*\*|/\*|\*/|\*)", line)
            if not m:
                if line or found:
                    break
                continue
            said = "" if m[1] == "*/" else line[m.end() :].strip().removesuffix("*/").strip()
            if not said and found:
                break
            if said and not said.lower().startswith(NOISE):
                found.append(said)
    said = plain(" ".join(found)).strip()
    return sentence(said, 110) if len(said.encode()) >= 8 else None


def directory_purpose(text: Text, directory: str, paths: list[str]) -> str | None:
    """What a directory is for: by its manifest, its module's comment, or its README. paths: of files in it."""
    if said := description(text, directory):
        return said
    homes = (directory, below(directory, "src"))
    roots = sorted((p for p in paths if p.rpartition("/")[2] in MODULE_ROOTS and p.rpartition("/")[0] in homes), key=len)
    for path in roots:
        if said := module_doc(text(path) or "", path.rpartition(".")[2]):
            return said
    first = next((t for n in READMES if (t := text(below(directory, n))) is not None), "")
    found: list[str] = []
    for line in map(str.strip, first.splitlines()):
        if found and (not line or line[0] in "#|"):
            break
        if found or not (not line or line.startswith(("#", "<", "[!", "![", "|", "```"))):
            found.append(line)
    return sentence(plain(" ".join(found)), 110) if found else None


def commands(folder: Folder, directory: str) -> list[str]:
    """How to build and test what is in a directory, by its manifests."""
    place, out = f"{directory}/" if directory else ".", []
    at = lambda name: below(directory, name)
    if (cargo := folder(at("Cargo.toml"))) is not None:
        whole, up, inside = "[workspace]" in cargo, directory, False
        while up and not whole:
            up = up.rpartition("/")[0]
            inside = inside or "[workspace]" in (folder(below(up, "Cargo.toml")) or "")
        if not inside:
            out.append(f"{place} (Rust {'workspace' if whole else 'crate'}): `cargo build` · `cargo test`")
    try:
        scripts = json.loads(folder(at("package.json")) or "{}").get("scripts") or {}
    except (ValueError, AttributeError):
        scripts = {}
    runner = next((r for f, r in LOCK_FILES.items() if folder.has(at(f))), "npm")
    if chosen := [f"`{runner} run {s}`" for s in SCRIPTS if s in scripts]:
        out.append(f"{place} (package.json, {runner}): {' · '.join(chosen)}")
    if folder.has(at("go.mod")):
        out.append(f"{place} (Go module): `go build ./...` · `go test ./...`")
    if folder.has(at("pyproject.toml")) or folder.has(at("setup.py")):
        out.append(f"{place} (Python): `{'uv run ' if folder.has(at('uv.lock')) else ''}pytest`")
    if folder.has(at("Package.swift")):
        out.append(f"{place} (Swift package): `swift build` · `swift test`")
    if folder.has(at("gradlew")):
        out.append(f"{place} (Gradle): `./gradlew build` · `./gradlew test`")
    names = dict.fromkeys(re.findall(r"^([A-Za-z0-9-][A-Za-z0-9_-]*):", folder(at("Makefile")) or "", re.M))
    order = {n: i for i, n in enumerate(TARGETS)}
    if names:
        out.append(f"{place} (Makefile): {' · '.join(f'`make {n}`' for n in sorted(names, key=lambda n: order.get(n, len(order)))[:6])}")
    return out


class Areas:
    """Titles of maintained areas by directory. offset: where the mapped root lies below the file that lists them."""

    def __init__(self, text: str, offset: str = ""):
        self.offset, self.titles = offset.strip("/"), {}
        title = None
        for line in text.splitlines():
            if not line.strip():
                title = None
            elif not re.match(r"[A-Z]:.", line):
                title = title or line.strip()
            elif title and (m := re.match(r"F:\s*([^*?\[]+?)/\*?$", line.rstrip())):
                known = self.titles.setdefault(m[1], [])
                if title not in known:
                    known.append(title)

    def full(self, directory: str) -> str:
        return "/".join(x for x in (self.offset, directory) if x)

    def covering(self, directory: str) -> str | None:
        """The title of the closest area that holds a directory."""
        at = self.full(directory)
        while at not in self.titles:
            if not at:
                return None
            at = at.rpartition("/")[0]
        return self.titles[at][0]

    def inside(self, directory: str, counts: dict[str, int], most: int = 4) -> list[str]:
        """Titles of the areas in a directory that hold most of its files. counts: files by their directory."""
        stop, found = self.full(directory), {}
        for d, n in counts.items():
            at = self.full(d)
            while len(at) > len(stop) and at not in self.titles:
                at = at.rpartition("/")[0]
            if len(at) > len(stop):
                found[self.titles[at][0]] = found.get(self.titles[at][0], 0) + n
        return sorted(found, key=lambda t: (-found[t], t))[:most]


def find_areas(spark: SparkSession, root: str, up: int = 6) -> Areas | None:
    """Areas from a MAINTAINERS file in the root or one of so many directories above it."""
    at, parts = root.rstrip("/"), []
    for _ in range(up + 1):
        if (text := Folder(spark, at)("MAINTAINERS")) is not None:
            areas = Areas(text, "/".join(reversed(parts)))
            return areas if areas.titles else None
        at, _, last = at.rpartition("/")
        parts.append(last)
        if not at or at.endswith(":"):
            break
    return None
