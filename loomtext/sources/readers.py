"""Definition readers: from a source file to rows of definitions, symbols and imports.

Languages of which each line tells by itself have one rule: groups ``kind`` and
``name``. Grouped Go declarations, classes of scripts and C have readers of their
own. A reader that fails on a file gives no definitions; the file keeps its row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_DEFINITIONS = MOST_IMPORTS = 24
_ID = r"[A-Za-z_]\w*"
_NAME = r"[^A-Za-z0-9_\n]*(?P<name>[A-Za-z0-9_]+)"

# What stands before a definition's keyword and doesn't belong to it, and the keywords.
_RUST_LEAD = r'^\s*(?:(?:pub(?:\([^)]*\))?|async|unsafe|default|const(?= (?:fn|unsafe|async|extern) )|extern(?: "[^"]*")?(?= (?:fn|unsafe) )) +)*'
_JAVA_LEAD = r"^\s*(?:public )?(?:private )?(?:protected )?(?:internal )?(?:open )?"
RULES = {
    "rust": re.compile(_RUST_LEAD + rf"(?P<kind>fn|struct|enum|trait|type|union|mod|static(?= mut )|static|const) (?:mut )?{_NAME}"),
    "python": re.compile(rf"^\s*(?:async (?=def ))?(?P<kind>def|class) {_NAME}"),
    "java": re.compile(_JAVA_LEAD + rf"(?P<kind>class|interface|enum|struct|protocol|fun|func) {_NAME}"),
    "ruby": re.compile(rf"^\s*(?P<kind>def|class|module) {_NAME}"),
    "php": re.compile(rf"^\s*(?:public )?(?P<kind>function|class|interface|trait) {_NAME}"),
}
_RUST_MACRO = re.compile(_RUST_LEAD + rf"macro_rules! {_NAME}")
_RUST_IMPL = re.compile(_RUST_LEAD + r"impl (?P<head>[^{}]*)")
_IMPORTS = {"rust": re.compile(r"^\s*(?:(?:pub )?use crate|use super|use self)::(?P<path>.*?);*\s*$"), "python": re.compile(r"^\s*(?:from|import) +(?P<path>\S+)")}
LANGUAGE = {
    "rs": "rust", "py": "python", "java": "java", "kt": "java", "kts": "java", "swift": "java", "cs": "java", "rb": "ruby", "php": "php", "go": "go",
    "ts": "script", "tsx": "script", "js": "script", "jsx": "script", "mjs": "script", "cjs": "script", "svelte": "component", "vue": "component",
    "c": "c", "h": "c", "cc": "c", "cpp": "c", "hpp": "c",
}

#: (kind, definition, symbol): kinds are def, macro (after the rest in a record) and import; symbols may be missing.
Row = tuple[str, str, str | None]


def _short(text: str, most: int) -> str:
    flat = " ".join(text.split())
    return flat if len(flat) <= most else flat[: most - 3] + "..."


def by_rules(text: str, language: str) -> Iterator[Row]:
    """Languages of which each line tells by itself."""
    for line in text.split("\n"):
        if m := RULES[language].match(line):
            if m["name"] != "_":
                yield "def", f"{m['kind']} {m['name']}", m["name"]
        elif language == "rust" and (m := _RUST_MACRO.match(line)):
            yield "def", f"macro {m['name']}", m["name"]
        elif language == "rust" and (m := _RUST_IMPL.match(line)):
            yield "def", _short(f"impl {m['head'].split(' where ')[0].strip()}".strip(), 120), None
        if language in _IMPORTS and (m := _IMPORTS[language].match(line)):
            yield "import", _short(m["path"], 160) if language == "rust" else m["path"].replace(".", "/"), None


def _without_blocks(text: str) -> Iterator[tuple[int, str]]:
    """Indent and content of the lines that aren't in a block comment that begins a line, nor blank or a line comment."""
    inside = False
    for line in text.split("\n"):
        bare = line.strip()
        if inside or bare.startswith("/*"):
            inside = "*/" not in bare[0 if inside else 2 :]
        elif bare and not bare.startswith("//"):
            yield len(line.rstrip()) - len(bare), bare


_GO_FUNC = re.compile(r"func\s+(?:\((?P<receiver>[^()]*)\)\s*)?(?P<name>\w+)")
_GO_KIND = re.compile(r"(?P<kind>type|var|const)(?:\s+(?!\()|\s*(?=\())(?P<rest>.*)")


def go(text: str) -> Iterator[Row]:
    group = level = None

    def declared(kind: str, rest: str) -> Iterator[Row]:
        rest = rest.split("//")[0]
        for part in [rest] if kind == "type" else rest.split("=")[0].split(","):
            if (m := re.match(r"\s*(\w+)", part)) and m[1] != "_" and not m[1][0].isdigit():
                yield "def", f"{kind} {m[1]}", m[1]

    for indent, line in _without_blocks(text):
        if group:
            level = indent if level is None else level
            if not indent and line.startswith(")"):
                group = level = None
            elif indent == level:
                yield from declared(group, line)
        elif indent:
            continue
        elif m := _GO_FUNC.match(line):
            owner = re.match(r"\**(\w*)", (m["receiver"] or " ").split()[-1])[1] if (m["receiver"] or "").split() else ""
            if m["name"] != "_":
                yield "def", f"func {owner}.{m['name']}" if owner else f"func {m['name']}", m["name"]
        elif m := _GO_KIND.match(line):
            if not m["rest"].startswith("("):
                yield from declared(m["kind"], m["rest"])
            elif not m["rest"][1:].strip():
                group, level = m["kind"], None


# Declarations of scripts with their kinds, modifiers of members, what an import's path follows, in this order.
_SCRIPT = re.compile(r"(?:export default )?(?:export )?(?:declare )?(?:abstract (?=class )|async (?=function\b)|const (?=enum ))?(?P<kind>function(?:\*)?|class|interface|type|enum|const|let|var) +(?P<name>[\w$]+)")
_MEMBER = re.compile(r"(?:(?:public|private|protected|static|async|override|readonly|abstract|declare|get|set) +|\*\s*)*#?(?P<name>[\w$]+)\s*\??\s*(?P<after>[<(].*)")
_FROM = (' from "', " from '", 'import "', "import '", 'require("', "require('")


def _imported(line: str) -> str | None:
    for mark in _FROM:
        at = line.find(mark)
        if at >= 0 and (path := line[at + len(mark) :].split(mark[-1])[0].strip()):
            return path
    return None


def _after_angles(text: str) -> str:
    """What follows a group in angle brackets that a text begins with."""
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if not depth:
            return text[i + 1 :].lstrip() if c == ">" else text
    return ""


def script(text: str, base: int | None = 0) -> Iterator[Row]:
    """base: the indent of the top level; None: that of the first line."""
    owner = level = member = None
    for indent, line in _without_blocks(text):
        if (path := _imported(line)) and path[0] in "./":
            yield "import", path, None
        base = indent if base is None else base
        if owner:
            if indent > level:
                member = indent if member is None else member
                if indent == member and (m := _MEMBER.match(line)) and m["name"] != "constructor" and _after_angles(m["after"]).startswith("("):
                    yield "def", f"method {owner}.{m['name']}", m["name"]
                continue
            owner = None
            if line.startswith("}"):
                continue
        if indent == base and (m := _SCRIPT.match(line)) and not (m["kind"] == "class" and m["name"] == "extends"):
            kind = m["kind"].rstrip("*")
            yield "def", f"{kind} {m['name']}", m["name"]
            if kind == "class" and not line.endswith("}"):
                owner, level, member = m["name"], indent, None


_BLOCK = re.compile(r"^[ \t]*<script(?![^\n]*(?:</script|/>[ \t]*$))[^\n]*\n(?P<code>.*?)(?=^[ \t]*</script|\Z)", re.S | re.M)


def component(text: str) -> Iterator[Row]:
    for m in _BLOCK.finditer(text):
        yield from script(m["code"], None)


# C and C++: comments and directives go first; then each declaration that begins a line is cut at its { or ; outside of brackets.
_COMMENT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_DIRECTIVE = re.compile(r"^[ \t]*#(?:[^\n]*\\\n)*[^\n]*", re.M)
_ATTRIBUTE = re.compile(r"\[\[.*?\]\]|\b(?:__attribute__|__attribute|__declspec|alignas)\s*(?=\()")
_MACRO_NAME = re.compile(r"(?=[A-Z0-9_]*[A-Z])[A-Z0-9_]{2,}\Z")
_TYPE = re.compile(rf"(?P<kind>struct|union|enum(?: +(?:class|struct))?|class)\b\s*(?P<rest>.*)\Z", re.S)
_TAIL = re.compile(r"\s*(?:(?:const|noexcept|override|final|volatile)\b\s*|&\s*|__\w*\s*(?:\([^()]*(?:\([^()]*\)[^()]*)*\)\s*)?)*(?::(?!:).*)?\Z", re.S)
NOT_FUNCTIONS = ("if", "for", "while", "switch", "return", "sizeof", "else", "do", "catch", "defined")
MOST_LINES = 32


def _blank(m: re.Match) -> str:
    """A comment as blanks and line ends; a string as it is."""
    return m[0] if m[0][0] in "\"'" else "".join("\n" if c == "\n" else " " for c in m[0])


def _close(text: str, at: int, pair: str = "()") -> int:
    """The place after the bracket that closes the one at a place; the text's end if none does."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == pair[0]) - (text[i] == pair[1])
        if not depth:
            return i + 1
    return len(text)


def _bare(text: str) -> str:
    """A declaration without attributes."""
    while m := _ATTRIBUTE.search(text):
        text = text[: m.start()] + " " + text[m.end() if m[0].startswith("[[") else _close(text, m.end()) :]
    return text


def _typedef_name(text: str) -> str | None:
    at = text.find("(")
    if at >= 0:
        inner = text[at + 1 : max(at + 1, _close(text, at) - 1)]
        text = inner if "*" in inner else text[:at]
    else:
        text = text.split(",")[0].split("[")[0]
    names = [n for n in re.findall(r"[A-Za-z0-9_]+", text) if not n[0].isdigit() and not n.startswith("__")]
    return names[-1] if names else None


def _type_name(text: str) -> tuple[str, str] | None:
    """Kind and name (empty, if it has none) of a type whose body follows."""
    if not (m := _TYPE.match(text)):
        return None
    rest = m["rest"].strip()
    # A word in capitals before the name is a macro.
    while (w := re.match(r"([A-Z0-9_]*[A-Z][A-Z0-9_]*)\s+(?!final\b)(?=[A-Za-z_])", rest)) and _MACRO_NAME.match(w[1]):
        rest = rest[w.end() :]
    n = re.match(rf"(?:{_ID}\s*::\s*)*(?P<name>{_ID})?\s*", rest)
    name, rest = n["name"] or "", rest[n.end() :]
    if rest.startswith("<"):
        rest = _after_angles(rest)
    rest = re.sub(r"^final\b\s*", "", rest)
    return (m["kind"].split()[0], name) if not rest or (rest[0] == ":" and rest[1:2] != ":") else None


def _function(text: str) -> tuple[str, str] | None:
    """How a function whose body follows is shown, and its name."""
    at = text.find("(")
    head = text[:at].rstrip()
    m = re.search(r"[\w:~]+\Z", head, re.A)
    # Its name begins a line or follows a type on one that does.
    if at < 0 or "=" in head or not m or text.count("\n") > MOST_LINES or head.rpartition("\n")[2][:1].isspace():
        return None
    shown = m[0].lstrip(":")
    name = shown.rpartition("::")[2].lstrip("~")
    end = _close(text, at)
    line, _, below = text[end:].partition("\n")
    if not re.match(rf"{_ID}\Z", name, re.A) or name in NOT_FUNCTIONS or ";" in line or "=" in line or not _TAIL.match(below if not line.strip().startswith(":") else ""):
        return None
    if "::" not in shown and _MACRO_NAME.match(name):
        # A macro that makes a function: its first argument is the name.
        first = re.match(rf"\s*({_ID})", text[at + 1 :], re.A)
        return (first[1], first[1]) if first else None
    return None if not m.start() and "::" not in shown else (shown, name)


def _cut(code: str, at: int) -> tuple[int, str]:
    """Where a declaration ends, and its { or ; or nothing, if neither comes outside of brackets."""
    depth = 0
    for m in re.compile(r"[(){};]").finditer(code, at):
        depth = max(0, depth + (m[0] == "(") - (m[0] == ")"))
        if not depth and m[0] in "{};":
            return m.start(), "" if m[0] == "}" else m[0]
    return len(code), ""


def c(text: str) -> Iterator[Row]:
    code, guard = _COMMENT.sub(_blank, text), None
    for m in _DIRECTIVE.finditer(code):
        d = re.match(r"\s*#\s*(?P<word>\w+)\s*(?P<rest>.*)", m[0], re.S)
        if d is None:
            continue
        name = re.match(r"\w*", d["rest"], re.A)[0]
        if d["word"].startswith("ifndef"):
            guard = name
        elif d["word"] == "include" and (path := re.match(r'"([^"]+)"', d["rest"])):
            yield "import", path[1] if path[1].startswith(".") else f"./{path[1]}", None
        elif d["word"] == "define" and re.match(_ID, name):
            after = d["rest"][len(name) :]
            if name != guard or after.strip():
                yield "macro", f"define {name}", name if after.startswith("(") else None
    code = _DIRECTIVE.sub(_blank, code)
    code = re.sub(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", lambda m: m[0][0] + " " * (len(m[0]) - 2) + m[0][-1], code)
    done = 0
    for m in re.finditer(r"^[^\s}]", code, re.M):
        at = m.start()
        if at < done:
            continue
        end, mark = _cut(code, at)
        said = _bare(code[at:end]).strip()
        said = re.sub(r"\Atemplate\s*<[^\n]*>\s*\n?", "", said)
        is_typedef, body = said.startswith("typedef "), said.removeprefix("typedef ").strip()
        if mark == "{" and (kind := _type_name(body)):
            done = end
            if kind[1]:
                yield "def", " ".join(kind), kind[1]
            if is_typedef and (name := _typedef_name(code[_close(code, end, "{}") : _cut(code, _close(code, end, "{}"))[0]])):
                yield "def", f"typedef {name}", name
        elif is_typedef:
            if mark == ";" and (name := _typedef_name(body)):
                yield "def", f"typedef {name}", name
        elif mark == "{" and (found := _function(said)):
            done = end
            yield "def", f"fn {found[0]}", found[1]


def read(text: str, extension: str) -> list[Row]:
    """(kind, definition, symbol) in the order of the file; none for languages without a reader."""
    match LANGUAGE.get(extension.lower()):
        case None:
            return []
        case "go":
            return list(go(text))
        case "script":
            return list(script(text))
        case "component":
            return list(component(text))
        case "c":
            return list(c(text))
        case language:
            return list(by_rules(text, language))


def record(text: str, extension: str) -> tuple[list[str], list[str], list[str]]:
    """Definitions (sorted, macros after the rest, cut), all symbols and imports (cut)."""
    try:
        rows = read(text, extension)
    except Exception:  # whatever goes wrong in a reader, the file's text still counts
        rows = []
    plain = sorted({d for k, d, _ in rows if k == "def"})
    macros = sorted({d for k, d, _ in rows if k == "macro"})
    return (plain + macros)[:MOST_DEFINITIONS], sorted({s for _, _, s in rows if s}), sorted({d for k, d, _ in rows if k == "import"})[:MOST_IMPORTS]


PARSED = "definitions array<string>, symbols array<string>, imports array<string>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    strings = pa.list_(pa.string())
    for b in batches:
        ext = [p.rpartition(".")[2] for p in b.column("path").to_pylist()]
        rows = [record(t or "", e) for t, e in zip(b.column("text").to_pylist(), ext)]
        lists = [pa.array([r[i] for r in rows], strings) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*b.columns, *lists], [*b.schema.names, "definitions", "symbols", "imports"])


def parse(files: DataFrame) -> DataFrame:
    """files (path, size, mtime, text) with loc, entrypoint, definitions, symbols and imports."""
    ends = F.length("text") - F.length(F.translate("text", "\n", ""))
    loc = F.when(F.col("text") == "", 0).otherwise(ends + F.when(F.col("text").endswith("\n"), 0).otherwise(1)).cast("long")
    rows = files.withColumn("loc", loc).withColumn("entrypoint", F.regexp_extract("path", "[^/]*$", 0).isin("main.rs", "lib.rs", "index.ts"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_parsed, f"{schema}, {PARSED}")
