"""Trees of files, ignore rules, the feature table and the definition readers."""

from __future__ import annotations

import re

import pytest

from loomtext.sources import readers, tree

SOURCES = {
    "rs": ('pub(crate) async fn run() {}\nconst _: () = ();\npub const LIMIT: usize = 3;\nstatic mut HITS: u8 = 0;\npub unsafe extern "C" fn hook() {}\npub const fn made() {}\npub union Bits {}\nimpl<T> Display for Thing<T> where T: Copy {\nmacro_rules! shout {\nuse crate::a::b;\nuse std::io;\n',
        ["const LIMIT", "fn hook", "fn made", "fn run", "macro shout", "static HITS", "union Bits"], ["HITS", "LIMIT", "Bits", "hook", "made", "run", "shout"], ["a::b"]),
    "py": ("import os.path\nfrom .x import y\nclass A:\n    async def go(self): pass\n", ["class A", "def go"], ["A", "go"], ["/x", "os/path"]),
    "kt": ("public class Box\ninternal fun open() {}\nstatic fun no() {}\n", ["class Box", "fun open"], ["Box", "open"], []),
    "rb": ("module M\n  class C\n    def ok?\n", ["class C", "def ok", "module M"], ["C", "M", "ok"], []),
    "php": ("<?php\npublic function f() {}\ntrait T {}\n", ["function f", "trait T"], ["T", "f"], []),
    "go": ("/* func No() */\nfunc Run() {}\nfunc (s *Server) Stop() {}\nfunc (c Cache[K]) Get(k K) int { return 0 }\nfunc Each[T any](x []T) {}\nconst (\n\tA Kind = 1 // one, two\n\t_\n\tB\n)\ntype (\n\tBox struct {\n\t\tinner int\n\t}\n)\nvar p, q = 1, 2\nconst One = 1\nvar table = map[string]int{\"a\": 1, \"b\": 2}\n",
        ["const A", "const B", "const One", "func Cache.Get", "func Each", "func Run", "func Server.Stop", "type Box", "var p", "var q", "var table"], ["A", "B", "Box", "Each", "Get", "One", "Run", "Stop", "p", "q", "table"], []),
    "ts": ('import x from "./x";\nimport y from "lib";\n/*\n function no() {}\n*/\nexport default class Pool<T> extends Base {\n  private open: T[] = [];\n  taken = () => {};\n  @Dec() id: string;\n  constructor() {}\n  async take(n: number) {\n    if (n) {\n    }\n  }\n  static get size(): number { return 0; }\n  #drop() {}\n  map<U>(f: U) {}\n  abstract keep(): void;\n}\nexport const size = 3;\nexport const enum Mode { A }\ndeclare const V: string;\nvar old = require(\'./old\');\nconst { a, b } = x;\ninterface Row { area(): number }\n',
        ["class Pool", "const V", "const size", "enum Mode", "interface Row", "method Pool.drop", "method Pool.keep", "method Pool.map", "method Pool.size", "method Pool.take", "var old"],
        ["Mode", "Pool", "Row", "V", "drop", "keep", "map", "old", "size", "take"], ["./old", "./x"]),
    "vue": ('<template>function no() {}</template>\n<script setup>\n\timport R from "./R.vue";\n\tlet { x } = y();\n\tfunction yes() {\n\t\tconst inner = 1;\n\t}\n</script>\n<p>\nfunction no() {}\n</p>\n<script>\n  export const two = 2;\n</script>\n', ["const two", "function yes"], ["two", "yes"], ["./R.vue"]),
    "c": ('#ifndef G_H\n#define G_H\n#include "a.h"\n#include <b.h>\n#define MAX(a, b) \\\n  ((a) > (b))\n#define N 3\nstruct point {\n  int x;\n};\nstruct point *find(int id);\ntypedef unsigned long number;\ntypedef int (*handler)(int);\ntypedef int (CALL *hook)(void);\ntypedef struct {\n  int x;\n} pair_t;\nenum color { RED, BLUE };\nstatic int add(int a,\n  int b)\n{\n  if (a) { return b; }\n}\nstatic void *keep(struct point *p) { return p; }\nstatic int __attribute__((unused)) quiet(int x) {\n}\nvoid locked(int *l)\n__releases(l)\n__acquires(l)\n{\n}\nstatic int\nold_style(void)\n{\n}\nDEFINE_CALL3(openit, int, fd)\n{\n  return 0;\n}\nstatic struct driver d = {\n  .run = add,\n};\nregister_driver(d);\nint count; /* not_this(void) {\nnor_this(void) {\n*/\n// nor this(void) {\nstatic const char *g = "/x/*";\nint last(void) {\n}\n#endif\n',
        ["enum color", "fn add", "fn keep", "fn last", "fn locked", "fn old_style", "fn openit", "fn quiet", "struct point", "typedef handler", "typedef hook", "typedef number", "typedef pair_t", "define MAX", "define N"],
        ["MAX", "add", "color", "handler", "hook", "keep", "last", "locked", "number", "old_style", "openit", "pair_t", "point", "quiet"], ["./a.h"]),
    "cpp": ("namespace lib {\nclass LIB_API Graph : public Base {\npublic:\n  void inner() {}\n};\ntemplate <typename T>\nstruct Info<T *> {\n};\nclass Later;\nenum class Kind : int {\n  A,\n};\nGraph::Graph(const M &m)\n    : m(m) {\n}\nGraph::~Graph() {\n}\nbool Graph::known(V v) const {\n}\nName Pass::name()\n    const {\n}\nstruct Outer::Impl {\n};\nstruct Last final : public U {\n};\nTEST(Suite, Case) {\n}\n}\n",
        ["class Graph", "enum Kind", "fn Graph::Graph", "fn Graph::known", "fn Graph::~Graph", "fn Pass::name", "fn Suite", "struct Impl", "struct Info", "struct Last"], ["Graph", "Impl", "Info", "Kind", "Last", "Suite", "known", "name"], []),
    "css": ("a { b: c }", [], [], []),
}
@pytest.mark.parametrize("extension", sorted(SOURCES))
def test_reader(extension):
    text, definitions, symbols, imports = SOURCES[extension]
    assert readers.record(text, extension) == (definitions, sorted(symbols), imports)


def test_headers_of_rust_implementations():
    assert readers.record("impl Display for Thing where T: Copy {\nunsafe impl Send for X {}\n", "rs")[0] == ["impl Display for Thing", "impl Send for X"]


@pytest.mark.parametrize("extension", sorted(SOURCES))
def test_readers_survive_anything_anywhere(extension):
    text = SOURCES[extension][0]
    for at in range(0, len(text), 3):
        for put in ("µ", "(", "{", "\""):
            readers.read(text[:at] + put + text[at:], extension)
        readers.read(text[:at], extension)


@pytest.mark.parametrize("pattern, yes, no", [
    ("*.log", ["a.log", "x/y.log"], ["a.logs"]), ("/build", ["build", "build/a.c"], ["x/build"]), ("out/", ["out/a", "x/out/b"], ["out"]),
    ("a/**/b", ["a/b", "a/x/y/b"], ["b"]), ("doc/*.txt", ["doc/a.txt"], ["doc/x/a.txt"]), ("f?o[0-9]", ["foo1"], ["foox", "fo1"]),
])
def test_ignore_patterns(pattern, yes, no):
    regex, back = tree.ignore_regex(pattern)
    assert not back
    assert all(re.search(regex, p) for p in yes) and not any(re.search(regex, p) for p in no)
    assert tree.ignore_regex("# note") is None and tree.ignore_regex("!keep.log")[1]


def test_tree_and_features(spark, tmp_path):
    root = tmp_path / "tree"
    for name, text in {
        "src/main.rs": "fn main() {}\n", "src/a.py": "def a(): pass", "src/.hidden.py": "x", "node_modules/m.js": "x", "env/pyvenv.cfg": "", "env/lib/e.py": "x", "log/x.py": "x", "log/keep.py": "def keep(): pass\n", ".gitignore": "log/*\n!log/keep.py\n", ".git/info/exclude": "secret.py\n", "src/secret.py": "x", ".loomignore": "gen/\n", "gen/g.py": "x", "README.md": "# T", "big.py": "#" * 5000,
    }.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (root / "src/bad.py").write_bytes(b"\xff\xfe")
    listed = tree.files(spark, str(root), largest=4000)
    assert {r["path"] for r in listed.collect()} == {"src/main.rs", "src/a.py", "log/keep.py"}
    features = tree.Features(spark, str(tmp_path / "features"), "v1")
    assert features.read() is None
    first = {r["path"]: r for r in features.refresh(listed, readers.parse).collect()}
    assert first["src/main.rs"]["entrypoint"] and first["src/main.rs"]["definitions"] == ["fn main"] and first["src/a.py"]["loc"] == 1
    (root / "src/a.py").write_text("def a(): pass\ndef b(): pass\n")
    (root / "log/keep.py").unlink()
    seen = []

    def parse(new):
        seen.extend(r["path"] for r in new.select("path").collect())
        return readers.parse(new)

    second = {r["path"]: r for r in features.refresh(tree.files(spark, str(root), largest=4000), parse).collect()}
    assert seen == ["src/a.py"]
    assert set(second) == {"src/main.rs", "src/a.py"} and second["src/a.py"]["symbols"] == ["a", "b"]
    for _ in range(3):
        features.refresh(tree.files(spark, str(root), largest=4000), readers.parse)
    assert len(features._generations()) == 2
    assert tree.Features(spark, str(tmp_path / "features"), "v2").read() is None
