"""Maps of small trees, the command line, requests, git, and what trees say about themselves."""

from __future__ import annotations

import json
import subprocess

import pytest

from loomtext import cli
from loomtext.plans import repository as M
from loomtext.service import Service
from loomtext.sources import documents as D
from loomtext.sources import history

FILES = {
    "README.md": "# Boat\n\n[![badge](x)](y)\n\nA **tool** that [floats](http://x) well. It also sinks.\n\n## More\n",
    "Cargo.toml": '[package]\nname = "boat"\ndescription = "Floats things"\n',
    "Makefile": "clean:\n\trm x\nbuild: src\n_secret:\n.PHONY: all\nzeta:\n",
    "src/main.rs": "use crate::engine::Engine;\nfn main() {\n    Engine::launch_engine();\n}\n",
    "src/engine.rs": "//! Drives the boat along.\npub struct Engine;\nimpl Engine {\n    pub fn launch_engine() { sink_anchor(); }\n}\n",
    "src/anchor.rs": "pub fn sink_anchor() {}\npub fn lift_anchor() {}\n",
    "src/sail.rs": "use crate::engine;\nfn hoist_sail(e: Engine) { lift_anchor(); }\n",
    "web/package.json": '{"description": "The web side", "scripts": {"build": "x", "zap": "y", "test": "z"}}',
    "web/index.ts": 'import { draw } from "./draw";\nexport function boot() {}\n',
    "web/draw.ts": "export function draw() {}\n",
    "tests/test_io.py": '"""Checks input."""\ndef test_it(): pass\n',
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("boat")
    for name, text in FILES.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(text)
    run = lambda *a: subprocess.run(["git", "-C", str(top), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "feat: start the whole boat project")
    (top / "src/anchor.rs").write_text(FILES["src/anchor.rs"] + "// changed\n")
    run("commit", "-qam", "fix(anchor): make the anchor sink faster (#12)")
    (top / "src/sail.rs").write_text(FILES["src/sail.rs"] + "// dirty\n")
    (top / "src/new.rs").write_text("pub fn brand_new_thing() {}\n")
    return str(top)


@pytest.fixture(scope="module")
def boat(spark, root):
    return M.Repository(spark, root)


def test_changed_files_are_dirty_or_untracked(boat):
    assert {r["path"] for r in boat.rows().where("changed").collect()} == {"src/sail.rs", "src/new.rs"}


def test_overview(boat):
    text = boat.overview(2000).output
    for part in ("8 source files", "Boat: A tool that floats well.", "## Stack\nRust ", ". (Rust crate): `cargo build`", "(Makefile): `make build` · `make clean` · `make zeta`", "web/ (package.json, npm): `npm run build` · `npm run test`", "## Entry points\nsrc/main.rs", "web/index.ts", "web/ | 2 |", "The web side", "## Files"):
        assert part in text, (part, text)
    assert "src/engine.rs" in text and "_secret" not in text
    assert M.tokens(boat.overview(150).output) <= 150


def test_a_named_symbol_and_its_only_caller_come_first(boat):
    text = boat.task_map(M.Task("sail", mentioned_symbols=["sink_anchor"], budget=500)).output
    order = [line.split(" | ")[0] for line in text.splitlines() if line[:1].strip()]
    assert order[:2] == ["src/anchor.rs", "src/engine.rs"]
    first = boat.task_map(M.Task("hoist", mentioned_paths=["./web/draw.ts"], open_paths=["src/main.rs"], budget=500), compact=True).output.splitlines()
    assert first[0].startswith("web/draw.ts | 1 LOC") and first[1].startswith("src/main.rs")


def test_budgets_are_kept(boat):
    for budget in (0, 5, 40):
        text = boat.task_map(M.Task("engine anchor sail", budget=budget)).output
        assert text == M.NOTHING_FITS or M.tokens(text) <= budget
    assert boat.task_map(M.Task("engine", budget=0)).output == M.NOTHING_FITS
    note = boat.task_map(M.Task("engine", budget=900), most_files=3).output
    assert "indexed 3 of 8 source files" in note


def test_listing_starts_with_entry_points(boat):
    lines = [x for x in boat.listing().output.splitlines() if x[:1].strip()]
    assert [x.split(" | ")[0] for x in lines[:2]] in (["src/main.rs", "web/index.ts"], ["web/index.ts", "src/main.rs"])
    assert any(x.strip().startswith("refs: ") for x in boat.listing().output.splitlines())


def test_an_empty_tree(spark, tmp_path):
    got = M.Repository(spark, str(tmp_path)).overview()
    assert not got.ok and got.output == M.NO_FILES


@pytest.mark.parametrize("most", [*range(1, 140, 7), 999, 1000, 1001, 99_998, 99_999, 100_000, 150_000])
def test_bounded_output_says_what_is_left_out(most):
    text = "".join(chr(97 + i % 26) for i in range(100_050))
    got = M.bounded(text, most)
    assert len(got.output) <= most and got.truncated == (most < len(text))
    if got.truncated and "omitted" in got.output:
        head, tail = got.output.split("\n\n... [")[0], got.output.split("] ...\n\n")[1]
        assert text.startswith(head) and text.endswith(tail)
        assert f"[{len(text) - len(head) - len(tail)} chars omitted" in got.output


def test_arguments():
    a = cli.parse(["--query=find it", "--mentioned-path", "a.rs", "--open-path=b", "--token-budget", "0", "-q", "again", "--", "-dir"])
    assert (a.query, a.lists["mentioned-path"], a.lists["open-path"], a.token_budget, a.directory, a.is_task) == ("again", ["a.rs"], ["b"], 0, "-dir", True)
    assert not cli.parse(["--token-budget", "5"]).is_task
    for bad, says in ((["--max-chars", "0"], "at least 1"), (["--max-chars", "x"], "integer"), (["--query"], "requires a value"), (["--nope"], "unknown option"), (["a", "b"], "only one"), (["--list", "-q", "x"], "choose one")):
        with pytest.raises(cli.Wrong, match=says):
            cli.parse(bad)
    assert cli.main(["--help"]) == 0 and cli.main(["--bad"]) == 2 and cli.main(["/no/such/folder"]) == 2


def test_where_parsed_trees_are_kept():
    f = cli.cache_folder
    assert f({"LOOMTEXT_CACHE": "off", "HOME": "/h"}) is None and f({}) is None
    assert [f(e) for e in ({"LOOMTEXT_CACHE": "/c"}, {"XDG_CACHE_HOME": "/x", "HOME": "/h"}, {"HOME": "/h"}, {"LOOMTEXT_CACHE": "s3://b/c"})] == ["file:///c", "file:///x/loomtext", "file:///h/.cache/loomtext", "s3://b/c"]


def test_requests(spark, root):
    s = Service(spark)
    ask = lambda method, **params: s.handle({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})
    assert ask("initialize", protocolVersion="2024-11-05")["result"]["protocolVersion"] == "2024-11-05"
    assert ask("initialize", protocolVersion="1")["result"]["protocolVersion"] == "2025-11-25"
    assert ask("ping") == {"jsonrpc": "2.0", "id": 1, "result": {}}
    assert len(ask("tools/list")["result"]["tools"]) == 2
    assert ask("nope")["error"]["code"] == -32601 and s.handle({"method": "notifications/initialized"}) is None and s.handle({"method": "nope"}) is None
    assert ask("ping", _meta={"io.modelcontextprotocol/protocolVersion": "1999"})["error"]["code"] == -32022
    assert ask("ping", _meta={"io.modelcontextprotocol/protocolVersion": "2026-07-28"})["result"] == {"resultType": "complete"}
    call = lambda name, **args: ask("tools/call", name=name, arguments=args)
    assert call("tree_query")["error"]["code"] == -32602
    assert "array of strings" in call("tree_query", query="x", open_paths="y")["error"]["message"]
    assert call("tree_overview", dir="/no/such")["result"]["isError"]
    assert "src/anchor.rs" in call("tree_query", dir=root, query="sink the anchor", detail="compact")["result"]["content"][0]["text"]
    assert json.loads(s.line("{"))["error"]["code"] == -32700 and s.line(" ") is None
    assert len(json.loads(s.line('[{"id": 1, "method": "ping"}, {"method": "ping"}]'))) == 1


def test_commits_become_cases(spark, root):
    got = history.cases(history.commits(spark, root), "boat").collect()
    assert [(r["query"], r["gold"], r["kind"], r["tests_only"]) for r in got] == [("anchor: make the anchor sink faster", ["src/anchor.rs"], "lexical", False)]
    bare = history.bare_cases(history.cases(history.commits(spark, root), "boat")).collect()
    assert bare[0]["query"] == "make the anchor sink faster" and bare[0]["with_prefix"].startswith("anchor: ")


@pytest.mark.parametrize("text, extension, said", [
    ("#!/usr/bin/env python\n# x\n\n'''Reads the files.\n\nMore.'''\n", "py", "Reads the files."), ("// Copyright 2020\n// Package main does it. Really.\n\npackage main", "go", "Package main does it."),
    ("/**\n * Draws a [thing](x) here\n */\ncode", "ts", "Draws a thing here"), ("fn x() {}", "rs", None), ("//! short", "rs", None), ("import x", "py", None),
])
def test_module_comments(text, extension, said):
    assert D.module_doc(text, extension) == said


def test_areas():
    a = D.Areas("List\n\nTHE REST\nM:\tx\nF:\t*\nF:\t*/\n\nEXT4 FILES\nF:\tfs/ext4/\nF:\tfs/jbd2/*\n\nNETWORKING\nF:\tnet/\nF:\tnet/file.c\n\nINTEL\nF:\tdrivers/net/intel/\n")
    assert a.covering("fs/ext4/deep") == "EXT4 FILES" and a.covering("fs") is None and a.covering("net") == "NETWORKING"
    assert a.inside("fs", {"fs/ext4": 3, "fs/jbd2/x": 1, "fs/other": 9}) == ["EXT4 FILES"]
    assert D.Areas("INTEL\nF:\tdrivers/net/intel/\n", "drivers/net").inside("", {"intel/ice": 2}) == ["INTEL"]


def test_readme_and_sentences():
    assert D.readme("# *T*\n```\ncode\n```\n<p>\ntext one\ntext two\n\nmore") == ("*T*", "text one text two")
    assert D.readme("\n\n") is None and D.readme("# Only") == ("Only", "")
    assert D.plain("a [b](c) **d** [e f") == "a b d [e f"
    assert D.sentence("Short. A text with more. Rest", 80) == "Short. A text with more." and D.sentence("x" * 50, 10) == "xxxxxxx..."
    assert [M.thousands(n) for n in (999, 1250, 1949, 10_000, 12_999)] == ["999", "1.2k", "1.9k", "10k", "12k"]


def test_postings_follow_a_folder(spark, tmp_path):
    from loomtext.streaming import follow as S

    folder, table, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for rows in ([(1, "a boat and a boat")], [(2, None), (3, "sailBoat")]):
        spark.createDataFrame(rows, "doc_id long, text string").write.mode("append").parquet(folder)
        S.follow(spark, folder, table, mark).awaitTermination(60)
    assert sorted(map(tuple, S.read(spark, table).collect())) == [(1, "and", 1), (1, "boat", 2), (3, "boat", 1), (3, "sail", 1)]
