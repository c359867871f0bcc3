"""The command line: python -m loomtext.cli DIRECTORY [options], or `serve` for requests on standard input."""

from __future__ import annotations

import os
import sys
from dataclasses import dataclass, field

from .plans.repository import Repository, Result, Task

USAGE = """usage: python -m loomtext.cli [DIRECTORY] [options]
       python -m loomtext.cli serve

Without a task: an overview of the tree. With one: the files for it.

  -q, --query TEXT           the task in plain words
      --mentioned-path PATH  a path that the task names (may be repeated)
      --mentioned-symbol S   a symbol that it names (may be repeated)
      --open-path PATH       a file that is open (may be repeated)
      --token-budget N       size of the map in tokens
      --max-chars N          size of the output in characters (default 12000)
      --compact              one line for each file
      --overview, --list     the overview, or every file
  -h, --help, --version
"""


class Wrong(Exception):
    """Arguments that make no sense."""


@dataclass
class Arguments:
    directory: str = "."
    max_chars: int = 12_000
    token_budget: int | None = None
    query: str = ""
    flags: set[str] = field(default_factory=set)
    lists: dict[str, list[str]] = field(default_factory=lambda: {"mentioned-path": [], "mentioned-symbol": [], "open-path": []})

    @property
    def is_task(self) -> bool:
        return bool(self.query or any(self.lists.values()))


def _number(name: str, text: str, least: int) -> int:
    if not text.isascii() or not text.isdigit():
        raise Wrong(f"--{name} must be an integer")
    if int(text) < least:
        raise Wrong(f"--{name} must be at least {least}")
    return int(text)


def parse(argv: list[str]) -> Arguments:
    out, rest, places, plain = Arguments(), list(argv), [], False
    while rest:
        arg = rest.pop(0)
        if plain or not arg.startswith("-"):
            places.append(arg)
            continue
        if arg == "--":
            plain = True
            continue
        name, eq, value = {"-q": "--query", "-h": "--help"}.get(arg, arg)[2:].partition("=")
        if not eq and name in ("help", "version", "overview", "list", "compact") and not arg.startswith("---"):
            out.flags.add(name)
            continue
        if name not in ("query", "token-budget", "max-chars", *out.lists) or (arg[0:2] != "--" and arg != "-q"):
            raise Wrong(f"unknown option: {arg}")
        if not eq:
            if not rest:
                raise Wrong(f"--{name} requires a value")
            value = rest.pop(0)
        if name == "query":
            out.query = value
        elif name == "token-budget":
            out.token_budget = _number(name, value, 0)
        elif name == "max-chars":
            out.max_chars = _number(name, value, 1)
        else:
            out.lists[name].append(value)
    if len(places) > 1:
        raise Wrong("only one directory may be supplied")
    if sum((("overview" in out.flags), ("list" in out.flags), out.is_task)) > 1:
        raise Wrong("--overview, --list and a task are separate maps; choose one")
    out.directory = places[0] if places else "."
    return out


def cache_folder(env: dict[str, str]) -> str | None:
    """Where parsed trees are kept between runs; None: nowhere (LOOMTEXT_CACHE=off)."""
    named = env.get("LOOMTEXT_CACHE")
    if named == "off":
        return None
    home = env.get("XDG_CACHE_HOME") or (f"{env['HOME']}/.cache" if env.get("HOME") else "")
    folder = named or (f"{home}/loomtext" if home else None)
    return folder if folder is None or "://" in folder else f"file://{os.path.abspath(folder)}"


def run(spark, args: Arguments) -> Result:
    repository = Repository(spark, args.directory, cache_folder(dict(os.environ)))
    if "list" in args.flags:
        return repository.listing(args.max_chars)
    if not args.is_task:
        return repository.overview(2000 if args.token_budget is None else args.token_budget, args.max_chars)
    budget = -(-args.max_chars // 4) if args.token_budget is None else args.token_budget
    task = Task(args.query, args.lists["mentioned-path"], args.lists["mentioned-symbol"], args.lists["open-path"], budget)
    return repository.task_map(task, args.max_chars, "compact" in args.flags)


def put(result: Result) -> int:
    """Writes a result and gives the exit code. A reader that has gone is no failure."""
    stream = sys.stdout if result.ok else sys.stderr
    try:
        stream.write(result.output if result.output.endswith("\n") else result.output + "\n")
        stream.flush()
    except BrokenPipeError:
        return 0
    return 0 if result.ok else 1


def main(argv: list[str] | None = None) -> int:
    from .session import session, ship

    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["serve"]:
        from .service import serve

        spark = session()
        ship(spark)
        return serve(spark)
    try:
        args = parse(argv)
        if "help" in args.flags or "version" in args.flags:
            print(USAGE if "help" in args.flags else "loomtext", end="\n" if "version" in args.flags else "")
            return 0
        if "://" not in args.directory and not os.path.isdir(args.directory):
            raise Wrong(f"not a directory: {args.directory}")
    except Wrong as e:
        print(f"loomtext: {e}\nTry --help.", file=sys.stderr)
        return 2
    args.directory = args.directory if "://" in args.directory else os.path.realpath(args.directory)
    spark = session()
    ship(spark)
    return put(run(spark, args))


if __name__ == "__main__":
    sys.exit(main())
