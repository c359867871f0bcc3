"""Text functions as Spark columns: tokenizers, identifiers, paths, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cuts between words, before an upper-case letter after a lower-case letter or digit, and inside acronyms.
WORD_CUT = r"[^\p{IsAlphabetic}\p{N}]+|(?<=[\p{IsLowercase}\p{N}])(?=\p{IsUppercase})|(?<=\p{IsUppercase})(?=\p{IsUppercase}\p{IsLowercase})"
IDENTIFIER_CUT = r"[^\p{IsAlphabetic}\p{N}]+|(?<=[\p{IsLowercase}\p{N}])(?=\p{IsUppercase})"
# Symbols that say nothing about a file.
COMMON_SYMBOLS = (
    "actual", "boolean", "call", "changed", "clone", "close", "collect", "config", "context", "data", "default", "error", "expected", "file", "filter", "from", "get", "index", "input", "into",
    "item", "iter", "main", "map", "meta", "name", "new", "none", "number", "open", "option", "output", "path", "read", "result", "run", "set", "some", "state", "status", "string", "test", "tool",
    "unknown", "url", "value", "write",
)
# Directories of tests, change types of commit subjects, words that tell no task apart.
TEST_DIRECTORIES = ("tests", "test", "__tests__", "fixtures", "testdata", "benches", "examples")
CHANGE_TYPES = ("feat", "fix", "chore", "refactor", "perf", "style", "build", "ci", "bench")
STOP_TOKENS = ("src", "lib", "mod", "index", "main", "the", "and", "for", "with", "from", "into")
# Languages by extension.
LANGUAGES = {
    "Rust": ("rs",), "Python": ("py",), "TypeScript": ("ts", "tsx"), "JavaScript": ("js", "jsx", "mjs", "cjs"), "Go": ("go",), "Java": ("java",), "Kotlin": ("kt", "kts"), "Swift": ("swift",), "Ruby": ("rb",),
    "PHP": ("php",), "C#": ("cs",), "C": ("c", "h"), "C++": ("cc", "cpp", "hpp"), "Shell": ("sh",), "HTML": ("html",), "CSS": ("css", "scss"), "Svelte": ("svelte",), "Vue": ("vue",),
}
FAMILIES = {"web": ("TypeScript", "JavaScript", "Svelte", "Vue"), "c": ("C", "C++"), "jvm": ("Java", "Kotlin")}


def terms(text: Column) -> Column:
    """Lower-cased words of two characters or more, with repeats."""
    return F.filter(F.transform(F.split(text, WORD_CUT), F.lower), lambda w: F.length(w) >= 2)


def identifier_tokens(text: Column) -> Column:
    """The set of parts of identifiers; acronyms stay whole."""
    return F.array_distinct(F.filter(F.transform(F.split(text, IDENTIFIER_CUT), F.lower), lambda w: w != ""))


def identifier_runs(text: Column) -> Column:
    """Distinct runs of ASCII letters, digits and _ of 2 to 128 bytes."""
    # Means [^A-Za-z0-9_]+, which takes twenty times as long.
    return F.array_distinct(F.filter(F.split(text, r"\W+"), lambda w: F.length(w).between(2, 128)))


def plural(term: Column) -> Column:
    """The other number of a term: without its s, or with one."""
    strip = (F.length(term) >= 4) & term.endswith("s") & ~term.endswith("ss")
    return F.when(strip, F.substring(term, F.lit(1), F.length(term) - 1)).otherwise(F.concat(term, F.lit("s")))


def lines(text: Column) -> Column:
    """The number of lines; a last line end opens no new line."""
    ends = F.length(text) - F.length(F.translate(text, "\n", ""))
    return F.when(text == "", 0).otherwise(ends + F.when(text.endswith("\n"), 0).otherwise(1)).cast("long")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.ceil(F.length(text) / 4), F.lit(1)).cast("long")


def distinctive(symbol: Column) -> Column:
    """Whether a symbol says something: not a common word, long enough or visibly composed."""
    no_lower = ~symbol.rlike("[a-z]")
    composed = symbol.contains("_") | symbol.rlike("^.+[A-Z]")
    return ~F.lower(symbol).isin(*COMMON_SYMBOLS) & F.when(no_lower, symbol.contains("_") & (F.length(symbol) >= 4)).otherwise((F.length(symbol) >= 6) | composed)


def compact(text: Column, limit: int) -> Column:
    """White space collapsed, cut to so many characters with dots."""
    flat = F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))).otherwise(flat)


def first_sentence(text: Column, limit: int) -> Column:
    """The text up to its first full stop and blank after the twelfth character."""
    flat = F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))
    cut = F.regexp_extract(flat, r"^(.{13,}?\.) ", 1)
    return compact(F.when(cut != "", cut).otherwise(flat), limit)


def plain_markdown(text: Column) -> Column:
    """Link texts without their targets, and no emphasis or code marks."""
    return F.regexp_replace(F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1"), r"\*\*|`|__", "")


def thousands(n: Column) -> Column:
    """Numbers in short: 12k, 1.2k, 12. Built from integers, so ties go to the even digit."""
    q, r = F.floor(n / 100), n % 100
    tenth = q + F.when((r > 50) | ((r == 50) & (q % 2 == 1)), 1).otherwise(0)
    short = F.concat(F.floor(tenth / 10).cast("string"), F.lit("."), (tenth % 10).cast("string"), F.lit("k"))
    return F.when(n >= 10_000, F.concat(F.floor(n / 1000).cast("string"), F.lit("k"))).when(n >= 1000, short).otherwise(n.cast("string"))


def normal_path(path: Column) -> Column:
    """Slashes one way, no empty or . parts, and .. folded; leading ones stay."""
    parts = F.filter(F.split(F.translate(normal_space(path), "\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    up = lambda acc: (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != "..")
    fold = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when((p == "..") & up(acc), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    return F.array_join(fold, "/")


def test_like(path: Column) -> Column:
    """Whether a path is of a test, a fixture or an example; letters of either case."""
    return F.lower(F.concat(F.lit("/"), path)).rlike(f"/({'|'.join(TEST_DIRECTORIES)})/" + r"|/test_[^/]*$|\.(test|spec)\.[^/]*$|_test\.go$|_tests\.rs$")


def fixture_like(path: Column) -> Column:
    """The narrower rule of the structural ranking; letters as they are."""
    return path.rlike("^tests/|/(tests|test|fixtures|examples)/")


def clean_query(subject: Column) -> Column:
    """A commit subject without its request number and change type; the scope stays as words."""
    bare = F.regexp_replace(subject, r"\s*\(#[0-9]+\)\s*$", "")
    head = rf"^(?:{'|'.join(CHANGE_TYPES)})(?:\(([^)]*)\))?!?:\s*"
    scope, rest = F.regexp_extract(bare, head, 1), normal_space(F.regexp_replace(bare, head, ""))
    return F.when(bare.rlike(head) & (scope != ""), F.concat(scope, F.lit(": "), rest)).otherwise(rest)


def normal_space(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normal_identifier(name: Column) -> Column:
    return F.lower(normal_space(name))


def task_words(text: Column) -> Column:
    """Distinct lower-case words of three letters or digits and more, names split, without words that tell nothing."""
    parts = F.filter(F.regexp_extract_all(text, F.lit(r"([A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+)")), lambda w: F.length(w) >= 3)
    return F.array_except(F.array_distinct(F.transform(parts, F.lower)), F.array(*map(F.lit, STOP_TOKENS)))


def folded_words(text: Column) -> Column:
    """Lower-case words of two letters or digits and more, names split, without a plural's s if they are long; with repeats."""
    words = F.filter(F.regexp_extract_all(text, F.lit(r"([A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+)")), lambda w: F.length(w) > 1)
    low = F.transform(words, F.lower)
    return F.transform(low, lambda w: F.when((F.length(w) > 4) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))


def baseline_words(text: Column) -> Column:
    """Lower-cased ASCII words of two letters or digits and more, names split, with repeats."""
    return F.transform(F.filter(F.regexp_extract_all(text, F.lit(r"([A-Za-z][a-z]+|[A-Z]+(?![a-z])|[0-9]+)")), lambda w: F.length(w) > 1), F.lower)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def _named(groups: dict[str, tuple[str, ...]], x: Column, other: Column) -> Column:
    out = other
    for name, members in groups.items():
        out = F.when(x.isin(*members), name).otherwise(out)
    return out


def language(path: Column) -> Column:
    return _named(LANGUAGES, F.lower(extension(path)), F.lit("other"))


def language_family(path: Column) -> Column:
    """Languages whose files can name each other's types."""
    return _named(FAMILIES, language(path), language(path))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def query_words(query: Column) -> Column:
    """Identifier tokens of a query and, if it is one word, the word itself."""
    whole = normal_identifier(query)
    return F.array_distinct(F.concat(identifier_tokens(query), F.when((whole != "") & ~whole.rlike(r"(?U)\s"), F.array(whole)).otherwise(F.array().cast("array<string>"))))


def shortlist_words(text: Column) -> Column:
    """ASCII words of two characters or more, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) > 1))
