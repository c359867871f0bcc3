"""Orders and values that the ranking must give, whatever the plan."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import evaluate as E
from loomtext.operators import graph as G
from loomtext.operators import overview as O
from loomtext.operators import ranking as R

FILES = "doc_id long, path string, text string, symbols array<string>, loc long, tokens long, entrypoint boolean, changed boolean"


def files(spark, rows):
    plain = {"text": "", "symbols": [], "loc": 10, "tokens": 8, "entrypoint": False, "changed": False}
    return spark.createDataFrame([tuple(({"doc_id": i} | plain | r)[c.split()[0]] for c in FILES.split(", ")) for i, r in enumerate(rows)], FILES)


def context(spark, query="", paths=(), symbols=(), open_=()):
    return spark.createDataFrame([(1, query, list(paths), list(symbols), list(open_))], "query_id long, query string, mentioned_paths array<string>, mentioned_symbols array<string>, open_paths array<string>")


def ranked(f, c, callers=None):
    callers = f.sparkSession.createDataFrame([], "symbol string, caller long") if callers is None else callers
    s = R.with_prior(R.bm25(f, c.select("query_id", "query")), f)
    every = f.select(F.lit(1).cast("long").alias("query_id"), "doc_id", F.when(F.col("changed"), 2.0).otherwise(0.0).alias("prior"))
    rows = every.join(s, ["query_id", "doc_id"], "left").join(R.tiers(f, c, callers), ["query_id", "doc_id"], "left")
    rows = rows.select("query_id", "doc_id", F.coalesce("score", "prior").alias("score"), F.coalesce("tier", F.lit(0)).alias("tier")).join(f.select("doc_id", "path", "loc", "tokens", "entrypoint"), "doc_id")
    return R.total_order(rows)


def order(rows):
    return [r["doc_id"] for r in rows.orderBy("rank").collect()]


@pytest.mark.parametrize("text, want", [
    ("HTTPServer snake_case Signatures", {"case": 1, "http": 1, "server": 1, "signatures": 1, "snake": 1}),
    ("parseHTTPResponse XMLHttpRequest über_Größe a1B2 x", {"a1": 1, "b2": 1, "größe": 1, "http": 2, "parse": 1, "request": 1, "response": 1, "xml": 1, "über": 1}),
])
def test_tokenizer(spark, text, want):
    assert Counter(spark.range(1).select(T.terms(F.lit(text)).alias("t")).first()["t"]) == want


def test_tiers_come_in_their_order(spark):
    f = files(spark, [{"path": "named.rs"}, {"path": "def.rs", "symbols": ["verify_signature"]}, {"path": "caller.rs"}, {"path": "open.rs"}, {"path": "body.rs", "text": "signatures " * 9}])
    callers = spark.createDataFrame([("verify_signature", 2)], "symbol string, caller long")
    assert order(ranked(f, context(spark, "signatures", ["named.rs"], ["verify_signature"], ["open.rs"]), callers)) == [0, 1, 2, 3, 4]


def test_what_is_too_large_is_skipped(spark):
    f = files(spark, [{"path": "named.rs", "tokens": 100}, {"path": "a.rs"}, {"path": "b.rs"}, {"path": "open.rs"}, {"path": "hit.rs", "text": "signatures"}])
    r = ranked(f, context(spark, "signatures", ["named.rs"], [], ["open.rs"]))
    packed = lambda budget, **more: [x["doc_id"] for x in R.pack_skip(r, "query_id", budget, **more).orderBy("pos").collect()]
    assert packed(16) == [3, 4] == packed(16, chunk=1)
    assert packed(0) == packed(7) == packed(16, stop=True) == []


def test_packing_in_chunks_is_the_same(spark):
    import random

    rng = random.Random(4)
    rows = [(q, k + 1, rng.randrange(1, 60), 100 * q + k) for q in range(5) for k in range(90)]
    df = spark.createDataFrame(rows, "query_id long, rank long, tokens long, doc_id long")
    for stop in (False, True):
        want = []
        for q in range(5):
            left, pos = 150, 0
            for _, _, t, d in (r for r in rows if r[0] == q):
                if t <= left:
                    want.append((q, pos, d))
                    left, pos = left - t, pos + 1
                elif stop:
                    break
        for chunk in (3, 1000):
            assert sorted(map(tuple, R.pack_skip(df, "query_id", 150, stop, chunk).collect())) == want


def test_changed_files_win_over_one_word_but_not_over_a_path(spark):
    f = files(spark, [{"path": "a.rs", "text": "nebula noise words"}, {"path": "b.rs", "text": "noise", "changed": True}, {"path": "nebula/star/cloud.rs"}])
    assert order(ranked(f, context(spark, "nebula"))).index(1) < order(ranked(f, context(spark, "nebula"))).index(0)
    assert order(ranked(f, context(spark, "nebula star cloud")))[0] == 2


def test_ties_end_with_the_path(spark):
    assert order(ranked(files(spark, [{"path": "z.rs"}, {"path": "a.rs"}]), context(spark, "nothing"))) == [1, 0]


def test_named_references_survive_the_limit(spark):
    names = [f"symbol_number_{k:03}" for k in range(71)]
    f = files(spark, [{"path": "caller.rs", "text": " ".join(names)}, *({"path": f"d{k}.rs", "symbols": [n]} for k, n in enumerate(names))])
    symbols = f.select("doc_id", F.explode("symbols").alias("symbol"))
    named = spark.createDataFrame([(names[-1],)], "symbol string")
    got = {r["symbol"] for r in G.references(f, G.definers(symbols), 64, named).where("doc_id = 0").collect()}
    assert len(got) == 64 and names[-1] in got and names[-2] not in got


def test_shortlist_keeps_what_is_named_in_other_case(spark):
    f = spark.range(3002).select(F.col("id").alias("doc_id"), F.concat(F.lit("src/f"), F.col("id").cast("string"), F.when(F.col("id") == 3001, "/Target.rs").otherwise(".rs")).alias("path"), F.lit(False).alias("changed"))
    got = R.shortlist(f, context(spark, "x", ["target.RS"])).cache()
    assert got.count() == 3000 and got.where("place = 1").first()["doc_id"] == 3001


def test_layout_splits_what_dominates():
    sizes = [(f"area{k:02}", 1, 10) for k in range(20)] + [(f"devices/{c}", 1001, 5005) for c in ("bus", "gpu", "net")]
    rows = {d: n for d, n, _ in O.split_directories(sizes)}
    assert {f"devices/{c}": 1001 for c in ("bus", "gpu", "net")}.items() <= rows.items() and sum(k.startswith("area") for k in rows) == 20


def test_file_index_lines(spark):
    f = files(spark, [{"path": f"src/{n}.rs", "loc": k} for k, n in enumerate("abcde")] + [{"path": "x.py"}, {"path": "y.ts"}])
    assert {r["line"] for r in O.directories(f, 2).collect()} == {"src/ (5, .rs): e d +3", ". (2): x.py y.ts"}


def test_words_of_tasks_and_subjects(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert sorted(one(T.task_words(F.lit("fix HTTPServer snake_case in src/mod ab MAX2go")))) == ["case", "fix", "http", "max", "server", "snake"]
    for subject, want in (("fix(app): x y (#12)", "app: x y"), ("docs: keep this", "docs: keep this"), ("feat!: go", "go"), ("hpack: a b", "hpack: a b"), ("bench(x)!:  z ", "x: z")):
        assert one(T.clean_query(F.lit(subject))) == want
    assert one(T.normal_path(F.lit(" ./a\\b/../c//d/. "))) == "a/c/d" and one(T.normal_path(F.lit("../../x/.."))) == "../.."


def test_audit_refuses_gaps_and_repeats(spark):
    cases = spark.createDataFrame([("a",), ("b",)], "id string")
    label = lambda *rows: spark.createDataFrame(list(rows), "id string, label string")
    assert [r["id"] for r in E.audited(cases, label(("a", "fair"), ("b", "mismatch")), "fair").collect()] == ["a"]
    for bad in ([("a", "fair")], [("a", "fair"), ("a", "fair"), ("b", "fair")], [("a", "fair"), ("b", "fair"), ("c", "fair")]):
        with pytest.raises(ValueError, match="exactly once"):
            E.audited(cases, label(*bad), "fair")


def test_cases_of_one_file_are_capped(spark):
    rows = [(f"c{k}", "r", ["hot"] if k < 9 else ["cold", "hot"], f"{k:03}") for k in range(12)]
    df = spark.createDataFrame(rows, "id string, repo string, gold array<string>, digest string").repartition(3)
    assert sorted(r["id"] for r in E.capped_cases(df).collect()) == [f"c{k}" for k in range(6)]


def test_intervals_equal_a_plain_loop(spark):
    import random

    x = [0.1 * k for k in range(12)]
    rng = random.Random(7)
    means = sorted(sum(rng.choice(x) for _ in x) / len(x) for _ in range(2000))
    got = E.bootstrap(spark.createDataFrame(list(enumerate(x)), "query_id long, v double").repartition(4), "v").first()
    assert (got["low"], got["high"]) == (means[50], means[1950])


def test_percentiles_are_elements(spark):
    df = spark.createDataFrame([(float(v),) for v in (5, 1, 4, 1, 3, 9, 2, 6)], "v double")
    assert [E.nearest_rank(df, "v", s).first()["value_at"] for s in (0.0, 0.5, 0.95, 1.0)] == [1.0, 4.0, 9.0, 9.0]
    assert E.nearest_rank(df.limit(0), "v", 0.5).count() == 0


def test_paths_of_outputs(spark):
    out = "src/a.rs | 3 LOC\n  defs: fn x\n./src/b.rs | 4 LOC | fn y\n/top/src/a.rs | 3 LOC\nno map line\nlib/../c d.py | 1 LOC\n"
    df = spark.createDataFrame([(1, out, "/top")], "query_id long, output string, root string")
    assert [r["path"] for r in E.ranked_paths(df).orderBy("rank").collect()] == ["src/a.rs", "src/b.rs", "c d.py"]
    assert [r["path"] for r in E.ranked_paths(df.withColumn("output", F.lit(" x/y.rs \n\nz.py\nx/./y.rs")), maps=False, depth=2).orderBy("rank").collect()] == ["x/y.rs", "z.py"]


def test_sets_of_definitions(spark):
    rows = lambda *x: spark.createDataFrame([("a.c", *r) for r in x], "path string, kind string, name string")
    got = {r["kind"]: tuple(r)[1:] for r in E.name_sets(rows(("fn", "x"), ("fn", "y"), ("fn", "y")), rows(("fn", "x"), ("fn", "z"), ("struct", "s"))).collect()}
    assert got == {"fn": (1, 1, 1, 0.5, 0.5), "struct": (0, 0, 1, None, 0.0)}
