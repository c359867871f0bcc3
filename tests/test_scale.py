"""Operators at sizes and on rows that a plan over all pairs does not bear."""

from __future__ import annotations

import math
import random

from loomtext.operators import evaluate as E


def test_best_chunks_match_brute_force_in_small_blocks(spark, monkeypatch):
    """Equal vectors, a file in several blocks, repeated ids, vectors of zeros, null ones, and of another length."""
    monkeypatch.setattr(E, "VECTORS", 7)
    monkeypatch.setattr(E, "QUERIES", 3)
    monkeypatch.setattr(E, "HELD", 1)
    rng = random.Random(5)
    points = [[float(rng.randrange(-2, 3)) for _ in range(3)] for _ in range(12)]
    vectors = [(rng.randrange(15), rng.choice(points)) for _ in range(90)] + [(15, [0.0, 0.0, 0.0]), (16, None), (17, [1.0, 2.0]), (18, [1.0, None, 2.0])]
    queries = [(i % 8, rng.choice([p for p in points if any(p)])) for i in range(10)] + [(20, [2.0, 1.0]), (21, None)]

    def cosine(a, b):
        if a is None or b is None or None in a or len(a) != len(b):
            return None
        norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / norm if norm else math.nan

    order = lambda s: (0, 0.0) if s != s else (1, -s)
    want = {}
    for q in {q for q, _ in queries}:
        best = {}
        for f, v in vectors:
            for s in (cosine(v, e) for i, e in queries if i == q):
                old = best.get(f)
                best[f] = s if old is None or (s is not None and order(s) < order(old)) else old
        best = {f: s if s is None or s != s else round(s, 6) + 0.0 for f, s in best.items()}
        top = sorted(best, key=lambda f: ((2, 0.0) if best[f] is None else order(best[f]), f))[:6]
        want |= {(q, k + 1): (f, "NaN" if best[f] != best[f] else best[f]) for k, f in enumerate(top)}
    got = E.best_chunks(spark.createDataFrame(vectors, "file long, embedding array<float>"), spark.createDataFrame(queries, "query_id long, embedding array<float>"), 6).collect()
    assert {(r["query_id"], r["place"]): (r["file"], "NaN" if r["score"] != r["score"] else r["score"]) for r in got} == want


def corpus_of(spark, n=40):
    from loomtext import corpus

    rng = random.Random(9)
    words = ["alpha", "alphas", "beta", "gammaDelta", "epsilon_x", "zeta", "the", "of"]
    text = lambda i: "\n".join(f"{rng.choice(words)} {rng.choice(words)} own{i // 2}_{j} use{rng.randrange(n)}_0 own{rng.randrange(n // 2)}_0" for j in range(rng.randrange(3)))
    rows = [(i, f"src/{'alpha' if i % 7 == 0 else 'x'}/d{i}.rs", text(i), rng.randrange(5), i % 5 == 0, rng.randrange(1, 50)) for i in range(n)]
    files = corpus.with_symbols(spark.createDataFrame(rows, "doc_id long, path string, text string, loc long, entrypoint boolean, tokens long"))
    asked = [(q, " ".join(rng.sample(words, 3)), [f"src/x/d{q}.rs"], ["own3_0", "ALPHA", f"own{q}_0"], [f"src/x/d{q + 1}.rs"]) for q in range(6)] + [(9, "", [], ["beta"], [])]
    contexts = spark.createDataFrame(asked, "query_id long, query string, mentioned_paths array<string>, mentioned_symbols array<string>, open_paths array<string>")
    return files.localCheckpoint(), contexts


def test_scores_need_no_exchange_and_match_the_joined_form(spark, monkeypatch):
    from loomtext.operators import postings as P
    from loomtext.operators import ranking as R

    monkeypatch.setattr(R, "CELLS", 20)
    files, contexts = corpus_of(spark)
    queries = contexts.select("query_id", "query")
    for fields in (False, True):
        got = R.bm25(files, queries, fields)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        want = R.bm25_joined(files, P.query_terms(queries), fields)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert R.bm25(files, queries.limit(0)).count() == 0 and R.bm25(files.limit(0), queries).count() == 0


def test_ranking_matches_joins_and_its_best_are_those_of_the_whole(spark, monkeypatch):
    from pyspark.sql import functions as F

    from loomtext.operators import graph as G
    from loomtext.operators import ranking as R

    monkeypatch.setattr(R, "CELLS", 20)
    files, contexts = corpus_of(spark)
    symbols = files.select("doc_id", F.explode("symbols").alias("symbol"))
    callers = G.unique_callers(G.references(files, G.definers(symbols)))
    named = contexts.select(F.explode("mentioned_symbols").alias("symbol"))
    some = {r["symbol"] for r in named.collect()}
    assert {tuple(r) for r in G.callers_of(files, symbols, named).collect()} == {tuple(r) for r in callers.collect() if r["symbol"] in some}
    joined = R.bm25(files, contexts.select("query_id", "query")).join(R.tiers(files, contexts, callers), ["query_id", "doc_id"], "full")
    joined = joined.select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("tier", F.lit(0)).alias("tier"))
    columns = ["query_id", "doc_id", "tier", "score", "rank"]
    want = R.total_order(joined.join(files, "doc_id")).select(*columns)
    r = R.Ranking(files, contexts.select("query_id", "query"), contexts)
    rows = sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, r.ranked().select(*columns).collect())) == rows
    assert sorted(map(tuple, r.ranked(3).select(*columns).collect())) == [x for x in rows if x[4] <= 3]
    firsts = want.groupBy("query_id", "tier").agg(F.count("*"), F.min("rank").cast("long"))
    assert sorted(map(tuple, r.tier_counts().collect())) == sorted(map(tuple, firsts.collect()))
    assert {x[2] for x in rows} >= {0, 1, 3, 4}


def test_plain_bm25_stores_counts_and_no_words(spark, monkeypatch):
    from loomtext.operators import ranking as R

    files, contexts = corpus_of(spark)
    names = []
    monkeypatch.setattr(R, "stored", lambda df, name, f=R.stored: names.append(df.columns) or f(df, name))
    rows = R.plain_bm25(files, contexts.select("query_id", "query"), 50).collect()
    assert rows and all("every" not in c for c in names)
    best = {(r["query_id"], r["doc_id"]): r["score"] for r in rows if r["place"] <= 4}
    assert {(r["query_id"], r["doc_id"]): r["score"] for r in R.plain_bm25(files, contexts.select("query_id", "query"), 4).collect()} == best


def test_structural_scores_join_no_pairs_and_match_the_joined_form(spark, monkeypatch):
    from pyspark.sql import functions as F

    from loomtext.operators import structural as S

    files, contexts = corpus_of(spark)
    none = F.array().cast("array<string>")
    facts = files.select(F.lit("t").alias("tree"), "doc_id", "path", "symbols", none.alias("imports"), F.array(F.lit("own3_0")).alias("references"), F.col("tokens").cast("long").alias("tokens"), F.lit(False).alias("changed"), "entrypoint")
    asked = contexts.select(F.lit("t").alias("tree"), F.col("query_id").cast("string").alias("query_id"), "query", "mentioned_paths", "mentioned_symbols", "open_paths", F.lit(9).cast("long").alias("budget"))
    norm = S.normal_facts(facts).localCheckpoint()
    idf = S.frequencies(norm).localCheckpoint()
    df = S.base_scores(norm, asked, idf)
    # No join of pairs: the only exchanges of signals are by file.
    last = df._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")[0]
    assert "Join" not in last
    rows = lambda d: sorted((r["query_id"], r["doc_id"], round(r["score"], 6)) for r in d.collect())
    got = rows(df)
    assert len(got) == 40 * 7
    monkeypatch.setattr(S, "MOST_ASKED", 0)
    assert rows(S.base_scores(norm, asked, idf)) == got


def test_passages_are_found_in_one_pass_as_by_the_join(spark, monkeypatch):
    """Borders of blocks and rows, passages shorter than a window, equal beginnings, runs of one letter, repeated ids, nulls."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(E, "BLOCK", 16)
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("ab \nñ") for _ in range(n))
    texts = ["", "a", "a" * 200, *(some(rng.randrange(120)) for _ in range(60))]
    cuts = [t[i : i + rng.randrange(1, 60)] for t in texts[2:40] for i in [rng.randrange(max(1, len(t)))]]
    passages = [*cuts, texts[5] + texts[6], "a" * 40, "a" * 40 + "b", "", "ñ", "Z"]
    docs = spark.createDataFrame([*enumerate(texts), (3, "again " + texts[7]), (99, None)], "doc_id long, text string").withColumn("text", F.coalesce("text", F.lit("")))
    asked = spark.createDataFrame([(i % 30, p) for i, p in enumerate(passages)] + [(31, None)], "query_id long, passage string")
    want = {(i % 30, d) for i, p in enumerate(passages) for d, t in [*enumerate(texts), (3, "again " + texts[7]), (99, "")] if p in t}
    df = E.holders(docs, asked)
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert E.holders(docs, asked.limit(0)).count() == 0 and E.holders(docs.limit(0), asked).count() == 0
    monkeypatch.setattr(E, "MOST_PASSAGES", 3)
    assert {tuple(r) for r in E.holders(docs, asked).collect()} == want


def test_areas_keep_counts_and_no_words_and_match_the_joined_form(spark, monkeypatch):
    from loomtext.operators import ranking as R

    monkeypatch.setattr(R, "CELLS", 20)
    files, contexts = corpus_of(spark)
    files = files.selectExpr("doc_id", "concat('d', doc_id % 5, '/', path) AS path", "text").union(spark.createDataFrame([(90, "alone.rs", ""), (91, "d1/betas.rs", "Glasses glass")], "doc_id long, path string, text string")).localCheckpoint()
    queries = contexts.select("query_id", "query").union(spark.createDataFrame([(11, "nothingThere"), (12, "glasses")], "query_id long, query string"))
    names = []
    monkeypatch.setattr(R, "stored", lambda df, name, f=R.stored: names.append(df.columns) or f(df, name))
    for most in (1, 3):
        got = R.areas(files, queries, most)
        assert all("every" not in c for c in names)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        want = sorted(map(tuple, R.areas_joined(files, queries, most).collect()))
        names.clear()
        assert want and sorted(map(tuple, got.collect())) == want
    assert R.areas(files, queries.limit(0)).count() == 0 and R.areas(files.limit(0), queries).count() == 0


def test_symbols_with_two_sure_users_are_not_looked_at(spark, monkeypatch):
    """Files of few runs settle a symbol; files of many are still looked at as a whole, with their share of references."""
    from pyspark.sql import functions as F

    from loomtext import corpus
    from loomtext.operators import graph as G

    many = " ".join(f"own_{i:03}" for i in range(80))
    texts = {0: "\n".join(f"own_{i:03}" for i in range(80)), 1: "x zed_two own_001", 2: many, 3: "x own_001", 4: "zed_two\nzed_one", 5: many + " zed_one", 6: "x zed_two", 7: "x zed_two", 8: "x own_079 zed_one"}
    files = corpus.with_symbols(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).localCheckpoint()
    symbols = files.select("doc_id", F.explode("symbols").alias("symbol"))
    named = spark.createDataFrame([("own_001",), ("own_079",), ("zed_one",), ("zed_two",)], "symbol string")
    want = {tuple(r) for r in G.unique_callers(G.references(files, G.definers(symbols))).collect() if r["symbol"] in ("own_001", "own_079", "zed_one", "zed_two")}
    seen = []
    monkeypatch.setattr(G, "references", lambda f, *a, f0=G.references: seen.append({r["doc_id"] for r in f.select("doc_id").collect()}) or f0(f, *a))
    assert {tuple(r) for r in G.callers_of(files, symbols, named).collect()} == want == {("own_079", 8), ("zed_one", 8)}
    assert seen == [{2, 5, 8}]
    monkeypatch.setattr(G, "MOST_REFERENCES", -1)
    assert {tuple(r) for r in G.callers_of(files, symbols, named).collect()} == want
