"""What the operators promise beyond their base results, by value: passages, longest matches, packed ids, clashing columns, damage, skew."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomtext.llm import decontaminate, fingerprints, licenses, near_dup, packing, queries, scratch, suffix_dedup, token_store, toxicity
from loomtext.llm.textkit import Words, buffers

TOKENIZER = public_tokenizers.path(queries.TOKENIZER)
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def prose(rng, n, tag=""):
    return " ".join(tag + "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 9))) for _ in range(n))


def sharing(texts, n):
    """Texts of which some run of n words stands in another text too."""
    where = {}
    for i, t in enumerate(texts):
        w = words(t)
        for k in range(len(w) - n + 1):
            where.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {i for s in where.values() if len(s) > 1 for i in s}


@pytest.fixture(scope="module")
def passages(spark):
    rng = random.Random(11)
    shared = [prose(rng, 51 + k) for k in range(8)]
    texts = [prose(rng, rng.randrange(0, 120)) + " " + (shared[k % 8] if k % 3 == 0 else "") + " " + prose(rng, rng.randrange(0, 120)) for k in range(90)]
    texts += [prose(rng, 1) * 1 + " lorem" * 300, "", None]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7), texts


def test_no_passage_of_51_words_stays(passages):
    docs, texts = passages
    assert len(sharing(texts, 51)) == 30
    left = [r["text"] for r in suffix_dedup.strip_repeats(docs).orderBy("doc_id").collect()]
    assert not sharing(left, 51)
    assert left[-1] is None and all(left[i] == texts[i] for i in range(90) if i % 3)


def test_marks_find_every_shared_passage(passages):
    docs, texts = passages
    got = {r["doc_id"]: r["n_shared"] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert all(got[i] for i in sharing(texts, 51))
    assert not any(got[i] for i in set(range(len(texts))) - sharing(texts, 26))


def test_a_long_run_of_one_byte_is_few_rows(spark):
    docs = spark.createDataFrame([(1, "a" * 200_000), (2, "xy" * 50_000)], "id long, text string").withColumn("t", F.lit(1))
    rows = docs.mapInArrow(lambda b: suffix_dedup._anchors(b, 400, 100), suffix_dedup.ANCHORS)
    assert rows.count() < 20
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(docs.select(F.col("id").alias("doc_id"), "text")).collect()}
    assert got == {1: 200_000, 2: 100_000}


def test_repeats_are_exact_on_a_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.select("doc_id", "text").collect()}
    seen = Counter(t[k : k + 400] for t in texts.values() for k in range(len(t) - 399))
    gone = {}
    for i, t in texts.items():
        mark = np.zeros(len(t), bool)
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                mark[k : k + 400] = True
        gone[i] = int(mark.sum())
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(docs).collect()} == gone and any(gone.values())


def test_longest_matches_against_brute_force(spark):
    rng = random.Random(4)
    items = [("a", prose(rng, 40)), ("b", prose(rng, 20)), ("c", prose(rng, 5)), ("d", prose(rng, 30)), (None, prose(rng, 15))]
    piece = lambda t, a, b: " ".join(t.split()[a:b])
    texts = [
        prose(rng, 9) + " " + piece(items[0][1], 5, 33) + " " + prose(rng, 3), piece(items[1][1], 0, 14) + " " + items[1][1], items[2][1] + " " + prose(rng, 4),
        piece(items[0][1], 0, 13) + " " + piece(items[0][1], 20, 35), piece(items[3][1], 0, 12), items[4][1] + " " + items[1][1], "", None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r["doc_id"]: (r["longest"], r["longest_at"], r["longest_item"], r["longest_item_at"]) for r in decontaminate.judge(docs, bench).collect()}
    for i, t in enumerate(texts):
        w, best = words(t), (0, None, None, None)
        for name, item in items:
            b = words(item)
            least = min(13, len(b))
            for at, o in itertools.product(range(len(w)), range(len(b))):
                n = next((k for k, (x, y) in enumerate(zip(w[at:], b[o:])) if x != y), min(len(w) - at, len(b) - o))
                if n >= least and (best[0] == 0 or (-n, name or "", at, o) < (-best[0], best[2], best[1], best[3])):
                    best = (n, at, name or "", o)
        assert got[i] == best, i


def test_items_of_one_word_beside_long_ones(spark):
    rng = random.Random(9)
    long = prose(rng, 30)
    bench = spark.createDataFrame([(1, "solo"), (2, "two words"), (3, long)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"solo {long} two words"), (2, "two solo words"), (3, "words two")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.judge(docs, bench).collect()}
    assert got == {1: (33, 3), 2: (1, 1), 3: (0, 0)}


CLASH = "doc_id long, text string, spans string, items int, contaminated int, n_words string, n_hit int, match string, id string, t string, _t int, h int, root string, kept string, gone int"


def test_clashing_columns_keep_their_values(spark):
    rng = random.Random(2)
    item = prose(rng, 20)
    rows = [(i, t, "s", 1, 2, "w", 3, "m", "i", "t", 4, 5, "r", "k", 6) for i, t in enumerate([prose(rng, 80), f"{prose(rng, 2000)} {item}", prose(rng, 70), None])]
    docs = spark.createDataFrame(rows, CLASH)
    clean = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert clean.dtypes == docs.dtypes
    assert sorted(map(tuple, clean.collect())) == sorted((r for r in rows if r[0] != 1))
    kept = near_dup.keep_one(docs.union(docs))
    assert kept.dtypes == docs.dtypes and sorted(map(tuple, kept.collect())) == sorted(rows)


def test_no_benchmark_window_stays(spark, tiny):
    docs, bench = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "benchmark"))
    before = decontaminate.judge(docs, bench).where("n_hit > 0").count()
    left = decontaminate.drop_contaminated(docs, bench)
    assert before and left.count() == docs.count() - before
    assert not decontaminate.judge(left, bench).where("n_hit > 0").count()


def test_rows_equal_in_id_and_text_leave_the_same_row(spark):
    rows = [(1, "one two three four five six", k) for k in range(20)]
    got = {near_dup.keep_one(spark.createDataFrame(random.Random(k).sample(rows, 20), "doc_id long, text string, x int").repartition(k + 1)).first()["x"] for k in range(3)}
    assert len(got) == 1


def test_many_null_ids_stay_linear(spark):
    rng = random.Random(6)
    base = prose(rng, 100)
    texts = [base + f" end{k}" for k in range(600)]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(5)
    seen = spark.sparkContext.accumulator(0)
    plain = near_dup._sets

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield from plain(iter([b]))

    near_dup._sets = counted
    try:
        got = near_dup.classes(docs).collect()
    finally:
        near_dup._sets = plain
    assert len(got) == 600 and len({tuple(r["root"]) for r in got}) == 1
    assert 0 < seen.value <= 600


def test_classes_do_not_depend_on_partitions(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    found = [sorted((r["doc_id"], r["class_id"]) for r in near_dup.classes(docs.repartition(n)).select("doc_id", "class_id").collect()) for n in (1, 32)]
    assert found[0] == found[1] and any(a != b for a, b in found[0])


def test_recall_against_all_pairs(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    idf = near_dup.weights(docs)
    text, h, count = near_dup.shingles(pa.array([r["text"] for r in rows], pa.string()))
    sets = [dict(zip(h[text == i].tolist(), idf.of(h[text == i], count[text == i]).tolist())) for i in range(len(rows))]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and len(sets[i].keys() & sets[j].keys()) > 3 and near_dup.similarity(sets[i], sets[j]) >= near_dup.SIMILARITY]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(docs).collect()}
    assert len(pairs) > 5
    assert np.mean([got[rows[i]["doc_id"]] == got[rows[j]["doc_id"]] for i, j in pairs]) >= 0.9


def _rewrite(spark, path, where):
    """Takes the rows that meet a condition out of a table of the store."""
    jvm = spark._jvm
    spark.read.parquet(path).where(f"not coalesce({where}, false)").write.parquet(f"{path}-new")
    old, new = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}-new"))
    fs = old.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.delete(old, True)
    fs.rename(new, old)


@pytest.mark.parametrize("kind, error", [("recipe", "recipe isn't in the store"), ("chunk", "isn't in the store")])
def test_store_misses_what_is_lost(spark, kind, error):
    docs = spark.createDataFrame([(i, f"text number {i} of some") for i in range(9)], "doc_id long, text string")
    path = scratch.new_path(spark, "store")
    store = token_store.Store.write(docs, path, TOKENIZER)
    assert store.summary().count() == 9
    key = store._content(kind).select(F.hex("key").alias("k")).first()["k"]
    _rewrite(spark, f"{path}/content/kind={kind}", f"hex(key) = '{key}'")
    with pytest.raises(Exception, match=error):
        token_store.Store(spark, path).summary().collect()


@pytest.mark.parametrize("text, label", [
    ("licensed under the apache\nlicense, version 2.0", "apache-2.0"), ("the mit\nlicense", "mit"), ("gnu general public\n   license version 3", "gpl-3.0"), ("mit  license", "mit"),
    ("permission is hereby\n * x", None), ("mozilla\tpublic\r\nlicense, version 1.1", "mpl-1.1"),
])
def test_notices_over_line_ends(text, label):
    found = licenses.detect_in(f"x\n\n {text}  \n y")
    assert label in {x[2] for x in found} if label else not found
    for a, b, _, _ in found:
        assert f"x\n\n {text}  \n y"[a:b].split() == text[text.index(f"x\n\n {text}  \n y"[a:b]) :][: b - a].split()


def test_suppression_against_brute_force():
    rng = random.Random(5)
    bits = ["licensed under the apache license, version 2.0", "apache license", "the mit license", "mit license", "gnu general public license", "general public license, version 2", "bsd license", "simplified bsd license", "gpl, version 3", "cc-by-sa-4.0", "see"]
    table = licenses.rules()[0]
    for _ in range(60):
        text = " ".join(rng.choice(bits) for _ in range(rng.randrange(1, 9)))
        every = sorted((-p, m.start() - m.end(), i, m.start(), m.end(), label, sure) for i, (label, p, sure, _, regex) in enumerate(table) for m in regex.finditer(text))
        kept = []
        for x in every:
            if not any(k[3] <= x[3] and x[4] <= k[4] for k in kept):
                kept.append(x)
        assert licenses.detect(text) == sorted((x[3], x[4], x[5], x[6]) for x in kept)


def test_packed_ids_are_those_of_the_texts(spark):
    whole = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(3)
    texts = [(1, prose(rng, 700)), (1, "another"), (2, None), (None, prose(rng, 30)), (5, "same"), (5, "same"), (6, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    packed = packing.pack(docs, TOKENIZER, longest=128, buckets=3, budget=512)
    plan = {(r["bucket"], r["batch"], r["slot"]): r for r in packed.collect()}
    rows = packing.batches(docs, packed, TOKENIZER).collect()
    assert len(rows) == len(plan)
    streams = {}
    for r in rows:
        p = plan[r["bucket"], r["batch"], r["slot"]]
        assert p["doc_id"] == r["doc_id"] and len(r["ids"]) == p["bucket_len"] and set(r["ids"][r["n_tokens"] :]) <= {2}
        streams.setdefault((r["doc_id"], p["h"]), []).append((p["start"], r["ids"][: r["n_tokens"]]))
    got = Counter()
    for (i, _), parts in streams.items():
        by = {}
        for start, ids in parts:
            by.setdefault(start, []).append(ids)
        for k in range(len(by[0])):
            got[i, tuple(x for s in sorted(by) for x in by[s][k])] += 1
    assert got == Counter((i, (*whole.encode(t or "", add_special_tokens=False).ids, 2)) for i, t in texts)


def test_likeness_across_lengths(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rank = fingerprints.corpus_ranks(docs)
    texts = [r["text"] for r in docs.where("length(text) > 500").limit(40).collect()]
    of = lambda t: fingerprints.fingerprint(pa.array([t]), rank)[0]
    for n in (64, 95, 200, 400):
        assert np.mean([fingerprints.likeness(of(t[:n]), of(t[: n + 1])) for t in texts]) > 0.85, n
    assert len(of("short")) == 1 and fingerprints.likeness(of("x"), of("x")) == 1


def test_many_rows_of_one_id(spark):
    rng = random.Random(1)
    texts = [(7, prose(rng, 20)) for _ in range(200)] + [(i, prose(rng, 20)) for i in (1, 9)]
    got = fingerprints.compare_edited(spark.createDataFrame(texts, "doc_id long, text string").repartition(6)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in texts)


def test_ftrl_against_a_plain_loop():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 40, 8)).astype(np.int32) for _ in range(120)]
    labels = np.array([float(3 in r or 5 in r) for r in rows])
    model = toxicity.train(rows, labels, bits=6, l1=0.5, epochs=2)
    z, n, order = [0.0] * 65, [0.0] * 65, np.random.Generator(np.random.PCG64(7))

    def weight(i):
        l1 = 0.5 if i < 64 else 0.0
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / (1 + n[i] ** 0.5)

    for _ in range(2):
        for k in order.permutation(120).tolist():
            f = [*rows[k].tolist(), 64]
            w = [weight(i) for i in f]
            g = 1 / (1 + np.exp(-sum(w))) - labels[k]
            for i, x in zip(f, w):
                sigma = (n[i] + g * g) ** 0.5 - n[i] ** 0.5
                z[i] += g - sigma * x
                n[i] += g * g
    want = [weight(i) for i in range(65)]
    assert model.places.tolist() == [i for i in range(64) if want[i]]
    assert np.allclose(model.weights, [want[i] for i in model.places]) and np.isclose(model.intercept, want[64])
    score = model.score(Words(*buffers(pa.array(["", "a b"]))))
    assert np.isclose(score[0], 1 / (1 + np.exp(-want[64])))


def test_toxicity_sample_is_bounded_in_bytes(spark, tiny):
    docs, labels = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")
    seen, plain = [], toxicity.train

    def watched(rows, *rest, **more):
        seen.append(len(rows))
        return plain(rows, *rest, **more)

    toxicity.train = watched
    try:
        for most in (10, 50_000, 1 << 40):
            toxicity.fit(docs, labels, sample_bytes=most)
    finally:
        toxicity.train = plain
    assert seen[0] < seen[1] < seen[2]


def test_no_local_scratch_on_a_cluster():
    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="checkpoint"):
        scratch.folder(Session())
