"""The corpus operators against brute force, on odd rows and on empty tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomtext.llm import decontaminate, encoder, fingerprints, licenses, near_dup, packing, quality, queries, scratch, suffix_dedup, textkit, token_store, toxicity, url_filter

TOKENIZER = public_tokenizers.path(queries.TOKENIZER)
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, items int, id int, t string, h string, n int, bucket int, kept string, score string, x int, key string"
LONG = " ".join(f"word{i % 977} and {i % 13}" for i in range(60_000))
NOTE = "Licensed under the Apache License, Version 2.0. All rights reserved; see CC-BY 4.0 or the GNU General\nPublic License."
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog."), (1, "Another text under the same id, with other words."), (2, None), (3, ""), (None, "a row without an id"), (None, "a row without an id"),
    (4, LONG), (5, NOTE), (6, NOTE), (6, NOTE), (7, "\0 \n\t"), (8, "Größe, Straße – 漢字 😀 é"), (9, "x"), (10, "<|endoftext|> isn't × special ÷ here 's"), (-5, "minus"),
]


def rows(texts):
    return [(i, t, "en", "web", len(t or ""), "s", 1, 2, "t", "h", 3, 4, "k", "z", 5, "y") for i, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(TEXTS), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


# 1 token store


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(TOKENIZER)


def test_encoder_equals_the_library(whole):
    texts = [t or "" for _, t in TEXTS] + ["it's I'LL they've", "ÀÉÎ çà", "a1b22c", "tab\tline\r\nend", "—dash“quote”", "a\u00a0b", "<| x"]
    ids, bounds = encoder.Encoder(TOKENIZER).encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_store_reads_back_what_it_was_given(spark, odd, whole):
    store = token_store.Store.write(odd, scratch.new_path(spark, "store"), TOKENIZER)
    streams = [(i, [*whole.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in TEXTS]
    docs = store.documents().collect()
    back = {bytes(r["root"]): list(r["ids"]) for r in store.read().collect()}
    sums = {bytes(r["root"]): r["ids_crc32"] for r in store.checksums().collect()}
    assert Counter((r["doc_id"], tuple(back[bytes(r["root"])])) for r in docs) == Counter((i, tuple(s)) for i, s in streams)
    for root, ids in back.items():
        assert sums[root] == zlib.crc32(np.array(ids, "<u4").tobytes())
    docs.sort(key=lambda r: r["start"])
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in docs]
    assert order == sorted(order)
    assert [r["start"] for r in docs] == [0, *itertools.accumulate(r["n_tokens"] for r in docs)][:-1]
    assert len(store.manifest()) == 16
    digests = [bytes(r["digest"]) for r in store.chunks().collect()]
    assert len(digests) == len(set(digests))


def test_store_finds_damage(spark, odd):
    store = token_store.Store.write(odd.where("doc_id = 4"), scratch.new_path(spark, "store"), TOKENIZER)
    broken = store.chunks().selectExpr("digest", "concat(payload, cast('xx' as binary)) as payload")
    with pytest.raises(Exception, match="damaged"):
        broken.mapInArrow(token_store._summed, "digest binary, crc long, n_ids long").collect()


@pytest.mark.parametrize("change", [
    "kind = 'document' and doc_id = 7 -> null", "kind = 'document' and doc_id = 7 -> doc_id + 100", "kind = 'document' and part = 1 -> null", "kind = 'part' and part = 1 -> null", "kind = 'part' and part = 1 -> doc_id, n + 1",
])
def test_store_finds_a_damaged_index(spark, odd, change):
    path = scratch.new_path(spark, "store")
    store = token_store.Store.write(odd, path, TOKENIZER)
    before = store.documents().count()
    where, to = change.split(" -> ")
    index = spark.read.schema("kind string, part int, doc_id long, root binary, start long, n long").parquet(f"{path}/index")
    assert before == len(TEXTS) and index.where(where).count()
    if to == "null":
        bad = index.where(f"not coalesce({where}, false)")
    else:
        name = "n" if "n + 1" in to else "doc_id"
        bad = index.withColumn(name, F.expr(f"if(coalesce({where}, false), {name} + {100 if name == 'doc_id' else 1}, {name})"))
    bad.write.partitionBy("kind").parquet(f"{path}/index2")
    jvm = spark._jvm
    there = [jvm.org.apache.hadoop.fs.Path(f"{path}/{x}") for x in ("index", "index2")]
    fs = there[0].getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.delete(there[0], True)
    fs.rename(there[1], there[0])
    with pytest.raises(Exception, match="damaged|doesn't match"):
        token_store.Store(spark, path).documents().collect()


def test_merkle_roots_agree():
    for n in range(20):
        leaves, tree = [bytes([i]) * 16 for i in range(n)], token_store.Merkle()
        for x in leaves:
            tree.add(x)
        assert tree.root() == token_store.merkle(leaves)


def test_shifted_crcs_add_up():
    rng = random.Random(1)
    for _ in range(20):
        parts = [rng.randbytes(4 * rng.randrange(1, 50)) for _ in range(3)]
        after = [sum(map(len, parts[i + 1 :])) for i in range(3)]
        got = token_store.shift_crc(np.array([zlib.crc32(p) for p in parts], np.uint32), np.array(after))
        assert int(np.bitwise_xor.reduce(got)) == zlib.crc32(b"".join(parts))


def test_empty_store(spark, empty):
    store = token_store.Store.write(empty, scratch.new_path(spark, "store"), TOKENIZER)
    assert store.documents().count() == store.chunks().count() == store.checksums().count() == 0


# 2 quality


def test_quality_agrees_with_labels(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}
    judged = {r["doc_id"]: r["keep"] for r in quality.judge(docs, quality.fit(docs)).collect()}
    both = [(judged[k], v) for k, v in labels.items() if k in judged and v is not None]
    assert np.mean([a == bool(b) for a, b in both]) > 0.95


def test_quality_on_odd_rows(odd, empty):
    model = quality.fit(odd)
    judged = quality.judge(odd, model).collect()
    assert len(judged) == len(TEXTS)
    assert not any(r["keep"] or r["score"] for r in judged if r["doc_id"] in (2, 3, 7))
    kept = quality.keep_good(odd, model)
    assert kept.columns == odd.columns and kept.dtypes == odd.dtypes
    model = quality.fit(empty)
    assert quality.judge(empty, model).count() == quality.keep_good(empty, model).count() == 0


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(3)
    good = rng.random(20_000) < 0.8
    votes = np.stack([np.where(rng.random(20_000) < right, np.where(good, 1, 2), np.where(good, 2, 1)) for right in (0.95, 0.9, 0.8)], axis=1)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    prior, p = quality.estimate(patterns, n.astype(float))
    assert abs(prior - 0.8) < 0.1
    assert p[1, 0, 1] > p[1, 2, 1]


# 3 licences


def test_base_places_against_brute_force(odd):
    got = {(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan(odd).collect()}
    want = set()
    for i, t in TEXTS:
        w, at, labels = words(t), [], set()
        for phrase, label in licenses.BASE_PHRASES.items():
            p = phrase.encode().split()
            here = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        want.add((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    assert got == want


def test_contained_detections_are_suppressed():
    found = licenses.detect(NOTE.lower())
    labels = [x[2] for x in found]
    assert "apache-2.0" in labels and "apache" not in labels
    for a, b in itertools.permutations(found, 2):
        assert not (a[0] <= b[0] and b[1] <= a[1])


def test_rules_are_well_formed():
    assert len(licenses.rules()[0]) > 200
    for _, _, _, keyword, _ in licenses.rules()[0]:
        assert keyword == keyword.lower()
    assert licenses.detect("nothing here") == []


def form(tree, rng):
    """A text that a parsed regex matches, chosen at random."""
    out = ""
    for op, a in tree:
        op = str(op)
        if op == "LITERAL":
            out += chr(a)
        elif op == "SUBPATTERN":
            out += form(a[3], rng)
        elif op == "BRANCH":
            out += form(rng.choice(a[1]), rng)
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(form(a[2], rng) for _ in range(rng.randint(a[0], min(a[1], a[0] + 1))))
        elif op == "IN":
            kind, x = rng.choice([y for y in a if str(y[0]) != "NEGATE"]) if str(a[0][0]) != "NEGATE" else ("LITERAL", ord("q"))
            out += " " if str(kind) == "CATEGORY" else chr(x[0] if str(kind) == "RANGE" else x)
        else:
            out += {"ANY": " ", "AT": ""}[op]
    return out


def test_keywords_shut_no_match_out():
    rng = random.Random(3)
    for _, _, _, keyword, regex in licenses.rules()[0]:
        tree = re._parser.parse(regex.pattern, re.ASCII)
        texts = [f" {form(tree, rng)} " for _ in range(40)]
        # Some forms miss a word boundary.
        assert sum(bool(regex.search(text)) for text in texts) >= 1, regex.pattern
        for text in texts:
            assert licenses.detect(text) == licenses.detect(text, gated=False), (keyword, text)
    labels = {x[2] for x in licenses.detect("under the gnu general public license, version 3.")}
    assert "gpl-3.0" in labels
    assert [x[2] for x in licenses.detect("gpl, version 2")] == ["gpl-2.0"]


def test_licences_of_an_empty_table(empty):
    assert licenses.scan(empty).count() == 0


# 4 suffix arrays


def brute_repeats(texts, length):
    places = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if places[t[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_repeats_against_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("ab é") for _ in range(rng.randrange(25, 90))) for _ in range(6)]
    texts = []
    for _ in range(60):
        own = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(0, 80)))
        texts.append(own[: len(own) // 2] + rng.choice(["", *passages]) + own[len(own) // 2 :] + rng.choice(["", *passages])[:40])
    texts += ["a" * 100, "ab" * 40, "", texts[3], texts[3], *["z" * 21 + str(k) for k in range(30)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs, 20).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats([t.encode() for t in texts], 20)


def test_many_contexts_of_one_anchor(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", 3)
    test_repeats_against_brute_force(spark, 7)


def test_two_stage_sort_is_a_suffix_sort():
    rng = random.Random(5)
    for _ in range(60):
        parts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 30))).encode() for _ in range(rng.randrange(1, 5))]
        data, ends = b"".join(parts), np.cumsum([len(p) for p in parts])
        wanted = np.array(sorted(rng.sample(range(len(data)), rng.randrange(1, len(data) + 1))))
        order = suffix_dedup.two_stage_sort(data, ends, wanted, 64)
        suffix = lambda i: data[i : ends[np.searchsorted(ends, i, "right")]]
        got = [suffix(i) for i in order.tolist()]
        assert got == sorted(got) and sorted(order.tolist()) == wanted.tolist()
        common = suffix_dedup.neighbour_lcp(data, ends, order, 64).tolist()
        for a, b, n in zip(got, got[1:], common[1:]):
            assert n == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_repeats_of_odd_rows(odd, empty):
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(odd).collect())
    texts = [(t or "").encode() for _, t in TEXTS]
    assert got == Counter((i, *x) for (i, _), x in zip(TEXTS, brute_repeats(texts, 400)))
    stripped = suffix_dedup.strip_repeats(odd)
    assert stripped.dtypes == odd.dtypes and stripped.count() == len(TEXTS)
    assert [r["text"] for r in stripped.where("doc_id = 2").collect()] == [None]
    assert suffix_dedup.remove_repeats(empty).count() == suffix_dedup.strip_repeats(empty).count() == 0


# 5 urls


def test_urls(spark, tiny, same_rows):
    same_rows(queries.op5_url_filter, queries.ORACLE_SQL["op5_url_filter"], tiny)


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://NET/x", "http://a.b.net", "https://www.example.net/en/page?x#y", "https://example.net/en", "https://example.com/de/", "https://notexample.com/de/", "x://org/fr/", "x://y.org/fr", "://", "a://b://net/", "http://net?q"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, url_filter.default_rules(spark)).collect()}

    def want(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (low == h or low.endswith("." + h)) and path.startswith(p)]
        return low, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"

    assert got == {i: want(u) for i, u in enumerate(urls)}
    assert url_filter.judge(pages.limit(0), url_filter.default_rules(spark)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, url_filter.default_rules(spark).limit(0)).collect()} == {"allow"}


# 6 decontamination


def test_decontamination(tiny, same_rows):
    same_rows(queries.op6_decontaminate, queries.ORACLE_SQL["op6_decontaminate"], tiny)


def test_decontamination_of_odd_rows(spark, odd, empty, monkeypatch):
    items = [("a", " ".join(LONG.split()[100:120])), ("b", "quick BROWN fox"), (None, "lazy"), ("c", ""), ("d", None), ("a", "minus")]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id string, text string, spans int")

    def want(text):
        w, hit, found = words(text), set(), set()
        for item, t in items:
            b = words(t)
            k = min(13, len(b))
            for s in range(len(b) - k + 1 if b else 0):
                for at in range(len(w) - k + 1):
                    if w[at : at + k] == b[s : s + k]:
                        hit |= set(range(at, at + k))
                        found.add(item or "")
        return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)

    short = odd.where("doc_id is null or doc_id <> 4")
    expected = Counter((i, *want(t)) for i, t in TEXTS if i != 4)
    for words_at_once in (decontaminate.BLOCK_WORDS, 3):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", words_at_once)
        got = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.judge(short, bench).collect())
        assert got == expected
    assert decontaminate.judge(odd, bench).where("doc_id = 4").first()["n_hit"] > 0
    assert decontaminate.drop_contaminated(odd, bench).columns
    assert decontaminate.judge(empty, bench).count() == 0
    assert decontaminate.judge(odd, bench.limit(0)).where("n_hit > 0").count() == 0


# 7 packing


def test_bucket_bounds_are_optimal():
    rng = random.Random(2)
    for _ in range(40):
        lengths = sorted(rng.sample(range(1, 60), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 20) for _ in lengths]
        cost = lambda bounds: sum(n * (min(b for b in bounds if b >= x) - x) for x, n in zip(lengths, counts))
        best = min(cost((*c, lengths[-1])) for k in range(0, 3) for c in itertools.combinations(lengths[:-1], k))
        assert cost(packing.best_buckets(np.array(lengths), np.array(counts), 3)) == best
    assert packing.best_buckets(np.zeros(0, int), np.zeros(0, int), 3) == []


def test_packing_keeps_every_token(odd, empty, whole):
    got = packing.pack(odd, TOKENIZER).collect()
    total = sum(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in TEXTS)
    assert sum(r["n_tokens"] for r in got) == total
    slots = Counter((r["bucket"], r["batch"], r["slot"]) for r in got)
    assert max(slots.values()) == 1
    size = Counter()
    for r in got:
        assert r["padding"] == r["bucket_len"] - r["n_tokens"] >= 0
        size[r["bucket"], r["batch"]] += r["bucket_len"]
    assert max(size.values()) <= packing.BUDGET
    assert packing.pack(empty, TOKENIZER).count() == 0


# 8 fingerprints


def test_edited_texts_and_likeness(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "Straße", "漢字"]) + str(rng.randrange(999)) for _ in range(rng.randrange(1, 200))) for _ in range(40)]
    texts = [*base, base[0], "", "x", "ab", None, base[1]]
    docs = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string").repartition(4)
    rank = fingerprints.corpus_ranks(docs)
    got = {r["doc_id"]: r for r in fingerprints.compare_edited(docs, rank).collect()}
    assert len(got) == len(texts)
    of = lambda t: fingerprints.fingerprint(pa.array([t]), rank)[0]
    for i, t in enumerate(texts):
        t, after = t or "", texts[i - 1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["near_edited"] == pytest.approx(fingerprints.likeness(of(t), of(edited)))
        assert got[i]["near_next"] == pytest.approx(fingerprints.likeness(of(t), of(after)))
    assert got[0]["fingerprint"] == got[40]["fingerprint"]
    assert sum(got[i]["near_edited"] > got[i]["near_next"] for i in range(40)) >= 36


def test_entropies_against_brute_force():
    data = np.frombuffer(random.Random(1).randbytes(40) + b"aaaa" * 20 + "Größe".encode() * 9, np.uint8)
    got = fingerprints.entropies(data)
    for i in range(len(got)):
        n = np.bincount(data[i : i + fingerprints.WIDTH])
        p = n[n > 0] / fingerprints.WIDTH
        assert abs(got[i] / fingerprints.STEPS * np.log2(fingerprints.WIDTH) + (p * np.log2(p)).sum()) < 0.02


def test_fingerprints_of_odd_rows(odd, empty):
    assert fingerprints.compare_edited(odd).count() == len(TEXTS)
    assert fingerprints.compare_edited(odd.where("doc_id = 9")).first()["near_next"] == 1
    assert fingerprints.fingerprints(odd).count() == len(TEXTS)
    assert fingerprints.compare_edited(empty).count() == 0


# 9 toxicity


def test_toxicity_on_held_out_rows(spark, tiny):
    docs, labels = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1
    known = [(got[r["doc_id"]], r["toxic"]) for r in labels.collect() if r["doc_id"] in got]
    assert np.mean([a["predicted"] == b for a, b in known if a["held_out"]]) > 0.9
    other = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    again = toxicity.fit(docs, other)
    assert np.array_equal(model.weights, again.weights) and model.intercept == again.intercept


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (4, 0, 0), (None, 1, 1), (6, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, labels)
    assert toxicity.score(odd, model).count() == len(TEXTS)
    assert toxicity.score(empty, toxicity.fit(empty, labels.limit(0))).count() == 0
    assert {r["predicted"] for r in toxicity.score(odd, toxicity.fit(odd, labels.limit(0))).collect()} == {0}


# 10 near duplicates


def brute_classes(texts, idf):
    """Classes by all pairs. idf: of a Counter of shingles (tuples of words), their weights."""
    sets = [Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w := words(t)) >= 5 else Counter({tuple(w): 1} if w else {}) for t in texts]
    weights = [idf(c) for c in sets]
    root, links = list(range(len(texts))), 0

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        alike = texts[i] == texts[j] if not sets[i] or not sets[j] else near_dup.similarity(weights[i], weights[j]) >= near_dup.SIMILARITY
        if alike:
            a, b = sorted((top(i), top(j)))
            root[b] = a
            links += 1
    return [top(i) for i in range(len(texts))], links


def test_classes_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += ["", "", "  ", "one two", "one  two!", "One Two", "a b c d"]
    docs = spark.createDataFrame([(i, t, "c", 0) for i, t in enumerate(texts)], "doc_id long, text string, class_id string, keys int").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(docs).collect()}
    known = near_dup.weights(docs)

    def idf(c):
        h = {s: near_dup.shingles(pa.array([b" ".join(s).decode()]))[1] for s in c}
        return {s: float(known.of(h[s], np.array([n]))[0]) for s, n in c.items()}

    want, links = brute_classes(texts, idf)
    found = [(got[i] == got[j], want[i] == want[j]) for i, j in itertools.combinations(range(len(texts)), 2)]
    assert links > 20
    assert not any(a and not b for a, b in found)
    assert sum(a for a, b in found if b) >= 0.97 * sum(b for _, b in found)


@pytest.mark.parametrize("parts", [1, 60])
def test_document_frequencies_are_exact(spark, parts):
    texts = [f"own{k}a own{k}b own{k}c own{k}d own{k}e" + "".join(f" -{s} s{s}a s{s}b s{s}c s{s}d s{s}e" for s in (2, 5, 10, 20, 50, 99, 101, 150) if k % s == 0) for k in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    known = near_dup.weights(docs)
    _, h, _ = near_dup.shingles(pa.array(texts))
    h, n = np.unique(h, return_counts=True)
    want = 1 + near_dup.IDF_PART * np.log(np.minimum(len(texts) / n, near_dup.RARE))
    assert (n * near_dup.RARE > len(texts)).sum() > 20
    assert np.allclose(known.of(h, np.ones(len(h))), want)


def test_alike_texts_of_crowded_buckets_meet(spark):
    # Texts of a form that share little else; the two with the shortest remainders alone are alike.
    texts = []
    for f in range(6):
        form = [f"form{f}x{k}" for k in range(300)]
        texts += [" ".join(form + [f"own{f}x{k}x{i}" for i in range(16 if k < 2 else 60)]) for k in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(docs).collect()}
    known = near_dup.weights(docs)
    text, h, count = near_dup.shingles(pa.array(texts))
    sets = [dict(zip(h[text == i].tolist(), known.of(h[text == i], count[text == i]).tolist())) for i in range(400)]
    alike = {(i, j) for i, j in itertools.combinations(range(200), 2) if near_dup.similarity(sets[i], sets[j]) >= near_dup.SIMILARITY}
    assert alike == {(0, 1)}
    assert [got[k] == got[k + 1] for k in range(0, 1200, 200)] == [True] * 6
    assert len(set(got.values())) == 1194


def test_samples_agree_as_often_as_texts_are_alike():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 2**63, 400, dtype=np.uint64)
    w = rng.uniform(1, 3, 400)
    a, b = np.arange(0, 360), np.arange(40, 400)
    text = np.concatenate([np.zeros(360, int), np.ones(360, int)])
    got = near_dup.samples(text, np.concatenate([h[a], h[b]]), np.concatenate([w[a], w[b]]), 2, 2000)
    true = w[40:360].sum() / w.sum()
    assert abs((got[0] == got[1]).mean() - true) < 0.1


@pytest.mark.parametrize("shared, often, own", [(40, 50, 200), (12, 30, 40), (8, 200, 150), (300, 1, 30)])
def test_uneven_counts_agree_as_often_as_texts_are_alike(shared, often, own):
    rng = np.random.default_rng(shared)
    met, agreed, trials, more = 0, 0.0, 60, often + often // 50
    for _ in range(trials):
        h = rng.integers(1, 2**63, shared + 2 * own, dtype=np.uint64)
        sides = [np.append(h[:shared], h[shared + k * own : shared + (k + 1) * own]) for k in (0, 1)]
        count = np.concatenate([np.append(np.full(shared, k), np.ones(own, int)) for k in (often, more)])
        weight = near_dup.Weights(np.zeros(0, np.uint64), np.zeros(0)).of(np.concatenate(sides), np.ones(len(count)))
        got = near_dup.samples(np.repeat([0, 1], shared + own), np.concatenate(sides), weight, 2, count=count)
        keys = near_dup.bands(got)
        met += bool((keys[0] == keys[1]).any())
        agreed += (got[0] == got[1]).mean() / trials
    true = shared * often / (shared * more + 2 * own)
    assert true >= near_dup.SIMILARITY
    assert abs(agreed - true) < 0.03
    assert met == trials


def test_near_duplicates_of_odd_rows(odd, empty):
    got = near_dup.classes(odd).select("doc_id", "class_id", "n_links").collect()
    assert len(got) == len(TEXTS)
    assert {r["class_id"] for r in got if r["doc_id"] in (5, 6)} == {5}
    assert {r["class_id"] for r in got if r["doc_id"] in (2, 3)} == {2}
    kept = near_dup.keep_one(odd)
    assert kept.dtypes == odd.dtypes
    assert Counter(r["text"] for r in kept.collect())[NOTE] == 1
    assert kept.count() == 11
    assert near_dup.classes(empty).count() == near_dup.keep_one(empty).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (20, 21), (21, 22), (20, 22)]
    df = spark.createDataFrame(links, "a long, b long").selectExpr("named_struct('s1', a, 's2', a) as a", "named_struct('s1', b, 's2', b) as b")
    got = {r["node"]["s1"]: r["root"]["s1"] for r in near_dup.components(df).collect()}
    assert {k: got.get(k, k) for k in (1, 2, 3, 4, 5, 7, 8, 9, 20, 21, 22)} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20, 22: 20}


# kernels


def test_words_against_brute_force():
    texts = [t or "" for _, t in TEXTS] + ["", "a", "b"]
    w = textkit.Words(*textkit.buffers(pa.array(texts)))
    assert w.count.tolist() == [len(words(t)) for t in texts]
    by = {}
    for h, x in zip(w.hashes.tolist(), itertools.chain.from_iterable(map(words, texts))):
        assert by.setdefault(x, h) == h
    assert len(set(by.values())) == len(by)


def test_sliding_minima():
    v = np.random.default_rng(1).integers(0, 2**63, 200, dtype=np.uint64)
    for w in (1, 2, 3, 7, 64):
        assert textkit.sliding_min(v, w).tolist() == [v[i : i + w].min() for i in range(len(v) - w + 1)]
