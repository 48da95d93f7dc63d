"""Ranked search, toxicity and the divergence audit against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest

from tarifa.llm import divergence, search, terms, toxicity
from tests.llm.conftest import LOWER, N_CLASHES, SCHEMA

TERM, LETTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def found(pattern, text):
    return re.findall(pattern, (text or "").translate(LOWER))


def table(spark, rows):
    """documents of (doc_id, text, lang, source), with columns whose names clash."""
    return spark.createDataFrame([(*r, 0, *["z"] * N_CLASHES) for r in rows], SCHEMA).repartition(3)


# terms


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_terms_are_the_maximal_matches(block, monkeypatch):
    monkeypatch.setattr(terms, "BLOCK_BYTES", block)
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice("aZ09 _-\0\x1c\x85 éΣİ 👍\x7f[`{@/:") for _ in range(r.randint(0, 40)))
        for pattern, kept in ((TERM, terms.ALPHANUMERIC), (LETTER, terms.LETTERS)):
            assert [w.decode() for words in terms.split(text.encode(), kept) for w in words] == found(pattern, text)


# 11 search


def brute_ranked(docs, items, k):
    """Rows (item_id, rank, score) and, for scores that no other document has, the doc_id."""
    sized = [(doc_id, collections.Counter(found(TERM, text))) for doc_id, text in docs]
    sized = [(d, c, c.total()) for d, c in sized if c]
    documents, total = len(sized), sum(n for *_, n in sized)
    out = []
    for item_id, text in {(i, (t or "").translate(LOWER)) for i, t in items}:
        scores = []
        for doc_id, counts, n in sized:
            score = 0
            for term in set(found(TERM, text)):
                if tf := counts[term]:
                    df = sum(term in c for _, c, _ in sized)
                    score += math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) * ((10**9 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // total)))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("fan, shard, block", [(16, 4096, 2_000_000), (2, 3, 40), (3, 1, 200)])
def test_ranked_is_brute_force(spark, fan, shard, block, monkeypatch):
    """Few words, so many ties; null ids and texts, repeated rows and items, texts under one id, items without terms."""
    for name, value in (("FAN", fan), ("SHARD_DOCS", shard), ("BLOCK_CHARS", block)):
        monkeypatch.setattr(search, name, value)
    r = random.Random(3)
    prose = lambda n: " ".join(r.choice(["Alpha", "beta", "é1", "γ", "the", "x9"] + [f"w{i}" for i in range(12)]) for _ in range(n))
    docs = [(r.choice([i, i, None]), r.choice([prose(r.randint(1, 12))] * 8 + [None, "", "--"]), "en", "a") for i in range(60)]
    docs += docs[:15] + [(r.randint(0, 5), "alpha beta", "en", "b") for _ in range(12)] + [(99, prose(4000), "en", "c")]
    items = [(i, prose(r.randint(1, 5))) for i in range(6)] + [(0, "gamma the"), (0, "THE gamma"), (None, "alpha"), (7, None), (8, "...")]
    items += items[:2]
    asked = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, rank string")
    got = [tuple(x) for x in search.ranked(table(spark, docs), asked, 4).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=str) == brute_ranked([d[:2] for d in docs], items, 4)


def test_search_over_empty_tables(spark, none, nulls):
    items = spark.createDataFrame([(1, "text")], "item_id long, text string")
    assert search.ranked(none, items).count() == 0
    assert search.ranked(nulls, items.limit(0)).count() == 0
    assert search.ranked(nulls, spark.createDataFrame([(None, None)], "item_id long, text string")).count() == 0
    assert [r.doc_id for r in search.ranked(nulls, items).orderBy("rank").collect()] == [4, 4, None]


def test_bounds_hold_and_few_ranges_are_opened():
    """Every node's bound is at least each score below it; with a floor, the search opens a small part of the tree."""
    r = np.random.default_rng(5)
    n = 2000
    document = np.repeat(np.arange(n), 6)
    pairs = np.unique(np.stack([r.integers(0, 300, len(document)), document]), axis=1)
    tree = search.Tree(pairs[1], pairs[0], r.integers(1, 1000, pairs.shape[1]), n)
    asked, weights = np.sort(r.choice(300, 8, replace=False)), r.integers(1, 5000, 8)
    scores = tree.bounds(0, 0, n, asked, weights)
    for level in range(1, len(tree.levels)):
        bounds = tree.bounds(level, 0, tree.sizes[level], asked, weights)
        assert (bounds[np.arange(n) // search.FAN**level] >= scores).all()
    best = search.Best(5, int(np.sort(scores)[-5]))
    best.ids, opened = list(range(n)), []
    bounds = tree.bounds
    tree.bounds = lambda level, first, *rest: opened.append(first) or bounds(level, first, *rest)
    tree.search(asked, weights, best)
    expected = sorted(range(n), key=lambda d: (-scores[d], d))[:5]
    assert sorted((-s, -d) for s, d in best.heap) == [(-int(scores[d]), d) for d in expected]
    assert len(opened) < 0.6 * sum(tree.sizes[1:])


# 12 toxicity


def test_gradients_of_the_factorization_machine():
    r = np.random.default_rng(2)
    bags = [np.array([0, 2, 3]), np.array([], int), np.array([1, 2]), np.array([4])]
    at, ends, labels = np.concatenate(bags).astype(int), np.cumsum([len(b) for b in bags]), np.array([1.0, 0, 0, 1])
    model = {"b": 0.1, "w": r.normal(0, 1, 5), "v": r.normal(0, 1, (5, 3))}

    def loss(m):
        logit = [m["b"] + m["w"][b].sum() + sum(m["v"][i] @ m["v"][j] for i in b for j in b if i < j) for b in bags]
        return float(np.mean([np.log1p(np.exp(-x if y else x)) for x, y in zip(logit, labels)]))

    grads = toxicity.gradients(model, at, ends, labels)
    for name in model:
        flat = np.ravel(model[name])
        for i in range(flat.size):
            moved = [dict(model), dict(model)]
            for m, step in zip(moved, (1e-5, -1e-5)):
                x = np.array(model[name], float).ravel()
                x[i] += step
                m[name] = x.reshape(np.shape(model[name])) if np.shape(model[name]) else float(x[0])
            assert np.ravel(grads[name])[i] == pytest.approx((loss(moved[0]) - loss(moved[1])) / 2e-5, abs=1e-6)


def test_pairs_are_learned_that_no_sum_of_weights_can_tell(spark):
    """Toxic is an insult with a group, neither alone: exclusive-or of the two words would also need their product."""
    r = random.Random(4)
    rows, labels = [], []
    for i in range(1200):
        one, two = r.random() < 0.5, r.random() < 0.5
        text = [r.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) for _ in range(r.randint(3, 30))] + ["vermin"] * one + ["foreigners"] * two
        r.shuffle(text)
        rows.append((i, " ".join(text), "en", "a"))
        labels.append((i, int(one == two), 1))
    known = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    docs = table(spark, rows)
    out = toxicity.score(docs, toxicity.train(docs, known), 0.5).join(known, "doc_id").where("held_out")
    assert out.count() > 200
    assert out.where("predicted = toxic").count() / out.count() > 0.97


def test_toxicity_on_held_out_rows(spark, same):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = toxicity.query(spark, folder)
    assert out.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = out.where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(x.toxic, x.predicted): x["count"] for x in held}
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.8
    assert n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.02


def brute_scores(model, texts):
    out = []
    for text in texts:
        own = sorted({model["wanted"][f] for w in set(found(LETTER, text)) for f in toxicity.hashed(w.encode()) if f in model["wanted"]})
        pairs = sum(float(model["v"][i] @ model["v"][j]) for n, i in enumerate(own) for j in own[n + 1 :])
        out.append(1 / (1 + math.exp(-(model["b"] + model["w"][own].sum() + pairs))))
    return out


def test_scores_are_brute_force(spark, odd, nulls, none, monkeypatch):
    labels = spark.createDataFrame([(i * 3, i % 2) for i in range(60)] + [(None, 1), (3, None), (3, 0), (3, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    assert model["wanted"]
    for known in (toxicity.MOST_KNOWN, 3):
        monkeypatch.setattr(toxicity, "MOST_KNOWN", known)
        rows = odd.select("doc_id", "text").collect()
        got = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
        for row, expected in zip(rows, brute_scores(model, [r.text for r in rows])):
            assert got[row.doc_id] == pytest.approx(expected, abs=1e-9)
    assert toxicity.score(none, model).count() == 0
    out = toxicity.score(nulls, model).collect()
    assert sorted(str(r.doc_id) for r in out) == ["4", "4", "None", "None"] and {r.held_out for r in out if r.doc_id is None} == {False}
    for some, known in ((none, labels), (odd, labels.limit(0)), (odd, labels.where("toxic = 1"))):
        base = toxicity.score(odd, toxicity.train(some, known))
        assert base.selectExpr("count(DISTINCT score)").first()[0] == 1


def test_training_reads_whole_texts_and_is_bounded(spark):
    late = "word " * 30_000
    docs = table(spark, [(i, late + ("vile" if i % 2 else "fine"), "en", "a") for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels), 0.5)
    assert out.join(labels, "doc_id").where("predicted != toxic").count() == 0
    few = toxicity.train(docs, labels, most=7, most_features=2)
    assert len(few["wanted"]) <= 2


# 13 divergence


def brute_audit(docs, least, most):
    rows = [((lang or ""), (source or ""), found(LETTER, text)) for _, text, lang, source in docs]
    groups, held, times = {(lang, s) for lang, s, _ in rows}, collections.Counter(), collections.defaultdict(collections.Counter)
    for lang, source, words in rows:
        held.update((lang, w) for w in set(words))
        times[lang, source].update(words)
    out = []
    for lang in {x for x, _ in groups}:
        kept = [w for (x, w), n in held.items() if x == lang and n >= least]
        own = {s: times[lang, s] for x, s in groups if x == lang}
        whole = sum(own.values(), collections.Counter())

        def shares(c, kept=kept):
            size = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 5) // (size + 5 * len(kept)) for w in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares(whole)
        for s in own:
            parts = {"pair": [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode()) for o in own if o != s]}
            parts["term"] = [(q[w] - p[s][w], w.encode()) for w in kept if own[s][w] and p[s][w] > q[w]]
            for part, values in parts.items():
                out += [(lang, s, part, item.decode(), -v, n) for n, (v, item) in enumerate(sorted(values), 1) if part == "pair" or n <= most]
    return sorted(out)


@pytest.mark.parametrize("bits, held, few", [(16, 400_000, 100_000), (8, 5, 0)])
def test_audit_is_brute_force(spark, bits, held, few, monkeypatch):
    """With few cells the sketch lets nearly all through; with few counters tasks pass on parts; without broadcasts joins are shuffled."""
    for name, value in (("LEAST_BITS", bits), ("MOST_BITS", max(bits, 10)), ("HELD", held), ("BROADCAST_ROWS", few), ("RANGES", 8)):
        monkeypatch.setattr(divergence, name, value)
    r = random.Random(6)
    pools = {"en": ["the", "The", "é", "of", "a1b"] + [f"w{chr(97 + i)}" for i in range(20)], "de": ["der", "die", "ß"] + [f"v{chr(97 + i)}" for i in range(20)], None: ["x", "y"], "": ["x", "z"], "xx": ["rare"]}
    docs = []
    for i in range(300):
        lang = r.choice(["en", "en", "de", None, ""])
        text = r.choice([" ".join(r.choice(pools[lang]) for _ in range(r.randint(1, 25)))] * 9 + [None, "12 34"])
        docs.append((i, text, lang, r.choice(["s1", "s1", "s2", None, "", "ü"])))
    docs += docs[:20] + [(1, "rare", "xx", "a"), (2, None, "xx", "b"), (3, "the " * 30_000, "en", "s9"), (4, None, "en", "silent")]
    got = sorted(tuple(x) for x in divergence.audit(table(spark, docs), 12, 5).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute_audit(docs, 12, 5)


def test_audit_of_odd_tables(spark, odd, none, nulls):
    assert divergence.audit(none).count() == 0
    assert divergence.audit(nulls).count() == 0
    rows = [tuple(r) for r in odd.select("doc_id", "text", "lang", "source").collect()]
    assert sorted(tuple(x) for x in divergence.audit(odd, 2).select("lang", "source", "part", "item", "value", "rank").collect()) == brute_audit(rows, 2, 50)


def test_the_sketch_never_counts_too_little(spark):
    docs = spark.createDataFrame([("en", f"common {'some' if i < 5 else ''} own{chr(97 + i % 26)}x{chr(97 + i // 26)}") for i in range(60)], "lang string, text string").repartition(4)
    for least in (1, 5, 60, 61):
        bits, full = divergence.sketch(docs, least)
        cells = divergence._cells([b"common", b"some", b"ownaxa", b"missing"], "en", bits)
        able = (full[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).all(0).tolist()
        assert able == [least <= 60, least <= 5, least <= 1, False]
