import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarifa.llm import chat, components, exact, jaccard, mixing, packing, pii, quality, registry, rules, substrings, tokens
from tests.conftest import SMALL
from tests.llm.conftest import LOWER, words

P = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(name, same, spark):
    from tarifa.session import ship

    ship(spark)
    same(registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 14))


def operators():
    return {
        "mix": mixing.mix, "score": lambda d: quality.score(d, quality.fit(np.zeros((0, quality.FEATURES), np.float32), np.zeros(1, int), np.zeros(0))), "jaccard": jaccard.jaccard_components, "pii": pii.find_personal,
        "exact": exact.exact_duplicates, "substrings": substrings.remove_repeats, "tokens": lambda d: tokens.token_counts(d, P.path("piece_bpe_32k.model")), "rules": rules.line_rules,
        "pack": lambda d: packing.pack(d, P.path("word_bpe_49k.json")),
    }


@pytest.mark.parametrize("name", sorted(operators()))
def test_empty_tables_and_nulls_in_any_column(name, none, nulls):
    assert operators()[name](none).count() == 0
    got = operators()[name](nulls).collect()
    assert sorted(str(r.doc_id) for r in got) == ["4", "4", "None", "None"]


# 1 mixing


def waterfall(sizes, most=3):
    """Targets by dealing out again what capped sources leave, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), [s for s in names if sizes[s]], float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        capped = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not capped:
            target.update({s: level * weight[s] for s in open_})
            break
        for s in capped:
            target[s] = float(most * sizes[s])
            left -= target[s]
            open_.remove(s)
    return target


def test_mix_meets_the_targets(odd):
    got = mixing.mix(odd).collect()
    size = {r.doc_id: len(words(r.text)) for r in odd.collect()}
    assert all(r.size == size[r.doc_id] and r.taken == r.copies * r.size and r.taken <= 3 * r.size for r in got)
    by_source = collections.Counter()
    for r in got:
        by_source[r.source] += r.size
    want = waterfall(by_source)
    for s in by_source:
        rows = [r for r in got if r.source == s]
        assert rows[0].target == pytest.approx(want[s]) and rows[0].source_size == by_source[s]
        assert abs(sum(r.taken for r in rows) - want[s]) <= max(r.size for r in rows)
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in mixing.mix(odd.repartition(2)).collect()}


# 2 quality


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50 and sum(r.predicted == r.quality for r in got) / len(got) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_training_is_bounded_and_reads_whole_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, before, labels: seen.append((len(x), np.diff(before).tolist(), labels.tolist())))
    word = lambda n: " ".join(f"w{i}" for i in range(n))
    ids = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 5][:12]
    docs = [(i, word(64 * 40), "x") for i in ids[:10]] + [(ids[0], "another text", "x"), (ids[10], None, "x"), (ids[11], word(70_000), "x"), (ids[11], word(70_000), "x"), (None, "lost", "x")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in ids] + [(ids[0], None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for parts in (1, 3):
        quality.train(docs.repartition(parts), labels, each=20)
        quality.train(docs.repartition(parts), labels, most_passages=100, each=20)
    assert seen[0] == seen[2] and seen[1] == seen[3]
    assert sorted(seen[0][1]) == [1, 1] + [20] * 11 and 0 < seen[1][0] <= 100


def test_the_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    before, labels = np.array([0, 3, 4, 9]), np.array([1.0, 0.0, 1.0])
    x = rng.normal(size=(9, 8))
    model = {"W": rng.normal(size=(8, 5)), "b": rng.normal(size=5), "V": rng.normal(size=(5, 4)), "U": rng.normal(size=(5, 4)), "a": rng.normal(size=4), "c": rng.normal(size=5), "d": np.zeros(1)}
    weight = np.array([0.5, 2.0, 1.0]) / 3
    loss = lambda m: -(weight * (labels * np.log(f := quality._forward(m, x, before)["score"]) + (1 - labels) * np.log(1 - f))).sum()
    for name, grad in quality.gradients(model, x, before, labels, weight).items():
        for at in np.ndindex(model[name].shape):
            more, less = ({k: v.copy() for k, v in model.items()} for _ in range(2))
            more[name][at] += 1e-6
            less[name][at] -= 1e-6
            assert grad[at] == pytest.approx((loss(more) - loss(less)) / 2e-6, abs=1e-6)


def test_attention_gradients():
    rng = np.random.default_rng(0)
    before = np.array([0, 3, 4, 9])
    x = rng.normal(size=(9, quality.FEATURES)).astype(np.float32)
    model = quality.fit(x, before, np.array([1.0, 0.0, 1.0]), epochs=40)
    scores = quality._forward(model, quality._standard(model, x), before)
    assert list(scores["score"] > 0.5) == [True, False, True]
    assert np.allclose(np.add.reduceat(scores["weight"], before[:-1]), 1)


# 3 n-gram Jaccard


def brute_components(texts):
    sets = {}
    for d, t in texts.items():
        w = words((t or "").translate(LOWER))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in texts}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def near_copies(n, seed=3):
    """A chain of edits: neighbours link, ends don't."""
    r = random.Random(seed)
    now = [f"v{r.randint(0, 999)}" for _ in range(120)]
    out = []
    for _ in range(n):
        out.append(" ".join(now))
        now = list(now)
        now[r.randrange(len(now))] = f"e{r.randint(0, 9999)}"
    return out


@pytest.mark.parametrize("block", [512, 3])
def test_jaccard_components(spark, odd, block):
    texts = {r.doc_id: r.text for r in odd.collect()} | {1000 + i: t for i, t in enumerate(near_copies(25))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, block=block).collect()}
    assert got == brute_components(texts)


@pytest.mark.parametrize("count_from", [20_000, 0])
def test_divide_skip_is_counting(count_from, monkeypatch):
    monkeypatch.setattr(jaccard, "COUNT_FROM", count_from)
    r = random.Random(1)
    for _ in range(300):
        lists = [sorted(r.sample(range(30), r.randint(1, 20))) for _ in range(r.randint(1, 12))]
        needed = r.randint(1, len(lists))
        counts = collections.Counter(x for one in lists for x in one)
        assert jaccard.divide_skip(lists, needed) == {k: v for k, v in counts.items() if v >= needed}
        assert list(jaccard.heap_skip(lists, needed)) == sorted((k, v) for k, v in counts.items() if v >= needed)


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 15)] + [(7, 7), (3, 2)]
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100 + i: 100 for i in range(15)}


# 4 personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n) for i, n in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute_personal(text):
    checks = {"email": lambda h, d: True, "ip": lambda h, d: all(int(x) <= 255 for x in h.split(".")), "card": lambda h, d: 13 <= len(d) <= 19 and luhn(d), "phone": lambda h, d: 9 <= len(d) <= 15}
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if checks[k](m[0], re.sub("[^0-9]", "", m[0]))]


def test_personal_data(spark):
    r = random.Random(2)
    bits = ["a@b.com", "_x@c.d", "1.2.3.4", ".5.6", "0000255.1.1.1", "300.1.1.1", "4111 1111 1111 1111", "-4111-1111-1111-1111", "4952935900253052", "+1 (743) 555-3824", "+1", "é😀", " ", "\n", "@", "x" * 30, "9" * 25]
    texts = [None, "", "a" * 20000 + "@", "9" * 20000, "a@" * 5000, "+(" * 3000, "contact ti token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""] + ["".join(r.choice(bits) for _ in range(r.randint(1, 12))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii.find_personal(docs).collect():
        want = brute_personal(texts[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert row.spans.split(",")[: len(want)] == want or not want
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s.startswith(k) for s in want) for k in PATTERNS]


def test_further_spans_are_those_that_were_planted(spark):
    r = random.Random(8)
    prose = lambda n: " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 26))) for _ in range(n))
    key = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    made = {
        "secret": lambda: ('token = "', key()), "iban": lambda: ("transfer to account ", "DE89 3704 0044 0532 0130 00"), "ssn": lambda: ("social security ", f"{r.randint(100, 600)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"),
        "birth": lambda: ("born on ", f"19{r.randint(10, 99)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}"), "name": lambda: ("Dear ", "Mr. John Smith"), "address": lambda: ("lives at ", f"{r.randint(1, 900)} Old Mill Road"),
    }
    texts, want = [], {}
    for i in range(240):
        text = prose(10)
        if i % 2:
            kind = sorted(made)[i // 2 % 6]
            cue, value = made[kind]()
            want[i] = f"{kind}:{len(text) + 1 + len(cue)}:{len(text) + 1 + len(cue) + len(value)}"
            text = f"{text} {cue}{value}\" {prose(10)}"
        texts.append(f"{text}, 9870157079875996 12-34 999.1.1.1 x")
    rows = pii.find_personal(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {r.doc_id: r.spans for r in rows if r.spans}
    assert found == want and all(r.n_spans == (r.doc_id in want) for r in rows)


def test_a_further_span_that_touches_a_base_span_is_dropped(spark):
    secret = "ab12" * 6
    texts = [f'token = "{secret}"'] * 30 + [f'token = "{secret}@mail.com"', f'token = "{secret}" a@b.com', f"{secret}@{secret}.com"]
    got = {r.doc_id: r.spans for r in pii.find_personal(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == "secret:9:33" and got[30] == "email:9:42" and got[31] == "email:35:42,secret:9:33" and got[32] == "email:0:53"


def test_many_spans_in_one_text_take_time_in_proportion(spark):
    import time

    took = []
    for n in (1_000, 30_000):
        docs = spark.createDataFrame([(1, " ".join(f"u{i}@mail.com 10.0.0.{i % 300}" for i in range(n)))], "doc_id long, text string")
        began = time.time()
        row = pii.find_personal(docs).first()
        took.append(time.time() - began)
        assert row.n_email == n and row.n_ip == sum(i % 300 < 256 for i in range(n))
    assert took[1] < 30 * took[0] + 10


def test_reliabilities_follow_the_votes():
    prior, tables = pii.reliabilities({"++0": 80, "+-0": 5, "--0": 100, "-+0": 5, "000": 3})
    assert pii.posterior("++0", prior, tables) > 0.9 > 0.1 > pii.posterior("--0", prior, tables)


# 5 exact dedup


def test_directory_splits_what_is_overfull():
    buckets = exact.directory({0: 10, 1: 10, 2: 1, 15: 50}, 12, 4)
    assert len(buckets) == 16 and list(buckets) == sorted(buckets)
    assert buckets[0] != buckets[1] and buckets[8] == buckets[11] and buckets[14] != buckets[15]


def test_a_collision_is_chained():
    import pyarrow as pa

    rows = [(0, 5, "s1", b"x", 1, 1), (0, 5, "s2", b"y", 2, 1), (0, 5, "s1", b"x", 9, 2), (0, 6, "s3", b"x", 3, 1)]
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["slot", "key", "text_sha256", "text", "keep_id", "group_size"])
    out = [tuple(x.values()) for b in exact._owned(iter([batch.slice(0, 2), batch.slice(2)])) for x in b.to_pylist()]
    assert out == [(0, 5, 0, "s1", 9, 3), (0, 5, 1, "s2", 2, 1), (0, 6, 0, "s3", 3, 1)]


def test_directory_doubles_until_nothing_is_overfull(spark):
    r = random.Random(6)
    sizes = {r.randint(-(2**63), 2**63 - 1): r.randint(1, 9) for _ in range(60)} | {(5 << 58) + i: 9 for i in range(8)} | {77: 500}
    found = exact.buckets(spark.createDataFrame(list(sizes.items()), "key long, bytes long"), bucket_bytes=20, level=4)
    assert len(found) > 2  # beyond one level
    held = collections.Counter()
    for key, size in sizes.items():
        at = [r for fine, table in found for r in table.where(f"slot = {key >> (64 - fine)}").collect()][-1]
        assert not at.overfull and at.first <= key < at.first + (1 << (64 - at.local))
        held[at.first, at.local] += size
    spans = sorted((first, first + (1 << (64 - local))) for first, local in held)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert all(n <= 20 or sum(k >= f and k < f + (1 << (64 - d)) for k in sizes) == 1 for (f, d), n in held.items())


@pytest.mark.parametrize("hot, bits, level", [(10_000, 28, 16), (1, 9, 4)])
def test_exact_duplicates(odd, hot, bits, level, monkeypatch):
    """With few bits, texts of single rows travel too."""
    monkeypatch.setattr(exact, "HOT_GROUP", hot)
    monkeypatch.setattr(exact, "LEAST_BITS", min(bits, 16))
    monkeypatch.setattr(exact, "MOST_BITS", bits)
    texts = {r.doc_id: (r.text or "").translate(LOWER) for r in odd.collect()}
    by_text = collections.defaultdict(list)
    for d, t in texts.items():
        by_text[t].append(d)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_duplicates(odd, bucket_bytes=1000, level=level).collect()}
    assert got == {d: (max(by_text[t]), len(by_text[t]), d == max(by_text[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in texts.items()}


def test_every_shared_key_has_its_bit_and_few_others_do(spark):
    r = random.Random(7)
    keys = [r.randint(-(2**63), 2**63 - 1) for _ in range(3000)] + [-1, 0, 2**63 - 1, -(2**63)]
    bits, marks = exact.shared_keys(spark.createDataFrame([(k,) for k in keys], "key long"))
    has = lambda k: bool(marks[(s := k % (1 << 64) >> (64 - bits)) >> 3] >> (7 - (s & 7)) & 1)
    assert bits == 16 and all(map(has, keys))
    assert sum(has(r.randint(-(2**63), 2**63 - 1)) for _ in range(4000)) < 4000 * 0.08
    assert exact.shared_keys(spark.createDataFrame([], "key long"))[1].sum() == 0


# 6 chat


def test_render_finds_spans_and_rewrites():
    turns = [("user", "\\### Assistant: </turn> ok"), ("assistant", " x </turn>\\h"), ("a:b", ""), ("assistant", "")]
    done = chat.render(turns)
    assert chat.read_back(done.text) == turns and not done.rewritten
    assert [chat.unescape(done.text[a:b]) for a, b in done.loss_spans] == [" x </turn>\\h", ""]
    assert "".join(done.text[a:b] for a, b in done.turn_spans) == done.text
    rewriting = lambda t: f"{len(t)} turns\n" + chat.template(t)
    assert chat.render(turns[:2], rewriting).rewritten == [1]


def test_conversations_with_nulls_and_ties(spark, none):
    rows = [(1, 1, "user", "b", "z"), (1, 1, "user", "a", "z"), (1, None, None, None, "z"), (None, 0, "assistant", "x", "z"), (2, 0, "assistant", "é😀", "z")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.format_conversations(frame).collect()}
    assert chat.read_back(got[1].formatted) == [("", ""), ("user", "a"), ("user", "b")]
    assert (got[2].loss_chars, got[2].loss_sha256) == (2, hashlib.sha256("é😀".encode()).hexdigest())
    assert got[None].n_turns == 1
    assert chat.format_conversations(frame.limit(0)).count() == 0


# 7 suffixes


def test_loser_tree_merges_and_knows_the_common_prefixes():
    import os

    r = random.Random(0)
    for _ in range(400):
        made = [sorted(bytes(r.choice(b"ab\0") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 7))) for _ in range(r.randint(1, 9))]
        runs = [(s, [0] + [len(os.path.commonprefix([a, b])) for a, b in zip(s, s[1:])]) for s in made]
        order, index, common = substrings.merge(runs)
        out = [runs[a][0][b] for a, b in zip(order, index)]
        assert out == sorted(x for s in made for x in s)
        assert common == [0] + [len(os.path.commonprefix([a, b])) for a, b in zip(out, out[1:])]


def test_remove_repeats(spark, odd):
    x = "The quick brown fox jumps over the lazy dog and runs away into the deep dark woods."
    more = ["zz" + x[:50] + "q", x, x[:49], x[10:] + x[10:], "a" * 200, "a" * 120, "b" + "a" * 60 + "\0\0", "é" * 100, "x" + "é" * 40]
    texts = {r.doc_id: r.text for r in odd.collect()} | {1000 + i: t for i, t in enumerate(more)}
    raw = {d: (t or "").encode() for d, t in texts.items()}
    least = {}
    for d in sorted(raw):
        for i in range(len(raw[d]) - 49):
            least.setdefault(raw[d][i : i + 50], d)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    for row in substrings.remove_repeats(docs).collect():
        text = raw[row.doc_id]
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - 49):
            if least[text[i : i + 50]] < row.doc_id:
                gone[i : i + 50] = True
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        assert (row.n_bytes, row.n_removed, row.n_spans, bytes(row.kept)) == (len(text), int(gone.sum()), spans, kept)
        assert row.kept_sha256 == hashlib.sha256(kept).hexdigest()


# 8 tokens


def test_token_counts_are_the_library_s(spark, odd):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    machine = tokens.Transducer(P.path("piece_bpe_32k.model"))
    r = random.Random(1)
    pool = "  aab  \n\tthe ing.,!?▁é中国人民日本語 😀zz==--**__<s>"
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(1500)] + [" " * k for k in range(40)] + ["-" * 1500, "中国" * 900, "<s> hi </s><0x0A>"]
    assert list(machine.counts(texts)) == [len(x) for x in library.encode(texts)]
    for row in tokens.token_counts(odd, P.path("piece_bpe_32k.model"), limit=100).join(odd.select("doc_id", "text"), "doc_id").collect():
        assert (row.n_bytes, row.n_tokens) == (len((row.text or "").encode()), len(library.encode(row.text or "")))
        assert row.over_limit == (row.n_tokens > 100)


def test_chunks_without_a_reset_wait_for_the_one_before(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(tokens, "CHUNK", 7)
    machine = tokens.Transducer(P.path("piece_bpe_32k.model"))
    texts = ["international" * 9, "中国人民" * 20 + " ok", "a b", "thequickbrownfox jumped"]
    assert list(machine.counts(texts)) == [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")).encode(texts)]


# 9 rules


def test_line_rules(odd):
    for row in rules.line_rules(odd).join(odd.select("doc_id", "text"), "doc_id").collect():
        w = words(row.text)
        windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (row.text or "").split("\n") if words(x)]
        assert (row.n_words, row.word_chars, row.n_repeat_words, row.n_dup_lines) == (len(w), sum(map(len, w)), len(inside), len(lines) - len(set(lines)))
        assert row.n_symbols == sum(c in "#*$%&|<>" for c in row.text or "")
        assert row.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w))
        assert not (row.kept and row.base_failed)


def test_lines_that_fail():
    prose = ("Some plain words stand here. " * 3 + "\n") * 1
    for bad in ("Home | News | Shop | Help", "a### b*** c&&& d$$$ e%%%", "All rights reserved."):
        assert rules.judge((prose + bad).encode())[7] == 1
    assert rules.judge(prose.encode())[7] == 0


# 10 packing


def test_packing_is_gapless_and_tight(spark, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    got = packing.pack(odd, P.path("word_bpe_49k.json"), size=256).collect()
    pieces = collections.defaultdict(dict)
    for r in got:
        pieces[r.doc_id][r.piece] = r
    for d, t in texts.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for n, at in enumerate(range(0, len(ids), 256)):
            r, part = pieces[d][n], ids[at : at + 256]
            assert (r.start, r.length, r.ids_crc32) == (at, len(part), zlib.crc32(part.tobytes()))
        assert len(pieces[d]) == -(-len(ids) // 256)
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for rows in by_sequence.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by_sequence) <= -(-sum(r.length for r in got) // 256) * 1.1 + 1


def test_remembered_words_give_the_library_s_ids(monkeypatch):
    from tokenizers import Tokenizer

    own, tokenizer = packing.Words(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    r = random.Random(2)
    pool = ["the", "cat's", "don't", "<|endoftext|>", "é", "é", "İstanbul", "ΣΑΣ", "12", "3.4", ".", ",", "a.", "b,", "　", "́", "日本", "中.", "ﬁ", "😀", "I'll", "to%%%", "Ünd,###", "a<|endoftext|>", "x<|", "b'll", "()", ").", "\x1c", "\x85", "Straße", "naïve,"]
    texts = ["".join(r.choice(pool) + r.choice(["", " ", "\n"]) for _ in range(r.randint(0, 12))) for _ in range(1500)]
    want = [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(own, texts) == want
    monkeypatch.setattr(packing, "GENERATION_BYTES", 2_000)  # generations come and go
    monkeypatch.setattr(packing, "LONGEST", 3)
    assert [x for i in range(0, 1500, 7) for x in ids_of(own, texts[i : i + 7])] == want


def ids_of(own, texts):
    raw = [t.encode() for t in texts]
    ids, before = own.ids(np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8))
    return [ids[a:b].tolist() for a, b in zip(before, before[1:])]


def test_another_tokenizer_gets_whole_texts():
    from tokenizers import Tokenizer

    file = P.path("byte_bpe_50k.json")
    texts = ["", "a b", "the  cat\nsat", "é 😀 x"]
    assert ids_of(packing.Words(file), texts) == [x.ids for x in Tokenizer.from_file(file).encode_batch(texts, add_special_tokens=False)]


def test_packed_ids_make_up_the_sequences(spark, odd):
    got = packing.pack(odd, P.path("word_bpe_49k.json"), size=256, group=20, ids=True).collect()
    plain = packing.pack(odd, P.path("word_bpe_49k.json"), size=256, group=20).collect()
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    assert collections.Counter((r.doc_id, r.piece, r.length) for r in got) == collections.Counter((r.doc_id, r.piece, r.length) for r in plain)


def test_repeated_rows_are_dealt_over_groups(spark):
    docs = spark.createDataFrame([(7, "one two three", i) for i in range(400)], "doc_id long, text string, row int")
    got = packing.pack(docs, P.path("word_bpe_49k.json"), size=64, group=50).collect()
    assert len(got) == 400 and len({r.sequence_id >> 32 for r in got}) == 8


def test_sum_of_squares_takes_the_least_sum():
    r = random.Random(4)
    for _ in range(60):
        size, lengths = 12, [r.randint(1, 12) for _ in range(25)]
        sequence, _ = packing.sum_of_squares(np.array(lengths), size)
        rooms: dict[int, int] = {}
        for n, length in zip(sequence.tolist(), lengths):
            best = min(
                (sum(v * v for v in collections.Counter(x for x in {**rooms, k: room - length}.values() if x).values()) for k, room in [*rooms.items(), (-1, size)] if room >= length),
            )
            rooms[n] = rooms.get(n, size) - length
            assert rooms[n] >= 0
            assert sum(v * v for v in collections.Counter(x for x in rooms.values() if x).values()) == best
