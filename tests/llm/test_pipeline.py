import collections

import pytest
from pyspark.sql import Row

from tarifa.llm import mixing, rules
from tests.conftest import SMALL
from tests.llm.conftest import LOWER, N_CLASHES, SCHEMA, words
from tests.llm.test_operators import brute_components, waterfall

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_against_brute_force(spark):
    from tarifa.session import ship

    ship(spark)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    rows = docs.collect()

    kept = stage["quality_rules"](spark, docs, SMALL).cache()
    want = [Row(**r.asDict() | {"text": t, "n_chars": len(t)}) for r in rows if rules.judge((r.text or "").encode())[-1] for t in [brute_clean(r.text)]]
    assert sorted(kept.collect()) == sorted(want) and kept.columns == docs.columns

    once = stage["exact_dedup"](spark, kept, SMALL).cache()
    last = {r.text.translate(LOWER): r.doc_id for r in sorted(want, key=lambda r: r.doc_id)}
    want = [r for r in want if last[r.text.translate(LOWER)] == r.doc_id]
    assert sorted(once.collect()) == sorted(want)

    apart = stage["near_dedup"](spark, once, SMALL).cache()
    found = brute_components({r.doc_id: r.text for r in want})
    want = [r for r in want if found[r.doc_id][1] == r.doc_id]
    assert sorted(apart.collect()) == sorted(want) and 0 < len(want) < len(rows)

    mixed = stage["mixing"](spark, apart, SMALL).cache()
    sizes = collections.Counter()
    for r in want:
        sizes[r.source] += len(words(r.text))
    target, taken, most = waterfall(sizes), collections.Counter(), collections.Counter()
    for r in mixed.collect():
        taken[r.source] += len(words(r.text))
        most[r.source] = max(most[r.source], len(words(r.text)))
    assert mixed.columns == docs.columns and all(abs(taken[s] - target[s]) <= max(len(words(r.text)) for r in want if r.source == s) for s in sizes)
    copies = {r.doc_id: r.copies for r in mixing.mix(apart).collect()}
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter({d: n for d, n in copies.items() if n})

    placed = stage["packing"](spark, mixed, SMALL).collect()
    assert collections.Counter(r.doc_id for r in placed if r.piece == 0) == collections.Counter(r.doc_id for r in mixed.collect())


def test_run_and_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, SMALL).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]


def awkward():
    """(doc_id, text, source): null, repeated and shared ids on exact copies, near copies and lone texts."""
    base = " ".join(f"w{i}" for i in range(120))
    near, other = base.replace("w60 ", "x60 "), " ".join(f"v{i}" for i in range(90))
    lone = {n: " ".join(f"{n}{i}" for i in range(70)) for n in "abc"}
    return [
        (None, base, "s"), (None, base.upper(), None), (3, base, "s"), (3, base, "s"), (3, near, "t"), (None, near, "t"),
        (5, other, "s"), (5, lone["a"], "t"), (9, other, "t"), (9, lone["b"], None), (9, lone["b"], None), (9, lone["b"], None),
        (None, lone["c"], "s"), (None, lone["c"], "t"), (7, None, "s"), (None, "", "s"),
    ]


def awkward_frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *["z"] * N_CLASHES) for i, t, s in rows], SCHEMA).repartition(3)


def test_exact_stage_keeps_one_row_a_text_whatever_the_ids(spark):
    from tarifa.session import ship

    ship(spark)
    rows = awkward()
    got = dict(corpus_pipeline.STAGES)["exact_dedup"](spark, awkward_frame(spark, rows), SMALL)
    assert got.columns == awkward_frame(spark, []).columns
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[(t or "").translate(LOWER)].append(-1 if i is None else i)
    assert sorted(((r.text or "").translate(LOWER), -1 if r.doc_id is None else r.doc_id) for r in got.collect()) == sorted((t, max(ids)) for t, ids in groups.items())


def test_near_stage_keeps_one_row_a_component_whatever_the_ids(spark):
    from tarifa.session import ship

    ship(spark)
    rows = awkward()
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, awkward_frame(spark, rows), SMALL)
    assert got.columns == awkward_frame(spark, []).columns
    found = brute_components({n: t for n, (_, t, _) in enumerate(rows)})
    groups = collections.defaultdict(list)
    for n, (i, _, _) in enumerate(rows):
        groups[found[n][1]].append(10**9 if i is None else i)
    kept = [(n, 10**9 if r.doc_id is None else r.doc_id) for r in got.collect() for n in [next(found[k][1] for k, x in enumerate(rows) if x[1] == r.text and x[0] == r.doc_id)] if r.text]
    assert sorted(kept) == sorted((n, min(ids)) for n, ids in groups.items() if rows[n][1])
    assert sum(not r.text for r in got.collect()) == sum(not t for _, t, _ in rows)


def test_mixing_stage_takes_each_row_as_the_mix_says_whatever_the_ids(spark):
    from tarifa.session import ship

    ship(spark)
    rows = awkward() + [(None, " ".join(["z"] * 400), "t"), (11, "one two", "u"), (11, "one two", "u"), (11, "three", "s"), (None, "one", "u")]
    docs = awkward_frame(spark, rows)
    want = collections.Counter()
    for r in mixing.mix(docs).where("size > 0").collect():
        want[r.doc_id, r.source, r.size] += r.copies
    mixed = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, SMALL)
    assert mixed.columns == docs.columns
    assert collections.Counter((r.doc_id, r.source, len(words(r.text))) for r in mixed.collect()) == +want


def test_sources_of_one_id_or_of_repeated_rows_come_near_their_targets(spark):
    rows = [(None, f"{'word ' * (i % 7 + 1)}{i}", "none") for i in range(300)] + [(5, "one two three", "again")] * 300 + [(i, "a b c d", "own") for i in range(300)]
    for parts in (1, 5):
        got = mixing.mix(awkward_frame(spark, rows).repartition(parts)).collect()
        for source, most in (("none", 8), ("again", 3), ("own", 4)):
            mine = [r for r in got if r.source == source]
            assert len(mine) == 300 and abs(sum(r.taken for r in mine) - mine[0].target) <= most
        mixed = mixing.repeated(awkward_frame(spark, rows).repartition(parts))
        assert collections.Counter(r.source for r in mixed.collect()) == collections.Counter(r.source for r in got for _ in range(r.copies))


@pytest.mark.parametrize("name", ["quality_rules", "exact_dedup", "near_dedup", "mixing", "packing"])
def test_stages_with_nulls_in_any_column_and_very_long_texts(spark, none, nulls, name):
    from tarifa.session import ship

    ship(spark)
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, none, SMALL).count() == 0
    rows = stage(spark, nulls, SMALL).collect()
    assert len(rows) == {"quality_rules": 0, "exact_dedup": 2, "near_dedup": 2, "mixing": 3, "packing": 4}[name]
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = awkward_frame(spark, [(1, long, "s"), (2, long.upper(), "s"), (3, "short", "t")])
    got = stage(spark, docs, SMALL)
    if name == "packing":
        assert sum(r.length for r in got.where("doc_id = 1").collect()) > 60_000
    else:
        assert max(len(r.text) for r in got.collect()) == len(long) and got.columns == docs.columns


def brute_clean(text):
    """The lines that don't fail, judged one by one as texts of their own."""
    return "\n".join(x for x in text.split("\n") if rules.judge(x.encode())[7] == 0)


def test_failing_lines_leave_the_text(spark, tmp_path):
    from tarifa.llm import stages
    from tarifa.session import ship

    ship(spark)
    good = "\n".join(" ".join(f"é{i}w{j}" for j in range(12)) for i in range(8))
    bars, odd, notice = "home | shop | cart | help", "#### **** $$$$ %%%%", "Accept all COOKIES"
    texts = [good, f"{bars}\n{good}\n\n{odd}\n \n{notice}", good.replace("\n", f"\n{notice}\r\n"), good + "\n", bars, "", None, f"{odd}\n" * 90 + good]
    docs = awkward_frame(spark, [(i % 3 or None, t, "s") for i, t in enumerate(texts)])
    got = collections.Counter(r.clean_text for r in rules.line_rules(docs).collect())
    assert got == collections.Counter(None if t is None else brute_clean(t) for t in texts)
    want = [(i % 3 or None, brute_clean(t)) for i, t in enumerate(texts) if t and rules.judge(t.encode())[-1]]
    kept = stages.quality_rules(docs)
    assert kept.columns == docs.columns and len(want) == 4
    assert collections.Counter((r.doc_id, r.text, r.n_chars) for r in kept.collect()) == collections.Counter((i, t, len(t)) for i, t in want)
    small = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = [brute_clean(t) for t in small if t and rules.judge(t.encode())[-1]]
    assert collections.Counter(r.text for r in stages.quality_rules(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()) == collections.Counter(want)
    assert sum(t not in small for t in want) == 3


def test_run_hands_on_clean_texts_and_leaves_only_its_result(spark, monkeypatch):
    from tarifa.llm import shared

    seen = {}
    last = lambda spark, docs, sf_dir: seen.setdefault("rows", docs.collect()) and docs
    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[:2], ("last", last)])
    before = shared.stored_paths()
    assert corpus_pipeline.run(spark, SMALL).count() == len(seen["rows"]) > 0
    assert all(r.text == brute_clean(r.text) for r in seen["rows"])
    assert len(shared.stored_paths() - before) == 1
