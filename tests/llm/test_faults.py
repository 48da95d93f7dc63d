"""Rows that operators once took for others: colliding digests, one id and text in two sources, columns without an order, runs side by side."""

import hashlib
import random
import threading
import zlib

import xxhash
from pyspark.sql import functions as F

from tarifa.llm import components, jaccard, mixing, shared, stages, substrings
from tests.llm.test_operators import brute_components, near_copies

X = "The quick brown fox jumps over the lazy dog and runs away into the deep dark woods."


def colliding():
    """A text that holds X, and a short one without it, of one CRC-32."""
    spread = lambda i: hashlib.md5(str(i).encode()).hexdigest()  # noqa: E731  plain numbers' sums don't meet
    seen = {zlib.crc32(f"{X} {spread(i)}".encode()): i for i in range(200_000)}
    return next((f"{X} {spread(seen[c])}", spread(-i)) for i in range(1, 1_000_000) if (c := zlib.crc32(spread(-i).encode())) in seen)


def test_texts_without_ids_that_share_a_crc_are_told_apart(spark):
    long, short = colliding()
    assert zlib.crc32(long.encode()) == zlib.crc32(short.encode())
    docs = spark.createDataFrame([(1, X), (None, long), (None, short), (None, None), (None, "")], "doc_id long, text string").repartition(3)
    got = sorted((r.n_bytes, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs).collect())
    rest = hashlib.sha256(long[len(X) :].encode()).hexdigest()
    whole = {t: (len(t), 0, hashlib.sha256(t.encode()).hexdigest()) for t in (X, short, "")}
    assert got == sorted([whole[X], whole[short], whole[""], whole[""], (len(long), len(X), rest)])


def test_the_print_of_a_text_is_the_same_in_python(spark):
    texts = ["", "a", "é" * 40, X, X * 20, "\0", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64(F.coalesce("t", F.lit(""))).alias("p")).collect()
    for r in rows:
        assert r.p % (1 << 64) == xxhash.xxh64_intdigest((r.t or "").encode(), 42)


def test_a_mix_doesn_t_depend_on_the_order_of_its_rows(spark):
    rows = [(i, f"words of a text {i}" * (1 + i % 2), s) for i in range(1, 6) for s in ("A", "B", None)] + [(1, "words of a text 1" * 2, "A")] * 4
    runs = []
    for order, parts in ((rows, 1), (rows[::-1], 5), (rows[7:] + rows[:7], 3)):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string").repartition(parts)
        runs.append(sorted((r.doc_id, str(r.source), r.taken) for r in mixing.mix(docs).collect()))
        copies = mixing.repeated(docs).groupBy("doc_id", "source").count().collect()
        taken = {}
        for doc_id, source, words in runs[-1]:
            taken[doc_id, source] = taken.get((doc_id, source), 0) + words
        size = {(d, str(s)): len(t.split()) for d, t, s in rows}
        assert {(r.doc_id, str(r.source)): r["count"] * size[r.doc_id, str(r.source)] for r in copies} == {k: v for k, v in taken.items() if v}
    assert runs[0] == runs[1] == runs[2]


def test_stages_take_columns_of_any_type(spark):
    text = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate([text, text, text + " end", None])] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("more", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("deep", F.array(F.create_map(F.lit("k"), F.lit(1))))
    for stage, kept in ((stages.quality_rules, 6), (stages.exact_duplicates, 3), (stages.near_duplicates, 3), (stages.mixture, 6)):
        out = stage(docs)
        assert out.columns == docs.columns and out.count() == kept, stage
        assert out.where("doc_id IS NOT NULL AND more['k'] <> doc_id").count() == 0


def test_runs_in_two_threads_don_t_remove_each_other_s_tables(spark):
    mine = shared.stored(spark.range(3), "mine")

    def other():
        shared.stored(spark.range(5), "theirs")
        shared.remove_stored(spark)

    thread = threading.Thread(target=other)
    thread.start()
    thread.join()
    assert mine.count() == 3


def test_rows_are_counted_as_a_table_is_stored(spark):
    table = shared.stored(spark.range(7), "counted", even=F.count_if(F.col("id") % 2 == 0))
    assert shared.seen(table) == {"rows": 7, "even": 4}
    assert shared.seen(shared.stored(spark.range(7).where("id > 9"), "counted", least=F.min("id"))) == {"rows": 0, "least": None}
    assert shared.seen(shared.stored(table.join(table, "id").where("id > 9").distinct(), "counted")) == {"rows": 0}


def test_small_tables_are_joined_without_jobs_that_count_them(spark, odd):
    """Each job leaves garbage in the driver: the stage of near copies ran 92 jobs over sf0.01 when each small table was counted anew."""
    docs, context = odd.select("doc_id", "text"), spark.sparkContext
    context.setJobGroup("near", "near copies")
    try:
        stages.near_duplicates(docs).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(context.statusTracker().getJobIdsForGroup("near")) <= 75


def test_the_driver_gives_back_what_finished_jobs_have_left(spark, monkeypatch):
    given = []
    monkeypatch.setattr(shared, "release", given.append)
    for _ in range(2 * shared.RELEASED_AFTER):
        shared.stored(spark.range(1), "garbage")
    assert len(given) == 2


def tasks_of(spark, run):
    """What run() gives, and how many tasks it took with 64 partitions to a shuffle, none of which Spark joins."""
    context, held = spark.sparkContext, {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, group = {k: spark.conf.get(k) for k in held}, f"tasks-{random.random()}"
    for k, v in held.items():
        spark.conf.set(k, v)
    context.setJobGroup(group, "tasks counted")
    try:
        out = run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    tracker = context.statusTracker()
    stages_of = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    return out, sum(x.numCompletedTasks for s in stages_of if (x := tracker.getStageInfo(s)))


def test_rounds_over_few_edges_take_few_tasks(spark):
    """A round's tables hold few rows; written in as many files as a shuffle has partitions, they took most of op3's time on check_h."""
    edges = shared.stored(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 95)], "a long, b long"), "links")
    found, tasks = tasks_of(spark, lambda: components.components(edges, 41).collect())
    assert {r.id: r.root for r in found} == {i: 0 for i in range(41)} | {90: 90, 95: 90}
    assert 0 < tasks <= 300


def test_a_second_round_of_links_starts_from_the_components_of_the_first(spark, monkeypatch):
    rows, plain = {}, jaccard.stored

    def stored(df, name, **more):
        table = plain(df, name, **more)
        rows.setdefault(name, []).append(shared.seen(table)["rows"])
        return table

    monkeypatch.setattr(jaccard, "stored", stored)
    texts = dict(enumerate(near_copies(120, 5)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found, tasks = tasks_of(spark, lambda: jaccard.jaccard_components(docs, block=3).collect())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(texts)
    assert rows["jaccard-links"][1] > 0 and len(rows["jaccard-roots"]) == 1 and rows["jaccard-joined"][0] < rows["jaccard-roots"][0]
    assert 0 < tasks <= 1500


def test_components_of_edges_in_any_order(spark):
    r = random.Random(8)
    for n, m in ((60, 25), (60, 60), (200, 190)):
        names = r.sample(range(-(10**12), 10**12), n)
        edges = [(names[r.randrange(n)], names[r.randrange(n)]) for _ in range(m)] + list(zip(names[: n // 3], names[1 : n // 3]))
        root = {x: x for e in edges if e[0] != e[1] for x in e}
        for _ in range(n):
            for a, b in edges:
                if a != b:
                    root[a] = root[b] = min(root[a], root[b])
        assert {x.id: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()} == root


def test_trees_beyond_a_broadcast_find_their_roots(spark, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    edges = [(i, i + 1) for i in range(30)] + [(50, i) for i in range(51, 60)]
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), len(edges)).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 50 for i in range(50, 60)}


def test_a_table_of_many_rows_is_not_gathered(spark):
    wide = spark.range(10).repartition(40)
    assert [shared.gathered(wide, n).rdd.getNumPartitions() for n in (None, 10, 30 * shared.GATHERED_ROWS, 90 * shared.GATHERED_ROWS)] == [40, 4, 30, 40]
