import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import extract, graph, latest, resolve
from lodestone.sources import pages, sinks
from lodestone.streaming import ledger as streams


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 8), st.sampled_from("ab")), max_size=12))
def test_overlaps(raw):
    spans = [(a, a + n, k) for a, n, k in raw]
    kept = extract.without_overlaps(spans)
    assert all(p[1] <= q[0] for p, q in zip(kept, kept[1:], strict=False))
    assert all(any(max(s[0], k[0]) < min(s[1], k[1]) and k[1] - k[0] >= s[1] - s[0] for k in kept) for s in spans)


def test_mentions_have_exact_offsets(spark):
    entries = [("place", "دمشق"), ("place", "New York"), ("person", "York")]
    docs = spark.createDataFrame([(1, "😀 قصف بدمشق ودِمَشق مدمشقة"), (2, "in NEW  york, York; Yorkshire"), (3, None)], "id long, text string")
    got = extract.mentions(docs, entries).join(docs.withColumnRenamed("text", "source"), "id").collect()
    assert sorted((r.id, r.text) for r in got) == sorted([(1, "دمشق"), (1, "دِمَشق"), (2, "NEW  york"), (2, "York")])
    assert all(r.source[r.start_offset : r.end_offset] == r.text for r in got)


def test_country_and_classes(spark):
    rows = [("في مصر وبمصر والمصرف", "Egypt"), ("المصرف", None), ("لبنان قطر", "Lebanon"), (None, None)]
    df = spark.createDataFrame(rows, "t string, want string").withColumn("n", text.normalize_arabic(F.col("t")))
    assert all(r.got == r.want for r in df.withColumn("got", text.detect_country(F.col("n"))).collect())
    e = spark.createDataFrame([("قصف وغارة",), ("قصف",), ("توتر",), ("اجتماع",)], "t string").select(text.escalation(F.col("t"))["label"].alias("l")).collect()
    assert [r.l for r in e] == ["high", "medium", "medium", "low"]


def test_clusters_respect_constraints(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.7), (10, 11, 0.65)], "a long, b long, similarity double")
    apart = spark.createDataFrame([(1, 3)], "a long, b long")
    for n in (1, 4):
        got = {r.id: r.cluster for r in resolve.clusters(edges.repartition(n), apart).collect()}
        assert got == {1: 1, 2: 1, 3: 3, 4: 3, 10: 10, 11: 10}
    chain = spark.createDataFrame([(i, i + 1, 0.9) for i in range(40)], "a long, b long, similarity double")
    sizes = [r["count"] for r in resolve.clusters(chain, apart.limit(0)).groupBy("cluster").count().collect()]
    assert max(sizes) <= 2 and sum(sizes) == 41


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901)], "a long, b long")
    got = {r.node: r.comp for r in graph.components(edges).collect()}
    assert set(got.values()) == {0, 900} and len(got) == 303


def test_block_cap(spark):
    rows = [(i, ["k100"]) for i in range(100)] + [(1000 + i, ["k101"]) for i in range(101)] + [(5000, [])]
    pairs = resolve.candidate_pairs(spark.createDataFrame(rows, "id long, keys array<string>"), 100)
    assert pairs.count() == 100 * 99 // 2


def test_latest_ties(spark):
    f = spark.createDataFrame([(1, 1, "t", "a", 5), (2, 1, "t", "b", 5), (3, 1, "t", "c", 4)], "id long, subject_id long, fact_type string, value string, created_at long")
    assert latest.newest(f, ["subject_id", "fact_type"], ["id", "value"]).first().value == "b"


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "aé"), (2, "aé"), (3, "b")], "id long, text string")
    path = f"file://{tmp_path}/blobs"
    sinks.write_blobs(docs, path)
    sinks.write_blobs(docs, path)
    assert spark.read.parquet(path).count() == 2
    refs = docs.select("id", F.sha2("text", 256).alias("sha256"), F.length("text").alias("text_length"))
    assert all(r.intact for r in sinks.read_blobs(refs, path).collect())
    sinks.write_once(docs, f"file://{tmp_path}/once")
    sinks.write_once(docs, f"file://{tmp_path}/once")
    with pytest.raises(ValueError):
        sinks.write_once(docs.limit(1), f"file://{tmp_path}/once")
    sinks.write_snapshot(docs, docs.withColumn("slug", F.lit("x")), f"file://{tmp_path}/snap")
    assert spark.read.json(f"file://{tmp_path}/snap/main").count() == 3
    assert sinks.facts_of(docs.withColumn("n", F.lit("")), "id", ["text", "n"]).count() == 3


def test_json_ld_and_dates(spark):
    item = json.dumps({"@graph": [{"n": 1}], "n": 2})
    df = spark.createDataFrame([(1, f'<script type="application/ld+json">{item}</script><script type="application/ld+json">{{bad</script><script type="application/ld+json">[{{"n": 3}}]</script>')], "page_id long, html string")
    assert [r.n for r in pages.json_ld(df).selectExpr("try_variant_get(item, '$.n', 'int') AS n").collect()] == [1, 2, 3]
    dates = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("03-02-2024 01:05 PM",), ("x",), (None,)], "d string").select(pages.parse_date(F.col("d")).cast("string").alias("d")).collect()
    assert [r.d for r in dates] == ["2024-01-02 03:04:05", "2024-02-03 13:05:00", None, None]


def test_streams(spark, tmp_path):
    rows = [(i % 5, f"2024-01-01 0{i % 3}:00:00", i % 2, "click", 1.0, "{}") for i in range(20)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.events(spark, str(tmp_path / "in"))
    assert streams.drained(streams.idempotent(stream), "append").count() == 5
    assert streams.drained(streams.windowed_counts(stream, "1 hour")).agg(F.sum("n")).first()[0] == 20
    assert streams.drained(streams.leases(stream), "append").where("status = 'running'").count() == 2


def test_complete_linkage_by_brute_force():
    import random

    for seed in range(30):
        r = random.Random(seed)
        n = 14
        score = {(i, j): round(r.random(), 1) for i in range(n) for j in range(i + 1, n) if r.random() < 0.7}
        groups = [[i] for i in range(n)]
        while True:
            best, at = 0.4, None
            for i in range(len(groups)):
                for j in range(i + 1, len(groups)):
                    worst = min(score.get((min(a, b), max(a, b)), 0.0) for a in groups[i] for b in groups[j])
                    if worst >= best:
                        best, at = worst, (i, j)
            if at is None:
                break
            groups[at[0]] += groups.pop(at[1])
        got = resolve._linked_completely(list(range(n)), score, 0.4)
        assert sorted(map(sorted, got)) == sorted(map(sorted, groups)), seed


def test_parts_that_stay_apart(spark):
    """Greedy in order of ids, each into the first part without anyone it must not meet."""
    import random

    from lodestone.operators.provenance import partition_apart

    r = random.Random(3)
    members = [(f"g{i % 5}", i) for i in range(60)]
    apart = {tuple(sorted((r.randrange(60), r.randrange(60)))) for _ in range(120)}
    apart = {(a, b) for a, b in apart if a != b}
    want = []
    for g in range(5):
        parts = []
        for x in range(g, 60, 5):
            home = next((p for p in parts if all((min(x, y), max(x, y)) not in apart for y in p)), None)
            parts.append([x]) if home is None else home.append(x)
        want += [(f"g{g}", x, min(p)) for p in parts for x in p]
    got = partition_apart(spark.createDataFrame(members, "grp string, id long"), spark.createDataFrame(sorted(apart), "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
