"""Queries that read whole tables, held against plain Python over all of their rows."""

import math
import os
from collections import Counter, defaultdict

import pyarrow.dataset as ds
import pytest

import __spark_entry__ as entry
from lodestone.functions.names import romanized
from lodestone.operators import learning
from lodestone.plans import model

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(name):
    return ds.dataset(f"{SF}/{name}.parquet").to_table().to_pylist()


def run(spark, name):
    return entry.queries()[name](spark, SF).collect()


def test_lineage_of_all_parts(spark):
    assert sum(r.witnesses for r in run(spark, "g11_lineage_all")) == len(rows("part"))
    assert {r.cluster for r in run(spark, "j13_g07_g08_reconcile_all")} == {f"{p['p_type']}-{p['p_size'] % 9}" for p in rows("part")}


def test_targets_of_all_orders(spark):
    to = defaultdict(set)
    for o in rows("orders"):
        to[o["o_custkey"] % 300].add(o["o_custkey"] % 300 + 1 + o["o_orderkey"] % 7)
    ends = {}
    for n in sorted(to, reverse=True):
        ends[n] = set().union(*(ends.get(m, {m}) for m in to[n]))
    assert {(r.origin, r.node) for r in run(spark, "g14_current_targets_all")} == {(n, m) for n in ends for m in ends[n]}


def test_append_of_all_events(spark):
    early = {e["event_id"] for e in rows("events") if e["ts"].hour < 12}
    from lodestone.plans.ledger_queries import ledger_events

    old, new = {}, defaultdict(set)
    for e in sorted(ledger_events(spark, SF).collect(), key=lambda e: e.id):
        key, content = f"{e.run_id}:{e.event_type}", (e.event_type, e.source, e.id % 2)
        if e.id in early:
            old.setdefault(key, content)
        else:
            new[key].add(content)
    bad = {k for k, c in new.items() if len(c) > 1 or (k in old and c != {old[k]})}
    want = [(k, "conflict") for k in bad] + [(k, "new") for k in new if k not in old and k not in bad]
    assert sorted((r.event_key, r.outcome) for r in run(spark, "b01_idempotent_append_all")) == sorted(want)


def test_top_entities_of_a_type(spark, tmp_path):
    text = " ".join(surface for _, _, surface in model.DICTIONARY)
    spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["w10_top_entities_12"](spark, str(tmp_path)).collect()
    assert sorted((r.object_type, r.surface) for r in got) == sorted((kind, surface) for kind, _, surface in model.DICTIONARY)


def test_bootstrap_takes_its_default(spark, monkeypatch):
    taken, real = [], learning.bootstrap
    monkeypatch.setattr(learning, "bootstrap", lambda rows, samples=2000, **x: taken.append(samples) or real(rows, samples, **x))
    run(spark, "a26_bootstrap_interval")
    assert taken == [2000]


def test_romanised_names_of_all_tables(spark):
    names = {("phrases", -1 - i): t for i, t in enumerate(model.PHRASES)}
    for table, key, name in (("documents", "doc_id", "text"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"), ("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name")):
        names |= {(table, r[key]): r[name] for r in rows(table)}
    got = {(r.table, r.id, r.rank): r.spelling for r in run(spark, "t16_romanised_names")}
    assert got == {(*k, i): x for k, t in names.items() for i, x in enumerate(romanized(t))}


def test_name_scores_of_all_pairs(spark):
    """Every candidate pair's similarity and probability, from the names and the other features."""
    from lodestone.functions import fixed
    from lodestone.functions.names import similarity
    from lodestone.plans.resolve_queries import _records

    name = {r.id: r["name"] for r in _records(spark, SF).select("id", "name").collect()}
    rest = {(r.a, r.b): r for r in run(spark, "r06_r07_features_and_scores")}
    got = run(spark, "n01_r07_name_similarity_scores")
    assert {(r.a, r.b) for r in got} == set(rest) and got
    for r in got:
        assert abs(r.name_similarity - similarity(name[r.a], name[r.b])) < 1e-12
        x = [r.name_similarity, *(rest[r.a, r.b][f] for f in fixed.PAIR_FEATURES[1:])]
        assert abs(r.p - 1 / (1 + math.exp(-(fixed.PAIR_INTERCEPT + sum(w * v for w, v in zip(fixed.PAIR_WEIGHTS, x)))))) < 1e-9


def test_dictionary_mentions_of_all_documents(spark):
    """Hits found by looking at every word of the folded text, the longest first, then the leftmost."""
    from lodestone.functions.names import aligned

    entries = {aligned(s)[0]: kind for kind, _, s in model.DICTIONARY}
    want = set()
    for d in rows("documents"):
        form, at = aligned(d["text"])
        words, pos = [], 0
        for w in form.split(" "):
            words.append((pos, w))
            pos += len(w) + 1
        hits = [(at[a], at[a + len(w) - 1] + 1, entries[w]) for a, w in words if w in entries]
        want |= {(d["doc_id"], a, b, k) for a, b, k in hits}
    got = {(r.id, r.start_offset, r.end_offset, r.object_type) for r in run(spark, "x02_x04_dictionary_mentions")}
    assert got == want


def test_clusters_of_all_records(spark):
    """No rejected pair in one cluster, no cluster across components, and a cluster for every record."""
    from lodestone.plans.resolve_queries import _records, _scored

    got = {r.id: r.cluster for r in run(spark, "r09_r15_clusters")}
    assert set(got) == {r.id for r in _records(spark, SF).collect()}
    pairs = [(r.a, r.b, r.p) for r in _scored(spark, SF).where("same_type = 1").collect()]
    assert all(got[a] != got[b] for a, b, _ in pairs if (a + b) % 7 == 0)
    size = Counter(got.values())
    linked = {frozenset((a, b)) for a, b, p in pairs if (p >= 0.6 or (a + b) % 97 == 1) and (a + b) % 7}
    for a, c in got.items():
        assert size[c] == 1 or any(frozenset((a, b)) in linked for b, d in got.items() if d == c and b != a)
