import random

import numpy as np
import pytest

from lodestone.llm import common, jaccard
from lodestone.llm.jaccard import bands, near_duplicates, segments, shingle_sets, signatures

LETTERS = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").translate(LETTERS).encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and both * 100 >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n=120):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        kind = r.random()
        if rows and kind < 0.6:
            w = (r.choice(rows)[1] or "").split()
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                if w:
                    at = r.randrange(len(w))
                    w[at : at + r.choice([0, 1])] = r.choice([[], [r.choice(vocab)], [r.choice(vocab)] * 2])
            text = r.choice([" ", "\n"]).join(w)
        else:
            text = " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 3, 5, 8, 12, 30, 80, 200])))
        rows.append((i, text.upper() if r.random() < 0.1 else text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed) + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "a b c d e"), (1004, "A B C D e")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", __import__("pyspark").sql.functions.lit(1)).repartition(5))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows)


def test_empty_and_null_ids(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = near_duplicates(spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b"), (None, None)], "doc_id long, text string"))
    assert sorted(map(str, [(r.doc_id, r.component_id) for r in got.collect()])) == sorted(map(str, [(None, 7), (7, 7), (7, 7), (None, None)]))


def test_linked_sets_always_share_a_signature():
    r = np.random.default_rng(5)
    for n in [*range(1, 40), 60, 100, 333, 1000]:
        for _ in range(60 if n < 40 else 10):
            a = np.unique(r.integers(0, 1 << 64, n, dtype=np.uint64))
            extra = r.integers(0, n // 4 + 1)
            b = np.unique(np.concatenate([a[r.permutation(n)[: n - r.integers(0, n // 5 + 1)]], r.integers(0, 1 << 64, extra, dtype=np.uint64)]))
            if len(b) and 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
                assert len(np.intersect1d(signatures(a), signatures(b))), (n, len(b))


def test_short_allocations_are_exact():
    # few segments filled: all members fall into the same narrow part of the universe
    r = np.random.default_rng(6)
    for n in (16, 40, 200):
        for spread in (1, 2, 3, 5):
            a = np.unique((r.integers(0, spread, n, dtype=np.uint64) << np.uint64(61)) + r.integers(0, 1 << 20, n, dtype=np.uint64))
            for drop in range(0, len(a) // 5 + 1):
                b = np.delete(a, r.permutation(len(a))[:drop])
                if 100 * len(b) >= 80 * len(a):
                    assert len(np.intersect1d(signatures(a), signatures(b)))


def test_bands_and_segments():
    assert bands(10)[:4] == [1, 2, 3, 4]
    assert all(segments(t) > t // 4 for t in range(1, 2000))


def test_shingles_of_short_and_long_texts():
    s, n = shingle_sets([b"a b", b"", b"a b c d e f", b"A B C D E F", b"a b c d e a b c d e"])
    assert n.tolist() == [1, 0, 2, 2, 5]
    assert (s[1:3] == s[3:5]).all()


def test_coarse_and_fine_buckets(spark, monkeypatch):
    """Fingerprints that are dealt in two levels are counted alike."""
    rows = corpus(3)
    monkeypatch.setattr(jaccard, "COARSE", 3)
    monkeypatch.setattr(jaccard, "BUCKET_BYTES", 4_000)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows)


def test_chains_of_links(spark):
    """Components that only meet over several rounds: each text is linked with the next one alone."""
    words = [f"v{i}" for i in range(400)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 60])) for i in range(100)] + [(500 + i, " ".join(words[3 * i : 3 * i + 60])) for i in range(40)]
    r = random.Random(1)
    r.shuffle(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got.collect()) == brute(rows)


def test_scratch_is_removed(spark, tmp_path):
    monkey = pytest.MonkeyPatch()
    monkey.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    near_duplicates(spark.createDataFrame(corpus(4, 40), "doc_id long, text string")).count()
    monkey.undo()
    assert not list(tmp_path.glob("scratch-*"))


def test_very_long_and_repeated_texts(spark):
    r = random.Random(9)
    long = " ".join(f"w{r.randrange(10**9)}" for _ in range(250_000))
    rows = [(1, long), (2, long + " one more"), (2, long + " one more"), (3, "x " * 300_000), (4, "x x x x x x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as cls", "1 as key", "2 as th")
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in near_duplicates(df).collect())
    assert got == [(1, 249_996, 1), (2, 249_998, 1), (2, 249_998, 1), (3, 1, 3), (4, 1, 3)]
