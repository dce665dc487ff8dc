import random
from collections import Counter

from lodestone.llm.quality import judge, text_counts


def brute(t):
    b = (t or "").encode()
    w = b.split()
    g = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, lines, dup = set(), 0, 0
    for x in b.split(b"\n"):
        if x.split():
            lines += 1
            dup += x in seen
            seen.add(x)
    return [len(w), sum(len(x.decode()) for x in w), sum(b.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")), lines, dup, len(covered)]


def test_counts_equal_brute_force():
    r = random.Random(3)
    texts = ["", " \n\t", "a b c a b c", "ä ö ü é|é\x1f#", "x " * 300, "a\nb\na\n\n \na", None]
    for _ in range(150):
        texts.append(r.choice([" ", "\n", "  \r\n"]).join(r.choice(["a", "b", "ß", "cd", "e#", "*", "日本"]) for _ in range(r.randrange(60))))
    got = text_counts([(t or "").encode() for t in texts])
    for i, t in enumerate(texts):
        assert [int(x[i]) for x in got.values()] == brute(t), t


def test_verdicts(spark):
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(i, long, "good") for i in range(200)] + [(1000 + i, long + " #" * 40, "bad") for i in range(150)] + [(2000, long, "bad"), (2001, None, None), (2002, "", "good"), (2003, long, None)]
    rows += [(3000 + i, long + " #" * 40, "mid") for i in range(5)] + [(3100 + i, long, "mid") for i in range(60)]
    rows += [(4000 + i, long + " #" * 40, "worse") for i in range(50)] + [(4100 + i, long, "worse") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' as host", "0 as kept", "1 as n_words").repartition(4)
    got = {r.doc_id: r for r in judge(df).collect()}
    assert len(got) == len(rows)
    assert got[0].kept and not got[1000].kept and not got[2001].kept and not got[2002].kept
    # a clean document goes with its blocked host; the same text stays on others
    assert got[2000].host_verdict == "blocked" and not got[2000].kept and got[2003].kept
    # one that fails a soft rule stays on a host better than all documents, and goes on a worse one
    assert got[3000].host_verdict == "trusted" and got[3000].soft_failed and got[3000].kept
    assert got[4000].host_verdict == "watched" and not got[4000].kept and got[4100].kept
    assert judge(df.limit(0)).count() == 0


def test_repeats_and_very_long_texts(spark):
    long = " ".join(f"w{i % 70_001}" for i in range(700_000)) + "\n#\n#"
    df = spark.createDataFrame([(1, long, "a"), (2, "a b", "a"), (2, "a b", "a"), (None, None, None)], "doc_id long, text string, source string")
    got = judge(df).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_dup_lines, r.n_repeat_words) for r in got) == [(0, 0, 0, 0), (1, 700_002, 1, 700_000), (2, 2, 0, 0), (2, 2, 0, 0)]
