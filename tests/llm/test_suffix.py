import hashlib
import random
import re
from collections import Counter

import pytest

from lodestone.llm import suffix


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not p for p, g in zip(bytes(1) + gone, gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60, length=60):
    r = random.Random(seed)
    word = lambda: r.choice(["ab", "é", "xyz", "q", "日", "0 "])
    passages = ["".join(word() for _ in range(r.randrange(20, 90))) for _ in range(5)]
    rows = []
    for _ in range(n):
        kind = r.random()
        if rows and kind < 0.2:
            t = r.choice(rows)
        elif rows and kind < 0.5:
            b = r.choice(rows)
            i = r.randrange(len(b) + 1)
            t = b[:i] + r.choice(["", "#", word() * 3]) + b[i:]
        else:
            t = "".join("".join(word() for _ in range(r.randrange(40))) + (r.choice(passages)[r.randrange(30) :] if r.random() < 0.5 else "") for _ in range(r.randrange(1, 5)))
        rows.append(t)
    return rows + ["", "a" * 500, "ab" * 200, "a" * (length - 1), "a" * length, "z" + "a" * 100 + "y"]


@pytest.mark.parametrize(("seed", "group"), [(1, 2000), (2, 2000), (3, 1), (4, 5)])
def test_against_brute_force(spark, seed, group):
    texts = corpus(seed)
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (None, texts[0] + "tail" * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as l").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.dedup(df, length=60, group=group).collect()}
    want = brute([(t or "").encode() for _, t in rows], 60)
    assert got == {d: w for (d, _), w in zip(rows, want, strict=True)}


def test_long_texts_in_pieces(monkeypatch):
    r = random.Random(8)
    text = bytes(r.randrange(97, 101) for _ in range(5000))
    whole = suffix.anchors([text], 60)
    monkeypatch.setattr(suffix, "_CHUNK", 1024)
    parts = suffix.anchors([text], 60)
    rows = lambda x: {tuple(int(c[i]) for c in x) for i in range(len(x[0]))}
    assert {p[1:4] for p in rows(whole)} == {p[1:4] for p in rows(parts)}


@pytest.mark.parametrize("over", [0, 1, 59, 60, 61, 100, 117, 118, 119, 120, 392])
def test_anchors_of_pieces_come_once(monkeypatch, over):
    r = random.Random(over)
    text = bytes(r.randrange(97, 101) for _ in range(9 * 512 + over))
    whole = suffix.anchors([b"z" * 70, text, text], 60)
    monkeypatch.setattr(suffix, "_CHUNK", 1024)
    parts = suffix.anchors([b"z" * 70, text, text], 60)
    spots = lambda x: sorted((int(x[0][i]), int(x[1][i])) for i in range(len(x[0])))
    assert spots(parts) == spots(whole)


def test_long_text_without_repeats_stays(spark):
    r = random.Random(5)
    text = "".join(r.choice("abcdefgh") for _ in range(2 * (suffix._CHUNK // 2) + 600))
    got = suffix.dedup(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got.n_bytes, got.n_removed, got.kept_text) == (len(text), 0, text)


def test_empty_table(spark):
    assert suffix.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows_and_clashing_columns(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(500))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "short")], "doc_id long, text string").selectExpr("*", "1 as did", "2 as th", "3 as spans", "4 as n_bytes").repartition(2)
    got = sorted((r.doc_id or 0, r.n_removed, r.n_spans) for r in suffix.dedup(df).collect())
    assert got == [(0, 500, 1), (1, 500, 1), (1, 500, 1), (2, 0, 0)]


def brute_words(texts, length, words):
    """Windows of bytes as in ``brute``, and whole words under ``length`` bytes with white space alike."""
    plain = [re.sub(rb"[\x09-\x0D]", b" ", t) for t in texts]
    spans = [[m.span() for m in re.finditer(rb"[^ ]+", t)] for t in plain]
    strings = [[(a[0], b[1]) for a, b in zip(s, s[words:]) if b[1] - a[0] < length] for s in spans]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    some = Counter(t[a:b] for t, s in zip(plain, strings) for a, b in s)
    out = []
    for t, p, s in zip(texts, plain, strings):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        for a, b in s:
            if some[p[a:b]] > 1:
                gone[a:b] = b"\1" * (b - a)
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((sum(gone), sum(g and not p for p, g in zip(bytes(1) + gone, gone)), hashlib.sha256(kept).hexdigest()))
    return out


def wordy(seed, n=150):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.choice([1, 2, 3, 5, 9])))
    own = lambda most: [word() for _ in range(r.randrange(most))]
    passages = [[word() for _ in range(r.randrange(14, 34))] for _ in range(25)]
    rows = []
    for _ in range(n):
        if rows and r.random() < 0.15:
            t = r.choice(rows)
            i = r.randrange(len(t) + 1)
            t = t[:i] + r.choice(["", "x", " ", "\n"]) + t[i:]
        else:
            t = ""
            for _ in range(r.randrange(4)):
                t += "".join(w + r.choice("      \n\t") for w in own(30)) + r.choice(["", " ", "q"]) + r.choice([" ", " ", " ", "\n"]).join(r.choice(passages)) + r.choice(["", " ", "\n", "s ", "  "])
            t += " ".join(own(20))
        rows.append(t)
    return [*rows, "", " ", " ".join("a" * 30), "b " * 60]


@pytest.mark.parametrize(("seed", "group"), [(1, 2000), (2, 2000), (3, 1), (4, 3)])
def test_strings_of_words_against_brute_force(spark, seed, group):
    texts = wordy(seed)
    df = spark.createDataFrame([*enumerate(texts), (900, None)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.dedup(df, length=120, group=group, words=18).collect()}
    want = brute_words([t.encode() for t in [*texts, ""]], 120, 18)
    assert got == dict(zip([*range(len(texts)), 900], want, strict=True))
    assert want != brute_words([t.encode() for t in [*texts, ""]], 120, 1000)


@pytest.mark.parametrize("over", [0, 61, 119, 300])
def test_strings_of_words_in_pieces(monkeypatch, over):
    """Pieces of a long text have the anchors of the whole, once each."""
    r = random.Random(over)
    text = bytes(r.choice(b"abcd   \n") for _ in range(9 * 512 + over))
    whole = suffix.anchors([text, text], 120, 18)
    monkeypatch.setattr(suffix, "_CHUNK", 1024)
    parts = suffix.anchors([text, text], 120, 18)
    spots = lambda x: sorted((int(x[0][i]), int(x[1][i]), int(x[2][i]), int(x[3][i])) for i in range(len(x[0])))
    assert spots(parts) == spots(whole) and len(spots(whole)) > 100
