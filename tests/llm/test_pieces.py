import itertools
import random
import time

import numpy as np
import public_tokenizers
import sentencepiece

from lodestone.llm.pieces import MARK, NORMAL, Codec, decoded, encoded

PATH = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    r = random.Random(9)
    some = ["", " ", "  a   b ", "\n\n x\n", "Hello world, don't!", "naïve 日本語 😀 \t\x00", "a" * 700, " " * 37 + "x", "<s> </s> <0x0A>", f"x{MARK}y", "1234567 3.14", "thwhedble ingation!! THE ßen"]
    chars = "abcdehinorst ATE  .,'\n0é日"
    some += ["".join(r.choice(chars) for _ in range(r.randrange(120))) for _ in range(300)]
    return some


def test_ids_equal_the_library():
    sp, c = sentencepiece.SentencePieceProcessor(model_file=PATH), Codec.load(PATH)
    some = texts()
    for t, got, want in zip(some, c.encode(some), sp.encode(some), strict=True):
        assert np.frombuffer(got, c.dtype).tolist() == want, t
        assert c.decode(got) == sp.decode(want), t


def test_unigram_equals_all_segmentations():
    r = random.Random(2)
    pieces = [("<unk>", 0.0, 2)] + [(p, -r.random() * 5, NORMAL) for p in {MARK, "a", "b", MARK + "a", "ab", "ba", "aba", "bb", MARK + "ab", "bab"}]
    c = Codec(pieces, bpe=False)
    words = sorted({MARK + "".join(x) for n in range(1, 7) for x in itertools.product("abz", repeat=n)})

    def best(w):
        if not w:
            return 0.0
        return max((c.score.get(w[:k], c.penalty if k == 1 else -1e9) + best(w[k:]) for k in range(1, len(w) + 1)), default=0.0)

    for w, ids in c.encode_words(words[::7]):
        parts = [c.names[i] for i in np.frombuffer(ids, c.dtype).tolist()]
        assert abs(sum(c.penalty if p == "<unk>" else c.score[p] for p in parts) - best(w)) < 1e-9


def test_long_runs_and_words_take_linear_time():
    sp, c = sentencepiece.SentencePieceProcessor(model_file=PATH), Codec.load(PATH)
    for t in (" " * 100_000 + "x", "ab" * 20_000, "a" * 50_001, ("x" + " " * 999) * 30):
        start = time.process_time()
        got = c.encode([t])[0]
        assert time.process_time() - start < 3
        assert np.frombuffer(got, c.dtype).tolist() == sp.encode(t)
        assert c.decode(got) == t


def test_frames(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, None, None), (1, " ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5)
    out = encoded(df, PATH).cache()
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = {r.doc_id: r.n_pieces for r in out.collect()}
    assert all(got[i] == len(sp.encode(t or "")) for i, t, _ in rows)
    back = {r.doc_id: r.text for r in decoded(out, PATH).collect()}
    bad = [i for i, t, _ in rows if i is not None and back[i] != t]
    assert [rows[i][1] for i in bad] == [f"x{MARK}y"]
    assert encoded(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (2, None, 6)], "doc_id long, text string, n int").selectExpr("*", "'x' as row", "1 as ids").repartition(2)
    got = encoded(df, PATH, keep=("doc_id", "n"))
    assert got.columns == ["doc_id", "n", "n_pieces", "ids_crc32", "round_trip", "ids"]
    assert sorted((r.doc_id, r.n, r.n_pieces > 0, r.round_trip) for r in got.collect()) == [(1, 5, True, True), (1, 5, True, True), (2, 6, False, True)]
