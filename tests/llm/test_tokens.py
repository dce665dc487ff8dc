import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm.tokens import Encoder, Kept, encoder, frame, masked_crc, round_trip, unframe

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    r = random.Random(4)
    some = [None, "", "  \n", "Don't you'LL IT'S 12 3a4", "<|endoftext|> x<|startoftext|>", "Straße ÉÀ İI ΑΣ Σ é ñ b c", "日本語 text\x1cy a\x00b", "'s'd 'REt", "x" * 3000, "naïve—“q” ﬁ ½² ª º µ ß÷×"]
    chars = "abcXYZ 'tsl019.,!éßñÉ\n\tΣ̈中"
    return some + ["".join(r.choice(chars) for _ in range(r.randrange(80))) for _ in range(300)]


def test_words_encode_like_the_library():
    t, e = Tokenizer.from_file(PATH), encoder(PATH, "<u2")
    some = [x or "" for x in texts()]
    for x, got in zip(some, e.texts(some), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_store_of_two_generations():
    k, made = Kept(2), []

    def make(new):
        made.append(sorted(new))
        return [(x, x.upper()) for x in new]

    for keys in (["b", "a", "b"], ["c"], ["a", "d"], ["e", "a"], ["e" * 100] * 2, []):
        assert k.values_of(keys, make) == [x.upper() for x in keys]
    assert made[0] == ["a", "b"]
    assert "e" * 100 not in k
    assert len(k) + len(k.old) < 8


def test_other_tokenizers_get_whole_texts(tmp_path):
    """A tokenizer that differs in its normaliser alone isn't cut by words; nor is one of another kind."""
    told = json.loads(open(PATH).read())
    told["normalizer"]["normalizers"].pop()
    (tmp_path / "t.json").write_text(json.dumps(told))
    assert encoder(PATH, "<u2").split
    for path in (str(tmp_path / "t.json"), public_tokenizers.path("byte_bpe_50k.json")):
        t, e = Tokenizer.from_file(path), encoder(path, "<u2")
        assert not e.split
        some = [x or "" for x in texts()]
        assert [np.frombuffer(x, "<u2").tolist() for x in e.texts(some)] == [t.encode(x, add_special_tokens=False).ids for x in some]


def test_crc_and_frames():
    assert masked_crc([b"123456789"]) == [(((0xE3069283 >> 15) | (0xE3069283 << 17)) + 0xA282EAD8) & 0xFFFFFFFF]
    r = np.random.default_rng(1)
    some = [r.bytes(n) for n in (0, 1, 7, 2047, 2048, 2049, 10_000, 0, 5)]
    assert masked_crc(some) == [masked_crc([x])[0] for x in some]
    raw = b"".join(f := frame(some))
    at = np.cumsum([0, *map(len, f)])[:-1].tolist()
    assert unframe(raw, at) == some
    with pytest.raises(ValueError):
        unframe(raw[:40] + bytes([raw[40] ^ 1]) + raw[41:], at)


def test_round_trip(spark):
    rows = [(i * 7 % 331, x) for i, x in enumerate(texts())] + [(None, "a b"), (5000, "z"), (5000, "y y"), (5000, "z"), (-(1 << 63), "c"), (6000, "Very long " * 300_000)]
    got = sorted(round_trip(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as ids", "1 as start").repartition(6), PATH, end_id=2).collect(), key=lambda r: r.start)
    t = Tokenizer.from_file(PATH)
    want = {}
    for d, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at = 0
    assert [r.doc_id for r in got] == [None, *sorted(d for d, _ in rows if d is not None)]
    for r in got:
        assert r.start == at
        at += r.n_tokens
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
    assert round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_each_kind_of_words_alone():
    """Texts whose new words are all of letters, all mixed, or all for the library; and none at all."""
    t, e = Tokenizer.from_file(PATH), Encoder(PATH, "<u2")
    for some in (["only letters here", "and letters"], ["only letters here"], [], [""], ["1a 2b, x."], ["日本 Σ"], ["and 日本 1a"]):
        assert [np.frombuffer(x, "<u2").tolist() for x in e.texts(some)] == [t.encode(x, add_special_tokens=False).ids for x in some]
