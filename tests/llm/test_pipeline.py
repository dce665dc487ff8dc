import random
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from .test_jaccard import brute as brute_links  # noqa: E402
from .test_language import text as lang_text  # noqa: E402


def documents():
    r = random.Random(11)
    passage = " ".join(f"shared{i}" for i in range(70))
    rows = []
    for i in range(240):
        lang = r.choice(["en", "de", "fr", "es"])
        t = lang_text(r, lang, r.randrange(20, 90))
        if i % 9 == 0:
            t += " " + passage + " " + lang_text(r, lang, 20)
        rows.append((i, t, lang if i % 7 else None, r.choice(["a", "b", "c"]), len(t)))
    rows += [(300 + i, rows[i][1], *rows[i][2:]) for i in range(20)]
    rows += [(400 + i, rows[i][1].rsplit(" ", 1)[0], *rows[i][2:]) for i in range(20, 40)]
    return rows + [(500, None, "en", "a", None), (501, "", "en", None, 0), (502, "12 34 !!", None, "b", 8), (503, "the and the", None, None, 11)]


def test_stages_against_brute_force(spark, tmp_path):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs, out = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out.append(docs.collect())
    lang, near, cut, mix, last = out
    # language: everything with a letter stays, labels are filled in
    assert {x.doc_id for x in lang} == {d for d, t, *_ in rows if any(c.isalpha() for c in t or "")}
    assert all(x.lang for x in lang)
    # near duplicates: the smallest of each component
    links = brute_links(sorted((x.doc_id, x.text) for x in lang))
    assert sorted(x.doc_id for x in near) == [d for d, _, c in links if d == c]
    # repeats
    seen = Counter(b[i : i + 400] for x in near for b in [x.text.encode()] for i in range(len(b) - 399))
    want = {}
    for x in near:
        b = x.text.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        want[x.doc_id] = bytes(c for c, g in zip(b, gone, strict=True) if not g).decode(errors="ignore")
    assert {x.doc_id: x.text for x in cut} == want and any(x.text != {y.doc_id: y.text for y in near}[x.doc_id] for x in cut)
    assert all(x.n_chars == len(x.text) for x in cut)
    # mix: copies of what is there, 150 % of the words
    assert {(x.doc_id, x.text) for x in mix} <= {(x.doc_id, x.text) for x in cut}
    size = lambda some: sum(len(x.text.encode().split()) for x in some)
    assert abs(size(mix) - 1.5 * size(cut)) < 0.02 * size(cut)
    assert max(Counter(x.doc_id for x in mix).values()) <= 2
    # pieces
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {x.doc_id: x.text for x in cut}
    assert Counter(x.doc_id for x in last) == Counter(x.doc_id for x in mix)
    assert all(np.frombuffer(x.ids, "<u2").tolist() == sp.encode(text[x.doc_id]) and x.round_trip for x in last)


def test_empty_documents(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_languages_unknown_and_tables_without_labels(spark, tmp_path):
    """Text in no learned language goes if unlabelled; without any label all that has a letter stays."""
    r = random.Random(2)
    known = [(i, lang_text(r, lang, 40), lang, "a", 0) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    odd = [(900 + i, " ".join("".join(r.choice("жщъыэяю") for _ in range(7)) for _ in range(40)), None, "a", 0) for i in range(5)]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    got = {x.doc_id for x in corpus_pipeline.language_id(spark, spark.createDataFrame(known + odd, shape).repartition(3), "").collect()}
    assert got == {x[0] for x in known}
    none = spark.createDataFrame([(*x[:2], None, *x[3:]) for x in known + odd] + [(5000, "12 !", None, "a", 0), (5001, None, None, "a", 0)], shape)
    assert {x.doc_id for x in corpus_pipeline.language_id(spark, none, "").collect()} == {x[0] for x in known + odd}


def test_each_stage_begins_with_executors_that_gave_memory_back(spark):
    """In one JVM the executor's full collections can be counted."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = next(b for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = spark.createDataFrame([(1, "a b", None, "a", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        before = full.getCollectionCount()
        stage(spark, docs, "")
        assert full.getCollectionCount() > before, name


def test_passages_of_over_50_words_go_in_few_bytes(spark):
    r = random.Random(3)
    own = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage, short = (" ".join("".join(r.choice("klmnop") for _ in range(5)) for _ in range(n)) for n in (52, 50))
    assert len(passage) < 400
    parts = [(own(40), own(40)) for _ in range(8)]
    rows = [(i, f"{a}\n{passage if i < 4 else short} {b}", "en", "a", 0) for i, (a, b) in enumerate(parts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {x.doc_id: x.text for x in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    assert got == {i: f"{a}\n {b}" if i < 4 else rows[i][1] for i, (a, b) in enumerate(parts)}
