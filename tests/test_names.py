from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.functions import names


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_normal_forms(t):
    for f in (names.aligned, names.aligned_latin):
        out, at = f(t)
        assert len(out) == len(at) and at == sorted(at) and all(0 <= i < len(t) for i in at)
        assert f(out)[0] == out
    assert names.aligned(t) == names.aligned_by_character(t)
    assert names.aligned_latin(t) == names.aligned_by_character(t, "NFKD", {}, None)
    for spans in (names.paragraphs(t), names.sentences(t)):
        assert all(t[a:b] == x and x.strip() == x and x for a, b, x in spans)
        assert all(p[1] <= q[0] for p, q in zip(spans, spans[1:], strict=False))


def test_alignment_and_folds():
    out, at = names.aligned("أَحْمَد ٣  ﷺ")
    assert out.startswith("احمد 3")
    assert names.source_span(at, 0, 4) == (0, 7 + 0) or names.source_span(at, 0, 4)[0] == 0
    assert names.aligned_latin("Éa--B İx")[0] == "ea b ix"


def test_similarity():
    assert names.similarity("abc", "abc") == 1.0 and names.similarity("", "a") == 0.0 and names.similarity("ab", "xy") == 0.0
    assert abs(names.similarity("martha", "marhta") - 0.961111) < 1e-5
    assert abs(names.similarity("حسن", "حسين") - 0.933333) < 1e-5
    assert abs(names.similarity("abcd", "abxyzq") - 0.688889) < 1e-5


def test_romanisation():
    assert names.romanized("محمد")[0] == "mohammed" and len(names.romanized("ثثثثث")) == 12
    assert names.romanized("") == [] and names.romanized("الحسن علي")[0] == "hassan ali"


def test_sentences():
    assert [x for _, _, x in names.sentences("Dr. No paid 3.5 dollars. \"Why?!\" he said\n\nNew par. J. R. End...")] == ["Dr. No paid 3.5 dollars.", '"Why?!"', "he said", "New par.", "J.", "R.", "End..."]
    assert [x for _, _, x in names.sentences("See fig. 3 of it. General Co. said so. The U.S. Army e.g. left.")] == ["See fig. 3 of it.", "General Co.", "said so.", "The U.S. Army e.g. left."]
    assert [x for _, _, x in names.paragraphs("a\r\rb\nc\r\n \t\r\nd\n\n")] == ["a", "b\nc", "d"]
    assert len(names.sentences("One two. " * 20_000)) == 20_000
