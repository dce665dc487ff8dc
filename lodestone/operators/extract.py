"""Dictionary extraction: one automaton pass over aligned normal forms, whole words, no overlaps."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import aligned, source_span

#: Letters that attach to the next word.
PROCLITICS = "وفبلك"


def automaton(entries: list[tuple[str, str]], normal: Callable[[str], str] = lambda s: aligned(s)[0]):
    """All (type, surface) entries by normal form; of equal forms the last counts."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for kind, surface in entries:
        form = normal(surface)
        if form:
            out.add_word(form, (len(form), kind))
    if len(out):
        out.make_automaton()
    return out


def without_overlaps(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Longest first, then leftmost, of those that overlap; in order of position."""
    kept: list[tuple[int, int, str]] = []  # in order of position, without overlaps
    for s in sorted(set(spans), key=lambda s: (s[0] - s[1], s[0], s[2])):
        at = bisect_left(kept, (s[0],))
        if (at == 0 or kept[at - 1][1] <= s[0]) and (at == len(kept) or s[1] <= kept[at][0]):
            kept.insert(at, s)
    return kept


def scan(text: str | None, found, proclitics: str = PROCLITICS) -> list[tuple[int, int, str, str]]:
    """(start, end, type, text) in the source of whole-word hits."""
    if not text or not len(found):
        return []
    form, at = aligned(text)
    spans = []
    for end, (n, kind) in found.iter(form):
        a, b = end - n + 1, end + 1
        after = b == len(form) or form[b] == " "
        before = a == 0 or form[a - 1] == " " or form[a - 1] in proclitics
        if after and before:
            spans.append((*source_span(at, a, b), kind))
    return [(a, b, k, text[a:b]) for a, b, k in without_overlaps(spans)]


def mentions(documents: DataFrame, entries: list[tuple[str, str]], key: str = "id", text: str = "text", proclitics: str = PROCLITICS) -> DataFrame:
    """(key, start_offset, end_offset, object_type, text): offsets are code points of the source text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = automaton(entries)
        for pdf in frames:
            rows = [(k, *hit) for k, t in zip(pdf[key], pdf["text"], strict=True) for hit in scan(t, found, proclitics)]
            yield pd.DataFrame(rows, columns=[key, "start_offset", "end_offset", "object_type", "text"])

    return documents.select(key, F.col(text).alias("text")).mapInPandas(run, f"{key} long, start_offset int, end_offset int, object_type string, text string")
