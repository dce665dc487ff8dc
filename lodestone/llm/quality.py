"""Quality rules with host verdicts.

Each whole text gets word, symbol, line and repetition counts. Documents fail the base rule
(too few words, or mostly repeated three-word windows) or one of the soft rules (symbols,
repeated lines). Failures are counted a host, a host being the value of a column; its rate is
shrunk towards all hosts' with a beta prior fitted by moments to their rates, so that a host of
few documents isn't judged by them alone. The prior weighs at least one document and at most as
many as there are. Hosts are judged against the prior's mean, the rate of all documents: one is
``blocked`` if its posterior rate, less ``SURE`` posterior deviations, passes ``BLOCKED`` times
that mean, ``watched`` if its rate is above the mean, else ``trusted``. Verdicts are joined
back: a document that passes the base rule is dropped if its host is blocked, or if it fails a
soft rule and its host is watched; on a trusted host a soft failure is forgiven.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, claim, cut, mix, slices, small, utf8, word_hashes

BLOCKED = 2.0
SURE = 2.0
_U = np.uint64
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_ODD = mix(np.arange(31, 34, dtype=_U)) | _U(1)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _repeated(hashes: np.ndarray, n: np.ndarray) -> list[int]:
    """Words that lie in a three-word window found twice or more in their text."""
    full = max(len(hashes) - 2, 0)
    rolled = mix(hashes[:full] * _ODD[0] + hashes[1 : 1 + full] * _ODD[1] + hashes[2 : 2 + full] * _ODD[2]) if full else hashes
    out, at = [], 0
    for words in n.tolist():
        if words < 4:
            out.append(0)
        else:
            x = rolled[at : at + words - 2]
            order = np.argsort(x)
            same = x[order[1:]] == x[order[:-1]]
            if same.any():
                twice = np.zeros(words, bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                twice[2:] |= twice[1:-1] | twice[:-2]
                twice[1] |= twice[0]
                out.append(int(twice.sum()))
            else:
                out.append(0)
        at += words
    return out


def text_counts(texts: list[bytes]) -> dict[str, np.ndarray | list[int]]:
    hashes, n = word_hashes(texts, lower=False)
    chars, symbols, lines, dup = [], [], [], []
    for a, b in slices(texts, 1 << 20):
        buf = np.frombuffer(b"\n".join(texts[a:b]) + b"\n", np.uint8)
        sizes = np.array([len(x) + 1 for x in texts[a:b]])
        at = np.cumsum(sizes) - sizes
        chars.append(np.add.reduceat((~_SPACE[buf] & ((buf & 0xC0) != 0x80)).astype(np.int64), at))
        symbols.append(np.add.reduceat(_SYMBOL[buf].astype(np.int64), at))
    for x in texts:
        some = [y for y in x.split(b"\n") if y.split(None, 1)]
        lines.append(len(some))
        dup.append(len(some) - len(set(some)))
    many = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return dict(zip(COUNTS, (n, many(chars), many(symbols), lines, dup, _repeated(hashes, n)), strict=True))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim(__name__)
    for batch in batches:
        texts = utf8(batch.column("text"))
        counts = text_counts(texts)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *(pa.array(counts[c], pa.int64()) for c in COUNTS)], names=["doc_id", "host", *COUNTS])


def host_verdicts(measured: DataFrame) -> DataFrame:
    """(host, n, fails, rate, verdict): failure rates shrunk by a beta prior fitted to the hosts."""
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("base_failed") | F.col("soft_failed")).alias("fails"))
    hosts = cut(hosts)
    all_fails, all_n, n_hosts = (float(x or 0) for x in hosts.agg(F.sum("fails"), F.sum("n"), F.count("*")).first())
    mean = all_fails / max(all_n, 1.0)
    # the spread of rates beyond what sampling alone gives
    seen = hosts.agg(F.sum(F.col("n") * F.pow(F.col("fails") / F.col("n") - F.lit(mean), 2))).first()[0] or 0.0
    real = seen / max(all_n, 1.0) - mean * (1 - mean) * n_hosts / max(all_n, 1.0)
    weight = min(max(mean * (1 - mean) / real - 1, 1.0), all_n) if real > 0 else max(all_n, 1.0)
    rate = (F.col("fails") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    sure = F.col("rate") - SURE * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.lit(weight) + 1))
    above = F.col("fails") * F.lit(all_n) > F.lit(all_fails) * F.col("n")  # the shrunk rate's side of the mean, without rounding
    verdict = F.when(sure > BLOCKED * mean, "blocked").when(above, "watched").otherwise("trusted")
    return hosts.withColumn("rate", rate).withColumn("verdict", verdict)


def judge(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source") -> DataFrame:
    """One row per document: its counts, base_failed, soft_failed, its host's rate and verdict, kept.

    Null texts are empty and fail the base rule. Very long texts are measured whole, a few
    megabytes of words at a time. Null hosts are one host. Rows that repeat are judged alike. An
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    rows = base.mapInArrow(_measure, f"doc_id {kind}, host string, " + ", ".join(f"{c} long" for c in COUNTS))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    rows = rows.withColumn("soft_failed", (100 * F.col("n_symbols") > 10 * F.col("n_words")) | (100 * F.col("n_dup_lines") > 50 * F.col("n_lines")))
    rows = cut(rows)
    hosts = small(host_verdicts(rows).select(F.col("host").alias("_host"), F.col("rate").alias("host_rate"), F.col("verdict").alias("host_verdict")))
    out = rows.join(hosts, rows.host.eqNullSafe(F.col("_host"))).drop("_host")
    drop = F.col("base_failed") | (F.col("host_verdict") == "blocked") | (F.col("soft_failed") & (F.col("host_verdict") == "watched"))
    return out.withColumn("kept", ~drop)


SQL = r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
m AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 50 * n_lines AS soft_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (WHERE base_failed OR soft_failed)::DOUBLE AS fails FROM b GROUP BY source),
p0 AS (SELECT sum(fails) AS f, sum(n) AS n, sum(fails) / sum(n) AS mean, count(*)::DOUBLE AS hosts FROM h),
p1 AS (SELECT f, n, mean, (SELECT sum(h.n * (h.fails / h.n - p0.mean) ** 2) FROM h, p0) / n - mean * (1 - mean) * hosts / n AS real FROM p0),
p2 AS (SELECT f, n, mean, CASE WHEN real > 0 THEN least(greatest(mean * (1 - mean) / real - 1, 1.0), n) ELSE greatest(n, 1.0) END AS weight FROM p1),
v0 AS (SELECT source, h.n, fails, fails * p2.n > p2.f * h.n AS above, (fails + mean * weight) / (h.n + weight) AS rate, weight, mean FROM h, p2),
v AS (SELECT source, above, rate - 2.0 * sqrt(rate * (1 - rate) / (n + weight + 1)) > 2.0 * mean AS blocked FROM v0)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR blocked OR (soft_failed AND above AND NOT blocked)) AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
