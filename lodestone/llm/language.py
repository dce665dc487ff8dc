"""Language identification by hierarchical discrimination.

A text's features are frequencies of hashed character n-grams (one to four letters, lower case,
anything else one space) of the whole text, as square roots of their shares. A first set of
one-versus-rest linear machines picks the language family; within the family, one linear support
vector machine for each pair of languages votes, ties going to the larger sum of margins. Machines
are trained with the squared hinge loss by accelerated gradient descent.

Training minimises each machine's loss over all labelled texts. It begins at machines fitted in one
task to a bounded sample: of each language at most ``per_language`` distinct texts, those whose hash
is lowest, so that it spreads over all of the table. Then each of ``PASSES`` passes reads all labelled
texts and sums every machine's loss and gradient. The next point minimises the sample's loss with its
gradient set right by the difference to that of the whole (a surrogate loss: the sample gives the
curvature only), half the way to it if the step before raised the loss of the whole. Of a machine's
points the one of the least loss over all texts is the result. Only the model and its gradient, whose
sizes are fixed by ``BINS`` and the number of languages, go through the driver. Prediction uses the
text alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import claim, slices

BITS = 12
BINS = 1 << BITS
#: Passes of training over all labelled texts.
PASSES = 3
#: What the loss weighs against the size of the weights.
COST = 10.0
#: Fixed: languages by family; an unlisted language is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl it la oc pt rm ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "semitic": "am ar he mt",
    "indic": "bn gu hi mr ne pa ur",
    "iranian": "fa ku ps tg",
}
_OF = {lang: family for family, some in FAMILIES.items() for lang in some.split()}
_U = np.uint64


def family(lang: str) -> str:
    return _OF.get(lang.lower().replace("_", "-").split("-")[0], lang)


_LETTER = None


def _letters() -> np.ndarray:
    """For each code point its lower-case form if it is a letter, else 32."""
    global _LETTER
    if _LETTER is None:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LETTER = table
    return _LETTER


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of unit length, whether the text has a letter)."""
    out, some = np.zeros((len(texts), BINS), np.float32), np.zeros(len(texts), bool)
    table = _letters()
    for lo, hi in slices([(t or "").encode("utf-8", "replace") for t in texts], 1 << 17):
        part = [t or "" for t in texts[lo:hi]]
        joined = "".join(f"   {t}   " for t in part)
        codes = table[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
        ends = np.cumsum([len(t) + 6 for t in part])
        keep = np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))  # runs of other characters are one space
        keep[np.append(0, ends[:-1])] = True  # each text has a space of its own before it
        kept = np.cumsum(keep)
        bounds = np.append(0, kept[ends - 1])
        x = codes[keep].astype(_U)
        n = len(x)
        doc = np.repeat(np.arange(len(part), dtype=np.int64), np.diff(bounds))
        letter = x != 32
        some[lo:hi] = np.bincount(doc[letter], minlength=len(part)) > 0
        h = np.zeros(n, _U)
        row = doc << BITS
        found = []
        for k in range(4):
            h[: n - k] = h[: n - k] * _U(0x100000001B3) + x[k:] + _U(1)
            inside = doc[: n - k] == doc[k:]
            inside &= letter[: n - k] | letter[k:] if k else letter
            bins = (h[: n - k] * _U(0x9E3779B97F4A7C15) >> _U(64 - BITS)).view(np.int64)
            found.append((row[: n - k] + bins)[inside])
        counts = np.bincount(np.concatenate(found), minlength=len(part) * BINS).reshape(len(part), BINS)
        counts = np.sqrt(counts, dtype=np.float32)
        out[lo:hi] = counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)
    return out, some


def svm(x: np.ndarray, y: np.ndarray, c: float = COST, steps: int = 150, start: np.ndarray | None = None, slope: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """A linear machine for y in {-1, 1}: weights and intercept; classes count alike.

    ``slope`` is the gradient of the loss (without its share of the weights) that is to hold at ``start``
    in place of these rows' own.
    """
    n, d = x.shape
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    y = y.astype(np.float32)
    w = np.zeros(d + 1, np.float32) if start is None else start.astype(np.float32)
    z, t = w.copy(), 1.0
    x1 = np.hstack([x, np.ones((n, 1), x.dtype)])
    pull = np.float32(0)
    if slope is not None:
        slack = np.maximum(np.float32(0), np.float32(1) - y * (x1 @ w))
        pull = slope.astype(np.float32) + np.float32(2.0 * c) * (x1.T @ (weight * slack * y))
    rate = 1.0 / (1.0 + 2.0 * c * 2.0)  # rows have unit length, so the loss bends by no more
    for _ in range(steps):
        slack = np.maximum(np.float32(0), np.float32(1) - y * (x1 @ z))
        grad = z.copy()
        grad[-1] = 0.0
        grad += pull - np.float32(2.0 * c) * (x1.T @ (weight * slack * y))
        new = z - np.float32(rate) * grad
        t1 = (1.0 + np.sqrt(1.0 + 4.0 * t * t)) / 2.0
        z, w, t = new + np.float32((t - 1.0) / t1) * (new - w), new, t1
    return w[:-1].astype(np.float32), float(w[-1])


class Model:
    """Languages, their families, and the machines of both levels."""

    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray) -> None:
        self.langs, self.weights, self.bias = langs, weights, bias
        self.families = sorted({family(x) for x in langs})
        self.within = {f: [i for i, x in enumerate(langs) if family(x) == f] for f in self.families}
        self.pairs = [(a, b) for f in self.families for k, a in enumerate(self.within[f]) for b in self.within[f][k + 1 :]]

    def signs(self) -> np.ndarray:
        """For each language and machine what the machine is to say of it: 1, -1, or 0 if it isn't asked."""
        first = len(self.families)
        out = np.zeros((len(self.langs), first + len(self.pairs)), np.float32)
        if first > 1:
            out[:, :first] = [[1.0 if family(x) == f else -1.0 for f in self.families] for x in self.langs]
        for k, (a, b) in enumerate(self.pairs):
            out[a, first + k], out[b, first + k] = 1.0, -1.0
        return out

    def points(self) -> np.ndarray:
        """Each machine's weights and intercept in a row."""
        return np.hstack([self.weights, self.bias[:, None].astype(np.float32)])

    def at(self, points: np.ndarray) -> Model:
        return Model(self.langs, np.ascontiguousarray(points[:, :-1], np.float32), points[:, -1].astype(np.float64))

    @classmethod
    def fit(cls, texts: list[str | None], labels: list[str]) -> Model:
        x, some = features(texts)
        y = np.array(labels, object)
        x, y = x[some], y[some]
        model = cls(sorted(set(y)), np.zeros((0, BINS), np.float32), np.zeros(0))
        of = np.array([family(lang) for lang in y], object)
        machines = [svm(x, np.where(of == f, 1.0, -1.0)) for f in model.families] if len(model.families) > 1 else [(np.zeros(BINS, np.float32), 1.0)] * len(model.families)
        for a, b in model.pairs:
            own = (y == model.langs[a]) | (y == model.langs[b])
            machines.append(svm(x[own], np.where(y[own] == model.langs[a], 1.0, -1.0)))
        model.weights = np.array([w for w, _ in machines], np.float32).reshape(-1, BINS)
        model.bias = np.array([b for _, b in machines])
        return model

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and a score from 0 to 1; ``und`` and 0 without a letter."""
        x, some = features(texts)
        langs, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return langs, score
        margin = x @ self.weights.T + self.bias
        first = len(self.families)
        best = margin[:, :first].argmax(axis=1)
        logistic = lambda m: 1.0 / (1.0 + np.exp(-4.0 * np.clip(m, -20, 20)))
        votes = np.zeros((len(texts), len(self.langs)))
        sums = np.zeros_like(votes)
        sure = np.ones_like(votes)
        for k, (a, b) in enumerate(self.pairs):
            m = margin[:, first + k]
            votes[:, a] += m > 0
            votes[:, b] += m <= 0
            sums[:, a] += np.tanh(m)
            sums[:, b] -= np.tanh(m)
            sure[:, a] = np.minimum(sure[:, a], logistic(m))
            sure[:, b] = np.minimum(sure[:, b], logistic(-m))
        rank = votes * 1e3 + sums
        for i in np.flatnonzero(some):
            own = self.within[self.families[best[i]]]
            k = own[int(np.argmax(rank[i, own]))]
            langs[i] = self.langs[k]
            score[i] = sure[i, k] * (logistic(margin[i, best[i]]) if first > 1 else 1.0)
        return langs, score


def _fit(group: pa.Table) -> pa.Table:
    claim(__name__)
    rows = group.select(["lang", "text"]).sort_by([("lang", "ascending"), ("text", "ascending")]).to_pydict()
    m = Model.fit(rows["text"], rows["lang"])
    return pa.table([pa.array([m.langs], pa.list_(pa.string())), pa.array([m.weights.tobytes()]), pa.array([m.bias.tolist()], pa.list_(pa.float64()))], names=["langs", "weights", "bias"])


def _refit(model: Model, slopes: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    """Each machine's next point from its point and the whole table's gradient there; rows are the sample's."""
    langs, points, signs = model.langs, model.points(), model.signs()

    def run(group: pa.Table) -> pa.Table:
        claim(__name__)
        rows = group.select(["lang", "text"]).sort_by([("lang", "ascending"), ("text", "ascending")]).to_pydict()
        x, some = features(rows["text"])
        of = {lang: i for i, lang in enumerate(langs)}
        x, sign = x[some], signs[[of[lang] for lang, s in zip(rows["lang"], some, strict=True) if s]]
        out = points.copy()
        for k in range(len(points)):
            own = sign[:, k] != 0
            if own.any():
                w, b = svm(x[own], sign[own, k], start=points[k], slope=slopes[k])
                out[k] = np.append(w, np.float32(b))
        return pa.table([pa.array([out.astype("<f4").tobytes()])], names=["points"])

    return run


def _partial(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A partition's sums: of each machine and side the number of texts, their squared slacks, and the gradient of those."""
    langs, weights, bias, signs = model.langs, model.weights, model.bias, model.signs()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        of, k = {lang: i for i, lang in enumerate(langs)}, len(weights)
        n, loss, slope = np.zeros((2, k), np.int64), np.zeros((2, k)), np.zeros((2, k, BINS + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x, some = features(part.column("text").to_pylist())
                lang = np.array([of.get(x, -1) for x in part.column("lang").to_pylist()])
                some &= lang >= 0
                x, sign = x[some], signs[lang[some]]
                slack = np.maximum(np.float32(0), np.float32(1) - sign * (x @ weights.T + bias).astype(np.float32))
                for side, value in enumerate((1.0, -1.0)):
                    own = sign == value
                    part_slack = np.where(own, slack, np.float32(0))
                    n[side] += own.sum(axis=0)
                    loss[side] += np.square(part_slack, dtype=np.float64).sum(axis=0)
                    slope[side, :, :-1] -= value * (part_slack.T @ x)
                    slope[side, :, -1] -= value * part_slack.sum(axis=0, dtype=np.float64)
        some = [(s, i) for s in range(2) for i in range(k) if n[s, i]]
        if some:
            at = TaskContext.get().partitionId()
            columns = [pa.array([i for _, i in some], pa.int32()), pa.array([s for s, _ in some], pa.int32()), pa.array([at] * len(some), pa.int64())]
            columns += [pa.array([int(n[x]) for x in some], pa.int64()), pa.array([float(loss[x]) for x in some]), pa.array([slope[x].tobytes() for x in some], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["machine", "side", "part", "n", "loss", "slope"])

    return run


def _total(group: pa.Table) -> pa.Table:
    """A machine's sums over all partitions, both sides alike, in a fixed order."""
    rows = group.sort_by([("side", "ascending"), ("part", "ascending")]).to_pylist()
    loss, slope = 0.0, np.zeros(BINS + 1)
    for side in range(2):
        own = [r for r in rows if r["side"] == side]
        n = max(1, sum(r["n"] for r in own))
        loss += COST * 0.5 * sum(r["loss"] for r in own) / n
        for r in own:
            slope += COST / n * np.frombuffer(r["slope"])
    return pa.table([pa.array([rows[0]["machine"]], pa.int32()), pa.array([loss]), pa.array([slope.tobytes()], pa.binary())], names=["machine", "loss", "slope"])


def whole_loss(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> tuple[np.ndarray, np.ndarray]:
    """Each machine's loss over all labelled texts, and the gradient of the loss without its share of the weights."""
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    sums = rows.mapInArrow(_partial(model), "machine int, side int, part long, n long, loss double, slope binary")
    loss, slope = np.square(model.weights, dtype=np.float64).sum(axis=1) / 2, np.zeros((len(model.weights), BINS + 1))
    for r in sums.groupBy("machine").applyInArrow(_total, "machine int, loss double, slope binary").collect():  # a row a machine
        loss[r.machine] += r.loss
        slope[r.machine] = np.frombuffer(bytes(r.slope))
    return loss, slope


def _sample(docs: DataFrame, text: str, lang: str, per_language: int, highest: bool) -> DataFrame:
    """(lang, text): of each language at most so many distinct texts of rows with the lowest (or highest) hashes."""
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("at")).where("lang is not null and text is not null")
    order = F.desc("at") if highest else F.asc("at")
    # the hash that bounds each language's sample comes from a pass over hashes alone, of which a partition sends on its first few
    first = rows.select("lang", "at").withColumn("_n", F.dense_rank().over(Window.partitionBy("lang").orderBy(order))).where(F.col("_n") <= per_language)
    ends = first.groupBy("lang").agg((F.min("at") if highest else F.max("at")).alias("end")).collect()  # a row a language
    chosen = F.lit(False)
    for r in ends:
        chosen |= (F.col("lang") == r["lang"]) & ((F.col("at") >= r["end"]) if highest else (F.col("at") <= r["end"]))
    return rows.where(chosen).select("lang", "text").distinct()


def least_score(docs: DataFrame, model: Model, *, text: str = "text", lang: str = "lang") -> float:
    """Half of the least score of all texts whose label is predicted; 0 without any.

    A text below it is unlike all that was learned.
    """
    held = predict(docs.where(F.col(lang).isNotNull()), model, text, (lang,))
    return (held.where(F.col(lang) == F.col("lang_pred")).agg(F.min("score")).first()[0] or 0.0) / 2


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", usable: Column | None = None, per_language: int = 400, passes: int = PASSES) -> Model:
    """A model of all documents that have a language (and are ``usable``).

    ``per_language`` bounds the sample that training begins with, in which a text that repeats counts
    once; in the passes over all texts it counts as often as it stands. No pass leaves the sample's
    model. Ids are not looked at. No such document gives a model that answers ``und``.
    """
    if usable is not None:
        docs = docs.where(usable)
    docs = docs.where(F.col(text).rlike(r"\p{L}"))
    sample = _sample(docs, text, lang, per_language, False)
    got = sample.groupBy(F.lit("all")).applyInArrow(_fit, "langs array<string>, weights binary, bias array<double>").first()
    if got is None:
        return Model([], np.zeros((0, BINS), np.float32), np.zeros(0))
    model = Model(list(got.langs), np.frombuffer(bytes(got.weights), np.float32).reshape(-1, BINS), np.array(got.bias))
    if passes < 1 or len(model.langs) < 2:
        return model
    best, (least, slope) = model.points(), whole_loss(docs, model, text, lang)
    step = np.ones((len(best), 1), np.float32)
    for _ in range(passes - 1):
        got = sample.groupBy(F.lit("all")).applyInArrow(_refit(model.at(best), slope), "points binary").first()
        aim = np.frombuffer(bytes(got.points), "<f4").reshape(best.shape)
        new = best + step * (aim - best)
        loss, at = whole_loss(docs, model.at(new), text, lang)
        better = loss < least
        best, least, slope = np.where(better[:, None], new, best), np.where(better, loss, least), np.where(better[:, None], at, slope)
        step = np.where(better[:, None], step, step / 2)
    return model.at(best)


def _predict(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    langs, weights, bias = model.langs, model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        m = Model(langs, weights, bias)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lang, score = m.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(lang, pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred and score. Null texts and texts without a letter are ``und``, score 0.

    Very long texts are read whole. Rows that repeat are predicted alike; an empty table gives no rows.
    Kept columns may not be called lang_pred or score; other columns are ignored.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(text).alias("text"))
    out = rows.mapInArrow(_predict(model), f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")
    return out.select("row.*", "lang_pred", "score")
