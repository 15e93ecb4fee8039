"""Language ID: first the language family, then one-versus-one linear SVMs within it.

Features are counts of hashed byte trigrams over the whole text, A-Z lower-cased, with
everything but letters read as one space; square roots, scaled to unit length. Linear
support vector machines (squared hinge) are trained for each pair of families and for
each pair of languages of a family. A document goes to the family that wins most
family duels (ties: larger summed margin), then likewise to a language of that family.

The score is the product of the winner's mean duel probabilities at both levels, a
duel's probability being the logistic function of its margin times a fitted slope.

Training reads a sample of the labelled documents: at most SAMPLE in all, an equal share
for each language, those of least hash of id and text, so that rows with one id are drawn
apart; each language has one text at least. Of more than SAMPLE languages the most frequent
are learned. Every document is predicted from its whole
text. A text that is null or has no letter is `und` with score 0. If nothing is labelled
every text is `und`. Languages outside FAMILIES are each a family of their own.
"""

from __future__ import annotations

import pickle
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import spans

DIM = 4096
SAMPLE = 2400
UNDETERMINED = "und"
#: Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru pl cs sk uk bg sr hr sl mk be bs",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indo-aryan": "hi bn mr ur ne pa gu",
    "semitic": "ar he mt am",
    "celtic": "ga cy gd br",
}

_LETTERS = spans.LOWER.copy()
_LETTERS[~((spans.LOWER >= 0x61) & (spans.LOWER <= 0x7A) | (spans.LOWER >= 0x80))] = 0x20


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((family for family, codes in FAMILIES.items() if code in codes.split()), f"own:{lang}")


def trigram_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A unit row of DIM square-rooted trigram counts for each text; zero for texts without letters."""
    rows = len(offsets) - 1
    text = _LETTERS[data].astype(np.uint32)
    # a space before and after each text, so that no trigram crosses texts
    placed = np.full(len(text) + 2 * rows, 0x20, dtype=np.uint32)
    shift = np.repeat(2 * np.arange(rows) + 1, np.diff(offsets))
    placed[np.arange(len(text)) + shift] = text
    if len(placed) < 3:
        return np.zeros((rows, DIM), dtype=np.float32)
    a, b, c = placed[:-2], placed[1:-1], placed[2:]
    row = np.repeat(np.arange(rows), np.diff(offsets) + 2)[1:-1]
    keep = (b != 0x20) | (a != 0x20) & (c != 0x20)
    key = ((a << np.uint32(16) | b << np.uint32(8) | c) * np.uint32(2654435761)) >> np.uint32(20)
    ends = np.zeros(len(placed), dtype=bool)
    ends[offsets[1:] + 2 * np.arange(1, rows + 1) - 1] = True
    keep &= ~ends[1:-1] & ~np.concatenate([[False], ends[:-3]])
    counts = np.bincount(row[keep] * DIM + key[keep], minlength=rows * DIM).reshape(rows, DIM)
    out = np.sqrt(counts.astype(np.float32))
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    low = spans.LOWER[data]
    ascii_letters = np.append(0, np.cumsum((low >= 0x61) & (low <= 0x7A)))
    out = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
    for i in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])):
        out[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights (the last is the bias) of min |w|^2 / 2 + c * mean(hinge^2) for y in -1, 1, and the slope of a logistic link."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], dtype=np.float32)
    ahead, t = w, 1.0
    rate = 1 / (1 + 4 * c)
    for _ in range(steps):
        gap = np.maximum(0, 1 - y * (x @ ahead))
        grad = ahead - 2 * c * (x.T @ (weight * gap * y))
        new = ahead - rate * grad
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    margin = y * (x @ w)
    slopes = np.linspace(0.5, 8, 16)
    loss = [(weight * np.logaddexp(0, -s * margin)).sum() for s in slopes]
    return w, float(slopes[int(np.argmin(loss))])


class Duels:
    """One-versus-one classifiers over a list of names."""

    def __init__(self, names: list[str], x: np.ndarray, of: np.ndarray):
        self.names, self.pairs, weights, slopes = names, [], [], []
        for a, b in combinations(range(len(names)), 2):
            mine = (of == names[a]) | (of == names[b])
            w, slope = linear_svm(x[mine], np.where(of[mine] == names[a], 1, -1).astype(np.float32))
            self.pairs.append((a, b))
            weights.append(w)
            slopes.append(slope)
        self.weights = np.array(weights, dtype=np.float32).reshape(len(self.pairs), x.shape[1] + 1)
        self.slopes = np.array(slopes)

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner and its mean probability in its duels."""
        n, k = len(x), len(self.names)
        if k == 1 or not n:
            return np.zeros(n, dtype=np.int64), np.ones(n)
        margin = (x @ self.weights[:, :-1].T + self.weights[:, -1]) * self.slopes
        wins, chance, total = np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k))
        for i, (a, b) in enumerate(self.pairs):
            p = 1 / (1 + np.exp(-np.clip(margin[:, i], -50, 50)))
            wins[:, a] += margin[:, i] >= 0
            wins[:, b] += margin[:, i] < 0
            total[:, a] += margin[:, i]
            total[:, b] -= margin[:, i]
            chance[:, a] += p
            chance[:, b] += 1 - p
        best = np.argmax(wins + np.tanh(total / 1e3) / 4, axis=1)
        return best, chance[np.arange(n), best] / (k - 1)


class Model:
    def __init__(self, x: np.ndarray, lang: np.ndarray):
        family = np.array([family_of(v) for v in lang], dtype=object)
        self.families = Duels(sorted(set(family)), x, family)
        self.within = [Duels(sorted(set(lang[family == f])), x[family == f], lang[family == f]) for f in self.families.names]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        best, p = self.families.decide(x)
        out = np.empty(len(x), dtype=object)
        score = np.zeros(len(x))
        for i, duels in enumerate(self.within):
            mine = np.flatnonzero(best == i)
            own, q = duels.decide(x[mine])
            out[mine] = np.array(duels.names, dtype=object)[own]
            score[mine] = p[mine] * q
        return out.tolist(), score


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """labelled: (id, text, lang). None if no text is labelled."""
    usable = labelled.filter("lang is not null and text is not null")
    usable = usable.withColumn("draw", F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "text"), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    found = usable.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("least")).orderBy(F.desc("n"), "lang").limit(sample).collect()
    if not found:
        return None
    share = max(1, sample // len(found))
    # twice the share on average; of these the least hashes are taken
    wanted = F.create_map(*[x for r in found for x in (F.lit(r["lang"]), F.lit(max(r["least"], min(1.0, 2 * share / r["n"]))))])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id"))
    drawn = usable.filter(F.col("draw") <= F.element_at(wanted, F.col("lang"))).withColumn("place", place).filter(F.col("place") <= share)

    def features(batches):
        for batch in batches:
            data, offsets = spans.byte_column(batch.column(1))
            for i, j in spans.runs(offsets):
                x = trigram_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], names=["lang", "x"])

    rows = drawn.select("lang", "text").mapInArrow(features, "lang string, x binary").collect()
    rows = sorted(tuple(r) for r in rows)
    if not rows:
        return None
    x = np.array([np.frombuffer(r[1], dtype=np.float16) for r in rows]).astype(np.float32)
    return Model(x, np.array([r[0] for r in rows], dtype=object))


def predictions(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score; columns of those names in docs are replaced."""
    kept = [x for x in docs.columns if x not in ("lang_pred", "score")]
    rows = docs.select(*[F.col(f"`{x}`") for x in kept])
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    where = kept.index(text)
    schema = rows.withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema

    def scan(batches):
        local = pickle.loads(sent.value)
        for batch in batches:
            data, offsets = spans.byte_column(batch.column(where))
            names, scores = [], []
            for i, j in spans.runs(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                known = has_letter(part, at)
                if local is None:
                    known[:] = False
                lang, score = [UNDETERMINED] * len(known), np.zeros(len(known))
                some = np.flatnonzero(known)
                for k in range(0, len(some), 512):
                    pick = some[k : k + 512]
                    # rows are contiguous but for those without letters, whose features are zero
                    low, high = pick[0], pick[-1] + 1
                    x = trigram_features(part[at[low] : at[high]], at[low : high + 1] - at[low])[pick - low]
                    found, p = local.predict(x)
                    for r, v in zip(pick.tolist(), found):
                        lang[r] = v
                    score[pick] = p
                names += lang
                scores.append(score)
            new = [pa.array(names, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return rows.mapInArrow(scan, schema)


def held_out_of(doc_id: F.Column) -> F.Column:
    """Documents whose crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained_on(docs: DataFrame, **options) -> Model | None:
    """A model from the documents that are not held out."""
    return train(docs.filter(~held_out_of(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "text", "lang"), **options)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    rows = predictions(docs.select("doc_id", "text"), trained_on(docs))
    return rows.select("doc_id", held_out_of(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least_score: float = 0.3) -> DataFrame:
    """The documents with a language and at least that score, with their own columns."""
    names = {x: f"__own_{x}" for x in ("lang_pred", "score") if x in docs.columns}
    rows = predictions(docs.withColumnsRenamed(names), trained_on(docs))
    fine = (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score)
    return rows.filter(fine).select(*[F.col(f"`{names.get(x, x)}`").alias(x) for x in docs.columns])
