"""Language identification in two steps: the family first, then the language within it.

Texts are lower-cased; bytes of letters (ASCII letters and all bytes of longer UTF-8
sequences) form runs, and runs of one, two and three bytes, the gap between words among
them, are counted in hashed ``FEATURES`` buckets. Roots of the counts, scaled to length 1,
are a text's features, over the whole text however long.

Linear support vector machines decide. One per family, against all others, picks the
family; within it one per pair of languages votes, margins breaking ties. Families are
those of ``FAMILIES``; a language that is not listed is a family of its own. Each machine
is a group of its own in Spark, trained on at most about ``SAMPLE`` distinct texts of every
language. The sample is drawn by hash with a share that follows from counts over all
training texts; copies of a text count once, so that a large group of copies can't fill
it. All other work covers all rows, and rows are judged one by one.

``lang_pred`` is ``und`` with score 0 where a text is null or has no letter, or no training
text has a language. ``score`` is the logistic of twice the family's margin times the mean
of those of the language's own pairs: between 0 and 1, not a calibrated probability. A null
id counts as an empty string; repeated rows are judged each; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurelens.llm import words
from featurelens.session import adapt, stored

FEATURES = 4096
#: Distinct training texts of a language, in expectation.
SAMPLE = 800
#: Weight of the squared coefficients against the mean loss, and steps of the descent.
PENALTY, STEPS = 1e-4, 200
#: Bytes whose n-grams are counted at once.
SPAN = 1 << 18
#: Documents whose counts are held at once.
HELD = 256
UNKNOWN = "und"

#: Families of languages by ISO 639-1 code (fixed values).
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "finnic": "et fi",
    "turkic": "az kk ky tk tr tt ug uz",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "malayic": "id jv ms su",
}

_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], f"only {lang}")


#: Class of each byte: 0 for gaps, letters 1 to 26, bytes beyond ASCII 27 and on.
_CLASS = np.zeros(256, np.int64)
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CLASS[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, 155)


def features(texts: pa.Array) -> np.ndarray:
    """Rows of unit length (zero for texts without such bytes), ``FEATURES`` columns."""
    data, offsets = words.raw(pc.utf8_lower(texts))
    n = len(offsets) - 1
    counts = np.zeros(n * FEATURES)
    doc = np.repeat(np.arange(n, dtype=np.int64) * FEATURES, np.diff(offsets))
    for first in range(0, len(data), SPAN):
        last = min(first + SPAN, len(data))
        owner = doc[first : last + 2]
        kind = _CLASS[data[first : last + 2]]
        keys = kind + 1  # one byte
        size = last - first
        for order in (1, 2, 3):
            if order > 1:
                kept = len(keys) - 1
                keys = keys[:kept] * 157 + kind[order - 1 : order - 1 + kept] + 1
            m = min(size, len(keys))
            # Runs stay in one document and hold a letter at both ends or a gap at one of them.
            whole = (owner[:m] == owner[order - 1 : order - 1 + m]) & (kind[:m] + kind[order - 1 : order - 1 + m] > 0)
            if order == 3:
                whole &= kind[1 : 1 + m] > 0
            mixed = (keys[:m][whole] * 0x9E3779B1 + order * 0x85EBCA77) & 0xFFFFFFFF
            place = owner[:m][whole] + ((mixed >> 15) ^ mixed) % FEATURES
            counts += np.bincount(place, minlength=len(counts)) if len(place) * 8 > len(counts) else _scattered(place, len(counts))
    roots = np.sqrt(counts.reshape(n, FEATURES))
    norm = np.sqrt(np.einsum("ij,ij->i", roots, roots))
    return (roots / np.where(norm > 0, norm, 1)[:, None]).astype(np.float32)


def _scattered(place: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size)
    at, times = np.unique(place, return_counts=True)
    out[at] = times
    return out


def lettered(texts: pa.Array) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    found = pc.match_substring_regex(texts, r"\p{L}")
    return found.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)


def train(rows: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Coefficients, the constant last, of a support vector machine with squared hinge loss.

    Accelerated descent with a fixed number of steps; both sides weigh the same.
    """
    y = np.where(side, 1, -1).astype(np.float32)
    weight = np.where(side, 0.5 / max(side.sum(), 1), 0.5 / max((~side).sum(), 1)).astype(np.float32)
    rate = 1 / (PENALTY + 4)  # rows have a squared length of 2
    w = ahead = np.zeros(rows.shape[1] + 1, np.float32)
    for step in range(STEPS):
        slack = np.maximum(0, 1 - y * (rows @ ahead[:-1] + ahead[-1]))
        pull = weight * slack * y
        gradient = PENALTY * ahead - 2 * np.append(pull @ rows, pull.sum())
        after = ahead - np.float32(rate) * gradient
        ahead = after + np.float32(step / (step + 3)) * (after - w)
        w = after
    return w


@dataclass
class Identifier:
    """Families, their languages, and the machines that choose."""

    families: list[str]
    languages: dict[str, list[str]]
    family_rows: np.ndarray  # a row per family, the constant last
    pairs: dict[tuple[str, str], np.ndarray]

    def predict(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each row of features."""
        lang, score = np.empty(len(rows), object), np.zeros(len(rows))
        if not self.families:
            lang[:] = UNKNOWN
            return lang, score
        chosen, sure = np.zeros(len(rows), int), np.ones(len(rows))
        if len(self.families) > 1:
            margins = rows @ self.family_rows[:, :-1].T + self.family_rows[:, -1]
            chosen = margins.argmax(axis=1)
            sure = logistic(margins[np.arange(len(rows)), chosen])
        for i, name in enumerate(self.families):
            mine = np.flatnonzero(chosen == i)
            inside = self.languages[name]
            if not len(mine):
                continue
            votes, total, odds = (np.zeros((len(mine), len(inside))) for _ in range(3))
            for a, b in combinations(range(len(inside)), 2):
                machine = self.pairs[inside[a], inside[b]]
                margin = rows[mine] @ machine[:-1] + machine[-1]
                votes[:, a] += margin >= 0
                votes[:, b] += margin < 0
                total[:, a] += margin
                total[:, b] -= margin
                odds[:, a] += logistic(margin)
                odds[:, b] += logistic(-margin)
            best = (votes + 0.5 * np.tanh(total / max(len(inside), 1)) * 0.999).argmax(axis=1)
            lang[mine] = np.array(inside, object)[best]
            own = odds[np.arange(len(mine)), best] / (len(inside) - 1) if len(inside) > 1 else 1.0
            score[mine] = sure[mine] * own
        return lang, score


def logistic(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-2 * np.clip(margin.astype(np.float64), -20, 20)))


def held_out(key: str | Column) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _sampled(labelled: DataFrame, sample: int) -> DataFrame:
    """About ``sample`` distinct texts of every language, ``lang, text``, by hash."""
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("hash", 0.02).alias("texts"))
    # A row per language on both sides of the broadcast.
    share = counts.select("lang", F.least(F.lit(1.0), F.lit(1.1 * sample) / F.col("texts")).alias("share"))
    draw = F.shiftright(F.col("hash"), 11).cast("double") / F.lit(float(1 << 53)) + 0.5
    few = labelled.join(F.broadcast(share), "lang").filter(F.pmod(draw, F.lit(1.0)) < F.col("share"))
    return few.groupBy("lang", "hash").agg(F.first("text").alias("text")).select("lang", "text")


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in words.blocks(batch):
            for first in range(0, block.num_rows, HELD):
                part = block.slice(first, HELD)
                some = part.filter(pa.array(lettered(part.column(1))))
                vectors = [v.tobytes() for v in features(some.column(1)).astype(np.float16)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(vectors, pa.binary())], names=["lang", "vector"])


def _fitted(group: pd.DataFrame) -> pd.DataFrame:
    # One order of the rows, so that rounding does not depend on how they arrived.
    group = group.sort_values(["lang", "vector"])
    rows = np.empty((len(group), FEATURES), np.float32)
    for i, vector in enumerate(group["vector"]):
        rows[i] = np.frombuffer(vector, np.float16)
    weights = train(rows, group["side"].to_numpy(bool))
    return pd.DataFrame({"machine": [group["machine"].iloc[0]], "weights": [weights.tobytes()]})


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", sample: int = SAMPLE) -> Identifier:
    """The machines for all languages of ``labelled``."""
    spark = adapt(labelled.sparkSession)
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).dropna()
    few = _sampled(rows.withColumn("hash", F.xxhash64("text")), sample)
    vectors = stored(few.mapInArrow(_vectors, "lang string, vector binary"), "language-vectors")
    seen = sorted(r["lang"] for r in vectors.select("lang").distinct().collect())
    inside: dict[str, list[str]] = defaultdict(list)
    for name in seen:
        inside[family(name)].append(name)
    families = sorted(inside)
    machines = []  # machine, lang, side
    if len(families) > 1:
        machines += [(f"family {i}", x, family(x) == f) for i, f in enumerate(families) for x in seen]
    pairs = [(a, b) for f in families for a, b in combinations(inside[f], 2)]
    machines += [(f"pair {i}", x, x == a) for i, (a, b) in enumerate(pairs) for x in (a, b)]
    weights = {}
    if machines:
        roles = spark.createDataFrame(machines, "machine string, role string, side boolean")
        # Each machine's group holds the sample of the languages that it tells apart.
        dealt = vectors.join(F.broadcast(roles), F.col("lang") == F.col("role")).select("machine", "lang", "side", "vector")
        fitted = dealt.groupBy("machine").applyInPandas(_fitted, "machine string, weights binary")
        weights = {r["machine"]: np.frombuffer(r["weights"], np.float32) for r in fitted.collect()}
    family_rows = np.array([weights[f"family {i}"] for i in range(len(families))]) if len(families) > 1 else np.zeros((0, 0))
    return Identifier(families, dict(inside), family_rows, {p: weights[f"pair {i}"] for i, p in enumerate(pairs)})


def predict(docs: DataFrame, model: Identifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``lang_pred`` and ``score`` of every row of ``docs``."""
    spark = adapt(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch):
                for first in range(0, block.num_rows, HELD):
                    part = block.slice(first, HELD)
                    texts = part.column(2)
                    lang, score = shared.value.predict(features(texts))
                    known = lettered(texts)
                    lang[~known], score[~known] = UNKNOWN, 0.0
                    columns = [part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score)]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(key).alias("key"), held_out(key).alias("held_out"), F.col(text).cast("string").alias("text"))
    kind = dict(rows.dtypes)["key"]
    out = rows.mapInArrow(judge, f"key {kind}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("key", key)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """Languages of all documents, learnt from those not held out."""
    return predict(docs, fit(docs.filter(~held_out(key)), lang, text, sample), key, text)
