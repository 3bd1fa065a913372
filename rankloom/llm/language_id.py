"""Language of a text in two steps: its family first, then one-versus-one linear SVMs between the family's languages.

Every machine (a pair of families, or of languages of one family) is trained in a task of its own on a bounded sample of
labelled texts. Features are hashed letter n-grams of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm import bytewords as bw
from rankloom.llm.tables import pick

# Families of languages by ISO 639-1 code. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga gd cy br",
    "indic": "hi bn ur pa gu mr ne",
    "turkic": "tr az kk uz ky",
    "semitic": "ar he mt am",
    "sinitic": "zh yue",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

UNKNOWN = "und"
BUCKETS = 4096
_ROWS = 256
_LETTERS = bw.byte_set((0x61, 0x7A), (0x80, 0xFF))


@dataclass(frozen=True)
class LanguageModel:
    """``sample`` labelled texts of each language at most train the machines; ``epochs`` passes with regularisation ``decay``."""

    sample: int = 500
    epochs: int = 12
    decay: float = 1e-4


def family_of(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def features(block: bw.TextBlock) -> np.ndarray:
    """A row per text: square roots of hashed counts of its letter bigrams and trigrams, scaled to length 1.

    A-Z become a-z; whatever is no letter is one blank.
    """
    low = bw.LOWER[block.data]
    low = np.where(_LETTERS[low], low, np.uint8(0x20)).astype(np.uint32)
    row = np.repeat(np.arange(block.rows), np.diff(block.offsets))
    out = np.zeros(block.rows * BUCKETS, dtype=np.float32)
    for n, salt in ((2, 0x85EBCA6B), (3, 0xC2B2AE35)):
        size = low.size - n + 1
        if size <= 0:
            continue
        code = low[:size].copy()
        for i in range(1, n):
            code = (code << np.uint32(8)) | low[i : i + size]
        keep = row[:size] == row[n - 1 :]
        place = ((code * np.uint32(salt)) >> np.uint32(20)).astype(np.int64) + row[:size] * BUCKETS
        out += np.bincount(place[keep], minlength=out.size).astype(np.float32)
    found = np.sqrt(out.reshape(block.rows, BUCKETS))
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)


def _small_blocks(texts: pa.Array) -> Iterator[bw.TextBlock]:
    """Blocks of few rows, so that the feature table of a block is small."""
    for first in range(0, len(texts), _ROWS):
        for block in bw.blocks(texts.slice(first, _ROWS)):
            yield bw.TextBlock(first + block.first, block.data, block.offsets)


def train_machine(x: np.ndarray, y: np.ndarray, how: LanguageModel) -> np.ndarray:
    """A linear SVM (hinge loss, averaged stochastic subgradients): weights and, last, the threshold."""
    x = np.hstack([x, np.ones((x.shape[0], 1), dtype=x.dtype)]).astype(np.float64)
    w, total, step = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    rng = np.random.default_rng(4)
    for _ in range(how.epochs):
        for i in rng.permutation(x.shape[0]):
            step += 1
            rate = 1.0 / (how.decay * (step + 1.0 / how.decay))
            wrong = y[i] * (w @ x[i]) < 1
            w *= 1 - rate * how.decay
            if wrong:
                w += rate * y[i] * x[i]
            total += w
    return total / max(step, 1)


def _machines(langs: list[str]) -> list[tuple[str, str, str]]:
    """(level, a, b): level is empty between families, else the family of both languages."""
    families = sorted({family_of(x) for x in langs})
    out = [("", a, b) for a, b in combinations(families, 2)]
    for family in families:
        out += [(family, a, b) for a, b in combinations([x for x in langs if family_of(x) == family], 2)]
    return out


def _sample(usable: DataFrame, texts: dict[str, int], how: LanguageModel) -> DataFrame:
    """The ``sample`` different texts of each language with the smallest digests.

    ``texts`` holds about how many there are. Only digests under a bound that lets about four times the sample through
    are ranked, so what a language sends to the task that ranks it does not grow with the table.
    """
    share = F.col("digest").cast("double") / 2.0**64 + 0.5
    bounds = [(lang, min(1.0, 4.0 * how.sample / max(n, 1))) for lang, n in texts.items()]
    bounds = usable.sparkSession.createDataFrame(bounds, "lang string, bound double")
    low = usable.join(F.broadcast(bounds), "lang").filter(share <= F.col("bound"))
    low = low.groupBy("lang", "digest").agg(F.min("text").alias("text"))
    ranked = Window.partitionBy("lang").orderBy("digest")
    return low.withColumn("n", F.row_number().over(ranked)).filter(F.col("n") <= how.sample)


def train(labelled: DataFrame, how: LanguageModel = LanguageModel()) -> dict:
    """Machines from (text, lang). The driver gets the list of languages and one row of weights per machine."""
    usable = labelled.filter("lang is not null and text is not null").filter(F.col("text").rlike(r"\p{L}"))
    usable = usable.withColumn("digest", F.xxhash64("text"))
    counted = usable.groupBy("lang").agg(F.approx_count_distinct("digest").alias("texts")).collect()
    langs = sorted(r.lang for r in counted)
    chosen = _sample(usable, {r.lang: r.texts for r in counted}, how).select("text", "lang")
    machines = _machines(langs)
    if not machines:
        return {"langs": langs, "machines": []}
    spark = labelled.sparkSession
    sides = [(f"{i}", x, 1 if side == 1 else -1) for i, (level, a, b) in enumerate(machines) for side, name in ((1, a), (-1, b))
             for x in langs if (x if level else family_of(x)) == name]
    plan = spark.createDataFrame(sides, "machine string, lang string, y int")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["y", "text"])
        rows = [features(b) for b in _small_blocks(pa.array(frame["text"], pa.string()))]
        weights = train_machine(np.vstack(rows), frame["y"].to_numpy(dtype=np.float64), how)
        return pd.DataFrame({"machine": [frame["machine"].iloc[0]], "weights": [weights.astype(np.float32).tobytes()]})

    made = chosen.join(F.broadcast(plan), "lang").groupBy("machine").applyInPandas(one, "machine string, weights binary").collect()
    weights = {int(r.machine): np.frombuffer(bytes(r.weights), dtype=np.float32) for r in made}
    return {"langs": langs, "machines": [(*m, weights[i]) for i, m in enumerate(machines)]}


def _vote(x: np.ndarray, names: list[str], machines: list[tuple[str, str, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The winner of all pairs for each row (ties: the larger sum of margins), and how clearly it won (0 to 1)."""
    votes = np.zeros((x.shape[0], len(names)))
    surety = np.zeros_like(votes)
    at = {n: i for i, n in enumerate(names)}
    for a, b, weights in machines:
        margin = x @ weights[:-1] + weights[-1]
        chance = 1 / (1 + np.exp(-4.0 * np.clip(margin, -50, 50)))
        votes[:, at[a]] += margin >= 0
        votes[:, at[b]] += margin < 0
        surety[:, at[a]] += chance
        surety[:, at[b]] += 1 - chance
    best = np.argmax(votes + surety / (2 * len(names) + 1), axis=1)
    others = max(len(names) - 1, 1)
    sure = surety[np.arange(x.shape[0]), best] / others if len(names) > 1 else np.ones(x.shape[0])
    return best, sure


def predict(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of every row of features."""
    langs = model["langs"]
    families = sorted({family_of(n) for n in langs})
    best, sure = _vote(x, families, [(a, b, w) for level, a, b, w in model["machines"] if not level])
    said, score = np.empty(x.shape[0], dtype=object), np.zeros(x.shape[0])
    for i, family in enumerate(families):
        rows = np.flatnonzero(best == i)
        names = [n for n in langs if family_of(n) == family]
        inner, how_sure = _vote(x[rows], names, [(a, b, w) for level, a, b, w in model["machines"] if level == family])
        said[rows] = np.array(names, dtype=object)[inner]
        score[rows] = sure[rows] * how_sure
    return said, score


def identify(documents: DataFrame, model: dict, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, lang_pred and score (0 to 1) for every row.

    The whole text is read, and nothing but the text. A text that is null or has no letter is ``und`` with score 0, as is
    every text where nothing was learned. Repeated rows each give a row; an empty table gives none.
    """
    docs = pick(documents, **{c: c for c in (*carry, "text") if c in documents.columns})
    docs = docs.withColumn("_letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, score = np.full(batch.num_rows, UNKNOWN, dtype=object), np.zeros(batch.num_rows)
            if model["langs"]:
                for block in _small_blocks(batch.column("text")):
                    part = slice(block.first, block.first + block.rows)
                    said[part], score[part] = predict(features(block), model)
            letters = batch.column("_letters").to_numpy(zero_copy_only=False).astype(bool)
            said[~letters], score[~letters] = UNKNOWN, 0.0
            columns = [batch.column(c) for c in carry]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(said, pa.string()), pa.array(score, pa.float64())], names=[*carry, "lang_pred", "score"]
            )

    return docs.mapInArrow(per_batch, f"{schema}, lang_pred string, score double")


def held_out() -> Column:
    """The fold that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(documents: DataFrame, how: LanguageModel = LanguageModel()) -> DataFrame:
    """One row per row: doc_id, held_out, lang_pred, score. Learns from the text and non-null lang of rows outside the fold;
    a null doc_id is not held out. See ``identify`` for texts without letters."""
    docs = pick(documents, doc_id="doc_id", text="text", lang="lang").withColumn("doc_id", F.col("doc_id").cast("long"))
    docs = docs.withColumn("held_out", held_out())
    model = train(docs.filter("not held_out").select("text", "lang"), how)
    return identify(docs, model, ("doc_id", "held_out"))
