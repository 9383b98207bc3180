"""Toxicity of documents: gradient-boosted trees over dense features of the text, calibrated by isotonic regression.

Features are densities of lexicon words (a short fixed list, and words and word beginnings learned from labelled texts), how
close they stand to the second person, rates of capitals, punctuation and exclamation marks, and rates of obfuscated words
(digits or signs between letters, stretched letters), with hits that appear once the obfuscation is undone.

Labels come from rows outside the evaluation fold (`workspace.held_out`). At most about MAX_TRAIN of them are used, those with
the least hash of their id; another hash splits them: one half teaches the lexicon, a quarter the trees and a quarter the calibration, so
none of the three sees what an earlier one was fitted to. Every document is then scored whole. doc_id only deals out rows.

Defined cases
    null or empty text      all features 0, scored like any
    very long texts         read whole, word by word; a word of any length is counted whole
    null doc_id or label    not used for training, but scored
    several labels of an id toxic if any says so
    too few labels          without both labels in some part, all rows serve all three; without both at all, every score is 0
    repeated rows           scored alike
    ties                    equal features give equal scores; a score of exactly THRESHOLD is toxic
    empty table             no rows
    extra columns           kept by score(); the added ones start with two underscores
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import workspace as ws

#: Bound on labelled rows used for fitting.
MAX_TRAIN = 24_000
THRESHOLD = 0.7
TREES, DEPTH, STEP = 20, 4, 0.2
#: A learned term stands in at least so many and such a share of toxic texts, this much more often (log of the smoothed ratio)
#: than in others: rarer terms of a small sample tell of chance. As texts are MAX_TRAIN at most, MIN_SHARE also bounds how many there are.
MIN_TOXIC, MIN_SHARE, MIN_LOG_ODDS = 3, 0.02, 2.5
#: Bytes that one task's memory of chunks may take.
REMEMBERED_BYTES = 24 << 20
NEAR = 6

# Insults and second-person words.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown fool jerk creep vermin filth".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton vous votre usted tus vosotros".split())

_UNDO = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": "", "#": "", "%": "", "&": ""})
_STRETCH = re.compile(r"(.)\1{2,}")
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’…¿¡"
_INNER = re.compile(r"[^\W\d_][^\w\s'’\-]+[^\W\d_]|[^\W\d_]\d+[^\W\d_]")

FEATURES = ("words", "fixed_density", "learned_density", "begun_density", "hits", "strength", "strongest", "you_density", "near_you", "capitals", "shouted", "punctuation", "exclaimed", "obfuscated", "undone_density")


def terms_of(chunk: str) -> list[str]:
    """The bare word of a chunk, and its beginnings (marked by a star)."""
    word = chunk.strip(_EDGES).lower()
    return [word, *(f"{word[:n]}*" for n in range(3, 9) if len(word) > n)] if word else []


class Codes(dict):
    """One integer for each chunk of a text: bits 0-6 flags, then counts in fields of 8 bits (see `tally`), then the weight. Chunks
    of LONG characters or more carry no counts. Kept within REMEMBERED_BYTES: once full, it starts anew."""

    LONG = 256

    def __init__(self, learned: dict[str, float]):
        super().__init__()
        self.whole = {t: w for t, w in learned.items() if not t.endswith("*")}
        self.begun = {t[:-1]: w for t, w in learned.items() if t.endswith("*")}
        self.held = 0

    def __missing__(self, chunk: str) -> int:
        word = chunk.strip(_EDGES).lower()
        whole, begun = self.whole.get(word, 0.0), max([self.begun.get(word[:n], 0.0) for n in range(3, min(9, len(word)))], default=0.0)
        odd = bool(not chunk.isalpha() and _INNER.search(chunk)) or bool(_STRETCH.search(word))
        plain = _STRETCH.sub(r"\1", chunk.lower().translate(_UNDO)).strip(_EDGES) if odd else word
        undone = odd and (plain in INSULTS or self.whole.get(plain, 0) > 0)
        letters, upper, marks, exclaimed = tally(chunk)
        code = (word in INSULTS) | (whole > 0) << 1 | (begun > 0) << 2 | (word in SECOND_PERSON) << 3 | odd << 4 | undone << 5 | (upper == letters > 1) << 6
        if len(chunk) < self.LONG:
            code |= letters << 8 | upper << 16 | marks << 24 | exclaimed << 32
        code |= int(min(max(whole, begun), 20) * 1000) << 40
        if len(chunk) <= 48:
            size = 136 + 4 * len(chunk)
            self.held += size
            if self.held > REMEMBERED_BYTES:
                self.clear()
                self.held = size
            self[chunk] = code
        return code


def tally(chunk: str) -> tuple[int, int, int, int]:
    """Letters, capitals, marks and exclamation marks of a chunk."""
    if chunk.isalpha() and chunk.islower():
        return len(chunk), 0, 0, 0
    return sum(map(str.isalpha, chunk)), sum(map(str.isupper, chunk)), len(chunk) - sum(map(str.isalnum, chunk)), chunk.count("!")


def features(text: str | None, codes: Codes) -> list[float]:
    """FEATURES of a whole text."""
    chunks = text.split() if text else []
    n = len(chunks)
    if not n:
        return [0.0] * len(FEATURES)
    c = np.fromiter(map(codes.__getitem__, chunks), np.int64, n)
    flag = lambda k: (c >> k) & 1
    at, you = np.flatnonzero((c & 0b100111) > 0), np.flatnonzero(flag(3))
    near = 0.0
    if len(at) and len(you):
        k = np.searchsorted(you, at)
        gap = np.minimum(np.abs(at - you[np.minimum(k, len(you) - 1)]), np.abs(at - you[np.maximum(k - 1, 0)]))
        near = float((gap <= NEAR).mean())
    counts = [int(((c >> k) & 255).sum()) for k in (8, 16, 24, 32)]
    if len(text) >= Codes.LONG + n - 1:  # else no chunk can be so long
        for chunk in chunks:
            if len(chunk) >= Codes.LONG:
                counts = [a + b for a, b in zip(counts, tally(chunk))]
    letters, upper, marks, exclaimed = counts
    weight = (c >> 40) / 1000.0
    per = 100.0 / n
    return [
        float(np.log1p(n)), flag(0).sum() * per, flag(1).sum() * per, flag(2).sum() * per, float(np.log1p(len(at))), float(weight.sum()) * per, float(weight.max()), flag(3).sum() * per, near,
        upper / max(letters, 1), flag(6).sum() * per, marks / max(letters + marks, 1), exclaimed * per, flag(4).sum() * per, flag(5).sum() * per,
    ]


def featured(docs: DataFrame, learned: dict[str, float]) -> DataFrame:
    """docs with __features. Only the text goes to Python; what a task remembers goes with it."""

    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codes = Codes(learned)
        for texts in batches:
            yield pd.Series([[float(x) for x in features(t, codes)] for t in texts])

    return docs.withColumn("__features", of("text"))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """text, toxic, part of about `most` labelled rows outside the evaluation fold."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~ws.held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000))
    known = known.where(place < F.lit(int(1_000_000 * min(1.0, most / max(n, 1))))).withColumn("part", F.greatest(F.lit(0), F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(4)).cast("int") - 1))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic", "part")  # about `most` rows


def learn_terms(rows: DataFrame) -> dict[str, float]:
    """Terms that toxic texts have and others don't, with the log of how much more often."""
    def count(frames):
        for pdf in frames:
            for toxic, texts in pdf.groupby("toxic").text:
                seen = Counter()
                for text in texts:
                    seen.update({t for chunk in set((text or "").split()) for t in terms_of(chunk)})
                yield pd.DataFrame({"term": list(seen), "toxic": int(toxic), "n": list(seen.values())})

    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}  # two rows
    odds = F.log((F.col("t") + 0.5) / (n.get(1, 0) + 1)) - F.log((F.col("c") + 0.5) / (n.get(0, 0) + 1))
    counted = rows.select("text", "toxic").mapInPandas(count, "term string, toxic int, n bigint").groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    best = counted.where(F.col("t") >= max(MIN_TOXIC, MIN_SHARE * n.get(1, 0))).withColumn("w", odds).where(F.col("w") >= MIN_LOG_ODDS)
    return {r["term"]: float(r["w"]) for r in best.collect()}  # at most (terms of a text) / MIN_SHARE of them


def score(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """docs with __score and __toxic."""
    spark = docs.sparkSession
    rows, rows_path = ws.stage(training_rows(docs, labels, most), "tox-rows")
    seen = {(r["part"], r["toxic"]) for r in rows.select("part", "toxic").distinct().collect()}  # six at most
    if {t for _, t in seen} != {0, 1}:
        return docs.withColumn("__score", F.lit(0.0)).withColumn("__toxic", F.lit(False))
    part = (lambda k: rows.where(F.col("part") == k)) if len(seen) == 6 else (lambda k: rows)
    learned = learn_terms(part(0))
    ready = lambda df: featured(df, learned).withColumn("__x", array_to_vector("__features"))
    train, train_path = ws.stage(ready(part(1)).select(F.col("__x").alias("features"), F.col("toxic").cast("double").alias("label")), "tox-train")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7, featuresCol="features", labelCol="label").fit(train.coalesce(4))
    trees.setFeaturesCol("__x").setRawPredictionCol("__raw").setProbabilityCol("__p").setPredictionCol("__hard")
    likely = lambda df: trees.transform(df).withColumn("__likely", vector_to_array("__p")[1]).drop("__raw", "__p", "__hard", "__x", "__features")
    calibrated = IsotonicRegression(featuresCol="__likely", labelCol="label", predictionCol="__iso").fit(likely(ready(part(2))).select("__likely", F.col("toxic").cast("double").alias("label")))
    ws.drop(spark, rows_path, train_path)
    # steps of the calibration keep the order of the trees within them
    out = calibrated.transform(likely(ready(docs))).withColumn("__score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.99 * F.col("__iso") + 0.01 * F.col("__likely"))))
    return out.drop("__iso", "__likely").withColumn("__toxic", F.col("__score") >= THRESHOLD)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return ws.only(score(docs, labels), ~F.col("__toxic")).select(*docs.columns)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(ws.table(spark, sf_dir, "documents"), ws.table(spark, sf_dir, "labels"))
    return scored.select("doc_id", ws.held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), F.col("__toxic").cast("int").alias("predicted"))
