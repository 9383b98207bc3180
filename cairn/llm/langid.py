"""Language of texts and of spans within them.

A word is a run of letters, with the marks that stand on them. Its script, found in a table of code-point ranges, leaves the languages that training texts write in
that script (all of them for a script never seen). Each remaining language scores the word by its letter triples, word ends
included, hashed to BUCKETS; a Viterbi pass over the words of a text, which pays SWITCH for changing language, labels each word,
and equal neighbours make a span. A document's language is the one with most letters.

Training texts are at most about MAX_TRAIN rows outside the evaluation fold (those with the least hash of their id); their
triples are counted per language in Spark and the table of counts (languages times BUCKETS) is the model.

Defined cases
    null text, no letter   und, score 0, no spans (marks alone are no letters)
    very long texts        read whole; a batch of texts is labelled in parts of about LETTERS characters, never cutting a text
    null lang or doc_id    lang null: not learned from; doc_id null: never held out, predicted like any
    no training rows       every text is und, score 0
    ties                   the language that comes first by code point
    repeated rows          predicted alike
    empty table            no rows
    extra columns          not returned
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import workspace as ws

#: Bound on labelled rows used for fitting.
MAX_TRAIN = 20_000
BUCKETS = 1 << 16
#: Price of changing language between two words, in nats.
SWITCH = 6.0
#: A language is a candidate for a script that at least this share of its training words is written in.
SCRIPT_SHARE = 0.005
#: Letters scored at a time.
LETTERS = 1 << 20

# First code point and name of ranges, each up to the next.
SCRIPTS = ((0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"), (0x900, "devanagari"), (0x980, "indic"), (0xE00, "thai"), (0xE80, "other"),
           (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE80, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"))


#: Set on marks, which may stand in a word beside its letters but make none.
MARK = np.uint32(1 << 31)


@functools.cache
def letters() -> np.ndarray:
    """The lower-case form of each code point that is a letter, that of a mark with MARK set, 0 for others."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            low = chr(c).lower()
            out[c] = (ord(low) if len(low) == 1 else c) | (int(MARK) if kind == "M" else 0)
    return out


_STARTS = np.array([a for a, _ in SCRIPTS], np.uint32)
SCRIPT_NAMES = sorted({n for _, n in SCRIPTS})
_IDS = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS])


def words_of(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of joined texts: bucket of each letter, first letter of each word (as a number of a letter), place and script of it, and
    the text of each word. A word never reaches into the next text."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(p) + 1 for p in points])
    low = np.zeros(int(sizes.sum()) + 1, np.uint32)
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1])) + 1
    table = letters()
    for at, p in zip(begins, points):
        read = table[p]
        if ((read != 0) & (read < MARK)).any():  # a text without any letter has no words
            low[at : at + len(p)] = read
    at = np.flatnonzero(low)
    if not len(at):
        return (np.empty(0, np.int64),) * 5
    with np.errstate(over="ignore"):
        h = (low[at - 1] * np.uint32(0x9E3779B1) ^ low[at]) * np.uint32(0x85EBCA6B) ^ (low[np.minimum(at + 1, len(low) - 1)] * np.uint32(0xC2B2AE35))
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    bucket = (h >> np.uint32(16)).astype(np.int64)
    first = np.flatnonzero(low[at - 1] == 0)
    place = at[first]
    script = _IDS[np.searchsorted(_STARTS, low[place] & ~MARK, side="right") - 1]
    of = np.searchsorted(begins, place, side="right") - 1
    return bucket, first, place - begins[of], script, of


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        """counts: language by bucket; scripts: language by script, in words."""
        self.langs = langs
        total = counts.sum(axis=1, keepdims=True)
        self.logp = np.ascontiguousarray(np.log((counts + 0.1) / (total + 0.1 * BUCKETS)).T.astype(np.float32))
        allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        allowed[:, ~allowed.any(axis=0)] = True
        self.barred = np.where(allowed.T, 0.0, -1e4).astype(np.float32)  # script by language

    def label(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """Language, score and spans of each text."""
        bucket, first, place, script, of = words_of(texts)
        out = [("und", 0.0, [])] * len(texts)
        if not len(first) or not self.langs:
            return out
        scores = np.add.reduceat(self.logp[bucket], first, axis=0) + self.barred[script]
        size = np.diff(np.concatenate((first, [len(bucket)])))
        starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        path = viterbi(scores, starts, np.diff(np.concatenate((starts, [len(of)]))))
        ends = np.concatenate((starts[1:], [len(of)]))
        for a, b in zip(starts, ends):
            weight = np.bincount(path[a:b], weights=size[a:b], minlength=len(self.langs))
            best = int(np.argmax(weight))
            mean = scores[a:b].sum(axis=0) / size[a:b].sum()
            rest = np.delete(mean, best)
            margin = 10 * float(mean[best] - rest.max()) if len(rest) else 10.0
            edge = np.flatnonzero(np.concatenate(([True], path[a + 1 : b] != path[a : b - 1])))
            last = np.concatenate((edge[1:], [b - a])) - 1
            spans = [(int(place[a + i]), int(place[a + j] + size[a + j]), self.langs[path[a + i]]) for i, j in zip(edge, last)]
            out[of[a]] = (self.langs[best], float(weight[best] / weight.sum() / (1 + np.exp(-max(-30.0, min(30.0, margin))))), spans)
        return out


def viterbi(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Best language of each word of many texts at once: step t takes the t-th word of all texts that have one."""
    order = np.argsort(-sizes, kind="stable")
    at, left = starts[order], sizes[order]
    path = np.zeros(len(scores), np.int64)
    value = np.zeros((len(at), scores.shape[1]), np.float32)
    came = np.zeros((len(scores), scores.shape[1]), bool)  # true: the best path into this state changed language here
    top = np.zeros(len(scores), np.int64)  # the state it came from then
    active = np.searchsorted(-left, -np.arange(int(left[0])) - 1, side="right")  # texts with more than t words
    for t, k in enumerate(active):
        here, v = at[:k] + t, value[:k]
        if t:
            best = v.argmax(axis=1)
            changed = v[np.arange(k), best][:, None] - SWITCH
            came[here] = v < changed
            top[here] = best
            np.maximum(v, changed, out=v)
            v -= changed
        v += scores[here]
    now = value.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        here = at[:k] + t
        path[here] = now[:k]
        if t:
            now[:k] = np.where(came[here, now[:k]], top[here], now[:k])
    return path


def training_rows(docs: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """text, lang of about `most` labelled rows outside the evaluation fold."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~ws.held_out(F.col("doc_id")))
    share = min(1.0, most / max(known.select("lang").count(), 1))
    return known.where(F.pmod(F.xxhash64(F.lit("lang"), F.coalesce(F.col("doc_id").cast("string"), F.col("text"))), F.lit(1_000_000)) < F.lit(int(1_000_000 * share))).select("text", "lang")


def fit(rows: DataFrame) -> Model:
    def count(frames):
        for pdf in frames:
            for lang, texts in pdf.groupby("lang").text:
                bucket, _, _, script, _ = words_of(list(texts))
                for kind, seen, size in (("triple", bucket, BUCKETS), ("script", script, len(SCRIPT_NAMES))):
                    n = np.bincount(seen, minlength=size)
                    at = np.flatnonzero(n)
                    yield pd.DataFrame({"lang": lang, "kind": kind, "at": at, "n": n[at]})

    counted = rows.mapInPandas(count, "lang string, kind string, at int, n bigint").groupBy("lang", "kind", "at").agg(F.sum("n").alias("n")).toPandas()  # languages times BUCKETS at most
    langs = sorted(counted.lang.unique())
    tables = {"triple": np.zeros((len(langs), BUCKETS)), "script": np.zeros((len(langs), len(SCRIPT_NAMES)))}
    for kind, t in tables.items():
        part = counted[counted.kind == kind]
        t[part.lang.map({lang: i for i, lang in enumerate(langs)}).to_numpy(int), part["at"].to_numpy(int)] = part.n.to_numpy()
    return Model(langs, tables["triple"], tables["script"])


def identify(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score, spans (begin, end in characters, lang) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found, part, held = [], [], 0
            for t in texts:
                part.append(t)
                held += len(t)
                if held > LETTERS:
                    found += shared.value.label(part)
                    part, held = [], 0
            found += shared.value.label(part) if part else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] if spans else [] for f in found], span)], names=["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double, spans array<struct<begin:int,end:int,lang:string>>")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    docs = ws.table(spark, sf_dir, "documents")
    return identify(docs, fit(training_rows(docs)), spans=False).select("doc_id", ws.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
