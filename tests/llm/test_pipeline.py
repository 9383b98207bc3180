"""The stages of the corpus pipeline: columns, counts, toxic documents, odd rows and no rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import packing, tokens
from cairn.llm import workspace as ws
from tests.conftest import SF

STAGES = dict(corpus_pipeline.STAGES)


def ids(df, column="doc_id"):
    return Counter(r[0] for r in df.select(column).collect())


def test_stages(spark):
    docs = ws.table(spark, SF, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, _ = ws.stage(stage(spark, docs, SF), "t")
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > sizes[2] > sizes[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.where("piece = 0").count() == sizes[-1]
    assert last.groupBy("sequence_id").sum("length").where(f"`sum(length)` > {packing.LENGTH}").count() == 0


def test_toxicity_stage_takes_the_toxic_and_leaves_the_clean(spark):
    """Recall and false positives over labelled rows of the fold that nothing was learned from."""
    at = SF.replace("0.001", "0.1")
    docs, labels = ws.table(spark, at, "documents"), ws.table(spark, at, "labels")
    left = ids(STAGES["toxicity"](spark, docs, at))
    known = labels.where(ws.held_out(F.col("doc_id"))).join(docs.select("doc_id").distinct(), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).collect()
    toxic, clean = ([r["doc_id"] for r in known if r["toxic"] == t] for t in (1, 0))
    assert sum(d not in left for d in toxic) >= 0.85 * len(toxic) > 0
    assert sum(d not in left for d in clean) <= 0.02 * len(clean)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties and columns with clashing names."""
    some = " ".join(f"word{i}" for i in range(40))
    rows = [(1, None, "en", "web", 0), (2, "", "en", "web", 0), (3, some, None, None, None), (None, some + " more", "en", "web", 9), (None, None, None, None, None), (4, some, "en", "web", 9), (4, some, "en", "web", 9), (5, "x" * 300_000, "en", "books", 9), (6, " ".join(f"t{i}" for i in range(60_000)), "en", "books", 9)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return made.select("*", F.lit("mine").alias("score"), F.lit(1).alias("kept"), F.lit(2).alias("key"), F.lit(3).alias("node"), F.lit(4).alias("__mine"))


def test_stages_on_odd_rows(spark, odd):
    docs, _ = ws.stage(odd, "t")
    for name in ("toxicity", "quality rules", "near-duplicates", "mixing"):
        kept, _ = ws.stage(STAGES[name](spark, docs, SF), "t")
        assert kept.columns == docs.columns, name
        assert not ids(kept) - ids(docs) or name == "mixing"
    kept = ids(STAGES["near-duplicates"](spark, docs, SF))
    assert kept[3] + kept[4] == 1 and kept[1] == kept[2] == kept[5] == kept[6] == 1  # texts of no words are linked with nothing
    packed = STAGES["packing"](spark, docs, SF)
    assert ids(packed.where("piece = 0")) == ids(docs)
    assert packed.where("doc_id = 6").agg(F.max("piece")).first()[0] > 20
    assert packed.groupBy("sequence_id").sum("length").where(f"`sum(length)` > {packing.LENGTH}").count() == 0


def test_packing_after_other_stages_remembers_few_pieces(spark, odd, monkeypatch):
    """And what a worker remembers doesn't matter for the ids."""
    given, real = [], packing.pack
    monkeypatch.setattr(packing, "pack", lambda docs, **how: given.append(how) or real(docs, **how))
    assert STAGES["packing"](spark, odd.limit(3), SF).count() == 3 and given == [{"memory": tokens.REMEMBERED_BYTES}]
    few, many = (Counter(packing.pieces(odd, memory=m).select("doc_id", "piece", "length", "ids_crc32").collect()) for m in (2_000, tokens.SHARED_BYTES))
    assert few == many and sum(few.values()) > 20


def test_stages_on_no_documents(spark):
    docs = ws.table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs, _ = ws.stage(stage(spark, docs, SF), "t")
    assert docs.count() == 0
