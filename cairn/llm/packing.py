"""Best-fit packing of token ids into sequences by a grouping genetic algorithm on islands.

Documents are encoded once, cut where they exceed a sequence, and staged with their ids. A piece as long as a sequence is one.
The others are dealt by hash into shards of about SHARD_ITEMS pieces, so no task ever holds more. Each shard is evolved on
several islands. An individual is a grouping of the shard's pieces into bins. Crossover takes the fullest bins of one parent
whole, keeps the bins of the other that share no piece with them, and best-fits the pieces of the rest in descending length;
mutation empties a few of the worst bins in the same way. Between epochs each island sends its best individuals to the next one
through a Spark join. Islands that have reached the bound ceil(tokens / length) stop, and where a shard's first island does so at
once, its others don't start. The few bins of each shard that stay
loosely filled are pooled and evolved once more, so shards cost no sequence each.

Defined cases
    null or empty text   the end id alone: a piece of one token
    very long texts      cut into pieces; texts come to a task, and pieces leave it, in batches of a few MB, or of one text
    null doc_id          packed like others, doc_id stays null
    repeated rows        each row has pieces of its own
    ties                 pieces of one length are ordered by their number; random choices are seeded by shard, island, epoch
    empty table          no rows
    extra columns        not returned
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import tokens
from cairn.llm import workspace as ws

LENGTH = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
SHARD_ITEMS = 4096
ISLANDS = 4
EPOCHS = 4
POPULATION = 8
GENERATIONS = 10
#: Bins filled below this share are pooled over shards and packed again.
LOOSE = 0.9
BATCH_BYTES = 16 << 20


def pieces(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, end_id: int = END_ID, memory: int = tokens.SHARED_BYTES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (of `width` bytes) of whole texts. memory: bytes of pieces that a worker process remembers."""
    import public_tokenizers

    path, job = tokenizer or public_tokenizers.path(TOKENIZER), uuid.uuid4().hex
    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "width": pa.int32(), "ids": pa.binary()}

    def run(batches):
        e = tokens.shared(path, job, memory)
        end = np.array([end_id], e.dtype).tobytes()
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = e.encode(text.as_py() or "") + end
                step = length * e.width
                for k in range(0, len(ids), step):
                    part = ids[k : k + step]
                    rows.append((doc_id, k // step, k // e.width, len(part) // e.width, zlib.crc32(tokens.wide(part, e.width)), e.width, part))
                    held += len(part)
                if held > BATCH_BYTES:
                    yield _batch(rows, kinds)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, kinds)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, width int, ids binary")


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds.values())], names=list(kinds))


# One individual: bin number of each piece, pieces in descending length.


def best_fit(lens: np.ndarray, items: np.ndarray, bins: np.ndarray, room: list[int], length: int) -> None:
    """Puts items (in descending length) each where it leaves least room; bins and room are changed in place."""
    open_ = sorted((r, b) for b, r in enumerate(room) if r > 0)
    for i in items.tolist():
        n = int(lens[i])
        at = bisect_left(open_, (n, -1))
        if at < len(open_):
            r, b = open_.pop(at)
        else:
            r, b = length, len(room)
            room.append(length)
        bins[i] = b
        room[b] = r - n
        if r > n:
            insort(open_, (r - n, b))


def packed(bins: np.ndarray) -> np.ndarray:
    """Bins numbered from 0 without gaps."""
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def fills(lens: np.ndarray, bins: np.ndarray) -> np.ndarray:
    return np.bincount(bins, weights=lens).astype(np.int64)


def merit(lens: np.ndarray, bins: np.ndarray, length: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: smaller is better."""
    fill = fills(lens, bins)
    return len(fill), -float(np.mean((fill / length) ** 2))


def rebuilt(lens: np.ndarray, kept: np.ndarray, length: int) -> np.ndarray:
    """The grouping `kept` (-1: displaced) with the displaced pieces best-fitted."""
    free = np.flatnonzero(kept < 0)
    out = np.full(len(lens), -1, np.int32)
    out[kept >= 0] = packed(kept[kept >= 0]) if (kept >= 0).any() else 0
    room = (length - fills(lens[kept >= 0], out[kept >= 0])).tolist() if (kept >= 0).any() else []
    best_fit(lens, free, out, room, length)
    return out


def crossed(lens: np.ndarray, a: np.ndarray, b: np.ndarray, length: int, rng: np.random.Generator) -> np.ndarray:
    fill = fills(lens, a)
    best = np.argsort(-fill + rng.random(len(fill)), kind="stable")[: max(1, int(len(fill) * rng.uniform(0.3, 0.7)))]
    injected = np.isin(a, best)
    spoiled = np.isin(b, np.unique(b[injected]))
    kept = np.where(injected, a, np.where(spoiled, -1, b + len(fill)))
    return rebuilt(lens, kept, length)


def mutated(lens: np.ndarray, a: np.ndarray, length: int, rng: np.random.Generator) -> np.ndarray:
    fill = fills(lens, a)
    worst = np.argsort(fill + rng.random(len(fill)) * length * 0.2, kind="stable")[: max(2, len(fill) // 20)]
    return rebuilt(lens, np.where(np.isin(a, worst), -1, a), length)


def first_population(lens: np.ndarray, length: int, size: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Best fit in descending order, and others whose order is shaken a little."""
    out = []
    for k in range(size):
        order = np.argsort(-lens * rng.uniform(0.8, 1.2, len(lens)), kind="stable") if k else np.arange(len(lens))
        bins = np.full(len(lens), -1, np.int32)
        best_fit(lens, order, bins, [], length)
        out.append(bins)
        if not k and merit(lens, bins, length)[0] <= -(-int(lens.sum()) // length):
            break
    return out


def evolve(lens: np.ndarray, population: list[np.ndarray], length: int, rng: np.random.Generator, generations: int, size: int) -> list[np.ndarray]:
    """Best first, at most `size` of them."""
    least = -(-int(lens.sum()) // length)
    ranked = sorted(population, key=lambda x: merit(lens, x, length))[:size]
    for _ in range(generations):
        if merit(lens, ranked[0], length)[0] <= least:
            break
        children = [mutated(lens, ranked[0], length, rng)]
        while len(ranked) > 1 and len(children) < size:
            i, j = rng.choice(len(ranked), 2, replace=False)
            children.append(crossed(lens, ranked[i], ranked[j], length, rng))
        ranked = sorted(ranked + children, key=lambda x: merit(lens, x, length))[:size]
    return ranked


def _island_step(length: int, epoch: int, seed: int):
    """mapInPandas over islands: (shard, island, lens, population) to the same after an epoch."""

    def run(frames):
        for pdf in frames:
            made = []
            for shard, island, lens, population in zip(pdf.shard, pdf.island, pdf.lens, pdf.population):
                lens = np.asarray(lens, np.int64)
                rng = np.random.default_rng([seed, int(shard), int(island), epoch])
                held = [np.frombuffer(x, np.int32) for x in population] if population is not None and len(population) else first_population(lens, length, POPULATION, rng)
                best = evolve(lens, held, length, rng, GENERATIONS, POPULATION)
                made.append(([x.astype(np.int32).tobytes() for x in best], *merit(lens, best[0], length)))
            yield pdf.assign(population=[m[0] for m in made], n_bins=[m[1] for m in made], slack=[m[2] for m in made])[["shard", "island", "lens", "population", "n_bins", "slack"]]

    return run


def migrated(state: DataFrame) -> DataFrame:
    """shard, island, lens, population: each island with the best individual of the one before it."""
    elites = state.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.slice("population", 1, 1).alias("elites"))
    return state.join(elites, ["shard", "island"]).select("shard", "island", "lens", F.concat("elites", "population").alias("population"))


def _grouped(items: DataFrame, length: int, seed: int, items_per_shard: int) -> tuple[DataFrame, list[str]]:
    """pid, length, shard, bin, offset, fill of items (pid, length): the islands' best grouping of each shard."""
    spark = items.sparkSession
    n = items.count()
    shards = max(1, -(-n // items_per_shard))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("pid", F.lit(seed)), F.lit(shards)).cast("int"))
    held = F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("l"), "pid")))
    start, start_path = ws.stage(dealt.groupBy("shard").agg(held.alias("held")).select("shard", F.expr("transform(held, x -> cast(-x.l as int))").alias("lens"), F.expr("transform(held, x -> x.pid)").alias("pids")), "pack-shards")
    schema = "shard int, island int, lens array<int>, population array<binary>, n_bins int, slack double"
    step = lambda state, epoch: state.select("shard", "island", "lens", "population").mapInPandas(_island_step(length, epoch, seed), schema)
    new = F.lit(None).cast("array<binary>").alias("population")
    # the first island of each shard goes ahead: where it reaches the bound, nothing is left to search for
    ahead, ahead_path = ws.stage(step(start.select("shard", F.lit(0).alias("island"), "lens", new).repartition(max(1, min(shards, 2000)), "shard"), 0), "pack-islands")
    bound = F.ceil(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x) / F.lit(length))
    done, open_ = ahead.where(F.col("n_bins") <= bound), ahead.where(F.col("n_bins") > bound)
    others = open_.select("shard", F.explode(F.array(*[F.lit(i) for i in range(1, ISLANDS)])).alias("island"), "lens", new).repartition(max(1, min(shards, 2000)), "shard", "island")
    state, path = ws.stage(open_.unionByName(step(others, 0)), "pack-islands")
    paths = [start_path, ahead_path, path]
    for epoch in range(1, EPOCHS):
        state, path = ws.stage(step(migrated(state), epoch), "pack-islands")
        paths.append(path)

    def lay(frames):
        import pandas as pd

        for pdf in frames:
            for shard, lens, pids, best in zip(pdf.shard, pdf.lens, pdf.pids, pdf.best):
                lens, best = np.asarray(lens, np.int64), np.frombuffer(best, np.int32)
                order = np.argsort(best, kind="stable")
                b, l = best[order], lens[order]
                before = np.concatenate(([0], np.cumsum(l)[:-1]))
                first = np.concatenate(([True], b[1:] != b[:-1]))
                yield pd.DataFrame({"shard": np.int32(shard), "pid": np.asarray(pids, np.int64)[order], "length": l, "bin": b.astype(np.int32), "offset": before - before[first][np.cumsum(first) - 1], "fill": fills(lens, best)[b]})

    best = done.unionByName(state).groupBy("shard").agg(F.min_by(F.col("population")[0], F.struct("n_bins", "slack", "island")).alias("best"))
    return best.join(start, "shard").mapInPandas(lay, "shard int, pid bigint, length bigint, bin int, offset bigint, fill bigint"), paths


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, end_id: int = END_ID, items_per_shard: int = SHARD_ITEMS, memory: int = tokens.SHARED_BYTES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids, width, sequence_id, offset of every piece of docs. memory: see pieces, no matter
    for the result."""
    spark = docs.sparkSession
    with ws.small_batches(spark):
        cut, _ = ws.stage(pieces(docs, length, tokenizer, end_id, memory).withColumn("pid", F.monotonically_increasing_id()), "pack-pieces")
    whole = cut.where(F.col("length") == length).select("pid", F.col("pid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.where(F.col("length") < length).select("pid", "length")
    first, paths = _grouped(rest, length, 1, items_per_shard)
    first, first_path = ws.stage(first, "pack-first")
    loose = first.where(F.col("fill") < F.lit(LOOSE * length)).select("pid", "length")
    second, more = _grouped(loose, length, 2, items_per_shard)
    second, _ = ws.stage(second, "pack-second")
    ws.drop(spark, *paths, *more)
    named = lambda df, k: df.select("pid", (-(F.col("shard").cast("long") * 2 + k) * (1 << 20) - F.col("bin") - 1).alias("sequence_id"), "offset")
    placed = whole.unionByName(named(first.where(F.col("fill") >= F.lit(LOOSE * length)), 0)).unionByName(named(second, 1))
    return cut.join(placed, "pid").select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "width", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack(ws.table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
