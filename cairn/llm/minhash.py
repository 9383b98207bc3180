"""Near-duplicate documents by circulant MinHash, banding and exact verification.

Signatures. Each distinct five-word shingle is one 64-bit hash, folded to a universe of UNIVERSE places. Of two permutations of
it, sigma shuffles the places once, and pi, circularly shifted by k, gives coordinate k: min over shingles of
pi((sigma(x) + k) mod UNIVERSE). All ROWS * BANDS coordinates come from the pair: those of one place are neighbours in pi. BANDS = 50 bands of ROWS = 8 miss a pair of similarity 0.85
with probability (1 - 0.85^8)^50 = 1.3e-7, while pairs below 0.3 meet in a band with probability below 0.4 percent.

Links. Texts with equal shingle sets are one node. Round one pairs each node of a bucket with PIVOTS of the bucket, the node that
keeps most company over all its buckets (the middle of a group of copies, if there is one) and some chosen by hash, verifies those
pairs on the full sets and joins nodes into components. Round two takes the nodes of buckets that still span several components and
joins them on the shingles of their prefixes. A prefix is the rarest 15 percent of a set, and one: in an order that is the same for
all, two sets of similarity 0.85 or more share a shingle of their prefixes. Counts in a table of COUNTS places, made over all sets
that share a bucket, tell rare from frequent; collisions there cost time, not links. Of the nodes that share such a shingle, those of
the component that has most of them there are paired with the others only, not with each other, so a group of m copies in one
component costs m pairs and not their square; Spark may split the join of a shingle that many share.

Two tests, both exact, rule out pairs before their sets are compared: sizes, and a parity sketch that holds, for each of 1024 classes
of shingles, whether a set has an odd number of them (two sets differ by at least as many shingles as their sketches by bits). After
round two every pair that shares a bucket is linked, refuted, or inside one component. No bucket is capped.

What is shuffled. Nodes go by a number, not by their digest. Sizes and sketches are kept apart for nodes that share a bucket, which are
few. Of their texts the text is shuffled, once, to drop repeated rows; their sets only to be verified, in round two only those that a pair names.

Components are found by label propagation with pointer jumping: joins and minima, staged after each round.

Defined cases
    null, empty text, no words   set size 0: linked with nothing, its own component
    fewer than five words        the whole sequence is the one shingle
    repeated rows                equal sets, hence one component; each row is returned
    null doc_id                  linked as any, but never names a component unless all of it is null; kept only then
    empty table                  no rows
    extra columns                not returned by components(), kept by keep_one()
"""

from __future__ import annotations

import functools
import hashlib
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import workspace as ws

SHINGLE = 5
ROWS = 8
BANDS = 50
#: Documents are linked where 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Round one only saves work for round two, which settles every pair that is left: a few pivots are enough.
PIVOTS = 3
UNIVERSE = 1 << 20
COUNTS = 1 << 18
#: Longs of a set's parity sketch.
_PARITY = [f"p{k}" for k in range(16)]
#: Shingles are permuted in blocks of so many.
BLOCK = 512
#: Up to so many row keys, those of the texts to verify are broadcast (about 100 bytes each, 50 MB); beyond, a table of KEY_BITS bits is,
#: and the texts that it can't rule out are shuffled to the keys, with the same rows.
BROADCAST_ROWS = 500_000
#: 16 MB, for tables of any size.
KEY_BITS = 1 << 27

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lowered."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, text.encode("utf-8", "surrogatepass").translate(_LOWER).split()), np.uint64)


_MULT = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    words = word_hashes(text) if text else np.empty(0, np.uint64)
    if not len(words):
        return words
    n = max(1, len(words) - SHINGLE + 1)
    mixed = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        mixed = (mixed ^ words[k : k + n]) * _MULT
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed ^ np.uint64(min(len(words), SHINGLE)))


@functools.cache
def permutations(size: int) -> tuple[np.ndarray, np.ndarray]:
    """sigma, and pi as a view whose row j holds pi(j), pi(j + 1), ... around the circle."""
    rng = np.random.default_rng(20240229)
    sigma, pi = (rng.permutation(UNIVERSE).astype(np.uint32) for _ in range(2))
    return sigma, np.lib.stride_tricks.sliding_window_view(np.concatenate((pi, pi[: size - 1])), size)


def signature(shingles: np.ndarray, size: int = ROWS * BANDS) -> np.ndarray:
    """Coordinate k: min of pi((sigma(x) + k) mod UNIVERSE)."""
    sigma, shifted = permutations(size)
    places = sigma[(shingles ^ (shingles >> np.uint64(32))) & np.uint64(UNIVERSE - 1)]
    out = np.full(size, UNIVERSE, np.uint32)
    for at in range(0, len(places), BLOCK):
        np.minimum(out, shifted[places[at : at + BLOCK]].min(axis=0), out=out)
    return out


def bands_of(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, its number mixed in."""
    mixed = np.arange(1, BANDS + 1, dtype=np.uint64) * _MULT
    for column in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
        mixed = (mixed ^ column) * _MULT
        mixed ^= mixed >> np.uint64(31)
    return mixed.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key, n, digest (of the set; null: empty), bands, p0..p15 (the parity sketch) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))] + [(p, pa.int64()) for p in _PARITY])

    def run(batches):
        for batch in batches:
            ns, digests, bands, odd = [], [], [], []
            for text in batch.column(2):
                s = shingle_hashes(text.as_py())
                ns.append(len(s))
                odd.append(parity_of(s))
                if len(s):
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    bands.append(bands_of(signature(s)))
                else:
                    digests.append(None)
                    bands.append(None)
            words = np.array(odd, np.int64).reshape(len(ns), len(_PARITY))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), *[pa.array(words[:, k]) for k in range(len(_PARITY))]], schema=schema)

    spark_schema = "doc_id bigint, key binary, n bigint, digest binary, bands array<bigint>, " + ", ".join(f"{p} bigint" for p in _PARITY)
    return keyed(docs).mapInArrow(run, spark_schema)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with key: a digest of id and text, which a second pass over the table finds again however its files are split."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), "text")


def row_key():
    text = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit("")))
    return F.unhex(F.md5(text.cast("binary")))


def maybe_among(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """rows with __maybe, which is false only where key is none of keys."""
    place = F.pmod(F.xxhash64(key), F.lit(KEY_BITS))
    parts = keys.select(place.alias("__at")).groupBy(F.bitmap_bucket_number("__at").alias("__part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__at")).alias("__bits"))
    bit = F.bitmap_bit_position("__at")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    placed = rows.withColumn("__at", place).withColumn("__part", F.bitmap_bucket_number("__at")).join(F.broadcast(parts), "__part", "left")
    return placed.withColumn("__maybe", F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))).drop("__at", "__part", "__bits")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """node, s (its shingle hashes) of a frame (node, text)."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_hashes(t.as_py()).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))], names=["node", "s"])

    return texts.mapInArrow(run, "node bigint, s array<bigint>")


def _longs(scalar) -> np.ndarray:
    return scalar.values.to_numpy(zero_copy_only=False)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = _longs(x), _longs(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("s").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("s").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How many sets hold a shingle of each place of a table of fixed size."""

    def run(batches):
        seen = np.zeros(COUNTS, np.int64)
        for batch in batches:
            seen += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False) & (COUNTS - 1), minlength=COUNTS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["at", "n"])

    table = np.zeros(COUNTS, np.int64)
    for r in sets.select("s").mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():  # COUNTS rows at most
        table[r["at"]] = r["n"]
    return table


def parity_of(s: np.ndarray) -> np.ndarray:
    """Bit k: the set has an odd number of shingles of class k."""
    classes = 64 * len(_PARITY)
    odd = np.bincount(((s.view(np.uint64) * _MULT) >> np.uint64(40)).astype(np.int64) % classes, minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefixes(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """node, token of sets (node, s): the rarest shingles, of which similar sets share one."""
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        for batch in batches:
            nodes, tokens = [], []
            for node, s in zip(batch.column(0), batch.column(1)):
                s = _longs(s)
                least = -(-PERCENT * len(s) // 100)
                tokens.append(s[np.lexsort((s, shared.value[s & (COUNTS - 1)]))[: len(s) - least + 1]])
                nodes += [node.as_py()] * len(tokens[-1])
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.concatenate(tokens))], names=["node", "token"])

    return sets.select("node", "s").mapInArrow(run, "node bigint, token bigint")


def _close(x: str, y: str):
    """Sizes and parity leave the pair possible: sets that differ by d shingles are similar enough only if (100 + PERCENT) * d <=
    (100 - PERCENT) * (sum of their sizes)."""
    fits = (100 * F.col(f"{x}.n") >= PERCENT * F.col(f"{y}.n")) & (100 * F.col(f"{y}.n") >= PERCENT * F.col(f"{x}.n"))
    differ = functools.reduce(operator.add, [F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in _PARITY])
    return fits & ((100 + PERCENT) * differ <= (100 - PERCENT) * (F.col(f"{x}.n") + F.col(f"{y}.n")))


def pairs_across(tokens: DataFrame, roots: DataFrame, info: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of nodes of different components that share a token and may be similar enough. tokens (node, token),
    roots (node, root), info (node, n, p0..p15)."""
    spark = tokens.sparkSession
    owned, owned_path = ws.stage(tokens.join(roots, "node").select("token", "node", "root"), "mh-tokens")
    of = owned.groupBy("token", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("token").agg(F.max(F.struct("m", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    shared, shared_path = ws.stage(owned.join(of.select("token", "main"), "token").join(info, "node"), "mh-shared-tokens")
    x, y = shared.where(F.col("root") != F.col("main")).alias("x"), shared.alias("y")
    # of two nodes outside the main component either comes first once
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
    found = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & once & _close("x", "y"))
    pairs, _ = ws.stage(found.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "mh-pairs")
    ws.drop(spark, owned_path, shared_path)
    return pairs


def components(links: DataFrame) -> DataFrame:
    """node, root of every node of links (a, b): the least node of its component. Each round lowers labels to the least among
    neighbours and then to that label's own label; it ends when no label moves."""
    spark = links.sparkSession
    both, edges = ws.stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels, held = ws.stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "cc-labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(heard, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        step, path = ws.stage(lower.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("far", "root")).alias("root")), "cc-labels")
        moved = step.where("was <> root").limit(1).count()
        ws.drop(spark, held)
        labels, held = step.select("node", "root"), path
        if not moved:
            ws.drop(spark, edges)
            return labels


def resolve(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, key, n, digest of every row; and for each digest that has copies or links its component_id and the key of the one row
    that stays (of the smallest id)."""
    spark = docs.sparkSession
    rows, _ = ws.stage(sketches(docs), "mh-sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "key")).alias("f")
    grouped = rows.where("digest is not null").groupBy("digest").agg(first, F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"), *[F.first(p).alias(p) for p in _PARITY])
    nodes, nodes_path = ws.stage(grouped.withColumn("node", F.monotonically_increasing_id()), "mh-nodes")
    buckets = nodes.select("node", F.explode("bands").alias("key"))
    shared, shared_path = ws.stage(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "mh-shared")
    members, members_path = ws.stage(buckets.join(shared.hint("merge"), "key"), "mh-members")
    company = members.groupBy("node").agg(F.sum("m").alias("company"))
    chosen = (F.max(F.struct("company", "node"))["node"], *[F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(PIVOTS - 1)])
    pivots = members.join(company, "node").groupBy("key").agg(F.array_distinct(F.array(*chosen)).alias("p")).select("key", F.explode("p").alias("pivot"))
    pivots, pivots_path = ws.stage(pivots, "mh-pivots")
    wanted, wanted_path = ws.stage(members.select("node").distinct().join(nodes.select("node", F.col("f.key").alias("key"), "n", *_PARITY), "node"), "mh-wanted")
    info = wanted.select("node", "n", *_PARITY)
    star = members.join(pivots, "key").where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    star = star.join(info.alias("x"), F.col("a") == F.col("x.node")).join(info.alias("y"), F.col("b") == F.col("y.node")).where(_close("x", "y")).select("a", "b")
    star, star_path = ws.stage(star, "mh-star")
    of_key = wanted.select("key", "node")
    texts = keyed(docs.select("doc_id", "text"))
    few = of_key.count() <= BROADCAST_ROWS
    texts = (texts.join(F.broadcast(of_key), "key") if few else maybe_among(texts, "key", of_key).where("__maybe").join(of_key, "key")).select("node", "text")
    sets, sets_path = ws.stage(shingle_sets(texts.dropDuplicates(["node"])), "mh-sets")
    links, links_path = ws.stage(verified(star, sets), "mh-links")
    roots = components(links)
    labelled = members.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    opened, opened_path = ws.stage(labelled.join(mixed, "key").select("node", "root").distinct(), "mh-opened")
    pairs = pairs_across(prefixes(sets, shingle_counts(sets)), opened, info)
    rest, rest_path = ws.stage(pairs.join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "mh-rest")
    # staged, as Spark splits the join of a node in many pairs only where no other join stands below it
    named, named_path = ws.stage(sets.join(rest.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi"), "mh-named")
    more, more_path = ws.stage(verified(rest, named), "mh-more")
    if more.limit(1).count():
        roots = components(links.unionByName(more))
    least = roots.join(nodes.select("node", "f"), "node").groupBy("root").agg(F.min("f").alias("f"))
    named = roots.join(least, "root").select("node", F.col("f").alias("least"))
    final = nodes.select("digest", "node", "f", "copies").join(named, "node", "left").where("copies > 1 or least is not null").withColumn("least", F.coalesce("least", "f"))
    final, _ = ws.stage(final.select("digest", F.col("least.doc_id").alias("component_id"), F.col("least.key").alias("stays")), "mh-final")
    ws.drop(spark, nodes_path, wanted_path, shared_path, pivots_path, members_path, star_path, sets_path, links_path, opened_path, rest_path, named_path, more_path)
    return rows.select("doc_id", "key", "n", "digest"), final


def find_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    with ws.small_batches(docs.sparkSession):
        rows, final = resolve(docs)
    out = rows.join(final.withColumn("found", F.lit(True)), "digest", "left")
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component. Of rows that are equal in id and text any one stays: each task sends one."""
    with ws.small_batches(docs.sparkSession):
        rows, final = resolve(docs)
    judged = rows.join(final, "digest").groupBy("key").agg(F.first(F.col("key") == F.col("stays")).alias("__stays"), (F.count(F.lit(1)) > 1).alias("__several"))
    judged, _ = ws.stage(judged.withColumnRenamed("key", "__key"), "mh-judged")
    few = judged.count() <= BROADCAST_ROWS
    rows = docs.withColumn("__key", row_key())
    if not few:
        rows = maybe_among(rows, "__key", judged)
    marked = rows.join(F.broadcast(judged), "__key", "left") if few else rows.where("__maybe").join(judged, "__key", "left")
    plain = marked.where(F.col("__stays").isNull() | (F.col("__stays") & ~F.col("__several"))).select(*docs.columns)
    if not few:
        plain = plain.unionByName(rows.where("not __maybe").select(*docs.columns))
    one = marked.where(F.col("__stays") & F.col("__several")).groupBy("__key").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("__row"))
    return plain.unionByName(one.select("__row.*"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return find_components(ws.table(spark, sf_dir, "documents"))
