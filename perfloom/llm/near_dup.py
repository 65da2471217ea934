"""MinHash near-duplicates with sequential Bayesian verification.

1. Texts with equal shingle sets form a class; from here on its smallest doc_id stands for it.
2. Signatures are cut into bands; equal bands form buckets. In each bucket every member is compared with the smallest
   one. Members that end up in another component than it are then compared with the smallest of their own kind. A bucket
   of one group thus costs as many comparisons as it has members.
3. In buckets that still hold members of several components, members of different ones are compared. Two bounds rule
   most of that out before, and no linked pair: a member of whose shingles more than `1 - threshold` are in no other
   document is linked to none, so texts that only share a template are not paired; and a pair shares no more than the
   smaller of its counts of shingles in each of `PARTS` parts of their hashes.
4. A comparison first reads the signatures in batches: with m of n equal minima the similarity has a Beta posterior,
   and the pair is dropped as soon as the chance of reaching the threshold falls below `miss`.
5. What survives is confirmed on the full sets, and the links' connected components are found.

null or empty texts and texts without words have an empty set and no links. Rows with a null doc_id take no part: their
component is null and they are kept. Rows that repeat a doc_id have a row each; where one doc_id is the smallest of
several different texts, these count as one document with the links of all. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfloom.llm.components import components
from perfloom.llm.shingles import MinHash, sets
from perfloom.llm.tables import bounded, brief_shuffles, checkpoints, slices, small_batches, spread_join

BANDS, ROWS, WIDTH, THRESHOLD, MISS, STEP, PARTS = 32, 4, 5, 0.75, 1e-6, 16, 64


def least_matches(total: int, step: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """(n, the fewest of n equal minima with which a pair goes on): below, the posterior chance of the threshold is under `miss`."""
    out = []
    for n in range(step, total + 1, step):
        # With a uniform prior, P(J >= t | m of n) is the chance that of n + 1 draws at t at most m succeed.
        chance = np.cumsum([math.comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(n + 1)])
        out.append((n, int(np.searchsorted(chance, miss))))
    return out


def text_hash(text: str = "text") -> Column:
    """What tells the texts of one doc_id apart."""
    return F.xxhash64(text)


def _sketches(docs: DataFrame, bands: int, rows: int, width: int, signed: bool) -> DataFrame:
    """A row for each document: the size of its set, two hashes of it and, if `signed`, its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHash(bands * rows)
        for batch, texts in slices(batches, 1):
            found = sets(texts, width)
            raw, cut = hasher.signatures(found).tobytes() if signed else b"", 4 * bands * rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in found], pa.int64()),
                    pa.array([int(s.sum(dtype=np.uint64).view(np.int64)) for s in found], pa.int64()),
                    pa.array([int(np.bitwise_xor.reduce(s * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)) if len(s) else 0 for s in found], pa.int64()),
                    pa.array([raw[i * cut : (i + 1) * cut] for i in range(len(found))], pa.binary()),
                    batch.column(2),
                ],
                ["doc_id", "n_shingles", "h1", "h2", "signature", "text_hash"],
            )

    rows_ = docs.select("doc_id", F.col("text").cast("binary").alias("text"), text_hash().alias("text_hash"))
    return rows_.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, signature binary, text_hash long")


def _plausible(pairs: DataFrame, total: int, threshold: float, miss: float) -> DataFrame:
    """The pairs (a, b, sa, sb, ...) that the Bayesian test doesn't drop, without their signatures."""
    bounds = least_matches(total, STEP, threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, total) for k in ("sa", "sb"))
            left, equal, at = np.arange(len(x)), np.zeros(len(x), np.int64), 0
            for n, least in bounds:
                equal = equal + (x[left, at:n] == y[left, at:n]).sum(1)
                ok = equal >= least
                left, equal, at = left[ok], equal[ok], n
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(left)) for k in ("a", "b")], ["a", "b"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    per_cent = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column("xa"), batch.column("xb"), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                i = np.searchsorted(q, p)
                both = int((q[np.minimum(i, len(q) - 1)] == p).sum())
                if 100 * both >= per_cent * (len(p) + len(q) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in ("a", "b")], ["u", "v"])

    of = lambda k: found.selectExpr(f"doc_id {k}", f"shingles x{k}")
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "xa", "xb").mapInArrow(run, "u long, v long")


def _common_parts(found: DataFrame) -> DataFrame:
    """doc_id, parts: of `found` (doc_id, shingles), how many shingles of each of PARTS residues a row shares with any other row."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches, 1):
            out = [np.bincount(np.frombuffer(r, np.int64) % PARTS, minlength=PARTS) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "parts"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches, 1):
            x = [np.frombuffer(r, np.int64) for r in raw]
            ids = np.repeat(batch.column(0).to_numpy(), [len(v) for v in x])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(x))], ["doc_id", "shingle"])

    found = found.select("doc_id", "shingles")
    once = found.mapInArrow(rows, "doc_id long, shingle long").groupBy("shingle").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last")).where("doc_id = last")
    alone = once.groupBy("doc_id", F.pmod("shingle", F.lit(PARTS)).cast("int").alias("part")).agg(F.count("*").cast("int").alias("n"))
    alone = alone.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("alone"))
    both = found.mapInArrow(totals, "doc_id long, parts array<int>").join(alone, "doc_id", "left")
    return both.select("doc_id", F.when(F.col("alone").isNull(), F.col("parts")).otherwise(F.transform("parts", lambda x, i: x - F.coalesce(F.try_element_at("alone", i), F.lit(0)))).alias("parts"))


def _linked(docs: DataFrame, width: int, threshold: float, bands: int, rows: int, miss: float) -> tuple[DataFrame, DataFrame]:
    """Documents with their sets' size and hashes, and classes with the number of their rows and their components, without those of one row and no link."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Sketches are made twice, so that signatures are neither kept nor shuffled for more than one document of a class.
    sketch = _sketches(docs, bands, rows, width, False).drop("signature").checkpoint()
    usable = "doc_id is not null and n_shingles > 0"
    classes = sketch.where(usable).groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    signed = _sketches(docs, bands, rows, width, True).drop("text_hash").where(usable)
    reps = signed.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"))
    reps = reps.select("doc_id", "n_shingles", "signature").checkpoint()
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring("signature", i * (4 * rows) + 1, F.lit(4 * rows))))
    banded = reps.select("doc_id", "n_shingles", F.explode(keys).alias("key"))
    leaders = banded.groupBy("key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last"), F.count("*").alias("members")).where("leader <> last").drop("last").checkpoint()
    shared = spread_join(banded, leaders, ["key"], "members", bands * reps.count()).checkpoint()
    involved = bounded(shared.select("doc_id").distinct().checkpoint())
    signatures = reps.join(involved, "doc_id", "left_semi").checkpoint()
    rows_of = docs.join(involved, "doc_id", "left_semi")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, 1):
            found = sets(texts, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in found], pa.binary()), pa.array([len(s) for s in found], pa.int64())], ["doc_id", "shingles", "n"])

    found = rows_of.selectExpr("doc_id", "cast(text as binary) text").mapInArrow(shingle, "doc_id long, shingles binary, n long")
    found = found.join(signatures.selectExpr("doc_id", "n_shingles n"), ["doc_id", "n"], "left_semi").drop("n").dropDuplicates(["doc_id", "shingles"]).checkpoint()
    per_cent, total = round(threshold * 100), bands * rows

    def links(pairs: DataFrame) -> DataFrame:
        """Of candidate pairs (a, b): those that are linked."""
        of = lambda k: signatures.selectExpr(f"doc_id {k}", f"n_shingles n{k}", f"signature s{k}")
        near = pairs.distinct().join(of("a"), "a").join(of("b"), "b").where(f"100 * least(na, nb) >= {per_cent} * greatest(na, nb)")
        return _confirmed(_plausible(near, total, threshold, miss).distinct(), found, threshold)

    def labelled(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The shared buckets with members' components, and those members that aren't in the component of their bucket's leader."""
        known = components(edges).checkpoint()
        of = lambda k: known.selectExpr(f"node {k}", f"component c_{k}")
        all_of = shared.join(of("doc_id"), "doc_id", "left").join(of("leader"), "leader", "left")
        all_of = all_of.selectExpr("key", "doc_id", "n_shingles", "leader", "coalesce(c_doc_id, doc_id) c", "coalesce(c_leader, leader) c_leader")
        return known, all_of

    edges = links(shared.where("doc_id <> leader").selectExpr("doc_id a", "leader b")).checkpoint()
    known, members = labelled(edges)
    apart = members.where("c <> c_leader")
    second = apart.groupBy("key").agg(F.min("doc_id").alias("second"))
    pairs = apart.join(second, "key").where("doc_id <> second").selectExpr("doc_id a", "second b")
    more = links(pairs).checkpoint()
    if more.take(1):
        edges = edges.unionAll(more).checkpoint()
        known, members = labelled(edges)
        apart = members.where("c <> c_leader")
    # Whoever is apart still meets the members of other components. Shingles that no other document of these buckets has
    # can't be common to a pair: members with too many of them are linked to none, and aren't paired. Nor can a pair have
    # more in common than the smaller of its counts in each part of the hashes. This rules most pairs out, and no linked one.
    touched = members.join(apart.select("key").distinct(), "key", "left_semi").checkpoint()
    ids = bounded(touched.select("doc_id").distinct().checkpoint())
    parts = _common_parts(found.join(ids, "doc_id", "left_semi")).withColumn("s", F.aggregate("parts", F.lit(0), lambda a, x: a + x)).checkpoint()
    touched = touched.join(parts, "doc_id").where(f"100 * s >= {per_cent} * n_shingles").checkpoint()
    other = touched.selectExpr("key", "doc_id b", "n_shingles nb", "c cb", "c_leader", "s sb", "parts pb")
    rest = touched.where("c <> c_leader").selectExpr("key", "doc_id a", "n_shingles na", "c ca", "s sa", "parts pa").join(other, "key")
    enough = f"{100 + per_cent} * {{}} >= {per_cent} * (na + nb)"
    least = "aggregate(zip_with(pa, pb, (x, y) -> least(x, y)), 0, (t, x) -> t + x)"
    rest = rest.where(f"ca <> cb and (cb = c_leader or a < b) and {enough.format('least(sa, sb)')} and {enough.format(least)}").select("a", "b")
    last = links(rest).checkpoint()
    if last.take(1):
        known = components(edges.unionAll(last)).checkpoint()
    grouped = classes.join(known.selectExpr("node rep", "component"), "rep", "left").where("n > 1 or component is not null")
    return sketch, grouped.select("n_shingles", "h1", "h2", "n", F.coalesce("component", "rep").alias("component")).checkpoint()


def near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash for every row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    checkpoints(spark)
    small_batches(spark)
    with brief_shuffles(spark):
        sketch, classes = _linked(docs, width, threshold, bands, rows, miss)
    usable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    rows_ = spread_join(sketch.where(usable), classes, ["n_shingles", "h1", "h2"], "n", sketch.count(), "left")
    rows_ = rows_.unionByName(sketch.where(~usable), allowMissingColumns=True)
    out = rows_.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "text_hash")
    return out.select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"), "text_hash")
