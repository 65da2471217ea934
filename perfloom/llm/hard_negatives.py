"""Hard-negative mining with a pivot table.

Scores are inner products of whole-number vectors. Every vector gets one more component, sqrt(M^2 - |x|^2) with M the
greatest length, and a query gets 0: then |q - x|^2 = |q|^2 + M^2 - 2 q x, so a larger product is a smaller Euclidean
distance, for which the triangle inequality holds. `PIVOTS` rows far apart are pivots, and each row is stored with its
distances to them. From |d(q,p) - d(x,p)| <= d(q,x) <= d(q,p) + d(x,p) every pivot gives a bracket of the score; only rows
whose brackets reach into the range that is asked for have their product computed, in exact whole numbers.

Rows fall into cells by their nearest pivot, cells of more than `CELL_ROWS` rows are split. The same brackets, from the
least and greatest distances in a cell, rule whole cells out. A query first searches its own cell; the scores found there
are the floor that rows of other cells must reach. Queries stream past a split, in blocks of `QUERY_ROWS`, and give their
few best; these are merged by key. Positives are searched among rows of the anchor's label, with no bounds; then negatives
among the others, for all of an anchor's positives at once, each with the range that its score sets.

Pivots are chosen from at most `FIT_ROWS` rows, those with the smallest hash; every row is stored and searched, and the
choice changes no result. Rows with a null id, label or vector, with null components, or of another length than most take
no part; nor do vectors whose squared length reaches 2^55, as `least` times their scores would leave 64 bits. Rows that
repeat id, label and vector count once; those that repeat an id with another label or vector are rows of their own. Another
row means another id. Other columns are not read. An empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfloom.llm.tables import checkpoints, sampled, small_batches

PIVOTS, FIT_ROWS, CELL_ROWS, QUERY_ROWS, LEAST = 16, 4_096, 20_000, 20_000, 80
#: Few rows are still spread over so many splits.
LEAST_SPLITS = 16
#: Query rows that meet a split at once.
BLOCK = 64
#: Beyond every score.
FAR = 1 << 60
#: Share of |q|^2 + M^2 that covers the rounding of distances.
SLACK = 1e-6


class Pivots:
    """The pivots, the square M^2 of the greatest length, and distances in the space with one more component."""

    def __init__(self, x: np.ndarray, longest: float, n: int = PIVOTS):
        self.longest = longest
        self.points = x[:1].astype(np.float64)
        far = self.rows(x)[:, 0]
        while len(self.points) < min(n, len(x)) and far.max() > 0:
            self.points = np.vstack([self.points, x[far.argmax()].astype(np.float64)])
            far = np.minimum(far, self.rows(x)[:, -1])

    def _more(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.longest - (x * x).sum(1)))

    def rows(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.sqrt(np.maximum(0, 2 * (self.longest - x @ self.points.T - np.outer(self._more(x), self._more(self.points)))))

    def queries(self, q: np.ndarray) -> np.ndarray:
        q = q.astype(np.float64)
        return np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + self.longest - 2 * q @ self.points.T))

    def within(self, q: np.ndarray, gap: np.ndarray, reach: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where distances from `gap` to `reach` allow scores from `low` to `high`."""
        k = ((q.astype(np.float64) ** 2).sum(1) + self.longest)[:, None]
        return ((k - gap * gap) / 2 + SLACK * k >= low[:, None]) & ((k - reach * reach) / 2 - SLACK * k <= high[:, None])

    def survivors(self, q: np.ndarray, dq: np.ndarray, d: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each query and row, whether the brackets of all pivots leave its score in question."""
        gap, reach = np.zeros((len(q), len(d))), np.full((len(q), len(d)), np.inf)
        for a, b in zip(dq.T, d.T, strict=True):
            np.maximum(gap, np.abs(a[:, None] - b), out=gap)
            np.minimum(reach, a[:, None] + b, out=reach)
        return self.within(q, gap, reach, low, high)

    def cells(self, q: np.ndarray, least: np.ndarray, most: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each query and cell, whether it may hold a score in question. `least` and `most`: distances by cell and pivot."""
        dq = self.queries(q)[:, None, :]
        gap = np.maximum(0, np.maximum(least - dq, dq - most)).max(2)
        return self.within(q, gap, (dq + most).min(2), low, high)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """q @ x.T in whole numbers; by floating point where that is exact."""
    top = (q.astype(np.float64) ** 2).sum(1).max(initial=0) * (x.astype(np.float64) ** 2).sum(1).max(initial=0)
    return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if top < 2.0**105 else q @ x.T


def paired(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.einsum("pd,pd->p", q, x)


def first(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """The places of the n largest scores, ties to the smaller id."""
    at = np.arange(len(score))
    if len(score) > 4 * n:
        at = np.flatnonzero(score >= np.partition(score, len(score) - n)[len(score) - n])
    return at[np.lexsort((ids[at], -score[at]))[:n]]


class Split:
    """The rows of a split of a cell, ordered by label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, d: np.ndarray):
        o = np.argsort(labels, kind="stable")
        self.ids, self.labels, self.x, self.d = ids[o], labels[o], x[o], d[o]

    def search(self, pivots: Pivots, asks: dict[str, list | np.ndarray], same: bool, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(query, band, ids, scores): each query's n best of each band among the rows of its label, or of all others."""
        order = np.argsort(asks["label"], kind="stable") if same else np.arange(len(asks["label"]))
        labels = asks["label"][order]
        runs = np.split(order, np.flatnonzero(np.diff(labels)) + 1) if same else [order]
        for run in runs:
            for s in range(0, len(run), BLOCK):
                yield from self._block(pivots, asks, run[s : s + BLOCK], same, n)

    def _block(self, pivots: Pivots, asks: dict, who: np.ndarray, same: bool, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        label = asks["label"][who]
        a, b = (np.searchsorted(self.labels, label, side) for side in ("left", "right"))
        lo, hi = (int(a[0]), int(b[0])) if same else (0, len(self.ids))
        if lo == hi:
            return
        q, ids, x = asks["q"][who], self.ids[lo:hi], self.x[lo:hi]
        low, high = np.array([min(asks["low"][i]) for i in who]), np.array([max(asks["high"][i]) for i in who])
        open_ = pivots.survivors(q, asks["d"][who], self.d[lo:hi], low, high) & (ids != asks["id"][who, None])
        if not same:
            for i in range(len(who)):
                open_[i, a[i] : b[i]] = False
        dense = open_.mean() > 1 / 8
        if dense:
            exact = products(q, x)
        for i, w in enumerate(who.tolist()):
            at = np.flatnonzero(open_[i])
            score = exact[i, at] if dense else paired(np.broadcast_to(q[i], (len(at), q.shape[1])), x[at])
            for band, (least, most) in enumerate(zip(asks["low"][w], asks["high"][w], strict=True)):
                ok = np.flatnonzero((score >= least) & (score <= most))
                best = ok[first(score[ok], ids[at[ok]], n)]
                if len(best):
                    yield w, band, ids[at[best]], score[best]


def _whole(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.int64).reshape(len(column), -1)


def _real(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def _batch(columns: dict[str, tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in kinds.items()], list(kinds))


class _Table:
    """The stored rows with their cells, and searches in them."""

    def __init__(self, rows: DataFrame, pivots: Pivots, total: int):
        self.pivots, self.raw, self.names = pivots, pickle.dumps(pivots), len(pivots.points)
        raw = self.raw

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = pickle.loads(raw)
            for batch in batches:
                x = np.asarray(batch.column(2).flatten().to_numpy(), np.int64).reshape(batch.num_rows, -1)
                d = p.rows(x)
                made = [pa.array(d.argmin(1), pa.int32()), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(list(d), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made, batch.column(3)], ["id", "label", "cell", "x", "d", "anchor"])

        self.rows = rows.select("id", "label", "v", "anchor").mapInArrow(assign, "id long, label long, cell int, x binary, d array<double>, anchor boolean").checkpoint()
        ends = [f(F.col("d")[i]).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(self.names)]
        self.cells = self.rows.groupBy("cell").agg(F.count("*").alias("n"), *ends).orderBy("cell").collect()
        self.per_split = min(CELL_ROWS, -(-total // LEAST_SPLITS))

    def anchors(self) -> DataFrame:
        """Each anchor with a key of its own and one unbounded band."""
        far = lambda n: F.array(F.lit(n).cast("long"))
        return self.rows.where("anchor").select("id", F.xxhash64("label", "x").alias("h"), "label", "cell", "x", far(-FAR).alias("low"), far(FAR).alias("high"))

    def search(self, asked: DataFrame, same: bool, n: int) -> DataFrame:
        """id, h, band, rank, other, score: for each band of each query its n best rows."""
        home = self._best(self._met(self._routed(asked, True), same, n), n).checkpoint()
        floors = home.where(F.col("rank") == n).groupBy("id", "h").agg(F.map_from_entries(F.collect_list(F.struct("band", "score"))).alias("nth"))
        raised = asked.join(floors, ["id", "h"], "left").withColumn("low", F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.col("nth")[i], x)))).drop("nth")
        away = self._met(self._routed(raised, False), same, n)
        return self._best(home.drop("rank").unionByName(away), n).checkpoint()

    @staticmethod
    def _best(found: DataFrame, n: int) -> DataFrame:
        order = Window.partitionBy("id", "h", "band").orderBy(F.desc("score"), "other")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)

    def _routed(self, asked: DataFrame, home: bool) -> DataFrame:
        """A row for each query and split of a cell that it has to search: of its own cell, or of the others that its brackets leave."""
        raw, cells = self.raw, np.array([c["cell"] for c in self.cells])
        splits = np.array([-(-c["n"] // self.per_split) for c in self.cells])
        least, most = (np.array([[c[f"{f}{i}"] for i in range(self.names)] for c in self.cells]) for f in ("min", "max"))
        kinds = {"cell": pa.int32(), "split": pa.int32(), "id": pa.int64(), "h": pa.int64(), "label": pa.int64(), "x": pa.binary(), "low": pa.list_(pa.int64()), "high": pa.list_(pa.int64())}

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = pickle.loads(raw)
            for whole in batches:
                for batch in (whole.slice(s, 1024) for s in range(0, whole.num_rows, 1024)):
                    c = {k: batch.column(k).to_pylist() for k in (*kinds, "cell") if k != "split"}
                    mine = cells == np.array(c["cell"])[:, None]
                    if not home:
                        low, high = (np.array([f(v) for v in c[k]]) for f, k in ((min, "low"), (max, "high")))
                        mine = ~mine & p.cells(_whole(c["x"]), least, most, low, high)
                    rows, at = np.nonzero(mine)
                    times = splits[at]
                    row, cell = np.repeat(rows, times), np.repeat(cells[at], times)
                    out = {k: [v[i] for i in row.tolist()] for k, v in c.items()}
                    out["cell"], out["split"] = cell, np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    yield _batch(out, kinds)

        schema = "cell int, split int, id long, h long, label long, x binary, low array<long>, high array<long>"
        return asked.select("id", "h", "label", "cell", "x", "low", "high").mapInArrow(route, schema).checkpoint()

    def _met(self, routed: DataFrame, same: bool, n: int) -> DataFrame:
        """Queries searched in the splits that they are routed to."""
        spark, raw = routed.sparkSession, self.raw
        # A row for each pivot at most.
        splits = spark.createDataFrame([(c["cell"], -(-c["n"] // self.per_split)) for c in self.cells], "cell int, splits int")
        blocks = F.broadcast(routed.where("split = 0").groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks")))
        held = self.rows.join(F.broadcast(splits), "cell").join(blocks, "cell").select(
            "cell", F.pmod(F.xxhash64("id", "x"), F.col("splits")).cast("int").alias("split"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            F.lit(0).alias("side"), "id", F.lit(0).cast("long").alias("h"), "label", "x", "d", F.lit(None).cast("array<long>").alias("low"), F.lit(None).cast("array<long>").alias("high"),
        )
        asks = routed.join(blocks, "cell").select(
            "cell", "split", F.pmod(F.xxhash64("id", "h"), F.col("blocks")).cast("int").alias("block"),
            F.lit(1).alias("side"), "id", "h", "label", "x", F.lit(None).cast("array<double>").alias("d"), "low", "high",
        )
        met = held.unionByName(asks).repartition("cell", "split", "block").sortWithinPartitions("cell", "split", "block", "side")
        kinds = {"id": pa.int64(), "h": pa.int64(), "band": pa.int32(), "other": pa.int64(), "score": pa.int64()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p, now, parts, split = pickle.loads(raw), None, [], None
            for batch in batches:
                key = np.column_stack([batch.column(k).to_numpy() for k in ("cell", "split", "block", "side")])
                cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a == b:
                        continue
                    if (at := tuple(key[a, :3])) != now:
                        now, parts, split = at, [], None
                    part = batch.slice(a, b - a)
                    if not key[a, 3]:
                        d = np.asarray(part.column("d").flatten().to_numpy()).reshape(b - a, -1)
                        parts.append((part.column("id").to_numpy(), part.column("label").to_numpy(), _whole(part.column("x").to_pylist()), d))
                        continue
                    if parts:
                        split, parts = Split(*(np.concatenate(c) for c in zip(*parts, strict=True))), []
                    if split is None:
                        continue
                    q = _whole(part.column("x").to_pylist())
                    asks = {"id": part.column("id").to_numpy(), "label": part.column("label").to_numpy(), "q": q, "d": p.queries(q), "low": part.column("low").to_pylist(), "high": part.column("high").to_pylist()}
                    h = part.column("h").to_numpy()
                    found = list(split.search(p, asks, same, n))
                    if found:
                        times = [len(f[2]) for f in found]
                        query = np.repeat([f[0] for f in found], times)
                        out = {"id": asks["id"][query], "h": h[query], "band": np.repeat([f[1] for f in found], times), "other": np.concatenate([f[2] for f in found]), "score": np.concatenate([f[3] for f in found])}
                        yield _batch(out, kinds)

        return met.mapInArrow(run, "id long, h long, band int, other long, score long")


def hard_negatives(vectors: DataFrame, is_anchor: Column | str, positives: int = 5, negatives: int = 5, least: int = LEAST, pivots: int = PIVOTS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, from columns id, label and v, an array of whole numbers.

    For each row where `is_anchor` holds and each of its `positives` nearest others of the same label, the `negatives`
    nearest rows of other labels that score at most what the positive does and at least `least` percent of that.
    """
    spark = vectors.sparkSession
    checkpoints(spark)
    small_batches(spark)
    is_anchor = F.expr(is_anchor) if isinstance(is_anchor, str) else is_anchor
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<long>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.where("id is not null and label is not null and size(v) > 0 and not exists(v, c -> c is null)")
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    rows = rows.withColumn("square", square).where(F.col("square") < float(1 << 55))
    size = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("count"), F.max("square").alias("square")).orderBy(F.desc("count"), "n").first()
    if size is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = rows.where(F.size("v") == size["n"]).select("id", "label", "v", "anchor").distinct().checkpoint()
    fit = sampled(rows.select("id", "v"), fit_rows, "id").toArrow().column("v").combine_chunks()
    table = _Table(rows, Pivots(fit.flatten().to_numpy().reshape(len(fit), -1), size["square"], pivots), rows.count())
    anchors = table.anchors().checkpoint()
    near = table.search(anchors, True, positives)
    # A range is empty where the positive's score is below 0.
    lists = near.where("score >= 0").groupBy("id", "h").agg(F.sort_array(F.collect_list(F.struct("rank", "other", "score"))).alias("p"))
    asked = anchors.drop("low", "high").join(lists, ["id", "h"]).select(
        "id", "h", "label", "cell", "x", F.transform("p", lambda p: F.call_function("div", p["score"] * F.lit(least) + 99, F.lit(100)).cast("long")).alias("low"), F.transform("p", lambda p: p["score"]).alias("high"),
    )
    found = table.search(asked.checkpoint(), False, negatives)
    out = found.join(lists, ["id", "h"]).withColumn("p", F.col("p")[F.col("band")])
    return out.select(F.col("id").alias("anchor_id"), F.col("p.other").alias("positive_id"), "rank", F.col("other").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))
