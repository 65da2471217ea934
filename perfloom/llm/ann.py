"""Approximate nearest neighbours: an inverted file with product-quantised residuals and exact reranking.

Equal vectors form a class; a class keeps its k + 1 smallest ids, which is all that k nearest can need. Classes are
assigned to the nearest of the coarse centroids, and what is left of a vector is quantised in `PARTS` parts. A query
reads the lists whose centroids it agrees with most; tables of its products with all codewords give each vector's
approximate product. The best `RERANK` of every list get their exact one, in double precision, and so does every other
vector of the list whose approximate product, with the most that quantisation can take from it, reaches the exact one
of the last of the best. So a query loses nothing of the lists that it reads, however many near copies they hold.

Centroids and codewords are fitted to at most `FIT_ROWS` classes, those with the smallest hash; every class is indexed.
How many lists a query reads is measured: as many as hold `RECALL` of the true neighbours, among all vectors, of
`FIT_QUERIES` of the queries. As lists lose nothing, this is the recall of the whole search.

Lists are cut into cells of at most `CELL_ROWS` vectors, and cells are gathered into groups of about that size. A task
holds the vectors of one group at a time, and the queries that read its lists stream past them; where these are more
than `QUERY_ROWS`, the group is copied, so that they share the work. Groups that no query reads are left out.

Rows that repeat a vec_id with the same vector count once, as queries and as candidates; with other vectors they are
candidates of their own. Other columns are not read. Vectors that are null, of another length than most, zero, or hold a null or non-finite component take no part, as
queries or candidates; nor do rows with a null vec_id. An empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfloom.llm.tables import checkpoints, sampled, small_batches

FIT_ROWS, PARTS, CODES, RERANK, RECALL, CELL_ROWS, QUERY_ROWS, FIT_QUERIES = 32_768, 16, 256, 64, 0.98, 20_000, 50_000, 256


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """At most k centroids of the rows x."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (c * c).sum(1) / 2
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = (x[i : i + 4096] @ c.T - half).argmax(1)
    return out


class Index:
    """Coarse centroids, codewords and the number of lists that a query reads."""

    def __init__(self, x: np.ndarray, total: int, parts: int):
        # As many lists as rows a list, but no more than the fitted rows can tell apart.
        self.lists = int(max(1, min(np.sqrt(total), len(x) / 8)))
        self.coarse = kmeans(x, self.lists)
        at = nearest(x, self.coarse)
        rest = x - self.coarse[at]
        cuts = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
        self.parts = list(zip(cuts[:-1], cuts[1:], strict=True))
        self.words = [kmeans(rest[:, a:b], CODES, seed=a + 1) for a, b in self.parts]
        self.probes = self.lists

    def measure(self, q: np.ndarray, at: list[np.ndarray], recall: float) -> None:
        """Sets the number of lists to read, from the lists of the true neighbours of each row of q."""
        order = np.argsort(self._order(q), axis=1)
        ranks = np.concatenate([order[i, a] for i, a in enumerate(at)]) if at else np.zeros(0, np.int64)
        self.probes = int(np.quantile(ranks, recall, method="higher")) + 1 if len(ranks) else 1

    def _order(self, q: np.ndarray) -> np.ndarray:
        return np.argsort(-(q @ self.coarse.T), axis=1, kind="stable")

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = nearest(x, self.coarse)
        rest = x - self.coarse[at]
        return at, np.column_stack([nearest(rest[:, a:b], w) for (a, b), w in zip(self.parts, self.words, strict=True)]).astype(np.uint8)

    def reads(self, q: np.ndarray) -> np.ndarray:
        """The lists that each query reads."""
        return self._order(q)[:, : self.probes]

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        return [q[:, a:b] @ w.T for (a, b), w in zip(self.parts, self.words, strict=True)]

    def norms(self, x: np.ndarray) -> np.ndarray:
        """The length of each part of each row."""
        return np.column_stack([np.sqrt((x[:, a:b] ** 2).sum(1)) for a, b in self.parts])

    def errors(self, at: int, codes: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The length of what quantisation leaves of each part of the rows of a list."""
        return self.norms(x - self.coarse[at] - np.concatenate([w[codes[:, m]] for m, w in enumerate(self.words)], axis=1))


def best_in_list(ix: Index, at: int, codes: np.ndarray, x: np.ndarray, q: np.ndarray, tables: list[np.ndarray], floor: np.ndarray, n: int, rerank: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of q, rows of x, exact products): at least those of the list's n best of each query that reach `floor`.

    Products are exact where the approximate ones, with the most that their errors can add, reach the n-th best exact one.
    """
    near = sum(t[:, codes[:, m]] for m, t in enumerate(tables)) + (q @ ix.coarse[at])[:, None]
    size = near.shape[1]
    r = min(max(rerank, n), size)
    top = np.argpartition(-near, r - 1, axis=1)[:, :r] if r < size else np.tile(np.arange(r), (len(q), 1))
    exact = np.einsum("qd,qrd->qr", q, x[top])
    if r >= n:
        floor = np.maximum(floor, -np.partition(-exact, n - 1, axis=1)[:, n - 1])
    if r < size:
        # Rounding is far below this.
        least = (floor - 1e-9 * (np.abs(near).max(1) + 1e-300))[:, None]
        near += ix.norms(q) @ ix.errors(at, codes, x).T
        reach = near >= least
        np.put_along_axis(reach, top, False, axis=1)
        if reach.mean() > 1 / 16:
            reach &= q @ x.T >= least
        rows, others = np.nonzero(reach)
        more = np.concatenate([np.einsum("pd,pd->p", q[rows[i : i + 65536]], x[others[i : i + 65536]]) for i in range(0, max(1, len(rows)), 65536)])
        starts = np.searchsorted(rows, np.arange(len(q) + 1))
    for i in range(len(q)):
        if r < size:
            mine = slice(starts[i], starts[i + 1])
            yield i, np.concatenate([top[i], others[mine]]), np.concatenate([exact[i], more[mine]])
        else:
            yield i, top[i], exact[i]


def usable(v: str, size: int) -> Column:
    """True for vectors that take part."""
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.col(v).isNotNull() & (F.size(v) == size) & ~bad & F.exists(v, lambda c: c != 0)


def _floats(column: pa.Array) -> np.ndarray:
    """The rows of an Arrow column of arrays of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def _smallest(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def _true_lists(stored: DataFrame, q: np.ndarray, names: np.ndarray, n: int) -> list[np.ndarray]:
    """For each of a few queries, the lists of the n nearest of all other classes; each task keeps its n best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, at = np.full((len(q), 0), -np.inf), np.zeros((len(q), 0), np.int32)
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                x = _matrix(part.column(2).to_pylist())
                s = q @ x.T
                s[names[:, None] == part.column(0).to_numpy()[None]] = -np.inf
                score = np.concatenate([score, s], axis=1)
                at = np.concatenate([at, np.broadcast_to(part.column(1).to_numpy(), s.shape)], axis=1)
                if score.shape[1] > n:
                    best = np.argpartition(-score, n - 1, axis=1)[:, :n]
                    score, at = np.take_along_axis(score, best, 1), np.take_along_axis(at, best, 1)
        rows, columns = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(at[rows, columns], pa.int32()), pa.array(score[rows, columns], pa.float64())], ["query", "list", "score"])

    found = stored.select("class", "list", "x").mapInArrow(run, "query int, list int, score double")
    out: list[list[int]] = [[] for _ in q]
    for r in _smallest(found, ["query"], [F.desc("score"), "list"], n).select("query", "list").collect():
        out[r["query"]].append(r["list"])
    return [np.array(a, np.int64) for a in out]


def _nearest_of(ix: Index, lists: dict[int, tuple], asks: pa.RecordBatch, n: int, rerank: int) -> pa.RecordBatch:
    """query, class, score: for each query its n nearest among the lists of a group that it reads."""
    q, names = _matrix(asks.column("x").to_pylist()), asks.column("id").to_numpy()
    tables = ix.tables(q)
    readers: dict[int, list[int]] = {}
    for i, reads in enumerate(asks.column("lists").to_pylist()):
        for at in reads:
            readers.setdefault(at, []).append(i)
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for at, (codes, x, classes) in lists.items():
        who = np.array(readers.get(at, []), np.int64)
        for s in range(0, len(who), 256):
            w = who[s : s + 256]
            floor = np.array([best[i][0][n - 1] if i in best and len(best[i][0]) >= n else -np.inf for i in w.tolist()])
            for j, those, sc in best_in_list(ix, at, codes, x, q[w], [t[w] for t in tables], floor, n, rerank):
                i = int(w[j])
                a, b = best.get(i, (np.zeros(0), np.zeros(0, np.int64)))
                a, b = np.concatenate([a, sc]), np.concatenate([b, classes[those]])
                o = np.lexsort((b, -a))[:n]
                best[i] = a[o], b[o]
    query = np.repeat([names[i] for i in best], [len(v[0]) for v in best.values()]).astype(np.int64)
    score, found = (np.concatenate([v[c] for v in best.values()]) if best else np.zeros(0) for c in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array(found.astype(np.int64)), pa.array(score.astype(np.float64))], ["query", "class", "score"])


def nearest_neighbours(vectors: DataFrame, is_query: Column | str, k: int = 20, id_column: str = "vec_id", vector: str = "embedding", fit_rows: int = FIT_ROWS, recall: float = RECALL, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `vectors` where `is_query`, the k others with the largest inner product found, ties to the smaller id."""
    checkpoints(vectors.sparkSession)
    small_batches(vectors.sparkSession)
    is_query = F.expr(is_query) if isinstance(is_query, str) else is_query
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("id is not null")
    size = rows.where("v is not null").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    result = "query_id long, rank int, vec_id long, score double"
    if size is None or not size["n"]:
        return vectors.sparkSession.createDataFrame([], result)
    rows = rows.where(usable("v", size["n"]))
    # The first k + 1 ids of each class; only they leave their tasks.
    members = _smallest(rows.select("id", "v").distinct(), ["v"], ["id"], k + 1)
    classes = members.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("class", F.col("ids")[0]).checkpoint()
    total = classes.count()
    if not total:
        return vectors.sparkSession.createDataFrame([], result)
    fit = sampled(classes.select("class", "v"), fit_rows, "class").toArrow()
    index = Index(_floats(fit.column("v").combine_chunks()), total, PARTS)
    raw = pickle.dumps(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = pickle.loads(raw)
        for batch in batches:
            x = _floats(batch.column(1))
            at, codes = ix.encode(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())], ["class", "list", "code", "x"])

    stored = classes.select("class", "v").mapInArrow(assign, "class long, list int, code binary, x binary").checkpoint()
    asked = rows.where("q").select("v").distinct().join(classes.select("v", "class"), "v").select("class", "v").checkpoint()
    n_asked = asked.count()
    if not n_asked:
        return vectors.sparkSession.createDataFrame([], result)
    tried = sampled(asked, FIT_QUERIES, "class").collect()
    tried_q, tried_class = np.array([r["v"] for r in tried]), np.array([r["class"] for r in tried])
    index.measure(tried_q, _true_lists(stored, tried_q, tried_class, k + 1), recall)
    raw = pickle.dumps(index)
    sizes = {r["list"]: r["count"] for r in stored.groupBy("list").count().collect()}
    # Cells of each list, and the group of each cell.
    cells, groups, filled = {}, {}, 0
    for at, n in sorted(sizes.items()):
        cells[at] = -(-n // CELL_ROWS)
        for c in range(cells[at]):
            groups[at, c] = filled // CELL_ROWS
            filled += n // cells[at]
    least = min(8, len(groups))
    if max(groups.values()) + 1 < least:
        groups = {key: i * least // len(groups) for i, key in enumerate(groups)}
    of_list = {at: sorted({groups[at, c] for c in range(n)}) for at, n in cells.items()}
    spark = vectors.sparkSession
    cell_rows = spark.createDataFrame([(int(at), c, int(g)) for (at, c), g in groups.items()], "list int, cell int, group int")
    per_list = spark.createDataFrame([(int(at), int(n)) for at, n in cells.items()], "list int, cells int")
    # A row for each list, and for each CELL_ROWS vectors: small tables.
    placed = stored.join(F.broadcast(per_list), "list").withColumn("cell", F.pmod(F.xxhash64("class"), F.col("cells")).cast("int")).join(F.broadcast(cell_rows), ["list", "cell"]).select("group", "list", "class", "code", "x")
    raw_lists = pickle.dumps(of_list)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, where = pickle.loads(raw), pickle.loads(raw_lists)
        for batch in batches:
            q = _floats(batch.column(1))
            out: list[tuple] = []
            for name, vec, lists in zip(batch.column(0).to_pylist(), q, ix.reads(q), strict=True):
                by: dict[int, list[int]] = {}
                for at in lists.tolist():
                    for g in where.get(at, ()):
                        by.setdefault(g, []).append(at)
                out += [(g, name, vec.tobytes(), ls) for g, ls in by.items()]
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["group", "query", "y", "lists"])

    routed = asked.mapInArrow(route, "group int, query long, y binary, lists array<int>").checkpoint()
    blocks = F.broadcast(routed.groupBy("group").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks")))
    held = placed.join(blocks, "group").select("group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"), F.col("class").alias("id"), "list", "code", "x", F.lit(None).cast("array<int>").alias("lists"))
    asks = routed.join(blocks, "group").select("group", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("side"), F.col("query").alias("id"), F.lit(-1).alias("list"), F.lit(None).cast("binary").alias("code"), F.col("y").alias("x"), "lists")
    met = held.unionByName(asks).repartition("group", "block").sortWithinPartitions("group", "block", "side")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, now, parts, lists = pickle.loads(raw), None, [], {}
        for batch in batches:
            group, block, side = (batch.column(c).to_numpy() for c in ("group", "block", "side"))
            cuts = np.flatnonzero((np.diff(group) != 0) | (np.diff(block) != 0) | (np.diff(side) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(side)], strict=True):
                if b == a:
                    continue
                if (key := (int(group[a]), int(block[a]))) != now:
                    now, parts, lists = key, [], {}
                part = batch.slice(a, b - a)
                if not side[a]:
                    parts.append((part.column("list").to_numpy(), part.column("id").to_numpy(), np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(b - a, -1), _matrix(part.column("x").to_pylist())))
                    continue
                if parts:
                    of, names, codes, x = (np.concatenate(c) for c in zip(*parts, strict=True))
                    lists = {int(at): (codes[of == at], x[of == at], names[of == at]) for at in np.unique(of)}
                    parts = []
                for s in range(0, b - a, 4096):
                    yield _nearest_of(ix, lists, part.slice(s, 4096), k + 1, rerank)

    found = met.mapInArrow(search, "query long, class long, score double")
    best = _smallest(found, ["query"], [F.desc("score"), "class"], k + 1).checkpoint()
    # From classes to rows: a class stands for its first ids, and a query for every row with its vector.
    each = best.join(classes.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("vec_id"))
    each = _smallest(each, ["query"], [F.desc("score"), "vec_id"], k + 1).groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), "vec_id"))).alias("near"))
    queries = rows.where("q").select("id", "v").distinct().join(classes.select("v", F.col("class").alias("query")), "v").select("id", "query")
    out = queries.join(each, "query").select(F.col("id").alias("query_id"), F.slice(F.filter("near", lambda n: n["vec_id"] != F.col("id")), 1, k).alias("near"))
    return out.select("query_id", F.posexplode("near").alias("rank", "n")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "n.vec_id", (-F.col("n.order")).alias("score"))
