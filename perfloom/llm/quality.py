"""Quality scores by a generalised additive model with pairwise interactions.

Every document is described by `FEATURES`, numbers that are counted over its whole text. Boosting goes through the
features in turns, again and again; each turn fits a shallow tree of one feature to the present residuals and adds its
leaves to that feature's table of bins. The strongest pairs of features then get tables of their own in the same way. A
score is the logistic function of a sum of table cells.

Training reads at most `TRAIN_ROWS` labelled rows, those with the smallest hash of doc_id; their features are all that
reaches the driver. Scoring is one pass without a shuffle.

Rows with a null doc_id or label are not learnt from; of several labels of a document the mean is. Without labels, or
with one kind only, every score is the share of label 1 (0.5 without any). null and empty texts are scored like others,
from features of zero. Repeated rows get a row each; of the texts of one doc_id the first in order is learnt from.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from perfloom.llm.shingles import sets, words
from perfloom.llm.tables import sampled, slices, small_batches

TRAIN_ROWS, BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 20_000, 48, 10, 10, 250, 80, 0.1, 4
FEATURES = (
    "log_bytes", "upper", "punctuation", "digits", "exclamations", "symbols", "bars", "not_ascii", "mean_word", "deviation_word", "longest_word",
    "no_letter_words", "short_words", "capital_words", "distinct_words", "distinct_shingles", "log_lines", "distinct_lines", "mean_line", "ended_lines", "sentence_words", "entropy",
)
BLOCK = 1 << 20


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.float32)
    out[list(chars)] = 1
    return out


_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_CLASSES = [_class(x) for x in (_UPPER, _UPPER + _LOWER + bytes(range(128, 256)), b".,;:!?'\"()-", b"0123456789", b"!", b"#$%&*~^=<>{}[]\\_@+/`", b"|", bytes(range(128, 256)), b".!?")]


def features(texts: list[bytes]) -> np.ndarray:
    """A row of `FEATURES` for each text."""
    out, i = [], 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < BLOCK):
            size += len(texts[j]) + 1
            j += 1
        out.append(_features(texts[i:j]))
        i = j
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def _features(texts: list[bytes]) -> np.ndarray:
    n = len(texts)
    text = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, n)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    share = lambda a, b: np.divide(a, b, out=np.zeros(n), where=np.asarray(b) > 0)
    of = lambda mask: np.add.reduceat(mask, starts).astype(np.float64)
    upper, letters, marks, digits, bangs, symbols, bars, wide, ends = (of(c[text]) for c in _CLASSES)
    space = (text == 32) | ((text >= 9) & (text <= 13))
    solid = of((~space).astype(np.float32))
    edge = np.diff(space.astype(np.int8), prepend=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    hashes, counts = words(texts)
    owner = np.repeat(np.arange(n), counts)
    by = lambda v: np.bincount(owner, weights=v, minlength=n)
    size = (end - start).astype(np.float64)
    mean = share(by(size), counts)
    deviation = np.sqrt(np.maximum(0, share(by(size * size), counts) - mean**2))
    longest = np.zeros(n)
    np.maximum.at(longest, owner, size)
    lettered = np.concatenate([[0], np.cumsum(_CLASSES[1][text], dtype=np.float64)])
    bare = by(lettered[end] == lettered[start])
    distinct, kinds, entropy, lines, own, ended = (np.zeros(n) for _ in range(6))
    shingles = sets(texts)
    at = 0
    for k, (t, c) in enumerate(zip(texts, counts.tolist(), strict=True)):
        if not t:
            continue
        distinct[k] = len(np.unique(hashes[at : at + c])) / max(c, 1)
        kinds[k] = len(shingles[k]) / max(1, c - 4)
        at += c
        p = np.bincount(np.frombuffer(t, np.uint8))
        p = p[p > 0] / len(t)
        entropy[k] = -(p * np.log2(p)).sum()
        parts = [x for x in t.split(b"\n") if x.strip()]
        lines[k], own[k] = len(parts), len(set(parts)) / max(1, len(parts))
        ended[k] = sum(x.rstrip()[-1:] in b".!?" for x in parts) / max(1, len(parts))
    return np.column_stack(
        [
            np.log1p(lengths), share(upper, letters), share(marks, solid), share(digits, solid), share(bangs, solid), share(symbols, solid), share(bars, solid), share(wide, solid), mean, deviation, np.log1p(longest),
            share(bare, counts), share(by(size <= 3), counts), share(by(np.isin(text[start], list(_UPPER))), counts), distinct, kinds, np.log1p(lines), own, np.log1p(share(lengths, lines)), ended, np.log1p(share(counts, ends + 1)), entropy,
        ]
    )


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float = 4.0) -> np.ndarray:
    """The values of a tree over ordered bins with gradients g and curvatures h: the best split first, up to `leaves` leaves."""
    parts = [(0, len(g))]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: a * a / (b + 1)

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        k = np.arange(a + 1, b)
        lg, lh, rg, rh = cg[k] - cg[a], ch[k] - ch[a], cg[b] - cg[k], ch[b] - ch[k]
        v = np.where((lh >= least / 4) & (rh >= least / 4), gain(lg, lh) + gain(rg, rh) - gain(cg[b] - cg[a], ch[b] - ch[a]), 0)
        i = int(v.argmax())
        return float(v[i]), int(k[i])

    while len(parts) < leaves:
        (value, at), i = max((best(a, b), -i) for i, (a, b) in enumerate(parts))
        if value <= 1e-9:
            break
        a, b = parts[-i]
        parts[-i : -i + 1] = [(a, at), (at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1)
    return out


def _corner(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a grid into four by one line across each axis: its gain, and the values of the cells."""
    cg, ch = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (g, h))
    best, cells = 0.0, np.zeros_like(g)
    quarters = []
    for c in (cg, ch):
        a = c[1:-1, 1:-1]
        b, d = c[1:-1, -1:] - a, c[-1:, 1:-1] - a
        quarters.append((a, b, d, c[-1, -1] - a - b - d))
    value = sum(x * x / (y + 1) for x, y in zip(*quarters, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + 1)
    if value.size:
        i, j = np.unravel_index(int(value.argmax()), value.shape)
        best = float(value[i, j])
        v = [float(x[i, j] / (y[i, j] + 1)) for x, y in zip(*quarters, strict=True)]
        cells[: i + 1, : j + 1], cells[: i + 1, j + 1 :], cells[i + 1 :, : j + 1], cells[i + 1 :, j + 1 :] = v
    return best, cells


class AdditiveModel:
    """Tables over bins of single features and of pairs."""

    def __init__(self, base: float, edges: list[np.ndarray] | None = None):
        self.base, self.edges = base, edges or []
        self.tables: list[np.ndarray] = []
        self.coarse: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            f += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        for a, b, table in self.pairs:
            f += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-f))


def _edges(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1]))


def fit(x: np.ndarray, y: np.ndarray, bins: int = BINS, pairs: int = PAIRS) -> AdditiveModel:
    """Learns from rows x with labels y from 0 to 1."""
    if not len(y):
        return AdditiveModel(0.0)
    p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    m = AdditiveModel(float(np.log(p / (1 - p))))
    if y.min() == y.max():
        return m
    k = x.shape[1]
    m.edges = [_edges(x[:, j], bins) for j in range(k)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(m.edges)]
    f = np.full(len(y), m.base)
    for _ in range(ROUNDS):
        for j in range(k):
            q = 1 / (1 + np.exp(-f))
            g, h = (np.bincount(at[j], weights=w, minlength=len(m.tables[j])) for w in (y - q, q * (1 - q)))
            t = RATE * _tree(g, h, LEAVES)
            m.tables[j] += t
            f += t[at[j]]
    m.coarse = [_edges(x[:, j], PAIR_BINS) for j in range(k)]
    cell = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(m.coarse)]
    shape = [len(e) + 1 for e in m.coarse]

    def grids(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-f))
        return tuple(np.bincount(cell[a] * shape[b] + cell[b], weights=w, minlength=shape[a] * shape[b]).reshape(shape[a], shape[b]) for w in (y - q, q * (1 - q)))

    found = sorted(((_corner(*grids(a, b))[0], a, b) for a in range(k) for b in range(a + 1, k)), key=lambda z: (-z[0], z[1:]))
    m.pairs = [(a, b, np.zeros((shape[a], shape[b]))) for value, a, b in found[:pairs] if value > 1e-9]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in m.pairs:
            t = RATE * _corner(*grids(a, b))[1]
            table += t
            f += t[cell[a], cell[b]]
    return m


def _described(rows: DataFrame, names: list[str]) -> DataFrame:
    """The columns `names` and the features of `text`, as one array."""

    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, len(names)):
            x = features(texts)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), flat], [*names, "x"])

    kinds = dict(rows.dtypes)
    return rows.selectExpr(*names, "cast(text as binary) text").mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names) + ", x array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Learns `label` of `labels` (doc_id, label) from the texts of `docs`, from at most `train_rows` labels."""
    known = labels.where(f"doc_id is not null and {label} is not null").groupBy("doc_id").agg(F.avg(label).alias("y"))
    sample = sampled(known, train_rows, "doc_id")
    # Rows that repeat a doc_id don't raise the number learnt from.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text"))
    got = sorted((r["doc_id"], tuple(r["x"]), r["y"]) for r in _described(rows, ["doc_id", "y"]).collect())
    return fit(np.array([r[1] for r in got]), np.array([r[2] for r in got])) if got else AdditiveModel(0.0)


def score(docs: DataFrame, model: AdditiveModel, name: str = "score") -> DataFrame:
    """`docs` with the score as column `name`, in place of one that has that name."""
    small_batches(docs.sparkSession)
    raw, docs = pickle.dumps(model), docs.drop(name)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(raw)
        for batch, texts in slices(batches, at):
            x = features(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m.score(x))], [*names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def fold(doc_id: str = "doc_id") -> Column:
    """The fold of a document: crc32 of its id as text, modulo 3."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3
