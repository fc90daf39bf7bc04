"""Document quality by co-training two views.

One classifier sees a document's text (shape statistics and hashed words), the other its metadata (source, language,
length). Over some rounds each scores all unlabelled documents and labels those it is surest of: at most the share
`TAUGHT` of them, in the ratio of the classes, surest first (by bins of confidence; of the last bin, by a hash of id and
text). These pseudo-labels join the other's training rows; a view teaches a label from the highest certainty on at which
it is right as often as it claims, on held-out rows. Both are then calibrated, and a stacked pair of weights combines them, on labelled rows that
took no part in training.

The views of all documents are written once. A round is some passes over them, of which the driver gets sums: counts by
confidence, then the moments and Newton steps of both fits. Only the labelled rows are a bounded sample, taken in the
order of a hash of doc_id: the documents of `LABELLED` ids.

Rows: null text counts as empty, null metadata as a value of its own; documents with several labels take the majority
(ties: good); repeated rows are scored one by one; without labels of both classes every score is the share of good
labels (0.5 without any), and documents are kept from 0.5 on.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.llm.batches import arrow_map
from textlode.llm.boosting import sigmoid
from textlode.llm.quality_rules import Document, measure
from textlode.session import materialise, workspace

LABELLED, ROUNDS = 4000, 3
#: Levels of certainty; a view teaches a label from the highest one at which it is right as often as it claims.
LEVELS, CLAIMS = (0.95, 0.9, 0.85, 0.8), 8
#: The share of all unlabelled documents that a view labels in a round at most.
TAUGHT = 0.05
#: Bins of confidence from a level on, and how many of them a unit of the margin has.
BINS, BINS_A_UNIT = 2048, 64
HASHED, SOURCES, LANGS = 128, 64, 16
KEEP = 0.5


def text_view(d: Document) -> np.ndarray:
    """Shape statistics and the shares of hashed words."""
    n, chars = max(1, d.n_words), max(1, len(d.text))
    letters, upper, digits = (len(d.data) - len(d.data.translate(None, delete)) for delete in (bytes(range(65, 91)) + bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789"))
    own = d.words
    counts = np.bincount((own % np.uint64(HASHED)).astype(np.int64), minlength=HASHED) if len(own) else np.zeros(HASHED)
    shape = [
        np.log1p(d.n_words), d.word_chars / n, min(3.0, d.n_symbols / n), d.n_dup_lines / max(1, d.n_lines), d.n_repeat_words / n, len(np.unique(own)) / n, np.log1p(n / max(1, d.n_lines)),
        letters / chars, upper / chars, digits / chars, min(3.0, d.text.count("!") / n), min(3.0, d.text.count("|") / n), d.text.count(".") / n, d.text.count(",") / n, float(d.n_words < 50), d.text.count("http") / n,
    ]
    return np.concatenate([shape, counts / n]).astype(np.float32)


def metadata_view(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(SOURCES + LANGS + 4, np.float32)
    out[zlib.crc32(f"{source}".encode()) % SOURCES] = 1
    out[SOURCES + zlib.crc32(f"{lang}".encode()) % LANGS] = 1
    size = np.log1p(max(0, n_chars or 0))
    out[SOURCES + LANGS :] = [size, size * size / 10, n_chars is None, (n_chars or 0) < 300]
    return out


@dataclass
class Linear:
    """Logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 3.0, steps: int = 25) -> Linear:
        """Newton steps; `ridge` is the penalty on each weight."""
        x = x.astype(np.float64)
        mean, scale = x.mean(0), x.std(0)
        scale[scale < 1e-9] = 1.0
        z = np.concatenate([np.clip((x - mean) / scale, -6, 6), np.ones((len(x), 1))], 1)
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = sigmoid(z @ w)
            step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-5)[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w[:-1], float(w[-1]))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights + self.bias


@dataclass
class Rule:
    """What one view has taught in one round: `label` for the free rows beyond `least`, and for the `share` of that bin."""

    view: int
    teacher: Linear
    label: float
    least: int
    share: float
    level: float

    def takes(self, margin: np.ndarray, order: np.ndarray) -> np.ndarray:
        at = sure_bins(margin, self.label, self.level)
        return (at > self.least) | ((at == self.least) & (order < self.share))


@dataclass
class Model:
    """Both views, their calibration lines (slope, shift) and the stacked combination, or a constant."""

    views: list[Linear] | None
    lines: list[tuple[float, float]]
    stack: Linear | None
    constant: float = 0.5
    #: What each view has taught the other one, in order.
    rules: list[Rule] | None = None

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.views is None:
            same = np.full(len(text), self.constant)
            return same, same, same
        margins = [a * v.margin(x) + b for v, x, (a, b) in zip(self.views, (text, meta), self.lines, strict=True)]
        return sigmoid(margins[0]), sigmoid(margins[1]), sigmoid(self.stack.margin(np.stack(margins, 1)))


def sure_bins(margin: np.ndarray, label: float, level: float) -> np.ndarray:
    """Bins of the confidence in `label`, the surest last; -1 below `level`."""
    over = (margin if label else -margin) - float(np.log(level / (1 - level)))
    return np.where(over < 0, -1, np.minimum(BINS - 1, over * BINS_A_UNIT)).astype(np.int64)


def taken(rules: list[Rule], views: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """The first rule that takes each row, or -1."""
    out = np.full(len(order), -1)
    for j, rule in enumerate(rules):
        free = np.flatnonzero(out < 0)
        out[free[rule.takes(rule.teacher.margin(views[rule.view][free]), order[free])]] = j
    return out


class Pool:
    """All unlabelled documents, seen through sums that the executors form in one pass each."""

    def __init__(self, table: DataFrame) -> None:
        self.table = table
        self.parts = table.rdd.getNumPartitions()

    def sums(self, function: Callable[[list[np.ndarray], np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum of `function` (of the views and the order) over all batches; summed in groups of tasks before the driver."""
        groups = max(1, int(self.parts**0.5)) if self.parts > 32 else self.parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total = np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    total += function(_arrays(batch, 0), batch.column(2).to_numpy())
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId() % groups], pa.int32()), "total": [total.tobytes()]})

        def add(rows: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x) for x in sorted(rows.column("total").to_pylist()))
            return pa.table({"part": rows.column("part")[:1], "total": pa.array([total.tobytes()])})

        found = self.table.select("view_text", "view_meta", "place").mapInArrow(run, "part int, total binary")
        if groups < self.parts:
            found = found.groupBy("part").applyInArrow(add, "part int, total binary")
        return sum((np.frombuffer(r.total) for r in sorted(found.collect())), np.zeros(size))

    def histograms(self, rules: list[Rule], view: int, teacher: Linear, levels: dict[float, float]) -> tuple[int, np.ndarray]:
        """The number of documents, and the free ones by label (bad, good) and bin of the teacher's confidence."""

        def count(views: list[np.ndarray], order: np.ndarray) -> np.ndarray:
            margin = teacher.margin(views[view][taken(rules, views, order) < 0])
            bins = [sure_bins(margin, label, levels.get(label, LEVELS[0])) for label in (0.0, 1.0)]
            return np.concatenate([[len(order)], *(np.bincount(b[b >= 0], minlength=BINS) for b in bins)])

        n, *rest = self.sums(count, 1 + 2 * BINS)
        return int(n), np.array(rest).reshape(2, BINS)

    def fit(self, rules: list[Rule], views: list[Linear], known: list[np.ndarray], y: np.ndarray, ridge: float = 3.0, steps: int = 25) -> list[Linear]:
        """Both views on the labelled rows and on all that the rules take, by Newton steps from the former weights. The
        taken rows of a view weigh as much as its labelled ones together at most."""
        dims = [x.shape[1] for x in known]
        pupils = [[j for j, r in enumerate(rules) if r.view != k] for k in (0, 1)]
        labels = np.array([r.label for r in rules])

        def own(xs: list[np.ndarray], order: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
            by = taken(rules, xs, order)
            chosen = [np.isin(by, js) for js in pupils]
            return [(x[c].astype(np.float64), labels[by[c]]) for x, c in zip(xs, chosen, strict=True)]

        def moments(xs: list[np.ndarray], order: np.ndarray) -> np.ndarray:
            return np.concatenate([np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]) for x, _ in own(xs, order)])

        sums = self.sums(moments, sum(1 + 2 * d for d in dims))
        weight, shape, start = [], [], []
        for old, x, d in zip(views, known, dims, strict=True):
            (n, first, second), sums = np.split(sums[: 1 + 2 * d], [1, 1 + d]), sums[1 + 2 * d :]
            weight.append(min(1.0, len(y) / n[0]) if n[0] else 0.0)
            x = x.astype(np.float64)
            total = len(y) + weight[-1] * n[0]
            mean = (x.sum(0) + weight[-1] * first) / total
            var = ((x * x).sum(0) + weight[-1] * second) / total - mean * mean
            scale = np.where(var > 1e-10 * mean * mean + 1e-18, np.sqrt(np.maximum(var, 0)), 1.0)
            raw = old.weights / old.scale
            shape.append((mean, scale))
            start.append(np.append(raw * scale, old.bias + raw @ (mean - old.mean)))
        scaled = lambda x, mean, scale: np.concatenate([np.clip((x - mean) / scale, -6, 6), np.ones((len(x), 1))], 1)

        def newton(x: np.ndarray, truth: np.ndarray, k: int, w: np.ndarray) -> np.ndarray:
            z = scaled(x, *shape[k])
            p = sigmoid(z @ w)
            return np.concatenate([z.T @ (p - truth), ((z * np.maximum(p * (1 - p), 1e-5)[:, None]).T @ z).ravel()])

        sizes = [(d + 1) * (d + 2) for d in dims]
        for _ in range(steps):
            now = list(start)
            sums = self.sums(lambda xs, order: np.concatenate([newton(x, t, k, now[k]) for k, (x, t) in enumerate(own(xs, order))]), sum(sizes))  # noqa: B023
            most = 0.0
            for k, (part, d) in enumerate(zip(np.split(sums, [sizes[0]]), dims, strict=True)):
                both = newton(known[k].astype(np.float64), y, k, now[k]) + weight[k] * part
                penalty = np.full(d + 1, ridge)
                penalty[-1] = 1e-6
                step = np.linalg.solve(both[d + 1 :].reshape(d + 1, d + 1) + np.diag(penalty), both[: d + 1] + penalty * now[k])
                start[k] = now[k] - step
                most = max(most, np.abs(step).max())
            if most < 1e-3:  # the next step would be about the square of this one
                break
        return [Linear(mean, scale, w[:-1], float(w[-1])) for (mean, scale), w in zip(shape, start, strict=True)]


def _rule(view: int, teacher: Linear, label: float, level: float, counts: np.ndarray, most: float) -> Rule:
    """The rule that takes the surest `most` rows of a histogram: whole bins from the top, then a share of one bin."""
    above = np.cumsum(counts[::-1])[::-1]
    least = int(np.argmax(above <= most)) if (above <= most).any() else BINS
    if least == 0:
        return Rule(view, teacher, label, 0, 1.1, level)
    rest = most - (above[least] if least < BINS else 0)
    return Rule(view, teacher, label, least - 1, float(rest / counts[least - 1]), level)


def _levels(known: np.ndarray, y: np.ndarray) -> dict[float, float]:
    """For each label, the highest level at which a view's claims on held-out rows (`CLAIMS` of them at least) are right as
    often as they claim; none without held-out rows that say so."""
    out = {}
    for label, p in ((1.0, known), (0.0, 1 - known)):
        for level in LEVELS:
            claimed = p >= level
            if claimed.sum() >= CLAIMS and (y[claimed] == label).mean() >= level:
                out[label] = level
                break
    return out


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool: Pool, rounds: int = ROUNDS) -> Model:
    """Fit on the labelled rows and the pool; every fourth labelled row calibrates."""
    if not len(y) or y.min() == y.max():
        return Model(None, [], None, float(y.mean()) if len(y) else 0.5)
    held = np.arange(len(y)) % 4 == 3
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    labelled = [text, meta]
    share = float(y[~held].mean())
    views = [Linear.fit(v[~held], y[~held]) for v in labelled]
    rules: list[Rule] = []
    for _ in range(rounds):
        before = len(rules)
        for k in (0, 1):  # view k teaches the other one
            levels = _levels(sigmoid(views[k].margin(labelled[k][held])), y[held])
            if not levels:
                continue
            n, counts = pool.histograms(rules, k, views[k], levels)
            for label, most in ((1.0, n * TAUGHT * share), (0.0, n * TAUGHT * (1 - share))):
                if label in levels and counts[int(label)].any():
                    rules.append(_rule(k, views[k], label, levels[label], counts[int(label)], most))
        if len(rules) == before:
            break
        views = pool.fit(rules, views, [v[~held] for v in labelled], y[~held])
    base = held if held.any() else np.ones(len(y), bool)
    lines = []
    for view, x in zip(views, labelled, strict=True):
        line = Linear.fit(view.margin(x[base])[:, None], y[base], ridge=0.1)
        a = float(line.weights[0] / line.scale[0])
        lines.append((a, float(line.bias - a * line.mean[0])))
    stack = Linear.fit(np.stack([a * v.margin(x[base]) + b for v, x, (a, b) in zip(views, labelled, lines, strict=True)], 1), y[base], ridge=0.5)
    return Model(views, lines, stack, rules=rules)


def viewed(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, view_text, view_meta, place): both feature arrays of each row as bytes, and a hash in [0, 1) of id and text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def run(batch: pa.RecordBatch) -> list:
            texts, metas = measure(batch.column(1)), zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)
            return [batch.column(0), [text_view(t).tobytes() for t in texts], [metadata_view(*m).tobytes() for m in metas], batch.column(5)]

        return run

    place = F.shiftrightunsigned(F.xxhash64(id_col, "text"), 11) / F.lit(float(1 << 53))
    return arrow_map(docs.select(id_col, "text", "source", "lang", F.col("n_chars").cast("long"), place.alias("place")), make, f"`{id_col}` {kind}, view_text binary, view_meta binary, place double")


def _arrays(batch: pa.RecordBatch, first: int) -> list[np.ndarray]:
    """Both views of a batch; `first` is the column of the text view."""
    return [np.frombuffer(b"".join(batch.column(first + k).to_pylist()), np.float32).reshape(batch.num_rows, -1) for k in (0, 1)]


def _sample(ids: DataFrame, n: int) -> list[int]:
    """At most n of the ids, first by hash."""
    order = F.xxhash64("doc_id")
    return [r[0] for r in ids.select("doc_id").orderBy(order, "doc_id").limit(n).collect()]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return trained(docs, labels)[0]


def trained(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The model, from a bounded sample of the labelled documents and all others; the views of all rows."""
    spark = docs.sparkSession
    voted = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("_label"))
    table = materialise(viewed(docs).join(voted, "doc_id", "left"), workspace(spark, "views"))
    chosen = F.broadcast(spark.createDataFrame([(i,) for i in _sample(voted, LABELLED)], "doc_id long"))  # LABELLED rows at most
    rows = sorted(tuple(r) for r in table.filter("_label IS NOT NULL").join(chosen, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("view_text", "view_meta", "_label").collect())
    stack = lambda k, dim: np.frombuffer(b"".join(r[k] for r in rows), np.float32).reshape(len(rows), dim)
    text, meta = stack(0, len(text_view(measure(pa.array([""]))[0]))), stack(1, len(metadata_view(None, None, None)))
    return cotrain(text, meta, np.array([r[2] for r in rows]), Pool(table.filter("_label IS NULL"))), table


def score_views(views: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, p_text, p_metadata, score, kept) of every row of `viewed`."""
    kind = views.schema[id_col].dataType.simpleString()

    def make():
        def run(batch: pa.RecordBatch) -> list:
            by_text, by_meta, both = model.scores(*_arrays(batch, 1))
            return [batch.column(0), by_text, by_meta, both, both >= KEEP]

        return run

    return arrow_map(views.select(id_col, "view_text", "view_meta"), make, f"`{id_col}` {kind}, p_text double, p_metadata double, score double, kept boolean")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, p_text, p_metadata, score, kept) of every row."""
    return score_views(viewed(docs, id_col), model, id_col)
