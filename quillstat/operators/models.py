"""Models that Spark ML lacks, as pipeline stages: a neural regressor and boosted trees for several classes.

Both are trained on the driver's small state only, by sums that tasks make over their rows: gradients of a network, or
gradient histograms of a tree's level. Neither gathers rows. Rows are read by Python once, into blocks of numbers in
which rows with equal inputs are put together, as both sums depend on these rows by their number and the sums of their
labels only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.functions.ranks import ensure_checkpoints, quantiles


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _rows(batch: pa.RecordBatch, column: int = 0) -> np.ndarray:
    return _matrix(batch.column(column))


#: Numbers of a block.
BLOCK_NUMBERS = 1 << 19


def merged(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct rows of keys, the sums over their equals)."""
    order = np.lexsort(keys.T)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1))))
    return keys[starts], np.add.reduceat(sums[order], starts)


def packed(points: DataFrame, make) -> DataFrame:
    """Blocks (k binary, s binary) of the rows: `make` returns for a batch a row of keys and a row of sums for each of its
    rows, and equal keys of a block are one row. A task holds about two blocks."""
    numbers = BLOCK_NUMBERS

    def joined(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        return merged(*(np.concatenate(part) for part in zip(*held, strict=True)))

    def block(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (keys, sums)], names=["k", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                keys, sums = make(batch)
                held.append((keys, sums))
                n += len(keys)
                most = numbers // (keys.shape[1] + sums.shape[1])
                if n >= most:
                    held = [joined(held)]
                    n = len(held[0][0])
                    if 2 * n >= most:  # few were equal
                        yield block(*held[0])
                        held, n = [], 0
        if held:
            yield block(*joined(held))

    return points.mapInArrow(run, "k binary, s binary")


def _blocks(batch: pa.RecordBatch, *kinds: tuple[type, int]) -> Iterator[list[np.ndarray]]:
    """The matrices of each row, by their types and widths."""
    for row in range(batch.num_rows):
        yield [np.frombuffer(batch.column(c)[row].as_buffer(), kind).reshape(-1, width) for c, (kind, width) in enumerate(kinds)]


def summed(points: DataFrame, make) -> np.ndarray:
    """The sum over all tasks of the vector that `make` returns for a batch; each task sends one vector, and these are
    added by their parts in the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = make(batch)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "v"])

    got = points.mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()  # as long as the vector
    out = np.zeros(got.num_rows)
    out[got.column("at").to_numpy()] = got.column("v").to_numpy()
    return out


# ---------------------------------------------------------------- a neural regressor


class Network:
    """A fully connected network with tanh units and one linear output, over a flat vector of weights."""

    def __init__(self, sizes: list[int]):
        self.sizes = sizes
        self.shapes = list(zip(sizes[:-1], sizes[1:], strict=True))
        self.length = sum((i + 1) * o for i, o in self.shapes)

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([np.concatenate((rng.uniform(-1, 1, i * o) * np.sqrt(6 / (i + o)), np.zeros(o))) for i, o in self.shapes])

    def layers(self, w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for i, o in self.shapes:
            out.append((w[at : at + i * o].reshape(i, o), w[at + i * o : at + (i + 1) * o]))
            at += (i + 1) * o
        return out

    def forward(self, w: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """What every layer puts out, the input first."""
        out = [x]
        layers = self.layers(w)
        for k, (a, b) in enumerate(layers):
            z = out[-1] @ a + b
            out.append(z if k == len(layers) - 1 else np.tanh(z))
        return out

    def loss_and_gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray | float = 1.0) -> np.ndarray:
        """(sum of half squared errors, its gradient) as one vector, by back-propagation; each row counts n times."""
        out = self.forward(w, x)
        error = out[-1][:, 0] - y
        parts, delta = [], (n * error)[:, None]
        layers = self.layers(w)
        for k in range(len(layers) - 1, -1, -1):
            parts.append(np.concatenate(((out[k].T @ delta).ravel(), delta.sum(0))))
            if k:
                delta = (delta @ layers[k][0].T) * (1 - out[k] ** 2)
        return np.concatenate(([0.5 * (error @ (n * error))], *parts[::-1]))


def lbfgs(value, w: np.ndarray, rounds: int, tolerance: float, memory: int = 10) -> np.ndarray:
    """Minimise value(w) -> (loss, gradient) by limited-memory quasi-Newton steps with a backtracking line search."""
    loss, grad = value(w)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.abs(grad).max() < tolerance:
            break
        q, used = grad.copy(), []
        for s, y, rho in reversed(steps):
            a = rho * (s @ q)
            used.append(a)
            q -= a * y
        if steps:
            s, y, _ = steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(steps, reversed(used), strict=True):
            q += (a - rho * (y @ q)) * s
        slope = -(grad @ q)
        if slope >= 0:
            q, slope, steps = grad, -(grad @ grad), []
        size = 1.0 if steps else min(1.0, 1.0 / np.abs(grad).sum())
        for _ in range(25):
            new = w - size * q
            new_loss, new_grad = value(new)
            if new_loss <= loss + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = new - w, new_grad - grad
        if s @ y > 1e-12:
            steps = [*steps, (s, y, 1 / (s @ y))][-memory:]
        done = loss - new_loss < tolerance * max(abs(loss), 1e-12)
        w, loss, grad = new, new_loss, new_grad
        if done:
            break
    return w


class NeuralRegressor(Estimator):
    """A network for a number: `layers` hidden sizes, weights penalised by `regParam`, fitted on `features` and `label`.

    Every evaluation is one job over the cached blocks of rows: each task back-propagates its rows, equal ones at once
    against their mean label, and sends the sum of its gradients; what their labels differ by is added to the loss. The
    label is standardised; features should be.
    """

    def __init__(self, layers: list[int] | None = None, maxIter: int = 200, regParam: float = 1e-4, tol: float = 1e-6, seed: int = 42):
        super().__init__()
        self.layers, self.rounds, self.penalty, self.tolerance, self.seed = list(layers or [32, 16]), maxIter, regParam, tol, seed

    def _fit(self, dataset: DataFrame) -> NeuralModel:
        points = dataset.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))
        facts = points.agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.stddev_pop("y").alias("s"), F.max(F.size("x")).alias("p")).first()
        if not facts["n"]:
            raise ValueError("no rows to fit a network to")
        shift, width, n = facts["m"], facts["s"] or 1.0, facts["n"]
        net = Network([facts["p"], *self.layers, 1])

        def entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            y = (batch.column(1).to_numpy() - shift) / width
            return _rows(batch), np.column_stack((np.ones(len(y)), y, y * y))

        blocks = packed(points, entries).persist()
        try:

            def value(w: np.ndarray) -> tuple[float, np.ndarray]:
                def part(batch: pa.RecordBatch) -> np.ndarray:
                    total = np.zeros(net.length + 1)
                    for x, sums in _blocks(batch, (float, net.sizes[0]), (float, 3)):
                        times, mean = sums[:, 0], sums[:, 1] / sums[:, 0]
                        total += net.loss_and_gradient(w, x, mean, times)
                        total[0] += 0.5 * np.maximum(sums[:, 2] - times * mean**2, 0).sum()
                    return total

                got = summed(blocks, part) / n
                return got[0] + 0.5 * self.penalty * (w @ w), got[1:] + self.penalty * w

            w = lbfgs(value, net.start(self.seed), self.rounds, self.tolerance)
        finally:
            blocks.unpersist()
        return NeuralModel(net, w, shift, width)


class NeuralModel(Model):
    def __init__(self, net: Network, weights: np.ndarray, shift: float, width: float):
        super().__init__()
        self.net, self.weights, self.shift, self.width = net, weights, shift, width

    def _transform(self, dataset: DataFrame) -> DataFrame:
        net, w, shift, width = self.net, self.weights, self.shift, self.width

        @F.arrow_udf("double")
        def predict(x: pa.Array) -> pa.Array:
            return pa.array(net.forward(w, _matrix(x))[-1][:, 0] * width + shift if len(x) else [], pa.float64())

        return dataset.withColumn("prediction", predict(vector_to_array("features")))


# ---------------------------------------------------------------- boosted trees for several classes


class BinnedTree:
    """A complete tree over binned features: node k has the children 2 k + 1 and 2 k + 2; a row goes left where its bin is
    at most `cut`. Nodes without a split send all rows left."""

    def __init__(self, depth: int):
        self.depth = depth
        self.feature = np.zeros(2**depth - 1, np.int64)
        self.cut = np.full(2**depth - 1, 2**15, np.int64)
        self.value = np.zeros(2**depth)

    def node_of(self, bins: np.ndarray, level: int) -> np.ndarray:
        """Place of each row within a level."""
        at = np.zeros(len(bins), np.int64)
        for d in range(level):
            node = 2**d - 1 + at
            at = 2 * at + (bins[np.arange(len(bins)), self.feature[node]] > self.cut[node])
        return at


def tree_scores(bins: np.ndarray, trees: list[list[BinnedTree]], classes: int) -> np.ndarray:
    out = np.zeros((len(bins), classes))
    for group in trees:
        for k, tree in enumerate(group):
            out[:, k] += tree.value[tree.node_of(bins, tree.depth)]
    return out


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class SoftmaxBoosting(Estimator):
    """Boosted trees for `classes` classes, labels 0 to classes - 1: every round grows one tree a class on the gradients
    of the softmax loss.

    Features are cut in at most `bins` bins at exact quantiles, and rows of equal bins, which have equal scores, are one
    row of a block with its number of each class. A level of all classes' trees is one job: each task sums gradients and
    curvatures by class, node, feature and bin, the sums meet in the shuffle, and the driver picks the splits. Scores so far are written every `keep` rounds, so that a task repeats few trees and lineage stays short.
    """

    def __init__(self, classes: int, maxIter: int = 50, maxDepth: int = 5, stepSize: float = 0.1, bins: int = 32, regLambda: float = 1.0, minGain: float = 1e-6, keep: int = 10):
        super().__init__()
        self.classes, self.rounds, self.depth, self.rate, self.bins, self.penalty, self.least, self.keep = classes, maxIter, maxDepth, stepSize, bins, regLambda, minGain, keep

    def _edges(self, points: DataFrame, p: int) -> list[np.ndarray]:
        shares = [k / self.bins for k in range(1, self.bins)]
        found = quantiles(points, {str(k): F.col("x")[k] for k in range(p)}, shares)
        return [np.unique(np.array([v for v in found[str(k)] if v is not None], float)) for k in range(p)]

    def _fit(self, dataset: DataFrame) -> SoftmaxModel:
        ensure_checkpoints(dataset.sparkSession)
        source = dataset.select(vector_to_array("features").alias("x"), F.col("label").cast("double").cast("int").alias("y")).persist()
        first = source.first()
        if first is None:
            source.unpersist()
            raise ValueError("no rows to boost")
        p, classes = len(first["x"]), self.classes
        edges = self._edges(source, p)
        counts = {r["y"]: r["n"] for r in source.groupBy("y").agg(F.count("*").alias("n")).collect()}  # a row a class
        prior = np.log(np.maximum([counts.get(k, 0) for k in range(classes)], 0.5) / sum(counts.values()))

        def entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            return binned_rows(_rows(batch), edges).astype(np.int16), np.column_stack((np.ones(len(y)), y[:, None] == np.arange(classes))).astype(float)

        # bins, (rows, rows of each class), scores so far
        state = packed(source, entries).withColumn("f", F.lit(None).cast("binary")).checkpoint()
        source.unpersist()
        trees: list[list[BinnedTree]] = []
        fresh: list[list[BinnedTree]] = []
        width = max(len(e) for e in edges) + 1
        for _ in range(self.rounds):
            group = [BinnedTree(self.depth) for _ in range(classes)]
            for level in range(self.depth + 1):
                nodes = 2**level
                leaf = level == self.depth

                def sums(batch: pa.RecordBatch, group=group, level=level, nodes=nodes, leaf=leaf, fresh=tuple(fresh)) -> np.ndarray:
                    total = 0.0
                    for b, n, f in _scored(batch, p, prior):
                        share = softmax(f + tree_scores(b, list(fresh), classes))
                        out = []
                        for k, tree in enumerate(group):
                            g, h = n[:, 0] * share[:, k] - n[:, k + 1], n[:, 0] * np.maximum(share[:, k] * (1 - share[:, k]), 1e-16)
                            at = tree.node_of(b, level)
                            for j in range(1 if leaf else p):
                                cell = at if leaf else at * width + b[:, j]
                                out += [np.bincount(cell, v, nodes * (1 if leaf else width)) for v in (g, h)]
                        total = total + np.concatenate(out)
                    return total

                got = summed(state, sums)
                if leaf:
                    got = got.reshape(classes, 2, nodes)
                    for k, tree in enumerate(group):
                        tree.value = -self.rate * (classes - 1) / classes * got[k, 0] / (got[k, 1] + self.penalty)
                else:
                    self._split(group, got.reshape(classes, p, 2, nodes, width), level)
            trees.append(group)
            fresh.append(group)
            if len(fresh) == self.keep:
                state, fresh = _advanced(state, fresh, p, prior), []
        return SoftmaxModel(edges, prior, trees, classes)

    def _split(self, group: list[BinnedTree], sums: np.ndarray, level: int) -> None:
        upto = sums.cumsum(-1)  # class, feature, (g, h), node, bin
        g, h = upto[:, :, 0], upto[:, :, 1]
        whole_g, whole_h = g[..., -1:], h[..., -1:]
        score = lambda a, b: a * a / (b + self.penalty)
        gain = score(g, h) + score(whole_g - g, whole_h - h) - score(whole_g, whole_h)
        gain[..., -1] = 0
        for k, tree in enumerate(group):
            for node in range(gain.shape[2]):
                own = gain[k, :, node]
                j, cut = np.unravel_index(own.argmax(), own.shape)
                if own[j, cut] > self.least:
                    tree.feature[2**level - 1 + node], tree.cut[2**level - 1 + node] = j, cut


def binned_rows(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)])


def _scored(batch: pa.RecordBatch, p: int, prior: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bins, counts and scores of each block; before any are written, all scores are the prior."""
    for row, (b, n) in enumerate(_blocks(batch, (np.int16, p), (float, len(prior) + 1))):
        f = batch.column(2)[row]
        yield b.astype(np.int64), n, np.frombuffer(f.as_buffer(), float).reshape(-1, len(prior)) if f.is_valid else np.tile(prior, (len(b), 1))


def _advanced(state: DataFrame, fresh: list[list[BinnedTree]], p: int, prior: np.ndarray) -> DataFrame:
    """The blocks with the scores of further trees."""
    trees = list(fresh)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [(f + tree_scores(b, trees, len(prior))).tobytes() for b, _, f in _scored(batch, p, prior)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.binary())], names=["k", "s", "f"])

    return state.mapInArrow(run, "k binary, s binary, f binary").checkpoint()


class SoftmaxModel(Model):
    """Adds `probability`, an array of the classes' shares, and `prediction`, the greatest's number."""

    def __init__(self, edges: list[np.ndarray], prior: np.ndarray, trees: list[list[BinnedTree]], classes: int):
        super().__init__()
        self.edges, self.prior, self.trees, self.classes = edges, prior, trees, classes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        edges, prior, trees, classes = self.edges, self.prior, self.trees, self.classes

        @F.arrow_udf("array<double>")
        def shares(x: pa.Array) -> pa.Array:
            if not len(x):
                return pa.array([], pa.list_(pa.float64()))
            made = softmax(prior + tree_scores(binned_rows(_matrix(x), edges), trees, classes))
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * classes), pa.array(made.ravel()))

        made = dataset.withColumn("probability", shares(vector_to_array("features")))
        return made.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))
