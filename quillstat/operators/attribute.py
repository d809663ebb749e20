"""Additive attributions of tree models: what each feature of a row adds to the model's mean prediction.

A fitted Spark ML tree model is stored by its own writer, which gives a table of nodes. How many of the given rows pass
each node is counted in one job over all rows; these counts say how a feature that is not known is averaged over. In a
second job every row gets its Shapley values: a leaf is a product game over the features on its path, each of which a
row either meets (1) or misses (0) while its absence counts as the share of rows that go the leaf's way. The Shapley
value of a product game is an integral of a polynomial, of a degree under the number of features on the path, which
Gauss-Legendre nodes give exactly; so all rows of a batch are done at once, without visiting subsets. Rows that lie
between the same thresholds of a tree go the same way at all of its nodes, so a tree's values are worked out once for
such a cell, not for each row.

The values of a row add up to its prediction less the mean prediction of the given rows. For a forest that is the mean
over its trees (of a classifier, the probability of class 1), for boosted trees the weighted sum, which of a classifier
is half of the log-odds.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.functions.ranks import shared_folder, spread

#: Rows whose path factors are held at once, and up to how many cells a tree's values are worked out for all of them.
ROWS_AT_ONCE, CELLS = 512, 4096


@dataclass
class Tree:
    """Nodes as arrays; feature is -1 at a leaf. `left` holds rows whose value is at most the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weight: float

    def visited(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(node, the rows of x that pass it), parents first."""
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            yield node, rows
            if self.feature[node] >= 0:
                goes = x[rows, self.feature[node]] <= self.threshold[node]
                todo += [(int(self.left[node]), rows[goes]), (int(self.right[node]), rows[~goes])]

    def leaves(self, cover: np.ndarray) -> Iterator[tuple[float, list[int], np.ndarray, np.ndarray, np.ndarray]]:
        """(value, features of the path, low and high of each, share of the rows that go this way at each feature's nodes)."""
        todo: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
        while todo:
            node, path = todo.pop()
            f = int(self.feature[node])
            if f < 0:
                names = list(path)
                low, high, share = (np.array([path[k][p] for k in names]) for p in range(3))
                yield float(self.value[node]), names, low, high, share
                continue
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            t = float(self.threshold[node])
            for child, span in ((int(self.left[node]), (low, min(high, t))), (int(self.right[node]), (max(low, t), high))):
                part = cover[child] / cover[node] if cover[node] else 0.5
                todo.append((child, path | {f: (*span, share * part)}))


def node_tables(fitted, classify: bool = False) -> list[Tree]:
    """The trees of a fitted Spark ML tree model, by its stored node table. Their size is the model's own."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    folder = f"{shared_folder(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    fitted.write().overwrite().save(folder)
    rows = spark.read.parquet(f"{folder}/data")
    rows = rows if "treeID" in rows.columns else rows.select(F.lit(0).alias("treeID"), F.struct(*rows.columns).alias("nodeData"))
    nodes = rows.select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    weights = list(getattr(fitted, "treeWeights", None) or [1.0])
    boosted = type(fitted).__name__.startswith("GBT")
    trees = []
    for k in sorted({r["treeID"] for r in nodes}):
        own = [r for r in nodes if r["treeID"] == k]
        if [r["id"] for r in own] != list(range(len(own))):
            raise ValueError("a tree's nodes are not numbered from 0")
        if any(r["split"]["numCategories"] != -1 for r in own if r["leftChild"] >= 0):
            raise ValueError("splits by categories have no order")
        value = [r["impurityStats"][1] / sum(r["impurityStats"]) if classify and not boosted else r["prediction"] for r in own]
        leaf = np.array([r["leftChild"] < 0 for r in own])
        trees.append(
            Tree(
                np.where(leaf, -1, [r["split"]["featureIndex"] for r in own]),
                np.array([r["split"]["leftCategoriesOrThreshold"][0] if r["leftChild"] >= 0 else 0.0 for r in own]),
                np.array([r["leftChild"] for r in own]),
                np.array([r["rightChild"] for r in own]),
                np.array(value, float),
                weights[k] if boosted else 1.0 / len(weights),
            )
        )
    return trees


class Cells:
    """The cells that a tree's thresholds cut the space of its features in: all rows of one go the same way."""

    def __init__(self, tree: Tree):
        self.features = np.unique(tree.feature[tree.feature >= 0]).tolist()
        self.cuts = [np.unique(tree.threshold[tree.feature == f]) for f in self.features]
        self.count = math.prod(len(c) + 1 for c in self.cuts)
        self.few = self.count <= CELLS

    def of(self, x: np.ndarray) -> np.ndarray:
        """A number of each row's cell; where there are few cells, from 0 to count - 1."""
        code, size = np.zeros(len(x), np.int64), 1
        for f, cuts in zip(self.features, self.cuts, strict=True):
            if size * (len(cuts) + 1) > 2**62:
                code = np.unique(code, return_inverse=True)[1]
                size = len(x)
            code = code * (len(cuts) + 1) + np.searchsorted(cuts, x[:, f])
            size *= len(cuts) + 1
        return code

    def every(self, width: int) -> np.ndarray:
        """A row of each cell, by its number: the greatest values in it."""
        out = np.zeros((self.count, width))
        at = np.indices([len(c) + 1 for c in self.cuts]).reshape(len(self.cuts), self.count)
        for f, cuts, own in zip(self.features, self.cuts, at, strict=True):
            out[:, f] = np.append(cuts, np.inf)[own]
        return out


def covers(points: DataFrame, trees: list[Tree]) -> list[np.ndarray]:
    """How many rows of `points` (x array<double>) pass each node: counted in each task by cell, summed by node."""
    start = np.concatenate(([0], np.cumsum([len(t.feature) for t in trees])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(start[-1], np.int64)
        cells = [Cells(t) for t in trees]
        held = [np.zeros(c.count, np.int64) if c.few else None for c in cells]
        width = 0

        def pass_on(k: int, x: np.ndarray, n: np.ndarray) -> None:
            for node, rows in trees[k].visited(x):
                seen[start[k] + node] += n[rows].sum()

        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                width = x.shape[1]
                for k, c in enumerate(cells):
                    if c.few:
                        held[k] += np.bincount(c.of(x), minlength=c.count)
                    else:
                        _, first, n = np.unique(c.of(x), return_index=True, return_counts=True)
                        pass_on(k, x[first], n)
        if width:
            for k, c in enumerate(cells):
                if c.few:
                    pass_on(k, c.every(width), held[k])
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["node", "n"])

    total = np.zeros(start[-1], np.int64)
    for r in points.select("x").mapInArrow(run, "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("n")).collect():  # a row a node
        total[r["node"]] = r["n"]
    return [total[start[k] : start[k + 1]] for k in range(len(trees))]


def tree_values(x: np.ndarray, tree: Tree, cover: np.ndarray) -> np.ndarray:
    """[row, feature] Shapley values of one tree, times its weight."""
    out = np.zeros(x.shape)
    paths = list(tree.leaves(cover))
    for k in range(0, len(x), ROWS_AT_ONCE):
        part, made = x[k : k + ROWS_AT_ONCE], out[k : k + ROWS_AT_ONCE]
        for value, names, low, high, share in paths:
            if not names or value == 0:
                continue
            m = len(names)
            nodes, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
            t, weights = (nodes + 1) / 2, weights / 2
            meets = ((part[:, names] > low) & (part[:, names] <= high)).astype(float)  # [row, m]
            factor = meets[:, :, None] * t + share[None, :, None] * (1 - t)  # [row, m, node]
            before, behind = np.ones_like(factor), np.ones_like(factor)
            np.cumprod(factor[:, :-1], axis=1, out=before[:, 1:])
            behind[:, :-1] = np.cumprod(factor[:, :0:-1], axis=1)[:, ::-1]
            rest = (before * behind) @ weights  # the others' product, integrated
            made[:, names] += tree.weight * value * (meets - share) * rest
    return out


class Attributor:
    """[row, feature] Shapley values of all trees together. A tree of few cells keeps the values of all of them; of another
    tree, the cells that occur in a batch are worked out."""

    def __init__(self, trees: list[Tree], cover: list[np.ndarray]):
        self.parts = [(t, c, Cells(t)) for t, c in zip(trees, cover, strict=True)]
        self.kept: dict[int, np.ndarray] = {}

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape)
        for k, (tree, cover, cells) in enumerate(self.parts):
            at = cells.of(x)
            if cells.few and k not in self.kept and 2 * len(x) >= cells.count:
                self.kept[k] = tree_values(cells.every(x.shape[1]), tree, cover)
            if k in self.kept:
                out += self.kept[k][at]
            else:
                _, first, at = np.unique(at, return_index=True, return_inverse=True)
                out += tree_values(x[first], tree, cover)[at]
        return out


def batch_attributions(x: np.ndarray, trees: list[Tree], cover: list[np.ndarray]) -> np.ndarray:
    """[row, feature] Shapley values of all trees together."""
    return Attributor(trees, cover)(x)


def tree_attributions(rows: DataFrame, names: list[str], fitted, classify: bool = False, x: Column | None = None) -> tuple[DataFrame, float]:
    """(rows with `attributions`, an array in the order of `names`, and `explained`, the prediction that they add up to; the mean prediction).

    x is an array of what the model reads, the named columns by default. Rows with a missing value get null. An empty
    table gives an empty one. Rows are dealt out first, as a file of many narrow rows may be one task's.
    """
    trees = node_tables(fitted, classify)
    rows = spread(rows)
    if x is None:
        x = F.array(*[F.nanvl(F.col(f"`{n}`").cast("double"), F.lit(None).cast("double")) for n in names])
    points = rows.withColumn("x", x)
    known = ~F.exists("x", lambda v: v.isNull())
    cover = covers(points.filter(known), trees)
    base = sum(t.weight * float(sum(t.value[k] * c[k] for k in np.flatnonzero(t.feature < 0))) / max(int(c[0]), 1) for t, c in zip(trees, cover, strict=True))

    @F.arrow_udf("array<double>")
    def explain(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = Attributor(trees, cover)
        for batch in batches:
            good = len(batch) - batch.null_count
            values = made(batch.flatten().to_numpy(zero_copy_only=False).reshape(good, -1)) if good else np.zeros((0, 0))
            ends = np.concatenate(([0], np.cumsum(batch.is_valid().to_numpy(zero_copy_only=False)))) * values.shape[1]
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.ravel()), mask=batch.is_null())

    out = points.withColumn("attributions", explain(F.when(known, F.col("x"))))
    return out.withColumn("explained", F.aggregate("attributions", F.lit(base), lambda a, v: a + v)).select(*rows.columns, "attributions", "explained"), base


def mean_attributions(attributed: DataFrame, names: list[str]) -> DataFrame:
    """feature, mean_abs, percentage, rank: the mean size of each feature's attributions over all rows."""
    from pyspark.sql import Window

    cells = [F.struct(F.lit(n).alias("feature"), F.coalesce(F.avg(F.abs(F.col("attributions")[k])), F.lit(0.0)).alias("mean_abs")) for k, n in enumerate(names)]
    rows = attributed.agg(F.array(*cells).alias("r")).select(F.inline("r"))  # a row a feature
    whole = F.sum("mean_abs").over(Window.partitionBy())
    return rows.select("feature", "mean_abs", F.when(whole > 0, 100 * F.col("mean_abs") / whole).otherwise(0.0).alias("percentage"), F.row_number().over(Window.orderBy(F.desc("mean_abs"), "feature")).alias("rank"))
