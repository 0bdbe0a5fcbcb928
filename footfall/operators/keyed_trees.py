"""Boosted regression trees per key, fitted in parallel and scored in generated code.

Every counter has an ensemble of its own, as small as its history. ``fit_keyed_trees`` fits the counters of
a hash bucket in one grouped call, one after another: features are cut into at most ``bins`` quantile bins, a node's split is the best of the
histogram sums of its rows, and trees grow level by level to complete binary trees (a node without a
useful split passes all rows to the left). The result is one row a key with the trees laid out as flat
arrays. ``predict_keyed`` joins rows with their key's arrays and walks the trees by ``aggregate`` over the
levels: Column expressions, no Python.

A counter's rows are its rolled-up history (a row a day), bounded by the calendar and not by the volume of
readings. Missing labels are left out; missing features count as 0, as in ``regress.feature_table``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.operators.forecast import BUCKETS, fit_partitions

TREES_SCHEMA = "{key} {type}, n long, base double, depth int, feature array<int>, threshold array<double>, leaf array<double>, gain array<double>"


@dataclass(frozen=True)
class TreeConfig:
    rounds: int = 7
    depth: int = 4                # 16 leaves at most, the nearest to 9 grown leaf by leaf
    learning_rate: float = 0.05
    bins: int = 64
    min_rows: int = 20            # rows on each side of a split


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Upper edges of a feature's bins: midpoints between distinct values, or between quantiles."""
    value = np.unique(x)
    if len(value) > bins:
        value = np.unique(np.quantile(x, np.linspace(0, 1, bins), method="inverted_cdf"))
    return (value[1:] + value[:-1]) / 2


def _grow(code: np.ndarray, widths: list[int], residual: np.ndarray, cfg: TreeConfig):
    """One tree: (feature, bin) of each inner node by level, the leaf of each row, and the gains."""
    inner = (1 << cfg.depth) - 1
    feature, cut, gain = np.full(inner, -1), np.zeros(inner, int), np.zeros(inner)
    node = np.zeros(len(residual), int)
    useful, wide = [f for f, w in enumerate(widths) if w > 1], max(widths, default=1)
    # the histograms of all features and nodes of a level are one array of equal rows
    row = len(widths) * wide
    place, again = code + wide * np.arange(len(widths)), np.repeat(residual, len(widths))
    inside = np.arange(wide - 1) < np.array(widths, int)[:, None] - 1
    for level in range(cfg.depth):
        first, width = (1 << level) - 1, 1 << level
        local = node - first
        n_all, s_all = np.bincount(local, minlength=width), np.bincount(local, residual, minlength=width)
        best = np.full(width, 1e-12 * max(float(residual @ residual), 1e-300))
        if useful:
            cell = (local[:, None] * row + place).ravel()
            n = np.cumsum(np.bincount(cell, minlength=width * row).reshape(width, -1, wide), 2)[:, :, :-1]
            s = np.cumsum(np.bincount(cell, again, minlength=width * row).reshape(width, -1, wide), 2)[:, :, :-1]
            other = n_all[:, None, None] - n
            ok = (n >= cfg.min_rows) & (other >= cfg.min_rows) & inside
            with np.errstate(divide="ignore", invalid="ignore"):
                score = s**2 / n + (s_all[:, None, None] - s)**2 / other - (s_all**2 / np.maximum(n_all, 1))[:, None, None]
            score = np.where(ok, score, -np.inf)
            tops = score.argmax(2)
            values = np.take_along_axis(score, tops[:, :, None], 2)[:, :, 0]
        for f in useful:
            better = values[:, f] > best * (1 + 1e-12)   # ties stay with the earlier feature
            if better.any():
                best = np.where(better, values[:, f], best)
                at = first + np.flatnonzero(better)
                feature[at], cut[at], gain[at] = f, tops[better, f], values[better, f]
        f = feature[node]
        right = (f >= 0) & (code[np.arange(len(code)), np.maximum(f, 0)] > cut[node])
        node = 2 * node + 1 + right
    return feature, cut, node - inner, gain


def fit_arrays(x: np.ndarray, y: np.ndarray, cfg: TreeConfig):
    """(base, feature, threshold, leaf, gain) of one ensemble; the arrays hold all rounds one after another."""
    edges = [_edges(x[:, f], cfg.bins) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1) if edges else np.zeros((len(x), 0), int)
    widths = [len(e) + 1 for e in edges]
    base = float(y.mean())
    fitted, parts = np.full(len(y), base), []
    for _ in range(cfg.rounds):
        residual = y - fitted
        feature, cut, leaf, gain = _grow(code, widths, residual, cfg)
        leaves = 1 << cfg.depth
        n = np.bincount(leaf, minlength=leaves)
        value = cfg.learning_rate * np.bincount(leaf, residual, minlength=leaves) / np.maximum(n, 1)
        fitted += value[leaf]
        threshold = np.array([edges[f][c] if f >= 0 else 0.0 for f, c in zip(feature, cut)])
        parts.append((feature, threshold, value, gain))
    feature, threshold, leaf, gain = (np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0),) * 4
    return base, feature, threshold, leaf, gain


def fit_keyed_trees(train: DataFrame, features: Sequence[str], label: str = "visits", key: str = "counterId",
                    config: TreeConfig = TreeConfig()) -> DataFrame:
    """One row a key: its ensemble as flat arrays. Keys without a label get no row; NULL is a key like any."""
    names = list(features)
    value = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0))
    y = F.nanvl(F.col(label).cast("double"), F.lit(None))
    # the key travels as text, which keeps NULL and every digit; many keys share one grouped call
    rows = train.select(F.col(key).cast("string").alias("_key"), F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("_bucket"), y.alias("_y"),
                        *[value(c).alias(f"_x{i}") for i, c in enumerate(names)]).where(F.col("_y").isNotNull())
    columns = ["_y", *[f"_x{i}" for i in range(len(names))]]

    def fit(bucket: tuple, h: pd.DataFrame) -> pd.DataFrame:
        number, keys = pd.factorize(h["_key"], use_na_sentinel=False)
        values = h[columns].to_numpy(float)
        # rows in an order of their own values, so that a task that is run again gives the same sums
        order = np.lexsort([*values.T[::-1], number])
        number, values = number[order], values[order]
        out = []
        for part in np.split(values, np.flatnonzero(np.diff(number)) + 1):
            base, feature, threshold, leaf, gain = fit_arrays(part[:, 1:], part[:, 0], config)
            out.append({"n": len(part), "base": base, "depth": config.depth, "feature": feature.astype("int32"), "threshold": threshold, "leaf": leaf, "gain": gain})
        return pd.DataFrame(out).assign(_key=[None if pd.isna(k) else k for k in keys])

    schema, kind = TREES_SCHEMA.format(key="_key", type="string"), train.schema[key].dataType
    fitted = rows.repartition(fit_partitions(train.sparkSession), "_bucket").groupBy("_bucket").applyInPandas(fit, schema)
    return fitted.select(F.col("_key").cast(kind).alias(key), *[c for c in fitted.columns if c != "_key"])


def predict_keyed(trees: DataFrame, rows: DataFrame, features: Sequence[str], key: str = "counterId",
                  config: TreeConfig = TreeConfig(), out_col: str = "visits_pred") -> DataFrame:
    """``rows`` with the prediction of their own key's ensemble, NULL where the key has none.

    A walk is one ``aggregate`` per level: node -> 2 node + 1, or + 2 beyond the threshold."""
    inner, leaves = (1 << config.depth) - 1, 1 << config.depth
    value = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0))
    model = trees.select(F.col(key).alias("_key"), F.col("base").alias("_base"), F.col("feature").alias("_feature"),
                         F.col("threshold").alias("_threshold"), F.col("leaf").alias("_leaf"))
    out = rows.withColumn("_x", F.array(*[value(c) for c in features]) if features else F.array(F.lit(0.0)))
    out = out.join(model, out[key].eqNullSafe(model["_key"]), "left")

    def leaf_value(tree: Column) -> Column:
        def down(node: Column, _: Column) -> Column:
            at = tree * inner + node + 1
            f = F.element_at("_feature", at)
            beyond = (f >= 0) & (F.element_at("_x", F.greatest(f, F.lit(0)) + 1) > F.element_at("_threshold", at))
            return 2 * node + 1 + beyond.cast("int")
        node = F.aggregate(F.sequence(F.lit(1), F.lit(config.depth)), F.lit(0), down)
        return F.element_at("_leaf", tree * leaves + node - inner + 1)

    trees_of = F.sequence(F.lit(0), F.lit(config.rounds - 1)) if config.rounds else F.array().cast("array<int>")
    total = F.aggregate(trees_of, F.col("_base"), lambda a, t: a + leaf_value(t))
    pred = F.when(F.col("_base").isNotNull(), total)
    return out.withColumn(out_col, pred).drop("_x", "_key", "_base", "_feature", "_threshold", "_leaf")


def keyed_importance(trees: DataFrame, features: Sequence[str], key: str = "counterId") -> DataFrame:
    """(key, feature, splits, gain): how often and how well each feature splits, over a key's whole ensemble."""
    names = F.array(*[F.lit(n) for n in features])
    split = trees.select(F.col(key), F.explode(F.arrays_zip("feature", "gain")).alias("_s")).where(F.col("_s.feature") >= 0)
    return (split.groupBy(F.col(key), F.element_at(names, F.col("_s.feature") + 1).alias("feature"))
            .agg(F.count(F.lit(1)).alias("splits"), F.sum("_s.gain").alias("gain")))
