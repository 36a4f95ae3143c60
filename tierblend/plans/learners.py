"""Learners: families of models that are fitted for many configurations and left-out folds."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierblend.operators import cell_trees, margins, neighbours, nodes, ridge, trees
from tierblend.operators.encode import LeafCodes
from tierblend.operators.scores import class1_score, minmax_calibrate
from tierblend.operators.splits import LEVEL1_SEED, stratified_folds
from tierblend.session import settle

#: Models fitted at the same time. Each fit is itself spread over the cluster.
PARALLEL_FITS = 8


@dataclass(frozen=True)
class FoldedTable:
    """A training table with a fold column, stored by fold so that a fold is read on its own.

    ``grouped`` holds the same rows for linear fits, equal ones as one with a ``WEIGHT`` (see :func:`_group_rows`).
    """

    df: DataFrame
    key: str = "ID"
    label: str = "label"
    features: str = "features"
    fold: str = "fold"
    counts: tuple[tuple[int, int], ...] = ()
    grouped: DataFrame | None = None

    @property
    def folds(self) -> list[int]:
        return [f for f, _ in self.counts]

    def without(self, fold: int | None) -> DataFrame:
        return self.df if fold is None else self.df.filter(F.col(self.fold) != fold)

    def fitted_without(self, fold: int | None, weighted: bool = True) -> DataFrame:
        """Label and features of the rows outside a fold, with their weight where equal rows are grouped."""
        if self.grouped is None or not weighted:
            return self.without(fold).select(self.label, self.features)
        rows = self.grouped if fold is None else self.grouped.filter(F.col(self.fold) != fold)
        return rows.select(self.label, self.features, WEIGHT)

    def only(self, fold: int) -> DataFrame:
        return self.df.filter(F.col(self.fold) == fold)

    def size_without(self, fold: int | None) -> int:
        return sum(n for f, n in self.counts if f != fold)


def fold_table(
    df: DataFrame, k: int = 5, seed: int = LEVEL1_SEED, key: str = "ID", label: str = "label", features: str = "features"
) -> FoldedTable:
    """Assign the folds once; every model of the level then shares them."""
    kept = df.select(key, F.col(label).cast("double").alias(label), features)
    stored = settle(stratified_folds(kept, label, key, k, seed), "folds", ("fold",))
    counts = tuple(sorted((r["fold"], r["count"]) for r in stored.groupBy("fold").count().collect()))
    return FoldedTable(_spread(stored, key, sum(n for _, n in counts)), key, label, features, "fold", counts)


#: Below this many rows a further piece of a table costs more than it brings.
ROWS_PER_PIECE = 10_000


def _spread(stored: DataFrame, key: str, rows: int) -> DataFrame:
    """Cut a stored table once more when it has fewer pieces than its rows and the cores can use."""
    cores = stored.sparkSession.sparkContext.defaultParallelism
    useful = max(1, min(cores, rows // ROWS_PER_PIECE))
    if stored.rdd.getNumPartitions() >= useful:
        return stored
    return settle(stored.repartition(useful, key), "spread")


#: Weight column of grouped rows, and the pieces into which the weights of a whole table are cut at least.
WEIGHT, PIECES = "_weight", 10_000


def _group_rows(table: FoldedTable) -> DataFrame | None:
    """Equal rows of a fold and label as one row with its count as weight, where that saves most of the rows.

    Leaf codes take few values however many rows there are. Spark takes the deviations that scale the features from the
    weights as well (n - sum(w^2) / n in place of n - 1), so no weight is above a ``PIECES``-th of the rows: the fits
    then follow those on single rows closely.
    """
    total = sum(n for _, n in table.counts)
    most = total // PIECES
    if most < 2:
        return None
    by = (table.label, table.fold, table.features)
    pieces = F.ceil(F.col("count") / F.lit(most)).cast("int")
    cut = table.df.groupBy(*by).count().withColumn("_pieces", pieces).withColumn(WEIGHT, F.col("count") / F.col("_pieces"))
    rows = settle(cut.withColumn("_piece", F.explode(F.sequence(F.lit(1), F.col("_pieces")))).select(*by, WEIGHT), "grouped")
    return rows if rows.count() * 4 <= total else None


#: Columns of cells: the bins of the features, and the rows in all and per fold. Wider tables are not grouped.
BINS, COUNT, MOST_FEATURES = "_bins", "_rows", 64


@dataclass(frozen=True)
class Cells:
    """A table for tree fits: rows with equal label and bins of all features are one, with their number per fold.

    A tree asks of a feature only on which side of a candidate threshold it lies, so fits and scores on bin numbers
    lose nothing against the candidates, and the cells are bounded by the bins, however many rows there are. ``edges``
    are the candidates per feature; x <= edge lies to the left.
    """

    table: FoldedTable
    edges: tuple[tuple[float, ...], ...]
    df: DataFrame | None = None

    def binned(self, df: DataFrame) -> DataFrame:
        """Add the bin numbers of the features."""
        at, into = ([f"_{kind}{i}" for i in range(len(self.edges))] for kind in "xb")
        # a Bucketizer puts x >= split to the right; one without a split is not accepted
        splits = [[-math.inf, *([math.nextafter(e, math.inf) for e in own] or [1e308]), math.inf] for own in self.edges]
        wide = df.withColumn("_x", vector_to_array(self.table.features))
        wide = wide.select(*df.columns, *[F.get("_x", F.lit(i)).alias(c) for i, c in enumerate(at)])
        cut = Bucketizer(splitsArray=splits, inputCols=at, outputCols=into, handleInvalid="keep").transform(wide)
        return cut.select(*df.columns, F.array(*[F.col(c).cast("int") for c in into]).alias(BINS))

    def coded(self, df: DataFrame) -> DataFrame:
        """The bin numbers in place of the features."""
        kept = [c for c in df.columns if c not in (self.table.features, BINS)]
        return df.select(*kept, array_to_vector(F.col(BINS).cast("array<double>")).alias(self.table.features))

    def fit(self, est, fold: int | None):
        """Fit an estimator of trees outside a fold. No cell weighs more than a ``PIECES``-th of the rows, as row
        sampling takes or leaves a cell (or its piece) as a whole; a leaf's least rows are counted by weight."""
        t, total = self.table, self.table.size_without(fold)
        most = max(1, sum(n for _, n in t.counts) // PIECES)
        rows = F.col(COUNT) if fold is None else F.col(COUNT) - F.col(f"{COUNT}{fold}")
        cut = self.df.select(t.label, BINS, rows.alias(COUNT)).where(F.col(COUNT) > 0)
        cut = cut.withColumn("_pieces", F.ceil(F.col(COUNT) / F.lit(most)).cast("int")).select(
            t.label, BINS, (F.col(COUNT) / F.col("_pieces")).alias(WEIGHT), F.explode(F.sequence(F.lit(1), F.col("_pieces"))))
        least = (est.getMinInstancesPerNode() - 0.5) / total
        est = est.copy().setWeightCol(WEIGHT).setMinInstancesPerNode(1).setMinWeightFractionPerNode(least)
        return est.fit(self.coded(cut).select(t.label, t.features, WEIGHT))


def _edges(table: FoldedTable, bins: int) -> tuple[tuple[float, ...], ...] | None:
    """Candidate thresholds per feature: between all values where these are few, otherwise about ``bins`` quantiles."""
    first = table.df.select(F.size(vector_to_array(table.features)).alias("n")).first()
    if first is None or first["n"] > MOST_FEATURES:
        return None
    names = [f"_x{i}" for i in range(first["n"])]
    wide = table.df.select(vector_to_array(table.features).alias("_x")).select(
        *[F.get("_x", F.lit(i)).alias(c) for i, c in enumerate(names)])
    about = wide.agg(*[F.approx_count_distinct(c).alias(c) for c in names]).first()
    few = [c for c in names if about[c] <= 2 * bins]
    held = wide.agg(F.lit(0), *[F.sort_array(F.collect_set(F.when(~F.isnan(c), F.col(c)))).alias(c) for c in few]).first()
    few = [c for c in few if len(held[c]) <= bins]
    many = [c for c in names if c not in few]
    cuts = wide.approxQuantile(many, [i / bins for i in range(1, bins)], 0.1 / bins) if many else []
    edges = {c: [(a + b) / 2 for a, b in zip(held[c], held[c][1:])] for c in few} | dict(zip(many, cuts))
    return tuple(tuple(sorted(set(edges[c]))) for c in names)


def _cells(table: FoldedTable, bins: int, anyhow: bool = False) -> Cells | None:
    """The cells of a table, where they save most of the rows, or ``anyhow``."""
    total = sum(n for _, n in table.counts)
    if total // PIECES < 2 and not anyhow:
        return None
    edges = _edges(table, bins)
    if edges is None:
        return None
    cells = Cells(table, edges)
    rows = cells.binned(table.df)
    if rows.agg(F.approx_count_distinct(F.struct(table.label, BINS))).first()[0] * 4 > total and not anyhow:
        return None
    per_fold = [F.count_if(F.col(table.fold) == f).alias(f"{COUNT}{f}") for f in table.folds]
    counted = rows.groupBy(table.label, BINS).agg(F.count(F.lit(1)).alias(COUNT), *per_fold)
    stored = settle(counted, "cells")
    pieces = max(1, min(stored.sparkSession.sparkContext.defaultParallelism, stored.count() // ROWS_PER_PIECE))
    if stored.rdd.getNumPartitions() != pieces:
        stored = settle(stored.repartition(pieces, BINS), "cells")
    return replace(cells, df=stored)


def run_parallel(spark: SparkSession, jobs: Sequence[Callable], width: int = PARALLEL_FITS) -> list:
    """Results of driver-side jobs started side by side, in order."""
    if len(jobs) <= 1:
        return [j() for j in jobs]
    with ThreadPoolExecutor(min(width, len(jobs))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(j)) for j in jobs]]


class Fitted:
    """Models by ``(configuration ordinal, left-out fold or None)``; scores are class-1 values in [0, 1]."""

    def __init__(self, table: FoldedTable, models: dict, calibration: str = "auto"):
        self.table, self.models, self.calibration = table, models, calibration

    def attach(self, df: DataFrame, cfg: int, fold: int | None, name: str) -> DataFrame:
        """Add the score of one model as a column; no rows move."""
        before = df.columns
        scored = class1_score(self.models[(cfg, fold)].transform(df), name, self.calibration)
        return scored.select(*before, name)

    def out_of_fold(self, cfgs: Sequence[int]) -> DataFrame:
        """``(cfg, fold, key, label, p)``: each row scored by the model that has not seen its fold."""
        t, out = self.table, None
        for cfg in cfgs:
            for i in t.folds:
                part = self.attach(t.only(i).select(t.key, t.label, t.fold, t.features), cfg, i, "p")
                part = part.select(F.lit(cfg).alias("cfg"), t.fold, t.key, t.label, "p")
                out = part if out is None else out.unionByName(part)
        return out

    def score(self, test: DataFrame, cfgs: Sequence[int]) -> DataFrame:
        """``(cfg, key, p)`` from the models fitted on the whole table."""
        out = None
        for cfg in cfgs:
            part = self.attach(test, cfg, None, "p").select(F.lit(cfg).alias("cfg"), self.table.key, "p")
            out = part if out is None else out.unionByName(part)
        return out


@dataclass(frozen=True)
class SparkLearner:
    """Any Spark ML estimator. ``build(params, n)`` returns it for a training set of n rows."""

    build: Callable
    calibration: str = "auto"

    def fit(self, table: FoldedTable, configs: Sequence[dict], folds: bool = True, whole: bool = False) -> Fitted:
        held = (table.folds if folds else []) + ([None] if whole else [])
        todo = [(c, f) for c in range(len(configs)) for f in held]

        def one(c, f):
            est = self.build(dict(configs[c]), table.size_without(f))
            weighted = table.grouped is not None and est.hasParam("weightCol")
            if weighted:
                est = est.setWeightCol(WEIGHT)
            return lambda: est.fit(table.fitted_without(f, weighted))

        models = run_parallel(table.df.sparkSession, [one(c, f) for c, f in todo])
        return Fitted(table, dict(zip(todo, models)), self.calibration)


@dataclass(frozen=True)
class L1SvmLearner:
    """Squared-hinge SVM with L1 penalty; all values of C and all folds share the passes."""

    max_iter: int = 60

    def fit(self, table: FoldedTable, configs: Sequence[dict], folds: bool = True, whole: bool = False) -> Fitted:
        cs = [float(c["C"]) for c in configs]
        rows, weight = (table.df, None) if table.grouped is None else (table.grouped, WEIGHT)
        found = margins.fit_l1_svm(
            rows, sorted(set(cs)), table.features, table.label, table.fold if folds else None, self.max_iter, weight=weight
        )
        held = (table.folds if folds else []) + ([None] if whole else [])
        models = {(i, f): found[(c, f)] for i, c in enumerate(cs) for f in held}
        return Fitted(table, models, "minmax")


class _FittedNeighbours(Fitted):
    def __init__(self, table: FoldedTable, configs: Sequence[dict], folds: bool):
        super().__init__(table, {}, "probability")
        self.configs = [dict(c) for c in configs]
        self.most = max(int(c["n_neighbors"]) for c in self.configs)
        self.own = self._join(table.df, table.fold) if folds else None

    def _join(self, queries: DataFrame, apart: str | None) -> DataFrame:
        t = self.table
        target = t.df.withColumn("_vec", vector_to_array(t.features))
        asked = target if queries is t.df else queries.withColumn("_vec", vector_to_array(t.features))
        return settle(neighbours.nearest(asked, target, self.most, t.key, "_vec", t.label, apart), "neighbours")

    def _votes(self, found: DataFrame, cfgs: Sequence[int]) -> DataFrame:
        t, out = self.table, None
        for kind in sorted({self.configs[c].get("weights", "uniform") for c in cfgs}):
            mine = [c for c in cfgs if self.configs[c].get("weights", "uniform") == kind]
            ks = [int(self.configs[c]["n_neighbors"]) for c in mine]
            votes = neighbours.vote(found, t.label, sorted(set(ks)), kind)
            named = [F.struct(F.lit(c).alias("cfg"), F.lit(k).alias("k")) for c, k in zip(mine, ks)]
            pairs = votes.withColumn("_c", F.explode(F.filter(F.array(*named), lambda s: s["k"] == F.col("k"))))
            part = pairs.select(F.col("_c.cfg").alias("cfg"), F.col("query").alias(t.key), "p")
            out = part if out is None else out.unionByName(part)
        return out

    def out_of_fold(self, cfgs: Sequence[int]) -> DataFrame:
        t = self.table
        rows = t.df.select(t.key, t.label, t.fold)
        return self._votes(self.own, cfgs).join(rows, t.key).select("cfg", t.fold, t.key, t.label, "p")

    def score(self, test: DataFrame, cfgs: Sequence[int]) -> DataFrame:
        return self._votes(self._join(test, None), cfgs)


@dataclass(frozen=True)
class KnnLearner:
    """k nearest neighbours; all k, both weightings and all folds come from one join."""

    def fit(self, table: FoldedTable, configs: Sequence[dict], folds: bool = True, whole: bool = False) -> Fitted:
        return _FittedNeighbours(table, configs, folds)


class _FittedRidge(Fitted):
    def __init__(self, table: FoldedTable, columns: Sequence[str], configs: Sequence[dict], models: dict):
        super().__init__(table, models, "minmax")
        self.columns = list(columns)

    def out_of_fold(self, cfgs: Sequence[int]) -> DataFrame:
        t, cells = self.table, []
        for c in cfgs:
            raw = None
            for f in t.folds:
                here = self.models[(c, f)].decision()
                raw = F.when(F.col(t.fold) == f, here) if raw is None else raw.when(F.col(t.fold) == f, here)
            cells.append(F.struct(F.lit(c).alias("cfg"), raw.alias("raw")))
        long = t.df.select(t.key, t.label, t.fold, F.explode(F.array(*cells)).alias("_c"))
        long = long.select("_c.cfg", t.fold, t.key, t.label, "_c.raw")
        return minmax_calibrate(long, "raw", "p", ["cfg", t.fold]).select("cfg", t.fold, t.key, t.label, "p")


@dataclass(frozen=True)
class RidgeLearner:
    """Ridge classifier on plain columns; all alphas and folds are solved from one aggregate."""

    columns: tuple[str, ...]

    def fit(self, table: FoldedTable, configs: Sequence[dict], folds: bool = True, whole: bool = False) -> Fitted:
        per_fold = ridge.moments(table.df, self.columns, table.label, table.fold)
        held = (table.folds if folds else []) + ([None] if whole else [])
        models = {}
        for f in held:
            m = ridge.merge_all(v for g, v in per_fold.items() if g != f)
            for i, c in enumerate(configs):
                models[(i, f)] = ridge.solve_ridge(m, self.columns, c["alpha"], c.get("fit_intercept", True))
        return _FittedRidge(table, self.columns, configs, models)


def logistic_learner(penalty: str, label: str = "label") -> SparkLearner:
    return SparkLearner(lambda p, n: margins.logistic(p["C"], penalty, n, label=label, fit_intercept=p.get("fit_intercept", True)))


def hinge_svm_learner(label: str = "label") -> SparkLearner:
    return SparkLearner(lambda p, n: margins.hinge_svm(p["C"], n, label=label, fit_intercept=p.get("fit_intercept", True), tol=p.get("tol", 1e-3)), "minmax")


#: Tree settings that are read off a larger fit, and those that change nothing.
_SHARED = ("n_estimators", "max_leaf_nodes", "n_jobs", "nthread", "silent", "model_type")
#: Tree fits at the same time: each holds its rows, as binned points, in executor memory.
PARALLEL_TREES = 4
#: From so many boosted fits on, small tables are fitted one fit per task as large ones are.
MANY_FITS = 40


class _FittedTrees(Fitted):
    """``models`` holds one fit per (group of configurations, left-out fold); configurations read their share of it."""

    def __init__(self, table: FoldedTable, models: dict, configs: Sequence[dict], group: Sequence[int],
                 cells: Sequence[Cells | None]):
        super().__init__(table, models, "probability")
        self.configs, self.group, self.cells = list(configs), list(group), list(cells)
        self._read: dict = {}

    def _ensemble(self, group: int, fold: int | None):
        if (group, fold) not in self._read:
            self._read[(group, fold)] = nodes.ensemble(self.models[(group, fold)], self.table.df.sparkSession)
        return self._read[(group, fold)]

    def _scored(self, df: DataFrame, group: int, fold: int | None, cfgs: Sequence[int], keep: Sequence[str]) -> DataFrame:
        """``(keep..., _cells)``: cfg and p for all configurations of a group from one walk through its trees."""
        read, leaf = self._ensemble(group, fold), F.col("leaf")
        cells = []
        for cap in sorted({self.configs[c].get("max_leaf_nodes") or 0 for c in cfgs}):
            mine = [c for c in cfgs if (self.configs[c].get("max_leaf_nodes") or 0) == cap]
            stages = sorted({_stages(self.configs[c]) for c in mine})
            scores = read.scores(leaf, stages, cap or None)
            cells += [F.struct(F.lit(c).alias("cfg"), F.get(scores, F.lit(stages.index(_stages(self.configs[c])))).alias("p")) for c in mine]
        return nodes.with_leaves(self.models[(group, fold)], df).select(*keep, F.array(*cells).alias("_cells"))

    def _all(self, df: DataFrame, group: int, fold: int | None, cfgs: Sequence[int], keep: Sequence[str]) -> DataFrame:
        """``(keep..., cfg, p)`` of every row."""
        if self.cells[group]:
            given, name = self.cells[group].binned(df), self.table.features
            df = self.cells[group].coded(given.withColumn("_given", F.col(name)))
            keep = [F.col("_given").alias(name) if c == name else F.col(c) for c in keep]
        scored = self._scored(df, group, fold, cfgs, keep).withColumn("_cell", F.explode("_cells"))
        return scored.drop("_cells").select("*", "_cell.cfg", "_cell.p").drop("_cell")

    def _by_cell(self, cells: Cells, cfgs: Sequence[int]) -> DataFrame:
        """Out-of-fold rows: the cells that a fold holds are scored once, and its rows look their cell up."""
        t, found = self.table, None
        for g in sorted({self.group[c] for c in cfgs}):
            mine = [c for c in cfgs if self.group[c] == g]
            for i in t.folds:
                held = cells.df.where(F.col(f"{COUNT}{i}") > 0).select(BINS).distinct()
                held = cells.coded(held.withColumn("_at", F.col(BINS)))
                part = self._scored(held, g, i, mine, ("_at",)).select(F.lit(i).alias(t.fold), F.col("_at").alias(BINS), "_cells")
                found = part if found is None else found.unionByName(part)
        by_cell = found.groupBy(t.fold, BINS).agg(F.flatten(F.collect_list("_cells")).alias("_cells"))  # one per configuration
        rows = cells.binned(t.df).select(t.fold, t.key, t.label, BINS).join(by_cell, [t.fold, BINS])
        return rows.withColumn("_cell", F.explode("_cells")).select("_cell.cfg", t.fold, t.key, t.label, "_cell.p")

    def _union(self, cfgs: Sequence[int], parts: Callable) -> DataFrame:
        out = None
        for g in sorted({self.group[c] for c in cfgs}):
            for part in parts(g, [c for c in cfgs if self.group[c] == g]):
                out = part if out is None else out.unionByName(part)
        return out

    def attach(self, df: DataFrame, cfg: int, fold: int | None, name: str) -> DataFrame:
        return self._all(df, self.group[cfg], fold, [cfg], df.columns).select(*df.columns, F.col("p").alias(name))

    def out_of_fold(self, cfgs: Sequence[int]) -> DataFrame:
        t = self.table
        keep = (t.fold, t.key, t.label)
        kinds = list({id(x): x for x in (self.cells[self.group[c]] for c in cfgs)}.values())
        if len(kinds) == 1 and kinds[0]:
            return self._by_cell(kinds[0], cfgs)
        return self._union(cfgs, lambda g, mine: [self._all(t.only(i), g, i, mine, keep) for i in t.folds]).select(
            "cfg", *keep, "p")

    def score(self, test: DataFrame, cfgs: Sequence[int]) -> DataFrame:
        key = self.table.key
        return self._union(cfgs, lambda g, mine: [self._all(test, g, None, mine, (key,))]).select("cfg", key, "p")


class _FittedCells(Fitted):
    """Out-of-fold scores by models of :mod:`cell_trees`, keyed as in :class:`_FittedTrees`."""

    def __init__(self, table: FoldedTable, models: dict, configs: Sequence[dict], group: Sequence[int], cells: Sequence[Cells]):
        super().__init__(table, models, "probability")
        self.configs, self.group, self.cells = list(configs), list(group), list(cells)

    def out_of_fold(self, cfgs: Sequence[int]) -> DataFrame:
        """All models score each cell once; a row takes the scores of the models that have not seen its fold."""
        t, out = self.table, None
        for cells in {id(x): x for x in (self.cells[self.group[c]] for c in cfgs)}.values():
            mine = [c for c in cfgs if self.cells[self.group[c]] is cells]
            jobs = [(g, f) for g in sorted({self.group[c] for c in mine}) for f in t.folds]
            of = {g: [c for c in mine if self.group[c] == g] for g, _ in jobs}
            asked = [[(_stages(self.configs[c]), self.configs[c].get("max_leaf_nodes")) for c in of[g]] for g, _ in jobs]
            at = {(c, f): i for i, (c, f) in enumerate((c, f) for g, f in jobs for c in of[g])}
            scored = cell_trees.with_scores(cells.df.select(BINS).distinct(), BINS, [self.models[j] for j in jobs], asked, "_p")
            rows = cells.binned(t.df).select(t.fold, t.key, t.label, BINS).join(scored, BINS)
            picked = F.array(*[F.struct(F.lit(c).alias("cfg"), F.coalesce(*[F.when(F.col(t.fold) == f, F.get("_p", F.lit(at[c, f]))) for f in t.folds]).alias("p"))
                               for c in mine])
            part = rows.withColumn("_cell", F.explode(picked)).select("_cell.cfg", t.fold, t.key, t.label, "_cell.p")
            out = part if out is None else out.unionByName(part)
        return out


def _stages(config: dict) -> int:
    return int(config.get("n_estimators", 100))


@dataclass(frozen=True)
class TreeLearner:
    """Tree ensembles. Configurations that differ in the number of trees or in the cap on leaves share one fit.

    The fit has the largest number of trees; its first n are the ensemble of n trees (boosting adds one tree after the
    other, the trees of a forest do not depend on each other). ``max_leaf_nodes`` cuts the fitted trees back to their
    best splits; in boosting, later trees were fitted after the uncut ones. Rows in the same bins of all features are
    fitted and scored as one where that saves most of them (see :class:`Cells`).
    """

    build: Callable
    label: str = "label"

    def fit(self, table: FoldedTable, configs: Sequence[dict], folds: bool = True, whole: bool = False) -> Fitted:
        groups: list[tuple] = []
        member: list[int] = []
        for c in configs:
            depth = {"max_depth": c["max_depth"]} if "max_depth" in c else {"_cap": c.get("max_leaf_nodes")}
            own = tuple(sorted(({k: v for k, v in c.items() if k not in _SHARED} | depth).items(), key=lambda kv: kv[0]))
            if own not in groups:
                groups.append(own)
            member.append(groups.index(own))
        held = (table.folds if folds else []) + ([None] if whole else [])
        todo = [(g, f) for g in range(len(groups)) for f in held]

        def est(g):
            mine = [dict(c) for c, m in zip(configs, member) if m == g]
            return self.build(mine[0] | {"n_estimators": max(map(_stages, mine))}, self.label)

        ests = {(g, f): est(g) for g, f in todo}
        if not whole and all(isinstance(e, GBTClassifier) for e in ests.values()):
            large = sum(n for _, n in table.counts) // PIECES >= 2
            in_tasks = self._in_tasks(table, ests, configs, member) if large or len(todo) >= MANY_FITS else None
            if in_tasks:
                return in_tasks
        found = {b: _cells(table, b) for b in sorted({e.getMaxBins() for e in ests.values()})}
        smallest = min((table.size_without(f) for f in held), default=0)
        cells: list[Cells | None] = [None] * len(groups)
        for (g, _), e in ests.items():
            cells[g] = found[e.getMaxBins()] if 2 * e.getMinInstancesPerNode() < smallest else None

        def one(g, f):
            if cells[g]:
                return lambda: cells[g].fit(ests[(g, f)], f)
            return lambda: ests[(g, f)].fit(table.without(f).select(table.label, table.features))

        width = PARALLEL_FITS if all(cells) else PARALLEL_TREES
        models = run_parallel(table.df.sparkSession, [one(g, f) for g, f in todo], width)
        return _FittedTrees(table, dict(zip(todo, models)), configs, member, cells)


    def _in_tasks(self, table: FoldedTable, ests: dict, configs: Sequence[dict], member: Sequence[int]) -> Fitted | None:
        """Boosted trees as one fit per task, where the cells of the table can be sent."""
        spark, models, of = table.df.sparkSession, {}, {}
        for b in sorted({e.getMaxBins() for e in ests.values()}):
            cells = _cells(table, b, anyhow=True)
            width = 0 if cells is None else len(cells.edges)
            if cells is None or cells.df.count() * width > cell_trees.HELD:
                return None
            held = cells.df.select(table.label, *[F.get(BINS, F.lit(i)).alias(f"_b{i}") for i in range(width)],
                                   *[f"{COUNT}{f}" for f in table.folds]).orderBy(*[f"_b{i}" for i in range(width)], table.label).toPandas()
            bins = held[[f"_b{i}" for i in range(width)]].to_numpy(np.int64)
            per_fold = {f: held[f"{COUNT}{f}"].to_numpy(np.int64) for f in table.folds}
            todo = [k for k, e in ests.items() if e.getMaxBins() == b]
            of |= {g: cells for g, _ in todo}
            jobs = [(cell_trees.settings(ests[k], width), k[1]) for k in todo]
            models |= dict(zip(todo, cell_trees.fit_all(spark, bins, held[table.label].to_numpy(float), per_fold, jobs)))
        return _FittedCells(table, models, configs, member, [of[g] for g in sorted(of)])


def boosting_learner(label: str = "label") -> TreeLearner:
    return TreeLearner(lambda p, label: trees.boosted_trees(p, label=label), label)


def forest_learner(label: str = "label") -> TreeLearner:
    return TreeLearner(lambda p, label: trees.random_forest(p, label=label), label)


def encode_leaves(table: FoldedTable, test: DataFrame | None, tree_params: dict) -> tuple[FoldedTable, DataFrame | None, object]:
    """Replace the features by the one-hot codes of the leaves of boosted trees, at most ``max_leaf_nodes`` per tree.

    The trees see the whole training table (see :func:`nested_leaf_scores`
    for the variant without that leak). The codes are stored once and serve every linear model.
    """
    model = trees.boosted_trees(tree_params, table.features, table.label).fit(table.df.select(table.label, table.features))
    hot = LeafCodes(nodes.ensemble(model, table.df.sparkSession), tree_params.get("max_leaf_nodes"))

    def coded(df: DataFrame) -> DataFrame:
        kept = nodes.with_leaves(model, df).select(*[c for c in df.columns if c != table.features], "leaf")
        return hot.transform(kept, "leaf", table.features).drop("leaf")

    stored = settle(coded(table.df), "leaves")
    other = None if test is None else settle(coded(test), "leaves-test")
    codes = FoldedTable(stored, table.key, table.label, table.features, table.fold, table.counts)
    return replace(codes, grouped=_group_rows(codes)), other, model


def nested_leaf_scores(table: FoldedTable, tree_params: dict, learner, config: dict) -> DataFrame:
    """Out-of-fold scores with trees that, like the linear model, never see the scored fold."""
    out = None
    for i in table.folds:
        rest = tuple((f, n) for f, n in table.counts if f != i)
        inner = FoldedTable(table.without(i), table.key, table.label, table.features, table.fold, rest)
        coded, scored, _ = encode_leaves(inner, table.only(i), tree_params)
        fitted = learner.fit(coded, [config], folds=False, whole=True)
        part = fitted.attach(scored, 0, None, "p").select(F.lit(0).alias("cfg"), table.fold, table.key, table.label, "p")
        out = part if out is None else out.unionByName(part)
    return out
