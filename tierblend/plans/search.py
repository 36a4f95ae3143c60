"""Hyper-parameter search over shared folds."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierblend.operators.metrics import SCORE_NAMES, evaluate
from tierblend.plans.learners import FoldedTable
from tierblend.plans.store import ResultStore
from tierblend.session import settle

#: Configurations whose predictions are written and evaluated together.
ROUND = 16


def expand_grid(grid: dict[str, Sequence]) -> list[dict]:
    """All combinations, the last of the sorted parameter names varying fastest."""
    names = sorted(grid)
    return [dict(zip(names, values)) for values in itertools.product(*(grid[n] for n in names))]


def grid_table(spark, configs: Sequence[dict]) -> DataFrame:
    """``(cfg, params)`` with the parameters as a map of texts."""
    rows = [(i, {k: str(v) for k, v in c.items()}) for i, c in enumerate(configs)]
    return spark.createDataFrame(rows, "cfg int, params map<string,string>")


def unit_uniform(seed: int, name: str, trial: int) -> float:
    """A repeatable number in [0, 1) from the first 13 hex digits of ``seed:name:trial``."""
    digest = hashlib.md5(f"{seed}:{name}:{trial}".encode()).hexdigest()
    return int(digest[:13], 16) / 16.0**13


def sample_configs(space: dict, trials: int, seed: int = 0) -> list[dict]:
    """Draw configurations. A value is a constant, ``('uniform', lo, hi)`` or ``('quniform', lo, hi, q)``.

    Quantised draws are rounded to a multiple of q and become integers.
    """
    out = []
    for t in range(trials):
        config = {}
        for name in sorted(space):
            rule = space[name]
            if not (isinstance(rule, tuple) and rule and rule[0] in ("uniform", "quniform")):
                config[name] = rule
                continue
            value = rule[1] + unit_uniform(seed, name, t) * (rule[2] - rule[1])
            config[name] = value if rule[0] == "uniform" else int(round(value / rule[3]) * rule[3])
        out.append(config)
    return out


def long_scores(per_fold: DataFrame) -> DataFrame:
    """``(cfg, fold, metric, score)`` from one row per configuration and fold."""
    return per_fold.unpivot(["cfg", "fold"], list(SCORE_NAMES), "metric", "score")


def cv_scores(oof: DataFrame, label: str = "label") -> DataFrame:
    """The seven scores per configuration and fold, long."""
    return long_scores(evaluate(oof, label, "p", ["cfg", "fold"]))


def fold_summary(scores: DataFrame, by: Sequence[str] = ("cfg", "metric")) -> DataFrame:
    """Mean and population deviation over the folds."""
    return scores.groupBy(*by).agg(F.avg("score").alias("score_mean"), F.stddev_pop("score").alias("score_std"))


def result_table(scores: DataFrame, metric: str, folds: Sequence[int]) -> DataFrame:
    """One row per configuration: ``score_0 .. score_{k-1}, score_mean, score_std``."""
    one = scores.filter(F.col("metric") == metric)
    cells = [F.max(F.when(F.col("fold") == f, F.col("score"))).alias(f"score_{f}") for f in folds]
    return one.groupBy("cfg").agg(*cells, F.avg("score").alias("score_mean"), F.stddev_pop("score").alias("score_std"))


def best_config(scores: DataFrame, metric: str) -> DataFrame:
    """``(cfg, score)`` of the best mean: smallest for a loss, largest otherwise; ties go to the lower cfg.

    Means are compared to twelve decimals, as their last bits depend on the order of summation.
    """
    means = fold_summary(scores.filter(F.col("metric") == metric), ("cfg",)).filter(F.col("score_mean").isNotNull())
    sign = 1.0 if "loss" in metric else -1.0
    rank = F.struct(F.round(F.col("score_mean") * sign, 12).alias("s"), F.col("cfg"))
    return means.agg(F.min_by("cfg", rank).alias("cfg"), F.min_by("score_mean", rank).alias("score"))


def top_configs(scores: DataFrame, metric: str, k: int | None = None, use_lower: bool = False) -> DataFrame:
    """The k configurations (without k: all) of lowest ``-mean`` (plus the deviation with ``use_lower``)."""
    loss = -F.col("score_mean") + (F.col("score_std") if use_lower else F.lit(0.0))
    means = fold_summary(scores.filter(F.col("metric") == metric), ("cfg",))
    ordered = means.select("cfg", loss.alias("loss")).orderBy(F.round("loss", 12), "cfg")
    return ordered if k is None else ordered.limit(k)


@dataclass(frozen=True)
class SearchResult:
    configs: list[dict]
    scores: DataFrame
    metric: str
    best: int | None
    best_score: float | None
    rounds: tuple[DataFrame, ...] = ()

    @property
    def best_params(self) -> dict:
        return self.configs[self.best]

    def out_of_fold(self) -> DataFrame:
        """The stored out-of-fold predictions of the chosen configuration; nothing is fitted again."""
        return self.rounds[self.best // ROUND].filter(F.col("cfg") == self.best)


def _stored_round(learner, table: FoldedTable, part: list[dict], store: ResultStore, names: list[str]) -> DataFrame:
    """Predictions of a round from the store; what it does not hold is fitted and put there first."""
    spark = table.df.sparkSession
    held = store.present(spark, names)
    # settings that occur twice have one entry
    missing = [i for i, n in enumerate(names) if n not in held and names.index(n) == i]
    if missing:
        fresh = learner.fit(table, [part[i] for i in missing]).out_of_fold(range(len(missing)))
        store.put(fresh.select(F.col("cfg").alias("entry"), F.col(table.fold).cast("int").alias(table.fold), table.key, table.label, "p"),
                 [names[i] for i in missing])
    kinds = {c: table.df.schema[c].dataType.simpleString() for c in (table.key, table.label)}
    schema = f"`{table.fold}` int, `{table.key}` {kinds[table.key]}, `{table.label}` {kinds[table.label]}, p double"
    out = None
    for i, name in enumerate(names):
        one = store.get(spark, name, schema).select(F.lit(i).alias("cfg"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def run_search(
    learner, table: FoldedTable, configs: Sequence[dict], metric: str = "auc", keep: str | None = None, store: ResultStore | None = None,
) -> SearchResult:
    """Cross-validate every configuration on the shared folds and pick the best.

    Out-of-fold predictions are written once per round and scored by grouped aggregates. ``keep``
    names a folder that receives them as ``(cfg, fold, key, label, p)``; those of a former run are replaced. With
    ``store`` they stay there under their parameters and rows, and what it holds already is not fitted again.
    """
    spark = table.df.sparkSession
    rows, rounds = [], []
    names = store.names(table, configs) if store else []
    for start in range(0, len(configs), ROUND):
        part = list(configs[start : start + ROUND])
        if store:
            oof = _stored_round(learner, table, part, store, names[start : start + ROUND])
        else:
            oof = learner.fit(table, part).out_of_fold(range(len(part)))
        oof = oof.withColumn("cfg", F.col("cfg") + start).withColumnRenamed(table.fold, "fold")
        if keep:
            oof.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cfg").parquet(keep)
            oof = spark.read.schema(oof.schema).parquet(keep).filter(F.col("cfg").between(start, start + len(part) - 1))
        elif not store:
            oof = settle(oof, "oof")
        rounds.append(oof)
        # configurations times folds times seven numbers
        rows += [tuple(r) for r in cv_scores(oof, table.label).collect()]
    scores = spark.createDataFrame(rows, "cfg int, fold int, metric string, score double")
    top = best_config(scores, metric).first()
    return SearchResult(list(configs), scores, metric, top["cfg"], top["score"], tuple(rounds))


def grid_search(
    learner, table: FoldedTable, grid: dict[str, Sequence], metric: str = "auc", keep: str | None = None, store: ResultStore | None = None,
) -> SearchResult:
    return run_search(learner, table, expand_grid(grid), metric, keep, store)


def sampled_search(learner, table: FoldedTable, space: dict, trials: int = 201, metric: str = "auc", seed: int = 0) -> SearchResult:
    """Search over drawn configurations; :func:`top_configs` ranks the trials."""
    return run_search(learner, table, sample_configs(space, trials, seed), metric)


def refit_predictions(learner, table: FoldedTable, test: DataFrame, configs: Sequence[dict]) -> DataFrame:
    """Fit every configuration on the whole table and score the test table: ``(cfg, key, p)``."""
    return learner.fit(table, configs, folds=False, whole=True).score(test, range(len(configs)))


def described(result: SearchResult) -> DataFrame:
    """Scores with their parameters and a mark at the chosen configuration."""
    spark = result.scores.sparkSession
    table = grid_table(spark, result.configs)
    wide = fold_summary(result.scores.filter(F.col("metric") == result.metric), ("cfg",))
    return wide.join(F.broadcast(table), "cfg").select(
        "cfg", "params", "score_mean", "score_std", (F.col("cfg") == F.lit(result.best)).alias("is_best")
    )


def ranked(df: DataFrame, column: str) -> DataFrame:
    """Small result tables: add the rank of a column, highest first."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(column).desc(), "cfg")))
