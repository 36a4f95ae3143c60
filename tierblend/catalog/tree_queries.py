"""Queries on single splits and short boosted ensembles, which SQL can fit as well.

The features have few distinct values, so the candidate splits are all places between them, and the checks fit the
same trees: the split of least squared error per round, leaves at the mean of what is left to explain.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierblend.catalog.fixtures import basket_split, table
from tierblend.catalog.registry import query
from tierblend.operators import nodes, trees
from tierblend.operators.encode import LeafCodes
from tierblend.operators.splits import random_split
from tierblend.plans import learners, search
from tierblend.session import settle

STEP_COLUMNS = ("n_lines", "qty_band", "max_tax")
#: Rows that a leaf needs.
LEAST = 8


def step_baskets(spark: SparkSession, d: str) -> DataFrame:
    """Line items by order: measures of few distinct values, and a label that follows two of them, partly flipped."""
    per = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("ID")).agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"), F.floor(F.sum("l_quantity") / 25).cast("double").alias("qty_band"),
        F.max("l_tax").alias("max_tax"), F.sum("l_quantity").alias("qty"))
    flipped = F.substring(F.md5(F.col("ID").cast("string")), 1, 1) == "0"
    rule = (F.col("qty") > 60) & (F.col("max_tax") > 0.03)
    return per.select("ID", *STEP_COLUMNS, (rule != flipped).cast("double").alias("label"))


STEPS = """(select l_orderkey as "ID", count(*)::double as n_lines, floor(sum(l_quantity) / 25)::double as qty_band,
 max(l_tax) as max_tax, ((sum(l_quantity) > 60 and max(l_tax) > 0.03) <> (substr(md5(l_orderkey::varchar), 1, 1) = '0'))::int::double as label
 from lineitem group by l_orderkey)"""


def step_split(spark: SparkSession, d: str) -> tuple[learners.FoldedTable, DataFrame]:
    wide = VectorAssembler(inputCols=list(STEP_COLUMNS), outputCol="features").transform(step_baskets(spark, d))
    marked = random_split(settle(wide.select("ID", "label", "features"), "steps"), "ID", 0.2)
    return learners.fold_table(marked.filter(~F.col("is_test")).drop("is_test")), marked.filter("is_test").drop("is_test")


_BASE = f"""d as materialized (select *, row_number() over (order by md5('0:' || "ID"), "ID") <= ceil(0.2::double * count(*) over ()) as is_test,
 2 * label - 1 as y from {STEPS}),
 b as materialized (select *, case when is_test then -1 else ntile(5) over (partition by is_test, label order by md5('98754:' || "ID"), "ID") - 1 end as fold from d)"""


def _best_split(rows: str, by: str, name: str) -> str:
    """CTEs: per group of ``by`` the split of ``rows`` (columns, res) with the least squared error."""
    unpivoted = " union all ".join(f"select {by}, {i} as f, {c} as v, res from {rows}" for i, c in enumerate(STEP_COLUMNS))
    return f"""{name}_v as (select {by}, f, v, count(*) as n, sum(res) as s from ({unpivoted}) group by all),
 {name}_c as (select *, sum(n) over w as nl, sum(s) over w as sl, sum(n) over g as nt, sum(s) over g as st from {name}_v
  window w as (partition by {by}, f order by v), g as (partition by {by}, f)),
 {name} as materialized (select *, sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) - st * st / nt as won from {name}_c
  where nl >= {LEAST} and nt - nl >= {LEAST}
  qualify row_number() over (partition by {by} order by sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) desc, f, v) = 1)"""


_VALUE = "case k.f " + " ".join(f"when {i} then s.{c}" for i, c in enumerate(STEP_COLUMNS)) + " end"


def _boosted(runs: str, rounds: int) -> str:
    """CTEs s1..s{rounds}: margin m of every row after each round of every run (rate, hold); fold ``hold`` is not fitted."""
    out = [f"runs as (select * from (values {runs}) as t(run, rate, hold))", _BASE,
           "s0 as materialized (select run, rate, hold, b.*, 0.0::double as m from b cross join runs)"]
    for t in range(1, rounds + 1):
        res = "y" if t == 1 else "4 * y / (1 + exp(2 * y * m))"
        out.append(f"r{t} as materialized (select *, {res} as res from s{t - 1} where fold >= 0 and fold <> hold)")
        out.append(_best_split(f"r{t}", "run", f"k{t}"))
        out.append(f"""s{t} as materialized (select s.* exclude (m), s.m + {'1' if t == 1 else 's.rate'} *
 (case when {_VALUE} <= k.v then k.sl / k.nl else (k.st - k.sl) / (k.nt - k.nl) end) as m from s{t - 1} s join k{t} k using (run))""")
    return "with " + ",\n ".join(out)


STUMPS = {"n_estimators": 4, "max_depth": 1, "learning_rate": 0.1, "min_samples_leaf": LEAST}
_ONE_RUN = "(0, 0.1, -9)"
_STAGES = (1, 2, 4)


def _stump_model(spark, d):
    train, test = step_split(spark, d)
    return train, test, trees.boosted_trees(STUMPS).fit(train.df.select("label", "features"))


@query(f"""{_boosted(_ONE_RUN, 4)} """ + " union all ".join(
    f"""select "ID", {t} as stage, round(1 / (1 + exp(-2 * m)), 6) as p from s{t} where is_test""" for t in _STAGES))
def boosting_stages(spark, d):
    """Scores after one, two and four trees, read off a single fit."""
    _, test, model = _stump_model(spark, d)
    scores = nodes.ensemble(model, spark).scores(F.col("leaf"), _STAGES)
    named = F.array(*[F.struct(F.lit(t).alias("stage"), F.get(scores, F.lit(i)).alias("p")) for i, t in enumerate(_STAGES)])
    return nodes.with_leaves(model, test).select("ID", F.explode(named).alias("s")).select("ID", "s.stage", F.round("s.p", 6).alias("p"))


@query(f"""{_boosted(_ONE_RUN, 4)} """ + " union all ".join(
    f"""select {t} as stage, case when is_test then 'test' else 'train' end as part, round(avg(2 * ln(1 + exp(-2 * y * m))), 6) as loss
 from s{t} group by all""" for t in range(1, 5)))
def stump_losses(spark, d):
    """Loss after every stage on training and test rows."""
    train, test, model = _stump_model(spark, d)
    return trees.staged_loss(model, {"train": train.df, "test": test}).select("stage", "part", F.round("loss", 6).alias("loss"))


_NAMES_SQL = "case f " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(STEP_COLUMNS)) + " end"


@query(f"""{_boosted(_ONE_RUN, 4)}, k as (""" + " union all ".join(f"select f from k{t}" for t in range(1, 5)) + f""")
 select {_NAMES_SQL} as name, count(*) as splits, row_number() over (order by count(*) desc, {_NAMES_SQL})::int as rank from k group by f""")
def split_count_ranking(spark, d):
    """Features by the number of splits that use them."""
    _, _, model = _stump_model(spark, d)
    counts = nodes.split_counts(nodes.node_table(model, spark), STEP_COLUMNS)
    return search.ranked(counts.withColumnRenamed("name", "cfg"), "splits").withColumnRenamed("cfg", "name")


@query(f"""{_boosted(_ONE_RUN, 4)} select s."ID", 8 as n_codes, concat_ws(',', """ + ", ".join(
    f"(case when {_VALUE.replace('k.f', f'k{t}.f')} <= k{t}.v then {2 * t - 2} else {2 * t - 1} end)" for t in range(1, 5)) + """) as codes
 from s0 s join k1 using (run) join k2 using (run) join k3 using (run) join k4 using (run) where is_test""")
def leaf_code_positions(spark, d):
    """Active positions of the one-hot leaf codes, one per tree."""
    _, test, model = _stump_model(spark, d)
    at, size = LeafCodes(nodes.ensemble(model, spark)).positions(F.col("leaf"))
    return nodes.with_leaves(model, test).select("ID", F.lit(size).alias("n_codes"), F.concat_ws(",", at.cast("array<string>")).alias("codes"))


CAPPED = {"n_estimators": 1, "max_depth": 2, "min_samples_leaf": LEAST, "max_leaf_nodes": 3}


@query(f"""{_boosted(_ONE_RUN, 1)},
 side as materialized (select s.*, s.y as res, ({_VALUE} <= k.v)::int as on_left from s0 s join k1 k using (run)),
 fit2 as (select * from side where fold >= 0),
 {_best_split('fit2', 'on_left', 'k2')},
 kept as (select * from k2 where won > 1e-9 order by won desc, on_left desc limit 1),
 leafs as (select s."ID", s.is_test, s.y, s.on_left, k.on_left as cut, (k.f is not null and {_VALUE} <= k.v)::int as first from side s left join kept k using (on_left)),
 named as (select *, case when cut is null then on_left * 2 else on_left * 2 + first end as leaf from leafs),
 v as (select leaf, avg(y) as m from named where not is_test group by leaf),
 o as (select leaf, m, row_number() over (order by leaf desc) - 1 as number from v)
 select "ID", number::int as leaf, round(1 / (1 + exp(-2 * m)), 6) as p from named join o using (leaf) where is_test""")
def capped_tree_scores(spark, d):
    """A tree of depth two cut back to three leaves: its root split and the better one of the two below."""
    train, test = step_split(spark, d)
    model = trees.boosted_trees(CAPPED).fit(train.df.select("label", "features"))
    read = nodes.ensemble(model, spark)
    codes, _ = read.codes(F.col("fitted"), CAPPED["max_leaf_nodes"])
    p = F.get(read.scores(F.col("fitted"), [1], CAPPED["max_leaf_nodes"]), F.lit(0))
    return nodes.with_leaves(model, test, "fitted").select("ID", F.get(codes, F.lit(0)).alias("leaf"), F.round(p, 6).alias("p"))


STUMP_GRID = {"n_estimators": [1, 2, 4], "learning_rate": [0.1, 1.0], "max_depth": [1], "min_samples_leaf": [LEAST]}
_SEARCH_RUNS = ", ".join(f"({5 * i + h}, {rate}, {h})" for i, rate in enumerate(STUMP_GRID["learning_rate"]) for h in range(5))


@query(f"""{_boosted(_SEARCH_RUNS, 4)}, z as (""" + " union all ".join(
    f"select rate, {t} as n, hold, label, 1 / (1 + exp(-2 * m)) >= 0.5 as yes from s{t} where fold = hold" for t in (1, 2, 4)) + """),
 f1 as (select rate, n, hold, 2.0 * count(*) filter (yes and label = 1) / nullif(2.0 * count(*) filter (yes and label = 1)
  + count(*) filter (yes and label = 0) + count(*) filter (not yes and label = 1), 0) as f1 from z group by all),
 c as (select (row_number() over (order by rate, n) - 1)::int as cfg, rate as learning_rate, n as n_estimators, avg(f1) as mean, stddev_pop(f1) as sd
  from f1 group by rate, n)
 select cfg, learning_rate::double as learning_rate, n_estimators, round(mean, 6) as score_mean, round(sd, 6) as score_std,
  cfg = (select min_by(cfg, (-round(mean, 12), cfg)) from c) as is_best from c""")
def tree_search_f1(spark, d):
    """Settings of boosted trees by F1 of class 1 on five folds; the numbers of trees share their fits."""
    train, _ = step_split(spark, d)
    found = search.grid_search(learners.boosting_learner(), train, STUMP_GRID, "f1")
    return search.described(found).select(
        "cfg", F.col("params")["learning_rate"].cast("double").alias("learning_rate"), F.col("params")["n_estimators"].cast("int").alias("n_estimators"),
        F.round("score_mean", 6).alias("score_mean"), F.round("score_std", 6).alias("score_std"), "is_best")


# Members of the published grid of the encoding trees.
ENCODER_GRID = {"n_estimators": [10, 100], "max_leaf_nodes": [5, 10, 15, 20], "max_depth": [4], "learning_rate": [0.1], "subsample": [0.9],
                "max_features": [5], "min_samples_leaf": [8], "random_state": [0], "loss": ["deviance"]}


@query()
def encoder_search(spark, d):
    """The encoding trees by F1 on five folds: eight settings from one fit per fold."""
    train, _ = basket_split(spark, d)
    return search.described(search.grid_search(learners.boosting_learner(), train, ENCODER_GRID, "f1"))
