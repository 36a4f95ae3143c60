"""Queries whose results a database can recompute."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierblend.catalog.fixtures import (
    DOCS, META, ORDERS, SCORES, constant_dup, doc_features, meta_wide, order_features, order_scores, table, vectors,
)
from tierblend.catalog.registry import query
from tierblend.functions import columns
from tierblend.operators import encode, hashed_neighbours, joins, metrics, neighbours, ordering, profile, ridge, scale, scores, select, splits
from tierblend.plans import search
from tierblend.session import scratch_path
from tierblend.sources import sinks, stages, tables


def r6(c, name=None):
    col = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return col.alias(name or c)


FOLD = """ntile(5) over (partition by {label} order by md5('98754:' || "ID"), "ID") - 1"""
FOLDED_SCORES = f"""(select *, {FOLD.format(label='label')} as fold from {SCORES})"""
SPLIT_ORDERS = f"""(select *, row_number() over (order by md5('0:' || "ID"), "ID")
 <= ceil(0.2::double * count(*) over ()) as is_test from {ORDERS})"""

# ---- sources and sinks ----


@query(f"""select "ID", round(o_totalprice, 6) as o_totalprice, o_orderstatus, band from {ORDERS}""")
def csv_named_scan(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "named")
    sinks.write_csv(order_features(spark, d).select("ID", "o_totalprice", "o_orderstatus", "band"), path)
    schema = T.StructType([
        T.StructField("ID", T.LongType()), T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderstatus", T.StringType()), T.StructField("band", T.StringType()),
    ])
    return tables.scan_named(spark, path, schema).select("ID", r6("o_totalprice"), "o_orderstatus", "band")


@query("""select round(o_totalprice::float::double, 3) as price, round((o_custkey / 7)::float::double, 3) as part
 from orders""")
def csv_float_scan(spark, d):
    path = scratch_path(spark, "float")
    o = table(spark, d, "orders")
    sinks.write_csv(o.select(F.col("o_totalprice").alias("price"), (F.col("o_custkey") / 7).alias("part")), path)
    got = tables.scan_float(spark, path, ("price", "part"))
    return got.select(*[F.round(F.col(c).cast("double"), 3).alias(c) for c in ("price", "part")])


@query("""select row_number() over (order by o_orderkey) - 1 as "ID", o_orderkey, o_orderstatus from orders""")
def csv_sink_with_id(spark, d):
    path = scratch_path(spark, "with-id")
    sinks.write_csv_with_id(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), path, "o_orderkey")
    return tables.scan_named(spark, path, "ID bigint, o_orderkey bigint, o_orderstatus string")


@query(f"""select printf('%.10e', p) as p, label from {SCORES}""")
def meta_feature_sink(spark, d):
    path = scratch_path(spark, "meta")
    sinks.write_meta_feature(order_scores(spark, d), path, "p", "label")
    return tables.scan_named(spark, path, "p string, label int")


@query(f"""select "ID", p as "TARGET" from {SCORES}""")
def submission_table(spark, d):
    path = scratch_path(spark, "submission")
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("ID"))
    sinks.write_submission(ids, order_scores(spark, d), path, "ID", "p")
    return tables.scan_named(spark, path, "ID bigint, TARGET double")


# ---- projections and filters ----


@query(f"""select o_totalprice, c_acctbal, o_orderstatus, o_orderpriority, c_mktsegment, n_name from {ORDERS}""")
def project_features(spark, d):
    return order_features(spark, d).drop("ID", "TARGET", "band")


@query(f"""select "ID", (trim(band) = '>300K')::int as "TARGET" from {ORDERS}""")
def binary_label(spark, d):
    return order_features(spark, d).select("ID", columns.binary_label("band", ">300K").alias("TARGET"))


@query("""select o_orderkey as "ID", round(ln(o_totalprice + 1)::float::double, 4) as o_totalprice_log,
 (o_orderstatus = 'F')::int as "TARGET" from orders""")
def log_features(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("ID"), columns.log1p_float("o_totalprice").alias("o_totalprice_log"),
        (F.col("o_orderstatus") == "F").cast("int").alias("TARGET"),
    )
    return o.select("ID", F.round(F.col("o_totalprice_log").cast("double"), 4).alias("o_totalprice_log"), "TARGET")


@query(f"""select "ID", label, p from {FOLDED_SCORES} where fold = 2""")
def fold_subset(spark, d):
    return splits.stratified_folds(order_scores(spark, d), "label", "ID").filter("fold = 2").drop("fold")


@query(f"""select "ID", p from {SCORES} where p >= (select quantile_cont(p, 0.8) from {SCORES} where p > 0)""")
def quantile_filter(spark, d):
    return profile.keep_upper_scores(order_scores(spark, d).select("ID", "p"), "p")


# ---- feature transforms ----

_STATUS = ("F", "O", "P")
_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_ONE_HOT_SQL = ", ".join(
    [f"""(c_mktsegment = '{v}')::int::double as "c_mktsegment={v}" """ for v in _SEGMENTS]
    + [f"""(o_orderstatus = '{v}')::int::double as "o_orderstatus={v}" """ for v in _STATUS]
)


@query(f"""select "ID", o_totalprice, {_ONE_HOT_SQL}, "TARGET" from {ORDERS}""")
def one_hot_wide(spark, d):
    df = order_features(spark, d).select("ID", "o_totalprice", "o_orderstatus", "c_mktsegment", "TARGET")
    marked = splits.random_split(df, "ID", 0.2)
    parts = [marked.filter(~F.col("is_test")).drop("is_test"), marked.filter("is_test").drop("is_test")]
    model = encode.fit_one_hot(parts, ["o_orderstatus", "c_mktsegment"])
    both = model.transform(parts[0]).unionByName(model.transform(parts[1]))
    return both.select(*[c for c in both.columns if c != "TARGET"], "TARGET")


@query(f"""with o as {ORDERS}, p as (select o_orderpriority, row_number() over (order by min("ID")) - 1 as c from o group by 1),
 n as (select n_name, row_number() over (order by min("ID")) - 1 as c from o group by 1)
 select o."ID", p.c as o_orderpriority, n.c as n_name from o join p using (o_orderpriority) join n using (n_name)""")
def factorize_first_seen(spark, d):
    df = order_features(spark, d).select("ID", "o_orderpriority", "n_name")
    return encode.fit_factorize(df, ["o_orderpriority", "n_name"], "ID").transform(df)


@query("""select 'k1' as name, count(*) as n_rows from orders having min(1) = max(1)
 union all select 'o_totalprice', count(*) from orders having min(o_totalprice) = max(o_totalprice)
 union all select 'o_custkey', count(*) from orders having min(o_custkey) = max(o_custkey)""")
def constant_features(spark, d):
    df = constant_dup(spark, d)
    _, gone = select.drop_constants(df, ["o_totalprice", "o_custkey", "k1"])
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.explode(F.lit(gone)).alias("name"), "n_rows")


@query("""with o as (select o_custkey, o_totalprice, 1 as k1, o_totalprice as dup, o_totalprice + 0.01 as near from orders)
 select 'dup' as name, count(*) as n_rows from o having count(*) filter (dup is distinct from o_totalprice) = 0
 union all select 'near', count(*) from o having count(*) filter (near is distinct from o_totalprice) = 0
 union all select 'o_totalprice', count(*) from o having count(*) filter (o_totalprice is distinct from o_custkey) = 0""")
def identical_features(spark, d):
    df = constant_dup(spark, d)
    _, gone = select.drop_identicals(df, ["o_custkey", "o_totalprice", "dup", "near"], "ID")
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.explode(F.lit(gone)).alias("name"), "n_rows")


_SPLIT_STATS = f"""with s as {SPLIT_ORDERS}, m as (select min(o_totalprice) as lo, max(o_totalprice) as hi,
 min(c_acctbal) as lo2, max(c_acctbal) as hi2, avg(o_totalprice) as mu, stddev_pop(o_totalprice) as sd,
 avg(c_acctbal) as mu2, stddev_pop(c_acctbal) as sd2 from s where not is_test)"""


def _scaled(spark, d, fit):
    df = order_features(spark, d).select("ID", "o_totalprice", "c_acctbal", "TARGET")
    marked = splits.random_split(df, "ID", 0.2)
    train, test = scale.scale_pair(marked.filter(~F.col("is_test")), marked.filter("is_test"), ["o_totalprice", "c_acctbal"], fit)
    return train.unionByName(test).select("ID", r6("o_totalprice"), r6("c_acctbal"), "is_test", "TARGET")


@query(f"""{_SPLIT_STATS} select "ID", round((o_totalprice - lo) / (hi - lo), 6) as o_totalprice,
 round((c_acctbal - lo2) / (hi2 - lo2), 6) as c_acctbal, is_test, "TARGET" from s, m""")
def minmax_scaled(spark, d):
    return _scaled(spark, d, scale.fit_minmax)


@query(f"""{_SPLIT_STATS} select "ID", round((o_totalprice - mu) / sd, 6) as o_totalprice,
 round((c_acctbal - mu2) / sd2, 6) as c_acctbal, is_test, "TARGET" from s, m""")
def standard_scaled(spark, d):
    return _scaled(spark, d, scale.fit_standard)


@query(f"""with x as (select *, (n_chars + n_words + uniq_ratio + alpha_ratio) / 4 as mu from {DOCS})
 select "ID", n_chars, n_words, round(mu, 6) as mean, round(sqrt(((n_chars - mu) ** 2 + (n_words - mu) ** 2
 + (uniq_ratio - mu) ** 2 + (alpha_ratio - mu) ** 2) / 3), 6) as std,
 round(n_chars + n_words + uniq_ratio + alpha_ratio, 6) as sum_col_val,
 round(greatest(n_chars, n_words, uniq_ratio, alpha_ratio)::double, 6) as max_col_val,
 round(least(n_chars, n_words, uniq_ratio, alpha_ratio)::double, 6) as min_col_val from x""")
def row_stats_extended(spark, d):
    df = doc_features(spark, d).select("ID", "n_chars", "n_words", "uniq_ratio", "alpha_ratio", "TARGET")
    out = scale.row_statistics(df)
    return out.select("ID", "n_chars", "n_words", *[r6(c) for c in ("mean", "std", "sum_col_val", "max_col_val", "min_col_val")])


@query(f"""select "ID", round(o_totalprice / sqrt(sum(o_totalprice * o_totalprice) over ()), 8) as o_totalprice,
 round(c_acctbal / sqrt(sum(c_acctbal * c_acctbal) over ()), 8) as c_acctbal from {ORDERS}""")
def unit_norm_columns(spark, d):
    df = order_features(spark, d).select("ID", "o_totalprice", "c_acctbal")
    out = scale.fit_unit_norm(df, ["o_totalprice", "c_acctbal"]).transform(df)
    return out.select("ID", F.round("o_totalprice", 8).alias("o_totalprice"), F.round("c_acctbal", 8).alias("c_acctbal"))


_PCA_SQL = f"""with u as (select "ID", uniq_ratio / sqrt(sum(uniq_ratio * uniq_ratio) over ()) as x,
 alpha_ratio / sqrt(sum(alpha_ratio * alpha_ratio) over ()) as z from {DOCS}),
 m as (select avg(x) as mx, avg(z) as mz, var_samp(x) as a, covar_samp(x, z) as b, var_samp(z) as c from u),
 e as (select *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) as l1, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) as l2 from m),
 v as (select *, sqrt(b * b + (l1 - a) ** 2) as norm from e),
 w as (select *, case when abs(b) >= abs(l1 - a) then sign(b) else sign(l1 - a) end as s1 from v),
 q as (select *, s1 * b / norm as p1, s1 * (l1 - a) / norm as p2 from w),
 t as (select *, case when abs(p2) >= abs(p1) then sign(p2) else sign(-p1) end as s2 from q)"""


def _pca(spark, d):
    df = doc_features(spark, d).select("ID", "uniq_ratio", "alpha_ratio")
    unit = scale.fit_unit_norm(df, ["uniq_ratio", "alpha_ratio"]).transform(df)
    return unit, scale.fit_pca(unit, ["uniq_ratio", "alpha_ratio"], 2)


@query(f"""{_PCA_SQL} select 1 as component, round(l1 / (l1 + l2), 6) as explained from t
 union all select 2, round(l2 / (l1 + l2), 6) from t""")
def pca_explained_variance(spark, d):
    _, model = _pca(spark, d)
    rows = [(i + 1, round(x, 6)) for i, x in enumerate(model.explained)]
    return spark.createDataFrame(rows, "component int, explained double")


@query(f"""{_PCA_SQL} select "ID", round((x - mx) * p1 + (z - mz) * p2, 6) as pc1,
 round(s2 * ((x - mx) * p2 - (z - mz) * p1), 6) as pc2 from u, t""")
def pca_projection(spark, d):
    unit, model = _pca(spark, d)
    return model.transform(unit).select("ID", r6("pc1"), r6("pc2"))


# ---- joins and set operations ----


@query(f"""select "ID", o_totalprice, (o_orderstatus = 'F')::int::double as "o_orderstatus=F",
 (o_orderstatus = 'O')::int::double as "o_orderstatus=O", (o_orderstatus = 'P')::int::double as "o_orderstatus=P"
 from {ORDERS}""")
def key_join_encoded(spark, d):
    df = order_features(spark, d).select("ID", "o_totalprice", "o_orderstatus")
    codes = encode.fit_one_hot([df], ["o_orderstatus"]).transform(df.select("ID", "o_orderstatus"))
    return df.drop("o_orderstatus").join(codes, "ID")


@query(f"""select "ID", round(uniq_ratio, 6) as meta_uniq, round(alpha_ratio, 6) as meta_alpha,
 round(n_words::double / n_chars, 6) as meta_words, "TARGET" as label from {DOCS}""")
def combine_meta_features(spark, d):
    docs = doc_features(spark, d).withColumnRenamed("TARGET", "label")
    words = (F.col("n_words") / F.col("n_chars")).alias("w")
    parts = {
        "meta_uniq": docs.select("ID", "uniq_ratio", "label"), "meta_alpha": docs.select("ID", "alpha_ratio", "label"),
        "meta_words": docs.select("ID", words, "label"),
    }
    return joins.combine_columns(parts, "ID", "label").select("ID", *[r6(c) for c in parts], "label")


_NEAR = """with e as (select vec_id as "ID", embedding::double[] as v, (label < 5)::int as label from embeddings),
 f as (select *, ntile(5) over (partition by label order by md5('98754:' || "ID"), "ID") as fold from e),
 r as (select q."ID" as query, t."ID" as neighbour, t.label, list_distance(q.v, t.v) as dist,
 row_number() over (partition by q."ID" order by list_distance(q.v, t.v), t."ID") as rank
 from f q join f t on q.fold <> t.fold)"""


def _near(spark, d, k):
    f = splits.stratified_folds(vectors(spark, d), "label", "ID")
    return neighbours.nearest(f, f, k, "ID", "embedding", "label", "fold")


@query(f"""{_NEAR} select query, neighbour, rank::int as rank, round(dist, 6) as distance from r where rank <= 8""")
def knn_topk_pairs(spark, d):
    return _near(spark, d, 8).select("query", "neighbour", "rank", r6("distance"))


@query()
def knn_lsh_pairs(spark, d):
    v = vectors(spark, d)
    # these few vectors without much structure would be met whole if the costs decided
    return hashed_neighbours.nearest_hashed(v, v, 8, "ID", "embedding", bits=4).select("query", "neighbour", "rank", r6("distance"))


@query(f"""{_NEAR}, k as (select unnest([1, 2, 4, 8, 16, 24, 32, 64])::int as k)
 select query, k, round(case when count(*) filter (dist = 0) > 0 then avg(label) filter (dist = 0)
 else sum(label / dist) / sum(1 / dist) end, 6) as p from r join k on rank <= k group by query, k""")
def knn_vote(spark, d):
    return neighbours.vote(_near(spark, d, 64), "label", (1, 2, 4, 8, 16, 24, 32, 64)).select("query", "k", r6("p"))


@query(f"""select "ID", label, p from (select *, row_number() over (order by md5('0:' || "ID"), "ID")
 <= ceil(0.2::double * count(*) over ()) as is_test from {SCORES}) where not is_test""")
def split_complement(spark, d):
    df = order_scores(spark, d)
    test = splits.random_split(df, "ID", 0.2).filter("is_test")
    return splits.complement(df, test, "ID")


@query(f"""select "ID", band, "TARGET" from {SPLIT_ORDERS}""")
def union_train_test(spark, d):
    marked = splits.random_split(order_features(spark, d).select("ID", "band", "TARGET"), "ID", 0.2)
    return marked.filter(~F.col("is_test")).unionByName(marked.filter("is_test")).drop("is_test")


@query(f"""select distinct "TARGET", band from {ORDERS}""")
def distinct_labels(spark, d):
    return order_features(spark, d).select("TARGET", "band").distinct()


# ---- aggregations and metrics ----


def _describe_sql(c: str) -> str:
    return f"""select '{c}' as "column", count({c}) as n, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std,
 round(min({c})::double, 6) as min, round(quantile_cont({c}::double, 0.25), 6) as p25, round(quantile_cont({c}::double, 0.5), 6) as p50,
 round(quantile_cont({c}::double, 0.75), 6) as p75, round(max({c})::double, 6) as max from lineitem"""


_LINE_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" union all ".join(_describe_sql(c) for c in _LINE_NUMBERS))
def describe_numeric(spark, d):
    out = profile.describe(table(spark, d, "lineitem"), _LINE_NUMBERS)
    return out.select("column", "n", *[r6(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


@query("""select l_returnflag, count(*) as n from lineitem group by l_returnflag""")
def value_counts(spark, d):
    return profile.value_counts(table(spark, d, "lineitem"), "l_returnflag")


_PREDICTED = f"""(select label, (p >= 0.5)::int as pred from {SCORES})"""
_CONFUSION = f"""select count(*) filter (label = 0 and pred = 0) as tn, count(*) filter (label = 0 and pred = 1) as fp,
 count(*) filter (label = 1 and pred = 0) as fn, count(*) filter (label = 1 and pred = 1) as tp from {_PREDICTED}"""


def _predicted(spark, d):
    return order_scores(spark, d).withColumn("pred", (F.col("p") >= 0.5).cast("int"))


@query(_CONFUSION)
def confusion_matrix(spark, d):
    return metrics.confusion_matrix(_predicted(spark, d), "label", "pred")


@query(f"""select tn, fp, fn, tp, round((tp + tn)::double / (tp + tn + fp + fn), 6) as accuracy,
 round(tp::double / (tp + fp), 6) as precision, round(tp::double / (tp + fn), 6) as recall,
 round(2 * tp::double / (2 * tp + fp + fn), 6) as f1, round(tn::double / (tn + fp), 6) as precision_class0_swapped,
 round(tn::double / (tn + fn), 6) as recall_class0_swapped,
 round(2 * tn::double / (2 * tn + fp + fn), 6) as f_class0_swapped from ({_CONFUSION})""")
def classification_report(spark, d):
    out = metrics.classification_report(_predicted(spark, d), "label", "pred")
    return out.select("tn", "fp", "fn", "tp", *[r6(c) for c in out.columns[4:]])


@query(f"""with r as (select label, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0::double as rk from {SCORES})
 select round((sum(rk) filter (label = 1) - count(*) filter (label = 1) * (count(*) filter (label = 1) + 1) / 2.0::double)
 / (count(*) filter (label = 1)::double * count(*) filter (label = 0)), 6) as auc from r""")
def roc_auc(spark, d):
    return metrics.roc_auc(order_scores(spark, d), "label", "p").select(r6("auc"))


@query(f"""select fold::int as fold, round(avg(greatest(0, 1 - (2 * label - 1) * p)), 6) as hinge_loss from {FOLDED_SCORES} group by fold""")
def hinge_loss(spark, d):
    df = splits.stratified_folds(order_scores(spark, d), "label", "ID")
    return df.groupBy("fold").agg(r6(metrics.hinge_loss("label", "p"), "hinge_loss"))


_CLIPPED = "least(greatest({x}, 1e-15::double), 1 - 1e-15::double)"


@query(f"""select fold::int as fold, round(-avg(label * ln({_CLIPPED.format(x='p')}) + (1 - label) * ln(1 - {_CLIPPED.format(x='p')})), 6)
 as log_loss from {FOLDED_SCORES} group by fold""")
def log_loss(spark, d):
    df = splits.stratified_folds(order_scores(spark, d), "label", "ID")
    return df.groupBy("fold").agg(r6(metrics.log_loss("label", "p"), "log_loss"))


@query(f"""select round(avg((label - p) ** 2), 6) as mse from {SCORES}""")
def mean_squared_error(spark, d):
    return order_scores(spark, d).agg(r6(metrics.mean_squared_error("label", "p"), "mse"))


@query("""select round(quantile_cont(l_extendedprice, 0.1), 6) as q10, round(quantile_cont(l_extendedprice, 0.8), 6) as q80,
 round(quantile_cont(l_extendedprice, 0.99), 6) as q99 from lineitem""")
def exact_quantile(spark, d):
    q = ordering.exact_quantiles(table(spark, d, "lineitem"), "l_extendedprice", [0.1, 0.8, 0.99])
    return spark.createDataFrame([tuple(round(x, 6) for x in q)], "q10 double, q80 double, q99 double")


_HIST = """with m as (select min(o_totalprice) as lo, max(o_totalprice) as hi, count(*) as total from orders),
 c as (select least(floor((o_totalprice - lo) / (hi - lo) * 100), 99)::int as bin, count(*) as n from orders, m group by 1),
 h as (select b::int as bin, lo + (b + 1) * ((hi - lo) / 100) as edge, coalesce(n, 0)::bigint as n, (hi - lo) / 100 as width, total
 from range(100) t(b) cross join m left join c on c.bin = b)"""


@query(f"""{_HIST} select bin, n, round(n / total / width, 12) as density from h""")
def score_histogram(spark, d):
    h = profile.histogram(table(spark, d, "orders"), "o_totalprice")
    return h.select("bin", "n", F.round("density", 12).alias("density"))


@query(f"""{_HIST} select bin, round(edge, 4) as "right", round(sum(n) over (order by bin)::double / total, 6) as cdf from h""")
def score_cdf(spark, d):
    c = profile.cumulative(profile.histogram(table(spark, d, "orders"), "o_totalprice"))
    return c.select("bin", F.round("right", 4).alias("right"), r6("cdf"))


@query("""select row_number() over (order by o_orderkey) - 1 as "ID", o_orderkey from orders""")
def row_ids(spark, d):
    return ordering.with_row_number(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


# ---- splits ----


@query(f"""select "ID", row_number() over (order by md5('0:' || "ID"), "ID") <= ceil(0.2::double * count(*) over ()) as is_test from {SCORES}""")
def random_split(spark, d):
    return splits.random_split(order_scores(spark, d), "ID", 0.2).select("ID", "is_test")


@query(f"""select "ID", label, fold::int as fold from {FOLDED_SCORES}""")
def stratified_folds(spark, d):
    return splits.stratified_folds(order_scores(spark, d), "label", "ID").select("ID", "label", "fold")


@query(f"""with a as (select "ID", row_number() over (order by md5('0:' || "ID"), "ID") <= ceil(0.2::double * count(*) over ()) as held from {SCORES}),
 b as (select "ID", row_number() over (order by md5('1:' || "ID"), "ID") <= ceil(0.5::double * count(*) over ()) as late from a where held)
 select a."ID", case when not held then 'train' when late then 'ptest' else 'ptrain' end as part from a left join b on a."ID" = b."ID" """)
def three_way_holdout(spark, d):
    return splits.three_way_holdout(order_scores(spark, d).select("ID"), "ID")


@query(f"""with x as (select "ID", row_number() over (order by "ID") as rn, floor(count(*) over () * 0.2::double) as held, count(*) over () as n from {SCORES})
 select "ID", case when rn <= n - held then 'train' when rn <= n - held + floor(held * 0.5::double) then 'ptrain' else 'ptest' end as part from x""")
def sequential_split(spark, d):
    return splits.sequential_split(order_scores(spark, d).select("ID"), "ID")


# ---- closed-form models ----

_RIDGE = f"""with x as (select *, 2 * label - 1 as y from {META}),
 s as (select count(*) as n, avg(meta_a) as ma, avg(meta_b) as mb, avg(y) as my, covar_pop(meta_a, meta_a) as aa,
 covar_pop(meta_a, meta_b) as ab, covar_pop(meta_b, meta_b) as bb, covar_pop(meta_a, y) as ay, covar_pop(meta_b, y) as yb from x),
 al as (select unnest([0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0]::double[]) as alpha),
 g as (select alpha, ma, mb, my, n * aa + alpha as p, n * ab as q, n * bb + alpha as r, n * ay as u, n * yb as v from s, al),
 w as (select alpha, ma, mb, my, (u * r - q * v) / (p * r - q * q) as meta_a, (p * v - q * u) / (p * r - q * q) as meta_b from g),
 f as (select alpha, my - meta_a * ma - meta_b * mb as intercept, meta_a, meta_b from w)"""


@query(f"""{_RIDGE} select round(intercept, 6) as intercept, round(meta_a, 6) as meta_a, round(meta_b, 6) as meta_b from f where alpha = 1.0""")
def ridge_blend_weights(spark, d):
    model = ridge.fit_ridge(meta_wide(spark, d), ["meta_a", "meta_b"], "label", 1.0)
    return model.weight_table(spark).select(r6("intercept"), r6("meta_a"), r6("meta_b"))


@query(f"""{_RIDGE} select alpha, round(intercept, 6) as intercept, round(meta_a, 6) as meta_a, round(meta_b, 6) as meta_b from f""")
def ridge_path(spark, d):
    path = ridge.ridge_path(meta_wide(spark, d), ["meta_a", "meta_b"], "label", [0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0])
    return path.select("alpha", r6("intercept"), r6("meta_a"), r6("meta_b"))


@query(f"""{_RIDGE} select x."ID", round(f.intercept + x.meta_a * f.meta_a + x.meta_b * f.meta_b, 6) as decision,
 (f.intercept + x.meta_a * f.meta_a + x.meta_b * f.meta_b > 0)::int as prediction from x, f where f.alpha = 1.0""")
def apply_blend_weights(spark, d):
    meta = meta_wide(spark, d)
    weights = ridge.fit_ridge(meta, ["meta_a", "meta_b"], "label", 1.0).weight_table(spark)
    return ridge.apply_weights(meta, weights, ["meta_a", "meta_b"]).select("ID", r6("decision"), "prediction")


@query(f"""{_RIDGE} select x."ID", round(f.intercept + x.meta_a * f.meta_a + x.meta_b * f.meta_b, 6) as decision,
 (f.intercept + x.meta_a * f.meta_a + x.meta_b * f.meta_b > 0)::int as prediction from x, f where f.alpha = 10.0""")
def blend_weights_file(spark, d):
    """Weights stored as delimited text, read back and applied."""
    meta, path = meta_wide(spark, d), scratch_path(spark, "weights")
    sinks.write_weights(ridge.fit_ridge(meta, ["meta_a", "meta_b"], "label", 10.0).weight_table(spark), path)
    return ridge.apply_weights(meta, tables.scan_weights(spark, path), ["meta_a", "meta_b"]).select("ID", r6("decision"), "prediction")


_SCALED_META = f"""(select "ID", (meta_a - min(meta_a) over ()) / (max(meta_a) over () - min(meta_a) over ()) as meta_a,
 (meta_b - min(meta_b) over ()) / (max(meta_b) over () - min(meta_b) over ()) as meta_b, label from {META})"""


@query(f"""{_RIDGE.replace(META, _SCALED_META)} select x."ID", round(f.intercept + x.meta_a * f.meta_a + x.meta_b * f.meta_b, 6) as decision,
 (f.intercept + x.meta_a * f.meta_a + x.meta_b * f.meta_b > 0)::int as prediction from x, f where f.alpha = 0.1""")
def stored_pipeline(spark, d):
    """Scaler and ridge blend fitted as one pipeline, stored, loaded and applied."""
    meta, path, pair = meta_wide(spark, d), scratch_path(spark, "pipeline"), ["meta_a", "meta_b"]
    steps = [stages.ColumnScaler(columns=pair, kind="minmax"), stages.RidgeBlend(columns=pair, alpha=0.1)]
    sinks.save_model(Pipeline(stages=steps).fit(meta), path)
    return tables.load_model(path).transform(meta).select("ID", r6("rawPrediction", "decision"), "prediction")


@query("""select o_orderkey as "ID", o_orderpriority, round((o_totalprice - min(o_totalprice) over w)
 / (max(o_totalprice) over w - min(o_totalprice) over w), 6) as p from orders window w as (partition by o_orderpriority)""")
def minmax_calibration(spark, d):
    df = table(spark, d, "orders").select(F.col("o_orderkey").alias("ID"), "o_orderpriority", "o_totalprice")
    return scores.minmax_calibrate(df, "o_totalprice", "p", ["o_orderpriority"]).select("ID", "o_orderpriority", r6("p"))


# ---- configuration tables ----

_GRID = {"mix": (0.0, 0.25, 0.5), "power": (0.5, 1.0, 2.0)}
_SPACE = {"mix": ("uniform", 0.0, 0.5), "power": ("quniform", 1.0, 4.0, 1.0)}


def _config_score(config: dict):
    """A score family with two settings: the tied score raised to a power and mixed with one half."""
    mix, power = float(config["mix"]), float(config["power"])
    return F.lit(mix) * F.lit(0.5) + F.lit(1.0 - mix) * F.pow(F.col("p"), F.lit(power))


def _grid_scores(spark, d, configs):
    """Scores per configuration and fold from one pass: a configuration is a set of aggregates."""
    df = splits.stratified_folds(order_scores(spark, d), "label", "ID")
    cells = []
    for i, c in enumerate(configs):
        s = _config_score(c)
        hit = F.avg(((s >= 0.5) == (F.col("label") == 1)).cast("double"))
        for name, agg in (("hinge_loss", metrics.hinge_loss("label", s)), ("log_loss", metrics.log_loss("label", s)), ("accuracy", hit)):
            cells.append(F.struct(F.lit(i).alias("cfg"), F.lit(name).alias("metric"), agg.alias("score")))
    wide = df.groupBy("fold").agg(F.array(*cells).alias("_s"))
    return wide.select("fold", F.explode("_s").alias("_s")).select("_s.cfg", "fold", "_s.metric", "_s.score")


_GRID_SQL = f"""with f as {FOLDED_SCORES}, c as (select ((m.i - 1) * 3 + p.i - 1)::int as cfg, m.v as mix, p.v as power
 from (select unnest([0.0, 0.25, 0.5]::double[]) as v, unnest([1, 2, 3]) as i) m
 cross join (select unnest([0.5, 1.0, 2.0]::double[]) as v, unnest([1, 2, 3]) as i) p),
 s as (select cfg, mix, power, fold::int as fold, label, mix * 0.5::double + (1 - mix) * pow(p, power) as sc from f cross join c),
 g as (select cfg, mix, power, fold, avg(greatest(0, 1 - (2 * label - 1) * sc)) as hinge_loss,
 -avg(label * ln({_CLIPPED.format(x='sc')}) + (1 - label) * ln(1 - {_CLIPPED.format(x='sc')})) as log_loss,
 avg(((sc >= 0.5) = (label = 1))::int) as accuracy from s group by all)"""


@query(f"""{_GRID_SQL} select cfg, mix, power, round(avg(log_loss), 6) as log_loss from g group by all""")
def param_grid_table(spark, d):
    configs = search.expand_grid(_GRID)
    means = search.fold_summary(_grid_scores(spark, d, configs).filter("metric = 'log_loss'"), ("cfg",))
    named = search.grid_table(spark, configs).select(
        "cfg", F.col("params.mix").cast("double").alias("mix"), F.col("params.power").cast("double").alias("power")
    )
    return named.join(means, "cfg").select("cfg", "mix", "power", r6("score_mean", "log_loss"))


@query(f"""{_GRID_SQL} select cfg, {', '.join(f'round(max(log_loss) filter (fold = {i}), 6) as score_{i}' for i in range(5))},
 round(avg(log_loss), 6) as score_mean, round(stddev_pop(log_loss), 6) as score_std from g group by cfg""")
def cv_result_table(spark, d):
    out = search.result_table(_grid_scores(spark, d, search.expand_grid(_GRID)), "log_loss", range(5))
    return out.select("cfg", *[r6(c) for c in out.columns[1:]])


@query(f"""{_GRID_SQL}, l as (unpivot g on hinge_loss, log_loss, accuracy into name metric value score)
 select cfg, metric, round(avg(score), 6) as score_mean, round(stddev_pop(score), 6) as score_std from l group by cfg, metric""")
def fold_score_summary(spark, d):
    out = search.fold_summary(_grid_scores(spark, d, search.expand_grid(_GRID)))
    return out.select("cfg", "metric", r6("score_mean"), r6("score_std"))


@query(f"""{_GRID_SQL} select cfg, round(-avg(accuracy) + stddev_pop(accuracy), 6) as loss from g group by cfg
 order by round(-avg(accuracy) + stddev_pop(accuracy), 12), cfg limit 3""")
def topk_configs(spark, d):
    return search.top_configs(_grid_scores(spark, d, search.expand_grid(_GRID)), "accuracy", 3, use_lower=True).select("cfg", r6("loss"))


@query(f"""{_GRID_SQL}, m as (select cfg, avg(log_loss) as l, avg(accuracy) as a from g group by cfg)
 (select 'log_loss' as metric, cfg, round(l, 6) as score from m order by round(l, 12), cfg limit 1)
 union all (select 'accuracy', cfg, round(a, 6) from m order by round(a, 12) desc, cfg limit 1)""")
def best_config(spark, d):
    s = _grid_scores(spark, d, search.expand_grid(_GRID))
    parts = [search.best_config(s, m).select(F.lit(m).alias("metric"), "cfg", r6("score")) for m in ("log_loss", "accuracy")]
    return parts[0].unionByName(parts[1])


@query(f"""with f as {FOLDED_SCORES}, c as (select t::int as cfg, ('0x' || substr(md5('0:mix:' || t), 1, 13))::bigint / 16::double ** 13 * 0.5::double as mix,
 round(1 + ('0x' || substr(md5('0:power:' || t), 1, 13))::bigint / 16::double ** 13 * 3)::int as power from range(12) r(t)),
 s as (select cfg, mix, power, fold, label, mix * 0.5::double + (1 - mix) * pow(p, power) as sc from f cross join c),
 g as (select cfg, mix, power, fold, avg(greatest(0, 1 - (2 * label - 1) * sc)) as h from s group by all)
 select cfg, round(mix, 6) as mix, power, round(avg(h), 6) as hinge_loss from g group by all""")
def sampled_param_table(spark, d):
    configs = search.sample_configs(_SPACE, 12)
    means = search.fold_summary(_grid_scores(spark, d, configs).filter("metric = 'hinge_loss'"), ("cfg",))
    rows = [(i, c["mix"], c["power"]) for i, c in enumerate(configs)]
    drawn = spark.createDataFrame(rows, "cfg int, mix double, power int")
    return drawn.join(means, "cfg").select("cfg", r6("mix"), "power", r6("score_mean", "hinge_loss"))
