"""Input tables of the queries, derived from the given tables, each with the same derivation in SQL."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierblend.functions.columns import binary_label
from tierblend.operators.splits import random_split
from tierblend.plans.learners import FoldedTable, fold_table
from tierblend.session import settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_features(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents with text measures."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    words = F.split("text", " ")
    letters = F.length(F.regexp_replace("text", "[^A-Za-z]", ""))
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("ID"),
        F.length("text").cast("bigint").alias("n_chars"),
        F.size(words).cast("bigint").alias("n_words"),
        (F.size(F.array_distinct(words)) / F.size(words)).alias("uniq_ratio"),
        (letters / F.length("text")).alias("alpha_ratio"),
        "lang", "source", F.col("quality").alias("TARGET"),
    )


DOCS = """(select l.doc_id as "ID", length(d.text)::bigint as n_chars,
 len(string_split(d.text, ' '))::bigint as n_words,
 len(list_distinct(string_split(d.text, ' ')))::double / len(string_split(d.text, ' ')) as uniq_ratio,
 length(regexp_replace(d.text, '[^A-Za-z]', '', 'g'))::double / length(d.text) as alpha_ratio,
 d.lang, d.source, l.quality as "TARGET" from labels l join documents d on l.doc_id = d.doc_id)"""


def order_features(spark: SparkSession, d: str) -> DataFrame:
    """Orders with customer and nation; the label is a text compared after trimming."""
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    band = F.when(F.col("o_totalprice") > 300000, " >300K").otherwise(" <=300K")
    return joined.select(
        F.col("o_orderkey").alias("ID"), "o_totalprice", "c_acctbal", "o_orderstatus", "o_orderpriority",
        "c_mktsegment", "n_name", band.alias("band"), binary_label(band, ">300K").alias("TARGET"),
    )


ORDERS = """(select o_orderkey as "ID", o_totalprice, c_acctbal, o_orderstatus, o_orderpriority, c_mktsegment,
 n_name, case when o_totalprice > 300000 then ' >300K' else ' <=300K' end as band,
 (o_totalprice > 300000)::int as "TARGET"
 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""


def order_scores(spark: SparkSession, d: str) -> DataFrame:
    """A label and a score with many ties."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("ID"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        (F.floor(F.col("o_totalprice") / 5000) / 100).alias("p"),
    )


SCORES = """(select o_orderkey as "ID", (o_orderstatus = 'F')::int as label,
 floor(o_totalprice / 5000) / 100::double as p from orders)"""


def meta_wide(spark: SparkSession, d: str) -> DataFrame:
    """Two text measures in the role of meta features."""
    return doc_features(spark, d).select(
        "ID", F.col("uniq_ratio").alias("meta_a"), F.col("alpha_ratio").alias("meta_b"), F.col("TARGET").alias("label")
    )


META = f"""(select "ID", uniq_ratio as meta_a, alpha_ratio as meta_b, "TARGET" as label from {DOCS})"""


def constant_dup(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a constant, an identical and a nearly identical column."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("ID"), "o_custkey", "o_totalprice", F.lit(1).alias("k1"),
        F.col("o_totalprice").alias("dup"), (F.col("o_totalprice") + 0.01).alias("near"),
    )


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("ID"), "embedding", (F.col("label") < 5).cast("int").alias("label")
    )


BASKET_COLUMNS = ("n_lines", "sum_qty", "avg_discount", "max_tax", "avg_price")


def baskets(spark: SparkSession, d: str) -> DataFrame:
    """Line items gathered by order; the label is a rule over two of the measures with some labels flipped."""
    li = table(spark, d, "lineitem")
    per = li.groupBy(F.col("l_orderkey").alias("ID")).agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"), F.sum("l_quantity").alias("sum_qty"),
        F.avg("l_discount").alias("avg_discount"), F.max("l_tax").alias("max_tax"),
        F.avg("l_extendedprice").alias("avg_price"),
    )
    rule = (F.col("avg_discount") > 0.05) & (F.col("sum_qty") > 100)
    # one key in sixteen carries the opposite label
    flipped = F.substring(F.md5(F.col("ID").cast("string")), 1, 1) == "0"
    return per.withColumn("label", (rule != flipped).cast("double"))


def basket_vectors(spark: SparkSession, d: str) -> DataFrame:
    """``(ID, label, features)``; the measures are brought to comparable size by fixed factors."""
    df = baskets(spark, d).select(
        "ID", "label", (F.col("n_lines") / 10).alias("n_lines"), (F.col("sum_qty") / 200).alias("sum_qty"),
        (F.col("avg_discount") * 10).alias("avg_discount"), (F.col("max_tax") * 10).alias("max_tax"),
        F.log1p(F.col("avg_price")).alias("avg_price"),
    )
    return VectorAssembler(inputCols=list(BASKET_COLUMNS), outputCol="features").transform(df).select("ID", "label", "features")


def basket_split(spark: SparkSession, d: str, k: int = 5) -> tuple[FoldedTable, DataFrame]:
    """Folded training table and test table (a fifth of the baskets)."""
    stored = settle(basket_vectors(spark, d), "baskets")
    marked = random_split(stored, "ID", 0.2)
    train = fold_table(marked.filter(~F.col("is_test")).drop("is_test"), k)
    return train, marked.filter("is_test").drop("is_test")
