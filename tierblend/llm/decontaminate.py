"""Benchmark decontamination by winnowing, with DataFrame functions only.

Items of 13 or more words: k-grams of ``K`` words are hashed, and of each run of ``WINDOW - K + 1`` consecutive ones a
document keeps the smallest. Items keep the same, so a shared span of 13 words always shares a kept hash. A shorter item
is one window of its own length L, winnowed with K = L and runs of one. Documents that share a kept hash with an item
are extended: their word windows are compared, word for word, with the items' windows.

Null and empty texts have no words and are never hit. Rows are told apart by id and text, so repeated rows and repeated
ids each get their own result; null ids are kept. Extra columns are not read. Empty tables give empty or clean results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tierblend.llm.base import ascii_lower, free_name, query, settle, table, text_or_empty

WINDOW, K = 13, 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Benchmark hashes or windows are broadcast up to this many rows (some 16 MB of hashes); beyond, the join shuffles.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def _grams(ws: Column, k: int) -> Column:
    """Hash of each k consecutive words, in order; empty when there are fewer."""
    n = F.size(ws)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))),
                                      lambda i: F.xxhash64(F.slice(ws, i, k)))
                  ).otherwise(F.array().cast("array<bigint>"))


def fingerprints(ws: Column, window: int = WINDOW, k: int = K) -> Column:
    """Distinct smallest hashes of all runs of window - k + 1 consecutive k-grams."""
    run = window - k + 1
    grams = _grams(ws, k)
    return F.array_distinct(F.transform(
        F.array(grams), lambda g: F.when(F.size(g) >= run, F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(g) - run + 1, F.lit(1))), lambda i: F.array_min(F.slice(g, i, run))
        )).otherwise(F.array().cast("array<bigint>")))[0])


def _windows(ws: Column, length: int) -> Column:
    n = F.size(ws)
    return F.when(n >= length, F.transform(
        F.sequence(F.lit(1), F.greatest(n - length + 1, F.lit(1))),
        lambda i: F.struct(i.alias("at"), F.array_join(F.slice(ws, i, length), " ").alias("span"))))


def _side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """``doc_id``, ``sig`` (hash of the text), ``n_words``, ``n_hit`` and ``item_ids`` (sorted text) for every row."""
    items = settle(items.select(F.col("item_id").cast("string").alias("item_id"),
                                words(text_or_empty()).alias("ws")).where(F.size("ws") > 0), "benchmark-words")
    lengths = sorted(r[0] for r in items.select(F.least(F.size("ws"), F.lit(window)).alias("n")).distinct().collect())
    prepared = (docs.select("doc_id", F.xxhash64(text_or_empty()).alias("sig"), words(text_or_empty()).alias("ws")))
    prints = {n: (k if n == window else n) for n in lengths}  # at most ``window`` lengths
    pieces = [F.transform(fingerprints(F.col("ws"), n, g), lambda h: F.struct(F.lit(n).alias("n"), h.alias("h")))
              for n, g in prints.items()]
    empty = F.array().cast("array<struct<n:int,h:bigint>>")
    kept = settle(prepared.select("doc_id", "sig", F.size("ws").cast("long").alias("n_words"),
                                  (F.concat(*pieces) if pieces else empty).alias("fp")), "document-prints")
    mine = [items.where(F.size("ws") >= window if n == window else F.size("ws") == n)
            .select(F.lit(n).alias("n"), F.explode(fingerprints(F.col("ws"), n, g)).alias("h"))
            for n, g in prints.items()]
    if not mine:
        return kept.select("doc_id", "sig", "n_words", F.lit(0).cast("long").alias("n_hit"),
                           F.array().cast("array<string>").alias("item_ids"))
    known = mine[0]
    spans = None
    for part in mine[1:]:
        known = known.unionByName(part)
    for n in lengths:
        own = (items.where(F.size("ws") >= window if n == window else F.size("ws") == n)
               .select("item_id", F.lit(n).alias("n"), F.explode(_windows(F.col("ws"), n)).alias("w"))
               .select("item_id", "n", F.col("w.span").alias("span")).distinct())
        spans = own if spans is None else spans.unionByName(own)
    # A span's items in one row: a document window meets one row, however many items share the span.
    spans = settle(spans.groupBy("n", "span").agg(F.collect_set("item_id").alias("owners")), "benchmark-windows")
    known = settle(known.distinct(), "benchmark-prints")
    met = (kept.select("doc_id", "sig", F.explode("fp").alias("f")).select("doc_id", "sig", "f.n", "f.h")
           .join(_side(known), ["n", "h"], "left_semi").select("doc_id", "sig").distinct())
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["sig"] == b["sig"])
    met = settle(met, "document-candidates")
    found = prepared.join(met, same(prepared, met), "left_semi").dropDuplicates(["doc_id", "sig"])
    wide = [F.transform(F.coalesce(_windows(F.col("ws"), n), F.array().cast("array<struct<at:int,span:string>>")),
                        lambda w: F.struct(F.lit(n).alias("n"), w["at"].alias("at"), w["span"].alias("span")))
            for n in lengths]
    hits = (found.select("doc_id", "sig", F.explode(F.concat(*wide)).alias("w")).select("doc_id", "sig", "w.*")
            .join(_side(spans), ["n", "span"])
            .groupBy("doc_id", "sig").agg(
                F.collect_set(F.struct("at", "n")).alias("hit"), F.collect_set("owners").alias("owners"))
            .select(F.col("doc_id").alias("_d"), F.col("sig").alias("_s"),
                    F.size(F.array_distinct(F.flatten(F.transform(
                        "hit", lambda h: F.sequence(h["at"], h["at"] + h["n"] - 1))))).cast("long").alias("n_hit"),
                    F.array_sort(F.array_distinct(F.flatten("owners"))).alias("item_ids")))
    hits = settle(hits, "document-hits")
    return (kept.join(hits, kept["doc_id"].eqNullSafe(hits["_d"]) & (kept["sig"] == hits["_s"]), "left")
            .select("doc_id", "sig", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")))


def judge(hits: DataFrame) -> DataFrame:
    return hits.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    sig, row, other = (free_name(docs, c) for c in ("_sig", "_d", "_s"))
    bad = settle(judge(find_hits(docs, items)).where("contaminated")
                 .select(F.col("doc_id").alias(row), F.col("sig").alias(other)).distinct(), "contaminated")
    marked = docs.withColumn(sig, F.xxhash64(text_or_empty()))
    return marked.join(bad, marked["doc_id"].eqNullSafe(bad[row]) & (marked[sig] == bad[other]), "left_anti").drop(sig)


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
b as (select cast(item_id as varchar) item_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark),
bw as (select distinct item_id, least(len(ws), 13) n, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') span
       from b, unnest(generate_series(1, greatest(len(ws) - 12, 1))) g(i) where len(ws) > 0),
dw as (select doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') span
       from d, (select distinct n from bw), unnest(generate_series(1, len(ws) - n + 1)) g(i)),
h as (select doc_id, dw.n, i, item_id from dw join bw using (n, span)),
p as (select doc_id, count(distinct j) n_hit from (select distinct doc_id, n, i from h), unnest(generate_series(i, i + n - 1)) g(j)
      group by doc_id),
t as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids
      from (select distinct doc_id, item_id from h) group by doc_id)
select doc_id, cast(len(ws) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit,
       cast(coalesce(n_items, 0) as bigint) n_items, sha256(coalesce(ids, '')) items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) contaminated
from d left join p using (doc_id) left join t using (doc_id)
"""


@query(ORACLE)
def op1_decontaminate(spark, sf_dir):
    hits = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judge(hits).select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                              F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")
