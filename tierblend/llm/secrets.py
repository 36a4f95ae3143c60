"""Secret scans with corpus-wide ownership frequency, with DataFrame functions only.

Spans come from the built-in regular expressions: the gaps of ``split`` and the matches of ``regexp_extract_all`` give
positions in code points. Every candidate's value is hashed; per hash the distinct repositories and owners of the whole
corpus are counted (first per hash, owner and repository, so one value in a third of the rows is combined before the
shuffle). A value of ``COMMON_OWNERS`` owners or more is a widely copied example, any other one looks live. Base spans
always stay; the method adds ``opaque`` tokens (long, mixed letters and digits, with the padding of base64) that look
live, also behind ``=`` as in ``KEY=value``.

Null texts count as empty; null owners count as one owner. Repeated rows and ids stay rows of their own. Extra columns
are not read by the scan and are kept by ``redact``. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tierblend.llm.base import free_name, query, settle, table, text_or_empty

COMMON_OWNERS = 5
ASSIGN = (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: kind, pattern, group of the value, least length of the value. The last is added by the method, when it looks live.
KINDS = (
    ("assign", ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
    ("opaque", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+=*+(?![A-Za-z0-9+/_-])", 0, 32),
)


NO_SPANS = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


#: Entries of an array that are run over together, and characters of a text that are cut out together.
RUN, BLOCK = 256, 4096


def _running(values: Column, combine) -> Column:
    """Running results of ``combine`` (with neutral element 0) over an array of integers.

    An array grown entry by entry is copied at every step, so only runs of ``RUN`` entries and the list of runs grow.
    """
    none = F.array().cast("array<int>")
    grow = lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x)))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(RUN)), lambda i: F.slice(values, i, RUN))
    before = F.aggregate(F.transform(runs, lambda r: F.aggregate(r, F.lit(0), combine)), F.array(F.lit(0)), grow)
    inside = F.zip_with(runs, before, lambda r, start: F.slice(F.aggregate(F.coalesce(r, none), F.array(start), grow), 2, RUN))
    return F.flatten(inside)


def _spans(text: Column, match: Column, value: Column, rank: int, kind: str, pattern: str, least: int) -> Column:
    """Array of (start, rank, kind, end, value) for one kind, from its matches and the gaps between them."""
    none = F.array().cast(NO_SPANS)
    sizes = F.transform(match, F.char_length)
    gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(match)), F.char_length)
    ends = _running(F.zip_with(gaps, sizes, lambda g, n: g + n), lambda a, x: a + x)
    rows = F.transform(F.arrays_zip(ends.alias("end"), sizes.alias("size"), value.alias("value")), lambda x: F.struct(
        (x["end"] - x["size"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"),
        x["value"].alias("value")))
    return F.when(F.size(match) > 0, F.filter(rows, lambda r: F.char_length(r["value"]) >= least)).otherwise(none)


def candidates(docs: DataFrame, owner: str = "source", repository: str = "lang") -> DataFrame:
    """doc_id, sig, owner, repository and ``found``: all spans of every kind in order of start, then kind."""
    mixed = lambda v: v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]")
    matched = (docs.select("doc_id", text_or_empty().alias("_t"),
                           F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
                           F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"))
               .select("*", *[F.regexp_extract_all("_t", F.lit(p), F.lit(0)).alias(f"_m{i}")
                              for i, (_, p, _, _) in enumerate(KINDS)]))
    per_kind = []
    for i, (kind, pattern, group, least) in enumerate(KINDS):
        whole = F.col(f"_m{i}")
        value = whole if group == 0 else F.regexp_extract_all("_t", F.lit(pattern), F.lit(group))
        per_kind.append(_spans(F.col("_t"), whole, value, i, kind, pattern, least))
    per_kind[3] = F.filter(per_kind[3], lambda s: mixed(s["value"]))
    return matched.select("doc_id", F.xxhash64("_t").alias("sig"), "owner", "repository",
                          F.array_sort(F.concat(*per_kind)).alias("found"))


def ownership(found: DataFrame, common: int = COMMON_OWNERS) -> DataFrame:
    """Per value hash: n_rows, n_repositories, n_owners and ``live``."""
    return (found.select("owner", "repository", F.explode("found").alias("s"))
            .groupBy(F.xxhash64("s.value").alias("value_hash"), "owner", "repository").agg(F.count("*").alias("n"))
            .groupBy("value_hash").agg(F.sum("n").alias("n_rows"),
                                       F.count_distinct("owner", "repository").alias("n_repositories"),
                                       F.count_distinct("owner").alias("n_owners"))
            .withColumn("live", F.col("n_owners") < common))


def scan(docs: DataFrame, common: int = COMMON_OWNERS) -> DataFrame:
    """doc_id, sig and ``spans``: (start, rank, kind, end, live) of base spans and of added live ones."""
    found = settle(candidates(docs), "secret-candidates").withColumn("_row", F.xxhash64("doc_id", "sig"))
    owned = ownership(found, common).select("value_hash", "live")
    judged = (found.where(F.size("found") > 0).dropDuplicates(["doc_id", "sig"])
              .select("_row", "doc_id", "sig", F.explode("found").alias("s"))
              .withColumn("value_hash", F.xxhash64("s.value")).join(owned, "value_hash")
              .where((F.col("s.rank") < 3) | F.col("live"))
              .groupBy("_row", "doc_id", "sig").agg(F.array_sort(F.collect_list(F.struct(
                  "s.start", "s.rank", "s.kind", "s.end", "live"))).alias("spans"))
              .select(F.col("_row").alias("_r"), F.col("doc_id").alias("_d"), F.col("sig").alias("_s"), "spans"))
    judged = settle(judged, "secret-spans")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,live:boolean>>")
    return (found.select("_row", "doc_id", "sig")
            .join(judged, (F.col("_row") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d"))
                  & (F.col("sig") == F.col("_s")), "left")
            .select("doc_id", "sig", F.coalesce("spans", none).alias("spans")))


def _cut_out(spans: str) -> Column:
    """The text with its runs of spans replaced. Long texts are cut into blocks first, as a position is found by counting."""
    size = F.char_length("text")
    blocks = F.transform(F.sequence(F.lit(0), size, F.lit(BLOCK)), lambda i: F.col("text").substr(i + 1, F.lit(BLOCK)))
    seen = _running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x))
    # every span with the end of all spans before it; one that begins before that end belongs to the run
    rows = F.arrays_zip(F.concat(F.array(F.lit(0)), seen).alias("at"), F.col(spans).alias("s"))

    def part(held, start, end):
        first = F.floor(start / BLOCK).cast("int")
        near = F.array_join(F.slice(held, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
        return near.substr(start - first * BLOCK + 1, end - start)

    def whole(held):
        marks = F.transform(F.filter(rows, lambda r: r["s"].isNotNull() & (r["s"]["start"] >= r["at"])), lambda r: F.concat(
            part(held, r["at"], r["s"]["start"]), F.when(r["s"]["live"], F.lit("[SECRET]")).otherwise(F.lit("[EXAMPLE]"))))
        return F.concat(F.array_join(marks, ""), part(held, F.array_max(seen), size))

    # the blocks are bound to a variable, or every span would cut them anew
    return F.get(F.transform(F.array(blocks), whole), F.lit(0))


def redact(docs: DataFrame, common: int = COMMON_OWNERS) -> DataFrame:
    """``docs`` with each run of spans replaced: [SECRET] where one looks live, else [EXAMPLE]. Columns stay."""
    sig, row, other, found = (free_name(docs, c) for c in ("_sig", "_d", "_s", "_spans"))
    spans = (scan(docs, common).where(F.size("spans") > 0).dropDuplicates(["doc_id", "sig"])
             .select(F.col("doc_id").alias(row), F.col("sig").alias(other), F.col("spans").alias(found)))
    spans = settle(spans, "secret-redactions")
    marked = docs.withColumn(sig, F.xxhash64(text_or_empty()))
    joined = marked.join(spans, marked["doc_id"].eqNullSafe(spans[row]) & (marked[sig] == spans[other]), "left")
    return joined.withColumn("text", F.when(F.col(found).isNull(), F.col("text")).otherwise(_cut_out(found))).select(*map(_quoted, docs.columns))


def _quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


@query()
def op2_secrets(spark, sf_dir):
    out = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < 3)
    line = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return out.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
                      F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"),
                      F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"))
