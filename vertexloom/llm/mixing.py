"""Mixing sources to target weights by systematic sampling.

Each source has an expected number of copies a document, its target over its size. The expected
copies are prefix-summed over the source's documents, in order of size so that every stretch of
sizes is sampled evenly, one offset in [0, 1) is added, and a document is emitted once for each
integer that its stretch of the sum crosses. The offset is random but comes from the source's name,
so reruns agree. One document that is a large part of its source would throw the sum off by itself:
those over a LARGEth of their source have a whole number of expected copies, the nearest to the
rate, and the others share what is left of the target.

The prefix sum is distributed (common.ranked): a source with a third of all rows spreads over
many tasks. Only per-source totals are aggregated, and only three numbers a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, ranked, tuned, written

#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: A document of more than this part of its source has a whole number of expected copies.
LARGE = 50
#: A source's target stops at this many times its size, and so do a document's copies.
MOST = 3


def size_of(text: Column) -> Column:
    """Words of [^\\x20\\x09-\\x0D]+; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(rows: DataFrame) -> DataFrame:
    """skey, snull, source_size, target for rows (skey, snull, size): shares by weight, none above MOST times its size."""
    sums = written(rows.groupBy("snull", "skey").agg(F.sum("size").alias("source_size")), "sources")
    sums = ranked(sums.withColumn("all", F.lit(0)), ["all"], ["snull", "skey"], "source-order")
    weights = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("_rank") % len(WEIGHTS) + 1).cast("int"))
    sums = written(sums.select("snull", "skey", "source_size", weights.cast("long").alias("w")), "weights")
    total = sums.agg(F.sum("source_size")).first()[0] or 0
    share, stopped = 0.0, -1
    limit = F.col("source_size") * MOST
    while total:
        above = limit <= F.lit(share) * F.col("w") if stopped >= 0 else F.lit(False)
        n, held, free = sums.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, limit)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("w"))), F.lit(0))).first()
        if n == stopped or not free:
            break
        stopped, share = n, float(total - held) / float(free)
    return sums.select("snull", "skey", "source_size", F.least(limit.cast("double"), F.lit(share) * F.col("w")).alias("target"))


def _mix(rows: DataFrame) -> DataFrame:
    """rows (row, doc_id, source, size) with source_size, target and copies; row tells rows apart and may be null."""
    rows = rows.select("*", F.col("source").isNull().alias("snull"), F.coalesce("source", F.lit("")).alias("skey"))
    rows = rows.withColumn("tie", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    goals = written(targets(rows), "targets")
    rows = written(ranked(rows, ["snull", "skey"], ["size", "tie"], "mix-order").join(goals, ["snull", "skey"]), "mix-ranks")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.nullif(F.col("source_size"), F.lit(0))).otherwise(0.0)
    large = F.col("size") * LARGE > F.col("source_size")
    whole = F.least(F.floor(rate + 0.5), F.lit(MOST)).cast("long")
    left = rows.groupBy("snull", "skey").agg(
        (F.first("target") - F.coalesce(F.sum(F.when(large, whole * F.col("size"))), F.lit(0))).alias("goal"), F.coalesce(F.sum(F.when(~large, F.col("size"))), F.lit(0)).alias("words")
    )
    left = left.select("snull", "skey", F.when(F.col("words") > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(MOST)), F.col("goal") / F.nullif(F.col("words"), F.lit(0))))).otherwise(0.0).alias("rate"))
    rows = rows.join(written(left, "rates"), ["snull", "skey"])
    start = F.conv(F.substring(F.md5(F.concat(F.when(F.col("snull"), "n").otherwise("s"), F.col("skey"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    crossed = F.floor(start + (F.col("_rank") + 1) * F.col("rate")) - F.floor(start + F.col("_rank") * F.col("rate"))
    crossed = F.least(crossed, F.lit(MOST).cast("long"))  # rounding alone could give one more
    return rows.withColumn("copies", F.when(large, whole).otherwise(crossed))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs (doc_id, text, source).

    Sources are weighed in code-point order, null last; sizes are words, null text has none. A
    source without words has target 0 and gives nothing. Repeated rows are rows of their own: those
    with equal doc_id and size are interchangeable. An empty table gives an empty result. Other
    columns are ignored.
    """
    tuned(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].alias("source"), size_of(docs["text"]).alias("size"))
    return _mix(written(rows, "sizes")).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """docs, each row as often as the mix takes it, in all its columns; what mix() says of odd rows holds."""
    tuned(docs.sparkSession)
    rows = numbered(docs)
    plain = rows.select("row", rows["doc.doc_id"].cast("long").alias("doc_id"), rows["doc.source"].alias("source"), size_of(rows["doc.text"]).alias("size"))
    counts = written(_mix(written(plain, "sizes")).where("copies > 0").select("row", "copies"), "copies")
    return rows.hint("merge").join(counts, "row").select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")


SQL = r"""
with recursive d as (
  select doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(coalesce(doc_id::varchar, '')) as tie
  from documents),
s as (
  select source, sum(size)::bigint as source_size,
         ([1, 2, 3])[(row_number() over (order by source is null, source) - 1) % 3 + 1]::bigint as w
  from d group by source),
fill as (
  select 0 as round, (select count(*) from s) * 0 as stopped, sum(source_size)::double / sum(w)::double as share from s
  union all
  select round + 1,
         (select count(*) from s where 3 * source_size <= share * w),
         ((select sum(source_size) from s) - coalesce((select sum(3 * source_size) from s where 3 * source_size <= share * w), 0))::double
           / (select sum(w) from s where not 3 * source_size <= share * w)::double
  from fill
  where (select count(*) from s where 3 * source_size <= share * w) <> stopped
    and exists (select 1 from s where not 3 * source_size <= share * w)),
t as (
  select source, source_size, least((3 * source_size)::double, w * (select share from fill order by round desc limit 1)) as target
  from s),
r as (
  select doc_id, size, d.source, source_size, target,
         row_number() over (partition by t.source order by size, tie) - 1 as k,
         case when source_size > 0 then target / source_size else 0 end as rate,
         ('0x' || substr(md5(case when t.source is null then 'n' else 's' || t.source end), 1, 8))::bigint / 4294967296.0::double as start
  from d join t on d.source is not distinct from t.source),
parts as (
  select *, size * 50 > source_size as large, least(floor(rate + 0.5), 3)::bigint as whole from r),
rest as (
  select source as of, sum(case when large then 0 else size end) as words,
         first(target) - sum(case when large then whole * size else 0 end) as goal
  from parts group by source),
taken as (
  select parts.*, case when words > 0 then greatest(0.0::double, least(3.0::double, goal::double / words)) else 0.0::double end as e
  from parts join rest on source is not distinct from of),
chosen as (
  select doc_id, size, source_size, target,
         case when large then whole else least(floor(start + (k + 1) * e) - floor(start + k * e), 3) end::bigint as copies
  from taken)
select doc_id, size, source_size, target, copies, (copies * size)::bigint as taken from chosen
"""
