"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Each source's documents are shuffled (ordered by a hash) and queued up to `repeats` times. A copy's virtual finish time
is the source's cumulative size up to it, divided by the source's target. All copies are ordered by finish time and
cut where the total budget is reached. Within one source and epoch the copies taken are a prefix of the shuffled
order, so the cut comes down to one key per source and epoch: whole documents are never shuffled, they are compared
with those keys. Running sums are taken in three levels (blocks of buckets, buckets, rows of a bucket), so a source with a
third of all rows is spread over many tasks and no window holds all buckets.

Defined results: null and empty texts have size 0 and are taken with 0 words; null sources form one source, last in
order; a null id hashes as the empty string; documents of one source with equal hash (repeated ids) enter together; copies whose
finish times are equal enter together or not at all; an empty table gives no rows; texts are counted whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, free_name, materialise, running

WEIGHTS = (1, 2, 3)
REPEATS = 3
SEED = "mix-1"
#: Rows that one bucket of a running sum holds on average.
BUCKET_ROWS = 4000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def source_key(source: Column) -> Column:
    """A key without null, in code-point order with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, share: float = 1.0) -> DataFrame:
    """skey, source_size, target: one row per source; sizes has skey and size.

    Water filling: in order of the level at which a source is full (repeats * size / weight), the level that the rest of the
    budget gives to the sources not yet full rises up to the final level and falls after it, so its maximum is the final level.
    """
    by_source = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(Window.orderBy("skey")) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = by_source.withColumn("weight", weight).withColumn("full", F.col("source_size") * repeats)
    order = Window.orderBy(F.col("full") / F.col("weight"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("full").over(order), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(order), F.lit(0.0))))
    s = s.withColumn("level", F.max("level").over(every))
    return s.select("skey", "source_size", F.least(F.col("full").cast("double"), F.col("level") * F.col("weight")).alias("target"), "budget")


def cut_keys(sizes: DataFrame, targets: DataFrame, n_rows: int, repeats: int = REPEATS) -> DataFrame:
    """skey, cuts: for every source, the last shuffle key taken in each epoch (null: none). sizes has skey, key, size."""
    buckets = max(1, n_rows // BUCKET_ROWS)
    spread = (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / F.lit(float(1 << 32))).cast("long")
    d = sizes.where("size > 0").withColumn("bucket", spread)
    before = d.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = running(before, ["skey"], "bucket", "bucket_size", "before").drop("bucket_size")
    inside = F.sum("size").over(Window.partitionBy("skey", "bucket").orderBy("key").rangeBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("inside", inside).join(before, ["skey", "bucket"]).join(targets, "skey").where("target > 0")
    copies = d.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    copies = copies.withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("before") + F.col("inside")) / F.col("target"))
    # Global order by finish time: sums per range of finish times, then the order within the range where the budget ends.
    ranges = max(1, repeats * n_rows // BUCKET_ROWS)
    copies = copies.withColumn("range", F.floor(F.col("finish") * ranges))
    copies = copies.select("skey", "key", "size", "epoch", "finish", "range", "budget")
    copies = materialise(copies, "mix-copies")
    sums = copies.groupBy("range").agg(F.sum("size").alias("in_range"))
    sums = running(sums, [], "range", "in_range", "upto").withColumn("upto", F.col("upto") + F.col("in_range"))
    r = copies.join(sums, "range")
    whole = r.where("upto <= budget").select("skey", "epoch", "key")
    last = r.where("upto > budget and upto - in_range < budget")
    last = last.withColumn("sum", F.col("upto") - F.col("in_range") + F.sum("size").over(Window.partitionBy("range").orderBy("finish").rangeBetween(Window.unboundedPreceding, 0)))
    taken = whole.unionByName(last.where("sum <= budget").select("skey", "epoch", "key"))
    return taken.groupBy("skey").agg(F.array(*[F.max(F.when(F.col("epoch") == e, F.col("key"))) for e in range(repeats)]).alias("cuts"))


def copies_of(key: Column, cuts: Column, repeats: int = REPEATS) -> Column:
    one = F.lit(0)
    for e in range(repeats):
        one = one + F.when(key <= F.element_at(cuts, e + 1), 1).otherwise(0)
    return F.when(cuts.isNull(), 0).otherwise(one)


def mix_plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, share: float = 1.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sizes, sources): doc_id, skey, key, size of every document; skey, source_size, target, cuts of every source."""
    sizes = docs.select(F.col(id_col).alias("doc_id"), source_key(F.col(source_col)).alias("skey"), shuffle_key(F.col(id_col)).alias("key"), word_count(F.col(text_col)).alias("size"))
    sizes = materialise(sizes, "mix-sizes")
    targets = source_targets(sizes, weights, repeats, share)
    cuts = cut_keys(sizes.select("skey", "key", "size"), targets, sizes.count(), repeats)
    return sizes, materialise(targets.join(cuts, "skey", "left").drop("budget"), "mix-sources")


def mix_sizes(docs: DataFrame, repeats: int = REPEATS, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: what the mix takes of every document."""
    sizes, sources = mix_plan(docs, repeats=repeats, **options)
    out = sizes.join(sources, "skey")
    return out.select("doc_id", "size", "source_size", "target", (copies_of(F.col("key"), F.col("cuts"), repeats) * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, repeats: int = REPEATS, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with its own columns. Documents of size 0 stay once."""
    sizes, sources = mix_plan(docs, repeats=repeats, id_col=id_col, source_col=source_col, **options)
    names = {c: free_name(docs, c) for c in ("mix_key", "mix_cuts", "mix_copies")}
    side = sources.select(F.col("skey").alias(names["mix_key"]), F.col("cuts").alias(names["mix_cuts"]))
    text = options.get("text_col", "text")
    n = F.when(F.coalesce(F.regexp_instr(F.col(text), F.lit(WORD)), F.lit(0)) == 0, 1).otherwise(copies_of(shuffle_key(F.col(id_col)), F.col(names["mix_cuts"]), repeats))
    out = docs.withColumn(names["mix_key"], source_key(F.col(source_col))).join(side, names["mix_key"])
    out = out.withColumn(names["mix_copies"], F.explode(F.array_repeat(F.lit(0), n)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
with d as (
  select doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         case when source is null then '1' else '0' || source end as skey,
         md5('mix-1:' || coalesce(doc_id::varchar, '')) as key from {docs}),
s0 as (select skey, sum(size)::bigint as source_size from d group by skey),
s1 as (select *, ((row_number() over (order by encode(skey)) - 1) % 3 + 1)::double as weight, source_size * 3 as full_size from s0),
s2 as (select *, sum(source_size) over () as budget,
         (sum(source_size) over ()::double - coalesce(sum(full_size) over o, 0)::double) / (sum(weight) over () - coalesce(sum(weight) over o, 0)) as level
       from s1 window o as (order by full_size / weight, encode(skey) rows between unbounded preceding and 1 preceding)),
s as (select skey, source_size, budget::double as budget, least(full_size::double, max(level) over () * weight) as target from s2),
q as (select d.skey, d.key, d.size, s.source_size, s.target, s.budget,
        sum(d.size) over (partition by d.skey order by d.key range between unbounded preceding and current row)::bigint as upto
      from d join s using (skey) where d.size > 0 and s.target > 0),
c as (select *, (epoch * source_size + upto) / target as finish from q, (select unnest([0, 1, 2]) as epoch)),
t as (select *, sum(size) over (order by finish range between unbounded preceding and current row) as total from c),
k as (select skey, max(key) filter (epoch = 0) as k0, max(key) filter (epoch = 1) as k1, max(key) filter (epoch = 2) as k2 from t where total <= budget group by skey)
select d.doc_id, d.size, s.source_size, s.target,
  (d.size * (coalesce((d.key <= k0)::int, 0) + coalesce((d.key <= k1)::int, 0) + coalesce((d.key <= k2)::int, 0)))::bigint as taken
from d join s using (skey) left join k using (skey)
"""
