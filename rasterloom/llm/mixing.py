"""Temperature mixing of sources, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

REPETITION_LIMIT = 2.0
BLOCK_TOKENS = 1_000_000
SEED = "mix-1"
BUCKET_ROWS = 4096
#: The exponent is a multiple of 2**-PROBE_BITS*ROUNDS.
PROBE_BITS, ROUNDS = 4, 8


def word_count(text):
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\r]+"), lambda w: w != "")).cast("bigint")


def bisect_exponent(totals: DataFrame, repetition_limit: float | None, target_entropy: float | None) -> float:
    """The largest exponent meeting ``target_entropy`` (nats), or the smallest meeting ``repetition_limit``.

    totals: (source, tokens > 0). Entropy falls and the spread of repetitions shrinks as the
    exponent goes from 0 (equal shares) to 1 (shares as they are). A round tries 15 inner
    exponents in one aggregation over the sources, so a round is four bisection steps, and
    only those 15 sums come to the driver, however many sources there are.
    """
    grand = totals.agg(F.sum("tokens").alias("t"), F.max("tokens").alias("most"), F.min("tokens").alias("least")).first()
    if not grand["t"]:
        return 1.0
    share = F.col("tokens").cast("double") / float(grand["t"])
    steps, low = 1 << PROBE_BITS, 0
    for r in range(1, ROUNDS + 1):
        unit = 1 << (PROBE_BITS * (ROUNDS - r))
        scale = float(1 << (PROBE_BITS * ROUNDS))
        probes = [(low + i * unit) / scale for i in range(1, steps)]
        if target_entropy is not None:
            sums = totals.agg(*[F.sum(F.pow(share, F.lit(a))).alias(f"z{i}") for i, a in enumerate(probes)], *[F.sum(F.pow(share, F.lit(a)) * F.log(share) * a).alias(f"y{i}") for i, a in enumerate(probes)]).first()
            held = [math.log(sums[f"z{i}"]) - sums[f"y{i}"] / sums[f"z{i}"] >= target_entropy for i in range(len(probes))]
            low += unit * sum(held)  # entropy falls: the probes that hold come first
        else:
            spread = totals.agg(*[(F.max(F.pow(share, F.lit(a - 1.0))) / F.min(F.pow(share, F.lit(a - 1.0)))).alias(f"e{i}") for i, a in enumerate(probes)]).first()
            low += unit * sum(spread[f"e{i}"] > repetition_limit for i in range(len(probes)))
    whole = 1 << (PROBE_BITS * ROUNDS)
    if target_entropy is not None:
        return 1.0 if low == whole - 1 else low / whole
    spread = float(grand["most"]) / float(grand["least"])
    return 0.0 if spread <= repetition_limit else (low + 1) / whole


def mixture(documents: DataFrame, repetition_limit: float | None = REPETITION_LIMIT, target_entropy: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The training schedule: one row for each use of a document.

    Tokens are words between ASCII white space. A source's weight is its token share to the
    bisected exponent, normalised. The budget is the least for which each document is used
    at least once, so no clean document is lost: the least raised source gets one epoch, and
    no source more than ``repetition_limit`` (unless an entropy is asked for). Each epoch of
    a source is a permutation by MD5; the last is cut at the source's budget. The budgets
    are laid evenly over blocks of about ``block_tokens``, so each block has the target
    weights, and a block's rows are permuted again.

    Columns: doc_id, source, epoch (from 1), tokens, weight, block, slot (in the block).
    Rows that share source and id are used together. Null sources count as ''. Documents
    without words have no tokens and are used once in each whole epoch. Null ids are one
    id. An empty table gives an empty schedule. Other columns are not read.
    """
    units = written(
        documents.select(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(id_col).cast("bigint").alias("doc_id"), word_count(F.col(text_col)).alias("tokens"))
        .groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("copies")), "mix-units")
    totals = written(units.groupBy("source").agg(F.sum("tokens").alias("total")), "mix-totals")
    live = totals.filter("total > 0").select("source", F.col("total").alias("tokens"))
    exponent = bisect_exponent(live, repetition_limit, target_entropy)
    grand = totals.agg(F.max("total").alias("most"), F.sum(F.when(F.col("total") > 0, F.pow(F.col("total").cast("double"), F.lit(exponent)))).alias("z"), F.count("*").alias("n")).first()
    most = float(grand["most"] or 1) or 1.0
    raised = F.col("total").cast("double")
    plan = totals.select(
        "source", "total", F.round(F.when(F.col("total") > 0, F.pow(raised, F.lit(exponent)) / float(grand["z"] or 1)).otherwise(0.0), 6).alias("weight"),
        F.when(F.col("total") > 0, F.round(F.pow(F.lit(most) / raised, F.lit(1.0 - exponent)), 6)).otherwise(1.0).alias("epochs"),
    ).withColumn("budget", F.floor(raised * F.col("epochs")).cast("bigint"))
    blocks = max(1, math.ceil((plan.agg(F.sum("budget")).first()[0] or 0) / block_tokens))
    buckets = max(1, math.ceil(units.count() / BUCKET_ROWS))

    uses = units.join(plan, "source").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.ceil("epochs").cast("int"))))
    uses = uses.withColumn("key", F.md5(F.concat_ws("|", F.lit(seed), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    uses = uses.withColumn("bucket", F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") % buckets)
    # places in a source's stream by two levels of running sums, since one source may hold a third of all rows
    order = Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = uses.groupBy("source", "epoch", "bucket").agg(F.sum("tokens").alias("held")).withColumn("base", F.coalesce(F.sum("held").over(order), F.lit(0))).drop("held")
    inner = Window.partitionBy("source", "epoch", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    uses = uses.withColumn("inner", F.coalesce(F.sum("tokens").over(inner), F.lit(0))).join(base, ["source", "epoch", "bucket"])
    uses = uses.withColumn("place", (F.col("epoch") - 1) * F.col("total") + F.col("base") + F.col("inner"))
    uses = uses.filter((F.col("place") < F.col("budget")) | (F.col("epoch") <= F.floor("epochs")))
    uses = uses.withColumn("block", F.when(F.col("budget") > 0, F.least(F.floor(F.col("place").cast("double") * blocks / F.col("budget").cast("double")), F.lit(blocks - 1))).otherwise(0).cast("bigint"))
    uses = uses.withColumn("slot", F.row_number().over(Window.partitionBy("block").orderBy("key", "source", "doc_id")) - 1)
    return uses.select("doc_id", "source", F.col("epoch").cast("int").alias("epoch"), "tokens", "weight", "block", F.col("slot").cast("bigint").alias("slot"))


def mixed_documents(documents: DataFrame, id_col: str = "doc_id", source_col: str = "source", **how) -> DataFrame:
    """The documents as the schedule uses them: as many rows of each as it has uses, with the same columns."""
    uses = mixture(documents, id_col=id_col, source_col=source_col, **how).groupBy(F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source")).agg(F.count("*").cast("int").alias("_mix_n"))
    held = documents.join(uses, F.col(id_col).cast("bigint").eqNullSafe(F.col("_mix_id")) & (F.coalesce(F.col(source_col).cast("string"), F.lit("")) == F.col("_mix_source")))
    return held.withColumn("_mix_n", F.explode(F.sequence(F.lit(1), F.col("_mix_n")))).select(*documents.columns)


ORACLE = f"""
with d as (select coalesce(source, '') as source, doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda w: w <> ''))::bigint as n from documents),
 units as (select source, doc_id, sum(n)::bigint as tokens from d group by source, doc_id),
 totals as (select source, sum(tokens)::bigint as total from units group by source),
 e as (select max(total)::double as most, max(total)::double / min(total)::double as spread from totals where total > 0),
 a as (select most, case when spread <= {REPETITION_LIMIT} then 0.0 else ceil((1 - ln({REPETITION_LIMIT}) / ln(spread)) * 4294967296.0) / 4294967296.0 end as x from e),
 z as (select sum(pow(total::double, x)) as z from totals, a where total > 0),
 plan as (select source, total, case when total > 0 then round(pow(total::double, x) / z, 6) else 0.0 end as weight,
    case when total > 0 then round(pow(most / total::double, 1.0 - x), 6) else 1.0 end as epochs from totals, a, z),
 b as (select *, floor(total * epochs)::bigint as budget from plan),
 k as (select greatest(1, ceil(sum(budget) / {BLOCK_TOKENS}.0)) as blocks from b),
 m as (select greatest(1, ceil(count(*) / {BUCKET_ROWS}.0))::bigint as buckets from units),
 u as (select units.*, total, weight, epochs, budget, epoch, md5('{SEED}|' || epoch || '|' || coalesce(doc_id::varchar, '')) as key
    from units join b using (source), range(1, 3) r(epoch) where epoch <= ceil(epochs)),
 v as (select *, ('0x' || substr(key, 1, 8))::bigint % buckets as bucket from u, m),
 p as (select *, (epoch - 1) * total + coalesce(sum(tokens) over (partition by source, epoch order by bucket, key, doc_id rows between unbounded preceding and 1 preceding), 0) as place from v),
 f as (select p.*, case when budget > 0 then least(floor(place::double * blocks / budget::double), blocks - 1) else 0 end::bigint as block from p, k where place < budget or epoch <= floor(epochs))
select doc_id, source, epoch::int as epoch, tokens, weight, block, row_number() over (partition by block order by key, source, doc_id) - 1 as slot from f"""
