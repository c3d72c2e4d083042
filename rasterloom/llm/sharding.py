"""Sharding by histogram sort, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import md5_bits, written

BITS, LEVEL_BITS = 60, 10
LEVELS = BITS // LEVEL_BITS
TOLERANCE = 0.0025


def histogram_splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """Splitters (p, q) over rows (p, q, size): shard j begins at splitter j - 1.

    A round counts the exact bytes of the probed key ranges in every partition and sums
    them; at most ``shards * 2**LEVEL_BITS`` sums come to the driver, whatever the input.
    A splitter is settled once the nearest probe is within ``tolerance`` of a shard's bytes
    of its target; else the next round probes the range that holds the target. Keys that
    share p (equal texts) are divided by q only where no p meets the tolerance.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    targets = {j: total * j / shards for j in range(1, shards)}
    found: dict[int, tuple[int, int]] = {}
    # an open range: (fixed p or None, prefix at the current level, bytes below it)
    ranges = {j: (None, 0, 0) for j in targets}
    for level in range(2 * LEVELS):
        if not ranges:
            break
        column, inner = ("p", level) if level < LEVELS else ("q", level - LEVELS)
        shift = BITS - LEVEL_BITS * (inner + 1)
        wanted = sorted({r[:2] for r in ranges.values()}, key=str)
        sums: dict[tuple, dict[int, int]] = {w: {} for w in wanted}
        if column == "p":
            fixed = F.lit(None).cast("bigint")
            keep = F.shiftright("p", shift + LEVEL_BITS).isin([w[1] for w in wanted])
        else:
            fixed = F.col("p")
            keep = F.lit(False)
            for p, prefix in wanted:
                keep = keep | ((F.col("p") == p) & (F.shiftright("q", shift + LEVEL_BITS) == prefix))
        for row in keys.filter(keep).groupBy(fixed.alias("f"), F.shiftright(column, shift).alias("k")).agg(F.sum("size").alias("s")).collect():
            sums[(row["f"], row["k"] >> LEVEL_BITS)][row["k"]] = row["s"]
        after = {}
        for j, (p, prefix, below) in ranges.items():
            edges = [(prefix << LEVEL_BITS, below)]
            for k, s in sorted(sums[(p, prefix)].items()):
                edges += [(k, edges[-1][1]), (k + 1, edges[-1][1] + s)]
            near = min(edges, key=lambda e: (abs(e[1] - targets[j]), e[0]))
            if abs(near[1] - targets[j]) <= tolerance * total / shards or level == 2 * LEVELS - 1:
                at = near[0] << shift
                found[j] = (at, 0) if p is None else (p, at)
            else:
                k, low = [e for e in edges[1::2] if e[1] <= targets[j]][-1]
                after[j] = (k, 0, low) if level == LEVELS - 1 else (p, k, low)
        ranges = after
    return [found[j] for j in sorted(found)]


def below(splitters: list[tuple[int, int]]) -> Column:
    """How many splitters a row's key (p, q) has reached."""
    out = F.lit(0)
    for p, q in splitters:
        out = out + F.when((F.col("p") > p) | ((F.col("p") == p) & (F.col("q") >= q)), 1).otherwise(0)
    return out


def shard_by_bytes(documents: DataFrame, shards: int = 24, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of nearly equal bytes, and each row's gapless place in its shard.

    Rows are ordered by (p, q, id): p has 60 bits of the text's MD5, q of the id's. Equal
    texts therefore stand together, and a boundary parts them only where that is needed for
    the tolerance. After the splitters are known, rows are exchanged once, by ranges.

    A null text has 8 bytes and counts as the empty one for its checksum. Null ids order
    first. Repeated rows each get a place of their own. An empty table gives an empty
    result. Other columns are not read, so their names can't clash.
    """
    text, doc = F.col(text_col), F.col(id_col).cast("bigint")
    keys = written(documents.select(
        doc.alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 8).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        md5_bits(F.coalesce(text, F.lit(""))).alias("p"), md5_bits(F.coalesce(doc.cast("string"), F.lit(""))).alias("q"),
    ), "shard-keys")
    splitters = histogram_splitters(keys, shards, tolerance)
    dealt = keys.withColumn("shard", below(splitters)).repartitionByRange("shard", "p", "q", "doc_id").sortWithinPartitions("shard", "p", "q", "doc_id")
    at = F.monotonically_increasing_id()
    dealt = written(dealt.select("doc_id", "size", "text_crc32", "shard", F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("row")), "shard-rows")
    # one row for each pair of partition and shard that meet: at most partitions + shards
    starts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).select("shard", "part", "base")
    return dealt.join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("row") + F.col("base")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def oracle_sql(shards: int = 24, tolerance: float = TOLERANCE) -> str:
    levels = ", ".join(f"({r}, {BITS - LEVEL_BITS * min(r, LEVELS)}, {BITS - LEVEL_BITS * (r - LEVELS) if r > LEVELS else BITS})" for r in range(1, 2 * LEVELS + 1))
    step = "x"
    for _ in range(8):  # the table of CRC-32 from its polynomial
        step = f"list_transform({step}, lambda v: case when v % 2 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)"
    return f"""
with crc as (select {step.replace("(x,", "(range(256),", 1)} as t),
 k as (select doc_id, coalesce(strlen(text), 0)::bigint + 8 as size, text,
        ('0x' || substr(md5(coalesce(text, '')), 1, 15))::bigint as p, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as q
    from documents),
 total as (select sum(size)::double as t from k),
 levels(r, ps, qs) as (values {levels}),
 sums as (select r, p >> ps as a, q >> qs as b, sum(size) as s from k, levels group by r, p >> ps, q >> qs),
 cums as (select r, sum(s) over (partition by r order by a, b) as cum from sums union all select r, 0 from levels),
 targets as (select j, t * j / {shards} as goal, {tolerance} * t / {shards} as tol from total, range(1, {shards}) x(j)),
 best as (select j, r, tol, min(abs(cum - goal)) as d from targets, cums group by j, r, tol),
 pick as (select j, min(r) as r from best where d <= tol or r = {2 * LEVELS} group by j),
 edge as (select j, min(cum) as bytes from pick join best using (j, r) join targets using (j) join cums using (r) where abs(cum - goal) = d group by j),
 o as (select *, sum(size) over (order by p, q, doc_id rows unbounded preceding) as upto from k),
 s as (select o.*, (select count(*) from edge where edge.bytes <= o.upto - o.size)::int as shard from o)
select doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by p, q, doc_id) - 1 as slot, null::int as grown_shard from s, crc"""
