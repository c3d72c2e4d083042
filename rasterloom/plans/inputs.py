"""Codec-shaped relations derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import big


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, s): each vector as 64 integer samples."""
    e = load(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.transform("embedding", lambda v: F.floor(v.cast("double") * 128.0 + 0.5).cast("bigint")).alias("s"))


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, m): the samples as 8 rows of 8."""
    return line(spark, sf_dir).select("vec_id", "label", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.slice("s", y * 8 + 1, F.lit(8))).alias("m"))


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(flag, status, r, g, b, k) samples 0..255."""
    t = load(spark, sf_dir, "lineitem")
    return t.select(
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), ((F.col("l_quantity").cast("bigint") * 5) % 256).alias("r"), (F.col("l_extendedprice").cast("bigint") % 256).alias("g"),
        ((F.floor(F.col("l_tax") * 100 + 0.5).cast("bigint") * 31 + F.col("l_linenumber") * 7) % 256).alias("b"), (F.col("l_orderkey") % 256).alias("k"))


def siz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, grid_w, grid_h, tile_w, tile_h, nl, comps, xr, yr)."""
    p, key = load(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select(
        key.alias("image_id"), (64 + F.col("p_size").cast("bigint") * 16).alias("grid_w"), (64 + (key % 37) * 8).alias("grid_h"), F.when(key % 2 == 0, 128).otherwise(200).cast("bigint").alias("tile_w"), F.when(key % 3 == 0, 96).otherwise(160).cast("bigint").alias("tile_h"),
        (1 + key % 4).alias("nl"), (1 + key % 3).alias("comps"), (1 + key % 2).alias("xr"), (1 + F.call_function("div", key, big(2)) % 2).alias("yr"))


def roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(req, image_id, x, y, w, h, levels), with empty and outlying regions."""
    n = load(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    o = load(spark, sf_dir, "orders").crossJoin(F.broadcast(n))  # one row
    k = F.col("o_orderkey")
    return o.select(k.alias("req"), (k % (F.col("n") + 3)).alias("image_id"), ((k * 37) % 700).alias("x"), ((k * 53) % 300).alias("y"), ((k * 11) % 90).alias("w"), ((k * 7) % 70).alias("h"), (k % 5).alias("levels"))


def image_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, key = load(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select(
        key.alias("source_index"), F.when(F.col("p_size") > 16, "htjpeg2000_lossless").otherwise("jpeg2000_lossless").alias("syntax"), F.when(key % 5 == 0, "jph").otherwise("codestream").alias("kind"),
        (8 + (key % 3) * 4).alias("depth"), (key % 7 == 0).alias("signed"), F.when(key % 2 == 0, "nchw").otherwise("nhwc").alias("layout"), (1 + key % 4).alias("channels"), (key % 2 == 0).alias("mct"), (key % 3 != 0).alias("reversible"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, key = load(spark, sf_dir, "events"), F.col("event_id")
    return e.select(F.col("user_id").alias("source"), key.alias("job"), (1 + key % 4).alias("passes"), F.col("value").cast("bigint").alias("payload"), big(64).alias("descriptor"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select((F.col("user_id") % 16).alias("tile"), F.col("user_id").alias("block"), number.cast("bigint").alias("segment"), F.col("value").cast("bigint").alias("rate"), (F.col("event_id") % 4).alias("layer"), (F.col("event_id") % 17 - 8).alias("diff"))


def estimates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Benchmarks (id, median, lower, upper) of the earlier and the later events."""
    e = load(spark, sf_dir, "events").withColumn("id", F.concat_ws("/", "event_type", (F.col("user_id") % 40).cast("string"))).withColumn("early", F.col("event_id") % 2 == 0)
    made = e.groupBy("id", "early").agg(F.round(F.avg("value") * 1000.0, 3).alias("median"), F.round(F.min("value") * 1000.0, 3).alias("lower"), F.round(F.min("value") * 1000.0 + F.count("*") * 100.0, 3).alias("upper"))
    return made.filter("early").drop("early"), made.filter("not early").drop("early")


# the same relations in SQL
SQL = {
    "line": "select vec_id, label, list_transform(embedding, lambda v: floor(v::double * 128.0 + 0.5)::bigint) as s from embeddings",
    "px": "select vec_id, label, (i // 8)::bigint as y, (i % 8)::bigint as x, i, s[i + 1] as v from (select *, unnest(range(64)) as i from line)",
    "rgb": "select l_returnflag as flag, l_linestatus as status, (trunc(l_quantity)::bigint * 5) % 256 as r, trunc(l_extendedprice)::bigint % 256 as g, (floor(l_tax * 100 + 0.5)::bigint * 31 + l_linenumber * 7) % 256 as b, l_orderkey % 256 as k from lineitem",
    "siz": "select p_partkey as image_id, 64 + p_size::bigint * 16 as grid_w, 64 + (p_partkey % 37) * 8 as grid_h, case when p_partkey % 2 = 0 then 128 else 200 end::bigint as tile_w, case when p_partkey % 3 = 0 then 96 else 160 end::bigint as tile_h, 1 + p_partkey % 4 as nl, 1 + p_partkey % 3 as comps, 1 + p_partkey % 2 as xr, 1 + (p_partkey // 2) % 2 as yr from part",
    "roi": "select o_orderkey as req, o_orderkey % (n + 3) as image_id, (o_orderkey * 37) % 700 as x, (o_orderkey * 53) % 300 as y, (o_orderkey * 11) % 90 as w, (o_orderkey * 7) % 70 as h, o_orderkey % 5 as levels from orders, (select count(*) as n from part)",
    "image_meta": "select p_partkey as source_index, case when p_size > 16 then 'htjpeg2000_lossless' else 'jpeg2000_lossless' end as syntax, case when p_partkey % 5 = 0 then 'jph' else 'codestream' end as kind, 8 + (p_partkey % 3) * 4 as depth, p_partkey % 7 = 0 as signed, case when p_partkey % 2 = 0 then 'nchw' else 'nhwc' end as layout, 1 + p_partkey % 4 as channels, p_partkey % 2 = 0 as mct, p_partkey % 3 <> 0 as reversible from part",
    "jobs": "select user_id as source, event_id as job, 1 + event_id % 4 as passes, trunc(value)::bigint as payload, 64::bigint as descriptor from events",
    "segments": "select user_id % 16 as tile, user_id as block, row_number() over (partition by user_id order by ts, event_id) - 1 as segment, trunc(value)::bigint as rate, event_id % 4 as layer, event_id % 17 - 8 as diff from events",
    "est": "select event_type || '/' || (user_id % 40) as id, event_id % 2 = 0 as early, round(avg(value) * 1000.0, 3) as median, round(min(value) * 1000.0, 3) as lower, round(min(value) * 1000.0 + count(*) * 100.0, 3) as upper from events group by all",
    # tiles, components, resolutions and bands of siz
    "tiles": "select *, greatest((tile % across) * tile_w, 0) as tx0, greatest((tile // across) * tile_h, 0) as ty0, least((tile % across + 1) * tile_w, grid_w) as tx1, least((tile // across + 1) * tile_h, grid_h) as ty1 from (select *, unnest(range(across * down)) as tile from (select *, ceil(grid_w / tile_w)::bigint as across, ceil(grid_h / tile_h)::bigint as down from siz))",
    "ctiles": "select *, ceil(tx0 / sx)::bigint as cx0, ceil(ty0 / sy)::bigint as cy0, ceil(tx1 / sx)::bigint as cx1, ceil(ty1 / sy)::bigint as cy1 from (select *, case when comp = 0 then 1 else xr end as sx, case when comp = 0 then 1 else yr end as sy from (select *, unnest(range(comps)) as comp from tiles))",
    "res": "select *, ceil(cx0 / d)::bigint as rx0, ceil(cy0 / d)::bigint as ry0, ceil(cx1 / d)::bigint as rx1, ceil(cy1 / d)::bigint as ry1 from (select *, (1::bigint << (nl - res)) as d from (select *, unnest(range(nl + 1)) as res from ctiles))",
    "pcount": "select *, case when rx1 > rx0 then ceil(rx1 / 128)::bigint - rx0 // 128 else 0 end as px, case when ry1 > ry0 then ceil(ry1 / 128)::bigint - ry0 // 128 else 0 end as py from res",
    "bands": "select *, ceil(greatest(cx0 - ox, 0) / n)::bigint as bx0, ceil(greatest(cy0 - oy, 0) / n)::bigint as by0, ceil(greatest(cx1 - ox, 0) / n)::bigint as bx1, ceil(greatest(cy1 - oy, 0) / n)::bigint as by1 from (select *, (1::bigint << lev) as n, case when band in ('HL', 'HH') then 1::bigint << (lev - 1) else 0 end as ox, case when band in ('LH', 'HH') then 1::bigint << (lev - 1) else 0 end as oy from (select *, case when res = 0 then nl else nl - res + 1 end as lev, unnest(case when res = 0 then ['LL'] else ['HL', 'LH', 'HH'] end) as band from res))",
}
NEEDS = {"px": ["line"], "tiles": ["siz"], "ctiles": ["tiles"], "res": ["ctiles"], "pcount": ["res"], "bands": ["res"]}


def sql(query: str, *names: str) -> str:
    """``query`` over the named relations."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return f"with recursive {query.lstrip().removeprefix('+')}" if query.lstrip().startswith("+") else query
    return "with recursive " + ", ".join(f"{n} as ({SQL[n]})" for n in order) + ("," if query.lstrip().startswith("+") else "") + " " + query.lstrip().removeprefix("+")
