"""All registered queries of the codec operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, dct, geometry, huffman, packets, packing, quant, rects, resample, wavelet
from ..functions.columns import big, clamp, let, shr
from ..operators import batches, grids, metrics, progression, rate
from . import inputs as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *names: str):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = t.sql(sql, *names)
        return f

    return register


def fixed(c: Column, digits: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(c, digits) + 0.0


def lifted_sql(source: str, out: str, by: str, at: str, n: int = 8) -> str:
    """CTEs of one forward 5/3 pass of relation (vec_id, y, x, v) along ``at``; low part first."""
    half = (n + 1) // 2
    w = f"over (partition by vec_id, {by} order by {at})"
    return f"""
 {out}1 as (select *, case when {at} % 2 = 1 then v - ((lag(v) {w} + coalesce(lead(v) {w}, lag(v) {w})) >> 1) else v end as h from {source}),
 {out} as (select vec_id, label, {'y' if at == 'x' else f'(case when y % 2 = 0 then y // 2 else {half} + y // 2 end)'} as y, {'x' if at == 'y' else f'(case when x % 2 = 0 then x // 2 else {half} + x // 2 end)'} as x,
   case when {at} % 2 = 0 then h + ((coalesce(lag(h) {w}, lead(h) {w}) + coalesce(lead(h) {w}, lag(h) {w}) + 2) >> 2) else h end as v from {out}1)"""


# wavelets

@query("+ " + lifted_sql("(select vec_id, label, 0 as y, i as x, v from px)", "a", "y", "x", 64) + " select vec_id, x as idx, v from a", "px")
def dwt53_fwd_1d(spark: SparkSession, sf: str) -> DataFrame:
    return t.line(spark, sf).select("vec_id", F.posexplode(wavelet.forward53(F.col("s"))).alias("idx", "v"))


TWO_D = lifted_sql("px", "a", "x", "y") + "," + lifted_sql("a", "b", "y", "x")


@query("+ " + TWO_D + ", s as (select label, sum(abs(v))::bigint as coefficients from b group by label) select label, count(*) as total, count(*) as exact, 0::bigint as max_abs, 0.0::double as squares, 1.0::double as rate, any_value(coefficients) as coefficients from px join s using (label) group by label", "px")
def dwt53_roundtrip_2d(spark: SparkSession, sf: str) -> DataFrame:
    """Forward and inverse: all errors are 0; the coefficients' sum comes with them."""
    p = t.plane(spark, sf).withColumn("w", wavelet.forward_plane(F.col("m")))
    p = p.withColumn("back", wavelet.inverse_plane(F.col("w")))
    size = F.aggregate(F.flatten("w"), big(0), lambda s, v: s + F.abs(v))
    flat = p.select("label", size.alias("size"), F.posexplode(F.arrays_zip(F.flatten("m").alias("a"), F.flatten("back").alias("b"))).alias("i", "p")).select("label", F.when(F.col("i") == 0, F.col("size")).otherwise(0).alias("size"), "p.a", "p.b")
    out = metrics.error_metrics(flat, "a", "b", "label").join(flat.groupBy("label").agg(F.sum("size").alias("coefficients")), "label")
    return out.select("label", "total", "exact", "max_abs", F.col("squares").cast("double").alias("squares"), metrics.exact_rate(F.col("exact"), F.col("total")).alias("rate"), "coefficients")


LEVELS_SQL = TWO_D + ", b4 as (select * from b where x < 4 and y < 4)," + lifted_sql("b4", "c", "x", "y", 4) + "," + lifted_sql("c", "d", "y", "x", 4) + ", d2 as (select * from d where x < 2 and y < 2)," + lifted_sql("d2", "e", "x", "y", 2) + "," + lifted_sql("e", "f", "y", "x", 2)


@query("+ " + LEVELS_SQL + ", u as (select * from b where not (x < 4 and y < 4) union all select * from d where not (x < 2 and y < 2) union all select * from f) select vec_id, y * 8 + x as idx, v from u", "px")
def dwt53_multilevel(spark: SparkSession, sf: str) -> DataFrame:
    return t.plane(spark, sf).select("vec_id", F.posexplode(F.flatten(wavelet.forward_levels(F.col("m"), 3))).alias("idx", "v"))


@query("""+ o as (select unnest(range(32)) as i), taps as (select 'low' as band, i, d.s as s, sum(w) as w from o, lateral (select abs(2 * i + k) as s0, w from (values (-2, -0.125), (-1, 0.25), (0, 0.75), (1, 0.25), (2, -0.125)) k(k, w)) e, lateral (select case when s0 > 63 then 126 - s0 else s0 end as s) d group by all
 union all select 'high', i, d.s, sum(w) from o, lateral (select 2 * i + 1 + k as s0, w from (values (-1, -0.5), (0, 1.0), (1, -0.5)) k(k, w)) e, lateral (select case when s0 > 63 then 126 - s0 else s0 end as s) d group by all)
 select px.label, taps.band, taps.i::int as output, sum(w::double * v) as value from px join taps on px.i = taps.s group by px.label, taps.band, taps.i""", "px")
def dwt53_linear_taps(spark: SparkSession, sf: str) -> DataFrame:
    """The analysis without rounding as a table of weights; sums are pre-aggregated by label."""
    taps = spark.createDataFrame(wavelet.linear53_taps(64), "band string, output int, at int, weight double")
    samples = t.line(spark, sf).select("label", F.posexplode("s").alias("at", "v"))
    return samples.join(F.broadcast(taps), "at").groupBy("label", "band", "output").agg(F.sum(F.col("weight") * F.col("v")).alias("value"))


def lift97_sql(c: str, source: str, out: str, odd: bool) -> str:
    w = "over (partition by vec_id order by i)"
    return f"{out} as (select vec_id, i, case when i % 2 = {int(odd)} then v + {c} * (coalesce(lag(v) {w}, lead(v) {w}) + coalesce(lead(v) {w}, lag(v) {w})) else v end as v from {source})"


@query("+ z as (select vec_id, i, v::double as v from px), " + ", ".join(lift97_sql(f"({c})::double", s, o, odd) for c, s, o, odd in ((wavelet.ALPHA, "z", "a", True), (wavelet.BETA, "a", "b", False), (wavelet.GAMMA, "b", "c", True), (wavelet.DELTA, "c", "d", False)))
       + f" select vec_id, (case when i % 2 = 0 then i // 2 else 32 + i // 2 end)::int as idx, round(case when i % 2 = 0 then v * (1.0::double / {wavelet.KAPPA}::double) else v * {wavelet.KAPPA}::double end, 6) + 0.0 as v from d", "px")
def dwt97_fwd_1d(spark: SparkSession, sf: str) -> DataFrame:
    x = F.transform("s", lambda v: v.cast("double"))
    return t.line(spark, sf).select("vec_id", F.posexplode(wavelet.forward97(x)).alias("idx", "v")).select("vec_id", "idx", fixed(F.col("v")).alias("v"))


@query("select label, count(*) as total, true as close from px group by label", "px")
def dwt97_roundtrip_1d(spark: SparkSession, sf: str) -> DataFrame:
    x = F.transform("s", lambda v: v.cast("double"))
    p = t.line(spark, sf).withColumn("back", wavelet.inverse97(wavelet.forward97(x)))
    flat = p.select("label", F.explode(F.arrays_zip("s", "back")).alias("p"))
    return flat.groupBy("label").agg(F.count("*").alias("total"), (F.max(F.abs(F.col("p.s") - F.col("p.back"))) < 1e-6).alias("close"))


# colour

@query("select flag, status, count(*) as n, sum((r + 2 * g + b) >> 2)::bigint as y, sum(b - g)::bigint as cb, sum(r - g)::bigint as cr, 0::bigint as errors from rgb group by all", "rgb")
def rct_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    d = t.rgb(spark, sf)
    y, cb, cr = color.forward_rct(F.col("r"), F.col("g"), F.col("b"))
    d = d.withColumns({"y": y, "cb": cb, "cr": cr})
    r, g, b = color.inverse_rct(F.col("y"), F.col("cb"), F.col("cr"))
    wrong = ((r != F.col("r")) | (g != F.col("g")) | (b != F.col("b"))).cast("bigint")
    return d.groupBy("flag", "status").agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum("cb").alias("cb"), F.sum("cr").alias("cr"), F.sum(wrong).alias("errors"))


def group_sums(d: DataFrame, **values: Column) -> DataFrame:
    return d.groupBy("flag", "status").agg(*(F.sum(v).alias(n) for n, v in values.items()))


@query("select r, g, b, round(0.299::double * r + 0.587::double * g + 0.114::double * b, 6) + 0.0 as y, round(-0.16875::double * r + -0.33126::double * g + 0.5::double * b, 6) + 0.0 as cb, round(0.5::double * r + -0.41869::double * g + -0.08131::double * b, 6) + 0.0 as cr, count(*) as n from rgb group by all", "rgb")
def ict_forward(spark: SparkSession, sf: str) -> DataFrame:
    y, cb, cr = color.forward_ict(F.col("r"), F.col("g"), F.col("b"))
    return t.rgb(spark, sf).groupBy("r", "g", "b").agg(F.count("*").alias("n")).select("r", "g", "b", "n", fixed(y).alias("y"), fixed(cb).alias("cb"), fixed(cr).alias("cr"))


def ycc_sql(bits: int) -> str:
    c, top = 1 << (bits - 1), (1 << bits) - 1
    return f"""greatest(0, least({top}, y + ((91881 * (cr - {c}) + 32768) >> 16))) as r, greatest(0, least({top}, y - ((22554 * (cb - {c}) + 46802 * (cr - {c}) + 32768) >> 16))) as g, greatest(0, least({top}, y + ((116130 * (cb - {c}) + 32768) >> 16))) as b"""


def _ycc(bits: int):
    scale = 1 << (bits - 8)

    def run(spark: SparkSession, sf: str) -> DataFrame:
        r, g, b = color.ycbcr_to_rgb(F.col("r") * scale, F.col("g") * scale, F.col("b") * scale, bits)
        return group_sums(t.rgb(spark, sf), red=r, green=g, blue=b)

    run.__name__ = f"ycbcr{bits}_to_rgb"
    return query(f"+ v as (select flag, status, r * {scale} as y, g * {scale} as cb, b * {scale} as cr from rgb), o as (select flag, status, {ycc_sql(bits)} from v) select flag, status, sum(r)::bigint as red, sum(g)::bigint as green, sum(b)::bigint as blue from o group by all", "rgb")(run)


for _bits in (8, 12, 16):
    _ycc(_bits)


def _cmyk(bits: int):
    scale, top = 1 << (bits - 8), (1 << bits) - 1

    def run(spark: SparkSession, sf: str) -> DataFrame:
        r, g, b = color.inverted_cmyk_to_rgb(*(F.col(n) * scale for n in "rgbk"), bits)
        return group_sums(t.rgb(spark, sf), red=r, green=g, blue=b)

    run.__name__ = f"cmyk{bits}_to_rgb"
    return query("select flag, status, " + ", ".join(f"sum(({n} * {scale} * k * {scale} + {top // 2}) // {top})::bigint as {o}" for n, o in (("r", "red"), ("g", "green"), ("b", "blue"))) + " from rgb group by all", "rgb")(run)


for _bits in (8, 12):
    _cmyk(_bits)


@query(f"+ v as (select flag, status, r as y, g as cb, b as cr, k from rgb), o as (select flag, status, k, {ycc_sql(8)} from v) select flag, status, sum((r * k + 127) // 255)::bigint as red, sum((g * k + 127) // 255)::bigint as green, sum((b * k + 127) // 255)::bigint as blue from o group by all", "rgb")
def ycck_to_rgb(spark: SparkSession, sf: str) -> DataFrame:
    r, g, b = color.ycck_to_rgb(*(F.col(n) for n in "rgbk"))
    return group_sums(t.rgb(spark, sf), red=r, green=g, blue=b)


@query("select r, g, b, round(greatest(least(r + 1.402::double * (b - 128), 255), 0), 4) as red, round(greatest(least(r - 0.344136::double * (g - 128) + -0.714136::double * (b - 128), 255), 0), 4) as green, round(greatest(least(r + 1.772::double * (g - 128), 255), 0), 4) as blue, count(*) as n from rgb group by r, g, b", "rgb")
def sycc_to_rgb(spark: SparkSession, sf: str) -> DataFrame:
    r, g, b = color.sycc_to_rgb(F.col("r"), F.col("g"), F.col("b"))
    return t.rgb(spark, sf).groupBy("r", "g", "b").agg(F.count("*").alias("n")).select("r", "g", "b", "n", fixed(r, 4).alias("red"), fixed(g, 4).alias("green"), fixed(b, 4).alias("blue"))


@query("select i::int as idx, sum(greatest(0, least(255, v + 128)))::bigint as u8, sum(round(greatest(0, least(4095, v * 16 + 2048)) / 4095.0::double * 255.0))::bigint as from12, sum(case when ((v & 15) >= 8) then (v & 15) - 16 else v & 15 end)::bigint as nibble from px group by i", "px")
def sample_conversions(spark: SparkSession, sf: str) -> DataFrame:
    s = t.line(spark, sf).select(F.posexplode("s").alias("idx", "v"))
    v = F.col("v")
    return s.groupBy("idx").agg(F.sum(color.sample_as_u8(v + 128, 8)).alias("u8"), F.sum(color.sample_as_u8(v * 16 + 2048, 12)).alias("from12"), F.sum(color.sign_extend(v, 4)).alias("nibble"))


# quantization

@query("+ q as (select label, i, v, (1 + i % 5) * 0.75::double as d from px) select label, i::int as idx, sum((sign(v) * floor(abs(v) / d))::bigint)::bigint as q, round(sum(case when floor(abs(v) / d) = 0 then 0.0 else sign(v) * (floor(abs(v) / d) + 0.5) * d end), 6) + 0.0 as back from q group by label, i", "px")
def quantize_deadzone(spark: SparkSession, sf: str) -> DataFrame:
    s = t.line(spark, sf).select("label", F.posexplode("s").alias("idx", "v")).withColumn("d", (1 + F.col("idx") % 5) * F.lit(0.75))
    s = s.withColumn("q", quant.dead_zone(F.col("v"), F.col("d")))
    return s.groupBy("label", "idx").agg(F.sum("q").alias("q"), fixed(F.sum(quant.dequantize(F.col("q"), F.col("d")))).alias("back"))


@query("+ s as (select p_partkey as id, 8 + p_partkey % 5 as r, p_partkey % 20 as e, (p_partkey * 13) % 2048 as m from part) select id, round(pow(2.0, r - e) * (1 + m / 2048.0), 6) as delta, e::int as exponent, m::int as mantissa, (r + 1)::bigint as bitplanes from s")
def quant_steps(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    s = t.load(spark, sf, "part").select(k.alias("id"), (8 + k % 5).cast("int").alias("r"), (k % 20).cast("int").alias("e"), ((k * 13) % 2048).cast("int").alias("m"))
    s = s.withColumn("exact", quant.step_delta(F.col("r"), F.col("e"), F.col("m")))
    e, m = quant.step_from_delta(F.col("r"), F.col("exact"))
    return s.select("id", fixed(F.col("exact")).alias("delta"), e.cast("int").alias("exponent"), m.alias("mantissa"), quant.reversible_bitplanes(F.col("r"), F.lit("LL"), 2).cast("bigint").alias("bitplanes"))


# error metrics

@query("+ d as (select label, v as a, case when i % 9 = 0 then v + (vec_id % 3) - 1 else v end as b from px), s as (select label, count(*) as total, sum((a = b)::bigint)::bigint as exact, max(abs(a - b)) as max_abs, sum((a - b) * (a - b))::double as squares from d group by label) select label, total, exact, max_abs, squares, round(case when squares > 0 then 10.0 * log10(255.0 * 255.0 / (squares / total)) end, 6) as db, case when max_abs = 0 then 'exact' when max_abs <= 1 and exact / total >= 0.95 then 'one_lsb' else 'outside' end as class from s", "px")
def psnr_peak_mse(spark: SparkSession, sf: str) -> DataFrame:
    s = t.line(spark, sf).select("vec_id", "label", F.posexplode("s").alias("i", "a"))
    s = s.withColumn("b", F.when(F.col("i") % 9 == 0, F.col("a") + F.col("vec_id") % 3 - 1).otherwise(F.col("a")))
    m = metrics.error_metrics(s, "a", "b", "label")
    rate = metrics.exact_rate(F.col("exact"), F.col("total"))
    return m.select("label", "total", "exact", "max_abs", F.col("squares").cast("double").alias("squares"), F.round(metrics.psnr(F.col("squares"), F.col("total"), 255), 6).alias("db"), metrics.classify(F.col("max_abs"), rate, 0.95).alias("class"))


@query("select label, abs(v - (v >> 2) * 4 - 1) as abs_error, count(*) as n from px group by all", "px")
def error_histogram(spark: SparkSession, sf: str) -> DataFrame:
    s = t.line(spark, sf).select("label", F.explode("s").alias("a")).withColumn("b", F.shiftleft(shr(F.col("a"), 2), 2) + 1)
    return metrics.histogram(s, "a", "b", "label")


EST = "+ b as (select * from est where early), c as (select * from est where not early) "


@query(EST + "select coalesce(b.id, c.id) as id, case when c.median is null then 'missing_current' when b.median is null then 'missing_baseline' when b.median <= 0 then 'bad_baseline' else 'compared' end as state, round((c.median - b.median) / nullif(b.median, 0) * 100.0, 6) as delta_percent, coalesce((c.lower - b.upper) / nullif(b.upper, 0) * 100.0 > 10 and c.lower - b.upper > 100, false) as regressed from b full join c on b.id = c.id", "est")
def perf_regressions(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.perf_regressions(*t.estimates(spark, sf))


@query(EST + "select b.id, b.median <= 0.9 * c.median and b.upper < c.lower as wins, round((c.median - b.median) / c.median * 100.0, 6) as speedup_percent from b join c on b.id = c.id", "est")
def routing_wins(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.qualifying_wins(*t.estimates(spark, sf))


# geometry

RECT = "x0", "y0", "x1", "y1"


def spread(name: str) -> list[Column]:
    return [F.col(f"{name}.{n}").alias(n) for n in RECT]


@query("select image_id, tile, tx0 as x0, ty0 as y0, tx1 as x1, ty1 as y1 from tiles", "tiles")
def tile_grid(spark: SparkSession, sf: str) -> DataFrame:
    return grids.tiles(t.siz(spark, sf)).select("image_id", "tile", *spread("t"))


@query("select image_id, comp, res::int as res, count(*) as tiles, sum((rx1 - rx0) * (ry1 - ry0))::bigint as area, min(rx0) as x0, max(ry1) as y1 from res group by all", "res")
def resolution_ladder(spark: SparkSession, sf: str) -> DataFrame:
    r = grids.resolutions(grids.components(grids.tiles(grids.dealt(t.siz(spark, sf)))))
    return r.groupBy("image_id", "comp", "res").agg(F.count("*").alias("tiles"), F.sum((F.col("r.x1") - F.col("r.x0")) * (F.col("r.y1") - F.col("r.y0"))).alias("area"), F.min("r.x0").alias("x0"), F.max("r.y1").alias("y1"))


@query("select image_id, tile, comp, res::int as res, band, bx0 as x0, by0 as y0, bx1 as x1, by1 as y1 from bands", "bands")
def subband_rects(spark: SparkSession, sf: str) -> DataFrame:
    b = grids.bands(grids.resolutions(grids.components(grids.tiles(t.siz(spark, sf)))))
    return b.select("image_id", "tile", "comp", "res", "band", *spread("b"))


@query("select image_id, res::int as res, sum(px * py)::bigint as precincts from pcount group by all", "pcount")
def precinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = grids.precinct_counts(grids.resolutions(grids.components(grids.tiles(grids.dealt(t.siz(spark, sf))))))
    return p.groupBy("image_id", "res").agg(F.sum(F.col("px") * F.col("py")).alias("precincts"))


@query("+ e as (select *, case when res > 0 then 6 else 6 end as k from bands) select image_id, band, sum((case when bx1 > bx0 then ceil(bx1 / 64)::bigint - bx0 // 64 else 0 end) * (case when by1 > by0 then ceil(by1 / 64)::bigint - by0 // 64 else 0 end))::bigint as blocks from e group by all", "bands")
def codeblock_grid(spark: SparkSession, sf: str) -> DataFrame:
    b = grids.code_blocks(grids.bands(grids.resolutions(grids.components(grids.tiles(grids.dealt(t.siz(spark, sf)))))))
    return b.groupBy("image_id", "band").agg(F.sum("blocks").alias("blocks"))


@query("select image_id, floor(log2(least(grid_w, grid_h)))::int as levels, ceil(grid_w / 2)::bigint as low_w, grid_h // 2 as high_h from siz", "siz")
def level_limits(spark: SparkSession, sf: str) -> DataFrame:
    return t.siz(spark, sf).select("image_id", geometry.max_levels(F.col("grid_w"), F.col("grid_h")).alias("levels"), geometry.level_size(F.col("grid_w"), F.lit(1), True).alias("low_w"), geometry.level_size(F.col("grid_h"), F.lit(1), False).alias("high_h"))


@query("""+ a as (select req, x as ax0, y as ay0, x + w as ax1, y + h as ay1, (req * 17) % 600 as bx0, (req * 29) % 250 as by0, (req * 17) % 600 + 120 as bx1, (req * 29) % 250 + 60 as by1 from roi),
 j as (select *, greatest(ax0, bx0) as ix0, greatest(ay0, by0) as iy0, least(ax1, bx1) as ix1, least(ay1, by1) as iy1 from a)
 select req, ax0 < bx1 and bx0 < ax1 and ay0 < by1 and by0 < ay1 as overlap, case when ix0 > ix1 or iy0 > iy1 then 0 else ix0 end as ix0, case when ix0 > ix1 or iy0 > iy1 then 0 else iy1 end as iy1,
  case when ax0 >= ax1 or ay0 >= ay1 then bx0 else least(ax0, bx0) end as ux0, case when ax0 >= ax1 or ay0 >= ay1 then by1 else greatest(ay1, by1) end as uy1, greatest(ax0 - 9, bx0) as ex0, ax0 // 4 as sx0, ceil(ax1 / 4)::bigint as sx1 from j""", "roi")
def rect_algebra(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("req")
    d = t.roi(spark, sf).select("req", rects.rect(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("a"), rects.rect((k * 17) % 600, (k * 29) % 250, (k * 17) % 600 + 120, (k * 29) % 250 + 60).alias("b"))
    a, b = F.col("a"), F.col("b")
    d = d.select("req", rects.intersects(a, b).alias("overlap"), rects.intersect(a, b).alias("i"), rects.union(a, b).alias("u"), rects.expanded_within(a, 9, b).alias("e"), rects.scaled_covering(a, 4).alias("s"))
    return d.select("req", "overlap", F.col("i.x0").alias("ix0"), F.col("i.y1").alias("iy1"), F.col("u.x0").alias("ux0"), F.col("u.y1").alias("uy1"), F.col("e.x0").alias("ex0"), F.col("s.x0").alias("sx0"), F.col("s.x1").alias("sx1"))


@query("""select req, coalesce(case when grid_w is null then 'no_image' when w <= 0 or h <= 0 then 'empty_region' when x + w > grid_w or y + h > grid_h then 'out_of_bounds' when levels > nl then 'too_many_levels' end, 'ok') as outcome,
 case when grid_w is null or w <= 0 or h <= 0 or x + w > grid_w or y + h > grid_h or levels > nl then null else x // (1 << levels) end as ox0, case when grid_w is null or w <= 0 or h <= 0 or x + w > grid_w or y + h > grid_h or levels > nl then null else ceil((y + h) / (1 << levels))::bigint end as oy1 from roi left join siz using (image_id)""", "roi", "siz")
def decode_plan_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    p = grids.decode_plans(t.siz(spark, sf), t.roi(spark, sf))
    return p.select("req", F.coalesce("error", F.lit("ok")).alias("outcome"), F.col("output.x0").alias("ox0"), F.col("output.y1").alias("oy1"))


@query("select req, image_id, tile from roi join tiles using (image_id) where w > 0 and h > 0 and x < tx1 and tx0 < x + w and y < ty1 and ty0 < y + h", "roi", "tiles")
def roi_tile_prune(spark: SparkSession, sf: str) -> DataFrame:
    return grids.tiles_of_regions(t.siz(spark, sf), t.roi(spark, sf)).select("req", "image_id", "tile")


@query("select req, level::int as level, greatest(x // (1 << level) - 16, 0) as x0, greatest(y // (1 << level) - 16, 0) as y0, least(ceil((x + w) / (1 << level))::bigint + 16, ceil(grid_w / (1 << level))::bigint) as x1, least(ceil((y + h) / (1 << level))::bigint + 16, ceil(grid_h / (1 << level))::bigint) as y1 from (select *, unnest(range(1, nl + 1)) as level from roi join siz using (image_id) where w > 0 and h > 0 and x + w <= grid_w and y + h <= grid_h and levels <= nl)", "roi", "siz")
def roi_window_backprop(spark: SparkSession, sf: str) -> DataFrame:
    good = grids.decode_plans(t.siz(spark, sf), t.roi(spark, sf)).filter("error is null")
    return grids.region_windows(good).select("req", "level", *RECT)


# progressions

PACKETS_SQL = """+ a as (select *, sx * (1::bigint << (7 + nl - res)) as stx, sy * (1::bigint << (7 + nl - res)) as sty, unnest(range(px * py)) as precinct from pcount where px * py > 0),
 f as (select *, case when tx0 % stx <> 0 and rx0 % 128 = 0 then ceil(tx0 / stx)::bigint * stx else tx0 end as fx, case when ty0 % sty <> 0 and ry0 % 128 = 0 then ceil(ty0 / sty)::bigint * sty else ty0 end as fy from a),
 g as (select *, case when precinct % px = 0 then fx else (fx // stx + precinct % px) * stx end as ref_x, case when precinct // px = 0 then fy else (fy // sty + precinct // px) * sty end as ref_y from f),
 p as (select *, unnest(range(2)) as layer from g) """


def _packets(spark: SparkSession, sf: str) -> DataFrame:
    return progression.packets(grids.precincts(grids.resolutions(grids.components(grids.tiles(t.siz(spark, sf))))), 2)


def _progression(order: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return progression.ordered(_packets(spark, sf), order, "image_id", "tile").select("image_id", "tile", "layer", "res", "comp", "precinct", "ref_x", "ref_y", "ord")

    run.__name__ = f"progression_{order}"
    return query(PACKETS_SQL + f"select image_id, tile, layer::int as layer, res::int as res, comp, precinct, ref_x, ref_y, (row_number() over (partition by image_id, tile order by {', '.join(progression.ORDERS[order])}) - 1)::int as ord from p", "pcount")(run)


for _order in progression.ORDERS:
    _progression(_order)


@query(PACKETS_SQL + ", v as (select *, 0 as volume, row_number() over (partition by image_id, tile order by layer, res, comp, precinct) as o from p where res < 2 and layer = 0 union all select *, 1, row_number() over (partition by image_id, tile order by res, ref_y, ref_x, comp, precinct, layer) from p), k as (select *, row_number() over (partition by image_id, tile, layer, res, comp, precinct order by volume, o) as n from v) select image_id, tile, layer::int as layer, res::int as res, comp, precinct, volume::int as volume, (row_number() over (partition by image_id, tile order by volume, o) - 1)::int as ord from k where n = 1", "pcount")
def poc_union(spark: SparkSession, sf: str) -> DataFrame:
    p = _packets(spark, sf)
    first = progression.ordered(p.filter("res < 2 and layer = 0"), "lrcp", "image_id", "tile").withColumn("volume", F.lit(0))
    second = progression.ordered(p, "rpcl", "image_id", "tile").withColumn("volume", F.lit(1))
    return progression.union_of_changes(first.unionByName(second), "image_id", "tile").select("image_id", "tile", "layer", "res", "comp", "precinct", "volume", "ord")


@query(PACKETS_SQL + "select image_id, tile, layer::int as layer, res::int as res, comp, precinct, (row_number() over (partition by image_id, tile order by res, precinct, comp, layer) - 1)::int as ord from p", "pcount")
def packet_sort_rpcl(spark: SparkSession, sf: str) -> DataFrame:
    return progression.ordered(_packets(spark, sf), "rpcl", "image_id", "tile", encoder=True).select("image_id", "tile", "layer", "res", "comp", "precinct", "ord")


# batches and decisions

GROUP = ["syntax", "kind", "depth", "signed", "layout", "channels"]


@query(f"+ g as (select {', '.join(GROUP)}, min(source_index) as first_index, count(*) as members, max(source_index) as last_index from image_meta group by all) select *, (row_number() over (order by first_index) - 1)::int as group_no from g", "image_meta")
def batch_groups(spark: SparkSession, sf: str) -> DataFrame:
    return batches.homogeneous_groups(t.image_meta(spark, sf), GROUP)


@query(f"select source_index, (row_number() over (partition by {', '.join(GROUP)} order by source_index) - 1)::int as place from image_meta", "image_meta")
def batch_places(spark: SparkSession, sf: str) -> DataFrame:
    return batches.member_places(t.image_meta(spark, sf), GROUP).select("source_index", "place")


@query("""+ j as (select source, case passes when 1 then 'cleanup' when 2 then 'sigprop' else 'magref' end as bucket, job, payload, descriptor, row_number() over (partition by source, least(passes, 3) order by job) as k from jobs),
 r as (select source, bucket, k, job, 0::bigint as chunk, 1::bigint as n, payload as p, descriptor as d from j where k = 1
  union all select j.source, j.bucket, j.k, j.job, case when x.c then r.chunk + 1 else r.chunk end, case when x.c then 1 else r.n + 1 end, case when x.c then j.payload else r.p + j.payload end, case when x.c then j.descriptor else r.d + j.descriptor end
   from r join j on j.source = r.source and j.bucket = r.bucket and j.k = r.k + 1, lateral (select r.n = 4 or r.p + j.payload > 700 or r.d + j.descriptor > 1000 as c) x)
 select source, bucket, chunk, min(job) as first, max(job) as last, count(*) as n, max(p) as payload, max(d) as descriptor from r group by source, bucket, chunk""", "jobs")
def chunk_plan(spark: SparkSession, sf: str) -> DataFrame:
    j = t.jobs(spark, sf).withColumn("bucket", batches.pass_bucket(F.col("passes")))
    return batches.chunk_jobs(j, 4, 700, 1000, "job", "source")


@query("select block, segment, layer, max(layer) over (partition by block order by segment) as monotonic from segments", "segments")
def layer_monotonic(spark: SparkSession, sf: str) -> DataFrame:
    return batches.monotonic_layers(t.segments(spark, sf)).select("block", "segment", "layer", "monotonic")


@query("""+ s as (select tile, block, segment, rate, row_number() over (partition by tile order by block, segment) as k from segments),
 r as (select tile, k, block, 0::bigint as u0, 0::bigint as u1, 0::bigint as u2, 0 as layer from s where false
  union all select tile, 0::bigint, -1::bigint, 0, 0, 0, 0 from s where k = 1
  union all select s.tile, s.k, s.block, r.u0 + case when l.l <= 0 then s.rate else 0 end, r.u1 + case when l.l <= 1 then s.rate else 0 end, r.u2 + s.rate, l.l
   from r join s on s.tile = r.tile and s.k = r.k + 1, lateral (select case when r.block = s.block then r.layer else 0 end as m) m,
   lateral (select case when m.m <= 0 and r.u0 + s.rate <= 5512 and r.u1 + s.rate <= 20512 and r.u2 + s.rate <= 80800 then 0 when m.m <= 1 and r.u1 + s.rate <= 20512 and r.u2 + s.rate <= 80800 then 1 else 2 end as l) l)
 select tile, block, max(layer)::int as layer, count(*) as segments from r where k > 0 group by tile, block""", "segments")
def layer_assign_ht(spark: SparkSession, sf: str) -> DataFrame:
    return batches.assign_layers(t.segments(spark, sf), [5000, 20000, 80000], "tile")


@query("select block as comp, segment as mcu, segment // 8 as restart, sum(diff) over (partition by block, segment // 8 order by segment)::bigint as dc from segments", "segments")
def dc_prediction_restart(spark: SparkSession, sf: str) -> DataFrame:
    d = t.segments(spark, sf).select(F.col("block").alias("comp"), F.col("segment").alias("mcu"), "diff")
    return batches.dc_prediction(d, 8).select("comp", "mcu", "restart", "dc")


@query("+ p as (select doc_id, case when doc_id % 11 = 0 then 0 else n_chars end as size, lang as syntax, source as kind, n_chars % 3 as components, n_chars % 5 as bit_depth from documents) select doc_id, case when size = 0 then 'empty_payload' when syntax <> 'en' then 'transfer_syntax' when kind not in ('src1', 'src2', 'src3') then 'payload_kind' when components <> 1 then 'components' when doc_id % 2 = 0 and bit_depth <> 2 then 'bit_depth' end as reason from p")
def passthrough_decision(spark: SparkSession, sf: str) -> DataFrame:
    d = t.load(spark, sf, "documents")
    kinds = F.when(F.col("source").isin("src1", "src2", "src3"), F.col("source")).otherwise("src1")
    source = {"size": F.when(F.col("doc_id") % 11 == 0, 0).otherwise(F.col("n_chars")), "syntax": F.col("lang"), "kind": F.col("source"), "components": F.col("n_chars") % 3, "bit_depth": F.col("n_chars") % 5}
    wanted = {"syntax": F.lit("en"), "kind": kinds, "components": big(1), "bit_depth": F.when(F.col("doc_id") % 2 == 0, big(2))}
    return d.select("doc_id", batches.passthrough_reason(source, wanted).alias("reason"))


@query("select syntax, kind, reversible, case when syntax = 'htjpeg2000_lossless' and kind = 'jph' then 'passthrough' when syntax = 'htjpeg2000_lossless' then 'codestream_preserving' when reversible then 'coefficient' else 'pixel' end as mode, count(*) as n from image_meta group by all", "image_meta")
def recode_mode(spark: SparkSession, sf: str) -> DataFrame:
    mode = batches.recode_mode(F.col("syntax"), F.col("kind"), F.lit("jph"), F.col("reversible"))
    return t.image_meta(spark, sf).groupBy("syntax", "kind", "reversible", mode.alias("mode")).agg(F.count("*").alias("n"))


@query("select channels, mct, reversible, case when channels = 1 then 'grayscale' when channels >= 3 and mct and reversible then 'rct' when channels >= 3 and mct then 'ict' when channels in (3, 4) then 'rgb' else 'unknown' end as colorspace, count(*) as n from image_meta group by all", "image_meta")
def colorspace_inference(spark: SparkSession, sf: str) -> DataFrame:
    d = t.image_meta(spark, sf)
    return d.groupBy("channels", "mct", "reversible", color.infer_colorspace(F.col("channels"), F.col("mct"), F.col("reversible")).alias("colorspace")).agg(F.count("*").alias("n"))


@query("+ p as (select *, (p_partkey * 7) % 30 - 2 as idx, list_transform(range(25), lambda i: (i * i + 3)::bigint) as entries from part) select p_partkey as id, case when idx between 0 and 24 then entries[idx + 1] end as value, case when not (idx between 0 and 24) then 'palette_index' end as error from p")
def palette_lookup(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    d = t.load(spark, sf, "part").select(k.alias("id"), ((k * 7) % 30 - 2).alias("idx"), F.array(*[big(i * i + 3) for i in range(25)]).alias("entries"))
    return batches.palette_lookup(d, F.col("entries"), F.col("idx")).select("id", "value", "error")


@query("select n_nationkey::bigint as comp, coalesce(case when n_nationkey % 3 = 0 then 3 + n_nationkey % 4 end, 5)::bigint as levels, (1 | case when n_nationkey % 3 = 0 then n_nationkey % 8 else 0 end)::bigint as style from nation")
def coc_override(spark: SparkSession, sf: str) -> DataFrame:
    n = t.load(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("comp"))
    own = n.filter("comp % 3 = 0").select("comp", (3 + F.col("comp") % 4).alias("levels"), (F.col("comp") % 8).alias("style"))
    return batches.override(n.select("comp", big(5).alias("levels"), big(1).alias("style")), own, ["comp"], ["levels"], ["style"])


# resampling and DCT

U8 = "u as (select vec_id, y, x, greatest(0, least(255, v + 128)) as v from px)"


def _u8_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.transform("m", lambda r: F.transform(r, lambda v: clamp(v + 128, 0, 255)))
    return t.plane(spark, sf).select("vec_id", rows.alias("m"))


@query(f"""+ {U8}, w as (select *, lag(v) over (partition by vec_id, y order by x) as l, lead(v) over (partition by vec_id, y order by x) as r from u)
 select vec_id, y::int as y, (2 * x)::int as x, case when x = 0 then v else (3 * v + l + 1) >> 2 end as v from w union all select vec_id, y::int, (2 * x + 1)::int, case when x = 7 then v else (3 * v + r + 2) >> 2 end from w""", "px")
def fancy_upsample_h2v1(spark: SparkSession, sf: str) -> DataFrame:
    r = _u8_rows(spark, sf).select("vec_id", F.posexplode("m").alias("y", "row"))
    return r.select("vec_id", "y", F.posexplode(resample.upsample_h2v1(F.col("row"), F.lit(16))).alias("x", "v"))


@query(f"""+ {U8}, n as (select vec_id, y, x, v, coalesce(lag(v) over (partition by vec_id, x order by y), v) as up from u), c as (select vec_id, y, x, 3 * v + up as c from n),
 w as (select *, lag(c) over (partition by vec_id, y order by x) as l, lead(c) over (partition by vec_id, y order by x) as r from c)
 select vec_id, y::int as y, (2 * x)::int as x, case when x = 0 then (4 * c + 8) >> 4 else (3 * c + l + 8) >> 4 end as v from w union all select vec_id, y::int, (2 * x + 1)::int, case when x = 7 then (4 * c + 7) >> 4 else (3 * c + r + 7) >> 4 end from w""", "px")
def fancy_upsample_h2v2(spark: SparkSession, sf: str) -> DataFrame:
    r = _u8_rows(spark, sf).select("vec_id", "m", F.posexplode("m").alias("y", "row"))
    near = F.get("m", F.greatest(F.col("y") - 1, F.lit(0)))
    return r.select("vec_id", "y", F.posexplode(resample.upsample_h2v2(near, F.col("row"), F.lit(16))).alias("x", "v"))


ZZ = "zz as (select unnest([" + ", ".join(map(str, dct.ZIGZAG)) + "]) as pos, unnest(range(64)) as k)"


@query(f"+ {ZZ} select px.vec_id, case when max(abs(v)) filter (where pos <> 0) = 0 then 'dc_only' when max(abs(v)) filter (where pos >= 32) = 0 then 'bottom_half_zero' else 'general' end as activity, sum(v * v) filter (where pos % 8 < 4 and pos < 32)::bigint as low_energy, sum(v * (pos + 1))::bigint as walk from px join zz on px.i = zz.k group by px.vec_id", "px")
def zigzag_dct_energy(spark: SparkSession, sf: str) -> DataFrame:
    b = t.line(spark, sf).withColumn("c", dct.unzigzag(F.col("s")))
    energy = F.aggregate(F.filter("c", lambda v, i: (i % 8 < 4) & (i < 32)), big(0), lambda s, v: s + v * v)
    walk = F.aggregate(F.transform("c", lambda v, i: v * (i + 1)), big(0), lambda s, v: s + v)
    return b.select("vec_id", dct.activity(F.col("c")).alias("activity"), energy.alias("low_energy"), walk.alias("walk"))


BASIS = "basis as (select k, i, (case when k = 0 then sqrt(0.125) else 0.5 end) * cos(pi() * (2 * i + 1) * k / 16) as w from range(8) a(k), range(8) b(i))"


@query(f"+ {BASIS}, c as (select vec_id, b.i as y, x, sum(w * v) as v from px join basis b on px.y = b.k group by all) select vec_id, y::int * 8 + b.i::int as idx, round(sum(w * v), 4) + 0.0 as v from c join basis b on c.x = b.k group by vec_id, y, b.i", "px")
def idct8_float(spark: SparkSession, sf: str) -> DataFrame:
    b = t.line(spark, sf).select("vec_id", dct.idct8(F.transform("s", lambda v: v.cast("double"))).alias("p"))
    return b.select("vec_id", F.posexplode("p").alias("idx", "v")).select("vec_id", F.col("idx").cast("int").alias("idx"), fixed(F.col("v"), 4).alias("v"))


@query(f"""+ {BASIS}, o as (select unnest(range(4)) as j), taps as (select j, d.s, sum(w) as w from o, lateral (select abs(2 * j + k) as s0, w from (values (-2, -0.125), (-1, 0.25), (0, 0.75), (1, 0.25), (2, -0.125)) k(k, w)) e, lateral (select case when s0 > 7 then 14 - s0 else s0 end as s) d group by all
  union all select 4 + j, d.s, sum(w) from o, lateral (select 2 * j + 1 + k as s0, w from (values (-1, -0.5), (0, 1.0), (1, -0.5)) k(k, w)) e, lateral (select case when s0 > 7 then 14 - s0 else s0 end as s) d group by all),
 m as (select j, k, sum(taps.w::double * basis.w) as w from taps join basis on taps.s = basis.i group by j, k)
 select label, (a.j * 8 + b.j)::int as idx, round(sum(a.w * b.w * v), 3) + 0.0 as v from px join m a on px.y = a.k join m b on px.x = b.k group by label, a.j, b.j""", "px")
def fused_dct_dwt53(spark: SparkSession, sf: str) -> DataFrame:
    """Inverse DCT and 5/3 analysis as one linear map: its 64 x 64 weights meet the coefficients, summed by label."""
    taps: dict[tuple[int, int], float] = {}
    for band, out, at, w in wavelet.linear53_taps(8):
        for k in range(8):
            key = ((4 if band == "high" else 0) + out, k)
            taps[key] = taps.get(key, 0.0) + w * dct.basis(k, at)
    both = [(a * 8 + b, k * 8 + q, w * v) for (a, k), w in taps.items() for (b, q), v in taps.items()]
    weights = spark.createDataFrame(both, "idx int, at int, weight double")
    sums = t.line(spark, sf).select("label", F.posexplode("s").alias("at", "v")).groupBy("label", "at").agg(F.sum("v").alias("v"))
    return sums.join(F.broadcast(weights), "at").groupBy("label", "idx").agg(fixed(F.sum(F.col("weight") * F.col("v")), 3).alias("v"))


# entropy-coding tables and byte lists

@query("""+ d as (select lang, 1 + n_chars % 9 as len, 1 + count(*) % 3 as n from documents group by all), k as (select lang, len, n, row_number() over (partition by lang order by len) as r from d), m as (select lang, unnest(range(1, 17)) as len from (select distinct lang from documents)),
 b as (select m.lang, m.len, case when m.len >= 8 then coalesce(k.n, 0) else case when m.len in (3, 5) then 1 else 0 end end as n from m left join k on k.lang = m.lang and k.len = m.len),
 c as (select lang, len, n, sum(n) over (partition by lang order by len) - n as idx from b), f as (select a.lang, a.len, a.n, a.idx, coalesce(sum(p.n * (1::bigint << (a.len - p.len))), 0) as first from c a left join c p on p.lang = a.lang and p.len < a.len group by all)
 select lang, len::int as length, (first + j)::bigint as code, (idx + j)::bigint as idx from (select *, unnest(range(n::bigint)) as j from f)""", "px")
def canonical_huffman(spark: SparkSession, sf: str) -> DataFrame:
    d = t.load(spark, sf, "documents").groupBy("lang", (1 + F.col("n_chars") % 9).alias("len")).agg((1 + F.count("*") % 3).alias("n"))
    held = d.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("len", "n"))).alias("m"))
    bits = F.array(*[F.when(F.lit(i >= 8), F.coalesce(F.try_element_at("m", big(i)), big(0))).otherwise(big(int(i in (3, 5)))) for i in range(1, 17)])
    codes = held.select("lang", F.explode(huffman.canonical_codes(bits)).alias("c"))
    return codes.select("lang", "c.length", "c.code", "c.idx")


@query("select user_id, event_id, trunc(value * 1000)::bigint as v from events")
def varint_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths written as 7-bit groups and read back."""
    v = (F.col("value") * 1000).cast("bigint")
    e = t.load(spark, sf, "events").withColumn("g", huffman.to_varint(v))
    return e.select("user_id", "event_id", F.get(huffman.varints(F.concat(F.col("g"), F.array(big(5)))), F.lit(0)).alias("v"))


@query("select event_id, (case when s = 0 then 0 when v < (1 << (s - 1)) then v - (1 << s) + 1 else v end)::bigint as v from (select event_id, event_id % 11 as s, (event_id * 7) % (1 << (event_id % 11)) as v from events)")
def huffman_extend(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    size = (k % 11).cast("int")
    return t.load(spark, sf, "events").select("event_id", huffman.extend((k * 7) % F.call_function("shiftleft", big(1), size), size).alias("v"))


# rate control and bytes; these have no SQL, tests compare them with plain Python

@query()
def layer_assign_classic(spark: SparkSession, sf: str) -> DataFrame:
    s = t.segments(spark, sf).withColumn("distortion", F.col("rate") * (1.0 + F.col("layer")))
    return rate.layers_by_slope(s, [5000, 20000, 80000], ["tile"])


@query()
def jpeg2000_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector's plane as a lossless codestream, inspected and decoded again."""
    from ..operators import images
    from ..sources import containers

    p = t.line(spark, sf).select(F.col("vec_id").alias("image"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.array(F.transform("s", lambda v: clamp(v + 128, 0, 255))).alias("planes"))
    made = images.encode_images(p, kind="jp2", levels=2)
    seen = containers.inspect(made, key="image").select("image", "format", "levels", "reversible")
    back = images.decode_images(made, key="image").select("image", F.col("samples").alias("decoded"), "error")
    return seen.join(back, "image").join(p, "image").select("image", "format", "levels", "reversible", (F.col("decoded") == F.get("planes", F.lit(0))).alias("same"), "error")


@query()
def jpeg_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """DCT blocks of the planes coded as JPEG, counted by activity."""
    from ..operators import images

    p = t.line(spark, sf).select(F.col("vec_id").alias("image"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.array(F.transform("s", lambda v: clamp(v + 128, 0, 255))).alias("planes"))
    b = images.dct_blocks(images.encode_images(p, kind="jpeg"), key="image")
    return b.groupBy(dct.activity(F.col("coeff")).alias("activity")).agg(F.count("*").alias("blocks"))


@query()
def box_walk(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import images
    from ..sources import containers

    p = t.line(spark, sf).select(F.col("vec_id").alias("image"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.array(F.transform("s", lambda v: clamp(v + 128, 0, 255))).alias("planes"))
    made = images.encode_images(p, kind="jp2", levels=1)
    b = containers.box_rows(made, key="image").groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n"))
    m = containers.marker_rows(made, key="image").groupBy(F.col("marker").alias("name")).agg(F.count("*").alias("n"))
    return b.unionByName(m)


# packet header lengths and encoder rules

@query("""select job, length_bits, cleanup_bits, fits, case
  when passes = 0 then case when size <> 0 or cleanup <> 0 or refinement <> 0 then 'empty_has_segments' end
  when cleanup = 0 and refinement <> 0 then case when refinement <> size then 'refinement_only_mismatch' when refinement >= 2047 then 'refinement_out_of_range' end
  when passes = 1 then case when refinement <> 0 then 'single_pass_has_refinement' when cleanup not in (0, size) then 'single_pass_mismatch' end
  when cleanup = 0 or refinement = 0 then 'segments_required' when cleanup + refinement <> size then 'multi_pass_mismatch'
  when cleanup < 2 or cleanup >= 65535 then 'cleanup_out_of_range' when refinement >= 2047 then 'refinement_out_of_range' end as error
from (select event_id as job, event_id % 9 as passes,
    (3 + case when event_id % 9 >= 8 then 3 when event_id % 9 >= 4 then 2 when event_id % 9 >= 2 then 1 else 0 end)::bigint as length_bits,
    (3 + case when event_id % 9 >= 7 then 2 when event_id % 9 >= 4 then 2 else 0 end)::bigint as cleanup_bits, event_id % 70 < (1::bigint << (event_id % 9)) as fits,
    case when event_id % 5 in (0, 1) then 0 else event_id % 70 end as cleanup, case when event_id % 5 in (0, 2) then 0 else (event_id * 131) % 3000 end as refinement,
    case when event_id % 5 in (0, 1) then 0 else event_id % 70 end + case when event_id % 5 in (0, 2) then 0 else (event_id * 131) % 3000 end + case when event_id % 11 = 0 then 1 else 0 end as size from events)""")
def packet_lengths(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("event_id")
    passes, kind = key % 9, key % 5
    cleanup, refinement = F.when(kind.isin(0, 1), 0).otherwise(key % 70), F.when(kind.isin(0, 2), 0).otherwise((key * 131) % 3000)
    size = cleanup + refinement + F.when(key % 11 == 0, 1).otherwise(0)
    return t.load(spark, sf, "events").select(
        key.alias("job"), packets.length_bits(F.lit(3), passes).cast("bigint").alias("length_bits"), packets.cleanup_length_bits(F.lit(3), passes).cast("bigint").alias("cleanup_bits"),
        packets.fits_bits(key % 70, passes).alias("fits"), packets.segment_error(passes, size, cleanup, refinement).alias("error"))


@query("""select image_id, least(floor(log2(least(w, h)))::bigint, case when a is not null then case when least(w, h) < 64 then 0 else a end
    when p then case when least(w, h) <= 64 then 0 else ceil(log2(least(w, h) / 64))::bigint end else case when least(w, h) >= 64 then 1 else 0 end end)::bigint as levels,
  case when greatest(we, he) > 10 then 'side_too_large' when least(we, he) < 2 then 'side_too_small' when we + he > 12 then 'area_too_large' end as block_error,
  ceil(w * h * 0.75 / 8)::bigint as target, greatest((ceil(w * h * 0.75 / 8)::bigint + 99) // 100, 512)::bigint as tolerance
from (select image_id, grid_w // (1 + image_id % 3) as w, grid_h // (1 + image_id % 2) as h, image_id % 2 = 0 as p, case when image_id % 4 = 0 then image_id % 13 end as a, image_id % 13 as we, image_id % 11 as he from siz)""", "siz")
def encoder_rules(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("image_id")
    w, h = F.call_function("div", F.col("grid_w"), 1 + i % 3), F.call_function("div", F.col("grid_h"), 1 + i % 2)
    target = packets.byte_target(w, h, F.lit(0.75))
    levels = packets.lossless_levels(w, h, i % 2 == 0, F.when(i % 4 == 0, i % 13))
    return t.siz(spark, sf).select(i, levels.cast("bigint").alias("levels"), packets.block_error(i % 13, i % 11).alias("block_error"), target.alias("target"), packets.byte_tolerance(target).alias("tolerance"))


# pixels, windows and small decoder rules

PLANES = "u as (select vec_id, i, greatest(0, least(255, v + 128)) as u from px), p as (select vec_id, 0 as c, i, u as v from u union all select vec_id, 1, 63 - i, u from u union all select vec_id, 2, i, 255 - u from u)"


def _pixels(spark: SparkSession, sf: str) -> DataFrame:
    u = F.transform("s", lambda v: clamp(v + 128, 0, 255))
    return t.line(spark, sf).select("vec_id", packing.interleave(F.array(u, F.reverse(u), F.transform(u, lambda v: 255 - v))).alias("pixels"))


@query(f"+ {PLANES}, q as (select * from p union all select vec_id, 3, i, 255 from u) select vec_id, (((i // 8 - 1) * 4 + i % 8 - 2) * 4 + c)::int as place, v::bigint as v from q where i % 8 between 2 and 5 and i // 8 between 1 and 4", "px")
def pixel_region(spark: SparkSession, sf: str) -> DataFrame:
    """A region of pixels with an opaque fourth channel."""
    cut = packing.region(packing.add_alpha(F.col("pixels")), 4, 8, 2, 1, 6, 5)
    return _pixels(spark, sf).select("vec_id", F.posexplode(cut).alias("place", "v"))


@query(f"+ {PLANES} select vec_id, c::int as channel, i::int as place, (v - 128)::bigint as v from p", "px")
def pixel_planes(spark: SparkSession, sf: str) -> DataFrame:
    """Centred planes of pixels that had and lost an alpha channel."""
    planes = packing.deinterleave(packing.drop_alpha(packing.add_alpha(F.col("pixels"))), 3, 8)
    d = _pixels(spark, sf).select("vec_id", F.posexplode(planes).alias("channel", "plane"))
    return d.select("vec_id", "channel", F.posexplode("plane").alias("place", "v"))


@query("+ l as (select vec_id, s from line) select vec_id, (i // 8 * 11 + i % 8)::int as place, s[i + 1] as v from (select *, unnest(range(64)) as i from l) union all select vec_id, (y * 11 + 8 + x)::int, 0::bigint from l, range(7) a(y), range(3) b(x)", "line")
def strided_rows(spark: SparkSession, sf: str) -> DataFrame:
    return t.line(spark, sf).select("vec_id", F.posexplode(packing.strided(F.col("s"), 8, 11)).alias("place", "v"))


@query("""+ w as (select image_id, min(x) as x0, min(y) as y0, max(x + w) as x1, max(y + h) as y1 from roi where w > 0 and h > 0 group by image_id),
 b as (select image_id, gx * 64 as x0, gy * 64 as y0, least(gx * 64 + 64, grid_w) as x1, least(gy * 64 + 64, grid_h) as y1 from (select *, unnest(range(down)) as gy from (select *, unnest(range(ceil(grid_w / 64)::bigint)) as gx, ceil(grid_h / 64)::bigint as down from siz)))
 select image_id, count(*) as blocks, min(b.x0) as x0, min(b.y0) as y0, max(b.x1) as x1, max(b.y1) as y1 from b join w using (image_id) where b.x0 < w.x1 and w.x0 < b.x1 and b.y0 < w.y1 and w.y0 < b.y1 group by image_id""", "roi", "siz")
def roi_block_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The blocks of an image that the rectangle around its regions needs."""
    regions = t.roi(spark, sf).select("image_id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    needed = grids.block_ranges(t.siz(spark, sf), grids.window_union(regions, "image_id"))
    return needed.groupBy("image_id").agg(F.sum("blocks").alias("blocks"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


@query("""select event_id as job, d::bigint as denominator, (8 // d)::bigint as block_side, (case when event_id % 6 <= 1 then 1 else least(greatest(coalesce(case when event_id % 3 = 0 then event_id % 7 end, 4), 1), event_id % 6) end)::bigint as workers,
  case when event_id % 30 + event_id % 11 <= 31 then event_id % 30 + event_id % 11 end as bitplanes, case when event_id % 11 > 0 and abs(k) >= (1::bigint << (event_id % 11)) then sign(k)::bigint * (abs(k) >> (event_id % 11)) else k end as unshifted,
  round(event_id * 8.0::double / (16 * (1 + event_id % 9)), 6) as bpp, 16 * (1 + event_id % 9) * (1 + event_id % 4) as samples
from (select event_id, (event_id * 37) % 5001 - 2500 as k, [1, 2, 4, 8][1 + event_id % 4] as d from events)""")
def decoder_rules(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    scale = F.when(k % 4 == 0, "none").when(k % 4 == 1, "half").when(k % 4 == 2, "quarter").otherwise("eighth")
    return t.load(spark, sf, "events").select(
        k.alias("job"), big(packets.scale_denominator(scale)).alias("denominator"), packets.scaled_block_size(scale).alias("block_side"), big(packets.worker_count(k % 6, F.when(k % 3 == 0, k % 7), big(4))).alias("workers"),
        packets.roi_bitplanes(k % 30, k % 11, F.lit(31)).alias("bitplanes"), packets.roi_unshift((k * 37) % 5001 - 2500, k % 11).alias("unshifted"),
        fixed(packets.bits_per_pixel(k, big(16), 1 + k % 9)).alias("bpp"), packets.samples_per_image(big(16), 1 + k % 9, 1 + k % 4).alias("samples"))


@query("""+ a as (select p_partkey as id, p_partkey % 4 as res, ['LL', 'HL', 'LH', 'HH'][1 + (p_partkey // 4) % 4] as band, p_partkey % 3 as style, 1 + p_partkey % 10 as n, p_partkey % 7 as e0 from part),
 b as (select *, case when style = 2 or res = 0 then 0 when band = 'LL' then -1 else 1 + (res - 1) * 3 + case band when 'HL' then 0 when 'LH' then 1 else 2 end end as place from a),
 c as (select *, case when place < 0 or place >= n then 'missing_step' when style = 2 and e0 < 3 then 'invalid_exponents' end as error from b)
 select id, case when error is null then case when style = 2 then e0 - 3 + case when res = 0 then 3 else 4 - res end else e0 + place end end::bigint as exponent, case when error is null then place * 5 end::bigint as mantissa, error from c""")
def step_lookup(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    steps = F.transform(F.sequence(big(0), k % 10), lambda i: F.struct((k % 7 + i).alias("exponent"), (i * 5).alias("mantissa")))
    band = F.element_at(F.array(*map(F.lit, ("LL", "HL", "LH", "HH"))), (1 + F.call_function("div", k, big(4)) % 4).cast("int"))
    style = F.when(k % 3 == 0, "none").when(k % 3 == 1, "expounded").otherwise("derived")
    d = t.load(spark, sf, "part").select(k.alias("id"), packets.step_entry(style, steps, band, k % 4, big(3)).alias("e"))
    return d.select("id", "e.exponent", "e.mantissa", "e.error")
