"""A query per operator on the driver's tables, with the same in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import scale as S
from ..functions import stats
from ..functions.wcs import cutout_header, pix_to_sky, sky_to_pix
from ..operators import batches as B
from ..operators import catalog as C
from ..operators import chunks as K
from ..operators import detect, gates, losses, metrics, mosaic, pairs, profiles, widths
from ..operators.tiles import assemble_tiles, blur_tiles, chunked, dataset_stats, explode_tiles, freq_split_tiles, tile_quantiles, with_dataset_stats, with_tile_columns
from ..sources import images
from ..sources import tables as sinks
from ..sources.shared import stored
from ..streaming import jobs
from . import fixtures as X
from . import preprocess as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# SQL stand-ins, as in fixtures.
PX = "e AS (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS i FROM embeddings), px AS (SELECT vec_id AS idx, label, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x, CAST(embedding[i] AS DOUBLE) AS v FROM e)"
LR = PX + ", lr AS (SELECT idx, label, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, v FROM px WHERE y % 2 = 0 AND x % 2 = 0)"
PAIR = LR + ", lim AS (SELECT idx AS li, 1.5 * stddev_pop(v) AS lim FROM px GROUP BY idx), pr AS (SELECT px.idx, px.label, px.y, px.x, px.v AS r, lr.v AS f, CAST(px.v > lim AS INT) AS m FROM px JOIN lr ON px.idx = lr.idx AND px.y // 2 = lr.y AND px.x // 2 = lr.x JOIN lim ON px.idx = li)"
MLR = "mlr AS (SELECT CAST(o_orderkey // 100 AS INT) AS y, CAST(o_orderkey % 100 AS INT) AS x, o_totalprice AS v FROM orders)"
MHR = "mhr AS (SELECT CAST(2 * (l_orderkey // 100) + (l_linenumber - 1) % 4 // 2 AS INT) AS y, CAST(2 * (l_orderkey % 100) + (l_linenumber - 1) % 2 AS INT) AS x, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2)"
MASK = f"{MLR}, {MHR}, lit AS (SELECT DISTINCT CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x FROM mhr WHERE v != 0), mask AS (SELECT mlr.y, mlr.x, lit.y IS NOT NULL AS valid FROM mlr LEFT JOIN lit USING (y, x))"
CENTERS = MASK + ", ok AS (SELECT a.y, a.x FROM mask a JOIN mask b ON b.valid AND b.y BETWEEN a.y - 2 AND a.y + 1 AND b.x BETWEEN a.x - 2 AND a.x + 1 GROUP BY 1, 2 HAVING count(*) = 16)"
METRIC = "metric AS (SELECT 'run' AS run_id, event_id AS step, CASE WHEN user_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, event_type AS metric, value, ts FROM events)"
CATALOG = "cat AS (SELECT l_partkey AS object_id, l_returnflag AS source, l_linestatus AS mode, sum(l_extendedprice) / sum(l_quantity) AS measured FROM lineitem GROUP BY 1, 2, 3), pc AS (SELECT cat.*, p_retailprice AS truth FROM cat JOIN part ON object_id = p_partkey)"


def hashed(*parts: str) -> str:
    text = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def tiles_of(name: str, sql: str, digits: int = 6) -> Callable[[Callable[[DataFrame], DataFrame]], None]:
    """A query of tiles (idx, w, pixels) by pixel. The SQL is CTEs that end in out(idx, y, x, v)."""

    def register(f: Callable[[DataFrame], DataFrame]) -> None:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            made = f(X.tiles(spark, sf_dir))
            return explode_tiles(made.select("idx", "w", "pixels")).select("idx", "y", "x", F.round("v", digits).alias("v"))

        QUERIES[name] = run
        ORACLES[name] = f"WITH {sql} SELECT idx, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(v, {digits}) AS v FROM out"

    return register


def per_pixel(name: str, f: Callable[[Column], Column], sql: str, digits: int = 6) -> None:
    tiles_of(name, f"{PX}, out AS (SELECT idx, y, x, {sql} AS v FROM px)", digits)(lambda t: t.withColumn("pixels", S.on_pixels("pixels", f)))


# ---- scalar functions of pixels
per_pixel("f1_sigmoid", S.sigmoid, "1 / (1 + exp(-v))")
per_pixel("f2_sigmoid_symmetric", S.sigmoid_symmetric, "2 * (1 / (1 + exp(-v)) - 0.5)")
per_pixel("f3_scale_prod", lambda v: S.scale(v, 2.5, "prod"), "2.5 * v")
per_pixel("f3_scale_div", lambda v: S.scale(v, 0.25, "div"), "0.25 / nullif(v, 0)", 3)
per_pixel("f4_sigmoid_rms", lambda v: S.sigmoid_rms(S.clamp(v, 0.001, 1), 0.05), "1 / (1 + exp(-0.05 / least(greatest(v, 0.001), 1)))")
per_pixel("f4_sigmoid_rms_documented", lambda v: S.sigmoid_rms(v, 0.05, as_documented=True), "1 / (1 + exp(-v / 0.05))")
per_pixel("f8_min_max", lambda v: S.min_max(v, -0.1, 0.2), "(least(greatest(v, -0.1), 0.2) - -0.1) / (0.2 - -0.1)")
per_pixel("f9_min_max_inverse", lambda v: S.min_max_inverse(v, -3.0, 5.0), "v * (5.0 - -3.0) + -3.0")
per_pixel("f10_ds9_scale", lambda v: S.ds9_scale(F.abs(v), 1000.0, 1.0), "log10(abs(v) * 1000 + 1) / log10(1001) - 1")
per_pixel("f11_ds9_unscale", lambda v: S.ds9_unscale(v, 1000.0, 1.0), "(pow(1001.0, v + 1) - 1) / 1000")
per_pixel("f24_unit_range", S.unit_range, "(v + 1) / 2")
per_pixel("f25_display_norm", lambda v: S.display_norm(v, -0.3, 0.3, "asinh"), "asinh((least(greatest(v, -0.3), 0.3) + 0.3) / 0.6 / 0.1) / asinh(10.0)")
per_pixel("a13_bce_logit", lambda v: S.bce_with_logits(v, 1.0), "greatest(v, 0) - v + ln(1 + exp(-abs(v)))")


@query("f28_casts", f"WITH {PX} SELECT idx, y, x, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 6) AS as_float, CAST(v > 0 AS INT) AS as_mask FROM px")
def _(spark: SparkSession, d: str) -> DataFrame:
    px = explode_tiles(X.tiles(spark, d).select("idx", "w", "pixels"))
    return px.select("idx", "y", "x", F.round(F.col("v").cast("float").cast("double"), 6).alias("as_float"), (F.col("v") > 0).cast("tinyint").cast("int").alias("as_mask"))


@tiles_of("f5_log_scale", f"{PX}, lo AS (SELECT idx, min(v) AS lo FROM px GROUP BY idx), out AS (SELECT idx, y, x, log10(v + abs(lo) + 1e-6) AS v FROM px JOIN lo USING (idx))", 4)
def _(t: DataFrame) -> DataFrame:
    return t.withColumn("pixels", A.bound(F.array_min("pixels"), lambda lo: F.transform("pixels", lambda v: S.log_scale(v, lo))))


@tiles_of("f6_median_scale", f"{PX}, s AS (SELECT idx, median(v) AS m, stddev_pop(v) AS s FROM px GROUP BY idx), out AS (SELECT idx, y, x, (v - m) / nullif(s, 0) AS v FROM px JOIN s USING (idx))")
def _(t: DataFrame) -> DataFrame:
    return P.scale_tiles(t, "median_scale", out="pixels")


@tiles_of("f7_global_median_scale", f"{PX}, s AS (SELECT label, median(v) AS m, stddev_pop(v) AS s FROM px GROUP BY label), out AS (SELECT idx, y, x, (v - m) / nullif(s, 0) AS v FROM px JOIN s USING (label))")
def _(t: DataFrame) -> DataFrame:
    held = with_dataset_stats(t, dataset_stats(t, ["label"]), ["label"])
    return P.scale_tiles(held, "global_median_scale", out="pixels")


for _use in (False, True):
    _lo = "greatest(avg(v) - 3 * stddev_pop(v), min(v))" if _use else "0.0"
    tiles_of(f"f12_clip_{'data' if _use else 'zero'}", f"{PX}, s AS (SELECT idx, {_lo} AS lo, quantile_cont(v, 0.99999) AS hi FROM px GROUP BY idx), out AS (SELECT idx, y, x, least(greatest(v, lo), hi) AS v FROM px JOIN s USING (idx))")(lambda t, use=_use: t.withColumn("pixels", P.clipped("pixels", use)))

_KINDS_SQL = {
    "sigmoid": "2 * (1 / (1 + exp(-v)) - 0.5)",
    "log_scale": "log10(v + abs(lo) + 1e-6)",
    "median_scale": "(v - tm) / nullif(ts, 0)",
    "global_median_scale": "(v - m) / nullif(s, 0)",
    "clip_min_max_norm": "(v - lo) / (hi - lo)",
    "hst_downscale": "v",
    "paired_image_translation": "2 * ((v - lo) / (hi - lo)) - 1",
    "ds9_scale": "CASE WHEN v > -0.001 THEN log10(v * 1000 + 1) / log10(1001) - 1 END",
    "sigmoid_rms": "1 / (1 + exp(-least(greatest(s / nullif(v, 0), -600), 600)))",
}


@query(
    "f13_scale_tiles",
    f"WITH {PX}, g AS (SELECT label, min(v) AS lo, max(v) AS hi, median(v) AS m, stddev_pop(v) AS s FROM px GROUP BY label), t AS (SELECT idx, median(v) AS tm, stddev_pop(v) AS ts FROM px GROUP BY idx), j AS (SELECT * FROM px JOIN g USING (label) JOIN t USING (idx)) "
    + " UNION ALL ".join(f"SELECT '{k}' AS kind, idx, y, x, round({'CASE WHEN v + abs(lo) + 1e-6 > 0 THEN ' + e + ' END' if k == 'log_scale' else e}, 4) AS scaled FROM j" for k, e in _KINDS_SQL.items()),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    t = X.tiles(spark, d)
    t = with_dataset_stats(t, dataset_stats(t, ["label"]), ["label"]).withColumn("hr_lowest", F.col("lowest"))
    each = F.array(*(F.struct(F.lit(k).alias("kind"), P.SCALINGS[k]("pixels").alias("p")) for k in _KINDS_SQL))
    made = t.select("idx", "w", F.explode(each).alias("e")).select("idx", "w", "e.kind", F.col("e.p").alias("pixels"))
    return explode_tiles(made).select("kind", "idx", "y", "x", F.round("v", 4).alias("scaled"))


# ---- geometry
@tiles_of("f14_vflip", f"{PX}, out AS (SELECT idx, 7 - y AS y, x, v FROM px)")
def _(t: DataFrame) -> DataFrame:
    return t.withColumn("pixels", A.vflip("pixels", 8, 8))


@tiles_of("f14_hflip", f"{PX}, out AS (SELECT idx, y, 7 - x AS x, v FROM px)")
def _(t: DataFrame) -> DataFrame:
    return t.withColumn("pixels", A.hflip("pixels", 8, 8))


@tiles_of("f15_center_crop", f"{PX}, out AS (SELECT idx, y - 2 AS y, x - 1 AS x, v FROM px WHERE y BETWEEN 2 AND 6 AND x BETWEEN 1 AND 6)")
def _(t: DataFrame) -> DataFrame:
    return t.withColumn("pixels", A.center_crop("pixels", 8, 8, 5, 6)).withColumn("w", F.lit(6))


@tiles_of("f15_center_crop_padded", f"{PX}, g AS (SELECT a.i AS ty, b.i AS tx FROM range(11) a(i), range(6) b(i)), out AS (SELECT t.idx, ty AS y, tx AS x, coalesce(px.v, 0) AS v FROM (SELECT DISTINCT idx FROM px) t CROSS JOIN g LEFT JOIN px ON px.idx = t.idx AND px.y = ty - 1 AND px.x = tx + 1)")
def _(t: DataFrame) -> DataFrame:
    return t.withColumn("pixels", A.center_crop("pixels", 8, 8, 11, 6)).withColumn("w", F.lit(6))


_REFLECT = "CASE WHEN {0} < 3 THEN 3 - {0} WHEN {0} >= 11 THEN 17 - {0} ELSE {0} - 3 END"


@tiles_of("f16_reflect_pad", f"{PX}, g AS (SELECT a.i AS ty, b.i AS tx FROM range(14) a(i), range(14) b(i)), out AS (SELECT idx, ty AS y, tx AS x, v FROM px JOIN g ON y = {_REFLECT.format('ty')} AND x = {_REFLECT.format('tx')})")
def _(t: DataFrame) -> DataFrame:
    return t.withColumn("pixels", A.reflect_pad("pixels", 8, 8, 3)).withColumn("w", F.lit(14))


@tiles_of("f17_resize_nearest", f"{PX}, g AS (SELECT a.i AS ty, b.i AS tx FROM range(16) a(i), range(16) b(i)), out AS (SELECT idx, ty AS y, tx AS x, v FROM px JOIN g ON y = ty // 2 AND x = tx // 2)")
def _(t: DataFrame) -> DataFrame:
    return t.withColumn("pixels", A.resize_nearest("pixels", 8, 8, 16, 16)).withColumn("w", F.lit(16))


@tiles_of(
    "f18_resize_bilinear",
    f"{PX}, t AS (SELECT i, greatest((i + 0.5) * 8 / 12.0 - 0.5, 0) AS s FROM range(12) r(i)), u AS (SELECT i, floor(s) AS lo, least(floor(s) + 1, 7) AS hi, s - floor(s) AS f FROM t), "
    "out AS (SELECT a.idx, r.i AS y, c.i AS x, (a.v * (1 - c.f) + b.v * c.f) * (1 - r.f) + (p.v * (1 - c.f) + q.v * c.f) * r.f AS v FROM u r, u c "
    "JOIN px a ON a.y = r.lo AND a.x = c.lo JOIN px b ON b.idx = a.idx AND b.y = r.lo AND b.x = c.hi JOIN px p ON p.idx = a.idx AND p.y = r.hi AND p.x = c.lo JOIN px q ON q.idx = a.idx AND q.y = r.hi AND q.x = c.hi)",
)
def _(t: DataFrame) -> DataFrame:
    return t.withColumn("pixels", A.resize_bilinear("pixels", 8, 8, 12, 12)).withColumn("w", F.lit(12))


@tiles_of("f19_resize_area", f"{PX}, out AS (SELECT idx, y // 2 AS y, x // 2 AS x, sum(v) / 4 AS v FROM px GROUP BY 1, 2, 3)")
def _(t: DataFrame) -> DataFrame:
    return t.withColumn("pixels", A.resize("pixels", 8, 8, 4, "area")).withColumn("w", F.lit(4))


def _blur_sql(sigma: float, mode: str) -> str:
    taps = ", ".join(f"({i - len(w) // 2}, {t!r})" for w in [A.gaussian_taps(sigma)] for i, t in enumerate(w))
    at = {"symmetric": "least(((c + d) % 16 + 16) % 16, 15 - ((c + d) % 16 + 16) % 16)", "nearest": "least(greatest(c + d, 0), 7)"}[mode]
    tap = f"tap AS (SELECT c, {at} AS src, sum(t) AS t FROM range(8) r(c), (VALUES {taps}) k(d, t) GROUP BY 1, 2)"
    return f"{tap}, br AS (SELECT idx, y, c AS x, sum(v * t) AS v FROM px JOIN tap ON x = src GROUP BY 1, 2, 3), blur AS (SELECT idx, c AS y, x, sum(v * t) AS v FROM br JOIN tap ON y = src GROUP BY 1, 2, 3)"


@tiles_of("w2_gaussian_blur", f"{PX}, {_blur_sql(1.0, 'symmetric')}, out AS (SELECT * FROM blur)")
def _(t: DataFrame) -> DataFrame:
    return blur_tiles(t, 1.0)


@tiles_of("w2_gaussian_blur_column", f"{PX}, {_blur_sql(1.0, 'symmetric')}, out AS (SELECT * FROM blur)")
def _(t: DataFrame) -> DataFrame:
    return t.withColumn("pixels", A.gaussian_blur("pixels", 8, 8, 1.0))


@tiles_of("w3_decimate", f"{PX}, {_blur_sql(1.0, 'symmetric')}, out AS (SELECT idx, y // 3 AS y, x // 3 AS x, v FROM blur WHERE y % 3 = 0 AND x % 3 = 0)")
def _(t: DataFrame) -> DataFrame:
    return blur_tiles(t, 1.0).withColumn("pixels", A.decimate("pixels", 8, 8, 3)).withColumn("w", F.lit(3))


@query(
    "f20_freq_split",
    f"WITH {PX}, {_blur_sql(2.0, 'nearest')}, s AS (SELECT idx, min(v) AS lo, max(v) AS hi FROM px GROUP BY idx), b AS (SELECT idx, min(v) AS bl, max(v) AS bh FROM blur GROUP BY idx), "
    "low AS (SELECT idx, y, x, lo + (blur.v - bl) / nullif(bh - bl, 0) * (hi - lo) AS low FROM blur JOIN s USING (idx) JOIN b USING (idx)), hf AS (SELECT px.idx, px.y, px.x, low, px.v - low AS h FROM px JOIN low USING (idx, y, x)), m AS (SELECT idx, max(abs(h)) AS m FROM hf GROUP BY idx) "
    "SELECT idx, y, x, round(low, 6) AS low, round(h / nullif(m, 0), 6) AS high FROM hf JOIN m USING (idx)",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    t = freq_split_tiles(X.tiles(spark, d), 2.0)
    both = F.zip_with("low", "high", lambda low, high: F.struct(low.alias("low"), high.alias("high")))
    return explode_tiles(t.select("idx", "w", both.alias("pixels"))).select("idx", "y", "x", F.round("v.low", 6).alias("low"), F.round("v.high", 6).alias("high"))


@query("f24_rgb_normalised", f"WITH {PX}, c(channel, m, s) AS (VALUES (0, 0.485, 0.229), (1, 0.456, 0.224), (2, 0.406, 0.225)) SELECT idx, channel, round(avg(((v + 1) / 2 - m) / s), 6) AS mean_value FROM px, c GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    made = X.tiles(spark, d).select("idx", F.posexplode(S.rgb_normalised("pixels")).alias("channel", "p"))
    return made.select("idx", "channel", F.round(stats.mean("p"), 6).alias("mean_value"))


# ---- statistics and gates
@query("a1_a8_tile_stats", f"WITH {PX} SELECT idx, round(sum(v), 6) AS pix_sum, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS lowest, round(max(v), 6) AS highest, round(quantile_cont(v, 0.99999), 6) AS p99999, round(median(v), 6) AS median, round(max(abs(v)), 6) AS max_abs, bool_or(isnan(v) OR isinf(v)) AS any_bad FROM px GROUP BY idx")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c, n: F.round(c, 6).alias(n)
    return X.tiles(spark, d).select(
        "idx", r(stats.pixel_sum("pixels"), "pix_sum"), r(stats.mean("pixels"), "mean"), r(stats.spread("pixels"), "std"), r(F.array_min("pixels"), "lowest"), r(F.array_max("pixels"), "highest"),
        r(stats.percentile("pixels", 0.99999), "p99999"), r(stats.median("pixels"), "median"), r(stats.max_abs("pixels"), "max_abs"), stats.any_bad("pixels").alias("any_bad"),
    )


@query("a3_tile_quantiles", f"WITH {PX} SELECT idx, round(quantile_cont(v, 0.25), 6) AS q25, round(median(v), 6) AS q50, round(quantile_cont(v, 0.99999), 6) AS p99999 FROM px GROUP BY idx")
def _(spark: SparkSession, d: str) -> DataFrame:
    q = tile_quantiles(X.tiles(spark, d), [0.25, 0.5, 0.99999])
    return q.select("idx", *(F.round(F.get("quantiles", F.lit(i)), 6).alias(n) for i, n in enumerate(("q25", "q50", "p99999"))))


@query("a5_dataset_stats", f"WITH {PX} SELECT label, round(min(v), 6) AS lowest, round(max(v), 6) AS highest, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS std FROM px GROUP BY label")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = dataset_stats(X.tiles(spark, d), ["label"])
    return s.select("label", *(F.round(c, 6).alias(c) for c in ("lowest", "highest", "median", "std")))


_BAD_PX = f"{PX}, bad AS (SELECT idx % 3 AS g, v, idx % 10 IN (1, 2) AND y = 7 AND x = 7 AS bad FROM px WHERE idx % 10 NOT IN (3, 4))"


@query("a5_dataset_stats_bad", f"WITH {_BAD_PX} SELECT g, round(min(v) FILTER (NOT bad), 6) AS lowest, round(max(v) FILTER (NOT bad), 6) AS highest, round(median(v) FILTER (NOT bad), 6) AS median, round(stddev_pop(v) FILTER (NOT bad), 6) AS std, count(*) FILTER (bad) AS n_bad FROM bad GROUP BY g")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Tiles with NaN and infinite pixels, short ones and NULLs: finite pixels of whole tiles count."""
    t = bad_tiles(spark, d).select((F.col("idx") % 3).alias("g"), F.col("hr_h").alias("h"), F.col("hr_w").alias("w"), F.col("hr").alias("pixels"))
    return dataset_stats(t, ["g"]).select("g", *(F.round(c, 6).alias(c) for c in ("lowest", "highest", "median", "std")), "n_bad")


@query("p1_filter_log_sum", f"WITH {PX} SELECT idx, round(sum(v), 6) AS pix_sum FROM px GROUP BY idx HAVING sum(v) > exp(-1) AND sum(v) < exp(1)")
def _(spark: SparkSession, d: str) -> DataFrame:
    kept = gates.filter_log_sum(X.tiles(spark, d), "pixels", -1.0, 1.0)
    return kept.select("idx", F.round(stats.pixel_sum("pixels"), 6).alias("pix_sum"))


def bad_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles with a NaN, an infinity, a short array, NULL or a transposed 4 by 16 shape by idx % 10, as hr; whole ones as lr, lr_up and mask."""
    t = X.tiles(spark, d)
    spoil = lambda v: F.concat(F.slice("pixels", 1, 63), F.array(F.lit(float(v))))
    k = F.col("idx") % 10
    hr = F.when(k == 1, spoil("nan")).when(k == 2, spoil("inf")).when(k == 3, F.slice("pixels", 1, 60)).when(k != 4, F.col("pixels"))
    out = t.select("idx", hr.alias("hr"), F.col("pixels").alias("lr"), F.col("pixels").alias("lr_up"), F.col("pixels").alias("mask"), "h", "w")
    for c in ("hr", "lr", "lr_up"):
        odd = (F.col("idx") % 10 == 5) if c == "hr" else F.lit(False)
        out = out.withColumn(f"{c}_h", F.when(odd, 4).otherwise(F.col("h"))).withColumn(f"{c}_w", F.when(odd, 16).otherwise(F.col("w")))
    return out.drop("h", "w")


_SHAPES = {"hr": (8, 8), "lr": (8, 8), "lr_up": (8, 8)}


@query("p2_filter_finite", "SELECT vec_id AS idx FROM embeddings WHERE vec_id % 10 NOT IN (1, 2, 4)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return gates.filter_finite(gates.drop_corrupt(bad_tiles(spark, d), ["hr"]), ["hr", "lr"]).select("idx")


@query("p3_filter_shape", "SELECT vec_id AS idx FROM embeddings WHERE vec_id % 10 NOT IN (3, 4, 5)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return gates.filter_shape(bad_tiles(spark, d), _SHAPES).select("idx")


@query("p4_drop_corrupt", "SELECT vec_id AS idx, vec_id % 10 = 4 AS quarantined FROM embeddings")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = bad_tiles(spark, d)
    good = gates.drop_corrupt(t, ["hr", "lr"]).select("idx", F.lit(False).alias("quarantined"))
    return good.unionByName(gates.quarantine(t, ["hr", "lr"]).select("idx", F.lit(True).alias("quarantined")))


@query("p5_ratio_violations", "SELECT vec_id AS idx FROM embeddings WHERE vec_id % 7 = 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    sized = X.tiles(spark, d).withColumn("lh", F.when(F.col("idx") % 7 == 0, 3).otherwise(4)).withColumn("lw", F.lit(4))
    return gates.ratio_violations(sized, 2, ("h", "w"), ("lh", "lw")).select("idx")


@query("p5_assert_ratio", "SELECT vec_id AS idx FROM embeddings")
def _(spark: SparkSession, d: str) -> DataFrame:
    sized = X.tiles(spark, d).withColumn("lh", F.lit(4)).withColumn("lw", F.when(F.col("idx") % 7 == 0, None).otherwise(4))
    return gates.assert_ratio(sized, 2, ("h", "w"), ("lh", "lw")).select("idx")


@query("u2_batch_hook", "SELECT vec_id AS idx, CAST(vec_id // 8 AS BIGINT) AS batch_id, count(*) OVER (PARTITION BY vec_id // 8) AS size FROM embeddings WHERE vec_id % 10 != 4")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A user's batch function instead of the checks: only missing tiles go, and each row knows its batch's size."""

    def hook(batch: DataFrame) -> DataFrame:
        return batch.filter("hr is not null").withColumn("size", F.count("*").over(Window.partitionBy("batch_id")))

    return P.collate(bad_tiles(spark, d), 8, _SHAPES, hook=hook).select("idx", "batch_id", "size")


@query("p1_filter_log_sum_defaults", f"WITH {PX} SELECT idx, round(sum(50 * abs(v)), 4) AS pix_sum FROM px GROUP BY idx HAVING sum(50 * abs(v)) > exp(2) AND sum(50 * abs(v)) < exp(7)")
def _(spark: SparkSession, d: str) -> DataFrame:
    bright = X.tiles(spark, d).withColumn("pixels", F.transform("pixels", lambda v: F.abs(v) * 50))
    return gates.filter_log_sum(bright).select("idx", F.round(stats.pixel_sum("pixels"), 4).alias("pix_sum"))


@query("p6_collate", "SELECT vec_id AS idx, CAST(vec_id // 8 AS BIGINT) AS batch_id FROM embeddings WHERE vec_id % 10 NOT IN (1, 2, 3, 4, 5)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return P.collate(bad_tiles(spark, d), 8, _SHAPES).select("idx", "batch_id")


@query("x3_batch_refilled", "SELECT vec_id AS idx, CAST((row_number() OVER (ORDER BY vec_id) - 1) // 8 AS BIGINT) AS batch_id FROM embeddings WHERE vec_id % 10 NOT IN (1, 2, 3, 4, 5)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return P.collate(bad_tiles(spark, d), 8, _SHAPES, refill=True).select("idx", "batch_id")


@query("p7_quality_report", "SELECT CASE WHEN vec_id % 10 = 4 THEN 'corrupt' WHEN vec_id % 10 IN (1, 2) THEN 'not finite' WHEN vec_id % 10 IN (3, 5) THEN 'shape' ELSE 'good' END AS reason, count(*) AS n FROM embeddings GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return gates.quality_report(bad_tiles(spark, d), gates.reject_reason("hr", "lr", ["lr_up", "mask"], _SHAPES))


# ---- pairs
def _names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs, labels = X.table(spark, d, "documents"), X.table(spark, d, "labels")
    return docs.select(F.col("doc_id").alias("name"), "n_chars"), labels.select(F.col("doc_id").alias("name"), "quality")


@query("j1_pair_by_name", "SELECT doc_id AS name, n_chars, quality FROM documents JOIN labels USING (doc_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return pairs.pair_by_name(*_names(spark, d))


@query("j2_unpaired", "SELECT doc_id AS name, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return pairs.unpaired(*_names(spark, d))


@query("j7_f26_residual", f"WITH {PAIR} SELECT idx, y, x, round(f - r, 6) AS v FROM pr")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = X.tiles(spark, d)
    p = pairs.pair_truth_pred(t, X.pred_tiles(t)).select("idx", F.lit(8).alias("w"), pairs.residual("real", "fake").alias("pixels"))
    return explode_tiles(p).select("idx", "y", "x", F.round("v", 6).alias("v"))


@query("j8_masked_pair", f"WITH {PAIR} SELECT idx, CAST(sum(m) AS BIGINT) AS n_masked, round(sum(r * m), 6) AS masked_sum FROM pr GROUP BY idx")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = X.tiles(spark, d)
    p = pairs.masked_pair(pairs.pair_truth_pred(t, X.pred_tiles(t)), X.masks(t))
    lit = F.zip_with("real", "mask", lambda r, m: r * m.cast("double"))
    return p.select("idx", F.size(F.filter("mask", lambda m: m > 0)).cast("bigint").alias("n_masked"), F.round(stats.pixel_sum(lit), 6).alias("masked_sum"))


@query("j10_pair_val_batches", f"WITH {METRIC}, t AS (SELECT step, row_number() OVER (ORDER BY step) - 1 AS o FROM metric WHERE split = 'train'), v AS (SELECT step AS val_step, row_number() OVER (ORDER BY step) - 1 AS o FROM metric WHERE split = 'val') SELECT t.step, v.val_step FROM t JOIN v ON t.o % (SELECT count(*) FROM v) = v.o")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = X.metrics(spark, d)
    side = lambda s: B.number_rows(m.filter(F.col("split") == s).select("step"), ["step"])
    val = side("val").withColumnRenamed("step", "val_step")
    return pairs.pair_val_batches(side("train"), val, max(val.count(), 1)).select("step", "val_step")


# ---- losses
@query("a10_a12_a19_pair_losses", f"WITH {PAIR} SELECT label, round(avg(abs(r - f)), 6) AS l1, round(sum(abs(r - f) * m) / nullif(sum(m), 0), 6) AS masked_l1, round(sum((r - f) * (r - f) * m) / nullif(sum(m), 0), 6) AS masked_l2, round(sum(abs(r - f) * m) / nullif(sum(m), 0) / avg(abs(r - f)), 5) AS loss_ratio FROM pr GROUP BY label")
def _(spark: SparkSession, d: str) -> DataFrame:
    out = losses.validate(X.pairs(X.tiles(spark, d)), ["label"])
    return out.select("label", F.round("l1", 6).alias("l1"), F.round("masked_l1", 6).alias("masked_l1"), F.round("masked_l2", 6).alias("masked_l2"), F.round("loss_ratio", 5).alias("loss_ratio"))


_BCE = "greatest(v, 0) - v * {0} + ln(1 + exp(-abs(v)))"


@query("a13_bce_with_logits", f"WITH {PX} SELECT label, round(avg({_BCE.format('1.0')}), 6) AS bce FROM px GROUP BY label")
def _(spark: SparkSession, d: str) -> DataFrame:
    return losses.bce_mean(X.tiles(spark, d), 1.0, ["label"]).select("label", F.round("bce", 6).alias("bce"))


@query("a14_disc_loss", f"WITH {PX} SELECT label, round(avg({_BCE.format('1.0')}) FILTER (idx % 2 = 1) + avg({_BCE.format('0.0')}) FILTER (idx % 2 = 0), 6) AS disc_loss FROM px GROUP BY label")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = X.tiles(spark, d).withColumn("is_real", F.col("idx") % 2 == 1)
    return losses.disc_loss(t, ["label"]).select("label", F.round("disc_loss", 6).alias("disc_loss"))


@query("a15_feature_mse", f"WITH {PAIR}, l AS (SELECT label % 5 AS level, avg((r - f) * (r - f)) AS mse FROM pr GROUP BY 1) SELECT round(sum(mse / (1 << level)), 6) AS feature_mse FROM l")
def _(spark: SparkSession, d: str) -> DataFrame:
    f = X.pairs(X.tiles(spark, d)).withColumn("level", F.col("label") % 5)
    weights = f.select("level").distinct().withColumn("weight", 1.0 / F.pow(F.lit(2.0), "level"))
    return losses.feature_mse(f, weights).select(F.round("feature_mse", 6).alias("feature_mse"))


@query("a16_coeff_distance", f"WITH {PAIR}, s AS (SELECT idx, sum(abs(r - f)) AS s FROM pr WHERE label > 0 GROUP BY idx) SELECT round(avg(s), 6) AS coeff_distance FROM s")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = X.pairs(X.tiles(spark, d)).withColumnRenamed("label", "channel")
    return losses.coeff_distance(c).select(F.round("coeff_distance", 6).alias("coeff_distance"))


_LEVELS = {0: 1.0, 1: 0.5, 2: 0.25, 3: 0.125, 4: 0.0625}
_TERMS = (
    f"{PAIR}, t AS (SELECT label, avg(abs(r - f)) AS l1, sum(abs(r - f) * m) / nullif(sum(m), 0) AS masked_l1, sum((r - f) * (r - f) * m) / nullif(sum(m), 0) AS masked_l2, "
    "avg(greatest(f, 0) - f + ln(1 + exp(-abs(f)))) AS adv, avg(greatest(r, 0) - r + ln(1 + exp(-abs(r)))) + avg(greatest(f, 0) + ln(1 + exp(-abs(f)))) AS disc FROM pr GROUP BY label), "
    "lv AS (SELECT label, y % 5 AS level, avg((r - f) * (r - f)) AS mse FROM pr GROUP BY 1, 2), v AS (SELECT label, sum(mse / (1 << level)) AS vgg FROM lv GROUP BY 1), "
    "ch AS (SELECT label, idx, sum(abs(r - f)) FILTER (x > 0) AS c FROM pr GROUP BY 1, 2), sc AS (SELECT label, avg(c) AS scat FROM ch GROUP BY 1)"
)


def _all_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every component loss of pairs per label. Feature levels are rows of a tile modulo 5, coefficient channels its columns."""
    p = X.pairs(X.tiles(spark, d))
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct((i % 5).alias("level"), F.slice("real", i * 8 + 1, 8).alias("real"), F.slice("fake", i * 8 + 1, 8).alias("fake")))
    column = lambda c, j: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.get(c, i * 8 + j))
    columns = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.struct(j.alias("channel"), column("real", j).alias("real"), column("fake", j).alias("fake")))
    p = p.withColumn("features", rows).withColumn("coefficients", columns)
    return losses.validate(p, ["label"], {"fake": "fake", "real": "real"}, "features", "coefficients", _LEVELS)


@query("a18_validate", f"WITH {_TERMS} SELECT label, round(l1, 6) AS l1, round(masked_l1, 6) AS masked_l1, round(masked_l2, 6) AS masked_l2, round(masked_l1 / l1, 5) AS loss_ratio, round(adv, 6) AS adv, round(disc, 6) AS disc, round(vgg, 6) AS vgg, round(scat, 5) AS scat FROM t JOIN v USING (label) JOIN sc USING (label)")
def _(spark: SparkSession, d: str) -> DataFrame:
    out, digits = _all_terms(spark, d), {"loss_ratio": 5, "scat": 5}
    return out.select("label", *(F.round(c, digits.get(c, 6)).alias(c) for c in out.columns if c != "label"))


@query("a17_a18_composite_loss", f"WITH {_TERMS} SELECT label, round(1e-4 * (adv + 200 * l1 + 200 * coalesce(masked_l1, 0) + vgg + 0.0 * scat), 6) AS loss, round(1e-4 * (adv + 200 * l1 + 200 * coalesce(masked_l1, 0) + vgg + 2 * scat), 6) AS with_scattering FROM t JOIN v USING (label) JOIN sc USING (label)")
def _(spark: SparkSession, d: str) -> DataFrame:
    terms = {"adv": F.col("adv"), "recon": F.col("l1"), "vgg": F.col("vgg"), "scat": F.col("scat"), "seg": F.coalesce("masked_l1", F.lit(0.0))}
    loss, other = losses.composite_loss(terms), losses.composite_loss(terms, losses.WEIGHTS | {"scat": 2.0})
    return _all_terms(spark, d).select("label", F.round(loss, 6).alias("loss"), F.round(other, 6).alias("with_scattering"))


# ---- sources
_CLIP = "t{n} AS (SELECT idx, list_filter(p, lambda v: abs(v - list_aggregate(p, 'median')) <= 3 * list_aggregate(p, 'stddev_pop')) AS p FROM t{m})"
_RMS = "t0 AS (SELECT vec_id AS idx, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS p FROM embeddings), " + ", ".join(_CLIP.format(n=i + 1, m=i) for i in range(3)) + ", rms AS (SELECT idx, list_aggregate(p, 'stddev_pop') AS rms FROM t3)"


@query("a9_background_rms", f"WITH {_RMS} SELECT idx, round(rms, 6) AS rms FROM rms")
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.tiles(spark, d).select("idx", F.round(detect.background_rms("pixels"), 6).alias("rms"))


@query("w6_threshold_mask", f"WITH {PX}, {_RMS} SELECT idx, y, x, CAST(v > 1.5 * rms AS INT) AS m FROM px JOIN rms USING (idx)")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = detect.detect_sources(X.tiles(spark, d), 1.5, 1)
    return explode_tiles(t.select("idx", "w", F.col("mask").alias("pixels"))).select("idx", "y", "x", F.col("v").cast("int").alias("m"))


@query(
    "w6_detect_sources",
    f"WITH RECURSIVE {PX}, {_RMS}, on_px AS (SELECT idx, y, x, y * 8 + x AS id FROM px JOIN rms USING (idx) WHERE v > 1.5 * rms), "
    "edge AS (SELECT a.idx, a.id AS a, b.id AS b FROM on_px a JOIN on_px b ON a.idx = b.idx AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1), "
    "walk AS (SELECT idx, id AS a, id AS b FROM on_px UNION SELECT w.idx, w.a, e.b FROM walk w JOIN edge e ON w.idx = e.idx AND w.b = e.a), "
    "area AS (SELECT idx, a, count(*) AS n FROM walk GROUP BY 1, 2) SELECT idx, CAST(count(*) AS BIGINT) AS n_pixels, CAST(sum(a) AS BIGINT) AS id_sum FROM area WHERE n >= 3 GROUP BY idx",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    t = detect.detect_sources(X.tiles(spark, d), 1.5, 3)
    lit = explode_tiles(t.select("idx", "w", F.col("mask").alias("pixels"))).filter("v > 0")
    return lit.groupBy("idx").agg(F.count("*").alias("n_pixels"), F.sum(F.col("y") * 8 + F.col("x")).cast("bigint").alias("id_sum"))


_BOX_CLIP = "b{n} AS (SELECT idx, box, s0, list_filter(p, lambda v: abs(v - list_aggregate(p, 'median')) <= 3 * list_aggregate(p, 'stddev_pop')) AS p FROM b{m})"
_BOXES = f"{PX}, b0 AS (SELECT idx, CAST(y // 4 * 2 + x // 4 AS INT) AS box, stddev_pop(v) AS s0, list(v) AS p FROM px GROUP BY 1, 2), " + ", ".join(_BOX_CLIP.format(n=i + 1, m=i) for i in range(2)) + ", lev AS (SELECT idx, box, s0, list_aggregate(p, 'stddev_pop') AS s, list_aggregate(p, 'avg') AS mean, list_aggregate(p, 'median') AS med FROM b2)"


@query("a9_background_boxes", f"WITH {_BOXES} SELECT idx, box, round(CASE WHEN s0 - s < 0.2 * s0 THEN mean ELSE 2.5 * med - 1.5 * mean END, 6) AS level, round(s, 6) AS noise FROM lev")
def _(spark: SparkSession, d: str) -> DataFrame:
    made = detect.background_boxes(X.tiles(spark, d), 4, 2).select("idx", F.posexplode(F.arrays_zip("level", "noise")).alias("box", "b"))
    return made.select("idx", "box", F.round("b.level", 6).alias("level"), F.round("b.noise", 6).alias("noise"))


def _mesh_sql(passes: int) -> str:
    """CTEs up to mesh(idx, y, x, v, back) and noise(idx, rms): a mesh of two by two boxes of a tile, twice, and the deviation of what is left."""
    clip = "list_filter(p, lambda v: abs(v - list_aggregate(p, 'median')) <= 3 * list_aggregate(p, 'stddev_pop'))"

    def boxes(k: int, of: str) -> str:
        steps = [f"m{k}_0 AS (SELECT idx, y // 4 AS bj, x // 4 AS bi, stddev_pop(r) AS s0, list(r) AS p FROM {of} GROUP BY 1, 2, 3)"]
        steps += [f"m{k}_{i + 1} AS (SELECT idx, bj, bi, s0, {clip} AS p FROM m{k}_{i})" for i in range(passes)]
        level = "CASE WHEN s0 - list_aggregate(p, 'stddev_pop') < 0.2 * s0 THEN list_aggregate(p, 'avg') ELSE 2.5 * list_aggregate(p, 'median') - 1.5 * list_aggregate(p, 'avg') END"
        return ", ".join(steps) + f", l{k} AS (SELECT idx, bj, bi, list_aggregate(p, 'stddev_pop') AS s, {level} AS level FROM m{k}_{passes})"

    def spread_out(k: int, of: str) -> str:
        weight = "(CASE bj WHEN 1 THEN (y + 0.5) / 4 - 0.5 ELSE 1.5 - (y + 0.5) / 4 END) * (CASE bi WHEN 1 THEN (x + 0.5) / 4 - 0.5 ELSE 1.5 - (x + 0.5) / 4 END)"
        return f"s{k} AS (SELECT o.idx, o.y, o.x, any_value(o.v) AS v, any_value(o.back) + sum(l.level * {weight}) AS back FROM {of} o JOIN l{k} l ON o.idx = l.idx GROUP BY 1, 2, 3), r{k} AS (SELECT *, v - back AS r FROM s{k})"

    return f"r0 AS (SELECT idx, y, x, v, v AS r, 0.0::double AS back FROM px), {boxes(1, 'r0')}, {spread_out(1, 'r0')}, {boxes(2, 'r1')}, {spread_out(2, 'r1')}, {boxes(3, 'r2')}, mesh AS (SELECT * FROM r2), noise AS (SELECT idx, median(s) AS rms FROM l3 GROUP BY idx)"


@query("a9_background_mesh", f"WITH {PX}, {_mesh_sql(2)}, m AS (SELECT idx, avg(back) AS b FROM mesh GROUP BY idx) SELECT idx, round(b, 6) AS mean_level, round(rms, 6) AS rms FROM m JOIN noise USING (idx)")
def _(spark: SparkSession, d: str) -> DataFrame:
    made = detect.background_mesh(X.tiles(spark, d), 4, 2)
    return made.select("idx", F.round(stats.mean("background"), 6).alias("mean_level"), F.round("rms", 6).alias("rms"))


_AROUND = "near AS (SELECT c.idx, c.y, c.x, sum(n.v * (2 - abs(c.y - n.y)) * (2 - abs(c.x - n.x))) / 16 AS v FROM px c JOIN px n ON c.idx = n.idx AND abs(c.y - n.y) <= 1 AND abs(c.x - n.x) <= 1 GROUP BY 1, 2, 3)"


@tiles_of("w6_smoothed", f"{PX}, {_AROUND}, out AS (SELECT idx, y, x, v FROM near)")
def _(t: DataFrame) -> DataFrame:
    return with_tile_columns(t, lambda a: (detect.smoothed(a),), "pixels array<double>")


@query(
    "w6_segment_pixels",
    f"WITH RECURSIVE {PX}, {_AROUND}, {_mesh_sql(3)}, on_px AS (SELECT idx, y, x, y * 8 + x AS id FROM near JOIN noise USING (idx) WHERE v > 0.5 * rms), "
    "edge AS (SELECT a.idx, a.id AS a, b.id AS b FROM on_px a JOIN on_px b ON a.idx = b.idx AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1), "
    "walk AS (SELECT idx, id AS a, id AS b FROM on_px UNION SELECT w.idx, w.a, e.b FROM walk w JOIN edge e ON w.idx = e.idx AND w.b = e.a), "
    "area AS (SELECT idx, a, count(*) AS n FROM walk GROUP BY 1, 2) SELECT idx, CAST(count(*) AS BIGINT) AS n_pixels, CAST(sum(a) AS BIGINT) AS id_sum FROM area WHERE n >= 3 GROUP BY idx",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """The pixels of all sources: smoothed, above the mesh's noise, in areas large enough; splitting doesn't change them."""
    made = detect.segment_sources(X.tiles(spark, d), 0.5, 3, box=4)
    lit = explode_tiles(made.select("idx", "w", F.col("segments").alias("pixels"))).filter("v > 0")
    return lit.groupBy("idx").agg(F.count("*").alias("n_pixels"), F.sum(F.col("y") * 8 + F.col("x")).cast("bigint").alias("id_sum"))


@query("w6_segment_sources")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Sources of each tile, their pixels, and the segments as text."""
    made = detect.segment_sources(X.tiles(spark, d), 0.5, 3, box=4)
    return made.select("idx", "n_sources", F.size(F.filter("segments", lambda v: v > 0)).alias("n_pixels"), F.round("rms", 6).alias("rms"), F.array_join("segments", "").alias("segments"))


@query("e1_fwhm_bias", "WITH t AS (SELECT p_partkey AS object_id, (1.2 + p_size % 20 / 10.0) * 2 * sqrt(2 * ln(2)) AS truth FROM part) SELECT object_id, round(truth, 4) AS fwhm, round(truth * sqrt(1.5), 4) AS fwhm_major, CAST(0 AS DOUBLE) AS relative_bias FROM t")
def _(spark: SparkSession, d: str) -> DataFrame:
    """An elongated source for every part, as wide as its size says, as bright as its price, somewhere near the middle of its tile: measured, and held against the truth."""
    side, wide, long_ = 24, F.lit(1.2) + F.col("p_size") % 20 / 10.0, 1.5**0.5
    profile = lambda middle, stretch: F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda i: F.exp(-F.pow((i - middle) * stretch, 2) / (2 * wide * wide)))
    along, down = profile(11.5 + F.col("p_partkey") % 7 / 10.0, 1 / long_), profile(11.5 - F.col("p_partkey") % 5 / 10.0, long_)
    light = A.bound(along, lambda a: A.bound(down, lambda b: F.flatten(F.transform(b, lambda v: F.transform(a, lambda u: F.col("p_retailprice") * u * v + 3.0)))))
    parts = X.table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    spread = parts.repartition(-(-parts.count() // 2000) or 1)  # before there are pixels: a few bytes a tile
    t = spread.select("p_partkey", (wide * 2 * F.sqrt(F.lit(2.0) * F.log(F.lit(2.0)))).alias("truth"), F.lit(side).alias("h"), F.lit(side).alias("w"), light.alias("pixels"))
    made = widths.source_widths(t)
    bias = C.relative_bias("fwhm", "truth")
    return made.select(F.col("p_partkey").alias("object_id"), F.round("fwhm", 4).alias("fwhm"), F.round("fwhm_major", 4).alias("fwhm_major"), F.abs(F.round(bias, 5)).alias("relative_bias"))


@query("f27_binarised", "SELECT label, CAST(label > 0 AS INT) AS lit, count(*) AS n FROM embeddings GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = X.tiles(spark, d).withColumn("b", detect.binarised(F.array("label")))
    return t.groupBy("label", F.col("b")[0].cast("int").alias("lit")).agg(F.count("*").alias("n"))


# ---- mosaics
@query("s4_s7_footprint_roundtrip", f"WITH {MASK} SELECT y, x, valid FROM mask")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = X.scratch(spark, "footprint")
    sinks.write_footprint(X.mask_lr(spark, d), path)
    return sinks.read_footprint(spark, path).select("y", "x", "valid")


@query("s2_mosaic_tiles", f"WITH {MLR} SELECT CAST(y // 16 AS INT) AS ty, CAST(x // 16 AS INT) AS tx, CAST(count(*) AS INT) AS n, round(sum(v), 2) AS total FROM mlr GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = chunked(X.mosaic_lr(spark, d), 16)
    return t.select("ty", "tx", F.size("pixels").alias("n"), F.round(stats.pixel_sum("pixels"), 2).alias("total"))


@query("s7_footprint_wcs", "SELECT CAST(50.5 AS DOUBLE) AS crpix1, CAST(75.5 AS DOUBLE) AS crpix2, CAST(150.1 AS DOUBLE) AS crval1, count(*) AS pixels FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = X.scratch(spark, "footprint")
    sinks.write_footprint_with_wcs(X.mask_lr(spark, d), X.wcs_lr(), path)
    n = sinks.read_footprint(spark, path).agg(F.count("*").alias("pixels"))
    return sinks.read_footprint_wcs(spark, path).select("crpix1", "crpix2", "crval1").join(n)


@query("s1_read_fits_images", f"WITH {PX} SELECT CAST(idx AS VARCHAR) || '.fits' AS name, y, x, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 6) AS v FROM px")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = X.scratch(spark, "images")
    images.write_images(X.tiles(spark, d).withColumnRenamed("idx", "name"), path)
    back = images.read_images(spark, path).filter("error is null")
    return explode_tiles(back.select("name", "h", "w", "pixels")).select("name", "y", "x", F.round(F.col("v").cast("double"), 6).alias("v"))


@query("s2_read_mosaic", f"WITH {MLR} SELECT 'strip' || CAST(y // 50 AS VARCHAR) || '.fits' AS name, CAST(y % 50 AS INT) AS y, x, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 1) AS v FROM mlr")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Survey images of 50 rows each, written, and read as tiles of 16 pixels by byte ranges of a few tiles each."""
    path = X.scratch(spark, "surveys")
    strips = X.mosaic_lr(spark, d).withColumn("name", F.concat(F.lit("strip"), F.expr("y div 50")))
    images.write_images(assemble_tiles(strips, ["name"]), path)
    tiles = images.read_mosaic(spark, path, tile=16, range_bytes=4096)
    return images.mosaic_pixels(tiles, 16).select("name", "y", "x", F.round("v", 1).alias("v"))


@query("s3_list_tiles", "SELECT CAST(vec_id AS VARCHAR) || '.fits' AS name, CAST(5760 AS BIGINT) AS length FROM embeddings")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = X.scratch(spark, "listed")
    images.write_images(X.tiles(spark, d).withColumnRenamed("idx", "name"), path)
    return images.list_tiles(spark, path)


_CHUNK = 64


def _valid(spark: SparkSession, d: str) -> DataFrame:
    mask = K.chunks_of(X.mask_lr(spark, d).select("y", "x", F.col("valid").cast("double").alias("v")), _CHUNK)
    return K.valid_bits(K.with_border(mask, _CHUNK, X.WINDOW // 2, X.WINDOW // 2), _CHUNK, X.WINDOW)


@query("l4_sampling_bounds", f"WITH {MLR} SELECT 2 AS y_from, max(y) + 1 - 2 AS y_to, 2 AS x_from, max(x) + 1 - 2 AS x_to FROM mlr")
def _(spark: SparkSession, d: str) -> DataFrame:
    size = X.mosaic_lr(spark, d).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    (y0, y1), (x0, x1) = mosaic.sampling_bounds(F.col("h"), F.col("w"), X.WINDOW)
    return size.select(F.lit(y0).alias("y_from"), y1.alias("y_to"), F.lit(x0).alias("x_from"), x1.alias("x_to"))


@query("j3_l4_valid_centers", f"WITH {CENTERS}, b AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM mlr) SELECT y, x FROM ok, b WHERE y BETWEEN 2 AND h - 2 AND x BETWEEN 2 AND w - 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    (y0, y1), (x0, x1) = mosaic.sampling_bounds(F.col("h"), F.col("w"), X.WINDOW)
    size = X.mosaic_lr(spark, d).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))  # one row
    return K.centers_of(_valid(spark, d), _CHUNK).join(F.broadcast(size)).filter(F.col("y").between(y0, y1) & F.col("x").between(x0, x1)).select("y", "x")


@query("j3_valid_centers_rows", f"WITH {CENTERS} SELECT y, x FROM ok")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The form for masks with gaps, whose pixels are rows."""
    return mosaic.valid_centers(X.mask_lr(spark, d), X.WINDOW)


_RANKED = f"{CENTERS}, k AS (SELECT y, x, row_number() OVER (ORDER BY y // 64, x // 64, y, x) - 1 AS k FROM ok)"


@query("l1_draw_ranked", f"WITH {_RANKED} SELECT i AS idx, y, x FROM range(20000) r(i) JOIN k ON k = CAST('0x' || substr(md5('3:' || i), 1, 15) AS BIGINT) % (SELECT count(*) FROM ok)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A draw is a rank: no position is numbered."""
    return K.draw_locations(stored(_valid(spark, d)), _CHUNK, 20_000, seed=3)


@query("l1_draw_all_distinct", f"WITH {CENTERS} SELECT y, x FROM ok")
def _(spark: SparkSession, d: str) -> DataFrame:
    """As many draws without replacement as there are valid centres: each comes once."""
    bits = stored(_valid(spark, d))
    total = bits.agg(F.sum("n")).first()[0] or 0
    return K.draw_locations(bits, _CHUNK, total, seed=3, replace=False).select("y", "x")


@query("l1_sample_locations", f"WITH {CENTERS}, k AS (SELECT y, x, row_number() OVER (ORDER BY {hashed('3', 'y', 'x')}, y, x) - 1 AS k FROM ok) SELECT i AS idx, y, x FROM range(1000) r(i) JOIN k ON k = {hashed('3', 'i')} % (SELECT count(*) FROM ok)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return mosaic.sample_locations(X.mask_lr(spark, d), 1000, X.WINDOW, seed=3)


@query("l1_sample_without_replacement", f"WITH {CENTERS} SELECT y, x FROM ok ORDER BY {hashed('3', 'y', 'x')}, y, x LIMIT 500")
def _(spark: SparkSession, d: str) -> DataFrame:
    return mosaic.sample_locations(X.mask_lr(spark, d), 500, X.WINDOW, seed=3, replace=False)


def _window_pixels(cut: DataFrame) -> DataFrame:
    """Pixels of cutouts of six pixels, counted from the window's start; the centre follows from idx."""
    flat = explode_tiles(cut.withColumnsRenamed({"y": "top", "x": "left"}))
    return flat.select("idx", F.expr("int(top + y - (idx div 1000 - 3))").alias("y"), F.expr("int(left + x - (idx % 1000 - 3))").alias("x"), F.round("v", 2).alias("v"))


@query("j4_extract_cutouts_rows", f"WITH {MLR}, c AS (SELECT CAST(y * 1000 + x AS BIGINT) AS idx, y AS cy, x AS cx FROM mlr) SELECT idx, CAST(y - cy + 3 AS INT) AS y, CAST(x - cx + 3 AS INT) AS x, round(v, 2) AS v FROM mlr JOIN c ON y >= cy - 3 AND y < cy + 3 AND x >= cx - 3 AND x < cx + 3")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The form for mosaics with gaps, whose pixels are rows."""
    return mosaic.extract_cutouts(X.mosaic_lr(spark, d), _all_centers(spark, d), 6, 16).withColumn("v", F.round("v", 2))


@query("s6_write_filtered", f"WITH {PX} SELECT 'hr' AS survey, idx AS name, round(sum(v), 6) AS pix_sum FROM px GROUP BY idx HAVING sum(v) > exp(-1) AND sum(v) < exp(1)")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = X.scratch(spark, "filtered")
    t = X.tiles(spark, d).withColumnRenamed("idx", "name").withColumn("survey", F.lit("hr"))
    sinks.write_filtered(t, gates.filter_log_sum(t, "pixels", -1.0, 1.0), path)
    return spark.read.parquet(path).select("survey", "name", F.round(stats.pixel_sum("pixels"), 6).alias("pix_sum"))


@query("s6_write_filtered_pairs", f"WITH {LR}, ok AS (SELECT idx FROM px WHERE idx % 7 != 3 AND idx % 5 != 2 GROUP BY idx HAVING sum(v) > exp(-1) AND sum(v) < exp(1)) SELECT 'hr' AS survey, idx AS name, round(sum(v), 6) AS pix_sum FROM px JOIN ok USING (idx) GROUP BY idx UNION ALL SELECT 'lr', idx, round(sum(v), 6) FROM lr JOIN ok USING (idx) GROUP BY idx")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Both surveys' tiles of the pairs that pass, some tiles without a partner, written by survey and read back."""
    path, t = X.scratch(spark, "filtered_pairs"), X.tiles(spark, d)
    low, high = (x.select(F.lit(k).alias("survey"), F.col("idx").alias("name"), "h", "w", "pixels") for k, x in (("lr", X.low_tiles(t).filter("idx % 7 != 3")), ("hr", t.filter("idx % 5 != 2"))))
    sinks.write_filtered(low.unionByName(high), gates.accepted_pairs(low, high, low=-1.0, high=1.0), path)
    return spark.read.parquet(path).select("survey", "name", F.round(stats.pixel_sum("pixels"), 6).alias("pix_sum"))


def _tan_sql(x: str, y: str) -> str:
    """Low-resolution pixel numbers to high-resolution ones through the sky, as CTE columns."""
    lr, hr = "0.168 / 3600", "0.084 / 3600"
    return (
        f"a AS (SELECT *, radians(-({lr}) * ({x} - 50.5)) AS xi, radians({lr} * ({y} - 75.5)) AS eta, radians(2.2) AS d0 FROM mlr), "
        "b AS (SELECT *, cos(d0) - eta * sin(d0) AS below FROM a), "
        "sky AS (SELECT *, 150.1 + degrees(atan2(xi, below)) AS ra, degrees(atan2(sin(d0) + eta * cos(d0), sqrt(xi * xi + below * below))) AS dec FROM b), "
        "p AS (SELECT *, radians(ra - 150.1) AS al, radians(dec) AS de FROM sky), "
        "q AS (SELECT *, sin(de) * sin(d0) + cos(de) * cos(d0) * cos(al) AS c FROM p), "
        f"moved AS (SELECT *, degrees(cos(de) * sin(al) / c) / (-({hr})) + 100.5 AS tx, degrees((sin(de) * cos(d0) - cos(de) * sin(d0) * cos(al)) / c) / ({hr}) + 150.5 AS ty FROM q)"
    )


_TAN = f"{MLR}, {_tan_sql('x', 'y')}"


@query("j6_f22_crossmatch", f"WITH {_TAN} SELECT y, x, round(ra, 7) AS ra, round(dec, 7) AS dec, round(tx, 5) AS x_to, round(ty, 5) AS y_to FROM moved")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = mosaic.crossmatch_centers(X.mosaic_lr(spark, d).select("y", "x"), X.wcs_lr(), X.wcs_hr())
    return m.select("y", "x", F.round("ra", 7).alias("ra"), F.round("dec", 7).alias("dec"), F.round("x_to", 5).alias("x_to"), F.round("y_to", 5).alias("y_to"))


_REPROJECT = (
    f"{MHR}, {_TAN}, r AS (SELECT y, x, round(tx, 9) AS sx, round(ty, 9) AS sy FROM moved), w AS (SELECT y, x, floor(sx) AS x0, floor(sy) AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM r), "
    "tap AS (SELECT w.y, w.x, y0 + dy AS ny, x0 + dx AS nx, (CASE dy WHEN 1 THEN fy ELSE 1 - fy END) * (CASE dx WHEN 1 THEN fx ELSE 1 - fx END) AS t FROM w, (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx)), "
    "rp AS (SELECT tap.y, tap.x, sum(t * mhr.v) AS v, count(mhr.v) = count(*) AS covered FROM tap LEFT JOIN mhr ON mhr.y = ny AND mhr.x = nx WHERE t > 0 GROUP BY 1, 2)"
)


def _reprojected(spark: SparkSession, d: str) -> DataFrame:
    """The high-resolution mosaic on the low one's grid, by chunks."""
    size = X.mosaic_lr(spark, d).agg(F.max("y"), F.max("x")).first()  # one row
    target = K.grid(spark, size[0] + 1, size[1] + 1, _CHUNK)
    return K.reproject_chunks(K.chunks_of(X.mosaic_hr(spark, d), 2 * _CHUNK), target, X.WCS_HR, X.WCS_LR, 2 * _CHUNK, _CHUNK)


@query("j5_reproject", f"WITH {_REPROJECT} SELECT y, x, CASE WHEN covered THEN round(v, 5) END AS v, covered FROM rp")
def _(spark: SparkSession, d: str) -> DataFrame:
    made = explode_tiles(_reprojected(spark, d).withColumn("pixels", F.arrays_zip(F.col("pixels").alias("v"), F.col("covered").alias("c"))).drop("covered"))
    covered = F.col("v.c") == 1
    return made.select((F.col("ty") * _CHUNK + F.col("y")).alias("y"), (F.col("tx") * _CHUNK + F.col("x")).alias("x"), F.when(covered, F.round("v.v", 5)).alias("v"), covered.alias("covered"))


@query("j5_reproject_rows", f"WITH {_REPROJECT} SELECT y, x, CASE WHEN covered THEN round(v, 5) END AS v, covered FROM rp")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The form for mosaics whose pixels are rows."""
    r = mosaic.reproject(X.mosaic_hr(spark, d), X.mosaic_lr(spark, d), X.wcs_hr(), X.wcs_lr())
    return r.select("y", "x", F.round("v", 5).alias("v"), "covered")


@query("f21_footprint", f"WITH {_REPROJECT} SELECT y, x, coalesce(covered AND v != 0, false) AS valid FROM rp")
def _(spark: SparkSession, d: str) -> DataFrame:
    made = explode_tiles(K.footprint_chunks(_reprojected(spark, d)))
    return made.select((F.col("ty") * _CHUNK + F.col("y")).alias("y"), (F.col("tx") * _CHUNK + F.col("x")).alias("x"), (F.col("v") == 1).alias("valid"))


@query("f22_wcs_roundtrip", f"WITH {MLR} SELECT y, x, CAST(x AS DOUBLE) AS x_back, CAST(y AS DOUBLE) AS y_back FROM mlr")
def _(spark: SparkSession, d: str) -> DataFrame:
    w = X.wcs_lr()
    at = X.mosaic_lr(spark, d).select("y", "x", *(c.alias(n) for c, n in zip(pix_to_sky(F.col("x").cast("double"), F.col("y").cast("double"), w, 0), ("ra", "dec"))))
    x, y = sky_to_pix(F.col("ra"), F.col("dec"), w, 0)
    return at.select("y", "x", (F.round(x, 6) + 0.0).alias("x_back"), (F.round(y, 6) + 0.0).alias("y_back"))


# ---- ordinals, sampling, steps
@query("w1_l2_number_rows", "SELECT idx, ordinal FROM (SELECT vec_id AS idx, row_number() OVER (ORDER BY vec_id DESC) - 1 AS ordinal FROM embeddings) WHERE ordinal < 100")
def _(spark: SparkSession, d: str) -> DataFrame:
    """All rows are numbered, the last first; take() then keeps what it is for."""
    numbered = B.number_rows(X.tiles(spark, d).select((-F.col("idx")).alias("k")), ["k"])
    return B.take(numbered, 100, "ordinal").select((-F.col("k")).alias("idx"), "ordinal")


@query("l3_shuffle", f"SELECT vec_id AS idx, {hashed('5', '2', 'vec_id')} AS shuffle_key FROM embeddings")
def _(spark: SparkSession, d: str) -> DataFrame:
    return B.shuffled(X.tiles(spark, d).select("idx"), "idx", epoch=2, seed=5)


@query("l5_train_val_split", f"SELECT doc_id AS name, CASE WHEN {hashed('1', 'doc_id')} % 10000 < 2000 THEN 'val' ELSE 'train' END AS split FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return B.train_val_split(_names(spark, d)[0].select("name"), "name", 0.2, 1)


_BITS = hashed("0", "1", "idx")


@tiles_of("l6_augment_flips", f"{PX}, out AS (SELECT idx, CASE WHEN {_BITS} % 2 = 1 THEN 7 - y ELSE y END AS y, CASE WHEN {_BITS} // 2 % 2 = 1 THEN 7 - x ELSE x END AS x, v FROM px)")
def _(t: DataFrame) -> DataFrame:
    return t.withColumn("pixels", P.flipped("pixels", 8, 8, *B.flips("idx", 1)))


@query("l3_epoch_shards", f"SELECT doc_id, CAST({hashed('5', '2', 'doc_id')} % 8 AS INT) AS shard, row_number() OVER (PARTITION BY {hashed('5', '2', 'doc_id')} % 8 ORDER BY CAST('0x' || substr(md5('5:2:place:' || doc_id), 1, 15) AS BIGINT), doc_id) - 1 AS place FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    """An epoch's shards, written by shard and read back."""
    path = X.scratch(spark, "shards")
    B.epoch_shards(X.table(spark, d, "documents").select("doc_id"), "doc_id", 2, 8, seed=5).write.partitionBy("shard").parquet(path)
    return spark.read.parquet(path).select("doc_id", F.col("shard").cast("int").alias("shard"), "place")


@query("w4_every_n", f"WITH {METRIC} SELECT step, value FROM metric WHERE step % 25 = 0 AND step > 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    return B.every_n(X.metrics(spark, d), 25).select("step", "value")


@query("w5_carry_last", "WITH m AS (SELECT event_id AS step, user_id % 10 AS run, CASE WHEN event_type = 'error' THEN value END AS disc FROM events) SELECT step, run, round(last_value(disc IGNORE NULLS) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS carried FROM m")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = X.table(spark, d, "events").select(F.col("event_id").alias("step"), (F.col("user_id") % 10).alias("run"), F.when(F.col("event_type") == "error", F.col("value")).alias("disc"))
    return B.carry_last(m, "disc", ["run"], ["step"]).select("step", "run", F.round("carried", 6).alias("carried"))


# ---- profiles
_CURVE = "rg AS (SELECT idx, sqrt(pow(y - 3.5, 2) + pow(x - 3.5, 2)) AS r, sum(v * v) AS light FROM px GROUP BY 1, 2), gc AS (SELECT idx, r, sum(light) OVER (PARTITION BY idx ORDER BY r) / sum(light) OVER (PARTITION BY idx) AS frac FROM rg)"


def _light(t: DataFrame) -> DataFrame:
    return t.select("idx", "h", "w", F.transform("pixels", lambda v: v * v).alias("pixels"))


@query("w7_growth_curve", f"WITH {PX}, {_CURVE} SELECT idx, round(r, 6) AS r, round(frac, 6) AS frac FROM gc")
def _(spark: SparkSession, d: str) -> DataFrame:
    return profiles.curve_points(profiles.growth_curve(_light(X.tiles(spark, d)), 3.5, 3.5)).select("idx", F.round("r", 6).alias("r"), F.round("frac", 6).alias("frac"))


@query("w7_light_radii", f"WITH {PX}, {_CURVE}, q AS (SELECT idx, min(r) FILTER (frac >= 0.25) AS r25, min(r) FILTER (frac >= 0.5) AS r50, min(r) FILTER (frac >= 0.75) AS r75 FROM gc GROUP BY idx) SELECT idx, round(r25, 6) AS r25, round(r50, 6) AS r50, round(r75, 6) AS r75, round(r75 / nullif(r25, 0), 6) AS c7525 FROM q")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = profiles.light_radii(profiles.growth_curve(_light(X.tiles(spark, d)), 3.5, 3.5))
    return r.select("idx", *(F.round(c, 6).alias(c) for c in ("r25", "r50", "r75", "c7525")))


@query(
    "e5_encircled_energy_diff",
    f"WITH {PAIR}, a AS (SELECT idx, sqrt(pow(y - 3.5, 2) + pow(x - 3.5, 2)) <= 2.0 AS inside, r * r AS t, f * f AS m FROM pr), s AS (SELECT idx, sum(t) FILTER (inside) / sum(t) AS t, sum(m) FILTER (inside) / sum(m) AS m FROM a GROUP BY idx) SELECT idx, round((m - t) / nullif(t, 0), 5) AS diff FROM s",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    t = X.tiles(spark, d)
    curve = lambda x: profiles.growth_curve(_light(x), 3.5, 3.5)
    return profiles.encircled_energy_diff(curve(X.pred_tiles(t)), curve(t), 2.0).select("idx", F.round("diff", 5).alias("diff"))


@query(
    "e6_tile_moments",
    f"WITH {PX}, m AS (SELECT idx, sum(v * x * x) / sum(v) - pow(sum(v * x) / sum(v), 2) AS a, sum(v * y * y) / sum(v) - pow(sum(v * y) / sum(v), 2) AS d FROM px WHERE v > 0 GROUP BY idx), b AS (SELECT idx, sum(v * x * y) / sum(v) - sum(v * x) * sum(v * y) / (sum(v) * sum(v)) AS b FROM px WHERE v > 0 GROUP BY idx), "
    "r AS (SELECT idx, a, b, d, (a + d) / 2 AS mid, sqrt(pow(a - d, 2) / 4 + b * b) AS root FROM m JOIN b USING (idx)) SELECT idx, round(sqrt(greatest(mid - root, 0) / nullif(mid + root, 0)), 5) AS q, round(cos(atan2(2 * b, a - d) / 2), 5) AS ux, round(sin(atan2(2 * b, a - d) / 2), 5) AS uy FROM r",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return profiles.tile_moments(X.tiles(spark, d)).select("idx", *(F.round(c, 5).alias(c) for c in ("q", "ux", "uy")))


# ---- catalogues
@query("j9_e1_e2_biases", f"WITH {CATALOG} SELECT object_id, source, mode, round((measured - truth) / nullif(truth, 0), 6) AS relative_bias, round(ln(measured) - ln(truth), 6) AS absolute_bias FROM pc")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = C.pair_catalog(*X.catalog(spark, d))
    p = p.withColumn("log_measured", F.ln("measured")).withColumn("log_truth", F.ln("truth"))
    return p.select("object_id", "source", "mode", F.round(C.relative_bias("measured", "truth"), 6).alias("relative_bias"), F.round(C.absolute_bias("log_measured", "log_truth"), 6).alias("absolute_bias"))


def _summary(spark: SparkSession, d: str) -> DataFrame:
    p = C.pair_catalog(*X.catalog(spark, d)).withColumn("bias", C.relative_bias("measured", "truth"))
    return C.bias_summary(p, ["source", "mode"])


@query("a20_bias_summary", f"WITH {CATALOG}, b AS (SELECT source, mode, (measured - truth) / nullif(truth, 0) AS bias FROM pc) SELECT source, mode, round(avg(bias), 6) AS mean_bias, round(stddev_pop(bias), 6) AS spread, count(bias) AS n FROM b GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _summary(spark, d).select("source", "mode", F.round("mean_bias", 6).alias("mean_bias"), F.round("spread", 6).alias("spread"), "n")


@query("e4_better_flag", f"WITH {CATALOG}, b AS (SELECT source, mode, abs(avg((measured - truth) / nullif(truth, 0))) AS b FROM pc GROUP BY 1, 2) SELECT mode, source AS better FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY b, source) AS k FROM b) WHERE k = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return C.better_flag(_summary(spark, d), ["mode"])


@query("e3_orientation_similarity", "WITH u AS (SELECT vec_id // 2 AS pair, vec_id % 2 AS side, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings) SELECT CAST(m.pair AS BIGINT) AS pair, round(1 - abs((m.a * t.a + m.b * t.b) / nullif(sqrt(pow(m.a, 2) + pow(m.b, 2)) * sqrt(pow(t.a, 2) + pow(t.b, 2)), 0)), 6) AS similarity FROM u m JOIN u t ON m.pair = t.pair AND m.side = 0 AND t.side = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = X.table(spark, d, "embeddings").select(F.expr("vec_id div 2").alias("pair"), (F.col("vec_id") % 2).alias("side"), F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    m, t = e.filter("side = 0").select("pair", F.col("a").alias("ma"), F.col("b").alias("mb")), e.filter("side = 1").select("pair", F.col("a").alias("ta"), F.col("b").alias("tb"))
    return m.join(t, "pair").select("pair", F.round(C.orientation_similarity("ma", "mb", "ta", "tb"), 6).alias("similarity"))


# ---- metric logs
_NAMES = ["view", "signup", "purchase", "click", "error"]


@query("s8_x1_metrics_wide", f"WITH {METRIC} SELECT split, step // 100 AS block, " + ", ".join(f"round(avg(value) FILTER (metric = '{m}'), 4) AS {m}" for m in _NAMES) + " FROM metric GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = X.scratch(spark, "metrics")
    metrics.append_metrics(X.metrics(spark, d), path)
    wide = metrics.metrics_wide(spark.read.parquet(path).withColumn("block", F.expr("step div 100")), _NAMES, ["split", "block"])
    return wide.select("split", "block", *(F.round(m, 4).alias(m) for m in _NAMES))


@query("x2_train_val_gap", f"WITH {METRIC}, g AS (SELECT metric, avg(value) FILTER (split = 'train') AS train, avg(value) FILTER (split = 'val') AS val FROM metric GROUP BY 1) SELECT metric, round(train, 4) AS train, round(val, 4) AS val, round(val - train, 4) AS gap FROM g")
def _(spark: SparkSession, d: str) -> DataFrame:
    g = metrics.train_val_gap(X.metrics(spark, d), ["metric"])
    return g.select("metric", *(F.round(c, 4).alias(c) for c in ("train", "val", "gap")))


@query("s9_run_params", "SELECT o_orderpriority AS run_id, CAST(count(*) AS VARCHAR) AS n, CAST(max(o_orderkey) AS VARCHAR) AS last FROM orders GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    runs = X.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("run_id")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))
    path = X.scratch(spark, "params")
    for r in runs.collect():  # a row per priority: five
        metrics.append_run_params(spark, r["run_id"], {"n": r["n"], "last": r["last"]}, path)
    return metrics.params_wide(spark.read.parquet(path), ["n", "last"])


@query("s10_figure_table", f"WITH {PAIR}, c AS (SELECT idx, r, f FROM pr WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5), l AS (SELECT idx, avg(r) AS r, avg(f) AS f, avg(f - r) AS d, max(abs(f - r)) AS m FROM c GROUP BY idx) SELECT idx, 'real' AS panel, round(r, 6) AS mean_value, -1.0 AS vmin, 1.0 AS vmax FROM l UNION ALL SELECT idx, 'fake', round(f, 6), -1.0, 1.0 FROM l UNION ALL SELECT idx, 'residual', round(d, 6), -round(m, 6), round(m, 6) FROM l")
def _(spark: SparkSession, d: str) -> DataFrame:
    f = metrics.figure_table(X.pairs(X.tiles(spark, d)), 8, 8, 4)
    return f.select("idx", "panel", F.round(stats.mean("pixels"), 6).alias("mean_value"), F.round("vmin", 6).alias("vmin"), F.round("vmax", 6).alias("vmax"))


# ---- whole plans
_DS9 = "log10(least(greatest(v, 0), hi) * 1000 + 1) / log10(1001) - 1"
_DS9_OR_NULL = f"CASE WHEN least(greatest(v, 0), hi) > -0.001 THEN {_DS9} END"


@query(
    "f29_preprocess",
    f"WITH {LR}, hc AS (SELECT idx, y - 1 AS y, x - 1 AS x, v FROM px WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6), lc AS (SELECT * FROM lr WHERE y < 4), "
    "t0 AS (SELECT idx, list(v) AS p FROM hc GROUP BY idx), " + ", ".join(_CLIP.format(n=i + 1, m=i) for i in range(3)) + ", rms AS (SELECT idx, list_aggregate(p, 'stddev_pop') AS rms FROM t3), "
    "hh AS (SELECT idx, quantile_cont(v, 0.99999) AS hi FROM hc GROUP BY idx), lh AS (SELECT idx, quantile_cont(v, 0.99999) AS hi FROM lr WHERE y < 3 AND x < 3 GROUP BY idx), "
    f"hs AS (SELECT idx, y, x, {_DS9_OR_NULL} AS s, CAST(v > 1.5 * rms AS DOUBLE) AS m FROM hc JOIN hh USING (idx) JOIN rms USING (idx)), "
    f"ls AS (SELECT idx, y, x, {_DS9_OR_NULL} AS s FROM (SELECT idx, y - 0 AS y, x - 0 AS x, v FROM lr WHERE y < 3 AND x < 3) JOIN lh USING (idx)), "
    "up AS (SELECT idx, a.i AS y, b.i AS x, s FROM ls JOIN range(6) a(i) ON a.i // 2 = y JOIN range(6) b(i) ON b.i // 2 = x), "
    "g AS (SELECT a.i AS ty, b.i AS tx, CASE WHEN a.i < 2 THEN 2 - a.i WHEN a.i >= 8 THEN 12 - a.i ELSE a.i - 2 END AS sy, CASE WHEN b.i < 2 THEN 2 - b.i WHEN b.i >= 8 THEN 12 - b.i ELSE b.i - 2 END AS sx FROM range(10) a(i), range(10) b(i)), "
    "k AS (SELECT a.i AS ty, b.i AS tx, CASE WHEN a.i < 1 THEN 1 WHEN a.i >= 4 THEN 1 ELSE a.i - 1 END AS sy, CASE WHEN b.i < 1 THEN 1 WHEN b.i >= 4 THEN 1 ELSE b.i - 1 END AS sx FROM range(5) a(i), range(5) b(i)) "
    "SELECT 'hr' AS panel, idx, CAST(ty AS INT) AS y, CAST(tx AS INT) AS x, round(s, 4) AS v FROM hs JOIN g ON y = sy AND x = sx UNION ALL SELECT 'mask', idx, ty, tx, m FROM hs JOIN g ON y = sy AND x = sx "
    "UNION ALL SELECT 'lr_up', idx, ty, tx, round(s, 4) FROM up JOIN g ON y = sy AND x = sx UNION ALL SELECT 'lr', idx, ty, tx, round(s, 4) FROM ls JOIN k ON y = sy AND x = sx",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    t = X.tiles(spark, d)
    p = t.select("idx", F.col("pixels").alias("hr")).join(X.low_tiles(t).select("idx", F.col("pixels").alias("lr")), "idx")
    return _panels(P.preprocess(p, (8, 6, 2), (4, 3, 1), k=1.5))


@query("f29_preprocess_columns", ORACLES["f29_preprocess"])
def _(spark: SparkSession, d: str) -> DataFrame:
    """The form in built-in functions, for small tiles beside other columns."""
    t = X.tiles(spark, d)
    p = t.select("idx", F.col("pixels").alias("hr")).join(X.low_tiles(t).select("idx", F.col("pixels").alias("lr")), "idx")
    return _panels(P.preprocess_columns(p, (8, 6, 2), (4, 3, 1), k=1.5))


def _panels(made: DataFrame) -> DataFrame:
    panel = lambda c: F.struct(F.lit(c).alias("panel"), F.col(f"{c}_w").alias("w"), (F.transform(c, lambda v: v.cast("double")) if c == "mask" else F.col(c)).alias("pixels"))
    flat = made.select("idx", F.explode(F.array(*(panel(c) for c in ("hr", "mask", "lr_up", "lr")))).alias("p")).select("idx", "p.*")
    return explode_tiles(flat).select("panel", "idx", "y", "x", F.round("v", 4).alias("v"))


@query("u3_score_tiles", f"WITH {LR} SELECT idx, round(sum(CAST(CAST(v AS FLOAT) AS DOUBLE)) * 36, 3) AS total, 576 AS n FROM lr GROUP BY idx")
def _(spark: SparkSession, d: str) -> DataFrame:
    low = X.low_tiles(X.tiles(spark, d)).withColumn("pixels", F.transform("pixels", lambda v: v.cast("float")))
    made = P.score_tiles(low, P.nearest_baseline(6), 4, 4)
    return made.select("idx", F.round(F.aggregate("predicted", F.lit(0.0), lambda a, v: a + v), 3).alias("total"), F.size("predicted").alias("n"))


# ---- whole tables: at every position, ordinal and tile
def _all_centers(spark: SparkSession, d: str) -> DataFrame:
    return X.mosaic_lr(spark, d).select((F.col("y") * 1000 + F.col("x")).cast("bigint").alias("idx"), "y", "x")


_CUT = f"{MLR}, cut AS (SELECT CAST(c.y * 1000 + c.x AS BIGINT) AS idx, CAST(i AS INT) AS y, CAST(j AS INT) AS x, p.v FROM mlr p, range(6) a(i), range(6) b(j), mlr c WHERE c.y = p.y + 3 - i AND c.x = p.x + 3 - j)"


@query("j3_validate_locations", f"WITH {CENTERS} SELECT y, x FROM ok")
def _(spark: SparkSession, d: str) -> DataFrame:
    return K.validate_points(X.mosaic_lr(spark, d).select("y", "x"), _valid(spark, d), _CHUNK)


@query("j4_extract_cutouts", f"WITH {_CUT} SELECT idx, y, x, round(v, 2) AS v FROM cut")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _window_pixels(K.cut_bordered(stored(K.with_border(K.chunks_of(X.mosaic_lr(spark, d), _CHUNK), _CHUNK, 0, 5)), _all_centers(spark, d), 6, _CHUNK))


@query("j4_extract_cutouts_pieces", f"WITH {_CUT} SELECT idx, y, x, round(v, 2) AS v FROM cut")
def _(spark: SparkSession, d: str) -> DataFrame:
    """From chunks without a border, which are read as they are: windows over several are put together."""
    return _window_pixels(mosaic.cut_tiles(chunked(X.mosaic_lr(spark, d), _CHUNK), _all_centers(spark, d), 6, _CHUNK))


@query("j4_extract_from_images", f"WITH {_CUT}, k AS (SELECT y, x, row_number() OVER (ORDER BY y // 64, x // 64, y, x) - 1 AS k FROM (SELECT a.y, a.x FROM mlr a, (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM mlr) s WHERE a.y BETWEEN 3 AND h - 3 AND a.x BETWEEN 3 AND w - 3)), n AS (SELECT i, y, x FROM range(5000) r(i) JOIN k ON k = CAST('0x' || substr(md5('9:' || i), 1, 15) AS BIGINT) % (SELECT count(*) FROM k)) SELECT i AS idx, count(*) AS n, round(sum(round(CAST(CAST(v AS FLOAT) AS DOUBLE), 1)), 1) AS total FROM n JOIN cut ON cut.idx = n.y * 1000 + n.x GROUP BY i")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The whole way: a survey image, read by byte ranges, its chunks stored with a border, centres drawn where a window has all its pixels, and cut."""
    path = X.scratch(spark, "survey_image")
    images.write_images(assemble_tiles(X.mosaic_lr(spark, d).withColumn("name", F.lit("survey")), ["name"]), path)
    chunks = images.read_mosaic(spark, path, tile=_CHUNK, range_bytes=1 << 15).drop("name", "error")
    bordered = stored(K.with_border(chunks, _CHUNK, 3, 5))
    there = bordered.withColumn("pixels", F.transform("pixels", lambda v: F.when(F.isnan(v), 0.0).otherwise(1.0)))
    at = K.draw_locations(stored(K.valid_bits(there, _CHUNK, 6)), _CHUNK, 5000, seed=9)
    cut = K.cut_bordered(bordered, at, 6, _CHUNK)
    return cut.select("idx", F.size("pixels").cast("bigint").alias("n"), F.round(stats.pixel_sum(F.transform("pixels", lambda v: F.round(v, 1))), 1).alias("total"))


@query("j4_without_overlap", f"WITH {MHR}, {MLR}, met AS (SELECT DISTINCT y + i AS y, x + j AS x FROM mhr, range(2) a(i), range(2) b(j)) SELECT CAST(y * 1000 + x AS BIGINT) AS idx FROM mlr ANTI JOIN met USING (y, x)")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = _all_centers(spark, d)
    return mosaic.without_overlap(c, mosaic.extract_cutouts(X.mosaic_hr(spark, d), c, 2, 16)).select("idx")


_CUT_HR = "hd AS (SELECT CAST(2 * p.y + a.i AS INT) AS y, CAST(2 * p.x + b.j AS INT) AS x, p.v * (1 + a.i + 2 * b.j) AS v FROM mlr p, range(2) a(i), range(2) b(j)), cuth AS (SELECT CAST(c.y * 1000 + c.x AS BIGINT) AS idx, p.v FROM hd p, range(12) a(i), range(12) b(j), mlr c WHERE 2 * c.y = p.y + 6 - i AND 2 * c.x = p.x + 6 - j)"


@query("s5_cutout_pairs_roundtrip", f"WITH {_CUT}, {_CUT_HR} SELECT 'lr' AS survey, idx, CAST(count(*) AS INT) AS n, round(sum(v), 2) AS total FROM cut GROUP BY idx UNION ALL SELECT 'hr', idx, CAST(count(*) AS INT), round(sum(v), 2) FROM cuth GROUP BY idx")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Both surveys' cutouts at every position, written under the same idx; the high-resolution mosaic is the other one, each pixel as 2 by 2."""
    path, low, c = X.scratch(spark, "cutouts"), X.mosaic_lr(spark, d), _all_centers(spark, d)
    four = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    high = low.withColumn("p", four).select((F.col("y") * 2 + F.col("p.i")).alias("y"), (F.col("x") * 2 + F.col("p.j")).alias("x"), (F.col("v") * (F.lit(1) + F.col("p.i") + F.col("p.j") * 2)).alias("v"))
    low, high = (stored(K.with_border(K.chunks_of(m, side), side, 0, size - 1)) for m, side, size in ((low, _CHUNK, 6), (high, 2 * _CHUNK, 12)))
    cut = K.cut_bordered(low, c, 6, _CHUNK).withColumn("survey", F.lit("lr"))
    other = K.cut_bordered(high, c.select("idx", (F.col("y") * 2).alias("y"), (F.col("x") * 2).alias("x")), 12, 2 * _CHUNK).withColumn("survey", F.lit("hr"))
    sinks.write_cutout_pairs(cut.unionByName(other), path)
    return spark.read.parquet(path).select("survey", "idx", F.size("pixels").alias("n"), F.round(stats.pixel_sum("pixels"), 2).alias("total"))


@query("f23_cutout_wcs", f"WITH {MLR} SELECT y, x, CAST(50.5 - (x - 3) AS DOUBLE) AS crpix1, CAST(75.5 - (y - 3) AS DOUBLE) AS crpix2 FROM mlr")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = _all_centers(spark, d).withColumn("wcs", cutout_header(X.wcs_lr(), F.col("x") - 3, F.col("y") - 3))
    return c.select("y", "x", "wcs.crpix1", "wcs.crpix2")


@query("w1_number_rows_all", "SELECT vec_id AS idx, row_number() OVER (ORDER BY vec_id) - 1 AS ordinal FROM embeddings")
def _(spark: SparkSession, d: str) -> DataFrame:
    return B.number_rows(X.tiles(spark, d).select("idx"), ["idx"])


@query("u1_chained_steps", f"WITH {PX} SELECT idx, round(sum(2 * (1 / (1 + exp(-v)) - 0.5)), 6) AS total FROM px GROUP BY idx HAVING sum(v) > exp(-1) AND sum(v) < exp(1)")
def _(spark: SparkSession, d: str) -> DataFrame:
    made = P.chained(X.tiles(spark, d), lambda t: gates.filter_log_sum(t, "pixels", -1.0, 1.0), lambda t: P.scale_tiles(t, "sigmoid"))
    return made.select("idx", F.round(stats.pixel_sum("scaled"), 6).alias("total"))


# ---- streams
@query("t1_stream_quality_gate", f"WITH {PX} SELECT idx, round(sum(v), 6) AS pix_sum FROM px GROUP BY idx HAVING sum(v) > exp(-1) AND sum(v) < exp(1)")
def _(spark: SparkSession, d: str) -> DataFrame:
    source, out = X.scratch(spark, "arriving"), X.scratch(spark, "accepted")
    arriving = X.tiles(spark, d)
    arriving.write.parquet(source)
    jobs.run_once(jobs.quality_gate(spark.readStream.schema(arriving.schema).parquet(source), -1.0, 1.0), out, X.scratch(spark, "progress"))
    return spark.read.schema(arriving.schema).parquet(out).select("idx", F.round(stats.pixel_sum("pixels"), 6).alias("pix_sum"))


_ARRIVAL = 500_000


@query("t1_stream_pairs", f"WITH {PX}, t AS (SELECT idx, sum(v) AS s FROM px GROUP BY idx) SELECT idx AS name, CASE WHEN idx % 7 = 3 OR idx % 5 = 2 THEN 'unpaired' WHEN s > exp(-1) AND s < exp(1) THEN 'accepted' ELSE 'rejected' END AS status, idx % 7 != 3 AS has_low, idx % 5 != 2 AS has_high FROM t WHERE idx % 7 != 3 OR idx % 5 != 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Both surveys' tiles as streams that arrive in the order of time, some without a partner; a later tile of each moves the watermark past all others.

    Files of one arrival come in any order, and are one batch: the next one starts where the last one's checkpoint ends. State holds an arrival.
    """
    tiles = X.tiles(spark, d)
    count = max(2, -(-tiles.count() // _ARRIVAL))
    edges = [None, *tiles.approxQuantile("idx", [k / count for k in range(1, count)], 0.1 / count), None]
    sources, out, progress = [X.scratch(spark, "arriving") for _ in range(2)], X.scratch(spark, "paired"), X.scratch(spark, "progress")
    for after, until in zip(edges, edges[1:]):
        of = tiles.filter((F.col("idx") > after if after is not None else F.lit(True)) & (F.col("idx") <= until if until is not None else F.lit(True)))
        for path, t, there in zip(sources, (X.low_tiles(of), of), (F.col("idx") % 7 != 3, F.col("idx") % 5 != 2)):
            rows = t.filter(there).select(F.col("idx").alias("name"), F.timestamp_seconds(F.col("idx") + 1_700_000_000).alias("ts"), "pixels")
            if until is None:
                rows = rows.unionByName(spark.range(1).select(F.lit(None).cast("bigint").alias("name"), F.timestamp_seconds(F.lit(2_000_000_000)).alias("ts"), F.array(F.lit(1.0)).alias("pixels")))
            rows.repartition(4, "name").write.mode("append").parquet(path)
        made = jobs.paired_gate(*(spark.readStream.schema(rows.schema).parquet(path) for path in sources), low=-1.0, high=1.0)
        jobs.run_once(made, out, progress)
    done = spark.read.schema(made.schema).parquet(out).filter("name is not null")
    return done.select("name", "status", F.col("low_pixels").isNotNull().alias("has_low"), F.col("high_pixels").isNotNull().alias("has_high"))


@query("w1_number_text_keys", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderstatus DESC, o_orderkey) - 1 AS ordinal FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Numbers in the order of text keys, five of which hold all rows."""
    o = X.table(spark, d, "orders")
    return B.number_rows(o.select("o_orderkey", "o_orderpriority", "o_orderstatus"), ["o_orderpriority", F.desc("o_orderstatus"), "o_orderkey"]).select("o_orderkey", "ordinal")


@query("t2_windowed_metrics", "SELECT date_trunc('day', ts) AS window_start, event_type AS metric, round(avg(value), 7) AS mean_value, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = jobs.windowed_metrics(X.metrics(spark, d))
    return m.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "metric", F.round("mean_value", 7).alias("mean_value"), "n")


@query("t2_stream_metrics", "WITH l AS (SELECT max(ts) AS last FROM events) SELECT date_trunc('day', ts) AS window_start, event_type AS metric, round(avg(value), 7) AS mean_value, count(*) AS n FROM events, l GROUP BY 1, 2, last HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= last - INTERVAL 2 DAY")
def _(spark: SparkSession, d: str) -> DataFrame:
    source, out = X.scratch(spark, "log"), X.scratch(spark, "means")
    log = X.metrics(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), "metric", "value")
    log.write.parquet(source)
    result = jobs.windowed_metrics(spark.readStream.schema(log.schema).parquet(source))
    jobs.run_once(result, out, X.scratch(spark, "progress"))
    return spark.read.schema(result.schema).parquet(out).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "metric", F.round("mean_value", 7).alias("mean_value"), "n")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that pass the log-sum gate, clipped and scaled: idx, n, pix_sum, hi, mean_scaled."""
    t = gates.filter_log_sum(X.tiles(spark, sf_dir), "pixels", -1.0, 1.0)
    scaled = P.clipped("pixels", then=lambda v: S.ds9_scale(v, offset=1.0))
    return t.select("idx", F.size("pixels").alias("n"), F.round(stats.pixel_sum("pixels"), 6).alias("pix_sum"), F.round(P.clip_limits("pixels")[1], 6).alias("hi"), F.round(A.bound(scaled, stats.mean), 6).alias("mean_scaled"))


QUERIES["flagship"] = flagship
ORACLES["flagship"] = f"WITH {PX}, s AS (SELECT idx, sum(v) AS pix_sum, quantile_cont(v, 0.99999) AS hi FROM px GROUP BY idx HAVING sum(v) > exp(-1) AND sum(v) < exp(1)) SELECT idx, CAST(count(*) AS INT) AS n, round(any_value(pix_sum), 6) AS pix_sum, round(any_value(hi), 6) AS hi, round(avg({_DS9}), 6) AS mean_scaled FROM px JOIN s USING (idx) GROUP BY idx"
