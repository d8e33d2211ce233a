"""Registration metrics: image similarity, run metrics, verdicts, filters, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ["NCC", "SSIM", "Dice", "MSE", "PSNR"]


def metrics_wide(rows: DataFrame, keys: list[str]) -> DataFrame:
    """metric, value text rows to one column a metric; rows that aren't numbers are skipped."""
    ok = rows.withColumn("v", F.col("value").try_cast("double")).where("v is not null")
    return ok.groupBy(*keys).pivot("metric", METRICS).agg(F.max("v"))


def verdict(after: dict[str, Column], before: dict[str, Column]) -> Column:
    """good, warn or bad by how many of five comparisons hold; neutral without a run before."""
    zero = lambda d, k, v=0.0: F.coalesce(d[k], F.lit(v))
    tests = [zero(after, "NCC") >= zero(before, "NCC"), zero(after, "SSIM") >= zero(before, "SSIM"), zero(after, "Dice") >= zero(before, "Dice") - 0.005, zero(after, "PSNR") >= zero(before, "PSNR"), zero(after, "MSE", 1e9) <= zero(before, "MSE", 1e9)]
    n = sum((t.cast("int") for t in tests), F.lit(0))
    none = F.coalesce(*[before[k] for k in METRICS]).isNull()
    return F.when(none, "neutral").when(n >= 4, "good").when(n >= 3, "warn").otherwise("bad")


def tone(after: Column, before: Column, lower_is_better: bool = False) -> Column:
    """neutral under 1e-6, else good or bad by the sign."""
    d = after - before
    good = d < 0 if lower_is_better else d > 0
    return F.when(after.isNull() | before.isNull() | (F.abs(d) < 1e-6), "neutral").when(good, "good").otherwise("bad")


def quality_level(score: Column) -> Column:
    return F.when(score >= 0.70, "excellent").when(score >= 0.50, "good").when(score >= 0.30, "fair").otherwise("poor")


def benchmark(metrics: DataFrame) -> DataFrame:
    """One row a run: metrics after, before, their difference, verdict (K07, F21, F22, R12). metrics: run_name, stage, metric, value."""
    post = metrics_wide(metrics.where("stage = 'post'"), ["run_name"])
    pre = metrics_wide(metrics.where("stage = 'pre'"), ["run_name"])
    pre = pre.select("run_name", *[F.col(m).alias(f"{m}_pre") for m in METRICS])
    out = post.join(pre, "run_name", "left")
    out = out.withColumn("verdict", verdict({m: F.col(m) for m in METRICS}, {m: F.col(f"{m}_pre") for m in METRICS}))
    out = out.withColumns({f"{m}_delta": F.bround(F.col(m) - F.col(f"{m}_pre"), 6) for m in METRICS}).withColumn("ncc_tone", tone(F.col("NCC"), F.col("NCC_pre")))
    return out.orderBy(F.desc_nulls_last("NCC"), "run_name")


def pinned_first(runs: DataFrame, pinned: list[str], *, name: str = "run_name", when: str) -> DataFrame:
    """Pinned runs in their order, then the newest."""
    rank = F.array_position(F.array(*[F.lit(p) for p in pinned]), F.col(name))
    return runs.withColumn("pinned", rank > 0).orderBy(F.when(rank > 0, rank).asc_nulls_last(), F.desc(when), name)


def similarity(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b", mask_at: float = 0.10) -> DataFrame:
    """NCC, cosine, MSE, PSNR and Dice of paired pixels by key in one aggregation."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(x * x).alias("xx"), F.avg(y * y).alias("yy"), F.avg(x * y).alias("xy"), F.avg((x - y) * (x - y)).alias("mse"),
        F.count_if(x > mask_at).alias("ma"), F.count_if(y > mask_at).alias("mb"), F.count_if((x > mask_at) & (y > mask_at)).alias("mm"))
    sx, sy = F.sqrt(F.greatest(F.col("xx") - F.col("mx") ** 2, F.lit(0.0))), F.sqrt(F.greatest(F.col("yy") - F.col("my") ** 2, F.lit(0.0)))
    return s.select(*keys, "n", F.when((sx <= 1e-8) | (sy <= 1e-8), 0.0).otherwise((F.col("xy") - F.col("mx") * F.col("my")) / (sx * sy)).alias("ncc"), (F.col("xy") / (F.sqrt("xx") * F.sqrt("yy") + 1e-6)).alias("cosine"), F.col("mse"), (10 * F.log10(1 / F.greatest("mse", F.lit(1e-12)))).alias("psnr"), (2 * F.col("mm") / (F.col("ma") + F.col("mb") + 1e-6)).alias("dice"))


def normalise(pixels: DataFrame, keys: list[str], value: str, lo: float, hi: float, top: float = 1.0) -> DataFrame:
    """Values stretched between two exact percentiles of their image and clipped to 0..top; the range itself where the two meet."""
    q = pixels.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(lo), F.lit(hi))).alias("q"), F.min(value).alias("mn"), F.max(value).alias("mx"))
    flat = F.col("q")[1] - F.col("q")[0] <= 1e-6
    a, b = F.when(flat, F.col("mn")).otherwise(F.col("q")[0]), F.when(flat, F.col("mx")).otherwise(F.col("q")[1])
    scaled = (F.col(value) - a) / F.greatest(b - a, F.lit(1e-6))
    return pixels.join(q, keys).withColumn("norm", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)) * top).drop("q", "mn", "mx")


def otsu(pixels: DataFrame, keys: list[str], value: str, bins: int = 256) -> DataFrame:
    """Threshold of largest between-class variance over a histogram (M09); first of equal bins."""
    rng = pixels.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    b = F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    hist = pixels.join(rng, keys).where("hi > lo").groupBy(*keys, "lo", "hi", b.cast("int").alias("bin")).agg(F.count("*").alias("c"))
    mid = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    hist = hist.withColumns({"mid": mid, "cm": F.col("c") * mid})
    up, down = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys).orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    hist = hist.withColumns({"w0": F.sum("c").over(up), "m0": F.sum("cm").over(up), "w1": F.sum("c").over(down), "m1": F.sum("cm").over(down)}).where("w1 > 0")
    var = F.col("w0") * F.col("w1") * (F.col("m0") / F.col("w0") - F.col("m1") / F.col("w1")) ** 2
    return hist.withColumn("v", F.bround(var, 6)).groupBy(*keys).agg(F.max_by("mid", F.struct("v", -F.col("bin"))).alias("threshold"))


def displacement_filter(pairs: DataFrame, keys: list[str], max_disp: float, min_points: int = 16) -> DataFrame:
    """Keeps pairs up to max_disp, then up to max(median + 3.8 MAD, median + 2.5) where enough survive (M10). pairs: disp."""
    near = pairs.where(F.col("disp") <= max_disp)
    med = near.groupBy(*keys).agg(F.percentile("disp", F.lit(0.5)).alias("med"))
    dev = near.join(med, keys)
    mad = dev.groupBy(*keys, "med").agg(F.percentile(F.abs(F.col("disp") - F.col("med")), F.lit(0.5)).alias("mad"))
    limit = F.greatest(F.col("med") + 3.8 * F.col("mad"), F.col("med") + 2.5)
    kept = near.join(mad, keys).withColumn("_in", F.col("disp") <= limit)
    enough = F.count_if("_in").over(Window.partitionBy(*keys)) >= min_points
    return kept.withColumn("_ok", enough).where(F.col("_in") | ~F.col("_ok")).drop("_in", "_ok", "med", "mad")


def score_stats(qc: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Slices, good ones, mean, least and largest score to 3 decimals; 0 without any."""
    s = F.when(~F.isnan("best_score") & (F.abs("best_score") < float("inf")), F.col("best_score"))
    r = lambda c: F.coalesce(F.bround(c, 3), F.lit(0.0))
    return qc.agg(F.count("*").alias("n"), F.count_if("registration_ok").alias("ok"), F.count_if(s >= threshold).alias("passing"), r(F.avg(s)).alias("mean"), r(F.min(s)).alias("min"), r(F.max(s)).alias("max"))


def gate(qc: DataFrame) -> DataFrame:
    """qc, failing in the plan where a slice isn't registered."""
    return qc.where(F.assert_true(F.col("registration_ok"), F.concat(F.lit("slice not registered: "), F.col("slice_id").cast("string"))).isNull())


def affine_fit(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares affine from (x, y) to (u, v) by key, from normal-equation sums (M21): six coefficients."""
    m = {n: F.avg(e) for n, e in {"x": F.col("x"), "y": F.col("y"), "u": F.col("u"), "v": F.col("v")}.items()}
    s = pairs.groupBy(*keys).agg(*[e.alias(f"m{n}") for n, e in m.items()], F.var_pop("x").alias("sxx"), F.var_pop("y").alias("syy"), F.covar_pop("x", "y").alias("sxy"), *[F.covar_pop(a, b).alias(f"s{a}{b}") for a in "xy" for b in "uv"])
    det = F.col("sxx") * F.col("syy") - F.col("sxy") ** 2
    co = {}
    for t in "uv":
        co[f"a_{t}"] = (F.col(f"sx{t}") * F.col("syy") - F.col(f"sy{t}") * F.col("sxy")) / det
        co[f"b_{t}"] = (F.col(f"sy{t}") * F.col("sxx") - F.col(f"sx{t}") * F.col("sxy")) / det
    s = s.withColumns(co)
    return s.select(*keys, *co, *[(F.col(f"m{t}") - F.col(f"a_{t}") * F.col("mx") - F.col(f"b_{t}") * F.col("my")).alias(f"c_{t}") for t in "uv"])
