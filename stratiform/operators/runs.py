"""Runs as relations: serialisation, reports, archive and pins, calibration pairs, jobs and projects, whole pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import filters, kernels, mapping, registration, rollup

ERRORS = {"not_found": 404, "busy": 409, "invalid": 400, "forbidden": 403, "internal": 500}  # R21


class RunError(RuntimeError):
    """An error with one of the codes of ERRORS."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code, self.status = code, ERRORS[code]


def serialise(meta: DataFrame, metrics: DataFrame, files: DataFrame, pinned: list[str]) -> DataFrame:
    """One row a run (R12): names, backend label, pin, verdict, metrics after and before as JSON, and which artifacts there are.

    meta: run_name, input_source, backend, laplacian, updated_at; metrics: run_name, stage, metric, value; files: run_name, file.
    """
    m = registration.METRICS
    wide = registration.metrics_wide(metrics, ["run_name", "stage"])
    post, pre = (wide.where(F.col("stage") == s).select("run_name", F.struct(*m).alias(s)) for s in ("post", "pre"))
    got = files.groupBy("run_name").agg(F.array_sort(F.collect_set("file")).alias("artifacts"))
    j = meta.join(post, "run_name", "left").join(pre, "run_name", "left").join(got, "run_name", "left")
    verdict = registration.verdict({k: F.col(f"post.{k}") for k in m}, {k: F.col(f"pre.{k}") for k in m})
    base = F.coalesce(F.nullif(F.upper(F.trim("backend")), F.lit("")), F.lit("UNKNOWN"))
    return j.select(
        "run_name", F.coalesce(F.nullif(text.base_name(F.col("input_source")), F.lit("")), F.col("run_name")).alias("input_name"), F.when(F.col("laplacian"), F.concat(base, F.lit(" + Laplacian"))).otherwise(base).alias("pipeline_label"),
        F.col("run_name").isin(pinned).alias("pinned"), "updated_at", verdict.alias("verdict"), F.to_json("post").alias("metrics"), F.to_json("pre").alias("pre_metrics"), F.coalesce("artifacts", F.array().cast("array<string>")).alias("artifacts"))


def report(runs: DataFrame) -> DataFrame:
    """The rows of a run report's index (K06): place by NCC, each metric with its difference as text, verdict counts in all."""
    m = registration.METRICS
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("NCC"), "run_name"))  # a run is one row
    out = runs.withColumns({"place": place, **{f"{c}_text": F.concat(text.fixed(F.col(c)), F.lit(" ("), F.when(F.col(f"{c}_delta") >= 0, "+").otherwise(""), text.fixed(F.col(f"{c}_delta")), F.lit(")")) for c in m}})
    return out.select("place", "run_name", "verdict", *[f"{c}_text" for c in m], F.count("*").over(Window.partitionBy("verdict")).alias("runs_of_verdict"))


def report_html(rows: DataFrame) -> DataFrame:
    """One row a run with its page (K06): names escaped, links by run name."""
    safe = F.replace(F.replace(F.replace(F.col("run_name"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    cells = [F.concat(F.lit("<td>"), F.col(f"{c}_text"), F.lit("</td>")) for c in registration.METRICS]
    return rows.select("run_name", F.concat(F.lit('<tr class="'), F.col("verdict"), F.lit('"><td><a href="'), F.url_encode("run_name"), F.lit('/report.html">'), safe, F.lit("</a></td>"), *cells, F.lit("</tr>")).alias("html"))


def archive(runs: DataFrame, gone: DataFrame, at: Column) -> DataFrame:
    """Runs with archived_as set for those in `gone` (R13): the time's stamp and the name, with a number from 1 behind where a name repeats; they are unpinned. runs: run_name, pinned, run_id."""
    name = F.concat_ws("_", text.stamp(at), "run_name")
    n = F.row_number().over(Window.partitionBy("run_name").orderBy("run_id")) - 1
    marked = runs.join(gone.select("run_name").distinct().withColumn("_gone", F.lit(True)), "run_name", "left")
    unique = F.when(n > 0, F.concat(name, F.lit("_"), n.cast("string"))).otherwise(name)
    return marked.select("run_id", "run_name", (F.col("pinned") & F.col("_gone").isNull()).alias("pinned"), F.when(F.col("_gone"), unique).alias("archived_as"))


def pin(state: DataFrame, run: str, on: bool = True) -> DataFrame:
    """The pinned names after one is set or taken away."""
    rest = state.where(F.col("run_name") != run)
    return rest.unionByName(state.sparkSession.createDataFrame([(run,)], "run_name string")) if on else rest


def calibration_pairs(existing: DataFrame, new: DataFrame, most: int) -> DataFrame:
    """Training pairs after new ones are added with the next numbers and the oldest beyond `most` are dropped (K08). existing: id, name; new: ord, name. A pair is one row, `most` some hundreds."""
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    added = new.withColumn("_n", F.row_number().over(Window.orderBy("ord"))).crossJoin(top).select((F.col("_top") + F.col("_n")).cast("long").alias("id"), "name")
    every = existing.select(F.col("id").cast("long").alias("id"), "name").unionByName(added)
    return every.orderBy(F.desc("id")).limit(most)


def compare_alignment(scores: DataFrame) -> DataFrame:
    """Scores before and after with their difference and a warning where the edge score fell (R17). scores: key, before, after, before_edge, after_edge."""
    return scores.withColumns({"delta": F.col("after") - F.col("before"), "score_warning": F.col("after_edge") < F.col("before_edge")})


def score_alignment(images: DataFrame, keys: list[str], real: str = "real", before: str = "before", after: str = "after") -> DataFrame:
    """before, after, before_edge, after_edge, delta and score_warning of each image (R17): structural similarity of the real image to the label before and after, of the values and of
    their Sobel edges. Each pair is scaled by the larger of both ranges, 1 at least."""
    names = [real, before, after]
    px = images.select(*keys, "y", "x", *[F.col(c).cast("double").alias(f"raw_{i}") for i, c in enumerate(names)])
    for i in range(3):
        px = px.join(filters.sobel(px, keys, f"raw_{i}").withColumnRenamed("edge", f"edge_{i}"), [*keys, "y", "x"])
    pairs = F.array(*[F.struct(F.lit(f"{kind}_{i}").alias("pair"), F.col(f"{kind}_0").alias("a"), F.col(f"{kind}_{i}").alias("b")) for kind in ("raw", "edge") for i in (1, 2)])
    tall = px.select(*keys, "y", "x", F.explode(pairs).alias("p")).select(*keys, "y", "x", "p.*")
    span = tall.groupBy(*keys, "pair").agg(F.greatest(F.max("a") - F.min("a"), F.max("b") - F.min("b"), F.lit(1.0)).alias("_span"))
    scaled = tall.join(span, [*keys, "pair"]).withColumns({c: F.col(c) / F.col("_span") for c in ("a", "b")})
    s = kernels.ssim(scaled, [*keys, "pair"]).groupBy(*keys).agg(*[F.max(F.when(F.col("pair") == f"{kind}_{i}", F.col("ssim"))).alias(n) for kind, i, n in (("raw", 1, "before"), ("raw", 2, "after"), ("edge", 1, "before_edge"), ("edge", 2, "after_edge"))])
    return compare_alignment(s)


def start(jobs: DataFrame, job: str) -> DataFrame:
    """jobs with the job running; an error where it already runs."""
    if not jobs.where((F.col("job_id") == job) & (F.col("status") == "running")).isEmpty():
        raise RunError("busy", f"job {job} is running")
    rest = jobs.where(F.col("job_id") != job)
    return rest.unionByName(jobs.sparkSession.createDataFrame([(job, "running")], "job_id string, status string"))


def cancel(jobs: DataFrame, job: str) -> DataFrame:
    """jobs with the job cancelled if it runs or waits; an error where there is no such job."""
    if jobs.where(F.col("job_id") == job).isEmpty():
        raise RunError("not_found", f"no job {job}")
    return jobs.withColumn("status", F.when((F.col("job_id") == job) & F.col("status").isin("running", "queued"), "cancelled").otherwise(F.col("status")))


def project_overview(projects: DataFrame, samples: DataFrame) -> DataFrame:
    """Projects with their samples' count by state (R16), without samples 0."""
    states = ["pending", "queued", "running", "done", "error"]
    s = samples.groupBy("project_id").agg(F.count("*").alias("samples"), *[F.count_if(F.col("status") == x).alias(x) for x in states])
    return projects.join(s, "project_id", "left").fillna(0, ["samples", *states])


def overrides(configs: DataFrame, config: str = "config", payload: str = "payload") -> DataFrame:
    """Effective values of a JSON configuration under a run's JSON payload (F25): inputDir, pixelSizeUm, the first of channels, alignMode and confidenceThreshold override where they aren't empty.

    A pixel size that is no number is kept as it came; a threshold that is none doesn't override. Values are text, as in the document.
    """
    from_payload, base = lambda p: F.get_json_object(payload, p), lambda p: F.get_json_object(config, p)
    full = lambda c: F.nullif(c, F.lit(""))
    number = lambda c: F.coalesce(c.try_cast("double").cast("string"), c)
    out = {
        "slice_dir": F.coalesce(full(F.trim(from_payload("$.inputDir"))), base("$.input.slice_dir")),
        "pixel_size_um_xy": F.coalesce(number(full(from_payload("$.params.pixelSizeUm"))), base("$.input.pixel_size_um_xy")),
        "active_channel": F.coalesce(from_payload("$.channels[0]"), base("$.input.active_channel")),
        "align_mode": F.coalesce(full(from_payload("$.params.alignMode")), base("$.registration.align_mode")),
        "min_score": F.coalesce(full(from_payload("$.params.confidenceThreshold")).try_cast("double"), base("$.detection.min_score").try_cast("double")),
    }
    return configs.withColumns(out).drop(config, payload)


def analyse(cells: DataFrame, structure: DataFrame, raster: DataFrame | None, *, height: int = 0, width: int = 0) -> dict[str, DataFrame]:
    """The whole way from detected cells to results (R10): regions by raster look-up (or the cells' own), names attached, leaf and hierarchy counts, and a slice summary."""
    found = mapping.look_up_slice(cells, raster, height, width) if raster is not None else cells.withColumn("mapping_status", F.when(F.col("region_id") == 0, "outside_atlas").otherwise("ok"))
    mapped = mapping.attach_structure(found, structure)
    leaf, hierarchy = rollup.aggregate_by_region(mapped, structure)
    slices = mapped.groupBy("slice_id").agg(F.count("*").alias("cells"), F.count_if(F.col("mapping_status") == "ok").alias("mapped"), F.countDistinct("region_id").alias("regions"))
    return {"mapped": mapped, "leaf": leaf, "hierarchy": hierarchy, "slices": slices}


def volume_summary(voxels: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of a registered volume against its template (R11): similarity of signals, overlap of masks, and staining, by key. voxels: registered, template, annotation."""
    s = registration.similarity(voxels, keys, "registered", "template")
    from .raster import staining_by

    return s.join(staining_by(voxels.withColumn("signal", F.col("registered")), keys), keys)
