"""Scalar functions on paths, labels, colours and progress lines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rollup import path_ids  # noqa: F401  E01


def id_set(path: Column, region: Column) -> Column:
    """All digit runs of a path and the region itself, without repeats."""
    return F.array_union(F.transform(F.regexp_extract_all(F.coalesce(path, F.lit("")), F.lit(r"(\d+)")), lambda x: x.cast("int")), F.array(region))


def z_number(stem: Column, ignore_case: bool = True) -> Column:
    """The number after z in a file stem, or null."""
    return F.regexp_extract(stem, r"(?i)z(\d+)" if ignore_case else r"z(\d+)", 1).try_cast("int")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def hex_rgb(code: Column) -> Column:
    """'RRGGBB' to struct<r, g, b>; null where it isn't six hex digits."""
    part = lambda i: F.conv(F.substring(code, i, 2), 16, 10).cast("int")
    return F.when(code.rlike("^[0-9A-Fa-f]{6}$"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def id_rgb(region: Column) -> Column:
    """A fixed colour for each id: bits of id x 2654435761."""
    v = (region.cast("long") * F.lit(2654435761)).bitwiseAND(F.lit(0xFFFFFF))
    return F.struct(F.shiftright(v, 16).cast("int").alias("r"), F.shiftright(v, 8).bitwiseAND(F.lit(255)).cast("int").alias("g"), v.bitwiseAND(F.lit(255)).cast("int").alias("b"))


def progress(line: Column) -> dict[str, Column]:
    """Fields of '[PROGRESS:step=i/n:phase=p(:slices=a/b)?] message'; null for any other line."""
    pattern = r"^\[PROGRESS:([^\]]*)\]\s*(.*)$"
    meta, is_progress = F.regexp_extract(line, pattern, 1), line.rlike(pattern)
    kv = F.str_to_map(meta, F.lit(":"), F.lit("="))
    half = lambda k, i: F.split_part(kv[k], F.lit("/"), F.lit(i)).try_cast("int")
    put = lambda c: F.when(is_progress, c)
    return {"step": put(half("step", 1)), "steps": put(half("step", 2)), "phase": put(kv["phase"]), "slices_done": put(half("slices", 1)), "slices_total": put(half("slices", 2)), "message": put(F.regexp_extract(line, pattern, 2))}


def percent(step: Column, steps: Column, done: Column, total: Column) -> Column:
    """Whole percent of a run, 5 to 98 until it ends."""
    share = F.coalesce(done / F.when(total > 0, total), F.lit(0.0))
    return F.greatest(F.lit(5), F.least(F.lit(98), F.round(((step - 1) + share) / F.greatest(steps, F.lit(1)) * 100, 0).cast("int")))


def job_id(raw: Column, default: str = "default") -> Column:
    """Letters, digits, _ and -, others to -, no - or _ at the ends, 64 characters at most."""
    clean = F.regexp_replace(F.coalesce(raw, F.lit("")), r"[^\p{L}\p{N}_-]", "-")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(clean, r"^[-_]+|[-_]+$", ""), 1, 64), F.lit("")), F.lit(default))


def lenient(raw: Column, kind: str, default) -> Column:
    """A cast that falls back to a default."""
    return F.coalesce(F.trim(raw).try_cast(kind), F.lit(default).cast(kind))


def model_type(name: Column) -> Column:
    """nuclei, cyto3, cyto2, cyto by substring in that order, else cyto3."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.when(low.contains("nuclei"), "nuclei").when(low.contains("cyto3"), "cyto3").when(low.contains("cyto2"), "cyto2").when(low.contains("cyto"), "cyto").otherwise("cyto3")


def diameter_px(px: Column, um: Column, pixel_um: Column) -> Column:
    """Pixels as given, else from microns; only positive values count."""
    return F.coalesce(F.when(px > 0, px), F.when((um > 0) & (pixel_um > 0), um / pixel_um))


def fingerprint(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 12)


def slice_name(number: Column) -> Column:
    """slice_0007."""
    return F.format_string("slice_%04d", number)


def merged_name(first: Column, last: Column) -> Column:
    """z0003-z0007."""
    return F.format_string("z%04d-z%04d", first, last)


def hls(c: Column) -> Column:
    """struct<r, g, b> in 0 to 1 to struct<h, l, s>."""
    r, g, b = c["r"], c["g"], c["b"]
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    light = (top + low) / 2
    part = lambda v: (top - v) / span
    hue = F.when(r == top, part(b) - part(g)).when(g == top, 2 + part(r) - part(b)).otherwise(4 + part(g) - part(r)) / 6
    grey = span == 0
    return F.struct(F.when(grey, 0.0).otherwise(hue - F.floor(hue)).alias("h"), light.alias("l"), F.when(grey, 0.0).when(light <= 0.5, span / (top + low)).otherwise(span / (2 - top - low)).alias("s"))


def rgb(h: Column, light: Column, s: Column) -> Column:
    """Hue, lightness and saturation to struct<r, g, b>, truncated to whole numbers of 255."""
    m2 = F.when(light <= 0.5, light * (1 + s)).otherwise(light + s - light * s)
    m1 = 2 * light - m2

    def level(shift: float) -> Column:
        x = h + shift
        x = x - F.floor(x)
        v = F.when(x < 1 / 6, m1 + (m2 - m1) * x * 6).when(x < 0.5, m2).when(x < 2 / 3, m1 + (m2 - m1) * (2 / 3 - x) * 6).otherwise(m1)
        return (F.when(s == 0, light).otherwise(v) * 255).cast("int")

    return F.struct(level(1 / 3).alias("r"), level(0.0).alias("g"), level(-1 / 3).alias("b"))


def family_rgb(df: DataFrame, region: str, color: str, out: str) -> DataFrame:
    """Adds a region's colour: its own or that of its id, lightness shifted by the id and both held in bounds (E09). Shift and bounds."""
    base = F.coalesce(hex_rgb(F.col(color)), id_rgb(F.col(region)))
    df = df.withColumn("_c", base).withColumn("_c", F.struct(*[(F.col(f"_c.{k}") / 255.0).alias(k) for k in "rgb"])).withColumn("_c", hls(F.col("_c")))
    light = F.least(F.lit(0.78), F.greatest(F.lit(0.28), F.col("_c.l") + (F.pmod(F.col(region) * 37, F.lit(9)) - 4) * 0.028))
    sat = F.least(F.lit(0.95), F.greatest(F.lit(0.35), F.col("_c.s") * 1.08))
    return df.withColumn("_c", F.struct(F.col("_c.h").alias("h"), light.alias("l"), sat.alias("s"))).withColumn(out, rgb(F.col("_c.h"), F.col("_c.l"), F.col("_c.s"))).drop("_c")


def target_label(um: Column) -> Column:
    """native_xy, or the number in its shortest form with um behind."""
    return F.coalesce(F.concat(F.regexp_replace(F.round(um, 6).cast("string"), r"\.0$", ""), F.lit("um")), F.lit("native_xy"))


def channel_tag(name: Column, index: Column) -> Column:
    """c0 or c1 where the stem says so, else ch with the index."""
    low = F.lower(name)
    return F.when(low.contains("_c0"), "c0").when(low.contains("_c1"), "c1").otherwise(F.format_string("ch%02d", index))


def iso(time: Column) -> Column:
    """A time as ISO text to the second with the offset of the session's zone."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ssxxx")


def stamp(time: Column) -> Column:
    """A time as used in file names."""
    return F.date_format(time, "yyyyMMdd_HHmmss")


def _decimals(value: Column, digits: int) -> Column:
    """Half to even of the exact value, as text."""
    return F.call_function("format_number", value.cast("double"), F.lit("0." + "0" * digits))


def fixed(value: Column, digits: int = 4, none: str = "-") -> Column:
    """A number with a fixed count of decimals; `none` for null and NaN."""
    return F.when(value.isNull() | F.isnan(value.cast("double")), none).otherwise(_decimals(value, digits))


def percent_text(share: Column, digits: int = 1) -> Column:
    """A share of one as percent."""
    return F.concat(_decimals(share.cast("double") * 100, digits), F.lit("%"))


def resolved(path: Column) -> Column:
    """An absolute path without empty, . and .. parts."""
    step = lambda done, part: F.when(part.isin("", "."), done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def contained(path: Column, roots: list[str]) -> Column:
    """Whether the resolved path is one of the roots or lies in one."""
    at = resolved(path)
    inside = F.lit(False)
    for r in roots:
        inside = inside | (at == r.rstrip("/")) | at.startswith(r.rstrip("/") + "/")
    return inside


def plain_name(name: Column) -> Column:
    """The name where it is a base name, else null: no folder in it, not . or ..."""
    return F.when(~name.contains("/") & ~name.isin("", ".", ".."), name)
