"""Run configurations: look-ups, rules, sampling modes, parameter precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACEHOLDERS = ["path/to", "YOUR_", "<", "TODO"]


def get(doc: Column, dotted: str, default=None) -> Column:
    """A value of a JSON document by dotted key, with a default."""
    return F.coalesce(F.get_json_object(doc, f"$.{dotted}"), F.lit(default))


def required_text(field: str) -> tuple[str, str, str]:
    return field, "text", f"{field} is required"


def rules() -> list[tuple[str, str, str]]:
    """(field, kind, message) of the run configuration."""
    return [required_text("project.name"), required_text("input.slice_dir"), ("input.pixel_size_um_xy", "positive", "must be a positive number"), ("input.slice_spacing_um", "positive", "must be a positive number"), ("detection.min_size", "natural", "must be a whole number of 0 or more"), ("dedup.neighbor_slices", "natural", "must be a whole number of 0 or more"), ("dedup.r_xy_um", "positive", "must be a positive number"), ("registration.backend", "in:elastix|ants", "unknown backend")]


def issues(configs: DataFrame, doc: str = "doc") -> DataFrame:
    """config_id, field, severity, message for every rule that a document breaks; one pass over the documents."""
    out = []
    for field, kind, message in rules():
        v = F.get_json_object(F.col(doc), f"$.{field}")
        missing = v.isNull() | (F.trim(v) == "")
        num = v.try_cast("double")
        if kind == "text":
            bad, severity = missing, "error"
            odd = F.lit(False)
            for p in PLACEHOLDERS:
                odd = odd | v.contains(p)
            out.append(F.when(~missing & odd, F.struct(F.lit(field).alias("field"), F.lit("warning").alias("severity"), F.lit("placeholder value").alias("message"))))
        elif kind == "positive":
            bad, severity = missing | num.isNull() | (num <= 0), "error"
        elif kind == "natural":
            bad, severity = ~missing & (num.isNull() | (num < 0) | (num != F.floor(num))), "error"
        else:
            bad, severity = ~missing & ~v.isin(kind[3:].split("|")), "error"
        out.append(F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(field).alias("field"), F.lit(severity).alias("severity"), F.lit(message).alias("message"))))
    return configs.select("config_id", F.explode(F.array_compact(F.array(*out))).alias("i")).select("config_id", "i.*")


def sampling_mode(mode: Column, n: Column) -> Column:
    """struct<mode, n>: single or merged; null where the name is unknown (F16)."""
    m = F.lower(F.trim(F.coalesce(mode, F.lit("single"))))
    one = m.isin("", "single", "none", "every", "all")
    tail = F.regexp_extract(m, r"^merge(?:d)?_?(\d*)$", 1)
    many = m.rlike(r"^merge(d)?_?\d*$")
    k = F.coalesce(n, tail.try_cast("int"), F.lit(5))
    return F.when(one, F.struct(F.lit("single").alias("mode"), F.lit(1).alias("n"))).when(many, F.struct(F.lit("merged").alias("mode"), k.alias("n")))


def precedence(tuned: Column, best: Column, config: Column, default: Column) -> Column:
    """Tuned over best over configured over default, key by key (F26). A null value doesn't count."""
    ranked = [F.map_filter(F.coalesce(m, F.create_map().cast("map<string,double>")), lambda k, v: v.isNotNull()) for m in (tuned, best, config)]
    ranked.append(default)
    def without(m: Column, higher: list[Column]) -> Column:
        """The entries whose key no higher map has, so that no key comes twice."""
        return F.map_filter(m, lambda k, v: ~F.array_contains(F.concat(*[F.map_keys(x) for x in higher]), k))

    out = [without(m, ranked[:i]) if i else m for i, m in enumerate(ranked)]
    return F.map_concat(*out)


def ap_index(z: Column, scale: float, offset: int, top: int = 527) -> Column:
    """clamp(int(z scale) + offset), truncating."""
    return F.greatest(F.lit(0), F.least(F.lit(top), (z * scale).cast("int") + offset))


def gated(model: Column, formula: Column, max_dev: int = 30) -> Column:
    """The model's index unless it is too far from the formula's."""
    return F.when(F.abs(model - formula) <= max_dev, model).otherwise(formula)
