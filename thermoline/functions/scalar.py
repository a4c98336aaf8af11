"""Column expressions over measurement series. Missing values are NULL; NaN is turned into NULL at ingest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def finite(c: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def number_or_null(c: Column) -> Column:
    return finite(c.try_cast("double"))


def whole_or_null(c: Column) -> Column:
    """A whole number: text and fractions are cut towards zero, what is no number is NULL."""
    number = number_or_null(c)
    return F.when(F.abs(number) < 2.0**63, number.cast("long"))


def warning_codes(value: Column) -> Column:
    """A list of codes from JSON: a list without its NULLs and empty texts, or one value alone; none for NULL, an empty text and what can't be read."""
    v = F.try_parse_json(value)
    many = F.filter(F.try_variant_get(v, "$", "array<string>"), lambda x: x.isNotNull() & (x != ""))
    one = F.try_variant_get(v, "$", "string")
    alone = F.when(one.isNotNull() & (one != ""), F.array(one)).otherwise(F.array().cast("array<string>"))
    return F.coalesce(F.when(F.schema_of_variant(v).startswith("ARRAY"), many), alone)


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def recovery_ratio(x: Column, low: Column, high: Column) -> Column:
    """Share of the way from `low` to `high`, within 0 and 1; NULL where the two are too close to tell."""
    return F.when(F.abs(high - low) >= EPSILON, clip((x - low) / (high - low), 0.0, 1.0))


def directional_recovery(x: Column, low: Column, high: Column, increasing: Column) -> Column:
    """As recovery_ratio for a metric that grows, the mirror image for one that shrinks."""
    falling = F.when(F.abs(low - high) >= EPSILON, clip((low - x) / (low - high), 0.0, 1.0))
    return F.when(increasing, recovery_ratio(x, low, high)).otherwise(falling)


def recovery_from_fit(x: Column, x_m: Column, x_a: Column, increasing: Column) -> Column:
    """A shrinking metric is fitted on its negative, so its references are turned back first."""
    sign = F.when(increasing, F.lit(1.0)).otherwise(F.lit(-1.0))
    return directional_recovery(x, sign * x_m, sign * x_a, increasing)


def sigmoid(t: Column, x_m: Column, x_a: Column, t0: Column, width: Column) -> Column:
    return x_m + (x_a - x_m) / (1.0 + F.exp(-(t - t0) / width))


def safe_fraction(num: Column, den: Column) -> Column:
    return num / F.when(den.isNotNull(), F.greatest(den, F.lit(EPSILON)))


def projection(x: Column, y: Column, angle_deg: Column) -> Column:
    return x * F.cos(F.radians(angle_deg)) + y * F.sin(F.radians(angle_deg))


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def blend(a: Column, b: Column, weight: float) -> Column:
    w = min(1.0, max(0.0, weight))
    return (1.0 - w) * b + w * a


def quality_alpha(quality: Column, alpha: float = 0.35, floor: float = 0.08) -> Column:
    """Smoothing weight that follows quality between a floor and `alpha`; missing quality counts as 0."""
    alpha = min(0.99, max(0.01, alpha))
    floor = min(alpha, max(0.01, floor))
    return floor + (alpha - floor) * clip(F.coalesce(quality, F.lit(0.0)), 0.0, 1.0)


def polar(dx: Column, dy: Column) -> tuple[Column, Column]:
    return F.sqrt(dx * dx + dy * dy), F.atan2(dy, dx)


def rotate(x: Column, y: Column, theta: Column) -> tuple[Column, Column]:
    return x * F.cos(theta) - y * F.sin(theta), x * F.sin(theta) + y * F.cos(theta)


# Route aliases of the two families of objects.
WIRE_ROUTES = {"A": "x_route_a", "B": "kappa_fit", "C": "kappa_route_c"}
BRAIDED_ROUTES = {"A": "length_axis", "B": "diameter_max", "C": "area_proj"}


def family(preset: Column) -> Column:
    return F.when(F.coalesce(preset, F.lit("")).startswith("braided"), F.lit("braided")).otherwise(F.lit("wire"))


def route_alias(preset: Column, metric_key: Column) -> Column:
    def of(routes: dict[str, str]) -> Column:
        out = F.lit(None).cast("string")
        for alias, key in routes.items():
            out = F.when(metric_key == key, F.lit(alias)).otherwise(out)
        return out

    return F.when(family(preset) == "braided", of(BRAIDED_ROUTES)).otherwise(of(WIRE_ROUTES))


#: The words of a gate reason, tried in this order, and its label.
REASON_LABELS = (
    (("temperature",), "temperature"),
    (("attachment", "leak"), "attachment"),
    (("centerline",), "centerline"),
    (("endpoint",), "endpoint"),
    (("dynamic_range", "too_small"), "range"),
    (("insufficient",), "points"),
    (("monotonic",), "monotonic"),
)


def reason_label(reason: Column, default: str = "other") -> Column:
    low, out = F.lower(reason), F.lit(default)
    for words, label in reversed(REASON_LABELS):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, F.lit(label)).otherwise(out)
    return F.when(reason.isNull() | (reason == ""), F.lit(None).cast("string")).otherwise(out)


def display_time(created_at: Column, zone: str = "Asia/Shanghai") -> Column:
    """An ISO time in UTC, as minutes in a zone; needs a session in UTC."""
    return F.date_format(F.from_utc_timestamp(created_at.try_cast("timestamp"), zone), "yyyy-MM-dd HH:mm")


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"[^A-Za-z0-9._-]", "_")


def parse_roi(raw: Column) -> Column:
    """`[x0, y0, x1, y1]` or `x0,y0,x1,y1` as a struct of the box, or of the error."""
    parts = F.transform(F.split(F.regexp_replace(raw, r"[\[\]\s]", ""), ","), lambda x: x.try_cast("int"))
    x0, y0, x1, y1 = (F.get(parts, F.lit(k)) for k in range(4))
    error = (
        F.when(F.coalesce(F.trim(raw), F.lit("")) == "", F.lit("missing"))
        .when(F.size(parts) != 4, F.lit("not_four_numbers"))
        .when(x0.isNull() | y0.isNull() | x1.isNull() | y1.isNull(), F.lit("not_integers"))
        .when((x0 < 0) | (y0 < 0) | (x1 < 0) | (y1 < 0), F.lit("negative"))
        .when((x0 >= x1) | (y0 >= y1), F.lit("reversed"))
        .when((x1 - x0 < 2) | (y1 - y0 < 2), F.lit("too_small"))
    )
    good = error.isNull()
    return F.struct(*(F.when(good, c).alias(n) for c, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))), error.alias("error"))


def clip_roi(roi: Column, width: int, height: int) -> Column:
    """The box cut to the frame as a struct of the box, or of the error: what is left must overlap the frame and be two pixels wide and high."""
    box = {c: F.greatest(F.lit(0), F.least(roi[c], F.lit(most))) for c, most in (("x0", width), ("y0", height), ("x1", width), ("y1", height))}
    wide, high = box["x1"] - box["x0"], box["y1"] - box["y0"]
    error = F.when((wide <= 0) | (high <= 0), F.lit("outside_frame")).when((wide < 2) | (high < 2), F.lit("too_small"))
    return F.struct(*(F.when(error.isNull(), x).alias(c) for c, x in box.items()), error.alias("error"))


def expand_roi(roi: Column, margin: float, width: int, height: int) -> Column:
    """The box grown on each side by a share of its size, within the frame."""
    dx, dy = (roi["x1"] - roi["x0"]) * margin, (roi["y1"] - roi["y0"]) * margin
    return F.struct(
        F.greatest(F.lit(0), F.floor(roi["x0"] - dx).cast("int")).alias("x0"),
        F.greatest(F.lit(0), F.floor(roi["y0"] - dy).cast("int")).alias("y0"),
        F.least(F.lit(width), F.ceil(roi["x1"] + dx).cast("int")).alias("x1"),
        F.least(F.lit(height), F.ceil(roi["y1"] + dy).cast("int")).alias("y1"),
    )


def media_path_allowed(path: Column, suffixes: tuple[str, ...] = ("mp4", "png", "csv", "json", "jpg")) -> Column:
    kinds = "|".join(suffixes)
    return path.rlike(rf"(?i)^[^/\\].*\.({kinds})$") & ~path.rlike(r"(^|/)\.\.(/|$)") & (F.size(F.split(path, "/")) <= 4)


def merge_maps(base: Column, override: Column) -> Column:
    """Values of `override` where it has the key, else of `base`."""
    return F.map_zip_with(base, override, lambda _, a, b: F.coalesce(b, a))


def missing_outputs(expected: Column, existing: Column) -> Column:
    return F.array_except(expected, existing)


def wire_quality(rmse: Column, coverage: Column) -> Column:
    return F.exp(-rmse / 4.0) * coverage
