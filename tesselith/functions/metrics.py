"""Column builders on frame metrics: coercion, qualities, classes and weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other names of a metric, in the order in which they are tried.
ALIASES = {
    "fwhm": ("shape_fwhm", "fwhm", "median_fwhm"),
    "star_count": ("shape_star_count", "star_count", "stars"),
    "roundness": ("roundness", "median_roundness"),
    "alignment_rms": ("alignment_rms", "rms"),
    "snr": ("snr",),
}
WEIGHT_NAMES = ("fwhm", "roundness", "star_count", "snr", "alignment_rms", "coverage")


def finite(value: Column, default: Column | None = None) -> Column:
    """A number, or null (or the default) where it is none, NaN or infinite. Text is read as a number."""
    number = value.try_cast("double")
    fine = F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)
    return fine if default is None else F.coalesce(fine, default)


def aliased(columns: list[str], metric: str, nested: Column | None = None) -> Column:
    """The first finite one of a metric's names among ``columns``, else ``nested``."""
    found = [finite(F.col(c)) for c in ALIASES.get(metric, (metric,)) if c in columns]
    return F.coalesce(*found, *([finite(nested)] if nested is not None else []), F.lit(None).cast("double"))


def stack_quality(stars: Column, fwhm: Column, rms: Column, has_mask: Column) -> Column:
    base = F.when(fwhm > 0, stars / F.greatest(fwhm, F.lit(0.1))).otherwise(stars)
    base = F.when((rms > 0) & (rms < 999), base / (1 + rms / 10)).otherwise(base)
    return F.when(has_mask, base * 1.1).otherwise(base)


def temporal_quality(quality: Column, stars: Column, fwhm: Column) -> Column:
    return F.coalesce(finite(quality), stars / F.greatest(F.coalesce(fwhm, F.lit(0.0)), F.lit(0.1)))


def anchor_quality(stars: Column, fwhm: Column) -> Column:
    return F.when(fwhm > 0, stars / fwhm).otherwise(stars)


def trail_reason(roundness: Column, stars: Column, least_roundness: float, least_stars: float) -> Column:
    """Null for a frame that stays. A shape that isn't known is never taken for a good one."""
    unknown = roundness.isNull() | stars.isNull() | (roundness <= 0) | (roundness > 1) | (stars < least_stars)
    return F.when(unknown, "missing_shape_measurement").when(roundness < least_roundness, "elongated_stars")


def trail_assessment(
    stars: Column, roundness: Column, elongation: Column, excess: Column, direction: Column, tangential: Column, middle: dict[str, Column], spread: dict[str, Column], least_stars: float = 8
) -> Column:
    """(trail_class, cause, confidence, penalty) of a frame beside its session's ``middle`` and ``spread`` of roundness and excess.

    A spread that is unknown or 0 counts as 0.05 (roundness) or 0.25 (excess), an unknown middle as the frame's own."""
    usual = {"roundness": 0.05, "excess": 0.25}
    at = {"roundness": F.coalesce(middle["roundness"], roundness), "excess": F.coalesce(middle["excess"], excess)}
    by = {k: F.when(spread[k] > 0, spread[k]).otherwise(v) for k, v in usual.items()}
    zero = F.lit(0.0)
    coherent = F.greatest(F.coalesce(direction, zero), F.coalesce(tangential, zero))

    def trailed(sigmas: float, most_round: float, least_long: float, least_excess: float, least_coherent: float) -> Column:
        round_ = roundness <= F.least(F.lit(most_round), at["roundness"] - sigmas * by["roundness"])
        long = (elongation >= least_long) & (excess >= F.greatest(F.lit(least_excess), at["excess"] + sigmas * by["excess"]))
        return (stars >= least_stars) & round_ & long & (coherent >= least_coherent)

    unknown = stars.isNull() | roundness.isNull() | elongation.isNull() | excess.isNull()
    severe, moderate = trailed(3.0, 0.65, 1.5, 1.0, 0.65), trailed(2.0, 0.75, 1.25, 0.5, 0.40)
    cause = (
        F.when(tangential >= F.greatest(F.coalesce(direction, zero), F.lit(0.45)), "field_rotation").when(direction >= 0.45, "tracking").when(elongation >= 1.25, "optical_or_mixed").otherwise("unclassified")
    )
    sure = lambda base, slope: F.least(F.greatest(base + slope * coherent, zero), F.lit(1.0))
    made = lambda kind, why, confidence, penalty: F.struct(F.lit(kind).alias("trail_class"), why.alias("cause"), confidence.alias("confidence"), F.lit(penalty).alias("penalty"))
    none = made("unreliable", F.lit("unclassified"), zero, 1.0)
    return (
        F.when(unknown, none).when(severe, made("severe", cause, sure(0.55, 0.35), 0.0)).when(moderate, made("moderate", cause, sure(0.35, 0.45), 0.65)).when(stars < least_stars, none).otherwise(made("none", cause, sure(0.5, 0.3), 1.0))
    )


def trail_excluded(trail_class: Column, confidence: Column) -> Column:
    return F.coalesce((trail_class == "severe") & (confidence >= 0.80), F.lit(False))


def score_weight(score: Column, trail_class: Column) -> Column:
    clipped = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    penalty = F.when(trail_class == "severe", 0.0).when(trail_class == "moderate", 0.65).otherwise(1.0)
    return F.least(F.greatest((0.25 + 0.75 * clipped) * penalty, F.lit(0.0)), F.lit(2.0))


def sane_weight(weight: Column) -> Column:
    number = finite(weight)
    return F.when(number > 0, F.least(F.greatest(number, F.lit(0.25)), F.lit(2.0))).otherwise(1.0)


def parsed_weights(text: Column) -> Column:
    """A map of known names to positive weights, from a JSON object or from ``name=value`` pairs with , or ; between."""
    flat = F.when(F.trim(text).startswith("{"), F.from_json(text, "map<string,string>")).otherwise(
        F.call_function("str_to_map", F.regexp_replace(F.regexp_replace(text, r"\s+", ""), ";", ","), F.lit(","), F.lit("="))
    )
    known = F.map_filter(flat, lambda k, v: F.lower(F.trim(k)).isin(*WEIGHT_NAMES) & F.coalesce(finite(v) > 0, F.lit(False)))
    return F.transform_values(known, lambda k, v: v.try_cast("double"))


def first_reason(reasons: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The name of the first condition that holds."""
    head, *rest = reasons
    chain = reduce(lambda c, r: c.when(*r), rest, F.when(*head))
    return chain if otherwise is None else chain.otherwise(otherwise)
