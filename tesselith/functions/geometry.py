"""Column builders on 2 x 3 affine matrices and on transforms' qualities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesselith.functions.metrics import first_reason


@dataclass(frozen=True)
class Affine:
    """x' = a x + b y + tx, y' = c x + d y + ty, as columns."""

    a: Column
    b: Column
    c: Column
    d: Column
    tx: Column
    ty: Column

    @classmethod
    def of(cls, prefix: str = "") -> Affine:
        return cls(*(F.col(prefix + n) for n in ("a", "b", "c", "d", "tx", "ty")))

    def after(self, first: Affine) -> Affine:
        """This one applied to the result of ``first``."""
        return Affine(
            self.a * first.a + self.b * first.c,
            self.a * first.b + self.b * first.d,
            self.c * first.a + self.d * first.c,
            self.c * first.b + self.d * first.d,
            self.a * first.tx + self.b * first.ty + self.tx,
            self.c * first.tx + self.d * first.ty + self.ty,
        )

    def inverse(self) -> Affine:
        """Null where the matrix is singular."""
        det = F.nullif(self.a * self.d - self.b * self.c, F.lit(0.0))
        a, b, c, d = self.d / det, -self.b / det, -self.c / det, self.a / det
        return Affine(a, b, c, d, -(a * self.tx + b * self.ty), -(c * self.tx + d * self.ty))

    def rotation(self) -> Column:
        return F.degrees(F.atan2(self.c, self.a))

    def scale(self) -> Column:
        return F.hypot(self.a, self.c)

    def apply(self, x: Column, y: Column) -> tuple[Column, Column]:
        return self.a * x + self.b * y + self.tx, self.c * x + self.d * y + self.ty

    def columns(self, prefix: str = "", digits: int | None = None) -> list[Column]:
        own = (self.a, self.b, self.c, self.d, self.tx, self.ty)
        return [(v if digits is None else F.round(v, digits)).alias(prefix + n) for v, n in zip(own, ("a", "b", "c", "d", "tx", "ty"), strict=True)]


@dataclass(frozen=True)
class Limits:
    """What a registration must meet."""

    inliers: int = 4
    ratio: float = 0.15
    rms: float = 4.0
    translation: float = 1500.0
    rotation: float = 10.0
    scale_low: float = 0.95
    scale_high: float = 1.05


#: What the alignment over the whole night must meet.
GLOBAL_LIMITS = Limits(ratio=0.1, translation=3000.0, rotation=20.0, scale_low=0.96, scale_high=1.04)
#: A residual that isn't known counts as this.
NO_RMS = 999.0


def validation(matches: Column, inliers: Column, rms: Column, m: Affine, limits: Limits = Limits()) -> Column:
    """``accepted``, or why a transform is not taken: the first reason in a fixed order. The matrix may be null."""
    ratio = F.coalesce(F.try_divide(inliers.cast("double"), matches), F.lit(0.0))
    return first_reason(
        [
            (m.a.isNull() & (F.coalesce(matches, F.lit(0)) == 0), "phase_correlation_failed"),
            (m.a.isNull(), "insufficient_matches"),
            (F.coalesce(inliers, F.lit(0)) < limits.inliers, "insufficient_inliers"),
            (ratio < limits.ratio, "low_inlier_ratio"),
            (F.coalesce(rms, F.lit(NO_RMS)) > limits.rms, "high_rms"),
            (F.hypot(m.tx, m.ty) > limits.translation, "high_translation"),
            (F.abs(m.rotation()) > limits.rotation, "high_rotation"),
            (~m.scale().between(limits.scale_low, limits.scale_high), "invalid_scale"),
        ],
        "accepted",
    )


def confidence(ratio: Column, rms: Column, response: Column, spatial: Column, limits: Limits = Limits()) -> Column:
    """The class of an accepted transform; measures that are missing speak against it."""
    measured = lambda c, default: F.coalesce(c, F.lit(default))
    good = (measured(ratio, 0.0) >= max(2 * limits.ratio, 0.5)) & (measured(rms, NO_RMS) <= limits.rms / 2) & (measured(response, 0.0) >= 0.15) & (measured(spatial, 0.0) >= 0.01)
    return F.when(good, "accepted").otherwise("low_confidence")


def confidence_reason(response: Column, ratio: Column, rms: Column, spatial: Column) -> Column:
    """What speaks for a transform, as text; what is missing counts as in the checks. Halves go to the even digit."""
    shown = lambda c, default, digits: F.format_string(f"%.{digits}f", F.bround(F.coalesce(c, F.lit(default)), digits))
    parts = [("phase_response", shown(response, 0.0, 4)), ("inlier_coverage", shown(ratio, 0.0, 3)), ("rms", shown(rms, NO_RMS, 3)), ("spatial_coverage", shown(spatial, 0.0, 4))]
    return F.concat_ws("; ", *(F.concat(F.lit(f"{n}="), v) for n, v in parts), F.lit("motion=plausible"))


@dataclass(frozen=True)
class AlignmentGate:
    """What the residual of an aligned frame must meet."""

    confidence: float = 0.15
    rms: float = 3.0
    shift: float = 1.5
    coverage: float = 0.20


def alignment_decision(checked: Column, confidence_: Column, rms: Column, coverage: Column, shift_x: Column, shift_y: Column, gate: AlignmentGate = AlignmentGate()) -> Column:
    good = (confidence_ >= gate.confidence) & (rms <= gate.rms) & (coverage >= gate.coverage) & (F.hypot(shift_x, shift_y) <= gate.shift)
    low = F.coalesce(coverage, F.lit(0.0)) < gate.coverage
    return F.when(~checked, "unverified").when(low, "insufficient_overlap").when(good, "verified").otherwise("failed_quality")
