"""The algebra of belief and disbelief, as columns."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12
DISCOUNTED = "body_truth_discounted_by_body_falsity"
# What each setting may be; the first is the default.
CHOICES = {
    "body_truth": ("product", "minimum"),
    "body_falsity": ("noisy_or", "maximum"),
    "rule_propagation": ("body_times_rule_weights",),
    "constraint_propagation": ("body_times_constraint_weights_to_violation",),
    "support_aggregation": ("noisy_or", "maximum", "capped_sum"),
    "belnap_status": ("nonzero",),
    "non_atom": ("crisp_filters",),
    "rule_applicability": (DISCOUNTED, "body_truth_only"),
    "constraint_applicability": (DISCOUNTED, "body_truth_only"),
}


class UnsupportedSemantics(ValueError):
    """A setting that no evaluator has; raised before anything is evaluated."""


@dataclass(frozen=True)
class Semantics:
    body_truth: str = "product"
    body_falsity: str = "noisy_or"
    rule_propagation: str = "body_times_rule_weights"
    constraint_propagation: str = "body_times_constraint_weights_to_violation"
    support_aggregation: str = "noisy_or"
    belnap_status: str = "nonzero"
    non_atom: str = "crisp_filters"
    rule_applicability: str = DISCOUNTED
    constraint_applicability: str = DISCOUNTED

    def __post_init__(self):
        for f in fields(self):
            if getattr(self, f.name) not in CHOICES[f.name]:
                raise UnsupportedSemantics(f"{f.name} can't be {getattr(self, f.name)!r}; it is one of {', '.join(CHOICES[f.name])}")

    def with_(self, **settings: str) -> Semantics:
        return replace(self, **settings)

    def truth(self, a: Column, b: Column) -> Column:
        return a * b if self.body_truth == "product" else F.least(a, b)

    def falsity(self, a: Column, b: Column) -> Column:
        return 1 - (1 - a) * (1 - b) if self.body_falsity == "noisy_or" else F.greatest(a, b)

    def rule_applies(self, b: Column, d: Column) -> Column:
        return b * (1 - d) if self.rule_applicability == DISCOUNTED else b

    def constraint_applies(self, b: Column, d: Column) -> Column:
        return b * (1 - d) if self.constraint_applicability == DISCOUNTED else b

    def aggregate(self, c: Column) -> Column:
        """Of a group's positive values; 0 of none."""
        v = F.when(c > 0, c)
        if self.support_aggregation == "noisy_or":
            return F.coalesce(1 - F.product(1 - v), F.lit(0.0))
        if self.support_aggregation == "maximum":
            return F.coalesce(F.max(v), F.lit(0.0))
        return F.least(F.lit(1.0), F.coalesce(F.sum(v), F.lit(0.0)))

    def aggregate_two(self, a: Column, b: Column) -> Column:
        if self.support_aggregation == "noisy_or":
            return 1 - (1 - a) * (1 - b)
        return F.greatest(a, b) if self.support_aggregation == "maximum" else F.least(F.lit(1.0), a + b)


def status(b: Column, d: Column) -> Column:
    has, against = b > EPS, d > EPS
    return F.when(has & against, "both").when(has, "true").when(against, "false").otherwise("neither")


def focus_metric(focus: str, b: Column, d: Column) -> Column | None:
    """What a focus keeps above EPS and ranks by; None where it does neither."""
    return {"support": b, "disbelief": d, "contradiction": F.least(b, d)}.get(focus)
