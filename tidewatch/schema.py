"""Column roles of an entity time series."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Roles:
    """Names of the columns that play each part; every operator takes them from here."""

    entity: str = "engine"
    order: str = "cycle"
    mode: str = "op_mode"
    settings: tuple[str, ...] = ("op1",)
    sensors: tuple[str, ...] = ("s1", "s2", "s3")
    healthy: float = 0.30
    window: int = 10
    split: str = "split"

    @property
    def keys(self) -> list[str]:
        return [self.entity, self.order]

    @property
    def features(self) -> list[str]:
        return [f"{kind}_{s}" for kind in ("mean", "std", "slope") for s in self.sensors]


@dataclass(frozen=True)
class Rule:
    """A threshold rule: an order statistic (``quantile``) or mean plus k standard deviations."""

    rule_id: str
    kind: str
    value: float


# The registered threshold rules, onset policies and alert parameters.
RULES = (
    Rule("quantile_0.900", "quantile", 0.90),
    Rule("quantile_0.950", "quantile", 0.95),
    Rule("quantile_0.975", "quantile", 0.975),
    Rule("quantile_0.990", "quantile", 0.99),
    Rule("quantile_0.995", "quantile", 0.995),
    Rule("mean_plus_1.0_std", "mean_plus_std", 1.0),
    Rule("mean_plus_1.5_std", "mean_plus_std", 1.5),
    Rule("mean_plus_2.0_std", "mean_plus_std", 2.0),
)
EWMA = (None, 0.2, 0.5, 0.8)
PERSISTENCE = (1, 3, 5, 8)
#: (policy_id, share of life after onset, semantics, used for selection)
POLICIES = (
    ("normalized_life_last_10pct_endpoint", 0.10, "endpoint", True),
    ("normalized_life_last_20pct_endpoint", 0.20, "endpoint", True),
    ("normalized_life_last_30pct_endpoint", 0.30, "endpoint", True),
    ("normalized_life_last_20pct_full_window", 0.20, "full_window", False),
    ("normalized_life_last_30pct_full_window", 0.30, "full_window", False),
)
# Fixed value: the most false positives of a thousand healthy endpoints that a feasible policy has.
FEASIBLE_PER_1000 = 60.0
# What an explanation is and isn't, as every row of an inference timeline says.
EXPLANATION = {
    "explanation_type": "pca_reconstruction_error_contribution",
    "scope": "local_model_fidelity_explanation",
    "feature_space": "normalized_feature_space",
    "causality": "non_causal",
    "shap": "not_shap",
}
# The registered parameter sets of each detector.
DETECTOR_SETS = {
    "pca": [{"n_components": v} for v in (0.90, 0.95, 0.99)],
    "one_class_svm": [{"nu": v} for v in (0.01, 0.05, 0.10)],
    "isolation_forest": [{"max_samples": v, "n_estimators": 300.0} for v in (256.0, 1024.0, 5000.0)],
    "lof": [{"n_neighbors": v} for v in (20.0, 35.0, 50.0)],
}
#: Our names of registered detectors and parameters, and the parameters' types.
DETECTOR_NAMES = {"one_class_svm": "one_class"}
PARAMETER_NAMES = {"n_components": ("variance", float), "nu": ("nu", float), "max_samples": ("most", int), "n_estimators": ("trees", int), "n_neighbors": ("neighbors", int)}
#: Detectors and settings of a detector study: the registered sets.
DETECTOR_GRID = tuple((DETECTOR_NAMES.get(d, d), {PARAMETER_NAMES[k][0]: PARAMETER_NAMES[k][1](v) for k, v in p.items()}) for d, sets in DETECTOR_SETS.items() for p in sets)
# Fixed value: the median delay, in cycles, that a policy should keep.
DELAY_ASPIRATION = 12.0


@dataclass(frozen=True)
class Grid:
    """Axes of an alert-policy study."""

    detectors: tuple[str, ...]
    contexts: tuple[str, ...] = ("global", "per_mode")
    rules: tuple[Rule, ...] = RULES
    ewma: tuple[float | None, ...] = EWMA
    persistence: tuple[int, ...] = PERSISTENCE
    policies: tuple[tuple, ...] = field(default=POLICIES)
