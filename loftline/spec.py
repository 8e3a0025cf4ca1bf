"""Parameters of a listing query, validated once and never pasted into SQL."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class ScoringParams:
    """Cut points of the sub-scores (fixed values: defaults of the scoring model)."""

    home_size_tier1_sqft: float = 2000.0
    home_size_tier2_sqft: float = 3000.0
    lot_size_cap_acres: float = 8.0
    price_floor_quantile: float = 0.01
    price_ceiling_quantile: float = 0.95
    school_dist_full_points_miles: float = 1.0
    school_dist_zero_points_miles: float = 20.0
    max_violent_crime_100k: float = 720.0
    max_property_crime_100k: float = 5526.0
    drive_time_max_minutes: float = 60.0


#: Default weight of each feature.
DEFAULT_WEIGHTS: dict[str, float] = {
    "price": 20,
    "home_size_sqft": 7,
    "lot_size_acres": 8,
    "beds": 3,
    "baths": 2,
    "drive_time": 8,
    "kitchen_quality": 6,
    "bathroom_quality": 5,
    "general_interior_quality": 5,
    "general_exterior_quality": 5,
    "house_style": 3,
    "privacy_level": 7,
    "view_rating": 3,
    "land_usability": 4,
    "waterfront_quality": 3,
    "road_exposure": 8,
    "vegetation_density": 2,
    "positive_features_score": 2,
    "negative_features_severity": 6,
    "dedicated_office": 10,
    "avg_risk_severity": 5,
    "avg_crime_severity": 6,
    "avg_school_rating": 10,
    "avg_school_distance": 3,
}

#: How far each weight's slider goes, from 0.
SLIDER_ENDS: dict[str, float] = {
    "price": 50,
    "home_size_sqft": 20,
    "lot_size_acres": 20,
    "beds": 15,
    "baths": 15,
    "drive_time": 20,
    "avg_school_rating": 25,
    "avg_school_distance": 15,
    "kitchen_quality": 15,
    "bathroom_quality": 15,
    "general_interior_quality": 15,
    "general_exterior_quality": 15,
    "house_style": 15,
    "dedicated_office": 25,
    "privacy_level": 20,
    "view_rating": 15,
    "land_usability": 15,
    "waterfront_quality": 15,
    "road_exposure": 20,
    "vegetation_density": 15,
    "positive_features_score": 15,
    "negative_features_severity": 20,
    "avg_risk_severity": 20,
    "avg_crime_severity": 20,
}
SLIDER_STEP = 0.5

RANKING_MODES = ("score", "ai")
RATINGS = ("yes", "maybe", "no")


def normalised_weights(weights: Mapping[str, float]) -> dict[str, float]:
    """Each weight over the sum of the positive ones; unchanged where that sum is 0."""
    total = sum(w for w in weights.values() if w > 0)
    return {k: w / total for k, w in weights.items()} if total else dict(weights)


def on_sliders(weights: Mapping[str, float]) -> dict[str, float]:
    """Weights as their sliders can show them: within range, at the nearest step (of two, the lower)."""
    steps = lambda w: -int(-(w / SLIDER_STEP - 0.5) // 1)
    return {k: min(SLIDER_ENDS[k], max(0.0, steps(w) * SLIDER_STEP)) for k, w in weights.items()}


def as_float(value: object, default: float | None = None) -> float | None:
    try:
        return float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default


def as_count(value: object, default: int) -> int:
    """A whole number of at least 0."""
    number = as_float(value)
    return default if number is None or number != number or abs(number) == float("inf") else max(0, int(number))


@dataclass(frozen=True)
class QuerySpec:
    """What a listing view is asked for."""

    weights: Mapping[str, float] = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))
    params: ScoringParams = ScoringParams()
    mode: str = "score"
    ratings: tuple[str, ...] = ("yes", "maybe", "blank")
    statuses: tuple[str, ...] = ()
    financing: tuple[str, ...] = ("eligible",)
    score_threshold: float = 0.0
    ai_rank_threshold: int = 200
    aggressiveness: float = 0.4
    geo_only: bool = False

    def __post_init__(self) -> None:
        if self.mode not in RANKING_MODES:
            raise ValueError(f"ranking mode must be one of {RANKING_MODES}")
        if unknown := set(self.weights) - set(DEFAULT_WEIGHTS):
            raise ValueError(f"unknown features: {sorted(unknown)}")

    @classmethod
    def from_request(cls, args: Mapping[str, object]) -> QuerySpec:
        """From request-like arguments; what is missing or malformed takes its default."""
        given = {k: as_float(args.get(f"weight_{k}")) for k in DEFAULT_WEIGHTS}
        many = lambda key, default: tuple(args[key]) if isinstance(args.get(key), (list, tuple)) and args[key] else default
        base = {f.name: f.default for f in fields(cls) if f.name in ("ratings", "statuses", "financing", "score_threshold", "ai_rank_threshold", "aggressiveness")}
        return cls(
            weights={k: w if (v := given[k]) is None else v for k, w in DEFAULT_WEIGHTS.items()},
            mode=str(args["ranking_mode"]) if args.get("ranking_mode") in RANKING_MODES else "score",
            ratings=many("rating_filter", base["ratings"]),
            statuses=many("status_filter", base["statuses"]),
            financing=many("financing_filter", base["financing"]),
            score_threshold=as_float(args.get("min_score_threshold"), base["score_threshold"]),
            ai_rank_threshold=as_count(args.get("ai_rank_threshold"), base["ai_rank_threshold"]),
            aggressiveness=min(0.9, max(0.1, as_float(args.get("optimizer_aggressiveness"), base["aggressiveness"]))),
            geo_only=bool(args.get("geo_only", False)),
        )


def weight_parameters(weights: Mapping[str, float]) -> str:
    """``weight_<feature>=<two decimals>``, joined by &."""
    return "&".join(f"weight_{k}={w:.2f}" for k, w in weights.items())
