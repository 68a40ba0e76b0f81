"""Parameters of the pipeline: a profile by road width, and settings with bounds."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waylace.operators.ranks import elements_at

DEFAULT_WIDTH = 8.0
RURAL_FROM = 12.0


@dataclass(frozen=True)
class Policy:
    """All lengths in metres, all angles in degrees."""

    median_width: float
    profile: str
    lane_width: float
    pair_step: float
    axis_bin: float
    protrusion: float
    sharp_simplify: float
    reconnect_radius: float
    min_length: float
    resample_step: float
    voronoi_step: float
    selector_step: float
    reconnect_buffer: float
    shared_ratio: float
    min_quality: float
    keep_ratio: float
    length_factor: float
    smooth_rounds: int
    smooth_alpha: float
    reconnect_angle: float
    smooth_window: int
    prune_ratio: float
    radius_hit: float
    hit_ratio: float
    hit_count: int
    component_min_length: float
    spur_max_length: float
    spur_ratio: float
    merge_distance_min: float = 0.5
    merge_lane_ratio: float = 0.7
    pair_break_bins: float = 3.0
    boundary_step_floor: float = 0.5
    smooth_target_shift: float = 0.5
    reconnect_inside_ratio: float = 0.97
    parallel_distance_factor: float = 0.8
    parallel_angle: float = 12.0
    parallel_offset_factor: float = 0.2
    resample_floor: float = 0.4
    hit_remove_edges: int = 2
    hit_protect_length: float = 30.0
    hit_protect_radius: float = 1.0
    hard_radius: float = 0.05
    component_protect_radius: float = 1.0

    @property
    def merge_distance(self) -> float:
        return max(self.merge_distance_min, self.merge_lane_ratio * self.lane_width)


#: Fixed values, by width: factor, least, most.
BY_WIDTH = {
    "lane_width": (0.12, 1.4, 3.5),
    "pair_step": (0.16, 1.0, 3.0),
    "axis_bin": (0.10, 0.8, 2.0),
    "protrusion": (0.02, 0.15, 0.5),
    "sharp_simplify": (0.018, 0.1, 0.45),
    "reconnect_radius": (0.9, 4.0, 14.0),
    "min_length": (0.15, 1.0, 4.0),
    "resample_step": (0.12, 0.8, 2.5),
    "voronoi_step": (0.08, 0.35, 1.2),
    "selector_step": (0.10, 0.4, 2.0),
    "reconnect_buffer": (0.05, 0.1, 1.0),
}
#: Fixed values, by profile: rural, urban.
BY_PROFILE = {
    "shared_ratio": (0.06, 0.08),
    "min_quality": (0.48, 0.52),
    "keep_ratio": (0.72, 0.65),
    "length_factor": (1.8, 1.4),
    "smooth_rounds": (3, 2),
    "smooth_alpha": (0.30, 0.35),
    "reconnect_angle": (25.0, 20.0),
    "smooth_window": (5, 4),
    "prune_ratio": (1.8, 1.3),
    "radius_hit": (0.22, 0.12),
    "hit_ratio": (0.30, 0.45),
    "hit_count": (3, 4),
    "component_min_length": (18.0, 10.0),
    "spur_max_length": (3.5, 2.0),
    "spur_ratio": (0.25, 0.15),
}


def policy_for_width(width: float | None) -> Policy:
    """The policy for a median width; the default width where it is null or not positive."""
    m = float(width) if width and width > 0 else DEFAULT_WIDTH
    rural = m >= RURAL_FROM
    sized = {k: max(lo, min(hi, m * f)) for k, (f, lo, hi) in BY_WIDTH.items()}
    chosen = {k: v[0] if rural else v[1] for k, v in BY_PROFILE.items()}
    return Policy(median_width=m, profile="rural" if rural else "urban", **sized, **chosen)


def upper_median(df: DataFrame, column: str) -> float | None:
    """The element at place ``n div 2`` of the ordered positive values, from 0; null without any."""
    values = df.where(F.col(column) > 0)
    n = values.count()
    return elements_at(values, column, [n // 2], n)[0] if n else None


def policy_from_widths(widths: DataFrame, column: str = "width") -> Policy:
    return policy_for_width(upper_median(widths, column))


def policy_frame(spark, policy: Policy) -> DataFrame:
    """The policy as one row."""
    return spark.createDataFrame([tuple(getattr(policy, f.name) for f in fields(policy))], ", ".join(f"{f.name} {_KINDS[type(getattr(policy, f.name))]}" for f in fields(policy)))


_KINDS = {float: "double", int: "int", str: "string"}


def _bounded(default: float, low: float, high: float | None = None):
    return field(default=default, metadata={"low": low, "high": high})


@dataclass(frozen=True)
class Settings:
    """Settings that environment variables ``GIS_<NAME>`` or a ``.env`` file override."""

    debug_export_intermediate: bool = False
    topology_intersection_merge_threshold_m: float = _bounded(1.5, 0.0)
    topology_intersection_parallel_angle_deg: float = _bounded(15.0, 0.0, 90.0)
    topology_simplify_main_tolerance_m: float = _bounded(0.05, 0.0)
    topology_simplify_junction_tolerance_m: float = _bounded(0.12, 0.0)
    topology_junction_min_degree: int = _bounded(3, 2)

    def __post_init__(self) -> None:
        for f in fields(self):
            low, high = f.metadata.get("low"), f.metadata.get("high")
            value = getattr(self, f.name)
            if low is not None and value < low or high is not None and value > high:
                raise ValueError(f"{f.name} = {value} is out of bounds")


def load_settings(environ: dict[str, str] | None = None, env_file: str = ".env") -> Settings:
    """Settings from the environment, which goes before the file."""
    found: dict[str, str] = {}
    if os.path.isfile(env_file):
        with open(env_file, encoding="utf-8") as lines:
            found = {k.strip().upper(): v.strip().strip("\"'") for k, _, v in (x.partition("=") for x in lines if "=" in x and not x.lstrip().startswith("#"))}
    found |= {k.upper(): v for k, v in (os.environ if environ is None else environ).items()}
    out = {}
    for f in fields(Settings):
        raw = found.get(f"GIS_{f.name}".upper())
        if raw is not None:
            kind = type(f.default)
            out[f.name] = raw.lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
    return Settings(**out)
