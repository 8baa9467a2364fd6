"""Settings of the analysis and of the decomposition into faces."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

Range = tuple[float, float]


def parse_range(value) -> Range | None:
    """None, a pair, or "lo:hi" -> an inclusive range. Raises ValueError for anything else.

    A range whose ends are the wrong way round holds nothing: it is taken, and finds no points.
    """
    if value is None or value == "":
        return None
    if isinstance(value, str):
        low, mark, high = value.partition(":")
        if not mark:
            raise ValueError(f"a range is written lo:hi, not {value!r}")
        value = (low, high)
    low, high = (float(v) for v in value)
    return low, high


#: The other name under which ranges are parsed.
coerce_range = parse_range


# The settings' names and defaults, here and in DecompositionConfig.
@dataclass(frozen=True)
class RoughnessConfig:
    grid_mm: float = 0.20
    x_range: Range | None = None
    y_range: Range | None = None
    z_range: Range | None = None
    percentile_crop: float = 0.0
    long_cutoff_mm: float = 25.0
    short_cutoff_mm: float = 1.0
    svr_points: int = 10
    svr_span_mm: float = 0.5
    gaussian_mesh: bool = True
    subtract_noise: bool = True
    disc_averaging: bool = False
    detect_abnormalities: bool = False
    abnormality_threshold: float = 2.0
    min_abnormality_area_mm2: float = 2.0

    @classmethod
    def instrument_defaults(cls) -> RoughnessConfig:
        return cls()

    @classmethod
    def astm_standard_defaults(cls) -> RoughnessConfig:
        return cls()

    def with_(self, **overrides) -> RoughnessConfig:
        """A copy with some fields changed; unknown names raise TypeError, ranges are parsed."""
        known = {f.name for f in dataclasses.fields(self)}
        if unknown := set(overrides) - known:
            raise TypeError(f"unknown settings: {', '.join(sorted(unknown))}")
        return dataclasses.replace(self, **{k: parse_range(v) if k.endswith("_range") else v for k, v in overrides.items()})


def config_from_values(**values) -> RoughnessConfig:
    return RoughnessConfig().with_(**values)


@dataclass(frozen=True)
class DecompositionConfig:
    plane_distance_thresh_mm: float = 1.5
    edge_margin_mm: float = 3.0
    edge_neighbor_radius_mm: float = 4.5
    edge_neighbor_count: int = 30
    edge_curvature_threshold: float = 0.02
    cluster_cell_mm: float = 2.0
    min_patch_points: int = 5000
    min_patch_area_mm2: float = 400.0
    astm_min_area_mm2: float = 2500.0
    max_faces: int = 12
    ransac_iterations: int = 250
    subsample_target: int = 120_000
    parallel_angle_thresh_deg: float = 25.0
    flatness_ratio_thresh: float = 0.06
    min_plane_separation_mm: float = 10.0
