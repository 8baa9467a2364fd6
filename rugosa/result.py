"""Results: a few figures on the driver, grids and points as DataFrames."""

from __future__ import annotations

import json
import math
import os
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .config import DecompositionConfig, RoughnessConfig
from .functions.columns import grade_of


@dataclass(frozen=True)
class PlaneFit:
    """The fitted plane; coords: DataFrame (u, v, w) of the analysed points in mm along its axes."""

    centroid: np.ndarray
    normal: np.ndarray
    x_axis: np.ndarray
    y_axis: np.ndarray
    coords: DataFrame | None = None


@dataclass(frozen=True)
class Abnormality:
    id: int
    kind: str
    area_mm2: float
    diameter_mm: float
    peak_deviation_um: float
    centroid_uv_mm: tuple[float, float]
    point_count: int = 0


def _round(x, digits: int):
    return round(float(x), digits) if x is not None and math.isfinite(x) else None


def _defect(a: Abnormality) -> dict:
    # The keys of the interface.
    return {
        "id": a.id,
        "kind": a.kind,
        "area_mm2": round(a.area_mm2, 3),
        "diameter_mm": round(a.diameter_mm, 3),
        "peak_deviation_um": round(a.peak_deviation_um, 2),
        "centroid_uv_mm": [round(v, 2) for v in a.centroid_uv_mm],
        "point_count": a.point_count,
    }


@dataclass(frozen=True)
class RoughnessResult:
    """Figures of one surface; grids are DataFrames of cells (patch, iy, ix, ...).

    grid: filtered z in mm; elevation_grid: z in mm before filtering, null where unmeasured;
    heatmap_grid_um: value, if defects were looked for.
    """

    svr_um: float
    sa_um: float
    sq_um: float
    svr_raw_um: float = 0.0
    noise_floor_um: float = 0.0
    points: int = 0
    processed_points: int = 0
    grid_shape: tuple[int, int] = (0, 0)
    grid_pitch_mm: float = 0.20
    grid_origin_mm: tuple[float, float] = (0.0, 0.0)
    extent_mm: tuple[float, float] = (0.0, 0.0)
    plane: PlaneFit | None = None
    grid: DataFrame | None = None
    variogram_bins_um: tuple = ()
    variogram_counts: tuple = ()
    config: RoughnessConfig | None = None
    abnormalities: tuple[Abnormality, ...] = ()
    svr_clean_um: float | None = None
    abnormal_cells: DataFrame | None = None
    elevation_grid: DataFrame | None = None
    heatmap_grid_um: DataFrame | None = None

    @property
    def svr_mm(self) -> float:
        return self.svr_um / 1000

    @property
    def svr_in(self) -> float:
        return self.svr_mm / 25.4

    @property
    def patch_width_mm(self) -> float:
        return self.extent_mm[0] if self.extent_mm[0] > 0 else self.grid_shape[1] * self.grid_pitch_mm

    @property
    def patch_height_mm(self) -> float:
        return self.extent_mm[1] if self.extent_mm[1] > 0 else self.grid_shape[0] * self.grid_pitch_mm

    @property
    def patch_area_mm2(self) -> float:
        return self.patch_width_mm * self.patch_height_mm

    @property
    def point_density_pts_mm2(self) -> float:
        return self.points / self.patch_area_mm2 if self.patch_area_mm2 > 0 else 0.0

    @property
    def average_point_spacing_mm(self) -> float:
        return 1 / math.sqrt(self.point_density_pts_mm2) if self.point_density_pts_mm2 > 0 else 0.0

    @property
    def abnormal_area_mm2(self) -> float:
        return float(sum(a.area_mm2 for a in self.abnormalities))

    @property
    def abnormal_area_pct(self) -> float:
        return 100 * self.abnormal_area_mm2 / self.patch_area_mm2 if self.patch_area_mm2 > 0 else 0.0

    @property
    def abnormal_frequency_per_dm2(self) -> float:
        return 10_000 * len(self.abnormalities) / self.patch_area_mm2 if self.patch_area_mm2 > 0 else 0.0

    def comparator_equivalents(self) -> dict[str, str]:
        return {"SCRATA (A802)": grade_of(self.svr_mm, "SCRATA"), "GAR C-9": grade_of(self.svr_mm, "GAR C-9"), "ACI SIS": grade_of(self.svr_mm, "ACI SIS")}

    def heatmap(self, radius_mm: float = 5.0, disc_averaging: bool | None = None) -> DataFrame:
        """(patch, iy, ix, value) in micrometres; disc_averaging None takes the configuration's."""
        from .operators.heatmap import heatmap

        if self.grid is None:
            raise ValueError("the result has no grid")
        if disc_averaging is None and self.config is not None:
            disc_averaging = self.config.disc_averaging
        return heatmap(self.grid, self.grid_pitch_mm, radius_mm, disc_averaging=disc_averaging)

    def to_dict(self) -> dict:
        # The keys of the interface, in its order.
        return {
            "svr_um": _round(self.svr_um, 3),
            "sa_um": _round(self.sa_um, 3),
            "sq_um": _round(self.sq_um, 3),
            "svr_raw_um": _round(self.svr_raw_um, 3),
            "noise_floor_um": _round(self.noise_floor_um, 3),
            "points": int(self.points),
            "processed_points": int(self.processed_points),
            "grid_shape": list(self.grid_shape),
            "grid_pitch_mm": float(self.grid_pitch_mm),
            "variogram_bins_um": [_round(v, 4) for v in self.variogram_bins_um],
            "variogram_counts": [int(n) for n in self.variogram_counts],
            "comparators": self.comparator_equivalents(),
            "svr_clean_um": _round(self.svr_clean_um, 3),
            "abnormal_area_mm2": round(self.abnormal_area_mm2, 3),
            "abnormal_area_pct": round(self.abnormal_area_pct, 2),
            "abnormal_frequency_per_dm2": round(self.abnormal_frequency_per_dm2, 2),
            "abnormalities": [_defect(a) for a in self.abnormalities],
        }

    metrics_dict = to_dict

    def save_metrics_json(self, path: str) -> None:
        save_metrics_json(self, path)

    def save_grid_npz(self, path: str) -> None:
        save_grid_npz(self, path)

    def format_report(self, target_svr_mm: float | None = None) -> str:
        return format_report(self, target_svr_mm)

    def __repr__(self) -> str:
        h, w = self.grid_shape
        noise = f", noise floor: {self.noise_floor_um:.1f} µm" if self.noise_floor_um > 0 else ""
        # The labels.
        rows = {
            "Svr =": f"{self.svr_um:.1f} µm (raw: {self.svr_raw_um:.1f} µm{noise})",
            "Sa  =": f"{self.sa_um:.1f} µm",
            "Sq  =": f"{self.sq_um:.1f} µm",
            "Points:": f"{self.points:,} (processed: {self.processed_points:,})",
            "Grid:  ": f"{w} × {h} cells (pitch: {self.grid_pitch_mm:.3f} mm)" if h else "None",
        }
        return "RoughnessResult(\n" + "".join(f"  {k} {v}\n" for k, v in rows.items()) + ")"


@dataclass
class SurfacePatchResult:
    """One face. points: (pid, x, y, z) on it; invalid_points: those near its plane that cleaning took away."""

    patch_id: int
    name: str
    normal: np.ndarray
    centroid: np.ndarray
    area_mm2: float
    dims_mm: tuple[float, float]
    point_count: int
    is_astm_compliant: bool
    roughness: RoughnessResult
    points: DataFrame | None = field(default=None, repr=False)
    invalid_points: DataFrame | None = field(default=None, repr=False)

    def to_dict(self) -> dict:
        # The keys of the interface, in its order.
        return {
            "patch_id": self.patch_id,
            "name": self.name,
            "normal": [round(float(v), 4) for v in self.normal],
            "centroid": [round(float(v), 2) for v in self.centroid],
            "area_mm2": round(float(self.area_mm2), 1),
            "dims_mm": [round(float(v), 1) for v in self.dims_mm],
            "point_count": int(self.point_count),
            "is_astm_compliant": bool(self.is_astm_compliant),
            "roughness": self.roughness.to_dict(),
        }


@dataclass
class ObjectRoughnessResult:
    """All faces of an object. status: (pid, patch_id) of points on faces; unassigned: (pid, x, y, z) of the rest."""

    patches: list[SurfacePatchResult]
    total_points: int
    assigned_points: int
    status: DataFrame | None = None
    config: RoughnessConfig | None = None
    decomp_config: DecompositionConfig | None = None
    warnings: list[str] = field(default_factory=list)
    unassigned: DataFrame | None = field(default=None, repr=False)

    @property
    def patch_count(self) -> int:
        return len(self.patches)

    @property
    def unassigned_points(self) -> int:
        return self.total_points - self.assigned_points

    @property
    def coverage_pct(self) -> float:
        return 100 * self.assigned_points / self.total_points if self.total_points else 0.0

    @property
    def mean_svr_um(self) -> float:
        area = sum(p.area_mm2 for p in self.patches)
        return sum(p.area_mm2 * p.roughness.svr_um for p in self.patches) / area if area > 0 else float("nan")

    @property
    def worst_svr_um(self) -> float:
        return max((p.roughness.svr_um for p in self.patches), default=float("nan"))

    @property
    def best_svr_um(self) -> float:
        return min((p.roughness.svr_um for p in self.patches), default=float("nan"))

    @property
    def dominant_patch(self) -> SurfacePatchResult | None:
        """The first face in the canonical order."""
        return self.patches[0] if self.patches else None

    def to_dict(self) -> dict:
        # The keys of the interface, in its order.
        return {
            "patch_count": self.patch_count,
            "total_points": int(self.total_points),
            "assigned_points": int(self.assigned_points),
            "unassigned_points": int(self.unassigned_points),
            "coverage_pct": round(float(self.coverage_pct), 1),
            "mean_svr_um": _round(self.mean_svr_um, 3),
            "worst_svr_um": _round(self.worst_svr_um, 3),
            "best_svr_um": _round(self.best_svr_um, 3),
            "dominant_patch_id": self.dominant_patch.patch_id if self.patches else None,
            "patches": [p.to_dict() for p in self.patches],
        }

    def save_metrics_json(self, path: str) -> None:
        save_metrics_json(self, path)

    def format_report(self, target_svr_mm: float | None = None) -> str:
        total = [
            ("Total Scan Points", f"{self.total_points:,}"),
            ("Assigned Face Points", f"{self.assigned_points:,} ({self.coverage_pct:.1f}% surface coverage)"),
            ("Detected Surface Faces", self.patch_count),
        ]
        levels = [
            ("Area-Weighted Mean S_VR", f"{self.mean_svr_um:.1f} µm"),
            ("Worst-Case Face S_VR", f"{self.worst_svr_um:.1f} µm"),
            ("Best-Case Face S_VR", f"{self.best_svr_um:.1f} µm"),
            *_target(self.worst_svr_um / 1000, target_svr_mm, "Worst Face Spec Status"),
        ]
        out = _section("Multi-Surface 3D Object Roughness Report", total) + _section("Global 3D Object Roughness Summary", levels)
        for p in self.patches:
            r, density = p.roughness, p.point_count / p.area_mm2 if p.area_mm2 > 0 else 0.0
            spacing = 1 / math.sqrt(density) if density > 0 else 0.0
            dims = f"{p.dims_mm[0]:.1f} × {p.dims_mm[1]:.1f} mm"
            out += _section(p.name, [
                ("Points", f"{p.point_count:,} ({dims}, Area: {p.area_mm2:.0f} mm²)"),
                ("Face Size", "PASS (>=50x50mm)" if p.is_astm_compliant else "WARN (<50x50mm)"),
                ("Density", f"PASS ({spacing:.3f} mm spacing)" if spacing <= 0.20 else f"WARNING ({spacing:.3f} mm > 0.20 mm required)"),
                ("S_VR", f"{r.svr_um:.1f} µm  |  Sa: {r.sa_um:.1f} µm  |  Sq: {r.sq_um:.1f} µm"),
                ("SCRATA", r.comparator_equivalents()["SCRATA (A802)"]),
            ])
        return "\n".join(out + self.warnings)


def save_metrics_json(result, path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(result.to_dict(), indent=2) + "\n")


def save_grid_parquet(result: RoughnessResult, path: str) -> None:
    """The cells of a grid, written by the executors: for grids of any size."""
    if result.grid is None:
        raise ValueError("the result has no grid")
    result.grid.write.mode("overwrite").parquet(path)


def grid_array(cells: DataFrame, shape: tuple[int, int], column: str = "z") -> np.ndarray:
    """A patch's cells as an array on the driver, NaN where null; for files of one scan."""
    out = np.full(shape, np.nan)
    t = cells.select("iy", "ix", column).toPandas()
    out[t.iy.to_numpy(), t.ix.to_numpy()] = t[column].to_numpy(float)
    return out


def save_grid_npz(result: RoughnessResult, path: str) -> None:
    """The grid and its frame in one archive; executors write the grid, into a folder shared with the driver."""
    from .sources.writers import save_npz

    if result.grid is None:
        raise ValueError("the result has no grid")
    p, zero = result.plane, np.zeros(3)
    # The names of the arrays.
    arrays = {
        "grid": (result.grid, result.grid_shape, "z"),
        "grid_pitch_mm": result.grid_pitch_mm,
        "grid_origin": np.array([*result.grid_origin_mm, result.grid_pitch_mm]),
        "plane_centroid": p.centroid if p else zero,
        "plane_normal": p.normal if p else zero,
        "plane_x_axis": p.x_axis if p else zero,
        "plane_y_axis": p.y_axis if p else zero,
    }
    save_npz(path, arrays)


RULE = "─" * 55


def _section(title: str, rows: list[tuple]) -> list[str]:
    return [RULE, f"  {title}", RULE, *[f"  {k + ':':<27}{v}" if k else f"    {v}" for k, v in rows], ""]


def _target(svr_mm: float, target: float | None, label: str = "Status") -> list[tuple]:
    if target is None or target <= 0:
        return []
    verdict = "PASS (Within specification)" if svr_mm <= target else "FAIL (Exceeds specification)"
    return [("Purchaser Spec Target", f"<= {target:.4f} mm"), (label, verdict)]


def format_report(result, target_svr_mm: float | None = None) -> str:
    """The report of the standard's section 10; the labels are fixed values."""
    if not isinstance(result, RoughnessResult):
        return result.format_report(target_svr_mm)
    r, c = result, result.config
    h, w = r.grid_shape
    span = c.svr_span_mm if c else 0.5
    test = [("S_VR", f"{r.svr_mm:.4f} mm  ({r.svr_um:.1f} µm / {r.svr_in:.5f} in)"), ("Sa", f"{r.sa_um:.1f} µm"), ("Sq", f"{r.sq_um:.1f} µm")]
    if r.noise_floor_um > 0:
        test.append(("Dynamic Noise Floor", f"{r.noise_floor_um:.1f} µm, Raw S_VR: {r.svr_raw_um:.1f} µm"))
    test += _target(r.svr_mm, target_svr_mm)
    test += [
        ("Evaluation Length", f"{c.svr_points * c.svr_span_mm if c else 5.0:.1f} mm"),
        ("Distance Bucket Size", f"{span} mm"),
        ("Cutoff Wavelengths", f"Short (λs): {c.short_cutoff_mm:g} mm, Long (λc): {c.long_cutoff_mm:g} mm" if c else "N/A"),
    ]
    large = min(r.patch_width_mm, r.patch_height_mm) >= 50
    dense = 0 < r.average_point_spacing_mm <= 0.20
    size = [
        ("Patch Dimensions", f"{r.patch_width_mm:.1f} × {r.patch_height_mm:.1f} mm (Area: {r.patch_area_mm2:.0f} mm²)"),
        ("Patch Size Status", "VALID (>= 50x50 mm)" if large else "WARNING (< 50x50 mm recommended)"),
        ("Raw Points", f"{r.points:,}"),
        ("Processed Points", f"{r.processed_points:,}"),
        ("Avg Point Spacing", f"{r.average_point_spacing_mm:.3f} mm (~{r.point_density_pts_mm2:.1f} pts/mm²)"),
        ("Point Density Status", "VALID (<= 0.20 mm spacing)" if dense else "WARNING (> 0.20 mm required)"),
        ("Grid", f"{w} × {h} cells, pitch={r.grid_pitch_mm:.4f} mm" if h else "None"),
    ]
    out = _section("Surface Variogram Roughness (S_VR) Report", test)
    out += _section("Surface Patch & Sensor Validation", size)
    out += _section("Visual Comparator Equivalents", list(r.comparator_equivalents().items()))
    if r.plane is not None:
        out += _section("Plane & Geometry Alignment", [("Plane centroid", r.plane.centroid), ("Plane normal", r.plane.normal)])
    if len(r.variogram_bins_um):
        counts = [*r.variogram_counts, *[None] * len(r.variogram_bins_um)]
        lines = []
        for i, (v, n) in enumerate(zip(r.variogram_bins_um, counts)):
            text = f"{v:.3f} µm ({v / 1000:.4f} mm)" + (f"  pairs={n}" if n is not None else "") if math.isfinite(v) else "no pairs"
            lines.append(("", f"{i * span:.3f}–{(i + 1) * span:.3f} mm: {text}"))
        out += _section("Variogram Bins", lines)
    if r.abnormalities or r.svr_clean_um is not None:
        clean = f"{r.svr_clean_um / 1000:.4f} mm ({r.svr_clean_um:.1f} µm)" if r.svr_clean_um is not None else "N/A"
        rows = [
            ("Abnormalities Detected", len(r.abnormalities)),
            ("Clean S_VR (w/o abn)", clean),
            ("Total Abnormal Area", f"{r.abnormal_area_mm2:.2f} mm² ({r.abnormal_area_pct:.2f}%)"),
            ("Abnormality Frequency", f"{r.abnormal_frequency_per_dm2:.2f} per dm²"),
        ]
        for a in r.abnormalities:
            u, v = a.centroid_uv_mm
            what = f"area={a.area_mm2:.2f} mm², d={a.diameter_mm:.2f} mm, peak={a.peak_deviation_um:.1f} µm"
            rows.append(("", f"#{a.id} {a.kind.capitalize()}: {what} at ({u:.1f}, {v:.1f}) mm"))
        out += _section("Abnormality Analysis (ASTM WK92969 §8.7 / §10.1.5.3)", rows)
    return "\n".join(out)
