"""Areal surface roughness of 3-D point clouds, as Spark DataFrame jobs."""

import importlib

__version__ = "0.2.0"
# The names of the interface, by the module that has each; loaded when first asked for,
# so that executors import what a task needs only.
_WHERE = {
    "config": ["DecompositionConfig", "RoughnessConfig"],
    "interface": ["compute_heatmap_grid", "detect_surface_abnormalities", "interpolate_heatmap_at_points"],
    "operators.grid": ["SparseScanError"],
    "plans.analyze": [
        "PurePythonResult", "analyze_file", "analyze_object", "analyze_ply", "analyze_points", "analyze_pure_python",
        "compute_roughness", "compute_roughness_from_ply",
    ],
    "plans.decompose": ["decompose_3d_object", "is_planar_surface"],
    "result": [
        "Abnormality", "ObjectRoughnessResult", "PlaneFit", "RoughnessResult", "SurfacePatchResult",
        "format_report", "save_grid_npz", "save_metrics_json",
    ],
    "sources.readers": ["load_delimited", "load_obj", "load_pcd", "load_ply", "load_points", "load_stl_vertices"],
}
_NAMES = {n: (m, n) for m, names in _WHERE.items() for n in names}
__all__ = ["__version__", *_NAMES]


def __getattr__(name: str):
    if name not in _NAMES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    module, attribute = _NAMES[name]
    return getattr(importlib.import_module(f".{module}", __name__), attribute)
