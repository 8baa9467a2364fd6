"""Command line: roughness of a point file."""

from __future__ import annotations

import argparse

import numpy as np
from pyspark.sql import SparkSession

from .config import DecompositionConfig, RoughnessConfig
from .plans.analyze import analyze_object, analyze_points
from .result import ObjectRoughnessResult, format_report, save_grid_npz, save_metrics_json
from .sources.readers import load_points
from .sources.writers import save_npy, save_npz


def main(argv: list[str] | None = None) -> None:
    flag = {"action": argparse.BooleanOptionalAction}
    p = argparse.ArgumentParser(prog="rugosa", description=__doc__)
    # The options' names and defaults.
    p.add_argument("input")
    p.add_argument("--3d", "--decompose", dest="decompose", action="store_true", help="analyse each planar face")
    p.add_argument("--grid-mm", type=float, default=0.20)
    p.add_argument("--short-cutoff-mm", type=float, default=1.0)
    p.add_argument("--long-cutoff-mm", type=float, default=25.0)
    p.add_argument("--gaussian-mesh", default=True, **flag)
    p.add_argument("--edge-margin-mm", type=float, default=1.5)
    p.add_argument("--max-faces", type=int, default=12)
    p.add_argument("--disc-averaging", default=False, **flag)
    p.add_argument("--detect-abnormalities", default=False, **flag)
    p.add_argument("--abnormality-threshold", type=float, default=2.0)
    p.add_argument("--min-abnormality-area-mm2", type=float, default=2.0)
    p.add_argument("--target-svr-mm", type=float)
    for name in ("metrics", "grid", "heatmap"):
        p.add_argument(f"--{name}-out")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("rugosa").getOrCreate()
    config = RoughnessConfig(grid_mm=a.grid_mm, short_cutoff_mm=a.short_cutoff_mm, long_cutoff_mm=a.long_cutoff_mm, gaussian_mesh=a.gaussian_mesh, disc_averaging=a.disc_averaging, detect_abnormalities=a.detect_abnormalities, abnormality_threshold=a.abnormality_threshold, min_abnormality_area_mm2=a.min_abnormality_area_mm2)
    pts = load_points(spark, a.input)
    if a.decompose:
        result = analyze_object(pts, config, DecompositionConfig(edge_margin_mm=a.edge_margin_mm, max_faces=a.max_faces))
    else:
        result = analyze_points(pts, config)
    print(format_report(result, a.target_svr_mm))
    if a.metrics_out:
        save_metrics_json(result, a.metrics_out)
    if isinstance(result, ObjectRoughnessResult):
        if a.grid_out:
            save_npz(a.grid_out, {f"face_{f.patch_id}": (f.roughness.grid, f.roughness.grid_shape, "z") for f in result.patches})
        return
    if a.grid_out:
        save_grid_npz(result, a.grid_out)
    if a.heatmap_out:
        heat = (result.heatmap(disc_averaging=a.disc_averaging), result.grid_shape)
        if a.heatmap_out.endswith(".npz"):
            origin = np.array([*result.grid_origin_mm, result.grid_pitch_mm])
            save_npz(a.heatmap_out, {"heatmap": (*heat, "value"), "pitch_mm": result.grid_pitch_mm, "origin": origin})
        else:
            save_npy(*heat, a.heatmap_out if a.heatmap_out.endswith(".npy") else f"{a.heatmap_out}.npy", "value")


if __name__ == "__main__":
    main()
