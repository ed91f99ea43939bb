"""A whole run from movie to export, driven by a parameter table.

Parameters are rows (session, step, param, value) as ingest.params_load and params_merge give them; nested groups are
JSON text in value. Sessions with equal parameters run together, in one set of jobs; what is not set
has the default below. Stages are stored under the run's name with a manifest, so that a run can begin, end and go on at
any of them, and the results are exported by name and session.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightfield.operators import arrays, background, blocks, cleanup, factor, frames, ingest, merge, motion, reject, segment, stencil, tiles, traces
from brightfield.operators.base import FRAME, UNIT
from brightfield.sources.storage import arrow_rows, exists, materialize, remove, scratch, shared_dir

#: Steps in order with their parameters and defaults. Names and defaults are fixed values.
DEFAULTS: dict[str, dict[str, object]] = {
    "video_loading": {"downsample_frame": 1, "downsample_height": 1, "downsample_width": 1, "trim_video": False, "trim_start_frame": 0, "trim_end_frame": 12000, "video_percent": 100.0, "line_split_columns": 20, "line_split_factor": 2.0},
    "processing": {"denoise_method": "median", "ksize": 7, "bg_method": "tophat", "wnd": 15, "processing_order": "bg_first"},
    "erroneous_frames": {"threshold_factor": 5.0, "drop_frames": True},
    "cropping": {"center_radius_factor": 0.69, "y_offset": 0, "x_offset": 0, "bg_method": "ring", "bg_rank": 1, "bg_smooth_sigma": 4.0, "bg_ring_radius": 12.0, "bg_ring_width": 4.0, "bg_clip": True},
    "svd": {"n_components": 100, "n_power_iter": 5, "sparsity_threshold": 0.05},
    "watershed_segmentation": {"min_distance": 10, "threshold_rel": 0.1, "sigma": 1.0, "min_size": 10},
    "merging_units": {"distance_threshold": 25.0, "size_ratio_threshold": 5.0, "min_size": 9, "max_size": 5000},
    "temporal_merging": {"temporal_corr_threshold": 0.75, "spatial_overlap_threshold": 0.3, "max_size": 5000},
    "artifact_rejection": {"max_cell_size": 1000, "min_skew": 0.3, "min_snr": 2.0, "max_drift_ratio": 0.6, "min_solidity": 0.4, "require_large": True, "min_flags": 2},
    "noise_estimation": {"noise_scale": 1.5, "smoothing_sigma": 1.0, "bg_threshold": "mean"},
    "temporal_update": {"p": 2, "sparse_penal": 0.01, "max_iters": 500, "zero_thres": 0.0005, "chunk": 10000, "overlap": 100},
    "filter_validate": {"min_spike_sum": 1e-6, "min_c_var": 1e-6, "min_spatial_sum": 1e-6},
    "dilate": {"window_size": 3, "threshold": 0.1},
    "cluster": {"max_cluster_size": 10, "min_area": 20, "min_intensity": 0.1, "overlap_threshold": 0.2},
    "bounds": {"dilation_radius": 10, "padding": 20, "min_size": 40, "intensity_threshold": 0.05},
    "spatial_update": {"min_penalty": 1e-6, "max_penalty": 1e-2, "num_penalties": 10, "min_std": 0.1},
    "filter_export": {"min_size": 10, "min_snr": 2.0, "mesh_enable": True, "halo_share": 0.25, "similarity_ratio": 0.3, "drop_min_px": 25, "overlap_thr": 0.3, "corr_thr": 0.7, "max_size": 5000, "dilate_px": 2.0},
}
#: Sessions' parameter rows are gathered on the driver to find those that run together; this many sessions at most.
MOST_SESSIONS = 100_000


def typed(value: str | None, like: object) -> object:
    """The value as the default's type; what is empty or does not parse is the default."""
    try:
        if value is None or value == "" or value.lower() in ("none", "null"):
            return like
        if isinstance(like, bool):
            return value.strip().lower() in ("true", "1", "yes")
        return type(like)(float(value)) if isinstance(like, int) else type(like)(value)
    except ValueError:
        return like


def settings(params: DataFrame) -> dict[str, dict[str, dict[str, object]]]:
    """By session its value of every parameter in DEFAULTS. Steps are matched by name behind any prefix up to the first "_"; members of a JSON group are named group_member."""
    name = F.when(F.col("step").rlike(r"^step[0-9]+[a-z]*_"), F.regexp_replace("step", r"^step[0-9]+[a-z]*_", "")).otherwise(F.col("step"))
    rows = params.select("session", name.alias("step"), "param", "value").where(F.col("step").isin(*DEFAULTS))
    if params.select("session").distinct().count() > MOST_SESSIONS:
        raise ValueError(f"more than {MOST_SESSIONS} sessions; run them in parts")
    found: dict[str, dict[str, dict[str, object]]] = {}
    for r in params.select("session").distinct().collect():
        found[r.session] = {s: dict(d) for s, d in DEFAULTS.items()}
    for r in rows.collect():  # parameters of DEFAULTS alone
        given = {r.param: r.value}
        if r.value is not None and r.value.strip().startswith("{"):
            given = {f"{r.param}_{k}": None if v is None else str(v) for k, v in json.loads(r.value).items()}
        for param, value in given.items():
            if param in DEFAULTS[r.step]:
                found[r.session][r.step][param] = typed(value, DEFAULTS[r.step][param])
    return found


class Stage(NamedTuple):
    """make(tables, parameters, h, w) gives new tables and the size of images after it; `steps` name the parameters that it reads."""

    name: str
    make: Callable[[dict[str, DataFrame], dict, int, int], tuple[dict[str, DataFrame], int, int]]
    steps: tuple[str, ...]


def run(movie: DataFrame, params: DataFrame, path: str, name: str = "run", first: str | None = None, last: str | None = None, stages_path: str | None = None) -> list[dict[str, object]]:
    """Runs all sessions of movie (session, file, frame, h, w, px) and exports footprints, traces, spikes, lineage, motion, noise, removed and summary to path.

    Sessions without parameters take the defaults; those with equal parameters and images of one size run together, and a session's images
    must be of one size. Each stage's tables lie in stages_path (the shared folder) under the run's name, the stage and a hash of all parameters up to it
    and of the sessions; a manifest, written last, says that they are whole. What is whole is read and not made again, so that a run broken off goes on
    where it was, and one with other parameters shares the stages before them. With `first`, the stages before it must be there, and it and later ones are
    made anew; with `last` the run ends after that stage, and only a run to the end exports. Gives a row for each stage: stage, sessions, path and whether it was made.
    """
    spark = movie.sparkSession
    names = [s.name for s in STAGES]
    begin, end = (names.index(first) if first else 0), (names.index(last) if last else len(names) - 1)
    known = settings(params)
    groups: dict[tuple[str, int, int], list[str]] = {}
    for r in movie.groupBy("session").agg(F.min("h").alias("h"), F.max("h").alias("h2"), F.min("w").alias("w"), F.max("w").alias("w2")).orderBy("session").collect():
        if (r.h, r.w) != (r.h2, r.w2):
            raise ValueError(f"images of session {r.session} differ in size")
        groups.setdefault((json.dumps(known.get(r.session, DEFAULTS), sort_keys=True), r.h, r.w), []).append(r.session)
    root = f"{stages_path or shared_dir(spark) + '/runs'}/{name}"
    out: dict[str, DataFrame] = {}
    report: list[dict[str, object]] = []
    for (values, h, w), sessions in groups.items():
        p = json.loads(values)
        mark = hashlib.sha256(json.dumps([h, w, sessions]).encode()).hexdigest()
        chosen = spark.createDataFrame([(s,) for s in sessions], "session string")
        tables = {"given": movie.join(F.broadcast(chosen), "session", "left_semi")}
        for k, stage in enumerate(STAGES[: end + 1]):
            mark = hashlib.sha256(json.dumps([mark, stage.name, {s: p[s] for s in stage.steps}], sort_keys=True).encode()).hexdigest()
            where = f"{root}/{stage.name}-{mark[:16]}"
            whole = exists(spark, f"{where}/manifest/_SUCCESS")
            if not whole and k < begin:
                raise ValueError(f"stage {stage.name} of run {name} is not stored for session {sessions[0]}; begin there or before")
            if not whole or (first and k >= begin):
                remove(spark, f"{where}/manifest")
                with scratch():
                    made, h2, w2 = stage.make(tables, p, h, w)
                    for n, df in made.items():
                        with arrow_rows(spark, blocks.ARRAY_ROWS):
                            df.write.mode("overwrite").parquet(f"{where}/{n}")
                text = json.dumps({"tables": list(made), "h": h2, "w": w2, "parameters": {s: p[s] for s in stage.steps}, "sessions": sessions})
                spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{where}/manifest")
            kept = json.loads(spark.read.text(f"{where}/manifest").first()[0])
            h, w = kept["h"], kept["w"]
            tables |= {n: spark.read.parquet(f"{where}/{n}") for n in kept["tables"]}
            report.append({"stage": stage.name, "sessions": len(sessions), "path": where, "made": not whole or bool(first and k >= begin)})
        for n in EXPORTED if end == len(STAGES) - 1 else ():
            out[n] = tables[n] if n not in out else out[n].unionByName(tables[n])
    cleanup.export(out, path)
    return report


def load(t: dict, p: dict, h: int, w: int) -> tuple[dict[str, DataFrame], int, int]:
    """Selected frames, those split between lines, and the rest numbered anew."""
    v = p["video_loading"]
    movie = ingest.stride_downsample(t["given"], v["downsample_frame"], v["downsample_height"], v["downsample_width"], h, w)
    h, w = h // v["downsample_height"], w // v["downsample_width"]
    movie = ingest.trim_frames(movie, v["trim_start_frame"], v["trim_end_frame"] if v["trim_video"] else 0, v["video_percent"])
    movie = materialize(movie, "run-selected", blocks.ARRAY_ROWS)
    edge = arrays.cut(movie.select(*FRAME, "h", "w", "px"), h, w, (0, h, 1), (0, min(w, v["line_split_columns"]), 1))[0]
    split = materialize(frames.linesplit_basic(arrays.as_pixels(edge), v["line_split_columns"], v["line_split_factor"]).select("session", "frame"), "run-split")
    movie = movie.drop("original_frame")
    return {"loaded": movie.withColumn("original_frame", F.col("frame")) if split.isEmpty() else ingest.frame_reindex(movie, split), "split": split}, h, w


def clean(t: dict, p: dict, h: int, w: int) -> tuple[dict[str, DataFrame], int, int]:
    """Images without glow and background, denoised."""
    v = p["processing"]
    order = "background-denoise" if v["processing_order"] == "bg_first" else "denoise-background"
    return {"cleaned": stencil.preprocess(t["loaded"], h, w, order, v["bg_method"], v["wnd"], v["ksize"])}, h, w


def align(t: dict, p: dict, h: int, w: int) -> tuple[dict[str, DataFrame], int, int]:
    """The motion, the frames removed in their first numbering, and the others moved into place and numbered anew."""
    v, movie = p["erroneous_frames"], t["cleaned"]
    moves = materialize(motion.estimate_motion(movie.select("session", "frame", "h", "w", "px")), "run-motion")
    bad = frames.motion_outliers(moves, v["threshold_factor"]) if v["drop_frames"] else moves.select("session", "frame").limit(0)
    bad = materialize(bad, "run-bad")
    removed = frames.removed_frames(movie.select("session", F.col("original_frame").alias("frame"), F.col("frame").alias("new_frame")), bad, t["split"])
    moved = motion.apply_shift(movie.select("session", "frame", "h", "w", "px"), moves, h, w)
    return {"motion": moves, "removed": removed, "aligned": ingest.frame_reindex(moved, bad).drop("original_frame")}, h, w


def crop(t: dict, p: dict, h: int, w: int) -> tuple[dict[str, DataFrame], int, int]:
    """The centre of the images without what is left of the background, not negative."""
    v = p["cropping"]
    y0, y1, x0, x1 = background.crop_window(h, w, v["center_radius_factor"], v["y_offset"], v["x_offset"])
    movie, h, w = arrays.cut(t["aligned"], h, w, (y0, y1, 1), (x0, x1, 1))
    movie = materialize(movie, "run-cropped", blocks.ARRAY_ROWS)
    if v["bg_method"] == "ring":
        movie = background.ring_background(movie, h, w, v["bg_ring_radius"], v["bg_ring_width"], clip=v["bg_clip"])
    elif v["bg_method"] == "lowrank":
        basis = materialize(background.lowrank_basis(movie, h, w, v["bg_rank"], 1, v["bg_smooth_sigma"]), "run-basis")
        movie = background.lowrank_subtract(movie, basis, v["bg_clip"])
    return {"movie": factor.shift_nonneg(movie)}, h, w


def factors(t: dict, p: dict, h: int, w: int) -> tuple[dict[str, DataFrame], int, int]:
    """Non-negative factors of the movie, and the first of them as the background's image and trace."""
    v = p["svd"]
    svd = materialize(factor.randomized_svd(t["movie"].select("session", "frame", "h", "w", "px"), v["n_components"], v["n_power_iter"]), "run-svd")
    made = materialize(factor.nndsvd(svd, w, v["sparsity_threshold"]), "run-factors")
    a = made.where("part = 'V' and value > 0").select("session", F.col("k").cast("long").alias("unit_id"), F.expr(f"cast(index div {w} as int)").alias("y"), F.expr(f"cast(index % {w} as int)").alias("x"), F.col("value").alias("a"))
    c = made.where("part = 'U'").select("session", F.col("k").cast("long").alias("unit_id"), F.col("index").alias("frame"), F.col("value").alias("v"))
    b, f = factor.background_factor(a, c)
    return {"factor_images": a, "background": b, "background_trace": f}, h, w


def cells(t: dict, p: dict, h: int, w: int) -> tuple[dict[str, DataFrame], int, int]:
    """First footprints and traces: basins, merged cells, traces, merged units, without artefacts."""
    seg, near, join, odd = p["watershed_segmentation"], p["merging_units"], p["temporal_merging"], p["artifact_rejection"]
    labels = segment.basin_filter(segment.basin_label(t["factor_images"].where("unit_id <> 0"), seg["min_distance"], seg["threshold_rel"], seg["sigma"], h, w), seg["min_size"])
    labels = materialize(labels.withColumn("cell", F.shiftleft("unit_id", 32) + F.col("basin")), "run-basins")
    found = segment.component_table(labels).select("session", (F.shiftleft("unit_id", 32) + F.col("basin")).alias("unit_id"), "size", "cy", "cx")
    groups = segment.centroid_merge(found, near["distance_threshold"], near["size_ratio_threshold"], near["min_size"], near["max_size"])
    a = materialize(merge.merge_footprints(labels.select("session", F.col("cell").alias("unit_id"), "y", "x", "a"), groups), "run-cells")
    c = materialize(traces.extract_traces(t["movie"], a), "run-traces")
    a, c = traces.normalize_footprints(a, c)
    good = materialize(traces.drop_degenerate(a, c), "run-good")
    a, c = materialize(a.join(good, UNIT, "left_semi"), "run-a"), materialize(c.join(good, UNIT, "left_semi"), "run-c")
    groups = materialize(merge.merge_groups(a, c, join["spatial_overlap_threshold"], join["temporal_corr_threshold"], join["max_size"]), "run-groups")
    a, c = materialize(merge.merge_footprints(a, groups), "run-a"), materialize(merge.merge_traces(c, groups), "run-c")
    scores = reject.shape_props(a).join(reject.trace_skew(c), UNIT).join(reject.trace_snr(c), UNIT).join(reject.drift_ratio(c), UNIT)
    flags = reject.quarantine(scores, odd["min_skew"], odd["min_snr"], odd["max_drift_ratio"], odd["min_solidity"], odd["max_cell_size"], odd["require_large"], odd["min_flags"])
    kept = materialize(flags.where("not quarantined").select(*UNIT), "run-kept")
    return {"cells": a.join(kept, UNIT, "left_semi"), "cell_traces": c.join(kept, UNIT, "left_semi")}, h, w


def noise(t: dict, p: dict, h: int, w: int) -> tuple[dict[str, DataFrame], int, int]:
    v = p["noise_estimation"]
    return {"noise": reject.noise_map(t["movie"], t["background"], t["background_trace"], h, w, v["noise_scale"], v["smoothing_sigma"], v["bg_threshold"])}, h, w


def deconvolved(t: dict, a: DataFrame, v: dict) -> DataFrame:
    return traces.temporal_update(traces.project_yra(t["movie"], a, t["background"], t["background_trace"]), v["chunk"], v["overlap"], v["p"], v["sparse_penal"], v["max_iters"], v["zero_thres"])


def temporal(t: dict, p: dict, h: int, w: int) -> tuple[dict[str, DataFrame], int, int]:
    """Deconvolved traces, and the footprints of units that are active."""
    keep = p["filter_validate"]
    made = materialize(deconvolved(t, t["cells"], p["temporal_update"]), "run-deconvolved")
    good = reject.component_filter(reject.component_metrics(t["cells"], made), keep["min_spike_sum"], keep["min_c_var"], keep["min_spatial_sum"])
    return {"deconvolved": made, "active": t["cells"].join(good, UNIT, "left_semi")}, h, w


def spatial(t: dict, p: dict, h: int, w: int) -> tuple[dict[str, DataFrame], int, int]:
    """Footprints after a spatial update within clusters, and the traces that it rests on."""
    grow, group, box, fit, a = p["dilate"], p["cluster"], p["bounds"], p["spatial_update"], t["active"]
    grown = tiles.dilate(a, h, w, grow["window_size"], grow["threshold"]).select(*UNIT, "y", "x").join(a, [*UNIT, "y", "x"], "left")
    wide = materialize(grown.withColumn("a", F.coalesce("a", F.lit(0.0))), "run-dilated")
    clusters = materialize(tiles.cluster_units(wide, group["max_cluster_size"], group["overlap_threshold"]), "run-clusters")
    mask = materialize(tiles.cluster_mask(wide, clusters, h, w, box["dilation_radius"], box["intensity_threshold"]), "run-mask")
    bounds = tiles.cluster_bounds(mask, h, w, box["padding"], box["min_size"])
    c = t["deconvolved"].select(*UNIT, "frame", F.col("c").alias("v")).join(a.select(*UNIT).distinct(), UNIT, "left_semi")
    fresh = tiles.spatial_update(t["movie"], c, t["background_trace"], clusters, mask, (fit["min_penalty"], fit["max_penalty"], fit["num_penalties"]), fit["min_std"])
    fresh = materialize(tiles.growth_cap(fresh, reject.unit_sizes(wide)), "run-spatial")
    boxes = bounds.join(clusters, ["session", "cluster_id"]).join(fresh.select(*UNIT).distinct(), UNIT, "left_semi").select(*UNIT, "y0", "y1", "x0", "x1")
    return {"updated": tiles.overlap_split(tiles.replace_tiles(a, fresh, boxes)), "updated_traces": c}, h, w


def finish(t: dict, p: dict, h: int, w: int) -> tuple[dict[str, DataFrame], int, int]:
    """Final footprints, traces, spikes, lineage and summary."""
    e, join, a, c = p["filter_export"], p["temporal_merging"], t["updated"], t["updated_traces"]
    groups = materialize(merge.merge_groups(a, c, e["overlap_thr"], e["corr_thr"], join["max_size"]), "run-groups")
    a = materialize(merge.merge_footprints(a, groups), "run-merged")
    n_before = a.select(*UNIT).distinct().groupBy("session").agg(F.count("*").alias("n_before"))
    made = materialize(deconvolved(t, a, p["temporal_update"]), "run-deconvolved")
    final = made.select(*UNIT, "frame", F.col("c").alias("v"))
    good = materialize(reject.final_filter(a, reject.trace_snr(final), e["min_size"], e["min_snr"]).select(*UNIT), "run-final")
    a, final = a.join(good, UNIT, "left_semi"), final.join(good, UNIT, "left_semi")
    lineage = a.select(*UNIT, F.col("unit_id").alias("parent_unit_id")).distinct()
    if e["mesh_enable"]:
        a, final, lineage = cleanup.cleanup(a, final, h, w, e["halo_share"], e["drop_min_px"], e["similarity_ratio"], e["overlap_thr"], e["corr_thr"], e["max_size"], e["dilate_px"])
    a, final = materialize(a, "run-footprints"), materialize(final, "run-traces")
    spikes = made.join(good, UNIT, "left_semi").select(*UNIT, "frame", F.col("s").alias("v")).where("v > 0")
    return {"footprints": a, "traces": final, "spikes": spikes, "lineage": lineage, "summary": cleanup.export_summary(a, final, n_before)}, h, w


#: In order; each reads tables of earlier ones by name.
STAGES = (
    Stage("load", load, ("video_loading",)),
    Stage("clean", clean, ("processing",)),
    Stage("align", align, ("erroneous_frames",)),
    Stage("crop", crop, ("cropping",)),
    Stage("factors", factors, ("svd",)),
    Stage("cells", cells, ("watershed_segmentation", "merging_units", "temporal_merging", "artifact_rejection")),
    Stage("noise", noise, ("noise_estimation",)),
    Stage("temporal", temporal, ("temporal_update", "filter_validate")),
    Stage("spatial", spatial, ("dilate", "cluster", "bounds", "spatial_update")),
    Stage("finish", finish, ("filter_export", "temporal_merging", "temporal_update")),
)
EXPORTED = ("footprints", "traces", "spikes", "lineage", "motion", "noise", "removed", "summary")
