"""A run from movie to export over planted cells: whole, in parts, and gone on with."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightfield.operators import cleanup, ingest
from brightfield.plans import workflow

CELLS = ((9, 9), (9, 22), (22, 15))
SIZES = {"one": (32, 32), "two": (32, 32)}


def planted(seed, n, h, w):
    """Frames of three cells with spikes that decay, on a textured background whose brightness varies; what is constant goes with the minimum."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    foot = [np.exp(-((y - a) ** 2 + (x - b) ** 2) / 8.0) for a, b in CELLS]
    rise = np.zeros((len(CELLS), n))
    for k in range(len(CELLS)):
        for t in range(n):
            rise[k, t] = (0.85 * rise[k, t - 1] if t else 0) + (3.0 if rng.random() < 0.06 else 0)
    base = 2.0 + 0.5 * np.cos(y / 7.0) * np.sin(x / 5.0) + rng.random((h, w))
    images = [base * (1.6 + 0.5 * np.sin(t / 4)) + sum(f * r for f, r in zip(foot, rise[:, t], strict=True)) + 0.02 * rng.standard_normal((h, w)) for t in range(n)]
    return images, rise


STEPS = {
    "step2a_video_loading": {"downsample": {"frame": 1, "height": 1}, "line_splitting": {"mode": "basic"}},
    "step2b_processing": {"ksize": 3, "bg_method": "tophat", "wnd": 7},
    "step3a_cropping": {"center_radius_factor": 1.0, "bg_method": "none"},
    "step3b_svd": {"n_components": 6, "n_power_iter": 3},
    "step4b_watershed_segmentation": {"min_distance": 3},
    "step4c_merging_units": {"distance_threshold": 4.0},
    "step5a_noise_estimation": {"noise_scale": ""},
    "step8b_filter_export": {"drop_min_px": 5, "min_snr": 0.0, "corr_thr": 0.95},
}


def parameters(spark, steps):
    params = ingest.params_load(spark.createDataFrame([("one", json.dumps({"steps": steps}))], "session string, json string"))
    return params.unionByName(params.withColumn("session", F.lit("two")))


def test_from_movie_to_export(spark, tmp_path):
    n, rows, truth = 60, [], {}
    for k, (session, (h, w)) in enumerate(SIZES.items()):
        images, truth[session] = planted(k, n, h, w)
        rows += [(session, t // 30, t, h, w, [float(v) for v in image.ravel()]) for t, image in enumerate(images)]
    movie = spark.createDataFrame(rows, "session string, file long, frame long, h int, w int, px array<double>")
    params = parameters(spark, STEPS)
    known = workflow.settings(params)
    assert known["one"]["processing"]["ksize"] == 3 and known["one"]["svd"]["n_components"] == 6
    assert known["one"]["noise_estimation"]["noise_scale"] == 1.5 and known["one"]["video_loading"]["downsample_height"] == 1
    path, stages = str(tmp_path / "out"), str(tmp_path / "stages")
    names = [s.name for s in workflow.STAGES]
    go = lambda params, **how: [(r["stage"], r["made"]) for r in workflow.run(movie, params, path, name="planted", stages_path=stages, **how)]
    with pytest.raises(ValueError, match="stage load of run planted is not stored"):
        go(params, first="crop")
    # a run to a stage exports nothing, the next one goes on from there
    assert go(params, last="crop") == [(s, True) for s in names[:4]] and not (tmp_path / "out").exists()
    assert go(params) == [(s, i > 3) for i, s in enumerate(names)]
    read = lambda name: cleanup.read_export(spark, path, name)
    foot, trace = read("footprints").toPandas(), read("traces").toPandas()
    assert set(foot["session"]) == {"one", "two"}
    for session, rise in truth.items():
        a = foot[foot["session"] == session]
        centres = a.assign(wy=a["a"] * a["y"], wx=a["a"] * a["x"]).groupby("unit_id")[["a", "wy", "wx"]].sum()
        frames = sorted(trace[trace["session"] == session]["frame"].unique())
        kept = read("removed").where(F.col("session") == session).select("frame").toPandas()["frame"].tolist()
        assert len(frames) == 60 - len(set(kept))
        found = {}
        for k, (cy, cx) in enumerate(CELLS):
            away = np.hypot(centres["wy"] / centres["a"] - cy, centres["wx"] / centres["a"] - cx)
            t = trace[(trace["session"] == session) & (trace["unit_id"] == away.idxmin())].sort_values("frame")["v"].to_numpy()
            assert len(t) == len(frames) and (t >= 0).all()
            found[k] = (round(float(away.min()), 2), round(float(np.corrcoef(t, np.delete(rise[k], kept))[0, 1]), 3))
        assert any(d < 2.5 and r > 0.8 for d, r in found.values()), (session, found)  # the small movie's junk units absorb some cells
    summary = {r.session: r for r in read("summary").collect()}
    assert all(summary[s].units >= 1 for s in truth) and read("spikes").count() > 0 and read("noise").count() == sum(h * w for h, w in SIZES.values())
    # with another parameter of the export alone, what stands before it is read
    other = parameters(spark, {**STEPS, "step8b_filter_export": {**STEPS["step8b_filter_export"], "mesh_enable": False}})
    assert go(other) == [(s, s == "finish") for s in names]


def test_sessions_of_two_sizes(spark, tmp_path):
    """Sessions run by size; a stage made anew gives the same tables, and what is stored is not made again."""
    rng = np.random.default_rng(1)
    sizes = {"a": (6, 8), "b": (6, 8), "c": (9, 7)}
    rows = [(s, 0, t, h, w, [float(v) for v in rng.integers(0, 50, h * w)]) for s, (h, w) in sizes.items() for t in range(6)]
    movie = spark.createDataFrame(rows, "session string, file long, frame long, h int, w int, px array<double>")
    params = spark.createDataFrame([("a", "processing", "ksize", "3"), ("b", "processing", "ksize", "3"), ("c", "processing", "wnd", "3")], "session string, step string, param string, value string")
    go = lambda **how: workflow.run(movie, params, str(tmp_path / "out"), stages_path=str(tmp_path / "stages"), last="clean", **how)

    def cleaned(report):
        return {(r.session, r.frame): tuple(r.px) for x in report if x["stage"] == "clean" for r in spark.read.parquet(f"{x['path']}/cleaned").collect()}

    first = go()
    assert [(r["stage"], r["sessions"], r["made"]) for r in first] == [("load", 2, True), ("clean", 2, True), ("load", 1, True), ("clean", 1, True)]
    made = cleaned(first)
    assert {s: {len(px) for (t, _), px in made.items() if t == s} for s in sizes} == {s: {h * w} for s, (h, w) in sizes.items()}
    again = go(first="clean")
    assert [r["made"] for r in again] == [False, True, False, True] and cleaned(again) == made
    assert not any(r["made"] for r in go())


def test_images_of_a_session_are_of_one_size(spark, tmp_path):
    movie = spark.createDataFrame([("s", 0, 0, 1, 2, [1.0, 2.0]), ("s", 0, 1, 2, 1, [1.0, 2.0])], "session string, file long, frame long, h int, w int, px array<double>")
    params = spark.createDataFrame([], "session string, step string, param string, value string")
    with pytest.raises(ValueError, match="differ in size"):
        workflow.run(movie, params, str(tmp_path), stages_path=str(tmp_path))
