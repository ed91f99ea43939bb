"""Pixel-neighbourhood operators: for every pixel an aggregate over a neighbourhood of the same image.

Images are frame rows (keys, h, w, px) or complete images in pixel rows (keys, y, x, v), see arrays.py; the result
has the form of the input. Frame rows pass one numpy kernel and no shuffle.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightfield.functions import images
from brightfield.operators.arrays import is_frames, map_images, pixel_sums, with_image

BORDERS = ("reflect", "reflect101", "replicate", "ignore")


def disk(radius: float) -> list[tuple[int, int, float]]:
    r = int(radius)
    return [(dy, dx, 1.0) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= radius * radius]


def box(k: int) -> list[tuple[int, int, float]]:
    """k x k offsets; an even k has one more of them before the pixel than after it."""
    line = range(-(k // 2), k - k // 2)
    return [(dy, dx, 1.0 / (k * k)) for dy in line for dx in line]


def gaussian_line(radius: int, sigma: float) -> list[float]:
    raw = [math.exp(-d * d / (2.0 * sigma * sigma)) for d in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def gaussian_taps(sigma: float, truncate: float = 4.0) -> list[float]:
    """Taps up to truncate * sigma; one of 1 for a sigma of 0."""
    return gaussian_line(int(truncate * sigma + 0.5), sigma) if sigma > 0 else [1.0]


def stencil(img: DataFrame, offsets: list[tuple[int, int, float]], agg: str, border: str, h: int, w: int) -> DataFrame:
    """Weighted sum, mean (by weight), min, max or median over the offsets around each pixel of complete h x w images."""
    return map_images(img, h, w, lambda stack: images.neighbourhood(stack, offsets, agg, border))


def min_subtract(movie: DataFrame, h: int | None = None, w: int | None = None) -> DataFrame:
    """v minus the pixel's least value over all frames; frame rows need h and w."""
    if is_frames(movie):
        low = pixel_sums(movie, h, w, lambda stack: [stack], ["v"], how="min")
        made = with_image(movie, low, h, w, "low")
        return made.select(*(F.zip_with(F.col("px").cast("array<double>"), "low", lambda v, low: v - low).alias("px") if c == "px" else c for c in movie.columns))
    low = movie.groupBy("session", "y", "x").agg(F.min("v").alias("low"))
    return movie.join(low, ["session", "y", "x"]).select("session", "frame", "y", "x", (F.col("v") - F.col("low")).alias("v"))


def median_denoise(img: DataFrame, k: int, h: int, w: int) -> DataFrame:
    return stencil(img, box(k), "median", "replicate", h, w)


def _smooth(img: DataFrame, taps: list[float], border: str, h: int, w: int) -> DataFrame:
    return map_images(img, h, w, lambda stack: images.along(images.along(stack, taps, 2, border), taps, 1, border))


def gaussian_denoise(img: DataFrame, k: int, h: int, w: int, sigma: float = 0.0) -> DataFrame:
    """Separable Gaussian of k taps; a sigma of 0 is derived from k. Mirrored without repeating the border pixel."""
    return _smooth(img, gaussian_line(k // 2, sigma or 0.3 * ((k - 1) * 0.5 - 1) + 0.8), "reflect101", h, w)


def gaussian_image(img: DataFrame, sigma: float, h: int, w: int, truncate: float = 4.0) -> DataFrame:
    """Gaussian smoothing of complete images, taps up to truncate * sigma, border pixels repeated in the mirror."""
    return _smooth(img, gaussian_taps(sigma, truncate), "reflect", h, w)


def bilateral_denoise(img: DataFrame, d: int, h: int, w: int, sigma_space: float = 75.0, sigma_value: float = 75.0) -> DataFrame:
    """Mean of the disk of diameter d, weighted by distance and by difference of value."""
    offsets = [(dy, dx, math.exp(-(dy * dy + dx * dx) / (2 * sigma_space**2))) for dy, dx, _ in disk(d // 2)]
    return map_images(img, h, w, lambda stack: images.bilateral(stack, offsets, sigma_value, "reflect101"))


def anisotropic_denoise(img: DataFrame, niter: int, kappa: float = 50.0, gamma: float = 0.1, h: int | None = None, w: int | None = None) -> DataFrame:
    """niter steps of edge-preserving diffusion among the four neighbours, with exponential conductance; nothing flows over the border."""
    return map_images(img, h, w, lambda stack: images.diffused(stack, niter, kappa, gamma))


def tophat_background(img: DataFrame, radius: float, h: int, w: int) -> DataFrame:
    """v minus its opening: the greatest of the least values over disks."""
    return map_images(img, h, w, _tophat(radius))


def _tophat(radius: float):
    around = disk(radius)
    return lambda stack: stack - images.extreme(images.extreme(stack, around, np.minimum, "ignore"), around, np.maximum, "ignore")


def uniform_background(img: DataFrame, k: int, h: int, w: int) -> DataFrame:
    """v minus the mean of the k x k box; signed."""
    return map_images(img, h, w, _uniform(k))


def _uniform(k: int):
    taps = [1.0 / k] * k
    return lambda stack: stack - images.along(images.along(stack, taps, 2, "reflect"), taps, 1, "reflect")


def preprocess(movie: DataFrame, h: int, w: int, order: str = "background-denoise", background: str = "uniform", k_background: int = 3, k_denoise: int = 3) -> DataFrame:
    """Minimum subtraction, then background and median denoising in either order, in one pass over the images."""
    clean = _tophat(k_background) if background == "tophat" else _uniform(k_background)
    steps = [clean if step != "denoise" else lambda stack: images.neighbourhood(stack, box(k_denoise), "median", "replicate") for step in order.split("-")]

    def all_steps(stack: np.ndarray) -> np.ndarray:
        for step in steps:
            stack = step(stack)
        return stack

    return map_images(min_subtract(movie, h, w), h, w, all_steps)


def densify(footprints: DataFrame, h: int, w: int) -> DataFrame:
    """Complete images (session, unit_id, y, x, v) of sparse footprints."""
    grid = footprints.select("session", "unit_id").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(h - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))
    return grid.join(footprints.withColumnRenamed("a", "v"), ["session", "unit_id", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
