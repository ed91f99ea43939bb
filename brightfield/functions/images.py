"""Numpy kernels over stacks of images (n, h, w) and over single sparse footprints."""

from __future__ import annotations

import heapq

import numpy as np

#: How np.pad continues an image beyond its border; "ignore" leaves what lies outside out of account.
PADDING = {"reflect": "symmetric", "reflect101": "reflect", "replicate": "edge"}


def padded(stack: np.ndarray, ry: int, rx: int, border: str, fill: float = 0.0) -> np.ndarray:
    room = ((0, 0), (ry, ry), (rx, rx))
    return np.pad(stack, room, constant_values=fill) if border == "ignore" else np.pad(stack, room, mode=PADDING[border])


def along(stack: np.ndarray, taps: list[float], axis: int, border: str) -> np.ndarray:
    """Weighted sums of neighbours on one axis (1: rows, 2: columns), taps centred."""
    r = len(taps) // 2
    wide = padded(stack, r if axis == 1 else 0, r if axis == 2 else 0, border)
    size = stack.shape[axis]
    view = lambda d: wide[:, d : d + size] if axis == 1 else wide[:, :, d : d + size]
    out = taps[0] * view(0)
    for d, g in enumerate(taps[1:], 1):
        out += g * view(d)
    return out


def extreme(stack: np.ndarray, offsets: list[tuple[int, int, float]], op, border: str) -> np.ndarray:
    """Least or greatest value over the offsets, image by image.

    The runs of a disk's rows are nested: the extremes over a longer run are those over a shorter one at its two ends, one step
    for each length. Only the plane of the present length and the result are held, so that both stay in the processor's cache.
    """
    _, h, w = stack.shape
    ry, rx = max(abs(o[0]) for o in offsets), max(abs(o[1]) for o in offsets)
    by_row: dict[int, set[int]] = {}
    for dy, dx, _ in offsets:
        by_row.setdefault(dy, set()).add(dx)
    runs: dict[int, list[tuple[int, int]]] = {}
    for dy, dxs in by_row.items():
        line = np.array(sorted(dxs))
        for run in np.split(line, np.flatnonzero(np.diff(line) > 1) + 1):
            runs.setdefault(len(run), []).append((dy, int(run[0])))
    out = np.empty_like(stack, dtype=np.float64)
    for image, made in zip(stack, out, strict=True):
        plane = padded(image[None], ry, rx, border, np.inf if op is np.minimum else -np.inf)[0]
        size, begun = 1, False
        for length in sorted(runs):
            while size < length:
                step = min(size, length - size)
                plane = op(plane[:, :-step], plane[:, step:])
                size += step
            for dy, dx in runs[length]:
                part = plane[ry + dy : ry + dy + h, rx + dx : rx + dx + w]
                if begun:
                    op(made, part, out=made)
                else:
                    made[...], begun = part, True
    return out


#: Values of a plane at once in the median network: its some hundred planes then fit in the processor's cache.
MEDIAN_PLANE = 8192


def merged(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Odd-even merge of two lists of planes, each in ascending order at every pixel."""
    if not a or not b:
        return a or b
    if len(a) == len(b) == 1:
        return [np.minimum(a[0], b[0]), np.maximum(a[0], b[0])]
    even, odd = merged(a[::2], b[::2]), merged(a[1::2], b[1::2])
    out = even[:1]
    for x, y in zip(odd, even[1:], strict=False):
        out += [np.minimum(x, y), np.maximum(x, y)]
    n = min(len(odd), len(even) - 1)
    return out + odd[n:] + even[n + 1 :]


def box_median(wide: np.ndarray, k: int) -> np.ndarray:
    """The median of each k x k window (k odd) of an image that is k - 1 larger than the result.

    Every column of k values is sorted once, and sorted runs of 2, 4, ... columns are merged from halves that overlapping windows
    share. The window is its largest such run and the merged rest, and its middle value a minimum over the ways to share it between them.
    Planes are flat, so that a neighbouring column is one place further; what wraps around a row's end is cut off. A median is one of
    the values, so that images of single-precision values are worked on in single precision.
    """
    height, width = wide.shape
    h, w = height - k + 1, width - k + 1
    single = wide.astype(np.float32)
    wide = single if np.array_equal(single, wide) else np.ascontiguousarray(wide)
    out = np.empty((h, w))
    rows = max(1, MEDIAN_PLANE // width)
    middle = k * k // 2 + 1
    for top in range(0, h, rows):
        n = min(rows, h - top)
        column: list[list[np.ndarray]] = [[wide[top + i : top + i + n].ravel()] for i in range(k)]
        while len(column) > 1:
            column = [merged(x, y) for x, y in zip(column[::2], column[1::2], strict=False)] + (column[-1:] if len(column) % 2 else [])
        runs, size = {1: column[0]}, 1
        while size * 2 <= k:
            runs[2 * size] = merged([p[:-size] for p in runs[size]], [p[size:] for p in runs[size]])
            size *= 2
        rest, held = [], 0
        for piece in sorted((s for s in runs if s != size and (k - size) & s), reverse=True):
            given = [p[held:] for p in runs[piece]]
            length = min(len(given[0]), len(rest[0]) if rest else len(given[0]))
            rest = merged([p[:length] for p in rest], [p[:length] for p in given])
            held += piece
        length = n * width - k + 1
        large, rest = [p[:length] for p in runs[size]], [p[size : size + length] for p in rest]
        best = large[middle - 1] if len(large) >= middle else None
        for j in range(max(1, middle - len(large)), min(middle, len(rest)) + 1):
            made = np.maximum(large[middle - j - 1], rest[j - 1]) if middle > j else rest[j - 1]
            best = made if best is None else np.minimum(best, made)
        flat = np.empty(n * width)
        flat[:length] = best
        out[top : top + n] = flat.reshape(n, width)[:, :w]
    return out


def neighbourhood(stack: np.ndarray, offsets: list[tuple[int, int, float]], how: str, border: str) -> np.ndarray:
    """Weighted sum, mean (by weight), min, max or median over the offsets around each pixel."""
    if how in ("min", "max"):
        return extreme(stack, offsets, np.minimum if how == "min" else np.maximum, border)
    _, h, w = stack.shape
    ry, rx = max(abs(o[0]) for o in offsets), max(abs(o[1]) for o in offsets)
    wide = padded(stack, ry, rx, border, np.nan if how == "median" else 0.0)
    view = lambda image, dy, dx: image[..., ry + dy : ry + dy + h, rx + dx : rx + dx + w]
    if how == "median" and border != "ignore" and len(offsets) == (2 * ry + 1) * (2 * rx + 1) == len({o[:2] for o in offsets}):
        n = len(offsets)
        if ry == rx and not np.isnan(wide).any():
            return np.stack([box_median(image, 2 * ry + 1) for image in wide])
        out = np.empty_like(stack)
        rows = max(1, (1 << 22) // (w * n))
        for image, made in zip(wide, out, strict=True):
            for y in range(0, h, rows):
                windows = np.lib.stride_tricks.sliding_window_view(image[y : y + rows + 2 * ry], (2 * ry + 1, 2 * rx + 1))
                made[y : y + rows] = np.partition(windows.reshape(*windows.shape[:2], n), n // 2, axis=-1)[..., n // 2]
        return out
    if how == "median":
        middle = np.nanmedian if border == "ignore" else np.median
        return np.stack([middle(np.stack([view(image, dy, dx) for dy, dx, _ in offsets]), axis=0) for image in wide])
    total = np.zeros_like(stack)
    for dy, dx, g in offsets:
        total += g * view(wide, dy, dx)
    if how == "sum":
        return total
    inside = padded(np.ones((1, h, w)), ry, rx, border)
    return total / sum(g * view(inside, dy, dx) for dy, dx, g in offsets)


def bilateral(stack: np.ndarray, offsets: list[tuple[int, int, float]], sigma_value: float, border: str) -> np.ndarray:
    """Mean over the offsets, weighted by their weights and by the difference of value to the pixel's own."""
    _, h, w = stack.shape
    ry, rx = max(abs(o[0]) for o in offsets), max(abs(o[1]) for o in offsets)
    wide = padded(stack, ry, rx, border)
    total, weight = np.zeros_like(stack), np.zeros_like(stack)
    for dy, dx, g in offsets:
        v = wide[:, ry + dy : ry + dy + h, rx + dx : rx + dx + w]
        k = g * np.exp(-((v - stack) ** 2) / (2 * sigma_value**2))
        total += k * v
        weight += k
    return total / weight


def diffused(stack: np.ndarray, niter: int, kappa: float, gamma: float) -> np.ndarray:
    """niter steps of diffusion among the four neighbours with exponential conductance; nothing flows over the border."""
    for _ in range(niter):
        flow = np.zeros_like(stack)
        for axis in (1, 2):
            step = np.diff(stack, axis=axis)
            moved = np.exp(-((step / kappa) ** 2)) * step
            low = (slice(None), slice(None, -1)) if axis == 1 else (slice(None), slice(None), slice(None, -1))
            high = (slice(None), slice(1, None)) if axis == 1 else (slice(None), slice(None), slice(1, None))
            flow[low] += moved
            flow[high] -= moved
        stack = stack + gamma * flow
    return stack


def mirrored(c: np.ndarray, size: int) -> np.ndarray:
    """Coordinates within the image for any others, the border pixel repeated in the mirror."""
    c = np.mod(c, 2 * size)
    return np.where(c < size, c, 2 * size - 1 - c)


class Patch:
    """A sparse footprint as a dense window around its pixels, smoothed as a part of its h x w image, whose other pixels are 0."""

    def __init__(self, y: np.ndarray, x: np.ndarray, a: np.ndarray, taps: list[float], margin: int, h: int, w: int):
        r = len(taps) // 2
        reach = r + margin
        self.y0, y1 = max(0, int(y.min()) - reach), min(h, int(y.max()) + 1 + reach)
        self.x0, x1 = max(0, int(x.min()) - reach), min(w, int(x.max()) + 1 + reach)
        dense = np.zeros((y1 - self.y0, x1 - self.x0))
        dense[y - self.y0, x - self.x0] = a
        for axis, (lo, hi, size) in enumerate(((self.y0, y1, h), (self.x0, x1, w))):
            at = mirrored(np.arange(lo - r, hi + r), size)
            real = (at >= lo) & (at < hi)
            wide = np.take(dense, np.clip(at - lo, 0, hi - lo - 1), axis=axis) * (real[:, None] if axis == 0 else real[None, :])
            n = hi - lo
            dense = sum(g * (wide[d : d + n] if axis == 0 else wide[:, d : d + n]) for d, g in enumerate(taps))
        self.v = dense

    def peaks(self, d: int, threshold_rel: float) -> tuple[np.ndarray, np.ndarray]:
        """(y, x) of pixels that are greatest within d in either direction, above 0 and above the share of the peak; the first by (y, x) among equal neighbours."""
        square = [(dy, dx, 1.0) for dy in range(-d, d + 1) for dx in range(-d, d + 1)]
        top = extreme(self.v[None], square, np.maximum, "ignore")[0]
        y, x = np.nonzero((self.v == top) & (self.v > threshold_rel * self.v.max()) & (self.v > 0))
        near = np.zeros(len(y), dtype=bool)
        for i in range(1, len(y)):  # by (y, x), so that what comes before is earlier
            k = np.searchsorted(y[:i], y[i] - d)
            near[i] = bool((np.abs(x[k:i] - x[i]) <= d).any())
        return y[~near] + self.y0, x[~near] + self.x0

    def at(self, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.v[y - self.y0, x - self.x0]


def basins(y: np.ndarray, x: np.ndarray, v: np.ndarray, peaks: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The basin of each pixel, numbered from 1 by the (y, x) of its peak; 0 for pixels that no peak reaches.

    Flooding from the peaks down: always the greatest pixel on the shore hands its basin to its 4 neighbours among the pixels given, which
    join the shore. Of equal pixels the one that joined first goes first, so that plateaus are shared out ring by ring; equal peaks go by (y, x),
    and a pixel's neighbours join from above, left, right and below.
    """
    y0, x0 = int(y.min()) - 1, int(x.min()) - 1
    grid = np.full((int(y.max()) - y0 + 2, int(x.max()) - x0 + 2), -1, np.int64)
    grid[y - y0, x - x0] = np.arange(len(y))
    near = np.stack([grid[y - y0 + dy, x - x0 + dx] for dy, dx in ((-1, 0), (0, -1), (0, 1), (1, 0))], axis=1).tolist()
    py, px = peaks
    starts = grid[py - y0, px - x0][np.lexsort((px, py))].tolist()
    name, down = [0] * len(y), (-v).tolist()
    for number, i in enumerate(starts, 1):
        name[i] = number
    shore = [(down[i], joined, i) for joined, i in enumerate(starts)]
    heapq.heapify(shore)
    joined = len(shore)
    while shore:
        _, _, i = heapq.heappop(shore)
        for j in near[i]:
            if j >= 0 and not name[j]:
                name[j] = name[i]
                heapq.heappush(shore, (down[j], joined, j))
                joined += 1
    return np.array(name, dtype=np.int64)


def components(y: np.ndarray, x: np.ndarray, connectivity: int) -> np.ndarray:
    """For pixels sorted by (y, x) the index of the first one of their connected component (4 or 8 neighbours)."""
    y0, x0 = y.min() - 1, x.min() - 1
    grid = np.full((y.max() - y0 + 2, x.max() - x0 + 2), len(y), np.int64)
    grid[y - y0, x - x0] = np.arange(len(y))
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (connectivity == 8 or not (dy and dx))]
    near = np.stack([grid[y - y0 + dy, x - x0 + dx] for dy, dx in steps])
    label = np.append(np.arange(len(y)), len(y))
    while True:
        least = np.minimum(label[:-1], label[near].min(axis=0))
        least = np.append(least, len(y))
        # a component's label follows its pixels' smaller ones, and chains are cut short
        np.minimum.at(least, label[:-1], least[:-1])
        least = least[least]
        if (least == label).all():
            return label[:-1]
        label = least
