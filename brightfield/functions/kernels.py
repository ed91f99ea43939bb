"""Numpy kernels for single images, traces and small matrices; Spark deals out the work."""

from __future__ import annotations

import numpy as np


def phase_shift(fixed: np.ndarray, moving: np.ndarray, upsample: int = 100) -> tuple[float, float]:
    """(dy, dx) that moves `moving` onto `fixed`: the peak of the phase correlation, refined by a matrix Fourier transform around it."""
    return spectra_shift(np.fft.rfft2(fixed), np.fft.rfft2(moving), fixed.shape, upsample)


def spectra_shift(f: np.ndarray, g: np.ndarray, shape: tuple[int, int], upsample: int = 100) -> tuple[float, float]:
    """phase_shift from the half spectra (rfft2) of both images, so that one transform of an image serves all its registrations.

    The columns that the half leaves out are conjugates, and their part of a sum is the real part of the others once more. Only the row of the highest
    frequency of an even height, which has no partner, is summed over the whole width.
    """
    h, w = shape
    cross = f * np.conj(g)
    cross /= np.maximum(np.abs(cross), 1e-12 * max(np.abs(cross).max(), 1e-300))
    corr = np.abs(np.fft.irfft2(cross, s=shape))
    peak = np.array(np.unravel_index(corr.argmax(), corr.shape), dtype=float)
    peak = np.where(peak > np.array([h, w]) // 2, peak - np.array([h, w]), peak)
    if upsample <= 1:
        return float(peak[0]), float(peak[1])
    ky, kx = np.fft.fftfreq(h), np.fft.fftfreq(w)[: cross.shape[1]]
    twice = np.where((kx != 0) & (kx != -0.5), 2.0, 1.0)
    lone = None
    if h % 2 == 0:
        row = cross[h // 2]
        lone, cross = np.concatenate([row, np.conj(row[1 : (w + 1) // 2][::-1])]), cross.copy()
        cross[h // 2] = 0
    for scale in (10, upsample):
        reach = 1.5 if scale == 10 else 0.15
        steps = np.arange(-np.ceil(reach * scale), np.ceil(reach * scale) + 1) / scale
        centre = np.round(peak * scale) / scale
        ey = np.exp(2j * np.pi * np.outer(centre[0] + steps, ky))
        ex = np.exp(2j * np.pi * np.outer(kx, centre[1] + steps))
        pairs = kx != -0.5
        fine = ((ey @ cross[:, pairs] * twice[pairs]) @ ex[pairs]).real + 0j
        if not pairs.all():
            fine += ey @ cross[:, ~pairs] @ ex[~pairs]
        if lone is not None:
            fine += np.outer(ey[:, h // 2], lone @ np.exp(2j * np.pi * np.outer(np.fft.fftfreq(w), centre[1] + steps)))
        fine = np.abs(fine)
        i, j = np.unravel_index(fine.argmax(), fine.shape)
        peak = np.array([centre[0] + steps[i], centre[1] + steps[j]])
    return float(peak[0]), float(peak[1])


def warp(image: np.ndarray, dy: float, dx: float, fill: float = 0.0) -> np.ndarray:
    """image translated back by the motion (dy, dx), bilinear."""
    h, w = image.shape
    y, x = np.arange(h)[:, None] + dy, np.arange(w)[None, :] + dx
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - y0, x - x0
    out = np.zeros((h, w))
    weight = np.zeros((h, w))
    for oy, gy in ((0, 1 - fy), (1, fy)):
        for ox, gx in ((0, 1 - fx), (1, fx)):
            yy, xx = y0 + oy, x0 + ox
            real = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
            g = gy * gx * real
            out += g * image[np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)]
            weight += g
    return out + (1 - weight) * fill


def power(trace: np.ndarray) -> np.ndarray:
    """Power by non-negative frequency, of one trace or of each row."""
    return np.abs(np.fft.rfft(trace)) ** 2


def hull_area(y: np.ndarray, x: np.ndarray) -> float:
    """Area of the convex hull of pixels as unit squares, by a monotone chain over their corners."""
    corners = np.unique(np.concatenate([np.stack([y + a, x + b], 1) for a in (0, 1) for b in (0, 1)]), axis=0).astype(float)
    corners = corners[np.lexsort((corners[:, 1], corners[:, 0]))]

    def chain(points):
        out: list[np.ndarray] = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    hull = np.array(chain(corners) + chain(corners[::-1]))
    a, b = hull, np.roll(hull, -1, axis=0)
    return float(abs((a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]).sum()) / 2)


def ar_coefficients(trace: np.ndarray, p: int, segment: int = 1000) -> np.ndarray:
    """AR(p) by Yule-Walker on the whole segments of the centred trace, their median, shrunk until every root lies inside the unit circle.

    A trace shorter than a segment is one. A flat segment has no solution, and the result is 0.9^k then.
    """
    fallback = 0.9 ** np.arange(1, p + 1)
    size = min(segment, len(trace))
    if size <= p or np.ptp(trace) <= 1e-12 * np.abs(trace).max():
        return fallback
    found = []
    for x in (trace - trace.mean())[: len(trace) // size * size].reshape(-1, size):
        r = np.array([(x[: size - k] * x[k:]).sum() for k in range(p + 1)])
        if r[0] == 0:
            return fallback
        m = r[np.abs(np.arange(p)[:, None] - np.arange(p)[None, :])]
        if np.linalg.matrix_rank(m) == p:
            found.append(np.linalg.solve(m, r[1:]))
    g = np.median(found, axis=0) if found else fallback
    for _ in range(500):
        if np.abs(np.roots(np.concatenate([[1.0], -g]))).max(initial=0) < 1:
            break
        g = g * 0.95
    return g


def impulse(g: np.ndarray, n: int) -> np.ndarray:
    """Response of c[t] = sum g_k c[t - k] + s[t] to one spike."""
    return impulses(g[None, :], n)[0]


def impulses(g: np.ndarray, n: int) -> np.ndarray:
    """Responses (m, n) of c[t] = sum g_k c[t - k] + s[t] to one spike, for coefficients (m, p)."""
    out = np.zeros((len(g), n))
    out[:, 0] = 1.0
    for t in range(1, n):
        for k in range(1, min(g.shape[1], t) + 1):
            out[:, t] += g[:, k - 1] * out[:, t - k]
    return out


def baseline(u: np.ndarray, decay: np.ndarray) -> tuple[float, float]:
    """baselines of one trace."""
    b, c0 = baselines(u[None, :], decay[None, :])
    return float(b[0]), float(c0[0])


def baselines(u: np.ndarray, decay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """b and c0 of each row, not negative, with the least |u - b - c0 * decay|^2: both, one or none of them, whichever is allowed and least."""
    n, d1, d2, u1, ud = u.shape[1], decay.sum(axis=1), _dot(decay, decay), u.sum(axis=1), _dot(u, decay)
    det = n * d2 - d1 * d1
    apart = det > 1e-12 * n * d2
    over = np.where(apart, det, 1.0)
    b, c0 = (d2 * u1 - d1 * ud) / over, (n * ud - d1 * u1) / over
    both = apart & (b >= 0) & (c0 >= 0)
    one_b, one_c = np.maximum(0.0, u1 / n), np.maximum(0.0, ud / d2)
    first = u1 * one_b >= ud * one_c
    return np.where(both, b, np.where(first, one_b, 0.0)), np.where(both, c0, np.where(first, 0.0, one_c))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def deconvolve(y: np.ndarray, g: np.ndarray, sigma: float, lam: float, iters: int = 5000, zero: float = 5e-4, tol: float = 1e-5, every: int = 10) -> dict:
    """deconvolve_all of one trace."""
    made = deconvolve_all(y[None, :], g[None, :], np.array([sigma]), lam, iters, zero, tol, every)
    return {k: v[0] if v[0].ndim else v[0].item() for k, v in made.items()}


def deconvolve_all(y: np.ndarray, g: np.ndarray, sigma: np.ndarray, lam: float, iters: int = 5000, zero: float = 5e-4, tol: float = 1e-5, every: int = 10) -> dict[str, np.ndarray]:
    """For each trace, a row of y, minimises P = 0.5 |y - (c + b + c0 d^t)|^2 + lam * sigma * |s|_1 over s, b, c0 >= 0, where s[t] = c[t] - sum g_k c[t - k].

    Accelerated projected gradient on s, begun anew where it runs against the descent; b and c0 are the best for each s, and c follows
    from s by the response to a spike, computed with FFTs. It ends with a certificate: with r what is left of y, the response's products with
    r are at most lam * sigma at the optimum, r has no positive part along the baseline, and so a scaled r is feasible in the dual
    problem, max 0.5 |y|^2 - 0.5 |y - r|^2. `gap` is P less that maximum's value at the scaled r, `kkt` the largest breach of the optimality
    conditions of s; both are shares, of 0.5 |y|^2 and of the largest product of the response with y. The iteration stops at a gap of `tol` and
    is cut off after `iters` rounds, which the gap then shows. Values under `zero` are set to 0 afterwards.
    A response that turns negative is reported by `negative`. Rows are worked on together and leave as they are done; none depends on another.
    """
    m, n = y.shape
    size = 1 << int(np.ceil(np.log2(2 * n)))
    h = impulses(g, n)
    hf = np.fft.rfft(h, size)
    forward = lambda s, hf: np.fft.irfft(np.fft.rfft(s, size) * hf, size)[:, :n]
    back = lambda r, hf: np.fft.irfft(np.fft.rfft(r, size) * np.conj(hf), size)[:, :n]
    companion = np.zeros((m, g.shape[1], g.shape[1]))
    companion[:, 0, :] = g
    companion[:, np.arange(1, g.shape[1]), np.arange(g.shape[1] - 1)] = 1.0
    decay = np.abs(np.linalg.eigvals(companion)).max(axis=1, initial=0.0)[:, None] ** np.arange(n)
    step = 1.0 / np.maximum((np.abs(hf) ** 2).max(axis=1), 1e-12)
    weight, energy = lam * sigma, np.maximum(0.5 * _dot(y, y), 1e-300)
    pull = np.maximum(np.abs(back(y, hf)).max(axis=1), 1e-300)

    def left_of(s, y, hf, decay):
        u = y - forward(s, hf)
        b, c0 = baselines(u, decay)
        return u - b[:, None] - c0[:, None] * decay, b, c0

    def certificate(s, y, hf, decay, step, weight, energy, pull):
        r, b, c0 = left_of(s, y, hf, decay)
        product = back(r, hf)
        most = product.max(axis=1)
        theta = r * np.where(most > 0, np.minimum(1.0, weight / np.where(most > 0, most, 1.0)), 1.0)[:, None]
        gap = (0.5 * _dot(r, r) + weight * s.sum(axis=1)) - (energy - 0.5 * _dot(y - theta, y - theta))
        over = product - weight[:, None]
        breach = np.where(s > 0, np.abs(over), np.maximum(0.0, over)).max(axis=1)
        return np.maximum(0.0, gap) / energy, breach / pull, b, c0

    given = (y, hf, decay, step, weight, energy, pull)
    done, rounds = np.zeros((m, n)), np.zeros(m, dtype=np.int64)
    shown = certificate(done, *given)
    at = np.flatnonzero(shown[0] > tol)
    given = tuple(a[at] for a in given)
    s = z = np.zeros((len(at), n))
    t = np.ones(len(at))
    for turn in range(1, iters + 1):
        if not len(at):
            break
        y_, hf_, decay_, step_, weight_ = given[:5]
        r, _, _ = left_of(z, y_, hf_, decay_)
        s_new = np.maximum(0.0, z + step_[:, None] * (back(r, hf_) - weight_[:, None]))
        t = np.where(_dot(z - s_new, s_new - s) > 0, 1.0, t)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = s_new + ((t - 1) / t_new)[:, None] * (s_new - s)
        s, t = s_new, t_new
        if turn % every == 0 or turn == iters:
            now = certificate(s, *given)
            for whole, part in zip(shown, now, strict=True):
                whole[at] = part
            done[at], rounds[at] = s, turn
            go = now[0] > tol
            if not go.all():
                at, s, z, t, given = at[go], s[go], z[go], t[go], tuple(a[go] for a in given)
    gap, kkt, b, c0 = shown
    s = np.where(done < zero, 0.0, done)
    c = forward(s, hf)
    return {"c": np.where(c < zero, 0.0, c), "s": s, "b": b, "c0": c0, "decay": decay, "rounds": rounds, "negative": np.minimum(0.0, h.min(axis=1)), "gap": gap, "kkt": kkt}
