"""numpy kernels of the raster steps: the fast plan for images beyond toy size.

They compute what functions/raster.py expresses in columns; a test holds both together.
Each takes and returns an image (h x w), plus a context dict that carries status,
warnings and measured looks along.
"""

from __future__ import annotations

import numpy as np

EPS = 1e-6


def box(x: np.ndarray, size: int, pad: str = "reflect") -> np.ndarray:
    """Window mean by running sums along each axis."""
    size = int(size) + 1 - int(size) % 2
    if size <= 1:
        return x.astype(np.float64)
    r = size // 2
    p = np.pad(x.astype(np.float64), r, mode="reflect" if pad == "reflect" else "constant")
    for axis in (0, 1):
        c = np.cumsum(p, axis)
        c = np.insert(c, 0, 0.0, axis)
        n = c.shape[axis] - size
        p = (np.take(c, range(size, size + n), axis) - np.take(c, range(n), axis)) / size
    return p


def local_stats(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    m = box(x, size)
    return m, np.maximum(box(x * x, size) - m * m, 0.0)


def looks(x: np.ndarray) -> float:
    return float(np.clip(x.mean() ** 2 / (x.var() + EPS), 1, 64))


def gray01(x: np.ndarray) -> np.ndarray:
    x = x.mean(-1) if x.ndim == 3 else x
    top = x.max() if x.size else 0.0
    with np.errstate(invalid="ignore"):  # an infinite maximum leaves zeros and NaN, which validation handles
        return x / top if top > 1 else x


def validate(x, params, ctx):
    x = gray01(x)
    if np.isnan(x).any():
        fill = 0.0 if params.get("handle_nan", "zero") == "zero" else float(np.nanmedian(x))
        big = float(np.finfo(np.float32).max)
        x = np.nan_to_num(x, nan=fill, posinf=big, neginf=-big)
    x = np.where(np.isposinf(x), 1.0, np.where(np.isneginf(x), 0.0, x))
    if params.get("drop_empty", True) and (not x.size or x.std() < 1e-6):
        ctx["status"], ctx["error"] = "skipped", "empty/constant image"
    return x


def intensity(x, params, ctx):
    x, mode, eps = gray01(x), params.get("mode", "log1p"), float(params.get("eps", 1e-6))
    if mode == "log1p":
        x = np.log1p(x / max(eps, 1e-9))
    elif mode == "db":
        x = 10 * np.log10(x + eps)
    low, high = x.min(), x.max()
    return (x - low) / (high - low) if high - low > EPS else x


def lee(x, size, enl):
    m, s2 = local_stats(x, size)
    ci = s2 / (m * m + EPS)
    return m + np.clip((ci - 1 / enl) / (ci + EPS), 0, 1) * (x - m)


def refined_lee(x, size, enl):
    g = sum(np.abs(np.gradient(x, axis=a)) for a in (0, 1))
    edge = np.clip(g / (np.percentile(g, 95) + EPS), 0, 1) if g.max() > EPS else np.zeros_like(x)
    return edge * x + (1 - edge) * lee(x, size, enl)


def gamma_map(x, size, enl):
    m, s2 = local_stats(x, size)
    ci, cu = s2 / (m * m + EPS), 1 / enl
    a = (1 + cu) / np.maximum(ci - cu, EPS)
    b = a - enl - 1
    guess = (b * m + np.sqrt(np.maximum(b * b * m * m + 4 * a * enl * m * x, 0))) / (2 * a + EPS)
    return np.select([ci > 6 * cu, ci > cu], [x, guess], m)


def frost(x, size, damping):
    size += 1 - size % 2
    r, (h, w) = size // 2, x.shape
    m, s2 = local_stats(x, size)
    vary, p = s2 / (m * m + EPS), np.pad(x, r, mode="reflect")
    top, under = np.zeros_like(x), np.zeros_like(x)
    for dy, dx in np.ndindex(size, size):
        weight = np.exp(-damping * vary * np.hypot(dy - r, dx - r))
        top += weight * p[dy : dy + h, dx : dx + w]
        under += weight
    return top / (under + EPS)


def block_matched(x, sigma, ctx):
    """The bm3d library's filter; refined_lee with a warning where it is not installed or fails."""
    try:
        import bm3d

        noise = float((x - box(x, 3)).std()) if sigma in ("auto", None) else float(sigma)
        return bm3d.bm3d(x, sigma_psd=max(noise, 1e-3))
    except Exception as e:  # whatever ails the library, the image is filtered
        ctx["warnings"].append(f"bm3d: {type(e).__name__}, refined_lee instead")
        return refined_lee(x, 7, looks(x))


def speckle(x, params, ctx):
    x, size = gray01(x), int(params.get("window_size", 7))
    enl = looks(x) if params.get("enl", "auto") in ("auto", None) else float(params["enl"])
    ctx["enl"] = round(enl, 3)
    method = params.get("method", "refined_lee")
    if method == "bm3d":
        out = block_matched(x, params.get("bm3d_sigma", "auto"), ctx)
    elif method == "frost":
        out = frost(x, size, float(params.get("damping_factor", 2.0)))
    else:
        by = {"lee": lee, "refined_lee": refined_lee, "gamma_map": gamma_map}
        out = by[method](x, size, enl) if method in by else x
    return np.clip(out, 0, 1)


def clip_outliers(x, params, ctx):
    x = gray01(x)
    some = x[x > 0] if params.get("ignore_zero", True) and (x > 0).any() else x
    low, high = np.percentile(some, [float(params.get("min_percentile", 0.2)), float(params.get("max_percentile", 99.8))])
    return x if high - low < EPS else np.clip((x - low) / (high - low), 0, 1)


def tone_curve(bins: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    x = np.linspace(0, 1, bins)
    y = np.maximum.accumulate(1 - (1 - x**0.75) ** 1.15)
    return x, (y - y.min()) / (y.max() - y.min() + 1e-8)


def map_histogram(x, params, ctx):
    x, bins = gray01(x), int(params.get("bins", 1024))
    target = ctx.get("target") if params.get("mode") in ("unpaired_optical_reference", "preset") else None
    tx, ty = target if target is not None else tone_curve(bins)
    counts, edges = np.histogram(x, bins, (0.0, 1.0))
    cdf = np.cumsum(counts) / (counts.sum() + EPS)
    out = np.interp(np.interp(x.ravel(), (edges[:-1] + edges[1:]) / 2, cdf), ty, tx).reshape(x.shape)
    clahe = params.get("clahe") or {}
    if clahe.get("enabled"):
        out = equalised(out, int((clahe.get("tile_grid_size") or [8, 8])[0]), float(clahe.get("clip_limit", 2.0)))
    return np.clip(out, 0, 1)


def equalised(x: np.ndarray, grid: int = 8, limit: float = 2.0) -> np.ndarray:
    """Contrast-limited equalisation: a clipped cumulative histogram per tile, blended between tile centres."""
    h, w = x.shape
    u = np.clip(x * 255, 0, 255).astype(int)
    ys, xs = np.array_split(np.arange(h), min(grid, h)), np.array_split(np.arange(w), min(grid, w))
    maps = np.empty((len(ys), len(xs), 256))
    for i, yy in enumerate(ys):
        for j, xx in enumerate(xs):
            c = np.bincount(u[np.ix_(yy, xx)].ravel(), minlength=256).astype(float)
            top = max(limit * c.sum() / 256, 1.0)
            over = np.maximum(c - top, 0).sum()
            maps[i, j] = np.cumsum(np.minimum(c, top) + over / 256) / c.sum()
    cy, cx = np.array([a.mean() for a in ys]), np.array([a.mean() for a in xs])
    fy, fx = (np.interp(np.arange(n), c, np.arange(len(c))) for n, c in ((h, cy), (w, cx)))
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    y1, x1 = np.minimum(y0 + 1, len(cy) - 1), np.minimum(x0 + 1, len(cx) - 1)
    ty, tx = (fy - y0)[:, None], (fx - x0)[None, :]
    at = lambda a, b: maps[a[:, None], b[None, :], u]
    return (1 - ty) * ((1 - tx) * at(y0, x0) + tx * at(y0, x1)) + ty * ((1 - tx) * at(y1, x0) + tx * at(y1, x1))


def shifted(x: np.ndarray, weights: dict[tuple[int, int], float]) -> np.ndarray:
    """Weighted sum over (dy, dx) neighbours, mirrored at borders."""
    (h, w), p = x.shape, np.pad(x, 1, mode="reflect")
    return sum(v * p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for (dy, dx), v in weights.items())


def laplacian(x: np.ndarray) -> np.ndarray:
    return shifted(x, {(-1, 0): 1, (1, 0): 1, (0, -1): 1, (0, 1): 1, (0, 0): -4})


def saliency(x: np.ndarray, size: int = 5, boost: float = 3.0) -> np.ndarray:
    """1 on flat ground, up to 1 + boost where a pixel outshines its window (zero-padded)."""
    bright = np.maximum(x - box(x, size, "zero"), 0)
    return 1 + boost * np.clip(bright / max(np.percentile(bright, 99.5), 1e-5), 0, 1)


def sharpness(x: np.ndarray, size: int = 5, scale: float = 1.0) -> np.ndarray:
    """Edge energy times the coherence of its direction, from the structure tensor."""
    kx = {(dy, dx): dx * (2 - abs(dy)) for dy in (-1, 0, 1) for dx in (-1, 1)}
    gx, gy = shifted(x, kx), shifted(x, {(dx, dy): v for (dy, dx), v in kx.items()})
    xx, yy, xy = (box(g, size, "zero") for g in (gx * gx, gy * gy, gx * gy))
    energy = xx + yy
    coherence = np.clip(np.sqrt((xx - yy) ** 2 + 4 * xy * xy + 1e-12) / (energy + 1e-5), 0, 1)
    return np.clip(energy / (energy + scale), 0, 1) * coherence


def ssim(a: np.ndarray, b: np.ndarray, size: int = 7) -> float:
    """Mean structural similarity over size x size windows."""
    mx, my, xx, yy, xy = (box(v, size) for v in (a, b, a * a, b * b, a * b))
    top = (2 * mx * my + 1e-4) * (2 * (xy - mx * my) + 9e-4)
    return float((top / ((mx * mx + my * my + 1e-4) * ((xx - mx * mx) + (yy - my * my) + 9e-4) + 1e-8)).mean())


def gradient_loss(a: np.ndarray, b: np.ndarray) -> float:
    return float(sum(np.abs(np.diff(a, axis=k) - np.diff(b, axis=k)).mean() for k in (0, 1)))


def _triangle(n: int, m: int) -> np.ndarray:
    """m x n weights of a linear filter that widens when it shrinks."""
    scale = max(n / m, 1.0)
    centre = (np.arange(m) + 0.5) * n / m
    weight = np.maximum(0, 1 - np.abs((np.arange(n) + 0.5)[None, :] - centre[:, None]) / scale)
    return weight / weight.sum(1, keepdims=True)


def resized(x: np.ndarray, h: int, w: int) -> np.ndarray:
    return x if x.shape == (h, w) else _triangle(x.shape[0], h) @ x @ _triangle(x.shape[1], w).T


def resize(x, params, ctx):
    x, size = gray01(x), int(params.get("image_size", 256))
    u = np.floor(np.clip(x, 0, 1) * 255)
    if params.get("mode", "resize") == "center_crop":
        h, w = u.shape
        s = min(h, w)
        u = u[(h - s) // 2 : (h + s) // 2, (w - s) // 2 : (w + s) // 2]
    return np.round(resized(u, size, size)) / 255


def adapt_channels(x, params, ctx):
    return np.stack([x] * int(params.get("output_channels", 3)), -1) if x.ndim == 2 else x


def normalise(x, params, ctx):
    x = np.stack([x] * 3, -1) if x.ndim == 2 else x
    x = np.clip(x, 0, 1)
    return np.floor(x * 255) if params.get("output_range", "uint8") == "uint8" else x


#: Steps by name, in their default order. register() adds to them.
STEPS = {
    "validate_image": validate,
    "sar_intensity_transform": intensity,
    "speckle_filter": speckle,
    "outlier_clipping": clip_outliers,
    "histogram_mapping": map_histogram,
    "resize_or_tile": resize,
    "channel_adapter": adapt_channels,
    "normalize_for_cut": normalise,
}


def register(name: str, fn) -> None:
    """Adds a step fn(image, params, context) -> image."""
    STEPS[name] = fn
