"""Packed rasters: a row holds h, w and the row-major array of an image.

Neighbourhood operators are array expressions over one row, so no image is ever
shuffled and a plan scales with the number of images.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import clip, interpolate, let, mean, percentile, total, variance

EPS = 1e-6


def reflect(i: Column, n: Column) -> Column:
    """Mirrored index that does not repeat the border."""
    return F.when(i < 0, -i).when(i >= n, 2 * (n - 1) - i).otherwise(i)


def pixels(h: Column, w: Column, fn) -> Column:
    """fn(y, x, i) of every pixel, row by row."""
    return F.transform(F.sequence(F.lit(0), h * w - 1), lambda i: fn(F.floor(i / w).cast("int"), i % w, i))


def convolve(data: Column, h: Column, w: Column, weights: dict[tuple[int, int], float], pad: str = "reflect") -> Column:
    """Weighted sum over (dy, dx) offsets; pad is reflect or zero."""

    def of(d: Column) -> Column:
        def at(y: Column, x: Column, i: Column) -> Column:
            out = F.lit(0.0)
            for (dy, dx), weight in weights.items():
                ny, nx = y + dy, x + dx
                if pad == "reflect":
                    v = F.get(d, reflect(ny, h) * w + reflect(nx, w))
                else:
                    inside = (ny >= 0) & (ny < h) & (nx >= 0) & (nx < w)
                    v = F.when(inside, F.get(d, ny * w + nx)).otherwise(F.lit(0.0))
                out = out + F.lit(float(weight)) * v
            return out

        return pixels(h, w, at)

    return let(data, of)


def box_mean(data: Column, h: Column, w: Column, size: int, pad: str = "reflect") -> Column:
    """Mean over a size x size window (an even size counts as the next odd one), in two passes."""
    size += 1 - size % 2
    if size <= 1:
        return data
    r = size // 2
    rows = convolve(data, h, w, {(0, d): 1 / size for d in range(-r, r + 1)}, pad)
    return convolve(rows, h, w, {(d, 0): 1 / size for d in range(-r, r + 1)}, pad)


def squared(d: Column) -> Column:
    return F.transform(d, lambda v: v * v)


def local_stats(data: Column, h: Column, w: Column, size: int) -> Column:
    """Array of (m, s2): window mean and population variance, not under zero."""
    m, sq = box_mean(data, h, w, size), box_mean(squared(data), h, w, size)
    return F.zip_with(m, sq, lambda a, b: F.struct(a.alias("m"), F.greatest(b - a * a, F.lit(0.0)).alias("s2")))


def gray01(data: Column) -> Column:
    """Divided by its own maximum where that exceeds one; images with NaN stay as they are."""

    def of(d: Column) -> Column:
        scaled = let(F.array_max(d), lambda m: F.when(m > 1.0, F.transform(d, lambda v: v / m)).otherwise(d))
        return F.when(F.exists(d, F.isnan), d).otherwise(scaled)

    return let(data, of)


def replace_bad(data: Column) -> Column:
    """NaN to zero - infinities then become the largest single float - else +Inf to one and -Inf to zero."""
    top = 3.4028234663852886e38

    def of(d: Column) -> Column:
        def pick(v: Column, nan: Column) -> Column:
            high, low = F.when(nan, F.lit(top)).otherwise(1.0), F.when(nan, F.lit(-top)).otherwise(0.0)
            return F.when(F.isnan(v), 0.0).when(v == float("inf"), high).when(v == float("-inf"), low).otherwise(v)

        return let(F.exists(d, F.isnan), lambda nan: F.transform(d, lambda v: pick(v, nan)))

    return let(data, of)


def validated(data: Column) -> Column:
    return replace_bad(gray01(data))


def is_constant(data: Column) -> Column:
    return F.sqrt(variance(data)) < 1e-6


def intensity(data: Column, mode: str = "log1p", eps: float = 1e-6) -> Column:
    """Logarithmic intensity (log1p, db or none), then stretched to 0..1."""
    if mode == "log1p":
        data = F.transform(data, lambda v: F.log1p(v / max(eps, 1e-9)))
    elif mode == "db":
        data = F.transform(data, lambda v: 10.0 * F.log10(v + eps))

    def of(d: Column) -> Column:
        def stretched(b: Column) -> Column:
            return F.when(b["hi"] - b["lo"] > EPS, F.transform(d, lambda v: (v - b["lo"]) / (b["hi"] - b["lo"]))).otherwise(d)

        return let(F.struct(F.array_min(d).alias("lo"), F.array_max(d).alias("hi")), stretched)

    return let(data, of)


def looks(data: Column) -> Column:
    """Equivalent number of looks of a whole image, within 1..64."""
    return let(F.struct(mean(data).alias("m"), variance(data).alias("v")), lambda s: clip(s["m"] * s["m"] / (s["v"] + EPS), 1.0, 64.0))


def _per_pixel(data: Column, h: Column, w: Column, size: int, fn) -> Column:
    """fn(value, local mean, local variance, looks) per pixel, clipped to 0..1."""

    def of(d: Column) -> Column:
        return let(looks(d), lambda enl: F.zip_with(d, local_stats(d, h, w, size), lambda v, s: clip(fn(v, s["m"], s["s2"], enl), 0.0, 1.0)))

    return let(data, of)


def _lee(v, m, s2, enl):
    ci2, cu2 = s2 / (m * m + EPS), 1.0 / enl
    return m + clip((ci2 - cu2) / (ci2 + EPS), 0.0, 1.0) * (v - m)


def lee(data: Column, h: Column, w: Column, size: int = 7) -> Column:
    return _per_pixel(data, h, w, size, _lee)


def central_gradient(data: Column, h: Column, w: Column) -> Column:
    """Sum of the absolute central differences along both axes; one-sided at borders."""

    def of(d: Column) -> Column:
        def along(y, x, i, n, at, step):
            a, b = F.get(d, i - step), F.get(d, i + step)
            return F.abs(F.when(at == 0, b - F.get(d, i)).when(at == n - 1, F.get(d, i) - a).otherwise((b - a) / 2.0))

        return pixels(h, w, lambda y, x, i: along(y, x, i, w, x, F.lit(1)) + along(y, x, i, h, y, w))

    return let(data, of)


def refined_lee(data: Column, h: Column, w: Column, size: int = 7) -> Column:
    """Lee's filter blended with the original along strong gradients."""

    def of(d: Column) -> Column:
        def blend(g: Column) -> Column:
            edge = let(percentile(g, 95), lambda p: F.transform(g, lambda v: F.when(F.array_max(g) > EPS, clip(v / (p + EPS), 0.0, 1.0)).otherwise(0.0)))
            pairs = F.zip_with(d, edge, lambda v, e: F.struct(v.alias("v"), e.alias("e")))
            unclipped = let(looks(d), lambda enl: F.zip_with(d, local_stats(d, h, w, size), lambda v, s: _lee(v, s["m"], s["s2"], enl)))
            return F.zip_with(pairs, unclipped, lambda p, f: clip(p["e"] * p["v"] + (1.0 - p["e"]) * f, 0.0, 1.0))

        return let(central_gradient(d, h, w), blend)

    return let(data, of)


def gamma_map(data: Column, h: Column, w: Column, size: int = 7) -> Column:
    def at(v, m, s2, enl):
        ci2, cu2 = s2 / (m * m + EPS), 1.0 / enl
        alpha = (1.0 + cu2) / F.greatest(ci2 - cu2, F.lit(EPS))
        b = alpha - enl - 1.0
        root = F.sqrt(F.greatest(b * b * m * m + 4.0 * alpha * enl * m * v, F.lit(0.0)))
        estimate = (b * m + root) / (2.0 * alpha + EPS)
        return F.when(ci2 > cu2 * 6.0, v).when(ci2 > cu2, estimate).otherwise(m)

    return _per_pixel(data, h, w, size, at)


def frost(data: Column, h: Column, w: Column, size: int = 7, damping: float = 2.0) -> Column:
    """Window mean with weights that fall with distance, the faster the more the window varies."""
    size += 1 - size % 2
    r = size // 2

    def of(d: Column) -> Column:
        def with_stats(stats: Column) -> Column:
            def at(y, x, i):
                def weighed(s2: Column) -> Column:
                    top, under = F.lit(0.0), F.lit(EPS)
                    for dy in range(-r, r + 1):
                        for dx in range(-r, r + 1):
                            weight = F.exp(-damping * s2 * float((dy * dy + dx * dx) ** 0.5))
                            top = top + weight * F.get(d, reflect(y + dy, h) * w + reflect(x + dx, w))
                            under = under + weight
                    return clip(top / under, 0.0, 1.0)

                s = F.get(stats, i)
                return let(s["s2"] / (s["m"] * s["m"] + EPS), weighed)

            return pixels(h, w, at)

        return let(local_stats(d, h, w, size), with_stats)

    return let(data, of)


def clip_outliers(data: Column, low: float = 0.2, high: float = 99.8, ignore_zero: bool = True) -> Column:
    """Stretched between two percentiles, of the positive pixels if there are any."""

    def of(d: Column) -> Column:
        some = F.filter(d, lambda v: v > 0)
        used = F.when(F.size(some) > 0, some).otherwise(d) if ignore_zero else d

        def cut(b: Column) -> Column:
            return F.when(b["hi"] - b["lo"] < EPS, d).otherwise(F.transform(d, lambda v: clip((v - b["lo"]) / (b["hi"] - b["lo"]), 0.0, 1.0)))

        return let(let(used, lambda u: F.struct(percentile(u, low).alias("lo"), percentile(u, high).alias("hi"))), cut)

    return let(data, of)


def bin_of(v: Column, bins: int) -> Column:
    """Histogram bin over 0..1, the last one closed."""
    return F.least(F.floor(v * bins), F.lit(bins - 1)).cast("int")


def tone_curve(bins: int = 1024) -> Column:
    """Target curve: struct of x and the rising y over ``bins`` points."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: i / F.lit(float(bins - 1)))

    def of(x: Column) -> Column:
        raw = F.transform(x, lambda v: 1.0 - F.pow(1.0 - F.pow(v, F.lit(0.75)), F.lit(1.15)))  # rises, so it is its own running maximum
        y = let(raw, lambda r: F.transform(r, lambda v: (v - F.array_min(r)) / (F.array_max(r) - F.array_min(r) + 1e-8)))
        return F.struct(x.alias("x"), y.alias("y"))

    return let(grid, of)


def map_histogram(data: Column, bins: int, target: Column) -> Column:
    """Each pixel's rank in the image's histogram, looked up in the target curve's inverse."""

    def of(d: Column) -> Column:
        def with_cdf(cdf: Column) -> Column:
            def rank(v: Column) -> Column:
                t = clip(v * bins - 0.5, 0.0, bins - 1.0)
                b = F.least(F.floor(t), F.lit(bins - 2)).cast("int")
                return F.get(cdf, b) + (F.get(cdf, b + 1) - F.get(cdf, b)) * (t - b)

            return let(target, lambda c: F.transform(d, lambda v: clip(interpolate(rank(v), c["y"], c["x"]), 0.0, 1.0)))

        binned = F.transform(F.filter(d, lambda v: (v >= 0) & (v <= 1)), lambda v: bin_of(v, bins))
        counts = let(binned, lambda bs: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(bs, lambda k: k <= b)) / (F.size(bs) + EPS)))
        return let(counts, with_cdf)

    return let(data, of)


def to_u8(data: Column) -> Column:
    """0..1 to whole numbers 0..255, cut off, not rounded."""
    return F.transform(data, lambda v: F.floor(clip(v, 0.0, 1.0) * 255.0).cast("int"))


def channels(data: Column, n: int = 3) -> Column:
    return F.array_repeat(data, n)


def laplacian(data: Column, h: Column, w: Column) -> Column:
    return convolve(data, h, w, {(-1, 0): 1, (1, 0): 1, (0, -1): 1, (0, 1): 1, (0, 0): -4})


def differences(data: Column, h: Column, w: Column, axis: int) -> Column:
    """First differences along x (axis 1) or y (axis 0), borders left out."""

    def of(d: Column) -> Column:
        inside = (lambda y, x: x < w - 1) if axis else (lambda y, x: y < h - 1)
        step = F.lit(1) if axis else w
        return F.filter(pixels(h, w, lambda y, x, i: F.when(inside(y, x), F.get(d, i + step) - F.get(d, i))), lambda v: v.isNotNull())

    return let(data, of)


def entropy(data: Column, bins: int = 256) -> Column:
    """Bits of the histogram over 0..1, by run lengths of the sorted bins."""

    def of(s: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == F.size(s) - 1) | (F.get(s, i) != F.get(s, i + 1)))
        runs = let(ends, lambda e: F.transform(e, lambda b, k: (b - F.coalesce(F.get(e, k - 1), F.lit(-1))) / (F.size(s) + 1e-8)))
        return -total(F.transform(runs, lambda p: p * F.log2(p)))

    return let(F.sort_array(F.transform(F.filter(data, lambda v: (v >= 0) & (v <= 1)), lambda v: bin_of(v, bins))), of)


def correlation(a: Column, b: Column) -> Column:
    """Pearson's coefficient with a guarded denominator: zero for constant images."""
    both = F.struct(a.alias("a"), b.alias("b"), mean(a).alias("ma"), mean(b).alias("mb"))

    def of(s: Column) -> Column:
        ab = total(F.zip_with(s["a"], s["b"], lambda x, y: (x - s["ma"]) * (y - s["mb"])))
        aa = total(F.transform(s["a"], lambda x: (x - s["ma"]) * (x - s["ma"])))
        bb = total(F.transform(s["b"], lambda y: (y - s["mb"]) * (y - s["mb"])))
        return ab / (F.sqrt(aa * bb) + 1e-8)

    return let(both, of)


def psnr(a: Column, b: Column) -> Column:
    return let(mean(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))), lambda m: F.when(m <= 1e-8, 100.0).otherwise(10.0 * F.log10(1.0 / F.greatest(m, F.lit(1e-300)))))


def edge_preservation(a: Column, b: Column, h: Column, w: Column) -> Column:
    return let(F.struct(laplacian(a, h, w).alias("a"), laplacian(b, h, w).alias("b")), lambda s: correlation(s["a"], s["b"]))


def ssim(a: Column, b: Column, h: Column, w: Column, size: int = 7) -> Column:
    """Mean structural similarity over size x size windows."""

    def of(s: Column) -> Column:
        x, y = s["x"], s["y"]
        xy = F.zip_with(x, y, lambda p, q: p * q)
        maps = [box_mean(v, h, w, size) for v in (x, y, squared(x), squared(y), xy)]
        stacked = F.struct(*[m.alias(n) for m, n in zip(maps, "abcde", strict=True)])

        def over(m: Column) -> Column:
            def at(i: Column) -> Column:
                mx, my, xx, yy, pq = (F.get(m[n], i) for n in "abcde")
                top = (2 * mx * my + 1e-4) * (2 * (pq - mx * my) + 9e-4)
                return top / ((mx * mx + my * my + 1e-4) * ((xx - mx * mx) + (yy - my * my) + 9e-4) + 1e-8)

            return mean(F.transform(F.sequence(F.lit(0), h * w - 1), at))

        return let(stacked, over)

    return let(F.struct(a.alias("x"), b.alias("y")), of)


def saliency(data: Column, h: Column, w: Column, size: int = 5, boost: float = 3.0) -> Column:
    """1 on flat ground, up to 1 + boost where a pixel outshines its window (zero-padded)."""

    def of(d: Column) -> Column:
        bright = F.zip_with(d, box_mean(d, h, w, size, "zero"), lambda v, m: F.greatest(v - m, F.lit(0.0)))
        return let(bright, lambda c: let(F.greatest(percentile(c, 99.5), F.lit(1e-5)), lambda top: F.transform(c, lambda v: 1.0 + boost * clip(v / top, 0.0, 1.0))))

    return let(data, of)


def sharpness(data: Column, h: Column, w: Column, size: int = 5, scale: float = 1.0) -> Column:
    """Edge energy times the coherence of its direction, from the structure tensor."""
    kx = {(-1, -1): -1, (-1, 1): 1, (0, -1): -2, (0, 1): 2, (1, -1): -1, (1, 1): 1}
    ky = {(dx, dy): v for (dy, dx), v in kx.items()}

    def of(g: Column) -> Column:
        parts = [F.zip_with(g["x"], g["x"], lambda p, q: p * q), F.zip_with(g["y"], g["y"], lambda p, q: p * q), F.zip_with(g["x"], g["y"], lambda p, q: p * q)]
        stacked = F.struct(*[box_mean(p, h, w, size, "zero").alias(n) for p, n in zip(parts, "abc", strict=True)])

        def over(m: Column) -> Column:
            def at(i: Column) -> Column:
                xx, yy, xy = (F.get(m[n], i) for n in "abc")
                energy = xx + yy
                coherence = clip(F.sqrt((xx - yy) * (xx - yy) + 4.0 * xy * xy + 1e-12) / (energy + 1e-5), 0.0, 1.0)
                return clip(energy / (energy + scale), 0.0, 1.0) * coherence

            return F.transform(F.sequence(F.lit(0), h * w - 1), at)

        return let(stacked, over)

    return let(F.struct(convolve(data, h, w, kx).alias("x"), convolve(data, h, w, ky).alias("y")), of)
