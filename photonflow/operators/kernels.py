"""Numpy kernels on single frames, for images.frame_filter. Edges are reflected unless a kernel says otherwise."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from photonflow.operators.images import gaussian, label

Kernel = Callable[[np.ndarray], np.ndarray]


def neighbourhood(reduce: Callable[..., np.ndarray], size_y: int = 3, size_x: int = 3) -> Kernel:
    """A reduction over the box around each pixel (odd sizes): np.max, np.min, np.mean, np.median."""

    def run(image: np.ndarray) -> np.ndarray:
        padded = np.pad(image, [(size_y // 2,) * 2, (size_x // 2,) * 2], mode="symmetric")
        return reduce(sliding_window_view(padded, (size_y, size_x)), axis=(2, 3))

    return run


def despeckle(size: int = 3, nearest: int = 3) -> Kernel:
    """Median of the neighbours closest in value to the centre pixel."""

    def run(image: np.ndarray) -> np.ndarray:
        padded = np.pad(image, size // 2, mode="symmetric")
        box = sliding_window_view(padded, (size, size)).reshape(*image.shape, size * size)
        order = np.argsort(np.abs(box - image[..., None]), axis=2, kind="stable")[..., :nearest]
        return np.median(np.take_along_axis(box, order, 2), axis=2)

    return run


def difference_of_gaussians(narrow: float, wide: float) -> Kernel:
    a, b = gaussian(narrow), gaussian(wide)
    return lambda image: a(image) - b(image)


def mask_edges(width: int) -> Kernel:
    def run(image: np.ndarray) -> np.ndarray:
        out = np.zeros_like(image)
        out[width:-width, width:-width] = image[width:-width, width:-width]
        return out

    return run


def disc(radius: float) -> np.ndarray:
    r = int(np.ceil(radius))
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    return x * x + y * y <= radius * radius


def grey_morphology(reduce: Callable[..., np.ndarray], radius: float) -> Kernel:
    """np.max dilates, np.min erodes, over a disc: shifted frames are folded one by one."""
    shape = disc(radius)
    r = shape.shape[0] // 2
    fold = {np.max: np.maximum, np.min: np.minimum}[reduce]

    def run(image: np.ndarray) -> np.ndarray:
        padded = np.pad(image, r, mode="symmetric")
        out = None
        for y, x in np.argwhere(shape):
            part = padded[y : y + image.shape[0], x : x + image.shape[1]]
            out = part.copy() if out is None else fold(out, part, out=out)
        return out

    return run


def white_tophat(radius: float) -> Kernel:
    erode, dilate = grey_morphology(np.min, radius), grey_morphology(np.max, radius)
    return lambda image: image - dilate(erode(image))


def binary_morphology(grow: bool, radius: float, iterations: int = 1) -> Kernel:
    step = grey_morphology(np.max if grow else np.min, radius)

    def run(image: np.ndarray) -> np.ndarray:
        out = (image > 0).astype(float)
        for _ in range(iterations):
            out = step(out)
        return out

    return run


def fill_holes(image: np.ndarray) -> np.ndarray:
    """Background that can't reach the edge becomes foreground."""
    mask = image > 0
    outside = label(np.pad(~mask, 1, constant_values=True).astype(float))
    return (outside[1:-1, 1:-1] != outside[0, 0]).astype(float)


def label_regions(least: int = 1) -> Kernel:
    """Connected regions above 0.5, numbered; those of `least` pixels or fewer go if that is above 1."""

    def run(image: np.ndarray) -> np.ndarray:
        ids = label((image > 0.5).astype(float))
        if least > 1:
            small = np.bincount(ids.ravel()) <= least
            ids = label(np.where(small[ids], 0, ids).astype(float))
        return ids.astype(float)

    return run


def largest_label(image: np.ndarray) -> np.ndarray:
    n = np.bincount(image.astype(int).ravel())
    n[0] = 0
    return (image == n.argmax()).astype(float) if n.any() else np.zeros_like(image)


def otsu_level(image: np.ndarray, bins: int = 255) -> float:
    """The level that parts the histogram with the largest variance between the two sides."""
    n, edges = np.histogram(image, bins)
    mid = (edges[1:] + edges[:-1]) / 2
    w = np.cumsum(n)
    m = np.cumsum(n * mid)
    with np.errstate(invalid="ignore", divide="ignore"):
        between = (m[-1] * w / w[-1] - m) ** 2 / (w * (w[-1] - w))
    return float(mid[np.nanargmax(np.where(np.isfinite(between), between, -1))])


def isodata_level(image: np.ndarray, bins: int = 255, tolerance: float = 1e-5) -> float:
    """The level midway between the means of the two sides, found from the middle of the range on; by a histogram of `bins` edges."""
    n, edges = np.histogram(image, np.linspace(image.min(), image.max(), bins) if np.ptp(image) else bins)
    mid = (edges[1:] + edges[:-1]) / 2
    count, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * mid)])
    level = mid[len(edges) // 2]
    for _ in range(10_000):
        k = int(np.searchsorted(mid, level))
        if not 0 < count[k] < count[-1]:
            break
        new = (total[k] / count[k] + (total[-1] - total[k]) / (count[-1] - count[k])) / 2
        if abs(new - level) <= tolerance:
            return float(new)
        level = new
    return float(level)


def fractional_level(image: np.ndarray, share: float, bins: int = 5000) -> float:
    """The level above which the brightest pixels hold about `share` of all intensity."""
    n, edges = np.histogram(image, bins)
    mid = (edges[1:] + edges[:-1]) / 2
    total = np.cumsum(n * mid)
    return float(mid[np.abs(total - (1 - share) * total[-1]).argmin()])


def threshold_by(level: Callable[[np.ndarray], float]) -> Kernel:
    return lambda image: (image > level(image)).astype(float)


def local_maxima(level: float, distance: int) -> Kernel:
    peak = neighbourhood(np.max, 2 * distance + 1, 2 * distance + 1)
    return lambda image: ((image == peak(image)) & (image > level)).astype(float)


def _square_distance(mask: np.ndarray) -> np.ndarray:
    """Squared distance of each pixel to the nearest one of the mask: first along columns, then the best of all rows.

    Rows are tried from near to far, and no farther than the largest distance that is left.
    """
    far = float(mask.shape[0] + mask.shape[1]) ** 2 + 1
    up = np.full(mask.shape, far)
    run = np.full(mask.shape[1], np.sqrt(far))
    for order in (range(mask.shape[0]), reversed(range(mask.shape[0]))):
        run[:] = np.sqrt(far)
        for y in order:
            run = np.where(mask[y], 0.0, run + 1)
            up[y] = np.minimum(up[y], run * run)
    out = up.copy()
    for d in range(1, mask.shape[1]):
        if d * d >= out.max():
            break
        out[:, d:] = np.minimum(out[:, d:], up[:, :-d] + d * d)
        out[:, :-d] = np.minimum(out[:, :-d], up[:, d:] + d * d)
    return out


def distance_transform(image: np.ndarray) -> np.ndarray:
    """Signed Euclidean distance to the edge of data > 0.5, negative inside; 0 where there is no edge."""
    mask = image > 0.5
    if mask.all() or not mask.any():
        return np.zeros(image.shape)
    return np.sqrt(_square_distance(mask)) - np.sqrt(_square_distance(~mask))


def subsample(step: int) -> Kernel:
    return lambda image: image[::step, ::step]


def richardson_lucy(psf: np.ndarray, iterations: int = 10) -> Kernel:
    """Deconvolution with a centred point spread function, on a wrapped frame."""
    psf = psf / psf.sum()

    def run(image: np.ndarray) -> np.ndarray:
        wide = np.zeros(image.shape)
        wide[: psf.shape[0], : psf.shape[1]] = psf
        otf = np.fft.rfft2(np.roll(wide, [-(s // 2) for s in psf.shape], (0, 1)))
        blur = lambda v, h: np.fft.irfft2(np.fft.rfft2(v) * h, s=image.shape)
        guess = np.full(image.shape, max(image.mean(), 1e-12))
        for _ in range(iterations):
            guess = guess * blur(image / np.maximum(blur(guess, otf), 1e-12), otf.conj())
        return guess

    return run


def registration_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(y, x) by which b is shifted against a: centroid of the top third of their cross correlation's peak."""
    c = np.fft.fftshift(np.fft.ifft2(np.fft.fft2(b) * np.fft.fft2(a).conj()).real)
    c = c - c.min()
    top = np.maximum(c - c.max() * 2 / 3, 0)
    y, x = np.mgrid[: c.shape[0], : c.shape[1]]
    return float((top * y).sum() / top.sum() - c.shape[0] // 2), float((top * x).sum() / top.sum() - c.shape[1] // 2)


def fourier_ring_correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of two images' spectra on rings of whole frequencies."""
    fa, fb = np.fft.fft2(a), np.fft.fft2(b)
    y, x = (np.fft.fftfreq(n) * n for n in a.shape)
    ring = np.rint(np.hypot(y[:, None], x[None])).astype(int).ravel()
    part = lambda v: np.bincount(ring, v.real.ravel())[: min(a.shape) // 2]
    return part(fa * fb.conj()) / np.maximum(np.sqrt(part(np.abs(fa) ** 2) * part(np.abs(fb) ** 2)), 1e-300)
