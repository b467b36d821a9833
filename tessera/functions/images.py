"""Pixel functions on numpy arrays (height x width x channels): what the columns of ``arrays`` can't express.

Random steps draw from a generator seeded by seed, epoch and row, so results depend on neither partitions nor retries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

IMAGE = "struct<height:int,width:int,channels:int,data:binary>"


def decoded(row: dict | None) -> np.ndarray | None:
    return None if row is None or row["data"] is None else np.frombuffer(row["data"], np.uint8).reshape(int(row["height"]), int(row["width"]), int(row["channels"]))


def encoded(image: np.ndarray | None) -> dict | None:
    if image is None:
        return None
    image = image if image.ndim == 3 else image[:, :, None]
    return {"height": image.shape[0], "width": image.shape[1], "channels": image.shape[2], "data": np.ascontiguousarray(image, np.uint8).tobytes()}


def generator(seed: int, epoch: int, row) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.blake2b(f"{seed}-{epoch}-{row}".encode(), digest_size=8).digest(), "little"))


def padded(image: np.ndarray, size: int, value: int = 230) -> np.ndarray:
    """Constant padding at the lower and right edge."""
    out = np.full((max(size, image.shape[0]), max(size, image.shape[1]), image.shape[2]), value, np.uint8)
    out[: image.shape[0], : image.shape[1]] = image
    return out


def cropped(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The central part over the last two axes before the channels, whatever stands before them."""
    top, left = (image.shape[-3] - height) // 2, (image.shape[-2] - width) // 2
    return image[..., top : top + height, left : left + width, :]


def resized(image: np.ndarray, height: int, width: int, nearest: bool = False) -> np.ndarray:
    """Bilinear sampling at pixel centres; masks take the nearest pixel, so that class ids stay what they are."""
    h, w = image.shape[:2]
    y, x = (np.arange(height) + 0.5) * h / height - 0.5, (np.arange(width) + 0.5) * w / width - 0.5
    if nearest:
        return image[np.clip(np.rint(y), 0, h - 1).astype(int)][:, np.clip(np.rint(x), 0, w - 1).astype(int)]
    return sampled(image, np.clip(y, 0, h - 1)[:, None] + np.zeros(width), np.clip(x, 0, w - 1)[None, :] + np.zeros((height, 1)))


def sampled(image: np.ndarray, y: np.ndarray, x: np.ndarray, outside: int | None = None) -> np.ndarray:
    """Bilinear values at (y, x); places outside the image take the nearest edge or the given value."""
    h, w = image.shape[:2]
    away = (y < -0.5) | (y > h - 0.5) | (x < -0.5) | (x > w - 0.5)
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[..., None], (x - x0)[..., None]
    image = image.astype(float)
    out = (image[y0, x0] * (1 - fx) + image[y0, x1] * fx) * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy
    if outside is not None:
        out[away] = outside
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def longest_side(image: np.ndarray, size: int) -> np.ndarray:
    """Scaled so that the longer side is ``size``."""
    h, w = image.shape[:2]
    factor = size / max(h, w)
    return image if factor == 1 else resized(image, max(1, round(h * factor)), max(1, round(w * factor)))


def tissue_share(image: np.ndarray, white: int = 220) -> float:
    """Share of pixels that are darker than background in some channel."""
    return float((image.min(axis=2) < white).mean())


def sharpness(image: np.ndarray, normalised: bool = False, masked: bool = False, white: int = 220) -> float:
    """Variance of the Laplacian of the grey image; normalised by its mean, or over tissue only."""
    grey = image.astype(float).mean(axis=2)
    lap = np.zeros_like(grey)
    lap[1:-1, 1:-1] = grey[:-2, 1:-1] + grey[2:, 1:-1] + grey[1:-1, :-2] + grey[1:-1, 2:] - 4 * grey[1:-1, 1:-1]
    values = lap[image.min(axis=2) < white] if masked else lap
    if not values.size:
        return 0.0
    return float(values.var() / max(grey.mean(), 1e-9)) if normalised else float(values.var())


def preprocessed(image: np.ndarray | None, size: int, pad: int = 230, tissue: float | None = None, blur: float | None = None, mode: str | None = None, filters: tuple[Callable, ...] = (), transform: Callable | None = None) -> np.ndarray | None:
    """Padding, tissue test, blur test, filters, transform, in this order; the first test that fails drops the image."""
    if mode not in (None, "masked", "normalized"):
        raise ValueError(f"unknown blur mode {mode!r}")
    if image is None:
        return None
    image = padded(image, size, pad)
    if tissue is not None and tissue_share(image) < tissue:
        return None
    if blur is not None and sharpness(image, mode == "normalized", mode == "masked") < blur:
        return None
    for f in filters:
        image = f(image)
    return transform(image) if transform else image


def brightness_contrast(image: np.ndarray, brightness: float, contrast: float) -> np.ndarray:
    return np.clip(np.rint(image.astype(float) * (1 + contrast) + 255 * brightness), 0, 255).astype(np.uint8)


def sharpened(image: np.ndarray, alpha: float) -> np.ndarray:
    """A mix of the image and its 3 x 3 sharpened version."""
    p = np.pad(image.astype(float), ((1, 1), (1, 1), (0, 0)), mode="edge")
    around = sum(p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)
    strong = 9 * image - around
    return np.clip(np.rint((1 - alpha) * image + alpha * strong), 0, 255).astype(np.uint8)


def noisy(image: np.ndarray, rng: np.random.Generator, low: float = 10.0, high: float = 50.0) -> np.ndarray:
    """Gaussian noise of a variance between low and high."""
    return np.clip(np.rint(image + rng.normal(0, rng.uniform(low, high) ** 0.5, image.shape)), 0, 255).astype(np.uint8)


#: Optical densities of haematoxylin, eosin and a residual stain, by channel (red, green, blue).
STAINS = np.array([[0.65, 0.70, 0.29], [0.07, 0.99, 0.11], [0.27, 0.57, 0.78]])


def stain_shifted(image: np.ndarray, h: float, e: float, low: float = 0.05, high: float = 0.95) -> np.ndarray:
    """Scales the two stains' densities by 1 + h and 1 + e; almost empty and almost full images stay as they are."""
    if not low <= image.mean() / 255 <= high:
        return image
    basis = STAINS / np.linalg.norm(STAINS, axis=1, keepdims=True)
    density = -np.log(np.maximum(image.astype(float), 1) / 255)
    amounts = density.reshape(-1, 3) @ np.linalg.inv(basis)
    amounts *= np.array([1 + h, 1 + e, 1.0])
    return np.clip(np.rint(255 * np.exp(-(amounts @ basis))), 0, 255).astype(np.uint8).reshape(image.shape)


def hue_saturation(image: np.ndarray, hue: float, saturation: float) -> np.ndarray:
    """Shifts hue (of 180) and saturation (of 255); the value stays."""
    x = image.astype(float) / 255
    top, low = x.max(2), x.min(2)
    span = np.maximum(top - low, 1e-12)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    h = np.where(top == r, (g - b) / span % 6, np.where(top == g, (b - r) / span + 2, (r - g) / span + 4)) / 6
    s = np.where(top > 0, (top - low) / np.maximum(top, 1e-12), 0)
    h, s = (h + hue / 180) % 1, np.clip(s + saturation / 255, 0, 1)
    k = (np.array([5, 3, 1]) + h[..., None] * 6) % 6
    out = top[..., None] * (1 - s[..., None] * np.clip(np.minimum(k, 4 - k), 0, 1))
    return np.clip(np.rint(out * 255), 0, 255).astype(np.uint8)


def affine(image: np.ndarray, scale: float, dx: float, dy: float, degrees: float, shear: float, outside: int = 0) -> np.ndarray:
    """Scale, shear, rotate and shift about the centre, sampled backwards."""
    h, w = image.shape[:2]
    a, s = np.deg2rad(degrees), np.tan(np.deg2rad(shear))
    forward = scale * np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]) @ np.array([[1, s], [0, 1]])
    back = np.linalg.inv(forward)
    y, x = np.mgrid[0:h, 0:w].astype(float)
    u, v = x - (w - 1) / 2 - dx * w, y - (h - 1) / 2 - dy * h
    return sampled(image, back[1, 0] * u + back[1, 1] * v + (h - 1) / 2, back[0, 0] * u + back[0, 1] * v + (w - 1) / 2, outside)


def smoothed(field: np.ndarray, sigma: float) -> np.ndarray:
    """A separable Gaussian filter with edges held."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    for axis in (0, 1):
        padded_field = np.pad(field, [(reach, reach) if i == axis else (0, 0) for i in (0, 1)], mode="edge")
        field = np.apply_along_axis(lambda r: np.convolve(r, kernel, "valid"), axis, padded_field)
    return field


def elastic(image: np.ndarray, rng: np.random.Generator, alpha: float = 1.0, sigma: float = 50.0) -> np.ndarray:
    h, w = image.shape[:2]
    dy, dx = (alpha * smoothed(rng.uniform(-1, 1, (h, w)), min(sigma, max(h, w) / 4)) for _ in range(2))
    y, x = np.mgrid[0:h, 0:w].astype(float)
    return sampled(image, y + dy, x + dx)


def replaced_colour(image: np.ndarray, old: int = 0, new: int = 230) -> np.ndarray:
    out = image.copy()
    out[(image == old).all(axis=2)] = new
    return out


def augmented(image: np.ndarray, rng: np.random.Generator, size: int = 512, split: str = "train", augment: bool = True, stain: bool = True, background: int | None = 230) -> np.ndarray:
    """The augmentation chain: flips, quarter turns, transposition, light, sharpness, noise, stain, geometry (training only); then size and background."""
    if split not in ("train", "test", "val"):
        raise ValueError(f"unknown split {split!r}")
    if augment and split == "train":
        if rng.random() < 0.5:
            image = image[:, ::-1]
        if rng.random() < 0.5:
            image = image[::-1]
        if rng.random() < 0.5:
            image = np.rot90(image, int(rng.integers(0, 4)))
        if rng.random() < 0.5:
            image = image.transpose(1, 0, 2)
        if rng.random() < 0.3:
            image = brightness_contrast(image, rng.uniform(-0.2, 0.2), rng.uniform(-0.2, 0.2))
        if rng.random() < 0.3:
            image = sharpened(image, rng.uniform(0, 0.5))
        if rng.random() < 0.3:
            image = noisy(image, rng)
        if stain and image.shape[2] == 3 and rng.random() < 0.3:
            if rng.random() < 0.5:
                image = stain_shifted(image, rng.uniform(-0.1, 0.1), rng.uniform(-0.1, 0.1))
            else:
                image = hue_saturation(image, rng.uniform(-10, 10), rng.uniform(-10, 10))
        if rng.random() < 0.3:
            if rng.random() < 0.5:
                image = elastic(image, rng)
            else:
                image = affine(image, rng.uniform(0.9, 1.1), rng.uniform(-0.1, 0.1), rng.uniform(-0.1, 0.1), rng.uniform(-30, 30), rng.uniform(-9, 9))
    image = longest_side(np.ascontiguousarray(image), size)
    return image if background is None else replaced_colour(image, 0, background)


def map_images(df: DataFrame, fn: Callable[[np.ndarray | None, object], np.ndarray | None], image: str = "image", key: str = "id") -> DataFrame:
    """Applies fn(image, key) to an image column, batch by batch in Arrow; null stays null if fn says so."""
    at, by = df.columns.index(image), df.columns.index(key)
    kind = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keys = batch.column(by).to_pylist()
            out = [encoded(fn(decoded(row), k)) for row, k in zip(batch.column(at).to_pylist(), keys)]
            columns = list(batch.columns)
            columns[at] = pa.array(out, kind)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes))
