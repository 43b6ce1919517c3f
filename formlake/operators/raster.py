"""Image measures and pixel operations on Spark's image struct, as Arrow-batched functions over numpy arrays.

The image column is struct<origin,height,width,nChannels,mode,data> with rows of BGR (or grey) bytes, as Spark's image source reads it.
Borders are mirrored without the edge pixel; grey is 0.114 B + 0.587 G + 0.299 R.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
MEASURES = "struct<blur:double,noise:double,brightness:double,motion:double,straight:int,edges:double,rows:int>"


def pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)


def grey(img: np.ndarray) -> np.ndarray:
    if img.shape[2] == 1:
        return img[:, :, 0].astype(np.float64)
    return np.rint(img[:, :, 0] * 0.114 + img[:, :, 1] * 0.587 + img[:, :, 2] * 0.299)


def filtered(g: np.ndarray, kernel: list[list[float]]) -> np.ndarray:
    """Correlation with a small odd kernel, mirrored borders."""
    k = np.asarray(kernel, dtype=np.float64)
    pad = np.pad(g, [(s // 2, s // 2) for s in k.shape], mode="reflect" if min(g.shape) > max(k.shape) // 2 else "edge")
    out = np.zeros(g.shape)
    for i in range(k.shape[0]):
        for j in range(k.shape[1]):
            out += k[i, j] * pad[i : i + g.shape[0], j : j + g.shape[1]]
    return out


LAPLACE = [[0, 1, 0], [1, -4, 1], [0, 1, 0]]
SMOOTH = [[1 / 16, 2 / 16, 1 / 16], [2 / 16, 4 / 16, 2 / 16], [1 / 16, 2 / 16, 1 / 16]]
SOBEL_X, SOBEL_Y = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]


def blur(g: np.ndarray) -> float:
    """Variance of the Laplacian; low for blurred images."""
    return float(filtered(g, LAPLACE).var())


def noise(g: np.ndarray) -> float:
    return float((g - filtered(g, SMOOTH)).std())


def motion(g: np.ndarray) -> float:
    """Share of the stronger of both mean gradients; 0 for a flat image."""
    x, y = np.abs(filtered(g, SOBEL_X)).mean(), np.abs(filtered(g, SOBEL_Y)).mean()
    return float(max(x, y) / (x + y)) if x + y else 0.0


def straight_lines(g: np.ndarray, least: float = 0.3) -> int:
    """Rows and columns of dark pixels in one run over `least` of the side."""
    dark = g < otsu(g)
    return int((longest_run(dark) >= least * g.shape[1]).sum() + (longest_run(dark.T) >= least * g.shape[0]).sum())


def longest_run(on: np.ndarray) -> np.ndarray:
    best = run = np.zeros(on.shape[0], dtype=np.int64)
    for col in on.T:
        run = np.where(col, run + 1, 0)
        best = np.maximum(best, run)
    return best


def otsu(g: np.ndarray) -> float:
    """The threshold that parts dark and light best."""
    count = np.bincount(g.astype(np.int64).ravel(), minlength=256).astype(np.float64)
    below, total = np.cumsum(count), np.cumsum(count * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = (total[-1] * below / below[-1] - total) ** 2 / (below * (below[-1] - below))
    return float(np.nan_to_num(gap).argmax()) + 1


def binarise(g: np.ndarray, method: str = "otsu", block: int = 31, offset: float = 10) -> np.ndarray:
    """Black and white by Otsu's, a fixed (127) or the local mean's threshold."""
    if method == "adaptive":
        half = block // 2
        pad = np.pad(g, half, mode="edge")
        table = np.pad(np.cumsum(np.cumsum(pad, axis=0), axis=1), ((1, 0), (1, 0)))
        mean = (table[block:, block:] - table[:-block, block:] - table[block:, :-block] + table[:-block, :-block]) / block**2
        return np.where(g > mean - offset, 255, 0).astype(np.uint8)
    return np.where(g >= (127 if method == "fixed" else otsu(g)), 255, 0).astype(np.uint8)


def scaled(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear to the given size."""
    h, w = img.shape[:2]
    y, x = (np.clip((np.arange(n) + 0.5) * s / n - 0.5, 0, s - 1) for n, s in ((height, h), (width, w)))
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    f = img.astype(np.float64)
    out = (f[y0][:, x0] * (1 - fx) + f[y0][:, x1] * fx) * (1 - fy) + (f[y1][:, x0] * (1 - fx) + f[y1][:, x1] * fx) * fy
    return np.rint(out).astype(np.uint8)


def rescale(img: np.ndarray, max_dim: int = 1600) -> np.ndarray:
    """Only makes smaller."""
    h, w = img.shape[:2]
    k = max_dim / max(h, w)
    return img if k >= 1 else scaled(img, max(1, int(w * k)), max(1, int(h * k)))


def normal_size(img: np.ndarray, max_dim: int = 1600, min_dim: int = 300) -> np.ndarray:
    h, w = img.shape[:2]
    if max(h, w) > max_dim:
        return rescale(img, max_dim)
    k = min_dim / min(h, w)
    return img if k <= 1 else scaled(img, int(w * k), int(h * k))


def trim(img: np.ndarray, border: int = 5) -> np.ndarray:
    cut = img[border:-border, border:-border] if border else img
    return cut if cut.size else img


def contrast(img: np.ndarray, factor: float = 1.2) -> np.ndarray:
    """Away from the mean grey."""
    mean = np.rint(grey(img).mean())
    return np.clip(np.rint(mean + (img - mean) * factor), 0, 255).astype(np.uint8)


def brightness(img: np.ndarray, factor: float = 1.1) -> np.ndarray:
    return np.clip(np.rint(img * factor), 0, 255).astype(np.uint8)


def sharpness(img: np.ndarray, factor: float = 1.2) -> np.ndarray:
    """Away from the smoothed image."""
    soft = np.stack([filtered(img[:, :, c].astype(np.float64), [[1 / 13] * 3, [1 / 13, 5 / 13, 1 / 13], [1 / 13] * 3]) for c in range(img.shape[2])], axis=2)
    return np.clip(np.rint(soft + (img - soft) * factor), 0, 255).astype(np.uint8)


def flatten_alpha(img: np.ndarray, background: int = 255) -> np.ndarray:
    """Four channels over a plain background."""
    if img.shape[2] != 4:
        return img
    a = img[:, :, 3:].astype(np.float64) / 255
    return np.rint(img[:, :, :3] * a + background * (1 - a)).astype(np.uint8)


def dilate(on: np.ndarray, height: int = 2, width: int = 2) -> np.ndarray:
    """Maximum over a window."""
    pad = np.pad(on, ((height // 2, height - 1 - height // 2), (width // 2, width - 1 - width // 2)), mode="edge")
    return np.lib.stride_tricks.sliding_window_view(pad, (height, width)).max(axis=(2, 3))


def erode(on: np.ndarray, height: int = 2, width: int = 2) -> np.ndarray:
    return 255 - dilate(255 - on, height, width)


def text_lines(img: np.ndarray, least: int = 12, threshold: float = 50) -> list[tuple[int, int]]:
    """(y1, y2) of text lines; a line that touches the bottom edge isn't reported."""
    ink = 255 - binarise(grey(img), "adaptive", 31, 15)
    rows = dilate(ink, 3, min(50, ink.shape[1])).sum(axis=1, dtype=np.int64)
    out, start = [], None
    for y, v in enumerate(rows.tolist()):
        if start is None and v > threshold:
            start = y
        elif start is not None and v < threshold:
            if y - start > least:
                out.append((start, y))
            start = None
    return out


def has_run(on: np.ndarray, length: int) -> np.ndarray:
    """Whether each row holds so many dark points side by side."""
    sums = np.cumsum(np.pad(on > 0, ((0, 0), (1, 0))), axis=1, dtype=np.int64)
    if on.shape[1] < length:
        return np.zeros(len(on), dtype=bool)
    return (sums[:, length:] - sums[:, :-length] == length).any(axis=1)


def gaps(g: np.ndarray) -> tuple[float, float, bool]:
    """Spread of the distances between rows with a run of 40 dark points, and between columns with one of 5; whether there are such rows."""
    ink = 255 - binarise(g)
    out = []
    for on, length in ((ink, 40), (ink.T, 5)):
        at = np.flatnonzero(has_run(on, length))
        out.append((float(np.diff(at).std()) if len(at) > 1 else 0.0, len(at) > 0))
    return out[0][0], out[1][0], out[0][1]


def _runs(image: pd.DataFrame) -> pd.Series:
    out = []
    for h, w, c, data in zip(image["height"], image["width"], image["nChannels"], image["data"], strict=True):
        on, found = binarise(grey(pixels(h, w, c, data))) == 0, []
        for turned in (False, True):
            edge = np.diff(np.pad((on.T if turned else on).astype(np.int8), ((0, 0), (1, 1))), axis=1)
            at, start, end = *np.nonzero(edge == 1), np.nonzero(edge == -1)[1]
            sides = (at, start, at + 1, end) if turned else (start, at, end, at + 1)
            found += [{"x1": x1, "y1": y1, "x2": x2, "y2": y2} for x1, y1, x2, y2 in np.stack(sides, axis=1).tolist()]
        out.append(found)
    return pd.Series(out)


def ink_runs(images: DataFrame) -> DataFrame:
    """(doc_id, x1, y1, x2, y2) of all runs of dark points across (height 1) and down (width 1) in images (doc_id, image), for `layout`."""
    run = F.pandas_udf(_runs, "array<struct<x1:long,y1:long,x2:long,y2:long>>")
    return images.select("doc_id", F.explode(run("image")).alias("r")).select("doc_id", "r.*")


def measure(image: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for h, w, c, data in zip(image["height"], image["width"], image["nChannels"], image["data"], strict=True):
        g = grey(pixels(h, w, c, data))
        edges = np.hypot(filtered(g, SOBEL_X), filtered(g, SOBEL_Y)) > 100
        rows.append((blur(g), noise(g), float(g.mean()), motion(g), straight_lines(g), float(edges.mean()), len(text_lines(pixels(h, w, c, data)))))
    return pd.DataFrame(rows, columns=["blur", "noise", "brightness", "motion", "straight", "edges", "rows"])


def measures(image: Column) -> Column:
    """blur, noise, brightness, motion, straight lines, share of edges and text rows of an image column."""
    return F.pandas_udf(measure, MEASURES)(image)


def quality(m: Column, mode: str = "rich") -> Column:
    """struct(label, score, is_blurry, is_noisy, is_dark, is_over_exposed, table_like) of measured columns.

    mode "route" has its own limits (noise over 30, over-exposed beyond 230) and the labels good and poor only."""
    noisy, bright, table = (30, 230, 11) if mode == "route" else (25, 210, 10)
    blurry, dark = m["blur"] < 80, m["brightness"] < 60
    over, noise_ = m["brightness"] > bright, m["noise"] > noisy
    score = F.when(blurry, 0.5).otherwise(1.0) * F.when(noise_, 0.8).otherwise(1.0) * F.when(dark | over, 0.7).otherwise(1.0)
    if mode == "route":
        label = F.when(blurry | noise_ | dark | over, "poor").otherwise("good")
    else:
        label = F.when(blurry & dark, "poor").when(blurry | noise_ | dark | over, "ok").otherwise("good")
    return F.struct(label.alias("label"), score.alias("score"), blurry.alias("is_blurry"), noise_.alias("is_noisy"), dark.alias("is_dark"), over.alias("is_over_exposed"), (m["straight"] >= table).alias("table_like"))


def issues(m: Column) -> Column:
    """What is wrong with an image, as array<string>: blur, noise, dark, over_exposed."""
    light = F.when(m["brightness"] < 60, "dark").when(m["brightness"] > 210, "over_exposed")
    return F.array_compact(F.array(F.when(m["blur"] < 80, "blur"), F.when(m["noise"] > 25, "noise"), light))


def suggest_retake(m: Column) -> Column:
    """Blurred and dark images should be taken again."""
    return (m["blur"] < 80) | (m["brightness"] < 60)


def gap_measure(image: pd.DataFrame) -> pd.DataFrame:
    rows = [gaps(grey(pixels(h, w, c, data))) for h, w, c, data in zip(image["height"], image["width"], image["nChannels"], image["data"], strict=True)]
    return pd.DataFrame(rows, columns=["line_gap", "char_gap", "has_lines"])


def gap_measures(image: Column) -> Column:
    """struct(line_gap, char_gap, has_lines) of an image column, for `route.text_kind`."""
    return F.pandas_udf(gap_measure, "struct<line_gap:double,char_gap:double,has_lines:boolean>")(image)


def pixel_operation(change: Callable[[np.ndarray], np.ndarray]):
    """A function of image columns from one on pixel arrays; several operations fused in `change` cost one pass."""

    @F.pandas_udf(IMAGE)
    def run(image: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for o, h, w, c, data in zip(image["origin"], image["height"], image["width"], image["nChannels"], image["data"], strict=True):
            out = change(pixels(h, w, c, data))
            out = out[:, :, None] if out.ndim == 2 else out
            rows.append((o, out.shape[0], out.shape[1], out.shape[2], 16 if out.shape[2] == 3 else 24 if out.shape[2] == 4 else 0, out.tobytes()))
        return pd.DataFrame(rows, columns=["origin", "height", "width", "nChannels", "mode", "data"])

    return run


def prepare(max_dim: int = 1600, binary: bool = False, border: int = 4) -> Callable[[np.ndarray], np.ndarray]:
    """The pipeline before recognition: flatten, sharpen, contrast, shrink, trim, and black and white if asked for."""

    def run(img: np.ndarray) -> np.ndarray:
        img = trim(rescale(contrast(sharpness(flatten_alpha(img), 1.1), 1.1), max_dim), border)
        return binarise(grey(img), "adaptive") if binary else img

    return run
