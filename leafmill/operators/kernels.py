"""Page kernels: what needs a whole page at once, on numpy arrays.

Pages are rows: (page_id, height, width, pixels as an array, row by row). A kernel maps
rows to rows, so no page is shuffled, and many small pages pass in one Arrow batch. The size
of a page is limited (see catalogue.MAX_PIXELS). Pages that come as relations of pixels are
gathered by page first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

Kernel = Callable[[np.ndarray], np.ndarray]


#: Pixels that go out in one Arrow batch, or a page if it has more.
BATCH = 1 << 18


def pages_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, page) of a batch (page_id, height, width, pixels)."""
    heights, widths, pixels = (batch.column(i) for i in (1, 2, 3))
    flat, at = pixels.values.to_numpy(zero_copy_only=False), pixels.offsets.to_numpy()
    for i in range(batch.num_rows):
        yield i, flat[at[i] : at[i + 1]].astype(np.int64).reshape(heights[i].as_py(), widths[i].as_py())


def map_pages(pages: DataFrame, kernel: Kernel, value: str = "v", out: str = "v", kind: str = "int", where: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(page_id, y, x, out) of kernel(page), which may change the size; only pixels that where holds for, if given."""
    key = pages.schema["page_id"].dataType.simpleString()
    number = {"int": np.int32, "long": np.int64, "double": np.float64}[kind]

    def run(batches):
        for batch in batches:
            rows, found, size = [], [], 0

            def flush() -> pa.RecordBatch:
                ids = batch.column(0).take(pa.array(np.repeat(rows, [len(f[0]) for f in found])))
                return pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate([f[j] for f in found])) for j in range(3))], ["page_id", "y", "x", out])

            for i, page in pages_of(batch):
                made = np.asarray(kernel(page))
                y, x = np.nonzero(where(made)) if where else (a.ravel() for a in np.indices(made.shape))
                rows.append(i)
                found.append((y.astype(np.int32), x.astype(np.int32), made[y, x].astype(number)))
                size += len(y)
                if size >= BATCH:
                    yield flush()
                    rows, found, size = [], [], 0
            if rows:
                yield flush()

    return pages.select("page_id", "height", "width", value).mapInArrow(run, f"page_id {key}, y int, x int, {out} {kind}")


def map_values(pages: DataFrame, f: Callable[[np.ndarray], object], value: str, out: str, kind: str) -> DataFrame:
    """(page_id, out): one value a page."""
    key = pages.schema["page_id"].dataType.simpleString()
    own = T._parse_datatype_string(kind)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f(page) for _, page in pages_of(batch)], to_arrow_type(own))], ["page_id", out])

    return pages.select("page_id", "height", "width", value).mapInArrow(run, f"page_id {key}, {out} {kind}")


#: Code points that are blank on a page made of text.
BLANKS = np.array([0x20, *range(0x09, 0x0E)], np.uint32)


def text_tones(text: str) -> np.ndarray:
    """One pixel a character: 255 where it is blank, else its code point modulo 200."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(np.isin(codes, BLANKS), 255, codes % 200).astype(np.int64)


def map_texts(docs: DataFrame, f: Callable[[np.ndarray], dict[str, np.ndarray] | None], schema: str) -> DataFrame:
    """(page_id, schema) of f(tones) for each (page_id, text): columns of equal length, or None for no rows. Null texts have none."""
    key = docs.schema["page_id"].dataType.simpleString()
    names = [c.split()[0].strip("`") for c in schema.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            rows, made = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = f(text_tones(text)) if text else None
                if found is not None:
                    made.append(found)
                    rows += [i] * len(found[names[0]])
            if rows:
                columns = [pa.array(np.concatenate([m[n] for m in made]), kind) for n, kind in zip(names, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *columns], ["page_id", *names])

    return docs.select("page_id", "text").mapInArrow(run, f"page_id {key}, {schema}")


#: Characters of texts that a kernel takes at once.
CHARS = 1 << 20


def map_many_texts(docs: DataFrame, f: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """(page_id, schema) of (page_id, text): f(tones of several texts one after the other, their sizes) gives one value a text. Null and empty texts have none."""
    key = docs.schema["page_id"].dataType.simpleString()
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            texts, rows, size = [], [], 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    texts.append(text)
                    rows.append(i)
                    size += len(text)
                if texts and (size >= CHARS or i == batch.num_rows - 1):
                    found = f(text_tones("".join(texts)), np.array([len(t) for t in texts]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *(pa.array(found[n]) for n in names)], ["page_id", *names])
                    texts, rows, size = [], [], 0

    return docs.select("page_id", "text").mapInArrow(run, f"page_id {key}, {schema}")


def otsu_level(tones: np.ndarray) -> int:
    """Threshold between two classes of tones: the middle of the first and the last level whose variance between classes is greatest; 0 for one tone."""
    n = np.bincount(tones, minlength=256)
    own = np.flatnonzero(n)
    dark, total = np.cumsum(n)[own[:-1]], int(n.sum())
    dark_sum = np.cumsum(n * np.arange(256))[own[:-1]]
    if not len(dark):
        return 0
    light, light_sum = total - dark, int((n * np.arange(256)).sum()) - dark_sum
    apart = dark_sum / dark - light_sum / light
    variance = apart * apart * dark.astype(float) * light.astype(float)
    best = np.flatnonzero(variance == variance.max())
    # A level without pixels has the variance of the one before.
    return int(own[best[0]] + own[best[-1] + 1] - 1 + 2) // 2


def ink_projections(tones: np.ndarray, width: int = 64) -> dict[str, np.ndarray]:
    """Inked pixels of each row and column of a page filled row by row."""
    at = np.arange(len(tones))
    rows, columns = (np.bincount(i, tones < 255) for i in (at // width, at % width))
    return {"axis": np.repeat(["row", "column"], (len(rows), len(columns))), "i": np.concatenate((np.arange(len(rows)), np.arange(len(columns)))), "n": np.concatenate((rows, columns)).astype(np.int64)}


def content_box(tones: np.ndarray, width: int = 64) -> dict[str, np.ndarray] | None:
    """Threshold, bounding box and number of the pixels under it."""
    cut = otsu_level(tones)
    ink = np.flatnonzero(tones < cut)
    if not len(ink):
        return None
    x = ink % width
    found = {"threshold": cut, "left": x.min(), "top": ink[0] // width, "right": x.max(), "bottom": ink[-1] // width, "ink": len(ink)}
    return {name: np.array([v]) for name, v in found.items()}


def grid(part: pd.DataFrame, value: str) -> np.ndarray:
    out = np.zeros((part["y"].max() + 1, part["x"].max() + 1), np.int64)
    out[part["y"].to_numpy(), part["x"].to_numpy()] = part[value].to_numpy()
    return out


def per_page(pixels: DataFrame, kernel: Kernel, value: str = "v", out: str = "v", kind: str = "int") -> DataFrame:
    """(page_id, y, x, out) of kernel(page), which may change the size."""
    key = pixels.schema["page_id"].dataType.simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        made = kernel(grid(part, value))
        y, x = np.indices(made.shape)
        return pd.DataFrame({"page_id": part["page_id"].iloc[0], "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), out: made.ravel()})

    return pixels.select("page_id", "y", "x", value).groupBy("page_id").applyInPandas(run, f"page_id {key}, y int, x int, {out} {kind}")


def shifted(a: np.ndarray, dy: int, dx: int, fill: int) -> np.ndarray:
    """a moved by (dy, dx), with fill where nothing comes from."""
    out = np.full_like(a, fill)
    h, w = a.shape
    if abs(dy) < h and abs(dx) < w:
        out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = a[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return out


def neighbours(connectivity: int) -> list[tuple[int, int]]:
    near = [(-1, 0), (1, 0), (0, -1), (0, 1)]
    return near + [(-1, -1), (-1, 1), (1, -1), (1, 1)] if connectivity == 8 else near


def joined(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of `count` things the first one that links (a, b) lead to."""
    parent = np.arange(count)
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def components(black: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Labels 1, 2, ... of black components, by their first pixel in reading order; 0 elsewhere. Runs of rows are joined, not pixels."""
    h, w = black.shape
    wide, touch = w + 1, int(connectivity == 8)
    flat = np.zeros((h, wide), np.int8)
    flat[:, :w] = black > 0
    change = np.diff(np.concatenate(([0], flat.ravel())))
    start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    first = np.searchsorted(end, start + wide - touch, "right")
    number = np.maximum(np.searchsorted(start, end + wide + touch, "left") - first, 0)
    above = np.repeat(np.arange(len(start)), number)
    below = np.repeat(first, number) + np.arange(len(above)) - np.repeat(np.cumsum(number) - number, number)
    _, label = np.unique(joined(len(start), above, below), return_inverse=True)
    steps = np.zeros(h * wide, np.int64)
    steps[start] = label + 1
    steps[end] -= label + 1
    return np.cumsum(steps).reshape(h, wide)[:, :w]


def component_boxes(label: np.ndarray) -> np.ndarray:
    """(n, 4): left, top, right and bottom (the last two exclusive) of components 1 to n, in one pass."""
    n = int(label.max(initial=0))
    y, x = np.nonzero(label)
    of = label[y, x] - 1
    out = np.empty((n, 4), np.int64)
    for i, c in enumerate((x, y)):
        low, high = np.full(n, 1 << 40), np.full(n, -1)
        np.minimum.at(low, of, c)
        np.maximum.at(high, of, c)
        out[:, i], out[:, i + 2] = low, high + 1
    return out


def hit_miss_replace(black: np.ndarray, pattern: list[str], surroundings: int = 0) -> np.ndarray:
    """Black after all matches of a pattern have been replaced: X and - must be black, blank and + white, ? may be either; - turns white and + black.

    The pattern may reach over the page as long as its first replaced cell is on it.
    """
    cells = [(i, j, c) for i, row in enumerate(pattern) for j, c in enumerate(row) if c != "?"]
    first = next(((i, j) for i, j, c in cells if c in "-+"), None)
    if first is None:
        return black
    match = np.ones(black.shape, bool)
    for i, j, c in cells:
        match &= (shifted(black, first[0] - i, first[1] - j, surroundings) > 0) == (c in "X-")
    out = black > 0
    for sign in "+-":
        for i, j, c in cells:
            if c == sign:
                hit = shifted(match, i - first[0], j - first[1], False)
                out = out | hit if sign == "+" else out & ~hit
    return out.astype(np.int64)


def hit_miss_all_ways(black: np.ndarray, pattern: list[str]) -> np.ndarray:
    """The pattern as it is, turned clockwise, upside down and turned the other way, one after the other."""
    for turns in (0, -1, 2, 1):
        black = hit_miss_replace(black, ["".join(row) for row in np.rot90(np.array([list(row) for row in pattern]), turns)])
    return black


def gray_reconstruct(seed: np.ndarray, mask: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Seed spread as darkness under a mask: the neighbours' minimum, never darker than the mask, until it rests.

    Sweeps go down, up, right and left, each as far as it leads; what then can still spread does so pixel by pixel, from those that moved last.
    """
    h, w = mask.shape
    wide = np.full((h + 2, w + 2), 256, np.int16)
    wide[1:-1, 1:-1] = np.maximum(seed, mask)
    floor = np.full((h + 2, w + 2), 256, np.int16)
    floor[1:-1, 1:-1] = mask
    for _ in range(2):
        for turned in (False, True):
            a, m = (np.ascontiguousarray(x.T) if turned else x for x in (wide, floor))
            n = len(a)
            for step in (1, -1):
                for i in range(2, n) if step == 1 else range(n - 3, -1, -1):
                    near = a[i - step]
                    low = np.minimum(a[i], near)
                    if connectivity == 8:
                        np.minimum(low[1:], near[:-1], out=low[1:])
                        np.minimum(low[:-1], near[1:], out=low[:-1])
                    np.maximum(low, m[i], out=a[i])
            wide = np.ascontiguousarray(a.T) if turned else a
    now, floor, steps = wide.ravel(), floor.ravel(), [dy * (w + 2) + dx for dy, dx in neighbours(connectivity)]
    inner = np.arange((h + 2) * (w + 2)).reshape(h + 2, w + 2)[1:-1, 1:-1].ravel()
    edge = inner[np.any([np.maximum(now[inner], floor[inner + s]) < now[inner + s] for s in steps], axis=0)]
    while len(edge):
        moved = []
        for s in steps:
            to = edge + s
            low = np.maximum(now[edge], floor[to])
            better = low < now[to]
            now[to[better]] = low[better]
            moved.append(to[better])
        edge = np.unique(np.concatenate(moved))
    return now.reshape(h + 2, w + 2)[1:-1, 1:-1].astype(np.int64)


def blur(a: np.ndarray, sigma_x: float, sigma_y: float) -> np.ndarray:
    """Gaussian blur, to five sigmas; the edges' pixels repeat."""
    out = a.astype(float)
    for axis, sigma in ((1, sigma_x), (0, sigma_y)):
        if sigma > 0:
            r = max(1, int(5 * sigma + 0.5))
            weights = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
            padded = np.pad(out, [(r, r) if i == axis else (0, 0) for i in (0, 1)], mode="edge")
            n = out.shape[axis]
            out = sum(w * padded.take(range(i, i + n), axis) for i, w in enumerate(weights / weights.sum()))
    return out


def sharpen(a: np.ndarray, radius: int, coef: float) -> np.ndarray:
    return np.clip(np.rint(a + coef * (a - blur(a, radius, radius))), 0, 255).astype(np.int64)


def polynomial_kernel(width: int, height: int, degree_x: int, degree_y: int) -> np.ndarray:
    """Weights of a window that give the value in its middle of the least-squares polynomial."""
    y, x = np.mgrid[0:height, 0:width]
    y, x = (y - height // 2).ravel(), (x - width // 2).ravel()
    terms = np.stack([x**i * y**j for i in range(degree_x + 1) for j in range(degree_y + 1)], axis=1).astype(float)
    return np.linalg.pinv(terms)[0].reshape(height, width)


def polynomial_smooth(a: np.ndarray, width: int = 5, height: int = 5, degree_x: int = 2, degree_y: int = 2) -> np.ndarray:
    k = polynomial_kernel(width, height, degree_x, degree_y)
    padded = np.pad(a.astype(float), ((height // 2, height - 1 - height // 2), (width // 2, width - 1 - width // 2)), mode="edge")
    out = sum(k[i, j] * padded[i : i + a.shape[0], j : j + a.shape[1]] for i in range(height) for j in range(width))
    return np.clip(np.rint(out), 0, 255).astype(np.int64)


def box_median(a: np.ndarray, radius: int, at_once: int = 1 << 23) -> np.ndarray:
    """Median of the box around each pixel within the page, strip by strip, so that boxes of a few rows are held at once."""
    size = 2 * radius + 1
    padded = np.pad(a.astype(float), radius, constant_values=np.nan)
    boxes = np.lib.stride_tricks.sliding_window_view(padded, (size, size))
    rows = max(1, at_once // (a.shape[1] * size * size))
    return np.concatenate([np.nanmedian(boxes[y : y + rows].reshape(-1, a.shape[1], size * size), axis=2) for y in range(0, a.shape[0], rows)])


def subtract_background(a: np.ndarray, radius: int, coef: float) -> np.ndarray:
    """Paper made even: what a median of the surroundings is darker than white is given back in part."""
    return np.clip(np.rint(a + coef * (255 - box_median(a, radius))), 0, 255).astype(np.int64)


def ring_means(a: np.ndarray, radius: int) -> np.ndarray:
    """Mean of the square of that radius around each pixel, as far as it is on the page."""
    h, w = a.shape
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = a.cumsum(axis=0).cumsum(axis=1)
    y, x = np.arange(h), np.arange(w)
    top, bottom, left, right = np.maximum(y - radius, 0), np.minimum(y + radius + 1, h), np.maximum(x - radius, 0), np.minimum(x + radius + 1, w)
    sums = total[bottom][:, right] - total[top][:, right] - total[bottom][:, left] + total[top][:, left]
    return sums / ((bottom - top)[:, None] * (right - left))


#: Fixed values of the denoiser: least weight of a ring that counts as alike, the share of alike surroundings from which the average leads, and how far it leads.
ALIKE, ENOUGH, LEAD = 0.02, 0.66, 0.16


def denoise(a: np.ndarray, radius: int, coef: float) -> np.ndarray:
    """Pixels drawn to the means of the squares around them, the more the nearer those are in place and tone."""
    area = (2 * radius + 1) ** 2
    alike, weights, colour = np.full(a.shape, 1 / area), np.ones(a.shape), a.astype(float)
    for r in range(1, radius + 1):
        mean = ring_means(a, r)
        near = np.exp(-(r * r / area + ((a - mean) / 255 * r / coef) ** 2))
        colour, weights = colour + mean * near * 8 * r, weights + near * 8 * r
        alike += np.where(near > ALIKE, 8 * r / area, 0)
    colour /= weights
    return np.clip(np.floor(colour + (a - colour) * np.where(alike > ENOUGH, LEAD, 1 - LEAD) + 0.5), 0, 255).astype(np.int64)


def resample(a: np.ndarray, matrix: np.ndarray, height: int, width: int, outside: int = 255) -> np.ndarray:
    """Affine resampling: each target pixel reads the source at matrix (2 by 3), bilinearly."""
    y, x = np.mgrid[0:height, 0:width] + 0.5
    sx, sy = matrix[0, 0] * x + matrix[0, 1] * y + matrix[0, 2] - 0.5, matrix[1, 0] * x + matrix[1, 1] * y + matrix[1, 2] - 0.5
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = sx - x0, sy - y0

    def read(yy: np.ndarray, xx: np.ndarray) -> np.ndarray:
        inside = (yy >= 0) & (yy < a.shape[0]) & (xx >= 0) & (xx < a.shape[1])
        return np.where(inside, a[np.clip(yy, 0, a.shape[0] - 1), np.clip(xx, 0, a.shape[1] - 1)], outside)

    out = (read(y0, x0) * (1 - fx) + read(y0, x0 + 1) * fx) * (1 - fy) + (read(y0 + 1, x0) * (1 - fx) + read(y0 + 1, x0 + 1) * fx) * fy
    return np.clip(np.rint(out), 0, 255).astype(np.int64)


def two_tones(a: np.ndarray, delta: int = 0, low: int = 0, high: int = 255) -> int:
    """Threshold between the means of the darker and the lighter pixels, in steps of 1/256 tone until it rests; delta leans it."""
    h = np.bincount(np.clip(a, low, high).ravel(), minlength=256).astype(object)  # whole numbers of any size
    tones = np.flatnonzero(h)
    lean = min(512, max(0, 256 + 2 * delta))
    darkest, lightest = int(tones[0]) << 7, (int(tones[-1]) + 1) << 7
    now = (lean * lightest + (512 - lean) * darkest) >> 8
    for _ in range(256):
        dark = sum(int(h[t]) for t in tones if t << 8 < now)
        light = int(a.size) - dark
        below = (sum(int(h[t]) * int(t) for t in tones if t << 8 < now) << 7) // dark if dark else darkest
        above = (sum(int(h[t]) * int(t) for t in tones if t << 8 >= now) << 7) // light if light else lightest
        now, last = (lean * above + (512 - lean) * below + 127) >> 8, now
        if now == last:
            break
    return (now + 127) >> 8


def robust(a: np.ndarray, radius: int, coef: float) -> np.ndarray:
    """Pixels that stand out from their blurred surroundings drawn apart from these; white where the surroundings are under half of them."""
    mean = np.floor(blur(a, radius, radius) + 0.5)
    apart = mean - a
    pole = mean + apart <= 0
    drawn = 255 - (mean + 255) * apart / np.where(pole, 1, mean + apart)
    return np.where(pole, 255, np.floor(np.clip(coef * drawn + (1 - coef) * a + 0.5, 0, 255))).astype(np.int64)


def niblack(a: np.ndarray, radius: int, k: float) -> np.ndarray:
    """Local mean less k deviations, as a tone."""
    mean = ring_means(a, radius)
    sd = np.sqrt(np.abs(ring_means(a.astype(float) ** 2, radius) - mean * mean))
    return np.floor(np.clip(mean - k * sd, 0, 255)).astype(np.int64)


def smoothed(a: np.ndarray, radius: int, noise: float) -> np.ndarray:
    """Wiener filter against noise of that deviation, about the blurred page."""
    mean = np.floor(blur(a, radius, radius) + 0.5)
    local = ring_means(a, radius)
    sd = np.floor(np.clip(np.sqrt(np.abs(ring_means(a.astype(float) ** 2, radius) - local * local)) + 0.5, 0, 255))
    share = np.maximum(sd * sd - noise * noise, 0) / np.maximum(sd * sd, 1)
    return np.clip(np.floor(mean + (a - mean) * share + 0.5), 0, 255).astype(np.int64)


def gatos(a: np.ndarray, radius: int, k: float, delta: int = 0, noise: float = 3.0, q: float = 0.6, p: float = 0.2) -> np.ndarray:
    """Black by distance from the paper: paper under ink is the mean of paper pixels in the least window that has any."""
    calm = smoothed(a, 5, noise)
    ink = calm < niblack(calm, radius, k)
    h, w = a.shape
    paper, left = calm.copy(), ink.copy()
    size = 2 * radius + 1
    for window in range(size, 2 * max(h, w) + 2 * size, size):
        if not left.any():
            break
        # A window of that size about a pixel: its begin is half of it before.
        y, x = np.arange(h), np.arange(w)
        top, left_edge = np.maximum(y - (window - 1) // 2, 0), np.maximum(x - (window - 1) // 2, 0)
        bottom, right = np.minimum(y - (window - 1) // 2 + window, h), np.minimum(x - (window - 1) // 2 + window, w)
        sums = []
        for of in (np.where(ink, 0, 1), np.where(ink, 0, calm)):
            t = np.zeros((h + 1, w + 1), np.int64)
            t[1:, 1:] = of.cumsum(axis=0).cumsum(axis=1)
            sums.append(t[bottom][:, right] - t[top][:, right] - t[bottom][:, left_edge] + t[top][:, left_edge])
        hit = left & (sums[0] > 0)
        paper[hit] = (sums[1][hit] + sums[0][hit] // 2) // sums[0][hit]
        left &= ~hit
    darker = calm < paper
    if not darker.any() or darker.all():
        return (calm < paper).astype(np.int64)
    contrast, ground = (paper - calm)[darker].mean(), paper[~darker].mean()
    scale = (q - (1 - q) * delta * 0.02) * contrast
    bend = 1 / (1 + np.exp(-8 * (paper + 1) / (ground + 1) + 6))
    cut = np.clip(paper - np.trunc(scale * (p * bend + 1 - p) + 0.5), 0, 255)
    return (calm < cut).astype(np.int64)


def multi_scale(a: np.ndarray, radius: int, coef: float) -> np.ndarray:
    """Threshold map from the middles between the darkest and lightest pixel of overlapping blocks, large ones first, each level halving them down to the radius."""
    h, w = a.shape
    levels, block = 0, 1
    while block < (h + w) // 2:
        levels, block = levels + 1, 2 * block
    block //= 2
    small = 1
    while small < radius and levels > 1:
        levels, small = levels - 1, 2 * small
    now = np.full(a.shape, int((int(a.min()) + int(a.max())) * 0.5 + 0.5))
    old = -coef / (1 - coef) if coef < 0 else 1 / (1 + coef)  # what is kept of the level before
    new = 1 - old
    for _ in range(levels):
        reach = int(1.5 * block)
        for y in range(0, h, block):
            for x in range(0, w, block):
                box = (slice(y, min(y + reach, h)), slice(x, min(x + reach, w)))
                middle = (int(a[box].min()) + int(a[box].max())) * 0.5 * new
                now[box] = np.floor(np.clip(now[box] * old + middle + 0.5, 0, 255))
        block //= 2
    return now


def despeckle(black: np.ndarray, min_area: int, big_area: int, reach: float) -> np.ndarray:
    """Black without small components that stand apart from larger ones.

    Big components stay; those under min_area go; one in between stays if a kept one is
    within reach times the root of its area, and then keeps others in turn. Each round
    takes one map of distances to what was kept last.
    """
    label = components(black)
    n = int(label.max(initial=0))
    if not n:
        return black
    area = np.bincount(label.ravel(), minlength=n + 1)
    area[0] = 0
    kept, undecided = area >= big_area, (area >= min_area) & (area < big_area)
    fresh = kept.copy()
    while fresh.any() and undecided.any():
        squared, _ = nearest(np.where(fresh[label], label, 0))
        gap = np.full(n + 1, np.inf)
        np.minimum.at(gap, label.ravel(), squared.ravel())
        fresh = undecided & (gap <= reach * reach * area)
        undecided &= ~fresh
        kept |= fresh
    return np.where(kept[label], black, 0)


def nearest(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, label) of the labelled pixel nearest to each pixel; the smaller label of two as near; inf and 0 without any.

    Down and up the columns first, then along the rows, step by step as far as any pixel
    could still find a nearer one.
    """
    h, w = label.shape
    rows = np.arange(h)[:, None]
    above = np.maximum.accumulate(np.where(label > 0, rows, -1), axis=0)
    below = np.minimum.accumulate(np.where(label > 0, rows, h)[::-1], axis=0)[::-1]
    column = np.arange(w)[None, :]
    far = np.int64(1) << 40
    up, down = np.where(above >= 0, rows - above, far >> 16), np.where(below < h, below - rows, far >> 16)
    label_up, label_down = label[np.maximum(above, 0), column], label[np.minimum(below, h - 1), column]
    size = int(label.max(initial=0)) + 1
    key = np.minimum(np.where(above >= 0, up * up * size + label_up, far * size), np.where(below < h, down * down * size + label_down, far * size))
    best = key.copy()
    for dx in range(1, w):
        if (best // size).max() < dx * dx:
            break
        best[:, dx:] = np.minimum(best[:, dx:], key[:, :-dx] + dx * dx * size)
        best[:, :-dx] = np.minimum(best[:, :-dx], key[:, dx:] + dx * dx * size)
    none = best // size >= far
    return np.where(none, np.inf, best // size), np.where(none, 0, best % size)


def nearest_label(label: np.ndarray) -> np.ndarray:
    """For each pixel the label of the nearest labelled one; the smaller label of two as near."""
    return nearest(label)[1]


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull, counter-clockwise from the leftmost lowest."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) <= 2:
        return np.array(pts)

    def half(row: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for p in row:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """3 by 3 matrix that takes four points to four points."""
    rows, rhs = [], []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        rhs += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(rhs, float)), 1).reshape(3, 3)


def skew_angle(black: np.ndarray, limit: float = 7.0) -> float:
    """Angle whose vertical shear makes row counts differ most; whole degrees first, then bisection to a tenth."""
    y, x = np.nonzero(black)
    if not len(y):
        return 0.0
    middle = black.shape[1] / 2

    def score(angle: float) -> float:
        rows = np.rint(y - np.tan(np.radians(angle)) * (x - middle)).astype(int)
        counts = np.bincount(rows - rows.min())
        return float((np.diff(counts.astype(float)) ** 2).sum())

    angles = np.arange(-limit, limit + 1)
    scores = [score(a) for a in angles]
    best, top = float(angles[int(np.argmax(scores))]), max(scores)
    step = 0.5
    while step > 0.05:
        for a in (best - step, best + step):
            if abs(a) <= limit and (s := score(a)) > top:
                best, top = a, s
                break
        step /= 2
    return 0.0 if abs(best) < 0.1 else best


def hough_peaks(black: np.ndarray, angles: int = 36, top: int = 3) -> list[tuple[int, int, int]]:
    """(angle bin, distance, votes) of the best lines, each a maximum among its neighbours."""
    y, x = np.nonzero(black)
    theta = np.pi * np.arange(angles) / angles
    size = int(np.hypot(*black.shape)) + 1
    votes = np.zeros((angles, 2 * size + 1), int)
    for i, t in enumerate(theta):
        np.add.at(votes[i], np.rint(x * np.cos(t) + y * np.sin(t)).astype(int) + size, 1)
    best = np.ones_like(votes, bool)
    for dy in range(-2, 3):
        for dx in range(-2, 3):
            best &= votes >= shifted(votes, dy, dx, -1)
    found = sorted(((int(votes[i, j]), int(i), int(j) - size) for i, j in np.argwhere(best & (votes > 0))), key=lambda f: (-f[0], f[1], f[2]))
    return [(i, d, n) for n, i, d in found[:top]]


def colour_means(colours: np.ndarray, counts: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """k mean colours; the first is the commonest, each next the farthest from those before, weighted by count."""
    means = [colours[int(np.argmax(counts))].astype(float)]
    while len(means) < min(k, len(colours)):
        d = np.min([((colours - m) ** 2).sum(axis=1) for m in means], axis=0) * counts
        means.append(colours[int(np.argmax(d))].astype(float))
    means = np.array(means)
    for _ in range(rounds):
        own = np.argmin(((colours[:, None, :] - means[None]) ** 2).sum(axis=2), axis=1)
        nxt = np.array([np.average(colours[own == i], axis=0, weights=counts[own == i]) if (own == i).any() else means[i] for i in range(len(means))])
        if np.allclose(nxt, means):
            break
        means = nxt
    return means


def fit_surface(a: np.ndarray, degree_x: int, degree_y: int, mask: np.ndarray | None = None) -> np.ndarray:
    """Least-squares polynomial surface of a page, over masked pixels only if a mask is given."""
    y, x = np.indices(a.shape)
    y, x = y / max(1, a.shape[0] - 1), x / max(1, a.shape[1] - 1)
    terms = np.stack([x**i * y**j for i in range(degree_x + 1) for j in range(degree_y + 1)], axis=-1)
    on = np.ones(a.shape, bool) if mask is None else mask > 0
    w, *_ = np.linalg.lstsq(terms[on], a[on].astype(float), rcond=None)
    return terms @ w
