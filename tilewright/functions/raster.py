"""Contour and pixel kernels in numpy, for use inside Arrow-batched functions. All work on one film or tile at a time."""

from __future__ import annotations

import numpy as np


def fill_polygon(points: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mask of a polygon with whole-pixel vertices, boundary pixels included (a 20 x 20 square covers 21 x 21 pixels)."""
    mask = np.zeros((height, width), bool)
    p = np.asarray(points, float)
    if not len(p):
        return mask
    q = np.concatenate([p[1:], p[:1]])
    (left, low), (right, high) = p.min(0), p.max(0)
    low, high = max(0, int(np.ceil(low))), min(height - 1, int(np.floor(high)))
    left, right = max(0, int(np.ceil(left))), min(width, int(np.floor(right)) + 1)
    step = max(1, 2**18 // max(len(p), right - left + 1))  # lines at once
    for y0 in range(low, high + 1 if right > left else low, step):
        y = np.arange(y0, min(y0 + step, high + 1))[:, None]
        crossing = (p[:, 1] <= y) != (q[:, 1] <= y)
        line, edge = np.nonzero(crossing)
        if not len(line):
            continue
        a, b = p[edge], q[edge]
        xs = a[:, 0] + (y[line, 0] - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
        order = np.lexsort((xs, line))  # a closed line crosses an even number of times
        line, xs = line[order], xs[order]
        start = np.clip(np.ceil(xs[::2]), left, right).astype(int) - left
        end = np.maximum(np.clip(np.floor(xs[1::2]) + 1, left, right).astype(int) - left, start)
        change = np.zeros((len(y), right - left + 1), np.int32)
        np.add.at(change, (line[::2], start), 1)
        np.add.at(change, (line[::2], end), -1)
        mask[y0 : y0 + len(y), left:right] = np.cumsum(change[:, :-1], 1) > 0
    for (x0, y0), (x1, y1) in zip(p.tolist(), q.tolist()):  # the boundary itself
        if (x0 == x1 or y0 == y1) and x0.is_integer() and y0.is_integer() and x1.is_integer() and y1.is_integer():
            (xa, xb), (ya, yb) = sorted((int(x0), int(x1))), sorted((int(y0), int(y1)))
            mask[max(0, ya) : max(0, yb + 1), max(0, xa) : max(0, xb + 1)] = True
            continue
        n = int(max(abs(x1 - x0), abs(y1 - y0), 1))
        x, y = np.rint(np.linspace(x0, x1, n + 1)).astype(int), np.rint(np.linspace(y0, y1, n + 1)).astype(int)
        ok = (x >= 0) & (x < width) & (y >= 0) & (y < height)
        mask[y[ok], x[ok]] = True
    return mask


def visible_mask(points: np.ndarray, x: int, y: int, side: int) -> np.ndarray | None:
    """The polygon's pixels inside a window; None if its box misses the window or no pixel is left."""
    p = np.asarray(points, float)
    if not len(p):
        return None
    (x0, y0), (x1, y1) = p.min(0), p.max(0)
    if x1 < x or x0 > x + side or y1 < y or y0 > y + side:
        return None
    if len(p) < 3:
        mask = np.zeros((side, side), bool)
        a, b = np.floor(np.maximum([x0 - x, y0 - y], 0)).astype(int), np.ceil(np.minimum([x1 - x, y1 - y], side)).astype(int)
        mask[a[1] : b[1], a[0] : b[0]] = True
    else:
        mask = fill_polygon(np.rint(p - [x, y]), side, side)
    return mask if mask.any() else None


def area(points: np.ndarray) -> float:
    p = np.asarray(points, float)
    if len(p) < 3:
        return float(np.prod(p.max(0) - p.min(0))) if len(p) else 0.0
    q = np.concatenate([p[1:], p[:1]])
    return abs(float(np.sum(p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]))) / 2


def mask_box(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    """(x0, y0, x1, y1), upper ends exclusive; None if empty."""
    ys, xs = np.nonzero(mask)
    return (int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1) if len(xs) else None


def kept_box(points: np.ndarray, x: int, y: int, side: int, min_side: float = 4, visible: float = 0.10, tile: float = 0.005) -> tuple | None:
    """(box, visible share) of a polygon in a window if the keep rule accepts it, else None."""
    mask = visible_mask(points, x, y, side)
    if mask is None:
        return None
    box = mask_box(mask)
    w, h = box[2] - box[0], box[3] - box[1]
    share = float(mask.sum()) / max(area(points), 1.0)
    if w >= min_side and h >= min_side and (share >= visible or w * h >= tile * side * side):
        return box, min(1.0, share)
    return None


def components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """8-connected components: labels from 1 on, and how many. Runs of each row are joined by union-find."""
    parent: list[int] = [0]

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    labels = np.zeros(mask.shape, np.int64)
    steps = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    ys, starts = np.nonzero(steps == 1)
    ends = np.nonzero(steps == -1)[1]
    above: list[tuple[int, int, int]] = []
    runs: list[tuple[int, int, int]] = []
    at = -1
    for y, a, b in zip(ys.tolist(), starts.tolist(), ends.tolist()):
        if y != at:
            above, runs, at = runs if y == at + 1 else [], [], y
        own = 0
        for c, d, k in above:
            if c <= b and d >= a:  # touching, diagonals too
                k = find(k)
                if own and own != k:
                    parent[max(own, k)] = min(own, k)
                own = min(own, k) if own else k
        if not own:
            own = len(parent)
            parent.append(own)
        labels[y, a:b] = own
        runs.append((a, b, own))
    roots = np.array([find(i) for i in range(len(parent))])
    kept = np.unique(roots[1:]) if len(parent) > 1 else np.empty(0, int)
    number = np.zeros(len(parent), np.int64)
    number[kept] = np.arange(1, len(kept) + 1)
    return number[roots[labels]], len(kept)


_AROUND = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]  # (dx, dy), clockwise from north


def trace(mask: np.ndarray) -> list[np.ndarray]:
    """External contours as pixel loops, the largest area first; contours of one or two pixels are padded to three points."""
    box = mask_box(mask)
    if box is None:
        return []
    left, top, right, bottom = box
    labels, n = components(mask[top:bottom, left:right])
    flat = labels.ravel()
    places = np.flatnonzero(flat)
    places = places[np.argsort(flat[places], kind="stable")]
    out = []
    for own in np.split(places, np.cumsum(np.bincount(flat, minlength=n + 1)[1:])[:-1]):
        ys, xs = np.divmod(own, right - left)
        y0, x0 = int(ys[0]), int(xs.min())
        width = int(xs.max()) - x0 + 3  # the component in a box with a border of a pixel
        inside = np.zeros((int(ys[-1]) - y0 + 3) * width, bool)
        inside[(ys - y0 + 1) * width + xs - x0 + 1] = True
        inside, around = inside.tobytes(), [dy * width + dx for dx, dy in _AROUND]
        start = width + int(xs[0]) - x0 + 1
        loop, at, came = [start], start, 6
        while True:
            for turn in range(1, 9):
                d = (came + turn) % 8
                nxt = at + around[d]
                if inside[nxt]:
                    break
            else:
                break
            if at == start and len(loop) > 1 and nxt == loop[1]:
                loop.pop()
                break
            loop.append(nxt)
            at, came = nxt, (d + 4) % 8
        y, x = np.divmod(np.array(loop), width)
        p = np.stack([x + (left + x0 - 1), y + (top + y0 - 1)], 1).astype(float)
        while len(p) < 3:
            p = np.concatenate([p, p[-1:]])
        out.append(p)
    return sorted(out, key=lambda p: -area(p))


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One polygon of two by a bridge between their nearest vertices: len(a) + len(b) + 2 points."""
    d = ((a[:, None] - b[None]) ** 2).sum(2)
    i, j = np.unravel_index(int(d.argmin()), d.shape)
    return np.concatenate([a[: i + 1], b[j:], b[: j + 1], a[i:]])


def simplify(points: np.ndarray, eps: float) -> np.ndarray:
    """Douglas-Peucker on a closed polygon; the input if eps <= 0 or fewer than three points would stay."""
    p = np.asarray(points, float)
    if eps <= 0 or len(p) < 4:
        return p
    far = int(((p - p[0]) ** 2).sum(1).argmax())
    keep = {0, far}

    def split(ids):
        stack = [(0, len(ids) - 1)]
        while stack:
            a, b = stack.pop()
            if b - a < 2:
                continue
            s, e = p[ids[a]], p[ids[b]]
            inner = p[ids[a + 1 : b]] - s
            base = e - s
            length = np.hypot(*base)
            away = np.hypot(inner[:, 0], inner[:, 1]) if length == 0 else np.abs(base[0] * inner[:, 1] - base[1] * inner[:, 0]) / length
            k = int(away.argmax())
            if away[k] > eps:
                keep.add(int(ids[a + 1 + k]))
                stack += [(a, a + 1 + k), (a + 1 + k, b)]

    split(np.arange(far + 1))
    split(np.concatenate([np.arange(far, len(p)), [0]]))
    out = p[sorted(keep)]
    return out if len(out) >= 3 else p


def class_raster(shapes: list[tuple[np.ndarray, int]], height: int, width: int) -> np.ndarray:
    """Nine-class raster: the groups 8 then 7 first, then the targets 1 to 6; later shapes win."""
    out = np.zeros((height, width), np.uint8)
    order = {8: 0, 7: 1}
    for points, value in sorted(shapes, key=lambda s: (order.get(s[1], 2), s[1])):
        out[fill_polygon(np.rint(points), height, width)] = value
    return out


def raster_shapes(raster: np.ndarray, least: float = 0.0) -> list[tuple[int, np.ndarray]]:
    """(value, contour) of every external component of every value, without those under ``least`` area or three points."""
    return [(int(v), p) for v in np.unique(raster[raster > 0]) for p in trace(raster == v) if len(set(map(tuple, p.tolist()))) >= 3 and area(p) >= least]


def gaussian(image: np.ndarray, sigma: float, first: int = 0) -> np.ndarray:
    """Separable Gaussian with reflected borders, over the axes from ``first`` on."""
    r = max(1, int(np.ceil(4 * sigma)))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    out = np.asarray(image, float)
    for axis in range(first, out.ndim):
        pad = [(0, 0)] * out.ndim
        pad[axis] = (r, r)
        wide = np.pad(out, pad, mode="reflect" if out.shape[axis] > r else "edge")
        line = (slice(None),) * axis
        out = sum(w * wide[(*line, slice(i, i + out.shape[axis]))] for i, w in enumerate(k))
    return out


def grain(image: np.ndarray, exclude: np.ndarray | None = None, sigma: float = 2.0) -> float:
    """1.4826 times the median absolute deviation of the image less its Gaussian; 0 without pixels."""
    return float(grains(np.asarray(image, float)[None], exclude, sigma)[0])


def grains(images: np.ndarray, exclude: np.ndarray | None = None, sigma: float = 2.0) -> np.ndarray:
    """``grain`` of each image of a stack, all with the same pixels left out."""
    high = (images - gaussian(images, sigma, 1)).reshape(len(images), -1)
    v = high if exclude is None else np.compress(~exclude.ravel(), high, 1)
    return 1.4826 * np.median(np.abs(v - np.median(v, 1, keepdims=True)), 1) if v.size else np.zeros(len(images))


def clahe(tile: np.ndarray, clip: float = 2.0, grid: int = 8) -> np.ndarray:
    """Contrast-limited adaptive equalisation of a uint8 tile: clipped histograms of a grid of cells, bilinearly blended."""
    h, w = tile.shape
    ph, pw = -h % grid, -w % grid
    wide = np.pad(tile, ((0, ph), (0, pw)), mode="reflect" if min(h, w) > max(ph, pw) else "edge")
    ch, cw = wide.shape[0] // grid, wide.shape[1] // grid
    limit = max(1, int(clip * ch * cw / 256))
    maps = np.empty((grid, grid, 256))
    for i in range(grid):
        for j in range(grid):
            hist = np.bincount(wide[i * ch : (i + 1) * ch, j * cw : (j + 1) * cw].ravel(), minlength=256)
            extra = np.maximum(hist - limit, 0).sum()
            hist = np.minimum(hist, limit) + extra // 256
            hist[: extra % 256] += 1
            maps[i, j] = np.clip(np.rint(np.cumsum(hist) * 255.0 / (ch * cw)), 0, 255)
    y, x = (np.arange(h) + 0.5) / ch - 0.5, (np.arange(w) + 0.5) / cw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    ya, yb, xa, xb = (np.clip(v, 0, grid - 1) for v in (y0, y0 + 1, x0, x0 + 1))
    at = lambda a, b: maps[a[:, None], b[None], tile]
    out = (at(ya, xa) * (1 - fx) + at(ya, xb) * fx) * (1 - fy) + (at(yb, xa) * (1 - fx) + at(yb, xb) * fx) * fy
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def stretch(tile: np.ndarray, low: float, high: float) -> np.ndarray:
    """uint8: linear between the tile's own percentiles, clipped, truncated; zeros if the range is empty."""
    lo, hi = np.percentile(tile, [low, high])
    if hi <= lo:
        return np.zeros(tile.shape, np.uint8)
    return np.clip((tile.astype(float) - lo) / (hi - lo) * 255.0, 0, 255).astype(np.uint8)


def preprocess(film: np.ndarray, x: int, y: int, side: int, low: float = 0.5, high: float = 99.5, clip: float = 2.0, grid: int = 8) -> np.ndarray:
    """Crop (exact, or an error), stretch and equalise."""
    tile = film[y : y + side, x : x + side]
    if tile.shape != (side, side):
        raise ValueError(f"the window ({x}, {y}, {side}) leaves the film {film.shape}")
    return clahe(stretch(tile, low, high), clip, grid)


def longest_run(flags: np.ndarray) -> tuple[int, int]:
    """(start, end) of the longest run of true flags, the first on ties; (0, 0) without one."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], np.asarray(flags, np.int8), [0]])))
    if not len(edge):
        return 0, 0
    n = edge[1::2] - edge[::2]
    k = int(n.argmax())
    return int(edge[2 * k]), int(edge[2 * k + 1])


#: Fixed values of the bead rule: smoothing, rows of the shortest run, share of the film of the longest, smallest half width,
#: least contrast as a share of the bright end, rows that the peak of a cut bead must be away from the border.
BEAD_SIGMA, BEAD_RUN, BEAD_SHARE, BEAD_HALF, BEAD_CONTRAST, BEAD_MARGIN = 6.0, 40, 0.97, 30.0, 0.03, 20


def bead(profile: np.ndarray) -> dict | None:
    """Centre, half width and toes of a bead in a row profile; a toe cut off by the border is None.

    The bead is the longest run above the middle of the smoothed profile's 5th and 95th percentile. Where one side is cut, the peak
    takes the centre's place. None for flat profiles, runs that are too short, too long or cut on both sides, and narrow beads.
    """
    n = len(profile)
    if not n:
        return None
    p = gaussian(np.asarray(profile, float), BEAD_SIGMA)
    dark, bright = np.percentile(p, [5, 95])
    if bright <= 0 or bright - dark < BEAD_CONTRAST * bright:
        return None
    first, stop = longest_run(p > (dark + bright) / 2)
    toes = {"top": first if first > 0 else None, "bottom": stop - 1 if stop < n else None}
    known = [t for t in toes.values() if t is not None]
    if not BEAD_RUN <= stop - first <= BEAD_SHARE * n or not known:
        return None
    if len(known) == 2:
        centre = sum(known) / 2
    else:
        centre = float(first + p[first:stop].argmax())
        if min(centre, n - 1 - centre) < BEAD_MARGIN and abs(centre - known[0]) > min(centre, n - 1 - centre):
            return None
    half = abs(known[-1] - centre)
    return {"centre": centre, "half_width": float(half), **toes} if half >= BEAD_HALF else None


def place_by_profile(source: np.ndarray, target: np.ndarray, blocked: np.ndarray, columns: np.ndarray, n: int = 3) -> tuple[int, int, float] | None:
    """(row, column, score) of the best spot for a source profile in a target's row profile; the score is the worst of ``n`` slices'
    correlations, and spots whose block flag (rows x columns) is set are passed over."""
    h = len(source)
    if h > len(target) or h < n:
        return None
    win = np.lib.stride_tricks.sliding_window_view(np.asarray(target, float), h)
    cuts = np.array_split(np.arange(h), n)
    score = np.full(len(win), np.inf)
    for c in cuts:
        a, b = np.asarray(source, float)[c], win[:, c]
        a, b = a - a.mean(), b - b.mean(1, keepdims=True)
        norm = np.sqrt((a**2).sum() * (b**2).sum(1))
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.minimum(score, np.where(norm > 0, (b @ a) / norm, -np.inf))
    for row in np.argsort(-score, kind="stable"):
        if not np.isfinite(score[row]):
            break
        free = [int(c) for c in columns if not blocked[row : row + h, c].any()]
        if free:
            return int(row), free[0], float(score[row])
    return None


def composite(host: np.ndarray, residual: np.ndarray, row: int, col: int, base: float, scale: float = 1.0) -> np.ndarray:
    """The host with a scaled residual added in the additive space, back as uint16."""
    out = host.copy()
    h, w = residual.shape
    z = np.log(np.maximum(host[row : row + h, col : col + w].astype(float) - base, 1.0)) + scale * residual
    out[row : row + h, col : col + w] = np.clip(np.rint(np.exp(z) + base), 0, 65535).astype(host.dtype)
    return out


def fill_smooth(image: np.ndarray, hole: np.ndarray, rounds: int = 400) -> np.ndarray:
    """The image with its hole filled from the border: distances inwards first, then relaxed to a harmonic surface."""
    out = np.asarray(image, float).copy()
    if not hole.any() or hole.all():
        return out
    box = mask_box(hole)
    x0, y0, x1, y1 = max(0, box[0] - 2), max(0, box[1] - 2), min(hole.shape[1], box[2] + 2), min(hole.shape[0], box[3] + 2)
    part, open_ = out[y0:y1, x0:x1].copy(), hole[y0:y1, x0:x1].copy()
    todo = open_.copy()
    while todo.any():
        wide, known = np.pad(np.where(todo, 0.0, part), 1), np.pad(~todo, 1)
        total, n = np.zeros(part.shape), np.zeros(part.shape)
        for dy, dx in ((0, 1), (2, 1), (1, 0), (1, 2)):
            total += wide[dy : dy + part.shape[0], dx : dx + part.shape[1]]
            n += known[dy : dy + part.shape[0], dx : dx + part.shape[1]]
        ring = todo & (n > 0)
        if not ring.any():
            part[todo] = out[~hole].mean()
            break
        part[ring] = total[ring] / n[ring]
        todo &= ~ring
    for _ in range(rounds):
        wide = np.pad(part, 1, mode="edge")
        mean = (wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:]) / 4
        step = np.abs(mean[open_] - part[open_]).max()
        part[open_] = mean[open_]
        if step < 1e-6 * (np.abs(part).max() + 1):
            break
    out[y0:y1, x0:x1] = part
    return out


def distance_inside(mask: np.ndarray, most: int) -> np.ndarray:
    """Steps to the outside, up to ``most``."""
    out, left = np.zeros(mask.shape), mask.copy()
    for _ in range(most):
        out += left
        p = np.pad(left, 1)
        left = left & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    return out


def additive(image: np.ndarray, base: float) -> np.ndarray:
    return np.log(np.maximum(np.asarray(image, float) - base, 1.0))


def grey(z: np.ndarray, base: float) -> np.ndarray:
    return np.clip(np.rint(np.exp(z) + base), 0, 65535).astype(np.uint16)


def extract(film: np.ndarray, mask: np.ndarray, base: float, sign: int = 0, blur: float = 1.0, ramp: int = 4, most: float = 0.0) -> dict:
    """A defect's residual in the additive space, its blending weight and the grain around it.

    ``sign``: -1 or 1 keeps darker or brighter residuals only. The residual is blurred; with ``most`` > 1 it is scaled so that its
    90th percentile depth matches the one before blurring, by that factor at most. The weight rises over ``ramp`` pixels.
    """
    z = additive(film, base)
    residual = np.where(mask, z - fill_smooth(z, mask), 0.0)
    if sign:
        residual = np.where(np.sign(residual) == sign, residual, 0.0)
    soft = gaussian(residual, blur) * mask if blur > 0 else residual
    if most > 1 and mask.any():
        before, after = (np.percentile(np.abs(r[mask]), 90) for r in (residual, soft))
        soft = soft * float(np.clip(before / after, 1.0, most)) if after > 0 else soft
    weight = np.minimum(distance_inside(mask, ramp) / ramp, 1.0)
    return {"residual": soft * weight, "weight": weight, "grain": grain(z, mask)}


def null_implant(film: np.ndarray, mask: np.ndarray, base: float, seed: int) -> np.ndarray:
    """The film with the masked part removed and refilled with background and grain; no other pixel changes."""
    z = additive(film, base)
    noise = np.random.default_rng(seed).normal(0, grain(z, mask), z.shape)
    out = film.copy()
    out[mask] = grey(fill_smooth(z, mask) + noise, base)[mask]
    return out


def augmentation(u: np.ndarray, elongated: bool, scale: float = 0.2, aspect: float = 0.2, amplitude: float = 0.15) -> dict:
    """Parameters from six uniform draws: scale, aspect (split over both sides), rotation (10 degrees at most for elongated
    shapes), amplitude and flips."""
    spread = lambda v, s: float(np.exp((2 * v - 1) * np.log1p(s)))
    a = spread(u[1], aspect)
    turn = 10.0 if elongated else 180.0
    return {"sx": spread(u[0], scale) * np.sqrt(a), "sy": spread(u[0], scale) / np.sqrt(a), "degrees": (2 * float(u[2]) - 1) * turn, "amplitude": spread(u[3], amplitude), "flip_x": bool(u[4] < 0.5), "flip_y": bool(u[5] < 0.5)}


def warp(image: np.ndarray, points: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray]:
    """An image and its points under one affine map, on a canvas that holds the whole transformed crop; bilinear, 0 outside."""
    h, w = image.shape
    t = np.deg2rad(p["degrees"])
    m = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]]) @ np.diag([p["sx"] * (-1 if p["flip_x"] else 1), p["sy"] * (-1 if p["flip_y"] else 1)])
    corners = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float) @ m.T
    low = corners.min(0)
    size = np.ceil(corners.max(0) - low).astype(int) + 1
    yy, xx = np.mgrid[: size[1], : size[0]]
    back = (np.stack([xx, yy], -1) + low) @ np.linalg.inv(m).T
    x, y = back[..., 0], back[..., 1]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    out = np.zeros(x.shape)
    for dy in (0, 1):
        for dx in (0, 1):
            xi, yi = x0 + dx, y0 + dy
            ok = (xi >= 0) & (xi < w) & (yi >= 0) & (yi < h)
            weight = (1 - np.abs(x - xi)) * (1 - np.abs(y - yi))
            out[ok] += (weight * np.asarray(image, float)[np.clip(yi, 0, h - 1), np.clip(xi, 0, w - 1)])[ok]
    return out * p["amplitude"], np.asarray(points, float) @ m.T - low


def place_by_geometry(u: float, height: int, width: int, centre: float, half_width: float, seam: np.ndarray, blocked: np.ndarray, columns: np.ndarray, score, least: float) -> tuple[int, int, float] | None:
    """(row, column, score) of the best free spot inside the seam whose centre is at across-weld place ``u``; None if none reaches
    ``least``. ``score(row, column)`` rates a spot."""
    row = int(np.rint(centre + u * half_width - (height - 1) / 2))
    if row < 0 or row + height > seam.shape[0]:
        return None
    best = None
    for c in columns:
        c = int(c)
        if c < 0 or c + width > seam.shape[1] or blocked[row : row + height, c : c + width].any() or not seam[row : row + height, c : c + width].all():
            continue
        s = float(score(row, c))
        if s >= least and (best is None or s > best[2]):
            best = (row, c, s)
    return best


def across_weld(points: np.ndarray, centre: float, half_width: float) -> float:
    """The across-weld place of a polygon's middle: 0 on the centre line, 1 on the toe."""
    p = np.asarray(points, float)
    return float(((p[:, 1].min() + p[:, 1].max()) / 2 - centre) / half_width)


def dilate(mask: np.ndarray, r: int) -> np.ndarray:
    """The mask grown by a square of 2 r + 1 pixels."""
    out = mask
    for axis in (0, 1):
        wide = np.pad(out, [(r, r) if a == axis else (0, 0) for a in (0, 1)]).astype(np.int32)
        total = np.cumsum(np.insert(wide, 0, 0, axis=axis), axis=axis)
        n = mask.shape[axis]
        out = np.take(total, np.arange(2 * r + 1, n + 2 * r + 1), axis) > np.take(total, np.arange(n), axis)
    return out


def _around(image: np.ndarray, points: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The image (or each of a stack) around a polygon, the polygon's mask in it, and its corner (x, y)."""
    p = np.asarray(points, float)
    (x0, y0), (x1, y1) = np.maximum(np.floor(p.min(0)).astype(int) - pad, 0), np.ceil(p.max(0)).astype(int) + pad + 1
    crop = np.asarray(image[..., y0:y1, x0:x1], float)
    return crop, fill_polygon(np.rint(p - [x0, y0]), *crop.shape[-2:]), int(x0), int(y0)


def local_cnr(image: np.ndarray, points: np.ndarray, inner: int = 3, outer: int = 9, pad: int = 60) -> float:
    """(Median of the ring ``inner`` to ``outer`` pixels around a polygon - mean inside) / grain of what is not near the polygon."""
    return float(local_cnrs(np.asarray(image)[None], points, inner, outer, pad)[0])


def local_cnrs(images: np.ndarray, points: np.ndarray, inner: int = 3, outer: int = 9, pad: int = 60) -> np.ndarray:
    """``local_cnr`` of one polygon in each image of a stack: its masks are drawn once."""
    crops, mask, _, _ = _around(images, points, pad)
    near = dilate(mask, inner)
    ring = dilate(mask, outer) & ~near
    if not ring.any() or not mask.any():
        return np.full(len(images), np.nan)
    pixels = crops.reshape(len(crops), -1)
    among = lambda m: np.compress(m.ravel(), pixels, 1)
    return (np.median(among(ring), 1) - among(mask).mean(1)) / np.maximum(grains(crops, near), 1e-9)


def pore_dip(image: np.ndarray, points: np.ndarray, others: np.ndarray | None = None, inner: int = 2, outer: int = 8, least: int = 5, ring_least: int = 20) -> tuple[float, float] | None:
    """(background, dip) of a pore: the median of the ring around it without other shapes, and that less the mean inside. None for a
    pore or ring of too few pixels, or one that is not darker than its ring."""
    crop, mask, x0, y0 = _around(image, points, outer + 2)
    ring = dilate(mask, outer) & ~dilate(mask, inner)
    if others is not None:
        ring &= ~others[y0 : y0 + crop.shape[0], x0 : x0 + crop.shape[1]]
    if mask.sum() < least or ring.sum() < ring_least:
        return None
    back = float(np.median(crop[ring]))
    dip = back - float(crop[mask].mean())
    return (back, dip) if dip > 0 and back > 0 else None


def keep_out(height: int, width: int, shapes: list[np.ndarray], grow: int, windows: list[tuple[int, int, int]]) -> np.ndarray:
    """Where nothing may be put: the shapes grown by ``grow`` pixels, and the windows (x, y, side)."""
    out = np.zeros((height, width), bool)
    for p in shapes:
        out |= fill_polygon(np.rint(np.asarray(p, float)), height, width)
    out = dilate(out, grow) if out.any() else out
    for x, y, side in windows:
        out[max(0, y) : y + side, max(0, x) : x + side] = True
    return out


def _is_box(p: np.ndarray) -> bool:
    """Whether a polygon is its bounding box: four corners, two and two opposite."""
    total = p.min(0) + p.max(0)
    return len(p) == 4 and bool((p[0] != p[2]).all() and (p[1] != p[3]).all() and (p[0] + p[2] == total).all() and (p[1] + p[3] == total).all() and (p[0] == p[1]).sum() == 1)


def masks_clash(a: np.ndarray, b: np.ndarray, grow: int) -> bool:
    """Whether polygon ``b`` has a pixel within ``grow`` pixels of polygon ``a``. Masks lie within their boxes, hold their vertices, and
    fill the box of a rectangle; only pairs that this leaves open are drawn."""
    a, b = np.rint(np.asarray(a, float)), np.rint(np.asarray(b, float))
    if (a.min(0) - b.max(0) > grow).any() or (b.min(0) - a.max(0) > grow).any():
        return False
    if (np.abs(a[:, None] - b[None]).max(2) <= grow).any() or (_is_box(a) and _is_box(b)):
        return True
    low = np.minimum(a.min(0), b.min(0)) - grow - 2
    width, height = (np.maximum(a.max(0), b.max(0)) - low + grow + 3).astype(int)
    return bool((dilate(fill_polygon(a - low, height, width), grow) & fill_polygon(b - low, height, width)).any())


def cut(film: np.ndarray, turns: int, x: int, y: int, height: int, width: int) -> np.ndarray:
    """A crop of a film after quarter turns counter-clockwise; an error if it leaves the film."""
    image = np.rot90(film, turns)
    if x < 0 or y < 0 or y + height > image.shape[0] or x + width > image.shape[1]:
        raise ValueError(f"the crop ({x}, {y}, {width} x {height}) leaves the film {image.shape}")
    return image[y : y + height, x : x + width]


def compare_cut(film: np.ndarray, turns: int, x: int, y: int, crop: np.ndarray) -> str:
    """How a stored crop differs from what its place in the film gives: exact, or the number of pixels, or what is wrong."""
    try:
        own = cut(film, turns, x, y, *crop.shape)
    except ValueError as e:
        return f"bad offset: {e}"
    n = int(np.count_nonzero(own != crop))
    return "exact" if not n else f"{n} px differ"


def rederived(points: np.ndarray, x: int, y: int, side: int, eps: float = 0.0, **rule) -> dict | None:
    """What tracing a kept polygon in a window gives: its pieces, vertices, the overlap of the traced polygon filled again with
    the mask, and the largest distance of its box from the mask's; None if the keep rule drops it."""
    if kept_box(points, x, y, side, **rule) is None:
        return None
    mask = visible_mask(points, x, y, side)
    box, pieces = mask_box(mask), trace(mask)
    line = pieces[0]
    for piece in pieces[1:]:
        line = merge(line, piece)
    line = simplify(line, eps)
    again = fill_polygon(line, side, side)
    (px0, py0), (px1, py1) = line.min(0), line.max(0)
    away = max(abs(px0 - box[0]), abs(py0 - box[1]), abs(px1 - (box[2] - 1)), abs(py1 - (box[3] - 1)))
    return {"pieces": len(pieces), "vertices": len(line), "iou": float((again & mask).sum() / (again | mask).sum()), "deviation": float(away)}
