"""Pixel features of one picture (height x width x 3, RGB bytes) and a plain PNG writer."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Weights of red, green and blue in a grey level; smoothing and difference of the Sobel filter.
GREY_WEIGHTS = (0.2125, 0.7154, 0.0721)
SOBEL_SMOOTH, SOBEL_EDGE = (1, 2, 1), (1, 0, -1)
STRONG_EDGE = 0.1
N_COLORS = 5


def encode_png(rgb: np.ndarray) -> bytes:
    """8-bit RGB, not interlaced, rows unfiltered."""
    h, w, _ = rgb.shape

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, w * 3)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def decode_png(body: bytes) -> tuple[str, np.ndarray | None]:
    """("ok", pixels: height x width x 1 or 3), ("corrupt", None) where the file ends before its pixels do, or ("other", None).

    Read here are the plain kinds: 8-bit grey or RGB, not interlaced, without colour tables or profiles, rows unfiltered
    or as differences from the left or from above. What is other may still be a picture, for a reader of all kinds."""
    other = "other", None
    if body[:8] != b"\x89PNG\r\n\x1a\n" or body[12:16] != b"IHDR" or len(body) < 33:
        return other
    w, h, depth, kind, *rest = struct.unpack(">IIBBBBB", body[16:29])
    if depth != 8 or kind not in (0, 2) or any(rest) or not w or not h:
        return other
    at, parts = 33, []
    while at + 8 <= len(body):
        size, name = int.from_bytes(body[at : at + 4], "big"), body[at + 4 : at + 8]
        if name == b"IEND":
            break
        if name == b"IDAT":
            parts.append(body[at + 8 : at + 8 + size])
        elif name not in (b"tEXt", b"pHYs", b"tIME"):
            return other
        at += 12 + size
    whole, channels = body[at + 4 : at + 8] == b"IEND", 1 if kind == 0 else 3
    line, inflate = w * channels + 1, zlib.decompressobj()
    try:
        raw = inflate.decompress(b"".join(parts), h * line)
    except zlib.error:
        return other
    if len(raw) < h * line:
        return other if whole else ("corrupt", None)
    rows = np.frombuffer(raw, np.uint8).reshape(h, line)
    filters, x = rows[:, 0], rows[:, 1:].reshape(h, w, channels)
    if filters.any():
        if filters.max() > 2:
            return other
        x = x.copy()
        for i in np.flatnonzero(filters):
            x[i] = np.cumsum(x[i], axis=0, dtype=np.uint8) if filters[i] == 1 else x[i] + x[i - 1] if i else x[i]
    return "ok", x


def grey(rgb: np.ndarray) -> np.ndarray:
    """Levels 0 to 255, as whole numbers."""
    return np.floor(rgb.astype(np.float64) @ np.array(GREY_WEIGHTS)).astype(np.int64)


def histogram(rgb: np.ndarray, bins: int = 64) -> np.ndarray:
    """Share of pixels by level, red then green then blue."""
    pixels = rgb.reshape(-1, 3)
    return np.concatenate([np.bincount(pixels[:, c].astype(np.int64) * bins // 256, minlength=bins) for c in range(3)]) / len(pixels)


def dominant_colors(rgb: np.ndarray, n: int = N_COLORS, rounds: int = 100) -> np.ndarray:
    """n x 3 centres of k-means over the pixels, in 0..1, the one with most pixels first (ties: darkest first).

    Nearly black pixels are taken for background where over 100 others are left. Equal pixels are one point with a weight.
    Starting centres are the heaviest colour and then, one after another, the one farthest from those taken. Missing
    centres are zero."""
    pixels = rgb.reshape(-1, 3).astype(np.int64)
    lit = pixels.sum(axis=1) > 10
    if lit.sum() > 100:
        pixels = pixels[lit]
    colors, weight = np.unique(pixels, axis=0, return_counts=True)
    x, out = colors.astype(np.float64), np.zeros((n, 3))
    centre = x[[int(weight.argmax())]]
    while len(centre) < min(n, len(x)):
        far = ((x[:, None] - centre[None]) ** 2).sum(axis=2).min(axis=1)
        centre = np.concatenate([centre, x[[int(far.argmax())]]])
    of = None
    for _ in range(rounds):
        now = ((x[:, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
        if of is not None and (now == of).all():
            break
        of = now
        size = np.bincount(of, weight, minlength=len(centre))
        sums = np.stack([np.bincount(of, weight * x[:, c], minlength=len(centre)) for c in range(3)], axis=1)
        centre = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centre)
    size = np.bincount(of, weight, minlength=len(centre))
    out[: len(centre)] = centre[np.lexsort((*centre.T[::-1], -size))] / 255
    return out


def texture(level: np.ndarray) -> list[float]:
    """Contrast, dissimilarity, homogeneity, energy and correlation of horizontal neighbours, either way round."""
    a, b = level[:, :-1].ravel(), level[:, 1:].ravel()
    if not len(a):
        return [0.0, 0.0, 1.0, 1.0, 1.0]
    i, j = np.concatenate([a, b]), np.concatenate([b, a])
    apart = (i - j).astype(np.float64)
    _, n = np.unique(i * 256 + j, return_counts=True)
    spread = i.var()
    alike = ((i - i.mean()) * (j - j.mean())).mean() / spread if spread > 0 else 1.0
    return [float((apart**2).mean()), float(np.abs(apart).mean()), float((1 / (1 + apart**2)).mean()), float(np.sqrt(((n / len(i)) ** 2).sum())), float(alike)]


def along(x: np.ndarray, weights: tuple, axis: int) -> np.ndarray:
    """Correlation with three weights along an axis; borders are mirrored with the border pixel."""
    x = np.moveaxis(x, axis, 0)
    wide = np.concatenate([x[:1], x, x[-1:]])
    return np.moveaxis(sum(w * wide[k : k + len(x)] for k, w in enumerate(weights)), 0, axis)


def edges(level: np.ndarray) -> list[float]:
    """Mean and spread of the Sobel gradient (of levels in 0..1), and the share of pixels where it is over ``STRONG_EDGE``."""
    x = level / 255.0
    across = along(along(x, SOBEL_EDGE, 0), SOBEL_SMOOTH, 1) / 4
    down = along(along(x, SOBEL_EDGE, 1), SOBEL_SMOOTH, 0) / 4
    strength = np.hypot(across, down)
    return [float(strength.mean()), float(strength.std()), float((strength > STRONG_EDGE).mean())]
