"""The composite pattern: a base, warped, masked and toned."""

from __future__ import annotations

import numpy as np

from . import noise
from .params import at_share
from .patterns import get

# What the four choices stand for, and the constant that tells the slots' seeds apart.
BASES = ("STRIPES", "CHECKER", "PERLIN", "WORLEY", "WOOD", "MARBLE")
WARPS = ("none", "noise", "ripple", "swirl")
MASKS = ("none", "edges", "dots", "hexagons")
TONES = ("none", "gamma", "curve")
SLOT = 0x85EBCA6B


def slot_seed(seed, slot: int) -> np.int64:
    return np.int64(seed) ^ noise.GOLDEN ^ np.int64(SLOT * (slot + 1) & 0xFFFFFFFF)


def _base(kind: str, x, y, share: float, seed):
    p = at_share(get(kind), share)
    if kind == "STRIPES":
        turn = np.radians(p["angle_deg"])
        return np.sin(2 * np.pi * p["freq"] * (x * np.cos(turn) + y * np.sin(turn)) + p["phase"])
    if kind == "CHECKER":
        return noise.checker(x, y, p["cells"], p["angle_deg"])
    return noise.KERNELS[kind](x, y, p, seed)


def bilinear(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The image at coordinates -1..1 of its pixels' centres; beyond the border, the border."""
    height, width = image.shape
    at = []
    for c, n in ((x, width), (y, height)):
        place = np.clip((c + 1) / 2 * (n - 1), 0, n - 1)
        low = np.minimum(np.floor(place).astype(int), max(n - 2, 0))
        at.append((low, np.minimum(low + 1, n - 1), place - low))
    (x0, x1, u), (y0, y1, v) = at
    return (image[y0, x0] * (1 - u) + image[y0, x1] * u) * (1 - v) + (image[y1, x0] * (1 - u) + image[y1, x1] * u) * v


def _warped(kind: str, image, x, y, share: float, seed):
    amount = 0.02 + 0.18 * share
    r = np.sqrt(x * x + y * y + 1e-6)
    if kind == "noise":
        scale = 16 + 240 * share
        u = x + amount * noise.gradient_noise(x, y, scale, seed)
        v = y + amount * noise.gradient_noise(x, y, scale * 1.37, seed ^ noise.GOLDEN)
    elif kind == "ripple":
        phase = float(np.mod(np.float32(seed), np.float32(1000))) / 1000
        turn = 2 * np.pi * (r * (4 + 12 * share) + phase)
        u, v = x + amount * np.sin(turn), y + amount * np.cos(turn)
    else:
        turn = (1 + 3 * share) * r
        u = (1 - amount) * x + amount * (x * np.cos(turn) - y * np.sin(turn))
        v = (1 - amount) * y + amount * (x * np.sin(turn) + y * np.cos(turn))
    return bilinear(image, np.clip(u, -1, 1), np.clip(v, -1, 1))


def _masked(kind: str, image, x, y, share: float, seed):
    d = noise.nearest_site(x, y, 20 + 220 * share, seed)
    if kind == "edges":
        mask = 1 - np.exp(-8 * d)
    elif kind == "dots":
        t = np.clip(d / 0.12, 0, 1)
        mask = 1 - t * t * (3 - 2 * t)
    else:
        mask = (1 - d) ** 2
    return image * mask + (1 - mask) * image.mean()


def _toned(kind: str, image, share: float):
    t = np.clip((image + 1) / 2, 0, 1)
    if kind == "gamma":
        t = t ** (0.6 + 1.4 * share)
    else:
        a = 0.3 + 0.4 * share
        t = (1 - a) * t + a * (t * (2 - t))
    return 2 * t - 1


def composite(x, y, p, seed):
    pick = lambda choices, v: choices[min(max(round(v), 0), len(choices) - 1)]
    image = _base(pick(BASES, p["base_id"]), x, y, p["base_q"], slot_seed(seed, 1))
    if (warp := pick(WARPS, p["warp_id"])) != "none":
        image = _warped(warp, image, x, y, p["warp_q"], slot_seed(seed, 2))
    if (mask := pick(MASKS, p["mask_id"])) != "none":
        image = _masked(mask, image, x, y, p["mask_q"], slot_seed(seed, 3))
    if (tone := pick(TONES, p["pal_id"])) != "none":
        image = _toned(tone, image, p["pal_q"])
    return np.clip(image, -1, 1)


noise.KERNELS["COMPOSITE"] = composite
