"""Small numpy helpers on one grey image; Spark partitions the images, see :mod:`cardloom.sources.images`."""

from __future__ import annotations

import struct

import numpy as np

# Difference of the means of two halves, and range of the four quarters' means, above which light is uneven.
HALF_DIFFERENCE, QUARTER_RANGE = 30.0, 40.0
# Shadow removal (kernel as a share of the longer side, target brightness), first try and those of the second pass.
SHADOW = (0.15, 220.0)
SHADOW_AGAIN = {"fb15": (0.15, 220.0), "fb20": (0.20, 230.0), "fb10": (0.10, 200.0)}
# Least and largest kernel; mean brightness below which gamma is raised, and by how much.
KERNEL = (51, 255)
GAMMAS = ((70, 2.0), (100, 1.5))
# Images whose longer side is below the first are scaled to the second.
SMALL_SIDE, SCALED_SIDE = 800, 1600


def exif_orientation(content: bytes) -> int:
    """Value 1 to 8 of the orientation tag of a JPEG file; 1 where there is none."""
    at = 2
    while content[:2] == b"\xff\xd8" and at + 4 <= len(content) and content[at] == 0xFF:
        marker, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        if marker == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            return _tag(content[at + 10 : at + 2 + size])
        if marker == 0xDA or size < 2:
            break
        at += 2 + size
    return 1


def _tag(tiff: bytes) -> int:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return 1
    start = struct.unpack(order + "I", tiff[4:8])[0]
    if start + 2 > len(tiff):
        return 1
    for k in range(struct.unpack(order + "H", tiff[start : start + 2])[0]):
        entry = tiff[start + 2 + 12 * k : start + 14 + 12 * k]
        if len(entry) == 12 and struct.unpack(order + "H", entry[:2])[0] == 0x0112:
            value = struct.unpack(order + "H", entry[8:10])[0]
            return value if 1 <= value <= 8 else 1
    return 1


def upright(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels as the orientation tag wants them shown."""
    turned = np.rot90(pixels, {3: 2, 4: 2, 5: 3, 6: 3, 7: 1, 8: 1}.get(orientation, 0))
    return turned[:, ::-1] if orientation in (2, 4, 5, 7) else turned


def grey(pixels: np.ndarray) -> np.ndarray:
    """Brightness of blue-green-red pixels; one channel stays as it is."""
    if pixels.ndim == 2 or pixels.shape[2] == 1:
        return pixels.reshape(pixels.shape[:2])
    weights = np.array([0.114, 0.587, 0.299])
    return np.clip(np.rint(pixels[:, :, :3] @ weights), 0, 255).astype(np.uint8)


def uneven_light(image: np.ndarray, threshold: float = HALF_DIFFERENCE) -> bool:
    """Do the means of opposite halves differ by more than the threshold, or those of the quarters span more than theirs?"""
    h, w = image.shape[0] // 2, image.shape[1] // 2
    mean = lambda part: float(part.mean()) if part.size else 0.0
    if abs(mean(image[:, :w]) - mean(image[:, w:])) > threshold or abs(mean(image[:h]) - mean(image[h:])) > threshold:
        return True
    quarters = [mean(q) for q in (image[:h, :w], image[:h, w:], image[h:, :w], image[h:, w:])]
    return max(quarters) - min(quarters) > QUARTER_RANGE


def blurred(image: np.ndarray, size: int) -> np.ndarray:
    """Gaussian blur with an odd kernel, edges mirrored, one axis after the other."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - size // 2
    kernel = np.exp(-(x**2) / (2 * sigma**2))
    kernel /= kernel.sum()
    out = image.astype(np.float64)
    for axis in (0, 1):
        pad = [(size // 2,) * 2 if a == axis else (0, 0) for a in (0, 1)]
        mirrored = np.pad(out, pad, mode="reflect" if out.shape[axis] > size // 2 else "symmetric")
        out = sum(k * np.take(mirrored, range(i, i + image.shape[axis]), axis) for i, k in enumerate(kernel))
    return np.rint(out)


def without_shadow(image: np.ndarray, share: float = SHADOW[0], target: float = SHADOW[1]) -> np.ndarray:
    """Brightness over that of a strongly blurred background, times the target."""
    size = max(KERNEL[0], min(KERNEL[1], int(max(image.shape) * share)))
    background = blurred(image, size + (size % 2 == 0))
    return np.clip(image / (background + 1e-6) * target, 0, 255).astype(np.uint8)


def otsu_threshold(image: np.ndarray) -> int:
    """The brightness that separates dark from light best, by the variance between the two."""
    count = np.bincount(image.ravel(), minlength=256).astype(np.float64)
    below = np.cumsum(count)
    sums = np.cumsum(count * np.arange(256))
    above = below[-1] - below
    both = (below > 0) & (above > 0)
    gap = np.where(both, sums / np.maximum(below, 1) - (sums[-1] - sums) / np.maximum(above, 1), 0)
    return int(np.argmax(below * above * gap**2))


def binarised(image: np.ndarray) -> np.ndarray:
    return np.where(image > otsu_threshold(image), 255, 0).astype(np.uint8)


def equalised(image: np.ndarray) -> np.ndarray:
    """Histogram spread over all brightnesses; an image of one brightness stays."""
    upto = np.cumsum(np.bincount(image.ravel(), minlength=256))
    least = upto[upto > 0][0]
    if least == upto[-1]:
        return image.copy()
    return np.clip(np.rint((upto - least) * 255.0 / (upto[-1] - least)), 0, 255).astype(np.uint8)[image]


def brightened(image: np.ndarray) -> np.ndarray | None:
    """With raised gamma if the image is dark, else nothing."""
    gamma = next((g for below, g in GAMMAS if image.mean() < below), None)
    if gamma is None:
        return None
    return ((np.arange(256) / 255.0) ** (1 / gamma) * 255).astype(np.uint8)[image]


def scaled_size(height: int, width: int) -> tuple[int, int]:
    """Height and width after small images are scaled up."""
    longer = max(height, width)
    if not 0 < longer < SMALL_SIDE:
        return height, width
    return int(height * (SCALED_SIDE / longer)), int(width * (SCALED_SIDE / longer))


def scaled(image: np.ndarray) -> np.ndarray:
    """Scaled up if small, by linear interpolation."""
    height, width = scaled_size(*image.shape)
    if (height, width) == image.shape:
        return image
    out = image.astype(np.float64)
    for axis, n in ((0, height), (1, width)):
        at = np.clip((np.arange(n) + 0.5) * out.shape[axis] / n - 0.5, 0, out.shape[axis] - 1)
        low = np.floor(at).astype(int)
        high = np.minimum(low + 1, out.shape[axis] - 1)
        part = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
        out = np.take(out, low, axis) * (1 - part) + np.take(out, high, axis) * part
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def projection_score(edges: np.ndarray, degrees: float) -> float:
    """Variance of the row sums after a turn about the centre: greatest where lines of text lie level."""
    y, x = np.nonzero(edges)
    turn = np.deg2rad(degrees)
    row = np.rint((y - edges.shape[0] / 2) * np.cos(turn) - (x - edges.shape[1] / 2) * np.sin(turn) + edges.shape[0] / 2).astype(int)
    inside = (row >= 0) & (row < edges.shape[0])
    return float(np.bincount(row[inside], edges[y, x][inside].astype(np.float64), edges.shape[0]).var())


def variants(image: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """Labelled variants of a grey image that OCR reads; those that need local contrast or denoising are left to the OCR hook."""
    image = scaled(image)
    out = [("otsu", binarised(image)), ("raw_gray", image)]
    if uneven_light(image):
        lit = without_shadow(image)
        out += [("shadow", lit), ("shadow_otsu", binarised(lit)), ("shadow_eq", equalised(lit))]
    light = brightened(image)
    return out + ([("gamma", light)] if light is not None else [])


def variants_again(image: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """Variants of the second pass, for images whose best score is low; those with local contrast are left to the OCR hook."""
    out = []
    for tag, (share, target) in SHADOW_AGAIN.items():
        lit = without_shadow(image, share, target)
        out += [(f"sh_{tag}_plain", lit), (f"sh_{tag}_otsu", binarised(lit)), (f"sh_{tag}_eq", equalised(lit))]
    return out
