"""Many small values as one compressed value, for rows that hold a chunk or a bucket."""

from __future__ import annotations

import numpy as np
import zstandard


def zipped(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x)


def unzipped(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def pack_numbers(*arrays: np.ndarray) -> bytes:
    """Whole-number arrays as one compressed value: byte planes, so that small numbers shrink."""
    planes = [np.ascontiguousarray(a).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays]
    return zipped(b"".join([np.array([len(arrays), *map(len, arrays)], "<i8").tobytes(), *planes]))


def unpack_numbers(blob: bytes) -> list[np.ndarray]:
    raw = unzipped(blob)
    k = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes, at, out = np.frombuffer(raw, "<i8", k, 8).tolist(), 8 * (k + 1), []
    for n in sizes:
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view("<i8").ravel())
        at += 8 * n
    return out
