"""Floats on their way to a client: with fewer bits of mantissa, and XOR-coded."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Bits of a double's mantissa.
MANTISSA = 52


def truncated(values: Sequence[float | None], bits: int) -> list[float | None]:
    """``values`` with all but the first ``bits`` bits of the mantissa zero.  Infinities and
    what is no number stay as they are, and so does None."""
    if not 0 <= bits <= MANTISSA:
        raise ValueError(f"a mantissa has 0 to {MANTISSA} bits")
    there = np.array([v is not None for v in values], bool)
    data = np.array([0.0 if v is None else v for v in values], np.float64)
    raw = data.view(np.uint64)
    mask = np.uint64((1 << 64) - (1 << (MANTISSA - bits)))
    cut = np.where(np.isfinite(data), raw & mask, raw).view(np.float64)
    return [float(x) if t else None for x, t in zip(cut, there)]


def xored(values: Sequence[float | None]) -> tuple[bytes, list[int]]:
    """Floats, each as the bytes in which it differs from the one before, and the places of None.

    A byte says how many zero bytes lead the difference (upper half) and how many bytes
    follow (lower half); zero bytes at its end are left out.  Equal neighbours take one byte, and
    floats of few mantissa bits few more.
    """
    nulls = [i for i, v in enumerate(values) if v is None]
    raw = np.array([0.0 if v is None else v for v in values], ">f8").view(np.uint64)
    out = bytearray()
    for x in np.ascontiguousarray(raw ^ np.concatenate([np.zeros(1, np.uint64), raw[:-1]])[: len(raw)]).view(np.uint8).reshape(-1, 8):
        data = x.tobytes().rstrip(b"\0")
        lead = len(data) - len(data.lstrip(b"\0"))
        out.append((lead << 4 | len(data) - lead) if data else 0)
        out += data[lead:]
    return bytes(out), nulls


def unxored(data: bytes, nulls: Sequence[int] = ()) -> list[float | None]:
    """The floats of ``xored``."""
    parts, at = [], 0
    while at < len(data):
        lead, size = data[at] >> 4, data[at] & 15
        parts.append((b"\0" * lead + data[at + 1 : at + 1 + size]).ljust(8, b"\0"))
        at += 1 + size
    raw = np.frombuffer(b"".join(parts), np.uint64)
    out: list[float | None] = np.bitwise_xor.accumulate(raw).view(">f8").tolist() if len(raw) else []
    for i in nulls:
        out[i] = None
    return out
