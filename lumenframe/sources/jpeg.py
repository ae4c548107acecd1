"""Baseline JPEG in numpy: the entropy-coded bits are read value by value, everything after that works on all blocks at once.

For workers without an imaging library; ``decode_images`` takes another decoder where there is one. Progressive and arithmetic files are
refused with ValueError.
"""

from __future__ import annotations

import numpy as np


def _zigzag() -> list[int]:
    """Places of the 64 coefficients in the order of the file: along the diagonals, turning at each end."""
    by_diagonal = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return [8 * y + x for y, x in by_diagonal]


ZIGZAG = _zigzag()
#: Rows are the cosine functions of an 8-point transform.
COSINES = np.array([[(0.125 if k == 0 else 0.25) ** 0.5 * np.cos((2 * n + 1) * k * np.pi / 16) for n in range(8)] for k in range(8)])


def _codes(body: bytes) -> dict[tuple[int, int], int]:
    """(length, code) to value of a Huffman table."""
    out, code, at = {}, 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            out[n, code] = body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


class _Bits:
    """A scan's bits, without the zeros stuffed behind bytes of ones."""

    def __init__(self, data: bytes):
        self.raw = data.replace(b"\xff\x00", b"\xff")
        self.at, self.left = 0, 8 * len(self.raw)

    def take(self, n: int) -> int:
        if self.at + n > self.left:
            raise ValueError("a JPEG scan that ends early")
        first = self.at >> 3
        word = int.from_bytes(self.raw[first : first + 4].ljust(4, b"\0"), "big")
        out = word >> (32 - (self.at & 7) - n) & ((1 << n) - 1)
        self.at += n
        return out

    def symbol(self, table: list[tuple[int, int]]) -> int:
        """The next coded value, looked up by the next 16 bits."""
        first = self.at >> 3
        word = int.from_bytes(self.raw[first : first + 4].ljust(4, b"\xff"), "big")
        n, value = table[word >> (16 - (self.at & 7)) & 0xFFFF]
        if not n or self.at + n > self.left:
            raise ValueError("a damaged JPEG code")
        self.at += n
        return value

    def signed(self, n: int) -> int:
        if not n:
            return 0
        v = self.take(n)
        return v if v >> (n - 1) else v - (1 << n) + 1


def _lookup(codes: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    table = [(0, 0)] * (1 << 16)
    for (n, code), value in codes.items():
        table[code << (16 - n) : (code + 1) << (16 - n)] = [(n, value)] * (1 << (16 - n))
    return table


def _segments(blob: bytes):
    """(marker, body) of each segment; a scan's body is followed by its entropy-coded data under marker 0."""
    at = 2
    while at + 4 <= len(blob):
        if blob[at] != 0xFF:
            raise ValueError("a damaged JPEG segment")
        marker = blob[at + 1]
        if marker == 0xD9:
            return
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(blob[at + 2 : at + 4], "big")
        yield marker, blob[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDA:
            end = at
            while True:
                end = blob.find(b"\xff", end)
                if end < 0 or end + 1 >= len(blob):
                    end = len(blob)
                    break
                if blob[end + 1] == 0 or 0xD0 <= blob[end + 1] <= 0xD7:
                    end += 2
                    continue
                break
            yield 0, blob[at:end]
            at = end


def decode_jpeg(blob: bytes) -> np.ndarray:
    """A baseline JPEG, grey or of three components, to height x width x 3 in blue, green, red."""
    quant: dict[int, np.ndarray] = {}
    huff: dict[int, list] = {}
    frame, scan, interval = None, None, 0
    for marker, body in _segments(blob):
        if marker == 0xDB:
            while body:
                wide, key = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                quant[key] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                huff[body[0]] = _lookup(_codes(body[1:n]))
                body = body[n:]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8 or body[5] not in (1, 3):
                raise ValueError("a kind of JPEG that is not read")
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("a progressive or lossless JPEG, which is not read")
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            scan = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
        elif marker == 0:
            if frame is None or scan is None or len(scan) != len(frame) or not width or not height:
                raise ValueError("a JPEG scan without its header")
            return _picture(_blocks(body, frame, scan, huff, interval, width, height), frame, quant, width, height)
    raise ValueError("a JPEG without a scan")


def _blocks(data: bytes, frame: list, scan: dict, huff: dict, interval: int, width: int, height: int) -> list[np.ndarray]:
    """Coefficients of each component: block rows x block columns x 64, in the order of the file."""
    most_h, most_v = max(f[1] for f in frame), max(f[2] for f in frame)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    if len(frame) == 1:
        frame = [(frame[0][0], 1, 1, frame[0][3])]
        across, down = -(-width // 8), -(-height // 8)
    parts, start = [], 0  # restart markers cut the data
    for i in range(len(data) - 1):
        if data[i] == 0xFF and 0xD0 <= data[i + 1] <= 0xD7:
            parts.append(data[start:i])
            start = i + 2
    parts.append(data[start:])
    out = [np.zeros((down * v, across * h, 64), np.int32) for _, h, v, _ in frame]
    tables = []
    for key, *_ in frame:
        if key not in scan or scan[key] >> 4 not in huff or 16 | scan[key] & 15 not in huff:
            raise ValueError("a JPEG without a code table")
        tables.append((huff[scan[key] >> 4], huff[16 | scan[key] & 15]))
    units = across * down
    for k, part in enumerate(parts):
        bits, last = _Bits(part), [0] * len(frame)
        for unit in range(k * (interval or units), min(units, (k + 1) * (interval or units))):
            for c, (_, h, v, _) in enumerate(frame):
                dc, ac = tables[c]
                for b in range(h * v):
                    block = out[c][unit // across * v + b // h, unit % across * h + b % h]
                    last[c] += bits.signed(bits.symbol(dc))
                    block[0] = last[c]
                    i = 1
                    while i < 64:
                        code = bits.symbol(ac)
                        if not code:
                            break
                        i += code >> 4
                        if i > 63:
                            raise ValueError("a damaged JPEG block")
                        block[i] = bits.signed(code & 15)
                        i += 1
    return out


def _picture(blocks: list[np.ndarray], frame: list, quant: dict, width: int, height: int) -> np.ndarray:
    most_h, most_v = (max(f[i] for f in frame) if len(frame) > 1 else 1 for i in (1, 2))
    planes = []
    for x, (_, h, v, q) in zip(blocks, frame, strict=True):
        if q not in quant:
            raise ValueError("a JPEG without a quantization table")
        square = np.zeros(x.shape)
        square[..., ZIGZAG] = x * quant[q]
        square = square.reshape(*x.shape[:2], 8, 8)
        pixels = COSINES.T @ square @ COSINES
        plane = pixels.transpose(0, 2, 1, 3).reshape(8 * x.shape[0], 8 * x.shape[1]) + 128.0
        if len(frame) > 1:
            plane = plane.repeat(most_v // v, 0).repeat(most_h // h, 1)
        planes.append(np.clip(plane[:height, :width], 0, 255))
    if len(planes) == 1:
        rgb = [planes[0]] * 3
    else:
        y, cb, cr = planes[0], planes[1] - 128.0, planes[2] - 128.0
        rgb = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
    return np.ascontiguousarray(np.clip(np.rint(np.stack(rgb[::-1], 2)), 0, 255).astype(np.uint8))
