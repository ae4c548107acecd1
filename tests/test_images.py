"""Image formats against files written here, with every kind of row filter and pixel."""

import struct
import zlib

import numpy as np
import pytest

from lumenframe.sources import images, jpeg


def paeth(a, b, c):
    p = a + b - c
    return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]


def filtered(rows, lag, kinds):
    """Rows of bytes as PNG stores them, with the filters taken in turn."""
    out, above = b"", bytes(len(rows[0]))
    for y, row in enumerate(rows):
        kind = kinds[y % len(kinds)]
        left = bytes(lag) + row[:-lag]
        corner = bytes(lag) + above[:-lag]
        guess = {0: lambda a, b, c: 0, 1: lambda a, b, c: a, 2: lambda a, b, c: b, 3: lambda a, b, c: (a + b) // 2, 4: paeth}[kind]
        out += bytes([kind]) + bytes((v - guess(a, b, c)) % 256 for v, a, b, c in zip(row, left, above, corner))
        above = row
    return out


def bits(samples, depth):
    """Samples (rows x values) packed into bytes."""
    if depth == 16:
        return [b"".join(struct.pack(">H", int(v) * 257) for v in r) for r in samples]
    if depth == 8:
        return [bytes(r.astype(np.uint8)) for r in samples]
    return [np.packbits((r[:, None] >> np.arange(depth)[::-1] & 1).astype(np.uint8).ravel()).tobytes() for r in samples]


def png(samples, color, depth, *, interlace=False, kinds=(0, 1, 2, 3, 4), palette=None):
    """height x width x channels samples as a PNG file."""
    h, w, channels = samples.shape
    lag = max(1, channels * depth // 8)
    raw = b""
    for x, y, dx, dy in images.PASSES if interlace else [(0, 0, 1, 1)]:
        part = samples[y::dy, x::dx]
        if part.size:
            raw += filtered(bits(part.reshape(len(part), -1), depth), lag, kinds)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    plte = chunk(b"PLTE", palette.tobytes()) if palette is not None else b""
    packed = zlib.compress(raw)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, interlace)) + plte + chunk(b"IDAT", packed[:9]) + chunk(b"IDAT", packed[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlace", [False, True])
@pytest.mark.parametrize("kinds", [(0,), (1,), (2,), (3,), (4,), (0, 1, 2, 3, 4)])
def test_png_filters(kinds, interlace):
    px = np.random.default_rng(1).integers(0, 256, (13, 11, 3))
    assert (images.decode_png(png(px, 2, 8, kinds=kinds, interlace=interlace)) == px[:, :, ::-1]).all()


@pytest.mark.parametrize("color,channels,depth", [(0, 1, 1), (0, 1, 2), (0, 1, 4), (0, 1, 8), (0, 1, 16), (2, 3, 16), (4, 2, 8), (4, 2, 16), (6, 4, 8), (6, 4, 16)])
def test_png_kinds_of_pixels(color, channels, depth):
    px = np.random.default_rng(2).integers(0, 1 << min(depth, 8), (9, 10, channels))
    want = px[:, :, 2::-1] if channels > 2 else np.repeat(px[:, :, :1] * (255 // ((1 << min(depth, 8)) - 1)), 3, 2)
    for interlace in (False, True):
        assert (images.decode_png(png(px, color, depth, interlace=interlace)) == want).all()


@pytest.mark.parametrize("depth", [1, 2, 4, 8])
def test_png_palettes(depth):
    rng = np.random.default_rng(3)
    palette = rng.integers(0, 256, (1 << min(depth, 5), 3), dtype=np.uint8)
    px = rng.integers(0, len(palette), (7, 9, 1))
    assert (images.decode_png(png(px, 3, depth, palette=palette)) == palette[px[:, :, 0]][:, :, ::-1]).all()


def test_bad_files_are_rows_with_errors(spark):
    px = np.full((4, 4, 1), 9)
    good = png(np.full((4, 4, 3), 7), 2, 8)
    bad = [png(px, 3, 8, palette=np.zeros((3, 3), np.uint8)), png(px, 3, 8), good[:-30], b"\x89PNG\r\n\x1a\n", b"BM", b"P6 2 2 255\n", b"\xff\xd8\xff\xda", b"", good.replace(b"IHDR", b"IHDS")]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate([good, *bad])], "i int, content binary")
    got = {r.i: r for r in images.decode_images(rows).collect()}
    assert got[0].error is None and all(got[i].height == -1 and got[i].error.startswith("kParameterError") for i in range(1, len(bad) + 1))


def test_a_decoder_of_ones_own(spark):
    rows = spark.createDataFrame([(1, b"ab")], "i int, content binary")
    r = images.decode_images(rows, decoder=lambda b: np.full((len(b), 1, 3), b[0], np.uint8)).first()
    assert (r.height, r.width, bytes(r.data)) == (2, 1, b"a" * 6)


def test_bmp():
    px = np.random.default_rng(4).integers(0, 256, (5, 7, 3), dtype=np.uint8)
    for bits_, flip in ((24, False), (32, False), (24, True)):
        wide = px if bits_ == 24 else np.dstack([px, np.zeros((5, 7), np.uint8)])
        rows = [r.tobytes().ljust(-(-7 * bits_ // 32) * 4, b"\0") for r in wide]
        body = b"".join(rows if flip else rows[::-1])
        blob = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(body), 0, 0, 54, 40, 7, -5 if flip else 5, 1, bits_, 0, len(body), 0, 0, 0, 0) + body
        assert (images.decode_image(blob) == px).all()


def jpeg_file(planes, sampling, width, height, interval=0):
    """A baseline JPEG of sample planes, with a quantization of one and codes of equal length for all values."""
    order = jpeg.ZIGZAG
    codes = {v: v for v in range(255)}  # 8 bits; the code of ones alone is not allowed
    table = bytes([0] * 7 + [255] + [0] * 8) + bytes(range(255))
    out = []

    def signed(v):
        n = int(abs(v)).bit_length()
        return n, (v if v > 0 else v + (1 << n) - 1, n)

    most_h, most_v = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    last, parts = [0] * len(planes), []
    for unit in range(across * down):
        if interval and unit and unit % interval == 0:
            parts.append(out)
            out, last = [], [0] * len(planes)
        for c, (plane, (h, v)) in enumerate(zip(planes, sampling)):
            for b in range(h * v):
                y, x = (unit // across * v + b // h) * 8, (unit % across * h + b % h) * 8
                block = np.pad(plane, ((0, max(0, y + 8 - plane.shape[0])), (0, max(0, x + 8 - plane.shape[1]))), mode="edge")[y : y + 8, x : x + 8]
                coded = np.rint(jpeg.COSINES @ (block - 128.0) @ jpeg.COSINES.T).astype(int).ravel()[order]
                n, value = signed(int(coded[0]) - last[c])
                last[c] = int(coded[0])
                out += [(codes[n], 8), value]
                run = 0
                for k in range(1, 64):
                    if not coded[k]:
                        run += 1
                        continue
                    while run > 15:
                        out.append((codes[0xF0], 8))
                        run -= 16
                    n, value = signed(int(coded[k]))
                    out += [(codes[run << 4 | n], 8), value]
                    run = 0
                if run:
                    out.append((codes[0], 8))
    parts.append(out)
    data = []
    for p in parts:
        text = "".join(f"{v:0{n}b}" for v, n in p if n)
        text += "1" * (-len(text) % 8)
        data.append(int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00"))
    scan = b"".join(d + (bytes([0xFF, 0xD0 + i % 8]) if i + 1 < len(data) else b"") for i, d in enumerate(data))
    seg = lambda m, body: bytes([0xFF, m]) + struct.pack(">H", len(body) + 2) + body
    n = len(planes)
    frame = struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([i + 1, sampling[i][0] << 4 | sampling[i][1], 0]) for i in range(n))
    head = seg(0xE0, b"JFIF\0") + seg(0xDB, b"\0" + bytes([1] * 64)) + seg(0xC4, b"\x00" + table) + seg(0xC4, b"\x10" + table)
    head += seg(0xC0, frame) + (seg(0xDD, struct.pack(">H", interval)) if interval else b"")
    return b"\xff\xd8" + head + seg(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + b"\0\x3f\0") + scan + b"\xff\xd9"


def smooth(h, w, phase):
    y, x = np.mgrid[0:h, 0:w]
    return 128 + 90 * np.sin(x / 7 + phase) * np.cos(y / 9 - phase)


@pytest.mark.parametrize("interval", [0, 2])
@pytest.mark.parametrize("h,w", [(16, 16), (19, 21), (40, 9)])
def test_jpeg(h, w, interval):
    grey = smooth(h, w, 0.3)
    got = images.decode_image(jpeg_file([grey], [(1, 1)], w, h, interval))
    assert got.shape == (h, w, 3) and np.abs(got.astype(float) - grey[:, :, None]).max() <= 2
    y, cb, cr = smooth(h, w, 0.1), smooth(h, w, 1.0) / 4 + 96, smooth(h, w, 2.0) / 4 + 96
    rgb = np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], 2).clip(0, 255)
    got = images.decode_image(jpeg_file([y, cb, cr], [(1, 1)] * 3, w, h, interval))
    assert np.abs(got[:, :, ::-1].astype(float) - rgb).max() <= 4
    half = lambda p: np.pad(p, ((0, h % 2), (0, w % 2)), mode="edge").reshape(-(-h // 2), 2, -(-w // 2), 2).mean((1, 3))
    got = images.decode_image(jpeg_file([y, half(cb), half(cr)], [(2, 2), (1, 1), (1, 1)], w, h, interval))
    assert np.abs(got[:, :, ::-1].astype(float) - rgb).mean() <= 3


def test_zigzag():
    assert jpeg.ZIGZAG[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.ZIGZAG) == list(range(64)) and jpeg.ZIGZAG[-3:] == [55, 62, 63]
