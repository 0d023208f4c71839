"""Directories and blocks of TIFF files: classic and big, in strips or tiles, plain, LZW or deflated, one band."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

#: Tags by name, types by number with their size and format, compressions by number; fixed values of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SAMPLE_FORMAT, PIXEL_SCALE, TIE_POINT, GEO_KEYS, NODATA = 317, 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
CODECS = {1: "none", 5: "lzw", 8: "deflate", 32946: "deflate"}
CLEAR, END, FIRST, WIDEST = 256, 257, 258, 12
#: Sample kinds: numpy kind by number.
KINDS = {1: "u", 2: "i", 3: "f"}


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; the width grows one code early, as TIFF has it."""
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    out, before, width, held, bits = [], b"", 9, 0, 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == CLEAR:
            del table[FIRST:]
            before, width = b"", 9
            continue
        if code == END:
            break
        if before:
            if code < len(table):
                now = table[code]
            elif code == len(table):
                now = before + before[:1]
            else:
                raise ValueError("not an LZW stream")
            table.append(before + now[:1])
            if len(table) >= (1 << width) - 1 and width < WIDEST:
                width += 1
        else:
            now = table[code]
        out.append(now)
        before = now
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    table = {bytes([i]): i for i in range(256)}
    out, held, bits, width, free = bytearray(), 0, 0, 9, FIRST

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    def grow() -> bool:
        """After a code; whether the table is full."""
        nonlocal width, free
        free += 1
        if free == (1 << WIDEST) - 2:
            put(CLEAR)
            width, free = 9, FIRST
            return True
        if free >= 1 << width:
            width += 1
        return False

    put(CLEAR)
    run = b""
    for i in range(len(data)):
        longer = run + data[i : i + 1]
        if longer in table:
            run = longer
            continue
        put(table[run])
        table[longer] = free
        if grow():
            table = {bytes([i]): i for i in range(256)}
        run = data[i : i + 1]
    if run:
        put(table[run])
        grow()
    put(END)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def unpack(data: bytes, codec: str) -> bytes:
    return lzw_decode(data) if codec == "lzw" else zlib.decompress(data) if codec == "deflate" else data


def pack(data: bytes, codec: str) -> bytes:
    return lzw_encode(data) if codec == "lzw" else zlib.compress(data) if codec == "deflate" else data


@dataclass
class Directory:
    """What a file's first directory says, and how to find its blocks."""

    width: int
    height: int
    dtype: str
    codec: str
    block_width: int
    block_height: int
    offsets: list[int] = field(repr=False)
    sizes: list[int] = field(repr=False)
    predictor: int = 1
    west: float = 0.0
    north: float = 0.0
    size_x: float = 1.0
    size_y: float = 1.0
    nodata: float | None = None
    epsg: int | None = None

    @property
    def across(self) -> int:
        return -(-self.width // self.block_width)

    def place(self, block: int) -> tuple[int, int]:
        """First row and column of a block."""
        return block // self.across * self.block_height, block % self.across * self.block_width

    def blocks(self, r0: int, r1: int, c0: int, c1: int) -> list[int]:
        """Blocks that meet a window (bounds included)."""
        down = -(-self.height // self.block_height)
        rows = range(max(r0 // self.block_height, 0), min(r1 // self.block_height, down - 1) + 1)
        columns = range(max(c0 // self.block_width, 0), min(c1 // self.block_width, self.across - 1) + 1)
        return [i * self.across + j for i in rows for j in columns]

    def values(self, block: int, data: bytes) -> np.ndarray:
        """A block's cells, cut at the raster's edge."""
        kind = np.dtype(self.dtype)
        r, c = self.place(block)
        if not data:
            # A block that was never written holds no data.
            a = np.full((self.block_height, self.block_width), np.nan if self.nodata is None else self.nodata, kind)
        else:
            raw = unpack(data, self.codec)
            a = np.frombuffer(raw, kind, count=len(raw) // kind.itemsize // self.block_width * self.block_width).reshape(-1, self.block_width)
            if self.predictor == 2:
                a = np.cumsum(a, axis=1, dtype=kind)
        return a[: self.height - r, : self.width - c]


def read_directory(f) -> Directory:
    """The first directory of an open file (seek and read); only the directory is read."""

    def at(offset: int, n: int) -> bytes:
        f.seek(offset)
        return f.read(n)

    head = at(0, 16)
    e = {b"II": "<", b"MM": ">"}.get(head[:2])
    if e is None or struct.unpack(e + "H", head[2:4])[0] not in (42, 43):
        raise ValueError("not a TIFF file")
    big = struct.unpack(e + "H", head[2:4])[0] == 43
    start = struct.unpack(e + "Q", head[8:16])[0] if big else struct.unpack(e + "I", head[4:8])[0]
    n = struct.unpack(e + ("Q" if big else "H"), at(start, 8 if big else 2))[0]
    width, inline = (20, 8) if big else (12, 4)
    rows, tags = at(start + (8 if big else 2), n * width), {}
    for i in range(n):
        tag, kind = struct.unpack(e + "HH", rows[i * width : i * width + 4])
        count = struct.unpack(e + ("Q" if big else "I"), rows[i * width + 4 : i * width + width - inline])[0]
        if kind not in TYPES:
            continue
        size, code = TYPES[kind]
        own = rows[i * width + width - inline : (i + 1) * width]
        if size * count > inline:
            own = at(struct.unpack(e + ("Q" if big else "I"), own)[0], size * count)
        tags[tag] = own[:count].split(b"\0")[0].decode("latin-1") if code == "c" else struct.unpack(f"{e}{count}{code}", own[: size * count])
    one = lambda tag, other=None: tags[tag][0] if tag in tags else other
    if one(SAMPLES, 1) != 1 or one(COMPRESSION, 1) not in CODECS or one(PREDICTOR, 1) not in (1, 2):
        raise ValueError("bands, compression or predictor of this file are not supported")
    tiled = TILES in tags
    keys = tags.get(GEO_KEYS, ())
    epsg = next((keys[i + 3] for k in (3072, 2048) for i in range(4, len(keys) - 3, 4) if keys[i] == k), None)
    scale, tie = tags.get(PIXEL_SCALE, (1.0, 1.0, 0.0)), tags.get(TIE_POINT, (0.0,) * 6)
    return Directory(
        width=one(WIDTH), height=one(HEIGHT), dtype=f"{e}{KINDS[one(SAMPLE_FORMAT, 1)]}{one(BITS, 1) // 8}", codec=CODECS[one(COMPRESSION, 1)], predictor=one(PREDICTOR, 1),
        block_width=one(TILE_WIDTH) if tiled else one(WIDTH), block_height=one(TILE_HEIGHT) if tiled else min(one(STRIP_ROWS, one(HEIGHT)), one(HEIGHT)),
        offsets=list(tags[TILES if tiled else STRIPS]), sizes=list(tags[TILE_BYTES if tiled else STRIP_BYTES]),
        west=tie[3] - tie[0] * scale[0], north=tie[4] + tie[1] * scale[1], size_x=scale[0], size_y=scale[1],
        nodata=float(tags[NODATA]) if NODATA in tags else None, epsg=epsg,
    )


def write_raster(f, a: np.ndarray, block: int, codec: str, west: float, north: float, size: float, nodata: float | None, epsg: int | None = 4326) -> None:
    """One band as a big TIFF in square tiles of `block` cells, a multiple of 16; cells beyond the edge hold no data."""
    a = a.astype(a.dtype.newbyteorder("<"))
    height, width = a.shape
    down, across = -(-height // block), -(-width // block)
    whole = np.full((down * block, across * block), 0 if nodata is None else nodata, a.dtype)
    whole[:height, :width] = a
    offsets, sizes, at = [], [], 16
    f.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0))
    for i in range(down):
        for j in range(across):
            data = pack(np.ascontiguousarray(whole[i * block : (i + 1) * block, j * block : (j + 1) * block]).tobytes(), codec)
            offsets.append(at)
            sizes.append(len(data))
            at += f.write(data)
    number = {v: k for k, v in reversed(CODECS.items())}
    kind = {v: k for k, v in KINDS.items()}[a.dtype.kind]
    tags = {WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [a.dtype.itemsize * 8]), COMPRESSION: (3, [number[codec]]), PHOTOMETRIC: (3, [1]), SAMPLES: (3, [1]), PLANAR: (3, [1]), TILE_WIDTH: (4, [block]), TILE_HEIGHT: (4, [block])}
    tags |= {TILES: (16, offsets), TILE_BYTES: (16, sizes), SAMPLE_FORMAT: (3, [kind]), PIXEL_SCALE: (12, [size, size, 0.0]), TIE_POINT: (12, [0.0, 0.0, 0.0, west, north, 0.0])}
    if epsg:
        # Model (2 geographic, 1 projected), cells as areas, and the system's number.
        tags[GEO_KEYS] = (3, [1, 1, 0, 3, 1024, 0, 1, 2 if 4000 <= epsg < 5000 else 1, 1025, 0, 1, 1, 2048 if 4000 <= epsg < 5000 else 3072, 0, 1, epsg])
    if nodata is not None:
        tags[NODATA] = (2, [c.encode() for c in f"{nodata:.17g}"] + [b"\0"])
    rows, rest = b"", b""
    after = at + 8 + 20 * len(tags) + 8
    for tag, (code, values) in sorted(tags.items()):
        own = struct.pack(f"<{len(values)}{TYPES[code][1]}", *values)
        if len(own) > 8:
            rows += struct.pack("<HHQQ", tag, code, len(values), after + len(rest))
            rest += own
        else:
            rows += struct.pack("<HHQ", tag, code, len(values)) + own.ljust(8, b"\0")
    f.write(struct.pack("<Q", len(tags)) + rows + struct.pack("<Q", 0) + rest)
    f.seek(8)
    f.write(struct.pack("<Q", at))
