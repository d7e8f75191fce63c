"""Media bytes: structural validators, scores, decoders and encoders.

Every validator returns a dict with code, stage (6 when the whole structure holds, 1 when only the
container is known, 0 else) and the metadata it read; malformed input never raises.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.exprs import FORMAT_MAGIC
from .reading import Malformed, Window

# Limits.
MOST_CHUNK, MOST_INFLATED, MOST_PIXELS, MOST_RESOURCES = 128 << 20, 512 << 20, 256 << 20, 100_000


def sniff(head: bytes) -> str:
    for name, magic in FORMAT_MAGIC:
        if head.startswith(bytes.fromhex(magic)) and (name != "Wave" or head[8:12] == b"WAVE"):
            return name
    return "Unknown"


def _checked(read):
    """Turns a parser that raises ``Malformed`` into one that returns a failed result."""

    def run(data: bytes) -> dict:
        try:
            return read(data)
        except Malformed as e:
            return {"code": e.code, "stage": 0 if e.code.endswith(("SIGNATURE_MISMATCH", "RAW_MARKER_MISSING", "FILE_HEADER_TRUNCATED", "RIFF_HEADER_TRUNCATED")) else 1}

    run.__name__, run.__doc__ = read.__name__, read.__doc__
    return run


@_checked
def png(data: bytes) -> dict:
    """Chunk checksums and order, header values, and image data that inflates to exactly the scan lines."""
    if data[:8] != bytes.fromhex("89504E470D0A1A0A"):
        raise Malformed("PNG_SIGNATURE_MISMATCH")
    w, at, head, parts = Window(data, "PNG_CHUNK_HEADER_TRUNCATED"), 8, None, []
    while True:
        size, kind = struct.unpack(">I4s", w.take(at, 8))
        if size > MOST_CHUNK:
            raise Malformed("PNG_CHUNK_TOO_LARGE", at)
        body = w.take(at + 8, size + 4, "PNG_CHUNK_TRUNCATED")
        if zlib.crc32(kind + body[:-4]) != int.from_bytes(body[-4:], "big"):
            raise Malformed("PNG_CRC_MISMATCH", at)
        body, at = body[:-4], at + 12 + size
        if kind == b"IHDR":
            if head or size != 13:
                raise Malformed("PNG_IHDR_INVALID")
            head = struct.unpack(">IIBBBBB", body)
            _png_header(head)
        elif kind == b"IDAT":
            if not head:
                raise Malformed("PNG_IDAT_BEFORE_IHDR")
            parts.append(body)
        elif kind == b"IEND":
            if size:
                raise Malformed("PNG_IEND_INVALID")
            break
    if not head or not parts:
        raise Malformed("PNG_REQUIRED_CHUNK_MISSING")
    want = _png_size(head)
    engine = zlib.decompressobj()
    try:
        got = len(engine.decompress(b"".join(parts), min(want, MOST_INFLATED) + 1))
    except zlib.error:
        raise Malformed("PNG_IDAT_DECOMPRESSION_FAILED") from None
    if got != want or not engine.eof:
        raise Malformed("PNG_IDAT_DECOMPRESSION_FAILED")
    return {"code": "PNG_VALIDATED", "stage": 6, "width": head[0], "height": head[1]}


#: Bit depths of each colour type, and its channels.
_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _png_header(head: tuple) -> None:
    width, height, depth, colour, method, filtering, interlace = head
    if not (0 < width < 1 << 31 and 0 < height < 1 << 31) or depth not in _DEPTHS.get(colour, ()) or method or filtering or interlace > 1:
        raise Malformed("PNG_IHDR_VALUES_INVALID")


def _png_size(head: tuple) -> int:
    """Bytes of all scan lines; interlaced images have seven passes."""
    width, height, depth, colour, *_, interlace = head
    bits = depth * _CHANNELS[colour]
    passes = [(0, 0, 1, 1)] if not interlace else [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
    total = 0
    for x, y, dx, dy in passes:
        columns, rows = max(0, -(-(width - x) // dx)), max(0, -(-(height - y) // dy))
        if columns and rows:
            total += rows * (1 + -(-columns * bits // 8))
    if total > MOST_INFLATED:
        raise Malformed("PNG_IDAT_DECOMPRESSION_FAILED")
    return total


@_checked
def bmp(data: bytes) -> dict:
    """Headers, palette or masks, and pixel range; compressed images are identified only."""
    w = Window(data, "BMP_FILE_HEADER_TRUNCATED")
    head = w.take(0, 14)
    if head[:2] != b"BM":
        raise Malformed("BMP_SIGNATURE_MISMATCH")
    declared, _, start = struct.unpack("<III", head[2:])
    if declared > len(data):
        raise Malformed("BMP_DECLARED_LENGTH_INVALID")
    size = w.number("I", 14, "BMP_DIB_HEADER_TRUNCATED")
    if size < 40:
        raise Malformed("BMP_DIB_HEADER_UNSUPPORTED")
    if size > 4096:
        raise Malformed("BMP_DIB_HEADER_TOO_LARGE")
    w.take(14, size, "BMP_DIB_HEADER_TRUNCATED")
    width, height, planes, bits, compression = w.many("iiHHI", 18)
    colours = w.number("I", 46)
    if width <= 0 or not height or height == -(1 << 31) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32):
        raise Malformed("BMP_HEADER_VALUES_INVALID")
    allowed = {0: (1, 4, 8, 16, 24, 32), 1: (8,), 2: (4,), 3: (16, 32), 4: (24,), 5: (24, 32), 6: (16, 32)}
    if bits not in allowed.get(compression, ()):
        raise Malformed("BMP_COMPRESSION_INVALID")
    if not 14 + size <= start <= len(data):
        raise Malformed("BMP_PIXEL_OFFSET_INVALID")
    if bits <= 8 and colours > 1 << bits:
        raise Malformed("BMP_PALETTE_INVALID")
    extra = 4 * (colours or (1 << bits if bits <= 8 else 0))
    if compression in (3, 6) and size == 40:
        extra += 12 if compression == 3 else 16
    if 14 + size + extra > start:
        raise Malformed("BMP_PALETTE_OR_MASK_TRUNCATED")
    meta = {"width": width, "height": abs(height), "bits": bits, "top_down": height < 0, "pixels": start}
    if compression not in (0, 3, 6):
        return {"code": "BMP_COMPRESSED_CONTAINER_IDENTIFIED", "stage": 1} | meta
    stride = -(-width * bits // 32) * 4
    if stride * abs(height) > MOST_PIXELS:
        raise Malformed("BMP_PIXEL_DATA_TOO_LARGE")
    if start + stride * abs(height) > (declared or len(data)):
        raise Malformed("BMP_PIXEL_DATA_TRUNCATED")
    return {"code": "BMP_VALIDATED", "stage": 6, "stride": stride, "compression": compression} | meta


@_checked
def wave(data: bytes) -> dict:
    """Chunk bounds, consistent format values, data in whole frames; compressed sound is identified only."""
    w = Window(data, "WAVE_RIFF_HEADER_TRUNCATED")
    head = w.take(0, 12)
    if head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise Malformed("WAVE_SIGNATURE_MISMATCH")
    end = 8 + int.from_bytes(head[4:8], "little")
    if end > len(data):
        raise Malformed("WAVE_RIFF_LENGTH_INVALID")
    at, fmt, frames = 12, None, None
    while at < end:
        if end - at < 8:
            raise Malformed("WAVE_CHUNK_HEADER_TRUNCATED", at)
        kind, size = struct.unpack("<4sI", w.take(at, 8))
        if at + 8 + size > end:
            raise Malformed("WAVE_CHUNK_TRUNCATED", at)
        if kind == b"fmt ":
            if fmt or frames is not None or not 16 <= size <= 4096:
                raise Malformed("WAVE_FORMAT_CHUNK_INVALID", at)
            tag, channels, rate, per_second, frame, bits = w.many("HHIIHH", at + 8)
            if not (channels and rate and per_second and frame):
                raise Malformed("WAVE_FORMAT_VALUES_INVALID")
            if tag == 0xFFFE:
                if size < 40:
                    raise Malformed("WAVE_EXTENSIBLE_FORMAT_INVALID")
                tag = w.number("H", at + 32)
            plain = tag in (1, 3)
            if plain and (not bits or bits % 8 or frame != channels * bits // 8 or per_second != rate * frame):
                raise Malformed("WAVE_UNCOMPRESSED_METADATA_INVALID")
            fmt = (plain, frame)
        elif kind == b"data" and frames is None:
            if not fmt:
                raise Malformed("WAVE_DATA_BEFORE_FORMAT", at)
            frames = size
        at += 8 + size + size % 2
    if not fmt or frames is None:
        raise Malformed("WAVE_REQUIRED_CHUNK_MISSING")
    if not fmt[0]:
        return {"code": "WAVE_COMPRESSED_CONTAINER_IDENTIFIED", "stage": 1}
    if frames % fmt[1]:
        raise Malformed("WAVE_DATA_ALIGNMENT_INVALID")
    return {"code": "WAVE_UNCOMPRESSED_VALIDATED", "stage": 6}


@_checked
def jpeg(data: bytes) -> dict:
    """Marker framing, one frame, scans after it, and an end."""
    if data[:2] != b"\xff\xd8":
        raise Malformed("JPEG_SIGNATURE_MISMATCH")
    w, at, frame, scans = Window(data, "JPEG_END_MARKER_MISSING"), 2, None, 0
    while True:
        if w.take(at, 1) != b"\xff":
            raise Malformed("JPEG_DATA_INVALID", at)
        while w.take(at, 1) == b"\xff":
            at += 1
        kind = data[at]
        at += 1
        if kind == 0xD9:
            if not frame or not scans:
                raise Malformed("JPEG_REQUIRED_MARKER_MISSING")
            return {"code": "JPEG_VALIDATED", "stage": 6, "width": frame[2], "height": frame[1]}
        if kind in (0x00, 0x01, 0xD8) or 0xD0 <= kind <= 0xD7:
            raise Malformed("JPEG_MARKER_ORDER_INVALID", at)
        size = int.from_bytes(w.take(at, 2, "JPEG_SEGMENT_TRUNCATED"), "big")
        if size < 2:
            raise Malformed("JPEG_SEGMENT_TRUNCATED", at)
        body = w.take(at + 2, size - 2, "JPEG_SEGMENT_TRUNCATED")
        at += size
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            if frame or len(body) < 6:
                raise Malformed("JPEG_FRAME_MARKER_INVALID", at)
            frame = struct.unpack(">BHHB", body[:6])
            if frame[0] not in (8, 12, 16) or not frame[1] or not frame[2] or not 1 <= frame[3] <= 4 or len(body) != 6 + 3 * frame[3]:
                raise Malformed("JPEG_FRAME_VALUES_INVALID", at)
        elif kind == 0xDA:
            if not frame or not body or not 1 <= body[0] <= frame[3] or len(body) != 4 + 2 * body[0]:
                raise Malformed("JPEG_SCAN_MARKER_INVALID", at)
            scans += 1
            # Coded data: up to a marker that is neither a stuffed byte nor a restart.
            while True:
                at = data.find(b"\xff", at)
                if at < 0 or at + 1 >= len(data):
                    raise Malformed("JPEG_END_MARKER_MISSING")
                if data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7:
                    at += 2
                elif data[at + 1] == 0xFF:
                    at += 1
                else:
                    break


@_checked
def tlg(data: bytes) -> dict:
    """Version, channels and dimensions, behind an optional wrapper."""
    base = 15 if data.startswith(b"TLG0.0\x00sds\x1a") else 0
    mark = data[base : base + 11]
    if len(data) < base + 12 or mark[6:] != b"\x00raw\x1a":
        raise Malformed("TLG_RAW_MARKER_MISSING")
    version = {b"TLG5.0": 5, b"TLG6.0": 6}.get(mark[:6], 0)
    if not version:
        raise Malformed("TLG_VERSION_UNSUPPORTED")
    w, colours = Window(data, "TLG_METADATA_TRUNCATED"), data[base + 11]
    at = base + (15 if version == 6 else 12)
    width, height = w.many("II", at)
    if colours not in ((3, 4) if version == 5 else (1, 3, 4)):
        raise Malformed("TLG_COLOR_CHANNELS_INVALID")
    if version == 6 and any(data[base + 12 : base + 15]):
        raise Malformed("TLG6_RESERVED_BYTES_INVALID")
    if not (0 < width < 1 << 31 and 0 < height < 1 << 31):
        raise Malformed("TLG_DIMENSIONS_INVALID")
    return {"code": "TLG_METADATA_IDENTIFIED", "stage": 1, "version": version, "width": width, "height": height, "channels": colours, "data_offset": at + 8, "wrapped": bool(base)}


@_checked
def psb_header(data: bytes) -> dict:
    """Offsets of the tables, checked against the length and, from version 3, a checksum."""
    if data[:4] != b"PSB\0" or len(data) < 12:
        raise Malformed("PSB_SIGNATURE_MISMATCH")
    version = struct.unpack_from("<H", data, 4)[0]
    size = {1: 40, 2: 40, 3: 44, 4: 56}.get(version)
    if not size:
        raise Malformed("PSB_VERSION_UNSUPPORTED")
    if len(data) < size:
        raise Malformed("PSB_HEADER_TRUNCATED")
    length, names, texts, _, offsets, lengths, chunks, entries = struct.unpack_from("<8I", data, 8)
    out = {"version": version, "names": names, "offsets": offsets, "lengths": lengths, "chunks": chunks, "entries": entries}
    if length > 72 or not names or version > 1 and length not in (0, names, size):
        return {"code": "PSB_HEADER_MAY_BE_ENCRYPTED", "stage": 1} | out
    if max(names, texts, offsets, lengths, chunks, entries) >= len(data):
        raise Malformed("PSB_OFFSET_OUT_OF_RANGE")
    if version >= 3:
        check = zlib.adler32(data[8:40])
        if version == 4:
            check = zlib.adler32(data[44:56], check)
        if check != struct.unpack_from("<I", data, 40)[0]:
            raise Malformed("PSB_HEADER_CHECKSUM_MISMATCH")
    return {"code": "PSB_HEADER_IDENTIFIED", "stage": 1} | out


class _Psb(Window):
    def unsigned(self, at: int, n: int) -> int:
        return int.from_bytes(self.take(at, n), "little")

    def array(self, at: int) -> tuple[list[int], int]:
        """Numbers of a packed array, and where it ends."""
        count_bytes = self.unsigned(at, 1) - 0x0C
        if not 1 <= count_bytes <= 4:
            raise Malformed("PSB_STRUCTURE_INVALID", at)
        count, width = self.unsigned(at + 1, count_bytes), self.unsigned(at + 1 + count_bytes, 1) - 0x0C
        if not 1 <= width <= 4 or count > MOST_RESOURCES:
            raise Malformed("PSB_STRUCTURE_INVALID", at)
        start = at + 2 + count_bytes
        raw = self.take(start, count * width)
        return [int.from_bytes(raw[i : i + width], "little") for i in range(0, len(raw), width)], start + len(raw)

    def names(self, at: int) -> list[str]:
        """Names of the trie: each is read from its leaf up."""
        bases, at = self.array(at)
        parents, at = self.array(at)
        leaves, _ = self.array(at)
        out = []
        for leaf in leaves:
            letters, steps = bytearray(), 0
            while leaf:
                steps += 1
                if leaf >= len(parents) or steps > len(parents) + 1:
                    raise Malformed("PSB_STRUCTURE_INVALID")
                up = parents[leaf]
                if up >= len(bases) or not 0 <= leaf - bases[up] <= 255:
                    raise Malformed("PSB_STRUCTURE_INVALID")
                letters.append(leaf - bases[up])
                leaf = up
            out.append(bytes(reversed(letters)).decode("utf-8", "replace").rstrip("\0"))
        return out


def psb_resources(data: bytes) -> dict:
    """Root keys, whether they are those of a layered image, and direct resources (key, index, offset, length)."""
    head = psb_header(data)
    if head["code"] != "PSB_HEADER_IDENTIFIED" or not 2 <= head["version"] <= 4:
        return {"code": head["code"], "stage": head["stage"], "keys": [], "resources": [], "is_pimg": False}
    p = _Psb(data, "PSB_STRUCTURE_INVALID")
    try:
        names = p.names(head["names"])
        if p.unsigned(head["entries"], 1) != 0x21:
            raise Malformed("PSB_ROOT_NOT_DICTIONARY")
        indexes, at = p.array(head["entries"] + 1)
        places, base = p.array(at)
        if any(i >= len(names) for i in indexes) or len(places) != len(indexes):
            raise Malformed("PSB_ROOT_KEY_INDEX_INVALID")
        keys = [names[i] for i in indexes]
        offsets, _ = p.array(head["offsets"])
        lengths, _ = p.array(head["lengths"])
        if len(offsets) != len(lengths):
            raise Malformed("PSB_STRUCTURE_INVALID")
        found = []
        for position, (key, place) in enumerate(zip(keys, places, strict=True)):
            kind = p.unsigned(base + place, 1)
            if 0x19 <= kind <= 0x1C:
                i = p.unsigned(base + place + 1, kind - 0x18)
                if i >= len(offsets) or head["chunks"] + offsets[i] + lengths[i] > len(data):
                    raise Malformed("PSB_STRUCTURE_INVALID")
                found.append({"position": position, "name": key, "index": i, "offset": head["chunks"] + offsets[i], "length": lengths[i]})
    except Malformed as e:
        return {"code": e.code, "stage": 1, "keys": [], "resources": [], "is_pimg": False}
    pimg = {"layers", "width", "height"} <= set(keys)
    found.sort(key=lambda r: (r["index"], r["name"], r["position"]))
    return {"code": "PSB_PIMG_SIGNATURE_IDENTIFIED" if pimg else "PSB_ROOT_KEYS_IDENTIFIED", "stage": 1, "keys": keys, "resources": found, "is_pimg": pimg}


def score(data: bytes) -> dict:
    """Format, stage, score 0 to 100 and code: full validation 100, broken 20, headers 40 or 50, signatures 10."""
    kind = sniff(data[:32])
    full = {"Png": png, "Bmp": bmp, "Wave": wave, "Jpeg": jpeg}
    if kind in full:
        r = full[kind](data)
        return {"format": kind, "stage": r["stage"], "score": 100 if r["stage"] == 6 else 20, "code": r["code"]}
    if kind == "Tlg":
        r = tlg(data)
        return {"format": kind, "stage": r["stage"], "score": 40 if r["code"] == "TLG_METADATA_IDENTIFIED" else 0, "code": r["code"]}
    if kind == "Psb":
        r = psb_header(data)
        known = r["code"] in ("PSB_HEADER_IDENTIFIED", "PSB_HEADER_MAY_BE_ENCRYPTED")
        pimg = known and psb_resources(data)["is_pimg"]
        return {"format": kind, "stage": r["stage"], "score": (50 if pimg else 40) if known else 0, "code": r["code"]}
    named = {"Pimg": "PIMG_FORMAT_IDENTIFIED", "Ogg": "OGG_FORMAT_IDENTIFIED", "MpegProgramStream": "MPEG_PROGRAM_STREAM_IDENTIFIED", "OpenTypeFont": "OPENTYPE_FONT_IDENTIFIED"}
    if kind in named:
        return {"format": kind, "stage": 1, "score": 10, "code": named[kind]}
    return {"format": kind, "stage": 0, "score": 0, "code": "RESOURCE_FORMAT_UNRECOGNIZED"}


# --- decoding and encoding --------------------------------------------------------------------------


def decode_bmp(data: bytes) -> np.ndarray:
    """Pixels, rows from the top, red green blue alpha, of a plain 24 or 32 bit image."""
    head = bmp(data)
    if head["stage"] != 6 or head["bits"] not in (24, 32) or head["compression"]:
        raise Malformed("BMP_DECODE_UNSUPPORTED")
    rows = np.frombuffer(data, np.uint8, head["stride"] * head["height"], head["pixels"]).reshape(head["height"], head["stride"])
    n = head["bits"] // 8
    pixels = rows[:, : head["width"] * n].reshape(head["height"], head["width"], n)
    out = np.full((head["height"], head["width"], 4), 255, np.uint8)
    out[..., :3] = pixels[..., 2::-1]
    if n == 4 and pixels[..., 3].any():
        out[..., 3] = pixels[..., 3]
    return out if head["top_down"] else out[::-1]


def decode_tlg5(data: bytes) -> np.ndarray:
    """Pixels, red green blue alpha: planes packed against a ring of 4096 bytes that carries over, then differences."""
    head = tlg(data)
    if head.get("version") != 5:
        raise Malformed("TLG5_DECODE_UNSUPPORTED")
    width, height, channels = head["width"], head["height"], head["channels"]
    if width * height * 4 > MOST_PIXELS:
        raise Malformed("TLG5_TOO_LARGE")
    w = Window(data, "TLG5_DATA_TRUNCATED")
    block = w.number("I", head["data_offset"])
    if not block:
        raise Malformed("TLG5_BLOCK_HEIGHT_INVALID")
    at = head["data_offset"] + 4 + 4 * -(-height // block)
    out = np.zeros((height, width, 4), np.uint8)
    out[..., 3] = 255
    ring, place = bytearray(4096), 0
    above = np.zeros((width, channels), np.uint8)
    for top in range(0, height, block):
        rows = min(block, height - top)
        planes = []
        for _ in range(channels):
            flag, size = w.many("BI", at)
            raw = w.take(at + 5, size)
            at += 5 + size
            if flag == 0:
                raw, place = _unpack(raw, rows * width, ring, place)
            if len(raw) != rows * width:
                raise Malformed("TLG5_PLANE_LENGTH_INVALID")
            planes.append(np.frombuffer(raw, np.uint8).reshape(rows, width))
        for y in range(rows):
            row = np.stack([p[y] for p in planes], 1).copy()  # blue, green, red, then alpha
            row[:, 0] += row[:, 1]
            row[:, 2] += row[:, 1]
            above = np.cumsum(row, 0, dtype=np.uint8) + above
            out[top + y, :, :3] = above[:, 2::-1]
            if channels == 4:
                out[top + y, :, 3] = above[:, 3]
    return out


def _unpack(raw: bytes, want: int, ring: bytearray, place: int) -> tuple[bytes, int]:
    out, i, flags = bytearray(), 0, 0
    try:
        while len(out) < want:
            flags >>= 1
            if not flags & 0x100:
                flags, i = raw[i] | 0xFF00, i + 1
            if flags & 1:
                word = raw[i] | raw[i + 1] << 8
                i, start, n = i + 2, word & 0xFFF, word >> 12
                n += 3
                if n == 18:
                    n, i = n + raw[i], i + 1
                run = bytearray()
                for k in range(n):
                    b = ring[(start + k) & 0xFFF]
                    run.append(b)
                    ring[place] = b
                    place = (place + 1) & 0xFFF
                out += run
            else:
                out.append(raw[i])
                ring[place] = raw[i]
                place, i = (place + 1) & 0xFFF, i + 1
    except IndexError:
        raise Malformed("TLG5_DATA_TRUNCATED") from None
    return bytes(out), place


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG of red green blue alpha pixels, every line with filter 0."""
    height, width, _ = pixels.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], 1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return bytes.fromhex("89504E470D0A1A0A") + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def to_png(data: bytes) -> bytes:
    """A BMP or TLG5 image as PNG, validated again."""
    pixels = decode_bmp(data) if data[:2] == b"BM" else decode_tlg5(data)
    out = encode_png(pixels)
    if png(out)["stage"] != 6:
        raise Malformed("PNG_ENCODE_FAILED")
    return out


def looks_like_script(head: bytes) -> bool:
    """A byte order mark, the mark of coded scripts, or at least nine tenths printable of 32 bytes or more."""
    if head.startswith((b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff", b"\xfe\xfe\x01")):
        return True
    good = sum(32 <= b < 127 or b in (9, 10, 13) for b in head)
    return len(head) >= 32 and 10 * good >= 9 * len(head)


SCORED = pa.schema([("path", pa.string()), ("format", pa.string()), ("stage", pa.int32()), ("score", pa.int32()), ("code", pa.string())])


def scored(files: DataFrame) -> DataFrame:
    """Scores of the files of a frame (path, content)."""

    def run(batches):
        for batch in batches:
            rows = [{"path": p} | score(c or b"") for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=SCORED)

    return files.select("path", "content").mapInArrow(run, "path string, format string, stage int, score int, code string")
