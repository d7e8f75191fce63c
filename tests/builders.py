"""Small inputs built in code: archives, images, sounds, executables."""

from __future__ import annotations

import struct
import zlib

from silvane.sources import archives


def chunk(tag: bytes, data: bytes) -> bytes:
    return tag + struct.pack("<q", len(data)) + data


def info(name: str, size: int, packed: int, marked: bool = False, nul: bool = False) -> bytes:
    raw = name.encode("utf-16-le")
    return struct.pack("<Iqqh", 0x80000000 if marked else 0, size, packed, len(raw) // 2) + raw + b"\0\0" * nul


def archive(entries: list[dict], compressed: bool = False, extra: bytes = b"") -> bytes:
    """entries: name, segments (data, zlib?), marked, adler (None: none)."""
    body, index = bytearray(archives.SIGNATURE + bytes(8)), bytearray()
    for e in entries:
        segm, total, packed = b"", 0, 0
        for data, z in e["segments"]:
            raw = zlib.compress(data) if z else data
            segm += struct.pack("<Iqqq", int(z), len(body), e.get("claims", len(data)), len(raw))
            body += raw
            total, packed = total + len(data), packed + len(raw)
        parts = chunk(b"info", info(e["name"], total, packed, e.get("marked", False), e.get("nul", False))) + chunk(b"segm", segm)
        if e.get("adler") is not None:
            parts += chunk(b"adlr", struct.pack("<I", e["adler"]))
        index += chunk(b"File", parts)
    index += extra
    at = len(body)
    body += (b"\x01" + struct.pack("<qq", len(z := zlib.compress(bytes(index))), len(index)) + z) if compressed else b"\0" + struct.pack("<q", len(index)) + bytes(index)
    body[11:19] = struct.pack("<q", at)
    return bytes(body)


def png(width: int = 1, height: int = 1) -> bytes:
    c = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    lines = (b"\0" + bytes(4 * width)) * height
    return bytes.fromhex("89504E470D0A1A0A") + c(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + c(b"IDAT", zlib.compress(lines)) + c(b"IEND", b"")


def bmp(bits: int = 24, compression: int = 0) -> bytes:
    pixels = bytes([1, 2, 3, 0]) * 2
    return b"BM" + struct.pack("<IHHI", 54 + len(pixels), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, 2, 1, bits, compression, len(pixels), 0, 0, 0, 0) + pixels


def wave(tag: int = 1, rate_bytes: int = 44100) -> bytes:
    fmt = struct.pack("<HHIIHH", tag, 1, 22050, rate_bytes, 2, 16)
    body = b"WAVE" + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", 4) + bytes(4)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def jpeg() -> bytes:
    frame = b"\xff\xc0" + struct.pack(">H", 11) + struct.pack(">BHHB", 8, 2, 3, 1) + b"\x01\x11\x00"
    scan = b"\xff\xda" + struct.pack(">H", 8) + b"\x01\x01\x00\x00\x3f\x00" + b"\x12\xff\x00\x34"
    return b"\xff\xd8" + frame + scan + b"\xff\xd9"


def executable(imports: list[str], payload: bytes = b"") -> bytes:
    """A 32-bit image with one section that holds an import table."""
    section_at, raw_at = 0x1000, 0x200
    names, table = b"", b""
    base = 20 * (len(imports) + 1)
    for name in imports:
        table += struct.pack("<IIIII", 0, 0, 0, section_at + base + len(names), 0)
        names += name.encode() + b"\0"
    body = table + bytes(20) + names + payload
    optional = bytearray(224)
    struct.pack_into("<H", optional, 0, 0x10B)
    struct.pack_into("<I", optional, 60, raw_at)
    struct.pack_into("<II", optional, 96 + 8, section_at, len(body))
    head = bytearray(0x40)
    head[:2] = b"MZ"
    struct.pack_into("<I", head, 0x3C, 0x40)
    coff = b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, 1, 0, 0, 0, 224, 0)
    section = b".text\0\0\0" + struct.pack("<IIIIIIHHI", len(body), section_at, len(body), raw_at, 0, 0, 0, 0, 0x60000020)
    out = bytes(head) + coff + bytes(optional) + section
    return out + bytes(raw_at - len(out)) + body
