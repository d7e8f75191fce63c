"""Bounded reads of untrusted bytes, and the diagnostics that parsers return instead of raising."""

from __future__ import annotations

import struct

DIAGNOSTICS = "array<struct<code:string,severity:string,message:string,offset:long>>"


def diagnostic(code: str, severity: str = "Error", message: str = "", offset: int | None = None) -> dict:
    return {"code": code, "severity": severity, "message": message, "offset": offset}


class Malformed(Exception):
    """Input that a parser can't go on with; becomes one diagnostic."""

    def __init__(self, code: str, offset: int | None = None) -> None:
        super().__init__(code)
        self.code, self.offset = code, offset


class Window:
    """Numbers and slices of a byte string, with an error code for what lies beyond its end."""

    def __init__(self, data: bytes, code: str) -> None:
        self.data, self.code = data, code

    def take(self, at: int, n: int, code: str | None = None) -> bytes:
        if at < 0 or n < 0 or at + n > len(self.data):
            raise Malformed(code or self.code, at)
        return self.data[at : at + n]

    def number(self, form: str, at: int, code: str | None = None) -> int:
        return struct.unpack("<" + form, self.take(at, struct.calcsize("<" + form), code))[0]

    def many(self, form: str, at: int, code: str | None = None) -> tuple:
        return struct.unpack("<" + form, self.take(at, struct.calcsize("<" + form), code))
