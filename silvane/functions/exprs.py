"""Column expressions: all run inside whole-stage code generation, none calls Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of each category.
CATEGORY_EXTENSIONS = {
    "Images": (".png", ".jpg", ".jpeg", ".bmp", ".tlg", ".tlg5", ".tlg6", ".psb", ".pimg", ".mdf", ".mzs"),
    "Audio": (".ogg", ".wav", ".mp3", ".amv", ".mpg"),
    "Scripts": (".tjs", ".ks", ".kag", ".scn", ".txt"),
}
# Leading bytes (hex) of each format, in the order in which they are tried.
FORMAT_MAGIC = (
    ("Png", "89504E470D0A1A0A"),
    ("Tlg", "544C47"),
    ("Psb", "50534200"),
    ("Pimg", "50494D47"),
    ("Ogg", "4F676753"),
    ("Wave", "52494646"),
    ("Jpeg", "FFD8FF"),
    ("Bmp", "424D"),
    ("MpegProgramStream", "000001BA"),
    ("OpenTypeFont", "4F54544F"),
    ("OpenTypeFont", "00010000"),
)
# Category and usual extension of each format.
FORMAT_CATEGORY = {"Png": "Images", "Jpeg": "Images", "Bmp": "Images", "Tlg": "Images", "Psb": "Images", "Pimg": "Images", "Ogg": "Audio", "Wave": "Audio"}
FORMAT_EXTENSION = {"Png": ".png", "Tlg": ".tlg", "Psb": ".psb", "Pimg": ".pimg", "Ogg": ".ogg", "Wave": ".wav", "Jpeg": ".jpg", "Bmp": ".bmp"}
# Evidence stages in order, and machine codes of executables.
STAGES = ("Unidentified", "ContainerIdentified", "IndexParsed", "EntryLocated", "RawDataExtracted", "ContentFilterApplied", "FormatValidated", "ContentUsable")
FORMAT_VALIDATED = 6
MACHINES = {0x014C: "x86", 0x8664: "x64", 0x01C0: "ARM", 0xAA64: "ARM64"}
# Fixed value: largest signed 64-bit number, at which sums saturate.
MOST = 9223372036854775807


def extension(name: Column) -> Column:
    """Lower-case extension with its dot; null without one, or with a dot at the very end."""
    return F.nullif(F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1)), F.lit(""))


def extension_or_none(name: Column) -> Column:
    return F.coalesce(extension(name), F.lit("(none)"))


def category(name: Column) -> Column:
    ext = extension(name)
    out = F.when(F.lit(False), F.lit(""))
    for kind, known in CATEGORY_EXTENSIONS.items():
        out = out.when(ext.isin(*known), F.lit(kind))
    return out.otherwise("Other")


def matches_category(name: Column, wanted: str) -> Column:
    return F.lit(True) if wanted == "All" else category(name) == wanted


def sniff(content: Column) -> Column:
    """Format by leading bytes; a RIFF file must also say WAVE at byte 8."""
    out = F.when(F.lit(False), F.lit(""))
    for name, magic in FORMAT_MAGIC:
        test = F.startswith(content, F.unhex(F.lit(magic)))
        if name == "Wave":
            test = test & (F.substring(content, 9, 4) == F.unhex(F.lit("57415645")))
        out = out.when(test, F.lit(name))
    return out.otherwise("Unknown")


def _lookup(value: Column, known: dict) -> Column:
    return reduce(lambda out, kv: out.when(value == kv[0], F.lit(kv[1])), known.items(), F.when(F.lit(False), F.lit("")))


def format_category(fmt: Column) -> Column:
    return _lookup(fmt, FORMAT_CATEGORY)


def format_extension(fmt: Column) -> Column:
    return _lookup(fmt, FORMAT_EXTENSION)


def machine_name(code: Column) -> Column:
    return F.coalesce(_lookup(code, MACHINES), F.format_string("unknown-0x%04X", code.cast("int")))


def stage_rank(name: Column) -> Column:
    return _lookup(name, {s: i for i, s in enumerate(STAGES)}).cast("int")


def accepted(stage: Column) -> Column:
    return stage >= FORMAT_VALIDATED


def safe_relative_path(path: Column) -> Column:
    """A path inside a package: not blank or rooted, no backslash, no empty, '.' or '..' segment."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: (p == "") | (p == ".") | (p == ".."))
    return F.coalesce((F.trim(path) != "") & ~F.contains(path, F.lit("\\")) & ~path.rlike(r"^([A-Za-z]:|/)") & ~bad, F.lit(False))


def normalised(path: Column) -> Column:
    """Forward slashes only."""
    return F.translate(path, "\\", "/")


def contained(path: Column) -> Column:
    """Whether a relative path, '..' resolved, stays below its root: no prefix climbs above it."""
    parts = F.filter(F.split(normalised(path), "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok"))
    step = F.aggregate(parts, start, lambda s, p: F.struct((s["depth"] + F.when(p == "..", -1).otherwise(1)).alias("depth"), (s["ok"] & (s["depth"] + F.when(p == "..", -1).otherwise(1) >= 0)).alias("ok")))
    return F.coalesce(step["ok"] & (step["depth"] > 0) & ~path.rlike(r"^([A-Za-z]:|[/\\])"), F.lit(False))


def change_extension(path: Column, ext: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./\\]*$", ""), F.lit(ext))


def safe_file_name(name: Column, reference: Column, place: Column) -> Column:
    """``%06d-%06d-name`` with characters that file systems refuse replaced and at most 180 kept."""
    clean = F.left(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1F]', "_"), F.lit(180))
    return F.concat(F.format_string("%06d-%06d-", reference.cast("int"), place.cast("int")), clean)


def contains_ignoring_case(text: Column, part: Column) -> Column:
    return F.contains(F.upper(text), F.upper(part))


def uint32(text: Column) -> Column:
    """Decimal or 0x-hexadecimal text as a number from 0 to 2^32 - 1; null if it is neither."""
    hexed = F.conv(F.regexp_extract(text, r"^0[xX]([0-9A-Fa-f]{1,8})$", 1), 16, 10)
    dec = F.regexp_extract(text, r"^[0-9]{1,10}$", 0)
    value = F.when(text.rlike(r"^0[xX][0-9A-Fa-f]{1,8}$"), hexed).when(dec != "", dec).cast("long")
    return F.when(value <= 4294967295, value)


def opaque_name(name: Column) -> Column:
    """Thirty-two hexadecimal digits: a name that stands for a hash."""
    return name.rlike(r"^[0-9A-Fa-f]{32}$")


def md5_alias(name: Column) -> Column:
    """Hash of the lower-cased name in UTF-16, which stands for the name in some indexes."""
    return F.md5(F.encode(F.lower(name), "UTF-16LE"))


def adler32(content: Column) -> Column:
    """Adler-32 of a binary by closed sums: a = 1 + sum(b), b = n + sum((n - i) b_i), modulo 65521."""
    hexed = F.hex(content)
    n = F.octet_length(content)
    codes = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(n == 0, F.lit(0)).otherwise(F.conv(F.substring(hexed, 2 * i - 1, F.lit(2)), 16, 10).cast("long")))
    state = F.aggregate(codes, F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b")), lambda s, c: F.struct(((s["a"] + c) % 65521).alias("a"), ((s["b"] + s["a"] + c) % 65521).alias("b")))
    return F.when(n == 0, F.lit(1).cast("long")).otherwise(state["b"] * 65536 + state["a"])


def saturating_sum(value: Column) -> Column:
    return F.least(F.sum(value.cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")


def printable_runs(text: Column, least: int = 4) -> Column:
    """Runs of printable ASCII of at least ``least`` characters."""
    return F.regexp_extract_all(text, F.lit(rf"([\x20-\x7E]{{{least},}})"), F.lit(1))


def has_errors(diagnostics: Column) -> Column:
    return F.exists(diagnostics, lambda d: d["severity"] == "Error")
