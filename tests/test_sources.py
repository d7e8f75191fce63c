"""Archives, listings, packages, traces, executables, media: what is read, and what malformed input gives."""

from __future__ import annotations

import hashlib
import io
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest
from builders import archive, bmp, chunk, executable, jpeg, png, wave

from silvane.operators import rules
from silvane.plans import pipelines
from silvane.sources import archives, binaries, files, media, sinks, tables


def codes(notes):
    return [d["code"] for d in notes]


@pytest.mark.parametrize("compressed", [False, True])
@pytest.mark.parametrize("nul", [False, True])
def test_index(compressed, nul):
    raw = archive([{"name": "image/title.png", "segments": [(b"\xca\xfe\x01", False)], "adler": 0x12345678, "nul": nul}], compressed)
    out = archives.read_index(io.BytesIO(raw))
    (e,) = out["entries"]
    assert out["stage"] == 2 and out["is_index_compressed"] is compressed
    assert (e["name"], e["segments"][0]["offset"], e["adler32"]) == ("image/title.png", 19, 0x12345678)


def test_names_by_alias_then_adler():
    name = "Art/Title.png"
    alias = hashlib.md5(name.lower().encode("utf-16-le")).hexdigest()
    record = lambda key, n: chunk(b"hnfn", struct.pack("<Ih", key, len(n)) + n.encode("utf-16-le"))
    raw = archive([{"name": alias, "segments": [(b"a", False)], "adler": 7}, {"name": "x", "segments": [(b"b", False)], "adler": 9}], extra=record(7, "wrong.png") + record(9, "other.ogg") + record(9, "late.ogg") + record(1, name))
    assert [e["name"] for e in archives.read_index(io.BytesIO(raw))["entries"]] == [name, "other.ogg"]


def test_name_list():
    names = struct.pack("<IqIh", 0, 4 + 2 + 6, 5, 3) + "abc".encode("utf-16-le")
    packed = zlib.compress(names)
    first = archive([{"name": "q", "segments": [(packed, False)]}, {"name": "y", "segments": [(b"z", False)], "adler": 5}], extra=chunk(b"cbg:", struct.pack("<qII", 19, len(names), len(packed))))
    assert [e["name"] for e in archives.read_index(io.BytesIO(first))["entries"]] == ["q", "abc"]


def test_malformed_index():
    good = archive([{"name": "a", "segments": [(b"x", False)]}])
    at = struct.unpack_from("<q", good, 11)[0]
    big = bytearray(good)
    big[at + 1 : at + 9] = struct.pack("<q", 1 << 40)
    assert "XP3_INDEX_SIZE_INVALID" in codes(archives.read_index(io.BytesIO(bytes(big)))["diagnostics"])
    assert codes(archives.read_index(io.BytesIO(b"no"))["diagnostics"]) == ["XP3_HEADER_TOO_SHORT"]
    rng = random.Random(1)
    for n in range(len(good)):
        cut = bytearray(good[:n])
        if cut:
            cut[rng.randrange(len(cut))] ^= 255
        archives.read_index(io.BytesIO(bytes(cut)))  # never raises


def test_extract():
    adler = zlib.adler32(b"abcde")
    raw = archive([{"name": "a", "segments": [(b"ab", False), (b"cde", True)], "adler": adler}, {"name": "b", "segments": [(b"abcde", False)], "adler": 1}, {"name": "c", "segments": [(b"abcde", False)], "marked": True, "adler": adler}])
    f = io.BytesIO(raw)
    a, b, c = archives.read_index(f)["entries"]
    assert archives.extract(f, a)["content"] == b"abcde"
    assert codes(archives.extract(f, b)["diagnostics"]) == ["XP3_ADLER32_MISMATCH"]
    assert codes(archives.extract(f, c)["diagnostics"]) == ["XP3_CONTENT_FILTER_REQUIRED"]
    assert archives.extract(f, c, allow_unfiltered=True)["succeeded"]
    wrong = dict(a, packed_size=1)
    assert codes(archives.extract(f, wrong)["diagnostics"]) == ["XP3_ENTRY_SIZE_MISMATCH"]


def test_pack_round_trip(spark, tmp_path):
    source = tmp_path / "in"
    (source / "art").mkdir(parents=True)
    (source / "art" / "a.png").write_bytes(png())
    (source / "b.txt").write_text("hello world, hello world, hello")
    packed = tmp_path / "o.xp3"
    told = sinks.pack_directory(str(source), str(packed))
    assert [t["name"] for t in told] == ["art/a.png", "b.txt"]
    with pytest.raises(FileExistsError):
        sinks.pack_directory(str(source), str(packed))
    written, checked = pipelines.unpack(spark, [str(packed)], str(tmp_path / "out"))
    assert {r.output_name for r in written.collect() if r.written} == {"art/a.png", "b.txt"}
    assert (tmp_path / "out/art/a.png").read_bytes() == png()
    rows = {r.entry_name: r for r in checked.collect()}
    assert rows["art/a.png"].validated and rows["art/a.png"].detected_format == "Png" and not rows["b.txt"].validated
    assert archives.entries_of(spark.read.format("binaryFile").load(str(packed))).count() == 2


def test_duplicate_names():
    assert rules.exact_duplicate_names(["characters/a.png"] * 3) == ["characters/a.png", "characters/a__duplicate-002.png", "characters/a__duplicate-003.png"]
    assert rules.exact_duplicate_names(["a", "A", "a__duplicate-002"]) == ["a", "A__duplicate-002", "a__duplicate-002__duplicate-002"]


def test_filters():
    key = bytes([3, 5, 7])
    apply = archives.repeating_xor(key)
    hidden = apply("", None, 0, 0, png())
    best, worst = pipelines.score_filters(hidden, {"wrong": archives.repeating_xor(b"\x01"), "right": apply})
    assert (best["scheme_id"], best["accepted"], best["score"]) == ("right", True, 100)
    assert worst["code"] == "FILTER_CANDIDATE_REJECTED"
    entries = [{"name": str(i), "segments": [(apply("", None, 0, 0, d), False)], "marked": True, "adler": zlib.adler32(d)} for i, d in enumerate((png(), png(2, 2)))]
    raw = archive(entries)
    assert pipelines.prove_filter(raw, {"wrong": archives.repeating_xor(b"\x01"), "right": apply}) == "right"
    assert pipelines.gate(raw, apply) and not pipelines.gate(raw, archives.repeating_xor(b"\x01"))
    assert pipelines.byte_difference(bytes([0, 1, 2, 3, 4]), bytes([0, 9, 8, 3, 7])) == {"changed": 3, "first": 1, "last": 4, "ranges": [(1, 2), (4, 1)]}


def test_listing_and_zip(spark, tmp_path):
    (tmp_path / "d" / "empty").mkdir(parents=True)
    (tmp_path / "d" / "_hidden.xp3").write_bytes(b"")
    (tmp_path / "game.exe").write_bytes(b"MZ")
    rows = {r.rel_path: r for r in files.listing(spark, str(tmp_path)).collect()}
    assert set(rows) == {"d", "d/empty", "d/_hidden.xp3", "game.exe"} and rows["d/empty"].is_dir
    assert [(r.rel_path, r.role) for r in files.discover(spark, str(tmp_path)).collect()] == [("d/_hidden.xp3", "archive"), ("game.exe", "executable")]
    package = tmp_path / "p.zip"
    with zipfile.ZipFile(package, "w") as z:
        z.writestr("good/a.xp3", b"1234")
        z.writestr("GOOD/A.xp3", b"1234")
        z.writestr("../bad.txt", b"x")
    entries = spark.read.format("zip_entries").load(str(package))
    assert {(r.name, r.problem) for r in files.package_problems(entries, most_entry=3).collect()} >= {("../bad.txt", "PathUnsafe"), ("good/a.xp3", "item")}
    assert files.stage_member(str(package), "good/a.xp3") == b"1234"
    assert files.input_kind(str(package)) == "Package"


def test_trace(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes("﻿Time of Day,Process Name,PID,Operation,Path,Result,Detail\r\n1,g.exe,42,CreateFile,\"C:\\game,data.xp3\",SUCCESS,\r\n2,g.exe,42,RegQueryKey,HK,SUCCESS,\r\n3,o.exe,43,ReadFile,C:\\x,SUCCESS,\r\n".encode())
    assert [(r.source_line, r.path) for r in tables.trace(spark, str(path), 42).collect()] == [(2, "C:\\game,data.xp3")]
    path.write_text("PID,Path\n1,x\n")
    assert codes(tables.read_trace(str(path), 1)[1]) == ["RUNTIME_PROCMON_CSV_COLUMNS_MISSING"]
    assert tables.split_line('"p""q",x"y,z"w') == ['p"q', "xy,zw"]


def test_executables(spark, tmp_path):
    raw = executable(["KERNEL32.dll", "version.dll", "kernel32.dll"], (0x41C64E6D).to_bytes(4, "little") + b"uses CxEncryption here" + "wide text".encode("utf-16-le"))
    r = binaries.analyze(raw)
    assert r["pe"]["machine"] == "x86" and r["pe"]["imported_modules"] == ["KERNEL32.dll", "version.dll"]
    assert {s["encoding"] for s in r["strings"]} == {"ascii", "utf-16le"}
    assert [f["score"] for f in r["findings"] if f["kind"] == "HeuristicCandidate"] == [70]
    assert binaries.launcher_probe(r) == {"is_x86": True, "imports_version": True, "looks_packed": False}
    for n in range(0, len(raw), 7):
        binaries.analyze(raw[:n])
    (tmp_path / "game.exe").write_bytes(raw)
    (tmp_path / "Version.dll").write_bytes(executable([]))
    reports, links = pipelines.analyze_directory(spark, str(tmp_path))
    assert reports.count() == 2
    assert {r.module: r.resolved_path is not None for r in links.collect()} == {"KERNEL32.dll": False, "version.dll": True}
    base = {"schemaVersion": "1.0", "id": "k", "displayName": "K", "schemes": [{"id": "s", "revision": "1.0.0", "fingerprint": {"requiredMachine": "X86", "requiredImportedModules": ["VERSION.DLL"]}}, {"id": "h", "revision": "1.0.0", "fingerprint": {"requiredFindingIds": ["HEURISTIC_CX_ENCRYPTION"]}}]}
    found = rules.fingerprint_match(pipelines.matchable(reports), tables.scheme_rules(base)).collect()
    assert [(f.scheme_id, f.score) for f in found] == [("s", 30)]
    scan = pipelines.knowledge_scan(spark, str(tmp_path), base)
    assert pipelines.scan_compare(scan, scan).count() == 0


def test_overlay(spark, tmp_path):
    for side, data in (("r", {"replace.txt": "old", "same.txt": "same"}), ("o", {"replace.txt": "new", "same.txt": "same", "added.txt": "x", "folder": "f"})):
        (tmp_path / side).mkdir()
        for name, text in data.items():
            (tmp_path / side / name).write_text(text)
    (tmp_path / "r" / "folder").mkdir()
    out = pipelines.overlay_directories(spark, str(tmp_path / "r"), str(tmp_path / "o"))
    assert {r.rel_path: r.change_kind for r in out.collect()} == {"replace.txt": "Replaced", "same.txt": "Identical", "added.txt": "Added", "folder": "Conflict"}
    with pytest.raises(ValueError):
        pipelines.overlay_directories(spark, str(tmp_path), str(tmp_path / "o"))


def test_validators():
    assert media.png(png())["stage"] == 6
    broken = bytearray(png())
    broken[-20] ^= 1
    assert media.png(bytes(broken))["code"] == "PNG_CRC_MISMATCH"
    assert media.bmp(bmp())["stage"] == 6 and media.bmp(bmp()[:-1])["code"] == "BMP_DECLARED_LENGTH_INVALID"
    assert media.wave(wave())["stage"] == 6 and media.wave(wave(0x55))["stage"] == 1
    assert media.wave(wave(rate_bytes=1))["code"] == "WAVE_UNCOMPRESSED_METADATA_INVALID"
    assert media.jpeg(jpeg())["stage"] == 6 and media.jpeg(jpeg()[:-2])["stage"] == 1
    for make, read in ((png, media.png), (bmp, media.bmp), (wave, media.wave), (jpeg, media.jpeg)):
        for n in range(len(make())):
            assert read(make()[:n])["stage"] < 6
    assert media.score(b"OggS")["score"] == 10 and media.score(b"")["score"] == 0


def test_images():
    pixels = media.decode_bmp(bmp())
    assert pixels.tolist() == [[[3, 2, 1, 255]], [[3, 2, 1, 255]]]
    assert media.png(media.to_png(bmp()))["stage"] == 6
    plane = lambda *b: b"\x01" + struct.pack("<I", len(b)) + bytes(b)
    raw = b"TLG5.0\x00raw\x1a" + b"\x03" + struct.pack("<III", 1, 2, 2) + struct.pack("<I", 0) + plane(10, 3) + plane(20, 2) + plane(30, 3)
    # Differences run along the row and down the rows; green is added to blue and red.
    assert media.decode_tlg5(raw).tolist() == [[[50, 20, 30, 255]], [[55, 22, 35, 255]]]
    assert media.tlg(raw)["data_offset"] == 20
    assert media._unpack(bytes([0b00000010, 7, 0x00, 0x00]), 4, bytearray(4096), 0)[0] == bytes([7, 7, 7, 7])[:1] + bytes([7, 7, 7])


def test_psb():
    array = lambda *v: b"\x0d" + bytes([len(v)]) + b"\x0d" + bytes(v)
    # One name, "a": leaf 98 under 0 at base 1.
    parents = [0] * 99
    names = array(1) + array(*parents) + array(98)
    head = 44
    entries = head + len(names)
    root = b"\x21" + array(0) + array(0) + b"\x19\x00"
    offsets = entries + len(root)
    table = array(0) + array(3)
    data_at = offsets + len(table)
    fields = struct.pack("<8I", head, head, head, head, offsets, offsets + len(array(0)), data_at, entries)
    raw = b"PSB\0" + struct.pack("<HH", 3, 0) + fields + struct.pack("<I", zlib.adler32(fields)) + names + root + table + b"xyz"
    r = media.psb_resources(raw)
    assert r["keys"] == ["a"] and [(x["offset"], x["length"]) for x in r["resources"]] == [(data_at, 3)]
    assert media.psb_header(raw[:40])["code"] == "PSB_HEADER_TRUNCATED"
    for n in range(len(raw)):
        media.psb_resources(raw[:n])


def test_safe_output(tmp_path):
    assert sinks.safe_output(str(tmp_path), "a/b.txt").endswith("a/b.txt")
    for bad in ("../x", "/x", "C:\\x", "", "a/../../x"):
        with pytest.raises(ValueError):
            sinks.safe_output(str(tmp_path), bad)


def test_script_heuristic():
    assert media.looks_like_script(b"\xfe\xfe\x01xx") and media.looks_like_script(b"a" * 32) and not media.looks_like_script(b"a" * 31)
    assert np.array_equal(media.decode_bmp(bmp()), media.decode_bmp(bmp()))
