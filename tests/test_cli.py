"""Commands end to end: exit codes and JSON."""

from __future__ import annotations

import json

from builders import archive, bmp, png

from silvane import cli


def run(capsys, *args):
    code = cli.main(list(args))
    out = capsys.readouterr().out
    return code, json.loads(out) if code == 0 else None


def test_commands(spark, tmp_path, capsys):
    packed = tmp_path / "a.xp3"
    packed.write_bytes(archive([{"name": "a.png", "segments": [(png(), True)]}]))
    assert run(capsys, "probe", str(packed))[1]["is_xp3"]
    assert run(capsys, "xp3", "list", str(packed))[1]["entries"][0]["name"] == "a.png"
    assert run(capsys, "xp3", "profile", str(packed))[1]["archive"][0]["compressed_segment_count"] == 1
    assert run(capsys, "unpack", str(packed), str(tmp_path / "out"), "image")[1]["totals"]["validated"] == 1
    assert run(capsys, "verify", str(tmp_path / "out" / "a.png"))[1]["score"] == 100
    (tmp_path / "b.bmp").write_bytes(bmp())
    assert run(capsys, "convert", str(tmp_path / "b.bmp"), str(tmp_path / "b.png"))[0] == 0
    assert run(capsys, "convert", str(tmp_path / "b.bmp"), str(tmp_path / "b.png"))[0] == 3
    assert run(capsys, "unpack", str(packed), str(tmp_path / "x"), "pictures")[0] == 2
    assert run(capsys, "nothing")[0] == 1
