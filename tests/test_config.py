import gzip
import io
import tarfile

import pytest

from biblion import config
from biblion.sources import eprint


def test_settings(tmp_path):
    (tmp_path / config.NAME).write_text('ignore_rules = ["CIT003"]\nignore_keys = ["old*"]\nfail_on = "warning"\n[severity]\nREF013 = "error"\n')
    (tmp_path / "a").mkdir()
    s = config.load(config.find(tmp_path / "a"))
    assert s.ignore_rules == ("CIT003",) and s.severity == {"REF013": "error"} and s.fail_on == "warning"
    for wrong in ("ignore = 1", 'ignore_rules = ["XXX"]', 'fail_on = "bad"'):
        (tmp_path / config.NAME).write_text(wrong)
        with pytest.raises(ValueError):
            config.load(tmp_path / config.NAME)


def package(name, data=b"x"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_unpack(spark):
    assert eprint.unpack(package("a/main.tex")) == [("a/main.tex", b"x")]
    assert eprint.unpack(gzip.compress(b"\\documentclass{a}")) == [("main.tex", b"\\documentclass{a}")]
    assert eprint.unpack(b"%PDF-1.4")[0][0] == "paper.pdf"
    with pytest.raises(ValueError):
        eprint.unpack(package("../evil"))
    df = spark.createDataFrame([("p", bytearray(package("m.tex"))), ("q", bytearray(package("/etc/x")))], "file string, content binary")
    assert {(r.package, r.file) for r in eprint.files(df).collect()} == {("p", "m.tex"), ("q", None)}
