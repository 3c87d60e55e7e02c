"""Source packages of preprints: tar, gzip or a bare PDF, as rows of files."""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame

FILES = "package string, file string, content binary"


def unpack(content: bytes) -> list[tuple[str, bytes]]:
    """(name, bytes) of the regular files in a package. Names that lead out of it are refused, links are left out."""
    if content[:4] == b"%PDF":
        return [("paper.pdf", content)]
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
        if content[:4] == b"%PDF":
            return [("paper.pdf", content)]
    try:
        with tarfile.open(fileobj=io.BytesIO(content)) as tar:
            out = []
            for member in tar:
                name = PurePosixPath(member.name)
                if name.is_absolute() or ".." in name.parts:
                    raise ValueError(f"the package has a path outside itself: {member.name}")
                if member.isfile():
                    out.append((str(name), tar.extractfile(member).read()))
            return out
    except tarfile.ReadError:
        return [("main.tex", content)]


def files(packages: DataFrame) -> DataFrame:
    """packages(file, content) -> package, file, content; a package that cannot be read has one row without a file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, data in zip(frame["file"], frame["content"]):
                try:
                    rows += [(name, f, c) for f, c in unpack(data)]
                except (ValueError, OSError, EOFError):
                    rows.append((name, None, None))
            yield pd.DataFrame(rows, columns=["package", "file", "content"])

    return packages.select("file", "content").mapInPandas(run, FILES)
