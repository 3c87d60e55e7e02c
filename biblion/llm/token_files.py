"""Operator 3: token ids in flat binary files with 64-bit document offsets.

Documents go in ascending doc_id order. A range partition becomes three files of one part: the ids of its
documents one after another (little-endian, the narrowest of uint16 and uint32 that holds the vocabulary), the
offsets (int64, one more than documents, counted in ids from the part's start) and the doc_ids (int64). A part's
base, the number of ids before it, is the prefix sum of the parts' counts, so no task waits for another. Readers
map the files into memory (stores other than a local or mounted folder are read into memory part by part).

Tokens come from the tokenizers library. A text is cut at spaces and line feeds, where no token of this kind of
vocabulary can cross, and each distinct chunk is encoded once per worker and kept (at most MAX_CHUNKS of them).

Every attempt writes files of its own name and the manifest names those of the attempts that succeeded, so a
lost executor leaves stray files but no wrong ones. The manifest is a table of one row a part.

Edge cases. Null text counts as empty; an empty text is the end id alone. Null doc_ids come first (as
the smallest 64-bit number in the files, null in the result); equal doc_ids are ordered by a
hash of the text, and may lie in several parts. An empty
table gives no files and no rows. Further columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biblion.llm import textvec as tv
from biblion.llm.shared import fresh_path, stash, table

MAX_CHUNKS, END_ID, NO_ID = 600_000, 1, -(1 << 63)

#: How byte-level vocabularies write a byte: itself if it prints, else the next free character from 256 on.
_PRINTS = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHAR = {b: chr(b) for b in _PRINTS} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_PRINTS))}
WORD_AND_MARKS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")


class Chunks(dict):
    """Ids (as array bytes) of chunks without spaces; a new chunk is taken apart where that provably changes nothing."""

    def __init__(self, tokenizer, kind: str):
        self.tokenizer, self.kind = tokenizer, kind
        self[""] = b""

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha() and unicodedata.is_normalized("NFC", chunk):
            low = chunk.lower()
            if low == chunk:  # normalising leaves it alone, and it is one pre-token
                ids = [t.id for t in self.tokenizer.model.tokenize(chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(BYTE_CHAR))]
                out = array(self.kind, ids).tobytes()
            elif "Σ" not in chunk and low.isalpha() and unicodedata.is_normalized("NFC", low):
                out = self[low]
            else:
                out = self.encode(chunk)
        elif (m := WORD_AND_MARKS.fullmatch(chunk)) and m[1].lower().isalpha():  # letters end where marks begin
            out = self[m[1]] + self[m[2]]
        else:
            out = self.encode(chunk)
        if len(self) > MAX_CHUNKS:
            self.clear()
            self[""] = b""
        self[chunk] = out
        return out

    def encode(self, chunk: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def text(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_loaded: dict = {}


def chunks(spec: str) -> Chunks:
    """One per worker process and tokenizer."""
    key = hash(spec)
    if key not in _loaded:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(spec)
        tokenizer.encode_special_tokens = True
        _loaded[key] = Chunks(tokenizer, "H" if tokenizer.get_vocab_size() <= 1 << 16 else "I")
    return _loaded[key]


MANIFEST = "part int, path string, n_docs long, n_tokens long, width int"


def _write(spec, folder: str, end_id: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, root = pafs.FileSystem.from_uri(folder)
        path, own = f"{root}/part-{part:06d}-{uuid.uuid4().hex}", chunks(spec.value)
        width, end = array(own.kind).itemsize, array(own.kind, [end_id]).tobytes()
        docs = tokens = 0
        first = next(frames, None)
        if first is None:
            return
        store.create_dir(root, recursive=True)
        with store.open_output_stream(path + ".tokens") as out, store.open_output_stream(path + ".offsets") as offsets, store.open_output_stream(path + ".ids") as names:
            offsets.write(array("q", [0]).tobytes())
            for batch in (b for some in ([first], frames) for b in some):
                for ids, texts in tv.batches([batch]):
                    coded = [own.text(t or "") + end for t in texts]
                    sizes = np.array([len(c) // width for c in coded], np.int64)
                    out.write(b"".join(coded))
                    offsets.write((tokens + np.cumsum(sizes)).tobytes())
                    names.write(array("q", [NO_ID if i is None else i for i in ids]).tobytes())
                    docs += len(ids)
                    tokens += int(sizes.sum())
        yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "n_docs": docs, "n_tokens": tokens, "width": width}], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())]))

    return run


def write_tokens(docs: DataFrame, tokenizer_json: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Writes the files below folder; returns the manifest: part, path, n_docs, n_tokens, width, base."""
    json.loads(tokenizer_json)
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("tie", F.xxhash64("text", "doc_id"))
    # the tie deals out rows without an id, or with the same one
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    manifest = stash(rows.mapInArrow(_write(spec, folder, end_id), MANIFEST), "manifest")
    # one row a part: a single task adds them up
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def _mapped(store, path: str, kind: str) -> np.ndarray:
    if not store.get_file_info(path).size:
        return np.zeros(0, kind)
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read(folder: str):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in frames:
            for row in batch.to_pylist():
                ids = _mapped(store, row["path"] + ".tokens", f"<u{row['width']}")
                offsets, names = _mapped(store, row["path"] + ".offsets", "<i8"), _mapped(store, row["path"] + ".ids", "<i8")
                for a in range(0, len(names), 4096):
                    own, cut = names[a : a + 4096], offsets[a : a + 4097]
                    crc = [zlib.crc32(ids[x:y].astype("<u4")) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, pa.int64(), mask=own == NO_ID), pa.array(cut[:-1] + row["base"]), pa.array(np.diff(cut)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return run


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    # a number of partitions is named, else the few narrow rows would be put together in one task that reads every file
    return manifest.repartition(max(1, manifest.count()), "part").mapInArrow(_read(folder), READ)


def op3_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    folder = fresh_path(spark, "tokens")
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), spec, folder), folder)
