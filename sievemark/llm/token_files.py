"""Token ids in flat binary files.

Documents are range-partitioned by id and sorted; every partition encodes its texts and
streams them to one shard:

- ``shard-NNNNN.bin``: the ids of all its documents, little-endian unsigned integers of
  2 bytes (vocabularies up to 65,536) or 4 bytes, nothing else;
- ``shard-NNNNN.idx``: n + 1 64-bit offsets into it, in ids;
- ``shard-NNNNN.doc``: n 64-bit document ids (the smallest 64-bit integer: null);
- ``manifest.json``: width, shards with their counts, and bases. A shard's base, the
  number of ids before it, is a prefix sum over the counts of the shards before it.

A shard is written under a name of the task attempt and then moved, so that a repeated
task replaces a file by an equal one; only what the manifest lists is ever read.
Readers map the files into memory.

No token of a word tokenizer goes across white space, or from a letter to a mark, so a
text is encoded piece by piece and frequent pieces are remembered. ``splits_at_space``
says, by its description, whether a tokenizer allows that; others get their texts whole,
as does any text in which an added token stands.

Cases: a null text counts as empty, an empty text has the end id alone; documents of
equal id follow each other in the order of their texts' hashes; a null id comes first;
an empty table gives a manifest without shards; texts of any length are encoded whole; ids
are whole numbers, others are an error; columns other than id and text are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievemark.llm.common import (
    blobs,
    bound_batches,
    byte_letters,
    file_system,
    is_local,
    process_wide,
    qualified,
    write_manifest,
)

# A mark behind a letter or digit. It begins with the marks, so most letters are passed over.
WORD_END = re.compile(rb"([!-/:-@\[-`{-~])(?<=[A-Za-z0-9].)")
# Fixed value: how a word tokenizer of the known kind cuts a text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Small letters of Latin-1, in UTF-8.
SMALL_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+")
NULL_ID = -(2**63)
CACHE_PIECES = 300_000
LONGEST_CACHED = 48
WRITE_DOCS = 512
READ_DOCS = 4096


@dataclass(frozen=True)
class TokenSpec:
    """Tokenizer file (on every executor), id that ends a document, piecewise or whole."""

    tokenizer: str
    end_id: int
    pieces: bool


def splits_at_space(path: str) -> bool:
    """Whether the tokenizer normalises character by character, drops white space, cuts
    words as ``WORD_PATTERN`` does and marks their ends."""
    with open(path, encoding="utf-8") as file:
        config = json.load(file)
    normalizer, cutting = config.get("normalizer") or {}, config.get("pre_tokenizer") or {}
    steps = {n["type"] for n in normalizer.get("normalizers", [normalizer] if normalizer else [])}
    first, *others = cutting.get("pretokenizers", [cutting]) or [{}]
    by_word = first.get("type") == "Split" and first.get("pattern") == {"Regex": WORD_PATTERN} and first.get("invert")
    plain = all(o["type"] == "ByteLevel" and not o["use_regex"] and not o["add_prefix_space"] for o in others)
    marked = bool((config.get("model") or {}).get("end_of_word_suffix"))
    return bool(marked and by_word and others and plain and steps <= {"NFC", "Replace", "Lowercase"})


def id_type(path: str) -> str:
    return "<u2" if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 65_536 else "<u4"


class PieceIds(dict):
    """Packed ids of pieces, remembered; what was used since the last turn stays at hand."""

    def __init__(self, tokenizer: Tokenizer, dtype: str) -> None:
        self.tokenizer, self.model, self.dtype = tokenizer, tokenizer.model, dtype
        self.letters = byte_letters()
        self.code = "H" if dtype == "<u2" else "I"
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, piece: bytes) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            # One word, normal as it is: the tokenizer's model takes it, written in its letters.
            if piece.isalpha() and piece.islower():  # of bytes: a-z, which stand for themselves
                ids = [token.id for token in self.model.tokenize(piece.decode("ascii"))]
            elif SMALL_LETTERS.fullmatch(piece):
                written = piece.decode("latin-1").translate(self.letters)
                ids = [token.id for token in self.model.tokenize(written)]
            else:
                ids = self.tokenizer.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids
            packed = struct.pack(f"<{len(ids)}{self.code}", *ids)
        if len(piece) <= LONGEST_CACHED:
            self[piece] = packed
        return packed

    def turn(self) -> None:
        if len(self) > CACHE_PIECES:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Texts to packed ids."""

    def __init__(self, spec: TokenSpec, dtype: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(spec.tokenizer)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.spec, self.dtype = spec, dtype
        with open(spec.tokenizer, encoding="utf-8") as file:
            self.lowers = '"Lowercase"' in json.dumps(json.load(file).get("normalizer"))
        added = [re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        # An added token may be found in the text as it is or as it is normalised.
        self.added = re.compile(b"|".join(added), re.IGNORECASE) if added else None
        self.end = np.array([spec.end_id], dtype).tobytes()
        self.known = PieceIds(self.tokenizer, dtype)

    def whole(self, text: bytes) -> bytes:
        plain = text.decode("utf-8", "replace")
        return np.array(self.tokenizer.encode(plain, add_special_tokens=False).ids, self.dtype).tobytes()

    def cut(self, text: bytes) -> list[bytes]:
        """The pieces of a text: at ASCII white space, and where a letter or digit meets
        an ASCII mark, which no token goes across."""
        if self.lowers:  # the tokenizer does so as well: fewer different pieces
            text = text.lower()
        return WORD_END.sub(rb" \1", text).split()  # of bytes: at ASCII white space

    def documents(self, texts: list[bytes]) -> list[bytes]:
        done = []
        for text in texts:
            if not self.spec.pieces or (self.added and self.added.search(text)):
                done.append(self.whole(text) + self.end)
            else:
                done.append(b"".join(map(self.known.__getitem__, self.cut(text))) + self.end)
        self.known.turn()
        return done


def write_tokens(
    docs: DataFrame, folder: str, spec: TokenSpec, id_col: str = "doc_id", text_col: str = "text"
) -> dict:
    """Write the shards of ``docs`` and the manifest, which is returned as well."""
    dtype, folder = id_type(spec.tokenizer), qualified(docs.sparkSession, folder)
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)

    def write(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, where = file_system(folder)
        name = f"{where}/shard-{task.partitionId():05d}"
        mark = f".try-{task.taskAttemptId()}"
        encoder, outs, docs_done, ids_done = None, {}, 0, 0
        for batch in source:
            for first in range(0, batch.num_rows, WRITE_DOCS):
                part = batch.slice(first, WRITE_DOCS)
                if encoder is None:
                    encoder = process_wide(("encoder", spec, dtype), lambda: Encoder(spec, dtype))
                    outs = {s: files.open_output_stream(f"{name}{s}{mark}") for s in (".bin", ".idx", ".doc")}
                    outs[".idx"].write(np.zeros(1, "<i8").tobytes())
                packed = encoder.documents([t or b"" for t in blobs(part.column("text"))])
                sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // np.dtype(dtype).itemsize
                outs[".bin"].write(b"".join(packed))
                outs[".idx"].write((ids_done + np.cumsum(sizes)).astype("<i8").tobytes())
                keys = part.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                outs[".doc"].write(keys.astype("<i8").tobytes())
                docs_done += len(packed)
                ids_done += int(sizes.sum())
        for suffix, out in outs.items():
            out.close()
            files.move(f"{name}{suffix}{mark}", f"{name}{suffix}")
        if docs_done:
            yield pa.RecordBatch.from_pydict(
                {"shard": [task.partitionId()], "n_docs": [docs_done], "n_ids": [ids_done]},
                schema=pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
            )

    rows = bound_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # One row per shard comes to the driver.
    shards = sorted(
        (r.asDict() for r in dealt.mapInArrow(write, "shard int, n_docs bigint, n_ids bigint").collect()),
        key=lambda s: s["shard"],
    )
    base = 0
    for shard in shards:
        shard["base"] = base
        base += shard["n_ids"]
    manifest = {"dtype": dtype, "shards": shards, "n_ids": base}
    write_manifest(f"{folder}/manifest.json", manifest)
    return manifest


def load(system, path: str, dtype: str) -> np.ndarray:
    if is_local(system):
        return np.memmap(path, dtype, "r")
    with system.open_input_file(path) as file:
        return np.frombuffer(file.read_buffer(), dtype)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every document, from the files in ``folder``; ``ids`` is
    binary, little-endian unsigned 32-bit integers. A file that is missing or has another
    size than the manifest says is an error."""
    folder = qualified(spark, folder)
    system, path = file_system(folder)
    with system.open_input_file(f"{path}/manifest.json") as file:
        manifest = json.loads(file.read())
    dtype = manifest["dtype"]
    schema = "doc_id bigint, start bigint, ids binary"
    if not manifest["shards"]:
        return spark.createDataFrame([], schema)

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = file_system(folder)
        for batch in source:
            for shard, base, n_docs, n_ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = f"{where}/shard-{shard:05d}"
                ids, ends = load(files, f"{name}.bin", dtype), load(files, f"{name}.idx", "<i8")
                keys = load(files, f"{name}.doc", "<i8")
                if (len(keys), len(ends), len(ids)) != (n_docs, n_docs + 1, n_ids) or ends[-1] != n_ids:
                    raise ValueError(f"incomplete {name}: not the {n_docs} documents and {n_ids} ids of the manifest")
                for first in range(0, len(keys), READ_DOCS):
                    some = np.array(keys[first : first + READ_DOCS])
                    cut = np.array(ends[first : first + len(some) + 1])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(some, pa.int64(), mask=some == NULL_ID),
                            pa.array(base + cut[:-1], pa.int64()),
                            pa.array(
                                [ids[a:b].astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)],
                                pa.binary(),
                            ),
                        ],
                        names=["doc_id", "start", "ids"],
                    )

    shards = [tuple(s[n] for n in ("shard", "base", "n_docs", "n_ids")) for s in manifest["shards"]]
    listed = spark.createDataFrame(shards, "shard int, base bigint, n_docs bigint, n_ids bigint")
    listed = listed.repartition(len(shards))
    return listed.mapInArrow(read, schema)


def id_digest(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what ``read_tokens`` returns."""

    return tokens.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
