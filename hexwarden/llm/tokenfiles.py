"""Token ids of documents in length-delimited binary files.

File format. A record is: payload length (unsigned 64 bits, little-endian), masked CRC-32 of these 8 bytes (32 bits),
payload, masked CRC-32 of the payload. The mask turns a checksum c into ((c >> 15 | c << 17) + 0xA282EAD8) mod 2^32,
so checksums of data that hold checksums stay meaningful. The payload is one document's ids, each 2 bytes if the
vocabulary has at most 65,536 ids, else 4. Beside each ``.records`` file lies an ``.index`` file: a row of three
little-endian 64-bit numbers (doc id, byte offset of the record, number of ids) per record, plus a null flag, so a
reader can take records in any order.

Documents are written in ascending order of id (null ids first; rows with the same id by their text's hash): the key
range is cut at quantiles of the ids, each range is one task and one pair of files. A task writes under a name of its
own attempt and the manifest - rows that Spark collects into a table - names the files that count, so a repeated task
leaves no doubt. Files are written and read through ``pyarrow.fs``, which knows local and shared folders, HDFS and
object stores by their URI.

Defined results: null and empty texts are records with the end id alone; an empty table gives no files and an empty
result; extra columns are not read; a record whose checksum or length fails raises an error.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hexwarden.llm.common import table, worker_cache
from hexwarden.workspace import run_dir, written

VOCABULARY = "word_bpe_49k.json"
#: The end id, and the constant that masks checksums.
END_ID = 2
MASK_DELTA = 0xA282EAD8
#: Bytes of text that one pair of files is made of, and records that one reading task takes at a time.
FILE_TEXT_BYTES = 32 * 2**20
#: At most so many ranges are cut (Spark samples a hundred ids for each on the driver); beyond, files grow.
MOST_FILES = 100_000

#: Entries of a worker's cache of encoded pieces, some 200 bytes each; it is emptied when full, which costs time only.
CACHE_PIECES = 1_000_000

INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<i8"), ("n_tokens", "<i8"), ("is_null", "<i8")])
MANIFEST = "part long, records string, index string, n_docs long, n_tokens long, n_bytes long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


class _Pieces(dict):
    """Ids of pieces without blanks, as bytes; one is encoded when it is first asked for.

    The vocabulary's pre-tokenizer parts letters from signs and its normalizer lower-cases, so a piece of letters and signs
    behind them has the ids of the lower-cased letters and those of the signs, which many pieces share. All other
    pieces are encoded as they are.
    """

    def __init__(self, tokenizer, kind: str):
        self.tokenizer, self.kind = tokenizer, kind

    def __missing__(self, piece: str) -> bytes:
        letters = piece.rstrip(SIGNS)
        if letters.isalpha() and max(letters) <= "ÿ":
            lower, signs = letters.lower(), piece[len(letters) :]
            if signs:
                found = self[piece] = self[lower] + self[signs]
                return found
            if lower != piece:
                found = self[piece] = self[lower]
                return found
        ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        found = self[piece] = np.array(ids, dtype=self.kind).tobytes()
        return found


class Encoder:
    """Encodes texts with the tokenizers library, each distinct piece between blanks once.

    Both the normalizer and the pre-tokenizer of the vocabulary cut at white space and drop it, so a text's ids are
    those of its pieces one after the other (tested against whole texts).
    """

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if tokenizer.get_vocab_size() <= 2**16 else "<u4"
        self.pieces, self.cache_pieces = _Pieces(tokenizer, self.kind), cache_pieces

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of the width ``kind``."""
        out = []
        for text in texts:
            if len(self.pieces) > self.cache_pieces:
                self.pieces.clear()
            out.append(b"".join(map(self.pieces.__getitem__, _cut(text))))
        return out


def _cut(text: str) -> list[str]:
    # split() also cuts at four separators that the tokenizer takes for signs.
    if any(c in text for c in _NO_BLANKS):
        return text.translate(_TO_SPACE).split(" ")
    return text.split()


#: Signs that the pre-tokenizer keeps apart from letters (an apostrophe may begin a contraction).
SIGNS = ".,;:!?#*$%&\")(]["
_NO_BLANKS = "\x1c\x1d\x1e\x1f"
_TO_SPACE = str.maketrans(dict.fromkeys("\t\n\r\x0b\x0c", " "))


def _encoder(path: str, cache_pieces: int) -> Encoder:
    return worker_cache(f"encoder {path} {cache_pieces}", lambda: Encoder(path, cache_pieces))


def _writer(folder: str, vocabulary: str, end_id: int, cache_pieces: int):
    """A task: its rows, already in order, become one pair of files; returns their line of the manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = _encoder(vocabulary, cache_pieces)
        end = np.array([end_id], dtype=encoder.kind).tobytes()
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        name = f"part-{part:07d}-{uuid.uuid4().hex}"
        n_docs = n_tokens = offset = 0
        with (
            files.open_output_stream(f"{base}/{name}.records") as records,
            files.open_output_stream(f"{base}/{name}.index") as index,
        ):
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    rows = batch.slice(at, 256)
                    ids = rows.column("doc_id").to_pylist()
                    payloads = encoder.encode([t or "" for t in rows.column("text").to_pylist()])
                    entries = np.zeros(len(ids), dtype=INDEX)
                    for k, (doc_id, payload) in enumerate(zip(ids, payloads, strict=True)):
                        payload += end
                        length = len(payload).to_bytes(8, "little")
                        frame = b"".join(
                            (length, masked(length).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little"))
                        )
                        records.write(frame)
                        count = len(payload) // len(end)
                        entries[k] = (doc_id or 0, offset, count, doc_id is None)
                        offset += len(frame)
                        n_tokens += count
                    index.write(entries.tobytes())
                    n_docs += len(ids)
        if n_docs:
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "part": part,
                        "records": f"{name}.records",
                        "index": f"{name}.index",
                        "n_docs": n_docs,
                        "n_tokens": n_tokens,
                        "n_bytes": offset,
                    }
                ],
                schema=pa.schema(
                    [("part", pa.int64()), ("records", pa.string()), ("index", pa.string())]
                    + [(c, pa.int64()) for c in ("n_docs", "n_tokens", "n_bytes")]
                ),
            )

    return write


def write_files(
    docs: DataFrame,
    folder: str,
    vocabulary: str,
    id_col="doc_id",
    text_col="text",
    end_id: int = END_ID,
    file_text_bytes: int = FILE_TEXT_BYTES,
    cache_pieces: int = CACHE_PIECES,
) -> DataFrame:
    """Write the documents below ``folder``; returns the manifest, a stored table with one row per pair of files.

    File names are relative to ``folder``; files of attempts that did not count are not in the manifest.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    ranges = rows.repartitionByRange(min(MOST_FILES, 1 + n_bytes // file_text_bytes), *order).sortWithinPartitions(*order)
    return written(ranges.mapInArrow(_writer(folder, vocabulary, end_id, cache_pieces), MANIFEST), "token-manifest")


def _read_frame(source, entry) -> bytes:
    source.seek(int(entry["offset"]))
    head = source.read(12)
    length = int.from_bytes(head[:8], "little")
    if len(head) != 12 or masked(head[:8]) != int.from_bytes(head[8:], "little"):
        raise ValueError(f"bad length of a record at {entry['offset']}")
    body = source.read(length + 4)
    if len(body) != length + 4 or masked(body[:length]) != int.from_bytes(body[length:], "little"):
        raise ValueError(f"bad payload of a record at {entry['offset']}")
    return body[:length]


def records_of(folder: str, records: str, index: str, order=None) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc id, ids) of one pair of files, in file order or in the order of index rows that ``order`` lists."""
    files, base = fs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{base}/{index}") as source:
        entries = np.frombuffer(source.read(), dtype=INDEX)
    with files.open_input_file(f"{base}/{records}") as source:
        for entry in entries if order is None else entries[order]:
            payload = _read_frame(source, entry)
            width = len(payload) // int(entry["n_tokens"])
            yield None if entry["is_null"] else int(entry["doc_id"]), np.frombuffer(payload, dtype=f"<u{width}")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out, start = [], row["before"]
                for doc_id, ids in records_of(folder, row["records"], row["index"]):
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(out) == 10_000:
                        yield _digest_batch(out)
                        out = []
                if start != row["before"] + row["n_tokens"]:
                    raise ValueError(f"{row['records']}: {start - row['before']} ids, the manifest has {row['n_tokens']}")
                if out:
                    yield _digest_batch(out)

    return read


def read_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """Read the files back, checking every record: doc_id, start, n_tokens, ids_crc32.

    A file's line of the manifest carries the number of ids before it to the task that reads it, so documents meet
    nothing but their own file.
    """
    # A running total over the files, of which there are at most MOST_FILES.
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    lines = written(manifest.withColumn("before", F.coalesce(before, F.lit(0))), "token-starts")
    return lines.repartition(max(1, lines.count())).mapInArrow(_reader(folder), READ)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_and_read(
    docs: DataFrame,
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    cache_pieces: int = CACHE_PIECES,
) -> DataFrame:
    """Write ``docs`` to files in the shared folder and report what they hold, read back from them."""
    folder = run_dir(docs.sparkSession, "token-files")
    manifest = write_files(docs, folder, vocabulary or vocabulary_path(), id_col, text_col, cache_pieces=cache_pieces)
    return read_digests(manifest, folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read(table(spark, sf_dir, "documents"))
