"""Operator 10: token ids as length-delimited binary records with a separate offset index.

A file is a run of records. A record is: payload length (unsigned 64 bit, little endian), masked checksum of those
eight bytes (unsigned 32 bit), the payload (the ids, 16 bit each where the vocabulary allows, else 32), masked
checksum of the payload. The checksum is zlib's CRC-32, rotated right by 15 bits plus a constant, so that a
checksum of data that hold checksums stays sound. The index (Parquet) has a row for each record: file, byte
offset, byte length, number of ids, ids before it; readers seek by it in any order.

Defined results: null text is an empty text (its record holds the end id alone); repeated rows and repeated ids
get a record each, ties in order of a hash of the text; null ids come first; an empty table writes no file. Other columns
are ignored. A retried or speculative task writes a file of its own name; the index names the one that counted.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirelake.llm._spark import new_folder, written
from quirelake.llm._text import slices, utf8
from quirelake.llm.tokens import END_ID, encoder, texts

#: Fixed value of the masking rule of length-delimited record files.
MASK_DELTA = 0xA282EAD8
HEAD, TAIL = struct.Struct("<QI"), struct.Struct("<I")
#: Bytes of text in a file of records.
FILE_BYTES = 32 << 20
#: Bytes of a record beside its payload.
AROUND = HEAD.size + TAIL.size


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + TAIL.pack(masked(length)) + payload + TAIL.pack(masked(payload))


def unframe(record: bytes) -> bytes:
    """The payload; raises ValueError if the lengths or checksums do not fit."""
    if len(record) < HEAD.size + TAIL.size:
        raise ValueError("record is cut short")
    length, crc = HEAD.unpack_from(record)
    if masked(record[:8]) != crc or len(record) != HEAD.size + length + TAIL.size:
        raise ValueError("record length is damaged")
    payload = record[HEAD.size : HEAD.size + length]
    if masked(payload) != TAIL.unpack_from(record, HEAD.size + length)[0]:
        raise ValueError("record payload is damaged")
    return payload


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def ranges(docs: DataFrame, n: int) -> tuple[list[int], list[tuple]]:
    """Lower ends of n even ranges of the rows (doc_id, text), by id and a hash of the text, so that a repeated id may
    span several: hashes of those that begin without an id, which come first, and (doc_id, hash) of the others. Only
    ids and hashes move; n rows come here."""
    keys = docs.select(F.col("doc_id").isNotNull().alias("known"), "doc_id", F.xxhash64("text").alias("h"))
    dealt = keys.repartitionByRange(n, "known", "doc_id", "h").groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("known", "doc_id", "h")).alias("low"))
    lows = [r["low"] for r in dealt.select("low").collect()]
    return sorted(r["h"] for r in lows if not r["known"]), sorted((r["doc_id"], r["h"]) for r in lows if r["known"])


def encoded(docs: DataFrame, tokenizer: str, lows: tuple[list[int], list[tuple]], end_id: int = END_ID) -> DataFrame:
    """(part, doc_id, h, width, ids) of rows (doc_id, text): each text's ids with the end id, as little-endian integers
    of ``width`` bytes, and the number of the range the row is in."""
    sent, kind = docs.sparkSession.sparkContext.broadcast(lows), docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, lows = encoder(tokenizer), sent.value
        for batch in slices(batches, "text", 1 << 20):
            ids, bounds = enc.encode(*utf8(batch.column("text")))
            payloads = [one.tobytes() for one in texts(ids, bounds, end_id)]
            n, keys = batch.num_rows, zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), strict=True)
            parts = [_range_of(lows, i, h) for i, h in keys]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), batch.column("doc_id"), batch.column("h"), pa.array([enc.dtype.itemsize] * n, pa.int32()), pa.array(payloads, pa.binary())], names=["part", "doc_id", "h", "width", "ids"])

    return docs.withColumn("h", F.xxhash64("text")).mapInArrow(encode, f"part int, doc_id {kind}, h long, width int, ids binary")


def _range_of(lows: tuple[list[int], list[tuple]], doc_id, h: int) -> int:
    """The number of the last range that does not begin above the row."""
    unknown, known = lows
    return max(0, bisect_right(unknown, h) - 1 if doc_id is None else len(unknown) + bisect_right(known, (doc_id, h)) - 1)


def write_records(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode and write all texts in ascending id order; returns the index:
    (doc_id, file, at, n_bytes, n_tokens, start, width). ``folder`` must be reachable by all executors.

    Texts are encoded where they are read; what is dealt to ranges of about ``file_bytes`` bytes of text and sorted are
    ids, half as many bytes, and the workers that write them hold no tokenizer."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "records")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, at, start, out = f"ids-{uuid.uuid4().hex}.rec", 0, 0, None
        for batch in slices(batches, "ids", 1 << 22):
            if out is None:
                system, root = _open(folder)
                system.create_dir(root, recursive=True)
                out = system.open_output_stream(f"{root}/{name}")
            ats, sizes, counts, starts = [], [], [], []
            for payload, width in zip(batch.column("ids"), batch.column("width").to_pylist(), strict=True):
                record = frame(payload.as_py())
                out.write(record)
                ats.append(at)
                sizes.append(len(record))
                counts.append((len(record) - AROUND) // width)
                starts.append(start)
                at += sizes[-1]
                start += counts[-1]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array([name] * n), pa.array(ats, pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(starts, pa.int64()), batch.column("width")],
                names=["doc_id", "part", "name", "at", "n_bytes", "n_tokens", "part_start", "width"],
            )
        if out is not None:
            out.close()

    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lows = ranges(own, max(1, -(-total // file_bytes)))
    ordered = encoded(own, tokenizer, lows, end_id).repartitionById(max(1, sum(map(len, lows))), "part").sortWithinPartitions("doc_id", "h")
    index = written(ordered.mapInArrow(write, f"doc_id {kind}, part int, name string, at long, n_bytes long, n_tokens long, part_start long, width int"), "index")
    # one row for each file: the running total over files is small whatever the number of documents
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    return index.join(F.broadcast(bases), "part").select("doc_id", F.concat(F.lit(folder.rstrip("/") + "/"), "name").alias("file"), "at", "n_bytes", "n_tokens", (F.col("base") + F.col("part_start")).alias("start"), "width")


def _payloads(batches: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The rows of an index, about ``most`` bytes of records at a time, with their payloads; every checksum is verified."""
    name, source = None, None
    for batch in batches:
        ends = np.cumsum(batch.column("n_bytes").to_numpy())
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            some, payloads = batch.slice(at, upto - at), []
            for file, place, size in zip(*(some.column(c).to_pylist() for c in ("file", "at", "n_bytes")), strict=True):
                if file != name:
                    system, path = _open(file)
                    name, source = file, system.open_input_file(path)
                payloads.append(unframe(source.read_at(size, place)))
            yield some, payloads
            at = upto


def read_records(index: DataFrame) -> DataFrame:
    """The index rows with ``ids`` (binary, little endian, ``width`` bytes each), read from the files by their
    offsets in whatever order the rows come."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, payloads in _payloads(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary())], names=[*batch.schema.names, "ids"])

    return index.mapInArrow(read, ", ".join(f"`{n}` {t}" for n, t in index.dtypes) + ", ids binary")


def record_digests(index: DataFrame) -> DataFrame:
    """Per record, read back from its file: doc_id, start, n_tokens, ids_crc32 (over 32-bit ids)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, payloads in _payloads(batches):
            ids = [np.frombuffer(p, f"<u{width}") for p, width in zip(payloads, batch.column("width").to_pylist(), strict=True)]
            crcs, counts = [zlib.crc32(i.astype("<u4").tobytes()) for i in ids], [len(i) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = index.schema["doc_id"].dataType.simpleString()
    return index.mapInArrow(digest, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
