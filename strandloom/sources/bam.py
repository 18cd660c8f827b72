"""Binary alignments: records as bytes, packed and read in Arrow functions."""

from __future__ import annotations

import gzip
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The magic, the codes of bases and of CIGAR operations.
MAGIC, BASES, OPS = b"BAM\x01", "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
RECORD = "name string, flag int, ref_id int, pos int, mapq int, cigar string, sequence string, quality string"


def pack_record(name: str, flag: int, ref_id: int, pos: int, mapq: int, cigar: str, sequence: str, quality: str | None) -> bytes:
    """One record with its length before it; pos from 0. A missing quality is filled with 255, as readers expect."""
    ops, n = [], ""
    for c in cigar or "":
        if c.isdigit():
            n += c
        else:
            ops.append(int(n or 0) << 4 | max(0, OPS.find(c)))
            n = ""
    codes = [max(0, BASES.find(c)) if c in BASES else 15 for c in sequence.upper()] + [0] * (len(sequence) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    qual = bytes(ord(c) - 33 for c in quality) if quality else b"\xff" * len(sequence)
    body = struct.pack("<iiBBHHHiiii", ref_id, pos, len(name) + 1, mapq, 0, len(ops), flag, len(sequence), -1, -1, 0)
    body += name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + qual
    return struct.pack("<i", len(body)) + body


def pack(references: list[tuple[str, int]], records: list[bytes], header: str = "") -> bytes:
    out = MAGIC + struct.pack("<i", len(header)) + header.encode() + struct.pack("<i", len(references))
    for name, size in references:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size)
    return gzip.compress(out + b"".join(records), mtime=0)


def unpack(data: bytes) -> tuple[str, list[tuple[str, int]], list[dict]]:
    """Header text, references and records."""
    raw = gzip.decompress(data)
    if raw[:4] != MAGIC:
        raise ValueError("not a binary alignment")
    (size,) = struct.unpack_from("<i", raw, 4)
    header, at = raw[8 : 8 + size].decode(), 8 + size
    (count,) = struct.unpack_from("<i", raw, at)
    at, refs, out = at + 4, [], []
    for _ in range(count):
        (size,) = struct.unpack_from("<i", raw, at)
        name = raw[at + 4 : at + 3 + size].decode()
        refs.append((name, struct.unpack_from("<i", raw, at + 4 + size)[0]))
        at += 8 + size
    while at + 4 <= len(raw):
        (size,) = struct.unpack_from("<i", raw, at)
        ref_id, pos, name_n, mapq, _, ops_n, flag, seq_n, _, _, _ = struct.unpack_from("<iiBBHHHiiii", raw, at + 4)
        p = at + 36
        name = raw[p : p + name_n - 1].decode()
        p += name_n
        ops = struct.unpack_from(f"<{ops_n}I", raw, p)
        p += 4 * ops_n
        seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in raw[p : p + (seq_n + 1) // 2])[:seq_n]
        p += (seq_n + 1) // 2
        qual = raw[p : p + seq_n]
        out.append({"name": name, "flag": flag, "ref_id": ref_id, "pos": pos, "mapq": mapq, "cigar": "".join(f"{o >> 4}{OPS[o & 15]}" for o in ops), "sequence": seq, "quality": None if not qual or qual[0] == 255 else "".join(chr(q + 33) for q in qual)})
        at += 4 + size
    return header, refs, out


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of each file; a file is read whole, in one task."""

    @F.pandas_udf(f"array<struct<{RECORD.replace(' string', ':string').replace(' int', ':int')}>>")
    def records(content: pd.Series) -> pd.Series:
        return pd.Series([unpack(bytes(c))[2] for c in content])

    return spark.read.format("binaryFile").load(path).select("path", F.explode(records("content")).alias("r")).select("path", "r.*")


def packed_records(rows: DataFrame) -> DataFrame:
    """rows (named as in RECORD) with `packed`, the record's bytes."""

    @F.pandas_udf("binary")
    def run(r: pd.DataFrame) -> pd.Series:
        return pd.Series([pack_record(*x) for x in r.itertuples(index=False, name=None)])

    return rows.withColumn("packed", run(F.struct(*(c.split()[0] for c in RECORD.split(", ")))))
