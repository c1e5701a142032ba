"""Frame arithmetic and record codecs as column expressions.

A record is framed as uvarint(length), payload, 8-byte checksum. Everything here is plain Catalyst
expressions, so it fuses into the surrounding whole-stage code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHECKSUM_BYTES = 8
HEADER_BYTES = 64
STAMP_BYTES = 8


def uvarint_len(length: Column) -> Column:
    """Bytes of an unsigned varint: 7 bits a byte."""
    out = F.lit(9)  # lengths are below 2^63
    for n in range(8, 0, -1):
        out = F.when(length < F.lit(1 << (7 * n)), F.lit(n)).otherwise(out)
    return out.cast("long")


def framed_len(length: Column, stamped: bool = False) -> Column:
    """Framed size of a payload of `length` bytes; an enqueue stamp counts inside the payload."""
    inner = length.cast("long") + (STAMP_BYTES if stamped else 0)
    return uvarint_len(inner) + inner + CHECKSUM_BYTES


def frame(rows: DataFrame, payload: Column, stamped: bool = False) -> DataFrame:
    """Adds payload, payload_len, framed_len, checksum (md5 of the payload, hex). A null payload is empty."""
    body = F.coalesce(payload, F.lit(""))
    out = rows.withColumn("payload", body).withColumn("payload_len", F.octet_length("payload").cast("long"))
    return out.withColumn("framed_len", framed_len(F.col("payload_len"), stamped)).withColumn("checksum", F.md5(F.col("payload").cast("binary")))


def encode(columns: list[str]) -> Column:
    """Any columns as one JSON payload."""
    return F.to_json(F.struct(*columns))


def decode(payload: Column, schema: str) -> Column:
    """The payload as a struct of `schema`; null where it cannot be decoded (see with_codec_error)."""
    return F.from_json(payload.cast("string"), schema, {"mode": "PERMISSIVE"})


def with_codec_error(rows: DataFrame, payload: str, schema: str, column: str = "value") -> DataFrame:
    """Decoded `column` and boolean _codec_error: the payload does not decode, so its record stays at the head."""
    strict = schema + ", _bad string"
    parsed = F.from_json(F.col(payload).cast("string"), strict, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = rows.withColumn("_parsed", parsed)
    bad = F.col("_parsed").isNull() | F.col("_parsed._bad").isNotNull()
    return out.withColumn("_codec_error", bad).withColumn(column, F.when(~bad, F.col("_parsed").dropFields("_bad"))).drop("_parsed")


def age_us(now: Column, stamp: Column) -> Column:
    """Waiting time in microseconds; a clock that went back gives 0."""
    return F.greatest(F.unix_micros(now.cast("timestamp")) - F.unix_micros(stamp.cast("timestamp")), F.lit(0).cast("long"))


def segment_capacity(size: int) -> int:
    """Effective segment size: 8 MiB by default, 4096 at least, rounded up to 4096, below 2**48."""
    if size <= 0:
        return 8 << 20
    return min(-(-max(size, 4096) // 4096) * 4096, (1 << 48) - 4096)


def max_segments(option: int) -> int:
    """0 means 32, a negative number means no bound (0)."""
    return 32 if option == 0 else max(0, option)
