"""Media columns: payloads kept losslessly as FLAC, and read back as PCM blocks.

A payload is a text's UTF-8 bytes, filled with zeros to a positive multiple of 64; its bytes
are the samples of an 8-bit mono stream. Streams are decoded again, with all checksums, into
PCM blocks that carry the sample offset at which they start, so that a reader can seek; digests
and features are folded over these blocks, whose offsets must follow each other without a gap.
``write_pcm`` keeps blocks as a table, of which ``read_pcm`` reads only those of a sample range.
Everything is done inside a task, some documents at a time; nothing is shuffled.

Defined cases: a null or empty text is 64 zero bytes; equal texts have equal streams and
features; repeated rows are handled one by one; an empty table gives no rows; other columns
are neither read nor returned. A stream or checksum that is broken raises ``FlacError``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import flac
from tessera.llm.common import arrow_schema, as_batch, small_batches, texts_of

UNIT = 64
#: Payload bytes that a task codes at once.
GROUP_BYTES = 2 << 20


def payload(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def blocks_of(samples: bytes, points: np.ndarray) -> list[tuple[int, int | None, memoryview]]:
    """(sample offset, byte offset, samples) of a decoded stream's blocks. Byte offsets count
    from its first frame, and are null if it has no seek table."""
    size, view = int(points["size"][0]) if len(points) else flac.BLOCK, memoryview(samples)
    bytes_at = points["offset"].tolist()
    return [(at, bytes_at[n] if n < len(bytes_at) else None, view[at : at + size]) for n, at in enumerate(range(0, len(samples), size))]


def folded(blocks: list[tuple[int, int | None, memoryview]]) -> dict:
    """Length, digests and feature of blocks that begin at sample 0 and leave no gap."""
    digest, tail, n, whole = hashlib.sha256(), b"", 0, []
    for at, _, pcm in blocks:
        if at != n:
            raise flac.FlacError(f"block at sample {at}, not {n}")
        digest.update(pcm)
        n += len(pcm)
        tail = bytes(pcm[-UNIT:]) if len(pcm) >= UNIT else (tail + bytes(pcm))[-UNIT:]
        whole.append(pcm)
    x = np.frombuffer(b"".join(whole), np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    feature = f"peak={int(np.abs(x).max(initial=0))};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings};blocks={len(blocks)}"
    return {"payload_bytes": n, "payload_sha256": digest.hexdigest(), "tail_crc32": zlib.crc32(tail), "feature": feature, "n_blocks": len(blocks), "last_offset": blocks[-1][0] if blocks else 0}


def _grouped(df: DataFrame, size_of: Callable, schema: str, rows_of: Callable) -> DataFrame:
    """``rows_of(ids, values)`` for groups of some GROUP_BYTES of the second column's values."""
    small_batches(df.sparkSession)
    kinds = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            ids, values = batch.column(0).to_pylist(), size_of(batch)
            start, size = 0, 0
            for i, v in enumerate(values):
                size += len(v)
                if size >= GROUP_BYTES or i + 1 == len(values):
                    yield as_batch(rows_of(ids[start : i + 1], values[start : i + 1]), kinds)
                    start, size = i + 1, 0

    return df.mapInArrow(run, schema)


def _id_kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media) with a FLAC stream for each text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def rows_of(ids, texts):
        return {"id": ids, "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "media": flac.encode([payload(t) for t in texts])}

    out = _grouped(rows, texts_of, f"id {_id_kind(rows, 'id')}, n_bytes bigint, media binary", rows_of)
    return out.withColumnRenamed("id", id_col)


def pcm_blocks(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, block, sample_offset, byte_offset, pcm): decoded blocks with their places in the
    stream (byte offsets count from its first frame; null if it has no seek table)."""
    rows = media.where(F.col(media_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))

    def rows_of(ids, streams):
        out = {k: [] for k in ("id", "block", "sample", "byte", "pcm")}
        for i, decoded in zip(ids, flac.decode(streams), strict=True):
            for n, (at, byte, pcm) in enumerate(blocks_of(*decoded)):
                for column, value in zip(out.values(), (i, n, at, byte, bytes(pcm)), strict=True):
                    column.append(value)
        return out

    schema = f"id {_id_kind(rows, 'id')}, block bigint, sample_offset bigint, byte_offset bigint, pcm binary"
    return _grouped(rows, lambda b: b.column(1).to_pylist(), schema, rows_of).withColumnRenamed("id", id_col)


def write_pcm(media: DataFrame, path: str, id_col: str = "doc_id", media_col: str = "media") -> None:
    """Decoded blocks as Parquet files, those of a stream together and in order."""
    pcm_blocks(media, id_col, media_col).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_pcm(spark: SparkSession, path: str, start: int, stop: int, id_col: str = "doc_id") -> DataFrame:
    """(id, sample_offset, pcm): samples ``start`` to before ``stop`` of each stream, as pieces of
    its blocks; the bounds reach the scan, so files and row groups beside them aren't read. A range
    past a stream's end gives what is there."""
    rows = spark.read.parquet(path)
    widest = rows.agg(F.max(F.length("pcm"))).first()[0] or 0  # one number
    rows = rows.where((F.col("sample_offset") < stop) & (F.col("sample_offset") > start - widest))
    cut = F.greatest(F.lit(start) - F.col("sample_offset"), F.lit(0))
    n = F.least(F.length("pcm").cast("bigint"), F.lit(stop) - F.col("sample_offset")) - cut
    return rows.where(n > 0).select(id_col, (F.col("sample_offset") + cut).alias("sample_offset"), F.substr("pcm", (cut + 1).cast("int"), n.cast("int")).alias("pcm"))


def media_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature,
    n_blocks, last_offset) of (id, n_bytes, media), from the PCM blocks that are read back;
    ``last_offset`` is the sample at which the last block begins."""
    rows = media.select(F.col(id_col).alias("id"), "media", "n_bytes")

    def rows_of(ids, pairs):
        streams = [p.media for p in pairs]
        read = [folded(blocks_of(*decoded)) for decoded in flac.decode(streams)]
        column = lambda name: [r[name] for r in read]
        return {
            "id": ids, "n_bytes": [p.n_bytes for p in pairs], **{c: column(c) for c in ("payload_bytes", "payload_sha256", "tail_crc32")},
            "media_bytes": [len(m) for m in streams], "media_sha256": [hashlib.sha256(m).hexdigest() for m in streams],
            **{c: column(c) for c in ("feature", "n_blocks", "last_offset")},
        }

    schema = f"id {_id_kind(rows, 'id')}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_blocks bigint, last_offset bigint"
    return _grouped(rows, lambda b: [_Pair(m, n) for m, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)], schema, rows_of).withColumnRenamed("id", id_col)


class _Pair:
    """A stream with its text's length; as long as the stream."""

    def __init__(self, media: bytes, n_bytes: int):
        self.media, self.n_bytes = media, n_bytes

    def __len__(self) -> int:
        return len(self.media)
