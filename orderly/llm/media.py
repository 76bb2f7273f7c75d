"""Media columns: telephony audio.

A payload of bytes is kept as the coded samples of a WAV file: mu-law or A-law (one byte a sample) or IMA ADPCM (blocks
of a header and two samples a byte). Stored bytes are read back by parsing the container; companded samples expand by
lookup tables of 256 entries, ADPCM blocks are decoded together, one numpy step for the same position of all blocks.
PCM is resampled from 8 to 16 kHz by a half-band filter (the even samples are the input, odd ones lie between) and
stored as 16-bit WAV; features are computed from the samples in that file.

The codec follows from the payload (crc32 modulo 3), so equal texts give equal media. Null texts count as empty, and
an empty payload is one block of padding. Any bytes are valid input to every decoder: step indices beyond the table are clamped.
All work is a function of one row, in pieces of bounded size, without a shuffle; columns other than the text are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderly.session import bounded_batches

UNIT = 192
RATE = 8000
MULAW, ALAW, ADPCM = 7, 6, 17
CODECS = (MULAW, ALAW, ADPCM)
NAMES = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "ima_adpcm"}

# Fixed values of IMA ADPCM: the change of the step index by code, and the steps.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2)
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130,
        143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282,
        1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630,
        9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ]
)
# Odd taps of the half-band filter, outward from the middle: a windowed sinc whose sum over both sides is one.
HALF_TAPS = 6


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int64) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int64) ^ 0x55
    segment, low = (code & 0x70) >> 4, (code & 0x0F) << 4
    size = np.where(segment == 0, low + 8, (low + 0x108) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def filter_taps() -> np.ndarray:
    k = np.arange(HALF_TAPS) + 0.5
    taps = np.sin(np.pi * k) / (np.pi * k) * np.cos(np.pi * k / (2 * HALF_TAPS + 1)) ** 2
    return taps / (2 * taps.sum())


def wav(codec: int, payload: bytes) -> bytes:
    """A WAV file of the payload as coded samples."""
    if codec == ADPCM:
        per_block = 2 * (UNIT - 4) + 1
        samples = len(payload) // UNIT * per_block
        fmt = struct.pack("<HHIIHHHH", codec, 1, RATE, RATE * UNIT // per_block, UNIT, 4, 2, per_block)
    else:
        samples = len(payload)
        fmt = struct.pack("<HHIIHHH", codec, 1, RATE, RATE, 1, 8, 0)
    chunks = b"".join(name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2) for name, data in ((b"fmt ", fmt), (b"fact", struct.pack("<I", samples)), (b"data", payload)))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def pcm_wav(samples: np.ndarray, rate: int) -> bytes:
    """A WAV file of 16-bit samples."""
    data = samples.astype("<i2").tobytes()
    fmt = struct.pack("<HHIIHH", 1, 1, rate, 2 * rate, 2, 16)
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wav(stored: bytes) -> tuple[int, bytes]:
    """The codec and the coded samples of a WAV file."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, data = 12, 0, b""
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], struct.unpack("<I", stored[at + 4 : at + 8])[0]
        if name == b"fmt ":
            codec = struct.unpack("<H", stored[at + 8 : at + 10])[0]
        elif name == b"data":
            data = stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return codec, data


def decode_blocks(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM blocks, (blocks, bytes), to samples, (blocks, samples): all blocks advance together."""
    predictor = blocks[:, :2].copy().view("<i2").astype(np.int64)[:, 0]
    index = np.minimum(blocks[:, 2].astype(np.int64), len(STEPS) - 1)
    codes = np.stack([blocks[:, 4:] & 15, blocks[:, 4:] >> 4], 2).reshape(len(blocks), -1)
    codes = np.ascontiguousarray(codes.T).astype(np.int64)
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = predictor
    for t, code in enumerate(codes):
        step = STEPS[index]
        change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
        predictor = np.clip(np.where(code & 8, predictor - change, predictor + change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code], 0, len(STEPS) - 1)
        out[t + 1] = predictor
    return np.ascontiguousarray(out.T)


def decode(codec: int, data: bytes) -> np.ndarray:
    """Coded samples as 16-bit PCM at 8 kHz."""
    raw = np.frombuffer(data, np.uint8)
    return decode_blocks(raw.reshape(-1, UNIT)).reshape(-1) if codec == ADPCM else TABLES[codec][raw]


def resample(pcm: np.ndarray) -> np.ndarray:
    """16-bit PCM at twice the rate."""
    taps, n = filter_taps().astype(np.float32), len(pcm)
    wide = np.pad(pcm.astype(np.float32), (HALF_TAPS - 1, HALF_TAPS), mode="edge")
    between = np.zeros(n, np.float32)
    for k, tap in enumerate(taps):
        between += tap * (wide[HALF_TAPS - 1 - k : HALF_TAPS - 1 - k + n] + wide[HALF_TAPS + k : HALF_TAPS + k + n])
    out = np.empty(2 * n, np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip(np.rint(between), -32768, 32767).astype(np.int16)
    return out


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's bytes, padded by spaces to a positive multiple of the unit, and their number before."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b" "), len(data)


MEDIA = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
DIGEST = T.StructType(
    [T.StructField(n, t) for n, t in (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("pcm_bytes", T.LongType()), ("pcm_sha256", T.StringType()))]
)


def encode_text(docs: DataFrame, text_col: str = "text", out: str = "media") -> DataFrame:
    """docs with a struct column ``out``: n_bytes of the text and the media file that holds it."""

    bounded_batches(docs.sparkSession)

    @F.pandas_udf(MEDIA)
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                payload, n = payload_of(text)
                rows.append((n, wav(CODECS[zlib.crc32(payload) % len(CODECS)], payload)))
            yield pd.DataFrame(rows, columns=MEDIA.fieldNames())

    return docs.withColumn(out, coded.asNondeterministic()(F.col(text_col).cast("string")))


def decode_all(media: list[bytes | None]) -> list[np.ndarray | None]:
    """16-bit PCM at 8 kHz of WAV files. The ADPCM blocks of all files are decoded together, about a megabyte at a time."""
    out: list[np.ndarray | None] = [None] * len(media)
    group: list[tuple[int, bytes]] = []

    def flush() -> None:
        blocks = np.frombuffer(b"".join(data for _, data in group), np.uint8).reshape(-1, UNIT)
        ends = np.cumsum([len(data) // UNIT for _, data in group])
        for (i, _), samples in zip(group, np.split(decode_blocks(blocks), ends[:-1]), strict=True):
            out[i] = samples.reshape(-1)
        group.clear()

    size = 0
    for i, stored in enumerate(media):
        if stored is None:
            continue
        codec, data = read_wav(stored)
        if codec != ADPCM:
            out[i] = decode(codec, data)
            continue
        group.append((i, data))
        size += len(data)
        if size > 1_000_000:
            flush()
            size = 0
    if group:
        flush()
    return out


def pcm_files(media: list[bytes | None]) -> list[bytes | None]:
    """The files resampled to 16 kHz, as 16-bit WAV files."""
    return [None if pcm is None else pcm_wav(resample(pcm), 2 * RATE) for pcm in decode_all(media)]


def decode_media(docs: DataFrame, media_col: str = "media", out: str = "pcm") -> DataFrame:
    """docs with a binary column ``out``: the media resampled to 16 kHz, as a 16-bit WAV file (null for null media)."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(T.BinaryType())
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for media in batches:
            yield pd.Series(pcm_files(media.tolist()), dtype=object)

    return docs.withColumn(out, decoded.asNondeterministic()(F.col(media_col)))


def features(codec: int, samples: np.ndarray) -> str:
    """The codec, the number of samples, their root mean square and peak, zero crossings and checksum."""
    wide = samples.astype(np.int64)
    crossings = int(((wide[1:] >= 0) != (wide[:-1] >= 0)).sum())
    rms = (float(np.dot(wide, wide)) / max(1, len(wide))) ** 0.5
    return f"{NAMES[codec]};samples={len(wide)};rms={rms:.3f};peak={int(np.abs(wide).max(initial=0))};crossings={crossings};crc32={zlib.crc32(samples.astype('<i2').tobytes())}"


def digest_rows(media: list[bytes | None], pcm: list[bytes | None]) -> pd.DataFrame:
    """What reading the stored bytes of media and PCM back gives (null where either is)."""
    rows = []
    for m, p in zip(media, pcm, strict=True):
        if m is None or p is None:
            rows.append((None,) * len(DIGEST))
            continue
        codec, data = read_wav(m)
        samples = np.frombuffer(read_wav(p)[1], "<i2")
        rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(m), hashlib.sha256(m).hexdigest(), features(codec, samples), len(p), hashlib.sha256(p).hexdigest()))
    return pd.DataFrame(rows, columns=DIGEST.fieldNames()).astype({f.name: "Int64" for f in DIGEST.fields if f.dataType == T.LongType()})


def digest(docs: DataFrame, media_col: str = "media", pcm_col: str | None = None, out: str = "digest") -> DataFrame:
    """docs with a struct column ``out``: what reading the stored bytes of media and PCM back gives (null media: null). Without
    ``pcm_col`` the PCM files are made as decode_media makes them and read back in the same task, which spares a
    column of five times the media's size."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(DIGEST)
    def of_both(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for media, pcm in batches:
            yield digest_rows(media.tolist(), pcm.tolist())

    @F.pandas_udf(DIGEST)
    def of_media(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for media in batches:
            files = media.tolist()
            parts = [files[k : k + 100] for k in range(0, len(files), 100)]  # so that few PCM files are held at a time
            yield pd.concat([digest_rows(part, pcm_files(part)) for part in parts] or [digest_rows([], [])], ignore_index=True)

    if pcm_col is None:
        return docs.withColumn(out, of_media.asNondeterministic()(F.col(media_col)))
    return docs.withColumn(out, of_both.asNondeterministic()(F.col(media_col), F.col(pcm_col)))
