"""Media columns: telephony audio.

A payload of bytes is kept as the data of a WAV file in one of three telephony codings, each of which takes any bytes:
mu-law and A-law (one sample a byte) and IMA ADPCM (blocks of 64 bytes). Reading expands mu-law and A-law by lookup
tables, decodes ADPCM blocks side by side with numpy, and resamples the 16-bit PCM.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_columns

BLOCK = 64
SAMPLES_A_BLOCK = 2 * (BLOCK - 4) + 1
#: The format codes of WAV files.
FORMATS = {"pcm": 0x0001, "alaw": 0x0006, "mulaw": 0x0007, "ima_adpcm": 0x0011}
CODECS = ("mulaw", "alaw", "ima_adpcm")
#: IMA ADPCM's step sizes and the changes of the step's index.
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], dtype=np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: the linear value of each code."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: the linear value of each code."""
    code = np.arange(256) ^ 0x55
    segment = (code & 0x70) >> 4
    size = ((code & 0x0F) << 4) + 8
    size = np.where(segment > 0, size + 0x100 << np.maximum(segment - 1, 0), size)
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def adpcm_pcm(data: np.ndarray) -> np.ndarray:
    """Whole blocks of IMA ADPCM as PCM: every step handles one sample of all blocks."""
    blocks = data.reshape(-1, BLOCK)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    codes = np.empty((SAMPLES_A_BLOCK - 1, len(blocks)), dtype=np.uint8)
    body = blocks[:, 4:].T
    codes[0::2], codes[1::2] = body & 15, body >> 4
    out = np.empty((SAMPLES_A_BLOCK, len(blocks)), dtype=np.int16)
    out[0] = value
    for i, code in enumerate(codes, 1):
        step = STEPS[index]
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + MOVES[code & 7], 0, len(STEPS) - 1)
        out[i] = value
    return np.ascontiguousarray(out.T).reshape(-1)


def expand(codec: str, data: np.ndarray) -> np.ndarray:
    return adpcm_pcm(data) if codec == "ima_adpcm" else TABLES[codec][data]


def resample(pcm: np.ndarray, rate: int, to: int, half: int = 4) -> np.ndarray:
    """PCM at another rate, by a windowed sinc of 2*half taps in 14-bit integers, so that all machines agree."""
    up, down = to // gcd(rate, to), rate // gcd(rate, to)
    n = len(pcm) * up // down
    padded = np.concatenate([np.zeros(half, np.int32), pcm.astype(np.int32), np.zeros(half + 1, np.int32)])
    out = np.empty(n, dtype=np.int16)
    cut = min(1.0, up / down)
    for phase in range(up):
        at = np.arange(phase, n, up) * down
        whole, part = at // up, (at[0] % up) / up if len(at) else 0.0
        if not len(at):
            continue
        x = np.arange(1 - half, half + 1) - part
        taps = cut * np.sinc(cut * x) * np.cos(np.pi * x / (2 * half + 1)) ** 2
        taps = np.rint(taps / taps.sum() * 16384).astype(np.int32)
        step = whole[1] - whole[0] if len(whole) > 1 else 1
        total = np.full(len(at), 8192, dtype=np.int32)
        for j, tap in enumerate(taps):
            if tap:
                lo = whole[0] + j + 1
                total += tap * padded[lo : lo + step * (len(at) - 1) + 1 : step]
        out[phase::up] = np.clip(total >> 14, -32768, 32767)
    return out


def wav(codec: str, data: bytes, rate: int, samples: int) -> bytes:
    code = FORMATS[codec]
    if codec == "pcm":
        form = struct.pack("<HHIIHH", code, 1, rate, 2 * rate, 2, 16)
        fact = b""
    elif codec == "ima_adpcm":
        form = struct.pack("<HHIIHHHH", code, 1, rate, rate * BLOCK // SAMPLES_A_BLOCK, BLOCK, 4, 2, SAMPLES_A_BLOCK)
        fact = b"fact" + struct.pack("<II", 4, samples)
    else:
        form = struct.pack("<HHIIHHH", code, 1, rate, rate, 1, 8, 0)
        fact = b"fact" + struct.pack("<II", 4, samples)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wav(file: bytes) -> tuple[str, int, bytes]:
    """The codec, rate and data of a WAV file that has one channel."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, rate = 12, None, 0
    while at + 8 <= len(file):
        name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if name == b"fmt ":
            code, channels, rate = struct.unpack_from("<HHI", file, at + 8)
            codec = {v: k for k, v in FORMATS.items()}.get(code)
            if codec is None or channels != 1:
                raise ValueError(f"format {code} with {channels} channels is not supported")
        elif name == b"data":
            if codec is None or at + 8 + size > len(file):
                raise ValueError("the data chunk is cut short or comes before its format")
            return codec, rate, file[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def pad(payload: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the block size."""
    return payload + b"\0" * (-len(payload) % BLOCK or (0 if payload else BLOCK))


def store_audio(df: DataFrame, payload: str = "payload", media: str = "media", codec: str | None = None, rate: int = 8000) -> DataFrame:
    """df with `media` (binary): a WAV file whose data are the payload, padded by zero bytes to whole blocks.

    With codec None the payload's block count picks mu-law, A-law or IMA ADPCM in turn, so equal payloads have equal files.
    Null and empty payloads make one block of zeros. A column already named `media` is replaced; others pass through.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            out = []
            for x in b.column(b.schema.get_field_index(payload)).cast(pa.binary()).to_pylist():
                data = pad(x or b"")
                kind = codec or CODECS[len(data) // BLOCK % len(CODECS)]
                out.append(wav(kind, data, rate, len(data) // BLOCK * SAMPLES_A_BLOCK if kind == "ima_adpcm" else len(data)))
            yield [pa.array(out, pa.binary())]

    return with_columns(df, payload, [T.StructField(media, T.BinaryType(), True)], fill)


def _decoded(files: list[bytes | None]) -> list[tuple[str, int, bytes, np.ndarray] | None]:
    """Each file's codec, rate, data and PCM; files of one codec are expanded together."""
    parsed = [parse_wav(f) if f is not None else None for f in files]
    pcm: list = [None] * len(files)
    for codec in {p[0] for p in parsed if p}:
        at = [i for i, p in enumerate(parsed) if p and p[0] == codec]
        if codec == "pcm":
            for i in at:
                pcm[i] = np.frombuffer(parsed[i][2], dtype="<i2")
            continue
        whole = expand(codec, np.frombuffer(b"".join(parsed[i][2] for i in at), dtype=np.uint8))
        scale = SAMPLES_A_BLOCK / BLOCK if codec == "ima_adpcm" else 1
        ends = np.cumsum([round(len(parsed[i][2]) * scale) for i in at])
        for i, a, e in zip(at, [0, *ends[:-1]], ends):
            pcm[i] = whole[a:e]
    return [p and (*p, x) for p, x in zip(parsed, pcm)]


#: Bytes of media decoded at a time.
AT_A_TIME = 8_000_000


def _chunks(column: list[bytes | None]) -> Iterator[list[bytes | None]]:
    some, n = [], 0
    for x in column:
        some.append(x)
        n += len(x or b"")
        if n >= AT_A_TIME:
            yield some
            some, n = [], 0
    if some:
        yield some


def features(codec: str, pcm: np.ndarray, to: np.ndarray, to_rate: int) -> str:
    """Codec, samples, peak, energy and sign changes, then count and CRC of the resampled PCM."""
    x = pcm.astype(np.int64)
    rms = int(np.sqrt(int(x @ x) / max(1, len(x))))
    turns = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{codec};n={len(pcm)};peak={int(np.abs(x).max(initial=0))};rms={rms};turns={turns};rate={to_rate};m={len(to)};crc={zlib.crc32(to.astype('<i2').tobytes()):08x}"


def read_audio(df: DataFrame, media: str = "media", rate: int = 16000, payload: str = "payload", feature: str = "feature", pcm: str | None = None) -> DataFrame:
    """df with the stored payload and a feature string of every WAV file in `media`; with `pcm`, also a WAV file of the resampled PCM.

    Null media give nulls; a file that is no WAV file of a known format is an error. Files are read whole, of any length,
    some megabytes of them at a time. Columns of the same names are replaced; an empty table gives no rows.
    """
    fields = [T.StructField(payload, T.BinaryType(), True), T.StructField(feature, T.StringType(), True)]
    if pcm:
        fields.append(T.StructField(pcm, T.BinaryType(), True))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            out: tuple[list, list, list] = [], [], []
            for files in _chunks(b.column(b.schema.get_field_index(media)).to_pylist()):
                for x in _decoded(files):
                    if x is None:
                        new = (None, None, None)
                    else:
                        codec, own, data, sound = x
                        other = resample(sound, own, rate)
                        new = (data, features(codec, sound, other, rate), wav("pcm", other.astype("<i2").tobytes(), rate, len(other)) if pcm else None)
                    for o, v in zip(out, new):
                        o.append(v)
            yield [pa.array(o, pa.string() if i == 1 else pa.binary()) for i, o in enumerate(out[: len(fields)])]

    return with_columns(df, media, fields, fill)


def media_digests(docs: DataFrame) -> DataFrame:
    """Stores every text's UTF-8 bytes as audio, reads them back, and returns lengths, digests and features by doc_id.

    pcm_bytes and pcm_sha256 are of the stored WAV file of the resampled PCM. Null texts are empty, and empty ones make one
    block; texts are whole, of any length; one row per row of docs, also for null and repeated ids; columns other than
    doc_id and text are not read; an empty table gives no rows.
    """
    stored = store_audio(docs.select("doc_id", F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("payload")))
    kept = stored.select("doc_id", F.length("payload").cast("long").alias("n_bytes"), "media")
    back = read_audio(kept, pcm="pcm")
    return back.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -BLOCK, BLOCK)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.length("pcm").cast("long").alias("pcm_bytes"),
        F.sha2("pcm", 256).alias("pcm_sha256"),
    )
