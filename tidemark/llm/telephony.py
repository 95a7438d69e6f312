"""Telephony audio columns: G.711 mu-law and A-law, IMA ADPCM, to resampled PCM.

``store`` puts bytes into RIFF files whose coded samples are those bytes;
``decode`` reads such files (of any origin), expands companded samples by lookup
tables, decodes ADPCM blocks side by side (one numpy step per sample of a block,
over all blocks of a batch) and resamples to the rate asked for.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value

by_value(__name__)

#: RIFF format tags.
A_LAW, MU_LAW, IMA_ADPCM = 6, 7, 17
CODEC_NAMES = {A_LAW: "alaw", MU_LAW: "mulaw", IMA_ADPCM: "ima_adpcm"}
RATE = 8000
#: Bytes of nibbles in an ADPCM block of ours; four header bytes stand before them.
NIBBLES = 192
#: Bytes of media decoded at once in a task.
CHUNK = 1 << 20
#: Fixed values of the IMA ADPCM format: how a code moves the step index.
INDEX_MOVES = [-1, -1, -1, -1, 2, 4, 6, 8, -1, -1, -1, -1, 2, 4, 6, 8]
#: Fixed values of the IMA ADPCM format: the quantizer's steps.
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]


def mu_law_table() -> np.ndarray:
    """The 256 linear values of mu-law codes (16-bit scale)."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """The 256 linear values of A-law codes (16-bit scale)."""
    code = np.arange(256) ^ 0x55
    part, seg = (code & 15) << 4, code >> 4 & 7
    size = np.where(seg == 0, part + 8, (part + 264) << np.maximum(seg - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def store(payload: bytes, codec: int) -> bytes:
    """A mono 8 kHz RIFF file whose coded samples are ``payload``; for ADPCM its length must be a multiple of NIBBLES."""
    if codec == IMA_ADPCM:
        blocks = np.zeros((len(payload) // NIBBLES, NIBBLES + 4), np.uint8)
        blocks[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, NIBBLES)
        data, align, per = blocks.tobytes(), NIBBLES + 4, 2 * NIBBLES + 1
        fmt = struct.pack("<HHIIHHHH", codec, 1, RATE, RATE * align // per, align, 4, 2, per)
        n = len(blocks) * per
    else:
        data, n = payload, len(payload)
        fmt = struct.pack("<HHIIHHH", codec, 1, RATE, RATE, 1, 8, 0)
    chunks = b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) % 2) for k, v in ((b"fmt ", fmt), (b"fact", struct.pack("<I", n)), (b"data", data)))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def pcm_file(pcm: np.ndarray, rate: int) -> bytes:
    """A mono RIFF file of 16-bit PCM."""
    data = pcm.astype("<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(data))
    return head + data


def features(pcm: np.ndarray) -> str:
    """Samples, peak, zero crossings and mean energy of PCM, as samples:peak:crossings:energy."""
    wide = pcm.astype(np.int64)
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{len(pcm)}:{int(np.abs(wide).max(initial=0))}:{crossings}:{int(wide @ wide) // max(len(pcm), 1)}"


def parse(media: bytes) -> tuple[int, int, int, bytes] | None:
    """(codec, rate, block bytes, coded data) of a mono telephony file; None if it isn't one."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, fmt = 12, None
    while at + 8 <= len(media):
        n = struct.unpack_from("<I", media, at + 4)[0]
        if media[at : at + 4] == b"fmt " and n >= 16 and at + 24 <= len(media):
            codec, channels, rate, _, align, _ = struct.unpack_from("<HHIIHH", media, at + 8)
            fmt = (codec, rate, align) if channels == 1 and codec in CODEC_NAMES and rate and align else None
        elif media[at : at + 4] == b"data":
            return (*fmt, media[at + 8 : at + 8 + n]) if fmt else None
        at += 8 + n + n % 2
    return None


def payload_of(codec: int, align: int, data: bytes) -> bytes:
    """The coded samples without block headers."""
    if codec != IMA_ADPCM or align <= 4:
        return data
    whole = len(data) // align * align
    return np.frombuffer(data[:whole], np.uint8).reshape(-1, align)[:, 4:].tobytes()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM blocks (blocks x bytes), all blocks at once, one step per sample."""
    steps, moves = np.array(STEPS, np.int32), np.array(INDEX_MOVES, np.int32)
    head = blocks[:, :4].astype(np.int32)
    value = (head[:, 0] | head[:, 1] << 8).astype(np.uint16).view(np.int16).astype(np.int32)
    index = np.minimum(head[:, 2], 88)
    codes = np.empty((2 * (blocks.shape[1] - 4), len(blocks)), np.uint8)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = value
    for k, code in enumerate(codes):
        step = steps[index]
        move = (step >> 3) + step * (code >> 2 & 1) + (step >> 1) * (code >> 1 & 1) + (step >> 2) * (code & 1)
        value = np.clip(np.where(code & 8, value - move, value + move), -32768, 32767)
        index = np.clip(index + moves[code], 0, 88)
        out[k + 1] = value
    return np.ascontiguousarray(out.T).reshape(-1)


def resample(pcm: np.ndarray, rate: int, to: int, taps: int = 16) -> np.ndarray:
    """Polyphase windowed-sinc resampling of 16-bit PCM; ends are padded with silence."""
    if rate == to or not len(pcm):
        return pcm
    g = np.gcd(rate, to)
    up, down = to // g, rate // g
    n = -(-len(pcm) * up // down)
    cut = min(1.0, to / rate)
    reach = int(np.ceil(taps / 2 / cut))
    padded = np.concatenate([np.zeros(reach, np.float32), pcm.astype(np.float32), np.zeros(reach + 1, np.float32)])
    out = np.empty(n, np.float32)
    for phase in range(up):  # outputs whose place between input samples is the same
        k = np.arange(phase, n, up)
        if not len(k):
            break
        first, frac = phase * down // up, (phase * down % up) / up
        t = np.arange(-reach + 1, reach + 1) - frac
        w = np.sinc(t * cut) * np.cos(np.pi * t / (2 * (reach + 1))) ** 2
        w = (w / w.sum()).astype(np.float32)
        start = first + 1
        got = np.zeros(len(k), np.float32)
        for j, c in enumerate(w):
            got += c * padded[start + j : start + j + down * len(k) : down][: len(k)]
        out[phase::up] = got
    return np.clip(np.rint(out), -32768, 32767).astype(np.int16)


def expand(files: list[tuple[int, int, int, bytes] | None], to: int) -> list[np.ndarray | None]:
    """Resampled PCM of parsed files; ADPCM files of one block size are decoded together."""
    tables = {MU_LAW: mu_law_table(), A_LAW: a_law_table()}
    out: list[np.ndarray | None] = [None] * len(files)
    blocks: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, f in enumerate(files):
        if f is None:
            continue
        codec, rate, align, data = f
        if codec in tables:
            out[i] = tables[codec][np.frombuffer(data, np.uint8)]
        elif align <= 4:
            out[i] = np.empty(0, np.int16)
        else:
            whole = len(data) // align * align
            blocks.setdefault(align, []).append((i, np.frombuffer(data[:whole], np.uint8).reshape(-1, align)))
    for align, parts in blocks.items():
        pcm, at = decode_adpcm(np.concatenate([b for _, b in parts])), 0
        per = 2 * (align - 4) + 1
        for i, b in parts:
            out[i] = pcm[at : at + len(b) * per]
            at += len(b) * per
    return [None if p is None else resample(p, files[i][1], to) for i, p in enumerate(out)]


def telephony_media(payload: Column, codec: Column) -> Column:
    """The RIFF file of a payload by codec, as a column (store() of every row)."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf(T.BinaryType())
    def made(p, c):
        return p.combine(c, lambda x, k: None if x is None else store(x, int(k)))

    return made(payload, codec)


def _split(batch: pa.RecordBatch, column: int):
    """Slices of a batch whose media take about CHUNK bytes."""
    sizes = [len(x) if x is not None else 0 for x in (v.as_buffer() if v.is_valid else None for v in batch.column(column))]
    start = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > CHUNK:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += n
    yield batch.slice(start)


def decode(df: DataFrame, media: str = "media", to: int = 16000, stored: bool = False) -> DataFrame:
    """``df`` with codec, payload (coded samples), rate, sound and pcm (16-bit little-endian at ``to`` Hz) of its media column.

    ``sound``: what ``features`` tells of the resampled PCM. ``stored``: in place
    of pcm a column wav, the resampled PCM as a RIFF file. Rows whose media are
    null, empty, not RIFF, not mono or of another codec get nulls. Parts of an
    ADPCM block at a file's end are left out. Columns of df with the new names
    are replaced.
    """
    last = "wav" if stored else "pcm"
    df = df.drop("codec", "payload", "rate", "sound", last)
    at = df.columns.index(media)
    added = [T.StructField("codec", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("rate", T.IntegerType()), T.StructField("sound", T.StringType()), T.StructField(last, T.BinaryType())]

    def run(batches):
        for whole in batches:
            for batch in _split(whole, at):
                files = [parse(m) if m else None for m in batch.column(at).to_pylist()]
                pcm = expand(files, to)
                put = (lambda p: pcm_file(p, to)) if stored else (lambda p: p.astype("<i2").tobytes())
                cols = [
                    pa.array([f and CODEC_NAMES[f[0]] for f in files], pa.string()),
                    pa.array([f and payload_of(f[0], f[2], f[3]) for f in files], pa.binary()),
                    pa.array([f and to for f in files], pa.int32()),
                    pa.array([None if p is None else features(p) for p in pcm], pa.string()),
                    pa.array([None if p is None else put(p) for p in pcm], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "codec", "payload", "rate", "sound", last])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added]))
