"""Audio columns: WAV bytes in and out, short-time Fourier transforms, and spectral-peak pair fingerprints.

A frame's loudest bin in each of a few frequency bands is a peak; peaks are paired with peaks of the next frames, and
every pair (two bins and their distance) is stored with the frame at which it starts: two arrays of one length.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME, HOP, RATE = 576, 288, 8000
#: Bounds of the frequency bands, in bins.
BANDS = (2, 18, 48, 112, 289)
#: A pair joins a peak to the next band's peak this many frames later.
STEPS = (1, 2)
#: Power below which a band is silent: about what rounding leaves of a constant level.
SILENT = 1.0
_WINDOW = np.hanning(FRAME).astype(np.float32)
_FRAMES_AT_ONCE = 4096


def write_wav(samples: bytes, rate: int = RATE) -> bytes:
    """One channel of unsigned 8-bit samples as a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def read_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Samples and rate of a WAV file with one channel of 8 bits."""
    with wave.open(io.BytesIO(data)) as w:
        if w.getnchannels() != 1 or w.getsampwidth() != 1:
            raise ValueError("one channel of 8-bit samples is expected")
        return np.frombuffer(w.readframes(w.getnframes()), np.uint8), w.getframerate()


def peaks(samples: np.ndarray) -> np.ndarray:
    """frames x bands: the loudest bin of each band in each frame, 0 where a band holds nothing above ``SILENT``."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.empty((len(frames), len(BANDS) - 1), np.int32)
    for at in range(0, len(frames), _FRAMES_AT_ONCE):
        block = (frames[at : at + _FRAMES_AT_ONCE].astype(np.float32) - np.float32(128)) * _WINDOW
        spectrum = np.fft.rfft(block)
        power = spectrum.real**2 + spectrum.imag**2
        for b, (low, high) in enumerate(zip(BANDS[:-1], BANDS[1:])):
            part = power[:, low:high]
            best = np.argmax(part, 1)
            out[at : at + len(block), b] = np.where(part[np.arange(len(part)), best] > SILENT, low + best, 0)
    return out


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers and codes of the peak pairs; audio of a single frame has none."""
    bins = peaks(samples)
    n, bands = bins.shape
    times, codes = [], []
    for step in STEPS:
        if n <= step:
            continue
        a, b = bins[:-step], np.roll(bins[step:], -1, 1)
        heard = ((a > 0) & (b > 0)).reshape(-1)
        codes.append(((a << 12) | (b << 2) | step).reshape(-1)[heard])
        times.append(np.repeat(np.arange(n - step, dtype=np.int32), bands)[heard])
    if not codes:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    time, code = np.concatenate(times), np.concatenate(codes).astype(np.int32)
    order = np.lexsort((code, time))
    return time[order], code[order]


def text_payload(text: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of one frame."""
    return text + b"\xff" * (max(1, -(-len(text) // FRAME)) * FRAME - len(text))


_COLUMNS = (
    ("n_bytes", "long", pa.int64()), ("payload_bytes", "long", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "long", pa.int64()),
    ("media_bytes", "long", pa.int64()), ("media_sha256", "string", pa.string()), ("sample_rate", "int", pa.int32()), ("feature", "string", pa.string()),
)
_ARRAYS = (("pair_time", "array<int>", pa.list_(pa.int32())), ("pair_code", "array<int>", pa.list_(pa.int32())))


def _describe(text: bytes) -> tuple:
    media = write_wav(text_payload(text))
    samples, rate = read_wav(media)
    payload = samples.tobytes()
    time, code = fingerprint(samples)
    digest = hashlib.sha256(time.astype("<i4").tobytes() + code.astype("<i4").tobytes()).hexdigest()
    return (
        len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), rate,
        f"{1 + (len(payload) - FRAME) // HOP}:{len(code)}:{digest}", time, code, media,
    )


def _run(arrays: bool, media: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _COLUMNS + (_ARRAYS if arrays else ()) + ((("media", "binary", pa.binary()),) if media else ())
        picks = list(range(len(_COLUMNS))) + ([8, 9] if arrays else []) + ([10] if media else [])
        step = 256
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                found = [_describe((t.as_py() or "").encode()) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([f[k] for f in found], c[2]) for k, c in zip(picks, columns))], ["doc_id", *(c[0] for c in columns)])

    return run


def text_to_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", arrays: bool = True, media: bool = False) -> DataFrame:
    """Store each whole text's bytes as a WAV file, read it back, and fingerprint it.

    Gives one row per row: doc_id, sizes and hashes of payload and file, ``feature`` (frames, pairs and a digest of the
    fingerprint), the time-coded arrays ``pair_time`` and ``pair_code`` on request, and the file itself on request.
    A null text counts as empty, which is one frame of padding without pairs; equal texts give equal values; repeated
    rows each give a row; a null id stays null; an empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    columns = _COLUMNS + (_ARRAYS if arrays else ()) + ((("media", "binary", None),) if media else ())
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_run(arrays, media), f"doc_id {kind}, " + ", ".join(f"{c[0]} {c[1]}" for c in columns))
