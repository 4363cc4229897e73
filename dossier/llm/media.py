"""Media columns: bytes stored as WAV, and audio fingerprints computed from what the files hold.

`as_wav` writes the UTF-8 bytes of a text as 8-bit mono samples with the `wave` module, filled up with
spaces to a positive multiple of FRAME, so that every file has one whole frame at least.  `read_wav` reads the
stored bytes back, and `landmarks` makes their fingerprint: a short-time Fourier transform (Hann window
of FRAME samples, a step of HOP), the strongest bin of each of BANDS bands, of these the local maxima in
time (the peaks), and each peak joined with the next FAN peaks that come up to REACH steps later.  A pair
is one long: its first peak's time in the upper 32 bits, and bins and time difference in the lower 20,
so the array is in order of time and its codes can be looked up.

The transform's sine table is rounded to whole numbers small enough for every sum to be exact in 32-bit
floats, whatever the order of addition: equal bytes give equal fingerprints on every machine.  Frames of
many files are transformed by one matrix product; a long file goes through in pieces of PIECE samples,
and only its band maxima are held together.

Defined cases: a null or empty text is a file of FRAME spaces; repeated rows give equal values; a file of
one frame, or without change in time, has the pairs that its peaks give (maybe none); an empty table gives
no rows; columns that bear an output's name are replaced.  A null media value reads as null.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Samples of a frame and between frames; bands of the spectrum; pairs of a peak; most steps between the two; samples a second.
FRAME, HOP, BANDS, FAN, REACH, RATE = 192, 96, 6, 3, 63, 8000
#: Samples transformed at once, and bytes of files read at once.
PIECE, TAKEN = 1 << 20, 4 << 20
_BINS = FRAME // 2


def _table() -> np.ndarray:
    """Windowed cosines and sines of the bins 1 .. FRAME/2, rounded: 192 * 128 * 511 < 2**24."""
    t = np.arange(FRAME)
    angle = 2 * np.pi * np.outer(t, np.arange(1, _BINS + 1)) / FRAME
    window = (0.5 - 0.5 * np.cos(2 * np.pi * t / FRAME))[:, None] * 511
    return np.rint(np.hstack([window * np.cos(angle), window * np.sin(angle)])).astype(np.float32)


TABLE = _table()


def to_wav(payload: bytes) -> bytes:
    """A mono WAV file whose 8-bit samples are these bytes."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("an 8-bit mono file is expected")
        return r.readframes(r.getnframes())


def padded(raw: bytes) -> bytes:
    return raw + b" " * (FRAME - len(raw) if not raw else -len(raw) % FRAME)


def band_maxima(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Power and bin (from 1) of the strongest bin of each band (ties: the lowest), for each step of HOP samples."""
    steps = max(0, len(samples) // HOP - 1)
    power, bins = np.zeros((steps, BANDS), np.int64), np.zeros((steps, BANDS), np.int64)
    width, at_once = _BINS // BANDS, PIECE // HOP
    for lo in range(0, steps, at_once):
        hi = min(steps, lo + at_once)
        part = samples[lo * HOP : (hi - 1) * HOP + FRAME].astype(np.float32) - np.float32(128)
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        got = (np.ascontiguousarray(frames) @ TABLE).astype(np.int64)
        p = (got[:, :_BINS] ** 2 + got[:, _BINS:] ** 2).reshape(hi - lo, BANDS, width)
        best = p.argmax(2)
        power[lo:hi] = np.take_along_axis(p, best[:, :, None], 2)[:, :, 0]
        bins[lo:hi] = best + 1 + width * np.arange(BANDS)
    return power, bins


def peak_pairs(power: np.ndarray, bins: np.ndarray, files: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time-coded pairs of all files, in order, and their number for each file.

    files: the steps of each file; the steps of all lie one after another."""
    steps, begin = len(power), np.cumsum(files) - files
    file = np.repeat(np.arange(len(files)), files)
    first, last = np.zeros(steps, bool), np.zeros(steps, bool)
    first[begin[files > 0]] = True
    last[(begin + files - 1)[files > 0]] = True
    rises, falls = np.ones((steps, BANDS), bool), np.ones((steps, BANDS), bool)
    rises[1:] = (power[1:] > power[:-1]) | first[1:, None]
    falls[:-1] = (power[:-1] >= power[1:]) | last[:-1, None]
    step, band = np.nonzero(rises & falls & (power > 0))
    owner, time, f = file[step], step - begin[file[step]], bins[step, band]
    pairs, of = [], []
    # The next peaks of a later step: those of the same step lie between, BANDS - 1 at most.
    after = np.searchsorted(step, step, "right")
    for k in range(FAN):
        at = after + k
        near = np.flatnonzero(at < len(step))
        there = at[near]
        near, there = near[ok := (owner[there] == owner[near]) & (step[there] - step[near] <= REACH)], there[ok]
        pairs.append(time[near] << 32 | f[near] << 13 | f[there] << 6 | (step[there] - step[near]))
        of.append(near * FAN + k)
    order = np.argsort(np.concatenate(of)) if of else []
    pairs, of = np.concatenate(pairs)[order], np.concatenate(of)[order] // FAN
    return pairs, np.bincount(owner[of], minlength=len(files))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = max(1, TAKEN * batch.num_rows // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def _with(docs: DataFrame, add, fields: list[T.StructField], source: str) -> DataFrame:
    """docs and the columns that add(a column of binary values) gives."""
    names = [f.name for f in fields]
    kept = docs.drop(*[n for n in names if n != source])
    schema = T.StructType([*kept.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, *add(part.column(source))], names=[*part.schema.names, *names])

    return kept.mapInArrow(run, schema)


def as_wav(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs and `media`: the text's UTF-8 bytes, filled up, as a WAV file."""

    def add(column: pa.Array) -> list[pa.Array]:
        raw = column.cast(pa.binary()).to_pylist()
        return [pa.array([to_wav(padded(x or b"")) for x in raw], pa.binary())]

    return _with(docs, add, [T.StructField(media, T.BinaryType())], text)


def read_wav(docs: DataFrame, media: str = "media", payload: str = "payload", landmarks: str = "landmarks") -> DataFrame:
    """docs, `payload` (the samples that the files hold, as bytes) and `landmarks` (array of time-coded peak pairs)."""

    def add(column: pa.Array) -> list[pa.Array]:
        stored = column.to_pylist()
        read = [None if x is None else from_wav(x) for x in stored]
        samples = np.frombuffer(b"".join(x or b"" for x in read), np.uint8)
        sizes = np.array([len(x or b"") for x in read], np.int64)
        power, bins = _of_files(samples, sizes)
        pairs, count = peak_pairs(power, bins, np.maximum(sizes // HOP - 1, 0))
        offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        null = np.array([x is None for x in read], bool)
        return [pa.array(read, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(pairs, pa.int64()), mask=pa.array(null))]

    return _with(docs, add, [T.StructField(payload, T.BinaryType()), T.StructField(landmarks, T.ArrayType(T.LongType()))], media)


def _of_files(samples: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band maxima of files that lie one after another; a step across two files is left out.

    Files whose samples aren't whole steps are transformed one by one, the rest together."""
    if (sizes % HOP == 0).all():
        power, bins = band_maxima(samples)
        inside = np.ones(len(power), bool)
        ends = np.cumsum(sizes) // HOP - 1
        inside[ends[(ends >= 0) & (ends < len(power))]] = False
        return power[inside], bins[inside]
    at = np.cumsum(sizes) - sizes
    each = [band_maxima(samples[a : a + n]) for a, n in zip(at.tolist(), sizes.tolist())]
    return np.concatenate([p for p, _ in each]), np.concatenate([b for _, b in each])
