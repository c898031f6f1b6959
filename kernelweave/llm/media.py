"""Texts as 8-bit WAV, short-time Fourier transforms and spectral-peak pair fingerprints.

A text's UTF-8 bytes (null: none), filled with blanks to a positive multiple of 192, are the
samples of a mono 8-bit WAV file written and read by the wave module. Frames of 192 samples,
96 apart, are transformed; peaks are the largest of their neighbourhood in time and frequency;
each is paired with the next ones. A fingerprint holds its time: frame << 18 | bin << 11 |
other bin << 4 | frames between. Texts of one frame may have no pair: an empty array. Equal
texts have equal values, wherever they stand. Columns are added; rows and others stay.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column
from pyspark.sql import functions as F

from kernelweave.llm import textarrays as ta

FRAME, HOP, RATE = 192, 96, 8000
REACH_BINS, REACH_FRAMES, PAIRS, LOWEST_BIN = 8, 1, 2, 3
_WINDOW = np.hanning(FRAME + 1)[:FRAME].astype(np.float32)

COLUMNS = "struct<n_bytes:bigint,payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,fingerprints:array<bigint>>"


def wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def samples(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def spectra(sound: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(levels, owner, time) of each frame of sounds that begin at `at`; levels are whole numbers."""
    n = np.diff(at) // HOP - 1
    owner = np.repeat(np.arange(len(n)), n)
    time = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    frames = sliding_window_view(sound, FRAME)[::HOP][at[owner] // HOP + time]
    mags = np.abs(np.fft.rfft((frames.astype(np.float32) - np.float32(128)) * _WINDOW, axis=1))
    return np.rint(mags * 4).astype(np.int32), owner, time


def peaks(levels: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of levels that no neighbour passes; of equal neighbours the first."""
    n, bins = levels.shape
    ranked = levels * 128 + (127 - np.arange(bins, dtype=np.int32))  # no ties in a frame
    ranked[:, :LOWEST_BIN] = -1
    best = np.full((n, bins + 2 * REACH_BINS), -1, np.int32)
    best[:, REACH_BINS:-REACH_BINS] = ranked
    width = 1
    while width < 2 * REACH_BINS + 1:
        step = min(width, 2 * REACH_BINS + 1 - width)
        best = np.maximum(best[:, : best.shape[1] - step], best[:, step:])
        width += step
    top = (ranked == best) & (levels > 0)
    before, after = np.full((n, bins), -1, np.int32), np.full((n, bins), -1, np.int32)
    same = owner[1:] == owner[:-1]
    before[1:][same], after[:-1][same] = best[:-1][same], best[1:][same]
    frame, at = np.nonzero(top & (ranked > before) & (ranked >= after))
    good = at >= LOWEST_BIN
    return frame[good], at[good]


def fingerprints(sound: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Of each sound the sorted time-coded peak pairs."""
    levels, owner, time = spectra(sound, at)
    frame, bin_ = peaks(levels, owner)
    codes, mine = [], []
    for k in range(1, PAIRS + 1):
        a, b = np.arange(max(len(frame) - k, 0)), np.arange(k, max(len(frame), k))
        gap = frame[b] - frame[a]
        ok = (owner[frame[a]] == owner[frame[b]]) & (gap < 16)
        a, b, gap = a[ok], b[ok], gap[ok]
        codes.append(time[frame[a]].astype(np.int64) << 18 | bin_[a] << 11 | bin_[b] << 4 | gap)
        mine.append(owner[frame[a]])
    code, of = np.concatenate(codes), np.concatenate(mine)
    order = np.lexsort((code, of))
    return np.split(code[order], np.searchsorted(of[order], np.arange(1, len(at) - 1)))


def features(texts: pa.Array) -> pa.StructArray:
    cols: list[list] = [[] for _ in range(7)]
    for part in ta.slices(texts, 1 << 19):
        data, offs = ta.utf8(part)
        raw, cuts = data.tobytes(), offs.tolist()
        sounds = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            size = hi - lo
            media = wav(raw[lo:hi] + b" " * (max(1, -(-size // FRAME)) * FRAME - size))
            payload = samples(media)
            sounds.append(payload)
            row = (size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())
            for c, x in zip(cols, row, strict=False):
                c.append(x)
        at = np.concatenate([[0], np.cumsum([len(s) for s in sounds])])
        cols[6] += fingerprints(np.frombuffer(b"".join(sounds), np.uint8), at)
    i64, s = pa.int64(), pa.string()
    counts = np.concatenate([np.zeros(1, np.int64), np.array([len(x) for x in cols[6]], np.int64)])
    prints = pa.ListArray.from_arrays(pa.array(np.cumsum(counts).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *cols[6]])))
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "fingerprints"]
    return pa.StructArray.from_arrays([*(pa.array(c, t) for c, t in zip(cols, [i64, i64, s, i64, i64, s], strict=False)), prints], names)


def media(texts: Column) -> Column:
    """A struct of COLUMNS for each whole text."""

    @F.arrow_udf(COLUMNS)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield features(texts)

    return of(texts)


def media_bytes(texts: Column) -> Column:
    """binary: the WAV file of each whole text, to store as a media column."""

    @F.arrow_udf("binary")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            raw = [(t or "").encode() for t in texts.to_pylist()]
            yield pa.array([wav(t + b" " * (max(1, -(-len(t) // FRAME)) * FRAME - len(t))) for t in raw], pa.binary())

    return of(texts)
