"""Media columns: bytes kept as 8-bit audio, read back, and described by audio features.

Storing: a payload is the bytes, padded with blanks (32) to a positive multiple of ``UNIT``, as the
samples of a mono 8-bit WAV file.  Stored media are a written table; features come from what is read.

Features: the samples are resampled at 3/4 of their rate by a polyphase filter (each of the three output phases has
its own taps), overlapping frames go through a mel filterbank, and spans of high energy are segmented with two
thresholds: a span opens at the upper and closes below the lower one.  Log-mel frames are cut into overlapping
windows of one shape and stored, in a written table, as an Arrow IPC stream with a fixed-shape tensor column and
the time span of each window.

All numbers are whole: taps, taper, transform and filters are rounded tables, sums stay below 2^53, where doubles
are exact in any order, and logarithms are read from a table.  So equal texts have equal features on any
processor, and every text is worked on alone, whatever its batch.

Null and empty texts are one unit of blanks.  Repeated rows give repeated rows; null ids stay null; extra columns
are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import math
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import Rows, id_and_text, pairs, written

UNIT, PAD = 192, b" "
RATE, UP, DOWN, TAPS = 16_000, 3, 4, 16
FRAME, HOP, FFT, MELS = 240, 120, 256, 24
WINDOW, STEP = 32, 24
#: Units: of a tap, of a resampled sample, of the taper, of the transform, of a filter, and steps of a logarithm to the base 2.
TAP_ONE, SAMPLE_ONE, TAPER_ONE, WAVE_ONE, FILTER_ONE, LOG_STEPS = 1024, 16, 127, 1024, 256, 64
OPEN, CLOSE = 0.5, -0.5
#: Frames worked on at once.
BLOCK_FRAMES = 4_096


def payload_of(data: bytes) -> bytes:
    return data + PAD * (-len(data) % UNIT or (0 if data else UNIT))


def write_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    pad = b"\0" * (len(samples) % 2)
    chunks = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + pad
    return b"RIFF" + struct.pack("<I", len(chunks)) + chunks


def read_wav(media: bytes) -> tuple[bytes, int]:
    """(samples, rate), by walking the file's chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit PCM")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@cache
def polyphase_taps(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """up rows of taps in units of 1 / TAP_ONE: a windowed sinc low-pass, dealt to its phases."""
    n = np.arange(up * taps) - (up * taps - 1) / 2
    cut = 1 / max(up, down)
    h = (cut * np.sinc(cut * n) * np.hamming(up * taps) * up).reshape(taps, up).T
    return np.rint(np.ascontiguousarray(h[:, ::-1] / h.sum(axis=1, keepdims=True)) * TAP_ONE).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Whole samples at up / down times their rate, in units of 1 / SAMPLE_ONE; output n is phase (n * down) mod up over the inputs around n * down / up."""
    h = polyphase_taps(up, down, taps)
    n = -(-len(x) * up // down)
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(x.astype(np.float32), (taps // 2, taps)), taps)
    out = np.empty(n, np.float32)
    for first in range(min(up, n)):
        at, phase = first * down // up, first * down % up
        own = windows[at::down][: len(out[first::up])]
        for i in range(0, len(own), 1 << 18):
            out[first::up][i : i + (1 << 18)] = own[i : i + (1 << 18)] @ h[phase]  # below 2^24
    return np.floor(out * np.float32(SAMPLE_ONE / TAP_ONE) + np.float32(0.5))


def mel_filters(rate: int, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangles in units of 1 / FILTER_ONE, evenly spaced on the mel scale; bins by filters."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.arange(fft // 2 + 1) * rate / fft
    up, down = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.rint(np.maximum(0, np.minimum(up, down)) * FILTER_ONE)


_ANGLE = 2 * np.pi * np.arange(FRAME)[:, None] * np.arange(FFT // 2 + 1) / FFT
_WAVES = np.rint(np.concatenate([np.cos(_ANGLE), np.sin(_ANGLE)], axis=1) * WAVE_ONE)
_TAPER = np.rint(np.hanning(FRAME) * TAPER_ONE)
_LOG = np.rint(2.0 ** (np.arange(LOG_STEPS) / LOG_STEPS - 1) * (1 << 40)) / (1 << 40)


def whole_log(x: np.ndarray) -> np.ndarray:
    """Logarithms of x + 1 to the base 2, rounded down, in units of 1 / LOG_STEPS."""
    part, power = np.frexp(x + 1)
    return ((power - 1) * LOG_STEPS + np.searchsorted(_LOG, part, side="right") - 1).astype(np.int16)


def log_mel(x: np.ndarray, filters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames by filters, log energy of each frame) over overlapping frames of whole samples."""
    frames = max(1, 1 - (FRAME - len(x)) // HOP)  # the last is padded with silence
    x = np.pad(x, (0, max(0, (frames - 1) * HOP + FRAME - len(x))))
    view = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:frames]
    mel, energy = np.empty((frames, filters.shape[1]), np.int16), np.empty(frames, np.int16)
    bins = FFT // 2 + 1
    for i in range(0, frames, BLOCK_FRAMES):
        block = view[i : i + BLOCK_FRAMES] * _TAPER  # whole doubles from here on
        waves = np.floor(block @ _WAVES / (1 << 16))
        waves *= waves
        mel[i : i + BLOCK_FRAMES] = whole_log((waves[:, :bins] + waves[:, bins:]) @ filters)
        energy[i : i + BLOCK_FRAMES] = whole_log((block * block).sum(axis=1))
    return mel, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Spans of frames: opened at mean + OPEN deviations, closed below mean + CLOSE deviations."""
    energy = energy.astype(np.float64)
    mean = float(energy.sum()) / len(energy)
    spread = math.sqrt(max(0.0, float((energy * energy).sum()) / len(energy) - mean * mean))
    says = np.where(energy >= mean + OPEN * spread, 1, np.where(energy < mean + CLOSE * spread, 0, -1))
    last = np.maximum.accumulate(np.where(says >= 0, np.arange(len(says)), -1))
    on = np.where(last >= 0, says[last], 0).astype(np.int8)
    turns = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))


@cache
def _tensor_type(mels: int) -> pa.DataType:
    return pa.fixed_shape_tensor(pa.int16(), (WINDOW, mels), dim_names=["frame", "mel"])


def tensor_stream(mel: np.ndarray, rate: int) -> tuple[bytes, int]:
    """(Arrow IPC stream of start_s, end_s and log-mel windows as fixed-shape tensors, windows); the last is padded with silence."""
    n = max(1, -(-max(0, len(mel) - WINDOW) // STEP) + 1)
    padded = np.zeros(((n - 1) * STEP + WINDOW, mel.shape[1]), np.int16)
    padded[: len(mel)] = mel
    windows = padded[np.arange(n)[:, None] * STEP + np.arange(WINDOW)]
    kind = _tensor_type(mel.shape[1])
    flat = pa.FixedSizeListArray.from_arrays(pa.array(windows.ravel()), WINDOW * mel.shape[1])
    start = np.arange(n) * STEP * HOP / rate
    batch = pa.record_batch([pa.array(start), pa.array(start + (WINDOW - 1) * HOP / rate + FRAME / rate), pa.ExtensionArray.from_storage(kind, flat)], names=["start_s", "end_s", "log_mel"])
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue(), n


def read_tensors(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(windows by frames by filters, spans in seconds) of a stored stream."""
    table = pa.ipc.open_stream(stream).read_all()
    return table["log_mel"].combine_chunks().to_numpy_ndarray(), np.stack([table["start_s"].to_numpy(), table["end_s"].to_numpy()], axis=1)


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table: doc_id, n_bytes (unpadded), media (a WAV file)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for doc_id, text in pairs(batches):
            data = text.encode("utf-8", "surrogatepass")
            media = write_wav(payload_of(data))
            yield from out.add((doc_id, len(data), media), len(media) + 64)
        yield out.flush()

    return written(id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media", compression="zstd")


_SPAN = "struct<start_s:double,end_s:double>"
FEATURES = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, n_windows long, segments array<{_SPAN}>, tensors binary"


def media_features(media: DataFrame) -> DataFrame:
    """What the stored bytes hold: digests, frames, energy spans and log-mel tensors."""
    span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    number, name = pa.int64(), pa.string()
    schema = pa.schema(
        [("doc_id", number), ("n_bytes", number), ("payload_bytes", number), ("payload_sha256", name), ("tail_crc32", number), ("media_bytes", number), ("media_sha256", name), ("n_frames", number), ("n_windows", number), ("segments", span), ("tensors", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, filters = Rows(schema), {}
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for doc_id, n_bytes, stored in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True):
                    samples, rate = read_wav(stored)
                    x = np.frombuffer(samples, np.uint8).astype(np.int16) - 128
                    own = rate * UP // DOWN
                    if own not in filters:
                        filters[own] = mel_filters(own)
                    mel, energy = log_mel(resample(x), filters[own])
                    tensors, windows = tensor_stream(mel, own)
                    spans = [{"start_s": a * HOP / own, "end_s": ((b - 1) * HOP + FRAME) / own} for a, b in segments(energy)]
                    row = (doc_id, n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), len(mel), windows, spans, tensors)
                    yield from out.add(row, len(tensors) + 500)
        yield out.flush()

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)


def op4_audio_features(spark, sf_dir: str) -> DataFrame:
    """Every document's text as audio: what was stored, read back, and a digest of its features as they are stored."""
    from pyspark.sql import functions as F

    found = written(media_features(store_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))), "features", compression="zstd")
    feature = F.concat_ws(";", F.concat(F.lit("frames="), "n_frames"), F.concat(F.lit("windows="), "n_windows"), F.concat(F.lit("segments="), F.size("segments")), F.concat(F.lit("spans="), F.sha2(F.to_json("segments"), 256)), F.concat(F.lit("log_mel="), F.sha2("tensors", 256)))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
