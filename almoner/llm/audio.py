"""Media columns: byte payloads kept losslessly as 8-bit PCM, with log-mel features, energy segments and time spans.

A payload becomes a WAV file (mono, unsigned 8-bit samples); the file is read back by its RIFF chunks, its samples are
resampled by a polyphase FIR, framed with overlap, turned into log-mel energies and cut into active segments by energy
with hysteresis.  Features are tensors of one fixed shape (``CLIP_FRAMES`` x ``MELS``, the last one zero-padded), each with
its time span.  They are stored as Arrow's fixed-shape tensors: a table of the shared folder holds Arrow streams, each of
the clips of a few megabytes of media, whose schema carries ``tensor_type``; digests are taken from what is read back.

Defined results: a null text counts as empty; an empty payload becomes 64 zero bytes (silence: one tensor, no segment);
equal payloads give equal values; repeated rows stay; extra columns are ignored; an empty table gives an empty result.
A payload is resampled in blocks of ``BLOCK`` samples and transformed 2048 frames at a time; its resampled signal and its
log-mel frames are held whole, so a worker's memory is a small multiple of its longest payload or of ``CHUNK_BYTES``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almoner.llm.common import blobs, discard, slices, written

UNIT = 64
RATE = 16_000
UP, DOWN = 1, 2
TAPS = 16
FRAME, HOP = 256, 128
MELS = 16
CLIP_FRAMES = 64
BLOCK = 1 << 18
#: A segment starts where the energy is OPEN above the clip's floor and ends where it falls below CLOSE.
OPEN_DB, CLOSE_DB = 9.0, 6.0

MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
FEATURE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_clips long, n_segments long"

#: Columns of the stream of files; active holds the active spans' starts and ends in turn.
FILE_FIELDS = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "active": pa.list_(pa.float64())}


def tensor_type() -> pa.DataType:
    """The Arrow type of one clip of features."""
    return pa.fixed_shape_tensor(pa.float32(), (CLIP_FRAMES, MELS))


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of UNIT."""
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A RIFF/WAVE file of unsigned 8-bit mono samples."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    odd = b"\0" * (len(samples) & 1)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(samples) + len(odd), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(samples)) + samples + odd


def from_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate, found by walking the chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            kind, channels, rate = struct.unpack_from("<HHI", media, at + 8)
            if (kind, channels, media[at + 22]) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is stored")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


@lru_cache
def _bank(up: int, down: int) -> np.ndarray:
    """Windowed-sinc low-pass, one row of taps for each of the ``up`` phases."""
    n = TAPS * up
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = np.sinc(t * cut) * np.hamming(n)
    return (h / h.sum() * up).reshape(TAPS, up).T.astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase: output i is phase ``i*down % up`` of the filter at input ``i*down // up``; only kept outputs are computed."""
    bank, n = _bank(up, down), -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(TAPS // 2, np.float32), x, np.zeros(TAPS + down, np.float32)])
    out = np.empty(n, np.float32)
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    for first in range(min(up, n)):
        phase, start = first * down % up, first * down // up
        own = windows[start :: down][: -(-(n - first) // up)]
        out[first::up] = own @ bank[phase][::-1]
    return out


@lru_cache
def _mel() -> np.ndarray:
    """Triangular filters over the FFT bins, evenly spaced in mel."""
    rate = RATE * UP / DOWN
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), MELS + 2)
    edges = 700 * (10 ** (mel / 2595) - 1) / rate * FRAME
    bins = np.arange(FRAME // 2 + 1)[:, None]
    rise, fall = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray) -> np.ndarray:
    """frames x MELS, natural log; a signal shorter than a frame is zero-padded to one."""
    if len(x) < FRAME:
        x = np.concatenate([x, np.zeros(FRAME - len(x), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    out = []
    for i in range(0, len(frames), 2048):
        s = np.fft.rfft(frames[i : i + 2048] * window)
        out.append(np.log((s.real**2 + s.imag**2).astype(np.float32) @ _mel() + 1e-6))
    return np.concatenate(out)


def segments(energy_db: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) frames: opened at OPEN_DB above the quietest frame, kept until it falls under CLOSE_DB."""
    floor = energy_db.min()
    high, low = energy_db >= floor + OPEN_DB, energy_db < floor + CLOSE_DB
    mark = np.where(high, 1, np.where(low, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[np.maximum(last, 0)] == 1, False)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def features(samples: bytes) -> tuple[np.ndarray, np.ndarray, list[tuple[float, float]]]:
    """Tensors (clips x CLIP_FRAMES x MELS, float32), their spans in seconds (clips x 2), and the active spans in seconds."""
    x = np.frombuffer(samples, np.uint8)
    parts, lead = [], TAPS * DOWN  # blocks overlap by the filter's reach, so that they join without a seam
    for at in range(0, max(1, len(x)), BLOCK):
        lo, hi = max(0, at - lead), min(len(x), at + BLOCK + lead)
        y = resample((x[lo:hi].astype(np.float32) - 128) / 128)
        parts.append(y[(at - lo) * UP // DOWN : (min(len(x), at + BLOCK) - lo) * UP // DOWN])
    mel = log_mel(np.concatenate(parts))
    n, rate = len(mel), RATE * UP / DOWN
    clips = -(-n // CLIP_FRAMES)
    tensors = np.zeros((clips * CLIP_FRAMES, MELS), np.float32)
    tensors[:n] = mel
    starts = np.arange(clips) * CLIP_FRAMES
    spans = np.stack([starts * HOP, (np.minimum(starts + CLIP_FRAMES, n) - 1) * HOP + FRAME], 1) / rate
    db = 10 / np.log(10) * np.log(np.exp(mel).mean(1))
    active = [(a * HOP / rate, ((b - 1) * HOP + FRAME) / rate) for a, b in segments(db)]
    return tensors.reshape(clips, CLIP_FRAMES, MELS), spans, active


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, media): each text's padded bytes as a WAV file."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = blobs(b.column(1))
            for lo in range(0, len(texts), 500):
                part = texts[lo : lo + 500]
                yield pa.record_batch([b.column(0)[lo : lo + 500].cast(pa.int64()), pa.array([len(t) for t in part], pa.int64()), pa.array([to_wav(pad(t)) for t in part], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(store, MEDIA_SCHEMA)


def _stream(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unstream(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def to_clips(media: DataFrame) -> DataFrame:
    """Rows (files, clips) of Arrow streams: what is known of some media rows, and their tensors with spans.

    A row of ``clips`` names its row of ``files`` by number, and its rows are in the order of files and time.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, wavs in slices(b, 2):
                files, counts, spans, tensors = [], [], [], []
                for doc, n, wav in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), wavs, strict=True):
                    payload, _ = from_wav(wav)
                    t, s, active = features(payload)
                    files.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(wav), hashlib.sha256(wav).hexdigest(), [x for span in active for x in span]))
                    counts.append(len(t))
                    spans.append(s)
                    tensors.append(t.ravel())
                span, flat = np.concatenate(spans), pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(tensors)), CLIP_FRAMES * MELS)
                number = [pa.array(np.repeat(np.arange(len(files), dtype=np.int32), counts)), pa.array(np.concatenate([np.arange(c, dtype=np.int32) for c in counts]))]
                held = pa.record_batch([*number, pa.array(span[:, 0]), pa.array(span[:, 1]), pa.ExtensionArray.from_storage(tensor_type(), flat)], names=["file", "clip", "start_s", "end_s", "tensor"])
                about = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*files, strict=True), FILE_FIELDS.values(), strict=True)], names=list(FILE_FIELDS))
                yield pa.record_batch([pa.array([_stream(about)], pa.binary()), pa.array([_stream(held)], pa.binary())], names=["files", "clips"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(cut, "files binary, clips binary")


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table, np.ndarray, np.ndarray]]:
    """Files, clips, tensors (clips x CLIP_FRAMES x MELS) and the first clip of each file, for each row of ``to_clips``."""
    for b in batches:
        for f, c in zip(b.column(0), b.column(1), strict=True):
            files, clip = _unstream(f.as_py()), _unstream(c.as_py())
            if clip.schema.field("tensor").type != tensor_type():
                raise ValueError("not a table of these clips")
            tensors = clip["tensor"].combine_chunks()
            tensors = (tensors.chunk(0) if isinstance(tensors, pa.ChunkedArray) else tensors).to_numpy_ndarray()
            yield files, clip, tensors, np.searchsorted(clip["file"].to_numpy(), np.arange(files.num_rows + 1))


def clips(stored: DataFrame) -> DataFrame:
    """Rows (doc_id, clip, start_s, end_s, tensor): the stored tensors as plain lists in row-major order, which Spark's columns know."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files, clip, tensors, _ in _stored(batches):
            flat = pa.FixedSizeListArray.from_arrays(pa.array(tensors.ravel()), CLIP_FRAMES * MELS).cast(pa.list_(pa.float32()))
            doc = files["doc_id"].take(clip["file"]).combine_chunks()
            columns = [doc, *(clip[c].combine_chunks() for c in ("clip", "start_s", "end_s")), flat]
            yield pa.record_batch(columns, names=["doc_id", "clip", "start_s", "end_s", "tensor"])

    return stored.mapInArrow(read, "doc_id long, clip int, start_s double, end_s double, tensor array<float>")


def describe(stored: DataFrame) -> DataFrame:
    """One row per media row with the digests of its payload and of its stored features."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FEATURE_SCHEMA.split(", ")]
        for files, clip, tensors, first in _stored(batches):
            spans, extra = np.stack([clip["start_s"].to_numpy(), clip["end_s"].to_numpy()], 1), []
            for active, lo, hi in zip(files["active"].to_pylist(), first[:-1], first[1:], strict=True):
                frames = tensors[lo:hi].reshape(-1, MELS)
                digest = hashlib.sha256(np.rint(frames * 100).astype("<i4").tobytes() + np.rint(spans[lo:hi] * 1e4).astype("<i8").tobytes()).hexdigest()
                mean = ",".join(f"{v:.2f}" for v in frames.mean(0))
                seconds = sum(e - s for s, e in zip(active[::2], active[1::2], strict=True))
                extra.append((f"{hi - lo}x{CLIP_FRAMES}x{MELS};mean={mean};active={len(active) // 2}:{seconds:.3f}s;sha256={digest}", int(hi - lo), len(active) // 2))
            kinds = (pa.string(), pa.int64(), pa.int64())
            columns = [*(files[c].combine_chunks() for c in FILE_FIELDS if c != "active"), *(pa.array(c, k) for c, k in zip(zip(*extra, strict=True), kinds, strict=True))]
            yield pa.record_batch(columns, names=names)

    return stored.mapInArrow(read, FEATURE_SCHEMA)


def audio_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as media and every medium's tensors in tables of the shared folder, read these back and describe them."""
    media = written(to_media(docs, id_col, text_col), "media")
    stored = written(to_clips(media), "clips")
    discard(media)
    return describe(stored)
