"""Audio features: stored 8-bit samples, polyphase resampling, log-mel tensors, energy segments."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AudioSpec:
    """rate * up / down is the rate after resampling. Levels of the hysteresis are dB against full scale."""

    rate: int = 20_000
    up: int = 2
    down: int = 5
    half_taps: int = 10
    frame: int = 256
    hop: int = 128
    mels: int = 32
    patch: int = 32
    on_db: float = -30.0
    off_db: float = -36.0
    block_patches: int = 32

    @property
    def out_rate(self) -> float:
        return self.rate * self.up / self.down


def to_wav(samples: bytes, rate: int) -> bytes:
    """A mono WAV file of unsigned 8-bit PCM; an odd payload gets the pad byte RIFF asks for."""
    pad = b"\0" * (len(samples) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + pad


def from_wav(media: bytes) -> tuple[int, memoryview]:
    """(rate, samples) of such a file, by its chunks."""
    view = memoryview(media)
    if view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(view):
        name, n = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", view, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
        elif name == b"data":
            return rate, view[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def padded(text: bytes, unit: int, fill: int = 255) -> bytes:
    """text, lengthened by fill to a positive multiple of unit."""
    return text + bytes([fill]) * (-len(text) % unit or (0 if text else unit))


class Extractor:
    """Features of one recording at a time, by blocks of frames, so that memory doesn't grow with its length."""

    def __init__(self, spec: AudioSpec):
        s = self.spec = spec
        half = s.half_taps * max(s.up, s.down)
        t = np.arange(-half, half + 1)
        h = np.sinc(t / max(s.up, s.down)) * np.kaiser(2 * half + 1, 8.0)
        h *= s.up / h.sum()
        # Output n = up * m + r reads input around floor(n * down / up), with every up-th tap: one column for each r.
        self.left = half // s.up + 1
        self.width = self.left + half // s.up + 2 + (s.up - 1) * s.down // s.up
        self.taps = np.zeros((self.width, s.up), np.float32)
        for r in range(s.up):
            for k in range(self.width):
                lag = r * s.down - (k - self.left) * s.up
                if -half <= lag <= half:
                    self.taps[k, r] = h[lag + half]
        self.window = np.hanning(s.frame).astype(np.float32)
        self.mel = self._mel().astype(np.float32)

    def _mel(self) -> np.ndarray:
        s = self.spec
        hz = np.fft.rfftfreq(s.frame, 1 / s.out_rate)
        top = 2595 * np.log10(1 + s.out_rate / 2 / 700)
        edges = 700 * (10 ** (np.linspace(0, top, s.mels + 2) / 2595) - 1)
        up = (hz[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
        down = (edges[2:] - hz[:, None]) / (edges[2:] - edges[1:-1])
        return np.maximum(0, np.minimum(up, down))

    def resampled(self, x: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Outputs start..stop of the whole recording x (8-bit); start is a multiple of up."""
        s = self.spec
        m0, m1 = start // s.up, -(-stop // s.up)
        a, b = m0 * s.down - self.left, (m1 - 1) * s.down - self.left + self.width
        part = (x[max(a, 0) : min(b, len(x))].astype(np.float32) - 128.0) / 128.0
        part = np.pad(part, (max(-a, 0), max(b - max(len(x), a), 0))) if a < 0 or b > len(x) else part
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(part, self.width)[:: s.down][: m1 - m0])
        return (rows @ self.taps).reshape(-1)[: stop - start]

    def n_out(self, n: int) -> int:
        return -(-n * self.spec.up // self.spec.down)

    def n_frames(self, n: int) -> int:
        return max(1, -(-(self.n_out(n) - self.spec.frame) // self.spec.hop) + 1)

    def blocks(self, x: np.ndarray):
        """(first frame, log-mel [frames, mels], energy in dB [frames]) for each block."""
        s, total, out = self.spec, self.n_frames(len(x)), self.n_out(len(x))
        step = s.block_patches * s.patch
        for f0 in range(0, total, step):
            f1 = min(f0 + step, total)
            a, b = f0 * s.hop, (f1 - 1) * s.hop + s.frame
            lead = a % s.up
            y = self.resampled(x, a - lead, min(b, out))[lead:]
            y = np.pad(y, (0, b - a - len(y))) if len(y) < b - a else y
            frames = np.lib.stride_tricks.sliding_window_view(y, s.frame)[:: s.hop] * self.window
            spectrum = np.fft.rfft(frames, axis=1)
            power = spectrum.real**2 + spectrum.imag**2
            yield f0, np.log10(np.maximum(power @ self.mel, 1e-10)).astype(np.float32), 10 * np.log10(np.maximum((frames * frames).mean(1), 1e-10))

    def __call__(self, samples) -> tuple[bytes, list[tuple[float, float]], int]:
        """(Arrow stream of tensors with time spans, active segments in seconds, number of patches)."""
        s, x = self.spec, np.frombuffer(samples, np.uint8)
        total, sec = self.n_frames(len(x)), s.hop / s.out_rate
        kind = pa.fixed_shape_tensor(pa.float32(), [s.patch, s.mels])
        schema = pa.schema({"t0": pa.float64(), "t1": pa.float64(), "frames": pa.int32(), "logmel": kind})
        sink, segments, on, since, count = pa.BufferOutputStream(), [], False, 0, 0
        with pa.ipc.new_stream(sink, schema) as out:
            for f0, mel, db in self.blocks(x):
                n = -(-len(mel) // s.patch)
                full = np.zeros((n * s.patch, s.mels), np.float32)
                full[: len(mel)] = np.round(mel, 3)
                first = f0 + np.arange(n) * s.patch
                used = np.minimum(s.patch, total - first)
                out.write_batch(pa.record_batch([pa.array(first * sec), pa.array((first + used - 1) * sec + s.frame / s.out_rate), pa.array(used, pa.int32()), pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, s.patch, s.mels))], schema=schema))
                count += n
                # The last decisive level at or before each frame says whether it is active.
                said = np.where(db >= s.on_db, 1, np.where(db < s.off_db, 0, -1))
                at = np.maximum.accumulate(np.where(said >= 0, np.arange(len(said)), -1))
                state = np.where(at >= 0, said[at] == 1, on)
                for k in np.flatnonzero(np.diff(state, prepend=on)):
                    if state[k]:
                        since = f0 + int(k)
                    else:
                        segments.append((since * sec, (f0 + int(k) - 1) * sec + s.frame / s.out_rate))
                on = bool(state[-1])
        if on:
            segments.append((since * sec, (total - 1) * sec + s.frame / s.out_rate))
        return sink.getvalue().to_pybytes(), segments, count


def read_tensors(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, n_tensors int, tensors binary, segments array<struct<t0:double,t1:double>>"


def audio_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 576, spec: AudioSpec = AudioSpec(), flush_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of df: the recording, what was read back from it, its tensors and its active segments.

    The UTF-8 bytes of text_col, padded by 255 to a positive multiple of unit, are the samples of an
    8-bit WAV file (media). The file is parsed again and the digests, tensors and segments come from the
    samples read back. tensors is an Arrow stream whose column logmel is a fixed-shape tensor
    [patch, mels], with the seconds t0 and t1 it spans and the frames that are not padding.

    Null and empty texts give one unit of padding; ties and repeated rows give equal values; an empty
    table gives an empty one; other columns of df are not read, whatever their names. A text is handled
    by blocks of frames, so only its bytes and its tensors are in memory.
    """

    def run(batches):
        extract, rows, held = Extractor(spec), [], 0

        def batch():
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

        span = pa.list_(pa.struct({"t0": pa.float64(), "t1": pa.float64()}))
        kinds = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), span]
        names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media", "n_tensors", "tensors", "segments"]
        for b in batches:
            kinds[0] = b.schema.field(0).type
            for key, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                raw = text.as_py() or b""
                media = to_wav(padded(raw, unit), spec.rate)
                _, payload = from_wav(media)
                tensors, segments, n = extract(payload)
                rows.append((key, len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), media, n, tensors, [{"t0": a, "t1": z} for a, z in segments]))
                held += len(media) + len(tensors)
                if held >= flush_bytes:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()

    one = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return one.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {SCHEMA}")


def digest(features: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of audio_features()."""
    spans = F.concat_ws(",", F.transform("segments", lambda s: F.format_string("%.4f-%.4f", s["t0"], s["t1"])))
    return features.select(
        id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.col("n_tensors").cast("string"), F.size("segments").cast("string"), F.sha2(F.concat(F.col("tensors"), F.encode(spans, "UTF-8")), 256)).alias("feature"),
        "n_tensors", F.size("segments").alias("n_segments"),
    )
