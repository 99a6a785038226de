"""Media columns: audio features of 8-bit sound kept in the rows.

media_table() stores payloads as WAV, 8-bit mono at RATE. features() reads the stored bytes back and computes, per
sound, log-mel frames of overlapped windows after polyphase resampling to RESAMPLED, in fixed-shape tensors of
FRAMES x MELS values with the time span each covers, and the segments in which the energy, with hysteresis, is up.
Tensors are rows of a stored table; as_tensors() reads them as Arrow tensors, and digest() sums the rows of each sound
up. A sound is computed on its own, and features are rounded to whole steps of 1/STEP, so that equal sounds have equal
features whatever batch they are in.

Defined cases: a null text is an empty one, and an empty payload is padded to 64 bytes like any other; the last tensor
is filled up with frames of silence; a null media value has no tensors and no segments; repeated rows get a result row
each; ids are of any type; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import small_batches, written

RATE, UP, DOWN = 8000, 3, 4
RESAMPLED = RATE * UP // DOWN
TAPS = 16
WINDOW, HOP = 256, 128
FRAMES, MELS = 64, 16
STEP = 20
#: Hysteresis in dB above a sound's median frame energy: a segment begins above UPPER and ends below LOWER.
UPPER_DB, LOWER_DB = 3.0, 1.0
SILENCE = -5.0
PAD = 64


def wav(payload: bytes) -> bytes:
    """8-bit mono PCM; the payload's bytes are the samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def samples(media: bytes) -> bytes:
    """The samples of a stored WAV: its chunks are walked to the data."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV without data")


def low_pass(up: int = UP, down: int = DOWN) -> np.ndarray:
    """A windowed sinc at the lower of both rates, TAPS for each of its periods, a whole number for each of the phases."""
    n = -(-TAPS * max(up, down) // up) * up
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hanning(n + 2)[1:-1]
    return h / h.sum() * up


def resample(x: np.ndarray, h: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase resampling by up / down: output m is the phase m * down % up of the filter over the samples up to
    m * down // up. Outputs of one phase read samples at a regular distance; none between is computed."""
    out, taps = -(-len(x) * up // down), len(h) // up
    y = np.zeros(out)
    padded = np.concatenate([np.zeros(taps - 1), x, np.zeros(1)])
    seen = np.lib.stride_tricks.sliding_window_view(padded, taps)  # row i ends with sample i
    for first in range(min(up, out)):  # outputs first, first + up, ... have one phase, and are down samples apart
        phase, at = first * down % up, first * down // up
        count = len(range(first, out, up))
        y[first::up] = seen[at : at + (count - 1) * down + 1 : down] @ h[phase::up][::-1]
    return y


def mel_bank() -> np.ndarray:
    """Triangles on the mel scale, (WINDOW // 2 + 1) x MELS."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60.0), mel(RESAMPLED / 2), MELS + 2) / 2595) - 1)
    f = np.linspace(0, RESAMPLED / 2, WINDOW // 2 + 1)[:, None]
    up = (f - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down))


class Analyser:
    def __init__(self) -> None:
        self.h, self.bank, self.window = low_pass(), mel_bank(), np.hanning(WINDOW)

    def frames(self, payload: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Tensors (n, FRAMES, MELS) of int16 steps, and the energies in dB of the frames that are sound."""
        x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
        y = resample(x, self.h)
        count = max(1, -(-max(0, len(y) - WINDOW) // HOP) + 1)
        blocks = -(-count // FRAMES)
        y = np.concatenate([y, np.zeros((blocks * FRAMES - 1) * HOP + WINDOW - len(y))])
        cut = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP]
        out = np.full((blocks * FRAMES, MELS), round(SILENCE * STEP), np.int16)
        energy = np.empty(count)
        for at in range(0, count, FRAMES):
            to = min(at + FRAMES, count)
            power = np.abs(np.fft.rfft(cut[at:to] * self.window, axis=1)) ** 2
            out[at:to] = np.rint(np.log10(np.maximum(power @ self.bank, 10**SILENCE)) * STEP)
            energy[at:to] = np.rint(100 * np.log10(np.maximum(power.sum(axis=1), 10**SILENCE))) / 10
        return out.reshape(blocks, FRAMES, MELS), energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of the stretches that rise above UPPER_DB and stay above LOWER_DB."""
    level = energy - np.median(energy)
    out, start = [], None
    for i in np.flatnonzero((level >= UPPER_DB) | (level < LOWER_DB)):
        if start is None and level[i] >= UPPER_DB:
            start = int(i)
        elif start is not None and level[i] < LOWER_DB:
            out.append((start, int(i)))
            start = None
    if start is not None:
        out.append((start, len(level)))
    return out


def _ms(frame: int) -> int:
    return frame * HOP * 1000 // RESAMPLED


def as_tensors(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """A log_mel column read from Parquet as an Arrow array of fixed-shape tensors (FRAMES x MELS)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), np.float32).reshape(-1, FRAMES, MELS)
    return pa.FixedShapeTensorArray.from_numpy_ndarray(flat)


def media_table(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, media): texts as UTF-8, padded with zero bytes to a positive multiple of PAD, as WAV."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            media = [wav(b + bytes(max(PAD, -(-len(b) // PAD) * PAD) - len(b))) for b in raw]
            columns = [batch.column("doc_id"), pa.array([len(b) for b in raw], pa.int64()), pa.array(media, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(store, f"doc_id {id_type}, n_bytes long, media binary")


#: Columns of features() beside those of the media table: SPANS begin in the tensor's span; SOUND, what is known of the
#: whole sound, is on the row of its first tensor.
SPANS = "array<struct<from_ms: bigint, to_ms: bigint>>"
SOUND = (
    "struct<media_bytes: bigint, payload_bytes: bigint, payload_sha256: string, tail_crc32: bigint, frames: bigint, median_db: double>"
)
COLUMNS = {
    "media_sha256": "string",
    "chunk": "bigint",
    "from_ms": "bigint",
    "to_ms": "bigint",
    "segments": SPANS,
    "sound": SOUND,
    "log_mel": "array<float>",
}


def _types() -> dict[str, pa.DataType]:
    spans = pa.list_(pa.struct([("from_ms", pa.int64()), ("to_ms", pa.int64())]))
    texts = {"payload_sha256": pa.string(), "median_db": pa.float64()}
    names = ("media_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "frames", "median_db")
    sound = pa.struct([(c, texts.get(c, pa.int64())) for c in names])
    return {"media_sha256": pa.string(), "chunk": pa.int64(), "from_ms": pa.int64(), "to_ms": pa.int64(), "segments": spans, "sound": sound}


def features(media: DataFrame) -> DataFrame:
    """One row for each tensor of the sounds in column media: the other columns, which must not be named like these, and
    COLUMNS. log_mel has FRAMES * MELS values, see as_tensors()."""
    own = [c for c in media.columns if c != "media"]
    kinds = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in own)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analyser, types = Analyser(), _types()
        for batch in batches:
            row, tensors, found = [], [np.zeros(0, np.int16)], {c: [] for c in types}
            for k, m in enumerate(batch.column("media").to_pylist()):
                if m is None:
                    continue
                payload, sha = samples(m), hashlib.sha256(m).hexdigest()
                steps, energy = analyser.frames(payload)
                up = segments(energy)
                sound = (len(m), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(energy), float(np.median(energy)))
                sound = dict(zip((f.name for f in types["sound"]), sound, strict=True))
                for c in range(len(steps)):
                    begin, end = c * FRAMES, min((c + 1) * FRAMES, len(energy))
                    here = [{"from_ms": _ms(a), "to_ms": _ms(b)} for a, b in up if begin <= a < end]
                    values = (sha, c, _ms(begin), _ms(end), here, None if c else sound)
                    for name, value in zip(types, values, strict=True):
                        found[name].append(value)
                row += [k] * len(steps)
                tensors.append(steps.reshape(-1))
            log_mel = pa.array(np.concatenate(tensors).astype(np.float32) / STEP)
            log_mel = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * FRAMES * MELS), log_mel)
            same = [batch.column(c).take(pa.array(row, pa.int64())) for c in own]
            made = [pa.array(found[c], t) for c, t in types.items()]
            yield pa.RecordBatch.from_arrays([*same, *made, log_mel], names=[*own, *COLUMNS])

    added = ", ".join(f"{c} {t}" for c, t in COLUMNS.items())
    return media.select(*own, "media").mapInArrow(compute, f"{kinds}, {added}")


def digest(stored: DataFrame) -> DataFrame:
    """One row for each sound of a stored table of features(): its other columns, media_sha256, sound and feature, a
    string that sums the tensors and segments up. Tensors are hashed where they are read."""
    by = [c for c in stored.columns if c not in COLUMNS] + ["media_sha256"]
    length = F.aggregate("segments", F.lit(0).cast("long"), lambda n, x: n + x["to_ms"] - x["from_ms"])
    chunk = F.struct("chunk", F.hex(F.xxhash64("log_mel")).alias("hash"), F.size("segments").alias("n"), length.alias("ms"), "to_ms")
    out = stored.select(*by, "sound", chunk.alias("_c")).groupBy(*by).agg(
        F.array_sort(F.collect_set("_c")).alias("_all"), F.max("sound").alias("sound"), F.count("sound").alias("_rows")
    )
    total = lambda field: F.aggregate("_all", F.lit(0).cast("long"), lambda n, x: n + x[field])
    hashes = F.array_join(F.transform("_all", lambda x: x["hash"]), ",")
    feature = F.format_string(
        f"frames=%d;tensors=%dx{FRAMES}x{MELS};ms=%d;segments=%d;voiced_ms=%d;db=%.1f;log_mel=%s",
        "sound.frames",
        F.size("_all"),
        F.array_max(F.transform("_all", lambda x: x["to_ms"])),
        total("n"),
        total("ms"),
        "sound.median_db",
        F.substring(F.sha2(hashes, 256), 1, 32),
    )
    repeated = F.explode(F.array_repeat(F.lit(1), F.col("_rows").cast("int")))
    return out.select(*by, "sound", feature.alias("feature"), repeated.alias("_one")).drop("_one")


def op7_audio(docs: DataFrame) -> DataFrame:
    with small_batches(docs.sparkSession):
        media = written(media_table(docs), "media", "zstd")
        tensors = written(features(media), "tensors", "zstd")
    return digest(tensors).select(
        "doc_id", "n_bytes", "sound.payload_bytes", "sound.payload_sha256", "sound.tail_crc32", "sound.media_bytes", "media_sha256", "feature"
    )
