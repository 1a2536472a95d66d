"""Media columns: texts kept as 8-bit audio, and features of that audio.

A payload is stored losslessly as the samples of a mono 8-bit WAV file.  The
features are computed from the stored bytes read back:

* polyphase resampling from 12 kHz to 8 kHz (up 2, down 3): the filter is split
  into one branch for each output phase, so no zero-stuffed sample is touched;
* log-mel energies of Hann windows of 256 samples that overlap by half;
* hysteresis segmentation: a segment starts where the frame energy rises above
  the upper threshold and ends where it falls below the lower one.

Frames are stored as Arrow tensors of the fixed shape (FRAMES, MELS), each with
the time span it covers; the last is padded with the floor value.

Filter, window, transform and mel bank have whole-number coefficients, and all
sums stay below 2^53, so products of matrices in doubles are exact whatever
their order: equal texts have equal features on any processor.  Levels are
whole tenths of a decibel, found in a table of exact thresholds.

Defined cases: null text is an empty text, whose payload is 192 spaces; long
texts are processed in blocks of samples, so memory doesn't follow their
length; equal texts have equal bytes and features whatever rows stand beside
them, since every row is computed alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkgram.llm.common import bounded_batches, cut

UNIT = 192
RATE_IN, UP, DOWN = 12_000, 2, 3
RATE = RATE_IN * UP // DOWN
WINDOW, HOP, MELS, FRAMES = 256, 128, 20, 64
TAPS = 24  # for each phase
#: Powers of two that the coefficients of filter, window, transform and mel bank are multiples of.
FILTER_BITS, WINDOW_BITS, TURN_BITS, MEL_BITS = 14, 10, 12, 6
#: Bits that are dropped after the filter (four stay below a sample's unit) and after the transform.
FILTER_SHIFT, TURN_SHIFT = 10, 20
LOWEST_HZ, LOWEST_BIN = 60.0, 2
#: Hysteresis thresholds above a text's quietest decile, in tenths of a dB, and the shortest segment in frames.
RISE, FALL, SHORTEST = 60, 30, 2
#: Input samples a block; a multiple of DOWN * HOP.
BLOCK = DOWN * HOP * 512


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(padded UTF-8 bytes, bytes before padding)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * ((-len(data)) % UNIT or (0 if data else UNIT)), len(data)


def to_wav(samples: bytes, rate: int = RATE_IN) -> bytes:
    """A mono 8-bit PCM WAV file; chunks have even lengths."""
    pad = b"\0" * (len(samples) & 1)
    size = 4 + 24 + 8 + len(samples) + len(pad)
    return b"RIFF" + struct.pack("<I", size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + pad


def from_wav(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of such a file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            coding, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (coding, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit PCM")
        elif kind == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


def _branches() -> np.ndarray:
    """[input tap, output phase]: the windowed-sinc filter split by phase."""
    span = TAPS + DOWN
    n = np.arange(-span * UP, span * UP + 1)
    h = np.sinc(n / DOWN) / DOWN * UP * np.hamming(len(n))
    out = np.zeros((span + DOWN, UP))
    middle = out.shape[0] // 2
    for phase in range(UP):  # output m = UP * b + phase lies at input DOWN * (b + phase / UP)
        for tap in range(out.shape[0]):
            k = round(DOWN * phase - (tap - middle) * UP)
            if abs(k) <= span * UP:
                out[tap, phase] = h[k + span * UP]
    return np.rint(out / out.sum(axis=0) * 2**FILTER_BITS)


def _turns() -> np.ndarray:
    """[sample, (cosine, sine) of each bin from LOWEST_BIN]: the transform of a window."""
    angle = 2 * np.pi / WINDOW * (np.outer(np.arange(WINDOW), np.arange(LOWEST_BIN, WINDOW // 2 + 1)) % WINDOW)
    return np.rint(np.hstack([np.cos(angle), np.sin(angle)]) * 2**TURN_BITS)


def _mel_bank() -> np.ndarray:
    """[spectrum bin, mel band]: triangles equally spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(LOWEST_HZ), mel(RATE / 2), MELS + 2) / 2595) - 1)
    f = np.arange(LOWEST_BIN, WINDOW // 2 + 1)[:, None] * RATE / WINDOW
    lo, mid, hi = edges[:-2], edges[1:-1], edges[2:]
    return np.rint(np.clip(np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid)), 0, None) * 2**MEL_BITS)


def _level_edges() -> np.ndarray:
    """The least whole number of each level: 100 * log10 of it is the level or more."""
    edges, at = [], 1
    for level in range(1596):  # up to 2^53
        at = max(at, int(10 ** (level / 100)) - 2)
        while at**100 < 10**level:
            at += 1
        edges.append(at)
    return np.array(edges, np.float64)


_BRANCHES, _TURNS, _MEL, _LEVELS = _branches(), _turns(), _mel_bank(), _level_edges()
_HANN = np.rint(np.hanning(WINDOW + 1)[:-1] * 2**WINDOW_BITS)


def levels(power: np.ndarray) -> np.ndarray:
    """Tenths of a decibel, rounded down; 0 for powers of 0 and 1."""
    return np.maximum(np.searchsorted(_LEVELS, power, side="right") - 1, 0).astype(np.int32)


def resample(x: np.ndarray) -> np.ndarray:
    """UP / DOWN times the rate, by one dot product for each output sample; whole
    numbers in, whole sixteenths out."""
    taps = _BRANCHES.shape[0]
    blocks = -(-len(x) // DOWN)
    left = taps // 2
    padded = np.zeros(blocks * DOWN + taps + DOWN)
    padded[left : left + len(x)] = x
    view = np.lib.stride_tricks.as_strided(padded, (blocks, taps), (padded.strides[0] * DOWN, padded.strides[0]))
    return np.floor((np.ascontiguousarray(view) @ _BRANCHES).reshape(-1) / 2**FILTER_SHIFT)


def log_mel(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(levels of [frame, mel band], level of each frame's energy)."""
    raw = np.frombuffer(samples, np.uint8)
    mels, energies = [], []
    margin = DOWN * WINDOW  # input on both sides that a block's frames and filters reach
    total = max(1, -(-(len(raw) * UP) // (DOWN * HOP)) - 1)
    bins = _MEL.shape[0]
    for at in range(0, max(len(raw), 1), BLOCK):
        lo = max(0, at - margin)
        x = raw[lo : at + BLOCK + margin].astype(np.float64) - 128.0
        y = resample(x)[(at - lo) * UP // DOWN :]
        first = at * UP // DOWN // HOP
        n = min(BLOCK * UP // DOWN // HOP, total - first)
        if n <= 0:
            continue
        y = np.concatenate([y, np.zeros(max(0, (n - 1) * HOP + WINDOW - len(y)))])
        frames = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[: (n - 1) * HOP + 1 : HOP]
        turned = np.floor((frames * _HANN) @ _TURNS / 2**TURN_SHIFT)
        power = turned[:, :bins] ** 2 + turned[:, bins:] ** 2
        energies.append(levels(power.sum(axis=1)))
        mels.append(levels(power @ _MEL))
    return np.concatenate(mels), np.concatenate(energies)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Spans of frames [start, end) between a rise and the fall that follows it."""
    base = int(np.sort(energy)[len(energy) // 10])
    state = np.where(energy >= base + RISE, 1, np.where(energy < base + FALL, -1, 0))
    known = np.flatnonzero(state)
    # frames between the thresholds keep the state before them; at first it is "off"
    last = np.searchsorted(known, np.arange(len(state)), side="right") - 1
    on = np.zeros(len(state) + 2, np.int8)
    if len(known):
        on[1:-1] = (last >= 0) & (state[known[np.maximum(last, 0)]] > 0)
    change = np.diff(on)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    return [(int(s), int(e)) for s, e in zip(starts, ends, strict=True) if e - s >= SHORTEST]


def tensors(mel: np.ndarray) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """([tensor, FRAMES, MELS] float32 in dB, time span in seconds of each)."""
    n = -(-len(mel) // FRAMES)
    out = np.zeros((n * FRAMES, MELS), np.float32)
    out[: len(mel)] = mel / 10
    spans = [(i * FRAMES * HOP / RATE, ((min(len(mel), (i + 1) * FRAMES) - 1) * HOP + WINDOW) / RATE) for i in range(n)]
    return out.reshape(n, FRAMES, MELS), spans


def to_arrow_tensors(values: np.ndarray) -> pa.FixedShapeTensorArray:
    return pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(values))


def from_storage(flat: pa.Array) -> pa.FixedShapeTensorArray:
    """The ``tensor`` column of ``audio_features`` as an Arrow tensor array."""
    kind = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))
    return pa.ExtensionArray.from_storage(kind, flat.cast(pa.list_(pa.float32(), FRAMES * MELS)))


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, media)``: each text as a WAV file."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [payload_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in pairs], pa.int64()), pa.array([to_wav(p) for p, _ in pairs], pa.binary())], names=["id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


_FILE = pa.struct([("samples", pa.int64()), ("samples_sha256", pa.string()), ("tail_crc32", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
_SEGMENTS = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
_FEATURES_DDL = "place int, frames int, start_s double, end_s double, tensor array<float>, segments array<struct<start_s:double,end_s:double>>, file struct<samples:long,samples_sha256:string,tail_crc32:long,bytes:long,sha256:string>"
#: Tensors handed on at once.
_TENSORS = 256


def audio_features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each tensor of each file, by place: its frames, time span and
    values, and the segments (in seconds) that start in it.

    ``file`` tells of the file's samples and bytes beside its first tensor; the
    columns ``keep`` of ``media`` stand beside all.  A file's rows follow each
    other; there is no shuffle.
    """
    bounded_batches(media.sparkSession)
    fields = media.select(id_col, *keep).schema
    ddl = ", ".join([f"id {fields[id_col].dataType.simpleString()}", *(f"k{i} {fields[c].dataType.simpleString()}" for i, c in enumerate(keep)), _FEATURES_DDL])
    names = ["id", *(f"k{i}" for i in range(len(keep))), "place", "frames", "start_s", "end_s", "tensor", "segments", "file"]

    def of_file(blob: bytes) -> list[tuple]:
        samples, _ = from_wav(blob)
        mel, energy = log_mel(samples)
        values, spans = tensors(mel)
        held: list[list[dict]] = [[] for _ in spans]
        for s, e in segments(energy):
            held[s // FRAMES].append({"start_s": s * HOP / RATE, "end_s": ((e - 1) * HOP + WINDOW) / RATE})
        of_first = {"samples": len(samples), "samples_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-16:]), "bytes": len(blob), "sha256": hashlib.sha256(blob).hexdigest()}
        return [(i, min(FRAMES, len(mel) - i * FRAMES), *spans[i], values[i], held[i], None if i else of_first) for i in range(len(spans))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), None, _SEGMENTS, _FILE]
        for batch in batches:
            places, rows = [], []

            def flush() -> pa.RecordBatch:
                beside = [batch.column(i).take(pa.array(places)) for i in (0, *range(2, batch.num_columns))]
                columns = [to_arrow_tensors(np.stack(c)).storage.cast(pa.list_(pa.float32())) if t is None else pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                return pa.RecordBatch.from_arrays([*beside, *columns], names=names)

            for i in range(batch.num_rows):
                for row in of_file(batch.column(1)[i].as_py()):
                    places.append(i)
                    rows.append(row)
                    if len(rows) >= _TENSORS:
                        yield flush()
                        places, rows = [], []
            if rows:
                yield flush()

    out = media.select(id_col, media_col, *keep).mapInArrow(run, ddl)
    return out.withColumnsRenamed({"id": id_col} | {f"k{i}": c for i, c in enumerate(keep)})


class _Digest:
    """Sums up the tensors and segments of one file."""

    def __init__(self, row: dict):
        self.row, self.tensors, self.frames, self.segments = row, 0, 0, 0
        self.sums, self.sha = np.zeros(MELS, np.int64), hashlib.sha256()

    def add(self, row: dict, tensor: np.ndarray) -> None:
        mel = np.rint(tensor[: row["frames"] * MELS].astype(np.float64) * 10).astype("<i4")
        self.tensors += 1
        self.frames += row["frames"]
        self.segments += len(row["segments"])
        self.sums += mel.reshape(-1, MELS).sum(axis=0)
        self.sha.update(mel.tobytes())
        spans = [row["start_s"], row["end_s"], *(x for s in row["segments"] for x in (s["start_s"], s["end_s"]))]
        self.sha.update(np.rint(np.array(spans) * RATE).astype("<i8").tobytes())

    def feature(self) -> str:
        means = ",".join(map(str, (self.sums // self.frames).tolist()))
        return f"tensors={self.tensors};frames={self.frames};segments={self.segments};mel={means};sha256={self.sha.hexdigest()}"


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as media, reads the files back, and returns their digests
    and those of their tensors, time spans and segments.

    The media column is written to storage; what follows is one pass over it
    without a shuffle, in which tensors stream by.
    """
    stored = cut(store_media(docs, id_col, text_col), "media", compression="zstd")
    features = audio_features(stored, id_col, keep=("n_bytes",))
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_file: _Digest | None = None

        def batch_of(done: list[_Digest], id_type: pa.DataType) -> pa.RecordBatch:
            rows = [(d.row["id"], d.row["n_bytes"], *(d.row["file"][k] for k in ("samples", "samples_sha256", "tail_crc32", "bytes", "sha256")), d.feature()) for d in done]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([id_type, *types])], names=["id", *names])

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            values = batch.column("tensor").flatten().to_numpy(zero_copy_only=False).reshape(-1, FRAMES * MELS)
            done = []
            for row, tensor in zip(batch.drop_columns("tensor").rename_columns(plain).to_pylist(), values, strict=True):
                if row["place"] == 0:
                    if open_file is not None:
                        done.append(open_file)
                    open_file = _Digest(row)
                open_file.add(row, tensor)
            if done:
                yield batch_of(done, id_type)
        if open_file is not None:
            yield batch_of([open_file], id_type)

    plain = ["id", *(c for c in features.columns[1:] if c != "tensor")]
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return features.mapInArrow(run, schema).withColumnRenamed("id", id_col)
