"""Media columns (4): chroma audio fingerprints by integral-image filters, aligned by offset histograms and bit errors."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostweave.llm import kernels as K
from hostweave.llm.common import ARROW_BYTES, Workspace, keyed, semi, small_batches, within
from hostweave.llm.components import components

_U = np.uint64
#: Frames that one fingerprint integer looks at, and runs of integers of which each keeps one landmark.
SPAN, WINNOW = 16, 3
#: Two recordings match where at an offset they have at least LEAST_OVERLAP integers in common and at most this share of their bits differs.
MOST_ERROR, LEAST_OVERLAP = 0.125, 16
#: An equal landmark is a vote where the signs of the filters differ in at most this share at the integers 1 to AROUND times STEP before and after it (those that both recordings have).
AROUND, STEP, AROUND_ERROR = 6, 4, 0.15
#: Earlier recordings that one landmark votes for at first, marks of a value (or candidates of a room) that a task holds, and pairs of marks that are compared at once.
PARTNERS, BLOCK, PAIRS = 4, 4096, 1 << 18
#: A component of linked recordings is dealt to tasks by pairs of its parts: recordings of a quarter of a part or piece, parts of a component at most, and integers that are compared at once.
PART, PARTS, INTS = 32, 32, 1 << 20
#: Bits of a gap's remainder in packed().
RICE = 2


@dataclass(frozen=True)
class Sound:
    """How samples become frames. rate is that of raw samples; WAV data brings its own."""

    rate: int = 11025
    frame: int = 4096
    hop: int = 1365
    lowest: float = 28.0
    highest: float = 3520.0


#: Short frames, for recordings of a fraction of a second; shorter ones don't tell pitches apart.
SHORT = Sound(frame=256, hop=32, lowest=80.0, highest=5512.0)


def samples_of(data: bytes, sound: Sound) -> tuple[np.ndarray, int]:
    """Mono samples in -1..1 of PCM WAV data with 8 or 16 bits; other bytes are raw unsigned 8-bit samples.

    Data that begins as WAV and is cut, has no format before its samples, or another one (other bits, no channel, a rate
    of 0) has no samples.
    """
    none = np.zeros(0, np.float32), sound.rate
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128, sound.rate
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"fmt ":
            if size < 16 or at + 24 > len(data):
                return none
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", data[at + 8 : at + 24])
            form = (channels, rate, bits) if kind in (1, 0xFFFE) and channels and rate and bits in (8, 16) else None
        if name == b"data":
            if form is None:
                return none
            channels, rate, bits = form
            body = data[at + 8 : at + 8 + size]
            x = (np.frombuffer(body, np.uint8).astype(np.float32) - 128) / 128 if bits == 8 else np.frombuffer(body[: len(body) // 2 * 2], "<i2").astype(np.float32) / 32768
            return x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1), rate
        at += 8 + size + size % 2
    return none


def pitch_classes(rate: int, sound: Sound) -> np.ndarray:
    """For each bin of the spectrum its share in each of 12 pitch classes (one of them, or none)."""
    f = np.fft.rfftfreq(sound.frame, 1 / rate)
    out = np.zeros((len(f), 12), dtype=np.float32)
    use = np.flatnonzero((f >= sound.lowest) & (f <= sound.highest))
    out[use, np.round(12 * np.log2(f[use] / 440)).astype(int) % 12] = 1
    return out


def chroma(x: np.ndarray, rate: int, sound: Sound, block: int = 1 << 14) -> np.ndarray:
    """Frames x 12 energies, each frame of unit length (or zero where it is silent). Short sounds are padded to SPAN frames."""
    least = sound.frame + (SPAN - 1) * sound.hop
    if len(x) < least:
        x = np.concatenate([x, np.zeros(least - len(x), np.float32)])
    n = (len(x) - sound.frame) // sound.hop + 1
    frames = np.lib.stride_tricks.sliding_window_view(x, sound.frame)[:: sound.hop][:n]
    window, classes = np.hanning(sound.frame).astype(np.float32), pitch_classes(rate, sound)
    out = np.empty((n, 12), dtype=np.float32)
    for a in range(0, n, block):
        spectrum = np.fft.rfft(frames[a : a + block] * window, axis=1)
        out[a : a + block] = (spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ classes
    length = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.divide(out, length, out=np.zeros_like(out), where=length > 1e-6)


def filters() -> list[tuple[str, int, int, int]]:
    """16 filters (kind, lowest pitch class, classes, frames) by rule: four kinds, each at four places and sizes."""
    sizes = [(0, 12, SPAN), (0, 6, SPAN // 2), (3, 6, SPAN // 2), (6, 6, SPAN // 4)]
    return [(kind, *size) for kind in ("time", "pitch", "check", "middle") for size in sizes]


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """One 32-bit integer per SPAN consecutive frames: 16 filters over the integral image, two Gray-coded bits each."""
    n = len(frames) - SPAN + 1
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.astype(np.float64).cumsum(axis=0).cumsum(axis=1)

    def area(t: int, p: int, w: int, h: int) -> np.ndarray:
        """Sums over frames t..t+w and classes p..p+h from each place on."""
        return image[t + w : t + w + n, p + h] - image[t : t + n, p + h] - image[t + w : t + w + n, p] + image[t : t + n, p]

    out = np.zeros(n, dtype=np.uint32)
    for kind, p, h, w in filters():
        at = (SPAN - w) // 2
        if kind == "time":
            a, b = area(at, p, w // 2, h), area(at + w // 2, p, w - w // 2, h)
        elif kind == "pitch":
            a, b = area(at, p, w, h // 2), area(at, p + h // 2, w, h - h // 2)
        elif kind == "check":
            a = area(at, p, w // 2, h // 2) + area(at + w // 2, p + h // 2, w - w // 2, h - h // 2)
            b = area(at + w // 2, p, w - w // 2, h // 2) + area(at, p + h // 2, w // 2, h - h // 2)
        else:
            third = h // 3
            b = area(at, p + third, w, third) * 2
            a = area(at, p, w, h) - b / 2
        ratio = np.log((1e-3 + a) / (1e-3 + b))
        level = (ratio > -0.15).astype(np.uint32) + (ratio > 0) + (ratio > 0.15)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return out


def landmarks(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing: of every WINNOW consecutive integers the one of the smallest hash, so recordings with that many in common share a landmark. Returns values and first places."""
    h = K.mix(fp.astype(np.uint64) + _U(77))
    w = min(WINNOW, len(h))
    spots = np.unique(np.lib.stride_tricks.sliding_window_view(h, w).argmin(axis=1) + np.arange(len(h) - w + 1))
    values, first = np.unique(fp[spots], return_index=True)
    return values, spots[first]


def _prints(sound: Sound):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, ids = [], []
            for data in batch.column(1):
                x, rate = samples_of(data.as_py() or b"", sound)
                fp = fingerprint(chroma(x, rate, sound)) if len(x) else np.zeros(0, np.uint32)
                fps.append(fp)
                rolled = K.mix(fp.astype(np.uint64) + (np.arange(len(fp), dtype=np.uint64) << _U(32)))
                ids.append(int(np.bitwise_xor.reduce(K.mix(rolled + _U(len(x))))) if len(fp) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in fps], pa.int32()), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array([x.astype("<u4").tobytes() for x in fps], pa.binary())], names=["doc_id", "n", "cid", "fp"])

    return run


def fingerprints(media: DataFrame, audio: Column, sound: Sound = Sound()) -> DataFrame:
    """doc_id, n (integers), cid (equal for equal fingerprints of as many samples) and fp (the integers, 4 bytes each) per row."""
    small_batches(media.sparkSession)
    schema = "doc_id {}, n int, cid long, fp binary".format(media.schema["doc_id"].dataType.simpleString())
    return media.select("doc_id", audio.alias("audio")).mapInArrow(_prints(sound), schema)


def ints_of(fp: bytes) -> np.ndarray:
    return np.frombuffer(fp, "<u4")


def packed(fp: np.ndarray) -> bytes:
    """Integers for a shuffle: one in about seven bits changes from one integer to the next, so the gaps between changes are written, by Rice's code: all units, then all remainders. The integers themselves follow a 0 where that is shorter."""
    last = np.concatenate([np.zeros(1, "<u4"), fp])
    changes = np.unpackbits((last[1:] ^ last[:-1]).astype("<u4").view(np.uint8), bitorder="little")
    gaps = np.diff(np.append(np.flatnonzero(changes), len(changes)), prepend=-1) - 1  # the last one ends the integers
    ends = np.cumsum((gaps >> RICE) + 1) - 1
    units = np.zeros(ends[-1] + 1, np.uint8)
    units[ends] = 1
    rest = ((gaps[:, None] >> np.arange(RICE)) & 1).astype(np.uint8).ravel()
    out = np.packbits(np.concatenate([units, rest]), bitorder="little").tobytes()
    return struct.pack("<I", len(units)) + out if len(out) < 4 * len(fp) else struct.pack("<I", 0) + fp.astype("<u4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    units = struct.unpack_from("<I", data)[0]
    if not units:
        return np.frombuffer(data, "<u4", offset=4)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=4), bitorder="little")
    ends = np.flatnonzero(bits[:units])
    rest = bits[units : units + RICE * len(ends)].reshape(-1, RICE) @ (1 << np.arange(RICE))
    at = np.cumsum(((np.diff(ends, prepend=-1) - 1) << RICE) + rest + 1) - 1
    changes = np.zeros(at[-1], np.uint8)
    changes[at[:-1]] = 1
    return np.bitwise_xor.accumulate(np.packbits(changes, bitorder="little").view("<u4"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows with fp, the last column, packed."""
    for batch in batches:
        fps = pa.array([packed(ints_of(x)) for x in batch.column(batch.num_columns - 1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fps], names=batch.schema.names)


def signs(fp: np.ndarray) -> np.ndarray:
    """The upper bit of each of the 16 filters' levels: whether the filter is above zero."""
    x = (fp >> np.uint32(1)) & np.uint32(0x55555555)
    for shift, mask in ((1, 0x33333333), (2, 0x0F0F0F0F), (4, 0x00FF00FF), (8, 0x0000FFFF)):
        x = (x | (x >> np.uint32(shift))) & np.uint32(mask)
    return x.astype("<u2")


def surroundings(fp: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Per place WORDS words: the signs at the AROUND integers before (the nearest first) and then after; 0 where there is none."""
    reach = AROUND * STEP
    padded = np.concatenate([np.zeros(reach, "<u2"), signs(fp), np.zeros(reach, "<u2")])
    steps = np.arange(1, AROUND + 1) * STEP
    return np.ascontiguousarray(padded[places[:, None] + np.concatenate([-steps, steps]) + reach]).view("<u8")


def _masks() -> np.ndarray:
    """The words' bits that count where 0 to AROUND integers before, and as many after, are there."""
    out = np.zeros((AROUND + 1, AROUND + 1, 2 * AROUND), dtype="<u2")
    for before in range(AROUND + 1):
        for after in range(AROUND + 1):
            out[before, after, :before] = out[before, after, AROUND : AROUND + after] = 0xFFFF
    return out.view("<u8").reshape((AROUND + 1) ** 2, -1)


MASKS = _masks()
WORDS = MASKS.shape[1]


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From num, root, fp: a row per landmark with its surroundings."""
    for batch in batches:
        rows = []
        for num, root, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            fp = ints_of(data.as_py())
            if len(fp) < LEAST_OVERLAP:
                continue
            values, places = landmarks(fp)
            rows.append((values, np.full(len(values), num), np.full(len(values), root), np.full(len(values), len(fp)), places, surroundings(fp, places)))
        if rows:
            value, num, root, n, place, around = (np.concatenate(x) for x in zip(*rows, strict=True))
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * WORDS), len(value), [None, pa.py_buffer(around.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int32)), pa.array(num, pa.int64()), pa.array(root, pa.int64()), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32)), packed], names=["value", "num", "root", "n", "place", "around"])


@dataclass
class Marks:
    """Landmarks by value and then num. Those of one root aren't compared; a root of -1 is compared with all."""

    value: np.ndarray
    num: np.ndarray
    root: np.ndarray
    n: np.ndarray
    place: np.ndarray
    around: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch) -> Marks:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        around = np.frombuffer(b"".join(batch.column(5).to_pylist()), "<u8").reshape(len(batch), WORDS)
        return Marks(*columns, around)

    @staticmethod
    def joined(parts: list[Marks]) -> Marks:
        return Marks(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("value", "num", "root", "n", "place", "around")))

    def take(self, a: int, b: int) -> Marks:
        return Marks(*(getattr(self, f)[a:b] for f in ("value", "num", "root", "n", "place", "around")))

    def packed(self) -> bytes:
        return b"".join(np.ascontiguousarray(x, t).tobytes() for x, t in ((self.num, "<i8"), (self.root, "<i8"), (self.n, "<i4"), (self.place, "<i4"), (self.around, "<u8")))

    @staticmethod
    def unpacked(data: bytes) -> Marks:
        k, at, out = len(data) // (24 + 8 * WORDS), 0, []
        for t, width in (("<i8", 8), ("<i8", 8), ("<i4", 4), ("<i4", 4), ("<u8", 8 * WORDS)):
            out.append(np.frombuffer(data, t, offset=at, count=k * width // np.dtype(t).itemsize))
            at += k * width
        num, root, n, place, around = out
        return Marks(np.zeros(k, np.int32), num, root, n, place, around.reshape(k, WORDS))


def agree(x: Marks, i: np.ndarray, y: Marks, j: np.ndarray) -> np.ndarray:
    """Which pairs of equal landmarks are votes: they leave enough overlap and what both have around them is alike."""
    px, py = x.place[i], y.place[j]
    before, after = np.minimum(px, py), np.minimum(x.n[i] - px, y.n[j] - py) - 1
    some = np.flatnonzero(before + after + 1 >= LEAST_OVERLAP)
    i, j = i[some], j[some]
    before, after = np.minimum(before[some] // STEP, AROUND), np.minimum(after[some] // STEP, AROUND)
    mask, most = before * (AROUND + 1) + after, AROUND_ERROR * 16 * (before + after)
    wrong = np.zeros(len(i), np.int64)
    for w in range(WORDS):
        wrong += np.bitwise_count((x.around[i, w] ^ y.around[j, w]) & MASKS[mask, w])
    out = np.zeros(len(px), dtype=bool)
    out[some] = wrong <= most
    return out


def votes_of(x: Marks, y: Marks | None, first: np.ndarray, count: np.ndarray, partners: int | None) -> tuple[np.ndarray, ...]:
    """For each mark k of y (or of x itself) its pairs with the count[k] marks of x from first[k] on: places of the voted for and of the voters, at most `partners` for each voter, the first ones; and voters that had more, with the last that each named."""
    later = y or x
    rows = np.flatnonzero(count > 0)
    found_i, found_j, more, last, at = *([np.zeros(0, np.int64)] for _ in range(4)), 0
    total = np.cumsum(count[rows])
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        part, k = rows[at:to], count[rows[at:to]]
        j = np.repeat(part, k)
        i = np.arange(len(j)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[part], k)
        apart = (x.root[i] != later.root[j]) | (later.root[j] < 0)
        i, j = i[apart], j[apart]
        good = agree(x, i, later, j)
        i, j = i[good], j[good]
        if partners is not None and len(j):
            start = np.flatnonzero(np.append(True, j[1:] != j[:-1]))
            size = np.diff(np.append(start, len(j)))
            more.append(j[start[size > partners]])
            last.append(i[start[size > partners] + partners - 1])
            early = np.arange(len(j)) - np.repeat(start, size) < partners
            i, j = i[early], j[early]
        found_i.append(i)
        found_j.append(j)
        at = to
    return tuple(np.concatenate(x) for x in (found_i, found_j, more, last))


VOTES = "num long, leader long, offset int, more int, block int, marks binary"


def _rows(num, leader, offset, more=None, block=None, marks=None) -> pa.RecordBatch:
    k = len(num)
    columns = [pa.array(num, pa.int64()), pa.array(leader, pa.int64()) if leader is not None else pa.nulls(k, pa.int64()), pa.array(offset, pa.int32()) if offset is not None else pa.nulls(k, pa.int32())]
    columns += [pa.array(x, t) if x is not None else pa.nulls(k, t) for x, t in ((more, pa.int32()), (block, pa.int32()), (marks, pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, names=["num", "leader", "offset", "more", "block", "marks"])


def _votes(partners: int | None):
    """From marks sorted by value and num: a row (num, leader, offset) for each vote, (num, the last named, more) where a voter has more of a value's partners than it may name, and (value as num, block, marks) for each block of a value that has more than BLOCK marks."""

    def settle(m: Marks) -> Iterator[pa.RecordBatch]:
        """Whole values of at most BLOCK marks: each mark with those before it."""
        start = np.flatnonzero(np.append(True, m.value[1:] != m.value[:-1]))
        first = np.repeat(start, np.diff(np.append(start, len(m.value))))
        i, j, more, last = votes_of(m, None, first, np.arange(len(m.value)) - first, partners)
        yield _rows(m.num[j], m.num[i], m.place[i] - m.place[j])
        if len(more):
            yield _rows(m.num[more], m.num[last], None, m.value[more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Marks | None = None  # the last value so far, which may go on
        block = 0  # blocks of it that were given away
        for batch in batches:
            m = Marks.of(batch) if held is None else Marks.joined([held, Marks.of(batch)])
            while len(m.value):
                first = int(np.searchsorted(m.value, m.value[0], "right"))
                if block or first > BLOCK:  # a value of several blocks comes first
                    if first < BLOCK and first == len(m.value):
                        break
                    take = min(first, BLOCK)
                    yield _rows([int(m.value[0])], None, None, None, [block], [m.take(0, take).packed()])
                    block = 0 if take == first < len(m.value) else block + 1
                    m = m.take(take, len(m.value))
                    continue
                last = int(np.searchsorted(m.value, m.value[-1], "left"))
                # values before the last are whole; those with too many marks are left for the next turn
                sizes = np.diff(np.flatnonzero(np.concatenate([[True], m.value[1:] != m.value[:-1], [True]])))
                ends = np.cumsum(sizes)
                big = np.flatnonzero(sizes > BLOCK)
                stop = min(last, int(ends[big[0]] - sizes[big[0]]) if len(big) else last)
                if stop:
                    yield from settle(m.take(0, stop))
                    m = m.take(stop, len(m.value))
                if not len(big) or not stop:
                    break
            held = m if len(m.value) else None
        if held is not None:
            if block:
                yield _rows([int(held.value[0])], None, None, None, [block], [held.packed()])
            else:
                yield from settle(held)

    return run


def _across(partners: int | None):
    """From pairs of blocks of a value (value, a, left, b, right): rows as _votes gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value, a, left, b, right in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                x = Marks.unpacked(left)
                y = None if a == b else Marks.unpacked(right)
                z, size = y or x, len(x.num)
                i, j, more, last = votes_of(x, y, np.zeros(len(z.num), np.int64), np.full(len(z.num), size) if y else np.arange(size), partners)
                yield _rows(z.num[j], x.num[i], x.place[i] - z.place[j])
                if len(more):
                    yield _rows(z.num[more], x.num[last], None, np.full(len(more), value))

    return run


def votes(marks: DataFrame, partners: int | None, ws: Workspace, name: str) -> DataFrame:
    """VOTES of marks, without blocks: a value of very many marks is dealt to tasks by pairs of its blocks."""
    sorted_marks = marks.repartition("value").sortWithinPartitions("value", "num")
    spark = marks.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(4 * BLOCK))  # marks are small
    found = ws.put(sorted_marks.mapInArrow(_votes(partners), VOTES), name)
    small_batches(spark)
    blocks = found.where("block IS NOT NULL").select(F.col("num").alias("value"), "block", "marks")
    if blocks.isEmpty():
        return found
    left, right = blocks.withColumnsRenamed({"block": "a", "marks": "left"}), blocks.withColumnsRenamed({"block": "b", "marks": "right"})
    pairs = left.join(right, "value").where("a <= b").select(F.col("value").cast("int").alias("value"), "a", "left", "b", "right")
    return found.where("block IS NULL").unionByName(ws.put(pairs.repartition("value", "a", "b").mapInArrow(_across(partners), VOTES), f"{name}-blocks"))


def _errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From num, leader, offset, votes, fp, fq (the integers in common): the share of different bits instead of the last two."""
    for batch in batches:
        error = [int(np.bitwise_count(ints_of(x) ^ ints_of(y)).sum(dtype=np.int64)) / (8 * len(x)) if x else 1.0 for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.array(error, pa.float64())], names=["num", "leader", "offset", "votes", "bit_error"])


def _rooms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows by home and part, those with integers first (home, part, num, start, packed fp) and then candidates (leader, offset, votes, low, common): num, leader, offset, votes, fp, fq of each candidate."""
    room, held = None, {}
    for batch in batches:
        out, size = [], 0
        for home, part, num, start, fp, leader, offset, votes, low, common in zip(*(batch.column(i).to_pylist() for i in range(10)), strict=True):
            if room != (home, part):
                room, held = (home, part), {}
            if fp is not None:
                held[num] = start, unpacked(fp).tobytes()
                continue
            (a, x), (b, y) = held[num], held[leader]
            a, b = 4 * (low - a), 4 * (low + offset - b)
            out.append((num, leader, offset, votes, x[a : a + 4 * common], y[b : b + 4 * common]))
            size += 8 * common
            if size > ARROW_BYTES:
                yield _pairs(out)
                out, size = [], 0
        if out:
            yield _pairs(out)


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["num", "leader", "offset", "votes", "fp", "fq"])


def _room_errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _errors(_rooms(batches))


def seats(tried: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """tried with the room, home and part, in which each candidate is compared. A voter's home is the leader that most candidates name of those it names, or that one's home; so alike recordings meet, and a room needs each once. A home of many candidates has several parts."""
    named = ws.put(tried.groupBy("leader").agg(F.count("*").alias("_rows")), f"{name}-named")
    most = F.max_by("leader", F.struct("_rows", -F.col("leader"))).alias("home")
    homes = keyed(tried.select("num", "leader"), named, "leader", counts=named).groupBy("num").agg(most, F.count("*").alias("tries"))
    homes = ws.put(homes, f"{name}-homes-0")
    for k in (1, 2):  # the home of the home, twice
        onward = homes.select(F.col("num").alias("home"), F.col("home").alias("next"))
        homes = ws.put(keyed(homes, onward, "home", how="left").select("num", F.coalesce("next", "home").alias("home"), "tries"), f"{name}-homes-{k}")
    rooms = homes.groupBy("home").agg(F.count("*").alias("rows"), F.ceil(F.sum("tries") / BLOCK).cast("int").alias("parts"))
    homes = ws.put(keyed(homes, ws.put(rooms, f"{name}-rooms"), "home", "rows"), f"{name}-homes")
    # a voter of very many candidates is in several parts
    dealt = F.when(F.col("tries") > BLOCK, F.xxhash64("num", "leader")).otherwise(F.xxhash64("num"))
    seated = keyed(tried, homes, "num", counts=homes.select("num", F.col("tries").alias("_rows")))
    return ws.put(seated.withColumn("part", F.pmod(dealt, F.col("parts")).cast("int")).drop("parts", "tries"), f"{name}-seats")


def first_of(found: DataFrame, prints: DataFrame, most_error: float, ws: Workspace, name: str) -> DataFrame:
    """num, leader, leaders: of each voter all leaders that pass at any voted offset, and the smallest of them. prints: num, n, fp of each class."""
    peaks = ws.put(found.where("offset IS NOT NULL").groupBy("num", "leader", "offset").agg(F.count("*").alias("votes")), f"{name}-peaks")
    involved = ws.put(peaks.select("num").unionByName(peaks.select(F.col("leader").alias("num"))).distinct(), f"{name}-involved")
    size = ws.put(keyed(prints.select("num", "n"), involved, "num"), f"{name}-sizes")
    low, high = F.greatest(F.lit(0), -F.col("offset")), F.least(F.col("n"), F.col("n_leader") - F.col("offset"))
    tried = keyed(keyed(peaks, size.withColumnsRenamed({"num": "leader", "n": "n_leader"}), "leader"), size, "num")
    tried = tried.select("num", "leader", "offset", "votes", low.alias("low"), (high - low).alias("common")).where(F.col("common") >= LEAST_OVERLAP)
    # written, as the joins count their keys first; a candidate is made once
    seated = seats(ws.put(tried, f"{name}-tried"), ws, name)
    # of each recording of a room only the integers that its candidates there have in common go on, once for all of them
    ends = lambda who, shift: seated.select("home", "part", F.col(who).alias("num"), (F.col("low") + shift).alias("start"), (F.col("low") + F.col("common") + shift).alias("stop"))
    wanted = ends("num", F.lit(0)).unionByName(ends("leader", F.col("offset"))).groupBy("home", "part", "num").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    wanted = ws.put(wanted, f"{name}-wanted")
    marked = within(wanted)
    held = keyed(wanted, prints.select("num", "fp"), "num") if marked is wanted else prints.select("num", "fp").join(marked, "num")
    held = held.select("home", "part", "num", "start", F.substr("fp", F.col("start") * 4 + 1, (F.col("stop") - F.col("start")) * 4).alias("fp"))
    held = held.mapInArrow(_packed, held.schema)
    rows = held.unionByName(seated, allowMissingColumns=True).select("home", "part", "num", "start", "fp", "leader", "offset", "votes", "low", "common")
    rows = rows.repartition("home", "part").sortWithinPartitions("home", "part", F.col("fp").isNull())
    tried = rows.mapInArrow(_room_errors, "num long, leader long, offset int, votes long, bit_error double")
    return ws.put(tried.where(F.col("bit_error") <= most_error).groupBy("num").agg(F.min("leader").alias("leader"), F.collect_set("leader").alias("leaders")), name)


def _linked(tile: np.ndarray, side: np.ndarray, num: np.ndarray, fps: list[np.ndarray], most_error: float) -> pa.RecordBatch:
    """LINKS of recordings by tile and then num: each is compared with those of its tile, or of the tile's other side where side isn't -1, at every offset of their offset histogram."""
    n = np.array([len(x) for x in fps])
    found = [landmarks(x) for x in fps]
    row = np.repeat(np.arange(len(fps)), [len(v) for v, _ in found])
    value, place = (np.concatenate(x) for x in zip(*found, strict=True))
    around = np.concatenate([surroundings(x, places) for x, (_, places) in zip(fps, found, strict=True)])
    order = np.lexsort((row, value, tile[row]))
    row, value = row[order], value[order]
    marks = Marks(value, row, side[row], n[row], place[order], around[order])
    start = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (tile[row][1:] != tile[row][:-1])]))
    first = np.repeat(start, np.diff(np.append(start, len(row))))
    i, j, _, _ = votes_of(marks, None, first, np.arange(len(row)) - first, None)
    later, leader, offset = row[j], row[i], marks.place[i].astype(np.int64) - marks.place[j]
    order = np.lexsort((offset, leader, later))
    later, leader, offset = later[order], leader[order], offset[order]
    peak = np.flatnonzero(np.concatenate([[True] * (len(later) > 0), (later[1:] != later[:-1]) | (leader[1:] != leader[:-1]) | (offset[1:] != offset[:-1])]))
    votes = np.diff(np.append(peak, len(later)))
    later, leader, offset = later[peak], leader[peak], offset[peak]
    # the bits that differ over the integers in common
    data, at = np.concatenate(fps), np.cumsum(n) - n
    low = np.maximum(0, -offset)
    common = np.minimum(n[later], n[leader] - offset) - low
    wrong, ends, k = np.zeros(len(later), np.int64), np.cumsum(common), 0
    while k < len(later):
        to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + INTS, "right")))
        c = common[k:to]
        starts = np.cumsum(c) - c
        step = np.arange(int(c.sum())) - np.repeat(starts, c)
        x, y = np.repeat((at[later] + low)[k:to], c) + step, np.repeat((at[leader] + low + offset)[k:to], c) + step
        wrong[k:to] = np.add.reduceat(np.bitwise_count(data[x] ^ data[y]).astype(np.int64), starts)
        k = to
    error = wrong / (32 * common)
    good = np.flatnonzero(error <= most_error)
    # by voter, leader, votes and offset
    good = good[np.lexsort((offset[good], -votes[good], leader[good], later[good]))]
    pair = good[np.flatnonzero(np.concatenate([[True] * (len(good) > 0), (later[good][1:] != later[good][:-1]) | (leader[good][1:] != leader[good][:-1])]))]
    links = np.bincount(later[pair], minlength=len(fps)) + np.bincount(leader[pair], minlength=len(fps))
    best = np.full(len(fps), -1)
    best[later[pair][::-1]] = pair[::-1]  # the first of each voter is written last
    rows = np.flatnonzero(links)
    best, none = best[rows], best[rows] < 0
    columns = [pa.array(num[rows], pa.int64()), pa.array(links[rows], pa.int64())]
    columns += [pa.array(x[best], t, mask=none) for x, t in ((num[leader], pa.int64()), (offset.astype(np.int32), pa.int32()), (votes, pa.int64()), (error, pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, names=["num", "n_links", "leader", "offset", "votes", "bit_error"])


LINKS = "num long, n_links long, leader long, offset int, votes long, bit_error double"


def _tiles(most_error: float):
    """From rows sorted by root, a, b (two parts of a component, or one and itself), with part, num, fp (packed): LINKS of each tile. A tile of more than PART recordings a side is compared by pieces."""

    def pieces(rows: list[tuple]) -> Iterator[list[tuple]]:
        """(side, num, fp) of each piece of one tile's rows."""
        _, a, b = rows[0][0]
        sides = [sorted((num, fp) for _, part, num, fp in rows if part == p) for p in ((a,) if a == b else (a, b))]
        cut = [[x[k : k + 4 * PART] for k in range(0, len(x), 4 * PART)] for x in sides]
        for k, x in enumerate(cut[0]):
            for y in cut[-1][k if a == b else 0 :]:
                yield [(-1, *r) for r in x] if x is y else sorted([*((0, *r) for r in x), *((1, *r) for r in y)], key=lambda r: r[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # of the tile so far
        ready: list[tuple] = []  # of whole pieces
        size = tile = 0

        def take(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal ready, size, tile
            for piece in pieces(rows):
                ready += [(tile, side, num, ints_of(fp)) for side, num, fp in piece]
                size, tile = size + sum(len(fp) for *_, fp in piece) // 4, tile + 1
                if size >= INTS // 16:
                    yield linked()

        def linked() -> pa.RecordBatch:
            nonlocal ready, size
            tiles, sides, nums, fps = zip(*ready, strict=True)
            ready, size = [], 0
            return _linked(np.array(tiles), np.array(sides), np.array(nums), list(fps), most_error)

        for batch in batches:
            root, a, b, part, num, fp = (batch.column(i).to_pylist() for i in range(6))
            for row in zip(zip(root, a, b, strict=True), part, num, (unpacked(x).tobytes() for x in fp), strict=True):
                if held and held[0][0] != row[0]:
                    yield from take(held)
                    held = []
                held.append(row)
        if held:
            yield from take(held)
        if ready:
            yield linked()

    return run


def links_within(members: DataFrame, own: DataFrame, most_error: float, ws: Workspace) -> DataFrame:
    """members: num, root of each class that is linked. Per class num, n_links (the classes of its component that match it) and its match: leader, offset, votes, bit_error, null where none is earlier."""
    sizes = ws.put(members.groupBy("root").agg(F.count("*").alias("rows")).withColumn("parts", F.least(F.lit(PARTS), F.ceil(F.sqrt(F.col("rows") / (4 * PART)))).cast("int")), "components")
    dealt = keyed(members, sizes, "root", "rows").withColumn("part", F.pmod(F.xxhash64("num"), F.col("parts")).cast("int"))
    dealt = keyed(own.select("num", "fp"), ws.put(dealt, "dealt"), "num").select("num", "root", "part", "parts", "fp")
    dealt = ws.put(dealt.mapInArrow(_packed, dealt.schema), "parts")
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = tiles.select("root", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "num", "fp")
    found = tiles.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b").mapInArrow(_tiles(most_error), LINKS)
    first = F.min(F.when(F.col("leader").isNotNull(), F.struct("leader", "offset", "votes", "bit_error"))).alias("first")
    return found.groupBy("num").agg(F.sum("n_links").alias("n_links"), first).select("num", "n_links", "first.*")


def align(media: DataFrame, audio: Column, sound: Sound = Sound(), most_error: float = MOST_ERROR) -> DataFrame:
    """One row per row of media: doc_id, n_ints, class_id, class_size, match_id, offset, votes, bit_error, component_id, n_links.

    Recordings of equal fingerprints and lengths are one class, named by its smallest doc_id. Two classes link at an
    offset where at most most_error of the bits differ over at least LEAST_OVERLAP integers. Candidates come from offset
    histograms: equal landmarks (winnowed integers, each value at its first place) with alike surroundings vote for the
    difference of their places, and every offset with a vote is verified. n_links is the number of other classes that the
    class links to, and component_id the smallest class_id that links reach, itself included. match_id is the smallest
    earlier class (of smaller class_id) that it links to, null where there is none; of its passing offsets that with most votes is
    taken, then the smallest. offset is in hops: the match's place 0 is at this recording's place -offset.

    At first a landmark votes for the PARTNERS smallest classes that have it. The landmarks that more classes have vote for all
    of them afterwards, save within a component of the links so far; so PARTNERS changes no component. In the end the
    classes of each component are compared in tasks, each pair once, and only counts and matches leave the tasks; so no
    pairs are made of a large group of near copies. Landmarks are an index: a link of classes that share none is
    not found (the README gives the recall).

    A null or empty recording has no integers, matches nothing and is its own class. Sounds shorter than the filters' span
    are padded with silence; those of fewer than LEAST_OVERLAP integers match as a whole only. Rows that repeat are one
    class. An empty table gives an empty result.
    """
    ws = Workspace(media.sparkSession, "chroma")
    prints = ws.put(fingerprints(media, audio, sound).withColumn("tag", F.monotonically_increasing_id()), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("o"), "doc_id", "tag")).alias("first")
    classes = prints.where("n > 0").groupBy("cid").agg(first, F.count("*").alias("class_size"), F.first("n").alias("n"))
    # num has the order of class ids, so that earlier classes have smaller ones
    classes = classes.repartitionByRange("first").sortWithinPartitions("first").withColumn("num", F.monotonically_increasing_id())
    classes = ws.put(classes.select("num", "cid", F.col("first.doc_id").alias("class_id"), F.col("first.tag").alias("tag"), "class_size", "n"), "classes")
    own = ws.put(keyed(prints.select("tag", "fp"), classes.select("tag", "num", "n"), "tag").select("num", "n", "fp"), "own")

    schema = "value int, num long, root long, n int, place int, around binary"
    found = votes(own.select("num", F.lit(-1).cast("long").alias("root"), "fp").mapInArrow(_marks, schema), PARTNERS, ws, "votes")
    ws.release()
    ends = ("num", F.explode("leaders").alias("v"))
    links = first_of(found, own, most_error, ws, "matched").select(*ends).withColumnRenamed("num", "u")
    roots = components(links, ws, "first-roots")
    ws.release()
    # values of which a voter didn't name all partners; those of the same component are linked already, those up to the last named were tried
    more = found.where("more IS NOT NULL")
    voters = ws.put(more.select("num").distinct(), "more-voters")
    more = ws.put(more.groupBy(F.col("more").alias("value")).agg(F.min("leader").alias("named"), F.max("num").alias("last")), "more")
    if not more.isEmpty():
        placed = keyed(own, roots.withColumnRenamed("id", "num"), "num", how="left").select("num", F.coalesce("root", "num").alias("root"), "fp")
        marks = keyed(placed.mapInArrow(_marks, schema), more, "value").where("num > named AND num <= last").drop("named", "last")
        again, tried = (semi(x, voters, "num") for x in (votes(marks, None, ws, "all-votes"), found.where("offset IS NOT NULL")))
        again = again.join(tried.select("num", "leader", "offset"), ["num", "leader", "offset"], "left_anti")
        rest = first_of(again, own, most_error, ws, "rest").select(*ends).withColumnRenamed("num", "u")
        if not rest.isEmpty():
            roots = components(roots.select(F.col("id").alias("u"), F.col("root").alias("v")).unionByName(rest), ws, "roots")
        ws.release()
    members = ws.put(roots.select(F.col("id").alias("num"), "root").unionByName(roots.select(F.col("root").alias("num"), "root").distinct()), "members")
    matched = ws.put(keyed(links_within(members, own, most_error, ws), members, "num"), "linked")
    ws.release()
    leaders = classes.select(F.col("num").alias("leader"), F.col("class_id").alias("match_id"))
    matched = keyed(matched, leaders, "leader", how="left")
    matched = ws.put(keyed(matched, classes.select(F.col("num").alias("root"), F.col("class_id").alias("component_id")), "root"), "named-links")
    named = classes.select("num", "cid", "class_id", "class_size").join(matched, "num", "left").withColumns({"component_id": F.when(F.col("root").isNull(), F.col("class_id")).otherwise(F.col("component_id")), "n_links": F.coalesce("n_links", F.lit(0))})
    named = ws.put(named.select("cid", "class_id", "class_size", "match_id", "offset", "votes", "bit_error", "component_id", "n_links"), "named")
    out = keyed(prints.select("doc_id", "n", "cid"), named.withColumn("rows", F.col("class_size")), "cid", "rows", how="left")
    silent = F.col("n") == 0
    own_class = [F.when(silent, F.col("doc_id")).otherwise(F.col(x)).alias(x) for x in ("class_id", "component_id")]
    match = [F.when(~silent, F.col(x)).alias(x) for x in ("match_id", "offset", "votes", "bit_error")]
    return out.select("doc_id", F.col("n").cast("long").alias("n_ints"), own_class[0], F.when(silent, 1).otherwise(F.col("class_size")).cast("long").alias("class_size"), *match, own_class[1], F.when(silent, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"))
