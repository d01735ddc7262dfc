"""SentencePiece encoding and decoding (3): unigram Viterbi over a double-array trie, with byte fallback."""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostweave.llm.common import small_batches

MARK = "▁"
#: Default vocabulary file; any SentencePiece model with byte pieces will do.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: A character without a piece costs this much more than the worst piece (then its bytes are emitted).
UNKNOWN_PENALTY = 10.0
#: Segments that a worker remembers before it forgets them all, and the bytes beyond which it remembers none. Longer ones are segmented one by one, BLOCK start bytes at a time.
REMEMBERED, LONG, BLOCK = 400_000, 256, 1 << 16
#: Runs of spaces go with the word that follows, as pieces have the marker in front only. New lines and marker characters stand alone.
SEGMENT = re.compile(rf" *[^ \n{MARK}]+|\n|{MARK}| +")


class DoubleArray:
    """A trie over UTF-8 bytes: node s has a child by byte c at t = base[s] + c where check[t] == s; value[t] is the piece that ends there, or -1."""

    def __init__(self, words: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for word, i in words.items():
            s = 0
            for c in word:
                if c not in children[s]:
                    children[s][c] = len(children)
                    children.append({})
                    ends.append(-1)
                s = children[s][c]
            ends[s] = i
        size = 3 * len(children) + 4096
        free = np.ones(size, dtype=bool)
        free[0] = False
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        place, todo = {0: 0}, [0]
        since = {True: 1, False: 1}  # where to look for room, for nodes with one child (they fill holes) and with more
        while todo:
            node = todo.pop()
            if not children[node]:
                continue
            codes = np.array(sorted(children[node]))
            at, one = 0, len(codes) == 1
            while not at:
                window = np.flatnonzero(free[since[one] : since[one] + 1024]) + since[one] - codes[0]
                window = window[(window >= 1) & (window + 256 < size)]
                fits = free[window[:, None] + codes].all(axis=1)
                if fits.any():
                    at = int(window[fits.argmax()])
                elif since[one] >= size:
                    raise ValueError("the trie has no room")
                else:
                    since[one] += 1024
            self.base[place[node]] = at
            free[at + codes] = False
            self.check[at + codes] = place[node]
            for c in codes.tolist():
                child = children[node][c]
                place[child] = at + c
                self.value[at + c] = ends[child]
                todo.append(child)


@dataclass
class Vocabulary:
    pieces: list[bytes]  # what each id stands for in a text
    scores: np.ndarray
    trie: DoubleArray
    byte_ids: list[int]
    unknown: float

    def __post_init__(self):
        self.memory: dict[str, bytes] = {}

    def byte_fallback(self, raw: bytes) -> list[int]:
        return [self.byte_ids[b] for b in raw.replace(MARK.encode(), b" ")]

    def _matches(self, text: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and id of every piece that begins at a byte of begin..end, by start: one step of the trie for all of them at once."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        at, state, j = np.arange(begin, end), np.zeros(end - begin, dtype=np.int64), 0
        found = []
        while len(at):
            inside = at + j < len(text)
            at, state = at[inside], state[inside]
            go = base[state] + text[at + j]
            ok = check[go] == state
            at, state, j = at[ok], go[ok].astype(np.int64), j + 1
            hit = value[state] >= 0
            found.append((at[hit], at[hit] + j, value[state[hit]]))
        starts, ends, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((ends, starts))
        return starts[order], ends[order], ids[order]

    def segment_long(self, segment: str) -> np.ndarray:
        """Viterbi over one long segment: the pieces of a block of start bytes are looked up together, and then the scores run over them."""
        raw = segment.replace(" ", MARK).encode()
        text, n = np.frombuffer(raw, np.uint8), len(raw)
        best, back, piece = array("d", [-math.inf]) * (n + 1), array("q", [-1]) * (n + 1), array("i", [-1]) * (n + 1)
        best[0] = 0.0
        widths = 1 + (text >= 0xC0).astype(np.int64) + (text >= 0xE0) + (text >= 0xF0)
        for a in range(0, n, BLOCK):
            b = min(n, a + BLOCK)
            starts, ends, ids = self._matches(text, a, b)
            ranges = np.searchsorted(starts, np.arange(a, b + 1)).tolist()
            scores, ends, ids, width = self.scores[ids].tolist(), ends.tolist(), ids.tolist(), widths[a:b].tolist()
            for i in range(a, b):
                here = best[i]
                if here == -math.inf:
                    continue
                single = i + width[i - a]
                whole = False
                for k in range(ranges[i - a], ranges[i - a + 1]):
                    to, score = ends[k], here + scores[k]
                    whole = whole or to == single
                    if score > best[to]:
                        best[to], back[to], piece[to] = score, i, ids[k]
                if not whole and here + self.unknown > best[single]:
                    best[single], back[single], piece[single] = here + self.unknown, i, -1
        return np.array(self._walk(raw, back, piece), dtype=np.int32)

    def _walk(self, raw: bytes, back, piece) -> list[int]:
        """The ids of the best path, followed from the end."""
        at, found = len(raw), []
        while at:
            if piece[at] >= 0:
                found.append(piece[at])
            else:
                found += reversed(self.byte_fallback(raw[back[at] : at]))
            at = back[at]
        found.reverse()
        return found

    def learn(self, segments: Iterable[str]) -> None:
        """Viterbi over many segments at once: one step for each start byte and piece length."""
        segments = sorted(segments, key=len)
        for a in range(0, len(segments), 4096):
            self._learn(segments[a : a + 4096])

    def _learn(self, segments: list[str]) -> None:
        raw = [s.replace(" ", MARK).encode() for s in segments]
        n, lengths = len(raw), np.array([len(x) for x in raw])
        longest = int(lengths.max())
        if n > 1 and n * longest > 1 << 22:  # long segments: fewer at once
            self._learn(segments[: n // 2])
            self._learn(segments[n // 2 :])
            return
        text = np.zeros((n, longest + 1), dtype=np.uint8)
        for i, x in enumerate(raw):
            text[i, : len(x)] = np.frombuffer(x, np.uint8)
        best = np.full((n, longest + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, longest + 1), np.int32), np.full((n, longest + 1), -1, np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(longest):
            rows = np.flatnonzero((best[:, i] > -np.inf) & (lengths > i))
            lead = text[rows, i]
            width = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            here, single = best[rows, i], np.zeros(len(rows), dtype=bool)
            state, live, j = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows)), i
            while len(live):
                go = base[state] + text[rows[live], j]
                ok = (check[go] == state) & (lengths[rows[live]] > j)
                live, state, j = live[ok], go[ok].astype(np.int64), j + 1
                ends = value[state]
                at = ends >= 0
                if at.any():
                    hit, ids = live[at], ends[at]
                    single[hit] |= width[hit] == j - i
                    score = here[hit] + self.scores[ids]
                    better = score > best[rows[hit], j]
                    r = rows[hit[better]]
                    best[r, j], back[r, j], piece[r, j] = score[better], i, ids[better]
            if not single.all():
                r, to, score = rows[~single], i + width[~single].astype(np.int64), here[~single] + self.unknown
                better = score > best[r, to]
                r, to = r[better], to[better]
                best[r, to], back[r, to], piece[r, to] = score[better], i, -1
        for s, x, since, ids in zip(segments, raw, back.tolist(), piece.tolist(), strict=True):
            self.memory[s] = array("i", self._walk(x, since, ids)).tobytes()

    def encode_many(self, texts: Iterable[str], together: int = 1 << 20) -> Iterator[np.ndarray]:
        """Ids of each text; new segments of about `together` characters of texts are segmented in one go."""
        waiting, size = [], 0
        for text in texts:
            waiting.append(SEGMENT.findall(text))
            size += len(text)
            if size >= together:
                yield from self._flush(waiting)
                waiting, size = [], 0
        yield from self._flush(waiting)

    def _flush(self, waiting: list[list[str]]) -> Iterator[np.ndarray]:
        memory = self.memory
        every = set().union(*waiting)
        long = {s: self.segment_long(s).tobytes() for s in every if len(s) > LONG}
        every.difference_update(long)
        if len(memory) + len(every) > REMEMBERED:
            memory.clear()
        # the marker character itself isn't a space
        memory[MARK] = array("i", [self.byte_ids[b] for b in MARK.encode()]).tobytes()
        self.learn(every.difference(memory))
        for segments in waiting:
            yield np.frombuffer(b"".join([memory[s] if len(s) <= LONG else long[s] for s in segments]) if long else b"".join(map(memory.__getitem__, segments)), np.int32)

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_many([text]))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids. An id that the vocabulary lacks, and bytes that aren't UTF-8 (of cut ids), become U+FFFD."""
        n = len(self.pieces)
        return b"".join([self.pieces[i] if 0 <= i < n else b"\xff" for i in ids.tolist()]).decode("utf-8", "replace")


def load(path: str = MODEL_FILE) -> Vocabulary:
    """Pieces of a SentencePiece file. A unigram file's scores are log probabilities; a merge list's are ranks, which become Zipf-Mandelbrot log scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    given = np.array([sp.get_score(i) for i in range(n)])
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    ranked = np.array_equal(given[plain], np.round(given[plain]))
    scores = np.array([-math.log(2.7 - x) for x in given]) if ranked else given
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if not all(sp.is_byte(i) for i in byte_ids):
        raise ValueError("the vocabulary has no byte pieces")
    value = {i: bytes([b]) for b, i in enumerate(byte_ids)}
    pieces = [value.get(i, names[i].replace(MARK, " ").encode() if not (sp.is_control(i) or sp.is_unknown(i)) else b"") for i in range(n)]
    # a piece with the marker behind another character would cross segments
    usable = {names[i].encode(): i for i in plain if MARK not in names[i].lstrip(MARK) and "\n" not in names[i]}
    return Vocabulary(pieces, scores, DoubleArray(usable), byte_ids, float(scores[plain].min()) - UNKNOWN_PENALTY)


def _encode(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            ids = list(v.encode_many(texts))
            whole = [v.decode(x) == text for x, text in zip(ids, texts, strict=True)]
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(np.diff(offsets).astype(np.int64)), pa.array(whole)], names=["doc_id", "ids", "n_tokens", "round_trip"])

    return run


def broadcast(spark: SparkSession, path: str = MODEL_FILE):
    """The vocabulary for all executors; its size is that of the file's pieces."""
    return spark.sparkContext.broadcast(load(path))


def encode(docs: DataFrame, path: str = MODEL_FILE) -> DataFrame:
    """One row per row of docs: doc_id, ids, n_tokens, round_trip (the decoded ids are the text).

    The best-scored sequence of pieces of the whole text; of equal scores, the one whose last piece begins first. Spaces are
    the marker; no space is added, no text is normalised, so decoding gives the text back. New lines, the marker character
    itself and characters without a piece become byte pieces. A null or empty text has no ids. Repeated rows are encoded
    alike, an empty table gives an empty result and other columns are ignored.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id {}, ids array<int>, n_tokens long, round_trip boolean".format(docs.schema["doc_id"].dataType.simpleString())
    return docs.select("doc_id", "text").mapInArrow(_encode(broadcast(docs.sparkSession, path)), schema)


def decode(encoded: DataFrame, path: str = MODEL_FILE) -> DataFrame:
    """doc_id and text of a table with doc_id and ids. Null or no ids are an empty text; a null id, one that the vocabulary lacks, and bytes that aren't UTF-8 become U+FFFD."""
    vocabulary = broadcast(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [vocabulary.value.decode(np.array([-1 if i is None else i for i in x or []], dtype=np.int32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    small_batches(encoded.sparkSession)
    return encoded.select("doc_id", F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id {}, text string".format(encoded.schema["doc_id"].dataType.simpleString()))
