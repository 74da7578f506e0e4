"""SentencePiece encoding and decoding by a streaming Viterbi search."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The public vocabulary used by default; a parameter everywhere.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: A piece that falls back to bytes costs this much more than the worst piece.
BYTE_PENALTY = 10.0
#: Segmented chunks that a worker remembers; the memory is emptied when full, results do not depend on it.
REMEMBERED = 400_000
#: Characters of text that a worker holds at a time, beyond one whole text.
BATCH_CHARS = 4_000_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores, and the ids of the bytes."""

    pieces: dict[str, int]
    scores: list[float]
    byte_ids: list[int]
    contents: list[bytes]
    dummy_prefix: bool

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        """Read a model file on the driver; pieces of control and unknown kind take no part."""
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        with open(path, "rb") as file:
            data = file.read()
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(data)
        model = SentencePieceProcessor(model_proto=data)
        normal = proto.normalizer_spec
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces:
            raise ValueError("only models with the identity normalizer are supported")
        if not all(model.is_byte(model.piece_to_id(f"<0x{b:02X}>")) for b in range(256)):
            raise ValueError("the model needs byte fallback")
        pieces, contents = {}, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            special = model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
            if model.is_byte(i):
                contents.append(bytes([int(piece[3:5], 16)]))
            else:
                contents.append(b"" if special else piece.replace(SPACE, " ").encode())
                if not special:
                    pieces[piece] = i
        scores = [model.get_score(i) for i in range(model.get_piece_size())]
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls(pieces, scores, byte_ids, contents, normal.add_dummy_prefix)

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    @cached_property
    def byte_score(self) -> float:
        return min([0.0, *(self.scores[i] for i in self.pieces.values())]) - BYTE_PENALTY

    @cached_property
    def prefixes(self) -> set[str]:
        return {p[:n] for p in self.pieces for n in range(1, len(p) + 1)}

    @cached_property
    def starts_at_space(self) -> bool:
        """No piece goes on past the start of a word or past either side of a line end, so all paths meet there."""
        return not any(SPACE in p.lstrip(SPACE) or ("\n" in p and p.lstrip(SPACE) != "\n") for p in self.pieces)


def segment(text: str, vocabulary: Vocabulary) -> Iterator[int]:
    """Ids of the best segmentation of an escaped text, given out as soon as they are certain.

    Forward Viterbi search: best[j] is the best score of the first j characters and back[j] the piece that ends
    there. Only the boundaries within reach of the next pieces (the longest piece) are open. When all open
    boundaries trace back to one common boundary, everything before it is
    certain: its ids are given out and forgotten. So memory is bounded by the distance over which
    paths disagree, not by the text. Equal scores: the longer piece wins.
    """
    pieces, scores, prefixes, reach = vocabulary.pieces, vocabulary.scores, vocabulary.prefixes, vocabulary.longest
    best: dict[int, float] = {0: 0.0}
    back: dict[int, tuple[int, tuple[int, ...]]] = {}
    done, end = 0, len(text)
    frontier = 0  # the furthest boundary that a piece has reached
    for i in range(end):
        score = best.pop(i)
        j = i + 1
        single = False
        while j <= min(end, i + reach):
            part = text[i:j]
            if part not in prefixes:
                break
            found = pieces.get(part)
            if found is not None:
                single = single or j == i + 1
                total = score + scores[found]
                if j not in best or total > best[j]:
                    best[j], back[j] = total, (i, (found,))
                frontier = max(frontier, j)
            j += 1
        if not single:
            data = text[i].encode("utf-8", "surrogatepass")
            total = score + vocabulary.byte_score * len(data)
            if i + 1 not in best or total > best[i + 1]:
                best[i + 1], back[i + 1] = total, (i, tuple(vocabulary.byte_ids[b] for b in data))
            frontier = max(frontier, i + 1)
        if len(best) == 1:  # every surviving path goes through this boundary
            yield from trace(back, done, frontier)
            back.clear()
            done = frontier
        elif len(back) >= 4 * reach and i % reach == 0:
            common = meeting(best, back, done)
            if common > done:
                yield from trace(back, done, common)
                for k in [k for k in back if k <= common]:
                    del back[k]
                done = common
    if done < end:
        yield from trace(back, done, end)


def trace(back: dict[int, tuple[int, tuple[int, ...]]], start: int, end: int) -> Iterator[int]:
    """Ids of the path from ``start`` to ``end``."""
    parts = []
    while end > start:
        end, ids = back[end]
        parts.append(ids)
    for ids in reversed(parts):
        yield from ids


def meeting(best: dict[int, float], back: dict, done: int) -> int:
    """The last boundary that the paths of all open boundaries share."""
    open_ends = set(best)
    while len(open_ends) > 1:
        last = max(open_ends)
        open_ends.remove(last)
        open_ends.add(back[last][0] if last > done else done)
    return open_ends.pop()


class PieceTable:
    """Ids of pieces by the hash of their characters: each hash has one place, found through a table of shifts."""

    BASE = np.uint64(0x9E3779B97F4A7C15)
    SLOTS, BUCKETS = 17, 12

    def __init__(self, vocabulary: Vocabulary):
        powers = [1]
        for _ in range(vocabulary.longest):
            powers.append(powers[-1] * int(self.BASE) % 2**64)
        self.powers = np.array(powers, np.uint64)
        names = list(vocabulary.pieces)
        keys = np.array([self._hash(p) for p in names], np.uint64)
        if len(set(keys.tolist())) < len(names):
            raise ValueError("two pieces share a hash")
        self.shift = np.zeros(1 << self.BUCKETS, np.uint64)
        self.key = np.zeros(1 << self.SLOTS, np.uint64)
        self.id = np.full(1 << self.SLOTS, -1, np.int32)
        ids = np.array(list(vocabulary.pieces.values()), np.int32)
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
        for group in sorted(groups, key=len, reverse=True):
            if not len(group):
                continue
            for trial in range(100_000):
                slots = self._slot(keys[group], np.uint64(trial * 0x2545F4914F6CDD1D % 2**64))
                if len(set(slots.tolist())) == len(group) and (self.id[slots] < 0).all():
                    break
            else:
                raise ValueError("no free places")
            self.shift[bucket[group[0]]] = trial * 0x2545F4914F6CDD1D % 2**64
            self.key[slots], self.id[slots] = keys[group], ids[group]

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self.BASE) + ord(c) + 1) % 2**64
        return h

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.BUCKETS)

    def _slot(self, keys: np.ndarray, shift) -> np.ndarray:
        return ((keys ^ shift) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - self.SLOTS)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ids by hash, -1 where no piece has it."""
        slots = self._slot(keys, self.shift[self._bucket(keys)])
        return np.where(self.key[slots] == keys, self.id[slots], -1)


def segment_words(words: list[str], vocabulary: Vocabulary, table: PieceTable, scores: np.ndarray) -> list[bytes]:
    """The search of :func:`segment` for many words of one length at once; every character must be a piece."""
    n, length, reach = len(words), len(words[0]), vocabulary.longest
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(n, length).T.astype(np.uint64)
    hashes = np.zeros((length + 1, n), np.uint64)
    for j in range(length):
        hashes[j + 1] = hashes[j] * table.BASE + codes[j] + np.uint64(1)
    best = np.full((length + 1, n), -np.inf)
    best[0] = 0
    piece = np.zeros((length + 1, n), np.int32)
    width = np.zeros((length + 1, n), np.int64)
    for j in range(1, length + 1):
        for size in range(min(reach, j), 0, -1):  # equal scores: the longer piece wins
            found = table.find(hashes[j] - hashes[j - size] * table.powers[size])
            hit = np.flatnonzero(found >= 0)
            if not len(hit):
                continue
            ids = found[hit]
            total = best[j - size, hit] + scores[ids]
            better = total > best[j, hit]
            hit, ids = hit[better], ids[better]
            best[j, hit], piece[j, hit], width[j, hit] = total[better], ids, size
    out = np.zeros((n, length), np.int32)
    at, count, rows = np.full(n, length), np.zeros(n, np.int64), np.arange(n)
    while len(rows):
        count[rows] += 1
        out[rows, length - count[rows]] = piece[at[rows], rows]
        at[rows] -= width[at[rows], rows]
        rows = rows[at[rows] > 0]
    data, row_bytes = out.tobytes(), 4 * length
    return [data[(i + 1) * row_bytes - 4 * c : (i + 1) * row_bytes] for i, c in enumerate(count.tolist())]


class Encoder(dict):
    """Bytes of the ids (little-endian 32 bits) of chunks, remembered for chunks that come again.

    Where no piece of the vocabulary can cross (before a space, around a line end) all paths meet, so
    chunks are independent and the search may take many at once. Long chunks, and those with characters
    that fall back to bytes, are streamed.
    """

    #: Chunks up to this length are searched together.
    TOGETHER = 40

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        super().__init__()
        self.vocabulary, self.remembered = vocabulary, remembered
        self.table, self.scores = PieceTable(vocabulary), np.array(vocabulary.scores)
        self.singles = {p for p in vocabulary.pieces if len(p) == 1}
        self.split = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}*\n|{SPACE}+").findall

    def learn(self, chunks: set[str]) -> None:
        """Search the chunks that are not remembered."""
        by_length: dict[int, list[str]] = {}
        for chunk in chunks.difference(self):
            if len(chunk) <= self.TOGETHER and self.singles.issuperset(chunk):
                by_length.setdefault(len(chunk), []).append(chunk)
            else:
                self[chunk] = np.fromiter(segment(chunk, self.vocabulary), np.int32).tobytes()
        for words in by_length.values():
            self.update(zip(words, segment_words(words, self.vocabulary, self.table, self.scores)))

    def encode_all(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids of whole texts; None for None."""
        if len(self) >= self.remembered:
            self.clear()
        prefix = SPACE if self.vocabulary.dummy_prefix else ""
        apart = self.split if self.vocabulary.starts_at_space else lambda t: [t]
        chunks = [apart(prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        self.learn(set().union(*chunks))
        return [None if t is None else b"".join(map(self.__getitem__, c)) for t, c in zip(texts, chunks)]


def decode(ids, vocabulary: Vocabulary) -> str:
    """The text of ids: contents joined, the added space taken off; bytes that are not UTF-8 become U+FFFD."""
    text = b"".join(map(vocabulary.contents.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if vocabulary.dummy_prefix and text.startswith(" ") else text


def encode(
    docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", check: bool = True
) -> DataFrame:
    """(key, ids array<int>, n_ids, round_trip): pieces of every whole text, and whether they decode to it again.

    The vocabulary (tens of thousands of pieces, bounded by its file) goes to the tasks with the function. A null text
    has null ids, an empty one none. Rows are independent: no shuffle, repeated rows give repeated
    rows, columns of docs named like the new ones do not matter, no rows give no rows.
    ``check=False`` leaves round_trip null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        contents, prefix = shared.value.contents, shared.value.dummy_prefix

        def flush(keys: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
            found = encoder.encode_all(texts)
            offsets = np.zeros(len(found) + 1, np.int32)
            np.cumsum([0 if x is None else len(x) // 4 for x in found], out=offsets[1:])
            values = np.frombuffer(b"".join(x for x in found if x), np.int32)
            nulls = pa.array([x is None for x in found], pa.bool_())
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=nulls)
            same: list[bool | None] = [None] * len(found)
            if check:
                items = values.tolist()
                for i, t in enumerate(texts):
                    if t is not None:
                        again = b"".join(map(contents.__getitem__, items[offsets[i] : offsets[i + 1]]))
                        same[i] = again == (b" " if prefix and t else b"") + t.encode("utf-8", "surrogatepass")
            count = pa.array([None if x is None else len(x) // 4 for x in found], pa.int64())
            return pa.RecordBatch.from_arrays([keys, ids, count, pa.array(same, pa.bool_())], ["key", "ids", "n_ids", "round_trip"])

        for batch in batches:
            keys, texts, start, held = batch.column(0), [], 0, 0
            for i, t in enumerate(batch.column(1)):
                texts.append(t.as_py())
                held += len(texts[-1] or "")
                if held >= BATCH_CHARS:
                    yield flush(keys.slice(start, i + 1 - start), texts)
                    texts, start, held = [], i + 1, 0
            if texts:
                yield flush(keys.slice(start), texts)

    kind = docs.schema[key].dataType.simpleString()
    wide = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    return wide.mapInArrow(run, f"key {kind}, ids array<int>, n_ids long, round_trip boolean").withColumnRenamed("key", key)
