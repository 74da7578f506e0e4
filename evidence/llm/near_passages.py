"""Near-duplicate passages by compact windows of min-hashes over five-word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from evidence.llm.components import sent
from evidence.llm.shingles import SHINGLE, in_batches, mix, shingles, words
from evidence.operators.scale import stored

#: Hash functions, words of a passage and similarity of the sets of shingles of two passages, at least.
FUNCTIONS, PASSAGE, SIMILARITY = 8, 50, 0.8
#: Unmatched shingles side by side, and words that one side has more than the other, that are allowed in passages of any length.
GAP, BAND = 10, 12
#: Windows of one signature that are compared in pairs after two centres; the shingle of a larger group is no smallest one any more.
CROWD = 32
#: Ids of copies that may go to every task; more are left out by a shuffle.
COPIES = 2_000_000
#: Texts of a block that are compared with one other, on average.
BLOCK = 32
#: Shingles of texts that a worker compares side by side, beyond one pair.
SIDE_BY_SIDE = 150_000
#: Tables of earlier turns that a turn reads; those after the first are merged beyond.
FEW = 3

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(x)
    if n < width:
        return x[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def compact_windows(hashes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, left, right): all parts i..j with left <= i <= centre <= j <= right have their smallest hash at the centre.

    These are the nodes of the Cartesian tree over the hashes, with the spans of their subtrees, and together they hold every part
    of the sequence. Only spans of ``least`` places or more are given. A place is a centre if it is the minimum of some part
    of that length, that is if the largest of the minima of the parts around it is its own hash; the nearest smaller hash
    on either side bounds the span and is found by steps of powers of two over range minima. Of equal hashes the
    leftmost counts as the smallest, so each of a row of equal minima has a span of its own. A hash of 0 ends a text.
    """
    empty = np.zeros(0, np.int64)
    low = sliding_min(hashes, least)
    if not low.any():
        return empty, empty, empty
    sides = np.zeros(least - 1, np.uint64)
    highest = ~sliding_min(~np.concatenate([sides, low, sides]), least)
    centre = np.flatnonzero((highest == hashes) & (hashes > 0))
    stops = np.flatnonzero(hashes == 0)
    longest = int(np.diff(np.concatenate([[-1], stops, [len(hashes)]])).max())
    levels = [hashes]
    while 2 ** len(levels) <= longest:
        step = 2 ** (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
    own = hashes[centre]
    right, left = centre + 1, centre - 1
    for j in range(len(levels) - 1, -1, -1):
        size, table = 2**j, levels[j]
        fits = right + size <= len(hashes)
        go = fits & (table[np.where(fits, right, 0)] >= own)
        right = right + size * go
        fits = left - size + 1 >= 0
        go = fits & (table[np.where(fits, left - size + 1, 0)] > own)
        left = left - size * go
    left, right = left + 1, right - 1
    wide = right - left + 1 >= least
    return centre[wide], left[wide], right[wide]


def ordered(found: np.ndarray, k: int) -> np.ndarray:
    """Hashes of shingles for the function of number ``k`` (under 16), which the last bits hold; never 0 and without the first bit."""
    return (mix(found ^ (np.uint64(k + 1) * _GOLD)) >> np.uint64(1)) & ~np.uint64(31) | np.uint64(16 + k)


def folded(plain: DataFrame) -> DataFrame:
    """(doc, n_words, leader): texts of (doc, text) with the same words as that of a smaller document, the smallest of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def then(batch: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
            split = [(t or b"").split() for t in texts]
            same = pa.array([hashlib.blake2b(b" ".join(w), digest_size=16).digest() for w in split], pa.binary())
            return pa.RecordBatch.from_arrays([batch.column(0), same, pa.array([len(w) for w in split], pa.int64())], ["doc", "same", "n_words"])

        yield from in_batches(batches, "text", then)

    signed = stored(plain.mapInArrow(run, "doc long, same binary, n_words long"))
    leaders = signed.groupBy("same").agg(F.min("doc").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return stored(signed.join(leaders.drop("n"), "same").where("doc > leader").select("doc", "n_words", "leader"))


def chunked(plain: DataFrame) -> DataFrame:
    """(chunk, docs, packed): the words of many texts in one compressed row, which the smallest of its ids names; null as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress

        def then(batch: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
            docs = batch.column(0).to_numpy()
            plain = pack(b"\n".join(b" ".join((t or b"").split()) for t in texts))
            return pa.RecordBatch.from_arrays([
                pa.array([docs.min()], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([plain], pa.binary()),
            ], ["chunk", "docs", "packed"])

        yield from in_batches(batches, "text", then)

    return plain.mapInArrow(run, "chunk long, docs array<long>, packed binary")


def _slots(found: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (part, 32 bits) of hashes as numbers in order, the one of each hash, how often each occurs, and where each part begins."""
    slot = (found >> np.uint64(32)) % np.uint64(parts) << np.uint64(32) | found & np.uint64(0xFFFFFFFF)
    values, which, often = np.unique(slot, return_inverse=True, return_counts=True)
    return values, which, often, np.searchsorted(values, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))


def shared_elsewhere(chunks: DataFrame, parts: int) -> DataFrame:
    """(chunk, part, bits): for the distinct shingles of a chunk, dealt to ``parts`` by their hashes, whether another chunk holds them.

    Of a hash 32 bits beside the part are compared: a shingle of one place seldom counts as shared, one of two always.
    """

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                values, _, _, begin = _slots(shingles(words(unpack(packed.as_py()).split(b"\n"))).hash, parts)
                low = values.astype(np.uint32)
                some = np.flatnonzero(np.diff(begin))
                rows = [low[begin[i] : begin[i + 1]].tobytes() for i in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), chunk)), pa.array(some.astype(np.int32)), pa.array(rows, pa.binary())], ["chunk", "part", "held"]
                )

    def counted(table: pa.Table) -> pa.Table:
        held = [np.frombuffer(h.as_py(), np.uint32) for h in table.column("held")]
        every = np.sort(np.concatenate(held))
        twice = every[1:][every[1:] == every[:-1]]
        bits = [np.packbits(_among(h, twice)).tobytes() for h in held]
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "bits": pa.array(bits, pa.binary())})

    return chunks.select("chunk", "packed").mapInArrow(dealt, "chunk long, part int, held binary").groupBy("part").applyInArrow(
        counted, "chunk long, part int, bits binary"
    )


def _among(x: np.ndarray, ordered_values: np.ndarray) -> np.ndarray:
    """Which of x are among values in order."""
    if not len(ordered_values):
        return np.zeros(len(x), bool)
    return ordered_values[np.minimum(np.searchsorted(ordered_values, x), len(ordered_values) - 1)] == x


def dense_runs(shared: np.ndarray, first: np.ndarray, least: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the runs of places that lie in a part of ``least`` places or more, ``similarity`` of them shared; ``first`` is where texts begin.

    A shingle that is not shared has one place, so the share of places is no less than that of different shingles. With
    1 - similarity for a shared place, less similarity for another, and a fall after each text that nothing makes up for, such a part
    is one whose sum is not negative; the longest from a place ends where the running maximum from the right is last as high.
    """
    counts = np.diff(first)
    if len(counts) == 1 and len(shared) >= least and np.count_nonzero(shared) >= similarity * len(shared):
        return first[:1], first[1:]
    up, down = int(np.ceil((1 - similarity) * 1000 - 1e-6)), int(np.floor(similarity * 1000 + 1e-6))
    at = np.arange(len(shared)) + np.repeat(np.arange(len(counts)), counts)
    step = np.full(len(shared) + len(counts), -(up + down) * (int(counts.max(initial=0)) + 1), np.int64)
    step[at] = np.where(shared, up, -down)
    n = len(step) + 1 - least
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.zeros(len(step) + 1, np.int64)
    np.cumsum(step, out=total[1:])
    # a place is inside if some part of ``least`` or more around it has a sum that is not negative: one that begins far before it, or near
    highest = np.maximum.accumulate(total[::-1])[::-1]
    near = np.zeros(len(step) + 1, np.int64)
    np.cumsum(highest[least:] >= total[:n], out=near[1 : n + 1])
    near[n + 1 :] = near[n]
    inside = near[1:] > 0
    inside[least - 1 :] = near[least:] > near[: n]
    inside[least - 1 :] |= highest[least:] >= np.minimum.accumulate(total[:n])
    inside = inside[at]
    turns = np.zeros(len(shared) + 1, bool)  # a text begins a run of its own
    turns[first] = True
    opens = inside & (turns[:-1] | ~np.concatenate([[False], inside[:-1]]))
    closes = inside & (turns[1:] | ~np.concatenate([inside[1:], [False]]))
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def dense_parts(chunks: DataFrame, passage: int, similarity: float) -> DataFrame:
    """(doc, place, size, held): where runs of ``dense_runs`` begin in a text, their sizes, and their hashes of shingles; texts without any are left out.

    Both sides of a passage lie in such runs: they have ``similarity`` of their shingles in common, and these are shared.
    """
    least, parts = passage - SHINGLE + 1, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = shared_elsewhere(chunks, parts).groupBy("chunk").agg(F.collect_list("part").alias("part"), F.collect_list("bits").alias("bits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for docs, packed, which, bits in zip(*(batch.column(i) for i in range(4))):
                found = shingles(words(unpack(packed.as_py()).split(b"\n")))
                _, slot, often, begin = _slots(found.hash, parts)
                shared = often > 1
                for i, b in zip(which.as_py() or [], bits.as_py() or []):
                    lo, hi = begin[i], begin[i + 1]
                    shared[lo:hi] |= np.unpackbits(np.frombuffer(b, np.uint8), count=hi - lo).view(bool)
                start, end = dense_runs(shared[slot], found.first, least, similarity)
                if not len(start):
                    continue
                text = np.searchsorted(found.first, start, "right") - 1
                of = np.flatnonzero(np.diff(text, prepend=-1))
                ends = np.append(of, len(text)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (start - found.first[text], end - start)]
                held = [b"".join(found.hash[start[j] : end[j]].tobytes() for j in range(x, y)) for x, y in zip(ends[:-1], ends[1:])]
                own = pa.array(np.asarray(docs.as_py(), np.int64)[text[of]])
                yield pa.RecordBatch.from_arrays([own, *lists, pa.array(held, pa.binary())], ["doc", "place", "size", "held"])

    return chunks.join(known, "chunk", "left").select("docs", "packed", "part", "bits").mapInArrow(
        run, "doc long, place array<int>, size array<int>, held binary"
    )


def unpacked(places: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of packed centres the place, and the first and last place where a part of ``least`` shingles begins that lies in the window and holds the centre."""
    at = places >> 32
    return at, at - (places >> 16 & 0xFFFF), at + (places & 0xFFFF) - least + 1


_WINDOWS, _LINKS = ["signature", "doc", "size"], ["doc", "other", "signature", "there", "size"]


def _dealt(part: np.ndarray, rows: list[np.ndarray], places: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Rows with lists of places, of which the last column has the sizes, as one row of bytes for each part."""
    order = np.argsort(part, kind="stable")
    size = rows[-1]
    values = places[_ranges((np.cumsum(size) - size)[order], size[order])]
    part, rows = part[order], [r[order] for r in rows]
    begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])[: len(part)])
    end = np.append(begin[1:], len(part))[: len(begin)]
    until = np.concatenate([[0], np.cumsum(rows[-1])])
    columns = [[r[a:b].tobytes() for a, b in zip(begin, end)] for r in rows] + [[values[until[a] : until[b]].tobytes() for a, b in zip(begin, end)]]
    return pa.RecordBatch.from_arrays([pa.array(part[begin], pa.int32()), *[pa.array(c, pa.binary()) for c in columns]], ["part", *names, "places"])


def _undealt(table: pa.Table, names: list[str]) -> list[np.ndarray]:
    """The columns of ``_dealt`` with all places at the end."""
    return [np.frombuffer(b"".join(table.column(n).to_pylist()), np.int64) for n in (*names, "places")]


def linked(windows: DataFrame, parts: int) -> DataFrame:
    """(doc, other, places, least, most): of ``all_windows`` those that are not the smallest of their signature, with the document and place of that one, by pairs of documents."""

    def first(table: pa.Table) -> pa.Table:
        signature, doc, size, places = _undealt(table, _WINDOWS)
        order = np.lexsort((doc, signature))
        begin = (np.cumsum(size) - size)[order]
        signature, doc, size = signature[order], doc[order], size[order]
        opens = np.flatnonzero(np.concatenate([[True], signature[1:] != signature[:-1]]))
        rows = np.diff(np.append(opens, len(signature)))
        other, there = np.repeat(doc[opens], rows), np.repeat(places[begin[opens]] >> 32, rows)
        begin[opens] += 1  # the smallest itself
        size[opens] -= 1
        some = np.flatnonzero(size)
        doc, other, size = doc[some], other[some], size[some]
        part = (mix(doc.view(np.uint64) ^ mix(other.view(np.uint64) + _GOLD)) % np.uint64(parts)).astype(np.int32)
        batch = _dealt(part, [doc, other, signature[some], there[some], size], places[_ranges(begin[some], size)], _LINKS)
        return pa.Table.from_batches([batch])

    def second(table: pa.Table) -> pa.Table:
        doc, other, signature, there, size, places = _undealt(table, _LINKS)
        order = np.lexsort((signature, other, doc))
        begin = (np.cumsum(size) - size)[order]
        doc, other, signature, there, size = (c[order] for c in (doc, other, signature, there, size))
        opens = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (other[1:] != other[:-1])]))
        edge = np.append(opens, len(doc))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(places[_ranges(begin, size)]))
        at = pa.StructArray.from_arrays([pa.array(signature), lists, pa.array(there), pa.array(np.ones(len(doc), bool))], ["signature", "places", "there", "new"])
        return pa.table({
            "doc": doc[opens], "other": other[opens], "places": pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), at),
            "least": signature[opens], "most": signature[edge[1:] - 1],
        })

    schema = "part int, doc binary, other binary, signature binary, there binary, size binary, places binary"
    return windows.groupBy("part").applyInArrow(first, schema).groupBy("part").applyInArrow(
        second, "doc long, other long, places array<struct<signature:long,places:array<long>,there:long,new:boolean>>, least long, most long"
    )


def all_windows(dense: DataFrame, functions: int, passage: int, parts: int, crowded: np.ndarray | None = None) -> DataFrame:
    """(part, signature, doc, size, places): the centres of the compact windows of every text in its dense parts, each as a number (see ``unpacked``), dealt to parts by signature.

    With the signatures of crowded groups their shingles come after all others in every function, and only windows that
    hold such a shingle are given. A negative signature is that of a window with no other shingles in reach.
    """
    least = passage - SHINGLE + 1
    shared = None if crowded is None else dense.sparkSession.sparkContext.broadcast(np.sort(crowded).view(np.uint64))

    def found_in(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64)
        begin, size = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (1, 2))
        text = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy())
        stop = np.cumsum(size + 1) - 1
        at = np.arange(len(found)) + np.repeat(np.arange(len(size)), size)  # a stop after each run
        late = np.zeros(len(found), bool)
        if shared is not None:
            for k in range(functions):
                late |= np.isin(ordered(found, k), shared.value)
        before = np.zeros(len(found) + len(size) + 1, np.int64)
        before[at + 1] = late
        before = np.cumsum(before)
        signature, owner, place = [], [], []
        for k in range(functions):
            hashes = np.zeros(len(found) + len(size), np.uint64)
            hashes[at] = ordered(found, k) | (late.astype(np.uint64) << np.uint64(63))
            centre, left, right = compact_windows(hashes, least)
            if shared is not None:
                centre = centre[before[right + 1] > before[left]]
            which = np.searchsorted(stop, centre, "left")
            signature.append(hashes[centre].view(np.int64))
            owner.append(text[which])
            near = [np.minimum(d, least - 1) for d in (centre - left, right - centre)] if shared is None else [least - 1] * 2
            place.append((centre - (stop - size)[which] + begin[which]) << 32 | near[0] << 16 | near[1])
        signature, owner, place = np.concatenate(signature), np.concatenate(owner), np.concatenate(place)
        order = np.lexsort((place, owner, signature))
        signature, owner, place = signature[order], owner[order], place[order]
        of = np.flatnonzero(np.concatenate([[True], (np.diff(signature) != 0) | (np.diff(owner) != 0)])[: len(signature)])
        size = np.diff(np.append(of, len(place)))
        part = (signature[of].view(np.uint64) >> np.uint64(32)) % np.uint64(parts)
        return _dealt(part.astype(np.int32), [signature[of], batch.column(0).to_numpy()[owner[of]], size], place, _WINDOWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(batches, "held", lambda batch, _: found_in(batch))

    return dense.mapInArrow(run, "part int, signature binary, doc binary, size binary, places binary")


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def _highest(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Running maxima inside groups, which are numbered in order."""
    wide = group * (2 * int(np.abs(x).max(initial=0)) + 1)
    return np.maximum.accumulate(x + wide) - wide


#: Shingles of the dense parts of a text, where each begins in the text, and their sizes.
Parts = tuple[np.ndarray, np.ndarray, np.ndarray]


def _first_of(codes: np.ndarray, size: int) -> np.ndarray:
    """Where each code comes first."""
    first = np.zeros(size, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return first


def common_passages(
    x: np.ndarray, y: np.ndarray, places: list[tuple[int, int]], least: int, similarity: float, same: bool
) -> list[tuple[int, int, int, int, float]]:
    """(start, end, start there, end there, similarity) of passages of x and y around places with equal shingles.

    A passage grows from the place over shingles that both have at about the same distance. The similarity leaves room for
    about m * (1 / similarity - 1) unmatched ones beside m matched ones: so wide may a gap be, and so far may places shift by words
    added or left out. Of the growing spans the largest whose sets of shingles are similar enough on both sides counts;
    last comes the run of equal shingles. Places inside a passage that was found, or a run that was tried, are not tried again,
    nor is a place if passages hold every part of ``least`` shingles around it: parts without the place have others.

    In one text (``same``) places nearer than the words of a passage are no repeat. Passages do not overlap, but for a run of equal
    shingles in a periodic text: it may run on into itself, as each part of it is equal to one that lies far enough before.
    """
    at = np.array(sorted(places), np.int64).reshape(-1, 2)
    x, y = ((h, np.zeros(1, np.int64), np.array([len(h)])) for h in (x, y))
    return passages_around([(x, y, np.column_stack([at, at[:, 0] - least + 1, at[:, 0]]), same)], least, similarity)[0][0]


def passages_around(
    pairs: list[tuple[Parts, Parts, np.ndarray, bool]], least: int, similarity: float
) -> list[tuple[list[tuple[int, int, int, int, float]], np.ndarray]]:
    """For each (x, y, at, same): ``common_passages`` around the rows (place, place there, first and last begin of a part with the place) of ``at``; rows that need none as others hold these parts.

    Both sides of a passage lie in dense runs of one part; a shingle that only one side has counts where it comes first.
    Shingles are told apart by the pair and 64 bits, so that all pairs are handled side by side.
    """
    covered = np.zeros(sum(len(p[2]) for p in pairs), bool)
    found: list[list[tuple[int, int, int, int, float]]] = [[] for _ in pairs]
    same = np.array([p[3] for p in pairs], bool)
    (mine, theirs), size = _codes([p[0][0] for p in pairs], [p[1][0] for p in pairs])
    often = [np.bincount(c, minlength=size) for c in (mine, theirs)]
    count = np.array([len(p[2]) for p in pairs])
    of = np.repeat(np.arange(len(pairs)), count)
    at = np.concatenate([np.asarray(p[2], np.int64).reshape(-1, 4) for p in pairs])
    rows = np.flatnonzero(~same[of] | (np.abs(at[:, 0] - at[:, 1]) >= least + SHINGLE - 1))
    of, at = of[rows], at[rows]
    runs, moves, held = [], [], np.ones(len(rows), bool)
    for k, c in enumerate((mine, theirs)):
        place, length = (np.concatenate([p[k][i] for p in pairs]).astype(np.int64) for i in (1, 2))
        owner = np.repeat(np.arange(len(pairs)), [len(p[k][1]) for p in pairs])
        begins = np.concatenate([[0], np.cumsum(length)])
        shared = np.where(np.repeat(same[owner], length), often[k][c] > 1, often[1 - k][c] > 0)
        begin, end = dense_runs(shared | (_first_of(c, size)[c] < np.arange(len(c))), begins, least, similarity)
        move = begins[:-1] - place  # from a place of the text to that among all
        runs.append((begin, end, move[np.searchsorted(begins, begin, "right") - 1]))
        wide = int(max((place + length).max(initial=0), at[:, k].max(initial=0))) + 1
        i = np.maximum(np.searchsorted(owner * wide + place, of * wide + at[:, k], "right") - 1, 0)
        held &= (owner[i] == of) & (place[i] <= at[:, k]) & (at[:, k] < place[i] + length[i])
        moves.append(move[i])
    at[:, [0, 2, 3]] += moves[0][:, None]
    at[:, 1] += moves[1]
    rows, of, at = rows[held], of[held], at[held]
    inside = []
    for k in (0, 1):
        begin, end, _ = runs[k]
        i = np.searchsorted(begin, at[:, k], "right") - 1
        inside.append(np.where((i >= 0) & (at[:, k] < np.append(end, 0)[i]), i, -1))
    fits = np.flatnonzero((inside[0] >= 0) & (inside[1] >= 0))
    fits = fits[mine[at[fits, 0]] == theirs[at[fits, 1]]]
    if len(fits):
        rows, of, at = rows[fits], of[fits], at[fits]
        two = np.column_stack([inside[0][fits], inside[1][fits]])
        order = np.lexsort((at[:, 1], at[:, 0], two[:, 1], two[:, 0]))
        rows, of, at, two = rows[order], of[order], at[order], two[order]
        opens = np.flatnonzero(np.concatenate([[True], (two[1:] != two[:-1]).any(axis=1)]))
        low, high, move = ([runs[k][i][two[opens, k]] for k in (0, 1)] for i in (0, 1, 2))
        # so many jobs at once that the copies of their runs stay small
        total = np.cumsum(high[0] - low[0] + high[1] - low[1])
        cuts = np.flatnonzero(np.diff(total // SIDE_BY_SIDE)) + 1
        for some in np.split(np.arange(len(opens)), cuts):
            part = slice(opens[some[0]], opens[some[-1] + 1] if some[-1] + 1 < len(opens) else len(rows))
            pair = of[opens[some]]
            apart = low[0][some] - move[0][some] - low[1][some] + move[1][some]
            job = np.repeat(some - some[0], np.diff(np.append(opens[some], part.stop)))
            shift = np.column_stack([low[0][some], low[1][some], low[0][some], low[0][some]])[job]
            jobs = _Jobs(mine, theirs, [x[some] for x in low], [x[some] for x in high], size, same[pair], apart, least, similarity)
            new, without = jobs.run(job, at[part] - shift)
            covered[rows[part][without]] = True
            for j, k, m, n, o, alike in new:
                a, c = (low[i][some[j]] - move[i][some[j]] for i in (0, 1))
                found[pair[j]].append((int(a + k), int(a + m), int(c + n), int(c + o), alike))
    return [(sorted(f), c) for f, c in zip(found, np.split(covered, np.cumsum(count)[:-1]))]


def _codes(xs: list[np.ndarray], ys: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Shingles of all x and all y as small numbers, those of different pairs different."""
    salt = mix(np.arange(1, len(xs) + 1, dtype=np.uint64) * _GOLD)
    every = np.concatenate([h ^ s for side in (xs, ys) for h, s in zip(side, salt)])
    values, codes = np.unique(every, return_inverse=True)
    return np.split(codes, [sum(len(x) for x in xs)]), len(values)


class _Jobs:
    """Pairs of dense runs x and y of shingles as small numbers, of one text if ``same``, where x begins ``apart`` places after y.

    Places are counted in all x, or all y, one after the other; each turn tries the first place that each job has left.
    """

    def __init__(
        self, mine: np.ndarray, theirs: np.ndarray, low: list[np.ndarray], high: list[np.ndarray], size: int, same: np.ndarray, apart: np.ndarray,
        least: int, similarity: float,
    ) -> None:
        self.least, self.similarity, self.same, self.ahead = least, similarity, same, np.where(same, apart, 0)
        self.size = [h - b for b, h in zip(low, high)]
        self.base = [np.cumsum(n) - n for n in self.size]
        self.room = 1 / similarity - 1
        self.band = np.maximum(BAND, (np.minimum(*self.size) * self.room).astype(np.int64))
        job = [np.repeat(np.arange(len(n)), n) for n in self.size]
        # a pair may have several jobs, and a shingle of each has a number of its own
        every = np.concatenate([c[_ranges(b, n)] + j * size for c, b, n, j in zip((mine, theirs), low, self.size, job)])
        values, codes = np.unique(every, return_inverse=True)
        x, y = self.codes = np.split(codes, [len(job[0])])
        self.values = len(values)
        self.place = [np.arange(len(j)) - b[j] for j, b in zip(job, self.base)]
        wide = 2 * int(self.size[0].max() + self.size[1].max())
        self.there = np.sort(y * (2 * wide) + self.place[1] + wide)
        known = [np.zeros(self.values, bool) for _ in (0, 1)]
        known[0][x] = known[1][y] = True
        often = [np.bincount(c, minlength=self.values) for c in (x, y)]
        self.repeated = often[0][x] > 1
        self.several = often[1][x] > 1
        # how far the one place there lies, out of reach if there are none or more
        self.only = np.where(often[1][x] == 1, _first_of(y, self.values)[x] - np.arange(len(x)), 1 << 40)
        self.key = x * (2 * wide) + wide
        bare = [~other[c] & (_first_of(c, self.values)[c] == np.arange(len(c))) for c, other in zip((x, y), known[::-1])]
        # how many shingles that the other side has not come for the first time before each place
        self.alone = [np.concatenate([[0], np.cumsum(b)]) for b in bare]
        # both sides of a passage together have few such ones, so one side has no more than half of them
        self.strong = []
        for b, n in zip(bare, self.size):
            cover = np.zeros(len(b) + 1, np.int8)
            begin, end = dense_runs(~b, np.concatenate([[0], np.cumsum(n)]), least, 2 * similarity / (1 + similarity))
            cover[begin] += 1
            cover[end] -= 1
            self.strong.append(np.cumsum(cover[:-1], dtype=np.int8) > 0)
        self.held = np.zeros(len(x), bool)  # where parts of ``least`` shingles begin that a passage holds

    def run(self, job: np.ndarray, at: np.ndarray) -> tuple[list[tuple[int, int, int, int, int, float]], np.ndarray]:
        """Passages (job, start, end, start there, end there, similarity) around places of jobs, in order; rows that need none."""
        found: list[tuple[int, int, int, int, int, float]] = []
        covered = np.zeros(len(at), bool)
        base, other = self.base[0][job], self.base[1][job]
        here, there = at[:, 0] + base, at[:, 1] + other
        low, high = np.maximum(at[:, 2], 0) + base, np.minimum(at[:, 3], self.size[0][job] - self.least) + base
        tries = self.strong[0][here] | self.strong[1][there]
        row, dull = np.flatnonzero(tries), np.flatnonzero(~tries)  # no passage holds a dull one
        while len(row):
            of = job[row]
            head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            first = row[head]
            j, p, q = of[head], here[first], there[first]
            span = self.verbatim(j, p, q)
            alike = np.ones(len(j))
            known, none, best, value, done = self.tried(j, p, q, self.band[j], low[first], high[first])
            again = np.flatnonzero(~known & ~none & ~done & (self.band[j] > BAND))
            if len(again):
                known[again], _, best2, value2, _ = self.tried(j[again], p[again], q[again], np.full(len(again), BAND), low[first[again]], high[first[again]])
                longer = best2[:, 1] - best2[:, 0] > best[again, 1] - best[again, 0]
                best[again[longer]], value[again[longer]] = best2[longer], value2[longer]
            covered[first[known]] = True
            long = np.minimum(span[:, 1] - span[:, 0], span[:, 3] - span[:, 2]) + 1 >= self.least
            some = best[:, 1] >= best[:, 0]
            grown = some & ~(self.same[j] & long)
            span[grown], alike[grown] = best[grown], value[grown]
            new = (grown | long) & ~known
            for i in np.flatnonzero(new).tolist():
                k, m, n, o = span[i].tolist()
                x, y = int(self.base[0][j[i]]), int(self.base[1][j[i]])
                found.append((int(j[i]), k - x, m - x, n - y, o - y, float(alike[i])))
                self.held[k : m - self.least + 2] = True
            which = np.repeat(np.arange(len(j)), np.diff(np.append(head, len(row))))
            k, m, n, o = (span[which, c] for c in range(4))
            gone = (k <= here[row]) & (here[row] <= m) & (n <= there[row]) & (there[row] <= o)
            gone &= np.abs((here[row] - there[row]) - (k - n)) <= self.band[of]
            gone &= ~known[which]
            gone[head] = True
            row, which = row[~gone], which[~gone]
            check = np.flatnonzero(new[which])
            if len(check):
                full = self.all_held(j[new], low[row[check]], high[row[check]] + 1, job[row[check]])
                covered[row[check[full]]] = True
                keep = np.ones(len(row), bool)
                keep[check[full]] = False
                row = row[keep]
        if len(dull) and found:
            jobs = np.unique([f[0] for f in found])
            dull = dull[np.isin(job[dull], jobs)]
            covered[dull[self.all_held(jobs, low[dull], high[dull] + 1, job[dull])]] = True
        return found, covered

    def all_held(self, jobs: np.ndarray, low: np.ndarray, high: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Whether ``held`` holds all places from low on before high, in rows of some jobs."""
        base, size = self.base[0][jobs], self.size[0][jobs]
        sums = np.concatenate([[0], np.cumsum(self.held[_ranges(base, size)])])
        shift = (base - np.cumsum(size) + size)[np.searchsorted(jobs, of)]
        high = np.maximum(high, low)
        return sums[high - shift] - sums[low - shift] == high - low

    def verbatim(self, j: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The longest equal runs around two places of each job."""
        x, y = self.codes
        mine, theirs = p - self.base[0][j], q - self.base[1][j]
        back = np.minimum(mine, theirs)
        size = back + np.minimum(self.size[0][j] - mine, self.size[1][j] - theirs)
        at = _ranges(p - back, size)
        bad = np.flatnonzero(x[at] != y[at + np.repeat(q - p, size)])
        start = np.cumsum(size) - size
        i = np.searchsorted(bad, start + back)
        left = np.maximum(np.concatenate([[-1], bad])[i] + 1, start)
        right = np.minimum(np.append(bad, len(at))[i], start + size) - 1
        first, last = p - back + left - start, p - back + right - start
        return np.column_stack([first, last, first + q - p, last + q - p])

    def tried(
        self, j: np.ndarray, p: np.ndarray, q: np.ndarray, width: np.ndarray, low: np.ndarray, high: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each job: whether passages hold all parts around the place, whether it has no dense run, the largest similar span (empty if none), its similarity, and whether it is the last."""
        m = len(j)
        known, none, best, value, done = np.zeros(m, bool), np.ones(m, bool), np.zeros((m, 4), np.int64), np.ones(m), np.zeros(m, bool)
        best[:, 1] = -1
        x = self.codes[0]
        base, other = self.base[0][j], self.base[1][j]
        shift = (p - base) - (q - other)
        # a passage reaches no farther than y does, but for words put in
        start = np.maximum(0, shift - width) + base
        size = np.minimum(self.size[0][j], shift + self.size[1][j] + width) + base - start
        near = np.where(self.same[j], np.minimum(width, np.abs(shift + self.ahead[j]) - 1), width)
        edge = np.concatenate([[0], np.cumsum(size)])
        every, k = _ranges(start, size), np.repeat(np.arange(m), size)
        line = base + shift - other  # places of y are so far from those of x
        off = self.only[every] + line[k]
        hit = np.abs(off) <= near[k]
        several = np.flatnonzero(self.several[every])
        if len(several):
            i, j_of = every[several], k[several]
            key = self.key[i] + (i - (base + shift)[j_of])
            i = np.searchsorted(self.there, key)
            before, after = self.there[np.maximum(i - 1, 0)] - key, self.there[np.minimum(i, len(self.there) - 1)] - key
            off[several] = np.where(np.abs(before) <= np.abs(after), before, after)
            hit[several] = np.abs(off[several]) <= near[j_of]
        bare = ~hit
        hit = np.flatnonzero(hit)
        at, k = every[hit], k[hit]
        partner = off[hit] + at - line[k]
        count = np.bincount(k, minlength=m)
        # a shingle without a match counts where it comes first
        alone = np.flatnonzero(bare & self.repeated[every])
        if len(alone):
            codes = x[every[alone]]
            again = np.argsort(codes, kind="stable")
            codes = codes[again]
            bare[alone[again[1:][codes[1:] == codes[:-1]]]] = False
        begin, end = dense_runs(~bare, edge, self.least, self.similarity)
        if not len(begin):
            return known, none, best, value, done
        spot = edge[:-1] + p - start
        i = np.maximum(np.searchsorted(begin, spot, "right") - 1, 0)
        none = ~((begin[i] <= spot) & (spot < end[i]) & (count >= self.similarity * self.least - 1e-6))
        move = start - edge[:-1]
        a, b = np.maximum(begin[i] + move, low), np.minimum(high, end[i] + move - self.least) + 1
        ok = np.flatnonzero(~none & (b >= base))  # a place whose parts all begin before x is tried
        known[ok] = [self.held[c:d].all() for c, d in zip(a[ok].tolist(), b[ok].tolist())]
        live = np.flatnonzero(~none & ~known)
        if not len(live):
            return known, none, best, value, done
        number = np.full(m, -1)
        number[live] = np.arange(len(live))
        hit = np.flatnonzero(number[k] >= 0)
        most = np.maximum(GAP, (count[live] * self.room).astype(np.int64))
        spans, of, p, q = *self.growing(at[hit], partner[hit], number[k[hit]], p[live], q[live], most), p[live], q[live]
        j, base, other = j[live], base[live], other[live]
        mine, theirs = spans[:, 1] - spans[:, 0] + 1, spans[:, 3] - spans[:, 2] + 1
        fits = np.minimum(mine, theirs) >= self.least
        if self.same[j].any():
            move = (self.ahead[j] - base + other)[of]
            apart = (spans[:, 1] + move + SHINGLE <= spans[:, 2]) | (spans[:, 3] + SHINGLE <= spans[:, 0] + move)
            fits &= ~self.same[j][of] | apart
        # shingles that the other side has nowhere bound the similarity of a span: what is larger than all that can do need not be counted
        ours, others = (c[spans[:, i + 1] + 1] - c[spans[:, i]] for c, i in zip(self.alone, (0, 2)))
        common = np.minimum(mine - ours, theirs - others)
        able = np.flatnonzero(fits & (common >= (self.similarity - 1e-9) * (common + ours + others)))
        if not len(able):
            return known, none, best, value, done
        top = np.full(len(live), -1)
        top[of[able]] = able
        final = np.append(np.flatnonzero(of[1:] != of[:-1]), len(of) - 1)
        kept = np.arange(len(of)) <= top[of]
        ids = np.flatnonzero(kept)
        jobs = np.flatnonzero(top >= 0)
        number = np.full(len(live), -1)
        number[jobs] = np.arange(len(jobs))
        alike = self.alikes(spans[ids], number[of[ids]], p[jobs], q[jobs])
        good = np.flatnonzero(fits[ids] & (alike >= self.similarity))
        last = np.full(len(live), -1)
        last[of[ids[good]]] = good
        some = np.flatnonzero(last >= 0)
        best[live[some]], value[live[some]] = spans[ids[last[some]]], alike[last[some]]
        done[live[some]] = ids[last[some]] == final[some]
        return known, none, best, value, done

    def growing(
        self, matched: np.ndarray, partner: np.ndarray, of: np.ndarray, p: np.ndarray, q: np.ndarray, most: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """(first, last, first there, last there) of the run of matched places around each place and of it with ever more runs over gaps of up to ``most``, and whose each is.

        The nearer of the next runs on both sides comes first: runs are merged by the largest gap on the way to them.
        """
        m = len(p)
        breaks = np.flatnonzero((matched[1:] - matched[:-1] > 1) | (of[1:] != of[:-1]))
        opens, closes = np.concatenate([[0], breaks + 1]), np.append(breaks, len(matched) - 1)
        first, last, there, there_last = matched[opens], matched[closes], partner[opens], partner[closes]
        gaps = first[1:] - last[:-1] - 1
        run = np.searchsorted(first, p, "right") - 1
        edge = np.searchsorted(of[opens], np.arange(m + 1))
        keys, jobs, lefts = [], [], 0
        for size in (run - edge[:-1], edge[1:] - 1 - run):
            j = np.repeat(np.arange(m), size)
            i = np.arange(len(j)) - np.repeat(np.cumsum(size) - size, size)
            widest = _highest(gaps[run[j] - 1 - i] if not keys else gaps[run[j] + i], j)
            go = widest <= most[j]
            keys.append(widest[go])
            jobs.append(j[go])
            lefts = lefts or (len(keys) == 1 and int(go.sum()))
        key, job = np.concatenate(keys), np.concatenate(jobs)
        order = np.argsort(key + job * (int(most.max()) + 1), kind="stable")
        job = job[order]
        head = np.searchsorted(job, np.arange(m)) + np.arange(m)  # a span without more runs comes first
        back = np.zeros(len(job) + m, np.int64)
        back[np.arange(len(job)) + job + 1] = order < lefts
        of = np.repeat(np.arange(m), np.diff(np.append(head, len(back))))
        back = np.cumsum(back)
        back -= back[head][of]
        a, b = run[of] - back, run[of] + np.arange(len(of)) - head[of] - back
        low = -_highest(-np.minimum(there[a], q[of]), of)
        return np.column_stack([first[a], last[b], low, _highest(np.maximum(there_last[b], q[of]), of)]), of

    def alikes(self, spans: np.ndarray, of: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Similarity of the sets of shingles of growing spans around two places of each job."""
        head = np.searchsorted(of, np.arange(len(p)))
        top = np.append(head[1:], len(of)) - 1
        never = len(of)
        entered = []
        for codes, place, i in ((self.codes[0], p, 0), (self.codes[1], q, 2)):
            size = spans[top, i + 1] - spans[top, i] + 1
            at, job = _ranges(spans[top, i], size), np.repeat(np.arange(len(p)), size)
            wide = 2 * len(codes) + 2
            ahead = at > place[job]
            step = np.empty(len(at), np.int64)
            step[ahead] = np.searchsorted(spans[:, i + 1], at[ahead])
            step[~ahead] = np.searchsorted(of * wide - spans[:, i], job[~ahead] * wide - at[~ahead])
            out = np.full(self.values, never)
            np.minimum.at(out, codes[at], step)
            entered.append(out)
        s, t, common = (np.cumsum(np.bincount(e, minlength=never + 1)[:-1]) for e in (*entered, np.maximum(*entered)))
        s, t, common = (c - np.where(head > 0, c[head - 1], 0)[of] for c in (s, t, common))
        return common / (s + t - common)


_FOUND = "doc long, start_word long, n_words long, first long, first_start_word long, first_n_words long, similarity double"


def compare(pairs: DataFrame, dense: DataFrame, least: int, similarity: float) -> DataFrame:
    """Passages of the pairs (doc, other, places) from the dense parts of their texts; rows (doc, signature, places) without a passage hold the new windows that no passage covers."""
    spark = pairs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    # the text that others are compared with goes once to each block of BLOCK of them; only few have more
    many = pairs.groupBy("other").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).where("blocks > 1")
    block = F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc"), "blocks"))
    dealt = pairs.join(F.broadcast(many), "other", "left").select("other", block.alias("block"), "doc", "places")
    asked = dealt.withColumn("member", F.col("doc")).unionByName(
        dealt.select("other", "block").distinct().withColumn("member", F.col("other")), allowMissingColumns=True
    )
    texts = dense.select(F.col("doc").alias("member"), "place", "size", "held")
    both = asked.join(texts, "member").select("other", "block", "doc", "places", "place", "size", "held").repartition(
        tasks, "other", "block").sortWithinPartitions("other", "block", F.col("doc").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[Parts, Parts, np.ndarray, bool]] = []
        names: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
        held, theirs = 0, None
        for batch in batches:
            doc, at = batch.column(2).to_pylist(), _Lists(batch.column(3))
            place, size = (batch.column(i).flatten().to_numpy() for i in (4, 5))
            edge = np.concatenate([[0], np.cumsum(batch.column(4).value_lengths().to_numpy())])
            for i, (other, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(6))):
                parts = np.frombuffer(text.as_buffer(), np.uint64), place[edge[i] : edge[i + 1]], size[edge[i] : edge[i + 1]]
                if doc[i] is None:  # the first row of its block
                    theirs = parts
                    continue
                signature, there, new, places, lengths = at.of(i)
                here, low, high = unpacked(places, least)
                pairs.append((parts, theirs, np.column_stack([here, np.repeat(there, lengths), low, high]), doc[i] == other))
                names.append((doc[i], other, np.where(new, signature, 0), places, lengths))
                held += len(parts[0]) + len(theirs[0])
                if held >= SIDE_BY_SIDE:
                    yield _compared(pairs, names, least, similarity)
                    pairs, names, held = [], [], 0
        if pairs:
            yield _compared(pairs, names, least, similarity)

    return both.mapInArrow(run, f"{_FOUND}, signature long, places array<long>")


class _Lists:
    """The lists of structs (signature, places, there, new) of a column."""

    def __init__(self, column: pa.ListArray) -> None:
        every = column.flatten()
        places = every.field("places")
        self.signature, self.there, self.new = (every.field(n).to_numpy(zero_copy_only=False) for n in ("signature", "there", "new"))
        self.places, self.lengths = places.flatten().to_numpy(), places.value_lengths().to_numpy().astype(np.int64)
        self.edge = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())])
        self.start = np.concatenate([[0], np.cumsum(self.lengths)])

    def of(self, i: int) -> tuple[np.ndarray, ...]:
        """(signature, there, new, all places, how many of each) of a row."""
        a, b = self.edge[i], self.edge[i + 1]
        return self.signature[a:b], self.there[a:b], self.new[a:b].astype(bool), self.places[self.start[a] : self.start[b]], self.lengths[a:b]


def _listed(values: np.ndarray, keep: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """Which lists of these lengths keep a value, and what they keep."""
    left = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[keep], minlength=len(lengths))
    some = np.flatnonzero(left)
    return some, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left[some])]).astype(np.int32)), pa.array(values[keep]))


def _compared(pairs: list, names: list, least: int, similarity: float) -> pa.RecordBatch:
    """Rows of ``compare``; a signature of 0 stands for windows that are not new."""
    rows, still = [], []
    for (doc, other, signature, places, lengths), (_, _, at, _), (found, settled) in zip(names, pairs, passages_around(pairs, least, similarity)):
        rows += [(doc, i, j - i + SHINGLE, other, k, m - k + SHINGLE, alike) for i, j, k, m, alike in found]
        here, there = at[:, 0], at[:, 1]
        for i, j, k, m, _ in found:
            settled = settled | (i <= here) & (here <= j) & (k <= there) & (there <= m)
        still.append(np.repeat(signature != 0, lengths) & ~settled)
    signature, lengths, places = (np.concatenate([n[i] for n in names]) for i in (2, 4, 3))
    some, lists = _listed(places, np.concatenate(still), lengths)
    docs = np.repeat([n[0] for n in names], [len(n[2]) for n in names])[some]
    types = [pa.int64()] * 6 + [pa.float64()]
    columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, types)]
    open_ = [pa.array(docs, pa.int64()), *[pa.nulls(len(some), t) for t in types[1:]], pa.array(signature[some], pa.int64()), lists]
    columns += [pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), lists.type)]
    fields = ["doc", "start_word", "n_words", "first", "first_start_word", "first_n_words", "similarity", "signature", "places"]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([a, b.cast(a.type)]) for a, b in zip(columns, open_)], fields)


def not_held(windows: DataFrame, rows: DataFrame, passage: int) -> DataFrame:
    """The windows (signature, doc, places) around which the passages (doc, start_word, n_words) leave a part of ``passage`` words out."""
    least = passage - SHINGLE + 1
    open_ = windows.groupBy("doc").agg(F.collect_list(F.struct("signature", "places")).alias("w"))
    spans = rows.groupBy("doc").agg(F.collect_list(F.struct("start_word", (F.col("start_word") + F.col("n_words") - passage).alias("end"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, spans = batch.column(1).flatten(), batch.column(2).flatten()
            count = batch.column(1).value_lengths().to_numpy()
            lengths = every.field("places").value_lengths().to_numpy().astype(np.int64)
            places = every.field("places").flatten().to_numpy()
            signature, doc = every.field("signature").to_numpy(), np.repeat(batch.column(0).to_numpy(), count)
            _, low, high = unpacked(places, least)
            known = np.zeros(len(places), bool)
            if len(spans):
                of = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().fill_null(0).to_numpy())
                start, end = spans.field("start_word").to_numpy(), spans.field("end").to_numpy()
                order = np.lexsort((start, of))
                of, start, end = of[order], start[order], _highest(end[order], of[order])
                begin = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (start[1:] > end[:-1] + 1)]))  # of rows that meet
                row = np.repeat(np.repeat(np.arange(batch.num_rows), count), lengths)
                wide = int(max(start.max(), high.max(initial=0), low.max(initial=0))) + least + passage + 1
                i = np.searchsorted(of[begin] * wide + start[begin], row * wide + low, "right") - 1
                known = (i >= 0) & (of[begin][i] == row) & (high <= end[np.append(begin[1:], len(end)) - 1][i])
            some, lists = _listed(places, ~known, lengths)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(signature[some]), pa.array(doc[some]), lists], ["signature", "doc", "places"])

    return open_.join(spans, "doc", "left").select("doc", "w", "spans").mapInArrow(run, "signature long, doc long, places array<long>")


def near_passages(
    docs: DataFrame, key: str = "doc_id", text: str = "text", functions: int = FUNCTIONS, passage: int = PASSAGE, similarity: float = SIMILARITY
) -> DataFrame:
    """(key, start_word, n_words, first_<key>, first_start_word, first_n_words, similarity): passages that occur in an earlier document.

    1. Texts with the same words are folded to the smallest key; a copy is one passage of that document. Both sides of a
       passage have ``similarity`` of their shingles in common, so these occur at two places or more: hashes of all shingles are dealt out to be counted, and
       only parts of a text where that share of places has shared shingles (see ``dense_runs``) go on. No passage is lost by this, but phrases
       that are frequent in otherwise different texts mostly are.
    2. For each of several hash functions, compact windows hold every part of ``passage`` words or more; two parts share their
       min-hash exactly if their windows have one signature. Verbatim passages meet in every function, similar ones in each with
       the chance of their similarity. A text has one row a signature.
    3. Windows of equal signature are aggregated to the one of the smallest key, and every other window is linked to it. All
       links of two documents are brought together, and two documents are compared once two signatures or more agree, in
       this turn and those before: always for a verbatim passage, which all functions see, and for one of similarity 0.8 but for a
       chance of 8e-5.
    4. The dense parts of both texts verify, many pairs side by side: the passage around a common shingle must have ``passage`` words or more on both sides and a
       similarity of sets of five-word shingles of ``similarity`` or more.
    5. Windows whose link no passage confirms, and around which the passages found so far do not hold every part of ``passage`` words, go on to the next smallest window of their signature, and what is left
       then is compared in pairs where a signature has up to CROWD windows. A larger group has a frequent phrase at its
       centre: its shingle comes after all others from then on, so that windows around it get signatures of
       the other words, and all steps are repeated for them, until no signature has two unconfirmed windows left.

    So every repeated passage is a row, which names a document that represents it; repeats inside one document count. Null
    texts and texts under ``passage`` words have none. Rows that repeat a key count as one document (the one of the largest text);
    rows with a null key are left out. No rows: no rows.
    """
    plain = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    if not plain.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        plain = stored(plain.groupBy("doc").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text")))
    least = passage - SHINGLE + 1
    copies = folded(plain)
    whole = plain.join(sent(copies.select("doc"), COPIES), "doc", "left_anti")
    dense = stored(dense_parts(stored(chunked(whole)), passage, similarity))
    where = F.struct("doc", "place")
    found: list[DataFrame] = []
    before: list[DataFrame] = []
    turns = count()

    def grouped(windows: DataFrame) -> DataFrame:
        groups = windows.select("signature", "doc", F.size("places").alias("n"), F.array_min("places").alias("place")).groupBy("signature").agg(
            F.sum("n").alias("n"), F.min("doc").alias("low"), F.min_by("place", "doc").alias("place")
        ).where("n > 1")
        return windows.join(groups.select("signature", "n", F.struct(F.col("low").alias("doc"), "place").alias("first")), "signature")

    def after_first(met: DataFrame) -> DataFrame:
        own = F.when(F.col("doc") == F.col("first.doc"), F.array_remove("places", F.col("first.place"))).otherwise(F.col("places"))
        return met.withColumn("places", own).where(F.size("places") > 0)

    def merged(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for more in tables[1:]:
            out = out.unionByName(more)
        return out

    def noted(pairs: DataFrame) -> DataFrame:
        """What later turns need of the pairs of a turn: its own places, and only of those that wait for a second signature."""
        compared = pairs.where("NOT alone").select("doc", "other", F.lit(None).cast(pairs.schema["places"].dataType).alias("places"), "least", "most")
        own = F.transform(F.filter("places", lambda p: p["new"]), lambda p: p.withField("new", F.lit(False)))
        return compared.unionByName(pairs.where("alone").withColumn("places", own).drop("alone"))

    def paired(met: DataFrame) -> DataFrame:
        """The links (signature, doc, places, first) by pairs of documents."""
        at = F.struct("signature", "places", F.shiftright("first.place", 32).alias("there"), F.lit(True).alias("new"))
        return met.select("doc", F.col("first.doc").alias("other"), "signature", at.alias("at")).groupBy("doc", "other").agg(
            F.collect_list("at").alias("places"), F.min("signature").alias("least"), F.max("signature").alias("most")
        )

    def turn(pairs: DataFrame) -> DataFrame:
        """Compare the links (doc, other, places, least, most) as far as two signatures agree; windows that are not confirmed."""
        if before:
            pairs = stored(pairs)
            touched = sent(stored(pairs.select("doc", "other")))
            for earlier in before:
                # a pair compared before brings that two signatures agree, one that waits also brings its places
                pairs = pairs.unionByName(earlier.join(touched, ["doc", "other"], "left_semi"))
            pairs = pairs.groupBy("doc", "other").agg(
                F.flatten(F.collect_list("places")).alias("places"), F.min("least").alias("least"), F.max("most").alias("most")
            )
        pairs = stored(pairs.withColumn("alone", F.expr("least = most")), "alone")
        before.append(noted(pairs))
        if len(before) > FEW:
            before[1:] = [stored(merged(before[1:]))]
        checked = stored(compare(pairs.where("NOT alone").select("doc", "other", "places"), dense, least, similarity))
        found.append(checked.where("start_word IS NOT NULL").drop("signature", "places").withColumn("turn", F.lit(next(turns))))
        if len(found) > FEW:
            found[1:] = [stored(merged(found[1:]))]
        alone = pairs.where("alone").select("doc", F.explode(F.filter("places", lambda p: p["new"])).alias("w"))
        left = alone.select("w.signature", "doc", "w.places").unionByName(checked.where("start_word IS NULL").select("signature", "doc", "places"))
        return not_held(left, merged(found), passage)

    parts = int(plain.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs, crowded = linked(all_windows(dense, functions, passage, parts), parts), np.zeros(0, np.int64)
    while True:
        windows = stored(turn(paired(after_first(grouped(stored(turn(pairs)))))))
        # a text without others whose places are too near each other has nothing left to compare
        last = F.shiftright(F.max(F.array_max("places")), 32) - F.shiftright(F.min(F.array_min("places")), 32)
        open_ = windows.groupBy("signature").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), last.alias("last")).where(
            (F.col("low") != F.col("high")) | (F.col("last") >= passage)
        )
        rest = stored(grouped(windows.join(open_.select("signature"), "signature", "left_semi")))
        few = rest.where((F.col("n") <= CROWD) | (F.col("signature") < 0))
        flat = few.select("signature", "doc", F.explode("places").alias("place"))
        later = flat.join(flat.select("signature", where.alias("first")), "signature").where(where > F.col("first"))
        near = F.shiftright("place", 32) - F.shiftright("first.place", 32) < passage  # in one text these are no repeat
        later = later.where((F.col("doc") != F.col("first.doc")) | ~near)
        later = stored(later.groupBy("signature", "doc", "first").agg(F.collect_list("place").alias("places")))
        if not later.isEmpty():
            turn(paired(later))
        many = rest.where((F.col("n") > CROWD) & (F.col("signature") >= 0))
        new = [r[0] for r in many.select("signature").distinct().collect()]
        if not new:
            break
        crowded = np.append(crowded, np.array(new, np.int64))
        again = dense.join(sent(stored(many.select("doc").distinct())), "doc", "left_semi")
        pairs = linked(all_windows(again, functions, passage, parts, crowded), parts)
    first, *others = found
    out = first.drop("turn").unionByName(copies.where(F.col("n_words") >= passage).select(
        "doc", F.lit(0).cast("long").alias("start_word"), "n_words", F.col("leader").alias("first"), F.lit(0).cast("long").alias("first_start_word"),
        F.col("n_words").alias("first_n_words"), F.lit(1.0).alias("similarity"),
    ))
    if others:
        # what a later turn finds is left out where a row of the document covers it and names an earlier one
        added = stored(merged(others).dropDuplicates(["doc", "start_word", "n_words", "first"]))
        of = first.unionByName(added).select(*[F.col(c).alias(f"of_{c}") for c in first.columns]).join(
            sent(stored(added.select(F.col("doc").alias("of_doc")).distinct())), "of_doc", "left_semi"
        )
        end, of_end = F.col("start_word") + F.col("n_words"), F.col("of_start_word") + F.col("of_n_words")
        larger = (F.col("of_turn") < F.col("turn")) | (F.col("of_n_words") > F.col("n_words"))
        covered = (F.col("doc") == F.col("of_doc")) & (F.col("of_start_word") <= F.col("start_word")) & (of_end >= end) & (
            (F.col("of_first") < F.col("first")) | ((F.col("of_first") == F.col("first")) & larger)
        )
        out = out.unionByName(added.join(of, covered, "left_anti").drop("turn"))
    return out.withColumnsRenamed({"doc": key, "first": f"first_{key}"})
