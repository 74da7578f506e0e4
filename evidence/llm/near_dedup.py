"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from evidence.llm.components import components, sent
from evidence.llm.shingles import Shingles, in_batches, mix, shingles, words
from evidence.operators.scale import stored

#: Bands of the signature and registers of a band: at a similarity of 0.8 a pair is missed with a chance of 3e-5.
BANDS, ROWS = 20, 4
#: Documents are near-duplicates from this similarity of their sets of five-word shingles on.
SIMILARITY = 0.8
#: Texts with one difference from their centre in common that are compared in pairs; more are compared with centres first.
CROWD = 64

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def weighted(found: Shingles) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, weight) of the distinct shingles of each text; n occurrences weigh 1 + ln n."""
    text = np.repeat(np.arange(len(found.first) - 1), np.diff(found.first))
    order = np.lexsort((found.hash, text))
    t, h = text[order], found.hash[order]
    new = np.concatenate([[True], (t[1:] != t[:-1]) | (h[1:] != h[:-1])]) if len(t) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(t)))
    return t[at], h[at], 1 + np.log(counts)


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, size: int) -> np.ndarray:
    """ProbMinHash: registers (texts x size) whose share of agreement estimates the probability Jaccard similarity.

    Every shingle is a Poisson process with its weight as the rate; each arrival falls into a random register,
    which keeps the shingle that came first. Arrivals are drawn in rounds, one per shingle; a shingle
    is done once its next arrival is later than the latest of all registers of its text, as nothing can change any more.
    Times and registers are hashes of the shingle, so equal shingles arrive alike everywhere. A text
    without shingles has zeros.
    """
    first = np.full(texts * size, np.inf)
    winner = np.zeros(texts * size, np.uint64)
    state, time = shingle.copy(), np.zeros(len(shingle))
    active = np.arange(len(shingle))
    while len(active):
        state = mix(state + _GOLD)
        uniform = ((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time = time - np.log(uniform) / weight[active]
        register = text[active] * size + (mix(state ^ _GOLD) % np.uint64(size)).astype(np.int64)
        sooner = np.flatnonzero(time < first[register])
        np.minimum.at(first, register[sooner], time[sooner])
        won = sooner[time[sooner] == first[register[sooner]]]
        winner[register[won]] = shingle[active[won]]
        latest = first.reshape(texts, size).max(axis=1)
        going = time < latest[text[active]]
        state, time, active = state[going], time[going], active[going]
    return winner.reshape(texts, size)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for every band, the number of the band included."""
    parts = signature.reshape(len(signature), bands, rows)
    keys = np.zeros(parts.shape[:2], np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _GOLD
    for i in range(rows):
        keys = mix(keys ^ parts[:, :, i])
    return keys.view(np.int64)


def sign(docs: DataFrame, key: str, text: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, same, bands, packed): hash of the words, band keys and compressed words of every text with words."""
    size = bands * rows

    def then(batch: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=1).compress
        plain = [b" ".join((t or b"").translate(_SPACES).split(b" ")) for t in texts]
        some = words(plain)
        found = shingles(some)
        keys = band_keys(signatures(*weighted(found), len(plain), size), bands, rows)
        keep = np.flatnonzero(np.diff(some.first))
        joined = [b" ".join(filter(None, plain[i].split(b" "))) for i in keep]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(keep)), pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in joined], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * bands), pa.array(keys[keep].ravel())),
                pa.array([pack(t) for t in joined], pa.binary()),
            ],
            ["id", "same", "bands", "packed"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(batches, "text", then)

    wide = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return wide.mapInArrow(run, "id long, same binary, bands array<long>, packed binary")


def _beside(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """(a, b, left, right): pairs with the whole texts of both."""
    # only texts that are compared are joined; ids and pairs go to the texts while their counted rows are few
    needed = sent(stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    texts = stored(packed.join(needed, "id", "left_semi"))
    pairs = sent(pairs)
    left = texts.select(F.col("id").alias("a"), F.col("packed").alias("left"))
    right = texts.select(F.col("id").alias("b"), F.col("packed").alias("right"))
    return left.join(pairs, "a").join(right, "b").select("a", "b", "left", "right")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]]]:
    """Rows of (a, b, left, right) in parts of 200, with the distinct shingles of both texts of every row."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for start in range(0, batch.num_rows, 200):
            part = batch.slice(start, 200)
            ids = {}
            for id_column, column in (("a", "left"), ("b", "right")):
                for i, x in zip(part.column(id_column).to_pylist(), part.column(column)):
                    if i not in ids:
                        ids[i] = unpack(x.as_py())
            t, h, _ = weighted(shingles(words(list(ids.values()))))
            found = dict(zip(ids, np.split(h, np.searchsorted(t, np.arange(1, len(ids))))))
            yield part, [(found[a], found[b]) for a, b in zip(part.column("a").to_pylist(), part.column("b").to_pylist())]


def verify(pairs: DataFrame, packed: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b) of the pairs whose sets of shingles are similar enough, from the whole texts of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, both in _sets(batches):
            keep = []
            for x, y in both:
                common = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                keep.append(common >= similarity * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([part.column("a").filter(pa.array(keep)), part.column("b").filter(pa.array(keep))], ["a", "b"])

    return _beside(pairs, packed).mapInArrow(run, "a long, b long")


def differences(near: DataFrame, packed: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id, centre, added, missing, size, linked) for pairs (id, centre).

    The shingles that a text has beside its centre and those of the centre that it lacks, how many the centre has, and whether the
    two are similar.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, both in _sets(batches):
            added = [np.setdiff1d(x, o, assume_unique=True).view(np.int64) for x, o in both]
            missing = [np.setdiff1d(o, x, assume_unique=True).view(np.int64) for x, o in both]
            size = [len(o) for _, o in both]
            linked = [n - len(m) >= similarity * (n + len(a)) for a, m, n in zip(added, missing, size)]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("a"), part.column("b"), pa.array(added, longs), pa.array(missing, longs), pa.array(size, pa.int64()), pa.array(linked, pa.bool_())],
                ["id", "centre", "added", "missing", "size", "linked"],
            )

    pairs = near.select(F.col("id").alias("a"), F.col("centre").alias("b"))
    return _beside(pairs, packed).mapInArrow(run, "id long, centre long, added array<long>, missing array<long>, size long, linked boolean")


def regroup(parts: DataFrame, labels: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(bucket, mixed, id, label, linked, added, a, m, size, lone, n): texts of one centre that share a shingle by which they differ from it.

    Let D be the symmetric difference of a text and the centre, A its added shingles, M the missing ones. If x and y are similar and y
    is not similar to the centre, D(x) and D(y) have more than (|D(x)| - (1 - similarity) |A(x)|) / 2 shingles in
    common: their symmetric difference is that of D(x) and D(y), at most (1 - similarity) |x u y|, and |D(y)| is more than
    (1 - similarity) |y u centre|. So, in one order of all shingles, the first common one is among the
    first |D(x)| less that number (the head). Two texts unlike the centre meet by their heads; one like the centre meets, by its head,
    all of the difference of the other. Added shingles come before missing ones and rare before frequent.
    If y is unlike the centre and x has no added shingle in common with y, similarity asks for |A(x)| < |M(x)|, the missing ones.
    A text of n shingles shares one of its first (1 - similarity) n + 1 with every similar text, whatever the order. Where it adds so many to the
    centre, its head is these only, against the heads of other such texts and all added shingles of the rest.
    An added shingle that no other text of the centre has is in common with none (``lone`` of them): a text with more than
    (1 - similarity) of its shingles of this kind is like no other of the centre and left out.
    A bucket is one such shingle of one centre, n its texts, or the fewer of those like and unlike the centre. Only buckets with two classes that
    may meet are given.
    """
    a, m = F.size("added"), F.size("missing")
    common = F.floor((a + m - (1 - similarity) * a) / 2 - 1e-9)
    first = F.floor((1 - similarity) * (F.col("size") + a - m) + 1e-9) + 1
    head = F.when(a >= first, first).otherwise(F.greatest(a + m - common, a)).alias("head")
    kinds = F.array(
        F.struct(F.lit(True).alias("plus"), F.col("added").alias("tokens")), F.struct(F.lit(False).alias("plus"), F.col("missing").alias("tokens"))
    )
    flat = parts.select("id", "centre", "size", "linked", a.alias("a"), m.alias("m"), head, (a >= first).alias("own"), F.explode(kinds).alias("k"))
    flat = stored(flat.select("id", "centre", "size", "linked", "a", "m", "head", "own", "k.plus", F.explode("k.tokens").alias("token")))
    often = flat.groupBy("centre", "token").agg(F.count(F.lit(1)).alias("often"))
    order = Window.partitionBy("centre", "id").orderBy(F.desc("plus"), "often", "token")
    lone = F.count_if(F.col("plus") & (F.col("often") == 1)).over(Window.partitionBy("centre", "id"))
    placed = flat.join(often, ["centre", "token"]).withColumn("early", F.row_number().over(order) <= F.col("head")).withColumn("lone", lone)
    placed = placed.where((F.col("often") > 1) & (F.col("lone") <= (1 - similarity) * (F.col("size") + F.col("a") - F.col("m")) + 1e-6))
    # a text that meets one unlike the centre at missing shingles only lacks more than it adds: copies with changed words do not meet there
    early = F.col("early") & (F.col("plus") | (F.col("a") < F.col("m")))
    both, mixed, none = F.array(F.lit(True), F.lit(False)), F.array(F.lit(True)), F.array().cast("array<boolean>")
    # mixed buckets hold the heads of texts like the centre and those of the others, or all their differences where they add little, the rest heads of texts unlike the centre
    dealt = placed.withColumn("mixed", F.explode(F.when(F.col("linked"), F.when(early, mixed).otherwise(none)).otherwise(F.when(early, both).when(F.col("own"), none).otherwise(mixed))))
    dealt = stored(dealt.join(labels, "id").select(
        F.xxhash64("centre", "token", "mixed").alias("bucket"), "mixed", "id", "label", "linked", F.col("plus").alias("added"), "a", "m", "size", "lone"
    ))
    counted = dealt.groupBy("bucket", "mixed").agg(
        F.count(F.lit(1)).alias("all"), F.count_if("linked").alias("close"), F.min("label").alias("low"), F.max("label").alias("high")
    ).where("low <> high and (not mixed or close between 1 and all - 1)")
    n = F.when(F.col("mixed"), F.least("close", F.col("all") - F.col("close"))).otherwise(F.col("all")).alias("n")
    return dealt.join(counted.select("bucket", n), "bucket")


def within(groups: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): pairs of texts of one bucket and unlike classes that can be similar by their counts of shingles.

    Two texts that share no added shingle, as those that first meet at a missing one, have
    similarity * (A(x) + A(y)) + max(M) - similarity * min(M) <= (1 - similarity) * |centre|. What is in common is no more than either
    has without its lone shingles.
    """
    x = groups.select("bucket", "mixed", "added", "size", F.col("id").alias("a"), F.col("label").alias("left"), F.col("linked").alias("l"), F.col("a").alias("ax"), F.col("m").alias("mx"), F.col("lone").alias("lx"))
    y = groups.select("bucket", F.col("id").alias("b"), F.col("label").alias("right"), F.col("linked").alias("r"), F.col("a").alias("ay"), F.col("m").alias("my"), F.col("lone").alias("ly"))
    n, k = F.col("size") + F.col("ax") - F.col("mx"), F.col("size") + F.col("ay") - F.col("my")
    high, low = F.greatest("mx", "my"), F.least("mx", "my")
    alone = similarity * (F.col("ax") + F.col("ay")) + high - similarity * low <= (1 - similarity) * F.col("size") + 1e-6
    shared = F.least(n - F.col("lx"), k - F.col("ly"))
    may = (F.greatest(n, k) * similarity <= F.least(n, k) + 1e-6) & (F.col("added") | alone) & (shared * (1 + similarity) + 1e-6 >= similarity * (n + k))
    sides = F.when(F.col("mixed"), F.col("l") & ~F.col("r")).otherwise(F.col("a") < F.col("b"))
    met = x.join(y, (x["bucket"] == y["bucket"]) & (F.col("left") != F.col("right")) & sides & may)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """(key, class_id): every document with the smallest id of its class of near-duplicates.

    1. Each text gets a ProbMinHash signature over its weighted five-word shingles. Documents with the same words are folded to
       the smallest id, so copies cost one row.
    2. Bands of equal registers make buckets. All members of a bucket are compared with its centre by whole texts
       (share of common shingles), and links make classes. Most buckets are then of one class and done. The centre is the member that meets
       the most texts in all of its buckets (the smallest id of these): among copies with changed words that is the one least
       changed, which most are like.
    3. Members of the others are compared with each other only if they differ from the centre by a common shingle,
       which two similar texts must (see ``regroup``). What many texts have in common with the centre thus makes no pairs.
       Up to ``CROWD`` texts with one such shingle are compared in pairs, more are a bucket of the next
       turn, with two, four ... centres, so turns are few. Every two similar members of a bucket are compared, or in one class.
    4. Buckets are aggregated before they are joined, and a bucket with a third of all rows is joined by adaptive skew
       splitting. Links and classes stay distributed.

    A text of one to four words has one shingle; null texts and texts without words are classes of their own. Rows that repeat an id
    are one document. Rows with a null id are left out. No rows: no rows.
    """
    signed = stored(sign(docs, key, text, bands, rows))
    copies = stored(signed.groupBy("same").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n")))
    leaders = copies.select(F.col("leader").alias("id"))
    bucketed = signed.join(leaders, "id", "left_semi").select("id", F.explode("bands").alias("bucket")).distinct()
    shared = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = stored(bucketed.join(shared, "bucket").select("bucket", "id", F.col("id").alias("label")))
    packed = signed.select("id", "packed")
    links = tested = labels = None

    def compare(pairs: DataFrame) -> None:
        nonlocal links, tested, labels
        if tested is not None:
            pairs = pairs.join(sent(tested), ["a", "b"], "left_anti")
        pairs = stored(pairs)
        if pairs.isEmpty():
            return
        tested = pairs if tested is None else stored(tested.unionByName(pairs))
        found = stored(verify(pairs, packed, similarity).distinct())
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            labels = components(links)

    def relabelled(rows: DataFrame) -> DataFrame:
        if labels is None:
            return rows
        known = sent(labels.select("id", F.col("label").alias("now")))
        return rows.join(known, "id", "left").select(*[F.coalesce("now", "label").alias("label") if c == "label" else F.col(c) for c in rows.columns])

    turn = 0
    while not members.isEmpty():
        slot = F.pmod(F.xxhash64("id"), F.lit(2**turn)).alias("slot")
        sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
        meets = members.join(sizes, "bucket").groupBy("id").agg(F.sum("n").alias("meets"))
        central = F.min(F.struct((-F.col("meets")).alias("rank"), "id", "label")).alias("c")
        centres = stored(members.join(meets, "id").groupBy("bucket", slot).agg(central).select(
            "bucket", F.col("c.id").alias("centre"), F.col("c.label").alias("own"), "c.rank"
        ))
        met = members.join(centres, "bucket").where("label <> own")
        compare(met.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct())
        # centres were compared with all others of their bucket and leave it; a bucket of one class is done for good, as classes only grow
        members = stored(relabelled(members.join(centres.select("bucket", F.col("centre").alias("id")), ["bucket", "id"], "left_anti").select("bucket", "id", "label")))
        still = members.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
        members = stored(members.join(sent(stored(still)), "bucket", "left_semi"))
        if members.isEmpty():
            break
        least = centres.groupBy("bucket").agg(F.min(F.struct("rank", "centre")).alias("c")).select("bucket", "c.centre")
        near = stored(members.join(least, "bucket").select("id", "centre").distinct())
        classed = stored(members.select("id", "label").distinct())
        groups = stored(regroup(differences(near, packed, similarity), classed, similarity))
        compare(within(groups.where(F.col("n") <= CROWD), similarity))
        members = stored(relabelled(groups.where(F.col("n") > CROWD).select("bucket", "id", "label")))
        turn += 1
    named = copies.select("same", F.col("leader").alias("id"))
    if labels is not None:
        named = named.join(labels, "id", "left").select("same", F.coalesce("label", "id").alias("id"))
    found = signed.select("id", "same").join(named.withColumnRenamed("id", "class_id"), "same").groupBy("id").agg(F.min("class_id").alias("class_id"))
    ids = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id")).distinct()
    return ids.join(found, "id", "left").select(F.col("id").alias(key), F.coalesce("class_id", "id").alias("class_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs without near-duplicates: of each class the document with the smallest id stays.

    Of rows that repeat an id one stays. Rows with a null id are no part of a class and stay.
    """
    found = stored(classes(docs, key, text, **options))
    # the ids that go are few beside the texts: counted, they go to the scan instead of shuffling it
    dropped = sent(stored(found.where(F.col(key) != F.col("class_id")).select(key)))
    kept = docs.join(dropped, key, "left_anti").select(*docs.columns)
    repeated = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if repeated.isEmpty():
        return kept
    return kept.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(kept.where(F.col(key).isNull()))
