"""Quality classifier from heuristic labellers: their accuracies by expectation-maximisation, then a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evidence.llm.shingles import Words, in_batches, letters_hash, words
from evidence.operators.scale import stored

# Fixed word lists of the labellers of rude language.
INSULTS = ["idiot", "idiots", "moron", "morons", "loser", "losers", "clown", "clowns", "stupid", "fool", "fools", "dumb", "jerk"]
CONTEMPT = ["scum", "trash", "worthless", "pathetic", "disgusting", "filth", "vermin", "garbage", "useless", "hate"]

#: The scorer is trained on about this many documents, drawn by a hash of their ids.
TRAINING_ROWS = 12_000
#: Hashed features, and documents of the sample that a feature must occur in.
BUCKETS, LEAST_DOCS = 1 << 16, 5

#: A word or the start of a word joins the learned lexicon if at least this share of the labelled documents that hold it are
#: bad, and if it follows at least so many different words there (copies of one document do not count twice).
LEXICON_SHARE, LEXICON_CONTEXTS = 0.95, 8
#: Bytes of the starts of a longer word that are units of their own.
STARTS = (4, 5)

#: The mean length of fewer words says nothing; it is set to a value on which its labeller abstains.
FEW_WORDS, NO_VOTE = 30, 6.5

STATISTICS = [
    "words", "mean_word", "symbol_rate", "upper_rate", "exclaim_rate", "bar_rate", "distinct_rate", "same_again_rate", "insults",
    "contempt", "rude_kinds", "rude_rate", "listed_words", "listed_starts",
]


@dataclass(frozen=True)
class Labeller:
    """Votes bad from one value of a statistic on, good up to another, and abstains between them.

    ``kinds`` are the kinds of bad text that it was written for; they only start the estimation.
    """

    statistic: str
    bad_from: float
    good_to: float
    kinds: tuple[str, ...]
    sign: int = 1  # -1 turns the statistic around


HEADS: dict[str, list[Labeller]] = {
    "low_quality": [
        Labeller("symbol_rate", 0.25, 0.02, ("symbols", "listing")), Labeller("mean_word", 7.0, 6.0, ("symbols",)),
        Labeller("bar_rate", 0.2, 0.02, ("listing",)),
        Labeller("upper_rate", 0.4, 0.12, ("shouting",)), Labeller("exclaim_rate", 0.25, 0.05, ("shouting",)),
        Labeller("same_again_rate", 0.15, 0.03, ("repetition",)), Labeller("distinct_rate", -0.25, -0.55, ("repetition",), -1),
    ],
    "toxic": [
        Labeller("insults", 1, 0, ("rude",)), Labeller("contempt", 1, 0, ("rude",)), Labeller("rude_kinds", 2, 0, ("rude",)),
        Labeller("rude_rate", 0.002, 0.0, ("rude",)), Labeller("listed_words", 1, 0, ("rude", "listed")),
        Labeller("listed_starts", 1, 0, ("listed",)),
    ],
}


def _lower(text: bytes) -> bytes:
    return text.lower()


def _word_hashes(listed: list[str]) -> np.ndarray:
    return np.sort(words([w.encode() for w in listed]).hash)


@dataclass
class Document:
    """Statistics (documents x STATISTICS) and distinct hashed words of several texts."""

    statistics: np.ndarray
    feature: np.ndarray
    text: np.ndarray


_MARKS = {name: np.isin(np.arange(256), np.frombuffer(chars, np.uint8)) for name, chars in {
    "symbol": b"#*$%&|<>", "exclaim": b"!?", "bar": b"|", "upper": bytes(range(65, 91)), "first_bytes": bytes([*range(128), *range(192, 256)]),
}.items()}


def _per_text(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marks)])
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)


def _plain_words(texts: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words without case and end marks, then hashes of the starts of longer words and the number of the word of each."""
    plain = [_lower(t).translate(None, b".,;:!?\"()'") for t in texts]
    found = words(plain)
    data = np.frombuffer(b"\n".join(plain) + b"\n", np.uint8)
    longer = [np.flatnonzero(found.end - found.start > size) for size in STARTS]
    starts = [letters_hash(data[found.start[w][:, None] + np.arange(size)]) for size, w in zip(STARTS, longer)]
    return found, np.concatenate(starts), np.concatenate(longer)


def measure(texts: list[bytes | None], lexicon: np.ndarray) -> Document:
    """Counts over whole texts, vectorised; a null text counts as an empty one. ``lexicon`` holds sorted unit hashes."""
    plain = [t or b"" for t in texts]
    data = np.frombuffer(b"\n".join(plain) + b"\n", np.uint8)
    bounds = np.cumsum([0, *[len(t) + 1 for t in plain]])
    found, starts, start_word = _plain_words(plain)
    n = np.diff(found.first).astype(float)
    order = np.lexsort((found.hash, found.text))
    t, h = found.text[order], found.hash[order]
    new = np.concatenate([[True], (t[1:] != t[:-1]) | (h[1:] != h[:-1])]) if len(t) else np.zeros(0, bool)
    text, word = t[new], h[new]
    again = np.concatenate([[False], (found.hash[1:] == found.hash[:-1]) & (found.text[1:] == found.text[:-1])])[: len(t)]
    lists = {k: np.isin(found.hash, _word_hashes(v)) for k, v in (("insults", INSULTS), ("contempt", CONTEMPT))}
    kinds = np.isin(word, _word_hashes(INSULTS + CONTEMPT))

    def by_text(which: np.ndarray, where: np.ndarray) -> np.ndarray:
        return np.bincount(which[where], minlength=len(plain)).astype(float)

    size = np.maximum(n, 1)
    letters = _per_text(_MARKS["first_bytes"][data] & (data > 32), bounds)
    insults, contempt = by_text(found.text, lists["insults"]), by_text(found.text, lists["contempt"])
    statistics = np.stack([
        n, np.where(n < FEW_WORDS, NO_VOTE, letters / size), _per_text(_MARKS["symbol"][data], bounds) / size,
        _per_text(_MARKS["upper"][data], bounds) / np.maximum(letters, 1), _per_text(_MARKS["exclaim"][data], bounds) / size,
        _per_text(_MARKS["bar"][data], bounds) / size, by_text(text, np.ones(len(text), bool)) / size, by_text(found.text, again) / size,
        insults, contempt, by_text(text, kinds), (insults + contempt) / size, by_text(found.text, _listed(found.hash, lexicon)),
        by_text(found.text[start_word], _listed(starts, lexicon)),
    ], axis=1)
    feature = (np.concatenate([word, starts]) >> np.uint64(40)).astype(np.int64) % BUCKETS
    owner = np.concatenate([text, found.text[start_word]])
    pairs = np.unique(owner * BUCKETS + feature)
    return Document(statistics, pairs % BUCKETS, pairs // BUCKETS)


def _listed(units: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    if not len(lexicon):
        return np.zeros(len(units), bool)
    return lexicon[np.minimum(np.searchsorted(lexicon, units), len(lexicon) - 1)] == units


def votes(statistics: np.ndarray, labellers: list[Labeller]) -> np.ndarray:
    """2 for bad, 1 for good, 0 for no vote."""
    out = np.zeros((len(statistics), len(labellers)), np.int64)
    for i, one in enumerate(labellers):
        x = one.sign * statistics[:, STATISTICS.index(one.statistic)]
        out[:, i] = np.where(x >= one.bad_from, 2, np.where(x <= one.good_to, 1, 0))
    return out


def _pattern(v: np.ndarray) -> np.ndarray:
    return (v * 3 ** np.arange(v.shape[1])).sum(axis=1)


@dataclass
class Accuracies:
    """Of one head: shares of the classes (good, then the kinds of bad), and how often a labeller votes what in each."""

    shares: np.ndarray  # classes
    table: np.ndarray  # classes x labellers x 3

    def beliefs(self, v: np.ndarray) -> np.ndarray:
        """Probability of every class for rows of votes."""
        at = np.arange(v.shape[1])
        logs = np.log(self.shares) + np.log(self.table)[:, at, v].sum(axis=2).T
        odds = np.exp(logs - logs.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of bad for rows of votes."""
        return 1 - self.beliefs(v)[:, 0]


def estimate(patterns: dict[int, int], labellers: list[Labeller], rounds: int = 60) -> Accuracies:
    """Expectation-maximisation over counts of vote patterns: votes are independent given the unknown class.

    Bad texts are of several kinds, each with accuracies of its own, as a labeller for one says nothing of the others.
    Starts from labellers that find their kinds three times in five and call most else good.
    """
    kinds = list(dict.fromkeys(k for one in labellers for k in one.kinds))
    good, own = [0.25, 0.7, 0.05], [0.25, 0.15, 0.6]
    table = np.array([[own if kind in one.kinds else good for one in labellers] for kind in [None, *kinds]])
    model = Accuracies(np.array([0.9, *[0.1 / len(kinds)] * len(kinds)]), table)
    if not patterns:
        return model
    code, count = np.array(sorted(patterns)), np.array([patterns[k] for k in sorted(patterns)], float)
    v = code[:, None] // 3 ** np.arange(len(labellers)) % 3
    seen = (v[:, :, None] == np.arange(3)).astype(float)
    for _ in range(rounds):
        belief = model.beliefs(v) * count[:, None]
        sums = np.einsum("pc,plx->clx", belief, seen) + 0.5
        shares = belief.sum(axis=0) + 0.5
        model = Accuracies(shares / shares.sum(), sums / sums.sum(axis=2, keepdims=True))
    return model


@dataclass
class Scorer:
    """Linear weights of hashed words and of standardised statistics for one head."""

    hashed: np.ndarray
    dense: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    bias: float

    def score(self, found: Document) -> np.ndarray:
        linear = np.bincount(found.text, self.hashed[found.feature], minlength=len(found.statistics))
        linear = linear + ((_squashed(found.statistics) - self.mean) / self.scale) @ self.dense + self.bias
        return 1 / (1 + np.exp(-np.clip(linear, -30, 30)))


def _squashed(statistics: np.ndarray) -> np.ndarray:
    return np.log1p(np.minimum(statistics, 1e6) * np.where(np.isin(STATISTICS, ["words", "mean_word"]), 1, 100))


def fit_scorer(
    features: list[np.ndarray], statistics: np.ndarray, target: np.ndarray, epochs: int = 10, rate: float = 0.1, decay: float = 1e-4,
    batch: int = 256,
) -> Scorer:
    """Logistic regression on soft labels, in batches with per-weight step sizes. No rows: every score is one half."""
    dense = _squashed(statistics)
    mean, scale = (dense.mean(axis=0), dense.std(axis=0) + 1e-6) if len(dense) else (np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    dense = (dense - mean) / scale
    often = np.bincount(np.concatenate([np.unique(f) for f in features] or [np.zeros(0, np.int64)]), minlength=BUCKETS) >= LEAST_DOCS
    features = [f[often[f]] for f in features]
    hashed, weights, bias = np.zeros(BUCKETS), np.zeros(len(STATISTICS)), 0.0
    sum_h, sum_w, sum_b = np.full(BUCKETS, 1e-6), np.full(len(STATISTICS), 1e-6), 1e-6
    random = np.random.default_rng(0)
    for _ in range(epochs if len(target) else 0):
        for part in np.array_split(random.permutation(len(target)), max(1, len(target) // batch)):
            which = np.repeat(np.arange(len(part)), [len(features[i]) for i in part])
            at = np.concatenate([features[i] for i in part])
            linear = np.bincount(which, hashed[at], minlength=len(part)) + dense[part] @ weights + bias
            error = (1 / (1 + np.exp(-np.clip(linear, -30, 30))) - target[part]) / len(part)
            gh = np.bincount(at, error[which], minlength=BUCKETS) + decay * hashed
            gw, gb = error @ dense[part] + decay * weights, error.sum()
            sum_h, sum_w, sum_b = sum_h + gh**2, sum_w + gw**2, sum_b + gb**2
            hashed -= rate * gh / np.sqrt(sum_h)
            weights -= rate * gw / np.sqrt(sum_w)
            bias -= rate * gb / np.sqrt(sum_b)
    return Scorer(hashed, weights, mean, scale, float(bias))


@dataclass
class Model:
    lexicon: np.ndarray
    accuracies: dict[str, Accuracies]
    scorers: dict[str, Scorer]


def _texts(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    return docs.select(*more, F.col(text).cast("string").alias("text"))


def learn_lexicon(docs: DataFrame, labels: DataFrame | None, key: str, text: str, label: str, training_rows: int) -> np.ndarray:
    """Sorted hashes of words and starts of words that mark bad documents (label 1).

    Counted over about ``training_rows`` labelled documents, drawn by a hash of their ids and joined to their texts by a
    broadcast of that bounded number of ids. Null ids and labels are left out; the highest label of an id counts.
    """
    if labels is None:
        return np.zeros(0, np.uint64)
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    share = min(1.0, training_rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64(key, F.lit("lexicon")), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = drawn.groupBy(F.col(key).alias("_key")).agg(F.when(F.max(label) == 1, 1).otherwise(0).alias("bad"))
    rows = stored(_texts(docs, text, F.col(key).alias("_key")).join(F.broadcast(sample), "_key").select("text", "bad"))

    def units(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, text, hash of the word before) of every word and start."""
        found, starts, word = _plain_words([t or b"" for t in texts])
        before = np.concatenate([[np.uint64(0)], found.hash])[: len(found.hash)]
        return np.concatenate([found.hash, starts]), np.concatenate([found.text, found.text[word]]), np.concatenate([before, before[word]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def then(batch: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
            unit, owner, _ = units(texts)
            bad = np.array(batch.column(1).to_pylist(), np.int64)
            order = np.lexsort((unit, owner))
            unit, owner = unit[order], owner[order]
            new = np.concatenate([[True], (unit[1:] != unit[:-1]) | (owner[1:] != owner[:-1])])[: len(unit)]
            unit, is_bad = unit[new], bad[owner[new]]
            names, place = np.unique(unit, return_inverse=True)
            return pa.RecordBatch.from_arrays([
                pa.array(names.view(np.int64)), pa.array(np.bincount(place, is_bad, len(names)).astype(np.int64)),
                pa.array(np.bincount(place, minlength=len(names))),
            ], ["unit", "bad", "n"])

        yield from in_batches(batches, "text", then)

    counted = rows.mapInArrow(count, "unit long, bad long, n long").groupBy("unit").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    likely = counted.where((F.col("bad") >= LEXICON_CONTEXTS) & (F.col("bad") >= LEXICON_SHARE * F.col("n"))).select("unit")
    candidates = np.sort(np.array([r["unit"] for r in likely.collect()], np.int64).view(np.uint64))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def then(batch: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
            unit, owner, before = units(texts)
            pick = _listed(unit, candidates) & np.array(batch.column(1).to_pylist(), bool)[owner]
            return pa.RecordBatch.from_arrays([pa.array(unit[pick].view(np.int64)), pa.array(before[pick].view(np.int64))], ["unit", "before"])

        yield from in_batches(batches, "text", then)

    varied = rows.mapInArrow(contexts, "unit long, before long").groupBy("unit").agg(F.countDistinct("before").alias("n"))
    found = [r["unit"] for r in varied.where(F.col("n") >= LEXICON_CONTEXTS).collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def pattern_counts(docs: DataFrame, text: str, lexicon: np.ndarray) -> dict[str, dict[int, int]]:
    """How often every pattern of votes occurs over all documents, by head.

    Tasks count first; at most 3 ** labellers patterns of a head exist, whatever the size of the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def then(batch: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
            statistics = measure(texts, lexicon).statistics
            rows = []
            for head, labellers in HEADS.items():
                code, n = np.unique(_pattern(votes(statistics, labellers)), return_counts=True)
                rows += [(head, int(c), int(k)) for c, k in zip(code, n)]
            return pa.RecordBatch.from_pydict(dict(zip(("head", "pattern", "n"), zip(*rows))))

        yield from in_batches(batches, "text", then)

    counted = _texts(docs, text).mapInArrow(run, "head string, pattern long, n long").groupBy("head", "pattern").agg(F.sum("n").alias("n"))
    out: dict[str, dict[int, int]] = {head: {} for head in HEADS}
    for row in counted.collect():
        out[row["head"]][row["pattern"]] = row["n"]
    return out


def train(
    docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic",
    training_rows: int = TRAINING_ROWS,
) -> Model:
    """Accuracies from the votes on all documents, and scorers from posterior labels of a bounded, hashed sample.

    ``labels`` (key, label), if given, only serve to list words for two of the labellers. Documents with a null id are counted
    like all others. No documents: a model whose scores are one half.
    """
    lexicon = learn_lexicon(docs, labels, key, text, label, training_rows)
    counts = pattern_counts(docs, text, lexicon)
    accuracies = {head: estimate(counts[head], labellers) for head, labellers in HEADS.items()}
    total = sum(counts["toxic"].values())
    share = min(1.0, training_rows / max(1, total))
    drawn = docs.where(F.pmod(F.xxhash64(key, F.lit("train")), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def then(batch: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
            found = measure(texts, lexicon)
            stops = np.searchsorted(found.text, np.arange(len(texts) + 1)).astype(np.int32)
            return pa.RecordBatch.from_arrays([
                batch.column(0), pa.ListArray.from_arrays(pa.array(stops), pa.array(found.feature.astype(np.int32))),
                pa.array(found.statistics.tolist(), pa.list_(pa.float64())),
            ], ["order", "features", "statistics"])

        yield from in_batches(batches, "text", then)

    rows = _texts(drawn, text, F.xxhash64(key).alias("order")).mapInArrow(
        run, "order long, features array<int>, statistics array<double>"
    ).toArrow().sort_by("order")
    features = [np.asarray(x.values.to_numpy(), np.int64) for x in rows.column("features")]
    statistics = np.array(rows.column("statistics").to_pylist(), float).reshape(-1, len(STATISTICS))
    scorers = {
        head: fit_scorer(features, statistics, accuracies[head].posterior(votes(statistics, labellers)))
        for head, labellers in HEADS.items()
    }
    return Model(lexicon, accuracies, scorers)


def classify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(key, low_quality_score, low_quality_posterior, the same for toxic, low_quality, toxic, kept) for every document.

    A score is that of the linear scorer, a posterior that of the labellers' votes; the flags are set where their mean
    reaches the threshold, so that a scorer that has seen few texts of a kind does not overrule all labellers. A null text counts as an empty one (no words). Rows are independent: repeated
    rows give repeated rows; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()
    names = [f"{head}_{part}" for head in HEADS for part in ("score", "posterior")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def then(batch: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
            found = measure(texts, shared.value.lexicon)
            columns = []
            for head, labellers in HEADS.items():
                columns.append(pa.array(shared.value.scorers[head].score(found)))
                columns.append(pa.array(shared.value.accuracies[head].posterior(votes(found.statistics, labellers))))
            return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", *names])

        yield from in_batches(batches, "text", then)

    wide = _texts(docs, text, F.col(key).alias("key"))
    scored = wide.mapInArrow(run, f"key {kind}, " + ", ".join(f"{name} double" for name in names))
    flags = scored.withColumns({h: F.col(f"{h}_score") + F.col(f"{h}_posterior") >= 2 * threshold for h in HEADS})
    return flags.withColumn("kept", ~F.col("low_quality") & ~F.col("toxic")).withColumnRenamed("key", key)
