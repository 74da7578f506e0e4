"""Toxicity of texts whose spelling may be disguised: a noisy channel restores words, a learned scorer reads them."""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F, types as T

from evidence.operators.scale import stored

# Letters that a digit or symbol may stand for.
READINGS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e",
}
#: Costs (negative logarithms) of what the channel does to a letter: written as another sign, written more than once,
#: parted from the next by a sign or a space. Against them: a sign or space that does end a word, digits that
#: are digits, and a sign for a letter that stands for none.
SUBSTITUTED, REPEATED, PARTED, ENDS, DIGITS, STRAY = 1.0, 1.0, 0.2, 2.0, 3.0, 4.0

# Symbols of the language model: 0 is a boundary, then a-z, ß to ÿ, other letters, digits, other signs.
_LATIN = [chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(0xDF, 0x100))]
_LETTER, _DIGIT, _SIGN = len(_LATIN) + 1, len(_LATIN) + 2, len(_LATIN) + 3
SYMBOLS = len(_LATIN) + 4

#: Code points beyond this one count as other letters.
_TABLED = 0x3000
#: Bytes of text that a worker handles together, and words whose restoration it remembers.
BATCH_BYTES, REMEMBERED = 4_000_000, 300_000

_STRETCH = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")
# three equal letters, or three pairs
_REPEATS = re.compile(r"(.)\1(?:\1|.*(.)\2.*(.)\3)", re.DOTALL)
_RUNS = re.compile(r"(.)\1*", re.DOTALL)
_WORD = re.compile(r"[^\W_]+")
_PREFIXES = (4, 5, 6)
# signs that are no letters in disguise, and those that are none at the end of a word
_AROUND = "".join(c for c in string.punctuation if c not in READINGS) + "«»“”„‚‘’…–—¡¿·•"
_BEHIND = _AROUND + "!|+"


def symbol(c: str) -> int:
    if c.isspace():
        return 0
    if c in _LATIN_AT:
        return _LATIN_AT[c]
    return _LETTER if c.isalpha() or ord(c) >= _TABLED else _DIGIT if c.isdigit() else _SIGN


_LATIN_AT = {c: i + 1 for i, c in enumerate(_LATIN)}
_table: list[np.ndarray] = []


def _symbols() -> np.ndarray:
    if not _table:
        _table.append(np.array([symbol(chr(c)) for c in range(_TABLED)] + [_LETTER], np.int64))
    return _table[0]


def trigram_counts(texts: list[str]) -> np.ndarray:
    """How often each three symbols follow each other in lower-case texts; a run of spaces is one boundary."""
    codes = np.frombuffer(("  " + "  ".join(texts) + "  ").lower().encode("utf-32-le", "replace"), np.uint32)
    s = _symbols()[np.minimum(codes, _TABLED)]
    s = s[(s != 0) | np.concatenate([[True], s[:-1] != 0])]
    return np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3) if len(s) > 2 else np.zeros(SYMBOLS**3, np.int64)


class LanguageModel:
    """Interpolated trigram model of characters: ``costs[a * SYMBOLS + b][c]`` is the negative logarithm of c after a, b."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
        # the first symbols of a word have the boundary and the word before it as context: only the boundary is kept
        tri[0] = tri.sum(axis=0)
        bi, uni = tri[1:].sum(axis=0), tri[1:].sum(axis=(0, 1))

        def share(x: np.ndarray) -> np.ndarray:
            return x / np.maximum(x.sum(axis=-1, keepdims=True), 1)

        p = 0.7 * share(tri) + 0.2 * share(bi)[None] + 0.09 * share(uni)[None, None] + 0.01 / SYMBOLS
        self.costs = (-np.log(p)).reshape(SYMBOLS * SYMBOLS, SYMBOLS).tolist()


def language_model(docs: DataFrame, text: str = "text") -> LanguageModel:
    """Trigram model over all texts. Each task adds its counts up; no more rows come back than three symbols can form."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for part in _texts(batches):
            total += trigram_counts([t for _, t in part])
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["gram", "n"])

    counted = docs.select(F.lit(None).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(count, "gram long, n long")
    total = np.zeros(SYMBOLS**3, np.int64)
    for row in counted.groupBy("gram").agg(F.sum("n").alias("n")).collect():
        total[row["gram"]] = row["n"]
    return LanguageModel(total)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(key, text) pairs in lists of about BATCH_BYTES, null texts as empty ones."""
    held, size = [], 0
    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
            value = text.as_py() or ""
            held.append((key, value))
            size += len(value) + 64
            if size >= BATCH_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def lattice(token: str) -> list[list[tuple[str, float, tuple[int, ...]]]]:
    """What each run of equal characters may stand for: (text, cost, symbols)."""

    def option(text: str, cost: float) -> tuple:
        return text, cost, tuple(symbol(c) for c in text)

    out = []
    for run in _RUNS.finditer(token):
        c, n = run.group(1), len(run.group())
        options = []
        if c.isalpha():
            options = [option(c, 0.0)] if n == 1 else [option(c, REPEATED), option(c * 2, 0.0 if n == 2 else REPEATED)]
        else:
            for letter in READINGS.get(c, ""):
                options.append(option(letter, SUBSTITUTED + (REPEATED if n > 1 else 0.0)))
                if n > 1:
                    options.append(option(letter * 2, SUBSTITUTED + (REPEATED if n > 2 else 0.0)))
            if c.isalnum():
                options.append((run.group(), DIGITS, (_DIGIT,) * min(n, 3)))
            else:
                options += [option("", PARTED), option(" ", ENDS)] if c not in READINGS else [option("", STRAY), option(" ", STRAY)]
        out.append(options)
    return out


def decode(token: str, model: LanguageModel) -> str:
    """The reading of least cost: Viterbi search over the last two symbols of the restored text; ties to the earlier option."""
    costs = model.costs
    states: dict[int, tuple] = {0: (0.0, None)}
    for options in lattice(token):
        after: dict[int, tuple] = {}
        for state, (cost, path) in states.items():
            for text, extra, symbols in options:
                at, total = state, cost + extra
                for s in symbols:
                    if s or at % SYMBOLS:  # a boundary after a boundary is none
                        total += costs[at][s]
                        at = at % SYMBOLS * SYMBOLS + s if s else 0
                if at not in after or total < after[at][0]:
                    after[at] = (total, (text, path))
        states = after
    _, _, path = min((cost + (costs[at][0] if at % SYMBOLS else 0.0), n, path) for n, (at, (cost, path)) in enumerate(states.items()))
    parts = []
    while path:
        parts.append(path[0])
        path = path[1]
    return "".join(reversed(parts))


@dataclass
class Reader:
    """Distinct restored words of texts; ``model`` None leaves disguises as they are."""

    model: LanguageModel | None
    known: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def token(self, token: str) -> tuple[str, ...]:
        """Words that one token stands for."""
        core = token
        if not token.isalpha():  # signs around a word are punctuation, but for those that may be its letters
            core = token.strip(_AROUND).rstrip(_BEHIND)
        if self.model and len(core) > 2 and (not core.isalpha() or _REPEATS.search(core)) and any(map(str.isalpha, core)):
            return tuple(_WORD.findall(decode(core, self.model)))
        return (core,) if core.isalpha() else tuple(_WORD.findall(core))

    def spaced(self, flat: str) -> list[str]:
        """Words that stretches of single characters stand for."""
        return [w for s in _STRETCH.finditer(flat) for w in _WORD.findall(decode(s.group(), self.model))] if self.model else []

    def words(self, text: str) -> set[str]:
        flat = " ".join(text.lower().split())
        out: set[str] = set()
        for token in set(flat.split(" ")):
            found = self.known.get(token)
            if found is None:
                found = self.known[token] = self.token(token)
                if len(self.known) > REMEMBERED:
                    self.known.clear()
            out.update(found)
        out.update(self.spaced(flat))
        return out


def features(words: set[str]) -> set[str]:
    """Words (``=word``) and their beginnings (``^word``) of a text, each once."""
    out = set()
    for w in words:
        out.add("=" + w)
        for n in _PREFIXES:
            if len(w) > n:
                out.add("^" + w[:n])
    return out


@dataclass
class Scorer:
    """Weights of features, the intercept, and the model that restores words."""

    weights: dict[str, float]
    intercept: float
    model: LanguageModel | None

    def reader(self) -> Callable[[str], tuple[float, list[str]]]:
        """A function from a text to its score and the features found."""
        reader, weights = Reader(self.model), self.weights
        telling: dict[str, list[str]] = {}
        plain: set[str] = set()  # tokens without features: nearly all, set aside by one difference of sets

        def hits(words) -> list[str]:
            return [f for w in words for f in ("=" + w, *("^" + w[:n] for n in _PREFIXES if len(w) > n)) if f in weights]

        def score(text: str) -> tuple[float, list[str]]:
            flat = " ".join(text.lower().split())
            present: set[str] = set(hits(reader.spaced(flat)))
            for token in set(flat.split(" ")) - plain:
                found = telling.get(token)
                if found is None:
                    found = hits(reader.token(token))
                    if found:
                        telling[token] = found
                    else:
                        plain.add(token)
                present.update(found)
            if len(plain) > REMEMBERED:
                plain.clear()
            if len(telling) > REMEMBERED:
                telling.clear()
            matched = sorted(present)
            return float(1 / (1 + np.exp(-np.clip(self.intercept + sum(weights[f] for f in matched), -500, 500)))), matched

        return score


def held_out(key: str, parts: int = 5):
    """Whether crc32 of the key as text leaves remainder 0; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts == 0


def training_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = 12_000) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled documents that are not held out, in the order of a hash of the key.

    A key that has several labels is toxic if one of them says so; of several texts of one key the smallest is taken. Null
    keys, labels and keys without a document take no part.
    """
    told = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("key")).agg(
        F.max((F.col(label) > 0).cast("int")).alias("toxic")
    )
    drawn = told.orderBy(F.xxhash64("key"), "key").limit(rows)
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(drawn), "key").groupBy("key").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    training_rows: int = 12_000, most_features: int = 5_000, least_evidence: float = 15.0, restore: bool = True,
) -> Scorer:
    """A scorer from the labelled documents that are not held out.

    The character model counts all texts. At most ``training_rows`` labelled documents are restored; of their words and
    beginnings of words those more frequent in toxic texts by a likelihood ratio of ``least_evidence`` or more are kept, the
    strongest ``most_features`` of them, and a logistic regression weighs their presence. Without toxic or without
    other labelled rows the score is the share of toxic ones (0.5 of two more rows, one of each kind).
    """
    model = language_model(docs, text) if restore else None
    sample = stored(training_sample(docs, labels, key, text, label, training_rows))
    total = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = total.get(1, 0), total.get(0, 0)
    if not bad or not good:
        return Scorer({}, float(np.log((bad + 1) / (good + 1))), model)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, counts = Reader(shared.value), (Counter(), Counter())
        for part in _texts(batches):
            for toxic, value in part:
                counts[toxic].update(features(reader.words(value)))
        names = list(counts[0].keys() | counts[1].keys())
        for at in range(0, len(names), 100_000):
            some = names[at : at + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), pa.array([counts[1][f] for f in some], pa.int64()), pa.array([counts[0][f] for f in some], pa.int64())],
                names=["feature", "bad", "good"],
            )

    rows = sample.select(F.col("toxic").cast("long").alias("key"), "text")
    counted = rows.mapInArrow(count, "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("b"), F.sum("good").alias("g"))

    def term(n: str, rest: str, size: int):
        expected = f"(({n} + {rest}) * {size / (bad + good)!r}D)"
        return f"(CASE WHEN {n} > 0 THEN {n} * ln({n} / {expected}) ELSE 0 END)"

    # likelihood ratio of presence and absence against equal rates
    counted = counted.withColumn("b0", F.lit(bad) - F.col("b")).withColumn("g0", F.lit(good) - F.col("g"))
    ratio = F.expr(f"2 * ({term('b', 'g', bad)} + {term('g', 'b', good)} + {term('b0', 'g0', bad)} + {term('g0', 'b0', good)})")
    chosen = counted.where(F.col("b") * good > F.col("g") * bad).withColumn("ratio", ratio).where(F.col("ratio") >= least_evidence)
    names = [r["feature"] for r in chosen.orderBy(F.desc("ratio"), "feature").limit(most_features).collect()]
    if not names:
        return Scorer({}, float(np.log((bad + 1) / (good + 1))), model)
    place = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, at = Reader(shared.value), place.value
        for part in _texts(batches):
            found = [sorted(at[f] for f in features(reader.words(value)) if f in at) for _, value in part]
            yield pa.RecordBatch.from_arrays(
                [pa.array([float(t) for t, _ in part]), pa.array(found, pa.list_(pa.int32()))], names=["label", "held"]
            )

    # rows of equal features are one weighted row
    held = stored(rows.mapInArrow(present, "label double, held array<int>").groupBy("label", "held").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    dense = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.array_contains("held", i).cast("double"))
    fitted = LogisticRegression(regParam=2e-4, standardization=False, maxIter=100, weightCol="weight").fit(
        held.select("label", "weight", array_to_vector(dense).alias("features"))
    )
    return Scorer({f: float(w) for f, w in zip(names, fitted.coefficients.toArray()) if w}, float(fitted.intercept), model)


SCORED = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("matched", T.ArrayType(T.StringType())),
])


def score(docs: DataFrame, scorer: Scorer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted, matched) of every whole text; ``matched`` holds the features found in the restored text.

    Only the text decides the score. Null and empty texts have the score of a text without features; repeated rows are scored
    each; a very long text is read as one, a list of its distinct words at a time. Extra columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = shared.value.reader()
        for part in _texts(batches):
            found = [read(value) for _, value in part]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in part], pa.int64()), pa.array([s for s, _ in found], pa.float64()), pa.array([m for _, m in found], pa.list_(pa.string()))],
                names=SCORED.names,
            )

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCORED)
    return rows.select(
        F.col("key").alias(key), held_out("key").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "matched"
    )
