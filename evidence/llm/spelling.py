"""Spelling variants: words one edit apart, found with FM-indexes over the delimited vocabulary."""

from __future__ import annotations

from math import ceil, floor, log, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from evidence.operators.scale import stored

#: Words are runs of these letters; only A-Z change case.
LETTERS = r"[a-zÀ-ÿ]"
#: Code points a word must have, so each half has three at least.
SHORTEST = 6
#: Mean number of words in the index of one group, and words searched side by side.
INDEX_WORDS, SEARCHED = 20_000, 4_000

FOUND = T.StructType([
    T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("n_near", T.LongType()),
    T.StructField("best_n", T.LongType()), T.StructField("best", T.StringType()),
])


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 5, every: int = 199) -> DataFrame:
    """(word, n): words of SHORTEST code points or more with at least ``least`` occurrences in all texts.

    A word is a maximal run of letters of the whole text, A-Z in lower case. Where ``every`` divides the unsigned crc32 of
    ``<key>:<run>``, the run loses its code point number crc32 % length. Null texts have no words, a null key counts
    as an empty one, repeated rows count again. Counting is partially aggregated, so a word that fills a third of
    the corpus is one row a task.
    """
    runs = docs.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"),
        F.explode(F.regexp_extract_all(
            F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(f"{LETTERS}{{{SHORTEST},}}"), F.lit(0)
        )).alias("run"),
    )
    size = F.char_length("run")
    hashed = runs.withColumn("h", F.crc32(F.concat("k", F.lit(":"), "run").cast("binary")))
    place = (F.col("h") % size).cast("int")
    cut = F.when(
        F.col("h") % every == 0, F.concat(F.col("run").substr(F.lit(1), place), F.col("run").substr(place + 2, size))
    ).otherwise(F.col("run"))
    return hashed.select(cut.alias("word")).where(F.char_length("word") >= SHORTEST).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")
    ).where(F.col("n") >= least)


class Index:
    """FM-index of words, each closed by a delimiter of its own that sorts before all letters, in word order.

    A pattern is searched from its last symbol on: an interval of suffix ranks holds the suffixes that begin with what
    was matched. Searches start from the delimiters, so a match ends where a word ends.
    """

    def __init__(self, words: list[str]):
        codes = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le"), np.uint32)
        alphabet, symbols = np.unique(codes, return_inverse=True)
        self.words, self.symbols, self.alphabet = words, len(alphabet) - 1, alphabet
        n, ends = len(codes), np.flatnonzero(symbols == 0)
        self.word_at = np.cumsum(np.concatenate([[0], (symbols[:-1] == 0)]))
        # ranks by prefixes of 1, 2, 4 ... symbols; the delimiters differ, so no comparison leaves a word
        rank = symbols.astype(np.int64) + len(ends)
        rank[ends] = np.arange(len(ends))
        step = 1
        while True:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            both = rank * (n + len(alphabet) + len(ends) + 2) + after
            order = np.argsort(both, kind="stable")
            new = np.concatenate([[0], np.cumsum(np.diff(both[order]) != 0)])
            rank[order] = new
            if new[-1] == n - 1:
                break
            step *= 2
        self.suffix = order
        self.before = symbols[order - 1]  # the text ends with a delimiter, which stands before its first symbol too
        where = np.argsort(self.before, kind="stable")
        counts = np.bincount(self.before, minlength=len(alphabet))
        self.first = np.cumsum(counts) - counts
        self.step_to = np.empty(n, np.int64)  # suffix rank of the suffix one symbol longer
        self.step_to[where] = np.arange(n)
        self.width = n + 1
        self.places = self.before[where].astype(np.int64) * self.width + where
        self.all = (0, len(ends))

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Suffix rank of the first suffix ``symbol`` + s with s at ``row`` or later."""
        return np.searchsorted(self.places, symbol * self.width + row)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words joined, and where each begins; the words are in the index."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(w) for w in words], np.int64)
        return np.searchsorted(self.alphabet, codes), np.cumsum(lengths) - lengths

    def longer(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """(interval number, symbol, low, high) of every symbol that stands before the suffixes of each interval."""
        size = high - low
        small = np.flatnonzero(size <= self.symbols)
        counts = size[small]
        owner = np.repeat(small, counts)
        rows = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + low[owner]
        letter = self.before[rows] != 0
        owner, rows = owner[letter], rows[letter]
        key, at, times = np.unique(owner * (self.symbols + 1) + self.before[rows], return_index=True, return_counts=True)
        start = self.step_to[rows[at]]
        wide = np.flatnonzero(size > self.symbols)
        each = np.repeat(wide, self.symbols)
        letters = np.tile(np.arange(1, self.symbols + 1), len(wide))
        lower, upper = self.rank(letters, low[each]), self.rank(letters, high[each])
        held = upper > lower
        return tuple(np.concatenate(x) for x in (
            (key // (self.symbols + 1), each[held]), (key % (self.symbols + 1), letters[held]),
            (start, lower[held]), (start + times, upper[held]),
        ))

    def whole(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval number, word number) of the words that are matched from end to end."""
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        rows = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + low[owner]
        begins = self.before[rows] == 0
        return owner[begins], self.word_at[self.suffix[rows[begins]]]


def one_edit(index: Index, words: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number in ``words``, number in the index) of index words that differ by one edit ahead of the last ``exact`` symbols.

    The last symbols are matched exactly; from there each state either goes on without an error or
    spends its one: skip a symbol of the word, read another in its place, or read one more. States whose interval is
    empty are gone; those that used the error go on exactly to the beginning of a word.
    """
    text, begin = index.encode(words)
    lengths = np.array([len(w) for w in words], np.int64)
    n = len(words)
    q, left = np.arange(n), lengths.copy()
    low, high = np.full(n, index.all[0]), np.full(n, index.all[1])
    found_q, found_w = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def match(q, left, low, high):
        symbol = text[begin[q] + left - 1]
        low, high = index.rank(symbol, low), index.rank(symbol, high)
        alive = high > low
        return q[alive], left[alive] - 1, low[alive], high[alive]

    for step in range(int(exact.max(initial=0))):
        now = exact[q] > step
        moved = match(q[now], left[now], low[now], high[now])
        q, left, low, high = (np.concatenate([a, b[~now]]) for a, b in zip(moved, (q, left, low, high)))
    clean, used = (q, left, low, high), tuple(np.zeros(0, np.int64) for _ in range(4))
    while len(clean[0]) or len(used[0]):
        q, left, low, high = used
        done = left == 0
        at, word = index.whole(low[done], high[done])
        found_q.append(q[done][at])
        found_w.append(word)
        used = match(*(x[~done] for x in used))
        q, left, low, high = clean
        at, symbol, lower, upper = index.longer(low, high)
        more = left[at] > 0
        expected = np.where(more, text[np.minimum(begin[q[at]] + np.maximum(left[at] - 1, 0), len(text) - 1)], -1)
        same = more & (symbol == expected)
        other = more & (symbol != expected)
        skip = left > 0
        spent = (
            (q[at], left[at], lower, upper),  # one symbol more
            (q[at][other], left[at][other] - 1, lower[other], upper[other]),  # another symbol
            (q[skip], left[skip] - 1, low[skip], high[skip]),  # one symbol less
        )
        used = tuple(np.concatenate(x) for x in zip(used, *spent))
        clean = q[at][same], left[at][same] - 1, lower[same], upper[same]
    pairs = np.unique(np.concatenate(found_q) * len(index.words) + np.concatenate(found_w))
    return pairs // len(index.words), pairs % len(index.words)


def search_group(rows: pd.DataFrame) -> pd.DataFrame:
    """Near words of the searched words of one group: (word, n, n_near, best_n, best), one row a searched word.

    Rows are (side, w, n, depth, asks). On side 1 the words are reversed, so the exact half is the first one.
    A pair that side 0 finds as well is left to it.
    """
    side = int(rows["side"].iloc[0])
    distinct = rows.drop_duplicates("w").sort_values("w")
    names, sizes = distinct["w"].tolist(), distinct["n"].to_numpy(np.int64)
    index = Index(names)
    asked = rows[rows["asks"]]
    out = []
    for at in range(0, len(asked), SEARCHED):
        part = asked.iloc[at : at + SEARCHED]
        words, n = part["w"].tolist(), part["n"].to_numpy(np.int64)
        query, near = one_edit(index, words, part["depth"].to_numpy(np.int64))
        if side:
            fresh = [not names[v].startswith(words[w][: len(words[w]) // 2]) for w, v in zip(query.tolist(), near.tolist())]
            query, near = query[fresh], near[fresh]
        shown = np.array([w[::-1] for w in names], object) if side else np.array(names, object)
        order = sorted(range(len(query)), key=lambda i: (query[i], -sizes[near[i]], shown[near[i]]))
        query, near = query[order], near[order]
        counts = np.bincount(query, minlength=len(words))
        first = np.searchsorted(query, np.arange(len(words)))
        for i, word in enumerate(words):
            best = near[first[i]] if counts[i] else None
            out.append((
                word[::-1] if side else word, int(n[i]), int(counts[i]),
                None if best is None else int(sizes[best]), None if best is None else shown[best],
            ))
    found = pd.DataFrame(out, columns=FOUND.names)
    return found.astype({"n": "int64", "n_near": "int64", "best_n": "Int64"})


def near_words(words: DataFrame, index_words: int = INDEX_WORDS) -> DataFrame:
    """(word, n, n_near, best_n, best) over (word, n): how many other words are one edit away, and the most frequent of them.

    With one edit between two words, either the last or the first half of the word is in the other, at its
    end or beginning. So a word is searched among the words that end with its last half and, reversed, among those that begin
    with its first half; a word is indexed under the halves that words of its own length and one more or less have.
    Halves are dealt by hash to groups of about ``index_words`` words, each with an index of its own. A group is never less
    than the distinct words with one half in common.
    """
    total = words.count()
    groups = max(1, -(-4 * total // index_words))
    both = words.select("n", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("word").alias("w")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("w"))
    )).alias("s")).select("n", "s.*")
    half = lambda length: F.floor((length + F.col("side")) / 2).cast("int")
    size = F.char_length("w")
    depths = F.array_distinct(F.array(half(size - 1), half(size), half(size + 1)))
    keyed = both.withColumn("depth", F.explode(depths)).where(F.col("depth") >= SHORTEST // 2).select(
        F.pmod(F.xxhash64("side", "depth", F.expr("right(w, depth)")), F.lit(groups)).alias("bucket"),
        "side", "w", "n", "depth", (F.col("depth") == half(size)).alias("asks"),
    )
    found = keyed.groupBy("side", "bucket").applyInPandas(search_group, FOUND)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))))
    return found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best")
    )


def variants(words: DataFrame, factor: int = 5, index_words: int = INDEX_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) over (word, n) of words with SHORTEST code points or more.

    The form of a word is its most frequent near word (ties: the first in code-point order) if that is ``factor`` times as
    frequent or more, else null; the root is the end of the chain of forms, the word itself where there is none. A
    chain gains a factor a step, so the largest count bounds its length, and roots are found by so many joins that
    double the steps. No words: no rows.
    """
    # the vocabulary is counted and then dealt, the found words are judged and then followed
    near = stored(near_words(stored(words), index_words))
    takes = F.col("best_n") >= factor * F.col("n")
    judged = near.select(
        "word", F.when(takes, F.col("best")).alias("form"), "n", "n_near", F.when(takes, F.col("best_n")).alias("form_n")
    )
    largest, least = judged.agg(F.max("n"), F.min("n")).first()
    steps = 1 + floor(log(largest / least, factor) + 1e-9) if largest else 1
    roots = judged.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(ceil(log2(max(steps, 1)))):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = stored(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
