"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from evidence.llm import spelling
from evidence.plans.catalog import table

from tests.llm.samples import documents

FOLDER = "/root/testdata/sf0.001"


def one_apart(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_vocabulary(rows, least=5):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{low}".encode())
            if h % 199 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}


def plain_variants(words, factor=5):
    patterns = {}
    for w in words:  # words one edit apart share a word with one place left out, or that word itself
        for p in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            patterns.setdefault(p, set()).add(w)
    near = {w: set() for w in words}
    for group in patterns.values():
        for a in group:
            near[a] |= {b for b in group if one_apart(a, b)}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def collected(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, FOLDER, "documents").collect()]
    got = entry.queries()["op11_spelling_variants"](spark, FOLDER)
    want = plain_variants(plain_vocabulary(rows))
    assert collected(got) == want and got.count() == len(want) > 500


@pytest.mark.parametrize("index_words", [40, 1_000_000])
def test_dense_neighbourhoods(spark, index_words):
    draw = random.Random(4)
    words = {"".join(draw.choice("abé") for _ in range(draw.randint(6, 9))): draw.choice([5, 5, 25, 26, 130, 131, 700]) for _ in range(500)}
    words |= {"x" * n: 5 ** (n - 5) for n in range(6, 15)} | {"hold" * 60: 9, "hold" * 60 + "s": 50}  # a chain of nine, and long words
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = spelling.variants(df, index_words=index_words)
    assert collected(got) == plain_variants(words) and got.count() == len(words)
    assert {r["root"] for r in got.where("word rlike '^x+$'").collect()} == {"x" * 14}


def test_hard_rows(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert collected(spelling.variants(spelling.vocabulary(docs, least=1))) == plain_variants(plain_vocabulary(rows, 1))
    assert spelling.variants(spelling.vocabulary(documents(spark, []))).count() == 0
    edge = documents(spark, [(None, "Straße× ÉCOLES strasse ÿÿÿÿÿÿ ABCDEFG"), (1, None), (2, ""), (3, "abcdef" * 4000)])
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    found = {r["word"]: r["n"] for r in spelling.vocabulary(edge, least=1).collect()}
    assert found == plain_vocabulary(rows, 1) and "Écoles" in found and "écoles" not in found and "straße×" in found


def test_index_intervals():
    index = spelling.Index(["banana", "bandana", "cabana"])
    low, high = index.all
    at = {c: i for i, c in enumerate(map(chr, index.alphabet))}
    for c in "ana"[::-1]:
        low, high = (int(index.rank(np.array([at[c]]), np.array([x]))[0]) for x in (low, high))
    assert high - low == 3  # all three end so
    owner, symbol, lower, upper = index.longer(np.array([low]), np.array([high]))
    assert {chr(index.alphabet[s]): int(b - a) for s, a, b in zip(symbol, lower, upper)} == {"n": 1, "d": 1, "b": 1}
