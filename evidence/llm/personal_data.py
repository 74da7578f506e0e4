"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds to them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Fixed kinds, in the order of the output; the last one comes from the labels below only.
KINDS = ["email", "ip", "card", "phone", "secret"]
STATES = ["other", *KINDS]
#: Kinds whose spans may hold several words.
WIDE = {"card", "phone"}

# Fixed patterns. Atomic digits and the look-behind change no match, they keep long runs linear.
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_HOST = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SECRET = re.compile(r"\bAKIA[0-9A-Z]{16}\b|\b(?:password|passwd|secret|token|api_key)=[^\s\"']{8,}|(?<=\")[0-9a-f]{32,64}(?=\")")

#: The field is trained on windows of words from about so many documents, at most so many windows each.
TRAINING_DOCS, WINDOWS_A_DOC, WINDOW = 3000, 4, 17
#: Characters that a worker decodes together, beyond one whole text: each takes about 80 bytes.
BATCH_CHARS = 500_000

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def emails(text: str) -> Iterator[Span]:
    """Matches from left to right. Each at sign is met once, and its local part ends at the match before."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        host = EMAIL_HOST.match(text, at + 1) if start < at else None
        if host:
            yield "email", start, host.end()
            last = host.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind and start; matches that fail a kind's check are dropped."""
    spans = list(emails(text))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(digits := _only_digits(m[0])) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(_only_digits(m[0])) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def plausible(kind: str, text: str) -> bool:
    """Whether a span found by the field can be of its kind."""
    digits = _only_digits(text)
    if kind == "email":
        return "@" in text[1:-1]
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15 and not any(c.isalpha() for c in text)
    return len(text) >= 12 and bool(digits) and any(c.isalpha() for c in text)


# Classes of characters that make up a shape; all others share one class.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "@", ".", "-", "+", "()", "=", "\"'", ":/"]
SHAPES = 1 << 12
SIZES = [SHAPES, 12, 12, 16, 16, 8, 8, 8, 8]
SPACES = (9, 10, 11, 12, 13, 32)


def _class_table() -> np.ndarray:
    table = np.full(129, len(CLASSES), np.uint8)
    table[128] = 0  # letters beyond ASCII count as lower case
    for i, chars in enumerate(CLASSES):
        table[[ord(c) for c in chars]] = i
    return table


CLASS_OF = _class_table()
RANK_WEIGHT = (np.arange(1, 18, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


@dataclass
class Words:
    """Words of several texts joined by line ends: places, line of each, and one number per feature."""

    start: np.ndarray
    end: np.ndarray
    line: np.ndarray
    features: np.ndarray  # words x len(SIZES)


def _bucket(x: np.ndarray, most: int) -> np.ndarray:
    return np.minimum(x, most - 1)


def words_of(text: str) -> Words:
    """Words and their shape features, all from counts over the array of code points."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = np.isin(np.minimum(codes, 127).astype(np.uint8), SPACES)
    edge = np.diff(np.concatenate([[1], space.view(np.int8), [1]]))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return Words(start, end, start, np.zeros((0, len(SIZES)), np.int64))
    line = np.searchsorted(np.flatnonzero(codes == 10), start)
    kind = CLASS_OF[np.minimum(codes, 128)][~space]
    length = end - start
    first = np.cumsum(length) - length
    changes = np.empty(len(kind), bool)
    changes[0], changes[1:] = True, kind[1:] != kind[:-1]
    changes[first] = True
    run = np.cumsum(changes)
    rank = np.minimum(run - np.repeat(run[first], length), 16)
    weight = np.where(changes, (kind.astype(np.uint64) + np.uint64(1)) * RANK_WEIGHT[rank], np.uint64(0))
    shape = (np.add.reduceat(weight, first) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(52)

    def count(i: int) -> np.ndarray:
        return np.add.reduceat((kind == i).astype(np.int32), first)

    digits = count(2)
    some = (count(0) > 0) + 2 * (count(1) > 0) + 4 * (digits > 0)
    features = np.stack([
        shape.astype(np.int64), kind[first], kind[first + length - 1],
        np.where(digits < 10, digits, np.searchsorted([13, 16, 20, 33, 41], digits, "right") + 10),
        np.where(length < 8, length, np.searchsorted([12, 16, 19, 24, 33, 41, 65], length, "right") + 8),
        _bucket(count(4), 8), _bucket(count(5), 8), _bucket(count(3) + 2 * count(8), 8), some,
    ], axis=1).astype(np.int64)
    return Words(start, end, line, features)


OFFSETS = np.cumsum([0, *SIZES[:-1]])
WEIGHTS = sum(SIZES)


@dataclass
class Field:
    """Weights of the conditional random field: features of the word and of both neighbours, and transitions."""

    weights: np.ndarray  # 3 x WEIGHTS x states
    moves: np.ndarray  # states x states


def _index(features: np.ndarray) -> np.ndarray:
    return features + OFFSETS


def _emissions(field: Field, features: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Scores of the states of each word. Words of equal features are scored once."""
    packed = np.zeros(len(features), np.uint64)
    for i, size in enumerate(SIZES):
        packed = packed * np.uint64(size) + features[:, i].astype(np.uint64)
    _, pick, which = np.unique(packed, return_index=True, return_inverse=True)
    rows = _index(features[pick])
    own, before, after = (field.weights[i][rows].sum(axis=1, dtype=np.float32) for i in range(3))
    scores = own[which]
    same = line[1:] == line[:-1]
    scores[1:][same] += before[which[:-1]][same]
    scores[:-1][same] += after[which[1:]][same]
    return scores


def viterbi(emissions: np.ndarray, moves: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Best states of every word; lines are sequences, all decoded side by side."""
    n, states = emissions.shape
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    length = np.diff(np.append(first, n))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    active = np.searchsorted(-length, -np.arange(length[0]), "left")  # lines longer than t
    back = np.zeros((n, states), np.uint8)
    score = emissions[first]
    final = np.zeros((len(first), states), np.float32)
    turned = np.ascontiguousarray(moves.T)
    for t in range(1, length[0]):
        k = active[t]
        final[k : len(score)] = score[k:]
        at = first[:k] + t
        options = score[:k, None, :] + turned
        best = options.argmax(axis=2)
        back[at] = best
        score = np.take_along_axis(options, best[:, :, None], 2)[:, :, 0] + emissions[at]
    final[: len(score)] = score
    out = np.zeros(n, np.uint8)
    state = final.argmax(axis=1).astype(np.uint8)
    for t in range(length[0] - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        out[at] = state[:k]
        if t:
            state[:k] = back[at, state[:k]]
    return out


def _trimmed(text: str, kind: str, start: int, end: int) -> tuple[int, int]:
    head, tail = ("\"'<[{", ".,;:!?\"'>]})") if kind == "phone" else ("\"'<[{(", ".,;:!?\"'>]})")
    while start < end and text[start] in head:
        start += 1
    while end > start and text[end - 1] in tail:
        end -= 1
    return start, end


def added_spans(field: Field, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """Spans that the field finds in each text and that overlap none of its base spans."""
    joined = "\n".join(texts)
    words = words_of(joined)
    out: list[list[Span]] = [[] for _ in texts]
    if not len(words.start):
        return out
    states = viterbi(_emissions(field, words.features, words.line), field.moves, words.line)
    starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
    hits = np.flatnonzero(states)
    at = 0
    while at < len(hits):
        i = j = int(hits[at])
        kind = STATES[states[i]]
        at += 1
        while kind in WIDE and at < len(hits) and hits[at] == j + 1 and states[j + 1] == states[i] and words.line[j + 1] == words.line[i]:
            j, at = j + 1, at + 1
        start, end = _trimmed(joined, kind, int(words.start[i]), int(words.end[j]))
        if start == end or not plausible(kind, joined[start:end]):
            continue
        doc = int(np.searchsorted(starts, start, "right")) - 1
        a, b = start - int(starts[doc]), end - int(starts[doc])
        if all(b <= x or y <= a for _, x, y in base[doc]):
            out[doc].append((kind, a, b))
    return out


def labelled_windows(text: str, seed: int) -> list[tuple[str, list[int]]]:
    """Windows of words with the state of each: around spans of the patterns, and one elsewhere."""
    spans = base_spans(text) + [("secret", *m.span()) for m in SECRET.finditer(text)]
    words = words_of(text)
    n = len(words.start)
    if not n:
        return []
    states = np.zeros(n, np.int64)
    for kind, a, b in spans:
        states[np.searchsorted(words.end, a, "right") : np.searchsorted(words.start, b, "left")] = STATES.index(kind)
    found = np.flatnonzero(states)
    centres = [*found[np.linspace(0, len(found) - 1, min(len(found), WINDOWS_A_DOC - 1)).astype(int)], seed % n]
    out = []
    for c in centres:
        inside = np.flatnonzero(words.line == words.line[c])
        a, b = max(inside[0], c - WINDOW // 2), min(inside[-1], c + WINDOW // 2)
        out.append((text[words.start[a] : words.end[b]], states[a : b + 1].tolist()))
    return out


def labelled_table(docs: DataFrame, key: str, text: str, training_docs: int = TRAINING_DOCS) -> DataFrame:
    """(window, states): a small labelled table from about ``training_docs`` documents drawn by a hash of their ids."""
    share = min(1.0, training_docs / max(1, docs.count()))
    drawn = docs.where(F.pmod(F.xxhash64(key, F.lit("train")), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = drawn.select(F.col(text).cast("string").alias("text"), F.crc32(F.col(key).cast("string")).alias("seed")).where("text IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [w for t, s in zip(batch["text"], batch["seed"].fillna(0)) for w in labelled_windows(t, int(s))]
            yield pd.DataFrame(found, columns=["window", "states"])

    return rows.mapInPandas(run, "window string, states array<long>")


def fit(windows: list[tuple[str, list[int]]], epochs: int = 12, rate: float = 0.3, decay: float = 1e-4, batch: int = 256) -> Field:
    """Train by the gradient of the log likelihood (forward-backward sums) in batches, with per-weight step sizes.

    The table is small (its bound is that of :func:`labelled_table`), so it is trained in memory. An empty table gives a
    field that adds nothing.
    """
    states = len(STATES)
    weights, moves = np.zeros((3, WEIGHTS, states)), np.zeros((states, states))
    weights[0, OFFSETS[1] : OFFSETS[2], 0] = 1e-3  # ties go to no span
    sums_w, sums_m = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    sequences = [(_index(words_of(t).features), np.array(s)) for t, s in sorted(windows, key=lambda w: (w[0], list(w[1])))]
    sequences = [(x, y) for x, y in sequences if len(x) == len(y) and len(y)]
    random = np.random.default_rng(0)
    for _ in range(epochs):
        for part in np.array_split(random.permutation(len(sequences)), max(1, len(sequences) // batch)):
            if not len(part):
                continue
            longest = max(len(sequences[i][1]) for i in part)
            x = np.zeros((len(part), longest + 2, len(SIZES)), np.int64)
            y, real = np.zeros((len(part), longest), np.int64), np.zeros((len(part), longest), bool)
            for r, i in enumerate(part):
                n = len(sequences[i][1])
                x[r, 1 : n + 1], y[r, :n], real[r, :n] = sequences[i][0], sequences[i][1], True
            has = np.pad(real, ((0, 0), (1, 1)))
            views = [(x[:, 1:-1], real), (x[:, :-2], real & has[:, :-2]), (x[:, 2:], real & has[:, 2:])]
            emission = sum((weights[k][v].sum(axis=2) * m[:, :, None] for k, (v, m) in enumerate(views)))
            belief, pairs = _beliefs(emission, moves, real)
            target = np.eye(states)[y]
            error = (belief - target) * real[:, :, None]
            grad_w = decay * weights
            for k, (v, m) in enumerate(views):
                at = v[m]
                np.add.at(grad_w[k], at.ravel(), np.repeat(error[m] / len(part), len(SIZES), axis=0))
            seen = np.einsum("btk,btl,bt->kl", target[:, :-1], target[:, 1:], real[:, 1:].astype(float))
            grad_m = (pairs - seen) / len(part) + decay * moves
            sums_w += grad_w**2
            sums_m += grad_m**2
            weights -= rate * grad_w / np.sqrt(sums_w)
            moves -= rate * grad_m / np.sqrt(sums_m)
    return Field(weights.astype(np.float32), moves.astype(np.float32))


def _beliefs(emission: np.ndarray, moves: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the states of each word, and expected transitions summed over the batch."""
    rows, longest, states = emission.shape
    step = np.exp(moves)
    local = np.exp(emission - emission.max(axis=2, keepdims=True))
    forward, backward = np.zeros_like(local), np.ones_like(local)
    forward[:, 0] = local[:, 0] / local[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, longest):
        now = forward[:, t - 1] @ step * local[:, t]
        forward[:, t] = np.where(real[:, t, None], now / now.sum(axis=1, keepdims=True), forward[:, t - 1])
    for t in range(longest - 2, -1, -1):
        now = (backward[:, t + 1] * local[:, t + 1]) @ step.T
        backward[:, t] = np.where(real[:, t + 1, None], now / now.sum(axis=1, keepdims=True), 1.0)
    belief = forward * backward
    belief /= belief.sum(axis=2, keepdims=True)
    pairs = np.zeros((states, states))
    for t in range(1, longest):
        joint = forward[:, t - 1, :, None] * step * (local[:, t] * backward[:, t])[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        pairs += (joint * real[:, t, None, None]).sum(axis=0)
    return belief, pairs


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", training_docs: int = TRAINING_DOCS) -> Field:
    """A field trained on the labelled table of ``docs``."""
    return fit([(r["window"], r["states"]) for r in labelled_table(docs, key, text, training_docs).collect()])


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"<{kind.upper()}>"]
        last = max(last, b)
    return "".join(out) + text[last:]


def find(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """(_row, spans, n_base, masked): personal data in every whole text.

    ``_row`` holds the columns of docs, so names never clash. ``spans`` is array<struct<kind, start, end, base>> in
    code points, base spans first by kind and start, then those of the field; ``n_base`` counts the first. ``masked`` is the text with
    all spans replaced. A null text has no spans and stays null; rows are independent,
    so repeated rows give repeated results and nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
            base = [base_spans(t or "") for t in texts]
            more = added_spans(shared.value, [t or "" for t in texts], base)
            spans, hidden = [], []
            for t, b, m in zip(texts, base, more):
                spans.append([{"kind": k, "start": x, "end": y, "base": own} for s, own in ((b, True), (m, False)) for k, x, y in s])
                hidden.append(None if t is None else masked(t, b + m) if b or m else t)
            return pa.RecordBatch.from_arrays(
                [rows, pa.array(spans, pa.list_(span)), pa.array([len(b) for b in base], pa.int64()), pa.array(hidden, pa.string())],
                ["_row", "spans", "n_base", "masked"],
            )

        for batch in batches:
            texts, start, held = [], 0, 0
            for i, t in enumerate(batch.column(1)):
                texts.append(t.as_py())
                held += len(texts[-1] or "")
                if held >= BATCH_CHARS:
                    yield flush(batch.column(0).slice(start, i + 1 - start), texts)
                    texts, start, held = [], i + 1, 0
            if texts:
                yield flush(batch.column(0).slice(start), texts)

    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).cast("string").alias("_text"))
    schema = f"_row {wide.schema['_row'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>, n_base long, masked string"
    return wide.mapInArrow(run, schema)


def digests(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of base spans, and all spans as text."""
    found = find(docs.select(key, text), field, text)
    place = F.array(*map(F.lit, KINDS))

    def joined(spans):
        by_kind = F.transform(spans, lambda s: F.struct(
            F.array_position(place, s["kind"]).alias("o"), s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("k")
        ))
        parts = F.transform(F.array_sort(by_kind), lambda s: F.concat_ws(":", s["k"], s["a"].cast("string"), s["b"].cast("string")))
        return F.array_join(parts, ",")

    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")

    return found.select(
        F.col(f"_row.{key}").alias(key), *[count(k).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def brute_digest(text: str | None) -> str:
    """The digest of the base spans of one text."""
    return hashlib.sha256(written(ordered(base_spans(text or ""))).encode()).hexdigest()
