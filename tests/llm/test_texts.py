"""Operators on texts against brute force, with hard rows and with none."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

from evidence.llm import near_dedup, near_passages, personal_data, pieces, quality_rules, shingles as hashes, substring_dedup, weak_quality
from evidence.llm.suffix_array import permuted_prefixes, suffix_array
from pyspark.sql import functions as F

from tests.llm.samples import documents, passage, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_classes_equal_brute_force(spark):
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(documents(spark)).collect()}
    sets = {i: shingle_set(t) for i, t in texts() if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert got == {i: root(i) for i in sets}
    assert got[2] == got[3] == 1 and got[11] == 10 and got[8] == 8


def test_bucket_of_three_where_the_larger_two_are_alike(spark):
    for seed in range(100):
        b = passage(seed, 100)
        rows = [(1, b[: len(b) // 2] + passage(seed + 1000, 50)), (2, b), (3, b + " end")]
        found = near_dedup.weighted(near_dedup.shingles(near_dedup.words([t.encode() for _, t in rows])))
        if len(set(near_dedup.signatures(*found, 3, 1).ravel().tolist())) == 1:
            break
    got = near_dedup.classes(documents(spark, rows), bands=1, rows=1).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 2), (3, 2)]


def classes_by_brute_force(rows, similarity=0.8):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def around(seed, kinds):
    """Variants of one text: changed words, cut ends, an own half, and variants of these."""
    draw = random.Random(seed)
    base = passage(seed, 90).split(" ")
    rows = [base]
    for k in range(kinds):
        own = list(draw.choice(rows[:6]))
        for _ in range(draw.choice([1, 2, 3, 4])):
            own[draw.randrange(len(own))] = f"w{draw.randrange(40)}"
        cut = draw.choice([0, 0, 4, 9, 15, 20])
        own = own[cut:] if k % 2 else own[: len(own) - cut]
        if k % 5 == 0:
            own = own[:50] + passage(seed + 1000 + k % 3, 45).split(" ")
        rows.append(own)
    return [(i, " ".join(w)) for i, w in enumerate(rows, 1)]


@pytest.mark.parametrize("crowd", [3, 64])
def test_all_in_one_bucket_equals_brute_force(spark, monkeypatch, crowd):
    # every text in the same bucket: what the differences from the centres leave out must be unlike
    monkeypatch.setattr(near_dedup, "band_keys", lambda signature, bands, rows: np.ones((len(signature), bands), np.int64))
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    rows = around(crowd + 1, 40 if crowd < 64 else 120)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(documents(spark, rows), bands=1, rows=1).collect()}
    want = classes_by_brute_force(rows)
    assert len(set(want.values())) > 5 and got == want


def test_texts_with_much_in_common_make_few_pairs(spark, monkeypatch):
    # 300 texts share half of their words, or are copies of one text with a tenth of the words changed: all in one bucket
    seen = []
    check = near_dedup.verify
    monkeypatch.setattr(near_dedup, "band_keys", lambda signature, bands, rows: np.ones((len(signature), bands), np.int64))
    monkeypatch.setattr(near_dedup, "verify", lambda pairs, *a: seen.append(pairs.count()) or check(pairs, *a))
    base, draw = passage(50, 100).split(" "), random.Random(7)
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        own = list(base)
        if i % 2:
            own[50:] = passage(2000 + i, 50).split(" ")
        else:
            for k in draw.sample(range(100), 5):
                own[k] = f"w{i}x{k}"
        rows.append((i, " ".join(own)))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(documents(spark, rows), bands=1, rows=1).collect()}
    assert got == classes_by_brute_force(rows) and sum(seen) < 3 * len(rows)


def test_changed_copies_around_a_much_changed_one_make_few_pairs(spark, monkeypatch):
    # copies of one text with nought to twelve changed words, all in one bucket; the smallest id has the most changes
    seen = []
    check = near_dedup.verify
    keys = near_dedup.band_keys
    # a bucket of all, and others that hold the more texts the more alike these are
    monkeypatch.setattr(near_dedup, "band_keys", lambda signature, bands, rows: np.where(np.arange(bands) == 0, 1, keys(signature, bands, rows)))
    monkeypatch.setattr(near_dedup, "verify", lambda pairs, *a: seen.append(pairs.count()) or check(pairs, *a))
    base, draw = passage(60, 150).split(" "), random.Random(3)
    rows = []
    for i in range(1, 301):
        own = list(base)
        for k in draw.sample(range(150), 12 if i == 1 else i % 13):
            own[k] = f"w{draw.randrange(400)}"
        rows.append((i, " ".join(own)))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(documents(spark, rows), bands=6, rows=3).collect()}
    want = classes_by_brute_force(rows)
    assert got == want and len(set(want.values())) > 100 and sum(seen) < 2 * len(rows)


def test_keep_one(spark):
    docs = documents(spark)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == [1, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14, 15, 16]
    assert kept.where("doc_id IS NULL").count() == 2


def test_signature_estimates_similarity():
    a, b = np.arange(1, 1001, dtype=np.uint64), np.arange(201, 1201, dtype=np.uint64)
    text = np.repeat([0, 1], 1000)
    found = near_dedup.signatures(text, near_dedup.mix(np.concatenate([a, b])), np.ones(2000), 2, 2000)
    assert abs((found[0] == found[1]).mean() - 800 / 1200) < 0.05
    # weights: the share of a shingle's registers follows its weight
    heavy = near_dedup.signatures(np.zeros(10, int), near_dedup.mix(a[:10]), np.array([9.0] + [1.0] * 9), 1, 2000)
    assert abs((heavy[0] == near_dedup.mix(a[:1])[0]).mean() - 0.5) < 0.05


def removed_by_brute_force(rows, window):
    seen, out = set(), []
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - window + 1):
            piece = data[s : s + window]
            if piece in seen:
                gone[s : s + window] = b"\1" * window
            seen.add(piece)
        rest = bytes(x for x, g in zip(data, gone) if not g)
        spans = sum(1 for k in range(len(data)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((key, len(data), len(data) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [1, 1000])
def test_substrings_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 3000)
    rows = sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = substring_dedup.remove_repeats(documents(spark)).drop("kept").select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    ).collect()
    assert sorted(map(tuple, got), key=str) == sorted(removed_by_brute_force(rows, 100), key=str)


def test_a_phrase_of_many_passages_is_told_apart_by_longer_strings(spark, monkeypatch):
    # one phrase in 60 documents, with other words around it, with equal ones on one side, and twice in a document
    monkeypatch.setattr(substring_dedup, "CROWD", 8)
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 3000)
    phrase, tail = passage(900, 6), passage(901, 25)
    rows = [(i, f"{passage(910 + i, 30)} {phrase} {tail if i % 3 == 0 else passage(1000 + i, 30)}") for i in range(60)]
    rows += [(100 + i, f"{phrase} {phrase[:-1]}{i} {phrase} {passage(1100, 30)} {phrase}") for i in range(12)]
    got = substring_dedup.remove_repeats(documents(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(removed_by_brute_force(rows, 100))
    # every window lies in a passage, also after it is cut again
    pieces = [t.encode() for _, t in rows]
    text, start, count, *_ = substring_dedup.passages(pieces, 100, substring_dedup.LONGER)
    assert np.bincount(text, count).tolist() == [max(0, len(t) - 99) for t in pieces]


def test_suffix_array_and_prefixes():
    draw = np.random.default_rng(1)
    for trial in range(300):
        t = draw.integers(0, [1, 2, 4, 200][trial % 4], draw.integers(0, 80)).astype(np.uint8)
        if trial % 5 == 0:
            t = np.tile(t[:7], 9)
        data, order = t.tobytes(), suffix_array(t)
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        shared = permuted_prefixes(t, order) if len(t) else []
        for before, here in zip(order[:-1], order[1:]):
            a, b = data[before:], data[here:]
            assert shared[here] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_passages(spark):
    got = near_passages.near_passages(documents(spark)).collect()
    cover = defaultdict(list)
    for r in got:
        cover[r["doc_id"]].append((r["start_word"], r["start_word"] + r["n_words"], r["first_doc_id"], r["similarity"]))
    assert (0, 120, 1, 1.0) in cover[2] and any(f == 1 and s >= 0.8 and b - a >= 110 for a, b, f, s in cover[3])
    assert any(f == 4 and a <= 2 and b >= 100 for a, b, f, _ in cover[5])
    assert any(f == 6 and b - a == 90 for a, b, f, _ in cover[6])
    assert not {1, 4, 7, 8, 9, 10, 11, 14, 15} & set(cover)


@pytest.mark.parametrize("crowd", [32, 3])
def test_passages_whose_first_document_holds_a_part(spark, monkeypatch, crowd):
    monkeypatch.setattr(near_passages, "CROWD", crowd)
    whole = passage(50, 60)
    part = " ".join(whole.split(" ")[8:52])
    alone = passage(51, 60).split(" ")  # earlier documents own ten words each of it
    line = passage(52, 40)
    rows = [(1, passage(60, 70) + " " + part + " " + passage(61, 70)), *[(i, f"{passage(60 + i, 80)} {whole} {passage(80 + i, 50)}") for i in (20, 21)]]
    rows += [(2 + k, f"{passage(200 + k, 60)} {' '.join(alone[10 * k : 10 * k + 10])} {passage(210 + k, 60)}") for k in range(6)]
    rows += [(i, f"{passage(300 + i, 60)} {' '.join(alone)} {passage(330 + i, 60)}") for i in (22, 23)]
    rows += [(i, f"{passage(400 + i, 50)} {line} {passage(500 + i, 50)}") for i in range(30, 75)]
    rows += [(i, f"{passage(600 + i, 50)} {passage(53, 10)} {line} {passage(54, 10)} {passage(700 + i, 50)}") for i in (80, 81, 82)]
    cover = defaultdict(list)
    for r in near_passages.near_passages(documents(spark, rows)).collect():
        cover[r["doc_id"]].append((r["start_word"], r["n_words"], r["first_doc_id"], r["similarity"]))
    got = {i: sorted(c) for i, c in cover.items()}
    assert got == {21: [(80, 60, 20, 1.0)], 23: [(60, 60, 22, 1.0)], 81: [(50, 60, 80, 1.0)], 82: [(50, 60, 80, 1.0)]}


def test_verbatim_windows_are_covered(spark):
    # every 50 words that stand in an earlier document, or earlier in the same without overlap, lie in a row: also where texts are periodic
    block, line = passage(70, 30), passage(71, 55)
    rows = [
        (1, f"{passage(72, 9)} {' '.join([block] * 5)} {passage(73, 20)}"), (2, "again " * 400), (3, f"{passage(74, 40)} {' '.join(['again'] * 130)}"),
        (4, f"{line} {passage(75, 70)} {line} {passage(76, 30)} {line}"), (5, f"{passage(77, 12)} {' '.join([block] * 3)} {line}"),
        (6, " ".join([passage(78, 7)] * 40)), (7, passage(79, 300)), (8, f"{passage(80, 60)} {passage(78, 7)} {passage(81, 60)}"),
    ]
    cover = defaultdict(set)
    for r in near_passages.near_passages(documents(spark, rows)).collect():
        cover[r["doc_id"]].update(range(r["start_word"], r["start_word"] + r["n_words"] - 49))
    seen, missed, repeated = {}, [], 0
    for key, text in rows:
        split = text.split()
        for p in range(len(split) - 49):
            first = seen.setdefault(tuple(split[p : p + 50]), (key, p))
            if first[0] < key or first[1] <= p - 50:
                repeated += 1
                if p not in cover[key]:
                    missed.append((key, p, first))
    assert repeated > 600 and missed == []
    assert not cover[7] and not cover[8]


def test_passages_with_words_put_in_or_taken_out():
    hashes = lambda w: near_passages.shingles(near_passages.words([" ".join(w).encode()])).hash
    for n in (70, 90):
        for words in range(7, 16):
            for at in (n // 3, n // 2, 2 * n // 3):
                plain = passage(n, n).split(" ")
                longer = plain[:at] + passage(1000 + words, words).split(" ") + plain[at:]
                a, b = shingle_set(" ".join(plain)), shingle_set(" ".join(longer))
                if len(a & b) < 0.8 * len(a | b):
                    continue
                x, y = (hashes(passage(7, 60).split(" ") + w + passage(8, 60).split(" ")) for w in (plain, longer))
                other = hashes(passage(9, 80).split(" ") + longer)
                for left, right, p, q in ((x, other, 62, 82), (other, x, 82, 62), (hashes(plain), y, 2, 62)):
                    got = near_passages.common_passages(left, right, [(p, q)], 46, 0.8, False)
                    assert len(got) == 1 and min(got[0][1] - got[0][0], got[0][3] - got[0][2]) >= n - 5 and got[0][4] >= 0.8, (n, words, at)


def test_two_signatures_agree_on_near_passages():
    draw, missed = np.random.default_rng(11), 0
    for _ in range(400):
        shared = draw.integers(1, 1 << 62, 80).astype(np.uint64)
        both = [np.concatenate([shared, draw.integers(1, 1 << 62, 10).astype(np.uint64)]) for _ in range(2)]  # similarity 0.8
        seeds = np.arange(1, near_passages.FUNCTIONS + 1, dtype=np.uint64) * near_passages._GOLD
        x, y = ([near_passages.mix(b ^ seed).min() for seed in seeds] for b in both)
        missed += sum(i == j for i, j in zip(x, y)) < 2
    assert missed <= 1


@pytest.mark.parametrize("values", [60, 8, 2])
def test_compact_windows_hold_all_parts(values):
    draw = np.random.default_rng(4)
    for _ in range(100):
        n, least = int(draw.integers(1, 60)), int(draw.integers(2, 9))
        h = (draw.permutation(np.arange(n)) % values + 1).astype(np.uint64)
        h[draw.integers(0, n, 2)] = 0
        found = set(zip(*(x.tolist() for x in near_passages.compact_windows(h, least))))
        for i in range(n):
            for j in range(i + least - 1, n):
                if (h[i : j + 1] == 0).any():
                    break
                c = i + int(h[i : j + 1].argmin())
                assert any(x == c and a <= i and b >= j for x, a, b in found)


def naive_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and personal_data.luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_plain_patterns():
    draw = np.random.default_rng(0)
    for _ in range(20000):
        t = "".join(draw.choice(list("ab1.@-+ ()24"), draw.integers(0, 40)))
        assert personal_data.base_spans(t) == naive_spans(t)
    assert personal_data.base_spans("1" * 50000 + " " + "a" * 50000 + "@") == []


def training_table():
    table = []
    for i in range(60):
        word = passage(i, 3)
        for t, kind in ((f"{word} {passage(i + 70, 1)}.x{i % 2 or ''}@mail.example{'.org' * (1 + i % 3)} {word}", "email"), (f"{word} 10.{i}.0.{i} {word}", "ip"), (f"{word} plain {word}", None)):
            states = [personal_data.STATES.index(kind) if k == 3 and kind else 0 for k in range(7)]
            table.append((t, states))
    return table


def test_field_learns_and_decodes():
    field = personal_data.fit(training_table())
    found = personal_data.added_spans(field, ["ask other.name@host.example.net now\nor 192.168.7.9 then", ""], [[], []])
    assert [k for k, _, _ in found[0]] == ["email", "ip"] and found[1] == []
    # Viterbi against all paths
    draw = np.random.default_rng(2)
    emissions, moves = draw.normal(size=(9, 6)).astype(np.float32), draw.normal(size=(6, 6)).astype(np.float32)
    line = np.array([0] * 4 + [1] + [2] * 4)
    got = personal_data.viterbi(emissions, moves, line)
    for first, last in ((0, 4), (4, 5), (5, 9)):
        paths = np.stack(np.meshgrid(*[range(6)] * (last - first), indexing="ij"), -1).reshape(-1, last - first)
        score = sum(emissions[first + k, paths[:, k]] for k in range(last - first)) + sum(moves[paths[:, k], paths[:, k + 1]] for k in range(last - first - 1))
        assert got[first:last].tolist() == paths[score.argmax()].tolist()


def test_a_batch_of_personal_data_takes_little_memory():
    # workers hold one batch each beside the executor's heap
    field = personal_data.fit(training_table())
    lines = [passage(k, 100) + " ask other.name@host.example.net" for k in range(200)]
    batch = lines * (personal_data.BATCH_CHARS // sum(map(len, lines)) + 1)
    tracemalloc.start()
    found = personal_data.added_spans(field, batch, [[] for _ in batch])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(found) and peak < 100e6


def test_personal_data_of_hard_rows(spark):
    field = personal_data.fit(training_table())
    docs = documents(spark)
    rows = personal_data.digests(docs, field).collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    for i, t in texts():
        if i is not None:
            spans = sorted(naive_spans(t or ""), key=lambda s: (personal_data.KINDS.index(s[0]), s[1]))
            assert by_id[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
    assert (by_id[14]["n_email"], by_id[14]["n_ip"], by_id[14]["n_card"], by_id[14]["n_phone"]) == (1, 1, 1, 1)
    masked = {r["i"]: r["masked"] for r in personal_data.find(docs, field).select(F.col("_row.doc_id").alias("i"), "masked").collect()}
    assert masked[7] is None and "<EMAIL>" in masked[14] and "@" not in masked[14] and masked[1] == dict(texts())[1]


def best_pieces(text, v):
    best, back = [0.0] + [float("-inf")] * len(text), [None] * (len(text) + 1)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - v.longest), j):
            found = v.pieces.get(text[i:j])
            if found is not None and best[i] + v.scores[found] > best[j]:
                best[j], back[j] = best[i] + v.scores[found], (i, [found])
        if text[j - 1] not in v.pieces:
            data = text[j - 1].encode()
            if best[j - 1] + v.byte_score * len(data) > best[j]:
                best[j], back[j] = best[j - 1] + v.byte_score * len(data), (j - 1, [v.byte_ids[b] for b in data])
    out, j = [], len(text)
    while j:
        j, ids = back[j]
        out = ids + out
    return out


def test_pieces_equal_full_search_and_round_trip(spark):
    v = pieces.Vocabulary.load()
    rows = {r["doc_id"]: r for r in pieces.encode(documents(spark), v).where("doc_id IS NOT NULL").collect()}
    for i, t in texts():
        if i is None:
            continue
        if t is None:
            assert rows[i]["ids"] is None and rows[i]["round_trip"] is None
            continue
        assert rows[i]["round_trip"] and pieces.decode(rows[i]["ids"], v) == t
        if len(t) < 6000:
            escaped = pieces.SPACE + t.replace(" ", pieces.SPACE) if t else ""
            assert rows[i]["ids"] == best_pieces(escaped, v) == list(pieces.segment(escaped, v))


@pytest.mark.parametrize("names, cut", [(["a", "b", "▁a", "▁\n", "\n", "▁▁"], True), (["a", "b", "a\n"], False), (["a", "\nb"], False), (["a", "a▁b"], False)])
def test_texts_are_cut_only_where_no_piece_crosses(names, cut):
    singles = ["a", "b", "▁", "\n"]
    names = [*names, *[c for c in singles if c not in names]]
    ids = {p: 256 + i for i, p in enumerate(names)}
    scores = [0.0] * 256 + [-1.0 * (len(p) == 1) - 0.5 for p in names]
    small = pieces.Vocabulary(ids, scores, list(range(256)), [bytes([i]) for i in range(256)] + [p.replace("▁", " ").encode() for p in names], True)
    assert small.starts_at_space == cut
    for text in ("a\nb a b", "ab\n a\n\nb  a", "\n", "a b\nb"):
        whole = list(pieces.segment("▁" + text.replace(" ", "▁"), small))
        assert np.frombuffer(pieces.Encoder(small).encode_all([text])[0], np.int32).tolist() == whole
        assert pieces.decode(whole, small) == text


def test_encoder_memory_does_not_matter():
    v = pieces.Vocabulary.load()
    small, large = pieces.Encoder(v, remembered=3), pieces.Encoder(v)
    for _, t in texts():
        assert small.encode_all([t]) == large.encode_all([t])


def statistics_by_hand(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(spark):
    rows = [*texts(), (20, "a b c\na b c\n a b c\n\n#x $y| <z>"), (21, "a b a b a b"), (22, "a\x0bb\x0cc\r\nd e")]
    judged = quality_rules.judge(documents(spark, rows), []).select(F.col("_row.text").alias("text"), "_s.*", "base_failed", "kept")
    for r in judged.collect():
        want = statistics_by_hand(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r["kept"] == (not r["base_failed"])


def test_rules_are_learned(spark):
    rows = [(i, float(i % 50), float((i * 7) % 100) / 100) for i in range(900)]
    table = spark.createDataFrame(rows, "key long, x double, y double").withColumn("bad", ((F.col("x") >= 40) & (F.col("y") < 0.5)).cast("int"))
    rules = quality_rules.learn_rules(table, ["x", "y"])
    columns = {"x": F.col("x"), "y": F.col("y")}
    found = table.withColumn("rule", quality_rules.first_rule(rules, columns))
    assert rules and found.where("bad = 0 AND rule IS NOT NULL").count() <= 9 and found.where("bad = 1 AND rule IS NULL").count() <= 9
    assert quality_rules.learn_rules(table.limit(0), ["x", "y"]) == [] and quality_rules.learn_rules(table.where("bad = 0"), ["x", "y"]) == []


def test_weak_labels_find_classes():
    draw = np.random.default_rng(0)
    bad = draw.random(20000) < 0.15
    labellers = [weak_quality.Labeller(n, 1, 0, ("k",)) for n in ("words", "mean_word", "symbol_rate")]
    right = [0.9, 0.8, 0.7]
    v = np.stack([np.where(draw.random(20000) < p, np.where(bad, 2, 1), np.where(bad, 1, 2)) for p in right], axis=1)
    code, n = np.unique(weak_quality._pattern(v), return_counts=True)
    model = weak_quality.estimate(dict(zip(code.tolist(), n.tolist())), labellers, rounds=300)
    assert abs(model.shares[1] - 0.15) < 0.05
    for i, p in enumerate(right):
        assert abs(model.table[1, i, 2] - p) < 0.1


def test_classifier_on_hard_rows_and_held_out_labels(spark):
    rude = [(100 + i, passage(100 + i, 80) + (" you stupid worthless idiot" if i % 5 == 0 else "")) for i in range(300)]
    junk = [(500 + i, " ".join(w + "###" for w in passage(900 + i, 60).split())) for i in range(60)]
    docs = documents(spark, [*texts(), *rude, *junk])
    found = {r["doc_id"]: r for r in weak_quality.classify(docs, weak_quality.train(docs)).collect()}
    assert len(found) == len({i for i, _ in [*texts(), *rude, *junk]})
    assert all(found[i]["toxic"] == (i % 5 == 0) for i, _ in rude) and all(found[i]["kept"] == (i % 5 != 0) for i, _ in rude)
    assert all(found[i]["low_quality"] for i, _ in junk)


def test_empty_tables(spark):
    docs = documents(spark, [])
    v = pieces.Vocabulary.load()
    assert near_dedup.classes(docs).count() == near_dedup.keep_one(docs).count() == 0
    assert substring_dedup.remove_repeats(docs).count() == near_passages.near_passages(docs).count() == 0
    assert personal_data.digests(docs, personal_data.train(docs)).count() == pieces.encode(docs, v).count() == 0
    assert weak_quality.classify(docs, weak_quality.train(docs)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.judge(docs, quality_rules.fit(docs, labels)).count() == 0


def test_only_dense_parts_have_windows(spark):
    # lines of 30 words that many texts hold, each among words of its own, are no part of a passage: no windows, no links
    line = passage(900, 30)
    rows = [(i, f"{passage(910 + i, 60)} {line} {passage(960 + i, 60)}") for i in range(1, 41)]
    rows += [(i, f"{passage(1100 + i, 40)} {passage(901, 70)} {passage(1200 + i, 40)}") for i in (50, 51)]
    chunks = near_passages.chunked(documents(spark, rows).select(F.col("doc_id").alias("doc"), "text"))
    dense = {r["doc"]: list(zip(r["place"], r["size"])) for r in near_passages.dense_parts(chunks, 50, 0.8).collect()}
    assert sorted(dense) == [50, 51]
    for (place, size), in dense.values():
        assert place <= 40 and place + size >= 106 and size <= 66 + 2 * 66 / 4


def test_dense_runs_equal_brute_force():
    draw = np.random.default_rng(6)
    for _ in range(200):
        sizes, least = draw.integers(0, 40, 3), int(draw.integers(2, 12))
        first = np.concatenate([[0], np.cumsum(sizes)])
        shared = draw.random(first[-1]) < draw.choice([0.5, 0.7, 0.9])
        inside = np.zeros(len(shared), bool)
        for a, b in zip(first[:-1], first[1:]):
            for i in range(a, b):
                for j in range(i + least, b + 1):
                    if shared[i:j].sum() * 5 >= 4 * (j - i):
                        inside[i:j] = True
        got = np.zeros(len(shared), bool)
        for i, j in zip(*near_passages.dense_runs(shared, first, least, 0.8)):
            got[i:j] = True
        assert (got == inside).all()


def test_passages_of_copies_and_of_periodic_texts_are_few(spark):
    line = " ".join([passage(905, 60)] * 60)
    rows = [(1, line), (2, line.replace(" ", "\n")), (3, " ".join([passage(905, 60)] * 3) + " " + passage(906, 40))]
    got = near_passages.near_passages(documents(spark, rows)).collect()
    assert [tuple(r)[1:] for r in got if r["doc_id"] == 2] == [(0, 3600, 1, 0, 3600, 1.0)]
    assert len(got) < 40 and any(r["doc_id"] == 3 and r["first_doc_id"] == 1 and r["n_words"] >= 180 for r in got)


def test_pairs_are_verified_side_by_side(monkeypatch):
    # as if each pair were alone, in as many steps as the longest needs; texts with changes all over are not tried at all
    draw, pairs, tries = random.Random(17), [], []
    part = lambda w: (near_passages.shingles(near_passages.words([" ".join(w).encode()])).hash, np.zeros(1, int), np.array([len(w) - 4]))
    for n in range(60):
        base = passage(1300 + n, draw.randint(60, 400)).split(" ")
        every = 8 if n % 4 == 0 else draw.choice([25, 60, 150])
        other = [f"{w}x" if i % every == 3 else w for i, w in enumerate(base)][draw.randint(0, 5) :]
        x, y = part(passage(1400 + n, 30).split(" ") + base), part(other)
        there = {h: q for q, h in enumerate(y[0].tolist())}
        at = np.array([(p, there[h], p - 45, p) for p, h in enumerate(x[0].tolist()) if h in there and p % 7 == 0]).reshape(-1, 4)
        pairs.append((x, y, at, False))
    plain = near_passages._Jobs.tried
    monkeypatch.setattr(near_passages._Jobs, "tried", lambda self, j, *a: tries.append(len(j)) or plain(self, j, *a))
    alone = []
    for k, p in enumerate(pairs):
        before = len(tries)
        alone += near_passages.passages_around([p], 46, 0.8)
        assert k % 4 or len(tries) == before
    steps = len(tries)
    together = near_passages.passages_around(pairs, 46, 0.8)
    assert [f for f, _ in together] == [f for f, _ in alone] and all((a == b).all() for (_, a), (_, b) in zip(together, alone))
    assert sum(bool(f) for f, _ in together) >= 25 and len(tries) - steps <= steps / 3


def test_letters_of_words_are_hashed_side_by_side():
    draw = random.Random(5)
    for k in range(60):
        lengths = [1, 2, 5, 39, 40, 41, 42, 300, 5000] if k % 3 == 0 else range(1, 13)
        split = [[bytes(draw.choices(range(33, 256), k=draw.choice(lengths))) for _ in range(draw.randint(0, 9))] for _ in range(draw.randint(0, 4))]
        found = near_passages.words([b" \t"[: k % 3] + b" ".join(w) for w in split])
        want = [(hashes._LETTER[list(w)] * hashes._PLACE[np.arange(len(w)) & 4095]).sum(dtype=np.uint64) for part in split for w in part]
        assert found.hash.tolist() == near_passages.mix(np.array(want, np.uint64)).tolist()
        assert np.diff(found.first).tolist() == [len(w) for w in split]
