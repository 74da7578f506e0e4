"""Small tables with nulls, empty and long texts, repeated rows and clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, copy string, packed string, n_words string, kept string"


def passage(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) for _ in range(n))


def near_copy(text: str, every: int) -> str:
    parts = text.split(" ")
    return " ".join("changed" if i % every == every - 1 else w for i, w in enumerate(parts))


def texts() -> list[tuple]:
    a, b, c = passage(1, 120), passage(2, 200), passage(3, 90)
    return [
        (1, a), (2, a), (3, near_copy(a, 60)), (4, b), (5, "start here " + b[:700] + " other end " + passage(5, 80)), (6, c + "\n" + c),
        (7, None), (8, ""), (9, " \t\n"), (10, "one two three"), (11, "one two three"), (12, "word " * 3000), (13, passage(6, 4000)),
        (13, passage(6, 4000)), (14, "mail a.b@c.de or +1 (389) 555-5010, host 10.0.0.256 and 10.0.0.25; card 4111 1111 1111 1111 é 日本 😀"),
        (None, "a row without an id but with some words"), (None, None), (15, "x" * 5000), (16, "é日😀 " * 300),
    ]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [(i, t, None if k % 3 else "en", None if k % 4 == 0 else f"s{k % 3}", None, "r", "c", "p", "n", "k") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)
