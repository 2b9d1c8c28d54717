"""Small tables with the awkward cases: nulls, empty and long texts, repeated rows, clashing column names."""

from __future__ import annotations

import random

LINE = "the same fifty bytes and more that several of the documents share in the middle of their text"
CLASHES = "score double, n_tokens bigint, position_ string, component_id_ bigint, label string"


def texts() -> list[tuple]:
    rnd = random.Random(5)
    words = ["ba", "Ko", "lem", "éta", "nur", "SI", "tov", "日本", "pran", "x1"]

    def prose(n: int) -> str:
        return " ".join(rnd.choice(words) + rnd.choice(words) for _ in range(n))

    base = prose(120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base), (2, " ".join(near)), (3, base), (4, None), (5, ""), (6, " \t\n"), (7, "one"), (8, "one two"),
        (9, prose(10) + LINE + prose(10)), (10, prose(30) + LINE), (11, LINE + LINE), (12, "a" * 700), (13, "a" * 60),
        (14, prose(6000)), (15, "Licensed under the Apache License, Version 2.0. " + prose(5) + " MIT License, mit license"),
        (16, "licensed under (the) apache   license version 2.0 " + prose(5)), (17, "cc by cc by"), (18, "Ünï <|endoftext|> 's it's 日本 \x00 \u2581 x"),
        (None, base), (None, None), (3, base), (20, LINE[:49]), (21, LINE[:50]), (22, prose(3) + "\U0001f600" * 20), (19, LINE[:50]),
    ]
    return rows


def documents(spark):
    """The rows above with the other columns of the table and some whose names an operator might use itself."""
    rows = [(i, t, "en" if k % 2 else None, None if k % 7 == 0 else f"s{k % 3}", None if t is None else len(t), 0.5, k, "p", k, "L") for k, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHES}")
