"""Odd documents: nulls anywhere, empty and long texts, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "bucket int, rank string, shard double, kept string, node binary, stratum string, digest long, piece string, _row int, _gone int, listed string"
)
WORDS = "the of and to in is that for was on harbor lantern meadow quartz violin ember cobalt drift".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None, 1, "r", 0.5, "k", b"x", "q", 7, "p", 3, 4, "l")


def rows() -> list[tuple]:
    long = prose(7, 6000)
    base = prose(1, 300)
    near = base.split(" ")
    near[150] = "CHANGED"
    found = [
        row(1, base),
        row(2, base),
        row(3, " ".join(near)),
        row(4, base.upper()),
        row(5, None),
        row(6, ""),
        row(7, " \t\n "),
        row(8, "one"),
        row(9, "one"),
        row(10, "a b"),
        row(11, long),
        row(12, long + " tail", None),
        row(13, "12345 !!! %%%", "de", None),
        row(14, "ünï cödé\u00a0text \u2003 wide 日本 😀", None),
        row(15, prose(2, 80), "fr"),
        row(15, prose(2, 80), "fr"),
        row(16, "<|endoftext|> </s> <s> x  y\r\n\tz "),
        row(None, prose(3, 60)),
        row(None, prose(3, 60)),
        row(17, "same line here\nsame line here\nsame line here\nother"),
        row(18, ("round and round we go " * 40).strip()),
        row(-5, prose(4, 70)),
    ]
    return found


def documents(spark, only=None):
    return spark.createDataFrame(rows() if only is None else only, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
