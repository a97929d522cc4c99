"""Inputs that every operator must take: nulls, empty and long texts, repeated rows, clashing extra columns, no rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, kept int, shard array<int>, key long, bands string, g int"


def prose(n: int, seed: int = 0) -> str:
    draw = random.Random(seed)
    words = ["".join(draw.choice(["th", "an", "er", "on", "re", "st", "in"]) for _ in range(draw.randint(1, 4))) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words)) + "."


def odd_rows():
    texts = [(None, "No id here. " + prose(60, 1)), (1, None), (2, ""), (3, " \n\t "), (4, prose(30_000, 2)), (5, prose(80, 3)), (5, prose(80, 3)), (6, "x" * 50_000), (7, "日本語 テキスト <|endoftext|> ½ \x00"), (None, None), (8, prose(3, 4))]
    return [(i, t, None if i == 2 else "en", None if i == 1 else "src0", None, "clash", 0, [1], 1, "b", 2) for i, t in texts]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def table(spark, name, sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")


def words_of(text):
    import re

    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
