"""Rows that every operator must bear: nulls, empty and very long texts, repeats, clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, KEY long, fp string, Doc_Id string"


def rows() -> list[tuple]:
    chance = random.Random(5)
    syllables = ["an", "the", "of", "re", "tion", "é", "ß", "in", "or", "ing"]

    def prose(words: int) -> str:
        return " ".join("".join(chance.choice(syllables) for _ in range(chance.randint(1, 4))) for _ in range(words))

    long_text = prose(30_000)
    same = prose(60)
    texts = [
        (1, None), (2, ""), (3, "  \n\t "), (4, same), (5, same.replace(" ", "\n ")), (6, same + " more"),
        (7, long_text), (8, "one"), (9, "two words"), (9, "two words"), (9, "other text, same id"), (None, "no id"),
        (None, None), (10, "ONE"), (11, "漢字 😀 ﬁ é <|endoftext|> don't 12.5 [INST] </s> \\ ~"), (12, "a" * 5000),
        (13, "mail me: jo.doe+x@mail.example.com or +1 (212) 555-0199, card 4111 1111 1111 1111, ip 10.0.0.256 10.0.0.25"),
        (14, "x " * 50), (15, "\n".join(["a repeated line of text"] * 6)),
    ]
    texts += [(100 + i, prose(80)) for i in range(40)]
    return [
        (d, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else "src1", 3, i, "x", "y") for i, (d, t) in enumerate(texts)
    ]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def key(value):
    return tuple((v is not None, v) for v in value)
