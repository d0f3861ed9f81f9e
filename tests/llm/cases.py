"""Documents with everything that may be odd about a row."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, size int, key string, row string, node long, judged string"
BASE = ["doc_id", "text", "lang", "source", "n_chars"]
WORDS = {
    "en": "the of and to in is that for with was this from have which their would about there been other".split(),
    "de": "der und die das nicht mit auch sich auf werden eine über durch wird einer nach schließlich für zwischen während".split(),
    "fr": "les des une dans pour qui sur avec être même après français où très déjà leur cette comme étaient toujours".split(),
}


def sentence(rng: random.Random, lang: str, n: int = 8) -> str:
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(("", "", "e", "n")) for _ in range(n)).capitalize() + "."


def text(rng: random.Random, lang: str = "en", sentences: int = 6) -> str:
    return " ".join(sentence(rng, lang) for _ in range(sentences))


def rows(seed: int = 1, many: int = 40) -> list[tuple]:
    """(doc_id, text, lang, source) rows: ordinary ones, copies, near copies and the odd ones."""
    rng = random.Random(seed)
    out = []
    for i in range(many):
        lang = rng.choice(list(WORDS))
        out.append((10 + i, text(rng, lang, rng.randrange(1, 12)), lang, rng.choice(("b", "a", "a", "ä", None))))
    long = text(rng, "en", 3000)
    out += [
        (100, out[0][1], "en", "a"), (101, out[0][1] + " ", "en", "a"), (102, out[0][1].replace(" ", "\n"), "de", "b"), (3, out[0][1], "en", None),
        (103, out[5][1] + " more", "en", "a"), (104, long, "en", "a"), (105, long + " tail", "en", "a"),
        (106, None, "en", "a"), (107, "", "de", "b"), (108, " \t\n\x0b\x0c\r ", None, "b"), (109, "word", "fr", None), (110, "word", "fr", "b"),
        (None, out[1][1], "en", "a"), (None, None, None, None), (None, "word word", "en", "b"),
        (111, out[2][1], "en", "a"), (111, out[2][1], "en", "a"), (111, out[3][1] + " once more again", "en", "a"),
        (112, "123 456 ---   !!", "en", "a"), (113, "a b　c <|endoftext|> d\te", "en", "b"),
    ]
    return out


def frame(spark, data: list[tuple] | None = None, parts: int = 3):
    """The rows as a table with further columns whose names operators use inside."""
    data = rows() if data is None else data
    full = [(i, t, la, s, None if t is None else len(t), "x", 7, "k", "r", 5, "j") for i, t, la, s in data]
    return spark.createDataFrame(full, SCHEMA).repartition(parts) if full else spark.createDataFrame([], SCHEMA)


def none_safe(values):
    return sorted(values, key=lambda r: tuple((v is None, v) for v in r))
