"""Language identification by compression.

Each language has a dictionary of raw text, sampled from labelled documents. A text is cut into blocks, every block is
compressed with every dictionary, and the language with the smallest total wins: the better a dictionary's words and
endings match, the fewer bytes are left. Cutting into blocks keeps a long text from becoming its own dictionary, so
evidence from the whole text counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from procatlas.llm.store import per_process
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
RESULT = "lang_pred string, score double, margin double, rejected boolean"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    """Raw-content dictionaries by language, the most frequent language first.

    A text is rejected when the smallest total saves less of the next than ``min_margin``, or less than one byte for every
    ``bytes_a_step`` of the text where that is less. So a few words may leave the same bytes with every dictionary.
    """

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    level: int = 6
    block: int = 2048
    min_margin: float = 0.01
    bytes_a_step: int = 64

    def sizes(self, texts) -> list[list[int]]:
        """Compressed bytes of each text by language."""
        compressors = _compressors(self)
        out = []
        for text in texts:
            raw = text.lower().encode()
            blocks = [raw[i : i + self.block] for i in range(0, len(raw), self.block)]
            out.append([sum(len(c.compress(b)) for b in blocks) for c in compressors])
        return out

    def judge(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, margin, rejected) of one text."""
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, 0.0, True
        sizes = self.sizes([text])[0]
        best = min(range(len(sizes)), key=lambda i: sizes[i])
        others = sizes[:best] + sizes[best + 1 :]
        if not others:
            return self.languages[best], 1.0, 1.0, False
        saved = min(others) - sizes[best]
        margin = saved / min(others)
        narrow = saved < min(self.min_margin * min(others), len(text.encode()) // self.bytes_a_step)
        return self.languages[best], 0.5 + 0.5 * min(1.0, 10 * margin), margin, narrow


def _compressors(model: Model) -> list:
    """The process's compressors of a model, with digested dictionaries."""

    def make() -> list:
        import zstandard

        ready = []
        for raw in model.dictionaries:
            dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=model.level)
            ready.append(zstandard.ZstdCompressor(level=model.level, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False))
        return ready

    return per_process("compressors", (model.dictionaries, model.level), make)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = 150, piece: int = 1024,
        pieces: int = 9600, least: int = 10, **settings) -> Model:
    """Dictionaries from a bounded sample of labelled rows.

    From every language the ``per_language`` rows with the smallest hashes give one piece of ``piece`` characters each, from a
    hashed place of the text; where there are so many languages that this passes ``pieces`` in all, fewer rows of each do, but
    ``least``. Pieces that dictionaries made of them assign to
    another language are then left out, which removes wrong labels. Rows with a null language or text teach nothing.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(F.trim(text)) > 0))
    names = [r[0] for r in rows.groupBy(F.col(lang).alias("lang")).count().orderBy(F.desc("count"), "lang").collect()]
    per_language = min(per_language, max(least, pieces // max(len(names), 1)))
    draw = F.xxhash64(F.lit("language"), F.col(doc_id), F.length(text))
    start = F.pmod(F.shiftright(draw, 7), F.greatest(F.length(text) - piece + 1, F.lit(1))).cast("int") + 1
    drawn = rows.select(F.col(lang).alias("lang"), draw.alias("draw"), F.substr(F.col(text), start, F.lit(piece)).alias("piece"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "piece"))
    sample = drawn.withColumn("rank", rank).filter(F.col("rank") <= per_language).orderBy("lang", "rank").collect()

    def build(rows) -> Model:
        by = {}
        for r in rows:
            by.setdefault(r["lang"], []).append(r["piece"].lower())
        known = [name for name in names if name in by]
        return Model(tuple(known), tuple("\n".join(by[name]).encode() for name in known), **settings)

    # A piece compresses to almost nothing with the dictionary that holds it, so each half judges the other.
    halves = [[r for r in sample if r["rank"] % 2 == h] for h in (0, 1)]
    judges = [build(half) for half in halves]
    agreed = [r for h in (0, 1) for r in halves[h] if judges[1 - h].judge(r["piece"])[0] in (r["lang"], UNKNOWN)]
    kept = {r["lang"] for r in agreed}
    return build(sorted(agreed + [r for r in sample if r["lang"] not in kept], key=lambda r: (r["lang"], r["rank"])))


def judge_language(model: Model, text: Column) -> Column:
    """A struct column ``lang_pred, score, margin, rejected``.

    Null, empty and letterless texts, and all texts if no language was learned, are ``und`` with score 0, and rejected.
    ``margin`` is the part of the second smallest total that the smallest saves; a text rejected for it keeps its language.
    Ties go to the more frequent language, with margin 0. Texts that repeat get the same answer.
    """

    @F.pandas_udf(RESULT)
    def judged(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.judge(t) for t in texts], columns=["lang_pred", "score", "margin", "rejected"])

    return judged(text)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows with all their columns, inside ``row``, beside ``lang_pred, score, margin, rejected``."""
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    return whole.select("row", judge_language(model, F.col("text")).alias("judged")).select("row", "judged.*")
