"""Text normalisation: fused Arrow stages, and what Spark expresses by itself."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Optional stages by the names that options give them.
LOWERCASE, STRIP_DIACRITICS, STRIP_PUNCTUATION = "lowercase", "strip-diacritics", "strip-punctuation"
FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def without_marks(text: str) -> str:
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c)[0] != "M"))


def without_punctuation(text: str) -> str:
    return "".join(" " if unicodedata.category(c)[0] == "P" else c for c in text)


STAGES: dict[str, Callable[[str], str]] = {LOWERCASE: str.casefold, STRIP_DIACRITICS: without_marks, STRIP_PUNCTUATION: without_punctuation}


def normalise(text: str, stages: Sequence[str] = (), form: str = "NFKC") -> str:
    """Unicode form first, then the stages as ordered, then single spaces."""
    text = unicodedata.normalize(form, text)
    for name in stages:
        text = STAGES[name](text)
    return " ".join(text.split())


def normaliser(stages: Sequence[str] = (), form: str = "NFKC") -> Callable[[Column], Column]:
    """A column function for the stages; one pass over Arrow batches, each different text once. Null stays null."""
    if form not in FORMS:
        raise ValueError(f"unknown Unicode form {form!r}")
    for name in stages:
        if name not in STAGES:
            raise ValueError(f"unknown text normalizer {name!r}")
    stages = tuple(stages)

    @F.pandas_udf("string")
    def apply(texts):
        known = {t: normalise(t, stages, form) for t in texts.dropna().unique()}
        return texts.map(known).astype(object).where(texts.notna(), None)

    return apply


def collapse_blanks(text: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends; as Python splits."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def length_without_blanks(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", ""))


def trigrams(token: Column) -> Column:
    """The different three-character substrings."""
    return F.when(F.length(token) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(token) - 2), lambda i: F.substring(token, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def fixed_point(rate: Column, scale: int) -> Column:
    """Rounded half to even."""
    return F.rint(rate * scale).cast("int")
