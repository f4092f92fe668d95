"""Source files that do not parse.

A file is read in the language of its extension by every dialect of that language at once, on one graph-structured stack; a file
that none of them accepts is flagged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm import csharp, vb

#: The languages by extension.
LANGUAGES = {"cs": ("CSharp", csharp.valid), "vb": ("VisualBasic", vb.valid)}


def language_of(path: str | None) -> str | None:
    """The language of a path's extension, case ignored; null for others."""
    known = LANGUAGES.get((path or "").lower().rpartition(".")[2])
    return known[0] if known else None


def parses(path: str | None, text: str | None) -> bool | None:
    """Whether a text is valid in the language of its path; null for a null text and for other languages. An empty text is valid."""
    known = LANGUAGES.get((path or "").lower().rpartition(".")[2])
    if known is None or text is None:
        return None
    return known[1](text)


def parses_column(path: Column, text: Column) -> Column:
    """:func:`parses` over columns."""

    @F.pandas_udf("boolean")
    def valid(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for paths, texts in parts:
            yield pd.Series([parses(p, t) for p, t in zip(paths, texts)], dtype=object)

    return valid(path, text)


def checked(files: DataFrame, key: str, path: str, text: str, *keep: str) -> DataFrame:
    """The files of a known language with a text: (key, *keep, language, valid). Repeated rows are kept each; other columns are ignored."""
    ending = F.lower(F.regexp_extract(F.col(path), r"\.([^.]*)$", 1))
    known = files.filter(ending.isin(*LANGUAGES) & F.col(text).isNotNull())
    language = F.create_map(*[F.lit(x) for e, (name, _) in LANGUAGES.items() for x in (e, name)])[ending]
    return known.select(key, *keep, language.alias("language"), parses_column(F.col(path), F.col(text)).alias("valid"))


def invalid_rates(files: DataFrame, key: str, path: str, text: str, repository: str) -> DataFrame:
    """Files that do not parse per repository and language: (repository, language, files, invalid, rate). A null repository is one of its own."""
    rows = checked(files, key, path, text, repository)
    counts = rows.groupBy(F.col(repository).alias("repository"), "language").agg(F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid"))
    return counts.withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
