"""One consistent form for texts that look the same.

A table maps every character that has the look of another to it: full and half width forms, ligatures, characters without a look,
kinds of space, and letters of one shape in the Latin, Greek and Cyrillic scripts. Most of it follows from Unicode's own data. With
the composed letters and syllables, spelt out with every spelling of their parts, it makes the mapping of sequences, which is checked
for conflicts and compiled to a trie. One pass over the clusters of a text (a grapheme cluster, with the characters without a look
that follow it and the marks after those) takes the longest match at each place; the marks of a cluster are put in canonical order
before, and marks beyond those of any composed letter are composed by Unicode's rule.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.shapes import SAME_SHAPE
from gneiss.work import staged

# Characters of other categories that have no look, and format characters that do have one.
NO_LOOK = [(0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF)]
WITH_LOOK = [(0x0600, 0x0605), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x0890, 0x0891), (0x08E2, 0x08E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD), (0x13430, 0x1343F)]

#: Planes that hold characters, private ones aside.
ASSIGNED = (*range(0x80, 0x34000), *range(0xE0000, 0xE1000))
_JOINER = "\u200d"
_MICRO = 0xB5  # the only single letter that Unicode holds twice for the sake of another character set
_DIGRAPH = re.compile("LIGATURE|WITH SMALL LETTER|DIGRAPH")


def build_table() -> dict[str, str]:
    """The mapping of single characters (after canonical decomposition), checked for conflicts."""
    table: dict[str, str] = {}

    def put(source: str, target: str) -> None:
        if table.setdefault(source, target) != target:
            raise ValueError(f"{source!r} is mapped to both {table[source]!r} and {target!r}")

    inside = lambda cp, ranges: any(a <= cp <= b for a, b in ranges)
    for cp in ASSIGNED:
        char = chr(cp)
        category = unicodedata.category(char)
        if category == "Cf" and not inside(cp, WITH_LOOK) or inside(cp, NO_LOOK):
            put(char, "")
            continue
        if category == "Zs":
            put(char, " ")
            continue
        kind, _, rest = unicodedata.decomposition(char).partition(" ")
        if not kind.startswith("<"):
            continue
        target = "".join(chr(int(x, 16)) for x in rest.split())
        if kind in ("<wide>", "<narrow>"):
            put(char, target)
        elif kind == "<compat>" and target.isalpha() and (cp == _MICRO or len(target) > 1 and _DIGRAPH.search(unicodedata.name(char, ""))):
            put(char, target)
    for letters in SAME_SHAPE.values():
        for source, target in letters.items():
            if source != target:
                put(source, target)
    # targets are taken to their own form, so that one pass is enough
    for source in list(table):
        for _ in range(4):
            target = "".join(table.get(c, c) for c in unicodedata.normalize("NFD", table[source]))
            if target == table[source]:
                break
            table[source] = target
        else:
            raise ValueError(f"{source!r} has no stable form")
    _check(table)
    return table


def _check(table: dict[str, str]) -> None:
    for source, target in table.items():
        if any(c in table for c in target):
            raise ValueError(f"the form of {source!r} is not final")
        if source.isascii():
            raise ValueError(f"plain {source!r} must stay as it is")
        if unicodedata.category(source) in ("Lu", "Ll") and len(target) == 1 and target.isalpha() and unicodedata.category(target) in ("Lu", "Ll") and unicodedata.category(source) != unicodedata.category(target):
            raise ValueError(f"{source!r} would change its case")


def build_sequences(table: dict[str, str]) -> dict[str, str]:
    """The mapping of sequences in canonical order to their composed forms: ``table`` itself, and each composed letter or syllable with every spelling of its parts."""
    spelt: dict[str, list[str]] = {}
    sequences: dict[str, str] = {}

    def put(source: str, target: str) -> None:
        if sequences.setdefault(source, target) != target:
            raise ValueError(f"{source!r} is mapped to both {sequences[source]!r} and {target!r}")

    for source, target in table.items():
        put(source, unicodedata.normalize("NFC", target))
        if len(target) == 1:
            spelt.setdefault(target, []).append(source)
    for cp in ASSIGNED:
        char = chr(cp)
        if not (unicodedata.decomposition(char) or 0xAC00 <= cp <= 0xD7A3):  # syllables are composed by rule and have none of their own
            continue
        parts = unicodedata.normalize("NFD", char)
        if len(parts) == 1 or unicodedata.normalize("NFC", parts) != char:
            continue
        form = unicodedata.normalize("NFC", "".join(table.get(c, c) for c in parts))
        # of the parts' own forms: a letter of the same shape under the same marks is the same sequence
        for spelling in product(*[(c, *spelt.get(c, ())) for c in parts]):
            put("".join(spelling), form)
    return sequences


class Transducer:
    """A trie of sequences; takes the longest that begins at each place."""

    def __init__(self, sequences: dict[str, str]) -> None:
        self.root: dict = {}
        for source, target in sequences.items():
            node = self.root
            for char in source:
                node = node.setdefault(char, {})
            node[None] = target

    def __call__(self, text: str) -> str:
        out, i, n = [], 0, len(text)
        while i < n:
            node, best, j = self.root.get(text[i]), None, i
            while node is not None:
                j += 1
                if None in node:
                    best, end = node[None], j
                node = node.get(text[j]) if j < n else None
            if best is None:
                best, end = text[i], i + 1
            out.append(best)
            i = end
        return "".join(out)


class Canonicalizer:
    """The compiled transducer over the clusters of a text."""

    _run = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+")
    _emoji = regex.compile(r"\p{Extended_Pictographic}")
    _kept = 100_000

    def __init__(self, table: dict[str, str] | None = None) -> None:
        table = build_table() if table is None else table
        # characters without a look are taken out before the walk, so that what they part can match as one sequence
        self.walk = Transducer({source: target for source, target in build_sequences(table).items() if target})
        self.known: dict[str, str] = {}
        self.unseen = {ord(c): None for c, target in table.items() if not target}
        unseen = "".join(f"\\U{cp:08x}" for cp in self.unseen)
        # what has no look parts no cluster: marks, and the later letters of a syllable, belong to the letter before it
        # also where a cluster ends with it by Unicode's rule
        later = rf"[\p{{M}}\u1160-\u11ff\uff9e\uff9f{unseen}]"
        self._cluster = regex.compile(rf"\X(?:(?<=[{unseen}]){later}+|[{unseen}]{later}*)?" if unseen else r"\X")

    def cluster(self, text: str) -> str:
        """The form of one cluster."""
        unseen = self.unseen
        if _JOINER in text and len(self._emoji.findall(text)) > 1:  # within a picture put together of pictures the joiner does have a look
            unseen = {cp: None for cp in unseen if chr(cp) != _JOINER}
        return unicodedata.normalize("NFC", self.walk(unicodedata.normalize("NFD", text.translate(unseen))))

    def _of_run(self, match: re.Match) -> str:
        known, out = self.known, []
        for piece in self._cluster.findall(match[0]):
            form = known.get(piece)
            if form is None:
                if len(known) >= self._kept:
                    known.clear()
                form = known[piece] = self.cluster(piece)
            out.append(form)
        return "".join(out)

    def __call__(self, text: str | None) -> str | None:
        """The form of a text; null for null."""
        return text if text is None or text.isascii() else self._run.sub(self._of_run, text)


@lru_cache(maxsize=1)
def canonicalizer() -> Canonicalizer:
    return Canonicalizer()


def canonical_column(text: Column) -> Column:
    """The consistent form of a text column; null stays null, empty stays empty."""

    @F.pandas_udf("string")
    def form(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = canonicalizer()
        for part in texts:
            yield part.map(known, na_action="ignore")

    return form(text)


def _keys(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(id, form, raw): hashes of the consistent form and of the text itself, of the texts with a visible character."""
    both = documents.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("raw"), canonical_column(F.col(text)).alias("form"))
    marked = both.select("id", F.unhex(F.sha2("form", 256)).alias("form"), F.unhex(F.sha2("raw", 256)).alias("raw"), F.col("form").rlike(r"[^\s\x00-\x1f\x7f-\x9f]").alias("visible"))
    # hashes only, written once: what follows reads them several times, and neither that nor the filter must run the transducer again
    return staged(marked, "look-keys").filter("visible").drop("visible")


#: Documents of one look that stand on the right side of one task's pairs, about; a look that more share is cut into so many parts.
LOOK_BLOCK = 2_000


def same_look(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (a, b), a < b, of documents whose texts have one form and are not the same.

    Null, empty and blank texts are in no pair, nor are exact copies of one text; a document that looks like both copies of a text
    is in a pair with each. A look that very many documents share has many such pairs, whose rows are spread over tasks;
    :func:`look_classes` says the same in one row for each document.
    """
    keys = _keys(documents, key, text)
    # only forms with several spellings are joined; combined on the map side, so a form of a third of all rows is a row for each task
    spelt = keys.groupBy("form").agg(F.min("raw").alias("low"), F.max("raw").alias("high"), F.count("*").alias("n")).filter(F.col("low") != F.col("high"))
    members = keys.join(spelt.select("form", F.ceil(F.col("n") / LOOK_BLOCK).cast("int").alias("parts")), "form")
    a = members.select("form", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("a"), F.col("raw").alias("raw_a"))
    b = members.select("form", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("b"), F.col("raw").alias("raw_b"))
    return a.join(b, ["form", "part"]).filter((F.col("raw_a") != F.col("raw_b")) & (F.col("a") < F.col("b"))).select("a", "b")


def look_classes(documents: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each document with a visible text: (id, class_id, text_id, spellings).

    class_id is the least id of its look, text_id the least id of exactly its text; two documents look the same and differ where
    their class_id is one and their text_id is not. ``spellings`` counts the different texts of the look.
    """
    keys = _keys(documents, key, text)
    # distinct spellings first, so that copies do not gather anywhere
    texts = staged(keys.groupBy("form", "raw").agg(F.min("id").alias("text_id")), "look-texts")
    spelt = texts.groupBy("form").agg(F.min("text_id").alias("class_id"), F.count("*").alias("spellings"))
    return keys.join(texts, ["form", "raw"]).join(spelt, "form").select("id", "class_id", "text_id", "spellings")
