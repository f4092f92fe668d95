"""Telling source files that someone wrote by hand from generated, minified, vendored and data files.

Signs are looked for in this order: the path, then what two multi-pattern automata find: notices of generators and licence banners in
the header, marks that generators leave in the code, and the namespaces. A phrase that is only part of a sign is looked at in its line,
at the place where it was found. What leaves no phrase, minified code and data kept as code, is judged by the make-up of the text.
Namespaces are third-party ones where most of their files, in more than one repository, are told by path or banner; the files of such
a namespace that are neither, and lie in a repository with a main namespace of its own, are third-party copies too.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.work import staged

# Endings and names of files that tools write.
TOOL_ENDINGS = re.compile(r"(?:\.designer|\.g|\.g\.i|\.generated|\.assemblyinfo|\.assemblyattributes|_pb2|\.pb)\.(?:cs|vb|js|ts|py|go|cc|h)$|(?:^|/)temporarygeneratedfile_[^/]*$")
SHORT_ENDINGS = re.compile(r"[.-]min\.(?:js|css|mjs)$|\.(?:bundle|chunk|packed)\.(?:js|css|mjs)$|\.[0-9a-f]{8,}\.(?:js|css|mjs)$")
LOCKFILES = frozenset("package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml packages.lock.json project.assets.json composer.lock cargo.lock poetry.lock gemfile.lock".split())
# Directories of third-party copies, anywhere or only outside of a project's own directory; and of build results.
VENDORED = frozenset("node_modules bower_components jspm_packages third_party third-party thirdparty 3rdparty vendored".split())
VENDORED_OUTSIDE = frozenset("vendor external externals extern packages lib libs deps".split())
BUILT = frozenset("obj".split())
CONFIGURATION = frozenset("json yml yaml config xml ini toml props targets csproj vbproj sln resx settings editorconfig".split())

# Phrases in headers, in lower case. Those of NOTICES say that a tool wrote the file, those of BY_HAND that none did.
NOTICES = (
    "<auto-generated", "<autogenerated", "code generated by", "do not edit", "do not modify", "don't edit", "edits are lost", "edits will be lost", "changes will be lost",
    "changes may be lost", "will be overwritten", "is overwritten", "regenerated on each", "regenerated by", "this file was generated", "this file is generated", "this code was generated",
    "automatically generated", "auto-generated by", "autogenerated by", "auto generated by", "generated file", "generated code", "wrote this file", "@generated", "was generated by",
)
BY_HAND = ("written by hand", "handwritten", "hand-written", "not generated", "not auto-generated", "not autogenerated", "replaces the file", "replaces the class", "replaces the code")
#: Notices that hold whatever else the header says.
FIRM = ("<auto-generated", "do not edit")
# Phrases that say what a tool made the file from, and those of licence banners of third-party files, with the form of the line where they stand.
_SOURCES = re.compile(r"(?:^|[/*'\s])\w+ output for \S+\.\w+\s*$|(?:^|[/*'\s])generated from \S+\.\w+|^\W*\w+ \d+(?:\.\d+)+ \S+\.(?:grammar|g4?|y|l|xsd|wsdl|proto)\s*$|(?:^|[/*'\s])source: \S+\.(?:proto|grammar|g4|xsd|wsdl|thrift)\s*$")
_BANNER = re.compile(r"spdx-license-identifier:|licensed under|\blicense file of\b|^\s*/\*!.*\|\s*\(c\)|released under the \w+ licen[cs]e|permission is hereby granted")
IN_LINE = {
    **dict.fromkeys(("output for ", "generated from ", "source: ", ".grammar", ".g", ".y", ".l", ".xsd", ".wsdl", ".proto"), ("source", _SOURCES)),
    **dict.fromkeys(("spdx-license-identifier:", "licensed under", "license file of", "/*!", "released under the ", "permission is hereby granted"), ("banner", _BANNER)),
}
# Phrases in code, with the form of the line where they stand.
_ATTRIBUTE = re.compile(r"^\s*[\[<]\s*(?:(?:assembly|module)\s*:\s*)?(?:global(?:::|\.))?(?:system\.codedom\.compiler\.)?(?:generatedcode|compilergenerated)(?:attribute)?\s*\(|^\s*#line\s+\d+\s+\"|^\s*#pragma checksum|^\s*\[assembly:\s*global::system\.reflection\.assemblytitle")
IN_CODE = {
    **dict.fromkeys(("generatedcode", "compilergenerated", "#line", "#pragma checksum", "global::system.reflection.assemblytitle"), ("mark", _ATTRIBUTE)),
    **dict.fromkeys(("global::system", "global.system"), ("qualified", re.compile(r"\bglobal(?:::|\.)system\b"))),
    "const int t__": ("token", re.compile(r"^\s*(?:public )?const int t__\d+\s*=\s*\d+;")),
    "namespace": ("namespace", re.compile(r"^[ \t]*namespace[ \t]+(?:global(?:::|\.))?([a-z_]\w*)")),
}

_HEADER_LINE = re.compile(r"\s*(?:$|//|/\*|\*|'|rem\b|#(?!\s*(?:if|else|elif|end|line))|<!--|\ufeff)", re.I)
_BYTE_ORDER = re.compile("^(?:\ufeff|\u00ef\u00bb\u00bf)+")
_KEY_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]+-----[^\"]*")
_STRINGS = re.compile(r'@"(?:[^"]|"")*(?:"|\Z)|"(?:[^"\\\n]|\\.)*"')
_NUMBER = re.compile(r"[-+]?(?:0[xX][0-9A-Fa-f]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)[A-Za-z]{0,2}")
_WORD = re.compile(r"[A-Za-z_]\w*")
_COMMENT = re.compile(r"/\*.*?\*/|//[^\n]*", re.S)


def _automaton(phrases: Iterable[str]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for phrase in phrases:
        machine.add_word(phrase, phrase)
    machine.make_automaton()
    return machine


@lru_cache(maxsize=1)
def _automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    """One for headers and one for code."""
    return _automaton([*NOTICES, *BY_HAND, *IN_LINE]), _automaton(IN_CODE)


def _line_at(text: str, at: int) -> str:
    end = text.find("\n", at)
    return text[text.rfind("\n", 0, at) + 1 : len(text) if end < 0 else end]


def header(text: str) -> str:
    """The comments and directives before the first line of code, of whatever length; a mark of byte order, read rightly or wrongly, comes before them."""
    text = _BYTE_ORDER.sub("", text, count=1)
    end, inside = 0, False
    for line in text.splitlines(keepends=True):
        if inside:
            inside = "*/" not in line
        elif _HEADER_LINE.match(line):
            start = line.rfind("/*")
            inside = start >= 0 and "*/" not in line[start:]
        else:
            break
        end += len(line)
    return text[:end]


def _from_path(path: str) -> str | None:
    parts = path.replace("\\", "/").split("/")
    low = path.replace("\\", "/").lower()
    name = parts[-1].lower()
    if name in LOCKFILES:
        return "lockfile"
    if name.rpartition(".")[2] in CONFIGURATION:
        return "configuration"
    if TOOL_ENDINGS.search(low):
        return "generated"
    if SHORT_ENDINGS.search(low):
        return "minified"
    project = False
    for i, part in enumerate(parts[:-1]):
        plain = part.lower()
        if plain in BUILT:
            return "generated"
        if plain == "node_modules" or plain in VENDORED and not project:
            return "vendored"
        # these names are also plain words, and a project's own folders are often named so
        if part in VENDORED_OUTSIDE and not project and i < len(parts) - 2:
            return "vendored"
        project = project or "." in part.strip(".")
    return None


def header_signs(head: str) -> set[str]:
    """What the header says, by the automaton: generated and banner."""
    low = head.lower()
    told, by_hand, firm, out = False, False, False, set()
    for end, phrase in _automata()[0].iter(low):
        if phrase in IN_LINE:
            kind, form = IN_LINE[phrase]
            if kind not in out and form.search(_line_at(low, end)):
                out.add(kind)
        elif phrase in BY_HAND:
            by_hand = True
        else:
            told, firm = True, firm or phrase in FIRM
    if (told or "source" in out) and (not by_hand or firm):
        out.add("generated")
    return out - {"source"}


def code_signs(text: str) -> tuple[set[str], list[str]]:
    """What the code says, by the automaton: whether a tool made it, and the roots of its namespaces, in lower case."""
    low = text.lower()
    counts = {"qualified": 0, "token": 0}
    out: set[str] = set()
    roots: dict[str, None] = {}
    for end, phrase in _automata()[1].iter(low):
        kind, form = IN_CODE[phrase]
        if kind == "qualified":
            counts[kind] += not low[end + 1 : end + 2].isalnum()
            continue
        if kind == "mark" and kind in out:
            continue
        match = form.match(_line_at(low, end))
        if match is None:
            continue
        if kind == "mark":
            out.add(kind)
        elif kind == "token":
            counts[kind] += 1
        else:
            roots.setdefault(match[1])
    # names spelt out from the global root again and again, or a lexer's table of numbered tokens: nobody types these
    spelt = counts["qualified"]
    if counts["token"] >= 3 or spelt >= 3 and spelt > 0.1 * sum(1 for x in text.splitlines() if x.strip()):
        out.add("mark")
    return out, list(roots)


def _short(text: str) -> bool:
    """Code put together on few, very long lines, with hardly any white space."""
    lines = [x for x in text.splitlines() if x.strip()]
    if not lines:
        return False
    longest = max(map(len, lines))
    if longest < 400:
        return False
    dense = max(lines, key=len)
    code = _STRINGS.sub('""', dense)
    return len(code) >= 400 and code.count(" ") < 0.12 * len(code) and sum(code.count(c) for c in ";{}(),") > 0.08 * len(code) and not _table(dense)


def _table(text: str) -> bool:
    """Mostly numbers and separators."""
    return len(text) > 200 and sum(c.isdigit() or c in " ,{}[]().-+xXABCDEFabcdef;\t\r\n" for c in text) > 0.85 * len(text) and len(_WORD.findall(_NUMBER.sub("", text))) * 8 < len(_NUMBER.findall(text)) * 2


def data_share(text: str) -> tuple[float, int]:
    """The share of a text's visible characters in numbers and strings that hold no prose, code or key block, and how many such characters there are."""
    text = _COMMENT.sub("", text) if '"' not in text else _KEY_BLOCK.sub("", text)
    literal = 0
    rest = []
    last = 0
    for m in _STRINGS.finditer(text):
        rest.append(text[last : m.start()])
        last = m.end()
        inside = m[0]
        if len(inside) >= 40 and (inside.count("\n") > 3 or inside.count(" ") * 20 < len(inside)):
            literal += len(re.sub(r"\s+", "", inside))
    rest.append(text[last:])
    outside = " ".join(rest)
    numbers = sum(len(m) for m in _NUMBER.findall(outside)) + outside.count(",")
    total = len(re.sub(r"\s+", "", text))
    return ((literal + numbers) / total if total else 0.0), literal + numbers


def classify(path: str | None, text: str | None) -> tuple[str | None, str | None]:
    """Why a file is not hand-written, as far as the file itself tells: generated, minified, vendored, data or lockfile; null for hand-written and configuration files, and for null texts. And the root of its first namespace."""
    if text is None:
        return None, None
    by_path = _from_path(path or "")
    if by_path == "configuration":
        return None, None
    head = header(text)
    signs = set() if by_path else header_signs(head)
    marks, roots = code_signs(text)
    root = roots[0] if roots else None
    if by_path:
        return by_path, root
    if "generated" in signs or marks:
        return "generated", root
    if "banner" in signs:
        return "vendored", root
    if _short(text):
        return "minified", root
    share, size = data_share(text)
    if share > 0.6 and size > 600:
        return "data", root
    return None, root


def classify_column(path: Column, text: Column) -> Column:
    """:func:`classify` over columns."""

    @F.pandas_udf("reason string, root string")
    def reason(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for paths, texts in parts:
            yield pd.DataFrame([classify(p, t) for p, t in zip(paths, texts)], columns=["reason", "root"], dtype=object)

    return reason(path, text)


def third_party(judged: DataFrame) -> DataFrame:
    """Namespaces (root) of third parties, each repository without its own main one: (repository, root).

    Of a third party's namespace more files are told by path or banner than are not told at all, and those lie in more than one
    repository. One row for each repository and namespace is all that is counted with.
    """
    seen = judged.filter(F.col("root").isNotNull() & (F.col("reason").isNull() | (F.col("reason") == "vendored")))
    told = F.col("reason").isNotNull()
    counted = staged(seen.groupBy("repository", "root").agg(F.count_if(told).alias("told"), F.count_if(~told).alias("untold")), "roots")
    place = F.xxhash64("repository")
    known = counted.groupBy("root").agg(F.sum("told").alias("told"), F.sum("untold").alias("untold"), F.min(F.when(F.col("told") > 0, place)).alias("a"), F.max(F.when(F.col("told") > 0, place)).alias("b"))
    known = known.filter((F.col("told") > F.col("untold")) & (F.col("a") != F.col("b"))).select("root")
    main = counted.filter("untold > 0").groupBy("repository").agg(F.max_by("root", F.struct("untold", "root")).alias("main"))
    here = counted.join(known, "root", "left_semi").join(main.withColumnRenamed("repository", "r"), F.col("repository").eqNullSafe(F.col("r")), "left")
    return here.filter(F.col("main").isNull() | (F.col("main") != F.col("root"))).select("repository", "root")


def not_handwritten(files: DataFrame, key: str, path: str, text: str, repository: str) -> DataFrame:
    """The files that nobody wrote by hand: (key, reason).

    A null or empty text, a null path or a null repository lack only the signs that they would bear; a null text is no case. One row
    for each row of ``files``, repeated rows included; other columns are ignored. An empty table gives an empty table.
    """
    judged = files.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(repository).alias("repository"), classify_column(F.col(path), F.col(text)).alias("v"))
    judged = staged(judged.select("key", "repository", "v.reason", "v.root"), "judged")
    # a namespace may have a third of all files: its files are spread over the repositories they lie in
    copies = third_party(judged).select(F.col("repository").alias("r"), F.col("root").alias("n"))
    untold = judged.filter(F.col("reason").isNull() & F.col("root").isNotNull())
    copied = untold.join(copies, (F.col("root") == F.col("n")) & F.col("repository").eqNullSafe(F.col("r")), "left_semi").withColumn("reason", F.lit("vendored"))
    return judged.filter(F.col("reason").isNotNull()).unionByName(copied).select(F.col("key").alias(key), "reason")
