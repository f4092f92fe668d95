"""Credentials embedded in source code: finding their lines and blanking them.

Each detection regex is parsed for the trigrams that any match must contain (see :mod:`gneiss.llm.trigrams`). Files are cut into chunks
at line ends; an index from trigrams to chunks is built once over each run of chunks, the formula of each regex is answered from its
postings, and only the chunks that are left are searched. Matches are then judged by their value: placeholders, references to
settings, prose, names and public keys are no credentials. What is blanked is read as the language has it: escapes go as a whole,
doubled quotes of verbatim and Visual Basic literals too, and the holes of an interpolated literal stay.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.trigrams import TrigramIndex, required

#: Characters of a chunk, about; chunks end at line ends and overlap by OVERLAP_LINES that are not blank: as many as the parts of a match can stand on.
CHUNK = 4096
OVERLAP_LINES = 8
#: Characters over which one index is built, about: what a task holds of it.
INDEXED = 4_000_000

_NAME = r"(?:password|passwd|passphrase|pwd|secret|token|api[-_ ]?key|access[-_ ]?key|account[-_ ]?key|auth[-_ ]?key|shared[-_ ]?key|private[-_ ]?key|signing[-_ ]?key|credential)"
_OPEN = r"\s*[@$]{0,3}(?:\"\")?\""
#: The inside of a literal: escapes, doubled quotes, and a backslash before the quote at its end where a backslash is no escape.
_LITERAL = r"(?:[^\"\\\n]|\\.|\"\"|\\(?=\"))+"

# The detection patterns; v is the credential. Those marked quoted need the match to lie in a string, a comment or a configuration file.
PATTERNS = {
    "private key": r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<v>)",
    "named literal": rf"(?i)(?P<n>{_NAME}[\w\-]*)[\"'\])]*(?:\s+as\s+string)?\s*(?:[:=]=?|\?\?|<>|!=){_OPEN}(?P<v>{_LITERAL})\"",
    "single quotes": rf"(?i)(?P<n>{_NAME}[\w\-]*)[\"'\])]*\s*[:=]=?\s*'(?P<v>[^'\n]+)'",
    "short name": rf"(?i)(?<![a-z0-9\-])(?P<n>pass|key)(?:\s+as\s+string)?\s*[:=]=?{_OPEN}(?P<v>{_LITERAL})\"",
    "shortest name": rf"(?i)(?<![\w\-])(?P<n>pw)(?:\s+as\s+string)?\s*[:=]=?{_OPEN}(?P<v>{_LITERAL})\"",
    "plain setting": rf"(?im)^[ \t]*(?:-[ \t]+|export[ \t]+|set[ \t]+)?(?P<n>[\w.\-]*{_NAME}[\w\-]*)[ \t]*[:=][ \t]*(?P<v>[^\s\"'#<>]+)[ \t]*\r?$",
    "in text": r"(?i)(?<![\w\-])(?P<n>password|passwd|pwd|passphrase|accountkey|sharedaccesskey|sharedsecret|secret|token|api_?key)[ \t]*[=:][ \t]*(?P<v>[^\s;\"'<>,]+)",
    "address login": r"(?i)[a-z][a-z0-9+.\-]*://[^\s/:@\"'<>]*:(?P<v>[^\s/@\"'<>]+)@",
    "address signature": r"(?i)[?&;](?:sig|signature|x-amz-signature|access_token|token|apikey|api_key|code)=(?P<v>[a-z0-9%+/_=.\-]{16,})",
    "authorization": r"(?i)\b(?:bearer|basic)[ \t]+(?P<v>[a-z0-9+/_.=~\-]{12,})",
    "login pair": r"(?i)credentials?\s*\(\s*\"[^\"\n]*\"\s*,\s*@?\"(?P<v>[^\"\n]+)\"",
    "named argument": rf"(?i)(?P<n>(?:{_NAME}|authorization|[-_]key)[\w.\-]*)\"\s*,{_OPEN}(?:bearer |basic |token )?(?P<v>[^\"\n]+)\"",
    "encoded": rf"(?i)(?:{_NAME}|[-_]key)[\w\-]*\"\s*[\])]*\s*[,=][^\"\n]*frombase64string\(\s*\"(?P<v>[^\"\n]{{8,}})\"",
    "setting element": rf"(?i)\b(?:key|name)\s*=\s*\"(?P<n>[^\"\n]*{_NAME}[^\"\n]*)\"\s+(?:value|connectionstring)\s*=\s*\"(?P<v>[^\"\n]+)\"",
    "login note": r"(?i)\blogin\b:?[ \t]+[\w.@\-]+[ \t]*/[ \t]*(?P<v>[^\s\"'<>/]+)",
    "signed token": r"\beyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.(?P<v>[A-Za-z0-9_\-]{8,})",
    "live key": r"(?<![A-Za-z0-9])(?P<v>[a-z]{2,6}_live_[A-Za-z0-9]{16,}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{30,}|gho_[A-Za-z0-9]{30,}|ghs_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9\-]{20,})",
}
_QUOTED = frozenset({"in text"})
_SETTINGS = frozenset({"plain setting"})
_IN_LITERALS = frozenset({"in text", "address login", "address signature", "authorization", "named argument"})
_SURE = frozenset({"signed token", "live key", "encoded", "private key"})

# What stands for a credential without being one.
_PLACEHOLDER = re.compile(
    r"^<.*>$|\$\{|\$\(|\#\{|\{\{|^%.*%$|^\{.*\}$|^\[.*\]$|\*{3,}|^x{4,}$|^\.{3,}$|^_+$|^-+$|^(?:null|none|nil|true|false|empty|undefined|todo|tbd|n/?a|redacted|string)$"
    r"|(?:^|[^a-z])(?:your|example|sample|placeholder|changeme|change-me|replace|insert|set-by|dummy|fake)(?:[^a-z]|$)|^(?:vault|env|secret|keyvault|ssm|arn|file|secretref)[:/]",
    re.I,
)
_NOT_A_VALUE = re.compile(r"(?:name|label|id|path|lifetime|minutes|seconds|hours|days|header|field|type|hash|checksum|digest|file|url|uri|endpoint|length|policy|expiry|expires|ttl|count|limit|message|text|title|hint|regex|pattern|format|prefix|issuer|audience|provider|service|store|scheme)s?$", re.I)
_PUBLIC = re.compile(r"public[-_ ]?key", re.I)
#: Names of amounts; numbers are no credentials there.
_AMOUNT = re.compile(r"max|min(?:imum)?[A-Z_\-]|num|tokens$|version|size|retr(?:y|ies)|timeout|age$|attempt|interval|index|port$|lines?$", re.I)
#: What stands for a value that is elsewhere: a parameter, a variable, a call.
_REFERENCE = re.compile(r"^[@$:%?&!*][a-z_][a-z_.]*%?$|^[\w.]+\(", re.I)
_SHORT_NUMBER = re.compile(r"^v?\d+(?:\.\d+)*[a-z%]?$", re.I)
_WORDY = re.compile(r"^[a-zA-Z0-9\s._:/\\,;'!?()\[\]\-]*$")
_HUMP = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_RUN = re.compile(r"[aeiouy]+|[b-df-hj-np-tv-xz]+")
# What the syllables of words begin and end with.
_BEGINNINGS = frozenset("b c d f g h j k l m n p q r s t v w x z bl br ch chr cl cr dr dw fl fr gh gl gn gr kl kn kr ph phr pl pr ps rh sc sch scr sh shr sk sl sm sn sp sph spl spr sq st str sw th thr tr ts tw wh wr".split())
_ENDINGS = frozenset(
    "b c d f g h k l m n p r s t w x z bb cc dd ff gg ll mm nn pp rr ss tt zz bs bt ch chs ck cks cs ct cts dg ds dth ff ft fth fts gh ght ghts gn gs gth ks lb lch ld lds lf lk lks ll lls lm lms lp ls lt lth lts mb mbs mn mp mps mpt mpts ms nc nch nd nds ng ngs ngth ngths "
    "nk nks ns nst nt nth nts nx ph phs ps pt pth pts rb rbs rc rch rd rds rf rg rk rks rl rld rlds rls rm rms rn rns rp rps rs rst rt rth rts rv sh sk sks sm sms sp ss st sts tch th ths ts tz wd wk wks wl wls wn wns ws xt xts".split()
)
# Words that stand after the name of a password without being one.
_LABEL = re.compile(r"pass|secret|token|credential|login|user|account|^(?:required|optional|hidden|visible|enabled|disabled|changed|expired|invalid|incorrect|wrong|missing|unknown|default|forgot|forgotten|confirm|encrypted|protected|plain|masked|nothing|prompt|manual|input|field|value|never|always)$", re.I)
_PASSWORD = re.compile(r"(?:password|passwd|passphrase|pwd|pass|pw)$", re.I)
_GUID = re.compile(r"^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$", re.I)
_JOINED = re.compile(r"\"[ \t]*(?:(?:\+|&[ \t]*_?)[ \t]*\r?\n?[ \t]*|\r?\n[ \t]*(?:\+|&)[ \t]*)[@$]{0,2}\"((?:[^\"\\\n]|\\.|\"\")*)")
_NO_ESCAPES = re.compile(r"\.(?:config|xml|[a-z]+proj|props|targets|html?|xaml|resx|ini|properties|conf|cfg)$")
_COMMENTED = re.compile(r"//|/\*|<!--|^\s*(?:\*|'|#|rem\s)|(?<!\S)'", re.I | re.M)
_ESCAPED = re.compile(r'\\.|"', re.S)
_DOUBLED = re.compile(r'""|"')
_HOLE = re.compile(r"\{\{|\}\}|\{[^{}\n]*\}")
_PART = re.compile(r"[^\s;\"'<>,]*")
_PEM_BODY = re.compile(r"[^\"<]*?(?=-----END |\"|<|\Z)")
SETTINGS_FILE = re.compile(r"\.(?:json|ya?ml|config|xml|ini|toml|env|properties|settings|conf|cfg)$", re.I)


@dataclass(frozen=True)
class Found:
    """A credential: its pattern, the offset where its literal begins, and the spans to blank."""

    pattern: str
    at: int
    spans: tuple[tuple[int, int], ...]


class Detector:
    """The patterns with their needed trigrams."""

    def __init__(self) -> None:
        # patterns that ignore case search a copy in lower case, which the engine does much faster; where that would shift places, they don't
        self.regex = {name: re.compile(p) for name, p in PATTERNS.items()}
        self.plain = {name: re.compile(re.sub(r"^\(\?i(m?)\)", lambda m: "(?m)" if m[1] else "", p)) for name, p in PATTERNS.items() if p.startswith("(?i")}
        self.needs = {name: required(p) for name, p in PATTERNS.items()}
        self.index = TrigramIndex(list(self.needs.values()))

    def candidates(self, low: list[str]) -> dict[str, list[int]]:
        """For each pattern the chunks (in lower case) that can hold a match, from the index over all of them."""
        postings = self.index.postings(low)
        return {name: np.flatnonzero(postings.answer(need)).tolist() for name, need in self.needs.items()}

    def find(self, texts: list[str | None], paths: list[str | None]) -> list[list[Found]]:
        """The credentials of each text, in order, one for each place."""
        found: list[dict[int, Found]] = [{} for _ in texts]
        chunks: list[tuple[int, int, int]] = []
        size = 0
        for i, text in enumerate(texts):
            for start, end in chunk_bounds(text or ""):
                chunks.append((i, start, end))
                size += end - start
                if size >= INDEXED:
                    self._search(chunks, texts, paths, found)
                    chunks, size = [], 0
        self._search(chunks, texts, paths, found)
        return [sorted(x.values(), key=lambda h: h.at) for x in found]

    def _search(self, chunks: list[tuple[int, int, int]], texts: list[str | None], paths: list[str | None], found: list[dict[int, Found]]) -> None:
        low = [texts[i][start:end].lower() for i, start, end in chunks]
        for name, places in self.candidates(low).items():
            exact, plain = self.regex[name], self.plain.get(name)
            for c in places:
                i, start, end = chunks[c]
                path = paths[i] or ""
                if name in _SETTINGS and not SETTINGS_FILE.search(path):
                    continue
                for match in plain.finditer(low[c]) if plain and len(low[c]) == end - start else exact.finditer(texts[i][start:end]):
                    hit = _judge(name, match, start, texts[i], path)
                    if hit and hit.at not in found[i]:
                        found[i][hit.at] = hit


def chunk_bounds(text: str) -> list[tuple[int, int]]:
    """Chunks that cover a text, cut at line ends; each goes on for OVERLAP_LINES that are not blank, and the blank ones between, after the start of the next."""
    bounds, start, n = [], 0, len(text)
    while start < n:
        cut = n if start + CHUNK >= n else text.find("\n", start + CHUNK) + 1 or n
        end, lines = cut, 0
        while end < n and lines < OVERLAP_LINES:
            line, end = end, text.find("\n", end) + 1 or n
            lines += not text[line:end].isspace()
        bounds.append((start, end))
        if end == n:
            break
        start = cut
    return bounds


def _is_word(part: str) -> bool:
    """Whether letters can be said: every run of consonants is an ending of a syllable and a beginning of the next."""
    low = part.lower()
    runs = _RUN.findall(low)
    if not runs or re.search(r"q(?!u)|[aeiouy]{5}", low):
        return False
    for k, run in enumerate(runs):
        if run[0] in "aeiouy":
            continue
        first, last = k == 0, k == len(runs) - 1
        if first and last or not any((run[:i] in _ENDINGS if i else True) and (run[i:] in _BEGINNINGS if i < len(run) else True) for i in ([0] if first else [len(run)] if last else range(len(run) + 1))):
            return False
    return True


def _is_words(value: str) -> bool:
    """Plain words: a name made of them, a short abbreviation, or prose."""
    tokens = [t for t in (t.strip("\"'().,;:!?") for t in re.sub(r"\{[^}]*\}", "", value).split()) if any(c.isalnum() for c in t)]
    if len(value.split()) > 1:  # prose holds numbers and marks as well
        return 2 * sum(t.isdigit() or not re.search(r"\d", t) and _is_words(t) for t in tokens) >= len(tokens)
    if not _WORDY.match(value):
        return False
    letters = re.sub(r"[^a-zA-Z]", "", value)
    if len(letters) <= 3:
        return True
    humps = _HUMP.findall(value)
    said = sum(len(h) for h in humps if len(h) >= 3 and _is_word(h))
    return 2 * said >= len(letters) and (len(letters) < 8 or 3 * len(humps) <= len(letters))


def _is_password(value: str) -> bool:
    """Letters in one case after a name that can only mean a password, and no word that stands there in labels and settings."""
    return value.isalpha() and len(value) >= 6 and (value.islower() or value.isupper()) and not _LABEL.search(value)


def _looks_secret(value: str, named: bool = True) -> bool:
    """Neither a placeholder nor a reference nor plain words; where no name says that it is a credential, also neither short nor an id."""
    if _PLACEHOLDER.search(value):
        return False
    if not named:
        if len(value) < 6 or any(c.isspace() for c in value) or _GUID.match(value):
            return False
        if any(c.isdigit() for c in value):
            return not value.isdigit()
        # without digits: consonants in a row that no word has, or capitals in places where words have none
        if len(value) >= 8 and value.isalpha() and re.search(r"[bcdfghjklmnpqrstvwxz]{5}", value.lower()):
            return True
        turns = sum(a.islower() != b.islower() for a, b in zip(value, value[1:]) if a.isalpha() and b.isalpha())
        return len(value) >= 8 and turns >= 5 and value.isalnum()
    if not any(c.isalnum() for c in value) or _REFERENCE.search(value):
        return False
    if value.isdigit():
        return len(value) >= 4
    if any(c.isspace() for c in value):
        return not _is_words(value)
    if any(c.isdigit() for c in value):
        return len(value) >= 6 or not _SHORT_NUMBER.match(value)
    return not _is_words(value.rstrip(".,;:!?"))


def _kind(text: str, at: int, path: str) -> str:
    """How the literal whose inside begins at a place is written: r(aw), v (quotes doubled), p(lain, without escapes) or e(scapes), and i where it is interpolated."""
    low = path.lower()
    if _NO_ESCAPES.search(low):
        return "p"
    raw = text[at - 3 : at] == '"""' and not low.endswith(".vb")
    begin = at - 3 if raw else at - 1
    first = begin
    while first > 0 and text[first - 1] in "@$":
        first -= 1
    marks = text[first:begin]
    return ("r" if raw else "v" if "@" in marks or low.endswith(".vb") else "e") + ("i" if "$" in marks else "")


def _closing(text: str, at: int, kind: str, stop: int) -> int:
    """The place of the quote that closes a literal; ``stop`` where there is none before."""
    if kind[0] in "rp":
        end = text.find('"' * (3 if kind[0] == "r" else 1), at, stop)
        return stop if end < 0 else end
    for mark in (_DOUBLED if kind[0] == "v" else _ESCAPED).finditer(text, at, stop):
        if len(mark[0]) == 1:
            return mark.start()
    return stop


@lru_cache(maxsize=16)
def _line(text: str, start: int, path: str) -> tuple[list[int], list[int], int]:
    """Where the literals of a line begin and end, and where its comment begins (the line's end if it has none)."""
    stop = text.find("\n", start)
    stop = len(text) if stop < 0 else stop
    begins, ends, at = [], [], start
    while (quote := text.find('"', at, stop)) >= 0:
        at = quote + 1
        if text[quote - 1 : at + 1] == "'\"'" or text[max(quote - 2, 0) : quote] == "'\\":  # the quote as a character
            continue
        if text.startswith('"""', quote) and not path.lower().endswith(".vb"):
            at = quote + 3
        kind = _kind(text, at, path)
        begins.append(at)
        ends.append(_closing(text, at, kind, stop))
        at = ends[-1] + (3 if kind[0] == "r" else 1)
    comment = _COMMENTED.search(text, start, stop)
    return begins, ends, comment.start() if comment else stop


def _inside(text: str, at: int, path: str) -> tuple[int, int] | None:
    """Where the literal around a place begins and ends on its line."""
    begins, ends, _ = _line(text, text.rfind("\n", 0, at) + 1, path)
    i = bisect_right(begins, at) - 1
    return (begins[i], ends[i]) if i >= 0 and at < ends[i] else None


def _in_text(text: str, at: int, path: str) -> bool:
    """Whether a place lies in a string or a comment, judged by its line."""
    return _inside(text, at, path) is not None or _line(text, text.rfind("\n", 0, at) + 1, path)[2] < at


def _without_holes(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for a, b in spans:
        for hole in _HOLE.finditer(text, a, b):
            if len(hole[0]) > 2 and not hole[0].startswith(("{{", "}}")):
                out.append((a, hole.start()))
                a = hole.end()
        out.append((a, b))
    return [(a, b) for a, b in out if a < b]


def _judge(name: str, match: re.Match, start: int, text: str, path: str) -> Found | None:
    if name == "private key":
        at = start + match.start()
        body = start + match.end()
        return Found(name, at, ((body, _PEM_BODY.match(text, body).end()),))
    at, end = start + match.start("v"), start + match.end("v")
    kind = "e"
    if text[at - 1 : at] == '"' and text[end : end + 1] == '"':  # a whole literal
        kind = _kind(text, at, path)
        stop = text.find("\n", at)
        close = _closing(text, at, kind, len(text) if stop < 0 else stop)
        end = close if text[close : close + 1] == '"' else end
    elif name in _IN_LITERALS and (around := _inside(text, at, path)):  # a part of one, which an escape may continue
        kind = _kind(text, around[0], path)
        while end < around[1] and text[end] == '"':
            end = _PART.match(text, end + 1, around[1]).end()
        end = min(end, around[1])
    value = text[at:end]
    spans = [(at, end)]
    if text[end : end + 1] == '"':
        while more := _JOINED.match(text, end):
            value += more[1]
            spans.append(more.span(1))
            end = more.end()
    if kind.endswith("i"):
        spans = _without_holes(text, spans)
        value = "".join(text[a:b] for a, b in spans)
        if not any(c.isalnum() for c in value):
            return None
    named = None
    if "n" in match.re.groupindex:  # the name goes on before the word by which it was found
        first = start + match.start("n")
        while first > 0 and (text[first - 1].isalnum() or text[first - 1] in "_.-"):
            first -= 1
        named = text[first : start + match.end("n")]
    settings = bool(SETTINGS_FILE.search(path))
    if name in _QUOTED and not settings and not _in_text(text, start + match.start(), path):
        return None
    if named and (_NOT_A_VALUE.search(named) or _PUBLIC.search(named)):
        return None
    plain_key = name == "short name" and named.lower().endswith("key")
    if plain_key and (len(value) < 12 or re.search(r"[\s:/\\]", value) and not re.search(r"\d", value)):
        return None
    if name == "address login":
        value = value.strip()
        return Found(name, at, tuple(spans)) if value and not _PLACEHOLDER.search(value) and not value.startswith("{") else None
    if name == "in text":
        value = value.rstrip(").")
    if re.match(r"(?i)bearer |basic ", value):
        value = value.split(" ", 1)[1]
    inner = re.search(r"(?i)://[^\s/:@]*:[^\s/@]+@|(?:password|pwd|accountkey)\s*=", value)
    if inner and name != "in text":
        return None  # the part of it that is one is found by itself
    if name not in _SURE and not _looks_secret(value, not plain_key):
        if not (named and _PASSWORD.search(named) and _is_password(value) and not _PLACEHOLDER.search(value)):
            return None
    if named and _AMOUNT.search(named) and _SHORT_NUMBER.match(value):
        return None
    if name in _SURE and _PLACEHOLDER.search(value):
        return None
    if re.search(r"[({\[]$|^\w+\(", value) and name in ("in text", "plain setting"):
        return None
    return Found(name, at, tuple(spans))


@lru_cache(maxsize=1)
def detector() -> Detector:
    return Detector()


def line_of(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def blanked(text: str, found: list[Found]) -> str:
    """The text with the credentials overwritten: all characters of them but line ends become x, so that lengths, lines and all code around stay."""
    if not found:
        return text
    out = list(text)
    for hit in found:
        for a, b in hit.spans:
            for i in range(a, b):
                if out[i] not in "\r\n":
                    out[i] = "x"
    return "".join(out)


def secrets_column(path: Column, text: Column) -> Column:
    """For each text an array of (line_no, pattern), one for each line on which a credential begins; empty for null and empty texts."""

    @F.pandas_udf("array<struct<line_no:int,pattern:string>>")
    def lines(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for paths, texts in parts:
            out = []
            for text, hits in zip(texts, detector().find(texts.tolist(), paths.tolist())):
                once: dict[int, str] = {}
                for hit in hits:
                    once.setdefault(line_of(text, hit.at), hit.pattern)
                out.append([{"line_no": n, "pattern": p} for n, p in once.items()])
            yield pd.Series(out, dtype=object)

    return lines(path, text)


def redacted_column(path: Column, text: Column) -> Column:
    """The texts with their credentials blanked; null for null."""

    @F.pandas_udf("string")
    def clean(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for paths, texts in parts:
            yield pd.Series([None if t is None else blanked(t, hits) for t, hits in zip(texts, detector().find(texts.tolist(), paths.tolist()))], dtype=object)

    return clean(path, text)


def find_secrets(files: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """One row for each line of a file on which a credential begins: (key, line_no, pattern).

    Lines are parted by line feeds and counted from 1. Null and empty texts have none; a null path counts as source code. Repeated
    rows are searched each; other columns are ignored.
    """
    rows = files.filter(F.col(text).isNotNull()).select(F.col(key), F.explode(secrets_column(F.col(path), F.col(text))).alias("hit"))
    return rows.select(key, "hit.line_no", "hit.pattern")
