"""Scalar functions as expressions over columns; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark a text or a name as secret-like.
SECRET_MARKERS = ("password", "secret", "token", "apikey", "connectionstring", "credential")
UNSAFE_NAMES = ("secret", "password", "token", "connectionstring")
REDACTED_PREVIEW = "[redacted secret-like evidence preview]"
#: What trimming takes away.
SPACE = r"[\s\u0085\p{Z}]"


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def trimmed(text: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(F.regexp_replace(_c(text), f"^{SPACE}+", ""), f"{SPACE}+$", "")


def blank_to_null(text: Column | str) -> Column:
    """Trimmed text; null for null, empty and blank."""
    return F.nullif(trimmed(text), F.lit(""))


def contains_ci(text: Column | str, part: Column | str) -> Column:
    """Whether a text contains a literal part, case ignored; false for a null text."""
    part = F.lit(part.lower()) if isinstance(part, str) else F.lower(part)
    return F.coalesce(F.contains(F.lower(_c(text)), part), F.lit(False))


def equals_ci(text: Column | str, value: str) -> Column:
    """Whether a text equals a trimmed value, case ignored; false for a null text."""
    return F.coalesce(F.lower(_c(text)) == value.strip().lower(), F.lit(False))


def any_contains_ci(texts: Column | str, part: str) -> Column:
    """Whether any member of an array contains a part, case ignored."""
    return F.coalesce(F.exists(_c(texts), lambda t: contains_ci(t, part)), F.lit(False))


def wildcard(text: Column, pattern: str) -> Column:
    """Whether the whole text matches a pattern of ``*`` and ``?``, case-sensitive; neither matches a line feed. At most 256 characters."""
    if len(pattern) > 256:
        raise ValueError("PatternTooLong")
    special = set("\\^$.|?*+()[]{}")
    body = "".join(".*" if ch == "*" else "." if ch == "?" else "\\" + ch if ch in special else ch for ch in pattern)
    return text.rlike(f"^{body}$")


def metadata_variant(metadata: Column | str) -> Column:
    """A JSON object parsed once for the functions below; null if it is none."""
    return F.try_parse_json(_c(metadata))


def _member(variant: Column, key: str, kind: str) -> Column:
    # only quotes in single form let dots be part of a name
    return F.try_variant_get(variant, f"$['{key}']", kind)


def metadata_text(metadata: Column | str, *keys: str) -> Column:
    """The first of several members that is a JSON string; numbers and truth values are none."""
    return variant_text(metadata_variant(metadata), *keys)


def variant_text(variant: Column, *keys: str) -> Column:
    """:func:`metadata_text` of an object that is parsed already; where many members are read, the parsed object should be a column of its own."""
    strict = [F.when(F.schema_of_variant(_member(variant, k, "variant")) == "STRING", _member(variant, k, "string")) for k in keys]
    return F.coalesce(*strict) if len(strict) > 1 else strict[0]


def metadata_flag(metadata: Column | str, key: str) -> Column:
    """Whether a member is JSON true or the text true, case ignored; missing counts as false."""
    return F.coalesce(F.lower(F.get_json_object(_c(metadata), f"$['{key}']")) == "true", F.lit(False))


def metadata_int(metadata: Column | str, key: str) -> Column:
    """A member as a whole number; null if it is none."""
    return F.get_json_object(_c(metadata), f"$['{key}']").try_cast("int")


def one_of(value: Column, cases: Sequence[tuple[str, str]], otherwise: str | None) -> Column:
    """The result of the first literal part that the value contains, case ignored."""
    out = F.lit(otherwise)
    for part, result in reversed(cases):
        out = F.when(contains_ci(value, part), result).otherwise(out)
    return out


def infer_namespace(qualified: Column | str) -> Column:
    """A dotted name without its last two parts; null with fewer than three."""
    parts = name_parts(qualified)
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0))), "."))


def infer_container(qualified: Column | str) -> Column:
    """The last part but one of a dotted name; null with fewer than two."""
    parts = name_parts(qualified)
    return F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(-2)))


def name_parts(qualified: Column | str) -> Column:
    """The parts of a dotted name, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(_c(qualified), r"\."), trimmed), lambda p: p != "")


def bounded(text: Column | str, length: int) -> Column:
    """At most ``length`` characters of a text."""
    return F.substring(_c(text), 1, length)


def secret_like(text: Column | str) -> Column:
    """Whether a text holds one of the markers, case ignored; false for null."""
    low = F.lower(_c(text))
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in SECRET_MARKERS]), F.lit(False))


def preview(text: Column | str, length: int) -> Column:
    """A bounded preview, replaced as a whole where the text is secret-like; null for null and empty."""
    return F.when(F.coalesce(_c(text), F.lit("")) != "", F.when(secret_like(text), REDACTED_PREVIEW).otherwise(bounded(text, length)))


def safe_host(value: Column | str) -> Column:
    """The host of an address; of other text what comes before ``/``, ``?`` or ``#``, unless it holds an at sign or is secret-like."""
    text = blank_to_null(value)
    host = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    plain = F.regexp_extract(text, r"^([^/?#]*)", 1)
    return F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), host).when(F.contains(plain, F.lit("@")) | secret_like(plain), None).otherwise(plain)


def relative_path(path: Column | str) -> Column:
    """A repository-relative path in its one form: forward slashes, no doubled ones, none at the ends, no leading ``./``; null for rooted paths."""
    text = F.regexp_replace(trimmed(path), r"\\", "/")
    rooted = text.rlike(r"^(?:/|[A-Za-z]:)")
    text = F.regexp_replace(F.regexp_replace(text, r"^(?:\./)+", ""), "/{2,}", "/")
    return F.when(~rooted, F.regexp_replace(text, "^/+|/+$", ""))


def file_name(path: Column | str) -> Column:
    """What comes after the last slash of either kind."""
    return F.regexp_extract(_c(path), r"([^/\\]*)$", 1)


def stable_key(prefix: str, payload: Column | str) -> Column:
    return F.concat(F.lit(prefix + "://"), trimmed(payload))


def fingerprint(category: str, fields: Mapping[str, Column], metadata: Column) -> Column:
    """``sha256:`` and the hash of the canonical text: category, the fields in name order, the metadata; null is spelt ``<null>``."""
    lines = [F.lit(f"category={category}\n")]
    lines += [F.concat(F.lit(f"field:{name}="), F.coalesce(fields[name].cast("string"), F.lit("<null>")), F.lit("\n")) for name in sorted(fields)]
    lines.append(F.concat(F.lit("metadata="), F.coalesce(metadata, F.lit("<null>")), F.lit("\n")))
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(*lines), 256))


def snippet(text: Column | str, length: int = 160) -> Column:
    """White space to single spaces, trimmed, bounded."""
    return bounded(trimmed(F.regexp_replace(_c(text), r"\s+", " ")), length)


def safe_metadata_name(name: Column) -> Column:
    """Whether a metadata name may be shown: it begins with a small letter and holds no secret-like word."""
    low = F.lower(name)
    return name.rlike(r"^\p{Ll}") & ~reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in UNSAFE_NAMES])


def safe_metadata(metadata: Column | str) -> Column:
    """The members of a JSON object of texts whose names may be shown, as a map."""
    return F.map_filter(F.from_json(_c(metadata), "map<string,string>"), lambda k, v: safe_metadata_name(k))


def string_or_list(metadata: Column | str, key: str) -> Column:
    """A member that is a text or an array of texts, as an array; blanks dropped, trimmed."""
    raw = F.get_json_object(_c(metadata), f"$['{key}']")
    many = F.from_json(raw, "array<string>")
    values = F.when(raw.rlike(r"^\s*\["), many).when(raw.isNotNull(), F.array(raw)).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(values, trimmed), lambda v: v != "")


# ---- SQL texts ----------------------------------------------------------------------------------------------------------------

# Words that stand after a clause without being a table.
NOT_TABLES = ("AS", "SET", "VALUES", "USING", "WHERE")


def sql_tokens(sql: Column | str) -> Column:
    """Words of a statement, parted by white space and punctuation, without brackets and quotes around them."""
    words = F.transform(F.split(_c(sql), r"[ \r\n\t(),;=]"), lambda w: F.regexp_replace(w, r"^[\[\]\"'`]+|[\[\]\"'`]+$", ""))
    return F.filter(words, lambda w: F.trim(w) != "")


def sql_verb(tokens: Column) -> Column:
    """The first word in capitals; null if there is none."""
    return F.upper(F.try_element_at(tokens, F.lit(1)))


def _table_at(tokens: Column, place: Column) -> Column:
    """The table at a place (from 1), with the default schema dbo; null for a place without one."""
    word = F.when(place > 0, F.try_element_at(tokens, place))
    bare = F.filter(F.transform(F.split(word, r"\."), lambda p: F.regexp_replace(p, r"^[\[\]\"'`]+|[\[\]\"'`]+$", "")), lambda p: p != "")
    name = F.when(F.size(bare) == 1, F.concat(F.lit("dbo."), F.element_at(bare, 1))).when(F.size(bare) > 1, F.concat_ws(".", F.try_element_at(bare, F.lit(-2)), F.try_element_at(bare, F.lit(-1))))
    return F.when(word.isNotNull() & ~F.upper(word).isin(*NOT_TABLES), name)


def _after(tokens: Column, keyword: str) -> Column:
    """The place after a keyword's first occurrence; 0 if there is none."""
    at = F.array_position(F.transform(tokens, F.upper), keyword)
    return F.when((at > 0) & (at < F.size(tokens)), at.cast("int") + 1).otherwise(F.lit(0))


def sql_tables(tokens: Column) -> Column:
    """The tables that a simple statement touches: distinct, in order of appearance of their clauses."""
    verb = sql_verb(tokens)
    some = lambda *t: F.array_distinct(F.array_compact(F.array(*t)))
    after = lambda word: _table_at(tokens, _after(tokens, word))
    return (
        F.when(verb == "SELECT", some(after("FROM"), after("JOIN"))).when(verb == "INSERT", some(after("INTO"))).when(verb == "UPDATE", some(_table_at(tokens, F.lit(2)))).when(verb == "DELETE", some(after("FROM")))
        .when(verb == "MERGE", some(_table_at(tokens, F.lit(2)), after("USING"))).when(verb.isin("CREATE", "ALTER", "DROP"), some(after("TABLE"))).otherwise(F.array().cast("array<string>"))
    )


def redact_sql(sql: Column | str) -> Column:
    """Passwords of connection texts, whatever they are, and the administrator's name blanked."""
    text = F.regexp_replace(_c(sql), r"(?i)password\s*=\s*('[^']*'|[^;\s'\"]*)", "Credential=[REDACTED]")
    return F.regexp_replace(text, r"(?i)(user id)=sa\b", "$1=[REDACTED_USER]")
