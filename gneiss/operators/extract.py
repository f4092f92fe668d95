"""Facts taken from texts alone: project files, configuration, markup and call shapes, without a compiler.

Input is always (file key, path, text). XML is read by the engine's XPath functions, source text by regular expressions; both stay in
the JVM. Only nested JSON of unknown depth is flattened by a vectorised Python function.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.columns import contains_ci, file_name, secret_like

# Words by which a project's kind is known, with their priority; of one priority two kinds contradict each other.
APPLICATION_SIGNS = (
    (1, "Microsoft.NET.Sdk.Web", "Api"), (1, "Microsoft.NET.Sdk.Worker", "Worker"), (1, "Microsoft.NET.Sdk.BlazorWebAssembly", "Blazor"), (2, "<UseWPF>true", "Wpf"), (2, "<UseWindowsForms>true", "WindowsForms"), (2, "<UseMaui>true", "Maui"),
    (2, "Microsoft.NET.Test.Sdk", "Test"), (3, "<OutputType>Exe", "Console"), (3, "<OutputType>WinExe", "Desktop"), (4, "<OutputType>Library", "Library"),
)
HTTP_VERBS = ("Get", "Post", "Put", "Delete", "Patch")


def _local(name: str) -> str:
    """An XPath step that ignores namespaces."""
    return f"*[local-name()='{name}']"


def project_facts(files: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """(key, name, frameworks, old_style, packages, references) of project files (.csproj, .vbproj); texts that are no XML are left out."""
    known = files.filter(F.lower(F.col(path)).rlike(r"\.(?:cs|vb)proj$") & F.col(text).isNotNull())
    xml = F.regexp_replace(F.col(text), r"^﻿", "")
    well_formed = xml.rlike(r"(?s)^\s*(?:<\?xml.*?\?>\s*)?(?:<!--.*?-->\s*)*<Project\b.*</Project>\s*$")
    good = known.filter(well_formed)
    every = lambda p: F.xpath(xml, F.lit(p))
    frameworks = F.split(F.concat_ws(";", every(f"//{_local('TargetFramework')}/text()"), every(f"//{_local('TargetFrameworks')}/text()"), every(f"//{_local('TargetFrameworkVersion')}/text()")), ";")
    return good.select(
        F.col(key), F.regexp_replace(file_name(F.col(path)), r"\.[^.]*$", "").alias("name"), F.filter(frameworks, lambda f: F.trim(f) != "").alias("frameworks"), (~xml.rlike(r"<Project[^>]*\bSdk\s*=")).alias("old_style"),
        F.array_sort(F.array_distinct(every(f"//{_local('PackageReference')}/@Include"))).alias("packages"), F.array_sort(F.array_distinct(F.transform(every(f"//{_local('ProjectReference')}/@Include"), lambda r: F.regexp_replace(r, r"\\", "/")))).alias("references"),
    )


def application_type(text: Column) -> Column:
    """The kind of a project by its signs: the best priority decides, and two kinds of it are Contradictory; none is Unknown."""
    signs = F.array_compact(F.array(*[F.when(contains_ci(text, sign), F.struct(F.lit(p).alias("p"), F.lit(kind).alias("kind"))) for p, sign, kind in APPLICATION_SIGNS]))
    best = F.array_min(F.transform(signs, lambda s: s["p"]))
    kinds = F.array_distinct(F.transform(F.filter(signs, lambda s: s["p"] == best), lambda s: s["kind"]))
    return F.when(F.size(signs) == 0, "Unknown").when(F.size(kinds) > 1, "Contradictory").otherwise(F.try_element_at(kinds, F.lit(1)))


def flatten_json(text: Column) -> Column:
    """The leaves of a JSON object as an array of (key, kind), with names joined by colons and list places as names; null for other texts. Values are not given."""

    @F.pandas_udf("array<struct<key:string,kind:string>>")
    def leaves(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([_leaves(t) for t in part], dtype=object)

    return leaves(text)


def _leaves(text: str | None) -> list[dict] | None:
    try:
        root = json.loads(text.lstrip("﻿")) if text else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(root, dict):
        return None
    out, todo = [], [("", root)]
    while todo:
        name, value = todo.pop()
        items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else None
        if items is not None:
            todo += [(f"{name}:{k}" if name else str(k), v) for k, v in items]
        else:
            kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"
            out.append({"key": name, "kind": kind})
    return sorted(out, key=lambda leaf: leaf["key"])


def configuration_keys(files: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """(key, name, source, secret_like): configuration names of JSON files and of XML settings and connections."""
    low = F.lower(F.col(path))
    from_json = files.filter(low.endswith(".json") & F.col(text).isNotNull()).select(F.col(key), F.explode(flatten_json(F.col(text))).alias("leaf")).select(key, F.col("leaf.key").alias("name"), F.lit("json").alias("source"))
    setting = F.regexp_extract_all(F.col(text), F.lit(r"<add\s[^>]*?\b(?:key|name)\s*=\s*\"([^\"]+)\""), 1)
    from_xml = files.filter(low.endswith(".config") & F.col(text).isNotNull()).select(F.col(key), F.explode(F.array_distinct(setting)).alias("name"), F.lit("xml").alias("source"))
    return from_json.unionByName(from_xml).withColumn("secret_like", secret_like("name"))


def declared_types(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, namespace, kind, name) of C# types by the shape of their declarations, one for each."""
    space = F.regexp_extract(F.col(text), r"(?m)^\s*namespace\s+([\w.]+)", 1)
    shape = r"(?m)^[ \t]*(?:(?:public|internal|private|protected|static|sealed|abstract|partial|readonly|file)\s+)*(class|struct|interface|enum|record)\s+([A-Za-z_]\w*)"
    found = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(shape), 1).alias("kind"), F.regexp_extract_all(F.col(text), F.lit(shape), 2).alias("name"))
    return files.filter(F.col(text).isNotNull()).select(F.col(key), space.alias("namespace"), F.explode(found).alias("d")).select(key, "namespace", "d.kind", "d.name")


def mapped_endpoints(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, method, route) of calls like MapGet("/route", ...)."""
    shape = rf"\.Map({'|'.join(HTTP_VERBS)})\s*\(\s*\"([^\"]*)\""
    found = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(shape), 1).alias("method"), F.regexp_extract_all(F.col(text), F.lit(shape), 2).alias("route"))
    return files.filter(F.col(text).isNotNull()).select(F.col(key), F.explode(found).alias("e")).select(key, F.upper("e.method").alias("method"), F.col("e.route").alias("route"))


def markup_facts(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fact, value): routes, injections, components, links and layouts of Razor; class, bindings, handlers and resources of XAML."""
    shapes = {
        "route": r"(?m)^\s*@page\s+\"([^\"]*)\"", "inject": r"(?m)^\s*@inject\s+([\w.<>]+)", "layout": r"(?m)^\s*@layout\s+([\w.]+)", "component": r"<([A-Z]\w+)[\s/>]", "link": r"\bhref\s*=\s*\"(/[^\"]*)\"", "class": r"\bx:Class\s*=\s*\"([^\"]+)\"",
        "binding": r"\{Binding\s+(?:Path\s*=\s*)?([\w.]+)", "handler": r"\b(?:Click|Loaded|Tapped|SelectionChanged|TextChanged)\s*=\s*\"(\w+)\"", "resource": r"\{(?:Static|Dynamic)Resource\s+([\w.]+)\}",
    }
    parts = [F.transform(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(shape), 1)), _fact(name)) for name, shape in shapes.items()]
    return files.filter(F.col(text).isNotNull()).select(F.col(key), F.explode(F.concat(*parts)).alias("f")).select(key, "f.fact", "f.value")


def _fact(name: str):
    return lambda value: F.struct(F.lit(name).alias("fact"), value.alias("value"))


def mapping_facts(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, table, column) of LINQ to SQL mappings (DBML) and typed data sets (XSD), by their elements."""
    table = r"<Table\s[^>]*?\bName\s*=\s*\"([^\"]+)\""
    column = r"<Column\s[^>]*?\bName\s*=\s*\"([^\"]+)\""
    blocks = F.regexp_extract_all(F.col(text), F.lit(r"(?s)(<Table\s.*?</Table>)"), 1)
    dbml = files.filter(F.col(text).contains("<Table ")).select(F.col(key), F.explode(blocks).alias("b")).select(key, F.lit("dbml").alias("kind"), F.regexp_extract("b", table, 1).alias("table"), F.explode_outer(F.regexp_extract_all("b", F.lit(column), 1)).alias("column"))
    sets = F.regexp_extract_all(F.col(text), F.lit(r"<TableAdapter\s[^>]*?\bName\s*=\s*\"([^\"]+)\""), 1)
    xsd = files.filter(F.col(text).contains("<TableAdapter ")).select(F.col(key), F.lit("xsd").alias("kind"), F.explode(F.array_distinct(sets)).alias("table"), F.lit(None).cast("string").alias("column"))
    return dbml.unionByName(xsd)


def route_key(route: Column) -> Column:
    """A route in the form in which calls and endpoints meet: lower case, no outer slashes or query, parameters as ``{}``."""
    plain = F.regexp_replace(F.lower(F.trim(route)), r"[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(plain, r"^/+|/+$", ""), r"\{[^}/]*\}", "{}")


def match_calls(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Outgoing calls (call, method, route, base_url, config_key) to endpoints (endpoint, method, route, base_url, config_key): (call, state, endpoint).

    Method and route must meet, case ignored. If the call names a base address or configuration key, exactly one endpoint must share one of
    them; if it names neither, there must be only one such endpoint. Else the state is ``unknown``.
    """
    c = calls.select("call", F.lower("method").alias("m"), route_key(F.col("route")).alias("r"), F.lower("base_url").alias("b"), F.lower("config_key").alias("k"))
    e = endpoints.select("endpoint", F.lower("method").alias("m"), route_key(F.col("route")).alias("r"), F.lower("base_url").alias("eb"), F.lower("config_key").alias("ek"))
    owned = F.coalesce(F.col("b") == F.col("eb"), F.lit(False)) | F.coalesce(F.col("k") == F.col("ek"), F.lit(False))
    joined = c.join(e, ["m", "r"], "left").withColumn("owned", owned)
    per = joined.groupBy("call").agg(
        F.count_if("owned").alias("owners"), F.max(F.when(F.col("owned"), F.col("endpoint"))).alias("owner"), F.count("endpoint").alias("routes"), F.max("endpoint").alias("only"), F.bool_and(F.col("b").isNull() & F.col("k").isNull()).alias("free")
    )
    endpoint = F.when(F.col("owners") == 1, F.col("owner")).when(F.col("free") & (F.col("routes") == 1), F.col("only"))
    return per.select("call", F.when(endpoint.isNotNull(), "matched").otherwise("unknown").alias("state"), endpoint.alias("endpoint"))


def recent_runs(runs: DataFrame, limit: int) -> DataFrame:
    """The latest extraction runs: by start descending, then run id."""
    return runs.orderBy(F.col("startedUtc").desc(), "runId").limit(limit)


def first_of(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an explicit order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")
