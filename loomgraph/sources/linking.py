"""From extracted references to edges of the graph: places, exported names, endpoints.

An extractor writes what stands in the text: an element's name, a decorator's, a
URL, a module's path. Here these become references that resolution can follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import test_rules as T
from ..functions.scalars import dirname
from .folders import staged

#: The label of the node that stands where an edge of a type was read.
AT_PLACE = {"RENDERS_JSX": ("JSXElement",), "CALLS_API": ("APICall",), "HAS_PROPS": ("Property", "Prop"), "USES_MIDDLEWARE": ("Middleware",), "DECORATES": ("Decorator",)}
#: Of these the name may be defined in the tree as well: then an edge to the definition is added.
DEFINED = ("RENDERS_JSX", "USES_MIDDLEWARE")


#: Edges that are resolved from the end that names the other, and what they are the other way round.
TURNED = {"DECORATED_BY": ("DECORATES",), "EXPOSED_BY": ("EXPOSES_ENDPOINT", "HANDLES_ROUTE")}


def placed(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """raw with the references of AT_PLACE's types pointing to the node at their place, a decorator's edge turned to begin at its mark.

    Where no node stands there the reference is left. Edges to the definitions of
    components, middleware, decorators and handlers are added; the column
    optional tells them, since names of other packages aren't in the tree and
    nothing is lost with them.
    """
    label = F.create_map(*[F.lit(x) for t, labels in AT_PLACE.items() for k in labels for x in (f"{t} {k}", True)])
    kinds = sorted({k for labels in AT_PLACE.values() for k in labels})
    there = nodes.where(F.col("label").isin(*kinds)).select("file_path", "start_byte", F.col("label").alias("_label"), F.col("name").alias("_name"), F.col("id").alias("_at"))
    found = raw.where(F.col("type").isin(*AT_PLACE)).join(there, ["file_path", "start_byte"]).where(F.try_element_at(label, F.concat("type", F.lit(" "), "_label")))
    # a call's element is named by its function; the others by the reference, an element perhaps with what is before its dot
    found = found.where((F.col("type") == "CALLS_API") | (F.col("_name") == F.col("dst_ref")) | F.endswith("_name", F.concat(F.lit("."), "dst_ref")))
    sought = F.coalesce(F.col("type").isin(*AT_PLACE), F.lit(False))
    joined = raw.where(sought).join(found.groupBy("id").agg(F.min("_at").alias("_at")), "id", "left")
    turned = (F.col("type") == "DECORATES") & F.col("_at").isNotNull()
    out = joined.withColumns({"dst_ref": F.when(turned, F.col("src_id")).otherwise(F.coalesce("_at", "dst_ref")), "src_id": F.when(turned, F.col("_at")).otherwise(F.col("src_id"))})
    more = lambda df, kind, **columns: df.withColumns({"id": F.concat(F.lit(f"{kind}:"), "id"), **columns}).select(*raw.columns, F.lit(True).alias("optional"))
    definitions = more(joined.where(F.col("type").isin(*DEFINED) & F.col("_at").isNotNull()), "d")
    decorators = more(raw.where("type = 'DECORATES'"), "d", type=F.lit("DECORATED_BY"))
    handlers = more(raw.where("type = 'EXPOSES_ENDPOINT' and props['handler'] is not null"), "h", type=F.lit("EXPOSED_BY"), src_id=F.col("dst_ref"), dst_ref=F.col("props")["handler"])
    out = out.select(*raw.columns).unionByName(raw.where(~sought)).withColumn("optional", F.lit(False))
    return out.unionByName(definitions).unionByName(decorators).unionByName(handlers)


def turned(resolved: DataFrame) -> DataFrame:
    """resolved edges with those of TURNED the right way round; only what the schema allows."""
    kinds = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in TURNED.items() for x in pair])
    back = resolved.where(F.col("type").isin(*TURNED)).withColumn("type", F.explode(kinds[F.col("type")]))
    ends = {"src_id": "dst_id", "dst_id": "src_id", "src_label": "dst_label", "dst_label": "src_label"}
    back = back.select(*[F.concat("id", F.lit(":"), "type").alias("id") if c == "id" else F.col(ends.get(c, c)).alias(c) for c in resolved.columns])
    return resolved.where(~F.col("type").isin(*TURNED)).unionByName(back)


def _module_path(folder: Column, module: Column) -> Column:
    """The relative path of a TypeScript module named from a folder: . stays, .. goes up."""
    parts = F.concat(F.filter(F.split(F.when(folder == ".", "").otherwise(F.coalesce(folder, F.lit(""))), "/"), lambda x: x != ""), F.split(module, "/"))
    seen = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x.isin(".", ""), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.array_join(seen, "/")


def modules(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, module, to) of asked(file_path, module): the file of the tree that a relative TypeScript path names, with a known extension or as a folder's index."""
    ends = F.array(*[F.lit(x) for x in ("", *T.EXTENSIONS[2:], *(f"/index{x}" for x in T.EXTENSIONS[2:]))])
    a = asked.where("module like '.%'").distinct().withColumn("_p", _module_path(dirname(F.col("file_path")), F.col("module")))
    a = a.select("file_path", "module", F.posexplode(ends).alias("rank", "end"), "_p").select("file_path", "module", "rank", F.concat("_p", "end").alias("path"))
    found = a.join(files.select(F.col("file_path").alias("path")), "path")
    return found.groupBy("file_path", "module").agg(F.min(F.struct("rank", "path")).alias("f")).select("file_path", "module", F.col("f.path").alias("to"))


def _listed(text: Column) -> Column:
    """The (name, alias) pairs of a list such as a, b as c."""
    word = lambda x, k: F.regexp_extract(x, r"^(?:type\s+)?(\S+?)(?:\s+as\s+(\S+))?$", k)
    items = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(items, lambda x: F.struct(word(x, 1).alias("name"), F.when(word(x, 2) != "", word(x, 2)).otherwise(word(x, 1)).alias("alias")))


EXPORTED = ("Function", "Class", "Interface", "Type", "Enum", "Variable", "Namespace")


def exported(nodes: DataFrame, raw: DataFrame) -> DataFrame:
    """(file_path, name, id): what each TypeScript or JavaScript file exports, through any chain of re-exports.

    A file's own declarations and its lists of names come first, then what it
    names from others, under the new name, then what a star gives; a name that
    the file states itself isn't taken from a star, and a star doesn't give the
    default. The work goes by rounds over what is new only, each written; they
    are as many as the longest chain, and end with circles too, since a name of
    a file is taken once.
    """
    ts = nodes.where("language in ('typescript', 'javascript')")
    files = ts.where("label = 'File'").select("file_path")
    top = ts.where(F.col("label").isin(*EXPORTED))
    own = top.where("is_exported").select("file_path", F.when(F.col("props")["default"] == "True", "default").otherwise(F.col("name")).alias("name"), "id")
    own = own.unionByName(top.where("is_exported and props['default'] = 'True'").select("file_path", "name", "id"))
    lists = ts.where("label = 'Export' and props['re_export'] is null").select("file_path", F.when(F.col("props")["default"] == "True", "default").otherwise(F.col("name")).alias("name"), F.coalesce(F.col("props")["local"], "name").alias("local"))
    declared = top.groupBy("file_path", F.col("name").alias("local")).agg(F.min_by("id", F.struct("start_byte", "id")).alias("id"))
    own = own.unionByName(lists.join(declared, ["file_path", "local"]).select("file_path", "name", "id"))
    own = own.groupBy("file_path", "name").agg(F.min("id").alias("id"))

    again = raw.where("type = 'RE_EXPORTS'").select("file_path", F.col("dst_ref").alias("module"), F.trim(F.col("props")["export_name"]).alias("what"))
    again = again.join(modules(again.select("file_path", "module"), files), ["file_path", "module"])
    # the names of an imported list may be exported again in a list
    taken = ts.where("label = 'Import'").select("file_path", F.col("props")["path"].alias("module"), F.explode(_listed(F.regexp_extract("signature", r"\{([^}]*)\}", 1))).alias("x")).select("file_path", "module", F.col("x.name").alias("source"), F.col("x.alias").alias("local"))
    passed = taken.join(lists, ["file_path", "local"]).join(modules(taken.select("file_path", "module"), files), ["file_path", "module"]).select("file_path", "name", "to", "source")
    named = again.where("what not like '*%'").select("file_path", "to", F.explode(_listed(F.col("what"))).alias("x")).select("file_path", F.col("x.alias").alias("name"), "to", F.col("x.name").alias("source")).unionByName(passed.select("file_path", "name", "to", "source"))
    named = staged(named.distinct(), "named")
    stars = staged(again.where("what = '*'").select("file_path", "to").distinct(), "stars")
    stated = own.select("file_path", "name").unionByName(named.select("file_path", "name")).distinct()

    seen = new = staged(own, "exports")
    while not new.isEmpty():
        by_name = new.select(F.col("file_path").alias("to"), F.col("name").alias("source"), "id").join(named, ["to", "source"]).select("file_path", "name", "id")
        by_star = new.where("name <> 'default'").select(F.col("file_path").alias("to"), "name", "id").join(stars, "to").select("file_path", "name", "id").join(stated, ["file_path", "name"], "left_anti")
        more = by_name.unionByName(by_star).groupBy("file_path", "name").agg(F.min("id").alias("id"))
        new = staged(more.join(seen, ["file_path", "name"], "left_anti").select("file_path", "name", "id"), "exports")
        seen = seen.unionByName(new)
    return seen


def bindings(nodes: DataFrame, raw: DataFrame, exports: DataFrame | None = None) -> DataFrame:
    """(file_path, ref, id): what the references of raw that a file's imports bring in stand for, by name, default or namespace.member."""
    exports = exported(nodes, raw) if exports is None else exports
    ts = nodes.where("language in ('typescript', 'javascript')")
    i = ts.where("label = 'Import'").select("file_path", F.col("props")["path"].alias("module"), "signature", F.col("props")["default"].alias("standard"))
    i = i.join(modules(i.select("file_path", "module"), ts.where("label = 'File'").select("file_path")), ["file_path", "module"])
    listed = i.select("file_path", "to", F.explode(_listed(F.regexp_extract("signature", r"\{([^}]*)\}", 1))).alias("x")).select("file_path", "to", F.col("x.alias").alias("local"), F.col("x.name").alias("source"))
    standard = i.where("standard is not null").select("file_path", "to", F.col("standard").alias("local"), F.lit("default").alias("source"))
    spaces = i.select("file_path", "to", F.regexp_extract("signature", r"\*\s+as\s+([\w$]+)", 1).alias("local")).where("local <> ''")
    refs = raw.where("dst_ref is not null").select("file_path", F.col("dst_ref").alias("ref")).distinct()
    whole = refs.withColumn("local", F.col("ref")).join(listed.unionByName(standard), ["file_path", "local"])
    member = refs.where("ref like '%.%'").withColumns({"local": F.substring_index("ref", ".", 1), "source": F.expr("substr(ref, instr(ref, '.') + 1)")}).join(spaces, ["file_path", "local"])
    asked = whole.select("file_path", "ref", "to", "source").unionByName(member.select("file_path", "ref", "to", "source"))
    return asked.join(exports.select(F.col("file_path").alias("to"), F.col("name").alias("source"), "id"), ["to", "source"]).groupBy("file_path", "ref").agg(F.min("id").alias("id"))


def re_exports(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """raw with the modules of RE_EXPORTS as the files that they name; a module outside of the tree stays as it is."""
    files = nodes.where("label = 'File'").select("file_path")
    found = modules(raw.where("type = 'RE_EXPORTS'").select("file_path", F.col("dst_ref").alias("module")), files).withColumnRenamed("module", "dst_ref")
    own = F.col("type").eqNullSafe(F.lit("RE_EXPORTS"))
    return raw.where(own).join(found, ["file_path", "dst_ref"], "left").withColumn("dst_ref", F.coalesce("to", "dst_ref")).select(*raw.columns).unionByName(raw.where(~own))


def endpoint_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src_id, dst_id, src_label, url, method): CALLS_API from the callers of the graph's API calls to the endpoints whose path their URL matches, in any language.

    The methods agree where the endpoint states one.
    """
    from ..plans.crosslang import path_matches

    calls = edges.where("type = 'CALLS_API' and dst_label = 'APICall'").select("src_id", "src_label", F.col("props")["api_endpoint"].alias("target"), F.upper(F.col("props")["http_method"]).alias("method")).where("target <> ''").distinct()
    ends = nodes.where("label = 'Endpoint'").select(F.col("id").alias("dst_id"), F.coalesce(F.col("props")["path"], "name").alias("path"), F.upper(F.coalesce(F.col("props")["http_method"], "signature")).alias("stated"))
    out = path_matches(calls, ends).where("stated is null or stated in ('ANY', 'ALL', '') or stated = method")
    return out.select("src_id", "dst_id", "src_label", F.col("target").alias("url"), "method").distinct()

