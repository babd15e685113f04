"""Endpoints and API calls found by patterns in text, and their links across languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import percent, url_path
from ..operators.patterns import every_pair
from .binding import graph, load
from .registry import query

# What an endpoint's or a call's text says: (language, path group, method, pattern). The method is the number of a group, a
# word, or a word and the pattern that states another inside the text; a text may state several.
ENDPOINTS = (
    ("python", 1, ("GET", r"methods\s*=\s*[\[(]([^\])]*)"), r"@\w+\.route\s*\(\s*['\"]([^'\"]+)['\"][^\n]*"),
    ("python", 2, 1, r"@\w+\.(get|post|put|delete|patch)\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("go", 1, "ANY", r"\.Handle(?:Func)?\s*\(\s*[\"`]([^\"`]+)[\"`]\s*,"),
    ("go", 2, 1, r"\.(GET|POST|PUT|DELETE|PATCH)\s*\(\s*[\"`]([^\"`]+)[\"`]\s*,"),
    ("typescript", 2, 1, r"(?:app|router)\.(get|post|put|delete|patch)\s*\(\s*['\"`]([^'\"`]+)['\"`]"),
    ("typescript", 2, 1, r"@(Get|Post|Put|Delete|Patch)\s*\(\s*['\"`]([^'\"`]*)['\"`]"),
)
CALLS = (
    ("python", 2, 1, r"requests\.(get|post|put|delete|patch)\s*\(\s*f?['\"]([^'\"]+)['\"]"),
    ("go", 2, 1, r"http\.(Get|Post|Put|Delete|Head)\s*\(\s*[\"`]([^\"`]+)[\"`]"),
    ("typescript", 1, ("GET", r"\bmethod\s*:\s*(['\"`]\w+)"), r"\bfetch\s*\(\s*['\"`]([^'\"`]+)['\"`](?:\s*,\s*\{[^}]*\})?"),
    ("typescript", 2, 1, r"axios\.(get|post|put|delete|patch)\s*\(\s*['\"`]([^'\"`]+)['\"`]"),
)


def _found(rules: tuple, language: Column, content: Column, name: str) -> Column:
    """Array of struct(method, path) for the rules of the row's language; null content has none."""
    empty = F.array().cast(f"array<struct<method:string,{name}:string>>")

    def methods(hit, method, pattern):
        if isinstance(method, int):
            return F.array(F.upper(F.regexp_extract(hit, pattern, method)))
        word, stated = (method, None) if isinstance(method, str) else method
        if stated is None:
            return F.array(F.lit(word))
        found = F.regexp_extract_all(F.regexp_extract(hit, stated, 1), F.lit(r"\w+"), 0)
        return F.when(F.size(found) > 0, F.transform(found, F.upper)).otherwise(F.array(F.lit(word)))

    def each(path, method, pattern):
        return lambda h: F.transform(methods(h, method, pattern), lambda m: F.struct(m.alias("method"), F.regexp_extract(h, pattern, path).alias(name)))

    parts = []
    for lang, path, method, pattern in rules:
        same = language.isin("typescript", "javascript") if lang == "typescript" else language == lang
        hits = F.flatten(F.transform(F.regexp_extract_all(content, F.lit(pattern), 0), each(path, method, pattern)))
        parts.append(F.when(same & content.isNotNull(), hits).otherwise(empty))
    return F.concat(*parts)


def endpoints(files: DataFrame) -> DataFrame:
    """(method, path, language, file) of files(path, language, content)."""
    return files.select(F.explode(_found(ENDPOINTS, F.col("language"), F.col("content"), "p")).alias("e"), "language", F.col("path").alias("file")).select("e.method", F.col("e.p").alias("path"), "language", "file")


def api_calls(files: DataFrame) -> DataFrame:
    """(method, target, language, file)."""
    return files.select(F.explode(_found(CALLS, F.col("language"), F.col("content"), "t")).alias("e"), "language", F.col("path").alias("file")).select("e.method", F.col("e.t").alias("target"), "language", "file")


def call_path(target: Column) -> Column:
    """The path of a call's target, without host, query and fragment."""
    return url_path(target)


def endpoint_key(path: Column) -> Column:
    """The path of an endpoint as it is sought in calls: without a slash at its end; the root is one slash."""
    key = F.rtrim(url_path(path), F.lit("/"))
    return F.when(key == "", "/").otherwise(key)


#: Runs of so many characters index the endpoints' paths.
GRAM = 3


def _grams(text: Column, sizes) -> Column:
    """The distinct runs of a text of each of the sizes."""
    runs = lambda n: F.when(F.char_length(text) >= n, F.transform(F.sequence(F.lit(1), F.char_length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[runs(n) for n in sizes]))


def path_matches(calls: DataFrame, ends: DataFrame) -> DataFrame:
    """calls(target, ...) with every one of ends(path, ...) whose path stands anywhere in the target's: the whole, its end or inside.

    Each distinct endpoint path is posted under one run of GRAM characters, the
    one that fewest endpoint paths have (shorter paths under themselves). A
    call's distinct path is looked up under all its runs, in one equi-join, and
    what is found is compared; so a call meets the endpoints that share a rare
    run with it and not all. A null target or path matches nothing.
    """
    c = calls.withColumn("_path", call_path(F.col("target")))
    e = ends.withColumn("_key", endpoint_key(F.col("path")))
    keys = e.select("_key").where("_key is not null").distinct()
    posted = keys.select("_key", F.explode(F.when(F.char_length("_key") < GRAM, F.array("_key")).otherwise(_grams(F.col("_key"), (GRAM,)))).alias("gram"))
    common = posted.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = posted.join(common, "gram").groupBy("_key").agg(F.min(F.struct("n", "gram")).alias("g")).select("_key", F.col("g.gram").alias("gram"))
    paths = c.select("_path").where("_path is not null").distinct()
    asked = paths.select("_path", F.explode(_grams(F.col("_path"), range(1, GRAM + 1))).alias("gram"))
    found = asked.join(rarest, "gram").where(F.contains("_path", F.col("_key"))).select("_path", "_key")
    return c.join(found, "_path").join(e, "_key").drop("_path", "_key")


def match_paths(calls: DataFrame, ends: DataFrame) -> DataFrame:
    """path_matches() between different languages; calls need target and language, ends path and language, which come back as endpoint_path and so on."""
    e = ends.withColumnsRenamed({x: f"endpoint_{x}" for x in ends.columns if x != "path"}).withColumn("endpoint_path", F.col("path"))
    return path_matches(calls, e).where(F.col("language") != F.col("endpoint_language")).drop("path")


@query("j20_api_links", """
, c as (select page_id, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '') as p, case when page_id % 2 = 0 then 'python' else 'go' end as language from pages),
known as (select unnest(['/en', '/fr', '/de', '/es']) as path)
select page_id, path as endpoint_path from c join known on contains(p, path)""")
def j20(spark, d):
    """Pages' addresses as calls; their language folders as endpoints of another language."""
    calls = load(spark, d, "pages").select("page_id", F.col("url").alias("target"), F.when(F.col("page_id") % 2 == 0, "python").otherwise("go").alias("language"))
    ends = spark.createDataFrame([("/en", "typescript"), ("/fr/", "typescript"), ("/de", "typescript"), ("/es", "typescript"), ("/en", "go")], "path string, language string").where("language = 'typescript'")
    return match_paths(calls, ends).select("page_id", F.rtrim(F.col("endpoint_path"), F.lit("/")).alias("endpoint_path"))


@query("j20_paths_of_pages", r"""
, c as (select page_id, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '') as p from pages),
shown as (select page_id, case when p = '' then '/' else p end as p from c),
cut as (select page_id as endpoint, case page_id % 3 when 0 then p when 1 then substr(p, 1, length(p) - 1) else substr(p, 1 + length(p) // 2) end as path from shown where page_id % 5 = 0),
e as (select endpoint, case when rtrim(path, '/') = '' then '/' else rtrim(path, '/') end as k from cut)
select page_id, endpoint from shown join e on contains(p, k)""")
def j20_pages(spark, d):
    """Pages' addresses as calls; every fifth page's path as an endpoint: the whole, all but its last character, or its second half."""
    pages = load(spark, d, "pages")
    p = url_path(F.col("url"))
    n = F.char_length(p)
    part = F.when(F.col("page_id") % 3 == 0, p).when(F.col("page_id") % 3 == 1, F.substring(p, F.lit(1), n - 1)).otherwise(F.substring(p, (F.floor(n / 2) + 1).cast("int"), n))
    ends = pages.where("page_id % 5 = 0").select(F.col("page_id").alias("endpoint"), part.alias("path"))
    return path_matches(pages.select("page_id", F.col("url").alias("target")), ends).select("page_id", "endpoint")


@query("j21_tests_by_target_name", "select t.id as test_id, f.id as target_id from test t join fn f on f.name = t.test_target where f.language <> t.language")
def j21(spark, d):
    g = graph(spark, d)
    t = g.scan("TestFunction").where("test_target <> ''").select(F.col("id").alias("test_id"), F.col("test_target").alias("name"), F.col("language").alias("tl"))
    f = g.scan("Function").where(~F.col("is_test")).select(F.col("id").alias("target_id"), "name", "language")
    return every_pair(t, f, "name", alike=("tl", "language"), where="language <> tl").select("test_id", "target_id")


@query("j22_tests_api", """
select t.id as test_id, f.id as entity_id from api join test t on t.id = api.src join ep e on e.id = api.dst join fn f on f.file_path = 'src/m' || (split_part(e.id, ':', 2)::int % 5) || '/f' || (split_part(e.id, ':', 2)::int % 5 + 5) || case (split_part(e.id, ':', 2)::int % 5 + 5) % 3 when 0 then '.go' when 1 then '.py' else '.ts' end
where f.language <> t.language and e.signature = 'GET'""")
def j22(spark, d):
    """Tests that call an endpoint, with the functions of the endpoint's file; the file is bound to the endpoint's number."""
    g = graph(spark, d)
    n = F.split_part(F.col("dst_id"), F.lit(":"), F.lit(2)).cast("int") % 5
    bn = n + 5
    ext = F.when(bn % 3 == 0, ".go").when(bn % 3 == 1, ".py").otherwise(".ts")
    calls = g.rel("TESTS_API").select(F.col("src_id").alias("test_id"), "dst_id", F.concat(F.lit("src/m"), n, F.lit("/f"), bn, ext).alias("file_path"))
    get = g.scan("Endpoint").where(F.upper("signature") == "GET").select(F.col("id").alias("dst_id"))
    t = g.scan("TestFunction").select(F.col("id").alias("test_id"), F.col("language").alias("tl"))
    f = g.scan("Function").select(F.col("id").alias("entity_id"), "file_path", "language")
    calls = calls.join(get, "dst_id").join(t, "test_id").select("test_id", "file_path", "tl")
    return every_pair(calls, f, "file_path", alike=("tl", "language"), where="language <> tl").select("test_id", "entity_id")


def analyze_project(files: DataFrame) -> DataFrame:
    """One row: endpoints, calls, matched calls, matched endpoints, and the share of endpoints that are called."""
    ends, calls = endpoints(files), api_calls(files)
    links = match_paths(calls, ends.withColumn("file", F.col("file")))
    a = ends.agg(F.count("*").alias("endpoints"))
    b = calls.agg(F.count("*").alias("api_calls"))
    c = links.agg(F.count("*").alias("links"), F.count_distinct("endpoint_method", "endpoint_path", "endpoint_file").alias("called_endpoints"))
    x = a.crossJoin(b).crossJoin(c)  # one row each
    return x.withColumn("coverage_percentage", F.coalesce(percent(F.col("called_endpoints"), F.col("endpoints")), F.lit(0.0)))


@query("f17_url_paths", r"""
select page_id, case when p = '' then '/' else p end as path from (
  select page_id, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '') as p from pages)""")
def f17(spark, d):
    return load(spark, d, "pages").select("page_id", url_path(F.col("url")).alias("path"))
