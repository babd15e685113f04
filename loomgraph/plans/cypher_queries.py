"""Cypher text run by the compiler, a feature or two of the language each, with SQL of its own."""

from __future__ import annotations

from .binding import graph
from .registry import query

CYPHER = {
    # WITH, DISTINCT inside an aggregate, CASE inside SUM, ROUND
    "cy_overall_coverage": (
        """MATCH (code:Function) OPTIONAL MATCH (check:TestFunction)-[:TESTS|COVERS]->(code)
        WITH code, COUNT(DISTINCT check) AS checks
        WITH code.language AS language, SUM(CASE WHEN checks > 0 THEN 1 ELSE 0 END) AS reached, COUNT(code) AS known, MAX(checks) AS most
        RETURN language, reached, known, most, ROUND(reached * 100.0 / known, 1) AS share ORDER BY share DESC, language""",
        """, per as (select id, language, count(distinct src) as checks from fn left join reaches on dst = id group by all)
        select language, sum(case when checks > 0 then 1 else 0 end)::bigint as reached, count(*) as known, max(checks) as most, round(sum(case when checks > 0 then 1 else 0 end) * 100.0::double / count(*), 1) as share from per group by 1""",
    ),
    # a negated pattern, AND, OR, NOT, string predicates, arithmetic
    "cy_untested_functions": (
        """MATCH (code:Function) WHERE NOT (:TestFunction)-[:TESTS|COVERS]->(code) AND (code.name ENDS WITH 'e' OR code.complexity % 10 = 3) AND NOT code.file_path CONTAINS 'm0'
        RETURN code.id AS id, code.complexity * 2 + 1 AS weight""",
        "select id, complexity * 2 + 1 as weight from fn where id not in (select dst from reaches) and (name like '%e' or complexity % 10 = 3) and file_path not like '%m0%'",
    ),
    # two hops in one optional pattern, an absent property, HAVING by WITH .. WHERE
    "cy_class_coverage": (
        """MATCH (owner:Class)-[:Contains]->(part:Function) WITH owner, COLLECT(part.name) AS parts, MIN(part.complexity) AS least
        WHERE SIZE(parts) >= 2 AND NOT EXISTS(owner.doc_string)
        OPTIONAL MATCH (owner)-[:Contains]->(:Function)<-[link:TESTS|COVERS]-(:TestFunction)
        RETURN owner.id AS owner, SIZE(parts) AS parts, least, COUNT(link) AS links""",
        """, c as (select parent_id, count(*) as parts, min(complexity) as least from fn group by 1 having count(*) >= 2),
        l as (select src, dst from tests union all select src, dst from covers)
        select c.parent_id as owner, c.parts, c.least, count(l.src) as links from c join fn on fn.parent_id = c.parent_id left join l on l.dst = fn.id group by all""",
    ),
    # a pattern from the right, a second WITH, COALESCE of a null
    "cy_critical_untested": (
        """MATCH (code:Function)<-[:CALLS]-(user:Function) WITH code, COLLECT(DISTINCT user.language) AS languages, COUNT(user) AS users
        WHERE users > 1 AND NOT EXISTS((code)<-[:TESTS|COVERS]-(:TestFunction))
        RETURN code.id AS id, users, SIZE(languages) AS languages, COALESCE(code.doc_string, 'none') AS doc""",
        "select f.id, count(*) as users, count(distinct u.language)::int as languages, 'none' as doc from calls join fn f on f.id = dst join fn u on u.id = src where f.id not in (select dst from reaches) group by f.id having count(*) > 1",
    ),
    # a bounded walk back to its start
    "cy_circular_calls": (
        "MATCH loop = (first:Function)-[:CALLS*2..3]->(first) RETURN first.language AS language, size(loop) AS steps, COUNT(DISTINCT first.id) AS starts",
        """, w as (
          select a.src as id, 3 as steps from calls a join calls b on a.dst = b.src where b.dst = a.src and (a.src, a.dst) <> (b.src, b.dst)
          union all select a.src, 4 from calls a join calls b on a.dst = b.src join calls c on b.dst = c.src
            where c.dst = a.src and (a.src, a.dst) <> (b.src, b.dst) and (a.src, a.dst) <> (c.src, c.dst) and (b.src, b.dst) <> (c.src, c.dst))
        select language, steps, count(distinct id) as starts from w join fn using (id) group by 1, 2""",
    ),
    # a comparison of two nodes' properties, grouping by an expression
    "cy_cross_file_calls": (
        "MATCH (one:Function)-[:CALLS]->(two:Function) WHERE one.language <> two.language AND one.complexity >= two.complexity RETURN one.language + '>' + two.language AS pair, COUNT(*) AS calls, AVG(one.complexity - two.complexity) AS gap",
        "select a.language || '>' || b.language as pair, count(*) as calls, avg(a.complexity - b.complexity) as gap from calls join fn a on a.id = src join fn b on b.id = dst where a.language <> b.language and a.complexity >= b.complexity group by 1",
    ),
    # an optional pattern without a label, two kinds of CASE
    "cy_effectiveness": (
        """MATCH (check:TestFunction) OPTIONAL MATCH (check)-[:TESTS|COVERS|MOCKS]->(thing) WITH check, COUNT(DISTINCT thing) AS things
        RETURN CASE check.test_type WHEN 'unit' THEN 'u' ELSE 'o' END AS kind, CASE WHEN things > 2 THEN 'many' WHEN things > 0 THEN 'some' ELSE 'no' END AS amount, COUNT(check) AS checks""",
        """, x as (select src, dst from reaches union select src, dst from mocks), n as (select t.id, t.test_type, count(distinct dst) as things from test t left join x on src = t.id group by all)
        select case test_type when 'unit' then 'u' else 'o' end as kind, case when things > 2 then 'many' when things > 0 then 'some' else 'no' end as amount, count(*) as checks from n group by 1, 2""",
    ),
    # a property map, LIMIT after an order, of a small result
    "cy_framework_average": (
        "MATCH (check:TestFunction {test_type: 'unit', is_test: true}) RETURN check.test_framework AS framework, SUM(check.assertion_count) AS total, AVG(check.assertion_count) AS mean ORDER BY framework LIMIT 3",
        "select test_framework as framework, sum(assertion_count)::bigint as total, avg(assertion_count) as mean from test where test_type = 'unit' group by 1 order by 1 limit 3",
    ),
    # regular expressions, IN, SPLIT, slices, REDUCE
    "cy_regex_and_lists": (
        "MATCH (f:File) WHERE f.path =~ '.*_test\\\\.(ts|py)$' AND f.language IN ['python', 'typescript'] RETURN f.path as path, SPLIT(f.path, '/')[0..-1] as folders, REDUCE(s = '', x IN SPLIT(f.path, '/')[0..-1] | s + '/' + x) as module",
        "select file_path as path, string_split(file_path, '/')[1:-2] as folders, '/' || regexp_replace(file_path, '/[^/]*$', '') as module from file where regexp_full_match(file_path, '.*_test\\.(ts|py)') and language in ('python', 'typescript')",
    ),
    # a negated pattern of two hops, the size of a pattern
    "cy_untested_classes": (
        """MATCH (owner:Class) WHERE NOT EXISTS((:TestFunction)-[:TESTS|COVERS]->(:Function)<-[:Contains]-(owner))
        RETURN owner.id AS owner, SIZE((owner)-[:INHERITS]->(:Class)) + SIZE((owner)-[:Contains]->(:Function)) AS edges""",
        """, e as (select parent_id as id from fn union all select src from inherits)
        select c.id as owner, count(e.id) as edges from cls c left join e on e.id = c.id where c.id not in (select parent_id from fn where id in (select dst from reaches)) group by 1""",
    ),
    # UNWIND, an expression over its variable
    "cy_unwound_folders": (
        "MATCH (f:File) UNWIND SPLIT(f.path, '/') AS piece WITH piece, COUNT(*) AS uses WHERE uses > 1 AND NOT piece CONTAINS '.' RETURN piece, uses",
        "select piece, count(*) as uses from (select unnest(string_split(file_path, '/')) as piece from file) where piece not like '%.%' group by 1 having count(*) > 1",
    ),
}


def _register(name, text, sql):
    @query(name, sql)
    def run(spark, d):
        return graph(spark, d).cypher(text)


for _name, (_text, _sql) in CYPHER.items():
    _register(_name, _text, _sql)
