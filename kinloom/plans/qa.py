"""Questions: canned routes, guarded read-only SQL, detail bundles and prompts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import query_text
from ..operators.graph import Graph, adopted_sons, event_participants, family_trails, neighbourhood, person_events, persons_named, succession
from ..operators.search import snippet_keywords, snippets
from ..sources.models import Client

#: Patterns of the questions with canned answers; a name has up to five characters before its trigger.
ADOPTED = r"(.{1,5})[的之]义子|(.{1,5})收了哪些义子"
SUCCESSION = "皇位更替|更替链|谁接替|顺序"
FAMILY = r"(.{1,5})(?:家族|族谱|亲属)"
RELATED = r"(.{1,5})(?:的关系|有什么关系|相关)"
CONTEXT_CHARS = 6000
VIEWS = ("person", "dynasty", "event", "place", "edges", "nodes")
#: Plan nodes of a read-only query; any other node is rejected.
READ_NODES = frozenset("Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Join LateralJoin SubqueryAlias UnresolvedRelation UnresolvedWith Distinct Union Intersect Except UnresolvedHaving UnresolvedInlineTable OneRowRelation LocalRelation Window WithWindowDefinition UnresolvedSubqueryColumnAliases Generate CTE CTERelationDef".split())
#: Expressions that hold a plan.
SUBQUERIES = frozenset("ScalarSubquery Exists ListQuery InSubquery LateralSubquery UnresolvedScalarSubquery UnresolvedExists".split())
#: Functions that a query may call: they work on values alone. Operators, casts, CASE and the like are expressions of their own.
FUNCTIONS = frozenset(
    """
    count sum avg mean min max min_by max_by any_value first last first_value last_value nth_value every some bool_and bool_or count_if collect_list collect_set array_agg listagg string_agg
    approx_count_distinct approx_percentile percentile percentile_approx percentile_cont percentile_disc median mode stddev stddev_pop stddev_samp variance var_pop var_samp corr covar_pop covar_samp skewness kurtosis
    grouping grouping_id row_number rank dense_rank percent_rank cume_dist ntile lag lead
    between coalesce nullif nvl nvl2 ifnull if isnull isnotnull greatest least equal_null nullifzero zeroifnull
    abs ceil ceiling floor round bround sign signum sqrt cbrt exp ln log log2 log10 power pow mod pmod div negative positive bin hex conv factorial
    concat concat_ws length char_length character_length octet_length lower lcase upper ucase trim ltrim rtrim btrim lpad rpad substring substr substring_index left right instr locate position replace translate
    repeat reverse split split_part contains startswith endswith like ilike rlike regexp regexp_like regexp_count regexp_extract regexp_extract_all regexp_replace regexp_substr regexp_instr initcap ascii char chr format_string printf format_number levenshtein soundex overlay find_in_set sentences
    md5 sha1 sha2 crc32 hash xxhash64 base64 unbase64
    array array_contains array_distinct array_except array_intersect array_join array_max array_min array_position array_remove array_repeat array_size array_sort array_union arrays_overlap arrays_zip cardinality element_at
    exists explode explode_outer posexplode posexplode_outer inline inline_outer stack filter flatten forall aggregate reduce transform zip_with get sequence shuffle size slice sort_array array_append array_prepend array_compact array_insert
    map map_keys map_values map_entries map_from_arrays map_from_entries map_concat map_contains_key map_filter transform_keys transform_values str_to_map named_struct struct
    to_json from_json get_json_object json_tuple json_array_length json_object_keys schema_of_json
    cast string int integer bigint smallint tinyint double float decimal boolean date timestamp binary try_cast try_add try_subtract try_multiply try_divide try_element_at try_to_number to_number to_char typeof
    current_date current_timestamp now year quarter month day dayofmonth dayofweek dayofyear weekofyear weekday hour minute second date_add date_sub dateadd datediff date_diff months_between add_months last_day next_day trunc date_trunc date_part extract to_date to_timestamp date_format make_date
    """.split()
)


class NotAllowed(ValueError):
    pass


def guard(spark: SparkSession, sql: str) -> None:
    """Raises NotAllowed unless the text is one query over the graph's views that only reads.

    Spark's own parser makes the plan; every node in it, in CTEs and subqueries too, must be on the list, every relation a view or a CTE in whose scope it stands, and every
    function one of FUNCTIONS, called by its plain name. Names that are only put together later (IDENTIFIER) are rejected, whatever they stand for.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise NotAllowed(f"not a query: {str(e)[:200]}") from e
    _walk(plan, frozenset(VIEWS))


def _each(seq) -> Iterator:
    items = seq.iterator()
    while items.hasNext():
        yield items.next()


def _walk(plan, known: frozenset[str]) -> None:
    """Checks a parsed plan. known: views and CTEs that may be read here."""
    kind = plan.getClass().getSimpleName()
    if kind not in READ_NODES:
        raise NotAllowed(f"not a read-only query: {kind}")
    if kind == "UnresolvedRelation":
        parts = list(_each(plan.multipartIdentifier()))
        if len(parts) != 1 or parts[0].lower() not in known:
            raise NotAllowed(f"no such view: {'.'.join(parts)}")
    if kind == "UnresolvedWith":
        for cte in _each(plan.cteRelations()):
            name = cte._1().lower()
            _walk(cte._2(), known | {name} if plan.allowRecursion() else known)
            known = known | {name}
    if kind == "WithWindowDefinition":  # its windows stand in a map, which the plan does not count among its expressions
        for window in _each(plan.windowDefinitions().values()):
            _check(window, known)
    for expression in _each(plan.expressions()):
        _check(expression, known)
    for child in _each(plan.children()):
        _walk(child, known)


def _check(expression, known: frozenset[str]) -> None:
    """Checks a parsed expression, what it is made of, and the subquery that it may hold."""
    kind = expression.getClass().getSimpleName()
    if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
        if kind == "UnresolvedFunction":
            parts = list(_each(expression.nameParts()))
        else:
            parts = [expression.name().funcName()] if expression.name().database().isEmpty() else ["", ""]
        if len(parts) != 1 or parts[0].lower() not in FUNCTIONS:
            raise NotAllowed(f"a function that is not allowed: {'.'.join(parts)}")
    elif "Identifier" in kind or kind in ("PythonUDF", "ScalaUDF", "Reflect", "CallMethodViaReflection"):
        raise NotAllowed(f"an expression that is not allowed: {kind}")
    if kind in SUBQUERIES and kind != "InSubquery":  # its query is one of its children
        _walk(expression.plan(), known)
    for child in _each(expression.children()):
        _check(child, known)


def register(graph: Graph) -> None:
    for name in VIEWS[:-1]:
        getattr(graph, name).createOrReplaceTempView(name)
    graph.nodes().createOrReplaceTempView("nodes")


def run_query(graph: Graph, sql: str) -> DataFrame:
    spark = graph.person.sparkSession
    guard(spark, sql)
    register(graph)
    return spark.sql(sql)


def routes(question: str) -> list[tuple[str, str | None]]:
    """(route, name) for each canned route that fits."""
    out: list[tuple[str, str | None]] = []
    if m := re.search(ADOPTED, question):
        out.append(("adopted_sons", m[1] or m[2]))
    if re.search(SUCCESSION, question):
        out.append(("succession", None))
    if m := re.search(FAMILY, question):
        out.append(("family", m[1]))
    if m := re.search(RELATED, question):
        out.append(("relations", m[1]))
    return out


def _rows(source: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(source).alias("source"), F.to_json(F.struct(*df.columns)).alias("row"))


def canned(graph: Graph, question: str) -> DataFrame | None:
    """(source, row as JSON) of all canned routes that fit; None if none does."""
    out = None
    for route, name in routes(question):
        if route == "succession":
            found = succession(graph)
        else:
            person = persons_named(graph, name).orderBy("seq", "uid").select("uid").first()
            if person is None:
                continue
            by = {"adopted_sons": adopted_sons, "relations": neighbourhood}
            if route == "family":
                found = family_trails(graph, graph.person.where(F.col("uid") == person.uid).select("uid"))
            else:
                found = by[route](graph, person.uid)
        rows = _rows(route, found)
        out = rows if out is None else out.unionByName(rows)
    return out


def schema_text(graph: Graph) -> str:
    """The views with their columns and types, one a line."""
    views = [(name, graph.nodes() if name == "nodes" else getattr(graph, name)) for name in VIEWS]
    return "\n".join(f"{name}({', '.join(f'{c} {t}' for c, t in df.dtypes)})" for name, df in views)


def answer(graph: Graph, question: str, client: Client, limit: int = 500) -> dict:
    """question, sql, sql_error, rows, answer. Canned rows come before those of the model's query, which always runs."""
    spark = graph.person.sparkSession
    rows = [] if (found := canned(graph, question)) is None else [r.asDict() for r in found.limit(limit).collect()]
    sql = error = None
    try:
        reply = client.chat([{"role": "system", "content": f"Write one SQL query over these views.\n{schema_text(graph)}"}, {"role": "user", "content": question}])
        sql = spark.createDataFrame([(reply,)], "o string").select(query_text(F.col("o")).alias("q")).first().q
        if sql:
            rows += [r.asDict() for r in _rows("query", run_query(graph, sql)).limit(limit).collect()]
    except Exception as e:
        error = str(e)[:500]
    context = json.dumps(rows, ensure_ascii=False, default=str)
    if len(context) > CONTEXT_CHARS:
        context = context[:CONTEXT_CHARS] + "..."
    prompt = f"Question: {question}\nData: {context}" if rows else f"Question: {question}\nThere is no data in the graph."
    try:
        text = client.chat([{"role": "user", "content": prompt}])
    except Exception as e:
        text = f"The model failed: {e}"
    return {"question": question, "sql": sql, "sql_error": error, "rows": rows, "answer": text}


def person_detail(graph: Graph, uid: str) -> dict[str, DataFrame]:
    return {"person": graph.person.where(F.col("uid") == uid), "events": person_events(graph, uid, 50), "relations": neighbourhood(graph, uid, participation=False)}


def event_detail(graph: Graph, uid: str, books: DataFrame) -> dict[str, DataFrame]:
    event = graph.event.where(F.col("uid") == uid)
    found = event.select("name", "description").first()
    words = snippet_keywords(found.name, found.description) if found else []
    return {"event": event, "participants": event_participants(graph, uid), "snippets": snippets(books, words)}
