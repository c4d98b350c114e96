"""Read-only SQL over registered tables: one query statement, checked on its parsed plan before it runs.

The plan may hold nodes that read, functions of a list, and files below named folders; anything else is
refused. Functions that can run code, read the session or the machine are in no list."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession

_READS = {"Project", "Aggregate", "Filter", "Join", "Sort", "GlobalLimit", "LocalLimit", "Union", "Distinct", "Intersect", "Except", "SubqueryAlias", "WithCTE", "UnresolvedWith", "CTERelationDef", "CTERelationRef", "UnresolvedRelation", "OneRowRelation", "UnresolvedInlineTable", "UnresolvedTableValuedFunction", "UnresolvedHaving", "Generate", "Window", "WithWindowDefinition", "Pivot", "Unpivot", "LateralJoin", "UnresolvedSubqueryColumnAliases", "Sample", "Tail", "Offset", "LocalRelation", "Range", "UnresolvedHint", "RepartitionByExpression", "Repartition", "RebalancePartitions", "UnresolvedOrdinal", "AsOfJoin", "TimeWindow"}
#: Groups of built-in functions (as the session documents them) that only compute, and functions of these
#: and of other groups that do more: run code or tell of the session and the machine.
_GROUPS = {"agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "datetime_funcs", "date_funcs", "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs", "operator_funcs", "predicate_funcs", "string_funcs", "struct_funcs", "url_funcs", "variant_funcs", "window_funcs", "xml_funcs", "csv_funcs", "sketch_funcs", "st_funcs", "vector_funcs"}
_OTHERS = {"typeof", "monotonically_increasing_id", "uuid", "rand", "randn", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "range", "count_if", "named_struct"}
_NEVER = {"java_method", "reflect", "try_reflect", "raise_error", "assert_true", "input_file_name", "input_file_block_start", "input_file_block_length", "current_user", "session_user", "user", "current_catalog", "current_database", "current_schema", "version", "spark_partition_id", "python_worker_logs", "sql_keywords", "collations"}
_FILES = {"parquet", "json", "csv", "text", "orc", "avro", "binaryfile", "xml", "delta"}


class NotReadOnly(ValueError):
    """The statement is something other than a query of what it may read."""


@functools.lru_cache(maxsize=4)
def _allowed(session) -> frozenset[str]:
    """Names of the functions a query may call, by the group each built-in one is in."""
    catalog = session.sessionState().catalog()
    found = catalog.listFunctions("default", "*")
    names = set(_OTHERS)
    for i in range(found.size()):
        ident = found.apply(i)._1()
        if ident.database().isEmpty() or ident.database().get() in ("builtin", "system"):
            try:
                if catalog.lookupFunctionInfo(ident).getGroup() in _GROUPS:
                    names.add(ident.funcName().lower())
            except Exception:  # noqa: BLE001, S112  a function the catalogue can't describe is not allowed
                continue
    return frozenset(names - _NEVER)


def _all(seq):
    return (seq.apply(i) for i in range(seq.size()))


def _nodes(plan):
    yield plan
    yield from (n for child in _all(plan.children()) for n in _nodes(child))
    yield from (n for child in _all(plan.innerChildren()) if hasattr(child, "innerChildren") for n in _nodes(child))


def _expressions(node):
    """All expressions of a plan's node, those inside others too."""
    todo = list(_all(node.expressions()))
    while todo:
        e = todo.pop()
        yield e
        todo += _all(e.children())


def _check(spark: SparkSession, plan, folders: tuple[str, ...]) -> None:
    for node in _nodes(plan):
        name = node.getClass().getSimpleName().rstrip("$")
        if name not in _READS:
            raise NotReadOnly(f"only queries are allowed, not {name}")
        if name == "UnresolvedRelation":
            parts = list(_all(node.multipartIdentifier()))
            if len(parts) == 2 and parts[0].lower() in _FILES and not _below(spark, parts[1], folders):
                raise NotReadOnly(f"files are read only below the folders that were named, not {parts[1]}")
        calls = [_last(node.name())] if name == "UnresolvedTableValuedFunction" else []
        for e in _expressions(node):
            kind = e.getClass().getSimpleName()
            if kind == "UnresolvedFunction":
                calls.append(_last(e.nameParts()))
            elif hasattr(e, "plan") and kind in ("ScalarSubquery", "Exists", "ListQuery", "UnresolvedScalarSubquery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
                _check(spark, e.plan(), folders)
        for call in calls:
            if call not in _allowed(spark._jsparkSession):
                raise NotReadOnly(f"the function {call} is not among those a query may call")


def _last(parts) -> str:
    return parts.apply(parts.size() - 1).lower()


def _below(spark: SparkSession, path: str, folders: tuple[str, ...]) -> bool:
    java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    clean = lambda p: java(p).toUri().normalize().getPath().rstrip("/") + "/"
    return ".." not in re.split(r"[/\\]", path) and any(clean(path).startswith(clean(f)) for f in folders)


def run_sql(spark: SparkSession, statement: str, limit: int | None = 20, folders: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a query, at most limit. Anything but a query (also after WITH) is refused before it runs.

    folders: below these, files may be read as tables, such as csv.`/data/x.csv` or json.`/data/y.json`."""
    statement = statement.strip().rstrip(";")
    _check(spark, spark._jsparkSession.sessionState().sqlParser().parsePlan(statement), folders)
    out = spark.sql(statement)
    return out if limit is None else out.limit(limit)


def external_table(spark: SparkSession, name: str, path: str, **options: str) -> DataFrame:
    """A CSV (with a header by default), JSON, JSONL or Parquet file as a view for run_sql."""
    kind = path.lower().rstrip("/").rpartition(".")[2]
    reader = spark.read.options(**options)
    if kind == "csv":
        found = reader.options(header=options.get("header", "true"), inferSchema=options.get("inferSchema", "true"), multiLine="true", escape='"').csv(path)
    elif kind in ("json", "jsonl", "ndjson"):
        found = reader.option("multiLine", str(kind == "json").lower()).json(path)
    elif kind == "parquet":
        found = reader.parquet(path)
    else:
        raise ValueError(f"not a CSV, JSON or Parquet file: {path!r}")
    found.createOrReplaceTempView(name)
    return found
