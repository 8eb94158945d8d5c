"""One query text for two engines: Spark SQL over Parquet files, and the SQL that checks it.

A query is a function of a dialect. What both engines spell alike is written plainly; the rest goes through the methods
below. Spark reads tables by path, so that queries need no views and prune columns at the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: name: function of a dialect
QUERIES: dict[str, Callable[[Dialect], str]] = {}
#: name: function of (spark, sf_dir), for what SQL can't express
FRAMES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: name: SQL that checks a frame
CHECKS: dict[str, str] = {}


class Dialect:
    def t(self, name: str) -> str:
        raise NotImplementedError


class SparkSQL(Dialect):
    def __init__(self, sf_dir: str):
        self.sf_dir = sf_dir

    def t(self, name):
        return f"parquet.`{self.sf_dir}/{name}.parquet`"

    sha = staticmethod(lambda x: f"sha2({x}, 256)")
    days = staticmethod(lambda a, b: f"datediff({b}, {a})")
    size = staticmethod(lambda a: f"size({a})")
    distinct = staticmethod(lambda a: f"array_distinct({a})")
    find = staticmethod(lambda x, p: f"regexp_extract_all({x}, r'{p}', 0)")
    sub = staticmethod(lambda x, p, r: f"regexp_replace({x}, r'{p}', '{r}')")
    like = staticmethod(lambda x, p: f"({x} rlike r'{p}')")
    split = staticmethod(lambda x, by: f"split({x}, '[{by}]')")
    both = staticmethod(lambda a, b: f"array_intersect({a}, {b})")
    minus = staticmethod(lambda a, b: f"array_except({a}, {b})")
    keep = staticmethod(lambda a, f: f"filter({a}, x -> {f})")
    each = staticmethod(lambda a, f: f"transform({a}, x -> {f})")
    part = staticmethod(lambda a, i, n: f"slice({a}, {i}, {n})")
    at = staticmethod(lambda a, i: f"try_element_at({a}, {i})")
    text = staticmethod(lambda a, by: f"array_join({a}, '{by}')")
    weekday = staticmethod(lambda d: f"weekday({d})")
    seconds = staticmethod(lambda t: f"unix_timestamp({t})")
    listed = staticmethod(lambda x, by, order: f"listagg({x}, '{by}') WITHIN GROUP (ORDER BY {order})")
    quantile = staticmethod(lambda x, q: f"percentile({x}, {q})")
    hexint = staticmethod(lambda h: f"CAST(conv({h}, 16, 10) AS BIGINT)")
    span = staticmethod(lambda a, b: f"CASE WHEN ({a}) <= ({b}) THEN sequence({a}, {b}) ELSE array() END")
    collect = staticmethod(lambda x, order: f"transform(array_sort(collect_list(struct({order} AS o, {x} AS v))), s -> s.v)")
    adddays = staticmethod(lambda d, n: f"date_add({d}, {n})")
    starts = staticmethod(lambda x, p: f"startswith({x}, {p})")
    field = staticmethod(lambda x, k: f"get_json_object({x}, '$.{k}')")
    instr = staticmethod(lambda x, y: f"instr({x}, {y})")
    empty = "CAST(array() AS array<string>)"

    def grams(self, a, n):
        return f"CASE WHEN size({a}) >= {n} THEN transform(sequence(0, size({a}) - {n}), i -> array_join(slice({a}, i + 1, {n}), ' ')) ELSE {self.empty} END"

    def unnest(self, cols, source, a, pos, val):
        # OUTER: a filter that Spark infers from a plain explode is pushed below, where it works the array out a second time
        return f"SELECT {cols}, {pos}, {val} FROM {source} LATERAL VIEW OUTER posexplode({a}) AS {pos}, {val} WHERE {val} IS NOT NULL"


class DuckDB(Dialect):
    def t(self, name):
        return name

    sha = staticmethod(lambda x: f"sha256({x})")
    days = staticmethod(lambda a, b: f"date_diff('day', {a}, {b})")
    size = staticmethod(lambda a: f"len({a})")
    distinct = staticmethod(lambda a: f"list_distinct({a})")
    find = staticmethod(lambda x, p: f"regexp_extract_all({x}, '{p}')")
    sub = staticmethod(lambda x, p, r: f"regexp_replace({x}, '{p}', '{r}', 'g')")
    like = staticmethod(lambda x, p: f"regexp_matches({x}, '{p}')")
    split = staticmethod(lambda x, by: f"string_split_regex({x}, '[{by}]')")
    both = staticmethod(lambda a, b: f"list_intersect({a}, {b})")
    minus = staticmethod(lambda a, b: f"list_filter(list_distinct({a}), lambda x: NOT list_contains({b}, x))")
    keep = staticmethod(lambda a, f: f"list_filter({a}, lambda x: {f})")
    each = staticmethod(lambda a, f: f"list_transform({a}, lambda x: {f})")
    part = staticmethod(lambda a, i, n: f"({a})[{i}:({i}) + ({n}) - 1]")
    at = staticmethod(lambda a, i: f"({a})[{i}]")
    text = staticmethod(lambda a, by: f"array_to_string({a}, '{by}')")
    weekday = staticmethod(lambda d: f"(isodow({d}) - 1)")
    seconds = staticmethod(lambda t: f"CAST(floor(epoch({t})) AS BIGINT)")
    listed = staticmethod(lambda x, by, order: f"string_agg({x}, '{by}' ORDER BY {order})")
    quantile = staticmethod(lambda x, q: f"quantile_cont({x}, {q})")
    hexint = staticmethod(lambda h: f"CAST(('0x' || {h}) AS BIGINT)")
    span = staticmethod(lambda a, b: f"range({a}, ({b}) + 1)")
    collect = staticmethod(lambda x, order: f"list({x} ORDER BY {order})")
    adddays = staticmethod(lambda d, n: f"CAST({d} + to_days(CAST({n} AS INTEGER)) AS DATE)")
    starts = staticmethod(lambda x, p: f"starts_with({x}, {p})")
    field = staticmethod(lambda x, k: f"json_extract_string({x}, '$.{k}')")
    instr = staticmethod(lambda x, y: f"instr({x}, {y})")
    empty = "CAST([] AS VARCHAR[])"

    def grams(self, a, n):
        return f"list_transform(range(0, greatest(len({a}) - {n} + 1, 0)), lambda i: array_to_string(({a})[i + 1:i + {n}], ' '))"

    def unnest(self, cols, source, a, pos, val):
        return f"SELECT {cols}, CAST(unnest(range(len({a}))) AS INTEGER) AS {pos}, unnest({a}) AS {val} FROM {source}"


def query(f):
    QUERIES[f.__name__] = f
    return f


def frame(check: str | None = None):
    def register(f):
        FRAMES[f.__name__] = f
        if check:
            CHECKS[f.__name__] = check
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda spark, sf_dir, f=f: spark.sql(f(SparkSQL(sf_dir)))) for k, f in QUERIES.items()} | FRAMES


def oracle_sql() -> dict[str, str]:
    return {k: f(DuckDB()) for k, f in QUERIES.items()} | CHECKS
