"""Workload files: one statement per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thingroups.spec import AggQuery, JoinSpec, Predicate

# The statement shape that can be answered approximately.
NAME = r"[A-Za-z_]\w*"
COLUMN = rf"(?:{NAME}\.)?({NAME})"
LITERAL = r"(?:'(?:[^']|'')*'|[-+]?\d+(?:\.\d+)?)"
TERM = rf"{COLUMN}\s*(>=|<=|=|>|<)\s*({LITERAL})"
WHERE = rf"(?:{NAME}\.)?{NAME}\s*(?:>=|<=|=|>|<)\s*{LITERAL}"
STATEMENT = (
    rf"(?i)^SELECT\s+{COLUMN}\s*,\s*(AVG|SUM|COUNT)\s*\(\s*{COLUMN}\s*\)\s+FROM\s+({NAME})"
    rf"(?:\s+(?:INNER\s+)?JOIN\s+({NAME})\s+ON\s+{COLUMN}\s*=\s*{COLUMN})?"
    rf"(?:\s+WHERE\s+({WHERE}(?:\s+AND\s+{WHERE})*))?"
    rf"\s+GROUP\s+BY\s+{COLUMN}$"
)


def trimmed(line: Column) -> Column:
    """The statement without surrounding blanks and semicolons."""
    return F.regexp_replace(line, r"^[\s;]+|[\s;]+$", "")


def read_workload(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``(workload, line, sql)`` of every non-blank line; ``line`` keeps the file order."""
    # A row's place in its file; a workload is one text file.
    lines = spark.read.text(path).select(
        F.lit(name).alias("workload"),
        F.monotonically_increasing_id().alias("line"),
        trimmed(F.col("value")).alias("sql"),
    )
    return lines.where(F.col("sql") != "")


def profile(statements: DataFrame) -> DataFrame:
    """Take statements apart: aggregate, group, tables, predicates.

    Works on any number of statements; a statement of another shape is marked
    unsupported. Names are lower-cased, literals stay as written. A column may be named with
    its table, if that is one of the statement's tables.
    """
    def part(i: int) -> Column:
        return F.regexp_extract("sql", STATEMENT, i)

    def name(i: int) -> Column:
        return F.lower(part(i))

    bare = F.regexp_replace("sql", r"'(?:[^']|'')*'", "")  # without texts
    qualifiers = F.transform(F.regexp_extract_all(bare, F.lit(rf"({NAME})\.{NAME}"), F.lit(1)), F.lower)
    known = F.size(F.array_except(qualifiers, F.array(name(4), name(5)))) == 0
    where = part(8)
    columns = F.transform(F.regexp_extract_all(where, F.lit(TERM), F.lit(1)), F.lower)
    operators = F.regexp_extract_all(where, F.lit(TERM), F.lit(2))
    literals = F.regexp_extract_all(where, F.lit(TERM), F.lit(3))
    return statements.select(
        *statements.columns,
        (F.col("sql").rlike(STATEMENT) & (name(1) == name(9)) & known).alias("supported"),
        F.upper(part(2)).alias("func"),
        name(3).alias("measure"),
        name(1).alias("grp_column"),
        name(4).alias("fact"),
        name(5).alias("dimension"),
        name(6).alias("on_left"),
        name(7).alias("on_right"),
        columns.alias("pred_columns"),
        operators.alias("pred_ops"),
        literals.alias("pred_values"),
        F.size(columns).alias("n_predicates"),
    )


def profile_summary(profiled: DataFrame) -> DataFrame:
    """Statements per aggregate, group column and number of predicates."""
    return (
        profiled.where("supported")
        .groupBy("func", "grp_column", "n_predicates")
        .agg(F.count(F.lit(1)).alias("n_statements"))
    )


def to_query(row, fact_columns) -> AggQuery:
    """A profiled line as a query; the join may name its two sides in either order."""
    if not row["supported"]:
        raise ValueError(f"unsupported statement: {row['sql']}")
    join = None
    if row["dimension"]:
        sides = (row["on_left"], row["on_right"])
        fact_key, dim_key = sides if sides[0] in fact_columns(row["fact"]) else sides[::-1]
        join = JoinSpec(row["dimension"], fact_key, dim_key)
    predicates = []
    for column, op, text in zip(row["pred_columns"], row["pred_ops"], row["pred_values"]):
        quoted = text.startswith("'")
        predicates.append(Predicate(column, op, text[1:-1].replace("''", "'") if quoted else text))
    return AggQuery(row["func"], row["measure"], row["fact"], row["grp_column"], tuple(predicates), join)
