"""Read-only SQL over one prepared table."""

from __future__ import annotations

import re
import threading
import uuid

from pyspark.sql import DataFrame

MAX_ROWS = 500
TIME_LIMIT_SECONDS = 30

# Statement words that are refused.
FORBIDDEN = (
    "INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "ATTACH", "COPY", "PRAGMA", "EXECUTE", "TRUNCATE",
    "GRANT", "REVOKE",
)
# Functions that run code or read files outside the table.
REFUSED_CALLS = ("reflect", "java_method", "try_reflect", "read_files", "input_file_name", "input_file_block_start", "input_file_block_length")
#: A literal, a quoted name, or a comment: what stands inside the first two is never code.
QUOTED = r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`[^`]*`"


def check_statement(sql: str) -> str:
    """Return the statement without comments, or raise when it is not a single read-only query over one table.

    Literals and quoted names are set aside first, so their contents are neither searched nor changed.
    """
    kept: list[str] = []

    def aside(m: re.Match) -> str:
        if m.group(0)[0] not in "'\"`":
            return " "
        kept.append(m.group(0))
        return f"\x00{len(kept) - 1}\x00"

    if "\x00" in (sql or ""):
        raise ValueError("the query holds a null character")
    bare = re.sub(rf"{QUOTED}|--[^\n]*|/\*.*?\*/", aside, sql or "", flags=re.S).strip().rstrip(";").strip()
    if not bare:
        raise ValueError("the query is empty")
    if not re.match(r"(SELECT|WITH)\b", bare, re.I):
        raise ValueError("only SELECT or WITH queries are allowed")
    if ";" in bare:
        raise ValueError("only one statement is allowed")
    if re.search(rf"\b({'|'.join(FORBIDDEN)})\b", bare, re.I):
        raise ValueError("the query holds a forbidden keyword")
    names = re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m.group(1))].strip("`") if kept[int(m.group(1))][0] == "`" else "", bare)
    if re.search(rf"\b({'|'.join(REFUSED_CALLS)})\b\s*\(", names, re.I):
        raise ValueError("the query calls a function that is not allowed")
    return re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m.group(1))], bare)


def read_relations(df: DataFrame, statement: str) -> set[str]:
    """Names of the tables and files that a statement reads, from Spark's own parser; names it defines itself don't count."""
    plan = df.sparkSession._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    text = plan.toString()
    read = set(re.findall(r"'UnresolvedRelation \[([^\]]*)\]", text))
    own = {n.strip().lower() for n in re.findall(r"(?:\bCTE \[|, )([\w ,]+)\]", text) for n in n.split(",")}
    return {", ".join(p.strip() for p in n.split(",")) for n in read if n.strip().lower() not in own}


def run_sql(df: DataFrame, sql: str, view: str = "data", max_rows: int = MAX_ROWS) -> DataFrame:
    """The query's rows over ``df`` as the table ``data``, cut to one row above the cap; it can read nothing else.

    The table is a view under a private name, so a view ``data`` of the session stays as it is.
    """
    statement = check_statement(sql)
    others = {n for n in read_relations(df, statement) if n.lower() != view.lower()}
    if others:
        raise ValueError(f"the query reads other tables or files: {sorted(others)}")
    name = f"{view}_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    try:
        return df.sparkSession.sql(f"WITH `{view}` AS (SELECT * FROM `{name}`) SELECT * FROM ({statement})").limit(max_rows + 1)
    finally:
        df.sparkSession.catalog.dropTempView(name)


def fetch_sql(df: DataFrame, sql: str, seconds: int = TIME_LIMIT_SECONDS) -> dict:
    """Run a query under the time limit; returns at most 500 rows and whether more were there."""
    jobs = df.sparkSession.sparkContext
    tag = f"adhoc-{uuid.uuid4().hex}"
    timer = threading.Timer(seconds, jobs.cancelJobGroup, [tag])
    jobs.setJobGroup(tag, "ad-hoc query", interruptOnCancel=True)
    timer.start()
    try:
        rows = run_sql(df, sql).collect()
    finally:
        timer.cancel()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            jobs.setLocalProperty(name, None)
    return {"rows": [r.asDict(recursive=True) for r in rows[:MAX_ROWS]], "truncated": len(rows) > MAX_ROWS}
