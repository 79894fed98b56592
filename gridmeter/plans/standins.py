"""Domain tables over the synthetic test tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import dealt, parts

_ORD = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
_BASE = f"SELECT *, row_number() OVER (PARTITION BY l_orderkey {_ORD}) AS ord FROM {{lineitem}}"
_SHIFT = "l_partkey % 4 - 1"

VIEWS: dict[str, str] = {
    # verdicts of rules on tables: a file is an order, a table a line
    "checks": f"""SELECT l_orderkey AS stem, l_linenumber AS tbl, CASE l_returnflag WHEN 'A' THEN 'L1-' WHEN 'N' THEN 'L2-' ELSE 'L3-' END || CASE l_linestatus WHEN 'F' THEN '07' ELSE '02' END AS rule_id,
        l_quantity > 25 AS passed, CASE WHEN l_discount = 0 THEN 0.0 ELSE 1 - l_tax END AS confidence, CAST(floor(l_quantity / 10) AS BIGINT) AS n_violations,
        CASE l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'fatal' WHEN 2 THEN 'major' ELSE 'minor' END AS severity,
        o_orderstatus AS gov_org, o_orderpriority AS stat_type, CAST(greatest(1, floor(o_totalprice / 1000)) AS BIGINT) AS weight, ord
        FROM ({_BASE}) l JOIN {{orders}} o ON l_orderkey = o_orderkey""",
    "violations": f"""SELECT l_orderkey AS stem, CASE l_returnflag WHEN 'A' THEN 'L1-' WHEN 'N' THEN 'L2-' ELSE 'L3-' END || l_linestatus AS rule_id, 'S' || CAST(l_linenumber % 3 AS STRING) AS sheet_name,
        'R' || CAST(l_suppkey % 5 AS STRING) AS cell_range, CAST(l_partkey % 3 AS STRING) AS description,
        CASE l_suppkey % 3 WHEN 0 THEN 'fatal' WHEN 1 THEN 'major' ELSE 'minor' END AS severity, ord FROM ({_BASE}) l""",
    # boxes: truth, and predictions that are shifted, dropped or split
    "gt": f"""SELECT l_orderkey AS doc, l_linestatus AS sheet, CAST((l_linenumber - 1) * 12 AS BIGINT) AS first_row, CAST(l_suppkey % 5 AS BIGINT) AS first_col,
        CAST((l_linenumber - 1) * 12 + CAST(l_quantity AS INT) % 10 AS BIGINT) AS last_row, CAST(l_suppkey % 5 + l_partkey % 6 AS BIGINT) AS last_col, l_partkey, l_discount, ord,
        row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY ord) - 1 AS idx FROM ({_BASE}) l""",
    "pred": f"""SELECT doc, sheet, first_row, first_col, last_row, last_col, abstain, row_number() OVER (PARTITION BY doc, sheet ORDER BY ord, half) - 1 AS idx FROM (
        SELECT doc, sheet, greatest(0, first_row + {_SHIFT}) AS first_row, first_col, CASE WHEN l_partkey % 11 = 0 AND last_row > first_row THEN greatest(0, first_row + {_SHIFT}) ELSE greatest(0, last_row + {_SHIFT}) END AS last_row, last_col, l_discount = 0 AS abstain, ord, 0 AS half
        FROM {{gt}} g WHERE l_partkey % 7 <> 0
        UNION ALL SELECT doc, sheet, greatest(0, first_row + {_SHIFT}) + 1, first_col, greatest(greatest(0, first_row + {_SHIFT}) + 1, last_row + {_SHIFT}), last_col, l_discount = 0, ord, 1
        FROM {{gt}} g WHERE l_partkey % 7 <> 0 AND l_partkey % 11 = 0 AND last_row > first_row) x""",
    "roles": "SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'Header' WHEN 'system' THEN 'Other' ELSE 'Data' END AS truth, CASE turn % 3 WHEN 0 THEN 'Header' WHEN 1 THEN 'Data' ELSE 'Other' END AS guess, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS ord FROM {conversations}",
    # level scores with nulls, of a baseline and a variant
    "levels": """SELECT d.doc_id AS file, 'L' || CAST(d.doc_id % 3 + 1 AS STRING) AS level, CASE WHEN quality IS NULL AND d.doc_id % 2 = 0 THEN NULL ELSE coalesce(quality, 0) * 40 + CAST(n_chars % 61 AS INT) - CAST(n_chars % 61 AS INT) % 20 END AS score,
        coalesce(toxic, 0) = 1 AS forced_zero, CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE coalesce(quality, 0) * 40 + CAST(n_chars % 61 AS INT) - CAST(n_chars % 61 AS INT) % 20 + CASE WHEN d.doc_id % 5 = 0 THEN 10 ELSE 0 END END AS variant_score
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "states": "SELECT doc_id AS file, 'R' || CAST(s AS STRING) AS rule_id, CASE (doc_id * 7 + s * 3) % 5 WHEN 0 THEN 'fail' WHEN 1 THEN 'skip' ELSE 'pass' END AS state FROM {documents} CROSS JOIN (SELECT 1 AS s UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) r WHERE (doc_id + s) % 11 <> 0",
    "variant_states": """SELECT doc_id AS file, 'R' || CAST(s AS STRING) AS rule_id, v AS variant, CASE (doc_id * 7 + s * 3 + CASE WHEN (doc_id + length(v)) % 4 = 0 THEN 1 ELSE 0 END) % 5 WHEN 0 THEN 'fail' WHEN 1 THEN 'skip' ELSE 'pass' END AS state
        FROM {documents} CROSS JOIN (SELECT 1 AS s UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) r CROSS JOIN (SELECT 'shift_top+1' AS v UNION ALL SELECT 'split_2' UNION ALL SELECT 'detector') q WHERE (doc_id + s) % 13 <> 0""",
    "families": "SELECT 'shift_top+1' AS variant, 'shift' AS family UNION ALL SELECT 'split_2', 'split' UNION ALL SELECT 'detector', 'detector'",
    # a catalogue of resources: a survey is a group of customers
    "resources": """SELECT CAST(o_custkey % 500 AS STRING) AS survey, o_orderpriority AS stem, o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE '' END AS stem_region,
        CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE CAST(o_orderkey % 40 AS STRING) END AS table_no, o_orderstatus AS table_name, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS STRING) AS survey_date,
        CASE o_orderkey % 6 WHEN 0 THEN 'xls ' WHEN 1 THEN 'CSV' WHEN 2 THEN '' WHEN 3 THEN 'XLS_REP' ELSE 'XLS' END AS format, 'u' || CAST(o_orderkey AS STRING) AS url, CAST(o_orderkey AS STRING) AS resource_id,
        'org' || CAST(o_custkey % 7 AS STRING) AS organization, CAST(day(o_orderdate) AS STRING) AS released, o_orderkey AS ord FROM {orders}""",
    "pool": "SELECT o_orderkey AS id, o_orderstatus || '-' || o_orderpriority AS cell, o_custkey % 50 AS survey, o_orderstatus AS owner, o_orderpriority AS bucket, o_orderkey % 3 = 0 AS derived FROM {orders}",
    # a grid of cells: the words of a document's first lines, with gaps and numbers by arithmetic
    "cells": """SELECT doc_id AS doc, CAST(doc_id % 2 AS INT) AS sheet, r AS row, c AS col, (doc_id + r * 3 + c * 5) % 3 <> 0 AND r > 1 AS numeric, 'v' || CAST((doc_id + r + c) % 10 AS STRING) AS value
        FROM {documents} CROSS JOIN (SELECT linenumber AS r FROM (SELECT DISTINCT l_linenumber + 7 * (l_suppkey % 3) - 1 AS linenumber FROM {lineitem}) a) rr
        CROSS JOIN (SELECT DISTINCT l_linenumber - 1 AS c FROM {lineitem} WHERE l_linenumber <= 5) cc
        WHERE (doc_id + r) % 7 > 1 AND r < 5 + doc_id % 14 AND (c > 0 OR r > doc_id % 3) AND (r > 0 OR c = 1)""",
    "merged": "SELECT doc_id AS doc, CAST(doc_id % 2 AS INT) AS sheet, doc_id % 11 AS n_merged FROM {documents}",
    "files": "SELECT o_orderkey AS file, CASE WHEN o_orderkey % 3 = 0 THEN '.xls' ELSE '.xlsx' END AS ext, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE year(o_orderdate) END AS year, o_custkey % 60 AS survey, CASE o_orderkey % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'timeout' ELSE 'ok' END AS status FROM {orders}",
    "ranges": "SELECT 'own' || CAST(l_suppkey % 9 AS STRING) || '__' || CAST(l_orderkey % 700 AS STRING) AS file, 's' || CAST(l_linenumber % 3 AS STRING) AS sheet, CASE l_partkey % 5 WHEN 0 THEN 'Derived' WHEN 1 THEN 'Notes' ELSE 'Table' END AS label FROM {lineitem}",
}
#: Views that sort, join or number the lines of each order: their inputs come dealt out by order, by a count of the lines.
_BY_ORDER = {"checks": {"lineitem": "l_orderkey", "orders": "o_orderkey"}, "violations": {"lineitem": "l_orderkey"}, "gt": {"lineitem": "l_orderkey"}}
_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A domain table; or a test table. given: domain tables that it reads, where the caller has them."""
    if name in _TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    inputs = {n: given[n] if n in given else view(spark, sf_dir, n) for n in _names(sql)}
    if name in _BY_ORDER:
        n = parts(inputs["lineitem"])
        inputs |= {t: dealt(inputs[t], n, key) for t, key in _BY_ORDER[name].items()}
    return spark.sql(sql, **inputs)


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """sql for DuckDB, after the domain tables that it uses."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in _names(VIEWS[name]):
                add(n)
            order.append(name)

    for n in names:
        add(n)
    defined = ", ".join(f"{n} AS ({re.sub(r'\{(\w+)\}', r'\1', VIEWS[n])})" for n in order)
    head = "WITH RECURSIVE " if recursive else "WITH "
    sql = sql.strip()
    return f"{head}{defined}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"{head}{defined} {sql}"
