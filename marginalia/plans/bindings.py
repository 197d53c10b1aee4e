"""Inputs of the registered queries, made from the given tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

STRINGS = "'\"id\":\"f1\",\"metric\":\"Total\",'"
SQL = {
    "b_requests": """
        SELECT doc_id AS request_id,
               CASE WHEN doc_id % 10 = 8 THEN 'file' WHEN doc_id % 10 = 9 THEN 'fax' ELSE 'text' END AS input_mode,
               CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE text END AS source_text,
               CASE WHEN doc_id % 20 = 8 THEN NULL WHEN doc_id % 10 = 8 THEN concat(source, '.pdf') ELSE NULL END AS file_name,
               CASE WHEN doc_id % 4 = 0 THEN 'management-review' WHEN doc_id % 4 = 1 THEN 'board-update'
                    WHEN doc_id % 4 = 2 THEN 'investor-summary' ELSE 'sales-pitch' END AS deck_purpose,
               CAST(doc_id % 24 AS INT) AS slide_count
        FROM {documents}""",
    "b_forms": """
        SELECT doc_id AS request_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'text' END AS input_mode,
               CASE WHEN doc_id % 5 = 0 THEN NULL ELSE text END AS source_text, CAST(NULL AS STRING) AS file_name,
               CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'board-update' END AS deck_purpose,
               CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(doc_id % 24 AS INT) END AS slide_count
        FROM {documents}""",
    "b_analyses": f"""
        SELECT o_orderkey AS analysis_id, CAST(o_orderkey % 12 AS INT) AS fault,
               CASE WHEN o_orderkey % 24 = 1 THEN 'not json' ELSE concat(
                 '{{{{"schemaVersion":', CASE WHEN o_orderkey % 12 = 4 THEN '0.1' ELSE '"0.1"' END,
                 ',"executiveSummary":["', CASE WHEN o_orderkey % 12 = 5 THEN '' ELSE concat('Order ', CAST(o_orderkey AS STRING)) END, '","Second sentence."]',
                 ',"facts":[{{{{', {STRINGS}, '"value":', CASE WHEN o_orderkey % 12 = 7 THEN '"12"' ELSE CAST(o_orderkey AS STRING) END,
                 CASE WHEN o_orderkey % 12 = 6 THEN '' WHEN o_orderkey % 12 = 11 THEN ',"unit":null' ELSE ',"unit":"USD"' END,
                 ',"period":"Q2 1996","source":{{{{"page":', CASE WHEN o_orderkey % 12 = 8 THEN '0' ELSE '17.0' END,
                 '}}}},"confidence":', CASE WHEN o_orderkey % 12 = 9 THEN '1.1' ELSE '1' END, '}}}}],"trends":', CASE WHEN o_orderkey % 12 = 10 THEN '{{{{}}}}' ELSE '[]' END,
                 CASE WHEN o_orderkey % 12 = 3 THEN '' ELSE ',"risks":[]' END, CASE WHEN o_orderkey % 12 = 2 THEN ',"html":1' ELSE '' END,
                 ',"opportunities":[],"recommendedVisuals":[', CASE WHEN o_orderkey % 7 = 0 THEN '5,' ELSE '' END,
                 '{{{{"type":"line","factIds":["f1"', CASE WHEN o_orderkey % 5 = 0 THEN ',"f9"' ELSE '' END, CASE WHEN o_orderkey % 11 = 0 THEN ',7' ELSE '' END, ']}}}}]}}}}',
                 CASE WHEN o_orderkey % 48 = 13 THEN ' junk' WHEN o_orderkey % 48 = 37 THEN ']' ELSE '' END) END AS raw
        FROM {{orders}}""".replace("{{{{", "{{").replace("}}}}", "}}"),
    "b_sales": """
        SELECT r_name, n_name, c_custkey, o_orderdate, l_extendedprice, l_discount
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
        JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "b_claims": "SELECT item_id AS claim_id, text AS claim, item_id AS query_id, text FROM {benchmark}",
    "b_texts": "SELECT doc_id, text FROM {documents}",
    "b_events": """
        SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id AS job, value,
               CASE event_type WHEN 'signup' THEN 'extraction' WHEN 'view' THEN 'retrieval' WHEN 'click' THEN 'analysis'
                    WHEN 'purchase' THEN 'rendering' ELSE 'repair' END AS stage FROM {events}""",
    "b_artifacts": "SELECT o_orderkey AS artifact_id, o_custkey AS account, o_orderdate AS created FROM {orders}",
    "b_entitled": "SELECT c_custkey AS account FROM {customer} WHERE c_acctbal > 0",
    "b_model_runs": """
        SELECT concat('model', CAST(CAST(substr(source, 4) AS INT) % 4 AS STRING)) AS model, quality AS correct, n_chars AS cost
        FROM {documents} JOIN {labels} USING (doc_id)""",
    "b_fixtures": """
        SELECT doc_id AS fixture_id, CASE CAST(substr(source, 4) AS INT) % 5 WHEN 0 THEN 'synthetic' WHEN 1 THEN 'licensed'
               WHEN 2 THEN 'anonymized' WHEN 3 THEN 'opted-in' ELSE 'private' END AS provenance FROM {documents}""",
    "b_strings": "SELECT concat('p', CAST(page_id AS STRING)) AS id, html AS s FROM {pages} UNION ALL SELECT concat('d', CAST(doc_id AS STRING)), text FROM {documents}",
    "b_renders": """
        SELECT concat('deck', CAST(o_orderkey AS STRING)) AS output_path, CAST(o_orderkey % 4 AS INT) AS n,
               o_orderstatus AS w FROM {orders}""",
}


#: Inputs that are parsed or searched at length, and so are dealt to all cores; of those whose rows are many and short, the rows that a task gets at most.
DEALT = ("b_analyses", "b_texts")
ROWS = {"b_analyses": 100_000}


def scan(spark: SparkSession, path: str, dealt: bool, rows: int | None = None) -> DataFrame:
    """A table; ``dealt`` to all cores if its files make fewer partitions than there are, as one small file does, and to as many tasks as have ``rows`` rows each."""
    df = spark.read.parquet(path)
    if not dealt:
        return df
    tasks = max(spark.sparkContext.defaultParallelism, -(-df.count() // rows) if rows else 0)
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The bound input ``name`` over the tables in ``sf_dir``."""
    text = SQL[name]
    tables = {t: scan(spark, f"{sf_dir}/{t}.parquet", name in DEALT, ROWS.get(name)) for t in set(re.findall(r"(?<!\{)\{(\w+)\}", text))}
    return spark.sql(text, **tables)


def duck(*names: str) -> str:
    """The same inputs as common table expressions for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({re.sub(r'(?<!{){(\w+)}', r'\1', SQL[n]).replace('{{', '{').replace('}}', '}')})" for n in names)
