"""Registered queries, one or more for each operator, and independent DuckDB SQL for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import job_short_id, with_json
from ..operators import contract, deck, facts, golden, requests, sections, telemetry
from ..sources.json_io import read_analyses, read_requests, write_analyses, write_jobs
from ..sources.tables import new_folder as _folder
from ..sources.tables import written
from ..streaming import jobs as streams
from .bindings import bind, duck

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
LAYOUTS = [("title", 1, 120), ("short", 3, 300), ("list", 5, 900), ("dense", 6, 2500)]
PER_SLIDE, TOP_K, MAX_REPAIRS = 5, 5, 3


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


DIGEST = "sha256(coalesce(source_text, '')) AS source"


def _digest(df: DataFrame) -> DataFrame:
    return df.withColumn("source", F.sha2(F.coalesce("source_text", F.lit("")), 256)).drop("source_text")


@query(duck("b_requests") + """, r AS (SELECT *, request_id % 9 = 0 AS bad FROM b_requests) SELECT CASE WHEN NOT bad THEN input_mode END AS input_mode, CASE WHEN NOT bad THEN file_name END AS file_name,
    CASE WHEN NOT bad THEN deck_purpose END AS deck_purpose, CASE WHEN NOT bad THEN slide_count END AS slide_count, bad::BIGINT AS n_type_errors, sha256(CASE WHEN bad THEN '' ELSE coalesce(source_text, '') END) AS source FROM r""")
def c1_parse_requests(spark, d):
    """Requests written as lines of JSON and read by the source; on every ninth line something follows the request."""
    path = _folder(spark)
    more = F.when(F.col("request_id") % 9 > 0, "").when(F.col("request_id") % 2 == 0, " {}").otherwise("}")
    bind(spark, d, "b_requests").select(F.concat(F.to_json(F.struct("input_mode", "source_text", "file_name", "deck_purpose", "slide_count")), more)).write.text(path)
    return _digest(read_requests(spark, path)).withColumn("n_type_errors", F.size("type_errors").cast("long")).drop("type_errors")


@query(duck("b_forms") + """ SELECT request_id, ifnull(input_mode, 'file') AS input_mode, file_name, ifnull(deck_purpose, 'management-review') AS deck_purpose,
    ifnull(slide_count, 10) AS slide_count, sha256(ifnull(source_text, '')) AS source FROM b_forms""")
def c2_form_defaults(spark, d):
    return _digest(requests.with_request_defaults(bind(spark, d, "b_forms")))


@query(duck("b_requests") + """ SELECT request_id, CASE input_mode WHEN 'file' THEN file_name END AS file_name,
    sha256(CASE input_mode WHEN 'text' THEN ifnull(source_text, '') ELSE '' END) AS source FROM b_requests""")
def c3_source_by_mode(spark, d):
    return _digest(requests.select_source_by_mode(bind(spark, d, "b_requests"))).select("request_id", "file_name", "source")


_VALID = duck("b_requests") + """, v AS (SELECT *, concat_ws(',', CASE WHEN request_id % 10 = 9 THEN 'input_mode' END, CASE WHEN request_id % 4 = 3 THEN 'deck_purpose' END,
    CASE WHEN request_id % 24 < 5 OR request_id % 24 > 20 THEN 'slide_count' END) AS f FROM b_requests),
    e AS (SELECT *, CASE WHEN f <> '' THEN f WHEN request_id % 10 < 8 AND (request_id % 7 = 0 OR NOT regexp_matches(ifnull(source_text, ''), '\\S')) THEN 'source_text is required when input_mode is text'
      WHEN request_id % 20 = 8 THEN 'file_name is required when input_mode is file' ELSE '' END AS errors FROM v)"""


@query(_VALID + " SELECT request_id, errors FROM e")
def c4_validate_requests(spark, d):
    return requests.validate_requests(bind(spark, d, "b_requests")).select("request_id", F.array_join("errors", ",").alias("errors"))


@query(_VALID + " SELECT request_id, errors FROM e WHERE errors LIKE '%required%'")
def c5_source_rule(spark, d):
    v = requests.validate_requests(bind(spark, d, "b_requests"))
    return v.select("request_id", F.array_join("errors", ",").alias("errors")).where(F.col("errors").isin(requests.SOURCE_REQUIRED, requests.FILE_REQUIRED))


@query(_VALID + " SELECT request_id, CASE errors WHEN '' THEN 202 ELSE 422 END AS code FROM e")
def c6_route_requests(spark, d):
    ok, bad = requests.route_requests(requests.validate_requests(bind(spark, d, "b_requests")))
    return ok.select("request_id", F.lit(202).alias("code")).union(bad.select("request_id", F.lit(422).alias("code")))


_ID = r"regexp_replace(sha256(CAST(request_id AS VARCHAR))[1:32], '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5')"


def _jobs(spark, d) -> DataFrame:
    ok, _ = requests.route_requests(requests.validate_requests(bind(spark, d, "b_requests")))
    return requests.enqueue_jobs(ok, "request_id")


@query(_VALID + f" SELECT request_id, {_ID} AS id, 'queued' AS status, input_mode, file_name, deck_purpose, slide_count, {DIGEST} FROM e WHERE errors = ''")
def c7_enqueue_jobs(spark, d):
    return _digest(_jobs(spark, d))


@query(_VALID + " SELECT request_id, sha256(CAST(request_id AS VARCHAR))[1:8] AS short_id FROM e WHERE errors = ''")
def c8_short_id(spark, d):
    return _jobs(spark, d).select("request_id", job_short_id(F.col("id")).alias("short_id"))


@query(duck("b_analyses") + " SELECT analysis_id, length(raw) AS n_chars, fault <> 1 AS is_json FROM b_analyses")
def c9_parse_analyses(spark, d):
    a = with_json(bind(spark, d, "b_analyses"), "raw", "v")
    return a.select("analysis_id", F.length("raw").cast("long").alias("n_chars"), F.col("v").isNotNull().alias("is_json"))


@query(duck("b_analyses") + " SELECT analysis_id, fault NOT IN (1, 4) AS minimum_ok FROM b_analyses")
def c10_minimum_check(spark, d):
    return contract.analysis_minimum_ok(bind(spark, d, "b_analyses")).select("analysis_id", "minimum_ok")


@query(duck("b_analyses") + """, r AS (SELECT * FROM (VALUES (1, '', 'parse'), (2, '', 'additionalProperties'), (3, '/risks', 'required'), (4, '/schemaVersion', 'const'),
    (5, '/executiveSummary/0', 'minLength'), (6, '/facts/0/unit', 'required'), (7, '/facts/0/value', 'type'), (8, '/facts/0/source/page', 'minimum'),
    (9, '/facts/0/confidence', 'maximum'), (10, '/trends', 'type'), (11, '/facts/0/unit', 'type')) t(fault, path, keyword))
    SELECT analysis_id, path, keyword FROM b_analyses JOIN r USING (fault)""")
def c11_contract_violations(spark, d):
    return contract.analysis_violations(bind(spark, d, "b_analyses"))


def _valid(spark, d) -> DataFrame:
    """Analyses that the contract finds nothing wrong with."""
    return contract.valid_analyses(bind(spark, d, "b_analyses"))


@query("""SELECT o_orderkey AS analysis_id, 0 AS fact_pos, 'f1' AS fact_id, 'Total' AS metric, o_orderkey::DOUBLE AS value, 'USD' AS unit, 'Q2 1996' AS period, 17 AS page, 1.0::DOUBLE AS confidence
    FROM orders WHERE o_orderkey % 12 = 0""")
def c12_explode_facts(spark, d):
    return contract.explode_facts(_valid(spark, d))


@query("""SELECT o_orderkey AS analysis_id, i AS sentence_pos, CASE i WHEN 0 THEN 'Order ' || o_orderkey ELSE 'Second sentence.' END AS sentence
    FROM orders, (VALUES (0), (1)) t(i) WHERE o_orderkey % 12 = 0""")
def c13_explode_summary(spark, d):
    return contract.explode_summary(_valid(spark, d))


_VISUAL = "SELECT o_orderkey AS analysis_id, CASE o_orderkey % 7 WHEN 0 THEN 1 ELSE 0 END AS visual_pos"


def _resolved(spark, d, how) -> DataFrame:
    valid = written(_valid(spark, d))
    return how(contract.explode_visuals(valid), contract.explode_facts(valid))


@query(_VISUAL + ", 0 AS ref_pos, 'f1' AS fact_id, 'Total' AS metric, o_orderkey::DOUBLE AS value FROM orders WHERE o_orderkey % 12 = 0")
def c14_resolve_visuals(spark, d):
    return _resolved(spark, d, contract.resolve_visual_facts)


@query(f"""{_VISUAL}, 1 AS ref_pos, 'f9' AS fact_id FROM orders WHERE o_orderkey % 12 = 0 AND o_orderkey % 5 = 0
    UNION ALL {_VISUAL}, CASE o_orderkey % 5 WHEN 0 THEN 2 ELSE 1 END, NULL FROM orders WHERE o_orderkey % 12 = 0 AND o_orderkey % 11 = 0""")
def c14_dangling_visuals(spark, d):
    return _resolved(spark, d, contract.dangling_visual_refs)


@query("""SELECT doc_id AS request_id, CASE WHEN n >= 0 AND n = floor(n) THEN 'pending' END AS status, CASE WHEN n >= 0 AND n = floor(n) THEN n::INT END AS slides,
    CASE WHEN n >= 0 AND n = floor(n) THEN NULL ELSE 'slideCount must be a non-negative integer' END AS error
    FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE (doc_id % 24 - 4) / 2.0 END AS n FROM documents)""")
def c15_preflight(spark, d):
    b = bind(spark, d, "b_requests").select("request_id", F.when(F.col("request_id") % 5 != 0, (F.col("slide_count") - 4) / 2.0).alias("slide_count"))
    r = deck.preflight_report(b)
    return r.select("request_id", "report.status", F.col("report.slide_count").alias("slides"), "error")


def _renders(spark, d) -> DataFrame:
    n = F.col("n")
    return bind(spark, d, "b_renders").select("output_path", F.when(n == 3, F.lit(None)).otherwise(F.array_repeat("w", n)).alias("warnings"))


@query(duck("b_renders") + " SELECT output_path, w AS warning FROM b_renders WHERE n IN (1, 2) UNION ALL SELECT output_path, w FROM b_renders WHERE n = 2 UNION ALL SELECT output_path, NULL FROM b_renders WHERE n IN (0, 3)")
def c16_render_warnings(spark, d):
    return deck.render_warnings(_renders(spark, d))


@query(duck("b_renders") + " SELECT output_path, (CASE n WHEN 3 THEN 0 ELSE n END)::BIGINT AS n_warnings FROM b_renders")
def c16_warning_counts(spark, d):
    return deck.count_warnings(_renders(spark, d))


@query(_VALID + f" SELECT request_id, {_ID} AS id, status, slide_count FROM (SELECT *, 'queued' AS status FROM e) WHERE errors = ''")
def c17_write_jobs(spark, d):
    path = _folder(spark)
    write_jobs(_jobs(spark, d), path)
    return spark.read.schema("request_id long, id string, slide_count int, status string").json(path)


@query(duck("b_analyses") + " SELECT CASE fault WHEN 1 THEN 'none' ELSE '0.1' END AS schema_version, count(*) AS n, sum(length(raw))::BIGINT AS n_chars FROM b_analyses GROUP BY 1")
def c17_write_analyses(spark, d):
    path = _folder(spark)
    write_analyses(bind(spark, d, "b_analyses"), path)
    back = spark.read.schema("value string, schema_version string").text(path)
    return back.groupBy("schema_version").agg(F.count("*").alias("n"), F.sum(F.length("value").cast("long")).alias("n_chars"))


_LINES = """, lines AS (SELECT doc_id, i - 1 AS line_no, (1 + (i - 1) // 10)::INT AS page, t AS text FROM
    (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM b_texts)) WHERE regexp_matches(t, '\\S'))"""


def _sections(spark, d) -> DataFrame:
    return sections.split_sections(bind(spark, d, "b_texts"))


@query(duck("b_texts") + _LINES + " SELECT doc_id, line_no::INT AS line_no, page, sha256(text) AS h FROM lines")
def d1_split_sections(spark, d):
    return _sections(spark, d).withColumn("h", F.sha2("text", 256)).drop("text")


@query(duck("b_texts", "b_claims") + _LINES + """, q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM b_claims),
    s AS (SELECT DISTINCT doc_id, line_no, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM lines),
    c AS (SELECT query_id, doc_id, line_no, count(*) AS score FROM s JOIN q USING (term) GROUP BY ALL)
    SELECT query_id, doc_id, line_no::INT AS line_no, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, line_no)::INT AS rank FROM c QUALIFY rank <= 5""")
def d2_retrieve(spark, d):
    return sections.retrieve_sections(_sections(spark, d), bind(spark, d, "b_claims").select("query_id", "text"), TOP_K)


@query(duck("b_texts") + _LINES + """, m AS (SELECT doc_id, page, line_no::INT AS line_no, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS i FROM
    (SELECT *, regexp_extract_all(text, '[$€£]?[0-9][0-9,]*(?:[.][0-9]+)?%?') AS l FROM lines))
    SELECT doc_id, page, line_no, i::INT AS mention_no, raw, try_cast(regexp_replace(raw, '[^0-9.]', '', 'g') AS DOUBLE) AS value,
      CASE WHEN raw LIKE '%\\%' ESCAPE '\\' THEN 'percent' WHEN raw[1] IN ('$', '€', '£') THEN 'currency' ELSE 'none' END AS unit_class FROM m""")
def d3_mentions(spark, d):
    return sections.extract_mentions(_sections(spark, d))


AMOUNT = "l_extendedprice * (1 - l_discount)"


def _facts(spark, d, entity: str) -> DataFrame:
    return facts.compute_facts(bind(spark, d, "b_sales"), F.col(entity), F.col("o_orderdate"), AMOUNT, 1 + F.col("qidx") % 20)


def _facts_sql(entity: str) -> str:
    return duck("b_sales") + f""", f AS (SELECT CAST({entity} AS VARCHAR) AS entity, (year(o_orderdate) * 4 + quarter(o_orderdate) - 1)::INT AS qidx,
        sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)))::DOUBLE AS value, count(*) AS input_rows FROM b_sales GROUP BY ALL),
        p AS (SELECT *, 'Q' || (qidx % 4 + 1) || ' ' || (qidx // 4) AS period FROM f)"""


_FACT_ID = r"regexp_replace(sha256('Revenue' || chr(31) || entity || chr(31) || qidx)[1:32], '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5')"


@query(_facts_sql("n_name") + f""" SELECT {_FACT_ID} AS id, entity, 'Revenue' AS metric, 'USD' AS unit, period, qidx, value, 'sum(l_extendedprice * (1 - l_discount))' AS formula,
    input_rows, (1 + qidx % 20)::INT AS page, 1.0::DOUBLE AS confidence FROM p""")
def d4_facts(spark, d):
    return _facts(spark, d, "n_name")


@query(_facts_sql("n_name") + " SELECT entity AS analysis_id, count(*) AS n_facts, sum(value) AS total, min((1 + qidx % 20)::INT) AS first_page, true AS minimum_ok FROM p GROUP BY entity")
def c9_read_analyses(spark, d):
    """Analyses written as files of one document each and read by the source; a file's folder names its analysis."""
    path, f = _folder(spark), _facts(spark, d, "n_name")
    built = facts.build_analysis(f, facts.compute_trends(f))
    built.select("analysis_id", F.col("raw").alias("value")).write.partitionBy("analysis_id").text(path)
    read = contract.analysis_minimum_ok(read_analyses(spark, path)).withColumn("name", F.url_decode(F.regexp_extract("analysis_id", "analysis_id=([^/]*)/", 1)))
    rows = contract.explode_facts(read).groupBy("analysis_id").agg(F.count("*").alias("n_facts"), F.sum("value").alias("total"), F.min("page").alias("first_page"))
    return read.join(rows, "analysis_id").select(F.url_decode("name").alias("analysis_id"), "n_facts", "total", "first_page", "minimum_ok")


def _trends_sql(entity: str) -> str:
    return _facts_sql(entity) + """ SELECT a.entity, a.period, a.value, b.value AS prior, CASE WHEN b.value <> 0 THEN round(100 * (a.value - b.value) / b.value, 4) END AS yoy_pct,
        CASE WHEN a.value > b.value THEN 'increased' WHEN a.value < b.value THEN 'decreased' WHEN a.value = b.value THEN 'flat' END AS direction
        FROM p a LEFT JOIN p b ON a.entity = b.entity AND a.qidx = b.qidx + 4"""


def _trends(spark, d, entity: str) -> DataFrame:
    return facts.compute_trends(_facts(spark, d, entity)).select("entity", "period", "value", "prior", "yoy_pct", "direction")


@query(_trends_sql("r_name"))
def d5_trends_region(spark, d):
    return _trends(spark, d, "r_name")


@query(_trends_sql("c_custkey"))
def d5_trends_customer(spark, d):
    return _trends(spark, d, "c_custkey")


@query(_facts_sql("n_name") + " SELECT entity AS analysis_id, count(*) AS n_facts, arg_min(period, qidx) AS first_period, arg_max(period, qidx) AS last_period, 0::BIGINT AS n_violations FROM p GROUP BY entity")
def d6_build_analysis(spark, d):
    f = _facts(spark, d, "n_name")
    path = _folder(spark)
    facts.build_analysis(f, facts.compute_trends(f)).write.parquet(path)  # read for its facts and for the check, built once
    built = spark.read.schema("analysis_id string, raw string").parquet(path)
    rows = contract.explode_facts(built).groupBy("analysis_id").agg(F.count("*").alias("n_facts"), F.min_by("period", "fact_pos").alias("first_period"), F.max_by("period", "fact_pos").alias("last_period"))
    bad = contract.analysis_violations(built).groupBy("analysis_id").agg(F.count("*").alias("v"))
    return rows.join(bad, "analysis_id", "left").select("analysis_id", "n_facts", "first_period", "last_period", F.coalesce("v", F.lit(0)).cast("long").alias("n_violations"))


@query(duck("b_texts") + _LINES + """, m AS (SELECT doc_id, line_no::INT AS line_no, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS i FROM
    (SELECT *, regexp_extract_all(text, '[$€£]?[0-9][0-9,]*(?:[.][0-9]+)?%?') AS l FROM lines))
    SELECT doc_id, line_no, i::INT AS mention_no, CASE doc_id % 3 WHEN 0 THEN 'page_missing' WHEN 1 THEN 'value_absent' ELSE 'grounded' END AS status FROM m""")
def d7_citations(spark, d):
    m = sections.extract_mentions(_sections(spark, d))
    n = F.col("doc_id") % 3
    made = m.select("doc_id", "line_no", "mention_no", F.when(n == 0, F.col("page") + 100_000).otherwise(F.col("page")).alias("page"), F.when(n == 1, F.concat(F.lit("~"), "raw")).otherwise(F.col("raw")).alias("value_text"))
    return sections.check_citations(made, _sections(spark, d)).select("doc_id", "line_no", "mention_no", "status")


@query(duck("b_strings") + " SELECT id FROM b_strings WHERE regexp_matches(s, '<[A-Za-z/!][^>]*>')")
def d8_markup(spark, d):
    return sections.find_markup(bind(spark, d, "b_strings")).select("id")


@query(duck("b_artifacts", "b_entitled") + " SELECT artifact_id, account IN (SELECT account FROM b_entitled) AS entitled FROM b_artifacts")
def d9_entitled(spark, d):
    yes, no = requests.entitled_requests(bind(spark, d, "b_artifacts"), bind(spark, d, "b_entitled"), "account")
    return yes.select("artifact_id", F.lit(True).alias("entitled")).union(no.select("artifact_id", F.lit(False).alias("entitled")))


def _slides(spark, d) -> DataFrame:
    s = _sections(spark, d)
    counts = bind(spark, d, "b_texts").select(F.col("doc_id").alias("job"), (5 + F.col("doc_id") % 16).cast("int").alias("slide_count"))
    return deck.compile_deckspec(s.select(F.col("doc_id").alias("job"), F.col("line_no").alias("ord"), "text"), counts, PER_SLIDE)


_SLIDES = _LINES + """, n AS (SELECT doc_id AS job, text, line_no, (1 + (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1) // 5)::INT AS slide_no FROM lines),
    slides AS (SELECT job, slide_no, count(*)::INT AS n_items, max(length(text))::INT AS longest, slide_no > 5 + job % 16 AS overflow, sha256(string_agg(text, chr(10) ORDER BY line_no)) AS h FROM n GROUP BY job, slide_no)"""


@query(duck("b_texts") + _SLIDES + " SELECT * FROM slides")
def d10_deckspec(spark, d):
    return _slides(spark, d).select("job", "slide_no", "n_items", "longest", "overflow", F.sha2(F.array_join("items", "\n"), 256).alias("h"))


_FIT = _SLIDES + """, fit AS (SELECT job, slide_no, CASE WHEN n_items <= 1 AND longest <= 120 THEN 'title' WHEN n_items <= 3 AND longest <= 300 THEN 'short'
    WHEN n_items <= 5 AND longest <= 900 THEN 'list' WHEN n_items <= 6 AND longest <= 2500 THEN 'dense' END AS layout FROM slides)"""


@query(duck("b_texts") + _FIT + " SELECT * FROM fit")
def d11_fit_layouts(spark, d):
    return deck.fit_layouts(_slides(spark, d), LAYOUTS).select("job", "slide_no", "layout")


@query(duck("b_texts") + _FIT + " SELECT job, coalesce(string_agg('no_layout:' || slide_no, ',' ORDER BY slide_no) FILTER (layout IS NULL), '') AS failures FROM fit GROUP BY job")
def d11_layout_failures(spark, d):
    return deck.layout_failures(deck.fit_layouts(_slides(spark, d), LAYOUTS))


@query(duck("b_events") + """ SELECT event_id, job, row_number() OVER (PARTITION BY job ORDER BY ts, event_id)::INT AS attempt,
    CASE WHEN attempt <= 3 THEN 'run' ELSE 'refused' END AS decision FROM b_events WHERE stage = 'repair'""")
def d12_bound_repairs(spark, d):
    return deck.bound_repairs(bind(spark, d, "b_events").where("stage = 'repair'"), MAX_REPAIRS, "job", "ts", "event_id").select("event_id", "job", "attempt", "decision")


_LATEST = duck("b_events") + " SELECT job, arg_max(stage, row(ts, event_id)) AS stage, count(*) AS n_events FROM b_events GROUP BY job"


@query(_LATEST)
def d13_job_status(spark, d):
    return telemetry.latest_job_status(bind(spark, d, "b_events"))


@query(duck("b_artifacts") + " SELECT account, arg_max(artifact_id, row(created, artifact_id)) AS latest_id FROM b_artifacts GROUP BY account")
def d14_latest_artifacts(spark, d):
    return deck.latest_artifacts(bind(spark, d, "b_artifacts"), "account", "created", "artifact_id").drop("latest_created")


@query(duck("b_requests") + " SELECT request_id, input_mode, file_name, deck_purpose, slide_count, length(source_text)::INT AS source_length, sha256(source_text) AS source_sha256 FROM b_requests")
def d15_log_view(spark, d):
    return requests.log_view(bind(spark, d, "b_requests"))


@query(duck("b_fixtures") + " SELECT fixture_id, provenance FROM b_fixtures WHERE provenance <> 'private'")
def d16_admit_fixtures(spark, d):
    return golden.admit_fixtures(bind(spark, d, "b_fixtures"))


@query(duck("b_fixtures") + " SELECT count(DISTINCT fixture_id) AS n_fixtures, count(DISTINCT fixture_id) >= 20 AS meets_target FROM b_fixtures WHERE provenance <> 'private'")
def d16_fixture_target(spark, d):
    return golden.fixture_target(bind(spark, d, "b_fixtures"))


def _expected(spark, d) -> tuple[DataFrame, DataFrame]:
    """Produced facts, and expected ones with faults by quarter: 11 dropped, 7 another value, 5 another unit, 3 another page."""
    produced = _facts(spark, d, "n_name").select(F.col("entity").alias("fixture_id"), "metric", "period", "value", "unit", "page", "qidx")
    q = F.col("qidx")
    changed = {"value": F.when(q % 7 == 0, F.col("value") * 1.1).otherwise(F.col("value")), "unit": F.when(q % 5 == 0, "EUR").otherwise(F.col("unit")), "page": F.when(q % 3 == 0, F.col("page") + 1).otherwise(F.col("page"))}
    return produced.where(q % 11 != 0).withColumns(changed).drop("qidx"), produced.where(q % 13 != 0).drop("qidx")


_OUTCOME = _facts_sql("n_name") + """, o AS (SELECT entity AS fixture_id, 'Revenue' AS metric, period, CASE WHEN qidx % 11 = 0 THEN 'unexpected' WHEN qidx % 13 = 0 THEN 'missing' WHEN qidx % 7 = 0 THEN 'value_mismatch'
    WHEN qidx % 5 = 0 THEN 'unit_mismatch' WHEN qidx % 3 = 0 THEN 'page_mismatch' ELSE 'match' END AS outcome FROM p WHERE NOT (qidx % 11 = 0 AND qidx % 13 = 0))"""


@query(_OUTCOME + " SELECT * FROM o")
def d17_score_facts(spark, d):
    return golden.score_facts(*_expected(spark, d))


@query(_OUTCOME + """ SELECT fixture_id, count(*) AS n, count(*) FILTER (outcome = 'match') AS n_match, n_match / n AS accuracy,
    n_match / nullif(count(*) FILTER (outcome <> 'missing'), 0) AS precision, n_match / nullif(count(*) FILTER (outcome <> 'unexpected'), 0) AS recall FROM o GROUP BY fixture_id""")
def d17_fact_accuracy(spark, d):
    return golden.fact_accuracy(golden.score_facts(*_expected(spark, d)))


_HITS = duck("b_texts", "b_claims") + ", hits AS (SELECT claim_id, doc_id FROM b_claims JOIN b_texts ON contains(b_texts.text, claim))"


def _claims(spark, d) -> DataFrame:
    return bind(spark, d, "b_claims").select("claim_id", "claim")


@query(_HITS + " SELECT claim_id AS finding_id FROM b_claims WHERE claim_id NOT IN (SELECT claim_id FROM hits)")
def d18_missing_findings(spark, d):
    """Required findings of one fixture, the whole corpus, that no document holds."""
    need = _claims(spark, d).select(F.lit(0).alias("fixture_id"), F.col("claim").alias("finding"), F.col("claim_id").alias("finding_id"))
    return golden.missing_findings(need, bind(spark, d, "b_texts").select(F.lit(0).alias("fixture_id"), "text"))[0].select("finding_id")


@query(duck("b_texts", "b_claims") + """, r AS (SELECT doc_id AS fixture_id, claim AS finding FROM b_texts JOIN b_claims ON claim_id = doc_id % (SELECT count(*) FROM b_claims))
    SELECT r.fixture_id, avg(CASE WHEN contains(b_texts.text, finding) THEN 1.0 ELSE 0.0 END)::DOUBLE AS coverage FROM r JOIN b_texts ON fixture_id = doc_id GROUP BY 1""")
def d18_finding_coverage(spark, d):
    """A finding for each document as a fixture, all of them in turn."""
    texts, claims = bind(spark, d, "b_texts").withColumnRenamed("doc_id", "fixture_id"), _claims(spark, d)
    need = texts.select("fixture_id", (F.col("fixture_id") % claims.count()).alias("claim_id")).join(claims.withColumnRenamed("claim", "finding"), "claim_id").drop("claim_id")
    return golden.missing_findings(need, texts)[1]


@query(_HITS + " SELECT * FROM hits")
def d19_forbidden_hits(spark, d):
    return golden.forbidden_hits(_claims(spark, d), bind(spark, d, "b_texts"))


@query(_facts_sql("n_name") + """, a AS (SELECT entity, period, value * (CASE WHEN qidx % 7 = 0 THEN 2 ELSE 1 END) AS value FROM p WHERE qidx % 11 <> 0), b AS (SELECT entity, period, value FROM p)
    (SELECT *, 'expected_only' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) UNION ALL (SELECT *, 'actual_only' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))""")
def d20_contract_diff(spark, d):
    f = _facts(spark, d, "n_name")
    e = f.where("qidx % 11 <> 0").withColumn("value", F.when(F.col("qidx") % 7 == 0, F.col("value") * 2).otherwise(F.col("value"))).select("entity", "period", "value")
    return golden.contract_diff(e, f.select("entity", "period", "value"))


@query(duck("b_texts") + _SLIDES + """, m AS (SELECT job, count(*) AS slides, max(n_items) AS most_items, max(longest) AS longest FROM slides GROUP BY job)
    SELECT job AS fixture_id, 'slides' AS measure, slides::BIGINT AS value, slides BETWEEN 1 AND 3 AS holds FROM m
    UNION ALL SELECT job, 'most_items', most_items, most_items BETWEEN 1 AND 4 FROM m UNION ALL SELECT job, 'longest', longest, longest BETWEEN 0 AND 500 FROM m""")
def d21_layout_assertions(spark, d):
    got = deck.measures(_slides(spark, d))
    limits = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(a).alias("min"), F.lit(b).alias("max")) for m, a, b in (("slides", 1, 3), ("most_items", 1, 4), ("longest", 0, 500))]))
    asserted = got.select("fixture_id").distinct().select("fixture_id", limits.alias("x")).select("fixture_id", "x.measure", "x.min", "x.max")
    return deck.check_layout_assertions(got, asserted).select("fixture_id", "measure", "value", "holds")


@query(duck("b_events") + """ SELECT stage, count(*) AS n, count(DISTINCT job) AS jobs, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95,
    sum(CAST(value AS DECIMAL(18,4)))::DOUBLE AS total, sum(CAST(value AS DECIMAL(18,4)))::DOUBLE / count(DISTINCT job) AS cost_per_job FROM b_events GROUP BY stage""")
def d22_stage_telemetry(spark, d):
    return telemetry.stage_telemetry(bind(spark, d, "b_events"))


@query(duck("b_model_runs") + """, m AS (SELECT model, avg(correct)::DOUBLE AS accuracy, avg(cost)::DOUBLE AS cost FROM b_model_runs GROUP BY model)
    SELECT *, row_number() OVER (ORDER BY accuracy DESC, cost, model)::INT AS rank, CASE rank WHEN 1 THEN 'primary' ELSE 'fallback' END AS choice FROM m QUALIFY rank <= 2""")
def d23_rank_models(spark, d):
    return telemetry.rank_models(bind(spark, d, "b_model_runs"))


@query(_VALID + " SELECT count(*) FILTER (errors = '') AS accepted, count(*) FILTER (errors <> '') AS rejected FROM (SELECT DISTINCT input_mode, source_text, file_name, deck_purpose, slide_count, errors FROM e)")
def d24_stream_intake(spark, d):
    """Requests written as JSON files twice over and taken in as a stream; each different one counts once."""
    src, out = _folder(spark), _folder(spark)
    lines = bind(spark, d, "b_requests").select(F.to_json(F.struct(*streams.KEY)).alias("value"))
    lines.union(lines).write.text(src)
    streams.stream_intake(spark, src, out, _folder(spark)).awaitTermination()
    count = lambda k: spark.read.parquet(f"{out}/{k}").agg(F.count("*").alias(k))
    pair = count("accepted").withColumn("k", F.lit(1)).join(count("rejected").withColumn("k", F.lit(1)), "k")
    return pair.select("accepted", "rejected")


def _event_stream(spark, d) -> DataFrame:
    """The bound events as files, read as a stream."""
    src = _folder(spark)
    bound = bind(spark, d, "b_events")
    bound.write.parquet(src)
    return spark.readStream.schema(bound.schema).parquet(src)


@query(_LATEST)
def d25_stream_progress(spark, d):
    out = _folder(spark)
    streams.stream_progress(_event_stream(spark, d), out, _folder(spark)).awaitTermination()
    return streams.read_progress(spark, out)


@query(duck("b_events") + """ SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, stage, count(*) AS n FROM b_events GROUP BY ALL
    HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM b_events) - INTERVAL 1 HOUR""")
def d25_stream_windows(spark, d):
    out = _folder(spark)
    streams.stream_stage_windows(_event_stream(spark, d), out, _folder(spark)).awaitTermination()
    return spark.read.parquet(out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
