"""Source sections: splitting, retrieval, figures, citations, markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import not_blank
from ..sources.tables import discard, written

LINES_PER_PAGE = 10
#: The part of a query's terms that is looked up first, and how many times more in each further round at most.
FIRST_PART, MORE_TERMS = 3, 4
FIGURE = r"[$€£]?[0-9][0-9,]*(?:[.][0-9]+)?%?"
MARKUP = r"<[A-Za-z/!][^>]*>"


def split_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, page, text): the lines that aren't blank; lines count from 0, pages of ten lines from 1."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "text"))
    return lines.where(not_blank(F.col("text"))).select("doc_id", "line_no", (1 + F.floor(F.col("line_no") / LINES_PER_PAGE)).cast("int").alias("page"), "text")


def terms(col) -> F.Column:
    """Distinct lower-case words of a to z."""
    return F.array_distinct(F.filter(F.split(F.lower(col), "[^a-z]+"), lambda t: t != ""))


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query with their rank; each task keeps ``k`` a query before they are shuffled."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "line_no")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _retrieve(sections: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best sections of each query, by its terms from the rarest on, as many as it takes.

    A section without any of a query's j rarest terms, of m that the sections hold, scores
    m - j at most. Rounds look up the sections of ever more terms; each section is scored
    once, where its rarest shared term is looked up. Once the k-th best score is above
    m - j, what is left can't reach it, and the query is done.
    """
    held = written(sections.select("doc_id", "line_no", terms(F.col("text")).alias("held")).where(F.size("held") > 0).withColumn("section", F.monotonically_increasing_id()))
    asked = queries.select("query_id", F.explode(terms(F.col("text"))).alias("term")).distinct()
    posting = held.select("section", F.explode("held").alias("term"))
    counts = posting.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("n", "term"))
    asked = written(asked.join(counts, "term").select("query_id", "term", place.alias("place")))
    lists = written(asked.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("terms"), F.count("*").alias("m")))
    best, tables = None, [asked]
    state = lists.select("query_id", F.lit(0).cast("long").alias("low"), F.ceil(F.col("m") / FIRST_PART).alias("high"), F.lit(1).cast("long").alias("least"))
    while state is not None:
        looked_up = written(asked.join(state, "query_id").where("place > low and place <= high").select("query_id", "term", "place", "least"))
        met = posting.join(looked_up, "term").groupBy("query_id", "section").agg(F.min("place").alias("place"), F.first("least").alias("least"))
        pairs = met.join(held, "section").where(F.size("held") >= F.col("least")).join(lists.select("query_id", "terms"), "query_id").withColumn("shared", F.array_intersect("terms", "held"))
        first = F.element_at("terms", F.col("place").cast("int")) == F.col("shared")[0]
        found = pairs.where(first).select("query_id", "doc_id", "line_no", F.size("shared").cast("long").alias("score"))
        best = written(_best(found if best is None else found.unionByName(best.drop("rank")), k))
        kth = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(1).alias("kth"))
        state = state.join(lists.select("query_id", "m"), "query_id").join(kth, "query_id", "left").withColumn("least", F.coalesce("kth", "least"))
        state = written(state.select("query_id", F.col("high").alias("low"), F.least(F.col("high") * MORE_TERMS, F.col("m") - F.col("least") + 1).alias("high"), "least").where("high > low"))
        tables += [looked_up, state, best]
        if not state.limit(1).count():
            state = None
    discard(lists, held, *[t for t in tables if t is not best])
    return best


def retrieve_sections(sections: DataFrame, queries: DataFrame, k: int, scope: str = "all", job_col: str = "doc_id") -> DataFrame:
    """The ``k`` sections of each query that hold most of its different terms, of equals the first by doc_id and line_no.

    scope "all" looks up a query's rarest terms first and stops once no other section can
    be among the best; sections and queries meet by joins, which Catalyst broadcasts or
    shuffles by size. scope "job" looks only into sections whose ``job_col`` is the
    query's, by a join on both. Rows that repeat a query_id are one query of all their
    terms; sections without any of a query's terms, null texts too, aren't found.
    """
    if scope == "all":
        return _retrieve(sections, queries, k)
    q = queries.select("query_id", job_col, F.explode(terms(F.col("text"))).alias("term")).distinct()
    s = sections.select(*dict.fromkeys(["doc_id", "line_no", job_col]), F.explode(terms(F.col("text"))).alias("term"))
    return _best(s.join(q, ["term", job_col]).groupBy("query_id", "doc_id", "line_no").agg(F.count("*").alias("score")), k)


def extract_mentions(sections: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, mention_no, raw, value, unit_class): the figures of each section."""
    raw = sections.select("doc_id", "page", "line_no", F.posexplode(F.regexp_extract_all("text", F.lit(FIGURE), F.lit(0))).alias("mention_no", "raw"))
    unit = F.when(F.col("raw").endswith("%"), "percent").when(F.rlike("raw", F.lit("^[$€£]")), "currency").otherwise("none")
    return raw.withColumn("value", F.regexp_replace("raw", "[^0-9.]", "").try_cast("double")).withColumn("unit_class", unit)


def check_citations(facts: DataFrame, sections: DataFrame) -> DataFrame:
    """``facts`` (doc_id, page, value_text) with status page_missing, value_absent or grounded; only cited pages are put together."""
    cited = facts.select("doc_id", "page").distinct()
    pages = sections.join(cited, ["doc_id", "page"], "left_semi").groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("page_text"))
    status = F.when(F.col("page_text").isNull(), "page_missing").when(F.contains("page_text", "value_text"), "grounded").otherwise("value_absent")
    return facts.join(pages, ["doc_id", "page"], "left").withColumn("status", status).drop("page_text")


def find_markup(strings: DataFrame, col: str = "s") -> DataFrame:
    """Rows whose string holds a tag."""
    return strings.where(F.rlike(col, F.lit(MARKUP)))
