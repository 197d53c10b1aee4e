"""The analysis contract: checks, and facts, sentences and visuals as rows.

A document is parsed once to a variant. Its root, sentences and facts become rows,
and the rules of each one array of path and keyword over plain columns, so the
check needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import member, number_of, string_of, with_json

#: Fixed values of the analysis contract.
VERSION = "0.1"
LISTS = ("executiveSummary", "facts", "trends", "risks", "opportunities", "recommendedVisuals")
MEMBERS = ("schemaVersion", *LISTS)
FACT_STRINGS = ("id", "metric", "unit", "period")
FACT_MEMBERS = ("id", "metric", "value", "unit", "period", "source", "confidence")


def _rule(broken: Column, path: Column, keyword: str) -> Column:
    return F.when(F.coalesce(broken, F.lit(False)), F.struct(path.alias("path"), F.lit(keyword).alias("keyword")))


def _extra_keys(v: Column, names: tuple[str, ...]) -> Column:
    """Whether an object has other keys than ``names``; null for what is no object."""
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    return F.size(F.array_except(keys, F.array(*map(F.lit, names)))) > 0


#: Schemas of numbers, and of facts whose members are all there, no others, and of the right types, but for pages that are no integers.
NUMERIC = r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"
SOUND_FACT = r"^OBJECT<confidence: (BIGINT|DOUBLE|DECIMAL\(\d+,\d+\)), id: STRING, metric: STRING, period: STRING, source: OBJECT<page: (BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))>, unit: STRING, value: (BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))>$"


def _integer(schema: Column, value: Column) -> Column:
    """Whether a number, by its schema and its value as a double, is an integer; 17.0 is one."""
    return schema.isNotNull() & (F.rlike(schema, F.lit(r"^(BIGINT|DECIMAL\(\d+,0\))$")) | (F.rlike(schema, F.lit(NUMERIC)) & (value == F.floor(value))))


def _list(v: Column, path: str) -> Column:
    """The members of an array; null for what is no array."""
    return F.try_variant_get(v, path, "array<variant>")


def _is_version(v: Column) -> Column:
    return (F.schema_of_variant(member(v, "$.schemaVersion")) == "STRING") & (F.try_variant_get(v, "$.schemaVersion", "string") == VERSION)


def _root_ok(v: Column) -> Column:
    """Whether a document breaks no rule of its root."""
    ok = _is_version(v)
    for k in LISTS:
        ok = ok & _list(v, f"$.{k}").isNotNull()
    keys = F.sort_array(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))
    return F.coalesce(ok & (keys == F.array(*map(F.lit, sorted(MEMBERS)))), F.lit(False))


def _sentence_ok(item: Column) -> Column:
    """Whether a sentence breaks no rule."""
    return F.coalesce((F.schema_of_variant(item) == "STRING") & (F.length(F.try_variant_get(item, "$", "string")) > 0), F.lit(False))


def _fact_ok(item: Column) -> Column:
    """Whether a fact breaks no rule, by its schema and a few values."""
    number = lambda path: F.try_variant_get(item, path, "double")
    page = number("$.source.page")
    ok = F.rlike(F.schema_of_variant(item), F.lit(SOUND_FACT)) & (page >= 1) & _integer(F.schema_of_variant(member(item, "$.source.page")), page) & number("$.confidence").between(0, 1)
    for k in FACT_STRINGS:
        ok = ok & (F.length(F.try_variant_get(item, f"$.{k}", "string")) > 0)
    return F.coalesce(ok, F.lit(False))


def _sound(part: Column, item: Column) -> Column:
    """Whether a root, fact or sentence breaks no rule: most need no closer look."""
    return F.when(part == "root", _root_ok(item)).when(part == "fact", _fact_ok(item)).otherwise(_sentence_ok(item))


def valid_analyses(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Rows of ``df`` in which ``analysis_violations`` finds nothing. A row is judged where it stands: nothing is shuffled or read twice."""
    v = F.col("__v")
    rows = with_json(df, raw_col, "__v").withColumn("__v", F.explode(F.array(v)))  # rows of a generator: a filter would move below a plain column and parse at each mention
    return rows.where(_root_ok(v) & F.forall(_list(v, "$.executiveSummary"), _sentence_ok) & F.forall(_list(v, "$.facts"), _fact_ok)).drop("__v")


def _missing(keys: Column, names: tuple[str, ...], at: Column) -> Column:
    """An array of the rules that members which ``keys`` lack break; null for what is no object."""
    return F.transform(F.array_except(F.array(*map(F.lit, names)), keys), lambda k: F.struct(F.concat(at, F.lit("/"), k).alias("path"), F.lit("required").alias("keyword")))


def _all(rules: list[Column], missing: Column) -> Column:
    return F.concat(F.array_compact(F.array(*rules)), F.coalesce(missing, F.array().cast("array<struct<path:string,keyword:string>>")))


def _string_rules(schema: Column, text: Column, path: Column) -> list[Column]:
    return [_rule(schema != "STRING", path, "type"), _rule((schema == "STRING") & (F.length(text) < 1), path, "minLength")]


def _root_rules() -> Column:
    item, keys = F.col("item"), F.map_keys("members")
    there = lambda k: F.array_contains(keys, k)
    rules = [_rule(keys.isNull(), F.lit(""), "type"), _rule(F.size(F.array_except(keys, F.array(*map(F.lit, MEMBERS)))) > 0, F.lit(""), "additionalProperties")]
    rules.append(_rule(there("schemaVersion") & ~F.coalesce(_is_version(item), F.lit(False)), F.lit("/schemaVersion"), "const"))
    rules += [_rule(there(k) & _list(item, f"$.{k}").isNull(), F.lit(f"/{k}"), "type") for k in LISTS]
    return F.when(item.isNull(), F.array(F.struct(F.lit("").alias("path"), F.lit("parse").alias("keyword")))).otherwise(_all(rules, _missing(keys, MEMBERS, F.lit(""))))


def _fact_rules() -> Column:
    at = lambda tail="": F.concat(F.lit("/facts/"), F.col("pos").cast("string"), F.lit(tail))
    item, keys, schema = F.col("item"), F.map_keys("members"), lambda k: F.col("schemas")[k]
    number = lambda path: F.try_variant_get(item, path, "double")
    numeric = lambda s: F.rlike(s, F.lit(NUMERIC))
    has_source, source, c = schema("source").startswith("OBJECT"), F.map_keys(F.try_variant_get(item, "$.source", "map<string,variant>")), number("$.confidence")
    page = F.col("page_schema")
    rules = [_rule(keys.isNull(), at(), "type"), _rule(F.size(F.array_except(keys, F.array(*map(F.lit, FACT_MEMBERS)))) > 0, at(), "additionalProperties")]
    for k in FACT_STRINGS:
        rules += _string_rules(schema(k), F.try_variant_get(item, f"$.{k}", "string"), at(f"/{k}"))
    rules.append(_rule(~numeric(schema("value")), at("/value"), "type"))
    rules += [_rule(~has_source, at("/source"), "type"), _rule(has_source & (F.size(F.array_except(source, F.array(F.lit("page")))) > 0), at("/source"), "additionalProperties"), _rule(has_source & page.isNull(), at("/source/page"), "required")]
    rules += [_rule(page.isNotNull() & ~F.coalesce(_integer(page, number("$.source.page")), F.lit(False)), at("/source/page"), "type"), _rule(numeric(page) & (number("$.source.page") < 1), at("/source/page"), "minimum")]
    confident = numeric(schema("confidence"))
    rules += [_rule(~confident, at("/confidence"), "type"), _rule(confident & (c < 0), at("/confidence"), "minimum"), _rule(confident & (c > 1), at("/confidence"), "maximum")]
    return _all(rules, _missing(keys, FACT_MEMBERS, at()))


def analysis_violations(df: DataFrame, id_col: str = "analysis_id", raw_col: str = "raw") -> DataFrame:
    """(analysis_id, path, keyword): a row for each broken rule; what isn't JSON breaks the rule "parse".

    A document is parsed once; its root, sentences and facts become rows, so that rules
    are compiled as plain columns. Nothing is shuffled.
    """
    v = _parsed(df, id_col, raw_col)
    part = lambda name, x, i: F.struct(F.lit(name).alias("part"), i.cast("int").alias("pos"), x.alias("item"))
    items = lambda k, name: F.coalesce(F.transform(_list(F.col("v"), f"$.{k}"), lambda x, i: part(name, x, i)), F.array().cast("array<struct<part:string,pos:int,item:variant>>"))
    parts = F.concat(F.array(part("root", F.col("v"), F.lit(0))), items("executiveSummary", "sentence"), items("facts", "fact"))
    unsound = F.filter(parts, lambda x: ~_sound(x["part"], x["item"]))  # in a lambda: as a filter of rows it took longer, probably since its generated method is too long for the JVM to compile
    rows = v.select("analysis_id", F.explode(unsound).alias("x")).select("analysis_id", "x.*")
    root, fact, sentence = (F.col("part") == p for p in ("root", "fact", "sentence"))
    item = F.col("item")
    rows = rows.withColumn("members", F.when(~sentence, F.try_variant_get(item, "$", "map<string,variant>")))
    rows = rows.withColumn("schemas", F.when(fact, F.transform_values("members", lambda _, x: F.schema_of_variant(x)))).withColumn("page_schema", F.when(fact, F.schema_of_variant(member(item, "$.source.page"))))
    said = _string_rules(F.schema_of_variant(item), F.try_variant_get(item, "$", "string"), F.concat(F.lit("/executiveSummary/"), F.col("pos").cast("string")))
    broken = F.when(root, _root_rules()).when(fact, _fact_rules()).otherwise(F.array_compact(F.array(*said)))
    return rows.select("analysis_id", F.explode(broken).alias("r")).select("analysis_id", "r.path", "r.keyword")


def _items(v: DataFrame, name: str) -> DataFrame:
    """(analysis_id, pos, item): the members of an array of each document."""
    return v.select("analysis_id", F.posexplode(_list(F.col("v"), f"$.{name}")).alias("pos", "item"))


def analysis_minimum_ok(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """``df`` with minimum_ok: the version is the string "0.1" and facts is an array."""
    v = F.col("__v")
    ok = _is_version(v) & _list(v, "$.facts").isNotNull()
    return with_json(df, raw_col, "__v").withColumn("minimum_ok", F.coalesce(ok, F.lit(False))).drop("__v")


def _parsed(df: DataFrame, id_col: str, raw_col: str) -> DataFrame:
    return with_json(df.select(F.col(id_col).alias("analysis_id"), F.col(raw_col).alias("__raw")), "__raw", "v").select("analysis_id", "v")


def explode_facts(df: DataFrame, id_col: str = "analysis_id", raw_col: str = "raw") -> DataFrame:
    """A row for each fact, its place kept and its page flat: null for members that a document lacks or has in another type. A page of 17.0 is 17."""
    item = F.col("item")
    rows = _items(_parsed(df, id_col, raw_col), "facts").withColumn("p", number_of(item, "$.source.page"))
    page = F.when(F.col("p") == F.floor("p"), F.col("p").try_cast("int"))
    text = [string_of(item, f"$.{k}") for k in FACT_STRINGS]
    return rows.select("analysis_id", F.col("pos").alias("fact_pos"), text[0].alias("fact_id"), text[1].alias("metric"), number_of(item, "$.value").alias("value"), text[2].alias("unit"), text[3].alias("period"), page.alias("page"), number_of(item, "$.confidence").alias("confidence"))


def explode_summary(df: DataFrame, id_col: str = "analysis_id", raw_col: str = "raw") -> DataFrame:
    """A row for each member of the summary, its place kept; sentence is null for what is no string."""
    said = _items(_parsed(df, id_col, raw_col), "executiveSummary")
    return said.select("analysis_id", F.col("pos").alias("sentence_pos"), string_of(F.col("item"), "$").alias("sentence"))


def explode_visuals(df: DataFrame, id_col: str = "analysis_id", raw_col: str = "raw") -> DataFrame:
    """A row for each reference of a visual, its place kept. Visuals may be of any shape: ones without a list factIds have none; a reference that is no string has a null fact_id."""
    visuals = _items(_parsed(df, id_col, raw_col), "recommendedVisuals").select("analysis_id", F.col("pos").alias("visual_pos"), string_of(F.col("item"), "$.type").alias("visual_type"), F.try_variant_get("item", "$.factIds", "array<variant>").alias("refs"))
    rows = visuals.select("analysis_id", "visual_pos", "visual_type", F.posexplode("refs").alias("ref_pos", "ref"))
    return rows.select("analysis_id", "visual_pos", "visual_type", "ref_pos", string_of(F.col("ref"), "$").alias("fact_id"))


def resolve_visual_facts(visuals: DataFrame, facts: DataFrame) -> DataFrame:
    """Visuals with the metric and value of the facts that they name; of repeated ids the first fact counts."""
    first = facts.groupBy("analysis_id", "fact_id").agg(F.min_by(F.struct("metric", "value"), "fact_pos").alias("f"))
    return visuals.join(first, ["analysis_id", "fact_id"]).select("analysis_id", "visual_pos", "ref_pos", "fact_id", "f.metric", "f.value")


def dangling_visual_refs(visuals: DataFrame, facts: DataFrame) -> DataFrame:
    """References to no fact of their analysis; those that are no string too."""
    return visuals.join(facts.select("analysis_id", "fact_id").distinct(), ["analysis_id", "fact_id"], "left_anti").select("analysis_id", "visual_pos", "ref_pos", "fact_id")
