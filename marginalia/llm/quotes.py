"""Chat formatting by linking quotations.

Lines of a message that begin with > are quotes, their number of marks the level.
Runs of lines of one level are quoted passages. Passages and single lines are
normalised, hashed and joined to what messages say themselves, in the same
conversation; a message answers the earlier one that it quotes most of. Threads
follow from those links, and messages come back without quotes, as rows with the
keys that put them in reply order, or as a record for each thread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected

#: Code points that a normalised quoted passage needs: short messages are answered too.
MIN_QUOTE = 1
#: Turns that one record of a thread spans at most, so that no thread makes a row without bound.
PART_TURNS = 512
_MARKS = r"^\s*(?:>\s?)+"


def _lines(text: Column) -> Column:
    """(level, text) of each line: the number of leading > marks, and the line without them."""
    marks = lambda line: F.regexp_extract(line, _MARKS, 0)
    return F.transform(F.split(text, "\n"), lambda line: F.struct(F.length(F.regexp_replace(marks(line), "[^>]", "")).alias("level"), F.regexp_replace(line, _MARKS, "").alias("text")))


def _norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s]+", " "))


def _passages(lines: Column) -> Column:
    """(level, text) of each maximal run of quoted lines of one level: lines split where the level changes, each run joined once."""

    def of(x: Column) -> Column:
        changes = F.transform(x, lambda line, i: F.when((i == 0) | (F.element_at(x, F.greatest(i, F.lit(1)))["level"] != line["level"]), i + 1))
        starts = F.filter(changes, lambda i: i.isNotNull())
        ends = F.concat(F.slice(starts, 2, F.size(x)), F.array(F.size(x) + 1))
        runs = F.filter(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda r: F.element_at(x, r["s"])["level"] > 0)
        return F.transform(runs, lambda r: F.struct(F.element_at(x, r["s"])["level"].alias("level"), F.array_join(F.transform(F.slice(x, r["s"], r["e"] - r["s"]), lambda y: y["text"]), " ").alias("text")))

    return F.transform(F.array(lines), of)[0]  # inside lambdas Spark evaluates each mention of an expression anew


def _different(quotes: Column) -> Column:
    """The different (level, text), as strings meanwhile: of these Spark makes a hash set, of structs it compares all pairs."""
    named = F.array_distinct(F.transform(quotes, lambda q: F.concat_ws(":", q["level"].cast("string"), q["text"])))
    return F.transform(named, lambda s: F.struct(F.substring_index(s, ":", 1).cast("int").alias("level"), F.substr(s, F.instr(s, ":") + 1).alias("text")))


def parse_quotes(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """``messages`` with body (its own lines, blank ends stripped) and quotes: (level, text) of each quoted run and line.

    A null text is empty; one without quotes is its own body as it stands. Texts of any
    length are taken whole, in time that grows with their lines. Columns named body or
    quotes are replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    quoted = F.rlike(text, F.lit(r"(?m)^\s*>"))
    split = messages.withColumn("__text", text).withColumn("__lines", F.when(quoted, _lines(F.col("__text"))))
    lines = F.col("__lines")
    own = F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["text"]), "\n")
    single = F.filter(lines, lambda x: x["level"] > 0)
    none = F.array().cast("array<struct<level:int,text:string>>")
    body = F.when(lines.isNotNull(), F.regexp_replace(own, r"^\s+|\s+$", "")).otherwise(F.col("__text"))
    return split.withColumn("body", body).withColumn("quotes", F.when(lines.isNotNull(), _different(F.concat(_passages(lines), single))).otherwise(none)).drop("__text", "__lines")


def reply_threads(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", min_quote: int = MIN_QUOTE) -> DataFrame:
    """(conv_id, turn, role, parent_turn, thread_turn, n_quotes, body, formatted) for each message.

    parent_turn is the earlier message of the conversation that the message quotes
    most of, by code points of the outermost level that finds any; of equals the
    latest, null if none. thread_turn is the first message of its thread. Ordered by
    conv_id, thread_turn and turn, each message follows what it answers. A passage
    said by several messages counts for the first. formatted puts the role before the
    body. Null texts are empty; rows of a null conversation or turn have no links and
    are their own thread; repeated rows come back each, with equal links. An empty
    table gives an empty table.
    """
    m = written(parse_quotes(messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))).drop("text"))
    quoting = m.where(F.size("quotes") > 0).select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", F.col("q.level").alias("level"), _norm(F.col("q.text")).alias("t")).where(F.length("t") >= min_quote).distinct()
    quoting = quoting.select("conv_id", F.col("turn").alias("by"), "level", F.length("t").alias("n"), F.xxhash64("t").alias("h"), F.hash("t").alias("h2"))
    convs = quoting.select("conv_id").distinct()
    said = m.join(convs, "conv_id", "left_semi").select("conv_id", "turn", F.explode(F.array_distinct(F.concat(F.array(F.col("body")), F.split("body", "\n"), F.split("body", r"\n\s*\n")))).alias("t"))
    said = said.select("conv_id", "turn", _norm(F.col("t")).alias("t")).where(F.length("t") >= min_quote).groupBy("conv_id", F.xxhash64("t").alias("h"), F.hash("t").alias("h2")).agg(F.min("turn").alias("turn"))
    hits = quoting.join(said, ["conv_id", "h", "h2"]).where("turn < by").groupBy("conv_id", "by", "turn", "level").agg(F.sum("n").alias("n"))
    parents = hits.groupBy("conv_id", "by").agg(F.max_by("turn", F.struct(-F.col("level"), "n", "turn")).alias("parent_turn"))
    name = lambda turn: F.struct(F.col("conv_id").alias("conv_id"), F.col(turn).alias("turn"))
    roots = connected(parents.select(name("by").alias("a"), name("parent_turn").alias("b"))).select(F.col("node.conv_id").alias("rc"), F.col("node.turn").alias("rt"), F.col("component.turn").alias("root"))
    linked = m.join(parents.withColumnRenamed("conv_id", "pc"), (F.col("conv_id") == F.col("pc")) & (F.col("turn") == F.col("by")), "left").join(roots, (F.col("conv_id") == F.col("rc")) & (F.col("turn") == F.col("rt")), "left")
    return linked.select("conv_id", "turn", "role", "parent_turn", F.coalesce("root", "turn").alias("thread_turn"), F.size("quotes").cast("long").alias("n_quotes"), "body", F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), "body").alias("formatted"))


def conversation_records(threads: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, thread_turn, part, n_messages, turns, parents, n_quotes, text) from what ``reply_threads`` gives: a record for each thread.

    A thread's messages stand in reply order, by turn: each after the one that it
    answers. turns and parents list them and what they answer ("-" for none), joined
    by commas; text joins the formatted messages by line feeds. A thread that spans
    more than ``part_turns`` turns has a record for each such stretch, numbered by
    part; equal messages of one turn count once. Messages without a conversation or
    turn have a record each, equal ones one.
    """
    alone = F.when(F.col("conv_id").isNull() | F.col("turn").isNull(), F.xxhash64("role", "body"))
    rows = threads.withColumns({"__alone": alone, "part": F.floor(F.col("turn") / part_turns).cast("long")})
    message = F.struct("turn", "parent_turn", "n_quotes", "formatted")
    by = rows.groupBy("conv_id", "thread_turn", "part", "__alone").agg(F.sort_array(F.collect_set(message)).alias("m"))
    listed = lambda c: F.array_join(F.transform("m", lambda x: F.coalesce(x[c].cast("string"), F.lit("-"))), ",")
    n_quotes = F.aggregate("m", F.lit(0).cast("long"), lambda n, x: n + x["n_quotes"])
    return by.select("conv_id", "thread_turn", "part", F.size("m").cast("long").alias("n_messages"), listed("turn").alias("turns"), listed("parent_turn").alias("parents"), n_quotes.alias("n_quotes"), F.array_join(F.transform("m", lambda x: x["formatted"]), "\n").alias("text"))


def reply_ordered(threads: DataFrame) -> DataFrame:
    """The rows of ``threads`` in reply order over all partitions, however long a thread is: by conversation, thread and turn."""
    return threads.orderBy("conv_id", "thread_turn", "turn")
