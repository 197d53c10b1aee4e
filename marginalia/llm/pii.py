"""Personal data, with Spark's own functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, modulo
97 for account numbers), and words just before a span raise its score, which
decides whether spans of weak kinds count. Texts are never exploded: each becomes
arrays of spans in place, without a shuffle. Patterns begin where the match before
ended or at the edge of a run, so that a run of any length is scanned a few times
only, and places are added up block by block: time is linear in a text's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the base spans, in the order of kinds, anchored and possessive where that changes no match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Stricter patterns, looked for inside the base proposals that fail.
INSIDE = {"card": r"(?<![0-9])[0-9]{13,19}+(?![0-9])", "phone": r"\+1\x20\([0-9]{3}\)\x20[0-9]{3}-[0-9]{4}(?![0-9-])"}
#: Patterns of other kinds: account numbers, social security numbers, keys of known forms, and values assigned to names of secrets.
ADDED = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "key": r"(?<![A-Za-z0-9_])(?:AKIA[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{24}|xox[abp]-[A-Za-z0-9-]{20,80}+)(?![A-Za-z0-9_])|-----BEGIN\x20[A-Z\x20]{0,20}PRIVATE\x20KEY-----",
    "secret": r"(?i)(?<![a-z0-9])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\x20?[=:]\x20?[\x22\x27]?[A-Za-z0-9+/_.-]{8,200}+(?![A-Za-z0-9+/_.-])",
}
#: What a text must hold for a pattern to be tried at all.
GUARDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]", "key": r"AKIA|gh[opsu]_|sk_live_|xox[abp]-|-----BEGIN", "secret": r"(?i)token|secret|passw|key"}
#: Score of a kind without context, words that raise it by BOOST when among the CONTEXT code points before, back to the match before.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3, "key": 0.9, "secret": 0.3}
WORDS = {
    "email": "mail|e-mail|email|contact|write to|address",
    "ip": "ip|host|server|address|login|client",
    "card": "card|visa|mastercard|amex|credit|debit|payment|pay",
    "phone": "phone|tel|call|mobile|fax|cell|contact",
    "iban": "iban|account|bank|transfer|konto",
    "ssn": "ssn|social security|social|security number",
    "key": "key|token|secret|credentials",
    "secret": "login|credentials|auth|bearer|config|export|env",
}
BOOST, CONTEXT, LEAST, BLOCK = 0.3, 40, 0.5, 256


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is made once: inside lambdas each mention of an expression is evaluated anew."""
    return F.transform(F.array(value), body)[0]


def _luhn(text: Column) -> Column:
    """Whether the digits in ``text`` pass Luhn's test."""

    def fold(digits: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            d = F.substring(digits, i + 1, F.lit(1)).cast("int")
            twice = d * 2
            return acc + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

        return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0

    return _let(F.reverse(F.regexp_replace(text, "[^0-9]", "")), fold)


def _mod97(text: Column) -> Column:
    """Whether an account number gives 1 modulo 97 with its first four places moved to the end and letters as 10 to 35."""

    def fold(plain: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            c = F.ascii(F.substring(plain, (i + 4) % F.length(plain) + 1, F.lit(1)))
            return F.when(c < 58, (acc * 10 + c - 48) % 97).otherwise((acc * 100 + c - 55) % 97)

        return F.aggregate(F.sequence(F.lit(0), F.length(plain) - 1), F.lit(0), step) == 1

    return _let(F.regexp_replace(text, r"\x20", ""), fold)


def _n_digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


def _octets(text: Column) -> Column:
    return F.forall(F.split(text, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int") <= 255, F.lit(False)))


def _mixed(text: Column) -> Column:
    """Whether the last part of an assignment, at least eight characters, has both digits and letters, as keys have and words have not."""
    value = F.regexp_extract(text, r"[A-Za-z0-9+/_.-]{8,200}$", 0)
    return F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Za-z]"))


def _short(text: Column, most: int, valid) -> Column:
    """``valid``, but for proposals of at most ``most`` digits only."""
    return F.when(_n_digits(text).between(13, most), valid(text)).otherwise(False)


VALID = {"email": lambda t: F.lit(True), "ip": _octets, "card": lambda t: _short(t, 19, _luhn), "phone": lambda t: _n_digits(t).between(9, 15), "iban": _mod97, "ssn": lambda t: F.lit(True), "key": lambda t: F.lit(True), "secret": lambda t: F.lit(True)}
_MATCH, _SPAN = "array<struct<gap:string,m:string,at:int>>", "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"


def _placed(pairs: Column) -> Column:
    """(gap, m, at): matches with the text before each and their first place, in code points; added up in blocks, as growing an array by one takes time in its size."""
    length = lambda x: F.length(x["gap"]) + F.length(x["m"])

    def block(p: Column, k: Column) -> Column:
        rows = F.slice(p, k * BLOCK + 1, F.lit(BLOCK))
        start = F.struct(F.lit(0).alias("n"), F.array().cast(_MATCH).alias("out"))
        add = lambda acc, x: F.struct((acc["n"] + length(x)).alias("n"), F.concat(acc["out"], F.array(F.struct(x["gap"].alias("gap"), x["m"].alias("m"), (acc["n"] + F.length(x["gap"])).alias("at")))).alias("out"))
        return F.aggregate(rows, start, add)

    def moved(blocks: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))
        offsets = F.aggregate(blocks, start, lambda acc, b: F.struct((acc["n"] + b["n"]).alias("n"), F.concat(acc["out"], F.array(acc["n"])).alias("out")))["out"]
        put = lambda b, off: F.transform(b["out"], lambda x: F.struct(x["gap"].alias("gap"), x["m"].alias("m"), (x["at"] + off).alias("at")))
        return F.flatten(F.zip_with(blocks, offsets, put))

    blocks = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda k: block(p, k))
    return _let(_let(pairs, blocks), moved)


def _matches(text: Column, pattern: str) -> Column:
    """The leftmost matches that don't overlap, placed; none if the text has none."""
    pairs = lambda gaps: F.zip_with(F.slice(gaps, 1, F.size(gaps) - 1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    return _let(F.split(text, pattern, -1), lambda gaps: F.when(F.size(gaps) > 1, _placed(pairs(gaps))).otherwise(F.array().cast(_MATCH)))


def _span(kind: str, start: Column, m: Column, before: Column, base: bool) -> Column:
    near = F.rlike(F.lower(F.substring(before, F.greatest(F.length(before) - CONTEXT, F.lit(0)) + 1, F.lit(CONTEXT))), F.lit(rf"\b(?:{WORDS[kind]})\b"))
    score = F.lit(SCORES[kind]) + F.when(near, BOOST).otherwise(0.0)
    if kind == "secret":
        score = score + F.when(_mixed(m), BOOST).otherwise(0.0)
    return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(m)).cast("int").alias("end"), F.least(score, F.lit(1.0)).alias("score"), F.lit(base).alias("base"))


def _spans(text: Column, kind: str) -> Column:
    """Valid spans of a kind, in order: base ones, and inside of failing proposals those of the stricter pattern."""
    none = F.array().cast(_SPAN)

    def judged(x: Column) -> Column:
        base = kind in PATTERNS
        own = F.array(_span(kind, x["at"], x["m"], x["gap"], base))
        if kind not in INSIDE:
            return F.when(VALID[kind](x["m"]), own).otherwise(none)
        inner = lambda y: F.when(VALID[kind](y["m"]), F.array(_span(kind, x["at"] + y["at"], y["m"], F.concat(x["gap"], y["gap"]), False))).otherwise(none)
        return F.when(VALID[kind](x["m"]), own).otherwise(F.flatten(F.transform(_matches(x["m"], INSIDE[kind]), inner)))

    pattern = PATTERNS.get(kind) or ADDED[kind]
    return F.when(F.rlike(text, F.lit(GUARDS[kind])), F.flatten(F.transform(_matches(text, pattern), judged))).otherwise(none)


def find_pii(docs: DataFrame, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """``docs`` with a column spans: an array of (kind, start, end, score, base), ordered by kind and start.

    Spans of base true are the valid ones of the four base kinds, whatever their
    score. The others come from the stricter patterns inside base proposals that
    fail, and are of the other kinds, as far as they score ``least`` or more; they
    overlap no base span of their kind. A score is the kind's, raised by context words
    and, for assigned secrets, by a value that mixes letters and digits. Null and
    empty texts have no spans. Rows don't meet, so repeated rows and ids of any kind
    are as good as others; a column named spans is replaced. Texts of any length are
    searched whole, in time that grows with their length. An empty table gives an
    empty table.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    spans = F.filter(F.concat(*[_spans(text, k) for k in [*PATTERNS, *ADDED]]), lambda s: s["base"] | (s["score"] >= least))
    return docs.select(*[c for c in docs.columns if c != "spans"], spans.alias("spans"))


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["base"])


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
