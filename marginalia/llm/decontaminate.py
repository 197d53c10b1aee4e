"""Benchmark decontamination by templates.

Texts become tokens in which numbers, names and units are typed placeholders
(slots), by lists of English, German, French and Spanish words; neighbouring names,
and numbers in several words, are one slot. Names begin with a capital within a
sentence; German nouns, told by the article before them, are literals. Hashes of
windows of template tokens are joined between documents and benchmark items; a pair
of document and item is contaminated if an alignment covers enough of the item's
tokens and its slots are consistent: each value of the item stands for one value of
the document throughout, and no two names of the item for the same. An alignment joins nearby shifts, so that words may be put
in or left out. So copies are found as well as edited ones and questions asked again
with other numbers and names. Windows of the item with few literals are hashed by
their lower-cased tokens instead, and match only as they stand; items of under
MIN_LITERALS tokens match only as a whole sentence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import bounded_batches, written

WINDOW, MIN_LITERALS, COVERAGE = 8, 4, 0.5
#: Shifts of one alignment are this share of the item's tokens apart at most, or LEAST_SLACK tokens.
SLACK, LEAST_SLACK = 0.5, 4
#: Hashes of benchmark windows that go to the executors at once (32 MB); more are handled in blocks, with a pass each.
BLOCK_WINDOWS = 4_000_000
#: Measures that count as a unit after a number, short ones and then English, German, French and Spanish ones.
UNITS = """
mm cm m km in ft yd mi g kg mg lb lbs oz ml l s sec min h hr hrs mph kmh
mile miles metre metres meter meters kilometre kilometres kilometer kilometers inch inches foot feet yard yards gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes litre litres liter liters gallon gallons cup cups second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents degree degrees
metern kilometern zentimeter gramm kilogramm pfund tonnen sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren prozent grad
mètre mètres kilomètre kilomètres centimètres gramme grammes kilogramme kilogrammes livre livres seconde secondes heure heures jour jours semaine semaines mois ans année années degré degrés
metro metros kilómetro kilómetros centímetros gramo gramos kilo kilos kilogramos libra libras tonelada toneladas litro litros segundo segundos minuto minutos hora horas día días semana semanas mes meses año años grado grados
"""
#: Written numbers under twenty, in the same order of languages. Ones that are common words of another language are left out.
SMALL_NUMBERS = """
two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn
deux trois quatre cinq sept huit dix onze douze treize quatorze quinze seize
dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince dieciséis diecisiete dieciocho diecinueve
"""
#: Written tens.
TENS = """
twenty thirty forty fifty sixty seventy eighty ninety
zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig
vingt vingts trente quarante cinquante soixante
veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa
"""
#: Written numbers that "one" makes a number with, and that "and" goes on from.
LARGE_NUMBERS = "hundred thousand million hundert tausend millionen mille millions mil millón millones"
#: Spanish hundreds.
HUNDREDS = "cien ciento doscientos trescientos cuatrocientos quinientos seiscientos setecientos ochocientos novecientos"
#: Words for one, and words that join the parts of a number after a large one or after tens.
ONES, AFTER_LARGE, AFTER_TENS = "one eins ein eine un une uno una", "and und", "et y"
#: German articles; a capital after them, or after them and an inflected word, begins a noun and no name.
ARTICLES = "der die das den dem ein eine einen einem einer eines im am zum zur vom"
#: Endings of inflected words.
INFLECTED = ("e", "en", "er", "es", "em")


def _written_numbers() -> str:
    """All written numbers, with the German and Spanish ones that are one word of several."""
    german, tens = SMALL_NUMBERS.split("\n")[2].split()[:8], TENS.split("\n")[2].split()
    joined = [f"{one}und{ten}" for one in ("ein", *german) for ten in tens] + [f"{one}{large}" for one in ("ein", *german) for large in ("hundert", "tausend")]
    spanish = [f"veinti{one}" for one in "uno un dós trés cuatro cinco séis siete ocho nueve".split()]
    return " ".join([SMALL_NUMBERS, TENS, LARGE_NUMBERS, HUNDREDS, *joined, *spanish])


_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x6E756D626572, 0x6E616D65, 0x756E6974))
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_PLAIN = np.uint64(0x706C61696E)
_STOP = np.zeros(256, bool)
_STOP[[0x2E, 0x21, 0x3F, 0x3A, 10]] = True
_APART = np.ones(256, bool)
_APART[[0x20, 0x2D]] = False


def _known(words: str) -> np.ndarray:
    data, off = tk.buffers(pa.array(words.split()))
    return np.sort(tk.span_hashes(data, off[:-1], off[1:]))


_NUMBERS, _LARGE, _TENS, _ONES, _AFTER_LARGE, _AFTER_TENS, _UNITS, _ARTICLES = (_known(x) for x in (_written_numbers(), LARGE_NUMBERS, TENS, ONES, AFTER_LARGE, AFTER_TENS, UNITS, ARTICLES))


def _inflected(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each token ends as INFLECTED words do and is longer than three bytes."""
    last, second = data[end - 1], data[np.maximum(end - 2, 0)]
    e = ord("e")
    return (end - start > 3) & ((last == e) | ((second == e) & np.isin(last, [ord(x[1]) for x in INFLECTED if len(x) == 2])))


def _capital(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Bytes of the capital letter at each start (Latin, Greek or Cyrillic), 0 if there is none."""
    lead, second = data[start], data[np.minimum(start + 1, len(data) - 1)]
    wide = ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E)) | ((lead == 0xCE) & (second >= 0x91) & (second <= 0xA9)) | ((lead == 0xD0) & (second >= 0x80) & (second <= 0xAF))
    return np.where(_UPPER[lead], 1, np.where(wide, 2, 0))


def template(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all rows: start, end, plain hash, template hash, whether it is a literal, whether it goes on the slot before it, whether it begins a sentence; and each row's first token."""
    n = len(data)
    digit = _DIGIT[data]
    m = _WORD[data]
    if n > 2:
        m[1:-1] |= ((data[1:-1] == 0x2E) | (data[1:-1] == 0x2C)) & digit[:-2] & digit[2:]
    start, end, first = tk.mask_spans(m, off)
    if not len(start):
        return start, end, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, bool), first
    plain = h = tk.span_hashes(tk.LOWER[data], start, end)
    is_in = lambda known: known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
    opens = np.zeros(len(start), bool)  # first of its row
    opens[first[:-1][np.diff(first) > 0]] = True
    apart = np.r_[0, np.cumsum(_APART[data])]
    close = ~opens & np.r_[False, apart[start[1:]] == apart[end[:-1]]]  # only blanks or hyphens before it
    before, after = (lambda x: np.r_[False, x[:-1]] & close), (lambda x: np.r_[(x & close)[1:], False])
    word, large, tens = is_in(_NUMBERS), is_in(_LARGE), is_in(_TENS)
    link, one = (is_in(_AFTER_LARGE) & before(large)) | (is_in(_AFTER_TENS) & before(tens)), is_in(_ONES)
    word |= one & (after(large) | before(tens) | before(link))
    word |= link & after(word)
    number = digit[start] | word
    unit = np.r_[False, number[:-1]] & ~opens & ~number & is_in(_UNITS)
    stops = np.r_[0, np.cumsum(_STOP[data])]
    sentence_start = opens | np.r_[True, stops[start[1:]] > stops[end[:-1]]]
    capital = _capital(data, start)
    after_it = np.minimum(start + capital, n - 1)
    low_second = (capital > 0) & (end - start > capital) & ~_UPPER[data[after_it]] & (data[after_it] > 57)
    article, inflected = is_in(_ARTICLES), (capital == 0) & _inflected(data, start, end)
    noun = before(article) | before(inflected & before(article))
    name = low_second & ~sentence_start & ~number & ~unit & ~noun
    h = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, h)))
    goes_on = (name & before(name)) | (number & before(number) & (word | before(word)))
    return start, end, plain, h, ~(number | unit | name), goes_on, sentence_start, first


def _windows(hashes: np.ndarray, literal: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token and hash of the windows within a row, and whether they have enough literals."""
    w = tk.rolling(hashes, length)
    if not len(w):
        return np.zeros(0, np.int64), w, np.zeros(0, bool)
    at = np.arange(len(w))
    last = np.repeat(first[1:], np.diff(first))[: len(w)]
    lit = np.r_[0, np.cumsum(literal)]
    fine = at + length <= last
    return at[fine], w[fine] ^ np.uint64(length), (lit[at + length] - lit[at] >= MIN_LITERALS)[fine]


def _fits(size: np.ndarray, length: int) -> np.ndarray:
    """Whether items of ``size`` tokens have windows of ``length``: WINDOW or all of them, and under half of them, so that one edit leaves some."""
    return (np.minimum(size, WINDOW) == length) | ((size > WINDOW) & ((size - 1) // 2 == length))


def _hit_batch(part: pa.RecordBatch, wanted, kinds: list[tuple[int, bool]], items: bool) -> pa.RecordBatch:
    data, off = tk.buffers(part.column("text"))
    start, end, exact, h, literal, goes_on, opens, first = template(data, off)
    row_of = np.repeat(np.arange(part.num_rows), np.diff(first))
    raw = tk.LOWER[data].tobytes()
    kind = np.where(h == _NUMBER, "0", np.where(h == _NAME, "N", "u"))
    value = lambda k, s, e: f"{kind[k]}:{' '.join(raw[s:e].decode('utf-8', 'replace').split())}"
    closes = np.r_[opens[1:], True] if len(opens) else opens  # opens is true at each row's first token
    heads = np.flatnonzero(~goes_on)
    ends = np.r_[heads[1:], len(start)]
    first_head = np.searchsorted(heads, first)
    head_of = np.cumsum(~goes_on) - 1
    rows, pos, at_token, size, keys, slots, long, as_is = [], [], [], [], [], [], [], []
    for length, plain in kinds:
        if plain:
            at, w, rich = _windows(exact, literal, first, length)
            w, token, past = w ^ _PLAIN, at, at + length
            n_tokens, use = np.diff(first), ~rich if items else np.ones(len(at), bool)
            if length < MIN_LITERALS and not items:
                use &= opens[at] & closes[past - 1]
        else:
            at, w, use = _windows(h[heads], literal[heads], first_head, length)
            token, past = heads[at], ends[at + length - 1]
            n_tokens = np.diff(first_head)
        if items:
            use &= _fits(n_tokens[row_of[token]], length)
        use = np.flatnonzero(use)
        use = use[wanted(w[use])]
        token, past = token[use], past[use]
        row = row_of[token]
        rows.append(row)
        pos.append(head_of[token] - first_head[row])
        at_token.append(token - first[row])
        size.append(past - token)
        keys.append(w[use])
        long.append(np.full(len(use), length))
        as_is.append(np.full(len(use), plain))
        if plain:  # a document's equal the item's
            slots += [[value(k, start[k], end[k]) for k in range(i, j) if not literal[k]] if items else None for i, j in zip(token.tolist(), past.tolist(), strict=True)]
        else:
            slots += [[value(heads[k], start[heads[k]], end[ends[k] - 1]) for k in range(i, i + length) if not literal[heads[k]]] for i in at[use].tolist()]
    cat = lambda x, t: np.concatenate(x).astype(t)
    ids = part.column("id").take(pa.array(cat(rows, np.int64)))
    tokens = np.diff(first)[cat(rows, np.int64)]
    ints = [pa.array(cat(x, np.int32)) for x in (pos, at_token, size, long)]
    return pa.RecordBatch.from_arrays([ids, *ints, pa.array(cat(as_is, bool)), pa.array(tokens.astype(np.int32)), pa.array(cat(keys, np.uint64).view(np.int64)), pa.array(slots, pa.list_(pa.string()))], names=["id", "pos", "at", "size", "length", "plain", "tokens", "h", "slots"])


_SCHEMA = "id long, pos int, at int, size int, length int, plain boolean, tokens int, h long, slots array<string>"


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, pos, at, size, length, plain, tokens, h, slots) of each window of each item.

    pos counts template tokens, in which a run of slots is one; at, size and tokens
    (of the whole item) count all. Items under WINDOW tokens are one window of their
    length; ones up to twice that also have windows of under half their length. Where
    windows have under MIN_LITERALS literals, plain ones of the tokens as they stand
    are given in their place. slots are the values of the window's slots, each with a
    letter for its type. Null texts have no windows.
    """

    def run(batches):
        for batch in batches:
            for part in tk.chunks(batch):
                yield _hit_batch(part, lambda w: np.ones(len(w), bool), [(n, True) for n in range(1, MIN_LITERALS)] + [(n, plain) for n in range(MIN_LITERALS, WINDOW + 1) for plain in (False, True)], True)

    bounded_batches(items.sparkSession)
    return items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).distinct().mapInArrow(run, _SCHEMA)


def _document_hits(docs: DataFrame, hashes: np.ndarray, kinds: list[tuple[int, bool]]) -> DataFrame:
    bits = 20
    hashes = np.sort(hashes.view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(hashes)  # BLOCK_WINDOWS numbers at most

    def run(batches):
        known = shared.value
        table = np.zeros(1 << bits, bool)
        table[known >> np.uint64(64 - bits)] = True

        def wanted(w: np.ndarray) -> np.ndarray:
            keep = table[w >> np.uint64(64 - bits)]
            some = np.flatnonzero(keep)
            keep[some] = known[np.minimum(np.searchsorted(known, w[some]), len(known) - 1)] == w[some]
            return keep

        for batch in batches:
            for part in tk.chunks(batch):
                yield _hit_batch(part, wanted, kinds, False)

    return docs.mapInArrow(run, _SCHEMA)


def _consistent(pairs, values: dict[str, str], names: dict[str, str]) -> bool:
    """Whether each of the pairs (value in the item, value in the document) fits ``values`` and, for names, ``names`` the other way; both get them."""
    return all(values.setdefault(i, d) == d and (i[0] != "N" or names.setdefault(d, i) == i) for i, d in pairs)


def _joined(tokens: int, shifts: list[dict]) -> tuple[int, int, int, int]:
    """Tokens covered, windows matched, slot values and changed ones of the alignment that covers most.

    Around each shift with consistent slots, nearby ones join it, those with most
    windows first, if the slots of all remain consistent.
    """
    parts = []
    for x in sorted(shifts, key=lambda x: x["shift"]):
        values: dict[str, str] = {}
        if _consistent([(v["i"], v["d"]) for v in x["slots"]], values, {}):
            parts.append((x["shift"], {(w["at"], w["size"], w["h"]) for w in x["windows"]}, values))
    slack, low, high, best = max(LEAST_SLACK, int(SLACK * tokens)), 0, 0, (0, 0, 0, 0)
    for shift, windows, values in parts:
        while parts[low][0] < shift - slack:
            low += 1
        while high < len(parts) and parts[high][0] <= shift + slack:
            high += 1
        windows, values, names = set(windows), dict(values), {d: i for i, d in values.items() if i[0] == "N"}
        for _, more, others in sorted(parts[low:high], key=lambda p: (-len(p[1]), abs(p[0] - shift), p[0])):
            if more <= windows:
                continue
            both, back = dict(values), dict(names)
            if _consistent(others.items(), both, back):
                windows |= more
                values, names = both, back
        covered = len({k for at, size, _ in windows for k in range(at, at + size)})
        best = max(best, (covered, len(windows), len(values), sum(i != d for i, d in values.items())), key=lambda b: b[:2])
    return best


def contaminated_pairs(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, item_id, matched, windows, n_slots, n_changed): the contaminated pairs.

    matched of the item's windows stand in the document in one alignment of nearby
    shifts, with consistent slots, and cover ``coverage`` of the item's tokens and
    WINDOW tokens (or all) at least; n_changed of the n_slots different slot values
    differ from the item's. Items of fewer than MIN_LITERALS tokens match where they
    are a whole sentence or line. Texts without tokens, null texts and rows of a null
    id match nothing. Texts of any length are taken whole. A repeated row gives its
    pairs once; other columns are left out, so their names can't clash; empty tables
    give none.
    """
    bounded_batches(docs.sparkSession)
    bench = written(benchmark_windows(items))
    found = bench.agg(F.count_distinct("h").alias("n")).first()["n"]
    blocks = -(-found // block_windows)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = sorted((r["length"], r["plain"]) for r in bench.select("length", "plain").distinct().collect())
    hits = None
    for k in range(max(1, blocks)):
        own = bench.where(F.pmod("h", F.lit(max(1, blocks))) == k).select("h").distinct().toArrow().column("h").to_numpy()
        part = _document_hits(texts, own, kinds) if len(own) else docs.sparkSession.createDataFrame([], _SCHEMA)
        hits = part if hits is None else hits.union(part)
    right = bench.select(F.col("id").alias("item_id"), F.col("pos").alias("off"), F.struct("at", "size", "h").alias("window"), "h", F.col("slots").alias("item_slots"))
    totals = bench.groupBy(F.col("id").alias("item_id")).agg(F.count("*").alias("windows"), F.max("tokens").alias("tokens"))
    aligned = hits.select("id", "pos", "h", "slots").join(right, "h").withColumn("shift", F.col("pos") - F.col("off")).repartition("id", "item_id")
    pairs = F.transform(F.arrays_zip("item_slots", F.coalesce("slots", "item_slots").alias("slots")), lambda x: F.struct(x["item_slots"].alias("i"), x["slots"].alias("d")))
    by = aligned.groupBy("id", "item_id", "shift").agg(F.collect_set("window").alias("windows"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("slots"))
    shifts = by.groupBy("id", "item_id").agg(F.collect_list(F.struct("shift", "windows", "slots")).alias("shifts")).join(totals, "item_id")

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            best = [_joined(r["tokens"], r["shifts"]) for r in rows]
            out = [(r["id"], r["item_id"], b[1], r["windows"], b[2], b[3]) for r, b in zip(rows, best, strict=True) if b[0] >= max(coverage * r["tokens"], min(r["tokens"], WINDOW))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64() if k < 4 else pa.int32()) for k in range(6)], names=names)

    names = ["doc_id", "item_id", "matched", "windows", "n_slots", "n_changed"]
    return shifts.mapInArrow(run, "doc_id long, item_id long, matched long, windows long, n_slots int, n_changed int")


def clean_documents(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are in no contaminated pair; rows of a null id stay."""
    bad = contaminated_pairs(docs, items, coverage, id_col, text_col).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs[id_col].cast("long") == bad["__bad"], "left_anti")
