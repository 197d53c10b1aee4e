"""Registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, embedding_dedup, licenses, line_dedup, merkle, pii, quality, quotes, simhash, substring_dedup, toxicity, whitening
from .common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def default_ranks() -> dict[bytes, int]:
    import public_tokenizers

    return bpe.load_ranks(public_tokenizers.path(VOCABULARY))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_offending"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = default_ranks()
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(bpe.decode(F.col("ids"), ranks), 256).alias("decoded_sha256"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(table(spark, sf_dir, "embeddings"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = found.select("doc_id", "spans", pii.base_spans(F.col("spans")).alias("base"))
    scores = F.array_join(F.transform("spans", lambda s: F.round(s["score"], 2).cast("string")), ",")
    return base.select("doc_id", *[pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.PATTERNS], F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), scores.alias("scores"))


#: Replies with quotes, made of the messages of conversations, which have none: by turn and conversation a reply quotes the message before, that and the one before it in two levels, the first line of the one before it, or nothing.
QUOTED = """
    SELECT c.conv_id, c.turn, c.role, CASE
      WHEN (c.conv_id + c.turn) % 4 = 1 AND a.text IS NOT NULL THEN concat('> ', replace(a.text, chr(10), concat(chr(10), '> ')), chr(10), c.text)
      WHEN (c.conv_id + c.turn) % 4 = 2 AND b.text IS NOT NULL THEN concat('>> ', replace(b.text, chr(10), concat(chr(10), '>> ')), chr(10), '> ', replace(a.text, chr(10), concat(chr(10), '> ')), chr(10), c.text)
      WHEN (c.conv_id + c.turn) % 4 = 3 AND b.text IS NOT NULL THEN concat('> ', translate(split_part(b.text, chr(10), 1), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), chr(10), c.text)
      ELSE c.text END AS text
    FROM {conversations} c LEFT JOIN {conversations} a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1 LEFT JOIN {conversations} b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2"""


def op8_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversation_records(quotes.reply_threads(spark.sql(QUOTED, conversations=table(spark, sf_dir, "conversations"))))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_manifest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_decontamination, op2_simhash, op3_toxicity, op4_line_dedup, op5_bpe, op6_embedding_dedup, op7_pii, op8_chat_quotes, op9_substring_dedup, op10_quality, op11_licenses, op12_whitening, op13_merkle]
    return {f.__name__: f for f in own}


_BLANK = r"chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
ORACLES = {
    "op4_line_dedup": f"""
        WITH lines AS (
          SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
        keyed AS (SELECT *, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
        common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (k IN (SELECT k FROM common)) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (k NOT IN (SELECT k FROM common)), '')) AS kept_sha256
        FROM keyed GROUP BY doc_id""",
    "op6_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL),
        pairs AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
                  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach AS (SELECT x, y FROM pairs UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x)
        SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.m, e.vec_id)) AS component_id,
               e.vec_id = least(e.vec_id, coalesce(c.m, e.vec_id)) AS kept
        FROM embeddings e LEFT JOIN (SELECT x, count(*) AS n FROM pairs GROUP BY x) n ON n.x = e.vec_id
        LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) c ON c.x = e.vec_id""",
    "op9_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
        least_doc AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s HAVING count(DISTINCT doc_id) > 1),
        marked AS (SELECT win.doc_id, i FROM win JOIN least_doc USING (s) WHERE win.doc_id > m),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM marked),
        words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
        kept AS (SELECT words.doc_id, count(*) AS n, count(gone.i) AS g,
                        string_agg(word, ' ' ORDER BY words.i) FILTER (gone.i IS NULL) AS t
                 FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.i = words.i GROUP BY words.doc_id)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(g, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op8_chat_quotes": rf"""
        WITH RECURSIVE q AS ({QUOTED.replace("{conversations}", "conversations")}),
        lines AS (SELECT conv_id, turn, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS l FROM q)),
        cut AS (SELECT conv_id, turn, i, x, regexp_extract(x, '^\s*(?:>\s?)+', 0) AS marks FROM lines),
        levels AS (SELECT conv_id, turn, i, length(marks) - length(replace(marks, '>', '')) AS level, substr(x, length(marks) + 1) AS t FROM cut),
        islands AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY i) AS g FROM levels),
        passages AS (SELECT conv_id, turn, level, string_agg(t, ' ' ORDER BY i) AS t FROM islands WHERE level > 0 GROUP BY conv_id, turn, level, g
                     UNION ALL SELECT conv_id, turn, level, t FROM levels WHERE level > 0),
        quoting AS (SELECT DISTINCT conv_id, turn, level, trim(regexp_replace(lower(t), '\s+', ' ', 'g')) AS t FROM passages),
        own AS (SELECT conv_id, turn, max(level) > 0 AS quoted, coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (level = 0), '') AS t FROM levels GROUP BY conv_id, turn),
        bodies AS (SELECT conv_id, turn, CASE WHEN quoted THEN regexp_replace(t, '^\s+|\s+$', '', 'g') ELSE t END AS body FROM own),
        pieces AS (SELECT conv_id, turn, unnest([body] || string_split(body, chr(10)) || regexp_split_to_array(body, '\n\s*\n')) AS t FROM bodies),
        said AS (SELECT conv_id, trim(regexp_replace(lower(t), '\s+', ' ', 'g')) AS t, min(turn) AS turn FROM pieces GROUP BY ALL),
        hits AS (SELECT k.conv_id, k.turn AS reply, s.turn AS parent, k.level, sum(length(k.t)) AS n FROM quoting k JOIN said s ON s.conv_id = k.conv_id AND s.t = k.t WHERE k.t <> '' AND s.turn < k.turn GROUP BY ALL),
        parents AS (SELECT conv_id, reply, parent FROM hits QUALIFY row_number() OVER (PARTITION BY conv_id, reply ORDER BY level, n DESC, parent DESC) = 1),
        roots AS (SELECT conv_id, turn, turn AS root FROM q WHERE (conv_id, turn) NOT IN (SELECT conv_id, reply FROM parents)
                  UNION ALL SELECT p.conv_id, p.reply, r.root FROM roots r JOIN parents p ON p.conv_id = r.conv_id AND p.parent = r.turn),
        counts AS (SELECT conv_id, turn, count(DISTINCT (level, t)) AS n_quotes FROM passages GROUP BY ALL),
        rows AS (SELECT r.conv_id, r.root, r.turn, q.role, b.body, p.parent, coalesce(c.n_quotes, 0) AS n_quotes FROM roots r JOIN q USING (conv_id, turn) JOIN bodies b USING (conv_id, turn)
                 LEFT JOIN parents p ON p.conv_id = r.conv_id AND p.reply = r.turn LEFT JOIN counts c ON c.conv_id = r.conv_id AND c.turn = r.turn)
        SELECT conv_id, root AS thread_turn, turn // 512 AS part, count(*) AS n_messages, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS turns,
               string_agg(coalesce(CAST(parent AS VARCHAR), '-'), ',' ORDER BY turn) AS parents, sum(n_quotes)::BIGINT AS n_quotes,
               string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || body, chr(10) ORDER BY turn) AS text
        FROM rows GROUP BY conv_id, root, turn // 512""",
}


def _merkle_sql() -> str:
    """Trees, siblings and folds by recursion; DuckDB has no crc32, so the id's bytes are folded bit by bit."""
    hashed = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    tree = lambda name, base: f"""{name}(tree, level, i, h, n) AS (SELECT * FROM ({base}) UNION ALL
          SELECT tree, any_value(level) + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 15) // 16) FROM {name} WHERE n > 1 GROUP BY tree, i // 16)"""  # noqa: E731
    runs = lambda name, of: f"{name} AS (SELECT tree, level, i // 16 AS run, list(h ORDER BY i) AS hs FROM {of} WHERE n > 1 GROUP BY ALL)"
    fold = lambda base, of: f"""SELECT * FROM ({base}) UNION ALL SELECT f.k, f.tree, f.level + 1, f.i // 16, sha256(array_to_string(hs[:f.i % 16] || [f.h] || hs[f.i % 16 + 2:], '')),
          f.s || array_to_string(hs[:f.i % 16] || hs[f.i % 16 + 2:], '') FROM {of} f JOIN runs r ON r.tree = f.tree AND r.level = f.level AND r.run = f.i // 16"""  # noqa: E731
    crc = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
    return f"""
        WITH RECURSIVE d AS (SELECT *, coalesce('s' || source, '') AS tree, {hashed("text")} AS leaf,
            CASE WHEN {crc} % 5 = 0 THEN {hashed("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed FROM documents),
        k AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n, row_number() OVER () AS k FROM d),
        {tree("t", "SELECT tree, 0 AS level, i, leaf AS h, n FROM k")},
        subroots AS (SELECT tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
        {tree("u", "SELECT '/' AS tree, 0 AS level, i, h, n FROM subroots")},
        {runs("below", "t")}, {runs("above", "u")}, runs AS (SELECT * FROM below UNION ALL SELECT * FROM above),
        f(k, tree, level, i, h, s) AS ({fold("SELECT k, tree, 0 AS level, i, coalesce(changed, leaf) AS h, '' AS s FROM k", "f")}),
        done AS (SELECT k, tree, arg_max(h, level) AS h, arg_max(s, level) AS s FROM f GROUP BY ALL),
        g(k, tree, level, i, h, s) AS ({fold("SELECT k, '/' AS tree, 0 AS level, b.i, done.h, done.s FROM done JOIN subroots b ON b.name = done.tree", "g")}),
        ended AS (SELECT k, arg_max(h, level) AS h, arg_max(s, level) AS s FROM g GROUP BY k),
        root AS (SELECT h FROM u WHERE n = 1)
        SELECT k.doc_id, k.leaf, b.h AS subroot, root.h AS root, sha256(ended.s) AS proof_sha256, ended.h AS folded_root, ended.h = root.h AS verified
        FROM k JOIN subroots b ON b.name = k.tree JOIN ended USING (k), root"""


ORACLES["op13_merkle"] = _merkle_sql()


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
