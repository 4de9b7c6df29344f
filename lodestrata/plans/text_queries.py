"""Queries over texts, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import chunks
from lodestrata.session import rounded, table

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOKENS = "list_filter(regexp_split_to_array(" + _LOWER + r", '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_ANSWER = "list_filter(regexp_split_to_array(regexp_replace(" + _LOWER + r", '[!-/:-@\[-`{{-~]', '', 'g'), '[\x20\x09-\x0D]+'), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the'))"
_WORDS = "list_filter(regexp_split_to_array(" + _LOWER + ", '[^a-z0-9_]+'), lambda w: length(w) >= {1})"


def normalize_text(spark, sf_dir):
    words = T.answer_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.md5(F.array_join(words, " ")).alias("normalized_md5"))


NORMALIZE = f"""
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_tokens, md5(array_to_string(ws, ' ')) AS normalized_md5
FROM (SELECT doc_id, {_ANSWER.format("coalesce(text, '')")} AS ws FROM documents)"""


def _pairs(spark, sf_dir):
    """Each turn as a prediction of what the turn before it says."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.select("conv_id", "turn", "text", F.lag("text").over(w).alias("gold")).where("gold is not null")


def token_f1_pairs(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select("conv_id", "turn", T.answer_tokens(F.col("text")).alias("p"), T.answer_tokens(F.col("gold")).alias("g"))
    sides = rows.select("conv_id", "turn", F.explode("p").alias("w"), F.lit(1).alias("p"), F.lit(0).alias("g")).union(
        rows.select("conv_id", "turn", F.explode("g").alias("w"), F.lit(0), F.lit(1))
    )
    common = (
        sides.groupBy("conv_id", "turn", "w").agg(F.least(F.sum("p"), F.sum("g")).alias("n"))
        .groupBy("conv_id", "turn").agg(F.sum("n").alias("common"))
    )
    n = F.coalesce("common", F.lit(0))
    f1 = T.token_f1(n, F.greatest(F.size("p"), F.lit(1)), F.greatest(F.size("g"), F.lit(1)))
    f1 = F.when(T.special_mismatch(F.array_join("p", " "), F.array_join("g", " ")), 0.0).otherwise(f1)
    return rows.join(common, ["conv_id", "turn"], "left").select("conv_id", "turn", n.cast("long").alias("n_common"), rounded(f1).alias("f1"))


TOKEN_F1 = f"""
WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS gold FROM conversations),
p AS (SELECT conv_id, turn, {_ANSWER.format('text')} AS p, {_ANSWER.format('gold')} AS g FROM t WHERE gold IS NOT NULL),
s AS (SELECT conv_id, turn, unnest(p) AS w, 1 AS a, 0 AS b FROM p UNION ALL SELECT conv_id, turn, unnest(g), 0, 1 FROM p),
c AS (SELECT conv_id, turn, sum(n) AS common FROM (SELECT conv_id, turn, w, least(sum(a), sum(b)) AS n FROM s GROUP BY ALL) GROUP BY ALL)
SELECT conv_id, turn, CAST(coalesce(common, 0) AS BIGINT) AS n_common,
  round(CASE WHEN (array_to_string(p, ' ') IN ('yes', 'no', 'noanswer') OR array_to_string(g, ' ') IN ('yes', 'no', 'noanswer')) AND p <> g THEN 0.0 WHEN common > 0 THEN 2 * (common / len(p)) * (common / len(g)) / (common / len(p) + common / len(g)) ELSE 0.0 END, 6)::DOUBLE AS f1
FROM p LEFT JOIN c USING (conv_id, turn)"""


def exact_and_substring_match(spark, sf_dir):
    return _pairs(spark, sf_dir).select(
        "conv_id", "turn", T.exact_match(F.col("text"), F.col("gold")).alias("exact"), T.substring_match(F.col("text"), F.col("gold")).alias("substring")
    )


MATCHES = f"""
WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS gold FROM conversations),
p AS (SELECT conv_id, turn, array_to_string({_ANSWER.format("coalesce(text, '')")}, ' ') AS p, array_to_string({_ANSWER.format('gold')}, ' ') AS g FROM t WHERE gold IS NOT NULL)
SELECT conv_id, turn, CAST(p = g AS DOUBLE) AS exact, CAST(contains(p, g) AS DOUBLE) AS substring FROM p"""


def levenshtein_pairs(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("distance"),
        rounded(1 - F.levenshtein("p_name", "p_type") / F.greatest(F.length("p_name"), F.length("p_type"), F.lit(1))).alias("similarity"),
    )


LEVENSHTEIN = """
SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS BIGINT) AS distance,
       round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type), 1), 6)::DOUBLE AS similarity FROM part"""


def sentence_split_count(spark, sf_dir):
    s = T.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.md5(F.coalesce(F.get(s, F.lit(0)), F.lit(""))).alias("first_md5"))


SENTENCES = r"""
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, md5(coalesce(s[1], '')) AS first_md5 FROM (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])[\x20\x09-\x0D]+', '\1' || chr(1), 'g'), chr(1)),
         lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda x: x <> '') AS s FROM documents)"""


def first_last_line(spark, sf_dir):
    found = T.lines(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(found).cast("long").alias("n_lines"), F.md5(F.coalesce(F.get(found, F.lit(0)), F.lit(""))).alias("first_md5"),
        F.md5(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))).alias("last_md5"),
    )


LINES = r"""
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_lines, md5(coalesce(s[1], '')) AS first_md5, md5(coalesce(s[-1], '')) AS last_md5 FROM (
  SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)),
         lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda x: x <> '') AS s FROM documents)"""


def regex_label_extract(spark, sf_dir):
    n = F.regexp_extract("c_name", r"#0*([0-9]+)$", 1)
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(n != "", n.try_cast("long")).alias("label"), F.lower(F.col("c_mktsegment")).alias("segment"))


LABELS = """SELECT c_custkey, TRY_CAST(nullif(regexp_extract(c_name, '#0*([0-9]+)$', 1), '') AS BIGINT) AS label, lower(c_mktsegment) AS segment FROM customer"""


def provenance_header_roundtrip(spark, sf_dir):
    header = T.provenance_header(F.col("conv_id"), F.col("turn"))
    stored = F.concat(header, F.lit("\n"), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", stored.alias("s")).select(
        "conv_id", "turn", T.header_id(F.col("s")).alias("source_id"), F.md5(T.without_header(F.col("s"))).alias("text_md5")
    )


PROVENANCE = """SELECT conv_id, turn, conv_id || ':' || turn AS source_id, md5(coalesce(text, '')) AS text_md5 FROM conversations"""


def keyword_overlap_pairs(spark, sf_dir):
    score = T.keyword_overlap(T.word_tokens(F.col("text"), 3), T.word_tokens(F.col("gold"), 3))
    return _pairs(spark, sf_dir).select("conv_id", "turn", rounded(score).alias("overlap"))


OVERLAP = f"""
WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS gold FROM conversations),
p AS (SELECT conv_id, turn, list_distinct({_WORDS.format("coalesce(text, '')", 3)}) AS a, list_distinct({_WORDS.format('gold', 3)}) AS b FROM t WHERE gold IS NOT NULL)
SELECT conv_id, turn, round(len(list_intersect(a, b)) / greatest(len(a), len(b), 1), 6)::DOUBLE AS overlap FROM p"""


def frequent_words(spark, sf_dir):
    words = F.filter(T.word_tokens(F.col("text"), 3), lambda w: ~w.isin(*T.STOPWORDS))
    counts = table(spark, sf_dir, "conversations").select("role", F.explode(words).alias("word")).groupBy("role", "word").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("role").orderBy(F.desc("n"), "word")).cast("long")
    return counts.withColumn("place", place).where("place <= 10")


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
FREQUENT = f"""
SELECT role, word, n, CAST(row_number() OVER (PARTITION BY role ORDER BY n DESC, word) AS BIGINT) AS place
FROM (SELECT role, word, count(*) AS n FROM (SELECT role, unnest({_WORDS.format('text', 3)}) AS word FROM conversations) WHERE word NOT IN ({_STOP}) GROUP BY ALL)
QUALIFY place <= 10"""


def html_to_text(spark, sf_dir):
    text = T.html_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("text_md5"))


HTML = r"""
SELECT page_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5 FROM (
 SELECT page_id, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(
   regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]*>', ' ', 'gs'),
   '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[\x20\x09-\x0D]+', ' ', 'g'), '^ | $', '', 'g') AS t FROM pages)"""


def turn_pack_chunks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("size", F.size(T.tokens(F.col("text"))))
    return chunks.pack_turns(c, "conv_id", "turn", F.col("size"), 64)


PACK = f"""
WITH RECURSIVE t AS (SELECT conv_id, turn, CAST(len({_TOKENS.format("coalesce(text, '')")}) AS BIGINT) AS size,
   row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
r AS (SELECT conv_id, turn, size, n, CAST(0 AS BIGINT) AS chunk, size AS used FROM t WHERE n = 1
  UNION ALL SELECT t.conv_id, t.turn, t.size, t.n, CASE WHEN r.used > 0 AND r.used + t.size > 64 THEN r.chunk + 1 ELSE r.chunk END,
    CASE WHEN r.used > 0 AND r.used + t.size > 64 THEN t.size ELSE r.used + t.size END FROM r JOIN t ON t.conv_id = r.conv_id AND t.n = r.n + 1)
SELECT conv_id, chunk, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n_turns, CAST(sum(size) AS BIGINT) AS size FROM r GROUP BY conv_id, chunk"""


def sliding_dialogue_windows(spark, sf_dir):
    return chunks.sliding(table(spark, sf_dir, "conversations"), "conv_id", "turn", 3, 1)


SLIDING = """
WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS at, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
w AS (SELECT DISTINCT conv_id, n, unnest(range(0, CAST(greatest(0, ceil((n - 3) / 2)) AS BIGINT) + 1)) AS win FROM t)
SELECT w.conv_id, CAST(w.win AS BIGINT) AS "window", min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n_turns
FROM w JOIN t ON t.conv_id = w.conv_id AND t.at >= w.win * 2 AND t.at < w.win * 2 + 3 GROUP BY w.conv_id, w.win"""


def exact_dedup_first_seen(spark, sf_dir):
    found = table(spark, sf_dir, "documents").groupBy(F.md5(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))).alias("text_md5"))
    return found.agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))


FIRST_SEEN = r"""
SELECT md5(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'))) AS text_md5, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY 1"""


def anti_join_missing_hash(spark, sf_dir):
    """Texts of the conversations whose stored id no document has."""
    stored = table(spark, sf_dir, "documents").select(T.stored_id("chunk", F.col("text")).alias("hash_id"))
    asked = table(spark, sf_dir, "benchmark").select("item_id", T.stored_id("chunk", F.col("text")).alias("hash_id"))
    return asked.join(stored, "hash_id", "left_anti").select("item_id", "hash_id")


MISSING = """
SELECT item_id, 'chunk-' || md5(coalesce(text, '')) AS hash_id FROM benchmark
WHERE md5(coalesce(text, '')) NOT IN (SELECT md5(coalesce(text, '')) FROM documents)"""


def budgeted_context_prefix(spark, sf_dir):
    from lodestrata.operators import retrieval

    w = Window.partitionBy("source").orderBy("doc_id")
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))
    return retrieval.budgeted(d.withColumn("rank", F.row_number().over(w).cast("long")), "source", 2000)


BUDGET = f"""
WITH d AS (SELECT source, doc_id, CAST(len({_TOKENS.format("coalesce(text, '')")}) AS BIGINT) AS n_tokens,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents),
b AS (SELECT *, 2000 - coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM d)
SELECT source, doc_id, n_tokens, rank, CAST(least(room, n_tokens) AS BIGINT) AS taken FROM b WHERE room > 0"""


QUERIES = {
    "normalize_text": (normalize_text, NORMALIZE), "token_f1_pairs": (token_f1_pairs, TOKEN_F1),
    "exact_and_substring_match": (exact_and_substring_match, MATCHES), "levenshtein_pairs": (levenshtein_pairs, LEVENSHTEIN),
    "sentence_split_count": (sentence_split_count, SENTENCES), "first_last_line": (first_last_line, LINES),
    "regex_label_extract": (regex_label_extract, LABELS), "provenance_header_roundtrip": (provenance_header_roundtrip, PROVENANCE),
    "keyword_overlap_pairs": (keyword_overlap_pairs, OVERLAP), "frequent_words": (frequent_words, FREQUENT), "html_to_text": (html_to_text, HTML),
    "turn_pack_chunks": (turn_pack_chunks, PACK), "sliding_dialogue_windows": (sliding_dialogue_windows, SLIDING),
    "exact_dedup_first_seen": (exact_dedup_first_seen, FIRST_SEEN), "anti_join_missing_hash": (anti_join_missing_hash, MISSING),
    "budgeted_context_prefix": (budgeted_context_prefix, BUDGET),
}
