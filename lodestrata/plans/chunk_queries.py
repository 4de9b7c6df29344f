"""Queries that cut texts into chunks, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import cleanup as C
from lodestrata.functions import text as T
from lodestrata.operators import chunks
from lodestrata.plans.text_queries import _TOKENS
from lodestrata.session import table


def _digest(df, key="doc_id"):
    return df.select(key, "chunk", "n_pieces", F.md5("text").alias("text_md5"))


_SENTENCES = r"""s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])[\x20\x09-\x0D]+', '\1' || chr(1), 'g'), chr(1)),
         lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda x: x <> '') AS ps FROM documents)"""


def _packed_sql(measure, budget, between, joint, empty_first=False):
    """Folds a list of sizes into chunk numbers: the first two elements of the list are the chunk and what it holds."""
    first = f"(len(acc) = 2 AND x[1] > {budget})" if empty_first else "false"
    return f"""
z AS (SELECT doc_id, ps, list_transform(ps, lambda p: CAST({measure} AS BIGINT)) AS sizes FROM s WHERE len(ps) > 0),
f AS (SELECT doc_id, ps, list_reduce(list_transform(sizes, lambda v: [v]), lambda acc, x: CASE WHEN (acc[2] > 0 AND acc[2] + {between} + x[1] > {budget}) OR {first}
  THEN list_append(list_concat([acc[1] + 1, x[1]], acc[3:]), acc[1] + 1) ELSE list_append(list_concat([acc[1], acc[2] + x[1] + CASE WHEN acc[2] > 0 THEN {between} ELSE 0 END], acc[3:]), acc[1]) END, [CAST(0 AS BIGINT), CAST(0 AS BIGINT)])[3:] AS numbers FROM z),
u AS (SELECT doc_id, unnest(ps) AS piece, unnest(numbers) AS chunk, generate_subscripts(ps, 1) AS pos FROM f)
SELECT doc_id, chunk, count(*) AS n_pieces, md5(string_agg(piece, {joint} ORDER BY pos)) AS text_md5 FROM u GROUP BY doc_id, chunk"""


_WORDS_OF = r"len(list_filter(regexp_split_to_array(p, '[\x20\x09-\x0D]+'), lambda w: w <> ''))"


def sentence_chunks(spark, sf_dir):
    """Sentences packed to 60 words, with one more between two."""
    return _digest(chunks.packed_pieces(table(spark, sf_dir, "documents"), "doc_id", T.sentences(F.col("text")), "words", 60, 1))


def sentence_chunks_empty_first(spark, sf_dir):
    """Sentences packed to 12 words: a longer first one leaves chunk 0 empty."""
    return _digest(chunks.packed_pieces(table(spark, sf_dir, "documents"), "doc_id", T.sentences(F.col("text")), "words", 12, 0, " ", True))


def paragraph_chunks(spark, sf_dir):
    """Parts between blank lines, cut at 400 characters, packed to 900 with two between."""
    return _digest(chunks.packed_pieces(table(spark, sf_dir, "documents"), "doc_id", chunks.paragraphs(F.col("text"), 400), "chars", 900, 2, "\n\n"))


PARAGRAPHS = r"""WITH q AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n[\x20\x09]*\n'), lambda p: regexp_replace(p, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda p: p <> '') AS qs FROM documents),
s AS (SELECT doc_id, flatten(list_transform(qs, lambda p: list_transform(range(0, (length(p) - 1) // 400 + 1), lambda i: substr(p, i * 400 + 1, 400)))) AS ps FROM q),"""


def line_chunks(spark, sf_dir):
    """Lines as rows, packed to 300 characters."""
    return _digest(chunks.packed_pieces(table(spark, sf_dir, "documents"), "doc_id", T.lines(F.col("text")), "chars", 300, 1, "\n"))


LINES = r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda p: regexp_replace(p, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda p: p <> '') AS ps FROM documents),"""


def token_windows(spark, sf_dir):
    """Windows of 50 words that share ten."""
    found = chunks.token_windows(table(spark, sf_dir, "documents"), "doc_id", T.tokens(F.col("text")), 50, 10)
    return found.select("doc_id", "window", "first", "n", F.md5("text").alias("text_md5"))


WINDOWS = f"""WITH d AS (SELECT doc_id, {_TOKENS.format("coalesce(text, '')")} AS ws FROM documents), w AS (SELECT doc_id, ws, unnest(range(0, greatest(1, CAST(ceil((len(ws) - 10) / 40) AS BIGINT)))) AS win FROM d WHERE len(ws) > 0)
SELECT doc_id, win AS "window", win * 40 AS first, CAST(len(list_slice(ws, win * 40 + 1, win * 40 + 50)) AS BIGINT) AS n, md5(array_to_string(list_slice(ws, win * 40 + 1, win * 40 + 50), ' ')) AS text_md5 FROM w"""


def long_context(spark, sf_dir):
    """All turns of a conversation in one text, cut to its last 150 words."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    ws = F.flatten(F.transform("t", lambda x: T.tokens(x["text"])))
    return c.withColumn("ws", ws).select("conv_id", F.size("ws").cast("long").alias("n_words"), F.md5(F.array_join(C.cut(F.col("ws"), 150, "tail"), " ")).alias("tail_md5"))


LONG = f"""WITH t AS (SELECT conv_id, turn, {_TOKENS.format("coalesce(text, '')")} AS ws FROM conversations), c AS (SELECT conv_id, flatten(list(ws ORDER BY turn)) AS ws FROM t GROUP BY conv_id)
SELECT conv_id, CAST(len(ws) AS BIGINT) AS n_words, md5(array_to_string(list_slice(ws, greatest(len(ws) - 149, 1), len(ws)), ' ')) AS tail_md5 FROM c"""

QUERIES = {
    "sentence_chunks": (sentence_chunks, f"WITH {_SENTENCES}," + _packed_sql(_WORDS_OF, 60, 1, "' '")), "sentence_chunks_empty_first": (sentence_chunks_empty_first, f"WITH {_SENTENCES}," + _packed_sql(_WORDS_OF, 12, 0, "' '", True)),
    "paragraph_chunks": (paragraph_chunks, PARAGRAPHS + _packed_sql("length(p)", 900, 2, "chr(10) || chr(10)")), "line_chunks": (line_chunks, LINES + _packed_sql("length(p)", 300, 1, "chr(10)")),
    "token_windows": (token_windows, WINDOWS), "long_context": (long_context, LONG),
}
