"""Queries that take texts apart without loss, with SQL where it gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import chunks
from lodestrata.session import table


def word_pieces(spark, sf_dir):
    """How many pieces of each kind a document has, and a digest of the pieces in order."""
    n = lambda ps, k: F.size(F.filter(ps, lambda x: x["kind"] == k)).cast("long").alias(k)
    digest = lambda ps: F.md5(F.array_join(F.transform(ps, lambda x: F.concat(x["piece"], F.lit("|"), x["kind"])), "\x01")).alias("pieces_md5")
    counted = F.transform(F.array(chunks.typed_pieces(F.col("text"))), lambda ps: F.struct(n(ps, "word"), n(ps, "sentence_end"), n(ps, "paragraph_end"), digest(ps)))
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(counted))


_PIECE = f"[^ {chunks.SENTENCE_ENDS}]*(?:[{chunks.SENTENCE_ENDS}] *| )|[^ {chunks.SENTENCE_ENDS}]+"
WORDS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_PIECE}') AS ps FROM documents),
u AS (SELECT doc_id, unnest(ps) AS piece, unnest(list_append(ps[2:], '')) AS after, generate_subscripts(ps, 1) AS pos FROM d WHERE len(ps) > 0),
k AS (SELECT *, CASE WHEN NOT regexp_matches(piece, '[{chunks.SENTENCE_ENDS}]') THEN 'word' WHEN after[1] IN (chr(10), chr(13)) THEN 'paragraph_end' ELSE 'sentence_end' END AS kind FROM u),
g AS (SELECT doc_id, count(*) FILTER (kind = 'word') AS word, count(*) FILTER (kind = 'sentence_end') AS sentence_end, count(*) FILTER (kind = 'paragraph_end') AS paragraph_end, md5(string_agg(piece || '|' || kind, chr(1) ORDER BY pos)) AS pieces_md5 FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(word, 0) AS word, coalesce(sentence_end, 0) AS sentence_end, coalesce(paragraph_end, 0) AS paragraph_end, coalesce(pieces_md5, md5('')) AS pieces_md5 FROM documents LEFT JOIN g USING (doc_id)"""


def cut_sentences(spark, sf_dir):
    """Sentences of 200 characters at most, with their paragraphs and kinds."""
    found = chunks.cut_sentences(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), "chars", 200)
    return found.select("doc_id", "sentence", "paragraph", "kind", "n_pieces", F.md5("text").alias("text_md5"))


QUERIES = {"word_pieces": (word_pieces, WORDS), "cut_sentences": (cut_sentences, None)}
