"""Benchmark decontamination by a distributed positional inverted index, in native operations.

The index holds the postings (document, position, neighbouring words) of the test terms by which
windows are looked up: of each window the rarest term, by the counts over all documents. Windows
meet the postings of their rarest term, each posting shifted by the term's offset; the other terms
are then looked for among the neighbours, the rarest first: at their own offsets for exact phrases, anywhere
near for proximity matches. The neighbours stand in for the other terms' lists, most of which
would hold a large part of all words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm._shared import ascii_lower, small_enough, stored

#: What divides the words of the query contract, after A-Z is in lower case.
BETWEEN_TERMS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Tables of test windows and terms up to this many rows are broadcast, others are shuffled.
MAX_BROADCAST_ROWS = 200_000


def terms(text: Column) -> Column:
    """The lower-case words of a text in order; none for null."""
    # split() is ten times as fast as regexp_extract_all(); only its first and last parts can be empty
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), BETWEEN_TERMS, -1), ""), F.array().cast("array<string>"))


def test_windows(items: DataFrame, size: int = 13) -> DataFrame:
    """item_id, text to the distinct (item_id, window): `size` consecutive words, or all words of a shorter item."""
    words = F.col("words")
    last = F.greatest(F.size(words) - size, F.lit(0))
    return (
        items.select("item_id", terms(F.col("text")).alias("words"))
        .where(F.size("words") > 0)
        .select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
        .select("item_id", F.slice(words, F.col("at") + 1, size).alias("window"))
        .distinct()
    )


def anchored(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Each distinct window with its terms' offsets from the rarest to the most frequent.

    counts: (term, n) over all documents. Windows with a term that no document has are left out, as
    they can occur nowhere.
    """
    placed = windows.select("window").distinct().select("window", F.posexplode("window").alias("offset", "term"))
    ranked = placed.join(counts, "term").groupBy("window").agg(
        F.sort_array(F.collect_list(F.struct("n", "term", "offset"))).alias("rare")
    )
    return ranked.where(F.size("rare") == F.size("window")).select(
        "window", F.col("rare")[0]["term"].alias("term"), F.transform("rare", lambda x: x["offset"]).alias("offsets")
    )


def build_index(docs: DataFrame, anchors: DataFrame, reach: int) -> DataFrame:
    """Postings of the anchor terms: doc (struct), n_words, term, at, first (position of context[0]), context, and one row without a term for each document.

    docs has doc and words; the context are the words up to `reach` positions away. With many anchors only (doc, term, at) is shuffled,
    and contexts are cut where a document meets its own positions again.
    """
    known = small_enough(anchors.withColumn("known", F.lit(True)), MAX_BROADCAST_ROWS)
    # an empty word in front, which no text has, stands for the document
    placed = docs.select("doc", "words", F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("at", "term"))
    first = F.greatest(F.col("at") - reach, F.lit(0))
    n_words = F.size("words").cast("long").alias("n_words")
    context = F.when(F.col("term") != "", F.slice("words", first + 1, F.col("at") - first + 1 + reach)).alias("context")
    if anchors.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        found = placed.join(known, "term", "left").where(F.col("known") | (F.col("at") == 0))
        return found.withColumn("at", F.col("at") - 1).select("doc", n_words, "term", "at", first.alias("first"), context)
    # repeated rows are one document here, and each of them takes its matches again at the end
    own = placed.select("doc", "at", "term").join(known, "term").distinct().groupBy("doc").agg(F.collect_list(F.struct("at", "term")).alias("found"))
    rows = docs.join(own, "doc", "left")
    places = F.concat(F.array(F.struct(F.lit(0).alias("at"), F.lit("").alias("term"))), F.coalesce("found", F.array().cast("array<struct<at:int,term:string>>")))
    each = rows.select("doc", "words", F.explode(places).alias("p")).select("doc", "words", (F.col("p.at") - 1).alias("at"), F.col("p.term").alias("term"))
    return each.select("doc", n_words, "term", "at", first.alias("first"), context)


def phrase_matches(index: DataFrame, windows: DataFrame, slop: int = 3) -> DataFrame:
    """Where windows occur: doc, window, start, exact. windows comes from anchored(), and index reaches size - 1 + slop words.

    Exact matches have each term at its offset from the rarest. The others are proximity matches: all terms lie within
    the window's length plus slop of its rarest term. Both checks go from the rarest term on and end at the first that is missing.
    """
    found = index.where("context is not null").join(small_enough(windows, MAX_BROADCAST_ROWS), "term").withColumn("start", F.col("at") - F.col("offsets")[0])
    base = F.col("start") - F.col("first")
    same = F.forall(
        "offsets", lambda o: F.coalesce(F.get(F.col("context"), base + o) == F.get(F.col("window"), o), F.lit(False))
    )
    far = F.size("window") - 1 + slop
    lo = F.greatest(F.col("at") - F.col("first") - far, F.lit(0))
    around = F.slice("context", lo + 1, F.col("at") - F.col("first") - lo + 1 + far)
    near = F.forall("offsets", lambda o: F.array_contains(F.col("around"), F.get(F.col("window"), o)))
    exact = (F.col("start") >= 0) & same
    checked = found.withColumn("exact", exact).withColumn("around", around).where(F.col("exact") | near)
    return checked.select("doc", "window", "start", "exact")


def contamination(docs: DataFrame, items: DataFrame, size: int = 13, share: int = 20, slop: int = 3) -> DataFrame:
    """What benchmark items each document holds.

    docs has doc_id and text, items has item_id and text; other columns are ignored. Returns one row
    per row of docs: doc_id, text_hash, n_words, n_hit (words inside any exact occurrence of a window), item_ids (sorted as
    strings), near_ids (those with an exact or a proximity match), contaminated (some word is hit, and share * n_hit >= n_words). Null and empty texts have no words and no
    hits; a null item_id counts in n_hit but is no item. Rows with the same doc_id and text have
    the same result; rows with one doc_id and different texts are kept apart.
    """
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("doc"), terms(F.col("text")).alias("words"))
    windows = stored(test_windows(items, size), "windows")
    vocabulary = windows.select(F.explode("window").alias("term")).distinct()
    counts = (
        keyed.select(F.explode("words").alias("term"))
        .join(small_enough(vocabulary, MAX_BROADCAST_ROWS), "term")
        .groupBy("term").agg(F.count("*").alias("n"))
    )
    looked_up = stored(anchored(windows, counts), "anchors")
    index = stored(build_index(keyed, looked_up.select("term").distinct(), size - 1 + slop), "postings")
    matches = stored(phrase_matches(index, looked_up, slop).distinct(), "matches")
    order = Window.partitionBy("doc").orderBy("start", "end")
    reached = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = (
        matches.where("exact").select("doc", "start", (F.col("start") + F.size("window")).alias("end")).distinct()
        .withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", reached)))
        .groupBy("doc").agg(F.sum("new").cast("long").alias("n_hit"))
    )
    item = F.col("item_id").cast("string")
    named = (
        matches.groupBy("doc", "window").agg(F.max("exact").alias("exact"))
        .join(small_enough(windows, MAX_BROADCAST_ROWS), "window")
        .groupBy("doc").agg(F.sort_array(F.collect_set(F.when(F.col("exact"), item))).alias("item_ids"), F.sort_array(F.collect_set(item)).alias("near_ids"))
    )
    found = named.join(hits, "doc", "left")
    n_hit, none = F.coalesce("n_hit", F.lit(0).cast("long")), F.array().cast("array<string>")
    # doc holds a null doc_id as a field, so joins on it need no null-safe test
    return index.where("context is null").select("doc", "n_words").join(found, "doc", "left").select(
        F.col("doc.doc_id").alias("doc_id"), F.col("doc.text_hash").alias("text_hash"), "n_words", n_hit.alias("n_hit"),
        F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("near_ids", none).alias("near_ids"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """docs without the contaminated documents; all columns stay."""
    found = stored(contamination(docs, items, size, share).where("contaminated").select("doc_id", "text_hash").distinct(), "contaminated")
    bad = small_enough(found, MAX_BROADCAST_ROWS).alias("b")
    return docs.alias("d").join(
        bad, F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64("d.text") == F.col("b.text_hash")), "left_anti"
    )


DECONTAM_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
w AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i:i + 12], ' ') AS phrase
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM w),
pw AS (SELECT DISTINCT phrase, n FROM w), pt AS (SELECT phrase, n, string_split(phrase, ' ') AS terms FROM pw),
tc AS (SELECT term, count(*) AS uses FROM (SELECT unnest(ws) AS term FROM d) WHERE term IN (SELECT unnest(terms) FROM pt) GROUP BY term),
pu AS (SELECT phrase, n, unnest(terms) AS term, generate_subscripts(terms, 1) AS off, len(terms) AS size FROM pt),
an AS (SELECT phrase, n, term FROM (SELECT *, count(uses) OVER (PARTITION BY phrase) AS known, row_number() OVER (PARTITION BY phrase ORDER BY uses, pu.term, off) AS k FROM pu LEFT JOIN tc USING (term)) WHERE known = size AND k = 1),
po AS (SELECT doc_id, ws, unnest(ws) AS term, generate_subscripts(ws, 1) AS pos FROM d),
ne AS (SELECT DISTINCT doc_id, phrase FROM (SELECT doc_id, ws, pos, an.n, phrase FROM po JOIN an USING (term)) WHERE list_has_all(list_slice(ws, greatest(1, pos - n - 2), pos + n + 2), string_split(phrase, ' '))),
nn AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM ne JOIN w USING (phrase) GROUP BY doc_id),
g AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
m AS (SELECT g.doc_id, g.i, g.n, w.item_id FROM g JOIN w USING (n, phrase)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN nn USING (doc_id)
"""
