"""Queries of filters, dates, text cleaning, vectors and memory tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import cleanup as C
from lodestrata.functions import dates as D
from lodestrata.functions import filters
from lodestrata.functions import text as T
from lodestrata.functions import vector as V
from lodestrata.operators import memory as M
from lodestrata.operators.trees import depth_threshold
from lodestrata.plans.table_queries import _events
from lodestrata.plans.text_queries import _LOWER, _TOKENS
from lodestrata.session import rounded, table


def facet_filter(spark, sf_dir):
    """Facets that hold together, each only where it names values: languages, sources, no ids; then an exclusion."""
    d = table(spark, sf_dir, "documents")
    facets = {"lang": filters.wanted_values("en, de,"), "source": filters.wanted_values(["src1", "src2", "src5", "src7"]), "doc_id": filters.wanted_values(" , ")}
    for column, values in facets.items():
        d = d.where(F.col(column).isin(*values)) if values else d
    return d.where(~F.col("doc_id").cast("string").isin("1", "2", "3")).select("doc_id", "lang", "source")


FACETS = "SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND source IN ('src1', 'src2', 'src5', 'src7') AND doc_id NOT IN (1, 2, 3)"


def tenant_or_shared(spark, sf_dir):
    """A user's own events, or those of shared keys, with a score of 40 at least; missing scores count as passed."""
    e = _events(spark, sf_dir)
    k = F.get_json_object("props", "$.k").try_cast("long")
    return e.where((F.col("user_id") == 3) | k.isin(1, 2, 3)).where(F.coalesce("value", F.lit(1e9)) >= 40).select("event_id", "user_id")


TENANT = "SELECT event_id, user_id FROM events WHERE (user_id = 3 OR TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IN (1, 2, 3)) AND coalesce(value, 1e9) >= 40"


def closed_range_filter(spark, sf_dir):
    """Ranges with both ends, and a half-open one of time, sorted, a page of it."""
    e = _events(spark, sf_dir).where(F.col("value").between(20, 80) & (F.col("ts") >= F.lit("2024-01-05").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-15").cast("timestamp")))
    return e.orderBy("ts", "event_id").offset(10).limit(40).select("event_id")


RANGES = "SELECT event_id FROM events WHERE value BETWEEN 20 AND 80 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-15' ORDER BY ts, event_id LIMIT 40 OFFSET 10"


def symbolic_filter(spark, sf_dir):
    """Users by any of two kinds of events, a day within a range and a name that holds a text; no criteria would give none."""
    e = _events(spark, sf_dir).where(F.date_format("ts", "yyyy-MM-dd").between("2024-01-03", "2024-01-20"))
    users = e.groupBy("user_id").agg(F.collect_set("event_type").alias("tags"), F.min("event_id").alias("first"))
    name = F.concat(F.lit("User Number "), "user_id")
    return users.where(filters.tags_any(F.col("tags"), ["signup", "error"]) & T.ascii_lower(name).contains("number 1")).select("user_id", "first")


SYMBOLIC = """SELECT user_id, min(event_id) AS first FROM events WHERE strftime(ts, '%Y-%m-%d') BETWEEN '2024-01-03' AND '2024-01-20' GROUP BY user_id
HAVING bool_or(event_type IN ('signup', 'error')) AND contains(lower('User Number ' || user_id), 'number 1')"""


def completed_contexts(spark, sf_dir):
    """Users all of whose events are accounted for by a judged document of the same number, with how many are."""
    e = _events(spark, sf_dir).select("user_id", "event_id")
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("event_id"), F.lit(1).alias("done"))
    return e.join(done, "event_id", "left").groupBy("user_id").agg(F.count("*").alias("n"), F.count("done").alias("n_done"), (F.count("*") == F.count("done")).alias("complete"))


COMPLETED = "SELECT user_id, count(*) AS n, count(l.doc_id) AS n_done, count(*) = count(l.doc_id) AS complete FROM events LEFT JOIN labels AS l ON l.doc_id = event_id GROUP BY user_id"


def too_short_and_changed(spark, sf_dir):
    """Turns of 20 characters at least against the turn before: the change of their characters over whole texts, and whether it is kept as an update."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("old", F.lag("text").over(w)).where("old is not null").where(C.long_enough(F.col("text")))
    ratio = C.change_ratio(F.col("old"), F.col("text"))
    return c.select("conv_id", "turn", rounded(ratio).alias("ratio"), C.keep_update(F.col("text"), F.col("old")).alias("kept"))


_HAN = r"[\x{4E00}-\x{9FFF}]"
CHANGED = f"""
WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS old FROM conversations),
s AS (SELECT conv_id, turn, list_distinct(string_split(old, '')) AS a, list_distinct(string_split(text, '')) AS b,
  greatest(1, floor((length(old) - length(regexp_replace(old, '{_HAN}', '', 'g'))) * 1.5::DOUBLE
    + len(list_filter(regexp_split_to_array(old, '\\s+'), lambda w: regexp_matches(w, '\\p{{L}}') AND NOT regexp_matches(w, '{_HAN}'))) * 1.33::DOUBLE
    + length(regexp_replace(old, '{_HAN}', '', 'g')) * 0.5::DOUBLE)) AS n
  FROM c WHERE old IS NOT NULL AND length(text) >= 20),
r AS (SELECT conv_id, turn, n, 1 - len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS ratio FROM s)
SELECT conv_id, turn, round(ratio, 6)::DOUBLE AS ratio, ratio > 0 AND ratio < CASE WHEN n < 200 THEN 0.7 ELSE 0.2 END AS kept FROM r"""


def date_formats(spark, sf_dir):
    """Order dates written in six formats and read back, with seconds since 1970 from seconds and milliseconds."""
    o = table(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("timestamp"))
    n = F.col("o_orderkey") % 6
    written = (
        F.when(n == 0, F.date_format("d", "yyyy-MM-dd HH:mm:ss")).when(n == 1, F.date_format("d", "yyyy/MM/dd HH:mm")).when(n == 2, F.date_format("d", "yyyy-MM-dd"))
        .when(n == 3, F.date_format("d", "yyyy/MM/dd")).when(n == 4, F.date_format("d", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon")
    )
    epoch = F.unix_timestamp("d") * F.when(n < 3, 1000).otherwise(1)
    return o.select("o_orderkey", F.unix_timestamp(D.any_time(written)).alias("at"), D.epoch_seconds(epoch).cast("long").alias("seconds"))


DATES = """SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 5 THEN CAST(epoch(o_orderdate) AS BIGINT) END AS at, CAST(epoch(o_orderdate) AS BIGINT) AS seconds FROM orders"""


def session_times(spark, sf_dir):
    """Event times written like session headers and read back: the minute, and the synthetic clock of each user's n-th event."""
    e = _events(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    header = F.date_format("ts", "yyyy/MM/dd '('E')' HH:mm")
    clock = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n"))
    return e.withColumn("n", n).select("event_id", F.unix_timestamp(D.session_time(header)).alias("minute"), D.iso_seconds(clock).alias("clock"))


SESSION_TIMES = """SELECT event_id, CAST(floor(epoch(ts) / 60) AS BIGINT) * 60 AS minute, strftime(make_timestamp((1700000000 + row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 1000000), '%Y-%m-%dT%H:%M:%S') AS clock FROM events"""


def time_id_window(spark, sf_dir):
    """Events whose key, read as a time, lies in a closed window; what is no number is left out."""
    at = F.get_json_object("props", "$.k").try_cast("long")
    return _events(spark, sf_dir).where(at.between(10, 15)).groupBy("user_id").agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))


ID_WINDOW = "SELECT user_id, count(*) AS n, min(k) AS first, max(k) AS last FROM (SELECT user_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k BETWEEN 10 AND 15 GROUP BY user_id"


def text_cleaning(spark, sf_dir):
    """Turns in their normal forms: for matching, for storage, as triples, as keys and slugs."""
    t = F.concat(F.lit("[source_id: a:1]\n‘x’ , — "), "text", F.lit("\r\n\n\n\nend. "))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.md5(C.matching_form(t)).alias("matching_md5"), F.md5(C.stored_form(t)).alias("stored_md5"), F.md5(C.triple_form(F.col("text"))).alias("triple_md5"),
        C.key_form(F.concat("role", F.lit(" no. "), "turn")).alias("key"), C.slug(F.concat_ws("/", "role", "turn", F.lit("a b"))).alias("slug"), C.is_ascii(t).alias("ascii"),
        C.category_name(F.col("turn") % 7).alias("category"),
    )


_EDGE = r"regexp_replace({0}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
CLEANING = r"""
WITH c AS (SELECT *, '[source_id: a:1]' || chr(10) || chr(8216) || 'x' || chr(8217) || ' , ' || chr(8212) || ' ' || text || chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || 'end. ' AS t FROM conversations)
SELECT conv_id, turn, md5(regexp_replace(""" + _EDGE.format("regexp_replace(translate(translate(t, chr(8216) || chr(8217) || chr(8220) || chr(8221) || chr(8211) || chr(8212) || chr(160), '''''\"\"-- '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g')".replace('\\"', '"').replace("\\\\", "\\")) + r""", '[\x20]+([,.;:!?])', '\1', 'g')) AS matching_md5,
  md5(""" + _EDGE.format(r"regexp_replace(regexp_replace(regexp_replace(t, '^\[source_id: [^\]]*\]\n?', ''), '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')").replace("{{3,}}", "{3,}") + r""") AS stored_md5,
  md5(trim(regexp_replace(""" + _LOWER.format("text") + r""", '[^a-z0-9 ]', ' ', 'g'))) AS triple_md5, lower(role) || '_no_' || turn AS key, role || '-' || turn || '-a-b' AS slug, false AS ascii,
  CASE turn % 7 WHEN 1 THEN 'multi-hop' WHEN 2 THEN 'temporal' WHEN 3 THEN 'open-domain' WHEN 4 THEN 'single-hop' WHEN 5 THEN 'adversarial' ELSE 'category-' || turn % 7 END AS category FROM c"""


def token_cuts(spark, sf_dir):
    """Turns cut to 12 words: head, tail, half of each; and their anchors of eight words."""
    ws = T.tokens(F.col("text"))
    joined = lambda kind: F.md5(F.array_join(C.cut(F.col("ws"), 12, kind), " ")).alias(f"{kind}_md5")
    return table(spark, sf_dir, "conversations").withColumn("ws", ws).select(
        "conv_id", "turn", joined("head"), joined("tail"), joined("head_tail"), F.size(C.anchors(F.col("ws"), 8)).cast("long").alias("n_anchors"), F.md5(F.array_join(C.anchors(F.col("ws"), 8), "|")).alias("anchors_md5"),
    )


CUTS = f"""
WITH c AS (SELECT conv_id, turn, {_TOKENS.format("coalesce(text, '')")} AS ws FROM conversations),
a AS (SELECT conv_id, turn, ws, CASE WHEN len(ws) > 8 THEN list_transform([0, 1, 2, 3, 4], lambda q: array_to_string(list_slice(ws, CAST(floor((len(ws) - 8) * q / 4) AS BIGINT) + 1, CAST(floor((len(ws) - 8) * q / 4) AS BIGINT) + 8), ' ')) ELSE [array_to_string(ws, ' ')] END AS runs FROM c),
b AS (SELECT conv_id, turn, ws, list_filter(runs, lambda x, i: length(x) >= 24 AND list_position(runs, x) = i) AS an FROM a)
SELECT conv_id, turn, md5(array_to_string(list_slice(ws, 1, 12), ' ')) AS head_md5, md5(array_to_string(list_slice(ws, greatest(len(ws) - 11, 1), len(ws)), ' ')) AS tail_md5,
  md5(array_to_string(CASE WHEN len(ws) <= 12 THEN ws ELSE list_concat(list_slice(ws, 1, 6), list_slice(ws, len(ws) - 5, len(ws))) END, ' ')) AS head_tail_md5, CAST(len(an) AS BIGINT) AS n_anchors, md5(array_to_string(an, '|')) AS anchors_md5 FROM b"""


def text_summaries(spark, sf_dir):
    s = C.summary(F.col("text"), 80)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(s).cast("long").alias("n_chars"), F.md5(s).alias("summary_md5"))


SUMMARIES = r"""
WITH p AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'), '^ | $', '', 'g') AS t FROM conversations), h AS (SELECT *, substr(t, 1, 80) AS h, length(substr(t, 1, 80)) - strpos(reverse(substr(t, 1, 80)), ' .') AS stop FROM p),
s AS (SELECT conv_id, turn, CASE WHEN length(t) <= 80 THEN t WHEN strpos(h, '. ') > 0 AND stop >= 40 THEN substr(h, 1, stop) ELSE regexp_replace(h, ' +$', '') || '...' END AS s FROM h)
SELECT conv_id, turn, length(s) AS n_chars, md5(s) AS summary_md5 FROM s"""


def bigram_and_dice(spark, sf_dir):
    """Part names against types: Jaccard of character pairs, and Dice of words."""
    a, b = C.ngrams(T.ascii_lower(F.col("p_name"))), C.ngrams(T.ascii_lower(F.col("p_type")))
    x, y = F.array_distinct(C.ngrams(F.col("p_name"), 1)), F.array_distinct(C.ngrams(F.col("p_brand"), 1))
    return table(spark, sf_dir, "part").select("p_partkey", rounded(T.set_jaccard(a, b)).alias("bigram"), rounded(C.dice(x, y)).alias("dice"))


_GRAMS = "list_distinct(list_transform(range(1, length({0}) - {1} + 2), lambda i: substr({0}, i, {1})))"
BIGRAM = f"""
WITH g AS (SELECT p_partkey, {_GRAMS.format('lower(p_name)', 2)} AS a, {_GRAMS.format('lower(p_type)', 2)} AS b, {_GRAMS.format('p_name', 1)} AS x, {_GRAMS.format('p_brand', 1)} AS y FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6)::DOUBLE AS bigram, round(2 * len(list_intersect(x, y)) / (len(x) + len(y)), 6)::DOUBLE AS dice FROM g"""


def vector_forms(spark, sf_dir):
    """Vectors against their label's first: the cosine that may be null, the one with an epsilon, and the length of the unit vector."""
    v = table(spark, sf_dir, "embeddings")
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("other"))
    e = v.join(F.broadcast(first), "label")
    a = F.when(F.col("vec_id") % 10 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    return e.withColumn("a", a).select(
        "vec_id", rounded(V.cosine_or_null(F.col("a"), F.col("other"))).alias("nullable"), rounded(V.cosine_with_eps(F.col("a"), F.col("other"))).alias("eps"), rounded(V.norm(V.unit(F.col("a")))).alias("size"),
    )


VECTORS = """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), f AS (SELECT label, min_by(e, vec_id) AS o FROM v GROUP BY label),
n AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN list_transform(e, lambda x: 0.0::DOUBLE) ELSE e END AS a, o FROM v JOIN f USING (label)),
d AS (SELECT vec_id, list_dot_product(a, o) AS ao, sqrt(list_dot_product(a, a)) AS na, sqrt(list_dot_product(o, o)) AS no FROM n)
SELECT vec_id, round(CASE WHEN na * no > 0 THEN ao / (na * no) END, 6)::DOUBLE AS nullable, round(ao / (na * no + 1e-10), 6)::DOUBLE AS eps, CASE WHEN na > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS size FROM d"""


def depth_thresholds(spark, sf_dir):
    """Of each turn the threshold of its depth in a tree, and the route of its conversation by hash."""
    route = F.conv(F.substring(F.md5(F.col("conv_id").cast("string")), 1, 8), 16, 10).cast("long") % 7
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rounded(depth_threshold(F.col("turn"), 0.3, 0.5, 8)).alias("threshold"), route.alias("route"))


DEPTHS = "SELECT conv_id, turn, round(0.3 * exp(0.5 * turn / 8), 6)::DOUBLE AS threshold, CAST('0x' || substr(md5(CAST(conv_id AS VARCHAR)), 1, 8) AS BIGINT) % 7 AS route FROM conversations"


def history_read(spark, sf_dir):
    """The log of user 5 in the order of change, each with the event it replaced."""
    e = _events(spark, sf_dir).where("user_id = 5")
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return e.select("event_id", "event_type", F.lag("event_id").over(w).alias("replaced"), F.row_number().over(w).cast("long").alias("version"))


HISTORY = "SELECT event_id, event_type, lag(event_id) OVER w AS replaced, row_number() OVER w AS version FROM events WHERE user_id = 5 WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)"


def _memories(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("at", F.unix_micros("ts"))
    half = e.where("event_id % 2 = 0").groupBy("user_id", "event_type")
    other = e.where("event_id % 2 = 1").where("user_id % 3 > 0").groupBy("user_id", "event_type")
    side = lambda g: g.agg(F.min("at").alias("created_at"), F.max("at").alias("updated_at"), F.max_by("event_id", F.struct("at", "event_id")).alias("event_id"))
    return side(half), side(other)


_SIDES = """
h AS (SELECT user_id, event_type, min(epoch_us(ts)) AS created_at, max(epoch_us(ts)) AS updated_at, max_by(event_id, (ts, event_id)) AS event_id FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
o AS (SELECT user_id, event_type, min(epoch_us(ts)) AS created_at, max(epoch_us(ts)) AS updated_at, max_by(event_id, (ts, event_id)) AS event_id FROM events WHERE event_id % 2 = 1 AND user_id % 3 > 0 GROUP BY ALL)"""


def on_conflict_upsert(spark, sf_dir):
    """Memories of even events with those of odd ones put over them; created_at stays as it was first."""
    return M.upserted(*_memories(spark, sf_dir), ["user_id", "event_type"], ("created_at",))


UPSERT = f"""WITH {_SIDES} SELECT user_id, event_type, coalesce(h.created_at, o.created_at) AS created_at, coalesce(o.updated_at, h.updated_at) AS updated_at, coalesce(o.event_id, h.event_id) AS event_id FROM h FULL JOIN o USING (user_id, event_type)"""


def insert_if_absent(spark, sf_dir):
    return M.inserted_if_absent(*_memories(spark, sf_dir), ["user_id", "event_type"])


ABSENT = f"WITH {_SIDES} SELECT * FROM h UNION ALL SELECT * FROM o WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM h)"


def orphan_delete(spark, sf_dir):
    """Memories whose source has no row any more, and those that no event used since a day: how many of each user would go."""
    old, new = _memories(spark, sf_dir)
    gone = old.join(new.select("user_id", "event_type"), ["user_id", "event_type"], "left_anti")
    unused = F.col("updated_at") < F.unix_micros(F.lit("2024-01-28").cast("timestamp"))
    return gone.groupBy("user_id").agg(F.count("*").alias("n_orphans"), F.sum(unused.cast("long")).alias("n_expired"))


ORPHANS = f"""WITH {_SIDES} SELECT user_id, count(*) AS n_orphans, CAST(count(*) FILTER (updated_at < epoch_us(TIMESTAMP '2024-01-28')) AS BIGINT) AS n_expired FROM h WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM o) GROUP BY user_id"""


def soft_delete_restore(spark, sf_dir):
    """What is alive when errors delete a user's memory and sign-ups restore it, and what stays deleted."""
    e = _events(spark, sf_dir).where("event_type in ('error', 'signup')").select("user_id", "ts", "event_id", "event_type")
    last = M.last_wins(e, ["user_id"], ["ts", "event_id"])
    return last.select("user_id", (F.col("event_type") == "error").alias("deleted"))


RESTORE = "SELECT user_id, event_type = 'error' AS deleted FROM events WHERE event_type IN ('error', 'signup') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def replace_working_memory(spark, sf_dir):
    """A user's working memory after the first 20 new events come in: the eight latest of all stay."""
    e = _events(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    first = e.withColumn("n", F.row_number().over(w)).where("n <= 20").select("user_id", "ts", "event_id")
    return M.keep_latest(first, "user_id", ["ts", "event_id"], 8).select("user_id", "event_id", "place")


WORKING = """WITH f AS (SELECT user_id, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 20)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM f QUALIFY place <= 8"""


def undo_pointer(spark, sf_dir):
    """For each event the checkpoint (purchase) before it, whose number is the largest below its own."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = _events(spark, sf_dir).withColumn("number", F.row_number().over(w).cast("long"))
    back = F.max(F.when(F.col("event_type") == "purchase", F.col("number"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return n.select("event_id", "number", back.alias("undo_to"))


UNDO = """WITH n AS (SELECT user_id, ts, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number FROM events)
SELECT event_id, number, max(number) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS undo_to FROM n"""


def edge_type_index(spark, sf_dir):
    """Texts of edges by type with their counts, and the first triplet of each as a text."""
    e = _events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k"))
    text = F.concat_ws(" -> ", F.concat(F.lit("user "), "user_id"), "event_type", F.concat(F.lit("key "), "k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.min_by(text, "event_id").alias("first_text"))


EDGE_TYPES = "SELECT event_type, count(*) AS n, min_by('user ' || user_id || ' -> ' || event_type || ' -> key ' || json_extract_string(props, '$.k'), event_id) AS first_text FROM events GROUP BY event_type"


def lfu_eviction(spark, sf_dir):
    """The least used memories of each kind go until five stay; the oldest of equally used ones first."""
    used = _events(spark, sf_dir).groupBy("event_type", "user_id").agg(F.count("*").alias("uses"), F.min("event_id").alias("first"))
    w = Window.partitionBy("event_type").orderBy(F.desc("uses"), F.desc("first"))
    return used.withColumn("place", F.row_number().over(w)).where("place > 5").select("event_type", "user_id", "uses")


LFU = """WITH u AS (SELECT event_type, user_id, count(*) AS uses, min(event_id) AS first FROM events GROUP BY ALL)
SELECT event_type, user_id, uses FROM u QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY uses DESC, first DESC) > 5"""


def hottest_segment(spark, sf_dir):
    hot = _events(spark, sf_dir).groupBy("event_type", "user_id").agg(rounded(F.count("*") * 0.8 + F.count_if(F.col("value") > 50) * 0.8).alias("heat"))
    return hot.groupBy("event_type").agg(F.max_by(F.struct("user_id", "heat"), F.struct("heat", -F.col("user_id"))).alias("x")).select("event_type", "x.user_id", "x.heat")


HOTTEST = """SELECT event_type, user_id, heat FROM (SELECT event_type, user_id, round(count(*) * 0.8 + count(*) FILTER (value > 50) * 0.8, 6)::DOUBLE AS heat FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY heat DESC, user_id) = 1"""


def scaled_metric_means(spark, sf_dir):
    """Means of metrics, times 100 but for lengths and times; text that is no number is left out."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    long = d.select(F.explode(F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("output_len"), F.col("n_chars").cast("string"), F.lit("source"), F.col("source"))).alias("metric", "value"))
    mean = F.avg(F.col("value").try_cast("double"))
    scale = F.when(F.col("metric").rlike("_len|_time"), 1).otherwise(100)
    return long.groupBy("metric").agg(F.count(F.col("value").try_cast("double")).alias("n"), rounded(mean * scale, 4).alias("mean"))


SCALED = """WITH d AS (SELECT CAST(quality AS VARCHAR) AS q, CAST(n_chars AS VARCHAR) AS n, source FROM documents LEFT JOIN labels USING (doc_id)), l AS (SELECT 'quality' AS metric, q AS value FROM d UNION ALL SELECT 'output_len', n FROM d UNION ALL SELECT 'source', source FROM d)
SELECT metric, count(TRY_CAST(value AS DOUBLE)) AS n, round(avg(TRY_CAST(value AS DOUBLE)) * CASE WHEN regexp_matches(metric, '_len|_time') THEN 1 ELSE 100 END, 4)::DOUBLE AS mean FROM l GROUP BY metric"""


def write_read_totals(spark, sf_dir):
    """Write and read operations and their mean cost: a context's first row counts as its write, all others as reads."""
    e = _events(spark, sf_dir)
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) == 1
    split = e.select("event_type", "value", first.alias("is_write"))
    return split.groupBy(F.when(F.col("is_write"), "write").otherwise("read").alias("op")).agg(F.count("*").alias("n"), rounded(F.sum("value"), 4).alias("total"), rounded(F.avg("value")).alias("mean"))


TOTALS = """SELECT CASE WHEN first THEN 'write' ELSE 'read' END AS op, count(*) AS n, round(sum(value), 4)::DOUBLE AS total, round(avg(value), 6)::DOUBLE AS mean
FROM (SELECT value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS first FROM events) GROUP BY 1"""


def token_statistics(spark, sf_dir):
    """Calls and words by role: of turns as prompts, of the turns that follow as completions, and both."""
    n = F.size(T.tokens(F.col("text"))).cast("long")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", n.alias("prompt"))
    c = c.withColumn("completion", F.coalesce(F.lead("prompt").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(0).cast("long")))
    return c.groupBy("role").agg(F.count("*").alias("calls"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.sum(F.col("prompt") + F.col("completion")).alias("total"))


TOKENS = f"""WITH c AS (SELECT conv_id, turn, role, CAST(len({_TOKENS.format("coalesce(text, '')")}) AS BIGINT) AS p FROM conversations), d AS (SELECT *, coalesce(lead(p) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS q FROM c)
SELECT role, count(*) AS calls, CAST(sum(p) AS BIGINT) AS prompt, CAST(sum(q) AS BIGINT) AS completion, CAST(sum(p + q) AS BIGINT) AS total FROM d GROUP BY role"""


def importance_scores(spark, sf_dir):
    """How often a user clicks or views against all its events; 0 without events of the last days."""
    e = _events(spark, sf_dir)
    late = F.count_if(F.col("ts") >= F.lit("2024-01-10").cast("timestamp"))
    acts = F.count_if(F.col("event_type").isin("click", "view") & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp")))
    return e.groupBy("user_id").agg(rounded(F.when(late > 0, acts / late).otherwise(0.0)).alias("importance"))


IMPORTANCE = """SELECT user_id, round(CASE WHEN count(*) FILTER (ts >= TIMESTAMP '2024-01-10') > 0 THEN count(*) FILTER (event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-10') / count(*) FILTER (ts >= TIMESTAMP '2024-01-10') ELSE 0 END, 6)::DOUBLE AS importance FROM events GROUP BY user_id"""


def out_of_order_gaps(spark, sf_dir):
    """Events in the order of their ids: how many come earlier than the one before, by type."""
    w = Window.partitionBy("event_type").orderBy(F.col("event_id") * 7919 % 10007, "event_id")
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)
    return _events(spark, sf_dir).select("event_type", F.when(gap < 0, "out of order").when(gap.isNull(), "first").otherwise("in order").alias("label")).groupBy("event_type", "label").agg(F.count("*").alias("n"))


GAPS = """SELECT event_type, CASE WHEN g < 0 THEN 'out of order' WHEN g IS NULL THEN 'first' ELSE 'in order' END AS label, count(*) AS n
FROM (SELECT event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY event_id * 7919 % 10007, event_id) AS g FROM events) GROUP BY ALL"""


def consolidation_window(spark, sf_dir):
    """Each user's next window: from the last purchase on six hours, what it holds, where the pointer goes and whether there is more."""
    e = _events(spark, sf_dir).select("user_id", "event_type", F.unix_micros("ts").alias("at"))
    start = e.groupBy("user_id").agg(F.max(F.when((F.col("event_type") == "purchase") & (F.col("at") < F.unix_micros(F.lit("2024-01-20").cast("timestamp"))), F.col("at"))).alias("start"))
    inside = F.col("at").between(F.col("start"), F.col("start") + 21_600_000_000)
    joined = e.join(F.broadcast(start), "user_id").where("start is not null")
    return joined.groupBy("user_id").agg(F.count_if(inside).alias("n"), F.max(F.when(inside, F.col("at"))).alias("pointer"), F.max(F.col("at") > F.col("start") + 21_600_000_000).alias("more"))


CONSOLIDATION = """WITH s AS (SELECT user_id, max(epoch_us(ts)) AS start FROM events WHERE event_type = 'purchase' AND ts < TIMESTAMP '2024-01-20' GROUP BY user_id)
SELECT user_id, count(*) FILTER (epoch_us(ts) BETWEEN start AND start + 21600000000) AS n, max(epoch_us(ts)) FILTER (epoch_us(ts) BETWEEN start AND start + 21600000000) AS pointer, bool_or(epoch_us(ts) > start + 21600000000) AS more FROM events JOIN s USING (user_id) GROUP BY user_id"""

QUERIES = {
    "facet_filter": (facet_filter, FACETS), "tenant_or_shared": (tenant_or_shared, TENANT), "closed_range_filter": (closed_range_filter, RANGES),
    "symbolic_filter": (symbolic_filter, SYMBOLIC), "completed_contexts": (completed_contexts, COMPLETED), "too_short_and_changed": (too_short_and_changed, CHANGED),
    "date_formats": (date_formats, DATES), "session_times": (session_times, SESSION_TIMES), "time_id_window": (time_id_window, ID_WINDOW),
    "text_cleaning": (text_cleaning, CLEANING), "token_cuts": (token_cuts, CUTS), "text_summaries": (text_summaries, SUMMARIES), "bigram_and_dice": (bigram_and_dice, BIGRAM),
    "vector_forms": (vector_forms, VECTORS), "depth_thresholds": (depth_thresholds, DEPTHS), "history_read": (history_read, HISTORY), "on_conflict_upsert": (on_conflict_upsert, UPSERT),
    "insert_if_absent": (insert_if_absent, ABSENT), "orphan_delete": (orphan_delete, ORPHANS), "soft_delete_restore": (soft_delete_restore, RESTORE),
    "replace_working_memory": (replace_working_memory, WORKING), "undo_pointer": (undo_pointer, UNDO), "edge_type_index": (edge_type_index, EDGE_TYPES),
    "lfu_eviction": (lfu_eviction, LFU), "hottest_segment": (hottest_segment, HOTTEST), "scaled_metric_means": (scaled_metric_means, SCALED),
    "write_read_totals": (write_read_totals, TOTALS), "token_statistics": (token_statistics, TOKENS), "importance_scores": (importance_scores, IMPORTANCE),
    "out_of_order_gaps": (out_of_order_gaps, GAPS), "consolidation_window": (consolidation_window, CONSOLIDATION),
}
