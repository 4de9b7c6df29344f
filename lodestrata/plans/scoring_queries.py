"""Queries that score outputs against gold answers, with the SQL that gives the same rows.

Outputs are made of the conversations: each turn's gold is the first sentence of the turn before it, and
its output is that gold in five wordings, or the turn itself.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import scoring as S
from lodestrata.functions import text as T
from lodestrata.plans.text_queries import _ANSWER, _LOWER
from lodestrata.session import rounded, table


def _outputs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = c.select("conv_id", "turn", "text", F.substring_index(F.lag("text").over(w), ".", 1).alias("gold")).where("gold is not null")
    n = F.col("turn") % 5
    output = (
        F.when(n == 0, F.concat(F.lit("The final answer is "), "gold")).when(n == 1, F.col("text"))
        .when(n == 2, F.concat(F.lit("Well.\nAnswer: answer: "), "gold", F.lit("\nmore")))
        .when(n == 3, F.concat(F.lit("The "), "gold", F.lit("!"))).otherwise(F.concat(F.lit("Label: "), (F.col("turn") * 7 % 13).cast("string"), F.lit(" of 20")))
    )
    return t.select("conv_id", "turn", "text", "gold", output.alias("output"))


_OUT = """
t AS (SELECT conv_id, turn, text, string_split(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '.')[1] AS gold FROM conversations),
o AS (SELECT conv_id, turn, text, gold, CASE turn % 5 WHEN 0 THEN 'The final answer is ' || gold WHEN 1 THEN text WHEN 2 THEN 'Well.' || chr(10) || 'Answer: answer: ' || gold || chr(10) || 'more'
  WHEN 3 THEN 'The ' || gold || '!' ELSE 'Label: ' || (turn * 7 % 13) || ' of 20' END AS output FROM t WHERE gold IS NOT NULL)"""
_TRIM = r"regexp_replace({0}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"


def answer_extraction(spark, sf_dir):
    o = F.col("output")
    return _outputs(spark, sf_dir).select(
        "conv_id", "turn", F.md5(S.parsed_output(o)).alias("parsed_md5"), F.md5(F.coalesce(S.answer_span(o), F.lit("-"))).alias("span_md5"),
        S.label_prediction(o).alias("label"), F.md5(S.first_sentence(o)).alias("sentence_md5"), F.size(T.answer_tokens(o)).cast("long").alias("n_words"),
    )


_PARSED = "CASE WHEN regexp_matches(output, '(?i)answer:') THEN " + _TRIM.format("regexp_replace(regexp_extract(output, '(?i)answer:([^\\n]*)', 1), '(?i)answer:', '', 'g')") + " ELSE " + _TRIM.format("string_split(output, chr(10))[1]") + " END"
EXTRACTION = f"""
WITH {_OUT} SELECT conv_id, turn, md5({_PARSED}) AS parsed_md5,
  md5(coalesce(nullif(regexp_extract(output, '^(?i:(?:the )?(?:final )?answer is):?[\\x20]*([^\\n]*)$', 1), ''), '-')) AS span_md5,
  TRY_CAST(coalesce(nullif(regexp_extract(output, '(?i:label):[\\x20]*([0-9]+)', 1), ''), nullif(regexp_extract(output, '^[\\x20\\x09-\\x0D]*([0-9]+)[\\x20\\x09-\\x0D]*$', 1), '')) AS BIGINT) AS label,
  md5({_TRIM.format("string_split(regexp_replace(output, '([.!?。！？])[\\x20\\x09-\\x0D]+|\\n+', '\\1' || chr(1), 'g'), chr(1))[1]")}) AS sentence_md5,
  CAST(len({_ANSWER.format('output')}) AS BIGINT) AS n_words FROM o"""


def rouge_l_pairs(spark, sf_dir):
    """ROUGE-L of whole normalised turns against the sentence before them."""
    o = _outputs(spark, sf_dir).select("conv_id", "turn", T.answer_tokens(F.col("output")).alias("p"), T.answer_tokens(F.col("gold")).alias("g"))
    o = o.withColumn("common", S.lcs_length(F.col("p"), F.col("g")))
    p, r, f = S.rouge_l(F.col("common"), F.size("p"), F.size("g"))
    return o.select("conv_id", "turn", "common", rounded(p).alias("precision"), rounded(r).alias("recall"), rounded(f).alias("f1"))


ROUGE = f"""
WITH RECURSIVE {_OUT}, p AS (SELECT conv_id, turn, {_ANSWER.format('output')} AS p, {_ANSWER.format('gold')} AS g FROM o),
r AS (SELECT conv_id, turn, p, g, 0 AS i, list_transform(range(0, len(p) + 1), lambda x: CAST(0 AS BIGINT)) AS c FROM p
 UNION ALL SELECT conv_id, turn, p, g, i + 1, list_reduce(list_transform(range(1, len(p) + 1), lambda j: [j]), lambda acc, j: list_append(acc, CASE WHEN g[i + 1] = p[j[1]] THEN c[j[1]] + 1 ELSE greatest(c[j[1] + 1], acc[-1]) END), [CAST(0 AS BIGINT)]) FROM r WHERE i < len(g)),
f AS (SELECT *, c[-1] AS common FROM r WHERE i = len(g))
SELECT conv_id, turn, common, round(CASE WHEN common > 0 THEN common / len(p) ELSE 0 END, 6)::DOUBLE AS precision, round(CASE WHEN common > 0 THEN common / len(g) ELSE 0 END, 6)::DOUBLE AS recall,
 round(CASE WHEN common > 0 THEN 2 * (common / len(p)) * (common / len(g)) / (common / len(p) + common / len(g)) ELSE 0 END, 6)::DOUBLE AS f1 FROM f"""


def _candidates(spark, sf_dir):
    """Three candidates of each output: raw, parsed, and its first sentence, each against two golds."""
    o = _outputs(spark, sf_dir)
    c = F.posexplode(F.array("output", S.parsed_output(F.col("output")), S.first_sentence(F.col("output")))).alias("n", "candidate")
    rows = o.select("conv_id", "turn", "gold", c).select("conv_id", "turn", "n", "candidate", F.explode(F.array("gold", F.substring_index("gold", " ", 4))).alias("one"))
    p = F.col("candidate")
    scored = rows.select(
        "conv_id", "turn", "n", T.exact_match(p, F.col("one")).alias("em"), T.substring_match(p, F.col("one")).alias("sub"),
        rounded(S.answer_f1(p, F.col("one"))).alias("f1"), F.size(T.answer_tokens(p)).alias("n_words"),
    )
    return scored.groupBy("conv_id", "turn", "n").agg(F.max("em").alias("em"), F.max("sub").alias("sub"), F.max("f1").alias("f1"), F.max("n_words").alias("n_words"))


_F1 = "round(CASE WHEN (array_to_string(p, ' ') IN ('yes', 'no', 'noanswer') OR array_to_string(g, ' ') IN ('yes', 'no', 'noanswer')) AND p <> g THEN 0 WHEN common > 0 THEN 2 * common / (len(p) + len(g)) ELSE 0 END, 6)::DOUBLE"
_COMMON = "list_sum(list_transform(list_distinct(list_intersect(p, g)), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(g, lambda y: y = x)))))"
_CAND = f"""{_OUT}, c AS (SELECT conv_id, turn, unnest([0, 1, 2]) AS n, unnest([output, {_PARSED}, {_TRIM.format("string_split(regexp_replace(output, '([.!?。！？])[\\x20\\x09-\\x0D]+|\\n+', '\\1' || chr(1), 'g'), chr(1))[1]")}]) AS candidate, gold FROM o),
d AS (SELECT conv_id, turn, n, candidate, unnest([gold, array_to_string(list_slice(string_split(gold, ' '), 1, 4), ' ')]) AS one FROM c),
e AS (SELECT conv_id, turn, n, {_ANSWER.format('candidate')} AS p, {_ANSWER.format('one')} AS g FROM d),
h AS (SELECT *, {_COMMON} AS common FROM e),
s AS (SELECT conv_id, turn, n, CAST(p = g AS DOUBLE) AS em, CAST(contains(array_to_string(p, ' '), array_to_string(g, ' ')) AS DOUBLE) AS sub, {_F1} AS f1, len(p) AS n_words FROM h),
m AS (SELECT conv_id, turn, n, max(em) AS em, max(sub) AS sub, max(f1) AS f1, max(n_words) AS n_words FROM s GROUP BY ALL)"""


def gold_max_metrics(spark, sf_dir):
    """Of each output the highest of every metric over all golds and candidates."""
    return _candidates(spark, sf_dir).groupBy("conv_id", "turn").agg(F.max("em").alias("em"), F.max("sub").alias("sub"), F.max("f1").alias("f1"))


GOLD_MAX = f"WITH {_CAND} SELECT conv_id, turn, max(em) AS em, max(sub) AS sub, max(f1) AS f1 FROM m GROUP BY conv_id, turn"


def best_candidate(spark, sf_dir):
    """Of each output's candidates the best by exact match, substring match, F1 and then fewer words; the first wins ties."""
    key = F.struct("em", "sub", "f1", (-F.col("n_words")).alias("w"), (-F.col("n")).alias("k"))
    best = _candidates(spark, sf_dir).groupBy("conv_id", "turn").agg(F.max_by(F.struct("n", "em", "sub", "f1"), key).alias("b"))
    return best.select("conv_id", "turn", F.col("b.n").cast("long").alias("candidate"), "b.em", "b.sub", "b.f1")


BEST = f"WITH {_CAND} SELECT conv_id, turn, CAST(n AS BIGINT) AS candidate, em, sub, f1 FROM m QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY em DESC, sub DESC, f1 DESC, n_words, n) = 1"


def pooled_em_f1(spark, sf_dir):
    """Means of the best exact match and F1 over all outputs, times 100, by which wording the output has."""
    m = gold_max_metrics(spark, sf_dir)
    return m.groupBy((F.col("turn") % 5).alias("wording")).agg(F.count("*").alias("n"), rounded(F.avg("em") * 100, 4).alias("em"), rounded(F.avg("f1") * 100, 4).alias("f1"))


POOLED = f"SELECT turn % 5 AS wording, count(*) AS n, round(avg(em) * 100, 4)::DOUBLE AS em, round(avg(f1) * 100, 4)::DOUBLE AS f1 FROM ({GOLD_MAX}) GROUP BY 1"


def option_extraction(spark, sf_dir):
    """Options of outputs in four wordings, and the choice that follows from the text where no option is named."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    letter = F.substring(F.lit("ABCD"), (F.col("turn") % 4 + 1).cast("int"), 1)
    n = (F.col("conv_id") + F.col("turn")) % 4
    output = F.when(n == 0, F.concat(F.lit(" ("), letter, F.lit(") "))).when(n == 1, F.concat(F.lit("So the answer is "), letter, F.lit(", as said"))).when(n == 2, F.concat(letter, F.lit(") because"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", S.option_prediction(output).alias("option"), F.md5(S.choice_text(output)).alias("choice_md5"), F.size(S.choice_tokens(output)).cast("long").alias("n_tokens"))


OPTION = r"""
WITH c AS (SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN ' (' || substr('ABCD', CAST(turn % 4 + 1 AS INT), 1) || ') ' WHEN 1 THEN 'So the answer is ' || substr('ABCD', CAST(turn % 4 + 1 AS INT), 1) || ', as said'
  WHEN 2 THEN substr('ABCD', CAST(turn % 4 + 1 AS INT), 1) || ') because' ELSE text END AS output FROM conversations)
SELECT conv_id, turn, coalesce(nullif(regexp_extract(output, '^[\x20\x09-\x0D]*\(?([A-D])\)?[.]?[\x20\x09-\x0D]*$', 1), ''), nullif(regexp_extract(output, '(?i:answer)[\x20]*(?:is|:)[\x20]*\(?([A-D])(?:[^A-Za-z0-9_]|$)', 1), ''), nullif(regexp_extract(output, '^[\x20\x09-\x0D]*\(?([A-D])[).:]', 1), '')) AS option,
  md5(regexp_replace(regexp_replace(regexp_replace(""" + _LOWER.format("output") + r""", '[\x20\x09-\x0D]+', ' ', 'g'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '^[!-/:-@\[-`{-~\x20]+|[!-/:-@\[-`{-~\x20]+$', '', 'g')) AS choice_md5,
  CAST(len(list_filter(regexp_split_to_array(""" + _LOWER.format("output") + r""", '[^a-z0-9]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM c"""


def option_by_choice_text(spark, sf_dir):
    """Which of four choices (the turns of one conversation's first sentences) an output names: by token F1 of .55 at least and .08 more than the next."""
    o = _outputs(spark, sf_dir).select("conv_id", "turn", "output", "gold")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, 0)
    o = o.withColumn("golds", F.collect_list("gold").over(w))
    choices = o.select("conv_id", "turn", S.choice_tokens(F.col("output")).alias("p"), F.posexplode("golds").alias("n", "choice"))
    scored = choices.select("conv_id", "turn", "n", rounded(S.f1_of_tokens(F.col("p"), S.choice_tokens(F.col("choice")))).alias("f1"))
    best = scored.groupBy("conv_id", "turn").agg(F.max(F.struct("f1", (-F.col("n")).alias("k"))).alias("b"), F.slice(F.sort_array(F.collect_list("f1"), False), 1, 2).alias("two"))
    second = F.coalesce(F.get("two", F.lit(1)), F.lit(0.0))
    sure = (F.col("b.f1") >= 0.55) & (F.col("b.f1") - second >= 0.08)
    return best.select("conv_id", "turn", F.when(sure, -F.col("b.k")).cast("long").alias("choice"), F.col("b.f1").alias("f1"))


_CTOK = "list_filter(regexp_split_to_array(" + _LOWER + ", '[^a-z0-9]+'), lambda x: x <> '')"
CHOICE = f"""
WITH {_OUT}, c AS (SELECT conv_id, turn, output, list(gold) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS golds FROM o),
x AS (SELECT conv_id, turn, {_CTOK.format('output')} AS p, unnest(golds) AS choice, generate_subscripts(golds, 1) - 1 AS n FROM c),
y AS (SELECT conv_id, turn, n, p, {_CTOK.format('choice')} AS g FROM x), z AS (SELECT *, {_COMMON} AS common FROM y),
s AS (SELECT conv_id, turn, n, round(CASE WHEN common > 0 THEN 2 * common / (len(p) + len(g)) ELSE 0 END, 6)::DOUBLE AS f1 FROM z),
r AS (SELECT *, row_number() OVER w AS k, coalesce(lead(f1) OVER w, 0) AS next FROM s WINDOW w AS (PARTITION BY conv_id, turn ORDER BY f1 DESC, n))
SELECT conv_id, turn, CASE WHEN f1 >= 0.55 AND f1 - next >= 0.08 THEN CAST(n AS BIGINT) END AS choice, f1 FROM r WHERE k = 1"""


def judge_labels(spark, sf_dir):
    """Labels as a judge's responses in five wordings: as an object, fenced, in words; what they say and how many of each are right."""
    d = table(spark, sf_dir, "labels")
    good, n = F.col("quality") == 1, F.col("doc_id") % 5
    said = F.when(good, "correct").otherwise("wrong")
    response = (
        F.when(n == 0, F.concat(F.lit('{"label": "'), said, F.lit('"}'))).when(n == 1, F.concat(F.lit('Sure:\n```json\n{"label": "'), said, F.lit('", "why": "x"}\n```')))
        .when(n == 2, F.when(good, "It is INCORRECT to doubt it").otherwise("wrong, no")).when(n == 3, F.when(good, "yes").otherwise("No")).otherwise(F.lit("unsure"))
    )
    rows = d.select("doc_id", S.judge_label(response).alias("label"))
    return rows.groupBy("label", S.judge_bool(F.col("label")).alias("verdict")).agg(F.count("*").alias("n"))


JUDGE = """
WITH r AS (SELECT CASE doc_id % 5 WHEN 0 THEN '{"label": "' || CASE WHEN quality = 1 THEN 'correct' ELSE 'wrong' END || '"}' WHEN 1 THEN 'Sure: {"label": "' || CASE WHEN quality = 1 THEN 'correct' ELSE 'wrong' END || '", "why": "x"}'
  WHEN 2 THEN CASE WHEN quality = 1 THEN 'It is INCORRECT to doubt it' ELSE 'wrong, no' END WHEN 3 THEN CASE WHEN quality = 1 THEN 'yes' ELSE 'No' END ELSE 'unsure' END AS s FROM labels),
l AS (SELECT CASE WHEN contains(upper(s), 'CORRECT') THEN 'CORRECT' WHEN contains(upper(s), 'WRONG') THEN 'WRONG' WHEN contains(upper(s), 'YES') THEN 'YES' WHEN contains(upper(s), 'NO') THEN 'NO' END AS label FROM r)
SELECT label, CASE WHEN label IN ('CORRECT', 'YES') THEN true WHEN label IS NOT NULL THEN false END AS verdict, count(*) AS n FROM l GROUP BY ALL"""


def contained_elements(spark, sf_dir):
    """The share of a turn's gold elements (the words of its gold from four letters on) that the output holds, and whether all are."""
    golds = F.filter(F.split("gold", " "), lambda w: F.length(w) >= 4)
    share = S.contained_share(F.col("output"), F.col("golds"))
    return _outputs(spark, sf_dir).select("conv_id", "turn", "output", golds.alias("golds")).select("conv_id", "turn", rounded(share).alias("share"), (share == 1.0).cast("double").alias("all_found"))


CONTAINED = f"""
WITH {_OUT}, g AS (SELECT conv_id, turn, output, list_filter(string_split(gold, ' '), lambda w: length(w) >= 4) AS golds FROM o),
s AS (SELECT conv_id, turn, CASE WHEN len(golds) > 0 THEN len(list_filter(golds, lambda w: contains({_LOWER.format('output')}, {_LOWER.format('w')}))) / len(golds) ELSE 0.0 END AS share FROM g)
SELECT conv_id, turn, round(share, 6)::DOUBLE AS share, CAST(share = 1.0 AS DOUBLE) AS all_found FROM s"""


def routed_score(spark, sf_dir):
    """One score for each output by the kind of its context: labels, contained elements, choices or the default, the better of raw and parsed."""
    o, kind = _outputs(spark, sf_dir), F.col("conv_id") % 3
    raw, parsed = S.answer_f1(F.col("output"), F.col("gold")), S.answer_f1(S.parsed_output(F.col("output")), F.col("gold"))
    score = F.when(kind == 0, (S.label_prediction(F.col("output")) == F.col("turn") * 7 % 13).cast("double")).when(kind == 1, F.contains(T.ascii_lower(F.col("output")), T.ascii_lower(F.col("gold"))).cast("double"))
    return o.select("conv_id", "turn", rounded(F.coalesce(score.otherwise(F.greatest(raw, parsed)), F.lit(0.0))).alias("score"))


ROUTED = f"""
WITH {_OUT}, q AS (SELECT conv_id, turn, output, gold, {_PARSED} AS parsed FROM o),
e AS (SELECT conv_id, turn, output, gold, unnest([{_ANSWER.format('output')}, {_ANSWER.format('parsed')}]) AS p, {_ANSWER.format('gold')} AS g FROM q), h AS (SELECT *, {_COMMON} AS common FROM e)
SELECT conv_id, turn, max(CASE conv_id % 3 WHEN 0 THEN CASE WHEN TRY_CAST(nullif(regexp_extract(output, '(?i:label):[\\x20]*([0-9]+)', 1), '') AS BIGINT) = turn * 7 % 13 THEN 1.0 ELSE 0.0 END
  WHEN 1 THEN CASE WHEN contains({_LOWER.format('output')}, {_LOWER.format('gold')}) THEN 1.0 ELSE 0.0 END ELSE {_F1} END)::DOUBLE AS score FROM h GROUP BY conv_id, turn"""

QUERIES = {
    "answer_extraction": (answer_extraction, EXTRACTION), "rouge_l_pairs": (rouge_l_pairs, ROUGE), "gold_max_metrics": (gold_max_metrics, GOLD_MAX),
    "best_candidate": (best_candidate, BEST), "pooled_em_f1": (pooled_em_f1, POOLED), "option_extraction": (option_extraction, OPTION),
    "option_by_choice_text": (option_by_choice_text, CHOICE), "judge_labels": (judge_labels, JUDGE), "contained_elements": (contained_elements, CONTAINED),
    "routed_score": (routed_score, ROUTED),
}
