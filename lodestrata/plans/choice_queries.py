"""Queries that find the option or choice an output means, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import scoring as S
from lodestrata.functions import text as T
from lodestrata.plans.scoring_queries import _COMMON, _CTOK, _F1, _OUT, _PARSED, _TRIM, _outputs
from lodestrata.plans.text_queries import _ANSWER, _LOWER
from lodestrata.session import rounded


def choice_chain(spark, sf_dir):
    """What outputs mean among four choices (the golds of a conversation's last four turns): by text, by the whole chain, whether that is right, and the plain metrics of the raw output.

    As the metrics drop articles, no option and option A compare as equal.
    """
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, 0)
    letter = lambda n: F.substring(F.lit("ABCD"), n.cast("int"), F.lit(1))
    told = F.concat(F.lit("So I think.\n("), letter(F.col("turn") % 4 + 1), F.lit(")"))
    o = _outputs(spark, sf_dir).withColumn("golds", F.collect_list("gold").over(w)).withColumn("output", F.when((F.col("conv_id") + F.col("turn")) % 6 == 0, told).otherwise(F.col("output")))
    output, golds, right = F.col("output"), F.col("golds"), letter(F.size("golds"))
    found = F.struct(right.alias("right"), S.choice_of_text(output, golds).alias("by_text"), S.option_chain(output, golds).alias("option"), T.answer_tokens(output).alias("raw"))

    def scored(x):
        em = lambda a: (a == F.array_join(T.answer_tokens(x["right"]), " ")).cast("double")
        raw, gold = F.array_join(x["raw"], " "), F.array_join(T.answer_tokens(x["right"]), " ")
        f1 = F.when(T.special_mismatch(raw, gold), 0.0).otherwise(S.f1_of_tokens(x["raw"], T.answer_tokens(x["right"])))
        return F.struct(x["by_text"].alias("by_text"), x["option"].alias("option"), em(F.array_join(T.answer_tokens(x["option"]), " ")).alias("em"), em(raw).alias("raw_em"), rounded(f1).alias("raw_f1"))

    # an array of one: the options are then found once, however often the metrics read them
    return o.select("conv_id", "turn", F.inline(F.transform(F.array(found), scored)))


def _norm(x: str) -> str:
    edges = r"'^[!-/:-@\[-`{-~\x20]+|[!-/:-@\[-`{-~\x20]+$'"
    return "regexp_replace(" + _TRIM.format("regexp_replace(" + _LOWER.format(x) + r", '[\x20\x09-\x0D]+', ' ', 'g')") + f", {edges}, '', 'g')"


def _option(x: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, '{p}', 1), '')" for p in S.OPTION_PATTERNS) + ")"


_LINES = "list_filter(list_transform(string_split(output, chr(10)), lambda l: " + _TRIM.format("l") + "), lambda l: l <> '')"
CHAIN = f"""
WITH {_OUT}, c AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 6 = 0 THEN 'So I think.' || chr(10) || '(' || substr('ABCD', CAST(turn % 4 + 1 AS INT), 1) || ')' ELSE output END AS output,
  list(gold) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS golds FROM o),
d AS (SELECT conv_id, turn, output, golds, substr('ABCD', len(golds), 1) AS ok, {_PARSED} AS parsed, {_LINES} AS ls FROM c),
x AS (SELECT conv_id, turn, golds, unnest([0, 1]) AS which, unnest([output, parsed]) AS pred FROM d),
y AS (SELECT conv_id, turn, which, {_norm('pred')} AS p, unnest(golds) AS choice, generate_subscripts(golds, 1) - 1 AS n FROM x),
z AS (SELECT conv_id, turn, which, n, p, {_norm('choice')} AS c FROM y),
k AS (SELECT *, {_CTOK.format('p')} AS pt, list_distinct({_CTOK.format('p')}) AS ps, list_distinct({_CTOK.format('c')}) AS cs FROM z WHERE p <> '' AND c <> ''),
s AS (SELECT *, round(CASE WHEN len(list_intersect(ps, cs)) > 0 THEN 2 * len(list_intersect(ps, cs)) / (len(ps) + len(cs)) + CASE WHEN contains(p, c) OR contains(c, p) THEN 0.15 ELSE 0 END ELSE 0 END, 9)::DOUBLE AS score,
  starts_with(c, p) OR starts_with(p, c) AS begun, length(p) >= 24 OR len(pt) >= 3 AS lengthy FROM k),
g AS (SELECT conv_id, turn, which, min(n) FILTER (c = p) AS same, CASE WHEN count(*) FILTER (begun) = 1 THEN min(n) FILTER (begun) END AS one, any_value(lengthy) AS lengthy,
  list(n ORDER BY score DESC, n)[1] AS top, max(score) AS best, coalesce(list(score ORDER BY score DESC)[2], 0) AS next FROM s GROUP BY conv_id, turn, which),
t2 AS (SELECT conv_id, turn, which, CAST(coalesce(same, CASE WHEN lengthy THEN coalesce(one, CASE WHEN best >= 0.55 AND round(best - next, 9) >= 0.08 THEN top END) END) AS BIGINT) AS choice FROM g),
e AS (SELECT d.conv_id, d.turn, output, ok, a.choice AS by_text, coalesce({_option('output')}, {_option('parsed')}, {_option('ls[1]')}, {_option('ls[-1]')}, substr('ABCD', a.choice + 1, 1), substr('ABCD', b.choice + 1, 1)) AS option
  FROM d LEFT JOIN t2 AS a ON a.conv_id = d.conv_id AND a.turn = d.turn AND a.which = 0 LEFT JOIN t2 AS b ON b.conv_id = d.conv_id AND b.turn = d.turn AND b.which = 1),
h AS (SELECT *, {_ANSWER.format("coalesce(option, '')")} AS o2, {_ANSWER.format('output')} AS p, {_ANSWER.format('ok')} AS g FROM e), h2 AS (SELECT *, {_COMMON} AS common FROM h)
SELECT conv_id, turn, by_text, option, CAST(o2 = g AS DOUBLE) AS em, CAST(p = g AS DOUBLE) AS raw_em, {_F1} AS raw_f1 FROM h2"""

QUERIES = {"choice_chain": (choice_chain, CHAIN)}
