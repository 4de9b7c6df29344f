"""Secret scans in native operations: fixed patterns, and a battery of randomness tests.

Every run of 20 or more key characters is a candidate. Its encoding is inferred, and under the
alphabet of that encoding three statistics are taken: Pearson's chi-squared for uniform symbols, the
number of runs above and below the alphabet's middle, and the lag-1 serial correlation. A candidate
is reported if
  - the three tests, joined by Fisher's method, do not reject randomness (p >= alpha), and
  - the hypothesis that it is ordinary text, whose symbols repeat as often as text symbols do
    (chi-squared then has a larger, non-central mean), is rejected at the false-discovery rate q.
The Benjamini-Hochberg rule runs over all candidates of the corpus, apart for each encoding and
each doubling of the length: short candidates are many and weakly told apart, and so need a
smaller p. It is taken on counts of p-values in bins of a tenth of a decade, which rounds up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm._shared import stored

#: Fixed patterns of the query contract, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Symbols of an encoding in order, and how often two symbols of ordinary text are equal.
HEX_SYMBOLS = "0123456789abcdef"
BASE32_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
TEXT_COINCIDENCE = {16: 0.14, 32: 0.075, 62: 0.065, 64: 0.065}
MAX_BIN = 400


def _spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """Array of (start, end, kind, token) of the matches that keep(match index, match) accepts; none without a match."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:int,end:int,kind:int,token:string>>")
    state = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), pair["match"].alias("token"))
        more = F.when(keep(pair), F.array_append(acc["out"], span)).otherwise(acc["out"])
        return F.struct(end.alias("at"), more.alias("out"))

    parts = {"gap": F.split(text, pattern, -1), "match": matches}
    if kind == 0:
        parts["value"] = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    # the last gap has no match after it
    pairs = F.slice(F.arrays_zip(*(v.alias(k) for k, v in parts.items())), F.lit(1), F.size(matches))
    return F.when(text.rlike(pattern), F.aggregate(pairs, state, step, lambda acc: acc["out"])).otherwise(empty)


def base_spans(text: Column) -> Column:
    """The spans of the fixed patterns, by start and then kind."""
    return F.array_sort(
        F.concat(
            _spans(text, ASSIGN, 0, lambda p: F.length(p["value"]) >= 6),
            _spans(text, ACCESS, 1, lambda p: F.length(p["match"]) >= 20),
            # a longest run of 24 or more is found as such, without stopping at each shorter run
            _spans(text, HEX[:-1] + "{24,}", 2, lambda p: F.lit(True)),
        ),
        lambda x, y: F.when((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["kind"] < y["kind"])), -1).otherwise(1),
    )


def _symbols(c: Column) -> Column:
    """A candidate with its symbols as numbers and the size of its alphabet."""
    token = c["token"]
    is_hex = token.rlike("^([0-9a-f]+|[0-9A-F]+)$")
    is_32 = token.rlike("^[A-Z2-7]+$")
    size = F.when(is_hex, 16).when(is_32, 32).when(token.rlike("[+/_-]"), 64).otherwise(62)
    alphabet = F.when(is_hex, HEX_SYMBOLS).when(is_32, BASE32_SYMBOLS).otherwise(BASE64_SYMBOLS)
    plain = F.when(is_hex, F.lower(token)).otherwise(F.translate(token, "-_", "+/"))
    values = F.transform(F.split(plain, ""), lambda ch: F.instr(alphabet, ch) - 1)
    return F.struct(c["start"].alias("start"), c["end"].alias("end"), size.cast("double").alias("k"), values.alias("v"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _sums(c: Column) -> Column:
    """The sums from which the statistics follow."""
    v, n = c["v"], F.size(c["v"])
    turned = F.concat(F.slice(v, F.lit(2), n - 1), F.slice(v, F.lit(1), F.lit(1)))
    high = F.transform(v, lambda x: (x * 2 >= c["k"]).cast("int"))
    changes = F.zip_with(F.slice(high, F.lit(1), n - 1), F.slice(high, F.lit(2), n - 1), lambda a, b: F.abs(a - b))
    squares = F.transform(F.array_distinct(v), lambda x: F.pow(F.size(F.filter(v, lambda y: y == x)).cast("double"), 2))
    return F.struct(
        c["start"].alias("start"), c["end"].alias("end"), c["k"].alias("k"), n.cast("double").alias("n"),
        _total(squares).alias("squares"), _total(v).alias("sum"), _total(F.transform(v, lambda x: x * x)).alias("sum2"),
        _total(F.zip_with(v, turned, lambda a, b: a * b)).alias("lag"),
        _total(high).alias("above"), (_total(changes) + 1).alias("runs"),
    )


def _z_scores(c: Column) -> Column:
    n, k, below = c["n"], c["k"], c["n"] - c["above"]
    chi2 = c["squares"] * k / n - n
    extra = (n - 1) * (F.element_at(F.create_map(*(F.lit(float(x)) for kv in TEXT_COINCIDENCE.items() for x in kv)), k) * k - 1)
    mean_runs = c["above"] * below * 2 / n + 1
    sd_runs = F.sqrt(F.greatest((mean_runs - 1) * (mean_runs - 2) / (n - 1), F.lit(1e-9)))
    spread = n * c["sum2"] - c["sum"] * c["sum"]
    serial = F.when(spread > 0, (n * c["lag"] - c["sum"] * c["sum"]) / spread).otherwise(1.0)
    return F.struct(
        c["start"].alias("start"), c["end"].alias("end"), k.cast("int").alias("k"),
        F.floor(F.log2(n)).cast("int").alias("band"),
        ((chi2 - (k - 1)) / F.sqrt((k - 1) * 2 * (n - 1) / n)).alias("z_chi"),
        ((chi2 - (k - 1) - extra) / F.sqrt((k - 1) * 2 + extra * 4)).alias("z_text"),
        F.when((c["above"] == 0) | (below == 0), 99.0).otherwise((c["runs"] - mean_runs) / sd_runs).alias("z_runs"),
        ((serial + F.lit(1) / (n - 1)) * (n - 1) * F.sqrt(n - 2) / n).alias("z_serial"),
    )


def normal_cdf(z: Column) -> Column:
    """The normal distribution function by the logistic formula with a cubic term (off by under 0.0002)."""
    z = F.greatest(F.least(z, F.lit(9.0)), F.lit(-9.0))
    return F.lit(1) / (F.exp(-(z * 1.5976 + z * z * z * 0.07056)) + 1)


def _p_values(c: Column) -> Column:
    logs = (
        F.log(normal_cdf(-c["z_chi"]))
        + F.log(normal_cdf(-F.abs(c["z_runs"])) * 2)
        + F.log(normal_cdf(-F.abs(c["z_serial"])) * 2)
    )
    fisher = F.exp(logs) * (F.lit(1) - logs + logs * logs / 2)  # chi-squared with six degrees of freedom
    return F.struct(
        c["start"].alias("start"), c["end"].alias("end"), F.lit(3).alias("kind"),
        (c["k"] * 100 + c["band"]).alias("family"), fisher.alias("p_random"),
        F.least(F.floor(F.log10(normal_cdf(c["z_text"])) * -10), F.lit(MAX_BIN)).cast("int").alias("bin"),
    )


def score_candidates(text: Column) -> Column:
    """Array of (start, end, kind, family, p_random, bin) of the candidates of a text."""
    found = _spans(text, CANDIDATE, 3, lambda p: F.lit(True))
    for step in (_symbols, _sums, _z_scores, _p_values):
        found = F.transform(found, step)
    return found


def false_discovery_bins(scored: DataFrame, q: float) -> dict[int, int]:
    """For each family of candidates, the smallest bin that the Benjamini-Hochberg rule accepts.

    There are at most 4 encodings x 31 lengths x 401 bins of counts, so they are ranked on the driver.
    """
    rows = scored.select(F.explode("candidates").alias("c")).groupBy("c.family", "c.bin").count().collect()
    accepted: dict[int, int] = {}
    for family in {r.family for r in rows}:
        bins = sorted(((r.bin, r["count"]) for r in rows if r.family == family), reverse=True)
        tests, smaller = sum(n for _, n in bins), 0
        for b, n in bins:
            smaller += n
            if 10 ** (-b / 10) <= q * smaller / tests:
                accepted[family] = b
    return accepted


def scan_secrets(docs: DataFrame, q: float = 0.01, alpha: float = 0.01) -> DataFrame:
    """The secrets in each text.

    docs has doc_id and text; other columns are ignored. Returns one row per input row: doc_id,
    spans: array of (start, end, kind), by start and then kind, in code points with the end excluded.
    Kinds are numbers into KINDS; base spans have 0 to 2, and what the tests add has 3. A
    candidate that overlaps a base span is not added. Null and empty texts have no spans; repeated
    rows have a result each, and count each in the false-discovery rule.
    """
    text = F.coalesce("text", F.lit(""))
    scored = stored(docs.select("doc_id", base_spans(text).alias("base"), score_candidates(text).alias("candidates")), "spans")
    accepted = false_discovery_bins(scored, q)
    limits = F.create_map(*(F.lit(x) for kv in sorted(accepted.items()) for x in kv)) if accepted else None

    def added(c: Column) -> Column:
        if limits is None:
            return F.lit(False)
        free = ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        return F.coalesce(c["bin"] >= F.element_at(limits, c["family"]), F.lit(False)) & (c["p_random"] >= alpha) & free

    bare = lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))
    base, more = F.transform("base", bare), F.transform(F.filter("candidates", added), bare)
    by_start = lambda x, y: F.when((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["kind"] < y["kind"])), -1).otherwise(1)
    return scored.select("doc_id", F.array_sort(F.concat(base, more), by_start).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
