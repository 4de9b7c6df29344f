import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestrata.functions import stems as S
from lodestrata.operators import retrieval as R

#: The examples of the published rules.
PAPER = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop
tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit radicalli radic differentli differ
vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl
triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust
defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular effective effect bowdlerize bowdler
probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil""".split()


def test_published_examples():
    wrong = [(w, want, S.stem(w)) for w, want in zip(PAPER[::2], PAPER[1::2], strict=True) if S.stem(w) != want]
    assert not wrong and S.stem("as") == "as" and S.stem("") == "" and S.stem("s") == "s"


def test_keywords(spark):
    df = spark.createDataFrame([(1, "The Ponies, and Cats' hopping!"), (2, None), (3, ""), (4, "我爱北京 motoring 好"), (5, "a b c1d 42")], "n long, text string")
    got = [r.k for r in df.coalesce(1).orderBy("n").select(S.keywords(F.col("text"), ("the", "and")).alias("k")).collect()]
    assert got == [["poni", "cat", "hop"], [], [], ["motor", "我爱", "爱北", "北京", "好"], []]
    assert [r.k for r in df.where("n = 2").select(S.stems(F.lit(None).cast("array<string>")).alias("k")).collect()] == [None]


def test_stemmed_bm25_equals_the_formula(spark):
    texts = {1: "ponies hopping", 2: "a pony hopped and hopped", 3: "cats", 4: None, 5: "the cat's motoring along with other motors", 6: "nothing here"}
    words = {n: [S.stem(w) for w in (t or "").lower().replace("'s", "").split() if len(w) > 1 and w not in R.T.STOPWORDS] for n, t in texts.items()}
    docs = spark.createDataFrame([(n, t and t.replace("'s", "")) for n, t in texts.items()], "doc_id long, text string").withColumn("words", F.lit(1))
    asked = {1: "hop pony", 2: "motor cats motor", 3: None}
    got = {(r.query_id, r.doc_id): r.score for r in R.bm25_stemmed(docs, spark.createDataFrame(list(asked.items()), "query_id long, text string")).collect()}
    df = Counter(w for ws in words.values() for w in set(ws))
    idf = {w: math.log((6 - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    idf = {w: v if v >= 0 else 0.25 * sum(idf.values()) / len(idf) for w, v in idf.items()}
    size, want = sum(map(len, words.values())) / 6, {}
    for q, text in asked.items():
        for d, ws in words.items():
            terms = [S.stem(w) for w in (text or "").split()]
            if set(terms) & set(ws):
                want[q, d] = round(sum(idf[t] * ws.count(t) * 2.5 / (ws.count(t) + 1.5 * (0.25 + 0.75 * len(ws) / size)) for t in terms if t in ws), 6)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_pages_pass_both_tiers(spark):
    s = spark.createDataFrame([(1, 1, [1.0, 0.0], ["a", "b"]), (1, 2, [0.0, 1.0], ["a"]), (1, 3, None, ["a"]), (2, 1, [1.0, 0.0], None)], "key long, session long, vector array<double>, words array<string>")
    p = spark.createDataFrame([(1, 1, 10, [1.0, 1.0]), (1, 1, 11, [0.0, 1.0]), (1, 2, 12, [1.0, 0.0]), (1, 2, 13, None), (2, 1, 14, [1.0, 0.0])], "key long, session long, page long, vector array<double>")
    q = spark.createDataFrame([(7, 1, [1.0, 0.0], ["a", "a"]), (8, 2, [1.0, 0.0], ["a"]), (9, 1, None, ["a"]), (10, 5, [1.0, 0.0], None)], "query_id long, key long, query array<double>, words array<string>")
    got = [tuple(r) for r in R.tiered_pages(q, s, p, 0.9, 0.5, 5).orderBy("query_id", "rank").collect()]
    assert got == [(7, 10, 1, 1.75, 0.707107, 1), (7, 12, 2, 1.0, 1.0, 2), (8, 14, 1, 1.0, 1.0, 1)]


def test_pages_of_sessions_meet_in_blocks_and_slices(spark):
    """As by a plain loop, with blocks of 3 queries and slices of 20 rows; pairs of queries and sessions are not joined."""
    r, many = np.random.default_rng(8), "k long, session long, vector array<double>, words array<string>"
    vector, some = lambda: r.integers(-2, 4, 4).astype(float).tolist(), lambda: r.choice(list("abcdefgh"), r.integers(0, 6)).tolist()
    sessions = [(n % 3, n, vector(), some()) for n in range(60)]
    pages = [(n % 60 % 3, n % 60, n, vector()) for n in range(240)]
    asked = [(n, n % 3, vector(), some()) for n in range(20)]
    cosine = lambda a, b: float(np.dot(a, b) / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-12))
    want = []
    for query, key, x, ws in asked:
        found = []
        for k, session, v, words in sessions:
            n = len(set(ws) & set(words))
            score = round(cosine(x, v) + (n / len(set(ws)) + n / len(set(words))) / 2 if n else cosine(x, v), 6)
            if k == key and score >= 0.4:
                found += [(-score, -round(cosine(x, y), 6), page) for _, own, page, y in pages if own == session and round(cosine(x, y), 6) >= 0.2]
        want += [(query, n + 1, page, s, p) for n, (s, p, page) in enumerate(sorted(found)[:6])]
    frame = lambda rows, names: spark.createDataFrame(rows, names.replace("k long", "key long"))
    q = frame(asked, "query_id long, k long, query array<double>, words array<string>")
    got = R.tiered_pages(q, frame(sessions, many), frame(pages, "k long, session long, page long, vector array<double>"), 0.4, 0.2, 6, block=3, rows_a_task=20)
    rows = sorted((x.query_id, x["rank"], x.page, x.score, x.page_score) for x in got.collect())
    assert [x[:3] for x in rows] == [x[:3] for x in sorted(want)] and all(abs(a[3] + b[3]) < 2e-6 and abs(a[4] + b[4]) < 2e-6 for a, b in zip(rows, sorted(want), strict=True))
