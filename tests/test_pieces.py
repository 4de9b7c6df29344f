import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import scoring as S
from lodestrata.operators import chunks
from lodestrata.operators import retrieval as R

TEXTS = [
    None, "", " ", "...", "One two. Three!  Four?\nFive; six\n\nseven", "a.b.c", "no end", "  lead. \n tail. ", "。你好！ 再见\n", "x " * 50 + ".", "1 2. 3 4",
    "w" * 300, "End.\r\nNext… and\nmore.", ". . .\n.", "Ein Satz.  Noch einer.\n\nAbsatz 2; 3.", "7 8 9 " * 20,
]


def plain_pieces(text):
    out, now, i = [], "", 0
    while i < len(text):
        now += text[i]
        i += 1
        if now[-1] in chunks.SENTENCE_ENDS:
            while i < len(text) and text[i] == " ":
                now, i = now + " ", i + 1
            out.append((now, "paragraph_end" if i < len(text) and text[i] in "\n\r" else "sentence_end"))
            now = ""
        elif now[-1] == " ":
            out.append((now, "word"))
            now = ""
    return out + ([(now, "word")] if now else [])


def plain_sentences(text, size, most):
    out, now, used, paragraph, state = [], "", 0, 0, None
    for piece, kind in plain_pieces(text):
        n = len(piece) if size == "chars" else len(piece.split())
        if kind != "word" or any(c.isalpha() for c in piece):
            state = kind
        if now and most and used + n > most:
            out.append((paragraph, state, now))
            now, used = piece, n
        else:
            now, used = now + piece, used + n
            if kind != "word":
                paragraph += kind == "paragraph_end"
                out.append((paragraph, state, now))
                now, used = "", 0
    return out + ([(paragraph, "sentence_cut" if state == "word" else state, now)] if now else [])


def test_pieces_are_lossless(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    got = {r.id: [(p.piece, p.kind) for p in r.ps] for r in rows.select("id", chunks.typed_pieces(F.col("text")).alias("ps")).collect()}
    for n, text in enumerate(TEXTS):
        assert got[n] == plain_pieces(text or "") and "".join(p for p, _ in got[n]) == (text or "")


@pytest.mark.parametrize(("size", "most"), [("chars", None), ("chars", 12), ("chars", 1), ("words", 3)])
def test_cut_sentences(spark, size, most):
    rows = spark.createDataFrame([(n, t, 0) for n, t in enumerate(TEXTS + [TEXTS[4]])], "id long, text string, sentence int")
    got = sorted((r.id, r.sentence, r.paragraph, r.kind, r.text) for r in chunks.cut_sentences(rows, "id", F.col("text"), size, most).collect())
    want = [(n, k, *s) for n, t in enumerate(TEXTS + [TEXTS[4]]) for k, s in enumerate(plain_sentences(t or "", size, most))]
    assert got == sorted(want)
    assert chunks.cut_sentences(rows.limit(0), "id", F.col("text")).collect() == []


def test_cut_sentences_leave_in_batches(spark):
    """Long texts of random pieces, whose sentences are more than one batch holds; no array of pieces is made of a text."""
    r = np.random.default_rng(5)
    texts = ["".join(r.choice(["word ", "x", " ", ".", "! ", "\n", "1 ", "é", "…", "_ ", "longer words here "], n)) for n in (60_000, 3, 9_000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    for size, most in (("chars", 20), ("chars", 3), ("chars", None)):
        found = chunks.cut_sentences(rows, "id", F.col("text"), size, most)
        assert "ArrowEvalPython" not in found._jdf.queryExecution().toString()
        got = sorted((x.id, x.sentence, x.paragraph, x.kind, x.text) for x in found.collect())
        assert got == sorted((n, k, *s) for n, t in enumerate(texts) for k, s in enumerate(plain_sentences(t, size, most)))
        assert all(x.n_pieces == len(plain_pieces(x.text)) or "\n" in x.text or x.text[0] in chunks.SENTENCE_ENDS for x in found.where("id = 1").collect())


def test_choices_by_text(spark):
    four = ["The cat sat on the mat", "The cat sat on the mat, then it slept", "Dogs bark at night", "Blue"]
    cases = [
        (" the cat SAT on the mat. ", four, 0),  # the same text
        ("blue!", four, 3),
        ("Dogs", four, None),  # short, and not the same
        ("dogs bark at", four, 2),  # the only one that begins with it
        ("The cat sat on", four, 0),  # two begin with it; by words 8/9 against 8/12, 0.15 more for both
        ("It is said that dogs bark at night", four, 2),  # by words, holding the choice
        ("at night bark dogs", four, 2),
        ("nothing of this kind is here", four, None),
        ("", four, None), (None, four, None), ("the cat sat on the mat", None, None), ("the cat sat on the mat", [], None),
        ("the cat sat on the mat", [None, " ", "the cat sat on the mat"], 2),
        ("same words here", ["same words here", "same words here"], 0),
    ]
    rows = spark.createDataFrame([(n, p, c) for n, (p, c, _) in enumerate(cases)], "id long, p string, c array<string>")
    got = {r.id: r.got for r in rows.select("id", S.choice_of_text(F.col("p"), F.col("c")).alias("got")).collect()}
    assert [got[n] for n in range(len(cases))] == [w for _, _, w in cases]


def test_option_chain_in_order(spark):
    four = ["red apples on trees", "green pears in boxes", "old plums and figs", "one"]
    cases = [("(B)", "B"), ("Well.\nanswer: (C)\nD", "C"), ("I think\n\n (D) \n", "D"), ("It may be\nold plums and figs", None), ("answer: old plums and figs\nred", "C"), ("one", "D"), (None, None), ("", None)]
    rows = spark.createDataFrame([(n, p) for n, (p, _) in enumerate(cases)], "id long, p string").withColumn("c", F.array(*map(F.lit, four)))
    got = {r.id: r.got for r in rows.select("id", S.option_chain(F.col("p"), F.col("c")).alias("got")).collect()}
    assert {n: got[n] for n in got if n != 3} == {n: w for n, (_, w) in enumerate(cases) if n != 3}
    assert got[3] == "C"  # most of its words are those of the third choice


def test_topic_matches_by_brute_force(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(150, 5)).round(2)
    words = [[f"w{k}" for k in r.integers(0, 12, r.integers(0, 6))] for _ in range(150)]
    rows = [(k, x[k].tolist(), words[k], 1) for k in range(150)] + [(200, x[3].tolist(), words[3], 1), (201, None, ["w1"], 1), (202, [0.0] * 5, None, 1), (203, [1.0, None, 1.0, 1.0, 1.0], [], 1), (204, [1.0], ["w1"], 1), (None, x[0].tolist(), [], 1)]
    table = spark.createDataFrame(rows, "id long, vector array<double>, words array<string>, score int")
    asked = table.where("id % 10 = 0 OR id = 202").withColumnRenamed("id", "query_id")
    got = sorted((m.query_id, m.rank, m.id, m.score) for m in R.topic_matches(table, asked, 4, block=3, rows_a_task=40).collect())
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-12)
    whole = [(k, unit(v), set(w or [])) for k, v, w, _ in rows if k is not None and v is not None and len(v) == 5 and None not in v]
    want = []
    for q, v, w in whole:
        if q % 10 == 0 or q == 202:
            found = sorted((-round(0.8 * float(u @ v) + 0.2 * len(w & s) / max(len(w), len(s), 1), 6), k) for k, u, s in whole if k != q)[:4]
            want += [(q, n, k, -s) for n, (s, k) in enumerate(found, 1)]
    assert [g[:3] for g in got] == [t[:3] for t in sorted(want)] and np.allclose([g[3] for g in got], [t[3] for t in sorted(want)], atol=2e-6)
    assert R.topic_matches(table.limit(0), asked, 4).collect() == []
