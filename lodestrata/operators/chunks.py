"""Chunking of ordered texts: packing turns into chunks by budget, and sliding windows over dialogues."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


def _numbers(sizes: pd.Series, budget: int, between: int, empty_first: bool) -> pd.Series:
    out = []
    for row in sizes:
        n = used = 0
        numbers = []
        for k, size in enumerate(() if row is None else row):
            if (used > 0 and used + between + size > budget) or (empty_first and k == 0 and size > budget):
                n, used = n + 1, size
            else:
                used += size + (between if used else 0)
            numbers.append(n)
        out.append(numbers)
    return pd.Series(out)


def packed(sizes: Column, budget: int, between: int = 0, empty_first: bool = False) -> Column:
    """Array of chunk numbers for an array of sizes in order: what would overflow the budget opens a chunk.

    Two in one chunk have `between` between them; one larger than the budget is a chunk of its own. empty_first: if the first
    is larger than the budget, an empty chunk 0 comes before it. One pass over each array.
    """
    return F.pandas_udf(lambda x: _numbers(x, budget, between, empty_first), "array<int>")(sizes)


def packed_pieces(rows: DataFrame, key: str, pieces: Column, size: str, budget: int, between: int = 0, joint: str = " ", empty_first: bool = False) -> DataFrame:
    """key, chunk, n_pieces, text: the pieces of each row (an array of texts) packed into chunks; size says what of a piece counts, "chars" or "words"."""
    sized = rows.select(key, pieces.alias("pieces")).withColumn("sizes", F.transform("pieces", lambda p: _measured(size, p)))
    numbered = sized.withColumn("numbers", packed(F.col("sizes"), budget, between, empty_first))
    each = numbered.select(key, F.posexplode(F.arrays_zip("pieces", "numbers")).alias("at", "x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("x.pieces").alias("p")))), lambda x: x["p"])
    return each.groupBy(key, F.col("x.numbers").cast("long").alias("chunk")).agg(F.count("*").alias("n_pieces"), F.array_join(ordered, joint).alias("text"))


def _measured(size: str, piece: Column) -> Column:
    """How many characters or words a piece has."""
    return F.length(piece) if size == "chars" else F.size(F.array_remove(F.split(piece, r"[\x20\x09-\x0D]+"), ""))


def paragraphs(text: Column, most: int) -> Column:
    """Parts between blank lines, trimmed and not empty; a part of over `most` characters is cut into pieces of that size."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n[\x20\x09]*\n"), lambda p: F.regexp_replace(p, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")), lambda p: p != "")
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda i: F.substring(p, i * most + 1, F.lit(most)))
    return F.flatten(F.transform(parts, cut))


def token_windows(rows: DataFrame, key: str, words: Column, size: int, overlap: int) -> DataFrame:
    """key, window, first (place of its first word), n, text: windows of `size` words that share `overlap` with the one before; the last may be shorter."""
    step = size - overlap
    w = rows.select(key, words.alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("ws") - overlap) / step) - 1).cast("int"))
    each = w.select(key, "ws", F.explode(starts).alias("window"))
    part = F.slice("ws", F.col("window") * step + 1, size)
    return each.select(key, F.col("window").cast("long").alias("window"), (F.col("window") * step).cast("long").alias("first"), F.size(part).cast("long").alias("n"), F.array_join(part, " ").alias("text"))


def pack_turns(turns: DataFrame, group: str, order: str, size: Column, budget: int) -> DataFrame:
    """group, chunk, first_turn, last_turn, n_turns, size; a group's turns come together, texts stay behind."""
    ordered = turns.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("turn"), size.cast("long").alias("size")))).alias("turns"))
    numbered = ordered.select(group, "turns", packed(F.transform("turns", lambda t: t["size"]), budget).alias("chunks"))
    rows = numbered.select(group, F.explode(F.arrays_zip("turns", "chunks")).alias("t"))
    return rows.groupBy(group, F.col("t.chunks").cast("long").alias("chunk")).agg(
        F.min("t.turns.turn").alias("first_turn"), F.max("t.turns.turn").alias("last_turn"), F.count("*").alias("n_turns"), F.sum("t.turns.size").alias("size")
    )


def sliding(turns: DataFrame, group: str, order: str, size: int, overlap: int) -> DataFrame:
    """group, window, first_turn, last_turn, n_turns: windows of `size` turns every size - overlap; the last may be shorter.

    A window that would hold only turns of the one before is left out.
    """
    step = size - overlap
    w = Window.partitionBy(group).orderBy(order)
    placed = turns.withColumn("at", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(group)))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / step)).cast("int")
    first = F.greatest(F.lit(0), F.floor((F.col("at") - size + step) / step)).cast("int")
    upto = F.least(last, F.floor(F.col("at") / step).cast("int"))
    each = placed.where(first <= upto).withColumn("window", F.explode(F.sequence(first, upto)))
    return each.groupBy(group, F.col("window").cast("long").alias("window")).agg(
        F.min(order).alias("first_turn"), F.max(order).alias("last_turn"), F.count("*").alias("n_turns")
    )


#: The characters that end a sentence.
SENTENCE_ENDS = ".;!?…。！？"


def typed_pieces(text: Column) -> Column:
    """Array of (piece, kind) that together give the text again; none for null and empty texts.

    A piece ends with a space, or with the end of a sentence and the spaces after it: kind "sentence_end", or "paragraph_end" where a line end follows; all others are "word".
    """
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^ {SENTENCE_ENDS}]*(?:[{SENTENCE_ENDS}] *| )|[^ {SENTENCE_ENDS}]+"), F.lit(0))
    kind = lambda p, after: F.when(~p.rlike(f"[{SENTENCE_ENDS}]"), "word").when(after.rlike(r"^[\n\r]"), "paragraph_end").otherwise("sentence_end")
    # the piece after each one comes from the array without its first; after the last there is none. An array of one: pieces are then found once
    typed = lambda ps: F.zip_with(ps, F.slice(ps, 2, F.greatest(F.size(ps), F.lit(1))), lambda p, after: F.struct(p.alias("piece"), kind(p, F.coalesce(after, F.lit(""))).alias("kind")))
    return F.filter(F.get(F.transform(F.array(pieces), typed), F.lit(0)), lambda x: x["piece"].isNotNull())


_PIECE = re.compile(f"[^ {SENTENCE_ENDS}]*(?:[{SENTENCE_ENDS}] *| )|[^ {SENTENCE_ENDS}]+")
_STRETCH = re.compile(f"([^{SENTENCE_ENDS}]*)([{SENTENCE_ENDS}] *)?")
_LETTER = re.compile(r"[^\W\d_]")


def _has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None and any(map(str.isalpha, text))


def _sentences(text: str, size: str, most: int | None) -> Iterator[tuple[int, str | None, int, str]]:
    """paragraph, kind, n_pieces, text of each sentence; a stretch up to the next end that fits as a whole is not taken apart."""
    measured = len if size == "chars" else lambda p: int(p.strip(" \t\n\x0b\x0c\r") != "")
    now, n_now, paragraph, used, state = [], 0, 0, 0, None
    for m in _STRETCH.finditer(text):
        stretch, (body, end) = m.group(), m.groups()
        if not stretch:
            continue
        closing = end and ("paragraph_end" if text[m.end() : m.end() + 1] in ("\n", "\r") else "sentence_end")
        if most is None or (size == "chars" and used + len(stretch) <= most):
            pieces = [(stretch, closing, body.count(" ") + (1 if end or body[-1] != " " else 0), 0 if most is None else len(stretch))]
        else:
            found = _PIECE.findall(stretch)
            pieces = [(p, None, 1, measured(p)) for p in (found[:-1] if end else found)] + ([(found[-1], closing, 1, measured(found[-1]))] if end else [])
        for piece, kind, n, filled in pieces:
            state = kind or ("word" if state != "word" and _has_letter(piece) else state)
            if now and most is not None and used + filled > most:
                yield paragraph, state, n_now, "".join(now)
                now, n_now, used = [piece], n, filled
                continue
            now.append(piece)
            n_now, used = n_now + n, used + filled
            if kind:
                paragraph += kind == "paragraph_end"
                yield paragraph, state, n_now, "".join(now)
                now, n_now, used = [], 0, 0
    if now:
        yield paragraph, "sentence_cut" if state == "word" else state, n_now, "".join(now)


def cut_sentences(rows: DataFrame, key: str, text: Column, size: str = "chars", most: int | None = None) -> DataFrame:
    """key, sentence, paragraph, kind, n_pieces, text: the typed pieces of each text joined into sentences, which give the text again.

    A sentence ends with a piece that ends one, or before the piece with which it would hold over `most` (size: "chars" or "words"); a single piece may be larger, and the piece that
    didn't fit begins the next sentence, even one that ends a sentence. A sentence's kind is that of the last piece met that ends something or has a letter, the piece that didn't fit included; where a text
    stops within a sentence it is "sentence_cut", and null where nothing told. paragraph counts the ends of paragraphs that ended sentences so far, a sentence's own included. Null and empty texts
    give no rows. Rows are not shuffled: a text is read by one task, as in a table it is one row, and its sentences leave the task in batches of some megabytes.
    """
    names = ["sentence", "paragraph", "kind", "n_pieces", "text"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, found, held = batch.column(0), batch.column(1), [], 0

            def flushed():
                at, *columns = zip(*found, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
                return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *map(pa.array, columns, kinds)], [key, *names])

            for k in range(len(batch)):
                for n, (paragraph, kind, n_pieces, sentence) in enumerate(_sentences(texts[k].as_py() or "", size, most)):
                    found.append((k, n, paragraph, kind, n_pieces, sentence))
                    held += len(sentence)
                    if len(found) >= 50_000 or held > 4_000_000:
                        yield flushed()
                        found, held = [], 0
            if found:
                yield flushed()

    schema = StructType([rows.schema[key], *(StructField(c, StringType() if c in ("kind", "text") else LongType()) for c in names)])
    return rows.select(F.col(key), text.alias("__text")).mapInArrow(cut, schema)
