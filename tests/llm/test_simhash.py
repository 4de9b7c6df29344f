import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from lodestrata.llm import simhash_trie as S


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, budget=2):
    """Every pair is compared."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            if (prints[x] ^ prints[y]).bit_count() <= budget:
                a, b = find(ids[x]), find(ids[y])
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints_match_their_definition(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.fingerprint & (2**64 - 1) for r in S.fingerprints(docs).collect()}
    assert got == {i: plain_print(t) for i, t in texts}
    # the JVM's hash is the one of the contract
    row = spark.range(1).select(F.xxhash64(F.lit("the one of")).alias("h")).first()
    assert row.h & (2**64 - 1) == xxhash.xxh64_intdigest(b"the one of", 42)


def test_long_text_in_pieces():
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert S.fingerprint(text) == plain_print(text)


def test_components_match_all_pairs(spark):
    rng = np.random.default_rng(3)
    prints = [int(x) for x in rng.integers(0, 2**63, 60)]
    for p in list(prints):  # chains of copies with up to two bits changed
        for _ in range(8):
            p ^= 1 << int(rng.integers(0, 64))
            if rng.random() < 0.6:
                p ^= 1 << int(rng.integers(0, 64))
            prints.append(p)
    prints = list(dict.fromkeys([0, *prints]))
    ids = list(range(len(prints)))
    rows = [(p - 2**64 if p >= 2**63 else p, i) for p, i in zip(prints, ids, strict=True)]
    df = spark.createDataFrame(rows, "fingerprint long, id long")
    want = plain_components(ids, prints)
    for most_rows in (2, 16, 8192):
        links = S.trie_links(df, 2, most_rows)
        found = {r.node: r.component for r in S.components(links).collect()}
        assert {i: found.get(i, i) for i in ids} == want


def test_crowded_nodes_match_all_pairs(spark):
    rng = np.random.default_rng(4)
    # half of the fingerprints are alike in their first or their last 32 bits, many of these within the budget
    prints = [int(x) for x in rng.integers(0, 2**63, 40)] + [5 << 40 | int(x) for x in rng.integers(0, 600, 150)] + [int(x) << 41 | 77 for x in rng.integers(0, 600, 150)]
    prints = list(dict.fromkeys(prints))
    ids = list(range(len(prints)))
    df = spark.createDataFrame(list(zip(prints, ids, strict=True)), "fingerprint long, id long")
    want = plain_components(ids, prints)
    for most_rows in (8, 100):
        found = {r.node: r.component for r in S.components(S.trie_links(df, 2, most_rows)).collect()}
        assert {i: found.get(i, i) for i in ids} == want


def test_links_of_a_stream_in_small_parts():
    rng = np.random.default_rng(6)
    bits = np.sort(rng.integers(0, 4, 300).astype(np.uint64) << np.uint64(62) | rng.integers(0, 2**10, 300).astype(np.uint64))
    table = pa.table({"trie": np.zeros(300, np.int32), "bits": bits.view(np.int64), "id": np.arange(300)})
    for least in (1, 40, 1000):
        found = pa.Table.from_batches(S._node_links(2, 2, least)(iter(table.to_batches(max_chunksize=7))))
        root = S.forest(iter([(found.column("a").to_numpy(), found.column("b").to_numpy())]), 300)
        pairs = [(i, j) for i in range(300) for j in range(i) if bits[i] >> np.uint64(62) == bits[j] >> np.uint64(62) and (int(bits[i]) ^ int(bits[j])).bit_count() <= 2]
        i, j = (np.array(x) for x in zip(*pairs, strict=True))
        assert (root == S.forest(iter([(i, j)]), 300)).all()


def test_whole_operator(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = plain_components([i for i, _ in texts], [plain_print(t) for _, t in texts])
    assert {r.doc_id: r.component_id for r in S.simhash_components(docs).collect()} == want
    assert sorted(r.doc_id for r in S.near_dedup(docs).collect()) == sorted(set(want.values()))


def test_edges(spark):
    kind = "doc_id long, text string, fingerprint string, component_id int"
    rows = [(5, None, "x", 1), (3, "", None, 2), (9, " \t\n", "y", 3), (9, " \t\n", "y", 3), (None, "a b c d", "z", 4), (7, "A b C d", "z", 4)]
    got = S.simhash_components(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 7), (3, 3), (5, 3), (7, 7), (9, 3), (9, 3)]
    assert S.simhash_components(spark.createDataFrame([], kind)).collect() == []


def test_different_texts_of_one_id_stay_apart(spark):
    a, b, c = ("the first text has its own words", "nothing alike stands in another version", "a third one that is far from both of them")
    rows = [(1, a, "x"), (1, b, "x"), (1, b, "y"), (2, b.upper(), "x"), (3, a, "x"), (4, c, "x"), (None, a, "x"), (5, None, "x"), (5, "", "x")]
    stays = []
    for parts in (1, 3):
        df = spark.createDataFrame(rows if parts == 1 else rows[::-1], "doc_id long, text string, source string").repartition(parts)
        got = S.near_dedup(df)
        assert got.columns == df.columns
        stays.append(sorted((tuple(r) for r in got.collect()), key=repr))
    assert stays[0] == stays[1] and [r[0] for r in stays[0]] == [1, 1, 4, 5, None]
    assert {r[1] for r in stays[0] if r[0] == 1} == {a, b}
