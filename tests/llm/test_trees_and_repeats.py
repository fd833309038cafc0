"""Repeated runs, the Merkle manifest and the conversation trie against brute force, and on odd rows."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import manifest, repeats, trie
from plumbline.llm.order import running, spread_join

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (4, "a"), (None, "null id " * 9), (5, "wort " * 3000), (6, "é ü ñ 中文 𝒳 " * 30), (7, "null id " * 9)]


def run_texts():
    rng = random.Random(1)
    base = [[rng.choice("abcdefgh") for _ in range(60)] for _ in range(6)]
    texts = []
    for _ in range(50):
        words = []
        for _ in range(rng.randint(0, 4)):
            b, i = rng.choice(base), rng.randint(0, 50)
            words += b[i : i + rng.randint(1, 30)] + [f"u{rng.randint(0, 3)}" for _ in range(rng.randint(0, 5))]
        texts.append(" ".join(words))
    return [None, "", "  ", *texts, *texts[8:12], "x " * 200]


@pytest.mark.parametrize("window, least", [(5, 3), (12, 3), (35, 16), (9, 9), (3, 1)])
def test_repeated_windows_equal_brute_force(spark, monkeypatch, window, least):
    monkeypatch.setattr(repeats, "PIECE_BYTES", 300)  # so that a text's runs meet others in other pieces, too
    texts = run_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in repeats.judge(docs, window, least).collect()}
    assert got == dict(enumerate(repeats.brute_force(texts, window)))


def test_lengths_halve_and_seeds_are_met_by_equal_windows():
    assert repeats.lengths(35) == [18, 35] and repeats.lengths(35, 8) == [9, 18, 35] and repeats.lengths(3, 1) == [1, 2, 3]
    import numpy as np

    h = np.array([random.Random(4).randrange(6) for _ in range(1)] + [5, 1, 1, 4, 2, 2, 2, 0, 3, 1, 5], dtype=np.uint64)
    for width in (1, 2, 3, 5, 12):
        want = {j for i in range(len(h) - width + 1) for j in range(i, i + width) if h[j] == min(h[i : i + width])}
        assert set(repeats.seeds(h, width).tolist()) == want


def test_longest_repeats_double_until_none_survives(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words[:25], "x"]), " ".join(["y", *words[30:36]]), "z"]
    got = repeats.longest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 3)
    by = {r["text"]: r["words"] for r in got.join(spark.createDataFrame([(t,) for t in texts], "text string").withColumn("key", repeats.text_key()), "key").collect()}
    assert by == {texts[0]: 20, texts[1]: 20, texts[2]: 5}


def test_repeats_on_odd_rows(spark):
    docs = spark.createDataFrame([(*r, "x", "s") for r in ODD], "doc_id long, text string, key string, copies string")
    got = sorted(map(str, map(tuple, repeats.judge(docs, 10).collect())))
    assert got == sorted(str((i, *x)) for (i, _), x in zip(ODD, repeats.brute_force([t for _, t in ODD], 10), strict=True))
    left = repeats.without_repeats(docs, 10)
    assert left.columns == docs.columns and left.count() == len(ODD)
    assert {r["text"] for r in left.where("doc_id = 7 or doc_id is null").collect()} == {""} and left.where("doc_id = 4 and text = 'a'").count() == 2
    assert repeats.judge(docs.where("false")).count() == 0 and repeats.without_repeats(docs.where("false")).count() == 0


def leaves():
    rng = random.Random(2)
    rows = [
        {"doc_id": rng.choice([None, *range(60)]), "text": rng.choice([None, "", "é x", "abc"]), "lang": rng.choice([None, "", "de", "fr", "é", "v"]), "source": rng.choice([None, "s"]), "n_chars": rng.choice([None, 3])}
        for _ in range(90)
    ]
    return rows + [rows[0]] * 5


@pytest.mark.parametrize("band", [1, 2, 10])
def test_manifest_equals_brute_force(spark, band):
    rows = leaves()
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, g string, digest string")
    got = manifest.manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, band)
    want = manifest.brute_force(rows, lambda r: r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and not all(x[-1] for x in want)


def test_manifest_of_one_row_and_none(spark):
    row = {"doc_id": 5, "text": "a", "lang": "de", "source": "s", "n_chars": 1}
    docs = spark.createDataFrame([tuple(row[c] for c in manifest.FIELDS)], "doc_id long, source string, lang string, n_chars long, text string")
    assert [tuple(r) for r in manifest.manifest(docs).collect()] == manifest.brute_force([row])
    assert manifest.manifest(docs.where("false")).count() == 0


def test_blocks_send_digests_forward_and_proofs_back():
    leaf = [manifest.digest([str(i)]) for i in range(11)]
    block = manifest.Block(leaf, 4)
    assert all(manifest.folded(d, s) == block.root for d, s in zip(leaf, block.suffixes(""), strict=True))
    assert manifest.folded(leaf[3], block.suffixes("")[4]) != block.root
    assert manifest.Block(leaf[:1], 0).suffixes("N") == ["N"]


def turns():
    rng = random.Random(3)
    rows = [(c, rng.choice([None, t, t]), rng.choice(["u", "a", None]), rng.choice(["x", "y", "é", None])) for c in [None, *range(40)] for t in range(rng.randint(1, 12))]
    return rows + [(c, i, "u", f"t{i // 3}") for c in (41, 46) for i in range(120)] + [(c, 0, "u", "x") for c in range(50, 60)]


@pytest.mark.parametrize("small", [40, 100_000])
def test_trie_equals_brute_force(spark, small):
    rows = turns()
    got = trie.prefix_trie(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n long"), small)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, trie.brute_force(rows)))


def test_trie_of_no_conversations(spark):
    none = spark.createDataFrame([(None, 1, "u", "x")], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(none).count() == 0 and trie.prefix_trie(none.where("false")).count() == 0


def test_decomposition_of_any_tree():
    rng = random.Random(5)
    for shape in ("path", "star", "random"):
        parent = [None] + [{"path": i, "star": 0, "random": rng.randrange(i + 1)}[shape] for i in range(200)]
        a, weight = [rng.randrange(9) for _ in parent], [rng.randrange(1, 5) for _ in parent]
        depth, under, want = [0] * len(parent), [*weight], [*a]
        for i in range(1, len(parent)):
            depth[i] = depth[parent[i]] + 1
        for i in reversed(range(1, len(parent))):
            under[parent[i]] += under[i]
            want[parent[i]] += want[i]
        rows = sorted(((i, 0, parent[i], None if parent[i] is None else 0, depth[i], 0, under[i], a[i], 1, 0, 0, 0, 0) for i in range(len(parent))), key=lambda r: r[4])
        got = {r[0]: r[2] for r in trie.decomposed(rows)}
        assert got == dict(enumerate(want))


def test_running_totals_over_partitions(spark):
    rng = random.Random(6)
    rows = [(rng.choice("aab"), rng.randrange(50), rng.randrange(9)) for _ in range(400)]
    got = running(spark.createDataFrame(rows, "g string, k long, v long").repartition(7), "g", [F.col("k"), F.col("v")], ["v"], "running").collect()
    for g in "ab":
        total, mine = 0, sorted((r["ord"], r["k"], r["v"], r["run_v"]) for r in got if r["g"] == g)
        assert [m[1:3] for m in mine] == sorted(r[1:] for r in rows if r[0] == g)
        for i, m in enumerate(mine):
            total += m[2]
            assert m[0] == i and m[3] == total


def test_joins_with_hot_keys(spark):
    left = spark.createDataFrame([(1 if i % 2 else i, i) for i in range(3000)], "k long, x long")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("y")).where("k <> 4")
    for how, n in (("inner", 2999), ("left", 3000)):
        got = spread_join(left, right, ["k"], how)
        assert got.count() == n and got.columns == ["k", "x", "y"] and got.where("k = 1 and y = 2999").count() == 1500
