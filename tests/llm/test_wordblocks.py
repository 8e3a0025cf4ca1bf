"""Repeated word windows against a plain walk over all windows."""

import hashlib
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loftline.llm import wordblocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, window=20):
    """doc_id: (words, removed, sha) of distinct ids, by all windows in order."""
    words = {i: WORD.findall(t or "") for i, t in rows}
    seen, gone = set(), {i: set() for i in words}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            key = tuple(words[i][p : p + window])
            if key in seen:
                gone[i].update(range(p, p + window))
            seen.add(key)
    keep = {i: " ".join(w for p, w in enumerate(ws) if p not in gone[i]) for i, ws in words.items()}
    return {i: (len(words[i]), len(gone[i]), hashlib.sha256(keep[i].encode()).hexdigest()) for i in words}


def answer(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Ä", "be", "sea", "Sea", "日本", "x" * 30, "don't", "12"]) + str(rng.randint(0, 40))
    passages = [[word() for _ in range(n)] for n in (19, 20, 21, 29, 60, 400)]
    rows = [(0, None), (1, ""), (2, " \t\n\x0b"), (3, " ".join(["same"] * 500)), (4, " ".join(["same"] * 19))]
    for i in range(5, 120):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts += rng.choice([[word() for _ in range(rng.randint(1, 45))], rng.choice(passages), rng.choice(passages)[3:]])
        rows.append((i, rng.choice([" ", "\n", "   "]).join(parts)))
    # One passage in a third of all rows.
    return rows + [(i, " ".join(passages[3] + [str(i)])) for i in range(120, 180)]


@pytest.mark.parametrize("parts", [1, 7])
def test_windows_against_all_windows(spark, parts, monkeypatch):
    # Small shards and packs, so that hits cross them.
    monkeypatch.setattr(wordblocks, "SHARD_BYTES", 3000)
    rows = corpus(parts)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert answer(wordblocks.remove_repeated_words(docs)) == plain(rows)


def test_every_offset_of_a_copied_window(spark):
    rng = random.Random(4)
    source = [f"w{rng.randint(0, 10**9)}" for _ in range(60)]
    rows = [(0, " ".join(source))]
    for start in range(41):
        rows.append((1 + start, " ".join([f"a{start}"] * (start % 13) + source[start : start + 20] + ["end"])))
        rows.append((100 + start, " ".join([f"b{start}"] * (start % 7) + source[start : start + 19])))
    got = answer(wordblocks.remove_repeated_words(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == plain(rows)
    assert all(got[1 + s][1] == 20 and got[100 + s][1] == 0 for s in range(41))


def test_repeated_ids_nulls_and_clashing_columns(spark):
    text = " ".join(f"t{k}" for k in range(25))
    rows = [(7, text, 1, "x"), (7, text, 2, "y"), (None, text, 3, None), (None, None, 4, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block int, texts string")
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in wordblocks.remove_repeated_words(docs).collect())
    assert got == [(-1, 0, 0), (-1, 25, 0), (7, 25, 25), (7, 25, 25)]
    assert wordblocks.remove_repeated_words(docs.limit(0)).collect() == []


def test_maximal_repeats_and_kept_words(spark):
    a, b = [f"a{k}" for k in range(30)], [f"b{k}" for k in range(22)]
    rows = [(1, " ".join(a + ["-"] + b)), (2, "x " + "  ".join(a) + " y\n" + " ".join(b)), (3, " ".join(a[5:29]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["start"], r["end"]): r["words"] for r in wordblocks.maximal_repeats(docs).collect()}
    assert got == {(2, 1, 31): " ".join(a), (2, 32, 54): " ".join(b), (3, 0, 24): " ".join(a[5:29])}
    kept = {r["doc_id"]: bytes(r["kept"]).decode() for r in wordblocks.remove_repeated_words(docs, with_text=True).collect()}
    assert kept == {1: rows[0][1], 2: "x y", 3: ""}
    with pytest.raises(ValueError):
        wordblocks.remove_repeated_words(docs, window=18)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40), min_size=1, max_size=6))
def test_few_symbols(spark, texts):
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert answer(wordblocks.remove_repeated_words(spark.createDataFrame(rows, "doc_id long, text string"), 5, 3)) == plain(rows, 5)


def test_a_very_long_repetitive_text(spark):
    rows = [(0, "one two three " * 60_000), (1, "one two three " * 50), (2, "z" * 2_000_000)]
    got = answer(wordblocks.remove_repeated_words(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[0][:2] == (180_000, 180_000 - 3) and got[1][:2] == (150, 150) and got[2][:2] == (1, 0)
