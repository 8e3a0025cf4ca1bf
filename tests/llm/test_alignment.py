"""Alignments against whole-text encoding by fresh tokenizers and plain loops."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from loftline.llm import alignment
from loftline.llm.tokens import _BYTE_CHARS


def encoders():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    value = {c: k for k, c in enumerate(_BYTE_CHARS)}

    def first(text):
        e = a.encode(" " + text, add_special_tokens=False)
        return [(i, bytes(value[c] for c in t)) for i, t in zip(e.ids, e.tokens)]

    def second(text):
        return [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text))]

    return first, second


def spans(tokens):
    at = 0
    for i, raw in tokens:
        yield i, at, at + len(raw)
        at += len(raw)


def plain(rows):
    first, second = encoders()
    done, total = {}, Counter()
    for n, (_, text) in enumerate(rows):
        x, y = (first(text), second(text)) if text else ([], [])
        if not text or any(b"".join(r for _, r in z) != (" " + text).encode() for z in (x, y)):
            done[n] = ([], 0, 0, 0, "")
            continue
        x, y = list(spans(x)), list(spans(y))
        links = [(i, j) for i, lo, hi in x for j, a, b in y if a < hi and lo < b] if len(x) < 600 else swept(x, y)
        total.update(links)
        ends = sorted({h for _, _, h in x} & {h for _, _, h in y})
        groups, lo = [], 0
        if len(x) < 600:
            for hi in ends:
                groups.append(",".join(str(i) for i, a, b in x if lo <= a and b <= hi) + "|" + ",".join(str(i) for i, a, b in y if lo <= a and b <= hi))
                lo = hi
        done[n] = (links, len(x), len(y), len(ends), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else None)
    top = Counter()
    for (_, j), c in total.items():
        top[j] = max(top[j], c)
    return [(rows[n][0], x, y, g, len(links), sum(total[p] == top[p[1]] for p in links), sum(total[p] for p in links), sha) for n, (links, x, y, g, sha) in done.items()]


def swept(x, y):
    out, k = [], 0
    for i, lo, hi in x:
        while y[k][2] <= lo:
            k += 1
        j = k
        while j < len(y) and y[j][1] < hi:
            out.append((i, y[j][0]))
            j += 1
    return out


TEXTS = [
    None, "", " ", "a ", "  two  spaces  ", "<|endoftext|> and </s> <s> <unk> <0x41>", "tab\tand\nlines\r\n\n  x", "Ünïcödé naïve café", "日本語のテキスト 한국어", "🙂👩‍👩‍👧 emoji", "x▁y", "▁",
    "é composed é", "zero​width nbsp　wide", "a\x00b", "12345 678,90 $5.00", "don't can't it's", "A" * 300, "ﬁ ligature", "under_score __init__ == != ->", "same text here", "same text here",
]


def rows_of(seed, n):
    rng = random.Random(seed)
    parts = [t for t in TEXTS if t] + ["the quick brown fox", "jumps over", "Straße", "\n", " ", "internationalization", "0x7fff"]
    return [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, rng.choice(["", " ", "\n"]).join(rng.choice(parts) for _ in range(rng.randint(1, 9))).replace("▁", "_")) for i in range(n)]


def got(df):
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((r["doc_id"], *(r[n] for n in names)) for r in df.collect())


def test_against_plain_loops(spark, monkeypatch):
    rows = rows_of(1, 60)
    want = sorted(plain(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(alignment.align(docs.coalesce(1))) == want
    # Several blocks, and several stretches in each.
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 700)
    monkeypatch.setattr(alignment, "STRETCH", 90)
    assert got(alignment.align(docs.repartition(3))) == want


def test_a_long_text_in_stretches(spark):
    rows = [(1, "lorem ipsum dolor-sit amet " * 9000), (2, "ab" * 20_000), (3, "7" * 50_000)]
    want = {r[0]: r[1:7] for r in plain(rows)}
    result = {r[0]: r[1:7] for r in got(alignment.align(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert result == want


def test_pair_counts_repeats_empties_and_clashes(spark):
    rows = [(1, "one two", 5, "x"), (1, "one two", 6, None), (None, "one", 7, "y"), (None, None, 8, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block long, sha string")
    out = sorted((r["doc_id"] or 0, r["n_links"], r["count_sum"]) for r in alignment.align(docs).collect())
    assert out == [(0, 0, 0), (0, 1, 3), (1, 2, 5), (1, 2, 5)]
    pairs = [(r["n"], r["best"]) for r in alignment.pair_counts(docs).orderBy("n").collect()]
    assert pairs == [(2, True), (3, True)]
    assert alignment.align(docs.limit(0)).collect() == []


def test_pieces_of_cut_texts_equal_whole_texts():
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = [t for _, t in rows_of(7, 200) if t and "▁" not in t]
    from loftline.llm.kernels import utf8_view

    buf, offs = utf8_view(pa.array([" " + t for t in texts]))
    ids, at = alignment.encode_pieces(buf, offs)
    assert [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:])] == [b.encode(t) for t in texts]
