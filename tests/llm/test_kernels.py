import random
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loftline.llm import decontam, kernels, packing, suffixes, tokens


def test_word_spans_and_hashes():
    texts = ["A b", "", None, " x\ty ", "a", "B"]
    buf, offs = kernels.utf8_view(pa.array(texts, pa.string()))
    starts, ends, first = kernels.word_spans(buf, offs)
    words = [bytes(buf[a:b]).decode() for a, b in zip(starts, ends)]
    assert words == ["A", "b", "x", "y", "a", "B"] and np.diff(first).tolist() == [2, 0, 0, 2, 1, 1]
    h = kernels.span_hashes(buf, starts, ends, lower=True)
    assert h[0] == h[4] and h[1] == h[5] and len(set(h.tolist())) == 4
    assert kernels.span_hashes(buf, starts, ends, lower=True, step=1).tolist() == h.tolist()


@pytest.mark.parametrize("limit", [1, 5, 1000])
def test_blocks_keep_rows(limit):
    texts = ["abc", None, "", "defgh" * 3, "x"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    got = [t for b in kernels.text_blocks([batch, batch.slice(0, 0), batch], "text", limit) for t in b["text"].to_pylist()]
    assert got == texts * 2


def test_pieces_encode_as_whole_texts():
    rng = random.Random(5)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", " ", "　", "'s", "'", "ll", "1", "23", ".", "!!", "ß", "中", "x", "word", "\x1c", "🙂", "Ġ", "\x85", "<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", "<|"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["", None, " ", "\n\nx", "long " * 2000, "a <|endof", "text|> b", "hello <|endoftext|> world"]
    ids, rows = tokens.encode_block(*kernels.utf8_view(pa.array(texts, pa.string())), 2)
    plain = Tokenizer.from_file(public_tokenizers.path(tokens.DEFAULT_TOKENIZER))
    for k, t in enumerate(texts):
        assert ids[rows[k] : rows[k + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids + [2]


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(250):
        t = [rng.randint(1, rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 60))] + [0]
        a = np.array(t, np.int16)
        order = suffixes.suffix_array(a)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        shared = suffixes.common_prefixes(a, order, 1000)
        for k in range(1, len(t)):
            x, y = t[order[k - 1] :], t[order[k] :]
            assert shared[k] == next(n for n in range(len(t) + 1) if x[n : n + 1] != y[n : n + 1])


def test_suffix_arrays_take_no_steps_by_symbol():
    def lines(t):
        count = 0

        def tracer(frame, event, arg):
            nonlocal count
            if frame.f_code.co_filename != suffixes.__file__:
                return None
            count += event == "line"
            return tracer

        old = sys.gettrace()
        sys.settrace(tracer)
        try:
            order = suffixes.suffix_array(t)
        finally:
            sys.settrace(old)
        assert len(order) == len(t)
        return count

    rng = np.random.default_rng(3)
    units = rng.integers(2, 60, (300, 400)).astype(np.int16)
    units[::2] = units[0]
    units[:, -1] = 1
    assert lines(np.append(units.ravel(), 0).astype(np.int16)) < 1000


def test_common_prefixes_of_some_suffixes():
    rng = random.Random(4)
    for _ in range(200):
        t = [rng.randint(1, rng.choice([1, 2, 3])) for _ in range(rng.randint(1, 60))] + [0]
        a = np.array(t, np.int16)
        order = suffixes.suffix_array(a)
        some = order[np.array([rng.random() < 0.6 for _ in t])]
        shared = suffixes.common_prefixes(a, some, 1000)
        for k in range(1, len(some)):
            x, y = t[some[k - 1] :], t[some[k] :]
            assert shared[k] == next(n for n in range(len(t) + 1) if x[n : n + 1] != y[n : n + 1])


def test_banded_edits():
    def plain(seg, region):
        row = [0] * (len(region) + 1)
        for i, c in enumerate(seg, 1):
            new = [i]
            for j, x in enumerate(region, 1):
                new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    rng = random.Random(2)
    for _ in range(200):
        a, b = (bytes(rng.choice(b"abc") for _ in range(rng.randint(lo, 25))) for lo in (1, 0))
        cost, x, y = decontam.banded_edits(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8), 99)
        assert cost == plain(a, b) == plain(a, b[x:y])


def test_best_fit():
    rng = random.Random(3)
    for _ in range(30):
        sizes = sorted((rng.randint(1, 64) for _ in range(rng.randint(0, 60))), reverse=True)
        into, offset, opened = packing.best_fit_decreasing(np.array(sizes, int), 64)
        rooms = []
        for n, w, o in zip(sizes, into.tolist(), offset.tolist()):
            fit = [(r, k) for k, r in enumerate(rooms) if r >= n]
            if fit:
                assert rooms[w] == min(fit)[0] and o == 64 - rooms[w]
            else:
                assert w == len(rooms) and o == 0
                rooms.append(64)
            rooms[w] -= n
        assert opened == len(rooms)
