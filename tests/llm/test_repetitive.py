"""Texts and items that repeat themselves: results as elsewhere, memory bounded."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from loftline.llm import decontam
from loftline.llm.kernels import utf8_view


def found(items, texts):
    buf, offs = utf8_view(pa.array(texts))
    return sorted(decontam.find_leaks(buf, offs, decontam.ItemIndex(items)))


def corpus(seed):
    rng = np.random.default_rng(seed)
    word = lambda n: "".join(rng.choice(list("abcd"), n))
    items = [(k, word(int(n))) for k, n in enumerate(rng.integers(20, 400, 12))] + [(50, "ab" * 90), (51, "7" * 120), (52, "abc" * 17), (53, word(5))]
    texts = ["", "ab" * 300, "7" * 49, "7" * 700, None]
    for _ in range(30):
        parts = []
        for _ in range(rng.integers(1, 5)):
            source = items[rng.integers(len(items))][1]
            a = int(rng.integers(0, len(source)))
            cut = list(source[a : a + int(rng.integers(30, 200))])
            for at in rng.integers(0, max(1, len(cut)), len(cut) // 20):
                if cut:
                    cut[at] = rng.choice(["x", "", cut[at] + "y"])
            parts += ["".join(cut), word(int(rng.integers(0, 60)))]
        texts.append(" ".join(parts))
    return items, texts


@pytest.mark.parametrize("seed", [1, 2])
def test_stretches_find_what_whole_texts_do(monkeypatch, seed):
    items, texts = corpus(seed)
    want = found(items, texts)
    assert len(want) > 20
    # Every text by itself, in stretches, with few shared q-grams listed at a time.
    monkeypatch.setattr(decontam, "STRETCH", 64)
    for listed in (1, 300):
        monkeypatch.setattr(decontam, "LISTED", listed)
        got = found(items, texts)
        # The same items with as many edits; where several places are as good, any is.
        assert [(i, r, e) for i, r, _, e, *_ in got] == [(i, r, e) for i, r, _, e, *_ in want]


def test_pieces_of_long_items(monkeypatch):
    items, texts = corpus(3)
    want = [(i, r, e) for i, r, _, e, *_ in found(items, texts)]
    monkeypatch.setattr(decontam, "PIECE", 130)
    index = decontam.ItemIndex(items)
    assert len(index.items) > len(items) and len([x for x in index.items if x.item_id == 50]) < 180 // 30
    assert [(i, r, e) for i, r, _, e, *_ in found(items, texts)] == want


MEASURED = """
import resource, time
import numpy as np, pyarrow as pa
from loftline.llm import decontam
from loftline.llm.kernels import utf8_view
kinds = ["".join(chr(97 + (k * j + j) % 26) for j in range(1, p + 1)) for k, p in enumerate(range(15, 35))]
items = [(100, "7" * 300)] + [(k, (p * 200)[:1080]) for k, p in enumerate(kinds)]
texts = ["7" * 1_000_000, (kinds[3] * 9000)[:108_000], "".join((p * 400)[:5400] for p in kinds)]
began = time.time()
buf, offs = utf8_view(pa.array(texts))
out = decontam.find_leaks(buf, offs, decontam.ItemIndex(items))
print(len(out), time.time() - began, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1e3)
"""


def test_memory_and_time_of_repetitive_texts():
    told = subprocess.run([sys.executable, "-c", MEASURED], capture_output=True, text=True, check=True, cwd=Path(decontam.__file__).parents[2]).stdout.split()
    assert int(told[0]) >= 22 and float(told[1]) < 10 and float(told[2]) < 500
