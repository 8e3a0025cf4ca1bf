"""Benchmark leaks against every window by a plain edit distance, and languages against plain vectors."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from loftline.llm import decontam, langid
from loftline.llm.kernels import utf8_view


def folded(t):
    return "".join(c for c in t.lower() if c.isalnum())


def least_edits(windows, text):
    """Fewest edits of each window (rows of equal length) against any part of ``text``, a column of the text at a time."""
    n = windows.shape[1]
    cost = np.tile(np.arange(n + 1), (len(windows), 1))
    best = cost[:, -1].copy()
    for c in text:
        new = np.zeros_like(cost)
        for i in range(1, n + 1):
            new[:, i] = np.minimum(np.minimum(cost[:, i - 1] + (windows[:, i - 1] != c), cost[:, i] + 1), new[:, i - 1] + 1)
        cost = new
        best = np.minimum(best, cost[:, -1])
    return best


def leaks_in(item, text):
    item, text = np.frombuffer(folded(item).encode(), np.uint8), np.frombuffer(folded(text).encode(), np.uint8)
    sizes = [(n, e) for n, e in decontam.WINDOWS if n <= len(item)]
    if len(item) < decontam.LONGEST:
        sizes.append((len(item), int(decontam.EDIT_SHARE * len(item)) if len(item) >= decontam.EXACT_BELOW else 0))
    for n, e in sizes:
        windows = np.array([item[s : s + n] for s in range(len(item) - n + 1)])
        if len(text) >= n - e and (least_edits(windows, text) <= e).any():
            return True
    return False


def test_leaks_are_those_of_all_windows():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("er on th an ing re ti sh ou la ke mo".split()) for _ in range(rng.randint(1, 4)))
    items = [" ".join(word() for _ in range(n)) for n in (3, 8, 11, 14, 25)]
    texts = []
    for _ in range(60):
        chars = list(folded(rng.choice(items)))
        at = rng.randint(0, max(0, len(chars) - 40))
        part = chars[at : at + rng.randint(40, 75)]
        for k in rng.sample(range(len(part)), min(len(part), rng.randint(0, 6))):
            part[k] = rng.choice(["z", "", part[k] + "z"])
        texts.append(f"{word()} {''.join(part)} {word()} {word()}")
    buf, offs = utf8_view(pa.array([*texts, None, ""]))
    got = {(i, r) for i, r, *_ in decontam.find_leaks(buf, offs, decontam.ItemIndex(list(enumerate(items))))}
    want = {(i, r) for i, item in enumerate(items) for r, t in enumerate(texts) if leaks_in(item, t)}
    assert got == want and 10 < len(want) < 60 * len(items)


def test_predictions_are_those_of_the_largest_cosine(spark):
    rng = random.Random(10)
    sounds = {"en": "th an ing er on re sh".split(), "de": "sch ung ei der keit ü".split(), "fr": "eau é que les oi ê".split()}
    rows = [(i, " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60))), lang) for i, lang in enumerate(sorted(sounds) * 60)]
    # Repeated rows, a tie between two languages that share all their texts, and a very long text.
    rows += [rows[0], rows[0]] + [(1000 + i, f"{t} aa", "en") for i, t, _ in rows[:3]] + [(2000, "the ing " * 40_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = defaultdict(list)
    for r in langid.predict(docs, model).collect():
        got[r["doc_id"]].append((r["lang_pred"], r["score"]))
    for i, t, _ in rows:
        # Letters in any case and bytes beyond ASCII count; all else is one boundary.
        b = [x | 0x20 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 0x20 for x in t.encode()]
        grams = Counter()
        for k, x in enumerate(b):
            if x != 0x20:
                grams[int(langid._hash(np.array([x + 1], np.uint32))[0])] += 1
            if k + 1 < len(b) and not x == b[k + 1] == 0x20:
                grams[int(langid._hash(np.array([(x << 8) + b[k + 1] + (1 << 20)], np.uint32))[0])] += 1
            if k + 2 < len(b) and not (b[k + 1] == 0x20 and 0x20 in (x, b[k + 2])):
                grams[int(langid._hash(np.array([(x << 16) + (b[k + 1] << 8) + b[k + 2] + (1 << 30)], np.uint32))[0])] += 1
            if k > 3000:
                break
        if len(b) > 3000:
            continue
        v = {g: math.log1p(n) * float(model.idf[g]) for g, n in grams.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x * float(c[g]) for g, x in v.items()) / size for c in model.centroids]
        best = max(range(len(cosines)), key=lambda k: cosines[k])
        for lang, score in got[i]:
            assert abs(score - cosines[best]) < 1e-3 and (lang == model.languages[model.owner[best]] or max(c for c, o in zip(cosines, model.owner) if model.languages[o] == lang) > cosines[best] - 1e-3)
    held = [(i, lang) for i, _, lang in rows[:180] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i][0][0] == lang for i, lang in held) >= 0.95 * len(held) and len(got[0]) == 3 and got[2000][0][0] == "en"
