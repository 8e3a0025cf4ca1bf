"""Telling terms against a plain count of texts and sightings."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from loftline.llm import pii

MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
TERM = re.compile(r"[^\W\d_]\w+")


def lower(p, n, z=1.645):
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def plain(texts):
    """term: (share, bits) of the telling ones, for texts whose entities are addresses."""
    occurs, near, sightings, places = Counter(), Counter(), defaultdict(dict), Counter()
    for t in texts:
        for w in TERM.findall(MAIL.sub(" ", t).lower()):
            occurs[w] += 1
        cuts = [(0, 0), *[m.span() for m in MAIL.finditer(t)], (len(t), len(t))]
        for k in range(1, len(cuts) - 1):
            a, b = cuts[k]
            before, after = t[cuts[k - 1][1] : a], t[b : cuts[k + 1][0]]
            before = re.sub(r"^\w+", "", before[-96:]) if len(before) > 96 else before
            after = re.sub(r"\w+$", "", after[:96]) if len(after) > 96 else after
            words = TERM.findall((before + " " + after).lower())
            for target in (t[a:b].lower(), "kind"):
                for w in words:
                    near[w, target] += 1
                    places[target] += 1
                    sightings[w, target].setdefault((t[a:b].lower(), tuple(words)), set()).add(t)
    out = {}
    for (w, target), n in near.items():
        # A sighting stands for one text; here each text's sightings are its own or all texts' alike.
        texts_near = len({min(held) for held in sightings[w, target].values()})
        p = min(n, occurs[w]) / occurs[w]
        share = lower(p, texts_near / p)
        bits = math.log2(p) - math.log2(places[target] / sum(occurs.values()))
        if share >= pii.MIN_SHARE and bits >= pii.MIN_BITS:
            out[w] = max(out.get(w, (0.0, 0.0)), (share, bits))
    return out


def telling(spark, texts):
    docs = spark.createDataFrame([(k % 40, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    return {r["term"]: (r["share"], r["bits"]) for r in pii.disclosure(docs, pii.find_entities(docs)).collect()}


def filler(rng, n):
    return " ".join(rng.choice("some plain words go here and there now while others stay".split()) for _ in range(n))


def test_telling_terms_equal_a_plain_count(spark):
    rng = random.Random(3)
    names = {"quillfeather": "q.f@mail.org", "brandywine": "b@x.org", "underhill": "u@y.net"}
    texts = [filler(rng, rng.randint(5, 60)) for _ in range(300)]
    for name, mail in names.items():
        texts += [f"{filler(rng, 30)} ask {name} at {mail} {filler(rng, rng.randint(3, 40))}" for _ in range(6)]
    texts += [f"{filler(rng, 40)} underhill {filler(rng, 20)}" for _ in range(9)]
    texts += [f"mails x{k}@z.org {filler(rng, 20)} x{k}@z.org" for k in range(4)]
    want = plain(texts)
    assert {"quillfeather", "brandywine"} <= set(want) and "underhill" not in want
    got = telling(spark, texts)
    assert set(got) == set(want)
    assert all(got[w] == pytest.approx(want[w], rel=1e-9) for w in want)
    # Copies of all texts make nothing surer.
    assert {w: s for w, (s, _) in telling(spark, texts * 2).items()} == pytest.approx({w: s for w, (s, _) in want.items()})


def test_copies_and_repeated_lines_tell_nothing(spark):
    rng = random.Random(5)
    other = [filler(rng, 30) for _ in range(200)]
    bulletin = "Quarterly hydrology bulletin contact bob@x.org for the estuary survey"
    assert telling(spark, other + [bulletin] * 4) == {}
    # Near copies differ elsewhere; what stands around the address is the same.
    lead = "over the whole long river valley and across all the hills around it as far as one can see from the bridge "
    near = [f"{filler(rng, 20)} {lead}{bulletin} {lead}{filler(rng, 20)}" for _ in range(6)]
    assert telling(spark, other + near) == {}
    line = "the ofenwhen of elquerrie writes from 10.1.2.3 to a@b.org again\n"
    assert telling(spark, other + [line * 30]) == {}
