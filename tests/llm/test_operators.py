"""Each operator against brute force on small tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loftline.llm import ann, decontam, langid, lm, neardup, packing, pii, queries, secrets, suffixdedup, tokenbin, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = ["er", "on", "th", "an", "ing", "re", "ti", "é", "sh", "ou"]


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
    made = [" ".join(word() for _ in range(rng.randint(5, 200))) for _ in range(60)]
    passage = " ".join(word() for _ in range(120))
    out = [*made, *made[:6], None, "", "   ", "one", "one", "ONE two", "9" * 3000, "x " * 2000, f"{made[7]} {passage}", f"{passage} {made[8]}", f"{passage[3:]}"]
    for t in made[10:20]:
        w = t.split()
        for k in range(0, len(w), 25):
            w[k] = word()
        out.append(" ".join(w))
    out += [
        'api_key = "Zx9' + "aB3dE5fG7hJ9kL" + '" rest', "token: short", "AKIA" + "ABCDEF0123456789ZZ", "deadbeef" * 4 + " é " + "0123456789abcdef", "the secret here: see Qw8Zr5Ty2Lm9Xc4Vb7Np now",
        "hello <|endoftext|> world", "mail bob.x@example.co.uk, a@b@c.de and 10.0.0.256 or 10.0.0.1.9", "card 4111 1111 1111 1111 phone +1 (555) 010-9999 end", "+12 3",
    ]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    path = tmp_path_factory.mktemp("docs")
    rows = [(i, t, ("en", "fr", None)[i % 3], "s", 1) for i, t in texts] + [(None, "no id here at all", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.mark.parametrize(("value", "names"), [("'mine'", [*queries.QUERIES]), ("1", ["op7_decontamination", "op10_near_duplicates"])])
def test_extra_columns_with_clashing_names(spark, texts, tmp_path, value, names):
    some = [t for t in texts if t[0] % 8 == 0]
    docs = spark.createDataFrame([(i, t, ("en", "fr")[i % 2]) for i, t in some], "doc_id long, text string, lang string")
    items = spark.createDataFrame([(7, texts[8][1])], "item_id long, text string")
    vectors = spark.createDataFrame([(i, [1.0 + i, 2.0, -i * 0.5]) for i in range(60)], "vec_id long, embedding array<double>")
    out = []
    for folder, extra in (("plain", []), ("more", ["row_id", "spans", "score", "key", "word", "n", "first", "shard", "block", "doc", "kind", "term", "_text", "cid", "c0", "label"])):
        for name, table in (("documents", docs), ("benchmark", items), ("embeddings", vectors)):
            table.select("*", *[F.expr(f"{value} AS {c}") for c in extra]).coalesce(1).write.parquet(f"{tmp_path}/{folder}/{name}.parquet")
        out.append({n: Counter(map(str, q(spark, f"{tmp_path}/{folder}").collect())) for n in names for q in [queries.QUERIES[n]]})
    assert out[0] == out[1]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def digest(spans):
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "pipeline"])
def test_empty_tables(spark, nothing, name):
    assert queries.QUERIES[name](spark, nothing).count() == 0


def test_secrets(spark, folder, texts):
    got = by_id(queries.op1_secret_scan(spark, folder))
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, t in texts:
        s = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t or "") if len(m[2]) >= 12]
        s += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 18]
        s += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 16]
        spans = [f"{k}:{a}:{b}" for a, _, b, k in sorted(s)]
        assert got[i]["base_sha256"] == digest(spans)
        assert [x for x in got[i]["spans"].split(",") if x and not x.startswith("novel")] == spans
    assert sum(r["n_novel"] for r in got.values()) == 1


def test_repeated_strings_are_not_novel():
    value = "Qw8Zr5Ty2Lm9Xc4Vb7Np"
    assert secrets.novelty(value, "the secret: ", "") > 0.72 > secrets.novelty(value, f"{value} and {value} ", "")


def test_redaction_keeps_rows_and_columns(spark, folder, texts):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("spans", F.lit("mine"))
    got = secrets.redact_secrets(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    out = by_id(got)
    changed = {i for i, t in texts if out[i]["text"] != t}
    assert changed and all("[SECRET]" in out[i]["text"] and out[i]["n_chars"] == len(out[i]["text"]) for i in changed)


def luhn(d):
    return sum((x * 2 - 9 * (x > 4) if k % 2 else x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def personal(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


def test_personal_data(spark, tmp_path, texts):
    rng = random.Random(3)
    parts = ["1", "4", "9", "0", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "_", "x@y", "é", "\n", "  ", "255", "256", "+1", "4111111111111111", "10.0.0.1", "🙂", "%"]
    every = texts + [(1000 + k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for k in range(500)] + [(2000, "9" * 40000), (2001, "a" * 40000)]
    spark.createDataFrame(every, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = by_id(queries.op2_pii(spark, str(tmp_path)))
    for i, t in every:
        base = [x for x in got[i]["spans"].split(",") if x and not x.startswith("term")]
        assert base == personal(t or "") and got[i]["base_sha256"] == digest(base)


def test_telling_terms_are_generalised(spark):
    rows = [(i, f"some plain words here and mailto bob{i}@x.org then more words follow after it") for i in range(30)] + [(100 + i, "some plain words here and then more words follow after it " * 40) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(pii.sanitise(docs))
    assert "<EMAIL>" in got[0]["text"] and "mailto" not in got[0]["text"] and "words" in got[0]["text"]
    assert got[100]["text"] == rows[30][1]


def test_a_name_beside_its_address_is_found_anywhere(spark):
    rng = random.Random(8)
    filler = lambda n: " ".join(rng.choice(["some", "plain", "words", "go", "here", "and", "there", "now"]) for _ in range(n))
    rows = [(i, f"{filler(30)} write to Quillfeather at q.f@mail.org {filler(5)}") for i in range(8)]
    rows += [(10, f"{filler(60)} quillfeather left {filler(40)}"), (11, f"Quillfeather, q.f@mail.org; quillfeather@mail.org {filler(3)}"), (12, filler(8000)), (10, f"{filler(60)} again")]
    rows += [(20 + i, f"{filler(30)} write to someone at u{i}@mail.org {filler(5)}") for i in range(3)] + [(None, "Quillfeather"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit("mine"))
    got = pii.find_pii(docs, with_text=True).collect()
    assert len(got) == len(rows)
    terms = {r["text"]: [r["text"][s["start"] : s["end"]].lower() for s in r["spans"] if s["kind"] == "term"] for r in got}
    for _, t in rows:
        alone = re.sub(r"[\w.]+@[\w.]+", "", t or "").lower()
        assert [x for x in terms[t or ""] if x == "quillfeather"] == ["quillfeather"] * alone.count("quillfeather")
        assert not {"some", "plain", "words"} & set(terms[t or ""])
    out = [r["text"] for r in pii.sanitise(docs).collect()]
    assert len(out) == len(rows) and not any("uillfeather" in x for x in out)
    share = {r["term"]: r["share"] for r in pii.disclosure(docs, pii.find_entities(docs)).collect()}
    assert 0.5 <= share["quillfeather"] < 0.9 and any("<EMAIL TERM>" in x for x in out)


def test_texts_with_very_many_entities(spark):
    text = "\n".join(f"10.{k % 256}.{k // 256 % 256}.1 é" for k in range(40_000))
    [r] = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"]] == personal(text)


def test_language(spark):
    rng = random.Random(4)
    sounds = {"en": ["the", "ing", "wh", "and", "ed"], "de": ["sch", "ung", "ü", "der", "keit"], "fr": ["eau", "é", "que", "les", "ç"]}
    rows = [(i, " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(30)), lang) for i, lang in enumerate(sorted(sounds) * 60)]
    rows += [(900, None, "en"), (901, "12 34 !!", "de"), (902, "", None), (None, "the and", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = by_id(langid.predict(docs, model))
    held = [(i, lang) for i, _, lang in rows[:180] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 30 and all(got[i]["lang_pred"] == lang for i, lang in held)
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] for i in (900, 901, 902)) and all(0 <= r["score"] <= 1 for r in got.values())
    clash = docs.withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1))
    kept = langid.accepted(clash, model)
    assert kept.columns == clash.columns and kept.count() == 181


def test_packing(spark, folder, texts):
    got = queries.op4_packing(spark, folder).collect()
    plain = Tokenizer.from_file(public_tokenizers.path(tokens.DEFAULT_TOKENIZER))
    ids = {i: plain.encode(t or "", add_special_tokens=False).ids + [1] for i, t in [*texts, (None, "no id here at all")]}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts, total in [(pieces[i], len(x)) for i, x in ids.items()] + [(w, None) for w in windows.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == total if total is not None else at <= 2048
    assert len(windows) <= sum(map(len, ids.values())) / 2048 * 1.05 + 2
    with_ids = packing.cut_documents(spark.read.parquet(f"{folder}/documents.parquet"), with_ids=True).where("doc_id = 67").first()
    assert with_ids["ids"] == ids[67]


def test_token_files(spark, folder, texts, tmp_path):
    got = {r["doc_id"]: r for r in queries.op5_token_ids(spark, folder).collect()}
    plain, before = Tokenizer.from_file(public_tokenizers.path(tokens.DEFAULT_TOKENIZER)), 0
    for i, t in [(None, "no id here at all"), *texts]:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        before += len(ids)
    path = f"{tmp_path}/ids"
    tokenbin.write_token_ids(spark.read.parquet(f"{folder}/documents.parquet"), path)
    assert tokenbin.read_token_ids(spark, path).where("doc_id = 3").first()["ids"][-1] == 2


def test_language_model(spark, folder, texts):
    got = by_id(queries.op6_lm_score(spark, folder))
    tokens_of = lambda t: [*words_of(t), None]
    counts = Counter(w for i, t in texts if zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in texts:
        w, r = tokens_of(t), got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(counts[x] > 0 for x in w), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert not got[None]["held_out"]


def test_leaks(spark, texts):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 4)))
    item = " ".join(word() for _ in range(40))
    chars = list(item)
    for k in rng.sample(range(len(chars)), 4):
        chars[k] = "z"
    half = item[: len(item) * 3 // 4]
    far = "".join("z" if k % 4 == 0 else c for k, c in enumerate(item))
    docs = [*texts, (500, f"before {item.upper()} after"), (501, "x " + "".join(chars)), (502, f"{half} then on"), (503, far), (504, item[:40]), (500, item)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny"), (None, item)], "item_id long, text string")
    for size in (decontam.INDEX_BYTES, 300):
        got = decontam.leaks(df, items, size).collect()
        assert Counter((r["doc_id"], r["item_id"]) for r in got) == Counter({(500, 1): 2, (501, 1): 1, (502, 1): 1})
    tiny = spark.createDataFrame([(1, "T i-ny!"), (2, "tiny thing"), (3, "so tiny"), (4, "")], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["start"], r["end"]) for r in decontam.leaks(tiny, items).collect()] == [(1, 4, 0, 6)]
    kept = decontam.clean(df.withColumn("row_id", F.lit("mine")).withColumn("c0", F.lit(1)), items)
    assert kept.columns == ["doc_id", "text", "row_id", "c0"] and kept.count() == len(docs) - 4


def test_nearest(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[10] = x[150]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000, None, 0), (1050, [0.0] * 16, 0), (1100, [float("nan")] * 16, 0), (1150, [1.0] * 3, 0), (None, [1.0] * 16, 0), (1200, [None] * 16, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = defaultdict(list)
    for r in sorted(queries.op8_nearest(spark, str(tmp_path)).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hits = 0
    assert set(got) == set(range(0, 300, 50))
    for q, found in got.items():
        near = y @ y[q]
        near[q] = -9
        hits += len({v for v, _ in found} & set(np.lexsort((np.arange(300), -near))[:5].tolist()))
        assert len(found) == 5 and all(s == pytest.approx(near[v], abs=1e-12) for v, s in found)
    assert hits >= 0.9 * 30
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in ann.nearest(few, few.where("vec_id = 0")).collect()] == [(0, 1)]


def test_repeated_vectors_and_small_shards(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "mine") for i, v in enumerate(x)] * 2, "vec_id long, embedding array<float>, key string").repartition(3)
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    for shard, block in ((ann.SHARD_ROWS, ann.QUERY_BLOCK), (64, 5)):
        got = ann.nearest(df, df.where("vec_id % 50 = 0"), shard_rows=shard, query_block=block).collect()
        assert len(got) == 12 * 5
        hits = 0
        for q in range(0, 300, 50):
            near = y @ y[q]
            near[q] = -9
            want = np.repeat(np.lexsort((np.arange(300), -near))[:3], 2)[:5].tolist()
            own = [sorted(r["vec_id"] for r in got if (r["query_id"], r["rank"]) == (q, k)) for k in (1, 2, 3, 4, 5)]
            # Both rows of a query get the same answer, in which every vector stands twice.
            assert all(a == b for a, b in own) and own[0] == own[1] and own[2] == own[3] != own[0]
            hits += sum(w in (a for a, _ in own) for w in want)
        assert hits >= 0.9 * 30


def test_recall_on_many_vectors(spark, tmp_path):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(40, 64))
    x = (centres[rng.integers(0, 40, 50_000)] + 1.5 * rng.normal(size=(50_000, 64))).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float32()))}), f"{tmp_path}/v.parquet")
    df = spark.read.parquet(f"{tmp_path}/v.parquet").repartition(4)
    got = defaultdict(set)
    for r in ann.nearest(df, df.where("vec_id % 500 = 0")).collect():
        got[r["query_id"]].add(r["vec_id"])
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hits = 0
    for q in range(0, len(x), 500):
        near = y @ y[q]
        near[q] = -9
        hits += len(got[q] & set(np.argpartition(-near, 5)[:5].tolist()))
    assert len(got) == 100 and hits >= 0.9 * 500


def test_code_index_finds_all_within_radius():
    rng = np.random.default_rng(9)
    codes = rng.integers(0, 256, (500, 4), dtype=np.uint8)
    for radius in (0, 5, 9, 14):
        index = ann.Substrings(codes, radius)
        for q in codes[:20]:
            assert index.within(q).tolist() == np.flatnonzero(ann.hamming(codes, q) <= radius).tolist()


def without_repeats(docs, length):
    seen = Counter(b[s : s + length] for b in docs for s in range(len(b) - length + 1))
    out = []
    for b in docs:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1))
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("tile", [suffixdedup.TILE, 1])
def test_repeats(spark, texts, tile, monkeypatch):
    monkeypatch.setattr(suffixdedup, "TILE", tile)
    docs = [*texts, (None, texts[3][1]), (3, texts[3][1]), (900, "ab" * 500), (901, (texts[5][1] or "") * 3)]
    # Passages of 250 to 400 bytes, at the end of a row too, and repeats that only the next row would continue.
    docs += [(910 + k, f"{'xyz'[k]} {texts[12][1][k * 7 : k * 7 + 330 + k]}") for k in range(3)] + [(920 + k, texts[13][1][-300:]) for k in range(2)] + [(930 + k, f"{k}{texts[14][1][:280]}é{k}") for k in range(3)]
    got = suffixdedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    raw = [(t or "").encode() for _, t in docs]
    want = Counter((i, *r, p[2]) for (i, _), r, p in zip(docs, without_repeats(raw, 400), without_repeats(raw, 250)))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["n_passages"]) for r in got) == want


def components(docs, size, percent):
    sets = []
    for _, t in docs:
        w = words_of(t)
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(docs):
        least[root(k)].append(i)
    name = {g: min((i for i in ids if i is not None), default=None) for g, ids in least.items()}
    return [(i, len(sets[k]), name[root(k)]) for k, (i, _) in enumerate(docs)]


@pytest.mark.parametrize("tile", [neardup.TILE, 2])
def test_near_duplicates(spark, texts, tile, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", tile)
    rng = random.Random(12)
    base = [f"w{k}" for k in range(60)]
    docs = [*texts, (None, texts[4][1]), (4, texts[4][1])]
    for k in range(25):
        w = list(base)
        for j in rng.sample(range(60), rng.randint(1, 6)):
            w[j] = f"v{k}{j}"
        docs.append((600 + k, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = neardup.near_duplicates(df, words=2, percent=80).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(components(docs, 2, 80))
    kept = neardup.deduplicated(df.withColumn("first", F.lit(1)), words=2)
    names = Counter(c if n else (i, n) for i, n, c in components(docs, 2, 80))
    assert kept.columns == ["doc_id", "text", "first"] and kept.count() == len(names)
