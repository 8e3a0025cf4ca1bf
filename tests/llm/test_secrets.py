"""Secrets that the base patterns miss, strings that are none, and the identifiers of a corpus."""

import random

from loftline.llm import secrets

B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def test_planted_secrets_are_found_and_identifiers_are_not(spark):
    rng = random.Random(3)
    noise = lambda n: "\n".join(f"    value_{k} = load({k})  # step {k}" for k in range(n))
    planted, plain = [], []
    for k in range(120):
        value = "".join(rng.choice(B64) for _ in range(rng.choice((24, 32, 40, 64))))
        line = ("Authorization: Bearer {}", "the credential is {}", "access key id {} here", "private-key file holds {}")[k % 4].format(value)
        planted.append((k, f"{noise(8)}\n{line}\n{noise(8)}", value))
        names = rng.sample(["session_token2_handler_v1", "get_user_secret_key1_name", "credential_store_v2_backend", "api_key_rotation_2024_policy", "bearer_token1_refresh_job"], 3)
        plain.append((1000 + k, f"{noise(4)}\nsee the secret store and token guide: {' '.join(names)}\n{noise(4)}\n{' '.join(names)}"))
    docs = spark.createDataFrame([p[:2] for p in planted] + plain, "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.scan_secrets(docs).collect()}
    hit = sum(any(k == "novel" and text[a:b] == value for k, a, b in got[i]) for i, text, value in planted)
    wrong = sum(len(got[i]) for i, _ in plain)
    assert hit >= 114 and wrong == 0


def test_the_corpus_names_its_identifiers(spark):
    rows = [(k, f"secret_rotation_policy: the token lives in vaultkeeper {k}\nnothing") for k in range(30)] + [(99, "a token Qw8Zr5Ty2Lm9Xc4Vb7Np alone"), (None, None), (98, "no such word in unrelatedname here")]
    words = secrets.identifiers_of(spark.createDataFrame(rows, "doc_id long, text string"))
    assert words.startswith(secrets.IDENTIFIERS) and "vaultkeeper" in words and "secret_rotation_policy" in words
    assert "Qw8Zr5Ty2Lm9Xc4Vb7Np" not in words and "unrelatedname" not in words
    assert secrets.novelty("vaultkeeper1vaultkeeper", "", "", words) < secrets.novelty("vaultkeeper1vaultkeeper", "", "")


def test_a_string_that_its_text_repeats_far_away_is_not_novel():
    value, filler = "Qw8Zr5Ty2Lm9Xc4Vb7Np", "plain words go here " * 3000
    assert [s for s, *_ in secrets.novel_spans(f"{filler}the secret {value}", [])] == [len(filler) + 11]
    assert not secrets.novel_spans(f"{value} {filler}the secret {value}", [])


def test_texts_of_very_many_secrets(spark):
    text = "".join(f"token = {'%032x' % (k * 7919)} é\n" for k in range(4000))
    [r] = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    kinds = [s["kind"] for s in r["spans"]]
    assert kinds.count("assign") == 4000 and kinds.count("hex") == 4000
