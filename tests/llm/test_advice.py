
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsmelt.llm import pii, shingle_sets
from docsmelt.llm.impact_index import every
from docsmelt.llm.permutation_index import nearest

SPACE = r"[^\x20\x09-\x0d]+"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


# --- pipeline: near-duplicates ------------------------------------------------------------


def brute_sets(texts, k=5):
    out = []
    for text in texts:
        words = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append({" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} or ({" ".join(words)} if words else set()))
    return out


def brute_firsts(sets):
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def edited():
    rng = random.Random(3)
    base = [[f"W{rng.randint(0, 900)}" for _ in range(n)] for n in (3, 6, 9, 13, 14, 40, 40, 150, 700)]
    out = []
    for words in base:
        for _ in range(14):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 30))):
                copy[rng.randrange(len(copy))] = "changed"
            out.append(" ".join(copy + [f"more{rng.randint(0, 3)}"] * rng.randint(0, 1) + copy[-5:] * rng.choice([0, 0, 3])))
    return out


@pytest.mark.parametrize("group", [1 << 21, 400, 30])  # components in one group each, the large ones in blocks, nearly all
def test_near_dedup_is_jaccard_by_brute_force(spark, monkeypatch, group):
    import corpus_pipeline as pipeline

    monkeypatch.setattr(shingle_sets, "TILE_ROWS", 16)
    monkeypatch.setattr(shingle_sets, "GROUP_SHINGLES", group)
    texts = edited()
    root = brute_firsts(brute_sets(texts))
    assert 20 < len(set(root)) < len(texts) - 20
    stay = pipeline.near_dedup(spark, documents(spark, texts), "").collect()
    assert sorted(r["doc_id"] for r in stay) == sorted(set(root))
    got = {r["doc_id"]: r["component_id"] for r in shingle_sets.similar_texts(documents(spark, texts)).collect()}
    assert got == dict(enumerate(root))
    assert pipeline.near_dedup(spark, documents(spark, texts).limit(0), "").count() == 0


def test_similarity_of_exactly_four_fifths_links(spark):
    words = [f"w{i}" for i in range(8)]
    texts = [" ".join(words), " ".join([*words, "z"]), " ".join([*words, "y", "x"])]  # 4 shingles of 5, then 4 of 6
    assert [r["component_id"] for r in shingle_sets.similar_texts(documents(spark, texts)).orderBy("doc_id").collect()] == [0, 0, 2]


def test_texts_without_words_and_short_texts_stay(spark):
    import corpus_pipeline as pipeline

    short = [f"a{i} b{i} c{i} d{i} e{i} f{i}" for i in range(150)]  # some have few bits set in a fingerprint
    texts = [None, "", " \n", "\t", *short, "two words", "Two words"]
    stay = pipeline.near_dedup(spark, documents(spark, texts), "").collect()
    assert sorted(r["doc_id"] for r in stay) == list(range(len(texts) - 1))


def test_sketches_tell_no_similar_sets_apart(monkeypatch):
    monkeypatch.setattr(shingle_sets, "BLOCK", 8)
    rng, rule = np.random.default_rng(5), shingle_sets.Similarity(0.8)
    sets = []
    for n in (1, 2, 5, 40, 63, 64, 65, 130, 500, 2000):
        whole = rng.integers(0, 2**63, n).astype(np.uint64)
        for _ in range(8):
            copy = whole[rng.random(n) > rng.choice([0, 0.03, 0.1, 0.2])]
            sets.append(np.unique(np.concatenate([copy, rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 8))).astype(np.uint64)])))
    sets = sorted((s for s in sets if len(s)), key=len)
    size = np.array([len(s) for s in sets])
    data, first = shingle_sets.sketches(np.concatenate(sets), np.concatenate(([0], np.cumsum(size))), shingle_sets.sketch_bits(size))
    side = size, [data[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
    pairs = {(i, j) for a, b in shingle_sets.candidate_pairs(side, side, True, rule) for i, j in zip(a.tolist(), b.tolist())}
    similar = {(i, j) for j in range(len(sets)) for i in range(j) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    assert similar and similar <= pairs and len(pairs) < len(sets) ** 2 / 8


# --- 8: PII -----------------------------------------------------------------------------


def test_every_pattern_is_found_alone_in_a_text(spark):
    alone = [
        ("email", "x@y.org"), ("ip", "1.2.3.4"), ("card", "4994-2260-2090-0891"), ("ssn", "123-45-6789"),
        ("phone", "743-555-3824"), ("phone", "(74) 555-3824"), ("phone", "+1 743.555.3824"), ("phone", "+33 12 34 56 78"), ("phone", "+49-30-12-34-56"), ("phone", "+4 12.34.56"),
        ("iban", "GB82 WEST ABCD EFGH"), ("iban", "MT84MALTAB12CD34EF56"), ("iban", "DE89 3704 0044 0532 0130 00"),
        ("secret", "ab" * 16), ("secret", "AB" * 16), ("secret", "a1" * 16), *[("secret", f"{p}{s}abcdefghijklmnop") for p in ("sk", "pk", "ghp", "gho", "AKIA") for s in ("", "_", "-")],
        ("name", "Mary Jones"), *[("name", f"{a} Smith") for a in pii.ADDRESS], *[("name", f"{n} Smith") for k, v in pii.GIVEN_NAMES.items() if k[1] == "latin" for n in v],
    ]
    df = documents(spark, [f"so {v} it" for _, v in alone])
    kinds = [r[0] for r in documents(spark, [v for _, v in alone]).orderBy("doc_id").select(pii.kind_of(F.col("text"))).collect()]
    got = {r["doc_id"]: r for r in pii.replace_entities(df).collect()}
    for i, (kind, v) in enumerate(alone):
        assert (kinds[i], got[i]["n_entities"]) == (kind, 1) and v not in got[i]["text"], v


# --- 3: nearest neighbours with a hot vector ----------------------------------------------


def test_op3_keeps_the_smallest_ids_of_a_hot_vector(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(3000, 12)) / 3
    v[7] *= 3  # long, so the nearest to many
    v[rng.permutation(3000)[:1000]] = v[7]  # a third of the rows, and more than are reranked
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, every(100)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hits, hot = [], []
    for q in range(0, 3000, 100):
        score = (v * v[q]).sum(axis=1)
        want = sorted((i for i in range(3000) if i != q), key=lambda i: (-score[i], i))[:20]
        hits.append(len(set(want) & set(got[q])) / 20)
        if (v[want] == v[7]).all():
            hot.append(got[q] == want)
    assert hot and all(hot) and np.mean(hits) >= 0.9
