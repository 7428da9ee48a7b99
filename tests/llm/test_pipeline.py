"""The pipeline against a chain of brute-force stages, and its stages on odd tables."""

import random
import re

import pytest

pytest.importorskip("public_tokenizers")


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
        p = q
    return p[-1]


def classes(n, linked):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def corpus():
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    shared = line(14)
    texts = []
    for _ in range(14):
        lines = [line(rng.randint(8, 16)) for _ in range(8)]
        texts.append("\n".join(lines))
        if rng.random() < 0.5:
            lines.insert(3, shared if rng.random() < 0.5 else shared[:-1] + "!")
        if rng.random() < 0.4:
            lines.append("home | about | contact | terms | help")
        if rng.random() < 0.4:
            lines.append('the token = "' + "0f" * 20 + '" is in here')
        t = "\n".join(lines).split(" ")
        for _ in range(rng.choice((0, 1, 2, 40))):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    return [*texts, None, "", "too short", " ".join(["same"] * 300)]


def brute(rows):
    """(doc_id, text) after each stage but the last."""
    from veilmark.llm.quality import judge

    rows = [(d, judge(t)) for d, t in rows]
    rows = [(d, r[10]) for d, r in rows if r[6]]
    yield rows
    at = [(d, i, x.strip()) for d, t in rows for i, x in enumerate(t.split("\n")) if x.strip()]
    own = [x for *_, x in at]

    def like(i, j):
        a, b = own[i], own[j]
        few, n = min(len(a.split()), len(b.split())) // 20, min(2, min(len(a), len(b)) // 32)
        return a == b or (abs(len(a) - len(b)) <= n and lev(a, b) <= n) or (few > 0 and lev(a.split(), b.split()) <= few)

    gone = {at[i][:2] for i, c in enumerate(classes(len(own), like)) if c != i}
    rows = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)) for d, t in rows]
    yield rows
    sets = []
    for _, t in rows:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    rows = [r for i, (r, c) in enumerate(zip(rows, classes(len(rows), lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])))) if c == i]
    yield rows
    yield [(d, re.sub(r"token = \"[0-9a-f]{40}|[0-9a-f]{32,}", "<secret>", t)) for d, t in rows]


def test_run_is_the_chain_of_brute_force(spark, tmp_path):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    import corpus_pipeline as P

    texts = corpus()
    kind = "doc_id long, text string, lang string, source string, n_chars long, row string, spans int"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in enumerate(texts)], kind)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, ((name, stage), want) in enumerate(zip(P.STAGES, brute(list(enumerate(texts))))):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        now = spark.read.parquet(f"{tmp_path}/out{k}")
        assert {r.doc_id: r.text for r in now.collect()} == dict(want), name
        assert now.columns == docs.columns and all(r.n_chars == len(r.text) for r in now.collect()), name
    assert len(want) < len(texts) - 4 and any("<secret>" in t for _, t in want)
    rows, tok = P.run(spark, str(tmp_path)).collect(), Tokenizer.from_file(path("byte_bpe_50k.json"))
    for d, t in want:
        assert sum(r.length for r in rows if r.doc_id == d) == len(tok.encode(t, add_special_tokens=False).ids) + 1
    assert {r.doc_id for r in rows} == {d for d, _ in want}


def test_stages_on_nulls_repeats_and_nothing(spark):
    import corpus_pipeline as P

    good = " ".join(f"word{i}" for i in range(60)) + "."
    rows = [(None, None), (None, good), (1, None), (1, good), (1, good), (1, good + " and a little more"), (2, ""), (3, "x " * 50_000)]
    docs = spark.createDataFrame([(d, t, "a", "b", 0) for d, t in rows], "doc_id long, text string, key string, gone string, n_chars long")
    for name, stage in P.STAGES:
        assert stage(spark, docs, "").count() > 0, name
        assert stage(spark, docs.limit(0), "").count() == 0, name
    kept = sorted(((r.doc_id, r.text) for r in P.near_dedup(spark, docs, "").collect()), key=str)
    # of equal rows one stays; null ids all stay; null and empty texts are alike
    assert [d for d, _ in kept] == sorted([None, None, 1, 1, 3], key=str) and (2, "") not in kept
