"""Steps that walk whole texts against plain walks and against the window forms of the same operators."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from veilmark.functions.labels import tag
from veilmark.functions.text import BASE, COVER, RULES, compiled, tokens
from veilmark.functions.walk import slices, walk
from veilmark.operators import context, entities, subwords, texts
from veilmark.plans import queries as Q
from veilmark.plans.pipeline import evaluate, evaluate_texts

PARTS = ["a.b@c.de", "+1 (504) 555-2652", "10.0.0.1", "1.2.3.4567", "123456789", "1234567890123", " ", "\n", "\t", " \n ", "\xa0", "é", "ßx", "日本", "😀", "_", "..", "!", "?", "foo", "+", "@", "a@b", "+12", "9", ".", "-", "1.1.1", "\x1c", "\x85", "%", "q@w.e.r", "(", "\r\n", "\x0b"]


def made(n, size, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, size))) for _ in range(n)]


def plain(text):
    """Tokens by the covering pattern, piece by piece."""
    out, at, sent = [], 0, 0
    for ent, m in enumerate(compiled(COVER).finditer(text)):
        label = next((name for name, p in RULES if compiled(p).fullmatch(m.group())), None)
        inner = [x for x in compiled(BASE).finditer(m.group())]
        own = [x for x in inner if not all(c in " \t\n\x0b\f\r" for c in x.group())]
        out += [(x.group(), at + x.start(), at + x.end(), sent, label, ent, k, len(own)) for k, x in enumerate(own, 1)]
        if label is None:
            sent += m.group() in (".", "!", "?") or "\n" in m.group()
        at = m.end()
    return out


def test_tokens_are_those_of_the_covering_pattern():
    every = [None, "", *made(4000, 25, 1), "x" * 5 + "\n", "1" * 8, "1" * 9]
    got = []
    for _, off, data in slices(pa.array(every, pa.string())):
        w = walk(off, data)
        rows = list(zip(*[w.column(f).to_pylist() for f in ("token", "start", "end", "sent", "label", "ent", "k", "n")], strict=True))
        got += [rows[a:z] for a, z in zip(w.ends, w.ends[1:], strict=False)]
    assert got == [plain(t or "") for t in every]


def test_rows_of_a_long_note_in_time(spark):
    """400,000 tokens in 40,000 sentences of one note: every row's slices copied all of them before."""
    note = "one two three four five six seven eight nine. " * 40_000
    docs = spark.createDataFrame([(1, note), (2, ""), (3, None)], "doc_id long, text string")
    at = time.time()
    assert context.sentence_rows(docs, ["doc_id"], 32, 8, 32, 32, tokens="text", notation="BILOU").select(F.sum(F.size("tokens")), F.count("*")).first()[1] == 40_000
    assert context.windows(docs, ["doc_id"], tokens="text").select(F.sum(F.size("context_after"))).first()[0] > 0
    assert context.token_chunks(docs, ["doc_id"], 50, tokens="text").count() == 8000
    assert time.time() - at < 40


def test_rows_of_notes_and_of_texts_agree(spark):
    from veilmark.functions.text import note_tokens

    docs = spark.createDataFrame(list(enumerate([*made(150, 60, 2), "", None])), "doc_id long, text string")
    notes = note_tokens(docs, ["doc_id"])
    notes = notes.withColumn("tokens", F.transform("tokens", lambda x: x.withField("tag", tag(x["k"], x["n"], x["label"], "BIO"))))
    for more in ({}, {"context_labels": "label"}, {"info": ["start", "end"]}):
        a = context.sentence_rows(notes, ["doc_id"], 16, 4, 9, 5, **more)
        b = context.sentence_rows(docs, ["doc_id"], 16, 4, 9, 5, tokens="text", notation="BIO", **more)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() > 500
    vocabulary = ["B-EMAIL", "B-ID", "B-PHONE", "I-EMAIL", "I-ID", "I-PHONE", "O"]
    rows = context.sentence_rows(notes, ["doc_id"], 16, 4, 9, 5)
    for label_all in (False, True):
        want = rows.select("doc_id", "sent", "part", subwords.align(subwords.rule_pieces(F.col("tokens")), F.col("labels"), vocabulary, label_all).alias("a"))
        got = subwords.piece_rows(docs, ["doc_id"], vocabulary, label_all, 4, 16, 4, 9, 5, tokens="text", notation="BIO")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_entities_and_scores_of_texts_need_no_shuffle_and_agree_with_windows(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate([*made(300, 60, 3), "", None, "10.0.0.1 , 10.0.0.2 ; x"])), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    key, d = ["doc_id"], str(tmp_path)
    docs = Q._docs(spark, d)
    same = lambda a, b: sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))

    def tagged(notation):
        t = tokens(docs, key).withColumn("truth", tag(F.col("k"), F.col("n"), F.col("label"), notation))
        hole = F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("idx").cast("string"))), 1, 1) == "0"
        return t.withColumn("tag", F.when(hole, "O").otherwise(F.col("truth")))

    for notation in ("BILOU", "BIO", "BIOES", "IO"):
        t = tagged(notation)
        for mode, want in (("strict", entities.entities(t, key, notation)), ("lenient", entities.lenient_entities(t, key)), ("merged", entities.entities(entities.relax(t), key, "IO")), ("signs", entities.entities(entities.absorb_signs(t, key), key, "IO"))):
            got = texts.entities(docs, key, notation, mode, Q.HOLES)
            assert same(got, want.select("doc_id", "label", "start", "end")), (notation, mode)
            assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert same(texts.violations(docs, key, notation, Q.HOLES), entities.violations(t, key, notation)), notation
    gold = Q._gold(spark, d)
    for mode in ("strict", "default"):
        want = evaluate(gold, tagged("BILOU"), key, maps=Q.MAPS, mode=mode)
        got = evaluate_texts(docs, key, maps=Q.MAPS, mode=mode, retag=Q.HOLES)
        assert same(got.select("name", F.round("value", 9).alias("value")), want.select("name", F.round("value", 9).alias("value")))
        assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()


def test_conll_sink_can_compress(spark, tmp_path):
    from veilmark.sources.notes import write_conll

    docs = spark.createDataFrame([(1, "some words of a note " * 2000)], "doc_id long, text string")
    rows = context.sentence_rows(docs, ["doc_id"], 1 << 20, 32, 0, 0, tokens="text", notation="BIO")
    sizes = []
    for how in ("none", "lz4"):
        write_conll(rows, str(tmp_path / how), how)
        sizes.append(sum(p.stat().st_size for p in (tmp_path / how).glob("part*")))
    assert sizes[1] * 3 < sizes[0] and sorted(spark.read.text(str(tmp_path / "lz4")).collect()) == sorted(spark.read.text(str(tmp_path / "none")).collect())
