import itertools
import random

import pytest
from pyspark.sql import functions as F

from veilmark.functions.labels import checked, default_tags, tag_tokens, zip_equal
from veilmark.functions.text import chunks, squeeze
from veilmark.operators import context, entities, redact, scores, spans, split


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in (("text", "string"),)[: len(values)]) or "x int").select(column).first()[0] if values else spark.range(1).select(column).first()[0]


def span_array(items):
    return F.from_json(F.lit(str([dict(zip(("start", "end", "label"), i)) for i in items]).replace("'", '"')), "array<struct<start:int,end:int,label:string>>")


def test_duplicate_span_keeps_the_higher_priority(spark):
    got = one(spark, spans.resolve(F.lit("BWH^Bruce"), span_array([(0, 9, "HOSP"), (0, 9, "PATIENT")])))
    assert [tuple(s) for s in got] == [(0, 9, "PATIENT")]


def test_partial_overlap_cuts_the_later_span(spark):
    got = one(spark, spans.resolve(F.lit("JT/781-815-9090"), span_array([(0, 6, "HOSP"), (3, 15, "PHONE")])))
    assert [tuple(s) for s in got] == [(0, 6, "HOSP"), (6, 15, "PHONE")]


def test_span_grows_to_its_token(spark):
    got = one(spark, spans.align(span_array([(15, 17, "AGE")])[0], F.array(F.lit(0), F.lit(15)), F.array(F.lit(3), F.lit(19))))
    assert tuple(got) == (15, 19, "AGE")


def test_ages_that_stay(spark):
    kept = [a for a in ["0", "1", "8", "9", "10", "79", "80", "88", "89", "90", "120", "92 (45)"] if one(spark, redact.replacement(F.lit(a), F.lit("AGE"), "remove", True)) == a]
    assert kept == ["1", "8", "10", "79", "80", "88", "92 (45)"]


def test_redaction_counts_code_points_and_joins_blanks(spark):
    got = one(spark, redact.redact(F.lit("😀 Jack\t \n\n x "), span_array([(2, 6, "PATIENT")]), "replace_informative"))
    assert got == "😀 <<PATIENT:Jack>> \n x"


def test_signs_between_one_type_are_absorbed(spark):
    tags = "B-LOC I-LOC L-LOC O U-LOC O U-LOC".split()
    toks = "12 Mill Lane , Annex ; Riverton".split()
    df = spark.createDataFrame([("a", i, t, g) for i, (t, g) in enumerate(zip(toks, tags))], "k string, idx int, token string, tag string")
    assert {r["tag"] for r in entities.absorb_signs(df, ["k"]).collect()} == {"I-LOC"}


def test_violations(spark):
    df = spark.createDataFrame([("a", 0, "O"), ("a", 1, "I-DATE"), ("b", 0, "B-DATE"), ("b", 1, "O")], "k string, idx int, tag string")
    assert {r["k"]: r["violations"] for r in entities.violations(df, ["k"], "BILOU").collect()} == {"a": 1, "b": 0}
    assert all(r["violations"] == 0 for r in entities.violations(df, ["k"], "IO").collect())


def loop_trim(p, c, n, budget, chunk):
    while p + c + n > budget and (n > chunk or p > chunk):
        if n >= p:
            n -= 1
        else:
            p -= 1
    return p, n


def test_trim_is_the_loop(spark):
    rows = [(p, c, n, b, k) for p in range(0, 33, 5) for c in (1, 7, 40) for n in range(0, 33, 4) for b, k in ((48, 8), (32, 4))]
    for b, k in ((48, 8), (32, 4)):
        own = [r for r in rows if r[3:] == (b, k)]
        df = spark.createDataFrame(own, "p int, c int, n int, b int, k int")
        a, z = context.trim(F.col("p"), F.col("c"), F.col("n"), b, k)
        for r in df.select("p", "c", "n", a.alias("x"), z.alias("y")).collect():
            assert (r.x, r.y) == loop_trim(r.p, r.c, r.n, b, k)


def loop_rows(n, start, end, budget, chunk, before, after, pre, post, sub=False):
    """Rows (part's tokens, left, right) of a note's sentences by popping tokens; ``n``: their sizes, ``pre`` and ``post``: chunks put at the ends."""
    at = [sum(n[:i]) for i in range(len(n) + 1)]
    for i, c in enumerate(n):
        p, z = loop_trim(min(before, at[i] - start), c, min(after, end - at[i + 1]), budget, chunk)
        if p + c + z <= budget:
            yield at[i], c, p + (pre if i == 0 else 0), z + (post if i == len(n) - 1 else 0)
        else:
            size = budget - 2 * chunk
            cuts = [min(size, c - k) for k in range(0, c, size)]
            yield from ((at[i] + a, m, q, r) for a, m, q, r in loop_rows(cuts, 0, c, budget, chunk, before, after, p, z, True))


def test_long_sentences_are_split_as_the_loop_does(spark):
    rng = random.Random(9)
    for budget, chunk, before, after in ((32, 8, 32, 32), (128, 32, 32, 32), (20, 4, 7, 50)):
        sizes = [60, 3, *[rng.choice((1, 5, 17, 30, 33, 64, 200)) for _ in range(25)]]
        want = list(loop_rows(sizes, 0, sum(sizes), budget, chunk, before, after, 0, 0))
        at = [sum(sizes[:i]) for i in range(len(sizes) + 1)]
        rows = [(i, at[i], at[i + 1], min(before, at[i]), min(after, at[-1] - at[i + 1])) for i in range(len(sizes))]
        s = spark.createDataFrame(rows, "k int, i int, j int, n_before int, n_after int")
        got = [(r.part_i, r.part_j - r.part_i, r.left, r.right) for r in context.split_long(s, budget, chunk, before, after).orderBy("k", "part").collect()]
        assert got == want
    assert [sum(r[1:]) for r in loop_rows([60], 0, 60, 32, 8, 32, 32, 0, 0)][1] == 32


def test_scores(spark):
    v = F.array(*[F.lit(x) for x in (-2.3, -0.22, -2.3)])
    assert one(spark, scores.argmax(v)) == 1
    assert one(spark, scores.threshold_max(v, 1, 0.05)) == 0
    assert one(spark, scores.threshold_max(v, 1, 0.5)) == 1


def test_viterbi_takes_the_best_legal_path(spark):
    tags = ["B-X", "I-X", "O"]
    df = spark.createDataFrame([([[0.0, 1.0, 2.0], [0.0, 5.0, 0.0]],)], "s array<array<double>>")
    assert scores.viterbi(df, "s", "BIO", tags).first()["path"] == ["I-X", "I-X"]  # not O before I-X


def test_legal_transitions():
    for n, a, b, ok in (("BILOU", "START", "I-X", True), ("BILOU", "START", "L-X", True), ("BILOU", "B-X", "END", True), ("BIO", "START", "I-X", True), ("BIO", "START", "END", False), ("IOB1", "START", "END", False),
                        ("IOB1", "START", "B-X", False), ("IOB1", "B-X", "B-X", True), ("BMES", "START", "O", False), ("BMES", "B-X", "M-X", True), ("BMES", "O", "B-X", False), ("BIOUL", "L-X", "I-X", False),
                        ("BILOU", "B-X", "I-Y", False), ("BILOU", "O", "U-X", True), ("BIO", "O", "I-X", False), ("BIO", "START", "START", False), ("BIO", "END", "O", False)):
        assert scores.legal(n, a, b) == ok, (n, a, b)
    with pytest.raises(ValueError):
        scores.legal("IO", "O", "O")


def test_viterbi_is_enumeration(spark):
    rng = random.Random(10)
    for notation, tags in (("BIO", ["B-X", "B-Y", "I-X", "I-Y", "O"]), ("BILOU", ["B-X", "I-X", "L-X", "O", "U-X"])):
        w = [[rng.random() for _ in range(7)] for _ in range(7)]
        rows = [(i, [[rng.uniform(-2, 2) for _ in tags] for _ in range(rng.randint(0, 4))]) for i in range(12)]
        rows = [(i, m, [rng.choice((1, 1, -100)) for _ in m]) for i, m in rows]
        df = spark.createDataFrame(rows, "k int, s array<array<double>>, y array<int>")
        got = {r.k: r.path for r in scores.viterbi(df, "s", notation, tags, labels="y", weights=w, top_k=3).collect()}
        for k, m, y in rows:
            m = [v for v, i in zip(m, y) if i != -100]
            paths = []
            for p in itertools.product(range(len(tags)), repeat=len(m)) if m else []:
                ends = [5, *p, 6]
                names = ["START", *[tags[i] for i in p], "END"]
                if all(scores.legal(notation, a, b) for a, b in zip(names, names[1:])):
                    paths.append((sum(v[i] for v, i in zip(m, p)) + sum(w[a][b] for a, b in zip(ends, ends[1:])), names[1:-1]))
            want = sorted(paths, reverse=True)[:3]
            assert [x["path"] for x in got[k]] == [p for _, p in want]
            assert all(abs(x["score"] - v) < 1e-9 for x, (v, _) in zip(got[k], want))


def test_decoding_leaves_out_ignored_places(spark):
    df = spark.createDataFrame([([[0.0, 5.0, 0.0], [9.0, 0.0, 0.0], [0.0, 0.1, 0.2]], [1, -100, 2])], "predictions array<array<double>>, labels array<int>")
    tags = ["B-X", "I-X", "O"]
    for name, want in (("argmax", ["I-X", "O"]), ("threshold_max", ["I-X", "I-X"]), ("crf", ["I-X", "O"])):
        r = scores.decoded(df, name, tags, 0.3, "BIO").first()
        assert (r.predictions, r.labels) == (want, ["I-X", "O"]), name
    assert scores.decoded(df, "logits", tags).first().predictions == [[0.0, 5.0, 0.0], [0.0, 0.1, 0.2]]


def test_long_note_is_redacted_in_time(spark):
    """50,000 tokens in one note, and an entity every hundred."""
    import time

    from veilmark.plans.pipeline import deidentify

    text = " ".join(f"a.b{i}@c.example" if i % 100 == 0 else "word," for i in range(25_000))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    at = time.time()
    got = {r.doc_id: r.deid_text for r in deidentify(docs, ["doc_id"]).collect()}
    assert got[1].count("EMAIL") == 250 and "@" not in got[1] and got[3] == "" and time.time() - at < 60


def test_modes_forbidden_types_and_unequal_arrays(spark):
    toks = F.from_json(F.lit('[{"start":0,"end":2}]'), "array<struct<start:int,end:int>>")
    assert one(spark, default_tags(toks, "predict", "BIO")) == ["O"]
    with pytest.raises(ValueError):
        default_tags(toks, "else", "BIO")
    for bad in (checked(F.lit("B-OTHERISSUE")), zip_equal(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2)))):
        with pytest.raises(Exception, match="settled|different"):
            one(spark, bad)


def test_word_pieces_are_those_of_the_library(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from veilmark.operators.subwords import align, model_pieces

    path, tags = public.path("word_bpe_49k.json"), ["B-AGE", "B-DATE", "I-AGE", "I-DATE", "O"]
    rows = [(["Jan", "Doberman", "60", "years", "in", "20801", "\t"], ["NA", "NA", "B-AGE", "O", "O", "B-DATE", "O"]), ([], [])]
    df = spark.createDataFrame(rows, "tokens array<string>, labels array<string>")
    tok = Tokenizer.from_file(path)
    for label_all in (False, True):
        got = model_pieces(df, path).select(align(F.col("pieces"), F.col("labels"), tags, label_all).alias("a")).collect()
        want = [(None, None, -100)]
        for w, (t, y) in enumerate(zip(*rows[0])):
            for i, p in enumerate(tok.encode(t, add_special_tokens=False).tokens or [""]):
                first = -100 if y == "NA" else tags.index(y)
                want.append((p, w, first if i == 0 else -100 if not label_all or y == "NA" else tags.index("I" + y[1:] if y[0] == "B" else y)))
        assert [tuple(x) for x in got[0].a] == [*want, (None, None, -100)] and len(got[1].a) == 2


def test_recall_threshold(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, False), (0.7, True), (0.1, True)], "score double, truth boolean")
    r = scores.recall_threshold(df, 0.5).first()
    assert (r.threshold, round(r.precision, 6)) == (0.7, round(2 / 3, 6))
    assert scores.recall_threshold(df, 1.0).count() == 0


def test_tags_of_tokens_and_misaligned_spans(spark):
    toks = F.from_json(F.lit('[{"start":0,"end":2},{"start":3,"end":5},{"start":6,"end":8}]'), "array<struct<start:int,end:int>>")
    assert one(spark, tag_tokens(toks, span_array([(0, 5, "ID")]), "BILOU")) == ["B-ID", "L-ID", "O"]


def test_small_text_functions(spark):
    assert one(spark, squeeze(F.lit("a__________"))) == "a" + "_" * 8
    assert one(spark, squeeze(F.lit("1 1/2"))) == "1-1/2"
    assert one(spark, chunks(F.sequence(F.lit(1), F.lit(5)), 2)) == [[1, 2], [3, 4], [5]]


def test_greedy_split_gives_each_group_one_split():
    got = split.greedy([(f"g{i}", {"A": i % 3 + 1}) for i in range(30)], {"train": 70, "validation": 15, "test": 15}, 10)
    assert len(got) == 30 and set(got.values()) <= {"train", "validation", "test"}
    assert set(split.greedy([("a", {"A": 1}), ("b", {})], {"train": 100, "validation": 0, "test": 0}, 0).values()) == {"train"}


def test_word_list(spark, tmp_path):
    from veilmark.sources.notes import abbreviations

    (tmp_path / "w.txt").write_text("Dr.\n\n b.i.d. \nQD\n")
    assert abbreviations(spark, str(tmp_path / "w.txt")) == ["Dr.", "QD", "b.i.d.", "dr.", "qd"]


def test_archive_and_conll(spark, tmp_path):
    import io
    import tarfile

    from veilmark.sources.notes import load_archive, map_span_types

    xml = b'<r><TEXT>Al 40</TEXT><TAGS><NAME id="P0" start="0" end="2" text="Al" TYPE="PATIENT"/><X start="3" end="5" TYPE="OTHER"/></TAGS></r>'
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        info = tarfile.TarInfo("d/110-01.xml")
        info.size = len(xml)
        t.addfile(info, io.BytesIO(xml))
    row = map_span_types(load_archive(spark, str(tmp_path / "a.tar")), {"PATIENT": "PATIENT"}).first()
    assert (row.text, row.meta.note_id, [tuple(s) for s in row.spans]) == ("Al 40", "110-01", [(0, 2, "PATIENT")])


def test_tagger_and_command_line(spark, tmp_path):
    import json

    from veilmark.plans.run import main
    from veilmark.plans.tagger import Tagger
    from veilmark.sources.notes import NOTE, RunConfig, load_json

    notes = [("n1", "Call 123456789 now. Or not.", [(5, 14, "ID")]), ("n2", "Nothing here", []), ("n3", "", []), ("n4", "Id 999999999, 10.0.0.1 too", [(3, 12, "ID"), (14, 22, "ID")])]
    (tmp_path / "notes.jsonl").write_text("".join(json.dumps({"text": t, "meta": {"note_id": n, "patient_id": "p"}, "spans": [dict(zip(("start", "end", "label"), s)) for s in sp]}) + "\n" for n, t, sp in notes))
    (tmp_path / "s.json").write_text(json.dumps({"notation": "BIO", "ner_types": ["EMAIL", "ID", "PHONE"], "max_prev_sentence_token": 4, "learning_rate": 1}))
    config, ignored = RunConfig.read(str(tmp_path / "s.json"))
    assert config.max_prev == 4 and ignored == ["learning_rate"]
    with pytest.raises(ValueError, match="learning_rate"):
        RunConfig.load(str(tmp_path / "s.json"))
    for what in ("redact", "tag", "evaluate"):
        main([what, str(tmp_path / "s.json"), str(tmp_path / "notes.jsonl"), str(tmp_path / what)], spark)
    out = {r.note_id: r.deid_text for r in spark.read.json(str(tmp_path / "redact")).collect()}
    assert out == {"n1": "Call ID now. Or not.", "n2": "Nothing here", "n4": "Id ID too"}  # a comma between two of one type is taken in
    tags = {r.note_id: r.predictions for r in spark.read.json(str(tmp_path / "tag")).collect()}
    assert tags["n1"] == ["O", "B-ID", "O", "O", "O", "O", "O"] and tags["n4"][1] == "B-ID"
    m = json.loads(spark.read.text(str(tmp_path / "evaluate")).first()[0])
    assert abs(m["ID_recall"] - 2 / 3) < 1e-9 and m["violations_count"] == 0  # the address is seven tokens, none of which a rule takes on its own
    tagger = Tagger(config).load({"test": load_json(spark, str(tmp_path / "notes.jsonl"), NOTE).select("meta.note_id", "text", "spans")})
    with pytest.raises(ValueError):
        tagger.predict()
    with pytest.raises(ValueError):
        tagger.set_predict("none")
    assert tagger.set_predict(limit=2).predict().count() == 2 and tagger.set_train("test").train_rows().count() == 4
    crf = RunConfig(notation="BIO", ner_types=["ID"], post_process="crf")
    assert Tagger(crf).load({"test": tagger._splits["test"]}).set_predict().predict().count() == 3
