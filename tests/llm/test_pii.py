"""Disclosing terms against brute force over a small corpus."""

import math
import random
import re


def corpus():
    rng = random.Random(11)
    words = ["alder", "birch", "cedar", "Dogwood", "elm", "fir", "ginkgo", "hazel", "ivy", "juniper", "l'orme", "Ünder"]
    people = [("ann.lee@x.example.org", ["Annlee", "keeper"]), ("10.1.2.3", ["server-room"]), ("4539 5787 6362 1486", ["Visaholder"]), ("+1 (504) 555-2652", ["Bobson"])]
    texts = []
    for i in range(60):
        t = [rng.choice(words) for _ in range(rng.randint(3, 12))]
        if i % 3 == 0:
            value, names = people[i // 3 % 4]
            t.insert(rng.randrange(len(t)), value)
            if rng.random() < 0.9:
                t.insert(rng.randrange(len(t)), rng.choice(names))
        if i % 17 == 0:
            t.append("keeper")
        texts.append(" ".join(t))
    copied = "one text only: c.d@e.example.org and Copiedname"
    return [*texts, copied, copied, copied, None, "", "keeper\nAnnlee, Bobson."]


def brute(texts):
    from veilmark.llm import pii

    texts = [t or "" for t in texts]
    letters = re.compile(r"[^\W\d_]+")
    found = []
    for t in texts:
        own = []
        for rank, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+){3}", r"[0-9](?:[ -]?[0-9])+", r"\+[0-9][ ().0-9-]+[0-9]")):
            for m in re.finditer(p, t):
                digits = re.sub(r"\D", "", m[0])
                luhn = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0
                if rank == 0 or (rank == 1 and all(int(x) < 256 for x in m[0].split("."))) or (rank == 2 and 12 <= len(digits) <= 19 and luhn) or (rank == 3 and 9 <= len(digits) <= 15):
                    own.append((m.start(), rank, m.end(), m[0]))
        found.append(own)
    terms = [{m[0].lower() for m in letters.finditer(t)} for t in texts]
    share = {}
    for e in {(r, v) for f in found for _, r, _, v in f}:
        has = [i for i, f in enumerate(found) if any((r, v) == e for _, r, _, v in f)]
        for w in {w for i in has for w in terms[i]}:
            both = [i for i in has if w in terms[i]]
            m = len({texts[i] for i in both})
            if m > 1:
                ic = math.log2(len(texts) / len(has))
                s = math.log2(len(both) * len(texts) / (sum(w in x for x in terms) * len(has))) / ic * (1 - 4 ** (1 - m))
                share[w] = max(share.get(w, s), s)
    flagged = {w for w, s in share.items() if s >= pii.GENERALISE}
    out = []
    for t, f in zip(texts, found):
        spans = [(s, r, e) for s, r, e, _ in f]
        spans += [(m.start(), 4, m.end()) for m in letters.finditer(t) if m[0].lower() in flagged and not any(s < m.end() and m.start() < e for s, _, e, _ in f)]
        out.append(",".join(f"{pii.KINDS[r]}:{s}:{e}" for s, r, e in sorted(spans)))
    return out, flagged, {w for w, s in share.items() if s >= pii.DISCLOSE}


def test_terms_are_those_of_brute_force(spark):
    from veilmark.llm.pii import report, sanitise

    texts = corpus()
    want, flagged, removed = brute(texts)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, term int, hash string")
    got = {r.doc_id: r.spans for r in report(docs).collect()}
    assert got == dict(enumerate(want))
    assert {"annlee", "bobson"} <= flagged and "copiedname" not in flagged and "elm" not in flagged
    clean = {r.doc_id: r.text for r in sanitise(docs).collect()}
    last = clean[len(texts) - 1].lower()
    assert all((w in last) != (w in removed) for w in ("annlee", "bobson") if w in flagged and w in removed)
    assert not any(re.search(rf"\b{w}\b", x.lower()) for w in removed for x in clean.values())
