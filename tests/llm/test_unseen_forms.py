"""Secrets of forms not trained on, subword toxicity, licences, languages, sieves, and clashing columns, with exact values."""

import random
import re
import string

import numpy as np
from pyspark.sql import functions as F
from test_llm import DOCS, brute_groups, docs, text

from sigrel.llm import language, license_scan, line_dedup, secrets, toxicity
from sigrel.llm.common import Tables, sieve, sifted
from sigrel.llm.jaccard_join import jaccard_groups
from sigrel.llm.quality import quality_rules


def test_sieve_passes_every_member(spark):
    members = Tables(spark).put(spark.range(0, 5000, 7).withColumnRenamed("id", "key"))
    got = sifted(spark.range(5000), F.col("id"), sieve(members, "key")).select("id", "_may").collect()
    may = {r["id"] for r in got if r["_may"]}
    assert set(range(0, 5000, 7)) <= may and len(got) == 5000 and len(may) < 1300
    none = sifted(spark.range(50), F.col("id"), sieve(members.where("key < 0"), "key"))
    assert none.where("_may").count() == 0 and none.count() == 50


def test_secrets_of_forms_not_trained_on(spark):
    rng = random.Random(77)
    token = lambda n, a=string.ascii_letters + string.digits: "".join(rng.choice(a) for _ in range(n))
    held = [lambda: "ghp_" + token(36), lambda: "glpat-" + token(20), lambda: "sk_live_" + token(24), lambda: "npm_" + token(36), lambda: "AIza" + token(35), lambda: "eyJ" + token(30) + "." + token(60) + "." + token(43), lambda: "hf_" + token(34), lambda: "-----BEGIN PRIVATE KEY----- " + token(64, string.ascii_letters + string.digits + "/+")]
    texts, wanted = [], {}
    for i in range(600):
        w = text(rng, 60).split()
        if i < 160:
            secret = held[i % len(held)]()
            wanted[i] = secret.split()[-1]
            w.insert(rng.randrange(61), secret)
        elif i < 300:
            w.insert(rng.randrange(61), rng.choice((f"{rng.randrange(10**9)}", f"20{rng.randrange(10, 99)}-03-1{rng.randrange(9)}", "foo.bar@example.org", "https://example.org/a/b?id=77")))
        elif i < 400:
            w.insert(rng.randrange(61), f"password: {token(14)}")
        texts.append(" ".join(w))
    d = docs(spark, texts)
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(d).collect()}
    found = sum(any(wanted[i] in texts[i][s["start"] : s["end"]] for s in got[i]) for i in wanted)
    wrong = sum(s["kind"] == "model" for i in range(160, 600) for s in got[i])
    assert found >= 0.9 * len(wanted) and wrong <= 5
    # the fixed patterns, row by row
    for i, t in enumerate(texts):
        base = [(m.start(), m.end(), "assign") for m in secrets.ASSIGN.finditer(t) if len(m[2]) >= 8] + [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert sorted(base) == sorted((s["start"], s["end"], s["kind"]) for s in got[i] if s["kind"] != "model")


def test_toxicity_learns_stems(spark):
    rng = random.Random(5)
    stems = ("blorgf", "snarkel")
    texts, labels = [], []
    for i in range(500):
        w = text(rng, 50).split()
        if i % 5 == 0:
            for _ in range(3):
                w[rng.randrange(50)] = rng.choice(stems) + rng.choice(("ish", "er", "ly", "ing", "um", "ax"))
        texts.append(" ".join(w))
        labels.append((i, 0, int(i % 5 == 0)))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(spark, texts), known, learn=F.col("doc_id") < 400)
    assert (np.abs(model.word_logits()) > 0).sum() > 500
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs(spark, texts), model).collect()}
    assert sum(got[i] == labels[i][2] for i in range(400, 500)) >= 97
    # endings that were never seen
    for clean, bad in (("kar lost mik", "kar blorgfett mik"), ("pik ters", "pik snarkeloo")):
        s = [r["score"] for r in toxicity.score_toxicity(docs(spark, [clean, bad]), model).orderBy("doc_id").collect()]
        assert s[1] > s[0] + 0.2
    one = toxicity.fit(docs(spark, ["a", "b", "b"], ids=[1, 2, 2]), spark.createDataFrame([(2, 0, 1)], "doc_id long, quality int, toxic int"))
    assert len({r["score"] for r in toxicity.score_toxicity(docs(spark, ["x", None, ""]), one).collect()}) == 1


def test_license_table(spark):
    for name in license_scan.RULES:
        for rule in license_scan.RULES[name]:
            assert all(k in license_scan.SENTENCES for k in rule.replace("|", " ").split())
    assert all(re.search(license_scan._HINT, s) for s in [*license_scan.SENTENCES.values(), *license_scan.notices()])
    texts, want = [], []
    for name, rules in license_scan.RULES.items():
        texts.append("Intro of ours.\n" + ". ".join(license_scan.SENTENCES[k].capitalize() for k in rules[0].split("|")[0].split()) + ".\nMore.")
        want.append(name)
    n = len(texts)
    texts += ["This file is licensed under the MIT license.", "// SPDX-License-Identifier: BSD-3-Clause", "Released under CC BY-SA 4.0!", "we permit nothing", None]
    want += ["MIT", "BSD-3-Clause", "CC-BY-SA-4.0"]
    d = docs(spark, texts).withColumn("_found", F.lit(5))
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(d).collect()}
    hit = [want[i] in got[i]["licenses"] for i in range(len(want))]
    assert all(hit), [want[i] for i in range(len(want)) if not hit[i]]
    assert len(got[n]["licenses"]) == 1 and got[n + 3]["licenses"] == [] == got[n + 4]["licenses"] and got[0]["_found"] == 5
    assert "BSD-2-Clause" not in got[want.index("BSD-3-Clause")]["licenses"]


def test_language_without_rows_and_letters(spark):
    none = language.fit(docs(spark, []))
    got = language.identify(docs(spark, ["hello", None]), none).orderBy("doc_id").collect()
    assert [(r["language"]["nearest"], r["language"]["score"]) for r in got] == [("und", 0.0)] * 2
    rng = random.Random(8)
    kinds = {f"l{k}": ["".join(rng.choice(string.ascii_lowercase) for _ in range(3)) for _ in range(6)] for k in range(30)}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(2)) for _ in range(60)), k, "s", 0) for i, k in enumerate(list(kinds) * 12)]
    rows += [(0, "other text of the id", "l0", "s", 0), (0, "other text of the id", "l0", "s", 0)]
    d = spark.createDataFrame(rows, DOCS)
    model = language.fit(d, sample_rows=10, sample_total=240)
    assert len(model.langs) == 30
    again = language.fit(d.repartition(7), sample_rows=10, sample_total=240)
    assert np.array_equal(model.centroids, again.centroids)
    got = {r["doc_id"]: r["language"] for r in language.identify(d.where("doc_id > 0"), model).collect()}
    assert sum(got[i]["nearest"] == k for i, _, k, _, _ in rows[1:360]) >= 350
    odd = language.identify(docs(spark, ["² ½ ③ Ⅷ", "123 _ !", "ª"]), model).orderBy("doc_id").collect()
    assert [r["language"]["nearest"] == "und" for r in odd] == [True, True, False]


def test_groups_among_many_copies(spark):
    rng = random.Random(12)
    base = text(rng, 150)
    texts = [base] * 60
    for k in range(40):  # near copies in a chain around one text
        w = base.split()
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(150)] = rng.choice(("zz", "yy", "xx")) + str(k)
        texts.append(" ".join(w))
    shared = text(rng, 60)
    texts += [text(rng, 70) + " " + shared for _ in range(30)] + [text(rng, 90) for _ in range(10)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[k]) for i, k in enumerate(order)]
    for n, percent in ((3, 90), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_groups(docs(spark, [t for _, t in rows]), n, percent).collect()}
        assert got == brute_groups(rows, n, percent)


def test_line_dedup_copies_and_clashing_columns(spark):
    rng = random.Random(3)
    long, short = "\n".join(text(rng, 12) for _ in range(5)), text(rng, 9)
    d = docs(spark, [long, long, short, short, None, "", long + "\n" + text(rng, 5)], ids=[5, 2, 1, 3, 4, 6, 7])
    for c in ("_doc", "_row", "_runs", "_rl", "_rw", "_lines", "_may", "row", "it", "runs", "n_lines"):
        d = d.withColumn(c, F.lit(7))
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(d).collect()}
    assert got[2]["text"] == long and got[5]["text"] == "" and (got[5]["removed_lines"], got[5]["removed_words"]) == (5, 60)
    assert got[1]["text"] == got[3]["text"] == short and got[4]["text"] is None and got[6]["text"] == ""
    assert got[7]["removed_lines"] == 5 and got[7]["n_lines"] == 6 and got[7]["text"] == (long + "\n" + "x").split("\n")[-1].replace("x", got[7]["text"])
    assert all(got[i][c] == 7 for i in got for c in ("_doc", "_row", "_runs", "_rl", "_may", "row", "it", "runs"))


def test_quality_of_rows_without_id(spark):
    d = docs(spark, [text(random.Random(1), 80), None, ""], ids=[None, 2, 3])
    got = {r["doc_id"]: r for r in quality_rules(d).collect()}
    assert got[None]["n_words"] == 80 and got[2]["n_words"] == 0 and got[3]["base_failed"]
