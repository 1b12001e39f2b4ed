"""The field over word shapes: its gradient and likelihood against all labellings, and hard words of both kinds."""

import itertools
import random
import string

import numpy as np
import pytest
from test_llm import docs, text

from sigrel.llm import secrets


def test_training_is_that_of_the_whole_likelihood():
    rng = random.Random(2)
    parts = []
    for _ in range(12):
        n = rng.randrange(1, 5)
        tags, before = [], 0
        for _ in range(n):
            before = rng.choice((0, 0, 1, 2) if before else (0, 1))
            tags.append(before)
        parts.append(([rng.getrandbits(len(secrets.BITS)) for _ in range(n)], tags, [float(rng.random() < 0.5), 0.0]))
    parts += parts[:3]

    def likelihood(crf):
        tables, total = crf.tables().astype(float), 0.0
        for shapes, tags, f in parts:
            def score(labels):
                s = crf.first[labels[0]]
                for i, c in enumerate(labels):
                    near = [shapes[i], *(shapes[j] if 0 <= j < len(shapes) else None for j in (i - 1, i - 2, i + 1))]
                    s += sum(tables[k][w][c] for k, w in enumerate(near) if w is not None) + np.array(f) @ crf.file[:, c]
                    s += crf.moves[labels[i - 1], c] if i else 0
                return s

            total += score(tags) - np.log(sum(np.exp(score(x)) for x in itertools.product(range(3), repeat=len(shapes))))
        return total / len(parts)

    values = [likelihood(secrets.train(parts, steps=s)) for s in (0, 5, 30, 120)]
    assert values[0] < values[1] < values[2] <= values[3] + 1e-3 and values[3] > 0.4 * values[0]


def test_plain_words_have_the_shape_of_the_long_way():
    for w in ("word", "mypassword", "tokens", "auth", "capital", "a" * 8, "b" * 16, "c" * 32, "secret" * 6):
        plain, quoted = secrets.shape(w.encode()), secrets.shape(b"`" + w.encode())
        # a quote in front leaves the core as it is: only its own bit, and 32 characters with the quote, differ
        assert plain == quoted & ~(1 << 12) or len(w) == 31, w


def test_hard_words_of_both_kinds(spark):
    rng = random.Random(31)
    token = lambda n, a=string.ascii_letters + string.digits: "".join(rng.choice(a) for _ in range(n))
    hexes = lambda: "-".join(token(k, "0123456789abcdef") for k in (8, 4, 4, 4, 12))
    word = lambda: rng.choice(("report", "summer", "invoice", "holiday", "window", "station", "kitchen", "budget"))
    held = (lambda: "ghp_" + token(36), lambda: "password is " + token(12), lambda: "client_secret_id " + hexes(), lambda: f"postgres://admin:{token(14)}@db.example.com/main", lambda: token(40), lambda: "SG." + token(22) + "." + token(43))
    mild = (
        lambda: f"IMG_2021{rng.randrange(10, 13)}04_{token(6, string.digits)}.jpg", lambda: word() + word().capitalize() + word().capitalize(), lambda: f"https://{word()}.example.com/{word()}?ref={token(6)}&page={rng.randrange(99)}",
        lambda: f"2021-0{rng.randrange(1, 9)}-1{rng.randrange(9)}T1{rng.randrange(9)}:3{rng.randrange(9)}:20Z", lambda: f"{word()}.{word()}{rng.randrange(99)}@{word()}.org", lambda: f"192.168.{rng.randrange(256)}.{rng.randrange(256)}",
        lambda: f"192.168.{rng.randrange(256)}.{rng.randrange(256)}***", lambda: f"/usr/{word()}/{word()}_{rng.randrange(99)}/{word()}.conf", lambda: f"{word().upper()}_{word().upper()}_{rng.randrange(99)}", lambda: "your password is required",
    )
    texts, where = [], {}
    for i in range(900):
        w = text(rng, 60).split()
        at = rng.randrange(60)
        if i < 240:
            x = held[i % len(held)]()
        elif i < 640:
            x = mild[i % len(mild)]()
        else:
            x = f"password: {token(14)}"
        a = len(" ".join(w[:at])) + (at > 0)
        where[i] = (a, a + len(x))
        texts.append(" ".join([*w[:at], x, *w[at:]]))
    got = {r["doc_id"]: [s for s in r["spans"] if s["start"] < where[r["doc_id"]][1] and s["end"] > where[r["doc_id"]][0]] for r in secrets.find_secrets(docs(spark, texts)).collect()}
    missed = [texts[i][where[i][0] : where[i][1]] for i in range(240) if not got[i]]
    assert len(missed) <= 0.1 * 240, missed
    wrong = [texts[i][where[i][0] : where[i][1]] for i in range(240, 640) if got[i]]
    assert len(wrong) <= 0.05 * 400, wrong
    assert not [x for x in wrong if x.startswith("192.") or "@" in x]
    assert all(got[i] for i in range(640, 900))


def test_without_examples_nothing_is_added(spark):
    assert secrets.find_secrets(docs(spark, [])).count() == 0
    got = secrets.find_secrets(docs(spark, [None, "", "one " + "ab12" * 8])).orderBy("doc_id").collect()
    assert [len([s for s in r["spans"] if s["kind"] != "model"]) for r in got] == [0, 0, 1]
    assert secrets.train([]).weights[-1, 0, secrets.OUTSIDE] == pytest.approx(10.0)
