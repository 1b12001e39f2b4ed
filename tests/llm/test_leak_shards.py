"""One latent space for the whole benchmark: shards change no result, and reworded items are found."""

import random

from test_llm import docs

from sigrel.llm import decontaminate

SYLLABLES = ("ka", "lo", "mi", "ru", "te", "su", "po", "ne")
WORDS = [a + b + c for a in SYLLABLES for b in ("rn", "st", "lm", "pk") for c in SYLLABLES]


def planted(replaced: int):
    """40 items, a text for each of them with one word in ``replaced`` (but in the last 8) replaced, and 60 clean texts."""
    rng = random.Random(31)
    make = lambda n: [rng.choice(WORDS) for _ in range(n)]
    items = [make(rng.randrange(24, 60)) for _ in range(40)]
    texts = []
    for w in items:
        w = [rng.choice(WORDS) if i % replaced == 0 and i < len(w) - 8 else x for i, x in enumerate(w)]
        head = make(rng.randrange(20, 200))
        texts.append(" ".join(head + w + make(100)))
    return items, texts, [" ".join(make(250)) for _ in range(60)]


def test_shards_change_nothing(spark):
    for replaced in (3, 4):
        items, texts, clean = planted(replaced)
        bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
        table = docs(spark, texts + clean)
        ask = lambda words: {r["doc_id"]: r["leaked_items"] for r in decontaminate.find_leaks(table, bench, shard_words=words).collect()}
        whole = ask(1_000_000)
        assert ask(330) == whole == ask(1_000)
        held = [i for i in range(40) if i in whole[i]]
        assert len(held) >= 36
        assert all(whole[i] == [] for i in range(40, 100))


def test_shards_hold_every_piece_once():
    pieces = [(i, [b"w"] * n, []) for i, n in enumerate([5, 80, 3, 3, 40, 1])]
    for most in (1, 6, 50, 1_000):
        parts = list(decontaminate.shards_of(pieces, most))
        assert sum(parts, []) == pieces
        assert all(len(p) == 1 or sum(len(w) for _, w, _ in p) <= most for p in parts)


def test_lots_keep_the_order():
    texts = ["a" * n for n in (5, 0, 900, 3, 3)] + [None, "b"]
    for most in (1, 6, 10_000):
        assert sum(decontaminate._lots(texts, most), []) == texts
