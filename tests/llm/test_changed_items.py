"""Benchmark items with one word changed are still met; a question without its answer isn't."""

import random

from larkspur.llm import decontam


def test_one_changed_word_is_met(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 7))) for _ in range(600)]
    noise = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, noise(q), noise(a)) for k, (q, a) in enumerate([(6, 5), (12, 8), (23, 5), (30, 6), (9, 20), (40, 3), (40, 2), (18, 23), (60, 30)])]
    docs, want = [], set()
    for k, q, a in items:
        for side, part in enumerate((q, a)):
            for at in range(len(part)):
                changed = [list(q), list(a)]
                changed[side][at] = "zzchanged"
                want.add((len(docs), k))
                docs.append((len(docs), " ".join([*noise(30), *changed[0], ". ", *changed[1], *noise(30)])))
    docs += [(10_000 + k, " ".join([*noise(50), *q, *noise(50)])) for k, q, a in items if len(a) > 3]
    benchmark = spark.createDataFrame([(k, " ".join(q) + ". " + " ".join(a) + ".") for k, q, a in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}
    assert want - got == set()
    assert got - want == set()


def test_words_in_order():
    part = b"a b c d e f g h".split()
    assert decontam.in_order(part, b"x a b c z e f g h x".split()) == 7 / 8
    assert decontam.in_order(part, b"h g f e d c b a".split()) == 1 / 8
    assert decontam.in_order(part, b"a x x x b x x x c x x x d x x x e x x x f".split()) == 3 / 8


def test_two_changed_words_are_met_at_every_length(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 7))) for _ in range(900)]
    noise = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(n, noise(n), noise(9)) for n in range(20, 41)]
    docs = []
    for n, q, a in items:
        changed = list(q)
        changed[n // 3] = changed[2 * n // 3] = "zzchanged"
        docs.append((n, " ".join([*noise(40), *changed, ". ", *a, *noise(40)])))
        docs.append((100 + n, " ".join([*noise(40), *q[: n // 2], *noise(n // 2), ". ", *a, *noise(40)])))
    benchmark = spark.createDataFrame([(n, " ".join(q) + ". " + " ".join(a) + ".") for n, q, a in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}
    assert got == {(n, n) for n, _, _ in items}
