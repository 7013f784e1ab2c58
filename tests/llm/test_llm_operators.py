"""The ten operators on small hand-made rows: against brute force, the libraries, round trips, and odd rows."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from larkspur.llm import ann, bpe, decontam, langid, lines, neardup, pii, tokencount, toxicity, warc

SF = "/root/testdata/sf0.001"
ODD = [(9_000_001, None), (9_000_002, ""), (9_000_003, " \n\t"), (9_000_004, "x" * 60_000), (9_000_005, "a b c d e " * 4000), (9_000_006, "same\nsame"), (9_000_006, "same\nsame"), (None, "no id at all, but words enough for one shingle")]


@pytest.fixture(scope="module")
def docs(spark):
    """The smallest table and odd rows, with columns whose names clash with others used inside."""
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    both = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd)
    return both.withColumn("lang", F.lit("xx")).withColumn("h", F.lit(1)).withColumn("pii", F.lit(2)).withColumn("key", F.lit(3)).withColumn("n", F.lit(4)).cache()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


# --- language


def test_language(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    with_odd = table.unionByName(spark.createDataFrame([(i, t) for i, t in ODD], "doc_id long, text string"), allowMissingColumns=True)
    rows = langid.predict_languages(with_odd).collect()
    truth = {r.doc_id: r.lang for r in table.select("doc_id", "lang").collect()}
    out = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == with_odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows if r.doc_id is not None)
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.97 * len(out)
    assert {r.lang_pred for r in rows if r.doc_id in (9_000_001, 9_000_002, 9_000_003)} == {"und"}
    assert {r.lang_pred for r in langid.predict_languages(spark.createDataFrame([(1, "word", None)], "doc_id long, text string, lang string")).collect()} == {"und"}
    assert langid.predict_languages(empty(spark)).count() == 0


def test_windows_cover_every_ngram():
    for n in (0, 1, 127, 128, 129, 253, 1000):
        data = bytes(random.Random(n).randrange(1, 256) for _ in range(n))
        got = b"|".join(w.tobytes() for w in langid.windows(data))
        assert all(data[i : i + 4] in got for i in range(max(0, n - 3)))


# --- personal data


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(d[0::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def test_pii_equals_brute_force(spark, docs):
    rng = random.Random(8)
    noisy = [(8_000_000 + i, "".join(rng.choice(["4111 1111 1111 1111", "+1 (555) 010-", "9", " ", "-", ".", "a@b.c", "_d@e.f", "1.2.3.4", "256", "é", "😀", "7-7"]) for _ in range(40))) for i in range(300)]
    all_docs = docs.select("doc_id", "text").where("doc_id <> 9000004").unionByName(spark.createDataFrame([*noisy, (8_500_000, "x@y.zz " * 3000)], "doc_id long, text string"))
    got = by_id(pii.pii_digest(all_docs))
    for doc_id, text in {(r.doc_id, r.text) for r in all_docs.collect()}:
        spans = sorted((m.start(), o, f"{k}:{m.start()}:{m.end()}") for o, (k, p, ok) in enumerate(BASE) for m in re.finditer(p, text or "") if ok(m[0]))
        assert got[doc_id].base_sha256 == hashlib.sha256(",".join(s for *_, s in spans).encode()).hexdigest(), doc_id
        assert [got[doc_id][f"n_{k}"] for k, *_ in BASE] == [sum(o == i for _, o, _ in spans) for i in range(4)]


def test_pii_checks_and_context(spark):
    rows = spark.createDataFrame([(1, "IBAN GB82 WEST 1234 5698 7654 32."), (2, "GB82 WEST 1234 5698 7654 33"), (3, "ssn 123-45-6789"), (4, "123-45-6789"), (5, "9" * 50_000)], "doc_id long, text string")
    got = by_id(pii.pii_digest(rows))
    assert [got[i].spans for i in range(1, 6)] == ["iban:5:32", "", "ssn:4:15", "", ""]
    assert pii.pii_digest(empty(spark)).count() == 0


# --- BPE and token counts


TEXTS = [None, "", "  ", "a<|endoftext|>b <|startoftext|>", "Hello world's don't I'll 1234 ½ Ⅷ é é İI ſ ﬁ 日本語 😀👍 \u0000 x\u0085y", "ß" * 300, "ab" * 3000, "ΑΣ ΌΣΟΣ", "<s> <0x0A> ▁x", " a\n b\n\n", "\t\tif x:\r\n"]


def all_texts(spark):
    rng = random.Random(3)
    wild = ["".join(chr(rng.choice([rng.randrange(32, 127), 32, 10, rng.randrange(0x80, 0x2000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(120)) for _ in range(100)]
    return [*TEXTS, *wild, *(r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect())]


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, texts = Tokenizer.from_file(path), all_texts(spark)
    got = by_id(bpe.encode_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path))
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_speculation_is_verified():
    t = bpe.WordBpe(bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    rng = random.Random(1)
    for _ in range(300):
        word = "".join(rng.choice("etaoinshrdlu'") for _ in range(rng.randrange(1, 60)))
        assert t.merged([*word[:-1], word[-1] + t.end]) == t.merged_short([*word[:-1], word[-1] + t.end])


def test_token_counts_equal_library(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = Tokenizer(models.Unigram(tokencount.read_pieces(path), unk_id=0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    texts = all_texts(spark)
    got = by_id(tokencount.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path))
    assert [got[i].n_tokens for i in range(len(texts))] == [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


# --- nearest neighbours


def test_neighbours(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    one = [float(x) for x in rows.first().embedding]
    odd = [(10**6 + i, one) for i in range(60)] + [(2 * 10**6, None), (2 * 10**6 + 20, [0.0] * 64), (None, [1.0] * 64), (2 * 10**6 + 40, [float("nan")] * 64), (2 * 10**6 + 60, [1.0, None] + [0.5] * 62), (2 * 10**6 + 80, [1.0, 2.0])]
    rows = rows.unionByName(spark.createDataFrame(odd, "vec_id long, embedding array<float>"))
    got = {}
    for r in ann.search(rows).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    kept = [(r.vec_id, np.array(r.embedding, float)) for r in rows.collect() if r.vec_id is not None and r.embedding and len(r.embedding) == 64 and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    ids, x = np.array([i for i, _ in kept]), np.stack([v for _, v in kept])
    found = wanted = 0
    asked = [k for k in range(len(ids)) if ids[k] % 20 == 0]
    assert got.keys() == {int(ids[k]) for k in asked}
    for k in asked:
        score = x @ x[k]
        best = [ids[j] for j in np.lexsort((ids, -score)) if j != k][:20]
        mine = got[ids[k]]
        assert len(mine) == 20 and mine == sorted(mine, key=lambda m: (-m[1], m[0]))
        assert all(abs(score[np.flatnonzero(ids == i)[0]] - s) < 1e-9 for i, s in mine)
        found, wanted = found + len({i for i, _ in mine} & set(best)), wanted + 20
    assert found >= 0.9 * wanted
    few = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.search(few).orderBy("rank").collect()] == [(20, 1, 2, 2.0), (20, 2, 1, 0.5)]
    assert ann.search(few.limit(0)).count() == 0


# --- near duplicates


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            both = len(x & y)
            if both and 100 * both >= 75 * (len(x) + len(y) - both):
                p, q = find(ids[a]), find(ids[b])
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark, docs):
    rng = random.Random(5)
    base = [rng.choice(["ab", "cd", "the", "of", f"x{i}"]) for i in range(300)]
    copies = []
    for i in range(80):
        b = list(base)
        for _ in range(rng.choice([2, 5, 9, 12])):
            b[rng.randrange(300)] = f"q{rng.randrange(10**6)}"
        copies.append((7_000_000 + i, " ".join(b)))
    rows = docs.select("doc_id", "text", "key", "n").unionByName(spark.createDataFrame([*copies, (7_100_000, "A  b"), (7_100_001, "a b"), (7_100_002, "a b c d e f")], "doc_id long, text string"), allowMissingColumns=True)
    got = neardup.near_duplicates(rows).collect()
    want = brute_components([(r.doc_id, r.text) for r in rows.collect() if r.doc_id is not None])
    assert len(got) == rows.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_registers_merge_by_maximum():
    a, b = neardup.shingles("one two three four five six seven"), neardup.shingles("five six seven eight nine ten eleven")
    ra, rb = neardup.registers([a, b])
    assert (np.maximum(ra, rb) == neardup.registers([np.union1d(a, b)])[0]).all()


# --- toxicity


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    rows = toxicity.score_documents(documents.unionByName(odd, allowMissingColumns=True), labels).collect()
    assert len(rows) == documents.count() + len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    bad, good = [r.score for r in held if truth[r.doc_id]], [r.score for r in held if not truth[r.doc_id]]
    assert np.mean([b > g for b in bad for g in good]) >= 0.9
    assert {r.score for r in toxicity.score_documents(documents.limit(3), labels.limit(0)).collect()} == {0.0}


def test_misspellings_share_vectors():
    rng = random.Random(2)
    plain = ["the", "house", "green", "walks", "slowly", "river", "stone", "under"]
    texts = [" ".join(rng.choice(plain) for _ in range(30)) + (" worthless" if i % 2 else "") for i in range(300)]
    model = toxicity.train(texts, np.array([i % 2 for i in range(300)]))
    assert model.score("the river worthles stone") > 0.5 > model.score("the river under stone")


# --- WARC


def test_warc_equals_sql(spark):
    odd = [(9001, "u", "x" * 2000), (9002, None, "x" * 2000), (9002, None, "x" * 2000), (None, "u", "x" * 2000), (9003, "u", None), (9004, "u", ""), (9005, "u", "y"), (9006, "u", "y"), (None, "u", "z" * 1500), (None, "u", "z" * 1500), (9007, "a\r\nb", "é\r\n\r\n" * 600)]
    pages = spark.read.parquet(f"{SF}/pages.parquet").unionByName(spark.createDataFrame(odd, "page_id long, url string, html string")).withColumn("digest", F.lit(0)).withColumn("path", F.lit(1))
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "html").toArrow())
    got = warc.archive_and_read(pages)
    assert sorted(map(repr, map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))) == sorted(map(repr, con.sql(warc.ORACLE).fetchall()))
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_warc_selected_records_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i} é</p>" * (i % 7)) for i in range(200)], "page_id long, url string, html string")
    index = warc.write_archives(pages, f"file://{tmp_path}")
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_records(index.where("page_id % 3 = 0")).collect()}
    assert got == {i: f"<p>{i} é</p>" * (i % 7) for i in range(0, 200, 3)}
    with pytest.raises(ValueError, match="digest"):
        warc.parse(warc.record(1, "u", b"abc", "0" * 40, None))


# --- lines


def within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def test_lines_equal_brute_force(spark):
    rng, rows = random.Random(1), []
    for i in range(120):
        b = "".join(rng.choice("ab é") for _ in range(rng.choice([5, 15, 16, 17, 255, 256, 257, 258, 513, 600])))
        many = [b]
        for _ in range(4):
            x = list(b)
            p, op = rng.choice([0, len(x) - 1, rng.randrange(len(x)), min(256, len(x) - 1)]), rng.random()
            if op < 0.4:
                x[p] = rng.choice("abé")
            elif op < 0.7:
                del x[p]
            else:
                x.insert(p, "a")
            many.append("".join(x))
        rng.shuffle(many)
        rows.append((i, "\n".join(many)))
    rows += [(500, None), (501, ""), (502, "\n \n"), (503, "short"), (504, "shorr"), (505, "short"), (506, "a\nb\nab\nba\nabc"), (507, "w" * 4_000), (508, "w" * 3_999 + "v"), (509, "x" + "w" * 4_000)]
    all_lines = [((d, n), x.strip(" ")) for d, t in rows for n, x in enumerate((t or "").split("\n")) if x.strip(" ")]
    want = []
    for k, (at, x) in enumerate(all_lines):
        partner = next((a for a, y in all_lines[:k] if x == y or within_one(x, y)), None)
        if partner:
            want.append((*at, *partner, 0 if any(a == partner and x == y for a, y in all_lines[:k]) else 1))
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(1)).withColumn("h", F.lit(1))
    assert sorted(map(tuple, lines.duplicate_lines(table).collect())) == sorted(want)
    assert lines.duplicate_lines(empty(spark)).count() == 0
    assert lines.duplicate_lines(table.where("doc_id = 7").union(table.where("doc_id = 7"))).select("doc_id", "line_no").distinct().count() == lines.duplicate_lines(table.where("doc_id = 7")).count()


def test_documents_without_their_duplicate_lines(spark):
    rows = [(1, "first line of all\nsecond", 99), (2, "first line of all\nother", 99), (3, "first line of al", 99), (4, None, 0), (5, "", 0)]
    got = by_id(lines.drop_duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")))
    assert {i: (r.text, r.n_chars) for i, r in got.items()} == {1: ("first line of all\nsecond", 99), 2: ("other", 5), 4: (None, 0), 5: ("", 0)}


# --- decontamination


def test_decontamination(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6)))
    vocabulary = [word() for _ in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12, 40))) + ". " + " ".join(rng.choice(vocabulary) for _ in range(8)) + ".") for i in range(60)]
    noise = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, f"{noise(rng.randrange(300))} {items[i][1].upper() if i % 2 else items[i][1]} {noise(rng.randrange(300))}") for i in range(60)]
    docs += [(100 + i, noise(500)) for i in range(40)] + [(200, items[0][1].split(".")[0]), (201, None), (202, ""), (203, "x " * 50_000)]
    benchmark = spark.createDataFrame([*items, (900, None), (None, "x"), (901, ""), (5, items[5][1])], "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(7))
    got = sorted((r.doc_id, r.item_id) for r in decontam.contaminated(table, benchmark).collect())
    assert got == [(i, i) for i in range(60)]
    kept = decontam.drop_contaminated(table, benchmark)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i >= 60)
    assert decontam.contaminated(table, benchmark.limit(0)).count() == 0
    index = decontam.ItemIndex(items)
    for _, text in docs[:40]:
        query = sorted({index.number[w] for w in decontam.terms(text or "") if w in index.number})
        whole = {}
        for t in query:
            for k, x in zip(index.postings[t].items, index.postings[t].impacts):
                whole[k] = whole.get(k, 0) + x
        assert {k for k, _ in index.retrieve(query)} == {k for k, x in whole.items() if x >= decontam.THRESHOLD - 1e-9}
