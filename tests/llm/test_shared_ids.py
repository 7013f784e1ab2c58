"""Documents without an id, and different documents under one id, each judged by its own text."""

from larkspur.llm import neardup

FIELDS = "doc_id long, text string, n_chars long"


def words(prefix, n=40):
    return " ".join(f"{prefix}{i}" for i in range(n))


def texts(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.collect())


def test_near_dedup_keeps_unlike_documents(spark):
    rows = [(None, words("a")), (None, words("b")), (None, words("b")), (7, words("c")), (7, words("d")), (7, words("d")), (3, words("e")), (None, words("e")), (8, words("d") + " more"), (7, ""), (9, words("c").upper()), (None, "")]
    got = texts(neardup.keep_one(spark.createDataFrame([(*r, 1) for r in rows], FIELDS)))
    want = [(None, words("a")), (None, words("b")), (None, ""), (3, words("e")), (7, words("c")), (7, words("d")), (7, "")]
    assert got == sorted((d is not None, d or 0, t) for d, t in want)


def test_near_duplicates_of_a_shared_id(spark):
    """Both texts of 7 link with other ids, near copies under one id keep one, and an id's blank text is no link's."""
    rows = [(7, words("a")), (7, words("b")), (2, words("a") + " more"), (9, words("b") + " more"), (5, words("c")), (5, words("c") + " more"), (9, None)]
    got = sorted((r.component_id, r.doc_id, r.n_shingles, r.kept) for r in neardup.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], FIELDS)).collect())
    assert [g[:3] for g in got] == [(2, 2, 37), (2, 7, 36), (5, 5, 36), (5, 5, 37), (7, 7, 36), (7, 9, 37), (9, 9, 0)]
    assert sorted((c, d) for c, d, _, kept in got if kept) == [(2, 2), (5, 5), (7, 7), (9, 9)]
