"""Documents without an id, and different documents under one id, each losing its own lines only."""

from larkspur.llm import lines

FIELDS = "doc_id long, text string, n_chars long"


def texts(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.collect())


def test_lines_go_from_their_own_document_only(spark):
    rows = [(None, "a line that all repeat\nonly in the first"), (None, "something else at first\na line that all repeat"), (None, "clean and unique, line one\nclean and unique, line 2 here"),
            (7, "head of the seventh\na line that all repeat"), (7, "head of another seventh\nwith its own second line"), (7, "head of another seventh\nwith its own second line"), (7, None)]
    got = texts(lines.drop_duplicate_lines(spark.createDataFrame([(*r, 1) for r in rows], FIELDS)))
    want = [*rows[:1], (None, "something else at first"), rows[2], (7, "head of the seventh"), *rows[4:]]
    assert got == sorted((d is not None, d or 0, t or "") for d, t in want)


def test_equal_lines_at_one_number_are_found(spark):
    for doc_id in (None, 7):
        docs = spark.createDataFrame([(doc_id, "the very same first line\nleft", 1), (doc_id, "the very same first line\nright", 1)], FIELDS)
        assert [tuple(r) for r in lines.duplicate_lines(docs).collect()] == [(doc_id, 0, doc_id, 0, 0)]
        assert sorted(len(r.text.split("\n")) for r in lines.drop_duplicate_lines(docs).collect()) == [1, 2]


def test_one_edit_goes_at_every_length(spark):
    # Of each pair of lines one edit apart the later goes, however short they are.
    rows = []
    for n in range(1, 40):
        word = "".join(chr(0x4E00 + (n * 50 + i)) for i in range(n))
        rows += [(2 * n, f"{word}\nkeep {n:02d} {n * n * n:08d} {chr(0x5E00 + n) * 9}", 1), (2 * n + 1, f"{word[:-1]}\u0416\nstay {n:02d} {n * 77:08d} {chr(0x6E00 + n) * 9}", 1)]
    docs = spark.createDataFrame(rows, FIELDS)
    gone = {(r.doc_id, r.line_no) for r in lines.duplicate_lines(docs).collect()}
    left = {r.doc_id: r.text for r in lines.drop_duplicate_lines(docs).collect()}
    assert {(2 * n + 1, 0) for n in range(1, 40)} <= gone
    assert all(left.get(d, "").split("\n") == [x for i, x in enumerate(t.split("\n")) if (d, i) not in gone] for d, t, _ in rows)
