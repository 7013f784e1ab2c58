"""What larger tables brought up: instants beside a slot's edge, hot blocks, long chains, many copies."""

from types import SimpleNamespace

import duckdb
import pandas as pd
import parity

from larkspur import catalogue
from larkspur.plans import delivery, evidence, merging, repair
from larkspur.streaming import keyed


def put(folder, **tables):
    """Tables written by their SQL; the folder they lie in."""
    for name, sql in tables.items():
        duckdb.connect().execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def equal(spark, name, sf):
    return parity.compare(spark, catalogue.QUERIES[name], catalogue.ORACLE[name], sf)


EVENTS = "SELECT (i * 10 + j)::BIGINT AS event_id, make_timestamp(1704067200000000 + i * 1800000000 + [0, -1, -400, -499, -500, -501, 500000, 1500000, 2500000][j + 1]) AS ts, (i % 20)::BIGINT AS user_id FROM range(40) a(i), range(9) b(j)"


def test_slots_go_by_the_nearest_millisecond(spark, tmp_path):
    assert equal(spark, "backoff", put(tmp_path, events=EVENTS)) == ""


def test_half_seconds_go_to_the_even_one(spark, tmp_path):
    assert equal(spark, "quiet_hours_next", put(tmp_path, events=EVENTS)) == ""


def test_similar_titles_open_up_to_all_their_copies(spark, tmp_path):
    """Copies of one name, names in either order and one that shares a single word of three."""
    part = "SELECT i::BIGINT AS p_partkey, 'Brand#1' AS p_brand, 5 AS p_size, ['large ring', 'ring large', 'small ring', 'old hot plate', 'ring'][i % 5 + 1] AS p_name FROM range(40) t(i)"
    sf = put(tmp_path, part=part)
    assert equal(spark, "title_similarity", sf) == ""
    plan = catalogue.QUERIES["title_similarity"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan  # copies count as one while pairs are compared


def test_equal_texts_of_postings_are_read_once(spark, tmp_path):
    """What a text states doesn't come from its rows any more, neither with few texts (broadcast) nor with many (joined by shuffle)."""
    orders = "SELECT i::BIGINT AS o_orderkey, (i % 4)::BIGINT AS o_custkey, TIMESTAMP '1998-01-01' + INTERVAL (i % 3) DAY AS o_orderdate FROM range(600) t(i)"
    sf = put(tmp_path, orders=orders)
    assert equal(spark, "role_evidence", sf) == ""
    plan = catalogue.QUERIES["role_evidence"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "date posted" not in plan


def test_read_once_or_by_row_is_the_same(spark, monkeypatch):
    """Seasons that begin in the title and end in the text among them, and texts that are null or empty."""
    titles = ["Summer Intern", "Summer", "Fall 2027 PhD", "Intern (Remote)", "Graduating Summer", None]
    texts = ["2027 internship. Spring 2028", "Graduating May 2027.\n2028", "Pay:\nUSD 30 - 35 per hour\nApply by 2027-05-01. Winter 2029", "", None, " \n2027"]
    rows = spark.createDataFrame([(i, t, d) for i, (t, d) in enumerate((t, d) for t in titles for d in texts)], "id int, title string, description string")
    told = [sorted(map(repr, evidence.with_evidence(rows, pay="title", alike=alike).collect())) for alike in (False, True)]
    monkeypatch.setattr(evidence, "FEW_BYTES", 0)
    assert told[0] == told[1] == sorted(map(repr, evidence.with_evidence(rows, pay="title", alike=True).collect()))
    seasons = {(r.title, r.description): r.evidence.season and tuple(r.evidence.season) for r in evidence.with_evidence(rows).where("evidence is not null").collect()}
    assert seasons["Summer Intern", texts[0]] == ("summer", 2027) and seasons["Summer", texts[5]] == ("summer", 2027) and seasons["Graduating Summer", texts[0]] == ("spring", 2028)


def test_evidence_meets_on_all_that_reaches_the_bar(spark, tmp_path):
    part = "SELECT i::BIGINT AS p_partkey, 'Brand#1' AS p_brand, ['X', 'Y', NULL][i % 3 + 1] AS p_type, ['large ring', 'large bolt', 'Large', '', NULL][i % 5 + 1] AS p_name FROM range(45) t(i)"
    sf = put(tmp_path, part=part)
    assert equal(spark, "evidence_match", sf) == ""
    joins = [line for line in catalogue.QUERIES["evidence_match"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
    assert joins and all("p_type" in line for line in joins)


def test_alike_devices_share_their_messages(spark, tmp_path):
    orders = "SELECT i::BIGINT AS o_orderkey, (i % 4)::BIGINT AS o_custkey, TIMESTAMP '1998-01-01' + INTERVAL (i * 20) DAY AS o_orderdate, (i % 5 + 1) || '-X' AS o_orderpriority FROM range(120) t(i)"
    sf = put(tmp_path, orders=orders, customer="SELECT i::BIGINT AS c_custkey, (i % 2)::INT AS c_nationkey FROM range(4) t(i)", supplier="SELECT i::BIGINT AS s_suppkey, (i % 3)::INT AS s_nationkey FROM range(100) t(i)")
    assert equal(spark, "fan_out", sf) == ""
    df = catalogue.QUERIES["fan_out"](spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.split("\n")[1].find("Join") >= 0  # the last step sends to each device; nothing is shuffled behind it


def test_roles_are_ordered_before_devices_meet_them(spark, tmp_path, monkeypatch):
    """Drops of several cards and of single roles, keys, wishes and days that are null, keys below zero; with few devices no message is shuffled."""
    orders = """SELECT CASE WHEN i <> 77 THEN i END::BIGINT AS o_orderkey, CASE WHEN i % 31 > 0 THEN CASE WHEN i % 9 = 0 THEN i % 40 ELSE i % 3 END END::BIGINT AS o_custkey,
        CASE WHEN i % 29 > 0 THEN TIMESTAMP '1998-01-01' + INTERVAL (i) DAY END AS o_orderdate, CASE WHEN i % 23 > 0 THEN (i % 6) || '-X' END AS o_orderpriority FROM range(600) t(i)"""
    customer = "SELECT i::BIGINT AS c_custkey, CASE WHEN i <> 5 THEN i % 4 END::INT AS c_nationkey FROM range(40) t(i)"
    supplier = "SELECT CASE WHEN i <> 3 THEN i - 20 END::BIGINT AS s_suppkey, CASE WHEN i % 7 > 0 THEN i % 3 END::INT AS s_nationkey FROM range(70) t(i)"
    sf = put(tmp_path, orders=orders, customer=customer, supplier=supplier)
    assert equal(spark, "fan_out", sf) == ""
    df = catalogue.QUERIES["fan_out"](spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert "strategy=broadcast" in plan[1]
    meets, ordered = (min(i for i, line in enumerate(plan) if x in line) for x in ("s_nationkey", "Window ["))
    assert meets < ordered  # above the window in the plan
    assert df.where("card AND chunk > 1").count() and df.where("NOT card").count()
    monkeypatch.setattr(delivery, "ALIKE", 1)
    assert equal(spark, "fan_out", sf) == "" and "Generate" in catalogue.QUERIES["fan_out"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(delivery, "FEW_DEVICES", 0)
    assert equal(spark, "fan_out", sf) == ""


def test_nearest_vectors_with_ties_and_without_a_length(spark, tmp_path):
    """More rows than one piece of a product, many of them equal, one without a length."""
    vectors = "SELECT i::BIGINT AS vec_id, CASE WHEN i = 7 THEN [0, 0]::FLOAT[] ELSE [i % 9 - 4, i % 7 - 3.5]::FLOAT[] END AS embedding, (i % 5)::INT AS label FROM range(6000) t(i)"
    sf = put(tmp_path, embeddings=vectors)
    assert equal(spark, "vector_topk", sf) == ""
    assert "CoGroup" in catalogue.QUERIES["vector_topk"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_first_spellings_without_a_shuffle(spark, tmp_path):
    documents = "SELECT * FROM (VALUES (1::BIGINT, 'B a  A b\nB c b'), (2, ''), (3, '   '), (4, NULL), (5, 'Éa éA x')) t(doc_id, text)"
    sf = put(tmp_path, documents=documents)
    assert equal(spark, "first_spellings", sf) == ""
    assert "Aggregate" not in catalogue.QUERIES["first_spellings"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_links_of_a_chain_end_in_few_rounds(spark, monkeypatch):
    """Pointers of a round lead down to one end, so the links of a long chain are gone after the first."""
    steps, put_down = [], repair.written
    monkeypatch.setattr(repair, "written", lambda df, name: steps.append(name) or put_down(df, name))
    found = repair.components(spark.range(1, 300).selectExpr("id AS a", "id + 1 AS b"))
    assert {tuple(r) for r in found.collect()} == {(i, 1) for i in range(1, 301)}
    assert steps.count("links") == 2


def test_a_key_s_events_are_stored_at_once():
    calls = []
    store = SimpleNamespace(appendList=lambda rows: calls.append(rows), appendValue=lambda row: calls.append([row]))
    release = keyed.Release("user_id", 10)
    release.held, release.handle = store, SimpleNamespace(registerTimer=lambda at: calls.append(at))
    assert list(release.handleInputRows((1,), [pd.DataFrame({"at": [5, 3], "event_id": [1, 2]}), pd.DataFrame({"at": [4], "event_id": [3]})], None)) == []
    assert calls == [[(5, 1), (3, 2), (4, 3)], 13]


SNAPSHOTS = """SELECT CASE WHEN i % 11 = 0 THEN NULL WHEN i % 2 = 0 THEN 1 ELSE i % 7 END::BIGINT AS l_suppkey, CASE WHEN i % 13 = 0 THEN NULL WHEN i % 2 = 0 THEN 1 ELSE i % 5 END::BIGINT AS l_partkey,
    CASE WHEN i % 17 > 0 THEN TIMESTAMP '1998-01-01' + INTERVAL (i % 23) DAY END AS l_shipdate, CASE WHEN i % 19 > 0 THEN ['A', 'N', 'R'][CASE WHEN i % 3 = 0 THEN i % 2 ELSE 0 END + 1] END AS l_returnflag FROM range(3000) t(i)"""


def test_consensus_of_keys_and_snapshots_that_are_null(spark, tmp_path):
    """One key with a third of the rows, keys of which a part is null, few days with many rows each."""
    assert equal(spark, "consensus_promotion", put(tmp_path, lineitem=SNAPSHOTS)) == ""


def test_consensus_sorts_few_rows_in_a_task(spark, tmp_path, monkeypatch):
    """Rows are dealt out before they are sorted, to more tasks the more there are, and a day's rows are one before its key's days meet."""
    monkeypatch.setattr(merging, "TASK_ROWS", 100, raising=False)
    sf = put(tmp_path, lineitem=SNAPSHOTS)
    assert equal(spark, "consensus_promotion", sf) == ""
    _, between, below = catalogue.QUERIES["consensus_promotion"](spark, sf)._jdf.queryExecution().executedPlan().toString().split("Exchange")
    assert ", 30), REPARTITION_BY_NUM" in between and "SortAggregate" in between
    assert ", 30), REPARTITION_BY_NUM" in below and "Sort" not in below and "WindowGroupLimit" not in below


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    """To 200 tasks by few rows each, as rows are written straight to a file for each; then by more rows each."""
    monkeypatch.setattr(merging, "TASK_ROWS", 100)
    monkeypatch.setattr(merging, "MOST_ROWS", 1000)
    assert [merging.sorting_tasks(spark.range(n)) for n in (0, 101, 2_901, 90_000, 200_001)] == [4, 4, 30, 200, 201]
