"""A folder of list documents, in batch and as a stream, in both layouts, changed between runs."""

import json
import os

import parity
import pytest
from pyspark.sql import functions as F

from larkspur import catalogue
from larkspur.sources import lists
from larkspur.streaming import flows

TABLE = """# List
| Company | Role | Location | Apply |
| --- | :-: | --- | --- |
| **[Acorn](https://acorn.test)** | Data `Intern` | Oslo<br>Rome | <a href="https://jobs.test/1?a=1&amp;b=2">Apply</a> |
| ↳ | Design Intern | Remote | 🔒 |
| Birch | too | few |

text between
| Company | Role | Location | Apply |
|---|---|---|---|
| ↳ | No company above | Bonn | [x](https://jobs.test/2) closed |
"""
SECTIONS = """## Pine & Co
**Locations**: Chicago, *NYC*
| Role | Links |
| --- | --- |
| QD | [Apply](https://jobs.test/qd) [C++ ✅](https://jobs.test/qd-cpp) |
| Ops | [Expired](https://jobs.test/ops) |
## Oak
| SWE | [apply](https://jobs.test/swe?a=1&amp;b=2) [bad](ftp://x) |
"""


@pytest.fixture
def source(spark):
    lists.register(spark)
    return lambda folder, **options: spark.read.format("list_documents").options(**options).load(f"file://{folder}")


def plain(df):
    return sorted((tuple(r) for r in df.drop("etag").collect()), key=repr)


def test_query(spark):
    assert parity.compare(spark, catalogue.QUERIES["list_source"], catalogue.ORACLE["list_source"], "/root/testdata/sf0.001") == ""


def test_both_layouts(source, tmp_path):
    (tmp_path / "a.md").write_text(TABLE)
    assert plain(source(tmp_path)) == sorted([
        ("a.md", 4, "Acorn", "Data Intern", "Oslo Rome", "https://jobs.test/1?a=1&b=2", False), ("a.md", 5, "Acorn", "Design Intern", "Remote", None, True), ("a.md", 11, None, "No company above", "Bonn", "https://jobs.test/2", True),
    ], key=repr)
    (tmp_path / "a.md").write_text(SECTIONS)
    assert plain(source(tmp_path, layout="sections")) == sorted([
        ("a.md", 5, "Pine & Co", "Quantitative Developer Intern", "Chicago, NYC", "https://jobs.test/qd", False), ("a.md", 5, "Pine & Co", "Quantitative Developer Intern — C++", "Chicago, NYC", "https://jobs.test/qd-cpp", False),
        ("a.md", 6, "Pine & Co", "Ops Intern — Expired", "Chicago, NYC", "https://jobs.test/ops", True), ("a.md", 8, "Oak", "Software Engineering Intern", "Unspecified", "https://jobs.test/swe?a=1&b=2", False),
    ], key=repr)
    with pytest.raises(Exception, match="layout"):
        source(tmp_path, layout="other").count()


def test_batch_and_stream_read_alike_and_changes_only(spark, source, tmp_path):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    for name in ("a.md", "b.md", "deep/c.md"):
        (folder / name).write_text(TABLE.replace("Acorn", name))
    (folder / ".hidden.md").write_text(TABLE)
    run = lambda: flows.drain(spark.readStream.format("list_documents").load(f"file://{folder}"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    run()
    first = spark.read.parquet(f"{tmp_path}/out")
    assert plain(first) == plain(source(folder)) and first.count() == 9
    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 9
    known = json.dumps({r.document: r.etag for r in source(folder).select("document", "etag").distinct().collect()})
    assert source(folder, known=known).count() == 0
    (folder / "b.md").write_text(TABLE.replace("Acorn", "changed"))
    (folder / "d.md").write_text(TABLE)
    os.remove(folder / "a.md")
    run()
    again = spark.read.parquet(f"{tmp_path}/out")
    assert again.count() == 15 and {r.document for r in again.where(F.col("company").isin("changed", "Acorn")).collect()} == {"b.md", "d.md"}
    assert {r.document for r in source(folder, known=known).collect()} == {"b.md", "d.md"}


def test_caps_fail_the_whole_read(source, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.md").write_text(TABLE)
    for options in ({"documentBytes": "10"}, {"sourceBytes": str(len(TABLE.encode()) + 10)}):
        with pytest.raises(Exception, match="more than"):
            source(tmp_path, **options).count()
    assert source(tmp_path / "none").count() == 0
