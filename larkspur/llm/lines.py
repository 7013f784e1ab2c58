"""Line dedup: lines within one edit of an earlier line go; the earliest of them stays.

DataFrame functions only. The method is a deletion-neighbourhood join: a line's variants are the line
itself and the line less any one character. Two lines are within one edit exactly if one's variant is
the other line, or if both give the same variant by dropping the character at the same place. So a group
of equal variants needs its earliest line only, found by an aggregate: no pairs are made.

Variants are one for each character, so they are made only where they can meet another line's: of two
lines within one edit, the longer one's half (all but one character, halved) is a common prefix or a
common suffix, and the edit lies outside it. A line of which nobody else has a half makes no variants,
and one that shares only its first (last) half drops only characters behind (before) it; neither loses
anything. A first pass sums up which variants several lines have, as two hashes for each; only those rows
are looked at again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import hinted, ids_shared, materialize, text_digest, text_or_empty

#: A long line's variants are hashed by segments of so many characters, so their cost doesn't grow with its square.
SEGMENT = 256
#: Variants that one task makes.
TASK_VARIANTS = 400_000


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0) and line (spaces trimmed) of every line that isn't blank. Null texts have none."""
    return docs.select("doc_id", F.posexplode(F.split(text_or_empty(), "\n")).alias("line_no", "line")).select("doc_id", "line_no", F.trim("line").alias("line")).where(F.col("line") != "")


def _half(longer: Column) -> Column:
    """Characters of a half, for two lines of which the longer has so many."""
    return F.floor((longer - 1) / 2).cast("int")


def _half_keys(lines: DataFrame) -> DataFrame:
    """h, side (0 to 3) and key: the first and last half as the longer (or equal) line of a pair, then both as the shorter one."""
    n = F.char_length("line")
    keys = [F.xxhash64(F.lit(side), n + more, cut("line", _half(n + more))) for more in (0, 1) for side, cut in (("p", F.left), ("s", F.right))]
    return lines.select("h", F.posexplode(F.array(*keys)).alias("side", "key"))


def _able(lines: DataFrame) -> DataFrame:
    """Distinct lines that may have a neighbour: h, h2, line, at (their earliest place), whole, and the places from lo up to hi that are dropped."""
    keys = _half_keys(lines)
    contested = keys.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key")
    sides = keys.join(hinted(materialize(contested, "halves")), "key", "left_semi").groupBy("h").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("side"))).alias("sides"))
    able = lines.join(hinted(materialize(sides, "sides")), "h").groupBy("h", "h2", "line", "sides").agg(F.min("at").alias("at"))
    n, has = F.char_length("line"), lambda side: F.col("sides").bitwiseAND(1 << side) > 0
    lo = F.when(has(1), 0).when(has(0), _half(n)).otherwise(n)
    hi = F.when(has(0), n).when(has(1), n - _half(n)).otherwise(n)
    return materialize(able.select("h", "h2", "line", "at", (has(2) | has(3)).alias("whole"), lo.alias("lo"), hi.alias("hi")), "lines")


def _variants(able: DataFrame) -> DataFrame:
    """Rows (key, place, h): the variants of each line.

    place is the dropped character's, or -1 for the whole line. Keys are chained from hashes of segments:
    those before the dropped character as they stand, the segment that lost it, and those behind shifted by one.
    """
    piece = lambda k, shift: F.xxhash64(F.substr("line", k * SEGMENT + 1 + shift, F.lit(SEGMENT)))
    count = lambda length: F.greatest(F.ceil(length / SEGMENT), F.lit(1)).cast("int")
    upto = lambda m: F.sequence(F.lit(0), m - 1)
    chained = lambda before, middle, after: F.xxhash64(F.xxhash64(before), middle, F.xxhash64(after))
    tail = lambda xs, j: F.slice(xs, j + 2, F.greatest(F.size(xs) - j - 1, F.lit(0)))
    n, j = F.char_length("line"), F.col("j")
    base = able.withColumn("plain", F.transform(upto(count(n)), lambda k: piece(k, 0))).withColumn("moved", F.transform(upto(count(n - 1)), lambda k: piece(k, 1)))
    whole = base.where("whole").select("h", "plain", F.explode(upto(F.size("plain"))).alias("j"))
    whole = whole.select(chained(F.slice("plain", F.lit(1), j), F.element_at("plain", j + 1), tail(F.col("plain"), j)).alias("key"), F.lit(-1).alias("place"), "h")
    part = base.where("lo < hi").select("h", "line", "lo", "hi", "plain", "moved", F.explode(upto(F.size("moved"))).alias("j"))
    part = part.select(
        "h", "j", F.substr("line", j * SEGMENT + 1, F.lit(SEGMENT + 1)).alias("middle"), (j == F.size("moved") - 1).alias("last"), "lo", "hi",
        F.xxhash64(F.slice("plain", F.lit(1), j)).alias("before"), F.xxhash64(tail(F.col("moved"), j)).alias("after"),
    )
    first = F.greatest(F.col("lo") - j * SEGMENT, F.lit(0))
    end = F.least(F.col("hi") - j * SEGMENT, F.char_length("middle") - F.when(F.col("last"), 0).otherwise(1))
    part = part.where(first < end).select("h", "j", "middle", "before", "after", F.explode(F.sequence(first, end - 1)).alias("i"))
    dropped = F.concat(F.left("middle", F.col("i")), F.substr("middle", F.col("i") + 2))
    return whole.unionByName(part.select(F.xxhash64("before", F.xxhash64(dropped), "after").alias("key"), (j * SEGMENT + F.col("i")).alias("place"), "h"))


def _near_partners(lines: DataFrame) -> DataFrame:
    """Of each distinct line with an earlier line one edit away: h, h2 and the earliest such line's place, `near`."""
    able = _able(lines)
    work = able.agg(F.sum(F.greatest(F.col("hi") - F.col("lo"), F.lit(0)) + 1)).first()[0] or 0
    variants = _variants(able.repartition(max(able.sparkSession.sparkContext.defaultParallelism, -(-work // TASK_VARIANTS))))
    met = variants.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key")
    found = variants.join(hinted(materialize(met, "met")), "key", "left_semi")
    found = materialize(found.join(hinted(able.select("h", "at")), "h"), "variants")
    mine, is_whole = F.struct("at", "h"), F.col("place") < 0
    # Substitutions meet at one place; a whole line meets those that are longer by one, whatever they dropped.
    alike = found.where(~is_whole).groupBy("key", "place").agg(F.min(mine).alias("p"), F.max(mine).alias("q")).where("p <> q").select("key", "place", "p")
    longer = found.groupBy("key").agg(F.min(F.when(is_whole, mine)).alias("w"), F.min(F.when(~is_whole, mine)).alias("p")).where("w is not null and p is not null")
    pairs = found.join(alike, ["key", "place"]).select("h", "at", "p")
    pairs = pairs.unionByName(found.join(longer, "key").select("h", "at", F.when(is_whole, F.col("p")).otherwise(F.col("w")).alias("p")))
    pairs = pairs.where("p.at < at").select("h", F.col("p.at").alias("near"), F.col("p.h").alias("ph")).distinct()
    texts = able.select("h", "h2", "line")
    checked = pairs.join(texts, "h").join(texts.select(F.col("h").alias("ph"), F.col("line").alias("theirs")), "ph")
    return checked.where(F.levenshtein("line", "theirs", 1).between(0, 1)).groupBy("h", "h2").agg(F.min("near").alias("near"))


def _repeated_lines(docs: DataFrame, own: list[str], min_chars: int) -> DataFrame:
    """duplicate_lines with the columns `own` (the text's digest, or none), which tell documents of one doc_id apart."""
    digests = [F.col(c) for c in own]
    lines = docs.select("doc_id", *(text_digest() if own else []), F.posexplode(F.split(text_or_empty(), "\n")).alias("line_no", "line"))
    lines = lines.select("doc_id", "line_no", F.trim("line").alias("line"), *digests).where(F.col("line") != "")
    lines = lines.select("doc_id", "line_no", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("h2"), "line", F.struct("doc_id", "line_no", *digests).alias("at"))
    # Equal lines: 128 bits of hash stand for a line, of which one group is summed up before the shuffle.
    same = lines.groupBy("h", "h2").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first <> last").select("h", "h2", "first")
    near = materialize(_near_partners(lines.where(F.char_length("line") >= min_chars)), "near")
    either = same.withColumn("near", F.lit(None).cast(near.schema["near"].dataType)).unionByName(near.withColumn("first", F.lit(None).cast(near.schema["near"].dataType)))
    either = materialize(either.groupBy("h", "h2").agg(F.min("first").alias("first"), F.min("near").alias("near")), "repeated")
    found = lines.select("doc_id", "line_no", "h", "h2", "at").join(hinted(either), ["h", "h2"])
    found = found.withColumn("kept", F.least("first", "near")).where("kept < at")
    distance = F.when(F.col("kept") == F.col("first"), 0).otherwise(1).alias("distance")
    return found.select("doc_id", "line_no", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no"), distance, *[F.col(f"at.{c}").alias(c) for c in own])


def _own(docs: DataFrame) -> list[str]:
    """What tells apart the documents of one doc_id: nothing where ids are unique or stand for one text, so that positions stay narrow."""
    return ["t1", "t2"] if ids_shared(docs.select("doc_id", *text_digest())) else []


def duplicate_lines(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """Every line that repeats an earlier one: doc_id, line_no, kept_doc_id, kept_line_no, distance (0 or 1).

    Earlier means a smaller (doc_id, line_no), null ids first, then a smaller digest of the text where documents
    share both; the kept line named is the earliest within one edit, over the whole corpus, in that order. A line
    may name one that itself goes. Lines of fewer than min_chars characters only match equal lines; by default
    there are none. Blank lines always stay; null and empty texts have no lines. Lines may be of any length.
    Repeated rows (equal doc_id and text) are one and the same line, so none of them goes for the other; other
    columns are not read.
    """
    return _repeated_lines(docs, _own(docs), min_chars).select("doc_id", "line_no", "kept_doc_id", "kept_line_no", "distance")


def drop_duplicate_lines(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """The documents without their duplicate lines; n_chars follows. Those of which nothing is left go, those that were blank before stay.

    Lines go as `duplicate_lines` says; those of fewer than min_chars characters, by default none, for an equal line only.
    Column names beginning with `__dup_` are used inside; all others pass through.
    """
    own = _own(docs)
    gone = _repeated_lines(docs, own, min_chars).groupBy(F.col("doc_id").alias("__dup_id"), *[F.col(c).alias(f"__dup_{c}") for c in own]).agg(F.collect_set("line_no").alias("__dup_gone"))
    gone = hinted(materialize(gone, "gone"))
    mine = F.col("doc_id").eqNullSafe(F.col("__dup_id"))
    for digest, name in zip(text_digest(), own, strict=False):
        mine = mine & (digest == F.col(f"__dup_{name}"))
    df = docs.join(gone, mine, "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(F.col("__dup_gone"), i)), "\n")
    df = df.withColumn("text", F.when(F.col("__dup_gone").isNull(), F.col("text")).otherwise(left)).where(F.col("__dup_gone").isNull() | (F.trim(F.translate("text", "\n", " ")) != ""))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(F.col("__dup_gone").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return df.select(*docs.columns)


ORACLE = """
WITH l AS (SELECT doc_id, line_no - 1 AS line_no, trim(line) AS line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents) WHERE trim(line) <> ''),
d AS (SELECT line, min(row(doc_id, line_no)) AS pos, length(line) AS n FROM l GROUP BY line),
k AS (SELECT *, unnest([n, n + 1]) AS m FROM d),
h AS (SELECT *, unnest(['p' || left(line, ((m - 1) // 2)::INT), 's' || right(line, ((m - 1) // 2)::INT)]) AS half FROM k),
c AS (SELECT DISTINCT x.line AS a, y.line AS b, y.pos AS b_pos FROM h x JOIN h y ON x.m = y.m AND x.half = y.half AND y.pos < x.pos AND x.line <> y.line AND abs(x.n - y.n) <= 1),
v AS (SELECT a, min(b_pos) AS near FROM c WHERE len(list_filter(range(0, least(length(a), length(b)) + 1), lambda i: left(a, i::INT) = left(b, i::INT) AND substr(a, i + 1 + (length(a) >= length(b))::INT) = substr(b, i + 1 + (length(b) >= length(a))::INT))) > 0 GROUP BY a),
r AS (SELECT l.doc_id, l.line_no, d.pos, least(d.pos, v.near) AS kept FROM l JOIN d USING (line) LEFT JOIN v ON v.a = l.line)
SELECT doc_id, line_no::INT AS line_no, kept[1] AS kept_doc_id, kept[2]::INT AS kept_line_no, CASE WHEN kept = pos THEN 0 ELSE 1 END AS distance FROM r WHERE kept < row(doc_id, line_no)
"""
