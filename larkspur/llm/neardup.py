"""Near-duplicate documents by SetSketch registers.

A register holds the exponentially spaced, truncated minimum of its hash over a document's shingles.
Registers merge by maximum, and equal registers tell of similar sets, so bands of them find candidates.
Documents with equal sets fold into one first. Of each band's bucket, everyone is checked against the
bucket's first document; what is linked by then is one component. Only buckets with several components
left are compared pair by pair, inside a task: a joint likelihood of the similarity, from how many registers
are greater, less and equal and from the known set sizes, decides what is worth a look; shortened shingle
hashes then tell what is a link, and only links leave the task. Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import bounded_batches, hinted, ids_shared, materialize, text_digest, text_or_empty

SHINGLE, PERCENT = 5, 75
#: Registers, bands of them, and the base and rate of their spacing. At similarity 0.75 all bands miss once in 200,000 pairs.
REGISTERS, BANDS = 128, 32
BASE, RATE, TOP = 1.001, 20.0, 65_534
#: Pairs whose likeliest similarity is below this are not checked: six standard errors under the threshold.
LEAST_ESTIMATE = 0.5
#: Documents of a bucket that one task compares; larger buckets are dealt out as pairs of such blocks.
BLOCK = 2048
#: Documents whose registers one task makes anew.
SKETCHED = 4000
#: Similarities on shortened hashes from which a pair leaves the task, and from which it surely is a link.
LIKELY_LINK, SURE_LINK = 0.74, 0.76
_U64 = np.uint64
_WORD_CACHE = 100_000


class _WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()
_rng = np.random.default_rng(20_24)
_POWERS = _rng.integers(1 << 62, 1 << 63, SHINGLE, dtype=np.uint64) | _U64(1)
_SEEDS = _rng.integers(1, 1 << 63, REGISTERS, dtype=np.uint64) | _U64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct five-word shingles; of all words, if they are fewer; none without words.

    A to Z are lowered; words are split at the six ASCII spaces, which is how bytes split.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - SHINGLE + 1)
    mix = np.full(n, min(len(w), SHINGLE), np.uint64)
    for k in range(min(SHINGLE, len(w))):
        mix += w[k : k + n] * _POWERS[k]
    return np.unique(_mixed(mix))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers for each set that isn't empty."""
    lengths = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    flat = np.concatenate(sets)
    least = np.empty((len(sets), REGISTERS), np.uint64)
    for j in range(REGISTERS):
        x = flat * _SEEDS[j]
        x ^= x >> _U64(32)
        x *= _SEEDS[(j + 1) % REGISTERS]
        least[:, j] = np.minimum.reduceat(x, starts)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def _bands(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band: its place and its registers."""
    rows = regs.reshape(len(regs), BANDS, REGISTERS // BANDS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _U64(0x9E3779B97F4A7C15), rows.shape[:2]).copy()
    for k in range(rows.shape[2]):
        key = _mixed(key ^ rows[:, :, k])
    return key.view(np.int64)


def likely(equal: np.ndarray, more: np.ndarray, less: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the likeliest similarity is LEAST_ESTIMATE or more, given the register counts and the set sizes a and b.

    A register of the first is the greater one with probability p(u - vJ), the less one with p(v - uJ), where
    u and v are the shares of a and b in a + b and p(x) = -log_base(1 - x (base - 1) / base). The likelihood
    is concave in J, so its slope at the bound tells on which side the maximum lies.
    """
    u, v = a / (a + b), b / (a + b)
    j, c = LEAST_ESTIMATE, (BASE - 1) / BASE
    x, y = u - v * j, v - u * j
    p = lambda z: -np.log1p(-z * c) / np.log(BASE)
    dp = lambda z: c / (np.log(BASE) * (1 - z * c))
    with np.errstate(all="ignore"):
        slope = -more * v * dp(x) / p(x) - less * u * dp(y) / p(y) + equal * (v * dp(x) + u * dp(y)) / (1 - p(x) - p(y))
    return (x > 0) & (y > 0) & (slope >= 0)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text (t1, t2), n_shingles, digest of the set (s1, s2; null if empty), and the band keys of each document."""

    @F.pandas_udf("n_shingles long, s1 long, s2 long, bands array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingles(t) for t in texts]
            full = [k for k, s in enumerate(sets) if len(s)]
            out = pd.DataFrame({"n_shingles": [len(s) for s in sets], "s1": pd.array([None] * len(sets), "Int64"), "s2": pd.array([None] * len(sets), "Int64"), "bands": [None] * len(sets)})
            if full:
                out.loc[full, "s1"] = [xxhash.xxh3_64_intdigest(sets[k].tobytes(), 1) - (1 << 63) for k in full]
                out.loc[full, "s2"] = [xxhash.xxh3_64_intdigest(sets[k].tobytes(), 2) - (1 << 63) for k in full]
                # Few shingles at a time, which keeps the work in small arrays.
                turns = np.cumsum([len(sets[k]) for k in full]) // 32_768
                bands = np.concatenate([_bands(registers([sets[full[i]] for i in np.flatnonzero(turns == t)])) for t in np.unique(turns)])
                out["bands"] = pd.Series(list(bands), index=full).reindex(out.index)
                out["bands"] = out["bands"].where(out["bands"].notna(), None)
            yield out

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", *text_digest(), run(text_or_empty()).alias("x")).select("doc_id", "t1", "t2", "x.*")


def components(edges: DataFrame) -> DataFrame:
    """id and component (the least id reachable) of every id in the edges (a, b).

    Labels spread along the edges and then point to their labels' labels, until nothing changes; each round's
    labels are a written table, so neither lineage nor the driver's memory grows.
    """
    both = materialize(edges.select(F.col("a").alias("id"), F.col("b").alias("to")).union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("to"), F.col("component").alias("theirs")), "to").groupBy("id").agg(F.min("theirs").alias("theirs"))
        step = labels.join(near, "id").select("id", "component", F.least("component", "theirs").alias("met"))
        jump = labels.select(F.col("id").alias("met"), F.col("component").alias("further"))
        step = step.join(jump, "met").select("id", F.least("met", "further").alias("new"), "component")
        step = materialize(step, "labels")
        moved = step.where("new <> component").limit(1).count()
        labels = step.select("id", F.col("new").alias("component"))
        if not moved:
            return labels


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose full shingle sets are similar enough. Ordered by b, so that its set is made once for many a."""

    @F.pandas_udf("boolean")
    def check(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        last, held = None, np.zeros(0, np.uint64)
        for left, right in batches:
            out = []
            for x, y in zip(left, right, strict=True):
                if y != last:
                    last, held = y, shingles(y)
                mine = shingles(x)
                both = len(np.intersect1d(mine, held, assume_unique=True))
                out.append(bool(both) and 100 * both >= PERCENT * (len(mine) + len(held) - both))
            yield pd.Series(out)

    left = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("x")), "a")
    full = left.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("y")), "b")
    return full.where(check("x", "y")).select("a", "b").distinct()


def _likely_partners(i: int, to: np.ndarray, g: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Those of `to` in another component that may be similar to i, and how many registers they share."""
    n = g["n"]
    to = to[(g["component"][to] != g["component"][i]) & (100 * n[to] >= PERCENT * n[i]) & (100 * n[i] >= PERCENT * n[to])]
    equal = (g["regs"][to] == g["regs"][i]).sum(1)
    near = equal >= REGISTERS * LEAST_ESTIMATE / 2
    to, equal = to[near], equal[near]
    more = (g["regs"][to] < g["regs"][i]).sum(1)
    ok = likely(equal, more, REGISTERS - equal - more, np.float64(n[i]), n[to].astype(np.float64))
    return to[ok], equal[ok]


def _group_links(g: dict[str, np.ndarray]) -> list[tuple[int, int]]:
    """Links of one bucket (or of two blocks of it), as places: likely pairs whose shortened sets are similar enough.

    A pair is looked at in the first band that it shares, and only while its components are apart.
    """
    same = g["lo"][0] == g["hi"][0]
    left = np.flatnonzero(g["block"] == g["lo"][0])
    right = np.flatnonzero(g["block"] == g["hi"][0])
    band, width, parent, found = int(g["band"][0]), REGISTERS // BANDS, {}, []

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    sets: dict[int, np.ndarray] = {}
    held = lambda k: sets[k] if k in sets else sets.setdefault(k, np.frombuffer(g["short"][k], np.uint32))
    for i in left:
        js, equal = _likely_partners(i, right[right > i] if same else right, g)
        if band and len(js):
            before = (g["regs"][js, : band * width] == g["regs"][i, : band * width]).reshape(len(js), band, width).all(2).any(1)
            js, equal = js[~before], equal[~before]
        for j in js[np.argsort(-equal, kind="stable")].tolist():
            a, b = root(int(g["component"][i])), root(int(g["component"][j]))
            if a == b:
                continue
            x, y = held(int(i)), held(j)
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            alike = both / (len(x) + len(y) - both)
            if alike >= LIKELY_LINK:
                found.append((int(i), j))
            if alike >= SURE_LINK:
                parent[max(a, b)] = min(a, b)
    return found


def _cross_links(members: DataFrame) -> DataFrame:
    """Pairs (a, b), a > b, of different components that share a bucket and look like links.

    Rows of a bucket come sorted, so buckets stream through a task; one beyond BLOCK documents is dealt out
    as pairs of blocks.
    """
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("doc"), "blocks").cast("int")
    dealt = members.join(sizes, "key").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "doc", "component", "n", "regs", "short")
    dealt = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "doc")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] | None = None
        for pdf in _ended(batches):
            new = None if pdf is None else {c: pdf[c].to_numpy() for c in pdf.columns if c != "regs"} | {"regs": np.frombuffer(b"".join(pdf["regs"]), np.uint16).reshape(-1, REGISTERS)}
            held = new if held is None else held if new is None else {c: np.concatenate([held[c], new[c]]) for c in held}
            if held is None:
                continue
            change = np.flatnonzero((held["key"][1:] != held["key"][:-1]) | (held["lo"][1:] != held["lo"][:-1]) | (held["hi"][1:] != held["hi"][:-1])) + 1
            bounds = [0, *change.tolist(), *([len(held["key"])] if pdf is None else [])]
            pairs = []
            for x, y in zip(bounds, bounds[1:], strict=False):
                g = {c: v[x:y] for c, v in held.items()}
                pairs += [(max(p, q), min(p, q)) for i, j in _group_links(g) for p, q in [(int(g["doc"][i]), int(g["doc"][j]))] if p != q]
            held = {c: v[bounds[-1] :] for c, v in held.items()} if pdf is not None else None
            if pairs:
                yield pd.DataFrame(pairs, columns=["a", "b"])

    return dealt.mapInPandas(search, "a long, b long").distinct()


def _ended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    """The batches, and None behind the last one."""
    yield from batches
    yield None


def _sketched(texts: DataFrame) -> DataFrame:
    """doc, set size, registers, and the distinct shingle hashes shortened to 32 bits, of each candidate."""

    @F.pandas_udf("n long, regs binary, short binary")
    def run(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t) for t in texts]
        return pd.DataFrame({"n": [len(s) for s in sets], "regs": [r.tobytes() for s in sets for r in registers([s])], "short": [np.unique((s >> _U64(32)).astype(np.uint32)).tobytes() for s in sets]})

    # The work is Python time, so rows are dealt by number instead of by their bytes.
    tasks = max(texts.sparkSession.sparkContext.defaultParallelism, -(-texts.count() // SKETCHED))
    return texts.repartition(tasks).select("doc", run("text").alias("x")).select("doc", "x.*")


def _representatives(made: DataFrame) -> DataFrame:
    """s1, s2, rep (the least doc_id) and doc (a number, in order of rep) of sets with an id.

    A doc_id is its own number and sets of a single row are left out, unless ids stand for several texts: then
    every set is there and has a number of its own.
    """
    equal = made.where("s1 is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("rep is not null")
    if not ids_shared(made.where("doc_id is not null")):
        return materialize(equal.where("copies > 1").select("s1", "s2", "rep", F.col("rep").alias("doc")), "copies")
    return materialize(equal.select("s1", "s2", "rep").orderBy("rep", "s1", "s2").withColumn("doc", F.monotonically_increasing_id()), "sets")


def _judged(docs: DataFrame) -> DataFrame:
    """near_duplicates with the digests of each row's text and set."""
    made = materialize(sketch(docs), "sketch")
    sets = _representatives(made)
    ranked = made.where("s1 is not null and doc_id is not null").join(hinted(sets), ["s1", "s2"], "left").where("rep is null or rep = doc_id").withColumn("doc", F.coalesce("doc", "doc_id"))
    keys = ranked.select(F.posexplode("bands").alias("band", "key"), "doc")
    buckets = keys.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("key", "first")
    shared = materialize(keys.join(hinted(materialize(buckets, "buckets")), "key"), "shared")

    needed = hinted(materialize(shared.select("doc").distinct(), "needed"))
    needed = hinted(materialize(ranked.select("doc", "doc_id", "t1", "t2").join(needed, "doc", "left_semi").distinct(), "needed"))
    texts = materialize(docs.select("*", *text_digest()).join(needed, ["doc_id", "t1", "t2"]).select("doc", "text").dropDuplicates(["doc"]), "texts")
    star = shared.where("first < doc").select(F.col("doc").alias("a"), F.col("first").alias("b")).distinct()
    links = materialize(_similar(star, texts), "links")
    belongs = components(links)
    placed = shared.join(belongs.select(F.col("id").alias("doc"), "component"), "doc", "left").select("key", "band", "doc", F.coalesce("component", "doc").alias("component"))
    several = materialize(placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key"), "several")
    apart = placed.join(hinted(several), "key", "left_semi").join(materialize(_sketched(texts), "registers"), "doc")
    pairs = materialize(_cross_links(apart).join(star, ["a", "b"], "left_anti"), "pairs")
    links = materialize(links.union(_similar(pairs, texts)), "links")
    belongs = components(links).where("id <> component").select(F.col("id").alias("doc"), "component")
    belongs = belongs.join(hinted(materialize(sets.select(F.col("doc").alias("component"), F.col("rep").alias("least")).distinct(), "reps")), "component", "left")
    belongs = materialize(belongs.select("doc", F.coalesce("least", "component").alias("component")), "components")

    whole = made.select("doc_id", "t1", "t2", "n_shingles", "s1", "s2").join(hinted(sets), ["s1", "s2"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    whole = whole.withColumn("doc", F.when(F.col("s1").isNotNull(), F.coalesce("doc", "doc_id"))).join(hinted(belongs), "doc", "left")
    kept = F.col("component").isNull() & F.col("doc_id").eqNullSafe(F.col("rep"))
    return whole.select("doc_id", "t1", "t2", "s1", "s2", "n_shingles", F.coalesce("component", "rep").alias("component_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id reachable over links), kept (it stands for its component).

    Links are similarities of PERCENT or more on sets of five-word shingles. Documents without words, null
    texts among them, have an empty set, link with nothing and are kept. Repeated rows get equal results. Rows
    without a doc_id only join documents of an equal set; alone, they keep a null component and are kept.
    Rows that share a doc_id but not a text are judged by their own text: unlike ones are all kept, of linked
    ones one set is. Other columns are not read.
    """
    return _judged(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group, with all columns; of repeated rows, one.

    Rows are told apart by doc_id and text, so unlike documents that share an id, or have none, all stay.
    Column names beginning with `__kept_` and `__own_` are used inside.
    """
    kept = _judged(docs.select("doc_id", "text")).where("kept")
    # Of one id's texts with an equal set, one; texts without words are equal only as they stand.
    alike = [F.coalesce("s1", "t1").alias("u1"), F.coalesce("s2", "t2").alias("u2"), F.col("s1").isNull().alias("bare")]
    kept = materialize(kept.groupBy(F.col("doc_id").alias("__kept_id"), *alike).agg(F.min(F.struct("t1", "t2")).alias("t"), F.count("*").alias("n")), "kept")
    repeated = kept.where("n > 1").limit(1).count()
    those = hinted(kept.select("__kept_id", F.col("t.t1").alias("__kept_t1"), F.col("t.t2").alias("__kept_t2")))
    mine = docs.select("*", *[c.alias(n) for c, n in zip(text_digest(), ("__own_t1", "__own_t2"), strict=True)])
    left = mine.join(those, F.col("doc_id").eqNullSafe(F.col("__kept_id")) & (F.col("__own_t1") == F.col("__kept_t1")) & (F.col("__own_t2") == F.col("__kept_t2")), "left_semi")
    return (left.dropDuplicates(["doc_id", "__own_t1", "__own_t2"]) if repeated else left).select(*docs.columns)
