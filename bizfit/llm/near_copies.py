"""Near copies for the pipeline: word shingles of five, exact Jaccard similarity of 0.8 or more.

Candidates come from the SimHash operator first: texts have a fingerprint of their
five-word shingles, and those within four bits of the smallest under a Golay key are
candidates, then, by the probes, all within four bits that are still apart. But a pair at similarity 0.8 differs by about ten bits of 64, which no code
radius reaches at a bearable number of keys (README has the sum), so the rest come from
BANDS independent fingerprints of ROWS minima of hashed shingles each; texts with an
equal one are candidates. A pair at similarity 0.8 has none in common with a chance of
(1 - 0.8^5)^32 = 3e-6, a nearer pair with less.

Filter. A text also has an odd sketch, the parities of its shingle hashes dealt to
1,024 places. Two sketches differ in no more places than the sets have shingles
apart, so a pair whose sketches differ in over a ninth of both counts is surely
under 0.8. Sets of over SAMPLED shingles are sketched from a sample of hashes, the
same for all texts, and six deviations are allowed. All other candidates are
compared exactly, by their sets of 64-bit shingle hashes, and only pairs found at
0.8 or more are linked. A text under five words is one shingle.

Equal word sequences are combined first. A fingerprint's members are first linked to
the most central of them, the one that shares the most fingerprints with others, as
copies are near their original rather than one another. Only pairs that are still in
different components are compared then, so a group of near copies doesn't yield all
its pairs, and no link between components is lost. Members meet by their numbers
alone; sketches, and texts, which are read again, are taken for the members of candidate
pairs only.

Nulls: a null text is empty, and empty texts are equal. A null doc_id is never a
component's smallest id unless all are null; of each component one row is kept,
whether ids repeat or are null. An empty table gives an empty result.
Repeated rows are one node; a hot key is split; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizfit.llm.common import ascii_lower, join_groups, relabel
from bizfit.llm.near_dedup import hub_links, pack_bits, probe_links, set_bits
from bizfit.operators.graph import connected_components
from bizfit.operators.shared import cut, discard

SHINGLE = 5
BANDS, ROWS = 32, 5
BLOCK = 256
CHUNK = 1 << 12
MARKS = 1 << 22
SAMPLED = 512
PLACES = 1024
LONGS = PLACES // 64
_RNG = np.random.default_rng(5)
TIMES, PLUS = _RNG.integers(0, 1 << 63, (2, BANDS * ROWS, 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
MIX = _RNG.integers(0, 1 << 63, ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: list[bytes]) -> np.ndarray:
    """The distinct hashes of a text's word shingles; a shorter text is one shingle."""
    joined = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    return np.array(list({xxhash.xxh64_intdigest(x, 42) for x in joined}), np.uint64)


def node_of(words: list[bytes]) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), 42)).view(np.int64))


def band_keys(h: np.ndarray) -> np.ndarray:
    """One key a band of a set of shingle hashes."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), CHUNK):
        np.minimum(low, (h[at : at + CHUNK] * TIMES + PLUS).min(axis=1), out=low)
    keys = ((low.reshape(BANDS, ROWS) * MIX).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)) * SPREAD
    return keys.view(np.int64)


def odd_sketch(h: np.ndarray) -> tuple[int, np.ndarray]:
    """(halvings k, sketches of the hashes sampled at 2^-k and at half of that): a set has at most SAMPLED expected in the first."""
    halvings, out = max(0, (len(h) - 1) // SAMPLED).bit_length(), []
    for k in (halvings, halvings + 1):
        part = h[(h & np.uint64((1 << k) - 1)) == 0]
        odd = np.bincount((part >> np.uint64(40) & np.uint64(PLACES - 1)).astype(np.int64), minlength=PLACES) & 1
        out.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
    return halvings, np.concatenate(out)


def _words(column: pa.Array) -> Iterator[list[bytes]]:
    for t in column.cast(pa.large_binary()):
        yield t.as_buffer().to_pybytes().lower().split() if t.is_valid else []


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
        node, fp, n, halvings, odd, keys = [], [], [], [], [], []
        for w in _words(b.column(1)):
            h = shingles(w)
            k, places = odd_sketch(h)
            node.append(node_of(w))
            fp.append(pack_bits(sum(set_bits(h[at : at + CHUNK]) for at in range(0, len(h), CHUNK)) * 2 > len(h)))
            n.append(len(h))
            halvings.append(k)
            odd.append(places)
            keys.append(band_keys(h))
        longs = pa.list_(pa.int64())
        arrays = [b.column(0), pa.array(node, pa.int64()), pa.array(fp, pa.int64()), pa.array(n, pa.int32()), pa.array(halvings, pa.int32()), pa.array(odd, longs), pa.array(keys, longs)]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "node", "fp", "n", "halvings", "odd", "keys"])


def _may_match(a: str, b: str) -> F.Column:
    """Whether the counts and odd sketches of two members leave 0.8 possible."""
    x, y = (lambda name: F.col(a + name)), (lambda name: F.col(b + name))
    k = F.greatest(x("halvings"), y("halvings"))
    same_rate = [F.slice(side("odd"), (k - side("halvings")) * LONGS + 1, LONGS) for side in (x, y)]
    apart = F.aggregate(F.zip_with(*same_rate, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda p, q: p + q)
    most = (x("n") + y("n")) / 9.0
    expected = most / F.pow(F.lit(2.0), k)
    return (x("n") * 5 >= y("n") * 4) & (y("n") * 5 >= x("n") * 4) & (apart <= F.when(k == 0, most).otherwise(expected + 6 * F.sqrt(expected) + 6))


def facts_of(nodes: DataFrame, some: DataFrame) -> DataFrame:
    """(node, x) of the nodes in ``some``: what _may_match() asks of a member."""
    return cut(nodes.select("node", F.struct("node", "n", "halvings", "odd").alias("x")).join(some.select("node").distinct(), "node", "left_semi"), "copies-facts")


def hopeful(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) of nodes whose counts and sketches leave 0.8 possible; one node may be in any share of them."""
    pairs = cut(pairs, "copies-met")
    total = pairs.count()
    facts = facts_of(nodes, pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))))
    for side, x in (("a", "x"), ("b", "y")):
        times = cut(pairs.groupBy(side).agg(F.count("*").alias("times")), "copies-times")
        pairs = join_groups(pairs, facts.withColumnsRenamed({"node": side, "x": x}).join(times, side), [side], "times", total).drop("times")
    return pairs.filter(_may_match("x.", "y.")).select("a", "b")


def similar(docs: DataFrame, text: str, pairs: DataFrame) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) of nodes whose sets of shingles have a similarity of 0.8 or more."""
    pairs = asked = cut(pairs, "copies-pairs")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    marks = np.zeros(MARKS, bool)  # spares texts that are in no pair; of bounded size, the join decides
    marks[nodes.select(F.pmod("node", F.lit(MARKS)).cast("int").alias("m")).distinct().toArrow().column("m").to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(marks))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.unpackbits(shared.value)
        for b in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            found = {node: w for w in _words(b.column(0)) if there[(node := node_of(w)) % MARKS]}
            hashes = [shingles(w).view(np.int64) for w in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["node", "hashes"])

    known = docs.select(text).mapInArrow(sets, "node long, hashes array<long>").join(nodes.distinct(), "node", "left_semi")
    known = cut(known.groupBy("node").agg(F.first("hashes").alias("hashes")), "copies-sets")
    total = pairs.count()
    for side in ("b", "a"):
        times = cut(pairs.groupBy(side).agg(F.count("*").alias("times")), "copies-times")
        pairs = join_groups(pairs, known.withColumnsRenamed({"node": side, "hashes": f"{side}_hashes"}).join(times, side), [side], "times", total).drop("times")
    both = F.size(F.array_intersect("a_hashes", "b_hashes"))
    found = cut(pairs.filter(both * 5 >= (F.size("a_hashes") + F.size("b_hashes") - both) * 4).select("a", "b"), "copies-similar")
    discard(known)
    discard(asked)
    return found


def golay_stars(nodes: DataFrame) -> DataFrame:
    """(x, y) members whose fingerprints are equal or linked through a Golay key's smallest; y is the first with its fingerprint."""
    first = cut(nodes.groupBy("fp").agg(F.min("node").alias("y"), F.count("*").alias("m")), "copies-fps")
    links = hub_links(first.select("fp"), first.count()).unionByName(first.filter("m > 1").select("fp", F.col("fp").alias("hub")))
    near = links.join(first.select(F.col("fp").alias("hub"), "y"), "hub").join(first.select("fp", "m"), "fp")
    return join_groups(nodes.select("fp", F.col("node").alias("x")), cut(near.select("fp", "m", "y"), "copies-near"), ["fp"], "m", nodes.count()).select("x", "y")


def golay_pairs(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, b) members of different parts (node, part) whose fingerprints are equal or linked by the probes of operator 6, and that may be at 0.8."""
    placed = cut(nodes.select("node", "fp").join(parts, "node").select("node", "fp", "part"), "copies-golay")
    kinds = cut(placed.select("fp", "part").distinct(), "copies-kinds")
    same = kinds.join(kinds.select("fp", F.col("part").alias("part2")), "fp").filter("part < part2").select("fp", "part", F.col("fp").alias("fp2"), "part2")
    near = cut(probe_links(kinds).distinct().unionByName(same), "copies-probes")
    ends = near.select("fp", "part").unionByName(near.select(F.col("fp2").alias("fp"), F.col("part2").alias("part"))).distinct()
    placed = cut(placed.join(ends, ["fp", "part"], "left_semi"), "copies-near-placed")
    placed = placed.join(facts_of(nodes, placed), "node").select("fp", "part", "x")
    met = near.join(placed, ["fp", "part"]).join(placed.select(F.col("fp").alias("fp2"), F.col("part").alias("part2"), F.col("x").alias("y")), ["fp2", "part2"])
    return met.filter(_may_match("x.", "y.")).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def link_copies(docs: DataFrame, text: str, nodes: DataFrame) -> DataFrame:
    """(node, part): part is the smallest node reachable by links of similarity 0.8 or more."""
    total = nodes.count() * BANDS
    index = nodes.select(F.explode("keys").alias("key"), "node")
    counts = cut(index.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "copies-keys")
    shared = cut(join_groups(index, counts, ["key"], "m", total), "copies-shared")
    weights = shared.groupBy("node").agg(F.sum("m").alias("weight"))
    members = cut(shared.join(weights, "node").select("key", "m", F.struct("weight", "node").alias("x")), "copies-members")

    hubs = cut(members.groupBy("key", "m").agg(F.max("x").alias("y")), "copies-hubs")
    stars = join_groups(members.select("key", "x"), hubs, ["key"], "m", total).select("x.node", F.col("y.node").alias("hub")).unionByName(golay_stars(nodes).toDF("node", "hub"))
    stars = stars.filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    first = connected_components(similar(docs, text, hopeful(nodes, stars)), "a", "b")
    parts = cut(nodes.select("node").join(first, "node", "left").select("node", F.coalesce("component", "node").alias("part")), "copies-parts")

    placed = cut(members.withColumn("node", F.col("x.node")).join(parts, "node").select("key", "m", "x", "part"), "copies-placed")
    mixed = placed.groupBy("key", "m").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.max_by("part", "x").alias("main")).filter("lo <> hi")
    left_over = join_groups(placed.drop("m"), cut(mixed.select("key", F.col("m").alias("size"), "main"), "copies-mixed"), ["key"], "size", total)
    left_over = cut(left_over.select("key", "size", "main", "part", "x.node"), "copies-left-over")
    left_over = left_over.join(facts_of(nodes, left_over), "node").drop("node")
    blocks = F.ceil(F.col("size") / BLOCK)
    own = left_over.withColumn("own", F.pmod(F.xxhash64("x.node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    # one of each pair isn't in the key's main part
    x = own.filter("part <> main").select("key", F.col("own").alias("u"), F.col("other").alias("v"), "x", F.col("part").alias("x_part"), "main")
    y = own.select("key", F.col("other").alias("u"), F.col("own").alias("v"), F.col("x").alias("y"), F.col("part").alias("y_part"))
    once = (F.col("y_part") == F.col("main")) | (F.col("x.node") < F.col("y.node"))
    met = x.join(y, ["key", "u", "v"]).filter(once & (F.col("x_part") != F.col("y_part")) & _may_match("x.", "y.")).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    more = similar(docs, text, met.unionByName(golay_pairs(nodes, parts)).distinct())
    part = lambda side: parts.select(F.col("node").alias(side), F.col("part").alias(f"{side}_part"))
    joined = connected_components(more.join(part("a"), "a").join(part("b"), "b"), "a_part", "b_part").withColumnRenamed("node", "part")
    return relabel(parts, joined, "part", "component", total)


def node_column(text: str) -> Column:
    """node_of() of a text column."""
    return F.xxhash64(F.trim(F.regexp_replace(ascii_lower(F.col(text)), r"[\x20\x09-\x0D]+", " ")))


def grouped(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id and node of every row; node, part, its rows and smallest id of every node; the number of nodes)."""
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    made = cut(docs.select(doc_id, text).mapInArrow(_sketches, f"doc_id {kind}, node long, fp long, n int, halvings int, odd array<long>, keys array<long>"), "copies-rows")
    same = made.groupBy("node").agg(F.min("doc_id").alias("low_id"), F.count("*").alias("rows"), *(F.first(c).alias(c) for c in ("fp", "n", "halvings", "odd", "keys")))
    nodes, rows = cut(same, "copies-nodes"), cut(made.select("doc_id", "node"), "copies-where")
    discard(made)
    return rows, cut(link_copies(docs, text, nodes), "copies-linked").join(nodes.select("node", "low_id", "rows"), "node"), nodes.count()


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable) for every row."""
    rows, linked, total = grouped(docs, doc_id, text)
    ids = cut(linked.groupBy("part").agg(F.min("low_id").alias("component_id"), F.count("*").alias("nodes")), "copies-ids")
    groups = cut(join_groups(linked, ids, ["part"], "nodes", total).select("node", "rows", "component_id"), "copies-groups")
    return join_groups(rows, groups, ["node"], "rows", rows.count()).select("doc_id", "component_id")


def keep_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of ``docs``, with all its columns: the one with the smallest id.

    Rows are told apart by id and words: of rows with the smallest id the one whose words
    hash lowest stays, of rows that repeat both the one that sorts first as JSON. Null ids come last.
    """
    rows, linked, total = grouped(docs, doc_id, text)
    best = F.min(F.struct(F.col("low_id").isNull().alias("none"), "low_id", "node")).alias("best")
    several = cut(linked.groupBy("part").agg(best, F.count("*").alias("nodes"), F.sum("rows").alias("of")).filter("of > 1"), "copies-several")
    groups = cut(join_groups(linked, several, ["part"], "nodes", total).select("node", "rows", "best"), "copies-groups")
    seen = join_groups(rows, groups, ["node"], "rows", rows.count()).groupBy(F.col("doc_id").alias("_id"), F.col("node").alias("_words"))
    stays = F.first((F.col("node") == F.col("best.node")) & F.col("doc_id").eqNullSafe(F.col("best.low_id"))).alias("stays")
    seen = cut(seen.agg(stays, F.count("*").alias("times")).filter("not stays or times > 1"), "copies-dropped")
    keyed = docs.withColumn("_of", node_column(text))
    of = (keyed["_of"] == seen["_words"]) & keyed[doc_id].eqNullSafe(seen["_id"])
    kept = keyed.join(seen, of, "left_anti").select(*docs.columns)
    if seen.filter("stays").isEmpty():
        return kept
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = keyed.join(seen.filter("stays"), of, "left_semi").groupBy("_of", doc_id).agg(F.min_by(whole, F.to_json(whole)).alias("_row")).select("_row.*")
    return kept.unionByName(repeated)
