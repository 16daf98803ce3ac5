"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of ``64 * k`` bits is cut into segments. Two fingerprints that differ in at most ``d`` bits differ in
at most one bit of some segment once there are ``d // 2 + 1`` segments. A segment's *variants* are the segment with
one of its bits wiped out; segments that differ in at most one bit share a variant. So candidates come from an
equality join on (position of the wiped bit, rest of the segment), and a bit count inside the join verifies them.

Dense groups (thousands of near copies share their buckets) do not give all pairs: a first pass links every
fingerprint of a bucket to the bucket's smallest one only, the components of these links are labelled, and
the second pass pairs only fingerprints of a bucket that carry different labels. No link between two
components is lost, and pairs inside one need not be written.

``one_of_each`` asks for a Jaccard similarity, of which fingerprints tell only part: their bits follow the cosine of shingle
counts, so a copy with a run of words appended, cut off or inserted may differ in more bits than any number of segments can
bridge. Its candidates are the links of deletion variants together with pairs that share a band of min-hashes, which depends
on the similarity alone, and the exact similarity decides. In the first pass a node tries the closest of its buckets' smallest
members only, of either kind; the second pass pairs what then carries different labels, by deletion variants and by bands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, joined_evenly, saved, small_batches, words

_CHUNK = 1 << 15  # shingles whose bits are unpacked at once
#: Buckets of fewer members are searched for pairs even if all are linked already.
DENSE = 32


def shingles(tokens: list[bytes], size: int) -> Iterator[bytes]:
    """Runs of ``size`` words, repeats included; a shorter sequence is one shingle, an empty one none."""
    if len(tokens) <= size:
        return iter([b" ".join(tokens)] if tokens else [])
    return map(b" ".join, zip(*(tokens[i:] for i in range(size))))


def fingerprint(tokens: list[bytes], size: int, lanes: int = 1, seed: int = 42) -> np.ndarray:
    """``lanes`` unsigned 64-bit numbers; a bit is 1 if set in over half the shingles' hashes. No shingle: zeros.

    Lane ``i`` hashes with seed ``seed + i``. Bits are counted in blocks, so memory doesn't grow with the text.
    """
    out = np.zeros(lanes, dtype="<u8")
    for lane in range(lanes):
        ones, n, source = np.zeros(64, dtype=np.int64), 0, shingles(tokens, size)
        while True:
            block = np.fromiter(
                (xxhash.xxh64_intdigest(s, seed + lane) for s, _ in zip(source, range(_CHUNK))), dtype="<u8"
            )
            if not len(block):
                break
            ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(block)
            if len(block) < _CHUNK:
                break
        if n:
            out[lane] = np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0]
    return out


_ODD = np.random.default_rng(9).integers(0, 1 << 62, 128, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Bands of min-hashes and hashes a band: sets of similarity 0.8 share no band in 0.005 % of cases, sets of 0.5 in 45 %.
BANDS, BAND_HASHES = 25, 5


def min_hashes(tokens: list[bytes], size: int) -> tuple[np.ndarray, int]:
    """128 minimum hashes of the shingles, one of which is equal in two texts with a chance of their Jaccard similarity, and
    the fingerprint of the same shingles' hashes."""
    least, source = np.full(128, np.iinfo(np.uint64).max, dtype=np.uint64), shingles(tokens, size)
    ones, n = np.zeros(64, dtype=np.int64), 0
    while True:
        block = np.fromiter((xxhash.xxh64_intdigest(s, 3) for s, _ in zip(source, range(4096))), dtype="<u8")
        if not len(block):
            break
        np.minimum(least, (block[:, None] * _ODD).min(0), out=least)
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(block)
    return least, int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def sketch(least: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers: a bit of each minimum hash. Bits differ with half of 1 - Jaccard."""
    return np.packbits((least >> np.uint64(23)).astype(np.uint8) & 1, bitorder="little").view("<u8")


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of the minimum hashes."""
    rows = least[: BANDS * BAND_HASHES].astype("<u8").reshape(BANDS, BAND_HASHES)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(rows)], dtype="<u8")


def with_fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id and the fingerprint ``f0`` (a long with the bits of the unsigned number) of every row's text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(words(text.as_py()), size)[0] for text in batch.column(1)], dtype="<u8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view("<i8"))], names=["doc_id", "f0"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, f0 long")


def with_bands(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, ``same``, the fingerprint ``f0``, the sketch ``m0``, ``m1`` and the keys ``bands`` of the shingles of ``size`` words of
    every row's text.

    ``same`` is the XXH64 of the normalised words: rows of equal words share it.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, bands = np.zeros((batch.num_rows, 4), dtype="<u8"), np.zeros((batch.num_rows, BANDS), dtype="<u8")
            for i, text in enumerate(batch.column(1)):
                tokens = words(text.as_py())
                least, prints = min_hashes(tokens, size)
                numbers[i] = xxhash.xxh64_intdigest(b" ".join(tokens), 7), prints, *sketch(least)
                bands[i] = band_keys(least)
            ends = pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(numbers[:, i].copy().view("<i8")) for i in range(4)),
                 pa.ListArray.from_arrays(ends, pa.array(bands.reshape(-1).view("<i8")))],
                names=["doc_id", "same", "f0", "m0", "m1", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, same long, f0 long, m0 long, m1 long, bands array<long>"
    )


def segments(lanes: int, count: int) -> list[tuple[int, int, int]]:
    """(lane, first bit, width) of the segments of every lane, ``count`` a lane, as even as possible."""
    edges = [round(i * 64 / count) for i in range(count + 1)]
    return [(lane, a, b - a) for lane in range(lanes) for a, b in zip(edges, edges[1:])]


def variants(lanes: int, count: int):
    """Array column of the one-wildcard variants: ``key``, the number of the wiped bit above, the rest of the segment below,
    and ``own``, the wiped bit itself, plus 2 for the first variant of a segment."""
    keys, number = [], 0
    for lane, first, width in segments(lanes, count):
        part = f"(shiftrightunsigned(f{lane}, {first}) & {(1 << width) - 1}L)"
        for bit in range(width):
            key = f"({part} & {((1 << width) - 1) ^ (1 << bit)}L) | {number << 32}L"
            own = f"CAST(shiftrightunsigned(f{lane}, {first + bit}) & 1L AS INT)" + (" + 2" if bit == 0 else "")
            keys.append(f"named_struct('key', {key}, 'own', {own})")
            number += 1
    return F.expr(f"array({', '.join(keys)})")


def links(nodes: DataFrame, lanes: int, count: int, most: int) -> DataFrame:
    """(node, component) of all nodes that have a link; nodes: (node, f0, ...), one row each.

    ``most``: the differing bits allowed over all lanes.
    """
    prints = [f"f{i}" for i in range(lanes)]
    return _linked(nodes.select("node", *prints), [(variants(lanes, count), prints, prints, most)])


def _by_key(rows: DataFrame, keys: Column, source: list[str], compared: list[str]) -> DataFrame:
    """A row for each key of each node: key, own, node and what is compared (and ``label``, where there is one).

    A node becomes many rows, so even few bytes of nodes are dealt over all tasks first. The rows are then shuffled
    once, by their key; what follows stays in these partitions and reads the same shuffle again.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in rows.columns)).repartition(tasks)
    kept = [c for c in rows.columns if c not in source or c in compared]
    return whole.select(F.explode(keys).alias("v"), *kept).select("v.key", "v.own", *kept).where("key IS NOT NULL").repartition(
        tasks, "key")


def _bits(x: str, y: str, compared: list[str]) -> str:
    return " + ".join(f"bit_count({x}.{n} ^ {y}.{n})" for n in compared)


def _stars(nodes: DataFrame, keys: Column, source: list[str], compared: list[str], most: int) -> DataFrame:
    """Pairs (a, b, bits) of each key's smallest node and its others that differ in at most ``most`` bits."""
    keyed = _by_key(nodes.select("node", *dict.fromkeys([*source, *compared])), keys, source, compared).alias("keyed")
    lead = keyed.groupBy("key").agg(
        F.min("node").alias("node"), *(F.min_by(n, "node").alias(n) for n in compared), F.count("*").alias("n")
    ).where("n > 1").drop("n").alias("lead")
    bits = _bits("keyed", "lead", compared)
    return (
        keyed.join(lead, F.expr(f"keyed.key = lead.key AND keyed.node <> lead.node AND {bits} <= {most}"))
        .select(F.col("lead.node").alias("a"), F.col("keyed.node").alias("b"), F.expr(bits).alias("bits")).distinct()
    )


def _across(labelled: DataFrame, keys: Column, source: list[str], compared: list[str], most: int) -> DataFrame:
    """Pairs (a, b) of nodes that share a key, carry different labels and differ in at most ``most`` bits."""
    keyed = _by_key(labelled.select("node", "label", *dict.fromkeys([*source, *compared])), keys, source, compared)
    # Large buckets whose members are all linked have nothing to add.
    done = keyed.groupBy("key").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")
    ).where(f"low = high AND n >= {DENSE}").select("key")
    rest = keyed.join(done, "key", "left_anti")
    return (
        rest.alias("x").join(
            rest.alias("y"),
            # Equal segments share all variants: they meet in the first one only.
            F.expr("x.key = y.key AND x.node < y.node AND x.label <> y.label AND (x.own <> y.own OR x.own >= 2) AND "
                   f"{_bits('x', 'y', compared)} <= {most}"),
        )
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    )


#: Keys, the columns they are made of, the columns that are compared, and the bits that may differ.
Kind = tuple[Column, list[str], list[str], int]


def _linked(
    nodes: DataFrame, kinds: list[Kind], verify: Callable[[DataFrame], DataFrame] | None = None, leads: int | None = None
) -> DataFrame:
    """(node, component) of all nodes that have a link; nodes: (node, the columns that the kinds name).

    A kind's keys are an array of (key, own) as ``variants`` gives it. Nodes link if they share a key of some kind and the columns
    it compares differ in at most as many bits as it allows; ``verify`` may drop pairs from a frame (a, b) of such nodes. With
    ``leads``, a node tries only as many of each kind's closest buckets in the first pass; what they leave out is left to the
    second pass, which tries the pairs of every kind.
    """
    names = list(dict.fromkeys(name for _, source, compared, _ in kinds for name in (*source, *compared)))
    check = verify or (lambda pairs: pairs)
    closest = Window.partitionBy("b").orderBy("bits", "a")
    stars = [_stars(nodes, *kind) for kind in kinds]
    if leads:
        stars = [s.withColumn("turn", F.row_number().over(closest)).where(F.col("turn") <= leads) for s in stars]
    first = saved(check(reduce(DataFrame.unionByName, (s.select("a", "b") for s in stars)).distinct()), "stars")
    labels = components(first)

    labelled = saved(
        nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("label"), *names),
        "labelled",
    )
    across = reduce(DataFrame.unionByName, (_across(labelled, *kind) for kind in kinds))
    return components(first.unionByName(check(across.distinct() if len(kinds) > 1 else across)))


def near_duplicates(docs: DataFrame, size: int = 4, most: int = 4) -> DataFrame:
    """Fingerprint and component of every row: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at ``most`` or fewer differing bits; component_id is the smallest doc_id reachable.
    Null and empty texts have fingerprint zero and link like any other. Rows with a null doc_id get a fingerprint and
    a null component and link nothing. A repeated doc_id gives a row each, and its fingerprints count as one
    document: a component reaches through it. Extra columns are ignored; an empty table gives no rows.
    """
    prints = saved(with_fingerprints(docs, size).select("doc_id", "f0"), "prints")
    known = prints.where("doc_id IS NOT NULL")
    of = known.groupBy("f0").agg(F.min("doc_id").alias("node"))
    joined = links(of.select("node", "f0"), 1, most // 2 + 1, most) if most else None
    roots = of if joined is None else (
        of.join(joined, "node", "left").select("f0", F.coalesce("component", "node").alias("node"))
    )
    # Rows per fingerprint are known, so one that a share of all rows has doesn't end up in one task.
    sizes = known.groupBy("f0").agg(F.count("*").alias("rows"))
    facts = saved(roots.withColumnRenamed("node", "root").join(sizes, "f0"), "roots")
    members = joined_evenly(known, facts, "f0", "rows").select("doc_id", "f0", "root")
    # A doc_id that has several fingerprints ties their components together.
    ties = members.groupBy("doc_id").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    tied = components(ties.select("a", "b"))
    whole = members.join(tied.withColumnRenamed("node", "root"), "root", "left").select(
        "doc_id", "f0", F.coalesce("component", "root").alias("component_id")
    )
    out = whole.unionByName(
        prints.where("doc_id IS NULL").withColumn("component_id", F.lit(None).cast("long"))
    )
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


#: Bits of the 128 of two sketches that may differ before the exact check. At similarity 0.8 a bit differs with a chance of a tenth:
#: more than 32 do in 3 of 10 million pairs right at the bound.
SKETCH_BITS = 32
#: Bits of two fingerprints that may differ in links by deletion variants: two segments of 32 bits.
PRINT_BITS = 3
#: Closest leads of either kind that a node tries in the first pass. What isn't linked there is left to the second.
LEADS = 2
#: Sets that one task compares with a hub's set.
HUB_PAIRS = 2000


def _shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """id and the distinct hashes of the shingles of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for text in batch.column(1):
                found = {xxhash.xxh64_intdigest(s, 1) for s in shingles(words(text.as_py()), size)}
                sets.append(np.fromiter(found, dtype="<u8", count=len(found)).view("<i8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "set"])

    return docs.mapInArrow(run, "id long, set array<long>")


def one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows with all their columns, but one document of each group of near copies: that with the smallest doc_id.

    Documents link if their sets of ``size``-word shingles have a Jaccard similarity of ``similarity`` or more; a group is what
    links reach. Candidates are documents whose fingerprints share a deletion variant and differ in at most ``PRINT_BITS``
    bits, and documents that share a band of min-hashes and have close sketches; all are checked exactly. Equal words are copies
    whatever their spaces and A-Z case. Texts without words are copies of each other. Of rows that repeat an id all stay if one does; rows with a null
    id stay.
    """
    names = ["same", "f0", "m0", "m1"]
    prints = saved(with_bands(docs, size).where("doc_id IS NOT NULL"), "prints")
    # Equal words have equal bands.
    groups = saved(prints.groupBy(*names).agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "groups")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id IS NOT NULL")

    # A node may be the smallest id of several texts if ids repeat: one row a node and text is enough.
    nodes = groups.groupBy("node").agg(F.min(F.struct(*names, "bands")).alias("row")).select(
        "node", *[f"row.{c}" for c in (*names[1:], "bands")])
    bands = F.expr("transform(bands, b -> named_struct('key', b, 'own', 2))")
    kinds = [(variants(1, PRINT_BITS // 2 + 1), ["f0"], ["f0"], PRINT_BITS), (bands, ["bands"], ["m0", "m1"], SKETCH_BITS)]
    joined = _linked(nodes, kinds, lambda pairs: _similar(pairs, texts, size, similarity), LEADS)
    keepers = groups.join(joined, "node", "left").select(*names, F.coalesce("component", "node").alias("keeper"))
    gone = (
        prints.select("doc_id", *names).join(keepers, names).groupBy("doc_id").agg(F.min("keeper").alias("keeper"))
        .where("keeper <> doc_id").select(F.col("doc_id").alias("gone_id"))
    )
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return row.join(gone, F.col("row.doc_id").cast("long") == F.col("gone_id"), "left_anti").select("row.*")


def _similar(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of ids whose texts' shingle sets have this Jaccard similarity.

    The set of ``b`` travels once a pair; that of ``a``, which may be a hub of many pairs, once for every ``HUB_PAIRS`` of them.
    """
    pairs = saved(pairs, "candidates")
    asked = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = saved(_shingle_sets(texts.join(asked, "id", "left_semi"), size).withColumn("n", F.size("set")), "sets")
    hubs = saved(
        pairs.groupBy("a").agg(F.count("*").alias("pairs")).join(sets.groupBy(F.col("id").alias("a")).agg(
            F.min("n").alias("least"), F.max("n").alias("most")), "a")
        .withColumn("parts", F.ceil(F.col("pairs") / HUB_PAIRS).cast("long")), "hubs")
    # Sets whose sizes differ too much can't be similar; only the others travel. (An id that repeats may have several sets.)
    close = joined_evenly(pairs, hubs, "a", "pairs").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y"), "n"), "b").where(
        (F.col("most") >= F.lit(similarity) * F.col("n") - 1e-9) & (F.col("n") >= F.lit(similarity) * F.col("least") - 1e-9)
    ).select("a", "b", "y", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    spread = sets.select(F.col("id").alias("a"), F.col("set").alias("x")).join(hubs.select("a", "parts"), "a").select(
        "a", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    both = close.join(spread, ["a", "part"])
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared) - 1e-9).where(
        "size(x) > 0").select("a", "b").distinct()
