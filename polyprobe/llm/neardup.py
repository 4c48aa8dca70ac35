"""MinHash near-duplicates: one-permutation hashing, banded buckets, star-shaped candidates, confirmed links.

One hash per shingle fills ``BINS`` bins (the top bits choose the bin, the
smallest value stays).  An empty bin borrows from the first filled bin in its
own fixed random sequence, so each bin agrees between two sets with
probability equal to their similarity, whatever the set size (optimal
densification).  ``BANDS`` bands of ``BINS / BANDS`` bins name buckets; at
similarity 0.8 all bands of a pair miss with probability 5e-8.

Documents with equal shingle sets are one class before anything is paired, and
a bucket offers star edges (hub to member), never all pairs.  A star may miss
a link between two members that both fail against its hub, so buckets that still
span several components get further hubs, sixteen times as many each round,
until no pair of different components is left untried.  An exact bound on what
two sets can share spares nearly all of these pairs.  All links are confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from polyprobe.llm.common import batch_of, mixed, release, signed, slices, stored, windows, words

BINS = 128
BANDS = 32
#: Members up to which a shingle's pairs are counted one by one when buckets are worked out.
RARE = 16
#: Length of the random sequence from which an empty bin borrows.
_TRIES = 2048
_DONORS = np.random.default_rng(20170806).integers(0, BINS, (_TRIES, BINS))


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    for part in slices(texts):
        found = words(part, fold_case=True)
        hashes, bounds = windows(found, size)
        for row in range(len(bounds) - 1):
            own = hashes[bounds[row]: bounds[row + 1]]
            if not len(own):
                w = found.hash[found.first[row]: found.first[row + 1]]
                if len(w):
                    # Mixed apart from windows: "a b" and "a b c d" never agree.
                    total = np.full(1, len(w), np.uint64)
                    for h in w:
                        total = mixed(total + h)
                    own = total
            own = np.sort(own)
            yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def one_permutation(hashes: np.ndarray) -> np.ndarray:
    """Densified signature of sorted distinct hashes."""
    which = (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
    values = np.zeros(BINS, np.uint64)
    filled = np.zeros(BINS, bool)
    values[which[first]] = hashes[first]
    filled[which[first]] = True
    donor = np.arange(BINS)
    empty = np.flatnonzero(~filled)
    for t in range(0, _TRIES, 32):
        if not len(empty):
            break
        tries = _DONORS[t: t + 32][:, empty]
        hit = filled[tries]
        done = hit.any(axis=0)
        donor[empty[done]] = tries[hit.argmax(axis=0), np.arange(len(empty))][done]
        empty = empty[~done]
    if len(empty):  # about one text in 10**5 with a single filled bin
        donor[empty] = which[first[0]]
    return values[donor]


def _band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, -1)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(rows.shape[1]):
        total = mixed(total + rows[:, k])
    return total


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """Per row: id, set size, two hashes that name the set, and its band keys (none for a set without members)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()),
                        ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            n, a, b, bands, lengths = [], [], [], [], []
            for own in shingle_sets(batch.column(1), size):
                n.append(len(own))
                a.append(own.sum(dtype=np.uint64))
                b.append(mixed(own).sum(dtype=np.uint64))
                lengths.append(BANDS if len(own) else 0)
                if len(own):
                    bands.append(_band_keys(one_permutation(own)))
            flat = np.concatenate(bands) if bands else np.zeros(0, np.uint64)
            starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n, pa.int64()), pa.array(signed(np.array(a, np.uint64))),
                pa.array(signed(np.array(b, np.uint64))),
                pa.ListArray.from_arrays(pa.array(starts), pa.array(signed(flat)))], schema=schema)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose full shingle sets have ``100 * both >= percent * either``."""

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            both = zip(shingle_sets(batch.column(2), size), shingle_sets(batch.column(3), size))
            for i, (x, y) in enumerate(both):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = bool(common) and 100 * common >= percent * (len(x) + len(y) - common)
            yield batch_of(schema, a=batch.column(0).to_numpy()[keep], b=batch.column(1).to_numpy()[keep])

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b") \
        .mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, name: str) -> DataFrame:
    """Smallest reachable node of every node that has an edge: (node, label).

    Large-star and small-star steps alternate until nothing changes; the number
    of steps grows with the logarithm of the longest path.
    """
    pairs = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .where("u <> v").distinct(), name)
    mark = F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    last = None
    while (now := pairs.agg(*mark).first()) != last:
        last = now
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v") \
            .unionByName(least.select("u", F.col("m").alias("v")))
        pairs = stored(small.distinct(), name)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()


def still_open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (key, rep, ...) of the buckets whose members span several components, with each member's label."""
    named = buckets.join(labels.withColumnRenamed("node", "rep"), "rep", "left") \
        .withColumn("label", F.coalesce("label", "rep"))
    mixed_keys = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    return named.join(mixed_keys.select("key"), "key", "left_semi")


def shared_shingles(buckets: DataFrame, texts: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """What open members can share at all, which bounds the similarity of a pair exactly.

    Shingles of at most ``RARE`` open members are counted pair by pair: (a, b,
    rare).  The others only bound: a pair shares no more of them than the
    smaller of both members' numbers (rep, frequent).  An edit makes rare
    shingles, so heavily edited copies of one text fall to the bound.
    """
    members = buckets.select(F.col("rep").alias("doc_id")).distinct()
    schema = pa.schema([("rep", pa.int64()), ("h", pa.int64())])

    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), size))
            ids = np.repeat(batch.column(0).to_numpy(), [len(x) for x in sets])
            yield batch_of(schema, rep=ids, h=signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64))

    rows = stored(texts.join(members, "doc_id").select("doc_id", "text").mapInArrow(run, "rep bigint, h bigint"),
                  "shingles")
    spread = stored(rows.join(rows.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "h"), "shingles")
    frequent = spread.where(F.col("c") > RARE).groupBy("rep").agg(F.count("*").alias("frequent"))
    few = spread.where(F.col("c") <= RARE).groupBy("h").agg(F.array_sort(F.collect_set("rep")).alias("reps"))
    rare = few.select("reps", F.explode("reps").alias("a")) \
        .select("a", F.explode(F.filter("reps", lambda x: x > F.col("a"))).alias("b")) \
        .groupBy("a", "b").agg(F.count("*").alias("rare"))
    return frequent, rare


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                    percent: int = 80) -> DataFrame:
    """Component of every document under near-duplicate links.

    Returns doc_id, n_shingles, component_id (smallest reachable id), kept.
    Null, empty and blank texts have no shingles, link with nothing and are
    kept; rows with a null id are left out, as nothing could name them; rows
    that repeat an id count as one document per distinct text of it and share
    a component.  Other columns of ``docs`` are ignored, so their names can't
    clash.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .where("doc_id is not null")
    all_sets = stored(sketches(texts, size=size), "sketches")
    sets = all_sets.where("n_shingles > 0")
    named = ["set_a", "set_b", "n_shingles"]
    classes = sets.groupBy(named).agg(F.min("doc_id").alias("rep"))
    members = stored(sets.select("doc_id", *named).join(classes, named).select("doc_id", "rep"), "members")
    reps = members.select("rep").distinct()
    rows = sets.join(reps, sets.doc_id == reps.rep).select("rep", "n_shingles", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).where("hub < top")
    crowded = stored(rows.join(shared.select("key", "hub"), "key").distinct(), "buckets")
    # Only texts that share a bucket are moved, and once.
    close = stored(texts.join(crowded.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts")
    # First each member tries one hub, the smallest any of its buckets offers.
    tried = stored(crowded.where("rep > hub").groupBy(F.col("rep").alias("b")).agg(F.min("hub").alias("a"))
                   .select("a", "b"), "pairs")
    links = stored(confirmed(tried, close, size, percent), "links")
    labels = components(links, "labels")
    release(spark)
    rest = still_open(crowded.select("key", "rep", "n_shingles"), labels)
    rest = stored(rest, "open")
    frequent, rare = shared_shingles(rest, close, size)
    rest = stored(rest.join(frequent, "rep", "left").withColumn("frequent", F.coalesce("frequent", F.lit(0))), "open")
    release(spark)

    def possible(common, na, nb):
        return 100 * common >= percent * (F.col(na) + F.col(nb) - common)

    ends = rest.groupBy("rep").agg(F.first("n_shingles").alias("n"), F.first("frequent").alias("f"),
                                   F.first("label").alias("l"))
    by_rare = rare.join(ends.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("f").alias("fa"),
                                    F.col("l").alias("la")), "a") \
        .join(ends.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("f").alias("fb"),
                          F.col("l").alias("lb")), "b") \
        .where((F.col("la") != F.col("lb")) & possible(F.least("fa", "fb") + F.col("rare"), "na", "nb")).select("a", "b")
    for hubs_each in (16 ** k for k in range(1, 16)):
        # A pair that shares several open buckets is offered in the one with the smallest key.
        placed = stored(rest.join(rest.groupBy("rep").agg(F.collect_set("key").alias("keys")), "rep"), "open")
        hubs = placed.withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("rep"))) \
            .where(F.col("at") <= hubs_each) \
            .select("key", F.col("rep").alias("a"), F.col("label").alias("la"), F.col("n_shingles").alias("na"),
                    F.col("frequent").alias("fa"), F.col("keys").alias("ka"))
        offered = hubs.join(placed, "key").where(
            (F.col("rep") > F.col("a")) & (F.col("label") != F.col("la"))
            & possible(F.least("fa", "frequent"), "na", "n_shingles")
            & (F.array_min(F.array_intersect("ka", "keys")) == F.col("key")))
        offered = offered.select("a", F.col("rep").alias("b"))
        if by_rare is not None:
            offered, by_rare = offered.unionByName(by_rare), None
        fresh = stored(offered.distinct()
                       .join(tried, ["a", "b"], "left_anti"), "pairs")
        found = stored(confirmed(fresh, close, size, percent), "links")
        # What each bucket still has to try: members beyond its hubs, if they span components.
        passed = hubs.groupBy("key").agg(F.max("a").alias("passed"), F.count("*").alias("tried"))
        beyond = rest.drop("label").join(passed.where(F.col("tried") == hubs_each), "key") \
            .where(F.col("rep") > F.col("passed")).drop("passed", "tried")
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = components(links, "labels")
        tried = tried.unionByName(fresh)
        rest = stored(still_open(beyond, labels), "open")
        release(spark)
        if rest.isEmpty():
            break
    named = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left") \
        .select("doc_id", F.coalesce("label", "rep").alias("component_id"))
    # An id that repeats with different texts joins their components.
    out = all_sets.select("doc_id", "n_shingles").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    return out.join(named.groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "doc_id", "left") \
        .withColumn("component_id", F.coalesce("component_id", "doc_id")) \
        .withColumn("kept", F.col("component_id") == F.col("doc_id"))
