"""MinHash near-dedup with odd sketches.

1. Each document's set of 5-word shingles gives 128 MinHash samples, which four at a time key 32 bands, and
   one-permutation MinHash samples, one for each of 16384 bins that isn't empty, which are folded into a
   2048-bit parity bitmap, the odd sketch. The population count of two sketches' XOR tells how many samples
   differ; for sets up to some hundred shingles that is nearly the sets' difference itself.
2. Documents with equal sets are one class, for which the smallest doc_id stands.
3. Turns. In each band bucket that holds several classes, all point at one hub, the class that meets most
   others in all its buckets: of a text and its edited copies that is the text. A class keeps the hub that it
   shares most bands with; if sketches allow that pair 0.75, it is confirmed on the full sets. Components
   follow. Buckets that hold several components stay open. While they ask for many comparisons and the last
   turn linked a good share of what it tried, another turn follows, where classes outside the hub's component
   point at the one among them that meets most others.
4. Last round, which alone decides what is whole: classes of open buckets are compared across components.
   Two sets at 0.75 share one of the rarest quarter of either's shingles (counted over the classes of open
   buckets), so only rows of these are joined, where component, size and place in the order allow 0.75. A
   boilerplate passage in unrelated texts is never among the rarest, so it makes no pairs. What sketches
   allow is confirmed on the full sets. Of two rows one is outside the shingle's main component, and a
   frequent shingle's rows outside it are salted over many tasks, so no task takes all pairs of a group.
   Pairs inside a component can't change the result, so all links between components count.

A pair at similarity 0.75 shares no bucket with probability (1 - 0.75**4)**32 < 6e-6; the sketches' bound lies
SIGMAS deviations (estimated from above) beyond what 0.75 gives, which loses less than one such pair in
50,000. Both bounds hold however full buckets are, as there are no caps. Shingles are compared by 61-bit
fingerprints modulo a prime, mixed to 64 bits, and classes by two such sums and the set's size.

Defined results: null or blank text has an empty set, is linked with nothing and kept; rows with one
doc_id are one document, linked if any of them is; a null doc_id is a component of its own (null), kept;
a text of any length is one row of a batch, in some 100 bytes of memory a byte; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rolling as R
from .common import longs, stored, table, text_slices
from .components import components

SHINGLE = 5
#: Link where 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
#: Bins of the one-permutation samples, and bits of the odd sketch they are folded into.
BIN_BITS, BITS = 14, 2048
U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240229))
_A = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * U(2) + U(1)
_B = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
#: Standard deviations by which a pair's sketches may lie above what a similarity of 0.75 gives.
SIGMAS = 4
#: Another turn follows while open buckets ask for more than so many comparisons a row, and the last turn
#: linked one in LINKED of the pairs it tried. Turns only save the last round work: it is whole in any case.
COMPARISONS, LINKED = 64, 8
#: Comparisons by one shingle that a task gets at most; beyond, its rows are dealt to several.
SHARE = 1 << 22
#: At most so many pairs have their ids broadcast (16 MB) to pick texts before the shuffle; beyond, all are shuffled.
FEW_PAIRS = 1_000_000


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents, and where each document's begin (one more)."""
    data = _LOWER[data]
    starts, ends, first = R.word_spans(data, offs)
    words = R.word_hashes(data, starts, ends)
    counts = np.diff(first)
    at, doc = R.starts_of_windows(first, size)
    grams = R.Sums(words).grams(size)
    hashes = grams[at] if len(at) else np.zeros(0, U)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = R.mix(R.Sums(words).ranges(first[short], first[short + 1]) + counts[short].astype(U) * U(0xA24BAED4963EE407))
        hashes, doc = np.concatenate([hashes, whole]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        hashes, doc = hashes[order], doc[order]
    edges = np.searchsorted(doc, np.arange(len(counts) + 1))
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
        hashes[s:e].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(new)])[edges]


def samples(sets: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """MinHash samples, a row for each document that has shingles."""
    starts = edges[:-1][np.diff(edges) > 0]
    out = np.empty((len(starts), SAMPLES), U)
    for i in range(SAMPLES):
        out[:, i] = np.minimum.reduceat(sets * _A[i] + _B[i], starts)
    return out


def sketches(sets: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Odd sketches, as rows of BITS / 64 longs, and the number of samples in each. A sample is the least hash
    of a bin, a bin being all hashes with the same leading bits; sets are sorted, so that is its first."""
    n = len(edges) - 1
    doc = np.repeat(np.arange(n), np.diff(edges))
    bins = sets >> U(64 - BIN_BITS)
    first = np.ones(len(sets), bool)
    first[1:] = (bins[1:] != bins[:-1]) | (doc[1:] != doc[:-1])
    doc = doc[first]
    at = (R.mix(sets[first]) & U(BITS - 1)).astype(np.int64) + doc * BITS
    odd = (np.bincount(at, minlength=n * BITS) & 1).astype(np.uint8).reshape(n, BITS)
    return np.packbits(odd, axis=1).view(np.int64), np.bincount(doc, minlength=n)


def band_keys(mins: np.ndarray) -> np.ndarray:
    m = mins.reshape(len(mins), BANDS, ROWS)
    key = np.zeros(m.shape[:2], U) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = R.mix(key * U(R.BASE) + m[:, :, i])
    return key.view(np.int64)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(b.schema.get_field_index("doc_id"))
        for at, rows, data, offs in text_slices(b, "text"):
            sets, edges = shingle_sets(data, offs)
            n = np.diff(edges)
            full = n > 0
            mins = samples(sets, edges) if full.any() else np.empty((0, SAMPLES), U)
            keys = np.zeros((rows, BANDS), np.int64)
            keys[full] = band_keys(mins)
            bits, filled = sketches(sets, edges)
            one, two = np.zeros(rows, U), np.zeros(rows, U)
            if full.any():
                starts = edges[:-1][full]
                one[full], two[full] = np.add.reduceat(sets, starts), np.bitwise_xor.reduceat(R.mix(sets + U(1)), starts)
            yield pa.RecordBatch.from_arrays([ids.slice(at, rows), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), _lists(keys), _lists(bits), pa.array(filled)], ["doc_id", "n_shingles", "set1", "set2", "bands", "sketch", "filled"])


def _confirm(percent: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = b.column(b.schema.get_field_index("text_a")), b.column(b.schema.get_field_index("text_b"))
            yes = np.zeros(b.num_rows, bool)
            at = 0
            while at < b.num_rows:
                rows = min(64, b.num_rows - at)
                both = pa.concat_arrays([left.slice(at, rows), right.slice(at, rows)])
                got = []
                for _, _, data, offs in text_slices(pa.RecordBatch.from_arrays([both], ["t"]), "t"):
                    sets, edges = shingle_sets(data, offs)
                    got += [sets[s:e] for s, e in zip(edges[:-1].tolist(), edges[1:].tolist())]
                for i in range(rows):
                    x, y = got[i], got[rows + i]
                    if len(x) and len(y):
                        common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                        yes[at + i] = 100 * common >= percent * (len(x) + len(y) - common)
                at += rows
            keep = pa.array(yes)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)).filter(keep) for c in ("a", "b")], ["a", "b"])

    return go


def confirmed(docs: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those pairs (a, b), stored ones, whose full sets are similar enough."""
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    if pairs.count() <= FEW_PAIRS:
        ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        texts = texts.join(F.broadcast(ids), "doc_id", "left_semi")
    texts = texts.dropDuplicates(["doc_id", "text"])
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return both.mapInArrow(_confirm(percent), "a long, b long")


#: What the tests of a pair read of either side; the other side's names end in _b.
SKETCH = ["n_shingles", "filled", "sketch"]


def _bits() -> Column:
    """Bits in which two sketches differ."""
    return sum((F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(BITS // 64)), F.lit(0))


def _may_link() -> Column:
    """Whether sizes and sketches leave a similarity of 0.75 possible.

    At 0.75 the union has (n + n') / 1.75 elements, u of which are samples; 0.75 u of them are common, which
    leaves f + f' - 1.5 u that differ. Not all elements are samples, hence the deviation: twice that of u draws
    from the union, which simulations of 20 to 10,000 shingles stay below. Elements that meet in a bit of the
    sketch only lower the count."""
    bins = float(1 << BIN_BITS)
    total = (F.col("n_shingles") + F.col("n_shingles_b")) / F.lit(1.75)
    u = bins * (1 - F.exp(-total / bins))
    spread = 4 * F.sqrt(0.1875 * u * F.greatest(F.lit(0.0), 1 - u / total)) + 0.75
    most = F.greatest(F.lit(0.0), F.col("filled") + F.col("filled_b") - 1.5 * u) + SIGMAS * spread
    gone = F.exp(-4 * most / BITS)
    odd = BITS / 2 * (1 - F.exp(-2 * most / BITS)) + SIGMAS * F.sqrt(F.greatest(F.lit(0.0), BITS / 4 * (1 - gone) - most * gone))
    sizes = 100 * F.least("n_shingles", "n_shingles_b") >= PERCENT * F.greatest("n_shingles", "n_shingles_b")
    return sizes & (_bits() <= F.least(most, odd))


def _emit_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every shingle: the class's id, its text's tag, the set's size, the shingle."""
    for b in batches:
        ids, tags = longs(b, "a"), longs(b, "tag")
        for at, _, data, offs in text_slices(b, "text"):
            sets, edges = shingle_sets(data, offs)
            n = np.diff(edges)
            doc = np.repeat(np.arange(len(n)), n) + at
            yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(tags[doc]), pa.array(np.repeat(n, n)), pa.array(sets.view(np.int64))], ["a", "tag", "n", "shingle"])


def _linked_sketches(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those pairs (a, b) that sizes and sketches let be similar enough."""
    sketch = classes.select("a", *SKETCH)
    other = classes.select(F.col("a").alias("b"), *[F.col(c).alias(f"{c}_b") for c in SKETCH])
    return pairs.join(sketch, "a").join(other, "b").where(_may_link()).select("a", "b").distinct()


def _across(docs: DataFrame, classes: DataFrame, open_: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components, of the classes open_ (a, group), that sketches let be similar."""
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("a"), F.xxhash64("text").alias("tag"), "text")
    texts = texts.join(open_.select("a"), "a", "left_semi").dropDuplicates(["a", "tag"])
    every = stored(texts.mapInArrow(_emit_sets, "a long, tag long, n long, shingle long"), "minhash-shingles")
    often = every.groupBy("shingle").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    # the order within a set: frequency, then the shingle itself; those that stand once come first, and match none
    seat = Window.partitionBy("a", "tag", "n").orderBy("f", "shingle")
    rows = every.join(often, "shingle").withColumn("from_end", F.count(F.lit(1)).over(Window.partitionBy("a", "tag", "n")) - F.row_number().over(seat))
    need = F.ceil(F.col("n") * F.lit(PERCENT) / F.lit(100))
    rare = rows.where(F.col("from_end") >= need - 1).join(open_, "a").select("shingle", "a", "n", "from_end", "group").distinct()
    rare = stored(rare, "minhash-rare")
    main = rare.groupBy("shingle", "group").agg(F.count(F.lit(1)).alias("n")).groupBy("shingle")
    main = main.agg(F.max(F.struct("n", "group")).alias("most"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    parts = (F.lit(1) + (F.col("all") - F.col("most.n")) * F.col("all") / F.lit(SHARE)).cast("int")
    main = stored(main.select("shingle", F.col("most.group").alias("main"), parts.alias("parts")), "minhash-main")
    left = rare.join(main, "shingle").where("group <> main").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    right = rare.join(main, "shingle").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = right.select("shingle", "part", F.col("a").alias("b"), F.col("n").alias("n_b"), F.col("from_end").alias("from_end_b"), F.col("group").alias("group_b"))
    small, large = F.least("n", "n_b"), F.greatest("n", "n_b")
    # of what comes from this place on, both sets must hold what 0.75 needs
    rest = F.least("from_end", "from_end_b") + 1
    may = (F.col("group") != F.col("group_b")) & ((F.col("group_b") == F.col("main")) | (F.col("a") < F.col("b")))
    may = may & (100 * small >= PERCENT * large) & ((100 + PERCENT) * rest >= PERCENT * (small + large))
    both = left.alias("x").join(right.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.part") == F.col("y.part")) & may)
    return _linked_sketches(both.select("a", "b").distinct(), classes)


def _state(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
    """rows (a, met, buckets, group) with each group's component by groups (id, group)."""
    if groups is not None:
        rows = rows.join(groups.toDF("group", "into"), "group", "left").select("a", "met", "buckets", F.coalesce("into", "group").alias("group"))
    return stored(rows, "minhash-state")


def _merged(state: DataFrame, links: DataFrame) -> DataFrame:
    """state after links (a, b), whose components are sought among the groups they join only."""
    group = state.select("a", "group")
    ends = links.join(group.toDF("a", "x"), "a").join(group.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b")
    return _state(state, components(ends))


def similar_groups(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id of the group), kept."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    signed = stored(texts.mapInArrow(_sign, "doc_id long, n_shingles long, set1 long, set2 long, bands array<long>, sketch array<long>, filled long"), "minhash-signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    key = ["set1", "set2", "n_shingles"]
    classes = full.groupBy(*key).agg(F.min("doc_id").alias("a"), F.min_by(F.struct("bands", "sketch", "filled"), "doc_id").alias("of"))
    classes = stored(classes.select(*key, "a", "of.bands", "of.sketch", "of.filled"), "minhash-classes")
    member = stored(full.select("doc_id", *key).join(classes.select(*key, F.col("a").alias("class_id")), key).select("doc_id", "class_id").distinct(), "minhash-members")
    owner = member.groupBy("doc_id").agg(F.min("class_id").alias("b"), F.max("class_id").alias("z")).where("b < z")
    same = member.join(owner, "doc_id").where("class_id > b").select(F.col("class_id").alias("a"), "b")  # rows with one doc_id are linked

    buckets = classes.select("a", F.explode("bands").alias("bucket"))
    crowd = buckets.groupBy("bucket").agg((F.count(F.lit(1)) - 1).alias("others")).where("others > 0")
    # a class's buckets that hold others, a few dozen at most, in one row
    met = buckets.join(crowd, "bucket").groupBy("a").agg(F.sum("others").alias("met"), F.collect_set("bucket").alias("buckets"))
    state = _state(classes.select("a").distinct().join(met, "a", "left").withColumn("group", F.col("a")), None)
    turn, before = 0, None
    while True:
        rows = state.select("a", "met", "group", F.explode("buckets").alias("bucket"))
        if turn:  # those outside the largest component of their bucket
            sizes = rows.groupBy("bucket", "group").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket")
            main = sizes.agg(F.max(F.struct("n", "group")).alias("most"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
            main = stored(main.select("bucket", F.col("most.group").alias("main"), ((F.col("all") - F.col("most.n")) * F.col("all")).alias("work")), "minhash-open")
            work, size = main.agg(F.sum("work")).first()[0] or 0, rows.count()
            if work <= COMPARISONS * size or before is not None and work * LINKED > before * (LINKED - 1):
                break
            before = work
            rows = rows.join(main, "bucket").where("group <> main").select("a", "met", "group", "bucket")
        rank = F.xxhash64("a", F.lit(turn)) if turn else F.col("met")
        hubs = rows.groupBy("bucket").agg(F.max(F.struct(rank.alias("rank"), (-F.col("a")).alias("less"), "group")).alias("hub"))
        tried = rows.join(hubs, "bucket").where("group <> hub.group").groupBy("a", (-F.col("hub.less")).alias("b")).agg(F.count(F.lit(1)).alias("shared"))
        tried = tried.groupBy("a").agg(F.max(F.struct("shared", (-F.col("b")).alias("less"))).alias("best")).select("a", (-F.col("best.less")).alias("b"))
        found = confirmed(docs, stored(_linked_sketches(tried, classes), "minhash-pairs"))
        state, turn = _merged(state, stored(found if turn else found.union(same), "minhash-links")), turn + 1
    open_ = rows.join(main, "bucket").select("a", "group").distinct()
    found = stored(confirmed(docs, stored(_across(docs, classes, open_), "minhash-pairs")), "minhash-links")
    if found.head(1):
        state = _merged(state, found)
    ids = member.join(state.select(F.col("a").alias("class_id"), "group"), "class_id").groupBy("doc_id").agg(F.min("group").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(ids, "doc_id", "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def first_of_groups(docs: DataFrame) -> DataFrame:
    """docs without those that resemble a document with a smaller id."""
    gone = stored(similar_groups(docs).where("not kept").select("doc_id").distinct(), "minhash-gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))
