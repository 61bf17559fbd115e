"""N-gram Jaccard join by PartEnum signatures.

1. Sizes fall into bands, each ending at most 1 / 0.8 beyond the one before, so two linked sets lie in one
   band or in neighbouring ones. A set signs for its own band and for the next; linked sets thus meet in the
   larger one's band, where they differ in at most ``budget`` shingles: those at 0.8 with sizes a and b
   differ in (a + b) / 9 at most.
2. In a band the domain of shingles (their hashes) is dealt to groups, and each group to N2 parts. With
   budget // (K2 + 1) + 1 groups, some group holds at most K2 of the differences, so N2 - K2 of its parts are
   equal on both sides: every choice of N2 - K2 parts of every group is a signature, a hash of band, group,
   choice and the set's shingles in them. Linked sets share one for certain, whatever the hashes are.
3. Empty choices would be shared by many. There are some spare groups, so linked sets agree in ``spare`` + 1
   groups at least, and a set in which no more than ``spare`` groups have an empty choice leaves those out:
   one of the other groups still speaks for it. Only sets with more such groups sign them.
4. Most signatures stand alone. Tasks pack (signature, set) in arrays, dealt by the signature's leading bits,
   and what meets nothing goes. A signature that a task holds several times goes through once, its sets
   beside it, so a signature of very many sets reaches a bucket as one entry a task.
5. Where sets meet, all first point at the smallest id among them; each set's most shared one is confirmed on
   the full sets, and components follow. While open signatures (those with several components) ask for many
   comparisons and the last turn linked a good share, another turn follows.
6. Last round, which alone decides what is whole: for each open signature, sets outside its largest
   component against all. Rows of frequent ones are salted. Pairs carry on if sizes and 1,024 parity bits
   (each shingle flips one, so no more bits differ than shingles) allow 0.8, and are confirmed on the full
   sets. Pairs within a component can't change the result.

No step loses a link: there are no caps, and nothing is drawn at random. Shingles are compared by 61-bit
fingerprints modulo a prime, mixed to 64 bits; equal sets are one class, by two such sums and the size.

Defined results: null or blank text has an empty set and is linked with nothing; rows with one doc_id are
one document, linked if any of them is; a null doc_id is a component of its own (null); repeated rows are
returned as often as they stand; an empty table gives no rows; a text of any length is one row of a batch, in
some 100 bytes of memory a byte; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rolling as R
from .common import longs, stored, table, text_slices
from .components import components
from .minhash import confirmed, shingle_sets

#: Link where 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Parts of a group, and how many of them may differ.
N2, K2 = 3, 1
#: One spare group for so many.
SPARE = 6
#: Bits of the parity sketch.
BITS = 1024
#: Entries that a task packs before it deals them, and entries that a bucket holds about.
FLUSH, BUCKET = 1 << 19, 1 << 19
#: Another turn follows while open signatures ask for more than so many comparisons a row, and the last turn
#: linked one in LINKED of the pairs it tried. Turns only save the last round work: it is whole in any case.
COMPARISONS, LINKED = 16, 8
#: Comparisons by one signature that a task gets at most; beyond, its rows are dealt to several.
SHARE = 1 << 22
U = np.uint64
#: Leading bytes of a signature that are dealt. Those that share them meet too, so no link is lost; what else meets is
#: tested: of n signatures some n * n / 2 ** 49 pairs.
SIG = 6
MASK = U((1 << 64) - (1 << 8 * (8 - SIG)))


def _bands(percent: int, most: int = 1 << 40) -> np.ndarray:
    ends = [1]
    while ends[-1] < most:
        ends.append(max(ends[-1] + 1, 100 * ends[-1] // percent))
    return np.array(ends)


#: The largest size of each band, the differences that its links may have, its groups and how many of them are spare.
ENDS = _bands(PERCENT)
BUDGET = (100 - PERCENT) * 2 * ENDS // (100 + PERCENT)
NEEDED = BUDGET // (K2 + 1) + 1
SPARES = NEEDED // SPARE
CHOICES = list(itertools.combinations(range(N2), N2 - K2))


def signatures(sets: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of sets (sorted hashes, set i from edges[i] to edges[i + 1]), and each one's set."""
    sizes = np.diff(edges)
    found = [_signed(sets, sizes, np.searchsorted(ENDS, sizes) + step) for step in (0, 1)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _signed(sets: np.ndarray, sizes: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    groups = np.where((sizes > 0) & (BUDGET[band] > 0), NEEDED[band] + SPARES[band], 0)  # a budget of 0 links equal sets only, which are one class
    base = np.cumsum(groups) - groups
    total = int(groups.sum())
    doc = np.repeat(np.arange(len(sizes)), sizes)
    used = groups[doc] > 0
    h, doc = sets[used], doc[used]
    group = ((h >> U(32)) * groups[doc].astype(U) >> U(32)).astype(np.int64) + base[doc]  # ascends, as each set's hashes do
    part = (h & U(0xFFFFFFFF)) * U(N2) >> U(32)
    at = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=total))]) if total else np.zeros(1, np.int64)
    mixed = R.mix(h + U(0x9E3779B97F4A7C15))
    sums, filled = [], []
    for j in range(N2):
        own = part == U(j)
        run = np.concatenate([np.zeros(1, U), np.cumsum(np.where(own, mixed, U(0)))])
        sums.append(run[at[1:]] - run[at[:-1]])
        run = np.concatenate([[0], np.cumsum(own)])
        filled.append(run[at[1:]] > run[at[:-1]])
    owner = np.repeat(np.arange(len(sizes)), groups)
    full = [np.logical_or.reduce([filled[j] for j in c]) for c in CHOICES]
    poor = np.bincount(owner, weights=~np.logical_and.reduce(full), minlength=len(sizes)) > SPARES[band]
    where = R.mix(band[owner].astype(U) * U(0xD6E8FEB86659FD93) + (np.arange(total) - base[owner]).astype(U))
    out, of = [], []
    for i, c in enumerate(CHOICES):
        emit = full[i] | poor[owner]
        inside = np.add.reduce([sums[j] for j in c])[emit]
        out.append(R.mix(R.mix(inside + U(i + 1)) + where[emit]))
        of.append(owner[emit])
    return np.concatenate(out), np.concatenate(of)


def parity(sets: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Rows of BITS / 64 longs: whether an odd number of shingles falls on each bit."""
    n = len(edges) - 1
    at = (R.mix(sets) & U(BITS - 1)).astype(np.int64) + np.repeat(np.arange(n), np.diff(edges)) * BITS
    return np.packbits((np.bincount(at, minlength=n * BITS) & 1).astype(np.uint8).reshape(n, BITS), axis=1).view(np.int64)


def set_sums(sets: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums of each set, 0 for empty ones."""
    one, two = np.zeros(len(edges) - 1, U), np.zeros(len(edges) - 1, U)
    full = np.diff(edges) > 0
    if full.any():
        starts = edges[:-1][full]
        one[full], two[full] = np.add.reduceat(sets, starts), np.bitwise_xor.reduceat(R.mix(sets + U(1)), starts)
    return one, two


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(b.schema.get_field_index("doc_id"))
        for at, rows, data, offs in text_slices(b, "text"):
            sets, edges = shingle_sets(data, offs)
            one, two = set_sums(sets, edges)
            bits = parity(sets, edges)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * bits.shape[1]), pa.array(bits.ravel()))
            yield pa.RecordBatch.from_arrays([ids.slice(at, rows), pa.array(np.diff(edges)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists], ["doc_id", "n_shingles", "set1", "set2", "parity"])


def _row(bucket: int, whole: bool, sig: np.ndarray, key: np.ndarray) -> tuple[int, bool, bytes, bytes]:
    return bucket, whole, sig.tobytes(), key.tobytes()


def _distinct(sig: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct entries in the order of their signatures, and whether each signature has several sets."""
    order = np.argsort(sig, kind="stable")
    sig, key = sig[order], key[order]
    same = sig[1:] == sig[:-1]
    again = np.zeros(len(sig), bool)
    again[1:], again[:-1] = same, same | again[:-1]
    at = np.flatnonzero(again)  # few: only these need the order of their sets
    if len(at):
        inner = at[np.lexsort((key[at], sig[at]))]
        sig[at], key[at] = sig[inner], key[inner]
    keep = np.ones(len(sig), bool)
    keep[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
    sig, key = sig[keep], key[keep]
    same = sig[1:] == sig[:-1]
    several = np.zeros(len(sig), bool)
    several[1:] = same
    several[:-1] |= same
    return sig, key, several


def _packed(sig: np.ndarray, key: np.ndarray, buckets: int, turn: int) -> list[tuple[int, bool, bytes, bytes]]:
    """Rows of a bucket each: one set for every signature. The sets of one that has several go through as they are."""
    sig, key, several = _distinct(sig, key)
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    rows = []
    s, k = sig[several], key[several]
    for i, at in enumerate(range(0, len(s), BUCKET)):
        rows.append(_row((turn + i) % buckets, True, s[at : at + BUCKET], k[at : at + BUCKET]))
    s, k = sig[first], key[first]
    bucket = ((s >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
    ends = np.searchsorted(bucket, np.arange(buckets + 1))
    rows += [_row(i, False, s[a:e], k[a:e]) for i, (a, e) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())) if a < e]
    return rows


def _short(sigs: bytes) -> bytes:
    """SIG bytes of each signature, the leading ones first, all signatures' in turn: they ascend, so these compress."""
    return np.ascontiguousarray(np.frombuffer(sigs, U).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :SIG].T).tobytes()


def _long(short: bytes) -> np.ndarray:
    out = np.zeros((len(short) // SIG, 8), np.uint8)
    out[:, :SIG] = np.frombuffer(short, np.uint8).reshape(SIG, -1).T
    return out.view(">u8").ravel().astype(U)


def _deal(buckets: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, keys, n, turn = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            rows = _packed(np.concatenate(sigs) & MASK, np.concatenate(keys), buckets, turn * 7919)
            rows = [(bucket, whole, _short(s), k) for bucket, whole, s, k in rows]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.binary(), pa.binary()))], ["bucket", "whole", "sigs", "sets"])

        for b in batches:
            for _, _, data, offs in text_slices(b, "text"):
                sets, edges = shingle_sets(data, offs)
                sig, of = signatures(sets, edges)
                sigs.append(sig)
                keys.append(set_sums(sets, edges)[0][of])
                n += len(sig)
                if n >= FLUSH:
                    yield flush()
                    sigs, keys, n, turn = [], [], 0, turn + 1
        if n:
            yield flush()

    return go


def _entries(sig: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(sig), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)].view(np.int64)) for x in (sig, key)], ["sig", "set1"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, set1) of the signatures that several sets of a bucket have. Buckets stay packed until their turn, since a task
    may get many: only one is laid out and sorted at a time."""
    kept: dict[int, list[tuple[bytes, bytes]]] = {}
    for b in batches:
        for bucket, whole, s, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
            if whole:
                yield from _entries(_long(s.as_py()), np.frombuffer(k.as_py(), U))
            else:
                kept.setdefault(bucket, []).append((s.as_py(), k.as_py()))
    while kept:
        rows = kept.popitem()[1]
        sig, key, several = _distinct(np.concatenate([_long(s) for s, _ in rows]), np.concatenate([np.frombuffer(k, U) for _, k in rows]))
        yield from _entries(sig[several], key[several])


def meetings(docs: DataFrame, classes: DataFrame, shingles: int) -> DataFrame:
    """(sig, a): the classes that share a signature with another, of docs with so many shingles in all."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shingles // (4 * BUCKET)))
    packed = docs.where("text is not null").select("text").mapInArrow(_deal(4 * parts), "bucket int, whole boolean, sigs binary, sets binary")
    met = packed.repartition(parts, "bucket").mapInArrow(_meet, "sig long, set1 long")
    return stored(met.join(classes.select("set1", "a"), "set1").select("sig", "a").distinct(), "partenum-meetings")


def _may_link() -> Column:
    """Whether sizes and parity bits leave PERCENT possible; the other side's names end in _b."""
    n, m = F.col("n_shingles"), F.col("n_shingles_b")
    bits = sum((F.bit_count(F.col("parity")[i].bitwiseXOR(F.col("parity_b")[i])) for i in range(BITS // 64)), F.lit(0))
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & ((100 + PERCENT) * bits <= (100 - PERCENT) * (n + m))


def _hub_pairs(rows: DataFrame, classes: DataFrame, rank: Column) -> DataFrame:
    """Each class of rows (sig, a, group) with the one that it shares most signatures with, of those that stand for a signature."""
    hubs = rows.groupBy("sig").agg(F.min(F.struct(rank.alias("rank"), "a", "group")).alias("hub"))
    tried = rows.join(hubs, "sig").where("group <> hub.group").groupBy("a", F.col("hub.a").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    tried = tried.groupBy("a").agg(F.max(F.struct("shared", (-F.col("b")).alias("less"))).alias("best")).select("a", (-F.col("best.less")).alias("b"))
    own = classes.select("a", "n_shingles", "parity")
    return tried.join(own, "a").join(own.toDF("b", "n_shingles_b", "parity_b"), "b").where(_may_link()).select("a", "b")


def _across(rows: DataFrame, open_: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share an open signature and may be linked."""
    parts = (F.lit(1) + F.col("work") / F.lit(SHARE)).cast("int")
    own = rows.join(open_.select("sig", "main", parts.alias("parts")), "sig").join(classes.select("a", "n_shingles", "parity"), "a")
    own = stored(own.select("sig", "a", "group", "main", "parts", "n_shingles", "parity"), "partenum-open")
    left = own.where("group <> main").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).drop("parts")
    right = own.select("sig", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), *[F.col(c).alias(f"{c}_b") for c in ("a", "group", "n_shingles", "parity")])
    once = (F.col("group") != F.col("group_b")) & ((F.col("group_b") == F.col("main")) | (F.col("a") < F.col("a_b")))
    both = left.alias("x").join(right.alias("y"), (F.col("x.sig") == F.col("y.sig")) & (F.col("x.salt") == F.col("y.salt")) & once & _may_link())
    return both.select("a", F.col("a_b").alias("b")).distinct()


def _merged(state: DataFrame, links: DataFrame) -> DataFrame:
    """state (a, group) after links (a, b), whose components are sought among the groups they join only."""
    ends = links.join(state.toDF("a", "x"), "a").join(state.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b")
    into = components(ends).toDF("group", "into")
    return stored(state.join(into, "group", "left").select("a", F.coalesce("into", "group").alias("group")), "partenum-state")


def joined_groups(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = stored(texts.mapInArrow(_sign, "doc_id long, n_shingles long, set1 long, set2 long, parity array<long>"), "partenum-signed")
    full, key = signed.where("n_shingles > 0 and doc_id is not null"), ["set1", "set2", "n_shingles"]
    classes = stored(full.groupBy(*key).agg(F.min("doc_id").alias("a"), F.min_by("parity", "doc_id").alias("parity")), "partenum-classes")
    member = stored(full.select("doc_id", *key).join(classes.select(*key, "a"), key).select("doc_id", "a").distinct(), "partenum-members")
    first = member.groupBy("doc_id").agg(F.min("a").alias("b"), F.max("a").alias("last")).where("b < last")
    same = member.join(first, "doc_id").where("a > b").select("a", "b")  # rows with one doc_id are linked
    shingles = full.agg(F.sum("n_shingles")).first()[0] or 0
    met = meetings(texts.where("doc_id is not null"), classes, shingles)
    state = stored(classes.select("a", F.col("a").alias("group")).distinct(), "partenum-state")
    turn, before = 0, None
    while True:
        rows = met.join(state, "a")
        sizes = rows.groupBy("sig", "group").agg(F.count(F.lit(1)).alias("n")).groupBy("sig")
        open_ = sizes.agg(F.max(F.struct("n", "group")).alias("most"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
        open_ = stored(open_.select("sig", F.col("most.group").alias("main"), ((F.col("all") - F.col("most.n")) * F.col("all")).alias("work"), "all"), "partenum-sizes")
        work, size = open_.agg(F.sum("work"), F.sum("all")).first()
        if turn and ((work or 0) <= COMPARISONS * (size or 0) or before is not None and work * LINKED > before * (LINKED - 1)):
            break
        rank = F.xxhash64("a", F.lit(turn)) if turn else F.lit(0)
        if turn:
            before = work
            rows = rows.join(open_, "sig").where("group <> main").select("sig", "a", "group")
        found = confirmed(docs, stored(_hub_pairs(rows, classes, rank), "partenum-pairs"), PERCENT)
        state, turn = _merged(state, stored(found if turn else found.union(same), "partenum-links")), turn + 1
    found = stored(confirmed(docs, stored(_across(rows, open_, classes), "partenum-pairs"), PERCENT), "partenum-links")
    if found.head(1):
        state = _merged(state, found)
    ids = member.join(state, "a").groupBy("doc_id").agg(F.min("group").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(ids, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op13_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined_groups(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= {PERCENT} * (na.n + nb.n - common)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS least FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""
