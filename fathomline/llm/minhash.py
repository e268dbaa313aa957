"""b-bit MinHash near-duplicate detection with exact confirmation.

A text's set is its distinct shingles of ``shingle`` words (fewer words: the whole sequence is
one shingle; none: the empty set, linked with nothing). Exact copies of a set are collapsed into
classes first. Each class has ``bands * rows`` minima; whole minima form the bands' bucket keys,
and only the lowest ``BITS`` bits of each are kept, packed into 64-bit words. Candidates meet
in a bucket, are screened by the collision-corrected estimate from the packed words, and are
confirmed on full shingle sets, so every link found is exact.

Candidate pairs never cover a bucket: each member first meets one member of each of its buckets,
chosen by a hash of member and bucket, so a member has up to ``bands`` different partners. Members
that confirmation left in different components of one bucket are then compared with each other: by
a join in small buckets, and in large ones by numpy blocks that hold the full sets, confirm on the
spot and emit only links that connect two components.

Edge cases. Null and empty texts: no shingles, own component. Null id: kept, component null, linked with nothing.
Every row is a document: rows that repeat an id have the component of their own text, so equal rows
share one, and an id with two texts may have two. Ties: the smallest id represents. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm import common as C
from fathomline.operators.graph import components
from fathomline.runtime import materialise, ship

BITS = 2
BANDS = 24
ROWS = 4
_LANES = 32  # minima a 64-bit word holds at two bits each
_PAIR_MASK = 0x5555555555555555
BLOCK = 512
SMALL_BUCKET = 48
#: Least and largest bit table that names the texts whose sets are needed: 16 bits an id, 16 MB at most.
LOG_CELLS = (16, 27)

_SIGNED = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set_a", T.LongType()),
        T.StructField("set_b", T.LongType()),
        T.StructField("sig", T.ArrayType(T.LongType())),
        T.StructField("keys", T.ArrayType(T.LongType())),
    ]
)
_SETS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set_a", T.LongType()),
        T.StructField("set_b", T.LongType()),
        T.StructField("grams", T.ArrayType(T.LongType())),
    ]
)
_SET = ["set_a", "set_b", "n_shingles"]


def shingle_sets(chunk: C.Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text of a chunk, and where each text's begin."""
    _, _, _, edge, word = C.words(chunk)
    count = np.diff(edge)
    text = C.owner(edge)
    lane = C.seeded(width, 77)
    pad = np.concatenate([word, np.zeros(width, np.uint64)])
    gram = np.zeros(len(word), np.uint64)
    for k in range(width):
        gram = C.mix(gram + pad[k : k + len(word)] * lane[k])
    left = edge[1:][text] - np.arange(len(word))
    whole = left >= width
    brief = np.flatnonzero((count > 0) & (count < width))
    if len(brief):  # the whole sequence is one shingle, hashed with its length
        whole[edge[:-1][brief]] = True
        for i in brief:
            h = np.zeros(1, np.uint64)
            for k in range(count[i]):
                h = C.mix(h + word[edge[i] + k : edge[i] + k + 1] * lane[k])
            gram[edge[i]] = C.mix(h + np.uint64(count[i]))[0]
    gram, text = gram[whole], text[whole]
    # two stable passes: by hash, then by text
    order = np.argsort(gram, kind="stable")
    order = order[np.argsort(text[order].astype(np.uint16 if chunk.n < 65536 else np.int64), kind="stable")]
    gram, text = gram[order], text[order]
    fresh = np.ones(len(gram), bool)
    fresh[1:] = (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])
    gram, text = gram[fresh], text[fresh]
    return gram, np.searchsorted(text, np.arange(chunk.n + 1))


def signatures(gram: np.ndarray, edge: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Minima of every non-empty text: packed low bits (texts x words) and band keys (texts x bands)."""
    full = np.flatnonzero(np.diff(edge))
    if not len(full):
        return np.zeros((0, -(-bands * rows // _LANES)), np.int64), np.zeros((0, bands), np.int64)
    k = bands * rows
    start = edge[:-1][full]
    by = C.seeded(2 * k, 4242).astype(np.uint32)
    short = (gram >> np.uint64(32)).astype(np.uint32)
    low = np.empty((k, len(full)), np.uint32)
    for i in range(k):
        low[i] = np.minimum.reduceat(short * (by[2 * i] | np.uint32(1)) + by[2 * i + 1], start)
    words = -(-k // _LANES)
    packed = np.zeros((len(full), words), np.uint64)
    for i in range(k):
        # the multiplier is odd, so low bits of a minimum are those of the value itself: mix first
        bits = C.mix(low[i].astype(np.uint64) + np.uint64(i << 32)) & np.uint64(3)
        packed[:, i // _LANES] |= bits << np.uint64(2 * (i % _LANES))
    keys = np.zeros((len(full), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(full), b + 1, np.uint64)
        for r in range(rows):
            h = C.mix(h + low[b * rows + r].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        keys[:, b] = h
    return packed.view(np.int64), keys.view(np.int64)


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _set_hashes(gram: np.ndarray, edge: np.ndarray) -> list[pa.Array]:
    """Number of shingles and two 64-bit hashes of each text's set; null hashes for empty sets."""
    sums = [np.zeros(len(gram) + 1, np.uint64) for _ in range(2)]
    np.cumsum(C.mix(gram), out=sums[0][1:])
    np.cumsum(C.mix(gram ^ np.uint64(0x632BE59BD9B4E019)), out=sums[1][1:])
    count = np.diff(edge)
    return [pa.array(count.astype(np.int64)), *(pa.array((s[edge[1:]] - s[edge[:-1]]).view(np.int64), mask=count == 0) for s in sums)]


def _sign(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in C.text_chunks(batch.column("text")):
                gram, edge = shingle_sets(chunk, width)
                packed, keys = signatures(gram, edge, bands, rows)
                at = np.concatenate([[0], np.cumsum(np.diff(edge) > 0)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id")[chunk.rows],
                        *_set_hashes(gram, edge),
                        _lists(packed.ravel(), at * packed.shape[1]),
                        _lists(keys.ravel(), at * keys.shape[1]),
                    ],
                    names=_SIGNED.names,
                )

    return run


def _gather(width: int, wanted):
    """Shingle sets of the rows whose cell is marked, once a task; all others pass by untouched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, seen = wanted.value, set()
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            batch = batch.filter(pa.array((marks[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1))
            for chunk in C.text_chunks(batch.column("text")):
                gram, edge = shingle_sets(chunk, width)
                made = pa.RecordBatch.from_arrays(
                    [batch.column("id")[chunk.rows], *_set_hashes(gram, edge), _lists(gram.view(np.int64), edge)], names=_SETS.names
                )
                own = list(zip(*(made.column(k).to_pylist() for k in range(4)), strict=True))
                fresh = [k for k, row in enumerate(own) if row not in seen and not seen.add(row)]
                yield made if len(fresh) == len(own) else made.take(pa.array(fresh, pa.int64()))

    return run


def estimate_floor(similarity: float, k: int) -> tuple[float, int]:
    """Lowest estimate that is still screened in (five standard errors below), and its most mismatches."""
    chance = 2.0**-BITS
    agree = chance + (1 - chance) * similarity
    sigma = math.sqrt(agree * (1 - agree) / k) / (1 - chance)
    low = max(0.0, similarity - 5 * sigma)
    return low, math.floor(k * (1 - chance) * (1 - low))


def _mismatches(a: str, b: str, words: int):
    """Lanes in which two packed signatures differ."""
    total = F.lit(0)
    for w in range(words):
        x = F.col(a)[w].bitwiseXOR(F.col(b)[w])
        total = total + F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(F.lit(_PAIR_MASK)))
    return total


def _block_compare(most: int, percent: int):
    """Links between components that one block pair of a bucket holds, enough to join them."""
    mask, lanes = np.uint64(_PAIR_MASK), np.uint64(1)

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("rep").to_numpy()
        side = table.column("side").to_numpy()
        one = table.column("bi")[0].as_py() == table.column("bj")[0].as_py()
        sig = np.array(table.column("sig").to_pylist(), dtype=np.int64).view(np.uint64)
        grams = table.column("grams").combine_chunks()
        flat, cut = grams.flatten().to_numpy().view(np.uint64), grams.offsets.to_numpy() - grams.offsets[0].as_py()
        size = np.diff(cut)
        _, comp = np.unique(table.column("comp").to_numpy(), return_inverse=True)
        left = np.arange(len(ids)) if one else np.flatnonzero(side == 0)
        right = np.arange(len(ids)) if one else np.flatnonzero(side == 1)
        found = []
        for i in left:
            x = sig[right] ^ sig[i]
            far = np.bitwise_count((x | (x >> lanes)) & mask).sum(1)
            hit = right[(far <= most) & (comp[right] != comp[i])]
            if not len(hit):
                continue
            own = flat[cut[i] : cut[i + 1]]
            n = size[hit]
            edge = np.concatenate([[0], np.cumsum(n)])
            at = np.arange(edge[-1]) + np.repeat(cut[hit] - edge[:-1], n)
            near = np.minimum(np.searchsorted(own, flat[at]), len(own) - 1)
            both = np.add.reduceat((own[near] == flat[at]).astype(np.int64), edge[:-1])
            for j in hit[both * 100 >= (len(own) + n - both) * percent]:
                if comp[i] != comp[j]:
                    comp[comp == comp[j]] = comp[i]
                    found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """One row per row of ``docs``: (key, n_shingles, component_id, kept)."""
    kept = F.col("id").isNull() | (F.col("id") == F.col("component_id"))
    return grouped(docs, key=key, **options).select(F.col("id").alias(key), "n_shingles", "component_id", kept.alias("kept"))


def grouped(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    bands: int = BANDS,
    rows: int = ROWS,
    small_bucket: int = SMALL_BUCKET,
) -> DataFrame:
    """One row per row of ``docs``: (id, n_shingles, set_a, set_b, component_id); equal sets have equal hashes."""
    spark = docs.sparkSession
    ship(spark)
    percent = round(100 * similarity)
    own = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    signed = materialise(own.mapInArrow(_sign(shingle, bands, rows), _SIGNED), "minhash-sets")

    # classes of equal sets, numbered, with the signature that all their rows have; a written table, so that a join on a
    # hot set may be split
    full = signed.filter("n_shingles > 0 and id is not null")
    classes = full.groupBy(*_SET).agg(F.min("id").alias("first"), F.any_value("sig").alias("sig"), F.any_value("keys").alias("keys"))
    leaders = materialise(classes.withColumn("rep", F.monotonically_increasing_id()), "minhash-classes")
    classes = leaders.select("rep", "first", *_SET)

    member = leaders.select("rep", F.explode("keys").alias("bucket"))
    heads = member.groupBy("bucket").agg(
        F.min_by("rep", F.xxhash64("rep", "bucket")).alias("head"), F.count(F.lit(1)).alias("size")
    ).filter("size > 1")
    placed = materialise(member.join(heads, "bucket"), "minhash-buckets")

    words = -(-bands * rows // _LANES)
    low, most = estimate_floor(similarity, bands * rows)
    sigs = leaders.select("rep", "sig")

    def sets_of(reps: DataFrame) -> DataFrame:
        """Shingle sets of these classes' first texts, by id and set: a bit table picks them, and few others, in the scan."""
        some = materialise(classes.join(reps.distinct(), "rep"), "minhash-wanted")
        least, most_cells = LOG_CELLS
        log = min(most_cells, max(least, (some.count() * 16).bit_length()))
        cell = F.pmod(F.xxhash64("id"), F.lit(1 << log)).cast("int")
        marked = some.select(F.col("first").alias("id")).select(cell.alias("cell"))
        # bit c of the table is number c + 1 of the bitmap functions, whose buckets of 32,768 count from 1
        number = "CAST(cell + 1 AS BIGINT)"
        bits = marked.groupBy(F.expr(f"bitmap_bucket_number({number})").alias("k"))
        marks = np.zeros(max(4096, 1 << (log - 3)), np.uint8)
        for x in bits.agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({number}))").alias("bits")).collect():  # at most 2^12 rows of 4 KB
            at = (x["k"] - 1) * 4096
            marks[at : at + 4096] = np.frombuffer(bytes(x["bits"]), np.uint8)
        texts = own.filter("id is not null").withColumn("cell", cell)
        grams = texts.mapInArrow(_gather(shingle, spark.sparkContext.broadcast(marks)), _SETS)
        return materialise(grams.withColumnRenamed("id", "first"), "minhash-grams")

    def named(side: str) -> DataFrame:
        """Classes by number, as columns of one side of a pair."""
        return classes.select(F.col("rep").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("first", *_SET)))

    def with_grams(rows: DataFrame, sets: DataFrame, side: str) -> DataFrame:
        own = sets.select(*(F.col(c).alias(f"{side}_{c}") for c in ("first", *_SET)), F.col("grams").alias(f"{side}_grams"))
        keys = [f"{side}_{c}" for c in ("first", *_SET)]
        return rows.join(named(side), side).join(own, keys).drop(*keys)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs whose full sets are similar enough. Sets are built for the pairs' texts only."""
        pairs = materialise(pairs, "minhash-pairs")
        sets = sets_of(pairs.select(F.col("a").alias("rep")).unionAll(pairs.select(F.col("b").alias("rep"))))
        both = with_grams(with_grams(pairs, sets, "a"), sets, "b").select(
            "a", "b", F.size("a_grams").alias("na"), F.size("b_grams").alias("nb"), F.size(F.array_intersect("a_grams", "b_grams")).alias("both")
        )
        return materialise(
            both.filter(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("a", "b").distinct(),
            "minhash-links",
        )

    def screened(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a")
            .join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
            .filter(_mismatches("sa", "sb", words) <= most)
            .select("a", "b")
        )

    star = placed.filter("rep <> head").select(F.least("head", "rep").alias("a"), F.greatest("head", "rep").alias("b")).distinct()
    links = confirmed(screened(star))
    first = components(links)

    # members of one bucket that are still in different components
    labelled = placed.join(first.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        "bucket", "rep", "size", F.coalesce("component", "rep").alias("comp")
    )
    mixed = labelled.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    mixed = mixed.filter("lo <> hi").select("bucket")
    rest = materialise(
        labelled.join(mixed, "bucket", "left_semi").join(sigs, "rep").select("bucket", "rep", "size", "comp", "sig"),
        "minhash-rest",
    )
    small = rest.filter(F.col("size") <= small_bucket)
    near = (
        small.select("bucket", F.col("rep").alias("a"), F.col("comp").alias("ca"), F.col("sig").alias("sa"))
        .join(small.select("bucket", F.col("rep").alias("b"), F.col("comp").alias("cb"), F.col("sig").alias("sb")), "bucket")
        .filter("a < b and ca <> cb")
        .filter(_mismatches("sa", "sb", words) <= most)
        .select("a", "b")
    )
    big = rest.filter(F.col("size") > small_bucket)
    far = spark.createDataFrame([], "a bigint, b bigint")
    if not big.isEmpty():
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        sets = sets_of(big.select("rep"))
        large = (
            with_grams(big, sets, "rep")
            .withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .select(
                "bucket", "rep", "comp", "sig", F.col("rep_grams").alias("grams"),
                F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"),
                (F.col("own") > F.col("other")).cast("int").alias("side"),
            )
        )
        far = large.groupBy("bucket", "bi", "bj").applyInArrow(_block_compare(most, percent), "a bigint, b bigint")
        far = materialise(far.distinct(), "minhash-far")
    more = confirmed(near.distinct()).unionAll(far)
    label = components(links.unionAll(more)).select(F.col("id").alias("rep"), "component")
    placed = classes.join(label, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    # a component's smallest id; sets that are linked with none keep their own
    joint = placed.join(label.select("component").distinct(), "component", "left_semi").groupBy("component").agg(F.min("first").alias("least"))
    known = placed.join(joint, "component", "left").select(*_SET, F.coalesce("least", "first").alias("component_id"))
    known = materialise(known, "minhash-components")
    columns = ["id", "n_shingles", "set_a", "set_b"]
    alone = signed.filter("n_shingles = 0 or id is null").select(*columns, F.col("id").alias("component_id"))
    return full.select(*columns).join(known, _SET).select(*columns, "component_id").unionAll(alone)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of every group of near duplicates stays, the one with the smallest id.

    Rows of one id stay as long as their sets of shingles are not linked; of rows that repeat both id and set, the
    one with the smallest text stays. Rows without an id stay.
    """
    rows = materialise(grouped(docs), "minhash-rows")
    named = rows.filter("id is not null")
    again = named.groupBy("id").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select(F.col("id").alias("again_id"))
    again = materialise(again, "minhash-again")
    gone = named.filter("id <> component_id").select(F.col("id").alias("gone_id")).unionAll(again).distinct()
    single = docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
    if again.isEmpty():
        return single
    # rows that share an id: by id and set
    mine = docs.join(again, docs["doc_id"] == again["again_id"], "left_semi")
    marked = materialise(mine.select(F.struct(*(mine[c] for c in docs.columns)).alias("row")), "minhash-mine")
    chosen = named.join(again, named["id"] == again["again_id"], "left_semi").filter("id = component_id")
    # of several sets of one id in one group, one
    chosen = chosen.select("id", "component_id", *_SET, (F.col("n_shingles") > 0).alias("some")).distinct()
    chosen = chosen.groupBy("component_id", "some").agg(F.min(F.struct("set_a", "set_b", "n_shingles", "id")).alias("pick")).select("pick.*")
    signed = marked.select(F.col("row.doc_id").cast("bigint").alias("id"), F.col("row.text").alias("text"), F.xxhash64("row").alias("nth"))
    signed = signed.mapInArrow(_resign(5), T.StructType([*_SETS.fields[:4], T.StructField("nth", T.LongType())]))
    same = [signed["id"] == chosen["id"], *(signed[c].eqNullSafe(chosen[c]) for c in _SET)]
    kept = signed.join(chosen, same, "left_semi")
    first = marked.withColumn("nth", F.xxhash64("row")).join(kept.select(F.col("id").alias("k"), *_SET, "nth").distinct(), "nth")
    once = first.groupBy("k", *_SET).agg(F.min_by("row", F.struct("row.text", "nth")).alias("row")).select("row.*")
    return single.unionByName(once)


def _resign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in C.text_chunks(batch.column("text")):
                gram, edge = shingle_sets(chunk, width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[chunk.rows], *_set_hashes(gram, edge), batch.column("nth")[chunk.rows]], names=[*_SETS.names[:4], "nth"]
                )

    return run
