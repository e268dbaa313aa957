"""Phrase collocations, mined by pivot partitioning.

Words are counted first. Every phrase belongs to its rarest word, the pivot: a text is rewritten for each of its pivots into the
fragment of words around it that are not rarer (a rarer word, a word below the least count or the end of a piece cuts it), and
fragments go to the pivot's partition. There all phrases of a fragment that hold the pivot are counted, which are exactly the
phrases that the pivot owns; all occurrences of a phrase meet in one partition, so rare phrases are dropped before anything else
is shuffled. Of equal words in a phrase the first one is its pivot.

How rare a word is comes from a table of fixed size with the logarithm of the counts of all frequent words in a slot. Words that
meet in a slot seem more frequent than they are: that moves a phrase to another of its words or keeps a rare word in a
fragment for longer, and changes no count. A pivot with more than ``1 / SHARES`` of all words would be a hot partition; its
phrases are sent one by one, each to a partition of its own. Equal words and fragments of about 2 MB of texts are added up before
they are sent, by 128 bits of hash.

Counts are exact (long; products in 38 decimal digits). Joins on words look the few hot ones up in a broadcast table of at most
``2 * SHARES`` rows and shuffle the rest.

Edge cases. Null or empty text: no words. Null lang: ``und``, together with rows that say so. Ids play no part; repeated rows
count again. Invalid or control characters are parts of words. No phrases: an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import LOWER, Chunk, mix, owner, seeded, span_hashes, spans, text_chunks
from fathomline.runtime import materialise, ship

SLOTS = 1 << 22
SHARES = 1 << 14
#: Bytes of whole texts in which equal words and fragments are added up before they are sent on.
AT_ONCE = 2 << 20
#: Words or fragments that are laid out as strings at once.
STEP = 1 << 18
#: Languages whose scales are broadcast; those of more are shuffled.
LANGUAGES = 10_000
#: Bits that hold where the words of a fragment end.
BITS = 60

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(10, 14)]] = True
_PART = ~_BREAK
_PART[[32, 9]] = False
_OTHER = seeded(256, 29)


def rank_of(count: np.ndarray) -> np.ndarray:
    """Counts on a scale of eighths of their binary logarithm, 1 at least; 0 for none."""
    return np.where(count > 0, np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(count, 1)))), 0).astype(np.uint8)


class Laid:
    """Words of a chunk: places in a buffer where one space follows each, text, two hashes by language, and what they touch."""

    def __init__(self, chunk: Chunk, salts: np.ndarray):
        data = LOWER[chunk.data]
        first, last, edge = spans(_PART[data], chunk.starts)
        self.text = owner(edge)
        self.hash = mix(span_hashes(data, first, last) ^ salts[self.text])
        self.other = mix(span_hashes(data, first, last, _OTHER) ^ salts[self.text])
        cut = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_BREAK[data], out=cut[1:])
        #: whether a word and the next one stand in one piece
        self.joined = (self.text[1:] == self.text[:-1]) & (cut[first[1:]] == cut[last[:-1]])
        self.size = last - first
        self.at = np.concatenate([[0], np.cumsum(self.size + 1)])
        source = np.arange(self.at[-1]) - np.repeat(self.at[:-1] - first, self.size + 1)
        self.bytes = data[np.minimum(source, max(0, len(data) - 1))] if len(data) else data
        self.bytes[self.at[1:] - 1] = 32

    def strings(self, low: np.ndarray, high: np.ndarray) -> pa.Array:
        """Words ``low`` to ``high`` (inclusive) with single spaces, as bytes."""
        start, size = self.at[low], self.at[high] + self.size[high] - self.at[low]
        offsets = np.concatenate([[0], np.cumsum(size)])
        source = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - start, size)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(low), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.bytes[source])]).cast(pa.binary())

    def keys(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of words ``low`` to ``high``; equal words of one language have equal ones."""
        made = []
        for own in (self.hash, self.other):
            h = np.zeros(len(low), np.uint64)
            for d in range(int((high - low).max(initial=-1)) + 1):
                there = low + d <= high
                h = np.where(there, mix(h + own[np.minimum(low + d, len(own) - 1)]), h)
            made.append(h)
        return made[0], made[1]


def _salts(langs: list[str]) -> np.ndarray:
    return mix(np.array([zlib.crc32(x.encode()) + 1 for x in langs], np.uint64))


def grouped(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an item of every group, its number of items) of items alike in both 64-bit hashes.

    A group may come in parts (its counts are added up later), but items of different words would have to share 128 bits.
    """
    order = np.argsort(one, kind="stable")
    one, two = one[order], two[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(one)), bool), (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
    return order[first], np.diff(np.append(first, len(one)))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Laid, pa.Array]]:
    """Laid-out words of whole texts, and the language of each text."""
    for batch in batches:
        lang = batch.column("lang")
        for chunk in text_chunks(batch.column("text"), AT_ONCE):
            own = lang.slice(chunk.rows.start, chunk.n)
            code = own.dictionary_encode()
            laid = Laid(chunk, _salts(code.dictionary.to_pylist())[code.indices.to_numpy()])
            if len(laid.text):
                yield laid, own


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for laid, lang in _chunks(batches):
        items, counts = grouped(laid.hash, laid.other)
        for a in range(0, len(items), STEP):
            at = items[a : a + STEP]
            columns = [lang.take(pa.array(laid.text[at])), laid.strings(at, at).cast(pa.string()), pa.array(counts[a : a + STEP].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])


def _slots(size: int):
    """(slot, n) of counted words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column("lang").cast(pa.large_string()).dictionary_encode()
            salts = _salts(code.dictionary.to_pylist())[code.indices.to_numpy()] if batch.num_rows else np.zeros(0, np.uint64)
            for chunk in text_chunks(batch.column("word")):
                edge = chunk.starts
                h = mix(span_hashes(chunk.data, edge[:-1], edge[1:]) ^ salts[chunk.rows])
                slot = pa.array((h & np.uint64(size - 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([slot, batch.column("n").slice(chunk.rows.start, chunk.n)], names=["slot", "n"])

    return run


def fragments(laid: Laid, ranks: np.ndarray, hot: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, last word, pivot's place in the fragment, route) of all fragments; place -1: the fragment is one phrase.

    Fragments of hot pivots, and those too long for their ends to be packed, come as the phrases they hold.
    """
    rank = ranks[(laid.hash & np.uint64(len(ranks) - 1)).astype(np.int64)].astype(np.uint64)
    key = np.where(rank > 0, (rank << np.uint64(56)) | (laid.hash >> np.uint64(8)), np.uint64(0))
    n = len(key)

    def reach(step: int) -> np.ndarray:
        """Words, up to ``longest - 1``, that stay in a pivot's fragment on one side."""
        open_, far = rank > 0, np.zeros(n, np.int64)
        for d in range(1, min(longest, n)):
            if step < 0:  # before the pivot only words that are more frequent, so the first of equal words owns a phrase
                here, there, joined = slice(d, None), key[:-d], laid.joined[: n - d]
                open_[here] &= joined & (there > key[here])
                open_[:d] = False
            else:
                here, there, joined = slice(0, n - d), key[d:], laid.joined[d - 1 :]
                open_[here] &= joined & (there >= key[here])
                open_[n - d :] = False
            far += open_
        return far

    left, right = reach(-1), reach(1)
    some = np.flatnonzero(left + right > 0)
    low, high = some - left[some], some + right[some]
    size = laid.at[high] + laid.size[high] - laid.at[low]
    single = (rank[some] >= hot) | (size >= 1 << (BITS // (2 * longest - 1)))
    busy, some = some[single], some[~single]
    made = [(low[~single], high[~single], left[some], key[some])]
    for size in range(2, longest + 1):
        for before in range(size):
            p = busy[(left[busy] >= before) & (right[busy] >= size - 1 - before)]
            s = p - before
            made.append((s, s + size - 1, np.full(len(p), -1), laid.keys(s, s + size - 1)[0]))
    return tuple(np.concatenate(v) for v in zip(*made, strict=True))


def packed_ends(laid: Laid, low: np.ndarray, high: np.ndarray, longest: int) -> np.ndarray:
    """Where the words of each fragment end, from its start on, in equal parts of one number; 0 where there is no word."""
    bits, ends = BITS // (2 * longest - 1), np.zeros(len(low), np.int64)
    for d in range(2 * longest - 1):
        word = np.minimum(low + d, high)
        ends |= np.where(low + d <= high, laid.at[word] + laid.size[word] - laid.at[low], 0) << (bits * d)
    return ends


#: ``shape`` holds the ends of a fragment's words, and above them the pivot's place, counted from 1; 0 for a phrase.
_SENT = "lang string, route int, shape bigint, fragment binary, n int"


def _route(shared, hot: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for laid, lang in _chunks(batches):
            low, high, at, route = fragments(laid, ranks, hot, longest)
            one, two = laid.keys(low, high)
            place = mix((at + 2).astype(np.uint64))
            items, counts = grouped(one ^ place, two ^ place)
            for a in range(0, len(items), STEP):
                k = items[a : a + STEP]
                shape = np.where(at[k] < 0, 0, packed_ends(laid, low[k], high[k], longest) | (at[k] + 1) << BITS)
                columns = [
                    lang.take(pa.array(laid.text[low[k]])), pa.array((mix(route[k]) >> np.uint64(33)).astype(np.int32)), pa.array(shape), laid.strings(low[k], high[k]), pa.array(counts[a : a + STEP].astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "route", "shape", "fragment", "n"])

    return run


def _owned(sent: DataFrame, longest: int) -> DataFrame:
    """Phrases of fragments that hold their pivot, as (lang, route, n, phrase): slices of a fragment's bytes.

    Every row meets a fixed list of places a phrase may have around the pivot; expressions stay small enough for the JVM to compile.
    """
    bits = BITS // (2 * longest - 1)
    places = ", ".join(f"named_struct('before', {b}, 'after', {m - 1 - b})" for m in range(2, longest + 1) for b in range(m))
    end = lambda k: f"(shiftright(shape, {bits} * ({k})) & {(1 << bits) - 1})"
    laid = sent.selectExpr("lang", "route", "n", "fragment", "shape", f"cast(shiftright(shape, {BITS}) as int) - 1 as at", f"explode(array({places})) as p")
    laid = laid.selectExpr("lang", "route", "n", "fragment", "shape", "at - p.before as first", "at + p.after as last", "p.before = 0 and p.after = 1 as once")
    laid = laid.filter(f"(shape = 0 and once) or (shape <> 0 and first >= 0 and last < {2 * longest - 1} and {end('last')} > 0)")
    start = f"case when first <= 0 then 0 else {end('first - 1')} + 1 end"
    return laid.selectExpr("lang", "route", "n", f"case when shape = 0 then fragment else substring(fragment, cast({start} + 1 as int), cast({end('last')} - {start} as int)) end as phrase")


def _piece(start: F.Column | int, size: F.Column | int) -> F.Column:
    return F.concat_ws(" ", F.slice("w", start if isinstance(start, F.Column) else F.lit(start), size if isinstance(size, F.Column) else F.lit(size)))


def mined(docs: DataFrame, least: int, longest: int, slots: int, shares: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Words (lang, word, n), phrases (lang, phrase, w, a) that stand ``least`` times or more, both written; all words by lang; their sum."""
    spark = docs.sparkSession
    own = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = own.mapInArrow(_count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = materialise(words, "phrase-words")
    whole = words.groupBy("lang").agg(F.sum("n").alias("n"))
    total = int(words.agg(F.sum("n").alias("n")).first()["n"] or 0)
    used = words.filter(F.col("n") >= least).mapInArrow(_slots(slots), "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    ranks = np.zeros(slots, np.uint8)  # as many rows as slots at most
    ranks[used.column("slot").to_numpy()] = rank_of(used.column("n").to_numpy())
    hot = int(rank_of(np.array([max(least, total // shares)]))[0])
    sent = own.mapInArrow(_route(spark.sparkContext.broadcast(ranks), hot, longest), _SENT)
    laid = _owned(sent.repartition("lang", "route"), longest)
    found = laid.groupBy("lang", "route", "phrase").agg(F.sum("n").alias("a")).filter(F.col("a") >= least).withColumn("phrase", F.col("phrase").cast("string"))
    found = materialise(found.select("lang", "phrase", F.split("phrase", " ").alias("w"), "a"), "phrase-mined")
    return words, found, whole, total


def _counts(rows: DataFrame, part: str, name: str, parts: DataFrame, hot: int) -> DataFrame:
    """Adds the count of each row's ``part`` as ``name``: hot parts by broadcast (their number is bounded), others by a shuffle."""
    few = parts.filter(F.col("f") >= hot).select("lang", F.col("phrase").alias(part), F.col("f").alias("_hot"))
    rest = parts.filter(F.col("f") < hot).select("lang", F.col("phrase").alias("_key"), F.col("f").alias("_cold"))
    met = rows.join(F.broadcast(few), ["lang", part], "left")
    # rows that are settled meet nothing: no part begins with a space
    key = F.when(F.col("_hot").isNull(), F.col(part)).otherwise(F.concat(F.lit(" "), F.col("phrase")))
    met = met.withColumn("_key", key).join(rest, ["lang", "_key"], "left")
    return met.withColumn(name, F.coalesce("_hot", "_cold")).drop("_hot", "_cold", "_key")


def collocations(
    docs: DataFrame, *, least: int = 10, longest: int = 3, top: int = 2000, cover: int = 50, slots: int = SLOTS, shares: int = SHARES
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``top`` phrases of every language of (lang, text).

    ``slots`` (a power of two) and ``shares`` decide where phrases are counted, never what is counted.
    """
    ship(docs.sparkSession)
    words, found, whole, total = mined(docs, least, longest, slots, shares)
    hot = max(least, total // shares)
    parts = words.filter(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.col("n").alias("f"))
    parts = parts.unionByName(found.filter(F.size("w") < longest).select("lang", "phrase", F.col("a").alias("f")))
    cuts = found.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _piece(1, F.col("k")).alias("one"), _piece(F.col("k") + 1, F.size("w") - F.col("k")).alias("two"))
    cuts = _counts(_counts(cuts, "one", "l", parts, hot), "two", "r", parts, hot)
    wide = "cast({0} as decimal(15, 0))"
    score = F.expr(f"(cast(1000000 as decimal(7, 0)) * {wide.format('a')} * {wide.format('a')}) div ({wide.format('l')} * {wide.format('r')})")
    cuts = cuts.withColumn("score", score.cast("bigint"))
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("b"))
    inner = [
        F.when(F.size("w") >= start + size, _piece(start + 1, size)) for size in range(2, longest) for start in range(longest - size + 1)
    ]  # shorter phrases at every place of a longer one
    if inner:
        within = found.filter(F.size("w") > 2).select("lang", F.explode(F.array_compact(F.array(*inner))).alias("phrase"), F.col("phrase").alias("longer"), "a")
        most = within.filter("phrase <> longer").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
        best = best.join(most, ["lang", "phrase"], "left").filter(F.coalesce(F.col("most") * 100 < F.col("a") * cover, F.lit(True)))
    rows = materialise(best.select("lang", "phrase", "a", "b.l", "b.r", "b.score"), "phrase-scored")
    # the step of the scale of scores that holds a language's last phrase to return; few rows a language, whatever its size
    step = F.floor(F.log2(F.col("score") + 1) * 64).cast("int")
    steps = rows.groupBy("lang", step.alias("step")).agg(F.count(F.lit(1)).alias("c"))
    down = Window.partitionBy("lang").orderBy(F.desc("step"))
    last = steps.withColumn("c", F.sum("c").over(down)).groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("c") >= top, F.col("step"))), F.lit(0)).alias("last"))
    last = materialise(last, "phrase-last")
    few = last.limit(LANGUAGES + 1).count() <= LANGUAGES
    rows = rows.join(F.broadcast(last) if few else last, "lang").filter(step >= F.col("last")).drop("last")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # many may share that step, so a language's first ones are sought among the first of its shares
    shares = rows.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = shares.withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).filter(F.col("_k") <= top).drop("_s", "_k")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.join(whole, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = 10, top: int = 2000, cover: int = 50) -> str:
    """DuckDB SQL of the same rows (phrases of two and three words) over the table ``documents``."""
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
with piece as materialized (select lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') as w from (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), '{up}', '{low}'), '[.,;:!?\x0A-\x0D]')) as p from documents)),
grams as materialized (select lang, m, g, count(*) as f from (select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) as g
  from piece cross join range(1, 4) t(m) where len(w) >= m) group by all),
total as (select lang, cast(sum(f) as bigint) as n from grams where m = 1 group by lang),
often as (select *, string_split(g, ' ') as w from grams where m > 1 and f >= {least}),
cut as (select s.*, k, array_to_string(w[1:k], ' ') as one, array_to_string(w[k + 1:], ' ') as two from often s cross join range(1, 3) t(k) where k < m),
scored as (select c.lang, c.g, c.f as a, x.f as l, y.f as r, k, cast((1000000::hugeint * c.f * c.f) // (x.f::hugeint * y.f) as bigint) as score
  from cut c join grams x on x.lang = c.lang and x.g = c.one join grams y on y.lang = c.lang and y.g = c.two),
best as (select * from scored qualify row_number() over (partition by lang, g order by score, k) = 1),
longer as (select lang, g, max(f) as most from (select lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as g from often where m = 3) group by all)
select b.lang, row_number() over (partition by b.lang order by score desc, a desc, b.g) as rank, b.g as phrase, a, l, r, n, score
from best b join total using (lang) left join longer o on o.lang = b.lang and o.g = b.g where coalesce(100 * most < {cover} * a, true) qualify rank <= {top}"""
