"""Set similarity join of texts by word shingles: universe partition and pigeonhole, verified exactly.

Sizes fall into bands; the pairs of a band are those whose larger set lies in it. For these the universe of tokens is
hashed to m segments, of which the first x also index their one-deletion neighbourhoods. A set of n tokens differs from
any set similar to it in at most H(n) tokens. It writes its segments in order until the pieces of weight in them come
to H(n) + 1 + s: a plain segment with tokens weighs 1 (it matches where nothing in it differs), a segment with
neighbourhoods weighs up to 2 (it matches where at most one token differs). As H bounds the difference of a pair from
either side, the set that stops first shares at least 1 + s of weight with its partner. x, m and the spare weight s are
chosen per band by a cost model: keys written, candidate pairs expected from partly similar texts, and sets that are
left to the exact way for the rest.

Texts that share a key are candidates. In a bucket of a few texts all pairs are; a larger bucket offers the pairs with
its first text, which links groups of copies, and stays open where those links leave its texts in several components.
Pairs are first compared by size and by a parity sketch (bits that each token flips; two sketches differ in no more
bits than the sets in tokens, so no similar pair is lost), then on their whole sets (64-bit hashes of the shingles).
A similar pair is missed only if all that it shares is open, so only where for both its texts the open segments weigh
more than their spare. Such texts (few, by the choice of s) are joined among themselves by the shingles that are rarest
among them: in the order of rarity, two similar sets share one of their first n - ceil(t n) + 1. Buckets of that join
that stay open are cut into blocks, and pairs of blocks are compared in separate tasks. So no link between components
is lost and no group of copies is expanded.

Copies are set aside before any text is read by Python: equal texts (by their 64-bit hash) are signed once, and equal
sets are joined once, under their fingerprint. Null and empty texts have no shingles and are linked with nothing: their
component is their own id. Repeated rows share a component. Rows with a null id take part; a component is named after
its least id that is not null. Input columns other than id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderly.llm.components import components
from orderly.session import bounded_batches, materialize, release

# The low bits of a key: the band of the pairs that it serves, and whether it comes from a segment with neighbourhoods.
BAND_BITS = 11
KEY_BITS = BAND_BITS + 1
LIGHT = 8
BLOCK = 256
# The bits by which rows are sifted: half a million numbers are sent to every executor at most.
SIFT_BITS = 1 << 25
# What the cost model takes for granted, in units of a written key: the texts that share a part with a given one, evenly
# spread in similarity (some for every text, and more the shorter it is); the cost of a candidate pair, and per token of one that has to be
# compared whole; the share of texts that hold a popular passage, and the cost per token of a set left to the exact way.
PARTNERS = 4.0
SHORT_PARTNERS = 400.0
PAIR_COST = 12.0
TOKEN_COST = 0.3
POPULAR = 0.1
REST_COST = 10.0


def splitmix(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; A-Z are lower-cased, words end at ASCII white space."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in parts], np.uint64)
    k = min(words, len(parts))
    out = np.full(len(parts) - k + 1, k, np.uint64)
    for i in range(k):
        out = splitmix(out) * np.uint64(0x9FB21C651E98DF25) + hashes[i : i + len(out)]
    return np.unique(splitmix(out))


@lru_cache(64)
def bands(percent: int) -> np.ndarray:
    """The least size of each size band. A band spans twice the ratio that similar sets may differ by, so that a pair
    lies in one band or in two that follow each other, and only the larger half of a band meets the next one."""
    least = [1]
    while least[-1] < 1 << 40:
        n = least[-1]
        least.append(max(n + 1, n * 10_000 // percent**2 + 1, n + n // 50))
    return np.array(least)


def most_differing(n: int, other: int, percent: int) -> int:
    """The most tokens in which sets of these two sizes may differ and still be similar."""
    return (100 - percent) * (n + other) // (100 + percent)


def reach(n: int, band: int, percent: int) -> int | None:
    """The most tokens in which a set of n may differ from a set similar to it in the pairs of a band, or None where
    none is in reach."""
    least = bands(percent)
    other = min(int(least[band + 1]) - 1, n * 100 // percent)
    return most_differing(n, other, percent) if n >= least[band] or other >= least[band] else None


def above(rate: np.ndarray, most: np.ndarray) -> np.ndarray:
    """About the chance that a Poisson variable exceeds ``most`` (a logistic curve in place of the normal one)."""
    return 1 / (1 + np.exp(np.clip(1.7 * (most + 0.5 - rate) / np.sqrt(rate + 0.05), -40, 40)))


def expected_cost(n: int, need: np.ndarray, m: np.ndarray, x: np.ndarray, s: np.ndarray, percent: int) -> np.ndarray:
    """The cost, in keys, of a set of n tokens that has to gather the weight ``need``, of which s is spare, from m
    segments, for arrays of choices."""
    mean = n / m
    deep = np.minimum(x, (need + 1) // 2)
    plain = np.minimum(m - x, np.maximum(0, need - 2 * deep))
    short = above(np.exp(-mean) * ((m - x) + x * (2 + mean)), m + x - need)
    pairs = stuck = 0.0
    for k in range(20):
        alike = (k + 0.5) / 20 * percent / 100
        differing = 2 * n * (1 - alike) / (1 + alike)
        rate = differing / m  # a segment's tokens that the partner lacks
        chance = -np.expm1(-np.exp(-rate) * (plain + deep * (1 + rate)))
        pairs += (PARTNERS + SHORT_PARTNERS / n) / 20 * chance * (PAIR_COST + TOKEN_COST * n * (differing < 1.5 * (need - s)))
        rate = (1 - alike) * mean  # a segment's tokens that lie outside the passage
        stuck += above(np.exp(-rate) * (plain + 2 * deep * (1 + rate)), s) / 20
    return plain + deep * (1 + mean) + pairs + REST_COST * n * (short + POPULAR * stuck)


@lru_cache(4096)
def allocation(percent: int, band: int) -> tuple[int, int, int]:
    """(segments m, the first x of them with one-deletion neighbourhoods, spare weight s) for the pairs of a band."""
    least = bands(percent)
    low, high = int(least[band]), int(least[band + 1]) - 1
    sizes = sorted({low, (low + high) // 2, high, max(1, -(-low * percent // 100))})
    needs = [(n, h + 1) for n in sizes if (h := reach(n, band, percent)) is not None]
    most = max(h for _, h in needs)
    spare = sorted({0, 1, 2, 3, 4, 5, 6, 8, 10, 12, *(most * k // 100 for k in (2, 4, 6, 8, 10, 15))})
    grid = [
        (x, s, max(1, x, most + s - x + more))
        for s in spare
        for x in sorted({*range(min(7, (most + s + 1) // 2 + 1)), *((most + s) * k // 200 for k in range(0, 101, 5))})
        for more in sorted({0, 1, 2, 3, *((most + s) * k // 100 for k in (1, 2, 4, 8, 12, 20, 30))})
    ]
    x, s, m = np.array(grid).T
    best = int(sum(expected_cost(n, h + s, m, x, s, percent) / n for n, h in needs).argmin())
    return int(m[best]), int(x[best]), int(s[best])


def keys_of(tokens: np.ndarray, band: int, percent: int) -> tuple[np.ndarray, int]:
    """Keys of one set in the pairs of a band, and the weight that may stay open before the set depends on it."""
    differing = reach(len(tokens), band, percent)
    if differing is None:
        return np.zeros(0, np.int64), 0
    m, x, s = allocation(percent, band)
    value = splitmix(tokens ^ splitmix(np.array([band], np.uint64)))
    segment = ((value >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
    count = np.bincount(segment, minlength=m)
    weight = np.minimum(count, 1)
    weight[:x] = np.minimum(count[:x], 2)
    gathered = np.cumsum(weight)
    need = differing + 1 + s
    used = min(m, int(np.searchsorted(gathered, need)) + 1)
    low = np.bincount(segment, (value & np.uint64(0xFFFFFFFF)).astype(float), m)
    high = np.bincount(segment, (value >> np.uint64(32)).astype(float), m)
    total = low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))
    salt = splitmix(np.arange(m, dtype=np.uint64) + np.uint64(band << 32))
    own = np.flatnonzero(count[:used])
    mask = ~np.uint64((1 << KEY_BITS) - 1)
    plain = own[own >= x]
    keys = (splitmix(total[plain] + salt[plain]) & mask) | np.uint64(band << 1)
    if x:
        deep = own[own < x]
        near = (segment < min(x, used)) & (count[segment] > 1)
        both = np.concatenate([total[deep] + salt[deep], total[segment[near]] - value[near] + salt[segment[near]]])
        keys = np.concatenate([keys, (splitmix(both) & mask) | np.uint64(band << 1 | 1)])
    return np.unique(keys).view(np.int64), s - max(0, need - int(gathered[used - 1]))


def sketch(tokens: np.ndarray, band: int, percent: int) -> np.ndarray:
    """Parity bits of a set, as many for all sets in the pairs of a band: each token flips one."""
    bits = 64 * max(1, most_differing(int(bands(percent)[band + 1]), int(bands(percent)[band + 1]), percent) * 8 // 64)
    flips = np.bincount((splitmix(tokens) % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64)


def fingerprint(tokens: np.ndarray) -> int | None:
    if not len(tokens):
        return None
    return int(np.array([xxhash.xxh64_intdigest(tokens.tobytes())], np.uint64).view(np.int64)[0])


SIGNED = T.StructType(
    [
        T.StructField("fp", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("band", T.IntegerType()),
        T.StructField("spare", T.ArrayType(T.IntegerType())),
        T.StructField("deep", T.ArrayType(T.IntegerType())),
        T.StructField("bits", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("keys", T.ArrayType(T.LongType())),
    ]
)


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def sifted(rows: DataFrame, hashed: Column, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose hash is in wanted (one column of hashes), with a few others, and the rest, of which none is. Only a
    bit of each wanted hash is sent to the tasks, in a table of bounded size, so that texts needn't be shuffled to be told apart."""
    bit = F.pmod(F.col(wanted.columns[0]), F.lit(SIFT_BITS))
    one = lambda at: F.expr(f"shiftleft(1L, cast({at} & 63 as int))")
    words = wanted.select(bit.alias("__bit")).groupBy(F.shiftright("__bit", 6).alias("__word")).agg(F.bit_or(one("__bit")).alias("__bits"))
    marked = rows.withColumn("__at", F.pmod(hashed, F.lit(SIFT_BITS))).join(F.broadcast(words), F.shiftright("__at", 6) == F.col("__word"), "left")
    found = F.coalesce(F.col("__bits").bitwiseAND(one("__at")) != 0, F.lit(False))
    return marked.where(found).select(*rows.columns), marked.where(~found).select(*rows.columns)


def one_of_each(texts: DataFrame, often: DataFrame) -> DataFrame:
    """(h, text): one row for every h of texts; often has the h that occur more than once."""
    some, alone = sifted(texts, F.col("h"), often)
    return alone.unionByName(some.groupBy("h").agg(F.first("text").alias("text")))


def signatures(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """h with fp (the set's fingerprint), n (its size), its band, and for the pairs of its own band and of the next
    one: spare, deep (the number of segments with neighbourhoods), bits (the parity sketch) and keys."""

    @F.pandas_udf(SIGNED)
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        least = bands(percent)
        for texts in batches:
            rows = []
            for text in texts:
                tokens = shingles(text, words)
                if not len(tokens):
                    rows.append((None, 0, 0, [], [], [], []))
                    continue
                band = int(np.searchsorted(least, len(tokens), "right")) - 1
                both = [keys_of(tokens, b, percent) for b in (band, band + 1)]
                deep = [allocation(percent, b)[1] for b in (band, band + 1)]
                bits = [sketch(tokens, b, percent) for b in (band, band + 1)]
                rows.append((fingerprint(tokens), len(tokens), band, [s for _, s in both], deep, bits, np.concatenate([k for k, _ in both])))
            out = pd.DataFrame(rows, columns=SIGNED.fieldNames())
            yield out.assign(fp=out["fp"].astype("Int64"))

    return texts.withColumn("s", signed.asNondeterministic()(F.col("text").cast("string"))).select("h", "s.*")


def candidates(rows: DataFrame, light: int = LIGHT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From distinct (key, fp, ...): candidate pairs (a, b), a < b, the rows of buckets too large to offer all their
    pairs, and the table behind those rows, to be released when they have been read. The rows are shuffled once, whatever
    their number: keys are counted where they have been brought together, and those of a single set (most) are not kept. A hot key
    adds at most a row a set to one task, which counts them in a buffer that spills."""
    shared = materialize(rows.withColumn("c", F.count("*").over(Window.partitionBy("key"))).where("c > 1"))
    few = shared.where(F.col("c") <= light).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("f"))
    every = F.flatten(F.transform("f", lambda a, i: F.transform(F.slice("f", i + 2, F.lit(light)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    many = shared.where(F.col("c") > light)
    first = materialize(many.groupBy("key").agg(F.min("fp").alias("a")))
    starred = many.join(first, "key").select("a", F.col("fp").alias("b")).where("a < b")
    pairs = materialize(few.select(F.explode(every).alias("p")).select("p.*").unionByName(starred).distinct())
    release(first)
    return pairs, many.select(*rows.columns), shared


def unlike(a: str, b: str, percent: int) -> str:
    """SQL: sizes or parity sketches of two sets (structs of n, band and bits) rule out that they are similar."""
    group = f"greatest({a}.band, {b}.band)"
    flipped = f"aggregate(zip_with({a}.bits[{group} - {a}.band], {b}.bits[{group} - {b}.band], (x, y) -> bit_count(x ^ y)), 0, (acc, c) -> acc + c)"
    far = f"100 * least({a}.n, {b}.n) < {percent} * greatest({a}.n, {b}.n)"
    return f"CASE WHEN {far} THEN true ELSE {100 + percent} * {flipped} > {100 - percent} * ({a}.n + {b}.n) END"


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and parity sketches do not rule out. sets: fp, n, band, bits."""
    left, right = (sets.select(F.col("fp").alias(s), F.struct("n", "band", "bits").alias(f"s{s}")) for s in "ab")
    return pairs.join(left, "a").join(right, "b").where(f"NOT {unlike('sa', 'sb', percent)}").select("a", "b")


def token_sets(texts: DataFrame, often: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """(fp, tokens) of the sets asked for (fp, h)."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, words).view(np.int64) for t in texts])

    found = one_of_each(sifted(texts, F.col("h"), asked.select("h"))[0], often).join(asked, "h")
    return materialize(found.select("fp", tokens(F.col("text").cast("string")).alias("tokens")))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets reach the threshold."""
    left = sets.select(F.col("fp").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("fp").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("ta") + F.size("tb") - both)).select("a", "b")


def open_buckets(heavy: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows (key, fp, root, c) of those large buckets in which the links found leave several components; c is the
    number of sets in the bucket."""
    named = heavy.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    several = named.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("c")).where("r0 != r1")
    several = materialize(several.select("key", "c"))
    rows = materialize(named.join(several, "key"))
    release(several)
    return rows


def rarest(sets: DataFrame, percent: int) -> DataFrame:
    """(key, fp, n, i): of each set those among its first shingles in the order of rarity that another set has too; a set
    shares one of them with any set similar to it. n is the set's size and i the shingle's place, from 0. Shingles of
    one set alone (most) come first in that order and are only counted."""
    tokens = sets.select("fp", F.size("tokens").alias("n"), F.explode("tokens").alias("key"))
    often = materialize(tokens.groupBy("key").count().where("count > 1"))
    ranked = tokens.join(often, "key").groupBy("fp", "n").agg(F.sort_array(F.collect_list(F.struct("count", "key"))).alias("t"))
    alone = F.col("n") - F.size("t")
    first = F.greatest(F.expr(f"cast(n - ceil(n * {percent} / 100) + 1 as int)") - alone, F.lit(0))
    some = ranked.select(F.posexplode(F.slice("t", F.lit(1), first)).alias("i", "t"), "fp", "n", alone.alias("alone"))
    return some.select("t.key", "fp", "n", (F.col("i") + F.col("alone")).alias("i"))


def likely(one: pd.DataFrame, two: pd.DataFrame, percent: int) -> np.ndarray:
    """Which rows of one and two (fp, root, n, i, band, bits) may be similar: of different components, near in size, with few
    enough rarer shingles before the shared one, and with parity sketches near enough."""
    n, m = one["n"].to_numpy(np.int64)[:, None], two["n"].to_numpy(np.int64)[None]
    before = one["i"].to_numpy(np.int64)[:, None] + two["i"].to_numpy(np.int64)[None]
    may = (one["root"].to_numpy()[:, None] != two["root"].to_numpy()[None]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    may &= (100 + percent) * before <= (100 - percent) * (n + m)
    bands = [np.asarray(x["band"], np.int64) for x in (one, two)]
    for a in np.unique(bands[0]):
        for b in np.unique(bands[1]):
            rows, columns = np.flatnonzero(bands[0] == a), np.flatnonzero(bands[1] == b)
            if abs(a - b) > 1:
                may[np.ix_(rows, columns)] = False
                continue
            left, right = (np.array([x["bits"].iloc[k][max(a, b) - own] for k in at]).view(np.uint64) for x, at, own in ((one, rows, a), (two, columns, b)))
            for k, row in enumerate(rows):
                may[row, columns] &= (100 + percent) * np.bitwise_count(left[k] ^ right).sum(1) <= (100 - percent) * (n[row, 0] + m[0, columns])
    return may


def linked(one: pd.DataFrame, two: pd.DataFrame, may: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of fingerprints that are similar, by their whole token sets; pairs that earlier ones connect are passed over."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.get(x, x)) != x:
            x = up[x] = up.get(y, y)
        return x

    found = []
    for r, c in zip(*np.nonzero(may), strict=True):
        a, b = find(one["root"].iloc[r]), find(two["root"].iloc[c])
        if a != b:
            s, t = one["tokens"].iloc[r], two["tokens"].iloc[c]
            both = len(np.intersect1d(s, t, assume_unique=True))
            if 100 * both >= percent * (len(s) + len(t) - both):
                up[max(a, b)] = min(a, b)
                x, y = int(one["fp"].iloc[r]), int(two["fp"].iloc[c])
                found.append((min(x, y), max(x, y)))
    return found


def within(rest: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Similar pairs (a, b) that connect the components inside open buckets. rest: key, fp, root, n, i, c. A bucket is cut
    into blocks of about ``block`` sets, and two blocks meet under a key of their own, so the pairs of a large bucket
    are dealt to many tasks, each of two blocks at most. Sketches are compared first; only rows that some sketch leaves
    possible carry their tokens to the exact comparison. What passes is verified on the spot, so that neither near misses nor
    all pairs of a group of copies are ever written out."""
    blocks = F.ceil(F.col("c") / block).cast("int")
    cut = rest.join(reps.select("fp", "band", "bits"), "fp").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pair = F.struct(F.least("block", "other").alias("from"), F.greatest("block", "other").alias("to"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", pair.alias("p"), "block", "fp", "root", "n", "i", "band", "bits")
    fields = "key long, `from` int, `to` int, block int, fp long, root long, n long, i int, band int, bits array<array<bigint>>"

    def sides(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray]:
        rows = rows.sort_values("fp")
        one, two = rows[rows["block"] == rows["from"]], rows[rows["block"] == rows["to"]]
        may = likely(one, two, percent)
        return one, two, np.triu(may, 1) if rows["from"].iloc[0] == rows["to"].iloc[0] else may

    def possible_rows(rows: pd.DataFrame) -> pd.DataFrame:
        one, two, may = sides(rows)
        return pd.concat([one[may.any(1)], two[may.any(0)]]).drop_duplicates("fp")

    def similar(rows: pd.DataFrame) -> pd.DataFrame:
        one, two, may = sides(rows)
        return pd.DataFrame(linked(one, two, may, percent), columns=["a", "b"])

    where = ["key", "from", "to"]
    active = materialize(met.select("key", "p.*", "block", "fp", "root", "n", "i", "band", "bits").groupBy(*where).applyInPandas(possible_rows, fields))
    return active.join(sets, "fp").groupBy(*where).applyInPandas(similar, "a long, b long").distinct()


def grouped(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, light: int = LIGHT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """One row per row of docs: id, h (a hash of the text) and fp (NULL: no shingles). And one row per set: fp, n, root
    (shared by the sets of a component) and least, the component's least id."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(text_hash(text_col).alias("h"), F.col(text_col).alias("text"))
    members = materialize(docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("h")))
    often = materialize(members.groupBy("h").count().where("count > 1").select("h"))
    signed = materialize(signatures(one_of_each(texts, often), words, percent))
    full = signed.where("fp IS NOT NULL")
    reps = materialize(full.drop("keys").groupBy("fp", "n", "band").agg(F.min_by(F.struct("h", "spare", "deep", "bits"), "h").alias("s"), F.count("*").alias("c")).select("fp", "n", "band", "s.*", "c"))
    twice = materialize(reps.where("c > 1").select(F.col("fp").alias("same"), F.col("h").alias("kept")))
    once = full.select("fp", "h", "keys").join(twice, (F.col("fp") == F.col("same")) & (F.col("h") != F.col("kept")), "left_anti")
    pairs, heavy, shared = candidates(once.select(F.explode("keys").alias("key"), "fp"), light)
    plain = members
    members = materialize(members.join(signed.select("h", "fp"), "h"))
    release(signed, plain, twice)

    maybe = materialize(possible(pairs, reps, percent))
    asked = materialize(maybe.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(reps, "fp").select("fp", "h"))
    sets = token_sets(texts, often, asked, words)
    links = materialize(verified(maybe, sets, percent))
    roots = components(links)
    release(pairs, maybe, asked, sets, links)

    at = F.shiftright(F.col("key"), 1).bitwiseAND((1 << BAND_BITS) - 1).cast("int")
    kind = F.col("key").bitwiseAND(1)
    opened = open_buckets(heavy, roots)
    release(shared)
    left = opened.groupBy("fp", at.alias("at")).agg(F.count_if(kind == 0).alias("plain"), F.count_if(kind == 1).alias("deep_keys"))
    depends = left.join(reps, "fp").where("plain + 2 * least(deep_keys, deep[at - band]) > spare[at - band]")
    weak = reps.where(F.array_min("spare") < 0)
    hard = materialize(depends.select("fp", "h").unionByName(weak.select("fp", "h")).distinct())
    release(opened)
    if hard.limit(1).count():
        sets = token_sets(texts, often, hard, words)
        pairs, heavy, shared = candidates(rarest(sets, percent), light)
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(verified(possible(pairs, reps, percent), sets, percent))
        roots = components(links)
        rest = open_buckets(heavy, roots)
        found = materialize(within(rest, reps, sets, percent, block))
        if found.limit(1).count():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))
        release(pairs, shared, rest, sets, found)

    least = members.where("fp IS NOT NULL").groupBy("fp").agg(F.min("id").alias("id"))
    rooted = reps.select("fp", "n").join(least, "fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = materialize(rooted.withColumn("root", F.coalesce("root", "fp")))
    named = materialize(rooted.groupBy("root").agg(F.min("id").alias("least")))
    sets = materialize(rooted.drop("id").join(named, "root").select("fp", "n", "root", "least"))
    release(often, hard, reps, rooted, named)
    return members, sets


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, light: int = LIGHT, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id. Two texts link where the Jaccard similarity of their
    sets of ``words``-word shingles reaches ``percent`` in a hundred."""
    members, sets = grouped(docs, id_col, text_col, words, percent, light, block)
    return members.join(sets, "fp", "left").select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("least", "id").alias("component_id")
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component: that of the least id (null ids last), then of the least hash of the text. Rows are told apart by id and
    text, so repeated and null ids lose no other text. Texts without shingles stay, each as its own group. Of rows that
    repeat id and text one stays, that with the least other columns; null ids without shingles are nobody's copies."""
    members, sets = grouped(docs, id_col, text_col, words, percent)
    found = materialize(members.join(sets.select("fp", "root"), "fp", "left").select("id", "h", "root"))
    release(members, sets)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id1"), F.col("h").alias("h1")))
    best = materialize(found.where("root IS NOT NULL").groupBy("root").agg(first.alias("b")).select("root", "b.id1", "b.h1"))
    gone = materialize(found.join(best, "root").where("NOT (id <=> id1 AND h = h1)").select(F.col("id").alias("__id"), F.col("h").alias("__h")).distinct())
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (text_hash(text_col) == F.col("__h"))
    marks = gone.select(F.xxhash64("__id", "__h").alias("mark"))
    both = F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h"))
    spared = sifted(found, F.xxhash64("id", "h"), marks)[0].join(gone, both, "left_anti")
    spared = materialize(spared.select(F.col("id").alias("__id"), F.col("h").alias("__h")))
    some, others = sifted(docs, F.xxhash64(F.col(id_col), text_hash(text_col)), marks)
    kept = others.unionByName(some.join(spared, same, "left_semi"))
    often = found.groupBy("id", "h").agg(F.count("*").alias("c"), F.max("root").alias("root")).where("c > 1 AND (root IS NOT NULL OR id IS NOT NULL)")
    often = materialize(often.select(F.col("id").alias("__id"), F.col("h").alias("__h")))
    release(found, best)
    if often.limit(1).count():
        one = kept.join(often, same, "left_semi").groupBy(F.col(id_col).alias("__id"), text_hash(text_col).alias("__h"))
        one = one.agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
        kept = kept.join(often, same, "left_anti").unionByName(one)
    return kept.select(*docs.columns)
