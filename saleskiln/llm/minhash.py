"""Near-duplicates by HyperMinHash.

A document's shingle hashes fall into buckets by their first bits; a bucket keeps, of its smallest hash, the number of
leading zeros and some bits of mantissa: two bytes instead of eight. An empty bucket borrows from a bucket drawn by a
fixed sequence of its own, so that short texts fill all registers and two sets agree in one with a chance near their
similarity. Bands of registers propose pairs, the share of equal registers, less what equals by compression, estimates
the similarity, and full sets decide.

Of a group of documents with equal sets only one goes on. In a bucket of a band, documents are held against one hub,
the member that shares most buckets with others. Buckets that this leaves with several components are open: their
members are held against those of other components that share one of their rarest shingles, which linked sets must. So
a group of thousands of copies costs a comparison each, near misses cost few, and no link between components is lost:
every pair that a band proposes is either compared, already connected, or below the threshold by its sizes, its rarest
shingles, or an estimate six standard errors too low.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

from saleskiln.llm.common import Scratch, batch_udf, unused_name, with_struct
from saleskiln.llm.components import components

SHINGLE_WORDS = 5
#: Two sets are linked from this percentage of their union on.
PERCENT = 85
#: Buckets as a power of two, mantissa bits; registers of a band, bands.
LOG_BUCKETS, MANTISSA, ROWS = 7, 10, 5
BUCKETS = 1 << LOG_BUCKETS
BANDS = BUCKETS // ROWS
#: Bits, as a power of two, of the bitmap that holds texts back before sets are fetched: 4 MB at every size of the input.
LOG_BITMAP, BLOCK = 25, 1 << 15
#: Shingles that more members than this have are not ordered by how many.
RARE = 32
#: Estimates this many standard errors below the threshold are dropped before sets are fetched.
ERRORS = 6
LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b" \t\n\x0b\x0c\r" else b for b in range(256))
BASE, STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def powers(base: int, count: int) -> np.ndarray:
    out, value = np.empty(count, np.uint64), 1
    for k in range(count):
        out[k] = value
        value = value * base & 0xFFFFFFFFFFFFFFFF
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles: of all runs of ``size`` words, or of fewer words as one."""
    parts = [text.encode().translate(LOWER) + b" " for text in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    is_word = data != 32
    starts = np.flatnonzero(is_word & ~np.concatenate([[False], is_word[:-1]]))
    ends = np.flatnonzero(~is_word & np.concatenate([[False], is_word[:-1]]))
    if not len(starts):
        return [np.array([], np.uint64)] * len(texts)
    lengths = ends - starts
    # a word's hash: its bytes as digits of a number to an odd base, times what its length gives
    at = np.arange(len(data)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))
    terms = np.where(is_word, (data.astype(np.uint64) + np.uint64(1)) * powers(BASE, int(lengths.max()) + 1)[np.minimum(at, lengths.max())], np.uint64(0))
    words = mix(np.add.reduceat(terms, starts) + mix(lengths.astype(np.uint64)))
    # of each run of words, and of shorter texts as a whole
    edge = np.searchsorted(starts, np.cumsum([len(p) for p in parts]))
    steps = powers(STEP, size)
    runs = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for k in range(size):
        runs += words[k : k + len(runs)] * steps[k]
    runs = mix(runs)
    out, first = [], 0
    for last in edge:
        count = last - first
        if count >= size:
            out.append(np.unique(runs[first : last - size + 1]))
        elif count:
            out.append(mix(np.array([np.sum(words[first:last] * steps[:count])], np.uint64) + np.uint64(count)))
        else:
            out.append(np.array([], np.uint64))
        first = last
    return out


def loan_order() -> np.ndarray:
    """For each bucket the order in which it looks for a register to borrow, itself first; the same everywhere."""
    rng = np.random.default_rng(20240501)
    order = np.argsort(rng.random((BUCKETS, BUCKETS)), axis=1)
    return np.concatenate([np.arange(BUCKETS)[:, None], order], axis=1)


def registers_of(hashes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Registers of a sorted, non-empty set: leading zeros in the high bits, the mantissa behind them in the low ones."""
    bucket = (hashes >> np.uint64(64 - LOG_BUCKETS)).astype(np.int64)
    filled, first = np.unique(bucket, return_index=True)
    rest = (hashes[first] << np.uint64(LOG_BUCKETS)) | np.uint64(1)
    exponent = np.frexp(rest.astype(np.float64))[1].astype(np.int64)
    exponent = np.minimum(exponent, 64)
    zeros = 64 - exponent
    mantissa = ((rest << zeros.astype(np.uint64)) << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    own = np.zeros(BUCKETS, np.uint16)
    own[filled] = (zeros.astype(np.uint16) << MANTISSA) | mantissa.astype(np.uint16)
    if len(filled) == BUCKETS:
        return own
    has = np.zeros(BUCKETS, bool)
    has[filled] = True
    lender = order[np.arange(BUCKETS), has[order].argmax(axis=1)]
    return own[lender]


def collision_rate(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Chance that the registers of two different smallest hashes are equal, for sets of these sizes: the sum over all
    register values of both chances, which are those of the least of that many uniform numbers."""
    a, b = np.maximum(n_a / BUCKETS, 1.0), np.maximum(n_b / BUCKETS, 1.0)
    total = np.zeros(len(a))
    for zeros in range(64 - LOG_BUCKETS - MANTISSA):
        low, high = 2.0 ** -(zeros + 1), 2.0**-zeros
        total += (high - low) * 2.0**-MANTISSA * a * b / (a + b) * (np.exp(-(a + b) * low) - np.exp(-(a + b) * high))
    return total


def similarity_estimate(left: list[bytes], right: list[bytes], n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    a = np.frombuffer(b"".join(left), np.uint16).reshape(-1, BUCKETS)
    b = np.frombuffer(b"".join(right), np.uint16).reshape(-1, BUCKETS)
    chance = collision_rate(n_a, n_b)
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


def sketches(docs: DataFrame, text_column: str, size: int) -> DataFrame:
    """``docs`` with n_shingles, set_key (digest of the whole set) and registers, both null for an empty set."""

    def start():
        order = loan_order()

        def work(texts: list) -> pa.Array:
            sets = shingle_sets([t or "" for t in texts], size)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            registers = [registers_of(s, order).tobytes() if len(s) else None for s in sets]
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(registers, pa.binary())]
            return pa.StructArray.from_arrays(columns, ["n_shingles", "set_key", "registers"])

        return work

    return with_struct(docs, batch_udf("n_shingles bigint, set_key binary, registers binary", start)(F.col(text_column)), ["n_shingles", "set_key", "registers"])


def full_sets(docs: DataFrame, text_column: str, size: int) -> DataFrame:
    """``docs`` with the hashes of each whole set."""
    start = lambda: lambda texts: pa.array([s.view(np.int64) for s in shingle_sets([t or "" for t in texts], size)], pa.list_(pa.int64()))
    return docs.withColumn("hashes", batch_udf("array<bigint>", start)(F.col(text_column)))


def sets_of(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, hashes) of the rows of ``texts`` whose node is in ``wanted``.

    The join would shuffle every text for the few that are wanted. So a bitmap of the hashes of the wanted nodes, of a
    fixed size, is broadcast first; where it is dense it lets more texts through, and the join decides in any case.
    """
    place = lambda frame: frame.withColumn("place", F.pmod(F.xxhash64("node"), F.lit(1 << LOG_BITMAP))).withColumn("block", F.floor(F.col("place") / BLOCK))
    at = F.col("place") % BLOCK
    marks = place(wanted.select("node")).select("block", at.alias("at")).repartition("block").groupBy("block").agg(F.bitmap_construct_agg("at").alias("marks"))
    byte = F.conv(F.hex(F.substring("marks", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = place(texts).join(F.broadcast(marks), "block").where(F.getbit(byte, (at % 8).cast("int")) == 1)
    return full_sets(held.select("node", "text"), "text", size).select("node", "hashes").join(wanted, "node", "left_semi")


@arrow_udf(DoubleType())
def estimate(left: pa.Array, right: pa.Array, n_a: pa.Array, n_b: pa.Array) -> pa.Array:
    if not len(left):
        return pa.array([], pa.float64())
    return pa.array(similarity_estimate(left.to_pylist(), right.to_pylist(), n_a.to_numpy(), n_b.to_numpy()))


def band_keys(registers: Column) -> Column:
    """One hash per band of registers."""
    return F.array(*[F.xxhash64(F.lit(k), F.substring(registers, 2 * ROWS * k + 1, 2 * ROWS)) for k in range(BANDS)])


def sized_enough(a: str, b: str, percent: int) -> Column:
    """Sets whose sizes alone leave the threshold open."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, scratch: Scratch, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. Sizes and the estimate from the registers come first."""
    facts = lambda end: nodes.select(F.col("node").alias(end), F.col("n_shingles").alias(f"n_{end}"), F.col("registers").alias(f"r_{end}"))
    floor = percent / 100 - ERRORS * (percent / 100 * (1 - percent / 100) / BUCKETS) ** 0.5
    near = pairs.join(facts("a"), "a").join(facts("b"), "b").where(sized_enough("n_a", "n_b", percent))
    near = near.withColumn("about", estimate("r_a", "r_b", "n_a", "n_b")).where(F.col("about") >= floor)
    near = scratch.write(near.select("a", "b"))
    wanted = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    sets = scratch.write(sets_of(texts, wanted, size))
    side = lambda end: sets.select(F.col("node").alias(end), F.col("hashes").alias(f"h_{end}"))
    both = F.size(F.array_intersect("h_a", "h_b"))
    union = F.size("h_a") + F.size("h_b") - both
    sure = near.join(side("a"), "a").join(side("b"), "b").where(100 * both >= percent * union)
    sure = scratch.write(sure.select("a", "b").distinct())
    scratch.drop(sets)
    return sure


def rarest_shingles(members: DataFrame, texts: DataFrame, scratch: Scratch, size: int, percent: int) -> DataFrame:
    """(node, length, hash, place): those shingles of each set of ``members``, in an order that is the same for all sets,
    one of which any linked set must have too.

    An intersection of ``percent`` of a union leaves out few of either set's shingles, so the first shingles in any order
    cannot all be missing from it. Rare ones come first: those that no other member has, which only take up places, then
    those that up to RARE members have, by their number, then all others. Near misses differ in rare shingles, so they
    have none of the first ones in common.
    """
    none = F.array().cast("array<bigint>")
    sets = scratch.write(sets_of(texts, members.select("node").distinct(), size).distinct())
    held = sets.select("node", F.explode("hashes").alias("hash")).distinct()
    counts = scratch.write(held.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where(F.col("n") <= RARE))
    length = F.size("hashes")
    own = counts.where("n = 1").groupBy("node").agg(F.collect_list("hash").alias("lone"))
    left = sets.join(own, "node", "left").withColumn("lone", F.array_intersect("hashes", F.coalesce("lone", none)))
    left = scratch.write(left.where(100 * (length - F.size("lone")) >= percent * length))
    held = left.select("node", F.explode(F.array_except("hashes", "lone")).alias("hash")).distinct()
    few = held.join(counts.where("n > 1").select("hash", "n"), "hash").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "hash"))).alias("few"))
    few = few.select("node", F.col("few")["hash"].alias("few"))
    order = F.concat(F.array_intersect("few", "hashes"), F.array_sort(F.array_except(F.array_except("hashes", "lone"), "few")))
    first = (length - F.ceil(percent * length / 100) + 1 - F.size("lone")).cast("int")
    left = left.join(few, "node", "left").withColumn("few", F.coalesce("few", none))
    out = left.select("node", length.alias("length"), F.size("lone").alias("before"), F.posexplode(F.slice(order, F.lit(1), first)).alias("at", "hash"))
    return out.select("node", "length", "hash", (F.col("before") + F.col("at") + 1).alias("place"))


def leftover_pairs(members: DataFrame, texts: DataFrame, scratch: Scratch, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ``members`` (node, component) in different components that can be linked: they have one of
    their rarest shingles in common, with enough shingles of both behind it. Of those that have a shingle in common,
    only the ones outside its largest component are held against all."""
    firsts = scratch.write(rarest_shingles(members, texts, scratch, size, percent).join(members, "node"))
    largest = firsts.groupBy("hash", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("hash").agg(F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("many"))
    outside = firsts.join(largest.where("many > 1").select("hash", F.col("top")["component"].alias("home")), "hash").where("component <> home")
    outside = outside.select("hash", F.col("node").alias("x"), F.col("component").alias("cx"), F.col("length").alias("lx"), F.col("place").alias("px"))
    # of sizes that sum to s, a pair needs s * percent / (100 + percent) shingles in common
    behind = 1 + F.least(F.col("lx") - F.col("px"), F.col("length") - F.col("place"))
    enough = (100 + percent) * behind >= percent * (F.col("lx") + F.col("length"))
    pairs = outside.join(firsts, "hash").where((F.col("cx") != F.col("component")) & enough)
    return pairs.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id", size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with n_shingles, component_id (smallest id reachable over links, itself included) and kept.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their shingle sets. A null or empty text,
    or one without words, has an empty set and no links. Rows that share an id count as one document, linked if any of
    its texts is. Rows without an id have no links: their
    n_shingles and component_id are null, and they are kept. Ids are of any type that has an order. An empty table gives
    no rows; columns of these names are replaced.
    """
    scratch = Scratch(docs.sparkSession)
    ids = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    marked = scratch.write(sketches(ids, "text", size).drop("text"))
    usable = marked.where("id is not null and set_key is not null")
    # one node per distinct set: the smallest id that has it
    nodes = scratch.write(usable.groupBy("set_key").agg(F.min("id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")))
    same = usable.join(nodes.select("set_key", "node"), "set_key").select("id", "node").where("id <> node").distinct()
    texts = ids.withColumnRenamed("id", "node")

    bands = nodes.select("node", F.explode(band_keys(F.col("registers"))).alias("band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = scratch.write(bands.join(shared, "band").distinct())
    fame = members.groupBy("node").agg(F.sum("n").alias("fame"))
    famed = members.join(fame, "node").groupBy("band").agg(F.min(F.struct((-F.col("fame")).alias("less"), "node")).alias("top"))
    hubs = famed.select("band", F.col("top")["node"].alias("hub"))
    spokes = members.join(hubs, "band").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    sure = confirmed(spokes, nodes, texts, scratch, size, percent)
    labels = components(sure, scratch)

    # buckets that still hold several components: their members by their rarest shingles
    placed = scratch.write(members.join(labels, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component")))
    mixed = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
    open_ = scratch.write(placed.join(mixed, "band", "left_semi").select("node", "component").distinct())
    rest = leftover_pairs(open_, texts, scratch, size, percent)
    more = confirmed(rest.join(spokes, ["a", "b"], "left_anti"), nodes, texts, scratch, size, percent)

    links = sure.unionByName(more).unionByName(same.select(F.col("node").alias("a"), F.col("id").alias("b")))
    found = components(links, scratch).select(F.col("node").alias("id"), "component")
    result = marked.groupBy("id").agg(F.max("n_shingles").alias("n_shingles")).where("id is not null").join(found, "id", "left")
    result = scratch.write(result.select("id", "n_shingles", F.coalesce("component", "id").alias("component_id")))
    base = docs.drop("n_shingles", "component_id", "kept")
    key = unused_name(base, "near_id")
    out = base.join(result.withColumnRenamed("id", key), base[id_column] == F.col(key), "left").drop(key)
    return out.withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True)))
