"""Sharding by histogram sort: exact byte counts below candidate key boundaries, refined until the splitters fit.

The sort key of a row is (xxhash64(text), doc_id), so equal texts lie side by side and a group of copies of any size
can still be cut between two doc_ids.  The key is read as a first digit of 16 bits and further ones of 8.  Each round
counts, for the prefixes that still hold an unplaced splitter, exact bytes and rows by the next digit (65,536 counts in
the first round, then 256 a prefix, with partial aggregation on every partition), and places a splitter at the digit
boundary nearest its target if that is within tolerance, else goes one digit deeper.  Rows then move once, to ranges
that are bounded in bytes and in rows; their number follows the rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, stored

SHARDS = 24
#: Bits of the digits of a key; the first seven make the hash, the others the id.
WIDTHS = (16, 8, 8, 8, 8, 8, 8) + (8,) * 8
HASH_DIGITS = 7
RANGES_PER_SHARD = 8
#: Rows that one task sorts; above RANGES_PER_SHARD times as many a shard, there are more ranges.
ROWS_PER_RANGE = 1_000_000


def _prefix(level: int, column: str, first: int) -> Column:
    """The leading digits, up to this level, of h or id as a number of the key's unsigned order; 0 if there are none."""
    bits = sum(WIDTHS[first:level])
    if bits <= 0:
        return F.lit(0).cast("long")
    flipped = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))
    return F.shiftrightunsigned(flipped, 64 - bits) if bits < 64 else flipped


def _packed(digits: tuple[int, ...], widths: tuple[int, ...]) -> int:
    value = 0
    for d, w in zip(digits, widths, strict=True):
        value = (value << w) + d
    return value


def _boundary(prefix: tuple[int, ...]) -> tuple[int, int]:
    """(h, id) of the smallest key that begins with these digits."""
    digits = (*prefix, *[0] * (len(WIDTHS) - len(prefix)))
    return _packed(digits[:HASH_DIGITS], WIDTHS[:HASH_DIGITS]) - (1 << 63), _packed(digits[HASH_DIGITS:], WIDTHS[HASH_DIGITS:]) - (1 << 63)


def _boundary_after(prefix: tuple[int, ...]) -> tuple[int, int] | None:
    """The smallest key after all that begin with prefix; None if there is none."""
    p = list(prefix)
    while p and p[-1] == (1 << WIDTHS[len(p) - 1]) - 1:
        p.pop()
    return _boundary((*p[:-1], p[-1] + 1)) if p else None


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def find_splitters(keys: DataFrame, targets: list[tuple[str, float]], tolerance: dict[str, float]) -> list[tuple[int, int]]:
    """For each (measure, amount) a key (h, id) so that the measure of the smaller keys is within tolerance of it.

    keys: h, id, size.  measure: ``size`` or ``rows``.  What comes to the driver is 65,536 counts in the first round
    and at most 256 for each unplaced splitter in the next ones, whatever the size of the input.
    """
    spark = keys.sparkSession
    found: dict[int, tuple[int, int]] = {}
    open_at = {i: ((), 0.0) for i in range(len(targets))}  # target: prefix, measure below it
    for level in range(len(WIDTHS)):
        prefixes = sorted({p for p, _ in open_at.values()})
        if not prefixes:
            break
        halves = lambda n: (_prefix(min(n, HASH_DIGITS), "h", 0), _prefix(n, "id", HASH_DIGITS))
        rows = keys.withColumn("at", F.lit(0))
        if level:
            packed = [(k, _signed(_packed(p[:HASH_DIGITS], WIDTHS[: len(p[:HASH_DIGITS])])), _signed(_packed(p[HASH_DIGITS:], WIDTHS[HASH_DIGITS : len(p)]))) for k, p in enumerate(prefixes)]
            known = spark.createDataFrame(packed, "at int, hp long, ip long")  # at most a row for each target
            hp, ip = halves(level)
            rows = keys.withColumn("hp", hp).withColumn("ip", ip).join(F.broadcast(known), ["hp", "ip"])
        digit = halves(level + 1)[0 if level < HASH_DIGITS else 1].bitwiseAND(F.lit((1 << WIDTHS[level]) - 1)).cast("int")
        counts: dict[int, list[tuple[int, float, float]]] = {k: [] for k in range(len(prefixes))}
        for r in rows.groupBy("at", digit.alias("digit")).agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect():
            counts[r["at"]].append((r["digit"], float(r["size"]), float(r["rows"])))
        sums, alone = {}, {}
        for k, p in enumerate(prefixes):
            c = sorted(counts[k])
            for m, name in ((1, "size"), (2, "rows")):
                below, total = [], 0.0
                for x in c:
                    below.append(total)
                    total += x[m]
                sums[p, name] = ([x[0] for x in c], below, total)
            alone[p] = {x[0] for x in c if x[2] <= 1}
        for i, (prefix, under) in list(open_at.items()):
            name, amount = targets[i]
            digits, below, total = sums[prefix, name]
            if not digits:
                found[i] = _boundary(prefix)
                del open_at[i]
                continue
            j = min(len(digits) - 1, max(0, bisect_left(below, amount - under) - 1))  # the digit that holds the target
            edge = lambda e: under + (below[e] if e < len(digits) else total)  # noqa: B023, E731
            near = min((j, j + 1), key=lambda e: abs(edge(e) - amount))
            if abs(edge(near) - amount) <= tolerance[name] or level == len(WIDTHS) - 1 or digits[j] in alone[prefix]:
                if near < len(digits):
                    found[i] = _boundary((*prefix, digits[near]))
                else:
                    found[i] = _boundary_after((*prefix, digits[-1])) or ((1 << 63) - 1, (1 << 63) - 1)
                del open_at[i]
            else:
                open_at[i] = ((*prefix, digits[j]), edge(j))
    return [found[i] for i in range(len(targets))]


def _placed(keys: DataFrame, splitters: list[tuple[int, int]], name: str) -> DataFrame:
    """Adds name: how many of the sorted splitters are at or below the row's key.

    A table over the first digit says how many are below all its keys, and which fall among them.
    """
    first = [(h + (1 << 63)) >> 48 for h, _ in splitters]
    rows = [(d, lo := bisect_left(first, d), [{"h": h, "id": i} for h, i in splitters[lo : bisect_right(first, d)]]) for d in range(65536)]
    table = keys.sparkSession.createDataFrame(rows, "d int, below int, among array<struct<h:long,id:long>>")
    own = F.struct("h", "id")
    both = keys.withColumn("d", _prefix(1, "h", 0).cast("int")).join(F.broadcast(table), "d")
    return both.withColumn(name, F.col("below") + F.size(F.filter("among", lambda s: s <= own))).drop("d", "below", "among")


def assign_shards(docs: DataFrame, n_shards: int = SHARDS, tolerance: float = 0.002, ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null): shards of near equal bytes.

    size is the UTF-8 bytes of the text, 0 for null, plus 8.  ``tolerance`` is how far the bytes below a splitter may
    be from their target, as a share of a shard's mean.  Equal texts get neighbouring places; a group of copies is
    cut only where a splitter has to fall inside it.  Repeated rows each get a place; null ids sort as 0.  slot
    counts from 0 without gaps in each shard, in key order.  An empty table gives no rows; with fewer rows than
    shards some shards stay empty.  Of the groups of equal texts only those are cut that a splitter has to fall in, that
    is where the bytes at neither of the group's ends are within tolerance of the target.
    """
    text = F.coalesce("text", F.lit(""))
    keys = pick(docs, "doc_id", "text").select(
        "doc_id", F.xxhash64(text).alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"),
    )
    keys = stored(keys, "shard-keys")
    total = keys.agg(F.sum("size").alias("size"), F.count("*").alias("rows")).first()
    size, rows = float(total["size"] or 0), float(total["rows"])
    fine = n_shards * max(ranges_per_shard, ceil(rows / n_shards / ROWS_PER_RANGE))
    targets = [("size", size * k / n_shards) for k in range(1, n_shards)] + [("rows", rows * k / fine) for k in range(1, fine)]
    bounds = find_splitters(keys, targets, {"size": tolerance * size / n_shards, "rows": 0.25 * rows / fine})
    cuts, ranges = sorted(bounds[: n_shards - 1]), sorted(set(bounds))
    placed = _placed(_placed(keys, ranges, "range"), cuts, "shard")
    counts = placed.groupBy("shard", "range").agg(F.count("*").alias("n"))  # at most a row for each of the ranges
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "range").orderBy("h", "id")
    return (
        placed.join(F.broadcast(offsets), ["shard", "range"])
        .withColumn("slot", F.row_number().over(within) - 1 + F.col("offset"))
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes each shard's rows (doc_id, text, slot) as Parquet under path/shard=K, through one exchange.

    The join back to the texts is by doc_id and the text's checksum; rows that agree in both are the same text, so
    it matters not which of them takes which slot.
    """
    places = assign_shards(docs, **options)
    rank = Window.partitionBy("doc_id", "text_crc32").orderBy("shard", "slot")
    texts = pick(docs, "doc_id", "text").withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit(""))))
    texts = texts.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "text_crc32").orderBy("text")))
    places = places.withColumn("nth", F.row_number().over(rank))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "text_crc32", "nth")]
    both = texts.alias("a").join(places.alias("b"), on).select("a.doc_id", "a.text", "b.shard", "b.slot")
    both.repartition("shard", (F.col("slot") / 100_000).cast("long")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
