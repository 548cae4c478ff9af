"""Near-duplicates by MinHash: an inverted join on signature coordinates, confirmed on full shingle sets.

1. A signature of COORDINATES minima is made for each text (Arrow batches, numpy), with two fingerprints of its set.
   Equal sets form a class; only its smallest doc_id takes part further, so copies cost one row each.
2. Every class is posted under each (coordinate, value) pair.  Values found once are dropped.  Two sets that agree in
   MATCHES coordinates must share one of the first m - MATCHES + 1 of a class's m remaining values in any fixed
   order; ordered by how often a value occurs, that prefix is the rarest ones, and the long lists are skipped.
3. Lists are not expanded into pairs.  The lists of a cluster agree on a pivot: the member with the most values that
   others share, handed on between lists that have members in common, HOPS times in the first round, less often in
   the next ones.  Every member is compared to the pivots of its lists, on the full sets of whole texts; that gives
   the elements in which the two sets differ.  Members linked to one pivot need no pairs among themselves.
4. A link between two members of which one is not linked to their pivot takes a common element of their differences
   (``_links_around`` proves how many), so these are found by a second inverted join, on the rarest elements.
5. Jaccard distance is a metric, so a member as near as INNER to the pivot has all its links among the members that
   are as near as NEAR; it leaves the list.  The pivot leaves too.  Once a round no longer halves what is listed, no
   dense cluster is left, and a last round takes the differences of all members, near or not: that settles all lists.

A pair at exactly the threshold 0.8 agrees in fewer than MATCHES of the COORDINATES with a chance of about one in a
million; steps 3 to 5 lose none of the pairs that agree in that many.  All tables between the steps are written to the
shared folder.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, stored

SHINGLE = 5
COORDINATES = 48
MATCHES = 24
#: Link where 100 * intersection >= PERCENT * union.
PERCENT = 80
#: How often lists hand their pivots on in the first round; once less in each of the next.
HOPS = 2
#: Percent similarity to a pivot.  Linked members' distances to a pivot differ by 100 - PERCENT at most.
INNER, NEAR = 40, 20
#: Members of one pivot that are compared in one task; more are dealt to several, each with the pivot's text.
MEMBERS_A_TASK = 256
#: A list of ids up to this length may be broadcast; a longer one is shuffled.
MAX_BROADCAST_IDS = 200_000
_BLOCK = 8192


@lru_cache(1)
def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240)
    odd = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd(64), odd(COORDINATES)[:, None], rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)[:, None]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The set of the text's k-word shingles as ascending 64-bit hashes.  A-Z are lower-cased, words are runs of other
    bytes than ASCII blanks; fewer than k words are one shingle; no words, none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    weights = _constants()[0]
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h += w[i : len(w) - n + 1 + i] * weights[i]
    return np.unique(_mixed(h))


def signature(s: np.ndarray) -> np.ndarray:
    """COORDINATES minima of a non-empty set, 32 bits each."""
    _, a, b = _constants()
    low = None
    for i in range(0, len(s), _BLOCK):
        part = (((s[None, i : i + _BLOCK] ^ b) * a)).min(axis=1)
        low = part if low is None else np.minimum(low, part)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n (size of the set), f1, f2 (its fingerprint), sig (empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, prints, sig = [], [], []
            for t in b.column("text"):
                s = shingles(t.as_py(), k)
                n.append(len(s))
                prints.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64))
                sig.append(signature(s) if len(s) else np.zeros(0, np.int32))
            f = np.array(prints, np.int64).reshape(-1, 2)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sig])]).astype(np.int32)
            flat = np.concatenate(sig) if sig else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                ["doc_id", "n", "f1", "f2", "sig"],
            )

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, sig array<int>")


def postings(classes: DataFrame) -> DataFrame:
    """classes: id, sig.  (id, m, key) of every class's prefix: its rarest values, as many as it needs; m is how many
    of its values others have too."""
    posted = classes.select("id", F.posexplode("sig").alias("c", "v")).select("id", F.xxhash64("c", "v").alias("key"))
    often = posted.groupBy("key").agg(F.count("*").alias("n")).where("n >= 2")
    grouped = posted.join(often, "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys"))
    need = F.size("keys") - MATCHES + 1
    prefix = F.transform(F.slice("keys", F.lit(1), F.greatest(need, F.lit(0))), lambda x: x["key"])
    return grouped.where(need >= 1).select("id", F.size("keys").alias("m"), F.explode(prefix).alias("key"))


def _pivots(members: DataFrame, hops: int) -> DataFrame:
    """members: id, m, key, comp.  (key, pivot) of the lists that hold two components or more.

    A list's first pivot is its member with the greatest m, the smallest id of those.  Handing on: a member knows the
    best pivot of its lists, a list takes the best that a member knows.
    """
    rank = F.struct("m", (-F.col("id")).alias("i"))
    lists = members.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.max(rank).alias("top")).where("least < most").select("key", "top")
    for _ in range(hops):
        known = members.join(lists, "key").groupBy("id").agg(F.max("top").alias("known"))
        lists = members.join(lists.select("key"), "key", "left_semi").join(known, "id").groupBy("key").agg(F.max("known").alias("top"))
    return lists.select("key", (-F.col("top")["i"]).alias("pivot"))


def _compared(pairs: DataFrame, docs: DataFrame, k: int, near: int) -> DataFrame:
    """pairs: a, b (the pivot).  a, q, b, p, n_a, n_b, same, d: fingerprints (q, p) and sizes of the full sets, how
    many elements both hold, and the elements that one of them only holds (null where the two are not ``near``).

    The pivot's text goes to each task that compares some of its members, the member's text moves once.  A doc_id with
    several texts is compared by each; the fingerprints tell them apart.
    """
    few = pairs.count() <= MAX_BROADCAST_IDS
    light = F.broadcast if few else lambda t: t
    tasks = pairs.groupBy("b").agg(F.ceil(F.count("*") / MEMBERS_A_TASK).cast("int").alias("tasks"))
    pairs = pairs.join(light(tasks), "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("tasks")).cast("int").alias("part"))
    own = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).join(light(pairs), "a")
    parts = tasks.select("b", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("part"))
    other = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")).join(light(parts), "b")
    both = own.join(other.hint("merge"), ["b", "part"]).select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: OrderedDict[str | None, tuple[np.ndarray, int]] = OrderedDict()

        def pivot(text: str | None) -> tuple[np.ndarray, int]:
            if text not in memo:
                memo[text] = (found := shingles(text, k), printed(found))
                while len(memo) > 8:
                    memo.popitem(last=False)
            memo.move_to_end(text)
            return memo[text]

        def printed(found: np.ndarray) -> int:
            return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for start in range(0, len(a), 256):
                end = min(start + 256, len(a))
                sizes, parts = [], []
                for i in range(start, end):
                    (t, p), s = pivot(batch.column("text_b")[i].as_py()), shingles(batch.column("text_a")[i].as_py(), k)
                    d = np.setxor1d(s, t, assume_unique=True).view(np.int64)
                    same = (len(s) + len(t) - len(d)) // 2
                    sizes.append((printed(s), p, len(s), len(t), same))
                    parts.append(d if 100 * same >= near * (len(s) + len(t) - same) else None)
                q, p, n_a, n_b, same = (pa.array([x[c] for x in sizes], pa.int64()) for c in range(5))
                yield pa.RecordBatch.from_arrays([pa.array(a[start:end], pa.int64()), q, pa.array(b[start:end], pa.int64()), p, n_a, n_b, same, pa.array(parts, pa.list_(pa.int64()))], ["a", "q", "b", "p", "n_a", "n_b", "same", "d"])

    return both.mapInArrow(run, "a long, q long, b long, p long, n_a long, n_b long, same long, d array<long>")


def _alike(percent: int) -> Column:
    """100 * intersection >= percent * union."""
    return 100 * F.col("same") >= percent * (F.col("n_a") + F.col("n_b") - F.col("same"))


def _links_around(compared: DataFrame) -> DataFrame:
    """compared: as of ``_compared``.  The linked pairs (a, b) of members of one pivot of which one at least is far,
    that is not linked to the pivot itself.

    Let Dx be the elements in which x and the pivot p differ, w_x = (100 + P) |Dx| - (100 - P) n_x and
    c = |Dx and Dy|, with P for PERCENT.  x and y differ in |Dx| + |Dy| - 2 c elements, so they are linked if and only
    if 2 (100 + P) c >= w_x + w_y, and x is far if and only if w_x > (100 - P) n_p.  What y must share with any far
    member follows from y alone: 2 (100 + P) c > w_y + (100 - P) n_p.  As n_y <= n_p + |Dy| and |Dy| >= c, w_y is at
    least 2 P c - (100 - P) n_p; so what a far x must share follows from x alone: 200 c >= w_x - (100 - P) n_p.
    Each member is listed once, under the rarest of the elements that it cannot do without.
    """
    group = ["b", "p"]
    weight = (100 + PERCENT) * F.size("d") - (100 - PERCENT) * F.col("n_a")
    rows = compared.where("d IS NOT NULL").select(*group, "a", "q", (~_alike(PERCENT)).alias("far"), "n_b", weight.alias("w"), F.explode("d").alias("e"))
    shared = rows.groupBy(*group, "e").agg(F.count("*").alias("often"), F.max("far").alias("far")).where("often >= 2 AND far").select(*group, "e", "often")
    members = rows.join(shared, [*group, "e"]).groupBy(*group, "a", "q").agg(F.sort_array(F.collect_list(F.struct("often", "e"))).alias("elements"), *[F.first(c).alias(c) for c in ("far", "w", "n_b")])
    step, slack = 2 * (100 + PERCENT), (100 - PERCENT) * F.col("n_b")
    members = members.withColumn("m", F.size("elements")).withColumn("gives", (F.floor((F.col("w") + slack) / step) + 1).cast("int"))
    members = members.withColumn("seeks", F.greatest(F.lit(1), F.ceil((F.col("w") - slack) / 200)).cast("int"))
    members = stored(members.where("m >= gives OR far AND m >= seeks"), "around")

    def listed(own: DataFrame, name: str, need: str) -> DataFrame:
        rarest = F.transform(F.slice("elements", F.lit(1), F.col("m") - F.col(need) + 1), lambda x: x["e"])
        named = [F.col(c).alias(f"{c}_{name}") for c in ("a", "q", "far", "w")]
        return own.where(F.col("m") >= F.col(need)).select(*group, *named, "m", F.posexplode(rarest).alias("at", "e")).withColumn(f"m_{name}", F.col("m") - F.col("at")).drop("m", "at")

    x, y = listed(members.where("far"), "x", "seeks"), listed(members, "y", "gives")
    # m_x and m_y: elements from the common one on; the first common one of a link leaves enough after it in both
    # two far members would meet twice, once as each other's x and y
    able = (F.col("a_x") != F.col("a_y")) & (~F.col("far_y") | (F.col("a_x") < F.col("a_y"))) & (step * F.least("m_x", "m_y") >= F.col("w_x") + F.col("w_y"))
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in (*group, "e")]
    pairs = x.alias("l").join(y.alias("r"), [*on, able]).select("l.b", "l.p", "a_x", "q_x", "a_y", "q_y", (F.col("w_x") + F.col("w_y")).alias("w")).distinct()
    for n in ("x", "y"):
        pairs = pairs.join(compared.select(*group, *[F.col(c).alias(f"{c}_{n}") for c in ("a", "q", "d")]), [*group, f"a_{n}", f"q_{n}"])
    linked = step * F.size(F.array_intersect("d_x", "d_y")) >= F.col("w")
    return pairs.where(linked).select(F.greatest("a_x", "a_y").alias("a"), F.least("a_x", "a_y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b.  (id, comp) of every id in edges: the smallest id that it is connected to.

    Each round takes the smallest label among an id's neighbours and then that label's own label; rounds go on until
    nothing changes.  Only a flag comes to the driver.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    while True:
        heard = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("h_id")).agg(F.min("comp").alias("heard"))
        stepped = labels.join(heard, F.col("id") == F.col("h_id"), "left").select("id", "comp", F.least("comp", F.coalesce("heard", "comp")).alias("low"))
        roots = labels.select(F.col("id").alias("r_id"), F.col("comp").alias("root"))
        moved = stepped.join(roots, F.col("low") == F.col("r_id"), "left").select("id", "comp", F.least("low", F.coalesce("root", "low")).alias("next"))
        moved = stored(moved, "labels")
        if moved.where("comp <> next").isEmpty():
            return labels
        labels = moved.select("id", F.col("next").alias("comp"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links lead to, itself included), kept.

    A null, empty or blank text has an empty set, is linked with nothing and is kept.  Rows without a doc_id are kept
    with a null component_id and link nothing.  Repeated rows of a doc_id are one document; should their texts
    differ, the links of all of them count.  An empty table gives no rows.
    """
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = stored(signatures(rows, k), "signatures")
    linkable = signed.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    # equal sets are one class, named by its smallest doc_id; its text is read again by that id
    classes = stored(linkable.groupBy("f1", "f2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    # the classes of a doc_id with several texts are linked by it
    several = linkable.groupBy("doc_id").agg(F.min("f1").alias("least"), F.max("f1").alias("most")).where("least < most").select("doc_id")
    several = linkable.join(several, "doc_id", "left_semi").join(classes.select("f1", "f2", "id"), ["f1", "f2"])
    several = several.groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("a"), F.collect_set("id").alias("ids")).where("a <> b")
    several = stored(several.select(F.explode("ids").alias("a"), "b").where("a <> b"), "several")
    posted = stored(postings(classes), "postings")
    labels, turn, listed, last = None if several.isEmpty() else components(several), 0, posted.count(), False
    while not last:
        if labels is None:
            members = posted.withColumn("comp", F.col("id"))
        else:
            members = stored(posted.join(labels, "id", "left").select("id", "m", "key", F.coalesce("comp", "id").alias("comp")), "labelled")
        members = stored(members.join(_pivots(members, max(0, HOPS - turn)), "key").select("id", "m", "key", "pivot"), "members")
        before, listed = listed, members.count()
        if not listed:
            break
        last = turn > HOPS and 2 * listed > before
        pairs = stored(members.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct(), "pairs")
        compared = stored(_compared(pairs, rows, k, 0 if last else NEAR), "compared")
        links = stored(compared.where(_alike(PERCENT)).select("a", "b").union(_links_around(compared)), "links")
        if not links.isEmpty():
            known = links if labels is None else links.union(labels.where("id <> comp").select(F.col("id").alias("a"), F.col("comp").alias("b")))
            labels = components(known)
        settled = compared.where(_alike(INNER)).select(F.col("a").alias("id"), F.col("b").alias("pivot")).distinct()
        posted = members.where("id <> pivot").join(settled, ["id", "pivot"], "left_anti").select("id", "m", "key")
        turn += 1
    named = classes.select("f1", "f2", "id")
    if labels is not None:
        named = named.join(labels, "id", "left").select("f1", "f2", F.coalesce("comp", "id").alias("id"))
    named = signed.join(named, ["f1", "f2"], "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("id")).otherwise(F.col("doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
