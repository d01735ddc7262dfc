"""N-gram Jaccard join (2): parity sketches, pigeonhole by size band, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostweave.llm import kernels as K
from hostweave.llm.common import Workspace, keyed, semi, small_batches
from hostweave.llm.components import components

#: Words of the compact sketch that prunes candidates by Hamming distance, of 64 bits each.
SKETCH_WORDS = 8
#: Leaves of one hub that one task compares with it.
LEAVES = 128
#: Leaves of a hub, and members of all their sets, up to which one task compares the leaves with each other.
GROUP_LEAVES, GROUP_MEMBERS = 2048, 1_000_000
_U = np.uint64


def difference_bounds(a: int, threshold: tuple[int, int]) -> tuple[int, int]:
    """The largest symmetric difference of a set of size a with a partner at or above the threshold p / q: with any partner, and with one that isn't larger.

    |A and B| >= t |A or B| gives |A xor B| <= (1 - t) / (1 + t) (|A| + |B|) and |B| <= |A| / t.
    """
    p, q = threshold
    return (q - p) * a // p, (q - p) * 2 * a // (q + p)


def parts_of_band(band: int, threshold: tuple[int, int]) -> int:
    """Parts of a sketch in the band of pairs whose smaller set has 2**band to 2**(band + 1) - 1 members.

    A quarter more than pigeonhole needs, so that parts with few tokens need not be joined on.
    """
    most, _ = difference_bounds(2 ** (band + 1) - 1, threshold)
    return most + 1 + (most + 3) // 4


def band_keys(tokens: np.ndarray, band: int, differ: int, threshold: tuple[int, int]) -> np.ndarray:
    """Join keys of one set in one band.

    Each token flips one bit of one of the parts; a part's bits are kept as the XOR of the flipped bits' codes. A
    symmetric difference of d tokens changes at most d parts. Of m parts the differ + 1 with the most tokens (then the
    first) are keys: two sets that differ in at most `differ` tokens have a common part, their fullest common part has
    at most `differ` parts before it in either order, and so it is a key of both.
    """
    m = parts_of_band(band, threshold)
    where = (tokens % _U(m)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    counts = np.bincount(where, minlength=m)
    ends = np.cumsum(counts)
    running = np.zeros(len(tokens) + 1, dtype=np.uint64)
    np.bitwise_xor.accumulate(K.mix(tokens[order] ^ _U(0x5851F42D4C957F2D)), out=running[1:])
    values = running[ends] ^ running[ends - counts]
    kept = np.arange(m) if differ + 1 >= m else np.argsort(-counts, kind="stable")[: differ + 1]
    return K.mix(K.mix(values[kept]) + kept.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U((band + 1) * 0xC2B2AE3D27D4EB4F % 2**64))


def set_keys(tokens: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Keys of a set in the band of its own size, and in the one below for partners that are smaller."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    p, q = threshold
    band = n.bit_length() - 1
    any_partner, _ = difference_bounds(n, threshold)
    keys = [band_keys(tokens, band, any_partner, threshold)]
    largest_below = 2**band - 1
    if largest_below and q * largest_below >= p * n:
        keys.append(band_keys(tokens, band - 1, (q - p) * (largest_below + n) // (q + p), threshold))
    return np.concatenate(keys)


def compact_sketch(tokens: np.ndarray) -> np.ndarray:
    """Each token flips one of 64 * SKETCH_WORDS bits, so the Hamming distance is at most the symmetric difference."""
    spot = (K.mix(tokens) >> _U(7)) % _U(64 * SKETCH_WORDS)
    odd = np.bincount(spot.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _signatures(shingle: int, threshold: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(K.text_shingles(batch.column(1), shingle))
            content = [int(np.bitwise_xor.reduce(K.mix(x + _U(len(x))))) if len(x) else 0 for x in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(np.array(content, dtype=np.uint64).view(np.int64)), K.long_lists([compact_sketch(x) for x in sets]), K.long_lists([set_keys(x, threshold) for x in sets])],
                names=["doc_id", "n_shingles", "cid", "sketch", "keys"],
            )

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(K.text_shingles(batch.column(0), shingle))
            content = [int(np.bitwise_xor.reduce(K.mix(x + _U(len(x))))) if len(x) else 0 for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(content, dtype=np.uint64).view(np.int64)), K.long_lists(sets)], names=["cid", "members"])

    return run


def verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Of the pairs (u, v) of classes those at or above the threshold: by size, by Hamming distance, then by counting."""
    p, q = threshold
    c = classes.select("cid", "n_shingles", "sketch")
    # pairs is a written table; a class that very many pairs have is dealt by their number in it all along
    counts = {side: pairs.groupBy(side).agg(F.count("*").alias("_rows")) for side in ("u", "v")}
    for side in ("u", "v"):
        pairs = keyed(pairs, c.withColumnsRenamed({"cid": side, "n_shingles": f"n_{side}", "sketch": f"k_{side}"}), side, counts=counts[side])
    differ = sum((F.bit_count(F.col("k_u")[i].bitwiseXOR(F.col("k_v")[i])) for i in range(1, SKETCH_WORDS)), F.bit_count(F.col("k_u")[0].bitwiseXOR(F.col("k_v")[0])))
    near = pairs.where((q * F.least("n_u", "n_v") >= p * F.greatest("n_u", "n_v")) & (differ * (q + p) <= (q - p) * (F.col("n_u") + F.col("n_v")))).drop("k_u", "k_v")
    for side in ("u", "v"):
        near = keyed(near, sets.withColumnsRenamed({"cid": side, "members": f"m_{side}"}), side, counts=counts[side])
    common = F.size(F.array_intersect("m_u", "m_v"))
    return near.where(common * q >= (F.col("n_u") + F.col("n_v") - common) * p).select("u", "v")


def _with_hubs(buckets: DataFrame, ws: Workspace) -> DataFrame:
    """(key, cid) with each bucket's hub: the class that shares most buckets with most classes, then the smallest. That is a text which others were copied from rather than one of its copies. buckets: (key, cid, n), n the key's classes."""
    degrees = buckets.groupBy("cid").agg(F.sum("n").alias("degree"))
    hubs = buckets.join(degrees, "cid").groupBy("key").agg(F.min(F.struct(-F.col("degree"), F.col("cid").alias("cid")))["cid"].alias("hub"), F.first("n").alias("rows"))
    return keyed(buckets.drop("n"), ws.put(hubs, "hubs-of-keys"), "key", "rows")


def links_within(hub: int, cids: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], threshold: tuple[int, int]) -> list[tuple[int, int]]:
    """Of one hub's leaves, links that join all components that any link between two of them joins; those with the hub itself were looked for before. By size, by Hamming distance, then by counting."""
    p, q = threshold
    n = np.array([len(x) for x in sets], dtype=np.int64)
    sketches = np.stack([compact_sketch(x) for x in sets])
    group, found = np.unique(roots, return_inverse=True)[1], []
    for i in np.flatnonzero(cids != hub):
        j = i + 1 + np.flatnonzero((group[i + 1 :] != group[i]) & (cids[i + 1 :] != hub))
        j = j[q * np.minimum(n[j], n[i]) >= p * np.maximum(n[j], n[i])]
        differ = np.bitwise_count(sketches[j] ^ sketches[i]).sum(axis=1, dtype=np.int64)
        for k in j[differ * (q + p) <= (q - p) * (n[j] + n[i])]:
            if group[k] == group[i]:
                continue
            common = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
            if common * q >= (n[i] + n[k] - common) * p:
                found.append((int(cids[i]), int(cids[k])))
                group[group == group[k]] = group[i]
    return found


def _within(threshold: tuple[int, int]):
    """From (hub, cid, root, members), a hub's rows together: the links (u, v) of links_within."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last hub so far, which may go on

        def links() -> pa.RecordBatch:
            cids, roots = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (1, 2))
            sets = [x.values.to_numpy().view(np.uint64) for b in held for x in b.column(3)]
            found = links_within(held[0].column(0)[0].as_py(), cids, roots, sets, threshold)
            return pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], names=["u", "v"])

        for batch in batches:
            if not len(batch):
                continue
            hub = batch.column(0).to_numpy()
            starts = [0, *(np.flatnonzero(hub[1:] != hub[:-1]) + 1).tolist(), len(hub)]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if held and held[0].column(0)[0].as_py() != hub[a]:
                    yield links()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield links()

    return run


def across_components(leaves: DataFrame, classes: DataFrame, sets: DataFrame, threshold: tuple[int, int], ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """leaves: (hub, cid, root), the classes of buckets that lie in several components. Returns links, and candidate pairs, that together join all components that any link within a hub's leaves joins.

    The leaves of a hub that has few are compared in one task. For the other hubs, however large, there is another exact way:

    Let D be a leaf's symmetric difference with its hub and E = (q + p) |D| - (q - p) n, with n its size. Of two leaves,
    |x xor y| = |Dx| + |Dy| - 2 |Dx and Dy|, so they link just when Ex + Ey <= 2 (q + p) |Dx and Dy|.
    Where Ex + Ey <= 0 they link whatever D holds. All such leaves link with the leaf of the smallest E, so those links do.
    Else Dx and Dy have at least t = (Ex + Ey) / 2 (q + p) members in common, and so the |D| - t + 1 members of each that
    are rarest among the hub's leaves have one. Edits of a copy are rare members, so near copies of one text that aren't
    similar enough to each other hardly ever meet here, however many they are.
    Members are classed to know Ey better: the hub's component in four classes by E, all else in one. Pairs within the
    hub's component aren't looked for.
    """
    p, q = threshold
    # a hub was compared with each of its leaves; only hubs with two leaves or more have other pairs
    sized = keyed(leaves, classes.select("cid", F.col("n_shingles").alias("n")), "cid")
    several = ws.put(sized.groupBy("hub").agg(F.count("*").alias("leaves"), F.sum("n").alias("members")).where("leaves > 2"), "hubs")
    leaves = ws.put(keyed(leaves, several.withColumn("few", (F.col("leaves") <= GROUP_LEAVES) & (F.col("members") <= GROUP_MEMBERS)).drop("members"), "hub", "leaves"), "several")
    involved = leaves.select("cid").distinct()
    known = ws.put(classes.select("cid", F.col("n_shingles").alias("n")).join(involved, "cid", "left_semi").join(sets, "cid"), "known")
    few = leaves.where("few").select("hub", "cid", "root").join(known.drop("n"), "cid").select("hub", "cid", "root", "members")
    few = ws.put(few.repartition("hub").sortWithinPartitions("hub").mapInArrow(_within(threshold), "u long, v long"), "within")
    ws.release()
    leaves, several = leaves.where("NOT few").drop("few"), several.drop("members")
    if leaves.isEmpty():
        return few, few.limit(0)
    hubs = leaves.where("cid = hub").select("hub", F.col("root").alias("hub_root")).join(several, "hub")
    hubs = hubs.join(known.withColumnsRenamed({"cid": "hub", "n": "n_hub", "members": "center"}), "hub")
    # the leaves of a hub that has many meet it in parts, not in one task
    mine = keyed(leaves.join(known, "cid"), ws.put(hubs, "centers"), "hub", "leaves", hot_rows=LEAVES)
    mine = mine.withColumn("d", F.concat(F.array_except("members", "center"), F.array_except("center", "members"))).drop("members", "center")
    mine = mine.withColumn("e", ((q + p) * F.size("d") - (q - p) * F.col("n")).cast("long"))
    reach = (q - p) * F.col("n_hub")
    own_class = F.least(F.greatest(F.floor(F.col("e") * 2 / reach).cast("int") + 2, F.lit(0)), F.lit(3)) + 1
    mine = mine.withColumn("class", F.when(F.col("root") == F.col("hub_root"), own_class).otherwise(0))
    mine = ws.put(mine.select("hub", "cid", "root", "n", "e", "class", "d"), "differences")

    ws.release()
    least = mine.groupBy("hub").agg(F.min(F.struct("e", "cid")).alias("first"), *[F.min(F.when(F.col("class") == k, F.col("e"))).alias(f"e{k}") for k in range(5)])
    least = ws.put(least, "least")
    least = ws.put(least.join(several, "hub"), "least-leaves")
    joined = keyed(mine.drop("d"), least.select("hub", "first", "leaves"), "hub", "leaves", hot_rows=LEAVES)
    near = joined.where((F.col("e") + F.col("first.e") <= 0) & (F.col("cid") != F.col("first.cid"))).select(F.col("first.cid").alias("u"), F.col("cid").alias("v"))

    with_least = keyed(mine, least.drop("first"), "hub", "leaves", hot_rows=LEAVES)

    def prefix(k: int) -> Column:
        """How many of its rarest members a leaf must show to partners whose smallest e is that of class k; none if there are no partners."""
        t = F.greatest(F.ceil((F.col("e") + F.col(f"e{k}")) / (2 * (q + p))), F.lit(1))
        return F.coalesce(F.greatest(F.size("d") - t + 1, F.lit(0)), F.lit(0)).cast("int")

    shown = F.when(F.col("class") == 0, F.array(*[prefix(k) for k in range(5)])).otherwise(F.array(prefix(0)))
    mine = with_least.withColumn("shown", shown).where(F.array_max("shown") > 0)
    each = mine.select("hub", "cid", F.size("d").alias("size"), F.array_max("shown").alias("most"), F.explode("d").alias("member"))
    # a member's number is that of its hash with the hub: where two members collide both seem more frequent to all leaves
    each = ws.put(each.withColumn("place_of", F.xxhash64("hub", "member")), "each")
    counts = each.groupBy("place_of").agg(F.count("*").alias("often")).where("often > 1")
    each = keyed(each, ws.put(counts.withColumn("rows", F.col("often")), "often"), "place_of", "rows", hot_rows=LEAVES).drop("place_of")
    # members that one leaf alone has come first in that leaf's order, and meet nothing
    own = Window.partitionBy("hub", "cid")
    spread = each.withColumn("place", F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("often", "member")))
    spread = spread.where("place <= most").select("hub", "cid", "member", "place")
    about = mine.select("hub", "cid", "root", "n", "e", "class", F.size("d").alias("d"), "shown")
    spread = ws.put(spread.join(about, ["hub", "cid"]), "spread")
    near = ws.put(near, "near")
    for name in ("each", "often", "centers", "known", "differences"):
        ws.drop(name)
    ws.release()
    columns = ("cid", "root", "n", "e", "class", "d", "shown", "place")
    x, y = (spread.where(c).select("hub", "member", *[F.col(k).alias(f"{k}_{side}") for k in columns]) for side, c in (("x", "class = 0"), ("y", "true")))
    possible = (F.col("root_x") != F.col("root_y")) & (F.col("e_x") + F.col("e_y") <= 2 * (q + p) * F.least("d_x", "d_y")) & (q * F.least("n_x", "n_y") >= p * F.greatest("n_x", "n_y"))
    # class 0 shows as much to each class as that class's smallest e asks for, the others show what class 0 asks for
    shows = (F.col("place_x") <= F.get("shown_x", F.col("class_y"))) & (F.col("place_y") <= F.col("shown_y")[0]) & ((F.col("class_y") > 0) | (F.col("cid_x") < F.col("cid_y")))
    pairs = x.join(y, ["hub", "member"]).where(possible & shows)
    return near.unionByName(few), pairs.select(F.least("cid_x", "cid_y").alias("u"), F.greatest("cid_x", "cid_y").alias("v")).distinct()


def jaccard_components(docs: DataFrame, shingle: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included), class_size (documents of the same shingle set).

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, a set is a text's distinct shingles of `shingle` words (fewer
    words are one shingle). Two documents link when their sets' Jaccard similarity is at least threshold[0] /
    threshold[1]. A null text, an empty one and one without words has an empty set, links with nothing and is its own
    component. Rows that repeat a doc_id are nodes by their own text. A null doc_id is never the smallest of a component
    unless all are null. An empty table gives an empty result; other columns are ignored. Members of sets are 64-bit
    hashes of shingles.

    Documents of one set are one class. Classes that share a key are candidates. In each key's bucket every class is
    first compared with the bucket's hub only. Pairs matter only where that leaves a bucket in two components
    or more, and only across components; see across_components, so that a large group of near copies makes few pairs.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "parity")
    schema = "doc_id {}, n_shingles long, cid long, sketch array<long>, keys array<long>".format(docs.schema["doc_id"].dataType.simpleString())
    signed = ws.put(docs.select("doc_id", "text").mapInArrow(_signatures(shingle, threshold), schema), "signed")
    some = signed.where("n_shingles > 0")
    classes = ws.put(some.groupBy("cid").agg(F.min("doc_id").alias("least"), F.count("*").alias("class_size"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "classes")
    ids = ws.put(signed.select("doc_id", "n_shingles", "cid"), "ids")
    # of each class one array of keys at the map side, so a text's copies don't repeat its keys
    keys = ws.put(some.groupBy("cid").agg(F.first("keys").alias("keys")), "keys")
    ws.drop("signed")
    ws.release()

    # one shuffle of the keys; a key's rows are the classes that have it, whatever their number of copies
    of_key = Window.partitionBy("key")
    each_key = keys.select("cid", F.explode("keys").alias("key")).withColumns({"n": F.count("*").over(of_key), "low": F.min("cid").over(of_key), "high": F.max("cid").over(of_key)})
    buckets = ws.put(each_key.where("low != high").select("key", "cid", "n"), "buckets")
    ws.drop("keys")
    ws.release()
    shared = ws.put(_with_hubs(buckets, ws), "shared")
    ws.drop("buckets")
    involved = ws.put(shared.select("cid").distinct(), "involved")
    # the sets of classes that are in any bucket, from one document of each class
    readers = ws.put(classes.join(involved, "cid", "left_semi").select("least").distinct().withColumnRenamed("least", "doc_id"), "readers")
    texts = semi(docs.select("doc_id", "text"), readers, "doc_id", null_safe=True)
    sets = texts.select("text").mapInArrow(_sets(shingle), "cid long, members array<long>").where(F.size("members") > 0)
    sets = ws.put(sets.groupBy("cid").agg(F.first("members").alias("members")), "sets")

    ws.release()
    stars = ws.put(shared.where("cid != hub").select(F.least("hub", "cid").alias("u"), F.greatest("hub", "cid").alias("v")).distinct(), "stars")
    links = ws.put(verified(stars, classes, sets, threshold), "links")
    ws.release()
    roots = components(links, ws, "near")
    placed = ws.put(shared.join(roots, shared["cid"] == roots["id"], "left").select("key", "hub", "cid", F.coalesce("root", "cid").alias("root")), "placed")
    split = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n")).where("a != b").select("key", "n")
    leaves = ws.put(keyed(placed, ws.put(split, "split"), "key", "n").select("hub", "cid", "root").distinct(), "leaves")
    ws.drop("placed")
    near, across = across_components(leaves, classes, sets, threshold, ws)
    across = ws.put(across, "across")
    ws.release()
    fresh = ws.put(across.join(stars, ["u", "v"], "left_anti"), "fresh")
    more = fresh.select("u", "v") if fresh.isEmpty() else ws.put(verified(fresh, classes, sets, threshold), "more")
    # every pair across components that could be a link has now been compared, so these links complete the graph
    roots = components(links.unionByName(more).unionByName(near), ws, "all")
    members = classes.join(roots, classes["cid"] == roots["id"], "left").select("cid", "least", "class_size", F.coalesce("root", "cid").alias("root"))
    smallest = members.groupBy("root").agg(F.min("least").alias("component_id"))
    members = members.join(smallest, "root").select("cid", "class_size", "component_id")
    out = keyed(ids, ws.put(members, "members"), "cid", how="left")
    empty = F.col("n_shingles") == 0
    return out.select("doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(empty, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"))


#: DuckDB twin of the query: all pairs that share a shingle, by counting, and all that a document reaches.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS members FROM w
), e AS (SELECT doc_id, unnest(members) AS m, len(members) AS n FROM s),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.m = b.m AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.v FROM reach r JOIN links l ON l.u = r.b),
roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, len(members)::BIGINT AS n_shingles, component_id, CASE WHEN len(members) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY members) END AS class_size FROM s JOIN roots USING (doc_id)
"""
