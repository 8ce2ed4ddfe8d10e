"""N-gram Jaccard join: universe partitioning and the pigeonhole principle, verified exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.llm.shared import among, discard, frequent, stage
from quern.llm.shingles import mix, shingle_sets

#: Words of a shingle, and the least similarity in hundredths.
K, PERCENT = 4, 85
#: Bytes of the sets, or of the sketches, of a block, if a single one doesn't have more.
BLOCK = 1 << 18
#: Each band's sizes reach about so many hundredths of its smallest one, if not those of similar sets reach further. A set
#: signs twice if sets of the band below may be similar: with wide bands fewer do, with narrow ones segments are fewer.
WIDTH = 160
#: Bits of a set's sketch per element, at least; a power of two in all.
BITS = 4
#: One document in so many is looked at to find signatures that many sets share; one that LOUD or more of them share is dealt
#: to SPREAD parts of tasks. At most LISTED such signatures are broadcast. None of these numbers changes a result.
ONE_IN, LOUD, SPREAD, LISTED = 64, 64, 1024, 1 << 16
#: Largest set whose size band is tabulated.
LARGEST = 1 << 40


def bands(percent: int) -> list[int]:
    """Smallest size of each band. Sets that are similar enough are in one band or in neighbouring ones."""
    bounds = [1]
    while bounds[-1] < LARGEST:
        bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * 100 // percent), bounds[-1] * WIDTH // 100))
    return bounds


def segments(bounds: list[int], percent: int) -> list[int]:
    """Segments of each band: one more than two similar sets, the smaller one of the band, can differ in."""
    out = []
    for k in range(len(bounds) - 1):
        smaller = bounds[k + 1] - 1
        larger = smaller * 100 // percent
        out.append((100 - percent) * (smaller + larger) // (100 + percent) + 1)
    return out


def signatures(x: np.ndarray, at: np.ndarray, band: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets in a band, and the set of each.

    The universe is hashed into parts[k] segments for set k, one more than two
    similar sets can differ in, so some segment agrees. A segment costs as
    many candidates as sets share it. An empty one is the dearest and buys
    nothing: it is given up. The budget it leaves is made up where it is
    cheapest, with segments of two elements or more, the first ones in order:
    they also give their subsets that lack one element, so that a difference
    of one is found there. Of two sets, the one that gives up less is served
    by the other's signatures, which go at least as far. A set without enough
    such segments gives up none.
    """
    sizes = np.diff(at)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = np.concatenate(([0], np.cumsum(parts)))
    slot = first[owner] + ((mix(x, 3) >> np.uint64(32)) * parts[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    value = mix(x, 4)
    count = np.bincount(slot, minlength=first[-1])
    total = np.zeros(first[-1], np.uint64)
    np.add.at(total, slot, value)
    of = np.repeat(np.arange(len(sizes)), parts)
    salt = mix((band[of].astype(np.uint64) << np.uint64(40)) + (np.arange(first[-1]) - first[of]).astype(np.uint64), 5)
    strong = np.concatenate(([0], np.cumsum(count >= 2)))
    empty = np.concatenate(([0], np.cumsum(count == 0)))
    given_up = (empty[first[1:]] - empty[first[:-1]])[of]
    gained = strong[:-1] - strong[first[:-1]][of]  # strong segments before this one
    short = (strong[first[1:]] - strong[first[:-1]])[of] < given_up
    exact = (count > 0) | short
    with np.errstate(over="ignore"):
        less = ((gained < given_up)[slot]) & (count[slot] >= 2)
        sigs = np.concatenate((mix(total[exact] ^ salt[exact], 6), mix((total[slot[less]] - value[less]) ^ salt[slot[less]], 6)))
    return sigs, np.concatenate((of[exact], owner[less]))


def _nodes(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(x, 8), dtype=np.uint64)))
    with np.errstate(over="ignore"):
        return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64), 9)


def sketches(x: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Of each set, for each hash value of its elements whether their number is odd, in bits.

    Two sets whose sketches differ in so many bits differ in as many elements
    at least. A sketch of twice the size folds to one of the size.
    """
    n = np.diff(at)
    size = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n * BITS, 1))).astype(np.int64))
    first = np.concatenate(([0], np.cumsum(size)))
    of = np.repeat(np.arange(len(n)), n)
    bit = first[of] + (mix(x, 10) & (size[of] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(bit, minlength=first[-1]) & 1).astype(np.uint8)
    raw = np.packbits(odd).tobytes()
    return [raw[a // 8 : b // 8] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _fold(rows: np.ndarray, size: int) -> np.ndarray:
    while rows.shape[-1] > size:
        half = rows.shape[-1] // 2
        rows = rows[..., :half] ^ rows[..., half:]
    return rows


def _may_link(p: np.ndarray, n: np.ndarray, q: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m elements with the sketches p and q can be similar."""
    size = min(p.shape[-1], q.shape[-1])
    apart = np.bitwise_count(_fold(p, size) ^ _fold(q, size)).sum(-1, dtype=np.int64)
    return (100 + percent) * apart <= (100 - percent) * (n + m)


def _digests(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for first, rows, x, at in shingle_sets(b, 1, k):
                n = np.diff(at)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, rows), pa.array(n), pa.array(_nodes(x, at).view(np.int64), mask=n == 0), pa.array(sketches(x, at), pa.binary())],
                    ["doc_id", "n", "node", "bits"],
                )

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, node long, bits binary")


def _signed(docs: DataFrame, k: int, percent: int, settled: dict[int, int]) -> DataFrame:
    """sig, node: the signatures of every set in its own band and as a larger partner in the band below.

    settled: of a frequent set, the doc_id of the one row that is to sign for it.
    """
    starts = np.array(bands(percent), np.int64)
    number = np.array([*segments(bands(percent), percent), 1], np.int64)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for first, rows, x, at in shingle_sets(b, 1, k):
                n, node = np.diff(at), _nodes(x, at).view(np.int64)
                signs = n > 0
                if settled:
                    ids = b.column(0).slice(first, rows).to_pylist()
                    signs &= np.array([settled.get(v, d) == d for v, d in zip(node.tolist(), ids, strict=True)])
                own = np.searchsorted(starts, n, "right") - 1
                for below in (0, 1):
                    band = own - below
                    use = signs & (band >= 0) & (100 * (starts[np.maximum(own, 0)] - 1) >= percent * n if below else True)
                    use &= number[np.maximum(band, 0)] > 1  # else only equal sets are similar
                    pick = np.flatnonzero(use)
                    if not len(pick):
                        continue
                    keep = np.repeat(use, n)
                    sigs, of = signatures(x[keep], np.concatenate(([0], np.cumsum(n[pick]))), band[pick], number[band[pick]])
                    of = pick[of]
                    yield pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), pa.array(node[of])], ["sig", "node"])

    return docs.mapInArrow(run, "sig long, node long")


def _loud(texts: DataFrame, k: int, percent: int, settled: dict[int, int]) -> DataFrame:
    """sig, loud (true): signatures that very many sets share, LISTED rows at most.

    Found on a fixed share of the documents. Their sets need not meet to learn
    that the signature is shared, so they are dealt to many tasks; sets of all
    others meet by signature. A signature taken for loud that only one set has
    pairs that set with itself, which gives no link.
    """
    some = texts.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(ONE_IN)) == 0))
    counted = _signed(some, k, percent, settled).groupBy("sig").count().where(F.col("count") >= LOUD)
    return stage(counted.orderBy(F.desc("count"), "sig").limit(LISTED).select("sig", F.lit(True).alias("loud")), "loud")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for first, rows, x, at in shingle_sets(b, 1, k):
                raw = x.tobytes()
                data = [raw[8 * s : 8 * e] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                node = pa.array(_nodes(x, at).view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, rows), node, pa.array(data, pa.binary())], ["again", "node", "x"])

    return docs.mapInArrow(run, "again boolean, node long, x binary")


def _linked(pairs: DataFrame, sets_: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those similar enough, by their whole sets."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            last, held = None, None
            for i, (p, q) in enumerate(zip(b.column("xa"), b.column("xb"), strict=True)):
                p, q = p.as_buffer(), q.as_buffer()
                if last is None or not last.equals(p):
                    last, held = p, np.frombuffer(p, np.uint64)
                y = np.frombuffer(q, np.uint64)
                where = np.searchsorted(held, y)
                both = int(np.count_nonzero(held[np.minimum(where, len(held) - 1)] == y))
                ok[i] = 100 * both >= percent * (len(held) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok))], ["u", "v"])

    left = sets_.select(F.col("node").alias("a"), F.col("x").alias("xa"))
    right = sets_.select(F.col("node").alias("b"), F.col("x").alias("xb"))
    return pairs.join(right, "b").join(left, "a").mapInArrow(run, "u long, v long")


def _possible(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those that can be similar by their sizes and sketches. No similar pair is lost."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            n, m = b.column("n").to_numpy(), b.column("m").to_numpy()
            for i, (p, q) in enumerate(zip(b.column("p"), b.column("q"), strict=True)):
                ok[i] = _may_link(np.frombuffer(p.as_buffer(), np.uint8), n[i], np.frombuffer(q.as_buffer(), np.uint8), m[i], percent)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok))], ["a", "b"])

    left = known.select(F.col("node").alias("a"), "n", F.col("bits").alias("p"))
    right = known.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("bits").alias("q"))
    sized = pairs.join(right, "b").join(left, "a").where(_near(percent, "n", "m"))
    return sized.select("a", "b", "n", "m", "p", "q").mapInArrow(run, "a long, b long")


def _paired_blocks(nodes: DataFrame, data: DataFrame, size: Column, percent: int) -> DataFrame:
    """home, s, t: for each home the pairs of its blocks that have more than one root and sizes that can be similar.

    nodes: home, node, root, n; data: node, x; size: the bytes of x, from n. A
    home's sets are dealt by hash to as many blocks as their bytes ask for, a
    large home's by classes of size first. So a home of any size is spread
    without being sorted or numbered in one task, no pairs of sets are rows,
    and no task holds more than two blocks at a time.
    """
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)) if percent < 100 else F.col("n")
    sized = nodes.withColumn("class", step.cast("long"))
    classes = sized.groupBy("home", "class").agg(F.sum(size).alias("bytes"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    of = Window.partitionBy("home")  # a row for each class of size, of which there are few
    several = classes.select("home", "class", "bytes", F.sum("bytes").over(of).alias("all"), F.min("lo").over(of).alias("lo"), F.max("hi").over(of).alias("hi")).where("lo <> hi")
    large = F.col("all") > BLOCK
    parts = several.select("home", "class", F.when(large, F.col("class")).otherwise(F.lit(0)).alias("as"), F.when(large, F.ceil(F.col("bytes") / BLOCK)).otherwise(F.lit(1)).alias("parts"))
    block = F.struct(F.col("as").alias("class"), F.pmod(F.xxhash64("node"), F.greatest("parts", F.lit(1))).alias("part"))
    placed = sized.join(parts, ["home", "class"]).select("home", "node", "root", "n", block.alias("block"))
    blocks = stage(
        placed.join(data, "node")
        .groupBy("home", "block")
        .agg(F.collect_list(F.struct("node", "root", "n", "x")).alias("s"), *(f(c).alias(f"{w}{c}") for c in ("root", "n") for w, f in (("lo", F.min), ("hi", F.max)))),
        "blocks",
    )
    ends = blocks.drop("s")
    # Both sides carry numbers only here. Of two blocks, in any order, sets can be similar only if the largest of one
    # reaches the smallest of the other.
    others = ends.select("home", F.col("block").alias("with"), F.col("loroot").alias("lo2"), F.col("hiroot").alias("hi2"), F.col("lon").alias("n2"), F.col("hin").alias("hi2n"))
    numbers = ends.join(others, "home").where("block <= with and not (loroot = hiroot and lo2 = hi2 and loroot = lo2)")
    numbers = numbers.where(F.col("hin") * 100 >= F.col("n2") * percent).where(F.col("hi2n") * 100 >= F.col("lon") * percent).select("home", "block", "with")
    second = blocks.select("home", F.col("block").alias("with"), F.col("s").alias("t"))
    return numbers.join(blocks.select("home", "block", "s"), ["home", "block"]).join(second, ["home", "with"]).select("home", "s", "t")


def _sides(row_s, row_t, kind) -> list[tuple]:
    out = []
    for v in (row_s.values, row_t.values):
        out.append((v.field("node").to_numpy(), v.field("root").to_numpy(), v.field("n").to_numpy(), [np.frombuffer(x.as_buffer(), kind) for x in v.field("x")]))
    return out


def _suspects(nodes: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """home, node of the nodes that can link, by their sketches, with one of another root in their home."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                (u, r, n, ps), (v, q, m, qs) = _sides(b.column(1)[i], b.column(2)[i], np.uint8)
                found = set()
                stacked = {}
                for size in {len(y) for y in qs}:
                    at = np.array([k for k, y in enumerate(qs) if len(y) == size])
                    stacked[size] = at, np.stack([qs[k] for k in at])
                for k, p in enumerate(ps):
                    for at, rows in stacked.values():
                        for a in range(0, len(at), 256):
                            some = at[a : a + 256]
                            ok = _may_link(rows[a : a + 256], m[some], p, n[k], percent) & (q[some] != r[k])
                            if ok.any():
                                found.update(v[some[ok]].tolist(), (int(u[k]),))
                homes = pa.array([b.column(0)[i].as_py()] * len(found), pa.int64())
                yield pa.RecordBatch.from_arrays([homes, pa.array(sorted(found), pa.int64())], ["home", "node"])

    bits = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("n") * BITS, F.lit(64)))))
    both = _paired_blocks(nodes, known.select("node", F.col("bits").alias("x")), bits / 8, percent)
    return both.mapInArrow(run, "home long, node long").distinct()


def _within(nodes: DataFrame, sets_: DataFrame, percent: int) -> DataFrame:
    """Links between different roots among the sets of each home, at most one for each two roots of a pair of blocks."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                (nodes_, roots, _, xs), (others, other_roots, _, ys) = _sides(b.column(1)[i], b.column(2)[i], np.uint64)
                u, v = _compared(nodes_, roots, xs, others, other_roots, ys, percent)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return _paired_blocks(nodes, sets_, 8 * F.col("n"), percent).mapInArrow(run, "u long, v long")


def _compared(nodes, roots, xs, others, other_roots, ys, percent: int) -> tuple[list[int], list[int]]:
    """One link, if there is any, for each two different roots of two blocks."""
    sizes = np.array([len(y) for y in ys])
    values, owner = np.concatenate(ys), np.repeat(np.arange(len(ys)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    u, v, seen = [], [], set()
    for node, root, x in zip(nodes.tolist(), roots.tolist(), xs, strict=True):
        lo, hi = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
        n = hi - lo
        where = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        both = np.bincount(owner[where], minlength=len(ys))
        near = (100 * both >= percent * (len(x) + sizes - both)) & (other_roots != root)
        for k in np.flatnonzero(near).tolist():
            if (key := (root, int(other_roots[k]))) not in seen:
                seen.add(key)
                u.append(node)
                v.append(int(others[k]))
    return u, v


def _near(percent: int, n: str, m: str):
    return (100 * F.least(n, m).cast("long")) >= (percent * F.greatest(n, m).cast("long"))


def join(docs: DataFrame, k: int = K, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Two documents link when 100 * |intersection| >= percent * |union| of their
    sets of k-word shingles; component_id is the smallest doc_id that links
    reach. Null text counts as empty; a document without words links with
    nothing and is its own component, as is a row with a null id (component
    null). Repeated rows and rows that share an id count as one document that
    has the links of each. Other columns are ignored; an empty table gives no
    rows. Sets are compared by 64-bit hashes of their shingles and of
    themselves.

    Equal sets become one node first. Sets that agree on a signature are
    candidates: within a signature each set is paired with a central one only.
    Pairs whose sketches, some bits per element, differ too much to be similar
    are dropped; the others are verified on whole sets. Where a signature then
    still spans several components, its sets are compared across components
    too, in blocks of bounded size, by sketches and then by whole sets, so no
    link between components is missed.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t"))
    rows = stage(_digests(texts, k), "digests")
    hot = frequent(rows.where("node is not null and doc_id is not null"), "node")
    hot = among(rows.where("doc_id is not null"), "node", hot).groupBy("node").agg(F.min("doc_id").alias("d"), F.count("*").alias("c"))
    settled = {r["node"]: r["d"] for r in hot.where("c > 1").collect()}  # at most shared.WINNERS rows

    signed = _signed(texts.where("doc_id is not null"), k, percent, settled)
    loud = _loud(texts, k, percent, settled)
    dealt = signed.join(F.broadcast(loud), "sig", "left").select("sig", "node", F.when(F.col("loud"), F.pmod(F.xxhash64("node"), F.lit(SPREAD))).alias("part"))
    by = Window.partitionBy("sig", "part")
    met = dealt.withColumn("lo", F.min("node").over(by)).withColumn("hi", F.max("node").over(by)).where("lo <> hi or part is not null")
    members = stage(met.select("sig", "node").distinct(), "members")
    # Frequent sets are one row each, settled before; of other sets the rows are few.
    some = rows.where("node is not null and doc_id is not null").select("node", "n", "bits").join(members.select("node").distinct(), "node", "left_semi")
    known = stage(some.dropDuplicates(["node"]), "sketches")

    # The member that shares most stands in the middle of its group, and mostly of its neighbours' groups too.
    sized = members.join(members.groupBy("sig").agg(F.count("*").alias("c")), "sig")
    weighed = sized.join(sized.groupBy("node").agg(F.sum("c").alias("w")), "node")
    pivots = stage(weighed.groupBy("sig").agg(F.max(F.struct("w", "node")).alias("f")).select("sig", F.col("f.node").alias("home")), "pivots")
    around = stage(members.join(pivots, "sig"), "around")
    discard(loud, members, pivots)
    star = around.where("node <> home").select(F.col("home").alias("a"), F.col("node").alias("b")).distinct()
    pairs = stage(_possible(star, known, percent), "pairs")
    same = rows.where("node is not null and doc_id is not null").select("doc_id", "node")
    shared = stage(same.groupBy("doc_id").count().where("count > 1").select("doc_id"), "shared")
    repeated = None if shared.isEmpty() else shared
    links = stage(_linked(pairs, _whole(texts, same, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), repeated, k), percent), "links")
    discard(pairs)
    if repeated is not None:  # rows that share an id tie their sets together
        several = same.join(repeated, "doc_id", "left_semi")
        tied = several.join(several.groupBy("doc_id").agg(F.min("node").alias("u")), "doc_id").where("node <> u")
        links = links.unionByName(stage(tied.select("u", F.col("node").alias("v")).distinct(), "ties"))
    roots = components(links)

    rooted = stage(around.join(roots, "node", "left").select("sig", "node", "home", F.coalesce("root", "node").alias("root")), "rooted")
    discard(around)
    spans = rooted.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("sig")
    # All sets of a signature have its pivot as a home in common; a set may have several homes.
    left = rooted.join(spans, "sig", "left_semi").select("home", "node", "root").distinct().join(known.select("node", "n"), "node")
    left = stage(left, "open")
    discard(rooted)
    suspects = stage(left.join(_suspects(left, known, percent), ["home", "node"], "left_semi"), "suspects")
    if not suspects.isEmpty():
        found = stage(_within(suspects, _whole(texts, same, suspects.select("node").distinct(), repeated, k), percent), "links")
        if not found.isEmpty():
            roots = components(links.unionByName(found))
    discard(known, left, suspects)

    # Smallest doc_id of each set, then of each component.
    least = same.groupBy("node").agg(F.min("doc_id").alias("d"))
    linked = roots.join(least, "node")
    low = linked.groupBy("root").agg(F.min("d").alias("component"))
    named = stage(linked.join(low, "root").select("node", "component"), "named")
    return _named(rows, same, named, settled)


def _whole(texts: DataFrame, same: DataFrame, wanted: DataFrame, repeated: DataFrame | None, k: int) -> DataFrame:
    """node, x: the whole set of each wanted node, from one document each. repeated: the ids that rows share, if any."""
    stands = same.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    if repeated is None:
        chosen = stands.select("doc_id", F.lit(False).alias("again"))
    else:
        chosen = stands.select("doc_id").distinct().join(repeated.withColumn("again", F.lit(True)), "doc_id", "left").fillna(False, ["again"])
    found = stage(_sets(texts.join(chosen, "doc_id").select("again", "_t"), k), "sets")
    if repeated is None:
        return found.select("node", "x")
    # Only rows that share an id can give a set twice.
    return found.where("not again").select("node", "x").unionByName(found.where("again").select("node", "x").dropDuplicates(["node"]))


def _named(rows: DataFrame, same: DataFrame, named: DataFrame, settled: dict[int, int]) -> DataFrame:
    spark = rows.sparkSession
    usual = F.coalesce(F.col("component"), F.when(F.col("doc_id").isNotNull(), F.col("doc_id")))
    out = ("doc_id", F.col("n").alias("n_shingles"), usual.alias("component_id"))
    known = rows.where("node is not null and doc_id is not null")
    alone = rows.where("node is null or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    if settled:
        # Rows of frequent sets, at most shared.WINNERS ones, are named from a broadcast; the others meet by set.
        frequent_ = F.broadcast(spark.createDataFrame([(v,) for v in settled], "node long"))
        least = settled | {r["node"]: r["component"] for r in named.join(frequent_, "node").collect()}
        hot = F.broadcast(spark.createDataFrame(list(least.items()), f"node long, component {rows.schema['doc_id'].dataType.simpleString()}"))
        alone = alone.unionByName(known.join(hot, "node").select(*out))
        known, same = known.join(frequent_, "node", "left_anti"), same.join(frequent_, "node", "left_anti")
    every = same.groupBy("node").agg(F.min("doc_id").alias("d")).join(named, "node", "left").select("node", F.coalesce("component", "d").alias("component"))
    return known.join(every, "node", "left").select(*out).unionByName(alone)


def representatives(docs: DataFrame, k: int = K, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component of join(), that with the smallest id; all columns stay.

    Documents without words or without an id stay. Of rows that share the id
    that stays one does; which one, the hash of the text decides.
    """
    groups = join(docs, k, percent, doc_id, text)
    gone = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, F.col(doc_id) == F.col("_gone"), "left_anti")
    twice = groups.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_twice"))
    twice = stage(twice, "twice")
    once = left.join(twice, F.col(doc_id) == F.col("_twice"), "left_anti")
    again = left.join(twice, F.col(doc_id) == F.col("_twice"), "left_semi")
    again = again.select(F.struct(*docs.columns).alias("_r"), F.col(doc_id).alias("_d"), F.col(text).alias("_t"))
    first = again.withColumn("_n", F.row_number().over(Window.partitionBy("_d").orderBy(F.xxhash64("_t"), "_t"))).where("_n = 1").select("_r.*")
    return once.unionByName(first)
