"""Near-duplicate documents by a chosen-path set similarity join.

1. Every text becomes its set of distinct five-word shingles (64-bit hashes), one byte of each of its TOKENS
   minwise tokens (the least value under each of as many hash functions), the TREES root nodes that its tokens
   choose, and a 128-bit digest of the set. Texts with equal sets are one class, so exact copies never meet again.
2. Each of TREES independent trees has roots chosen by three minwise tokens. A node of at most NODE classes is
   compared exhaustively on minwise tokens. A larger one is branched by two further tokens, chosen by a hash of
   the node, up to DEPTH times; at each level it is also compared in blocks of about NODE classes, every block
   together with the members that resemble the node most, so a centre meets all that gather round it. Members
   of a root that these blocks have not joined are then compared in pairs of parts, so a root of any size is
   compared wholly, and only the pairs already joined are spared.
   Two sets of similarity 0.85 meet in a tree with probability 0.61, and miss all 16 trees in 2 of 10 million.
3. From a block come the edges of its greatest spanning forest on estimated similarity, not all its pairs; what
   these edges join is a family, and no link leaves a family.
4. A family's full sets are compared exactly, in parts of about NODE sets, each pair of parts in one block. A
   family of more than PARTS parts is first compared in the blocks of its trees, and then in all pairs of parts
   that these links have not joined, so its result is as exact; its work grows with the square of the texts that
   remain unjoined. From each block come the edges of a spanning forest of its confirmed links.

Links, families, components and signatures stay in Spark tables throughout; the driver sees counts only.

A null, empty or wordless text has an empty set and is linked with nothing. A text of one to four words is one
shingle. Repeated rows fall in one class. Of rows that share a doc_id but
not a text, each links by its own text, and their links join one component, as components are of ids.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.llm.common import BROADCAST_IDS, Words, chunks, discard, few_parts, free_name, in_doc, materialise, mix, read_table, row_key, semi_by_id, session_defaults, small_side, stored, tidy, utf8_parts, windows

SHINGLE = 5
#: Links need 100 * intersection >= LINK_PERCENT * union.
LINK_PERCENT = 85
TOKENS, TREES, DEPTH, NODE = 128, 16, 3, 256
#: A family of more parts than this, of about NODE texts and PART_SHINGLES shingles, is joined by its trees' blocks first.
PARTS, PART_SHINGLES = 48, 1_000_000
#: Pairs of fewer equal tokens than this are no candidates: five standard deviations below 0.85 * TOKENS.
LEAST_EQUAL = 88

_rng = np.random.Generator(np.random.PCG64(7))
_MULTIPLY = _rng.integers(1, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, TOKENS, dtype=np.uint64)
FEATURES = "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, sig binary, roots array<bigint>"


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, text of each) for texts i..j, ordered by text."""
    key, doc, _ = windows(Words(raw, offsets, i, j, lower=True), SHINGLE, whole_if_short=True)
    once = ~pd.Series(in_doc(key, doc)).duplicated().to_numpy() if len(key) else np.zeros(0, bool)
    return key[once], doc[once]


def _signatures(key: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    size = np.bincount(doc, minlength=n)
    h1, h2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    sig, roots = np.zeros((n, TOKENS), np.uint8), np.zeros((n, TREES), np.uint64)
    if len(key):
        full = np.flatnonzero(size)
        first = (np.cumsum(size) - size)[full]
        h1[full], h2[full] = np.add.reduceat(key, first), np.add.reduceat(mix(key ^ np.uint64(0x5DEECE66D)), first)
        for k in range(TOKENS):
            least = np.minimum.reduceat(key * _MULTIPLY[k] + _ADD[k], first) >> np.uint64(24)
            sig[full, k] = mix(least) & np.uint64(255)
            if k < 3 * TREES:
                roots[full, k // 3] = mix(roots[full, k // 3] + least + np.uint64(k))
    return size, h1.view(np.int64), h2.view(np.int64), sig, roots.view(np.int64)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    session_defaults(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8_parts(batch.column(1))
            for i, j in chunks(offsets):
                size, h1, h2, sig, roots = _signatures(*shingle_sets(raw, offsets, i, j), j - i)
                rows = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(np.arange(j - i + 1, dtype=np.int32) * TOKENS), pa.py_buffer(sig)])
                starts = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * TREES), pa.array(roots.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(size.astype(np.int64)), pa.array(h1), pa.array(h2), rows, starts], names=["doc_id", "n_shingles", "h1", "h2", "sig", "roots"])

    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(tidy(run), FEATURES)


def blocks(classes: DataFrame) -> DataFrame:
    """(block, rep): who is compared with whom, over all trees and levels; blocks of one are left out."""
    nodes = classes.select("rep", F.explode("roots").alias("node"))
    found, rows = None, None
    for level in range(DEPTH + 1):
        sized = nodes.join(nodes.groupBy("node").agg(F.count("*").alias("members")), "node", "left")  # a row for each row
        sized = materialise(sized if rows is None else few_parts(sized, rows))
        small = sized.filter(F.col("members").between(2, NODE)).select(F.col("node").alias("block"), "rep")
        large = sized.filter(F.col("members") > NODE)
        found = small if found is None else found.unionByName(small)
        rows = large.count()
        if not rows:
            break
        parts = F.ceil(F.col("members") / NODE)
        cut = few_parts(large, rows).withColumn("part", F.pmod(F.xxhash64("rep", "node"), parts))
        cut = materialise(few_parts(classes.select("rep", "sig").join(small_side(cut, rows), "rep"), rows))
        # how well a member matches the commonest token of its node, over sixteen of the tokens
        token = cut.select("node", F.posexplode(F.array(*[F.substring("sig", 8 * k + 1, 1) for k in range(16)])).alias("place", "token"))
        usual = token.groupBy("node", "place", "token").agg(F.count("*").alias("n")).groupBy("node", "place").agg(F.max_by("token", "n").alias("token"))
        usual = few_parts(usual.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("place", "token"))).alias("usual")), rows)
        score = sum(F.when(F.col("usual")[k] == F.substring("sig", 8 * k + 1, 1), 1).otherwise(0) for k in range(16))
        scored = cut.join(small_side(usual, rows // 16), "node").select("node", "part", "members", F.struct(score.alias("score"), F.col("rep")).alias("best"))
        winners = scored.groupBy("node", "part", "members").agg(F.max("best").alias("best"))
        centres = winners.groupBy("node", F.pmod("part", F.lit(4)).alias("quarter"), "members").agg(F.max("best").alias("best"))
        shared = few_parts(centres, rows).select("node", F.col("best.rep").alias("rep"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("members") / NODE) - 1)).alias("part"))
        block = F.xxhash64("node", F.lit("part"), "part").alias("block")
        found = found.unionByName(cut.select(block, "rep")).unionByName(shared.select(block, "rep"))  # a centre may come twice: pairs of one rep are skipped
        if level < DEPTH:
            token = [F.expr(f"substring(sig, cast(pmod(xxhash64(node, {level}, {k}), {TOKENS}) as int) + 1, 1)") for k in range(2)]
            nodes = cut.select("rep", F.xxhash64("node", *token).alias("node"))
    return found


def _forest(equal: np.ndarray) -> list[tuple[int, int]]:
    """Edges of the greatest spanning forest of a symmetric matrix of equal-token counts (0: no edge).

    Prim's rule; where no edge is left, the next node begins another tree.
    """
    m = len(equal)
    best, near, todo, out = equal[0].copy(), np.zeros(m, np.int64), np.ones(m, bool), []
    todo[0] = False
    for _ in range(m - 1):
        k = int(np.where(todo, best, -1).argmax())
        if best[k] > 0:
            out.append((int(near[k]), k))
        todo[k] = False
        closer = todo & (equal[k] > best)
        best[closer], near[closer] = equal[k][closer], k
    return out


def _candidates(gid: np.ndarray, rep: np.ndarray, n: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of each block's spanning forest, from rows sorted by block."""
    left, right = [], []
    start = np.concatenate(([0], np.flatnonzero(gid[1:] != gid[:-1]) + 1))
    size = np.diff(np.append(start, len(gid)))

    def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        equal = (sig[a] == sig[b]).sum(1)
        fit = (equal >= LEAST_EQUAL) & (100 * np.minimum(n[a], n[b]) >= LINK_PERCENT * np.maximum(n[a], n[b])) & (rep[a] != rep[b])
        return np.where(fit, equal, 0)

    for s, m in zip(start[size > 3], size[size > 3], strict=True):
        at = np.arange(s, s + m)
        equal = np.zeros((m, m), np.int32)
        for k in range(m - 1):
            equal[k, k + 1 :] = fits(np.full(m - 1 - k, s + k), at[k + 1 :])
        equal += equal.T
        near = equal.any(1)
        at, equal = at[near], equal[np.ix_(near, near)]
        if len(at):
            edges = np.array(_forest(equal)).reshape(-1, 2)
            left.append(rep[at[edges[:, 0]]])
            right.append(rep[at[edges[:, 1]]])
    few = np.repeat(size, size) <= 3
    for shift in (1, 2):
        a = np.flatnonzero(few[:-shift] & (gid[:-shift] == gid[shift:])) if len(gid) > shift else np.zeros(0, np.int64)
        ok = fits(a, a + shift) > 0
        left.append(rep[a[ok]])
        right.append(rep[a[ok] + shift])
    return np.concatenate(left), np.concatenate(right)


def _links(gid: np.ndarray, rep: np.ndarray, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of each block's confirmed links; keys[at[k]:at[k + 1]] is the set of row k."""
    left, right = [], []
    start = np.append(np.concatenate(([0], np.flatnonzero(gid[1:] != gid[:-1]) + 1)), len(gid))
    for s, e in zip(start[:-1], start[1:], strict=True):
        m = e - s
        if m < 2:
            continue
        size = np.diff(at[s : e + 1])
        values, ids, times = np.unique(keys[at[s] : at[e]], return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(m), size)
        often = times > 1  # a shingle of one set only is in no intersection
        places = np.cumsum(often) - 1
        here = often[ids]
        owner, ids = owner[here], places[ids[here]]
        shared = np.zeros((m, m), np.float32)
        for low in range(0, int(often.sum()), 8192):  # a matrix of m x 8192 at a time
            part = (ids >= low) & (ids < low + 8192)
            matrix = np.zeros((m, 8192), np.float32)
            matrix[owner[part], ids[part] - low] = 1
            shared += matrix @ matrix.T
        linked = 100 * shared >= LINK_PERCENT * (size[:, None] + size - shared)
        todo = np.ones(m, bool)
        while todo.any():
            seed = int(todo.argmax())
            todo[seed] = False
            ahead = [seed]
            while ahead:
                k = ahead.pop()
                new = np.flatnonzero(linked[k] & todo)
                todo[new] = False
                left.append(np.full(len(new), rep[s + k]))
                right.append(rep[s + new])
                ahead.extend(new.tolist())
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def _by_block(rows: DataFrame, work) -> DataFrame:
    """Distinct (a, b) with a < b that `work` finds in whole blocks; rows are dealt and sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            a, b = work(pa.Table.from_batches(parts).combine_chunks())
            ok = a != b
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[ok], pa.int64()), pa.array(np.maximum(a, b)[ok], pa.int64())], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            gid = batch.column(0).to_numpy()
            last = int(np.searchsorted(gid, gid[-1]))  # where the last block, which may go on, begins
            if last:
                yield done([*held, batch.slice(0, last)])
                held = []
            elif held and held[-1].column(0)[-1].as_py() != gid[0]:
                yield done(held)
                held = []
            held.append(batch.slice(last))
        if held:
            yield done(held)

    dealt = rows.repartition("block").sortWithinPartitions("block", "rep")
    return dealt.mapInArrow(tidy(run), "a bigint, b bigint").groupBy("a", "b").agg(F.count("*").alias("times")).select("a", "b")


def candidates(members: DataFrame) -> DataFrame:
    """(a, b) from rows (block, rep, n_shingles, sig)."""

    def work(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, TOKENS)
        return _candidates(*(t.column(c).to_numpy() for c in ("block", "rep", "n_shingles")), sig)

    return _by_block(members.select("block", "rep", "n_shingles", "sig"), work)


def unjoined(grouped: DataFrame, labels: DataFrame) -> DataFrame:
    """(rep, blocks) from rows (node, rep, load): each pair of a node's members whose labels differ meets in a block.

    The members of a node's commonest label make its first parts and meet the other members only; those meet all. A
    part has about NODE members and a load of one. Members without a label are alone; a node of one label gives nothing.
    """
    rows = grouped.count()
    named = grouped.join(small_side(labels.select("rep", "label"), rows), "rep", "left").select("node", "rep", "load", F.coalesce("label", "rep").alias("label"))
    named = materialise(few_parts(named, rows))
    usual = named.groupBy("node", "label").agg(F.count("*").alias("n")).groupBy("node").agg(F.max_by("label", F.struct("n", "label")).alias("usual"), F.count("*").alias("labels")).filter("labels > 1")
    usual = materialise(few_parts(usual.select("node", "usual"), rows))
    split = named.join(small_side(usual, rows), "node").withColumn("first", F.col("label") == F.col("usual"))

    def parts(which: Column) -> Column:
        return F.greatest(F.ceil(F.count_if(which) / NODE), F.ceil(F.coalesce(F.sum(F.when(which, F.col("load"))), F.lit(0.0)))).cast("int")

    counts = materialise(few_parts(split.groupBy("node").agg(parts(F.col("first")).alias("m"), parts(~F.col("first")).alias("r")), rows))
    placed = split.join(small_side(counts, rows), "node")
    part = F.when(F.col("first"), F.pmod(F.xxhash64("rep"), F.col("m"))).otherwise(F.col("m") + F.pmod(F.xxhash64("rep"), F.col("r"))).cast("int")
    others = F.sequence(F.when(F.col("first"), F.col("m")).otherwise(0), F.col("m") + F.col("r") - 1)
    met = F.transform(others, lambda q: F.xxhash64("node", F.lit("unjoined"), F.least("part", q), F.greatest("part", q)))
    return placed.withColumn("part", part).select("rep", met.alias("blocks"))


def families_of(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, label) of all that candidate edges join, and (block, rep) of the trees' blocks."""
    members = materialise(blocks(classes))
    signed = classes.select("rep", "n_shingles", "sig")
    pairs = materialise(candidates(members.join(signed, "rep")))
    families = components(pairs)
    # only a large root whose members these blocks left in several families is gone through again
    n = families.count()
    named = classes.select("rep", "roots").join(small_side(families, n), "rep", "left").select("rep", F.coalesce("label", "rep").alias("label"), F.explode(F.array_distinct("roots")).alias("node"))
    mixed = named.groupBy("node").agg(F.count("*").alias("members"), F.min("label").alias("low"), F.max("label").alias("high")).filter((F.col("members") > NODE) & (F.col("low") != F.col("high"))).select("node")
    mixed = materialise(mixed)
    n = mixed.count()
    if n:
        grouped = materialise(named.select("node", "rep").join(small_side(mixed, n), "node").withColumn("load", F.lit(0.0)))
        left = materialise(unjoined(grouped, families))
        if not left.isEmpty():
            more = candidates(left.select(F.explode("blocks").alias("block"), "rep").join(signed, "rep"))
            families = components(pairs.unionByName(more))
    return families, members


def exact_blocks(families: DataFrame, classes: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, blocks): where each text of a family goes to be compared on full sets; and the members of families of
    more than PARTS parts, (node, rep, load), of which these blocks are the first comparison only."""
    n = families.count()
    sized = materialise(few_parts(classes.select("rep", "n_shingles").join(small_side(families, n), "rep"), n))
    parts = F.greatest(F.ceil(F.count("*") / NODE), F.ceil(F.sum("n_shingles") / PART_SHINGLES)).cast("int")
    family = few_parts(sized.groupBy("label").agg(parts.alias("parts")), n)
    placed = materialise(sized.join(small_side(family, n), "label").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.xxhash64("label", F.least("part", q), F.greatest("part", q)))
    out = placed.filter(F.col("parts") <= PARTS).select("rep", pairs.alias("blocks"))
    large = placed.filter(F.col("parts") > PARTS).select(F.col("label").alias("node"), "rep", (F.col("n_shingles") / PART_SHINGLES).alias("load"))
    if large.isEmpty():
        return out, large
    own = members.select("rep", "block").join(large, "rep", "left_semi").groupBy("rep").agg(F.collect_set("block").alias("blocks"))  # TREES times DEPTH + 1 at most
    return out.unionByName(own), large


def confirmed(docs: DataFrame, where: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b): links found in each block on the full sets of whole texts."""
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("rep"), F.col(f"`{text_col}`").alias("text"))
    few = (where.agg(F.sum(F.size("blocks") + 4)).first()[0] or 0) <= BROADCAST_IDS
    picked = texts.join(F.broadcast(where) if few else where, "rep").select("blocks", "rep", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8_parts(batch.column(2))
            for i, j in chunks(offsets):
                key, doc = shingle_sets(raw, offsets, i, j)
                at = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=j - i))))
                sets = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(key.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(c[i:j] for c in batch.columns[:2]), sets], names=["blocks", "rep", "shingles"])

    sets = picked.mapInArrow(tidy(run), "blocks array<bigint>, rep bigint, shingles array<bigint>")

    def work(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        lists = t.column("shingles").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        at = lists.offsets.to_numpy()
        return _links(t.column("block").to_numpy(), t.column("rep").to_numpy(), at - at[0], lists.flatten().to_numpy())

    return _by_block(sets.select(F.explode("blocks").alias("block"), "rep", "shingles"), work)


def components(links: DataFrame) -> DataFrame:
    """(rep, label): the least rep reachable. Each round hooks every node to its least neighbour, halves the
    paths twice, and contracts the links, so that rounds grow as the logarithm of the longest path. While links are
    few, their tables are broadcast and kept in few partitions; beyond that the same joins shuffle."""
    edges, made = materialise(links.select("a", "b")), []
    n = edges.count()
    labels = None
    while n:
        edges = few_parts(edges, n)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("up"))
        up = materialise(few_parts(up, 2 * n))
        for _ in range(2):
            over = up.select(F.col("a").alias("up"), F.col("up").alias("over"))
            up = up.join(small_side(over, 2 * n), "up", "left").select("a", F.coalesce("over", "up").alias("up"))
        up = stored(up, made)
        if labels is None:
            labels, ends = up.select(F.col("a").alias("rep"), F.col("up").alias("label")), 2 * n
        else:
            to = up.select(F.col("a").alias("label"), "up")
            labels = labels.join(small_side(to, 2 * n), "label", "left").select("rep", F.coalesce("up", "label").alias("label"))
        x, y = up.select("a", F.col("up").alias("x")), up.select(F.col("a").alias("b"), F.col("up").alias("y"))
        left = edges.join(small_side(x, 2 * n), "a").join(small_side(y, 2 * n), "b").filter("x != y")
        edges = stored(few_parts(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), n), made)
        n = edges.count()
    if labels is None:
        return edges.select(F.col("a").alias("rep"), F.col("b").alias("label"))
    labels = materialise(few_parts(labels, ends))
    for path in made:
        discard(links.sparkSession, path)
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs."""
    feats = materialise(features(docs, id_col, text_col))
    classes = feats.filter("n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("roots").alias("roots"))
    classes = materialise(classes)
    families, members = families_of(classes)
    where, large = exact_blocks(families, classes, members)
    links = confirmed(docs, materialise(where), id_col, text_col)
    if large.isEmpty():
        first = components(links)
    else:
        links = materialise(links)
        left = materialise(unjoined(materialise(large), components(links)))
        first = components(links.unionByName(confirmed(docs, left, id_col, text_col)))
    n = first.count()
    known = classes.select("h1", "h2", "n_shingles", "rep").join(small_side(first, n), "rep", "left").select("h1", "h2", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
    out = feats.select("doc_id", "n_shingles", "h1", "h2").join(known, ["h1", "h2", "n_shingles"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays, that with the least doc_id; of repeated rows, one.
    A row without a doc_id is judged by its text like any other, and comes after those that have one."""
    session_defaults(spark)
    key = free_name(docs)
    keyed = docs.withColumn(key, row_key())
    kept = materialise(near_duplicates(keyed.select(key, "text"), key).filter("kept").select(F.col("doc_id").alias(key)))
    ids = kept.distinct()
    stays = semi_by_id(keyed, ids, key).drop(key)
    return stays if kept.count() == ids.count() else stays.dropDuplicates(["doc_id", "text"])
