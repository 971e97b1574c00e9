"""N-gram Jaccard join with signature trees.

Documents are sets of word shingles. Equal sets are one node. Nodes that reach
the threshold must share one of the first shingles of both, in an order common
to all: shingles found in a large share of the documents come last, so each
node sends a short prefix, and nodes that share a prefix shingle form a group.
Groups of the same members are kept once.

First, each node is compared with one centre of its groups, the one it shares most
of them with; exact comparisons give links, and links give components. What is left
are pairs of different components within a group. Groups of one pivot (their smallest
node) are then one family, and its nodes become leaves of a signature tree, whose
inner nodes hold the OR of the leaves' token bitmaps and their range of sizes; a dual
traversal drops pairs of tree nodes whose largest possible overlap cannot reach the
threshold, or that lie in one component. Nodes of pairs that survive meet once more
with their sets, in the same blocks: there the pairs are compared exactly, by bits of
the members that several sets have, and a link is put out only when it joins two
components of the block. No link between components is lost, pairs within a component
need no comparison, and no pair is ever stored: a block puts out fewer rows than it
has nodes. The comparisons of a family of sets that share most of their members and
yet do not link remain, block by block.

Defined results: null is the empty text; a text without words has no shingle, is
linked with nothing and is its own component; a text of fewer words than a
shingle has one, of all its words; rows of one id are rows of their own; the
smallest id that is not null names a component; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curbline.llm.common import attach, bounded_batches, tidy, total_of, whole
from curbline.llm.components import components
from curbline.llm.text_arrays import LOWER, Words, mix, parts, shingles
from curbline.session import cut, settle

#: Shingles in more than one document of HEAVY_SHARE (HEAVY_LEAST at least) come last in the order; the
#: heaviest HEAVY_MOST of them are sent to all tasks. The order decides what a group costs, not what is found.
HEAVY_SHARE, HEAVY_LEAST, HEAVY_MOST = 2000, 64, 1 << 20
#: Shingles counted together in a task before the repeated ones are sent on.
COUNTED = 1 << 21
#: Postings of one group-forming task; nodes, and members of their sets, in one block of a large family; the same of one tree task.
POSTINGS, BLOCK, BLOCK_MEMBERS, TREE_ROWS, TREE_MEMBERS = 1 << 19, 1024, 1 << 20, 1 << 13, 1 << 21
#: Bytes of signatures, or of exact bitmaps, compared at a time, of either side.
COMPARED = 1 << 22
#: Bits of a signature: LEAST_BITS, or the power of two of at least BITS_EACH for each member; leaves under a tree node.
LEAST_BITS, BITS_EACH, FAN = 512, 2, 8
#: Star rounds before the trees: each compares a node with one other one of its groups.
STARS = 1
#: Pairs that meet one copy of a set in the exact comparison.
PAIRS_A_COPY = 256
#: Bits of the bitmap that tells which texts are looked at again: 8 MB, sent to all tasks.
MARKS = 1 << 26


@dataclass(frozen=True)
class Rule:
    """Shingle width in words, and the threshold in hundredths."""

    width: int = 5
    percent: int = 80

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - (n * self.percent + 99) // 100 + 1

    def reaches(self, overlap, total):
        """Whether sets of ``total`` members together can link with so many in common."""
        return 100 * overlap >= self.percent * (total - overlap)


def _sets(column: pa.Array, rule: Rule) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, size of each set, and the sets' members, each in order, end to end."""
    words = Words()
    for a, b, data, offsets in parts(column, 1 << 20):
        lowered = LOWER[data]
        starts, ends, at = words.find(lowered, offsets)
        tokens, at = shingles(words.hashes(lowered, starts, ends), at, rule.width)
        order = np.lexsort((tokens, at))
        tokens, at = tokens[order], at[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (at[1:] != at[:-1])
        tokens, at = tokens[new], at[new]
        yield a, np.bincount(at, minlength=b - a), tokens


def _keys(sizes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """One number for each set, the same for equal sets; 0 for the empty one."""
    has = sizes > 0
    out = np.zeros(len(sizes), np.uint64)
    if len(tokens):
        first = (np.cumsum(sizes) - sizes)[has]
        out[has] = mix(np.add.reduceat(mix(tokens), first) + sizes[has].astype(np.uint64))
    return out


def _signatures(sizes: np.ndarray, tokens: np.ndarray) -> list[bytes | None]:
    """The bitmap of each set, a bit for each member; null for the empty one."""
    out: list[bytes | None] = []
    end = 0
    for n in sizes.tolist():
        width = max(LEAST_BITS, 1 << (BITS_EACH * n - 1).bit_length()) if n else LEAST_BITS
        flags = np.zeros(width, bool)
        flags[tokens[end : end + n] % np.uint64(width)] = True
        out.append(np.packbits(flags).tobytes() if n else None)
        end += n
    return out


def _wide(bits: list[bytes], size: int) -> np.ndarray:
    """Signatures of one width or less as rows of words; a shorter one is repeated.

    The bits of a member are then set in each repeat, so two sets have at least as
    many bits in common as they have different members in common at the shorter width.
    """
    return np.frombuffer(b"".join(b * (size // len(b)) for b in bits), np.uint64).reshape(len(bits), -1)


def _spare(bits: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Members of each set that share a bit with another one of it."""
    return sizes - np.array([int.from_bytes(b).bit_count() for b in bits], np.int64)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _survey(docs: DataFrame, rule: Rule) -> DataFrame:
    """A row per document (``id, h, n, key, bits``), and rows of repeated shingles (``token, df``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        id_type, names = pa.null(), ["id", "h", "n", "key", "bits", "token", "df"]

        def repeated() -> pa.RecordBatch:
            token, df = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            token, df = token[df > 1], df[df > 1].astype(np.int64)
            none = [pa.nulls(len(token), t) for t in (id_type, pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays([*none, _long(token), pa.array(df)], names=names)

        for batch in batches:
            id_type = batch.schema.field("_id").type
            for a, sizes, tokens in _sets(batch.column("_text"), rule):
                n = len(sizes)
                held.append(tokens)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").slice(a, n), batch.column("_h").slice(a, n), pa.array(sizes.astype(np.int64)),
                        _long(_keys(sizes, tokens)), pa.array(_signatures(sizes, tokens), pa.binary()),
                        pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                    ],
                    names=names,
                )
                if sum(map(len, held)) >= COUNTED:
                    yield repeated()
        if held:
            yield repeated()

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(tidy(run), f"id {kind}, h bigint, n bigint, key bigint, bits binary, token bigint, df bigint")


def _heavy(survey: DataFrame, n_docs: int, heavy_least: int) -> np.ndarray:
    """Shingles to put last, in order of their value, with the logarithm of their count."""
    counts = survey.where("token IS NOT NULL").groupBy("token").agg(F.sum("df").alias("df"))
    often = counts.where(F.col("df") >= max(heavy_least, n_docs // HEAVY_SHARE)).orderBy(F.desc("df"), "token").limit(HEAVY_MOST)
    got = often.select("token", F.floor(F.log2("df")).cast("tinyint").alias("rank")).toArrow()
    token = np.array(got.column("token").to_numpy().astype(np.int64)).view(np.uint64)
    order = np.argsort(token)
    table = np.zeros(len(token), [("token", np.uint64), ("rank", np.int8)])
    table["token"], table["rank"] = token[order], got.column("rank").to_numpy()[order]
    return table


def _shared(docs: DataFrame, rule: Rule, heavy: np.ndarray, n_buckets: int) -> DataFrame:
    """``token, key`` of prefix shingles that at least two nodes have (heavy ones: any)."""
    sent = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            done: set[int] = set()  # copies of a set within a batch send it once
            for _, sizes, tokens in _sets(batch.column("_text"), rule):
                keys = _keys(sizes, tokens)
                send = np.array([n > 0 and k not in done and not done.add(k) for n, k in zip(sizes, keys.tolist())], bool)
                at = np.repeat(np.arange(len(sizes)), sizes)
                tokens, at = tokens[send[at]], at[send[at]]
                if not len(tokens):
                    continue
                rank = np.zeros(len(tokens), np.int8)
                if len(table):
                    place = np.minimum(np.searchsorted(table["token"], tokens), len(table) - 1)
                    hit = table["token"][place] == tokens
                    rank[hit] = table["rank"][place[hit]]
                    order = np.lexsort((tokens, rank, at))
                    tokens, rank, at = tokens[order], rank[order], at[order]
                kept = np.where(send, sizes, 0)
                inside = np.arange(len(tokens)) - np.repeat(np.cumsum(kept) - kept, kept)
                first = inside < rule.prefix(kept)[at]
                tokens, rank, key = tokens[first], rank[first], keys[at[first]]
                # heavy shingles are dealt by node, others by shingle
                bucket = np.where(rank > 0, n_buckets + key % np.uint64(n_buckets), tokens % np.uint64(n_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, both = bucket[order], np.column_stack([tokens[order], key[order]])
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                ends = np.append(cuts[1:], len(bucket))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cuts]), pa.array([both[x:y].tobytes() for x, y in zip(cuts, ends)], pa.binary())],
                    names=["bucket", "postings"],
                )

    def meet(table: pa.Table) -> pa.Table:
        both = np.frombuffer(b"".join(table.column("postings").to_pylist()), np.uint64).reshape(-1, 2)
        token, key = both[:, 0], both[:, 1]
        order = np.lexsort((key, token))
        token, key = token[order], key[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
        token, key = token[new], key[new]
        if len(token) and table.column("bucket")[0].as_py() < n_buckets:
            same = token[1:] == token[:-1]
            several = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            token, key = token[several], key[several]
        return pa.table({"token": _long(token), "key": _long(key)})

    sent_out = docs.select("_text").mapInArrow(tidy(run), "bucket bigint, postings binary")
    return sent_out.groupBy("bucket").applyInArrow(meet, "token bigint, key bigint")


def _marks(rows: DataFrame) -> np.ndarray:
    """Bitmap of MARKS bits of the rows' ``r``, in words: what a scan tests before it makes a set."""
    bit = F.pmod("r", F.lit(MARKS))
    words = rows.groupBy(F.shiftright(bit, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(bit, F.lit(64)).cast("int"))).alias("mask")
    ).toArrow()
    out = np.zeros(MARKS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    return out.view(np.uint64)


def _members(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """``key, members`` of the nodes of the pairs, and of a few more.

    The sets are made again where the texts lie. A bitmap of fixed size tells
    which rows to look at, so no text is shuffled; it may let others pass, which
    the joins on the key then leave out.
    """
    ends = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    wanted = ends.join(nodes.select("key", "rep"), "key").select(F.xxhash64("rep.id", "rep.h").alias("r"))
    sent = docs.sparkSession.sparkContext.broadcast(_marks(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = sent.value
        for batch in batches:
            bit = np.mod(batch.column("r").to_numpy(), MARKS)
            marked = (marks[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)
            for _, sizes, tokens in _sets(batch.column("_text").filter(pa.array(marked == 1)), rule):
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [_long(_keys(sizes, tokens)), pa.array([tokens[e - n : e].tobytes() for e, n in zip(ends, sizes)], pa.binary())],
                    names=["key", "members"],
                )

    rows = docs.select(F.xxhash64("_id", "_h").alias("r"), "_text")
    return rows.mapInArrow(tidy(run), "key bigint, members binary")


def _likely(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs that the sizes and signatures of both nodes leave possible."""
    sides = []
    for side in ("a", "b"):
        sides.append(nodes.select(F.col("key").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = [batch.column(f"n_{s}").to_numpy() for s in "ab"]
            keep = rule.reaches(np.minimum(n_a, n_b), n_a + n_b)
            bits_a, bits_b = [batch.column(f"bits_{s}").to_pylist() for s in "ab"]
            for width in {max(len(bits_a[k]), len(bits_b[k])) for k in np.flatnonzero(keep)}:
                at = np.array([k for k in np.flatnonzero(keep) if max(len(bits_a[k]), len(bits_b[k])) == width])
                x, y = [bits_a[k] for k in at], [bits_b[k] for k in at]
                common = np.bitwise_count(_wide(x, width) & _wide(y, width)).sum(axis=1, dtype=np.int64)
                most = np.minimum(np.minimum(n_a[at], n_b[at]), common + np.minimum(_spare(x, n_a[at]), _spare(y, n_b[at])))
                keep[at] = rule.reaches(most, n_a[at] + n_b[at])
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    joined = _joined(_joined(pairs, sides[1], "b"), sides[0], "a")
    return joined.select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(tidy(run), "a bigint, b bigint")


def _joined(pairs: DataFrame, side_rows: DataFrame, side: str) -> DataFrame:
    """Pairs with the columns of one side's row; a node with many pairs meets them as several copies."""
    counts = cut(pairs.groupBy(side).agg(F.count("*").alias("_n")).withColumn("_copies", F.ceil(F.col("_n") / PAIRS_A_COPY)))
    other = "b" if side == "a" else "a"
    dealt = attach(pairs, counts, side, "_n", total_of(counts, "_n"), ["a", "b"]).withColumn(
        "_copy", F.pmod(F.xxhash64(other), F.col("_copies"))
    )
    sent = counts.select(F.col(side).alias("_side"), "_copies")
    copies = side_rows.join(sent, F.col(side) == F.col("_side")).withColumn(
        "_c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1))
    ).drop("_side", "_copies").withColumnRenamed(side, "_key")
    more = [c for c in side_rows.columns if c != side]
    return dealt.join(copies, (F.col(side) == F.col("_key")) & (F.col("_copy") == F.col("_c"))).select(*pairs.columns, *more)


def _links(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose sets reach the threshold, by exact comparison."""
    sets = cut(_members(docs, nodes, pairs, rule))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("members_a"), batch.column("members_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if not rule.reaches(min(len(x), len(y)), len(x) + len(y)):
                    keep.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                keep.append(rule.reaches(int((both[1:] == both[:-1]).sum()), len(both)))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    sides = [sets.select(F.col("key").alias(s), F.col("members").alias(f"members_{s}")) for s in "ab"]
    joined = _joined(_joined(pairs, sides[1], "b"), sides[0], "a")
    return joined.select("a", "b", "members_a", "members_b").mapInArrow(tidy(run), "a bigint, b bigint")


class Tree:
    """A signature tree over nodes in order of component, then size.

    The overlap of two sets is at most the bits they have in common and the members
    of either that share a bit with another one (``spare``).
    """

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, spare: np.ndarray, component: np.ndarray):
        level = {"bits": bits, "low": sizes, "high": sizes, "spare": spare, "first": component, "last": component}
        self.levels = [level]
        while len(level["low"]) > 1:
            at = np.arange(0, len(level["low"]), FAN)
            level = {
                "bits": np.bitwise_or.reduceat(level["bits"], at), "low": np.minimum.reduceat(level["low"], at),
                "high": np.maximum.reduceat(level["high"], at), "spare": np.maximum.reduceat(level["spare"], at),
                "first": np.minimum.reduceat(level["first"], at), "last": np.maximum.reduceat(level["last"], at),
            }
            self.levels.append(level)

    def pairs(self, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves x < y, of different components, that could link."""
        depth = len(self.levels) - 1
        x = y = np.zeros(1, np.int64)
        for k in range(depth, -1, -1):
            if k < depth:  # the children of each surviving pair
                n = len(self.levels[k]["low"])
                step = np.arange(FAN)
                x = np.repeat((x[:, None] * FAN + step).ravel().reshape(-1, FAN), FAN, axis=1).ravel()
                y = np.tile(y[:, None] * FAN + step, (1, FAN)).ravel()
                ok = (x < n) & (y < n) & (x <= y)
                x, y = x[ok], y[ok]
            keep = np.zeros(len(x), bool)
            some = max(1, COMPARED // (8 * self.levels[k]["bits"].shape[1]))
            for a in range(0, len(x), some):
                keep[a : a + some] = self._possible(self.levels[k], x[a : a + some], y[a : a + some], rule)
            x, y = x[keep], y[keep]
        leaf = x < y
        return x[leaf], y[leaf]

    @staticmethod
    def _possible(level: dict, x: np.ndarray, y: np.ndarray, rule: Rule) -> np.ndarray:
        common = np.bitwise_count(level["bits"][x] & level["bits"][y]).sum(axis=1, dtype=np.int64)
        most = np.minimum(np.minimum(level["high"][x], level["high"][y]), common + np.minimum(level["spare"][x], level["spare"][y]))
        apart = ~((level["first"][x] == level["last"][x]) & (level["first"][y] == level["last"][y]) & (level["first"][x] == level["first"][y]))
        sizes = (100 * level["high"][x] >= rule.percent * level["low"][y]) & (100 * level["high"][y] >= rule.percent * level["low"][x])
        return apart & sizes & rule.reaches(most, level["low"][x] + level["low"][y])


def _by_width(bits, sizes, spare, width, component, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group: sets that can link have signatures of one width, or of the next."""
    reach = 1
    while reach * rule.percent < 100:  # how many times larger a partner can be, as a power of two
        reach *= 2
    found, done = [], 0
    for w in np.unique(width):
        if width[(width >= w) & (width <= w * reach)].max() <= done:
            continue  # met with the narrower ones
        at = np.flatnonzero((width >= w) & (width <= w * reach))
        done = int(width[at].max())
        x, y = Tree(_wide([bits[k] for k in at], done), sizes[at], spare[at], component[at]).pairs(rule)
        found.append(np.column_stack([at[x], at[y]]))
    both = np.unique(np.concatenate(found), axis=0)
    return both[:, 0], both[:, 1]


def _blocks(members: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """Members ``pivot, key, component`` of families, once for each block pair ``i <= j`` of their family that they take part in.

    Each pair of a family's blocks is a piece of work, with ``own`` the block of the row.
    """
    rows = cut(members.select("pivot", "key", "component").distinct().join(nodes.select(F.col("key").alias("_k"), "n"), F.col("key") == F.col("_k")).drop("_k"))
    families = cut(rows.groupBy("pivot").agg(F.count("*").alias("n_family"), F.sum("n").alias("n_members")))
    rows = cut(attach(rows, families, "pivot", "n_family", total_of(families, "n_family"), ["key"]))
    # In a family of one block, a node whose nearest sizes are too far off has no partner; larger ones are left to the trees.
    by_size = Window.partitionBy("pivot").orderBy("n", "key")
    near = (F.lag("n").over(by_size) * 100 >= F.col("n") * rule.percent) | (F.col("n") * 100 >= F.lead("n").over(by_size) * rule.percent)
    small = rows.where(F.col("n_family") <= BLOCK).withColumn("_near", near).where("_near").drop("_near")
    rows = small.unionByName(rows.where(F.col("n_family") > BLOCK))
    blocks = F.greatest(F.ceil(F.col("n_family") / BLOCK), F.least(F.ceil(F.col("n_members") / BLOCK_MEMBERS), F.col("n_family"))).cast("int")
    return rows.withColumns({"own": F.pmod(F.xxhash64("key"), blocks).cast("int"), "_other": F.explode(F.sequence(F.lit(0), blocks - 1))}).select(
        "pivot", F.least("own", "_other").alias("i"), F.greatest("own", "_other").alias("j"), "own", "key", "component", "n"
    )


def _dealt(rows: DataFrame) -> DataFrame:
    """Block pairs dealt to tasks of bounded rows and members."""
    size = rows.agg(F.count("*").alias("rows"), F.sum("n").alias("members")).first()
    tasks = max(1, -(-size["rows"] // TREE_ROWS), -(-(size["members"] or 0) // TREE_MEMBERS))
    return rows.withColumn("_task", F.pmod(F.xxhash64("pivot", "i", "j"), F.lit(tasks)))


_IN_ORDER = [(c, "ascending") for c in ("pivot", "i", "j", "component", "n", "key")]


def _possible_pairs(table: pa.Table, bits: list[bytes], rule: Rule) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row of each block pair of the ordered table, and the pairs of its rows that could link."""
    pivot, i, j, own, component, n = [table.column(c).to_numpy() for c in ("pivot", "i", "j", "own", "component", "n")]
    spare, width = _spare(bits, n), np.array([len(b) for b in bits])
    cuts = np.flatnonzero((pivot[1:] != pivot[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
    for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pivot)]):
        x, y = _by_width(bits[s:e], n[s:e], spare[s:e], width[s:e], component[s:e], rule)
        if i[s] != j[s]:  # pairs within a block are found where it meets itself
            cross = own[s + x] != own[s + y]
            x, y = x[cross], y[cross]
        yield s, e, x, y


def _open_nodes(rows: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """The rows of block pairs that are in a pair which could link, by the signature trees."""
    with_bits = _dealt(rows.join(nodes.select(F.col("key").alias("_k"), "bits"), F.col("key") == F.col("_k")).drop("_k"))
    kept = ["pivot", "i", "j", "own", "key", "component", "n"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(_IN_ORDER)
        bits = table.column("bits").to_pylist()
        table = table.select(kept)
        some = np.zeros(table.num_rows, bool)
        for s, _, x, y in _possible_pairs(table, bits, rule):
            some[s + x] = some[s + y] = True
        return table.filter(pa.array(some))

    return with_bits.groupBy("_task").applyInArrow(run, "pivot bigint, i int, j int, own int, key bigint, component bigint, n bigint")


def _overlaps(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Members that the sets of each pair have in common, exactly, by a bit for each member that several sets have."""
    used, place = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = place[: len(x)], place[len(x) :]
    sizes = np.array([len(sets[k]) for k in used])
    value, column = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True)
    row = np.repeat(np.arange(len(used)), sizes)
    shared = np.bincount(column, minlength=len(value)) > 1
    column, row = (np.cumsum(shared) - 1)[column[shared[column]]], row[shared[column]]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    common = np.zeros(len(x), np.int64)
    some = max(64, COMPARED // max(len(used), 1) * 8 // 64 * 64)  # columns at a time
    for first in range(0, int(shared.sum()), some):
        a, b = np.searchsorted(column, [first, first + some])
        width = min(some, int(column[b - 1]) - first + 1) if b > a else 0
        if not width:
            continue
        flags = np.zeros((len(used), -(-width // 64) * 64), bool)
        flags[row[a:b], column[a:b] - first] = True
        words = np.packbits(flags, axis=1).view(np.uint64)
        del flags
        step = max(1, COMPARED // (8 * words.shape[1]))
        for k in range(0, len(x), step):
            common[k : k + step] += np.bitwise_count(words[x[k : k + step]] & words[y[k : k + step]]).sum(axis=1, dtype=np.int64)
    return common


class Joined:
    """Components that links have joined so far."""

    def __init__(self, component: np.ndarray):
        _, self.at = np.unique(component, return_inverse=True)
        self.to = np.arange(int(self.at.max(initial=-1)) + 1)

    def of(self, rows: np.ndarray) -> np.ndarray:
        while True:
            further = self.to[self.to]
            if (further == self.to).all():
                return self.to[self.at[rows]]
            self.to = further

    def join(self, a: int, b: int) -> bool:
        a, b = self.at[a], self.at[b]
        while self.to[a] != a:
            a = self.to[a]
        while self.to[b] != b:
            b = self.to[b]
        self.to[max(a, b)] = min(a, b)
        return a != b


def _across(members: DataFrame, docs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """Links ``a, b`` that join components, of members ``pivot, key, component`` of one family: all that are needed to join them."""
    open_ = cut(_open_nodes(_blocks(members, nodes, rule), nodes, rule))
    sets = cut(_members(docs, nodes, open_.select(F.col("key").alias("a"), F.col("key").alias("b")), rule))
    with_sets = _dealt(open_.join(sets.select(F.col("key").alias("_k"), "members"), F.col("key") == F.col("_k")).drop("_k"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(_IN_ORDER)
        sets = [np.frombuffer(m.as_buffer(), np.uint64) for m in table.column("members")]
        key, component, n = [table.column(c).to_numpy() for c in ("key", "component", "n")]
        bits = [b for m in sets for b in _signatures(np.array([len(m)]), m)]
        joined, links = Joined(component), []
        for s, _, x, y in _possible_pairs(table, bits, rule):
            x, y = s + x, s + y
            while len(x):  # pairs that one link makes needless are left out of the next round
                some = min(len(x), 1 << 16)
                apart = joined.of(x[:some]) != joined.of(y[:some])
                a, b = x[:some][apart], y[:some][apart]
                x, y = x[some:], y[some:]
                if len(a):
                    reach = rule.reaches(_overlaps(sets, a, b), n[a] + n[b])
                    links += [(key[p], key[q]) for p, q in zip(a[reach].tolist(), b[reach].tolist()) if joined.join(p, q)]
        both = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(both.min(axis=1)), "b": pa.array(both.max(axis=1))})

    return with_sets.groupBy("_task").applyInArrow(run, "a bigint, b bigint")


def _star(inside: DataFrame, turn: int) -> DataFrame:
    """Each node with the centre it shares most groups with, of another component.

    A group's centre is its first node in an order that changes from turn to turn.
    """
    rank = F.xxhash64("key", F.lit(turn))
    centres = cut(inside.groupBy("token").agg(
        F.min_by(F.struct("key", "component"), rank).alias("centre"), F.count("*").alias("n")
    ))
    total = total_of(centres, "n")
    return (
        attach(inside, centres, "token", "n", total, ["key"])
        .where(F.col("component") != F.col("centre.component"))
        .groupBy("key", F.col("centre.key").alias("centre")).agg(F.sum("weight").alias("w"))
        .groupBy("key").agg(F.max(F.struct("w", "centre")).alias("best"))
        .select(F.col("best.centre").alias("a"), F.col("key").alias("b"))
    )


def join(docs: DataFrame, id: str = "doc_id", text: str = "text", rule: Rule = Rule(), heavy_least: int = HEAVY_LEAST) -> DataFrame:
    """``id, h`` (hash of the text), ``n_shingles``, ``component_id`` and ``component`` (its number; null without words) of every row."""
    bounded_batches(docs)
    texts = docs.select(F.col(id).alias("_id"), whole(text).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    survey = cut(_survey(texts, rule))
    rows = survey.where("n IS NOT NULL").select("id", "h", "n", "key")
    full = rows.where("n > 0")
    nodes = cut(survey.where("n > 0").groupBy("key").agg(
        F.min(F.struct("id", "h")).alias("rep"), F.min("id").alias("least"), F.count("*").alias("size"),
        F.max("n").alias("n"), F.first("bits").alias("bits"),
    ))
    seen = rows.agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")).first()
    heavy = _heavy(survey, seen["docs"], heavy_least)
    n_buckets = max(8, -(-((seen["tokens"] or 0) * (100 - rule.percent) // 100 + seen["docs"]) // POSTINGS))
    shared = cut(_shared(texts, rule, heavy, n_buckets))

    # Groups of the same members are one group.
    groups = cut(
        shared.groupBy("token").agg(
            F.min("key").alias("pivot"), F.count("*").alias("n_group"),
            F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"),
        ).where("n_group > 1").groupBy("pivot", "n_group", "x", "y").agg(F.min("token").alias("token"), F.count("*").alias("weight"))
        .select("token", "pivot", "n_group", "weight")
    )
    members = cut(
        attach(shared, groups, "token", "n_group", total_of(groups, "n_group"), ["key"]).where("pivot IS NOT NULL")
    )

    def place(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Components so far, and the members of groups that span several."""
        found = components(links)
        placed = cut(
            members.join(found, F.col("key") == F.col("node"), "left")
            .select("token", "pivot", "key", "n_group", "weight", F.coalesce("component", "key").alias("component"))
        )
        spans = cut(
            placed.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("n"))
            .where("c0 <> c1").select("token", "n")
        )
        inside = attach(placed, spans, "token", "n", total_of(groups, "n_group"), ["key"]).where("n IS NOT NULL").drop("n")
        return found, cut(inside)

    links = None
    settle(docs.sparkSession)
    inside = cut(members.select("token", "pivot", "key", "n_group", "weight", F.col("key").alias("component")))
    for turn in range(STARS + 1):
        if inside.isEmpty():
            break
        if turn < STARS:
            likely = _likely(cut(_star(inside, turn)), nodes, rule)
            more = cut(_links(cut(likely), texts, nodes, rule))
            links = more if links is None else links.unionByName(more)
            found, inside = place(links)
            settle(docs.sparkSession)
        else:  # the links between components that the trees leave possible
            links = links.unionByName(cut(_across(inside, texts, nodes, rule)))
            found = components(links)
    if links is None:
        found = nodes.select(F.col("key").alias("node"), F.col("key").alias("component"))

    placed = cut(
        nodes.join(found, F.col("key") == F.col("node"), "left")
        .select("key", "size", "least", F.coalesce("component", "key").alias("component"))
    )
    least = cut(placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n_nodes")))
    named = attach(
        placed, least, "component", "n_nodes", total_of(least, "n_nodes"), ["key"]
    ).select("key", "size", "component_id", "component")
    total = total_of(nodes, "size")
    return attach(full, cut(named), "key", "size", total, ["id", "h"]).select(
        "id", "h", F.col("n").alias("n_shingles"), "component_id", "component"
    ).unionByName(rows.where("n = 0").select(
        "id", "h", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(None).cast("bigint").alias("component")
    ))


def op10(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return join(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
