"""Spelling variants grouped with a frequency-vector trie.

A word's vector counts its letters by group (``GROUPS``). Words lie in a trie by
successive counts. One inserted, deleted or replaced letter raises one count by one
at most, and lowers one by one at most, so a depth-first search follows a word's own
counts with a surplus and a deficit of one to spend; the words of the leaves it
reaches are compared letter by letter. Of two words, the one whose first different
count is smaller finds the other: each pair is found once.

The top of the trie is split over tasks: nodes with more than ``Split.most`` words
are cut deeper, the rest are the tasks' subtries; a leaf of more words than that is
cut into blocks. A word lies in one of them and is sent, as a question, to those its
budget reaches. How many words share a node is counted first, and only the nodes to
cut (a fixed number for each level at most) reach the driver and the tasks. Each task
answers with a row per word; pairs are never stored.

Defined results: null is the empty text; a null id counts as the empty text where
:func:`op13` deletes letters; rows of one id and repeated rows are counted each; an
empty table, or one without words, gives an empty result; ties between near words
go to the smaller in code-point order; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.llm.common import bounded_batches, tidy, whole
from curbline.session import cut

#: Letter groups in the order of the levels, of about the same share of Latin text; other letters are one more.
GROUPS = ("e", "t", "az", "oj", "iq", "nx", "sk", "hv", "rb", "dpy", "lc", "umf", "wg")
LEVELS = len(GROUPS) + 1
_GROUP = np.full(256, len(GROUPS), np.int64)
for _k, _letters in enumerate(GROUPS):
    _GROUP[[ord(c) for c in _letters]] = _k
#: Counts above TOP are not told apart in the trie: a difference of one is then one or none.
TOP = 255
#: Different words a task counts together; searches and pairs handled at a time; bytes of letters compared at a time.
COUNTED, SEARCHED, PAIRS, COMPARED = 1 << 18, 1 << 16, 1 << 18, 1 << 24
#: Characters of a text searched for words at a time, unless a word is longer.
PIECE = 1 << 20

_NONE, _SURPLUS, _BOTH = 0, 1, 2  # what a search has spent


@dataclass(frozen=True)
class Split:
    """A subtrie holds ``least`` words or a share of one in ``parts``, whichever is more; tasks take ``rows`` words and questions."""

    least: int = 8192
    parts: int = 10_000
    rows: int = 1 << 16

    def most(self, n_words: int) -> int:
        return max(self.least, n_words // self.parts)


def _pieces(text: str) -> Iterator[str]:
    """The text cut where no letter is."""
    a = 0
    while len(text) - a > PIECE:
        b = a + PIECE
        while b < len(text) and re.match("[A-Za-zÀ-ÿ]", text[b]):
            b += 1
        yield text[a:b]
        a = b
    yield text[a:]


def word_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = 7, drop: int = 0) -> DataFrame:
    """``word, n``: lower-cased runs of letters of ``least`` letters or more, with how often they occur.

    With ``drop``, a run whose crc32 with its id divides by it loses the letter that number names.
    """
    run_of_letters = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column("_key").to_pylist(), batch.column("_text")):
                lowered = text.as_py().encode().lower().decode()  # bytes: A-Z only
                start = zlib.crc32(f"{key}:".encode())
                for piece in _pieces(lowered):
                    for word, n in Counter(run_of_letters.findall(piece)).items():
                        if drop and (h := zlib.crc32(word.encode(), start)) % drop == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                        total[word] += n
                    if len(total) >= COUNTED:
                        yield counted()
        if total:
            yield counted()

    rows = docs.select(whole(id).alias("_key"), whole(text).alias("_text"))
    return rows.mapInArrow(tidy(run), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Letters:
    """Words as letters end to end, a byte each."""

    def __init__(self, words: list[str]):
        each = [w.encode("latin-1") for w in words]
        self.size = np.array([len(w) for w in each], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(each) + b"\0", np.uint8)

    def rows(self, at: np.ndarray, width: int) -> np.ndarray:
        """The words' letters as rows of one width, filled up with zeros."""
        step = np.arange(width)
        inside = step < self.size[at][:, None]
        return np.where(inside, self.data[np.where(inside, self.first[at][:, None] + step, 0)], 0)

    def vectors(self) -> np.ndarray:
        """A row per word: how many letters of each group it has, TOP at most."""
        n = len(self.size)
        at = np.repeat(np.arange(n), self.size)
        counts = np.bincount(at * LEVELS + _GROUP[self.data[:-1]], minlength=n * LEVELS)
        return np.minimum(counts, TOP).astype(np.uint8).reshape(n, LEVELS)


class Trie:
    """Words in order of their vectors; a node is a stretch of them, known by its first place."""

    def __init__(self, vectors: np.ndarray):
        self.order = np.lexsort(vectors.T[::-1])
        ranked = vectors[self.order]
        n = len(ranked)
        new = np.zeros(n, bool)
        if n:
            new[0] = True
        node = np.zeros(n, np.int64)
        self.keys: list[np.ndarray] = []  # of each level's nodes: parent and count, rising
        for level in range(LEVELS):
            new[1:] |= ranked[1:, level] != ranked[:-1, level]
            first = np.flatnonzero(new)
            self.keys.append(node[first] * 256 + ranked[first, level])
            node = np.cumsum(new) - 1
        self.first = np.append(np.flatnonzero(new), n)  # of each leaf's words

    def child(self, level: int, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the nodes have a child of that count, and the child."""
        key = node * 256 + count
        keys = self.keys[level]
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        has = (keys[place] == key) & (count >= 0) & (count <= TOP)
        return has, place

    def search(self, questions: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Question, leaf and what was spent, for all leaves in reach; depth first, in blocks."""
        if not len(self.order):
            return
        stack = []
        for a in range(0, len(questions), SEARCHED):
            some = np.arange(a, min(a + SEARCHED, len(questions)))
            stack.append((0, some, np.zeros(len(some), np.int64), np.zeros(len(some), np.int8)))
        while stack:
            level, q, node, spent = stack.pop()
            if level == LEVELS:
                yield q, node, spent
                continue
            count = questions[q, level].astype(np.int64)
            found = []
            for step, which, becomes in ((0, None, None), (1, spent == _NONE, _SURPLUS), (-1, spent == _SURPLUS, _BOTH)):
                at = np.arange(len(q)) if which is None else np.flatnonzero(which)
                has, place = self.child(level, node[at], count[at] + step)
                at, place = at[has], place[has]
                found.append((q[at], place, spent[at] if becomes is None else np.full(len(at), becomes, np.int8)))
            q, node, spent = [np.concatenate(c) for c in zip(*found)]
            for a in range(0, len(q), SEARCHED):
                b = a + SEARCHED
                stack.append((level + 1, q[a:b], node[a:b], spent[a:b]))


def one_edit(x: Letters, a: np.ndarray, y: Letters, b: np.ndarray) -> np.ndarray:
    """Whether the words differ by exactly one letter put in, taken out or replaced."""
    out = np.zeros(len(a), bool)
    swap = x.size[a] > y.size[b]
    for turn, (s, i, t, j) in ((~swap, (x, a, y, b)), (swap, (y, b, x, a))):
        gap = t.size[j] - s.size[i]
        for extra in (0, 1):
            at = np.flatnonzero(turn & (gap == extra))
            at = at[np.argsort(s.size[i[at]], kind="stable")]
            done = 0
            while done < len(at):  # words of like size together, in blocks of bounded bytes
                sizes = s.size[i[at[done:]]] + 2
                k = done + max(1, int(np.searchsorted(sizes * np.arange(1, len(sizes) + 1), COMPARED, "right")))
                some = at[done:k]
                width = int(s.size[i[some]].max())
                short, long = s.rows(i[some], width), t.rows(j[some], width + extra)
                inside = np.arange(width) < s.size[i[some]][:, None]
                differ = (short != long[:, :width]) & inside
                if extra:  # equal up to a place, and after it one letter on
                    first = np.where(differ.any(axis=1), differ.argmax(axis=1), s.size[i[some]])
                    after = (short != long[:, 1:]) & inside & (np.arange(width) >= first[:, None])
                    out[some] = ~after.any(axis=1)
                else:
                    out[some] = differ.sum(axis=1) == 1
                done = k
    return out


def near_words(words: list[str], n: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each word: pairs found here that it is in, and the best partner (largest n, then smallest; -1 for none).

    ``words`` rise; ``own`` marks those of the trie; all are searched for in it.
    """
    letters = Letters(words)
    vectors = letters.vectors()
    mine = np.flatnonzero(own)
    trie = Trie(vectors[mine])
    held = mine[trie.order]  # words of the trie in its order
    near = np.zeros(len(words), np.int64)
    best = np.full(len(words), -1, np.int64)
    rank = np.empty(len(words), np.int64)  # the better, the smaller
    rank[np.argsort(-n, kind="stable")] = np.arange(len(words))
    best_rank = np.full(len(words), len(words), np.int64)
    for q, leaf, spent in trie.search(vectors):
        lo, size = trie.first[leaf], trie.first[leaf + 1] - trie.first[leaf]
        last = np.cumsum(size)
        done = 0
        while done < last[-1]:  # the words of the leaves, a bounded number at a time
            upto = min(done + PAIRS, int(last[-1]))
            at = np.arange(done, upto)
            k = np.searchsorted(last, at, "right")
            a, b = q[k], held[lo[k] + at - (last - size)[k]]
            once = (spent[k] != _NONE) | (a < b)  # two words of one vector find each other, here or in another block
            a, b = a[once], b[once]
            linked = one_edit(letters, a, letters, b)
            a, b = a[linked], b[linked]
            for x, y in ((a, b), (b, a)):
                near += np.bincount(x, minlength=len(words))
                np.minimum.at(best_rank, x, rank[y])
            done = upto
    by_rank = np.argsort(rank)
    has = best_rank < len(words)
    best[has] = by_rank[best_rank[has]]
    return near, best


def _prefix(vector: np.ndarray) -> list[bytes]:
    return [v.tobytes() for v in vector]


def _subtrie(vector: bytes, heavy: dict[bytes, int]) -> bytes:
    """The node a word lies under."""
    depth = 0
    while depth < LEVELS and vector[:depth] in heavy:
        depth += 1
    return vector[:depth]


def _blocks(node: bytes, heavy: dict[bytes, int]) -> list[bytes]:
    """The blocks of a heavy leaf; any other node is one."""
    if len(node) < LEVELS or node not in heavy:
        return [node]
    return [node + k.to_bytes(8) for k in range(heavy[node])]


def _reached(vector: bytes, heavy: dict[bytes, int]) -> list[bytes]:
    """Nodes that a word's search reaches besides its own."""
    out, stack = [], [(b"", _NONE)]
    while stack:
        node, spent = stack.pop()
        if node not in heavy or len(node) == LEVELS:
            if spent != _NONE:
                out.append(node)
            continue
        c = vector[len(node)]
        stack.append((node + bytes([c]), spent))
        if spent == _NONE and c < TOP:
            stack.append((node + bytes([c + 1]), _SURPLUS))
        elif spent == _SURPLUS and c > 0:
            stack.append((node + bytes([c - 1]), _BOTH))
    return out


def _heavy(words: DataFrame, most: int) -> dict[bytes, int]:
    """Nodes of more than ``most`` words, n / most of each level at most, and how many times as many they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors, n = np.unique(Letters(batch.column("word").to_pylist()).vectors(), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(_prefix(vectors), pa.binary()), pa.array(n)], names=["vector", "n"])

    vectors = words.select("word").mapInArrow(tidy(run), "vector binary, n bigint").groupBy("vector").agg(F.sum("n").alias("n"))
    nodes = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("depth"), "vector", "n").select(
        F.expr("substring(vector, 1, depth)").alias("node"), "n"
    )
    got = nodes.groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") > most).collect()
    return {bytes(r["node"]): -(-r["n"] // most) for r in got}


def near_counts(words: DataFrame, split: Split = Split()) -> DataFrame:
    """``word, n_near, best``: near words of ``word, n`` (different words) and the best of them (``n, word``); words without one are left out."""
    n_words = words.count()
    heavy = words.sparkSession.sparkContext.broadcast(_heavy(words, split.most(n_words)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = heavy.value
        for batch in batches:
            if not batch.num_rows:
                continue
            out: dict[str, list] = {"node": [], "own": [], "at": []}
            words_ = batch.column("word").to_pylist()
            for k, vector in enumerate(_prefix(Letters(words_).vectors())):
                own = _blocks(_subtrie(vector, cuts), cuts)
                mine = own[zlib.crc32(words_[k].encode()) % len(own)]
                nodes = own + [b for x in _reached(vector, cuts) for b in _blocks(x, cuts)]
                out["node"] += nodes
                out["own"] += [x == mine for x in nodes]
                out["at"] += [k] * len(nodes)
            rows = batch.select(["word", "n"]).take(pa.array(out["at"], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["node"], pa.binary()), pa.array(out["own"], pa.bool_()), *rows.columns], names=["node", "own", "word", "n"]
            )

    dealt = cut(words.mapInArrow(tidy(deal), "node binary, own boolean, word string, n bigint"))
    # A task takes several subtries as one; a question that reaches several of them comes once.
    tasks = max(1, -(-dealt.count() // split.rows))
    asked = dealt.groupBy(F.pmod(F.xxhash64("node"), F.lit(tasks)).alias("task"), "word").agg(F.max("n").alias("n"), F.max("own").alias("own"))

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by("word")
        names, n = table.column("word").to_pylist(), table.column("n").to_numpy()
        near, best = near_words(names, n, table.column("own").to_numpy(zero_copy_only=False))
        some = np.flatnonzero(near)
        return pa.table({
            "word": pa.array([names[k] for k in some], pa.string()), "n_near": pa.array(near[some]),
            "best_n": pa.array(n[best[some]]), "best": pa.array([names[k] for k in best[some]], pa.string()),
        })

    met = asked.groupBy("task").applyInArrow(meet, "word string, n_near bigint, best_n bigint, best string")
    return met.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("best")
    ).select("word", "n_near", F.struct((-F.col("best.less")).alias("n"), F.col("best.word").alias("word")).alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """``word, root`` of links ``word, form``, followed to the last form.

    Each form is more frequent than its word by a factor, so few rounds are needed;
    only words that still move go on.
    """
    ends = links.select(F.col("word").alias("_word"), F.col("form").alias("_next"))
    moving, done = links.select("word", F.col("form").alias("root")), []
    while True:
        step = cut(moving.join(ends, F.col("root") == F.col("_word"), "left").select("word", "root", "_next"))
        done.append(step.where("_next IS NULL").select("word", "root"))
        moving = step.where("_next IS NOT NULL").select("word", F.col("_next").alias("root"))
        if moving.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def group(words: DataFrame, times: int = 10, split: Split = Split()) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of different words ``word, n``: see :func:`op13`."""
    near = near_counts(words, split)
    placed = cut(
        words.join(near, "word", "left")
        .withColumn("_is", F.coalesce(F.col("best.n") >= times * F.col("n"), F.lit(False)))
        .select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(F.col("_is"), F.col("best.word")).alias("form"), F.when(F.col("_is"), F.col("best.n")).alias("form_n"),
        )
    )
    last = roots(placed.where("form IS NOT NULL").select("word", "form"))
    return placed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13(spark: SparkSession, docs: DataFrame) -> DataFrame:
    bounded_batches(docs)
    words = cut(word_counts(docs, drop=31).where("n >= 2"))
    return group(words)
