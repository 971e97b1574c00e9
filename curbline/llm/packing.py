"""Best-fit packing of tokenized documents under several capacities.

A document becomes its token ids and an end mark; one longer than a sequence is
cut into full pieces, its first piece the shorter. Full pieces are sequences of
their own. The others are dealt by hash into groups of about GROUP pieces, and
each group is packed by vector best fit, longest piece first: of the sequences
with room in tokens, documents and attention cost (the sum of squared lengths),
the one with the smallest weighted norm of what would be left, or the largest
weighted dot product of need and room, takes the piece.

Defined results: a null text is the empty one, a piece of the end mark alone; a
repeated row is packed again; a null id is kept; an empty table gives no piece;
extra columns are not read.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.llm.common import bounded_batches, tidy, whole
from curbline.llm.text_arrays import Words, parts
from curbline.session import cut

END = 2
#: Pieces shorter than a sequence in one packing group, about.
GROUP = 8_192
#: Words whose ids a worker remembers, at most.
REMEMBERED = 200_000

_L = "A-Za-zÀ-ÖØ-öø-ſ"
_S = r"\t\n\x0b\x0c\r "
#: Texts of these characters alone are split below; others go through the tokenizer whole.
_PLAIN = rf"[{_S}!-~À-ÖØ-öø-ſ]*"
_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[0x21:0x7F] = _OTHER
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[0x30:0x3A] = _DIGIT
for _a, _b in ((0x41, 0x5B), (0x61, 0x7B), (0x80, 0xC0), (0xC3, 0xC6)):  # ASCII, and U+00C0 to U+017F in two bytes
    _KIND[_a:_b] = _LETTER
#: Endings that the byte-level BPE splits off after an apostrophe.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def split_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the byte-level BPE's words start in plain texts laid end to end.

    Runs of letters, of digits and of other marks are words, with one blank
    before them; other white space is a word up to its last character, which is
    a word of its own unless it is that blank; an apostrophe takes its ending.
    """
    n = len(data)
    kind = _KIND[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = edge[:-1].copy()
    first[1:] |= kind[1:] != kind[:-1]  # a run starts here
    space = kind == _SPACE
    starts = first.copy()
    run = np.flatnonzero(first & ~space & ~edge[:-1])
    run = run[space[run - 1]]  # runs right after white space of the same text
    starts[run - 1] = True
    starts[run[data[run - 1] == 0x20]] = False
    quote = np.flatnonzero(first & (data == 0x27))
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == _LETTER) & ~edge[quote + 1]]
    blank = (quote > 0) & ~edge[quote] & (data[quote - 1] == 0x20)
    quote = quote[~blank]
    if len(quote):
        ahead = np.concatenate([data, np.zeros(4, np.uint8)])
        same = np.concatenate([~edge[:-1] & (kind == _LETTER), np.zeros(4, bool)])
        for ending in _ENDINGS:
            hit = np.ones(len(quote), bool)
            for k, c in enumerate(ending.encode(), 1):
                hit &= (ahead[quote + k] == c) & same[quote + k]
            at = quote[hit]
            starts[at + 1] = False
            after = at + 1 + len(ending)
            starts[after[same[after]]] = True
    return np.flatnonzero(starts)


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence, and the weight of each in the choice of a sequence.

    The defaults of documents and cost cannot bind before tokens do.
    """

    tokens: int = 1024
    documents: int = 1024
    cost: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    by: str = "norm"  # or "dot"


def _shown_bytes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from 256."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Token ids of texts, equal to the tokenizer's."""

    def __init__(self, path: str):
        import re

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.plain = re.compile(_PLAIN)
        # The same vocabulary, applied to one split word at a time.
        shown = _shown_bytes()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(shown[c] for c in t): i for t, i in self.tokenizer.get_vocab().items() if t not in special}
        self.merge = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.words = Words()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}  # hash of a word -> its place
        self.ids, self.n_ids = np.zeros(1 << 20, np.uint32), 0
        self.at, self.size = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def _learn(self, word: bytes) -> int:
        ids, place = self.merge(word.decode()), len(self.known)
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        if place == len(self.at):
            self.at, self.size = [np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size)]
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.at[place], self.size[place] = self.n_ids, len(ids)
        self.n_ids += len(ids)
        return place

    def _plain_ids(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each of several plain texts: each different word is looked up once."""
        starts = split_words(data, offsets)
        ends = np.append(starts[1:], len(data))
        hashes = self.words.hashes(data, starts, ends) + (ends - starts).astype(np.uint64)
        different, example, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._forget()
        known = self.known
        places = [known.get(h, -1) for h in different.tolist()]
        places = np.array(places, np.int64)
        for k in np.flatnonzero(places < 0):
            e = example[k]
            place = self._learn(data[starts[e] : ends[e]].tobytes())
            known[int(different[k])] = places[k] = place
        place = places[back]
        size = self.size[place]
        upto = np.cumsum(size)
        ids = self.ids[np.repeat(self.at[place] - upto + size, size) + np.arange(upto[-1])] if len(upto) else self.ids[:0]
        words_before = np.searchsorted(starts, offsets)
        ids_before = np.concatenate([[0], upto])[words_before]
        return [ids[a:b] for a, b in zip(ids_before[:-1], ids_before[1:])]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text in turn."""
        for a, b, data, offsets in parts(column, 1 << 20):
            texts = [column[i].as_py() for i in range(a, b)]
            plain = [bool(self.plain.fullmatch(t)) for t in texts]
            if all(plain):
                yield from self._plain_ids(data, offsets)
            else:
                for k, t in enumerate(texts):
                    part = data[offsets[k] : offsets[k + 1]]
                    yield self._plain_ids(part, np.array([0, len(part)]))[0] if plain[k] and t else self.whole(t)


def encoder(path: str) -> Encoder:
    """One encoder for each worker process; task code is pickled by value, so module globals end with the task."""
    kept = vars(sys).setdefault("_curbline_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def pieces(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", limit: int = 1024, with_ids: bool = False) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` of every piece, and the ids' bytes if asked for."""
    kind = docs.schema[id].dataType.simpleString()
    bounded_batches(docs)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        mark = np.array([END], "<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, got in enumerate(encode(batch.column("_text"))):
                tokens = got.astype("<u4").tobytes() + mark
                n = len(tokens) // 4
                end = (n - 1) % limit + 1
                at = k = 0
                while at < n:
                    part = tokens[4 * at : 4 * end]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(end - at)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
                    at, end, k = end, end + limit, k + 1
            arrays = [
                batch.column("_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
            ]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")
    return docs.select(F.col(id).alias("_id"), whole(text).alias("_text")).mapInArrow(tidy(cut_up), schema).withColumnRenamed("id", id)


def best_fit(lengths: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece."""
    caps = np.array([limits.tokens, limits.documents, limits.cost], float)
    scale = np.array(limits.weights) / caps**2
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room = np.empty((3, len(lengths)))  # of sequences that could still take the shortest piece
    name = np.empty(len(lengths), np.int64)
    live = n = 0
    least = float(lengths.min(initial=limits.tokens))
    least = (least, 1.0, least**2)
    for i in np.argsort(-lengths, kind="stable"):
        size = float(lengths[i])
        need = (size, 1.0, size * size)
        if any(d > c for d, c in zip(need, caps)):
            raise ValueError(f"a piece of {lengths[i]} tokens is over the limits")
        best = -1
        if live:
            fits = np.flatnonzero(room[0, :live] >= size)
            if len(fits):
                left = room[:, fits]
                ok = (left[1] >= 1.0) & (left[2] >= need[2])
                if not ok.all():
                    fits, left = fits[ok], left[:, ok]
            if len(fits):
                if limits.by == "dot":
                    best = fits[sum(s * d * r for s, d, r in zip(scale, need, left)).argmax()]
                else:
                    best = fits[sum(s * (r - d) ** 2 for s, d, r in zip(scale, need, left)).argmin()]
        if best < 0:
            best, live = live, live + 1
            room[:, best], name[best] = caps, n
            n += 1
        bins[i], offsets[i] = name[best], limits.tokens - room[0, best]
        for k in range(3):
            room[k, best] -= need[k]
        if any(room[k, best] < least[k] for k in range(3)):  # the last live one takes its place
            live -= 1
            room[:, best], name[best] = room[:, live], name[live]
    return bins, offsets


def pack(cut_pieces: DataFrame, limits: Limits = Limits(), group: int = GROUP) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have a ``length``."""
    rows = cut(cut_pieces.withColumn("_row", F.monotonically_increasing_id()))
    full, part = rows.where(F.col("length") == limits.tokens), rows.where(F.col("length") < limits.tokens)
    if (limits.documents, limits.cost) < (1, limits.tokens**2) or limits.cost < limits.tokens**2:
        full, part = rows.limit(0), rows
    groups = max(1, -(-part.count() // group))
    settings = astuple(limits)

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by("_row")
        lengths, row = table.column("length").to_numpy(), table.column("_row").to_numpy()
        bins, offsets = best_fit(lengths, Limits(*settings))
        first = np.full(bins.max(initial=-1) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, bins, row)  # a sequence is named by the least of its rows
        table = table.drop_columns(["_group"])
        return table.append_column("sequence_id", pa.array(first[bins])).append_column("offset", pa.array(offsets))

    dealt = part.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id bigint, offset bigint"
    packed = dealt.groupBy("_group").applyInArrow(fill, schema)
    alone = full.withColumn("sequence_id", F.col("_row")).withColumn("offset", F.lit(0).cast("bigint"))
    return alone.unionByName(packed).drop("_row")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return pack(pieces(docs, vocabulary()))
