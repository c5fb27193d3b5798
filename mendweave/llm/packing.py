"""Best-fit packing planned on a histogram of lengths.

Texts are tokenized and cut into pieces of a sequence's size at most. Best-fit decreasing runs on the driver over the
numbers of pieces of each length, which are as many as a sequence has tokens whatever the corpus holds. It gives planned
slots: so many pieces of a length, from a rank on, go to consecutive sequences at an offset. Pieces take their slots by a
join on length and rank. Each task ranks the pieces that it cuts, length by length, and the ranks of the tasks before are
added, so neither a length that many pieces share nor an id, null or repeated, gathers rows in one task.

Defined results: null and empty texts are one piece that holds the end token alone. Repeated rows are packed as often as
they occur; rows with a null id too. Texts of any length are cut, none is left out. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import carried, equal_words, field, kept, pieces, read, saved, share_path, strings, tidied, word_spans

CAPACITY = 4096
END = 1
TOKENIZER = "word_bpe_49k.json"
#: Bytes of words, their ids and the entries themselves that a worker remembers, in two generations.
REMEMBERED = 64 << 20
#: Bytes that an entry takes besides the word and its ids.
ENTRY = 200
#: Bytes of text that are encoded at a time.
CHUNK = 1 << 20
#: Rows of the plan that are broadcast at most; a longer one is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: The task that cut a piece, and the piece's rank among those of its length there.
TASK, RANK = "__task", "__rank"


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(97, 123)]] = True
#: ASCII letters and the bytes of non-ASCII characters up to U+00FF, of which ``learn`` checks that they make letters.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), 0xC3, *range(0x80, 0xC0)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def parted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 texts with A-Z lower-cased and a space between a letter or digit and a sign that follows it; their offsets.

    The tokenizer lower-cases too, its pattern has a border there, and white space is dropped, so the ids stay. Letters
    are told among ASCII and the Latin letters U+00C0 to U+00FF; elsewhere no space is set.
    """
    text = _LOWER[data]
    if len(text) < 2:
        return text, offsets
    letter = _ALNUM[text]
    letter[1:] |= (text[:-1] == 0xC3) & (text[1:] >= 0x80) & (text[1:] != 0x97) & (text[1:] != 0xB7)
    at = np.flatnonzero(letter[:-1] & _SIGN[text[1:]]) + 1
    return np.insert(text, at, 32), offsets + np.searchsorted(at, offsets)


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes, remembered by word.

    No rule of the tokenizer reaches over white space: its pattern splits there, and neither its normalisation nor its
    merges look beyond. So the ids of a text are those of its parts between ASCII spaces, one after the other.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0  # bytes of ``known``

    def learn(self, plain: list[bytes], rest: list[bytes]) -> None:
        """Words are encoded as one text with spaces between.

        The pattern keeps a word of letters whole, and its last token is one that ends words; of other words a token belongs
        to the word that its place lies in.
        """
        for lo in range(0, len(plain), 1000):
            part = plain[lo : lo + 1000]
            ids = np.array(self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):
                self._place(part)
            else:
                self._keep(part, ids, [0, *(4 * stops).tolist()])
        for lo in range(0, len(rest), 1000):
            self._place(rest[lo : lo + 1000])

    def _place(self, part: list[bytes]) -> None:
        texts = [w.decode() for w in part]
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        at = np.fromiter((o[0] for o in found.offsets), np.int64, len(found.ids))
        starts = np.concatenate(([0], np.cumsum([len(w) + 1 for w in texts])))
        self._keep(part, np.array(found.ids, "<u4"), (4 * np.searchsorted(at, starts)).tolist())

    def _keep(self, part: list[bytes], ids: np.ndarray, cuts: list[int]) -> None:
        body = ids.tobytes()
        self.known.update(zip(part, [body[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))
        self.held += len(body) + sum(map(len, part)) + ENTRY * len(part)

    def whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and each text's range among them. Each word is looked up once."""
        text, off = parted(data, offsets)
        starts, stops, bounds = word_spans(text, off)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        first, back = equal_words(text, starts, stops)
        body = text.tobytes()
        words = [body[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)]
        if 2 * self.held > REMEMBERED:
            self.known, self.older, self.held = {}, self.known, 0
        found = list(map(self.known.get, words))
        if None in found:
            odd = np.concatenate(([0], np.cumsum(~_LETTER[text], dtype=np.int32)))
            plain = (odd[stops] == odd[starts])[first].tolist()
            new: tuple[list, list] = ([], [])
            for w, x, p in zip(words, found, plain, strict=True):
                if x is None:
                    old = self.older.get(w)
                    if old is None:
                        new[not p].append(w)
                    else:
                        self.known[w] = old
                        self.held += ENTRY + len(w) + len(old)
            self.learn(*new)
            found = list(map(self.known.__getitem__, words))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, begins = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        own = sizes[back]
        total = np.concatenate(([0], np.cumsum(own)))
        return flat[np.repeat(begins[back] - total[:-1], own) + np.arange(total[-1])], total[bounds]


def encoder_of(path: str) -> Encoder:
    """The encoder that this worker's tasks share."""
    return kept("encoders").get(path) or kept("encoders").setdefault(path, Encoder(path))


def _pieces(path: str, columns: list[str], text_col: str, size: int, end: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        tail, step = np.array([end], "<u4").tobytes(), 4 * size
        task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            data, offsets = strings(batch.column(text_col))
            for lo, hi in pieces(offsets, CHUNK):
                row, piece, start, length, crc, rank, each = [], [], [], [], [], [], []
                own, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                every, bounds = encoder.encode(own, off)
                special = b"<|" in own.tobytes()
                for i in range(lo, hi):
                    ids = every[bounds[i - lo] : bounds[i - lo + 1]].tobytes()
                    if special and b"<|" in (text := own[off[i - lo] : off[i - lo + 1]].tobytes()):
                        ids = encoder.whole(text)  # special tokens are told by their case and signs
                    ids += tail
                    for k in range(0, len(ids), step):
                        part = ids[k : k + step]
                        n = len(part) // 4
                        row.append(i)
                        piece.append(k // step)
                        start.append(k // 4)
                        length.append(n)
                        crc.append(zlib.crc32(part))
                        rank.append(int(seen[n]))
                        seen[n] += 1
                        if keep_ids:
                            each.append(np.frombuffer(part, "<u4").astype(np.int32))
                taken = [batch.column(c).take(pa.array(row, pa.int64())) for c in columns]
                out = [*taken, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array(np.full(len(row), task, np.int32)), pa.array(rank, pa.int64())]
                names = [*columns, "piece", "start", "length", "ids_crc32", TASK, RANK]
                if keep_ids:
                    out.append(pa.array(each, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def cut(docs: DataFrame, path: str, carry: list[str], text_col: str = "text", size: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: ``carry``, piece, start, length, ids_crc32, the task that cut it and its rank among those of its
    length there and, if asked for, ids."""
    share_path(docs.sparkSession)
    carry = carried(carry, "piece", "start", "length", "ids_crc32", "ids", TASK, RANK)
    schema = ", ".join([*(field(docs, c) for c in carry), f"piece int, start bigint, length bigint, ids_crc32 bigint, {TASK} int, {RANK} bigint", *(["ids array<int>"] if keep_ids else [])])
    return docs.select(*dict.fromkeys([*carry, text_col])).mapInArrow(tidied(_pieces(path, carry, text_col, size, end, keep_ids), "encoders"), schema)


def plan(counts: dict[int, int], size: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over numbers of pieces: (length, first rank, number, first sequence, offset).

    Of equal lengths, the open sequence with the least room that is enough takes as many as it holds, then the next.
    """
    out, rooms, open_, used = [], [], {}, 0

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_:
                bisect.insort(rooms, room)
                open_[room] = []
            open_[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(k)
            else:
                room, first = size, used
                n = -(-left // (size // length))
                used += n
            each = min(room // length, left)
            bins = min(n, left // each)
            for j in range(each):
                out.append((length, rank, bins, first, size - room + j * length))
                rank += bins
            left -= each * bins
            if bins < n and room == size and first + n == used:  # sequences that were opened for a rest
                used -= n - bins
                n = bins
            leave(room, first + bins, n - bins)
            leave(room - each * length, first, bins)
    return out


def pack(cut_pieces: DataFrame, size: int = CAPACITY) -> DataFrame:
    """The pieces (of ``cut``, written down before, as tasks and ranks must not change) with sequence_id and offset."""
    spark = cut_pieces.sparkSession
    sizes = cut_pieces.groupBy("length", TASK).agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # ``size`` rows at most
    rows = plan(counts, size)
    slots = spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], "length bigint, first bigint, n bigint, sequence bigint, offset bigint")
    if len(rows) <= BROADCAST_ROWS:
        slots = F.broadcast(slots)
    before = F.sum("n").over(Window.partitionBy("length").orderBy(TASK).rowsBetween(Window.unboundedPreceding, -1))  # a row a task
    base = sizes.select("length", TASK, F.coalesce(before, F.lit(0)).alias("base"))
    ranked = cut_pieces.join(base, ["length", TASK]).withColumn("rank", F.col("base") + F.col(RANK))
    ranked, slots = ranked.alias("p"), slots.alias("s")
    on = (F.col("p.length") == F.col("s.length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    placed = ranked.join(slots, on)
    return placed.select(*(F.col(f"p.{c}") for c in cut_pieces.columns if c not in (TASK, RANK)), (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), F.col("s.offset").alias("offset"))


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = CAPACITY, end: int = END) -> DataFrame:
    return pack(saved(cut(docs, path, [id_col], text_col, size, end)), size)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op10_packing": op10_packing}
