"""Packing: tokens of documents into sequences of one length, first-fit decreasing in randomised groups of documents.

A document is cut into full sequences, which need no packing, and a rest. The rests of a group go, longest first, into the
first sequence that has room, which a tournament tree of the sequences' free room finds. Where that leaves much padding (many
rests of an awkward length and few short ones), the loosest sequences are dissolved: their documents fill the others' room,
cut at whole blocks. A group is some thousand documents that a hash picks, so no source or length has one of its own.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import wordspans
from tessera.llm.common import materialize, small_batches

#: Code points beyond ASCII on which all versions of Unicode agree and which normal forms leave alone; and no dotted capital I.
PLAIN = "\t\n\r\x20-\x7e¡-įı-ȳ"
LETTER, DIGIT, OTHER = 1, 2, 3
CLASS = np.full(256, LETTER, np.uint8)  # what begins beyond ASCII is a letter but for what is mended in pre_tokens()
CLASS[:128] = OTHER
CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = LETTER
CLASS[list(b"0123456789")] = DIGIT
CLASS[list(b"\x20\t\n\r")] = wordspans.BLANK
#: After the byte C2: signs but for the letters and numbers of that block.
AFTER_C2 = np.full(256, OTHER, np.uint8)
AFTER_C2[[0xAA, 0xB5, 0xBA]] = LETTER
AFTER_C2[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = DIGIT


class Encoder:
    """Ids of texts as a file of the tokenizers library has them, without begin, end or added special tokens.

    Where the file lower-cases and splits as the public word-end vocabulary does, the pre-tokens of plain texts are found by
    classes of bytes, all of a batch at once, and each distinct one is encoded once by the library's model. Other texts, other
    files and texts with special strings are encoded whole by the library.
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_file(path), most
        self.tok.no_padding()
        self.tok.no_truncation()
        added = [a.content for a in self.tok.get_added_tokens_decoder().values()]
        self.fast = str(self.tok.normalizer).startswith('Sequence(normalizers=[NFC(), Replace(pattern=Regex("\\s+"), content=" "), Lowercase()') and "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in str(self.tok.pre_tokenizer)
        self.odd = "|".join([f"[^{PLAIN}]", *map(re.escape, added)])
        self.spelt = dict(enumerate(_byte_letters()))
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.at = [np.empty(0, np.uint32)], [0]

    def learn(self, words: list[bytes]) -> None:
        """Encodes the words that are not known."""
        new, ids = [w for w in words if w not in self.known], []
        n, spelt, tokenize = self.at[-1], self.spelt, self.tok.model.tokenize
        for w in new:
            self.known[w] = len(self.at) - 1
            got = [t.id for t in tokenize(w.decode("latin-1").translate(spelt))]
            ids += got
            n += len(got)
            self.at.append(n)
        self.ids = [np.concatenate([*self.ids, np.array(ids, np.uint32)])]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin, with the end. Null is empty."""
        texts = texts.cast(pa.string()).fill_null("")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False) if self.fast else np.ones(len(texts), bool)
        whole = self.tok.encode_batch_fast(texts.filter(pa.array(odd)).to_pylist(), add_special_tokens=False)
        whole = [np.array(e.ids, np.uint32) for e in whole]
        if odd.all():
            return np.concatenate([np.empty(0, np.uint32), *whole]), np.concatenate([[0], np.cumsum([len(x) for x in whole], dtype=np.int64)])
        ids, at = self._plain(pc.utf8_lower(pc.if_else(pa.array(odd), "", texts)))
        if not whole:
            return ids, at
        size = np.diff(at)
        size[odd] = [len(x) for x in whole]
        out, end = np.empty(int(size.sum()), np.uint32), np.concatenate([[0], np.cumsum(size)])
        from_plain = np.repeat(~odd, size)
        out[from_plain] = ids
        out[~from_plain] = np.concatenate(whole)
        return out, end

    def _plain(self, lower: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        buf, at = wordspans.bytes_of(lower)
        start, inside = pre_tokens(buf, at)
        number, distinct = wordspans.numbered(buf, inside, start)
        words = distinct.to_pylist()
        if len(self.known) + len(words) > self.most:
            self.forget()
        self.learn(words)
        entry = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[number]
        begin = np.array(self.at, np.int64)
        size = begin[entry + 1] - begin[entry]
        end = np.concatenate([[0], np.cumsum(size)])
        return self.ids[0][np.repeat(begin[entry] - end[:-1], size) + np.arange(end[-1])], end[np.searchsorted(start, at)]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: the byte's own where it is printable, else the next of those from 256 on."""
    own, others = [*range(33, 127), *range(161, 173), *range(174, 256)], iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def pre_tokens(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pre-tokens of lower-cased plain texts start, and which bytes are in one.

    They are English endings after an apostrophe, letters, single digits, and signs.
    """
    kind = CLASS[buf]
    follows = (buf & 0xC0) == 0x80
    for lead, own in ((np.flatnonzero(buf == 0xC2), AFTER_C2), (np.flatnonzero(buf == 0xC3), None)):
        nxt = buf[lead + 1]
        lead, to = (lead, own[nxt]) if own is not None else (lead[(nxt == 0x97) | (nxt == 0xB7)], OTHER)
        kind[lead] = kind[lead + 1] = to
    inside, text = kind != wordspans.BLANK, np.zeros(len(buf) + 1, bool)
    text[at] = True
    start = inside & ~follows
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) | text[1:-1]
    mark = np.flatnonzero((buf == 39) & start)
    b = np.concatenate([buf, np.zeros(3, np.uint8)])
    one, two = b[mark + 1], b[mark + 2]
    last = np.searchsorted(at, mark, side="right")
    room = at[last] - mark
    short = np.isin(one, list(b"stmd")) & (room > 1)
    long = (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)) & (room > 2)
    start[mark[short | long] + 1] = False
    after = np.concatenate([mark[short] + 2, mark[long] + 3])
    after = after[after < len(buf)]
    start[after] = inside[after]
    return np.flatnonzero(start), inside


def joined_crc(parts: list[int], zeros: bytes) -> int:
    """The checksum of byte strings one after the other by their checksums, where all but the first are as long as `zeros`."""
    out, none = parts[0], zlib.crc32(zeros)
    for p in parts[1:]:
        out = p ^ zlib.crc32(zeros, out) ^ none
    return out


class Room:
    """Free room of numbered sequences in a tournament tree: each node has the most room below it."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.most = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Takes that much of the first sequence that has it, and says which."""
        most, k = self.most, 1
        while k < self.leaves:
            k *= 2
            if most[k] < size:
                k += 1
        most[k], found = most[k] - size, k - self.leaves
        while k > 1:
            k >>= 1
            m = max(most[2 * k], most[2 * k + 1])
            if most[k] == m:
                break
            most[k] = m
        return found


def fill(sizes: list[int], capacity: int, block: int, max_padding: float) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (which, start, length) of items of these sizes, none over the capacity.

    First-fit decreasing, ties in the order given. While more than that share would be padding and the other sequences
    have room for all of the loosest one, its pieces fill theirs, the largest room first, cut at multiples of the block.
    """
    room, out = Room(len(sizes), capacity), []
    for i in sorted((i for i, s in enumerate(sizes) if s), key=lambda i: -sizes[i]):
        k = room.first_fit(sizes[i])
        if k == len(out):
            out.append([])
        out[k].append((i, 0, sizes[i]))
    free = [room.most[room.leaves + k] for k in range(len(out))]
    padding, allowed = sum(free), max_padding * sum(sizes)
    blocks = sum(f // block for f in free)
    heap = [(-f, k) for k, f in enumerate(free) if f >= block]
    heapq.heapify(heap)
    for k in sorted(range(len(out)), key=lambda k: (-free[k], k)):
        need = sum(-(-n // block) for _, _, n in out[k])
        if padding <= allowed or blocks - free[k] // block < need:
            break
        blocks -= free[k] // block
        for i, start, n in out[k]:
            while n:
                f, j = heapq.heappop(heap)
                if j == k or not out[j] or -f != free[j]:
                    continue
                take = n if n <= free[j] else free[j] // block * block
                out[j].append((i, start, take))
                blocks -= free[j] // block - (free[j] - take) // block
                free[j] -= take
                start, n = start + take, n - take
                if free[j] >= block:
                    heapq.heappush(heap, (-free[j], j))
        out[k], free[k] = [], 0
        padding -= capacity
    return [x for x in out if x]


def _tokenized(path: str, end: int, capacity: int, block: int, kind: str, keep_ids: bool) -> tuple[Callable, str]:
    """Rows of a document's number and checksums: of its full sequences, and of the blocks of its rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, number = Encoder(path), TaskContext.get().partitionId() << 33
        for b in wordspans.pieces(batches, 0, 1 << 21):
            ids, at = enc.encode(b.column(0))
            full, rest, fat, rat, lists = [], [], [0], [0], []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = np.append(ids[i:j], np.uint32(end)).astype("<u4")
                data, cut = own.tobytes(), len(own) // capacity * capacity * 4
                full += [zlib.crc32(data[k : k + 4 * capacity]) for k in range(0, cut, 4 * capacity)]
                rest += [zlib.crc32(data[k : k + 4 * block]) for k in range(cut, len(data), 4 * block)]
                fat.append(len(full))
                rat.append(len(rest))
                lists += [own] if keep_ids else []
            of = lambda x, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int64()))
            cols = [pa.array(np.arange(number, number + b.num_rows)), b.column(1), pa.array(at[1:] - at[:-1] + 1), of(full, fat), of(rest, rat)]
            names = ["row_no", "id", "n", "full", "rest"]
            if keep_ids:
                cols.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)
            number += b.num_rows

    return run, f"row_no long, id {kind}, n long, full array<long>, rest array<long>" + ", ids array<int>" * keep_ids


def _packed(capacity: int, block: int, max_padding: float) -> Callable[[pa.Table], pa.Table]:
    """The pieces of a group."""
    zeros = bytes(4 * block)

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("row_no")
        group, n, full, rest = t.column("g")[0].as_py() << 32, t.column("n").to_pylist(), t.column("full").to_pylist(), t.column("rest").to_pylist()
        rows, seq = [], group
        for i, crcs in enumerate(full):
            for k, c in enumerate(crcs):
                rows.append((i, k * capacity, capacity, c, seq, 0))
                seq += 1
        for pieces in fill([x % capacity for x in n], capacity, block, max_padding):
            offset = 0
            for i, start, size in pieces:
                c = rest[i][start // block : -(-(start + size) // block)]
                tail = size % block or block  # the last block may be a part
                crc = joined_crc(c[:-1], zeros) if len(c) > 1 else c[0]
                if len(c) > 1:
                    last = bytes(4 * tail)
                    crc = c[-1] ^ zlib.crc32(last, crc) ^ zlib.crc32(last)
                rows.append((i, len(full[i]) * capacity + start, size, crc, seq, offset))
                offset += size
            seq += 1
        i, *cols = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        return pa.Table.from_arrays([t.column("row_no").take(i), t.column("id").take(i), *map(pa.array, cols), t.column("n").take(i)], names=["row_no", "id", "start", "length", "ids_crc32", "sequence_id", "offset", "doc_tokens"])

    return pack


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end: int = 2, group: int = 4096, block: int = 64, max_padding: float = 0.005, ids: bool = False
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece of each document; with `ids` also its ids.

    A document is its ids by the tokenizer file at `path` and then the id `end`. Each id is in exactly one piece; pieces
    of a sequence lie one after the other from 0. Documents of up to the capacity are cut only where padding would be more than
    `max_padding` of a group, at multiples of `block` ids. `group` is the mean number of documents in a group.

    Null and empty texts are the end alone. Repeated rows, ids that are null or equal are documents of their own: the rows
    of the written table of lengths are numbered and the numbers are dealt, so reruns and lost tasks see the same groups. Of equal
    lengths the lower row number goes first. An empty table has no pieces; other columns are not read. A text of any length is encoded whole,
    its full sequences are never gathered.
    """
    if capacity % block:
        raise ValueError("the capacity must be a multiple of the block")
    small_batches(docs.sparkSession)
    chosen = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    rows = materialize(chosen.mapInArrow(*_tokenized(path, end, capacity, block, chosen.schema["id"].dataType.simpleString(), ids)), "tokenized")
    groups = max(1, -(-rows.count() // group))
    dealt = rows.select("row_no", "id", "n", "full", "rest", F.pmod(F.xxhash64("row_no"), F.lit(groups)).alias("g"))
    kind = chosen.schema["id"].dataType.simpleString()
    out = dealt.groupBy("g").applyInArrow(_packed(capacity, block, max_padding), f"row_no long, id {kind}, start long, length long, ids_crc32 long, sequence_id long, offset long, doc_tokens long")
    if ids:
        out = out.join(rows.select("row_no", F.col("ids").alias("all")), "row_no").withColumn("ids", F.slice("all", (F.col("start") + 1).cast("int"), F.col("length").cast("int")))
    return out.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * ids)
