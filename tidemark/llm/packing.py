"""Packing of tokenised documents into sequences by best-two-fit.

Texts are tokenised once, where they are read; only a few numbers per piece are shuffled. Pieces are dealt by hash into
groups of bounded size, and each group is packed in one task: a bin is filled greedily with the longest piece that fits,
then its smallest piece is given up if two unpacked pieces fill the wider gap more tightly.
"""

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import by_batch, materialised

LENGTH = 1024
END = 2
#: Pieces that one task packs; about one sequence in each group stays partly empty.
GROUP = 50_000
CACHE = 400_000
SPECIAL = "<|endoftext|>"
#: The last letter of the Latin blocks; chunks with letters beyond it are left to the tokenizer itself.
LATIN = "\u024f"
_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("repeat", pa.int64())])
_PLACED = pa.schema([*list(_PIECES)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit integers, just as the tokenizer file gives them.

    Byte-level pre-tokenizing always starts a token at a space that a character other than white space follows, so a text
    is a sequence of chunks cut before such spaces, and chunks met before are looked up. A new chunk is encoded with the
    rank file of the same vocabulary, which is faster for short strings. Texts with other white space after a space, or
    with the string of the special token, go to the tokenizer whole; chunks with letters beyond Latin one by one.
    """

    def __init__(self, tokenizer: str, ranks: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(tokenizer)
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.quick = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.known: dict[str, bytes | None] = {}

    def _exact(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _short(self, text: str) -> bytes:
        if max(text) > LATIN:
            return self._exact(text)
        return np.array(self.quick.encode_ordinary(text), dtype="<u4").tobytes()

    def _learn(self, parts: list[str]) -> None:
        if len(self.known) > CACHE:
            self.known.clear()
        for part in parts:
            if part not in self.known:
                odd = not part or part[0].isspace() or SPECIAL in part
                self.known[part] = None if odd else self._short(" " + part)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, *parts = text.split(" ")
        known = self.known
        try:
            found = [known[p] for p in parts]
        except KeyError:
            self._learn(parts)
            found = [known[p] for p in parts]
        if None in found or SPECIAL in first:
            return self._exact(text)
        return (self._short(first) if first else b"") + b"".join(found)


@lru_cache(maxsize=2)
def encoder(tokenizer: str, ranks: str) -> Encoder:
    return Encoder(tokenizer, ranks)


def cuts(total: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a first one with the rest."""
    first = total if total <= length else (total % length or length)
    return [(0, first)] + [(start, length) for start in range(first, total, length)]


def pieces(docs: DataFrame, tokenizer: str, ranks: str, length: int = LENGTH) -> DataFrame:
    """The pieces of docs(doc_id, text); ``repeat`` numbers the rows that share a doc_id within a batch."""
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode, rows, met = encoder(tokenizer, ranks).encode, [], {}
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            doc_id = doc_id.as_py()
            ids = encode(text.as_py() or "") + END.to_bytes(4, "little")
            repeat = met[doc_id] = met.get(doc_id, -1) + 1
            for k, (start, n) in enumerate(cuts(len(ids) // 4, length)):
                rows.append((doc_id, k, start, n, zlib.crc32(ids[4 * start:4 * (start + n)]), repeat))
        columns = zip(*rows) if rows else [[] for _ in _PIECES]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _PIECES)], schema=_PIECES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        by_batch(make, _PIECES), "doc_id long, piece int, start long, length long, ids_crc32 long, repeat long")


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in lengths, none over the capacity."""
    pool: dict[int, list[int]] = {}
    for at, n in enumerate(lengths):
        pool.setdefault(n, []).append(at)
    present = sum(1 << n for n in pool)

    def largest(limit: int) -> int:
        return (present & ((1 << (limit + 1)) - 1)).bit_length() - 1

    def take(n: int) -> int:
        nonlocal present
        at = pool[n].pop()
        if not pool[n]:
            present ^= 1 << n
        return at

    def put(n: int, at: int) -> None:
        nonlocal present
        pool[n].append(at)
        present |= 1 << n

    def two(low: int, room: int) -> tuple[int, int] | None:
        """The two lengths with the largest sum over low and up to room."""
        best, chosen, a = low, None, largest(room - 1)
        while a > 0 and 2 * a > best:
            b = largest(min(a, room - a))
            if b == a and len(pool[a]) < 2:
                b = largest(a - 1)
            if b > 0 and a + b > best:
                best, chosen = a + b, (a, b)
                if best == room:
                    break
            a = largest(a - 1)
        return chosen

    bins = []
    while present:
        inside, gap = [], capacity
        while gap > 0 and (n := largest(gap)) > 0:
            inside.append((n, take(n)))
            gap -= n
        if gap > 0 and len(inside) > 1 and present:
            smallest = inside[-1]
            found = two(smallest[0], gap + smallest[0])
            if found:
                inside[-1:] = [(n, take(n)) for n in found]
                put(*smallest)
        bins.append([at for _, at in inside])
    return bins


def pack(docs: DataFrame, tokenizer: str, ranks: str, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of docs(doc_id, text).

    A null text is empty and has only the end token; a null doc_id is kept; repeated rows are packed each for itself,
    with pieces that look alike; other columns are ignored. An empty table gives an empty result.
    """
    cut = materialised(pieces(docs, tokenizer, ranks, length), "pieces")
    groups = max(1, -(-cut.count() // group))

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("repeat", "ascending")])
        lengths = rows.column("length").to_pylist()
        base = (rows.column("lot")[0].as_py() if lengths else 0) << 32
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        for k, inside in enumerate(best_two_fit(lengths, length)):
            at = 0
            for i in inside:
                sequence[i], offset[i], at = base + k, at, at + lengths[i]
        found = rows.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return pa.Table.from_arrays([*found.columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], schema=_PLACED)

    lot = F.pmod(F.xxhash64("doc_id", "piece", "repeat"), F.lit(groups))
    return cut.withColumn("lot", lot).groupBy("lot").applyInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
