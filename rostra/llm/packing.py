"""Cost-balanced packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import heapq
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._words import SMALL_SLICE, Words, as_bytes, byte_table, give_back, slices, tidy

CAPACITY, END_ID = 4096, 2
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n (attention looks at pairs within a piece).
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Tokens that one round of packing holds at most, before it starts new sequences.
WINDOW = 2 << 20
#: Words whose ids a worker remembers.
MEMORY = 400_000
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"

_PLAIN = regex.compile(r"[!-~À-ɏ]+")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

class WordTokenizer:
    """Ids of words by a tokenizer that never joins characters across white space. A word is encoded once while remembered;
    words of plain letters and marks go to the model piece by piece, all others through the whole tokenizer."""

    def __init__(self, path: str):
        import unicodedata

        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.as_seen = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.normal = lambda w: unicodedata.is_normalized("NFC", w)
        self.forget()

    def forget(self) -> None:
        self.places: dict[bytes, int] = {}  # word to place and number of its ids in self.ids
        self.pieces: dict[str, list[int]] = {}
        self.ids = array("I")

    def piece(self, piece: str) -> list[int]:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.pieces[piece] = self.direct(piece)
        return ids

    def direct(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece if piece.isascii() else self.as_seen(piece)[0][0])]

    def word(self, word: bytes) -> list[int]:
        if word.isalpha() and word.islower():  # ASCII letters
            return [t.id for t in self.model.tokenize(word.decode())]
        text = word.decode()
        if "<|" in text or not _PLAIN.fullmatch(text) or not self.normal(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        found = _PIECES.findall(text.lower())
        return self.direct(found[0]) if len(found) == 1 else [i for p in found for i in self.piece(p)]

    def encode(self, vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All remembered ids, and each word's first place and number."""
        if len(self.places) + len(self.pieces) > MEMORY:
            self.forget()
        places, known, ids = [], self.places, self.ids
        for w in vocabulary:
            at = known.get(w)
            if at is None:
                found = self.word(w)
                at = known[w] = len(ids) << 24 | len(found)
                ids.extend(found)
            places.append(at)
        where = np.array(places, np.int64)
        return np.frombuffer(ids, np.uint32) if len(ids) else np.empty(0, np.uint32), where >> 24, where & 0xFFFFFF


#: Where words split into letters, digits (one by one) and marks, for texts of which plain_texts() is sure.
_KINDS = np.array([0 if 48 <= b <= 57 else 1 if 97 <= b <= 122 or b >= 128 else 2 for b in range(256)], np.uint8)
_ODD = byte_table(lambda b: (b < 32 and not 9 <= b <= 13) or b in (0x27, 0x7F) or b >= 0xC9)


def plain_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have only ASCII without apostrophes, control characters and `<|`, and Latin letters up to U+023F but for
    the dotted capital I: in these, words split at changes of kind, letter by letter as the tokenizer does."""
    after = np.append(data[1:], np.uint8(0))
    odd = _ODD[data] | ((data == 0xC2) & (after < 0xC0)) | ((data == 0xC3) & ((after == 0x97) | (after == 0xB7))) | ((data == 0xC4) & (after == 0xB0)) | ((data == 0x3C) & (after == 0x7C))
    upto = np.concatenate([[0], np.cumsum(odd)])
    return upto[offsets[1:]] == upto[offsets[:-1]]


def encode_texts(tokenizer: WordTokenizer, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The ids of each text, END_ID last."""
    plain = plain_texts(data, offsets)
    size = np.diff(offsets)
    out: list[np.ndarray | None] = [None] * len(size)
    for kind, lower, kinds in ((True, True, _KINDS), (False, False, None)):
        which = np.flatnonzero(plain == kind)
        if not len(which):
            continue
        part = data if len(which) == len(size) else data[np.repeat(plain == kind, size)]
        words = Words(part, np.concatenate([[0], np.cumsum(size[which])]), lower=lower, kinds=kinds)
        ids, begin, length = tokenizer.encode(words.vocabulary)
        begin, length = begin[words.codes], length[words.codes]
        upto = np.concatenate([[0], np.cumsum(length)])
        flat = ids[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], length)]
        del ids  # so that the array can grow again
        cut = upto[words.bounds]
        for i, d in enumerate(which.tolist()):
            out[d] = np.append(flat[cut[i] : cut[i + 1]], np.uint32(END_ID))
    return out


def cost(length: float) -> float:
    return LINEAR * length + QUADRATIC * length * length


def pack(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray]:
    """Pieces (document, start, length, sequence, offset) and each sequence's cost.

    Documents of `capacity` or more give full sequences and a remainder. What is left goes, longest first, whole into the
    lowest-cost sequence with room for it; where no sequence has room for all of it, it is cut to the room of the
    lowest-cost open one. There are as few sequences as the tokens need, so all but the shortfall of one is filled.
    """
    pieces, heap, full = [], [], 0
    for d, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            pieces.append((d, start, capacity, full, 0))
            full += 1
        if n % capacity:
            heap.append((-(n % capacity), d, n - n % capacity))
    heapq.heapify(heap)
    tokens = -sum(h[0] for h in heap)
    k = -(-tokens // capacity)
    room = np.full(k, capacity, np.int64)
    if k:
        room[-1] = tokens - (k - 1) * capacity  # the last one is the only one with padding
    total = room.copy()
    costs = np.concatenate([np.full(full, cost(capacity)), np.zeros(k)])
    open_costs = costs[full:]
    while heap:
        n, d, start = heapq.heappop(heap)
        n = -n
        fits = room >= n
        where = int(np.argmin(np.where(fits if fits.any() else room > 0, open_costs, np.inf)))
        take = min(n, int(room[where]))
        pieces.append((d, start, take, full + where, int(total[where] - room[where])))
        room[where] -= take
        open_costs[where] += cost(take)
        if take < n:
            heapq.heappush(heap, (-(n - take), d, start + take))
    return pieces, costs


def pack_batches(tokenizer_path: str, capacity: int, window: int):
    def run(batches):
        from pyspark import TaskContext

        tokenizer = WordTokenizer(tokenizer_path)
        context = TaskContext.get()
        next_id = (context.partitionId() if context else 0) << 40
        ids, docs, held = [], [], 0

        def flush():
            nonlocal next_id
            pieces, costs = pack([len(x) for x in ids], capacity)
            crc = [zlib.crc32(ids[d][s : s + n].tobytes()) for d, s, n, _, _ in pieces]
            d, start, length, seq, offset = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
            doc_ids = pa.array(docs, pa.int64()).take(pa.array(d))
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))[d]
            out = [doc_ids, start, length, np.array(crc, np.int64), sizes, seq + next_id, offset, costs[seq]]
            next_id += len(costs)
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names=[f.split()[0] for f in PIECE_SCHEMA.split(", ")])

        for batch in batches:
            data, offsets = as_bytes(batch.column(1))
            names = batch.column(0).to_pylist()
            for first, part, cuts in slices(data, offsets, SMALL_SLICE):
                encoded = encode_texts(tokenizer, part, cuts)
                give_back()
                for k, x in enumerate(encoded):
                    if held and held + len(x) > window:
                        yield flush()
                        ids.clear()
                        docs.clear()
                        held = 0
                    ids.append(x)
                    docs.append(names[first + k])
                    held += len(x)
        if ids:
            yield flush()

    return run


def packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, capacity: int = CAPACITY, window: int = WINDOW) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens, balancing estimated training cost.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost (of the sequence).
    Each task packs what it reads in windows of at most `window` tokens (a longer document is a window of its own), so
    nothing is shuffled and memory is bounded by the window and one document; a window ends with at most one sequence that
    is not full. Null and empty texts have the end id only. Rows stay apart even if repeated; a null doc_id stays null.
    Other columns are not read. An empty table gives an empty result. sequence_id follows from the table's split into
    tasks, so a task that runs again gives the same rows.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    from pyspark.sql import functions as F

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(pack_batches(tokenizer_path, capacity, window)), PIECE_SCHEMA)
