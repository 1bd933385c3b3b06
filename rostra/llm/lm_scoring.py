"""LM scoring with an Elias-Fano n-gram trie in memory-mapped shards, asked by the tasks that hold the texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import ASKED, Keeper, answered, asked, by_shard, distinct, pack, per_slice, read_arrays, remove_file, shuffles_removed, steps, text_bytes, unpack, write_arrays
from ._shared import fresh_path, remove, written
from ._words import Words, as_bytes, mix64, slices
from .elias_fano import EliasFano
from .quality_classifier import held_out

#: Words of an n-gram at most. The code takes any number from 2 on; questions and shards grow with it.
ORDER, ADD = 3, 0.1
#: A context seen c times gives SPREAD * c ** GROWTH to the shorter context (Dirichlet smoothing, its mass grows as a context's
#: number of distinct followers does).
SPREAD, GROWTH = 1.5, 0.6
#: Logarithms are kept as 16-bit codes, STEP apart; NONE: not in the trie.
STEP, NONE = 1 / 4096, 65535
#: Bytes of text for each shard, and that a task handles at once.
SHARD_BYTES, SLICE_BYTES = 12 << 20, 6 << 20
#: Bits of a word's hash as first, second, third and later word of a path in the trie: a word needs to be told from the others
#: that follow the same context only. Counts of words go by 64-bit hashes.
BITS = (40, 32, 24, 24, 24)
END = np.uint64(xxhash.xxh3_64_intdigest(b""))
ODD = np.uint64(0x9E3779B97F4A7C15)


def spread(count: np.ndarray) -> np.ndarray:
    return SPREAD * count**GROWTH


def encode_log(value: np.ndarray) -> np.ndarray:
    """Codes of numbers from 1e-15 to 10."""
    return np.clip(np.round((1 - np.log10(value)) / STEP), 0, NONE - 1).astype(np.uint16)


def decode_log(code: np.ndarray) -> np.ndarray:
    """The numbers, 0 for NONE."""
    return np.where(code == NONE, 0.0, 10.0 ** (1 - STEP * code.astype(np.float64)))


def encode_count(count: np.ndarray) -> np.ndarray:
    return np.round(np.log10(count) / STEP).astype(np.uint16)


def decode_count(code: np.ndarray) -> np.ndarray:
    """Counts up to 10 ** 15, 0 for NONE."""
    return np.where(code == NONE, 0.0, 10.0 ** (STEP * code.astype(np.float64)))


# -- what a slice of texts asks --------------------------------------------------------------------------------------------


def tokens(part: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted hashes of the words and END, number of each token, bounds): each text's words and then its end."""
    w = Words(part, cuts)
    hashes = np.append(w.hashes(), END)
    n = len(cuts) - 1
    bounds = w.bounds + np.arange(n + 1)
    codes = np.full(len(w.codes) + n, len(hashes) - 1, np.int64)
    codes[np.arange(len(w.codes)) + w.texts()] = w.codes
    vocabulary, place = distinct(hashes)
    return vocabulary, place[codes], bounds


def windows(vocabulary: np.ndarray, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct windows of ORDER word numbers from 1 on, in order, 0 where a text has ended; the window that begins at each place;
    places' bounds). Places are each text's end token, as what stands before it, and its tokens; the window of the last
    place is -1, as all windows have two words at least."""
    n = len(bounds) - 1
    at = bounds + np.arange(n + 1)
    line = np.full(len(codes) + n, np.searchsorted(vocabulary, END), np.int64)
    line[np.arange(len(codes)) + np.repeat(np.arange(n), np.diff(bounds)) + 1] = codes
    ends = np.repeat(at[1:], np.diff(at))
    begin = np.flatnonzero(np.arange(len(line)) + 1 < ends)
    columns = np.zeros((ORDER, len(begin)), np.int64)
    for k in range(ORDER):
        inside = begin + k < ends[begin]
        columns[k][inside] = line[begin[inside] + k] + 1
    order, new = sorted_rows(columns, [len(vocabulary).bit_length()] * ORDER)
    which = np.full(len(line), -1, np.int64)
    which[begin[order]] = np.cumsum(new) - 1
    return columns[:, order[new]], which, at


def sorted_rows(columns, bits) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows by their columns, which of the ordered ones differ from the row before). bits: of each column's values."""
    packed, room = [], 0
    for c, b in zip(columns, bits, strict=False):
        if b > room:
            packed.append(np.zeros(len(c), np.uint64))
            room = 64
        packed[-1] = (packed[-1] << np.uint64(b)) | c.astype(np.uint64)
        room -= b
    order = np.lexsort(packed[::-1])
    new = np.ones(len(order), bool)
    new[1:] = False
    for key in packed:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    return order, new


def shards_of(vocabulary: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """A window's shard follows from its first two words, so that no frequent word makes a shard large. A frequent pair costs its
    shard what distinct windows with it each slice has."""
    h = vocabulary >> np.uint64(64 - BITS[1])
    key = mix64(h[rows[0] - 1] * ODD + h[rows[1] - 1])
    return (key % np.uint64(n)).astype(np.int64)


def window_block(vocabulary: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> bytes:
    """Windows, in order, as hashes of their words, cut to BITS; 0 stays. Each first word stands once, with its number of second
    words, and each pair once, with its number of windows."""
    columns = []
    for c, bits in zip(rows, BITS, strict=False):
        h = np.maximum(vocabulary >> np.uint64(64 - bits), 1).astype(np.uint64 if bits > 32 else np.uint32)
        columns.append(np.where(c > 0, h[c - 1], h.dtype.type(0)))
    first, second, *more = columns
    new_first = np.append(True, first[1:] != first[:-1])
    pair = np.flatnonzero(new_first | np.append(True, second[1:] != second[:-1]))
    word = np.flatnonzero(new_first[pair])
    pairs, windows = (np.diff(at, append=n).astype(np.uint32) for at, n in ((word, len(pair)), (pair, len(first))))
    return pack(counts.astype(np.uint32), steps(first[pair][word]), pairs, second[pair], windows, *more)


def open_block(blob: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    """(counts, columns of hashes) of a window_block."""
    counts, first, pairs, second, windows, *more = unpack(blob)
    first = np.repeat(np.cumsum(first, dtype=first.dtype), pairs)
    return counts, [np.repeat(first, windows), np.repeat(second, windows), *more]


def few(codes: np.ndarray) -> list[np.ndarray]:
    """[distinct codes, which of them each one is]: counts are of few kinds, and most numbers fit a byte."""
    kinds, which = np.unique(codes, return_inverse=True)
    return [kinds, which.astype(np.uint8 if len(kinds) <= 256 else np.uint16)]


def all_of(blob: bytes) -> list[np.ndarray]:
    """The arrays of codes that were packed as few of each."""
    parts = unpack(blob)
    return [kinds[which] for kinds, which in zip(parts[::2], parts[1::2], strict=True)]


def word_shards(vocabulary: np.ndarray, n: int) -> np.ndarray:
    return (mix64(vocabulary) % np.uint64(n)).astype(np.int64)


def ask(folder: str, n: int):
    """Texts (doc_id, learn, text) to questions: shards 0 to n - 1 have windows, n to 2n - 1 words."""

    def run(batches):
        keeper = Keeper(folder)
        for batch in batches:
            learn = batch.column(1).to_numpy(zero_copy_only=False)
            for first, part, cuts in slices(*as_bytes(batch.column(2)), SLICE_BYTES):
                vocabulary, codes, bounds = tokens(part, cuts)
                learned = learn[first : first + len(cuts) - 1].astype(bool)
                ids = pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(cuts) - 1)], names=["doc_id"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, ids.schema) as out:
                    out.write_batch(ids)
                names = np.frombuffer(sink.getvalue(), np.uint8)
                kept = keeper.keep(pack(names, steps(vocabulary), codes.astype(np.uint32), bounds.astype(np.int64)))
                from_learned = np.repeat(learned, np.diff(bounds))
                blobs = []
                counts = np.bincount(codes, from_learned, len(vocabulary))
                for s, at in by_shard(word_shards(vocabulary, n)):
                    blobs.append((n + s, pack(steps(vocabulary[at]), counts[at].astype(np.uint32))))
                rows, which, places = windows(vocabulary, codes, bounds)
                begin = np.flatnonzero(which >= 0)
                counts = np.bincount(which[begin], np.repeat(learned, np.diff(places))[begin], rows.shape[1])
                for s, at in by_shard(shards_of(vocabulary, rows, n)):
                    blobs.append((s, window_block(vocabulary, rows[:, at], counts[at])))
                yield asked(kept, blobs)
        keeper.close()

    return run


# -- what shards answer ----------------------------------------------------------------------------------------------------


def answer_counts(folder: str, shard: int, blobs: list[bytes]) -> tuple[list[bytes], int, int]:
    """Counts of words; the shard reports its distinct words and their tokens."""
    parts = [unpack(b) for b in blobs]
    asked_keys = [np.cumsum(k) for k, _ in parts]
    keys, place = distinct(np.concatenate(asked_keys))
    counts = np.bincount(place, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)
    seen = counts > 0
    level = EliasFano.of(keys[seen])
    write_arrays(f"{folder}/counts-{shard}", {"n": level.n, "low_bits": level.low_bits}, [*level.parts(), counts[seen]])
    meta, (lows, highs, ones, kept) = read_arrays(f"{folder}/counts-{shard}")
    at, found = EliasFano(meta["n"], meta["low_bits"], lows, highs, ones).successor(keys)
    known = np.zeros(len(keys), np.int64)
    known[found] = kept[at[found]]
    cuts = np.cumsum([len(k) for k in asked_keys])[:-1]
    return [pack(known[p]) for p in np.split(place, cuts)], int(seen.sum()), int(counts.sum())


class TrieShard:
    """The trie below some pairs of words. Level k has the distinct paths of k + 1 words in order: children, the last word's hash of
    BITS[k] bits below its parent's number, and pointers, where each parent's children begin. Level 1 (pairs) has codes of counts, as their
    context's count is with another shard, all below of smoothed probabilities."""

    def __init__(self, uri: str):
        meta, arrays = read_arrays(uri)
        levels = [EliasFano(n, b, *arrays[3 * i : 3 * i + 3]) for i, (n, b) in enumerate(zip(meta["n"], meta["low_bits"], strict=True))]
        self.children, self.pointers, self.codes = levels[:ORDER], levels[ORDER:], arrays[3 * len(levels) :]

    @staticmethod
    def write(uri: str, rows: list[np.ndarray], counts: np.ndarray) -> None:
        """rows: columns of distinct windows in order, with their counts."""
        children, pointers, codes = [], [], []
        node = np.zeros(len(counts), np.int64)  # each row's node on the level before
        parents, number = np.zeros(1), np.zeros(1)
        inside = np.ones(len(counts), bool)
        for k in range(ORDER):
            inside = inside & (rows[k] > 0)
            at = np.flatnonzero(inside)
            new = np.ones(len(at), bool)
            new[1:] = (node[at][1:] != node[at][:-1]) | (rows[k][at][1:] != rows[k][at][:-1])
            first = at[new]
            children.append(EliasFano.of((node[first].astype(np.uint64) << np.uint64(BITS[k])) | rows[k][first].astype(np.uint64)))
            if k:
                pointers.append(EliasFano.of(np.searchsorted(node[first], np.arange(len(parents) + 1))))
            sums = np.add.reduceat(counts[at], np.flatnonzero(new)) if len(at) else np.zeros(0)
            if k == 1:
                codes.append(encode_count(sums))
                number = decode_count(codes[-1])
            elif k > 1:
                context = number[node[first]]
                codes.append(encode_log(sums / (context + spread(context))))
                number = decode_log(codes[-1]) * (context + spread(context))
            parents = first
            here = np.full(len(counts), -1, np.int64)
            here[at] = np.cumsum(new) - 1
            node = here
        levels = [*children, *pointers]
        write_arrays(uri, {"n": [x.n for x in levels], "low_bits": [x.low_bits for x in levels]}, [*[p for x in levels for p in x.parts()], *codes])

    def child(self, level: int, parents: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The node that a word makes below each parent, -1 for none: the successor among the words of that context."""
        place, found = self.children[level].successor((np.maximum(parents, 0).astype(np.uint64) << np.uint64(BITS[level])) | words.astype(np.uint64))
        return np.where(found & (parents >= 0) & (words > 0), place, -1)

    def followers(self, level: int, parent: int) -> np.ndarray:
        """The words' hashes below a node of the level before."""
        a, b = self.pointers[level - 1].get(np.array([parent, parent + 1])).astype(np.int64)
        return (self.children[level].get(np.arange(a, b)) & np.uint64((1 << BITS[level]) - 1)).astype(np.int64)

    def look_up(self, rows: list[np.ndarray]) -> np.ndarray:
        """For sorted distinct windows their codes on all levels from 1 on, NONE where the trie has no such path. A path that many windows
        begin with is looked for once."""
        n = len(rows[0])
        out = np.full((ORDER - 1, n), NONE, np.uint16)
        node, new = np.zeros(n, np.int64), np.zeros(n, bool)
        new[:1] = True
        for k in range(ORDER):
            new[1:] |= rows[k][1:] != rows[k][:-1]
            first = np.flatnonzero(new)
            found = self.child(k, node[first], rows[k][first])
            node = found[np.cumsum(new) - 1]
            if k:
                out[k - 1][node >= 0] = self.codes[k - 1][node[node >= 0]]
        return out


def path_counts(codes: np.ndarray) -> list[np.ndarray]:
    """A path's codes as codes of counts, which take less room on their way: a smoothed probability and its context's count give the
    path's own count, a whole number."""
    out, context = [codes[0]], decode_count(codes[0])
    for code in codes[1:]:
        found = code != NONE
        context = np.where(found, np.maximum(np.round(decode_log(code) * (context + spread(context))), 1), 0)
        out.append(np.where(found, encode_count(np.maximum(context, 1)), NONE).astype(np.uint16))
    return out


def answer_windows(folder: str, shard: int, blobs: list[bytes]) -> tuple[list[bytes], int, int]:
    """Builds the shard's trie of all learned windows and looks up all windows in it."""
    parts = [open_block(b) for b in blobs]
    sizes = [len(c) for c, _ in parts]
    counts = np.concatenate([c for c, _ in parts])
    rows = [np.concatenate([columns[k] for _, columns in parts]) for k in range(ORDER)]
    del parts
    order, new = sorted_rows(rows, BITS)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    first = order[new]
    rows = [c[first] for c in rows]
    counts = np.bincount(which, counts, len(first)).astype(np.int64)
    del order, new, first
    seen = counts > 0
    TrieShard.write(f"{folder}/trie-{shard}", [c[seen] for c in rows], counts[seen])
    codes = path_counts(TrieShard(f"{folder}/trie-{shard}").look_up(rows))
    return [pack(*[x for c in codes for x in few(c[p])]) for p in np.split(which, np.cumsum(sizes)[:-1])], 0, 0


def answer(folder: str, n: int, keep: bool):
    """keep: leave the shard's files."""

    def run(shard: int, blobs: list[bytes]):
        found = (answer_windows if shard < n else answer_counts)(folder, shard, blobs)
        if not keep:
            remove_file(f"{folder}/{'trie' if shard < n else 'counts'}-{shard}")
        return found

    return run


# -- what a slice makes of the answers -------------------------------------------------------------------------------------


def probabilities(found: dict[int, bytes], vocabulary: np.ndarray, codes: np.ndarray, bounds: np.ndarray, n: int, total: int, distinct_words: int):
    """(count of each token, its add-one-tenth probability, its probability after up to ORDER - 1 tokens)."""
    counts = np.zeros(len(vocabulary))
    for s, at in by_shard(word_shards(vocabulary, n)):
        counts[at] = unpack(found[n + s])[0]
    rows, which, places = windows(vocabulary, codes, bounds)
    path = np.full((ORDER - 1, rows.shape[1] + 1), NONE, np.uint16)  # the last one for what is no window
    for s, at in by_shard(shards_of(vocabulary, rows, n)):
        path[:, at] = all_of(found[s])
    single = counts[codes]
    base = (single + ADD) / (total + ADD * (distinct_words + 1))
    before = np.roll(single, 1)
    before[bounds[:-1]] = counts[np.searchsorted(vocabulary, END)]
    # place of the token itself, and the windows that begin some places before it
    place = np.arange(len(codes)) + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) + 1
    start = np.repeat(places[:-1], np.diff(bounds))
    p = base
    for k in range(ORDER - 1):
        at = np.where(place - k - 1 >= start, which[np.maximum(place - k - 1, 0)], -1)
        context = decode_count(path[k - 1][at]) if k else before
        share = decode_count(path[k][at]) / np.maximum(context + spread(context), 1e-9)
        weight = spread(context)
        p = np.where((at >= 0) & (context > 0), share + p * weight / np.maximum(context + weight, 1e-9), p)
    return single, base, p


def tell(n: int, total: int, distinct_words: int, each: bool):
    def run(data: bytes, found: dict[int, bytes]):
        names, hashes, codes, bounds = unpack(data)
        doc_ids = pa.ipc.open_stream(names.tobytes()).read_all().combine_chunks().column(0)
        doc_ids = doc_ids.combine_chunks() if isinstance(doc_ids, pa.ChunkedArray) else doc_ids
        codes = codes.astype(np.int64)
        single, base, p = probabilities(found, np.cumsum(hashes), codes, bounds, n, total, distinct_words)
        texts = lambda x: np.add.reduceat(x, bounds[:-1])
        columns = [doc_ids, pa.array(np.diff(bounds)), pa.array(texts((single > 0).astype(np.int64))), pa.array(texts(np.log10(base))), pa.array(texts(np.log10(p)))]
        names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
        if each:
            columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.log10(p))))
            names.append("token_scores")
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 10, remainder: int = 0, model_dir: str | None = None, token_scores: bool = False) -> DataFrame:
    """log10 probabilities of every whole text, learned from the texts that are not held out.

    Returns one row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (words alone, add 0.1) and score
    (a word after up to ORDER - 1 others; each context is smoothed by the next shorter one, the shortest by those words alone; the
    end token is what stands before a text's first word). token_scores: also each token's part of the score. Tokens are
    words, A-Z lower-cased, and one end per text. Null texts count as empty and have the end only. Rows stay apart even if
    repeated; a null doc_id is not held out. Other columns are not read. An empty table gives an empty result; where nothing
    is left to learn from, every token is unknown and both scores are 0.

    Each slice of texts asks the shards of the trie for its distinct windows and words; a shard merges what all slices ask,
    builds its part of the trie from the learned windows, writes it, and looks the asked ones up in it. So no task holds
    more than a shard or a slice, and nothing is broadcast. model_dir: where to leave the trie; else each part goes once
    its shard has answered.
    """
    spark = docs.sparkSession
    folder = model_dir or fresh_path(spark, "trie")
    kept = fresh_path(spark, "slices")
    id_ = F.col(id_col)
    rows = docs.select(id_.alias("doc_id"), (~held_out(id_, modulus, remainder)).alias("learn"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = max(4, -(-text_bytes(rows) // SHARD_BYTES))
    with shuffles_removed(spark):
        answers = written(answered(rows.mapInArrow(ask(kept, n), ASKED), 2 * n, answer(folder, n, bool(model_dir))), "answers")
    if not model_dir:
        remove(spark, folder)
    distinct_words, total = answers.agg(F.sum("n"), F.sum("total")).first()
    kind = rows.dtypes[0][1]
    schema = f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double" + ", token_scores array<double>" * token_scores
    scored = per_slice(answers, n, tell(n, total or 0, distinct_words or 0, token_scores), schema)
    out = ["doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "n_tokens", "n_known", F.lit(total or 0).cast("long").alias("train_tokens"), "base_score", "score"]
    return scored.select(*out, *["token_scores"] * token_scores)
