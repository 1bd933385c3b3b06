"""N-gram Jaccard join: rare-first prefix filter with length, positional and suffix filters, each pair verified once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import ASKED, Keeper, answered, asked, by_shard, distinct, pack, per_slice, steps, text_bytes, unpack
from ._shared import fresh_path, written
from ._words import Words, as_bytes, mix64, slices, window_hashes
from .components import components

N_GRAM = 5
#: Jaccard similarity of at least NUM / DEN links.
NUM, DEN = 3, 4
#: Frequencies are counted by the first KEY_BITS bits of an n-gram's hash; they set the order of n-grams, and an n-gram seen in
#: one document only is in no other prefix. Equal bits make an n-gram look more frequent, never less.
KEY_BITS = 48
#: Bytes of text for each shard of the frequencies.
SHARD_BYTES = 12 << 20
#: Bytes of text that a task handles at once.
SLICE_BYTES = 4 << 20
#: Classes of a bucket that meet the others of it in one task.
SALT = 4096
#: Partitions of the hash range in the suffix filter.
PARTS = 256


def needed(a, b):
    """The overlap that sets of a and b n-grams need to link: the least k with DEN * k >= NUM * (a + b - k)."""
    return -((-NUM * (a + b)) // (NUM + DEN))


def prefix_length(n: int) -> int:
    return n + (-NUM * n) // DEN + 1


def words_of(part: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted hashes of the words, number of each word of the texts, texts' bounds)."""
    w = Words(part, cuts)
    vocabulary, place = distinct(w.hashes())
    return vocabulary, place[w.codes], w.bounds


def shingle_sets(vocabulary: np.ndarray, codes: np.ndarray, bounds: np.ndarray, size: int = N_GRAM):
    """For each text its sorted distinct n-gram hashes; a text of fewer words has one, of all its words; none without words."""
    words = vocabulary[codes]
    grams = window_hashes(words, size)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        else:
            yield mix64(window_hashes(words[a:b], b - a) + np.uint64(b - a)) if b > a else words[:0]


def shard_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (mix64(keys) % np.uint64(n)).astype(np.int64)


def ask(folder: str, n: int, size: int):
    """Texts (doc_id, text) to questions: in how many documents are the slice's n-grams. The texts are kept as numbers of words,
    which take half the room of their sets."""

    def run(batches):
        keeper = Keeper(folder)
        for batch in batches:
            for first, part, cuts in slices(*as_bytes(batch.column(1)), SLICE_BYTES):
                vocabulary, codes, bounds = words_of(part, cuts)
                ids = batch.column(0).slice(first, len(cuts) - 1)
                known = np.asarray(ids.is_valid())
                kept = keeper.keep(pack(np.asarray(ids.fill_null(0)).astype(np.int64), known, steps(vocabulary), codes.astype(np.uint32), bounds.astype(np.int64)))
                flat = np.concatenate(list(shingle_sets(vocabulary, codes, bounds, size)))
                keys, place = distinct(flat >> np.uint64(64 - KEY_BITS))
                counts = np.bincount(place, minlength=len(keys)).astype(np.uint32)
                blobs = [(s, pack(steps(keys[at]), counts[at])) for s, at in by_shard(shard_of(keys, n))]
                yield asked(kept, blobs or [(0, pack(keys, counts))])
        keeper.close()

    return run


def answer(shard: int, blobs: list[bytes]) -> tuple[list[bytes], int, int]:
    """Frequency classes, two per power of two: 0 for n-grams of one document."""
    parts = [unpack(b) for b in blobs]
    keys, place = distinct(np.concatenate([np.cumsum(k) for k, _ in parts]))
    counts = np.bincount(place, np.concatenate([c for _, c in parts]), len(keys))
    classes = np.ceil(2 * np.log2(np.maximum(counts, 1))).astype(np.uint8)
    return [pack(classes[p]) for p in np.split(place, np.cumsum([len(k) for k, _ in parts])[:-1])], 0, 0


HEADS = "doc_id long, n long, s1 long, s2 long, grams array<bigint>, places array<int>, parts binary, hashes binary"


def tell(n_shards: int, size: int):
    """A slice's sets and the frequencies of their n-grams to HEADS: the set's size and 128-bit hash, and the part of the prefix
    that other documents have too: n-grams and their places in the order from rare to frequent. The prefix is as long as a
    set that links must share one n-gram of. Where there is such a part, also the set (sorted 64-bit hashes) and how many of
    it are in each part of the hash range, at most 255."""

    def run(data: bytes, found: dict[int, bytes]):
        ids, known, hashes, codes, bounds = unpack(data)
        sets = list(shingle_sets(np.cumsum(hashes), codes, bounds, size))
        flat, n = np.concatenate(sets), np.fromiter(map(len, sets), np.int64, len(sets))
        keys, which = distinct(flat >> np.uint64(64 - KEY_BITS))
        classes = np.zeros(len(keys), np.uint8)
        for s, at in by_shard(shard_of(keys, n_shards)):
            classes[at] = unpack(found[s])[0]
        classes = classes[which]
        bounds = np.concatenate([[0], np.cumsum(n)])
        digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
        shared = np.flatnonzero(classes)
        doc = np.searchsorted(bounds, shared, "right") - 1
        order = np.lexsort((flat[shared], classes[shared], doc))
        shared, doc = shared[order], doc[order]
        begin = np.searchsorted(doc, np.arange(len(sets) + 1))
        alone = n - np.diff(begin)  # n-grams of this document only come first
        place = np.arange(len(shared)) - begin[doc] + alone[doc]
        keep = place < prefix_length(n[doc])
        some = np.bincount(doc[keep], minlength=len(sets))
        kept = np.concatenate([[0], np.cumsum(some)]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(kept), pa.array(x)) for x in (flat[shared[keep]].view(np.int64), place[keep].astype(np.int32))]
        parts = [np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=PARTS), 255).astype(np.uint8).tobytes() if k else None for s, k in zip(sets, some, strict=True)]
        whole = [s.tobytes() if k else None for s, k in zip(sets, some, strict=True)]
        columns = [pa.array(ids, pa.int64(), mask=~known.astype(bool)), pa.array(n), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), *lists, pa.array(parts, pa.binary()), pa.array(whole, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in HEADS.split(", ")])

    return run


def suffix_filter(batches):
    """Keeps pairs whose sets can still share enough. Sets that share k of a and b n-grams differ in a + b - 2k; each part of
    the hash range differs at least by the difference of its counts, whose sum must not exceed that."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int16) for i in (4, 5))
        keep = np.abs(x - y).sum(axis=1) <= a + b - 2 * needed(a, b)
        yield batch.filter(pa.array(keep)).select([0, 1])


def verify(batches):
    """Keeps pairs whose sets' similarity reaches the threshold."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.sort(np.concatenate([x, y]))
            same = int((both[1:] == both[:-1]).sum())
            keep.append(same >= needed(len(x), len(y)))
        yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of distinct pairs (u, v), those that link."""
    small = sets.select("id", "n", "parts")
    seen = pairs.join(small.toDF("u", "nu", "pu"), "u").join(small.toDF("v", "nv", "pv"), "v").select("u", "v", "nu", "nv", "pu", "pv")
    left = written(seen.mapInArrow(suffix_filter, "u long, v long"), "filtered")
    grams = sets.select("id", "grams")
    return left.join(grams.toDF("u", "gu"), "u").join(grams.toDF("v", "gv"), "v").select("u", "v", "gu", "gv").mapInArrow(verify, "u long, v long")


def possible(nu: str, iu: str, nv: str, iv: str):
    """Length, positional and suffix filter of a shared prefix n-gram at place iu of nu and iv of nv. At the first one that two
    sets share, what stands before it in either is not in the other: that bounds the overlap, and the sets' difference."""
    a, b, i, j = F.col(nu), F.col(nv), F.col(iu), F.col(iv)
    need = F.ceil(NUM * (a + b) / (NUM + DEN))
    return (DEN * F.least(a, b) >= NUM * F.greatest(a, b)) & (F.least(a - i, b - j) >= need) & (i + j <= a + b - 2 * need)


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = N_GRAM) -> DataFrame:
    """Links documents whose sets of distinct word n-grams have a Jaccard similarity of at least 3/4.

    Returns one row per input row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links). Null texts and
    texts without words have no n-grams and link with nothing; rows with a null doc_id link with nothing and have a null
    component. doc_ids are integers that identify documents; rows that repeat one share what either links with. Other
    columns are not read. An empty table gives an empty result.

    Documents with equal sets are one class, so copies are never paired. Classes meet in the buckets of their prefix n-grams.
    A bucket's head is the class with the fewest rarer n-grams, of copies with edits the least edited one. First each class is
    paired with the head that it shares most n-grams with; what links there becomes a component.
    Then all pairs of a bucket whose classes are in different components are verified, so no link that could join two
    components is missed, and a bucket whose classes are one component already costs nothing more.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # texts are read and cut into n-grams once; each slice asks the shards of the frequencies
    n_shards = max(4, -(-text_bytes(rows) // SHARD_BYTES))
    counted = answered(rows.mapInArrow(ask(fresh_path(docs.sparkSession, "slices"), n_shards, size), ASKED), n_shards, answer)
    heads = written(per_slice(counted, n_shards, tell(n_shards, size), HEADS), "heads")
    members = heads.select("doc_id", "n", "s1", "s2")

    classes = heads.filter("doc_id is not null and size(grams) > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("id"), F.any_value("grams").alias("grams"), F.any_value("places").alias("places"))
    classes = written(classes, "classes")
    tokens = classes.select("id", "n", F.explode(F.arrays_zip("grams", "places")).alias("x")).select("id", "n", F.col("x.places").alias("at"), F.col("x.grams").alias("gram"))
    # a bucket's size and head are summed task by task before they meet, and joins can split a large bucket
    buckets = written(tokens.groupBy("gram").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("at", "n", "id")).alias("lead")).filter("k > 1").drop("k"), "buckets")
    with_lead = written(tokens.join(buckets, "gram"), "shared")
    shared = with_lead.drop("lead")
    stars = with_lead.select(F.col("id").alias("u"), "n", "at", F.col("lead.id").alias("v"), F.col("lead.n").alias("m"), F.col("lead.at").alias("lat")).filter("u <> v").filter(possible("n", "at", "m", "lat"))
    best = stars.groupBy("u", "v").agg(F.count(F.lit(1)).alias("c")).groupBy("u").agg(F.max_by("v", F.struct("c", -F.col("v"))).alias("v"))
    best = written(best, "stars")

    wanted = written(shared.select("id").distinct(), "wanted")
    own = heads.filter("hashes is not null").select(F.col("doc_id").alias("id"), "n", "parts", F.col("hashes").alias("grams"))
    sets = written(own.join(wanted, "id", "left_semi"), "sets")
    edges = written(linked(best, sets), "links")
    labels = components(edges)

    tagged = shared.join(labels, shared["id"] == labels["u"], "left").select("id", "n", "at", "gram", F.coalesce("component", "id").alias("c"))
    tagged = written(tagged, "tagged")
    mixed = written(tagged.groupBy("gram").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("gram"), "mixed")
    # sets that link differ in size by a factor of DEN / NUM at most: they are in one band of sizes or in neighbouring ones
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(DEN / NUM)) + 1e-9).cast("int")
    split = written(tagged.join(mixed, "gram", "left_semi").select("id", "n", "at", "gram", "c", band.alias("band")), "open")
    salts = split.groupBy("gram", "band").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("salts"))
    dealt = split.join(salts, ["gram", "band"]).withColumn("salt", F.pmod(F.hash("id"), "salts")).drop("salts")
    near = split.select(F.col("id").alias("v"), F.col("n").alias("m"), F.col("at").alias("lat"), "gram", F.col("c").alias("d"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    other = near.join(salts, ["gram", "band"]).select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).drop("salts")
    across = dealt.withColumnRenamed("id", "u").join(other, ["gram", "band", "salt"]).filter("u < v and c <> d").filter(possible("n", "at", "m", "lat")).select("u", "v").distinct()
    tried = best.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    more = written(linked(written(across.join(tried, ["u", "v"], "left_anti"), "across"), sets), "links")
    labels = components(edges.unionByName(more)).withColumnRenamed("u", "node")

    doubled = written(members.filter("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k"), "classes")
    placed = members.join(doubled, ["s1", "s2"], "left").select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("id", "doc_id")).otherwise(F.col("doc_id")).alias("node"))
    final = placed.join(labels, "node", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "node")).otherwise(F.col("doc_id"))
    return final.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
