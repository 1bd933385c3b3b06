import binascii
import glob
import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostra.llm import exact_dedup, language_id, license_scan, line_dedup, lm_scoring, mixing, ngram_join, packing, quality_classifier, quality_rules
from rostra.llm.components import components
from rostra.llm.elias_fano import EliasFano

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STRIP = " \t\n\x0b\x0c\r"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def rows(df):
    return [r.asDict(True) for r in df.collect()]


def same(a, b):
    key = lambda r: repr(sorted(r.items(), key=lambda x: x[0]))
    assert sorted(map(key, a)) == sorted(map(key, b))


# -- 1


def plain_lines(table, min_length=40, min_docs=5):
    key = lambda line: low(line.strip(STRIP))
    holders = defaultdict(list)
    for i, t in table:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_length:
                holders[k].append(i)
    gone = {k: max((x for x in v if x is not None), default=None) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in table:
        all_lines = (t or "").split("\n")
        keep = [x for x in all_lines if key(x) not in gone or gone[key(x)] is None or gone[key(x)] == i]
        out.append({"doc_id": i, "n_lines": len(all_lines), "n_dropped": len(all_lines) - len(keep), "kept_sha256": hashlib.sha256("\n".join(keep).encode()).hexdigest()})
    return out


@pytest.mark.parametrize("min_docs", [2, 5])
@pytest.mark.parametrize("n_batches", [1, 3])
def test_line_dedup(spark, odd, none, min_docs, n_batches):
    extra = [(100 + i, f"A Line that many documents share, all of 50 characters\n own {i}\n\t a line that many documents share, ALL of 50 characters \nü" + "é" * 39) for i in range(7)]
    df = odd.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = rows(line_dedup.line_dedup(df, min_docs=min_docs, n_batches=n_batches).select("doc_id", "n_lines", "n_dropped", "kept_sha256"))
    same(got, plain_lines([tuple(r) for r in df.collect()], min_docs=min_docs))
    assert any(r["n_dropped"] for r in got)


def test_line_dedup_keeps_columns(odd, none):
    out = line_dedup.line_dedup(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_dropped", "kept_sha256"] and out.count() == odd.count()
    assert line_dedup.line_dedup(none).count() == 0


def test_line_runs_are_compacted(spark, small):
    lines = small.selectExpr("xxhash64(doc_id) as row_no", "doc_id", "text").mapInArrow(line_dedup.hash_lines(40), line_dedup.LINE_SCHEMA)
    store = line_dedup.LineRuns(spark, 3, fanout=2)
    for part in line_dedup.batches(lines, 4):
        store.add(part)
    assert [len(level) for level in store.levels] == [0, 0, 1]
    want = lines.groupBy("h1", "h2").agg(F.max("doc_id").alias("top"))
    same(rows(store.owners().select("h1", "h2", "top")), rows(want))
    store.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("rostra_run")]


def test_the_anti_join_decides_owners(spark):
    """A hash belongs to the batch that brought it first, whatever comes later, and runs merge without exchange or sort."""
    store = line_dedup.LineRuns(spark, 2, fanout=3)
    for rows_of in ([(5, 1, 1), (4, 2, 2)], [(9, 1, 1), (3, 3, 3)], [(8, 3, 3), (7, 4, 4)]):
        store.add(spark.createDataFrame(rows_of, "doc_id long, h1 long, h2 long"))
    assert {(r["h1"], r["top"]) for r in store.owners().collect()} == {(1, 5), (2, 4), (3, 3), (4, 7)}
    a, b = line_dedup.LineRuns(spark, 2, fanout=9), spark.range(100).selectExpr("id as doc_id", "id % 50 as h1", "id as h2")
    a.add(b.filter("doc_id < 60"))
    a.add(b.filter("doc_id >= 60"))
    with line_dedup.stored_order(spark):
        plan = a._both(*a.runs())._jdf.queryExecution().executedPlan().toString()
        anti = a.runs()[0].join(a.runs()[1].select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    for p in (plan, anti):
        assert "SortMergeJoin" in p and "Exchange" not in p and "Sort [" not in p
    store.close()
    a.close()


# -- 2


def test_packing_round_trip(small, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert packing.packing(none).count() == 0
    for df in (odd, small):
        table = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = rows(packing.packing(df))
        ids = defaultdict(list)
        for i, t in table:
            ids[i].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])
        assert Counter(r["doc_id"] for r in got).keys() == Counter(i for i, _ in table).keys()
        for i, lists in ids.items():
            pieces = [r for r in got if r["doc_id"] == i]
            assert sum(r["length"] for r in pieces) == sum(map(len, lists))
            for r in pieces:
                crcs = {binascii.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for x in lists if len(x) == r["doc_tokens"]}
                assert r["ids_crc32"] in crcs
        used = defaultdict(list)
        for r in got:
            used[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096
        total = sum(r["length"] for r in got)
        assert len(used) * 4096 - total < 4096 * 4 and len(used) <= -(-total // 4096) + 4


def test_pack_balances_costs():
    pieces, costs = packing.pack([3000, 2000, 2000, 1000, 96, 96], 4096)
    by_sequence = defaultdict(list)
    for _, _, n, q, _ in pieces:
        by_sequence[q].append(n)
    assert sorted(sorted(v) for v in by_sequence.values()) == [[96, 1000, 3000], [96, 2000, 2000]]
    assert sorted(costs) == sorted(sum(map(packing.cost, v)) for v in by_sequence.values())
    assert packing.pack([], 4096)[0] == [] and packing.pack([8192], 4096)[0] == [(0, 0, 4096, 0, 0), (0, 4096, 4096, 1, 0)]


@pytest.mark.parametrize("text", ["It's CAN'T we'll", "Straße ÉCOLE x2y 3.14 ***foo***", "<|endoftext|> a<|STARTOFTEXT|>", "İi ΣΑΣ ½² Ⅷ 日本語 a\xa0b​c", "a\x00b\x7f\x1c", "ǅ ª º µ é ÷×"])
def test_tokens_are_the_tokenizers(text):
    import public_tokenizers
    import pyarrow as pa

    path = public_tokenizers.path("word_bpe_49k.json")
    t = packing.WordTokenizer(path)
    data, offsets = packing.as_bytes(pa.array([text, text + " x", "plain words, only"]))
    got = packing.encode_texts(t, data, offsets)
    assert [g.tolist() for g in got] == [t.whole.encode(x, add_special_tokens=False).ids + [2] for x in (text, text + " x", "plain words, only")]


# -- 3


def waterfill(sizes, weights=(5, 2, 1)):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, total, capped = {}, sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: 3 * sizes[s] if s in capped else w[s] * rest / sum(w[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mixing(odd, small, none):
    for df in (odd, small):
        got = rows(mixing.mix(df))
        sizes, taken = Counter(), Counter()
        for r in got:
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
            assert 0 <= r["taken"] <= 3 * r["size"]
        assert sorted(r["size"] for r in got) == sorted(len(WORD.findall(r["text"] or "")) for r in df.collect())
        for s, t in waterfill(dict(sizes)).items():
            assert abs(taken[s] - t) <= 3
            assert all(math.isclose(r["target"], t) and r["source_size"] == sizes[s] for r in got if r["source"] == s)
        same(got, rows(mixing.mix(df.repartition(5))))
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    out = mixing.mixed(small)
    assert out.columns == small.columns
    assert max(Counter(r["doc_id"] for r in out.collect()).values()) <= 3


@pytest.mark.parametrize("weight", [0.05, 0.2, 1.0])
def test_slices_are_even_for_all_weights(spark, weight):
    """No slice holds more than a few in 4000 documents, and the whole mix agrees with one sort of everything."""
    coarse, fine = mixing.slice_of()
    keys = spark.range(200_000).select((-F.log(mixing.uniform(F.lit("s"), F.col("id"))) / F.lit(weight)).alias("key"))
    most = keys.groupBy(coarse.alias("c")).count().agg(F.max("count")).first()[0]
    assert most < 200_000 / 4000 * 2
    parts = keys.select("key", coarse.alias("c"), fine.alias("f")).orderBy("key").collect()
    assert [(r["c"], r["f"]) for r in parts] == sorted((r["c"], r["f"]) for r in parts)


def test_mixing_takes_in_the_order_of_the_keys(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), "ab"[i % 3 == 0]) for i in range(900)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in rows(mixing.mix(df, quality=F.when(F.col("doc_id") % 5 == 0, None).otherwise(F.lit(0.05) + (F.col("doc_id") % 9) / 10)))}
    u = {i: (int(hashlib.md5(f"mix-1|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in got}
    key = {i: -math.log(u[i]) / (0.05 + (i % 9) / 10 if i % 5 else 1e-6) for i in got}
    for s in "ab":
        ids = sorted((i for i in got if got[i]["source"] == s), key=key.get)
        left = math.floor(got[ids[0]]["target"] - got[ids[0]]["epochs"] * got[ids[0]]["source_size"] + 0.5)
        for i in ids:
            part = min(left, got[i]["size"])
            left -= part
            assert got[i]["taken"] == got[i]["epochs"] * got[i]["size"] + part


def test_mixing_caps(spark):
    df = spark.createDataFrame([(1, "a " * 10, "a"), (2, "b " * 1000, "b"), (3, "c " * 5, "c"), (4, "", None)], "doc_id long, text string, source string")
    got = {r["source"]: r for r in rows(mixing.mix(df))}
    assert (got["a"]["taken"], got["c"]["taken"], got[None]["taken"]) == (30, 15, 0) and got["b"]["taken"] == 970


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100, "d": 100, "e": 100, None: 100}, {"a": 50, "b": 20, "c": 10}])
def test_mixing_ties(spark, sizes):
    df = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string")
    got = {r["source"]: r for r in rows(mixing.mix(df))}
    want = waterfill(sizes)
    assert math.isclose(sum(r["target"] for r in got.values()), sum(sizes.values()))
    assert all(math.isclose(r["target"], want[s]) and abs(r["taken"] - want[s]) <= 1 and r["epochs"] >= 0 for s, r in got.items())


# -- 4


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 1), (5, 3), (1000, 1000), (5000, 10**9), (3000, 2**62), (20000, 50)):
        v = np.sort(rng.integers(0, top, n).astype(np.uint64))
        e = EliasFano.of(v)
        if n:
            assert (e.get(np.arange(n)) == v).all()
        q = np.concatenate([rng.integers(0, top, 500).astype(np.uint64), v[:200], np.array([0, top, 2**63], np.uint64)])
        place, found = e.successor(q)
        assert (place == np.searchsorted(v, q)).all() and (found == np.isin(q, v)).all()


def plain_model(table, order):
    """(each document's tokens, counts of n-grams of up to `order` tokens, log10 probability of a token after a list of them)."""
    docs = defaultdict(list)
    for i, t in table:
        docs[i].append(WORD.findall(low(t)) + [""])
    counts = Counter()
    for i, ds in docs.items():
        for d in ds:
            if i is None or zlib.crc32(str(i).encode()) % 10:
                line = ["", *d]
                counts.update((w,) for w in d)
                counts.update(tuple(line[k : k + n]) for n in range(2, order + 1) for k in range(len(line) - n + 1))
    total, words = (sum(c for g, c in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts))

    def probability(word, before):
        p = (counts[(word,)] + 0.1) / (total + 0.1 * (words + 1))
        for n in range(1, order):
            context = tuple(before[-n:])
            c = counts[context] if len(before) >= n else 0
            if c:
                p = (counts[(*context, word)] + lm_scoring.spread(c) * p) / (c + lm_scoring.spread(c))
        return p

    return docs, counts, total, words, probability


def plain_scores(d, probability):
    line = ["", *d]
    return [math.log10(probability(line[k], line[:k][-9:])) for k in range(1, len(line))]


@pytest.mark.parametrize("order", [2, 3, 5])
def test_lm_scores(spark, odd, small, none, order, monkeypatch):
    monkeypatch.setattr(lm_scoring, "ORDER", order)
    long = spark.createDataFrame([(1000, " ".join(f"w{i % 977} v{i % 13}" for i in range(20_000)))], "doc_id long, text string")
    for df in (odd.select("doc_id", "text"), small.select("doc_id", "text").union(long)):
        docs, c, n, v, probability = plain_model([tuple(r) for r in df.collect()], order)
        got = defaultdict(list)
        for r in rows(lm_scoring.lm_scores(df)):
            got[r["doc_id"]].append(r)
        for i, lists in docs.items():
            want = sorted((len(d), sum(c[w,] > 0 for w in d), round(sum(math.log10((c[w,] + 0.1) / (n + 0.1 * (v + 1))) for w in d), 5), round(sum(plain_scores(d, probability)), 3)) for d in lists)
            have = sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 5), round(r["score"], 3)) for r in got[i])
            assert [w[:3] for w in want] == [h[:3] for h in have]
            assert all(abs(w[3] - h[3]) <= 0.0005 * w[0] + 0.002 for w, h in zip(want, have, strict=True))
            assert all(r["train_tokens"] == n and r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 10 == 0) for r in got[i])
    held = [r for rs in got.values() for r in rs if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm_scoring.lm_scores(none).count() == 0
    alone = rows(lm_scoring.lm_scores(spark.createDataFrame([(12, "x y")], "doc_id long, text string").filter("crc32(cast(doc_id as string)) % 10 = 0")))
    assert all(r["train_tokens"] == 0 for r in alone)


def test_lm_probabilities_sum_to_one(spark):
    """After contexts of no to six words, over the vocabulary, the end and one unknown word; all in held-out texts."""
    ids = iter(i for i in range(10**6) if zlib.crc32(str(i).encode()) % 10 == 0)
    texts = ["a b a c d a b", "a b b a b a c d", "c a b a c", "b"] * 3
    learned = [(i, t) for i, t in zip((i for i in range(100) if zlib.crc32(str(i).encode()) % 10), texts, strict=False)]
    words, contexts = ["a", "b", "c", "d", "zzz"], ["", "a", "a b", "d a", "a b a", "b b a", "a b a c", "x y a b a c"]
    asked = {(c, w): (next(ids), f"{c} {w}".strip()) for c in contexts for w in words} | {(c, ""): (next(ids), c) for c in contexts}
    df = spark.createDataFrame(learned + list(asked.values()), "doc_id long, text string")
    got = {r["doc_id"]: r["token_scores"] for r in rows(lm_scoring.lm_scores(df, token_scores=True)) if r["held_out"]}
    for c in contexts:
        at = len(c.split())
        assert math.isclose(sum(10 ** got[asked[c, w][0]][at] for w in [*words, ""]), 1, abs_tol=0.002)


def test_repeated_texts_score_apart(spark):
    rng = np.random.default_rng(1)
    text = lambda: " ".join(f"w{int(x)}" for x in 2000 * rng.random(80) ** 2)
    ids = [i for i in range(900) if zlib.crc32(str(i).encode()) % 10]
    once = [(i, text()) for i in ids[:300]]
    twice = [(i, t) for pair in zip(ids[300:340], ids[340:380], (text() for _ in range(40)), strict=True) for i, t in ((pair[0], pair[2]), (pair[1], pair[2]))]
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in rows(lm_scoring.lm_scores(spark.createDataFrame(once + twice, "doc_id long, text string")))}
    assert min(got[i] for i, _ in twice) > max(got[i] for i, _ in once)


def test_trie_paths(tmp_path, monkeypatch):
    """Pointers and children give back every path, and look-ups find the learned paths only."""
    monkeypatch.setattr(lm_scoring, "ORDER", 5)
    rng = np.random.default_rng(2)
    table = np.unique(rng.integers(1, 31, (400, 5)), axis=0)
    table[::7, 3:] = 0
    table[1::7, 4] = 0
    table = np.unique(table, axis=0)
    learned = rng.random(len(table)) < 0.6
    counts = rng.integers(1, 9, len(table))
    lm_scoring.TrieShard.write(f"{tmp_path}/t", list(table[learned].T), counts[learned])
    trie = lm_scoring.TrieShard(f"{tmp_path}/t")
    paths = {tuple(r[: k + 1]) for r in table[learned].tolist() for k in range(5) if all(r[: k + 1])}

    def walk(level, node, path):
        for j, w in enumerate(trie.followers(level, node) if level else trie.children[0].get(np.arange(trie.children[0].n)).astype(int)):
            yield (*path, int(w))
            if level < 4:
                yield from walk(level + 1, int(trie.pointers[level - 1].get(np.array([node]))[0]) + j if level else j, (*path, int(w)))

    assert set(walk(0, 0, ())) == paths
    found = trie.look_up(list(table.T))
    for k in range(4):
        assert [f != lm_scoring.NONE for f in found[k].tolist()] == [tuple(r[: k + 2]) in paths for r in table.tolist()]


# -- 5


def test_blocks_of_windows_and_answers():
    r = np.random.default_rng(5)
    vocabulary = np.unique(r.integers(0, 2**64, 300, np.uint64))
    table = np.unique(np.stack([r.integers(1, k, 4000) for k in (20, 60, len(vocabulary) + 1)], 1), axis=0)
    table[::7, 2] = 0
    table = np.unique(table, axis=0)
    counts = r.integers(0, 9, len(table))
    for rows, c in ((table.T, counts), (table[:1].T, counts[:1])):
        got_counts, columns = lm_scoring.open_block(lm_scoring.window_block(vocabulary, rows, c))
        assert got_counts.tolist() == c.tolist()
        for got, numbers, bits in zip(columns, rows, lm_scoring.BITS, strict=False):
            assert got.tolist() == [int(vocabulary[i - 1] >> np.uint64(64 - bits)) if i else 0 for i in numbers]
    for kinds in (1, 256, 257, 60000):
        codes = [r.integers(0, kinds, 5000).astype(np.uint16), np.arange(5000).astype(np.uint16) % np.uint16(kinds)]
        back = lm_scoring.all_of(lm_scoring.pack(*[x for c in codes for x in lm_scoring.few(c)]))
        assert [b.tolist() for b in back] == [c.tolist() for c in codes] and back[0].dtype == np.uint16


def test_the_questions_shuffle_goes_with_the_answers(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    there = lambda: {f: os.path.getsize(f) for folder in folders for f in glob.glob(f"{folder}/*/shuffle_*.data")}
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, set_to = there(), spark.conf.get(name)
    docs = spark.createDataFrame([(i, " ".join(f"word{i * k}" for k in range(200))) for i in range(300)], "doc_id long, text string")
    scored = lm_scoring.lm_scores(docs)
    assert sum(size for f, size in there().items() if f not in before) < 10_000 and spark.conf.get(name) == set_to
    assert scored.count() == 300


def test_exact_dedup(odd, small, none):
    for df in (odd, small):
        table = [(r["doc_id"], re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")) for r in df.collect()]
        groups = defaultdict(list)
        for i, t in table:
            groups[t].append(i)
        first = {t: min((i for i in v if i is not None), default=None) for t, v in groups.items()}
        got = rows(exact_dedup.exact_dedup(df))
        want = Counter((i, first[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in table)
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
        kept = [r for r in got if r["kept"]]
        assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_dedup.exact_dedup(none).count() == 0


#: Texts in five scripts; as in writing, few characters are frequent and many are rare.
SCRIPTS = ["".join(chr(lo + int(span * (zlib.crc32(f"{lo} {i}".encode()) / 2**32) ** 3)) for i in range(9000)) for lo, span in ((0x4E00, 900), (0x410, 64), (0x905, 50), (0x61, 26), (0x1F600, 60))]


def test_chunks_join_to_the_text(small):
    out = small.select("text", exact_dedup.chunks(small["text"]).alias("c")).collect()
    assert all("".join(r["c"]) == r["text"] for r in out) and max(len(r["c"]) for r in out) > 3


@pytest.mark.parametrize("text", SCRIPTS)
def test_an_inserted_character_leaves_most_chunks(spark, text):
    df = spark.createDataFrame([(text,), ("x" + text,), (text[:4000] + "x" + text[4000:],)], "text string")
    a, b, c = (r[0] for r in df.select(exact_dedup.chunks(df["text"])).collect())
    assert "".join(b) == "x" + text and len(set(a) & set(b)) > 0.5 * len(a) and len(set(a) & set(c)) > 0.5 * len(a)


def test_colliding_identifiers_are_told_apart(spark, odd, monkeypatch):
    """With identifiers of 3 bits, lists of other chunks look equal but for what the digests say."""
    df = odd.select("doc_id", "text").union(spark.createDataFrame([(200 + i, t * 2 + str(i % 3)) for i, t in enumerate(SCRIPTS * 3)], "doc_id long, text string"))
    want = rows(exact_dedup.exact_dedup(df))
    monkeypatch.setattr(exact_dedup, "chunk_id", lambda c: F.xxhash64(c).bitwiseAND(F.lit(7)))
    store = exact_dedup.chunk_store(exact_dedup.recipes(df))
    assert exact_dedup.shared_ids(store).count() > 20
    same(rows(exact_dedup.exact_dedup(df)), want)


# -- 6 and 9


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])


def test_quality_classifier(spark, odd, none, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = rows(quality_classifier.quality_scores(docs.select("doc_id", "text"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")).select("body.doc_id", "held_out", "score", "predicted"))
    held = [r for r in got if r["held_out"] and r["doc_id"] in known]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)
    assert auc([(r["score"], known[r["doc_id"]]) for r in held]) > 0.97
    out = quality_classifier.quality_scores(odd, labels).select("body.*")
    assert out.columns == odd.columns and out.count() == odd.count()
    assert quality_classifier.quality_scores(none, labels).count() == 0
    assert {r["score"] for r in rows(quality_classifier.quality_scores(odd, labels.limit(0)))} == {0.5}


def plain_features(text, bits):
    """Hashed words, pairs, shapes and pairs of shapes of a text, in plain Python."""
    import xxhash

    h, full = xxhash.xxh3_64_intdigest, (1 << 64) - 1

    def mix(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> shift)) * factor & full
        return x ^ (x >> 31)

    def shape(w):
        kind = "".join("a" if "a" <= c <= "z" or ord(c) > 127 else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else c for c in w.encode().decode("latin-1"))
        return re.sub(r"(.)\1+", r"\1", kind, flags=re.S).encode("latin-1")

    words = WORD.findall(text or "")
    out, last, last_shape = [], 0, 0
    for i, w in enumerate(words):
        word, of = h(w.encode()), h(b"=") if i and words[i - 1] == w else h(b"s" + shape(w))
        before_shape = 0 if not i else h(b"s" + shape(words[i - 1]))
        out += [mix(word), mix((word + last * 0x9E3779B97F4A7C15) & full), mix(of), mix((of + before_shape * 0x9E3779B97F4A7C15) & full)]
        last = word
    return [x & ((1 << bits) - 1) for x in out], len(words)


def test_ftrl_against_plain_python(spark):
    """Weights of a model learned from a few documents, coordinate by coordinate."""
    docs = [(i, t, i % 2) for i, t in enumerate(["good words here", "BAD!!! bad bad $$$", "more good words", "x1 x1 x22 ***", "", "naïve café words"]) if zlib.crc32(str(i).encode()) % 4 != 2]
    df = spark.createDataFrame(docs, "doc_id long, text string, quality int")
    got = np.frombuffer(quality_classifier.train(df.select("doc_id", "text"), df.select("doc_id", "quality"), bits=12, epochs=2), "<f4")
    order = {r["doc_id"]: r["o"] for r in df.select("doc_id", F.xxhash64("doc_id").alias("o")).collect()}
    z, n = Counter(), Counter()
    alpha, beta, l1, l2 = quality_classifier.ALPHA, quality_classifier.BETA, quality_classifier.L1, quality_classifier.L2
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for _ in range(2):
        for _, text, y in sorted(docs, key=lambda d: order[d[0]]):
            buckets, words = plain_features(text, 12)
            values = {b: c / max(1, words) for b, c in Counter(buckets).items()} | {1 << 12: 1.0}
            w = {i: weight(i) for i in values}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in values.items())))
            for i, v in values.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    assert np.allclose(got, [weight(i) for i in range((1 << 12) + 1)], atol=1e-5)


def test_language_by_compressed_sizes(spark, small):
    """Predictions are the language whose dictionary makes a text smallest, by compressors made here."""
    import zstandard

    known = language_id.dictionaries(small)
    how = zstandard.ZstdCompressionParameters.from_level(language_id.LEVEL, min_match=language_id.MIN_MATCH, write_content_size=0, write_dict_id=0)
    packers = {k: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how) for k, raw in known.items()}
    got = {r["doc_id"]: r["lang_pred"] for r in rows(language_id.language_id(small))}
    for r in small.collect():
        if r["text"] and re.search(r"[^\W\d_]", r["text"]):
            sizes = {k: len(p.compress(language_id.words_only(r["text"]))) for k, p in packers.items()}
            assert got[r["doc_id"]] == min(sorted(sizes), key=sizes.get)


def test_very_long_texts(spark, labels):
    """One text of over a million characters among empty ones, through every operator."""
    long = " ".join(f"w{i * i % 9973} x{i % 31}" for i in range(90_000)) + "\n" + "one more line that is quite a bit longer than forty characters\n" * 3000
    df = spark.createDataFrame([(1, long, "en", "a"), (2, "", "fr", None), (3, None, None, "a"), (4, long + " x", "en", "b")], "doc_id long, text string, lang string, source string")
    assert len(long) > 1_000_000
    runs = [line_dedup.line_dedup, mixing.mix, lm_scoring.lm_scores, exact_dedup.exact_dedup, quality_rules.quality_rules, language_id.language_id, license_scan.license_scan, ngram_join.ngram_join]
    got = {f.__name__: rows(f(df).select("*")) for f in runs}
    assert all(len(r) == 4 for r in got.values())
    assert quality_classifier.quality_scores(df, labels).count() == 4 and packing.packing(df).agg(F.sum("length")).first()[0] > 300_000
    assert {r["doc_id"]: r["component_id"] for r in got["ngram_join"]} == {1: 1, 2: 2, 3: 3, 4: 1}


def test_language_id(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = rows(language_id.language_id(docs))
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    by_text = [(r["text"], x["lang_pred"], x["score"]) for r, x in zip(odd.collect(), rows(language_id.language_id(odd)), strict=True)]
    assert {(p, s) for t, p, s in by_text if t in (None, "", " \t\n", "###*** $$$ !!!")} == {("und", 0.0)}
    assert all(p == "en" or p == "fr" for t, p, _ in by_text if t and re.search("[a-z]", t))
    assert language_id.language_id(none).count() == 0
    assert {r["lang_pred"] for r in rows(language_id.language_id(docs.limit(5).withColumn("lang", docs["lang"].cast("string")).filter("lang is null")))} == set()


def test_language_dictionaries_hold_whole_documents(spark):
    head = "shared header of all documents " * 100
    docs = spark.createDataFrame([(i, head + ("ende der seite" if i % 2 else "bas de la page"), "de" if i % 2 else "fr") for i in range(60)], "doc_id long, text string, lang string")
    known = language_id.dictionaries(docs)
    assert b"ende der seite" in known["de"] and b"bas de la page" in known["fr"]
    few = language_id.dictionaries(docs, max_chars=len(head) + 100)
    assert all(k.count(b"seite") + k.count(b"page") == 2 for k in few.values())


# -- 7


def plain_join(table):
    sets = {}
    for i, t in table:
        w = WORD.findall(low(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [{"doc_id": i, "n_shingles": len(s), "component_id": find(i)} for i, s in sets.items()]


def test_ngram_join(spark, odd, small, none):
    unique = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    for df in (unique, small):
        same(rows(ngram_join.ngram_join(df)), plain_join([(r["doc_id"], r["text"]) for r in df.collect()]))
    got = rows(ngram_join.ngram_join(odd))
    assert len(got) == odd.count() and [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert ngram_join.ngram_join(none).count() == 0


def test_ngram_join_on_edited_copies(spark):
    """Copies with growing numbers of edits: chains, pairs at the threshold, and copies too far from all others."""
    import random

    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    table = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        table.append((i, " ".join(words[: rng.choice([60, 60, 50, 45])])))
    df = spark.createDataFrame(table, "doc_id long, text string")
    want = plain_join(table)
    same(rows(ngram_join.ngram_join(df)), want)
    assert 1 < len({r["component_id"] for r in want}) < 90


@pytest.mark.parametrize("a,b", [(1, 1), (3, 4), (7, 9), (100, 133), (100, 134)])
def test_bounds(a, b):
    k = ngram_join.needed(a, b)
    fits = lambda k: 4 * k >= 3 * (a + b - k)
    assert fits(k) and not fits(k - 1)
    assert ngram_join.prefix_length(a) == a - math.ceil(3 * a / 4) + 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 50), (7, 7)] + [(1000, 1001 + i) for i in range(30)]
    got = {r["u"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 50, 200: 50, **{1001 + i: 1000 for i in range(30)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# -- 8


def plain_rules(t):
    words = WORD.findall(t or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, g in enumerate(windows) if counts[g] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_rules(odd, small, none):
    for df in (odd, small):
        got = rows(quality_rules.quality_rules(df))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == Counter((r["doc_id"], *plain_rules(r["text"])) for r in df.collect())
        assert not any(r["kept"] and r["base_failed"] for r in got)
        assert all(r["kept"] == (not r["base_failed"] and r["failed_rules"] == "") for r in got)
    assert quality_rules.quality_rules(none).count() == 0


RUSSIAN = "Сегодня утром мы вышли из дома и пошли по длинной улице к реке, где уже ждали друзья с лодкой и сетями. Погода была тихая, вода стояла высоко, и старый рыбак сказал, что к полудню ветер переменится. Мы сели в лодку, взяли вёсла и медленно поплыли вниз по течению, разговаривая о том, что случилось зимой, и о людях, которых давно никто не видел."


def test_stop_words_apply_to_latin_letters_only(spark):
    df = spark.createDataFrame([(1, RUSSIAN), (2, "zzz qqq xxx " * 30), (3, " ".join(f"w{i} der die und" for i in range(30)))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(quality_rules.quality_rules(df))}
    assert got[1]["kept"] and got[1]["stop_word_share"] is None and "stop_word_share" in got[2]["failed_rules"] and got[3]["stop_word_share"] > 0.5


# -- 10

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_scan(t):
    words = TOKEN.findall(low(t))
    hits = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_license_scan(spark, odd, small, none):
    extra = spark.createDataFrame([(500, "The MIT License and mit-license, MIT LICENSE"), (501, "General Public License apache license"), (502, "permission is hereby granted")], "doc_id long, text string")
    for df in (odd.select("doc_id", "text").union(extra), small):
        got = rows(license_scan.license_scan(df))
        names = ("n_words", "n_base", "first_word", "last_word", "base_labels")
        assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == Counter((r["doc_id"], *plain_scan(r["text"])) for r in df.select("doc_id", "text").collect())
        assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert license_scan.license_scan(none).count() == 0


def test_each_template_gives_its_own_label_only(spark):
    known = license_scan.TEMPLATES
    names = list(known)
    texts = [(i, "Copyright 2001 some holder. " + known[n] + " Then other words follow.") for i, n in enumerate(names)]
    pairs = [(a, b) for a in names for b in names if a < b]
    texts += [(1000 + i, known[a] + "\n\nand the other part is under this one:\n\n" + known[b]) for i, (a, b) in enumerate(pairs)]
    texts += [(5000 + i, " ".join(known[n].split()[: len(known[n].split()) // 2])) for i, n in enumerate(names)]
    got = {r["doc_id"]: r for r in rows(license_scan.license_scan(spark.createDataFrame(texts, "doc_id long, text string"), phrases={}))}
    for i, n in enumerate(names):
        assert (got[i]["labels"], got[i]["score"]) == (n, 1.0)
        assert got[5000 + i]["labels"] == ""
    for i, pair in enumerate(pairs):
        assert got[1000 + i]["labels"] == ",".join(sorted(pair))


def plain_finds(text, known=None, min_found=0.8):
    """Every stretch of a text against every template, by the table of the longest common subsequence."""
    known = known or license_scan.TEMPLATES
    words = TOKEN.findall(low(text))
    best = {}
    for name, t in known.items():
        t = TOKEN.findall(low(t))
        table = np.zeros((len(words) + 1, len(t) + 1), int)
        for i, w in enumerate(words, 1):
            for j, x in enumerate(t, 1):
                table[i, j] = table[i - 1, j - 1] + 1 if w == x else max(table[i - 1, j], table[i, j - 1])
        if table[-1, -1] >= min_found * len(t):
            best[name] = table[-1, -1]
    return best


def test_finds_against_the_whole_table(spark):
    """Short notices with words taken out, put in and changed: a label is only given where a plain comparison allows it, and given
    where one notice fills the text and reaches the share clearly."""
    import random

    rng = random.Random(4)
    short = {n: t for n, t in license_scan.TEMPLATES.items() if len(t.split()) < 45}
    cases, clear = [], {}
    for i in range(60):
        name = rng.choice(list(short))
        words = short[name].split()
        rate = rng.choice([0.0, 0.05, 0.1, 0.4])
        cases.append((i, " ".join(rng.choice(["", "zz", w + " zz"]) if rng.random() < rate else w for w in words)))
        if rate == 0.0:
            clear[i] = name
    got = {r["doc_id"]: r["labels"] for r in rows(license_scan.license_scan(spark.createDataFrame(cases, "doc_id long, text string"), known=short, phrases={}))}
    for i, text in cases:
        allowed = plain_finds(text, short)
        labels = set(filter(None, got[i].split(",")))
        assert labels <= set(allowed) and len(labels) <= 1
        assert all(allowed[x] == max(allowed.values()) for x in labels)
        if i in clear:
            assert labels == {clear[i]}


def test_license_scan_with_words_on_each_line(spark):
    """A word before every 12 words of a notice; then as many foreign words as leave under 0.8 of a notice."""
    known = license_scan.TEMPLATES
    lined = lambda name, size, put: " ".join(w + (put if i % size == 0 else "") for i, w in enumerate(TOKEN.findall(low(known[name])), 1))
    names = [n for n in known if len(TOKEN.findall(low(known[n]))) > 24]
    cases = [(i, lined(n, 12, " rem")) for i, n in enumerate(names)] + [(100 + i, lined(n, 4, " zz zz zz")) for i, n in enumerate(names)]
    got = {r["doc_id"]: r for r in rows(license_scan.license_scan(spark.createDataFrame(cases, "doc_id long, text string"), phrases={}))}
    for i, n in enumerate(names):
        assert n in got[i]["labels"].split(",") and got[i]["score"] > 0.9
        assert got[100 + i]["labels"] == "" and got[100 + i]["score"] == 0
