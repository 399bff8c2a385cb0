"""Each corpus operator against a plain statement of its contract, on small tables with nulls, ties, repeated rows and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import mixing, near_dedup, packing, pii, quality_classifier, quality_rules, sharding, suffix_dedup, token_counts, top_k

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, kept string, n long"


def words(n, seed):
    r = random.Random(seed)
    return [r.choice("abcdefgh") + r.choice("aeiou") + r.choice("rstlnm") + r.choice(["", "er", "ing"]) for _ in range(n)]


def corpus():
    """About 90 rows: plain ones, copies, near copies, shared passages, junk, and every odd case."""
    rows = []
    passage = " ".join(words(60, 999))
    for k in range(40):
        text = " ".join(words(20 + 7 * k, k))
        if k % 5 == 0:
            text += "\n" + passage
        rows.append((k, text, ["en", "de", None][k % 3], [f"s{k % 4}", None][k % 7 == 0]))
    base = words(120, 5)
    for k in range(40, 50):
        near = list(base)
        near[(k * 13) % 120] = f"x{k}"
        rows.append((k, " ".join(near), "en", "s1"))
    rows += [(60, rows[3][1], "en", "s0"), (61, rows[3][1].upper(), "en", "s0"), (62, "", "en", "s0"), (63, None, None, None), (64, " \n\t ", "en", "s0"), (65, "one two", "en", "s9"), (66, "One  TWO", "en", "s9"),
             (67, "a", "en", "s9"), (68, "é ü 漢字 🙂 naïve", "en", "s9"), (69, "spam " * 300, "en", "s2"), (70, " ".join(words(5000, 77)), "de", "s2"), (71, "ab" * 400, "en", "s2"), (72, "x\n" * 80, "en", "s2")]
    return [(i, t, lang, s, None if t is None else len(t), "clash", "clash", "clash", 7) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5, "doc_id")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


TEXTS = {r[0]: r[1] or "" for r in corpus()}


def shingles(text, k):
    w = [x for x in re.split(rb"[\x20\x09-\x0d]+", text.encode().lower()) if x]
    return set(zip(*(w[i:] for i in range(k)))) if len(w) >= k else ({tuple(w)} if w else set())


def linked(texts, k, percent):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return sets, {i: find(i) for i in texts}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, k, percent):
    sets, parent = linked(TEXTS, k, percent)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, k=k, percent=percent).collect()}
    assert got == {i: (len(sets[i]), parent[i]) for i in TEXTS}


def test_near_duplicates_odd_rows(spark, empty):
    rows = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    got = collections.Counter((r["id"], r["component_id"]) for r in near_dedup.near_duplicates(rows).collect())
    assert got == {(None, None): 1, (1, 1): 2, (2, 1): 1, (3, 3): 1}
    assert near_dedup.near_duplicates(empty).count() == 0


def test_densified_bins_agree_with_similarity():
    rng = np.random.default_rng(1)
    orders = np.argsort(np.random.default_rng(7).random((336, 336)), axis=1)
    a = np.unique(rng.integers(0, 2**63, 30, dtype=np.uint64) * np.uint64(2))
    b = np.sort(np.concatenate([a[3:], np.unique(rng.integers(0, 2**63, 3, dtype=np.uint64))]))
    sig = near_dedup.signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([np.sort(a), b]), 2, 336, orders)
    assert abs((sig[0] == sig[1]).mean() - 27 / 33) < 0.15 and (sig != 0).all()


def dense_group(n=160, length=140, seed=8):
    """Copies of one text with few to many words replaced: many are linked, many others a little less alike than a link."""
    r = random.Random(seed)
    base, pool, out = words(length, seed), words(400, seed + 1), {}
    for i in range(n):
        text = list(base)
        for at in r.sample(range(length), r.randint(0, 12)):
            text[at] = r.choice(pool)
        out[i] = " ".join(text)
    return out


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_no_link_is_lost_in_a_dense_group(spark, k, percent):
    texts = dense_group()
    _, parent = linked(texts, k, percent)
    assert 2 < len(set(parent.values())) < len(texts) - 20
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["id"]: r["component_id"] for r in near_dedup.near_duplicates(df, k=k, percent=percent).collect()} == parent


def test_parities_bound_the_difference():
    rng = np.random.default_rng(5)
    for size, gone in ((5, 2), (150, 20), (600, 300), (4000, 10)):
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, gone, dtype=np.uint64)]))
        bits = near_dedup.parities(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2)
        differ = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
        real = len(np.setxor1d(a, b))
        assert differ <= real and (real > 100 or differ > 0.9 * real)


@pytest.mark.parametrize("size", [7, 20, 60, 400])
def test_pairs_at_the_threshold_share_a_bucket(size):
    """Recall of the buckets on pairs that are just links; bins of short sets are mostly densified and depend on each other."""
    rng, bands, rows = np.random.default_rng(size), 48, 7
    orders = np.argsort(np.random.default_rng(7).random((bands * rows, bands * rows)), axis=1)
    changed, tries, met = int(size * 0.15 / 1.85), 400, 0
    for _ in range(tries):
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        b = np.sort(np.concatenate([rng.permutation(a)[changed:], rng.integers(0, 2**64, changed, dtype=np.uint64)]))
        sig = near_dedup.signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2, bands * rows, orders).reshape(2, bands, rows)
        met += bool((sig[0] == sig[1]).all(axis=1).any())
    assert met >= tries - 1, met


@pytest.mark.parametrize("most", [0, 1000])
def test_long_chains_are_one_component(spark, most):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (7, 7)], "u long, v long")
    got = {r["id"]: r["component"] for r in near_dedup.components(edges, most=most).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100}


def best_split(word, scores, unknown):
    best = [(0, 0)] + [None] * len(word)
    for e in range(1, len(word) + 1):
        found = [(best[s][0] + scores[word[s:e]], best[s][1] - 1) for s in range(e) if word[s:e] in scores]
        if word[e - 1 : e] not in scores or not found:
            found.append((best[e - 1][0] + unknown, best[e - 1][1] - 1))
        best[e] = max(found)
    return -best[-1][1]


@pytest.mark.parametrize("most_nodes", [1_000_000, 200])
def test_token_counts(docs, empty, most_nodes):
    import public_tokenizers

    scores = token_counts.scores_of(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    unknown = token_counts.Trie(scores).unknown
    got = {r["id"]: (r["n_bytes"], r["n_pretokens"], r["n_tokens"]) for r in token_counts.token_counts(docs, most_nodes=most_nodes).collect()}
    for i, t in TEXTS.items():
        parts = token_counts.PRETOKEN.findall(t.encode())
        assert b"".join(parts) == t.encode()
        assert got[i] == (len(t.encode()), len(parts), sum(best_split(p, scores, unknown) for p in parts))
    assert token_counts.token_counts(empty).count() == 0


def test_hilbert_is_a_walk_of_neighbours():
    for bits, dims in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        order = np.argsort(sharding.hilbert(cells, bits))
        assert sorted(sharding.hilbert(cells, bits)) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_sharding(docs, empty, law, tmp_path):
    rows = sharding.shard_plan(docs, sharding.DIMS, law=law).collect()
    assert sorted(r["id"] for r in rows) == sorted(TEXTS)
    assert all(r["size"] == len(TEXTS[r["id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(TEXTS[r["id"]].encode()) for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in by.values())
    if law == "rows":
        assert {len(s) for s in by.values()} <= {len(rows) // 24, len(rows) // 24 + 1} and len(by) == 24
    ordered = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    plain = sorted(rows, key=lambda r: (r["hilbert"], r["text_crc32"], r["id"]))
    assert [r["id"] for r in ordered] == [r["id"] for r in plain]
    if law == "bytes":  # a row belongs to the shard that holds its middle byte
        whole, before = sum(r["size"] for r in rows), 0
        for r in plain:
            assert r["shard"] == min((2 * before + r["size"]) * 24 // (2 * whole), 23)
            before += r["size"]
    assert sharding.shard_plan(empty, sharding.DIMS, law=law).count() == 0
    if law == "rows":
        sharding.write_shards(docs, str(tmp_path / "out"), sharding.DIMS)
        back = docs.sparkSession.read.parquet(str(tmp_path / "out"))
        assert back.count() == len(rows) and set(docs.columns) <= set(back.columns)


def test_shards_of_repeated_and_null_ids(spark, tmp_path):
    """Ties in every key: nothing is lost or doubled, and slots have no gaps."""
    rows = [(1, "a b", "en", "s", 3, "x")] * 5 + [(None, f"t{k % 3}", "de", None, 2, "y") for k in range(9)] + [(2, None, None, None, None, "z"), (2, "other", "en", "s", 5, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, SLOT string")
    sharding.write_shards(docs, str(tmp_path / "odd"), sharding.DIMS, shards=3)
    back = spark.read.parquet(str(tmp_path / "odd"))
    assert collections.Counter((r["doc_id"], r["text"]) for r in back.collect()) == collections.Counter(r[:2] for r in rows)
    slots = collections.defaultdict(list)
    for r in back.collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 3


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)], "clash") for i in range(400)]
    rows += [(400 + i, rows[50][1], "clash") for i in range(30)] + [(50, rows[50][1], "again"), (900, None, ""), (950, [1.0, None] * 4, ""), (1000, [float("nan")] * 8, ""), (1050, [float("inf")] * 8, ""), (None, rows[1][1], "")]
    got = top_k.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string"), F.col("vec_id") % 50 == 0, pivots=6, sample=40).collect()
    live = [(i, np.floor(256 * np.array(v))) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = collections.Counter()
    for a, (i, q) in enumerate(live):
        if i % 50 == 0:
            best = sorted(((-int(q @ x), j) for b, (j, x) in enumerate(live) if b != a))[:5]
            want.update((i, rank, j, -s) for rank, (s, j) in enumerate(best, 1))
    assert collections.Counter((r["query_id"], r["rank"], r["id"], r["score"]) for r in got) == want
    assert top_k.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_the_pivot_table_eliminates(spark):
    """Vectors in clusters: blocks, strips and single vectors are left out, and the result is that of all pairs."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 12)) * 3
    x = np.concatenate([c + rng.normal(size=(200, 12)) * 0.1 for c in centres])
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = top_k.whole(x, 256.0)
    ids = rng.permutation(len(x))
    some = rng.permutation(len(x))[:400]
    table = top_k.choose_pivots(x[some], 16)
    far = top_k.distances(x, table).astype(np.float32).astype(np.float64)
    asked = np.flatnonzero(ids % 50 == 0)
    queries = (ids[asked], ids[asked], x[asked], far[asked])
    best = top_k.Best(queries, top_k.floors(queries, ids[some], x[some], 5), 5)
    order = np.lexsort((far.min(axis=1), far.argmin(axis=1)))
    for at in range(0, len(x), 512):
        part = order[at : at + 512]
        best.meet((ids[part], ids[part], x[part], far[part]))
    assert best.pairs == len(asked) * len(x) and best.scored < 0.2 * best.pairs, best.scored / best.pairs
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    for r in range(len(asked)):
        want = np.lexsort((ids, -scores[r]))[:5]
        mine = best.row == r
        assert best.cand[mine].tolist() == ids[want].tolist() and best.score[mine].tolist() == scores[r][want].tolist()


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(top_k, "BLOCK", 32)
    monkeypatch.setattr(top_k, "ASKED", 8)
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=6)]) for i in range(700)]
    got = top_k.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 7 == 0, pivots=5, sample=30).collect()
    x = np.floor(256 * np.array([v for _, v in rows]))
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    want = {(i, r + 1, int(j), int(scores[i, j])) for i in range(0, 700, 7) for r, j in enumerate(np.lexsort((np.arange(700), -scores[i]))[:5])}
    assert {tuple(r) for r in got} == want


def removed(texts, length):
    seen, out = set(), {}
    for i in sorted(texts):
        raw = texts[i].encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            if s in seen:
                gone[k : k + length] = True
            seen.add(s)
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        out[i] = (len(raw), int(gone.sum()), int((edges == 1).sum()), bytes(np.frombuffer(raw, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("length", [100, 40])
def test_suffix_dedup(docs, empty, length):
    got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(docs, length=length).collect()}
    assert got == removed(TEXTS, length)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_crowded_classes_are_dealt_again(spark):
    texts = {i: "".join(random.Random(i % 7).choices("abcd", k=90)) + "The same middle of some length that all of these share, word for word, on and on." + "".join(random.Random(i).choices("abcd", k=90)) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    found = suffix_dedup.settle_table(suffix_dedup.anchored(docs, "doc_id", "text", 100, 16))
    assert found.where("class is not null").count() > 0
    more = suffix_dedup.sorted_runs(docs, found.where("class is not null"), "doc_id", "text", 100, 16, crowd=5, most=2000)
    gone = collections.defaultdict(set)
    for r in found.where("class is null").unionByName(more).collect():
        gone[r["id"]] |= set(range(r["lo"], r["stop"]))
    assert {i: len(gone[i]) for i in texts} == {i: x[1] for i, x in removed(texts, 100).items()}


def low_passage():
    """32 bytes whose hash is low, so that nearly every window over them has them for its anchor."""
    rng = np.random.default_rng(2)
    text = rng.choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8), 4_000_000)
    powers = suffix_dedup.Powers()
    sums = powers.sums(text)
    grams = (sums[32:] - sums[:-32]) * powers.down[: len(text) - 31]
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    at = int(grams.argmin())
    return text[at : at + 32].tobytes().decode()


def test_a_class_of_thirty_thousand_texts(spark):
    r, passage = random.Random(5), low_passage()
    side = lambda: "".join(r.choices("abcdefgh ", k=90))
    few = [side() for _ in range(400)]
    texts = {i: r.choice(few) + passage + r.choice(few) for i in range(30_000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    got = {r["id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(docs).select("id", "n_removed", "n_spans").collect()}
    assert got == {i: x[1:3] for i, x in removed(texts, 100).items()}


def test_suffix_dedup_of_null_and_repeated_ids(spark):
    a, b = "".join(random.Random(1).choices("abcd ", k=300)), "".join(random.Random(2).choices("abcd ", k=300))
    rows = [(None, a), (None, a), (None, b), (None, None), (5, a), (6, b[:200] + "x" + a[50:]), (7, "short"), (7, "short"), (8, a * 3), (9, "z" * 90 + b), (9, "z" * 90 + b), (9, "y" * 99)]
    got = collections.Counter((r["id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == {(None, 300, 0): 3, (None, 0, 0): 1, (5, 300, 300): 1, (6, 451, 450): 1, (7, 5, 0): 2, (8, 900, 900): 1, (9, 390, 300): 2, (9, 99, 0): 1}


def test_suffix_dedup_of_rows_that_repeat(spark):
    """Without other odd ids: equal rows keep their text, and what is later than both goes."""
    a = "".join(random.Random(1).choices("abcd ", k=300))
    rows = [(2, a), (2, a), (1, "x" * 20 + a[:150]), (4, a[100:]), (4, a[100:])] + [(k, a[k:]) for k in range(10, 40)]
    for parts in (1, 4):
        got = collections.Counter((r["id"], r["n_removed"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect())
        assert got == {(1, 0): 1, (2, 150): 2, (4, 200): 2, **{(k, 300 - k): 1 for k in range(10, 40)}}


def test_long_lengths_fit_a_run(spark):
    r = random.Random(4)
    shared = "".join(r.choices("abcdefgh ", k=900))
    texts = {i: "".join(r.choices("abcdefgh ", k=200)) + shared[i * 7 :] for i in range(12)}
    got = {x["id"]: x["n_removed"] for x in suffix_dedup.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), length=500).collect()}
    assert got == {i: x[1] for i, x in removed(texts, 500).items()}


def test_suffix_array():
    for seed in range(40):
        r = random.Random(seed)
        s = np.array([r.randint(1, r.choice([2, 3, 250])) for _ in range(r.randint(1, 300))], np.int64)
        assert suffix_dedup.suffix_array(s, 10**6).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        depth = r.choice([3, 10, 40])
        order = suffix_dedup.suffix_array(s, depth).tolist()
        assert sorted(order) == list(range(len(s)))
        heads = [s[i : i + depth].tolist() for i in order]
        assert heads == sorted(heads)


def test_suffix_array_of_large_letters():
    for seed in range(20):
        r = random.Random(seed)
        few = [r.randint(1, 2**30 - 1) for _ in range(6)]
        s = np.array([r.choice(few) for _ in range(300)], np.int64)
        assert suffix_dedup.suffix_array(s, 10**6).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    with pytest.raises(ValueError):
        suffix_dedup.suffix_array(np.array([1, 2**30, 2, 3], np.int64), 10)


def test_repeats_in_a_group_of_many_bytes():
    rng = np.random.default_rng(3)
    distinct = rng.integers(0, 256, (20_000, 150), dtype=np.uint8)
    text = np.concatenate([distinct, distinct[rng.permutation(20_000)]]).ravel()
    starts = (np.arange(40_000)[:, None] * 150 + np.arange(0, 50, 7)).ravel()
    gone = suffix_dedup.repeated_starts(text, starts, 100, np.arange(len(starts)))
    assert (gone == (starts >= 20_000 * 150)).all()


def statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    at = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(at)


def test_quality_statistics(docs, empty):
    rows = quality_rules.judge(docs, carry=["doc_id"]).collect()
    for r in rows:
        n, chars, symbols, dup, repeat = statistics(TEXTS[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat), r["doc_id"]
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n) and not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(empty).count() == 0
    clash = quality_rules.judge(docs)
    assert clash.columns.count("kept") == 1 and clash.schema["kept"].dataType.simpleString() == "boolean"


def test_estimates_resist_outliers(spark):
    rng = np.random.default_rng(4)
    good = np.round(rng.multivariate_normal([300, 200, 50, 10], np.diag([40.0, 30, 30, 30]) ** 2, 800)).astype(int)
    bad = np.round(rng.normal([300, 200, 600, 10], 5, (200, 4))).astype(int)
    rows = [("g", *map(int, x)) for x in np.concatenate([good, bad])]
    found = quality_rules.estimates(spark.createDataFrame(rows, "g string, x0 long, x1 long, x2 long, x3 long").repartition(3)).first()
    assert abs(found["m2"] - 50) < 8 and 20 < found["l22"] < 60
    d2 = ((600 - found["m2"]) / found["l22"]) ** 2
    assert d2 > 100


def plain_estimate(x, share=0.75, steps=6):
    """The minimum covariance determinant of one group by the same steps, on all rows at once."""
    floor, p = 24.0, x.shape[1]

    def shape(rows, factor):
        m = rows.mean(axis=0)
        return m, factor * ((rows.T @ rows) / len(rows) - np.outer(m, m)) + floor**2 * np.eye(p)

    def far(m, c):
        z = np.linalg.solve(np.linalg.cholesky(c), (x - m).T)
        return (z**2).sum(axis=0)

    point = quality_rules.chi2_point(share, p // 2)
    factor = share / quality_rules.chi2_even(point, p // 2 + 1)
    q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    found = []
    for m, c in (shape(x, 1.0), (q2, np.diag(np.maximum((q3 - q1) / 1.349, floor) ** 2))):
        for _ in range(steps):
            bins = np.floor(16 * np.log2(1 + far(m, c))).astype(int)
            order = np.sort(np.unique(bins))
            before = np.array([(bins < b).sum() for b in order])
            m, c = shape(x[np.isin(bins, order[before < share * len(x)])], factor)
        found.append((np.linalg.slogdet(c)[1], m, c))
    _, m, c = min(found, key=lambda f: f[0])
    return shape(x[far(m, c) <= quality_rules.chi2_point(0.975, p // 2)], 0.975 / quality_rules.chi2_even(quality_rules.chi2_point(0.975, p // 2), p // 2 + 1))


def test_the_verdict_is_that_of_a_plain_estimate(spark):
    """Two languages and three sources, one of them too small for an estimate of its own."""
    r = random.Random(11)
    rows = []
    for k in range(520):
        lang, source = r.choice(["en", "de"]), r.choice(["a", "a", "b"]) if k > 30 else "rare"
        text = words(r.randint(55, 260), k)
        for _ in range(r.choice([0, 0, 0, 1, 4, 60])):
            text[r.randrange(len(text))] += r.choice(["#", "***", "%&"])
        if k % 9 == 0:
            text = [w * r.choice([1, 3, 6]) for w in text]
        if k % 11 == 0:
            text += text[: r.randint(3, 40)]
        rows.append((k, " ".join(text), lang, source))
    rows += [(1000 + k, "too short", "en", "a") for k in range(5)]
    out = [x.asDict() for x in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)).collect()]
    live = [x for x in out if not x["base_failed"]]
    raw = lambda x: (x["n_words"], x["word_chars"], x["n_symbols"], x["n_repeat_words"])
    of = lambda n, chars, symbols, repeat: [math.log1p(n), 2 * math.log(chars / n), math.log1p(200 * symbols / chars), math.log1p(20 * repeat / n)]
    points = {x["doc_id"]: np.array([math.floor(64 * v + 0.5) for v in of(*raw(x))], float) for x in live}
    groups = collections.defaultdict(list)
    for x in live:
        for level in ((x["lang"], x["source"]), (x["lang"],), ()):
            groups[level].append(points[x["doc_id"]])
    known = {level: plain_estimate(np.array(g)) for level, g in groups.items() if len(g) >= 80}
    assert ("en", "rare") not in known and ("en", "a") in known
    verdicts = collections.Counter()
    for x in live:
        m, c = next(known[level] for level in ((x["lang"], x["source"]), (x["lang"],), ()) if level in known)
        d = points[x["doc_id"]] - m
        d2 = float(d @ np.linalg.solve(c, d))
        assert x["distance2"] == pytest.approx(d2, rel=1e-6)
        assert x["kept"] == (d2 <= quality_rules.chi2_point(1 - 1e-7, 2))
        verdicts[x["kept"]] += 1
    assert verdicts[False] > 5 and verdicts[True] > 300 and not any(x["kept"] for x in out if x["base_failed"])


def test_outliers_are_rejected_and_clean_texts_kept(spark):
    rows = [(k, " ".join(words(80 + k % 50, k)), "en", "a") for k in range(200)] + [(1000 + k, "*** ".join(words(90, k)), "en", "a") for k in range(20)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[k] for k in range(200)) and not any(got[1000 + k] for k in range(20))


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: model.encode(t, add_special_tokens=False).ids + [0] for i, t in TEXTS.items()}
    rows = packing.pack(docs, keep_ids=True).collect()
    for i, whole in ids.items():
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert [x for r in mine for x in np.frombuffer(r["ids"], "<u4").tolist()] == whole
        assert all(r["doc_tokens"] == len(whole) and r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and r["length"] * 4 == len(r["ids"]) for r in mine)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(map(len, ids.values()))
    assert len(by) <= total / 1024 + 1 + 5
    assert packing.pack(empty).count() == 0


def test_encoder_agrees_with_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    from quire.llm.bpe import Encoder

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        mine = Encoder(f.read())
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(6)
    parts = ["'", " ", "  ", "\n", "s", "t", "re", "ve", "ll", "d", "m", "a", "B", "é", "1", "22", "!", "?", "\t", "漢", " ", "　", "🙂", "<|endoftext|>", "''", "$", "​", "٣", "\x1c", "\x85"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(3000)] + ["", "z" * 300, " " * 100]
    assert [x.tolist() for x in mine.ids(texts)] == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


def test_classifier_learns_and_labels_are_no_inputs(spark):
    good = [(k, " ".join(words(60 + k % 40, k)) + ".", 1) for k in range(300)]
    bad = [(1000 + k, " ".join(words(60 + k % 40, k)).upper() + "!!", 0) for k in range(150)]
    rows = spark.createDataFrame(good + bad + [(5000, None, None), (5001, "", 1)], "doc_id long, text string, label int")
    model = quality_classifier.train(rows, rows.where("doc_id % 2 = 0").select("doc_id", "label"), label_col="label")
    got = {r["id"]: r["score"] for r in quality_classifier.score(rows, model).collect()}
    assert np.mean([got[k] >= 0.7 for k, _, _ in good if k % 2]) > 0.97 and np.mean([got[k] < 0.7 for k, _, _ in bad if k % 2]) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and got[5000] == got[5001]


def test_classifier_on_odd_rows(spark):
    """A text of a million characters, equal texts with either label, a repeated label, null ids."""
    rows = [(k, "same words again and again", k % 2) for k in range(40)] + [(100, "long " * 200_000, 1), (None, "no id", 1), (101, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(3)
    labels = docs.select("doc_id", "quality").unionByName(docs.select("doc_id", "quality").where("doc_id < 3"))
    model = quality_classifier.train(docs, labels)
    got = quality_classifier.score(docs, model).collect()
    assert len(got) == len(rows) and len({r["score"] for r in got if r["id"] is not None and r["id"] < 40}) == 1 and all(0 <= r["score"] <= 1 for r in got)


def test_classifier_without_labels(docs, empty):
    model = quality_classifier.train(docs, docs.sparkSession.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality_classifier.score(docs, model).collect()} == {0.5}
    assert quality_classifier.score(empty, model).count() == 0


def test_pairs_find_what_no_single_feature_shows():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_classifier.fit(x, y, rounds=60)
    assert ((model.scores(x) > 0.5) == (y > 0.5)).mean() > 0.9


def test_mixing(docs, empty):
    rows = [r.asDict() for r in mixing.mix(docs).collect()]
    sizes = collections.Counter()
    for r in rows:
        assert r["mix_size"] == len(re.findall(r"[^\x20\x09-\x0D]+", TEXTS[r["doc_id"]]))
        sizes[r["source"]] += r["mix_size"]
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    goal, full, left = {}, set(), 1.5 * sum(sizes.values())
    while True:  # share, stop those that are above, share again
        rate = left / sum(weight[s] for s in names if s not in full)
        over = [s for s in names if s not in full and rate * weight[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            full.add(s)
            goal[s] = 2 * sizes[s]
            left -= goal[s]
    goal.update({s: rate * weight[s] for s in names if s not in full})
    taken = collections.Counter()
    for r in rows:
        assert r["mix_source_size"] == sizes[r["source"]] and r["mix_target"] == pytest.approx(goal[r["source"]])
        assert 0 <= r["mix_taken"] <= 2 * r["mix_size"]
        taken[r["source"]] += r["mix_taken"]
    assert all(abs(taken[s] - goal[s]) < 1.001 for s in names)
    whole = mixing.expand(mixing.mix(docs))
    assert whole.columns == docs.columns
    n = whole.select(F.sum(F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")))).first()[0]
    assert n == sum(taken.values())
    assert mixing.mix(empty).count() == 0


def test_the_row_at_the_cut_keeps_its_words(spark):
    rows = [(k, "\n \t a b c d", "s", k, "x") for k in range(7)] + [(9, "x " * 30, "t", 1, "y"), (10, "\v", "t", 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_size long, mix_other string")
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    taken = collections.Counter()
    for r in out.collect():
        taken[r["source"]] += len(r["text"].split())
        assert (r["doc_id"], r["mix_size"], r["mix_other"]) in {(x[0], x[3], x[4]) for x in rows}
    want = {r["source"]: r["taken"] for r in mixing.mix(docs, prefix="my_").groupBy("source").agg(F.sum("my_taken").alias("taken")).collect()}
    assert taken == want and set(mixing.mix(docs).columns) == {*docs.columns, "mix_source_size", "mix_target", "mix_taken"}


def test_mixing_is_the_same_again_and_splits_ids_that_repeat(spark):
    rows = [(1, "a b c d", "x")] * 3 + [(2, "a b", "x"), (None, "c d e", "x"), (None, "f", None), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    once = sorted(map(repr, mixing.mix(df).collect()))
    assert once == sorted(map(repr, mixing.mix(df.repartition(4)).collect())) and len(once) == len(rows)


KEY = "of tests"
PEOPLE = [
    (1, "Write to Anna.Berg@mail.example.org or +1 (310) 555-4510; Frau Anna Berg, card 4111111111111111."),
    (2, "anna.berg@mail.example.org wrote; 13105554510? +1-310-555-4510 is hers. Mr Smith. 10.20.30.40"),
    (3, "clean text, version 3.1.4 of 2024-05-01, 12345 words"), (4, None), (5, ""), (6, '密码 token = "0123456789abcdef0123456789abcdef" 王伟先生'), (7, "Mr. John Smith and Mrs Smith"),
]


def test_pii(spark, empty):
    df = spark.createDataFrame(PEOPLE, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.replace(df, KEY).collect()}
    assert got[3] == PEOPLE[2][1] and got[4] is None and got[5] == ""
    for secret in ("Berg", "555-4510", "4111111111111111", "10.20.30.40", "0123456789abcdef", "王伟", "Smith"):
        assert not any(secret.lower() in (t or "").lower() for t in got.values()), secret
    mail = re.search(r"[\w.]+@[\w.]+", got[1])[0].lower()
    assert mail in got[2].lower()  # one person, one address
    digits = re.sub(r"\D", "", re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[1])[0])
    assert digits == re.sub(r"\D", "", re.search(r"\+1-\d{3}-\d{3}-\d{4}", got[2])[0])
    card = re.search(r"card (\d{16})", got[1])[1]
    assert card[0] == "4" and sum(sum(divmod(int(c) * (2 if k % 2 == 0 else 1), 10)) for k, c in enumerate(card)) % 10 == 0
    assert re.search(r'token = "[0-9a-f]{32}"', got[6]) and re.search(r"[一-鿿]{2}先生", got[6])
    assert re.fullmatch(r"Mr\. [A-Z]\w+ [A-Z]\w+ and Mrs [A-Z]\w+", got[7])
    first = re.match(r"Frau (\w+)", got[1][got[1].index("Frau") :])[1]
    assert first in pii.GIVEN["f"]
    assert pii.replace(empty, KEY).count() == 0
    assert sorted(map(repr, pii.replace(df.repartition(3), KEY).collect())) == sorted(map(repr, pii.replace(df, KEY).collect()))


def test_guards_lose_no_mention(spark):
    rows = [f"key {c}eadbee{k}0123456789deadbeef01234567 of {k}" for k, c in enumerate("0123456789abcdef")] + [r[1] for r in PEOPLE] + list(TEXTS.values()) + ["госпожа Ольга Белова", "г-н Белов", "Mme Blanc", "DE89 3704 0044 0532 0130 00", "王伟先生", "api_key: abcdefgh"]
    df = spark.createDataFrame([(t,) for t in rows], "text string").unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")).where("text is not null")
    unguarded = "|".join(f"(?:{p})" for p in pii.PATTERNS.values())
    got = pii.with_mentions(df, "text").where("pii__names is null").select("text", F.col("pii__found").alias("m"), F.regexp_extract_all("text", F.lit(unguarded), F.lit(0)).alias("every")).collect()
    assert [r["m"] for r in got] == [r["every"] for r in got] and any(r["m"] for r in got)
    assert all(len(r["m"]) == 1 for r in got if r["text"].startswith("key "))


def test_secrets_in_any_case(spark):
    low = "9233a8ecf7c5d1e0b4a69233a8ecf7c5d1e0b4a6"
    rows = [f"token = '{low}' here", f'TOKEN = "{low.upper()}" here', f"digest {low.upper()} here", f"digest {low} here", "Password: Tr0ubadour-x here", "API_KEY=tr0ubadour-x here", "ApiKey: DeadBeef here", f"long {low * 2} here", f"long {(low * 2).upper()} here", "SECRET:ABCDEFGHIJ here", f"hex {low[:20]}{low[20:].upper()} here"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["pii_entities"]) for r in pii.replace(df, KEY).collect()}
    assert all(got[i][1] == 1 and got[i][0] != t and got[i][0].endswith(" here") for i, t in enumerate(rows))
    text = [got[i][0] for i in range(len(rows))]
    made = re.fullmatch("token = '([0-9a-f]{40})' here", text[0])[1]
    assert text[1:4] == [f'TOKEN = "{made.upper()}" here', f"digest {made.upper()} here", f"digest {made} here"]  # one secret, one surrogate
    assert text[10] == f"hex {made} here" and text[8] == f"long {text[7].split()[1].upper()} here"
    assert re.fullmatch(r"Password: [A-Z][a-z]\d[a-z]{7}-[a-z] here", text[4]) and text[5].startswith("API_KEY=") and text[4][10:] != text[5][8:]  # case tells passwords apart
    assert re.fullmatch("ApiKey: [A-Z][a-z]{3}[A-Z][a-z]{3} here", text[6]) and re.fullmatch("SECRET:[A-Z]{10} here", text[9])


def names_of(text, pattern):
    return re.fullmatch(pattern, text).groups()


def test_mentions_of_a_person_stay_one_person(spark):
    name = r"(\w+)"
    rows = [
        (1, "Dr Anna Berg met Frau Anna Berg. Anna Berg left, and Berg called.", rf"Dr {name} {name} met Frau {name} {name}\. {name} {name} left, and {name} called\."),
        (2, "Mr John Smith, later Mr Smith and John Smith; Smithson stays.", rf"Mr {name} {name}, later Mr {name} and {name} {name}; Smithson stays\."),
        (3, "Call (310) 555-4510 or +1 310 555 4510 or 310-555-4510.", None),
        (4, "Prof Anna Berg, not Mr Paul Berg.", rf"Prof {name} {name}, not Mr {name} {name}\."),
        (5, "王伟先生来了。王伟说。", r"(\p{Han}+)".replace(r"\p{Han}", "[一-鿿]") + "先生来了。([一-鿿]+)说。"),
        (6, "Anna Berg is named without a title here.", None),
        (7, "госпожа Ольга Белова и господин Белов, Ольга Белова", rf"госпожа {name} {name} и господин {name}, {name} {name}"),
    ]
    got = {r["doc_id"]: r["text"] for r in pii.replace(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), KEY).collect()}
    found = {i: names_of(got[i], p) for i, _, p in rows if p}
    given, family = found[1][:2]
    assert found[1] == (given, family, given, family, given, family, family) and found[4][:2] == (given, family) and found[4][3] == family != found[2][1]
    assert found[2] == (found[2][0], found[2][1], found[2][1], *found[2][:2]) and given not in pii.GIVEN["m"] + pii.GIVEN["x"]
    assert found[5][0] == found[5][1] != "王伟" and len(found[5][0]) == 2
    assert found[7][:2] == found[7][3:] and found[7][2] not in ("Белов", found[7][1])
    a, b, c = (re.sub(r"\D", "", x) for x in re.findall(r"[(+\d][-()\d ]+\d", got[3]))
    assert a == c == b[1:] and b[0] == "1" and a != "3105554510" and got[6] == rows[5][1]


def test_han_names_do_not_run_out(spark):
    texts = [chr(0x738B) + chr(0x4E00 + k) + "先生" for k in range(1500)]  # more than the lists have
    got = [r["text"] for r in pii.replace(spark.createDataFrame([(t,) for t in texts], "text string"), KEY).collect()]
    assert len(set(got)) == len(texts) and all(len(t) == 4 and t.endswith("先生") for t in got) and not set(got) & set(texts)


def test_keys_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "Mr Smith, a@b.example", "old")], "doc_id long, text string, PII_entities string")
    one, other = pii.replace(df, KEY).first(), pii.replace(df, "another").first()
    assert one["text"] != other["text"] and one["pii_entities"] == 2 and len(one) == 3


def test_colliding_surrogates_are_hashed_again(spark):
    df = spark.createDataFrame([(i, f"host 10.0.{i // 250}.{i % 250 + 1} up") for i in range(600)], "doc_id long, text string")
    again = pii.hashed_again(df, "text", KEY).collect()
    got = [re.search(r"\d+\.\d+\.\d+\.\d+", r["text"])[0] for r in pii.replace(df, KEY).collect()]
    assert len(set(got)) == 600 and not set(got) & {f"10.0.{i // 250}.{i % 250 + 1}" for i in range(600)} and len(again) >= 0


def test_names_stay_apart_when_the_lists_are_short(spark):
    names = sorted({"".join(random.Random(k).choices("abcdefghij", k=6)).capitalize() for k in range(3000)})
    df = spark.createDataFrame([(i, f"Mr {n}") for i, n in enumerate(names)], "doc_id long, text string")
    assert pii.hashed_again(df, "text", KEY).count() > 0
    got = [r["text"] for r in pii.replace(df, KEY).collect()]
    assert len(set(got)) == len(names)


def test_most_frequent_word_is_counted_wherever_it_stands():
    share = quality_classifier.vector
    for text in ("first flood flood other flood flood last", "first second flood flood third flood last", "flood flood middle one flood last"):
        count = collections.Counter(text.split()).most_common(1)[0][1]
        assert share(text)[-2] == count / len(text.split())
    assert share("")[-2] == share(None)[-2] == 0


def test_every_query_block_is_met(spark):
    for wide in (1, 5, 65_536, 65_537, (1 << 20) + 3):
        got = top_k.numbered(spark.range(1), wide).agg(F.count("qb"), F.countDistinct("qb"), F.min("qb"), F.max("qb")).first()
        assert tuple(got) == (wide, wide, 0, wide - 1)


def test_a_very_long_text_through_every_operator(spark):
    long = " ".join(words(120_000, 3)) + " Frau Anna Berg, anna@mail.example.org\n"
    docs = spark.createDataFrame([(1, long, "en", "s"), (2, long, "en", "s"), (3, "a short one " * 30, "en", "s")], "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    n = len(long.split())
    assert {(r["id"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect()} == {(1, 1), (2, 1), (3, 3)}
    cut = {r["id"]: (r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert cut[2] == (len(long.encode()),) * 2 and cut[1][1] < 1000
    assert {r["id"]: r["n_bytes"] for r in token_counts.token_counts(docs).collect()}[1] == len(long.encode())
    assert sum(r["size"] for r in sharding.shard_plan(docs, sharding.DIMS).collect()) == 2 * (len(long) + 8) + 368
    assert {r["doc_id"]: (r["n_words"], r["base_failed"]) for r in quality_rules.judge(docs).collect()}[1] == (n, False)
    rows = packing.pack(docs).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == next(r["doc_tokens"] for r in rows if r["doc_id"] == 1) > n
    assert {r["doc_id"]: r["mix_size"] for r in mixing.mix(docs).collect()}[1] == n
    texts = {r["doc_id"]: r["text"] for r in pii.replace(docs, KEY).collect()}
    assert texts[1] == texts[2] and texts[1].split()[:120_000] == long.split()[:120_000] and "Berg" not in texts[1] and "anna@" not in texts[1]


def test_removed_bytes_digest():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
