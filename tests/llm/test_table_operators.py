"""Fingerprints, mixing, sharding, packing, similarity join and url filters."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from revtrack.llm import jaccard, mixing, ordering, packing, queries, shards, simhash, urls
from revtrack.llm.common import configure_batches, stage

from .conftest import odd_rows, prose

tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = tokenizers.path("word_bpe_49k.json")


@pytest.fixture(autouse=True)
def _batches(spark):
    configure_batches(spark)


# --- fingerprints ---


def test_fingerprints_equal_votes_in_memory(spark, odd):
    rows = [(i, prose(i, 30 + i), "en", "a", 0) for i in range(20)] + [(90, "a", "", "", 0), (91, "  a\n", "", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    words = [(i, w, b) for i, text, *_ in rows for w, b in zip(text.split(), [*text.split()[1:], None])]
    hashes = spark.createDataFrame(words, "doc_id long, a string, b string").select("doc_id", "a", "b", F.xxhash64("a", "b").alias("h")).collect()
    votes = defaultdict(lambda: [0] * 64)
    for r in hashes:
        weight = 1 + (len(r.a) > 3) + (len(r.b or "") > 3)
        for k in range(64):
            votes[r.doc_id][k] += weight if r.h >> k & 1 else -weight
    want = {i: sum(1 << k for k in range(64) if v[k] > 0) for i, v in votes.items()}
    got = {r.doc_id: r.fp % (1 << 64) for r in simhash.fingerprints(docs, ["doc_id"], "text").collect()}
    assert got == want and got[90] == got[91]
    odd_prints = {r.doc_id: r.fp for r in simhash.fingerprints(odd.select("doc_id", "text"), ["doc_id"], "text").collect()}
    assert odd_prints[1] == odd_prints[2] == odd_prints[3] == 0 and odd_prints[4] == odd_prints[5]


def test_search_finds_all_within_the_radius(spark):
    draw = random.Random(3)
    base = [draw.getrandbits(64) for _ in range(20)]
    prints = []
    for b in base:
        for _ in range(15):
            x = b
            for k in draw.sample(range(64), draw.randint(0, 6)):
                x ^= 1 << k
            prints.append(x - (1 << 64) if x >> 63 else x)
    prints += prints[:30]
    stored = spark.createDataFrame([(p,) for p in prints], "fp long")
    asked = spark.createDataFrame([(p,) for p in prints[::7]], "fp long")
    for radius, blocks in ((3, 6), (3, 4), (0, 1), (5, 8)):
        got = [(r.query, r.found, r.n) for r in simhash.near(asked, stored, radius, blocks).collect()]
        times = Counter(prints)
        want = {(q, f, times[f]) for q in set(prints[::7]) for f in times if bin((q ^ f) & (1 << 64) - 1).count("1") <= radius}
        assert len(got) == len(set(got)) and set(got) == want
    assert simhash.near(asked.limit(0), stored).count() == 0


def test_next_row_equals_a_sorted_list(spark, odd, none, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 7)
    draw = random.Random(8)
    ids = [draw.choice([draw.randint(-50, 50), draw.randint(0, 10**15), None]) for _ in range(400)]
    rows = [(i, f"t{n}", "", "", 0) for n, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    down = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = {a[1]: b[1] for a, b in zip(down, down[1:] + down[:1])}
    ranked, after = ordering.with_next(docs, "doc_id", ["text"], ["text"])
    assert {r.text: r.next_text for r in ranked.collect()} == want and after.count() > 20
    assert ordering.with_next(none, "doc_id", ["text"], ["text"])[0].count() == 0
    one = ordering.with_next(docs.where("text = 't0'"), "doc_id", ["text"], ["text"])[0].first()
    assert one.text == one.next_text
    assert ordering.with_next(odd, "doc_id", ["text"], ["text"])[0].count() == len(odd_rows())


def test_fingerprint_query_equals_edited_texts(spark, tmp_path):
    from revtrack.llm.queries import op4_simhash

    rows = [(i * 3, prose(i, 20 + i % 9), "en", "a", 0) for i in range(60)] + [(500, None, "en", "a", None), (501, "é", "en", "a", 1)]
    rows += [(600 + i, prose(7, 27), "en", "a", 0) for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    down = sorted(rows, key=lambda r: -r[0])
    got = {r.doc_id: r for r in op4_simhash(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    by_text = {}
    for (i, text, *_), (after, following, *_) in zip(down, down[1:] + down[:1]):
        text, following = text or "", following or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        same = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 64
        assert got[i].near_edited == same(got[i].fingerprint, got[i].edited_fingerprint)
        assert got[i].near_next == same(got[i].fingerprint, got[after].fingerprint)
        assert by_text.setdefault(text, got[i].fingerprint) == got[i].fingerprint
    for r in got.values():
        near = sum(bin(int(r.fingerprint, 16) ^ int(o.fingerprint, 16)).count("1") <= 3 for o in got.values()) - 1
        assert r.n_near == (near if r.doc_id % 50 == 0 else None)


# --- mixing ---


def fill(sizes: dict, weights=(5, 2, 1), cap=3):
    """Targets by sharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        rest = sum(weight[s] for s in order if s not in capped)
        target = {s: cap * sizes[s] if s in capped else weight[s] * left / rest for s in order}
        over = {s for s in order if s not in capped and target[s] > cap * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("seed", range(4))
def test_mix_meets_targets_exactly(table, seed):
    draw = random.Random(seed)
    sources = ["z", "a", "b", "é", None, "B", "c"][: 3 + seed]
    rows = [(i, prose(i, draw.randint(0, 30)), "en", draw.choice(sources[: 1 + i % len(sources)]), 0) for i in range(150)]
    docs = table(rows)
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(text.split())
    want, taken = fill(sizes), Counter()
    for r in got:
        taken[r.source] += r.taken
        assert abs(r.target - want[r.source]) < 1e-6 and r.taken <= 3 * r.size and r.source_size == sizes[r.source]
    assert {s: taken[s] for s in sizes} == {s: int(want[s] + 1e-9) for s in sizes}
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    out = mixing.mixed_documents(docs)
    words = Counter()
    for r in out.collect():
        words[r.source] += len(r.text.split())
    assert +words == +taken and out.columns == docs.columns


def test_prefix_sums_over_many_ranges(table, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 5)
    rows = [(i, prose(i, 1 + i % 9), "en", "ab"[i % 4 == 0], 0) for i in range(200)]
    few = {r.doc_id: r.taken for r in mixing.mix(table(rows)).collect()}
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 10_000)
    assert few == {r.doc_id: r.taken for r in mixing.mix(table(rows)).collect()}


def test_mix_of_odd_rows(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == len(odd_rows())
    assert all(r.taken == 0 for r in got if r.size == 0)
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns and {r.size for r in out.collect()} == {"size!"}
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


# --- sharding ---


def test_shards_are_balanced_and_numbered_without_gaps(spark):
    draw = random.Random(1)
    rows = stage(spark.createDataFrame([(i, int(draw.paretovariate(1.2) * 100) % 20_000 + 1) for i in range(4_000)], "doc_id long, size long").repartition(4))
    store = shards.new_store(spark, "test")
    got = shards.shard(rows, store, shards=8, order=("size",)).collect()
    bytes_, numbers = Counter(), defaultdict(list)
    for r in got:
        bytes_[r.shard] += r.size
        numbers[r.shard].append(r.slot)
    assert len(got) == 4_000 and max(bytes_.values()) / min(bytes_.values()) < 1.02
    assert all(sorted(v) == list(range(len(v))) for v in numbers.values())
    first, second = ({r.slot: r.shard for r in store.read(v).collect()} for v in (0, 1))
    assert len(first) == len(second) == shards.SLOTS and first != second
    # A map that is in use says where a record is: by its id's slot alone.
    assert all(second[r.virtual_slot] == r.shard for r in got)


def test_growing_moves_slots_into_the_new_shard_only(spark):
    sizes = spark.range(512).select(F.col("id").cast("int").alias("slot"), (F.col("id") % 17 + 1).alias("bytes"))
    old = shards.initial_map(spark, 4, 512)
    new = shards.grow(old, sizes, 4)
    before, after = ({r.slot: r.shard for r in m.collect()} for m in (old, new))
    assert all(after[s] in (before[s], 4) for s in before) and {r.version for r in new.collect()} == {1}
    load = Counter()
    for s, to in after.items():
        load[to] += s % 17 + 1
    assert max(load.values()) / min(load.values()) < 1.2


def test_shards_of_odd_rows(spark, odd, none):
    sized = lambda d: stage(d.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes_"), F.lit("x").alias("token")))
    got = shards.shard(sized(odd), shards.new_store(spark, "odd"), shards=3, size="bytes_").collect()
    numbers = defaultdict(list)
    for r in got:
        numbers[r.shard].append(r.slot)
    assert len(got) == len(odd_rows()) and all(sorted(v) == list(range(len(v))) for v in numbers.values())
    assert shards.shard(sized(none), shards.new_store(spark, "none"), shards=3, size="bytes_").count() == 0


# --- packing ---


def test_tokens_equal_those_of_whole_texts():
    tokenizer = packing.WordTokenizer(VOCABULARY)
    draw = random.Random(1)
    alphabet = "abAZ09'sS  \n\t.,#$<|>éÀßÿ×÷ñ½ªºİΣσ日́ \x1c\x7fdl'rm't_e"
    for i in range(2_000):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 25))) + "<|endoftext|>" * (i % 50 == 0)
        assert np.frombuffer(tokenizer.ids(text.encode()), "<u4").tolist() == tokenizer.whole.encode(text, add_special_tokens=False).ids, text


def test_windows_hold_all_pieces_within_capacity():
    draw = random.Random(2)
    for _ in range(50):
        sizes = sorted((draw.randint(1, 100) for _ in range(draw.randint(1, 120))), reverse=True)
        made = packing.windows(sizes, 100)
        assert sorted(i for w in made for i in w) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in w) <= 100 for w in made)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.difference([8, 7, 6, 5, 4], 2)) == [14, 16]
    assert len(packing.windows([8, 7, 6, 5, 4], 16)) == 2 and len(packing.windows([8, 7, 6, 5, 4], 15)) == 3
    assert packing.windows([], 5) in ([], [[]])


def test_packing_is_whole(spark, odd, none):
    # Enough documents for several groups.
    many = odd.select("doc_id", "text").union(spark.range(2_000).select(F.col("id") + 100, F.expr("repeat('word soup of some kind ', cast(id % 90 as int))")))
    got = packing.pack(packing.pieces(many, VOCABULARY)).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= packing.CAPACITY
    total = sum(n for parts in by_sequence.values() for _, n in parts)
    assert total / (len(by_sequence) * packing.CAPACITY) > 0.95
    tokenizer = packing.WordTokenizer(VOCABULARY)
    text = dict((r[0], r[1]) for r in odd_rows())[7]
    ids = tokenizer.ids(text.encode()) + (2).to_bytes(4, "little")
    parts = sorted(by_doc[7], key=lambda r: r.start)
    assert sum(r.length for r in parts) == len(ids) // 4 == parts[0].doc_tokens
    assert all(r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for r in parts)
    assert [(r.length, r.doc_tokens) for r in by_doc[1]] == [(1, 1)] and len(by_doc[5]) == 2
    assert packing.pack(packing.pieces(none, VOCABULARY)).count() == 0


BIG = 1 << 60  # a float rounds the ids beside it


def big_rows():
    base = prose(1, 120)
    return [(BIG + 1, base, "en", "a", 0), (BIG + 3, base + " extra", "en", "a", 0), (None, prose(2, 40), "en", "a", 0), (BIG + 5, prose(3, 9_000), "en", "b", 0)]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_packing_keeps_large_ids_beside_null(table, kind):
    docs = table(big_rows()).coalesce(1).withColumn("doc_id", F.col("doc_id").cast(kind))
    cut = packing.pieces(docs, VOCABULARY)
    for got in (cut, packing.pack(cut)):
        assert dict(got.dtypes)["doc_id"] == docs.dtypes[0][1]
        assert {None if r.doc_id is None else int(r.doc_id) for r in got.collect()} == {BIG + 1, BIG + 3, BIG + 5, None}


# --- similarity join ---


def brute_classes(rows, percent=75):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, row in enumerate(rows):
        ids[find(i)].append(row[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(row[0], len(sets[i]), least[find(i)]) for i, row in enumerate(rows)]


def near_copies(seed: int):
    """Groups that drift: each copy is an edit of the one before, so chains of links arise; a passage that most share."""
    draw = random.Random(seed)
    rows, passage = [], prose(99, 40)
    for g in range(12):
        words = prose(g + 100 * seed, draw.randint(3, 90)).split()
        for _ in range(draw.choice([1, 2, 9, 25])):
            for _ in range(draw.randint(0, 3)):
                words[draw.randrange(len(words))] = prose(draw.getrandbits(30), 1)
            rows.append((len(rows), " ".join(words) + (f" {passage}" if draw.random() < 0.6 else ""), "en", "a", 0))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_classes_equal_brute_force(table, seed):
    rows = near_copies(seed)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(table(rows).repartition(4)).collect()]
    assert sorted(got) == sorted(brute_classes(rows))


def test_components_of_a_chain(spark):
    draw = list(range(300))
    random.Random(1).shuffle(draw)
    links = spark.createDataFrame(list(zip(draw, draw[1:])) + [(1000, 1001), (1001, 1002), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in jaccard.components(links).collect()}
    assert got == {**dict.fromkeys(range(300), 0), **dict.fromkeys((1000, 1001, 1002), 1000)}


def test_prefixes_of_linked_sets_meet_in_every_order():
    draw = np.random.default_rng(1)
    counts = draw.integers(0, 200, 1 << jaccard.COUNT_BITS).astype(np.uint8)
    for _ in range(200):
        n = int(draw.integers(4, 60))
        common = draw.integers(0, 2**63, n).astype(np.uint64)
        extra = draw.integers(0, 2**63, n // 3).astype(np.uint64)
        cut = int(draw.integers(0, len(extra) + 1))
        a, b = np.unique(np.concatenate([common, extra[:cut]])), np.unique(np.concatenate([common, extra[cut:]]))
        assert 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
        for order in range(1, jaccard.ORDERS + 1):
            assert len(np.intersect1d(jaccard.prefix(a, counts, order), jaccard.prefix(b, counts, order)))


def test_cells_never_tell_less_than_the_common_prefix_tokens():
    draw = np.random.default_rng(5)
    for size in (1, 7, 300, 200_000):
        a = np.unique(draw.integers(0, 1 << 63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[: max(1, size - size // 8)], draw.integers(0, 1 << 63, size // 10).astype(np.uint64)]))
        common = [len(np.intersect1d(jaccard.prefix(a, None, k), jaccard.prefix(b, None, k))) for k in range(2, jaccard.ORDERS + 1)]
        rows = [pd.Series([jaccard.compact(x)[1]]) for x in (a, b)]
        assert jaccard._common_at_most.func(*rows)[0] >= min(common)


def test_classes_of_odd_rows(odd, none):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(odd).collect()]
    want = [(i, n, i if not n else c) for i, n, c in brute_classes(odd_rows())]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = jaccard.representatives(odd)
    assert kept.columns == odd.columns
    # The three without words stay; of 4, 5, 5 and 8 the first, of 9 and 10 the first.
    assert sorted((r.doc_id for r in kept.collect()), key=lambda i: i or 0) == [None, 1, 2, 3, 4, 7, 9]
    assert jaccard.classes(none).count() == 0 and jaccard.representatives(none).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_classes_keep_large_ids_beside_null(table, kind):
    docs = table(big_rows()).coalesce(1).withColumn("doc_id", F.col("doc_id").cast(kind))
    number = lambda i: -1 if i is None else int(i)
    got = sorted((number(r.doc_id), r.n_shingles, number(r.component_id)) for r in jaccard.classes(docs).collect())
    assert got == sorted((number(i), n, number(c)) for i, n, c in brute_classes(big_rows()))
    assert sorted(number(r.doc_id) for r in jaccard.representatives(docs).collect()) == [-1, BIG + 1, BIG + 5]


# --- url filters ---


def test_longest_key_wins_and_collisions_are_told_apart(spark):
    keys = ["com/en/", "example.com/en/7", "net/", "blocked.org"]
    store = urls.DigestArray(spark, spark.createDataFrame([(k,) for k in [*keys, "net/", None]], "key string"), {0, 1, 4, 5})
    rows = ["http://a.example.com/en/77?x", "https://A.COM/en/1", "x://m.blocked.org", "http://notblocked.org/", "http://net/", "http://xnet/", "nothing", None, "http://", "http:///en/", "http://é.net/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "i int, url string").select("i", urls.host_of(F.col("url")).alias("h"), urls.path_of(F.col("url")).alias("p"))
    got = {r.i: r.k for r in pages.select("i", store.longest_match(F.col("h"), F.col("p")).alias("k")).collect()}
    assert got == {0: "example.com/en/7", 1: "com/en/", 2: "blocked.org", 3: None, 4: "net/", 5: None, 6: None, 7: None, 8: None, 9: None, 10: "net/"}
    # Two strings under one digest: only the right one is confirmed.
    import xxhash

    digest = xxhash.xxh64_intdigest(b"b.org", urls.SEED)
    fake = [np.array([digest, digest], np.uint64), np.array([5, 10], np.uint64), np.frombuffer(b"a.orgb.org", np.uint8)]
    assert urls.longest_keys(fake, [0], ["b.org", "a.org"], ["", ""]) == ["b.org", None]
    empty = urls.DigestArray(spark, spark.createDataFrame([], "key string"), {0})
    assert pages.select(empty.longest_match(F.col("h"), F.col("p")).alias("k")).where("k IS NOT NULL").count() == 0


def test_long_lists_are_joined_with_the_same_result(spark, monkeypatch):
    keys = spark.createDataFrame([(k,) for k in ["com/en/", "example.com/en/7", "net/", "blocked.org", "net/", None]], "key string")
    hosts = ["a.example.com", "com", "m.blocked.org", "notblocked.org", "net", "xnet", "", "net.", "é.net", "blocked.org"]
    paths = ["/en/77", "/en/1", "", "/", "/", "/", "/", "/x", "/", "/en/"]
    rows = spark.createDataFrame(list(enumerate(zip(hosts, paths))), "i int, u struct<host string, path string>").select("i", "u.*")
    array = {r.i: r.k for r in urls.longest_keys_of(rows, keys, {0, 1, 4, 5}, "k").collect()}
    monkeypatch.setattr(urls, "MAX_FILE_BYTES", 0)
    joined = urls.longest_keys_of(rows, keys, {0, 1, 4, 5}, "k")
    assert joined.columns == ["i", "host", "path", "k"] and {r.i: r.k for r in joined.collect()} == array
    assert array[0] == "example.com/en/7" and array[2] == array[9] == "blocked.org" and array[3] is None and array[6] is None


def test_hosts_of_many_junk_pages_are_listed(spark):
    rows = [("bad.org", "a | b | c | d"), ("bad.org", "clean words")] + [("good.org", "clean words")] * 5 + [("good.org", "# # # #"), ("", "####"), ("none.org", None)]
    pages = spark.createDataFrame(rows, "host string, html string")
    assert [r.key for r in urls.junk_hosts(pages).collect()] == ["bad.org"]
    assert urls.junk_hosts(pages.limit(0)).count() == 0


def test_rules_have_the_verdicts_of_the_contract(spark, tmp_path):
    """One junk page makes `example.net` a listed host, so an allowing rule shows against it; other hosts are not listed."""
    rows = {
        "http://a.com/en/x": ("com/en/", "block"), "http://example.com/en/7x": ("example.com/en/7", "allow"), "http://b.net/de/x": ("net/de/", "allow"),
        "http://example.net/de/7": ("net/de/", "allow"), "http://example.net/de/8": ("example.net/de/8", "block"), "http://example.net/fr/": (None, "block"),
        "http://c.org/es/": ("org/es/", "block"), "http://c.org/en/": (None, "allow"),
    }
    pages = [(i, url, "#" * 50 if "example.net" in url else "text") for i, url in enumerate(rows)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in queries.op10_urls(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(rows))] == list(rows.values())
    assert queries.RULES == {("com", "/en/"): "block", ("example.com", "/en/7"): "allow", ("net", "/de/"): "allow", ("example.net", "/de/8"): "block", ("org", "/es/"): "block"}


def test_token_counts_are_handed_on_as_they_are_met(spark, table, monkeypatch):
    monkeypatch.setattr(jaccard, "COUNTED", 500)
    rows = [(i, prose(i % 90, 20 + i % 40), "en", "a", 0) for i in range(300)] + [(None, None, "en", "a", 0), (900, "", "en", "a", 0)]
    measured = jaccard.measure(table(rows).coalesce(1), "doc_id", "text")
    counted = measured.where("chunk is not null").groupBy("chunk").count()
    assert counted.agg({"count": "max"}).first()[0] > 2
    want = np.zeros(1 << jaccard.COUNT_BITS, np.uint32)
    for _, text, *_ in rows:
        np.add.at(want, (jaccard.shingles((text or "").encode()) >> np.uint64(64 - jaccard.COUNT_BITS)).astype(np.int64), 1)
    assert want.max() > 3
    assert (jaccard.count_table(measured) == np.minimum(np.log2(np.maximum(want, 1)) * 8, 255).astype(np.uint8)).all()
    assert not jaccard.count_table(measured.limit(0)).any()


def test_bitmaps_drop_far_pairs_and_never_a_link():
    draw = np.random.default_rng(11)
    for n in (4, 40, 1_270, 9_000):
        for share in (0.75, 0.9, 0.3):
            both = draw.integers(0, 1 << 63, int(n * share)).astype(np.uint64)
            a, b = (np.unique(np.concatenate([both, draw.integers(0, 1 << 63, extra).astype(np.uint64)])) for extra in ((n - len(both)), (n - len(both)) // 3))
            most = jaccard._common_at_most.func(*(pd.Series([jaccard.compact(x)[1]]) for x in (a, b)))[0]
            assert most >= len(np.intersect1d(a, b))
            # A link takes 75% of the union; sets of 1,270 tokens that had 30% in common could not be told from links by counts of a prefix.
            if share == 0.3 and n > 40:
                assert most < 0.75 * (len(a) + len(b)) / 1.75


def test_rows_that_stay_are_not_moved(spark, table):
    """The rows kept come from the table itself: lists too long to broadcast move the rows on them and no others."""
    rows = [(i, prose(i, 60), "en", "a", 0) for i in range(60)] + [(100 + i, prose(i, 60), "en", "b", 0) for i in range(20)] + [(5, prose(5, 60), "en", "a", 0)]
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jaccard.representatives(table(rows))
        assert sorted(r.doc_id for r in kept.collect()) == list(range(60))
        assert "BroadcastHashJoin" in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)


def test_worker_caches_are_held_one_at_a_time():
    from revtrack.llm.common import worker_cache

    cache = worker_cache("tokenizers")
    cache["path"] = "loaded"
    assert worker_cache("tokenizers") is cache
    worker_cache("sets")
    assert worker_cache("tokenizers") == {}


def test_readers_unpack_few_long_texts_at_a_time(spark):
    from revtrack.llm.common import configure_batches

    assert int(configure_batches(spark).conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 1_000
