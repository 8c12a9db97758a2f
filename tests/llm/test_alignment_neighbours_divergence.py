"""Token alignment, nearest neighbours and source divergence against brute force."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from revtrack.llm import alignment, divergence, neighbours
from revtrack.llm.common import configure_batches, stage

from .conftest import odd_rows, prose

tokenizers = pytest.importorskip("public_tokenizers")
A, B = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(autouse=True)
def _batches(spark):
    configure_batches(spark)


# --- alignment ---


def plain_alignment(texts):
    """Each text's result by going through tokens one by one."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    spelled = alignment._byte_of()
    assert ByteLevel().decode(["Ġab"]) == " ab" and len(spelled) == 256
    groups_of, links_of = [], []
    for text in texts:
        groups, links = [], []
        if text:
            xs = [(i, bytes(spelled[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            ys = []
            for i in b.encode(text):
                piece = b.id_to_piece(i)
                ys.append((i, bytes.fromhex(piece[3:5]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
            whole = b" " + text.encode()
            if b"".join(x for _, x in xs) == whole == b"".join(y for _, y in ys):
                spans = []
                for side in (xs, ys):
                    at, out = 0, []
                    for i, raw in side:
                        out.append((at, at + len(raw), i))
                        at += len(raw)
                    spans.append(out)
                both = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
                for lo, hi in zip([0, *both], both):
                    groups.append(tuple([i for s, e, i in side if lo <= s and e <= hi] for side in spans))
                links = [(i, j) for s, e, i in spans[0] for t, f, j in spans[1] if s < f and t < e]
        groups_of.append(groups)
        links_of.append(links)
    held = Counter(p for links in links_of for p in set(links))
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    out = []
    for groups, links in zip(groups_of, links_of):
        written = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((
            sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(held[p] == most[p[0]] for p in links),
            sum(held[p] for p in links), hashlib.sha256(written.encode()).hexdigest() if written else "",
        ))
    return out


def test_alignment_equals_going_through_tokens(spark, table):
    texts = [prose(i, 5 + 7 * i) for i in range(12)]
    texts += ["x", "  two  blanks\t\n", "naïve Straße — 漢字 and 🙂", "a▁b", "<|endoftext|> <s> </s> <unk> <0x41>", "\x00\x07", "don't we'll 1234567 1.5e-3", "ᏣᎳᎩ ꙮ", None, ""]
    texts += texts[:3]
    rows = [(2**60 + i if i != 4 else None, t, "en", "a", 0) for i, t in enumerate(texts)]
    found, pairs = alignment.align(table(rows), A, B)
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = Counter((r.doc_id, *(r[c] for c in names)) for r in found.collect())
    want = Counter((r[0], *x) for r, x in zip(rows, plain_alignment(texts)))
    assert got == want
    assert pairs.count() > 20 and pairs.groupBy("a", "b").count().where("count > 1").count() == 0


def test_alignment_on_odd_rows(spark, odd, none):
    found = alignment.align(odd, A, B)[0].collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in odd_rows())
    assert {(r.n_links, r.groups_sha256) for r in found if r.doc_id in (1, 2)} == {(0, "")}
    assert alignment.align(none, A, B)[0].count() == 0


def test_both_libraries_give_the_same_ids():
    pair = alignment.Pair(A, B)
    texts = [prose(3, 300), "don't  we'll\n\n 12 ab1 Ünïcödé Ж x y  ", "'S 'RE a's"]
    assert pair.fast is not None
    for text in texts:
        assert pair.fast.encode_ordinary(text) == pair.whole.encode(text, add_special_tokens=False).ids


# --- nearest neighbours ---


def nearest(vectors, queries, k):
    """Exact answers by id, from a dictionary of vectors."""
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], np.float32).astype(np.float64)
    out = {}
    for q in queries:
        score = (x[np.searchsorted(ids, q)] * x).sum(axis=1)
        rank = [(-s, i) for s, i in zip(score.tolist(), ids.tolist()) if i != q]
        out[q] = [(i, -s) for s, i in sorted(rank)[:k]]
    return out


@pytest.mark.parametrize("kind", ["sphere", "lengths", "clusters", "few"])
def test_neighbours_against_brute_force(spark, kind):
    draw = np.random.default_rng(5)
    n, d = (12 if kind == "few" else 1_500), 24
    x = draw.standard_normal((n, d))
    if kind == "sphere":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "lengths":
        x *= draw.uniform(0.2, 3, (n, 1))
    if kind == "clusters":
        x = np.repeat(x[:30], 50, axis=0) + 0.05 * x
        x[1_000:1_200] = x[1_000]  # one vector two hundred times
    vectors = {i: v.astype(np.float32).tolist() for i, v in enumerate(x)}
    rows = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").repartition(3)
    got = defaultdict(list)
    for r in neighbours.search(rows, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = nearest(vectors, range(0, n, 20), 20)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, len(want[q]) + 1))
        assert [(i, s) for _, i, s in found] == sorted(((i, s) for _, i, s in found), key=lambda e: (-e[1], e[0]))
        exact = dict(want[q])
        hits += sum(i in exact for _, i, _ in found)
        for _, i, s in found:
            assert math.isclose(s, float(np.dot(np.array(vectors[q], np.float32).astype(float), np.array(vectors[i], np.float32).astype(float))), abs_tol=1e-12)
    assert hits >= (0.9 if kind != "few" else 1) * sum(map(len, want.values()))


def test_every_code_within_the_radius_is_found():
    draw = np.random.default_rng(1)
    base = draw.integers(0, 256, (400, 8), dtype=np.uint8)
    base[200:300] = base[:100] ^ (draw.random((100, 8)) < 0.2).astype(np.uint8)
    base[300:] = base[7]
    asked = base[::9]
    apart = np.unpackbits(asked[:, None] ^ base[None], axis=2).sum(axis=2)
    for width in (8, 16):
        table = neighbours.SubstringIndex(base, width)
        for radius in (0, 1, 3, 6, 14, 30, 64):
            assert sum(p + 1 for p in neighbours.parts(radius, 64 // width)) == radius + 1
            q, row = table.within(asked, radius)
            assert set(zip(q.tolist(), row.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(apart <= radius)))) and len(q) == (apart <= radius).sum()


def test_neighbours_on_odd_rows(spark):
    good = [0.5, -1.0, 0.25]
    rows = [(0, good), (1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 2.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 0.0, 1.0])]
    rows += [(None, good), (7, [1.0, 2.0]), (20, good), (20, good), (40, [-1.0, 0.0, 0.0]), (8, [3.0, 1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *(F.lit("!").alias(c) for c in ("vec", "code", "norm", "rank", "score")))
    got = defaultdict(list)
    for r in neighbours.search(table, F.col("vec_id") % 20 == 0, 2).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got == {0: [(20, 1.3125), (20, 1.3125)], 20: [(0, 1.3125), (8, 0.75)], 40: [(0, -0.5), (20, -0.5)]}
    assert neighbours.search(table.limit(0), F.col("vec_id") % 20 == 0, 2).count() == 0
    assert neighbours.search(table.where("vec_id = 0"), F.col("vec_id") % 20 == 0, 2).count() == 0


# --- divergence ---


def plain_audit(rows, least_docs, terms):
    import re

    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least_docs)
        mine = sorted(s for x, s in groups if x == lang)
        whole = Counter()
        for s in mine:
            whole.update(counts[lang, s])

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q = shares(whole)
        by = {s: shares(counts[lang, s]) for s in mine}
        for s in mine:
            pair = sorted(((-sum(abs(by[s][t] - by[o][t]) for t in kept), o) for o in mine if o != s), key=lambda e: (e[0], e[1].encode()))
            term = sorted(((q[t] - by[s][t], t) for t in kept if counts[lang, s][t] and by[s][t] > q[t]), key=lambda e: (e[0], e[1].encode()))[:terms]
            out |= {(lang, s, part, i, -v, k + 1) for part, found in (("pair", pair), ("term", term)) for k, (v, i) in enumerate(found)}
    return out


@pytest.mark.parametrize("span", [4, 4_096])
def test_divergence_equals_plain_counts(spark, table, span):
    rows = [(i, prose(i % 70, 20 + i % 50) + (" Élan ÉLAN naïve ﬁn" if i % 3 else ""), ("en", "de", None)[i % 3], f"s{i % 7}" if i % 5 else None, 0) for i in range(400)]
    rows += [(900, None, "en", "empty", 0), (901, "only", "xx", "a", 0), (902, "", "xx", "b", 0), (903, "alone", "yy", "", 0)] + rows[:40]
    got = [tuple(r) for r in divergence.audit(table(rows), least_docs=6, terms=9, span=span).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows, 6, 9)


def test_equal_subtrees_are_one_node_and_priced_exactly():
    draw = np.random.default_rng(2)
    counts = np.zeros((5, 64), np.int64)
    counts[1, 3], counts[2], counts[3] = 9, draw.integers(0, 40, 64), draw.integers(0, 3, 64)
    counts[4] = counts[2]
    counts[:, 50:] = -1
    totals = [int(c[:50].sum()) + 250 for c in counts]
    forest = divergence.Forest(counts)
    assert forest.roots[2] == forest.roots[4] and len(set(forest.roots.tolist())) == 4
    left, right = np.triu_indices(5, 1)
    share = [[1 + 10**9 * (int(n) + 5) // t for n in c[:50]] for c, t in zip(counts, totals)]
    want = [sum(abs(x - y) for x, y in zip(share[i], share[j])) for i, j in zip(left, right)]
    assert forest.distances(left, right, totals) == want
    large = np.array([[10**13, 0], [5, 10**14]], object)
    totals = [10**13 + 10, 10**14 + 15]
    want = abs((1 + 10**9 * (10**13 + 5) // totals[0]) - (1 + 10**10 // totals[1])) + abs((1 + 5 * 10**9 // totals[0]) - (1 + 10**9 * (10**14 + 5) // totals[1]))
    assert divergence.Forest(large).distances(np.array([0]), np.array([1]), totals) == [want]


def test_divergence_on_odd_rows(spark, odd, none):
    got = {tuple(r) for r in divergence.audit(odd, least_docs=1).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == plain_audit(odd_rows(), 1, 50)
    assert divergence.audit(odd).where("part = 'pair' and value = 0").count() > 0
    assert divergence.audit(none).count() == 0


def test_divergence_writes_counts_once_and_holds_few(spark, table, monkeypatch):
    rows = [(i, prose(i % 50, 30), ("en", "de")[i % 2], f"s{i % 3}", 0) for i in range(120)]
    writes = []
    monkeypatch.setattr(divergence, "stage", lambda df: writes.append(df.columns) or stage(df))
    monkeypatch.setattr(divergence, "COUNTED", 40)
    monkeypatch.setattr(divergence, "HANDED", 7)
    got = {tuple(r) for r in divergence.audit(table(rows), least_docs=4).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == plain_audit(rows, 4, 50) and len(writes) == 2


def test_shares_beyond_64_bits(spark):
    rows = spark.createDataFrame([(3, 20, 4), (9_000_000_000, 10**17, 7), (9_000_000_001, 10**17, 7), (10**17, 10**18, 10**6), (10**18, 5 * 10**18, 1)], "n long, total long, v long").withColumn("total", F.col("total").cast("decimal(38,0)"))
    got = rows.select("n", "total", "v", divergence.share(F.col("n"), F.col("total"), F.col("v")).alias("s")).collect()
    assert [r.s for r in got] == [1 + 10**9 * (r.n + 5) // (int(r.total) + 5 * r.v) for r in got]
