"""Quality outliers, licence scan, toxicity and language identification."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from revtrack.llm import langid, licenses, quality, toxicity
from revtrack.llm.common import configure_batches

from .conftest import odd_rows, prose


@pytest.fixture(autouse=True)
def _batches(spark):
    configure_batches(spark)


# --- quality ---


def plain_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, dup, seen = (text or "").split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    times = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if times[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_statistics_equal_plain_counts():
    draw = random.Random(5)
    texts = ["", " ", "a b c d e a b c d e", "é ü x   y", "x\nx\n\n \n \nx\r\nx\r\n"]
    texts += ["".join(draw.choice("ab #|\n\té\x1c") for _ in range(draw.randint(0, 80))) for _ in range(300)]
    for text in texts:
        got = quality.text_stats(text.encode())
        assert (got[0], got[1], got[2], got[3], got[5]) == plain_stats(text), repr(text)


def test_repeated_words_of_long_runs():
    numbers = np.array(list(range(1000)) + list(range(1000)))
    assert quality.repeated_words(numbers) == 2000
    assert quality.repeated_words(np.arange(100_000)) == 0


def test_outliers_are_rejected_and_clean_texts_stay(spark, table):
    rows = [(i, prose(i, 60 + i % 90), "en", f"s{i % 2}", 0) for i in range(240)]
    rows += [(1000 + i, " ".join(w + "###" for w in prose(i, 80).split()), "en", "s0", 0) for i in range(12)]
    rows += [(2000, "few words", "en", "s0", 0), (2001, "a b c d e f " * 9, "en", "s0", 0)]
    got = {r.doc_id: r for r in quality.assess(table(rows), "doc_id").collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept for i in range(240))
    assert not any(got[1000 + i].kept for i in range(12))
    assert got[2000].base_failed and got[2001].base_failed and not got[2000].kept
    kept = quality.keep(table(rows))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(240)) and kept.columns == table(rows).columns


def test_estimate_equals_concentration_in_memory(spark):
    draw = np.random.default_rng(3)
    p = len(quality.NAMES)
    x = draw.normal(size=(400, p)) @ np.diag(np.linspace(0.5, 2, p))
    x[:60] += 8
    rows = spark.createDataFrame([("g", v.tolist()) for v in x], "group string, x array<double>")
    model = quality.fit(rows).first()
    assert model.n == 400
    # The estimate rests on the clean rows: the shifted ones are far from it, the others are not.
    off = x - np.array(model.mean)
    d = np.einsum("ij,jk,ik->i", off, np.array(model.precision).reshape(p, p), off)
    assert d[:60].min() > d[60:].max() and np.abs(np.array(model.mean)).max() < 0.5


def test_determinant_is_the_least_over_subsets(spark, monkeypatch):
    """A small group: the least determinant over all subsets of the covered size, by brute force."""
    draw = np.random.default_rng(8)
    p = len(quality.NAMES)
    x = draw.normal(size=(16, p))
    x[:4] = x[:4] * 0.1 + 9  # a tight cluster apart from the rest, which must not be what the estimate rests on
    monkeypatch.setattr(quality, "LEAST_GROUP", 10)
    rows = spark.createDataFrame([("g", v.tolist()) for v in x], "group string, x array<double>")
    model = quality.fit(rows).first()
    covered = round(quality.COVERED * len(x))
    dets = {
        take: np.linalg.slogdet(quality.floored(np.cov(x[list(take)].T, bias=True) * quality._consistent(p)))[1]
        for take in itertools.combinations(range(len(x)), covered)
    }
    best = min(dets, key=dets.get)
    assert min(best) >= 4
    # Distances are binned, so the subset may be cut within a bin: nearly the least, and far below what other starts give.
    assert model.log_det < dets[best] + 0.5 and model.log_det < np.median(list(dets.values()))
    assert np.abs(np.array(model.mean) - x[list(best)].mean(axis=0)).max() < 0.3


def test_every_start_and_the_least_determinant(spark):
    draw = np.random.default_rng(5)
    p = len(quality.NAMES)
    x = draw.normal(size=(300, p)) @ draw.normal(size=(p, p))
    x[:90] += 12
    rows = spark.createDataFrame([("g", v.tolist()) for v in x], "group string, x array<double>")
    first = quality.starts(rows)
    assert sorted(r.start for r in first.collect()) == list(range(len(quality.STARTS)))
    ends = first
    for _ in range(quality.FIRST_STEPS):
        ends = quality.concentrate(rows, ends)
    assert quality.fit(rows).first().log_det <= min(r.log_det for r in ends.collect()) + 1e-9


def test_deviations_are_at_least_the_floor():
    p = len(quality.NAMES)
    least = np.array(list(quality.FLOOR.values()))
    assert np.allclose(quality.floored(np.zeros((p, p))), np.diag(least**2))
    wide = np.diag((10 * least) ** 2)
    assert np.allclose(quality.floored(wide), wide)  # nothing is added to a variance above it
    same = np.ones((p, p))
    assert np.isfinite(np.linalg.inv(quality.floored(same))).all()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_counted_once_where_rows_are_kept(table):
    """With the function in a filter as well, tasks had two Python workers each and counted every text twice."""
    rows = [(i, prose(i, 60), "en", "s", 0) for i in range(60)] + [(100, "few words", "en", "s", 0), (101, None, None, None, 0)]
    kept = quality.keep(table(rows))
    assert len(re.findall(r"ArrowEvalPython \[", _plan(kept))) == 1
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60))


def test_sums_reach_workers_in_one_column(spark):
    """Dozens of columns took off-heap buffers for thousands of rows in every task of every step."""
    draw = np.random.default_rng(6)
    rows = spark.createDataFrame([("g", v.tolist()) for v in draw.normal(size=(80, len(quality.NAMES)))], "group string, x array<double>")
    first = quality.starts(rows)
    for made, names in ((first, ["group", "n", "sums"]), (quality.concentrate(rows, first), ["group", "start", "bin", "k", "sums"])):
        sent = re.search(r"FlatMapGroupsInPandas \[[^\]]*\], \w+\(([^)]*)\)", _plan(made))[1]
        assert re.findall(r"(\w+)#", sent) == names


def test_quality_of_odd_rows(odd, none):
    got = quality.assess(odd, "doc_id").collect()
    assert len(got) == len(odd_rows())
    assert all(r.distance is None for r in got)  # no group is large enough
    assert {r.doc_id for r in got if not r.kept} == {1, 2, 3, 9, 10}
    kept = quality.keep(odd)
    assert kept.columns == odd.columns and kept.count() == 6
    assert quality.assess(none, "doc_id").count() == 0 and quality.keep(none).count() == 0


# --- licences ---


def longest_run(sequences, text, end):
    for n in range(end + 1, 0, -1):
        part = text[end - n + 1 : end + 1]
        if any(s[j : j + n] == part for s in sequences for j in range(len(s) - n + 1)):
            return n
    return 0


def test_matching_statistics_equal_brute_force():
    draw = random.Random(1)
    for _ in range(200):
        sequences = [[draw.randint(0, 2) for _ in range(draw.randint(1, 9))] for _ in range(draw.randint(1, 4))]
        automaton = licenses.SuffixAutomaton(sequences)
        text = [draw.randint(0, 3) for _ in range(25)]
        state = length = 0
        for i, word in enumerate(text):
            state, length = automaton.step(state, length, word)
            assert length == longest_run(sequences, text, i)
            if length:
                ends = {(k, j + length - 1) for k, s in enumerate(sequences) for j in range(len(s) - length + 1) if s[j : j + length] == text[i - length + 1 : i + 1]}
                assert set(automaton.ends[state]) == ends


def test_phrases_and_spans():
    scanner = licenses.Scanner()
    n, places, spans = scanner.scan("Foo. Under the MIT-License under the mit license; CC BY-NC 4".encode())
    assert n == 13 and places == [(1, "mit"), (5, "mit"), (9, "cc-by-nc")]
    notice = dict(licenses.NOTICES)["gpl-3"]
    _, places, spans = scanner.scan(f"before {notice} after".encode())
    assert not places and [(s.label, s.first, s.share) for s in spans] == [("gpl-3", 1, 1.0)]
    words = licenses.NOTICES[0][1].split()
    words[20:22] = ["changed"]
    assert [s.label for s in scanner.scan(" ".join(words).encode())[2]] == ["mit"]
    assert scanner.scan(" ".join(words[:20]).encode())[2] == []


def test_phrase_places_equal_search():
    draw = random.Random(2)
    scanner = licenses.Scanner()
    pool = "under the mit license apache version 2 cc by nc other".split()
    for _ in range(200):
        words = [draw.choice(pool) for _ in range(60)]
        want = sorted((i, label) for p, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        assert sorted(scanner.scan(" ".join(words).encode())[1]) == want


def test_scan_of_odd_rows(odd, none):
    got = odd.select("doc_id", licenses.scan(F.col("text")).alias("s")).select("doc_id", "s.*").collect()
    assert len(got) == len(odd_rows()) and {(r.n_base, r.first_word, r.base_labels, r.labels, r.score) for r in got} == {(0, None, "", "", 0.0)}
    assert {r.doc_id: r.n_words for r in got}[7] == 30_000
    assert none.select(licenses.scan(F.col("text"))).count() == 0


# --- toxicity ---


def labelled(n=600):
    draw = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words, toxic = prose(i, 40).split(), i % 4 == 0
        if toxic:
            for word in draw.sample(["idiot", "moron", "scum"], 2):
                words.insert(draw.randint(0, len(words)), word)
        rows.append((i, " ".join(words), "en", "a", 0))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxic_words_are_learned(spark, table):
    rows, labels = labelled()
    seen = [x for x in labels if x[0] % 5]
    model = toxicity.fit(table(rows), spark.createDataFrame(seen, "doc_id long, label int"))
    again = toxicity.fit(table(rows), spark.createDataFrame(seen, "doc_id long, label int").repartition(5))
    assert model.intercept == again.intercept and len(model.index) < 2_000
    held = [i for i in range(len(rows)) if i % 5 == 0]
    score = model.scores([rows[i][1].encode() for i in held])
    right = [(s >= 0.5) == bool(labels[i][1]) for s, i in zip(score, held)]
    assert sum(right) / len(right) > 0.95


def below_share(rows, salt, n, most):
    """How many `doc_id` of `rows` have a hash below `most` of `n`, in Python's own integers."""
    draws = rows.select(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 40)).alias("d")).collect()
    return sum(r.d * n < most << 40 for r in draws)


def test_sample_of_labels_beyond_8_million_rows(spark, monkeypatch):
    labels = spark.range(2_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("label"))
    plain, more, most = F.count, (1 << 24) - 1_000, 1 << 22
    monkeypatch.setattr(F, "count", lambda c: plain(c) + F.lit(more))  # 2^24 rows of each label
    want = {k: below_share(labels.where(F.col("label") == k), "toxicity", 1 << 24, most) for k in (0, 1)}
    got = Counter(r.label for r in toxicity.sample(labels, {0: most, 1: most}).collect())
    assert dict(got) == want and all(150 < n < 350 for n in want.values())


def test_features_do_not_cross_documents():
    owner, found = toxicity.features([b"a b", b"", b"c"])
    assert sorted(Counter(owner.tolist()).items()) == [(0, 3), (2, 1)]
    assert set(found[owner == 0].tolist()).isdisjoint(found[owner == 2].tolist())


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1), (99, 1), (8, 0)], "doc_id long, label int")
    model = toxicity.fit(odd.select("doc_id", "text"), labels)
    got = odd.select("doc_id", toxicity.score(model, F.col("text")).alias("s")).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.s <= 1 for r in got)
    blank = toxicity.fit(none.select("doc_id", "text"), labels.limit(0))
    assert blank.scores([b"", b"idiot"]).tolist() == [0.5, 0.5]


# --- languages ---


def test_codewords_are_far_apart():
    for k in (2, 3, 4, 5, 9, 40):
        code = langid.codewords(k)
        gaps = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
        assert min(gaps) >= (1 if k == 2 else 2 ** (k - 2) if k <= 5 else code.shape[1] // 5)


def test_languages_are_told_apart(spark, table):
    stems = {"en": "the of and ing er th", "fr": "le que ent eau oi ê", "de": "der sch ung ein ü ch", "es": "el ción os ar ñ ue", "it": "il zione gli are che ò", "pl": "się nie ów cz rz ł"}
    draw = random.Random(6)
    write = lambda lang, n: " ".join("".join(draw.choice(stems[lang].split()) for _ in range(draw.randint(1, 3))) for _ in range(n))
    rows = [(i, write(lang, 40), lang, "a", 0) for i, lang in enumerate(list(stems) * 40)]
    model = langid.fit(table(rows))
    assert model.languages == sorted(stems)
    tests = [(lang, write(lang, 25)) for lang in stems for _ in range(30)]
    got, score, _ = model.predict([t.upper().encode() for _, t in tests])
    assert sum(g == lang for g, (lang, _) in zip(got, tests)) / len(tests) > 0.97 and score.min() >= 0 and score.max() <= 1


def test_sample_of_a_language_beyond_8_million_rows(spark, monkeypatch):
    rows = spark.range(2_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the text "), "id").alias("text"), F.lit("en").alias("lang"))
    plain, more, most, staged = F.count, (1 << 24) - 2_000, 1 << 22, []
    monkeypatch.setattr(F, "count", lambda c: plain(c) + F.lit(more))  # 2^24 rows of the language
    keep = langid.stage
    monkeypatch.setattr(langid, "stage", lambda df: staged.append(keep(df)) or staged[-1])
    assert langid.fit(rows, per_language=most).languages == ["en"]
    want = below_share(rows, "langid", 1 << 24, most)
    assert staged[-1].count() == want and 300 < want < 700


def test_languages_of_odd_rows(odd, none, table):
    model = langid.fit(odd)
    got = odd.select("doc_id", langid.identify(model, F.col("text")).alias("p")).select("doc_id", "p.*").collect()
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {1, 2, 3} and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert langid.fit(none).predict([b"abc", None])[0] == ["und", "und"]
    assert langid.fit(table([(1, "abc def", "en", "a", 0)])).predict([b"x", b"12 ..", "日本".encode()])[0] == ["en", "und", "en"]
