"""Operators over the whole corpus against plain models, on small tables with every odd case."""

import random
import re
from collections import Counter, defaultdict

import pytest

from rasterloom.llm import common, decontamination, line_dedup, ngram_join, quality_rules, sharding, suffix_dedup
from rasterloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, pos string, hits int, q_kept string"


def corpus() -> list[tuple]:
    rng = random.Random(5)
    vocabulary = [rng.choice(["ba", "ri", "tö", "ku", "men", "al"]) + rng.choice(["na", "lo", "sté", "x", "9"]) + rng.choice(["", "s", "ing"]) for _ in range(300)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    text = lambda n: "\n".join(sentence(rng.randint(5, 40)) for _ in range(n))
    shared = sentence(60)
    rows = [text(rng.randint(1, 12)) for _ in range(60)]
    rows += [rows[3], rows[3], rows[7], rows[7] + "\n" + sentence(4), rows[9].replace(" ", "  ", 1), rows[11].upper()]
    words = rows[5].split()
    for k in range(6):  # near copies
        words = list(words)
        words[rng.randrange(len(words))] = f"edit{k}"
        rows.append(" ".join(words))
    rows += [sentence(8) + "\n" + shared + "\n" + sentence(9) for _ in range(12)]
    rows += ["", None, " \t\n", "a", "a" * 400, "a" * 400, "ab" * 300, "x\n" * 90, "line\n\nline", "word " * 5000, shared, shared, "%%% ### &&& " * 30]
    return [(i, t, None, "s", None, 1, "clash", None, "clash") for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return common.keep(spark.createDataFrame(rows, SCHEMA).repartition(5))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows without doc_id, and repeated rows."""
    long = "some words that stand in a line of more than fifty bytes, again and again and again " * 3
    return spark.createDataFrame([(None, long), (None, None), (4, long), (4, long), (4, "other"), (2, "short")], "doc_id long, text string")


def test_repeated_bytes(docs, rows, empty, odd):
    first: dict[bytes, int] = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for s in range(len(b) - 49):
            first.setdefault(b[s : s + 50], i)
    found = {r.doc_id: r for r in suffix_dedup.removals(docs, with_text=True).collect()}
    assert len(found) == len(rows)
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        r = found[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone)))), i
        assert bytes(r.kept) == bytes(c for c, g in zip(b, gone) if not g)
    assert suffix_dedup.removals(empty).count() == 0
    some = sorted((str(r.doc_id), r.n_removed) for r in suffix_dedup.removals(odd).collect())
    assert some == [("2", 0), ("4", 0), ("4", 0), ("4", 0), ("None", 0), ("None", 252)]


def test_repeated_bytes_window_by_window(docs, monkeypatch):
    want = {r.doc_id: r.kept_sha256 for r in suffix_dedup.removals(docs).collect()}
    monkeypatch.setattr(suffix_dedup, "WIDE", 2)
    found = suffix_dedup.shared.__globals__["WIDE"]
    assert found == 2 and {r.doc_id: r.kept_sha256 for r in suffix_dedup.removals(docs).collect()} == want


def test_long_texts_are_cut_into_batches():
    text = bytes(random.Random(1).choices(b"abcdef ", k=4000))
    whole = suffix_dedup.batch_rows([(1, 0, text)])
    covered = set()
    for group in suffix_dedup.batches_of([(1, 0, text)], 512):
        for _, _, at, part in group:
            covered |= {text[at + i : at + i + 50] for i in range(len(part) - 49)}
    assert covered == {text[i : i + 50] for i in range(len(text) - 49)} and whole["n"].sum() == len(text) - 49


def features(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed


def test_quality(docs, rows, empty, odd):
    found = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    for i, t, *_ in rows:
        r = found[i]
        assert (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words, r.q_base_failed) == features(t), i
        assert r.q_kept == (not r.q_base_failed and r.q_posterior >= 0.5) and r.text == t and r.pos == "clash"
    assert all(found[i].q_kept for i in range(60) if len(rows[i][1].split()) >= 50)
    assert quality_rules.judged(empty).count() == 0 and quality_rules.judged(odd).count() == 6


def test_posteriors_are_those_of_a_plain_model(spark):
    import math

    patterns = [((1, 1, 1), 500), ((1, -1, 1), 40), ((-1, 0, 1), 30), ((0, 1, 1), 60), ((-1, -1, -1), 9)]
    guess = {-1: (0.15, 0.0005), 0: (0.1, 0.06), 1: (0.75, 0.9395)}
    chances, good, total = [[dict((k, guess[k][c]) for k in guess) for _ in range(3)] for c in (0, 1)], 0.85, sum(n for _, n in patterns)
    posterior = lambda v: 1 / (1 + math.exp(-(math.log(good / (1 - good)) + sum(math.log(chances[1][r][k] / chances[0][r][k]) for r, k in enumerate(v)))))
    for _ in range(30):
        g = [n * posterior(v) for v, n in patterns]
        mass = [[defaultdict(float) for _ in range(3)] for _ in (0, 1)]
        for (v, n), w in zip(patterns, g):
            for r, k in enumerate(v):
                mass[0][r][k] += n - w
                mass[1][r][k] += w
        good = (sum(g) + 1) / (total + 2)
        size = [(total - sum(g), 1.0), (sum(g), 10.0)]
        chances = [[{k: (mass[c][r][k] + size[c][1] * total * guess[k][c]) / (size[c][0] + size[c][1] * total) for k in guess} for r in range(3)] for c in (0, 1)]
    df = spark.createDataFrame([(list(v), n) for v, n in patterns], "pattern array<int>, n long")
    found = {tuple(r.pattern): r.posterior for r in quality_rules.posteriors(df, 3).collect()}
    assert found == pytest.approx({v: posterior(v) for v, _ in patterns}, rel=1e-6)


def normal(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_leaks(spark, empty, odd):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    passage = lambda n: [rng.choice(words) for _ in range(n)]
    items = [passage(n) for n in (30, 13, 20, 9, 5, 14)] + [[]]
    texts = [passage(60) for _ in range(20)]
    for k, item in enumerate(items[:6]):
        texts[k] = passage(7) + item + passage(5)
        edited = list(item)
        for j in rng.sample(range(len(item)), min(3, len(item))):
            edited[j] = "changed"
        texts[k + 6] = passage(3) + edited + passage(3)
        texts.append(item[: len(item) // 2] + passage(3))
    texts += [[], items[0] + items[1], items[2][:13]]
    rows = [(i, " ".join(t).replace("w1 ", "W1, ")) for i, t in enumerate(texts)] + [(900, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(77, None)], "item_id long, text string")
    want = {}
    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            size = min(13, len(item))
            if len(item) < 8:
                continue
            for shift in range(-len(item), len(t)):
                e = [int(0 <= shift + j < len(t) and t[shift + j] == w) for j, w in enumerate(item)]
                if hits := [s for s in range(len(item) - size + 1) if sum(e[s : s + size]) >= size - (2 if len(item) >= 13 else 0)]:
                    a, b, n = want.get((i, k), (10**9, -1, 0))
                    want[i, k] = min(a, max(0, hits[0] + shift)), max(b, min(len(t), hits[-1] + shift + size) - 1), max(n, sum(e))
    for limits in ({}, {"most_words": 0, "most_hits": 0}):
        found = {(r.doc_id, r.item_id): (r.first_word, r.last_word, r.n_equal) for r in decontamination.leaks(docs, bench, **limits).collect()}
        assert found == want
    assert decontamination.leaks(empty, bench).count() == 0 and decontamination.leaks(docs, empty.selectExpr("doc_id item_id", "text")).count() == 0
    assert decontamination.leaks(odd, odd.selectExpr("doc_id item_id", "text")).count() == 2


def test_masks_miss_nothing():
    from itertools import combinations

    for gone in combinations(range(decontamination.WINDOW), decontamination.SUBSTITUTIONS):
        assert any(all(i + k not in gone for k in mask) for mask in decontamination.MASKS for i in range(decontamination.WINDOW - mask[-1]))
    assert max(m[-1] for m in decontamination.MASKS) < decontamination.LEAST


def ngram_sets(rows, n):
    out = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = frozenset([tuple(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [tuple(w)] if w else [])
    return out


@pytest.mark.parametrize("n,threshold", [(3, 90), (5, 80)])
def test_ngram_join(docs, rows, empty, odd, n, threshold):
    sets = ngram_sets(rows, n)
    parent = {i: i for i in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(docs, n, threshold / 100).collect()}
    assert found == {i: (len(sets[i]), root(i)) for i in sets}
    assert ngram_join.groups(empty, n).count() == 0
    assert sorted((str(r.doc_id), str(r.component_id)) for r in ngram_join.groups(odd, n).collect()) == [("2", "2"), ("4", "4"), ("4", "4"), ("4", "4"), ("None", "None"), ("None", "None")]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(501, 530)] + [(7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    root = lambda a: a if parent.setdefault(a, a) == a else root(parent[a])
    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert found == {a: root(a) for a in parent}


def test_line_dedup(docs, rows, empty, odd):
    first, runs = {}, defaultdict(list)
    texts = {i: (t or "").split("\n") for i, t, *_ in rows}
    for i in texts:
        some = [(p, s) for p, s in enumerate(texts[i]) if re.search(r"[^\x20\x09-\x0D]", s)]
        for a in range(len(some)):
            n = 0
            for b in range(a, len(some)):
                n += len(re.findall(r"[^\x20\x09-\x0D]+", some[b][1]))
                if n >= 25 and b - a < 30:
                    key = tuple(s for _, s in some[a : b + 1])
                    first.setdefault(key, (i, a))
                    runs[i].append((key, a, [p for p, _ in some[a : b + 1]]))
    found = {r.doc_id: r for r in line_dedup.without_lines(docs, line_dedup.repeated_lines(docs)).collect()}
    for i in texts:
        gone = {p for key, a, places in runs[i] if first[key] < (i, a) for p in places}
        assert found[i].d_n_deleted == len(gone), i
        assert (found[i].text or "") == "\n".join(s for p, s in enumerate(texts[i]) if p not in gone)
        assert found[i].pos == "clash"
    assert found[61].text == "" and line_dedup.repeated_lines(empty).count() == 0
    assert line_dedup.without_lines(odd, line_dedup.repeated_lines(odd)).count() == 6


def test_shards(docs, rows, empty, odd):
    import zlib

    found = sharding.shard(docs, 5, bucket_rows=7).collect()
    assert sorted(r.doc_id for r in found) == [r[0] for r in rows]
    weights, slots, places = Counter(), defaultdict(list), defaultdict(set)
    for r in found:
        b = (rows[r.doc_id][1] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(b) + 16, zlib.crc32(b), "bytes", None)
        weights[r.shard] += r.size
        slots[r.shard].append(r.slot)
        places[b].add(r.shard)
    largest = max(r.size for r in found)
    share = sum(weights.values()) / 5
    assert set(weights) == set(range(5)) and all(abs(w - share) <= largest for w in weights.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(p) == 1 for p in places.values())
    assert sharding.shard(empty).count() == 0 and sharding.shard(odd, 3).count() == 6


def test_a_text_larger_than_a_shard_is_split(spark):
    docs = spark.createDataFrame([(i, "the same text " * 5 if i % 3 else f"text {i} " * 6) for i in range(300)], "doc_id long, text string")
    weights = Counter()
    for r in sharding.shard(docs, 6).collect():
        weights[r.shard] += r.size
    assert len(weights) == 6 and max(weights.values()) < 1.6 * min(weights.values())


def test_pipeline(spark, docs, rows, tmp_path):
    import corpus_pipeline as pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, rows[2][1]), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for name, stage in pipeline.STAGES[:-1]:
        now = common.keep(stage(spark, now, str(tmp_path)))
        assert now.columns == docs.columns, name
    ids = {r.doc_id for r in now.collect()}
    assert 2 not in ids and not ids & {60, 61, 62} and {3, 7, 9} <= ids
    last = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in last} == ids and all(len(r.token_ids) == 4 * r.n_tokens for r in last)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_short_runs(spark):
    import corpus_pipeline as pipeline

    boiler = "all rights are reserved by the owner here"  # 8 words
    texts = [f"own first line {i} of this one\n{boiler}\ntwo words\nonly {i}" for i in range(9)] + [f"{boiler}\nlast one of these here\n{boiler}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r.doc_id: r.text.split("\n") for r in pipeline.lines(spark, docs, "").collect()}
    assert [sum(t.count(boiler) for t in left.values()), left[0][1], left[9]] == [1, boiler, ["last one of these here"]]
    assert all("two words" in left[i] for i in range(9))  # nine copies of a short line stay
    more = docs.union(spark.createDataFrame([(10, "two words\nand more text than that")], docs.schema))
    left = {r.doc_id: r.text.split("\n") for r in pipeline.lines(spark, more, "").collect()}
    assert [i for i in sorted(left) if "two words" in left[i]] == [0] and left[10] == ["and more text than that"]
