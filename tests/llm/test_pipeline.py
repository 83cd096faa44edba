"""Every stage of the pipeline against a plain model of it, and what it does with columns that it doesn't know."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from rasterloom.llm import common, quality_rules

OWN = ["q_kept", "q_words", "q_n_words", "d_hash", "d_n_deleted", "n_deleted", "n_deleted_", "leak_id", "whole", "component_id", "hits", "of"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abdegilmnorstu", k=rng.randint(2, 8))) for _ in range(400)]
    line = lambda n: " ".join(rng.choices(vocabulary, k=n)) + "."
    texts = ["\n".join(line(rng.randint(4, 18)) for _ in range(rng.randint(4, 9))) for _ in range(40)]
    notice, passage, item = "please read the terms of this site", line(40), line(30)
    texts = [f"{t}\n{notice}" if i % 4 == 0 else t for i, t in enumerate(texts)]
    texts += [texts[2], texts[5].replace(" ", "  ", 1), f"{line(20)}\n{passage}\n{line(9)}", f"{line(21)}\n{passage}\n{line(9)}"]
    base = line(60).split()
    for k in range(4):  # near copies without a line in common
        base = list(base)
        base[rng.randrange(60)] = f"edit{k}"
        texts.append(" ".join(base))
    texts += [f"{line(15)}\n{item}\n{line(15)}", "too short", "", "%%% ### &&& " * 30, " \n ", "again and again " * 40]
    return [*enumerate(texts), (900, None)], item


def lines_model(rows):
    first, seen, out = {}, Counter(), {}
    split = {i: (t or "").split("\n") for i, t in rows}
    some = {i: [(p, s) for p, s in enumerate(split[i]) if words(s)] for i in split}
    runs = lambda x: [(a, x[a : b + 1]) for a in range(len(x)) for b in range(a, len(x)) if sum(len(words(s)) for _, s in x[a : b + 1]) >= 25]
    for i in sorted(split):
        for p, s in some[i]:
            seen[s] += 1
            first.setdefault(s, (i, p))
        for a, run in runs(some[i]):
            first.setdefault(tuple(s for _, s in run), (i, run[0][0]))
    for i, t in rows:
        gone = {p for p, s in some[i] if first[s] < (i, p) and (len(words(s)) >= 5 or seen[s] >= 10)}
        for a, run in runs(some[i]):
            if first[tuple(s for _, s in run)] < (i, run[0][0]):
                gone |= {p for p, _ in run}
        left = "\n".join(s for p, s in enumerate(split[i]) if p not in gone) if gone else t
        if not gone or words(left):
            out[i] = left
    return out


def near_model(rows):
    sets = {}
    for i, t in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[a]] == root[a] for a in root):
            break
    return {i: t for i, t in rows if root[i] == i}


def leak_model(rows, item):
    """The item is a run of one line: a document goes if it holds 11 of 13 words in place."""
    normal = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    want, out = normal(item), {}
    for i, t in rows:
        w = normal(t)
        hit = any(
            sum(w[a + k] == want[b + k] for k in range(13)) >= 11 for a in range(len(w) - 12) for b in range(len(want) - 12)
        )
        if not hit:
            out[i] = t
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, item = corpus()
    folder = str(tmp_path_factory.mktemp("pipeline"))
    # every row has a value of its own in columns that are named as columns that stages add
    docs = [(i, t, None, f"s{i}", len(t or "")) + tuple(f"{c} {i}" for c in OWN) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in OWN)
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, item


def test_stages_are_those_of_plain_models(spark, tables):
    folder, item = tables
    docs = common.table(spark, folder, "documents")
    now, columns = docs, docs.columns
    kept = {r.doc_id for r in quality_rules.judged(docs.select("doc_id", "text")).collect() if r.q_kept}
    models = [lambda rows: {i: t for i, t in rows if i in kept}, lines_model, near_model, lambda rows: leak_model(rows, item)]
    for (name, stage), model in zip(pipeline.STAGES, models):
        before = sorted((r.doc_id, r.text) for r in now.collect())
        now = common.keep(stage(spark, now, folder))
        rows = now.collect()
        assert now.columns == columns, name
        assert {r.doc_id: r.text for r in rows} == model(before), name
        assert len(before) > len(rows), name
        for r in rows:
            assert all(r[c] == f"{c} {r.doc_id}" for c in OWN) and r.source == f"s{r.doc_id}", name
            assert r.n_chars == len(r.text), name
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = pipeline.run(spark, folder).collect()
    assert {r.doc_id: r.n_tokens for r in last} == {r.doc_id: len(library.encode_ordinary(r.text)) for r in now.collect()}
