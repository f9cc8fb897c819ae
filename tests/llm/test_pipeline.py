"""The pipeline over the awkward tables, stage by stage against plain Python."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
from meshwork.llm import decontaminate, toxicity

BLANKS = " \t\n\x0b\x0c\r"


def rank(row) -> tuple:
    return (row.doc_id is None, row.doc_id or 0)


def plain_toxicity(rows, model):
    scorer = toxicity.Scorer(model)
    w = model.weights
    out = []
    for r in rows:
        f = scorer.features(r.text)
        z = w[-1] + sum((x - m) * k for x, m, k in zip(f, model.mean, w, strict=False))
        if not (f[0] > 0 and z >= 0):
            out.append(r)
    return out


def plain_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups["".join(c for c in r.text or "" if c not in BLANKS)].append(r)
    return [min(g, key=lambda r: (-len(r.text or ""), *rank(r))) for g in groups.values()]


def plain_near(rows):
    def grams(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [grams(r.text) for r in rows]
    label = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if (x or y) and 5 * len(x & y) >= 4 * len(x | y) or not x and not y:
                old, new = label[i], label[j]
                label = [new if k == old else k for k in label]
    groups = defaultdict(list)
    for r, k in zip(rows, label, strict=True):
        groups[k].append(r)
    return [min(g, key=rank) for g in groups.values()]


def plain_leaks(rows, items):
    import regex

    words = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]
    wanted = [x for x in (words(i.text) for i in items if i.item_id is not None) if len(x) >= decontaminate.MIN_TOKENS]

    def found(t, x):
        n = min(decontaminate.WINDOW, len(x))
        for g in range(1 - len(x), len(t)):
            same = [0 <= g + k < len(t) and t[g + k] == x[k] for k in range(len(x))]
            if sum(same) >= 0.8 * n and any(5 * sum(same[s : s + n]) >= 4 * n for s in range(len(x) - n + 1)):
                return True
        return False

    return [r for r in rows if not any(found(words(r.text), x) for x in wanted)]


def bag(rows) -> Counter:
    return Counter((r.doc_id, r.text) for r in rows)


def test_stages_against_plain_python(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    items = spark.read.parquet(f"{tables}/benchmark.parquet").collect()
    model = toxicity.fit(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    plain = [lambda rows: plain_toxicity(rows, model), plain_exact, plain_near, lambda rows: plain_leaks(rows, items)]
    frame, rows, kept = docs, docs.collect(), {}
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], plain, strict=True):
        frame = stage(spark, frame, tables)
        assert frame.columns == docs.columns
        path = f"{tables}-{name.replace(' ', '-')}"
        frame.write.mode("overwrite").parquet(path)
        frame, rows = spark.read.parquet(path), want(rows)
        assert bag(frame.collect()) == bag(rows), name
        kept[name] = [r.doc_id for r in rows]
    ids = kept["exact dedup"]
    assert [k for k in ids if k in (3, 15, 16, 17)] == [16]  # the longest of equal texts
    assert 18 not in kept["near dedup"] and 0 in kept["near dedup"]
    assert not {22, 23, 24} & set(kept["decontamination"])
    assert set(range(1, 3)) | set(range(4, 12)) <= set(kept["decontamination"])
    packed = corpus_pipeline.run(spark, tables).collect()
    assert {r.doc_id for r in packed} == set(kept["decontamination"])
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(kept["decontamination"])


def test_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []
