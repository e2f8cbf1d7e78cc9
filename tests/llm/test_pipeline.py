"""Each stage of corpus_pipeline, and all of them in a row, against plain Python on a small corpus."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from cutroom.llm import near_dedup, quality_rules

from . import brute
from .test_llm import edited, near_classes, words

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, keep boolean, __0 string"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with nulls, empty, repeated and very long texts, ties, copies, benchmark passages, and columns whose names clash; and a benchmark."""
    rng = random.Random(31)
    items = [(i, words(rng, 12, 5000)) for i in range(6)]
    rows = [(i, words(rng, rng.randrange(25, 90), 4000), rng.choice("aab")) for i in range(60)]
    for i in range(8):
        rows += [(100 + i, rows[i][1], "b"), (200 + i, edited(rng, rows[i + 10][1], 0.01), "c"), (300 + i, f"{words(rng, 30, 4000)} {items[i % 6][1].upper()} {words(rng, 30, 4000)}", None)]
    rows += [(400, None, "a"), (401, "", "a"), (402, "too short", "a"), (403, "# $ % " * 40, "a"), (404, words(rng, 8, 90) + "\n" + "again and again " * 30, "b"), (405, words(rng, 30_000, 9000), "b")]
    rows += [(5, rows[5][1], "a"), (5, rows[5][1], "a"), (None, words(rng, 50, 4000), "a"), (None, rows[7][1], None)]
    folder = tmp_path_factory.mktemp("corpus")
    full = [(d, t, "en", s, None if t is None else len(t), 7, d is None, "x") for d, t, s in rows]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def passes(text):
    m = brute.quality(text)
    letters = [c for c in text or "" if c.isascii() and c.isalpha()]
    lines = [x for x in (text or "").split("\n") if brute.SPACED.search(x)]
    n = m["n_words"]
    return not (
        m["base_failed"] or 10 * m["n_symbols"] > n or not 2 * n <= m["word_chars"] <= 15 * n or len(lines) >= 4 and 100 * m["n_dup_lines"] > 30 * len(lines)
        or len(letters) >= 20 and 2 * sum(c.isupper() for c in letters) > len(letters)
    )


def counted(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def test_stages(spark, corpus):
    folder, rows, items = corpus
    stages = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "shards"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    kept = stages["quality"](spark, docs, folder)
    want = [r for r in rows if passes(r[1])]
    assert kept.columns == docs.columns and counted(kept) == Counter(want) and 0 < len(want) < len(rows)
    assert quality_rules.CURRENT == 2

    alone = stages["near_duplicates"](spark, kept, folder)
    classes = near_classes([r[:2] for r in want], near_dedup.idf_table(kept))
    first = set(classes.values())
    got = counted(alone)
    assert alone.columns == docs.columns and Counter(d for d, *_ in got.elements()) == Counter(first) + Counter(d for d, *_ in want if d is None)
    assert set(got) <= set(want) and len(first) < len({d for d, *_ in want})

    clean = stages["decontamination"](spark, alone, folder)
    want = Counter({r: n for r, n in got.items() if not brute.decontaminate(r[1], items)[1]})
    assert clean.columns == docs.columns and counted(clean) == want and len(want) < len(got)

    mixed = stages["mixing"](spark, clean, folder)
    got = counted(mixed)
    assert mixed.columns == docs.columns and set(got) <= set(want) and all(n <= 2 * want[r] for r, n in got.items())
    size = lambda r: len(brute.SPACED.findall(r[1] or ""))
    sizes, taken = Counter(), Counter()
    for r, n in want.items():
        sizes[r[2]] += n * size(r)
    for r, n in got.items():
        taken[r[2]] += n * size(r)
    largest = max(map(size, want))
    for source, target in brute.mix_targets(sizes).items():
        assert abs(taken[source] - target) <= 2 * largest

    dealt = stages["shards"](spark, mixed, folder).collect()
    assert Counter(r.doc_id for r in dealt) == Counter(d for d, *_ in got.elements())
    slots = {}
    for r in dealt:
        slots.setdefault(r["shard"], []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len({(r.doc_id, r["shard"]) for r in dealt}) == len({r.doc_id for r in dealt})


def test_run_is_its_stages_in_a_row(spark, corpus):
    folder, *_ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    key = lambda r: (r.doc_id or -1, r.text_crc32, r["shard"])
    assert sorted(map(key, docs.collect())) == sorted(map(key, corpus_pipeline.run(spark, folder).collect()))


def test_stages_of_no_documents(spark, corpus):
    folder, *_ = corpus
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
