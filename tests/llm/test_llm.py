import hashlib
import math
import random
import string
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cutroom.llm import decontaminate, language_model, license_scan, line_dedup, near_dedup, quality_rules, queries, sharding, source_mix, token_counts, toxicity
from cutroom.llm.session import Shelf
from cutroom.llm.words import ALNUM, SPACED, pieces

from . import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, fail_bits bigint"


def frame(spark, rows, schema=SCHEMA):
    """rows: (doc_id, text[, source]); two more columns clash with the operators' own names."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), 7, 9) for r in rows]
    return spark.createDataFrame(full, schema).repartition(3)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Nulls, empty and white texts, ties, repeated rows, one very long text, symbols and several scripts."""
    rng = random.Random(3)
    long = words(rng, 60_000, 5000)
    body = words(rng, 80)
    return [
        (1, body, "a"), (1, body, "a"), (2, body + "\n" + body, "b"), (3, None, None), (4, "", "a"), (5, "  \t\n \x0b\x0c\r ", "c"),
        (6, long, "a"), (7, "## $$ %% && ** ## " * 8, "b"), (8, "Überraschung für älter\nñandú ñandú\n\nÜberraschung für älter", "é"), (9, "SHOUT " * 30, "b"),
        (10, "short text", "c"), (None, "no id here " + body, "a"), (11, "x" * 3000, "b"), (12, words(rng, 25), "😀"), (13, "a b  c퟿", None),
    ]


def by_id(df, *names):
    return sorted(([r[n] for n in ("doc_id", *names)] for r in df.collect()), key=lambda r: (r[0] is None, r))


def test_words_match_the_patterns(odd):
    texts = pa.array([t for _, t, *_ in odd])
    for kind, lower, plain in ((SPACED, False, lambda t: brute.SPACED.findall(t or "")), (ALNUM, True, brute.plain)):
        seen = {}
        for lo, hi, text in pieces(texts, 100_000):
            w = text.words(kind, lower=lower)
            for i in range(lo, hi):
                own = range(w.bounds[i - lo], w.bounds[i - lo + 1])
                assert [w.word(k, lower).decode() for k in own] == plain(odd[i][1])
                for k in own:
                    assert seen.setdefault(int(w.hashes[k]), w.word(k, lower)) == w.word(k, lower)
        assert len(set(seen.values())) == len(seen)


def test_quality_rules(spark, odd):
    docs = frame(spark, odd)
    rows = quality_rules.apply_policy(quality_rules.ledger(docs))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert by_id(rows, *names) == sorted(([d, *(brute.quality(t)[n] for n in names)] for d, t, *_ in odd), key=lambda r: (r[0] is None, r))
    base = rows.select("doc_id", (F.col("fail_bits").bitwiseAND(F.lit(quality_rules.mask(1)).cast("bigint")) != 0).alias("f"))
    assert sorted((r.doc_id or 0, r.f) for r in base.collect()) == sorted((d or 0, brute.quality(t)["base_failed"]) for d, t, *_ in odd)
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows.filter("kept").collect())
    got = {r["rule"]: r for r in quality_rules.ablation(rows).collect()}
    bits = [r.fail_bits for r in rows.collect()]
    for rule in quality_rules.RULES:
        assert got[rule.name].n_failed == sum(bool(b & 1 << rule.bit) for b in bits)
        assert got[rule.name].n_only == sum(b == 1 << rule.bit for b in bits)
    assert quality_rules.ledger(docs.limit(0)).count() == 0 and quality_rules.ablation(quality_rules.ledger(docs.limit(0))).count() == 0


def test_decontaminate(spark, odd):
    rng = random.Random(5)
    items = [(i, words(rng, rng.choice([1, 3, 9, 10, 14, 40]), 30)) for i in range(30)] + [(77, None), (78, ""), (79, "w1 w2"), (2, "Same id, two texts: w3 w4 w5")]
    docs = [(i, words(rng, 300, 30) + " " + items[i % 30][1].upper() + "! " + words(rng, 40, 9)) for i in range(60)] + [r[:2] for r in odd]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = by_id(decontaminate.digest(decontaminate.scan(frame(spark, docs), bench)), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = []
    for d, t in docs:
        n, hit, found, sha = brute.decontaminate(t, items)
        want.append([d, n, hit, found, sha, hit > 0])
    assert got == sorted(want, key=lambda r: (r[0] is None, r))
    clean = decontaminate.keep_clean(frame(spark, docs), bench)
    assert clean.columns == frame(spark, docs).columns and clean.count() == sum(not r[-1] for r in want)
    assert decontaminate.scan(frame(spark, docs), bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.scan(frame(spark, docs).limit(0), bench).count() == 0


def test_decontaminate_in_packs(spark, monkeypatch, odd):
    rng = random.Random(6)
    items = [(i, words(rng, 20, 50)) for i in range(12)] + [(50, "w1 w2"), (None, "w3 w4 w5"), (50, "w1 w2")]
    docs = [(i, words(rng, 50, 50) + " " + items[i][1]) for i in range(12)] + [r[:2] for r in odd]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("pack", F.lit("x"))
    frame_ = frame(spark, docs).withColumns({"k1": F.lit("k"), "items": F.lit(0)})
    digest = lambda: by_id(decontaminate.digest(decontaminate.scan(frame_, bench)), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    clean = lambda: Counter(map(str, decontaminate.keep_clean(frame_, bench).collect()))
    whole, kept = digest(), clean()
    assert any(r[-1] for r in whole) and not all(r[-1] for r in whole)
    monkeypatch.setattr(decontaminate, "PACK", 60)
    assert digest() == whole and clean() == kept


def test_a_large_benchmark_takes_time_in_proportion_to_the_text():
    """A million windows: tables of bounded size, and a search whose time follows the text."""
    import time

    rng = np.random.default_rng(1)
    bodies = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 1009)).encode() for _ in range(1000)]
    tables = decontaminate.Tables([(str(i), b) for i, b in enumerate(bodies)])
    (table,) = tables.tables
    assert len(table.windows) == 10**6
    assert sum(x.nbytes for x in (table.keys, table.shifts, table.windows, table.suffixes, table.starts, table.ends, table.owner)) < 100 * 10**6
    seconds = []
    for n in (40_000, 160_000):
        text = " ".join(f"w{x}" for x in rng.integers(0, 10**6, n)) + " " + bodies[3].decode()
        (_, _, piece), *rest = pieces(pa.array([text]), 1 << 30)
        assert not rest
        begin = time.perf_counter()
        hits = tables.hits(piece.words(ALNUM, lower=True))
        seconds.append(time.perf_counter() - begin)
        assert {i for _, _, i in hits} == {"3"} and len(hits) == 1000
    assert seconds[1] < 12 * seconds[0]


def test_source_mix(spark, odd):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randrange(1, 60)), rng.choice("aaaaaabcde") if i % 11 else None) for i in range(700)] + [r for r in odd if r[0] != 6]
    docs = frame(spark, rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(brute.SPACED.findall(t or ""))
    target = brute.mix_targets(sizes)
    got = source_mix.plan(docs).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source], rel=1e-9)
        assert r.taken in (0, r.size, 2 * r.size) and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= 2 * 500
    assert 0 <= 1.5 * sum(sizes.values()) - sum(taken.values()) <= 200
    again = source_mix.plan(docs.repartition(7))
    key = lambda r: (r.doc_id or -1, r.source or "", r.size, r.taken)
    assert sorted(map(key, again.collect())) == sorted(map(key, got))
    mixed = source_mix.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == +Counter({d: 0 for d in ()}) + sum((Counter({r.doc_id: r.copies}) for r in got), Counter())
    assert source_mix.plan(docs.limit(0)).count() == 0
    assert source_mix.plan(frame(spark, [(1, None), (2, "")])).agg(F.sum("taken")).first()[0] == 0


def test_source_mix_serves_equal_rows_one_by_one(spark):
    """Rows with equal or null doc_id, of one text or several, are no unit: every source comes near its target."""
    rows = [(i, "w " * 10, "a") for i in range(300)] + [(None, "x " * 10, "b")] * 1000 + [(7, f"y{i % 50} " * 10, "b") for i in range(500)] + [(i, "z " * 10, "c") for i in range(400)]
    docs = frame(spark, rows).withColumns({"size": F.lit("s"), "turn": F.lit(1), "__0": F.lit(2), "place": F.lit(None).cast("int")})
    got = source_mix.plan(docs).collect()
    taken, target = Counter(), {r.source: r.target for r in got}
    for r in got:
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size
    assert all(abs(taken[s] - t) <= 20 for s, t in target.items()) and sum(taken.values()) <= 1.5 * 22000
    again = source_mix.plan(docs.repartition(9)).collect()
    assert Counter((r.doc_id, r.source, r.taken) for r in got) == Counter((r.doc_id, r.source, r.taken) for r in again)
    mixed = source_mix.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter((r.doc_id, r.source) for r in mixed.collect()) == +sum((Counter({(r.doc_id, r.source): r.copies}) for r in got), Counter())


def test_source_mix_caps(spark):
    rows = [(i, "w " * 10, "a") for i in range(30)] + [(100 + i, "w " * 10, "b") for i in range(300)] + [(500 + i, "w", "c") for i in range(5)]
    got = source_mix.targets(spark.createDataFrame([("a", 300), ("b", 3000), ("c", 5)], "source string, source_size bigint"))
    assert {r.source: r.target for r in got.collect()} == pytest.approx(brute.mix_targets({"a": 300, "b": 3000, "c": 5}))
    taken = {r.source: r.t for r in source_mix.plan(frame(spark, rows)).groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    assert taken["a"] == 600 and taken["c"] == 10 and abs(taken["b"] - (1.5 * 3305 - 610)) < 20


def test_sharding(spark, odd):
    rows = [(i, f"text {i}") for i in range(3000)] + [r[:2] for r in odd]
    got = sharding.shard_documents(frame(spark, rows), 16).collect()
    assert len(got) == len(rows)
    slots = {}
    texts = {}
    for d, t in rows:
        texts.setdefault(d, set()).add(t)
    for r in got:
        mark = "-" if r.doc_id is None else f"={r.doc_id}"
        key = int(hashlib.md5(mark.encode()).hexdigest()[:16], 16)
        assert r["shard"] == brute.jump(key, 16) and r.grown_shard == brute.jump(key, 17)
        assert r.grown_shard in (r["shard"], 16)
        assert (r.size, r.text_crc32) in {(len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts[r.doc_id]}
        slots.setdefault(r["shard"], []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(slots) == 16
    wide = sharding.assign(frame(spark, rows).select("doc_id"), 500, "doc_id").collect()
    for r in wide[:300]:
        mark = "-" if r.doc_id is None else f"={r.doc_id}"
        assert r["shard"] == brute.jump(int(hashlib.md5(mark.encode()).hexdigest()[:16], 16), 500)
    few = frame(spark, rows).select("doc_id", sharding.jump(*sharding.key_bits("doc_id"), 500, steps=3).alias("j")).select("doc_id", "j.shard").collect()
    assert sorted((r.doc_id or -1, r["shard"]) for r in few) == sorted((r.doc_id or -1, r["shard"]) for r in wide)
    assert sharding.shard_documents(frame(spark, rows).limit(0), 16).count() == 0


def test_license_scan(spark, odd):
    rng = random.Random(9)
    docs = [r[:2] for r in odd]
    for i, (_, notice) in enumerate(license_scan.TEMPLATES):
        docs.append((100 + i, f"{words(rng, 30)}\n{notice}\n{words(rng, 10)} the MIT license, MIT. License"))
        docs.append((200 + i, f"{words(rng, 30)} {notice.upper().replace(' ', '  -- ')} {notice}"))
    got = {r.doc_id: r for r in license_scan.digest(license_scan.scan(frame(spark, docs))).collect()}
    for d, t in docs:
        w = brute.plain(t)
        places = sorted((i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None)
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        if d and d >= 100:
            assert license_scan.TEMPLATES[d % 100][0] in r.labels.split(",") and r.score == 1
        else:
            assert r.labels == r.base_labels
    assert license_scan.scan(frame(spark, docs).limit(0)).count() == 0


def test_suffix_automaton_matches_brute_force():
    rng = random.Random(10)
    for _ in range(60):
        templates = [[rng.randrange(4) for _ in range(rng.randrange(1, 14))] for _ in range(3)]
        text = [rng.randrange(5) for _ in range(60)]
        automaton = license_scan.SuffixAutomaton(templates)
        inside = lambda run: {(t, i + len(run)) for t, w in enumerate(templates) for i in range(len(w) - len(run) + 1) if w[i : i + len(run)] == run}  # noqa: E731, B023
        for i, (n, state) in enumerate(automaton.statistics(text), 1):
            assert n == max((n for n in range(1, i + 1) if inside(text[i - n : i])), default=0)
            if n >= 2:
                assert set(automaton.ends[automaton.anchor(state, 2)]) == inside(text[i - 2 : i])


def _chained(text, template, seed, gap):
    """Most words of the template that a chain of shared runs covers, by trying all chains; 0 without a run."""
    runs = []
    for x in range(len(text)):
        for y in range(len(template)):
            if text[x] == template[y] and not (x and y and text[x - 1] == template[y - 1]):
                n = next(k for k in range(len(text) + 1) if x + k == len(text) or y + k == len(template) or text[x + k] != template[y + k])
                if n >= seed:
                    runs.append((x, y, n))

    def longest(last, covered):
        u, v, m = last
        out = covered
        for x, y, n in runs:
            shared = max(0, u + m - x, v + m - y)
            if u < x and v < y and shared < n and x - u - m <= gap:
                out = max(out, longest((x, y, n), covered + n - shared))
        return out

    return max((longest(r, r[2]) for r in runs), default=0)


def test_license_labels_and_score_match_brute_force(spark):
    rng = random.Random(20)
    for case in range(6):
        templates = tuple((f"l{i % 4}", " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(4, 16)))) for i in range(6))
        docs = [(i, " ".join(rng.choice("abcdefgz") for _ in range(rng.randrange(0, 45)))) for i in range(40)]
        docs += [(100 + i, f"z z {' '.join(w for w in t.split() if rng.random() < 0.9)} z") for i, (_, t) in enumerate(templates)] + [(200, None)]
        got = {r.doc_id: r for r in license_scan.digest(license_scan.scan(frame(spark, docs), templates, {})).collect()}
        for d, t in docs:
            share = [(_chained(brute.plain(t), brute.plain(body), license_scan.SEED, license_scan.GAP) / len(body.split()), label) for label, body in templates]
            assert got[d].score == pytest.approx(max(s for s, _ in share)), (case, d)
            assert got[d].labels == ",".join(sorted({label for s, label in share if s >= license_scan.COVERED}))
    templates = (("x", "one two three four five six seven eight"), ("y", "five six seven eight nine"))
    (row,) = license_scan.digest(license_scan.scan(frame(spark, [(1, "four five six seven eight")]), templates, {})).collect()
    assert (row.labels, row.score) == ("y", 0.8)


def test_token_counts(spark, odd):
    ranked = [bytes([b]) for b in range(97, 110)] + [b"ab", b"abc", b" w", b"w1", b"cd", b"bcd", b" a", b"w12", "é".encode()]
    scores = token_counts.zipf_scores(ranked)
    unknown = min(scores.values()) - 10

    def best(token):
        out = [(0.0, 0)] + [(-math.inf, 0)] * len(token)
        for e in range(1, len(token) + 1):
            c = [(out[b][0] + scores[token[b:e]], -out[b][1] - 1) for b in range(e) if token[b:e] in scores]
            s, n = max(c) if c else (out[e - 1][0] + unknown, -out[e - 1][1] - 1)
            out[e] = (s, -n)
        return out[-1]

    docs = [r[:2] for r in odd] + [(50, "abcd abcd aabbccdd fghabc é ab"), (51, "mnop " * 3)]
    rows = by_id(token_counts.count_tokens(frame(spark, docs), scores), "n_pretokens", "n_tokens", "log_score")
    want = []
    for d, t in docs:
        cut = Counter(token_counts.regex.findall(token_counts.PRE_TOKEN, t or ""))
        found = {c: best(c.encode()) for c in cut}
        want.append([d, cut.total(), sum(n * found[c][1] for c, n in cut.items()), math.fsum(n * found[c][0] for c, n in cut.items())])
    want.sort(key=lambda r: (r[0] is None, r))
    assert [r[:3] for r in rows] == [r[:3] for r in want]
    assert [r[3] for r in rows] == pytest.approx([r[3] for r in want], rel=1e-12)
    assert token_counts.count_tokens(frame(spark, docs).limit(0), scores).count() == 0
    trie = token_counts.TokenTrie(scores, nodes=5)
    assert [trie.text([c])[0] for c in ("abcd", "abce", "zz", "abcd")] == [best(c.encode())[1] for c in ("abcd", "abce", "zz", "abcd")]


def test_toxicity_on_held_out_rows(spark, odd):
    rng = random.Random(12)
    bad = ["idiot", "scum", "trash"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 7 == 0
        text = words(rng, 60, 2000).split() + (rng.sample(bad, 2) if toxic else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        if i < 400:
            labels.append((i, int(i % 3 > 0), int(toxic)))
    labels += [(900, None, 1), (901, 1, None), (None, 1, 1), (0, 1, 1)]
    docs = frame(spark, rows + [(1000 + i, r[1]) for i, r in enumerate(odd)])
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    chain = toxicity.fit(docs, table)
    assert [c.name for c in chain] == ["low_quality", "toxic", "severe"]
    got = {r.doc_id: r for r in toxicity.predict(docs, chain).collect()}
    assert len(got) == 600 + len(odd)
    assert all(got[i].is_toxic == (i % 7 == 0) for i in range(400, 600))
    assert not any(got[1000 + i].is_toxic for i in range(len(odd)))
    again = {r.doc_id: r.p_toxic for r in toxicity.predict(docs, toxicity.fit(docs.repartition(5), table)).collect()}
    assert again == pytest.approx({d: r.p_toxic for d, r in got.items()})
    none = toxicity.predict(docs, toxicity.fit(docs, table.limit(0)))
    assert none.agg(F.max("p_toxic")).first()[0] < 1e-9 and none.count() == len(got)
    assert toxicity.predict(docs.limit(0), chain).count() == 0


def test_chain_matches_a_plain_version():
    """fit_chain against sets, loops and gradient steps: words chosen inside each fold, probabilities out of fold, weights at the penalty's optimum."""
    rng = random.Random(21)
    docs, a, b = [], [], []
    for i in range(240):
        a.append(rng.random() < 0.3)
        b.append(a[-1] and rng.random() < 0.7 or rng.random() < 0.05)
        docs.append(set(rng.sample(range(100, 160), 12)) | set(rng.sample(range(6), 3) if a[-1] else ()) | set(rng.sample(range(20, 26), 3) if b[-1] else ()))

    def telling(rows, y):
        out = []
        n1, n0 = max(1, sum(y)), max(1, len(y) - sum(y))
        for w in sorted(set().union(*rows)):
            c1, c0 = sum(w in d for d, t in zip(rows, y) if t), sum(w in d for d, t in zip(rows, y) if not t)
            p = (c1 + c0 + 0.5) / (n1 + n0 + 1)
            if abs(c1 / n1 - c0 / n0) / math.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)) >= toxicity.SIGNAL:
                out.append(w)
        return out

    def fitted(rows, y, earlier):
        words = telling(rows, y)
        x = np.array([[*(float(w in d) for w in words), *e, 1.0] for d, e in zip(rows, earlier)])
        w, ridge = np.zeros(x.shape[1]), np.array([1.0] * (x.shape[1] - 1) + [1e-3])
        step = 1 / (0.25 * np.linalg.norm(x, 2) ** 2 + 1)
        momentum = w
        for k in range(20_000):
            grad = x.T @ (1 / (1 + np.exp(-x @ momentum)) - np.array(y, float)) + ridge * momentum
            new = momentum - step * grad
            momentum, w = new + k / (k + 3) * (new - w), new
        return words, w

    def p_of(words, w, rows, earlier):
        return [1 / (1 + math.exp(-(sum(w[i] for i, x in enumerate(words) if x in d) + sum(w[len(words) + i] * v for i, v in enumerate(e)) + w[-1]))) for d, e in zip(rows, earlier)]

    chain = toxicity.fit_chain([np.array(sorted(d)) for d in docs], {"a": np.array(a), "b": np.array(b)})
    earlier = [[] for _ in docs]
    for link, y in zip(chain, (a, b)):
        words, w = fitted(docs, y, earlier)
        assert link.buckets.tolist() == words and len(words) >= 5
        assert link.weights == pytest.approx(w, abs=1e-4)
        held = [0.0] * len(docs)
        for f in range(5):
            own = [i for i in range(len(docs)) if i % 5 != f]
            part = [i for i in range(len(docs)) if i % 5 == f]
            model = fitted([docs[i] for i in own], [y[i] for i in own], [earlier[i] for i in own])
            for i, p in zip(part, p_of(*model, [docs[i] for i in part], [earlier[i] for i in part])):
                held[i] = p
        f1 = lambda t: 2 * sum(p >= t and k for p, k in zip(held, y)) / (sum(p >= t for p in held) + sum(y))  # noqa: E731, B023
        assert f1(link.threshold) == pytest.approx(max(f1(t) for t in held))
        earlier = [e + [p] for e, p in zip(earlier, held)]


def test_line_dedup(spark, odd):
    rng = random.Random(13)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.choice([21, 31, 32, 33, 63, 64, 65, 100, 200]))).strip() + "end" for _ in range(60)]
    pool = []
    for line in base:
        pool.append(line)
        for _ in range(6):
            i, c = rng.randrange(len(line)), rng.choice("abcdz")
            pool.append(rng.choice([line[:i] + c + line[i + 1 :], line[:i] + line[i + 1 :], line[:i] + c + line[i:], line + c, c + line, line[1:]]))
    rows = [(i, "\n".join(rng.choice(["", "  "]) + rng.choice(pool) + rng.choice(["", " ", "\r"]) for _ in range(rng.randrange(1, 9)))) for i in range(150)]
    rows += [(i + 500, t) for i, (_, t, *_) in enumerate(odd) if i != 6] + [(3, rows[3][1])] + [(700, "tiny\ntinx\ntiny"), (701, "\n\n"), (None, base[0]), (702, "a\nb\nab\n12\n1\n\n13"), (703, "\n".join(f"{rng.randrange(30)}" for _ in range(400)))]
    docs = frame(spark, rows).withColumns({"k1": F.lit("k"), "line": F.lit(1), "gone": F.lit(2)})
    for least in (20, 0):
        _hold_lines(docs, rows, least)


def _hold_lines(docs, rows, least):
    want = {}
    first, seen = {}, []
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        for n, line in enumerate((t or "").split("\n")):
            line = line.strip(" \t\n\x0b\x0c\r")
            if not line:
                continue
            if line in first:
                want[d, n] = "exact"
            else:
                if len(line) >= least and any(len(x) >= least and brute.edit_within_one(x, line) for x in seen):
                    want[d, n] = "near"
                first[line] = d
                seen.append(line)
    keys = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k1")).distinct()
    got = line_dedup.dropped_lines(docs, least).join(keys, "k1").collect()
    assert {(r.doc_id, r.line_no): r.reason for r in got} == want
    assert sum(r == "near" for r in want.values()) > 50
    if least:
        return
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, least).collect()}
    assert line_dedup.dedup_lines(docs.limit(0)).columns == docs.columns
    for d, t in rows:
        assert out[d] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in want))
    per = Counter((d, r) for (d, _), r in want.items())
    for r in line_dedup.digest(docs, least).collect():
        assert (r.n_exact, r.n_near) == (per[r.doc_id, "exact"], per[r.doc_id, "near"])
    assert line_dedup.digest(docs).count() == len(rows) and line_dedup.digest(docs.limit(0)).count() == 0


def near_classes(docs, idf):
    """doc_id -> class, from all pairs."""
    def weights(t):
        w = brute.plain(t)
        from cutroom.llm.words import Text

        data = np.frombuffer((t or "").encode(), np.uint8)
        h = Text(data, np.array([0, len(data)], np.int64)).words(ALNUM, lower=True).hashes
        own = [float(idf[int(x) >> 46]) for x in h]
        n = min(5, len(w))
        out = Counter()
        for i in range(len(w) - n + 1 if n else 0):
            out[tuple(w[i : i + n])] += sum(own[i : i + n]) / n
        return out

    rows = sorted(((d, t) for d, t in docs if d is not None), key=lambda r: r[0])
    bags, root = [weights(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    near_edge = 0
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] == rows[j][0]:
                same = True
            elif rows[i][1] is None or rows[j][1] is None:
                same = False
            elif not bags[i] or not bags[j]:
                same = rows[i][1] == rows[j][1]
            else:
                keys = bags[i].keys() | bags[j].keys()
                low, high = sum(min(bags[i][k], bags[j][k]) for k in keys), sum(max(bags[i][k], bags[j][k]) for k in keys)
                same = low / high >= near_dedup.SIMILARITY
                near_edge += abs(low / high - near_dedup.SIMILARITY) < 1e-9
            if same:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert not near_edge
    return {d: rows[find(i)][0] for i, (d, _) in enumerate(rows)}


def edited(rng, text, share):
    w = text.split()
    for i in rng.sample(range(len(w)), max(1, int(len(w) * share))):
        w[i] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_dedup(spark, odd):
    rng = random.Random(14)
    docs = [r[:2] for r in odd]
    for g in range(12):
        base = words(rng, rng.choice([4, 30, 120, 400]), 3000)
        for k in range(5):
            docs.append((100 + 10 * g + k, base if k == 4 else edited(rng, base, 0.02) if k else base.upper() + "!"))
    passage = words(rng, 60, 3000)
    docs += [(1000 + i, passage + " " + words(rng, 60, 3000)) for i in range(40)]
    docs += [(2000, ""), (2001, None)]
    docs += [(3000, docs[15][1]), (3000, docs[40][1]), (3001, None), (3001, docs[41][1]), (3002, None), (3002, None)]
    df = frame(spark, docs)
    want = near_classes(docs, near_dedup.idf_table(df))
    got = near_dedup.near_duplicates(df).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert {r.doc_id for r in got if r.is_first and r.doc_id is not None} == set(want.values())
    kept = near_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert want[docs[15][0]] == want[docs[40][0]] == want[3001] and want[2001] != want[3002]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(set(want.values())) + Counter({None: 1})
    assert sorted(map(str, kept.collect())) == sorted(map(str, near_dedup.drop_near_duplicates(df.repartition(5)).collect()))


def test_near_dedup_of_a_large_group(spark):
    rng = random.Random(15)
    base = words(rng, 300, 10**6)
    docs = [(500, base)] + [(i, edited(rng, base, 0.014)) for i in range(120)] + [(1000 + i, words(rng, 200, 10**6)) for i in range(30)]
    df = frame(spark, docs)
    want = near_classes(docs, near_dedup.idf_table(df))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert max(Counter(want.values()).values()) > 60
    assert got == want


def test_icws_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 600).astype(np.uint64)
    a, b = np.exp(rng.normal(size=500)), np.exp(rng.normal(size=500))
    b[:350] = a[100:450] * np.where(rng.random(350) < 0.5, 1, 1.3)
    ka, kb = keys[:500], keys[100:]
    drawn = near_dedup.sample(np.concatenate([ka, kb]), np.concatenate([a, b]), np.array([0, 500, 1000]), 256)
    x, y = dict(zip(ka.tolist(), a)), dict(zip(kb.tolist(), b))
    every = x.keys() | y.keys()
    true = sum(min(x.get(k, 0), y.get(k, 0)) for k in every) / sum(max(x.get(k, 0), y.get(k, 0)) for k in every)
    assert abs((drawn[0] == drawn[1]).mean() - true) < 0.12


def test_components(spark):
    rng = random.Random(16)
    name = lambda i: f"{i:05d}".encode()
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [tuple(sorted(rng.sample(range(200, 260), 2))) for _ in range(40)]
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges], "a binary, b binary")
    got = {bytes(r.key): bytes(r.root) for r in near_dedup.components(df, Shelf(spark)).collect()}
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {name(k): name(v) for k, v in root.items()}


def _forward_by_hand(tokens, base, model, table, head):
    """log10 probability of a text's tokens (hashes) from the formulas, in plain Python."""
    states = len(model.begin)
    at_other = 10 ** base.symbol_log10()[-1]
    lacking = 0.5 / base.whole / at_other
    share_of = {w: [q / sum(qs) for q in qs] for w, (_, qs) in table.items()}
    sums = [sum(n * share_of[w][s] for w, (n, _) in table.items()) for s in range(states)]

    def emission(w):
        if w in head:
            return [model.emit[head[w], s] for s in range(states)]
        n = table[w][0] if w in table else 0
        u = (n + 0.5) / base.whole / at_other
        if not n:
            return [model.emit[-1, s] * u for s in range(states)]
        lam = language_model.LEARNT
        return [model.emit[-1, s] * (lam * n * share_of[w][s] / sums[s] * (1 - lacking) + (1 - lam) * u) for s in range(states)]

    total, alpha = 0.0, list(model.begin)
    for i, w in enumerate(tokens):
        if i:
            alpha = [sum(alpha[r] * model.move[r, s] for r in range(states)) for s in range(states)]
        alpha = [a * e for a, e in zip(alpha, emission(w))]
        total += math.log10(sum(alpha))
        alpha = [a / sum(alpha) for a in alpha]
    return total


def _whole_model(docs, rounds, states=8):
    shelf = Shelf(docs.sparkSession)
    training = docs.filter(~language_model.is_held_out(F.col("doc_id")))
    base = language_model.base_model(language_model.count_words(training), language_model.HEAD, language_model.KNOWN)
    texts = language_model.symbol_texts(training, base, shelf)
    model = language_model.baum_welch(texts, base, rounds, states)
    table = language_model.emission_table(texts, base, model, shelf)
    return base, texts, model, table, shelf


def test_language_model(spark, odd, monkeypatch):
    """Base columns and the score against plain Python, with words in the head, among the known and beyond; held-out texts score better than under the base."""
    rng = random.Random(17)
    langs = [[f"{p}{i}" for i in range(120)] for p in "xyz"]
    rows = [(i, " ".join(rng.choices(langs[i % 3], weights=[1 / (k + 1) for k in range(120)], k=rng.randrange(1, 90)))) for i in range(500)]
    rows += [(1000 + i, t) for i, (_, t, *_) in enumerate(odd)]
    docs = frame(spark, rows).withColumn("n_tokens", F.lit("x"))
    for small in ({"HEAD": 50, "KNOWN": 80, "CHUNK": 3000}, {}):
        for k, v in small.items():
            monkeypatch.setattr(language_model, k, v)
        base, _, model, table, shelf = _whole_model(docs, 4)
        got = {r.doc_id: r for r in language_model.score(docs, table, base, model, shelf).collect()}
        rare = {r.word % 2**64: (r.n, list((r.shares % 2**64).to_bytes(8, "little"))) for r in table.collect()}
        head = {int(w): int(h) for w, h in zip(base.words, base.head) if h < base.symbols - 1}
        assert len(rare) + len(head) == base.v
        held = [0.0, 0.0]
        for (d, score, n_known, n), (_, t) in zip(brute.base_scores(rows), rows):
            r = got[d]
            assert (r.held_out, r.n_known, r.train_tokens, r.n_tokens) == (brute.held_out(d), n_known, n, len(brute.SPACED.findall(t or "")) + 1)
            assert r.base_score == pytest.approx(score, rel=1e-9)
            if d % 10 == 0 and d < 1000 or d > 1000 and r.n_tokens < 5000:
                _, hashes, _ = next(language_model._texts(pa.table({"t": [t]}).to_batches(), 0)) if t is not None else (0, np.array([language_model.END]), 0)
                assert r.score == pytest.approx(_forward_by_hand(hashes.tolist(), base, model, rare, head), rel=1e-6)
            if r.held_out and d < 1000:
                held[0] += r.base_score
                held[1] += r.score
        assert held[1] > held[0] * 0.97
        monkeypatch.undo()
    none = language_model.fit_and_score(docs.filter("doc_id = 1001 OR doc_id IS NULL"), 1)
    assert all(math.isfinite(r.score) for r in none.collect())
    assert language_model.fit_and_score(docs.limit(0), 1).count() == 0


def test_emissions_of_words_outside_the_head_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD", 20)
    rng = random.Random(18)
    docs = frame(spark, [(i, words(rng, 40, 200)) for i in range(60)])
    base, _, model, table, _ = _whole_model(docs, 2, states=3)
    made = language_model.emissions(table, base, model)
    rows = table.collect()
    n = np.array([r.n for r in rows])
    share = (n + 0.5) / base.whole / 10 ** base.symbol_log10()[-1]
    factors = made.of_others(n, language_model._shares(np.array([r.shares for r in rows]), 3), share)
    assert (share[:, None] * factors).sum(0) + made.other * made.lacking == pytest.approx(made.other, rel=1e-5)


def test_forward_and_expected_counts_match_brute_force():
    rng = np.random.default_rng(3)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    hmm = language_model.Hmm(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((4, 3)), 0))
    seqs = [rng.integers(0, 4, n) for n in (1, 5, 3, 6, 6, 2)]
    symbols, begins = np.concatenate(seqs), np.cumsum([0] + [len(s) for s in seqs])
    import itertools

    begin, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3))
    each = np.zeros((len(symbols), 3))
    for k, s in enumerate(seqs):
        paths = {p: (hmm.begin[p[0]] * np.prod([hmm.emit[x, i] for x, i in zip(s, p)]) * np.prod([hmm.move[a, b] for a, b in zip(p, p[1:])])) for p in itertools.product(range(3), repeat=len(s))}
        whole = sum(paths.values())
        for p, q in paths.items():
            begin[p[0]] += q / whole
            for a, b in zip(p, p[1:]):
                move[a, b] += q / whole
            for j, (x, i) in enumerate(zip(s, p)):
                emit[x, i] += q / whole
                each[begins[k] + j, i] += q / whole
        assert hmm.log10(hmm.emit[s], np.array([0, len(s)]))[0] == pytest.approx(math.log10(whole))
    for chunk in (1, 2, 5, 7, 1000):
        found = np.zeros_like(each)
        got = hmm.expect(symbols, begins, chunk, lambda places, states: found.__setitem__(places, states))  # noqa: B023
        for a, b in zip(got, (begin, move, emit)):
            assert a == pytest.approx(b)
        assert found == pytest.approx(each)


def test_hmm_is_a_distribution(spark):
    """Rows of the tables sum to one, and so do, over all texts of up to a few symbols and their continuations, the probabilities."""
    import itertools

    rows = [(i, t) for i, t in enumerate(["a b", "a a c", "b", "d", "a b a", "c d"] * 3)]
    base = language_model.base_model(language_model.count_words(frame(spark, rows)), 2, 3)
    assert (10 ** base.symbol_log10()).sum() == pytest.approx(1)
    model = language_model.baum_welch(language_model.symbol_texts(frame(spark, rows), base, Shelf(spark)), base, 2, states=2)
    assert model.emit.sum(0) == pytest.approx(np.ones(2)) and model.move.sum(1) == pytest.approx(np.ones(2)) and model.begin.sum() == pytest.approx(1)
    for n in (1, 3):
        assert sum(10 ** model.log10(model.emit[list(s)], np.array([0, n]))[0] for s in itertools.product(range(base.symbols), repeat=n)) == pytest.approx(1)


def test_every_query_runs(spark):
    names = {int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")}
    assert names == set(range(1, 11))
    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    for query in queries.OPERATORS:
        if query.__name__ not in queries.ORACLE_SQL:
            df = query(spark, d)
            assert df.count() == n, query.__name__
            assert "doc_id" in df.columns


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    want = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(want.fetchall())
