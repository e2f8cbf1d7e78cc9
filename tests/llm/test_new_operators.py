"""Conversation trie, whitening and exact duplicates against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutroom.llm import conversation_trie, exact_dedup, language_model, near_dedup, whitening
from cutroom.llm.session import Shelf

DOCS = "doc_id bigint, text string, sender string, place int, group_size string, sha string"


def docs_of(spark, rows, parts=3):
    """More columns clash with the operator's own names."""
    return spark.createDataFrame([(*r, "x", 1, None, "y") for r in rows], DOCS).repartition(parts)


def plain_duplicates(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = []
    for text, ids in groups.items():
        ids = sorted(ids, key=lambda d: (d is not None, d or 0), reverse=True)
        out += [(d, ids[0], len(ids), i == 0, hashlib.sha256(text.encode()).hexdigest()) for i, d in enumerate(ids)]
    return Counter(out)


ODD = [(1, "a"), (1, "a"), (2, "a "), (3, None), (4, ""), (None, "a"), (None, "lone"), (5, "ñ" * 100_000), (6, "ñ" * 100_000), (7, "ñ" * 99_999), (8, " "), (-3, "tie"), (-3, "tie"), (None, "nulls"), (None, "nulls")]


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_exact_duplicates(spark, monkeypatch, chunk):
    monkeypatch.setattr(exact_dedup, "CHUNK", chunk)
    rng = random.Random(1)
    rows = ODD + [(100 + i, f"text {rng.randrange(150)}") for i in range(400)] + [(1000 + i, "hot") for i in range(300)]
    docs = docs_of(spark, rows, 5)
    assert Counter(map(tuple, exact_dedup.exact_duplicates(docs).collect())) == plain_duplicates(rows)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text or "") for r in kept.collect()) == Counter((d, t or "") for d, t in {t or "": max((x for x, u in rows if (u or "") == (t or "")), key=lambda x: (x is not None, x or 0)) for _, t in rows}.items() for d, t in [(t, d)])
    for name in ("exact_duplicates", "drop_exact_duplicates"):
        assert getattr(exact_dedup, name)(docs.limit(0)).count() == 0


def test_equal_fingerprints_of_different_texts_are_told_apart(spark, monkeypatch):
    """Fingerprints of so few bits that most texts share theirs with others: bytes decide."""
    monkeypatch.setattr(exact_dedup, "SPARE", -2)
    rows = [(i, f"text {i % 500}") for i in range(900)]
    docs = docs_of(spark, rows)
    held = exact_dedup.chunks(docs)
    marks = exact_dedup.marked(held, exact_dedup.duplicate_bitmaps(exact_dedup.messages(held, 8, 6)), 8, 6)
    assert marks.filter("suspect").count() > 860  # 800 rows of 400 texts, and six in seven of the 100 others
    assert Counter(map(tuple, exact_dedup.exact_duplicates(docs).collect())) == plain_duplicates(rows)


def test_fingerprints_take_few_bits():
    rng = np.random.default_rng(2)
    for width, n in ((30, 5000), (45, 3), (6, 64), (20, 1)):
        values = np.unique(rng.integers(0, 1 << width, n))
        k, unary, rest = exact_dedup.encode(values, width)
        assert (exact_dedup.decode(len(values), k, unary, rest) == values).all()
        assert len(unary) + len(rest) <= (width - np.log2(len(values)) + 2.6) * len(values) / 8 + 2


def test_unsuspected_rows_are_few_in_the_shuffle_of_texts(spark):
    rows = [(i, f"text {i}") for i in range(2000)] + [(5000 + i, "twice") for i in range(2)]
    docs, shelf = docs_of(spark, rows), Shelf(spark)
    held = shelf.put(exact_dedup.chunks(docs))
    marks = exact_dedup.marked(held, exact_dedup.duplicate_bitmaps(exact_dedup.messages(held, 23, 6)), 23, 6)
    assert 2 <= marks.filter("suspect").count() <= 6


TURNS = "conv_id bigint, turn int, role string, text string, place int, digest string, depth long"


def plain_trie(rows):
    """Nodes by sequences of turns; rows: (conv_id, turn, role, text)."""
    sha = lambda s: hashlib.sha256((s or "").encode()).hexdigest()
    own = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            own[c].append(((n is not None, n or 0), hashlib.sha256((sha(role) + sha(text)).encode()).digest(), (role or "", text or "")))
    own = {c: [t for *_, t in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        convs[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    out = Counter()
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k))
        out[(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def trie_of(spark, rows):
    shelf = Shelf(spark)
    turns = shelf.put(conversation_trie.ordered_turns(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TURNS).repartition(3)))
    return Counter(tuple(r)[:-1] for r in conversation_trie.prefix_trie(conversation_trie.rebuilt(turns)).collect())


def test_conversation_trie(spark):
    rng = random.Random(4)
    rows = [(c, n, rng.choice("ua"), rng.choice(["yes", "nö", "", None])) for c in range(-30, 90) for n in range(rng.randrange(1, 12))]
    rows += [(200 + c, n, "u", "same") for c in range(60) for n in range(9)]  # copies of one conversation
    rows += [(301, None, None, None), (301, 5, None, "x"), (301, 5, "u", "x"), (301, 5, "u", "x"), (None, 0, "u", "no conversation"), (402, 0, "u", "alone")]
    want = plain_trie(rows)
    assert trie_of(spark, rows) == want
    assert any(n > 1 for *_, n in want.items()) or len(want) > 300
    assert not trie_of(spark, [])


def test_conversations_longer_than_blocks(spark):
    """Paths over several blocks that part within a block, at a border, and end at one."""
    same = [("u", f"t{i % 7}") for i in range(700)]
    rows = [(0, i, *t) for i, t in enumerate(same)] + [(5, i, *t) for i, t in enumerate(same[:512])] + [(10, i, *t) for i, t in enumerate(same[:256] + [("a", "off")] * 300)] + [(15, i, *t) for i, t in enumerate(same[:600] + [("a", "z")])]
    assert trie_of(spark, rows) == plain_trie(rows)


def test_members_of_a_node_are_digested_in_pieces(spark):
    """Twenty thousand conversations that end at one node, which several tasks have pieces of."""
    ends = spark.range(20_000).select(F.lit(b"n").alias("digest"), F.col("id").alias("conv_id")).union(spark.createDataFrame([(b"m", 3)], "digest binary, conv_id long"))
    got = {bytes(r.digest): r.ends_sha256 for r in conversation_trie.member_digests(ends.repartition(6)).collect()}
    assert got == {b"n": hashlib.sha256(",".join(map(str, range(20_000))).encode()).hexdigest(), b"m": hashlib.sha256(b"3").hexdigest()}


VECTORS = "vec_id bigint, embedding array<float>, n string, component int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0) for i, v in rows], VECTORS).repartition(3)


def plain_whitening(vectors):
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    centred = ((x * n - sums) / n).astype(float)
    values, components = np.linalg.eigh(centred.T @ centred / n)
    return ((x * n - sums) ** 2).sum(axis=1), values[::-1], centred @ components[:, ::-1] / np.sqrt(values[::-1])


def test_whitening(spark):
    rng = np.random.default_rng(3)
    good = (rng.normal(size=(600, 40)) @ rng.normal(size=(40, 40))).astype(np.float32).tolist()
    rows = list(enumerate(good)) + [(900 + i, good[0]) for i in range(300)] + [(None, good[1])]
    bad = [(700, None), (701, [float("nan")] + good[0][1:]), (702, [float("inf")] + good[0][1:]), (703, [None] + good[0][1:]), (704, []), (705, [1.0, 2.0])]
    got = whitening.whiten(vectors_of(spark, rows + bad)).collect()
    deviation, values, whitened = plain_whitening([v for _, v in rows])
    assert len(got) == 32 * len(rows) and {r.component for r in got} == set(range(1, 33)) and {r.n for r in got} == {len(rows)}
    place = {i: at for at, (i, _) in enumerate(rows)}
    signs = {r.component: np.sign(r.whitened * whitened[0, r.component - 1]) for r in got if r.vec_id == 0}
    for r in got:
        at, c = place[r.vec_id], r.component - 1
        assert r.deviation == deviation[at]
        assert r.whitened * signs[r.component] == pytest.approx(whitened[at, c], rel=1e-6, abs=1e-6)
        assert r.explained == pytest.approx(values[c] / values.sum(), rel=1e-9) and r.identity_error < 1e-8


def test_whitening_without_variance_or_rows(spark):
    got = whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0, 5.0]), (2, [1.0, 3.0, 5.0]), (2, [1.0, 3.0, 5.0])])).collect()
    assert [(r.component, r.whitened is None) for r in got if r.vec_id == 1] == [(1, False), (2, True), (3, True)]
    assert {r.explained for r in got} == {0.0, 1.0} and all(r.identity_error < 1e-12 for r in got)
    for rows in ([], [(1, None)], [(2, [])]):
        assert whitening.whiten(vectors_of(spark, rows)).collect() == []
    huge = whitening.whiten(vectors_of(spark, [(1, [3e38, 1.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])])).collect()
    assert len(huge) == 6 and all(r.n == 3 for r in huge)


def test_deviations_beyond_a_long():
    model = whitening.Whitening(10**9, [10**15, 10**15 + 1], np.zeros(0), np.zeros((2, 0)), np.zeros(0))
    x = np.array([[1_000_000, 1_000_000], [1_000_002, 1_000_001], [1_000_009, 1_000_009]])
    exact = [sum((10**9 * int(v) - s) ** 2 for v, s in zip(row, model.sums, strict=True)) for row in x]
    assert model.deviations(x).to_pylist() == [v if v < 2**63 else None for v in exact]
    assert exact[1] < 2**63 < exact[2]


def test_one_document_of_very_many_rows_is_numbered_in_small_windows(spark):
    """A hundred thousand rows without doc_id, half of them equal: slots have no gaps, no window holds more than a few of them."""
    from cutroom.llm import sharding

    docs = spark.range(50_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    docs = docs.union(spark.range(50_000).select(F.lit(None).cast("bigint"), F.lit("copy"))).union(spark.range(50).select("id", F.lit(None).cast("string")))
    rows = sharding.shard_documents(docs)
    slots = rows.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("m")).collect()
    assert sum(r.n for r in slots) == 100_050 and all(r.n == r.m == r.last + 1 for r in slots)
    windows = sharding.runs(docs).groupBy(F.pmod(F.xxhash64(*sharding.ORDER), F.lit(sharding.BLOCKS)).alias("block")).count()
    assert windows.agg(F.max("count")).first()[0] < 500


def test_near_texts_of_one_document(spark):
    """Two thousand rows of one doc_id whose texts are near each other are one class, and each text is read once."""
    from cutroom.llm import near_dedup

    rng = random.Random(9)
    body = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = [(7, " ".join([*body[: i % 140], f"x{i}", *body[i % 140 :]])) for i in range(2000)] + [(8, " ".join([*body, "end"])), (9, " ".join(f"z{rng.randrange(5000)}" for _ in range(80)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.class_id) for r in got} == {(7, 7), (8, 7), (9, 9)}
    assert all((r.n_links > 0) == (r.doc_id != 9) for r in got)
    idf = spark.sparkContext.broadcast(near_dedup.idf_table(docs))
    keys = near_dedup.sketches(docs, idf).select("key").distinct()
    assert near_dedup.keyed(docs.union(docs), keys).count() == len(rows)  # not 2,000 times as many
    few = spark.createDataFrame(keys.limit(3).collect(), "key binary")
    assert {bytes(r.key) for r in near_dedup.keyed(docs, few).collect()} == {bytes(r.key) for r in few.collect()}
    table = near_dedup.bit_table(few, "key")
    assert sum(near_dedup.in_table(table, bytes(r.key)) for r in keys.collect()) == 3


def test_near_lines_of_a_million_characters(spark):
    """Two lines of a million characters, one edit apart in the middle, take seconds; so do lines around the length at which blocks are hashed another way."""
    import time

    from cutroom.llm import line_dedup

    rng = random.Random(12)
    letters = "abcdefghij éü😀"
    long = "".join(rng.choice(letters) for _ in range(1_000_000))
    medium = ["".join(rng.choice(letters) for _ in range(n)) for n in (1023, 1024, 1025, 1056, 1057, 2080, 9000)]
    rows, near = [(0, "x" + long[1:-1] + "x"), (1, "x" + long[1:500_000] + "#" + long[500_001:-1] + "x")], 1
    for i, line in enumerate(medium):
        line = "x" + line[1:-1] + "x"
        edits = [line, line[:700] + "#" + line[701:], line[:33] + line[34:], line[: len(line) // 2] + "##" + line[len(line) // 2 + 2 :], line[:-1] + "##" + "x"]
        rows += [(10 + 10 * i + k, e) for k, e in enumerate(edits)]
        near += 2
    begin = time.perf_counter()
    got = {r.doc_id: r.n_near for r in line_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert time.perf_counter() - begin < 120
    want = {d: 0 for d, _ in rows} | {1: 1} | {10 + 10 * i + k: 1 for i in range(len(medium)) for k in (1, 2)}
    assert got == want


def shuffled(spark, act):
    """act's result, and the bytes that its stages wrote to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    out = act()
    return out, sum(n for k, n in written().items() if k not in before)


@pytest.mark.parametrize("size", [300, 3000])
def test_lines_like_no_other_are_not_shuffled(spark, size):
    """Texts of lines that share no half with another line, or are only equal to others, stay where they are read."""
    from cutroom.llm import line_dedup

    rng = random.Random(21)
    letters = "".join(map(chr, range(48, 112)))
    lines = ["".join(rng.choices(letters, k=size)) for _ in range(1_200_000 // size)]
    rows = [(i, "\n".join(lines[i::100])) for i in range(100)]
    rows += [(100, rows[7][1] + "\nnew"), (101, lines[0][:40] + "~" + lines[0][41:]), (102, lines[1] + "~"), (103, lines[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, moved = shuffled(spark, lambda: {r.doc_id: (r.n_exact, r.n_near) for r in line_dedup.digest(docs).collect()})
    found = {100: (len(lines[7::100]), 0), 101: (0, 1), 102: (0, 1), 103: (1, 0)}
    assert got == {d: found.get(d, (0, 0)) for d, _ in rows}
    # hashes of 300 characters take a third of them at most
    assert moved < sum(len(t) for _, t in rows) / 2


def test_near_texts_that_are_no_links_are_no_rows(spark, monkeypatch):
    """Texts near to all of a large group, but to none enough, are compared with it without a row for each pair."""
    draw, seen = random.Random(3), {}
    base = [f"w{i}" for i in range(200)]

    def near(i, n):
        words = list(base)
        for place in draw.sample(range(10, 190), n):
            words[place] = f"x{i}y{place}"
        return " ".join(words)

    docs = spark.createDataFrame([(i, near(i, 2 if i < 60 else 3)) for i in range(140)], "doc_id long, text string")
    verified = near_dedup._verified_in_cells

    def counted(likely, texts, idf):
        out = verified(likely, texts, idf)
        seen.update(rows=likely.count(), found=out.count())
        return out

    monkeypatch.setattr(near_dedup, "_verified_in_cells", counted)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    table = near_dedup.idf_table(docs)
    texts = {r.doc_id: near_dedup._one(r.text) for r in docs.collect()}
    bags = {i: near_dedup.shingles(t.words(near_dedup.ALNUM, lower=True), table)[:2] for i, t in texts.items()}
    likely, up = 0, {i: i for i in bags}

    def top(i):
        return i if up[i] == i else top(up[i])

    for i in bags:
        for j in range(i):
            alike = near_dedup._jaccard(*bags[i], *bags[j])
            if alike >= near_dedup.SIMILARITY:
                x, y = sorted((top(i), top(j)))
                up[y] = x
    classes = {i: top(i) for i in bags}
    for i in bags:
        likely += sum(classes[i] != classes[j] and near_dedup._jaccard(*bags[i], *bags[j]) >= 0.74 for j in range(i))
    assert got == classes
    assert likely > 1000 and seen["rows"] < likely / 3


def test_base_scores_are_those_of_the_whole_model(spark, monkeypatch):
    """The base columns, without training the HMM, equal those that the whole operator gives; words beyond the frequent ones meet the table."""
    draw = random.Random(9)
    docs = spark.createDataFrame([(i, None if i == 3 else " ".join(f"w{int(draw.expovariate(0.02))}" for _ in range(draw.randrange(60)))) for i in range(120)], "doc_id long, text string")
    monkeypatch.setattr(language_model, "KNOWN", 40)
    monkeypatch.setattr(language_model, "HEAD", 20)
    whole = language_model.fit_and_score(docs, 1)
    monkeypatch.setattr(language_model, "baum_welch", None)
    base = language_model.base_scores(docs)
    rows = lambda df: sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in df.select(base.columns).collect())
    assert rows(base) == rows(whole) and len(base.columns) == 6
