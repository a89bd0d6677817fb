"""Mixing, sharding, near duplicates, repeated passages and the pipeline: against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dexlake.llm import components, jaccard_join, lyndon, mixing, sharding, suffix_dedup

rnd = random.Random(11)


def words(n, seed=None):
    r = random.Random(seed) if seed is not None else rnd
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base, passage = words(160, 1), words(90, 2)
    rows = [(i, base if i % 3 == 0 else None if i % 11 == 0 else "" if i % 13 == 0 else words(rnd.randint(1, 60)), f"s{i % 4}" if i % 7 else None) for i in range(60)]
    changed = base.split()
    for k in range(12):  # near copies, each a little further from the base
        changed = [*changed]
        changed[7 * k + 3] = f"edit{k}"
        rows.append((100 + k, " ".join(changed), "s0"))
    rows += [(200 + k, f"{words(40)} {passage} {words(40)}", "s1") for k in range(8)]
    rows += [(300, words(4, 3), "s9"), (301, words(4, 3), "s9"), (302, (words(3, 4) + " ") * 400, "s2")]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, source string, grp string, n int").cache()


def texts_of(frame):
    return {r["doc_id"]: r["text"] or "" for r in frame.select("doc_id", "text").collect()}


# mixing -------------------------------------------------------------------------------------------------------------------


def test_periods_keep_every_source_within_a_block(spark):
    for shares in ([1, 1], [3, 2, 1], [7, 5, 3, 1, 1], [1, 9]):
        order, w = mixing.period(spark, shares), sum(shares)
        had = [0] * len(shares)
        for t, k in enumerate(order, 1):
            had[k] += 1
            assert all(abs(h - a * t / w) < 1 for h, a in zip(had, shares, strict=True))
        assert had == shares


def test_schedule_equals_a_simulation(spark, docs):
    shares = {"s0": 5, "s1": 2, "s2": 1}
    got = mixing.schedule(docs, shares, block_bytes=512).collect()
    assert len(got) == docs.count()
    totals = Counter()
    for r in got:
        totals[r["_mix_source"]] += r["_mix_size"]
    left = {s: -(-totals[s] // 512) for s in [*shares, mixing.OTHER] if totals[s]}
    full, slot, start, had, expected = {**shares, mixing.OTHER: 1}, 0, 0, dict.fromkeys(left, 0), {}
    block = dict.fromkeys(left, 0)
    while left:
        w = sum(full[s] for s in left)
        ready = [(-(-(had[s] + 1) * w // full[s]), k, s) for k, s in enumerate(left) if had[s] * w // full[s] <= slot - start]
        _, _, s = min(ready)
        expected[s, block[s]] = slot
        had[s] += 1
        block[s] += 1
        left[s] -= 1
        slot += 1
        if not left[s]:
            left = {k: n for k, n in left.items() if n}
            start, had = slot, dict.fromkeys(left, 0)
    for r in got:
        assert r["_mix_slot"] == expected[r["_mix_source"], r["_mix_block"]]
        assert r["_mix_release"] <= r["_mix_slot"] < r["_mix_deadline"]


def test_mixing_keeps_all_rows_and_columns(docs):
    out = mixing.mixed(docs, {"s0": 3, "s1": 1}, partitions=3)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert mixing.mixed(docs.limit(0), {"s0": 1}).count() == 0
    with pytest.raises(ValueError):
        mixing.schedule(docs, {"s0": 0})


# sharding -----------------------------------------------------------------------------------------------------------------


def brute_shards(rows, shards):
    keyed = sorted((hashlib.md5((t or "").encode()).hexdigest()[:16], i, len((t or "").encode()) + 8, t) for i, t in rows)
    total, run, slots, out = sum(k[2] for k in keyed), 0, Counter(), {}
    for _, i, size, t in keyed:
        shard = min(shards - 1, (2 * run + size) * shards // (2 * total))
        out[i] = (size, zlib.crc32((t or "").encode()), shard, slots[shard])
        slots[shard] += 1
        run += size
    return out


@pytest.mark.parametrize("ranges", [1, 8])
def test_shards_equal_brute_force(spark, docs, monkeypatch, ranges):
    monkeypatch.setattr(sharding, "RANGES_PER_SHARD", ranges)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard_by_bytes(docs, 6).collect()}
    assert got == brute_shards(rows, 6)
    assert sharding.shard_by_bytes(docs.limit(0), 6).count() == 0


def test_copies_of_one_text_are_split_evenly(spark):
    frame = spark.createDataFrame([(i if i else None, "same text") for i in range(600)], "doc_id long, text string")
    got = sharding.shard_by_bytes(frame, 24).groupBy("shard").count().collect()
    assert len(got) == 24 and {r["count"] for r in got} == {25}


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    frame = spark.range(4000).selectExpr("lpad(hex(id), 32, '0') as key", "cast(10 as long) as size")
    monkeypatch.setattr(sharding, "SAMPLES_PER_RANGE", 1)
    bounds = sharding.splitters(frame, 40_000, 20)
    sizes = frame.groupBy(sharding._range_of(frame["key"], bounds)).count().collect()
    assert bounds == sorted(bounds) and max(r["count"] for r in sizes) <= 2 * 4000 // 20


# components, near duplicates ------------------------------------------------------------------------------------------------


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("case", ["chain", "star", "random", "none"])
def test_components(spark, case):
    r = random.Random(6)
    pairs = {"chain": [(i, i + 1) for i in range(70)], "star": [(0, i) for i in range(1, 50)], "random": [(r.randrange(90), r.randrange(90)) for _ in range(60)] + [(3, 3)], "none": []}[case]
    got = {x["id"]: x["component"] for x in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    assert got == union(pairs, nodes)


def shingles(text, width=5):
    """Shingles as tuples of words: nothing is hashed."""
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1))) if found else frozenset()


def brute_components(texts, similarity="0.8"):
    sets, least = {i: shingles(t) for i, t in texts.items()}, Fraction(similarity)
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, union(links, ids)


def test_shingles_are_sets_of_words():
    assert len(jaccard_join.shingle_set("A b\nC  d\te f")) == 2
    assert (jaccard_join.shingle_set("A b C d e") == jaccard_join.shingle_set("\x0ba B c  D\re ")).all()
    assert len(jaccard_join.shingle_set("one two")) == 1 and len(jaccard_join.shingle_set(" \n")) == len(jaccard_join.shingle_set(None)) == 0
    assert len(jaccard_join.shingle_set("É é b c d")) == 1 and (jaccard_join.shingle_set("É") != jaccard_join.shingle_set("é")).all()
    plain = {tuple(w[i : i + 5]) for w in [words(300, 8).split()] for i in range(len(w) - 4)}
    assert len(jaccard_join.shingle_set(words(300, 8))) == len(plain)


def near_copies(seed, n, copies):
    """A text and copies with ever more words changed: most copies aren't similar to most others."""
    r = random.Random(seed)
    base = words(n, seed).split()
    rows = [" ".join(base)]
    for k in range(copies):
        changed = [*base]
        for _ in range(1 + k % 5):
            changed[r.randrange(n)] = f"edit{seed}x{r.randrange(40)}"
        rows.append(" ".join(changed))
    return rows


@pytest.mark.parametrize(("known", "long", "most"), [(4, 32, 10**6), (2, 1, 10**6), (2, 3, 50), (2, 2, 0)])
def test_near_duplicates_equal_brute_force(spark, docs, known, long, most):
    """Whatever counts as known or long, and however small the table is, all links are found."""
    clusters = [*near_copies(41, 70, 60), *near_copies(42, 40, 60), *near_copies(43, 25, 40), *near_copies(44, 300, 20)]
    passage = words(30, 45)
    clusters += [f"{words(8, 300 + k)} {passage}" for k in range(30)]
    more = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(clusters)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(more)
    sizes, expected = brute_components(texts_of(docs))
    got = jaccard_join.jaccard_components(docs, known=known, long=long, most_known=most).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == expected
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes


@pytest.mark.parametrize(("known", "long", "similarity"), [(2, 2, 0.805), (4, 32, 0.5), (2, 1, 1.0)])
def test_near_copies_of_few_words_are_all_linked(spark, known, long, similarity):
    r, rows = random.Random(5), []
    for k in range(150):
        whole = words(r.randint(6, 30), 1000 + k).split()
        copies = [whole, whole[1:], whole[:-1], [*whole, f"more{k}"], [f"edit{k}", *whole[1:]], whole]
        rows += [(6 * k + i, " ".join(c)) for i, c in enumerate(copies)]
    sizes, expected = brute_components(dict(rows), str(similarity))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), known=known, long=long, similarity=similarity).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == expected
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes


def test_near_duplicates_tell_rows_apart(spark):
    """Repeated ids, null ids, long texts, and words that polynomials modulo a power of two can't tell apart."""
    morse = "a"
    while len(morse) < 1024:
        morse += morse.translate(str.maketrans("ab", "ba"))
    long = words(30_000, 50)
    rows = [(1, morse), (2, morse.translate(str.maketrans("ab", "ba"))), (3, words(50, 51)), (3, words(50, 52)), (4, words(50, 51)), (5, words(50, 52)), (None, words(50, 51)), (None, words(50, 53)), (6, long), (7, long + " end"), (8, None), (8, None)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in got if r["component_id"] is not None) == [(0, 46, 3), (1, 1, 1), (2, 1, 2), (3, 46, 3), (3, 46, 3), (4, 46, 3), (5, 46, 3), (6, 29996, 6), (7, 29997, 6), (8, 0, 8), (8, 0, 8)]
    assert [r["n_shingles"] for r in got if r["component_id"] is None] == [46]


def test_near_duplicates_of_nothing(docs):
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0
    assert jaccard_join.jaccard_components(docs.where("text is null or text = ''")).where("doc_id <> component_id").count() == 0


# suffix arrays, repeated passages ----------------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 4), st.lists(st.integers(0, 3), max_size=70), st.integers(1, 3))
def test_suffix_arrays(letters, raw, times):
    text = bytes(97 + x % letters for x in raw) * times
    assert lyndon.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute_dedup(texts, window):
    starts = defaultdict(list)
    raws = {i: t.encode() for i, t in texts.items()}
    for i, raw in raws.items():
        for k in range(len(raw) - window + 1):
            starts[raw[k : k + window]].append((i, k))
    covered = {i: bytearray(len(raw)) for i, raw in raws.items()}
    for places in starts.values():
        if len(places) > 1:
            for i, k in places:
                covered[i][k : k + window] = b"\1" * window
    out = {}
    for i, raw in raws.items():
        kept = bytes(b for b, c in zip(raw, covered[i], strict=True) if not c)
        spans = sum(c and not (k and covered[i][k - 1]) for k, c in enumerate(covered[i]))
        out[i] = (len(raw), sum(covered[i]), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("window", "gram", "most", "widths"), [(400, 200, 256, (26, 1)), (40, 20, 2, (5, 1)), (40, 20, 1, (1,)), (64, 16, 3, (7, 1))])
def test_removal_equals_brute_force(docs, window, gram, most, widths):
    expected = brute_dedup(texts_of(docs), window)
    got = suffix_dedup.dedup_digests(docs, window=window, gram=gram, most_contexts=most, widths=widths).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == expected


def test_blocks_of_long_texts(monkeypatch):
    raw = words(400, 9).encode()
    whole = suffix_dedup.units_of(raw, 40, 20)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 100)
    parts = suffix_dedup.units_of(raw, 40, 20)

    def anchors(u):
        return [(int(a), int(f) + int(o)) for a, _, f, _, o in zip(*u, strict=True)], sum(int(n) for n in u[3])

    assert set(anchors(parts)[0]) == set(anchors(whole)[0]) and anchors(parts)[1] == anchors(whole)[1] == len(raw) - 39


def test_a_unit_gets_one_span(spark):
    """A passage in many texts: however many parts and windows find a unit's repeats, they come back to it once."""
    passage = words(60, 70)
    texts = {k: f"{words(12, 400 + k)} {passage} {words(12, 500 + k)}" for k in range(12)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    keyed = frame.select(suffix_dedup.text_key(F.col("text")).alias("doc"), "text")
    found = suffix_dedup.repeated_spans(keyed, window=40, gram=20, most_contexts=2, widths=(5, 1)).join(keyed, "doc").collect()
    assert len(found) == 12
    for r in found:
        raw = r["text"].encode()
        _, _, first, starts, _ = suffix_dedup.units_of(raw, 40, 20)
        assert all(sum(a <= x["a"] < a + n for x in r["spans"]) <= 1 for a, n in zip(first.tolist(), starts.tolist(), strict=True))
        again = {k for k in range(len(raw) - 39) if any(raw[k : k + 40] in t.encode() for t in texts.values() if t != r["text"])}
        assert {b for a, e in suffix_dedup.merged(r["spans"]) for b in range(a, e)} == {b for k in again for b in range(k, k + 40)}


def test_texts_without_their_repeats(docs):
    out = suffix_dedup.deduplicated(docs, window=40, gram=20)
    assert out.columns == docs.columns and out.count() == docs.count()
    expected = brute_dedup(texts_of(docs), 40)
    for r in out.collect():
        n, removed, _, _ = expected[r["doc_id"]]
        assert len((r["text"] or "").encode()) == n - removed
    assert suffix_dedup.deduplicated(docs.limit(0)).count() == 0


def test_rows_are_told_apart_by_their_texts(spark):
    """Repeated ids, null ids, repeated rows, and words that polynomials modulo a power of two can't tell apart."""
    morse = "a"
    while len(morse) < 1024:
        morse += morse.translate(str.maketrans("ab", "ba"))
    other, passage, alone = morse.translate(str.maketrans("ab", "ba")), words(100, 60), words(150, 61)
    rows = [(1, f"{words(20, 62)} {passage}"), (1, alone), (2, f"{passage} {words(20, 63)}"), (None, f"{words(9, 64)} {passage}"), (None, words(90, 65)), (3, None), (4, alone + " x"), (4, alone + " x"), (5, morse), (6, other), (7, other[:-1])]
    expected = brute_dedup({k: t or "" for k, (_, t) in enumerate(rows)}, 40)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.dedup_digests(frame, window=40, gram=20).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted((rows[k][0] or 0, *v) for k, v in expected.items())
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in got)
    clashing = frame.withColumns({c: F.lit(1) for c in ("doc", "spans", "row", "_dedup_doc", "a.b")})
    out = suffix_dedup.deduplicated(clashing, window=40, gram=20)
    assert out.columns == clashing.columns and sorted(len(r["text"] or "") for r in out.collect()) == sorted(v[0] - v[1] for v in expected.values())


def test_characters_are_not_cut_in_two(spark):
    shared = "é" * 300
    frame = spark.createDataFrame([(1, "ab" + shared), (2, "xyz" + shared + "ù")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in suffix_dedup.deduplicated(frame).collect()} == {1: "ab", 2: "xyzù"}


# pipeline -----------------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir, tmp_path):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    kept = docs
    for name, stage in C.STAGES[:-1]:
        stage(spark, kept, sf_dir).write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert kept.columns == columns
        counts.append(kept.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] == counts[4]
    assert C.STAGES[-1][1](spark, kept, sf_dir).agg({"doc_tokens": "sum"}).first()[0] > 0
    assert len(C.STAGES) == 5


def test_packing_follows_the_schedule(spark, sf_dir, tmp_path):
    """The hot source is left over at the end, in files larger than those before: rereading brings them first."""
    import corpus_pipeline as C

    r = random.Random(3)
    sources = ["src0"] * 1200 + ["src1"] * 120 + ["src5"] * 90
    rows = [(i, "".join(map(chr, r.choices(range(97, 123), k=2000))) if s == "src0" else f"{s} {i} " * 200, "en", s, 2000) for i, s in enumerate(sources)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    slots = {x["doc_id"]: (x["_mix_slot"], x["_mix_source"], x["_mix_phase"]) for x in mixing.schedule(frame, C.SHARES).collect()}
    C.mixing(spark, frame, sf_dir).write.parquet(str(tmp_path / "mixed"))
    pieces = C.packing(spark, spark.read.parquet(str(tmp_path / "mixed")), sf_dir).where("start = 0").orderBy("sequence_id", "offset").collect()
    order = [slots[x["doc_id"]] for x in pieces]
    assert len(order) == len(rows) and [x[0] for x in order] == sorted(x[0] for x in order)
    had, weights = Counter(), {s: C.SHARES[s] for s in ("src0", "src1", "src5")}
    for t, (_, source) in enumerate(dict.fromkeys((slot, source) for slot, source, phase in order if phase == 0), 1):
        had[source] += 1
        assert all(abs(had[s] - a * t / sum(weights.values())) < 1 for s, a in weights.items())


def test_one_row_of_each_group_stays(spark, sf_dir):
    import corpus_pipeline as C

    a, b = words(60, 70), words(60, 71)
    rows = [(5, a), (5, a), (5, b), (None, a), (None, b + " x"), (7, words(60, 72)), (None, words(60, 73)), (3, a + " y"), (8, None), (8, None)]
    frame = spark.createDataFrame([(i, t, "en", "src0", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = C.near_duplicates(spark, frame, sf_dir).collect()
    assert sorted(((r["doc_id"] or 0), r["text"] or "") for r in got) == sorted([(3, a + " y"), (5, b), (7, rows[5][1]), (0, rows[6][1]), (8, ""), (8, "")])


def test_short_passages_go(spark, sf_dir):
    """A passage of 51 words of about five letters, too short for the window of the operator's query."""
    import corpus_pipeline as C

    r = random.Random(80)
    passage = " ".join("".join(r.choice("abcdefgh") for _ in range(4 + k % 3)) for k in range(51))
    rows = [(k, f"{words(40, 81 + k)} {passage} {words(30, 91 + k)}", "en", "src0", 0) for k in range(3)] + [(9, words(100, 99), "en", "src0", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {x["doc_id"]: x["text"] for x in C.repeated_passages(spark, frame, sf_dir).collect()}
    assert len(passage) < 400 and all(passage[9:] not in got[k] and got[k].startswith(words(40, 81 + k)[:-9]) for k in range(3)) and got[9] == rows[3][1]


def test_pipeline_stages_take_odd_rows(spark, sf_dir):
    import corpus_pipeline as C

    odd = spark.createDataFrame([(1, None, None, None, None, "x"), (2, "", "en", "src0", 0, "x"), (2, "", "en", "src0", 0, "x"), (3, "a b", "en", "src1", 3, "x")], "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    for frame in (odd, odd.limit(0)):
        for _, stage in C.STAGES:
            stage(spark, frame, sf_dir).count()
    assert C.near_duplicates(spark, odd, sf_dir).count() == 4
