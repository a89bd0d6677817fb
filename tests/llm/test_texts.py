"""Token counts, fingerprints, media, languages, quality and packing: against brute force, round trips and held-out accuracy."""

import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dexlake.llm import language_id, order_minhash, packing, quality, tiff, token_count

EDGE = [(1, "the cat sat. On the mat!\nIt ran", "en"), (2, None, None), (3, "", "en"), (4, "the cat sat. On the mat!\nIt ran", "en"), (4, "the cat sat. On the mat!\nIt ran", "en"), (5, "日本 😀 é" * 900, "ja"), (6, "\n \t", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", 9) for r in EDGE], "doc_id long, text string, lang string, score string, n_tokens int")


# token counts -----------------------------------------------------------------------------------------------------------


def reference(pieces, scores, fallback):
    from tokenizers import Tokenizer, models, normalizers

    t = Tokenizer(models.Unigram(list(zip(pieces, scores, strict=True)), 0, fallback))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return lambda x: len(t.encode(x, add_special_tokens=False).ids)


SMALL = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aa", -2.0), ("ba", -2.0), ("aab", -3.0), ("▁", -1.0), ("▁a", -2.0), *((f"<0x{i:02X}>", -9.0) for i in range(256))]


@pytest.mark.parametrize("fallback", [True, False])
def test_counts_follow_the_tokenizers_ties(fallback):
    pieces, scores = zip(*SMALL, strict=True)
    count, truth = token_count.UnigramCounter(pieces, scores, byte_fallback=fallback).count, reference(pieces, scores, fallback)
    rnd = random.Random(1)
    for _ in range(1500):
        text = "".join(rnd.choice("aabb cé\n") for _ in range(rnd.randint(0, 24)))
        assert count(text) == truth(text), text


def test_counts_with_the_public_vocabulary(spark, sf_dir, docs):
    P = pytest.importorskip("public_tokenizers")
    pieces, scores = token_count.vocabulary_of(P.path("piece_bpe_32k.model"))
    truth = reference(pieces, scores, True)
    corpus = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for frame in (corpus, docs, docs.limit(0)):
        texts = sorted((r["doc_id"], r["text"] or "") for r in frame.select("doc_id", "text").collect())
        got = sorted(tuple(r) for r in token_count.count_tokens(frame, pieces, scores).collect())
        assert got == sorted((i, len(t), truth(t)) for i, t in texts)


# fingerprints -----------------------------------------------------------------------------------------------------------


def test_order_minhash_follows_order_and_likeness():
    sketch = order_minhash.OrderMinHash(k=3, lanes=256)
    rnd = random.Random(2)
    a = "".join(rnd.choice("abcdefghij") for _ in range(400))
    one = a[:200] + "Z" + a[201:]
    swapped = a[200:] + a[:200]
    near = [sketch.likeness(sketch(a), sketch(x)) for x in (a, one, swapped, "".join(rnd.sample(a, len(a))))]
    assert near[0] == 1.0 and near[1] > 0.9 and near[1] > near[2] > near[3]
    assert sketch.likeness(sketch(""), sketch(None)) == 1.0


def brute_order_minhash(text, k, sketch):
    """The same selection by plain loops over numbered k-mers."""
    with np.errstate(over="ignore"):
        h = sketch._kmers(text)
        seen, rows = {}, []
        for i, x in enumerate(h.tolist()):
            n = seen[x] = seen.get(x, -1) + 1
            v = np.uint64(n) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(x)
            rows.append((int(v * np.uint64(0x9E3779B97F4A7C15)) >> 32, i, x))
        out = []
        for odd, lane in zip(sketch.odd[:, 0].tolist(), sketch.lane.tolist(), strict=True):
            two = sorted(sorted((v * odd % (1 << 32), i, x) for v, i, x in rows)[:2], key=lambda r: r[1])
            a, b = np.uint64(two[0][2]), np.uint64(two[1][2])
            pair = order_minhash._mix(np.array([a])) + np.array([b]) * np.uint64(0x2545F4914F6CDD1D)
            out.append(int(order_minhash._mix(pair ^ np.uint64(lane))[0] >> np.uint64(48)))
        return out


def test_order_minhash_equals_plain_loops():
    sketch = order_minhash.OrderMinHash(k=4, lanes=16)
    for text in ("abcabcabcabd" * 3, "the cat sat on the mat", "aaaaaaaaaaab"):
        assert sketch(text).tolist() == brute_order_minhash(text, 4, sketch)


def test_long_texts_go_in_blocks(monkeypatch):
    text = "".join(random.Random(3).choice("abcdef ") for _ in range(5000))
    whole = order_minhash.OrderMinHash()(text)
    monkeypatch.setattr(order_minhash, "BLOCK", 512)
    assert (order_minhash.OrderMinHash()(text) == whole).all()


@pytest.mark.parametrize("per_range", [1, 2, 4096])
def test_fingerprints_meet_the_next_document(spark, sf_dir, docs, per_range):
    import hashlib

    frames = [docs.dropDuplicates(["doc_id"]), docs.limit(0), docs.where("doc_id = 1"), spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 25")]
    for frame in frames:
        texts = [(r[0], r[1] or "") for r in frame.select("doc_id", "text").orderBy("doc_id").collect()]
        got = {r["doc_id"]: r for r in order_minhash.order_fingerprints(frame, rows_per_range=per_range).collect()}
        assert len(got) == len(texts)
        sketch = order_minhash.OrderMinHash()
        for k, (i, text) in enumerate(texts):
            following = texts[(k + 1) % len(texts)][1]
            changed = order_minhash.edited(text, following)
            r = got[i]
            assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and r["n_chars"] == len(text)
            assert r["fingerprint"] == sketch.spell(sketch(text)) and r["edited_fingerprint"] == sketch.spell(sketch(changed))
            assert r["near_next"] == sketch.likeness(sketch(text), sketch(following))


def test_fingerprints_with_null_and_repeated_ids(spark):
    frame = spark.createDataFrame([(None, "null id first"), (1, "b"), (1, "a"), (2, "c")], "doc_id long, text string")
    got = order_minhash.order_fingerprints(frame, rows_per_range=1)
    assert got.count() == 4


# media ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("compression", [tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trip(compression, predictor, tile, kind, order):
    draw = np.random.default_rng(1)
    images = [{"pixels": draw.integers(0, 7, (h, w, s)).astype(kind), "compression": compression, "predictor": predictor, "tile": tile, "rows_per_strip": 7} for h, w, s in ((1, 1, 1), (33, 20, 3))]
    pages = list(tiff.pages_of(tiff.write_tiff(images, order)))
    assert [p.error for p in pages] == [None, None] and [p.page for p in pages] == [0, 1]
    for p, i in zip(pages, images, strict=True):
        assert (p.pixels == i["pixels"]).all()


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000))
def test_codecs_round_trip(data):
    assert tiff.unpack_lzw(tiff.pack_lzw(data), len(data)) == data
    assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data


def test_long_lzw_runs_through_all_widths():
    data = np.random.default_rng(2).integers(0, 256, 30_000, dtype=np.uint8).tobytes()
    assert tiff.unpack_lzw(tiff.pack_lzw(data), len(data)) == data


def test_broken_tiffs_have_error_rows(spark):
    good = tiff.write_tiff([{"pixels": np.ones((4, 4), np.uint8), "compression": tiff.DEFLATE}] * 2)
    cut = bytearray(good)
    cut[good.index(b"\x78")] = 0
    frame = spark.createDataFrame([(1, good, 1), (2, b"no tiff", 1), (3, None, 1), (4, b"", 1), (5, bytes(cut), 1), (1, good, 1)], "doc_id long, content binary, page int")
    got = tiff.tiff_pages(frame).collect()
    by = {k: [r["error"] is None for r in got if r["doc_id"] == k] for k in range(1, 6)}
    assert by == {1: [True] * 4, 2: [False], 3: [], 4: [], 5: [False, True]}
    assert all(r["pixels"] == b"\1" * 16 for r in got if r["error"] is None)


@pytest.mark.parametrize("tile", [None, (16, 16)])
def test_blank_bilevel_scans_have_pixels(tile):
    """A4 at 600 dpi (tiles: smaller), one bit a sample: 34.8 million samples in some 4 KB."""
    import struct

    height, stride = (64, 64) if tile else (7016, 620)
    raw = tiff.write_tiff([{"pixels": np.zeros((height, stride), np.uint8), "compression": tiff.DEFLATE, "tile": tile}])

    def field(tag, form, value):
        return struct.pack("<HHI", tag, form, 1) + struct.pack("<I", value)

    for tag, form, old, new in [(tiff.WIDTH, 4, stride, 8 * stride), (tiff.BITS, 3, 8, 1)] + ([(tiff.TILE_WIDTH, 4, 16, 128)] if tile else []):
        assert raw.count(field(tag, form, old)) == 1
        raw = raw.replace(field(tag, form, old), field(tag, form, new))
    (page,) = tiff.pages_of(raw)
    assert page.error is None and page.pixels.shape == (height, 8 * stride, 1) and not page.pixels.any()
    if not tile:
        for tag in (tiff.HEIGHT, tiff.ROWS_PER_STRIP):
            raw = raw.replace(field(tag, 4, height), field(tag, 4, 100 * height))
        (page,) = tiff.pages_of(raw)
        assert page.error == "more samples than the file can hold"


def test_an_endless_chain_of_directories_ends():
    raw = bytearray(tiff.write_tiff([{"pixels": np.ones((4, 4), np.uint8)}]))
    first = raw[4:8]
    raw[-4:] = first
    assert len(list(tiff.pages_of(bytes(raw)))) == 1


def test_texts_come_back_from_tiffs(docs):
    import hashlib

    got = {r["doc_id"]: r for r in tiff.text_media(docs).collect()}
    for i, text, _ in EDGE:
        payload, n = tiff.payload_of(text)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (n, len(payload)) and len(payload) % 576 == 0
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["media_sha256"] == hashlib.sha256(tiff.text_to_tiff(payload)).hexdigest()
    assert got[2]["feature"] == got[3]["feature"] and tiff.text_media(docs.limit(0)).count() == 0


def plain_tiff_samples(media):
    """The samples of a little-endian TIFF, read entry by entry: strips and tiles of 8-bit samples, PackBits or deflate, horizontal differences undone."""
    import struct

    def values(kind, n, at):
        form = {3: "H", 4: "I"}[kind]
        size = struct.calcsize(form) * n
        start = at if size <= 4 else struct.unpack_from("<I", media, at)[0]
        return struct.unpack_from(f"<{n}{form}", media, start)

    assert media[:4] == b"II*\0"
    found, at = b"", struct.unpack_from("<I", media, 4)[0]
    while at:
        (entries,) = struct.unpack_from("<H", media, at)
        tags = {}
        for k in range(entries):
            tag, kind, n = struct.unpack_from("<HHI", media, at + 2 + 12 * k)
            tags[tag] = values(kind, n, at + 10 + 12 * k)
        (at,) = struct.unpack_from("<I", media, at + 2 + 12 * entries)
        width, height = tags[256][0], tags[257][0]
        tiled = 322 in tags
        across, down = (tags[322][0], tags[323][0]) if tiled else (width, tags.get(278, (height,))[0])
        page = [bytearray(width) for _ in range(height)]
        per_row = -(-width // across)
        for k, (start, size) in enumerate(zip(tags[324 if tiled else 273], tags[325 if tiled else 279], strict=True)):
            raw, top, left = media[start : start + size], k // per_row * down, k % per_row * across
            if tags[259][0] == 8:
                raw = zlib.decompress(raw)
            elif tags[259][0] == 32773:
                out, i = b"", 0
                while i < len(raw):
                    c = raw[i]
                    if c < 128:
                        out, i = out + raw[i + 1 : i + 2 + c], i + 2 + c
                    elif c > 128:
                        out, i = out + raw[i + 1 : i + 2] * (257 - c), i + 2
                    else:
                        i += 1
                raw = out
            else:
                assert tags[259][0] == 1
            for y in range(min(down, height - top)):
                line = bytearray(raw[y * across : (y + 1) * across])
                if tags.get(317, (1,))[0] == 2:
                    for x in range(1, len(line)):
                        line[x] = (line[x] + line[x - 1]) & 255
                page[top + y][left : left + across] = line[: width - left]
        found += b"".join(page)
    return found


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 576 * 64, 576 * 65 + 3, 100_000])
def test_another_reader_finds_the_payload(size):
    rnd = random.Random(size)
    for text in ("".join(chr(rnd.choice([97, 98, 233, 0x65E5, 0x1F600])) for _ in range(size)), "a" * size):
        payload, _ = tiff.payload_of(text)
        assert plain_tiff_samples(tiff.text_to_tiff(payload)) == payload


# languages and quality ----------------------------------------------------------------------------------------------------


def test_unseen_words_fall_back_to_shorter_ngrams():
    model = language_id.LanguageModel.learn([("the cat ran there", "en"), ("der hund lief schnell", "de")])
    scorer = language_id.LanguageScorer(model)
    assert scorer("the hund der hund")[0] == "de" and scorer("schnellen")[0] == "de" and scorer("thereran")[0] == "en"
    assert scorer("12 !?") == ("und", 0.0)
    assert scorer("ЖЖЖ")[1] == 0.5  # not one letter is known: all languages alike


def test_languages_equal_plain_loops(spark, sf_dir):
    """Counts, logarithms and backoff again, word by word, over the whole learned sample (the smallest tables fit the bounds)."""
    import math
    import re
    from collections import Counter

    from dexlake.llm.queries import held_out

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", held_out("doc_id", 5, 0).alias("held")).collect()
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r for r in language_id.identify_languages(frame, language_id.learn_languages(frame, ~held_out("doc_id", 5, 0), words_per_language=10**6, ngrams_per_language=10**6)).collect()}
    cut = lambda t: [w for w in re.split(r"[\W\d_]+", (t or "").lower()) if w]
    words, grams = {}, {}
    for r in rows:
        if not r["held"] and r["lang"] and r["text"] is not None:
            for w in cut(r["text"]):
                words.setdefault(r["lang"], Counter())[w] += 1
    for lang, found in words.items():
        grams[lang] = Counter()
        for w, n in found.items():
            for k in range(1, 6):
                marked = w if k == 1 else f"<{w}>"
                for i in range(len(marked) - k + 1):
                    grams[lang][marked[i : i + k]] += n
    langs = sorted(words)
    kinds = {id(table): len({x for c in table.values() for x in c}) for table in (words, grams)}
    mass = {id(table): {lang: sum(c.values()) for lang, c in table.items()} for table in (words, grams)}

    def score(table, x, lang):
        return math.log(table[lang][x] + 0.5) - math.log(mass[id(table)][lang] + 0.5 * (kinds[id(table)] + 1))

    def of_word(w):
        if any(w in words[lang] for lang in langs):
            return [score(words, w, lang) for lang in langs]
        for k in range(5, 0, -1):
            marked = w if k == 1 else f"<{w}>"
            known = [g for g in (marked[i : i + k] for i in range(len(marked) - k + 1)) if any(g in grams[lang] for lang in langs)]
            if known:
                return [sum(score(grams, g, lang) for g in known) / len(known) for lang in langs]
        return [0.0] * len(langs)

    for r in rows:
        found = cut(r["text"])
        if not found:
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        means = [sum(x) / len(found) for x in zip(*map(of_word, found), strict=True)]
        best = max(means)
        assert got[r["doc_id"]]["lang_pred"] == langs[means.index(best)]
        assert got[r["doc_id"]]["score"] == pytest.approx(1 / sum(math.exp(language_id.SHARPNESS * (m - best)) for m in means), abs=1e-3)


def test_language_held_out_accuracy(spark, sf_dir, docs):
    from dexlake.llm.queries import held_out, op7_language_id

    got = op7_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    model = language_id.learn_languages(docs, ~held_out("doc_id", 5, 0))
    rows = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify_languages(docs, model).collect()}
    assert rows[2] == rows[3] == rows[6] == ("und", 0.0) and rows[1][0] == "en"
    empty = language_id.learn_languages(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in language_id.identify_languages(docs, empty).collect()} == {"und"}


def test_quality_held_out(spark):
    from dexlake.llm.queries import op8_quality

    d = "/root/testdata/sf0.01"
    got = op8_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    assert good.median() > 0.9 > bad.median() and (good >= 0.7).mean() > 0.95
    assert ((got.score >= 0.7) == (got.predicted == 1)).all()


def test_quality_equals_plain_compression(spark):
    """Sizes from a compressor that is made anew for every block; the curve is the best of its kind for the marks it was fitted to."""
    import math

    import zstandard

    rnd = random.Random(21)
    speak = lambda words, n: " ".join(rnd.choice(words) for _ in range(n))
    vocabulary = [["".join(rnd.choice("abcdefgh") for _ in range(7)) for _ in range(300)] for _ in range(2)]
    labelled = [(speak(vocabulary[q], rnd.randint(20, 400)), q) for q in (0, 1) for _ in range(240)]
    model = quality.learn(labelled)
    mixed = [speak(vocabulary[0], k) + " " + speak(vocabulary[1], 400 - k) for k in range(0, 401, 50)] + ["", "a", "é" * 5000]

    def size(raw, dictionary):
        total = 0
        for i in range(0, len(raw), 2048):
            compressor = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), level=3, write_content_size=False)
            total += len(compressor.compress(raw[i : i + 2048]))
        return total

    def mark(text):
        raw = text.encode()
        good, bad = size(raw, model.good), size(raw, model.bad)
        return (bad - good) / max(good, bad) if raw else 0.0

    frame = spark.createDataFrame(list(enumerate(mixed)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(frame, model).collect()}
    for k, text in enumerate(mixed):
        assert got[k] == pytest.approx(1 / (1 + math.exp(-(model.slope * mark(text) + model.offset))), abs=1e-9)
    assert got[0] > 0.9 > 0.1 > got[8]
    held = [(speak(vocabulary[q], 60), q) for q in (0, 1) for _ in range(60)]
    scorer = quality.QualityScorer(model)
    assert np.mean([(scorer(t) >= 0.5) == bool(q) for t, q in held]) > 0.97


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1), (4, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    for these in (labels, labels.limit(0)):
        model = quality.learn_quality(docs, these, F.lit(True))
        rows = quality.quality_scores(docs, model).collect()
        assert len(rows) == len(EDGE) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.learn([]).offset == 0
    kept = quality.score_quality(docs, quality.learn([]), score_col="q")
    assert kept.columns == [*docs.columns, "q"] and kept.count() == len(EDGE)


# packing ----------------------------------------------------------------------------------------------------------------


def test_plans_are_optimal():
    rnd = random.Random(3)
    window = 16
    for _ in range(200):
        at, cuts = 0, []
        for _ in range(rnd.randint(1, 9)):
            at += rnd.randint(1, 9)
            cuts.append((at, rnd.choice([0.0, 2.0, 5.0])))
        penalty = dict(cuts)

        def cost(stops, penalty=penalty):
            total, before = 0.0, 0
            for s in stops:
                n = s - before
                if n > window:
                    return float("inf")
                total += (0 if n & (n - 1) == 0 and n >= window // 8 else window - n) + penalty[s]
                before = s
            return total

        inner = [c for c, _ in cuts[:-1]]
        best = min(cost([*x, at]) for k in range(len(cuts)) for x in itertools.combinations(inner, k))
        assert cost(packing.plan(at, cuts, window)) == best


def test_giving_out_early_changes_nothing():
    rnd = random.Random(4)
    docs_ = [(i, np.array([rnd.randint(1, 9) for _ in range(rnd.randint(0, 300))], "<u2")) for i in range(120)]
    ends = lambda ids: np.flatnonzero(ids[:-1] == 3) + 1
    runs = [list(packing.pack_stream(iter(docs_), lambda x: x, ends, window=128, settle_every=k)) for k in (1, 64, 10**9)]
    assert runs[0] == runs[1] == runs[2]


def test_every_token_is_packed_once(spark, sf_dir, docs):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    special = spark.createDataFrame([(1, "<|endoftext|>"), (2, "a<|endoftext|> b. c <|endoftext|><|endoftext|>"), (3, "<|endoftext|")], "doc_id long, text string")
    for frame in (spark.read.parquet(f"{sf_dir}/documents.parquet"), docs.where("doc_id <> 4"), docs.limit(0), special):
        texts = {r[0]: [*t.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in frame.select("doc_id", "text").collect()}
        got = packing.pack(frame, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, special=packing.added_tokens(P.path("byte_bpe_50k.json"))).collect()
        by_doc, by_sequence = {}, {}
        for r in got:
            by_doc.setdefault(r["doc_id"], []).append(r)
            by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert by_doc.keys() == texts.keys()
        for key, ids in texts.items():
            at = 0
            for r in sorted(by_doc[key], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids)
                assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
                at += r["length"]
            assert at == len(ids)
        padding = 0
        for rows in by_sequence.values():
            at = 0
            for r in sorted(rows, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= 1024
            padding += 0 if at & (at - 1) == 0 else 1024 - at
        if len(texts) > 100:
            assert padding < 0.05 * sum(map(len, texts.values()))


def test_ids_equal_the_tokenizers():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = packing.TokenIds(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, packing.added_tokens(P.path("byte_bpe_50k.json")))
    assert ids("a<|endoftext|>b").tolist() == [64, 50256, 65]
    rnd = random.Random(5)
    for _ in range(1500):
        text = "".join(rnd.choice(["a", "the", " ", "\n", ".", ",", "é", "日", "'s", "12", "\t", " ", "<|endoftext|>", "!?", " "]) for _ in range(rnd.randint(0, 14)))
        assert ids(text).tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
