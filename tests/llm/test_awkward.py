"""Clashing columns, very long texts, ties and damage in every operator and stage; models against plain re-computation."""

import hashlib
import io
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from confluo.llm import bytesops, decontam, files, langid, linededup, media, mixing, neardup, quality, suffixdedup, tokens, warc
from confluo.llm.queries import PATTERN, TOKENIZERS, VOCABULARY

ODD = ["key", "id", "row", "_row", "_r", "_id", "_key", "_lines", "_gone", "_rate", "_source", "_scored", "_text", "block", "bucket", "source_of", "rate", "c0", "own_score", "a.b", "we`ird", "N", "first"]
RESULTS = {
    "quality": quality.RESULT,
    "decontam": decontam.RESULT,
    "suffixdedup": suffixdedup.RESULT,
    "neardup": neardup.RESULT,
    "mixing": mixing.RESULT,
    "langid": langid.RESULT,
    "linededup": linededup.RESULT,
}


def documents(spark, extra):
    base = "the cat sat on the mat and then it ran away from the dog over the hill to sleep in peace "
    rows = [(1, base * 2, "en", "a", 1), (2, base * 2, "en", "a", 1), (3, None, None, None, None), (4, "x\ny\nz\nx\ny\nz", "en", "b", 11), (None, "no id here at all", "en", "b", 5), (4, "x\ny\nz\nx\ny\nz", "en", "b", 11), (5, "", "de", "b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in extra])


def operators(spark, docs):
    bench = spark.createDataFrame([(1, "cat sat on the mat and then it ran away from the dog over")], "item_id long, text string")
    grades = spark.createDataFrame([(1, 2), (4, 0)], "doc_id long, grade int")
    yield "quality", quality.score(docs, quality.train(docs, grades))
    yield "decontam", decontam.find_matches(docs, bench)
    yield "suffixdedup", suffixdedup.remove_repeats(docs, carry=[c for c in docs.columns if c.lower() not in RESULTS["suffixdedup"]])
    yield "neardup", neardup.near_duplicates(docs)
    yield "mixing", mixing.mix_sources(docs)
    yield "langid", langid.identify(docs, langid.train(docs))
    yield "linededup", linededup.dedup_lines(docs)


def test_extra_columns_of_any_name_stay_in_every_operator(spark):
    docs = documents(spark, ODD)
    want = sorted(tuple(r) for r in docs.select("doc_id", *[F.col("`" + c.replace("`", "``") + "`") for c in ODD]).fillna(-1).collect())
    for name, out in operators(spark, docs):
        assert out.columns[-len(RESULTS[name]) :] == RESULTS[name] or name in ("mixing", "neardup"), name
        got = out.select("doc_id", *[F.col("`" + c.replace("`", "``") + "`") for c in ODD]).fillna(-1).collect()
        assert sorted(map(tuple, got)) == want, name


def test_stages_keep_columns_named_like_results(spark, tmp_path):
    extra = sorted({c for r in RESULTS.values() for c in r} - {"source", "text"}) + ["a.b", "key"]
    docs = documents(spark, [c for c in extra if c not in mixing.RESULT])
    spark.createDataFrame([(1, "cat sat on the mat and then it ran away from the dog over")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        for r in out.collect():
            who = "none" if r.doc_id is None else str(r.doc_id)
            assert all(r[c] == f"{c}:{who}" for c in docs.columns[5:]), name


def test_very_long_texts(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(3000)}" for _ in range(150_000)]
    long, one = " ".join(words), "q" * 700_000
    df = spark.createDataFrame([(1, long, "en", "a", 0), (2, long + " tail", "en", "a", 0), (3, one, "xx", "b", 0), (4, "line\n" * 40_000, "en", "b", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([(1, " ".join(words[90_000:90_020]))], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontam.find_matches(df, bench, carry=["doc_id"]).collect()} == {1: 20, 2: 20, 3: 0, 4: 0}
    cut = {r.doc_id: r for r in suffixdedup.remove_repeats(df, carry=["doc_id"]).collect()}
    assert bytes(cut[2].kept) == b" tail" and bytes(cut[3].kept) == one.encode() and len(cut[1].spans) == 0
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.doc_id: r.n_removed for r in linededup.dedup_lines(df).collect()} == {1: 0, 2: 0, 3: 0, 4: 39_999}
    assert {r.doc_id: r.size for r in mixing.mix_sources(df).collect()} == {1: 150_000, 2: 150_001, 3: 1, 4: 40_000}
    assert {r.doc_id: r.lang_pred for r in langid.identify(df, langid.train(df)).collect()}[3] == "xx"
    assert all(0 <= r.tail <= 1 for r in quality.score(df, quality.train(df, df.select("doc_id", F.col("doc_id").alias("grade")))).collect())
    assert {r.doc_id for r in media.features(media.load(spark, media.store(df))).where(f"payload_sha256 = '{hashlib.sha256(media.padded(one.encode())).hexdigest()}'").collect()} == {3}
    assert tokens.count_tokens(df.where("doc_id = 4"), f"{TOKENIZERS}/{VOCABULARY}", PATTERN).first().n_tokens >= 40_000


def test_hashes_of_long_words_do_not_depend_on_pieces():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 3 * bytesops.PIECE).astype(np.uint8)
    starts, ends = np.array([0, 5, 7, 9, 100]), np.array([len(data), 5, len(data) - 3, 20, 100 + bytesops.PIECE + 1])
    got = bytesops.word_hashes(data, starts, ends)
    for a, b, h in zip(starts.tolist(), ends.tolist(), got.tolist(), strict=True):
        total = 0
        for c in reversed(data[a:b].tolist()):
            total = (total * bytesops.BASE + c + 1) % (1 << 64)
        assert h == int(bytesops.mix(np.array([(total + (b - a) * 0xD6E8FEB86659FD93) % (1 << 64)], np.uint64))[0])


def thue_morse(n):
    return "".join("ab"[k.bit_count() % 2] for k in range(n))


def test_words_that_share_their_quick_hash_are_told_apart(spark):
    # a polynomial modulo 2^64 can not tell a Thue-Morse word from its complement, whatever the base
    one = thue_morse(4096)
    two = one.translate(str.maketrans("ab", "ba"))
    h = bytesops.word_hashes(np.frombuffer((one + two).encode(), np.uint8), np.array([0, 4096]), np.array([4096, 8192]))
    assert h[0] == h[1]
    docs = spark.createDataFrame([(1, f"see {one}"), (2, f"see {two}"), (3, two + "!" * 60 + one)], "doc_id long, text string")
    bench = spark.createDataFrame([("x", one), ("y", two)], "item_id string, text string")
    found = decontam.find_matches(docs, bench, carry=["doc_id"]).collect()
    assert {r.doc_id: sorted(i.item_id for i in r["items"]) for r in found} == {1: ["x"], 2: ["y"], 3: ["x", "y"]}
    assert [r.n_hit for r in decontam.find_matches(docs, bench.where("item_id = 'x'"), carry=["doc_id"]).orderBy("doc_id").collect()] == [1, 0, 1]


def test_ties(spark):
    # equal cross-entropies: the first language by code point
    docs = spark.createDataFrame([(1, "b", "same text here"), (2, "a", "same text here")], "doc_id long, lang string, text string")
    assert {r.lang_pred for r in langid.identify(docs, langid.train(docs)).collect()} == {"a"}
    # sources with equal capacity / weight get what the level gives, reruns agree
    rows = [(k, "w " * 6, s) for k, s in enumerate("aabbcc")]
    even = spark.createDataFrame(rows, "doc_id long, text string, source string")
    flat = mixing.mix_sources(even, weights=(1,)).collect()
    assert {r.target for r in flat} == {12.0} and all(r.taken == 6 for r in flat)
    # two equal longest matches: the first in the document
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    text = spark.createDataFrame([(1, "one two three and one two three")], "doc_id long, text string")
    assert [i.doc_word for i in decontam.find_matches(text, bench).first()["items"]] == [0]
    equal = spark.createDataFrame([(k, "g" if k % 2 else "h", k % 2) for k in range(40)], "doc_id long, text string, grade int")
    twice = [quality.score(equal, quality.train(equal, equal.union(equal).select("doc_id", "grade"))).orderBy("doc_id").collect() for _ in range(2)]
    assert twice[0] == twice[1]


def test_identifiers_that_are_no_integers_are_refused_at_once(spark):
    df = spark.createDataFrame([("x1", "text", "u")], "doc_id string, text string, page_id string")
    for run in (lambda: suffixdedup.remove_repeats(df), lambda: media.store(df), lambda: tokens.write_tokens(df, f"{TOKENIZERS}/{VOCABULARY}", PATTERN), lambda: warc.write_archives(df)):
        with pytest.raises(ValueError, match="integer"):
            run()


def test_a_benchmark_in_blocks_takes_one_scan(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "f g h")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b"), (1, "b c"), (2, "d e f"), (3, "g h"), (4, "f g")], "item_id long, text string")
    whole = decontam.find_matches(docs, bench)
    split = decontam.find_matches(docs, bench, block_bytes=4, held_bytes=1)
    assert len(decontam.benchmark_blocks(bench, 13, 4)) > 1
    assert sorted(map(str, whole.collect())) == sorted(map(str, split.collect()))
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def archive(spark, data):
    uri = f"{files.folder(spark, 'damaged')}/a.warc.gz"
    files.write(uri, data)
    return spark.createDataFrame([(uri,)], "archive string")


def test_damaged_archives_give_error_rows(spark):
    good = [b"".join(warc.records_of(k, f"http://{k}", b"page %d" % k, None, 1000)) for k in range(4)]
    cut = warc.resolve_revisits(warc.read_archives(archive(spark, good[0] + good[1] + good[2][:-9]))).collect()
    assert sorted(r.page_id for r in cut if r.page_id is not None) == [0, 1] and [("cut short" in r.error) for r in cut if r.error] == [True]
    bent = bytearray(good[1])
    bent[30:60] = bytes(30)
    out = warc.read_archives(archive(spark, good[0] + bytes(bent) + good[2] + good[3])).collect()
    assert sorted(r.page_id for r in out if r.error is None) == [0, 2, 3] and any(r.error for r in out)
    plain = [b"WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: 7\r\n%s\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhi" % x for x in (b"Content-Length: 21", b"Content-Length: many", b"X: y")]
    for data, n in zip(plain, (1, 0, 0), strict=True):
        out = warc.read_archives(archive(spark, data + b"\r\n\r\n")).collect()
        assert [r.error is None for r in out] == [bool(n)]
    assert warc.read_archives(archive(spark, plain[0])).first().payload == b"hi"
    other = warc.record([("WARC-Type", "response"), ("X-Page-Id", "seven"), ("WARC-Payload-Digest", "md5:abc")], b"HTTP/1.1 200 OK\r\n\r\nx")
    info = warc.record([("WARC-Type", "warcinfo")], b"software: none")
    out = {r.type: r for r in warc.read_archives(archive(spark, other + info)).collect()}
    assert "seven" in out["response"].error and out["warcinfo"].payload == b"software: none" and out["warcinfo"].error is None
    assert warc.read_archives(archive(spark, b"")).count() == 0


def test_members_may_begin_anywhere_in_a_piece(monkeypatch):
    rng = random.Random(4)
    bodies = [bytes(rng.randrange(256) for _ in range(rng.randrange(0, 90))) for _ in range(60)]
    members = [warc.record([("WARC-Type", "resource"), ("X-Page-Id", k)], b) for k, b in enumerate(bodies)]
    plain = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in bodies)
    for piece in [*range(1, 40), 1 << 16]:
        monkeypatch.setattr(warc, "PIECE", piece)
        assert [block for _, block in warc.parse(b"".join(members))] == bodies
        assert [block for _, block in warc.parse(plain)] == bodies
        bent = bytearray(members[3])
        bent[15:25] = bytes(10)
        got = [(block, error) for _, block, error in warc.scan(io.BytesIO(b"".join(members[:3]) + bytes(bent) + b"".join(members[4:])))]
        good = [block for block, error in got if error is None]
        assert good == bodies[:3] + bodies[4:] and len(got) > len(good), piece


def test_revisits_name_their_response_in_the_archive(spark):
    body = b"k" * 2000
    records = [*warc.records_of(5, "u", body, None, 9000), *warc.records_of(1, "u", body, 5, 9000), *warc.records_of(2, "u", body, 4, 9000)]
    out = {r.page_id: r for r in warc.resolve_revisits(warc.read_archives(archive(spark, b"".join(records)))).collect()}
    assert out[1].refers_to == 5 and out[1].payload_bytes == 2000 and out[1].error is None and out[2].error is not None and out[5].refers_to is None


def test_images_that_cannot_be_decoded_and_archives_without_directory_give_error_rows(spark):
    png = media.encode_png(media.padded(b"hello"), 5)
    for broken in (png[:-3], png[:20], png[:8], png[:8] + b"\0\0\0\1", b"GIF89a" + png):
        with pytest.raises(ValueError):
            media.decode_png(broken)
    df = spark.createDataFrame([("a", "0/1.png", 0, png[:-3], None), ("a", "1/2.png", 9, png, None), ("a", None, None, None, "gone"), ("a", "x", 1, png, None)], media.SCHEMA)
    out = media.features(df).collect()
    assert [(r.doc_id, r.error is None) for r in out] == [(1, False), (2, True), (None, False), (None, True)]
    folder = media.store(spark.createDataFrame([(k, "text") for k in range(6)], "doc_id long, text string").coalesce(1), roll_bytes=300)
    first = media.load(spark, folder).orderBy("archive").first().archive
    files.write(first, files.read(first)[:-30])
    out = media.load(spark, folder, split_bytes=50).collect()
    assert [r.archive for r in out if r.error] == [first] and all(r.archive != first for r in out if not r.error) and len(out) > 1


def test_images_against_an_independent_reading(spark):
    df = spark.createDataFrame([(1, "Grüße " * 50), (2, "")], "doc_id long, text string")
    folder = media.store(df)
    stored = {int(r.member.split("/")[1][:-4]): bytes(r.media) for r in media.load(spark, folder).collect()}
    for r in media.features(media.load(spark, folder)).collect():
        data, at, chunks = stored[r.doc_id], 8, {}
        while at < len(data):
            n = struct.unpack(">I", data[at : at + 4])[0]
            chunks[data[at + 4 : at + 8]] = data[at + 8 : at + 8 + n]
            at += n + 12
        width, height, depth, colour = struct.unpack(">IIBB", chunks[b"IHDR"][:10])
        lines = zlib.decompress(chunks[b"IDAT"])
        samples = [lines[y * (width + 1) + 1 + x] for y in range(height) for x in range(width)]
        mean = sum(samples) / len(samples)
        share = [c / len(samples) for c in Counter(samples).values()]
        columns = [sum(samples[x::width]) for x in range(width)]
        bright = int("".join("1" if c * width > sum(columns) else "0" for c in columns), 2)
        sd = math.sqrt(sum((s - mean) ** 2 for s in samples) / len(samples))
        assert (depth, colour) == (8, 0) and r.media_sha256 == hashlib.sha256(data).hexdigest() and r.media_bytes == len(data)
        assert r.feature == f"mean={mean:.4f};sd={sd:.4f};bits={abs(-sum(p * math.log2(p) for p in share)):.4f};hash={bright:016x}"


def kneser_ney(texts, alphabet, discount):
    """P(c | history of three) by the textbook recursion over plain dictionaries."""
    counts = [defaultdict(Counter) for _ in range(5)]
    for text in texts:
        line = "   " + text
        for k in range(3, len(line)):
            counts[4][line[k - 3 : k]][line[k]] += 1
    for order in (3, 2, 1):
        for history, follow in counts[order + 1].items():
            for c in follow:
                counts[order][history[1:]][c] += 1

    def p(history, c, order):
        if order == 0:
            return 1 / (alphabet + 1)
        own = counts[order].get(history)
        lower = p(history[1:], c, order - 1)
        if not own:
            return lower
        total = sum(own.values())
        return max(own[c] - discount, 0) / total + discount * len(own) / total * lower

    return lambda history, c: p(history, c, 4)


def test_language_scores_match_a_plain_kneser_ney(spark):
    train = {"en": ["the cat sat ", "a cat ran at the mat "], "de": ["der hund rannte ", "die katze sass da "]}
    rows = [(k, lang, t) for k, (lang, t) in enumerate((lang, t) for lang, ts in train.items() for t in ts)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    alphabet = len({c for ts in train.values() for t in ts for c in t})
    texts = ["the katze ran ", "xyz the ", "der mat "]
    bits, n = model.score(texts)
    for i, text in enumerate(texts):
        line = "   " + text
        for k, lang in enumerate(model.langs):
            p = kneser_ney(train[lang], alphabet, langid.load(model.parts[0][0]).discount)
            want = -sum(math.log2(p(line[j - 3 : j], line[j])) for j in range(3, len(line))) / len(text)
            assert n[i] == len(text) and math.isclose(bits[i, k], want, rel_tol=1e-5), (text, lang)


def test_ordinal_loss_and_gradient_match_a_plain_computation():
    rng = np.random.default_rng(5)
    n_rows, n_features, n_grades = 30, 7, 4
    has = rng.random((n_rows, n_features)) < 0.4
    rows, local = np.nonzero(has)
    y = rng.integers(0, n_grades, n_rows)
    v = np.concatenate((rng.normal(size=n_features), [-0.5], rng.normal(size=n_grades - 2)))

    def plain(v):
        theta = [v[n_features]]
        for g in v[n_features + 1 :]:
            theta.append(theta[-1] + math.exp(g))
        total = sum(w * w for w in v[:n_features]) / (2 * 3.0)
        for i in range(n_rows):
            s = sum(v[k] for k in range(n_features) if has[i, k])
            over = [1.0, *[1 / (1 + math.exp(t - s)) for t in theta], 0.0]
            total -= math.log(over[y[i]] - over[y[i] + 1])
        return total

    value, gradient = quality._loss(v, y, rows, local, n_features, 3.0)
    assert math.isclose(value, plain(v), rel_tol=1e-9)
    for k in range(len(v)):
        step = np.zeros(len(v))
        step[k] = 1e-6
        assert math.isclose(gradient[k], (plain(v + step) - plain(v - step)) / 2e-6, rel_tol=1e-4, abs_tol=1e-5)
    best = quality._minimise(lambda x: quality._loss(x, y, rows, local, n_features, 3.0), v, 200)
    assert all(plain(best) <= plain(best + d) + 1e-4 for d in rng.normal(scale=0.05, size=(20, len(v))))


def test_quality_on_labels_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumn("grade", F.when(F.col("toxic") == 1, 0).otherwise(1 + F.col("quality"))).select("doc_id", "grade")
    held = langid.held_out(F.col("doc_id"))
    model = quality.train(docs, labels.where(~held))
    out = quality.score(docs, model, carry=["doc_id"]).join(labels.where(held), "doc_id").collect()
    toxic = np.mean([(r.tail >= 0.5) == (r.grade >= 1) for r in out])
    high = np.mean([(r.above[1] >= 0.5) == (r.grade >= 2) for r in out])
    print(f"held out {len(out)}: toxic or not {toxic:.3f}, high quality or not {high:.3f}")
    assert toxic >= 0.95 and high >= 0.75


def test_near_duplicates_without_the_bit_filter_agree(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(300)}" for _ in range(60)]
    rows = [(k, " ".join(w if rng.random() > 0.04 * (k % 6) else f"x{rng.randrange(9)}" for w in base)) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    every = [sorted(map(tuple, neardup.near_duplicates(df, 2, 80, differ).drop("text").collect())) for differ in (50, None)]
    assert every[0] == every[1]
