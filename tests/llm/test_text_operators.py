"""Decontamination, suffix dedup, line dedup, mixing and language ID against brute force and awkward rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from confluo.llm import decontam, langid, linededup, mixing, quality, suffixdedup
from confluo.llm.queries import QUERIES

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_hits(rows, items, window=13):
    out = []
    for doc, text in rows:
        words = WORDS.findall(lower(text))
        hit, names = set(), set()
        for name, item in items:
            own = WORDS.findall(lower(item))
            w = min(window, len(own))
            wins = {tuple(own[p : p + w]) for p in range(len(own) - w + 1)} if w else set()
            for p in range(len(words) - w + 1):
                if w and tuple(words[p : p + w]) in wins:
                    hit |= set(range(p, p + w))
                    names.add(str(name))
        out.append((doc, len(words), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=str)


def text_of(rng, n, k=40):
    return " ".join(f"w{rng.randrange(k)}" for _ in range(n))


@pytest.mark.parametrize("block", [8 << 20, 600])
def test_decontamination_matches_brute_force(spark, block):
    rng = random.Random(1)
    items = [(k, text_of(rng, rng.choice([1, 3, 12, 13, 14, 40]), 60)) for k in range(12)] + [(20, None), (21, "!!"), (3, "Extra Item words"), (None, "null named item here")]
    rows = [(k, text_of(rng, rng.randrange(0, 300), 60)) for k in range(40)]
    for k in range(40, 60):
        own = rng.choice([t for _, t in items if t]).upper()
        rows.append((k, text_of(rng, 30, 500) + " " + own + ". " + text_of(rng, 400, 500)))
    rows += [(60, None), (61, ""), (62, "?!"), (40, rows[40][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find_matches(docs, bench, carry=["doc_id"], block_bytes=block, shard_bytes=2000)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, sorted({i.item_id for i in r["items"]}), r.contaminated) for r in found.collect()), key=str)
    assert got == brute_hits(rows, [("null" if n is None else n, t) for n, t in items])
    longest = {r.doc_id: max((i.n_words for i in r["items"]), default=0) for r in found.collect()}
    assert max(longest.values()) >= 13


def test_decontamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:3] for r in decontam.find_matches(docs, none, carry=["doc_id"]).select("doc_id", "n_hit", "n_words").collect()] == [(1, 0, 2)]
    assert decontam.decontaminate(docs.limit(0), none).count() == 0


def brute_cut(rows, width=50):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            first.setdefault(b[p : p + width], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if i is not None and first[b[p : p + width]] < i:
                gone[p : p + width] = b"\1" * width
        out.append((i, len(b), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [300, 1 << 20])
def test_suffix_dedup_matches_brute_force(spark, block):
    rng = random.Random(3)
    passage = text_of(rng, 30, 900)
    rows = [(k, text_of(rng, rng.randrange(0, 60), 900) + (" " + passage[: rng.randrange(40, 160)] if k % 3 else "")) for k in range(40)]
    rows += [(50, "a" * 300), (51, "a" * 200), (52, "ab" * 99), (53, "ab" * 60), (54, None), (55, ""), (56, "x" * 49), (57, "x" * 49), (58, "é" * 40), (59, "zé" + "é" * 40)]
    rows += [(60, "same row " * 20), (60, "same row " * 20), (None, passage), (None, passage), (61, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    out = suffixdedup.remove_repeats(df, block_bytes=block)
    got = sorted(((r.doc_id, r.n_bytes, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect()), key=str)
    assert got == brute_cut(rows)
    assert suffixdedup.remove_repeats(df.limit(0)).count() == 0


def test_radix_groups_are_exactly_the_repeated_strings():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    starts = np.arange(0, 380)
    live, group = suffixdedup.radix_groups(data, starts, 13)
    want = {}
    for s in starts:
        want.setdefault(bytes(data[s : s + 13]), []).append(int(s))
    got = {}
    for i, g in zip(live, group):
        got.setdefault(g, []).append(int(starts[i]))
    assert sorted(sorted(v) for v in got.values()) == sorted(v for v in want.values() if len(v) > 1)


def brute_lines(rows, width=3):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = text.split("\n") if text is not None else []
        gone = set()
        for p in range(len(lines) - width + 1):
            w = tuple(lines[p : p + width])
            if w in seen:
                gone |= set(range(p, p + width))
            seen.add(w)
        out.append((doc, len(lines), len(gone), None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return sorted(out, key=str)


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [(k, "\n".join(rng.choice("abcde") for _ in range(rng.randrange(0, 14)))) for k in range(60)]
    rows += [(70, None), (71, ""), (72, "a\na\na\na\na"), (73, "q\nr"), (74, "q\nr"), (None, "a\nb\nc\nd"), (75, "\n\n\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit(1))
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in linededup.dedup_lines(df).collect()), key=str)
    assert got == brute_lines(rows)
    twice = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc")], "doc_id long, text string")
    assert [r.n_removed for r in linededup.dedup_lines(twice).collect()] == [0, 0]
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_water_filling_and_shares(spark):
    rng = random.Random(7)
    sizes = {"a": 2000, "b": 30, "c": 500, "d": 4, None: 700}
    rows, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((k, " ".join(["w"] * rng.randrange(0, 9)), source))
            k += 1
    rows += [(k, None, "a"), (k + 1, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit("x"))
    out = mixing.mix_sources(df).collect()
    total = sum(r.size for r in out)
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r.size
    # brute water level
    names = sorted((s for s in by if s is not None)) + [None]
    weight = {s: [1, 2, 3][i % 3] for i, s in enumerate(names)}
    cap = {s: 3 * by[s][0].source_size for s in names}
    target, open_, rest = {}, set(names), float(total)
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if cap[s] <= level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = float(cap[s])
            rest -= cap[s]
        open_ -= full
    for s in names:
        assert math.isclose(by[s][0].target, target[s], rel_tol=1e-9, abs_tol=1e-9)
        assert abs(sum(r.taken for r in by[s]) - target[s]) <= 3 + 2 * math.sqrt(len(by[s]))
    assert sorted(map(str, mixing.mix_sources(df).collect())) == sorted(map(str, out))
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_language_models_are_distributions_and_tell_languages_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.withColumn("held", langid.held_out(F.col("doc_id")))
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows.select("doc_id", "held").collect())
    model = langid.train(rows.where("not held"))
    # next-character probabilities sum to one after any known context
    context = [ord(c) for c in "tha"]
    every = np.arange(1 << 16, dtype=np.uint64)
    assert len(model.parts) == 1
    part = langid.load(model.parts[0][0])
    codes = (np.uint64(context[0]) << np.uint64(48)) | (np.uint64(context[1]) << np.uint64(32)) | (np.uint64(context[2]) << np.uint64(16)) | every
    p = 2.0 ** -part.entropy(codes, model.langs.index("en"))
    known = p[p > p.min() * (1 + 1e-9)].sum() + p.min() * (part.letters + 1 - (p > p.min() * (1 + 1e-9)).sum())
    assert abs(known - 1) < 1e-6
    out = langid.identify(rows, model)
    assert out.where("held and lang = lang_pred").count() >= 0.95 * out.where("held").count()
    assert out.where("rejected").count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "qxzvkj wqpfzx jjkqzv xxqz wvkzq pqxj " * 20), (5, "the and of to in " * 30)], "doc_id long, text string").withColumn("score", F.lit(1))
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in langid.identify(odd, model).collect()}
    assert [got[k][0] for k in (1, 2, 3)] == ["und"] * 3 and all(got[k][1] for k in (1, 2, 3, 4)) and not got[5][1]
    none = langid.train(rows.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}


def test_letters_beyond_the_basic_plane(spark):
    adlam = "".join(chr(0x1E922 + k % 34) + " " * (k % 5 == 4) for k in range(200))
    rows = [(1, "en", "the cat sat on the mat and ran " * 5), (2, "ff", adlam), (3, "txg", "".join(chr(0x17000 + k % 50) for k in range(100))), (4, "zh", "\uf914\u4e00\u4e8c" * 50)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert model.langs == ["en", "ff", "txg", "zh"]
    new = rows + [(5, "und", "\U0001f914" * 30 + " \U0001f923\U0001f980"), (6, "ff", adlam[7:90].upper())]
    out = langid.identify(spark.createDataFrame(new, "doc_id long, lang string, text string"), model)
    assert {r.doc_id: r.lang_pred for r in out.collect()} == {k: lang for k, lang, _ in new}
    places = langid._place_table()
    own = [places[c] for c in range(0x20000) if chr(c).isalpha() and chr(c).lower() == chr(c)]
    assert 0 not in own and len(set(own)) == len(own)


def test_language_models_in_parts_keep_every_count(spark):
    rng = random.Random(13)
    rare = ["qaxo zuvi wexa qoxi zaqu vixo", "zuvi qaxo vixo wexa zaqu qoxi"]
    rows = [(k, "hot", text_of(rng, 60, 3000).replace("w", "en")) for k in range(300)]
    rows += [(300 + k, "hot", " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(60))) for k in range(300)]
    rows += [(600 + k, "rare", text) for k, text in enumerate(rare)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    whole, split = langid.train(docs), langid.train(docs, max_cells=9_000)
    assert whole.langs == split.langs == ["hot", "rare"] and len(whole.parts) == 1 and len(split.parts) > 2
    texts = [r[2] for r in rows[::50]] + rare + ["", None, "unseen ÄÖ text 12 яблоко"]
    (a, n), (b, m) = whole.score(texts), split.score(texts)
    assert n.tolist() == m.tolist() and np.allclose(a, b, equal_nan=True)
    every = [sorted((r.doc_id, r.lang_pred, round(r.score, 9), round(r.entropy, 6)) for r in langid.identify(docs, m, ["doc_id"], held_bytes=4000).collect()) for m in (whole, split)]
    assert every[0] == every[1] and {r[1] for r in every[0] if r[0] >= 600} == {"rare"}


def test_calibration_uses_every_document_of_a_rare_language(spark):
    rng = random.Random(17)
    letters = [chr(0x4E00 + k) for k in range(400)]
    rare = [(10_000 + k, "rare", "".join(rng.choice(letters) for _ in range(rng.randrange(5, 60)))) for k in range(6)]
    docs = spark.createDataFrame([(k, "hot", "the cat sat on the mat " * 2) for k in range(6000)] + rare, "doc_id long, lang string, text string")
    model = langid.train(docs)
    bits, _ = model.score([r[2] for r in rare])
    own = bits[:, model.langs.index("rare")]
    k = model.langs.index("rare")
    assert math.isclose(model.mean[k], own.mean(), rel_tol=1e-9) and math.isclose(model.spread[k], max(0.15, own.std()), rel_tol=1e-6)
    assert {(r.lang_pred, r.rejected) for r in langid.identify(docs.where("lang = 'rare'"), model).collect()} == {("rare", False)}


def test_ordinal_classifier(spark):
    rng = random.Random(11)
    good, bad, worse = (lambda: text_of(rng, 40, 3000)), (lambda: text_of(rng, 40, 3000) + " ### $$$ ### $$$ ### $$$"), (lambda: text_of(rng, 40, 3000) + " " + rng.choice(["idiot", "scum"]))
    rows = [(k, [worse, bad, good][k % 3](), k % 3) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = quality.train(df, df.select("doc_id", "grade").where("doc_id < 600"))
    assert model.grades == [0, 1, 2] and all(np.diff(model.thresholds) >= 0)
    out = quality.score(df.where("doc_id >= 600").withColumn("tail", F.lit(2)), model).collect()
    assert sum((r.tail >= 0.5) == (r.grade >= 1) for r in out) >= 0.95 * len(out)
    mean = [np.mean([r.expected_grade for r in out if r.grade == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 50_000)], "doc_id long, text string")
    assert all(0 <= r.tail <= 1 and 0 <= r.expected_grade <= 2 for r in quality.score(odd, model).collect())
    flat = quality.train(df.limit(0), df.select("doc_id", "grade").limit(0))
    assert quality.score(odd, flat).count() == 3 and quality.score(odd.limit(0), model).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_returns_one_row_a_document(spark, name):
    table, key = ("pages", "page_id") if name == "op6_warc" else ("documents", "doc_id")
    there = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").count()
    rows = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert rows.count() == there and rows.select(key).distinct().count() == there
