"""Near duplicates against brute force, and awkward inputs."""

import random

import pytest
from pyspark.sql import functions as F

from confluo.llm import neardup


def brute(rows, shingle, percent):
    sets = []
    for _, text in rows:
        words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        sets.append({tuple(words[i : i + shingle]) for i in range(len(words) - shingle + 1)} if len(words) >= shingle else ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), doc), doc)
    return sorted((doc, len(sets[i]), low[find(i)], doc == low[find(i)]) for i, (doc, _) in enumerate(rows))


def got(df):
    return sorted((r._id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


@pytest.mark.parametrize("shingle", [2, 5])
def test_groups_of_copies_match_brute_force(spark, shingle):
    rng = random.Random(shingle)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, doc = [], 0
    for group, size in ((0, 160), (1, 60), (2, 5)):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(size):
            text = base[:]
            for _ in range(rng.choice([0, 1, 3, 6, 9, 12, 15] if shingle == 2 else [0, 1, 2, 3, 4, 6])):
                # few substitutes per place, so that copies of copies share changes
                at = rng.randrange(len(text))
                text[at] = f"x{at}-{rng.randrange(2)}"
            if rng.random() < 0.2:
                text = text[: rng.randrange(90, 120)]
            rows.append((doc, " ".join(text)))
            doc += 1
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(60):  # share a passage, similarity about one third
        rows.append((doc, " ".join(passage + [rng.choice(vocabulary) for _ in range(60)])))
        doc += 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(neardup.classes(df, shingle, 80, per_row=True)) == brute(rows, shingle, 80)


def test_awkward_rows(spark):
    rows = [(1, "a b c"), (2, "A  b\tC"), (3, None), (4, ""), (5, " \n "), (6, "one"), (7, "one"), (8, "two"), (7, "one"), (9, "x " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kept": F.lit(3), "_x": F.lit(1)})
    found = neardup.near_duplicates(df, shingle=2)
    assert found.columns == ["doc_id", "text", "_x", "n_shingles", "component_id", "kept"]
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found.collect()) == sorted(brute(rows, 2, 80))
    kept = neardup.drop_near_duplicates(df, shingle=2)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 6, 8, 9]


def test_repeated_rows_keep_their_links_in_any_order(spark, monkeypatch):
    text = " ".join(f"w{k}" for k in range(100))
    rows = [(1, text), (1, text), (2, text + " more"), (2, text + " more")]
    write = neardup.materialize

    def unsigned_first(df, name="step"):
        return write(df.coalesce(1).sortWithinPartitions(F.col("keys").asc_nulls_first()) if name == "minhash" else df, name)

    monkeypatch.setattr(neardup, "materialize", unsigned_first)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert got(neardup.classes(df, 2, 80, per_row=True)) == brute(rows, 2, 80)


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "p q r"), (4, "p q r"), (None, "s t u")], "doc_id long, text string")
    assert sorted(((r._id, r.component_id, r.kept) for r in neardup.classes(df, 2, 80).collect()), key=str) == [(4, 4, True), (None, 4, False), (None, None, True)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0
