"""Near-duplicate detection with circulant MinHash, banding and exact verification.

Semantics
---------
* A-Z are lower-cased; words are split at space and bytes 9-13. A document's
  set is its distinct ``shingle``-word shingles; with fewer words the whole
  sequence is one; without words (or text) the set is empty and links nothing.
* Two documents are linked when ``100 * |A & B| >= percent * |A | B|``,
  decided on the full sets. A component is what links reach.
* Per row: ``n_shingles``, ``component_id`` (smallest doc_id reachable) and
  ``kept`` (doc_id = component_id).

Method: one permutation scrambles the shingle universe, a second one, shifted
circularly by k, gives signature coordinate k (two permutations in all).
Bands of coordinates propose candidates. With 40 bands of 5 a pair at
similarity 0.8 is missed with probability 1.2e-7.

Groups of copies never become all pairs. Equal sets collapse to one
representative first. In each band bucket every representative is compared
with one hub: the member that sits in the largest buckets, i.e. the text that
most others resemble. That leaves buckets whose members are not all in the hub's
component. What their members x and y can still share is known from the
comparisons with the hub h: ``|x & y| <= min(|x & h|, |y & h|) + |(x - h) & (y - h)|``.
So a pair of members near the hub is looked at only when they share enough
shingles that the hub lacks (found by an equi-join on those shingles) or when the
sizes allow it without any (found by an equi-join on the size). Members far from the hub
(similarity below one half) meet the members of their bucket under two further
conditions: the triangle inequality of the Jaccard distance, and at most ``differ`` of 200
signature bits differing (a pair at 0.8 is missed with chance 1e-8).

What this may miss: a similar pair that no band brings together (chance 1.2e-7 at 0.8, less above) and, among
pairs of one bucket that are both far from its hub, one of more than ``differ`` bits; ``differ=None`` leaves
that filter out. Words and shingles are known by 64-bit hashes, so sets are the full sets up to a collision.

Edge cases: null text and empty text have no shingles and stay; a null doc_id
links nothing by itself, its row takes the component of its equal texts and
is kept only when no other row has that text; doc_id should name one text: of rows that share it each has the
component of its own text, but links of texts that the same doc_id represents are pooled; of equal texts the smallest
doc_id stays, there are no other ties; empty tables give empty results; extra columns of any name stay, names
of result columns are replaced. A very long text is one task's work, with some 30 bytes a byte of text, and its
set of 8 bytes a shingle is held whole when it is compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from confluo.llm.bytesops import ASCII_LOWER, SPACED, U64, blocks, mix, utf8, word_hashes, word_spans
from confluo.llm.names import fresh, without
from confluo.operators.components import connected_components
from confluo.plans.shared import materialize
from confluo.plans.skew import keyed_join

RESULT = ["n_shingles", "component_id", "kept"]
BANDS, ROWS = 40, 5
BLOCK = 1 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every row."""
    data = ASCII_LOWER[data]
    starts, ends, first = word_spans(data, offsets, SPACED)
    hashes = word_hashes(data, starts, ends)
    grams = hashes.copy()
    for k in range(1, shingle):
        rolled = grams[: len(grams) - k] * U64(0x9FB21C651E98DF25) + hashes[k:]
        grams[: len(rolled)] = mix(rolled)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= shingle:
            sets.append(np.unique(grams[a : b - shingle + 1]))
        elif b > a:
            acc = hashes[a]
            for h in hashes[a + 1 : b]:
                acc = mix(np.array([acc], U64) * U64(0x9FB21C651E98DF25) + h)[0]
            sets.append(mix(np.array([acc ^ U64(b - a)], U64)))
        else:
            sets.append(np.zeros(0, U64))
    return sets


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation, of 32-bit numbers."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of non-empty sets: one row a set, one uint32 column a coordinate."""
    if not sets:
        return np.zeros((0, coordinates), np.uint32)
    scrambled = (mix(np.concatenate(sets) ^ U64(0xA0761D6478BD642F)) >> U64(32)).astype(np.uint32)
    sizes = np.array([len(s) for s in sets])
    first = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), coordinates), np.uint32)
    for k in range(coordinates):
        out[:, k] = np.minimum.reduceat(_second(scrambled - np.uint32(k)), first)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    keys = np.empty((len(signature), BANDS), np.int64)
    for b in range(BANDS):
        acc = np.full(len(signature), b + 1, U64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            acc = mix(acc * U64(0x9FB21C651E98DF25) + signature[:, k].astype(U64))
        keys[:, b] = acc.view(np.int64)
    return keys


def _fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _features(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for i, j in blocks(offsets, BLOCK):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
                prints = [_fingerprint(s) if len(s) else None for s in sets]
                # equal sets are signed once a block, at the row that may represent them: that of the smallest doc_id
                ids = batch.column(0).slice(i, j - i).to_pylist()
                spot: dict[bytes, int] = {}
                for k in sorted(range(j - i), key=lambda k: (ids[k] is None, ids[k] if ids[k] is not None else 0)):
                    if prints[k] is not None:
                        spot.setdefault(prints[k], k)
                signature = signatures([sets[k] for k in spot.values()])
                keys = band_keys(signature)
                bits = np.zeros((len(signature), 32), np.uint8)
                bits[:, : BANDS * ROWS // 8] = np.packbits((signature & np.uint32(1)).astype(bool), axis=1)
                bits = bits.view(np.int64)
                line = {k: n for n, k in enumerate(spot.values())}
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(1).slice(i, j - i),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(prints, pa.binary()),
                        pa.array([keys[line[k]] if k in line else None for k in range(j - i)], pa.list_(pa.int64())),
                        pa.array([bits[line[k]] if k in line else None for k in range(j - i)], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "row", "n", "print", "keys", "bits"],
                )

    return run


def _sets(shingle: int, filter_):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy().view(U64) & U64(64 * len(filter_.value) - 1)
            batch = batch.filter(pa.array((filter_.value[at >> U64(6)] >> (at & U64(63))) & U64(1) == 1))
            data, offsets = utf8(batch.column(1))
            for i, j in blocks(offsets, BLOCK):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([_fingerprint(s) if len(s) else None for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["doc_id", "print", "members"],
                )

    return run


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes: dict[str, list] = {"na": [], "nb": [], "common": [], "linked": [], "own": []}
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                inside = np.isin(a, b, assume_unique=True)
                common = int(inside.sum())
                either = len(a) + len(b) - common
                sizes["na"].append(len(a))
                sizes["nb"].append(len(b))
                sizes["common"].append(common)
                sizes["linked"].append(100 * common >= percent * either)
                sizes["own"].append(a[~inside].view(np.int64) if 2 * common >= either else None)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(v, t) for v, t in zip(sizes.values(), kinds, strict=True)]], ["a", "b", *sizes])

    return run


def bit_filter(wanted: DataFrame, most: int = 1 << 26) -> np.ndarray:
    """A bitmap over the hashes of the wanted ids, so that texts of other documents need not be shuffled.

    About 16 bits an id, 8 MB at most; with more ids it lets more pass, the join after it is exact.
    """
    bits, need = 1 << 10, min(most, 16 * wanted.count())
    while bits < need:
        bits *= 2
    at = F.xxhash64("id").bitwiseAND(F.lit(bits - 1))
    words = wanted.select(F.shiftright(at, 6).alias("w"), F.expr("shiftleft(1L, cast(xxhash64(id) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint64)


def compared(pairs: DataFrame, docs: DataFrame, reps: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of representatives with the sizes of their full sets, what they have in
    common, whether they are linked and, for similar ones, the shingles of a that b lacks."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "wanted")
    filter_ = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted))
    texts = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    sets = texts.mapInArrow(_sets(shingle, filter_), f"doc_id {kind}, print binary, members binary")
    sets = sets.join(wanted, sets.doc_id == wanted.id, "left_semi")
    sets = sets.join(reps.select(F.col("rep").alias("_rep"), F.col("print").alias("_print")), (F.col("doc_id") == F.col("_rep")) & (F.col("print") == F.col("_print")), "left_semi").dropDuplicates(["doc_id", "print"])
    sets = materialize(sets.select("doc_id", "members"), "sets")
    left = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("sb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return joined.mapInArrow(_compare(percent), f"a {kind}, b {kind}, na long, nb long, common long, linked boolean, own array<long>")


def _open_pairs(spokes: DataFrame, part: DataFrame, live: DataFrame, hubs: DataFrame, bits: DataFrame, percent: int, differ: int | None) -> DataFrame:
    """Pairs ``(a, b)`` of bucket members in different components that may still be similar."""
    comp = part.select(F.col("node").alias("_n"), "component")

    def placed(df: DataFrame, by: str, name: str) -> DataFrame:
        return df.join(comp, df[by] == F.col("_n"), "left").withColumn(name, F.coalesce("component", by)).drop("_n", "component")

    spokes = materialize(placed(spokes.withColumnsRenamed({"a": "x", "b": "hub"}).withColumn("near", F.col("own").isNotNull()), "x", "cx"), "placed")
    # per hub its component and whether all that were compared with it are in it; a hub of a third of all rows is joined by broadcast
    around = placed(spokes.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.min("cx").alias("low"), F.max("cx").alias("high")), "hub", "ch")
    around = materialize(around.select("hub", "n", "ch", ((F.col("low") != F.col("ch")) | (F.col("high") != F.col("ch"))).alias("open")).where("open").drop("open"), "open")
    unsettled = around.select("hub")
    around = materialize(keyed_join(spokes, around.drop("n"), around.select("hub", "n"), ["hub"]), "spokes")
    near = around.where("near")
    need = lambda nx, ny: F.ceil((nx + ny) * percent / (100 + percent))  # noqa: E731  what a link has in common at least
    one = near.where("cx <> ch").select("hub", "x", "cx", F.col("na").alias("nx"), F.col("common").alias("mx"))
    two = near.select("hub", F.col("x").alias("y"), F.col("cx").alias("cy"), F.col("na").alias("ny"), F.col("common").alias("my"))
    # shingles beyond the hub, the rarest around this hub first; a pair that shares s of them
    # has a first common one with at least s - 1 behind it on either side
    own = materialize(near.select("hub", "x", F.explode("own").alias("g")), "own")
    often = own.groupBy("hub", "g").agg(F.count(F.lit(1)).alias("f"))
    line = Window.partitionBy("hub", "x").orderBy("f", "g")
    placed_own = own.join(often, ["hub", "g"]).select("hub", "x", "g", "f", (F.count(F.lit(1)).over(Window.partitionBy("hub", "x")) - F.row_number().over(line) + 1).alias("left"))
    placed_own = materialize(placed_own.where("f > 1").drop("f"), "placed")
    share = need(F.col("nx"), F.col("ny")) - F.least("mx", "my")
    first = placed_own.join(one, ["hub", "x"]).withColumnRenamed("left", "lx")
    second = placed_own.withColumnsRenamed({"x": "y", "left": "ly"}).join(two, ["hub", "y"]).withColumnsRenamed({"hub": "_h", "g": "_g"})
    shared = (
        first.join(second, (F.col("hub") == F.col("_h")) & (F.col("g") == F.col("_g")) & (F.col("cx") != F.col("cy")) & (share >= 1) & (F.least("lx", "ly") >= share))
        .select("x", "y")
        .distinct()
    )
    low, high = F.ceil(F.col("nx") * percent / 100), F.floor(F.col("mx") * (100 + percent) / percent) - F.col("nx")
    sized = (
        one.where(low <= high)
        .withColumn("ny", F.explode(F.sequence(low, high)))
        .join(two, ["hub", "ny"])
        .where((F.col("cx") != F.col("cy")) & (F.least("mx", "my") >= need(F.col("nx"), F.col("ny"))))
        .select("x", "y")
    )
    far = around.where("not near").select("x").distinct()
    mixed = live.join(hubs.join(unsettled, "hub", "left_semi"), "key").select("key", "hub", F.col("rep").alias("x"))
    apart = F.lit(1.0) - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    known = around.select("hub", "x", "cx", "ch", "near", apart.alias("d"))
    centre = around.select("hub", F.col("hub").alias("x"), F.col("ch").alias("cx"), "ch", F.lit(True).alias("near"), F.lit(0.0).alias("d")).distinct()
    member = mixed.join(known.unionByName(centre), ["hub", "x"]).join(bits.select(F.col("rep").alias("x"), "bits"), "x")
    if far.isEmpty():
        distant = shared.limit(0)
    else:
        left = member.where("not near").select("key", "x", "cx", "ch", F.col("d").alias("dx"), F.col("bits").alias("bx"))
        right = member.select("key", F.col("x").alias("y"), F.col("cx").alias("cy"), F.col("ch").alias("hy"), F.col("d").alias("dy"), F.col("bits").alias("by"))
        differing = sum((F.bit_count(F.col("bx")[k].bitwiseXOR(F.col("by")[k])) for k in range(4)), F.lit(0))
        alike = F.lit(True) if differ is None else differing <= differ
        distant = (
            left.join(right, (left.key == right.key) & (F.col("cx") != F.col("cy")) & ((F.col("cx") != F.col("ch")) | (F.col("cy") != F.col("hy"))) & (F.abs(F.col("dx") - F.col("dy")) <= 1.0 - percent / 100 + 1e-9) & alike)
            .select("x", "y")
        )
    rest = shared.unionByName(sized).unionByName(distant)
    return rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, differ: int | None = 50) -> DataFrame:
    """``docs`` with ``n_shingles, component_id, kept``; ``differ=None`` compares far pairs without looking at bits first."""
    docs = without(docs, RESULT)
    key, other, row = fresh([*docs.columns, *RESULT], "key", "id", "row")
    found = classes(docs, shingle, percent, differ).withColumnsRenamed({"_id": other, "_r": row})
    joined = docs.withColumn(key, F.xxhash64("doc_id", "text")).join(found, (F.col(key) == F.col(row)) & F.col("doc_id").eqNullSafe(F.col(other)), "left")
    return joined.drop(key, other, row)


def classes(docs: DataFrame, shingle: int, percent: int, differ: int | None = 50, per_row: bool = False) -> DataFrame:
    """``(_id, _r, n_shingles, component_id, kept)``: one line per distinct row, or per row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    features = materialize(
        texts.mapInArrow(_features(shingle), f"doc_id {kind}, row long, n long, print binary, keys array<long>, bits array<long>"),
        "minhash",
    )
    known = features.where("print is not null and doc_id is not null")
    reps = known.groupBy("print").agg(F.min("doc_id").alias("rep"))
    banded = known.join(reps.withColumnRenamed("print", "_p"), (F.col("print") == F.col("_p")) & (F.col("doc_id") == F.col("rep")))
    # of repeated rows only one a block is signed
    banded = banded.where("keys is not null").dropDuplicates(["print"]).select("rep", "bits", "keys")
    spread = banded.select("rep", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    live = materialize(spread.join(shared, "key"), "buckets")
    score = live.groupBy("rep").agg(F.sum("many").alias("score"))
    hubs = live.join(score, "rep").groupBy("key").agg(F.max_by("rep", F.struct("score", "rep")).alias("hub"))
    hubs = materialize(hubs, "hubs")
    pairs = live.join(hubs, "key").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    spokes = materialize(compared(materialize(pairs, "pairs"), docs, reps, shingle, percent), "spokes")
    links = spokes.where("linked").select("a", "b")
    part = connected_components(links, "a", "b")
    rest = materialize(_open_pairs(spokes, part, live, hubs, banded.select("rep", "bits"), percent, differ), "rest")
    if rest.isEmpty():
        whole = part
    else:
        more = compared(rest, docs, reps, shingle, percent).where("linked").select("a", "b")
        stars = part.select(F.col("node").alias("a"), F.col("component").alias("b"))  # the links so far, contracted
        whole = connected_components(stars.unionByName(more), "a", "b")
    named = reps.join(whole, reps.rep == whole.node, "left").select(
        F.col("print").alias("_p"), F.coalesce("component", "rep").alias("component")
    )
    rows = features.select("doc_id", "row", "n", "print")
    rows = rows if per_row else rows.dropDuplicates(["doc_id", "row"])
    component = F.coalesce("component", F.col("doc_id"))
    return rows.join(named, F.col("print") == F.col("_p"), "left").select(
        F.col("doc_id").alias("_id"),
        F.col("row").alias("_r"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, its smallest doc_id, with the columns of ``docs``.

    Rows that agree in doc_id and text are copies of each other: one stays.
    """
    key, other, row = fresh(docs.columns, "key", "id", "row")
    kept = classes(docs, shingle, percent).where("kept").select(F.col("_id").alias(other), F.col("_r").alias(row))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    rows = keyed.join(kept, (F.col(key) == F.col(row)) & F.col("doc_id").eqNullSafe(F.col(other)), "left_semi")
    return rows.dropDuplicates(["doc_id", key]).drop(key)
