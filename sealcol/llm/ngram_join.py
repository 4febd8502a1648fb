"""N-gram Jaccard self-join: a MinHash LSH forest for candidates, exact verification, connected groups.

Texts are compared as sets of five-word shingles (a text of fewer words, but not none, is one shingle); a link is a Jaccard
similarity of at least ``threshold`` between two different sets. Steps, none of which sees more than one row per set:

1. Rows of the same shingle set fall into one class; only classes go on, so a hot group of copies is one row.
2. Each class has a label in each of ``trees`` prefix trees (a forest): ``deepest`` MinHash values one after another. Labels
   meet by sorted prefix. Matching begins with whole labels, and the prefix is shortened by one value at a time, in all trees
   at once, until the measured recall is at least ``recall``: a candidate pair whose labels agree in a share a of their values
   had the chance 1 - (1 - a**depth)**trees to be met, so it stands for 1 / chance pairs, and one more pair just at the threshold
   is added for what no pair tells of. It is never shortened beyond the depth at which pairs just at the threshold meet with that probability.
3. A run of a few classes under one prefix gives its pairs, each in the first tree where it meets, and only if the labels'
   agreement doesn't rule the similarity out. A run of more gives each member one edge to its least member.
4. Candidate edges make families. Each class's text is sent once to its family, and all pairs of a family are verified on
   exact sets there, in integers; a family of over ``block`` classes is cut into blocks and verified block against block, since
   the number of each class's links is part of the result. What leaves is one row per class and block pair - its links and a
   root - never the pairs themselves.
5. Verified links make the groups.

Defined cases: null and empty texts have no shingle, no links, and are one class; very long texts are cut nowhere (their
families get more blocks); ids may be null or repeated (a group's id is its smallest id; ``keep_one`` takes null last, and of
rows equal in id and set any one); an empty table has no rows. Other columns are carried by ``keep_one`` and not looked at.
A 128-bit hash of its shingles identifies a set; sets are compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, free_name, materialise, with_fields
from .components import components
from .vectext import chunks, find_words, mix, windows, Words

SHINGLE = 5
THRESHOLD = 0.8
#: Classes under one prefix up to which pairs are told one by one.
FEW = 16
#: Keys of sets that a task remembers to have told.
TOLD = 100_000
BLOCK = 512
#: Shingles of a block on average: families of very long texts get more blocks.
BLOCK_SHINGLES = 1_000_000


def met(similarity: float, depth: int, trees: int) -> float:
    """The chance that two labels share a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def depth_for(threshold: float, recall: float, trees: int, deepest: int) -> int:
    """The longest prefix at which pairs at the threshold still meet in some tree with the given probability."""
    return next((d for d in range(deepest, 1, -1) if met(threshold, d, trees) >= recall), 1)


def measured_recall(agreeing: dict[int, int], depth: int, threshold: float, trees: int, deepest: int) -> float:
    """Of the pairs at or above the threshold the share that is met, from how many met pairs agree in how many values."""
    alike = {n / (trees * deepest): pairs for n, pairs in agreeing.items() if n >= threshold * trees * deepest}
    missed = sum(pairs * (1 / met(a, depth, trees) - 1) for a, pairs in alike.items()) + 1 / met(threshold, depth, trees) - 1
    n = sum(alike.values())
    return n / (n + missed)


def shingle_sets(w: Words, k: int = SHINGLE) -> list[np.ndarray]:
    """Each row's distinct shingle hashes, sorted."""
    at, g = windows(w, k)
    ptr = np.searchsorted(at, w.ptr)
    short = {}
    n = np.diff(w.ptr)
    for size in range(1, k):
        rows = np.flatnonzero(n == size)
        if len(rows):
            places, h = windows(w, size)
            for r, x in zip(rows.tolist(), h[np.searchsorted(places, w.ptr[rows])].tolist()):
                short[r] = np.array([x], np.uint64)
    return [short[r] if r in short else np.unique(g[ptr[r] : ptr[r + 1]]) for r in range(len(n))]


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


class Signer:
    """MinHash values of a set, 16 bits each, tree by tree."""

    def __init__(self, trees: int, deepest: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 1 << 32, trees * deepest, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, trees * deepest, dtype=np.uint32)

    def label(self, s: np.ndarray) -> bytes:
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        x = (s >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(x), 2048):
            least = np.minimum(least, (x[i : i + 2048, None] * self.a + self.b).min(axis=0))
        return (mix(least.astype(np.uint64)) & np.uint64(0xFFFF)).astype(">u2").tobytes()


def _ledger(docs: DataFrame, id_col: str, text_col: str, trees: int, deepest: int) -> DataFrame:
    """id, key, n (shingles), label of each row."""
    src = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))

    def run(batches):
        signer = Signer(trees, deepest)
        for batch in batches:
            for a, b, raw, offs in chunks(batch.column(1)):
                sets = shingle_sets(find_words(raw, offs))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([signer.label(s) if len(s) else b"" for s in sets], pa.binary())], names=["id", "key", "n", "label"])

    return src.mapInArrow(run, with_fields(src.select("id"), "key binary, n long, label binary"))


def _pairs(few: DataFrame, trees: int, deepest: int, depth: int, least: float) -> DataFrame:
    """Pairs of each small run of (tree, prefix), and in how many values their labels agree: in the first tree where they meet, unless their labels rule them out."""

    def run(batches):
        held: tuple = (None, [], [])
        for batch in batches:
            a, b, agree = [], [], []
            for tree, prefix, key, label in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if (tree, prefix) != held[0]:
                    held = ((tree, prefix), [], [])
                v = np.frombuffer(label, np.uint16).reshape(trees, deepest)
                for other, u in zip(held[1], held[2]):
                    same = u == v
                    n = int(same.sum())
                    if n >= least * same.size and not same[:tree, :depth].all(axis=1).any():
                        a.append(min(key, other))
                        b.append(max(key, other))
                        agree.append(n)
                held[1].append(key)
                held[2].append(v)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(agree, pa.int32())], names=["a", "b", "agree"])

    return few.select("tree", "prefix", "key", "label").repartition("tree", "prefix").sortWithinPartitions("tree", "prefix").mapInArrow(run, "a binary, b binary, agree int")


def _forest(classes: DataFrame, threshold: float, recall: float, trees: int, deepest: int) -> DataFrame:
    """Candidate edges (a, b) of the classes, at the longest prefix that has the recall."""
    labels = classes.filter(F.col("n") > 0).select("key", "label")
    slack = 5.5 * math.sqrt(threshold * (1 - threshold) / (trees * deepest))
    for depth in range(deepest, depth_for(threshold, recall, trees, deepest) - 1, -1):
        tree = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring(F.col("label"), t * 2 * deepest + 1, F.lit(2 * depth)))).alias("tree", "prefix")
        placed = labels.select("key", tree)
        runs = placed.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("m"), F.min("key").alias("least")).filter("m > 1")
        # an exchange of its own: both sides of the join are plain ones, and a run that many share can be split
        shared = materialise(placed.join(runs.repartition("tree", "prefix").hint("merge"), ["tree", "prefix"]), "forest-runs")
        few = shared.filter(F.col("m") <= FEW).join(labels.hint("merge"), "key")
        pairs = materialise(_pairs(few, trees, deepest, depth, threshold - slack), "forest-pairs")
        agreeing = {r["agree"]: r["count"] for r in pairs.groupBy("agree").count().collect()}  # at most one row a value of the labels
        if measured_recall(agreeing, depth, threshold, trees, deepest) >= recall:
            break
    stars = shared.filter((F.col("m") > FEW) & (F.col("key") != F.col("least"))).select(F.col("least").alias("a"), F.col("key").alias("b")).distinct()
    return pairs.select("a", "b").union(stars)


def links_within(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set, and the least index it is connected to; pairs are those of left x right (each once)."""
    n = len(sets)
    count, root = np.zeros(n, np.int64), np.arange(n)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    value, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    shared = times[code] > 1  # a shingle of one set alone is in no intersection
    code, owner = (np.cumsum(times > 1) - 1)[code[shared]], owner[shared]
    width = int((times > 1).sum())
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    place_l, place_r = np.full(n, -1), np.full(n, -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    both = np.zeros((len(left), len(right)), np.int64)
    for c in range(0, width, 2048):
        a, b = np.searchsorted(code, [c, c + 2048])
        part = np.zeros((n, min(2048, width - c)), np.float32)
        part[owner[a:b], code[a:b] - c] = 1
        both += (part[left] @ part[right].T).astype(np.int64)  # whole numbers below 2049: exact in float32
    union = size[left][:, None] + size[right][None, :] - both
    ratio = Fraction(threshold).limit_denominator(1_000_000)
    hit = (both * ratio.denominator >= ratio.numerator * union) & (size[left][:, None] > 0)
    same = np.array_equal(left, right)
    if same:
        np.fill_diagonal(hit, False)
    count[left] += hit.sum(axis=1)
    if not same:
        count[right] += hit.sum(axis=0)
    changed = True
    lists = [(left[i], right[np.flatnonzero(hit[i])]) for i in np.flatnonzero(hit.any(axis=1))]
    while changed:
        changed = False
        for i, others in lists:
            low = min(root[i], root[others].min())
            if root[i] != low or (root[others] != low).any():
                root[i] = low
                root[others] = low
                changed = True
    return count, root


def _verified(members: DataFrame, texts: DataFrame, threshold: float, block: int) -> DataFrame:
    """key, root (a key it is linked to, or its own), links; one row per class and block pair of its family.

    members: key, family, blocks (of the family). texts: key, text, a key any number of times.
    """
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    placed = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1).cast("array<int>")))
    placed = placed.select("key", "family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    rows = texts.join(placed.hint("merge"), "key").select("family", "i", "j", "key", "own", "text")
    rows = rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "key")

    def solve(group, keys, owns, texts):
        sets = []
        for _, _, raw, offs in chunks(pa.array(texts, pa.large_string())):
            sets += shingle_sets(find_words(raw, offs))
        owns = np.array(owns)
        left, right = np.flatnonzero(owns == group[1]), np.flatnonzero(owns == group[2])
        count, root = links_within(sets, left, right, threshold)
        return keys, [keys[r] for r in root.tolist()], count.tolist()

    def run(batches):
        group, keys, owns, texts = None, [], [], []
        out: tuple[list, list, list] = ([], [], [])

        def close():
            if keys:
                for whole, part in zip(out, solve(group, keys, owns, texts)):
                    whole.extend(part)

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in range(6)]):
                if row[:3] != group:
                    close()
                    group, keys, owns, texts = row[:3], [], [], []
                if not keys or keys[-1] != row[3]:
                    keys.append(row[3])
                    owns.append(row[4])
                    texts.append(row[5])
            if len(out[0]) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], names=["key", "root", "links"])
                out = ([], [], [])
        close()
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], names=["key", "root", "links"])

    return rows.mapInArrow(run, "key binary, root binary, links long")


def _keyed_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """key and text of the rows; of copies in a task few are told."""
    src = docs.select(col(text_col).cast("string").alias("text"))

    def run(batches):
        told: set[bytes] = set()
        for batch in batches:
            for a, b, raw, offs in chunks(batch.column(0)):
                keys = [set_key(s) for s in shingle_sets(find_words(raw, offs))]
                new = [i for i, k in enumerate(keys) if not (k in told or told.add(k))]
                if len(told) > TOLD:
                    told.clear()
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in new], pa.binary()), batch.column(0).slice(a, b - a).take(pa.array(new, pa.int64()))], names=["key", "text"])

    return src.mapInArrow(run, "key binary, text string")


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = 0.9995, trees: int = 16, deepest: int = 8, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(ledger, classes), both written: ledger has id and key of each row; classes key, copies, links, group (a key), group_id, group_key."""
    whole = materialise(_ledger(docs, id_col, text_col, trees, deepest), "shingle-ledger")
    classes = whole.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("id"), F.max("n").alias("n"), F.max("label").alias("label"))
    classes = materialise(classes, "shingle-classes")
    families = components(_forest(classes, threshold, recall, trees, deepest))
    families = families.join(classes.select(F.col("key").alias("node"), "n"), "node")
    sizes = families.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = families.join(sizes, "root").select(F.col("node").alias("key"), F.col("root").alias("family"), "blocks")
    found = materialise(_verified(members, _keyed_texts(docs, text_col), threshold, block), "verified-links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    groups = components(found.filter(F.col("key") != F.col("root")).select(F.col("root").alias("a"), F.col("key").alias("b")))
    out = classes.select("key", "copies", "id").join(links, "key", "left").join(groups.select(F.col("node").alias("key"), "root"), "key", "left")
    out = out.select("key", "copies", "id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "key").alias("root"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("key"))).alias("first")
    tops = out.groupBy("root").agg(first)
    out = out.join(tops, "root").select("key", "copies", "links", F.col("first.id").alias("group_id"), F.col("first.key").alias("group_key"))
    return whole.select("id", "key"), materialise(out, "shingle-groups")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row: id, class_id (its group's smallest id), n_links (other shingle sets it is linked to), n_copies (rows of its own set)."""
    ledger, classes = join(docs, id_col=id_col, text_col=text_col, **options)
    out = ledger.join(classes.hint("merge"), "key")
    return out.select(F.col("id").alias(id_col), F.col("group_id").alias("class_id"), F.col("links").alias("n_links"), F.col("copies").alias("n_copies"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input's rows and columns, one row of each group: that of the smallest id."""
    ledger, classes = join(docs, id_col=id_col, text_col=text_col, **options)
    # of the classes of a group one stays, with its smallest id; what is joined to whole rows are ids to drop
    keep = classes.filter(F.col("key") == F.col("group_key")).select("key", F.col("group_id").alias("keep_id"))
    doc, key = free_name(docs, "doc_"), free_name(docs, "key_")
    at, names = docs.columns.index(text_col), [*docs.columns, key]

    def run(batches):
        for batch in batches:
            for a, b, raw, offs in chunks(batch.column(at)):
                keys = [set_key(s) for s in shingle_sets(find_words(raw, offs))]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(keys, pa.binary())], names=names)

    keyed = docs.mapInArrow(run, with_fields(docs, f"`{key}` binary"))
    rows = keyed.select(F.struct(*[col(c) for c in docs.columns]).alias(doc), col(id_col).alias("id"), F.col(f"`{key}`").alias("key"))
    kept = rows.join(keep.hint("merge"), (rows["key"] == keep["key"]) & rows["id"].eqNullSafe(keep["keep_id"]), "left_semi")
    kept = kept.groupBy("key").agg(F.first(doc).alias(doc))
    return kept.select(*[F.col(doc)[c].alias(c) for c in docs.columns])
