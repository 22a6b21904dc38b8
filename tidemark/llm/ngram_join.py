"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

1. Texts with the same set of shingles are one node.
2. Of a node of n shingles the smallest hashes are taken (``SKETCH``, or, if that is shorter, the prefix
   in which linked sets share ``SHARED`` hashes). Linked sets share that many of them, so each may pass
   over the ``SHARED`` - 1 that most nodes have: those of common lines. It is filed under the others and
   its size band; one band is as wide as the sizes of two linked sets can differ, so a node also visits
   the band below. Files of the same nodes are one.
3. A file with more rows than a tile holds is split into tiles by a hash, each pair of tiles apart.
   In a tile, popcounts of the bitmap signatures, which are as wide as the sets need, bound the overlap of
   two sets from above; pairs that could link are joined to groups, and only a spanning forest of them
   leaves the tile.
4. The texts of one group of the forest meet in tiles again, and sorted arrays of shingle hashes are
   intersected exactly. Pairs already connected inside a tile needn't be.

With ``sketch=None`` the full prefix is taken, however long, and nothing is left to chance; by default
two linked sets share ``SHARED`` hashes among the smallest ``SKETCH`` of each unless fewer of the smallest
``SKETCH`` of their union lie in the intersection, which for random hashes has a probability of at most
4e-17 (8 of 40, each in it with 0.8): less than that of two shingles having one 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import chunks_by_bytes, cut
from .graph import connected_components

WORDS, PERCENT = 5, 80
SKETCH, SHARED = 40, 8
BITMAP_WORDS = 16  # of 64 bits
TILE_ROWS = 2048
#: Rows and shingles of a verification tile, where whole sets meet.
SET_ROWS, SET_SHINGLES = 2048, 4_000_000
BLOCK_BYTES = 4 << 20
#: Words whose hashes a Python worker keeps at most.
REMEMBERED = 250_000


class _Hashes(dict):
    def __missing__(self, word):
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Hashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | bytes | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than a shingle are one, none are none."""
    data = (text.encode() if isinstance(text, str) else text) or b""
    words = data.lower().split()  # ASCII letters and white space only
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(_words) > REMEMBERED:
        _words.clear()
    a = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(a) < size:
        return np.array([xxhash.xxh3_64_intdigest(b"\0".join(words))], dtype=np.uint64)
    n = len(a) - size + 1
    h = _mix(a[:n])
    for i in range(1, size):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + a[i : i + n])
    return np.unique(h)


def _bitmap(hashes: np.ndarray, words: int = BITMAP_WORDS) -> np.ndarray:
    """Signature of a set in so many words of 64 bits: each bit is the parity of the number of hashes that fall on it.

    A bit in which two signatures differ stands for at least one element of one set alone, however
    full the signatures are.
    """
    counts = np.bincount(((hashes >> np.uint64(20)) % np.uint64(words * 64)).astype(np.int64), minlength=words * 64)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def overlap_bound(n, m, differing):
    """Largest possible intersection of sets of n and m whose signatures differ in so many bits."""
    return np.minimum((n + m - differing) // 2, np.minimum(n, m))


def _folded(bitmap: bytes, words: int) -> np.ndarray:
    """A signature in fewer words, both powers of two: parities of places that become one are joined."""
    bits = np.frombuffer(bitmap, dtype=np.uint64)
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def signature(hashes: np.ndarray) -> bytes:
    """The bitmap of a set, of as many bits as it has hashes or up to twice that: sets much less alike than
    the threshold differ in more of them than linked ones can, however large they are."""
    return _bitmap(hashes, 1 << max(2, (len(hashes) - 1).bit_length() - 6)).tobytes()


def shared_least(n: int, percent: int = PERCENT) -> int:
    """Hashes that the prefix of a set of n shares with that of any linked set of n or more."""
    return min(SHARED, -(-percent * n // 100))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Of a set of n, so many of the smallest hashes that any linked set must share ``shared_least`` of them."""
    return n - -(-percent * n // 100) + shared_least(n, percent)


def spare(n: int, percent: int = PERCENT) -> int:
    """Of the hashes in its prefix a set of n needn't be filed under so many, whichever come last in one order of all hashes.

    The prefixes of two linked sets share more hashes than either passes over, so the first one
    that they share is passed over by neither. The smallest set that can link decides.
    """
    return shared_least(-(-percent * n // 100), percent) - 1


def band(n: int, percent: int = PERCENT) -> int:
    """Linked sets lie in the same band or in neighbouring ones."""
    return int(np.floor(np.log(n) / np.log(100 / percent) + 1e-9))


def needed(n: np.ndarray, m, percent: int = PERCENT) -> np.ndarray:
    """Smallest intersection of linked sets of n and m: i (100 + percent) >= percent (n + m)."""
    return -(-percent * (n + m) // (100 + percent))


class _Forest:
    """Union-find over the rows of a tile."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    def all(self) -> np.ndarray:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return up
            self.root = up


def possible_pairs(n: np.ndarray, bits: np.ndarray, side: np.ndarray | None, percent: int = PERCENT):
    """Edges (i, j) of a spanning forest of the pairs of rows that the bounds allow to link.

    ``side``: pairs within one side are left
    to another tile, unless None.
    """
    order = np.argsort(n, kind="stable")
    n, bits, side = n[order], bits[order], None if side is None else side[order]
    forest, out = _Forest(len(n)), []
    for i in range(len(n) - 1):
        # Sizes ascend: no set larger than n * 100 / percent can link.
        stop = int(np.searchsorted(n, n[i] * 100 // percent, side="right"))
        if stop <= i + 1:
            continue
        later = np.arange(i + 1, stop)
        if side is not None:
            later = later[side[later] != side[i]]
        later = later[forest.all()[later] != forest.find(i)]
        if not len(later):
            continue
        most = overlap_bound(n[later], n[i], np.bitwise_count(bits[later] ^ bits[i]).sum(axis=1, dtype=np.int64))
        for j in later[most >= needed(n[later], n[i], percent)].tolist():
            a, b = forest.find(i), forest.find(j)
            if a != b:
                forest.root[b] = a
                out.append((int(order[i]), int(order[j])))
    return out


def linked_pairs(sets: list[np.ndarray], side: np.ndarray | None, percent: int = PERCENT):
    """Edges of a spanning forest of the pairs of sets that do link, by exact intersection.

    Of each set, the later ones that could link and aren't connected to it yet are found at once; their
    signatures are as wide as the sets of the tile need.
    """
    n = np.array([len(s) for s in sets])
    width = max(BITMAP_WORDS, min(1024, 1 << int(2 * n.max() // 64).bit_length()))
    bits = np.stack([_bitmap(s, width) for s in sets])
    order = np.argsort(n, kind="stable")
    n, bits, side = n[order], bits[order], None if side is None else side[order]
    forest, out = _Forest(len(sets)), []
    for i in range(len(n) - 1):
        stop = int(np.searchsorted(n, n[i] * 100 // percent, side="right"))
        later = np.arange(i + 1, stop)
        if side is not None:
            later = later[side[later] != side[i]]
        if len(later):
            later = later[forest.all()[later] != forest.find(i)]
        for lo in range(0, len(later), 256):  # in blocks, as wide signatures take room
            some = later[lo : lo + 256]
            some = some[forest.all()[some] != forest.find(i)]
            if not len(some):
                continue
            most = overlap_bound(n[some], n[i], np.bitwise_count(bits[some] ^ bits[i]).sum(axis=1, dtype=np.int64))
            for j in some[most >= needed(n[some], n[i], percent)].tolist():
                if forest.find(i) != forest.find(j) and common(sets[order[i]], sets[order[j]]) >= needed(n[i], n[j], percent):
                    forest.root[forest.find(j)] = forest.find(i)
                    out.append((int(order[i]), int(order[j])))
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct hashes."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def _node(hashes: np.ndarray) -> int | None:
    """64-bit identity of a shingle set; None for an empty one."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())))) if len(hashes) else None


def _blocks(batch, column: int):
    for lo, hi in chunks_by_bytes([len(x.as_py() or "") for x in batch.column(column)], BLOCK_BYTES):
        yield batch.slice(lo, hi - lo)


def _sketched(sketch: int | None):
    def run(batches):
        for batch in batches:
            for part in _blocks(batch, 2):
                sets = [shingle_set(t) for t in part.column(2).cast(pa.binary()).to_pylist()]
                prefix = [prefix_length(len(s)) if sketch is None else min(sketch, prefix_length(len(s))) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array([len(s) for s in sets], type=pa.int64()), pa.array([_node(s) for s in sets], type=pa.int64()),
                        pa.array([s[:k].view(np.int64) for s, k in zip(sets, prefix)], type=pa.list_(pa.int64())), pa.array([spare(len(s)) for s in sets], type=pa.int32()), pa.array([signature(s) for s in sets], type=pa.binary()),
                    ],
                    names=["doc", "hash", "n", "node", "tokens", "spare", "bits"],
                )

    return run


def _tiled(rows: DataFrame, keys: list[str], size: int, weights: int | None = None) -> DataFrame:
    """(node, tile, part, other): ``rows``, which have a node, dealt to tiles of about ``size`` rows, and of
    a sum of ``n`` of about ``weights`` if that is given.

    A group of ``keys`` with more rows is split into parts by a hash of the node, and each pair of
    parts is a tile; groups of one row need none, and of groups of the same nodes (by 128 bits of
    their hashes) one is dealt.
    """
    parts = F.ceil(F.count("*") / size)
    parts = parts if weights is None else F.greatest(parts, F.ceil(F.sum("n") / weights))
    held = F.struct(F.count("*").alias("n_rows"), *[F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"h{seed}") for seed in (1, 2)])
    counts = rows.groupBy(*keys).agg(parts.cast("int").alias("parts"), held.alias("held")).where("held.n_rows > 1")
    counts = counts.groupBy("held").agg(F.min(F.struct(*keys, "parts")).alias("first")).select("first.*")
    dealt = rows.join(counts, keys).withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select("node", F.xxhash64(*keys, F.least("part", "other"), F.greatest("part", "other")).alias("tile"), "part", "other")


def _edges_by_tile(work):
    """A mapInArrow function: the rows of a tile, which follow each other, go to ``work``."""

    def run(batches):
        rest, a, b = None, [], []

        def take(table):
            ids = table["node"].to_pylist()
            for i, j in work(table):
                a.append(ids[i])
                b.append(ids[j])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None or not len(rest) else pa.concat_tables([rest, table])
            tiles = rest["tile"].to_numpy()
            starts = np.flatnonzero(np.r_[True, tiles[1:] != tiles[:-1]]) if len(tiles) else []
            for x, y in zip(starts[:-1], starts[1:]):
                take(rest.slice(x, y - x))
            rest = rest.slice(starts[-1]) if len(starts) else rest
            yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])
            a.clear()
            b.clear()
        if rest is not None and len(rest):
            take(rest)
        yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])

    return run


def _sides(table):
    """None for a tile of one part, whose rows all meet; else the part of each row."""
    part, other = table["part"].to_numpy(), table["other"].to_numpy()
    return None if (part == other).all() else part


def _possible(table):
    bits = table["bits"].to_pylist()
    words = min(map(len, bits)) // 8
    bits = np.stack([_folded(b, words) for b in bits])
    return possible_pairs(table["n"].to_numpy(), bits, _sides(table))


def _linked(table):
    """Whole texts meet in a tile and are made to sets there."""
    sets = [shingle_set(t) for t in table["text"].cast(pa.binary()).to_pylist()]
    return linked_pairs(sets, _sides(table)) if sets else []


def _met(rows: DataFrame, work) -> DataFrame:
    return rows.repartition("tile").sortWithinPartitions("tile", "node").mapInArrow(_edges_by_tile(work), "a long, b long")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("hash"), text.alias("text"))


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sketch: int | None = SKETCH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, nodes, edges): (doc, hash, n, node) of every row, node being the identity of its shingle set
    (null without shingles) and hash that of its text; (node, doc, hash) of each node's first document,
    null ids last; and (a, b) of nodes, edges of a spanning forest of all links."""
    texts = _texts(docs, id_col, text_col)
    rows = cut(texts.mapInArrow(_sketched(sketch), "doc long, hash long, n long, node long, tokens array<long>, spare int, bits binary"), "sketches")
    first = F.min(F.struct(F.col("doc").isNull().alias("last"), "doc", "hash"))
    firsts = cut(rows.where("node is not null").groupBy("node").agg(first.alias("f")).select("node", "f.doc", "f.hash"), "first-texts")
    of = firsts.select(F.col("node").alias("of"), F.col("doc").alias("d"), F.col("hash").alias("h"))
    one = rows.join(of, (F.col("node") == F.col("of")) & F.col("doc").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h"))).select("node", "doc", "hash", "n", "tokens", "spare", "bits").dropDuplicates(["node"])
    one = cut(one, "sets-once")
    filed = one.select("node", F.expr(f"int(floor(ln(n) / ln({100 / PERCENT}) + 1e-9))").alias("home"), "spare", F.explode("tokens").alias("token"))
    shared = filed.groupBy("token").agg(F.count("*").alias("files")).where("files > 1")
    commonest = Window.partitionBy("node").orderBy(F.desc("files"), "token")
    filed = filed.join(shared, "token").withColumn("place", F.row_number().over(commonest)).where("place > spare")
    filed = cut(filed.withColumn("band", F.explode(F.array(F.col("home"), F.col("home") - 1))).select("node", "token", "band"), "files")
    tiles = _tiled(filed, ["token", "band"], TILE_ROWS).join(one.select("node", "n", "bits"), "node")
    groups = connected_components(cut(_met(tiles, _possible), "possible"))
    groups = cut(groups.join(one.select("node", "n", "doc", "hash"), "node"), "groups")
    # The texts of nodes with possible links, each once however often its row is repeated. Both sides grow
    # with the input, so they are merged at every size rather than broadcast while they are small.
    needed_texts = groups.select("node", F.col("doc").alias("d"), F.col("hash").alias("h"))
    found = texts.join(needed_texts.hint("merge"), F.col("doc").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h"))).select("node", "text").dropDuplicates(["node"])
    met = _tiled(groups, ["component"], SET_ROWS, SET_SHINGLES).join(cut(found, "texts-once").hint("merge"), "node")
    return rows.select("doc", "hash", "n", "node"), firsts, cut(_met(met, _linked), "edges")


def _grouped(rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, doc, hash): of each node the first document of its component, null ids last. Written, so
    that rows of a large group of copies are split among tasks where they are joined to it."""
    found = connected_components(edges).withColumnRenamed("node", "of")
    every = cut(nodes.join(found, F.col("node") == F.col("of"), "left").select("node", "doc", "hash", F.coalesce("component", "node").alias("group")), "grouped")
    first = F.min(F.struct(F.col("doc").isNull().alias("last"), "doc", "hash")).alias("f")
    least = cut(every.groupBy("group").agg(first, F.count("*").alias("n")).where("n > 1").select("group", "f"), "least")
    out = every.join(least, "group", "left")
    return cut(out.select(F.col("node").alias("of"), F.when(F.col("f").isNull(), F.col("doc")).otherwise(F.col("f.doc")).alias("first"), F.when(F.col("f").isNull(), F.col("hash")).otherwise(F.col("f.hash")).alias("first_hash")), "components")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sketch: int | None = SKETCH) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Shingles are of five words in A-Z lower case; two sets link when the intersection is at least
    80 % of the union. A null, empty or white text has no shingles and is its own component. Repeated
    rows get the same answer each, rows of one id with different texts each their own. A null id
    counts as larger than any other; a component of null ids alone has a null id. Other columns
    aren't read; an empty table gives an empty result. Very long texts are compared whole.
    """
    rows, nodes, edges = links(docs, id_col, text_col, sketch)
    some = rows.where("node is not null").join(_grouped(rows, nodes, edges), F.col("node") == F.col("of"))
    alone = rows.where("node is null").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("doc").alias("component_id"))
    return some.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("first").alias("component_id")).unionByName(alone)


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sketch: int | None = SKETCH) -> DataFrame:
    """The rows of ``docs`` that stay if one of each component does: that with the smallest id, null ids
    last; of several texts under that id the one with the smallest hash; of repeated rows one, whichever.

    Rows without words are linked with nothing and all stay. Every column is kept, whatever its name.
    """
    rows, nodes, edges = links(docs, id_col, text_col, sketch)
    first = _grouped(rows, nodes, edges).select(F.col("first").alias("doc"), F.col("first_hash").alias("hash")).distinct()
    times = rows.where("node is not null").groupBy("doc", "hash").agg(F.count("*").alias("times"))
    kept = first.join(times, first["doc"].eqNullSafe(times["doc"]) & (first["hash"] == times["hash"])).select(first["doc"].alias("d"), first["hash"].alias("h"), "times")
    kept = cut(kept, "kept")
    text = F.col(text_col).cast("string")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("hash"), F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded"))
    met = whole.where("worded").join(kept.hint("merge"), F.col("doc").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")))
    repeated = met.where("times > 1").groupBy("doc", "hash").agg(F.first("row").alias("row"))
    return whole.where("not worded").select("row").unionByName(met.where("times = 1").select("row")).unionByName(repeated.select("row")).select("row.*")


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all whole texts of ``documents``."""
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
