"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared exactly, tile against tile, by exclusive-or and bit
counts in numpy. Large tiles are dealt to tasks in pairs; inside a task, small
tiles hold fingerprints with the same numbers of set bits in each part of their
bits. Two fingerprints within ``radius`` bits differ by no more than ``radius``
over these counts together, so all other pairs of small tiles are skipped.
Equal fingerprints are one row before tiles are made.

The corpus stage takes what is found as candidates and checks them against their shingles.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from rewardmill.llm.common import map_batches, map_of, maybe_in, pieces, ship, stored, superseded
from rewardmill.llm.components import connected_components

#: Fingerprints that a task holds of either side.
TILE = 1 << 17
#: Size classes of sets: so many for a factor of e in size; sizes that allow a Jaccard similarity of 0.8 differ by a factor of 1.25 at most.
CLASSES_A_UNIT = 20
CLASSES_APART = 5
#: Units that small components are dealt to at least.
LEAST_UNITS = 64
#: Shingles (and 64 for each text) of either side that a task holds when it checks candidates.
BLOCK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str, size: int, seed: int) -> np.ndarray:
    """XXH64 of every ``size``-word shingle, repeats included; of the whole sequence if it is shorter."""
    words = _SPACE.split(text.encode("utf-8", "surrogatepass").translate(_LOWER).strip(b" \t\n\x0b\x0c\r"))
    if words == [b""]:
        return np.zeros(0, "u8")
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, seed)], "u8")
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist())], "u8")


def bits_of(hashes: np.ndarray) -> int:
    """The fingerprint as a number: a bit is set if over half of the hashes have it."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, "i8")
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].astype(">u8").view("u1").reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype="u2" if len(bits) < 1 << 16 else "i8")
    return int(np.packbits(counts * 2 > len(hashes)).view(">u8")[0])


def _mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Independent bits for one more word of a wide fingerprint, from the same hash (a 64-bit finaliser)."""
    if not lane:
        return hashes
    x = hashes + np.uint64((lane * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, size: int, lanes: int = 1, seed: int = 42, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``fp``, an array of ``lanes`` bigints (64 bits each), for every row of ``docs``.

    A null or blank text has a fingerprint of zeros. Rows stay where they are read.
    """
    kept = docs.select(*keep)
    schema = StructType([*kept.schema.fields, StructField("fp", ArrayType(LongType()))])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                out = []
                for text in part.column("text").to_pylist():
                    hashes = shingle_hashes(text or "", size, seed)
                    out.append([bits_of(_mixed(hashes, lane)) for lane in range(lanes)])
                words = np.array(out, "u8").view("i8").reshape(-1)
                offsets = np.arange(0, len(words) + 1, lanes, dtype="i4")
                prints = pa.ListArray.from_arrays(pa.array(offsets), pa.array(words))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], prints], [*keep, "fp"])

    return map_batches(docs.select(*keep, "text"), compute, schema)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold together what the given links do, at most one for each node."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    held = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[held], nodes[label[held]]


def near_pairs(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of x and j of y (both n by lanes) whose bits differ in at most ``radius`` places."""
    left, right = [], []
    first = min(2, x.shape[1])
    step = max(1, (1 << 19) // max(1, len(y)))
    columns = [np.ascontiguousarray(y[:, lane]) for lane in range(first)]
    for at in range(0, len(x), step):
        count = np.bitwise_count(x[at : at + step, 0, None] ^ columns[0])
        if first == 2:
            count += np.bitwise_count(x[at : at + step, 1, None] ^ columns[1])
        i, j = np.nonzero(count <= radius)
        if len(i) and x.shape[1] > first:
            whole = np.bitwise_count(x[at + i] ^ y[j]).sum(axis=1)
            i, j = i[whole <= radius], j[whole <= radius]
        left.append(i + at)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def tile_links(
    ids: np.ndarray, fps: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int, fields: int, width: int, sizes: np.ndarray | None = None
):
    """Links between the rows of two large tiles (``left`` and ``right``: their rows), as a forest.

    With ``sizes`` (of sets) a pair links only if they allow a Jaccard similarity of 0.8.

    Inside, rows lie in small tiles by the numbers of set bits in ``fields`` equal parts of
    their bits, in steps of ``width``; pairs of these whose counts differ by more than ``radius`` are skipped.
    """

    def small_tiles(rows: np.ndarray):
        per_byte = np.bitwise_count(fps[rows].astype(">u8").view("u1").reshape(len(rows), fields, -1))
        counts = per_byte.sum(axis=2, dtype="i4") // width
        cells, at = np.unique(counts, axis=0, return_inverse=True)
        order = np.argsort(at, kind="stable")
        ends = np.cumsum(np.bincount(at, minlength=len(cells)))
        return cells, rows[order], ends

    cells_x, rows_x, ends_x = small_tiles(left)
    cells_y, rows_y, ends_y = small_tiles(right)
    apart = np.abs(cells_x[:, None, :] - cells_y[None, :, :])
    gap = np.where(apart > 0, (apart - 1) * width + 1, 0).sum(axis=2)
    a, b = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
    for x, y in zip(*np.nonzero(gap <= radius)):
        some_x = rows_x[ends_x[x - 1] if x else 0 : ends_x[x]]
        some_y = rows_y[ends_y[y - 1] if y else 0 : ends_y[y]]
        i, j = near_pairs(fps[some_x], fps[some_y], radius)
        i, j = some_x[i], some_y[j]
        if sizes is not None:
            alike = _sizes_allow(sizes[i], sizes[j])
            i, j = i[alike], j[alike]
        i, j = ids[i], ids[j]
        a.append(i[i != j])
        b.append(j[i != j])
    return _forest(np.concatenate(a), np.concatenate(b))


def _sizes_allow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can have a Jaccard similarity of 0.8: no pair shares more than the smaller set."""
    small, large = np.minimum(a, b), np.maximum(a, b)
    return (small > 0) & (5 * small >= 4 * large)


def set_of(hashes: np.ndarray) -> np.ndarray:
    """The distinct shingles of a text, in order."""
    return np.unique(hashes)


def _set_prints(docs: DataFrame, size: int, lanes: int, keep: Sequence[str]) -> DataFrame:
    """As ``fingerprints``, with ``node``, a hash of the set of shingles, and ``shingles``, how many it has."""
    kept = docs.select(*keep)
    extra = [StructField("fp", ArrayType(LongType())), StructField("node", LongType()), StructField("shingles", LongType())]
    schema = StructType([*kept.schema.fields, *extra])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                out, nodes, counts = [], [], []
                for text in part.column("text").to_pylist():
                    hashes = shingle_hashes(text or "", size, 42)
                    distinct = set_of(hashes)
                    out.append([bits_of(_mixed(hashes, lane)) for lane in range(lanes)])
                    nodes.append(xxhash.xxh64_intdigest(distinct.tobytes()))
                    counts.append(len(distinct))
                words = np.array(out, "u8").view("i8").reshape(-1)
                offsets = np.arange(0, len(words) + 1, lanes, dtype="i4")
                made = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(words)), pa.array(np.array(nodes, "u8").view("i8")), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *made], [*keep, "fp", "node", "shingles"])

    return map_batches(docs.select(*keep, "text"), compute, schema)


def _with_sets(texts: DataFrame, size: int, keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` and ``set``, the distinct shingles as bytes of eight each."""
    schema = StructType([*texts.select(*keep).schema.fields, StructField("set", BinaryType())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                sets = [set_of(shingle_hashes(t or "", size, 42)).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(sets, pa.binary())], [*keep, "set"])

    return map_batches(texts.select(*keep, "text"), compute, schema)


def similar_links(
    ids: np.ndarray, fps: np.ndarray, sets: Sequence[bytes], left: np.ndarray, right: np.ndarray, radius: int
) -> tuple[np.ndarray, np.ndarray]:
    """Links between ``left`` and ``right`` (rows) within ``radius`` bits and with a Jaccard similarity of 0.8, as a forest.

    A pair that checked links already join is not checked again.
    """
    order = np.unique(np.concatenate([left, right]))
    counts = np.array([len(sets[n]) // 8 for n in order], "i8")
    ends = np.cumsum(counts)
    distinct, flat = np.unique(np.frombuffer(b"".join(sets[n] for n in order), "u8"), return_inverse=True)
    mark = np.zeros(len(distinct), bool)
    fps, left, right = fps[order], np.searchsorted(order, left), np.searchsorted(order, right)
    same = np.array_equal(left, right)
    label = np.arange(len(order))
    a, b = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
    for i in left.tolist():
        others = right[right > i] if same else right
        small, large = np.minimum(counts[others], counts[i]), np.maximum(counts[others], counts[i])
        # No pair can share more than the smaller set.
        others = others[(label[others] != label[i]) & (small > 0) & (5 * small >= 4 * large)]
        others = others[np.bitwise_count(fps[others] ^ fps[i]).sum(axis=1) <= radius] if len(others) else others
        if not len(others):
            continue
        mine = flat[ends[i] - counts[i] : ends[i]]
        mark[mine] = True
        for at in range(0, len(others), 256):
            some = others[at : at + 256]
            some = some[label[some] != label[i]]
            if not len(some):
                continue
            held = counts[some]
            starts = np.cumsum(held) - held
            places = np.repeat(ends[some] - held - starts, held) + np.arange(held.sum())
            shared = np.add.reduceat(mark[flat[places]], starts, dtype="i8")
            linked = some[5 * shared >= 4 * (held + counts[i] - shared)]
            if len(linked):
                a.append(np.full(len(linked), ids[order[i]]))
                b.append(ids[order[linked]])
                joined = np.unique(np.append(label[linked], label[i]))
                label[np.isin(label, joined)] = joined[0]
        mark[mine] = False
    return _forest(np.concatenate(a), np.concatenate(b))


def _size_class(size: Column) -> Column:
    """Sets whose sizes allow a Jaccard similarity of 0.8 are at most ``CLASSES_APART`` classes apart."""
    return F.floor(F.log(F.greatest(size, F.lit(1))) * CLASSES_A_UNIT).cast("int")


def _checked(candidates: DataFrame, radius: int, block: int) -> DataFrame:
    """Links (a, b) among ``candidates`` (node, root, fp, set, shingles) that hold against their sets, inside each root.

    A root with more than ``block`` shingles is cut into blocks along the sizes of its sets, and only pairs of blocks whose sizes allow a
    link are formed, each in one task; small roots share tasks. Each pair of blocks gives a forest.
    """
    weight = F.sum(F.col("shingles") + 64)
    sized = candidates.withColumn("class", _size_class(F.col("shingles")))
    classes = stored(sized.groupBy("root", "class").agg(weight.alias("weight")), "classes")
    roots = classes.groupBy("root").agg(F.sum("weight").alias("whole"))
    large = classes.join(roots.filter(F.col("whole") > block), "root")
    blocks = large.select("root", "class", F.ceil(F.col("weight") / block).cast("int").alias("blocks"))
    others = blocks.select("root", F.col("class").alias("other_class"), F.col("blocks").alias("other_blocks"))
    partners = blocks.join(others, "root").filter(F.abs(F.col("class") - F.col("other_class")) <= CLASSES_APART)
    total = roots.filter(F.col("whole") <= block).agg(F.sum("whole")).head()[0] or 0
    units = max(LEAST_UNITS, -(-total // block))
    columns = ["node", "root", "fp", "set", "shingles"]
    mine = F.struct("class", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    split = sized.join(partners, ["root", "class"]).select(*columns, mine.alias("tile"), "other_class", "other_blocks")
    split = split.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
    other = F.struct(F.col("other_class").alias("class"), "block")
    whole = F.struct(F.lit(0).alias("class"), F.lit(0).alias("block"))
    sent = split.select(*columns, F.lit(True).alias("large"), F.col("root").alias("unit"), "tile", other.alias("other"))
    small = sized.join(roots.filter(F.col("whole") > block).select("root"), "root", "left_anti")
    sent = sent.unionByName(
        small.select(*columns, F.lit(False).alias("large"), F.pmod(F.xxhash64("root"), F.lit(units)).alias("unit"), whole.alias("tile"), whole.alias("other"))
    )

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        low, high = key[2].as_py(), key[3].as_py()
        ids, roots = rows.column("node").to_numpy(), rows.column("root").to_numpy()
        flat = pa.concat_arrays([c.flatten() for c in rows.column("fp").chunks]).to_numpy()
        fps = flat.view("u8").reshape(len(ids), -1)
        tile_of = np.array([t == high for t in rows.column("tile").to_pylist()])
        sets = rows.column("set").to_pylist()
        order = np.argsort(roots, kind="stable")
        out = []
        for of_root in np.split(order, np.flatnonzero(np.diff(roots[order])) + 1):
            left, right = of_root[~tile_of[of_root] | (low == high)], of_root[tile_of[of_root]]
            if len(left) and len(right):
                out.append(similar_links(ids, fps, sets, left, right, radius))
        a, b = (np.concatenate([np.zeros(0, "i8"), *[x[side] for x in out]]) for side in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    ship(candidates.sparkSession)
    pair = [F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high")]
    return sent.groupBy("large", "unit", *pair).applyInArrow(compare, "a long, b long")


def one_of_each_group(docs: DataFrame, size: int = 5, lanes: int = 4, radius: int = 51, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the smallest doc_id, then text hash.

    Two texts are alike if the Jaccard similarity of their sets of ``size``-word shingles is at least 0.8. Fingerprints only
    find the candidates: pairs with at most ``radius`` of 256 differing bits whose numbers of shingles allow that similarity. A group is
    whatever checked links hold together. Null and blank texts are alike. Of repeated rows with one id and text one stays. Columns of any
    name are returned as they are.

    Texts with one set of shingles are one node. Candidate pairs are first joined to components; only the nodes of these
    have their sets formed (of one text each) and compared, block by block. A membership map of fixed size keeps the texts of
    other documents, and the rows that no group touches, out of the two shuffles of wide rows.
    """
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.xxhash64("text").alias("digest"), F.col("text").alias("text"),
    ).withColumn("hash", F.xxhash64("id", "digest"))
    prints = stored(_set_prints(rows, size, lanes, keep=("doc_id", "id", "digest", "hash")), "simhash")
    first = F.min(F.struct("doc_id", "digest", "id", "hash")).alias("w")
    nodes = stored(prints.groupBy("node").agg(first, F.count(F.lit(1)).alias("n"), F.first("fp").alias("fp"), F.first("shingles").alias("shingles")), "fingerprints")
    classed = nodes.select("node", "fp", "shingles", _size_class(F.col("shingles")).alias("class"))
    found = connected_components(near_links(classed, radius, lambda a, b: abs(a - b) <= CLASSES_APART, fields=1, width=26))
    wanted = stored(nodes.join(found, "node").select("node", "root", "fp", "shingles", "w.id", "w.digest", "w.hash"), "candidates")
    possible, _ = maybe_in(rows.select("id", "digest", "hash", "text"), F.col("hash"), map_of(wanted, "hash"))
    texts = possible.join(wanted.drop("hash"), ["id", "digest"]).dropDuplicates(["id", "digest"])
    sets = stored(_with_sets(texts, size, keep=("node", "root", "fp", "shingles")), "sets")
    links = _checked(sets, radius, block)
    roots = connected_components(links)
    superseded(found, wanted, sets)
    labelled = nodes.select("node", "w", "n").join(roots, "node", "left")
    # Rows of groups, and rows that share a node: of these one stays. All others stay without a look.
    contested = labelled.filter("root IS NOT NULL OR n > 1").withColumn("root", F.coalesce("root", "node"))
    winners = contested.groupBy("root").agg(F.min("w").alias("w")).select("w.id", "w.digest")
    keys = stored(prints.select("node", "id", "digest", "hash").join(contested.select("node"), "node").select("id", "digest", "hash").distinct(), "contested")
    winners = stored(winners, "winners")
    superseded(prints, nodes, roots)
    possible, apart = maybe_in(rows.drop("text"), F.col("hash"), map_of(keys, "hash"))
    losers = keys.select("id", "digest").join(winners, ["id", "digest"], "left_anti")
    remaining = possible.join(losers, ["id", "digest"], "left_anti").dropDuplicates(["id", "digest"])
    return apart.select("row.*").unionByName(remaining.select("row.*"))


def near_links(
    nodes: DataFrame, radius: int, together: Callable[[int, int], bool], fields: int, width: int, tile: int = TILE, least_tiles: int = 8
) -> DataFrame:
    """Links (a, b) that join all rows of ``nodes`` (node bigint, fp array<bigint>, class int) within ``radius`` bits.

    Every row is compared with every other, tile against tile, unless their classes rule it out: ``together`` says
    which can hold a link. Tiles are cut along the classes (few: they are counted in the driver), a large class into
    several by hash, and only pairs of tiles that can hold a link are formed. Nodes are distinct. Each pair of tiles
    gives a forest, not all its links: components stay the same, and a dense group of m rows gives m links, not m squared.
    With a column ``shingles`` a pair links only if these set sizes allow a Jaccard similarity of 0.8.
    """
    counts = [tuple(r) for r in nodes.groupBy("class").count().orderBy("class").collect()]
    room = min(tile, max(1, -(-sum(n for _, n in counts) // least_tiles)))
    groups: list[list] = []
    for value, n in counts:
        if groups and groups[-1][1] + n <= room:
            groups[-1][0].append(value)
            groups[-1][1] += n
        else:
            groups.append([[value], n])
    parts = [-(-n // room) for _, n in groups]
    meet = [
        (value, g, parts[g], h, parts[h])
        for g, (values, _) in enumerate(groups)
        for h, (others, _) in enumerate(groups)
        if any(together(v, o) for v in values for o in others)
        for value in values
    ]
    spark = nodes.sparkSession
    meeting = spark.createDataFrame(meet, "class int, g int, parts int, h int, other_parts int")
    more = [c for c in ("shingles",) if c in nodes.columns]
    sent = nodes.join(F.broadcast(meeting), "class").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)))
    mine = F.struct(F.col("g").alias("group"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    sent = sent.select("node", "fp", *more, mine.alias("tile"), F.struct(F.col("h").alias("group"), F.col("part").alias("part")).alias("other"))
    pair = [F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high")]
    sent = sent.select("node", "fp", *more, *pair, (F.col("tile") == F.greatest("tile", "other")).alias("is_high"))

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        ids = rows.column("node").to_numpy()
        flat = pa.concat_arrays([c.flatten() for c in rows.column("fp").chunks]).to_numpy()
        fps = flat.view("u8").reshape(len(ids), -1)
        high = rows.column("is_high").to_numpy()
        left, right = np.flatnonzero(~high | (key[0] == key[1])), np.flatnonzero(high)
        sizes = rows.column("shingles").to_numpy() if more else None
        a, b = tile_links(ids, fps, left, right, radius, fields, width, sizes) if len(left) and len(right) else (ids[:0], ids[:0])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    ship(spark)
    return sent.groupBy("low", "high").applyInArrow(compare, "a long, b long")


def near_duplicate_groups(prints: DataFrame, radius: int, fields: int = 2, width: int = 1) -> DataFrame:
    """``prints`` (doc_id, fp, ...) with ``component_id``: the smallest doc_id reachable by links of at most ``radius`` bits.

    Every row comes back, repeated rows and null ids too; a component of null ids only has a null id.
    ``root`` names a component also then. Columns of these two names are replaced.
    ``prints`` is read several times: store it first.
    """
    node = F.when(F.size("fp") == 1, F.element_at("fp", 1)).otherwise(F.xxhash64("fp"))
    rows = prints.drop("component_id", "root").withColumn("node", node)
    nodes = stored(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp")), "fingerprints")
    # Set bits of both halves of the fingerprint's first word: two near ones differ by no more than the radius over both.
    word = F.element_at("fp", 1)
    bits = F.bit_count(F.shiftrightunsigned(word, 32)) * 64 + F.bit_count(word.bitwiseAND(F.lit(0xFFFFFFFF)))
    classed = nodes.select("node", "fp", bits.cast("int").alias("class"))
    roots = connected_components(near_links(classed, radius, lambda a, b: abs(a // 64 - b // 64) + abs(a % 64 - b % 64) <= radius, fields, width))
    labelled = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = labelled.join(least, "root").select("node", "root", "component_id")
    return rows.join(of_node, "node").drop("node")
