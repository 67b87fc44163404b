"""Exact Jaccard join of word n-gram sets, and its components.

The document by n-gram incidence matrix is multiplied with its transpose in
blocks (``products``): a cell holds the rows of two tiles of bounded size,
overlap counts accumulate over the cell's common columns, and pairs below the
bound that follows from the two sizes are discarded in the task. What decides
which cells are multiplied, so that no link is lost and not all pairs are made:

* Equal sets are one row (a node). Columns that no other row has can't overlap;
  a row with too few others for its size is discarded (``_able``).
* Column blocks: two sets of at most r elements that reach the similarity differ
  in at most k(r) elements, so of k(r) + 1 column blocks they agree on one
  entirely. Size classes grow by the similarity's ratio, a set takes part in its
  own and the next one, and rows that agree on too few blocks are discarded.
* Every row is multiplied with its pivot, the row of most shared blocks that it
  agrees with most; linked rows form components. That leaves rows of different
  components. Those of one pivot's family are multiplied tile by tile, but for
  tiles of one component and of sizes too far apart; those of different families
  meet through their rarest columns, of which two linked rows share one.

Hot keys: exact copies are reduced to one row a task and key before any
exchange; joins on a node, block, pivot or component deal the rows of hot ones
over many tasks (``spread_join``); a column of many rows is paired tile by tile.
Exchanges of elements and block keys run in ``SLICES`` of the hash space, one
after another, so that their shuffle files never lie on disk together.

Shingles and sets are told apart by 64-bit hashes; of n different sets about
n**2 / 2**65 pairs are expected to be taken for equal. Edge cases: a null text
counts as empty; documents without words have no shingles and link with nothing;
with fewer words than a shingle the whole sequence is one; rows without id take
no part and have no component; rows that share an id are one document, linked
with all that any of them links with, and each is returned with its own size;
an empty table gives no rows; other columns, whatever their names, are ignored;
a very long text is one row, and a tile has one row at least.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollsift.llm.common import chunks, discard, give_back, materialise, spread_join, whole_text
from rollsift.llm.graphs import components
from rollsift.llm.words import mix, words_of

#: Elements and rows of the sets of a tile at most, as dealt by hash; a cell multiplies two tiles.
TILE_ELEMENTS, TILE_ROWS = 200_000, 96
#: Elements of a tile that is multiplied with one row only: its work is linear, so small tiles cost little.
STAR_ELEMENTS = 10_000
#: Parts of the hash space that are exchanged one after another.
SLICES = 4
#: Columns of more rows than this are paired in tiles of as many.
COLUMN_ROWS = 512
#: Columns of more rows than this are multiplied as a dense matrix.
DENSE_ROWS = 48
NEVER = 1 << 30
_PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_SET_SALTS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344], np.uint64)


def shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts (repeats included) and where each text's begin and end."""
    w = words_of(column)
    n = len(w.hash)
    total = np.zeros(n, np.uint64)
    for j in range(words):
        total[: n - j] += w.hash[j:] * _PLACES[j] if n > j else 0
    last = np.cumsum(w.counts)
    whole = np.arange(n) + words <= np.repeat(last, w.counts)
    hashed, doc = mix(total[whole]), w.doc[whole]
    short = np.flatnonzero((w.counts > 0) & (w.counts < words))
    if len(short):
        own = []
        for d in short:
            h = w.hash[last[d] - w.counts[d] : last[d]]
            own.append((h * _PLACES[: len(h)]).sum(dtype=np.uint64) + np.uint64(len(h)))
        hashed, doc = np.concatenate([hashed, mix(np.array(own, np.uint64) ^ _SET_SALTS[0])]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        hashed, doc = hashed[order], doc[order]
    return hashed, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(w.counts)))])


@lru_cache(maxsize=8)
def _classes(percent: int, reach: int) -> tuple[list[int], list[int]]:
    """Largest sizes of the classes that cover sizes up to ``reach`` and one more, and their column blocks (0: none)."""
    largest, blocks, first = [], [], 1
    while not largest or largest[-2 if len(largest) > 1 else 0] < reach or len(largest) < 2:
        r = first * 100 // percent
        differ = 2 * r * (100 - percent) // (100 + percent)
        largest.append(r)
        blocks.append(differ + 1 + 1 + differ // 50 if differ else 0)
        first = r + 1
    return largest, blocks


def differing(a: int, b: int, percent: int) -> int:
    """Elements in which two linked sets of these sizes differ at most."""
    return (100 - percent) * (a + b) // (100 + percent)


def block_keys(elements: np.ndarray, percent: int) -> tuple[np.ndarray, int, tuple[int, int, int, int]]:
    """A hash for each column block's content in the set's size class and the next, of 48 bits: the last is the
    class's parity. Then the own class, and how many keys a linked set must share: of the own class if it
    is of the class before, of the own and of the next if it is of the same class, of the next if it is of the next.

    elements: the set, sorted. Blocks are ranges of hashes, so that each is a run of elements.
    Empty blocks have a key only where the others are too few to be sure of an agreement."""
    n = len(elements)
    largest, blocks = _classes(percent, 1 << (n - 1).bit_length() if n > 1 else 1)
    own = int(np.searchsorted(largest, n))
    weights = mix(elements ^ _SET_SALTS[1])
    out, sure = [], {}
    for c in (own, own + 1):
        m = blocks[c]
        if not m:
            continue  # only equal sets can link
        block = ((elements >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        filled = block[first]
        sums = np.add.reduceat(weights, first)
        sure[c] = len(first)
        if len(first) <= differing(largest[c], largest[c], percent):
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), filled)
            filled, sums = np.concatenate([filled, empty]), np.concatenate([sums, np.zeros(len(empty), np.uint64)])
            sure[c] = 0
        key = mix(sums + (filled + np.uint64(1)) * _PLACES[7] + np.full(len(filled), c + 1, np.uint64) * _PLACES[11])
        out.append(((key >> np.uint64(17)) << np.uint64(1)) | np.uint64(c & 1))
    before = largest[own - 1] if own else 0
    same, after = differing(n, largest[own], percent), min(differing(n, largest[own + 1], percent), (100 - percent) * n // percent)
    wanted = lambda c, most: max(1, sure[c] - most) if c in sure else NEVER
    needs = wanted(own, differing(n, before, percent)), wanted(own, same), wanted(own + 1, same), wanted(own + 1, after)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), own, needs


def set_hash(elements: np.ndarray) -> np.uint64:
    return mix(np.array([mix(elements ^ _SET_SALTS[0]).sum(dtype=np.uint64) + np.uint64(len(elements))], np.uint64))[0]


NEEDS = ["need_before", "need_same", "need_same_next", "need_after"]
KEYS, SETS = [f"keys{k}" for k in range(SLICES)], [f"set{k}" for k in range(SLICES)]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))


def described(df: DataFrame, words: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """id, size of the set, its hash (node), and its block keys by slice.

    A set that the task has met has its keys already: copies give none."""
    picked = df.select(F.col(doc_id).cast("long").alias("id"), whole_text(text).alias("_text"))
    names = ["id", "n", "node", *KEYS, "class", *NEEDS]
    none = np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for b in chunks(batches, "_text"):
            hashed, bounds = shingles(b.column("_text"), words)
            known = b.column("id").is_valid().to_pylist()
            sizes, nodes, keys, own, needs = [], [], [], [], []
            for s, e, has_id in zip(bounds[:-1].tolist(), bounds[1:].tolist(), known, strict=True):
                u = np.unique(hashed[s:e])
                node = int(set_hash(u))
                k, c, need = none, 0, (NEVER,) * 4
                if len(u) and has_id and node not in met:
                    met.add(node)
                    k, c, need = block_keys(u, percent)
                sizes.append(len(u))
                nodes.append(node)
                keys.append(k)
                own.append(c)
                needs.append(need)
            slice_of = [(k >> np.uint64(1)) % np.uint64(SLICES) for k in keys]
            lists = [_lists([k[at == j] for k, at in zip(keys, slice_of, strict=True)]) for j in range(SLICES)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.array(sizes, np.int64)), pa.array(np.array(nodes, np.uint64).view(np.int64)), *lists, pa.array(own, pa.int32()), *[pa.array(x, pa.int32()) for x in zip(*needs, strict=True)]], names)

    schema = "id long, n long, node long, " + ", ".join(f"{k} array<long>" for k in KEYS) + ", class int, " + ", ".join(f"{x} int" for x in NEEDS)
    return picked.mapInArrow(run, schema)


def sets_of(df: DataFrame, words: int, text: str, node: str) -> DataFrame:
    """node and the set of shingle hashes by slice, of the rows whose set is the node's; repeated rows of a task once."""
    picked = df.select(F.col(node).alias("node"), whole_text(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in chunks(batches, "_text"):
            hashed, bounds = shingles(b.column("_text"), words)
            nodes, sets = [], []
            for wanted, s, e in zip(b.column("node").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                u = np.unique(hashed[s:e])
                if wanted not in seen and int(set_hash(u).view(np.int64)) == wanted:
                    seen.add(wanted)
                    nodes.append(wanted)
                    sets.append(u)
            if nodes:
                slice_of = [u % np.uint64(SLICES) for u in sets]
                lists = [_lists([u[at == j] for u, at in zip(sets, slice_of, strict=True)]) for j in range(SLICES)]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), *lists], ["node", *SETS])

    return picked.mapInArrow(run, "node long, " + ", ".join(f"{x} array<long>" for x in SETS))


def overlap_matrix(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Common elements of every row set and column set: the product of two sparse incidence matrices.

    Elements of many sets are multiplied as dense columns, the others as outer products of their lists."""
    flat = lambda sets: (np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
    (a, a_row), (b, b_row) = flat(rows), flat(columns)
    both = np.intersect1d(a, b)
    place = lambda x: np.searchsorted(both, x)

    def known(x: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = place(x)
        hit = at < len(both)
        hit[hit] = both[at[hit]] == x[hit]
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], row[hit][order]

    out = np.zeros((len(rows), len(columns)), np.int32)
    if not len(both):
        return out
    a, a_row = known(a, a_row)
    b, b_row = known(b, b_row)
    a_n, b_n = np.bincount(a, minlength=len(both)), np.bincount(b, minlength=len(both))
    dense = np.flatnonzero(a_n * b_n > DENSE_ROWS * DENSE_ROWS)
    for i in range(0, len(dense), 2048):
        part = dense[i : i + 2048]
        x, y = np.zeros((len(rows), len(part)), np.float32), np.zeros((len(columns), len(part)), np.float32)
        for m, e, r in ((x, a, a_row), (y, b, b_row)):
            at = np.searchsorted(part, e)
            hit = at < len(part)
            hit[hit] = part[at[hit]] == e[hit]
            m[r[hit], at[hit]] = 1
        out += (x @ y.T).astype(np.int32)
    a_first, b_first = np.cumsum(a_n) - a_n, np.cumsum(b_n) - b_n
    sparse = np.flatnonzero((a_n * b_n > 0) & (a_n * b_n <= DENSE_ROWS * DENSE_ROWS))
    work = np.cumsum(a_n[sparse] * b_n[sparse])
    for part in np.split(sparse, np.searchsorted(work, np.arange(4_000_000, int(work[-1]) if len(work) else 0, 4_000_000))):
        pairs = a_n[part] * b_n[part]
        which = np.repeat(np.arange(len(part)), pairs)
        k = np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        r = a_row[a_first[part][which] + k // b_n[part][which]]
        c = b_row[b_first[part][which] + k % b_n[part][which]]
        out += np.bincount(r * len(columns) + c, minlength=out.size).reshape(out.shape).astype(np.int32)
    return out


def spanning(links: np.ndarray) -> np.ndarray:
    """Enough of the links (a, b) to connect what they all connect."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    keep = []
    for i, (a, b) in enumerate(links.tolist()):
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
            keep.append(i)
    return links[keep]


def tiles(amount: Column, size: int) -> Column:
    return F.greatest(F.ceil(amount / size).cast("int"), F.lit(1))


def _stars(sets: list[np.ndarray], cell: np.ndarray, center: np.ndarray) -> np.ndarray:
    """Overlap of each row with the one center row of its cell: a block-diagonal product of all cells at once.

    A column is the element mixed with its cell, so that blocks share none."""
    size = np.array([len(x) for x in sets])
    column = mix(np.concatenate(sets) + np.repeat(cell, size).astype(np.uint64) * _PLACES[3])
    of_center, row = np.repeat(center, size), np.repeat(np.arange(len(sets)), size)
    known, asked = np.sort(column[of_center]), column[~of_center]
    hit = np.zeros(len(asked), bool)
    if len(known):
        at = np.searchsorted(known, asked)
        hit = known[np.minimum(at, len(known) - 1)] == asked
    return np.bincount(row[~of_center][hit], minlength=len(sets))


def _multiply(block: dict[str, np.ndarray], sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Links between the components of whole cells' rows, (a, b)."""
    starts = np.flatnonzero(np.concatenate([[True], np.any([block[c][1:] != block[c][:-1] for c in CELL], axis=0)]))
    cell = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(sets))))
    size = np.array([len(x) for x in sets])
    left, right = block["tile"] == block["first"], block["tile"] == block["second"]
    component, found = block["component"], [np.zeros((0, 2), np.int64)]
    star = block["first"] == CENTER
    if star.any():
        at = np.flatnonzero(star)
        both = _stars([sets[i] for i in at], cell[at], left[at])
        centers = np.full(len(starts), -1)
        centers[cell[at[left[at]]]] = at[left[at]]
        c = centers[cell[at]]
        hit = (c >= 0) & ~left[at] & (100 * both >= percent * (size[c] + size[at] - both)) & (both > 0) & (component[c] != component[at])
        found.append(np.stack([component[c[hit]], component[at[hit]]], 1))
    for k in np.unique(cell[~star]):
        rows = np.arange(starts[k], starts[k + 1] if k + 1 < len(starts) else len(sets))
        a, b = rows[left[rows]], rows[right[rows]]
        if not len(a) or not len(b):
            continue
        both = overlap_matrix([sets[i] for i in a], [sets[i] for i in b])
        total = size[a][:, None] + size[b][None, :]
        hit = (100 * both >= percent * (total - both)) & (component[a][:, None] != component[b][None, :])
        i, j = np.nonzero(hit)
        found.append(spanning(np.stack([component[a[i]], component[b[j]]], 1)))
    return spanning(np.concatenate(found))


CELL = ["block", "first", "second"]
#: The tile of a cell's one center row.
CENTER = -1


def products(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components, from the blocked product.

    cells: block, first, second (the tiles that the cell multiplies), node, tile (one of the two), component. A cell
    whose first tile is ``CENTER`` has one row there. Small cells are multiplied together, as a block-diagonal
    matrix; a cell's rows never leave its task as pairs, only as many links as connect what all connect."""
    names = [*CELL, "tile", "node", "component"]
    rows = cells.select(*names).hint("shuffle_hash").join(sets.select("node", F.concat(*SETS).alias("set")), "node").select(*names, "set")
    rows = rows.repartition(*CELL).sortWithinPartitions(*CELL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_cells(batches):
            block = {c: part.column(c).to_numpy() for c in names}
            lists = part.column("set").combine_chunks()
            flat, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            links = _multiply(block, [flat[s:e] for s, e in zip(offsets[:-1], offsets[1:], strict=True)], percent)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])
        give_back()

    return rows.mapInArrow(run, "a long, b long").distinct()


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of whole cells that follow each other, of about a tile's elements unless one cell has more."""
    kept: list[pa.Table] = []
    held = 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        keys = np.stack([table.column(c).to_numpy() for c in CELL])
        starts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        if kept:
            last = kept[-1]
            if any(last.column(c)[-1].as_py() != keys[i, 0] for i, c in enumerate(CELL)):
                starts = np.concatenate([[0], starts])
        sizes = pa.compute.list_value_length(table.column("set")).to_numpy()
        before = np.concatenate([[0], np.cumsum(sizes)])
        at = 0
        for cut in starts.tolist():
            if held + before[cut] - before[at] >= TILE_ELEMENTS:
                kept.append(table.slice(at, cut - at))
                yield pa.concat_tables(kept).combine_chunks()
                kept, held, at = [], 0, cut
        kept.append(table.slice(at))
        held += int(before[-1] - before[at])
    if kept:
        yield pa.concat_tables(kept).combine_chunks()


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (the smallest id reachable by links).

    Nodes are sets, by their hash; copies of a set are rows of one node. Scratch tables go but for the small
    ones that the returned frame reads (ids with their sets' hashes, and a row a node)."""
    spark = df.sparkSession
    keyed, keyed_path = materialise(described(df, words, percent, doc_id, text), "sets", "zstd")
    docs, _ = materialise(keyed.select("id", "n", "node"), "documents")
    filled = docs.where("n > 0 and id is not null")
    nodes, _ = materialise(filled.groupBy("node").agg(F.min("id").alias("rep"), F.first("n").alias("n")), "nodes")
    members, member_paths = _members(keyed)
    agreeing, agreeing_path = materialise(_agreeing(members, keyed), "agreeing")
    discard(spark, keyed_path)
    # whole texts move once, at every size: a document for each node that can link as far as keys tell
    asked = nodes.join(agreeing.select("node"), "node").select(F.col("rep").alias("_rep"), F.col("node").alias("_node")).hint("shuffle_hash")
    texts = df.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_whole")).join(asked, F.col("_id") == F.col("_rep"))
    sets, sets_path = materialise(sets_of(texts, words, "_whole", "_node"), "element-sets")
    alone, alone_paths = _alone(sets)
    able, able_path = materialise(_able(alone, agreeing, percent), "able-nodes")
    all_sets_path, (sets, set_paths) = sets_path, _sets_of(sets, able)
    discard(spark, all_sets_path, *alone_paths)
    able_members, able_members_path = materialise(members.join(able, "node"), "able-members")
    discard(spark, agreeing_path, *member_paths)
    pivots, pivots_path = materialise(_pivots(able_members, percent), "pivots")
    links, links_path = materialise(products(_star_cells(pivots), sets, percent).unionByName(_same_ids(filled)), "links")
    labels = components(links)
    discard(spark, links_path)
    named, named_path = materialise(_named(able_members, labels), "named-members")
    left, left_path = materialise(_open_nodes(named, pivots), "open-nodes")
    discard(spark, able_members_path, able_path, pivots_path, named_path)
    inside, inside_path = materialise(products(_family_cells(left, percent), sets, percent), "links")
    crossing, rare_path = _crossing_pairs(left, sets, percent)
    crossing, crossing_path = materialise(crossing, "crossing-pairs")
    discard(spark, rare_path)
    across, across_path = materialise(products(_pair_cells(crossing), sets, percent), "links")
    more = inside.unionByName(across)
    if not more.isEmpty():
        joined = components(more).select(F.col("id").alias("component"), F.col("component").alias("_over"))
        labels = spread_join(labels.unionByName(_lone(more, labels)), joined, "component", "id", "left").select("id", F.coalesce("_over", "component").alias("component"))
    named = nodes.join(labels.withColumnRenamed("id", "node"), "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    named, named_path = materialise(named, "named-nodes")
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    of_node, _ = materialise(spread_join(named, least, "component", "node").select("node", "least"), "least-ids")
    discard(spark, *set_paths, left_path, inside_path, crossing_path, across_path, named_path)
    out = spread_join(docs, of_node, "node", "id", "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")))
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return _without_words(out, docs)


def _without_words(out: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows without words that share their id with rows that have some get the component of those."""
    empty = docs.where("n = 0 and id is not null").select("id").distinct()
    both = docs.where("n > 0").join(empty, "id", "left_semi").select("id").distinct()
    if both.isEmpty():
        return out
    known = out.where("n_shingles > 0").join(both.withColumnRenamed("id", "doc_id"), "doc_id").groupBy(F.col("doc_id").alias("_id")).agg(F.min("component_id").alias("_least"))
    return out.join(known, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "n_shingles", F.coalesce(F.when(F.col("n_shingles") == 0, F.col("_least")), F.col("component_id")).alias("component_id"))


def _lone(more: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, component) of the components of one node that the links name and the labels don't."""
    named = more.select(F.col("a").alias("id")).unionByName(more.select(F.col("b").alias("id"))).distinct()
    return named.join(labels.select("id"), "id", "left_anti").select("id", F.col("id").alias("component"))


def _same_ids(filled: DataFrame) -> DataFrame:
    """Links between the nodes of an id that several rows share."""
    several = filled.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("id", "a")
    return filled.join(several, "id").where("a <> node").select("a", F.col("node").alias("b")).distinct()


def _members(keyed: DataFrame) -> tuple[DataFrame, list[str]]:
    """(key, node, rows) of the keys that two nodes share at least, and the tables' paths; slice by slice."""
    spark, parts, paths = keyed.sparkSession, [], []
    for column in KEYS:
        keys = keyed.select("node", F.explode(column).alias("key"))
        counted = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("rows"))
        shared, shared_path = materialise(counted.where("lo < hi").select("key", "rows"), "shared-keys")
        rows = keyed.agg(F.sum(F.size(column))).first()[0] or 0
        # a key that very many rows have is dealt over many tasks by their nodes
        part, path = materialise(spread_join(keys, shared.select("key", "rows"), "key", "node", sizes=shared.withColumnRenamed("rows", "n"), rows=rows).distinct(), "members")
        discard(spark, shared_path)
        parts.append(part)
        paths.append(path)
    return reduce(DataFrame.unionByName, parts), paths


def _agreeing(members: DataFrame, keyed: DataFrame) -> DataFrame:
    """(node, n, class, reach) of the nodes that share as many keys as a link asks for; reach: how often theirs are shared."""
    odd = F.col("key").bitwiseAND(F.lit(1))
    shared = members.groupBy("node").agg(F.sum(odd).alias("odd"), F.sum(1 - odd).alias("even"), F.sum("rows").alias("reach"))
    facts = keyed.where(f"need_same < {NEVER} or need_before < {NEVER} or need_after < {NEVER}").select("node", "n", "class", *NEEDS).distinct()
    own_is_odd = F.col("class") % 2 == 1
    own, after = F.when(own_is_odd, F.col("odd")).otherwise(F.col("even")), F.when(own_is_odd, F.col("even")).otherwise(F.col("odd"))
    enough = (own >= F.col("need_before")) | ((own >= F.col("need_same")) & (after >= F.col("need_same_next"))) | (after >= F.col("need_after"))
    return shared.join(facts, "node").where(enough).select("node", "n", "class", "reach")


def _alone(sets: DataFrame) -> tuple[DataFrame, list[str]]:
    """(node, alone): elements of the node that no other node has; and the tables' paths. One pass over the elements,
    slice by slice."""
    parts, paths = [], []
    for column in SETS:
        seen = sets.select("node", F.explode(column).alias("element")).groupBy("element").agg(F.count("*").alias("df"), F.first("node").alias("node"))
        part, path = materialise(seen.where("df = 1").groupBy("node").agg(F.count("*").alias("alone")), "alone")
        parts.append(part)
        paths.append(path)
    return reduce(DataFrame.unionByName, parts), paths


def _able(alone: DataFrame, agreeing: DataFrame, percent: int) -> DataFrame:
    """The nodes that can link with any: ``common``, the elements that others have too, are as many as a link needs,
    the similarity's share of the node's own size."""
    total = alone.groupBy("node").agg(F.sum("alone").alias("alone"))
    counted = agreeing.join(total, "node", "left").withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0)))
    return counted.where(F.col("common") * 100 >= F.col("n") * percent).drop("alone")


def _sets_of(sets: DataFrame, able: DataFrame) -> tuple[DataFrame, list[str]]:
    """The sets of the able nodes; slices of the nodes, one after another."""
    parts, paths = [], []
    for k in range(SLICES):
        wanted = able.select("node").hint("shuffle_hash")
        part, path = materialise(sets.where(F.pmod(F.xxhash64("node"), F.lit(SLICES)) == k).join(wanted, "node"), "able-sets")
        parts.append(part)
        paths.append(path)
    return reduce(DataFrame.unionByName, parts), paths


def _fit(percent: int, n: tuple[str, str], common: tuple[str, str]) -> Column:
    """The size bound: the overlap that the sizes ask for is no more than either has in common with others."""
    return F.least(*common) * (100 + percent) >= (F.col(n[0]) + F.col(n[1])) * percent


def _pivots(members: DataFrame, percent: int) -> DataFrame:
    """(pivot, node, n): each node with the pivot that it shares most keys with."""
    pivots = members.groupBy("key").agg(F.max_by(F.struct("node", "n", "common"), F.struct("reach", "node")).alias("p"))
    pivots = pivots.select("key", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.common").alias("pivot_common"))
    pairs = spread_join(members, pivots, "key", "node").where("node <> pivot").where(_fit(percent, ("n", "pivot_n"), ("common", "pivot_common")))
    counted = pairs.groupBy("node", "pivot").agg(F.count("*").alias("keys"), F.first("n").alias("n"))
    return counted.groupBy("node").agg(F.max_by("pivot", F.struct("keys", "pivot")).alias("pivot"), F.first("n").alias("n"))


def _cells_of_stars(stars: DataFrame) -> DataFrame:
    """Cells of center and tile from (center, center_component, node, n, component)."""
    parts = stars.groupBy("center").agg(tiles(F.sum("n"), STAR_ELEMENTS).alias("parts"), F.first("center_component").alias("center_component"))
    dealt = spread_join(stars.drop("center_component"), parts, "center", "node").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int"))
    rows = dealt.select(F.col("center").alias("block"), F.lit(CENTER).alias("first"), F.col("tile").alias("second"), "tile", "node", "component")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    centers = parts.select(F.col("center").alias("block"), F.lit(CENTER).alias("first"), every.alias("second"), F.lit(CENTER).alias("tile"), F.col("center").alias("node"), F.col("center_component").alias("component"))
    return rows.unionByName(centers)


def _star_cells(pivots: DataFrame) -> DataFrame:
    return _cells_of_stars(pivots.select(F.col("pivot").alias("center"), F.col("pivot").alias("center_component"), "node", "n", F.col("node").alias("component")))


def _pair_cells(pairs: DataFrame) -> DataFrame:
    """Cells of pairs (a, b): the partners of a in tiles."""
    return _cells_of_stars(pairs.select(F.col("a").alias("center"), F.col("a_component").alias("center_component"), F.col("b").alias("node"), "n", F.col("b_component").alias("component")))


def _named(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with their component, a node without links being its own."""
    return members.drop("reach", "rows").join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))


def _open_nodes(named: DataFrame, pivots: DataFrame) -> DataFrame:
    """Nodes with a key that different components share: node, n, class, common, component, family (its pivot, or itself)."""
    open_keys = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    nodes = spread_join(named, open_keys, "key", "node").select("node", "n", "class", "common", "component").distinct()
    family = pivots.select("node", F.col("pivot").alias("family"))
    return nodes.join(family, "node", "left").withColumn("family", F.coalesce("family", "node"))


def _family_cells(nodes: DataFrame, percent: int) -> DataFrame:
    """Cells of families of several components. A family's rows are dealt into strata, by size class and by whether they
    are of its most frequent component; strata of tiles. Linked sets are of one size class or of neighbouring ones, and
    the main component's rows needn't meet each other."""
    by_component = nodes.groupBy("family", "component").agg(F.sum("n").alias("n"))
    main = by_component.groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("several")).where("several > 1")
    dealt = spread_join(nodes, main.select("family", "main"), "family", "node").withColumn("is_main", F.col("component") == F.col("main"))
    strata = dealt.groupBy("family", "is_main", "class").agg(F.greatest(tiles(F.sum("n"), TILE_ELEMENTS), tiles(F.count("*"), TILE_ROWS)).alias("parts"))
    name = 2 * F.col("class") + F.col("is_main").cast("int")
    strata = strata.select("family", name.alias("stratum"), "parts")
    other = strata.select("family", F.col("stratum").alias("other"), F.col("parts").alias("other_parts"))
    near = F.abs(F.floor(F.col("stratum") / 2) - F.floor(F.col("other") / 2)) <= 1
    both_main = (F.col("stratum") % 2 == 1) & (F.col("other") % 2 == 1)
    meetings = strata.join(other, "family").where(near & ~both_main).groupBy("family", "stratum", "parts").agg(F.collect_list(F.struct("other", "other_parts")).alias("others"))
    meetings = meetings.select(F.struct("family", "stratum").alias("at"), "parts", "others")
    rows = dealt.select(F.struct("family", name.alias("stratum")).alias("at"), "node", "component")
    rows = spread_join(rows, meetings, "at", "node")
    part = F.pmod(F.xxhash64("node"), F.col("parts").cast("long"))
    place = lambda stratum, p: stratum.cast("long") * (1 << 24) + p
    tile = place(F.col("at.stratum"), part)
    cells = F.flatten(F.transform("others", lambda o: F.transform(F.sequence(F.lit(0), o["other_parts"] - 1), lambda p: place(o["other"], p))))
    rows = rows.select(F.col("at.family").alias("block"), "node", "component", tile.alias("tile"), F.explode(cells).alias("met"))
    return rows.select("block", F.least("tile", "met").alias("first"), F.greatest("tile", "met").alias("second"), "tile", "node", "component")


def _crossing_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, str]:
    """(a, b, their components, size of b) and the path of a table that it reads; rows of different families and components that have one of their rarest elements
    in common.

    Of n elements, in an order that puts those of few nodes first, n - ceil(n * percent / 100) + 1 are enough: two
    linked sets share one of them. The rows of an element that many share are paired in tiles."""
    elements = sets.join(nodes.select("node"), "node", "left_semi").select("node", F.explode(F.concat(*SETS)).alias("element"))
    df = elements.groupBy("element").agg(F.count("*").alias("df")).where("df > 1")
    rows = nodes.agg(F.sum("n")).first()[0] or 0
    ordered = spread_join(elements, df, "element", "node", sizes=df.withColumnRenamed("df", "n"), rows=rows).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "element"))).alias("ordered"))
    # elements of no other node come first in the order; they take places but meet nobody
    enough = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("ordered"))
    rare = ordered.join(nodes, "node").where(enough > 0).withColumn("e", F.explode(F.slice("ordered", F.lit(1), enough.cast("int"))))
    names = ("node", "n", "common", "component", "family")
    parts = F.ceil(F.col("e.df") / COLUMN_ROWS).cast("int")
    rare, rare_path = materialise(rare.select(F.col("e.element").alias("element"), parts.alias("parts"), F.pmod(F.xxhash64("node"), parts.cast("long")).cast("int").alias("part"), *names), "rare-elements")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    side = lambda s, own, met: rare.select("element", F.col("part").alias(own), every.alias(met), *[F.col(c).alias(f"{s}_{c}") for c in names])
    crossing = (F.col("a_node") < F.col("b_node")) & (F.col("a_component") != F.col("b_component")) & (F.col("a_family") != F.col("b_family"))
    pairs = side("a", "i", "j").join(side("b", "j", "i"), ["element", "i", "j"]).where(crossing & _fit(percent, ("a_n", "b_n"), ("a_common", "b_common")))
    return pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), "a_component", "b_component", F.col("b_n").alias("n")).distinct(), rare_path
