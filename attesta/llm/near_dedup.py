"""MinHash near-dedup: a chosen-path set similarity join.

Documents with equal shingle sets form one class. Each class carries a signature of minwise tokens (coordinate, value).
In every tree a node passes on its classes to children named by chosen tokens (at the root ``1 / threshold`` of them
expected per class and one at least, below it two), so a similar pair keeps meeting while others part; nodes of at most ``leaf`` classes are compared exhaustively on
signatures, and pairs that may reach the threshold are confirmed on their full sets. Independent trees bring up recall.

A dense group never parts, and listing all its pairs is no use. So leaves first give a spanning forest of their likely
pairs, and large nodes a star; confirmed links merge classes into components. After that the classes of a node that have
a likely partner in another component meet there with their texts, every such pair still apart is compared on its full
sets, and only links that tie components leave the task. A node branches only if it holds more than one component and more
classes than one task compares. What is still as large at ``depth``, and before that a node whose branches held as many pairs
as itself twice in a row, is compared exhaustively, block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from attesta.llm.columns import Words, gram_hashes, mix64, slices, text_column, tidy
from attesta.llm.graph import connected_components
from attesta.llm.scratch import fresh, identity, materialise

COORDINATES = 32
#: Minwise bytes that estimate a similarity; those of a pair at the threshold agree in fewer places than asked for with a
#: chance of about 3e-6.
ESTIMATED, DEVIATIONS = 192, 4.5
TREES, LEAF, DEPTH = 12, 256, 6
#: Coordinates that a large node chooses: a pair at the threshold goes on in 1.6 children of each node that holds it.
CHOICES = 2
#: A node of this many leaves' classes is still compared in one task, class by class.
CROWD = 16
#: Shingles of one node's texts in a task; the texts of a node with more are dealt over pairs of blocks.
SHINGLES = 1 << 22
#: A node whose children hold this share of its pairs or more has not parted.
FLAT = 0.9

_SEEDS = mix64(np.arange(1, ESTIMATED + 1, dtype=np.uint64))
_FACTORS = mix64(np.arange(1001, ESTIMATED + 1001, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, the sorted distinct shingle hashes of each row) of slices of a text column; A-Z are lower-cased, a text
    of fewer words is one shingle, one without words has none."""
    for row, _, data, offsets in slices(column):
        words = Words(data, offsets, fold_case=True)
        grams = gram_hashes(words.key, size)
        sets = []
        for lo, hi in zip(words.first[:-1], words.first[1:]):
            if hi - lo >= size:
                sets.append(np.unique(grams[lo:hi - size + 1]))
            else:  # the whole sequence as one shingle
                sets.append(gram_hashes(words.key[lo:hi], hi - lo) ^ np.uint64(hi - lo) if hi > lo else grams[:0])
        yield row, sets


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in shingle_sets(text_column(batch, "text"), size):
                counts = np.array([len(s) for s in sets])
                full = np.flatnonzero(counts)
                tokens = np.zeros((len(sets), COORDINATES), dtype=np.uint32)
                brief = np.zeros((len(sets), ESTIMATED), dtype=np.uint8)
                if len(full):
                    values = np.concatenate(sets)
                    starts = (np.cumsum(counts) - counts)[full]
                    for i in range(ESTIMATED):
                        hashed = (((values ^ _SEEDS[i]) * _FACTORS[i]) >> np.uint64(32)).astype(np.uint32)
                        least = np.minimum.reduceat(hashed, starts)
                        brief[full, i] = least & np.uint32(255)
                        if i < COORDINATES:
                            tokens[full, i] = least
                part = batch.slice(row, len(sets))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), part.column(2), pa.array(counts, pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.FixedSizeListArray.from_arrays(pa.array(tokens.view(np.int32).ravel()), COORDINATES).cast(pa.list_(pa.int32())),
                    pa.array([b.tobytes() for b in brief], pa.binary())],
                    names=["row_id", "row_hash", "label", "n_shingles", "class", "tokens", "bytes"])
    return run


def _root_choices(threshold: float, trees: int) -> list[list[int]]:
    """(tree, coordinate) of the children of the roots; a tree that chose none draws again."""
    out = []
    for tree in range(trees):
        chosen, draw = np.zeros(0, dtype=np.int64), 0
        while not len(chosen):
            at = np.arange(tree * COORDINATES, (tree + 1) * COORDINATES, dtype=np.uint64) + np.uint64(7_001 + draw * trees * COORDINATES)
            chosen, draw = np.flatnonzero((mix64(at) >> np.uint64(33)) < (1 << 31) / (threshold * COORDINATES)), draw + 1
        out += [[tree, i] for i in chosen.tolist()]
    return out


def _roots(threshold: float, trees: int) -> Column:
    """The children of the roots: the coordinates that a tree's root chooses are the same for every class."""
    return F.array(*[F.xxhash64(F.lit(tree), F.lit(i), F.element_at("tokens", i + 1)) for tree, i in _root_choices(threshold, trees)])


def _branch(path: Column, level: Column, tries: Column) -> Column:
    """The children that a class goes to: tokens of the coordinates that the node chooses, ``CHOICES`` for each of the
    ``tries`` (nodes of equal members) that it stands for."""
    every = F.transform(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), lambda i: F.struct(
        F.xxhash64(path, level, i).alias("dice"), i.alias("i"), F.element_at("tokens", i + 1).alias("value")))
    chosen = F.slice(F.array_sort(every), 1, F.least(CHOICES * tries, F.lit(COORDINATES)).cast("int"))
    return F.transform(chosen, lambda t: F.xxhash64(path, level, t["i"], t["value"]))


_LOW, _HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def _agreeing(rows: np.ndarray, row: np.ndarray) -> np.ndarray:
    """In how many bytes each of the rows (eight bytes to a number) agrees with one."""
    differ = rows ^ row
    some = (differ & _LOW) + _LOW
    some |= differ
    some &= _HIGH  # one bit for each byte that differs
    return 8 * rows.shape[1] - np.bitwise_count(some).sum(axis=1, dtype=np.int64)


def _likely_partners(threshold: float):
    """A function of a node's (sizes, bytes, components): (i, js, agreement) of pairs of different components that may reach
    the threshold, each pair once."""
    least = int(np.floor(ESTIMATED * (threshold - DEVIATIONS * np.sqrt(threshold * (1 - threshold) / ESTIMATED))))

    def partners(sizes: np.ndarray, brief: np.ndarray, component: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        _, inverse, counts = np.unique(component, return_inverse=True, return_counts=True)
        # every pair of different components has a class outside the largest one
        largest = inverse == np.argmax(counts)
        order = np.argsort(largest, kind="stable")
        sizes, words, component = sizes[order], np.ascontiguousarray(brief[order]).view(np.uint64), component[order]
        for i in range(len(order) - int(largest.sum())):
            rest = slice(i + 1, None)
            small, large = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
            at = np.flatnonzero((small >= threshold * large - 1e-9) & (component[rest] != component[i])) + i + 1
            if len(at):
                same = _agreeing(words[at], words[i])
                at, same = at[same >= least], same[same >= least]
                if len(at):
                    yield order[i], order[at], same

    return partners


def _joined(n: int, found: np.ndarray) -> list[tuple[int, int]]:
    """The pairs that tie classes which those before did not."""
    root, out = list(range(n)), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x
    for i, j in found.T.tolist():
        a, b = top(i), top(j)
        if a != b:
            root[b] = a
            out.append((i, j))
    return out


def _by_node(work, names: list[str]):
    """Rows sorted by node (the first column): ``work`` on the rows of one node at a time gives the columns ``names``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            node = np.asarray(batch.column(0))
            out: list[tuple] = []
            cuts = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if held and node[lo] != last:
                    out += work(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = node[lo]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in out], pa.int64()) for k, n in enumerate(names)})
        if held:
            out = work(held)
            yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in out], pa.int64()) for k, n in enumerate(names)})
    return run


def _columns(parts: list[pa.RecordBatch]):
    """(ids, sizes, bytes, components) of a node's rows (node, id, n_shingles, bytes, component, ..)."""
    def column(i: int) -> np.ndarray:
        return np.concatenate([np.asarray(p.column(i)) for p in parts])
    brief = b"".join(x for p in parts for x in p.column(3).to_pylist())
    return column(1), column(2), np.frombuffer(brief, dtype=np.uint8).reshape(-1, ESTIMATED), column(4)


def _forest(threshold: float):
    """Of each node a spanning forest of its likely pairs, the most alike first."""
    partners = _likely_partners(threshold)

    def work(parts: list[pa.RecordBatch]) -> list[tuple]:
        ids, sizes, brief, component = _columns(parts)
        found = [np.stack([same, np.full(len(js), i), js]) for i, js, same in partners(sizes, brief, component)]
        if not found:
            return []
        pairs = np.concatenate(found, axis=1)
        tied = _joined(len(ids), pairs[1:, np.argsort(-pairs[0], kind="stable")])
        return [(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in tied]
    return _by_node(work, ["a", "b"])


def _border(threshold: float):
    """(node, id) of classes with a likely partner in another component."""
    partners = _likely_partners(threshold)

    def work(parts: list[pa.RecordBatch]) -> list[tuple]:
        ids, sizes, brief, component = _columns(parts)
        met = np.zeros(len(ids), dtype=bool)
        for i, js, _ in partners(sizes, brief, component):
            met[i] = met[js] = True
        node = parts[0].column(0)[0].as_py()
        return [(node, x) for x in ids[met].tolist()]
    return _by_node(work, ["node", "id"])


def _ties(size: int, threshold_pct: int):
    """Links that tie the components of a node: every likely pair of classes still apart is compared on its full sets."""
    partners = _likely_partners(threshold_pct / 100)

    def work(parts: list[pa.RecordBatch]) -> list[tuple]:
        ids, _, brief, component = _columns(parts)
        sets = [s for p in parts for _, part in shingle_sets(text_column(p, "text"), size) for s in part]
        sizes = np.array([len(s) for s in sets])
        start = np.cumsum(sizes) - sizes
        values, codes = np.unique(np.concatenate(sets), return_inverse=True)
        del sets
        held = np.zeros(len(values), dtype=np.int8)
        _, label = np.unique(component, return_inverse=True)
        out = []
        for i, js, _ in partners(sizes, brief, component):
            mine = codes[start[i]:start[i] + sizes[i]]
            held[mine] = 1
            for lo in range(0, len(js), 1024):
                some = js[lo:lo + 1024]
                some = some[label[some] != label[i]]
                if not len(some):
                    continue
                first = np.cumsum(sizes[some]) - sizes[some]
                each = np.arange(sizes[some].sum()) + np.repeat(start[some] - first, sizes[some])
                both = np.add.reduceat(held[codes[each]], first, dtype=np.int64)
                for j in some[100 * both >= threshold_pct * (sizes[i] + sizes[some] - both)].tolist():
                    if label[j] != label[i]:
                        out.append((ids[i], ids[j]))
                        label[label == label[j]] = label[i]
            held[mine] = 0
        return out
    return _by_node(work, ["a", "b"])


def _confirm(size: int, threshold_pct: int):
    """Pairs of texts whose full shingle sets reach the threshold."""
    def sets(column: pa.Array) -> list[np.ndarray]:
        return [s for _, part in shingle_sets(column, size) for s in part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for j, (x, y) in enumerate(zip(sets(text_column(part, "text_a")), sets(text_column(part, "text_b")))):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= threshold_pct * (len(x) + len(y) - both):
                        keep.append(i + j)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, threshold_pct: int = 80,
                    trees: int = TREES, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """Per document: its id, ``row_id`` and ``row_hash`` (see ``scratch.identity``), ``n_shingles`` (its set's size), ``class`` (equal for equal sets, null for empty ones),
    ``component_id`` (the least id in reach over links of Jaccard similarity ``threshold_pct`` percent or more, its own
    included) and ``kept`` (the id is the component's). Documents without words have no links; rows without an id are
    components by their text and are named by the least id there is. Repeated rows are equal documents."""
    threshold = threshold_pct / 100
    named = docs.select(*identity(key, text), F.col(key).cast("long").alias("label"), F.col(text).alias("text"))
    sketches = materialise(named.mapInArrow(
        tidy(_sketch(shingle)), "row_id long, row_hash int, label long, n_shingles long, class binary, tokens array<int>, bytes binary"), "sketches")
    classes = materialise(
        sketches.filter("class is not null").groupBy("class").agg(
            F.min("label").alias("label"), F.min(F.struct("row_id", "row_hash")).alias("row"),
            F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens"), F.first("bytes").alias("bytes"))
        .withColumn("id", F.monotonically_increasing_id()), "classes")
    brief = classes.select("id", "n_shingles", "bytes")

    def nodes_of(rows: DataFrame) -> DataFrame:
        """(node, n, tries) of nodes with partners; of nodes with the same classes one, with their number."""
        return (rows.groupBy("node").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"),
                                         F.sum(F.hash("id").cast("long")).alias("s")).filter("n > 1")
                .groupBy("n", "x", "s").agg(F.min("node").alias("node"), F.count("*").alias("tries")).select("node", "n", "tries"))

    def sketched(rows: DataFrame, components: DataFrame | None) -> DataFrame:
        """The rows of nodes (node, id) with what the comparisons of a node need, sorted by node."""
        full = rows.select("node", "id").join(brief, "id")
        if components is None:
            full = full.withColumn("component", F.col("id"))
        else:
            full = full.join(components, F.col("id") == F.col("of"), "left").withColumn("component", F.coalesce("root", "id"))
        return full.select("node", "id", "n_shingles", "bytes", "component")

    def in_nodes(rows: DataFrame, work, schema: str) -> DataFrame:
        return rows.repartition("node").sortWithinPartitions("node").mapInArrow(tidy(work), schema)

    def stars(rows: DataFrame) -> DataFrame:
        """Every class of a large node with the node's least one."""
        centre = rows.groupBy("node").agg(F.min("id").alias("a"))
        return rows.join(centre, "node").filter("id != a").select("a", F.col("id").alias("b"))

    rows = materialise(classes.select("id", F.explode(_roots(threshold, trees)).alias("node")), "rows")
    rows = materialise(rows.join(nodes_of(rows), "node"), "nodes")
    small, large = rows.filter(F.col("n") <= leaf), rows.filter(F.col("n") > leaf)
    forest = in_nodes(sketched(small, None), _forest(threshold), "a long, b long")
    pairs = materialise(forest.unionByName(stars(large)).distinct(), "pairs")
    wanted = (pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
              .distinct().join(classes.select("id", "row.*"), "id"))
    texts = materialise(wanted.join(named, ["row_id", "row_hash"]).select("id", "text"), "texts")

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(texts.selectExpr("id as a", "text as text_a"), "a").join(texts.selectExpr("id as b", "text as text_b"), "b")
        return materialise(pairs.select("a", "b", "text_a", "text_b").mapInArrow(
            tidy(_confirm(shingle, threshold_pct)), "a long, b long"), "links")

    components = materialise(connected_components(confirm(pairs)).withColumnRenamed("node", "of"), "components")

    def joined(links: DataFrame) -> DataFrame:
        """The components with some links more: only roots that these tie are worked on."""
        a, b = (components.selectExpr(f"of as {x}", f"root as root_{x}") for x in ("a", "b"))
        ties = links.join(a, "a", "left").join(b, "b", "left").select(
            F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).filter("a != b")
        ties = materialise(ties, "ties")
        if ties.isEmpty():
            return components
        tied = materialise(connected_components(ties).selectExpr("node as tied", "root as new"), "tied")
        known = components.join(tied, F.col("root") == F.col("tied"), "left").select("of", F.coalesce("new", "root").alias("root"))
        single = tied.join(components, F.col("tied") == F.col("of"), "left_anti").selectExpr("tied as of", "new as root")
        return materialise(known.unionByName(single), "components")

    def mixed(rows: DataFrame) -> DataFrame:
        """The rows of the nodes that hold several components, with n (classes) and ``apart`` (pairs of different
        components)."""
        rooted = rows.select("node", "id").join(components, F.col("id") == F.col("of"), "left").withColumn("root", F.coalesce("root", "id"))
        held = rooted.groupBy("node", "root").agg(F.count("*").alias("c")).groupBy("node").agg(
            F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("squares"))
        several = held.select("node", "n", ((F.col("n") * F.col("n") - F.col("squares")) / 2).alias("apart")).filter("apart > 0")
        return rows.drop("n", "apart").join(several, "node")

    def dealt(rows: DataFrame, blocks: Column) -> DataFrame:
        """(node, id) of nodes for every pair of the ``blocks`` that the classes of a node are dealt over."""
        each = rows.select("node", "id", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("i"),
                           F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"))
        return each.select(F.xxhash64("node", F.least("i", "j"), F.greatest("i", "j")).alias("node"), "id")

    crowd = CROWD * leaf
    easy = F.col("n") <= crowd
    blocks = F.ceil(2 * F.col("n") / crowd).cast("int")
    todo = [mixed(small).select("node", "id")]
    level, large = 1, materialise(mixed(large).withColumn("flat", F.lit(False)), "nodes")
    todo.append(large.filter(easy).select("node", "id"))
    hard = large.filter(~easy)
    while not hard.isEmpty():
        if level == depth:
            todo.append(dealt(hard, blocks))
            break
        level += 1
        children = hard.select("id", "node", "tries").join(classes.select("id", "tokens"), "id")
        children = children.select("id", F.col("node").alias("parent"), F.explode(_branch(F.col("node"), F.lit(level), F.col("tries"))).alias("node"))
        children = materialise(children, "rows")
        children = materialise(mixed(children.join(nodes_of(children).select("node", "tries"), "node")), "nodes")
        below = children.groupBy("parent", "node").agg(F.max("apart").alias("apart")).groupBy("parent").agg(F.sum("apart").alias("below"))
        known = hard.select(F.col("node").alias("parent"), "apart", F.col("flat").alias("before")).distinct().join(below, "parent")
        known = known.select("parent", "before", (F.col("below") >= FLAT * F.col("apart")).alias("flat"))
        dense = known.filter("before and flat").select("parent")
        todo.append(dealt(hard.join(dense, hard["node"] == dense["parent"], "left_semi"), blocks))
        children = children.join(known.filter("not (before and flat)").select("parent", "flat"), "parent").drop("parent")
        todo.append(children.filter(easy).select("node", "id"))
        hard = materialise(children.filter(~easy), "nodes")
        if not hard.isEmpty():
            components = joined(confirm(stars(hard).distinct().join(pairs, ["a", "b"], "left_anti")))
            hard = materialise(mixed(hard), "nodes")

    remaining = todo[0]
    for part in todo[1:]:
        remaining = remaining.unionByName(part)
    border = materialise(in_nodes(sketched(remaining, components), _border(threshold), "node long, id long"), "border")
    held = border.join(brief.select("id", "n_shingles"), "id").groupBy("node").agg(F.sum("n_shingles").alias("held"))
    border = dealt(border.join(held, "node"), F.when(F.col("held") <= SHINGLES, 1).otherwise(F.ceil(2 * F.col("held") / SHINGLES)).cast("int"))
    full = sketched(border, components).join(texts, "id").select("node", "id", "n_shingles", "bytes", "component", "text")
    components = joined(in_nodes(full, _ties(shingle, threshold_pct), "a long, b long"))

    rooted = classes.select("class", "label", "id").join(components, F.col("id") == F.col("of"), "left")\
        .withColumn("root", F.coalesce("root", "id"))
    named_roots = rooted.groupBy("root").agg(F.min("label").alias("component_id"))
    of_class = rooted.join(named_roots, "root").select("class", "component_id")
    out = sketches.select("row_id", "row_hash", "label", "n_shingles", "class").join(of_class, "class", "left")
    component = F.coalesce("component_id", "label")
    return out.select(F.col("label").alias(key), "row_id", "row_hash", "n_shingles", "class", component.alias("component_id"),
                      F.col("label").eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component, that with its least id; of repeated rows one stays."""
    row_id, row_hash, nth = fresh(docs, "row_id", "row_hash", "nth")
    kept = near_duplicates(docs, key, text, **options).filter("kept").select(F.col("row_id").alias(row_id), F.col("row_hash").alias(row_hash))
    named = docs.withColumns(dict(zip((row_id, row_hash), identity(key, text)))).join(kept, [row_id, row_hash], "left_semi")
    same = W.partitionBy(row_id, row_hash, F.xxhash64(text)).orderBy(row_hash)
    return named.withColumn(nth, F.row_number().over(same)).filter(F.col(nth) == 1).select(*docs.columns)
