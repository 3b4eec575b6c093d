"""A dataset's Merkle manifest by Pregel-style supersteps over RDDs (operator 13).

Rows are leaves; each source has a tree over its leaves in order of ids, and one tree stands over the sources' roots. ``FAN``
consecutive nodes become their hash until one is left. A vertex is a block: ``SPAN`` levels of a tree over at most
``FAN ** SPAN`` neighbouring nodes. In a superstep upward, nodes are messages to their blocks; a block that has all its nodes
hashes them to one and sends that on. Supersteps downward carry the siblings on the way to the root: a block with its own way
adds each node's siblings and sends them to the block below, until leaves have their proofs. A source with a third of all rows
is as many more blocks; no tree, level or source is in one task. Each superstep's blocks are kept by ``checkpoint``.

Places of leaves come from a sort by (source, id) into ranges and from counts of ranges; the driver sees one row for each range.

Null fields hash as ``-``. Null sources come first, null ids after all others, leaves of equal id in order of their hashes.
Rows equal in everything stay rows. A null id is never tampered with. Long texts are hashed in the JVM, and only hashes reach
Python. An empty table gives no rows. Further columns are not read.
"""

from collections.abc import Iterator
from hashlib import sha256

from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.work import checkpoints, parts, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN, SPAN = 3, 6


def digest(*inputs: str) -> str:
    return sha256("".join(inputs).encode()).hexdigest()


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*[field(text if name == "text" else F.col(name)) for name in FIELDS]).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf and held: the leaf of the row as it is found, which for ids of an even crc32 lacks line feeds."""
    text = F.col("text")
    even = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    tampered = F.coalesce(even & F.contains(text, F.lit("\n")), F.lit(False))
    # one generator, so that hashes are not made again where they are sorted by
    made = F.explode(F.array(F.struct(leaf(text).alias("leaf"), F.when(tampered, leaf(F.translate(text, "\n", ""))).alias("held"))))
    rows = docs.select(*FIELDS).select("doc_id", F.col("source").cast("string").alias("source"), made.alias("h"))
    return rows.select("doc_id", "source", "h.leaf", F.coalesce("h.held", "h.leaf").alias("held"))


def kept(rdd: RDD) -> RDD:
    """``rdd`` computed once and read from the checkpoint folder from then on."""
    rdd.persist(StorageLevel.DISK_ONLY)
    rdd.checkpoint()
    rdd.count()
    rdd.unpersist()
    return rdd


def numbered(rows: DataFrame) -> RDD:
    """((source's number, place in it), (last, (doc_id, source, leaf, held))) of every row of ``leaves``."""
    copies = F.monotonically_increasing_id()  # rows equal in everything are dealt by their place in the input
    ordered = written(rows, "leaves").withColumn("copy", copies).repartitionByRange(parts(rows), F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_last(), "leaf", "copy")
    ordered = ordered.sortWithinPartitions(F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_last(), "leaf")

    def counted(part: int, found: Iterator) -> Iterator:
        number, place, held = -1, 0, None
        for row in found:
            new = held is None or held[1] != row[1]
            if held is not None:
                yield part, number, place, new, held
            number, place, held = (number + 1, 0, row) if new else (number, place + 1, row)
        if held is not None:
            yield part, number, place, None, held  # whether it ends its source is up to the next range

    rdd = kept(ordered.select("doc_id", "source", "leaf", "held").rdd.map(tuple).mapPartitionsWithIndex(counted))

    def ends(found: Iterator) -> Iterator:
        first, last = None, None
        for last in found:
            first = first or last
        if last:
            yield last[0], first[4][1], last[4][1], last[1], last[2] + 1

    starts, finals, number, place, before = {}, {}, -1, 0, ()
    found = sorted(rdd.mapPartitions(ends).collect(), key=lambda x: x[0])  # one row for each range
    for k, (part, first, last, sources, rows_of_last) in enumerate(found):
        if (first,) != before:
            number, place = number + 1, 0
        starts[part] = number, place
        finals[part] = k + 1 == len(found) or found[k + 1][1] != last
        place = rows_of_last + (place if sources == 0 else 0)
        number, before = number + sources, (last,)

    def placed(x: tuple) -> tuple:
        part, number, place, last, row = x
        first, offset = starts[part]
        return (first + number, place + (offset if number == 0 else 0)), (finals[part] if last is None else last, row)

    return rdd.map(placed)


def raised(nodes: list[str], levels: int, whole: bool) -> str:
    """The hash of neighbouring nodes ``levels`` above, or of the whole tree."""
    while (len(nodes) > 1) if whole else levels:
        nodes, levels = [digest(*nodes[k : k + FAN]) for k in range(0, len(nodes), FAN)], levels - 1
    return nodes[0]


def siblings(nodes: list[str], levels: int, whole: bool) -> list[list[tuple[str, str]]]:
    """For each node what stands left and right of it in its run, level by level."""
    ways, of = [[] for _ in nodes], list(range(len(nodes)))
    while (len(nodes) > 1) if whole else levels:
        for k, at in enumerate(of):
            run = at - at % FAN
            ways[k].append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + FAN])))
        nodes, levels, of = [digest(*nodes[k : k + FAN]) for k in range(0, len(nodes), FAN)], levels - 1, [at // FAN for at in of]
    return ways


class Tree:
    """Trees over the nodes ((tree, place), (last, (node, ...))): supersteps up, then down."""

    def __init__(self, nodes: RDD, partitions: int, hash_at: int) -> None:
        self.partitions, self.at, self.steps = partitions, hash_at, []
        width, at = FAN**SPAN, hash_at

        def to_block(x: tuple) -> tuple:
            (tree, place), (last, node) = x
            return (tree, place // width), (place % width, last, node)

        while True:

            def complete(x: tuple, at: int = at) -> tuple:
                """A block with all its nodes: they in order, whether it is its whole tree, whether it has the last node, its hash."""
                (tree, block), found = x
                found = sorted(found, key=lambda y: y[0])
                held, last = [y[2] for y in found], found[-1][1]
                return (tree, block), (held, last and block == 0, last, raised([n[at] for n in held], SPAN, last and block == 0))

            blocks = kept(nodes.map(to_block).groupByKey(partitions).map(complete, preservesPartitioning=True))
            self.steps.append(blocks)
            nodes, at = blocks.filter(lambda x: not x[1][1]).mapValues(lambda x: (x[2], (x[3],))), 0
            if not nodes.count():
                break

    @staticmethod
    def tops(blocks: RDD) -> RDD:
        return blocks.filter(lambda x: x[1][1]).map(lambda x: (x[0][0], x[1][3]))

    def roots(self) -> RDD:
        """(tree, its root)."""
        return self.steps[0].context.union([self.tops(blocks) for blocks in self.steps])

    def ways(self, above: RDD) -> RDD:
        """(node, its siblings up to the top) of every node; ``above``: (tree, the siblings from its root on)."""
        arrived = None
        for step in range(len(self.steps) - 1, -1, -1):
            finished = self.tops(self.steps[step]).join(above, self.partitions).map(lambda x: ((x[0], 0), x[1][1]))
            arrived = arrived.union(finished) if arrived else finished

            def down(x: tuple, at: int = 0 if step else self.at) -> Iterator:
                (tree, block), ((held, whole, _, _), way) = x
                own = siblings([n[at] for n in held], SPAN, whole)
                for k, node in enumerate(held):
                    yield (tree, block * FAN**SPAN + k), (node, own[k] + way)

            out = self.steps[step].join(arrived, self.partitions).flatMap(down)
            arrived = out.mapValues(lambda x: x[1])
        return out.values()


def folded(node: str, way: list[tuple[str, str]]) -> str:
    """The root that follows from a leaf and its siblings."""
    for left, right in way:
        node = digest(left, node, right)
    return node


def manifest(docs: DataFrame) -> DataFrame:
    """A row for each leaf with its proof and the root that follows from the row as it is found."""
    spark = docs.sparkSession
    checkpoints(spark)
    rows, n = leaves(docs), parts(docs)
    schema = rows.select("doc_id", "source", "leaf").schema.add("subroot", "string").add("root", "string").add("proof_sha256", "string").add("folded_root", "string").add("verified", "boolean")
    nodes = numbered(rows)
    if nodes.isEmpty():
        return spark.createDataFrame([], schema)
    trees = Tree(nodes, n, 2)
    roots = kept(trees.roots())
    last = roots.keys().max()
    top = Tree(roots.map(lambda x: ((0, x[0]), (x[0] == last, (x[1], x[0])))), n, 0)
    root = top.roots().first()[1]
    above = top.ways(top.roots().mapValues(lambda _: [])).map(lambda x: (x[0][1], [(x[0][0],), *x[1]]))

    def proven(x: tuple) -> tuple:
        (doc_id, source, leaf, held), way = x
        subroot = next(level[0] for level in way if len(level) == 1)
        way = [level for level in way if len(level) == 2]
        found = folded(held, way)
        return doc_id, source, leaf, subroot, root, digest(*[s for level in way for s in level]), found, found == root

    return spark.createDataFrame(trees.ways(above).map(proven), schema, verifySchema=False)
