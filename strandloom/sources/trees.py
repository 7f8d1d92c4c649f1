"""Trees in Newick text as tables of nodes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.session import ship

#: Nodes of small trees that a task hands on at once.
ROWS = 10_000
_TOKEN = re.compile(r"\[[^\]]*\]|'(?:[^']|'')*'|[(),;]|:[^(),;\[]*|[^(),:;\[\s'][^(),:;\[]*")


def nodes_of(text: str | None) -> list[tuple[int, int | None, str | None, float | None, int]]:
    """(node, parent, name, length, depth), the root first and parents before their children; none where brackets don't match.

    Quoted names lose their quotes, comments are left out, and what isn't a number is no length.
    """
    nodes: list[list] = [[0, None, None, None, 0]]
    at, ended = 0, False

    def child(of: int) -> int:
        nodes.append([len(nodes), of, None, None, nodes[of][4] + 1])
        return len(nodes) - 1

    for token in _TOKEN.findall(text or ""):
        if ended or token[0] == "[":
            continue
        if token == "(":
            at = child(at)
        elif token in ",)":
            if nodes[at][1] is None:
                return []
            at = child(nodes[at][1]) if token == "," else nodes[at][1]
        elif token == ";":
            ended = True
        elif token[0] == ":":
            try:
                nodes[at][3] = float(token[1:])
            except ValueError:
                nodes[at][3] = None
        else:
            nodes[at][2] = token[1:-1].replace("''", "'") if token[0] == "'" else token.strip()
    return [tuple(n) for n in nodes] if ended and at == 0 and (len(nodes) > 1 or nodes[0][2] is not None) else []


def tree_nodes(trees: DataFrame) -> DataFrame:
    """(tree, node, parent, name, length, depth, above) of (tree, value), a Newick text in each row; above: the parent's name."""
    ship(trees.sparkSession)
    kind = trees.schema["tree"].dataType.simpleString()
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: list[int] = []
            found: list[tuple] = []

            def handed() -> pa.RecordBatch:
                columns = [pa.array(c, t) for c, t in zip(zip(*found), kinds, strict=True)]
                return pa.RecordBatch.from_arrays([batch.column("tree").take(pa.array(own, pa.int64())), *columns], names=["tree", "node", "parent", "name", "length", "depth", "above"])

            for k, text in enumerate(batch.column("value").to_pylist()):
                nodes = nodes_of(text)
                own += [k] * len(nodes)
                found += [(*n, None if n[1] is None else nodes[n[1]][2]) for n in nodes]
                if len(own) >= ROWS:
                    yield handed()
                    own, found = [], []
            if own:
                yield handed()

    return trees.select("tree", "value").mapInArrow(run, f"tree {kind}, node long, parent long, name string, length double, depth int, above string")


def tree_file(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of one tree, lines of a file or of a folder of files joined."""
    text = spark.read.text(path, wholetext=True)
    return tree_nodes(text.select(F.input_file_name().alias("tree"), "value"))
