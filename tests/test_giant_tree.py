"""Trees that fit into no block give the same rows as trees that do."""

from postmill.operators import hierarchy
from tests.test_hierarchy import SCHEMA, random_rows


def shapes(n=20):
    """One group each: a chain, a star, a loop with trees under it, two binary trees with the same names; and random rows."""
    parents = {
        "chain": lambda i: [f"n{i - 1}"] if i else [],
        "star": lambda i: ["n0"] if i else [],
        "loop": lambda i: [f"n{(i + 1) % 5}" if i < 5 else f"n{i // 2}"],
        "binary": lambda i: [f"n{(i - 1) // 2}"] if i else [],
        "again": lambda i: [f"n{(i - 1) // 2}"] if i else [],
    }
    return [(g, f"n{i}", i, p(i), "x") for g, p in parents.items() for i in range(n)] + random_rows(5)


def test_beyond_the_bound_equals_one_block(spark):
    links = spark.createDataFrame(shapes(), SCHEMA)
    rows = lambda df: sorted(tuple(r.asDict().items()) for r in df.collect())
    for lists in (False, True):
        assert rows(hierarchy.hierarchy(links, lists, block_nodes=3)) == rows(hierarchy.hierarchy(links, lists))
