"""Small graphs that the tests share."""

from weft.operators.graph import PropertyGraph


def social(spark):
    """Alice 35, Bob 25, Carol 30, Dave 40; Alice knows Bob and Carol, Dave knows Bob."""
    people = spark.createDataFrame([(1, "Alice", 35), (2, "Bob", 25), (3, "Carol", 30), (4, "Dave", 40)], "id long, name string, age long")
    knows = spark.createDataFrame([(10, 1, 2, 2001), (11, 1, 3, None), (12, 4, 2, 2005)], "id long, src long, dst long, since long")
    return PropertyGraph(spark).with_vertices("Person", people).with_edges("KNOWS", knows, "Person", "Person")


def links(spark, pairs, label="R", nodes=None, costs=None):
    ids = sorted(nodes if nodes is not None else {x for p in pairs for x in p})
    v = spark.createDataFrame([(i, i) for i in ids], "id long, k long")
    e = spark.createDataFrame([(100 + i, a, b, float(costs[i]) if costs else 1.0) for i, (a, b) in enumerate(pairs)], "id long, src long, dst long, cost double")
    return PropertyGraph(spark).with_vertices("N", v).with_edges(label, e, "N", "N")


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
