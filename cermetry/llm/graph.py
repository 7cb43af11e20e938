"""Connected components of a link table, by smallest labels with shortcuts."""

from pyspark.sql import functions as F

from cermetry.llm.store import stored


def components(links, a="a", b="b"):
    """(node, root) for every node that occurs in ``links``; root is the smallest
    node that can be reached.  Self links and repeated links do no harm.

    Each round every node takes the smallest label among its own and its
    neighbours', then the label of that label.  Both results are written to the
    shared folder: a lost executor costs one round, and a node with very many
    links meets its label in a join whose large partitions Spark can split.
    Only one row of checksums per round reaches the driver.
    """
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x != y")
    edges = stored(pairs.union(pairs.select("y", "x")).distinct(), "links")
    labels = stored(edges.groupBy(F.col("x").alias("node")).agg(F.min(F.least("x", "y")).alias("root")), "labels")
    state = None
    while True:
        near = edges.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("root").alias("low"))
        labels = stored(labels.join(near, F.col("node") == F.col("x")).select("node", F.least("root", "low").alias("root")), "labels")
        over = labels.select(F.col("node").alias("via"), F.col("root").alias("top"))
        labels = stored(labels.join(over, F.col("root") == F.col("via")).select("node", F.col("top").alias("root")), "labels")
        now = labels.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "root")), F.sum(F.hash("node", "root").cast("long"))).first()
        if now == state or not now[0]:
            return labels
        state = now
