"""Renames between two snapshots by the similarity of contents: bytes of the lines that both have, over the bytes of the larger file.

Candidates meet by rare lines.  Lines have one order, the rarest first; a file's leading lines are those before which less than
1 - threshold of its bytes stands.  Of two files that share enough, the first line they share is a leading one of both, so that joining
leading lines alone misses no pair, and lines that every file has hardly ever lead.

Pairs are taken greedily, the most similar first, each file once.  Spark takes them in rounds: a pair that is the best of both its files is what the greedy
order would take as well, so each round takes all of those and drops what else they were in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delve.functions.text import file_name
from delve.operators.verify import snapshot_diff
from delve.sources.stage import cut

THRESHOLD = 0.5


def line_weights(files: DataFrame, text: str = "content") -> DataFrame:
    """path, line, weight, size of files (path, text): each distinct line by its hash and bytes, the bytes of all its copies, and of the whole file.

    A line's bytes count its end; an empty or null file has one empty line.
    """
    lines = files.select("path", F.explode(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n")).alias("line"))
    length = F.octet_length("line") + 1
    each = lines.groupBy("path", F.struct(F.xxhash64("line").alias("hash"), length.alias("bytes")).alias("line")).agg(F.count("*").alias("copies"))
    sizes = files.select("path", (F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit(""))) + 1).cast("long").alias("size"))
    return each.join(sizes, "path").select("path", "line", (F.col("line.bytes") * F.col("copies")).cast("long").alias("weight"), "size")


def similarities(deleted: DataFrame, added: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """from, to, shared, size for the pairs of deleted and added files (path, line, weight, size) that share at least threshold of the larger."""
    both = deleted.withColumn("old", F.lit(True)).unionByName(added.withColumn("old", F.lit(False)))
    rarity = both.groupBy("line").agg(F.count("*").alias("files"), F.bool_or("old").alias("gone"), F.bool_or(~F.col("old")).alias("new"))
    # a line of one side alone is in no pair, but its bytes count
    known = both.join(rarity, "line")
    before = F.sum("weight").over(Window.partitionBy("old", "path").orderBy("files", "line").rowsBetween(Window.unboundedPreceding, -1))
    leading = known.withColumn("before", F.coalesce(before, F.lit(0))).where((F.col("size") - F.col("before") >= threshold * F.col("size")) & F.col("gone") & F.col("new"))
    leading = cut(leading.select("old", "path", "line", "size"))
    a = leading.where("old").select("line", F.col("path").alias("from"), F.col("size").alias("a"))
    b = leading.where("not old").select("line", F.col("path").alias("to"), F.col("size").alias("b"))
    near = (F.least("a", "b") >= threshold * F.greatest("a", "b"))
    pairs = cut(a.join(b, "line").where(near).select("from", "to", F.greatest("a", "b").alias("size")).distinct())
    old = deleted.select(F.col("path").alias("from"), "line", F.col("weight").alias("a"))
    new = added.select(F.col("path").alias("to"), "line", F.col("weight").alias("b"))
    shared = pairs.join(old, "from").join(new, ["to", "line"]).groupBy("from", "to", "size").agg(F.sum(F.least("a", "b")).alias("shared"))
    return shared.where(F.col("shared") >= threshold * F.col("size"))


def greedy_pairs(pairs: DataFrame, *order: Column) -> DataFrame:
    """Pairs (from, to) taken one after the other by order, then from and to, where neither is taken yet."""
    left = cut(pairs.withColumn("_key", F.struct(*(x.alias(f"k{i}") for i, x in enumerate(order)), "from", "to")))
    out = left.limit(0)
    while not left.isEmpty():
        first = lambda side: left.groupBy(side).agg(F.min("_key").alias(f"_{side}"))  # noqa: B023, E731
        best = cut(left.join(first("from"), "from").join(first("to"), "to").where((F.col("_key") == F.col("_from")) & (F.col("_key") == F.col("_to"))).drop("_from", "_to"))
        out = out.unionByName(best)
        left = cut(left.join(best.select("from"), "from", "left_anti").join(best.select("to"), "to", "left_anti"))
    return out.drop("_key")


def renamed(base: DataFrame, head: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """status, path, old_path, similarity of two snapshots (path, content): as snapshot_diff, and R also for a deleted and an added file of threshold or more.

    Files of one content are paired first (similarity 1).  Of the others the most similar pair goes first; of equal ones that of one file name, then by old
    and new path.  Null and empty contents have one empty line: they are alike.  Groups of g deleted and g added files that are all
    alike have g x g pairs, as each has to be measured.
    """
    hashed = lambda df: df.select("path", F.sha2(F.coalesce(F.col("content").cast("string"), F.lit("")), 256).alias("content_hash"))
    exact = cut(snapshot_diff(hashed(base), hashed(head)))
    gone, new = (cut(line_weights(side.join(exact.where(F.col("status") == s).select("path"), "path", "left_semi"))) for side, s in ((base, "D"), (head, "A")))
    same_name = (file_name(F.col("from").cast("string")) != file_name(F.col("to").cast("string"))).cast("int")
    close = similarities(gone, new, threshold).withColumn("similarity", F.col("shared") / F.col("size"))
    pairs = greedy_pairs(close.select("from", "to", "similarity"), -F.col("similarity"), same_name)
    rest = exact.join(pairs.select(F.col("from").alias("path"), F.lit("D").alias("status")), ["path", "status"], "left_anti").join(pairs.select(F.col("to").alias("path"), F.lit("A").alias("status")), ["path", "status"], "left_anti")
    found = pairs.select(F.lit("R").alias("status"), F.col("to").alias("path"), F.col("from").alias("old_path"), F.round("similarity", 6).alias("similarity"))
    return rest.select("status", "path", "old_path", F.when(F.col("status") == "R", F.lit(1.0)).alias("similarity")).unionByName(found)
