"""An index of source files that grows commit by commit: only contents that the parent has not are parsed, only references that can differ are bound.

Tables under root, written in this order for each commit, the manifest last, so that a commit without one is as good as not begun:

* rows/commit=c: parsed rows by blob, a key of content, and generation, c.  A manifest names for each blob the commit that holds its rows; a blob that
  went and came back has rows of two generations, of which that one counts.
* references/commit=c: each use with the id it wants and, where that symbol exists, its target.
* manifest/commit=c: path, blob, generation (the commit of its rows), parsed and rebound (whether this commit did that for the path).

A file's uses are bound again if its blob is new to the path or a module that it imports now leads elsewhere.  All other uses keep what they want; of
those only the ones that want a symbol which came or went change their target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delve.functions.text import file_name
from delve.operators import extract
from delve.sources.files import is_written

#: A commit whose parent's blobs lie in as many generations of rows as this writes them anew.
GENERATIONS = 16
ROWS = extract.ROWS.replace("path string", "blob string, generation string", 1)
MAIN = "/__main__.py"
MANIFEST = "path string, blob string, generation string, parsed boolean, rebound boolean"
REFERENCES = "path string, line int, kind string, name string, enclosing string, wanted string, target string, confidence string"


def blob_key(content: str = "content"):
    """What decides a file's rows but for its path: a hash of its content, and whether its name makes it an entry point."""
    return F.concat(F.sha2(F.coalesce(F.col(content).cast("binary"), F.lit(b"")), 256), F.when(file_name(F.col("path")) == "__main__.py", MAIN).otherwise(""))


class Snapshot:
    """The index as of one commit."""

    def __init__(self, spark: SparkSession, root: str, commit: str):
        self.spark, self.root, self.commit = spark, root, commit
        self.manifest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest/commit={commit}")

    @property
    def rows(self) -> DataFrame:
        return self.rows_of(self.manifest)

    def rows_of(self, files: DataFrame) -> DataFrame:
        """The rows of some files (path, blob, generation), in the columns of extract.ROWS."""
        return _rows(self.spark, self.root, self.generations(), files)

    def generations(self) -> list[str]:
        """The commits that hold rows of this one's blobs, GENERATIONS and its own at most."""
        return sorted(r.generation for r in self.manifest.select("generation").distinct().collect())

    @property
    def symbols(self) -> DataFrame:
        return extract.symbols(self.rows)

    @property
    def imports(self) -> DataFrame:
        return extract.resolve_imports(self.rows, self.manifest)

    @property
    def references(self) -> DataFrame:
        return self.spark.read.schema(REFERENCES).parquet(f"{self.root}/references/commit={self.commit}")


def _rows(spark: SparkSession, root: str, generations: list[str], files: DataFrame) -> DataFrame:
    names = [x.split()[0] for x in extract.ROWS.split(", ")]
    if not generations:
        return spark.createDataFrame([], extract.ROWS)
    held = spark.read.schema(ROWS).parquet(*(f"{root}/rows/commit={g}" for g in generations))
    return held.join(files.select("path", "blob", "generation"), ["blob", "generation"]).select(*names)


class IncrementalIndex:
    """Snapshots under root, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, generations: int = GENERATIONS):
        self.spark, self.root, self.most = spark, root.rstrip("/"), generations

    def at(self, commit: str) -> Snapshot:
        return Snapshot(self.spark, self.root, commit)

    def _write(self, df: DataFrame, table: str, commit: str) -> DataFrame:
        path = f"{self.root}/{table}/commit={commit}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def add(self, commit: str, files: DataFrame, parent: str | None = None) -> Snapshot:
        """The snapshot of files (path, content, perhaps blob: a key of their own), on top of its parent's; as stored, if the commit has been added.

        Null content is empty.  A path that is null or stands twice is refused; other columns of files are left out.
        """
        if is_written(self.spark, f"{self.root}/manifest/commit={commit}"):
            return self.at(commit)
        if parent is not None and not is_written(self.spark, f"{self.root}/manifest/commit={parent}"):
            raise ValueError(f"the parent {parent} of {commit} has not been added")
        own = files.select("path", (F.col("blob") if "blob" in files.columns else blob_key()).alias("blob"), "content")
        paths = self._write(own.select("path", "blob"), "paths", commit)
        if not paths.groupBy("path").count().where("count > 1 or path is null").isEmpty():
            raise ValueError("a snapshot holds each path once")
        before = self.at(parent).manifest if parent is not None else self.spark.createDataFrame([], MANIFEST)
        blobs = paths.select("blob").distinct().join(before.select("blob", "generation").distinct(), "blob", "left")
        blobs = self._write(blobs, "blobs", commit)
        kept = sorted(r.generation for r in blobs.where("generation is not null").select("generation").distinct().collect())  # at most self.most

        # one path stands for all that hold a new blob, so that it is parsed once
        one = paths.join(blobs.where("generation is null"), "blob", "left_semi").groupBy("blob").agg(F.min("path").alias("path"))
        fresh = own.select("path", "content").join(one, "path").select(F.col("blob").alias("path"), "content")
        parsed = extract.extract_files(fresh).withColumnRenamed("path", "blob")
        whole = len(kept) >= self.most
        if whole:
            held = self.spark.read.schema(ROWS).parquet(*(f"{self.root}/rows/commit={g}" for g in kept))
            parsed = parsed.unionByName(held.join(blobs.where("generation is not null"), ["blob", "generation"], "left_semi").drop("generation"))
        self._write(parsed.withColumn("generation", F.lit(commit)), "rows", commit)
        now = blobs.select("blob", (F.lit(commit) if whole else F.coalesce("generation", F.lit(commit))).alias("generation"), F.col("generation").isNull().alias("parsed"))
        manifest = paths.join(now, "blob").join(before.select("path", F.col("blob").alias("old_blob")), "path", "left")
        manifest = self._write(manifest.withColumn("changed", ~F.col("blob").eqNullSafe(F.col("old_blob"))), "changes", commit)
        generations = [commit] if whole else [*kept, commit]

        references, rebound = self._references(manifest, generations, before, parent)
        self._write(references.select(*(x.split()[0] for x in REFERENCES.split(", "))), "references", commit)
        marked = manifest.join(rebound.withColumn("rebound", F.lit(True)), "path", "left")
        self._write(marked.select("path", "blob", "generation", "parsed", F.coalesce("rebound", F.lit(False)).alias("rebound")), "manifest", commit)
        return self.at(commit)

    def _references(self, manifest: DataFrame, generations: list[str], before: DataFrame, parent: str | None) -> tuple[DataFrame, DataFrame]:
        """The references of manifest's files, and the paths of those that were bound anew."""
        rows_of = lambda files: _rows(self.spark, self.root, generations, files)
        changed = manifest.where("changed")
        if parent is None:
            rows = rows_of(manifest)
            return extract.with_targets(extract.bind_references(rows, manifest), extract.symbols(rows)), manifest.select("path")
        last = self.at(parent)
        old = extract.module_targets(before).withColumnRenamed("target", "old")
        moved = old.join(extract.module_targets(manifest), "module", "full").where(~F.col("old").eqNullSafe(F.col("target"))).select("module")
        named = extract.named_imports(rows_of(manifest.where("not changed"))).select("path", F.explode(F.array("module", "submodule")).alias("module"))
        rebound = changed.select("path").unionByName(named.join(moved, "module", "left_semi").select("path")).distinct()
        bound = extract.bind_references(rows_of(manifest.join(rebound, "path", "left_semi")), manifest)
        anew = extract.with_targets(bound, extract.symbols(rows_of(manifest)))

        ids = lambda rows: extract.symbols(rows).select("id").distinct()
        gone_or_changed = before.join(manifest.where("not changed"), "path", "left_anti")
        was, now = ids(last.rows_of(gone_or_changed)).withColumn("was", F.lit(True)), ids(rows_of(changed)).withColumn("now", F.lit(True))
        other = was.join(now, "id", "full").where("was is null or now is null").select(F.col("id").alias("wanted"), F.col("now").isNotNull().alias("exists"))
        still = last.references.join(manifest.select("path"), "path", "left_semi").join(rebound, "path", "left_anti").join(other, "wanted", "left")
        target = F.when(F.col("exists").isNull(), F.col("target")).when(F.col("exists"), F.col("wanted"))
        still = still.withColumn("target", target).withColumn("confidence", extract.confidence()).drop("exists")
        return anew.unionByName(still), rebound
