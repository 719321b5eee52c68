"""A code base as a graph: nodes, edges, exports and unresolved imports, each a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import globs, paths
from graphloom.shared import written

NODES = "id BIGINT, path STRING, language STRING, is_entry_point BOOLEAN"
EDGES = "src BIGINT, dst BIGINT, imported_names ARRAY<STRING>, is_type_only BOOLEAN, is_mod_declaration BOOLEAN, line BIGINT"
EXPORTS = "file_id BIGINT, exported_name STRING, is_default BOOLEAN, is_reexport BOOLEAN, is_type_only BOOLEAN, source_path STRING, line BIGINT"
UNRESOLVED = "file_id BIGINT, import_path STRING, kind STRING, detail STRING, line BIGINT"


def build_edges(rows: DataFrame) -> DataFrame:
    """One edge per (src, dst) from rows (src, dst, name, is_type_only, is_mod_declaration, line).

    Names are a bag (sorted, so that results don't depend on order); type-only if all rows are, a module declaration if
    any is, the line is the first.
    """
    return rows.groupBy("src", "dst").agg(
        F.sort_array(F.collect_list("name")).alias("imported_names"),
        F.bool_and("is_type_only").alias("is_type_only"),
        F.bool_or("is_mod_declaration").alias("is_mod_declaration"),
        F.min("line").alias("line"),
    )


@dataclass(frozen=True)
class CodeGraph:
    """Files as nodes, imports as edges. All members are lazy; every method returns new frames."""

    nodes: DataFrame
    edges: DataFrame
    exports: DataFrame
    unresolved: DataFrame

    @classmethod
    def empty(cls, spark) -> "CodeGraph":
        return cls(*(spark.createDataFrame([], s) for s in (NODES, EDGES, EXPORTS, UNRESOLVED)))

    def stored(self) -> "CodeGraph":
        """The same graph with its tables written to the shared folder: for plans that read them several times."""
        return CodeGraph(written(self.nodes, "nodes"), written(self.edges, "graph-edges"), written(self.exports, "exports"), written(self.unresolved, "unresolved"))

    @property
    def known_edges(self) -> DataFrame:
        """Edges with both ends among the nodes."""
        ids = self.nodes.select("id")
        return self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")

    def with_nodes(self, more: DataFrame) -> "CodeGraph":
        return replace(self, nodes=self.nodes.unionByName(more))

    def with_edges(self, more: DataFrame) -> "CodeGraph":
        return replace(self, edges=self.edges.unionByName(more))

    def with_unresolved(self, more: DataFrame) -> "CodeGraph":
        return replace(self, unresolved=self.unresolved.unionByName(more))

    def without_type_only(self) -> "CodeGraph":
        return replace(self, edges=self.edges.where("not is_type_only"))

    def without_mod_declarations(self) -> "CodeGraph":
        return replace(self, edges=self.edges.where("not is_mod_declaration"))

    def filtered(self, glob: str) -> "CodeGraph":
        """The subgraph of files that match; edges need both ends."""
        nodes = self.nodes.where(globs.matches_glob(F.col("path"), glob))
        ids = nodes.select("id")
        edges = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        own = ids.withColumnRenamed("id", "file_id")
        return CodeGraph(nodes, edges.select(*self.edges.columns), self.exports.join(own, "file_id", "left_semi").select(*self.exports.columns), self.unresolved.join(own, "file_id", "left_semi").select(*self.unresolved.columns))

    def imports_of(self, file_id: int) -> DataFrame:
        return self.edges.where(F.col("src") == file_id).select(F.col("dst").alias("id")).distinct().orderBy("id")

    def importers_of(self, file_id: int) -> DataFrame:
        return self.edges.where(F.col("dst") == file_id).select(F.col("src").alias("id")).distinct().orderBy("id")

    def entry_points(self) -> DataFrame:
        return self.nodes.where("is_entry_point")

    def with_unresolved_imports(self) -> DataFrame:
        """Files that have any."""
        return self.unresolved.select("file_id").distinct()

    def counts(self) -> DataFrame:
        """One row: files, imports, unresolved, exports."""
        one = [d.agg(F.count("*").alias(n)) for d, n in ((self.nodes, "file_count"), (self.edges, "import_count"), (self.unresolved, "unresolved_count"), (self.exports, "export_count"))]
        return one[0].select("file_count", *(d.scalar().alias(n) for d, n in zip(one[1:], ("import_count", "unresolved_count", "export_count"))))


@dataclass(frozen=True)
class SymbolGraph:
    """Symbols, and references between them."""

    symbols: DataFrame
    refs: DataFrame

    @classmethod
    def build(cls, symbols: DataFrame, refs: DataFrame) -> "SymbolGraph":
        """Keeps references whose two ends exist."""
        ids = symbols.select("id")
        kept = refs.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
        return cls(symbols, kept.select(*refs.columns))

    def merged(self, symbols: DataFrame, refs: DataFrame) -> "SymbolGraph":
        return SymbolGraph(self.symbols.unionByName(symbols), self.refs.unionByName(refs))

    def without_file(self, file_id: int) -> "SymbolGraph":
        """Without a file's symbols and all references that touch them."""
        gone = self.symbols.where(F.col("file_id") == file_id).select("id")
        refs = self.refs.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
        return SymbolGraph(self.symbols.where(F.col("file_id") != file_id), refs.select(*self.refs.columns))

    def callers(self, symbol: int) -> DataFrame:
        return self.refs.where(F.col("target_id") == symbol).select(F.col("source_id").alias("id"))

    def callees(self, symbol: int) -> DataFrame:
        return self.refs.where(F.col("source_id") == symbol).select(F.col("target_id").alias("id"))

    @property
    def edges(self) -> DataFrame:
        return self.refs.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))


def entry_points_by_annotation(imports: DataFrame, annotations: list[str]) -> DataFrame:
    """(file_id) of files with an ``@annotation:`` import of one of ``annotations``."""
    return imports.where(F.col("source_path").isin([f"@annotation:{a}" for a in annotations])).select("file_id").distinct()


def mark_entry_points(files: DataFrame, annotated: DataFrame | None = None, patterns: list[str] = (), root: str = "") -> DataFrame:
    """Adds ``is_entry_point``: by name, by glob on the path below ``root``, or by annotation."""
    rel = paths.relative(F.col("path"), root) if root else F.col("path")
    by_name: Column = paths.is_entry_point(rel)
    for p in patterns:
        by_name = by_name | globs.matches_glob(rel, p)
    if annotated is None:
        return files.withColumn("is_entry_point", by_name)
    marked = files.join(annotated.select(F.col("file_id").alias("_f")).distinct(), F.col("id") == F.col("_f"), "left")
    return marked.withColumn("is_entry_point", by_name | F.col("_f").isNotNull()).drop("_f")


def find_file(files: DataFrame, path: str, root: str = "") -> DataFrame:
    """The file at ``path``, else one whose path ends with it by whole components; ties: the smaller path. At most one row."""
    full = f"{root.rstrip('/')}/{path}" if root else path
    p = F.col("path")
    exact = (p == full) | (p == path)
    return files.where(exact | p.endswith("/" + path)).withColumn("_e", exact).orderBy(F.desc("_e"), "path").limit(1).drop("_e")
