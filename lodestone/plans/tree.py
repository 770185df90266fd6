"""Trees of symbols: by file, by type, or flat."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..schemas import DistillOptions, TreeOptions
from ..sources.tables import stored
from . import distill, parts
from .render import document

#: Order within a file and of the flat list: classes come last, with unknown types.
FLAT_ORDER = ("function", "interface", "type", "const", "enum")
GROUP_ORDER = ("class", "interface", "type", "function", "const", "enum")


def rank(order: tuple[str, ...]) -> Column:
    at = F.array_position(F.array(*map(F.lit, order)), F.col("type"))
    return F.when(at > 0, at).otherwise(99)


def visible(symbols: DataFrame, options: TreeOptions) -> DataFrame:
    return symbols if options.include_private else symbols.where("visibility <> 'private' AND NOT startswith(name, '_')")


def label(show_types: bool) -> Column:
    signature = F.when(F.col("signature") != "", F.concat(F.lit(" "), F.col("signature"))).otherwise("") if show_types else F.lit("")
    return F.concat(F.col("name"), signature)


def private_mark() -> Column:
    return F.when(F.col("visibility") == "private", " [private]").otherwise("")


def is_last(*partition: str, order: list[Column]) -> Column:
    return F.lead(F.lit(1)).over(W.partitionBy(*partition).orderBy(*order)).isNull()


def branch(last: Column) -> Column:
    return F.when(last, "└── ").otherwise("├── ")


def stem(last: Column) -> Column:
    return F.when(last, "    ").otherwise("│   ")


def skeleton(files: DataFrame) -> DataFrame:
    """Every folder and file of the paths: path, parent, name, is_file, is_last, and prefix: what stands before a
    line of its children, made of its ancestors' and its own place among their siblings. Folders come before files, in the
    locale's order; files follow by code."""
    parts = files.select("file").distinct().select(F.filter(F.split("file", "/"), lambda x: x != "").alias("p"))
    nodes = parts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.struct(F.array_join(F.slice("p", F.lit(1), k), "/").alias("path"), F.array_join(F.slice("p", F.lit(1), k - 1), "/").alias("parent"), F.get("p", k - 1).alias("name"), (k == F.size("p")).alias("is_file"), k.alias("depth")))).alias("n")).select("n.*").distinct()
    # the last of each folder by an aggregate, which a folder of very many entries does not gather in a task
    nodes = nodes.withColumn("sort", F.when(~F.col("is_file"), T.locale_key(F.col("name"))))
    ends = nodes.groupBy("parent").agg(F.max_by("path", F.struct("is_file", "sort", "name")).alias("path")).select("path", F.lit(True).alias("ends"))
    nodes = nodes.join(ends, "path", "left").withColumn("is_last", F.coalesce("ends", F.lit(False))).drop("ends")
    ups = nodes.select("path", "depth", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("depth")), lambda k: F.array_join(F.slice(F.split("path", "/"), F.lit(1), k), "/"))).alias("k", "up"))
    marks = nodes.select(F.col("path").alias("up"), stem(F.col("is_last")).alias("s"), F.struct(F.col("is_file").alias("f"), F.col("sort").alias("s"), F.col("name").alias("n")).alias("key"))
    grown = ups.join(marks, "up").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("k", "s", "key"))).alias("a"))
    grown = grown.select("path", F.array_join(F.transform("a", lambda x: x["s"]), "").alias("prefix"), F.transform("a", lambda x: x["key"]).alias("key"))
    return nodes.drop("sort").join(grown, "path")


def tree_lines(symbols: DataFrame, options: TreeOptions | None = None) -> DataFrame:
    """The tree's lines below its root, as blocks (ord, block): parts.numbered or parts.pieces put them in order over many
    tasks."""
    options = options or TreeOptions()
    rows = visible(symbols, options)
    nodes = skeleton(rows)
    own = F.left("prefix", F.greatest(F.length("prefix") - 4, F.lit(0)))
    none = F.array().cast("array<string>")
    heads = nodes.select(F.struct("key", F.lit(0).alias("i"), F.lit(0).alias("j")).alias("ord"), F.concat(own, branch(F.col("is_last")), "name", F.when(F.col("is_file"), "").otherwise("/")).alias("block"))
    order = [rank(FLAT_ORDER), F.col("type"), F.col("name"), F.col("ord")]
    placed = rows.withColumns({"i": F.row_number().over(W.partitionBy("file").orderBy(*order)), "last": is_last("file", order=order)})
    placed = placed.join(nodes.where("is_file").select("path", "prefix", "key"), F.array_join(F.filter(F.split("file", "/"), lambda x: x != ""), "/") == F.col("path"))
    doc = F.when(F.col("docstring") != "", F.array(F.concat("prefix", stem(F.col("last")), T.preview(F.col("docstring"), 80)))).otherwise(none)
    text = F.concat(F.array(F.concat("prefix", branch(F.col("last")), label(options.show_types), private_mark())), doc)
    leaves = placed.select("key", "i", F.posexplode(text).alias("j", "block")).select(F.struct("key", "i", "j").alias("ord"), "block")
    return heads.unionByName(leaves)


def tree_by_file(symbols: DataFrame, root: str = ".", options: TreeOptions | None = None) -> DataFrame:
    """The tree as one text, for symbols of which one text can hold them all."""
    body = document(tree_lines(symbols, options))
    return body.select(F.concat_ws("\n", F.lit(root), F.nullif("document", F.lit(""))).alias("document"))


def tree_by_type(symbols: DataFrame, options: TreeOptions | None = None, by: list[str] | None = None) -> DataFrame:
    """One document, or one for each group of ``by``."""
    by = by or []
    options = options or TreeOptions(group_by="type")
    rows = visible(symbols, options)
    order = [F.col("name"), F.col("file"), F.col("ord")]
    line = F.concat(branch(is_last(*by, "type", order=order)), label(options.show_types), F.lit(" "), F.col("file"), private_mark())
    groups = rows.withColumn("line", line).groupBy(*by, "type").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("name", "file", "ord", "line"))), lambda x: x["line"]).alias("lines"))
    at = rank(GROUP_ORDER)
    groups = groups.withColumns({"r": at, "last": F.lead(F.lit(1)).over(W.partitionBy(*by).orderBy(at, "type")).isNull()})  # one row a type
    head = F.format_string("%s%s (%d)", branch(F.col("last")), F.upper("type"), "n")
    text = F.concat_ws("\n", F.array(head), F.transform("lines", lambda x: F.concat(stem(F.col("last")), x)), F.when(~F.col("last"), F.array(F.lit("│"))))
    body = document(groups.select(F.struct("r", "type").alias("ord"), text.alias("block"), *by), by)
    return body.select(*by, F.concat_ws("\n", F.lit("APIs by Type"), F.nullif("document", F.lit(""))).alias("document"))


def tree_flat(symbols: DataFrame, options: TreeOptions | None = None, by: list[str] | None = None) -> DataFrame:
    """One line a symbol, in one document or in one for each group of ``by``. A document is one text, so its lines' order is
    taken in one task."""
    by = by or []
    options = options or TreeOptions(group_by="none")
    rows = visible(symbols, options)
    none = F.array().cast("array<string>")
    keyed = rows.select(*by, F.struct(rank(FLAT_ORDER).alias("r"), "type", "name", "file", "ord", F.concat(label(options.show_types), F.lit(" "), "file", private_mark()).alias("text"), F.when(F.col("docstring") != "", T.preview(F.col("docstring"), 100)).alias("doc")).alias("s"))
    whole = keyed.groupBy(*by).agg(F.array_sort(F.collect_list("s")).alias("all"))
    one = lambda s, last: F.concat(F.array(F.concat(branch(last), s["text"])), F.when(s["doc"].isNotNull(), F.array(F.concat(stem(last), s["doc"]))).otherwise(none))
    lines = F.flatten(F.transform("all", lambda s, i: one(s, i == F.size("all") - 1)))
    return whole.select(*by, F.array_join(F.concat(F.array(F.lit("All APIs")), lines), "\n").alias("document"))


def outline(symbols: DataFrame, options: TreeOptions | None = None, by: list[str] | None = None) -> DataFrame:
    """Markdown: a heading a file, a bullet a symbol."""
    by = by or []
    options = options or TreeOptions()
    rows = visible(symbols, options)
    bullet = F.concat(F.lit("- "), label(options.show_types), private_mark())
    files = document(rows.select("file", *by, F.struct(rank(FLAT_ORDER).alias("r"), "type", "name", "ord").alias("ord"), bullet.alias("block")), by=["file", *by])
    return document(files.select(F.col("file").alias("ord"), F.concat(F.lit("## "), "file", F.lit("\n\n"), "document", F.lit("\n")).alias("block"), *by), by)


def write_tree(symbols: DataFrame, path: str, root: str = ".", options: TreeOptions | None = None) -> str:
    """Writes the tree by file to one file, over many tasks."""
    lines = tree_lines(symbols, options)
    top = symbols.sparkSession.range(1).select(F.lit(None).cast(lines.schema["ord"].dataType).alias("ord"), F.lit(root).alias("block"))
    return parts.write(parts.pieces(top.unionByName(lines)), path)


def tree_path(spark: SparkSession, path: str, options: TreeOptions | None = None) -> DataFrame:
    """The tree of a folder's symbols, without the files that options.exclude names; also written to options.output, if
    given."""
    options = options or TreeOptions()
    reading = DistillOptions(exclude=options.exclude, private=True)
    symbols = distill.symbols(stored(distill.parse(distill.scan(spark, path, reading).select("file", "content"), reading), "parsed"))
    root = os.path.basename(os.path.abspath(path))
    document = tree(symbols, root, options)
    if options.output and options.group_by == "file" and not options.outline:
        write_tree(symbols, os.path.abspath(options.output), root, options)
    elif options.output:
        with open(options.output, "w", encoding="utf-8") as f:
            f.write(document.first().document)
    return document


def tree(symbols: DataFrame, root: str = ".", options: TreeOptions | None = None) -> DataFrame:
    options = options or TreeOptions()
    if options.outline:
        return outline(symbols, options)
    return tree_by_file(symbols, root, options) if options.group_by == "file" else tree_by_type(symbols, options) if options.group_by == "type" else tree_flat(symbols, options)
