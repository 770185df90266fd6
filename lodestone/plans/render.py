"""Relations as documents: text, Markdown and JSON.

Every renderer makes rows (ord, block) by expressions; ``document`` joins them in order. Only that last step brings
the blocks of one document together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.languages import combine_fence, extract_fence, syntax_language
from ..schemas import Metadata
from . import parts

TYPE_ORDER = ("interface", "class", "function", "type", "const", "enum")


def document(blocks: DataFrame, by: list[str] | None = None, separator: str = "\n") -> DataFrame:
    """One text for all blocks, or for each group of ``by``."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "block"))), lambda x: x["block"]), separator)
    return blocks.groupBy(*(by or [])).agg(joined.alias("document"))


def lines(*parts: Column | str) -> Column:
    """Lines joined; null ones are left out."""
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def framed(head: str, blocks: DataFrame, foot: str, by: list[str] | None = None) -> DataFrame:
    """The blocks' document between two fixed texts, or one for each group of ``by``."""
    body = document(blocks, by)
    inner = F.when(F.col("document") == "", "").otherwise(F.concat(F.col("document"), F.lit("\n")))
    return body.select(*(by or []), F.concat(F.lit(head), inner, F.lit(foot)).alias("document"))


def ordered(item: Column) -> Column:
    """An aggregate: the items as an array, by ord."""
    return F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("item")))), lambda x: x["item"])


# -- extract: changes with full_content


def extract_txt(changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    full = lines(F.concat(F.lit('      <content language="'), T.escape_xml(extract_fence(F.col("file"))), F.lit('">')), F.concat(F.lit("<![CDATA["), F.col("full_content"), F.lit("]]>")), "      </content>")
    diff = lines("      <diff>", F.concat(F.lit("<![CDATA["), T.format_diff(F.col("diff")), F.lit("]]>")), "      </diff>")
    tag = lambda name, value: F.concat(F.lit(f"      <{name}>"), value, F.lit(f"</{name}>"))
    block = lines(
        "    <file>",
        tag("path", T.escape_xml(F.col("file"))),
        tag("status", F.col("status")),
        tag("additions", F.col("additions").cast("string")),
        tag("deletions", F.col("deletions").cast("string")),
        F.when(F.col("old_file").isNotNull(), tag("old_path", T.escape_xml(F.col("old_file")))),
        F.when(F.col("full_content").isNotNull(), full).when(F.col("diff") != "", diff),
        "    </file>",
    )
    return framed("<code_context>\n  <changes>\n", changes.select("ord", block.alias("block"), *(by or [])), "  </changes>\n</code_context>", by)


def extract_md(changes: DataFrame, scope: DataFrame, metadata: str | Column | None = None, by: list[str] | None = None) -> DataFrame:
    """``scope`` is a row, or one for each group of ``by``; a metadata expression may use its columns."""
    renamed = F.when(F.col("status") == "renamed", F.concat(F.lit(" (renamed from "), F.col("old_file"), F.lit(")"))).otherwise("")
    fence = F.when(F.col("full_content").isNotNull(), lines(F.concat(F.lit("```"), extract_fence(F.col("file"))), F.col("full_content"), "```")).when(F.col("diff") != "", lines("```diff", T.format_diff(F.col("diff")), "```"))
    block = lines("", F.concat(F.lit("### "), F.col("file"), renamed), fence)
    body = document(changes.select("ord", block.alias("block"), *(by or [])), by)
    summary = F.format_string("## Scope\n- **Files Changed:** %d\n- **Lines:** +%d -%d", "files_changed", "lines_added", "lines_deleted")
    whole = F.concat_ws("\n\n", metadata if isinstance(metadata, Column) else F.lit(metadata), summary, F.when(F.col("files_changed") > 0, F.concat(F.lit("## Changes\n"), F.col("document"))))
    both = body.join(scope, by) if by else body.crossJoin(F.broadcast(scope))  # one row each
    return both.select(*(by or []), whole.alias("document"))


def metadata_column(m: Metadata, tokens: Column) -> Column:
    """The metadata section, with a token count of the same row."""
    before, after = metadata_md(m.repository, m.branch, m.commit, m.generated, m.method, 0, f"{m.tool} Version:** {m.version}", m.path, m.types).split("~0")
    return F.concat(F.lit(before + "~"), F.format_number(tokens, 0), F.lit(after.removesuffix("**")))


def metadata_struct(m: Metadata, tokens: Column) -> Column:
    text = lambda x: F.lit(x).cast("string")
    filters = F.struct(text(m.path).alias("path"), (F.array(*map(F.lit, m.types)) if m.types else F.lit(None).cast("array<string>")).alias("type"))
    return F.struct(
        text(m.generated).alias("generated"),
        F.struct(text(m.repository).alias("name"), text(m.branch).alias("branch"), text(m.commit).alias("commit")).alias("repository"),
        F.struct(text(m.method).alias("method"), (filters if m.path or m.types else F.lit(None).cast("struct<path:string,type:array<string>>")).alias("filters")).alias("extraction"),
        F.struct(tokens.alias("estimated")).alias("tokens"),
        F.struct(text(m.tool).alias("name"), text(m.version).alias("version")).alias("tool"),
    )


def metadata_md(repository: str, branch: str, commit: str, generated: str, method: str, tokens: int, tool: str, path: str | None = None, types: list[str] | None = None) -> str:
    out = ["## Metadata", f"- **Generated:** {generated}", f"- **Repository:** {repository} ({branch})", f"- **Commit:** {commit}", f"- **Extraction Method:** {method}"]
    if path or types:
        out += ["- **Filters:**", *([f"  - Path: {path}"] if path else []), *([f"  - Types: {', '.join(types)}"] if types else [])]
    return "\n".join([*out, f"- **Estimated Tokens:** ~{tokens:,}", f"- **{tool}**"])


def extract_json(changes: DataFrame, scope: DataFrame, metadata: Column | None = None, by: list[str] | None = None) -> DataFrame:
    item = F.struct("file", "status", "additions", "deletions", F.col("old_file").alias("oldFile"), "diff", F.col("full_content").alias("fullContent"))
    items = changes.groupBy(*(by or [])).agg(ordered(item).alias("changes"))
    total = F.struct(F.col("files_changed").alias("filesChanged"), F.col("functions_modified").alias("functionsModified"), F.col("lines_added").alias("linesAdded"), F.col("lines_deleted").alias("linesDeleted"))
    both = items.join(scope, by) if by else items.crossJoin(F.broadcast(scope))
    more = [metadata.alias("metadata")] if metadata is not None else []
    return both.select(*(by or []), F.to_json(F.struct(total.alias("scope"), "changes", *more)).alias("document"))


# -- combine: file, content, ord (and diff, where the content may be missing)


def shown(files: DataFrame) -> Column:
    diff = F.col("diff") if "diff" in files.columns else F.lit(None).cast("string")
    return F.coalesce(F.when(F.col("content") != "", F.col("content")), F.when(diff != "", diff))


def combine_txt_blocks(files: DataFrame) -> DataFrame:
    block = lines(F.concat(F.lit('<file path="'), T.escape_xml(F.col("file")), F.lit('">')), shown(files), "</file>", "")
    return files.withColumn("block", block)


def combine_txt(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    return framed("<code_context>\n\n", combine_txt_blocks(files).select("ord", "block", *(by or [])), "</code_context>", by)


def combine_md_blocks(files: DataFrame) -> DataFrame:
    block = lines(F.concat(F.lit("## "), F.col("file")), "", F.concat(F.lit("```"), combine_fence(F.col("file"))), shown(files), "```", "")
    return files.withColumn("block", block)


def combine_md(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    return framed("# Code Context\n\n", combine_md_blocks(files).select("ord", "block", *(by or [])), "", by)


def combine_pieces(files: DataFrame, fmt: str) -> DataFrame:
    """The document of combine_txt or combine_md, in pieces."""
    if fmt == "md":
        return parts.pieces(combine_md_blocks(files), "# Code Context\n\n")
    return parts.pieces(combine_txt_blocks(files), "<code_context>\n\n", "</code_context>")


def combine_json(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    item = F.struct(F.col("file").alias("path"), "status", F.coalesce(shown(files), F.lit("")).alias("content"), "additions", "deletions")
    both = files.groupBy(*(by or [])).agg(
        ordered(item).alias("files"),
        F.struct(F.count("*").alias("totalFiles"), F.coalesce(F.sum("additions"), F.lit(0)).alias("totalAdditions"), F.coalesce(F.sum("deletions"), F.lit(0)).alias("totalDeletions")).alias("metadata"),
    )
    return both.select(*(by or []), F.to_json(F.struct("files", "metadata")).alias("document"))


# -- distill: parsed files


def import_lines(imports: Column) -> Column:
    return F.array_join(F.transform(imports, lambda i: F.concat(F.lit("import '"), i["source"], F.lit("'\n"))), "")


def export_text(e: Column, docstrings: bool) -> Column:
    """One symbol of the text format: classes and interfaces with their members, all else by its signature."""
    bare = F.regexp_replace(F.trim(e["signature"]), "^export ", "")
    member = lambda kind, end: F.array_join(F.transform(F.filter(e["members"], kind), lambda m: F.concat(F.lit("    "), m["signature"], F.lit(end))), "")
    capture = lambda pattern, word: F.when(e["signature"].rlike(pattern), F.concat(F.lit(f" {word} "), F.regexp_extract(e["signature"], pattern, 1))).otherwise("")
    up_to_brace = r"\s+(.+?)(?:\s*\{|$)"
    constructor = F.slice(F.filter(e["members"], lambda m: m["name"] == "constructor"), 1, 1)
    first = F.array_join(F.transform(constructor, lambda m: F.concat(F.lit("    "), m["signature"], F.lit("\n"))), "")
    interface = F.concat(F.lit("export interface "), e["name"], capture("extends" + up_to_brace, "extends"), F.lit(" {\n"), member(lambda m: F.lit(True), ";\n"), F.lit("}\n"))
    klass = F.concat(F.lit("export class "), e["name"], capture(r"extends\s+(\w+)", "extends"), capture("implements" + up_to_brace, "implements"), F.lit(" {\n"), first, member(lambda m: m["type"] == "property", ";\n"), member(lambda m: (m["type"] == "method") & (m["name"] != "constructor"), "\n"), F.lit("}\n"))
    enum = F.when(bare.contains("enum "), F.concat(F.lit("export "), bare, F.lit("\n"))).otherwise(F.concat(F.lit("export enum "), e["name"], F.lit(" {}\n")))
    body = F.when(e["type"] == "interface", interface).when(e["type"] == "class", klass).when(e["type"] == "enum", enum).otherwise(F.concat(F.lit("export "), bare, F.lit("\n")))
    if not docstrings:
        return body
    doc = F.concat(F.lit("/**\n"), F.array_join(F.transform(F.split(e["docstring"], "\n"), lambda x: F.concat(F.lit(" * "), x)), "\n"), F.lit("\n */\n"))
    return F.concat(F.coalesce(F.when(e["docstring"] != "", doc), F.lit("")), body)


def visible(private: bool) -> Column:
    return F.col("exports") if private else F.filter("exports", lambda e: e["visibility"] != "private")


def by_type(exports: Column) -> Column:
    """Types in their fixed order, unknown ones last; within a type as they were."""
    rank = lambda e: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, TYPE_ORDER)), e["type"]), F.lit(0)), F.lit(99))
    keyed = F.transform(exports, lambda e, i: F.struct(rank(e).alias("r"), i.alias("i"), e.alias("e")))
    ordered = F.array_sort(keyed, lambda a, b: F.when(a["r"] != b["r"], (a["r"] - b["r"]).cast("int")).otherwise(a["i"] - b["i"]))
    return F.transform(ordered, lambda x: x["e"])


def distill_txt_blocks(parsed: DataFrame, private: bool = False, docstrings: bool = True, imports: bool = True, grouped: bool = True) -> DataFrame:
    """A block a file, by folder; two line feeds part them."""
    rows = by_type(visible(private)) if grouped else visible(private)
    text = F.array_join(F.transform(rows, lambda e: export_text(e, docstrings)), "")
    block = F.concat(F.lit('<file path="'), T.clean_path(F.col("file")), F.lit('">\n'), import_lines(F.col("imports")) if imports else F.lit(""), text, F.lit("</file>"))
    folder = F.coalesce(F.nullif(T.directory(F.col("file")), F.lit("")), F.lit("."))
    return parsed.withColumns({"block": block, "ord": F.struct(folder.alias("d"), T.locale_key(F.col("file")).alias("k"), F.col("file"))})


def distill_txt(parsed: DataFrame, private: bool = False, docstrings: bool = True, imports: bool = True, grouped: bool = True, by: list[str] | None = None) -> DataFrame:
    return document(distill_txt_blocks(parsed, private, docstrings, imports, grouped).select("ord", "block", *(by or [])), by, "\n\n")


def distill_md_blocks(parsed: DataFrame, private: bool = False, imports: bool = True) -> DataFrame:
    signatures = F.array_join(F.transform(visible(private), lambda e: F.concat(e["signature"], F.lit("\n"))), "")
    block = F.concat(F.lit("## "), F.col("file"), F.lit("\n\n```"), syntax_language(F.col("file")), F.lit("\n"), import_lines(F.col("imports")) if imports else F.lit(""), signatures, F.lit("```"))
    return parsed.withColumns({"block": block, "ord": F.col("file")})


def distill_md(parsed: DataFrame, private: bool = False, imports: bool = True, by: list[str] | None = None) -> DataFrame:
    return document(distill_md_blocks(parsed, private, imports).select("ord", "block", *(by or [])), by, "\n\n")


def distill_json(parsed: DataFrame, metrics: DataFrame, private: bool = False, docstrings: bool = False, by: list[str] | None = None) -> DataFrame:
    export = lambda e: F.struct(e["name"].alias("name"), e["type"].alias("type"), e["signature"].alias("signature"), e["visibility"].alias("visibility"), (e["docstring"] if docstrings else F.lit(None).cast("string")).alias("docstring"), F.when(F.size(e["members"]) > 0, e["members"]).alias("members"))
    item = F.struct(F.col("file").alias("path"), F.when(F.size("imports") > 0, F.transform("imports", lambda i: i["source"])).alias("imports"), F.transform(visible(private), export).alias("exports"))
    files = parsed.withColumn("ord", F.col("file")).groupBy(*(by or [])).agg(ordered(item).alias("files"))
    meta = F.struct(F.col("file_count").alias("fileCount"), F.col("original_tokens").alias("originalTokens"), F.col("distilled_tokens").alias("distilledTokens"), F.col("compression_ratio").alias("compressionRatio"), "languages")
    both = files.join(metrics, by) if by else files.crossJoin(F.broadcast(metrics))
    return both.select(*(by or []), F.to_json(F.struct("files", meta.alias("metadata"))).alias("document"))


# -- compressed files: file, content, language


def compression_txt(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    language = F.when(F.col("language").isNotNull(), F.concat(F.lit(' language="'), F.col("language"), F.lit('"'))).otherwise("")
    block = F.concat(F.lit('<file path="'), F.col("file"), F.lit('"'), language, F.lit(">\n"), F.col("content"), F.lit("\n</file>\n"))
    return document(files.select("ord", block.alias("block"), *(by or [])), by).select(*(by or []), F.regexp_replace("document", r"\s+$", "").alias("document"))


def compression_md(files: DataFrame, metadata: bool = True, by: list[str] | None = None) -> DataFrame:
    """Files (file, size, hash, language, content, ord) under headings, with their number and size before them."""
    block = F.concat(F.lit("## "), "file", F.lit("\n\n```"), F.coalesce("language", F.lit("txt")), F.lit("\n"), "content", F.lit("\n```\n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", block.alias("block")))), lambda x: x["block"]), "\n")
    both = files.groupBy(*(by or [])).agg(joined.alias("body"), F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("size"))
    summary = F.concat(F.lit("**Total Files:** "), F.col("n").cast("string"), F.lit("\n**Total Size:** "), F.format_number("size", 0), F.lit(" bytes\n\n")) if metadata else F.lit("")
    return both.select(*(by or []), F.regexp_replace(F.concat(F.lit("# Compressed Files\n\n"), summary, "body"), r"\s+$", "").alias("document"))


def compression_json(files: DataFrame, metadata: bool = True, by: list[str] | None = None) -> DataFrame:
    item = F.struct(F.col("file").alias("path"), "size", "hash", "language", "content")
    total = F.struct(F.count("*").alias("totalFiles"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("totalSize"))
    both = files.groupBy(*(by or [])).agg(ordered(item).alias("files"), total.alias("metadata"))
    return both.select(*(by or []), F.to_json(F.struct("files", *(["metadata"] if metadata else []))).alias("document"))


def _beside(a: DataFrame, b: DataFrame, whole: Column, by: list[str] | None) -> DataFrame:
    b = b.withColumnRenamed("document", "d")
    both = a.join(b, by) if by else a.crossJoin(F.broadcast(b))  # one row each
    return both.select(*(by or []), whole.alias("document"))


def combined_txt(files: DataFrame, parsed: DataFrame, by: list[str] | None = None) -> DataFrame:
    return _beside(compression_txt(files, by), distill_txt(parsed, by=by), F.concat_ws("\n\n---\n\n", "document", "d"), by)


def combined_md(files: DataFrame, parsed: DataFrame, by: list[str] | None = None) -> DataFrame:
    return _beside(compression_md(files, by=by), distill_md(parsed, by=by), F.concat_ws("\n\n---\n\n", "document", "d"), by)


def combined_json(files: DataFrame, parsed: DataFrame, metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    whole = F.concat(F.lit('{"compression":'), "document", F.lit(',"distillation":'), "d", F.lit("}"))
    return _beside(compression_json(files, by=by), distill_json(parsed, metrics, by=by), whole, by)


class Formats:
    """Renderers by the name of their format, one of them the default."""

    def __init__(self, default: str):
        self._renderers: dict[str, Callable[..., DataFrame]] = {}
        self._default = default

    def register(self, name: str, renderer: Callable[..., DataFrame]) -> None:
        self._renderers[name] = renderer

    def get(self, name: str) -> Callable[..., DataFrame] | None:
        return self._renderers.get(name)

    def default(self) -> Callable[..., DataFrame]:
        if self._default not in self._renderers:
            raise ValueError(f"the default format {self._default!r} is not registered")
        return self._renderers[self._default]

    def set_default(self, name: str) -> None:
        if name not in self._renderers:
            raise ValueError(f"format {name!r} is not registered")
        self._default = name

    def names(self) -> list[str]:
        return list(self._renderers)
