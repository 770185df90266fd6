"""Language parsers: source text to imports, exported symbols, skipped items and errors.

A parser is a function parse(source, options) -> Parsed. ``register`` adds one for some extensions; ``parse_files``
applies them to a relation of files in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..schemas import DistillOptions


@dataclass
class Member:
    name: str
    kind: str
    signature: str
    private: bool = False
    protected: bool = False


@dataclass
class Export:
    name: str
    kind: str
    signature: str
    visibility: str = "public"
    line: int = 0
    depth: int = 0
    docstring: str | None = None
    members: list[Member] = field(default_factory=list)


@dataclass
class Import:
    source: str
    specifiers: list[str]
    line: int


@dataclass
class Parsed:
    imports: list[Import] = field(default_factory=list)
    exports: list[Export] = field(default_factory=list)
    skipped: list[tuple[str, str, int]] = field(default_factory=list)
    errors: list[tuple[str, int, str]] = field(default_factory=list)


#: Kinds of symbols in the result; any other is a const.
KINDS = ("function", "class", "interface", "type", "enum")


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    parse: Callable[[str, DistillOptions], Parsed]
    initialize: Callable[[], None] | None = None
    """Called once in each process, before its first source."""


#: Languages that are initialized in this process.
_ready: set[str] = set()
_languages: dict[str, Language] = {}


def register(language: Language) -> None:
    _languages[language.name] = language


def unregister(name: str) -> None:
    _languages.pop(name, None)
    _ready.discard(name)


def registered_languages() -> list[Language]:
    return list(_languages.values())


def use(languages: list[Language]) -> None:
    """Registers, in a worker, what the driver has registered."""
    for x in languages:
        register(x)


def initialize(language: Language) -> None:
    if language.name not in _ready:
        if language.initialize:
            language.initialize()
        _ready.add(language.name)


def initialize_all() -> None:
    for x in registered_languages():
        initialize(x)


def is_initialized(name: str) -> bool:
    return name in _ready


def registered() -> list[str]:
    return list(_languages)


def language_for(path: str) -> Language | None:
    ext = "." + path.rsplit(".", 1)[-1].lower() if "." in path else ""
    return next((x for x in _languages.values() if ext in x.extensions), None)


def parse_source(path: str, source: str, options: DistillOptions) -> Parsed:
    """Never fails: what a parser raises becomes an error row, as does a file of no known language."""
    language = language_for(path)
    if language is None:
        return Parsed(errors=[(f"no language for {path}", 0, "error")])
    try:
        initialize(language)
        return language.parse(source, options)
    except Exception as e:  # noqa: BLE001  one file must not end the job
        return Parsed(errors=[(f"{type(e).__name__}: {e}", 0, "error")])


_MEMBER = pa.struct([("name", pa.string()), ("signature", pa.string()), ("type", pa.string())])
_EXPORT = pa.struct([("name", pa.string()), ("type", pa.string()), ("signature", pa.string()), ("docstring", pa.string()), ("visibility", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("members", pa.list_(_MEMBER))])
_IMPORT = pa.struct([("source", pa.string()), ("specifiers", pa.list_(pa.struct([("name", pa.string())]))), ("line", pa.int32())])
_SKIPPED = pa.struct([("name", pa.string()), ("reason", pa.string()), ("line", pa.int32())])
_ERROR = pa.struct([("message", pa.string()), ("line", pa.int32()), ("severity", pa.string())])
_PARTS = [("imports", pa.list_(_IMPORT)), ("exports", pa.list_(_EXPORT)), ("skipped", pa.list_(_SKIPPED)), ("errors", pa.list_(_ERROR))]
SCHEMA = (
    "file string, imports array<struct<source:string,specifiers:array<struct<name:string>>,line:int>>, "
    "exports array<struct<name:string,type:string,signature:string,docstring:string,visibility:string,start_line:int,end_line:int,members:array<struct<name:string,signature:string,type:string>>>>, "
    "skipped array<struct<name:string,reason:string,line:int>>, errors array<struct<message:string,line:int,severity:string>>"
)


def as_row(path: str, parsed: Parsed, compat: bool = False) -> dict:
    """The parsed file as one nested row: unknown kinds are consts, members properties or methods."""
    exports = [
        {"name": e.name, "type": e.kind if e.kind in KINDS else "const", "signature": e.signature, "docstring": None if compat else e.docstring, "visibility": e.visibility, "start_line": e.line, "end_line": e.line,
         "members": [{"name": m.name, "signature": m.signature, "type": "property" if m.kind == "property" else "method"} for m in e.members]}
        for e in parsed.exports
    ]
    imports, skipped, errors = _others(parsed)
    return {"file": path, "imports": imports, "exports": exports, "skipped": skipped, "errors": errors}


def _others(parsed: Parsed) -> tuple[list[dict], list[dict], list[dict]]:
    """Imports, skipped items and errors as rows."""
    imports = [{"source": i.source, "specifiers": [{"name": s} for s in i.specifiers], "line": i.line} for i in parsed.imports]
    skipped = [dict(zip(("name", "reason", "line"), s, strict=True)) for s in parsed.skipped]
    errors = [dict(zip(("message", "line", "severity"), e, strict=True)) for e in parsed.errors]
    return imports, skipped, errors


def _lists(counts: list[int], kind: pa.StructType, *columns: list) -> pa.Array:
    """Lists of structs of so many items each, by column."""
    items = pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(counts)], pa.int32()), items, type=pa.list_(kind))


def as_batch(read: list[tuple[str | None, Parsed]], compat: bool = False) -> pa.RecordBatch:
    """as_row of each (file, parsed), built by column, as a file can have hundreds of members."""
    exports = [e for _, p in read for e in p.exports]
    members = [m for e in exports for m in e.members]
    member_lists = _lists([len(e.members) for e in exports], _MEMBER, [m.name for m in members], [m.signature for m in members], ["property" if m.kind == "property" else "method" for m in members])
    lines = [e.line for e in exports]
    export_lists = _lists(
        [len(p.exports) for _, p in read], _EXPORT, [e.name for e in exports], [e.kind if e.kind in KINDS else "const" for e in exports], [e.signature for e in exports],
        [None if compat else e.docstring for e in exports], [e.visibility for e in exports], lines, lines, member_lists,
    )
    imports, skipped, errors = zip(*(_others(p) for _, p in read), strict=True)
    kinds = dict(_PARTS)
    columns = [pa.array([f for f, _ in read], pa.string()), pa.array(imports, kinds["imports"]), export_lists, pa.array(skipped, kinds["skipped"]), pa.array(errors, kinds["errors"])]
    return pa.RecordBatch.from_arrays(columns, schema=pa.schema([("file", pa.string()), *_PARTS]))


#: Rows and bytes of a batch that goes to a worker, and files and characters of source that it holds parsed at a time.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
HELD_FILES, HELD_CHARS = 100, 1 << 19


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, unless it has lower bounds already."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        number, unit = re.match(r"(-?\d+)([kmgtp]?)", spark.conf.get(key).lower()).groups()
        if not 0 < int(number) << 10 * " kmgtp".index(unit or " ") <= most:
            spark.conf.set(key, str(most))


def read_rows(batches: Iterator[pa.RecordBatch], read: Callable[[str | None, str], object], schema: pa.Schema, made: Callable[[list], pa.RecordBatch] | None = None) -> Iterator[pa.RecordBatch]:
    """read(file, content) of each row, given on every few files, so that no worker holds a whole batch parsed. ``made`` makes a
    batch of what is read, which else are rows."""
    made = made or (lambda rows: pa.RecordBatch.from_pylist(rows, schema=schema))
    for batch in batches:
        rows, chars = [], 0
        for f, c in zip(batch.column(0), batch.column(1), strict=True):
            content = c.as_py() or ""
            rows.append(read(f.as_py(), content))
            chars += len(content)
            if len(rows) == HELD_FILES or chars >= HELD_CHARS:
                yield made(rows)
                rows, chars = [], 0
        if rows:
            yield made(rows)


def parse_files(files: DataFrame, options: DistillOptions | None = None) -> DataFrame:
    """files (file, content) to one nested row a file. Row-local, so it works on streams as well."""
    options = options or DistillOptions()
    languages = registered_languages()
    small_batches(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use(languages)
        yield from read_rows(batches, lambda f, c: (f, parse_source(f, c, options)), pa.schema([("file", pa.string()), *_PARTS]), lambda read: as_batch(read, options.compat))

    return files.select("file", "content").mapInArrow(run, SCHEMA)


def _defaults() -> None:
    from . import python_lines, ts_lines, ts_syntax, ts_tree, ts_types

    readers = {"declared": ts_syntax.parse, "written": ts_tree.parse, "inferred": ts_types.parse}

    def typescript(source: str, options: DistillOptions) -> Parsed:
        """A source that its reader cannot follow is read by lines."""
        try:
            return readers[options.types](source, options)
        except Exception:  # noqa: BLE001  whatever a source holds
            return ts_lines.parse(source)

    register(Language("python", (".py", ".pyi", ".pyw"), python_lines.parse))
    register(Language("typescript", (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"), typescript))


_defaults()
