"""TypeScript that the reader cannot follow is read by lines."""

from __future__ import annotations

import pytest

from lodestone.parsers import parse_source, ts_lines, ts_syntax
from lodestone.schemas import DistillOptions

CUT = """import { a, b as c } from "./m";
  import d from 'n'
import './side';
export const LIMIT = 10;
  export class Store extends Base { x = 1; }
export interface Shape{
export type Id = string;
export enum Level { Low }
export let typeName = "t";
const hidden = 1;
export async function later() {}
export default Store;
export { a };
export function last(x: number): string {
export function"""


def test_lines_give_names_kinds_and_signatures():
    out = ts_lines.parse(CUT)
    assert [(i.source, i.specifiers, i.line) for i in out.imports] == [("./m", [], 1), ("n", [], 2)]
    assert [(e.name, e.kind, e.signature, e.line) for e in out.exports] == [
        ("LIMIT", "const", "export const LIMIT = 10;", 4),
        ("Store", "class", "export class Store extends Base", 5),
        ("Shape", "interface", "export interface Shape", 6),
        ("Id", "type", "export type Id = string;", 7),
        ("Level", "enum", "export enum Level", 8),
        ("typeName", "type", 'export let typeName = "t";', 9),
        ("last", "function", "export function last(x: number): string", 14),
    ]
    assert not out.errors and not out.skipped and all(e.visibility == "public" for e in out.exports)


@pytest.mark.parametrize("source", ["export function", "import { a } from 'm';\nexport const ok = 1;\nexport enum E { A }\nexport function"])
def test_sources_cut_off_are_no_errors(source):
    with pytest.raises(IndexError):
        ts_syntax._Reader(source, DistillOptions()).read()
    out = parse_source("a.ts", source, DistillOptions())
    assert not out.errors and out.exports == ts_lines.parse(source).exports


def test_every_beginning_of_a_source_is_read():
    whole = "import { a } from 'm';\nexport abstract class A<T> extends B { private x = 1; get y(): string { return 'a' } }\nexport const f = (a: number): void => {};\nexport * from './x';\n"
    assert not any(parse_source("a.ts", whole[:n], DistillOptions()).errors for n in range(len(whole)))
