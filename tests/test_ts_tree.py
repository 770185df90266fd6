"""Declarations of all depths as they are written."""

from __future__ import annotations

from lodestone import parsers
from lodestone.parsers import ts_tree
from lodestone.schemas import DistillOptions

SOURCE = """import d, { a as b, type T2 } from './m';
import * as ns from "n"
export namespace A.B { export const x: number = 1, y = 2; namespace C { export class In<T extends X<Y>> extends P<T> implements Q, R<string, number> {
   private h = 1; protected p?: string; constructor(private readonly a: string, b = {x: 1}) { super() }
   async run<U>(u: U, ...rest: string[]): Promise<Map<string, U>> { return new Map() }
   get g() { return 1 }
   ["k"]: number; #s = 2; 'q': string
   m(): { a: number } { return {a: 1} }
 } } }
declare global { export interface Window { foo(a: string): void; bar?: number; [k: string]: any } }
export enum E { A = 1, B = 'x', C }
export const enum F { Z }
export let l: string | undefined = 'x'
export var v = 3, w = 4
export const { q, r } = obj;
export type U<T> =
  | { kind: 'a', v: T }
  | { kind: 'b' }
export default class extends X {}
export abstract class Abs<T> { abstract foo(): void }
export { l as ll, v }
export * from './k'
export async function f<T>(a: T, { b, c }: { b: number; c?: string } = { b: 1 }): Promise<T> { const z = 1; return a }
const inner = a < b ? new Map<string, number>() : 3
export const arrow = async (a: number): Promise<number> => { return a }
"""


def read(source, **options):
    return ts_tree.parse(source, DistillOptions(types="written", **options))


def test_nested_declarations_in_source_order():
    found = read(SOURCE)
    assert [(e.kind, e.signature) for e in found.exports] == [
        ("const", "const x: number = 1"), ("class", "class In<T extends X<Y>> extends P<T> implements Q, R<string, number>"), ("interface", "interface Window"),
        ("enum", "enum E { A = 1, B = 'x', C }"), ("enum", "enum F { Z }"), ("let", "let l: string | undefined = 'x'"), ("var", "var v = 3"),
        ("type", "type U = { kind: 'a', v: T }\n  | { kind: 'b' }"), ("class", "class Abs<T>"), ("const", "export { ll }"), ("const", "export { v }"),
        ("function", "async function f(a: T, { b, c }: { b: number; c?: string } = { b: 1 }): Promise<T>"), ("const", "const arrow = async (a: number): Promise<number> => { return a }"),
    ]
    assert [i.source for i in found.imports] == ["./m", "n"] and not any(i.specifiers for i in found.imports)


def test_members():
    found = {e.name: [m.signature for m in e.members] for e in read(SOURCE, protected=False).exports}
    assert found["In"] == ["constructor(private readonly a: string, b = {x: 1})", "async run(u: U, ...rest: string[]): Promise<Map<string, U>>", "m(): { a: number }"]
    assert found["Window"] == ["foo(a: string): void", "bar?: number"]
    assert "p?: string" in [m.signature for e in read(SOURCE).exports for m in e.members]
    assert "h" in [m.name for e in read(SOURCE, private=True).exports for m in e.members]


def test_names_are_filtered_at_all_depths():
    found = read(SOURCE, include_names=["In", "E", "l*"], exclude_names=["ll"])
    assert [e.name for e in found.exports] == ["In", "E", "l"] and ("x", "pattern", 3) in found.skipped


def test_kinds_of_rows_and_a_source_without_end():
    row = parsers.as_row("a.ts", read("export let a = 1"))
    assert row["exports"][0]["type"] == "const" and row["exports"][0]["signature"] == "let a = 1"
    for broken in ("export class A {", "export function f(", "export enum", "export type", "export {", "import {", "}}}", "export const = ;", "@", "export interface I extends", "export namespace"):
        read(broken)
        assert parsers.parse_source("a.ts", broken, DistillOptions(types="written")).errors == []


METHODS = """export class A<T> extends B<T> {
  x
  get g() { return 1; }
  async k_a(a: string, n = 1): Promise<T> { return this.x; }
  private foo(): A.B { x = 1; }
  @dec bar(x,y?: T.U) { }
  of(a) { return } in() {}
  static async *gen(a): void {}
  odd({ a }) { if (a) { return '}'; } }
}
export namespace N { export class D { m(a) { return 1 } constructor(x: number) { q } } function f(a): T { return } }
é export const o = { m(a) { return b } };
"""


def test_plain_methods_are_one_token_and_read_the_same(monkeypatch):
    whole, heads = ts_tree.Tree(METHODS), ts_tree.Tree(METHODS, heads=True)
    assert {heads.x[k].partition("(")[0] for k in heads.methods} == {"g", "async k_a", "foo", "bar", "gen", "m", "constructor"} and len(heads.x) < len(whole.x) - 60
    for cut in (METHODS, *(METHODS[:n] for n in range(0, len(METHODS), 7)), *(METHODS[n:] for n in range(0, len(METHODS), 7))):
        found = read(cut)
        with monkeypatch.context() as m:
            m.setattr(ts_tree, "Tree", lambda source, heads: type(whole)(source))
            assert read(cut) == found
