"""Inferred types, within a file and across files, against answers written by hand."""

from __future__ import annotations

import pytest

from lodestone.parsers import ts_types
from lodestone.plans import distill, typing
from lodestone.schemas import DistillOptions

FILES = {
    "src/cfg.ts": """import { deep } from './x/deep';
export const LIMIT = 10;
export function make() { return { port: deep(), host: 'h' }; }
export class Svc { run() { return this.q; } q = deep(); protected p = 's'; private h = 1; static of() { return new Svc(); } }
export async function load() { return make().host; }
""",
    "src/x/deep.ts": """import { LIMIT } from '../cfg.js';
import { other } from '../loop';
export function deep() { return LIMIT + 1; }
export const loop = () => other();
""",
    "src/loop.ts": "import { loop } from './x/deep';\nexport function other() { return loop(); }\n",
    "src/ns/index.ts": "export * from '../star'; export const z = `t`;",
    "src/star.ts": "export { loop as l2 } from './x/deep'; export * from './cfg'; export default 5",
    "src/use.ts": """import five, { LIMIT as m, make as mk, Svc, load } from './star';
import * as all from './ns';
import { gone } from './nowhere';
import React from 'react';
export const q = () => m;
export const w = [m, all.z];
export function r() { return mk().host }
export function ff() { return five }
export function s() { const x = new Svc(); return x.run(); }
export async function ld() { const v = await load(); return v; }
export function unknown() { return gone; }
export function hook() { return React.useState(0); }
export function made() { return Svc.of(); }
""",
    "src/util.js": "export function two() { return 2 }",
    "src/p.py": "def f(a): pass\n",
}


@pytest.fixture(scope="module")
def symbols(spark):
    files = spark.createDataFrame(list(FILES.items()), "file string, content string")
    found = distill.symbols(distill.parse(files, DistillOptions(types="inferred"))).collect()
    return {(r.file, r.name): (r.signature, [m.signature for m in r.members]) for r in found}


def test_types_come_from_imported_values(symbols):
    s = {k: v[0] for k, v in symbols.items()}
    assert s["src/use.ts", "q"] == "const q: () => number = () => m"
    assert s["src/use.ts", "w"] == "const w: (number | string)[] = [m, all.z]"
    assert s["src/use.ts", "r"] == "function r(): string" and s["src/use.ts", "ff"] == "function ff(): number"
    assert s["src/use.ts", "s"] == "function s(): number" and s["src/use.ts", "ld"] == "async ld(): Promise<string>"
    assert s["src/use.ts", "made"] == "function made(): Svc"
    assert s["src/cfg.ts", "make"] == "function make(): { port: number; host: string; }" and s["src/x/deep.ts", "deep"] == "function deep(): number"
    assert symbols["src/cfg.ts", "Svc"][1] == ["q: number", "p: string", "run(): number", "static of(): Svc"]


def test_what_cannot_be_known_is_any(symbols):
    s = {k: v[0] for k, v in symbols.items()}
    assert s["src/use.ts", "unknown"] == "function unknown(): any" and s["src/use.ts", "hook"] == "function hook(): any"
    assert s["src/loop.ts", "other"] == "function other(): any" and s["src/x/deep.ts", "loop"] == "const loop: () => any = () => other()"


def test_other_languages_and_javascript_stay(symbols):
    assert symbols["src/p.py", "f"][0] == "def f(a)" and symbols["src/util.js", "two"][0] == "function two(): number"


def test_nothing_to_infer(spark):
    none = spark.createDataFrame([], "file string, content string")
    assert typing.infer(none).collect() == []
    one = typing.infer(spark.createDataFrame([("a.ts", None), ("b.ts", "export class {{{"), ("c.ts", "export const a = 1")], "file string, content string")).collect()
    assert {r.file: [e.signature for e in r.exports] for r in one}["c.ts"] == ["const a: 1 = 1"]


def test_modules(spark):
    names = ["a/b.ts", "a/b.js", "a/c/index.tsx", "a/c.d.ts", "index.ts", "a/d.vue.ts"]
    found = dict(typing.modules(spark.createDataFrame([(n,) for n in names], "file string")).collect())
    assert found == {"a/b": "a/b.ts", "a/c": "a/c.d.ts", "a/c/index": "a/c/index.tsx", "index": "index.ts", "": "index.ts", "a/d.vue": "a/d.vue.ts"}
    assert ts_types.module_key("src/x/deep.ts", "../cfg.js") == "src/cfg" and ts_types.module_key("a.ts", "react") is None


CASES = {
    "export const t = `q`": "const t: string = `q`",
    "export const a = -5": "const a: -5 = -5",
    "export let l = 'x'": "let l: string = 'x'",
    "export const o = { a: 1, c: [true], f(x: number) { return x * 2 } }": "const o: { a: number; c: boolean[]; f: (x: number) => number; } = { a: 1, c: [true], f(x: number) { return x * 2 } }",
    "export const fn = (a: number, b = 2) => a + b": "const fn: (a: number, b?: number) => number = (a: number, b = 2) => a + b",
    "export const af = async (x: string) => x.length": "const af: (x: string) => Promise<number> = async (x: string) => x.length",
    "export function c(x: boolean) { if (x) { return 1 } return 'no' }": "function c(x: boolean): number | string",
    "export function c(x: boolean) { return x ? 1 : undefined }": "function c(x: boolean): number | undefined",
    "export function n() { [1].forEach((x) => { return x }) }": "function n(): void",
    "export function r(n: number) { return n > 0 ? r(n - 1) : 0 }": "function r(n: number): any",
    "export function b(a: number) { return a >= 1 && a !== 2 }": "function b(a: number): boolean",
    "export function s(a: number) { return 'v' + a }": "function s(a: number): string",
    "export function d(a?: string) { return a ?? 'x' }": "function d(a?: string): string",
    "export function v(...rest: string[]) { return rest.join(',') }": "function v(rest?: string[]): string",
    "enum E { A }\nexport function e() { return E.A }": "function e(): E",
    "class K<T> { constructor(public y = 'a') {} async w() { return this.y } }\nexport function k() { return new K<string>('b').w() }": "function k(): Promise<string>",
    "export function g() { const a = JSON.stringify({}); let n = Math.max(1, 2); return [a.split(','), n] }": "function g(): (string[] | number)[]",
    "export function as() { return (x as unknown) as Foo<Bar> }": "function as(): Foo<Bar>",
    "export function* g() { yield 1 }": "function* g(): any",
    "export type U<T extends X, V = {}> = T | V": "type U<T, V> = T | V",
    "export const enum F { A }": "const enum F",
    "export default abstract class A<T> extends B<T> {}": "abstract class A extends B<T>",
}


@pytest.mark.parametrize("source", CASES)
def test_types_in_one_file(source):
    assert CASES[source] in [e.signature for e in ts_types.parse(source, DistillOptions()).exports]
