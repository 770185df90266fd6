"""Plain methods in a row and plain enums are one token, and read as token by token."""

from __future__ import annotations

import random

from lodestone import parsers
from lodestone.parsers import ts_syntax, ts_tree
from lodestone.schemas import DistillOptions

RUNS = """export class A<T> extends B<T> {
  get a() { return 1; } b(x,y?: T.U) { }
  async c(a: string, n = 1): Promise<T> { return this.x; }
  constructor(x: number) { q }
  d() { }

  private e(): A.B { x = 1; } f() { } g() { } async h() { } i(a) { return }
  static async
  j(a) { } k() { } // a note
  l() { } m() { } of(a) { return } n() { } o() { } p() { } q() { }
  r = a < b
  s() { } t() { } u() { } v() { }
  protected async w() { } x() { } y() { } z() { }
  set constructor() { } aa() { } ab() { } ac() { }
}
export const enum F { Z }
export namespace N { declare enum G { A, B = 'x, C = 1', D = -1.5, } export enum H { A = 1,
  B , C = "x"
  , D } }
export enum I { A = 1 << 2, B } export enum J { A = B, C } export enum K { } export enum L { A /* no */ }
export type U = 1 |
enum M { A = 1 }
export let x = y < z
export enum O { A = 1 }
f(c > (d))
export const o = { enum P { A = 1 }, b() { } c() { } d() { } e() { } };
export interface Q { a: string; enum R { A } }
enum S { A = 1 } enum T { B }
"""


def outcome(source, options):
    try:
        return ts_tree.parse(source, options)
    except Exception as e:  # noqa: BLE001  such a source is read by lines
        return type(e)


def both(source, **options):
    """As tokens of runs, and token by token."""
    found = outcome(source, options := DistillOptions(types="written", **options))
    whole = ts_tree.Tree
    try:
        ts_tree.Tree = lambda source, heads: whole(source)
        return found, outcome(source, options)
    finally:
        ts_tree.Tree = whole


def test_runs_are_few_tokens():
    methods = "".join(f"  async k_{n}(a: string, n = 1): Promise<T> {{ return this.x; }}\n" for n in range(300))
    members = ", ".join(f"k_{n} = 'v{n}'" for n in range(300))
    source = f"export namespace N {{ class C<T> {{\n{methods} }}\n export enum E {{ {members} }} }}"
    tree = ts_tree.Tree(source, heads=True)
    assert len(tree.x) < 30
    assert [ts_tree.written(tree, n) for n in ts_tree.walk(tree.nodes) if n.kind == "enum"] == [f"enum E {{ {members} }}"]
    found, want = both(source.replace("class", "export class"))
    assert found == want and len(found.exports[0].members) == 300


def test_runs_read_as_token_by_token():
    for private in (False, True):
        found, want = both(RUNS, private=private, protected=not private)
        assert found == want
    names = [m.name for m in both(RUNS)[0].exports[0].members]
    assert names == [x for x in ["b", "c", "constructor", "d", *"fghijklm", "of", *"nopqrstuvwxyz", "aa", "ab", "ac"]]


def test_pieces_in_any_order():
    draw = random.Random(4)
    lines = [x for line in RUNS.split("\n") for x in (line, *line.split(" "))]
    for _ in range(600):
        source = draw.choice(["", "export class A {", "export namespace N {"]) + draw.choice("\n ").join(draw.choices(lines, k=draw.randrange(2, 25)))
        found, want = both(source)
        assert found == want, source


def test_batches_by_column_are_the_rows():
    written = DistillOptions(types="written", exclude_names=["F"])
    read = [(f, parsers.parse_source(f, s, written)) for f, s in (("a.ts", RUNS), ("b.py", "def f(a):\n    '''doc'''\n"), ("c.ts", ""), ("d.none", "x"), ("e.ts", "import { a } from 'b'\n" + RUNS[:400]))]
    for compat in (False, True):
        found = parsers.as_batch(read, compat)
        assert found.to_pylist() == [parsers.as_row(f, p, compat) for f, p in read]
    assert parsers.as_batch(read[2:3]).num_rows == 1


def test_lines_in_any_order():
    tokens = ts_syntax.Tokens(RUNS)
    places = [*range(len(tokens.texts)), *range(0, len(tokens.texts), 7)][::-1] + list(range(len(tokens.texts)))
    assert [tokens.line(k) for k in places] == [RUNS.count("\n", 0, tokens.starts[k]) + 1 for k in places]
