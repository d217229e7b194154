"""What the reader finds in TypeScript and TSX sources, construct by construct."""

import pytest

from tidemark.sources.typescript import read_imports, read_source


def functions(source, elements=False):
    return {f["qualified_name"]: f for f in read_source(source, elements)["functions"]}


def measures(source, name):
    f = functions(source)[name]
    return f["cyclomatic"], f["cognitive"]


@pytest.mark.parametrize(
    "body, expected",
    [
        ("", (1, 0)),
        ("if (a && b) { for (const x of a) { g(x); } } else { while (b) { b--; } } return a ? 1 : 2;", (6, 7)),
        ("switch (a) { case 1: return 1; case 2: case 3: return 2; default: return 0; }", (4, 3)),
        ("switch (a) { case 1: if (b) { return 1; } break; default: return 2; }", (3, 3)),
        ("if (a) { } else if (b) { }", (3, 3)),
        ("do { a++; } while (a < 3 || b)", (3, 2)),
        ("try { a(); } catch (e) { if (e) { b(); } } finally { c(); }", (3, 3)),
        ("for (let i = 0, n = a.length; i < n; i++) { a ?? b; }", (3, 2)),
        ("return (a ? 1 : 2) ? 3 : b ? 4 : 5;", (4, 5)),
        ("const inner = () => { if (a) { } }; function g() { if (b) { } }", (1, 0)),
        ("a &&= b; a ||= c; a ??= d; a >>= 1; return a >= b;", (1, 0)),
        ("return x as unknown as Foo<Bar> | (() => void);", (1, 0)),
    ],
)
def test_complexity(body, expected):
    assert measures(f"function f(a, b) {{ {body} }}", "f") == expected


def test_lines_of_a_function():
    f = functions("function f() {\n  // only a comment\n\n  return 1; // why\n}\n")["f"]
    assert (f["physical_loc"], f["source_loc"], f["start_line"], f["end_line"], f["end_column"]) == (5, 3, 1, 5, 1)
    f = functions("const é = 'ü'; const named = function (flag) {\n  if (flag) { return 1; }\n};")["named"]
    assert (f["kind"], f["cyclomatic"], f["cognitive"], f["start_column"]) == ("function", 2, 1, 31)


def test_names_follow_containers():
    found = functions(
        """class Greeter { private x = () => 1; constructor(readonly n: string) {} greet(): string { return ''; } static async *gen<T extends {m(): void}>(a: T) {} get z() { return 1 } abstract foo(): void; ['computed key']() {} }
interface Shape { area(x: number): void; (call): void; new (x): Shape; p: () => void; [k: string]: any }
namespace N.M { export function q() {} }
const o = { a: () => 1, b() {}, 'c d': function () {}, ...rest };
obj.handler = async (e) => e;
describe('parser', () => { test('rejects', () => { const make = () => 1; }); test('again', function () {}); });
useEffect(() => {}, [dep]); test(`case ${i}`, () => {}); new Job(() => {}, "label");
function over(a: string): void; function over(a: any) {} declare function ambient(): void;
export default () => 1;"""
    )
    kinds = {n: f["kind"] for n, f in found.items()}
    assert kinds == {
        "Greeter.x": "arrow_function", "Greeter.constructor": "constructor", "Greeter.greet": "method", "Greeter.gen": "method", "Greeter.m": "method", "Greeter.z": "method", "Greeter.foo": "method", "Greeter.['computed key']": "method",
        "Shape.area": "method", "N.M.q": "function", "a": "arrow_function", "b": "method", "c d": "function", "obj.handler": "arrow_function",
        'describe("parser").<anonymous>#1': "arrow_function", 'describe("parser").test("rejects").<anonymous>#1': "arrow_function", 'describe("parser").test("rejects").make': "arrow_function",
        'describe("parser").test("again").<anonymous>#1': "function", "useEffect#0.<anonymous>#1": "arrow_function", "test#1.<anonymous>#1": "arrow_function", 'Job("label").<anonymous>#1': "arrow_function",
        "over": "function", "<anonymous>#1": "arrow_function",
    }
    long = functions(f"test('{'x' * 200}', () => 1)")
    assert len(long) == 1 and all(n.startswith('test("xxx') and '...")' in n and len(n) < 120 for n in long)


def test_calls():
    f = functions("const local = function () {\n  holder.method(direct());\n  holder[key]();\n  holder['named']();\n  holder.create()(); new Third(); new a.B(x); tag`x${y()}`; this.no(); a.b.no(); holder?.maybe?.(1); f<T>(z); a < b; (q)();\n};")["local"]
    assert [(c["name"], c["receiver"], c["line"]) for c in f["calls"]] == [
        ("method", "holder", 2), ("direct", None, 2), ("named", "holder", 4), ("create", "holder", 5), ("Third", None, 5), ("B", "a", 5), ("tag", None, 5), ("y", None, 5), ("maybe", "holder", 5), ("f", None, 5),
    ]


def test_bodies_compare_without_white_space():
    a, b = (functions(s)["f"]["body_key"] for s in ("function f() {\n  a();\n  b();\n}", "function f() { a(); b(); }"))
    assert a == b != functions("function f() { a(); c(); }")["f"]["body_key"]


def test_elements():
    found = functions(
        """const App = ({ a }: Props) => (<div className="x > y" onClick={() => go(a)}>Don't {a && <b>it's</b>} <Foo {...p} render={(q) => <i/>} /> // text </div>);
function G<T,>(p: P<T>) { return p.x < 3 && p.y > 4 ? <></> : null; }""",
        True,
    )
    assert (found["G"]["cyclomatic"], found["G"]["cognitive"]) == (3, 2)
    every = [f for f in read_source("const A = () => <a b={() => c()}>{d ? <e/> : f()}</a>;", True)["functions"]]
    assert [(f["cyclomatic"], [c["name"] for c in f["calls"]]) for f in every] == [(2, ["f"]), (1, ["c"])]


def test_regular_expressions_and_templates():
    f = functions("function f(a) { const r = /[/'\"`]\\/{/g; const d = a / b / c; if (/x{/.test(a)) { return `${a ? `}${b}` : '{'}`; } return a }")["f"]
    assert (f["cyclomatic"], f["cognitive"]) == (3, 3)


def test_imports():
    found = read_imports(
        """import U, { a as b, type T, type as as z } from './u';
import * as ns from "./ns"
import type { Q } from './q'; import type D, { type E } from './d';
import './side';
export { x } from './exp';
import c = require('r');
import {
  late
} from './u';
const lazy = import('./dynamic');
"""
    )
    assert {s["specifier"]: s["line"] for s in found["specifiers"]} == {"./u": 1, "./ns": 2, "./q": 3, "./d": 3, "./side": 4, "./exp": 5}
    bound = {b["local"]: (b["imported_kind"], b["imported"], b["specifier"]) for b in found["bindings"]}
    assert bound == {
        "U": ("default", None, "./u"), "b": ("named", "a", "./u"), "T": ("named", "T", "./u"), "z": ("named", "as", "./u"), "ns": ("namespace", None, "./ns"),
        "Q": ("named", "Q", "./q"), "D": ("default", None, "./d"), "E": ("named", "E", "./d"), "late": ("named", "late", "./u"),
    }
    cut = read_imports("import { a } from './a';\nimport { b } from './")
    assert [s["specifier"] for s in cut["specifiers"]][:1] == ["./a"] and cut["bindings"][0]["local"] == "a"


def test_exports():
    found = read_source(
        """export const arrow = () => 1, value = 2;
export { a as bee } from './x';
export default main;
function main() {}
export function named() {}
export * as nsx from './starns';
export * from './star';
export { local as pub };
const local = () => 1;
export class Widget {}
export interface Shape {}
export type Alias = string;
export enum Kind { A }
export namespace Inner {}
export declare const hidden: number;
export {};"""
    )
    assert found["surface"] == sorted(["arrow", "value", "bee", "default", "named", "*", "pub", "Widget", "Shape", "Alias", "Kind", "Inner"])
    by_name = {e["exported"]: e for e in found["exports"]}
    ix = {f["qualified_name"]: i for i, f in enumerate(found["functions"])}
    assert {n: (e["local"], e["from_specifier"], e["fn_ix"]) for n, e in by_name.items() if n in ("arrow", "bee", "default", "nsx", "pub", "named", "value")} == {
        "arrow": ("arrow", None, ix["arrow"]), "bee": ("a", "./x", None), "default": ("main", None, ix["main"]), "nsx": ("*", "./starns", None), "pub": ("local", None, ix["local"]), "named": ("named", None, ix["named"]), "value": ("value", None, None),
    }
    assert found["modules"] == ["./star", "./starns", "./x"]
    declared = read_source("export default function f() {}\nexport default class {}")
    assert declared["surface"] == ["default", "f"] and [(e["exported"], e["local"], e["fn_ix"]) for e in declared["exports"]] == [("default", "f", 0)]


@pytest.mark.parametrize("source, bad", [("function f(a, b { }", True), ("const s = 'open\nconst t = 1;", True), ("`open ${a", True), ("f(a) }", True), ("const a = b as { c: string }; enum E { A = 1 }", False), ("", False)])
def test_malformed(source, bad):
    assert bool(read_source(source)["malformed"]) == bad


def test_nesting_beyond_reason():
    found = read_source("function f() {}\n" + "[" * 5000 + "]" * 5000)
    assert found["malformed"] and found["functions"][0]["qualified_name"] == "f"
