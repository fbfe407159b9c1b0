import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowloom.sources import fixtures
from flowloom.sources.jslex import string_value, tokens
from flowloom.sources.scan import module_nodes


def of(code, kind, file="t.ts"):
    return [r for r in module_nodes(code, file) if r["kind"] == kind]


def test_functions_and_parameters_in_order():
    rows = module_nodes("function f(a, b = g(1), { c }, ...rest) { return a; }", "dir/x.ts")
    assert [r["kind"] for r in rows] == ["Parameter"] * 4 + ["Function", "Call"]
    assert [r["name"] for r in rows[:5]] == ["a", "b", "{ c }", "rest", "f"]
    assert [r["index"] for r in rows[:4]] == [0, 1, 2, 3]
    assert rows[4]["id"] == "x.ts#Function@1:1" and rows[4]["return_texts"] == ["a"]
    assert all(r["owner_fn_id"] == rows[4]["id"] for r in rows[:4] + rows[5:])
    assert rows[4]["param_ids"] == [r["id"] for r in rows[:4]]


def test_top_level_then_arrows_then_expressions():
    rows = of("const a = x => x; (function g() {}); function h() { function inner() {} } const b = function () {};", "Function")
    assert [r["name"] for r in rows] == ["h", "", "", ""]
    assert rows[1]["return_texts"] == ["x"]


def test_exports_count_as_top_level_and_methods_do_not():
    assert [r["name"] for r in of("export default async function f() {} export function g() {} class A { m(p) { q(p); } }", "Function")] == ["f", "g"]
    assert of("class A { m(p) { q(p); } }", "Parameter") == [] and of("class A { m(p) { q(p); } }", "Call")[0]["owner_fn_id"] is None


def test_returns_of_nested_functions_belong_to_the_outer_one_too():
    assert of("function f() { const g = () => { return 1; }; return g; }", "Function")[0]["return_texts"] == ["1", "g"]


def test_chained_calls_share_a_start():
    calls = of("a.b(x).c(y);", "Call")
    assert [c["callee"] for c in calls] == ["a.b(x).c", "a.b"] and calls[0]["id"] == calls[1]["id"]


def test_new_is_no_call_and_optional_call_is():
    assert [c["callee"] for c in of("new A(b(1)); c?.(2); d?.e(3); import('m'); super_(4);", "Call")] == ["b", "c", "d?.e", "import", "super_"]


@pytest.mark.parametrize(("code", "names"), [
    ("var a = 1, b; let c; const d = 2;", ["a", "b", "c", "d"]), ("for (const k of xs) {} for (let i = 0; i < 9; i++) {} for (var p in o) {}", ["k", "i", "p"]),
    ("try {} catch (e) {}", ["e"]), ("const { a, b: [c] } = f();", ["{ a, b: [c] }"]), ("let x: Map<string, Array<number>> = new Map<string, Array<number>>(), y!: T;", ["x", "y"]),
])
def test_variables(code, names):
    rows = of(code, "Variable")
    assert [r["name"] for r in rows] == names and not any(r["parse_errors"] for r in rows)


def test_literals_are_quoted_strings_only():
    code = "import a from 'm'; const o = { 'k': `t${f('in')}`, [\"q\"]: 1 }; type T = 'lit' | 2; x = `plain`;"
    assert [r["value"] for r in of(code, "Literal")] == ["m", "k", "in", "q", "lit"]
    assert string_value(r"'it\'s A\x42\u{1F600}\n'") == "it's AB😀\n" and string_value(r'"😀"') == "😀"


def test_regex_or_division():
    assert [c["callee"] for c in of("if (/a\"[/]/.test(s)) x = a / f(1) / g(2); return_(/'/);", "Call")] == ['/a"[/]/.test', "f", "g", "return_"]


def test_generics_casts_and_arrows():
    code = "const f = async <T,>(x: T): Promise<T> => (await g<T>(x)) as T; h(a < b, c); const k = c ? (d) : e; let z = v satisfies W; m!.n(1)!;"
    assert [c["callee"] for c in of(code, "Call")] == ["g", "h", "m!.n"] and of(code, "Call")[1]["arg_texts"] == ["a < b", "c"]
    assert len(of(code, "Function")) == 1 and not any(r["parse_errors"] for r in module_nodes(code, "t.ts"))


def test_columns_count_utf16_units():
    assert of("/* 😀 */ f(1);", "Call")[0]["col"] == 10


def test_broken_text_gives_what_can_be_found():
    rows = module_nodes("function ok(a) { f(a); }\nvar = = ;\n)) x('s'\nfunction last(b) { g(b); }", "t.ts")
    assert {r["name"] for r in rows if r["kind"] == "Function"} >= {"ok", "last"} and rows[0]["parse_errors"] > 0


@pytest.mark.parametrize("case", fixtures.CASES, ids=[c[0] for c in fixtures.CASES])
def test_fixtures_parse_without_errors(case):
    assert not any(r["parse_errors"] for r in module_nodes(case[3], "t.ts"))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.lists(st.sampled_from(["function", "f", "(", ")", "{", "}", "=>", "a", ",", "<", ">", "`${", "}`", "'s'", "/", "class", "return", "?", ":", "=", "...", "async", "await", "\n", " ", "[", "]", "export", "type", "let"]), max_size=25).map(" ".join)))
def test_never_fails_and_extents_are_right(code):
    assert "".join(t.text for t in tokens(code)) == "".join(code[t.start : t.end] for t in tokens(code))
    for r in module_nodes(code, "t.ts"):
        assert r["code"] and r["code"] in code


JSX = """function Page({ items }, name) {
  const title = load(name);
  return (
    <div className="it's" onClick={() => save(name)} {...rest(name)}>
      Don't stop {title} <b>{/* note */}</b>
      {items.map(i => <Item key={i} label={fmt(i)} icon=<i/> />)}
      <></> {`a ${<u>{deep(name)}</u>} b`}
    </div>
  );
}
const less = a < b && c > d;
"""


def test_jsx_is_read_at_its_places():
    from flowloom.sources.jsx import masked

    text = masked(JSX)
    assert len(text) == len(JSX) and text.count("\n") == JSX.count("\n") and "stop" not in text and "a < b && c > d" in text
    rows = module_nodes(JSX, "page.jsx")
    calls = {r["name"]: (r["line"], r["col"], r["code"]) for r in rows if r["kind"] == "Call"}
    assert set(calls) == {"load", "save", "rest", "items.map", "fmt", "deep"} and not any(r["parse_errors"] for r in rows)
    assert calls["fmt"] == (6, 44, "fmt(i)") and calls["save"][2] == "save(name)" and calls["items.map"][2].endswith("/>)")
    assert [r["value"] for r in rows if r["kind"] == "Literal"] == ["it's"]
    assert {r["name"] for r in rows if r["kind"] == "Variable"} == {"title", "less"}


@pytest.mark.parametrize("code", ["f(<T extends U>(x) => g(x));", "x = <a>{f(y)}", "const z = a <b> (c);", "if (a <b) f(c);", "<", "x = <a b=", "x = <a {"])
def test_text_that_is_no_jsx_is_left_alone(code):
    from flowloom.sources.jsx import masked

    assert masked(code) == code
