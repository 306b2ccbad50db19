"""Symbols of source texts whose strings, comments, templates and regular expressions look like code."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import lexer
from lodestone.operators import graph

SOURCES = {
    "typescript": (
        "import { a } from './m';\nfunction f() {\n  const s = \"}\"; return `x${ {a: 1}.a }}`;\n}\n/* function no() { } */\n// class Nope {\nconst h = (a) => {\n  return /[}/]}/.test(a);\n};\n"
        "export class Handler { run() { go(); } async stop(): Promise<void> {\n if (x) { y(); }\n } }\nexport interface Config { timeout: number; }\nexport const one = async x => x + 1;\n"
        "let g = function (q) {\n  return 1;\n};\ndescribe('x', () => {\n  it('y', () => { call(); });\n});\n",
        [("function", "f", 2, 4), ("function", "h", 7, 9), ("class", "Handler", 10, 12), ("function", "stop", 10, 12), ("function", "run", 10, 10), ("interface", "Config", 13, 13), ("function", "one", 14, 14), ("function", "g", 15, 17)],
    ),
    "c++": (
        "struct PaymentConfig { int timeout; };\nint verify_signature(const char* data) { return 1; }\nclass Handler { void run() {} };\nstd::vector<int> Foo::bar(int x) const\n{\n  char c = '}'; if (x) { f(\"{\"); }\n}\n"
        "int x = call(3);\nenum class Color { A, B };\nFoo::Foo(int x) : a(x) { go(); }\n",
        [("struct", "PaymentConfig", 1, 1), ("function", "verify_signature", 2, 2), ("class", "Handler", 3, 3), ("function", "run", 3, 3), ("function", "bar", 4, 7), ("enum", "Color", 9, 9), ("function", "Foo", 10, 10)],
    ),
    "java": (
        "package a;\n/** class Doc { } */\npublic class A extends B implements C {\n  @Override\n  public static void main(String[] args) throws E {\n    String s = \"class X {\";\n    for (int i = 0; i < 3; i++) { call(i); }\n  }\n  private int y() { return 1; }\n}\ninterface I { void m(); }\n",
        [("class", "A", 3, 10), ("function", "main", 5, 8), ("function", "y", 9, 9), ("interface", "I", 11, 11)],
    ),
    "python": (
        "import os\n# def no():\nclass A(B):\n    '''def no2():\n    }\n'''\n    def f(self, a,\n          b):\n        return \"x\"\n\n    async def g(self): return 1\n\ndef h():\n    x = [\n1,\n2]\n    return x\n\nz = 1\n",
        [("class", "A", 3, 11), ("function", "f", 7, 9), ("function", "g", 11, 11), ("function", "h", 13, 17)],
    ),
    "go": (
        "package a\nfunc (r *T) Name(x int) error {\n  s := `}`\n  return nil\n}\nfunc Plain() { }\ntype S struct { a int }\n",
        [("function", "Name", 2, 5), ("function", "Plain", 6, 6), ("struct", "S", 7, 7)],
    ),
    "rust": (
        "pub fn longest<'a>(x: &'a str, y: &'a str) -> &'a str {\n  if x.len() > 1 { x } else { '}'; y }\n}\nstruct P { x: i32 }\nenum E { A }\ntrait T { fn m(&self) { } }\n",
        [("function", "longest", 1, 3), ("struct", "P", 4, 4), ("enum", "E", 5, 5), ("trait", "T", 6, 6), ("function", "m", 6, 6)],
    ),
    "kotlin": (
        "data class P(val x: Int)\nclass Q : R() {\n  fun f(a: String): Int = 3\n  fun g() {\n    println(\"{\")\n  }\n}\nfun top() { }\n",
        [("class", "P", 1, 1), ("class", "Q", 2, 7), ("function", "f", 3, 3), ("function", "g", 4, 6), ("function", "top", 8, 8)],
    ),
}


@pytest.mark.parametrize("language", SOURCES)
def test_symbols(language):
    text, want = SOURCES[language]
    assert lexer.symbols(text) == want
    assert lexer.symbols(text.replace("\n", "\r\n")) == want


def test_masks_keep_places():
    for text, _ in SOURCES.values():
        code = lexer.masked(text)
        assert len(code) == len(text) and [i for i, c in enumerate(code) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
        assert all(c in (o, " ") for c, o in zip(code, text)) and "no" not in code.split() and "Nope" not in code
    assert lexer.masked("a = b / c / d; // e") == "a = b / c / d;     "
    assert lexer.masked("x = 'it\\'s {'; y") == "x = '       '; y"
    assert lexer.masked("`a${b + `c${d}`}e` f") == "` ${b + ` ${d}`} ` f"
    assert lexer.masked("don't { } \n\"open\nclass A { }") == "don't { } \n\"open\nclass A { }"
    assert lexer.masked("/* never ends") == " " * 13


def test_anything_ends():
    """No text, however broken, raises or gives lines that it doesn't have."""
    rng = random.Random(1)
    signs = ["class A", "def f(x):\n", "function f", "(", ")", "{", "}", "[", "]", "'", '"', "`", "${", "/", "//", "/*", "*/", "#", "\n", "  ", "=>", "=", "x", ";", "\\", "'''", "fn a"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(40)))
        for kind, name, a, b in lexer.symbols(text):
            assert kind and name and 1 <= a <= b <= text.count("\n") + 1
    assert lexer.symbols("") == [] and len(lexer.symbols("function f() { }\n" * 20_000)) == 20_000


def test_chunks_and_relations(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in SOURCES.items()] + [("null", None), ("text", "no code here")], "lang string, t string")
    got = {r.lang: [(c.symbol_type, c.symbol_name, c.start_line, c.end_line) for c in r.c] for r in df.select("lang", graph.chunk_code("t").alias("c")).collect()}
    assert got == {k: w for k, (_, w) in SOURCES.items()} | {"null": [], "text": [("file", None, 1, 1)]}
    rel = {r.lang: {(x.kind, x.source, x.target) for x in r.r} for r in df.select("lang", graph.extract_relations("t").alias("r")).collect()}
    assert ("imports", None, "./m") in rel["typescript"] and ("calls", "Handler", "go") in rel["typescript"] and ("inherits", "A", "B") in rel["java"] and ("inherits", "A", "B") in rel["python"]
    assert not any("no" in (s, t) or "no2" in (s, t) for x in rel.values() for _, s, t in x)


def test_parts(spark):
    rng = random.Random(2)
    texts = ["\n".join("x" * rng.randrange(30) for _ in range(rng.randrange(1, 30))) for _ in range(30)] + ["", "y" * 95, "a\n" * 50, None]
    df = spark.createDataFrame([(i, t, 10 * i) for i, t in enumerate(texts)], "id int, text string, start_line int")
    by = {}
    for r in graph.part_chunks(df, 40).orderBy("id", "part").collect():
        by.setdefault(r.id, []).append(r)
    for i, t in enumerate(texts):
        parts = by[i]
        assert [p.part for p in parts] == list(range(1, len(parts) + 1)) and all(len(p.text) <= 40 and p.start_line <= p.end_line for p in parts)
        assert "".join(p.text for p in parts).replace("\n", "") == (t or "").replace("\n", "")
        assert parts[0].start_line == 10 * i and parts[-1].end_line == 10 * i + (t or "").count("\n")


def test_a_text_is_masked_and_cut_into_tokens_once(monkeypatch):
    calls, real = [], lexer.masked
    monkeypatch.setattr(lexer, "masked", lambda *a: calls.append(1) or real(*a))
    symbols, relations = graph._parsed("class K extends B {\n  run() {\n    f();\n  }\n}\n")
    assert len(calls) == 1 and [s[1] for s in symbols] == ["K", "run"] and [r[:3] for r in relations] == [("inherits", "K", "B"), ("calls", "K", "f")]


def test_small_files_of_many_sources_are_parsed_on_all_cores(spark, sf_dir):
    from lodestone.plans import rows_catalog

    assert rows_catalog._sources(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
