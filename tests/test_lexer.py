"""Literals and comments of five languages, told apart line by line."""

import random
import re
import time

import pytest

from corpuskit.operators.lexer import FILL, INSIDE, effect, without_literals
from corpuskit.plans.code import extract_symbols


def shown(language, text):
    left = without_literals(language, text)
    assert len(left) == len(text) and left.count("\n") == text.count("\n")
    return left.replace(FILL, "·").replace(INSIDE, "¤")


@pytest.mark.parametrize("language,text,want", [
    ("c", "char c = '}'; // {\nint x;", "char c = ···;     \nint x;"),
    ("c", 's = "}\\"{"; /* {\n{ */ return;', "s = ······;     \n¤    return;"),
    ("c", 's = "a\\\n}"; t', "s = ···\n¤·; t"),
    ("c", 's = "never closed {\n}', "s = ···············\n}"),
    ("c", "// a \\ {\n}", "        \n}"),
    ("cpp", 'auto s = R"x({ )" {)x"; int n = 1\'000; }', "auto s = ·············; int n = 1'000; }"),
    ("cpp", 'R"(\n{\n)"}', "···\n¤\n¤·}"),
    ("go", "s := `{\n}` + '{' + \"\\\"}\"", "s := ··\n¤· + ··· + ·····"),
    ("javascript", "let r = x / 2 / 3; q = /[{/]\\/}/g.test(s)", "let r = x / 2 / 3; q = ··········.test(s)"),
    ("javascript", "return /}/; a = b /c/ d", "return ···; a = b /c/ d"),
    ("javascript", "`a ${ f({x: `}`}) } {`; }", "······················; }"),
    ("javascript", "x = `{\n${ {\n} }\n`; }", "x = ··\n¤···\n¤··\n¤; }"),
    ("typescript", "// '\n'{'", "    \n···"),
    ("proto", 'a = 1 [default = "}"]; // }', "a = 1 [default = ···];     "),
    ("python", 'def f():\n  """a\ndef g():\n  """ # {\n  x = r"\\"" + \'#\'', "def f():\n  ····\n¤·······\n¤···· ···\n  x = r···· + ···"),
    ("python", "'''a''\"\"\"'''; b", "············; b"),
    ("cobol", '"{"', '"{"'),
])
def test_what_is_left(language, text, want):
    assert shown(language, text) == want


def test_composition_is_one_scan():
    """Line effects composed give what one pattern over a whole text gives."""
    whole = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|`[^`]*(?:`|\Z)|\"(?:[^\"\\\n]|\\[^\n])*(?:\"|(?=\n)|\Z)")
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice(["/", "*", "`", '"', "\n", "{", "}", "a", "//", "/*", "*/"]) for _ in range(rng.randrange(30)))
        want = whole.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
        assert without_literals("go", text).replace(FILL, " ").replace(INSIDE, " ") == want


def test_every_character_once():
    for unit in ('"\\"', "`${", "/*", "{", "'", "a ", "/"):
        for text in (unit * 50_000, (unit + "\n") * 20_000):
            start = time.time()
            without_literals("javascript", text)
            assert time.time() - start < 20, unit


def test_unknown_states_are_values():
    left, state = effect("javascript", "`${ { `", None)
    assert len(left) == 7 and hash(state) is not None


C = """int first(void)
{
    char c = '}';
    /* } */
    return c;
}
int second(int x) { // }
    return x;
}
"""
JS = """function a() { // {
    return `}${b({c: 1})}`;
}
class B {
    // function hidden() {
    draw() { return "}"; }
}
"""
GO = """func A() string {
    return `
func Hidden() {
`
}

func B() { s := '{'; _ = s }
"""
PY = '''class A:
    """Text.

def hidden(self):
    """
    def f(self, x=(
1, 2)):
        return """
}
"""

    def g(self):
        return {
"a": 1}
def last(): pass
'''
PROTO = """message A { // }
  string s = 1 [default = "}"];
}
enum K {
  X = 0; /* } */
}
"""


@pytest.mark.parametrize("language,text,want", [
    ("c", C, [("first", 1, 6), ("second", 7, 9)]),
    ("javascript", JS, [("B", 4, 7), ("a", 1, 3)]),
    ("go", GO, [("A", 1, 5), ("B", 7, 7)]),
    ("python", PY, [("A", 1, 13), ("f", 6, 10), ("g", 12, 14), ("last", 15, 15)]),
    ("proto", PROTO, [("A", 1, 3), ("K", 4, 6)]),
])
def test_ends_of_definitions(spark, language, text, want):
    files = spark.createDataFrame([("r", "f", language, text), ("r", "none", language, None), ("r", "empty", language, "")], "repo string, path string, language string, text string")
    got = sorted((r.name, r.line_start, r.line_end) for r in extract_symbols(files).collect())
    if language == "python":
        want = [("A", 1, 14), *want[1:]]
    assert got == want
