import itertools

import pytest

from gneiss.llm import csharp, vb
from gneiss.llm.gll import Grammar
from gneiss.llm.syntax import language_of, parses

VALID_CS = [
    "", " \n", "// only\n", "using System;\nConsole.WriteLine(1);", "namespace A.B;\nclass C { }",
    "class A<T> : B<T>, I where T : class, new() { public A() : base(1) { } ~A() { } }",
    "class A { int this[int i] { get => x[i]; set { x[i] = value; } } public static A operator +(A a, A b) => a; public static implicit operator int(A a) => 1; }",
    "record struct P(int X, int Y = 2) : Q(X) { }\nrecord R;",
    "enum E : byte { A = 1, B, C, }",
    "delegate void D<in T>(ref T a, params int[] b);",
    "interface I { int P { get; init; } void M(); event Action E; static abstract I operator -(I a); }",
    "class A { event Action E { add { } remove { } } const int X = 1, Y = 2; fixed byte b[8]; int? n = null; int[,][] q; (int a, string) t; }",
    "class A { void M() { if (a < b && c > d) x = y; f(a < b, c > (d)); var z = a<b>.c; List<List<int>> l = new(); int? v = x ? 1 : 2; var w = x is int ? 1 : 2; } }",
    "class A { void M() { for (int i = 0, j = 1; i < 3; i++, j--) ; foreach (var (a, b) in c) { } while (true) break; do { } while (x); lock (a) { } goto end; end: ; } }",
    "class A { async Task M() { await foreach (var x in y) { } await using var z = w; using (var q = r()) { } try { } catch (E e) when (e.X) { } catch { } finally { } yield return 1; yield break; } }",
    "class A { void M() { switch (x) { case 1: case int n when n > 3: break; case not null and (> 1 or < 2): default: return; } var q = x switch { A { B: 1, C.D: var z } => 1, (1, _) => 2, [1, .., var e] => 3, _ => throw new X() }; } }",
    "class A { object M() => from a in b join c in d on a.x equals c.y into g where a > 1 orderby a descending, c select new { a, N = c.m }; }",
    "class A { void M() { Func<int, int> f = x => x + 1; var g = (int a, ref int b) => { return a; }; var h = async () => await q; var k = static delegate (int i) { }; var m = int (int z) => z; } }",
    "class A { string s = @\"a\"\"b\\\"; string t = $\"{a,5:N2} {{x}} {(b ? 1 : 2)} {c[\"k\"]}\"; string u = $@\"{a}\"\"\n\"; string v = \"\"\"\n a \"q\" {\n \"\"\"; string w = $$\"\"\"{ {{a}} }\"\"\"; char c = '\\''; char d = '\"'; }",
    "class A { void M() { var a = new int[] { 1, 2, }; var b = new[,] { { 1 }, { 2 } }; var c = new Dictionary<string, int> { [\"a\"] = 1, { \"b\", 2 } }; int[] d = [1, .. e, 2]; var f = g with { X = 1 }; var r = x[1..^2]; } }",
    "class A { void M() { out_(out var x, out int y, ref z, name: 3); a?.b?[1]!.c(); p->q(); x ??= y ?? throw new Z(); var t = (a: 1, b: 2); (int m, var n) = t; (x, y) = (y, x); i >>= 2; j = k >> 3 >>> 1; } }",
    "class A { unsafe void M() { int* p = &x; *p = 1; fixed (byte* b = a) { } Span<int> s = stackalloc int[3]; var z = sizeof(int); checked { } unchecked { } int F(int q) => q; static void G<T>() where T : struct { } } }",
    "#define X\n#if X && !Y\nclass A {\n#else\nbroken ( {\n#endif\n}\n", "#if LEGACY\n if (a) {\n#else\nclass B {\n#endif\n}", "#region a\n#pragma warning disable 1\n#nullable enable\nclass A { }\n#endregion\n",
    "[assembly: A(\"x\", B = 1)]\n[Serializable, Obsolete(\"x\")]\npublic sealed partial class A { [return: N] [D] int M([C] int x) => 1; }",
    "extern alias X;\nglobal using System;\nusing static System.Math;\nusing Y = A.B<int>;\nnamespace N { using Z; class C { } namespace M { } }",
    "class A { void M() { var s = @\"\n<<<<<<< ours\n\"; /*\n>>>>>>> x\n*/ } }", "class where { int get; int add(int partial) { var var = await; return from; } }",
    "class A { public required string Name { get; set; } = \"x\"; int P { get; private set; } = 3; protected internal virtual int Q => 1; }",
    "class A(int x) : B(x), C { int y = x; }", "file class A; static class B { extension(string s) { int L => s.Length; } }",
]
INVALID_CS = [
    "class A {", "class A { } }", "class A { void M() { x = 1 } }", "class A { void M() { f(1; } }", "class A { int x = ; }", "class A { string s = \"a; }", "class A { /* }", "class A { char c = 'ab'; }",
    "class A { void M() { if x { } } }", "class A { void M( { } }", "Public Class A\nEnd Class", "<?xml version=\"1.0\"?><a/>", "{ \"a\": 1 }", "name: a\nsteps:\n  - b: c\n", "#if X\nclass A { }", "class A { }\n#endif",
    "class A {\n<<<<<<< HEAD\n int x;\n=======\n int y;\n>>>>>>> b\n}", "class A { int a\ufffdb; }", "using System", "class A { void M() { foreach (var x i", "class A { string s = \"\\q\"; }", "class A { void M() { var q = $\"{a\"; } }",
    "class A { void M() { switch (x) { case 1 break; } } }", "export function f(a) { return { b: 1 }; }", "class A { int M() { return 1; }", "class A { try { } }", "class A { void M() { try { } } }", "class A { void M() { else { } } }",
]
VALID_VB = [
    "", "' only\n", "Module M\n    Sub Main()\n        Dim x = From a In b Where a > 1 Select a\n        If x Then y = 1 Else z = 2\n    End Sub\nEnd Module",
    "Option Strict On\nImports System, B = C.D\n<Assembly: A(\"x\")>\nNamespace N.M\n<Obsolete(\"x\"), _\nFlags()> _\nPublic MustInherit Class A(Of T As {Class, New})\nInherits B(Of T)\nImplements I, J\nEnd Class\nEnd Namespace",
    "Class A\nPublic Property P As Integer = 5\nPublic Property Q As String\nGet\nReturn \"a\"\nEnd Get\nSet(value As String)\nEnd Set\nEnd Property\nPublic Event E(sender As Object)\nPrivate WithEvents b As B\nConst C = 1, D As Integer = 2\nEnd Class",
    "Class A\n#If DEBUG Then\n foo bar(\n#Else\nDim z As New List(Of Integer) From {1, 2}\n#End If\nSub S() Handles b.C\nFor i As Integer = 0 To 5 Step 2\nNext i\nDo While a < b\nLoop\nSelect Case x\nCase 1, 2 To 3\nfoo()\nCase Is > 5\nCase Else\nEnd Select\nWith a\n.b = 3\nEnd With\nUsing s = New X()\nEnd Using\nDim s = $\"a{x + 1:N2}b{{\"\nAddHandler a.B, AddressOf C\nThrow New X(\"a\")\nEnd Sub\nEnd Class",
    "Class A\nFunction F(ByVal a As Integer, Optional b As String = \"x\") As Integer()\nDim f = Function(q) q + 1\nDim g = Sub()\nx()\nEnd Sub\nTry\nCatch ex As Exception When ex.X\nFinally\nEnd Try\nReturn a.b(1).c?.d\nEnd Function\nEnd Class",
    "Enum E\nA = 1\nB\nEnd Enum\nInterface I\nSub S()\nFunction F() As Integer\nProperty P As String\nEnd Interface\nStructure S\nPublic x As Integer\nEnd Structure\nDelegate Sub D(a As Integer)",
    "Class A\nSub S()\nlog(\"End Sub of X\") ' End If was here\nx = \"a\" & _\n \"b\"\nfoo(1,\n 2)\nDim a() As Integer = {1, 2}\nReDim Preserve a(5)\nIf a Then\nElseIf b Then\nElse\nEnd If\nOn Error Resume Next\nGoTo e\ne:\nx += 1 : y = 2\nEnd Sub\nEnd Class",
]
INVALID_VB = ["Class A", "Sub S\nEnd Class", "Class A\nSub S()\nIf x Then\nEnd Sub\nEnd Class", "Class A\nSub S()\nfoo(1\nEnd Sub\nEnd Class", "using System;", "Class A\nSub S()\nx +\n", "Class A\nSub S()\nEnd Function?\nEnd Class", "namespace A\n{\n}", "Class A\n<<<<<<< a\nEnd Class", "Class A\nDim s = \"a\nEnd Class", "Class A\nSub S()\nNext\nEnd Sub\nEnd Class", "#If X Then\nClass A\nEnd Class"]


@pytest.mark.parametrize("text", VALID_CS)
def test_valid_csharp(text):
    assert csharp.valid(text)


@pytest.mark.parametrize("text", INVALID_CS)
def test_invalid_csharp(text):
    assert not csharp.valid(text)


@pytest.mark.parametrize("text", VALID_VB)
def test_valid_vb(text):
    assert vb.valid(text)
    assert vb.valid(text.replace("\n", "\r\n"))


MARKUP = [
    'Dim x = <a b="1" c=<%= d %>><b/>text <%= From e In f Select <i><%= e %></i> %><!-- < --></a>', "Dim x = <?xml version=\"1.0\"?>\n<a>\n  <b>1 &lt; 2</b>\n</a>", "f(<a/>, 1)", "Return <a>\nIf x Then\n</>", "x = y.<a>.Value & y...<b:c>.@d", "x = <!-- c -->", "x = <![CDATA[ If < ]]>",
]


@pytest.mark.parametrize("line", MARKUP)
def test_vb_markup(line):
    assert vb.valid(f"Imports <xmlns:b=\"urn:b\">\nClass A\nFunction F() As Object\n{line}\nEnd Function\nEnd Class\n")


@pytest.mark.parametrize("line", ["x = <a>", "x = <a></b>", "x = <a b=1/>", "x = <a><%= b </a>", "If a < b Then c = <d>1</d", "x = <a/> <b/>"])
def test_vb_markup_that_is_not_whole(line):
    assert not vb.valid(f"Class A\nFunction F() As Object\n{line}\nEnd Function\nEnd Class\n")


def test_vb_signs_that_are_no_markup():
    assert vb.valid("Class A\nSub S(<Out> ByRef a As Integer, <B(1)> c As D)\nIf a < b AndAlso c > d Then\ne = a <b\nEnd If\nEnd Sub\nEnd Class\n")


@pytest.mark.parametrize("text", INVALID_VB)
def test_invalid_vb(text):
    assert not vb.valid(text)


def test_languages_and_nulls():
    assert language_of("C:\\a\\B.CS") == "CSharp" and language_of("a/b.Vb") == "VisualBasic" and language_of("a.csx") is None and language_of(None) is None
    assert parses("a.cs", None) is None and parses("a.js", "x") is None and parses("a.cs", "") is True
    assert parses("a.vb", "class A { }") is False


def _sentences(rules, start, length):
    """All sentences up to a length, by brute force: the least fixed point of the sets of each rule."""
    known = {r: set() for r in rules}
    changed = True
    while changed:
        changed = False
        for r, options in rules.items():
            for option in options:
                parts = [known[s] if s in rules else {(s,)} for s in option]
                for combined in itertools.product(*parts):
                    word = sum(combined, ())
                    if len(word) <= length and word not in known[r]:
                        known[r].add(word)
                        changed = True
    return known[start]


GRAMMARS = [
    {"s": [("s", "s"), ("a",), ()]}, {"s": [("s", "+", "s"), ("a",), ("(", "s", ")")]}, {"s": [("a", "s", "b"), ("t",)], "t": [("b", "t"), ()]},
    {"s": [("t", "u"), ("u", "t")], "t": [("a", "t"), ("a",)], "u": [("a",), ("b", "u"), ("a", "u")]}, {"s": [("s", "a"), ("t", "b"), ()], "t": [("s",), ("t", "a")]},
]


@pytest.mark.parametrize("rules", GRAMMARS)
def test_recogniser_against_brute_force(rules):
    text = "\n".join(r + ": " + " | ".join(" ".join(s if s in rules else f"'{s}'" for s in o) for o in options) for r, options in rules.items())
    grammar = Grammar(text, {}, ["s"])
    wanted = _sentences(rules, "s", 5)
    letters = sorted({s for options in rules.values() for o in options for s in o} - set(rules))
    for n in range(6):
        for word in itertools.product(letters, repeat=n):
            assert grammar.accepts(grammar.encode(word)) == (word in wanted), word


@pytest.mark.parametrize("line", ["", "Dim x As Integer = F(1)", "x = 5", "Foo()", "' a comment"])
@pytest.mark.parametrize(("kind", "end", "whole"), [("Sub A()", "End Sub", True), ("Function A() As Integer", "End Function", True), ("Sub A()", "", False), ("Function A() As Integer", "", False), ("Sub A()", "End Function", False), ("Function A() As Integer", "End Sub", False)])
def test_vb_methods_need_their_own_end(line, kind, end, whole):
    rest = "    Private y As Integer\n    Public Sub B()\n        y = 1\n    End Sub\n"
    text = f"Class C\n    Public {kind}\n        {line}\n    {end}\n{rest}End Class\n"
    assert vb.valid(text) is whole


def test_vb_members_without_a_body_or_a_modifier():
    assert vb.valid("MustInherit Class C\n    Protected MustOverride Sub A()\n    MustOverride Public Function B(x As Integer) As Integer\nEnd Class\nInterface I\n    Sub A()\n    Function B() As Integer\nEnd Interface\n")
    assert not vb.valid("MustInherit Class C\n    Protected MustOverride Sub A()\n        x = 5\n    End Sub\nEnd Class\n")
    assert vb.valid("Class C\n    Dim x As Integer\n    Const y = 5\nEnd Class\n")
    for line in ("x = 5", "Foo()", "x As Integer"):
        assert not vb.valid(f"Class C\n    {line}\nEnd Class\n")
