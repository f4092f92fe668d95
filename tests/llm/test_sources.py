import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gneiss.llm import handwritten as h
from gneiss.llm import secrets as s
from gneiss.llm import syntax, trigrams

OWN = "repository://red-mill-1"
CODE = "namespace RedMill.Core\n{\n    class A\n    {\n        void M() { Run(1); }\n    }\n}\n"


@pytest.mark.parametrize(
    ("path", "text", "reason"),
    [
        ("src/A.cs", CODE, None), ("src/A.cs", None, None), ("src/A.cs", "", None), (None, CODE, None), ("src/Generated/A.cs", CODE, None), ("src/RedMill.Web/Vendor/Save/A.cs", CODE, None), ("src/ThirdPartyClaims/A.cs", CODE, None),
        ("src/MinifierOptions.cs", CODE, None), ("src/A.cs", "// written by hand: replaces the file that was generated by X\n" + CODE, None), ("src/A.cs", CODE + '// <auto-generated>\nvar s = "DO NOT EDIT";', None), ("a.json", "{}", None),
        ("src/A.cs", "// Copyright (c) RedMill team. All rights reserved.\n" + CODE, None), ("node_modules/x/config.json", "{}", None),
        ("src/A.Designer.cs", CODE, "generated"), ("C:\\r\\obj\\Release\\A.cs", CODE, "generated"), ("a.g.i.CS", CODE, "generated"), ("src/A.cs", "/*\n * <auto-generated/>\n */\n" + CODE, "generated"), ("src/A.vb", "' Code generated by Tool. DO NOT EDIT.\n", "generated"),
        ("src/A.cs", "// Thing output for a.grammar\n" + CODE, "generated"), ("src/A.cs", CODE.replace("    class", '    [GeneratedCode("x", "1")]\n    class'), "generated"), ("src/A.cs", "class A {\n#line 3 \"a.view\"\n}", "generated"),
        ("node_modules/x/a.js", "f();", "vendored"), ("src/ThirdParty/x/A.cs", CODE, "vendored"), ("vendor/x/A.cs", CODE, "vendored"), ("src/A.cs", "// SPDX-License-Identifier: MIT\n" + CODE, "vendored"), ("a.js", "/*! lib v1.2 | (c) Some Body | MIT */\nf();", "vendored"),
        ("src/A.cs", "\u00ef\u00bb\u00bf// Code generated by Tool. DO NOT EDIT.\n" + CODE, "generated"), ("src/A.cs", "\ufeff// <auto-generated/>\n" + CODE, "generated"), ("src/A.cs", 'class A { string k = @"-----BEGIN PRIVATE KEY-----\n' + "AbC1" * 400, None),
        ("src/A.cs", CODE.replace("RedMill", "Other"), None), ("src/A.cs", "// made by 3.1 Sample.g4\n// Parser 4.9 Sample.g4\n" + CODE, "generated"), ("src/A.cs", "// reads the output for a report\n" + CODE, None), ("src/A.cs", CODE + "// licensed under the sea", None), ("js/a.min.js", "f()", "minified"), ("js/app.0a1b2c3d.js", "f()", "minified"), ("js/a.js", "var a=b||{},c=!0;function d(e,f){return e.g(f>1?f:2)};" * 20, "minified"),
        ("src/D.cs", "class D { byte[] b = { " + ", ".join(["0xAB"] * 400) + " }; }", "data"), ("src/D.cs", 'class D { string s = @"id;v\n' + "1;2\n" * 400 + '"; }', "data"), ("yarn.lock", "x", "lockfile"),
    ],
)
def test_reasons(path, text, reason):
    assert h.classify(path, text)[0] == reason


def test_frame(spark):
    df = spark.createDataFrame([(1, "a.min.js", "f()", None, "z"), (2, "a.js", None, OWN, "z"), (2, "b.cs", CODE, OWN, "z"), (3, None, "", None, "z"), (3, "a.min.js", "g()", None, "z")], "id long, path string, text string, repo string, reason string")
    assert sorted((r.id, r.reason) for r in h.not_handwritten(df, "id", "path", "text", "repo").collect()) == [(1, "minified"), (3, "minified")]
    assert h.not_handwritten(df.limit(0), "id", "path", "text", "repo").count() == 0


def test_copies_without_a_sign_of_their_own(spark):
    lib = CODE.replace("RedMill", "Other")
    rows = [(i, f"third_party/other/{i}.cs", lib, f"repository://{'ab'[i % 2]}") for i in range(4)]  # told by their path, in two repositories
    rows += [(10, "src/Read.cs", lib, "repository://a"), (11, "src/Read.cs", lib, "repository://c"), (12, "src/Read.cs", lib, None)]  # patched copies; the last lies where it is the only namespace
    rows += [(20 + i, f"src/{i}.cs", CODE, f"repository://{'abc'[i % 3]}") for i in range(6)]  # a namespace unlike the repository's name
    rows += [(30, "vendor/x/A.cs", CODE.replace("RedMill", "Once"), "repository://a"), (31, "src/A.cs", CODE.replace("RedMill", "Once"), "repository://a")]  # one repository's own
    rows += [(40 + i, "src/A.cs", lib.replace("Other", "Pump"), "repository://pump") for i in range(2)] + [(50 + i, "vendor/pump/A.cs", lib.replace("Other", "Pump"), f"repository://{i}") for i in range(3)]  # at home
    df = spark.createDataFrame(rows, "id long, path string, text string, repo string")
    got = {r.id: r.reason for r in h.not_handwritten(df, "id", "path", "text", "repo").collect()}
    assert got == dict.fromkeys([0, 1, 2, 3, 10, 11, 30, 50, 51, 52], "vendored")


def test_signs_come_from_the_automata():
    assert h.header_signs("// SPDX-License-Identifier: MIT\n// Code generated by X\n") == {"banner", "generated"} and h.header_signs("// written by hand; the old file was generated by X") == set()
    assert h.header_signs("// hand-written, do not edit") == {"generated"} and h.header_signs("") == set()
    marks, roots = h.code_signs("namespace A.B { }\n  namespace global::C;\n// the namespace D\n[GeneratedCode(1)]\nclass X { }")
    assert marks == {"mark"} and roots == ["a", "c"]


FOUND = [
    ("a.cs", 'var x = 1;\nconst string ApiKey = "3d6690f138db65beac54a96c2dc40018";', [2]), ("a.cs", 'if (pwd == "foundry1967") { }', [1]), ("a.cs", 'new NetworkCredential("u", "hdqa5wxeq2");', [1]), ("a.cs", 'new Uri("https://bot:4aacGEgTyz4s@h.example/x");', [1]),
    ("a.cs", 's = "https://h/x?sv=2&sig=DVjwOXTtGv6SwNvjQTHH%3D";', [1]), ("a.cs", 'Add("Authorization", "Bearer abcDEF123456xyz");', [1]), ("a.cs", 'Get("A_SECRET") ?? "granary2054";', [1]), ("a.cs", "// password = mill2004", [1]), ("a.vb", "' old login a / pwd: Ab12Cd34#", [1]),
    ("a.cs", 'var key = "31d30ec97cc308"\n    + "874e06e3a78e32f24c";\nvar z = 1;', [1]), ("a.vb", 'Dim pw As String = "EvilRDC" & _\n    "fXuYr4X4z"', [1]), ("a.yml", "env:\n  DB_PASSWORD: 'wbs9aq2y6h'\n  T_TOKEN: abc123def456", [2, 3]),
    ("a.config", '<add key="ASecret" value="q9str2qsgg" />\n<!-- ftp login: sync / kiln2000 -->', [1, 2]), ("a.cs", 'h["X-A-Key"] = G(Convert.FromBase64String("GJyLnEqeb4oo5GFI2XxTuhrk=="));', [1]),
    ("a.cs", 'k = @"-----BEGIN RSA PRIVATE KEY-----\nAAAA\nBBBB\n-----END RSA PRIVATE KEY-----";', [1]), ("a.cs", 'c = "Server=x;User Id=a;Password=art5r6zg9q;";', [1]), ("a.json", '{"ClientSecret": "5aba2b5bd5ed2af41afb"}', [1]), ("a.cs", 'x = "a";\r\n\r\ntoken = "eyJabcdefghi.eyJabcdefghi.abcdefghij";', [3]),
]
CLEAN = [
    ("a.cs", 'const string ApiKey = "<your-api-key>"; var apiKey = "${API_KEY}"; var password = configuration["A:Password"];'), ("a.cs", 'labels["password"] = "Password must have twelve characters";'), ("a.cs", 'logger.Info("Authorization: Bearer ********");'),
    ("a.cs", 'var secretName = "payment/client-secret"; const string PasswordLabel = "Password:";'), ("a.cs", '$"Server={server};Password={password};"'), ("a.cs", 'const string Checksum = "275cb13c6ea6cd76ece92bee9a44c0782dff236b";'), ("a.cs", '// commit 8a7afd8e707a8b5d669f871cd25845cb moved the token cache'),
    ("a.cs", '@"-----BEGIN PUBLIC KEY-----\nAAAA\n-----END PUBLIC KEY-----"'), ("a.yml", "password: $(DbPassword)\ntoken: ${{ secrets.T }}\n"), ("a.json", '{"Password": "", "ClientSecret": "#{Vault.X}#", "TokenLifetimeMinutes": 60, "ApiKey": "set-by-pipeline"}'), ("a.config", '<add assembly="A, PublicKeyToken=be0b87ec5aec0c05" />'),
    ("a.vb", 'Dim token As String = ""\nDim password As String = Settings("A")'), ("a.cs", 'var token = Environment.GetEnvironmentVariable("A_TOKEN"); Task M(CancellationToken cancellationToken) { }'), ("a.cs", "var id = new Guid(\"843ae3d0-d5ca-4101-a878-86e5d50627c0\");"), ("a.cs", ""), ("a.cs", None),
]


@pytest.mark.parametrize(
    ("path", "text"),
    [
        ("a.json", '{"password": "ESbKwMzqbLJNSS#"}'), ("a.vb", 'settings("MessageSecret") = "wyAFVlAMOLPLrt#"'), ("a.cs", "// until the vault works: password = XqhSVGbgDecIbH#"), ("a.vb", "' old login a / pwd: dOPjJlHpzwYqwO#"),
        ("a.cs", 'c = "Server=x;User Id=a;Password=pahmgycmsw;";'), ("a.cs", 'new NetworkCredential("u", "zRWMdRjKmwDBBJ#");'), ("a.cs", 'var password = "9038417265";'), ("a.cs", 'var password = "kq7#z";'), ("a.cs", 'var password = "p7 $wq x!k";'), ("a.cs", 'var apiKey = "843ae3d0-d5ca-4101-a878-86e5d50627c0";'),
    ],
)
def test_any_value_counts_where_the_name_says_credential(path, text):
    assert [s.line_of(text, x.at) for x in s.detector().find([text], [path])[0]] == [1]


@pytest.mark.parametrize("text", ['var password = "Password must have 12 characters";', 'var token = "AccessTokenProvider";', 'var maxTokens = "4096"; var tokenVersion = "v2.0";', 'sql = "where Password = @password";', 'var secret = "payment/client-secret";', 'var token = "=>";', 'var token = "Token {0} is not valid!";'])
def test_words_and_references_do_not_count(text):
    assert s.detector().find([text], ["a.cs"])[0] == []


@pytest.mark.parametrize(("path", "text", "lines"), FOUND)
def test_found(path, text, lines):
    hits = s.detector().find([text], [path])[0]
    assert sorted({s.line_of(text, x.at) for x in hits}) == lines
    clean = s.blanked(text, hits)
    assert len(clean) == len(text) and clean.count("\n") == text.count("\n") and clean.count('"') == text.count('"')
    assert not s.detector().find([clean], [path])[0] or "x" in clean
    for hit in hits:
        for a, b in hit.spans:
            assert set(clean[a:b]) <= set("x\r\n\"'")


@pytest.mark.parametrize(("path", "text"), CLEAN)
def test_clean(path, text):
    assert s.detector().find([text], [path])[0] == []


def test_needed_trigrams_are_needed():
    for name, pattern in s.PATTERNS.items():
        needs = trigrams.required(pattern)
        assert needs is not True, name
        for path, text, _ in FOUND:
            for m in re.finditer(pattern, text):
                assert trigrams.holds(needs, text[m.start() : m.end()].lower()), (name, path)


@pytest.mark.parametrize(
    ("pattern", "needs"),
    [
        ("abcd", ("and", frozenset(["abc", "bcd"]))), ("a?b*", True), ("(abc)+x", ("and", frozenset(["abc", "bcx"]))), ("abc|xyz", ("or", frozenset(["abc", "xyz"]))), ("abc|x", True), ("ab[cd]", ("or", frozenset(["abc", "abd"]))), ("pw ?=", ("or", frozenset(["pw=", ("and", frozenset(["pw ", "w ="]))]))), ("a.bcd", "bcd"), ("(?i)ABC", "abc"),
    ],
)
def test_required_trigrams(pattern, needs):
    assert trigrams.required(pattern) == needs


SMALL = st.recursive(st.sampled_from(["a", "b", "c", "ab", "[ab]", "é", r"\s"]), lambda x: st.builds("({}{})".format, x, x) | st.builds("({}|{})".format, x, x) | st.builds("({})?".format, x) | st.builds("({})+".format, x) | st.builds("({})*".format, x), max_leaves=8)


@settings(max_examples=400, deadline=None)
@given(SMALL, st.text("abcé \n", max_size=8))
def test_index_loses_no_match(pattern, text):
    needs = trigrams.required(pattern)
    if re.search(pattern, text):
        assert trigrams.holds(needs, text)
    chunks = ["abc", text, "", "é" + text, text[::-1]]
    answer = trigrams.TrigramIndex([needs]).postings(chunks).answer(needs)
    assert all(a or not trigrams.holds(needs, c) for a, c in zip(answer, chunks))
    if needs is not True and all(g.isascii() for g in trigrams.names(needs)):
        assert [bool(a) for a in answer] == [trigrams.holds(needs, c) for c in chunks]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9000), max_size=12), st.booleans())
def test_chunks_cover_the_text_and_overlap(lengths, ends):
    text = "\n".join("x" * n for n in lengths) + ("\n" if ends else "")
    bounds = s.chunk_bounds(text)
    if not text:
        assert bounds == []
        return
    assert bounds[0][0] == 0 and bounds[-1][1] == len(text) and all(c[0] < d[0] <= c[1] for c, d in zip(bounds, bounds[1:]))
    for (_, end), (start, _) in zip(bounds, bounds[1:]):
        assert end == len(text) or sum(bool(x.strip()) for x in text[start:end].split("\n")) >= s.OVERLAP_LINES


BLANKED = [
    ("a.cs", r'string password = "ab\"c9d3f7Kq";', 'string password = "xxxxxxxxxxxx";'), ("a.cs", 'var password = $"{prefix}a9X7kq22";', 'var password = $"{prefix}xxxxxxxx";'), ("a.cs", 'var password = @"ab""cd9\\";', 'var password = @"xxxxxxxx";'),
    ("a.vb", 'Dim password = "ab""c9d3f7"', 'Dim password = "xxxxxxxxxx"'), ("a.vb", 'Dim pwd = "q7w3e9r1\\" & x', 'Dim pwd = "xxxxxxxxx" & x'), ("a.cs", r'c = "Server=x;Password=ab\"c9d3f7Kq;Y=1";', 'c = "Server=x;Password=xxxxxxxxxxxx;Y=1";'), ("a.cs", 'var password = $@"9X""7kq22{y}z";', 'var password = $@"xxxxxxxxx{y}x";'),
    ("a.cs", 'new NetworkCredential("u", "hd\\"qa5wxeq2");', 'new NetworkCredential("u", "xxxxxxxxxxxx");'), ("a.config", '<add key="ASecret" value="q9str2qs\\" x="1" />', '<add key="ASecret" value="xxxxxxxxx" x="1" />'), ("a.cs", 'var password = """q9s"tr2qs""";', 'var password = """xxxxxxxxx""";'),
    ("a.cs", 'var password = "correcthorse"; pass = "a9"; var x = 1;', 'var password = "xxxxxxxxxxxx"; pass = "xx"; var x = 1;'), ("a.cs", 'string pw = "k3Jq"; string key = "a9X7kq22kz81";', 'string pw = "xxxx"; string key = "xxxxxxxxxxxx";'),
]


@pytest.mark.parametrize(("path", "text", "clean"), BLANKED)
def test_blanking_keeps_the_code_whole(path, text, clean):
    assert s.blanked(text, s.detector().find([text], [path])[0]) == clean
    if path.endswith((".cs", ".vb")):
        wrap = "class C {{ void M() {{ {} }} }}" if path.endswith("cs") else "Class C\nSub M()\n{}\nEnd Sub\nEnd Class\n"
        for code in (text, clean):
            assert syntax.parses(path, wrap.format(code)), code


def test_names_of_any_length():
    text = "var " + "very_long_" * 30 + 'password_hint = "a9X7kq22"; ' + "very_long_" * 30 + 'password = "a9X7kq22";'
    assert [h.at for h in s.detector().find([text], ["a.cs"])[0]] == [text.rindex("a9X7kq22")]


def test_candidates_lose_nothing_in_long_texts():
    filler = "// nothing to see in this line of text\n" * 400
    text = filler + 'var key = "31d30ec97cc308"\n    + "874e06e3a78e32f24c";\n' + filler + "// password = mill2004\n" + filler.replace("\n", "\r\n")
    bounds = s.chunk_bounds(text)
    assert bounds[0][0] == 0 and bounds[-1][1] == len(text) and all(b >= c for (_, b), (c, _) in zip(bounds, bounds[1:])) and len(bounds) > 8
    assert sorted({s.line_of(text, x.at) for x in s.detector().find([text], ["a.cs"])[0]}) == [401, 803]
    one_line = "x" * 20_000 + ' password = "mill2004x" ' + "y" * 20_000
    assert len(s.detector().find([one_line], ["a.cs"])[0]) == 1


def test_columns(spark):
    df = spark.createDataFrame([(1, "a.cs", "// password = mill2004\nx\n// password = mill2004", "p"), (2, None, None, "p"), (3, None, "// password = mill2004", "p"), (4, "a.cs", "", "p")], "id long, path string, text string, pattern string")
    assert sorted((r.id, r.line_no) for r in s.find_secrets(df, "id", "path", "text").collect()) == [(1, 1), (1, 3), (3, 1)]
    texts = {r.id: r.t for r in df.select("id", s.redacted_column(df.path, df.text).alias("t")).collect()}
    assert texts == {1: "// password = xxxxxxxx\nx\n// password = xxxxxxxx", 2: None, 3: "// password = xxxxxxxx", 4: ""}
    assert s.find_secrets(df.limit(0), "id", "path", "text").count() == 0


@pytest.mark.parametrize("gap", ["\n", "\n\n\n\n\n\n"])
@pytest.mark.parametrize("filler", ["x" * 5000 + " ", "// nothing to see here\n" * 179])
def test_a_match_over_many_lines_at_the_end_of_a_chunk(filler, gap):
    for shift in range(0, 60, 4):
        text = "y" * shift + filler + f'password ={gap}"mill2004";\n' + "// nothing to see here\n" * 400
        assert [s.line_of(text, x.at) for x in s.detector().find([text], ["a.cs"])[0]] == [text[: text.index("mill2004")].count("\n") + 1]
