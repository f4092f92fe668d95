"""C#: tokens and grammar for the recogniser."""

from __future__ import annotations

import re
from functools import lru_cache

from gneiss.llm.gll import Grammar

# The reserved words of the language, and words that mean something in some places only.
RESERVED = (
    "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto "
    "if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc "
    "static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while __arglist"
).split()
CONTEXTUAL = (
    "add alias allows and ascending async await by descending equals extension file from get global group init into join let managed not on or orderby partial record remove required scoped select set "
    "unmanaged var when where with yield"
).split()
PREDEFINED = "bool byte char decimal double float int long object sbyte short string uint ulong ushort void".split()

_ESCAPE = r"\\(?:['\"\\0abefnrtv]|x[0-9A-Fa-f]{1,4}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})"
# white space goes with the token after it; the groups are numbered in the order of the names below
_TOKEN = re.compile(
    rf"""[ \t\f\v\r\n\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000\ufeff\u0085\u2028\u2029\x1a]*(?:
([^\W\d]\w*)
|(\.(?!\.|\d)|[;(){{}},\[\]]|\?\?=|<<=|\.\.|\?\?|=>|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|->|::|<<|/(?![/*])|[-+*%&|^!~=<>?:])
|("(?!"")(?:[^"\\\r\n\u0085\u2028\u2029]|{_ESCAPE})*"(?:u8\b)?)
|(0[xX][0-9A-Fa-f_]+[uUlL]{{0,2}}|0[bB][01_]+[uUlL]{{0,2}}|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][-+]?\d[\d_]*)?[fFdDmM]?|\d[\d_]*(?:[eE][-+]?\d[\d_]*)?(?:[fFdDmM]|[uUlL]{{1,2}})?)
|(//[^\r\n]*|/\*[\s\S]*?\*/)
|('(?:[^'\\\r\n\u0085\u2028\u2029]|{_ESCAPE})')
|([$@]*")
|(@[^\W\d]\w*)
|(\#[^\r\n]*)
|\Z)""",
    re.X,
)
_WORD, _OP, _TEXT, _NUMBER, _COMMENT, _CHAR, _SPECIAL, _QUOTED, _DIRECTIVE = range(1, 10)
_PLAIN = re.compile(rf'(?:[^"\\\r\n\u0085\u2028\u2029]|{_ESCAPE})*"')
_VERBATIM = re.compile(r'(?:[^"]|"")*"')
_MARKER = re.compile(r"^(?:<{7}|>{7}|\|{7}|={7})(?: |\r?$)", re.M)
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|\Z)")
_SUFFIX = re.compile(r"u8\b", re.I)

ID = ["id", *CONTEXTUAL]

GRAMMAR = """
unit: extern* using* globalattrs* (filens | typelike*) ';'*
program: extern* using* globalattrs* stmt+ typelike*
extern: 'extern' 'alias' ID ';'
using: 'global'? 'using' ('static'? 'unsafe'? type | ID '=' 'unsafe'? type) ';'
globalattrs: '[' ID ':' attr (',' attr)* ','? ']'
filens: 'namespace' dotted ';' extern* using* typelike*
nsdecl: 'namespace' dotted '{' extern* using* typelike* '}' ';'?
typelike: nsdecl | attrs* _modifier* typedecl
dotted: ID ('.' ID)*
attrs: '[' ((ID | 'return' | 'event') ':')? attr (',' attr)* ','? ']'
attr: name ('(' args? ')')?
_modifier: 'abstract' | 'async' | 'const' | 'extern' | 'file' | 'fixed' | 'internal' | 'new' | 'override' | 'partial' | 'private' | 'protected' | 'public' | 'readonly' | 'ref' | 'required' | 'sealed' | 'static' | 'unsafe' | 'virtual' | 'volatile' | 'scoped'
typedecl: ('class' | 'struct' | 'interface' | 'record' ('class' | 'struct')?) ID typeparams? params? bases? where* (classbody | ';') | enumdecl | delegatedecl
classbody: '{' member* '}' ';'?
enumdecl: 'enum' ID (':' type)? '{' (enumitem (',' enumitem)* ','?)? '}' ';'?
enumitem: attrs* ID ('=' expr)?
delegatedecl: 'delegate' 'ref'? 'readonly'? type ID typeparams? params where* ';'
bases: ':' type ('(' args? ')')? (',' type)*
typeparams: '<' typeparam (',' typeparam)* '>'
typeparam: attrs* ('in' | 'out')? ID
where: 'where' ID ':' constraint (',' constraint)*
constraint: type | 'class' '?'? | 'struct' | 'new' '(' ')' | 'default' | 'allows' 'ref' 'struct'
params: '(' (param (',' param)*)? ')'
param: attrs* ('this' | 'ref' | 'out' | 'in' | 'params' | 'scoped' | 'readonly')* type ID ('=' expr)? | '__arglist'
member: attrs* _modifier* (typedecl | 'event' type _eventrest | type _memberrest | ID params _ctorinit? body | '~' ID '(' ')' body | ('implicit' | 'explicit') (name '.')? 'operator' 'checked'? type params body | 'extension' typeparams? params where* classbody)
_eventrest: _declarators ';' | _membername '{' accessor+ '}'
_memberrest: _declarators ';' | _membername typeparams? params where* body | _membername _proprest | (name '.')? 'this' '[' param (',' param)* ']' _proprest | (name '.')? 'operator' 'checked'? _opsign params body | ID '[' expr ']' (',' ID '[' expr ']')* ';'
_membername: ID | name '.' ID
_proprest: '{' accessor+ '}' ('=' varinit ';')? | '=>' expr ';'
accessor: attrs* _modifier* ('get' | 'set' | 'init' | 'add' | 'remove') body
_ctorinit: ':' ('this' | 'base') '(' args? ')'
body: block ';'? | '=>' expr ';' | ';'
_opsign: '+' | '-' | '!' | '~' | '++' | '--' | 'true' | 'false' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>' '>' | '>' '>' '>' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>='
_declarators: declarator (',' declarator)*
declarator: ID ('=' varinit)?
varinit: expr | init
type: _typecore _typesuffix*
_typesuffix: '?' | '*' | '[' ','* ']'
_typecore: _predefined | name | '(' tupleitem (',' tupleitem)+ ')' | 'delegate' '*' (ID ('[' ID (',' ID)* ']')?)? '<' _fparam (',' _fparam)* '>' | 'ref' 'readonly'? type | 'scoped' type
_fparam: ('ref' | 'in' | 'out' | 'readonly')* type
tupleitem: type ID?
_predefined: 'bool' | 'byte' | 'char' | 'decimal' | 'double' | 'float' | 'int' | 'long' | 'object' | 'sbyte' | 'short' | 'string' | 'uint' | 'ulong' | 'ushort' | 'void'
name: (ID '::')? ID typeargs? ('.' ID typeargs?)*
typeargs: '<' (attrs* type (',' attrs* type)* | ','*) '>'
block: '{' stmt* '}'
stmt: block | ';' | ID ':' stmt | attrs* _localdecl | expr ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | _forstmt | 'await'? 'foreach' '(' _foreachvar 'in' expr ')' stmt | 'switch' _switchhead '{' section* '}' | 'break' ';' | 'continue' ';' | 'goto' (ID | 'case' expr | 'default') ';' | 'return' expr? ';' | 'throw' expr? ';' | 'try' block (catch+ finally? | finally) | _usingstmt | 'lock' '(' expr ')' stmt | 'fixed' '(' type _declarators ')' stmt | ('checked' | 'unchecked' | 'unsafe') block | 'yield' ('return' expr | 'break') ';'
_switchhead: '(' expr (',' expr)* ')'
_foreachvar: ('ref' 'readonly'? | 'scoped')? type ID | 'var' designation | '(' tupleelem (',' tupleelem)+ ')'
_forstmt: 'for' '(' (type _declarators | expr (',' expr)*)? ';' expr? ';' (expr (',' expr)*)? ')' stmt
section: ('case' pattern ('when' expr)? ':' | 'default' ':')+ stmt+
catch: 'catch' ('(' type ID? ')')? ('when' '(' expr ')')? block
finally: 'finally' block
_usingstmt: 'await'? 'using' ('(' (type _declarators | expr) ')' stmt | type _declarators ';')
_localdecl: _localmod* type (_declarators ';' | ID typeparams? params where* (block | '=>' expr ';' | ';'))
_localmod: 'const' | 'static' | 'async' | 'unsafe' | 'extern' | 'ref' | 'readonly' | 'scoped'
args: arg (',' arg)*
arg: (ID ':')? (('ref' | 'in' | 'out')? expr | 'out' type designation)
designation: ID | '(' designation (',' designation)+ ')'
expr: (operand | '..' operand?) (_binop operand | '..' operand? | '=' init | 'is' pattern | 'as' type | '?' expr ':' expr | 'switch' '{' (arm (',' arm)* ','?)? '}' | 'with' init)*
_binop: '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '&&' | '||' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '??' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '??=' | '<<=' | '>' '>=' | '>' '>' '>='
operand: _prefix* _primary _postfix*
_prefix: '+' | '-' | '!' | '~' | '++' | '--' | '&' | '*' | '^' | 'await' | 'throw' | 'ref' | '(' type ')'
_primary: 'number' | 'string' | 'char' | 'true' | 'false' | 'null' | 'this' | 'base' | interpolated | ID typeargs? | ID '::' ID typeargs? | _predefined | '(' tupleelem (',' tupleelem)* ')' | collection | newexpr | 'typeof' '(' type ')' | 'sizeof' '(' type ')' | 'default' ('(' type ')')? | ('checked' | 'unchecked') '(' expr ')' | 'stackalloc' (type ('[' expr? ']')? init? | '[' expr? ']' init) | attrs* _lambdamod* 'delegate' params? block | lambda | query | '__arglist' ('(' args? ')')?
tupleelem: (ID ':')? (expr | type designation)
interpolated: 'open$' ('hole$' expr (',' expr)? 'format$'?)* 'close$'
collection: '[' (_element (',' _element)* ','?)? ']'
_element: expr | '..' expr
_postfix: ('.' | '?.' | '->') ID typeargs? | '?'? '[' args ']' | '(' args? ')' | '++' | '--' | '!'
newexpr: 'new' (_newtype ('(' args? ')' init? | init | _newrank+ init?) | '(' args? ')' init? | '[' ','* ']' init | '{' (_anonymous (',' _anonymous)* ','?)? '}')
_newtype: (_predefined | name | '(' tupleitem (',' tupleitem)+ ')') ('?' | '*')*
_newrank: '[' (expr (',' expr)* | ','*) ']' '?'?
_anonymous: (ID '=')? expr
init: '{' (inititem (',' inititem)* ','?)? '}'
inititem: expr | init | '[' args ']' '=' (expr | init)
lambda: attrs* _lambdamod* (ID | type? lambdaparams) '=>' (expr | block)
_lambdamod: 'async' | 'static'
lambdaparams: '(' (lambdaparam (',' lambdaparam)*)? ')'
lambdaparam: attrs* ('ref' | 'out' | 'in' | 'params' | 'scoped' | 'readonly' | 'this')* type? ID ('=' expr)?
arm: pattern ('when' expr)? '=>' expr
pattern: subpattern (('and' | 'or') subpattern)*
subpattern: 'not'* (_patternvalue | ('<' | '>' | '<=' | '>=') patternoperand | type designation? | 'var' designation | '(' pattern ')' | type? '(' (subfield (',' subfield)*)? ')' propertypattern? ID? | type? propertypattern ID? | '[' (_listitem (',' _listitem)* ','?)? ']' ID? | '..' pattern?)
_listitem: pattern
propertypattern: '{' (subfield (',' subfield)* ','?)? '}'
subfield: (ID ('.' ID)* ':')? pattern
_patternvalue: patternoperand
patternoperand: operand (('+' | '-' | '*' | '/' | '%' | '|' | '&' | '^' | '<<') operand)*
query: 'from' type? ID 'in' expr querybody
querybody: queryclause* ('select' expr | 'group' expr 'by' expr) ('into' ID querybody)?
queryclause: 'from' type? ID 'in' expr | 'let' ID '=' expr | 'where' expr | 'join' type? ID 'in' expr 'on' expr 'equals' expr ('into' ID)? | 'orderby' expr ('ascending' | 'descending')? (',' expr ('ascending' | 'descending')?)*
"""


class Invalid(Exception):
    """The text has no tokens: a literal or comment is not closed, a character has no place, a directive is out of order."""


_WORDS = {w: w for w in (*RESERVED, *CONTEXTUAL)}


def tokens(text: str) -> list[str]:
    """Token kinds of a text, with parts that conditional compilation leaves out left out (no symbol is defined from outside)."""
    out: list[str] = []
    end = _lex(text, 0, out, Directives(), None)
    assert end == len(text)
    return out


class Directives:
    """Nesting of conditional parts and regions."""

    def __init__(self) -> None:
        self.defined: set[str] = set()
        self.stack: list[list] = []  # ["if", taken, else seen] or ["region"]

    def test(self, condition: str) -> bool:
        words = re.findall(r"&&|\|\||==|!=|!|\(|\)|\w+", re.sub(r"//.*", "", condition))
        if "".join(words) != re.sub(r"\s+", "", re.sub(r"//.*", "", condition)) or not words:
            raise Invalid("condition")
        at = 0

        def either() -> bool:
            nonlocal at
            value = both()
            while at < len(words) and words[at] == "||":
                at += 1
                value = both() or value
            return value

        def both() -> bool:
            nonlocal at
            value = same()
            while at < len(words) and words[at] == "&&":
                at += 1
                value = same() and value
            return value

        def same() -> bool:
            nonlocal at
            value = one()
            while at < len(words) and words[at] in ("==", "!="):
                equal = words[at] == "=="
                at += 1
                value = (one() == value) == equal
            return value

        def one() -> bool:
            nonlocal at
            if at >= len(words):
                raise Invalid("condition")
            word = words[at]
            at += 1
            if word == "!":
                return not one()
            if word == "(":
                value = either()
                if at >= len(words) or words[at] != ")":
                    raise Invalid("condition")
                at += 1
                return value
            if not word[0].isalnum() and word[0] != "_":
                raise Invalid("condition")
            return word == "true" or word in self.defined

        value = either()
        if at != len(words):
            raise Invalid("condition")
        return value

    def line(self, directive: str, begun: bool) -> bool:
        """Take in a directive of a part that counts; whether what follows counts."""
        m = re.match(r"#\s*(\w*)\s*(.*)", directive, re.S)
        word, rest = m[1], m[2].strip()
        if word == "if":
            taken = self.test(rest)
            self.stack.append(["if", taken, False])
            return taken
        if word in ("elif", "else"):
            if not self.stack or self.stack[-1][0] != "if" or self.stack[-1][2]:
                raise Invalid("directive")
            self.stack[-1][2] = word == "else"
            return False  # the part before was taken
        if word == "endif":
            if not self.stack or self.stack[-1][0] != "if":
                raise Invalid("directive")
            self.stack.pop()
        elif word == "region":
            self.stack.append(["region"])
        elif word == "endregion":
            if not self.stack or self.stack[-1][0] != "region":
                raise Invalid("directive")
            self.stack.pop()
        elif word in ("define", "undef"):
            if begun or not re.fullmatch(r"[^\W\d]\w*(?:\s*//.*)?", rest):
                raise Invalid("directive")
            name = re.match(r"\w+", rest)[0]
            (self.defined.add if word == "define" else self.defined.discard)(name)
        elif word == "error" or word not in ("warning", "line", "pragma", "nullable", "r", "load", ""):
            if not directive.startswith("#!") and not directive.startswith("#:"):
                raise Invalid("directive")
        return True

    def skip(self, text: str, at: int) -> int:
        """From the start of a line that does not count, the place where the next part that counts begins."""
        depth = 0
        while at < len(text):
            m = _LINE.match(text, at)
            line = m[0].strip()
            at = m.end()
            if not line.startswith("#"):
                if m.end() == m.start():
                    break
                continue
            word, rest = re.match(r"#\s*(\w*)\s*(.*)", line, re.S).groups()
            if word == "if":
                depth += 1
            elif word == "endif":
                if not depth:
                    self.stack.pop()
                    return at
                depth -= 1
            elif not depth and word in ("elif", "else"):
                top = self.stack[-1]
                if top[2]:
                    raise Invalid("directive")
                top[2] = word == "else"
                if not top[1] and (word == "else" or self.test(rest)):
                    top[1] = True
                    return at
        raise Invalid("a conditional part is open")


def _starts_line(text: str, at: int) -> bool:
    """Whether only white space comes before a place on its line."""
    while at and text[at - 1] in " \t\f\v\ufeff":
        at -= 1
    return not at or text[at - 1] in "\r\n\u0085\u2028\u2029"


def _lex(text: str, at: int, out: list[str], directives: Directives | None, stop: str | None) -> int:
    """Append token kinds from ``at`` on; in a hole of an interpolated string up to its end, which is returned."""
    match, words, put = _TOKEN.match, _WORDS, out.append
    depth = 0
    while True:
        m = match(text, at)
        if m is None:
            raise Invalid(f"character at {at}")
        kind = m.lastindex
        at = m.end()
        if kind == _WORD:
            word = m[1]
            put(words[word] if word in words else "id")
        elif kind == _OP:
            op = m[2]
            if stop is not None:
                if op in "([{":
                    depth += 1
                elif op in ")]}":
                    if depth == 0:
                        return at - 1
                    depth -= 1
                elif depth == 0 and op == ":":
                    return at - 1
            if op == ",":
                # of numbers in a list, whatever list it is, one stands for all that follow each other
                if out[-4:] == _NUMBERS:
                    del out[-2:]
            elif op in _MARKS:
                if op == "?":
                    if text.startswith(".", at) and not text[at + 1 : at + 2].isdigit() and not text.startswith("..", at):
                        op = "?."
                        at += 1
                elif _MARKER.match(text, at - len(op)):
                    raise Invalid("conflict marker")
            put(op)
        elif kind == _TEXT:
            put("string")
        elif kind == _NUMBER:
            put("number")
        elif kind == _COMMENT:
            continue
        elif kind == _CHAR:
            put("char")
        elif kind == _SPECIAL:
            at = _string(text, m.start(7), out)
        elif kind == _QUOTED:
            put("id")
        elif kind == _DIRECTIVE:
            if directives is None or not _starts_line(text, m.start(9)):
                raise Invalid("directive")
            if not directives.line(m[9], bool(out)):
                at = directives.skip(text, _LINE.match(text, at).end())
        else:
            break
    if stop is not None:
        raise Invalid("an interpolation is open")
    if directives is not None and directives.stack:
        raise Invalid("a region or conditional part is open")
    return at


_NUMBERS = [",", "number", ",", "number"]
_MARKS = frozenset(["?", "<<", ">", "==", "||"])


def _string(text: str, at: int, out: list[str]) -> int:
    """A string of any kind that begins at ``at``; its end."""
    start = at
    while text[at : at + 1] in ("$", "@"):
        at += 1
    marks = text[start:at]
    quotes = at
    while text[quotes : quotes + 1] == '"':
        quotes += 1
    count = quotes - at
    dollars = marks.count("$")
    if count >= 3 and "@" not in marks:
        closing = text.find('"' * count, quotes)
        if closing < 0:
            raise Invalid("a raw string is open")
        while text[closing + count : closing + count + 1] == '"':
            closing += 1
        inside = text[quotes:closing]
        if "\n" not in inside and not inside:
            raise Invalid("an empty raw string")
        if dollars:
            _holes_raw(inside, dollars, out)
        else:
            out.append("string")
        end = closing + count
        m = _SUFFIX.match(text, end)
        return m.end() if m else end
    if not dollars:
        m = (_VERBATIM if "@" in marks else _PLAIN).match(text, at + 1)
        if not m:
            raise Invalid("a string is open")
        out.append("string")
        suffix = _SUFFIX.match(text, m.end())
        return suffix.end() if suffix else m.end()
    if dollars > 1 or marks.count("@") > 1:
        raise Invalid("marks of a string")
    verbatim = "@" in marks
    out.append("open$")
    at += 1
    while True:
        c = text[at : at + 1]
        if not c or not verbatim and c in "\r\n":
            raise Invalid("a string is open")
        if c == '"':
            if verbatim and text[at + 1 : at + 2] == '"':
                at += 2
                continue
            out.append("close$")
            return at + 1
        if c == "{":
            if text[at + 1 : at + 2] == "{":
                at += 2
                continue
            at = _hole(text, at + 1, out, verbatim)
            continue
        if c == "}":
            if text[at + 1 : at + 2] != "}":
                raise Invalid("a brace in a string")
            at += 2
            continue
        if c == "\\" and not verbatim:
            m = re.compile(_ESCAPE).match(text, at)
            if not m:
                raise Invalid("an escape")
            at = m.end()
            continue
        at += 1


def _hole(text: str, at: int, out: list[str], verbatim: bool) -> int:
    out.append("hole$")
    at = _lex(text, at, out, None, "}")
    if text[at] == ":":
        m = re.compile(r"(?:[^{}\"\r\n]|\{\{|\}\})*" if not verbatim else r"(?:[^{}\"]|\{\{|\}\}|\"\")*").match(text, at + 1)
        at = m.end()
        out.append("format$")
    if text[at : at + 1] != "}":
        raise Invalid("an interpolation is open")
    return at + 1


def _holes_raw(inside: str, dollars: int, out: list[str]) -> None:
    out.append("open$")
    at = 0
    while at < len(inside):
        if inside[at] == "{":
            run = len(inside[at:]) - len(inside[at:].lstrip("{"))
            if run >= 2 * dollars:
                raise Invalid("braces in a raw string")
            if run >= dollars:
                at = _hole(inside, at + run, out, True) - 1
                if inside[at : at + dollars] != "}" * dollars:
                    raise Invalid("an interpolation is open")
                at += dollars
                continue
            at += run
            continue
        at += 1
    out.append("close$")


@lru_cache(maxsize=1)
def grammar() -> Grammar:
    return Grammar(GRAMMAR, {"ID": ID}, ["unit", "program"])


#: The dialects: a file of declarations, and one that begins with statements.
DIALECTS = ("unit", "program")


def valid(text: str) -> bool:
    """Whether some dialect accepts the text."""
    try:
        kinds = tokens(text)
    except (Invalid, RecursionError):
        return False
    known = grammar()
    return known.accepts(known.encode(kinds), DIALECTS)
