"""Visual Basic: tokens and grammar for the recogniser.

A logical line ends with the token ``nl``. Line ends after an open bracket, a comma or an operator, before a closing bracket, and
after an underscore do not count, as the language has it. XML literals are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

from gneiss.llm.csharp import Invalid
from gneiss.llm.gll import Grammar

# The reserved words of the language, and words that mean something in some places only.
RESERVED = (
    "addhandler addressof alias and andalso as boolean byref byte byval call case catch cbool cbyte cchar cdate cdbl cdec char cint class clng cobj const continue csbyte cshort csng cstr ctype cuint culng "
    "cushort date decimal declare default delegate dim directcast do double each else elseif end endif enum erase error event exit false finally for friend function get gettype getxmlnamespace global gosub goto "
    "handles if implements imports in inherits integer interface is isnot let lib like long loop me mod module mustinherit mustoverride mybase myclass namespace narrowing new next not nothing "
    "notinheritable notoverridable object of on operator option optional or orelse overloads overridable overrides paramarray partial private property protected public raiseevent readonly redim "
    "rem removehandler resume return sbyte select set shadows shared short single static step stop string structure sub synclock then throw to true try trycast typeof uinteger ulong ushort using variant "
    "wend when while widening with withevents writeonly xor"
).split()
CONTEXTUAL = "aggregate ansi ascending assembly async auto await binary by compare custom descending distinct equals explicit from group infer into isfalse istrue iterator join key let mid off order preserve skip strict take text unicode until where yield".split()

_TOKEN = re.compile(
    r"""(?P<skip>[ \t\f\v\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000\ufeff]+)
|(?P<join>_[ \t]*(?:'[^\r\n]*)?(?:\r\n|\r|\n))
|(?P<comment>['\u2018\u2019][^\r\n]*|rem(?=[ \t\r\n]|\Z)[^\r\n]*)
|(?P<nl>\r\n|\r|\n|\u2028|\u2029|\u0085)
|(?P<interpolated>\$["\u201c\u201d])
|(?P<string>["\u201c\u201d](?:[^"\u201c\u201d]|["\u201c\u201d]{2})*["\u201c\u201d]c?)
|(?P<date>\#[ \t]*\d[^#\r\n]*\#)
|(?P<directive>\#[^\r\n]*)
|(?P<number>&h[0-9a-f_]+(?:ui|ul|us|[sil%&])?|&o[0-7_]+(?:ui|ul|us|[sil%&])?|&b[01_]+(?:ui|ul|us|[sil%&])?|(?:\d[\d_]*)?\.\d[\d_]*(?:e[-+]?\d+)?[fdr!\#@]?|\d[\d_]*(?:e[-+]?\d+)?(?:ui|ul|us|[silfdr%&!\#@])?)
|(?P<word>\[[^\W\d]\w*\]|[^\W\d]\w*[%&@!\#$]?(?!\w))
|(?P<op>:=|<>|><|<=|=<|>=|=>|<<=|>>=|<<|>>|\^=|\*=|/=|\\=|\+=|-=|&=|\?\.|[-+*/\\^&=<>?:,.(){}!@])""",
    re.X | re.I,
)
_MARKER = re.compile(r"^(?:<{7}|>{7}|\|{7}|={7})(?: |\r?$)", re.M)

_AFTER = frozenset(["(", "{", ",", "+", "-", "*", "/", "\\", "^", "&", "<<", ">>", "=", "<>", "<=", ">=", "+=", "-=", "*=", "/=", "\\=", "^=", "&=", "<<=", ">>=", ":=", ".", "?.", "!", "and", "or", "andalso", "orelse", "xor", "mod", "like", "is", "isnot", "of", "from", "in", "open$", "hole$", "by"])
_BEFORE = frozenset([")", "}"])

ID = ["id", *CONTEXTUAL]
#: After a dot every word is a name.
ANY = ["id", *CONTEXTUAL, *RESERVED]

GRAMMAR = """
unit: _t* (option _t+)* (imports _t+)* (fileattrs _t+)* (typelike _t+)*
_t: 'nl' | ':'
option: 'option' ('strict' | 'explicit' | 'infer' | 'compare') ('on' | 'off' | 'binary' | 'text')?
imports: 'imports' import (',' import)*
import: type | ID '=' type
fileattrs: '<' fileattr (',' fileattr)* '>'
fileattr: ('assembly' | 'module') ':' attr
typelike: 'namespace' ('global' | ID) ('.' _ANYID)* _t+ (typelike _t+)* 'end' 'namespace' | attrs? _modifier* typedecl
_ANYID: ANY
attrs: ('<' attr (',' attr)* '>' 'nl'?)+
attr: (('assembly' | 'module' | 'return') ':')? name ('(' args? ')')?
_modifier: _concrete | 'mustoverride'
_concrete: 'public' | 'private' | 'protected' | 'friend' | 'shared' | 'shadows' | 'static' | 'partial' | 'mustinherit' | 'notinheritable' | 'notoverridable' | 'overridable' | 'overrides' | 'overloads' | 'readonly' | 'writeonly' | 'default' | 'const' | 'dim' | 'withevents' | 'widening' | 'narrowing' | 'async' | 'iterator' | 'custom'
typedecl: 'class' ID typeparams? _t+ ('inherits' type _t+)? ('implements' type (',' type)* _t+)* (member _t+)* 'end' 'class' | 'structure' ID typeparams? _t+ ('implements' type (',' type)* _t+)* (member _t+)* 'end' 'structure' | 'module' ID _t+ (member _t+)* 'end' 'module' | 'interface' ID typeparams? _t+ ('inherits' type (',' type)* _t+)* (interfacemember _t+)* 'end' 'interface' | 'enum' ID ('as' type)? _t+ (attrs? ID ('=' expr)? _t+)* 'end' 'enum' | 'delegate' ('sub' | 'function') ID typeparams? params? returns?
typeparams: '(' 'of' typeparam (',' typeparam)* ')'
typeparam: ('in' | ID)? ID ('as' constraints)? | 'in'? ID ('as' constraints)?
constraints: constraint | '{' constraint (',' constraint)* '}'
constraint: type | 'new' | 'class' | 'structure'
returns: 'as' attrs? type
params: '(' (param (',' param)*)? ')'
param: attrs? ('byval' | 'byref' | 'optional' | 'paramarray')* ID ('?')? ranks? ('as' attrs? type)? ('=' expr)?
ranks: ('(' ','* ')')+
interfacemember: attrs? _modifier* ('sub' ID typeparams? params? | 'function' ID typeparams? params? returns? | 'property' ID params? returns? | 'event' ID (params | 'as' type)? | typedecl)
member: attrs? (_modifier* (typedecl | property | event | operatordecl | declare) | _concrete* method | abstract | _concrete+ fields)
fields: field (',' field)*
field: ID '?'? bounds? (',' ID '?'? bounds?)* ('as' newtype)? ('=' expr)?
bounds: '(' (bound (',' bound)* | ','*) ')' ranks?
bound: expr ('to' expr)?
newtype: type | 'new' type ('(' args? ')')? ('with' objectinit | 'from' collection)?
method: _subhead _t+ body 'end' 'sub' | _functionhead _t+ body 'end' 'function'
_subhead: 'sub' (ID | 'new') typeparams? params? handles?
_functionhead: 'function' ID typeparams? params? returns? handles?
abstract: _modifier* 'mustoverride' _modifier* (_subhead | _functionhead)
handles: ('handles' | 'implements') handle (',' handle)*
handle: (ID | 'me' | 'mybase' | 'myclass' | 'global') (('(' 'of' type (',' type)* ')')? '.' _ANYID)* ('(' 'of' type (',' type)* ')')?
property: 'property' ID params? ('as' newtype)? ('=' expr)? handles? (_t+ (accessor _t+)+ 'end' 'property')?
accessor: attrs? _modifier* ('get' _t+ body 'end' 'get' | 'set' params? _t+ body 'end' 'set')
event: 'event' ID (params | 'as' type)? handles? (_t+ (attrs? ('addhandler' | 'removehandler' | 'raiseevent') params _t+ body 'end' ('addhandler' | 'removehandler' | 'raiseevent') _t+)+ 'end' 'event')?
operatordecl: 'operator' (_opsign | 'ctype' | 'istrue' | 'isfalse' | 'not') params returns? _t+ body 'end' 'operator'
_opsign: '+' | '-' | '*' | '/' | '\\' | '^' | '&' | '=' | '<>' | '<' | '>' | '<=' | '>=' | '<<' | '>>' | 'and' | 'or' | 'xor' | 'mod' | 'like'
declare: 'declare' ('ansi' | 'unicode' | 'auto')? ('sub' | 'function') ID 'lib' 'string' ('alias' 'string')? params? returns?
type: _typecore '?'? ranks?
_typecore: ('global' | ID | _primitive) ('(' 'of' typelist ')')? ('.' _ANYID ('(' 'of' typelist ')')?)* | '(' tupletype (',' tupletype)+ ')'
tupletype: (ID 'as')? type
typelist: type (',' type)* | ','*
name: ('global' | ID | _primitive) ('(' 'of' typelist ')')? ('.' _ANYID ('(' 'of' typelist ')')?)*
_primitive: 'boolean' | 'byte' | 'char' | 'date' | 'decimal' | 'double' | 'integer' | 'long' | 'object' | 'sbyte' | 'short' | 'single' | 'string' | 'uinteger' | 'ulong' | 'ushort'
body: (_t | labelled _t | stmt _t)*
labelled: (ID | 'number') ':' stmt?
stmt: blockstmt | simple
simple: local | expression | 'call' postfixed | 'return' expr? | 'throw' expr? | 'exit' ('sub' | 'function' | 'property' | 'do' | 'for' | 'while' | 'select' | 'try' | 'operator') | 'continue' ('do' | 'for' | 'while') | 'goto' (ID | 'number') | 'on' 'error' ('resume' 'next' | 'goto' (ID | 'number' | '-' 'number')) | 'resume' ('next' | ID | 'number')? | 'error' expr | 'raiseevent' ID ('(' args? ')')? | ('addhandler' | 'removehandler') expr ',' expr | 'redim' 'preserve'? postfixed (',' postfixed)* | 'erase' postfixed (',' postfixed)* | 'stop' | 'end' | 'yield' expr | 'await' operand | 'mid' '(' args ')' '=' expr | singleif
local: attrs? ('dim' | 'const' | 'static' | 'shared' | 'readonly' | 'private' | 'public' | 'friend')+ fields
expression: postfixed (_assign expr)?
_assign: '=' | '+=' | '-=' | '*=' | '/=' | '\\=' | '^=' | '&=' | '<<=' | '>>='
singleif: 'if' expr 'then' simples ('else' simples?)?
simples: simple (':' simple?)*
blockstmt: 'if' expr 'then'? _t body ('elseif' expr 'then'? _t body | 'else' 'if' expr 'then'? _t body)* ('else' _t body)? ('end' 'if' | 'endif') | 'select' 'case'? expr _t+ ('case' cases _t body)* ('case' 'else' _t body)? 'end' 'select' | 'while' expr _t body ('end' 'while' | 'wend') | 'do' (('while' | 'until') expr)? _t body 'loop' (('while' | 'until') expr)? | forstmt _t body ('next' (postfixed (',' postfixed)*)?) | 'try' _t body ('catch' (ID ('as' type)?)? ('when' expr)? _t body)* ('finally' _t body)? 'end' 'try' | 'using' (fields | expr) _t body 'end' 'using' | 'synclock' expr _t body 'end' 'synclock' | 'with' expr _t body 'end' 'with'
forstmt: 'for' (postfixed ('as' type)? '=' expr 'to' expr ('step' expr)? | 'each' postfixed ('as' type)? 'in' expr)
cases: caseitem (',' caseitem)*
caseitem: expr ('to' expr)? | 'is'? ('=' | '<>' | '<' | '>' | '<=' | '>=') expr
args: arg? (',' arg?)*
arg: ((_ANYID ':=')? expr ('to' expr)?) | 'of' typelist
expr: _unary* operand (_binop _unary* operand)*
_unary: '+' | '-' | 'not' | 'addressof'
_binop: '+' | '-' | '*' | '/' | '\\' | '^' | '&' | '=' | '<>' | '<' | '>' | '<=' | '>=' | '<<' | '>>' | 'and' | 'or' | 'andalso' | 'orelse' | 'xor' | 'mod' | 'like' | 'is' | 'isnot'
operand: 'await'? postfixed | 'typeof' postfixed ('is' | 'isnot') type | lambda | query
postfixed: _primary _post*
_post: ('.' | '?.' | '!') _ANYID | '(' args? ')' | '?' '(' args? ')' | '.' '@' _ANYID
_primary: 'number' | 'string' | 'date#' | 'true' | 'false' | 'nothing' | 'me' | 'mybase' | 'myclass' | 'global' | ID | _primitive | interpolated | '(' tupleitem (',' tupleitem)* ')' | collection | ('.' | '!') _ANYID | newexpr | ('ctype' | 'directcast' | 'trycast') '(' expr ',' type ')' | _cast '(' expr ')' | 'gettype' '(' type ')' | 'if' '(' args ')'
tupleitem: (ID ':=')? expr
_cast: 'cbool' | 'cbyte' | 'cchar' | 'cdate' | 'cdbl' | 'cdec' | 'cint' | 'clng' | 'cobj' | 'csbyte' | 'cshort' | 'csng' | 'cstr' | 'cuint' | 'culng' | 'cushort'
interpolated: 'open$' ('hole$' expr (',' expr)? 'format$'?)* 'close$'
collection: '{' (expr (',' expr)*)? '}'
newexpr: 'new' (newcore ('(' args? ')')* (collection | 'with' objectinit | 'from' collection)? | 'with' objectinit)
newcore: ('global' | ID | _primitive) ('(' 'of' typelist ')')? ('.' _ANYID ('(' 'of' typelist ')')?)* '?'?
objectinit: '{' (fieldinit (',' fieldinit)*)? '}'
fieldinit: 'key'? '.' _ANYID '=' expr | expr
lambda: ('async' | 'iterator')* ('function' params returns? (expr | _t body 'end' 'function') | 'sub' params (simple | blockstmt | _t body 'end' 'sub'))
query: ('from' | 'aggregate') queryvar (',' queryvar)* queryclause*
queryvar: ID '?'? ('as' type)? 'in' 'nl'? expr
queryclause: 'nl'? ('from' queryvar (',' queryvar)* | 'let' assigned (',' assigned)* | 'where' expr | 'order' 'by' expr ('ascending' | 'descending')? (',' expr ('ascending' | 'descending')?)* | 'select' assigned (',' assigned)* | 'distinct' | ('skip' | 'take') 'while'? expr | 'group'? 'join' queryvar 'on' expr ('into' assigned (',' assigned)*)? | 'group' (assigned (',' assigned)*)? 'by' assigned (',' assigned)* 'into' assigned (',' assigned)* | 'into' assigned (',' assigned)* | 'aggregate' queryvar)
assigned: (ID ('as' type)? '=')? expr ('equals' expr)?
"""


_WORDS = {w: w for w in (*RESERVED, *CONTEXTUAL)}
_QUOTES = '"\u201c\u201d'


def tokens(text: str) -> list[str]:
    """Token kinds of a text, with parts that conditional compilation leaves out left out."""
    out: list[str] = []
    _lex(text, 0, out, None)
    kinds = ["nl"]
    for i, kind in enumerate(out):
        if kind == "nl":
            if kinds[-1] in _AFTER:
                continue
            after = next((k for k in out[i + 1 :][:50] if k != "nl"), "nl")
            if after in _BEFORE:
                continue
        kinds.append(kind)
    kinds.append("nl")
    return kinds


def _true(condition: str, defined: dict[str, bool]) -> bool:
    """A condition of symbols and literals with Not, And, Or, AndAlso, OrElse; undefined symbols are false."""
    words = re.findall(r"\(|\)|<>|=|\"[^\"]*\"|\w+", condition.split("'")[0].lower())
    if words and words[-1] == "then":
        words.pop()
    if not words:
        raise Invalid("condition")
    at = 0

    def either() -> object:
        nonlocal at
        value = both()
        while at < len(words) and words[at] in ("or", "orelse", "xor"):
            at += 1
            value = bool(both()) or bool(value)
        return value

    def both() -> object:
        nonlocal at
        value = same()
        while at < len(words) and words[at] in ("and", "andalso"):
            at += 1
            value = bool(same()) and bool(value)
        return value

    def same() -> object:
        nonlocal at
        if at < len(words) and words[at] == "not":
            at += 1
            return not same()
        value = one()
        while at < len(words) and words[at] in ("=", "<>"):
            equal = words[at] == "="
            at += 1
            value = (value == one()) == equal
        return value

    def one() -> object:
        nonlocal at
        if at >= len(words):
            raise Invalid("condition")
        word = words[at]
        at += 1
        if word == "(":
            value = either()
            at += 1
            return value
        if word[0] == '"':
            return word
        if word.isdigit():
            return int(word)
        return word == "true" or defined.get(word, False)

    return bool(either())


def _lex(text: str, at: int, out: list[str], stop: str | None) -> int:
    match, words, n = _TOKEN.match, _WORDS, len(text)
    stack: list[list] = []
    defined: dict[str, bool] = {}
    depth = 0
    line_start = True
    while at < n:
        m = match(text, at)
        if m is None:
            raise Invalid(f"character at {at}")
        kind, end = m.lastgroup, m.end()
        if kind in ("skip", "comment"):
            at = end
            continue
        if kind == "join":
            if at and not (text[at - 1].isspace()):
                raise Invalid("an underscore")
            at = end
            continue
        if kind == "nl":
            if stop is not None:
                raise Invalid("an interpolation is open")
            out.append("nl")
            line_start = True
            at = end
            continue
        if line_start and text[at] in "<>=|" and _MARKER.match(text, at):
            raise Invalid("conflict marker")
        if kind == "word":
            word = m[0].lower()
            if word[-1] in "%&@!#$" and word[:-1] in words:
                word, end = word[:-1], end - 1
            # after a dot a word is a name, whatever it means elsewhere
            out.append("id" if out and out[-1] in (".", "?.", "!") else words.get(word, "id"))
        elif kind == "op" and m[0][0] == "<" and (past := _markup(text, at, out)) > 0:
            line_start = False
            at = past
            continue
        elif kind == "op" and m[0] == "@" and out[-1:] == ["."]:  # an attribute of markup is a member by another sign
            pass
        elif kind == "op":
            op = m[0]
            if stop is not None:
                if op in "([{":
                    depth += 1
                elif op in ")]}":
                    if depth == 0:
                        return at
                    depth -= 1
                elif depth == 0 and op == ":":
                    return at
            out.append({"><": "<>", "=<": "<="}.get(op, op))
        elif kind == "number":
            out.append("number")
        elif kind == "string":
            out.append("string")
        elif kind == "date":
            out.append("date#")
        elif kind == "interpolated":
            at = _interpolated(text, end, out)
            line_start = False
            continue
        else:
            if not line_start or stop is not None:
                raise Invalid("directive")
            at = _directive(text, at, m[0], stack, defined)
            continue
        line_start = False
        at = end
    if stop is not None:
        raise Invalid("an interpolation is open")
    if stack:
        raise Invalid("a region or conditional part is open")
    return at


#: What a literal of markup may follow; after anything else the sign compares, or begins attributes.
_BEFORE_MARKUP = frozenset(["=", "(", ",", "{", "return", "in", "&", ":=", "yield", "nl", "then", "else", "if", "select", "+"])
_NAME = r"[^\W\d][\w.\-]*(?::[^\W\d][\w.\-]*)?"
_OPEN_TAG = re.compile(rf"<({_NAME})((?:\s+(?:{_NAME}\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'|<%=.*?%>)|<%=.*?%>))*)\s*(/?)>", re.S)
_CLOSE_TAG = re.compile(rf"</({_NAME})?\s*>")
_AXIS = re.compile(rf"<{_NAME}>")
_NAMESPACE = re.compile(r"<xmlns(?::[\w.\-]+)?\s*=\s*(?:\"[^\"]*\"|'[^']*')\s*>")
_NODES = (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<?", "?>"))


def _markup(text: str, at: int, out: list[str]) -> int:
    """Take in a literal of markup, a step along an axis of it or an imported namespace; the place behind it, or 0 where there is none."""
    last = out[-1] if out else "nl"
    if last == ".":
        step = _AXIS.match(text, at)
        if step is None:
            return 0
        if out[-3:] == [".", ".", "."]:
            del out[-2:]
        out.append("id")
        return step.end()
    if last == "imports" or last == "," and "imports" in out[-12:]:
        name = _NAMESPACE.match(text, at)
        if name:
            out.append("id")
            return name.end()
    if last not in _BEFORE_MARKUP:
        return 0
    end = _element(text, at)
    if end and last != "nl":
        out.append("string")
        return end
    return 0


def _element(text: str, at: int) -> int:
    """The place behind an element, or behind the nodes that begin a document and its element; 0 where it is not closed. Embedded expressions are passed over."""
    open_: list[str] = []
    while True:
        node = next(((a, b) for a, b in _NODES if text.startswith(a, at)), None)
        if node:
            end = text.find(node[1], at + len(node[0]))
            if end < 0:
                return 0
            at = end + len(node[1])
            if not open_:
                if node[0] != "<?":
                    return at
                at += len(text[at:]) - len(text[at:].lstrip())
        elif text.startswith("<%=", at) and open_:
            depth, at = 1, at + 3
            while depth:
                close, more = text.find("%>", at), text.find("<%=", at)
                if close < 0:
                    return 0
                inner = 0 <= more < close
                depth += 1 if inner else -1
                at = more + 3 if inner else close + 2
        elif text.startswith("</", at):
            tag = _CLOSE_TAG.match(text, at)
            if tag is None or not open_ or tag[1] not in (None, open_.pop()):
                return 0
            at = tag.end()
            if not open_:
                return at
        else:
            tag = _OPEN_TAG.match(text, at)
            if tag is None:
                return 0
            at = tag.end()
            if not tag[3]:
                open_.append(tag[1])
            elif not open_:
                return at
        if open_:
            at = text.find("<", at)
            if at < 0:
                return 0


def _interpolated(text: str, at: int, out: list[str]) -> int:
    out.append("open$")
    while True:
        c = text[at : at + 1]
        if not c:
            raise Invalid("a string is open")
        if c in _QUOTES:
            if text[at + 1 : at + 2] and text[at + 1] in _QUOTES:
                at += 2
                continue
            out.append("close$")
            return at + 1
        if c in "{}":
            if text[at + 1 : at + 2] == c:
                at += 2
                continue
            if c == "}":
                raise Invalid("a brace in a string")
            out.append("hole$")
            at = _lex(text, at + 1, out, "}")
            if text[at] == ":":
                at = re.compile(r"[^{}\"]*").match(text, at + 1).end()
                out.append("format$")
            if text[at : at + 1] != "}":
                raise Invalid("an interpolation is open")
        at += 1


_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|\Z)")


def _directive(text: str, at: int, directive: str, stack: list[list], defined: dict[str, bool]) -> int:
    """Take in a directive; the place from which the text counts again, with the directive's line end left."""
    words = directive[1:].split("'")[0].lower().split()
    word = words[0] if words else ""
    second = words[1] if len(words) > 1 else ""
    end = at + len(directive)
    rest = directive[1:].strip()[len(word) :].strip()
    if word == "if":
        taken = _true(rest, defined)
        stack.append(["if", taken, False])
        return end if taken else _skip(text, end, stack, defined)
    if word in ("elseif", "else"):
        if not stack or stack[-1][0] != "if" or stack[-1][2]:
            raise Invalid("directive")
        stack[-1][2] = word == "else"
        return _skip(text, end, stack, defined)
    if word == "end" and second in ("if", "region", "externalsource"):
        wanted = second if second != "externalsource" else "source"
        if not stack or stack[-1][0] != wanted:
            raise Invalid("directive")
        stack.pop()
    elif word == "region":
        stack.append(["region"])
    elif word == "externalsource":
        stack.append(["source"])
    elif word == "const":
        m = re.fullmatch(r"(\w+)\s*=\s*(.+)", rest, re.S)
        if not m:
            raise Invalid("directive")
        defined[m[1].lower()] = _true(m[2], defined)
    elif word not in ("enable", "disable", "externalchecksum", "r"):
        raise Invalid("directive")
    return end


def _skip(text: str, at: int, stack: list[list], defined: dict[str, bool]) -> int:
    depth = 0
    at = _LINE.match(text, at).end()
    while at < len(text):
        m = _LINE.match(text, at)
        line = m[0].strip()
        if line.startswith("#"):
            words = line[1:].lower().split()
            word = words[0] if words else ""
            if word == "if":
                depth += 1
            elif word == "end" and words[1:2] == ["if"]:
                if not depth:
                    stack.pop()
                    return m.end()
                depth -= 1
            elif not depth and word in ("elseif", "else"):
                top = stack[-1]
                if top[2]:
                    raise Invalid("directive")
                top[2] = word == "else"
                if not top[1] and (word == "else" or _true(line[1:].strip()[6:], defined)):
                    top[1] = True
                    return m.end()
        if m.end() == at:
            break
        at = m.end()
    raise Invalid("a conditional part is open")


@lru_cache(maxsize=1)
def grammar() -> Grammar:
    return Grammar(GRAMMAR, {"ID": ID, "ANY": ANY}, ["unit"])


DIALECTS = ("unit",)


def valid(text: str) -> bool:
    """Whether the language accepts the text."""
    try:
        kinds = tokens(text)
    except (Invalid, RecursionError):
        return False
    known = grammar()
    return known.accepts(known.encode(kinds), DIALECTS)
