"""Token patterns and grammars of the languages whose syntax is checked.

Grammars are written in a small notation: `rule = a b | c`, with quoted terminals, token classes in capitals, grouping,
`?`, `*` and `+`. No rule is left-recursive. They accept every valid program in common use and leave to a compiler what
is no matter of syntax; where the next token decides between readings, all are followed.
"""

from __future__ import annotations

import re

_NUM = r"(?:0[xX][0-9a-fA-F_']+|0[bBoO][0-7_']+|(?:\d[\d_']*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)\w*"
_DQ = r'"(?:[^"\\\n]|\\(?:.|\n))*"'
_SQ = r"'(?:[^'\\\n]|\\(?:.|\n))*'"
_CCOMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"

JSON = {
    "skip": r"[ \t\r\n]+",
    "token": [
        ("STR", r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"'),
        ("NUM", r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])"),
        ("NAME", r"[A-Za-z_]\w*"),
        ("OP", r"[\[\]{}:,]"),
    ],
    "words": "true false null",
    "grammar": """
start = value
value = '{' (pair (',' pair)*)? '}' | '[' (value (',' value)*)? ']' | STR | NUM | 'true' | 'false' | 'null'
pair = STR ':' value
""",
}

_JS_BASE = """
start = stmt* open?
block = '{' stmt* open? '}'
stmt = block | ';' | simple ';' | control | funcdecl | classdecl | module | NAME ':' stmt
open = simple | 'if' '(' expr ')' open | 'if' '(' expr ')' stmt 'else' open | ('while' | 'with') '(' expr ')' open | 'for' forhead open | modopen
simple = vardecl | 'return' expr? | 'throw' expr | 'break' NAME? | 'continue' NAME? | 'debugger' | sexpr | 'do' stmt 'while' '(' expr ')'
vardecl = ('var' | 'let' | 'const') declr (',' declr)*
declr = pattern ANN ('=' assign)?
pattern = ident | '[' (pelem? ',')* pelem? ']' | '{' (pprop (',' pprop)* ','?)? '}'
pelem = '...'? pattern ('=' assign)?
pprop = '...' pattern | propname (':' pelem)? ('=' assign)?
control = 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'for' forhead stmt | 'do' stmt 'while' '(' expr ')'
  | 'try' block ('catch' ('(' pattern ANN ')')? block)? ('finally' block)? | 'switch' '(' expr ')' '{' casearm* '}' | 'with' '(' expr ')' stmt
casearm = ('case' expr | 'default') ':' stmt* open?
forhead = 'await'? '(' ((vardecl | expr)? ';' expr? ';' expr? | (('var' | 'let' | 'const') pattern | expr) 'of' assign | ('var' | 'let' | 'const') pattern 'in' expr) ')'
funcdecl = 'async'? 'function' '*'? ident TPAR params RET block | FUNCSIG
params = '(' (param (',' param)* ','?)? ')'
param = deco* PMOD '...'? (pattern | 'this') OPT ANN ('=' assign)?
deco = '@' ident ('.' name)* args?
classdecl = deco* ABSTRACT 'class' ident? TPAR ('extends' unary TARGS)? IMPL classbody
classbody = '{' (member | ';')* memberopen? '}'
member = memberopen ';' | deco* CMOD ('async' | 'get' | 'set' | '*')* propname OPT TPAR params RET block | 'static' block
memberopen = deco* CMOD propname OPT ANN ('=' assign)? | METHODSIG
propname = name | STR | NUM | '[' assign ']' | PRIVATE
module = 'import' (importclause 'from')? STR attrs? ';' | 'export' (vardecl | 'default' assign | '*' ('as' name)? 'from' STR | namedlist ('from' STR)?) ';'
  | 'export' 'default'? (funcdecl | classdecl) | TSDECL
modopen = 'import' (importclause 'from')? STR | 'export' (vardecl | 'default' assign | '*' ('as' name)? 'from' STR | namedlist ('from' STR)?)
attrs = 'with' '{' '}'
importclause = TYPEONLY (ident (',' (namedlist | '*' 'as' ident))? | namedlist | '*' 'as' ident)
namedlist = '{' (nameditem (',' nameditem)* ','?)? '}'
nameditem = TYPEONLY (name | STR) ('as' (name | STR))?
expr = assign (',' assign)*
assign = unary (binop unary)* ASTYPE ('?' assign ':' assign)?
binop = '=' | '+' | '-' | '*' | '/' | '%' | '**' | '<' | '>' ('>' '>'?)? '='? | '<<' | 'OP2' | 'in' | 'instanceof' | '&&' | '||' | '??' | '&' | '|' | '^'
unary = ('!' | '-' | '+' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' | 'new' | 'yield' '*'?)* (primary trailer* ('++' | '--')?) | 'yield'
primary = ident | NUM | STR | TEMPLATE | REGEX | 'this' | 'super' | 'null' | 'true' | 'false' | 'import' | '(' expr ')' | '[' ('...'? assign? ',')* ('...'? assign)? ']'
  | '{' (prop (',' prop)* ','?)? '}' | 'async'? 'function' '*'? ident? TPAR params RET block | classdecl | 'async'? (ident | TPAR params RET) '=>' (block | assign) | PRIVATE
sexpr = sassign (',' assign)*
sassign = sunary (binop unary)* ASTYPE ('?' assign ':' assign)?
sunary = ('!' | '-' | '+' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' | 'new' | 'yield' '*'?)+ (primary trailer* ('++' | '--')?) | 'yield' | sprimary trailer* ('++' | '--')?
sprimary = ident | NUM | STR | TEMPLATE | REGEX | 'this' | 'super' | 'null' | 'true' | 'false' | 'import' | '(' expr ')' | '[' ('...'? assign? ',')* ('...'? assign)? ']' | 'async'? (ident | TPAR params RET) '=>' (block | assign) | PRIVATE
prop = '...' assign | propname (':' assign)? ('=' assign)? | ('async' | 'get' | 'set' | '*')* propname TPAR params RET block
trailer = ('.' | '?.') (name | PRIVATE) | '?.'? '[' expr ']' | TARGS '?.'? args | TEMPLATE | BANG
args = '(' ('...'? assign (',' '...'? assign)* ','?)? ')'
ident = NAME | 'of' | 'get' | 'set' | 'async' | 'as' | 'from' | 'static' | 'type' | 'let' | 'declare' | 'abstract' | 'readonly' | 'namespace' | 'is' | 'keyof' | 'infer' | 'private' | 'public' | 'protected' | 'override' | 'implements' | 'interface'
name = ident | 'KEYWORD'
KEYWORD_RULE
"""
_JS_WORDS = (
    "var let const return throw break continue debugger if else while with for do try catch finally switch case default of in async function class extends "
    "import export from as static get set new typeof void delete await yield instanceof this super null true false"
)
_TS_WORDS = "type declare abstract readonly namespace is keyof infer private public protected override implements interface enum"
_EMPTY = {k: "" for k in ("ANN", "TPAR", "RET", "PMOD", "OPT", "ABSTRACT", "TARGS", "IMPL", "TYPEONLY", "ASTYPE", "BANG", "FUNCSIG", "METHODSIG", "TSDECL")}


def _fill(base: str, parts: dict[str, str]) -> str:
    """Each part becomes a rule of the lower-case name."""
    filled = re.sub(r"\b(?:" + "|".join(parts) + r")\b", lambda m: f"x_{m[0].lower()}", base)
    return filled + "\n" + "\n".join(f"x_{k.lower()} = {v}" for k, v in parts.items())


def _keyword_rule(words: str) -> str:
    return " | ".join(f"'{w}'" for w in words.split())


def _js(words: str, parts: dict[str, str]) -> str:
    base = _JS_BASE.replace("KEYWORD_RULE", "anyword = " + _keyword_rule(words)).replace("'KEYWORD'", "anyword").replace("'OP2'", "OP2")
    known = set(words.split())
    rule = next(x for x in base.split("\n") if x.startswith("ident = "))
    kept = [x for x in rule[8:].split(" | ") if x == "NAME" or x.strip("'") in known]
    return _fill(base.replace(rule, "ident = " + " | ".join(kept)), parts)


_JS_TOKENS = [
    ("STR", _DQ + "|" + _SQ),
    ("NUM", _NUM),
    ("PRIVATE", r"#[A-Za-z_$][\w$]*"),
    ("NAME", r"[^\W\d][\w$]*|\$[\w$]*"),
    ("OP2", r"===|!==|==|!=|<=|\+=|-=|\*\*=|\*=|%=|&&=|\|\|=|\?\?=|<<=|&=|\|=|\^="),
    ("OP", r"\.\.\.|=>|\?\.(?!\d)|\?\?|\*\*|\+\+|--|&&|\|\||<<|[-+*/%=<>!~?:;,.(){}\[\]&|^@]"),
]

JS = {
    "skip": r"[ \t\r\f\v ﻿]+|" + _CCOMMENT,
    "token": _JS_TOKENS,
    "words": _JS_WORDS,
    "style": "js",
    "grammar": _js(_JS_WORDS, {**_EMPTY, "CMOD": "'static'*"}),
}

TS = {
    "skip": JS["skip"],
    "token": _JS_TOKENS,
    "words": _JS_WORDS + " " + _TS_WORDS,
    "style": "js",
    "grammar": _js(
        _JS_WORDS + " " + _TS_WORDS,
        {
            "ANN": "('!'? ':' type)?", "TPAR": "('<' tparam (',' tparam)* ','? '>')?", "RET": "(':' rettype)?", "OPT": "'?'?",
            "PMOD": "('private' | 'public' | 'protected' | 'readonly' | 'override')*", "CMOD": "('static' | 'private' | 'public' | 'protected' | 'readonly' | 'override' | 'abstract' | 'declare')*",
            "ABSTRACT": "'abstract'? 'declare'?", "TARGS": "targs?", "IMPL": "('implements' type (',' type)*)?", "TYPEONLY": "'type'?",
            "ASTYPE": "(('as' | 'OPSAT') type)*", "BANG": "'!'", "FUNCSIG": "'declare'? 'async'? 'function' ident x_tpar params x_ret ';'",
            "METHODSIG": "deco* x_cmod propname x_opt x_tpar params x_ret",
            "TSDECL": "'export'? 'declare'? ('interface' ident x_tpar ('extends' type (',' type)*)? typebody | 'type' ident x_tpar '=' type ';' | 'const'? 'enum' ident '{' (propname ('=' assign)? ','?)* '}' | ('namespace' ident ('.' ident)* | 'declare' ident) block) | 'declare' (vardecl ';' | funcdecl | classdecl) | 'import' 'type' importclause 'from' STR ';'",
        },
    ).replace("'OPSAT'", "'as'")
    + """
type = '|'? utype ('extends' utype '?' type ':' type)?
utype = itype (('|' | '&') itype)*
itype = ('keyof' | 'typeof' | 'readonly' | 'infer')* tprim ('[' type? ']')*
tprim = name ('.' name)* targs? | STR | NUM | '-' NUM | TEMPLATE | typebody | 'new'? x_tpar params '=>' rettype | '(' type ')' | '[' ('...'? (ident '?'? ':')? type '?'? (',' '...'? (ident '?'? ':')? type '?'?)* ','?)? ']'
rettype = type | ident 'is' type
typebody = '{' (tmember (';' | ','))* tmember? ';'? '}'
tmember = 'readonly'? ('get' | 'set')? propname '?'? x_ann | propname? '?'? x_tpar params x_ret | 'readonly'? '[' ident (':' type ']' | 'in' type ']') '?'? ':' type | 'new' params x_ret
targs = '<' type (',' type)* '>'
tparam = 'const'? ident ('extends' type)? ('=' type)?
""",
}

JAVA = {
    "skip": r"[ \t\r\n\f]+|" + _CCOMMENT,
    "token": [
        ("STR", r'"""[\s\S]*?"""|' + _DQ), ("CHR", r"'(?:[^'\\\n]|\\u*[\w\\'\"]+)'"), ("NUM", _NUM), ("NAME", r"[^\W\d][\w$]*|\$[\w$]*"),
        ("OP2", r"==|!=|<=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<="), ("OP", r"\.\.\.|->|::|\+\+|--|&&|\|\||<<|[-+*/%=<>!~?:;,.(){}\[\]&|^@]"),
    ],
    "words": "package import static class interface enum extends implements throws public private protected final abstract synchronized native transient volatile default strictfp "
    "if else for while do return break continue throw try catch finally switch case new this super null true false instanceof void int long double float boolean char byte short assert",
    "grammar": """
start = (annot* 'package' qname ';')? ('import' 'static'? qname ('.' '*')? ';' | ';')* (typedecl | ';')*
qname = NAME ('.' NAME)*
annot = '@' qname ('(' (elem (',' elem)*)? ')')?
elem = expr | annot | arrayinit
mods = (annot | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'synchronized' | 'native' | 'transient' | 'volatile' | 'default' | 'strictfp' | NAME)*
typedecl = mods ('class' NAME tparams? ('extends' type)? ('implements' types)? (NAME types)? body | 'interface' NAME tparams? ('extends' types)? (NAME types)? body
  | '@' 'interface' NAME body | 'enum' NAME ('implements' types)? '{' (annot* NAME args? body? (',' annot* NAME args? body?)*)? ','? (';' (member | ';')*)? '}' | NAME NAME tparams? params ('implements' types)? body)
body = '{' (member | ';')* '}'
member = mods (tparams? (type | 'void') NAME params ('[' ']')* throwing? (block | ('default' elem)? ';') | tparams? NAME params throwing? block | NAME block | type vars ';' | block) | typedecl
throwing = 'throws' types
tparams = '<' annot* NAME ('extends' type ('&' type)*)? (',' annot* NAME ('extends' type ('&' type)*)?)* '>'
types = type (',' type)*
type = annot* (prim | NAME targs? ('.' annot* NAME targs?)*) (annot* '[' ']')*
prim = 'int' | 'long' | 'double' | 'float' | 'boolean' | 'char' | 'byte' | 'short'
targs = '<' (targ (',' targ)*)? '>'
targ = type | annot* '?' (('extends' | 'super') type)?
params = '(' (param (',' param)*)? ')'
param = (annot | 'final')* type '...'? (NAME | 'this') ('[' ']')*
vars = var (',' var)*
var = NAME ('[' ']')* ('=' (expr | arrayinit))?
arrayinit = '{' ((expr | arrayinit) (',' (expr | arrayinit))* ','?)? '}'
block = '{' stmt* '}'
stmt = block | ';' | (annot | 'final')* type vars ';' | expr ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' ((annot | 'final')* type vars | expr (',' expr)*)? ';' expr? ';' (expr (',' expr)*)? ')' stmt | 'for' '(' (annot | 'final')* type NAME ':' expr ')' stmt
  | 'return' expr? ';' | 'break' NAME? ';' | 'continue' NAME? ';' | 'throw' expr ';' | 'assert' expr (':' expr)? ';' | NAME ':' stmt | 'synchronized' '(' expr ')' block
  | 'try' ('(' resource (';' resource)* ';'? ')')? block ('catch' '(' (annot | 'final')* type ('|' type)* NAME ')' block)* ('finally' block)? | switch | (annot | 'final' | 'abstract' | 'static')* typedecl | NAME expr ';'
resource = 'final'? type NAME '=' expr | expr
switch = 'switch' '(' expr ')' '{' (('case' label (',' label)* | 'default') (':' stmt* | '->' (expr ';' | block | 'throw' expr ';')))* '}'
label = expr | type NAME (NAME expr)? | 'default'
expr = unary (binop unary | 'instanceof' 'final'? type NAME? )* ('?' expr ':' expr)?
binop = '=' | OP2 | '+' | '-' | '*' | '/' | '%' | '<' | '>' ('>' '>'?)? '='? | '<<' | '&&' | '||' | '&' | '|' | '^'
unary = ('!' | '-' | '+' | '~' | '++' | '--')* (cast | primary trailer* ('++' | '--')?)
cast = '(' type ('&' type)* ')' unary
primary = NAME | NUM | STR | CHR | 'this' | 'super' | 'null' | 'true' | 'false' | '(' expr ')' | 'new' annot* (prim | NAME targs? ('.' NAME targs?)*) (args body? | ('[' expr? ']')+ arrayinit?) | lambda | switch
  | (prim | 'void') ('[' ']')* ('.' 'class' | '::' 'new') | NAME ('.' NAME)* targs? ('[' ']')* ('::' ('new' | NAME) | '.' 'class')
lambda = (NAME | '(' (NAME (',' NAME)*)? ')' | params) '->' (expr | block)
trailer = '.' targs? (NAME | 'this' | 'class' | 'super') | '.' 'new' NAME targs? args body? | '[' expr ']' | args | '::' targs? (NAME | 'new')
args = '(' (expr (',' expr)*)? ')'
""",
}

_C_PP = r"(?<![^\n])[ \t]*#[ \t]*(?:include|define|if|ifdef|ifndef|else|elif|endif|undef|pragma|error|line|warning)\b(?:[^\n\\]|\\[\s\S])*"
_C_TOKENS = [
    ("RAW", r'(?:u8|[uUL])?R"([^()\\\s]{0,16})\([\s\S]*?\)\1"'), ("STR", r"(?:u8|[uUL])?" + _DQ), ("CHR", r"[uUL]?'(?:[^'\\\n]|\\[^\n][0-9a-fA-F]*)+'"), ("NUM", _NUM), ("NAME", r"[^\W\d]\w*"),
    ("OP2", r"==|!=|<=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<="), ("OP", r"\.\.\.|->\*?|::|\+\+|--|&&|\|\||<<|[-+*/%=<>!~?:;,.(){}\[\]&|^]"),
]
_C_STMT = """
block = '{' stmt* '}'
stmt = block | ';' | decl | expr ';' | 'if' IFX '(' cond ')' stmt ('else' stmt)? | 'while' '(' cond ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' (decl | expr? ';') expr? ';' expr? ')' stmt | 'switch' '(' cond ')' stmt | 'case' tern ('...' tern)? ':' | 'default' ':' | 'return' (expr | braced)? ';' | 'break' ';' | 'continue' ';' | 'goto' NAME ';' | NAME ':' stmt | MORE
expr = tern (',' tern)*
tern = unary (binop unary)* ('?' expr? ':' tern)?
binop = '=' | OP2 | '+' | '-' | '*' | '/' | '%' | '<' | '>' '>'? '='? | '<<' | '&&' | '||' | '&' | '|' | '^'
args = '(' ((tern | braced) PACK (',' (tern | braced) PACK)*)? ')'
braced = '{' (initem (',' initem)* ','?)? '}'
initem = (('.' NAME | '[' expr ']')+ '='?)? (tern | braced)
"""
C = {
    "skip": r"[ \t\r\n\f\v]+|" + _CCOMMENT + "|" + _C_PP + r"|\\\n",
    "token": _C_TOKENS,
    "words": "if else while do for switch case default return break continue goto sizeof struct union enum typedef const static extern inline volatile register restrict unsigned signed int long short char float double void _Bool _Alignas _Static_assert",
    "grammar": _fill(
        """
start = (ext | ';')*
ext = decl | spec declarator decl* block | '_Static_assert' args ';'
decl = spec (initdecl (',' initdecl)*)? ';'
initdecl = declarator (':' tern)? ('=' (tern | braced))?
spec = qual* (basic (basic | qual)* | NAME qual* | record qual*)
qual = 'const' | 'static' | 'extern' | 'inline' | 'volatile' | 'register' | 'restrict' | 'typedef'
basic = 'unsigned' | 'signed' | 'int' | 'long' | 'short' | 'char' | 'float' | 'double' | 'void' | '_Bool'
record = ('struct' | 'union') (NAME fields? | fields) | 'enum' (NAME enums? | enums)
fields = '{' (spec (field (',' field)*)? ';')* '}'
field = declarator? (':' tern)?
enums = '{' (NAME ('=' tern)? (',' NAME ('=' tern)?)* ','?)? '}'
declarator = ('*' qual*)* (NAME | '(' declarator ')') suffix*
suffix = '[' ('static' | 'const')* tern? ']' | '(' (param (',' param)* (',' '...')? | NAME (',' NAME)*)? ')'
param = spec (declarator | abstract)
abstract = ('*' qual*)* ('(' abstract ')')? suffix*
cond = expr
unary = ('!' | '-' | '+' | '~' | '++' | '--' | '*' | '&' | '&&' | 'sizeof')* (primary trailer* ('++' | '--')? | cast)
cast = '(' spec abstract ')' (unary | braced)
primary = NAME | NUM | STR+ | CHR | '(' expr ')' | '(' block ')' | 'sizeof' '(' spec abstract ')'
trailer = '.' NAME | '->' NAME | '[' expr ']' | args
"""
        + _C_STMT,
        {"IFX": "", "MORE": "'_Static_assert' args ';'", "PACK": ""},
    ),
}
CPP = {
    "skip": C["skip"] + r"|\[\[[^\]\n]*\]\]",
    "token": _C_TOKENS,
    "words": C["words"].replace("_Bool _Alignas _Static_assert restrict", "")
    + " class public private protected virtual override final explicit friend template typename using namespace new delete this nullptr true false operator auto bool constexpr consteval "
    "static_cast dynamic_cast const_cast reinterpret_cast try catch throw noexcept mutable decltype static_assert thread_local concept requires wchar_t",
    "grammar": _fill(
        """
start = (ext | ';')*
ext = decl | func | 'template' '<' tpars '>' req? ext | 'namespace' ('inline'? NAME ('::' NAME)*)? '{' (ext | ';')* '}' | 'inline' 'namespace' NAME '{' (ext | ';')* '}' | 'using' 'namespace' qual_name ';' | 'using' ('typename'? qual_name | NAME '=' typeid) ';'
  | 'extern' STR ('{' (ext | ';')* '}' | ext) | 'namespace' NAME '=' qual_name ';' | 'static_assert' args ';' | 'template' ext | 'concept' NAME '=' tern ';'
req = 'requires' tern
tpars = (tpar (',' tpar)*)?
tpar = ('typename' | 'class') '...'? NAME? ('=' typeid)? | spec declarator? ('=' tern)? | 'template' '<' tpars '>' 'class' NAME?
func = (spec | qual*) fdeclarator ftail (ctorinit? block | 'try' ctorinit? block handler+)
fdeclarator = ptr* fname '(' parlist ')'
fname = qual_name | qual_name '::' '~' NAME | '~' NAME | (qual_name '::')? opname
opname = 'operator' ('+' | '-' | '*' | '/' | '%' | '=' | OP2 | '<' | '>' ('>' '='?)? | '<<' | '!' | '~' | '++' | '--' | '&&' | '||' | '&' | '|' | '^' | ',' | '->' | '(' ')' | '[' ']' | 'new' | 'delete' | '>' '=' | STR NAME | spec ptr*)
ftail = ('const' | 'volatile' | '&' | '&&' | 'noexcept' ('(' tern ')')? | 'override' | 'final' | 'throw' '(' ')')* ('->' typeid)? req?
ctorinit = ':' minit (',' minit)*
minit = qual_name (args | braced) '...'?
decl = spec (initdecl (',' initdecl)*)? ';' | 'friend' (decl | func | 'class' NAME ';') | 'typedef' spec declarator ';' | qual* fdeclarator ftail ('=' (NUM | 'default' | 'delete'))? ';' | spec fdeclarator ftail '=' (NUM | 'default' | 'delete') ';' | spec ('&' | '&&')? '[' NAME (',' NAME)* ']' '=' tern ';'
initdecl = declarator ftail (':' tern)? ('=' (tern | braced) | braced | args)?
spec = qual* (basic (basic | qual)* | 'typename'? '::'? qual_name qual* | record qual* | 'auto' qual* | 'decltype' args qual*)
qual = 'const' | 'static' | 'extern' | 'inline' | 'volatile' | 'register' | 'typedef' | 'virtual' | 'explicit' | 'constexpr' | 'consteval' | 'mutable' | 'friend' | 'thread_local'
basic = 'unsigned' | 'signed' | 'int' | 'long' | 'short' | 'char' | 'float' | 'double' | 'void' | 'bool' | 'wchar_t'
qual_name = NAME targs? ('::' 'template'? NAME targs?)*
targs = '<' ((typeid | targexpr) '...'? (',' (typeid | targexpr) '...'?)*)? '>'
targexpr = tunary (('+' | '-' | '*' | '/' | '%' | OP2 | '&&' | '||' | '&' | '|') tunary)*
tunary = ('!' | '-' | '~' | '&' | 'sizeof')* primary trailer*
typeid = spec abstract
record = ('class' | 'struct' | 'union') ('final'? qual_name 'final'? (bases? body)? | body) | 'enum' ('class' | 'struct')? NAME? (':' spec)? ('{' (NAME ('=' tern)? (',' NAME ('=' tern)?)* ','?)? '}')?
bases = ':' base (',' base)*
base = ('public' | 'private' | 'protected' | 'virtual')* qual_name '...'?
body = '{' (('public' | 'private' | 'protected') ':' | ext | ';')* '}'
ptr = ('*' | '&' | '&&' | qual_name '::' '*') ('const' | 'volatile')*
declarator = ptr* ('...'? qual_name | '(' declarator ')') suffix*
suffix = '[' tern? ']' | '(' parlist ')' ftail
parlist = (param (',' param)* (',' '...')? | '...')?
param = spec (declarator | abstract) ('=' (tern | braced))?
abstract = ptr* '...'? ('(' abstract ')')? suffix*
handler = 'catch' '(' (param | '...') ')' block
cond = (decl | expr ';')? (expr | spec declarator ('=' tern | braced))
unary = ('!' | '-' | '+' | '~' | '++' | '--' | '*' | '&' | '&&' | 'sizeof' | 'throw' | 'delete' ('[' ']')?)* (primary trailer* ('++' | '--')? | cast | new) | 'throw'
cast = '(' typeid ')' (unary | braced)
new = '::'? 'new' args? (spec ptr* ('[' tern ']')* | '(' typeid ')') (args | braced)?
primary = '::'? qual_name ('::' (opname | '~' NAME))? | NUM | STR+ | CHR | 'this' | 'nullptr' | 'true' | 'false' | '(' expr ('...' | binop '...')? ')' | 'sizeof' '...'? '(' typeid ')' | ('static_cast' | 'dynamic_cast' | 'const_cast' | 'reinterpret_cast') '<' typeid '>' '(' expr ')'
  | (basic | 'typename'? qual_name | 'auto') (args | braced) | '[' (capture (',' capture)*)? ']' ('<' tpars '>')? ('(' parlist ')')? ('mutable' | 'constexpr' | 'noexcept')* ('->' typeid)? block | 'decltype' args | 'noexcept' args
capture = '=' | '&'? ('this' | NAME ('=' tern)? '...'?) | '&' | '*' 'this'
trailer = ('.' | '->') ('template'? qual_name | '~' NAME | opname) | '[' (expr | braced) ']' | args | braced
"""
        + _C_STMT,
        {
            "IFX": "'constexpr'?", "PACK": "'...'?",
            "MORE": "'for' '(' (decl | expr ';')? spec (declarator | ptr* '[' NAME (',' NAME)* ']') ':' (expr | braced) ')' stmt | 'try' block handler+ | 'throw' expr? ';' | 'using' 'namespace'? qual_name ('=' typeid)? ';' | 'static_assert' args ';'",
        },
    ),
}

GO = {
    "skip": r"[ \t\r]+|//[^\n]*|/\*[^\n]*?\*/",
    "token": [
        ("STR", r"`[^`]*`|" + _DQ), ("CHR", r"'(?:[^'\\\n]|\\[^\n][0-9a-fA-F]*)'"), ("NUM", _NUM), ("NAME", r"[^\W\d]\w*"),
        ("OP2", r"==|!=|<=|>="), ("AOP", r"\+=|-=|\*=|/=|%=|&\^=|&=|\|=|\^=|<<=|>>="), ("OP", r"\.\.\.|:=|<-|\+\+|--|&&|\|\||<<|>>|&\^|[-+*/%=<>!~:;,.(){}\[\]&|^]"),
    ],
    "words": "package import func type struct interface map chan var const if else for range switch case default select go defer return break continue goto fallthrough",
    "style": "go",
    "grammar": """
start = (';'* 'package' NAME ';' (importdecl ';' | ';')* ((topdecl ';') | ';')*)?
importdecl = 'import' (importspec | '(' (importspec ';')* importspec? ')')
importspec = (NAME | '.')? STR
topdecl = decl | 'func' recv? NAME tparams? sig block?
recv = '(' param ')'
decl = 'var' (varspec | '(' (varspec ';')* varspec? ')') | 'const' (constspec | '(' (constspec ';')* constspec? ')') | 'type' (typespec | '(' (typespec ';')* typespec? ')')
varspec = names (type ('=' exprs)? | '=' exprs)
constspec = names (type? '=' exprs)?
typespec = NAME tparams? '='? type
tparams = '[' NAME (',' NAME)* constraint (',' NAME (',' NAME)* constraint)* ','? ']'
constraint = '~'? type ('|' '~'? type)*
names = NAME (',' NAME)*
sig = params (type | params)?
params = '(' (param (',' param)* ','?)? ')'
param = NAME '...'? type | '...'? type
type = NAME ('.' NAME)? ('[' type (',' type)* ']')? | '*' type | '[' ']' type | '[' (expr | '...') ']' type | 'map' '[' type ']' type | 'chan' '<-'? type | '<-' 'chan' type | 'func' sig | 'struct' '{' (field ';')* field? '}'
  | 'interface' '{' (imember ';')* imember? '}' | '(' type ')'
field = names type STR? | '*'? NAME ('.' NAME)? STR?
imember = NAME sig | constraint
block = '{' (stmt ';' | ';')* stmt? '}'
stmt = decl | simple | NAME ':' stmt? | 'go' expr | 'defer' expr | 'return' exprs? | 'break' NAME? | 'continue' NAME? | 'goto' NAME | 'fallthrough' | block | ifs
  | 'for' (expr | (simple? ';' expr? ';' simple?) | (exprs ('=' | ':='))? 'range' expr)? block
  | 'switch' (simple? ';')? (simple)? '{' (('case' (expr | type) (',' (expr | type))* | 'default') ':' (stmt ';' | ';')* stmt?)* '}' | 'select' '{' (('case' simple | 'default') ':' (stmt ';' | ';')* stmt?)* '}'
ifs = 'if' (simple ';')? expr block ('else' (ifs | block))?
simple = exprs (('=' | ':=' | AOP) exprs | '++' | '--' | '<-' expr)?
exprs = expr (',' expr)*
expr = unary (binop unary)*
binop = '+' | '-' | '*' | '/' | '%' | OP2 | '<' | '>' | '<<' | '>>' | '&&' | '||' | '&' | '|' | '^' | '&^'
unary = ('!' | '-' | '+' | '^' | '*' | '&' | '<-')* primary trailer*
primary = NAME | NUM | STR | CHR | '(' expr ')' | 'func' sig block | littype lit | '[' ']' type | 'map' '[' type ']' type | 'chan' type | 'struct' '{' '}' | 'interface' '{' '}' | '(' '*' type ')'
littype = '[' ']' type | '[' (expr | '...') ']' type | 'map' '[' type ']' type | 'struct' '{' (field ';')* field? '}'
lit = '{' (litelem (',' litelem)* ','?)? '}'
litelem = (expr | lit) (':' (expr | lit))?
trailer = '.' NAME | '.' '(' (type | 'type') ')' | '[' expr (',' expr)* ']' | '[' expr? ':' expr? (':' expr)? ']' | '(' ((expr | type) '...'? (',' (expr | type) '...'?)* ','?)? ')' | lit
""",
}

RUST = {
    "skip": r"[ \t\r\n\f]+|//[^\n]*|/\*[\s\S]*?\*/|(?<![\s\S])#![^\[\n][^\n]*",
    "token": [
        ("RAW", r'b?r(#+)"[\s\S]*?"\1'), ("STR", r'b?r"[^"]*"|[bc]?"(?:[^"\\]|\\[\s\S])*"'), ("CHR", r"b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.))'"), ("LIFE", r"'[^\W\d]\w*"),
        ("NUM", r"0[xX][0-9a-fA-F_]+\w*|0[bo][0-7_]+\w*|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?\d+)?(?:_?[iuf]\w+)?"), ("NAME", r"(?:r#)?[^\W\d]\w*"),
        ("OP2", r"==|!=|<=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<="), ("OP", r"\.\.=|\.\.\.|\.\.|->|=>|::|&&|\|\||<<|[-+*/%=<>!?:;,.(){}\[\]&|^@#$~]"),
    ],
    "words": "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn",
    "grammar": """
start = ('#' '!' tree)* item*
item = attr* vis? itemkind | attr* macro (';')? | ';'
attr = '#' tree
vis = 'pub' ('(' ('in'? path) ')')?
itemkind = 'use' usetree ';' | 'extern' 'crate' NAME ('as' NAME)? ';' | 'mod' NAME (';' | '{' item* '}') | fnhead (block | ';') | 'struct' NAME gen? where? (';' | '{' (sfield (',' sfield)* ','?)? '}') | 'struct' NAME gen? '(' (attr* vis? type (',' attr* vis? type)* ','?)? ')' where? ';'
  | 'enum' NAME gen? where? '{' (variant (',' variant)* ','?)? '}' | 'unsafe'? 'impl' gen? '!'? type ('for' type)? where? '{' item* '}' | 'unsafe'? 'trait' NAME gen? (':' bounds?)? where? '{' item* '}' | ('const' | 'static' 'mut'?) NAME ':' type ('=' expr)? ';'
  | 'type' NAME gen? (':' bounds)? where? ('=' type)? where? ';' | 'unsafe'? 'extern' STR? '{' item* '}'
fnhead = ('const' | 'async' | 'unsafe' | 'extern' STR?)* 'fn' NAME gen? '(' (fparam (',' fparam)* ','?)? ')' ('->' type)? where?
fparam = attr* ('&'? LIFE? 'mut'? 'self' (':' type)? | pattern ':' type | '...')
sfield = attr* vis? NAME ':' type
variant = attr* vis? NAME ('{' (sfield (',' sfield)* ','?)? '}' | '(' (attr* vis? type (',' attr* vis? type)* ','?)? ')')? ('=' expr)?
usetree = '::'? (useseg ('::' useseg)*)? ('as' NAME)?
useseg = pathname | '*' | '{' (usetree (',' usetree)* ','?)? '}'
gen = '<' (gparam (',' gparam)* ','?)? '>'
gparam = attr* (LIFE (':' LIFE ('+' LIFE)*)? | NAME (':' bounds?)? ('=' type)? | 'const' NAME ':' type ('=' expr)?)
where = 'where' (wpred (',' wpred)* ','?)?
wpred = (LIFE | forlife? type) ':' bounds?
forlife = 'for' gen
bounds = bound ('+' bound)*
bound = LIFE | '?'? forlife? path | '(' bound ')'
pathname = NAME | 'self' | 'Self' | 'super' | 'crate'
path = '::'? tseg ('::' tseg)*
tseg = pathname ('::'? gargs | '(' (type (',' type)*)? ')' ('->' type)?)? | qself
qself = '<' type ('as' path)? '>'
gargs = '<' (garg (',' garg)* ','?)? '>'
garg = LIFE | type | NUM | '-' NUM | block | NAME gargs? '=' type | NAME ':' bounds | STR | 'true' | 'false'
type = '&' LIFE? 'mut'? type | '&&' LIFE? 'mut'? type | '*' ('const' | 'mut') type | '[' type (';' expr)? ']' | '(' (type (',' type)* ','?)? ')' | ('dyn' | 'impl')? forlife? bounds | forlife? ('unsafe' | 'extern' STR?)* 'fn' '(' ((NAME ':')? type (',' (NAME ':')? type)* ','?)? ')' ('->' type)? | '!' | macro
pattern = '|'? patt ('|' patt)*
patt = ('ref' | 'mut')* NAME ('@' patt)? | lit (('..=' | '..' | '...') lit?)? | ('..=') lit | '..' | ('&' | '&&') 'mut'? patt | '(' (pattern (',' pattern)* ','?)? ')' | '[' (pattern (',' pattern)* ','?)? ']' | epath ('(' (pattern (',' pattern)* ','?)? ')' | '{' (fpat (',' fpat)* ','?)? '}' | ('..=' | '..') (lit | epath)?)? | macro
fpat = attr* ('..' | ('ref' | 'mut')* NAME | (NAME | NUM) ':' pattern)
lit = '-'? NUM | STR | CHR | 'true' | 'false'
epath = '::'? eseg ('::' eseg)*
eseg = pathname | gargs | qself
block = LIFE? ':'? '{' inner* stmt* expr? '}'
inner = '#' '!' tree
stmt = ';' | item | attr* 'let' pattern (':' type)? ('=' expr ('else' block)?)? ';' | attr* expr ';' | attr* blocklike
blocklike = block | ('unsafe' | 'async' 'move'? | 'const') block | (LIFE ':')? ('loop' block | 'while' cond block | 'for' pattern 'in' cond block) | ifs | match | macrobrace
ifs = 'if' cond block ('else' (ifs | block))?
cond = expr
match = 'match' cond '{' inner* (arm (',' arm | blockarm)* ','?)? '}' | 'match' cond '{' (blockarm ','? | arm ',')* arm? '}'
arm = attr* pattern ('if' cond)? '=>' expr
blockarm = attr* pattern ('if' cond)? '=>' blocklike
expr = ('..' | '..=') unary? | unary (binop unary | 'as' type)* | unary (binop unary | 'as' type)* ('..' | '..=') (unary (binop unary)*)? | 'let' pattern '=' expr
binop = '=' | OP2 | '+' | '-' | '*' | '/' | '%' | '<' | '>' '>'? '='? | '<<' | '&&' | '||' | '&' | '|' | '^'
unary = ('-' | '!' | '*' | ('&' | '&&') ('mut' | 'raw' )?)* primary trailer*
primary = lit | epath | epath '{' ((attr* (NAME | NUM) (':' expr)?) (',' attr* (NAME | NUM) (':' expr)?)*)? ','? ('..' expr?)? '}' | '(' (expr (',' expr)* ','?)? ')' | '[' (expr (',' expr)* ','? | expr ';' expr)? ']' | blocklike | macro
  | ('async' | 'move' | 'static')* ('||' | '|' (cparam (',' cparam)* ','?)? '|') ('->' type)? expr | 'return' expr? | 'break' LIFE? expr? | 'continue' LIFE?
cparam = patt (':' type)?
trailer = '.' (NAME ('::' gargs)? | NUM | 'await') | '(' (expr (',' expr)* ','?)? ')' | '[' expr ']' | '?'
macro = '::'? NAME ('::' NAME)* '!' NAME? tree
macrobrace = '::'? NAME ('::' NAME)* '!' NAME? bracetree
tree = '(' leaf* ')' | '[' leaf* ']' | bracetree
bracetree = '{' leaf* '}'
leaf = tree | ANY
""",
}

PYTHON = {
    "skip": r"[ \t\f]+|#[^\n]*|\\\r?\n",
    "token": [
        ("STR", r"(?i:[rbuft]{0,3})(?:'''(?:[^\\]|\\[\s\S])*?'''|\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|" + _DQ + "|" + _SQ + ")"),
        ("NUM", r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?)(?![\w.])"), ("NAME", r"[^\W\d]\w*"),
        ("OP2", r"==|!=|<=|>=|//(?!=)|<<(?!=)|>>(?!=)"), ("AOP", r"\+=|-=|\*\*=|\*=|//=|/=|%=|@=|&=|\|=|\^=|<<=|>>="), ("OP", r"\.\.\.|->|:=|\*\*|[-+*/%=<>~:;,.(){}\[\]&|^@]"),
    ],
    "words": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "style": "python",
    "grammar": """
start = (stmt | NL)*
stmt = small (';' small)* ';'? NL | compound
small = exprs (':' test ('=' exprs)? | AOP exprs | ('=' exprs)+)? | 'del' exprs | 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' (test ('from' test)?)? | 'global' NAME (',' NAME)* | 'nonlocal' NAME (',' NAME)* | 'assert' test (',' test)?
  | 'import' dotted ('as' NAME)? (',' dotted ('as' NAME)?)* | 'from' (('.' | '...')* dotted | ('.' | '...')+) 'import' ('*' | '(' imports ','? ')' | imports) | NAME NAME tparams? '=' test
imports = NAME ('as' NAME)? (',' NAME ('as' NAME)?)*
dotted = NAME ('.' NAME)*
suite = ':' (small (';' small)* ';'? NL | NL+ INDENT (stmt | NL)+ DEDENT)
compound = 'if' test suite ('elif' test suite)* ('else' suite)? | 'while' test suite ('else' suite)? | 'async'? 'for' exprs 'in' exprs suite ('else' suite)?
  | 'try' suite (('except' '*'? (test (',' test)* ('as' NAME)?)? suite)+ ('else' suite)? ('finally' suite)? | 'finally' suite) | 'async'? 'with' (witem (',' witem)* | '(' witem (',' witem)* ','? ')') suite
  | ('@' test NL+)* ('async'? 'def' NAME tparams? '(' params? ')' ('->' exprs)? suite | 'class' NAME tparams? args? suite) | NAME exprs ':' NL+ INDENT (NAME pats ('if' test)? suite NL*)+ DEDENT
pats = exprs ('as' NAME)?
tparams = '[' exprs ']'
witem = test ('as' test)?
params = param (',' param)* ','?
param = ('*' | '**')? NAME (':' test | ':' '*' test)? ('=' test)? | '*' | '/'
lparams = lparam (',' lparam)* ','?
lparam = ('*' | '**')? NAME ('=' test)? | '*' | '/'
exprs = star (',' star)* ','?
star = '*'? test
test = ortest ('if' ortest 'else' test)? (':=' test)? | 'lambda' lparams? ':' test | 'yield' ('from' test | exprs)?
ortest = nottest (('and' | 'or') nottest)*
nottest = 'not'* arith (cmp 'not'* arith)*
cmp = '<' | '>' | OP2 | 'in' | 'not' 'in' | 'is' 'not'? | '+' | '-' | '*' | '/' | '%' | '@' | '&' | '|' | '^' | '**'
arith = ('-' | '+' | '~' | 'await')* atom trailer*
atom = NAME | NUM | STR+ | 'None' | 'True' | 'False' | '...' | '(' (star comp | exprs)? ')' | '[' (star comp | exprs)? ']' | '{' (item comp | star comp | item (',' item)* ','? | exprs)? '}'
item = test ':' test | '**' test
comp = ('async'? 'for' exprs 'in' ortest ('if' (ortest | 'lambda' lparams? ':' test))*)+
trailer = '.' NAME | args | '[' sub (',' sub)* ','? ']'
sub = star | test? ':' test? (':' test?)?
args = '(' (arg (',' arg)* ','?)? ')'
arg = ('*' | '**') test | NAME '=' test | test comp?
""",
}

LANGUAGES = {"py": PYTHON, "js": JS, "ts": TS, "rs": RUST, "go": GO, "java": JAVA, "c": C, "cpp": CPP, "json": JSON}
