"""Source files that do not parse.

A file is lexed; brackets are matched and every bracketed group is folded into one
token, so that a statement or group becomes a short token sequence. Each sequence is parsed
by chart; where that fails, the cheapest repair of the whole sequence is found, whatever its
length and cost. A file whose repairs cost anything is flagged, and where the edits lie tells
truncation, merge conflict and wrong language apart.
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.chart import Grammar
from pagemill.session import spread
from pagemill.tables import whole_files

PYTHON = Grammar(
    """
    line -> simples | compound | decorator
    simples -> simple | simple ; | simple ; simples
    simple -> stars | assign | annotated | augmented | del targets | pass | break | continue | return | return stars | raise | raise expr | raise expr from expr
    simple -> global names | nonlocal names | import modules | from origin import * | from origin import aliases | from origin import ( | assert expr | assert expr , expr | yields | type n = expr | type a = expr
    names -> n | n , names
    modules -> module | module , modules
    module -> dotted | dotted as n
    dotted -> n | a
    origin -> dots | dotted | dots dotted
    dots -> . | ... | . dots | ... dots
    aliases -> n | n as n | n , aliases | n as n , aliases
    assign -> targets = right
    right -> stars | yields | assign
    targets -> target | target , | target , targets
    target -> one | ( | [ | * target
    one -> n | a
    annotated -> one : expr | ( : expr | one : expr = right | ( : expr = right
    augmented -> one aug stars | one aug yields
    yields -> yield | yield stars | yield from expr
    compound -> head | head simples
    head -> if named : | elif named : | else : | while named : | for targets in stars : | try : | except : | except caught : | except * caught : | finally : | with items : | async with items : | async for targets in stars :
    head -> define : | async define : | class n : | class n ( : | class n [ : | class n [ ( : | match stars : | case patterns : | case patterns if named :
    define -> def n ( | def n [ ( | def n ( -> expr | def n [ ( -> expr
    caught -> expr | expr as n | expr , exprs
    exprs -> expr | expr , exprs
    items -> item | item , | item , items
    item -> expr | expr as target
    patterns -> pattern | pattern , | pattern , patterns
    pattern -> either | either as n | * n
    either -> literal | literal op either
    literal -> operand | - operand | operand - operand | operand + operand | - operand - operand | - operand + operand
    decorator -> @ named
    named -> expr | n := expr
    expr -> disj | disj if disj else expr | lambda : expr | lambda params : expr
    disj -> unit | unit bin disj
    bin -> op | - | + | * | ** | @ | / | in | not in | is | is not | and | or
    unit -> operand | pre unit
    pre -> - | + | ~ | not | await
    operand -> n | a | k | c | ( | [ | { | ...
    star -> named | * disj
    stars -> star | star , | star , stars
    params -> param | param , | param , params
    param -> n | n = expr | * | * n | ** n | /
    typed -> tparam | tparam , | tparam , typed
    tparam -> n | n = expr | n : annot | n : annot = expr | * | * n | * n : annot | * n : * disj | ** n | ** n : annot | /
    annot -> expr
    comp -> for targets in disj | for targets in disj comp | for targets in disj conds | async for targets in disj | async for targets in disj comp | async for targets in disj conds
    conds -> if cond | if cond conds | if cond comp
    cond -> disj | n := disj | lambda : disj
    paren -> stars | yields | named comp
    list -> stars | named comp
    brace -> stars | named comp | pairs | pair comp
    pairs -> pair | pair , | pair , pairs
    pair -> expr : expr | ** disj
    args -> arg | arg , | arg , args | named comp
    arg -> named | n = expr | * expr | ** expr
    slices -> slice | slice , | slice , slices
    slice -> named | * disj | : | expr : | : expr | expr : expr | : : | expr : : | : expr : | expr : expr : | : : expr | expr : : expr | : expr : expr | expr : expr : expr
    imported -> aliases | aliases ,
    casep -> patterns | keyed | keyed , | patterns , keyed
    keyed -> n = pattern | n = pattern , keyed
    typevars -> tv | tv , | tv , typevars
    tv -> n | n : expr | n = expr | n : expr = expr | * n | ** n | * n = expr | ** n = expr
    """
)

C = Grammar(
    """
    id -> n | N
    outer -> specs declarator tail ; | specs declarator tail {
    tail -> N | N ( | attribute ( | tail N | tail N ( | tail attribute (
    outer -> ; | specs ; | specs inits ; | specs declarator { | id ( ; | id ( | id ( { | inits ; | asm ( ; | asm q ( ; | asm q q ( ; | assert ( ; | specs declarator attr {
    specs -> core | mods | mods core | n core | n mods core | mods n core | mods n mods core
    mods -> mod | mod mods
    mod -> q | N | N ( | attr
    core -> types | n | n mods | rec | rec mods | typeof ( | typeof ( mods
    types -> t | t types | t mods | t mods types
    rec -> record id | record { | record id { | record attr id { | record attr { | record attr id
    attr -> attribute ( | attr attribute (
    inits -> init | init , inits
    init -> declarator | declarator = value | declarator attr | declarator attr = value | declarator : expr | : expr
    value -> assign | {
    declarator -> direct | * declarator | q declarator | N declarator | attr declarator
    direct -> id | ( | direct [ | direct (
    statement -> expr ; | ; | specs ; | specs inits ; | return ; | return expr ; | return { ; | break ; | continue ; | goto id ; | goto * expr ; | asm ( ; | asm q ( ; | asm q q ( ; | asm goto ( ; | asm q goto ( ; | assert ( ;
    label -> id : | case cond : | case cond ... cond : | default :
    members -> specs ; | specs inits ; | ; | assert ( ; | id ( ;
    expr -> assign | assign , expr
    assign -> cond | cond = assign | cond aug assign | cond = {
    cond -> bin | bin ? expr : cond | bin ? : cond
    bin -> unit | unit op bin | unit * bin | unit & bin | unit - bin
    unit -> post | * unit | & unit | - unit | ! unit | ++ unit | sizeof unit | ( unit | && id
    post -> atom | post [ | post ( | post ++ | post . id | ( {
    atom -> id | 0 | strings | ( | [ | t (
    strings -> s | s strings | s id | s id strings | id strings
    list -> item | item , list
    item -> assign | param | abstract | { | cond : cond | specs : assign | specs abstract : assign | default : assign
    param -> specs | specs declarator | specs declarator N | specs abstract | ... | specs declarator attr | specs declarator = value
    abstract -> bare | * abstract | q abstract
    bare -> * | * q | [ | ( | ( ( | bare [
    header -> clause ; clause | clause ; ; | ; clause | ; ;
    header -> ; ; expr | ; expr ; | ; expr ; expr | clause ; ; expr | clause ; expr ; | clause ; expr ; expr | id list
    clause -> expr | specs inits
    inited -> entry | entry , | entry , inited
    entry -> assign | { | marks = assign | marks = { | id : assign | marks {
    marks -> . id | [ | marks . id | marks [ | [ ... [
    enums -> enum | enum , | enum , enums
    enum -> id | id = cond | id attr | id attr = cond
    index -> cond | q cond | * | q | cond ... cond
    """,
    inline=("id",),
)

_PY_KEYWORDS = frozenset("and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_PY_TOKEN = re.compile(
    r"""(?P<blank>[ \t\f]+|\\\r?\n|\#[^\n]*)
    |(?P<nl>\r?\n|\r)
    |(?P<str>[rRbBuUfFtT]{0,2}(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|(?!\"\"\"|''')(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')))
    |(?P<name>[^\W\d]\w*)
    |(?P<num>(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?P<glued>[\w]*))
    |(?P<conflict>^(?:<{7}|>{7}|\|{7})(?:[ ][^\n]*)?$|^={7}$)
    |(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|:=|->|[-+*/%@&|^]=|==|!=|<=|>=|\*\*|//|<<|>>|[-+*/%@&|^~<>=.,:;()\[\]{}])
    |(?P<bad>.)""",
    re.X | re.S | re.M,
)
_C_TOKEN = re.compile(
    r"""(?P<blank>[ \t\f\v]+|\\\r?\n|//(?:[^\n\\]|\\.)*|/\*.*?\*/)
    |(?P<nl>\r?\n|\r)
    |(?P<conflict>^(?:<{7}|>{7}|\|{7})(?:[ ][^\n]*)?$|^={7}$)
    |(?P<directive>^[ \t]*\#(?:/\*.*?\*/|//[^\n]*|[^\n\\/]|/(?![*/])|\\\r?\n|\\.)*)
    |(?P<str>(?:u8|[uUL])?"(?:[^"\\\n]|\\.)*"|[uUL]?'(?:[^'\\\n]|\\.)+')
    |(?P<name>[A-Za-z_$][\w$]*)
    |(?P<num>(?:0[xX][0-9a-fA-F']+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?|0[bB][01']+|(?:\d[\d']*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?:[uUlLfFzZ]|wb|WB)*(?P<glued>\w*))
    |(?P<op>\.\.\.|<<=|>>=|->|\+\+|--|[-+*/%&|^]=|==|!=|<=|>=|&&|\|\||<<|>>|[-+*/%&|^~!<>=?.,:;()\[\]{}])
    |(?P<bad>.)""",
    re.X | re.S | re.M,
)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
_C_KIND = dict.fromkeys("void char short int long float double signed unsigned _Bool bool _Complex __int128 wchar_t".split(), "t")
_C_KIND |= dict.fromkeys("static const extern inline volatile register typedef restrict auto _Noreturn _Thread_local thread_local constexpr _Atomic __inline __inline__ __restrict __restrict__ __volatile__ __extension__ __const".split(), "q")
_C_KIND |= dict.fromkeys(["struct", "union", "enum"], "record") | dict.fromkeys(["__attribute__", "__declspec", "_Alignas", "alignas", "__attribute"], "attribute")
_C_KIND |= dict.fromkeys(["sizeof", "_Alignof", "alignof", "__alignof__"], "sizeof") | dict.fromkeys(["asm", "__asm__", "__asm"], "asm") | dict.fromkeys(["_Static_assert", "static_assert"], "assert") | dict.fromkeys(["typeof", "__typeof__", "typeof_unqual"], "typeof")
_C_CONTROL = frozenset("if else while do for switch case default return break continue goto".split())
_CONFLICT = re.compile(r"^(?:<{7}(?: .*)?|={7}|>{7}(?: .*)?)$", re.M)
#: more failing pieces than these in a file are many, which tells a wrong language where edits are less dense
MANY = 6


class Edits:
    """Repairs of one file: their cost and the offsets where they lie."""

    def __init__(self) -> None:
        self.cost, self.places, self.pieces = 0, [], 0
        self._later: list[tuple] = []

    def add(self, place: int, cost: int = 1) -> None:
        self.cost += cost
        self.places.append(place)

    def later(self, check, *args) -> None:
        """Groups inside others are checked from a queue, so that no depth of nesting is too deep."""
        self._later.append((check, args))

    def finish(self) -> Edits:
        while self._later:
            check, args = self._later.pop()
            check(*args)
        return self

    def check(self, grammar: Grammar, start: str, tokens: list[tuple]) -> None:
        """Parse one folded sequence; tokens are (kind, offset, ...)."""
        if not _accepted(grammar, start, tokens):
            self.mend(grammar, start, tokens)

    def mend(self, grammar: Grammar, start: str, tokens: list[tuple], pieces: int = 1) -> None:
        """Add the cheapest repair of a whole sequence, of any length and cost; ``pieces`` of it do not parse."""
        cost, edits = grammar.repair(start, _kinds(grammar, tokens))
        if cost:
            self.pieces += pieces
        for k in edits:
            self.add(tokens[min(k, len(tokens) - 1)][1])


def _kinds(grammar: Grammar, tokens: list[tuple]) -> tuple[str, ...]:
    return _c_kinds(tokens) if grammar is C else tuple(t[0] for t in tokens)


def _accepted(grammar: Grammar, start: str, tokens: list[tuple]) -> bool:
    kinds = _kinds(grammar, tokens)
    kept = _shortened(kinds) if grammar is PYTHON or start in ("statement", "list", "inited") else range(len(kinds))
    return grammar.accepts(start, tuple(kinds[k] for k in kept))


_OPERANDS = frozenset("n N a k c 0 s ( [ {".split())
_BETWEEN = frozenset(["op", "-", "+", "*", "/", "@", "**", "&", "and", "or"])
_BEFORE = frozenset(["-", "+", "~", "not", "!"])


def _shortened(kinds: tuple[str, ...]) -> list[int]:
    """Places of the tokens that are left when long chains of operators and elements are made short.

    What lies inside ``x op x op x``, ``- - - x`` or a list of more than six equal elements can be left out: the rest is derived just
    when the whole is.
    """
    kept = list(range(len(kinds)))
    if len(kinds) < 12:
        return kept
    out: list[int] = []
    for k in kept:
        kind = kinds[k]
        if kind in _BETWEEN and len(out) > 2 and kinds[out[-1]] in _OPERANDS and kinds[out[-2]] in _BETWEEN and kinds[out[-3]] in _OPERANDS:
            del out[-2:]  # x op x (op)
        elif kind in _BEFORE and len(out) > 1 and kinds[out[-1]] == kind and kinds[out[-2]] == kind:
            continue
        elif kind == "," and len(out) > 11 and all(kinds[out[-n]] == "," for n in (2, 4, 6, 8, 10)) and len({kinds[out[-n]] for n in (1, 3, 5, 7, 9, 11)}) == 1 and kinds[out[-1]] in _OPERANDS:
            del out[-2:]  # , x (,)
        out.append(k)
    return out


def _fold(tokens: list[tuple[str, str, int]], edits: Edits, end: int) -> list[list]:
    """Nest bracketed groups. A node is [kind, offset, text, children or None]; brackets that do not match are edits."""
    stack: list[tuple[str, list]] = []
    top: list[list] = []
    for kind, t, at in tokens:
        if kind == "op" and t in _OPEN:
            node = [t, at, t, []]
            top.append(node)
            stack.append((t, top))
            top = node[3]
        elif kind == "op" and t in _CLOSE:
            if stack and stack[-1][0] == _CLOSE[t]:
                top = stack.pop()[1]
            elif any(s[0] == _CLOSE[t] for s in stack):
                while stack[-1][0] != _CLOSE[t]:  # close what was left open
                    edits.add(at)
                    top = stack.pop()[1]
                top = stack.pop()[1]
            else:
                edits.add(at)
        else:
            top.append([kind, at, t, None])
    for _ in stack:
        edits.add(end)
    while stack:
        top = stack.pop()[1]
    return top


# --- Python ---


def _py_operands(nodes: list[list], edits: Edits, context: str) -> list[tuple[str, int]]:
    """Reduce names, literals, calls, subscripts and attributes to one token each; check the groups on the way."""
    out: list[tuple[str, int]] = []
    prev = ""  # the kind of the operand that the next trailer would follow
    after_def = ""
    for kind, at, t, kids in nodes:
        if kids is not None:
            if context == "def" and t in "([" and after_def:
                edits.later(_py_group, "typed" if t == "(" else "typevars", kids, edits, at, t)
                out.append((t, at))
                after_def = after_def if t == "[" else ""
                prev = ""
            elif context == "class" and after_def and t in "([":
                edits.later(_py_group, "args" if t == "(" else "typevars", kids, edits, at, t)
                out.append((t, at))
                prev = ""
            elif context == "import":
                edits.later(_py_group, "imported", kids, edits, at, t)
                out.append((t, at))
            elif prev and t == "(":
                edits.later(_py_group, "casep" if context == "case" else "args", kids, edits, at, t)
                out[-1] = ("c", out[-1][1])
                prev = "c"
            elif prev and t == "[":
                if not kids:
                    edits.add(at)
                edits.later(_py_group, "slices", kids, edits, at, t)
                out[-1] = ("a", out[-1][1])
                prev = "a"
            else:
                many = context == "with" and t == "(" and any(k[2] == "as" and k[3] is None for k in kids)
                edits.later(_py_group, "items" if many else {"(": "paren", "[": "list", "{": "brace"}[t], kids, edits, at, t, context == "case")
                out.append((t, at))
                prev = t
            continue
        if kind == "name":
            if prev == ".":
                out.pop()
                out[-1] = ("a", out[-1][1])
                prev = "a"
            elif t in _PY_KEYWORDS:
                out.append((t, at))
                prev = ""
                after_def = t if t in ("def", "class") else after_def
            else:
                k = "k" if t in ("None", "True", "False") else "n"
                out.append((k, at))
                prev = k
        elif kind in ("str", "num"):
            if kind == "str" and out and out[-1][0] == "k" and prev == "s":
                continue  # adjacent strings are one
            out.append(("k", at))
            prev = "s" if kind == "str" else "k"
        elif kind == "op":
            if t == "." and prev and prev not in (".",):
                out.append((".", at))
                prev = "."
                continue
            k = t
            if t.endswith("=") and t not in ("=", "==", "!=", "<=", ">=", ":="):
                k = "aug"
            elif t in ("==", "!=", "<=", ">=", "<", ">", "//", "%", "<<", ">>", "&", "|", "^"):
                k = "op"
            out.append((k, at))
            prev = "..." if t == "..." else ""
        else:
            out.append((kind, at))
            prev = ""
    return out


def _py_group(start: str, kids: list[list], edits: Edits, at: int, bracket: str, pattern: bool = False) -> None:
    kids = [k for k in kids if k[0] != "nl"]
    if not kids:
        if start in ("imported", "typevars"):
            edits.add(at)
        return
    tokens = _py_operands(kids, edits, "case" if pattern or start == "casep" else "")
    if pattern or start == "casep":
        return  # patterns nest freely; their heads are checked
    kinds = tuple(k for k, _ in tokens)
    # long collections are checked element by element, which the grammar's lists allow
    if len(kinds) > 24 and start in ("paren", "list", "brace", "args") and "for" not in kinds:
        piece: list[tuple[str, int]] = []
        form = {"paren": "star", "list": "star", "args": "arg", "brace": "pair" if ":" in kinds or "**" in kinds else "star"}[start]
        parameters = 0  # lambdas whose parameters are not over: their commas separate no elements
        failing = 0
        for tok in [*tokens, (",", at)]:
            parameters += (tok[0] == "lambda") - (tok[0] == ":" and parameters > 0)
            if tok[0] != "," or parameters:
                piece.append(tok)
            else:
                failing += not _accepted(PYTHON, form, piece) if piece else tok[1] != at
                piece = []
        if piece:
            failing += not _accepted(PYTHON, start, piece)
        if failing:  # elements tell that it fails, the whole what repairs it
            edits.mend(PYTHON, start, tokens, failing)
        return
    edits.check(PYTHON, start, tokens)


_HEADS = frozenset("if elif else while for try except finally with def class async match case".split())


def python_edits(source: str) -> Edits:
    edits = Edits()
    text = source.removeprefix("﻿")
    if "\0" in text:
        edits.add(text.index("\0"))
    tokens: list[tuple[str, str, int]] = []
    for m in _PY_TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "blank":
            continue
        if kind == "glued":
            kind = "num"
        t = m[0]
        if kind == "num":
            if m["glued"]:
                follows = re.match(r"(?:and|else|for|if|in|is|or|not)\b", m["glued"])
                if not follows:
                    edits.add(m.start())
            elif re.match(r"0\d", t) and not re.match(r"[\d_]*[.eEjJ]|0[0_]*$", t):
                edits.add(m.start())
        elif kind == "bad":
            edits.add(m.start())
            if t in "\"'":  # a string that never ends
                edits.places.append(len(text) if text.startswith((t * 3,), m.start()) else m.start())
            continue
        elif kind == "conflict":
            edits.add(m.start())
            continue
        if kind == "num" and m["glued"]:  # a keyword may stand right after a number
            tokens.append(("num", t[: -len(m["glued"])], m.start()))
            kind, t = "name", m["glued"]
        tokens.append((kind, t, m.start()))
    nodes = _fold(tokens, edits, len(text))
    # logical lines
    lines: list[list[list]] = [[]]
    for node in nodes:
        if node[0] == "nl":
            if lines[-1]:
                lines.append([])
        else:
            lines[-1].append(node)
    if not lines[-1]:
        lines.pop()
    indents = [0]
    owners: list[list[str]] = [[]]  # kinds of the statements of each open block
    expects = False
    for line in lines:
        start = line[0][1]
        margin = text[text.rfind("\n", 0, start) + 1 : start]
        width = len(margin.expandtabs(8))
        if expects:
            if width <= indents[-1]:
                edits.add(start)  # a header without its block
            else:
                indents.append(width)
                owners.append([])
        elif width > indents[-1]:
            edits.add(start)
            indents.append(width)
            owners.append([])
        while width < indents[-1]:
            indents.pop()
            block = owners.pop()
            if block and block[-1] in ("try", "@"):
                edits.add(start)
            if width > indents[-1]:
                edits.add(start)  # no block has this margin
                indents.append(width)
                owners.append(block)
                break
        word = line[0][2] if line[0][0] == "name" else line[0][2] if line[0][2] == "@" else ""
        if word == "async" and len(line) > 1:
            word = line[1][2]
        context = word if word in ("def", "class", "case") else "import" if word in ("from", "import") else ""
        # match, case and type are keywords only where what follows fits
        soft = word in ("match", "case") and len(line) > 1 and any(n[2] == ":" and n[3] is None for n in line[1:]) or word == "type" and len(line) > 1 and line[1][0] == "name"
        if word == "case" and not soft:
            context = ""
        if word == "with":
            context = "with"
        reduced = _py_operands(line[1:] if soft else line, edits, context)
        if soft:
            reduced = [(word, start), *reduced]
            if not PYTHON.accepts("line", tuple(k for k, _ in reduced)):
                plain = _py_operands(line, Edits(), "")
                if PYTHON.accepts("line", tuple(k for k, _ in plain)):
                    reduced, word = plain, ""
        edits.check(PYTHON, "line", reduced)
        block = owners[-1]
        before = block[-1] if block else ""
        if word in ("elif", "else", "except", "finally"):
            fits = {"elif": ("if", "elif"), "else": ("if", "elif", "for", "while", "except"), "except": ("try", "except"), "finally": ("try", "except", "tryelse")}[word]
            if before not in fits:
                edits.add(start)
            block.append("tryelse" if word == "else" and before == "except" else "elsedone" if word == "else" else word)
        else:
            if before == "try":
                edits.add(start)
            if before == "@" and word not in ("@", "def", "class"):
                edits.add(start)
            block.append(word or "-")
        expects = line[-1][2] == ":" and line[-1][3] is None and (word in _HEADS or reduced[0][0] in _HEADS)
    if expects:
        edits.add(len(text))
    for block in owners:
        if block and block[-1] in ("try", "@"):
            edits.add(len(text))
    return edits.finish()


# --- C ---


def _c_tokens(nodes: list[list], edits: Edits) -> list[tuple]:
    out = []
    for node in nodes:
        kind, at, t, kids = node
        if kids is not None:
            out.append((t, at, node))
        elif kind == "name":
            out.append((t if t in _C_CONTROL else _C_KIND.get(t, "n"), at, node))
        elif kind == "num":
            out.append(("0", at, node))
        elif kind == "str":
            out.append(("s", at, node))
        elif kind == "op":
            if t.endswith("=") and t not in ("=", "==", "!=", "<=", ">="):
                k = "aug"
            elif t in ("==", "!=", "<=", ">=", "<", ">", "/", "%", "<<", ">>", "|", "^", "&&", "||", "+"):
                k = "op" if t != "+" else "-"
            else:
                k = {"~": "!", "--": "++", "->": "."}.get(t, t)
            out.append((k if t != "&&" else "op", at, node))
    return out


def _c_groups(tokens: list[tuple], edits: Edits, brace: str) -> None:
    """Check the groups of a sequence. ``brace``: what a brace at this place holds."""
    record = ""
    _c_types(tokens, edits)
    for i, (kind, at, node) in enumerate(tokens):
        if kind == "record":
            record = node[2]
        elif kind == "{":
            if record and tokens[i - 1][0] in ("record", "n", "(") and any(t[0] == "record" for t in tokens[max(0, i - 3) : i]):
                if record == "enum":
                    edits.later(_c_sequence, "enums", node, edits)
                else:
                    edits.later(_c_members, node, edits)
                record = ""
            elif brace == "block" and i == len(tokens) - 1 and not any(t[0] in ("=", "aug") for t in tokens[:i]):
                edits.later(_c_block, node[3], edits, at)
            else:
                edits.later(_c_sequence, "inited", node, edits)
        elif kind == "[":
            edits.later(_c_sequence, "index", node, edits)
        elif kind == "(":
            if i and (tokens[i - 1][0] in ("attribute", "asm") or any(t[0] == "asm" for t in tokens[max(0, i - 3) : i])):
                continue
            edits.later(_c_sequence, "list", node, edits)


_MACRO = re.compile(r"_*[A-Z][A-Z0-9_]*|__\w+")


def _c_kinds(tokens: list[tuple]) -> tuple[str, ...]:
    """Kinds for the grammar: a name written as macros are may stand where a qualifier can."""
    return tuple("N" if t[0] == "n" and len(t) > 2 and t[2] and _MACRO.fullmatch(t[2][2]) else t[0] for t in tokens)


def _c_types(tokens: list[tuple], edits: Edits) -> None:
    """Type words that stand together must make one type."""
    run: list[str] = []
    for t in [*tokens, ("", 0, None)]:
        if t[0] == "t":
            run.append(t[2][2])
        elif t[0] != "q":
            bases = [w for w in run if w not in ("short", "long", "signed", "unsigned", "_Complex", "int")]
            if len(run) > 1 and (run.count("int") > 1 or len(bases) > 1 or bases and "int" in run or run.count("long") > 2 or run.count("short") > 1 or "short" in run and "long" in run or {"signed", "unsigned"} <= set(run)):
                edits.add(t[1])
            run = []


def _c_sequence(start: str, node: list, edits: Edits) -> None:
    tokens = _c_tokens(node[3], edits)
    if not tokens:
        return
    if tokens[0][0] == "{" and start == "list" and len(tokens) == 1:  # a statement as an expression
        edits.later(_c_block, tokens[0][2][3], edits, node[1])
        return
    _c_groups(tokens, edits, "")
    kinds = tuple(t[0] for t in tokens)
    if start == "list" and ";" in kinds:
        edits.check(C, "header", tokens)
        return
    if len(kinds) > 24 and start in ("inited", "list", "enums"):
        piece: list[tuple] = []
        form = {"inited": "entry", "list": "item", "enums": "enum"}[start]
        failing = 0
        for k, t in enumerate([*tokens, (",", node[1], None)]):
            if t[0] != ",":
                piece.append(t)
            else:
                failing += not _accepted(C, form, piece) if piece else k < len(tokens)
                piece = []
        if failing:  # elements tell that it fails, the whole what repairs it
            edits.mend(C, start, tokens, failing)
        return
    if start == "list" and C.accepts("specs", _c_kinds(tokens)):
        return
    edits.check(C, start, tokens)


def _c_members(node: list, edits: Edits) -> None:
    piece: list[tuple] = []
    for t in _c_tokens(node[3], edits):
        piece.append(t)
        if t[0] == ";":
            _c_groups(piece, edits, "")
            edits.check(C, "members", piece)
            piece = []
    if piece:
        edits.check(C, "members", piece)


class _Control:
    """Control words whose statements are still open, innermost last; ``done`` when a statement has just ended."""

    def __init__(self) -> None:
        self.open: list[str] = []
        self.done = False

    def otherwise(self) -> bool:
        """Give an else to the innermost complete if; false where there is none."""
        if self.done:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k] == "do":
                    break
                if self.open[k] == "if":
                    self.open[k:] = ["else"]
                    self.done = False
                    return True
        return False

    def ends_do(self) -> bool:
        """Whether a while that follows belongs to a do; the words inside it are complete then."""
        if self.done and "do" in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index("do") :]
            return True
        return False

    def settle(self) -> int:
        """Another statement begins or the block ends: how many words lack theirs."""
        lacking = self.open.count("do") if self.done else len(self.open)
        if self.done:
            self.open = []
            self.done = False
            return lacking
        return 0 if self.open else lacking


def _c_block(nodes: list[list], edits: Edits, at: int) -> None:
    """Statements: control words are followed through, simple statements are parsed by chart."""
    tokens = _c_tokens(nodes, edits)
    i, n = 0, len(tokens)
    control = _Control()
    while i < n:
        kind, place, node = tokens[i]
        if kind == "else":
            if not control.otherwise():
                edits.add(place)
            i += 1
            continue
        if kind == "while" and control.ends_do():
            if i + 1 < n and tokens[i + 1][0] == "(" and tokens[i + 1][2][3]:
                edits.later(_c_sequence, "list", tokens[i + 1][2], edits)
                i += 2
            else:
                edits.add(place)
                i += 1
            if i < n and tokens[i][0] == ";":
                i += 1
            else:
                edits.add(place)
            control.done = True
            continue
        for _ in range(control.settle()):
            edits.add(place)
        if kind in ("if", "while", "for", "switch"):
            if i + 1 < n and tokens[i + 1][0] == "(":
                group = tokens[i + 1][2]
                if not group[3] or kind == "for" and sum(k[2] == ";" and k[3] is None for k in group[3]) != 2:
                    edits.add(place)
                else:
                    edits.later(_c_sequence, "list", group, edits)
                i += 2
                control.open.append("if" if kind == "if" else "loop")
            else:
                edits.add(place)
                i += 1
            continue
        if kind == "do":
            control.open.append("do")
            i += 1
            continue
        if kind in ("case", "default") or kind == "n" and i + 1 < n and tokens[i + 1][0] == ":" and not _in_ternary(tokens, i):
            j = i
            while j < n and tokens[j][0] != ":":
                j += 1
            piece = tokens[i : j + 1]
            _c_groups(piece, edits, "")
            edits.check(C, "label", piece)
            i = j + 1
            continue
        if kind == "{":
            edits.later(_c_block, node[3], edits, place)
            i += 1
            control.done = True
            continue
        j = i
        while j < n and tokens[j][0] != ";" and not (tokens[j][0] in ("if", "while", "for", "switch", "do", "return", "case", "default") and j > i):
            if tokens[j][0] == "{" and j > i and tokens[j - 1][0] == "(" and kind in ("n", "t", "q") and not any(t[0] in ("=", "record") for t in tokens[i:j]):
                break
            j += 1
        if j < n and tokens[j][0] == "{":  # a macro with a block, as list iterators have
            _c_groups(tokens[i:j], edits, "")
            if not (j == i + 2 and kind == "n") and not (kind in ("t", "q", "n") and j - i >= 3):
                edits.check(C, "statement", [*tokens[i:j], (";", place, None)])
            edits.later(_c_block, tokens[j][2][3], edits, place)
            i = j + 1
            control.done = True
            continue
        piece = tokens[i : j + 1] if j < n and tokens[j][0] == ";" else tokens[i:j]
        _c_groups(piece, edits, "")
        edits.check(C, "statement", piece)
        i = max(j + 1 if j < n and tokens[j][0] == ";" else j, i + 1)
        control.done = True
    left = control.settle() if control.done else len(control.open)
    for _ in range(left):
        edits.add(tokens[-1][1] if tokens else at)


def _in_ternary(tokens: list[tuple], i: int) -> bool:
    """Whether a colon after a name belongs to a condition that began earlier in the statement."""
    j = i - 1
    while j >= 0 and tokens[j][0] not in (";", "{", ":", "else", "do"):
        if tokens[j][0] == "?":
            return True
        j -= 1
    return False


def c_edits(source: str) -> Edits:
    edits = Edits()
    text = source.removeprefix("﻿")
    tokens: list[tuple[str, str, int]] = []
    depth = 0
    branches: list[list[bool]] = []  # of each open condition: whether its present branch is read, and whether one has been
    for m in _C_TOKEN.finditer(text):
        kind = m.lastgroup
        if kind in ("blank", "nl"):
            continue
        if not all(b[0] for b in branches) and kind not in ("directive", "conflict"):
            continue  # one branch of a condition is read: the other may open the same braces again
        if kind == "glued":
            kind = "num"
        if kind == "num" and m["glued"]:
            edits.add(m.start())
        if kind == "directive":
            word = re.match(r"[ \t]*#[ \t]*(\w*)", m[0])[1]
            if word in ("if", "ifdef", "ifndef"):
                depth += 1
                read = not re.match(r"[ \t]*#[ \t]*(?:if[ \t]+0\b|ifdef[ \t]+__cplusplus|if[ \t]+defined[ \t]*\(?[ \t]*__cplusplus)", m[0])
                branches.append([read, read])
            elif word in ("else", "elif", "elifdef", "elifndef") and branches:
                branches[-1] = [not branches[-1][1], True]
            elif word == "endif":
                depth -= 1
                if depth < 0:
                    edits.add(m.start())
                    depth = 0
                if branches:
                    branches.pop()
            elif word and word not in ("include", "define", "undef", "else", "elif", "elifdef", "elifndef", "pragma", "error", "warning", "line", "include_next", "import", "ident", "embed"):
                edits.add(m.start())
            continue
        if kind in ("bad", "conflict"):
            edits.add(m.start())
            continue
        tokens.append((kind, m[0], m.start()))
    for _ in range(depth):
        edits.add(len(text))
    opened = re.search(r"/\*", _blanked(text))
    if opened:
        edits.add(len(text))
    flat = _c_tokens(_fold(tokens, edits, len(text)), edits)
    piece: list[tuple] = []
    old_style = 0  # up to where declarations of parameters stand between the head of a function and its body
    for k, t in enumerate(flat):
        piece.append(t)
        if t[0] == ";" and k < old_style:
            _c_groups(piece, edits, "")
            edits.check(C, "members", piece)
            piece = []
            continue
        body = t[0] == "{" and len(piece) > 1 and piece[-2][0] in ("(", "attribute") and not any(p[0] == "=" for p in piece)
        macro = t[0] == "{" and len(piece) > 1 and piece[0][0] != "record" and piece[-2][0] == "n" and not any(p[0] in ("record", "=") for p in piece)
        if t[0] == "{" and len(piece) == 1 and k == old_style > 0:
            edits.later(_c_block, t[2][3], edits, t[1])
            piece = []
        elif t[0] == ";" and (at := _old_style(piece)) and (stop := _body_after(flat, k)):
            head, piece = [*piece[:at], ("{", t[1], None)], piece[at:]
            _c_groups(head[:-1], edits, "")
            edits.check(C, "outer", head)
            _c_groups(piece, edits, "")
            edits.check(C, "members", piece)
            piece, old_style = [], stop
        elif t[0] == ";" or body or macro and piece[0][2][2] == "extern":
            _c_groups(piece, edits, "block" if body else "")
            edits.check(C, "outer", piece)
            piece = []
        elif t[0] == "{" and len(piece) == 2 and piece[0][2][2] == "extern" or t[0] == "{" and len(piece) == 3 and piece[0][2][2] == "extern" and piece[1][0] == "s":
            piece = []
    if piece and not all(t[0] == "n" and re.fullmatch(r"_*[A-Z][A-Z0-9_]{3,}", t[2][2]) for t in piece):  # macros that stand alone
        _c_groups(piece, edits, "")
        edits.check(C, "outer", piece)
    return edits.finish()


def _old_style(piece: list[tuple]) -> int:
    """Where the first parameter declaration begins in ``type name(a, b) type a;``, 0 if this is none."""
    for k in range(1, len(piece) - 2):
        if piece[k][0] == "=":
            return 0
        if piece[k][0] == "(" and piece[k - 1][0] == "n" and piece[k + 1][0] in ("t", "q", "n", "record"):
            names = [n for n in piece[k][2][3] if n[0] != "nl"]
            return k + 1 if names and all(n[0] == ("op" if m % 2 else "name") for m, n in enumerate(names)) else 0
    return 0


def _body_after(flat: list[tuple], k: int) -> int:
    """The place of a body that declarations lead to, each ended by a semicolon; 0 if none follows."""
    while k + 1 < len(flat):
        if flat[k][0] == ";" and flat[k + 1][0] == "{":
            return k + 1
        k += 1
        if flat[k][0] in ("=", "{"):
            return 0
    return 0


def _blanked(text: str) -> str:
    """The text without what the lexer takes as a comment or string."""
    return "".join(m[0] for m in _C_TOKEN.finditer(text) if m.lastgroup in ("op", "bad", "name", "nl")) if "/*" in text and text.count("/*") > text.count("*/") else ""


def repairs(language: str, source: str | None) -> tuple[int, str | None]:
    """(edit cost, cause) of a file: cost 0 and no cause where it parses.

    Cause: 'conflict' where merge markers stand, 'truncation' where all edits lie at the end,
    'mismatch' where they lie all over, 'error' otherwise. An empty file parses.
    """
    if not source:
        return 0, None
    # the exact check of Python: a file that it finds valid costs nothing, whatever the chart would say, so it comes first
    found = error_place(source) if language == "python" else None
    if found == -1:
        return 0, None
    edits = (python_edits if language == "python" else c_edits)(source)
    if found is not None and not edits.cost:
        edits.add(found)
    if not edits.cost:
        return 0, None
    if len(_CONFLICT.findall(source)) >= 2:
        return edits.cost, "conflict"
    starts = [m.start() for m in re.finditer(r"^", source, re.M)]
    lines = sorted({bisect_right(starts, min(p, len(source))) for p in edits.places})
    total = source.rstrip().count("\n") + 1
    if lines[0] >= total:
        return edits.cost, "truncation"
    if len(lines) >= max(2, 0.25 * total) or edits.pieces > MANY and len(lines) > 0.15 * total:
        return edits.cost, "mismatch"
    return edits.cost, "error"


def error_place(source: str) -> int | None:
    """Where the running interpreter (3.12 or later) finds a syntax error in Python, -1 where it finds none, null where
    the file is beyond its own limits of nesting, which are no errors of syntax."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(source)
        return -1
    except SyntaxError as e:
        if "too many nested" in str(e) or "too many statically nested" in str(e):
            return None
        line = max(1, e.lineno or 1)
        return min(len(source), sum(len(x) for x in source.splitlines(keepends=True)[: line - 1]) + max(0, (e.offset or 1) - 1))
    except ValueError:
        return max(0, source.find("\0"))
    except (RecursionError, MemoryError):
        return None


#: fixed values: notes of a crawl that are no syntax errors, and the ways in which syntax errors are worded
_OTHER_NOTE = r"(?i)^line \d+: |larger than|too large|codec can't|can't decode|undecodable|cat-file failed|is missing|no such file|permission denied|timed? ?out|binary file"
_SYNTAX_NOTE = (
    r"(?i)syntax|\bpars(?:e|ed|er|ing)\b|grammar|unterminated|never closed|unclosed|unindent|indentation|indented|unmatched|does not match|unexpected (?:end|eof|token|character|indent|symbol)|end of file|\beof\b"
    r"|invalid (?:decimal|hexadecimal|octal|binary|digit|character|non-printable|token|expression|escape|literal|imaginary|string|target)|missing (?:parenthes|semicolon|brace|bracket)|expected |cannot assign|leading zeros|inconsistent use of tabs|not allowed|forgot a comma|merge conflict"
)


def skipped_as_invalid(revisions: DataFrame) -> DataFrame:
    """(repo, sha, path) of the files that a revision's notes report as not parsed or as having a syntax error.

    A note is ``path: reason``; notes with ``path#symbol``, about single lines, and about files that are too
    large, undecodable or missing are none. Null lists and null notes say nothing.
    """
    notes = revisions.where("skipped is not null").select("repo", "sha", F.explode("skipped").alias("note"))
    path, reason = F.expr("substring(note, 1, locate(': ', note) - 1)"), F.expr("substring(note, locate(': ', note) + 2)")
    return (
        notes.where("locate(': ', note) > 1").select("repo", "sha", path.alias("path"), reason.alias("reason"))
        .where(~F.col("path").contains("#") & ~F.col("reason").rlike(_OTHER_NOTE) & F.col("reason").rlike(_SYNTAX_NOTE))
        .select("repo", "sha", "path").distinct()
    )


def unparsed_pages(definitions: DataFrame) -> DataFrame:
    """(identity, language, cost, cause) of the whole-file pages in python or c that need repair."""
    schema = pa.schema([("identity", pa.string()), ("language", pa.string()), ("cost", pa.int32()), ("cause", pa.string())])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for identity, language, source in zip(*(c.to_pylist() for c in b.columns)):
                cost, cause = repairs(language, source)
                if cost:
                    rows.append((identity, language, cost, cause))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

    pages = definitions.where("kind = 'script' and language in ('python', 'c') and identity is not null").select("identity", "language", "source")
    return (
        spread(pages).mapInArrow(judged, "identity string, language string, cost int, cause string")
        .dropDuplicates(["identity"])
    )


def invalid_files(definitions: DataFrame, locations: DataFrame, revisions: DataFrame) -> DataFrame:
    """(repo, sha, path, language, cost, cause) of the files that are not valid in their language.

    ``cost`` is the number of edits that repair the page (one for each bracket, block or character out of place, and the
    least that each statement or group takes, whatever its length), ``cause`` as in ``repairs``. Files that only the
    notes report have a null cost, cause 'reported', and the language of their suffix ('' if it is another).
    Null or empty sources parse; places of pages without a row count only where reported; repeated rows count once.
    """
    found = whole_files(locations).join(unparsed_pages(definitions), "identity").select("repo", "sha", "path", "language", "cost", "cause")
    noted = skipped_as_invalid(revisions)
    ending = F.lower(F.substring_index("path", ".", -1))
    language = F.when(ending == "py", "python").when(ending.isin("c", "h"), "c").otherwise("")
    rest = noted.join(found.select("repo", "sha", "path").distinct(), ["repo", "sha", "path"], "left_anti")
    return found.unionByName(
        rest.select("repo", "sha", "path", language.alias("language"), F.lit(None).cast("int").alias("cost"), F.lit("reported").alias("cause"))
    ).distinct()


def invalid_rates(invalid: DataFrame, revisions: DataFrame) -> DataFrame:
    """Per repository and language: invalid files over the files of the trees of all its revisions."""
    trees = revisions.groupBy("repo", "sha").agg(F.max("files").alias("files")).groupBy("repo").agg(F.sum("files").alias("files"))
    bad = invalid.groupBy("repo", "language").agg(F.countDistinct("sha", "path").alias("invalid"))
    return bad.join(trees, "repo").select("repo", "language", "invalid", "files", F.when(F.col("files") > 0, F.col("invalid") / F.col("files")).alias("rate"))
