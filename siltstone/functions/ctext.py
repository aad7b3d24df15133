"""Reading C-like program text: words, statements, loops and memory accesses, without building a syntax tree.

Text is cut into words once; comments and preprocessor lines are left out. Brackets are matched on the words, so what
stands in them may run over lines and nest as deep as it likes. Damaged text gives what can still be read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

# Sizes of the types that a decompiler or a device header writes.
WIDTHS = {
    "char": 1, "byte": 1, "uchar": 1, "undefined": 1, "undefined1": 1, "uint8_t": 1, "int8_t": 1, "bool": 1,
    "short": 2, "ushort": 2, "word": 2, "undefined2": 2, "uint16_t": 2, "int16_t": 2,
    "int": 4, "uint": 4, "long": 4, "ulong": 4, "dword": 4, "undefined4": 4, "uint32_t": 4, "int32_t": 4,
    "undefined8": 8, "longlong": 8, "uint64_t": 8, "int64_t": 8,
}
# Words of the language that can stand before a bracket or a value.
RESERVED = frozenset("if else while for do return switch case break continue goto sizeof typedef struct union enum void int char short long float double unsigned signed const volatile static extern register auto inline bool true false NULL".split())
COMPOUND = frozenset(["+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>="])
PERIPHERAL = ((0x40000000, 0x5FFFFFFF), (0xE0000000, 0xFFFFFFFF))

_WORD = re.compile(
    r"""[ \t\r\f\v]+|(?P<nl>\n)|(?P<out>//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|$))|(?P<text>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)"""
    r"|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>0[xX][0-9a-fA-F]+[uUlL]*|[0-9][\w.]*)"
    r"|(?P<sign><<=|>>=|\.\.\.|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|::|[^\s])"
)
_SPACES = re.compile(r"[ \t\r\n\f\v]+")
_DATA = re.compile(r"_?DAT_([0-9a-fA-F]+)")
_GENERATED = re.compile(r"[a-z]+Var[0-9]+|(?:param|local)_\w+|[a-z]*Stack_?\w*")


@dataclass
class Code:
    """The words of a text: kind (name, number, text, sign), the text itself, place and line of each, and for every
    opening or closing bracket the place of its partner in the lists (-1 where it has none)."""

    kind: list[str]
    word: list[str]
    at: list[int]
    end: list[int]
    line: list[int]
    partner: list[int]
    source: str

    def text(self, lo: int, hi: int) -> str:
        """The source from word ``lo`` up to before word ``hi``, plain white space made single."""
        return _SPACES.sub(" ", self.source[self.at[lo] : self.end[hi - 1]]) if lo < hi else ""


def read(source: str) -> Code:
    kind, word, at, end, line = [], [], [], [], []
    breaks = [m.start() for m in re.finditer("\n", source)]
    fresh = True  # nothing but white space on this line so far
    skip_till = -1
    for m in _WORD.finditer(source):
        group = m.lastgroup
        if group == "nl":
            fresh = True
            continue
        if group is None or group == "out" or m.start() < skip_till:
            continue
        if fresh and m[0] == "#":
            cut = source.find("\n", m.start())
            skip_till = len(source) if cut < 0 else cut
            continue
        fresh = False
        kind.append(group)
        word.append(m[0])
        at.append(m.start())
        end.append(m.end())
        line.append(bisect_right(breaks, m.start()))
    partner = [-1] * len(word)
    open_: list[int] = []
    pairs = {")": "(", "]": "[", "}": "{"}
    for i, w in enumerate(word):
        if kind[i] != "sign":
            continue
        if w in "([{":
            open_.append(i)
        elif w in pairs:
            if w == "}":  # a block's end closes what damaged text left open in it
                while open_ and word[open_[-1]] != "{":
                    open_.pop()
            if open_ and word[open_[-1]] == pairs[w]:
                partner[i] = open_.pop()
                partner[partner[i]] = i
    return Code(kind, word, at, end, line, partner, source)


def value_of(word: str) -> int | None:
    """The number a word writes, suffixes left out."""
    w = word.rstrip("uUlL")
    try:
        return int(w, 16) if w[:2] in ("0x", "0X") else int(w)
    except ValueError:
        return None


def in_peripherals(n: int) -> bool:
    return any(lo <= n <= hi for lo, hi in PERIPHERAL)


def statements(c: Code) -> Iterator[tuple[int, int, int]]:
    """(first word, word behind the last, place of the first assignment or -1). Statements end at ``;`` and braces;
    the parts of a loop's or branch's head are statements of their own."""
    lo = 0
    assign = -1
    heads: set[int] = set()
    for i, w in enumerate(c.word):
        if c.kind[i] != "sign":
            if w in ("if", "while", "for", "switch") and i + 1 < len(c.word) and c.word[i + 1] == "(" and c.partner[i + 1] > 0:
                heads |= {i + 1, c.partner[i + 1]}
            continue
        if w in ("{", "}", ";") or i in heads:
            if lo < i:
                yield lo, i, assign
            lo, assign = i + 1, -1
        elif assign < 0 and (w == "=" or w in COMPOUND):
            assign = i
    if lo < len(c.word):
        yield lo, len(c.word), assign


def casts(c: Code) -> Iterator[tuple[int, str, int]]:
    """(place of the star, type, first word of the operand) of every ``*(T *)``."""
    w = c.word
    for i in range(len(w) - 4):
        if w[i] != "*" or w[i + 1] != "(" or c.kind[i] != "sign":
            continue
        j = i + 2
        while j < len(w) and w[j] in ("volatile", "const", "struct", "unsigned", "signed"):
            j += 1
        if j + 2 < len(w) and c.kind[j] == "name" and w[j + 1] == "*" and w[j + 2] == ")":
            if j + 3 < len(w):
                yield i, w[j], j + 3


def _operand(c: Code, i: int) -> tuple[int, int, int]:
    """First word, word behind the last, and word behind the whole, of the operand at ``i``."""
    if c.word[i] == "(":
        k = c.partner[i]
        return (i + 1, k, k + 1) if k > 0 else (i + 1, i + 1, i + 1)
    j = i + 1 if c.word[i] == "&" and i + 1 < len(c.word) else i
    return i, j + 1, j + 1


def _meaning(c: Code, lo: int, hi: int) -> tuple[str, str, str | None, int | None]:
    """(shape, provenance, base, number) of the operand ``lo:hi``."""
    w = c.word
    while lo < hi and w[lo] == "(" and c.partner[lo] == hi - 1:
        lo, hi = lo + 1, hi - 1
    names = [w[i] for i in range(lo, hi) if c.kind[i] == "name"]
    param = next((n for n in names if n.startswith("param_")), None)
    number = value_of(w[lo]) if c.kind[lo] == "number" else None
    data = _DATA.fullmatch(w[lo])
    if hi - lo == 1:
        if number is not None:
            return "constant", "CONST", None, number
        if data:
            return "constant", "CONST", None, int(data[1], 16)
    if hi - lo > 2 and w[lo + 1] == "+":
        if number is not None and w[lo][:2] in ("0x", "0X"):
            return "constant_offset", "CONST", None, number
        if data:
            return "data_offset", "GLOBAL_PTR", None, int(data[1], 16)
    last = value_of(w[hi - 1]) if hi - lo > 2 and w[hi - 2] == "+" and c.kind[hi - 1] == "number" else None
    if last is not None and (in_peripherals(last) or (param is None and w[hi - 1][:2] in ("0x", "0X") and last >= 0x1000)):
        return "constant_offset", "CONST", None, last
    if param:
        return "parameter", "ARG", param, last
    if w[lo] == "&" and names and names[0].startswith("local_"):
        return "stack", "STACK_PTR", names[0], last
    base = w[lo] if c.kind[lo] == "name" else names[0] if names else None
    return "pointer", "UNKNOWN", base, last


def accesses(c: Code) -> list[tuple[int, str, str, str, int, str | None, int | None]]:
    """Rows (line, kind, shape, provenance, width, base, number) of a text's memory accesses, in order.

    Read are dereferences of casts, bare data labels, and elements of named arrays. Of accesses that lie within one
    another the outer one counts. What stands before the first assignment of its statement is stored, with a
    compound assignment loaded and stored, everything else loaded. ``number`` is an address where the provenance is
    CONST or GLOBAL_PTR, else the offset added to ``base``; a small number added to a parameter is an offset. A number
    that signed 64 bits can't hold is None.
    """
    found: list[tuple[int, int, str, str, int, str | None, int | None]] = []
    for i, type_name, operand in casts(c):
        lo, hi, end = _operand(c, operand)
        if lo < hi:
            found.append((i, end, *_meaning(c, lo, hi)[:2], WIDTHS.get(type_name, 4), *_meaning(c, lo, hi)[2:]))
    claimed = _outermost(found)
    rest: list = []
    covered = [False] * len(c.word)
    for f in claimed:
        covered[f[0] : f[1]] = [True] * (f[1] - f[0])
    for i, w in enumerate(c.word):
        if c.kind[i] != "name" or covered[i]:
            continue
        data = _DATA.fullmatch(w)
        if data and len(data[1]) == 8:
            rest.append((i, i + 1, "data", "CONST", 4, None, int(data[1], 16)))
        elif i + 1 < len(c.word) and c.word[i + 1] == "[" and c.partner[i + 1] > 0 and w not in RESERVED and not _GENERATED.fullmatch(w):
            rest.append((i, c.partner[i + 1] + 1, "element", "UNKNOWN", 4, w, None))
    out = []
    spans = sorted([*claimed, *_outermost(rest)])
    stops = list(statements(c))
    k = 0
    for i, _, shape, provenance, width, base, number in spans:
        while k < len(stops) and stops[k][1] <= i:
            k += 1
        assign = stops[k][2] if k < len(stops) and stops[k][0] <= i else -1
        kinds = ("load",) if assign < 0 or i > assign else ("load", "store") if c.word[assign] in COMPOUND else ("store",)
        number = number if number is not None and number < 1 << 63 else None
        out += [(c.line[i], kind, shape, provenance, width, base, number) for kind in kinds]
    return out


def _outermost(spans: Sequence[tuple]) -> list[tuple]:
    kept: list[tuple] = []
    for s in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
    return kept


_ORDER = ("<", "<=", ">", ">=", "!=", "==")


def _body(c: Code, i: int) -> tuple[int, int]:
    """The words of the block or single statement at ``i``."""
    if i < len(c.word) and c.word[i] == "{":
        return i + 1, c.partner[i] if c.partner[i] > 0 else len(c.word)
    j = i
    while j < len(c.word) and c.word[j] != ";":
        j = c.partner[j] if c.word[j] in ("(", "[", "{") and c.partner[j] > j else j + 1
    return i, min(j + 1, len(c.word))


def bound_of(c: Code, lo: int, hi: int) -> tuple[str | None, bool]:
    """What the condition ``lo:hi`` compares its counter with, and whether that is a constant. A condition that only
    counts down is bounded by its counter."""
    depth_end = lo
    for i in range(lo, hi):
        if i < depth_end:
            continue
        if c.word[i] in ("(", "[") and c.partner[i] > i:
            depth_end = c.partner[i]
            continue
        if c.kind[i] == "sign" and c.word[i] in _ORDER:
            j = i + 1
            while j < hi and c.word[j] not in ("&&", "||", ";"):
                j = c.partner[j] + 1 if c.word[j] in ("(", "[") and c.partner[j] > j else j + 1
            bound = c.text(i + 1, j)
            zero = c.word[i] in ("!=", "==") and bound in ("0", "0x0", "NULL", "'\\0'")
            return bound or None, zero or (j - i == 2 and c.kind[i + 1] == "number")
    for i in range(lo, hi - 1):
        if c.kind[i] == "name" and c.word[i + 1] == "--":
            return c.word[i], False
        if c.word[i] == "--" and c.kind[i + 1] == "name":
            return c.word[i + 1], False
    return None, False


@dataclass
class Loop:
    line: int
    kind: str
    header: str
    bound: str | None
    constant: bool
    store: str | None = None
    index: str | None = None
    copy_dst: str | None = None
    copy_src: str | None = None
    body: str = ""
    last_line: int = 0
    braced: bool = False


def _store(c: Code, lo: int, assign: int, body_end: int) -> tuple[str, str] | None:
    """(target, what moves it on) of the store whose left side is ``lo:assign``, if it is one into memory."""
    w = c.word
    if w[assign - 1] == "]" and c.partner[assign - 1] > lo:
        k = c.partner[assign - 1]
        return c.text(lo, assign), c.text(k + 1, assign - 1)
    if w[lo] != "*":
        return None
    inner = [i for i in range(lo + 1, assign) if c.kind[i] == "name"]
    if "++" in w[lo:assign] or "--" in w[lo:assign]:
        name = w[inner[-1]] if inner else ""
        return c.text(lo, assign), name
    if w[assign - 1] == ")" and c.partner[assign - 1] > 0:
        k, e = c.partner[assign - 1], assign - 1
        plus = None
        i = k + 1
        while i < e:
            if w[i] in ("(", "[") and c.partner[i] > i:
                i = c.partner[i]
            elif w[i] in ("+", "-") and i > k + 1:
                plus = i
            i += 1
        if plus:
            return c.text(lo, assign), c.text(plus + 1, e)
        return None
    if len(inner) == 1 and assign - lo == 2:
        name = w[inner[0]]
        for i in range(assign, body_end - 1):
            if w[i] == name and (w[i + 1] in ("++", "--", "+=", "-=") or (w[i + 1] == "=" and name in w[i + 2 : i + 4])) or (w[i] in ("++", "--") and w[i + 1] == name):
                return c.text(lo, assign), name
    return None


def _copied(c: Code, lo: int, assign: int, hi: int) -> bool:
    """Whether ``lo:hi`` moves one element to another: ``a[i] = b[j]`` or ``*p = *q``, with or without steps."""
    w = c.word

    def plain(a: int, b: int) -> str | None:
        if b - a >= 4 and c.kind[a] == "name" and w[a + 1] == "[" and c.partner[a + 1] == b - 1:
            return "element"
        while a < b and w[a] == "(" and c.partner[a] > a and c.partner[a] < b - 1 and w[a] != "*":  # a cast before the value
            a = c.partner[a] + 1
        return "pointer" if a < b and w[a] == "*" else None

    left, right = plain(lo, assign), plain(assign + 1, hi)
    return left is not None and right is not None and w[assign] == "="


def loops(c: Code) -> list[Loop]:
    """All loops of a text with their bound, their first store whose place isn't a constant, and their first copy.

    A loop's body is what its brackets hold, however long; an inner loop's statements belong to the outer one too.
    """
    out = []
    stops = list(statements(c))
    starts = [s[0] for s in stops]
    for i, w in enumerate(c.word):
        if c.kind[i] != "name" or w not in ("for", "while", "do") or i + 1 >= len(c.word):
            continue
        if w == "do":
            if c.word[i + 1] != "{":
                continue
            lo, hi = _body(c, i + 1)
            head = (hi + 2, c.partner[hi + 2]) if hi + 2 < len(c.word) and c.word[hi + 1] == "while" and c.partner[hi + 2] > 0 else (hi, hi)
            head = (head[0] + 1, head[1]) if head[0] < head[1] else head
        else:
            if c.word[i + 1] != "(" or c.partner[i + 1] < 0:
                continue
            end = c.partner[i + 1]
            lo, hi = _body(c, end + 1)
            if w == "while" and lo < len(c.word) and c.word[lo] == ";":
                continue  # the end of a do loop, or an empty one
            head = (i + 2, end)
        cond = head
        if w == "for":
            cuts = [j for j in range(*head) if c.word[j] == ";"]
            cond = (cuts[0] + 1, cuts[1]) if len(cuts) == 2 else (head[1], head[1])
        bound, constant = bound_of(c, *cond)
        loop = Loop(c.line[i], w, c.text(*head), bound, constant, body=c.text(lo, hi), last_line=c.line[min(hi, len(c.word) - 1)], braced=lo > 0 and c.word[lo - 1] == "{")
        for k in range(bisect_right(starts, lo - 1), len(stops)):
            a, b, assign = stops[k]
            if a >= hi:
                break
            if assign < 0 or a == assign:
                continue
            if loop.copy_dst is None and _copied(c, a, assign, b):
                loop.copy_dst, loop.copy_src = c.text(a, assign), c.text(assign + 1, b)
            if loop.store is None:
                s = _store(c, a, assign, hi)
                if s and value_of(s[1].lstrip("-+ ")) is None:
                    loop.store, loop.index = s
        out.append(loop)
    return out


def pointer_parameters(c: Code) -> dict[str, list[str]]:
    """Of every function defined in the text the names of its parameters written with a star."""
    out: dict[str, list[str]] = {}
    for i, w in enumerate(c.word):
        k = c.partner[i]
        if w == "(" and i > 1 and k > 0 and k + 1 < len(c.word) and c.word[k + 1] == "{" and c.kind[i - 1] == "name" and c.word[i - 1] not in RESERVED:
            names = [c.word[j] for j in range(i + 1, k) if c.kind[j] == "name" and c.word[j - 1] == "*" and c.word[j + 1] in (",", ")")]
            out.setdefault(c.word[i - 1], names)
    return out


def arrays(c: Code) -> list[tuple[str, str]]:
    """(name, extent) of declared arrays: a type word, a name, a bracket with something in it, and no use of it."""
    out = []
    for i in range(1, len(c.word) - 2):
        if c.kind[i] == "name" and c.word[i + 1] == "[" and c.partner[i + 1] > i + 2 and c.kind[i - 1] == "name" and (c.word[i - 1] in WIDTHS or c.word[i - 1] in ("double", "float", "size_t")):
            out.append((c.word[i], c.text(i + 2, c.partner[i + 1])))
    return out


def pointer_stores(c: Code) -> list[tuple[int, str, str, bool]]:
    """Rows (line, base, form, own) of stores through a named pointer: ``deref`` (``*p =``, casts included), ``offset``
    (``*(T *)(p + 4) =``), ``element`` (``p[i] =``) or ``field`` (``p->f =``); own tells that the value is made of what
    the pointer already points at, as when a place is moved on."""
    out = []
    w = c.word
    for lo, hi, assign in statements(c):
        if assign < 0 or lo == assign:
            continue
        own = False
        if w[lo] == "*":
            i = lo + 1
            while i < assign and w[i] == "(" and c.partner[i] > 0 and w[c.partner[i] - 1] == "*":
                i = c.partner[i] + 1
            names = [j for j in range(i, assign) if c.kind[j] == "name" and w[j] not in RESERVED and w[j] not in WIDTHS]
            if not names:
                continue
            base = w[names[0]]
            form = "deref" if assign - i == 1 or (w[i] == "(" and c.partner[i] == assign - 1 and assign - i == 3) else "offset"
            own = form == "deref" and any(w[j] == base and w[j - 1] in ("*", ")") for j in range(assign + 1, hi)) and w[assign + 1] == "*"
            out.append((c.line[lo], base, form, own))
        elif c.kind[lo] == "name" and lo + 1 < assign and w[lo + 1] == "->":
            out.append((c.line[lo], w[lo], "field", False))
        elif c.kind[lo] == "name" and lo + 1 < assign and w[lo + 1] == "[" and c.partner[lo + 1] == assign - 1:
            out.append((c.line[lo], w[lo], "element", False))
    return out


def clamps(c: Code) -> list[tuple[int, str, str]]:
    """(line, variable, text) of values kept within a bound: ``v = min(v, b)``, ``v = v < b ? v : b`` and
    ``if (v > b) v = b``."""
    out = []
    w = c.word
    for lo, hi, assign in statements(c):
        if assign < 0 or assign - lo != 1 or c.kind[lo] != "name" or w[assign] != "=":
            continue
        v, value = w[lo], w[assign + 1 : hi]
        if not value:
            continue
        low = value[0].lower()
        called = len(value) > 3 and value[1] == "(" and (low in ("min", "max") or low.startswith("clamp"))
        if (called and v in value) or ("?" in value and v in value and any(x in _ORDER for x in value)):
            out.append((c.line[lo], v, c.text(lo, hi)))
            continue
        k = lo - 1 - (w[lo - 1] == "{")
        if k > 2 and w[k] == ")" and c.partner[k] > 0 and w[c.partner[k] - 1] == "if":
            a = c.partner[k]
            if w[a + 1] == v and w[a + 2] in (">", ">="):
                out.append((c.line[a], v, c.text(a - 1, hi)))
    return out


def field_uses(c: Code) -> list[tuple[int, str, str, str, str, bool]]:
    """Rows (line, kind, var, type, field, by_handle) of ``var->field`` and ``var->Instance->field`` where the text
    declares ``Type *var``; the first declaration of a name counts."""
    w = c.word
    types: dict[str, str] = {}
    for i in range(2, len(w) - 1):
        if c.kind[i] == "name" and w[i - 1] == "*" and c.kind[i - 2] == "name" and w[i - 2] not in RESERVED and w[i + 1] in (",", ";", ")", "="):
            types.setdefault(w[i], w[i - 2])
    out = []
    for lo, hi, assign in statements(c):
        for i in range(lo, hi - 2):
            if c.kind[i] != "name" or w[i] not in types or w[i + 1] != "->" or c.kind[i + 2] != "name" or (i > lo and w[i - 1] in ("->", ".")):
                continue
            handle = w[i + 2] == "Instance"
            if handle and not (i + 4 < hi and w[i + 3] == "->" and c.kind[i + 4] == "name"):
                continue
            kinds = ("load",) if assign < 0 or i > assign else ("load", "store") if w[assign] in COMPOUND else ("store",)
            out += [(c.line[i], k, w[i], types[w[i]], w[i + 4] if handle else w[i + 2], handle) for k in kinds]
    return out


def calls(c: Code, names: frozenset[str] | None = None) -> list[tuple[int, int, str, list[str]]]:
    """Rows (place, line, callee, arguments) of calls whose brackets close; of any name that isn't reserved, or of ``names``.
    Commas within brackets and quotes part no arguments."""
    out = []
    w = c.word
    for i in range(len(w) - 1):
        k = c.partner[i + 1]
        if c.kind[i] != "name" or w[i + 1] != "(" or k < 0 or (w[i] in RESERVED if names is None else w[i] not in names):
            continue
        args, lo, j = [], i + 2, i + 2
        while j < k:
            if w[j] in ("(", "[", "{") and c.kind[j] == "sign" and c.partner[j] > j:
                j = c.partner[j]
            elif w[j] == ",":
                args.append(c.text(lo, j))
                lo = j + 1
            j += 1
        if lo < k or args:
            args.append(c.text(lo, k))
        out.append((c.at[i], c.line[i], w[i], args))
    return out


def definitions(c: Code) -> list[tuple[int, str, str]]:
    """(line, name, text from the name to the closing brace) of the functions defined in a text."""
    out = []
    for i in range(1, len(c.word)):
        k = c.partner[i]
        if c.word[i] == "(" and k > 0 and k + 1 < len(c.word) and c.word[k + 1] == "{" and c.kind[i - 1] == "name" and c.word[i - 1] not in RESERVED:
            end = c.partner[k + 1] if c.partner[k + 1] > 0 else len(c.word) - 1
            out.append((c.line[i - 1], c.word[i - 1], c.source[c.at[i - 1] : c.end[end]]))
    return out


_EXITS = ("return", "goto", "break", "continue")


def guard_lines(c: Code) -> set[int]:
    """Lines on which something keeps a value in bounds: an ``if`` that compares by size with a number or leads to an exit, a
    call that takes the least or clamps, a choice between a number and something else."""
    out = set()
    w = c.word
    for i in range(len(w)):
        if w[i] == "if" and i + 1 < len(w) and w[i + 1] == "(" and c.partner[i + 1] > 0:
            end = c.partner[i + 1]
            sized = [j for j in range(i + 2, end) if c.kind[j] == "sign" and w[j] in ("<", "<=", ">", ">=")]
            then = end + 1 + (end + 1 < len(w) and w[end + 1] == "{")
            if any(c.kind[j + 1] == "number" for j in sized) or (sized and then < len(w) and w[then] in _EXITS):
                out.add(c.line[i])
        elif c.kind[i] == "name" and i + 1 < len(w) and w[i + 1] == "(" and (w[i].lower() in ("min", "fmin") or w[i].lower().startswith("clamp")):
            out.add(c.line[i])
        elif w[i] == "?" and i + 2 < len(w) and c.kind[i + 1] == "number" and w[i + 2] == ":":
            out.add(c.line[i])
    return out


def guarded_calls(c: Code, names: frozenset[str] | None = None, before: int = 10) -> list[tuple[int, int, str, list[str], bool]]:
    """:func:`calls`, and whether one of the ``before`` lines in front of each keeps a value in bounds."""
    lines = sorted(guard_lines(c))
    return [(*r, bisect_right(lines, r[1] - 1) > bisect_right(lines, r[1] - before - 1)) for r in calls(c, names)]


def reads_bounded_string(c: Code) -> bool:
    """Whether a text reads a string into a buffer with care: it loops up to a length less one, and ends the string with a
    zero at a place less one."""
    less_one = lambda x: x is not None and x.replace(" ", "").endswith(("-1", "+-1"))
    if not any(less_one(x.bound) for x in loops(c)):
        return False
    for lo, hi, assign in statements(c):
        if assign > lo and c.word[assign - 1] == "]" and c.partner[assign - 1] > lo and c.text(assign + 1, hi) in ("0", "0x0", "0x00", "'\\0'"):
            if less_one(c.text(c.partner[assign - 1] + 1, assign - 1)):
                return True
    return False
