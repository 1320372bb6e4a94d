"""Facts of JavaScript and TypeScript sources: a scanner, bracket matching and pattern rules over tokens.

No grammar is used; the rules read tokens, so comments, strings, templates and regular expressions do not
mislead them. What a source says twice is said twice here; queries remove repeats.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"\s*+(?:(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<id>[A-Za-z_$\u0080-￿][\w$\u0080-￿]*|#[A-Za-z_]\w*)|(?P<num>\d[\w.]*|\.\d[\w]*)"
    r"|(?P<str>'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?)|(?P<tick>`)"
    r"|(?P<op>=>|\.\.\.|\?\?=|\|\|=|&&=|\*\*=|>>>=|<<=|>>=|===|!==|\?\.|\?\?|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|.)|(?P<end>\Z))",
    re.DOTALL,
)
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: Of a template, what ends nothing.
PLAIN = re.compile(r"[^`\\$]+")
KEYWORDS = {
    "if", "for", "while", "switch", "catch", "function", "return", "await", "typeof", "new", "class", "super", "import", "require", "do", "else",
    "try", "finally", "throw", "delete", "void", "in", "of", "instanceof", "case", "default", "break", "continue", "yield", "async", "let", "const",
    "var", "export", "extends", "static", "get", "set", "this", "null", "true", "false", "undefined", "with", "debugger",
}
BEFORE_REGEX = {
    "return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "instanceof", "else", "do", "yield", "await",
}
DECLARING = {"function", "class", "let", "const", "var"}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "**=", "??=", "||=", "&&=", "<<=", ">>=", ">>>="}
# Timer, listener and promise calls; global names that are no variables of the project.
TIMING = {
    "setTimeout", "setInterval", "clearInterval", "clearTimeout", "addEventListener", "removeEventListener", "requestAnimationFrame",
    "cancelAnimationFrame", "fetch", "then", "catch", "finally",
}
GLOBALS = {
    "undefined", "null", "console", "window", "document", "module", "exports", "require", "process", "globalThis", "NaN", "Infinity", "Object",
    "Array", "String", "Number", "Boolean", "Promise", "Error", "JSON", "Math", "Date", "Map", "Set", "Symbol", "RegExp", "Proxy", "Reflect",
    "parseInt", "parseFloat", "isNaN", "isFinite", "encodeURIComponent", "decodeURIComponent", "setTimeout", "setInterval", "clearTimeout",
    "clearInterval", "requestAnimationFrame", "cancelAnimationFrame", "fetch", "alert", "confirm", "prompt",
}
# Operators that open, close or branch; words with which what a module has begins.
STRUCTURE = {"(", "[", "{", ")", "]", "}", "?", "&&", "||", "??"}
MODULE_WORDS = {"import", "require", "export", "module", "const", "let", "var"}
NEVER_READ = KEYWORDS | GLOBALS
MODULE, ANONYMOUS = "(module scope)", "(anonymous)"
SETTER = re.compile(r"(set|clear|reset|init)[A-Z]")


@dataclass(slots=True)
class Tok:
    kind: str
    text: str
    at: int


def scan(code: str) -> list[Tok]:
    """Tokens without blanks and comments. A template is a string token, then its expressions' tokens in parentheses."""
    out: tuple[list, list, list] = ([], [], [])
    _scan(code, 0, *out)
    return [Tok(*t) for t in zip(*out, strict=True)]


def _scan(code: str, base: int, kinds: list[str], texts: list[str], ats: list[int]) -> None:
    """Adds the tokens of a text that begins at base, a list for each of their fields: a source has many tokens, and lists are read faster than objects."""
    add_kind, add_text, add_at = kinds.append, texts.append, ats.append
    i, n = 0, len(code)
    while i < n:
        for m in TOKEN.finditer(code, i):  # a match begins where the last one ended, until something else than a pattern says where to go on
            kind = m.lastgroup
            if kind == "comment" or kind == "end":
                continue
            i, text = m.start(kind), m[kind]
            if kind == "tick":
                i = _template(code, i, base, kinds, texts, ats)
                break
            if text == "/" or text == "/=":
                if (not kinds or kinds[-1] == "op" and texts[-1] not in (")", "]", "}") or texts[-1] in BEFORE_REGEX) and (r := REGEX.match(code, i)):
                    add_kind("str")
                    add_text(r[0])
                    add_at(base + i)
                    i = r.end()
                    break
            add_kind(kind)
            add_text(text)
            add_at(base + i)
        else:
            break


def _template(code: str, i: int, base: int, kinds: list[str], texts: list[str], ats: list[int]) -> int:
    """Adds the tokens of the template that begins at i; where it ends."""
    n, j, parts = len(code), i + 1, []
    while j < n and code[j] != "`":
        if code[j] == "\\":
            j += 2
        elif code.startswith("${", j):
            k, depth = j + 2, 1
            while k < n and depth:
                if code[k] in "'\"":  # braces in strings do not count
                    k = TOKEN.match(code, k).end()
                    continue
                depth += {"{": 1, "}": -1}.get(code[k], 0)
                k += 1
            parts.append((j + 2, k - 1))
            j = k
        elif m := PLAIN.match(code, j):
            j = m.end()
        else:
            j += 1
    kinds.append("str")
    texts.append(code[i : j + 1])
    ats.append(base + i)
    for a, b in parts:
        kinds += "op", "op"
        texts += "+", "("
        ats += base + a, base + a
        inside: tuple[list, list, list] = ([], [], [])  # what stands before the expression does not tell what a slash in it is
        _scan(code[a:b], base + a, *inside)
        kinds += [*inside[0], "op"]
        texts += [*inside[1], ")"]
        ats += [*inside[2], base + b]
    return j + 1


@dataclass
class Fn:
    name: str
    params: list[str]
    head: int
    start: int
    end: int
    is_async: bool
    owner: str = ""
    parent: int = -1
    binds: dict[str, tuple[str, int]] = field(default_factory=dict)


class Source:
    """One source's tokens, brackets and functions, and the facts taken from them."""

    def __init__(self, code: str, bindings: bool = True, branches: bool = True):
        self.code = code
        self.kinds: list[str] = []  # of each token
        self.texts: list[str] = []
        ats: list[int] = []
        _scan(code, 0, self.kinds, self.texts, ats)
        self.n = len(self.texts)
        self.lines: list[int] = []  # of each token; tokens come in the order of the text
        add_line, end = self.lines.append, len(code)
        n, line_end = 1, code.find("\n") % (end + 1)
        for at in ats:
            while line_end < at:
                n, line_end = n + 1, code.find("\n", line_end + 1) % (end + 1)
            add_line(n)
        self.pair: dict[int, int] = {}
        self.marks: list[int] = []  # brackets and operators that branch
        self.around: list[int] = []  # the bracket that is open after each of them
        self.branch: list[int] = []  # the last operator that branches then, within that bracket
        stack, last = [-1], [-1]
        for i in [i for i, x in enumerate(self.texts) if x in STRUCTURE]:
            text = self.texts[i]
            if text in "([{":
                stack.append(i)
                last.append(-1)
            elif text in ")]}":
                if len(stack) > 1:
                    self.pair[stack[-1]] = i
                    self.pair[i] = stack.pop()
                    last.pop()
            else:
                last[-1] = i
            if branches:
                self.marks.append(i)
                self.around.append(stack[-1])
                self.branch.append(last[-1])
        self.unmatched = len(stack) - 1
        self.fns = self._functions()
        self.by_head = sorted((f.head, k) for k, f in enumerate(self.fns))
        self._nest()
        if bindings:
            self._bindings()

    def line(self, i: int) -> int:
        return self.lines[i]

    def text(self, i: int) -> str:
        return self.texts[i] if 0 <= i < self.n else ""

    def is_id(self, i: int) -> bool:
        return 0 <= i < self.n and self.kinds[i] == "id"

    # Functions and classes

    def _names_in(self, a: int, b: int) -> list[str]:
        """Names that a parameter list or pattern binds: not property keys, default values or types."""
        out, i, skip = [], a, False
        while i < b:
            kind, word = self.kinds[i], self.texts[i]
            if word in ("=", ":") and kind == "op" and not (word == ":" and self.text(i + 1) in ("{", "[")):
                if word == ":" and self.is_id(i + 1) and self.text(i + 2) in (",", "}", "="):
                    out[-1:] = []
                else:
                    skip = True
            elif word == "," and kind == "op":
                skip = False
            elif skip and word in ("(", "{", "[") and i in self.pair:
                i = self.pair[i]
            elif word in ("}", "]"):
                skip = False
            elif kind == "id" and not skip and word not in KEYWORDS and not (self.text(i + 1) == ":" and self.text(i + 2) in ("{", "[")):
                out.append(word)
            i += 1
        return out

    def _body(self, i: int) -> tuple[int, int] | None:
        """The braces that start at i, past a return type."""
        j = i
        while j < self.n and self.text(j) != "{" and j < i + 40:
            if self.text(j) in (";", ")", "=", ",", "}"):
                return None
            j = self.pair.get(j, j) + 1 if self.text(j) in ("(", "[") else j + 1
        return (j, self.pair[j]) if self.text(j) == "{" and j in self.pair else None

    def _expression_end(self, i: int) -> int:
        depth_end = self.n - 1
        j = i
        while j <= depth_end:
            t = self.text(j)
            if t in ("(", "[", "{") and self.kinds[j] == "op":
                j = self.pair.get(j, depth_end)
            elif t in (")", "]", "}", ",", ";"):
                return j - 1
            j += 1
        return depth_end

    def _named_before(self, i: int) -> str:
        """The name that an expression at i is assigned to, if it is."""
        j = i - 1
        if self.text(j) == "async":
            j -= 1
        if self.text(j) in ("=", ":") and self.is_id(j - 1) and self.text(j - 1) not in KEYWORDS:
            return self.text(j - 1)
        while j > 0 and self.text(j) != "=" and self.text(j) not in (";", "{", "}", "(", ","):
            j -= 1
        return ""

    def _functions(self) -> list[Fn]:
        out: list[Fn] = []
        self.classes: list[tuple[str, int, int]] = []
        taken: set[int] = set()
        texts = self.texts
        for i in [i for i, x in enumerate(texts) if x == "class"]:
            if self.kinds[i] == "id" and self.text(i - 1) != ".":
                name = self.text(i + 1) if self.is_id(i + 1) and self.text(i + 1) not in ("extends", "implements") else self._named_before(i)
                j = i + 1
                while j < self.n and self.text(j) != "{":
                    j += 1
                if j in self.pair:
                    self.classes.append((name or ANONYMOUS, j, self.pair[j]))
        members = {}
        for name, a, b in self.classes:
            i = a + 1
            while i < b:
                if self.text(i) in ("(", "[", "{") and i in self.pair:
                    i = self.pair[i]
                elif self.is_id(i) and self.text(i + 1) == "(" and self.text(i) not in ("if", "for", "while", "switch", "catch"):
                    members[i] = name
                    i = self.pair.get(i + 1, i)
                    continue
                i += 1
        for i in [i for i, (x, y) in enumerate(zip(texts, [*texts[1:], ""], strict=False)) if y == "(" or x == "function" or x == "=>"]:  # members have a bracket, too
            kind, word = self.kinds[i], self.texts[i]
            if kind == "id" and word == "function" and self.text(i - 1) != ".":
                j = i + 1 + (self.text(i + 1) == "*")
                name = self.text(j) if self.is_id(j) else self._named_before(i)
                j += self.is_id(j)
                if self.text(j) == "(" and j in self.pair and (b := self._body(self.pair[j] + 1)):
                    out.append(Fn(name or ANONYMOUS, self._names_in(j + 1, self.pair[j]), i, *b, self.text(i - 1) == "async"))
                    taken.add(b[0])
            elif word == "=>" and kind == "op":
                if self.text(i - 1) == ")":
                    a = self.pair.get(i - 1, i - 1)
                    params = self._names_in(a + 1, i - 1)
                else:
                    a, params = i - 1, [self.text(i - 1)]
                head = a - (self.text(a - 1) == "async")
                b = (i + 1, self.pair[i + 1]) if self.text(i + 1) == "{" and i + 1 in self.pair else (i, self._expression_end(i + 1))
                out.append(Fn(self._named_before(a) or ANONYMOUS, params, head, *b, self.text(a - 1) == "async"))
                taken.add(b[0])
            elif kind == "id" and self.text(i + 1) == "(" and word not in KEYWORDS - {"get", "set", "static", "async"} and self.text(i - 1) not in (".", "?.", "new", "function", "*") or i in members:
                j = self.pair.get(i + 1)
                if j and (b := self._body(j + 1)) and b[0] not in taken and (i in members or self.text(j + 1) == "{" and self.text(i - 1) in ("{", ",", "async", "get", "set")):
                    out.append(Fn(word, self._names_in(i + 2, j), i, *b, self.text(i - 1) == "async", members.get(i, "")))
                    taken.add(b[0])
        return sorted(out, key=lambda f: (f.start, -f.end))

    def _nest(self) -> None:
        self.inside = [-1] * self.n
        stack: list[int] = []
        opens: dict[int, list[int]] = {}
        for k, f in enumerate(self.fns):
            opens.setdefault(f.start, []).append(k)
        starts = list(opens)  # functions come in the order of their starts
        i, n = 0, self.n
        while i < n:
            while stack and self.fns[stack[-1]].end < i:
                stack.pop()
            for k in opens.get(i, ()):
                self.fns[k].parent = stack[-1] if stack else -1
                stack.append(k)
            j = bisect.bisect_right(starts, i)  # nothing changes before the next function begins or this one ends
            after = min(starts[j] if j < len(starts) else n, max(self.fns[stack[-1]].end, i) + 1 if stack else n, n)
            self.inside[i:after] = [stack[-1] if stack else -1] * (after - i)
            i = after
        self.names: list[str] = []  # of each function, or of the first one around it that has a name
        for f in self.fns:  # outer ones come first
            self.names.append(self.names[f.parent] if f.name == ANONYMOUS and f.parent >= 0 else f.name)

    def heads_in(self, a: int, b: int) -> list[Fn]:
        """Functions that begin after token a and up to b, outer ones first."""
        i, j = bisect.bisect_right(self.by_head, (a, 1 << 60)), bisect.bisect_right(self.by_head, (b, 1 << 60))
        return [self.fns[k] for k in sorted(k for _, k in self.by_head[i:j])]

    def commas(self, a: int, b: int) -> list[int]:
        """Commas between tokens a and b that no bracket in between encloses."""
        out = []
        while a < b:
            if self.text(a) == ",":
                out.append(a)
            a = self.pair[a] + 1 if self.kinds[a] == "op" and self.text(a) in ("(", "[", "{") and a in self.pair else a + 1
        return out

    def fn_name(self, i: int) -> str:
        k = self.inside[i]
        return MODULE if k < 0 else self.names[k]

    def _bindings(self) -> None:
        self.module: dict[str, tuple[str, int]] = {}
        self.declared: set[int] = set()  # tokens that declare
        put = lambda k, name, kind, line: (self.module if k < 0 else self.fns[k].binds).setdefault(name, (kind, line))
        for f in self.fns:
            for p in f.params:
                f.binds[p] = ("param", self.line(f.head))
            if f.name != ANONYMOUS and not f.owner and self.text(f.head) == "function":
                put(f.parent, f.name, "hoisted" if f.parent >= 0 else "module", self.line(f.head))
        for i in [i for i, x in enumerate(self.texts) if x == "let" or x == "const" or x == "var"]:
            kind, word = self.kinds[i], self.texts[i]
            if kind == "id" and self.text(i - 1) != ".":
                j = i + 1
                while True:
                    if self.text(j) in ("{", "[") and j in self.pair:
                        names = [(n, j) for n in self._names_in(j + 1, self.pair[j])]
                        self.declared.update(range(j, self.pair[j] + 1))
                        j = self.pair[j]
                    else:
                        names = [(self.text(j), j)] if self.is_id(j) else []
                        self.declared.add(j)
                    for n, at in names:
                        put(self.inside[i], n, "module" if self.inside[i] < 0 else "let" if word != "var" else "var", self.line(at))
                        if self.inside[i] < 0:
                            self.module_kinds[n] = word
                    j += 1
                    end = self._expression_end(j) if self.text(j) in ("=", ":") else j - 1
                    if self.text(end + 1) != ",":
                        break
                    j = end + 2

    module_kinds: dict[str, str]
    module_words: set[int]  # tokens of import declarations

    # Calls and accesses

    def chain(self, i: int) -> tuple[int, str]:
        """Where the member chain that ends at i starts, and its dotted name of up to four parts."""
        parts, j = [self.text(i)], i
        while self.text(j - 1) in (".", "?."):
            k = j - 2
            if self.text(k) in (")", "]") and k in self.pair:
                k = self.pair[k] - 1
                if not self.is_id(k):
                    return self.pair.get(j - 2, k), ".".join(parts[::-1][-4:])
            if not (self.is_id(k) or self.text(k) == "this"):
                break
            parts.append(self.text(k))
            j = k
        return j, ".".join(parts[::-1][-4:])

    def awaited(self, start: int) -> bool:
        j = start - 1
        while self.text(j) in ("(", "!", "new", "..."):
            j -= 1
        return self.text(j) in ("await", "return", "yield")

    def conditional(self, i: int) -> bool:
        """Inside a branch of its function: the nearest braces that follow a branching keyword."""
        f = self.inside[i]
        low, at = self.fns[f].start if f >= 0 else -1, i
        while True:  # outwards by brackets, so a long function is not read again for each of its writes
            k = bisect.bisect_left(self.marks, i) - 1
            j, i = (self.branch[k], self.around[k]) if k >= 0 else (-1, -1)
            if j > low and self.lines[j] == self.lines[at]:
                return True
            if i <= low:
                return False
            if self.texts[i] == "{":
                k = i - 1
                if self.text(k) == ")":
                    k = self.pair.get(k, k) - 1
                if self.text(k) in ("if", "else", "case", "try", "catch", "switch", "for", "while"):
                    return True


def _unquote(s: str) -> str:
    return s[1:-1] if len(s) >= 2 and s[0] in "'\"`" else s


# Kinds of facts by the step that finds them.
ACCESSES, STATEMENTS, SCOPES = {"access", "use", "comparison"}, {"statement"}, {"scope", "binding", "module_let"}
CALLS = {"call", "timing", "listener", "callback", "loop", "hook"}


def extract(code: str, kinds: frozenset[str] | None = None) -> list[tuple[str, dict]]:
    """(fact, fields) rows of one source; with kinds of these alone, and steps that none of them needs are left out."""
    wanted = lambda of: kinds is None or bool(kinds & of)
    s = Source.__new__(Source)
    s.module_kinds, s.module_words = {}, set()
    s.__init__(code, wanted(ACCESSES | STATEMENTS | SCOPES), wanted(ACCESSES))
    out: list[tuple[str, dict]] = []

    def add(fact: str, **f) -> None:
        if kinds is None or fact in kinds:
            out.append((fact, f))

    n = s.n
    for f in s.fns:
        if f.name != ANONYMOUS:
            add("function", name=f.name, line=s.line(f.head), line_end=s.line(f.end), is_async=f.is_async, owner=f.owner)
    for name, a, b in s.classes:
        add("class", name=name, line=s.line(a), line_end=s.line(b))
    if wanted(SCOPES):
        _scopes(s, add, wanted({"scope", "binding"}))
    _modules(s, add)
    if wanted(ACCESSES):
        _accesses(s, add)
    if wanted(CALLS):
        only = not wanted(CALLS - {"call"})
        heads = {f.head for f in s.fns}
        for i in [i for i, x in enumerate(s.texts[1:]) if x == "("]:
            kind, word = s.kinds[i], s.texts[i]
            if kind == "id" and (word not in KEYWORDS or s.text(i - 1) in (".", "?.")) and s.text(i - 1) != "function" and i not in heads:
                _call(s, i, add, only)
    if wanted(STATEMENTS):
        lets = {v for v, kind in s.module_kinds.items() if kind in ("let", "var")}
        setters = {g.name for g in s.fns if g.parent < 0 and g.name != ANONYMOUS and SETTER.match(g.name)}
        for k, f in enumerate(s.fns):
            if s.text(f.start) == "{" and f.name != ANONYMOUS:
                _statements(s, k, lets, setters, add)
    add("parse", n_tokens=n, errors=s.unmatched)
    return out


def _scopes(s: Source, add, bindings: bool) -> None:
    for k, f in enumerate(s.fns) if bindings else ():
        add("scope", scope_id=k, parent_id=f.parent, fn=f.name)
        for name, (kind, line) in f.binds.items():
            add("binding", scope_id=k, name=name, kind=kind, line=line)
    for name, (kind, line) in s.module.items():
        add("binding", scope_id=-1, name=name, kind=kind, line=line)
        if s.module_kinds.get(name) in ("let", "var"):
            add("module_let", var=name, line=line)


def _accesses(s: Source, add) -> None:
    reads: set[tuple] = set()
    heads = {f.head for f in s.fns}
    named = heads | {i for f in s.fns for i in range(f.head, f.start) if s.text(i) in f.params} | s.module_words
    texts = [*s.texts, ""]
    for i, (kind, word) in enumerate(zip(s.kinds, s.texts, strict=True)):
        if kind == "op" and word in ASSIGN and i:
            j = i - 1
            if s.text(j) in ("]", "}") and j in s.pair and s.text(s.pair[j]) in ("[", "{") and not s.is_id(s.pair[j] - 1) and j not in s.declared and word == "=" and s.text(s.pair[j] - 1) in (";", "(", "{", "}", ""):
                for name in s._names_in(s.pair[j] + 1, j):
                    add("access", var=name, kind="write", fn=s.fn_name(i), line=s.line(j), write_type="reassigned", conditional=s.conditional(i), computed=False)
            elif s.text(j) == "]" and j in s.pair and s.is_id(s.pair[j] - 1) and s.text(s.pair[j] - 1) not in KEYWORDS:
                _, name = s.chain(s.pair[j] - 1)
                add("access", var=f"{name}[]", kind="write", fn=s.fn_name(i), line=s.line(i), write_type="written", conditional=s.conditional(i), computed=True)
            elif s.is_id(j) and s.text(j) not in KEYWORDS and not (s.text(j - 1) in ("{", ",") and s.inside[i] >= 0 and i < s.fns[s.inside[i]].start):
                _, name = s.chain(j)
                if j not in s.declared:
                    add("access", var=name, kind="write", fn=s.fn_name(i), line=s.line(j), write_type="reassigned" if "." not in name else "written", conditional=s.conditional(i), computed=False)
        elif kind == "op":
            if word in ("++", "--"):
                j = i - 1 if s.is_id(i - 1) else i + 1
                if s.is_id(j):
                    while s.text(j + 1) in (".", "?.") and s.is_id(j + 2):
                        j += 2
                    add("access", var=s.chain(j)[1], kind="write", fn=s.fn_name(i), line=s.line(j), write_type="reassigned", conditional=s.conditional(i), computed=False)
            elif word in ("<", ">") and s.inside[i] >= 0:
                add("comparison", fn=s.fn_name(i), line=s.line(i), op=word)
        elif kind == "id":
            if word in NEVER_READ:
                continue
            before, then = texts[i - 1], texts[i + 1]
            if before == "." or before == "?." or before in DECLARING or i in s.declared or i in named:
                continue
            key_like = then == ":" and before in ("{", ",")
            if not key_like and then != "=":
                r = (word, s.fn_name(i), s.lines[i])
                if r not in reads:
                    reads.add(r)
                    add("access", var=word, kind="read", fn=r[1], line=r[2], write_type=None, conditional=False, computed=False)
                    add("use", scope_id=s.inside[i], fn=r[1], name=word)


def _call(s: Source, i: int, add, only: bool = False) -> None:
    """The facts of a call, or the call alone."""
    start, name = s.chain(i)
    receiver = name.rpartition(".")[0] or (s.text(start) if start < i and s.is_id(start) else None) or None
    line, fn, close = s.line(i), s.fn_name(i), s.pair.get(i + 1, i + 1)
    awaited = s.awaited(start)
    new = s.text(start - 1) == "new"
    callee = s.text(i)
    if new:
        return
    add("call", callee=callee, receiver=receiver, line=line, fn=fn, is_awaited=awaited, statement=s.text(start - 1) in (";", "{", "}", "") or s.line(start - 1) < s.line(start) if start else True)
    if only:
        return
    first = i + 2
    arg = s.text(first) if s.is_id(first) and s.text(first + 1) in (",", ")") else None
    if callee in TIMING:
        event = _unquote(s.text(first)) if callee.endswith("EventListener") and first < s.n and s.kinds[first] == "str" else None
        comma = next(iter(s.commas(first, close)), None)
        handler = s.text(comma + 1) if event is not None and comma and s.is_id(comma + 1) else arg
        inner = next((f.name for f in s.heads_in(i, close)), None)
        add("timing", api=f'{callee}("{event}")' if event is not None else callee, callback=handler if handler and handler not in KEYWORDS else inner, line=line, fn=fn, is_awaited=awaited)
        if event is not None:
            words = s.texts[comma + 2 : close] if comma else []
            flag = lambda w: next((words[k + 2] == "true" for k in range(len(words) - 2) if words[k] == w and words[k + 1] == ":"), None)
            bare = words[1] == "true" if len(words) >= 2 and words[0] == "," and words[1] in ("true", "false") else None
            add("listener", added=callee.startswith("add"), event=event, handler=handler or ANONYMOUS, line=line, capture=flag("capture") if bare is None else bare, passive=flag("passive"), has_options=bool(words))
    inner = [f for f in s.heads_in(i, close) if f.parent == s.inside[i]]
    if inner:
        add("callback", method=callee, is_async=inner[0].is_async, fn=fn, line=line)
        if callee == "forEach" and receiver:
            name = s.fn_name(inner[0].start)
            add("loop", line=line, collection=receiver, callback=name)
    elif callee == "forEach" and receiver and arg:
        add("loop", line=line, collection=receiver, callback=arg)
    if re.fullmatch(r"use[A-Z]\w*", callee):
        commas = s.commas(first, close)
        deps = None
        if commas and s.text(commas[0] + 1) == "[":
            deps = [s.texts[k] for k in range(commas[0] + 2, s.pair.get(commas[0] + 1, commas[0] + 2)) if s.kinds[k] == "id"]
        tail = s.texts[first:close]
        body = set(tail)
        cleanup = any(a == "return" and b in ("(", "function", "async") or a == "return" and "=>" in tail[k : k + 4] for k, (a, b) in enumerate(zip(tail, tail[1:], strict=False)))
        add("hook", hook=callee, line=line, n_args=len(commas) + (first < close), has_timing=bool(body & TIMING), has_await="await" in body, has_cleanup=cleanup, deps=deps)


def _modules(s: Source, add) -> None:
    words_at = [i for i, x in enumerate(s.texts) if x in MODULE_WORDS]
    for i in words_at:
        kind, word = s.kinds[i], s.texts[i]
        if kind != "id" or s.text(i - 1) == ".":
            continue
        if word == "import" and s.inside[i] < 0 and s.text(i + 1) != "(":
            j = i + 1
            while j < s.n and s.kinds[j] != "str" and s.text(j) != ";":
                j += 1
            source = _unquote(s.text(j))
            s.module_words.update(range(i, j))
            add("import_source", source=source)
            words = s.texts[i + 1 : j]
            if "{" in words:
                inner = words[words.index("{") + 1 : words.index("}") if "}" in words else None]
                for spec in " ".join(inner).split(","):
                    w = [x for x in spec.split() if x != "type"]
                    if w:
                        add("import", local_name=w[-1], original_name=w[0], source=source, line=s.line(i))
            if words and words[0] not in ("{", "*", "type"):
                add("import", local_name=words[0], original_name="default", source=source, line=s.line(i))
            if "*" in words and "as" in words:
                add("import", local_name=words[words.index("as") + 1], original_name="*", source=source, line=s.line(i))
        elif word in ("require", "import") and s.text(i + 1) == "(" and i + 2 < s.n and s.kinds[i + 2] == "str":
            source = _unquote(s.text(i + 2))
            add("import_source", source=source)
            if s.text(i - 1) == "=" and s.is_id(i - 2):
                add("import", local_name=s.text(i - 2), original_name="*", source=source, line=s.line(i))
            elif s.text(i - 1) == "=" and s.text(i - 2) == "}" and i - 2 in s.pair:
                for name in s._names_in(s.pair[i - 2] + 1, i - 2):
                    add("import", local_name=name, original_name=name, source=source, line=s.line(i))
        elif word == "export":
            j = i + 1
            default = s.text(j) == "default"
            j += default
            while s.text(j) in ("async", "abstract", "declare"):
                j += 1
            if s.text(j) in ("const", "let", "var", "function", "class", "interface", "type", "enum"):
                j += 1 + (s.text(j + 1) == "*")
                if s.is_id(j):
                    add("export", name=s.text(j), line=s.line(i), is_default=default)
            elif s.text(j) == "{" and j in s.pair:
                for spec in " ".join(s.texts[j + 1 : s.pair[j]]).split(","):
                    if spec.split():
                        add("export", name=spec.split()[-1], line=s.line(i), is_default=False)
                if s.text(s.pair[j] + 1) == "from":
                    add("import_source", source=_unquote(s.text(s.pair[j] + 2)))
            elif s.text(j) == "*" and "from" in (s.text(j + 1), s.text(j + 3)):
                add("import_source", source=_unquote(s.text(j + 2 if s.text(j + 1) == "from" else j + 4)))
            elif default:
                add("export", name=s.text(j) if s.is_id(j) else "default", line=s.line(i), is_default=True)
        elif word == "module" and s.text(i + 1) == "." and s.text(i + 2) == "exports" and s.text(i + 3) == "=":
            if s.text(i + 4) == "{" and i + 4 in s.pair:
                depth = 0
                for k in range(i + 5, s.pair[i + 4]):
                    depth += {"{": 1, "(": 1, "[": 1, "}": -1, ")": -1, "]": -1}.get(s.text(k), 0)
                    if depth == 0 and s.is_id(k) and s.text(k - 1) in ("{", ","):
                        add("export", name=s.text(k), line=s.line(k), is_default=False)
            elif s.is_id(i + 4):
                add("export", name=s.text(i + 4), line=s.line(i), is_default=True)
        elif word in ("const", "let", "var") and s.inside[i] < 0 and s.is_id(i + 1) and s.text(i + 2) == "=":
            j = i + 3
            if s.text(j) == "new" and s.text(j + 2) == "(" and j + 2 in s.pair:
                args = " ".join(s.texts[j + 3 : s.pair[j + 2]]).split(",")
                for k, a in enumerate(args):
                    if re.fullmatch(r"\s*[A-Za-z_$][\w$]*\s*", a):
                        add("new_expr", instance=s.text(i + 1), **{"class": s.text(j + 1)}, arg=a.strip(), arg_idx=k, line=s.line(i))
            elif word == "const" and s.is_id(j) and s.text(j + 1) == "(" and s.text(j) not in ("require", "import", "function", "await", "async"):
                add("call_expr", local_var=s.text(i + 1), callee=s.text(j), line=s.line(i))
            if s.text(j) in ("new", "{", "[", "(") or s.text(j + 1) == "=>":
                add("declarator", name=s.text(i + 1), unstable=True)
    for i in words_at:
        kind, word = s.kinds[i], s.texts[i]
        if kind == "id" and word in ("const", "let", "var") and s.inside[i] >= 0 and s.is_id(i + 1) and s.text(i + 2) == "=" and (s.text(i + 3) in ("new", "{", "[") or s.text(i + 3) == "(" and "=>" in (s.text(s.pair.get(i + 3, i) + 1),)):
            add("declarator", name=s.text(i + 1), unstable=True)
        if kind == "id" and word in ("const", "let", "var") and s.text(i + 1) == "[" and i + 1 in s.pair and s.text(s.pair[i + 1] + 1) == "=" and s.text(s.pair[i + 1] + 2) in ("useState", "useReducer", "React"):
            add("state_var", var=s.text(i + 2))
    for f in s.fns:
        if f.name == "constructor" and f.owner:
            for i in range(f.start, f.end):
                if s.text(i) == "this" and s.text(i + 1) == "." and s.text(i + 3) == "=" and s.text(i + 4) in f.params and s.text(i + 5) in (";", "}", "") or s.text(i) == "this" and s.text(i + 1) == "." and s.text(i + 3) == "=" and s.text(i + 4) in f.params and s.line(i + 5) > s.line(i + 4):
                    add("class_capture", **{"class": f.owner}, field=s.text(i + 2), param_idx=f.params.index(s.text(i + 4)), param=s.text(i + 4))


def _statements(s: Source, k: int, lets: set[str], setters: set[str], add) -> None:
    """The statements of a function's block, those of try blocks among them, with what they write of the module (its lets and setters) and where they await."""
    f = s.fns[k]
    stmts: list[tuple[int, int]] = []

    def split(a: int, b: int) -> None:
        i = first = a
        while i < b:
            t = s.text(i)
            if t == "try" and i == first and s.text(i + 1) == "{" and i + 1 in s.pair:
                split(i + 2, s.pair[i + 1])
                i = first = s.pair[i + 1] + 1
                continue
            if t in ("(", "[", "{") and i in s.pair and s.kinds[i] == "op":
                end = s.pair[i]
                block = t == "{" and s.text(i - 1) in (")", "else", "finally", "{", "}", ";")
                i = end
                if block and s.text(i + 1) not in ("else", "catch", "finally", ",", ")", ".", ";"):
                    stmts.append((first, i))
                    i = first = i + 1
                    continue
            elif t == ";":
                stmts.append((first, i))
                first = i + 1
            elif i > first and s.line(i) > s.line(i - 1) and s.text(i - 1) not in (",", "=", "+", "(", "{", "&&", "||", ".", "=>", "?", ":") and s.kinds[i] == "id" and s.kinds[i - 1] != "op" or i > first and s.line(i) > s.line(i - 1) and s.text(i - 1) in (")", "]", "}") and s.kinds[i] == "id" and s.text(i) not in ("else", "catch", "finally"):
                stmts.append((first, i - 1))
                first = i
                continue
            i += 1
        if first < b:
            stmts.append((first, b - 1))

    split(f.start + 1, f.end)
    idx = 0
    for a, b in stmts:
        awaits = [i for i in range(a, b + 1) if s.texts[i] == "await" and s.inside[i] == k]
        await_line = s.line(awaits[0]) if awaits else None
        subjects = []
        for i in range(a, b + 1):
            if s.inside[i] != k or s.kinds[i] != "id":
                continue
            root, then = s.texts[i], s.text(i + 1)
            if then != "(" and then not in ASSIGN or s.text(i - 1) in (".", "?."):
                continue
            if then != "(":
                if root in lets and root not in f.binds and i not in s.declared:
                    subjects.append((root, "variable", i))
            elif root in setters and root != f.name:
                subjects.append((root, "local setter", i))
            elif SETTER.match(root) and root not in s.module and root not in GLOBALS:
                subjects.append((root, "imported setter", i))
        if not subjects:
            add("statement", block_id=f"{f.name}:{s.line(f.head)}", stmt_idx=idx, write_subject=None, write_kind=None, line=s.line(a), await_line=await_line)
        for name, kind, i in subjects:
            later = bisect.bisect_left(awaits, i)
            add("statement", block_id=f"{f.name}:{s.line(f.head)}", stmt_idx=idx, write_subject=name, write_kind=kind, line=s.line(i), await_line=s.line(awaits[later]) if later < len(awaits) else await_line)
        idx += 1
