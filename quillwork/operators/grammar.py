"""Functions of brace and ``end`` languages by an island grammar: heads, scopes and branches; the rest is water.

A file is cut into tokens by one pattern a language (comments, strings in all their forms, script regular
expressions, words, signs), then walked once with a stack of open scopes. A scope knows what it is (body of a
function, type, object, match, select, macro, block), heads put their function on the scope that opens next, and a
branch counts for every function that is open. Tokens carry their line, so nothing is scanned twice.

Which nodes count as functions and branches of a language are fixed values: see BRANCHES and the notes in
the heads. Only what counts there is told apart; code that doesn't balance ends its functions where the file ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

# Words that count as a branch, by language. Case labels, arms, closures and conditional
# expressions are signs and are told apart in Walk.sign.
BRANCHES = {
    "rust": {"if", "else", "while", "loop", "for"},
    "javascript": {"if", "else", "for", "while", "do", "case", "catch"},
    "typescript": {"if", "else", "for", "while", "do", "case", "catch"},
    "go": {"if", "for", "select"},
    "c": set(),
    "cpp": set(),
    "csharp": {"if", "for", "foreach", "while", "switch"},
    "java": {"if", "for", "while", "case", "default"},
    "php": {"if", "else", "for", "foreach", "while", "switch", "case"},
    "swift": {"if", "guard", "for", "while", "repeat"},
    "kotlin": {"if", "else", "for", "while", "do"},
    "solidity": {"if", "else", "for", "while", "do"},
    "ruby": {"if", "elsif", "unless", "case", "for", "while", "until", "rescue", "ensure", "lambda"},
}
#: Languages where a do (or repeat) loop counts by itself, so that the while at its end doesn't.
LOOP_ENDS = {"javascript": "do", "typescript": "do", "swift": "repeat", "kotlin": "do", "solidity": "do", "java": "do", "csharp": "do", "php": "do"}
NESTED_COMMENTS = ("rust", "swift", "kotlin")
TYPES = ("class", "struct", "interface", "enum", "record", "trait", "contract", "library", "protocol", "extension", "namespace", "object", "impl", "mod", "module", "extern")
NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "new", "else", "do", "function", "throw", "await", "sizeof", "foreach", "using", "lock", "fixed", "super", "this", "base", "case", "typeof", "delete", "in", "of", "when"}
_MODIFIERS = {"rust": ("pub", "async", "unsafe", "const", "extern", "default", "crate"), "swift": ("public", "private", "internal", "open", "fileprivate", "static", "override", "mutating", "final", "class"), "kotlin": ("public", "private", "internal", "protected", "override", "suspend", "inline", "open", "tailrec", "operator", "infix"), "javascript": ("async",), "typescript": ("async",)}

_STRING, _CHAR = r'"(?:\\[\s\S]|[^"\\])*"', r"'(?:\\[\s\S]|[^'\\\n])*'"
_LINE_STRING = r'"(?:\\.|[^"\\\n])*"'
_SLASHES, _BLOCK = r"//[^\n]*", r"/\*[\s\S]*?(?:\*/|\Z)"
_TRIPLE = r'"""[\s\S]*?(?:"""|\Z)'
_PARTS = {
    "rust": (_SLASHES, r'b?r(?P<hash>#*)"[\s\S]*?"(?P=hash)', "b?" + _STRING, r"b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'", r"'\w+"),
    "javascript": (_SLASHES, _BLOCK, _LINE_STRING, _CHAR),
    "go": (_SLASHES, _BLOCK, r"`[^`]*`", _LINE_STRING, _CHAR),
    "c": (_SLASHES, _BLOCK, r"(?m:^)[ \t]*#(?:\\\n|[^\n])*", r'R"(?P<mark>[^(\s]*)\([\s\S]*?\)(?P=mark)"', _LINE_STRING, _CHAR),
    "csharp": (_SLASHES, _BLOCK, r"(?m:^)[ \t]*#[^\n]*", _TRIPLE, r'\$?@\$?"(?:""|[^"])*"', r"\$?" + _LINE_STRING, _CHAR),
    "java": (_SLASHES, _BLOCK, _TRIPLE, _LINE_STRING, _CHAR),
    "php": (_SLASHES, _BLOCK, r"#(?!\[)[^\n]*", r"<<<\s*[\"']?(?P<doc>\w+)[\"']?[\s\S]*?\n\s*(?P=doc)\b", _STRING, r"'(?:\\[\s\S]|[^'\\])*'"),
    "swift": (_SLASHES, r'#+"[\s\S]*?"#+', _TRIPLE, _LINE_STRING),
    "kotlin": (_SLASHES, _TRIPLE, _LINE_STRING, _CHAR),
    "solidity": (_SLASHES, _BLOCK, _LINE_STRING, _CHAR),
    "ruby": (r"(?m:^)=begin\b[\s\S]*?\n=end", r"#[^\n]*", r"<<[~-]?[\"']?(?P<here>[A-Z]\w*)[\"']?[\s\S]*?\n\s*(?P=here)\b", _STRING, r"'(?:\\[\s\S]|[^'\\])*'", r"%[wWiIqQ]?\[[^\]]*\]"),
}
_PARTS["typescript"], _PARTS["cpp"] = _PARTS["javascript"], _PARTS["c"]
_SIGNS = r"=>|->|\?\?=?|\?\.(?!\d)|\?->|\|\||&&|::|:=|[<>!=]=|\.\.\.?"
_SPACE = re.compile(r"[ \t\r\n]+")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_LEX = {lang: re.compile("|".join((f"(?P<skip>{'|'.join(p)})", r"(?P<word>[^\W\d][\w]*[?!]?(?<![?!])|[$#@]?[^\W\d]\w*)", r"(?P<number>\d[\w.]*)", f"(?P<sign>{_SIGNS}|[^\\s\\w])"))) for lang, p in _PARTS.items()}
LANGUAGES = tuple(_LEX)
_VALUE_WORDS = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "yield", "await", "and", "or", "not", "if", "unless", "while", "until", "when", "then"}


@dataclass(slots=True)
class Token:
    text: str
    line: int
    kind: str  # word, number, sign, literal
    end_line: int = 0
    twin: int = -1  # where the bracket that this one opens closes


@dataclass(slots=True)
class Function:
    name: str
    line: int
    end_line: int = 0
    branches: int = 0
    begin: int = 0  # tokens that the body stands between
    end: int = 0


@dataclass(slots=True)
class Scope:
    kind: str
    function: Function | None = None
    seen: set = field(default_factory=set)
    name: str = ""


def tokens(source: str, lang: str) -> list[Token]:
    """Tokens without comments; strings and the like are literals. Script templates give what stands in ${}."""
    lex, out, at, line = _LEX[lang], [], 0, 1
    script, nested = lang in ("javascript", "typescript"), lang in NESTED_COMMENTS
    templates: list[int] = []  # open braces at each ${ that is open
    if lang == "php" and "<?" in source:
        at = source.index("<?") + 2
        line += source.count("\n", 0, at)
    while at < len(source):
        c = source[at]
        if c in " \t\r\n":
            end = _SPACE.match(source, at).end()
            line += source.count("\n", at, end)
            at = end
            continue
        end, kind = 0, "literal"
        if nested and source.startswith("/*", at):
            depth, end = 0, len(source)
            for m in re.compile(r"/\*|\*/").finditer(source, at):
                depth += 1 if m[0] == "/*" else -1
                if not depth:
                    end = m.end()
                    break
            line += source.count("\n", at, end)
            at = end
            continue
        if script and (c == "`" or (c == "}" and templates and not templates[-1])):
            if c == "}":
                templates.pop()
                out.append(Token("}", line, "sign", line))
            m = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])*(`|\$\{|\Z)").match(source, at + 1)
            line += source.count("\n", at, m.end())
            out.append(Token("``", line, "literal", line))
            if m[1] == "${":
                templates.append(0)
                out.append(Token("{", line, "sign", line))
            at = m.end()
            continue
        if c == "/" and lang in ("javascript", "typescript", "ruby") and (m := _REGEX.match(source, at)) and not _is_value(out[-1] if out else None):
            end = m.end()
        else:
            m = lex.match(source, at)
            if m is None:
                at += 1
                continue
            end, kind = m.end(), m.lastgroup if m.lastgroup in ("word", "number", "sign") else "literal"
        text, first = source[at:end], line
        line += text.count("\n")
        at = end
        comment = kind == "literal" and (text.startswith(("//", "/*")) or (text[0] == "#" and lang in ("php", "ruby", "c", "cpp", "csharp")) or text.lstrip().startswith("#") and lang in ("c", "cpp", "csharp") or text.startswith("=begin"))
        if not comment:
            if templates and text in "{}":
                templates[-1] += 1 if text == "{" else -1
            out.append(Token(text, first, kind, line))
    open_at: list[int] = []
    for i, t in enumerate(out):
        if t.kind == "sign" and t.text in ("(", "[", "{"):
            open_at.append(i)
        elif t.kind == "sign" and t.text in (")", "]", "}") and open_at:
            out[open_at.pop()].twin = i
    for i in open_at:
        out[i].twin = len(out) - 1
    return out


def _is_value(t: Token | None) -> bool:
    return t is not None and (t.kind in ("number", "literal") or (t.kind == "word" and t.text not in _VALUE_WORDS) or t.text in (")", "]", "}"))


class Walk:
    def __init__(self, source: str, lang: str):
        self.lang, self.t = lang, tokens(source, lang)
        self.scopes: list[Scope] = [Scope("file")]
        self.opening: dict[int, Scope] = {}  # scopes that a bracket to come will open
        self.ends: dict[int, list[Function]] = {}  # functions that end with a token, without a scope of their own
        self.open: list[Function] = []
        self.found: list[Function] = []

    def at(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) and self.t[i].kind in ("word", "sign") else ""

    def is_word(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "word"

    def until(self, i: int, *stops: str) -> int:
        """The next of stops from i on outside brackets that open after i, or where the brackets around i close."""
        while i < len(self.t):
            text = self.at(i)
            if text in stops or text in (")", "]", "}"):
                return i
            i = self.t[i].twin + 1 if text in ("(", "[", "{") else i + 1
        return i

    def branch(self, i: int) -> None:
        for f in self.open:
            f.branches += 1

    def start(self, name: str, first: int, body: int | None, last: int | None = None) -> None:
        """A function that begins at token first and lasts for the scope that body opens, or to token last."""
        f = Function(name, self.t[first].line)
        self.found.append(f)
        if body is not None:
            self.opening[body] = Scope("function", f)
            f.begin, f.end = body + 1, self.t[body].twin
        else:
            f.begin, f.end = first + 1, last + 1
            f.end_line = self.t[min(last, len(self.t) - 1)].end_line
            if last > first:
                self.open.append(f)
                self.ends.setdefault(last, []).append(f)

    def first_of(self, i: int) -> int:
        """Where modifiers in front of token i begin."""
        words = _MODIFIERS.get(self.lang, ())
        while i > 0 and (self.at(i - 1) in words or (self.at(i - 1) == ")" and self.at(i - 2) in words and self.at(i - 4) == "pub") or (self.t[i - 1].kind == "literal" and self.at(i - 2) == "extern")):
            i -= 3 if self.at(i - 1) == ")" else 1
        return i

    def run(self) -> list[Function]:
        t = self.t
        for i in range(len(t)):
            text = self.at(i)
            if self.inside("macro"):  # what a macro gets is no code yet
                if text in ("(", "[", "{"):
                    self.scopes.append(Scope("macro"))
            elif t[i].kind == "word":
                self.word(i, text)
            elif text:
                self.sign(i, text)
            if text in (")", "]", "}") and len(self.scopes) > 1:
                self.close(i)
            for f in self.ends.pop(i, ()):
                self.open.remove(f)
        while len(self.scopes) > 1:
            self.close(len(t) - 1)
        return self.found

    def inside(self, kind: str) -> bool:
        return self.scopes[-1].kind == kind

    def close(self, i: int) -> None:
        scope = self.scopes.pop()
        if scope.function is not None:
            scope.function.end_line = self.t[i].end_line
            self.open.remove(scope.function)

    def enter(self, i: int, kind: str, name: str = "") -> None:
        scope = self.opening.pop(i, None) or Scope(kind, name=name)
        if scope.function is not None:
            self.open.append(scope.function)
        self.scopes.append(scope)

    # --- words ----------------------------------------------------------------------------------

    def word(self, i: int, text: str) -> None:
        lang, before = self.lang, self.at(i - 1)
        if before in (".", "?.", "->", "::") and not (lang == "kotlin" and before == "->") and text not in ("class",):
            if lang != "cpp" or before != "::":
                return
        if text in BRANCHES[lang] and self.counts(i, text):
            self.branch(i)
        if text == LOOP_ENDS.get(lang) and self.at(i + 1) == "{":
            self.opening[i + 1] = Scope("loop")
            self.scopes[-1].seen.add(self.t[i + 1].twin + 1)  # where its while stands
        if text in TYPES and before not in ("(", ",") and (self.is_word(i + 1) or text in ("extern", "impl", "object", "enum")):
            body = self.until(i + 1, "{", ";", "=")
            if self.at(body) == "{" and not (lang == "kotlin" and text == "extern"):
                name = self.at(i + 1)
                self.opening.setdefault(body, Scope("class", name=name))
                if lang == "php" and text == "class":
                    self.start(name, i, body)
                    self.opening[body].kind, self.opening[body].name = "class", name
        if text in ("match", "when") and lang in ("rust", "kotlin"):
            body = self.until(i + 1, "{", ";")
            if self.at(body) == "{":
                self.opening.setdefault(body, Scope("match"))
        if text == "switch" and lang in ("go", "csharp"):
            body = self.until(i + 1, "{", ";")
            if self.at(body) == "{":
                before_body = [self.at(k) for k in range(i, body)]
                if lang == "go" and "type" in before_body and before_body[before_body.index("type") - 1] == "(":
                    self.branch(i)
                self.opening.setdefault(body, Scope("arms" if lang == "csharp" and self.at(i + 1) == "{" else "block"))
        if text == "select" and lang == "go" and self.at(i + 1) == "{":
            self.opening[i + 1] = Scope("select")
        if lang == "go" and text == "case" and self.inside("select"):
            self.branch(i)
        if lang == "csharp" and text in ("case", "default") and self.at(i - 1) != ":" and self.at(self.until(i + 1, ":", ";", "{")) == ":" and not self.at(i + 1) == "(":
            self.branch(i)
        if lang == "rust" and self.at(i + 1) == "!" and self.at(i + 2) in ("(", "[", "{") and text not in BRANCHES[lang]:
            self.opening[i + 2] = Scope("macro")
        self.head(i, text)

    def counts(self, i: int, text: str) -> bool:
        lang, before, after = self.lang, self.at(i - 1), self.at(i + 1)
        if text == "while" and i in self.scopes[-1].seen:
            return False
        if text == "else":
            return before == "}" if lang == "rust" else True
        if text == "for" and lang == "rust":  # not in impl .. for .., nor for<'a>
            return after != "<" and before in ("{", "}", ";", "(", ",", "=", "=>", ":", "|", "||", "return", "") or before == ")"
        if text in ("do", "repeat"):
            return after == "{"
        if text == "default":  # a label, not a modifier or an annotation's value
            return after in (":", "->")
        if text in ("case", "catch") and lang in ("javascript", "typescript"):
            return after != ":"
        if text == "if" and lang == "rust" and self.inside("match"):  # a guard follows a pattern
            return not _is_value(self.t[i - 1])
        return True

    # --- heads ----------------------------------------------------------------------------------

    def head(self, i: int, text: str) -> None:
        lang = self.lang
        if lang == "rust" and text == "fn" and self.is_word(i + 1):
            body = self.until(i + 2, "{", ";")
            if self.at(body) == "{":
                self.start(self.at(i + 1), self.first_of(i), body)
        elif lang == "go" and text == "func" and len(self.scopes) == 1:
            name = self.t[i + 1].twin + 1 if self.at(i + 1) == "(" else i + 1
            body = self.until(name + 1, "{", ";") if self.is_word(name) else len(self.t)
            while self.at(body) == "{" and self.at(body - 1) in ("interface", "struct"):
                body = self.until(self.t[body].twin + 1, "{", ";")
            if self.at(body) == "{":
                self.start(self.at(name), i, body)
        elif lang in ("swift", "kotlin") and text == ("func" if lang == "swift" else "fun"):
            self.signature(i)
        elif lang in ("php", "solidity") and text == "function" and self.is_word(i + 1) and self.at(i + 2) == "(":
            if lang == "php" and self.inside("class"):
                return
            body = self.until(self.t[i + 2].twin + 1, "{", ";")
            self.start(self.at(i + 1), i, body if self.at(body) == "{" else None, body)
        elif lang in ("javascript", "typescript"):
            self.script(i, text)
        elif lang in ("java", "csharp"):
            self.member(i, text)
        elif lang in ("c", "cpp"):
            self.declarator(i, text)

    def signature(self, i: int) -> None:
        """Swift and Kotlin: a name, parameters, and a body in braces or (Kotlin) behind an equals sign."""
        opens = self.until(i + 1, "(", "{", ";", "=")
        if self.at(opens) != "(" or opens == i + 1:
            return
        after, first = self.t[opens].twin + 1, self.first_of(i)
        body = self.until(after, "{", "=", ";") if self.lang == "kotlin" else after
        if self.lang == "swift":
            while body < len(self.t) and self.at(body) not in ("{", "}", "func", "var", "init"):
                body = self.t[body].twin + 1 if self.at(body) in ("(", "[") else body + 1
        if self.at(body) == "{":
            self.start(self.at(opens - 1 if self.lang == "kotlin" else i + 1), first, body)
        elif self.lang == "kotlin" and self.at(body) == "=":
            self.start(self.at(opens - 1), first, None, self.expression_end(body + 1))

    def script(self, i: int, text: str) -> None:
        if text == "function" and self.is_word(i + 1) and self.at(i + 2) in ("(", "<"):
            before = self.at(i - 2) if self.at(i - 1) == "async" else self.at(i - 1)
            if before in ("", ";", "{", "}", ")", "export", "default") or (i and self.t[i - 1].kind == "literal"):
                body = self.until(self.until(i + 2, "("), "{", ";")
                if self.at(body) == "{":
                    self.start(self.at(i + 1), self.first_of(i), body)
            return
        member = self.inside("class") or self.inside("object")
        opens = i + 1 if self.at(i + 1) != "<" else self.until(i + 1, "(")
        if not member or self.at(opens) != "(" or text in ("if", "for", "while", "switch", "catch", "function", "return", "new"):
            return
        first = i
        while self.at(first - 1) in ("static", "async", "get", "set", "public", "private", "protected", "override", "abstract", "*", "readonly"):
            first -= 1
        if self.at(first - 1) not in ("{", "}", ";", ",", ")") or "abstract" in [self.at(k) for k in range(first, i)]:
            return
        after = self.t[opens].twin + 1
        body = self.until(after, "{", ";", ",") if self.at(after) == ":" else after
        if self.at(body) == "{":
            self.start(text, first, body)
        elif self.lang == "typescript" and self.inside("class") and self.at(after) in (":", ";", "}"):
            self.start(text, first, None, max(body - (self.at(body) in ("}", ";", ",")), after - 1))

    def member(self, i: int, text: str) -> None:
        """Java and C#: methods and constructors of a type, and local functions of C#."""
        if self.at(i + 1) not in ("(", "<") or text in NOT_NAMES:
            return
        opens = i + 1 if self.at(i + 1) == "(" else self.until(i + 1, "(", "{", ";", "=")
        if self.at(opens) != "(" or self.t[opens].twin < 0:
            return
        before, local = self.at(i - 1), any(s.kind == "function" for s in self.scopes)
        typed = (self.is_word(i - 1) and before not in NOT_NAMES and before[:1] != "@") or before in (">", "]", "?")
        after = self.t[opens].twin + 1
        if local:
            if self.lang == "csharp" and typed and self.at(after) in ("{", "=>") and before not in ("return", "await", "else"):
                self.member_body(i, after, text)
            return
        if not self.inside("class") or before in ("@", ".", "new", "=") or not (typed or text == self.scopes[-1].name):
            return
        self.member_body(i, after, text)

    def member_body(self, i: int, after: int, text: str) -> None:
        first = i
        while first > 0 and self.at(first - 1) not in (";", "{", "}"):
            first -= 1
        body = self.until(after, "{", ";", "=>", "=")
        if self.at(body) == "{":
            self.start(text, first, body)
        elif self.at(body) == ";":
            self.start(text, first, None, body)
        elif self.at(body) == "=>":
            self.start(text, first, None, self.until(body + 1, ";"))

    def declarator(self, i: int, text: str) -> None:
        """C and C++: the declarator alone, which holds no branch."""
        if self.at(i + 1) != "(" or text in NOT_NAMES or any(s.kind in ("function", "block", "(") for s in self.scopes):
            return
        first = i - 1 if self.at(i - 1) == "~" else i
        while self.at(first - 1) == "::" and self.is_word(first - 2):
            first -= 2
        before, close = self.at(first - 1), self.t[i + 1].twin
        typed = self.is_word(first - 1) and before not in NOT_NAMES or before in ("*", "&", ">")
        own = self.inside("class") and text == self.scopes[-1].name or first < i
        after = self.at(close + 1)
        if not (typed or own) or after not in ("{", ";", "const", "override", "noexcept", "final", "=", ":", "->", ",", "try", "volatile"):
            return
        if after in ("const", "override", "noexcept", "final", "volatile") and self.lang == "cpp":
            while self.at(close + 1) in ("const", "override", "noexcept", "final", "volatile"):
                close += 1
        f = Function("".join(self.at(k) for k in range(first, i + 1)), self.t[first].line, self.t[close].end_line)
        self.found.append(f)
        body = self.until(close + 1, "{", ";")
        if self.at(body) == "{":
            self.opening[body] = Scope("block")

    # --- signs ----------------------------------------------------------------------------------

    def sign(self, i: int, text: str) -> None:
        lang = self.lang
        if text == "{":
            self.enter(i, *self.brace(i))
        elif text in ("(", "["):
            self.enter(i, text)
        elif text == "=>" and lang == "rust" and self.inside("match"):
            self.branch(i)
        elif text in ("|", "||") and lang == "rust" and self.at(i - 1) in ("(", ",", "=", "{", ";", "=>", "return", "move", "[", ":", "&&", "||", "else"):
            if self.at(i - 1) != "{" or not self.inside("match"):
                self.branch(i)
        elif text == "=>" and lang in ("javascript", "typescript"):
            self.arrow(i)
        elif text == "=>" and lang == "csharp" and not self.inside("arms") and not self.inside("class") and not self.local_body(i):
            self.branch(i)
        elif text == "->" and lang == "java" and not self.of_case(i):
            self.branch(i)
        elif text == "->" and lang == "kotlin" and self.inside("match"):
            self.branch(i)
        elif text == "?" and lang in ("javascript", "typescript", "csharp", "php") and self.conditional(i):
            self.branch(i)

    def brace(self, i: int) -> tuple[str, str]:
        before, lang = self.at(i - 1), self.lang
        if lang in ("javascript", "typescript") and before in ("=", "(", ",", "[", ":", "?", "return", "&&", "||", "??", "...") and not (before == ":" and self.of_case(i)):
            return "object", ""
        if lang == "kotlin" and i not in self.opening and (before in (")", "=", "(", ",", "return", ">") and self.scopes[-1].kind != "file" or self.is_word(i - 1)) and not self.statement(i):
            self.branch(i)
        return "block", ""

    def statement(self, i: int) -> bool:
        """Kotlin: whether a brace belongs to a statement, and isn't a lambda."""
        k = i - 1
        if self.at(k) == ")":
            depth = 0
            while k >= 0:
                depth += {")": 1, "(": -1}.get(self.at(k), 0)
                if not depth:
                    break
                k -= 1
            return self.at(k - 1) in ("if", "for", "while", "when", "catch", "constructor")
        return self.at(k) in ("else", "do", "try", "finally", "init", "get", "set", "object")

    def arrow(self, i: int) -> None:
        first = i - 1
        if self.at(first) == ")":
            depth = 0
            while first >= 0:
                depth += {")": 1, "(": -1}.get(self.at(first), 0)
                if not depth:
                    break
                first -= 1
        if self.lang == "typescript":
            close, before = i - 1, self.at(first - 1)
            if self.at(close) != ")" and before == ":" and self.at(first - 2) == ")":  # a declared result
                close = first - 2
                first = close
                depth = 0
                while first >= 0:
                    depth += {")": 1, "(": -1}.get(self.at(first), 0)
                    if not depth:
                        break
                    first -= 1
                before = self.at(first - 1)
            if before in ("|", "&", "<", "=>") or (before == ":" and not self.inside("object")) or self.type_alias(first):
                return  # a function's type
        self.branch(i)
        start = first - 1 if self.at(first - 1) == "async" else first
        if self.at(i + 1) == "{":
            self.start("<anonymous>", start, i + 1)
        else:
            self.start("<anonymous>", start, None, self.expression_end(i + 1))

    def type_alias(self, i: int) -> bool:
        while i > 0 and self.at(i - 1) not in (";", "{", "}"):
            i -= 1
            if self.at(i) == "type" and self.is_word(i + 1) and self.at(i - 1) in ("", ";", "{", "}", "export"):
                return True
        return False

    def expression_end(self, i: int) -> int:
        """The last token of an expression that begins at i: before a comma, a semicolon, a closing bracket, or a line that begins with a word after a value."""
        last = i
        while i < len(self.t):
            if self.at(i) in (",", ";", ")", "]", "}") or (i > last and self.t[i].line > self.t[last].end_line and self.t[i].kind == "word" and _is_value(self.t[last]) and self.at(i) not in ("else", "in", "instanceof", "as")):
                break
            last = self.t[i].twin if self.at(i) in ("(", "[", "{") else i
            i = last + 1
        return last

    def of_case(self, i: int) -> bool:
        k = i - 1
        while k >= 0 and self.at(k) not in (";", "{", "}"):
            if self.at(k) in ("case", "default"):
                return True
            k -= 1
        return False

    def local_body(self, i: int) -> bool:
        """C#: whether an arrow is the body of a function whose head came before."""
        return self.at(i - 1) == ")" and any(f in self.open and self.t[i].line >= f.line and last == self.until(i + 1, ";") for last, fs in self.ends.items() for f in fs)

    def conditional(self, i: int) -> bool:
        after = self.at(i + 1)
        if self.lang == "php" and after == ":":
            return True
        if after in (":", ",", ")", ";", "=", "]", ">") or not _is_value(self.t[i - 1] if i else None):
            return False
        return self.at(self.until(i + 1, ":", ";", ",", "=>")) == ":"


# --- Ruby -----------------------------------------------------------------------------------------

_OPENS = {"def", "class", "module", "begin", "do", "if", "unless", "while", "until", "case", "for"}
_STATEMENT = {"if", "unless", "while", "until"}


def ruby(source: str) -> list[Function]:
    """Methods by their end words: a condition or loop behind a statement has no end and is no branch."""
    found, stack, last, loop = [], [], None, False
    for t in tokens(source, "ruby"):
        text = t.text if t.kind == "word" else ""
        begins = last is None or t.line > last.end_line or last.text in (";", "=", "(", "then", "do", "else", "||", "&&", "return", "{", "|")
        after_dot = last is not None and last.text in (".", ":", "?.")
        if text and after_dot and stack and stack[-1] is not None and stack[-1].name == "self":
            stack[-1].name = text
        if text and not after_dot:
            if text in BRANCHES["ruby"] and (text not in _STATEMENT or begins):
                for f in stack:
                    if f is not None:
                        f.branches += 1
            if text == "end" and stack:
                f = stack.pop()
                if f is not None:
                    f.end_line = t.end_line
            elif last is not None and last.text == "def":
                found.append(Function(text, last.line))
                stack[-1] = found[-1]
            elif text in _OPENS and (text not in _STATEMENT or begins) and not (text == "do" and loop):
                stack.append(None)
            loop = (text in ("while", "until", "for") and begins) or (loop and last is not None and t.line == last.end_line)
        last = t
    for f in stack:
        if f is not None:
            f.end_line = last.end_line
    return found


# Control-flow tokens that a function's shape is compared by, with the words that make them.
SHAPE_WORDS = {
    "if": "IF", "guard": "IF", "unless": "IF", "else": "ELSE", "elif": "ELSE", "elseif": "ELSE", "while": "WHILE", "for": "FOR", "foreach": "FOR", "loop": "LOOP", "repeat": "LOOP", "match": "MATCH", "switch": "MATCH",
    "when": "MATCH", "select": "MATCH", "case": "ARM", "default": "ARM", "let": "LET", "var": "LET", "const": "LET", "val": "LET", "return": "RET", "try": "TRY", "catch": "TRY", "finally": "TRY",
}
_DEEPEST = 20


def shapes(source: str, lang: str) -> list[tuple[str, int, list[str]]]:
    """(name, line, control-flow tokens) of each function with a body, down to a bounded depth of brackets."""
    walk = Walk(source, lang)
    found = [f for f in walk.run() if f.end > f.begin or f.begin and walk.at(f.begin - 1) == "{"]
    return [(f.name, f.line, list(_shape(walk, f))) for f in found]


def _shape(walk: Walk, f: Function) -> Iterator[str]:
    depth, lang = 0, walk.lang
    for i in range(f.begin, f.end):
        text = walk.at(i)
        depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(text, 0)
        if depth > _DEEPEST or not text:
            continue
        before = walk.at(i - 1)
        if walk.is_word(i):
            if text in SHAPE_WORDS and before not in (".", "?.", "->", "::"):
                yield SHAPE_WORDS[text]
            elif walk.at(i + 1) == "(" and text not in NOT_NAMES:
                yield "CALL"
        elif text == "{":
            yield "BLOCK"
        elif text == ":=":
            yield "LET"
        elif text == "=>":
            yield "ARM" if lang in ("rust", "php") else "LAMBDA"
        elif text == "->" and lang in ("kotlin", "java"):
            yield "ARM" if lang == "kotlin" or walk.of_case(i) else "LAMBDA"
        elif text in ("|", "||") and lang == "rust" and (before in ("(", ",", "=", "{", ";", "return", "move", "[")):
            yield "LAMBDA"


def functions(source: str, lang: str) -> list[tuple[str, int, int, int]]:
    """(name, line, end line, complexity) of each function, in the order of their heads."""
    found = ruby(source) if lang == "ruby" else Walk(source, lang).run()
    return [(f.name, f.line, f.end_line, 1 + f.branches) for f in found]
