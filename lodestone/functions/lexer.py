"""Source texts without what only looks like code, and the symbols that their tokens declare.

``masked`` blanks comments and the insides of strings, templates and regular expressions, place for place. ``symbols``
walks the tokens of that with a stack of brackets: declarations count where a statement may begin, methods in the
body of a type or at the top. Texts that indent instead are cut by their logical lines.
"""

from __future__ import annotations

import bisect
import re

#: What may stand before a regular expression, and so isn't the end of a value before a division.
_BEFORE_REGEX = re.compile(r"(?:^|[=(,:;!&|?{}\[+\-*%<>~^\n]|\b(?:return|typeof|case|in|of|do|else|throw|yield|await))[ \t]*$")
_TYPES = ("class", "interface", "struct", "enum", "object", "trait", "namespace", "union", "record", "module", "protocol")
_CONTROL = frozenset("if for while switch catch return else do try synchronized using lock when with sizeof typeof await yield new throw match foreach unless guard defer in of case delete".split())
_FUNCTIONS = frozenset(("function", "func", "fun", "fn", "def", "sub"))
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|=>|->|::|[^\s\w]|\d\w*")
_CHAR = re.compile(r"'(?:\\(?:u\{[^}]*\}|x[0-9a-fA-F]+|.)|[^\\'\n])'")
_LIFETIMES = re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:(?:unsafe|async|const)[ \t]+)*fn[ \t]+\w+", re.M)
_INDENTED = re.compile(r"^[ \t]*(?:async[ \t]+)?(def|class)[ \t]+([A-Za-z_]\w*)", re.M)


def indented(text: str) -> bool:
    """Whether blocks are made by indentation: there is a ``def`` or ``class`` whose line ends in a colon."""
    return bool(re.search(r"^[ \t]*(?:async[ \t]+)?(?:def|class)[ \t]+\w+[^{}\n]*:[ \t]*(?:#.*)?$|^[ \t]*(?:async[ \t]+)?def[ \t]+\w+\([^{}]*\)[^{}\n]*:", text, re.M))


def _end_of_string(text: str, at: int, quote: str) -> int:
    """Behind a string's closing quote; without one on its line (in the text, for triple quotes), -1."""
    i, n = at + len(quote), len(text)
    while i < n:
        if text[i] == "\\":
            i += 2
        elif text.startswith(quote, i):
            return i + len(quote)
        elif text[i] == "\n" and len(quote) == 1 and quote != "`":
            return -1
        else:
            i += 1
    return n if len(quote) == 3 or quote == "`" else -1


def _spans(text: str, hashes: bool) -> list[tuple[int, int]]:
    """What is to be blanked: comments, and strings without their quotes. ``hashes``: ``#`` begins a comment, ``//`` doesn't."""
    out, templates, i, n = [], [], 0, len(text)
    lifetimes = not hashes and bool(_LIFETIMES.search(text))
    start = re.compile(r"""["'`#/{}]""")
    while m := start.search(text, i):
        i, c = m.start(), m[0]
        if c == "#":
            end = text.find("\n", i) if hashes else i
            end = n if end < 0 else end
            if hashes:
                out.append((i, end))
            i = max(end, i + 1)
        elif c == "/" and not hashes and text[i : i + 2] in ("//", "/*"):
            end = text.find("\n", i) if text[i + 1] == "/" else text.find("*/", i + 2) + 2
            end = n if end < (2 if text[i + 1] == "*" else 0) else end
            out.append((i, end))
            i = end
        elif c == "/" and not hashes and _BEFORE_REGEX.search(text, max(0, i - 40), i) and (r := re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/").match(text, i)):
            out.append((i + 1, r.end() - 1))
            i = r.end()
        elif c in "\"'" or c == "`" and hashes:
            quote = c * 3 if text.startswith(c * 3, i) and c != "`" else c
            end = _end_of_string(text, i, quote)
            if end < 0 or c == "'" and lifetimes and not _CHAR.match(text, i):
                i += 1  # a lifetime, or an apostrophe
                continue
            out.append((i + len(quote), max(i + len(quote), end - len(quote))))
            i = end
        elif c == "`" or c == "}" and templates and templates[-1] == 0:
            if c == "}":
                templates.pop()
            j = i + 1
            while j < n and text[j] != "`" and not text.startswith("${", j):
                j += 2 if text[j] == "\\" else 1
            out.append((i + 1, min(j, n)))
            if text.startswith("${", j):
                templates.append(0)  # code again, until its brace closes
                i = j + 2
            else:
                i = j + 1
        else:
            if templates and c in "{}":
                templates[-1] += 1 if c == "{" else -1
            i += 1
    return out


def masked(text: str, hashes: bool | None = None) -> str:
    """The text with comments and the insides of strings as blanks; lines and columns stay."""
    out, at = [], 0
    for lo, hi in _spans(text, indented(text) if hashes is None else hashes):
        out += (text[at:lo], re.sub(r"[^\n]", " ", text[lo:hi]))
        at = max(at, hi)
    return "".join([*out, text[at:]])


def _by_indent(text: str, code: str) -> list[tuple[str, str, int, int]]:
    lines, depth, logical = code.split("\n"), 0, []
    held = {k for lo, hi in _spans(text, True) for k in range(text.count("\n", 0, lo) + 1, text.count("\n", 0, hi) + 1)} if "\"\"\"" in text or "'''" in text else set()
    for k, line in enumerate(lines):
        if line.strip() and depth == 0 and k not in held:
            logical.append((k, len(line) - len(line.lstrip())))
        depth = max(0, depth + sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}"))
    out, last = [], [k for k, line in enumerate(lines) if line.strip()]
    for m in _INDENTED.finditer(code):
        k = code.count("\n", 0, m.start(1))
        own = len(lines[k]) - len(lines[k].lstrip())
        if not any(i == k for i, _ in logical):
            continue
        until = next((i for i, indent in logical if i > k and indent <= own), len(lines))
        out.append(("class" if m[1] == "class" else "function", m[2], k + 1, max(i for i in last if i < until) + 1))
    return out


def symbols(text: str, code: str | None = None) -> list[tuple[str, str, int, int]]:
    """(type, name, first line, last line) of the types and functions that a text declares, in order; ``code`` is the masked text, if it is there."""
    hashes = indented(text)
    code = masked(text, hashes) if code is None else code
    if hashes:
        return _by_indent(text, code)
    found = [(m[0], m.start()) for m in _TOKEN.finditer(code)]
    tok, close, stack = [t for t, _ in found], {}, []
    for k, t in enumerate(tok):
        if t in "([{" and len(t) == 1:
            stack.append(k)
        elif t in ")]}" and len(t) == 1:
            while stack and "([{"[")]}".index(t)] != tok[stack[-1]]:
                stack.pop()
            if stack:
                close[stack.pop()] = k
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    line = lambda k: bisect.bisect_right(starts, found[min(k, len(found) - 1)][1])
    n, out, types, inside = len(tok), [], set(), []

    def body_after(k: int, stop: str | tuple[str, ...] = ";") -> int:
        """The brace that opens a body behind k, if nothing ends the declaration before; -1 for none."""
        while k < n:
            if tok[k] == "{":
                return k
            if tok[k] in stop or tok[k] == "}":
                return -1
            k = close.get(k, k) + 1 if tok[k] in "([" else k + 1
        return -1

    def end_of(brace: int, k: int) -> int:
        if brace >= 0:
            return line(close.get(brace, n - 1))
        own = line(k)  # an expression: up to its line's end, or the bracket that a line opens
        while k + 1 < n and line(k + 1) == own and tok[k] != ";":
            k = close.get(k, k) if tok[k] in "([{" and k in close else k + 1
            own = line(k)
        return line(k)

    k = 0
    while k < n:
        t, before = tok[k], tok[k - 1] if k else ""
        while inside and inside[-1][1] < k:
            inside.pop()
        named = k + 1 < n and re.match(r"[A-Za-z_$]", tok[k + 1])
        if t == "type" and named and tok[k + 2 : k + 3] in (["struct"], ["interface"]):
            brace = body_after(k + 3)
            if brace >= 0:
                types.add(brace)
                out.append((tok[k + 2], tok[k + 1], line(k), end_of(brace, k + 1)))
                k += 2
        elif t in _TYPES and named and before not in (".", "::", "<", ",", "(") and tok[k + 1] not in ("extends", "implements"):
            name = k + 2 if tok[k + 1] in ("class", "struct") and k + 2 < n and re.match(r"[A-Za-z_$]", tok[k + 2]) else k + 1
            brace = body_after(name + 1, (";", "=", "val", "var", "let", "const", "import", *_TYPES, *_FUNCTIONS))
            head = name + 1 if tok[name + 1 : name + 2] == ["("] else name  # a type may be no more than its head
            if brace >= 0 or head > name:
                types.add(brace)
                out.append((t, tok[name], line(k), end_of(brace, name) if brace >= 0 else line(close.get(head, head))))
                k = close.get(head, head) if head > name else name
        elif t in _FUNCTIONS and before not in (".", "::"):
            at = k + 1
            if at < n and tok[at] == "*":
                at += 1
            if at < n and tok[at] == "(" and t == "func":  # a receiver
                at = close.get(at, at) + 1
            if at + 1 < n and re.match(r"[A-Za-z_$]", tok[at]) and tok[at + 1] in ("(", "<", "["):
                over = at + 1
                while over < n and tok[over] != "(":
                    over += 1
                after = close.get(over, over) + 1
                brace = body_after(after, ";=")
                if brace >= 0 or after < n and tok[after] == "=" or ":" in tok[after : after + 1] and t == "fun":
                    out.append(("function", tok[at], line(k), end_of(brace, after)))
                k = at
        elif t == "=" and k and re.match(r"[A-Za-z_$]", before):
            # name = (a) => ..., name = async a => ..., name = function (...) {
            at = k + 1 + (k + 1 < n and tok[k + 1] == "async")
            if at < n and tok[at] == "function":
                brace = body_after(at + 1)
                if brace >= 0 and tok[at + 1 : at + 2] == ["("]:
                    out.append(("function", before, line(k - 1), end_of(brace, at)))
            elif at < n:
                arrow = close.get(at, at) + 1
                if arrow < n and tok[arrow] == ":":
                    while arrow < n and tok[arrow] not in ("=>", ";", "{", "="):
                        arrow += 1
                if arrow < n and tok[arrow] == "=>" and (tok[at] == "(" or re.match(r"[A-Za-z_$]", tok[at])):
                    brace = arrow + 1 if arrow + 1 < n and tok[arrow + 1] == "{" else -1
                    out.append(("function", before, line(k - 1), end_of(brace, arrow + 1 if arrow + 1 < n else arrow)))
        elif t == "(" and k and re.match(r"[A-Za-z_$]", before) and before not in _CONTROL and k in close and (not inside or inside[-1][0] in types):
            prior = tok[k - 2] if k > 1 else ""
            after = close[k] + 1
            brace = body_after(after, ";=,)" if after < n and tok[after] != ":" else ";=)")
            declares = prior not in (".", "new", "=", "(", ",", "return", "?", "|", "=>", ":") and (inside or re.match(r"[A-Za-z_$>*&\]]|::", prior or "-"))
            if brace >= 0 and declares and not any(x in ("=>", "=") for x in tok[after:brace]):
                first = k - 1
                while first > 0 and line(first - 1) == line(k) and tok[first - 1] not in ";{}":
                    first -= 1
                out.append(("function", before, line(first), end_of(brace, k)))
                inside.append((brace, close.get(brace, n)))
                k = brace
        elif t == "{":
            inside.append((k, close.get(k, n)))
        k += 1
    return sorted(set(out), key=lambda s: (s[2], -s[3], s[1]))
