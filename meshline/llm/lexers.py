"""Tokens of source text: comments dropped, literals as single tokens, indentation of Python as brackets."""

from __future__ import annotations

import re
from dataclasses import dataclass

BAD = "ERR"
CONFLICT = "CONFLICT"
OPEN = {"(": ")", "[": "]", "{": "}", "INDENT": "DEDENT"}
CLOSE = {v: k for k, v in OPEN.items()}


@dataclass(slots=True)
class Token:
    kind: str
    at: int
    nl: bool = False


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


# Reserved and contextual words that the grammars name.
KEYWORDS = {
    "python": _words("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type"),
    "javascript": _words("await break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield let static async of as from get set enum"),
    "java": _words("abstract assert break case catch class continue default do else enum extends false final finally for if implements import instanceof interface native new null package private protected public return static strictfp super switch synchronized this throw throws transient true try void volatile while record var yield sealed permits non"),
    "go": _words("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"),
    "rust": _words("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while union macro_rules"),
    "json": _words("true false null"),
}
KEYWORDS["typescript"] = KEYWORDS["javascript"] | _words("interface type implements declare abstract namespace module readonly keyof infer is public private protected satisfies override asserts")

_NUM = r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.?\d[\d_]*(?:\.(?![.\w]))?(?:[eE][+-]?\d+)?)"
_NAME = r"[^\W\d][\w$]*"
_CSTRING = r'"(?:[^"\\\n]|\\.)*"'
_CONFLICT = r"(?m:^(?:<{7}|>{7}|\|{7})(?: [^\n]*)?$|^={7}$)"


def _compile(**parts: str) -> re.Pattern:
    return re.compile("|".join(f"(?P<{k}>{v})" for k, v in parts.items()), re.S)


_C_COMMENT = r"//[^\n]*|/\*.*?\*/"
_PATTERNS = {
    "javascript": _compile(
        CONFLICT=_CONFLICT, ws=r"[^\S\n]+|\ufeff", line=r"\n", comment=r"\A#![^\n]*|" + _C_COMMENT + r"|<!--[^\n]*", STR=_CSTRING + r"|'(?:[^'\\\n]|\\.)*'",
        TEMPLATE=r"`(?:[^`\\$]|\\.|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\})*`", NUM=_NUM + "n?", ID=r"[#$]?(?:[^\W\d]|\$)[\w$]*|\$",
        op=r">>>=|\.\.\.|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|[-+*/%&|^!~?:;,.=<>()\[\]{}@]",
    ),
    "java": _compile(
        CONFLICT=_CONFLICT, ws=r"\s+|\ufeff", comment=_C_COMMENT, STR=r'"""\s*\n.*?"""|' + _CSTRING + r"|'(?:[^'\\\n]|\\[^\n]{1,6}?)'", NUM=_NUM + "[lLfFdD]?", ID=r"(?:[^\W\d]|\$)[\w$]*",
        op=r"\.\.\.|<<=|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%&|^!~?:;,.=<>()\[\]{}@]",
    ),
    "go": _compile(
        CONFLICT=_CONFLICT, ws=r"[^\S\n]+|\ufeff", line=r"\n", comment=_C_COMMENT, STR=_CSTRING + r"|`[^`]*`|'(?:[^'\\\n]|\\[^\n]{1,8}?)'", NUM=_NUM + "i?", ID=_NAME,
        op=r"\.\.\.|<<=|>>=|&\^=|<-|:=|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^!:;,.=<>()\[\]{}~]",
    ),
    "rust": _compile(
        CONFLICT=_CONFLICT, ws=r"\s+|\ufeff", comment=r"\A#![^\[\n][^\n]*|//[^\n]*", STR=r'[bc]?r(?P<h>#*)".*?"(?P=h)|[bc]?"(?:[^"\\]|\\.)*"|b?\'(?:[^\'\\\n]|\\[^\n]{1,9}?)\'', LIFE=r"'[^\W\d]\w*", NUM=r"(?:0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?\d+)?)(?:[iuf]\d+|[iu]size)?", ID=r"(?:r#)?[^\W\d]\w*",
        op=r"\.\.\.|\.\.=|\.\.|->|=>|::|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%&|^!?:;,.=<>()\[\]{}@#$~]",
    ),
    "json": _compile(CONFLICT=_CONFLICT, ws=r"[ \t\r\n]+", STR=r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"', NUM=r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])", ID=_NAME, op=r"[\[\]{},:]"),
    "python": _compile(
        CONFLICT=_CONFLICT, ws=r"[^\S\n]+|\\\r?\n|\ufeff", line=r"\n", comment=r"#[^\n]*", STR=r"(?i:[rbuft]|br|rb|fr|rf|tr|rt)?(?:'''(?:[^\\]|\\.)*?'''|\"\"\"(?:[^\\]|\\.)*?\"\"\"|'(?!'')(?:[^'\\\n]|\\.)*'|\"(?!\"\")(?:[^\"\\\n]|\\.)*\")",
        NUM=r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:(?:0(?:_?0)*|[1-9](?:_?\d)*)(?![\d_])(?:\.(?:\d(?:_?\d)*)?)?|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?!\w)", ID=r"[^\W\d]\w*",
        op=r"\*\*=|//=|>>=|<<=|\.\.\.|:=|->|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|\*\*|//|<<|>>|[-+*/%&|^~:;,.=<>()\[\]{}@]",
    ),
}
_PATTERNS["typescript"] = _PATTERNS["javascript"]
_BLOCK_COMMENTS = ("javascript", "typescript", "java", "go")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_VALUE_END = {"ID", "NUM", "STR", "TEMPLATE", "REGEX", ")", "]", "}", "this", "super", "null", "true", "false"}
_GO_LINE_END = {"ID", "NUM", "STR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}


def _rust_block(text: str, at: int) -> int:
    depth, i = 1, at + 2
    for m in re.compile(r"/\*|\*/").finditer(text, i):
        depth += 1 if m.group() == "/*" else -1
        if depth == 0:
            return m.end()
    return -1


def lex(text: str, lang: str) -> list[Token]:
    """Tokens in order; anything that starts no token is one of kind ERR."""
    pattern, words = _PATTERNS[lang], KEYWORDS[lang]
    js, go, py = lang in ("javascript", "typescript"), lang == "go", lang == "python"
    out: list[Token] = []
    at, n, nl, depth = 0, len(text), False, 0
    indents, fresh = [0], True
    while at < n:
        if py and fresh and text[at] in "<=>|" and (m := pattern.match(text, at)) and m.lastgroup == CONFLICT:
            out.append(Token(CONFLICT, at))  # a line of its own, which neither opens nor closes a block
            at = m.end() + 1
            continue
        if py and fresh and depth == 0:
            m = re.compile(r"[ \t\f]*").match(text, at)
            rest = text[m.end() : m.end() + 1]
            fresh = False
            if rest not in ("\n", "#", "\r", "") and not (rest == "\\" and text[m.end() + 1 : m.end() + 2] == "\n"):
                col = len(m.group().expandtabs(8))
                if col > indents[-1]:
                    indents.append(col)
                    out.append(Token("INDENT", at))
                while col < indents[-1]:
                    indents.pop()
                    out.append(Token("DEDENT", at))
                    if col > indents[-1]:
                        out.append(Token(BAD, at))
                        indents.append(col)
                        break
        if js and text[at] == "/" and (not out or out[-1].kind not in _VALUE_END):
            m = _REGEX.match(text, at)
            if m:
                out.append(Token("REGEX", at, nl))
                at, nl = m.end(), False
                continue
        if lang == "rust" and text.startswith("/*", at):
            end = _rust_block(text, at)
            if end < 0:
                out.append(Token(BAD, at, nl))
                break
            at = end
            continue
        m = pattern.match(text, at)
        if lang in _BLOCK_COMMENTS and text.startswith("/*", at) and m and m.lastgroup != "comment":
            out.append(Token(BAD, at, nl))  # a comment that never ends
            break
        if not m:
            out.append(Token(BAD, at, nl))
            at, nl = at + 1, False
            continue
        kind, value = m.lastgroup, m.group()
        if kind == "h":
            kind = "STR"
        start, at = at, m.end()
        if kind == "ws":
            continue
        if kind == "comment":
            if "\n" in value and (js or go) and (not go or out and out[-1].kind in _GO_LINE_END):
                nl = True
            continue
        if kind == "line":
            if py:
                fresh = depth == 0
                if depth == 0 and out and out[-1].kind not in ("NEWLINE", "INDENT", "DEDENT", CONFLICT):
                    out.append(Token("NEWLINE", start))
            elif not go or out and out[-1].kind in _GO_LINE_END:
                nl = True
            continue
        if kind == "ID" and value in words or kind == "op":
            kind = value
        elif py and kind == "STR" and re.match(r"[a-zA-Z]*b|[a-zA-Z]*B", value) and not value.isascii():
            kind = BAD
        if py:
            depth += kind in ("(", "[", "{")
            depth -= kind in (")", "]", "}") and depth > 0
        out.append(Token(kind, start, nl))
        nl = False
    if py:
        if out and out[-1].kind not in ("NEWLINE", "DEDENT", CONFLICT):
            out.append(Token("NEWLINE", n))
        out += [Token("DEDENT", n) for _ in indents[1:]]
    return out
