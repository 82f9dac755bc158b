"""Definitions, imports and calls of languages with braces, with the extents of definitions.

No grammar library is at hand, so a text is read in two steps: comments and strings are blanked out, at the same
positions, and what is left is searched for the heads of definitions, whose braces are then matched. A node has the
kind that grammars call it, a name, its whole text and the lines it begins and ends in, counted from 1.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

NAME = r"[A-Za-z_$][\w$]*"
#: Words before a parenthesis that are not calls, and words that are not names of methods.
NOT_NAMES = frozenset("if for while switch catch return function func fn match sizeof with new throw await yield typeof do else when guard in using lock fixed foreach synchronized super this".split())


@dataclass(frozen=True)
class Syntax:
    """How a language writes what is looked for: (kind, pattern) of definitions, whose group 1 is the name; patterns
    of imports, read where the blanked text has them; kinds of import and call; text of a call's callee."""

    definitions: tuple[tuple[str, str], ...]
    imports: str
    import_kind: str
    call_kind: str
    callee: str = rf"{NAME}(?:(?:\.|::|->|\?\.){NAME})*"
    line_comment: str = "//"


METHOD = rf"^[ \t]+(?:(?:public|private|protected|internal|static|async|final|abstract|virtual|override|readonly|sealed|synchronized|native|default|get|set)\s+)*"
TYPED = rf"(?:[\w$<>\[\],.?:&* ]+?[\s&*>\]])"
ECMA = Syntax(
    (("function_declaration", rf"\bfunction\s*\*?\s*({NAME})\s*[(<]"), ("class_declaration", rf"\bclass\s+({NAME})"), ("method_definition", rf"{METHOD}[*#]?({NAME})\s*(?:<[^>]*>)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^{{;=]+)?\{{")),
    r"^[ \t]*import\b[^;'\"]*(['\"])(.*?)\1", "import_statement", "call_expression",
)
LANGUAGES: dict[str, Syntax] = {
    "javascript": ECMA,
    "typescript": ECMA,
    "go": Syntax((("function_declaration", rf"^func\s+({NAME})"), ("method_declaration", rf"^func\s*\([^)]*\)\s*({NAME})")), r"^[ \t]*(?:import[ \t]+)?(?:[\w.]+[ \t]+)?(\")([^\"\n]+)\"[ \t]*$", "import_spec", "call_expression"),
    "rust": Syntax(
        (("function_item", rf"\bfn\s+({NAME})"), ("struct_item", rf"\bstruct\s+({NAME})"), ("enum_item", rf"\benum\s+({NAME})"), ("trait_item", rf"\btrait\s+({NAME})"), ("impl_item", rf"^[ \t]*(?:unsafe\s+)?impl\s*(?:<[^>]*>)?\s*({NAME})"), ("type_item", rf"\btype\s+({NAME})")),
        r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?use[ \t]+()([\w:]+)[ \t]*;", "use_declaration", "call_expression",
    ),
    "cpp": Syntax(
        (("function_definition", rf"^[ \t]*(?:{TYPED}\s*)?(?:{NAME}::)*(~?{NAME})\s*\([^;{{}}]*\)\s*(?:const|noexcept|override|final|\s)*(?::[^;{{]*)?\{{"), ("class_specifier", rf"\bclass\s+({NAME})"), ("struct_specifier", rf"\bstruct\s+({NAME})"), ("namespace_definition", rf"\bnamespace\s+({NAME})")),
        r"^[ \t]*#[ \t]*include[ \t]*([\"<])([^\">\n]+)[\">]", "preproc_include", "call_expression",
    ),
    "java": Syntax((("method_declaration", rf"{METHOD}(?:<[^>]*>\s*)?{TYPED}\s*({NAME})\s*\([^;{{}}]*\)\s*(?:throws\s+[\w.,\s]+)?[{{;]"), ("class_declaration", rf"\bclass\s+({NAME})"), ("interface_declaration", rf"\binterface\s+({NAME})"), ("enum_declaration", rf"\benum\s+({NAME})")), r"^[ \t]*import[ \t]+(?:static[ \t]+)?()([\w.]+)", "import_declaration", "method_invocation", callee=NAME),
    "c_sharp": Syntax((("method_declaration", rf"{METHOD}{TYPED}\s*({NAME})\s*(?:<[^>]*>)?\([^;{{}}]*\)\s*(?:\{{|=>|;)"), ("class_declaration", rf"\bclass\s+({NAME})"), ("interface_declaration", rf"\binterface\s+({NAME})"), ("struct_declaration", rf"\bstruct\s+({NAME})"), ("enum_declaration", rf"\benum\s+({NAME})")), r"^[ \t]*using[ \t]+(?:static[ \t]+)?()([\w.]+)[ \t]*;", "using_directive", "invocation_expression"),
    "php": Syntax((("function_definition", rf"^\s*function\s+&?({NAME})"), ("class_declaration", rf"\bclass\s+({NAME})"), ("method_declaration", rf"^[ \t]+(?:(?:public|private|protected|static|final|abstract)\s+)+function\s+&?({NAME})")), r"^[ \t]*use[ \t]+()([\w\\]+)", "namespace_use_declaration", "function_call_expression", callee=rf"(?:\$?{NAME}(?:->|::|\\))*{NAME}"),
    "swift": Syntax((("function_declaration", rf"\bfunc\s+({NAME})"), ("class_declaration", rf"\bclass\s+({NAME})"), ("struct_declaration", rf"\bstruct\s+({NAME})"), ("protocol_declaration", rf"\bprotocol\s+({NAME})"), ("enum_declaration", rf"\benum\s+({NAME})")), r"^[ \t]*import[ \t]+()([\w.]+)", "import_declaration", "call_expression"),
    "kotlin": Syntax((("function_declaration", rf"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?({NAME})"), ("class_declaration", rf"\b(?:class|interface)\s+({NAME})"), ("object_declaration", rf"\bobject\s+({NAME})")), r"^[ \t]*import[ \t]+()([\w.]+)", "import_header", "call_expression"),
    "scala": Syntax((("function_definition", rf"\bdef\s+({NAME})"), ("class_definition", rf"\bclass\s+({NAME})"), ("object_definition", rf"\bobject\s+({NAME})"), ("trait_definition", rf"\btrait\s+({NAME})")), r"^[ \t]*import[ \t]+()([\w.]+)", "import_declaration", "call_expression"),
    "dart": Syntax((("function_signature", rf"^(?:{TYPED}\s*)?({NAME})\s*\([^;{{}}]*\)\s*(?:async\s*)?(?:\{{|=>)"), ("class_definition", rf"\bclass\s+({NAME})"), ("method_signature", rf"^[ \t]+(?:static\s+)?(?:{TYPED}\s*)?({NAME})\s*\([^;{{}}]*\)\s*(?:async\s*)?(?:\{{|=>)")), r"^[ \t]*(?:import|export)[ \t]+(['\"])(.*?)\1", "import_or_export", "call_expression"),
    "zig": Syntax((("function_declaration", rf"\bfn\s+({NAME})"),), r"(?!)()()", "", "call_expression"),
}
STRINGS = r"\"\"\"[\s\S]*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])*'"
COMMENTS = r"/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*"


def blanked(text: str, rust: bool = False) -> str:
    """The text with blanks for comments and the insides of strings; in Rust a lone quote begins a lifetime."""
    strings = STRINGS.replace(r"'(?:\\.|[^'\\\n])*'", r"'(?:\\.|[^'\\\n])'") if rust else STRINGS
    return re.sub(f"{COMMENTS}|{strings}", lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def braces(text: str) -> dict[int, int]:
    """Place of the closing brace of each opening one; those that never close end with the text."""
    out, opened = {}, []
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            opened.append(m.start())
        elif opened:
            out[opened.pop()] = m.end()
    return out | {at: len(text) for at in opened}


def nodes(text: str, language: str) -> Iterator[tuple]:
    """(type, kind, name, text, first line, last line), in the order of the source."""
    syntax, blank = LANGUAGES[language], blanked(text, language == "rust")
    line_starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda at: bisect_right(line_starts, at)
    ends, found, heads = braces(blank), [], set()
    for kind, pattern in syntax.definitions:
        for m in re.finditer(pattern, blank, re.MULTILINE):
            name, at = m[1], m.start() + len(m[0]) - len(m[0].lstrip())
            if name in NOT_NAMES or m.start(1) in heads or re.match(r"(?:return|else|new|throw|await)\b", blank[at:]):
                continue
            # The body is the first brace before the statement ends; without one the definition ends with it.
            stop = re.compile(r"[{;]" if language not in ("go", "swift", "kotlin", "scala") else r"[{\n;]").search(blank, m.end() - (m[0][-1] in "{;"))
            end = len(blank) if stop is None else ends[stop.start()] if stop[0] == "{" else stop.start() + (stop[0] == ";")
            heads.add(m.start(1))
            found.append((at, -end, "definition", kind, name, end))
    spots = []
    for m in re.finditer(syntax.imports, text, re.MULTILINE):
        word = m.start() + len(m[0]) - len(m[0].lstrip())
        # A match within a comment or string is none: its first character is blank there.
        if (blank[word] != " " or language == "go" and in_imports(blank, word)) and m[2]:
            spots.append((m.start(), m.end()))
            found.append((word, -m.end(), "import", syntax.import_kind, m[2], m.end()))
    for m in re.finditer(rf"(?<![\w$.>:#@])({syntax.callee})\s*\(", blank):
        last = re.split(r"\.|::|->", m[1])[-1]
        if last in NOT_NAMES or m[1].split(".")[0] in NOT_NAMES - {"this", "super"} or m.start(1) + len(m[1]) - len(last) in heads or any(a <= m.start() < b for a, b in spots):
            continue
        end = closing(blank, m.end() - 1)
        found.append((m.start(), -end, "call", syntax.call_kind, m[1], end))
    for at, _, kind, node, name, end in sorted(found):
        yield kind, node, name, text[at:end], line(at), line(max(at, end - 1))


def in_imports(blank: str, at: int) -> bool:
    """Whether a line of Go lies in an import declaration."""
    head = blank.rfind("import", 0, at + 6)
    return head >= 0 and not re.search(r"[){}=]", blank[head:at])


def closing(text: str, at: int) -> int:
    """Behind the parenthesis that closes the one at `at`, or the end of the text."""
    depth = 0
    for m in re.compile(r"[()]").finditer(text, at):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            return m.end()
    return len(text)
