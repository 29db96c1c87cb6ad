"""Text functions of search and navigation: folding, terms, projections, scalar escapes."""

from __future__ import annotations

import json
import re
import unicodedata

# Context words and the context each stands for.
CONTEXT_ALIASES = {
    "call": ("calls", "called", "caller", "callers", "invoke", "invokes", "invoked", "invocation"),
    "import": ("imports", "imported", "module", "modules"),
    "export": ("exports", "exported"),
    "field": ("fields", "property", "properties", "member", "members"),
    "parameter_type": ("param", "params", "parameter", "parameters", "argument", "arguments", "arg", "args"),
    "return_type": ("return", "returns", "returned"),
    "generic_arg": ("generic", "generics", "template", "templates"),
    "attribute": ("annotation", "annotations", "decorator", "decorators"),
    "reference": ("references", "referenced"),
}
# Question words and words of intent that rank nothing.
STOP_WORDS = ("a", "an", "and", "are", "does", "for", "how", "in", "is", "of", "or", "the", "to", "what", "where", "which", "who", "why")
INTENT_WORDS = ("call", "calls", "called", "caller", "callers", "invoke", "invokes", "use", "uses", "used", "using", "import", "imports", "export", "exports", "extend", "extends", "implement", "implements", "depend", "depends", "reference", "references")
PROSE_FIELDS = ("rationale", "description", "summary", "text", "excerpt", "evidence")


def normalize(text: str) -> str:
    """Compatibility-decomposed, without combining marks, in lower case."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def context_alias(word: str) -> str:
    low = normalize(word.strip())
    return next((name for name, words in CONTEXT_ALIASES.items() if low in words), low)


def infer_contexts(text: str) -> list[str]:
    """Contexts that a question's words name."""
    return sorted({a for w in re.split(r"[\W_]+", text) if w and (a := context_alias(w)) in CONTEXT_ALIASES})


def cjk(ch: str) -> bool:
    return "\u3400" <= ch <= "\u9fff" or "\u3040" <= ch <= "\u30ff" or "\uac00" <= ch <= "\ud7af" or "\uf900" <= ch <= "\ufaff" or "\U00020000" <= ch <= "\U0003ffff"


def search_terms(text: str) -> list[str]:
    """One to eight distinct terms of a query, without question words and, if others remain, words of intent."""
    words: set[str] = set()
    for w in re.split(r"[\W_]+", unicodedata.normalize("NFKC", text)):
        if len(w) > 2 and all(map(cjk, w)):
            words.update(w[i : i + 2] for i in range(len(w) - 1))
        elif w:
            words.add(w)
    terms = [w for w in sorted(words) if normalize(w) not in STOP_WORDS] or sorted(words)
    meant = [w for w in terms if normalize(w) not in INTENT_WORDS]
    terms = meant or terms
    if not 1 <= len(terms) <= 8:
        raise ValueError("a query needs 1 to 8 distinct terms besides question words")
    return terms


def attributes(metadata: str | None) -> dict:
    """Innermost metadata below any layers of provenance; what is no JSON object is an empty one."""
    try:
        value = json.loads(metadata) if metadata else {}
    except ValueError:
        return {}
    while isinstance(value, dict) and "original_metadata" in value:
        value = value["original_metadata"]
    return value if isinstance(value, dict) else {}


def _leaves(value) -> list[str]:
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in (k, *_leaves(v))]
    if isinstance(value, list):
        return [x for v in value for x in _leaves(v)]
    return [value if isinstance(value, str) else json.dumps(value)]


def search_text(id_: str | None, label: str | None, qualified: str | None, file: str | None, metadata: str | None) -> str:
    """What search sees of a node: names, file, prose fields and attributes; split at case and underscores, folded, with CJK bigrams."""
    attrs = attributes(metadata)
    parts = [id_ or "", label or "", qualified or "", file or "", *[attrs[f] for f in PROSE_FIELDS if isinstance(attrs.get(f), str)]]
    if isinstance(attrs.get("attributes"), dict):
        parts += _leaves(attrs["attributes"])
    flat = unicodedata.normalize("NFKC", " ".join(parts))
    parts = [flat, re.sub(r"(?<=[^\W_A-Z])(?=[A-Z])", " ", flat).replace("_", " ")]
    folded = normalize(flat)
    if folded != flat.lower():
        parts.append(folded)
    for run in re.findall("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff]+", flat):
        parts += [*run, *[run[i : i + 2] for i in range(len(run) - 1)]]
    return " ".join(parts)


def tokens(text: str) -> list[str]:
    """Distinct postings of a text: folded runs of letters and digits."""
    return sorted(set(re.findall(r"[^\W_]+", normalize(text))))


def relative_path(base: str, target: str) -> str | None:
    """A link resolved against the file it stands in; null if it climbs above the root."""
    parts = base.split("/")[:-1] if not target.startswith("/") else []
    for p in target.split("/"):
        if p == "..":
            if not parts:
                return None
            parts.pop()
        elif p not in ("", "."):
            parts.append(p)
    return "/".join(parts)


def cut_label(text: str, most: int = 80) -> str:
    """The first ``most`` characters, cut at a word."""
    flat = " ".join(text.split())
    if len(flat) <= most:
        return flat
    head = flat[: most + 1].rsplit(" ", 1)[0]
    return (head if 0 < len(head) <= most else flat[:most]).rstrip()


def mermaid_escape(text: str) -> str:
    return "".join(c if c.isascii() and c.isalnum() else f"#{ord(c)};" for c in text)


def xml_escape(text: str) -> str:
    """Escaped text; characters that XML cannot hold are an error."""
    if re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", text):
        raise ValueError("a control character that XML cannot hold")
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def cypher_escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r")
