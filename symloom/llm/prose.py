"""Prose of a document: what is left when code, tables, links and quotations are taken out."""

from __future__ import annotations

import html
import re

_LINK = re.compile(r"!?\[([^\]\n]*)\]\([^)\n]*\)|<?\b(?:https?|ftp|mailto):[^\s>)]+>?|<[^<>\n]{1,200}>")
_CODE = re.compile(r"`[^`\n]*`")
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“”\n]*[“”]")
_ITEM = re.compile(r"(?:[-*+]|\d+[.)])[ \t]+")
_WORD = re.compile(r"[^\W\d_]{2,}")
_STOP = re.compile(r"[.!?]+\s+|\n")

# Frequent function words that tell the three languages of the corpus apart.
FUNCTION_WORDS = {
    "en": frozenset("the and of to is that in it for with are was which when has not this be by from or its".split()),
    "de": frozenset("der die das und ist nicht ein eine einen mit auf den dem des wird werden sich auch wenn zu im von".split()),
    "es": frozenset("el la los las y es de que en un una no con por para se del al cuando si su lo como más".split()),
}


def plain(text: str) -> str:
    """The prose of a text, one paragraph or list item a line."""
    if "&" in text:
        text = html.unescape(text)
    out: list[str] = []
    fence, open_ = "", False
    for line in text.splitlines():
        s = line.strip()
        if fence:
            if s.startswith(fence):
                fence = ""
            continue
        if s[:3] in ("```", "~~~"):
            fence, open_ = s[:3], False
            continue
        if not s or s[0] in "|>#=" or (not open_ and line[:1] in " \t" and (line[:4] == "    " or line[0] == "\t")):
            open_ = False
            continue
        item = _ITEM.match(s) if s[0] in "-*+0123456789" else None
        if item:
            s = s[item.end() :]
        if open_ and not item:
            out[-1] += " " + s
        else:
            out.append(s)
        open_ = True
    text = "\n".join(out)
    if "`" in text:
        text = _CODE.sub(" ", text)
    if "://" in text or "](" in text or "<" in text:
        text = _LINK.sub(lambda m: m.group(1) or " ", text)
    if '"' in text or "“" in text or "«" in text or "„" in text:
        text = _QUOTED.sub(" ", text)
    return text


def sentences(text: str | None) -> list[list[str]]:
    """Lower-cased words of each sentence of the prose; an empty list for null or a text without prose."""
    if not text:
        return []
    return [w for s in _STOP.split(plain(text).lower()) if len(w := _WORD.findall(s)) >= 3]


def language(counts: dict[str, int]) -> str:
    """The language whose function words are most frequent among counted words; '' where there are none."""
    best, name = 0, ""
    for lang, known in FUNCTION_WORDS.items():
        n = sum(counts.get(w, 0) for w in known)
        if n > best:
            best, name = n, lang
    return name
