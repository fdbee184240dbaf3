"""The stateful repair of one formula, apart from Spark so that workers can import it."""

from __future__ import annotations

import re
import unicodedata

# Control characters, blanks that are folded, and what counts as white space at the ends and before a bracket (the next line U+0085 doesn't, the byte order mark does).
_CONTROLS = "\x00-\x08\x0b\x0c\x0e-\x1f"
_SWALLOWED = re.compile(rf"\\[\n{_CONTROLS}\x7f](?=([)\]])?)")
_CONTROL = re.compile(rf"[{_CONTROLS}\x7f](?=([A-Za-z])?)")
_BLANKS = re.compile("[\u00a0\u2000-\u200b\u202f\u205f\u3000\t]")
_SPACE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_TOKENS = re.compile(rf"(\\[()\[\]]|(?<=[{_SPACE}])[)\]])")


def repair(text: str) -> str:
    """NFC; one kind of line end; a backslash and control character keep the backslash before a closing bracket alone; other controls become a backslash before a letter, else a blank; blanks are folded; a bracket that closes after white space while its delimiter is open gets its backslash."""
    text = unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n")
    text = _SWALLOWED.sub(lambda m: "\\" if m[1] else "", text)
    text = _CONTROL.sub(lambda m: "\\" if m[1] else " ", text)
    text = re.sub(" {2,}", " ", re.sub(" *\n *", " ", _BLANKS.sub(" ", text))).strip(_SPACE)
    depth, out = {")": 0, "]": 0}, []
    for k, part in enumerate(_TOKENS.split(text)):  # the odd ones are tokens
        if part in (r"\(", r"\["):
            depth[")" if part == r"\(" else "]"] += 1
        elif part in (r"\)", r"\]"):
            depth[part[1]] = max(0, depth[part[1]] - 1)
        elif k % 2 and part in depth and depth[part]:
            depth[part] -= 1
            part = "\\" + part
        out.append(part)
    return "".join(out)
